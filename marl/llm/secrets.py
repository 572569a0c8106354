"""Secret scans with multipart credential linking, in DataFrame functions alone.

Base spans, leftmost and not overlapping within a kind, failing matches dropped but still consumed:
assign (a keyword, `:` or `=`, and a value of 12 or more characters), access (`AKIA...`, 18 or more), hex
(16 or more). Weak candidates are no evidence by themselves: key (40 base64 characters that are not hex; a
`=` may stand before it, as in KEY=VALUE, but not behind it) and endpoint (a URL). Within a scope, at most
`SCOPE` code points between two spans of a document, a key is reported beside an access identifier, and an
endpoint beside an access identifier and a secret (an assign, a hex or a reported key).

Spans are found by splitting a text at its matches: gaps and matches give every start. The interval join is
a merge over spans sorted by start (running maxima of ends, minima of starts), so it costs no pairs; only
documents with an access identifier and a weak candidate enter it, and they enter as spans, not as texts.

Defined results: null and empty texts have no spans and empty strings; repeated rows, null and repeated
doc_ids keep one result a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marl.llm import common
from marl.llm.arrays import before

SCOPE = 200
KINDS = ("assign", "access", "hex", "key", "endpoint")
#: What a match looks like. `access` and `hex` are maximal runs, so the least length can stand in the pattern
#: without changing what is consumed; for `assign` it can't.
_KEYWORD = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
_VALUE = r"[A-Za-z0-9+/_.=-]+"
PATTERNS = {
    "assign": _KEYWORD + _VALUE,
    "access": r"AKIA[A-Z0-9]{14,}",
    "hex": r"[0-9a-f]{16,}",
    "key": r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])",
    "endpoint": r"""https?://[^\x20\x09-\x0D"'<>]+""",
}
ASSIGN_VALUE = 12

_SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def spans(text: Column, kind: str) -> Column:
    """The spans (start, kind, end) of a kind, in code points, ascending."""
    pattern = F.lit(PATTERNS[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.slice(F.split(text, PATTERNS[kind], -1), 1, F.size(found))
    widths = F.zip_with(gaps, found, lambda g, m: F.char_length(g) + F.char_length(m))
    starts = F.zip_with(before(widths), gaps, lambda b, g: b + F.char_length(g))
    number = F.lit(KINDS.index(kind))
    made = F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), number.alias("kind"), (s + F.char_length(m)).alias("end"), m.alias("text")))
    if kind == "assign":
        made = F.filter(made, lambda x: F.char_length(F.regexp_replace(x["text"], "^" + _KEYWORD, "")) >= ASSIGN_VALUE)
    if kind == "key":
        made = F.filter(made, lambda x: ~x["text"].rlike("^[0-9a-f]{40}$"))
    plain = F.transform(made, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return F.when(text.rlike(PATTERNS[kind]), plain).otherwise(F.array().cast(_SPAN))


def _joined(column: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _near(wanted: Column, scope: int) -> Column:
    """Whether a span of the same row that is `wanted` lies within the scope."""
    rise = Window.partitionBy("row").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fall = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind"), F.desc("end")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = F.max(F.when(wanted, F.col("end"))).over(rise)
    right = F.min(F.when(wanted, F.col("start"))).over(fall)
    return F.coalesce(F.col("start") - left <= scope, F.lit(False)) | F.coalesce(right - F.col("end") <= scope, F.lit(False))


def _linked(found: DataFrame, scope: int) -> DataFrame:
    """(row, weak): the weak candidates beside their complements."""
    access, key, endpoint = (KINDS.index(k) for k in ("access", "key", "endpoint"))
    both = found.where((F.size("weak") > 0) & F.exists("base", lambda s: s["kind"] == access))
    flat = both.select("row", F.explode(F.concat("base", "weak")).alias("s")).select("row", "s.start", "s.kind", "s.end")
    flat = flat.withColumn("by_access", _near(F.col("kind") == access, scope))
    secret = F.col("kind").isin(KINDS.index("assign"), KINDS.index("hex")) | ((F.col("kind") == key) & F.col("by_access"))
    flat = flat.withColumn("by_secret", _near(secret, scope))
    reported = flat.where(F.col("by_access") & ((F.col("kind") == key) | ((F.col("kind") == endpoint) & F.col("by_secret"))))
    return reported.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, reported): arrays of (start, kind, end) for every row, ascending; kind is an index of KINDS."""
    rows = common.texts(docs, id_col, text_col)
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(F.concat(*(spans(text, k) for k in KINDS[:3])))
    weak = F.concat(*(spans(text, k) for k in KINDS[3:]))
    found = common.materialise(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", base.alias("base"), weak.alias("weak")), "spans")
    linked = F.coalesce(F.col("linked"), F.array().cast(_SPAN))
    return found.join(_linked(found, scope), "row", "left").select("doc_id", "base", F.array_sort(F.concat("base", linked)).alias("reported"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("reported")).alias("spans"))


QUERIES = {"op9_secrets": op9_secrets}


def _sql_spans(kind: int, pattern: str, keep: str) -> str:
    """Spans of a pattern in SQL, from the gaps between its matches; `keep` is a condition on the match m."""
    return f"""SELECT r, {kind} AS kind, m, stop - length(m) AS start, stop FROM (
  SELECT r, m, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS stop FROM (
    SELECT r, unnest(regexp_extract_all(text, '{pattern}')) AS m, unnest(string_split_regex(text, '{pattern}')) AS g,
           generate_subscripts(string_split_regex(text, '{pattern}'), 1) AS i
    FROM d) WHERE m IS NOT NULL) WHERE {keep}"""


#: The patterns again, without look-around: a key is a run of 40 base64 characters that no `=` follows. `r` numbers the rows.
_ANY_CASE = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in k) for k in ("password", "passwd", "secret", "token", "api_?key"))
_HEAD = f"""(?:{_ANY_CASE})["'']?\\x20*[:=]\\x20*["'']?"""
_SQL = " UNION ALL ".join(
    [
        _sql_spans(0, _HEAD + _VALUE, f"length(regexp_replace(m, '^{_HEAD}', '')) >= {ASSIGN_VALUE}"),
        _sql_spans(1, "AKIA[A-Z0-9]+", "length(m) >= 18"),
        _sql_spans(2, "[0-9a-f]+", "length(m) >= 16"),
        _sql_spans(3, "[A-Za-z0-9+/]+=?", "regexp_full_match(m, '[A-Za-z0-9+/]{40}') AND NOT regexp_full_match(m, '[0-9a-f]{40}')"),
        _sql_spans(4, r"""https?://[^\x20\x09-\x0D"''<>]+""", "true"),
    ]
)
_BESIDE = "EXISTS (SELECT 1 FROM {0} o WHERE o.r = s.r AND o.start - s.stop <= {1} AND s.start - o.stop <= {1})"

ORACLES = {
    "op9_secrets": f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS MATERIALIZED ({_SQL}),
access AS (SELECT * FROM s WHERE kind = 1),
keys AS MATERIALIZED (SELECT * FROM s WHERE kind = 3 AND {_BESIDE.format("access", SCOPE)}),
secret AS (SELECT * FROM s WHERE kind IN (0, 2) UNION ALL SELECT * FROM keys),
ends AS (SELECT * FROM s WHERE kind = 4 AND {_BESIDE.format("access", SCOPE)} AND {_BESIDE.format("secret", SCOPE)}),
shown AS (
  SELECT r, kind, start, stop, {list(KINDS)}[kind + 1] || ':' || start || ':' || stop AS span
  FROM (SELECT * FROM s WHERE kind < 3 UNION ALL SELECT * FROM keys UNION ALL SELECT * FROM ends))
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, kind), '') AS spans
FROM d LEFT JOIN shown USING (r) GROUP BY d.r, d.doc_id
"""
}
