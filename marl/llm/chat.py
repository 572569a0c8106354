"""Chat formatting by event-sourced reconstruction, in DataFrame functions alone.

A log holds events (conv_id, seq, message, role, op, text) of three kinds: `delta` appends text to its
message, `edit` replaces it, `regenerate` empties it. Events are partitioned by conversation and sorted by
seq; folding a message takes what follows its last edit or regeneration, so its cost is linear. Messages
are rendered in the order of `message`:

    <|im_start|>role\\n text <|im_end|>\\n        (without the blanks)

Control strings inside texts and roles, those of other common templates too, get a backslash after their
first character; strings that already look escaped get one more, so unescaping is exact. `%` and line ends
in roles are percent-coded. The loss mask has one (start, length) a message in code points of the formatted text;
its length is 0 but for the assistant. `read_back` takes turns and loss text from the formatted text and the
mask alone.

All exchanges are by conv_id, once: a conversation is one formatted text and so one row.

Defined results: null texts and roles count as empty; events that repeat in every respect count once (logs
are delivered at least once); events with the same seq apply by kind and text; a null conv_id is one
conversation; a conversation without events doesn't exist; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marl.llm import common
from marl.llm.arrays import before

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LEARNED = "assistant"
#: Code points of a delta of a log that `log_of` makes.
DELTA = 512

#: Control strings without their first character, `<` or `[`.
_TAILS = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>"
_RAW = rf"([<\[])(\\*)({_TAILS})"
_ESCAPED = rf"([<\[])\\(\\*)({_TAILS})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _RAW, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _role_out(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def log_of(turns: DataFrame) -> DataFrame:
    """A log that leads to the rows (conv_id, turn, role, text): messages by turn, role and text.

    Of three messages, one is streamed in deltas; the next streams a draft, is regenerated and streamed; the
    third streams a draft that an edit replaces after all messages have been streamed. A draft is the beginning
    of the text backwards, so folding must undo it.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    rows = rows.withColumn("message", F.row_number().over(order).cast("long"))
    last = F.floor(F.greatest(F.char_length("text") - 1, F.lit(0)) / DELTA).cast("int")
    again, edited = F.pmod("message", F.lit(3)) == 1, F.pmod("message", F.lit(3)) == 2
    whole = F.sequence(F.when(again, -2).otherwise(0), last)  # -2 is the draft, -1 what ends it
    parts = rows.select("*", F.explode(F.when(edited, F.array(F.lit(-2), F.lit(-1))).otherwise(whole)).alias("part"))
    draft, ends = F.col("part") == -2, F.col("part") == -1
    op = F.when(ends & again, "regenerate").when(ends, "edit").otherwise("delta")
    said = F.when(draft, F.reverse(F.substring("text", 1, DELTA))).when(ends & again, F.lit(None)).when(ends, F.col("text")).otherwise(F.substring("text", F.col("part") * DELTA + 1, F.lit(DELTA)))
    seq = F.col("message") * (1 << 32) + F.col("part") + F.when(ends & edited, F.lit(1 << 62)).otherwise(F.lit(2))
    return parts.select("conv_id", seq.alias("seq"), "message", "role", op.alias("op"), said.alias("text"))


def fold(log: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): every message as its events leave it; the last role given holds."""
    rows = log.select(F.col("conv_id").cast("long").alias("conv_id"), "seq", "message", "role", "op", F.coalesce("text", F.lit("")).alias("text"))
    event = F.struct("seq", "op", "text")
    logs = rows.groupBy("conv_id", "message").agg(F.array_sort(F.array_distinct(F.collect_list(event))).alias("log"), F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"))
    place = F.transform("log", lambda e, i: F.when(e["op"] != "delta", i).otherwise(F.lit(-1)))
    last = F.greatest(F.array_max(place), F.lit(0))
    rest = F.slice("log", last + 1, F.size("log"))
    text = F.array_join(F.transform(rest, lambda e: F.when(e["op"] == "regenerate", F.lit("")).otherwise(e["text"])), "")
    return logs.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss) of folded messages."""
    shown = messages.select("conv_id", "message", (F.col("role") == LEARNED).alias("learned"), F.concat(F.lit(OPEN), _role_out(F.col("role")), F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"))
    whole = shown.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("message", "head", "body", "learned"))).alias("turns"))
    length = lambda t: F.char_length(t["head"]) + F.char_length(t["body"]) + len(CLOSE)
    mask = F.zip_with(
        "turns",
        before(F.transform("turns", length)),
        lambda t, at: F.struct((at + F.char_length(t["head"])).alias("start"), F.when(t["learned"], F.char_length(t["body"])).otherwise(F.lit(0)).cast("long").alias("length")),
    )
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "")
    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"), text.alias("formatted"), mask.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns (role, text), loss_texts) from `formatted` and `loss`."""
    end = F.split("formatted", r"<\|im_end\|>\n", -1)
    pieces = F.slice(end, 1, F.size(end) - 1)
    cut = formatted.withColumn("pieces", pieces)
    role = lambda p: F.substring_index(F.substring(p, len(OPEN) + 1, F.char_length(p)), "\n", 1)
    turn = lambda p: F.struct(_role_in(role(p)).alias("role"), unescape(F.substring(p, F.char_length(role(p)) + len(OPEN) + 2, F.char_length(p))).alias("text"))
    begins = before(F.transform("pieces", lambda p: F.char_length(p) + len(CLOSE)))
    placed = F.zip_with("pieces", begins, lambda p, at: F.struct(p.alias("piece"), at.alias("at")))
    under = F.zip_with(placed, "loss", lambda p, m: unescape(F.substring(p["piece"], (m["start"] - p["at"] + 1).cast("int"), m["length"].cast("int"))))
    return cut.select("conv_id", "formatted", F.transform("pieces", turn).alias("turns"), under.alias("loss_texts"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise(LEARNED).alias("role"), said.alias("text"))
    read = read_back(render(fold(log_of(turns.unionByName(own)))))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"))


QUERIES = {"op8_chat": op8_chat}
ORACLES = {
    "op8_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(replace(replace(role, '%', '%25'), chr(10), '%0A')) + length(text) + 12 + 1 + 11
         + len(regexp_extract_all(text || chr(10) || role, '[<\[]\\*(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)')) AS n
  FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
}
