"""Language ID by a bidirectional gated recurrent network over bytes.

The network labels every byte of a whole text; a document's probabilities are the means over its positions,
the language is the likeliest, the score its mean probability. It learns from text and language alone, of
rows with a language whose crc32(doc_id as text) mod 3 is not `HELD`: about `PER_LANGUAGE` documents a
language, drawn by a hash of doc_id, and of each `PER_DOCUMENT` segments spread over the whole text, for the
`LANGUAGES` languages with the most such rows. These three bounds are all that training sees, whatever the
table's size; the driver trains on those segments. A text's score depends on the text alone: the network runs
over blocks of one fixed width, and scores are rounded to `DIGITS` digits.

Defined results: a null text, or one without a letter, is `und` with score 0, and so is every text if no row can
be learned from; a null doc_id counts as an empty string in the split; repeated rows get equal results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marl.llm import bigru, common
from marl.llm.mixing import uniform

#: Of the split by crc32(doc_id as text) mod 3, the part that is never learned from.
HELD = 1
#: Bounds of the sample that the network is fitted on.
PER_LANGUAGE, PER_DOCUMENT, LANGUAGES = 300, 12, 64
DIGITS = 6
UNDETERMINED = "und"
#: A filter keeps documents from this score on; clean short texts score above it.
LEAST = 0.3

_LETTER = regex.compile(r"\p{L}")

PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == HELD


def _cut(batches: Iterator[pa.RecordBatch], per_document: int) -> Iterator[pa.RecordBatch]:
    """Segments spread over each text."""
    for batch in common.rows_of(batches):
        langs, keys, parts = [], [], []
        for lang, key, text in zip(batch.column("lang").to_pylist(), batch.column("key").to_pylist(), common.as_bytes(batch.column("text")), strict=True):
            last = max(0, len(text) - bigru.SEGMENT)
            for at in sorted(set(np.linspace(0, last, per_document).astype(int).tolist())):
                langs.append(lang)
                keys.append(key)
                parts.append(text[at : at + bigru.SEGMENT])
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.float64()), pa.array(parts, pa.binary())], names=["lang", "key", "part"])


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, per_document: int = PER_DOCUMENT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, float, bytes]]:
    """(language, draw, segment) of the bounded sample, sorted: the same for the same rows in any order."""
    common.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not n:
        return []
    share = F.create_map(*(F.lit(x) for lang, count in sorted(n.items()) for x in (lang, min(1.0, per_language / count))))
    drawn = rows.where(F.col("lang").isin(*sorted(n))).withColumn("key", uniform(F.concat(F.lit("langid:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))).where(F.col("key") < share[F.col("lang")])
    parts = drawn.mapInArrow(lambda b: _cut(b, per_document), "lang string, key double, part binary")
    most = 2 * len(n) * per_language * per_document  # a draw is about per_language documents a language; this is the firm bound
    return sorted((r["lang"], r["key"], bytes(r["part"])) for r in parts.orderBy("key", "lang", "part").limit(most).collect())


def fit(docs: DataFrame, **columns: str) -> tuple[list[str], list[np.ndarray]]:
    """(languages, weights) learned from a sample of `docs`; no languages if there is nothing to learn from."""
    rows = sample(docs, **columns)
    langs = sorted({lang for lang, _, _ in rows})
    if not langs:
        return [], []
    data, lengths, _ = bigru.segments([part for _, _, part in rows])
    labels = np.array([langs.index(lang) for lang, _, _ in rows])
    return langs, bigru.train(data, lengths, labels, len(langs)).arrays()


def predict(texts: list[bytes | None], langs: list[str], weights: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
    """Languages and scores of some texts."""
    clear = [bool(langs) and t is not None and _LETTER.search(t.decode("utf-8", "replace")) is not None for t in texts]
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    at = np.flatnonzero(clear)
    if len(at):
        own = [texts[i] for i in at]
        data, lengths, count = bigru.segments(own)
        first = np.cumsum(count) - count
        p = np.add.reduceat(bigru.pooled(bigru.Network.of(weights), data, lengths), first, axis=0) / np.array([len(t) for t in own])[:, None]
        best = p.argmax(axis=1)
        scores[at] = np.round(np.clip(p[np.arange(len(at)), best], 0, 1), DIGITS)
        for i, k in zip(at.tolist(), best.tolist(), strict=True):
            names[i] = langs[k]
    return names, scores


def _predicted(batches: Iterator[pa.RecordBatch], langs: list[str], weights: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in common.rows_of(batches):
        names, scores = predict(common.as_bytes(batch.column("text")), langs, weights)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])


def _kept(batches: Iterator[pa.RecordBatch], text_at: int, langs: list[str], weights: list[np.ndarray], least: float) -> Iterator[pa.RecordBatch]:
    for batch in common.rows_of(batches):
        names, scores = predict(common.as_bytes(batch.column(text_at)), langs, weights)
        yield batch.filter(pa.array([n != UNDETERMINED and s >= least for n, s in zip(names, scores, strict=True)]))


def identify(docs: DataFrame, langs: list[str], weights: list[np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """PREDICTED for every row, by a fitted network."""
    common.bounded_batches(docs.sparkSession)
    rows = common.texts(docs, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(lambda b: _predicted(b, langs, weights), PREDICTED)


def keep_determined(docs: DataFrame, langs: list[str], weights: list[np.ndarray], least: float = LEAST, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose language is determined with a score of `least` or more."""
    common.bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    return docs.mapInArrow(lambda b: _kept(b, at, langs, weights, least), docs.schema)


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return identify(docs, *fit(docs))


QUERIES = {"op1_langid": op1_langid}
ORACLES: dict[str, str] = {}
