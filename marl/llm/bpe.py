"""Byte-level BPE over Arrow batches with the tokenizers library.

A rank file (one base64 token and its rank a line) becomes a model of that library: bytes map to the visible
characters that byte-level models use, and every way to put a token together from two others is a merge, in
the order of the ranks, so merging by pair equals merging by rank. Text is split by the pattern; each distinct
piece is encoded once by a worker and kept, so a batch costs look-ups; a store beyond `PIECES` is cut back, but only
between texts, so a text of any number of pieces has all of its own.

Where merges of one rank overlap, the leftmost pair must win, whereas the library prefers the pair listed
first. Only a token that overlaps itself has such merges; pieces holding one are merged by `merged` below, the
same rule written out.

Decoding maps ids to characters and characters back to bytes and joins bytes before decoding them, so characters
that tokens split come out whole; `Decoder` does so for a stream of ids.

Defined results: null and empty texts have no ids and decode to no bytes; repeated rows and null doc_ids
keep one result a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import codecs
import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import accumulate, chain, islice

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import models

from marl.llm import common

#: Distinct pieces that a worker keeps from text to text; beyond it only the first met, as a rule the frequent ones, stay.
PIECES, FIRST = 300_000, 120_000

ENCODED = "doc_id long, ids array<int>"
OFFSETS = "doc_id long, ids array<int>, starts array<int>, ends array<int>"


def byte_characters() -> list[str]:
    """The character of each byte: itself if visible in Latin-1, else the next free one from U+0100."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merging by rule: again and again the leftmost of the adjacent pairs with the least rank."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)
    live = [True] * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not live[i] or j >= n or end[j] != stop:
            continue
        live[j], end[i], after[i] = False, stop, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and (b := after[a]) < n and (rank := ranks.get(piece[a : end[b]])) is not None:
                heapq.heappush(heap, (rank, a, end[b]))
    return [ranks[piece[i : end[i]]] for i in range(n) if live[i]]


def chains(token: bytes) -> list[bytes]:
    """A token overlapping itself, in every way that it can."""
    return [token + token[k:] for k in range(1, len(token)) if token[:k] == token[-k:]]


class Codec:
    """Encoding and decoding by one rank file; a worker makes it once."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern)
        table = byte_characters()
        shown = {token: "".join(table[b] for b in token) for token in ranks}
        merges, risky = [], ahocorasick.Automaton()
        for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
            cuts = [k for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]
            merges += [(shown[token[:k]], shown[token[k:]]) for k in cuts]
            if len(cuts) > 1:
                for chain_ in chains(token):
                    risky.add_word(chain_.decode("latin-1"), True)
        self.model = models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True, cache_capacity=0)
        self.character = dict(enumerate(table))
        self.characters = {r: shown[t] for t, r in ranks.items()}
        byte_of = {c: b for b, c in enumerate(table)}
        self.bytes = {r: bytes(byte_of[c] for c in s) for r, s in self.characters.items()}
        risky.make_automaton()
        self.risky = risky if len(risky) else None
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _risky_among(self, data: list[str]) -> set[int]:
        """Positions of the pieces, bytes as code points, in which a token overlaps itself: one search through all of them."""
        if self.risky is None:
            return set()
        ends = list(accumulate(map(len, data)))
        found = set()
        for at, _ in self.risky.iter("".join(data)):  # a hit across two pieces costs a needless merge, no more
            found.add(bisect.bisect_right(ends, at))
        return found

    def learn(self, new: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of pieces that aren't kept yet."""
        data = [p.encode().decode("latin-1") for p in new]
        tokens, character = self.model.tokenize, self.character
        learnt = {piece: tuple([t.id for t in tokens(raw.translate(character))]) for piece, raw in zip(new, data, strict=True)}
        for i in self._risky_among(data):
            learnt[new[i]] = tuple(merged(new[i].encode(), self.ranks))
        return learnt

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            found = self.split.findall(text)
            known = self.pieces
            if new := set(found).difference(known):
                known.update(self.learn(list(new)))
            out.append(list(chain.from_iterable(map(known.__getitem__, found))))
            if len(known) > PIECES:  # only now that the text is done
                self.pieces = dict(islice(known.items(), FIRST))
        return out

    def offsets(self, text: str, ids: list[int]) -> tuple[list[int], list[int]]:
        """For each id the code points it touches: start, and end (exclusive). A split character belongs to all its tokens."""
        at, place = [], 0
        for i, c in enumerate(text):
            at += [i] * len(c.encode())
        starts, ends = [], []
        for i in ids:
            stop = place + len(self.bytes[i])
            starts.append(at[place])
            ends.append(at[stop - 1] + 1)
            place = stop
        return starts, ends

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Decoder:
    """Text of a stream of ids: what a character lacks is held back until its bytes are there."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.partial = codec, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int], final: bool = False) -> str:
        return self.partial.decode(self.codec.decode(ids), final)


_made: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _made:
        _made[path, pattern] = Codec(read_ranks(path), pattern)
    return _made[path, pattern]


def encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str, offsets: bool = False) -> Iterator[pa.RecordBatch]:
    own = codec(path, pattern)
    for batch in common.rows_of(batches):
        texts = [(t or b"").decode("utf-8", "replace") for t in common.as_bytes(batch.column("text"))]
        ids = own.encode(texts)
        columns = [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))]
        if offsets:
            both = [own.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
            columns += [pa.array([b[k] for b in both], pa.list_(pa.int32())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "starts", "ends"][: len(columns)])


def decoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    own = codec(path, pattern)
    for batch in common.rows_of(batches):
        out = [own.decode(i or []) for i in batch.column("ids").to_pylist()]
        yield batch.append_column("decoded", pa.array(out, pa.binary()))


def _mapped(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    common.bounded_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) for every row, with `offsets` also the code points (starts, ends) of each id."""
    return _mapped(common.texts(docs, id_col, text_col), lambda b: encoded(b, path, pattern, offsets), OFFSETS if offsets else ENCODED)


def decode(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) of (doc_id, ids); decoded is bytes."""
    return _mapped(ids.select("doc_id", "ids"), lambda b: decoded(b, path, pattern), ENCODED + ", decoded binary")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch], path: str, pattern: str, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """Encodes, decodes the ids, and gives digests of both, with the ids if they are wanted."""
    own = codec(path, pattern)
    decimal = {i: str(i) for i in own.bytes}
    for batch in common.rows_of(batches):
        texts = [(t or b"").decode("utf-8", "replace") for t in common.as_bytes(batch.column("text"))]
        n, shown, back = [], [], []
        all_ids = own.encode(texts)
        for ids in all_ids:
            n.append(len(ids))
            shown.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
            back.append(hashlib.sha256(own.decode(ids)).hexdigest())
        out = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(shown, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
        if keep_ids:
            out["ids"] = pa.array(all_ids, pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def digests(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """DIGESTS for every row: of its ids, joined by commas, and of the bytes that the ids decode to; with `keep_ids` also `ids`."""
    return _mapped(common.texts(docs, id_col, text_col), lambda b: _digests(b, path, pattern, keep_ids), DIGESTS + ", ids array<int>" * keep_ids)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op6_bpe": op6_bpe}
ORACLES: dict[str, str] = {}
