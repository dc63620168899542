"""Best-fit packing of token pieces into sequences, by vectors of capacities.

A sequence has room for tokens, documents and attention cost (the sum of its
pieces' squared lengths). Pieces go longest first into the open sequence that
fits best under every limit: the one with the least weighted norm of what then
remains ("norm"), or with the largest weighted product of what it has left and
what the piece needs ("dot"). If none fits, a new sequence opens. A limit that
isn't given is what a sequence full of tokens needs at most, ``room`` documents
and a cost of room squared: it refuses nothing, yet what is left of it weighs.

A document with more tokens than a sequence is cut into full pieces, of which
the first may be shorter; nothing else is cut. Full pieces are sequences of
their own. The others are dealt to buckets of about ``bucket_pieces`` by a hash
of their row number, so no bucket depends on one source or one document; each
is packed by itself, and what is left not quite full meets again, in fewer
buckets, in a second round.

Defined cases: a null text is the empty text and gives a piece with the end id
alone; rows that share an id are packed each for itself; an empty table gives an
empty result; a piece that breaks a limit even alone (attention cost) gets a
sequence of its own; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, materialize, tidy, whole
from .tokens import CACHE_WORDS, word_ids

#: Of the residual's tokens, documents and attention cost, each as a share of its limit.
WEIGHTS = (1.0, 0.3, 0.3)
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def cut(n: int, room: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens."""
    head = n % room
    return ([(0, head)] if head else []) + [(at, room) for at in range(head, n, room)]


def token_pieces(docs: DataFrame, tokenizer: str, room: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cache_words: int = CACHE_WORDS, keep_words: bool = True) -> DataFrame:
    """The pieces of each row of docs, with their ids if asked for. keep_words: a worker remembers words from task to task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(tokenizer, cache_words), np.array([end_id], np.uint32)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, coded in zip(batch.column(0).to_pylist(), words.encode_all(batch.column(1)), strict=True):
                ids = np.concatenate((coded, end), dtype="<u4")
                for i, (start, n) in enumerate(cut(len(ids), room)):
                    raw = ids[start : start + n].tobytes()
                    for to, value in zip(out, (doc_id, i, start, n, zlib.crc32(raw), raw if with_ids else None), strict=True):
                        to.append(value)
            arrays = [pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays(arrays[: 5 + with_ids], names[: 5 + with_ids])
        if not keep_words:
            words.forget()
            tidy()

    rows = docs.select(col(docs, id_col).cast("long").alias("doc_id"), whole(col(docs, text_col)).alias("text"))
    return rows.mapInArrow(run, PIECES + ", ids binary" * with_ids)


class Bins:
    """Open sequences of one bucket, in order of opening: what each has left of every capacity."""

    def __init__(self, room: np.ndarray, weights: np.ndarray, rule: str, most: int):
        self.room, self.weights, self.rule = room, weights / room**2, rule
        self.left = np.empty((len(room), most))  # by capacity
        self.names = np.empty(most, np.int64)
        self.open = self.opened = 0

    def place(self, need: tuple[float, ...]) -> int:
        left, w = self.left, self.weights
        # tokens tell most sequences that can't
        fits = np.flatnonzero(left[0, : self.open] >= need[0])
        if len(fits):
            fits = fits[(left[1, fits] >= need[1]) & (left[2, fits] >= need[2])]
        if len(fits):
            t, d, c = left[0, fits], left[1, fits], left[2, fits]
            if self.rule == "norm":
                score = w[0] * (t - need[0]) ** 2 + w[1] * (d - need[1]) ** 2 + w[2] * (c - need[2]) ** 2
            else:
                score = -(w[0] * need[0] * t + w[1] * need[1] * d + w[2] * need[2] * c)
            best = int(fits[np.argmin(score)])
        else:
            best = self.open
            left[:, best] = self.room
            self.names[best] = self.opened
            self.open += 1
            self.opened += 1
        left[:, best] -= need
        return int(self.names[best])

    def close(self, tokens: int) -> None:
        """Forget sequences with room for fewer tokens, or for no further document."""
        n = self.open
        stay = np.flatnonzero((self.left[0, :n] >= tokens) & (self.left[1, :n] >= 1))
        if len(stay) < n:
            self.open = len(stay)
            self.left[:, : self.open] = self.left[:, stay]
            self.names[: self.open] = self.names[stay]


def best_fit(lengths: np.ndarray, room: int, max_docs: int | None = None, max_cost: int | None = None, weights: tuple[float, float, float] = WEIGHTS, rule: str = "norm") -> np.ndarray:
    """The sequence (from 0) of each piece."""
    max_cost = max_cost or room * room
    bins = Bins(np.array([room, max_docs or room, max_cost], float), np.array(weights), rule, len(lengths) + 1)
    out = np.empty(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    least = int(lengths.min()) if len(lengths) else 0
    for n, i in enumerate(order):
        k = int(lengths[i])
        out[i] = bins.place((k, 1, min(k * k, max_cost)))
        if not n % 64:
            bins.close(least)
    return out


def pack_bucket(pdf: pd.DataFrame, room: int, max_docs: int | None, max_cost: int | None, rule: str, weights: tuple[float, float, float]) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "rid"], ascending=[False, True], ignore_index=True)
    pdf["bin"] = best_fit(pdf["length"].to_numpy(), room, max_docs, max_cost, weights, rule)
    by = pdf.groupby("bin", sort=False)["length"]
    pdf["offset"] = (by.cumsum() - pdf["length"]).astype("int64")
    pdf["filled"] = by.transform("sum").astype("int64")
    return pdf


def pack(pieces: DataFrame, room: int = 1024, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm", weights: tuple[float, float, float] = WEIGHTS, bucket_pieces: int = 8192, loose: float = 0.98) -> DataFrame:
    """pieces with sequence_id and offset. pieces has a column length; its others pass through, and clash with none but these two."""
    columns = pieces.columns
    kept = materialize(pieces.withColumn("rid", F.monotonically_increasing_id()), "pieces")
    small = kept.where(F.col("length") < room)
    full = kept.where(F.col("length") >= room).select(*columns, (F.col("rid") * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in small.schema.fields)

    def packed(rows: DataFrame, per: int) -> DataFrame:
        n = max(1, -(-rows.count() // per))
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("rid"), F.lit(n)).cast("int"))
        return dealt.groupBy("bucket").applyInPandas(lambda pdf: pack_bucket(pdf, room, max_docs, max_cost, rule, weights), f"{schema}, bucket int, bin long, offset long, filled long")

    first = materialize(packed(small, bucket_pieces), "packed")
    tight = first.where(F.col("filled") >= int(loose * room))
    second = packed(first.where(F.col("filled") < int(loose * room)).select(*small.columns), bucket_pieces)
    number = (F.col("bucket").cast("long") * (1 << 34) + F.col("bin")) * 4
    out = tight.select(*columns, (number + 1).alias("sequence_id"), "offset").unionByName(second.select(*columns, (number + 2).alias("sequence_id"), "offset"))
    return out.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, room: int = 1024, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", cache_words: int = CACHE_WORDS, keep_words: bool = True, **options) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset."""
    out = pack(token_pieces(docs, tokenizer, room, end_id, id_col, text_col, with_ids, cache_words, keep_words), room, **options)
    return out.withColumn("length", F.col("length").cast("long"))
