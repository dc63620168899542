"""Token ids in files, compressed by Re-Pair grammars.

Documents are range-partitioned by id and sorted, encoded, and cut into shards of
about ``shard_tokens`` ids. In a shard, frequent pairs of neighbouring symbols
are replaced by new symbols (nonterminals) round after round, until no pair is
frequent or symbols run out; a round takes its most frequent pairs at once and
replaces them from left to right without overlap. No rule crosses a document's
end, so a document is a range of symbols and is decoded without its neighbours.

A shard's image holds, little-endian: magic "RPR1", symbol width in bits (16 or
32), number of ids below which symbols are plain (base), rules, documents,
symbols, tokens (7 unsigned 32-bit numbers after the magic); per rule its left
and right symbol, then each rule's expansion length; per document its id, its
first symbol and its first token; then the symbols. Expansion lengths let a
reader step over symbols to any token without expanding those before it.

Images are stored as rows of a Parquet table, (part, seq, start, n_tokens,
n_docs, image): part and seq order them as doc_id does, and the table's rows are
what Spark's readers fetch from any store.

Defined cases: a null text is the empty text, whose one id is the end id; null
ids come last; rows that share an id stay side by side, in order of their texts,
and are split over ranges unless their texts begin alike; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, col, materialize, whole
from .tokens import word_ids

MAGIC = b"RPR1"
SLOT_BITS = 18


def slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A number below 2^SLOT_BITS for each pair."""
    h = left * np.uint32(0x9E3779B1)
    h ^= right * np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE3D)
    h >>= np.uint32(32 - SLOT_BITS)
    return h.view(np.int32)


def merge_round(symbols: np.ndarray, last: np.ndarray, next_symbol: int, most: int, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round over symbols (uint32): (symbols, last, pairs replaced as left << 32 | right, in order of their new symbols)."""
    left, right, inside = symbols[:-1], symbols[1:], ~last[:-1]
    # Pairs are counted by slot first; only pairs of heavy slots are sorted.
    slot = slots(left, right)
    heavy = np.bincount(slot[inside], minlength=1 << SLOT_BITS) >= min_count
    at = np.flatnonzero(inside & heavy[slot])
    slot, code = slot[at], left[at].astype(np.uint64) << np.uint64(32) | right[at]
    found, count = np.unique(code, return_counts=True)
    ok = count >= min_count
    found, count = found[ok], count[ok]
    pairs = found[np.argsort(-count, kind="stable")[:most]]
    if not len(pairs):
        return symbols, last, pairs
    at_slot = slots((pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32))
    table = np.full(1 << SLOT_BITS, -1, np.int32)
    table[at_slot[::-1]] = np.arange(len(pairs), dtype=np.int32)[::-1]  # of pairs in one slot the most frequent has it
    pairs = pairs[kept := np.flatnonzero(table[at_slot] == np.arange(len(pairs)))]
    table[at_slot[kept]] = np.arange(len(kept), dtype=np.int32)
    rule = table[slot]
    hit = (pairs[np.maximum(rule, 0)] == code) & (rule >= 0)
    # of overlapping hits every other one, from the left
    where, rule = at[hit], rule[hit]
    begins = np.flatnonzero(np.concatenate([[True], np.diff(where) > 1]))
    nth = np.arange(len(where)) - np.repeat(begins, np.diff(np.append(begins, len(where))))
    where, rule = where[nth % 2 == 0], rule[nth % 2 == 0]
    symbols, last = symbols.copy(), last.copy()
    symbols[where] = rule + next_symbol
    last[where] = last[where + 1]
    stay = np.ones(len(symbols), bool)
    stay[where + 1] = False
    return symbols[stay], last[stay], pairs


def compress(docs: list[np.ndarray], ids: list[int | None], base: int, rounds: int | None = None, min_count: int = 16, per_round: int = 1 << 14) -> bytes:
    """A shard's image. Symbols are of 16 bits, and run out at 65,536, unless plain ids alone need more. rounds, if given, are the most there are."""
    sizes = np.array([len(d) for d in docs], np.int64)
    symbols = np.concatenate(docs).astype(np.uint32, copy=False) if docs else np.zeros(0, np.uint32)
    base = max(base, int(symbols.max(initial=0)) + 1)
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(sizes) - 1] = True
    room = (1 << 16) - base if base < 1 << 16 else 1 << 20
    rules: list[np.ndarray] = []
    n_rules = 0
    while len(symbols) > 1 and n_rules < room and (rounds is None or len(rules) < rounds):
        symbols, last, pairs = merge_round(symbols, last, base + n_rules, min(per_round, room - n_rules), min_count)
        if not len(pairs):
            break
        rules.append(pairs)
        n_rules += len(pairs)
    pairs = np.concatenate(rules) if rules else np.zeros(0, np.uint64)
    left, right = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
    wide = base + n_rules > 1 << 16
    kind = "<u4" if wide else "<u2"
    length = expansion_lengths(left, right, base)
    ends = np.flatnonzero(last) + 1
    begin = np.concatenate([[0], ends[:-1]]).astype("<u4") if len(ends) else np.zeros(0, "<u4")
    token = (np.cumsum(sizes) - sizes).astype("<u4")
    doc_ids = np.array([LAST_ID if i is None else i for i in ids], "<i8")
    head = MAGIC + struct.pack("<6I", 32 if wide else 16, base, n_rules, len(docs), len(symbols), int(sizes.sum()))
    return b"".join([head, left.astype(kind).tobytes(), right.astype(kind).tobytes(), length.astype("<u4").tobytes(), doc_ids.tobytes(), begin.tobytes(), token.tobytes(), symbols.astype(kind).tobytes()])


def expansion_lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Ids that each rule stands for; a rule names earlier symbols only, so repeating settles it, once a level."""
    length = np.zeros(len(left), np.int64)
    while len(left):
        sides = [np.where(x < base, 1, length[np.maximum(x - base, 0)]) for x in (left, right)]
        new = np.where((sides[0] > 0) & (sides[1] > 0), sides[0] + sides[1], 0)
        if (new == length).all():
            break
        length = new
    return length


class Shard:
    """Reads an image."""

    def __init__(self, image: bytes):
        if image[:4] != MAGIC:
            raise ValueError("not a shard of token ids")
        bits, self.base, rules, docs, symbols, self.n_tokens = struct.unpack_from("<6I", image, 4)
        at, kind = 28, "<u4" if bits == 32 else "<u2"

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(image, kind, n, at)
            at += out.nbytes
            return out

        self.left, self.right, self.length = take(kind, rules), take(kind, rules), take("<u4", rules)
        self.doc_ids, self.begin, self.token = take("<i8", docs), take("<u4", docs), take("<u4", docs)
        self.symbols = take(kind, symbols)
        self._flat()

    def _flat(self) -> None:
        """All rules' expansions one after another, by levels: rules of plain ids first."""
        n = len(self.length)
        self.off = np.concatenate([[0], np.cumsum(self.length, dtype=np.int64)])
        self.ids = np.zeros(int(self.off[-1]), np.uint32)
        done = np.zeros(n, bool)
        while not done.all():
            ready = ~done
            for side in (self.left, self.right):
                ready &= (side < self.base) | done[np.maximum(side.astype(np.int64) - self.base, 0)]
            at = np.flatnonzero(ready)
            half = self.off[at]
            for side in (self.left, self.right):
                got, sizes = self._expand(side[at].astype(np.int64))
                ends = np.cumsum(sizes)
                self.ids[np.arange(int(ends[-1])) + np.repeat(half - (ends - sizes), sizes)] = got
                half = half + sizes
            done[at] = True

    def _expand(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each symbol gave)."""
        rule = np.maximum(symbols - self.base, 0)
        plain = symbols < self.base
        sizes = np.where(plain, 1, self.length[rule] if len(self.length) else 1).astype(np.int64)
        ends = np.cumsum(sizes)
        begin = np.where(plain, 0, self.off[rule] if len(self.length) else 0)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)
        out = self.ids[np.minimum(at, max(len(self.ids) - 1, 0))] if len(self.ids) else np.zeros(len(at), np.uint32)
        first = np.repeat(plain, sizes)
        out[first] = symbols[plain]
        return out, sizes

    def document(self, i: int) -> np.ndarray:
        """The ids of the shard's i-th document, from its own symbols only."""
        end = int(self.begin[i + 1]) if i + 1 < len(self.begin) else len(self.symbols)
        return self._expand(self.symbols[int(self.begin[i]) : end].astype(np.int64))[0]

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Ids start to start + n of the shard: expansion lengths find the symbols that hold them."""
        sizes = np.where(self.symbols < self.base, 1, self.length[np.maximum(self.symbols.astype(np.int64) - self.base, 0)] if len(self.length) else 1)
        ends = np.cumsum(sizes)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, start + n, "left") + 1
        ids, _ = self._expand(self.symbols[a:b].astype(np.int64))
        skip = start - int(ends[a] - sizes[a])
        return ids[skip : skip + n]

    def all(self) -> np.ndarray:
        return self._expand(self.symbols.astype(np.int64))[0]


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 1, base: int = 49408, shard_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the table of shards to the shared folder and returns it, read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, start = TaskContext.get().partitionId(), 0, 0
        words, end = word_ids(tokenizer), np.array([end_id], np.uint32)
        held: list[np.ndarray] = []
        names: list[int | None] = []
        n = 0

        def image() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "start": [start], "n_tokens": [n], "n_docs": [len(held)], "image": [compress(held, names, base)]}, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("n_docs", pa.int64()), ("image", pa.binary())]))

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.encode_all(batch.column(1)), strict=True):
                held.append(np.concatenate((ids, end)))
                names.append(doc_id)
                n += len(held[-1])
                if n >= shard_tokens:
                    yield image()
                    seq, start, n, held, names = seq + 1, start + n, 0, [], []
        if held:
            yield image()

    rows = docs.select(col(docs, id_col).cast("long").alias("doc_id"), whole(col(docs, text_col)).alias("text"))
    order = F.col("doc_id").asc_nulls_last()
    # rows without an id, or of one id, are dealt by how their texts begin, which is in their order; without a number of ranges Spark
    # may put small neighbours together, so small tables aren't hundreds of files
    dealt = rows.repartitionByRange(order, F.substring("text", 1, 64)).sortWithinPartitions(order, "text")
    return materialize(dealt.mapInArrow(run, "part int, seq int, start long, n_tokens long, n_docs long, image binary"), "shards")


def read_shards(shards: DataFrame, with_ids: bool = False) -> DataFrame:
    """A row per document: doc_id, start, n_tokens, ids_crc32 (and ids)."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = F.coalesce(F.sum("part_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before.alias("base"))  # a row per range partition: as many as the session's shuffle has, so it may be broadcast
    rows = shards.join(F.broadcast(parts), "part").select((F.col("base") + F.col("start")).alias("start"), "image")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, image in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(image.as_py())
                ids = shard.all().astype("<u4")
                cuts = [*shard.token.tolist(), len(ids)]
                view = memoryview(ids.tobytes())
                raw = [view[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:], strict=False)]
                cols = [
                    pa.array([None if i == LAST_ID else i for i in shard.doc_ids.tolist()], pa.int64()),
                    pa.array([start + a for a in cuts[:-1]], pa.int64()),
                    pa.array([b - a for a, b in zip(cuts, cuts[1:], strict=False)], pa.int64()),
                    pa.array([zlib.crc32(x) for x in raw], pa.int64()),
                ]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array([bytes(x) for x in raw], pa.binary())] if with_ids else []), names + ["ids"] * with_ids)

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
