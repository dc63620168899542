"""Removal of repeated byte strings by a distributed, prefix-aware suffix sort.

A byte is removed if a string of ``length`` bytes covers it that also starts in
a document with a smaller id. Sorting every suffix of a corpus would move many
times its size, so only suffixes that can matter are sorted:

1. Of each window of ``length`` bytes, the position with the least hash of its
   next 16 bytes is the window's anchor. Equal windows have their anchor at the
   same place, so it is enough to sort the suffixes that begin at anchors (one
   position in 18) with the bytes of the windows that they are the anchor of.
2. As in prefix-doubling merge sort, what is unique by a longer prefix is found by
   32-bit fingerprints before anything is sorted and is not exchanged. A window
   holds its anchor's 16 bytes and 17 more after them or 18 before them, so an
   anchor has a fingerprint for its windows of each of these two sides; windows of
   a side that is unique go. A clash of fingerprints only lets more through.
3. Each chunk of documents sorts its remaining suffixes into runs, equal ones
   once with their smallest document, and sends each range of them front-coded:
   the length of the prefix shared with the suffix before, then the rest.
4. Each range merges the suffixes of a head, from the runs that have it, with a loser
   tree whose players carry the length of the prefix they share with the last winner.
   The longer one wins unseen; bytes are compared only from there on, so no known
   prefix is compared again. A suffix costs the logarithm of the runs that have its
   head, whatever the number of all runs is.
5. Where suffixes with the same head come out together, every window's smallest
   document is known, of a few suffixes by the prefixes that the tree gives and what
   is before the anchor; a chunk gets back one bit per suffix and window.

Order is by a hash of the head, then by bytes, so ranges are even without
sampling. A string in a third of all documents is one suffix per chunk. All of
it is one plan: chunks are shuffled once and read three times, lost tasks are
run again from shuffle files, and a chunk's documents are sorted before use, so
a rerun gives the same runs. The exchanges have a block per chunk and range that
have something for each other: at most the product of their numbers, which both
grow with the input, and at most the number of heads, which is in proportion to it.
By reckoning, not measured: blocks have many heads up to some 50 GB of input, and
one each from some 10 TB on, where a block's own fields are some five times its head.

Defined cases: a null or short text has no windows and keeps all its bytes; a
null id is larger than all ids; rows that share an id don't remove each other's
bytes but both lose to smaller ids; wholly equal rows with an id are in one chunk; an empty table gives an empty result; other
columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, col, whole

HEAD = 16
BLOCK = 1 << 18
POSITION_BITS = 24
CHUNK_BYTES = 16 << 20
RANGE_BYTES = 16 << 20
#: So many suffixes of one head are compared two by two, more of them by a table of their windows.
FEW = 8

U = np.uint64
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def head_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the HEAD bytes from each position on that has as many."""
    n = len(data) - HEAD + 1
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.empty(len(padded) - 7, U)
    for shift in range(8):
        part = words[shift::8]
        part[:] = np.frombuffer(padded, "<u8", len(part), shift)
    h = words[:n] * U(0x9E3779B97F4A7C15)
    h ^= h >> U(31)
    h += words[8 : 8 + n] * U(0xC2B2AE3D27D4EB4F)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    return h


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < width:
        out = np.minimum(out[: len(out) - (width - span)], out[width - span :])
    return out


def beside(identity: np.ndarray, h: np.ndarray, side: int) -> np.ndarray:
    """A hash of a head's identity and of the hash of the bytes on one side of it."""
    x = (identity ^ (h + U(side)) * U(0x9E3779B97F4A7C15)) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


def document_anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, identity, right, left) of each run of windows with one anchor: hashes of its head, and of that
    with the bytes that all windows have that begin from length - HEAD over 2 bytes before the anchor on, or that begin earlier.
    Long texts go block by block."""
    windows = len(data) - length + 1
    half = (length - HEAD) // 2
    found: tuple[list, ...] = ([], [], [], [], [], [])
    for at in range(0, windows, BLOCK):
        n = min(BLOCK, windows - at)
        h = head_hashes(data[at : at + n + length - 1])
        order = (h & ~U((1 << POSITION_BITS) - 1)) | np.arange(len(h), dtype=U)
        anchor = (sliding_min(order, length - HEAD + 1) & U((1 << POSITION_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(first[1:], n) - 1
        p = anchor[first]
        # anchors are the least hashes, so their identity is hashed again
        mixed = (h[p] ^ (h[p] >> U(33))) * U(0x94D049BB133111EB)
        identity = mixed ^ (mixed >> U(31))
        right = beside(identity, h[np.minimum(p + (length - HEAD - half), len(h) - 1)], 1)
        left = beside(identity, h[np.maximum(p - half - 1, 0)], 2)
        for to, x in zip(found, (p + at, first + at, last + at, identity, right, left), strict=True):
            to.append(x)
    kinds = (np.int64, np.int64, np.int64, U, U, U)  # of a text without windows, too: mixed kinds would meet as floats
    return tuple(np.concatenate(x) if x else np.zeros(0, k) for x, k in zip(found, kinds, strict=True))  # type: ignore[return-value]


class Chunk:
    """A chunk's documents in a fixed order, with their anchors."""

    def __init__(self, table: pa.Table, length: int, ranges: int):
        rows = [(LAST_ID if i is None else i, t.encode("utf-8", "surrogatepass"), i) for i, t in zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True)]
        rows.sort(key=lambda r: r[:2])
        self.order = np.array([r[0] for r in rows], np.int64)
        self.data = [r[1] for r in rows]
        self.ids = [r[2] for r in rows]
        self.length, self.ranges = length, ranges
        parts = [document_anchors(np.frombuffer(d, np.uint8), length) for d in self.data]
        self.doc = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        self.p, self.first, self.last, self.identity, right, left = (np.concatenate([p[k] for p in parts]) for k in range(6))
        del parts
        # where the windows of the right side begin
        self.turn = self.p - (length - HEAD) // 2
        self.right, self.left = np.flatnonzero(self.last >= self.turn), np.flatnonzero(self.first < self.turn)
        # range in the high half, fingerprint in the low one
        self.range = ((self.identity >> U(32)) * U(ranges)) >> U(32)
        codes = [self.range[at] << U(32) | (x[at] & U(0xFFFFFFFF)) for at, x in ((self.right, right), (self.left, left))]
        self.unique, self.at = np.unique(np.concatenate(codes), return_inverse=True)

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        """(range, its fingerprints in order)."""
        of = (self.unique >> U(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(of)) + 1
        for codes in np.split(self.unique, cuts):
            if len(codes):
                yield int(codes[0] >> U(32)), (codes & U(0xFFFFFFFF)).astype("<u4")

    def suffixes(self, bitmaps: pa.Table) -> dict[int, tuple[list[bytes], list[list[int]]]]:
        """By range: the sorted keys of the suffixes that others may share, and the entries (indices of anchors) of each. From now on
        first and last are those of the windows that others may share.
        A key is the head's identity, the bytes from the anchor on, the bytes before it, and how many those and the windows are."""
        shared = np.zeros(len(self.unique), bool)
        of = (self.unique >> U(32)).astype(np.int64)
        for r, bits in zip(bitmaps.column("range").to_pylist(), bitmaps.column("bits").to_pylist(), strict=True):
            a, b = np.searchsorted(of, [r, r + 1])
            shared[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(b - a)).astype(bool)
        if len(self.at):  # or by two documents of this chunk
            low, high = np.full(len(self.unique), len(self.data)), np.full(len(self.unique), -1)
            docs = self.doc[np.concatenate([self.right, self.left])]
            np.minimum.at(low, self.at, docs)
            np.maximum.at(high, self.at, docs)
            shared |= low < high
        right, left = np.zeros(len(self.p), bool), np.zeros(len(self.p), bool)
        right[self.right], left[self.left] = np.split(shared[self.at], [len(self.right)]) if len(self.at) else (False, False)
        self.first = np.where(left, self.first, np.maximum(self.first, self.turn))
        self.last = np.where(right, self.last, np.minimum(self.last, self.turn - 1))
        found: defaultdict[int, dict[bytes, list[int]]] = defaultdict(dict)
        chosen = np.flatnonzero(right | left)
        span, texts = self.length, self.data
        heads = self.identity[chosen].astype(">u8").tobytes()
        columns = (self.range, self.doc, self.p, self.first, self.last, self.p - self.first, self.last - self.first)
        rows = zip(chosen.tolist(), *(x[chosen].tolist() for x in columns), strict=True)
        at = 0
        for i, r, d, p, a, b, left, more in rows:
            data = texts[d]
            key = b"%b%b%b%c%c" % (heads[at : at + 8], data[p : b + span], data[a:p], left, more)
            at += 8
            keys = found[r]
            if key in keys:
                keys[key].append(i)
            else:
                keys[key] = [i]
        out = {}
        for r, keys in found.items():
            names = sorted(keys)
            out[r] = (names, [keys[k] for k in names])
        return out


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are known already."""
    n = min(len(a), len(b))
    while known < n:
        x, y = a[known : known + 16], b[known : known + 16]
        if x != y:
            m = min(len(x), len(y))
            diff = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return known + (m if not diff else m - 1 - (diff.bit_length() - 1 >> 3))
        known += len(x)
    return n


def front_code(keys: list[bytes], docs: np.ndarray) -> bytes:
    """Sorted keys with their smallest documents: lengths of shared prefixes and of rests, the rests, the documents."""
    shared = np.zeros(len(keys), "u1")
    rests = []
    before = b""
    for i, key in enumerate(keys):
        n = shared_prefix(before, key)
        shared[i] = n
        rests.append(key[n:])
        before = key
    sizes = np.fromiter(map(len, rests), "u1", len(rests))
    return zstandard.compress(b"".join([len(keys).to_bytes(4, "little"), shared.tobytes(), sizes.tobytes(), docs.astype("<i8").tobytes(), *rests]), 1)


def front_decode(run: bytes) -> tuple[list[bytes], list[int], list[int]]:
    """(keys, prefixes shared with the key before, documents)."""
    raw = zstandard.decompress(run)
    n = int.from_bytes(raw[:4], "little")
    shared = list(raw[4 : 4 + n])
    sizes = raw[4 + n : 4 + 2 * n]
    docs = np.frombuffer(raw, "<i8", n, 4 + 2 * n).tolist()
    at, before, keys = 4 + 10 * n, b"", []
    for h, size in zip(shared, sizes, strict=True):
        before = before[:h] + raw[at : at + size]
        at += size
        keys.append(before)
    return keys, shared, docs


def merge(runs: list[tuple[list[bytes], list[int], list[int]]], known: int = 0) -> Iterator[tuple[bytes, int, int, int]]:
    """(key, run, place in the run, prefix shared with the key before) of all runs in order; all keys share `known` bytes.
    A loser tree: each inner node keeps the loser of its match and the prefix that it shares with the last winner overall."""
    k = 1
    while k < len(runs):
        k *= 2
    keys = [r[0] for r in runs] + [[] for _ in range(k - len(runs))]
    shared = [r[1] for r in runs]
    place = [0] * k
    now: list[bytes | None] = [x[0] if x else None for x in keys]
    loser, prefix = [0] * k, [0] * k  # by inner node

    def first(node: int) -> tuple[int, int]:
        if node >= k:
            i = node - k
            return i, 0 if now[i] is not None else -1
        (a, ha), (b, hb) = first(2 * node), first(2 * node + 1)
        if ha < 0 or hb < 0:
            win, lose = ((a, ha), (b, hb)) if hb < 0 else ((b, hb), (a, ha))
        else:
            n = shared_prefix(now[a], now[b], known)
            win, lose = ((a, 0), (b, n)) if now[a] <= now[b] else ((b, 0), (a, n))
        loser[node], prefix[node] = lose
        return win

    winner, h = first(1) if k > 1 else (0, 0 if now[0] is not None else -1)
    h = 0
    while now[winner] is not None:
        i = place[winner]
        yield now[winner], winner, i, h
        i += 1
        place[winner] = i
        if i < len(keys[winner]):
            now[winner] = mine = keys[winner][i]
            h = shared[winner][i]
        else:
            now[winner] = mine = None
            h = -1
        node = winner + k >> 1
        while node:
            other = prefix[node]
            if other > h:
                prefix[node], loser[node], winner, h = h, winner, loser[node], other
                mine = now[winner]
            elif other == h and h >= 0:
                rival = now[loser[node]]
                n = shared_prefix(mine, rival, h)
                if rival[n : n + 1] < mine[n : n + 1]:
                    loser[node], winner, mine = winner, loser[node], rival
                prefix[node] = n
            node >>= 1


def window_documents(group: list[tuple[bytes, int]], length: int) -> list[list[int]]:
    """For each distinct key of one head: the smallest document of each of its windows, from the first on."""
    best: dict[tuple[int, bytes], int] = {}
    windows = []
    for key, doc in group:
        left, n = key[-2], key[-1] + 1
        text = key[-2 - left : -2] + key[8 : -2 - left]
        own = [(left - t, text[t : t + length]) for t in range(n)]
        windows.append(own)
        for w in own:
            if best.get(w, LAST_ID + 1) > doc:
                best[w] = doc
    return [[best[w] for w in own] for own in windows]


def shared_suffix(a: bytes, b: bytes) -> int:
    """Length of the common suffix."""
    n = min(len(a), len(b))
    diff = int.from_bytes(a[len(a) - n :], "big") ^ int.from_bytes(b[len(b) - n :], "big")
    return (diff & -diff).bit_length() - 1 >> 3 if diff else n


def shared_windows(keys: list[bytes], shared: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each of a few distinct sorted keys of one head: (another key's index, bits of the own windows that it has too).
    shared: the length of the prefix shared with the key before."""
    span = length - HEAD
    out: list[list[tuple[int, int]]] = [[] for _ in keys]
    lefts, counts = [k[-2] for k in keys], [k[-1] + 1 for k in keys]
    after = [len(k) - 10 - HEAD - left for k, left in zip(keys, lefts, strict=True)]
    for i, key in enumerate(keys):
        known = len(key)
        for j in range(i + 1, len(keys)):
            known = min(known, shared[j])
            if known - 8 - HEAD + lefts[i] < span:  # those that follow share no more
                break
            right = min(known - 8 - HEAD, after[i], after[j])
            # a window begins so many bytes before the anchor
            low = max(span - right, lefts[i] - counts[i] + 1, lefts[j] - counts[j] + 1)
            if low > min(lefts[i], lefts[j]):
                continue
            high = shared_suffix(key[-2 - lefts[i] : -2], keys[j][-2 - lefts[j] : -2])
            if low <= high:
                bits = (1 << high - low + 1) - 1
                out[i].append((j, bits << lefts[i] - high))
                out[j].append((i, bits << lefts[j] - high))
    return out


def merged_heads(decoded: list[tuple[list[bytes], list[int], list[int]]]) -> Iterator[list[tuple[bytes, int, list[tuple[int, int]]]]]:
    """Of each head that comes more than once: its keys in order, the prefix shared with the key before, and where each is (run, place)."""
    sizes = [len(d[0]) for d in decoded]
    heads = np.concatenate([np.frombuffer(b"".join([k[:8] for k in d[0]]), ">u8") for d in decoded]).astype(U)
    order = np.argsort(heads, kind="stable")  # a head's keys by run and place
    begins = np.flatnonzero(np.concatenate([[True], np.diff(heads[order]) != 0])) if len(order) else order
    ends = np.append(begins[1:], len(order))
    often = ends - begins > 1
    runs = np.repeat(np.arange(len(sizes)), sizes)[order].tolist()
    places = (np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order].tolist()
    for begin, end in zip(begins[often].tolist(), ends[often].tolist(), strict=True):
        if end - begin == 2 and runs[begin] != runs[begin + 1]:  # a tree of two leaves is one match
            x, y = (runs[begin], places[begin]), (runs[begin + 1], places[begin + 1])
            a, b = decoded[x[0]][0][x[1]], decoded[y[0]][0][y[1]]
            if a == b:
                yield [(a, 0, [x, y])]
            elif (n := shared_prefix(a, b, 8)) >= 8 + HEAD:
                yield [(a, 0, [x]), (b, n, [y])] if a < b else [(b, 0, [y]), (a, n, [x])]
            continue
        of, parts = [], []
        at = begin
        while at < end:
            run, to = runs[at], at + 1
            while to < end and runs[to] == run:
                to += 1
            low, high = places[at], places[at] + to - at
            of.append((run, low))
            parts.append((decoded[run][0][low:high], decoded[run][1][low:high], []))
            at = to
        group: list[tuple[bytes, int, list[tuple[int, int]]]] = []
        # a key's first 24 bytes are its head's identity and the head
        for key, part, place, shared in merge(parts, 8):
            run, low = of[part]
            if group and shared < 8 + HEAD:
                yield group
                group = []
            if group and shared == len(key) == len(group[-1][0]):
                group[-1][2].append((run, low + place))
            else:
                group.append((key, shared, [(run, low + place)]))
        yield group


def merge_range(runs: list[bytes], length: int) -> list[bytes]:
    """Of each run, an unsigned 64-bit number per key: bit t is set if the key's window t has a smaller document than the run has for it."""
    decoded = [front_decode(r) for r in runs]
    docs = [d[2] for d in decoded]
    masks = [np.zeros(len(d[0]), "<u8") for d in decoded]
    for group in merged_heads(decoded):
        lows = [min([docs[r][i] for r, i in where]) for _, _, where in group]
        if len(group) <= FEW:
            others = [[]] if len(group) == 1 else shared_windows([key for key, _, _ in group], [shared for _, shared, _ in group], length)
            for (key, _, where), low, other in zip(group, lows, others, strict=True):
                for r, i in where:
                    mine = docs[r][i]
                    if mine > low:
                        masks[r][i] = (1 << key[-1] + 1) - 1
                        continue
                    bits = 0
                    for j, has in other:
                        if lows[j] < mine:
                            bits |= has
                    if bits:
                        masks[r][i] = bits
            continue
        smallest = window_documents([(key, low) for (key, _, _), low in zip(group, lows, strict=True)], length)
        for (_, _, where), best in zip(group, smallest, strict=True):
            for r, i in where:
                mine = docs[r][i]
                bits = 0
                for t, d in enumerate(best):
                    if d < mine:
                        bits |= 1 << t
                if bits:
                    masks[r][i] = bits
    return [m.tobytes() for m in masks]


def removed_spans(chunk: Chunk, masks: pa.Table, suffixes: dict[int, tuple[list[bytes], list[list[int]]]]) -> list[list[tuple[int, int]]]:
    """Maximal removed byte ranges of each document of the chunk."""
    length = chunk.length
    first, windows, doc, rank = chunk.first.tolist(), (chunk.last - chunk.first + 1).tolist(), chunk.doc.tolist(), chunk.order[chunk.doc].tolist()
    owner: list[int] = []
    begin: list[int] = []
    end: list[int] = []

    def cover(i: int, low: int, n: int) -> None:
        owner.append(doc[i])
        begin.append(first[i] + low)
        end.append(first[i] + low + n - 1 + length)

    def cover_bits(i: int, mask: int) -> None:
        while mask:
            low = (mask & -mask).bit_length() - 1
            rest = mask >> low
            n = (~rest & (rest + 1)).bit_length() - 1
            cover(i, low, n)
            mask = rest >> n << n + low

    for r, raw in zip(masks.column("range").to_pylist(), masks.column("masks").to_pylist(), strict=True):
        for mask, at in zip(np.frombuffer(raw, "<u8").tolist(), suffixes[r][1], strict=True):
            if len(at) == 1:
                if mask:
                    cover_bits(at[0], mask)
                continue
            least = min(rank[i] for i in at)
            for i in at:
                if rank[i] > least:
                    cover(i, 0, windows[i])
                elif mask:
                    cover_bits(i, mask)
    out: list[list[tuple[int, int]]] = [[] for _ in chunk.data]
    if not owner:
        return out
    wide = max(map(len, chunk.data)) + 1
    base = np.array(owner, np.int64) * wide
    a, b = base + begin, base + end
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    for x, y in zip(a[new].tolist(), b[np.append(new[1:], len(a)) - 1].tolist(), strict=True):
        d = x // wide
        out[d].append((x - d * wide, y - d * wide))
    return out


def suffix_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """A row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (and kept, its remaining bytes)."""
    if not HEAD <= length <= HEAD + 63:
        raise ValueError(f"length must be from {HEAD} to {HEAD + 63}")
    spark = docs.sparkSession
    rows = docs.select(col(docs, id_col).cast("long").alias("doc_id"), whole(col(docs, text_col)).alias("text"))
    size = int(rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    chunks = max(-(-size // CHUNK_BYTES), 3 * spark.sparkContext.defaultParallelism)
    ranges = max(-(-size // RANGE_BYTES), 3 * spark.sparkContext.defaultParallelism)
    # equal texts without ids are told apart by their row's number
    own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text", own), F.lit(chunks)))

    def number(chunk: pa.Table) -> int:
        return chunk.column("chunk")[0].as_py()

    def send_heads(table: pa.Table) -> pa.Table:
        n, chunk = number(table), Chunk(table, length, ranges)
        got = list(chunk.blocks())
        return pa.table({"chunk": pa.array([n] * len(got), pa.int64()), "range": pa.array([r for r, _ in got], pa.int64()), "heads": pa.array([x.tobytes() for _, x in got], pa.binary())})

    def find_shared(table: pa.Table) -> pa.Table:
        heads = [np.frombuffer(x, "<u4") for x in table.column("heads").to_pylist()]
        every = np.sort(np.concatenate(heads))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        bits = []
        for x in heads:
            at = np.minimum(np.searchsorted(twice, x), max(len(twice) - 1, 0))
            bits.append(np.packbits(twice[at] == x if len(twice) else np.zeros(len(x), bool)).tobytes())
        return pa.table({"chunk": table.column("chunk"), "range": table.column("range"), "bits": pa.array(bits, pa.binary())})

    def send_runs(table: pa.Table, bitmaps: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [])
        if len(table):
            n, chunk = number(table), Chunk(table, length, ranges)
            rank = chunk.order[chunk.doc].tolist()
            for r, (keys, entries) in chunk.suffixes(bitmaps).items():
                least = np.array([rank[at[0]] if len(at) == 1 else min(rank[i] for i in at) for at in entries], np.int64)
                for to, x in zip(out, (n, r, front_code(keys, least)), strict=True):
                    to.append(x)
        return pa.table({"chunk": pa.array(out[0], pa.int64()), "range": pa.array(out[1], pa.int64()), "run": pa.array(out[2], pa.binary())})

    def merge_runs(table: pa.Table) -> pa.Table:
        masks = merge_range(table.column("run").to_pylist(), length)
        return pa.table({"chunk": table.column("chunk"), "range": table.column("range"), "masks": pa.array(masks, pa.binary()), "bits": pa.nulls(len(masks), pa.binary())})

    def remove(table: pa.Table, back: pa.Table) -> pa.Table:
        out: tuple[list, ...] = tuple([] for _ in range(7))
        if len(table):
            chunk = Chunk(table, length, ranges)
            is_mask = pa.compute.is_valid(back.column("masks"))
            bitmaps, masks = back.filter(pa.compute.invert(is_mask)), back.filter(is_mask)
            for doc_id, data, spans in zip(chunk.ids, chunk.data, removed_spans(chunk, masks, chunk.suffixes(bitmaps)), strict=True):
                at, kept = 0, []
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                left = b"".join([*kept, data[at:]])
                for to, x in zip(out, (doc_id, len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(), [{"begin": a, "end": b} for a, b in spans], left), strict=True):
                    to.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.binary())
        names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")
        return pa.table({c: pa.array(x, k) for c, x, k in list(zip(names, out, kinds, strict=True))[: 6 + with_text]})

    by_chunk = rows.groupBy("chunk")
    heads = by_chunk.applyInArrow(send_heads, "chunk long, range long, heads binary")
    shared = heads.groupBy("range").applyInArrow(find_shared, "chunk long, range long, bits binary")
    runs = by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(send_runs, "chunk long, range long, run binary")
    masks = runs.groupBy("range").applyInArrow(merge_runs, "chunk long, range long, masks binary, bits binary")
    back = masks.unionByName(shared.select("chunk", "range", F.lit(None).cast("binary").alias("masks"), "bits"))
    return by_chunk.cogroup(back.groupBy("chunk")).applyInArrow(remove, RESULT + ", spans array<struct<begin:long,end:long>>" + ", kept binary" * with_text)
