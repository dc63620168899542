"""SimHash near-dedup by anchor-point covering.

Fingerprints that differ in few bits are found without comparing all pairs. Two
blocks of 23 bits of a fingerprint are read as words of the binary Golay code,
which is perfect: each block is within 3 bits of exactly one codeword. A pair of
codewords is an anchor. A fingerprint's home is the anchor that covers it; it is
replicated to every anchor that is within covering radius plus threshold and
can be the home of a fingerprint within the threshold: a codeword 3 + c bits
away takes c flipped bits, and both blocks together take ``threshold`` at most.
At an anchor, homes are compared with replicas over all their bits, so each
linked pair of fingerprints is met exactly once. There are 2^24 anchors, and a
fingerprint has about 68 replicas at threshold 2 and 11 at threshold 1.

Equal fingerprints are one node, so a group of copies is one row here however
many rows it has. A component's name goes back to its fingerprints, and from those
to the rows, in parts where they are many (``common.hot_keys``).

``near_duplicates`` finds documents whose sets of five-word shingles have a
Jaccard similarity of 0.8 or more. First, SimHash fingerprints of those sets that differ
in ``bits`` at most are linked at anchors as above, and links are held to the exact
similarity. That can't be all: at 0.8 a copy differs in more bits. For what
fingerprints have not connected, a document has ``bands`` keys, each of
``per_band`` minima of its shingle set under as many random orders, and documents
that share a key are candidates; candidates are then held to the exact
similarity. A pair at similarity s is missed by all keys with a chance of
(1 - s^5)^40: 1.2e-7 at 0.8, less above, whatever its texts are.

Of those who share a key, one after another is compared with all others and then
leaves; those compared with it stay, linked or not, while any two of them are in
different components. The first is the smallest id, the second has the most links,
so the middle of a star of copies is found. What is left after ``PIVOTS`` rounds,
mostly copies too far from all others, is compared in blocks: a task counts what
its documents share by an inverted index of their shingles, leaves out those of
which no one has enough, and gives links, not pairs. So any two documents that
share a key are compared or connected by others. What is joined is written first,
so both sides of a join are plain shuffles and the planner may split a key's rows.

Defined cases: a null text is the empty one; texts without words have
fingerprint 0 and link like any others; fewer words than a shingle has are one
shingle; rows that share an id are one node of near_duplicates, with the shingles
of all of them, and each a row of simhash_components; null ids come last, and near_duplicates keeps their rows;
empty tables give empty results; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, drop_ids, hot_keys, materialize, replicated, salted, tidy, whole
from .components import components

BLOCK = 23
RADIUS = 3
#: The Golay code's generator polynomial, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
SEED = 42
#: Rounds of one against all among those who share a key, and the members and shingles that a block has about, after them.
PIVOTS, PER_BLOCK, BLOCK_SHINGLES = 2, 1024, 1 << 21


def remainder(value: int) -> int:
    for bit in range(BLOCK - 1, 10, -1):
        if value >> bit & 1:
            value ^= GENERATOR << (bit - 11)
    return value


@cache
def golay(threshold: int) -> tuple[np.ndarray, ...]:
    """(syndromes of the low 12 bits, of the high 11, coset leaders by syndrome, per cost: offsets by syndrome, steps to the codewords that near)."""
    low = np.array([remainder(i) for i in range(1 << 12)], np.int64)
    high = np.array([remainder(i << 12) for i in range(1 << 11)], np.int64)
    leader = np.zeros(1 << 11, np.int64)
    bits = [1 << i for i in range(BLOCK)]
    for i in range(BLOCK):
        for j in range(i, BLOCK):
            for k in range(j, BLOCK):
                e = bits[i] | bits[j] | bits[k]
                leader[low[e & 4095] ^ high[e >> 12]] = e
    leader[0] = 0
    codewords = np.array([(m << 11) ^ remainder(m << 11) for m in range(1, 1 << 12)], np.int64)
    away = np.bitwise_count(leader[:, None] ^ codewords[None, :])
    out = [low, high, leader, np.arange((1 << 11) + 1), np.zeros(1 << 11, np.int64)]
    for cost in range(1, threshold + 1):
        at, which = np.nonzero(away == RADIUS + cost)
        out += [np.searchsorted(at, np.arange((1 << 11) + 1)), codewords[which]]
    return tuple(out)


def anchors(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of the fingerprint, anchor) of every replica; threshold 0 gives the homes."""
    low, high, leader, *steps = golay(threshold)
    homes, syndromes = [], []
    for k in range(2):
        block = (fps >> (BLOCK * k)) & ((1 << BLOCK) - 1)
        s = low[block & 4095] ^ high[block >> 12]
        homes.append(block ^ leader[s])
        syndromes.append(s)
    rows, out = [], []
    for c1 in range(threshold + 1):
        for c2 in range(threshold + 1 - c1):
            (off1, step1), (off2, step2) = (steps[2 * c : 2 * c + 2] for c in (c1, c2))
            n1, n2 = (off[s + 1] - off[s] for off, s in ((off1, syndromes[0]), (off2, syndromes[1])))
            n = n1 * n2
            row = np.repeat(np.arange(len(fps)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            per = n2[row]
            a = homes[0][row] ^ step1[off1[syndromes[0]][row] + at // np.maximum(per, 1)]
            b = homes[1][row] ^ step2[off2[syndromes[1]][row] + at % np.maximum(per, 1)]
            rows.append(row)
            out.append(a | b << BLOCK)
    return np.concatenate(rows), np.concatenate(out)


def at_anchors(nodes: DataFrame, threshold: int) -> DataFrame:
    """(slot, anchor, node, fp) of nodes (slot, node, fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, node, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for i in range(0, len(fp), 4096):
                part = fp[i : i + 4096]
                row, anchor = anchors(part, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (slot[i : i + 4096][row], anchor, node[i : i + 4096][row], part[row])], ["slot", "anchor", "node", "fp"])

    return nodes.select(F.col("slot").cast("int"), F.col("node").cast("long"), F.col("fp").cast("long")).mapInArrow(run, "slot int, anchor long, node long, fp long")


def links(nodes: DataFrame, threshold: int) -> DataFrame:
    """(a, b) of every two nodes that in some slot differ in at most threshold bits. In a slot each fingerprint is of one node."""
    home = at_anchors(nodes, 0).select("slot", "anchor", F.col("node").alias("a"), F.col("fp").alias("fp_a"))
    replica = at_anchors(nodes, threshold).select("slot", "anchor", F.col("node").alias("b"), F.col("fp").alias("fp_b"))
    near = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= threshold
    # the planner takes replicas to be as few as nodes and would send all of them to the driver to broadcast them
    return home.hint("merge").join(replica, ["slot", "anchor"]).where((F.col("fp_a") < F.col("fp_b")) & near).select("a", "b")


def normal_words(text: str) -> list[bytes]:
    """Words of the UTF-8 text with A-Z in lower case; white space is U+0020 and U+0009 to U+000D."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 of each k-word shingle; of all words if they are fewer; none if there are none."""
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    n = max(len(words) - k + 1, 1)
    h = xxhash.xxh64_intdigest
    pairs = zip(begins[:n].tolist(), ends[min(k, len(words)) - 1 :].tolist(), strict=True)
    return np.array([h(line[a:b], SEED) for a, b in pairs], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits set in over half the hashes."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp), fp the 64 bits as a signed number."""

    @F.arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([majority(shingle_hashes(normal_words(t.as_py()), shingle)) for t in texts], np.uint64).view(np.int64))

    return docs.select(col(docs, id_col).cast("long").alias("doc_id"), fp(whole(col(docs, text_col))).alias("fp"))


def simhash_components(docs: DataFrame, threshold: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, fingerprint, component_id."""
    fps = materialize(fingerprints(docs, shingle, id_col, text_col).withColumn("rid", F.monotonically_increasing_id()), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    found = links(nodes.select(F.lit(0).alias("slot"), F.col("fp").alias("node"), "fp"), threshold)
    roots = materialize(components(materialize(found, "links")), "roots")
    nodes = materialize(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first_id", "n", F.coalesce("root", "fp").alias("root")), "rooted")
    named = materialize(nodes.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "components")
    hot = hot_keys(named, "root")
    nodes = salted(nodes, "root", hot, "fp").join(replicated(named.drop("n"), "root", hot), ["root", "salt"])
    nodes = materialize(nodes.select("fp", "component_id", "n"), "named")
    hot = hot_keys(nodes, "fp")
    out = salted(fps, "fp", hot, "rid").join(replicated(nodes.drop("n"), "fp", hot), ["fp", "salt"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def mixed(hashes: np.ndarray, i: int) -> np.ndarray:
    """The i-th hash of hashes, by a multiply and shift mixer."""
    x = hashes ^ np.uint64((0x9E3779B97F4A7C15 * (i + 1)) & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(node, hashes) of every id: the 32-bit hashes of its rows' shingles, each once."""

    @F.arrow_udf("array<int>")
    def shingles(texts: pa.Array) -> pa.Array:
        return pa.array([np.unique(shingle_hashes(normal_words(t.as_py()), shingle).astype(np.uint32)).view(np.int32) for t in texts], pa.list_(pa.int32()))

    rows = docs.where(col(docs, id_col).isNotNull()).select(col(docs, id_col).cast("long").alias("node"), whole(col(docs, text_col)).alias("text"))
    often = materialize(rows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node"), "repeated-ids")
    once = rows.join(often, "node", "left_anti").select("node", shingles("text").alias("hashes"))
    each = rows.join(often, "node", "left_semi").select("node", shingles("text").alias("hashes"))
    merged = each.select("node", F.explode_outer("hashes").alias("hash")).groupBy("node").agg(F.collect_set("hash").alias("hashes"))
    return once.unionByName(merged)


def band_keys(hashes: np.ndarray, bands: int, per_band: int) -> np.ndarray:
    """A set's keys, one of each band; the empty set has keys too."""
    n = bands * per_band
    factors = mixed(np.arange(n, dtype=np.uint64), 1) | np.uint64(1)
    x = mixed(hashes.astype(np.uint64), 0)
    least = np.full(n, (1 << 64) - 1, np.uint64)
    for i in range(0, len(x), 256):
        np.minimum(least, np.multiply.outer(factors, x[i : i + 256]).min(axis=1), out=least)
    parts = mixed(least, 2) * (mixed(np.arange(n, dtype=np.uint64), 3) | np.uint64(1))
    return mixed(parts.reshape(bands, per_band).sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64), 4).view(np.int64)


def in_bands(sets: DataFrame, bands: int, per_band: int) -> DataFrame:
    """(key, node) of every band of every set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            keys = [band_keys(hashes.values.to_numpy().view(np.uint32), bands, per_band) for hashes in batch.column(1)]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.repeat(nodes, bands))], ["key", "node"])
        tidy()

    return sets.select("node", "hashes").mapInArrow(run, "key long, node long")


def set_fingerprints(sets: DataFrame) -> DataFrame:
    """(node, fp) of every set; the empty set has 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [majority(mixed(hashes.values.to_numpy().view(np.uint32).astype(np.uint64), 5)) for hashes in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["node", "fp"])
        tidy()

    return sets.select("node", "hashes").mapInArrow(run, "node long, fp long")


def fingerprint_links(sets: DataFrame, bits: int) -> DataFrame:
    """(a, b): of each fingerprint the smallest node with all others of it, and with the smallest of each that differs in at most so many bits."""
    fps = materialize(set_fingerprints(sets), "set-fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("node").alias("first_id"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    near = links(nodes.select(F.lit(0).alias("slot"), F.col("first_id").alias("node"), "fp"), bits)
    hot = hot_keys(nodes, "fp")
    same = salted(fps, "fp", hot, "node").join(replicated(nodes.where("n > 1").drop("n"), "fp", hot), ["fp", "salt"])
    same = same.where("node <> first_id").select(F.col("first_id").alias("a"), F.col("node").alias("b"))
    return same.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def near_duplicates(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, bands: int = 40, per_band: int = 5, bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id) of every id that has a near duplicate."""
    sets = materialize(shingle_sets(docs, shingle, id_col, text_col), "shingles")
    alike = materialize(fingerprint_links(sets, bits), "fingerprint-links")
    near = materialize(verified(sets, alike, similarity, alike.count()), "near")
    roots = materialize(components(near), "roots")
    keys = materialize(in_bands(sets, bands, per_band), "band-keys")
    often = materialize(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "often")
    live = materialize(keys.join(often, "key", "left_semi"), "shared-keys")
    shared = materialize(sets.join(live.select("node").distinct(), "node", "left_semi"), "shared-shingles")
    for i in range(PIVOTS + 1):
        n = live.count()
        live = materialize(undecided(live, roots, n), "undecided", most_rows=n)
        if live.isEmpty():
            break
        if i < PIVOTS:
            pivots = materialize(central(live, near), "pivots", most_rows=n)
            joined = live.join(pivots, "key")
            found = joined.where("root <> pivot_root").select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"))
            live = materialize(joined.where("node <> pivot").select("key", "node"), "rest", most_rows=n)
            found = verified(shared, materialize(found.distinct(), "candidates", most_rows=n), similarity, n)
        else:
            found = across(live, shared, similarity, n)
        near = materialize(near.unionByName(found), "near")
        roots = materialize(components(near), "roots")
    return roots.select(F.col("node").alias("doc_id"), F.col("root").alias("component_id"))


def undecided(members: DataFrame, roots: DataFrame, n: int) -> DataFrame:
    """(key, node, root) of n members (key, node) of keys that more than one component has."""
    rooted = members.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed_keys = materialize(rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key"), "mixed-keys", most_rows=n)
    return rooted.join(mixed_keys, "key", "left_semi")


def central(members: DataFrame, near: DataFrame) -> DataFrame:
    """(key, pivot, pivot_root): of each key the member with the most links, of equals the smallest."""
    ends = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node")))
    ranked = members.join(ends.groupBy("node").agg(F.count(F.lit(1)).alias("links")), "node", "left")
    best = F.min(F.struct(-F.coalesce("links", F.lit(0)), "node", "root")).alias("best")
    return ranked.groupBy("key").agg(best).select("key", F.col("best.node").alias("pivot"), F.col("best.root").alias("pivot_root"))


def links_of(hashes: list[np.ndarray], roots: np.ndarray, side: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """(i, j) of every two of the sets that are in different components, and on different sides if there are sides, and similar."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out: list[tuple[int, int]] = []
    empty = np.flatnonzero(sizes == 0)
    out += [(int(empty[0]), int(i)) for i in empty[1:]]
    owner = np.repeat(np.arange(len(hashes)), sizes)
    names, number = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, np.uint32), return_inverse=True)
    count = np.bincount(number, minlength=len(names))
    # what no other set here has can't be shared: that bounds every similarity of a set
    often = np.bincount(owner, count[number] > 1, len(hashes))
    ends = np.cumsum(sizes)
    by_name = owner[np.argsort(number, kind="stable")]
    name_ends = np.cumsum(count)
    # the sets of one component needn't ask: they are asked by all others
    values, n = np.unique(roots, return_counts=True)
    asking = np.flatnonzero((roots != values[np.argmax(n)]) & (often >= similarity * sizes - 1e-9) & (sizes > 0)) if len(roots) else roots
    for i in asking.tolist():
        mine = number[ends[i] - sizes[i] : ends[i]]
        mine = mine[count[mine] > 1]
        lengths = count[mine]
        at = np.arange(int(lengths.sum())) + np.repeat(name_ends[mine] - np.cumsum(lengths), lengths)
        shared = np.bincount(by_name[at], minlength=len(hashes))
        ok = (shared >= similarity * (sizes[i] + sizes - shared) - 1e-9) & (roots != roots[i]) & (sizes > 0)
        if side is not None:
            ok &= side != side[i]
        out += [(i, j) for j in np.flatnonzero(ok).tolist()]
    return out


def across(members: DataFrame, sets: DataFrame, similarity: float, n: int) -> DataFrame:
    """(a, b) of every two of n members of a key that are in different components and similar. A key's members are dealt
    to blocks and every two blocks meet by themselves, so no key is one task."""
    sized = members.join(sets.select("node", F.size("hashes").alias("n")), "node")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / PER_BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = materialize(sized.groupBy("key").agg(blocks.alias("blocks")), "block-sizes", most_rows=n)
    dealt = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = materialize(dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root"), "blocks")

    def compare(table: pa.Table) -> pa.Table:
        node, block = table.column("node").to_numpy(), table.column("block").to_numpy()
        hashes = [x.values.to_numpy().view(np.uint32) for x in table.column("hashes")]
        # a block by itself, or one against another
        found = links_of(hashes, table.column("root").to_numpy(), block if (block != block[0]).any() else None, similarity)
        pairs = {(min(node[i], node[j]), max(node[i], node[j])) for i, j in found}
        return pa.table({"a": pa.array([a for a, _ in pairs], pa.int64()), "b": pa.array([b for _, b in pairs], pa.int64())})

    cells = dealt.join(sets, "node").groupBy("key", "i", "j")
    return cells.applyInArrow(compare, "a long, b long").distinct()


def verified(sets: DataFrame, pairs: DataFrame, similarity: float, n: int) -> DataFrame:
    """Of at most n pairs (a, b), those whose shingle sets are so similar."""
    ids = materialize(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), "pair-ids", most_rows=2 * n)
    sets = materialize(sets.join(ids, "node", "left_semi"), "pair-shingles")
    left, right = (sets.select(F.col("node").alias(x), F.col("hashes").alias(f"of_{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(shared >= F.lit(similarity) * (F.size("of_a") + F.size("of_b") - shared) - 1e-9).select("a", "b")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the near duplicates of another document: of each group the rows of the smallest id stay, all columns."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    gone = materialize(found.where("doc_id <> component_id").select("doc_id"), "near-gone")
    return drop_ids(docs, gone, id_col)
