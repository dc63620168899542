"""Each operator against a brute-force version, on a table with every odd case."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loomdoc.llm import chat, exact_dedup, gif, mixing, packing, simhash, suffix_dedup, token_files, tokens
from loomdoc.llm.tokens import WordIds, public_path

from . import cases

LAST = (1 << 63) - 1


def key(i):
    return LAST if i is None else i


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(spark, clashes=True).repartition(3).cache()


ROWS = cases.documents()


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# 10


def normal(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


def test_exact_dedup(spark, docs):
    groups = collections.defaultdict(list)
    for i, t, *_ in ROWS:
        groups[normal(t)].append(i)
    got = exact_dedup.exact_dedup(docs, fan_in=2).collect()
    assert len(got) == len(ROWS)
    by_text = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_text[r.text_sha256]
        assert (r.group_size, key(r.keep_id)) == (len(ids), min(map(key, ids)))
    assert collections.Counter(r.text_sha256 for r in got if r.kept) == collections.Counter(by_text.keys())
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(cases.empty(spark)).count() == 0


def test_runs_meet_in_binomial_rounds(spark):
    assert exact_dedup.tree(1, 8) == (2, 1) and exact_dedup.tree(12, 8) == (4, 2) and exact_dedup.tree(211, 8) == (6, 3) and exact_dedup.tree(8, 2) == (2, 3)
    text = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 700).cast("string"))
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), (F.lit(3000) - F.col("id")).alias("rid"), F.unhex(F.sha2(text, 256)).alias("sha"), F.length(text).alias("size"))
    for fan_in, least in ((2, 8), (3, 9), (8, 12)):
        merged = exact_dedup.merge_runs(rows, least, fan_in)
        physical = merged._jdf.queryExecution().executedPlan().toString()
        rounds = exact_dedup.tree(least, fan_in)[1]
        assert physical.count("Exchange shufflepartitionidpassthrough") == rounds == physical.count("Exchange ") == physical.count("- Sort ") and "Python" not in physical
        got = {bytes(r.sha): (r.best.doc_id, r.members) for r in merged.collect()}
        assert len(got) == merged.count() and got[hashlib.sha256(b"hot").digest()] == (0, 1000)
        for k in range(700):
            mine = [i for i in range(3000) if i % 700 == k and i % 3]
            assert got.get(hashlib.sha256(str(k).encode()).digest()) == ((min(mine), len(mine)) if mine else None)


def test_large_groups_meet_their_rows_in_parts(spark, monkeypatch):
    from loomdoc.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 10)
    rows = [(i, "same" if i % 3 else f"text {i % 60}", None, None, None) for i in range(600)]
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(cases.frame(spark, rows=rows)).collect()}
    assert got == {i: (1, 400, i == 1) if i % 3 else (i % 60, 10, i < 60) for i in range(600)}


def test_drop_exact_duplicates(spark, docs):
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    got = collections.Counter((r.doc_id, normal(r.text)) for r in out.collect())
    want = {}
    for i, t, *_ in ROWS:
        want[normal(t)] = min(want.get(normal(t), LAST), key(i))
    assert got == collections.Counter((None if i == LAST else i, t) for t, i in want.items())
    assert exact_dedup.drop_exact_duplicates(cases.empty(spark)).count() == 0


# 1


def brute_removal(rows, length):
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, LAST), key(i))
    out = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < key(i):
                covered[p : p + length] = b"\1" * length
        kept = bytes(x for x, c in zip(b, covered) if not c)
        spans = len(re.findall(b"\1+", bytes(covered)))
        out.append((i, len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("length", [50, 30])
def test_suffix_dedup(docs, length):
    got = suffix_dedup.suffix_dedup(docs, length)
    assert sorted_rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_removal(ROWS, length)


def test_suffix_dedup_of_repetitive_bytes(spark):
    rows = [(i, t, None, None, None) for i, t in enumerate(["a" * 200, "a" * 300 + "b", "ab" * 100, "x" + "ab" * 60, "b" + "a" * 49, "c" * 49, "c" * 50, "c" * 51, "日本" * 40, "本日" * 40])]
    got = suffix_dedup.suffix_dedup(cases.frame(spark, rows=rows), with_text=True)
    assert sorted_rows(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_removal(rows, 50)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got.collect())
    assert suffix_dedup.suffix_dedup(cases.empty(spark)).count() == 0


def test_long_texts_go_in_blocks(monkeypatch):
    data = np.frombuffer(cases.prose(__import__("random").Random(1), 3000).encode(), np.uint8)
    whole = suffix_dedup.document_anchors(data, 50)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    parts = suffix_dedup.document_anchors(data, 50)
    at = {int(w): int(p) for p, a, b in zip(*whole[:3]) for w in range(a, b + 1)}
    assert {int(w): int(p) for p, a, b in zip(*parts[:3]) for w in range(a, b + 1)} == at and len(at) == len(data) - 49


def test_loser_tree():
    rng = np.random.default_rng(3)
    for k in (1, 2, 3, 7, 16):
        runs = [sorted({bytes(rng.integers(97, 99, rng.integers(1, 9)).astype(np.uint8)) for _ in range(rng.integers(0, 30))}) for _ in range(k)]
        decoded = [suffix_dedup.front_decode(suffix_dedup.front_code(r, np.arange(len(r)))) for r in runs]
        assert [d[0] for d in decoded] == runs
        got = list(suffix_dedup.merge(decoded))
        assert [g[0] for g in got] == sorted(x for r in runs for x in r)
        assert all(g[0] == runs[g[1]][g[2]] for g in got)
        assert all(h == suffix_dedup.shared_prefix(a[0], b[0]) for a, b, h in zip(got, got[1:], [g[3] for g in got[1:]]))


def test_phrases_shorter_than_a_window_are_not_exchanged():
    rng = __import__("random").Random(8)
    texts = [rng.randbytes(90).hex() + " a phrase of 27 bytes only " + rng.randbytes(90).hex() for _ in range(200)]
    table = __import__("pyarrow").table({"doc_id": list(range(200)), "text": texts})
    chunk = suffix_dedup.Chunk(table, 50, 1)
    none = __import__("pyarrow").table({"range": [0], "bits": [bytes(len(chunk.unique) // 8 + 1)]})
    assert not chunk.suffixes(none)


def made_runs(n, per_head, seed):
    """Runs of n whose heads are in so many of them each, with tails that are equal in part."""
    rng = __import__("random").Random(seed)
    keys = [set() for _ in range(n)]
    for _ in range(1500):
        head = rng.randbytes(8 + suffix_dedup.HEAD)
        text = rng.randbytes(68)
        for run in rng.sample(range(n), per_head):
            body = bytearray(text)
            body[rng.randrange(68)] ^= 1
            left, more = rng.randrange(35), rng.randrange(20)
            more = min(more, left)
            after = 34 - left + more
            keys[run].add(head + bytes(body[34 : 34 + after]) + bytes(body[34 - left : 34]) + bytes([left, more]))
    return [suffix_dedup.front_code(sorted(k), np.array([rng.randrange(50) for _ in k], np.int64)) for k in keys]


def test_more_runs_dont_make_a_head_cost_more(monkeypatch):
    calls = []
    real = suffix_dedup.shared_prefix
    for n in (4, 256):
        runs = made_runs(n, 2, n)
        calls.append(0)

        def counted(*args):
            calls[-1] += 1
            return real(*args)

        monkeypatch.setattr(suffix_dedup, "shared_prefix", counted)
        suffix_dedup.merge_range(runs, 50)
        monkeypatch.setattr(suffix_dedup, "shared_prefix", real)
    assert calls[1] <= 1.1 * calls[0]


def test_few_suffixes_are_compared_like_many(monkeypatch):
    runs = made_runs(12, 6, 1)
    few = suffix_dedup.merge_range(runs, 50)
    assert any(any(m) for m in few)
    monkeypatch.setattr(suffix_dedup, "FEW", 0)
    assert suffix_dedup.merge_range(runs, 50) == few


# 3


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0d]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(n, linked):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                up[top(i)] = top(j)
    return [top(i) for i in range(n)]


def test_simhash_components(spark, docs):
    fps = [brute_fingerprint(t) for _, t, *_ in ROWS]
    group = closure(len(ROWS), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    least = {}
    for g, r in zip(group, ROWS):
        least[g] = min(least.get(g, LAST), key(r[0]))
    want = sorted(((r[0], f"{f:016x}", None if least[g] == LAST else least[g]) for r, f, g in zip(ROWS, fps, group)), key=repr)
    assert sorted_rows(simhash.simhash_components(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.simhash_components(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("threshold", [1, 2])
def test_links_are_complete(spark, threshold):
    rng = np.random.default_rng(1)
    fps = set()
    for seed in rng.integers(0, 1 << 63, 40):
        fps.add(int(seed))
        for _ in range(12):
            f = int(seed)
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                f ^= 1 << int(b)
            fps.add(f - (1 << 64) if f >= 1 << 63 else f)
    fps = sorted(fps)
    df = spark.createDataFrame([(0, f, f) for f in fps], "slot int, node long, fp long")
    got = [tuple(r) for r in simhash.links(df, threshold).collect()]
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= threshold}
    assert len(got) == len(set(got)) and set(got) == want


def test_replicas_are_never_broadcast(spark):
    """The default threshold takes a small table of nodes for small replicas."""
    nodes = spark.range(2000).select(F.lit(0).alias("slot"), F.col("id").alias("node"), F.xxhash64("id").alias("fp"))
    plan = simhash.links(nodes, 2)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_golay_code_is_perfect():
    _, _, leader, *_ = simhash.golay(0)
    assert len(set(leader.tolist())) == 2048 and max(int(x).bit_count() for x in leader) == 3
    assert min((m << 11 ^ simhash.remainder(m << 11)).bit_count() for m in range(1, 4096)) == 7


def test_near_duplicates(spark):
    rng = __import__("random").Random(11)
    rows, groups = [], []
    for g in range(25):
        words = cases.prose(rng, 250).split(" ")
        for c in range(3):
            copy = list(words)
            for _ in range(c * 2):
                copy[rng.randrange(250)] = "edit" + str(rng.randrange(10**6))
            rows.append((3 * g + c, " ".join(copy), "en", "s", 0))
            groups.append(g)
    df = cases.frame(spark, rows=rows)
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t, *_ in rows]
    want = closure(len(rows), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    linked = [i for i in range(len(rows)) if want[i] != i]
    assert all(groups[i] == groups[c] for i, c in got.items())
    assert sum(got.get(i, i) == i for i in linked) <= 0.05 * len(linked)
    left = simhash.drop_near_duplicates(df)
    assert left.columns == df.columns and {3 * g for g in range(25)} <= {r.doc_id for r in left.collect()}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def five_words(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def edited(rng, words, blocks, low=0):
    """words with so many of their blocks of ten changed to new words, spread over the text from the low-th on."""
    out = list(words)
    for b in rng.sample(range(low, len(words) // 10), blocks):
        out[10 * b + rng.randrange(10)] = f"new{rng.randrange(10**9)}"
    return out


def test_near_duplicates_with_new_words_in_a_small_vocabulary(spark):
    rng = __import__("random").Random(3)
    rows = []
    for g in range(60):
        words = [f"w{rng.randrange(400)}" for _ in range(2000)]
        rows += [(2 * g, " ".join(words), "en", "s", 0), (2 * g + 1, " ".join(edited(rng, words, 42)), "en", "s", 0)]
    sets = [five_words(t) for _, t, *_ in rows]
    assert all(0.8 <= jaccard(sets[2 * g], sets[2 * g + 1]) < 0.84 for g in range(60))
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(cases.frame(spark, rows=rows)).collect()}
    assert got == {i: i - i % 2 for i in range(120)}


def test_recall_by_similarity(spark):
    """Every band from 0.8 on; the queries are all rows, pairs by brute force over an inverted index."""
    rng = __import__("random").Random(9)
    rows = []
    for blocks in (2, 4, 7, 9, 11, 14):
        for _ in range(40):
            words = [f"w{rng.randrange(700)}" for _ in range(600)]
            rows += [(len(rows), " ".join(words), "en", "s", 0), (len(rows) + 1, " ".join(edited(rng, words, blocks)), "en", "s", 0)]
    sets = [five_words(t) for _, t, *_ in rows]
    index = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            index[x].append(i)
    pairs = {(i, j) for ids in index.values() for j in ids for i in ids if i < j}
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(cases.frame(spark, rows=rows)).collect()}
    met, all_ = collections.Counter(), collections.Counter()
    for i, j in pairs:
        if (s := jaccard(sets[i], sets[j])) >= 0.8:
            all_[int(s * 20)] += 1
            met[int(s * 20)] += got.get(i, i) == got.get(j, j)
    assert set(all_) == {16, 17, 18, 19} and min(all_.values()) >= 25
    assert all(met[k] >= 0.98 * all_[k] for k in all_)
    assert all(jaccard(sets[i], sets[c]) >= 0.8 for i, c in got.items())  # pairs alone, so a member is linked to its name


def test_simhash_of_large_groups(spark, monkeypatch):
    from loomdoc.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 10)
    rows = [(i if i % 7 else None, "same words in all of these" if i % 3 else f"own text number {i}", None, None, None) for i in range(400)]
    got = collections.Counter((r.doc_id, r.component_id, r.fingerprint) for r in simhash.simhash_components(cases.frame(spark, rows=rows)).collect())
    assert sum(got.values()) == 400
    same = f"{brute_fingerprint(rows[1][1]):016x}"
    mine = {k: n for k, n in got.items() if k[2] == same}
    assert sum(mine.values()) == 266 and {k[1] for k in mine} == {1}


def test_near_duplicates_around_a_middle_id(spark, monkeypatch):
    rng = __import__("random").Random(4)
    words = cases.prose(rng, 600).split(" ")
    rows = [(i, " ".join(words if i == 150 else edited(rng, words, 11)), "en", "s", 0) for i in range(300)]
    sets = [five_words(t) for _, t, *_ in rows]
    assert all(jaccard(s, sets[150]) >= 0.8 for s in sets)
    assert sum(jaccard(sets[i], sets[j]) >= 0.8 for i in range(150) for j in range(i)) < 150
    df = cases.frame(spark, rows=rows).repartition(3)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == dict.fromkeys(range(300), 0)
    monkeypatch.setattr(simhash, "PIVOTS", 0)  # pair by pair from the start
    monkeypatch.setattr(simhash, "PER_BLOCK", 20)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == dict.fromkeys(range(300), 0)


def test_near_dedup_links_fingerprints_at_anchors(spark, monkeypatch):
    import corpus_pipeline

    rng = __import__("random").Random(12)
    rows = []
    for g in range(60):
        words = cases.prose(rng, 500).split(" ")
        rows += [(len(rows) + c, " ".join(edited(rng, words, c)), "en", "s", 0) for c in range(3)]
    df = cases.frame(spark, rows=rows)
    sets = simhash.shingle_sets(df, 5, "doc_id", "text")
    fps = {r.node: r.fp for r in simhash.set_fingerprints(sets).collect()}
    words = [five_words(t) for _, t, *_ in rows]
    alike = [(i, j) for i in fps for j in fps if i < j and ((fps[i] ^ fps[j]) & (1 << 64) - 1).bit_count() <= 2]
    linked = {(i, j) for i, j in alike if jaccard(words[i], words[j]) >= 0.8}
    want = closure(len(rows), lambda i, j: (j, i) in linked)
    assert len(linked) >= 20
    # without the keys of minima: what fingerprints find by themselves
    monkeypatch.setattr(simhash, "in_bands", lambda sets, *_: sets.selectExpr("node as key", "node"))
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, df, "").collect()}
    assert left == {min(i for i in range(len(rows)) if want[i] == root) for root in set(want)}


def test_blocks_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PER_BLOCK", 6)
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 32, 60)
    sets = []
    for i in range(70):
        new = rng.integers(0, 1 << 32, rng.integers(0, 14))
        sets.append(np.unique(np.concatenate([rng.permutation(base)[: 60 - len(new)], new]).astype(np.uint32)))
    sets += [np.zeros(0, np.uint32)] * 3
    like = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9
    roots = [i // 2 if i < 40 else i for i in range(73)]
    for side in (None, np.arange(73) % 2):
        got = {(min(x), max(x)) for x in simhash.links_of(sets, np.array(roots), side, 0.8)}
        want = {(i, j) for j in range(70) for i in range(j) if roots[i] != roots[j] and like(i, j) and (side is None or side[i] != side[j])}
        assert {x for x in got if x[1] < 70} == want and len(want) > 20
    members = spark.createDataFrame([(k, n, roots[n]) for k in (1, 2) for n in range(k - 1, 70)] + [(3, 70, 70), (3, 71, 71), (3, 72, 72)], "key long, node long, root long")
    table = spark.createDataFrame([(n, [int(x) for x in h.view(np.int32)]) for n, h in enumerate(sets)], "node long, hashes array<int>")
    got = {(r.a, r.b) for r in simhash.across(members, table, 0.8, members.count()).collect()}
    assert {x for x in got if x[1] < 70} == {(i, j) for j in range(70) for i in range(j) if roots[i] != roots[j] and like(i, j)}
    assert closure(3, lambda i, j: (70 + j, 70 + i) in got) == [0, 0, 0] or {(70, 71), (70, 72)} <= got


def test_band_keys_meet_as_often_as_the_similarity_says():
    rng = np.random.default_rng(8)
    for s in (0.8, 0.5):
        n = round(200 * (1 - s) / (1 + s))  # of 200 hashes each, so many are their own
        met = []
        for _ in range(300):
            h = rng.integers(0, 1 << 32, 200 + n).astype(np.uint32)
            met.append((simhash.band_keys(h[:200], 40, 5) == simhash.band_keys(h[n:], 40, 5)).mean())
        j = (200 - n) / (200 + n)
        assert np.mean(met) == pytest.approx(j**5, rel=0.1)


def test_near_duplicates_of_odd_rows(spark, docs):
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    ids = collections.Counter(r.doc_id for r in left.collect())
    assert ids[None] == 2 and ids[1] == 1 and ids[2] == 0 and ids[9] == 1 and ids[10] == 0 and ids[11] == 2
    assert simhash.drop_near_duplicates(cases.empty(spark)).count() == 0


# 5 and 7


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    out = {}
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        out[name] = Tokenizer.from_file(public_path(name))
    return out


def test_word_ids_are_the_tokenizers(whole):
    odd = ["", " a", "a  b", "a \n b", "it's <|endoftext|> x", "a<|endoftext|>", "<|startoftext|> b <|endoftext|><|endoftext|> c", "x <|ENDOFTEXT|> y", "The THE the. The, End", "I'M It's DON'T X1Y2 A-B", "İstanbul ΣΑΣ. ok", "a\x1cb\x85d e　f", "\n\nhi  ", "é a ́b", "don't, x.y z!!", "ſt ßa", "tab\tx"]
    for name, t in whole.items():
        ids = WordIds(public_path(name), max_words=20)
        for text in odd + [r[1] or "" for r in ROWS]:
            assert ids.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
        ids = WordIds(public_path(name), specials_as_text=True)
        t.encode_special_tokens = True
        plain = [t.encode(text, add_special_tokens=False).ids for text in odd]
        t.encode_special_tokens = False
        assert [ids.encode(text).tolist() for text in odd] == plain


def test_words_are_looked_up_once_for_many_texts(whole):
    name = "word_bpe_49k.json"
    odd = ["", None, "  ", " it's. x", "The THE the. The!!! the''***", "a<|startoftext|>,, b", "x <|ENDOFTEXT|>. y", "don't, DON'T?", "İ. é. ÷. ΣΑΣ. 한. ½. 1. ». »", "e\u0301. J\u030c. =\u0338 <.\u0338", "a\x1cb. \x85d\xa0e.", "\x01. \x7f.", "ꝏ. ɐ. ſ. K.", "\U0001f600. ok", "le été. LE ÉTÉ, où? ß. ÿ;"]
    texts = odd + [r[1] for r in ROWS] + odd
    want = [whole[name].encode(t or "", add_special_tokens=False).ids for t in texts]
    for most in (20, 1_200_000):
        ids = WordIds(public_path(name), max_words=most)
        for given in (pa.array(["before", *texts])[1:], pa.array(["before", *texts], pa.large_string())[1:]):
            for slice_bytes in (1, 40, 1 << 20):
                assert [x.tolist() for x in ids.encode_all(given, slice_bytes)] == want
    spaced = WordIds(public_path("byte_bpe_50k.json"))
    assert [x.tolist() for x in spaced.encode_all(pa.array(odd))] == [whole["byte_bpe_50k.json"].encode(t or "", add_special_tokens=False).ids for t in odd]
    ids, asked = WordIds(public_path(name)), []
    ids.get = lambda word: asked.append(word) or dict.get(ids, word)
    texts = ["stem stem. Stem!!! STEM*** other"] * 500 + ["other, stem?"]
    assert [x.tolist() for x in ids.encode_all(pa.array(texts))] == [whole[name].encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted(asked) == ["", "!!!", "***", ",", ".", "?", "other", "stem"]


def test_new_words_of_many_texts_go_through_the_merges_at_once(whole):
    rng = __import__("random").Random(4)
    texts = [" ".join(cases.prose(rng, 40).replace(" ", rng.choice([" ", "\n"])) + f"{rng.randrange(10**9)}Été." for _ in range(3)) for _ in range(200)]
    ids, asked = WordIds(public_path("byte_bpe_50k.json")), []
    ids._plain = ids._all = lambda *given: asked.append(given) or np.zeros(0, np.uint32)
    want = [x.ids for x in whole["byte_bpe_50k.json"].encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in ids.encode_all(pa.array(texts))] == want
    assert not asked and not ids and not ids.firsts and not ids.others


def test_texts_in_arrays_are_cut_as_the_tokenizer_cuts(whole):
    rng = __import__("random").Random(6)
    atoms = [*"abeThs.,!#", "the", "ing", "é", "ß", "÷", "×", "À", "ɏ", "ɐ", "²", "ª", "1", "23", "'", "'s", "'ll", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\v"]
    rare = ["\x1c", "\x01", "\x85", "\xa0", "\u2003", "\u3000", "\u200b", "漢", "Д", "\U0001f600", "e\u0301", "<|endoftext|>", "x" * 70, " " * 60]
    texts = [None, "", *("".join(rng.choices(atoms + rare * (i % 3 == 0), k=rng.choice((1, 3, 20, 200)))) for i in range(900)), None]
    want = [x.ids for x in whole["byte_bpe_50k.json"].encode_batch([t or "" for t in texts], add_special_tokens=False)]
    ids = WordIds(public_path("byte_bpe_50k.json"), max_words=20)
    for given in (pa.array(["before", *texts])[1:], pa.array(["before", *texts], pa.large_string())[1:]):
        for slice_bytes in (1, 400, None):
            assert [x.tolist() for x in ids.encode_all(given, slice_bytes)] == want
    assert list(ids.encode_all(pa.array([], pa.string()))) == []


def test_merges_are_the_models_in_whatever_order():
    from tokenizers import models

    rng = __import__("random").Random(5)
    letters = tokens.byte_letters()
    for _ in range(20):
        vocab, merges = {c: n for n, c in enumerate(letters.values())}, []
        for _ in range(60):
            pair = (rng.choice(["a", "b", "c", *list(vocab)[256:]]), rng.choice(["a", "b", "c", *list(vocab)[256:]]))
            if pair not in merges and len("".join(pair)) < 8:
                merges.append(pair)
                vocab.setdefault("".join(pair), len(vocab))
        rng.shuffle(merges)  # a pair may outrank what its halves are made by
        model, ours = models.BPE(vocab=vocab, merges=merges, cache_capacity=0), tokens.Merges({"vocab": vocab}, merges, letters)
        for n in (1, 2, 3, 9, 48):
            pieces = ["".join(rng.choices("abc", k=n)) for _ in range(80)]
            got = {}
            for columns, ids in ours.group(np.array([list(x.encode()) for x in pieces], np.uint8).T):
                got |= dict(zip(columns.tolist(), ids.T.tolist(), strict=True))
            assert [got[i] for i in range(80)] == [[t.id for t in model.tokenize(x)] for x in pieces]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark, docs, whole):
    got = packing.pack_documents(docs, public_path("byte_bpe_50k.json"), bucket_pieces=7).collect()
    want = []
    for i, t, *_ in ROWS:
        ids = whole["byte_bpe_50k.json"].encode(t or "", add_special_tokens=False).ids + [2]
        head = len(ids) % 1024
        cuts = ([0, head] if head else [0]) + list(range(head + 1024, len(ids) + 1, 1024))
        want += [(i, n, a, b - a, crc(ids[a:b])) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack_documents(cases.empty(spark), public_path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_limit(rule):
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 700, 600)
    bins = packing.best_fit(lengths, 1024, max_docs=4, max_cost=300_000, rule=rule)
    for b in np.unique(bins):
        mine = lengths[bins == b]
        assert mine.sum() <= 1024 and len(mine) <= 4 and ((mine**2).sum() <= 300_000 or len(mine) == 1)
    plain = packing.best_fit(lengths, 1024, rule="norm")
    assert plain.max() + 1 <= -(-lengths.sum() // 1024) * 1.02 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [(None, None), (3, None), (None, 200_000), (4, 300_000)])
def test_best_fit_against_brute_force(rule, limits):
    """Longest first, each into the open sequence that the vector rule likes best."""
    room, weights = 1024, (1.0, 0.3, 0.3)
    full = [room, limits[0] or room, limits[1] or room * room]
    lengths = np.random.default_rng(7).integers(1, 800, 250)
    left, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = [lengths[i], 1, min(int(lengths[i]) ** 2, full[2])]
        best = None
        for b, have in enumerate(left):
            if all(h >= n for h, n in zip(have, need)):
                if rule == "norm":
                    score = sum(w * ((h - n) / f) ** 2 for w, h, n, f in zip(weights, have, need, full))
                else:
                    score = -sum(w * (h / f) * (n / f) for w, h, n, f in zip(weights, have, need, full))
                if best is None or score < best[0] - 1e-12:
                    best = (score, b)
        if best is None:
            left.append(list(full))
            best = (0, len(left) - 1)
        left[best[1]] = [h - n for h, n in zip(left[best[1]], need)]
        want[i] = best[1]
    got = packing.best_fit(lengths, room, *limits, weights=weights, rule=rule)
    assert got.tolist() == [want[i] for i in range(len(lengths))]


def test_documents_and_cost_decide_among_equal_rooms():
    """What is left of tokens is the same in two sequences; the one whose other capacities fit better is taken."""
    bins = packing.Bins(np.array([100.0, 100.0, 10_000.0]), np.array([1.0, 0.3, 0.3]), "norm", 3)
    bins.left[:, :2], bins.names[:2], bins.open, bins.opened = np.array([[50.0, 98.0, 9000.0], [50.0, 60.0, 4000.0]]).T, [0, 1], 2, 2
    assert bins.place((10, 1, 100)) == 1


def test_documents_go_into_few_sequences(spark):
    rng = __import__("random").Random(3)
    rows = [(i, cases.prose(rng, rng.randrange(1, 220)), "en", "s", 0) for i in range(1500)]
    got = packing.pack_documents(cases.frame(spark, rows=rows), public_path("byte_bpe_50k.json"), bucket_pieces=400)
    n, total = got.agg(F.countDistinct("sequence_id"), F.sum("length")).first()
    assert -(-total // 1024) <= n <= 1.015 * total / 1024 + 1


def test_token_files(spark, docs, whole):
    shards = token_files.write_shards(docs, public_path("word_bpe_49k.json"), shard_tokens=300)
    got = token_files.read_shards(shards, with_ids=True).orderBy("start").collect()
    ids = {}
    at = 0
    order = sorted(ROWS, key=lambda r: (key(r[0]), r[1] or ""))
    for r, (i, t, *_) in zip(got, order, strict=True):
        ids = whole["word_bpe_49k.json"].encode(t or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), crc(ids))
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        at += len(ids)
    assert token_files.read_shards(token_files.write_shards(cases.empty(spark), public_path("word_bpe_49k.json"))).count() == 0


def test_a_small_table_is_one_range_of_shards(spark, docs):
    shards = token_files.write_shards(docs, public_path("word_bpe_49k.json"), shard_tokens=300)
    assert [r.part for r in shards.select("part").distinct().collect()] == [0]
    assert [r.seq for r in shards.orderBy("start").collect()] == list(range(shards.count()))


def test_grammar_gives_random_access():
    rng = np.random.default_rng(4)
    for base, top in ((49408, 40), (70000, 60000)):
        docs = [rng.choice(top, n, p=None).astype(np.uint32) for n in rng.integers(1, 200, 60)] + [np.tile(np.array([5, 6, 7], np.uint32), 400), np.full(999, 3, np.uint32)]
        image = token_files.compress(docs, list(range(len(docs))), base, min_count=2)
        shard = token_files.Shard(image)
        every = np.concatenate(docs)
        assert (shard.all() == every).all() and len(shard.symbols) < len(every)
        for i in (0, 7, len(docs) - 1, len(docs) - 2):
            assert (shard.document(i) == docs[i]).all()
        for start, n in ((0, 1), (17, 300), (len(every) - 5, 5), (len(every) - 1500, 800)):
            assert (shard.tokens(start, n) == every[start : start + n]).all()
    with pytest.raises(ValueError):
        token_files.Shard(b"nope" + bytes(40))


def test_compression_goes_on_until_no_pair_is_frequent():
    text = np.random.default_rng(6).permutation(4096).astype(np.uint32)
    docs = [text] * 40
    shard = token_files.Shard(token_files.compress(docs, list(range(40)), 49408))
    assert len(shard.symbols) == 40 and shard.length.max() == 4096
    assert (shard.document(7) == text).all() and (shard.all() == np.concatenate(docs)).all()


# 6


def test_mixing(spark, docs):
    got = mixing.mix(docs, bins=8).collect()
    assert len(got) == len(ROWS)
    size = collections.Counter()
    for _, t, _, s, _ in ROWS:
        size[s] += len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    order = sorted((s for s in {r[3] for r in ROWS} if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(size.values())
    while True:  # the excess goes round until none is above its cap
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        open_ -= over
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    for s in order:  # rows that share an id are taken alike, so the step is at most two rows
        assert abs(taken[s] - target[s]) <= 2 * largest[s]
    assert sorted_rows(mixing.mix(docs.repartition(5), bins=64), "doc_id", "taken") == sorted((tuple([r.doc_id, r.taken]) for r in got), key=repr)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies = collections.Counter((r.doc_id, r.text) for r in mixed.collect())
    want = collections.Counter()
    for r, (i, t, *_) in zip(sorted(got, key=lambda r: (repr(r.doc_id), r.size, repr(r.source))), sorted(ROWS, key=lambda r: (repr(r[0]), len(re.findall(r"[^\x20\x09-\x0d]+", r[1] or "")), repr(r[3])))):
        want[i, t] += r.n_copies
    assert copies == +want
    assert mixing.mix(cases.empty(spark)).count() == 0 and mixing.mixed_documents(cases.empty(spark)).count() == 0


def test_pareto_sampling_follows_importance(spark):
    rows = [(i, "w " * 10, "en", "s1" if i % 4 else "s2", 0) for i in range(4000)]
    df = cases.frame(spark, rows=rows).withColumn("quality", (F.col("doc_id") % 2 + 1).cast("double"))
    got = mixing.mix(df, weights=(1, 1), budget=0.5, importance="quality")
    by = {r.odd: r.n for r in got.where("source = 's1'").groupBy((F.col("doc_id") % 2).alias("odd")).agg(F.avg("n_copies").alias("n")).collect()}
    assert by[1] / by[0] == pytest.approx(2, rel=0.15)
    total = got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()
    assert all(abs(r.t - r.target) <= 10 for r in total)


# 9


TALK = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello </s> [INST]"), (2, 0, "user", "hi"), (2, 1, "assistant", "hello </s> [INST]"), (2, 2, "user", "more\\l\\"),
    (3, 0, "user", "hi"), (3, 1, "assistant", None), (4, 0, "system", "<<SYS>>x<</SYS>>"), (4, 1, None, "t"), (5, 0, "tool>>", "[/INST] <</ROLE>>"),
    (None, 1, "assistant", "b"), (None, 0, "user", "a"), (6, 0, "user", "hi"), (6, 0, "assistant", "same turn"), (7, 0, "user", "hi"), (7, 0, "user", "hi"), (8, None, "user", ""), (9, 0, "assistant", "x" * 100_000),
]


def test_chat(spark):
    df = chat.with_probe(spark.createDataFrame([(*r, 1) for r in TALK], "conv_id long, turn long, role string, text string, tree int"))
    rows = [*TALK, (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    by = collections.defaultdict(list)
    for c, n, role, text in rows:
        by[c].append((n is not None, n or 0, role or "", text or ""))
    want = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        chars = sum(len(chat.render(r, t)[0]) for _, _, r, t in turns)
        want[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)
    for size in (256, 2):
        built = chat.trees(df, group_size=size)
        assert {r[0]: tuple(r)[1:] for r in chat.read_back(built).collect()} == want
    shared = chat.trees(df).collect()
    for tree in shared:
        assert tree.text == "".join(tree.text[n.begin : n.end] for n in tree.nodes)
        starts = [n.begin for n in tree.nodes]
        assert starts == sorted(starts)
    hello = [t for t in shared if "hello" in t.text]
    assert len(hello) == 1 and hello[0].text.count("hello") == 1
    assert chat.read_back(chat.trees(df.limit(0))).count() == 0


def test_a_shared_prefix_is_split_where_conversations_part(spark):
    talk = lambda c, i: ("user" if i % 2 == 0 else "assistant", "hi" if i == 0 else f"pair {c // 2} turn {i}" if i < 5 else f"own {c} turn {i}")
    rows = [(c, i, *talk(c, i)) for c in range(600) for i in range(6)]
    rows += [(1000 + c, i, r, t) for c in range(300) for i, (r, t) in enumerate([("user", "hi"), ("assistant", "same")])]  # the same to their ends
    rows += [(2000 + c, 0, "user", f"alone {c % 20}") for c in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    built = chat.trees(df, group_size=128).collect()
    assert sum(len(t.leaves) for t in built) == 940 and max(len(t.leaves) for t in built) <= 128
    talks = [t for t in built if "pair" in t.text]
    assert sum(len(t.nodes) for t in talks) == 300 * 6 + len(talks) and len(talks) <= 12
    texts = collections.Counter(t.text[n.begin : n.end] for t in talks for n in t.nodes)
    assert {n for x, n in texts.items() if "hi" not in x} == {1}  # every turn below the trunk once
    assert sum(len(t.nodes) for t in built if "same" in t.text) <= 2 * 8
    assert sum("alone" in t.text for t in built) == 20
    read = {r.conv_id: r.n_turns for r in chat.read_back(chat.trees(df, group_size=3)).collect()}
    assert read == dict(collections.Counter(r[0] for r in rows))


@pytest.mark.parametrize("text", ["", "\\", "\\l", "[INST]", "[\\INST]", "</s", "<<SYS>>", "<<<SYS>>", "[[INST]]", "<", "[", "\\\\b", "</s></s>", "[/INST] ", " [INST]"])
@pytest.mark.parametrize("role", ["user", "assistant", "system", "", "a>b", "<<ROLE"])
def test_template_is_reversible(role, text):
    chars, a, b = chat.render(role, text)
    assert chat.parse(chars) == (role, text)
    assert "</s>" not in chat.escape(text) and "[INST]" not in chat.escape(text)
    assert chat.unescape(chars[a:b]) == (text if role == "assistant" else "")


def test_attention_is_the_ancestors():
    text, nodes, leaves = chat.build_tree([(1, [("user", "a"), ("assistant", "b")]), (2, [("user", "a"), ("assistant", "c")]), (3, [("user", "a")])])
    assert [n["parent"] for n in nodes] == [-1, 0, 0] and [x["node"] for x in leaves] == [0, 1, 2]
    for n in nodes[1:]:
        seen = [i for x in n["attention"] for i in range(x["begin"], x["end"])]
        assert seen == [*range(nodes[0]["begin"], nodes[0]["end"]), *range(n["begin"], n["end"])]
        assert n["position"] == nodes[0]["end"]


# 4


def test_gif_of_documents(spark, docs):
    got = sorted_rows(gif.documents_as_gif(docs), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    want = []
    for i, t, *_ in ROWS:
        raw = (t or "").encode()
        pay = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want.append((i, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-32:])))
    assert got == sorted(want, key=repr)
    by = collections.defaultdict(set)
    for r in gif.documents_as_gif(docs, with_media=True).collect():
        by[r.payload_sha256].add((r.media_sha256, r.media_bytes, r.feature))
        media = bytes(r.media)
        assert (len(media), hashlib.sha256(media).hexdigest()) == (r.media_bytes, r.media_sha256)
        again = gif.decode(media)
        assert again.error is None and hashlib.sha256(b"".join(f.pixels for f in again.frames)).hexdigest() == r.payload_sha256
        assert [f.disposal for f in r.frames] == [2] * len(again.frames) and {f.transparent for f in r.frames} == {255}
        # a frame shows the text's bytes in it and no others
        raw = b"".join(f.pixels for f in again.frames)[: r.n_bytes]
        per = 24 * 576
        for i, f in enumerate(r.frames):
            part = collections.Counter(x >> 6 for x in raw[i * per : (i + 1) * per])
            assert [f.histogram[x] for x in (0, 21, 42, 63)] == [part[q] for q in range(4)] and sum(f.histogram) == r.frames[0].height * 24
        quarters = collections.Counter(x >> 6 for x in raw)
        share = "/".join(str(quarters[q] * 1000 // max(len(raw), 1)) for q in range(4))
        assert r.feature == f"{len(r.frames)} frames, {10 * len(r.frames)} cs, grey {share}"
    assert all(len(v) == 1 for v in by.values())
    assert gif.documents_as_gif(cases.empty(spark)).count() == 0


def test_a_small_file_that_claims_a_huge_picture(spark):
    huge = b"GIF89a" + b"\xff\xff\xff\xff\0\0\0"
    frame = b"\x2c" + bytes(4) + b"\xff\xff\xff\xff\0" + b"\x02" + gif.sub_blocks(gif.lzw_encode(bytes(9), 2))
    assert "limit" in gif.decode(huge + frame + b";").error
    assert "limit" in gif.decode(b"GIF89a" + b"\x04\0\x04\0\0\0\0" + frame + b";").error
    bomb = gif.lzw_encode(bytes(1 << 20))
    assert len(gif.lzw_decode(bomb, 8, 1000)) < 1 << 19
    df = spark.createDataFrame([(1, bytearray(huge + frame + b";"))], "id int, media binary")
    assert "limit" in gif.gif_frames(df).first().gif_error


def test_lzw_round_trip():
    rng = np.random.default_rng(6)
    for bits in (2, 4, 8):
        for n in (0, 1, 2, 300, 5000, 60_000):
            for data in (rng.integers(0, 1 << bits, n), np.repeat(rng.integers(0, 1 << bits, n // 40 + 1), 40)[:n]):
                raw = data.astype(np.uint8).tobytes()
                assert gif.lzw_decode(gif.lzw_encode(raw, bits), bits) == raw
    with pytest.raises(ValueError):
        gif.lzw_decode(bytes([0b11111111, 1]), 2)


def one_frame(pixels, left, top, w, h, disposal=0, transparent=None, interlace=False, local=None, delay=5):
    packed = disposal << 2 | (transparent is not None)
    flags = (0x40 if interlace else 0) | (0x80 | 1 if local else 0)
    return (
        b"\x21\xf9\x04" + bytes([packed, delay, 0, transparent or 0, 0])
        + b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (left, top, w, h)) + bytes([flags]) + (local or b"") + b"\x02" + gif.sub_blocks(gif.lzw_encode(bytes(pixels), 2))
    )


def test_gif_rules(spark):
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    local = bytes([9, 9, 9, 255, 255, 255, 0, 0, 0, 0, 0, 0])
    head = b"GIF89a" + (4).to_bytes(2, "little") * 2 + bytes([0x81, 0, 0]) + palette + b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x07\x00\x00" + b"\x21\xfe\x03hey\x00"
    frames = [
        one_frame([1] * 16, 0, 0, 4, 4, disposal=1),
        one_frame([2, 3, 3, 2], 1, 1, 2, 2, disposal=2, transparent=3),
        one_frame([3] * 4, 0, 0, 2, 2, disposal=3),
        one_frame([0] * 4 + [1] * 4 + [2] * 4 + [3] * 4, 0, 0, 4, 4, interlace=True),
        one_frame([1], 3, 3, 1, 1, local=local),
    ]
    g = gif.decode(head + b"".join(frames) + b";")
    assert g.error is None and g.loops == 7 and [f.delay_cs for f in g.frames] == [5] * 5
    red, green, blue, none = (255, 0, 0, 1), (0, 255, 0, 1), (0, 0, 255, 1), (0, 0, 0, 0)
    c = [[[tuple(int(v) for v in p) for p in row] for row in canvas] for canvas in gif.composed(g)]
    assert c[0] == [[red] * 4] * 4
    assert c[1][1] == [red, green, red, red] and c[1][2] == [red, red, green, red]
    assert c[2][0] == [blue, blue, red, red] and c[2][1] == [blue, blue, none, red] and c[2][2] == [red, none, none, red]
    assert [row[0] for row in c[3]] == [(0, 0, 0, 1), blue, green, blue][:1] + [c[3][1][0], c[3][2][0], c[3][3][0]]
    assert [g.frames[3].pixels[i * 4] for i in range(4)] == [0, 2, 1, 3]
    assert c[4][3][3] == (255, 255, 255, 1)
    hist = gif.histogram(np.array(c[2], np.uint8))
    assert hist[64] == 3 and hist.sum() == 16
    df = spark.createDataFrame([(1, bytearray(head + frames[0] + b";")), (2, bytearray(head + frames[0])), (3, bytearray(b"GIF")), (4, None)], "id int, media binary")
    rows = gif.gif_frames(df).orderBy("id").collect()
    assert rows[0].gif_error is None and rows[0].gif_frames[0].histogram[48] == 16
    assert rows[1].gif_error and len(rows[1].gif_frames) == 1
    assert rows[2].gif_error and rows[3].gif_error and rows[3].gif_frames == []
