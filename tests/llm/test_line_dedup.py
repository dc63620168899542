"""Line dedup against a brute-force version."""

import hashlib
import random

import numpy as np
import pytest

from loomdoc.llm import line_dedup

from . import cases

LAST = (1 << 63) - 1


def brute(rows, size, long_words=50):
    docs = [((LAST if i is None else i), t or "", i) for i, t, *_ in rows]
    first = {}
    for k, t, _ in docs:
        lines = t.split("\n")
        for p in range(len(lines) - size + 1):
            w = tuple(lines[p : p + size])
            if any(x.strip() for x in w):
                first[w] = min(first.get(w, (LAST + 1, 0)), (k, p))
        for p, line in enumerate(lines):
            if len(line.split()) >= long_words:
                first[line] = min(first.get(line, (LAST + 1, 0)), (k, p))
    out = []
    for k, t, i in docs:
        lines = t.split("\n")
        gone = set()
        for p in range(len(lines) - size + 1):
            f = first.get(tuple(lines[p : p + size]))
            if f and (f[0] < k or (f[0] == k and f[1] <= p - size)):
                gone |= set(range(p, p + size))
        for p, line in enumerate(lines):
            f = first.get(line)
            if f and (f[0] < k or (f[0] == k and f[1] < p)):
                gone.add(p)
        kept = "\n".join(x for n, x in enumerate(lines) if n not in gone)
        out.append((i, len(lines), len(gone), sum(n - 1 not in gone for n in gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of_lines(seed):
    rng = random.Random(seed)
    texts = ["\n".join(rng.choice(["a", "b", "c", "", " ", "Zeile ü", "long " * 50]) for _ in range(rng.randrange(14))) for _ in range(40)]
    ids = [*range(38), None, None]
    texts[38] = texts[39] = "only\nhere\nnull"
    texts[36] = None
    return [(i, t, None, None, None) for i, t in zip(ids, texts)] + [(40, "x\n" * 3000, None, None, None), (41, "y\nz\n" * 4 + "q", None, None, None)]


@pytest.mark.parametrize("size", [1, 2, 3])
def test_line_dedup(spark, size):
    rows = rows_of_lines(size)
    got = line_dedup.line_dedup(cases.frame(spark, clashes=True, rows=rows), size, with_text=True).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == brute(rows, size)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)


def test_a_long_line_goes_by_itself(spark):
    passage, short = " ".join(f"word{i}" for i in range(50)), " ".join(f"word{i}" for i in range(49))
    rows = [(1, f"a\n{passage}\nb\n{short}", None, None, None), (2, f"c\n{passage}\n{passage}\nd\n{short}\ne", None, None, None), (3, passage, None, None, None), (None, passage, None, None, None)]
    got = {r.doc_id: (r.n_removed, [tuple(x) for x in r.runs]) for r in line_dedup.line_dedup(cases.frame(spark, rows=rows), with_runs=True).collect()}
    assert got == {1: (0, []), 2: (2, [(1, 1, 1, 1), (2, 1, 1, 1)]), 3: (1, [(0, 1, 1, 1)]), None: (1, [(0, 1, 1, 1)])}
    for size, words in ((2, 3), (3, 50), (2, None)):
        rows = rows_of_lines(size)
        want = brute(rows, size, words or 10**9)
        got = line_dedup.line_dedup(cases.frame(spark, rows=rows), size, words).collect()
        assert sorted(((r.doc_id, r.n_lines, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == want


def test_odd_tables(spark):
    rows = [r for r in cases.documents() if r[0] not in (11, 12)]
    got = line_dedup.line_dedup(cases.frame(spark, rows=rows)).drop("kept")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 2)
    assert line_dedup.line_dedup(cases.empty(spark)).count() == 0
    twice = [(1, "a\nb\nc", None, None, None)] * 2  # equal rows are treated alike
    assert [r.n_removed for r in line_dedup.line_dedup(cases.frame(spark, rows=twice)).collect()] == [0, 0]


def test_equal_runs_share_a_fingerprint():
    rng = np.random.default_rng(1)
    for size in (2, 3, 5):
        run = rng.integers(0, 1 << 40, size)
        for _ in range(30):
            at = int(rng.integers(0, 20))
            h = np.concatenate([rng.integers(0, 1 << 40, at), run, rng.integers(0, 1 << 40, 9)])
            p, a, b = line_dedup.winnow(h, np.zeros(len(h), bool), size)
            k = int(np.flatnonzero((a <= at) & (at <= b))[0])
            assert p[k] - at == int(np.argmin(run))


def test_runs_go_on_beyond_a_seed(spark):
    lines = [f"line {i}" for i in range(40)]
    rows = [(1, "\n".join(["head", *lines]), None, None, None), (2, "\n".join(["other", *lines[5:30], "x", *lines[33:35]]), None, None, None), (None, lines[3] + "\n" + lines[4], None, None, None)]
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in line_dedup.line_dedup(cases.frame(spark, rows=rows), with_runs=True).collect()}
    assert got == {1: [], 2: [(1, 25, 1, 6), (27, 2, 1, 34)], None: [(0, 2, 1, 4)]}


def test_a_line_of_a_third_of_all_documents_is_many_parts(spark, monkeypatch):
    from loomdoc.llm import common

    monkeypatch.setattr(common, "LEAST_HOT", 5)
    rows = [(i, f"own {i}\nlicense\nterms\nown {i}" if i % 3 == 0 else f"a {i}\nb {i % 50}\nlicense\nc {i}", None, None, None) for i in range(300)]
    got = line_dedup.line_dedup(cases.frame(spark, rows=rows)).drop("kept")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, 2)
    counts = spark.createDataFrame([(k, n) for k, n in ((1, 4000), (2, 9), (3, 9))], "fp long, n long")
    hot = common.hot_keys(counts, "fp")
    assert [r.fp for r in hot.collect()] == [1] and hot.first().salts >= 8
