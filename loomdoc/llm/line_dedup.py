"""Line dedup by winnowing over line hashes.

A document is its lines' hashes. Of every window of ``min_lines`` lines the
leftmost least hash is a fingerprint, so two runs of that many equal lines, or
more, have equal fingerprints at equal places: every match of that length is
guaranteed a seed. A line of ``long_words`` words or more is a window, and a
fingerprint, by itself: a passage that was one line goes whatever its neighbours
are. A seed is a fingerprint's position with the lines before and
after it, as far as its windows reach. Fingerprints that occur once are dropped.

Seeds are then joined by position. A seed is extended to the left and to the
right, line by line; every extension of ``min_lines`` lines leads to the first
place that has those lines around the same fingerprint. Matches that go on, line
for line in both documents, across one seed's reach into the next one's are one
run, so runs are as long as the texts agree. A run's later place goes whole.

A fingerprint or window of many rows is split: see ``common.hot_keys``. A text
crosses the network once, to meet its document's runs.

"Later": in a document with a larger id, or further down in the same document by as
many lines as are compared. Windows of nothing but blank lines don't count. Lines end
at U+000A; they are compared by 64-bit hashes, windows by all their hashes.

Defined cases: a null text is the empty text, one empty line; a null id is larger
than all ids; rows that share an id are ordered by a hash of their texts, and
wholly equal rows are treated alike; an empty table gives an empty result; other
columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, col, hot_keys, materialize, replicated, salted, whole

#: A line of as many words is compared by itself.
LONG_WORDS = 50
RESULT = "doc_id long, n_lines long, n_removed long, n_spans long, kept_sha256 string"


def line_hashes(text: str, long_words: int | None = None) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(hashes of the lines as signed numbers, which of them are blank, the numbers of those with so many words)."""
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    h = np.array([xxhash.xxh64_intdigest(x) for x in lines], np.uint64).view(np.int64)
    long = [i for i, x in enumerate(lines) if len(x) >= 2 * long_words - 1 and len(x.split()) >= long_words] if long_words else []
    return h, np.fromiter((not x.strip() for x in lines), bool, len(lines)), long


def winnow(hashes: np.ndarray, blank: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint's line, first window, last window) of each run of windows that have the same fingerprint and aren't all blank."""
    n = len(hashes) - size + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    windows = np.lib.stride_tricks.sliding_window_view
    least = np.argmin(windows(hashes, size), axis=1) + np.arange(n)
    least[windows(blank, size).all(axis=1)] = -1
    first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    last = np.append(first[1:], n) - 1
    some = least[first] >= 0
    return least[first][some], first[some], last[some]


def seeds(rows: DataFrame, size: int, long_words: int | None) -> DataFrame:
    """(fp, id, h, at, before, after) of rows (id, h, text): a fingerprint, its line, and the hashes of the lines around it that its
    windows hold; both null for a long line by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for id_, h, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                hashes, blank, long = line_hashes(text, long_words)
                found = [(p, hashes[a:p], hashes[p + 1 : b + size]) for p, a, b in zip(*(x.tolist() for x in winnow(hashes, blank, size)), strict=True)]
                for p, before, after in [*found, *[(p, None, None) for p in long]]:
                    for to, x in zip(out, (int(hashes[p]), id_, h, p, before, after), strict=True):
                        to.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["fp", "id", "h", "at", "before", "after"])

    return rows.mapInArrow(run, "fp long, id long, h long, at int, before array<long>, after array<long>")


def matches(rows: DataFrame, size: int, long_words: int | None = None) -> DataFrame:
    """(id, h, at, n, place) of every window, of n lines, that has been before; place (id, h, at) is where first."""
    found = materialize(seeds(rows, size, long_words), "line-seeds")
    often = materialize(found.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "line-fingerprints")
    hot = hot_keys(often, "fp")
    shared = salted(found, "fp", hot, "id", "h", "at").join(replicated(often.select("fp"), "fp", hot), ["fp", "salt"], "left_semi")
    # the extensions of a seed to `size` lines: by how many lines to the left; a long line has itself alone
    alone = F.col("before").isNull()
    lefts = F.when(alone, F.array(F.lit(0))).otherwise(F.sequence(F.greatest(F.lit(0), F.lit(size - 1) - F.size("after")), F.size("before")))
    each = shared.select("fp", "id", "h", "at", "before", "after", F.explode(lefts).alias("left"))
    around = F.concat(F.slice("before", F.size("before") - F.col("left") + 1, F.col("left")), F.array("fp"), F.slice("after", F.lit(1), F.lit(size - 1) - F.col("left")))
    each = materialize(each.select(F.when(alone, F.array("fp")).otherwise(around).alias("lines"), "id", "h", (F.col("at") - F.col("left")).alias("at")), "line-windows")
    places = each.groupBy("lines").agg(F.min(F.struct("id", "h", "at")).alias("place"), F.count(F.lit(1)).alias("n")).where("n > 1")
    places = materialize(places, "line-places")
    hot = hot_keys(places, "lines")
    met = salted(each, "lines", hot, "id", "h", "at").join(replicated(places.select("lines", "place"), "lines", hot), ["lines", "salt"])
    same = (F.col("place.id") == F.col("id")) & (F.col("place.h") == F.col("h"))
    later = F.when(same, F.col("place.at") <= F.col("at") - F.size("lines")).otherwise(F.struct("place.id", "place.h") < F.struct("id", "h"))
    return met.where(later).select("id", "h", "at", F.size("lines").alias("n"), "place")


def runs_of(windows: list[dict]) -> list[dict]:
    """Matched windows (at, n, place) of one document as runs: windows that overlap alike at both places are one."""
    runs: list[dict] = []
    open_: dict[tuple, dict] = {}
    for w in sorted(windows, key=lambda w: (w["at"], w["n"])):
        id_, h, at = w["place"]["id"], w["place"]["h"], w["place"]["at"]
        key = (id_, h, at - w["at"])
        r = open_.get(key)
        if r and w["at"] < r["begin"] + r["lines"]:
            r["lines"] = max(r["lines"], w["at"] + w["n"] - r["begin"])
        else:
            open_[key] = r = {"begin": w["at"], "lines": w["n"], "first_id": None if id_ == LAST_ID else id_, "first_begin": at}
            runs.append(r)
    return runs


RUN = "begin:int,lines:int,first_id:long,first_begin:int"


def line_dedup(docs: DataFrame, min_lines: int = 2, long_words: int | None = LONG_WORDS, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, with_runs: bool = False) -> DataFrame:
    """A row per document: doc_id, n_lines, n_removed, n_spans, kept_sha256 (and kept, the remaining lines; and runs, what went and where it was first)."""
    if min_lines < 1 or long_words is not None and long_words < 1:
        raise ValueError("min_lines and long_words are 1 at least")
    text = whole(col(docs, text_col))
    rows = docs.select(F.coalesce(col(docs, id_col).cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    gone = matches(rows, min_lines, long_words).groupBy("id", "h").agg(F.collect_set(F.struct("at", "n", "place")).alias("windows"))  # at most a document's lines
    gone = materialize(gone, "line-repeats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"doc_id": pa.int64(), "n_lines": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string()}
        kinds |= {"kept": pa.binary()} if with_text else {}
        kinds |= {"runs": pa.list_(pa.struct([("begin", pa.int32()), ("lines", pa.int32()), ("first_id", pa.int64()), ("first_begin", pa.int32())]))} if with_runs else {}
        for batch in batches:
            out: dict[str, list] = {name: [] for name in kinds}
            for id_, body, windows in zip(*(batch.column(i) for i in range(3)), strict=True):
                lines = body.as_buffer().to_pybytes().split(b"\n")
                runs = runs_of(windows.as_py() or [])
                removed = np.zeros(len(lines) + 2, np.int8)
                for r in runs:
                    removed[r["begin"] + 1 : r["begin"] + 1 + r["lines"]] = 1
                kept = b"\n".join(x for x, r in zip(lines, removed[1:], strict=False) if not r) if runs else body.as_buffer().to_pybytes()
                row = {"doc_id": None if id_.as_py() == LAST_ID else id_.as_py(), "n_lines": len(lines), "n_removed": int(removed.sum()), "n_spans": int((np.diff(removed) == 1).sum())}
                row |= {"kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept, "runs": runs}
                for name, to in out.items():
                    to.append(row[name])
            yield pa.RecordBatch.from_arrays([pa.array(out[name], kind) for name, kind in kinds.items()], list(kinds))

    # always by a shuffle of both, whatever the sizes: each text moves once
    joined = rows.hint("merge").join(gone, ["id", "h"], "left").select("id", "text", "windows")
    return joined.mapInArrow(run, RESULT + ", kept binary" * with_text + f", runs array<struct<{RUN}>>" * with_runs)


ORACLE_SQL = rf"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, i AS pos, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM s)),
w AS (SELECT *, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS win FROM l),
f AS (SELECT *, first_value(doc_id) OVER k AS first_doc, first_value(pos) OVER k AS first_at FROM w WHERE win IS NOT NULL AND regexp_matches(win, '[^\s]')
      WINDOW k AS (PARTITION BY win ORDER BY doc_id, pos)),
g AS (SELECT doc_id, pos FROM f WHERE first_doc < doc_id OR (first_doc = doc_id AND first_at <= pos - 2)),
h AS (SELECT *, first_value(doc_id) OVER k AS first_doc, first_value(pos) OVER k AS first_at FROM l WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= {LONG_WORDS}
      WINDOW k AS (PARTITION BY line ORDER BY doc_id, pos)),
r AS (SELECT doc_id, pos FROM g UNION SELECT doc_id, pos + 1 FROM g UNION SELECT doc_id, pos FROM h WHERE first_doc < doc_id OR (first_doc = doc_id AND first_at < pos)),
x AS (SELECT l.*, r.pos IS NOT NULL AS gone FROM l LEFT JOIN r USING (doc_id, pos)),
y AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY pos), false) AS begins FROM x)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM y GROUP BY doc_id"""
