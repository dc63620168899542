"""Exact dedup by a tree merge of digest runs, in DataFrame operations only.

There are as many runs as partitions, and run i is partition i. In binomial rounds
``fan_in`` partitions at a time exchange their runs: written in base ``fan_in``, the
partners of a round have numbers that differ in that round's digit alone, and each
takes the share of the digests whose own number has its digit there. A partition
then sorts what it got and merges it: of equal digests one stays, with the smallest
identifier and the number of rows. So after each round a run covers ``fan_in`` times
as many rows and a ``fan_in``-th of the digests; after the last, every digest is in
one run, in order, and no run ever has all of them.

A group that holds a third of all rows is spread over all runs at first, and is one
row of each run after its first merge. On the way back, rows meet their groups by
digest, those of large groups in as many parts as they ask for (``common.hot_keys``).

Two rows are equal if SHA-256 and byte length of their normalised texts agree
(white-space runs become one space). That pair is the key of every merge, so
each level verifies it anew; no shorter hash is trusted.

Defined cases: a null text is the empty text; a null id sorts after all ids; of
rows that share the smallest id, the first in table order stays and just that
one; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, SPACE_RUN, col, drop_ids, fresh, hot_keys, materialize, partitions, replicated, salted, whole


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rid, sha, size): one small row per document, computed once. rid is the row's own number."""
    norm = F.regexp_replace(whole(col(docs, text_col)), SPACE_RUN, " ")
    rows = docs.select(col(docs, id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("rid"), norm.alias("norm"))
    return materialize(rows.select("doc_id", "rid", F.unhex(F.sha2("norm", 256)).alias("sha"), F.octet_length("norm").alias("size")), "digests")


def tree(least: int, fan_in: int) -> tuple[int, int]:
    """(runs a merge takes, rounds): at least so many runs in all, and the fewest rounds of at most fan_in."""
    rounds = 1
    while fan_in**rounds < least:
        rounds += 1
    fan = 2
    while fan**rounds < least:
        fan += 1
    return fan, rounds


def digit(number: Column, place: int) -> Column:
    """number's digit of that place value, times the place value; see tree."""
    return number - F.pmod(number, F.lit(place))


def merge_runs(rows: DataFrame, least_runs: int, fan_in: int) -> DataFrame:
    """(sha, size, best, members) of rows (doc_id, rid, sha, size): every digest once."""
    fan, rounds = tree(least_runs, fan_in)
    runs = fan**rounds
    best = F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("id"), "rid", "doc_id")
    level = rows.select(F.pmod(F.xxhash64("rid"), F.lit(runs)).cast("int").alias("run"), "sha", "size", best.alias("best"), F.lit(1).cast("long").alias("members"))
    share = F.pmod(F.xxhash64("sha"), F.lit(runs)).cast("int")
    for i in range(rounds):
        low, high = fan**i, fan ** (i + 1)
        # the partner whose digit of this round is the digest's
        to = F.col("run") - (digit(F.pmod("run", F.lit(high)), low)) + digit(F.pmod(share, F.lit(high)), low)
        sent = level.withColumn("run", to.cast("int")).repartitionById(runs, F.col("run"))
        # sorted runs side by side, so equal digests are neighbours: a streaming merge, without another exchange or sort
        level = sent.sortWithinPartitions("run", "sha", "size").groupBy("run", "sha", "size").agg(F.min("best").alias("best"), F.sum("members").alias("members"))
    return level.select("sha", "size", "best", "members")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = 8) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = digests(docs, id_col, text_col)
    groups = materialize(merge_runs(rows, partitions(docs.sparkSession), fan_in), "groups")
    hot = hot_keys(groups, "sha", "members")
    out = salted(rows, "sha", hot, "rid").join(replicated(groups, "sha", hot), ["sha", "size", "salt"])
    return out.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("members").alias("group_size"),
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, all its columns."""
    found = materialize(exact_dedup(docs, id_col, text_col), "exact")
    state = found.groupBy("doc_id").agg(F.max(F.col("kept").cast("int")).alias("some"), F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("int")).alias("kept_n"))
    gone = materialize(state.where("some = 0 and doc_id is not null").select("doc_id"), "exact-gone")
    # ids on several rows, of which some stay: those rows are told apart by their text
    mixed = materialize(state.where("some = 1 and n > kept_n or doc_id is null").select("doc_id"), "exact-mixed")
    rest = drop_ids(docs, gone, id_col)
    if mixed.isEmpty():
        return rest
    key, sha, best = fresh(docs, "mixed_id", "mixed_sha", "mixed_keep")
    mixed_ids = mixed.toDF(key)
    same = col(rest, id_col).eqNullSafe(mixed_ids[key])
    clear = rest.join(mixed_ids, same, "left_anti")
    norm = F.regexp_replace(whole(col(rest, text_col)), SPACE_RUN, " ")
    kept = found.where("kept").select(F.col("doc_id").alias(best), F.col("text_sha256").alias(f"{sha}_k"))
    held = rest.join(mixed_ids, same, "left_semi").withColumn(sha, F.sha2(norm, 256))
    held = held.join(kept, held[sha].eqNullSafe(kept[f"{sha}_k"]) & col(held, id_col).eqNullSafe(kept[best]), "left_semi")
    held = held.dropDuplicates([id_col, sha]).drop(sha)
    return clear.unionByName(held)
