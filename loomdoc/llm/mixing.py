"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words: its weight's share of ``budget`` times all
words, but at most ``repeat_cap`` times the source's own words; what the cap
cuts off goes to the other sources by weight until no target is above its cap.
The whole part of target / source words is given to each document as certain
copies. The rest is a sample of documents in Pareto order: a document's rank is
its random odds u/(1-u) divided by its inclusion odds p/(1-p), and documents
get one more copy in that order until the words left for the source are used
up. u comes from a hash of seed and id, so reruns agree.

Within a source p is proportional to a document's measure, so inclusion is
unequal: ``importance`` names a numeric column for it; without one it is the whole
part of the square root of the text's bytes, 1 at least. The scale is such that
the sample's expected words are those left; a p beyond 1 is all but certain.

The order is never sorted in one task. Ranks fall into bins; words are summed by
(source, bin), the bin in which a source's target is met is found from those
sums, it is cut into as many bins again, and only the rows of one of those are
ordered. What remains is one cut per source, by which each row is decided where
it stands.

Defined cases: a null text has no words; a null source is a source of its own,
after all others; a null id's u comes from the text; rows of a source that share
id and measure are taken alike; a source without words gets target 0; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, WORD, col, fresh, materialize, whole

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
REPEAT_CAP = 2
SEED = 17


def uniform(id_: Column, text: Column, seed: int) -> Column:
    """In (0, 1), from the first 52 bits of MD5 of "seed:id"; without an id, of "seed:" and the text's own MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.md5(whole(text)))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def measure(docs: DataFrame, text_col: str, importance: str | None) -> Column:
    """What a document's inclusion is proportional to."""
    if importance:
        return F.coalesce(col(docs, importance).cast("double"), F.lit(1.0))
    return F.greatest(F.floor(F.sqrt(F.octet_length(whole(col(docs, text_col))))).cast("double"), F.lit(1.0))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, cap: int) -> DataFrame:
    """One row per source: k, source, source_size, target, copies, part (what a further copy is to be given to), mean_importance."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), (F.sum(F.col("size") * F.col("importance")) / F.sum("size")).alias("mean_importance"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by = by.withColumn("k", F.row_number().over(order) - 1)
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("k", F.lit(len(weights))) + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("cap") / F.col("weight"))
    # by ratio of cap to weight the capped sources come first; each row sees what is left if it and all later ones aren't capped
    up = Window.orderBy("ratio", "k").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("ratio", "k").rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("level", (F.lit(budget) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / F.sum("weight").over(rest))
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "k", "level"))).over(everything)
    by = by.withColumn("stop", first)
    open_ = F.col("stop").isNotNull() & (F.struct("ratio", "k") >= F.struct("stop.ratio", "stop.k"))
    by = by.withColumn("target", F.when(open_, F.least(F.col("cap"), F.col("stop.level") * F.col("weight"))).otherwise(F.col("cap")))
    by = by.withColumn("copies", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(F.lit(0)).cast("int"))
    by = by.withColumn("left_words", F.col("target") - F.col("copies") * F.col("source_size"))
    by = by.withColumn("part", F.when(F.col("source_size") > 0, F.col("left_words") / F.col("source_size")).otherwise(F.lit(0.0)))
    return by.select("k", "source", "source_size", "target", "copies", "left_words", "part", F.coalesce("mean_importance", F.lit(1.0)).alias("mean_importance"))


def rank(u: Column, part: Column, importance: Column, mean: Column) -> Column:
    """r / (1 + r) of the Pareto rank r: as ordered as r, within (0, 1)."""
    p = F.greatest(F.least(part * importance / mean, F.lit(1.0 - 1e-12)), F.lit(1e-12))
    r = (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p))
    return r / (F.lit(1.0) + r)


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, cap: int = REPEAT_CAP, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", importance: str | None = None, bins: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(one small row per document, one row per source with its cut)."""
    id_, text = col(docs, id_col).cast("long"), col(docs, text_col)
    sizes = docs.select(id_.alias("doc_id"), col(docs, source_col).cast("string").alias("source"), words(text).alias("size"), measure(docs, text_col, importance).alias("importance"), uniform(id_, text, seed).alias("u"))
    sizes = materialize(sizes, "mix-sizes")
    targets = materialize(source_targets(sizes, weights, budget, cap).coalesce(1), "mix-targets")
    ranked = joined(sizes, targets).withColumn("rank", rank(F.col("u"), F.col("part"), F.col("importance"), F.col("mean_importance")))
    inside = ranked.withColumn("before", F.lit(0).cast("long")).withColumn("place", F.col("rank"))
    for _ in range(2):
        inside = inside.withColumn("place", F.col("place") * bins).withColumn("bin", F.least(F.floor("place"), F.lit(bins - 1)).cast("int")).withColumn("place", F.col("place") - F.col("bin"))
        sums = inside.groupBy("k", "bin").agg(F.sum("size").alias("words"), F.first("left_words").alias("left_words"), F.first("before").alias("before"), F.min("rank").alias("low"))
        so_far = F.col("before") + F.coalesce(F.sum("words").over(Window.partitionBy("k").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # the last bin that begins before the target is met: all of earlier bins is taken, nothing of later ones
        edge = sums.withColumn("before", so_far).where("before < left_words").groupBy("k").agg(F.max(F.struct("bin", "before", "low")).alias("edge"))
        edge = materialize(edge.select("k", "edge.*").coalesce(1), "mix-edges")
        inside = inside.drop("before").join(edge.drop("low"), ["k", "bin"])
    # rows that are taken alike are one step
    alike = inside.groupBy("k", "rank", F.coalesce("doc_id", F.lit(LAST_ID)).alias("id")).agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("left_words").alias("left_words"))
    order = Window.partitionBy("k").orderBy("rank", "id")
    alike = alike.withColumn("upto", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = alike.where(F.col("upto") - F.col("size") / 2 < F.col("left_words")).groupBy("k").agg(F.max(F.struct("rank", "id")).alias("last"))
    # a source whose edge bin gives nothing still takes all earlier bins
    cuts = edge.join(last, "k", "left").select("k", F.coalesce(F.col("last.rank"), F.col("low")).alias("cut_rank"), F.coalesce(F.col("last.id"), F.lit(-LAST_ID - 1)).alias("cut_id"))
    cuts = materialize(targets.join(cuts, "k", "left").select(*targets.columns, F.coalesce("cut_rank", F.lit(-1.0)).alias("cut_rank"), F.coalesce("cut_id", F.lit(-LAST_ID - 1)).alias("cut_id")).coalesce(1), "mix-cuts")
    return sizes, cuts


def joined(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """rows with their source's columns. by_source is one materialized row per source: broadcast if that is small enough."""
    key = "source of the targets"
    other = by_source.withColumnRenamed("source", key)
    return rows.join(other, rows["source"].eqNullSafe(other[key])).drop(key)


def copies_of(u: Column, importance: Column, id_: Column) -> Column:
    """How many times the mix has a row, from the columns of its source."""
    r = rank(u, F.col("part"), importance, F.col("mean_importance"))
    extra = F.struct(r.alias("rank"), F.coalesce(id_, F.lit(LAST_ID)).alias("id")) <= F.struct(F.col("cut_rank").alias("rank"), F.col("cut_id").alias("id"))
    return F.col("copies") + extra.cast("int")


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, n_copies."""
    sizes, cuts = plan(docs, **options)
    out = joined(sizes, cuts).withColumn("n_copies", copies_of(F.col("u"), F.col("importance"), F.col("doc_id")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"), "source", "n_copies")


def mixed_documents(docs: DataFrame, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", importance: str | None = None, **options) -> DataFrame:
    """The mix itself: each row of docs as many times as the mix has it, all its columns. Texts aren't shuffled: a row is decided by its source's cut."""
    _, cuts = plan(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, importance=importance, **options)
    key, times, one = fresh(docs, "mix_source", "mix_times", "mix_one")
    names = {c: f"{key}_{c}" for c in cuts.columns}
    side = cuts.toDF(*names.values())
    rows = docs.join(side, col(docs, source_col).cast("string").eqNullSafe(side[names["source"]]))
    id_ = col(docs, id_col).cast("long")
    r = rank(uniform(id_, col(docs, text_col), seed), side[names["part"]], measure(docs, text_col, importance), side[names["mean_importance"]])
    extra = F.struct(r.alias("rank"), F.coalesce(id_, F.lit(LAST_ID)).alias("id")) <= F.struct(side[names["cut_rank"]].alias("rank"), side[names["cut_id"]].alias("id"))
    rows = rows.withColumn(times, side[names["copies"]] + extra.cast("int")).where(F.col(times) > 0)
    rows = rows.withColumn(one, F.explode(F.sequence(F.lit(1), F.col(times))))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, greatest(floor(sqrt(strlen(coalesce(text, '')))), 1)::DOUBLE AS measure,
         (('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size * measure) / sum(size) AS mean_measure, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS k FROM d GROUP BY source),
w AS (
  SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[k % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap, (source_size * 2.0::DOUBLE) / ([3.0, 1.0, 2.0]::DOUBLE[])[k % 3 + 1] AS ratio FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT ratio AS f_ratio, k AS f_k, level AS f_level FROM l WHERE level <= ratio ORDER BY ratio, k LIMIT 1),
t AS (
  SELECT l.*, CASE WHEN (ratio, k) >= (f_ratio, f_k) THEN least(cap, f_level * weight) ELSE cap END AS target FROM l LEFT JOIN f ON true),
c AS (
  SELECT *, least(floor(target / source_size), 2)::BIGINT AS copies, target - least(floor(target / source_size), 2) * source_size AS left_words FROM t),
p AS (
  SELECT d.doc_id, d.size, c.source_size, c.target, c.copies, c.left_words, c.k, d.u,
         greatest(least(c.left_words / c.source_size * d.measure / c.mean_measure, (1.0 - 1e-12)::DOUBLE), 1e-12::DOUBLE) AS p FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source),
r AS (
  SELECT *, (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)) AS odds FROM p),
o AS (
  SELECT *, odds / (1.0::DOUBLE + odds) AS rank FROM r)
SELECT doc_id, size, source_size, target,
       size * (copies + CASE WHEN sum(size) OVER (PARTITION BY k ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE < left_words THEN 1 ELSE 0 END)::BIGINT AS taken
FROM o"""
