"""Mixing sources to target weights with hash-threshold histograms.

Every document gets a 48-bit hash of its id. The sizes are summed by source and hash bucket; the bucket in which a
source's budget runs out is cut into finer buckets, level after level, and only that bucket's documents are read again.
What lies under the final threshold is taken: a filter, no sort, and budgets are nested (a larger budget takes a superset).

Defined results: a null text has size 0 and nothing is taken from it; a null source is a source of its own, the last;
null ids share one hash. Documents whose hash equals the threshold (one, as a rule; all of them if ids repeat) share
what is left of the budget in proportion to their sizes, rounded down: the mix takes a part of those. Empty tables give
empty results. Extra columns pass through; columns named as the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, id_text, join_checked, stage, text_of

WEIGHTS = (5, 2, 1)
#: A source is repeated up to so many times.
EPOCHS = 3
LEVELS, LEVEL_BITS = 4, 12
RESULTS = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def hash48(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(id_text(doc_id).cast("binary")), 1, 12), 16, 10).cast("long")


def measured(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """docs with what the plan needs: size, and the internal columns _mix_hash and _mix_key."""
    kept = [c for c in docs.columns if c not in (*RESULTS, "_mix_hash", "_mix_key")]
    key = F.coalesce(F.concat(F.lit("s"), docs[source].cast("string")), F.lit("n"))
    return docs.select(*(docs[c] for c in kept), word_count(docs[text]).alias("size"), hash48(docs[doc_id]).alias("_mix_hash"), key.alias("_mix_key"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, share: float = 1.0) -> DataFrame:
    """One row for each source: _mix_key, source_size, target. sizes: _mix_key, size.

    Targets are min(epochs * size, level * weight); the level is where they add up to share of all sizes. It is found
    over sources in the order of epochs * size / weight: those before a position are capped, and the first position
    whose level is within its own cap is right. The windows see one row for each source, none for each document.
    """
    by_key = Window.orderBy("last", "name")
    by_ratio = Window.orderBy("ratio", "last", "name").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n = sizes.groupBy("_mix_key").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    n = n.withColumn("last", F.col("_mix_key") == "n").withColumn("name", F.substring("_mix_key", 2, 2**31 - 1))
    n = n.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_key) - 1) % len(weights) + 1).cast("long"))
    n = n.withColumn("cap", F.col("source_size") * epochs).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    n = n.withColumn("total", F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    n = n.withColumn("level", (F.col("total") * F.lit(float(share)) - F.coalesce(F.sum("cap").over(by_ratio), F.lit(0))) / (F.col("all_weight") - F.coalesce(F.sum("weight").over(by_ratio), F.lit(0))))
    n = n.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(every)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return n.select("_mix_key", "source_size", target.alias("target"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each source: its target, the whole copies of each of its documents, and the hash up to which documents get one more.

    sizes: _mix_key, _mix_hash, size, staged. Each level reads the boundary bucket of the level before alone.
    """
    quota = F.floor("target").cast("long")
    copies = F.when(F.col("source_size") > 0, F.floor(quota / F.col("source_size"))).otherwise(0).cast("long")
    bound = targets.withColumn("copies", copies).withColumn("rest", quota - F.col("copies") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")).withColumn("cell", F.col("source_size"))
    for level in range(1, LEVELS + 1):
        shift = (LEVELS - level) * LEVEL_BITS
        part = sizes.select("_mix_key", F.shiftright("_mix_hash", shift + LEVEL_BITS).alias("prefix"), F.shiftright("_mix_hash", shift).alias("bucket"), "size")
        hist = join_checked(part, bound.select("_mix_key", "prefix"), ["_mix_key", "prefix"]).groupBy("_mix_key", "bucket").agg(F.sum("size").alias("cell"))
        before = F.sum("cell").over(Window.partitionBy("_mix_key").orderBy("bucket")) - F.col("cell")
        found = hist.withColumn("before", before).join(bound.select("_mix_key", F.col("rest").alias("budget")), "_mix_key").where("before <= budget and budget < before + cell")
        bound = stage(bound.drop("prefix", "cell", "rest").join(found.select("_mix_key", F.col("bucket").alias("prefix"), "cell", (F.col("budget") - F.col("before")).alias("rest")), "_mix_key", "left"), f"mix-level{level}")
    return bound


def apply_thresholds(docs: DataFrame, bounds: DataFrame) -> DataFrame:
    """measured() documents with source_size, target and taken."""
    bounds = bounds.withColumnsRenamed({c: f"_mix_{c}" for c in ("prefix", "cell", "rest", "copies")})
    more = F.when(F.col("_mix_hash") < F.col("_mix_prefix"), F.col("size")).when(F.col("_mix_hash") == F.col("_mix_prefix"), F.floor(F.col("size") * F.col("_mix_rest").cast("decimal(38,0)") / F.col("_mix_cell")).cast("long")).otherwise(0)
    out = join_checked(docs, bounds, ["_mix_key"], "left").withColumn("taken", F.col("_mix_copies") * F.col("size") + more)
    return out.select(*(c for c in out.columns if not c.startswith("_mix_")))


def plan_mix(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, share: float = 1.0) -> DataFrame:
    targets = stage(source_targets(sizes, weights, epochs, share), "mix-targets")
    return thresholds(sizes, targets)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, share: float = 1.0, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: tuple[str, ...] | None = None) -> DataFrame:
    """All documents with size, source_size, target and taken (words that the mix takes; k whole copies and perhaps one more).

    carry: the columns to return of docs, all by default. Texts are read and counted once: what is carried is staged with the
    sizes, and the plan reads the narrow columns of that table.
    """
    ready = measured(docs, doc_id, text, source)
    ready = stage(ready if carry is None else ready.select(*carry, "size", "_mix_hash", "_mix_key"), "mix-sizes")
    return apply_thresholds(ready, plan_mix(ready.select("size", "_mix_hash", "_mix_key"), weights, epochs, share))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT AS h FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (ROW_NUMBER() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s),
r AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, ((SUM(source_size) OVER ())::DOUBLE - COALESCE(SUM(cap) OVER p, 0)::DOUBLE)
               / (SUM(weight) OVER () - COALESCE(SUM(weight) OVER p, 0))::DOUBLE AS level
      FROM r WINDOW p AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT arg_min(level, ratio) AS level FROM l WHERE level <= ratio),
t AS (SELECT l.source, source_size, LEAST(cap::DOUBLE, COALESCE(f.level * weight, cap::DOUBLE)) AS target FROM l LEFT JOIN f ON TRUE),
q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS copies FROM t),
c AS (SELECT d.doc_id, d.size, q.source_size, q.target, q.copies, floor(q.target)::BIGINT - q.copies * q.source_size AS rest,
             SUM(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto,
             SUM(size) OVER (PARTITION BY d.source, h)::BIGINT AS cell
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target,
       (copies * size + CASE WHEN upto <= rest THEN size WHEN upto - cell < rest THEN (size::HUGEINT * (rest - (upto - cell)) // cell)::BIGINT ELSE 0 END)::BIGINT AS taken
FROM c
"""


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, carry=("doc_id",)).select("doc_id", "size", "source_size", "target", "taken")
