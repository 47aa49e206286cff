"""Row numbers and running totals that don't bring all rows to one task."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.sources.shared import written

#: Slots in a segment of a running total.
SEGMENT = 4096


def with_sequence(df: DataFrame, *order: Column | str, name: str = "seq") -> DataFrame:
    """df with its 0-based position in the order (which must be total).

    Rows are range-partitioned and sorted; a row's position is that in its partition plus the sizes of those before: one number for
    each partition, which the driver adds up. The numbered rows are written once, so that positions stay what they are whatever is
    recomputed."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    local = F.monotonically_increasing_id()
    numbered = written(ranges.withColumn("_part", F.spark_partition_id()).withColumn("_at", local.bitwiseAND(F.lit((1 << 33) - 1))), "sequence")
    sizes = {r["_part"]: r["count"] for r in numbered.groupBy("_part").count().collect()}
    before = [0, *accumulate(sizes.get(p, 0) for p in range(max(sizes, default=0)))]
    return numbered.select(*df.columns, (F.get(F.array(*(F.lit(n).cast("long") for n in before)), F.col("_part")) + F.col("_at")).alias(name))


def dealt(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """df by hash of key over as many partitions as shuffles have, however few bytes they hold: for rows that expand."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def before_slot(df: DataFrame, keys: list[str], slot: str, values: list[str], slots: int | None = None, segment: int = SEGMENT) -> DataFrame:
    """df (a row for each of keys and slot) with each value replaced by its sum over the smaller slots of the same keys.

    With more slots than a segment, sums within segments and sums of the segments before are taken apart, so that a key with very
    many slots is shared out over tasks."""
    own = Window.partitionBy(*keys).orderBy(slot).rangeBetween(Window.unboundedPreceding, -1)
    total = lambda w: {v: F.coalesce(F.sum(v).over(w), F.lit(0)).cast("long") for v in values}
    if slots is not None and slots <= segment:
        return df.withColumns(total(own))
    cut = df.withColumn("_seg", F.floor(F.col(slot) / segment))
    inner = cut.withColumns(total(Window.partitionBy(*keys, "_seg").orderBy(slot).rangeBetween(Window.unboundedPreceding, -1)))
    sums = cut.groupBy(*keys, "_seg").agg(*(F.sum(v).alias(f"_{v}") for v in values))
    ahead = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "_seg", *(F.coalesce(F.sum(f"_{v}").over(ahead), F.lit(0)).cast("long").alias(f"_{v}") for v in values))
    both = inner.join(sums, [*keys, "_seg"])
    return both.withColumns({v: F.col(v) + F.col(f"_{v}") for v in values}).drop("_seg", *(f"_{v}" for v in values))


def ranked_running(df: DataFrame, keys: list[str], score: str, row_id: str, values: list[str], span: int = 1 << 16) -> DataFrame:
    """df with rn and running sums `cum_<value>` over (score descending, row_id) in each of keys, own row included.

    Three levels of prefix sums: scores, spans of ids that tie on a score, rows. Scores are rounded by the caller, so there are
    boundedly many; ties are shared out by spans of ids. No task holds all rows of a key. row_id must be an integer."""
    cut = df.withColumn("_span", F.floor(F.col(row_id) / span)).withColumn("_one", F.lit(1).cast("long"))
    every = ["_one", *values]
    inner = Window.partitionBy(*keys, score, "_span").orderBy(row_id).rowsBetween(Window.unboundedPreceding, 0)
    rows = cut.withColumns({f"_r_{v}": F.sum(v).over(inner) for v in every})
    spans = cut.groupBy(*keys, score, "_span").agg(*(F.sum(v).alias(f"_s_{v}") for v in every))
    scores = spans.groupBy(*keys, score).agg(*(F.sum(f"_s_{v}").alias(f"_t_{v}") for v in every))
    over_spans = Window.partitionBy(*keys, score).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    over_scores = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*keys, score, "_span", *(F.coalesce(F.sum(f"_s_{v}").over(over_spans), F.lit(0)).alias(f"_s_{v}") for v in every))
    scores = scores.select(*keys, score, *(F.coalesce(F.sum(f"_t_{v}").over(over_scores), F.lit(0)).alias(f"_t_{v}") for v in every))
    out = rows.join(spans, [*keys, score, "_span"]).join(scores, [*keys, score])
    sums = {v: (F.col(f"_r_{v}") + F.col(f"_s_{v}") + F.col(f"_t_{v}")).cast("long") for v in every}
    return out.select(*df.columns, sums["_one"].alias("rn"), *(sums[v].alias(f"cum_{v}") for v in values))
