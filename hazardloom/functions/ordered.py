"""Exact global order, running sums and quantiles without pulling rows into one task.

Rows are range partitioned by the order and checkpointed, so partition number and position are
facts of stored data. Only one row per partition goes through a single-task window, and only
that small table, as long as the number of partitions, is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardloom.session import materialise

_LOW_BITS = (1 << 33) - 1


def _placed(df: DataFrame, order: list[Column]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fixed = materialise(df.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    spot = fixed.withColumn("_spot", F.monotonically_increasing_id())
    return spot.withColumns({"_part": F.shiftright("_spot", 33), "_index": F.col("_spot").bitwiseAND(_LOW_BITS)})


def _starts(placed: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Per partition, the sums over all partitions before it."""
    per_part = placed.groupBy("_part").agg(*[v.alias("_t_" + k) for k, v in totals.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        "_part", *[F.coalesce(F.sum("_t_" + k).over(before), F.lit(0)).alias("_b_" + k) for k in totals]
    )


def with_row_number(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Adds the 1-based global position; the order must be total for a repeatable result."""
    placed = _placed(df, order)
    starts = _starts(placed, {"n": F.count(F.lit(1))})
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_b_n") + F.col("_index") + 1)
        .drop("_spot", "_part", "_index", "_b_n")
    )


def with_running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Adds, per entry name -> column, the inclusive running sum in the global order."""
    placed = _placed(df, order)
    starts = _starts(placed, {k: F.sum(c) for k, c in sums.items()})
    so_far = Window.partitionBy("_part").orderBy("_index").rowsBetween(Window.unboundedPreceding, 0)
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumns({k: F.col("_b_" + k) + F.sum(c).over(so_far) for k, c in sums.items()})
        .drop("_spot", "_part", "_index", *["_b_" + k for k in sums])
    )


HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of rows to their one group row, where a group may hold any share of the rows.

    Groups with more than a thousandth of all rows are fewer than a thousand, so they are
    broadcast and their rows never meet in one task; the other groups use the shuffle join."""
    total = groups.agg(F.sum(size)).scalar()
    hot = F.broadcast(groups.where(F.col(size) * HOT_SHARE > total))
    cold = rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col(size) * HOT_SHARE <= total), key)
    return rows.join(hot, key).unionByName(cold)


def exact_quantiles(df: DataFrame, groups: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group from the histogram of distinct values."""
    keyed = df.where(F.col(value).isNotNull())
    if not groups:
        keyed = keyed.withColumn("_all", F.lit(0))
    by = groups or ["_all"]
    histogram = keyed.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    running = with_running_sums(histogram, [F.col(c) for c in (*by, value)], {"_cum": "_n"})
    totals = running.groupBy(*by).agg(F.sum("_n").alias("_total"), F.min(F.col("_cum") - F.col("_n")).alias("_start"))
    joined = running.join(totals, by)
    picks = []
    for name, q in points.items():
        spot = (F.col("_total") - 1) * F.lit(float(q))
        for side, rank in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            at = F.col("_start") + rank
            inside = (F.col("_cum") - F.col("_n") <= at) & (at < F.col("_cum"))
            picks.append(F.max(F.when(inside, F.col(value).cast("double"))).alias(f"_{side}_{name}"))
    found = joined.groupBy(*by).agg(F.first("_total").alias("_total"), *picks)
    columns = []
    for name, q in points.items():
        spot = (F.col("_total") - 1) * F.lit(float(q))
        part = spot - F.floor(spot)
        columns.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * part).alias(name))
    return found.select(*groups, *columns)


def keep_first(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows per key. The rank filter lets Spark cut each group to n rows in every
    input partition before the shuffle, so a hot key costs no more than any other."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
