"""Purged temporal partitions, support and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.functions.time import DAY_S, big, floor_div

#: Observed bars of history that features need, in seconds of M1 bars.
BUFFER_S = 241 * 60


def purged(start: Column, info_end: Column, boundary: Column, stop: Column, buffer: Column | int = BUFFER_S) -> Column:
    """``train``, ``test`` or null: training rows begin and are known before the boundary less the
    buffer, test rows begin from it on and are known before ``stop``; what straddles is in neither."""
    b = buffer if isinstance(buffer, Column) else F.lit(buffer)
    return F.when((start < boundary) & (info_end < boundary - b), "train").when((start >= boundary) & (start < stop) & (info_end < stop), "test")


def fold_table(spark: SparkSession, folds: list[tuple[int, str, int, int]]) -> DataFrame:
    """A small table ``(fold, part, boundary, stop)`` in epoch seconds; a literal relation."""
    return spark.createDataFrame(folds, "fold int, part string, boundary bigint, stop bigint")


def partitioned(rows: DataFrame, folds: list[tuple[int, str, int, int]], start: str, info_end: str, buffer: int = BUFFER_S) -> DataFrame:
    """Each row once for every (fold, part) it belongs to: the folds are an array literal, so there is no join."""
    lit = F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(p).alias("part"), F.lit(b).cast("bigint").alias("boundary"), F.lit(s).cast("bigint").alias("stop")) for f, p, b, s in folds])
    x = rows.withColumn("_f", F.explode(lit))
    side = purged(F.col(start), F.col(info_end), F.col("_f.boundary"), F.col("_f.stop"), buffer)
    return x.select(*rows.columns, F.col("_f.fold").alias("fold"), F.concat_ws("_", F.col("_f.part"), side).alias("partition"), side.alias("role")).where("role is not null")


def observed_boundary(bars: DataFrame, boundary: int, count: int = 241) -> DataFrame:
    """Per feed the start of the ``count``-th observed bar before the boundary: a buffer in bars, not in time."""
    before = bars.where(F.col("b") < boundary)
    day = floor_div(F.col("b"), big(DAY_S))
    per_day = before.groupBy("feed_id", day.alias("day")).agg(F.count("*").alias("n"))
    later = W.partitionBy("feed_id").orderBy(F.desc("day")).rowsBetween(W.unboundedPreceding, -1)
    hit = per_day.withColumn("_after", F.coalesce(F.sum("n").over(later), big(0))).where((F.col("_after") < count) & (F.col("_after") + F.col("n") >= count))
    rank = F.row_number().over(W.partitionBy("feed_id", "day").orderBy(F.desc("b")))
    inside = before.withColumn("day", day).join(hit, ["feed_id", "day"]).withColumn("_r", rank)
    return inside.where(F.col("_r") == count - F.col("_after")).select("feed_id", F.col("b").alias("buffer_from"))


def class_support(rows: DataFrame, by: list[str], y: str = "y") -> DataFrame:
    """Rows, positives, negatives and unknowns of each group and why it can't be trained on."""
    g = rows.groupBy(*by).agg(
        F.count("*").alias("rows"), F.count_if(F.col(y) == 1).alias("positives"), F.count_if(F.col(y) == 0).alias("negatives"),
        F.count_if(F.col(y).isNull() | ~F.col(y).isin(0, 1)).alias("unknown"),
    )
    why = F.when(F.col("positives") + F.col("negatives") == 0, "empty").when(F.col("positives") == 0, "no_positives").when(F.col("negatives") == 0, "no_negatives")
    return g.withColumn("reason", why)


def admission(rows: DataFrame, reasons: list[tuple[str, Column]]) -> Column:
    """First reason in precedence that keeps a row from training, or ``admitted``."""
    out = None
    for name, cond in reasons:
        c = F.coalesce(cond, F.lit(False))
        out = F.when(c, name) if out is None else out.when(c, name)
    return out.otherwise("admitted")
