"""Descriptions, scores, sensitivity, drift and verdicts, all as plain aggregations."""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.operators.chunks import with_running

EPS = float(np.finfo(np.float64).eps)
THRESHOLDS = (0.3, 0.4, 0.5)


def cumulated(rows: DataFrame, by: list[str], value: str, weight: Column | None = None) -> DataFrame:
    """Each distinct value of a group once: ``_w`` (its rows or weight), ``_c`` (up to and with it), ``_t`` (of the group).

    Values collapse before they are shuffled and are put in order within 64 ranges of the group's
    span only; the ranges' totals, a row each, carry over. No group is ordered in one task.
    """
    per = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"), (F.count("*") if weight is None else F.sum(weight)).alias("_w"))
    span = per.groupBy(*by).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.sum("_w").alias("_t"))
    place = (F.col(value) - F.col("_lo")).cast("double") / (F.col("_hi") - F.col("_lo")).cast("double")
    per = per.join(span, by).withColumn("_k", F.when(F.col("_hi") > F.col("_lo"), F.floor(place * 65_535)).otherwise(0))
    return with_running(per, by, ["_k", value], F.col("_w"), "_c", 1024).drop("_k", "_lo", "_hi")


def step_quantile(value: str, share: float) -> Column:
    """Of ``cumulated`` rows: the first value at which the running weight reaches its share."""
    return F.min(F.when(F.col("_c") >= F.col("_t") * share, F.col(value)))


def linear_quantile(value: str, share: float) -> Column:
    """Of ``cumulated`` counts: the percentile between the two rows around its place."""
    at = (F.max("_t") - 1) * share
    row = lambda k: F.min(F.when(F.col("_c") > F.least(F.floor((F.col("_t") - 1) * share) + k, F.col("_t") - 1), F.col(value)))
    return row(0) + (row(1) - row(0)) * (at - F.floor(at))


def describe(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, population deviation, extremes and exact linear percentiles."""
    use = rows.where(F.col(value).isNotNull())
    whole = use.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"))
    marks = cumulated(use, by, value).groupBy(*by).agg(*[linear_quantile(value, p).alias(f"q{int(p * 100):02d}") for p in (0.05, 0.5, 0.95)])
    return whole.join(marks, by)


def tertiles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Cutpoints by the inverted CDF (values that occur), a third and two thirds."""
    return cumulated(rows, by, value).groupBy(*by).agg(step_quantile(value, 0.3333333333333333).alias("cut1"), step_quantile(value, 0.6666666666666666).alias("cut2"))


def banded(rows: DataFrame, cuts: DataFrame, by: list[str], value: str) -> DataFrame:
    band = F.when(F.col(value) <= F.col("cut1"), "low").when(F.col(value) <= F.col("cut2"), "mid").otherwise("high")
    return rows.join(cuts, by).withColumn("band", band).drop("cut1", "cut2")


def clipped_loss(y: Column, p: Column) -> Column:
    """Log loss of a probability clipped to the float's resolution; null where either is unknown."""
    c = F.when(p.isNotNull(), F.least(F.greatest(p, F.lit(EPS)), F.lit(1 - EPS)))  # least and greatest skip nulls
    return -(y * F.ln(c) + (1 - y) * F.log1p(-c))


def scores(rows: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Log loss, Brier score, average precision and ROC area per group, over distinct scores only.

    Rows collapse to (group, score) before anything is ordered: ties share one step in the
    precision-recall curve and count half in the area.
    """
    if not by:
        raise ValueError("name at least one grouping column")
    yc, pc = F.col(y).cast("double"), F.col(p)
    per = rows.groupBy(*by, pc.alias("_p")).agg(
        F.count("*").alias("_n"), F.sum(yc).alias("_t"), F.sum(clipped_loss(yc, pc)).alias("_ll"), F.sum((pc - yc) * (pc - yc)).alias("_br")
    )
    # Scores from the highest down, in 65,536 bands: a group's scores are not ordered in one task.
    per = per.withColumn("_k", -F.floor(F.col("_p") * 65_536)).withColumn("_down", -F.col("_p"))
    per = with_running(per, by, ["_k", "_down"], [F.col("_t"), F.col("_n")], ["_ct", "_cn"], 1024)
    whole = per.groupBy(*by).agg(F.sum("_t").alias("_pos"), F.sum("_n").alias("_all"))
    per = per.join(whole, by)
    neg = F.col("_n") - F.col("_t")
    above = F.col("_ct") - F.col("_t")
    return per.groupBy(*by).agg(
        F.sum("_n").alias("rows"),
        F.sum("_t").cast("bigint").alias("positives"),
        (F.sum("_ll") / F.sum("_n")).alias("log_loss"),
        (F.sum("_br") / F.sum("_n")).alias("brier"),
        F.sum(F.when(F.col("_pos") > 0, F.col("_t") / F.col("_pos") * F.col("_ct") / F.col("_cn"))).alias("average_precision"),
        F.sum(F.when((F.col("_pos") > 0) & (F.col("_pos") < F.col("_all")), neg * (above + F.col("_t") / 2) / (F.col("_pos") * (F.col("_all") - F.col("_pos"))))).alias("roc_auc"),
    )


def threshold_grid(rows: DataFrame, by: list[str], thresholds: tuple[float, ...] = THRESHOLDS, y: str = "y", p: str = "p") -> DataFrame:
    """Decisions at each threshold in one pass: confusion, precision, recall, F1 (null where undefined)."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    x = rows.select(*by, F.col(y).alias("_y"), F.col(p).alias("_p"), t)
    acc = F.col("_p") >= F.col("threshold")
    c = lambda a, b: F.count_if(a & (F.col("_y") == b))
    g = x.groupBy(*by, "threshold").agg(c(acc, 1).alias("tp"), c(acc, 0).alias("fp"), c(~acc, 1).alias("fn"), c(~acc, 0).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return g.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def choose_threshold(grid: DataFrame, by: list[str]) -> DataFrame:
    """The threshold with the highest F1, the highest of tied ones; none without positives."""
    best = F.max(F.when(F.col("tp") + F.col("fn") > 0, F.struct("f1", "threshold"))).alias("_m")
    return grid.groupBy(*by).agg(best).select(*by, F.col("_m.threshold").alias("threshold"), F.col("_m.f1").alias("f1"))


def reliability(rows: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Fixed deciles of the score, the last one closed: rows, mean score and share of positives."""
    bin_ = F.least(F.floor(F.col(p) * 10), F.lit(9)).cast("int").alias("decile")
    return rows.groupBy(*by, bin_).agg(F.count("*").alias("rows"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("share"))


def week_sensitivity(rows: DataFrame, by: list[str], *, y: str, a: str, b: str, start: str) -> DataFrame:
    """Difference of the losses of two scores, and its range when any one week (from Monday, UTC) is left out."""
    yc = F.col(y).cast("double")
    delta = {
        "log_loss": clipped_loss(yc, F.col(a)) - clipped_loss(yc, F.col(b)),
        "brier": (F.col(a) - yc) * (F.col(a) - yc) - (F.col(b) - yc) * (F.col(b) - yc),
    }
    week = F.floor((F.col(start) + 3 * 86_400) / (7 * 86_400)).alias("_w")
    per = rows.groupBy(*by, week).agg(F.count("*").alias("_n"), *[F.sum(d).alias(k) for k, d in delta.items()])
    whole = W.partitionBy(*by)
    per = per.withColumn("_all", F.sum("_n").over(whole))
    per = per.withColumns({f"_s_{k}": F.sum(k).over(whole) for k in delta})
    rest = F.col("_all") - F.col("_n")
    aggs = [F.count("*").alias("weeks")]
    for k in delta:
        without = F.when(rest > 0, (F.col(f"_s_{k}") - F.col(k)) / rest)
        aggs += [(F.sum(k) / F.sum("_n")).alias(f"{k}_delta"), F.min(without).alias(f"{k}_min"), F.max(without).alias(f"{k}_max")]
    return per.groupBy(*by).agg(*aggs)


def weighted_summary(rows: DataFrame, by: list[str], value: str, weight: str, qs: tuple[float, ...] = (0.05, 0.5, 0.95)) -> DataFrame:
    """Weighted mean, deviation and step quantiles: the first value at which the running weight reaches its share."""
    per = cumulated(rows.where(f"{value} is not null and {weight} > 0"), by, value, F.col(weight))
    v, w = F.col(value), F.col("_w")
    mean = per.groupBy(*by).agg((F.sum(v * w) / F.sum(w)).alias("_m"))
    off = v - F.col("_m")  # centred before it is squared
    return per.join(mean, by).groupBy(*by).agg(
        F.sum("_n").alias("n"), F.sum("_w").alias("weight"), F.max("_m").alias("mean"), F.sqrt(F.sum(off * off * w) / F.sum(w)).alias("std"),
        *[step_quantile(value, q).alias(f"q{int(q * 100):02d}") for q in qs],
    )


def drift(rows: DataFrame, reference: Column, columns: list[str], by: list[str]) -> DataFrame:
    """Each group's columns against the reference rows: shift of the mean in reference deviations, ratio of
    deviations, share outside the reference's 5 to 95 per cent; null where the reference does not vary."""
    long = rows.withColumn("_ref", F.coalesce(reference, F.lit(False))).unpivot([*by, "_ref"], columns, "feature", "value").where("value is not null")
    known = long.where("_ref")
    ref = known.groupBy("feature").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s"))
    ref = ref.join(cumulated(known, ["feature"], "value").groupBy("feature").agg(linear_quantile("value", 0.05).alias("a"), linear_quantile("value", 0.95).alias("z")), "feature")
    out = long.where("not _ref").join(ref, "feature").groupBy("feature", *by).agg(
        F.count("*").alias("n"), F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"),
        F.avg(((F.col("value") < F.col("a")) | (F.col("value") > F.col("z"))).cast("double")).alias("outside"), F.first("m").alias("m"), F.first("s").alias("s"),
    )
    ok = F.col("s") > 0
    return out.select("feature", *by, "n", F.when(ok, (F.col("_m") - F.col("m")) / F.col("s")).alias("shift"), F.when(ok, F.col("_s") / F.col("s")).alias("ratio"), "outside")


def tri_all(x: Column) -> Column:
    """Three-valued ALL: false beats unknown, unknown beats true; plain ``bool_and`` skips nulls."""
    return F.when(F.coalesce(F.bool_or(~x), F.lit(False)), F.lit(False)).when(F.count_if(x.isNull()) > 0, F.lit(None).cast("boolean")).otherwise(F.lit(True))


def correlations(rows: DataFrame, by: list[str], columns: list[str], against: str) -> DataFrame:
    """Pearson correlation of each column with another, null where either does not vary."""
    long = rows.unpivot([*by, against], columns, "feature", "value").where(F.col("value").isNotNull() & F.col(against).isNotNull())
    g = long.groupBy(*by, "feature").agg(F.corr("value", against).alias("r"), F.stddev_pop("value").alias("_a"), F.stddev_pop(against).alias("_b"), F.count("*").alias("n"))
    return g.select(*by, "feature", "n", F.when((F.col("_a") > 0) & (F.col("_b") > 0), F.col("r")).alias("r"))


def adf_statistic(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Unit-root statistic with one lag and a constant: the t value of the lagged level, from sums.

    Least squares of the difference on (1, level before, difference before); the normal
    equations are nine sums per group, solved in closed form.
    """
    w = W.partitionBy(*by).orderBy(*order)
    x = rows.withColumn("_l", F.lag(value).over(w)).withColumn("_ll", F.lag(value, 2).over(w))
    x = x.select(*by, (F.col(value) - F.col("_l")).alias("d"), F.col("_l").alias("l"), (F.col("_l") - F.col("_ll")).alias("p")).where("d is not null and p is not null")
    m = x.groupBy(*by).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "dlp"])
    c = x.join(m, by) if by else x.crossJoin(m)
    cov = {a + b: F.sum((F.col(a) - F.col(f"m{a}")) * (F.col(b) - F.col(f"m{b}"))) for a, b in ("ll", "pp", "lp", "dl", "dp", "dd")}
    s = c.groupBy(*by, "n").agg(*[e.alias(f"s{k}") for k, e in cov.items()])
    det = F.col("sll") * F.col("spp") - F.col("slp") * F.col("slp")
    beta = (F.col("sdl") * F.col("spp") - F.col("sdp") * F.col("slp")) / det
    gamma = (F.col("sdp") * F.col("sll") - F.col("sdl") * F.col("slp")) / det
    rss = F.col("sdd") - beta * F.col("sdl") - gamma * F.col("sdp")
    se = F.sqrt(rss / (F.col("n") - 3) * F.col("spp") / det)
    return s.where("n > 3").where(det > 0).select(*by, "n", (beta / se).alias("t"))


def softplus(x: Column) -> Column:
    """ln(1 + e^x) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(x, F.lit(-709.0)), F.lit(709.0))))


def removal(rows: DataFrame, by: list[str], y: str, logit: str, families: list[str]) -> DataFrame:
    """Change of the losses when a family's contribution is taken out of a linear score."""
    base = lambda z: softplus(z) - F.col(y) * z
    long = rows.unpivot([*by, y, logit], families, "family", "part")
    z0, z1 = F.col(logit), F.col(logit) - F.col("part")
    br = lambda z: (logistic(z) - F.col(y)) * (logistic(z) - F.col(y))
    return long.groupBy(*by, "family").agg(F.avg(base(z1) - base(z0)).alias("log_loss_delta"), F.avg(br(z1) - br(z0)).alias("brier_delta"))


