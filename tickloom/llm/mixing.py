"""Mixing sources to target weights (problem 8)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.tokens import VOCABULARY, with_token_counts
from tickloom.session import written

#: More sources than this are refused: the plan per source is a small driver-side dimension.
MAX_SOURCES = 10_000


@dataclass(frozen=True)
class Allotment:
    source: str
    weight: float
    tokens: int  # there are
    allotted: float  # to be had

    @property
    def epochs(self) -> float:
        return self.allotted / self.tokens if self.tokens else 0.0


def water_fill(weights: dict[str, float], tokens: dict[str, int], caps: dict[str, int], total: float | None) -> list[Allotment]:
    """Capped water-filling.

    Each source is to get its weight of ``total`` tokens, but no more than ``caps`` times what
    it has. Sources at their cap are clamped and what they leave is shared among the others
    by weight, until all is feasible. Without ``total`` it is the largest with which no
    source that exists has to be clamped, so that the target shares are reached exactly (sources
    that do not exist leave theirs to the others). A total beyond all caps gives all caps.
    """
    most = {s: float(tokens.get(s, 0) * max(0, caps[s])) for s in weights}
    active = {s for s, w in weights.items() if w > 0 and most[s] > 0}
    if not active:
        return [Allotment(s, weights[s], tokens.get(s, 0), 0.0) for s in sorted(weights)]
    if total is None:
        share = sum(weights[s] for s in active)
        total = min(most[s] * share / weights[s] for s in active)
    got = dict.fromkeys(weights, 0.0)
    left = min(float(total), sum(most[s] for s in active))
    while active:
        share = sum(weights[s] for s in active)
        full = {s for s in active if left * weights[s] / share >= most[s]}
        if not full:
            for s in active:
                got[s] = left * weights[s] / share
            break
        for s in full:
            got[s] = most[s]
        left -= sum(most[s] for s in full)
        active -= full
    return [Allotment(s, weights[s], tokens.get(s, 0), got[s]) for s in sorted(weights)]


def mix(
    docs: DataFrame,
    targets: DataFrame,
    *,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    share: str = "target_share",
    repeats: str = "max_repeats",
    total_tokens: float | str | None = None,
    seed: int = 17,
    buckets: int = 4096,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """The mixture: ``(doc_id, source, n_tokens, copies)``, one row per record that is in it.

    ``total_tokens`` is the size to reach; ``"all"``: as many tokens as the listed sources hold
    once, so that small sources are clamped and the others take their rest; None: the largest
    size at which every target share is reached exactly.

    A source whose allotment (``water_fill``) is ``e`` times its tokens gives every record
    ``floor(e)`` times, and once more those that come first in a seeded random order, up to
    the tokens of the fraction. The record across the border is taken where that is the nearer
    side, so a source is off by half a record at most. No record appears more than
    ``max_repeats`` times.

    Defined cases: records with a null or unlisted source have no target and are left out, as
    are null and empty texts; repeated rows are records of their own; target rows with a null
    source, weight or cap are left out and repeated ones count once (the largest weight); with
    no targets or no documents there are no rows. Only named columns are read.

    Distribution: texts are tokenised once, where they are read, and the narrow sizes are
    written to the shared folder. The border of the fraction is found from sums per (source,
    hash bucket), and rows are put in order only within the one bucket it falls in, so no
    source, however large, is sorted or gathered as a whole.
    """
    if targets.select(source).distinct().limit(MAX_SOURCES + 1).count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    want = targets.where(f"{source} is not null and {share} is not null and {repeats} is not null").groupBy(F.col(source).alias("s")).agg(F.max(share), F.min(repeats))
    rows = [(r[0], float(r[1]), int(r[2])) for r in want.collect()]
    weights, caps = {s: w for s, w, _ in rows}, {s: c for s, _, c in rows}
    spark = docs.sparkSession

    order = F.xxhash64(F.lit(seed), F.col("_id"), F.col("_src"))
    sized = with_token_counts(docs, {"_id": doc_id, "_src": source}, text=text, path=vocabulary).where("_src is not null and n_tokens > 0")
    if rows:
        sized = sized.where(F.col("_src").isin(list(weights)))
    else:
        sized = sized.where("false")
    sized = written(sized.withColumn("_h", order).withColumn("_b", F.pmod(F.col("_h"), F.lit(buckets)).cast("int")), "sizes")
    sums = sized.groupBy("_src", "_b").agg(F.sum("n_tokens").alias("_n"))
    tokens = {r[0]: int(r[1]) for r in sums.groupBy("_src").agg(F.sum("_n")).collect()}  # one row a listed source
    total = float(sum(tokens.values())) if total_tokens == "all" else total_tokens
    plan = water_fill(weights, tokens, caps, total)
    small = [(a.source, int(a.epochs + 1e-9), max(0.0, a.allotted - int(a.epochs + 1e-9) * a.tokens)) for a in plan if a.allotted > 0]
    lots = spark.createDataFrame(small, "_src string, _whole int, _extra double")

    before = W.partitionBy("_src").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    cut = sums.withColumn("_lead", F.coalesce(F.sum("_n").over(before), F.lit(0))).join(lots, "_src")
    placed = sized.join(cut, ["_src", "_b"])
    inner = F.coalesce(F.sum("n_tokens").over(W.partitionBy("_src", "_b").orderBy("_h", "_id", "n_tokens").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    border = (F.col("_lead") < F.col("_extra")) & (F.col("_lead") + F.col("_n") > F.col("_extra"))
    whole = placed.where(~border).withColumn("_more", (F.col("_lead") + F.col("_n") <= F.col("_extra")).cast("int"))
    part = placed.where(border).withColumn("_at", F.col("_lead") + inner)
    part = part.withColumn("_more", (F.col("_at") + F.col("n_tokens") / 2 <= F.col("_extra")).cast("int")).drop("_at")
    return (
        whole.unionByName(part)
        .withColumn("copies", F.col("_whole") + F.col("_more"))
        .where("copies > 0")
        .select(F.col("_id").alias(doc_id), F.col("_src").alias(source), "n_tokens", "copies")
    )


def shares(mixture: DataFrame, targets: DataFrame, *, source: str = "source", share: str = "target_share", repeats: str = "max_repeats") -> DataFrame:
    """Per source of the targets: records, tokens with copies, most copies, target share and the share reached."""
    got = mixture.groupBy(source).agg(
        F.count("*").alias("records"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies")
    )
    out = targets.select(source, share, repeats).join(got, source, "left")
    total = F.sum(F.coalesce("tokens", F.lit(0))).over(W.partitionBy())
    return out.select(
        source,
        share,
        repeats,
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("records", "tokens", "most_copies")],
        F.coalesce(F.col("tokens") / F.when(total > 0, total), F.lit(0.0)).alias("reached_share"),
    )
