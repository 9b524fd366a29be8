"""Queries of the problems 4, 7, 8 and 9, and the SQL they are checked with where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickloom.llm.mixing import mix, shares
from tickloom.llm.nearest import nearest_in_time
from tickloom.llm.packing import fill_report, pack
from tickloom.llm.residue import find_residue
from tickloom.llm.tokens import with_token_counts
from tickloom.session import table

#: The matrix's mark of a missing time (fixed value).
MISSING_MS = -9223372036854775808


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "economic_matrix")
    time = F.when(F.col("entry_ms").isNull() | (F.col("entry_ms") == MISSING_MS), F.col("decision_ms")).otherwise(F.col("entry_ms"))
    rows = m.select("row_id", "feed_id", time.alias("at_ms"))
    quotes = table(spark, d, "quotes").where("is_valid").select("quote_id", "feed_id", "source_time")
    return nearest_in_time(
        rows, quotes, left_id="row_id", right_id="quote_id", entity="feed_id", left_time="at_ms", right_time="source_time", tolerance=30_000
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).where("quote_id is not null").select("row_id", "quote_id")


def p4_nearest(spark: SparkSession, d: str) -> DataFrame:
    """All rows of the matrix, those without a quote too."""
    return _nearest(spark, d).withColumnRenamed("gap", "gap_ms")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents"), table(spark, d, "containers"))


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(_packed(spark, d))


def p7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Per kind: texts placed, containers over their capacity, texts split though they fit, texts whose pieces do not join up."""
    x = _packed(spark, d)
    filled = x.groupBy("container_kind", "container_id", "capacity_tokens").agg(F.sum("n_tokens").alias("used"))
    over = filled.groupBy("container_kind").agg(F.count_if(F.col("used") > F.col("capacity_tokens")).alias("overfull"))
    text = x.groupBy("container_kind", "doc_id", "capacity_tokens").agg(
        F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"), F.max(F.col("from_token") + F.col("n_tokens")).alias("until")
    )
    split = text.groupBy("container_kind").agg(
        F.count("*").alias("texts"),
        F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))).alias("split_though_fitting"),
        F.count_if(F.col("tokens") != F.col("until")).alias("torn"),
    )
    return split.join(over, "container_kind")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """A mixture of the corpus's own size: sources are clamped at their caps and the others take their rest."""
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), total_tokens="all")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that ``p8_mixture`` reaches; clamped sources fall short of their target."""
    return shares(p8_mixture(spark, d), table(spark, d, "mix_targets"))


def p8_exact(spark: SparkSession, d: str) -> DataFrame:
    """The largest mixture in which every source that exists has exactly its share: as large as the scarcest source allows."""
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_exact_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(p8_exact(spark, d), table(spark, d, "mix_targets"))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Faults of both mixtures: records over their cap, of unlisted sources or given twice, and sources that water-filling would give another size.

    A source is right if it is filled to its cap, or else to the one level (tokens a weight) that all
    others below their cap share, but for one record of its own.
    """
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    have = with_token_counts(docs, {"doc_id": "doc_id", "source": "source"}, text="text").groupBy("source").agg(F.sum("n_tokens").alias("have"), F.max("n_tokens").alias("longest"))
    want = targets.join(have, "source").withColumn("cap", F.col("have") * F.col("max_repeats"))
    out = None
    for name, x in (("corpus", p8_mixture(spark, d)), ("exact", p8_exact(spark, d))):
        x = x.join(targets, "source", "left")
        rows = x.groupBy("source").agg(
            F.sum(F.col("n_tokens") * F.col("copies")).alias("got"), F.count_if(F.col("copies") > F.col("max_repeats")).alias("over"),
            F.count_if(F.col("max_repeats").isNull()).alias("unlisted"), (F.count("*") - F.count_distinct("doc_id")).alias("twice"),
        )
        j = want.join(rows, "source", "full").withColumn("got", F.coalesce("got", F.lit(0)))
        free = F.col("got") + F.col("longest") < F.col("cap")
        level = F.max(F.when(free, F.col("got") / F.col("target_share"))).over(W.partitionBy())
        reach = F.col("got") + F.col("longest") >= F.least(level * F.col("target_share"), F.col("cap"))
        j = j.withColumn("unfair", ~reach & (F.col("target_share") > 0))
        one = j.agg(F.lit(name).alias("mixture"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("over", "unlisted", "twice")], F.count_if("unfair").alias("unfair"))
        out = one if out is None else out.unionByName(one)
    return out


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_residue(table(spark, d, "documents")).select("doc_id")


def p9_kinds(spark: SparkSession, d: str) -> DataFrame:
    return find_residue(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p4_found, p4_nearest, p7_packed, p7_fill, p7_invariants, p8_mixture, p8_shares, p8_exact, p8_exact_shares, p8_invariants, p9_found, p9_kinds)
}

_NEAREST = """
WITH m AS (
  SELECT row_id, feed_id, CASE WHEN entry_ms IS NULL OR entry_ms = -9223372036854775808 THEN decision_ms ELSE entry_ms END AS t
  FROM economic_matrix),
q AS (SELECT feed_id, source_time, min(quote_id) AS quote_id FROM quotes WHERE is_valid AND source_time IS NOT NULL GROUP BY 1, 2),
c AS (
  SELECT row_id, quote_id, source_time - t AS gap FROM m ASOF JOIN q ON m.feed_id = q.feed_id AND q.source_time <= m.t
  UNION ALL SELECT row_id, quote_id, source_time - t FROM m ASOF JOIN q ON m.feed_id = q.feed_id AND q.source_time >= m.t),
best AS (
  SELECT * FROM c WHERE abs(gap) <= 30000
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY abs(gap), gap, quote_id) = 1)
"""

SQL: dict[str, str] = {
    "p4_found": _NEAREST + "SELECT row_id, quote_id FROM best",
    "p4_nearest": _NEAREST + "SELECT row_id, quote_id, gap AS gap_ms FROM m LEFT JOIN best USING (row_id)",
    # Tokens cannot be counted in SQL; what has to hold of an arrangement can be stated.
    "p7_invariants": """SELECT container_kind, (SELECT count(*) FROM documents WHERE text <> '') AS texts, 0 AS overfull, 0 AS split_though_fitting, 0 AS torn
FROM containers WHERE capacity_tokens > 0""",
    "p8_invariants": "SELECT mixture, 0 AS over, 0 AS unlisted, 0 AS twice, 0 AS unfair FROM (VALUES ('corpus'), ('exact')) v(mixture)",
}
