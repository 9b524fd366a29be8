"""Sinks that read back what they wrote, and reports as CSV, JSON lines and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tickloom.operators.intervals import weighted_schedule
from tickloom.operators.provenance import fingerprint_columns, row_hash, table_fingerprint


def write_verified(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, mode: str = "error") -> DataFrame:
    """Write, read again, compare the order-free fingerprint, and return the table as read.

    What is written is fingerprinted on its way (``df`` is evaluated once); both fingerprints are
    one row. A difference raises and leaves the files for inspection.
    """
    seen = Observation()
    hashed = df.withColumn("_h", row_hash(df.columns)).observe(seen, *fingerprint_columns("_h")).drop("_h")
    w = hashed.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    spark = df.sparkSession
    back = spark.read.format(fmt).schema(df.schema).load(path).select(*df.columns)
    got, want = table_fingerprint(back, df.columns).first().asDict(), seen.get
    if want != got:
        raise ValueError(f"{path}: wrote {want}, read {got}")
    return back


def label_exports(labels: DataFrame) -> dict[str, DataFrame]:
    """What is exported of labels: all that are resolved, the best of them that do not overlap, and hard negatives.

    ``label`` is 1 for a reached target. Rows without a conclusive outcome are no labels and are left
    out. The selection (most total value, then least time, per feed) needs the columns ``feed_id, b,
    side, end_s, pnl_pips``; without them it is not made. Hard negatives are stopped before a
    target that was still reached.
    """
    known = labels.where("outcome in ('take_profit', 'stop_loss', 'timeout')").withColumn("label", (F.col("outcome") == "take_profit").cast("int"))
    parts = {"all": known, "hard_negatives": known.where("outcome = 'stop_loss' and post_status = 'reached'")}
    if {"feed_id", "b", "side", "end_s", "pnl_pips"} <= set(labels.columns):
        key = (2 * F.col("b") + (F.col("side") < 0).cast("int")).alias("_key")
        rows = known.select("feed_id", key, "b", "end_s", (F.col("pnl_pips") * 10_000).cast("bigint").alias("_v"))
        best = weighted_schedule(rows, "_key", "feed_id", "b", "end_s", "_v")
        parts["selected"] = known.withColumn("_key", key).join(best, ["feed_id", "_key"], "left_semi").drop("_key")
    return parts


def write_labels(labels: DataFrame, path: str) -> None:
    """``label_exports`` as CSV with headers, a folder each."""
    parts = label_exports(labels)
    for name, df in parts.items():
        df.write.mode("error").option("header", True).csv(f"{path}/{name}")


def union_reports(parts: list[DataFrame]) -> DataFrame:
    """Report tables under each other; columns that one lacks are null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table as Markdown. Reports are small: more than ``most`` rows raise instead of being cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: not a report")
    cell = lambda v: "unknown" if v is None else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])


def parse_markdown(lines: DataFrame, column: str, names: list[str]) -> DataFrame:
    """Rows of a Markdown table in a column of lines; head, rule and other text are left out."""
    cells = F.transform(F.split(F.trim(F.col(column)), r"(?<!\\)\|"), lambda x: F.trim(x))
    x = lines.select(cells.alias("_c")).where(F.size("_c") == len(names) + 2)
    x = x.where((F.col("_c")[0] == "") & ~F.col("_c")[1].rlike("^:?-+:?$") & (F.col("_c")[1] != names[0]))
    return x.select(*[F.col("_c")[i + 1].alias(n) for i, n in enumerate(names)])
