"""Content hashes, hash chains and comparisons of recomputed tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of a canonical text of the columns: values joined by a unit separator, nulls marked."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)


def fingerprint_columns(h: str) -> list[Column]:
    """The aggregates of ``table_fingerprint`` over a column of row hashes."""
    part = lambda a: F.conv(F.substring(h, a, 15), 16, 10).cast("decimal(38,0)")
    return [F.count("*").alias("rows"), F.sum(part(1)).alias("sum_a"), F.sum(part(16)).alias("sum_b")]


def table_fingerprint(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Order-free content hash: count, and sums of the halves of a 128-bit piece of each row's hash.

    Rows may come in any order and partitioning; repeated rows count as often as they occur.
    """
    return df.withColumn("_h", row_hash(columns)).groupBy(*(by or [])).agg(*fingerprint_columns("_h"))


def bucket_chain(df: DataFrame, by: list[str], bucket: str, columns: list[str]) -> DataFrame:
    """A chain a reader can verify in parallel: each bucket's hash covers its rows and names the bucket before.

    ``(by, bucket, rows, body, previous, link)`` with ``link = sha256(previous body + body)``. The body
    covers the hashes, in order, of the bucket's 4,096 parts by the first three digits of their rows'
    hashes; each part covers its rows' hashes in order. So no task gathers more of a bucket than a part.
    """
    h = df.withColumn("_h", row_hash(columns)).withColumn("_x", F.substring("_h", 1, 3))
    part = h.groupBy(*by, bucket, "_x").agg(F.count("*").alias("_n"), F.sha2(F.concat_ws("", F.array_sort(F.collect_list("_h"))), 256).alias("_p"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_x", "_p"))), lambda x: x["_p"])
    h = part.groupBy(*by, bucket).agg(F.sum("_n").alias("rows"), F.sha2(F.concat_ws("", parts), 256).alias("body"))
    prev = F.coalesce(F.lag("body").over(W.partitionBy(*by).orderBy(bucket)), F.lit("0" * 64))
    return h.withColumn("previous", prev).withColumn("link", F.sha2(F.concat("previous", "body"), 256))


def broken_links(chain: DataFrame, by: list[str], order: str) -> DataFrame:
    """Links that do not follow from the record before, or whose own hash is wrong."""
    prev = F.coalesce(F.lag("body").over(W.partitionBy(*by).orderBy(order)), F.lit("0" * 64))
    return chain.withColumn("_p", prev).where((F.col("previous") != F.col("_p")) | (F.col("link") != F.sha2(F.concat("previous", "body"), 256))).drop("_p")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, with multiplicity: empty if a replay is equal."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def key_faults(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are repeated on a side or missing on the other, per kind."""
    n = lambda d, c: d.groupBy(*keys).agg(F.count("*").alias(c))
    j = n(left, "_a").join(n(right, "_b"), keys, "full")
    kind = F.array_compact(
        F.array(
            F.when(F.col("_a") > 1, F.lit("repeated_left")), F.when(F.col("_b") > 1, F.lit("repeated_right")),
            F.when(F.col("_a").isNull(), F.lit("missing_left")), F.when(F.col("_b").isNull(), F.lit("missing_right")),
        )
    )
    return j.select(*keys, F.explode(kind).alias("fault"))


class Ledger:
    """An append-only JSON-lines ledger whose records name the hash of the one before.

    Driver-side bookkeeping of runs: a reservation must be closed before it may be repeated, and
    no more than ``budget`` may be made.
    """

    def __init__(self, path: str, budget: int):
        self.path, self.budget = path, budget

    def records(self) -> list[dict]:
        try:
            with open(self.path, encoding="utf-8") as f:
                rows = [json.loads(x) for x in f]
        except FileNotFoundError:
            return []
        last = "0" * 64
        for r in rows:
            body = {k: v for k, v in r.items() if k != "sha256"}
            if r["previous"] != last or r["sha256"] != self._hash(body):
                raise ValueError(f"ledger broken at {r.get('name')}")
            last = r["sha256"]
        return rows

    @staticmethod
    def _hash(body: dict) -> str:
        return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()

    def append(self, name: str, event: str, **facts) -> str:
        rows = self.records()
        if event == "reserve":
            if any(r["name"] == name for r in rows):
                raise ValueError(f"{name} was reserved before; no retries")
            if sum(r["event"] == "reserve" for r in rows) >= self.budget:
                raise ValueError("budget used up")
        elif not any(r["name"] == name and r["event"] == "reserve" for r in rows):
            raise ValueError(f"{name} was never reserved")
        body = {"name": name, "event": event, "facts": facts, "previous": rows[-1]["sha256"] if rows else "0" * 64}
        body["sha256"] = self._hash(body)
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps(body, sort_keys=True) + "\n")
        return body["sha256"]
