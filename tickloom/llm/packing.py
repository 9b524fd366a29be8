"""Filling fixed-capacity containers with items (problem 7)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.tokens import VOCABULARY, with_token_counts

PLACED = "container_kind string, container_id string, doc_id bigint, piece int, from_token bigint, n_tokens bigint, capacity_tokens bigint"


class BestFit:
    """Bounded-space online best-fit for one capacity.

    Open bins are kept by their free space: a bitset has bit ``f`` set where a bin with ``f``
    free tokens is open, so the fullest bin that still takes an item is the lowest bit at or
    above its size. When a new bin would be one too many, the fullest open one closes.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.bins, self.count, self.next_bin = 0, {}, 0, 0

    def place(self, size: int) -> int:
        """The number of the bin that takes an item of 1 to ``capacity`` tokens."""
        fits = self.bits >> size
        if fits:
            free = size + ((fits & -fits).bit_length() - 1)
            bin_ = self._take(free)
        else:
            if self.count == self.open_bins and self.bits:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, bin_ = self.capacity, self.next_bin
            self.next_bin += 1
        if free > size:
            left = free - size
            self.bins.setdefault(left, deque()).append(bin_)
            self.bits |= 1 << left
            self.count += 1
        return bin_

    def _take(self, free: int) -> int:
        queue = self.bins[free]
        bin_ = queue.popleft()
        self.count -= 1
        if not queue:
            del self.bins[free]
            self.bits &= ~(1 << free)
        return bin_


def _pieces(size: int, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(piece, from_token, length): one, unless the item exceeds the capacity by itself."""
    for i, at in enumerate(range(0, size, capacity)):
        yield i, at, min(capacity, size - at)


def pack(
    docs: DataFrame,
    containers: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    kind: str = "container_kind",
    capacity: str = "capacity_tokens",
    open_bins: int = 64,
    shard_docs: int = 20_000,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Each text assigned to containers of each kind.

    Columns: ``container_kind, container_id, doc_id, piece, from_token, n_tokens,
    capacity_tokens``. A text is split only if it exceeds the capacity by itself: then into
    full containers and a rest that is packed like any other item. No container holds more
    than its capacity. Ids of containers are ``shard-number``.

    Defined cases: null and empty texts have no tokens and need no container; a null document
    id is an item like any other; repeated rows are packed each; kinds with a null or
    non-positive capacity are left out, repeated kinds packed once; with no documents or no
    containers there are no rows. Only named columns are read.

    Method: bounded-space online best-fit (``BestFit``) with ``open_bins`` open at a time.
    Documents are dealt by a hash of their id to shards of about ``shard_docs`` (the number
    follows from the count of rows, which Parquet answers from its footers), and each shard
    packs its items in order of id in one pass that holds ``open_bins`` bins a kind. A shard
    leaves at most its open bins part-filled, which is the only loss against one long pass.
    The kinds are the fixed dimension of the problem; their few rows are read on the driver
    behind a check of their number.
    """
    if containers.select(kind).limit(1001).count() > 1000:
        raise ValueError("more than 1000 container kinds: this side is meant to be a small dimension")
    kinds = {r[0]: int(r[1]) for r in containers.select(kind, capacity).collect() if r[0] is not None and r[1] is not None and r[1] > 0}
    shards = max(1, -(-docs.count() // shard_docs))
    sized = with_token_counts(docs, {"_id": doc_id}, text=text, path=vocabulary)
    dealt = sized.where("n_tokens > 0").withColumn("_shard", F.pmod(F.xxhash64(F.col("_id").cast("string")), F.lit(shards)).cast("int"))
    ordered = dealt.repartition(min(shards, 20_000), "_shard").sortWithinPartitions("_shard", "_id", "n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, {}
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for shard, doc, size in zip(b.column(2).to_pylist(), b.column(0).to_pylist(), b.column(1).to_pylist()):
                if shard != at:
                    at, state = shard, {k: BestFit(c, open_bins) for k, c in kinds.items()}
                for k, fit in state.items():
                    for piece, start, n in _pieces(size, fit.capacity):
                        for column, v in zip(out, (k, f"{shard}-{fit.place(n)}", doc, piece, start, n, fit.capacity)):
                            column.append(v)
            types = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types)], names=[x.split()[0] for x in PLACED.split(", ")])

    return ordered.mapInArrow(run, PLACED)


def fill_report(placed: DataFrame) -> DataFrame:
    """Per kind: containers, texts, tokens, and the share of capacity that stays unused."""
    per = placed.groupBy("container_kind", "container_id", "capacity_tokens").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return per.groupBy("container_kind", "capacity_tokens").agg(
        F.count("*").alias("containers"),
        F.sum("items").alias("pieces"),
        F.sum("used").alias("tokens"),
        F.max("used").alias("fullest"),
        (1 - F.sum("used") / F.sum("capacity_tokens")).alias("unused_share"),
    )
