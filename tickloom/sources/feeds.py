"""Readers of price feeds: candle and tick CSV, and compressed binary records."""

from __future__ import annotations

import lzma
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.records import RESUME, record_ends

#: Schemas of the delivered files (fixed formats).
CANDLE_CSV = "timestamp timestamp, open decimal(18,8), high decimal(18,8), low decimal(18,8), close decimal(18,8), volume double"
TICK_CSV = "timestamp_utc timestamp, source_timestamp_est string, bid decimal(18,8), ask decimal(18,8), volume double, source_sequence bigint, flags string"
#: Big-endian records of binary feeds: prices are integers of 1/scale, times are offsets into the file's span.
TICK_RECORD = np.dtype([("ms", ">u4"), ("ask", ">u4"), ("bid", ">u4"), ("ask_volume", ">f4"), ("bid_volume", ">f4")])
BAR_RECORD = np.dtype([("second", ">u4"), ("open", ">u4"), ("close", ">u4"), ("low", ">u4"), ("high", ">u4"), ("volume", ">f4")])
SCALE = 100_000


def read_candles(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Typed candles; a malformed file fails at once. For files that may hold bad lines use ``records``."""
    return spark.read.schema(CANDLE_CSV).csv(path, header=header, mode="FAILFAST", timestampFormat="yyyy-MM-dd[ ]['T']HH:mm:ssXXX", enforceSchema=True)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files as ``(line_id, file_name, line_no, raw)`` for ``records.read_candle_lines``.

    A record ends at a newline outside quotes, so one with a newline in a quoted field stays whole;
    a line that begins with a stamp or a header begins a record all the same (``RESUME``).
    Numbers need the order within a file, so a file is read whole by one task; ids are unique
    but not dense.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                ends = record_ends(np.frombuffer(content, np.uint8), RESUME).tolist() if content else []
                rows = [content[a:z].removesuffix(b"\n").decode("utf-8", "replace") for a, z in zip([0, *ends], ends)]
                yield pd.DataFrame({"file_name": p, "line_no": np.arange(1, len(rows) + 1), "raw": rows})

    out = files.mapInPandas(split, "file_name string, line_no bigint, raw string")
    return out.withColumn("line_id", F.xxhash64("file_name", "line_no"))


def est_to_utc(text: Column, fmt: str = "yyyyMMdd HHmmss") -> Column:
    """A stamp in fixed UTC-5 (no daylight saving) as a UTC timestamp; null if it is none."""
    return F.try_to_timestamp(text, F.lit(fmt)) + F.expr("interval 5 hours")


def est_millis(text: Column) -> Column:
    """``yyyyMMdd HHmmssSSS`` in fixed UTC-5 as epoch milliseconds; null unless it is exactly that."""
    ok = text.rlike(r"^\d{8} \d{9}$")
    at = F.try_to_timestamp(F.substring(text, 1, 15), F.lit("yyyyMMdd HHmmss"))
    return F.when(ok, F.unix_millis(at) + F.substring(text, 16, 3).cast("bigint") + 5 * 3_600_000)


def binary_records(payload: bytes, layout: np.dtype) -> np.ndarray:
    """The records of a compressed payload; an empty one has none, one cut within a record is refused."""
    if not payload:
        return np.zeros(0, layout)
    raw = lzma.decompress(payload)
    whole, rest = divmod(len(raw), layout.itemsize)
    if rest:
        raise ValueError(f"{rest} bytes after {whole} whole records")
    return np.frombuffer(raw, layout)


def decode_ticks(payload: bytes) -> np.ndarray:
    return binary_records(payload, TICK_RECORD)


def decode_bars(payload: bytes) -> np.ndarray:
    return binary_records(payload, BAR_RECORD)


def _first_fault(n: int, checks: dict[str, np.ndarray]) -> np.ndarray:
    """For each record the first check it fails, or none."""
    return np.select(list(checks.values()), list(checks), "") if n else np.zeros(0, str)


def _volume_fault(*volumes: np.ndarray) -> np.ndarray:
    return np.any([~np.isfinite(v) | (v < 0) for v in volumes], axis=0)


def tick_faults(r: np.ndarray, span_ms: int = 3_600_000) -> np.ndarray:
    """``range`` (outside the file's span), ``order`` (before the latest so far), ``price`` (not above zero, or crossed), ``volume``."""
    ms, bid, ask = (r[c].astype(np.int64) for c in ("ms", "bid", "ask"))
    top = np.maximum.accumulate(ms) if len(r) else ms
    return _first_fault(len(r), {"range": ms >= span_ms, "order": ms < top, "price": (bid <= 0) | (ask < bid), "volume": _volume_fault(r["ask_volume"], r["bid_volume"])})


def bar_faults(r: np.ndarray, span_s: int = 86_400) -> np.ndarray:
    """``range`` (outside the day or off the minute), ``order`` (not after all before), ``price`` (not above zero, or no range), ``volume``."""
    at, o, c, lo, h = (r[x].astype(np.int64) for x in ("second", "open", "close", "low", "high"))
    seen = np.concatenate(([-1], np.maximum.accumulate(at)[:-1])) if len(r) else at
    price = (lo <= 0) | (lo > np.minimum(o, c)) | (np.maximum(o, c) > h)
    return _first_fault(len(r), {"range": (at >= span_s) | (at % 60 != 0), "order": at <= seen, "price": price, "volume": _volume_fault(r["volume"])})


def _read_binary(spark: SparkSession, path: str, start: Column, layout: np.dtype, time: str, prices: tuple[str, ...], volumes: tuple[str, ...], faults, scale: int, out: str) -> DataFrame:
    """Files are decoded where they lie, vectorised; prices become exact decimals in the JVM. Faulty records are kept, with ``reason``."""
    files = spark.read.format("binaryFile").load(path).select("path", start.cast("bigint").alias("start"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, s, c in zip(b["path"], b["start"], b["content"]):
                r = binary_records(c, layout)
                columns = {x: r[x].astype(np.int64) for x in prices} | {x: r[x].astype(float) for x in volumes}
                yield pd.DataFrame({"path": p, out: r[time].astype(np.int64) + s, **columns, "reason": faults(r)})

    schema = ", ".join([f"path string, {out} bigint", *[f"{x} bigint" for x in prices], *[f"{x} double" for x in volumes], "reason string"])
    price = [(F.col(x).cast("decimal(18,0)") / scale).cast("decimal(18,8)").alias(x) for x in prices]
    return files.mapInPandas(run, schema).select("path", out, *price, *volumes, F.nullif("reason", F.lit("")).alias("reason"))


def read_binary_ticks(spark: SparkSession, path: str, start_ms: Column, scale: int = SCALE) -> DataFrame:
    """``(path, ts_ms, bid, ask, bid_volume, ask_volume, reason)``; ``start_ms`` derives each file's first instant from ``path``."""
    return _read_binary(spark, path, start_ms, TICK_RECORD, "ms", ("bid", "ask"), ("bid_volume", "ask_volume"), tick_faults, scale, "ts_ms")


def read_binary_bars(spark: SparkSession, path: str, start_s: Column, scale: int = SCALE) -> DataFrame:
    """``(path, b, open, high, low, close, volume, reason)``; ``start_s`` derives each file's day from ``path``."""
    return _read_binary(spark, path, start_s, BAR_RECORD, "second", ("open", "high", "low", "close"), ("volume",), bar_faults, scale, "b")
