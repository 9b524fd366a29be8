"""Text records to typed candles, with the records that fail kept apart and reasoned (problem 2).

A structural index in the manner of vectorised CSV and JSON parsers: the quote bytes of a whole
batch are one mask, its prefix parity tells the bytes inside quotes, and the delimiters are the
commas outside. No record is looked at one by one in Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.session import written

QUOTE, COMMA, CR, NEWLINE = 34, 44, 13, 10
COLUMNS = ("timestamp", "open", "high", "low", "close", "volume")
STAMP = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:Z|\+00:00)$"
PLAIN = r"^[0-9]+(?:\.[0-9]+)?$"
_MONTH_DAYS = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])

PARSED = T.StructType(
    [
        T.StructField("_id", T.LongType()),
        T.StructField("_file", T.StringType()),
        T.StructField("_no", T.LongType()),
        T.StructField("_raw", T.StringType()),
        T.StructField("_n", T.IntegerType()),
        T.StructField("_head", T.StringType()),
        T.StructField("_bad", T.ArrayType(T.StringType())),
        T.StructField("_ts", T.LongType()),
        *[T.StructField(f"_{c}", T.StringType()) for c in COLUMNS[1:]],
    ]
)


#: A line that begins like this begins a record, whatever quote was left open before it.
RESUME = re.compile(rb"\n(?=[ \t]*\"?[ \t]*(?:\d{4}-\d\d-\d\d|timestamp))")


def record_ends(buf: np.ndarray, resume: re.Pattern | None = None) -> np.ndarray:
    """Offsets just after each record of a file's bytes: newlines outside quotes, and the end.

    With ``resume`` a newline it matches ends a record in any case and parity starts anew, so that
    a quote left open swallows no record that follows.
    """
    quotes = np.cumsum(buf == QUOTE)
    lines = np.flatnonzero(buf == NEWLINE)
    forced = np.array([m.start() for m in resume.finditer(buf.tobytes())] if resume else [], np.int64)
    base = np.concatenate(([0], quotes[forced]))[np.searchsorted(forced, lines)]  # quotes before the stretch that a newline lies in
    ends = lines[((quotes[lines] - base) % 2 == 0) | np.isin(lines, forced)] + 1
    return ends if len(ends) and ends[-1] == len(buf) else np.append(ends, len(buf))


def structural_index(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Delimiters of the records ``buf[starts:ends]``.

    Returns each field's start and end, the number of its record, and for each record whether
    its quotes are unbalanced. Parity starts anew with each record, so that a quote left open
    spoils no record but its own.
    """
    mask = buf == QUOTE
    quotes = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))  # quotes before each byte
    commas = np.flatnonzero(buf == COMMA)
    record = np.searchsorted(starts, commas, side="right") - 1
    inside = (record >= 0) & (commas < ends[np.maximum(record, 0)])
    commas, record = commas[inside], record[inside]
    outside = (quotes[commas] - quotes[starts[record]]) % 2 == 0
    commas, record = commas[outside], record[outside]
    n = len(starts)
    all_starts = np.concatenate((starts, commas + 1))
    all_records = np.concatenate((np.arange(n), record))
    order = np.lexsort((all_starts, all_records))
    first, of = all_starts[order], all_records[order]
    last = np.concatenate((first[1:] - 1, [0]))
    tail = np.append(of[1:] != of[:-1], True)
    last[tail] = ends[of[tail]]
    return first, last, of, (quotes[ends] - quotes[starts]) % 2 == 1


def _strip(buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Move bounds past blanks and tabs, by the nearest other byte on each side: one pass however long their runs are."""
    n = len(buf)
    solid = (buf != 32) & (buf != 9)
    at = np.arange(n)
    after = np.append(np.minimum.accumulate(np.where(solid, at, n)[::-1])[::-1], n)  # the first solid byte from each
    before = np.concatenate(([0], np.maximum.accumulate(np.where(solid, at + 1, 0))))  # one past the last solid byte before each
    a = np.minimum(after[a], b)
    return a, np.maximum(before[b], a)


def _strings(buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.LargeStringArray:
    """The byte ranges as an Arrow string column, gathered at once."""
    size = b - a
    offsets = np.concatenate(([0], np.cumsum(size)))
    data = buf[np.repeat(a - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(a), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def _stamps(text: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """Epoch microseconds, and whether the text is a real UTC date and time of the allowed forms."""
    ok = pc.match_substring_regex(text, STAMP).to_numpy(zero_copy_only=False).astype(bool)
    us = np.zeros(len(text), np.int64)
    if ok.any():
        body = pc.utf8_slice_codeunits(text.filter(pa.array(ok)), 0, 19)
        d = np.frombuffer("".join(body.to_pylist()).encode(), np.uint8).reshape(-1, 19).astype(np.int64) - 48
        year = d[:, 0] * 1000 + d[:, 1] * 100 + d[:, 2] * 10 + d[:, 3]
        month, day, hour, minute, sec = (d[:, i] * 10 + d[:, i + 1] for i in (5, 8, 11, 14, 17))
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        real = (year >= 1) & (month >= 1) & (month <= 12) & (day >= 1) & (hour < 24) & (minute < 60) & (sec < 60)
        real &= day <= _MONTH_DAYS[np.minimum(month, 12)] + (leap & (month == 2))
        months = ((year - 1970) * 12 + np.clip(month, 1, 12) - 1).astype("datetime64[M]")
        days = months.astype("datetime64[D]").astype(np.int64) + day - 1
        us[ok] = (days * 86_400 + hour * 3600 + minute * 60 + sec) * 1_000_000
        ok[ok] = real
    return us, ok


def parse_lines(raw: pa.Array) -> dict[str, pa.Array]:
    """Index, count and type checks of a column of lines; every output has one value a line."""
    raw = pc.fill_null(raw.cast(pa.large_string()), "")
    n = len(raw)
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + n + 1] if n else np.zeros(1, np.int64)
    whole = np.frombuffer(raw.buffers()[2], np.uint8) if n and raw.buffers()[2] is not None and raw.buffers()[2].size else np.zeros(0, np.uint8)
    buf = whole[offsets[0] : offsets[-1]]
    starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    padded = np.append(buf, [0, 0, 0])
    mark = (ends - starts >= 3) & (padded[starts] == 0xEF) & (padded[starts + 1] == 0xBB) & (padded[starts + 2] == 0xBF) if n else np.zeros(0, bool)
    starts = starts + 3 * mark  # a byte order mark is no part of the first field
    ends = ends - ((ends > starts) & (padded[ends - 1] == CR))
    first, last, of, unbalanced = structural_index(buf, starts, ends)
    count = np.bincount(of, minlength=n)

    # Unwrap fields that are wrapped as a whole; a quote that is left over is misplaced.
    a, b = _strip(buf, first, last)
    wrapped = (b - a >= 2) & (padded[a] == QUOTE) & (padded[b - 1] == QUOTE)
    a, b = _strip(buf, a + wrapped, b - wrapped)
    quotes = np.concatenate(([0], np.cumsum(buf == QUOTE)))
    misplaced = np.bincount(of[quotes[b] > quotes[a]], minlength=n) > 0
    values = _strings(buf, a, b)

    # What may be a repeated header: its names, unquoted.
    names = np.zeros(n, bool)
    lower = np.bincount(of, weights=pc.is_in(values, value_set=pa.array(COLUMNS, pa.large_string())).to_numpy(zero_copy_only=False), minlength=n)
    names |= (lower == count) & (count > 0)
    at = np.concatenate(([0], np.cumsum(count)))
    grouped = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), values)
    head = pc.if_else(pa.array(names), pc.binary_join(grouped, pa.scalar(",", pa.large_string())), pa.nulls(n, pa.large_string()))

    def field(k: int) -> pa.LargeStringArray:
        have = count > k
        pos = np.where(have, at[:-1] + k, 0)
        return pc.if_else(pa.array(have), values.take(pa.array(pos)), pa.nulls(n, pa.large_string())) if len(values) else pa.nulls(n, pa.large_string())

    texts = [field(k) for k in range(len(COLUMNS))]
    us, real = _stamps(pc.fill_null(texts[0], ""))
    plain = [pc.match_substring_regex(pc.fill_null(t, ""), PLAIN).to_numpy(zero_copy_only=False) for t in texts[1:]]
    empty = pc.equal(pc.fill_null(texts[5], ""), "").to_numpy(zero_copy_only=False)
    checks = [("open_quote", unbalanced), ("stray_quote", misplaced & ~unbalanced), ("bad_timestamp", ~real)]
    checks += [(f"bad_{c}", ~p) for c, p in zip(COLUMNS[1:5], plain[:4])] + [("bad_volume", ~plain[4] & ~empty)]
    hit = np.stack([m for _, m in checks], axis=1)
    at_bad = np.concatenate(([0], np.cumsum(hit.sum(axis=1)))).astype(np.int32)
    labels = pa.array([c for c, _ in checks]).take(pa.array(np.nonzero(hit)[1]))
    return {
        "_n": pa.array(count.astype(np.int32)),
        "_head": head.cast(pa.string()),
        "_bad": pa.ListArray.from_arrays(pa.array(at_bad), labels),
        "_ts": pc.if_else(pa.array(real), pa.array(us), pa.nulls(n, pa.int64())),
        **{f"_{c}": pc.if_else(pa.array(p), t, pa.nulls(n, pa.large_string())).cast(pa.string()) for c, t, p in zip(COLUMNS[1:], texts[1:], plain)},
    }


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            cols = {c: b.column(i) for i, c in enumerate(("_id", "_file", "_no", "_raw"))} | parse_lines(b.column(3))
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in PARSED], names=PARSED.names)


def read_candle_lines(
    lines: DataFrame,
    *,
    line_id: str = "line_id",
    file_name: str = "file_name",
    line_no: str = "line_no",
    raw: str = "raw",
) -> DataFrame:
    """Each line judged once: ``(line_id, file_name, line_no, kind, reasons, ts, open..close, volume, raw)``.

    ``kind`` is ``header`` (line 1 of a file, or a line that repeats its column names),
    ``candle`` or ``reject``. Rejects carry all their ``reasons``: ``open_quote`` or
    ``stray_quote``, ``column_count`` (as against line 1 of the file), ``bad_timestamp``,
    ``bad_<price>`` (no plain decimal), ``not_positive``, ``price_order``, ``bad_volume`` and
    ``out_of_range`` (plain, but more than a DECIMAL(38,18) holds). Values are typed for
    candles only: prices DECIMAL(38,18), so that digits are not rounded away before the checks.

    Defined cases: a null or empty line is a reject by its count; a trailing carriage return is
    ignored; a line of a file without line 1, or with a null file name, may have 5 or 6 columns;
    repeated lines are each judged; other columns are not read. An empty table gives no rows.

    Distribution: lines are parsed where they are read. What a file's header says, one row a
    file, is read first and written to the shared folder, so that its size is known when the join is
    planned: while it is small the lines are not shuffled; beyond that it is a sort-merge join whose
    hot files AQE splits.
    """
    slim = lines.select(F.col(line_id).cast("bigint").alias("_id"), F.col(file_name).alias("_file"), F.col(line_no).cast("bigint").alias("_no"), F.col(raw).alias("_raw"))
    parsed = slim.mapInArrow(_parse, PARSED)
    first = slim.where("_no = 1 and _file is not null").mapInArrow(_parse, PARSED)
    headers = first.groupBy("_file").agg(F.min("_n").alias("_want"), F.min("_head").alias("_names"))
    j = parsed.join(written(headers, "headers"), "_file", "left")
    price = {c: F.expr(f"try_cast(_{c} as decimal(38,18))") for c in COLUMNS[1:]}
    j = j.withColumns({f"_{c}": e for c, e in price.items()} | {f"_had_{c}": F.col(f"_{c}").isNotNull() for c in COLUMNS[1:]})
    o, h, lo, c = (F.col(f"_{x}") for x in COLUMNS[1:5])
    six = F.col("_n") == 6
    counted = F.when(F.col("_want").isNull(), F.col("_n").isin(5, 6)).otherwise((F.col("_n") == F.col("_want")) & F.col("_n").isin(5, 6))
    wide = F.lit(False)
    for x in COLUMNS[1:]:
        wide = wide | (F.col(f"_had_{x}") & F.col(f"_{x}").isNull() & ((F.lit(x) != "volume") | six))
    more = F.array_compact(
        F.array(
            F.when(~counted, F.lit("column_count")),
            F.when((o <= 0) | (h <= 0) | (lo <= 0) | (c <= 0), F.lit("not_positive")),
            F.when((lo > F.least(o, c)) | (h < F.greatest(o, c)), F.lit("price_order")),
            F.when(wide, F.lit("out_of_range")),
        )
    )
    typed = F.when(six, F.col("_bad")).otherwise(F.array_except("_bad", F.array(F.lit("bad_volume"))))
    header = (F.coalesce(F.col("_no"), F.lit(0)) == 1) | F.coalesce(F.col("_head") == F.col("_names"), F.lit(False))
    j = j.withColumn("_all", F.concat(more, typed))
    j = j.withColumn("kind", F.when(header, "header").when(F.size("_all") > 0, "reject").otherwise("candle"))
    good = F.col("kind") == "candle"
    return j.select(
        F.col("_id").alias("line_id"),
        F.col("_file").alias("file_name"),
        F.col("_no").alias("line_no"),
        "kind",
        F.when(F.col("kind") == "reject", F.col("_all")).otherwise(F.array().cast("array<string>")).alias("reasons"),
        F.when(good, F.timestamp_micros("_ts")).alias("ts"),
        *[F.when(good, F.col(f"_{x}")).alias(x) for x in COLUMNS[1:5]],
        F.when(good & six, F.col("_volume")).alias("volume"),
        F.col("_raw").alias("raw"),
    )
