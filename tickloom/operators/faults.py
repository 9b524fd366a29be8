"""Implausible spikes, stuck values and impossible readings, each feed by its own behaviour (problem 3)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.time import DAY_S, US
from tickloom.operators.chunks import stamp_chunks

IMPOSSIBLE, STUCK, SPIKE = 1, 2, 4


@dataclass(frozen=True)
class FaultConfig:
    """``spike_ratio``: distance to the levels before and after, in medians of the feed's range.
    ``side``: readings on each side whose median is the local background, so spikes of up to
    half as many readings are seen through. ``halo``: stamps that a chunk sees on both sides."""

    spike_ratio: float = 12.0
    side: int = 15
    chunk: int = 4096
    halo: int = 256


def _side_medians(c: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Median of the last ``side`` values before each position 0..n of ``c``, and of the next ones from it."""
    n = len(c)
    if not n:
        return np.full(1, np.nan), np.full(1, np.nan)
    k = min(side, n)
    mid = np.median(np.lib.stride_tricks.sliding_window_view(c, k), axis=1)  # of c[i : i + k]
    before = np.full(n + 1, np.nan)
    before[k:] = mid
    for i in range(1, k):
        before[i] = np.median(c[:i])
    after = np.full(n + 1, np.nan)
    after[: n - k + 1] = mid
    for i in range(n - k + 1, n):
        after[i] = np.median(c[i:])
    return before, after


def _nearer(x: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Signed distance to the nearer of two levels; to the other one where one is not known."""
    a, b = x - before, x - after
    return np.where(np.isnan(b) | (np.abs(a) <= np.abs(b)), a, b)


def _spread(x: np.ndarray, floor: float) -> float:
    x = x[np.isfinite(x)]
    return max(floor, 1.4826 * float(np.median(np.abs(x - np.median(x))))) if len(x) else floor


def phase_space_outliers(values: list[np.ndarray], level: np.ndarray, usable: np.ndarray, scale: float, cfg: FaultConfig) -> np.ndarray:
    """Rows outside a robust ellipsoid over value, first and second difference, iterated.

    The value is the distance from the local background (the nearer of the medians of the
    levels before and after, rows flagged so far left out), so that a lasting change of level
    is none. The semi-axes are the universal threshold ``sqrt(2 ln n)`` times robust spreads, and
    ``scale`` at least: a feed that hardly moves has no spike within its usual range. A jump
    out and back weighs in all three axes, twice as much in the second difference. Each round
    flags more rows or is the last. ``usable`` rows may serve as background.
    """
    n = len(level)
    out = np.zeros(n, bool)
    lam = np.sqrt(2 * np.log(max(n, 3)))
    while True:
        base = usable & ~out
        before, after = _side_medians(level[base], cfg.side)
        at = np.cumsum(base) - base  # usable rows before each row
        found, strict = np.zeros(n, bool), np.zeros(n, bool)
        for x in values:
            u = _nearer(x, before[at], after[at + base])
            d1 = np.diff(u, prepend=np.nan)
            d2 = np.append(d1[1:], np.nan) - d1
            axes = [max(scale, lam * _spread(v[base], 0.0)) for v in (u, d1, d2)]
            with np.errstate(invalid="ignore"):
                r = sum(np.nan_to_num((v / w) ** 2) for v, w in zip((u, d1, d2), axes))
                found |= r > 1
                strict |= (r > 1) & (np.abs(u) > axes[0])
        strict &= ~np.isnan(level)
        if not (strict & ~out).any():
            return found | out
        out |= strict


def exact_spikes(values: list[np.ndarray], level: np.ndarray, candidates: np.ndarray, case: np.ndarray, spare: np.ndarray, scale: float, cfg: FaultConfig) -> np.ndarray:
    """Candidates farther than ``spike_ratio`` scales from the level just before and just after.

    Levels are those of the nearest rows that are no cases themselves, so the set is the
    fixpoint that starts with every candidate taken for a case. Should the rounds come back to a
    set seen before, rows that are none in either are given up for good, so that it ends. Where a side of the chunk holds
    no such row, the nearest ``spare`` one (stuck, but at a real level) stands in; with no
    level on a side there is no spike.
    """
    n = len(level)
    pos = np.arange(n)
    spikes, seen = candidates.copy(), set()
    while True:
        sound = ~(case | spikes | np.isnan(level))
        levels = []
        for forward in (True, False):
            near = []
            for m in (sound, spare & ~spikes & ~np.isnan(level)):
                if forward:
                    i = np.maximum.accumulate(np.where(m, pos, -1))
                    i = np.concatenate(([-1], i[:-1]))
                else:
                    i = np.minimum.accumulate(np.where(m, pos, n)[::-1])[::-1]
                    i = np.concatenate((i[1:], [n]))
                    i = np.where(i == n, -1, i)
                near.append(i)
            i = np.where(near[0] >= 0, near[0], near[1])
            levels.append(np.where(i >= 0, level[np.maximum(i, 0)], np.nan))
        far = np.zeros(n, bool)
        with np.errstate(invalid="ignore"):
            for x in values:
                far |= (np.abs(x - levels[0]) > cfg.spike_ratio * scale) & (np.abs(x - levels[1]) > cfg.spike_ratio * scale)
        now = candidates & far
        if (now == spikes).all():
            return spikes
        if now.tobytes() in seen:
            now &= spikes
            candidates = now
        seen.add(now.tobytes())
        spikes = now


def stuck_runs(stamp: np.ndarray, value: np.ndarray, known: np.ndarray, least: int) -> np.ndarray:
    """Rows whose value stays the same over ``least`` or more stamps in a row (zero first difference).

    Equal stamps count once. Where one stamp has several values (a bar and its revision), a run
    may go through either the first or the last of them. Unknown values are passed over.
    """
    out = np.zeros(len(stamp), bool)
    idx = np.flatnonzero(known)
    if len(idx) < least:
        return out
    s, v = stamp[idx], value[idx]
    new = np.append(True, s[1:] != s[:-1])
    which = np.cumsum(new) - 1  # number of the stamp
    heads, tails = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
    for pick in (heads, tails):
        x = v[pick]
        begin = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
        length = np.diff(np.append(begin, len(x)))
        run = np.repeat(length >= least, length)
        out[idx] |= run[which] & (v == x[which])
    return out


RESULT = "_tab string, _feed bigint, _id bigint, _bits int"


def _judge(cfg: FaultConfig, pairwise: set[str], least: dict[str, int]):
    def run(table: pa.Table) -> pa.Table:
        n = table.num_rows
        get = lambda c: table.column(c).to_numpy()
        order = np.lexsort((get("_id"), get("_rank")))
        hi, lo, level = (get(c).astype(float)[order] for c in ("_hi", "_lo", "_level"))
        hi_i, lo_i, rank, own, bad = (get(c)[order] for c in ("_hi_i", "_lo_i", "_rank", "_own", "_bad"))
        tab = table.column("_tab")[0].as_py()
        scale = float(table.column("_scale")[0].as_py() or 0.0)
        known_hi, known_lo = ~np.isnan(hi), ~np.isnan(lo)
        if tab in pairwise:
            pair = np.unique(np.stack((hi_i, lo_i), axis=1), axis=0, return_inverse=True)[1].reshape(-1)
            stuck = stuck_runs(rank, pair, known_hi & known_lo, least[tab])
        else:
            stuck = stuck_runs(rank, hi_i, known_hi, least[tab]) | stuck_runs(rank, lo_i, known_lo, least[tab])
        case = bad | stuck
        if scale > 0:
            usable = ~bad & ~np.isnan(level)
            cand = phase_space_outliers([hi, lo], level, usable, scale, cfg)
            spike = exact_spikes([hi, lo], level, cand, case, stuck & ~bad, scale, cfg)
        else:
            spike = np.zeros(n, bool)
        bits = IMPOSSIBLE * bad + STUCK * stuck + SPIKE * spike
        keep = own & (bits > 0)
        feed, ids = table.column("_feed").to_numpy()[order], get("_id")[order]
        return pa.table(
            {
                "_tab": pa.array([tab] * int(keep.sum()), pa.string()),
                "_feed": pa.array(feed[keep], pa.int64()),
                "_id": pa.array(ids[keep], pa.int64()),
                "_bits": pa.array(bits[keep].astype(np.int32)),
            }
        )

    return run


def readings(df: DataFrame, tab: str, *, rec_id: str, feed: str, time_us: Column, hi: str, lo: str, level: Column, impossible: Column) -> DataFrame:
    """The common form of the tables judged; rows without a time stamp, feed or id are no cases."""
    unscaled = lambda c: (F.col(c).cast("decimal(28,8)") * 100_000_000).cast("bigint")
    return df.select(
        F.lit(tab).alias("_tab"),
        F.col(feed).cast("bigint").alias("_feed"),
        F.col(rec_id).cast("bigint").alias("_id"),
        time_us.alias("_t"),
        F.col(hi).cast("double").alias("_hi"),
        F.col(lo).cast("double").alias("_lo"),
        F.coalesce(unscaled(hi), F.lit(0)).alias("_hi_i"),
        F.coalesce(unscaled(lo), F.lit(0)).alias("_lo_i"),
        level.cast("double").alias("_level"),
        F.coalesce(impossible, F.lit(False)).alias("_bad"),
        (F.col(hi) - F.col(lo)).cast("decimal(20,8)").alias("_range"),
    ).where("_feed is not null and _id is not null and _t is not null")


def candle_readings(candles: DataFrame, tab: str = "candles") -> DataFrame:
    o, h, lo, c = (F.col(x) for x in ("open_px", "high_px", "low_px", "close_px"))
    return readings(
        candles,
        tab,
        rec_id="candle_id",
        feed="feed_id",
        time_us=F.unix_micros(F.col("ts").cast("timestamp")),
        hi="high_px",
        lo="low_px",
        level=c,
        impossible=_any(h <= 0, lo <= 0, h < o, h < c, h < lo, lo > o, lo > c),
    )


def group_readings(groups: DataFrame, tab: str = "quote_groups") -> DataFrame:
    bid, ask = F.col("bid_min"), F.col("ask_max")
    return readings(
        groups,
        tab,
        rec_id="group_id",
        feed="feed_id",
        time_us=F.col("ts_ms") * 1000,
        hi="ask_max",
        lo="bid_min",
        level=(bid + ask) / 2,
        impossible=_any(bid <= 0, ask <= 0, ask < bid),
    )


def _any(*conditions: Column) -> Column:
    """True where one holds; comparisons with null prices are not judged."""
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def typical_range(rows: DataFrame) -> DataFrame:
    """``(_tab, _feed, _scale)``: the exact median of the range, from a histogram per feed that is combined before it is shuffled."""
    hist = rows.where("_range is not null").groupBy("_tab", "_feed", "_range").agg(F.count("*").alias("_c"))
    return hist.groupBy("_tab", "_feed").agg(F.expr("percentile(cast(_range as double), 0.5, _c)").alias("_scale"))


def implausible(rows: DataFrame, cfg: FaultConfig = FaultConfig(), *, pairwise: tuple[str, ...] = ("quote_groups",), least: dict[str, int] | None = None) -> DataFrame:
    """``(tab, rec_id, impossible, stuck, spike)``: every faulty row of the common form, flagged.

    Each (tab, feed) is judged by its own median range. Impossible rows are found by bounds;
    stuck ones by runs of zero difference of at least ``least[tab]`` stamps (of either value,
    or of the pair for ``pairwise`` tabs); spikes by phase-space thresholding, followed by the
    exact rule of distances to the levels before and after.

    Defined cases: null prices are not judged and no level; rows at one stamp are each judged,
    repeated rows alike; a feed whose median range is zero or unknown has no spikes; empty
    tables give no rows; texts and other columns are not read.

    Distribution: ranked chunks (see ``stamp_chunks``) bound what a task holds whatever the
    feed's length; the halo is far longer than the stuck runs and spikes it has to show.
    """
    least = least or {"candles": 10, "quote_groups": 20}
    scale = typical_range(rows)
    chunks = stamp_chunks(rows.drop("_range"), ["_tab", "_feed"], "_t", width=DAY_S * US, chunk=cfg.chunk, halo=cfg.halo, carry=scale)
    slim = chunks.select("_tab", "_feed", "_chunk", "_rank", "_id", "_own", "_hi", "_lo", "_hi_i", "_lo_i", "_level", "_bad", "_scale")
    found = slim.groupBy("_tab", "_feed", "_chunk").applyInArrow(_judge(cfg, set(pairwise), least), RESULT)
    bit = lambda b: F.col("_bits").bitwiseAND(b) > 0
    return found.select(F.col("_tab").alias("tab"), F.col("_id").alias("rec_id"), bit(IMPOSSIBLE).alias("impossible"), bit(STUCK).alias("stuck"), bit(SPIKE).alias("spike"))
