"""Capture corrections: time stamp repair, frame drop and insert, rate control; the same state machine in batch and streaming.

What to drop depends on how many frames were written before, so each stream is
followed in order by one state of a few numbers, in one task; streams run in
parallel. A single endless stream belongs into the streaming form, whose state
goes from batch to batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

WRAP_31, WRAP_32 = 1 << 31, 1 << 32
OUT = "stream long, seq long, ts_us long, action string, inserted int, written long"


def repair_timestamps(packets: DataFrame, by: str = "stream", order: str = "seq") -> DataFrame:
    """ts_us without the jumps of a 31- or 32-bit microsecond counter that wrapped."""
    w = Window.partitionBy(by).orderBy(order)
    last = F.lag("ts_us").over(w)
    bias = F.when(last >= 4_285_000_000, F.lit(WRAP_32)).otherwise(F.lit(WRAP_31))
    wrapped = (F.col("ts_us") < last) & (F.col("ts_us") < 10_000_000) & (last >= 2_138_000_000) & (F.abs(F.col("ts_us") + bias - last) <= 5_000_000)
    jump = packets.withColumn("jump_", F.when(wrapped, bias).otherwise(F.lit(0)))
    return jump.withColumn("ts_us", F.col("ts_us") + F.sum("jump_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("jump_")


@dataclass
class Resync:
    """Drops a frame that comes three quarters of a frame early, inserts as many as are missing when one comes late."""

    rate: float
    limit: int = 10
    written: int = 0
    drops: bool = True
    inserts: bool = True

    def step(self, ts_us: int) -> tuple[str, int]:
        """(keep, drop or insert; how many frames are inserted before this one)."""
        error = ts_us * self.rate / 1e6 - self.written
        if error < -0.75 and self.drops:
            return "drop", 0
        extra = min(int(error + 0.5), self.limit) if error > 0.75 and self.written > 0 and self.inserts else 0
        self.written += 1 + extra
        return ("insert", extra) if extra else ("keep", 0)


def _follow(state: Resync, rows: pd.DataFrame) -> pd.DataFrame:
    actions, inserted, written = [], [], []
    for ts_us in rows["ts_us"].to_numpy().tolist():
        action, extra = state.step(ts_us)
        actions.append(action)
        inserted.append(extra)
        written.append(state.written)
    return pd.DataFrame({"stream": rows["stream"], "seq": rows["seq"], "ts_us": rows["ts_us"], "action": actions, "inserted": inserted, "written": written})


def resync(packets: DataFrame, rate: float, limit: int = 10, drops: bool = True, inserts: bool = True) -> DataFrame:
    """Packets (stream, seq, ts_us) with what becomes of each, in order of seq; drops and inserts turn either correction on."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _follow(Resync(rate, limit, 0, drops, inserts), rows.sort_values("seq"))

    return packets.select("stream", "seq", "ts_us").groupBy("stream").applyInPandas(run, OUT)


def resync_stream(packets: DataFrame, rate: float, limit: int = 10) -> DataFrame:
    """The same on a streaming DataFrame; the state survives between batches, rows of a batch go by seq."""
    def run(key: tuple, parts: Iterator[pd.DataFrame], kept: Any) -> Iterator[pd.DataFrame]:
        state = Resync(rate, limit, kept.get[0] if kept.exists else 0)
        rows = pd.concat(list(parts)).sort_values("seq")
        out = _follow(state, rows)
        kept.update((state.written,))
        yield out

    return packets.select("stream", "seq", "ts_us").groupBy("stream").applyInPandasWithState(run, OUT, "written long", "append", "NoTimeout")


@dataclass
class Controller:
    """A PI controller of the audio rate with a smoothed input, hysteresis and limited output."""

    gain: float = -0.05
    integral_gain: float = -0.005
    smoothing: float = 32.0
    dead_zone: float = 0.0
    most: float = 0.1
    level: float = 0.0
    total: float = 0.0

    def step(self, error: float) -> float:
        self.level += (error - self.level) / self.smoothing
        e = self.level if abs(self.level) > self.dead_zone else 0.0
        raw = self.gain * e + self.integral_gain * (self.total + e)
        if abs(raw) < self.most:  # no winding up at the limit
            self.total += e
        return max(-self.most, min(self.most, raw))


def control(errors: DataFrame, by: str = "stream", order: str = "seq", **settings) -> DataFrame:
    """(stream, seq, correction) from (stream, seq, error), each stream by its own controller."""
    start = asdict(Controller(**settings))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        c = Controller(**start)
        return pd.DataFrame({"stream": rows["stream"], "seq": rows["seq"], "correction": [c.step(e) for e in rows["error"]]})

    return errors.select(F.col(by).alias("stream"), F.col(order).alias("seq"), "error").groupBy("stream").applyInPandas(run, "stream long, seq long, correction double")


def summaries(packets: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None, gap: str | None = None) -> DataFrame:
    """Packets and bytes by kind and window of event time, for batch or stream (ts: time stamp); late rows beyond the watermark are left out.

    Windows tumble, slide by `slide`, or with `gap` are sessions that so long a silence ends.
    """
    windows = F.session_window("ts", gap) if gap else F.window("ts", width, slide)
    return packets.withWatermark("ts", late).groupBy(windows.alias("window"), "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
