"""Audio: sample formats and mixes as Column expressions, filters with memory as NumPy kernels over blocks.

Samples are rows (pos, l, r) of 16-bit values. Kernels get blocks of consecutive
positions with as many neighbours as they look at, so a stream of any length is
shared by many tasks; silence lies beyond its ends.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip16(v: Column) -> Column:
    return F.greatest(F.lit(-32768), F.least(F.lit(32767), v))


# --- formats: 8-bit samples are unsigned around 128, 16-bit ones signed -----------


def to_16(v8: Column) -> Column:
    return (v8 - 128) * 256


def to_8(v16: Column) -> Column:
    return F.shiftright(v16 + 0x8000, 8)


def mono_16(left: Column, right: Column) -> Column:
    return F.shiftright(left + right, 1)


def mono_8(left: Column, right: Column) -> Column:
    return F.shiftright(left + right, 1)


def mono_16_to_8(left: Column, right: Column) -> Column:
    return F.shiftright(left + right + 0x10000, 9)


def float_to_16(v: Column) -> Column:
    return clip16(F.floor(v * 32768 + 0.5)).cast("int")


def x_law_table(kind: str) -> list[int]:
    """16-bit values of the 256 codes of G.711, from its segment rule."""
    out = []
    for code in range(256):
        if kind == "mu":
            c = ~code & 0xFF
            v = (((c & 15) << 3) + 132 << ((c >> 4) & 7)) - 132
            out.append(-v if c & 0x80 else v)
        else:
            c = code ^ 0x55
            segment, mantissa = (c >> 4) & 7, (c & 15) << 4
            v = mantissa + 8 if segment == 0 else mantissa + 0x108 << segment - 1
            out.append(v if c & 0x80 else -v)
    return out


def decode_x_law(code: Column, kind: str) -> Column:
    return F.element_at(F.array(*map(F.lit, x_law_table(kind))), code + 1)


# --- memoryless filters ----------------------------------------------------


def gain(v: Column, ratio: float) -> Column:
    scale = int(np.floor(0.5 + ratio * 65536) + 128) >> 8
    return clip16(F.shiftright((v + 0x8000 - 0x8000) * scale + 0x80, 8))


def amplify_16(v: Column, factor: float) -> Column:
    f = int(factor * 256 + 0.5)
    return clip16(F.shiftright(v * f + 0x80, 8))


def amplify_8(v: Column, factor: float) -> Column:
    f = int(factor * 256 + 0.5)
    return F.greatest(F.lit(0), F.least(F.lit(255), F.shiftright(v * f + 0x8080 - 0x80 * f, 8)))


def mix(a: DataFrame, b: DataFrame) -> DataFrame:
    """Saturating sum by position; where one has ended, the other goes on alone."""
    zero = F.lit(0)
    b = b.select("pos", F.col("l").alias("l_"), F.col("r").alias("r_"))
    both = a.select("pos", "l", "r").join(b, "pos", "full_outer")
    return both.select("pos", *(clip16(F.coalesce(c, zero) + F.coalesce(f"{c}_", zero)).alias(c) for c in ("l", "r")))


def butterfly(left: Column, right: Column) -> tuple[Column, Column]:
    return F.shiftright(left + right, 1), F.shiftright(left - right, 1)


def stereo_split(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    return samples.select("pos", F.col("l").alias("v")), samples.select("pos", F.col("r").alias("v"))


def stereo_merge(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("pos", F.col("v").alias("l")).join(right.select("pos", F.col("v").alias("r")), "pos")


def center_mix(stereo: DataFrame, center: DataFrame) -> DataFrame:
    joined = stereo.join(center.select("pos", F.col("v").alias("c_")), "pos")
    return joined.select("pos", *(clip16(F.col(c) + F.col("c_")).alias(c) for c in ("l", "r")))


# --- filters with memory ---------------------------------------------------

Signal = np.ndarray  # (samples, 2)


def over_samples(samples: DataFrame, kernel: Callable[[Signal, int, int, int], Signal], before: int, after: int, block: int = 65_536) -> DataFrame:
    """(pos, l, r) by kernel(signal, start, stop, first): values for signal[start:stop], which begins at position `first`.

    Samples must be numbered without gaps; each block finds its ends in its own rows.
    """
    homes = F.sequence(F.floor((F.col("pos") - after) / block), F.floor((F.col("pos") + before) / block))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pos = table.column("pos").to_numpy()
        own = pos[pos // block == key[0].as_py()]
        if not len(own):
            return pa.table({"pos": pa.array([], pa.int64()), "l": pa.array([], pa.int32()), "r": pa.array([], pa.int32())})
        first, end = int(own.min()), int(own.max()) + 1
        signal = np.zeros((end - first + before + after, 2), np.int64)
        at = pos - first + before
        near = (at >= 0) & (at < len(signal))
        signal[at[near]] = np.column_stack((table.column("l").to_numpy(), table.column("r").to_numpy()))[near]
        out = np.clip(kernel(signal, before, before + end - first, first), -32768, 32767)
        return pa.table({"pos": pa.array(np.arange(first, end)), "l": pa.array(out[:, 0].astype(np.int32)), "r": pa.array(out[:, 1].astype(np.int32))})

    return samples.select("pos", "l", "r", F.explode(homes).alias("block_")).groupBy("block_").applyInArrow(run, "pos long, l int, r int")


def fir_taps(cutoff: float, rate: int, half: int, high: bool) -> np.ndarray:
    """Symmetric windowed-sinc taps in 1/16384; a high pass is a unit pulse less the low pass."""
    half = max(8, min(16384, half))
    c = max(0.0, min(1.0, 2 * cutoff / rate))
    n = np.arange(-half, half + 1)
    window = 0.42 + 0.5 * np.cos(np.pi * n / (half + 1)) + 0.08 * np.cos(2 * np.pi * n / (half + 1))
    h = c * np.sinc(c * n) * window
    h /= h.sum() or 1
    if high:
        h = -h
        h[half] += 1
    return np.floor(0.5 + h * 16384).astype(np.int64)


def fir(samples: DataFrame, taps: np.ndarray, **how) -> DataFrame:
    half = len(taps) // 2

    def run(signal: Signal, start: int, stop: int, first: int) -> Signal:
        return np.column_stack([np.convolve(signal[start - half : stop + half, k], taps, "valid") + 0x2000 >> 14 for k in (0, 1)])

    return over_samples(samples, run, half, half, **how)


def low_pass(samples: DataFrame, cutoff: float, rate: int = 44_100, half: int = 32, **how) -> DataFrame:
    return fir(samples, fir_taps(cutoff, rate, half, False), **how)


def high_pass(samples: DataFrame, cutoff: float, rate: int = 44_100, half: int = 32, **how) -> DataFrame:
    return fir(samples, fir_taps(cutoff, rate, half, True), **how)


def chorus(samples: DataFrame, rate: int = 44_100, **how) -> DataFrame:
    """Half of a copy delayed by 25 ms and a sine of 1 ms at 0.3 Hz (90 degrees on in the right channel), interpolated linearly."""
    center, swing = rate * 25 // 1000 * 256, rate * 1 // 1000 * 256
    step = int(2**32 * 0.3 / rate)
    reach = (center + swing) // 256 + 2

    def run(signal: Signal, start: int, stop: int, first: int) -> Signal:
        out = signal[start:stop].copy()
        for k in (0, 1):
            phase = (np.arange(first, first + stop - start) * step + k * 0x40000000) % 2**32
            delay = (center + swing * np.sin(phase * (np.pi / 2**31))).astype(np.int64)
            whole, part = delay >> 8, delay & 255
            at = np.arange(start, stop) - whole
            x1, x2 = signal[at, k], signal[at + 1, k]
            out[:, k] += x1 + ((x2 - x1) * part + 128 >> 8) >> 1
        return out

    return over_samples(samples, run, reach, 0, **how)


def polyphase_bank(cutoff: float, half: int, phases: int = 256) -> np.ndarray:
    """(phases, 2 * half) windowed-sinc taps, each phase summing to 1."""
    n = np.arange(-half + 1, half + 1)[None, :] - np.arange(phases)[:, None] / phases
    window = 0.42 + 0.5 * np.cos(np.pi * n / half) + 0.08 * np.cos(2 * np.pi * n / half)
    h = np.sinc(n * cutoff) * np.where(np.abs(n) <= half, window, 0)
    return h / h.sum(axis=1, keepdims=True)


def limit(samples: DataFrame, n: int) -> DataFrame:
    """The first n samples, by position, so that every run gives the same."""
    return samples.where(F.col("pos") < n)


def new_rate(samples: DataFrame, old: int, new: int) -> DataFrame:
    """The same samples at another rate: (pos, before, seconds, l, r), when each sounded and when it sounds now."""
    return samples.select("pos", (F.col("pos") / old).alias("before"), (F.col("pos") / new).alias("seconds"), "l", "r")


def _bounds(samples: DataFrame, bounds: tuple[int, int] | None) -> tuple[int, int]:
    """First position and number of samples: as given, else counted, which computes what samples are made of."""
    if bounds is None:
        ends = samples.agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).first()
        bounds = (0, 0) if ends["hi"] is None else (ends["lo"], ends["hi"] - ends["lo"] + 1)
    return bounds


def resample(samples: DataFrame, ratio: float, half: int = 16, block: int = 65_536, bounds: tuple[int, int] | None = None) -> DataFrame:
    """round(n * ratio) samples in place of n, through a polyphase low pass; output positions are dealt out in blocks. bounds: first position and n, if known."""
    lo, n = _bounds(samples, bounds)
    total = int(n * ratio + 0.5)
    bank = polyphase_bank(min(1.0, ratio), half)
    span = block / ratio  # source samples of an output block
    place = F.col("pos") - lo
    homes = F.sequence(F.floor((place - half - 1) / span), F.floor((place + half + 1) / span))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        first, end = max(0, key[0].as_py() * block), min(total, (key[0].as_py() + 1) * block)
        wanted = np.arange(first, max(first, end))
        source = np.floor(wanted / ratio * 256 + 0.5).astype(np.int64)
        at, phase = source >> 8, source & 255
        base = (at[0] if len(at) else 0) - half
        signal = np.zeros(((at[-1] - base if len(at) else 0) + 2 * half + 2, 2))
        pos = table.column("pos").to_numpy() - lo - base
        ok = (pos >= 0) & (pos < len(signal))
        signal[pos[ok]] = np.column_stack((table.column("l").to_numpy(), table.column("r").to_numpy()))[ok]
        rows = at[:, None] - base + np.arange(-half + 1, half + 1)[None, :]
        out = np.clip(np.floor(np.einsum("nt,ntk->nk", bank[phase], signal[rows]) + 0.5), -32768, 32767).astype(np.int32) if len(at) else np.zeros((0, 2), np.int32)
        return pa.table({"pos": pa.array(wanted), "l": pa.array(out[:, 0]), "r": pa.array(out[:, 1])})

    return samples.select("pos", "l", "r", F.explode(homes).alias("block_")).groupBy("block_").applyInArrow(run, "pos long, l int, r int")


def center_cut(samples: DataFrame, window: int = 8192, hop: int = 1024, block: int = 65_536) -> DataFrame:
    """(pos, l, r, c): what both channels share, by phase in overlapping spectra, taken out of the sides."""
    shape = np.hanning(window + 1)[:window]
    scale = hop / (shape**2).sum()

    def center(signal: Signal, start: int, stop: int, first: int) -> np.ndarray:
        out = np.zeros(len(signal))
        for at in range((-(first - start)) % hop, len(signal) - window + 1, hop):
            spectra = np.fft.rfft(signal[at : at + window] * shape[:, None], axis=0)
            both, side = spectra.sum(axis=1), spectra[:, 0] - spectra[:, 1]
            power = np.abs(both) ** 2
            alpha = np.where(power > 1e-10, 0.5 - 0.5 * np.sqrt(np.abs(side) ** 2 / np.maximum(power, 1e-10)), 0)
            out[at : at + window] += np.fft.irfft(both * np.maximum(alpha, 0), window) * shape * scale
        return np.floor(out[start:stop] + 0.5)

    middle = over_samples(samples, lambda s, a, b, f: np.repeat(center(s, a, b, f)[:, None], 2, axis=1), window, window, block=block)
    joined = samples.join(middle.select("pos", F.col("l").alias("c")), "pos")
    return joined.select("pos", clip16(F.col("l") - F.col("c")).alias("l"), clip16(F.col("r") - F.col("c")).alias("r"), "c")


def time_stretch(samples: DataFrame, ratio: float, window: int = 2048, search: int = 256, bounds: tuple[int, int] | None = None) -> DataFrame:
    """n * ratio samples of unchanged pitch: overlapped windows, each moved to where it fits the last best.

    Every window depends on the one before, so a block of 2**18 samples starts
    anew from its own nominal place and joins its neighbours by the cross-fade.
    """
    hop = window // 2
    block = 1 << 18
    fade = np.arange(hop)[:, None] / hop
    n = sum(_bounds(samples, bounds))
    total = int(n * ratio + 0.5)
    span = block / ratio
    reach = window + search + hop
    homes = F.sequence(F.floor((F.col("pos") - reach) / span), F.floor((F.col("pos") + reach) / span))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        first, end = max(0, key[0].as_py() * block), min(total, (key[0].as_py() + 1) * block)
        if first >= end:
            return pa.table({"pos": pa.array([], pa.int64()), "l": pa.array([], pa.int32()), "r": pa.array([], pa.int32())})
        base = int(first / ratio) - reach
        signal = np.zeros((int((end - first) / ratio) + 3 * reach + window, 2))
        pos = table.column("pos").to_numpy() - base
        ok = (pos >= 0) & (pos < len(signal))
        signal[pos[ok]] = np.column_stack((table.column("l").to_numpy(), table.column("r").to_numpy()))[ok]
        out, tail = [], None
        for at in range(first, end, hop):
            nominal = int(at / ratio) - base
            best = nominal
            if tail is not None:
                probe = tail[:, 0]
                around = np.lib.stride_tricks.sliding_window_view(signal[nominal - search : nominal + search + hop, 0], hop)
                best = nominal - search + int(np.argmin(((around - probe) ** 2).sum(axis=1)))
            piece = signal[best : best + window]
            out.append(piece[:hop] if tail is None else tail * (1 - fade) + piece[:hop] * fade)
            tail = piece[hop:]
        values = np.clip(np.floor(np.concatenate(out)[: end - first] + 0.5), -32768, 32767).astype(np.int32)
        return pa.table({"pos": pa.array(np.arange(first, end)), "l": pa.array(values[:, 0]), "r": pa.array(values[:, 1])})

    return samples.select("pos", "l", "r", F.explode(homes).alias("block_")).groupBy("block_").applyInArrow(run, "pos long, l int, r int")


def pitch_shift(samples: DataFrame, ratio: float, bounds: tuple[int, int] | None = None) -> DataFrame:
    """The same length at another pitch: stretched, then resampled back."""
    lo, n = _bounds(samples, bounds)
    return resample(time_stretch(samples, ratio, bounds=(lo, n)), 1 / ratio, bounds=(0, int((lo + n) * ratio + 0.5)))


def subset(samples: DataFrame, timeline: DataFrame, samples_per_frame: float, cell: int = 65_536) -> DataFrame:
    """Samples that a video timeline's spans select, in its order; each span's ends are rounded so that the error never adds up.

    A range join on cells of `cell` samples: a span is listed under every cell that it touches.
    """
    from framelake.plans.timeline import placed

    ends = placed(timeline).select(
        F.floor(F.col("start") * samples_per_frame + 0.5).cast("long").alias("src0"),
        F.floor(F.col("dst0") * samples_per_frame + 0.5).cast("long").alias("out0"),
        F.floor((F.col("dst0") + F.col("len")) * samples_per_frame + 0.5).cast("long").alias("out1"),
        "masked",
    )
    last = F.col("src0") + F.col("out1") - F.col("out0") - 1
    ends = ends.where("out1 > out0").withColumn("cell_", F.explode(F.sequence(F.floor(F.col("src0") / cell), F.floor(last / cell))))
    asked = samples.withColumn("cell_", F.floor(F.col("pos") / cell))
    joined = asked.join(ends, "cell_").where(F.col("pos").between(F.col("src0"), last))
    quiet = lambda c: F.when(F.col("masked"), 0).otherwise(F.col(c)).alias(c)
    return joined.select((F.col("pos") - F.col("src0") + F.col("out0")).alias("pos"), quiet("l"), quiet("r"))


# --- graphs ----------------------------------------------------------------


class AudioGraph:
    """Filters with numbered pins wired into a graph without cycles; running it composes DataFrames."""

    def __init__(self):
        self.filters: list[tuple[str, Callable]] = []
        self.wires: dict[tuple[int, int], tuple[int, int]] = {}  # (filter, input pin) -> (filter, output pin)

    def add(self, name: str, run: Callable[..., DataFrame | tuple[DataFrame, ...]]) -> int:
        self.filters.append((name, run))
        return len(self.filters) - 1

    def connect(self, source: int, source_pin: int, target: int, target_pin: int) -> None:
        if (target, target_pin) in self.wires:
            raise ValueError(f"pin {target_pin} of {self.filters[target][0]} is connected already")
        self.wires[target, target_pin] = source, source_pin

    def disconnect(self, target: int, target_pin: int) -> None:
        del self.wires[target, target_pin]

    def order(self) -> list[int]:
        """Filters after all that feed them."""
        done: dict[int, bool] = {}
        out: list[int] = []

        def visit(i: int) -> None:
            if i in done:
                if not done[i]:
                    raise ValueError(f"a cycle runs through {self.filters[i][0]}")
                return
            done[i] = False
            for (target, _), (source, _) in sorted(self.wires.items()):
                if target == i:
                    visit(source)
            done[i] = True
            out.append(i)

        for i in range(len(self.filters)):
            visit(i)
        return out

    def run(self) -> dict[int, tuple[DataFrame, ...]]:
        results: dict[int, tuple[DataFrame, ...]] = {}
        for i in self.order():
            pins = sorted(pin for target, pin in self.wires if target == i)
            found = self.filters[i][1](*(results[self.wires[i, p][0]][self.wires[i, p][1]] for p in pins))
            results[i] = found if isinstance(found, tuple) else (found,)
        return results
