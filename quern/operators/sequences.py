"""Runs in ordered series, filters, hidden states, periodograms, superposition and orbit geometry."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators.order import row_numbers
from quern.registry import operator


@operator("W14", group="sequences")
def run_lengths(df: DataFrame, by: list[str], place: str, state: str, least_rows: int = 2) -> DataFrame:
    """Regions of equal state along each group: (group, state, first, last, n, region), numbered over all groups.

    Groups of fewer rows than least_rows are left out. Gaps and islands by two row numbers.
    """
    own = W.partitionBy(*by)
    marked = df.withColumn("__size", F.count("*").over(own)).where(F.col("__size") >= least_rows)
    island = F.row_number().over(own.orderBy(place)) - F.row_number().over(W.partitionBy(*by, state).orderBy(place))
    runs = marked.withColumn("__i", island).groupBy(*by, state, "__i").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    return row_numbers(runs.drop("__i"), [*[F.col(c).asc() for c in by], F.col("first").asc()], "region")


@operator("W13", "S1", group="sequences")
def season_length(series: DataFrame, key: str, threshold: float, window: int = 6, mid: str = "07-01") -> DataFrame:
    """By key and year of a daily series (key, day, value): days from the first run of `window` days at or above the threshold
    that begins before `mid`, to the first run of as many days below it at or after `mid`; else to the end of the year."""
    own = W.partitionBy(key, "year")
    days = series.withColumn("year", F.year("day")).withColumn("warm", F.col("value") >= threshold).withColumn("i", F.row_number().over(own.orderBy("day")))
    ahead = own.orderBy("day").rowsBetween(0, window - 1)
    days = days.withColumn("full", F.count("*").over(ahead) == window).withColumn("up", F.col("full") & (F.min(F.col("warm").cast("int")).over(ahead) == 1)).withColumn("down", F.col("full") & (F.max(F.col("warm").cast("int")).over(ahead) == 0))
    late = F.date_format("day", "MM-dd") >= mid
    found = days.groupBy(key, "year").agg(F.min(F.when(F.col("up") & ~late, F.col("i"))).alias("start"), F.min(F.when(F.col("down") & late, F.col("i"))).alias("stop"), F.max("i").alias("n"))
    return found.select(key, "year", F.when(F.col("start").isNull(), 0).otherwise(F.coalesce("stop", F.col("n") + 1) - F.col("start")).cast("long").alias("length"))


def _butterworth(low: float, high: float, rate: float, corners: int) -> list[tuple[float, ...]]:
    """Second-order sections (b0, b1, b2, a1, a2) of a bandpass, or a highpass where high reaches half the rate."""
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    poles = np.exp(1j * np.pi * (2 * np.arange(1, corners + 1) + corners - 1) / (2 * corners))
    nyquist = rate / 2
    if high / nyquist > 1 - 1e-6:
        s = warp(low) / poles
        zeros, gain = np.zeros(len(s)), 1.0
    else:
        w0, band = np.sqrt(warp(low) * warp(high)), warp(high) - warp(low)
        half = poles * band / 2
        root = np.sqrt(half**2 - w0**2)
        s = np.concatenate([half + root, half - root])
        zeros, gain = np.zeros(corners), band**corners
    z = (2 * rate + s) / (2 * rate - s)
    gain = gain * np.real(np.prod(2 * rate - zeros) / np.prod(2 * rate - s))
    ones = [1.0] * len(zeros)
    minus = [-1.0] * (len(z) - len(zeros))
    pairs = sorted((p for p in z if p.imag > 1e-12), key=lambda p: abs(p))
    reals = sorted(p.real for p in z if abs(p.imag) <= 1e-12)
    tops = sorted([*ones, *minus])
    sections = []
    dens = [(-2 * p.real, abs(p) ** 2) for p in pairs] + [(-(reals[i] + reals[i + 1]), reals[i] * reals[i + 1]) if i + 1 < len(reals) else (-reals[i], 0.0) for i in range(0, len(reals), 2)]
    for k, (a1, a2) in enumerate(dens):
        own = ([tops[k], tops[-1 - k]] if 2 * k < len(tops) - 1 else [tops[k]]) if a2 else [tops[k]]
        num = np.poly(own)
        num = np.concatenate([num, np.zeros(3 - len(num))])
        sections.append((*(num * (gain if not k else 1.0)), a1, a2))
    return sections


def _run_sections(x: np.ndarray, sections: list[tuple[float, ...]]) -> np.ndarray:
    for b0, b1, b2, a1, a2 in sections:
        y, s1, s2 = np.empty_like(x), 0.0, 0.0
        for i, v in enumerate(x.tolist()):
            o = b0 * v + s1
            s1 = b1 * v - a1 * o + s2
            s2 = b2 * v - a2 * o
            y[i] = o
        x = y
    return x


@operator("S2", group="sequences")
def bandpass(traces: DataFrame, rate: float, low: float, high: float, corners: int = 4, zero_phase: bool = False) -> DataFrame:
    """Butterworth bandpass of each trace (trace_id, samples). One row is one trace; traces are filtered apart from each other."""
    sections = _butterworth(low, high, rate, corners)

    def run(frames):
        for f in frames:
            out = []
            for x in f["samples"]:
                y = _run_sections(np.asarray(x, float), sections)
                out.append((_run_sections(y[::-1], sections)[::-1] if zero_phase else y).tolist())
            yield pd.DataFrame({"trace_id": f["trace_id"], "samples": out})

    return traces.select("trace_id", "samples").mapInPandas(run, "trace_id long, samples array<double>")


@operator("S3", group="sequences")
def box_least_squares(curve: DataFrame, periods: list[float], duration: float, bins: int = 50) -> DataFrame:
    """By curve and period: the depth, its signal to noise and the phase of the best box of `duration` in the folded curve.

    curve: (curve_id, t, y, dy). Points are summed into phase bins before the shuffle; a box is a running sum over bins.
    """
    every = curve.select("curve_id", "t", "y", (1 / (F.col("dy") * F.col("dy"))).alias("w"), F.explode(F.array(*map(F.lit, periods))).alias("period"))
    phase = F.floor(F.pmod(F.col("t"), F.col("period")) / F.col("period") * bins)
    folded = every.groupBy("curve_id", "period", phase.alias("bin")).agg(F.sum(F.col("w") * F.col("y")).alias("wy"), F.sum("w").alias("w"))
    own = W.partitionBy("curve_id", "period")
    wide = F.greatest(F.lit(1), F.round(F.lit(duration) / F.col("period") * bins)).cast("int")
    total = folded.withColumn("all_wy", F.sum("wy").over(own)).withColumn("all_w", F.sum("w").over(own)).withColumn("wide", wide)
    # A bin counts in every box that starts up to `wide` bins before it.
    boxes = total.withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), F.col("wide") - 1), lambda i: F.pmod(F.col("bin") - i, F.lit(bins))))).groupBy("curve_id", "period", "start", "all_wy", "all_w").agg(F.sum("wy").alias("in_wy"), F.sum("w").alias("in_w"))
    inside, rest = F.col("in_wy") / F.col("in_w"), F.col("all_w") - F.col("in_w")
    depth = (F.col("all_wy") - F.col("in_wy")) / rest - inside
    scored = boxes.where(rest > 0).withColumn("depth", depth).withColumn("snr", F.col("depth") / F.sqrt(1 / F.col("in_w") + 1 / rest))
    return scored.groupBy("curve_id", "period").agg(F.max_by("depth", F.struct("snr", -F.col("start"))).alias("depth"), F.max("snr").alias("snr"), F.max_by(F.col("start") / bins, F.struct("snr", -F.col("start"))).alias("phase"))


@operator("E29", group="sequences")
def viterbi(series: DataFrame, means: list[float], sd: float, stay: float = 0.99, neutral: int = 3) -> DataFrame:
    """The likeliest states (1, 2, ...) along each series (series_id, place, value) under normal emissions, scored by the tail
    beyond the value. A series of one place is neutral. Series are independent; one must fit a task."""
    n = len(means)
    move = np.full((n, n), np.log((1 - stay) / max(n - 1, 1)))
    np.fill_diagonal(move, np.log(stay))

    def run(key, f):
        f = f.sort_values("place")
        if len(f) < 2:
            return pd.DataFrame({"series_id": f["series_id"], "place": f["place"], "state": neutral})
        from math import erfc

        x = f["value"].to_numpy()
        tail = np.array([[max(0.5 * erfc(abs(v - m) / sd / 2**0.5), 1e-300) for m in means] for v in x])
        score = np.log(tail / tail.sum(1, keepdims=True))
        best, back = score[0] + np.log(1 / n), np.zeros((len(x), n), int)
        for i in range(1, len(x)):
            ways = best[:, None] + move
            back[i] = ways.argmax(0)
            best = ways.max(0) + score[i]
        state = [int(best.argmax())]
        for i in range(len(x) - 1, 0, -1):
            state.append(int(back[i, state[-1]]))
        return pd.DataFrame({"series_id": f["series_id"], "place": f["place"], "state": [s + 1 for s in reversed(state)]})

    return series.groupBy("series_id").applyInPandas(run, "series_id long, place long, state int")


@operator("S5", group="sequences")
def superposed_rmsd(frames: DataFrame, reference: DataFrame) -> DataFrame:
    """By frame of (frame, atom, x, y, z): the least RMSD to the reference (atom, x, y, z) over rotations, both centred.

    Nine products, centres and squares are aggregated by frame; only these 16 numbers reach the solver.
    """
    ref = reference.select("atom", *[F.col(c).alias(f"r{c}") for c in "xyz"])
    sums = [F.sum(F.col(a) * F.col(f"r{b}")).alias(f"{a}{b}") for a in "xyz" for b in "xyz"]
    sums += [F.sum(c).alias(f"s_{c}") for c in ("x", "y", "z", "rx", "ry", "rz")] + [F.sum(sum((F.col(c) * F.col(c) for c in ("x", "y", "z", "rx", "ry", "rz")), F.lit(0.0))).alias("sq"), F.count("*").alias("n")]
    got = frames.join(F.broadcast(ref), "atom").groupBy("frame").agg(*sums)

    def run(parts):
        for f in parts:
            out = []
            for row in f.itertuples(index=False):
                h = np.array([[getattr(row, a + b) for b in "xyz"] for a in "xyz"])
                p, q = np.array([row.s_x, row.s_y, row.s_z]), np.array([row.s_rx, row.s_ry, row.s_rz])
                h -= np.outer(p, q) / row.n
                sq = row.sq - (p @ p + q @ q) / row.n
                s = np.linalg.svd(h, compute_uv=False)
                s[2] *= np.sign(np.linalg.det(h)) or 1.0
                out.append(np.sqrt(max(0.0, (sq - 2 * s.sum()) / row.n)))
            yield pd.DataFrame({"frame": f["frame"], "rmsd": out})

    return got.mapInPandas(run, "frame long, rmsd double")


@operator("S7", group="sequences")
def tensor_fit(voxels: DataFrame, design: list[list[float]]) -> DataFrame:
    """Weighted least squares of log signals on a design (constant last) by voxel: fractional anisotropy and mean diffusivity.

    design rows: -xx, -yy, -zz, -2xy, -2xz, -2yz of a gradient, and 1; voxels: (voxel_id, signal array).
    """
    x = np.asarray(design, float)

    def run(parts):
        for f in parts:
            y = np.log(np.maximum(np.stack(f["signal"].to_numpy()).astype(float), 1e-6))
            first = y @ np.linalg.pinv(x).T
            w = np.exp(2 * first @ x.T)
            a = np.einsum("vi,ij,ik->vjk", w, x, x)
            beta = np.linalg.solve(a, np.einsum("vi,ij,vi->vj", w, x, y)[..., None])[..., 0]
            d = beta[:, [0, 3, 4, 3, 1, 5, 4, 5, 2]].reshape(-1, 3, 3)
            e = np.maximum(np.linalg.eigvalsh(d), 1e-12)
            md = e.mean(1)
            fa = np.sqrt(1.5 * ((e - md[:, None]) ** 2).sum(1) / (e**2).sum(1))
            yield pd.DataFrame({"voxel_id": f["voxel_id"], "fa": fa, "md": md})

    return voxels.select("voxel_id", "signal").mapInPandas(run, "voxel_id long, fa double, md double")


def horner(coefficients: Column, x: Column) -> Column:
    """A polynomial with the lowest power first."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda s, c: s * x + c)


@operator("M25", group="sequences")
def orbit_at(times: DataFrame, coefficients: dict[str, list[float]]) -> DataFrame:
    """Position, velocity and acceleration by axis at times t, from polynomials."""
    cols = []
    for axis, c in coefficients.items():
        v = [i * a for i, a in enumerate(c)][1:] or [0.0]
        w = [i * a for i, a in enumerate(v)][1:] or [0.0]
        cols += [horner(F.array(*map(F.lit, k)), F.col("t")).alias(f"{name}_{axis}") for name, k in (("p", c), ("v", v), ("a", w))]
    return times.select("t", *cols)


@operator("M24", group="sequences")
def ground_range(points: DataFrame, epochs: DataFrame) -> DataFrame:
    """points (point_id, azimuth, slant) by polynomials in slant range whose coefficients are interpolated between epochs
    (azimuth, origin, coefficients); null outside the first and last epoch. An as-of join by one window."""
    nxt = W.orderBy("azimuth")
    spans = epochs.select(F.col("azimuth").alias("from"), F.lead("azimuth").over(nxt).alias("to"), F.col("origin").alias("o0"), F.lead("origin").over(nxt).alias("o1"), F.col("coefficients").alias("c0"), F.lead("coefficients").over(nxt).alias("c1")).where("to is not null")
    last = epochs.agg(F.max("azimuth")).scalar()
    inside = points.withColumn("last", last).join(F.broadcast(spans), (F.col("azimuth") >= F.col("from")) & ((F.col("azimuth") < F.col("to")) | ((F.col("azimuth") == F.col("to")) & (F.col("to") == F.col("last")))), "left")
    share = (F.col("azimuth") - F.col("from")) / (F.col("to") - F.col("from"))
    c = F.zip_with("c0", "c1", lambda a, b: a + (b - a) * share)
    return inside.select("point_id", horner(c, F.col("slant") - (F.col("o0") + (F.col("o1") - F.col("o0")) * share)).alias("ground"))


@operator("M26", "S10", group="sequences")
def zero_doppler(points: DataFrame) -> DataFrame:
    """Of targets (x, y, z) and sensors (p_, v_, a_ by axis): distance to the zero-Doppler plane, its rate, and slant range."""
    d = {c: F.col(c) - F.col(f"p_{c}") for c in "xyz"}
    dot = lambda f: sum((f(c) for c in "xyz"), F.lit(0.0))
    return points.select("point_id", dot(lambda c: d[c] * F.col(f"v_{c}")).alias("plane"), dot(lambda c: d[c] * F.col(f"a_{c}") - F.col(f"v_{c}") * F.col(f"v_{c}")).alias("rate"), F.sqrt(dot(lambda c: d[c] * d[c])).alias("slant"))


@operator("M23", "S10", group="sequences")
def geodetic_to_ecef(points: DataFrame) -> DataFrame:
    """Longitude, latitude (degrees) and height on WGS84 to earth-centred x, y, z."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    lat, lon = F.radians("lat"), F.radians("lon")
    n = F.lit(a) / F.sqrt(1 - e2 * F.sin(lat) ** 2)
    return points.select("point_id", ((n + F.col("height")) * F.cos(lat) * F.cos(lon)).alias("x"), ((n + F.col("height")) * F.cos(lat) * F.sin(lon)).alias("y"), ((n * (1 - e2) + F.col("height")) * F.sin(lat)).alias("z"))


@operator("M27", "S10", group="sequences")
def nearest_cell(points: DataFrame, grid: DataFrame, step: float) -> DataFrame:
    """The value of the grid cell (i, j, value) whose centre is nearest to (u, v); null outside. Halves round up."""
    return points.withColumn("i", F.floor(F.col("u") / step + 0.5).cast("long")).withColumn("j", F.floor(F.col("v") / step + 0.5).cast("long")).join(grid, ["i", "j"], "left").select("point_id", "value")


@operator("W19", "E27", group="sequences")
def nearest_time(points: DataFrame, curve: DataFrame) -> DataFrame:
    """By point (point_id, u, s): the time of the curve (t, u, s) at the least squared distance, the earliest of equals.
    The curve is a small table and is broadcast."""
    d = F.pow(F.col("u") - F.col("cu"), 2) + F.pow(F.col("s") - F.col("cs"), 2)
    joined = points.join(F.broadcast(curve.select("t", F.col("u").alias("cu"), F.col("s").alias("cs"))))
    return joined.withColumn("d", d).groupBy("point_id").agg(F.min_by("t", F.struct("d", "t")).alias("t"), F.min("d").alias("d"))


@operator("E27", group="sequences")
def splicing_curve(times: DataFrame, alpha: float, beta: float, gamma: float, u0: float = 0.0, s0: float = 0.0) -> DataFrame:
    """Unspliced and spliced amounts at times t under constant rates; beta and gamma differ."""
    t = F.col("t")
    eu, es = F.exp(-beta * t), F.exp(-gamma * t)
    c = (alpha - u0 * beta) / (gamma - beta)
    return times.select("t", (u0 * eu + alpha / beta * (1 - eu)).alias("u"), (s0 * es + alpha / gamma * (1 - es) + c * (es - eu)).alias("s"))
