"""Technical indicators over whole bar tables.

An indicator is a ``Study``: stages of window expressions and the number of rows it looks back. ``compute``
evaluates many studies in one pass over number-balanced blocks (see ``plans.blocks.rolling``).

Exponential averages y[t] = (1-a)*y[t-1] + a*x[t] are sums of x weighted by powers of d = 1-a, so a running
window sum inside a block gives them without Python. A row older than ``halo`` rows weighs less than 1e-36
of the newest one, which is below double precision, so the copied halo rows make every block exact. The
seed is the simple average of the first n values. Nulls are no inputs: rows without one are set aside, so that blocks
and halos consist of inputs however many rows are null, and get the last result afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.times import MARKET_ZONE, local_date
from tidemark.plans.blocks import BARS, Axis, rolling, scan, shift

Stage = Callable[[Window, Column], dict[str, Column]]
WEIGHT_FLOOR = 83.0  # -ln(1e-36)
EXPONENT_ROOM = 650.0  # keeps d**-k below the largest double


@dataclass(frozen=True)
class Study:
    outputs: tuple[str, ...]
    halo: int
    stages: tuple[Stage, ...]
    room: float = field(default=math.inf)  # most rows a block may have
    inputs: tuple[str, ...] = ()  # rows without a value in one of these are passed over
    previous: tuple[str, ...] = ()  # columns whose last value is wanted as ``_before_<column>``


def _rows(w: Window, n: int) -> Window:
    return w.rowsBetween(-(n - 1), 0)


def _full(rn: Column, n: int, x: Column) -> Column:
    return F.when(rn >= n, x)


def _decay(alpha: float) -> tuple[int, float]:
    fall = -math.log1p(-alpha)
    return math.ceil(2 * WEIGHT_FLOOR / fall), EXPONENT_ROOM / fall


def _smooth(out: str, src: Callable[[], Column], n: int, alpha: float) -> tuple[Stage, Stage]:
    """Two stages: the weighted input with its seed, then the running sum. Counting begins anew in each block, which
    holds the start of its series or ``halo`` inputs in front.
    """
    d = 1 - alpha
    count = f"_n_{out}"

    def feed(w, rn):
        past = w.rowsBetween(Window.unboundedPreceding, 0)
        x, c = src(), F.count(src()).over(past)
        whole = F.col("_rb") == 0
        value = F.when(whole & (c < n), 0.0).when(whole & (c == n), F.avg(x).over(past) / alpha).otherwise(x)
        return {count: c, f"_e_{out}": F.when(x.isNotNull(), value).otherwise(0.0)}

    def total(w, rn):
        k = F.col(count).cast("double")
        run = F.sum(F.col(f"_e_{out}") * F.pow(F.lit(d), -k)).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return {out: F.when((F.col("_rb") > 0) | (k >= n), alpha * F.pow(F.lit(d), k) * run)}

    return feed, total


def sma(n: int, src: str = "close", name: str | None = None) -> Study:
    out = name or f"sma_{n}"
    return Study((out,), n - 1, (lambda w, rn: {out: _full(rn, n, F.avg(src).over(_rows(w, n)))},))


def ema(n: int, src: str = "close", name: str | None = None) -> Study:
    out, alpha = name or f"ema_{n}", 2 / (n + 1)
    halo, room = _decay(alpha)
    return Study((out,), halo + n, _smooth(out, lambda: F.col(src), n, alpha), room, (src,))


def rsi(n: int = 14, src: str = "close") -> Study:
    out, alpha = f"rsi_{n}", 1 / n
    halo, room = _decay(alpha)

    def moves(w, rn):
        step = F.col(src) - F.col(f"_before_{src}")
        return {f"_up_{out}": F.when(step >= 0, step).when(step < 0, 0.0), f"_dn_{out}": F.when(step <= 0, -step).when(step > 0, 0.0)}

    up = _smooth(f"_au_{out}", lambda: F.col(f"_up_{out}"), n, alpha)
    dn = _smooth(f"_ad_{out}", lambda: F.col(f"_dn_{out}"), n, alpha)
    both = [lambda w, rn, a=a, b=b: {**a(w, rn), **b(w, rn)} for a, b in zip(up, dn)]

    def ratio(w, rn):
        g, loss = F.col(f"_au_{out}"), F.col(f"_ad_{out}")
        return {out: 100 * g / F.nullif(g + loss, F.lit(0.0))}

    return Study((out,), halo + n + 1, (moves, *both, ratio), room, (src,), (src,))


def macd(fast: int = 12, slow: int = 26, signal: int = 9, src: str = "close") -> Study:
    halos = [_decay(2 / (n + 1)) for n in (fast, slow, signal)]
    f = _smooth("_macd_f", lambda: F.col(src), fast, 2 / (fast + 1))
    s = _smooth("_macd_s", lambda: F.col(src), slow, 2 / (slow + 1))
    both = [lambda w, rn, a=a, b=b: {**a(w, rn), **b(w, rn)} for a, b in zip(f, s)]
    line = lambda w, rn: {"macd": F.col("_macd_f") - F.col("_macd_s")}
    sig = _smooth("macd_signal", lambda: F.col("macd"), signal, 2 / (signal + 1))
    hist = lambda w, rn: {"macd_hist": F.col("macd") - F.col("macd_signal")}
    return Study(
        ("macd", "macd_signal", "macd_hist"),
        halos[1][0] + slow + halos[2][0] + signal,
        (*both, line, *sig, hist),
        min(h[1] for h in halos),
        (src,),
    )


def bbands(n: int = 20, k: float = 2.0, src: str = "close") -> Study:
    def base(w, rn):
        return {"bb_mid": _full(rn, n, F.avg(src).over(_rows(w, n))), "_bb_sd": F.stddev_samp(src).over(_rows(w, n))}

    def bands(w, rn):
        m, s = F.col("bb_mid"), F.col("_bb_sd")
        lo, hi = m - k * s, m + k * s
        return {
            "bb_lower": lo,
            "bb_upper": hi,
            "bb_width": 100 * (hi - lo) / m,
            "bb_pct": (F.col(src) - lo) / F.nullif(hi - lo, F.lit(0.0)),
        }

    return Study(("bb_mid", "bb_lower", "bb_upper", "bb_width", "bb_pct"), n - 1, (base, bands))


def atr(n: int = 14) -> Study:
    out, alpha = f"atr_{n}", 1 / n
    halo, room = _decay(alpha)

    def true_range(w, rn):
        prev = F.col("_before_close")
        spread = F.col("high") - F.col("low")
        return {f"_tr_{out}": F.when(spread.isNotNull(), F.greatest(spread, F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)))}

    return Study(
        (out,), halo + n + 1, (true_range, *_smooth(out, lambda: F.col(f"_tr_{out}"), n, alpha)), room, ("high", "low"), ("close",)
    )


def roc(n: int = 10, src: str = "close") -> Study:
    return Study((f"roc_{n}",), n, (lambda w, rn: {f"roc_{n}": 100 * (F.col(src) / F.lag(src, n).over(w) - 1)},))


def stochastic(n: int = 14, smooth: int = 3, d: int = 3) -> Study:
    def raw(w, rn):
        lo, hi = F.min("low").over(_rows(w, n)), F.max("high").over(_rows(w, n))
        return {"_stoch": _full(rn, n, 100 * (F.col("close") - lo) / F.nullif(hi - lo, F.lit(0.0)))}

    def k_line(w, rn):
        return {"stoch_k": _full(rn, n + smooth - 1, F.avg("_stoch").over(_rows(w, smooth)))}

    def d_line(w, rn):
        return {"stoch_d": _full(rn, n + smooth + d - 2, F.avg("stoch_k").over(_rows(w, d)))}

    return Study(("stoch_k", "stoch_d"), n + smooth + d, (raw, k_line, d_line))


def vwma(n: int = 20) -> Study:
    def weighted(w, rn):
        total = F.sum(F.col("close") * F.col("volume")).over(_rows(w, n))
        return {f"vwma_{n}": _full(rn, n, total / F.nullif(F.sum("volume").over(_rows(w, n)), F.lit(0.0)))}

    return Study((f"vwma_{n}",), n - 1, (weighted,))


def momentum(n: int, src: str = "close") -> Study:
    out = f"momentum_{n}"
    return Study((out,), n, (lambda w, rn: {out: F.col(src) / F.lag(src, n).over(w) - 1},))


def compute(bars: DataFrame, studies: Sequence[Study], ax: Axis = BARS, block_rows: int | None = None) -> DataFrame:
    """All studies, in as few passes as their block sizes allow (normally one)."""
    out, kept = bars, list(bars.columns)
    for inputs in dict.fromkeys(s.inputs for s in studies):
        same = [s for s in studies if s.inputs == inputs]
        names = [o for s in same for o in s.outputs]
        if not inputs:
            out = _computed(out, same, ax, block_rows, kept)
        else:
            before = sorted({c for s in same for c in s.previous})
            if before:
                out = scan(out, ax, {f"_before_{c}": ("last", F.col(c)) for c in before}, exclusive=True)
            given = F.lit(True)
            for c in inputs:
                given = given & F.col(c).isNotNull()
            told = _computed(out.filter(given), same, ax, block_rows, kept)
            told = told.select(*kept, F.struct(*names).alias("_told")).unionByName(out.filter(~given).select(*kept), allowMissingColumns=True)
            last = scan(told, ax, {"_told": ("last", F.col("_told"))})
            out = last.select(*kept, *[F.col("_told")[c].alias(c) for c in names])
        kept += names
    return out.select(*bars.columns, *[o for s in studies for o in s.outputs])


def _computed(rows: DataFrame, studies: Sequence[Study], ax: Axis, block_rows: int | None, kept: list[str]) -> DataFrame:
    """``kept`` and the outputs of studies of the same inputs, in as few passes as their block sizes allow."""
    groups: list[list[Study]] = []
    for s in sorted(studies, key=lambda s: s.halo):
        for g in groups:
            halo, room = max(x.halo for x in (*g, s)), min(x.room for x in (*g, s))
            if room >= 2 * halo:
                g.append(s)
                break
        else:
            groups.append([s])
    out, kept = rows, [*kept, *(c for c in rows.columns if c.startswith("_before_"))]
    for g in groups:
        halo, room = max(s.halo for s in g), min(s.room for s in g)
        size = int(min(block_rows or 16 * max(halo, 1024), room - halo))
        depth = max(len(s.stages) for s in g)
        steps = [
            lambda w, rn, i=i, g=g: {k: v for s in g if i < len(s.stages) for k, v in s.stages[i](w, rn).items()}
            for i in range(depth)
        ]
        kept += [o for s in g for o in s.outputs]
        out = rolling(out, ax, halo, steps, block_rows=size).select(*kept)
    return out


def session_vwap(bars: DataFrame, zone: str = MARKET_ZONE, ax: Axis = BARS) -> DataFrame:
    """Volume-weighted typical price since the start of the local day."""
    day = bars.withColumn("session_date", local_date(F.col("ts"), zone))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    dax = Axis((*ax.keys, "session_date"), ax.ts, ax.seq, ax.width, ax.max_rows, ax.measured)
    run = scan(day, dax, {"_pv": ("sum", typical * F.col("volume")), "_v": ("sum", F.col("volume"))})
    return run.withColumn("vwap", F.col("_pv") / F.nullif("_v", F.lit(0.0))).drop("_pv", "_v")


def custom_blocked(
    bars: DataFrame, fn: Callable, schema: str, look_back: int, ax: Axis = BARS, block_rows: int = 50_000
) -> DataFrame:
    """A user's ``fn(pandas frame) -> pandas frame`` over series of any length, for a function that looks back
    ``look_back`` rows at most: it is called block by block with the rows before the block in front, which are
    cut from its result (same length and order required)."""
    keys = [*ax.keys, "_rb"]
    numbered = scan(bars, ax, {"_rn": ("count", F.lit(1))})
    size = max(block_rows, look_back, 1)
    own = F.floor((F.col("_rn") - 1) / size).cast("long")
    spill = F.pmod(F.col("_rn") - 1, F.lit(size)) >= size - look_back
    spread = numbered.withColumn("_own", own).withColumn(
        "_rb", F.explode(F.when(spill, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own")))
    )

    def run(pdf):
        pdf = pdf.sort_values("_rn")
        mine = (pdf["_own"] == pdf["_rb"]).to_numpy()
        out = fn(pdf.drop(columns=["_rn", "_own", "_rb"]).reset_index(drop=True))
        return out[mine]

    return spread.groupBy(*keys).applyInPandas(run, schema)


def alternating_signals(rows: DataFrame, buy: Column, sell: Column, ax: Axis = BARS) -> DataFrame:
    """Signals from the previous bar's indicator: buys and sells alternate, repeats are dropped."""
    raw = rows.withColumn("_sig", F.when(buy, 1).when(sell, -1))
    prev = shift(raw, ax, {"_s": (-1, F.col("_sig"))})
    kept = scan(prev, ax, {"_was": ("last", F.col("_s"))}, exclusive=True)
    fresh = F.col("_s").isNotNull() & (F.col("_was").isNull() | (F.col("_was") != F.col("_s")))
    return kept.withColumn("signal", F.when(fresh, F.col("_s"))).drop("_sig", "_s", "_was")
