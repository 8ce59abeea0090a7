"""Parameter sweeps: one job for all parameter sets instead of one run each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import indicators, returns
from tidemark.plans.blocks import BARS, Axis, shift


def moving_average_sweep(bars: DataFrame, lengths: Sequence[int], ax: Axis = BARS) -> DataFrame:
    """Long while the previous close is above its moving average: returns of every (length, asset) as run_id,
    ts, return. All averages come from one pass over the bars; only then is a row repeated per length."""
    rows = indicators.compute(bars.select(*ax.keys, "ts", "close"), [indicators.sma(n) for n in lengths], ax)
    runs = F.array(
        *[F.struct(F.lit(n).alias("n"), (F.col("close") > F.col(f"sma_{n}")).alias("long")) for n in lengths]
    )
    prev = shift(rows.withColumn("_runs", runs), ax, {"_held": (-1, F.col("_runs")), "_was": (-1, F.col("close"))})
    move = F.col("close") / F.col("_was") - 1
    spread = prev.withColumn("_move", move).select(*ax.keys, "ts", "_move", F.explode("_held").alias("_r"))
    ident = F.concat_ws("/", F.col("_r.n").cast("string"), *[F.col(k).cast("string") for k in ax.keys])
    return spread.select(ident.alias("run_id"), "ts", F.when(F.col("_r.long"), F.col("_move")).otherwise(0.0).alias("return"))


def sweep_performance(bars: DataFrame, lengths: Sequence[int], ax: Axis = BARS) -> DataFrame:
    return returns.performance(moving_average_sweep(bars, lengths, ax))
