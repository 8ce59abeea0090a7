"""Places for user code: metrics per run, extra columns per row."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.plans.blocks import Axis, scan


def custom_metrics(curve: DataFrame, fn: Callable[[pd.DataFrame], dict], keys: Sequence[str] = ("run_id",)) -> DataFrame:
    """A user's ``fn(frame) -> {name: number}`` per run. It sees every row of the run in order of ``ts``; a run is
    one Arrow group, so for runs beyond an executor's memory use ``merged_metrics``."""
    kinds = ", ".join(f"{k} {curve.schema[k].dataType.simpleString()}" for k in keys)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = fn(pdf.sort_values("ts").reset_index(drop=True))
        head = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**head, "metrics": [{str(k): float(v) for k, v in values.items()}]})

    return curve.groupBy(*keys).applyInPandas(run, f"{kinds}, metrics map<string, double>")


def merged_metrics(
    curve: DataFrame, part: Callable[[pd.DataFrame], dict], merge: Callable[[pd.DataFrame], dict], keys: Sequence[str] = ("run_id",), block_rows: int = 100_000
) -> DataFrame:
    """The same for runs of any length, from a metric that can be merged: ``part(frame) -> {name: number}`` sees the
    consecutive rows of one block, ``merge(frame of the blocks' results in order) -> {name: number}`` those."""
    keys = list(keys)
    numbered = scan(curve, Axis(tuple(keys)), {"_rn": ("count", F.lit(1))})
    kinds = ", ".join(f"{k} {curve.schema[k].dataType.simpleString()}" for k in keys)
    blocks = numbered.withColumn("_block", F.floor((F.col("_rn") - 1) / block_rows).cast("bigint"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = part(pdf.sort_values("_rn").drop(columns=["_rn", "_block"]).reset_index(drop=True))
        head = {k: [pdf[k].iloc[0]] for k in [*keys, "_block"]}
        return pd.DataFrame({**head, "metrics": [{str(k): float(v) for k, v in values.items()}]})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        values = merge(pd.DataFrame([dict(m) for m in pdf.sort_values("_block")["metrics"]]))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "metrics": [{str(k): float(v) for k, v in values.items()}]})

    parts = blocks.groupBy(*keys, "_block").applyInPandas(run, f"{kinds}, _block bigint, metrics map<string, double>")
    return parts.groupBy(*keys).applyInPandas(join, f"{kinds}, metrics map<string, double>")


def trace_columns(curve: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Extra columns on every row of a curve."""
    return curve.withColumns(dict(columns))
