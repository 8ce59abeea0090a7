"""The blocked toolkit against plain windows and brute force, with hot keys, hot hours and hot instants."""

import random

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import indicators as ind
from tidemark.plans.blocks import BLOCK, DAY, HOUR, SECOND, Axis, asof, fade, latest_by, rolling, scan, settle, shift, trailing, with_blocks


def skewed(spark, n=900, seed=7):
    """One asset with a third of all rows at a single instant, another spread over a month."""
    rng = random.Random(seed)
    rows = []
    base = pd.Timestamp("2024-01-01")
    for i in range(n):
        if i % 3 == 0:
            asset, ts = "hot", base + pd.Timedelta(hours=5)
        elif i % 3 == 1:
            asset, ts = "hot", base + pd.Timedelta(seconds=rng.randrange(30 * 86400))
        else:
            asset, ts = rng.choice("abc"), base + pd.Timedelta(seconds=rng.randrange(30 * 86400))
        rows.append((asset, ts.to_pydatetime(), i, None if rng.random() < 0.2 else float(rng.randrange(1, 100))))
    return spark.createDataFrame(rows, "asset string, ts timestamp, seq long, x double")


AXES = [
    Axis(seq=("seq",), width=10 * DAY),
    Axis(seq=("seq",), width=HOUR),
    Axis(seq=("seq",), width=30 * DAY, max_rows=40),
    Axis(seq=("seq",), width=30 * DAY, max_rows=7),
]


@pytest.mark.parametrize("ax", AXES)
def test_scan_equals_plain_window(spark, ax):
    df = skewed(spark).cache()
    x = F.col("x")
    outs = {"s": ("sum", x), "c": ("count", x), "hi": ("max", x), "lo": ("min", x), "p": ("prod", 1 + x / 1e4), "l": ("last", x), "f": ("first", x), "b": ("prev", x), "n": ("next", x)}
    got = scan(df, ax, outs)
    w = Window.partitionBy("asset").orderBy("ts", "seq")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select(
        "asset", "ts", "seq", "x", F.sum(x).over(run).alias("s"), F.count(x).over(run).alias("c"), F.max(x).over(run).alias("hi"), F.min(x).over(run).alias("lo"),
        F.product(1 + x / 1e4).over(run).alias("p"), F.last(x, True).over(run).alias("l"), F.first(x, True).over(run).alias("f"), F.lag(x).over(w).alias("b"), F.lead(x).over(w).alias("n"),
    )
    a = got.orderBy("seq").toPandas()
    b = want.orderBy("seq").toPandas()
    pd.testing.assert_frame_equal(a[b.columns], b, check_dtype=False, rtol=1e-9)


def test_exclusive_scan_leaves_current_row_out(spark):
    df = skewed(spark)
    got = scan(df, AXES[2], {"s": ("sum", F.col("x"))}, exclusive=True)
    w = Window.partitionBy("asset").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("s", F.sum("x").over(w))
    assert got.select("seq", "s").exceptAll(want.select("seq", "s")).count() == 0


def test_hot_blocks_are_cut_below_the_limit(spark):
    ax = Axis(seq=("seq",), width=30 * DAY, max_rows=40)
    sizes = with_blocks(skewed(spark), ax).groupBy("asset", BLOCK).count()
    # 300 rows of one instant can only be cut by sequence number; ranges are even, so sizes stay near the limit.
    assert sizes.agg(F.max("count")).first()[0] <= 2 * ax.max_rows


def test_shift_and_latest(spark):
    df = skewed(spark)
    got = shift(df, AXES[3], {"b": (-1, F.col("seq"))}).agg(F.count("b")).first()[0]
    assert got == 900 - df.select("asset").distinct().count()
    top = {r.asset: r.seq for r in latest_by(df, ["asset"], F.struct("ts", "seq")).collect()}
    w = Window.partitionBy("asset").orderBy(F.desc("ts"), F.desc("seq"))
    want = {r.asset: r.seq for r in df.withColumn("k", F.row_number().over(w)).filter("k = 1").collect()}
    assert top == want


@pytest.mark.parametrize("size", [5, 13, 1000])
def test_rolling_equals_plain_window(spark, size):
    df = skewed(spark).fillna(1.0, ["x"])
    got = rolling(df, AXES[2], 4, lambda w, rn: {"m": F.avg("x").over(w.rowsBetween(-4, 0)), "g": F.lag("x", 3).over(w)}, block_rows=size)
    w = Window.partitionBy("asset").orderBy("ts", "seq")
    want = df.select("seq", F.avg("x").over(w.rowsBetween(-4, 0)).alias("m"), F.lag("x", 3).over(w).alias("g"))
    pd.testing.assert_frame_equal(got.select("seq", "m", "g").orderBy("seq").toPandas(), want.orderBy("seq").toPandas(), rtol=1e-9)


def test_trailing_time_frame(spark):
    df = skewed(spark).fillna(1.0, ["x"])
    got = trailing(df, Axis(seq=("seq",), width=DAY), 3 * DAY, lambda w: {"n": F.count("x").over(w)})
    w = Window.partitionBy("asset").orderBy(F.unix_micros("ts")).rangeBetween(-3 * DAY, 0)
    want = df.withColumn("n", F.count("x").over(w))
    assert got.select("seq", "n").exceptAll(want.select("seq", "n")).count() == 0


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("limit", [20, 4_000_000])
def test_asof_equals_pandas(spark, strict, limit):
    df = skewed(spark)
    left = df.filter("seq % 2 = 0").select("asset", "ts", "seq")
    right = df.filter("seq % 2 = 1").select("asset", F.col("ts").alias("rts"), F.col("seq").alias("rseq"))
    one = right.groupBy("asset", "rts").agg(F.max("rseq").alias("rseq"))
    got = asof(left, one, right_ts="rts", strict=strict, max_rows=limit).orderBy("seq").toPandas()
    want = pd.merge_asof(
        left.toPandas().sort_values(["ts", "seq"]), one.toPandas().sort_values("rts"), left_on="ts", right_on="rts", by="asset", allow_exact_matches=not strict
    ).sort_values("seq").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[["asset", "seq", "rts", "rseq"]], want[["asset", "seq", "rts", "rseq"]], check_dtype=False)


def test_settle_checkpoints_reliably(spark):
    df = settle(spark.range(10))
    assert df.count() == 10 and "ExistingRDD" in df._jdf.queryExecution().toString()


def ema_by_hand(values, n):
    out, alpha = [None] * (n - 1), 2 / (n + 1)
    y = sum(values[:n]) / n
    out.append(y)
    for v in values[n:]:
        y = (1 - alpha) * y + alpha * v
        out.append(y)
    return out


@pytest.mark.parametrize("n", [2, 9, 50])
def test_ema_is_exact_across_blocks(spark, n):
    rng = random.Random(n)
    values = [100 + rng.random() * 50 for _ in range(5000)]
    base = pd.Timestamp("2020-01-01")
    pdf = pd.DataFrame({"asset": "a", "ts": [base + pd.Timedelta(minutes=i) for i in range(5000)], "close": values})
    # Small blocks: every block depends on its copied rows.
    got = ind.compute(spark.createDataFrame(pdf), [ind.ema(n)], block_rows=500).orderBy("ts").toPandas()[f"ema_{n}"]
    want = ema_by_hand(values, n)
    assert got.isna().sum() == n - 1
    assert max(abs(a - b) for a, b in zip(got[n - 1 :], want[n - 1 :])) < 1e-9


def test_step_units():
    assert SECOND * 3600 == HOUR


@pytest.mark.parametrize("ax, kind", [(AXES[3], "mixed"), (AXES[0], "slow"), (AXES[1], "fast")])
def test_fade_equals_recursion(spark, ax, kind):
    """Resets, rows that keep everything, and falls far beyond what one power can hold."""
    df = skewed(spark, 700).withColumn("h", F.pmod(F.xxhash64("seq"), F.lit(100)))
    h = F.col("h")
    keep = {"mixed": F.when(h < 3, 0.0).when(h < 50, 1.0).when(h < 60, None).otherwise(h / 100), "slow": F.lit(0.999), "fast": F.when(h < 50, 1e-150).otherwise(0.3)}[kind]
    df = df.withColumn("k", keep.cast("double"))
    got = fade(df, ax, {"y": (F.col("k"), F.col("x")), "z": (F.lit(0.5), F.col("x"))}).orderBy("asset", "ts", "seq").collect()
    assert got[0].asDict().keys() == {*df.columns, "y", "z"} and len(got) == 700
    last, y, z = None, 0.0, 0.0
    for r in got:
        if r.asset != last:
            last, y, z = r.asset, 0.0, 0.0
        y, z = (1.0 if r.k is None else r.k) * y + (r.x or 0.0), 0.5 * z + (r.x or 0.0)
        assert r.y == pytest.approx(y, rel=1e-11) and r.z == pytest.approx(z, rel=1e-11)


def test_asof_of_unique_right_rows(spark):
    """``unique`` spares the aggregate of the right side and changes nothing else."""
    left = spark.range(400).selectExpr("cast(id % 7 as string) asset", "timestamp_micros(id * 5000000) ts", "id")
    right = spark.range(150).selectExpr("cast(id % 7 as string) asset", "timestamp_micros(id * 14000000) q_ts", "id * 1.5 q")
    for strict in (False, True):
        plain = asof(left, right, right_ts="q_ts", strict=strict, width=60_000_000)
        told = asof(left, right, right_ts="q_ts", strict=strict, width=60_000_000, unique=True)
        assert sorted(told.collect(), key=str) == sorted(plain.collect(), key=str)
