"""Ordered computation over long series without putting a whole series into one task.

A plain ``Window.partitionBy(asset)`` sorts every row of an asset in a single task, which fails as soon as
one asset holds a large part of the table. Here a series is cut into *blocks* (stretches of its time axis).
Rows are exchanged once on (key, block); windows run inside a block; each block is summarised by a partial
aggregate (map-side combined), the few block summaries of a key are combined by a small window, and the
carried value is joined back on (key, block), which leaves the big side where it is.

Blocks have a fixed width. A block found to hold more than ``max_rows`` rows is cut into ever shorter time
steps, and at a single instant by its sequence number, so a hot asset, hour or instant is split too.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND = 1_000_000
HOUR = 3600 * SECOND
DAY = 24 * HOUR

BLOCK = "_blk"
# Successively shorter steps for blocks over the row limit: day, hour, minute, second, millisecond, instant.
FINER = (DAY, HOUR, 60 * SECOND, SECOND, 1000, 1)


@dataclass(frozen=True)
class Axis:
    """How a series is keyed and ordered, and how its axis is cut.

    ``keys`` + (``ts``, *``seq``) must be a total order. The first ``seq`` column, if any, should be numeric:
    it is what an overfull instant is cut by. ``measured=False`` skips the row count per block; it is meant
    for series with a known number of rows per block, such as bars (one row per step).
    """

    keys: tuple[str, ...] = ("asset",)
    ts: str = "ts"
    seq: tuple[str, ...] = ()
    width: int = 30 * DAY
    max_rows: int = 4_000_000
    measured: bool = True

    @property
    def order(self) -> list[Column]:
        return [F.col(self.ts), *[F.col(c) for c in self.seq]]

    @property
    def rank(self) -> Column:
        return F.struct(self.ts, *self.seq)


BARS = Axis(width=365 * DAY, measured=False)
TICKS = Axis(seq=("seq",), width=DAY)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session: ``spark.checkpoint.dir``, else the directory set on the context. Where
    neither is set, a session within one process gets a temporary folder; on a cluster that is an error, since
    executors can't read each other's disks."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    root = named or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        sc.setCheckpointDir(root)
    return root


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder of the session."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the session's shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder: columns that a reader leaves out are not read, and its files
    are smaller than those of a checkpoint. For rows that are gone over several times."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Jobs within remove their shuffle files as they end, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def position(df: DataFrame, name: str) -> Column:
    """The axis column as a long: microseconds for times, micro-units for numbers."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("long") * F.lit(DAY)
    if isinstance(kind, T.IntegralType):
        return F.col(name).cast("long")
    return F.floor(F.col(name) * 1_000_000).cast("long")


def _step(pos: Column, width: int) -> Column:
    return pos - F.pmod(pos, F.lit(width))


def with_blocks(df: DataFrame, ax: Axis) -> DataFrame:
    """Add the block of every row (kept if already there)."""
    if BLOCK in df.columns:
        return df
    pos = position(df, ax.ts)
    out = df.withColumn(BLOCK, F.struct(_step(pos, ax.width).alias("t"), F.lit(0).cast("long").alias("s")))
    if not ax.measured:
        return out
    on = [*ax.keys, BLOCK]
    for width in [w for w in FINER if w < ax.width]:
        hot = out.groupBy(*on).count().filter(F.col("count") > ax.max_rows)
        if hot.isEmpty():
            return out
        # At most rows/max_rows blocks can be over the limit, so the list is safe to broadcast. It is settled:
        # each level then adds one small join to the plan instead of doubling it.
        hot = settle(hot.select(*on, F.lit(True).alias("_hot")))
        out = (
            out.join(F.broadcast(hot), on, "left")
            .withColumn(
                BLOCK,
                F.when(
                    F.col("_hot"),
                    F.struct(_step(pos, width).alias("t"), F.lit(0).cast("long").alias("s")),
                ).otherwise(F.col(BLOCK)),
            )
            .drop("_hot")
        )
    if not ax.seq or not isinstance(df.schema[ax.seq[0]].dataType, T.NumericType):
        return out
    seq = F.col(ax.seq[0]).cast("long")
    hot = (
        out.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_n"), F.min(seq).alias("_lo"), F.max(seq).alias("_hi"))
        .filter(F.col("_n") > ax.max_rows)
    )
    if hot.isEmpty():
        return out
    step = F.greatest(F.lit(1), F.floor((F.col("_hi") - F.col("_lo") + 1) * ax.max_rows / F.col("_n")))
    hot = settle(hot.select(*on, "_lo", step.cast("long").alias("_step")))
    return (
        out.join(F.broadcast(hot), on, "left")
        .withColumn(
            BLOCK,
            F.struct(
                F.col(f"{BLOCK}.t").alias("t"),
                F.coalesce(F.floor((seq - F.col("_lo")) / F.col("_step")).cast("long"), F.lit(0).cast("long")).alias("s"),
            ),
        )
        .drop("_lo", "_step")
    )


def _total(kind: str, x: Column, rank: Column) -> Column:
    """What a block passes on."""
    if kind == "last":
        return F.max_by(x, F.when(x.isNotNull(), rank))
    if kind == "first":
        return F.min_by(x, F.when(x.isNotNull(), rank))
    if kind in ("prev", "next"):
        return (F.max_by if kind == "prev" else F.min_by)(F.struct(x.alias("v")), rank)
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "prod": F.product}[kind](x)


def _running(kind: str, x: Column) -> Column:
    if kind == "last":
        return F.last(x, ignorenulls=True)
    if kind == "first":
        return F.first(x, ignorenulls=True)
    return {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "prod": F.product}[kind](x)


def _merge(kind: str, inner: Column, carry: Column) -> Column:
    if kind == "last":
        return F.coalesce(inner, carry)
    if kind == "first":
        return F.coalesce(carry, inner)
    if kind in ("prev", "next"):
        return F.coalesce(inner, carry)["v"]
    if kind == "max":
        return F.greatest(carry, inner)
    if kind == "min":
        return F.least(carry, inner)
    both = carry * inner if kind == "prod" else carry + inner
    return F.when(carry.isNull(), inner).when(inner.isNull(), carry).otherwise(both)


def scan(df: DataFrame, ax: Axis, outs: dict[str, tuple[str, Column]], exclusive: bool = False) -> DataFrame:
    """Running aggregates in axis order: name -> (last|first|sum|count|max|min|prod, expression), and values of
    the neighbouring row: name -> (prev|next, expression).

    ``exclusive`` leaves the current row out of its own aggregate. Aggregates skip nulls, neighbours do not.
    """
    had = BLOCK in df.columns
    base = with_blocks(df, ax)
    on = [*ax.keys, BLOCK]
    rows = Window.partitionBy(*on).orderBy(*ax.order)
    inside = rows.rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
    blocks = Window.partitionBy(*ax.keys).orderBy(BLOCK)
    before = blocks.rowsBetween(Window.unboundedPreceding, -1)

    def inner_value(kind: str, x: Column) -> Column:
        if kind in ("prev", "next"):
            return (F.lag if kind == "prev" else F.lead)(F.struct(x.alias("v"))).over(rows)
        return _running(kind, x).over(inside)

    def carried(kind: str, c: str) -> Column:
        if kind in ("prev", "next"):
            return (F.lag if kind == "prev" else F.lead)(c).over(blocks)
        return _running("sum" if kind == "count" else kind, F.col(c)).over(before)

    kinds = [k for k, _ in outs.values()]
    totals = base.groupBy(*on).agg(*[_total(k, x, ax.rank).alias(f"_c{i}") for i, (k, x) in enumerate(outs.values())])
    # One row per block: this window sees the number of blocks of a key, not its rows.
    carries = totals.select(*on, *[carried(k, f"_c{i}").alias(f"_c{i}") for i, k in enumerate(kinds)])
    inner = base.withColumns({f"_i{i}": inner_value(k, x) for i, (k, x) in enumerate(outs.values())})
    joined = inner.join(carries, on, "left")
    keep = [c for c in base.columns if c not in outs and (had or c != BLOCK)]
    return joined.select(*keep, *[_merge(k, F.col(f"_i{i}"), F.col(f"_c{i}")).alias(n) for i, (n, (k, _)) in enumerate(outs.items())])


def shift(df: DataFrame, ax: Axis, outs: dict[str, tuple[int, Column]]) -> DataFrame:
    """Value of the previous (-1) or next (+1) row of the series, across block borders."""
    return scan(df, ax, {n: ("prev" if off < 0 else "next", x) for n, (off, x) in outs.items()})


#: Natural logarithms that a stretch of ``fade`` spans, so that their powers fit a double; and that of a reset.
_STRETCH, _FORGET = 300.0, 1000.0


def fade(df: DataFrame, ax: Axis, outs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Fading sums in axis order: name -> (keep, add) gives y = keep * y_before + add, starting from 0.

    ``keep`` lies between 0 and 1; a null one counts as 1, a null ``add`` as 0. Such steps compose: a block passes on
    y * (product of its keeps) + its own sum, whatever y it is given, so the blocks of a series are joined up by one
    small window. A sum is a running sum of ``add`` weighed by powers. A stretch of rows over which the logarithms of
    the keeps add up to ``_STRETCH`` needs itself and the stretch before; all else has faded beyond a double.
    """
    had = BLOCK in df.columns
    keys, on, past = list(ax.keys), [*ax.keys, BLOCK], (Window.unboundedPreceding, Window.currentRow)
    base = with_blocks(df, ax)
    names = [c for c in base.columns if c not in outs and (had or c != BLOCK)]

    def faded(rows: DataFrame, within: list[str], order: list[Column], i: int, add: Column, fall: Column) -> DataFrame:
        """Adds ``_y{i}``, the sum as if the rows of ``within`` began with 0, and ``_t{i}``, how far they have fallen."""
        rows = rows.withColumn(f"_t{i}", F.sum(fall).over(Window.partitionBy(*within).orderBy(*order).rowsBetween(*past)))
        rows = rows.withColumn(f"_p{i}", F.floor(F.col(f"_t{i}") / _STRETCH))
        deep = F.col(f"_t{i}") - F.col(f"_p{i}") * _STRETCH
        here = F.sum(add * F.exp(deep)).over(Window.partitionBy(*within, f"_p{i}").orderBy(*order).rowsBetween(*past))
        rows = rows.withColumn(f"_y{i}", here)
        front = F.sum(add * F.exp(deep - _STRETCH)).over(Window.partitionBy(*within).orderBy(f"_p{i}").rangeBetween(-1, -1))
        return rows.withColumn(f"_y{i}", (F.col(f"_y{i}") + F.coalesce(front, F.lit(0.0))) * F.exp(-deep)).drop(f"_p{i}")

    for i, (keep, add) in enumerate(outs.values()):
        keep = F.coalesce(keep.cast("double"), F.lit(1.0))
        fall = F.when(keep > 0, F.least(-F.log(keep), F.lit(_FORGET))).otherwise(_FORGET)
        base = faded(base, on, ax.order, i, F.coalesce(add.cast("double"), F.lit(0.0)), fall)
    ends = base.groupBy(*on).agg(*[F.max_by(f"_{c}{i}", ax.rank).alias(f"_{c}{i}") for i in range(len(outs)) for c in "yt"])
    series = Window.partitionBy(*keys).orderBy(BLOCK)
    for i in range(len(outs)):
        ends = faded(ends.withColumnsRenamed({f"_y{i}": "_add", f"_t{i}": "_fall"}), keys, [F.col(BLOCK)], i, F.col("_add"), F.col("_fall")).drop("_add", "_fall")
    given = ends.select(*on, *[F.coalesce(F.lag(f"_y{i}").over(series), F.lit(0.0)).alias(f"_g{i}") for i in range(len(outs))])
    values = [(F.col(f"_y{i}") + F.exp(-F.col(f"_t{i}")) * F.col(f"_g{i}")).alias(name) for i, name in enumerate(outs)]
    return base.join(given, on).select(*names, *values)


def rolling(
    df: DataFrame,
    ax: Axis,
    halo: int,
    build: Callable[[Window, Column], dict[str, Column]] | Sequence[Callable],
    block_rows: int | None = None,
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Row-frame computations that look back at most ``halo`` rows.

    Rows are numbered within their series (a blocked count), then exchanged on (key, number div block_rows).
    The last ``halo`` rows of a block are copied to the next one, so every frame is complete inside a block,
    and blocks have the same number of rows whatever the distribution. ``build`` gets the window inside a
    block and the 1-based row number; a list of builders is applied in turn, each seeing earlier columns.
    ``_k`` is the place of a row inside its block, counted from the first copied row.
    """
    size = max(block_rows or 16 * halo, halo, 1)
    numbered = scan(df, ax, {"_rn": ("count", F.lit(1))})
    own = F.floor((F.col("_rn") - 1) / size).cast("long")
    spill = F.pmod(F.col("_rn") - 1, F.lit(size)) >= size - halo
    spread = numbered.withColumn("_own", own).withColumn(
        "_rb", F.explode(F.when(spill, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own")))
    )
    spread = spread.withColumn("_k", F.col("_rn") - (F.col("_rb") * size - halo))
    win = Window.partitionBy(*ax.keys, "_rb").orderBy("_rn")
    builders = [build] if callable(build) else list(build)
    out = spread.withColumns(extra) if extra else spread
    for step in builders:
        out = out.withColumns(step(win, F.col("_rn")))
    drop = ["_rn", "_own", "_rb", "_k", BLOCK, *(extra or {})]
    return out.filter(F.col("_rb") == F.col("_own")).drop(*drop)


def trailing(df: DataFrame, ax: Axis, span: int, build: Callable[[Window], dict[str, Column]]) -> DataFrame:
    """Frames over the trailing ``span`` of axis units (microseconds for times).

    Blocks are at least ``span`` wide, so a frame reaches back into one earlier block at most; that part of
    a block is copied forward.
    """
    width = max(ax.width, span)
    pos = position(df, ax.ts)
    own = F.floor(pos / width).cast("long")
    late = F.pmod(pos, F.lit(width)) >= width - span
    spread = (
        df.withColumn("_pos", pos)
        .withColumn("_own", own)
        .withColumn("_rb", F.explode(F.when(late, F.array("_own", F.col("_own") + 1)).otherwise(F.array("_own"))))
    )
    win = Window.partitionBy(*ax.keys, "_rb").orderBy("_pos").rangeBetween(-span, 0)
    out = spread.withColumns(build(win))
    return out.filter(F.col("_rb") == F.col("_own")).drop("_pos", "_own", "_rb")


def latest_by(df: DataFrame, keys: Sequence[str], rank: Column, newest: bool = True) -> DataFrame:
    """One row per key: the one with the greatest (or least) rank. A partial aggregate, so hot keys shrink
    before the exchange, unlike ``row_number``. Ranks must be unique per key."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if newest else F.min_by
    boxed = df.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("_r"))
    return boxed.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = ("asset",),
    left_ts: str = "ts",
    right_ts: str = "ts",
    right_rank: Sequence[str] = (),
    strict: bool = False,
    width: int = DAY,
    measured: bool = True,
    max_rows: int = 4_000_000,
    unique: bool = False,
) -> DataFrame:
    """Attach to every left row the latest right row at or before (``strict``: before) it.

    Both sides are merged on one axis and the last right row is carried forward block by block; no side is
    broadcast and no pairs are formed. Right columns must not clash with left ones; they are null where
    nothing precedes. ``right_rank`` breaks ties between right rows of one instant (greatest wins); what it leaves
    tied is settled by a hash of the row, so a rerun gives the same result. ``unique`` says that no instant of a key has
    two right rows, which spares finding the greatest.
    """
    keys = list(keys)
    cols = [c for c in right.columns if c not in keys]
    plain = [c for c in cols if "map<" not in right.schema[c].dataType.simpleString()]
    rows = right.select(*keys, F.col(right_ts).alias("_t"), F.struct(*cols).alias("_r"), F.xxhash64(*plain).alias("_tie"), *right_rank)
    # One right row per instant; several left rows of an instant may then stand in any order, and are
    # spread by a hash so that an overfull instant can be cut.
    rank = F.struct(*[F.col(c) for c in right_rank], F.col("_tie"))
    one = rows if unique else rows.groupBy(*keys, "_t").agg(F.max_by("_r", rank).alias("_r"))
    boxed = F.struct(*left.columns)
    probe = left.select(
        *keys, F.col(left_ts).alias("_t"), boxed.alias("_l"), (1 + F.pmod(F.xxhash64(*left.columns), F.lit(65536))).alias("_n")
    )
    both = one.select(
        *keys, "_t", "_r", F.lit(70000 if strict else 0).cast("long").alias("_n")
    ).unionByName(probe, allowMissingColumns=True)
    ax = Axis(tuple(keys), "_t", ("_n",), width=width, measured=measured, max_rows=max_rows)
    done = scan(both, ax, {"_last": ("last", F.col("_r"))})
    return done.filter(F.col("_l").isNotNull()).select(
        *[F.col("_l")[c].alias(c) for c in left.columns], *[F.col("_last")[c].alias(c) for c in cols]
    )
