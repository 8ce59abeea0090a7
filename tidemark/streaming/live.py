"""Structured Streaming: live trades, quotes and orders."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.joins import upsert
from tidemark.operators.orders import FINAL_HOLD_SECONDS, PRESETS
from tidemark.plans.blocks import latest_by

GRACE = "3 seconds"


def scale_prices(df: DataFrame, column: str = "price") -> DataFrame:
    """Vendors send fixed-point prices with nine decimals; anything above 1e10 is one."""
    return df.withColumn(column, F.when(F.col(column) > 1e10, F.col(column) / 1e9).otherwise(F.col(column)))


def with_symbols(stream: DataFrame, mapping: DataFrame) -> DataFrame:
    """Instrument ids to symbols by a stream-static join; unknown ids are dropped."""
    return stream.join(mapping, "instrument_id")


def minute_bars(trades: DataFrame, step: str = "1 minute", grace: str = GRACE) -> DataFrame:
    """Tumbling OHLCV bars. A bar is final (append mode) once the watermark, ``grace`` behind the newest
    event, passes its end; later trades are dropped. The state kept is that of open bars only."""
    rank = F.struct("ts", "seq")
    return (
        trades.withWatermark("ts", grace)
        .groupBy("asset", F.window("ts", step).alias("_w"))
        .agg(
            F.min_by("price", rank).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", rank).alias("close"),
            F.sum("size").alias("volume"),
        )
        .select("asset", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def latest_state(stream: DataFrame, keys: tuple[str, ...] = ("asset",), order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """Newest row per key, for update mode."""
    rest = [c for c in stream.columns if c not in keys]
    out = stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_s"))
    return out.select(*keys, *[F.col("_s")[c].alias(c) for c in rest])


def without_replays(stream: DataFrame, key: str = "event_id", ts: str = "ts", overlap: str = "5 seconds") -> DataFrame:
    """Drop events a reconnect sends again within the overlap."""
    return stream.withWatermark(ts, overlap).dropDuplicatesWithinWatermark([key])


def quote_stream(stream: DataFrame, any_price: bool = False) -> DataFrame:
    """Mid and spread of two-sided quotes: both sides above 0, or with ``any_price`` both there."""
    two = F.col("bid").isNotNull() & F.col("ask").isNotNull() if any_price else (F.col("bid") > 0) & (F.col("ask") > 0)
    live = stream.filter(two)
    return live.withColumns({"mid": (F.col("bid") + F.col("ask")) / 2, "spread": F.col("ask") - F.col("bid")})


def fresh_or_history(stream: DataFrame, history: DataFrame, max_age_seconds: float = 2.0) -> DataFrame:
    """Live price if it was received within the age limit of its event, else the stored last price."""
    age = F.unix_micros("received_ts") - F.unix_micros("ts")
    out = stream.join(history.select("asset", F.col("price").alias("_old")), "asset", "left")
    fresh = age <= int(max_age_seconds * 1_000_000)
    return out.withColumns({"price": F.when(fresh, F.col("price")).otherwise(F.col("_old")), "is_fresh": fresh}).drop("_old")


def order_states(events: DataFrame) -> DataFrame:
    """Current state of every order from its status events: newest status, filled quantity so far."""
    rank = F.struct("ts", "seq")
    return events.groupBy("order_id").agg(
        F.max_by("status", rank).alias("status"),
        F.max("ts").alias("ts"),
        F.sum(F.when(F.col("status").isin("fill", "partial_fill"), F.col("quantity")).otherwise(0.0)).alias("filled_quantity"),
        F.count(F.lit(1)).alias("events"),
    )


STEP_OUT = "order_id bigint, step int, price double, action string"
STEP_STATE = "start_ms long, step int, mid double, final double, steps int, seconds int"


def smart_limit_timer(orders: DataFrame) -> DataFrame:
    """Live repricing of smart-limit orders (order_id, preset, mid, final): the first price at once, the next
    whenever its step begins, a cancel after the final hold. Driven by processing-time timers."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        out = []
        if state.hasTimedOut or state.exists:
            start, step, mid, final, steps, seconds = state.get
            for _ in frames:
                pass
        else:
            row = pd.concat(list(frames)).iloc[0]
            steps, seconds = PRESETS[row["preset"]]
            start, step, mid, final = now, -1, float(row["mid"]), float(row["final"])
        elapsed = (now - start) / 1000
        due = min(steps - 1, int(elapsed // seconds))
        if elapsed >= seconds * (steps - 1) + FINAL_HOLD_SECONDS:
            out.append((key[0], steps - 1, final, "cancel"))
            if state.exists:
                state.remove()
        else:
            if due > step:
                price = final if steps <= 1 else mid + (final - mid) / (steps - 1) * due
                out.append((key[0], due, price, "price"))
            state.update((start, due, mid, final, steps, seconds))
            wait = seconds * (due + 1) if due < steps - 1 else seconds * (steps - 1) + FINAL_HOLD_SECONDS
            state.setTimeoutDuration(max(1, int(wait * 1000 - (now - start))))
        yield pd.DataFrame(out, columns=["order_id", "step", "price", "action"])

    return orders.groupBy("order_id").applyInPandasWithState(run, STEP_OUT, STEP_STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def write_bars(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append finished bars to a parquet table, exactly once."""
    return (
        stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def write_updates(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write every batch of changed rows under its batch number (a repeated batch overwrites itself); readers
    take the newest row per key with ``current_rows``."""

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def current_rows(updates: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return latest_by(updates, list(keys), F.col("batch")).drop("batch")


def history_and_live(history: DataFrame, live: DataFrame) -> DataFrame:
    return upsert(history, live, ["asset", "ts"])
