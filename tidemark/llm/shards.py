"""Shards of equal size by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents of equal text are one group. A group that holds more than a ``1 / (shards * FINE)`` share of the bytes, tokens
or rows is an item of its own; there are at most ``3 * shards * FINE`` of those. One that doesn't fit half a shard is cut
into the fewest equal pieces that do (a text that makes up a third of the table can't lie in one of 40 equal shards). All
other groups are dealt by the hash of their text to items of their size class (half octaves), so many a class that no
item is expected to exceed that share. The list of items is bounded by the parameters, whatever the table.

Items are placed from the largest (weighted sum of its shares) to the smallest, each into the shard where the weighted dot product of its vector
(shares of bytes, tokens and rows of a shard) with the shard's residual capacity is highest; ties go to the smaller shard.
So law ``bytes`` holds: the sizes are near equal, and tokens and rows follow as far as the groups allow.

A document's size is its UTF-8 bytes plus ``OVERHEAD``; its tokens are its runs without white space. A null text counts as
an empty one. Repeated rows are rows. Rows with a null doc_id are dealt like others. Which rows of a group that had to be
cut go to which piece follows the order of the input; all else depends on the rows alone. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty
from tidemark.plans.blocks import shared_dir

SHARDS, FINE, OVERHEAD, ROWS_A_PART = 40, 512, 16, 20_000
#: What is balanced, the law first, and its weight in the dot product.
GOODS, WEIGHTS = ("size", "tokens", "one"), np.array([16, 4, 1])


def digests(documents: DataFrame) -> DataFrame:
    """(doc_id, size, tokens, one, text_crc32, g1, g2, row) of every row; the texts are not needed any more."""
    text = text_or_empty("text")
    return documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
        F.regexp_count(text, F.lit(r"\S+")).cast("bigint").alias("tokens"),
        F.lit(1).cast("bigint").alias("one"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g1"),
        F.xxhash64(F.lit(1), text).alias("g2"),
        F.monotonically_increasing_id().alias("row"),
    )


def size_class(size: str = "size") -> Column:
    return F.floor(2 * F.log2(F.col(size))).cast("int")


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item; ``items`` has a row of non-negative goods each."""
    total = items.sum(0)
    shares = items * (shards / np.where(total > 0, total, 1))
    left, where = np.ones((shards, items.shape[1])), np.zeros(len(items), np.int64)
    for k in np.argsort(-shares @ WEIGHTS, kind="stable"):
        where[k] = np.argmax(left @ (shares[k] * WEIGHTS))
        left[where[k]] -= shares[k]
    return where


def shard_documents(documents: DataFrame, shards: int = SHARDS, fine: int = FINE) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, tokens), a row for each row of ``documents(doc_id, text)``."""
    if shards < 1 or fine < 1:
        raise ValueError("shards and fine must be positive")
    spark = documents.sparkSession
    path = shared_dir(spark, "digests")
    digests(documents).write.parquet(path)
    rows = spark.read.parquet(path)
    sums = [F.sum(g).alias(g) for g in GOODS]
    total = np.array(rows.agg(*[F.coalesce(s, F.lit(0)).alias(g) for s, g in zip(sums, GOODS)]).first(), float)
    unit = np.maximum(total / (shards * fine), 1)

    groups = rows.groupBy("g1", "g2").agg(*sums)
    heavy = groups.where(" OR ".join(f"{g} > {u!r}" for g, u in zip(GOODS, unit.tolist()))).collect()
    heavy.sort(key=lambda r: (r["g1"], r["g2"]))
    pieces = [max(1, *(int(np.ceil(2 * r[g] * shards / t)) if r["one"] > 1 else 1 for g, t in zip(GOODS, total) if t)) for r in heavy]
    first = np.concatenate([[0], np.cumsum(pieces)]).astype(int)
    names = "g1 bigint, g2 bigint, first bigint, pieces bigint"
    own = spark.createDataFrame([(r["g1"], r["g2"], int(f), int(p)) for r, f, p in zip(heavy, first, pieces)], names)
    marked = rows.join(F.broadcast(own), ["g1", "g2"], "left").withColumn("class", size_class())

    light = marked.where("first IS NULL").groupBy("class").agg(*sums).collect()
    light.sort(key=lambda r: r["class"])
    dealt = [max(1, int(np.ceil(max(r[g] / u for g, u in zip(GOODS, unit))))) for r in light]
    base = first[-1] + np.concatenate([[0], np.cumsum(dealt)]).astype(int)
    classes = spark.createDataFrame([(r["class"], int(b), n) for r, b, n in zip(light, base, dealt)], "class int, base bigint, dealt bigint")
    item = F.when(F.col("first").isNotNull(), F.col("first") + F.pmod("row", "pieces")).otherwise(F.col("base") + F.pmod(F.xxhash64("g1", "g2"), F.col("dealt")))
    named = marked.join(F.broadcast(classes), "class", "left").withColumn("item", item)

    items = sorted(tuple(r) for r in named.groupBy("item").agg(*sums).collect())
    table = np.array(items, np.int64).reshape(-1, 1 + len(GOODS))
    where = place(table[:, 1:].astype(float), shards)
    start, filled = np.zeros(len(table), np.int64), np.zeros(shards, np.int64)
    for k, s in enumerate(where):
        start[k] = filled[s]
        filled[s] += table[k, -1]
    parts = -(-table[:, -1] // ROWS_A_PART)
    plan = spark.createDataFrame(list(zip(*[x.tolist() for x in (table[:, 0], where, start, parts)])), "item bigint, shard int, start bigint, parts bigint")

    put = named.join(F.broadcast(plan), "item").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    sizes = put.groupBy("item", "part").count()
    before = Window.partitionBy("item").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("item", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("item", "part").orderBy("doc_id", "text_crc32", "row")
    numbered = put.withColumn("number", F.row_number().over(inside) - 1).join(sizes, ["item", "part"])
    slot = (F.col("start") + F.col("before") + F.col("number")).alias("slot")
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op13_shards(spark: SparkSession, sf: str) -> DataFrame:
    return shard_documents(spark.read.parquet(f"{sf}/documents.parquet"))
