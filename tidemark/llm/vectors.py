"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors of one label and dimension are compared by cosine in double precision; pairs of at least ``least`` are links.
Equal vectors form a class, compared once. The unit vectors are turned so that their principal axes come first (an
exact rotation; the axes are taken from a sample of at most about ``PCA_SAMPLE`` vectors of each dimension, which can
change the effort, never the result). Two unit vectors whose first coordinates differ by more than the distance that
``least`` allows can't be linked, so classes are laid into cells of that width, cells are cut into tiles of about
``TILE`` classes, and tiles of the same or adjacent cells are compared. A tile pair multiplies the leading ``STEP``
coordinates, bounds what the others can add by the product of their norms, drops the pairs that can't reach the
threshold, and goes on with those left.

A tile pair returns for each class how many vectors it is linked to there, and one link that joins it to its part:
rows grow with classes, not pairs. Null, zero, non-finite vectors, vectors with a null component or no label, and
rows without a vec_id are linked with nothing. Repeated rows count as other vectors. Classes go by a digest of the vector,
so different vectors under one vec_id keep their links; the rows of such a vec_id have the greatest n_links and the
smallest component_id among them. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import components
from tidemark.llm.neardup import _groups, joined
from tidemark.plans.blocks import shared_dir

LEAST = 0.98
TILE, STEP, PCA_SAMPLE = 1024, 16, 4096


def units(batch: pa.RecordBatch) -> Iterator[np.ndarray | None]:
    """The unit vector of each row, None where it has none."""
    for row in batch.column("embedding"):
        values = row.values
        if values is None or not len(values) or values.null_count:
            yield None
            continue
        v = values.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(v).max()
        if not np.isfinite(top) or top == 0:
            yield None
            continue
        v = v / top
        yield v / np.sqrt(v @ v)


def unit_rows(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, dim, unit) of the vectors that can be linked."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, u) for k, u in enumerate(units(batch)) if u is not None]
            at = pa.array([k for k, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(at), batch.column("label").take(at), pa.array([len(u) for _, u in found], pa.int64()), pa.array([(u + 0.0).tobytes() for _, u in found], pa.binary())],
                names=["vec_id", "label", "dim", "unit"],
            )

    rows = embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("vec_id").cast("bigint"), F.col("label").cast("string"), F.col("embedding").cast("array<double>")
    )
    return rows.mapInArrow(make, "vec_id bigint, label string, dim bigint, unit binary")


def principal_axes(classes: DataFrame) -> dict[int, np.ndarray]:
    """For each dimension the axes, in falling order of variance, as columns."""
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    if not sizes:
        return {}
    share = F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, min(1.0, PCA_SAMPLE / n))])
    low = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share[F.col("dim")]
    sample = classes.where(low).select("dim", "unit").toPandas()
    axes = {int(d): np.eye(int(d)) for d in sizes}
    for d, group in sample.groupby("dim"):
        x = np.stack([np.frombuffer(u, np.float64) for u in group["unit"]])
        axes[int(d)] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    return axes


def rotated(classes: DataFrame, axes: dict[int, np.ndarray], width: float) -> DataFrame:
    """``classes(id, label, dim, copies, unit)`` with the unit vector turned to the axes, and its cell."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turned, cells = [], []
            for d, u in zip(batch.column("dim").to_pylist(), batch.column("unit").to_pylist()):
                v = np.frombuffer(u, np.float64) @ axes[d]
                turned.append(v.tobytes())
                cells.append(int(np.floor(v[0] / width)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(turned, pa.binary()), pa.array(cells, pa.int64())], names=["id", "label", "dim", "copies", "unit", "cell"])

    return classes.select("id", "label", "dim", "copies", "unit").mapInArrow(make, "id bigint, label string, dim bigint, copies bigint, unit binary, cell bigint")


def tile_pairs(cells: DataFrame, tile: int) -> DataFrame:
    """Every class once for each tile pair it is in: (label, dim, cell, i, next, j, side)."""
    key = ["label", "dim", "cell"]
    sizes = cells.groupBy(*key).agg(F.ceil(F.count("*") / tile).alias("own"))
    after = sizes.select("label", "dim", (F.col("cell") - 1).alias("cell"), F.col("own").alias("after"))
    before = sizes.select("label", "dim", (F.col("cell") + 1).alias("cell"), F.col("own").alias("before"))
    around = sizes.join(after, key, "left").join(before, key, "left").fillna(0, ["after", "before"])
    rows = cells.join(around, key).withColumn("t", F.pmod(F.xxhash64("id"), F.col("own")))

    def upto(n):
        return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.array().cast("array<bigint>"))

    def pair(cell, i, nxt, j, side):
        return F.struct(cell.alias("c"), i.alias("i"), F.lit(nxt).alias("next"), j.alias("j"), F.lit(side).alias("side"))

    t, c = F.col("t"), F.col("cell")
    inside = F.transform(upto(F.col("own")), lambda j: pair(c, F.least(t, j), 0, F.greatest(t, j), 0).withField("side", F.when(t <= j, 0).otherwise(1)))
    right = F.transform(upto(F.col("after")), lambda j: pair(c, t, 1, j, 0))
    left = F.transform(upto(F.col("before")), lambda j: pair(c - 1, j, 1, t, 1))
    out = rows.select("id", "label", "dim", "copies", "unit", F.explode(F.concat(inside, right, left)).alias("p"))
    return out.select("label", "dim", "p.c", "p.i", "p.next", "p.j", "p.side", "id", "copies", "unit")


def near_pairs(a: np.ndarray, b: np.ndarray, least: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` whose product reaches ``least``, adding ``step`` coordinates at a time."""
    d = a.shape[1]
    k = min(step, d)

    def rest(x: np.ndarray, at: int) -> np.ndarray:
        return np.sqrt((x[:, at:] ** 2).sum(1))

    dot = a[:, :k] @ b[:, :k].T
    i, j = np.nonzero(dot + np.outer(rest(a, k), rest(b, k)) >= least - 1e-9)
    dot = dot[i, j]
    while k < d and len(i):
        stop = min(k + step, d)
        for at in range(0, len(i), 1 << 16):
            part = slice(at, at + (1 << 16))
            dot[part] += np.einsum("nd,nd->n", a[i[part], k:stop], b[j[part], k:stop])
        k = stop
        keep = dot + rest(a, k)[i] * rest(b, k)[j] >= least - 1e-9
        i, j, dot = i[keep], j[keep], dot[keep]
    return i[dot >= least], j[dot >= least]


def compare_tiles(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["label_no", "dim", "c", "i", "next", "j"]
        for batch in _groups(batches, keys):
            key = np.stack([batch.column(k).to_numpy() for k in keys])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            ids, copies, side = (batch.column(k).to_numpy() for k in ("id", "copies", "side"))
            unit = batch.column("unit")
            out: list[tuple[np.ndarray, ...]] = []
            for start, stop in zip([0, *cuts], [*cuts, len(ids)]):
                x = np.stack([np.frombuffer(unit[k].as_buffer(), np.float64) for k in range(start, stop)])
                first, second = np.flatnonzero(side[start:stop] == 0), np.flatnonzero(side[start:stop] == 1)
                alone = key[3, start] == key[5, start] and key[4, start] == 0
                if alone:
                    second = first
                if not len(first) or not len(second):
                    continue
                a, b = near_pairs(x[first], x[second], least)
                a, b = first[a], second[b]
                if alone:
                    a, b = a[a < b], b[a < b]
                if len(a):
                    n, own = stop - start, copies[start:stop]
                    links = np.bincount(a, own[b], n) + np.bincount(b, own[a], n)
                    label = joined(n, a, b)
                    hit = np.flatnonzero(links)
                    out.append((ids[start:stop][hit], links[hit].astype(np.int64), ids[start:stop][label[hit]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["a", "links", "b"])

    return run


def near_vectors(embeddings: DataFrame, least: float = LEAST, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of ``embeddings(vec_id, embedding, label)``, a row for each row."""
    spark = embeddings.sparkSession
    path = shared_dir(spark, "units")
    digest = [F.xxhash64("label", "unit").alias("d1"), F.xxhash64(F.lit(1), "unit", "label").alias("d2")]
    unit_rows(embeddings).select("*", *digest).write.parquet(path)
    rows = spark.read.parquet(path)
    members = rows.groupBy("d1", "d2").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    path = shared_dir(spark, "vectors")
    rows.join(members, ["d1", "d2"]).where("vec_id = first").select(F.col("d1").alias("id"), "label", "dim", "copies", "unit").dropDuplicates(["id"]).write.parquet(path)
    classes = spark.read.parquet(path)
    cells = rotated(classes, principal_axes(classes), float(np.sqrt(max(2 - 2 * least, 1e-6))) * (1 + 1e-9))
    pairs = tile_pairs(cells, tile).withColumn("label_no", F.xxhash64("label"))
    keys = ["label_no", "dim", "c", "i", "next", "j"]
    dealt = pairs.repartition(*keys).sortWithinPartitions(*keys, "id").select(*keys, "side", "id", "copies", "unit")
    path = shared_dir(spark, "links")
    dealt.mapInArrow(compare_tiles(least), "a bigint, links bigint, b bigint").write.parquet(path)
    found = spark.read.parquet(path)
    linked = found.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "id")
    parts = components(found.select("a", "b")).withColumnRenamed("node", "id")
    named = members.withColumn("id", F.col("d1"))
    heads = named.join(parts, "id").groupBy("component").agg(F.min("first").alias("head"))
    known = named.join(linked, "id", "left").join(parts, "id", "left").join(heads, "component", "left")
    told = rows.select("vec_id", "d1", "d2").join(known, ["d1", "d2"]).select(
        "vec_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("head", "first").alias("component_id")
    )
    told = told.groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id")).join(told, "vec_id", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )


def op7_embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf}/embeddings.parquet"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
