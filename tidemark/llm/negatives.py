"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

A vector's component x becomes floor(256 * x); a row's score is its integer inner product with the anchor. Rows are laid in
the order of (length, label, place on a Hilbert curve through the ``AXES`` components of greatest variance) and written
as Parquet in blocks of at most ``BLOCK_ROWS`` rows of one label, each with the least and greatest value of every
component: its zone. Interval arithmetic over a zone bounds the score that any row of the block can have with an anchor.

Positives of an anchor: the best ``POSITIVES`` other rows of its label. The anchor's own block gives a first score to beat;
blocks of the label whose upper bound doesn't reach it are not read. Negatives of an anchor and positive: the best ``NEGATIVES``
rows of other labels whose score lies in the window from half to 95 hundredths of the positive's. Only blocks of other
labels whose bounds meet a window of an anchor are read. Both are one search: zones are dealt to chunks, the anchors (in
tiles, a tile being those of one block) visit every chunk, and the chosen blocks are then read with the tiles that want them.

Rows with a null label, vec_id or vector, an empty vector, a null or non-finite component, or one beyond ``FAR`` (scores
would leave 64 bits) take no part. Vectors of different lengths are not compared. Equal rows (vec_id, label, whole-number
vector) count once; other rows of one vec_id are rows of their own, ordered by label and vector where score and vec_id tie.
An anchor without positives, and a positive without negatives, give no rows; neither does an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.plans.blocks import shared_dir

SCALE, FAR = 256, float(1 << 14)
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH, OF = 50, 95, 100
AXES, BITS = 8, 7
BLOCK_ROWS, CHUNK_BLOCKS = 256, 256
NONE, MOST = -(1 << 62), 1 << 62

_ROW = "vec_id bigint, label bigint, dim int, vec binary"


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, dim, vec) of the rows that take part, each once; ``vec`` holds 32-bit numbers."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for k, row in enumerate(batch.column("embedding")):
                values = row.values
                if values is None or not len(values) or values.null_count:
                    continue
                v = values.to_numpy(zero_copy_only=False)
                if np.abs(v).max() <= FAR:  # false for NaN
                    at.append(k)
                    out.append(np.floor(v * SCALE).astype(np.int32).tobytes())
            taken = pa.array(at, pa.int64())
            sizes = pa.array([len(x) // 4 for x in out], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(taken), batch.column("label").take(taken), sizes, pa.array(out, pa.binary())], names=["vec_id", "label", "dim", "vec"]
            )

    rows = embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").select(
        F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), F.col("embedding").cast("array<double>")
    )
    return rows.mapInArrow(make, _ROW).distinct()


def curve_axes(rows: DataFrame) -> DataFrame:
    """For each vector length the components of greatest variance, with their range: (dim, axes(at, lo, hi))."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, raw in zip(batch.column("dim").to_pylist(), batch.column("vec").to_pylist()):
                v = np.frombuffer(raw, np.int32).astype(np.float64)
                old = sums.setdefault(dim, np.stack([np.zeros(dim), np.zeros(dim), np.zeros(dim), v, v]))
                old[0] += 1
                old[1] += v
                old[2] += v * v
                np.minimum(old[3], v, out=old[3])
                np.maximum(old[4], v, out=old[4])
        for dim, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, dim, np.int32)), pa.array(np.arange(dim, dtype=np.int32)), *map(pa.array, x)], names=["dim", "at", "n", "s", "q", "lo", "hi"])

    parts = rows.mapInArrow(make, "dim int, at int, n double, s double, q double, lo double, hi double")
    found = parts.groupBy("dim", "at").agg(*[F.sum(c).alias(c) for c in "nsq"], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spread = F.round(F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2), 6)
    place = F.row_number().over(Window.partitionBy("dim").orderBy(spread.desc(), "at"))
    top = found.withColumn("place", place).where(F.col("place") <= AXES)
    return top.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("place", "at", "lo", "hi"))).alias("axes"))


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of each column of ``cells``: axes x points, whole numbers of ``bits`` bits."""
    x = cells.astype(np.int64)
    n, bit = len(x), 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(n):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, bit = np.zeros(x.shape[1], np.int64), 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where(x[-1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace ``axes`` by the place on the curve through them."""
    for batch in batches:
        keys = np.zeros(batch.num_rows, np.int64)
        dims = batch.column("dim").to_numpy()
        raw, axes = batch.column("vec"), batch.column("axes")
        for dim in np.unique(dims):
            of = np.flatnonzero(dims == dim)
            v = np.stack([np.frombuffer(raw[int(k)].as_buffer(), np.int32) for k in of]).astype(np.float64)
            told = axes[int(of[0])].as_py()
            lo, hi = (np.array([a[c] for a in told])[:, None] for c in ("lo", "hi"))
            cells = (v[:, [a["at"] for a in told]].T - lo) * ((1 << BITS) - 1) / np.maximum(hi - lo, 1)
            keys[of] = hilbert(cells.astype(np.int64))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "dim", "vec", "anchor")), pa.array(keys)], names=["vec_id", "label", "dim", "vec", "anchor", "key"])


def cut_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted rows of one label and length as blocks with their zones."""
    kind: tuple | None = None
    ids: list[int] = []
    vecs: list[bytes] = []
    marks: list[bool] = []

    def block() -> pa.RecordBatch:
        v = np.frombuffer(b"".join(vecs), np.int32).reshape(len(ids), -1)
        values = [kind[0], kind[1], ids, v.tobytes(), np.array(marks, bool).tobytes(), v.min(0).tobytes(), v.max(0).tobytes()]
        return pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in zip(values, [pa.int32(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4])], names=["dim", "label", "ids", "vecs", "anchors", "lo", "hi"]
        )

    for batch in batches:
        for dim, label, vec_id, vec, anchor in zip(*(batch.column(c).to_pylist() for c in ("dim", "label", "vec_id", "vec", "anchor"))):
            if ids and (kind != (dim, label) or len(ids) == BLOCK_ROWS):
                yield block()
                ids, vecs, marks = [], [], []
            kind = (dim, label)
            ids.append(vec_id)
            vecs.append(vec)
            marks.append(bool(anchor))
    if ids:
        yield block()


def blocks_of(rows: DataFrame, anchor: Column) -> DataFrame:
    """The block table of ``rows``, written as Parquet."""
    spark = rows.sparkSession
    path = shared_dir(spark, "vectors")
    rows.withColumn("anchor", F.coalesce(anchor, F.lit(False))).write.parquet(path)
    rows = spark.read.parquet(path)
    keyed = rows.join(curve_axes(rows), "dim").mapInArrow(curve_keys, f"{_ROW}, anchor boolean, key bigint")
    order = ["dim", "label", "key", "vec_id", "vec"]
    laid = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    cut = laid.mapInArrow(cut_blocks, "dim int, label bigint, ids array<bigint>, vecs binary, anchors binary, lo binary, hi binary")
    path = shared_dir(spark, "blocks")
    cut.withColumn("block", F.monotonically_increasing_id()).write.parquet(path)
    return spark.read.parquet(path)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two whole-number matrices."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    top = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if top < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest product of each row of ``a`` with any vector between ``lo`` and ``hi``: interval arithmetic."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    return products(up, lo) + products(down, hi), products(up, hi) + products(down, lo)


def _matrix(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, np.int32).reshape(n, -1)


def first_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchors of each block, with the score that their positives have to reach by what their own block holds."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            at = np.flatnonzero(np.frombuffer(r["anchors"], bool))
            if not len(at):
                continue
            ids = np.array(r["ids"], np.int64)
            v = _matrix(r["vecs"], len(ids))
            scores = products(v[at], v)
            scores[np.arange(len(at)), at] = NONE - 1
            least = np.sort(scores, 1)[:, -POSITIVES] if len(ids) > POSITIVES else np.full(len(at), NONE)
            windows = np.stack([least, np.full(len(at), MOST)], 1).astype(np.int64)
            out.append({"tile": r["block"], "dim": r["dim"], "label": r["label"], "ids": ids[at].tolist(), "at": at.astype(np.int64).tobytes(), "vecs": v[at].tobytes(), "windows": windows.tobytes()})
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_TILE)


_TILE = pa.schema([("tile", pa.int64()), ("dim", pa.int32()), ("label", pa.int64()), ("ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("at", "vecs", "windows")]])
_TILE_DDL = "tile bigint, dim int, label bigint, ids array<bigint>, at binary, vecs binary, windows binary"


def choose_blocks(same: bool):
    """Zones and tiles of a chunk, zones first -> the blocks that each tile must read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, zones, packs = None, [], {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["chunk"] != chunk:
                    chunk, zones, packs = r["chunk"], [], {}
                if not r["side"]:
                    zones.append(r)
                    continue
                dim = r["dim"]
                if dim not in packs:
                    own = [z for z in zones if z["dim"] == dim]
                    packs[dim] = own and (*(np.array([z[c] for z in own], np.int64) for c in ("id", "label")), *(np.stack([np.frombuffer(z[c], np.int32) for z in own]) for c in ("lo", "hi")))
                if not packs[dim]:
                    continue
                ids, labels, lo, hi = packs[dim]
                of = np.flatnonzero((labels == r["label"]) == same)
                n = len(r["ids"])
                least, most = bounds(_matrix(r["vecs"], n), lo[of], hi[of])
                w = np.frombuffer(r["windows"], np.int64).reshape(n, -1, 2)
                meets = ((most[:, None, :] >= w[:, :, :1]) & (least[:, None, :] <= w[:, :, 1:])).any((0, 1))
                if meets.any():
                    out.append((chunk, r["id"], ids[of[meets]].tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.list_(pa.int64())))], names=["chunk", "tile", "wanted"])

    return run


def read_blocks(same: bool, best: int):
    """Blocks and tiles of a chunk, blocks first -> the best rows in each window of each anchor of a tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held = None, {}
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["chunk"] != chunk:
                    chunk, held = r["chunk"], {}
                if not r["side"]:
                    held[r["id"]] = r
                    continue
                n = len(r["ids"])
                a, at = _matrix(r["vecs"], n), np.frombuffer(r["at"], np.int64)
                w = np.frombuffer(r["windows"], np.int64).reshape(n, -1, 2)
                found: dict[tuple[int, int], list[tuple[int, int, int, bytes]]] = {}
                for b in (held[k] for k in r["wanted"]):
                    ids = b["ids"]
                    v = _matrix(b["vecs"], len(ids))
                    scores = products(a, v)
                    if b["id"] == r["id"]:
                        scores[np.arange(n), at] = NONE - 1
                    for i, k in np.argwhere(scores.max(1)[:, None] >= w[:, :, 0]):
                        own = found.setdefault((int(i), int(k)), [])
                        low = max(int(w[i, k, 0]), -own[-1][0] if len(own) == best else NONE + 1)
                        hit = np.flatnonzero((scores[i] >= low) & (scores[i] <= w[i, k, 1]))
                        if len(hit) > best:
                            hit = hit[scores[i, hit] >= np.partition(scores[i, hit], -best)[-best]]
                        if len(hit):
                            own += [(-int(scores[i, j]), ids[j], b["label"], v[j].tobytes()) for j in hit]
                            own.sort()
                            del own[best:]
                out += [(r["id"], i, k, vec_id, label, vec, -score) for (i, k), own in found.items() for score, vec_id, label, vec in own]
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["tile", "of", "window", "vec_id", "label", "vec", "score"])

    return run


def search(blocks: DataFrame, tiles: DataFrame, same: bool, best: int) -> DataFrame:
    """The ``best`` rows in every window of every anchor: (tile, of, window, vec_id, label, vec, score, rank)."""
    spark = blocks.sparkSession
    chunks = max(1, -(-blocks.count() // CHUNK_BLOCKS))
    chunk = F.pmod(F.xxhash64("block"), F.lit(chunks)).alias("chunk")
    empty, none = F.lit(None).cast("binary"), F.lit(None).cast("array<bigint>")
    zones = blocks.select(chunk, F.lit(0).alias("side"), F.col("block").alias("id"), "dim", "label", none.alias("ids"), empty.alias("vecs"), empty.alias("windows"), "lo", "hi")
    visits = tiles.select(
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint"))).alias("chunk"),
        F.lit(1).alias("side"), F.col("tile").alias("id"), "dim", "label", "ids", "vecs", "windows", empty.alias("lo"), empty.alias("hi"),
    )
    dealt = zones.unionByName(visits).repartition("chunk").sortWithinPartitions("chunk", "side", "id")
    path = shared_dir(spark, "wanted")
    dealt.mapInArrow(choose_blocks(same), "chunk bigint, tile bigint, wanted array<bigint>").write.parquet(path)
    wanted = spark.read.parquet(path)

    read = wanted.select(F.explode("wanted").alias("block")).distinct()
    pages = blocks.join(read, "block", "left_semi").select(
        chunk, F.lit(0).alias("side"), F.col("block").alias("id"), "label", "ids", "vecs", empty.alias("at"), empty.alias("windows"), none.alias("wanted")
    )
    asks = wanted.join(tiles, "tile").select("chunk", F.lit(1).alias("side"), F.col("tile").alias("id"), "label", "ids", "vecs", "at", "windows", "wanted")
    dealt = pages.unionByName(asks).repartition("chunk").sortWithinPartitions("chunk", "side", "id")
    found = dealt.mapInArrow(read_blocks(same, best), "tile bigint, of int, window int, vec_id bigint, label bigint, vec binary, score bigint")
    order = Window.partitionBy("tile", "of", "window").orderBy(F.desc("score"), "vec_id", "label", "vec")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def negative_tiles(tiles: DataFrame, positives: DataFrame) -> DataFrame:
    """The tiles with the windows of their anchors' positives; windows that hold nothing end before they begin."""
    lists = positives.groupBy("tile").agg(F.collect_list(F.struct("of", "rank", "score")).alias("scores"))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                w = np.full((len(r["ids"]), POSITIVES, 2), NONE, np.int64)
                w[:, :, 0] = MOST
                for x in r["scores"]:
                    w[x["of"], x["rank"] - 1] = -(-LOW * x["score"] // OF), HIGH * x["score"] // OF
                out.append({c: r[c] for c in _TILE.names} | {"windows": w.tobytes()})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_TILE)

    return tiles.join(lists, "tile").mapInArrow(make, _TILE_DDL)


def hard_negatives(embeddings: DataFrame, anchor: Column) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``embeddings(vec_id, embedding, label)``;
    ``anchor`` tells by vec_id and label which rows are anchors."""
    spark = embeddings.sparkSession
    blocks = blocks_of(whole_vectors(embeddings), anchor)
    path = shared_dir(spark, "tiles")
    columns = blocks.select("block", "dim", "label", "ids", "vecs", "anchors")
    columns.mapInArrow(first_tiles, _TILE_DDL).write.parquet(path)
    tiles = spark.read.parquet(path)
    path = shared_dir(spark, "positives")
    search(blocks, tiles, True, POSITIVES).write.parquet(path)
    positives = spark.read.parquet(path)
    path = shared_dir(spark, "windows")
    negative_tiles(tiles, positives).write.parquet(path)
    negatives = search(blocks, spark.read.parquet(path), False, NEGATIVES)
    named = tiles.select("tile", F.posexplode("ids").alias("of", "anchor_id"))
    scored = positives.select("tile", "of", (F.col("rank") - 1).alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = negatives.join(scored, ["tile", "of", "window"]).join(named, ["tile", "of"])
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Every fiftieth vector as an anchor; every seventh has a shifted label."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").withColumn("label", moved)
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
), p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INTEGER AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""
