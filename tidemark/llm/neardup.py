"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its distinct shingles of ``WIDTH`` words, or as many as are asked for (bytes A-Z lower-cased, words
between ASCII white space; a document of fewer words is one shingle, one without words is empty and linked with nothing). Documents with equal sets
form a class, and classes are represented by their smallest doc_id. Links are pairs of classes whose sets have
100 * intersection >= 80 * union.

Candidates: every set is reduced to ``SKETCH`` minwise tokens. In each of ``TREES`` independent trees the root holds
all classes; a node picks one or (in 9 of 16 cases) two pairs of token positions, drawn from its own path, and hands
every class to the child of the tokens it has there, so a class goes to 1 / 0.8 ** 2 children on average and a pair of
similarity 0.8 is expected to meet in one. A node of at most ``LEAF`` classes is compared exhaustively by sketch; larger
ones branch again. A node that is still larger at ``DEPTH`` consists of classes that agree in twice as many random
tokens: it is taken as one group of candidates, without comparing.

Confirmation: candidate groups are joined to components. Within each, links are confirmed on the full sets, class
against class, until everything is connected or all pairs are compared. A component of more than ``TILE`` classes is
cut into tiles that are compared inside and against a few pivots; the classes that are then outside the largest part
are compared with every tile. So a large group of copies costs its size, not its square, and no link between
different parts is lost.

Null texts are empty. A row with a null doc_id is its own component (null) and kept. Repeated rows share a class; rows
of one doc_id with different texts are compared each for itself. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import components, slices, text_or_empty
from tidemark.llm.words import byte_runs, mix, word_hashes
from tidemark.plans.blocks import settle, shared_dir

SKETCH, TREES, LEAF, DEPTH = 128, 10, 128, 4
ROWS_A_PART = 50_000
#: Equal sketch bytes a candidate pair has at least: 4.5 standard deviations below what similarity 0.8 expects.
ALIKE = 82
TILE, PIVOTS = 1024, 8
SHARE, OF = 80, 100
WIDTH = 2

#: (values, what is connected already, which to compare) -> links between the values' places.
Confirm = Callable[[list, np.ndarray, np.ndarray], list[tuple[int, int]]]

_LOWER = np.arange(256, dtype=np.uint16)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13, 32]] = 0
_LOWER[0] = 256  # a NUL is an ordinary character
_PICKS = mix(np.arange(1, 2 * SKETCH + 1, dtype=np.uint64))
_SLOPE, _SHIFT = (_PICKS[:SKETCH] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_PICKS[SKETCH:] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = byte_runs(texts)
    hashes, first = word_hashes(data, offsets, _LOWER)
    step = np.uint64(0x9E3779B97F4A7C15)
    runs = hashes[: max(0, len(hashes) - width + 1)].copy()
    for k in range(1, width):
        runs = runs * step + hashes[k : k + len(runs)]
    runs = mix(runs)
    for a, b in zip(first, first[1:]):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        else:
            own = hashes[a : a + (b > a)].copy()
            for k in range(a + 1, b):
                own = own * step + hashes[k]
            yield mix(own ^ np.uint64(0xD6E8FEB86659FD93))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """For each of the hash functions, the least value among the tokens."""
    low = np.full(SKETCH, 0xFFFFFFFF, np.uint32)
    short = (tokens >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        part = short[at : at + 1024] * _SLOPE[:, None] + _SHIFT[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def _each(batches: Iterator[pa.RecordBatch], make: Callable[[pa.RecordBatch], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 19):
            yield make(part)


def summaries(documents: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sketch): size, digest and sketch of every set. The sketch has 16 bits of each
    minwise token, first the low bytes of all, then the high ones."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        sizes, digests, sketches = [], [], []
        for s in shingle_sets(part.column("text"), width):
            sizes.append(len(s))
            digests.append((int(np.bitwise_xor.reduce(mix(s))) if len(s) else 0, int(s.sum(dtype=np.uint64))))
            sketches.append(sketch(s))
        d = np.array(digests, np.uint64).view(np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array(d[:, 0]),
                pa.array(d[:, 1]),
                pa.array([x.astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes() if n else None for x, n in zip(sketches, sizes)], pa.binary()),
            ],
            names=["doc_id", "n_shingles", "d1", "d2", "sketch"],
        )

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text"))
    return rows.mapInArrow(lambda b: _each(b, make), "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, sketch binary")


def children(size: int, node: str = "node", tokens: str = "sketch") -> Column:
    """The nodes a class goes to from a node."""

    def token(which: int) -> Column:
        at = F.pmod(F.xxhash64(F.col(node), F.lit(which)), F.lit(size)).cast("int")
        return F.xxhash64(at, F.substring(F.col(tokens), at + 1, F.lit(1)), F.substring(F.col(tokens), at + size + 1, F.lit(1)))

    first, other = (F.xxhash64(F.col(node), token(k), token(k + 1)) for k in (1, 3))
    second = F.pmod(F.xxhash64(F.col(node), F.lit(0)), F.lit(16)) < 9
    return F.explode(F.when(second, F.array(first, other)).otherwise(F.array(first)))


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of sorted rows, cut so that no group of equal keys is split over two."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        same = np.ones(table.num_rows, bool)
        for k in keys:
            column = table.column(k).to_numpy()
            same &= column == column[-1]
        stop = table.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if stop:
            yield table.slice(0, stop).combine_chunks().to_batches()[0]
        rest = table.slice(stop)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks().to_batches()[0]


def joined(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index each of ``n`` reaches over the given links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare_leaves(batches: Iterator[pa.RecordBatch], size: int, alike: int) -> Iterator[pa.RecordBatch]:
    """(a, b) for rows (node, id, low) sorted by node: links that join what a leaf's sketches show to be alike."""
    for batch in _groups(batches, ["node"]):
        node, ids = (batch.column(c).to_numpy() for c in ("node", "id"))
        low = np.frombuffer(b"".join(batch.column("low").to_pylist()), np.uint8).reshape(-1, size)
        left, right = [], []
        for lag in range(1, len(node)):
            near = np.flatnonzero(node[:-lag] == node[lag:])
            if not len(near):
                break
            for part in np.array_split(near, len(near) // 8192 + 1):
                hit = part[(low[part] == low[part + lag]).sum(1) >= alike]
                left.append(hit)
                right.append(hit + lag)
        if left:
            label = joined(len(node), np.concatenate(left), np.concatenate(right))
            own = np.flatnonzero(label != np.arange(len(node)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[label[own]])], names=["a", "b"])


def candidates(classes: DataFrame, size: int = SKETCH, alike: int = ALIKE) -> DataFrame:
    """Links (a, b), one per class and tree at most, that join all classes found to be alike."""
    seeds = F.explode(F.array(*[F.xxhash64(F.lit("tree"), F.lit(t)) for t in range(TREES)]))
    low = F.substring("sketch", 1, size).alias("low")
    below = classes.select("id", "sketch", seeds.alias("node")).select("id", children(size).alias("node"))
    found: list[DataFrame] = []
    for depth in range(1, DEPTH + 1):
        sizes = below.groupBy("node").agg(F.count("*").alias("n")).where("n > 1")
        held = settle(below.join(sizes, "node"))
        rows, wide = held.agg(F.count("*"), F.count_if(F.col("n") > LEAF)).first()
        held = held.coalesce(max(1, -(-rows // ROWS_A_PART)))
        leaves = held.where(F.col("n") <= LEAF).join(classes.select("id", low), "id").select("node", "id", "low")
        found.append(leaves.repartition("node").sortWithinPartitions("node").mapInArrow(lambda b: compare_leaves(b, size, alike), "a bigint, b bigint"))
        if not wide:
            break
        large = held.where(F.col("n") > LEAF)
        if depth == DEPTH:
            found.append(large.join(large.groupBy("node").agg(F.min("id").alias("b")), "node").select(F.col("id").alias("a"), "b"))
        else:
            below = large.join(classes.select("id", "sketch"), "id").select("id", children(size).alias("node")).distinct()
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def confirm(sets: list[np.ndarray], parts: np.ndarray, probes: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) that join everything the full sets link. ``parts``: what is connected already; only ``probes``
    are compared with all others, and only with those not connected yet."""
    label, links = parts.copy(), []
    if len(sets) < 2:
        return links
    sizes = np.array([len(s) for s in sets])
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    values, token = np.unique(np.concatenate(sets), return_inverse=True)
    has = np.zeros(len(values), bool)
    for i in probes:
        if (label == label[0]).all():
            break
        if (label == label[i]).all():
            continue
        own = token[offsets[i] : offsets[i] + sizes[i]]
        has[own] = True
        common = np.add.reduceat(has[token], offsets, dtype=np.int64)
        has[own] = False
        linked = (OF * common >= SHARE * (sizes + sizes[i] - common)) & (label != label[i])
        for j in np.flatnonzero(linked):
            if label[j] != label[i]:
                links.append((int(i), int(j)))
                label[label == label[j]] = label[i]
    return links


def _confirm_tiles(confirm: Confirm) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(a, b) for rows (grp, tile, other, id, part, probe, tokens) sorted by the first three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _groups(batches, ["grp", "tile", "other"]):
            keys = np.stack([batch.column(c).to_numpy() for c in ("grp", "tile", "other")])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            ids = batch.column("id").to_numpy()
            parts, probe = batch.column("part").to_numpy(), batch.column("probe").to_numpy(zero_copy_only=False)
            tokens = batch.column("tokens")
            a, b = [], []
            for start, stop in zip([0, *cuts], [*cuts, len(ids)]):
                values = [tokens[k].as_buffer() for k in range(start, stop)]
                for i, j in confirm(values, parts[start:stop], np.flatnonzero(probe[start:stop])):
                    a.append(ids[start + i])
                    b.append(ids[start + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def confirmed_links(groups: DataFrame, payload: Callable[[DataFrame], DataFrame], confirm: Confirm, tile: int | None = None) -> DataFrame:
    """Confirmed links (a, b) within ``groups(node, component)``, joining all that ``confirm`` links.

    ``payload`` adds the column ``tokens`` to rows (id, ...); ``confirm(tokens, parts, probes)`` compares the values of
    one tile. Tiles hold ``tile`` values on average; a larger group goes through pivots, as the module says. A node may be
    in several groups.
    """
    tile = tile or TILE
    keys = ["grp", "tile", "other"]

    def linked(tiles: DataFrame) -> DataFrame:
        rows = tiles.repartition(*keys).sortWithinPartitions(*keys)
        return rows.select(*keys, "id", "part", "probe", "tokens").mapInArrow(_confirm_tiles(confirm), "a bigint, b bigint")

    sizes = groups.groupBy("component").agg(F.count("*").alias("n"))
    dealt = groups.join(sizes, "component").select(
        F.col("node").alias("id"), F.col("component").alias("grp"), "n", F.ceil(F.col("n") / tile).alias("tiles")
    )
    dealt = settle(dealt.withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles"))))
    pivot = (F.col("tiles") > 1) & (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < F.lit(float(PIVOTS << 30)) / F.col("n"))
    tiles = F.when(pivot, F.sequence(F.lit(0).cast("bigint"), F.col("tiles") - 1)).otherwise(F.array("tile"))
    first = payload(dealt.withColumn("places", tiles)).select(
        "grp", F.explode("places").alias("tile"), F.lit(0).cast("bigint").alias("other"), "id", F.col("id").alias("part"), F.lit(True).alias("probe"), "tokens"
    )
    found = settle(linked(first).distinct())
    wide = dealt.where("tiles > 1")
    if wide.isEmpty():
        return found
    parts = wide.join(components(found).withColumnRenamed("node", "id"), "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    most = parts.groupBy("grp", "part").agg(F.count("*").alias("m")).groupBy("grp").agg(F.max_by("part", F.struct("m", "part")).alias("main"), F.sum("m").alias("all"), F.max("m").alias("m"))
    open_ = most.where("all > m").select("grp", "main", F.ceil((F.col("all") - F.col("m")) / tile).alias("others"))
    parts = settle(parts.join(open_, "grp").withColumn("outside", F.col("part") != F.col("main")))
    if parts.isEmpty():
        return found
    spread = payload(parts.select("id", "grp", "tile", "tiles", "part", "outside", "others"))

    def upto(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    inner = spread.select("grp", "tile", upto("others").alias("other"), "id", "part", F.lit(False).alias("probe"), "tokens")
    outer = spread.where("outside").select(
        "grp", upto("tiles").alias("tile"), F.pmod(F.xxhash64("id", F.lit(2)), F.col("others")).alias("other"), "id", "part", F.lit(True).alias("probe"), "tokens"
    )
    return found.unionByName(linked(inner.unionByName(outer)))


def links(documents: DataFrame, groups: DataFrame, width: int) -> DataFrame:
    """Confirmed links (a, b) between classes, on their full sets."""

    def make(part: pa.RecordBatch) -> pa.RecordBatch:
        sets = pa.array([s.tobytes() for s in shingle_sets(part.column("text"), width)], pa.binary())
        return pa.RecordBatch.from_arrays([*part.columns[:-1], sets], names=[*part.schema.names[:-1], "tokens"])

    def with_sets(chosen: DataFrame) -> DataFrame:
        rows = documents.select(F.col("doc_id").cast("bigint").alias("id"), text_or_empty("text").alias("text")).join(chosen, "id")
        kinds = ", ".join(f"{c} {k}" for c, k in chosen.dtypes)
        return rows.select(*chosen.columns, "text").mapInArrow(lambda b: _each(b, make), f"{kinds}, tokens binary")

    return confirmed_links(groups, with_sets, lambda tokens, parts, probes: confirm([np.frombuffer(t, np.uint64) for t in tokens], parts, probes))


def near_duplicates(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of ``documents(doc_id, text)``, a row for each row; by shingles of
    ``width`` words."""
    spark = documents.sparkSession
    path = shared_dir(spark, "sketches")
    summaries(documents, width).write.parquet(path)
    base = spark.read.parquet(path)
    digest = ["d1", "d2", "n_shingles"]
    rep = base.where("n_shingles > 0").groupBy(*digest).agg(F.min("doc_id").alias("id"))
    path = shared_dir(spark, "classes")
    base.join(rep, digest).where("doc_id = id").select("id", "sketch").write.parquet(path)
    classes = spark.read.parquet(path)
    groups = settle(components(candidates(classes)))
    linked = components(links(documents, groups, width)).withColumnRenamed("node", "id")
    members = rep.join(linked, "id", "left").select(*digest, F.coalesce("component", "id").alias("component_id"))
    out = base.select("doc_id", *digest).join(members, digest, "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def op10_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))
