"""Best-fit packing of token sequences by exact complements.

Every document becomes its ids and the closing id 0, cut into pieces of at most ``capacity`` ids; only the first piece
may be short. Pieces of one length are interchangeable, so the plan needs the number of pieces of each length and
nothing else: at most ``capacity`` numbers, whatever the corpus. ``plan`` runs on those. It opens a sequence with the
longest length left and looks for one, two or three lengths that fill the gap exactly; a combination found is used as
often as the counts allow. Where no exact filling exists, the longest length that fits is put in and the search goes
on with the smaller gap.

Pieces are numbered within their length, in groups of bounded size, so a length that a third of all documents share
is spread over many tasks; the number decides the sequence and the place.

Null texts count as empty: one piece, the closing id. Repeated rows are packed each for itself. Ties are numbered by
doc_id (nulls first), piece and checksum; rows equal in all three are the same. An empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.bpe import encoding, id_bytes
from tidemark.llm.common import text_or_empty
from tidemark.plans.blocks import settle

CAPACITY = 2048
GROUP_ROWS = 4096
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def special_ids(tokenizer_file: str) -> dict[str, int]:
    """The added tokens of a tokenizer file; their strings in a text stand for them."""
    with open(tokenizer_file) as f:
        return {t["content"]: int(t["id"]) for t in json.load(f)["added_tokens"]}


def pieces(documents: DataFrame, rank_file: str, pattern: str, capacity: int = CAPACITY, special: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row of ``documents(doc_id, text)``. Strings in ``special``
    become their ids, and what stands between them is encoded by itself."""
    told = {name: int(n).to_bytes(4, "little") for name, n in (special or {}).items()}
    parts = re.compile("(" + "|".join(map(re.escape, sorted(told, key=len, reverse=True))) + ")") if told else None

    def encoded(enc, text: str) -> bytes:
        if not parts or not parts.search(text):
            return id_bytes(enc, text)
        return b"".join(told[x] if k % 2 else id_bytes(enc, x) for k, x in enumerate(parts.split(text)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            ids, piece, start, length, crc = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = encoded(enc, text.as_py()) + b"\0\0\0\0"
                n = len(raw) // 4
                edges = [0, *range(n % capacity or min(n, capacity), n + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    ids.append(doc)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(raw[4 * a : 4 * b]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return documents.select(F.col("doc_id").cast("bigint"), text_or_empty("text").alias("text")).mapInArrow(cut, PIECES)


class Fillings:
    """The lengths at hand, with how many pieces each has left, and the sums of one, two and three of them."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n

    def single(self, gap: int, left: np.ndarray) -> tuple[int, ...]:
        return (gap,) if left[gap] else ()

    def pair(self, gap: int, left: np.ndarray, most: int | None = None) -> tuple[int, ...]:
        top = min(gap - 1, most or gap - 1)
        low = (gap + 1) // 2
        if top < low:
            return ()
        a = np.arange(top, low - 1, -1)
        ok = (left[a] > 0) & (left[gap - a] > (2 * a == gap))
        k = int(ok.argmax())
        return (int(a[k]), int(gap - a[k])) if ok[k] else ()

    def triple(self, gap: int, left: np.ndarray) -> tuple[int, ...]:
        for a in np.flatnonzero(left[: max(gap - 1, 0)])[::-1]:
            if 3 * a < gap:
                break
            left[a] -= 1
            rest = self.pair(int(gap - a), left, int(a))
            left[a] += 1
            if rest:
                return (int(a), *rest)
        return ()

    def fill(self, gap: int) -> list[int]:
        """Lengths to put into a gap, in order, without taking them."""
        left, chosen = self.left.copy(), []
        while gap:
            exact = self.single(gap, left) or self.pair(gap, left) or self.triple(gap, left)
            if exact:
                return [*chosen, *exact]
            fits = np.flatnonzero(left[: gap + 1])
            if not len(fits):
                break
            best = int(fits[-1])
            chosen.append(best)
            left[best] -= 1
            gap -= best
        return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a sequence, how many such sequences), using up all counts."""
    found = Fillings(counts, capacity)
    out = []
    for length in range(capacity, 0, -1):
        while found.left[length]:
            found.left[length] -= 1
            pattern = [length, *found.fill(capacity - length)]
            found.left[length] += 1
            kinds, need = np.unique(pattern, return_counts=True)
            times = int((found.left[kinds] // need).min())
            found.left[kinds] -= times * need
            out.append((pattern, times))
    return out


def places(patterns: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each run of numbers within a length: its first number, first sequence and offset; keyed for bisection."""
    used: dict[int, int] = {}
    key, sequence, offset, first = [], [], [], 0
    for lengths, times in patterns:
        at = 0
        for length in lengths:
            number = used.get(length, 0)
            key.append((length << 44) + number)
            sequence.append(first)
            offset.append(at)
            used[length] = number + times
            at += length
        first += times
    order = np.argsort(np.array(key, np.int64), kind="stable")
    return {n: np.array(x, np.int64)[order] for n, x in (("key", key), ("sequence", sequence), ("offset", offset))}


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (as ``pieces`` returns it) with ``sequence_id`` and ``offset``."""
    spark = cut.sparkSession
    cut = settle(cut)
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    where = places(plan(counts, capacity))
    groups = spark.createDataFrame([(k, -(-n // GROUP_ROWS)) for k, n in counts.items()], "length bigint, n_groups bigint")
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("n_groups")).alias("part")
    dealt = cut.join(F.broadcast(groups), "length").select(*cut.columns, part)
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32", "start")
    numbered = dealt.withColumn("number", F.row_number().over(inside) - 1).join(sizes, ["length", "part"])

    @F.arrow_udf("struct<sequence_id bigint, offset bigint>")
    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        of, n = length.to_numpy(zero_copy_only=False), number.to_numpy(zero_copy_only=False)
        run = np.searchsorted(where["key"], (of << 44) + n, "right") - 1
        sequence = where["sequence"][run] + n - (where["key"][run] & ((1 << 44) - 1))
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(where["offset"][run])], names=["sequence_id", "offset"])

    put = numbered.withColumn("put", place("length", F.col("number") + F.col("base")))
    return put.select(*cut.columns, "put.sequence_id", "put.offset")


def packed_documents(
    documents: DataFrame, rank_file: str | None = None, pattern: str | None = None, capacity: int = CAPACITY, special: dict[str, int] | None = None
) -> DataFrame:
    """Pieces of ``documents(doc_id, text)`` with their sequence and place; by default with the 50,257-id vocabulary."""
    import public_tokenizers

    if special is None and rank_file is None:
        special = special_ids(public_tokenizers.path("byte_bpe_50k.json"))
    cut = pieces(documents, rank_file or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN, capacity, special)
    return pack(cut, capacity)


def op5_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{sf}/documents.parquet"))
