"""SimHash fingerprints of documents, with built-in functions only.

A text's terms are its shingles of five words (split at white space after lower-casing; fewer words are one term). The
weight of a term is how often it occurs. Each of the 64 bits of its hash votes with that weight for or against the
bit of the fingerprint; a bit is set where the votes for it are more than those against (a tie leaves it clear). Texts
without words, null ones included, have fingerprint 0. Equal texts have equal fingerprints.

The votes of four bits share one bigint, 16 bits each, so a text takes 16 sums; a sum covers ``CHUNK`` terms at most and
can't overflow, and a very long text is summed in pieces. Only these sums are exchanged.

``near_fingerprints`` finds all pairs of different fingerprints within a Hamming radius with permuted block tables: the
bits are cut into ``blocks`` blocks, and two fingerprints that differ in at most ``radius`` bits agree on all but
``radius`` of them, so for every choice of the others one table is keyed by the bits of the blocks chosen. A pair is
taken from the first table that has it, and checked in full.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty
from tidemark.plans.blocks import settle

BITS, WORDS = 64, 5
CHUNK = 1 << 14
LANES = 0x0001000100010001
RADIUS, BLOCKS = 3, 6
BLOCK_ROWS = 1024


def votes(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, n, s0 .. s15) of the texts: the number of terms and, four to a sum, how many have each bit set; one row
    for every ``CHUNK`` terms, and one for a text without words."""
    words = texts.select(*keys, F.array_remove(F.split(F.lower(text), r"\s+"), "").alias("_w"))
    short = F.lit(WORDS) - F.size("_w")
    words = words.withColumn("_w", F.when((short > 0) & (short < WORDS), F.concat("_w", F.array_repeat(F.lit(""), short))).otherwise(F.col("_w")))
    n = F.greatest(F.size("_w") - (WORDS - 1), F.lit(0))
    zipped = F.arrays_zip(*[F.slice("_w", k + 1, n).alias(f"w{k}") for k in range(WORDS)])
    terms = words.select(*keys, F.posexplode_outer(zipped).alias("_p", "_t"))
    hashed = F.when(F.col("_p").isNotNull(), F.xxhash64(*[F.col(f"_t.w{k}") for k in range(WORDS)]))
    terms = terms.select(*keys, "_p", F.floor(F.col("_p") / CHUNK).alias("_c"), hashed.alias("_h"))
    lanes = [F.coalesce(F.sum(F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(LANES))), F.lit(0)).alias(f"s{k}") for k in range(16)]
    return terms.groupBy(*keys, "_c").agg(F.count("_p").alias("n"), *lanes).drop("_c")


def fingerprint_of(summed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, fingerprint as bigint) from ``votes``."""
    total = summed.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[F.sum(F.shiftrightunsigned(f"s{k}", 16 * j).bitwiseAND(F.lit(0xFFFF))).alias(f"b{16 * j + k}") for j in range(4) for k in range(16)],
    )
    bits = [F.when(2 * F.col(f"b{b}") > F.col("n"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(BITS)]
    return total.select(*keys, reduce(lambda x, y: x.bitwiseOR(y), bits).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def as_text(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), BITS // 4, "0"))


def near_fingerprints(fingerprints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, queries: DataFrame | None = None) -> DataFrame:
    """(a, b, distance) of the pairs of different values of ``fingerprints(fingerprint)`` within ``radius`` bits, a < b;
    with ``queries(fingerprint)``, of the pairs of a query a and another value b. Nulls are left out. Equal
    fingerprints are one value: rows that share one are joined to it by the caller."""
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    tables = F.array(*[F.lit(m) for m in masks])

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.select(F.col("fingerprint").alias(name)).where(F.col(name).isNotNull()).distinct()
        rows = rows.select(name, F.posexplode(tables).alias("table", "mask"))
        return rows.select(name, "table", F.col(name).bitwiseAND(F.col("mask")).alias("key"))

    right = keyed(fingerprints, "b")
    left = keyed(fingerprints if queries is None else queries, "a")
    pairs = left.join(right, ["table", "key"]).where(F.col("a") != F.col("b") if queries is not None else F.col("a") < F.col("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    first = F.array_min(F.filter(F.transform(tables, lambda m, k: F.when(differ.bitwiseAND(m) == 0, k)), lambda k: k.isNotNull()))
    return pairs.where(F.bit_count(differ) <= radius).where(first == F.col("table")).select("a", "b", F.bit_count(differ).alias("distance"))


def with_next(documents: DataFrame) -> DataFrame:
    """(doc_id, text, next_text, prev_id) of ``documents(doc_id, text)``: every document with the text of the next one
    in descending doc_id, the last one with that of the first, and the id it is next to.

    Documents are dealt into blocks of about ``BLOCK_ROWS`` by id; a window within each block and the first document
    of the block below give the answer, so texts are exchanged once and no task sees all ids. Rows that repeat a
    doc_id are one document, the one of the least text; rows without a doc_id are left out.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text")).where("doc_id IS NOT NULL")
    span = rows.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).first()
    if not span["n"]:
        return rows.select("*", F.col("text").alias("next_text"), F.col("doc_id").alias("prev_id"))
    n_blocks = max(1, span["n"] // BLOCK_ROWS)
    share = (F.col("doc_id").cast("double") - F.lit(float(span["lo"]))) / F.lit(float(span["hi"] - span["lo"] + 1))
    block = F.least(F.floor(share * n_blocks), F.lit(n_blocks - 1))
    rows = rows.withColumn("block", block)
    found = settle(rows.groupBy("block").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).withColumn("group", F.floor(F.col("block") / BLOCK_ROWS)))
    # the block above each, within groups of blocks; at the end of a group, the first of the next; then the first of all
    inside, across = Window.partitionBy("group").orderBy("block"), Window.orderBy("group")
    starts = found.groupBy("group").agg(F.min("block").alias("first"), F.min("low").alias("first_low"))
    starts = starts.select("group", F.lead("first").over(across).alias("next"), F.lead("first_low").over(across).alias("next_low"))
    chain = found.join(starts, "group").select(
        "block",
        F.coalesce(F.lead("block").over(inside), "next", F.lit(0)).alias("above"),
        F.coalesce(F.lead("low").over(inside), "next_low", F.lit(span["lo"])).alias("above_low"),
    )
    order = Window.partitionBy("block").orderBy(F.desc("doc_id"), "text")
    # the same exchange serves the heads and the rows
    dealt = rows.repartition("block").withColumn("before", F.lag("doc_id").over(order))
    heads = dealt.where("before IS NULL").select("block", "text").join(chain, "block").select(F.col("above").alias("block"), F.col("text").alias("head"))
    ends = heads.join(chain.select("block", "above_low"), "block")
    dealt = dealt.where("before IS NULL OR before <> doc_id")
    dealt = dealt.select("block", "doc_id", "text", F.lead("text").over(order).alias("after"), F.lag("doc_id").over(order).alias("before"))
    return dealt.join(ends, "block").select(
        "doc_id", "text", F.coalesce("after", "head").alias("next_text"), F.coalesce("before", "above_low").alias("prev_id")
    )


def edited_text() -> Column:
    """The text with its last half (rounded down) replaced by as much of the beginning of the next text."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))


def compared(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per doc_id: the
    fingerprints of the document and of its edited text, and the likeness of the first to the second and to the next
    document's, as the share of equal bits."""
    both = F.array(
        F.struct(F.lit(False).alias("edited"), F.char_length("text").cast("bigint").alias("n_chars"), F.lit(None).cast("string").alias("sha"), F.col("text").alias("body")),
        F.struct(F.lit(True).alias("edited"), F.lit(None).cast("bigint").alias("n_chars"), F.sha2(F.col("new"), 256).alias("sha"), F.col("new").alias("body")),
    )
    texts = with_next(documents).withColumn("new", edited_text()).select("doc_id", "prev_id", F.inline(both))
    keys = ["doc_id", "prev_id", "edited", "n_chars", "sha"]
    marked = fingerprint_of(votes(texts, keys, "body"), keys)
    told = F.when(F.col("edited"), F.array(F.struct(F.col("doc_id").alias("id"), F.lit("edited").alias("as")))).otherwise(
        F.array(F.struct(F.col("doc_id").alias("id"), F.lit("own").alias("as")), F.struct(F.col("prev_id").alias("id"), F.lit("next").alias("as")))
    )
    rows = marked.select("n_chars", "sha", "fingerprint", F.inline(told))
    own, edited, after = (F.max(F.when(F.col("as") == k, F.col("fingerprint"))) for k in ("own", "edited", "next"))
    met = rows.groupBy("id").agg(
        F.max(F.when(F.col("as") == "own", F.col("n_chars"))).alias("n_chars"), F.max("sha").alias("edited_sha256"), own.alias("f"), edited.alias("e"), after.alias("x")
    )
    f, e, x = F.col("f"), F.col("e"), F.col("x")
    return met.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", as_text(f).alias("fingerprint"), as_text(e).alias("edited_fingerprint"),
        likeness(f, e).alias("near_edited"), likeness(f, x).alias("near_next"),
    )


def op1_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return compared(spark.read.parquet(f"{sf}/documents.parquet"))
