"""Filing sections, keyword search, document and memory search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import count_hits
from tidemark.plans.blocks import latest_by

# The numbered items of annual and quarterly reports, and those with a lettered part.
ITEM_NUMBERS = frozenset(str(n) for n in range(1, 16)) | {"1a", "1b", "7a", "9a", "9b"}
HEADING_CHARS = 120
_ITEM = r"[^\S\n]*(?i:item)[^\S\n]+(?i:" + "|".join(sorted(ITEM_NUMBERS)) + r")(?=[.\s]|$)"


def filing_sections(docs: DataFrame, key: str = "doc_id", text: str = "text", heading_chars: int = HEADING_CHARS) -> DataFrame:
    """Split texts at their item headings: one row per (document, section), the longest of its name.

    A heading is a line that begins with the word item and the number of a known item. A section runs to the next
    heading; lines before the first one are dropped. ``heading`` is the start of the heading line. The text is cut in one
    pass at the line ends that a heading follows.
    """
    cut = F.split(F.concat(F.lit("\n"), F.col(text)), r"\n(?=" + _ITEM + ")")
    rows = docs.select(key, F.posexplode(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0)))).alias("pos", "text")).select(
        key,
        F.concat(F.lit("item_"), F.lower(F.regexp_extract("text", r"^\s*(?i:item)\s+(\d+[A-Za-z]?)", 1))).alias("section_id"),
        "pos",
        F.substring(F.trim(F.split("text", "\n", 2)[0]), 1, heading_chars).alias("heading"),
        "text",
    )
    return latest_by(rows, [key, "section_id"], F.struct(F.length("text"), -F.col("pos"))).drop("pos")


def _hits(text: Column, term: str) -> Column:
    """0-based starts of all occurrences of a literal lower-case term."""
    pieces = F.split(text, r"\Q" + term + r"\E", -1)
    n = len(term)
    start = F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
    walk = F.aggregate(
        F.slice(pieces, 1, F.size(pieces) - 1),
        start,
        lambda a, p: F.struct(
            (a["at"] + F.length(p) + n).cast("int").alias("at"), F.array_append(a["out"], (a["at"] + F.length(p)).cast("int")).alias("out")
        ),
    )
    return walk["out"]


def keyword_hits(docs: DataFrame, query: str, max_results: int, context: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Occurrences of the words of a query in every document with their surroundings, the first word's hits
    first, at most ``max_results`` per document."""
    terms = [t.lower() for t in query.split()]
    lowered = docs.select(key, F.col(text).alias("_t"), F.lower(text).alias("_l"))
    places = lambda t: F.transform(
        _hits(F.col("_l"), t), lambda p: F.struct(F.lit(t).alias("term"), p.alias("start"), (p + len(t)).alias("end"))
    )
    found = F.flatten(F.array(*[places(t) for t in terms]))
    rows = lowered.select(key, "_t", F.posexplode(F.slice(found, 1, max_results)).alias("hit", "_h"))
    a = F.greatest(F.col("_h.start") - context, F.lit(0))
    b = F.least(F.col("_h.end") + context, F.length("_t"))
    return rows.select(
        key, F.col("hit").cast("long").alias("hit"), F.col("_h.term").alias("term"), F.col("_h.start").cast("long").alias("start"),
        F.col("_h.end").cast("long").alias("end"), F.trim(F.substring(F.col("_t"), a + 1, b - a)).alias("context"),
    )


def document_search(docs: DataFrame, query: str, k: int, key: str = "doc_id", text: str = "text", snippet: int = 160) -> DataFrame:
    """Best k documents: 100 per phrase hit, 10 per distinct word present, and one per word hit up to 50."""
    phrase = " ".join(query.lower().split())
    terms = list(dict.fromkeys(phrase.split()))
    norm = F.regexp_replace(F.lower(text), r"\s+", " ")
    rows = docs.select(key, norm.alias("_n"))
    rows = rows.select(key, "_n", count_hits(F.col("_n"), phrase).alias("_p"), *[count_hits(F.col("_n"), t).alias(f"_w{i}") for i, t in enumerate(terms)])
    words = [F.col(f"_w{i}") for i in range(len(terms))]
    present = sum((F.when(w > 0, 1).otherwise(0) for w in words), F.lit(0))
    total = sum(words, F.lit(0))
    score = F.col("_p") * 100 + present * 10 + F.least(total, F.lit(50))
    first = F.least(*[F.nullif(F.instr(F.col("_n"), t), F.lit(0)) for t in (phrase, *terms)], F.lit(2**31 - 1))
    at = F.coalesce(F.nullif(F.instr(F.col("_n"), phrase), F.lit(0)), first)
    # Rows without a hit sort last, so they are dropped after the limit: a filter before it would be pushed
    # down and count every word twice.
    best = rows.withColumn("score", score.cast("long")).orderBy(F.desc("score"), key).limit(k)
    return best.filter(F.col("score") > 0).select(
        key, "score", F.substring(F.col("_n"), F.greatest(at - snippet // 2, F.lit(1)), F.lit(snippet)).alias("snippet")
    )


def memory_search(
    rows: DataFrame, query: str, limit: int, key: str, text: str, recency: str, **filters: str | None
) -> DataFrame:
    """Best rows by the number of query words present, then the newest; equal-to filters by column."""
    terms = [t.lower() for t in query.split()]
    for column, value in filters.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    low = F.lower(text)
    score = sum((F.when(low.contains(t), 1).otherwise(0) for t in terms), F.lit(0)) if terms else F.lit(1)
    return (
        rows.withColumn("score", score.cast("long"))
        .filter(F.col("score") > 0)
        .orderBy(F.desc("score"), F.desc(recency), key)
        .limit(limit)
    )


def without_repeats(index_rows: DataFrame, event_rows: DataFrame, key: str) -> DataFrame:
    """Search results of two stores in one list, one row per key; the index wins."""
    both = index_rows.withColumn("_p", F.lit(1)).unionByName(event_rows.withColumn("_p", F.lit(0)), allowMissingColumns=True)
    return latest_by(both, [key], F.struct("_p")).drop("_p")


def project_latest(events: DataFrame, key: str, sequence: str, created: str) -> DataFrame:
    """Event log to current state: the newest event of a key, with the creation time of its first one."""
    rest = [c for c in events.columns if c not in (key, created)]
    out = events.groupBy(key).agg(F.max_by(F.struct(*rest), sequence).alias("_s"), F.min_by(created, sequence).alias(created))
    return out.select(key, *[F.col("_s")[c].alias(c) for c in rest], created)


def top_k(rows: DataFrame, score: str, recency: str, k: int, tie: Sequence[str] = ()) -> DataFrame:
    return rows.orderBy(F.desc(score), F.desc(recency), *tie).limit(k)
