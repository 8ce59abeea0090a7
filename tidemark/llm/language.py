"""Language identification by nearest centroid.

A text is lower-cased, its non-letters become single spaces, and its letter pairs and triples are hashed into ``DIM``
counters. The vector is the square root of the counts times the inverse document frequency, scaled to length one.
Every language has up to ``CLUSTERS`` centroids, found by spherical k-means among its training texts, and a text gets
the language of the centroid with the largest cosine. A text further from its centroid than the training texts of
that cluster, by the factor ``REACH`` of their least cosine, is rejected.

The classifier is fitted on a sample of at most about ``PER_LANGUAGE`` labelled rows of each language (those with the
lowest hash of doc_id; the bound is on the expectation); prediction takes every whole text.

Texts that are null or have no letter are ``und`` with score 0 and rejected; without any training row all are. Equal
cosines go to the first language and cluster in order. Repeated rows are predicted alike; rows with a null doc_id are
predicted but never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.blocks import settle

BITS = 13
DIM = 1 << BITS
CLUSTERS = 4
PER_LANGUAGE = 400
REACH = 0.2
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> itself for letters, a space for anything else."""
    table = np.full(0x110000, 32, np.uint32)
    for k in range(0x110000):
        if chr(k).isalpha():
            table[k] = k
    return table


def counts(text: str | None) -> np.ndarray | None:
    """Hashed counts of the letter pairs and triples of a text; None without letters."""
    points = _letters()[np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = points == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    points = points[keep]
    if not len(points) or (points == 32).all():
        return None
    padded = np.concatenate([[np.uint32(32)], points, [np.uint32(32)]]).astype(np.uint32)
    pairs = padded[:-1] * np.uint32(0x9E3779B1) ^ padded[1:] * np.uint32(0x85EBCA6B)
    triples = pairs[:-1] * np.uint32(0xC2B2AE35) ^ padded[2:] * np.uint32(0x27D4EB2F)
    pairs = pairs * np.uint32(0x165667B1)
    triples = triples * np.uint32(0x9E3779B1)
    shift = np.uint32(32 - BITS)
    return np.bincount(np.concatenate([pairs >> shift, triples >> shift]), minlength=DIM)


def vector(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(tf.astype(np.float32)) * idf
    return v / max(float(np.sqrt(v @ v)), 1e-12)


def clusters(vectors: np.ndarray, k: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of length one, and the least cosine of the members of each; deterministic."""
    chosen = [int((vectors @ vectors.mean(0)).argmax())]
    while len(chosen) < min(k, len(vectors)):
        near = (vectors @ vectors[chosen].T).max(1)
        if near.min() > 1 - 1e-6:
            break
        chosen.append(int(near.argmin()))
    centres = vectors[chosen]
    for _ in range(rounds):
        of = (vectors @ centres.T).argmax(1)
        centres = np.stack([vectors[of == c].mean(0) if (of == c).any() else centres[c] for c in range(len(centres))])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    cos = vectors @ centres.T
    of = cos.argmax(1)
    return centres, np.array([cos[of == c, c].min() if (of == c).any() else 1.0 for c in range(len(centres))])


@dataclass
class Model:
    """``idf`` and one row per centroid: its language, vector and the least cosine accepted."""

    idf: np.ndarray
    langs: list[str]
    centres: np.ndarray
    least: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        tf = counts(text) if len(self.langs) else None
        if tf is None:
            return UNKNOWN, 0.0, True
        cos = self.centres @ vector(tf, self.idf)
        best = int(cos.argmax())
        return self.langs[best], float(min(max(cos[best], 0.0), 1.0)), bool(cos[best] < self.least[best])


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, k: int = CLUSTERS, reach: float = REACH) -> Model:
    """Fit on a bounded sample of ``labelled(doc_id, text, lang)``."""
    rows = labelled.where("lang IS NOT NULL AND doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model(np.ones(DIM, np.float32), [], np.zeros((0, DIM), np.float32), np.zeros(0))
    share = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, per_language / n))])
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30)) < share[F.col("lang")]
    sample = settle(rows.where(low).select("lang", "text", F.xxhash64("doc_id").alias("rank")))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, np.zeros(DIM, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                tf = counts(text.as_py())
                if tf is not None:
                    n, df = n + 1, df + (tf > 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIM)), pa.array(np.concatenate([[n], df]))], names=["gram", "df"])

    found = sample.select("text").mapInArrow(spread, "gram bigint, df bigint").groupBy("gram").agg(F.sum("df").alias("df")).toPandas()
    df = found.sort_values("gram")["df"].to_numpy()
    idf = (np.log((1 + df[0]) / (1 + df[1:])) + 1).astype(np.float32)

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        tfs = [counts(t) for t in group.sort_values(["rank", "text"])["text"]]
        vectors = [vector(tf, idf) for tf in tfs if tf is not None]
        if not vectors:
            return pd.DataFrame({n: pd.Series(dtype=object) for n in ("lang", "cluster", "centre", "least")})
        centres, least = clusters(np.stack(vectors), k)
        return pd.DataFrame({"lang": group["lang"].iloc[0], "cluster": range(len(centres)), "centre": list(centres.astype(np.float32)), "least": least})

    model = sample.groupBy("lang").applyInPandas(learn, "lang string, cluster int, centre array<float>, least double").toPandas().sort_values(["lang", "cluster"])
    centres = np.array(model["centre"].tolist(), np.float32).reshape(-1, DIM)
    return Model(idf, model["lang"].tolist(), centres, reach * model["least"].to_numpy(float))


def identify(text: str | Column, model: Model) -> Column:
    """Struct column (lang_pred, score, rejected) of a text column."""

    @F.arrow_udf("struct<lang_pred string, score double, rejected boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        found = [model.predict(t.as_py()) for t in texts]
        langs, scores, rejected = zip(*found) if found else ((), (), ())
        return pa.StructArray.from_arrays(
            [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["lang_pred", "score", "rejected"]
        )

    return predict(F.col(text) if isinstance(text, str) else text)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(3)) == 1, F.lit(False))


def op6_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    said = docs.select("doc_id", held_out().alias("held_out"), identify("text", model).alias("said"))
    return said.select("doc_id", "held_out", "said.lang_pred", "said.score", "said.rejected")
