"""Byte-level BPE encoding and decoding with a local rank file.

Texts are encoded by the tiktoken library: no network, no special tokens, every match of the split pattern on its own.
Two things the library can't do are added around it. A long text is cut where the pattern always ends a match, between
a non-space and a white-space character, so one call never holds more than a piece; and a run of white space so long
that the library's regular expressions overflow their stack is passed on as the single match it is. Ids decode to raw
bytes, since one id may be a part of a character.

Null texts count as empty and encode to no ids; null ids decode to null. Ties can't occur: ranks are unique.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty

#: White space as Unicode and the pattern define it; fixed values.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = frozenset(SPACE)
PIECE, RUN = 1 << 16, 1000
LONG_RUN = re.compile(f"[{SPACE}]{{{RUN},}}")
BOUNDARY = re.compile(f"[^{SPACE}](?=[{SPACE}])")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(enc: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of one text of any length."""
    if len(text) <= PIECE and not (SPACES.intersection(text[:: RUN // 2]) and LONG_RUN.search(text)):
        return enc.encode_ordinary(text)
    ids: list[int] = []
    start = 0
    while start < len(text):
        cut = BOUNDARY.search(text, start + PIECE)
        stop = cut.end() if cut else len(text)
        at = start
        for run in LONG_RUN.finditer(text, start, stop):
            ids += enc.encode_ordinary(text[at : run.start()])
            at = run.end() if run.end() == len(text) else run.end() - 1
            ids += enc._encode_single_piece(text[run.start() : at])
        ids += enc.encode_ordinary(text[at:stop])
        start = stop
    return ids


def id_bytes(enc: tiktoken.Encoding, text: str) -> bytes:
    """The ids of a text as little-endian unsigned 32-bit numbers."""
    return np.array(encode_text(enc, text), "<u4").tobytes()


def encode(text: str | Column, rank_file: str, pattern: str) -> Column:
    """Column of the ids of a text column, ``array<int>``; null texts have no ids."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        enc = encoding(rank_file, pattern)
        each = [np.array(encode_text(enc, t.as_py() or ""), np.int32) for t in texts]
        offsets = np.zeros(len(each) + 1, np.int32)
        np.cumsum([len(x) for x in each], out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(each) if each else np.zeros(0, np.int32)))

    return ids(text_or_empty(text))


def decode(ids: str | Column, rank_file: str, pattern: str) -> Column:
    """Column of the raw bytes of an id column; null for null."""

    @F.arrow_udf("binary")
    def raw(lists: pa.Array) -> pa.Array:
        enc = encoding(rank_file, pattern)
        return pa.array([enc.decode_bytes(x.values.to_numpy().tolist()) if x.is_valid else None for x in lists], pa.binary())

    return raw(F.col(ids) if isinstance(ids, str) else ids)


def round_trip(documents: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """``documents`` with ``ids`` and the bytes ``decoded`` from them (both replaced if present)."""
    return documents.withColumn("ids", encode(text, rank_file, pattern)).withColumn("decoded", decode("ids", rank_file, pattern))


def op3_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    coded = round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
