import collections
import zlib

import numpy as np
import pytest

from tidemark.llm.shards import OVERHEAD, op13_shards, place, shard_documents


def told(df):
    return df.toPandas().sort_values(["doc_id", "shard", "slot"])


def check(rows, out, shards):
    """The law of the contract, by plain counting."""
    want = collections.Counter((d, len((t or "").encode()) + OVERHEAD, zlib.crc32((t or "").encode())) for d, t in rows)
    assert collections.Counter(zip(out.doc_id.tolist(), out["size"].tolist(), out.text_crc32.tolist())) == want
    assert set(out.law) <= {"bytes"} and out.grown_shard.isna().all()
    for s, slots in out.groupby("shard").slot:
        assert 0 <= s < shards and sorted(slots) == list(range(len(slots)))


def test_place_takes_the_highest_dot_product():
    items = np.array([[8, 1, 1], [1, 8, 1], [1, 1, 8], [5, 5, 5], [3, 3, 3]], float)
    left = np.ones((2, 3))
    shares, want = items * 2 / items.sum(0), {}
    for k in sorted(range(5), key=lambda k: -(shares[k] @ (16, 4, 1))):
        dots = [16 * a[0] * shares[k][0] + 4 * a[1] * shares[k][1] + a[2] * shares[k][2] for a in left]
        want[k] = dots.index(max(dots))
        left[want[k]] -= shares[k]
    assert place(items, 2).tolist() == [want[k] for k in range(5)]


def test_query(spark, middle):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{middle}/documents.parquet").collect()]
    out = told(op13_shards(spark, middle))
    check(rows, out, 40)
    by = out.groupby("shard").agg(size=("size", "sum"), tokens=("tokens", "sum"), n=("slot", "count"))
    assert set(by.index) == set(range(40))
    assert (by["size"] / by["size"].mean()).sub(1).abs().max() < 0.03
    assert (by["tokens"] / by["tokens"].mean()).sub(1).abs().max() < 0.1 and np.ptp(by["n"]) <= 2
    texts = dict(rows)
    homes = out.groupby(out.doc_id.map(texts).fillna("")).shard.nunique()
    assert homes.max() == 1


def test_hot_group_is_cut_and_others_stay_whole(docs):
    rows = [(k, "the same words again") for k in range(400)] + [(1000 + k, f"text {k // 2} of two copies") for k in range(600)]
    out = told(shard_documents(docs(rows), 10))
    check(rows, out, 10)
    counts = out.groupby("shard").slot.count()
    assert counts.max() - counts.min() <= 6
    homes = out[out.doc_id >= 1000].groupby(out.doc_id // 2).shard.nunique()
    assert homes.max() == 1


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, None), (1, None), (2, ""), (None, "x"), (None, "x"), (3, " \n"), (4, "é" * 100_000)]])
def test_odd_rows(docs, rows):
    out = shard_documents(docs(rows), 4).toPandas()
    assert len(out) == len(rows)
    for s, slots in out.groupby("shard").slot:
        assert 0 <= s < 4 and sorted(slots) == list(range(len(slots)))
    assert out["size"].sum() == sum(len((t or "").encode()) + OVERHEAD for _, t in rows)


def test_bad_parameters(docs):
    with pytest.raises(ValueError):
        shard_documents(docs([]), 0)
