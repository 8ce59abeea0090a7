import collections
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import phrases
from tidemark.llm.automata import CountAutomaton
from tidemark.llm.phrases import Words, collocations, op12_collocations, sift_shards

KEYS = st.dictionaries(st.lists(st.binary(max_size=2), min_size=1, max_size=4).map(tuple), st.integers(1, 5), max_size=30)


def automaton(counted):
    return CountAutomaton.build(sorted(counted.items()))


@settings(max_examples=60, deadline=None)
@given(KEYS, KEYS, st.integers(1, 4))
def test_automata(a, b, least):
    x, y = automaton(a), automaton(b)
    assert list(x) == sorted(a.items())
    assert dict(CountAutomaton.from_bytes(x.to_bytes())) == a
    both = collections.Counter(a) + collections.Counter(b)
    assert dict(CountAutomaton.union([x, y], least)) == {k: n for k, n in both.items() if n >= least}
    assert list(x.compose(y)) == sorted((k, n) for k, n in a.items() if k in b)


def test_automaton_is_minimal():
    same = automaton({(bytes([p]), b"x", bytes([s])): 3 for p in range(5) for s in range(7)})
    assert len(same.states) == 1 + 4
    with pytest.raises(ValueError):
        CountAutomaton.build([((b"b",), 1), ((b"a",), 1)][::-1][:1] * 2)


def test_grams_stay_within_pieces():
    words = Words(pa.array(["A b\tc. a  b c", "", "b c\nd"]), ["en", "en", "de"])
    (_, _), (at, code) = words.grams(2, [])
    assert [words.key(k, 2) for k in at.tolist()] == [(b"en", b"a", b"b"), (b"en", b"b", b"c"), (b"en", b"a", b"b"), (b"en", b"b", b"c"), (b"de", b"b", b"c")]
    assert code[0] == code[2] and code[1] == code[3] and len(np.unique(code)) == 3


def brute(rows, least, longest, top):
    f, n = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    found = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    out = collections.defaultdict(list)
    for (lang, p), a in found.items():
        m = len(p)
        if any(g == lang and len(q) > m and b >= a and any(q[i : i + m] == p for i in range(len(q) - m + 1)) for (g, q), b in found.items()):
            continue
        score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, m))
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, rank, p.decode(), -a, x, y, n[lang], -s) for lang, v in out.items() for rank, (s, a, p, x, y) in enumerate(sorted(v)[:top], 1))


def found(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


def frame(spark, rows):
    names = "text string, lang string, doc_id bigint, range string, counts string, part string, phrase string, n string"
    return spark.createDataFrame([(*r, None, *["x"] * 5) for r in rows], names)


def test_query(spark, middle):
    rows = [(r.text, r.lang) for r in spark.read.parquet(f"{middle}/documents.parquet").collect()]
    got = found(op12_collocations(spark, middle))
    assert got and got == brute(rows, 100, 5, 2000)


def test_odd_texts(spark):
    rows = [
        ("New York is big. new  york, NEW\tYORK", "en"), ("new york is big", "en"), (None, "en"), ("", None), ("a a a a a a", None), ("a a a", None),
        ("é ß É ß\x00 é ß é ß", "fr"), ("  x y x y z x y z", "fr"), ("one\ntwo\rthree\x0bfour one\ntwo", "en\n x"), ("is big; is big", "en"),
        ("w " * 5000 + "end", "long"), (" \t ", "en"), ("b a b a b a b a", "de"), ("b a b a", "de"), ("b a b a", "de"),
    ]
    assert found(collocations(frame(spark, rows), 2, 5, 5)) == brute(rows, 2, 5, 5)
    assert found(collocations(frame(spark, rows), 3, 2, 2000)) == brute(rows, 3, 2, 2000)


@pytest.mark.parametrize("rows", [[], [(None, None)], [("only one each", "en")], [("word " * 3, "en")]])
def test_nothing_frequent(spark, rows):
    assert found(collocations(frame(spark, rows))) == []


def test_sifting_a_large_batch_takes_little_memory():
    """Several tasks share an executor, so the work arrays must not grow with the batch."""
    rnd = random.Random(1)
    words = ["".join(rnd.choices("abcdefghij", k=6)) for _ in range(5000)]
    texts = [" ".join(rnd.choices(words, k=300)) for _ in range(6000)]
    batch = pa.record_batch({"text": texts, "lang": ["en"] * len(texts)})
    tracemalloc.start()
    rows = sum(x.num_rows for x in sift_shards(2, 8, [])(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows and peak < 120 << 20


class Told:
    def __init__(self, value):
        self.value = value


def sorted_rows(batches, by):
    rows = [r for b in batches for r in b.to_pylist()]
    return sorted(rows, key=lambda r: r[by])


def counted(tasks, ranges, longest, least):
    """The n-grams of all tasks with their counts, and the number of keys that were put into transducers."""
    every = [Told(np.full(1 << 13, 255, np.uint8))] * longest
    shards = sorted_rows([b for t in tasks for b in phrases.shard_counts(ranges, every)(iter([t]))], "range")
    grams = sorted_rows(phrases.counted_once(least, ranges)(iter([pa.RecordBatch.from_pylist(shards, phrases._COUNTED)])), "range")
    names = {"range": pa.int32(), "lang": pa.string(), "words": pa.binary(), "count": pa.int64(), "total": phrases._TOTAL}
    tables = list(phrases.transducers(iter([pa.RecordBatch.from_pylist(grams, pa.schema(list(names.items())))])))
    keys = [k for b in tables for k in phrases.keys_of(b)]
    return dict(keys), len(keys), sum(r["words"] is not None for r in grams)


def test_a_phrase_of_every_task_is_one_key():
    """However many tasks have a phrase, one key of it is built."""
    texts = ["new york is big. new  york, NEW\tYORK", "é ß é ß \x00 é"]
    tasks = [pa.record_batch({"text": texts, "lang": ["en", "fr\nx"]}) for _ in range(12)]
    got, keys, rows = counted(tasks, 8, 2, 24)
    assert got[b"en", b"new", b"york"] == 36 and got["fr\nx".encode(), "é".encode(), "ß".encode()] == 24
    assert (b"en", b"york") in got and (b"en", b"york", b"is") not in got
    assert keys == rows == len(got)


def test_phrases_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(phrases, "mix", lambda x: x * np.uint64(0) + np.uint64(7))
    tasks = [pa.record_batch({"text": [x], "lang": ["en"]}) for x in ("a", "b", "a", "bc", "a", "b")]
    assert counted(tasks, 2, 1, 1)[0] == {(b"en", b"a"): 3, (b"en", b"b"): 2, (b"en", b"bc"): 1}
