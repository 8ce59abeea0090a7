"""Byte-level BPE, packing and token counts."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from tidemark.llm import bpe, counting, packing

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


@pytest.fixture(scope="module")
def packer():
    """As the packing query's contract names it: strings of special tokens become these."""
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


ODD = ["", " ", "  ", "a", "a  b", "a   b\n c", " \n\n x ", "'s 're", "\x1c a", "a\x85 b", "tab\t x", "　 a", "<|endoftext|>", "\U0001f600é日本", "x" * 300_000,
       " " * 5000 + "a", "a" + " \n" * 3000, "b " + "\n" * 4000 + "c d", ("word, " * 30_000) + " " * 2500, "\t" * 1500]


@pytest.mark.parametrize("text", ODD, ids=range(len(ODD)))
def test_long_and_odd_texts_encode_as_the_library_does(library, text):
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    ids = bpe.encode_text(enc, text)
    assert ids == library.encode(text, add_special_tokens=False).ids
    assert enc.decode_bytes(ids) == text.encode()


def test_round_trip_query(spark, small, library):
    import pyarrow.parquet as pq

    texts = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{small}/documents.parquet").to_pylist()}
    got = bpe.op3_byte_bpe(spark, small).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_null_ids_and_partial_characters(spark, docs):
    rows = docs([(1, None), (None, "é"), (2, ""), (2, "")])
    got = bpe.round_trip(rows, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r.doc_id or 0, len(r.ids), bytes(r.decoded)) for r in got) == [(0, 1, "é".encode()), (1, 0, b""), (2, 0, b""), (2, 0, b"")]
    some = spark.createDataFrame([([101],), (None,)], "ids array<int>").select(bpe.decode("ids", RANKS, public_tokenizers.PATTERN).alias("b"))
    enc = bpe.encoding(RANKS, public_tokenizers.PATTERN)
    assert [r.b and bytes(r.b) for r in some.collect()] == [enc.decode_bytes([101]), None]
    assert bpe.round_trip(docs([]), RANKS, public_tokenizers.PATTERN).count() == 0


def packed_ok(pieces, texts, library, capacity=2048):
    """Every piece is right and every sequence gapless; returns the number of sequences."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == {d for d, _ in texts}
    for d, text in texts:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[d], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r.start == at and 0 < r.length <= capacity
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
        assert len(own) == -(-len(ids) // capacity) and all(r.length == capacity for r in own[1:])
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing_query(spark, small, packer):
    import pyarrow.parquet as pq

    texts = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{small}/documents.parquet").to_pylist()]
    pieces = packing.op5_best_fit_packing(spark, small).collect()
    n = packed_ok(pieces, texts, packer)
    least = -(-sum(r.length for r in pieces) // 2048)
    assert n <= least + 2


def test_packing_odd_rows(docs, packer):
    texts = [(1, None), (2, ""), (3, "a b c"), (4, " ".join(["word"] * 9000)), (5, " ".join(["word"] * 2047)), (6, " ".join(["word"] * 2048)), (None, "x"),
             (8, "<|endoftext|>"), (9, "one<|endoftext|> two <|endoftext|><|endoftext|>\n\nthree"), (10, "<|endoftext| >"), (11, "ab <|endoftext|>" * 400)]
    pieces = packing.packed_documents(docs(texts)).collect()
    packed_ok(pieces, texts, packer)
    repeated = packing.packed_documents(docs([(7, "the same"), (7, "the same")])).collect()
    assert sorted((r.doc_id, r.offset) for r in repeated) == [(7, 0), (7, 3)] and len({r.sequence_id for r in repeated}) == 1
    assert packing.packed_documents(docs([])).count() == 0


def test_a_length_that_many_share_is_dealt_over_groups(docs, packer, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 7)
    texts = [(k, "same text") for k in range(300)] + [(1000 + k, "other " * (k % 40)) for k in range(100)]
    pieces = packing.packed_documents(docs(texts), capacity=64).collect()
    n = packed_ok(pieces, texts, packer, 64)
    assert n <= -(-sum(r.length for r in pieces) // 64) + 1


def test_plan_prefers_exact_complements():
    assert packing.plan({10: 1, 6: 2, 4: 1, 3: 1, 1: 1, 2: 1}, 10) == [([10], 1), ([6, 4], 1), ([6, 3, 1], 1), ([2], 1)]
    assert packing.plan({5: 1, 2: 1, 3: 1}, 10) == [([5, 3, 2], 1)]
    assert packing.plan({4: 1, 3: 1, 2: 1, 1: 1}, 10) == [([4, 3, 2, 1], 1)]
    random.seed(3)
    for _ in range(30):
        counts = Counter(random.choices(range(1, 41), k=random.randint(1, 200)))
        used = Counter()
        for lengths, times in packing.plan(dict(counts), 40):
            assert sum(lengths) <= 40 and times > 0
            for n in lengths:
                used[n] += times
        assert used == counts


def enumerated(pieces, unknown, word):
    """The best segmentation by trying all: its score, and the counts that may come with it."""
    best = None
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        edges = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(word)]
        score, n = 0.0, 0
        for a, b in zip(edges, edges[1:]):
            part = word[a:b]
            if part in pieces:
                score, n = score + pieces[part], n + 1
            elif b - a == 1:
                score, n = score + unknown, n + len(part.encode())
            else:
                break
        else:
            if best is None or score > best[0]:
                best = (score, {n})
            elif score == best[0]:
                best[1].add(n)
    return best


def test_counts_equal_the_best_of_all_segmentations():
    random.seed(5)
    m = counting.MARK
    for _ in range(60):
        pieces = {m: -9.0, **{"".join(random.choices("abé", k=random.randint(1, 4))): -float(random.randint(1, 12)) for _ in range(12)}, m + "a": -2.0}
        words = counting.Vocabulary(pieces)
        for _ in range(25):
            word = m + "".join(random.choices("abéz", k=random.randint(0, 8)))
            assert words.segment(word)[0] in enumerated(pieces, words.unknown, word)[1], (pieces, word)


def test_tie_goes_to_the_piece_that_begins_first():
    words = counting.Vocabulary({"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, "▁a": -2.0})
    assert words.count("ab") == (2, 0)  # ▁|ab, not ▁a|b or ▁|a|b
    assert words.count("z") == (2, 1) and words.count("é") == (3, 2)


def as_unigram(path):
    """The model file with its type set to unigram, for the library."""
    raw = open(path, "rb").read()

    def number(b, i):
        n = shift = 0
        while True:
            n |= (b[i] & 127) << shift
            i, shift = i + 1, shift + 7
            if b[i - 1] < 128:
                return n, i

    out, at = b"", 0
    while at < len(raw):
        key, after = number(raw, at)
        size, body = number(raw, after)
        block = raw[body : body + size]
        if key >> 3 == 2:
            block = block.replace(b"\x18\x02 \x80\xfa\x01", b"\x18\x01 \x80\xfa\x01", 1)
            assert len(block) == size
        out += raw[at:body] + block
        at = body + size
    return out


def test_counts_equal_the_library_where_its_sums_are_exact(small):
    import pyarrow.parquet as pq
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_proto=as_unigram(path))
    words = counting.vocabulary(path)
    texts = [t[:120].replace("\n", " ") for t in pq.read_table(f"{small}/documents.parquet").column("text").to_pylist() if t]
    texts = [t for t in [*texts, "hello world", "the", "an only"] if words.count(t)[1] == 0 and "  " not in t and not t.endswith(" ")]
    assert len(texts) > 100
    assert [words.count(t)[0] for t in texts] == [len(library.nbest_encode_as_pieces(t, 2)[0]) for t in texts]


def test_count_query_and_odd_rows(spark, docs, small):
    got = {r.doc_id: r for r in counting.op8_token_counts(spark, small).collect()}
    assert len(got) == 200 and all(r.n_tokens > 0 for r in got.values())
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = docs([(1, None), (2, ""), (3, "q" * 50_000), (None, "a b"), (3, "a b"), (3, "a b")])
    counted = [r.c for r in rows.select(counting.token_counts("text", path).alias("c")).collect()]
    assert counted[0].n_tokens == counted[1].n_tokens == 0 and counted[2].n_tokens > 1000
    assert counted[3] == counted[4] == counted[5]
    assert docs([]).select(counting.token_counts("text", path)).count() == 0
