"""Near-duplicate documents, lines and vectors, and connected components, against plain versions."""

import random
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
from brute import lost_lines, near_duplicates, removed_lines, rows_of
from pyspark.sql import functions as F

from tidemark.llm import common, lines, neardup, vectors, words


def test_components(spark):
    random.seed(2)
    links = [(random.randint(0, 400), random.randint(0, 400)) for _ in range(230)]
    links += [(1000, k) for k in range(1001, 1200)] + [(k, k + 1) for k in range(2000, 2060)] + [(5, 5), (None, 7), (2000, 2001)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            low, high = sorted((top(a), top(b)))
            up[high] = low
    frame = spark.createDataFrame(links, "a bigint, b bigint")
    assert {r.node: r.component for r in common.components(frame).collect()} == {x: top(x) for x in list(up)}
    assert common.components(frame.limit(0)).count() == 0


def test_word_hashes_depend_on_the_word_alone():
    texts = pa.array(["a b  a", "", "b\ta", "ab", " a", "é a"])
    data, offsets = words.byte_runs(texts.slice(0))
    hashes, first = words.word_hashes(data, offsets, neardup._LOWER)
    assert first.tolist() == [0, 3, 3, 5, 6, 7, 9]
    a, b = hashes[0], hashes[1]
    assert hashes.tolist()[2:5] == [a, b, a] and hashes[6] == a and hashes[8] == a
    assert len({int(h) for h in hashes}) == 4
    again = words.word_hashes(*words.byte_runs(texts.slice(2, 3)), neardup._LOWER)
    assert again[0].tolist() == hashes[3:7].tolist()


def family(seed, n, size=60, change=2):
    """Copies of one text, each with some words replaced."""
    rnd = random.Random(seed)
    base = [f"w{seed}x{k}" for k in range(size)]
    out = []
    for _ in range(n):
        copy = list(base)
        for k in rnd.sample(range(size), rnd.randint(0, change)):
            copy[k] = f"c{rnd.randint(0, 10**9)}"
        out.append(" ".join(copy))
    return out


SPECIAL = [None, "", " \n\t", "one", "ONE", "two words", "Two  words", "x y z", "\x1c y", "\x00 y", "\x01 y", "w " * 30_000, "w " * 30_001, "é É"]


def got_duplicates(frame):
    return sorted((tuple(r) for r in neardup.near_duplicates(frame).collect()), key=lambda r: (r[0] is None, r[0] or 0, str(r)))


def test_near_duplicates_of_odd_rows(docs):
    rows = list(enumerate([*SPECIAL, *family(1, 12), *family(2, 5, change=9)]))
    random.Random(1).shuffle(rows)
    odd = [rows[0], rows[0], (None, "two words"), (None, "two words")]
    got = got_duplicates(docs(rows + odd))
    assert len(got) == len(rows) + 4
    assert {d: (n, c, k) for d, n, c, k in got if d is not None} == near_duplicates(rows)
    assert [r[1:] for r in got if r[0] is None] == [(1, None, True)] * 2


def test_rows_of_one_id_with_different_texts(docs):
    rows = [(4, "a b c"), (2, "a b c"), (9, "d e f"), (4, "d e f")]
    assert got_duplicates(docs(rows)) == [(2, 2, 2, True), (4, 2, 2, False), (4, 2, 4, True), (9, 2, 4, False)]
    assert got_duplicates(docs([])) == []


def test_large_groups_go_through_tiles(docs, monkeypatch):
    for name, value in (("TILE", 10), ("LEAF", 5), ("PIVOTS", 2)):
        monkeypatch.setattr(neardup, name, value)
    texts = [*family(3, 90, change=5), *family(4, 40, change=9), *family(5, 30, size=30, change=4)]
    rows = list(enumerate(texts, 100))
    assert {d: (n, c, k) for d, n, c, k in got_duplicates(docs(rows))} == near_duplicates(rows)


def test_near_duplicate_query(spark, small):
    rows = rows_of(small)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.op10_minhash_near_dedup(spark, small).collect()}
    assert got == near_duplicates(rows)


def check_lines(frame, rows):
    gone = removed_lines(rows, 10**6)
    got = {r.doc_id: r for r in lines.dedup_lines(frame).collect()}
    assert len(got) == len(rows)
    for d, text in rows:
        kept = None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[d])
        assert got[d].text == kept and got[d].n_removed == len(gone[d]), d
        assert got[d].n_lines == (text.count("\n") + 1 if text else 0)
        assert got[d].component == "x"


def test_lines(docs):
    text = " ".join(f"word{k % 40}" for k in range(120))
    rows = [
        (9, f"{text}\nEin Satz.\n\n--\n{text} more"), (2, f"first\n{text}!\nein  SATZ"), (3, None), (4, ""), (5, "\n\n"), (6, "a1 b2"), (7, "A9, b7!\nx\nx\r\nx"),
        (8, text.replace("word7 ", "word8 ", 1)), (10, "Élan vital\nélan  vital"), (11, "tail\n"), (12, "tail"), (13, "9 lives\n7 lives\n" + "y " * 70_000), (-1, "tail\nown"),
    ]
    check_lines(docs(rows), rows)
    repeated = lines.dedup_lines(docs([(1, "a\nb\na"), (1, "a\nb\na"), (None, "b")])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in repeated) == [(0, "b"), (1, "a"), (1, "a")]


def test_many_variants_of_a_line(docs):
    rnd = random.Random(9)
    base = [f"w{k % 30}" for k in range(90)]
    rows = []
    for d in range(40):
        copy = list(base)
        copy[rnd.randrange(60, 90)] = f"c{d}"
        rows.append((d, " ".join(copy)))
    check_lines(docs(rows), rows)


def edited_lines(n, seed):
    """Pairs of a line of 3 to 100 words and a copy with words or letters replaced, with their edit similarity."""
    from brute import distance

    rnd = random.Random(seed)

    def word():
        return "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randint(2, 10)))

    out = []
    for k in range(n):
        words = [word() for _ in range((3, 5, 8, 20, 40, 100)[k % 6])]
        copy = list(words)
        if k % 4:
            for p in rnd.sample(range(len(words)), max(1, len(words) * (k % 3 + 1) // 20)):
                copy[p] = word()
            copy = " ".join(copy)
        else:
            letters = list(" ".join(words))
            for p in rnd.sample([i for i, c in enumerate(letters) if c != " "], max(1, len(letters) // 15)):
                letters[p] = "q"
            copy = "".join(letters)
        line = " ".join(words)
        out.append((line, copy, 1 - distance(line, copy) / max(len(line), len(copy))))
    return out


def test_lines_of_edit_similarity_are_found_without_a_fingerprint(docs):
    pairs = edited_lines(600, 5)
    rows = [(k, line) for k, (line, _, _) in enumerate(pairs)] + [(1000 + k, copy) for k, (_, copy, _) in enumerate(pairs)]
    got = {r.doc_id: r.n_removed for r in lines.dedup_lines(docs(rows)).collect()}
    near = [k for k, (_, _, s) in enumerate(pairs) if s >= 0.8]
    assert len(near) > 450
    assert sum(got[1000 + k] for k in near) >= 0.97 * len(near)
    assert all(got[d] == 0 for d in got if d < 1000 or d - 1000 not in near)


def test_a_worker_gives_free_memory_back():
    def resident():
        return int(open("/proc/self/statm").read().split()[1]) * 4096

    def make(batches):
        for batch in batches:
            held = [bytes(3000) for _ in range(50_000)]
            last = bytes(3000)  # keeps what was before it from being given back by itself
            del held
            yield batch
        del last

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], names=["a"])
    run = common.giving_back(make)(iter([batch, batch]))
    assert next(run) is batch
    before = resident()
    assert list(run) == [batch] and resident() < before - (50 << 20)


def syllable_lines(n, seed, least, most):
    """Lines of words of a few syllables, as the given documents have them."""
    r = random.Random(seed)
    parts = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    usual = ["".join(r.choices(parts, k=r.randint(1, 2))) for _ in range(60)]
    out = []
    for _ in range(n):
        size, line = r.randint(least, most), ""
        while len(line) < size:
            line += (r.choice(usual) if r.random() < 0.6 else "".join(r.choices(parts, k=r.randint(1, 4)))) + " "
        out.append(line.strip())
    return out


def candidates_of(docs, rows):
    found = lines.line_rows(docs(rows).withColumn("row", F.col("doc_id"))).where("keys IS NOT NULL")
    blocks = lines.block_rows(found.select(F.col("doc_id").alias("id"), "keys", "print", "more", "third"), lines.HOT)
    return {(min(p), max(p)) for p in lines.compared(blocks, False).where("print IS NULL").select("a", "b").collect()}


def test_unrelated_lines_of_the_same_syllables_are_seldom_compared(docs):
    rows = list(enumerate(syllable_lines(1200, 3, 500, 900)))
    found = lines.line_rows(docs(rows).withColumn("row", F.col("doc_id"))).select("doc_id", F.explode("keys").alias("key"))
    pairs = found.alias("a").join(found.alias("b"), "key").where("a.doc_id < b.doc_id").select("a.doc_id", "b.doc_id").distinct()
    assert pairs.count() < 30_000


def test_lines_with_letters_replaced_are_compared(docs):
    """Lines of 140 to 300 code points of which one in twelve is another."""
    r = random.Random(8)
    first = syllable_lines(400, 4, 140, 300)
    copies = ["".join(r.choice("abcdefghijklmnop") if c != " " and r.random() < 1 / 12 else c for c in x) for x in first]
    got = candidates_of(docs, list(enumerate(first)) + [(1000 + k, x) for k, x in enumerate(copies)])
    assert sum((k, 1000 + k) in got for k in range(400)) > 340


def test_the_kinds_of_blocks_overlap_where_lines_can_be_near(docs):
    """Pairs of a shorter and a longer line about the length at which the kind of blocks changes."""
    longer = syllable_lines(200, 6, lines.LINE, lines.LINE + 8)
    rows = [(k, x) for k, x in enumerate(longer)] + [(1000 + k, x[: lines.LINE - 1 - k % 3]) for k, x in enumerate(longer)]
    near = [k for k, x in enumerate(longer) if lines.alike(x, lines.normalised(rows[200 + k][1]))]
    got = candidates_of(docs, rows)
    assert len(near) > 100 and sum((k, 1000 + k) in got for k in near) > 0.95 * len(near)


def test_line_query(spark, small):
    """Against a join of all lines at edit similarity 0.8: nothing else goes, and nearly all of it does."""
    rows = rows_of(small)
    gone = removed_lines(rows)
    got = {r.doc_id: r for r in lines.op2_line_dedup(spark, small).collect()}
    lost = {d: lost_lines(text, got[d].text) for d, text in rows}
    assert all(lost[d] <= gone[d] for d, text in rows if max(map(len, (text or "").split("\n"))) <= 6000)
    assert sum(map(len, lost.values())) >= 0.97 * sum(map(len, gone.values()))
    assert {d: got[d].n_removed for d, _ in rows} == {d: len(x) for d, x in lost.items()}


def test_edit_distance():
    from brute import distance

    rnd = random.Random(1)
    for _ in range(1500):
        a, b = ("".join(rnd.choices("abé", k=rnd.randint(0, 12))) for _ in range(2))
        assert lines.edit_distance(a, b) == distance(a, b)


def brute_vectors(rows, least=0.98):
    good = {}
    for k, (v, e, label) in enumerate(rows):
        x = None if v is None or e is None or label is None or not len(e) or None in e else np.array(e, np.float64)
        if x is not None and np.isfinite(x).all() and x.any():
            good[k] = x / np.abs(x).max()
    links = {k: set() for k in range(len(rows))}
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(good[a]) == len(good[b]):
                x, y = good[a], good[b]
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                    links[a].add(b)
                    links[b].add(a)
    out = []
    for k, (v, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        part = v if v is None else min(rows[n][0] for n in seen)
        out.append((v, len(links[k]), part, v is None or v == part))
    return sorted(out, key=lambda r: (r[0] is None, r))


def vector_frame(spark, rows):
    names = "vec_id bigint, embedding array<float>, label int, component string, unit string, cell string"
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], names)


def test_vectors(spark, tile=7):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(12):
        centre = rng.normal(size=20)
        for _ in range(15):
            rows.append((len(rows), [float(np.float32(x)) for x in centre + rng.normal(size=20) * rng.choice([0.02, 0.1, 0.2])], c % 3))
    rows += [(500, rows[0][1], 0), (501, [2 * x for x in rows[0][1]], 0), (502, [-x for x in rows[0][1]], 0), (503, rows[0][1], 1), (504, rows[0][1], None)]
    rows += [(505, None, 1), (506, [], 1), (507, [0.0] * 20, 1), (508, [float("nan")] + [1.0] * 19, 1), (509, [None] + [1.0] * 19, 1), (510, [float("inf")] * 20, 1)]
    rows += [(511, [1.0, 2.0], 1), (512, [1.0, 2.0], 1), (513, [1e30, 1e30], 2), (514, [1e-30, 1e-30], 2), (None, rows[0][1], 0), (515, [3.0], 0), (516, [-3.0], 0)]
    got = sorted((tuple(r) for r in vectors.near_vectors(vector_frame(spark, rows), tile=tile).collect()), key=lambda r: (r[0] is None, r))
    assert got == brute_vectors(rows)


def test_vectors_of_no_rows(spark):
    assert vectors.near_vectors(vector_frame(spark, [(1, [1.0], 0)]).limit(0)).count() == 0
    twice = vectors.near_vectors(vector_frame(spark, [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (0, [1.0, 2.1], 0)])).collect()
    assert sorted(tuple(r) for r in twice) == [(0, 2, 0, True), (1, 2, 0, False), (1, 2, 0, False)]


def test_vectors_of_one_id(spark):
    """Different vectors under one id are classes of their own: each keeps its links."""
    rows = [(5, [1.0, 0.0, 0.0], 1), (5, [0.0, 1.0, 0.0], 1), (0, [1.0, 0.01, 0.0], 1), (2, [0.01, 1.0, 0.0], 1), (9, [0.0, 0.0, 1.0], 1)]
    got = sorted(tuple(r) for r in vectors.near_vectors(vector_frame(spark, rows)).collect())
    assert got == [(0, 1, 0, True), (2, 1, 2, True), (5, 1, 0, False), (5, 1, 0, False), (9, 0, 9, True)]


def test_vector_query_against_sql(spark, small):
    import pyarrow.parquet as pq

    embeddings = pq.read_table(f"{small}/embeddings.parquet")  # noqa: F841
    expected = sorted(duckdb.sql(vectors.OP7_SQL).fetchall())
    assert sorted(tuple(r) for r in vectors.op7_embedding_near_dedup(spark, small).collect()) == expected


def test_distances_of_many_pairs():
    from brute import distance

    rnd = random.Random(3)
    pairs = []
    for k in range(400):
        a = "".join(rnd.choices("abcdé 0", k=rnd.randint(1, 200)))
        b = "".join(c if rnd.random() > 0.15 else rnd.choice("xyz") for c in a) if k % 2 else "".join(rnd.choices("abcdé 0", k=rnd.randint(1, 200)))
        pairs.append((a, b) if len(a) <= len(b) else (b, a))
    codes = [[np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in side] for side in zip(*pairs)]
    want = np.array([distance(a, b) for a, b in pairs])
    assert (lines.distances(*codes, np.full(400, 1e9)) == want).all()
    most = np.array([0.2 * len(b) for _, b in pairs])
    got = lines.distances(*codes, most)
    assert ((got <= most) == (want <= most)).all() and (got == want)[want <= most].all()
    assert (lines.all_alike(pairs) == (want <= most + 1e-9)).all() and (want <= most).any()


def test_wide_lines_are_compared_together(monkeypatch):
    """Lines of any usual length go through arrays, of bounded size; the plain way one pair at a time is for the last few."""
    from brute import distance

    rnd = random.Random(6)

    def line(n):
        return " ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(n))

    def edited(text, share):
        return "".join(rnd.choice("xyz") if rnd.random() < share else c for c in text)

    def one_by_one(a, b):
        raise AssertionError(f"compared alone: {len(a)}, {len(b)}")

    wide = [(a, edited(a, (0.02, 0.17, 0.2, 0.23)[k % 4]) if k % 5 else line(240)) for k, a in enumerate(line(240) for _ in range(40))]
    want = [distance(a, b) <= 0.2 * max(len(a), len(b)) for a, b in wide]
    assert min(len(a) for a, _ in wide) > 1200 and 5 < sum(want) < 35
    with monkeypatch.context() as m:
        m.setattr(lines, "alike", one_by_one)
        assert lines.all_alike(wide).tolist() == want
    many = [(line(140), line(140)) for _ in range(2000)]
    tracemalloc.start()
    assert not lines.all_alike(many).any()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20


def sketched(n, seed, length=104, bits=3):
    """Lines (id, print, more, third, keys) of one block: SimHashes a few bits apart, or anywhere."""
    rnd = random.Random(seed)
    base = [rnd.getrandbits(56) for _ in range(5)]
    out = []
    for k in range(n):
        x = base[k % 5]
        for _ in range(bits if k % 3 else 40):
            x ^= 1 << rnd.randrange(56)
        code = length + k % 9
        out.append((k, x | code << 56, 0, 0, [7]))
    return out


def test_large_blocks_lose_no_candidate(spark):
    """Every line of a block meets every other that its SimHash lets through, however many they are and whatever their order,
    unless both are connected by then. Links here are pairs of an odd sum, so no line speaks for the others."""
    rows = sketched(700, 4)
    frame = spark.createDataFrame(rows, "id bigint, print bigint, more bigint, third bigint, keys array<int>")
    prints = np.array([r[1] for r in rows], np.uint64)
    zero = np.zeros(len(rows), np.uint64)
    a, b = np.triu_indices(len(rows), 1)
    near = lines.candidates(prints, zero, zero, a, b)
    want = {(int(x), int(y)) for x, y in zip(a[near], b[near])}
    got = {(min(p), max(p)) for part in lines.block_pairs(prints, zero, zero) for p in zip(*(lines_.tolist() for lines_ in part))}
    assert got == want and len(want) > 30 * lines.SMALL
    odd = [(x, y) for x, y in want if (x // 50 + y // 50) % 7 == 1]
    heads = list(range(len(rows)))

    def head(x):
        while heads[x] != x:
            x = heads[x]
        return x

    for x, y in odd:
        x, y = head(x), head(y)
        heads[max(x, y)] = min(x, y)
    linked = {x for p in odd for x in p}
    expected = {x: head(x) for x in linked}
    for most in (lines.HOT, 200):
        tried = []

        def confirm(pairs):
            tried.append(pairs.count())
            return pairs.where("(int(a / 50) + int(b / 50)) % 7 = 1")

        found = lines.linked_lines(frame, confirm, most)
        assert {r.node: r.component for r in found.collect()} == expected
        assert len(tried) == 2 and 0 < tried[0] <= 16 * len(rows) * (1 if most > 700 else 12)


def test_codes_of_very_long_lines_begin_anew():
    prints = np.array([(c % 256) << 56 for c in [*range(240, 270)] * 2], np.uint64)
    zero = np.zeros(len(prints), np.uint64)
    a, b = np.triu_indices(len(prints), 1)
    near = lines.candidates(prints, zero, zero, a, b)
    got = [(min(p), max(p)) for part in lines.block_pairs(prints, zero, zero) for p in zip(*(x.tolist() for x in part))]
    assert set(got) == set(zip(a[near].tolist(), b[near].tolist()))


def test_near_copies_of_a_line_give_few_pairs(docs):
    """Copies that are all near each other need no more pairs than connect them, and none is lost."""
    r = random.Random(12)
    words = syllable_lines(1, 12, 400, 420)[0].split()
    copies = {" ".join(r.choice(words) if r.random() < 0.03 else w for w in words) for _ in range(150)}
    rows = list(enumerate(sorted(copies)))
    assert len(rows) > 120 and len(candidates_of(docs, rows)) < 6 * len(rows)
    got = {x.doc_id: x.n_removed for x in lines.dedup_lines(docs(rows)).collect()}
    assert got[0] == 0 and sum(got.values()) == len(rows) - 1


def test_lines_that_share_more_blocks_may_differ_by_more_bits():
    """Unrelated lines that share one usual phrase meet in a block too."""
    one = int.from_bytes(bytes(range(1, 9)), "little")
    for shared, bits, want in ((1, 42, False), (1, 38, True), (2, 42, True), (2, 58, False), (4, 58, True), (4, 70, False)):
        other = int.from_bytes(bytes(k if k <= shared else 100 + k for k in range(1, 9)), "little")
        first = min(bits // 3, 14)
        prints = np.array([130 << 56, 130 << 56 | (1 << first) - 1], np.uint64)
        more = np.array([0, (1 << (bits - first)) - 1], np.uint64)
        third = np.array([1 << 32 | 2 << 40 | 3 << 48 | 4 << 56, 5 << 32 | 6 << 40 | 7 << 48 | 8 << 56], np.uint64)
        got = lines.candidates(prints, more, third, np.array([0]), np.array([1]), np.array([one, other], np.uint64))
        assert got.tolist() == [want], (shared, bits)


def test_texts_of_pairs_come_together_in_rounds(docs, monkeypatch):
    """However many pairs there are, the texts of a bounded number of them are joined at a time."""
    names, keep = [], lines.stored

    def stored(df, name):
        names.append(name)
        return keep(df, name)

    pairs = edited_lines(60, 9)
    rows = [(k, line) for k, (line, _, _) in enumerate(pairs)] + [(1000 + k, copy) for k, (_, copy, _) in enumerate(pairs)]
    want = {r.doc_id: r.n_removed for r in lines.dedup_lines(docs(rows)).collect()}
    assert sum(want.values()) > 40 and lines.rounds_of(10 * lines.AT_ONCE, 1000) == 10 and lines.rounds_of(0, 0) == 1
    monkeypatch.setattr(lines, "stored", stored)
    monkeypatch.setattr(lines, "rounds_of", lambda pairs, classes: 4)
    assert {r.doc_id: r.n_removed for r in lines.dedup_lines(docs(rows)).collect()} == want
    assert names.count("line-near") >= 4


def test_fine_prints_part_unrelated_lines():
    unrelated = syllable_lines(200, 31, 150, 400)
    r = random.Random(5)
    near = ["".join(r.choice("abcdefghij") if c != " " and r.random() < 0.1 else c for c in x) for x in unrelated]

    def kept(a, b):
        one, other = (list(map(bytes, lines.fine_prints(x))) for x in (a, b))
        batch = pa.record_batch({"a": list(range(len(a))), "b": list(range(len(a))), "one": pa.array(one, pa.binary()), "other": pa.array(other, pa.binary())})
        return sum(x.num_rows for x in lines.kindred(iter([batch])))

    assert kept(unrelated, near) == 200
    assert kept(unrelated, unrelated[1:] + unrelated[:1]) < 20
    assert kept(["abcde", "x" * 60, "ab cd é"], ["abcdf", "x" * 40, ""]) == 3
