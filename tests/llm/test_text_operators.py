"""Chat formatting, language identification, HTML extraction and fingerprints."""

import hashlib
import random
import unicodedata

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import chat, fingerprints, language, pages


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_any_text_and_role_survive_the_round_trip():
    random.seed(1)
    parts = ["<", "|", "\\", "turn", "end", ">", "\n", "a", chat.END, chat.TURN, "n"]
    for _ in range(5000):
        role, text = ("".join(random.choices(parts, k=random.randint(0, 7))) for _ in range(2))
        out, begin, stop = chat.format_turn(role, text)
        assert chat.parse(out) == [(role, text)] and chat.unescape(out[begin:stop]) == text
    assert chat.format_turn("user", "plain")[0] == "<|turn|>user\nplain<|end|>\n"
    assert chat.parse("no turn") is None and chat.parse("<|turn|>user\nopen") is None


def test_chat_rows(spark):
    names = "conv_id bigint, turn bigint, role string, text string, part string, loss string"
    long = "word <|end|>\n" * 20_000
    rows = [(1, 1, "assistant", long), (1, 0, "user", None), (2, None, None, "x"), (None, 0, "user", "n"), (3, 0, "assistant", "b"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a")]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], names)
    parts = chat.format_conversations(table, part_chars=1000)
    got = {r.conv_id: r for r in chat.read_back(parts).collect()}
    assert got[1].turns_sha256 == digest([("user", ""), ("assistant", long)])
    assert got[1].loss_chars == len(long) and got[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()
    assert got[2].turns_sha256 == digest([("", "x")]) and got[2].loss_chars == 0
    assert got[None].n_turns == 1
    assert got[3].n_turns == 3 and got[3].loss_sha256 == hashlib.sha256(b"aab").hexdigest()
    assert chat.read_back(chat.format_conversations(table.limit(0))).count() == 0


def test_parts_of_a_long_conversation(spark):
    rows = [(5, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(400)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    parts = chat.format_conversations(table, part_chars=500)
    assert parts.count() > 10
    (got,) = chat.read_back(parts).collect()
    assert got.n_turns == 400 and got.turns_sha256 == digest([(r, t) for _, _, r, t in rows])
    assert got.formatted_chars == sum(len(chat.format_turn(r, t)[0]) for _, _, r, t in rows)


def test_languages_held_out(spark, middle):
    got = language.op6_language_id(spark, middle)
    docs = spark.read.parquet(f"{middle}/documents.parquet").select("doc_id", "lang", "text")
    rows = got.join(docs, "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)
    assert not any(r.rejected for r in rows)


def test_language_rejects(spark, docs, middle):
    labelled = spark.read.parquet(f"{middle}/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(labelled)
    texts = ["", None, "12 .. 34 !", "слово и дело в русском языке", "The and thing of the other", "der die schung und das keit " * 20_000]
    said = [r.s for r in docs([(k, t) for k, t in enumerate(texts)]).orderBy("doc_id").select(language.identify("text", model).alias("s")).collect()]
    assert [s.lang_pred for s in said[:3]] == ["und"] * 3 and all(s.score == 0 and s.rejected for s in said[:3])
    assert said[3].rejected and not said[4].rejected
    assert [s.lang_pred for s in said[4:]] == ["en", "de"]
    nothing = language.fit(labelled.limit(0))
    assert nothing.predict("text") == ("und", 0.0, True)
    odd = language.fit(spark.createDataFrame([(None, "a b", "xx"), (1, None, "xx"), (2, "ab cd", None), (3, "...", "yy"), (4, "ab cd", "zz")], labelled.schema))
    assert odd.langs == ["zz"] and odd.predict("ab cd")[0] == "zz"


def test_letters_are_those_of_unicode():
    table = language._letters()
    for k in random.Random(2).sample(range(0x110000), 2000):
        assert (table[k] == k and k != 32) == unicodedata.category(chr(k)).startswith("L")


PAGE = '<html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>home</a></li></ul></nav>{}<footer>&copy; f</footer></body></html>'
CASES = [
    (PAGE.format("<div class='ad'>buy</div><article><h1>A &amp; b</h1><p>one\n two<br>three<p><b>fo</b>ur</p></article>"), "A & b one two three four"),
    (PAGE.format("<article><header><h1>Title</h1></header><p>x</p><aside>no</aside><div id='comments'><p>no</p></div><form>no</form>y</article>"), "Title x y"),
    (PAGE.format("<main><p>body &lt;b&gt; &#233;&#x2019;&nbsp;end</p></main><section class=sidebar>no</section>"), "body <b> é’ end"),
    (PAGE.format("<div role=main>m<!-- no --><noscript>no</noscript></div>"), "m"),
    (PAGE.format("<div><p>plain text</p><div class='cookie-notice'>no</div></div>"), "plain text"),
    ("<article>cut off <p>here", "cut off here"),
    ("<article>a<script>never closed", "a"),
    ("<article>a<!-- never closed", "a"),
    ("no markup, 1 < 2", "no markup, 1 < 2"),
    ("", ""),
    ("<article>" + "<p>w</p>" * 30_000 + "</article>", " ".join(["w"] * 30_000)),
]


@pytest.mark.parametrize(("html", "text"), CASES, ids=range(len(CASES)))
def test_main_text(html, text):
    assert pages.main_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<div style="overflow:hidden"><article><p>all</p></article></div>', "all"),
        ('<article><p><a href="/hidden-gems" title="hidden">gems</a> <span data-id="related">here</span></p></article>', "gems here"),
        ('<article><h2 id="related-work">Related</h2><section id="search"><p id=comments>on search</p></section></article>', "Related on search"),
        ("<article><p hidden>no</p><p HIDDEN=''>no</p><div id=comments>no</div><p aria-hidden='true'>no</p><h2 class='promo'>no</h2>yes</article>", "yes"),
        ("<div class = 'sidebar'>no</div><p data-x='class=\"ad\"'>yes</p><section id=related>no</section>", "yes"),
    ],
)
def test_attributes_are_read_whole(html, text):
    assert pages.main_text(html) == text


def test_template_of_a_host_without_article(spark):
    def page(k):
        return f"<html><body><div><p>Welcome to our site</p></div><div><p>story {k} about {k * k}</p><p>second part {k}</p></div><div><p>All rights reserved</p></div></body></html>"

    rows = [(k, f"http://one.example.com/{k}", page(k)) for k in range(6)]
    rows += [(50, "http://two.example.com/", page(50)), (51, None, None), (None, "", "<p>x</p>"), (6, "http://ONE.example.com:80/z", page(6)), (6, "http://ONE.example.com:80/z", page(6))]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, host string, token string")
    got = sorted(((r.page_id if r.page_id is not None else -1, r.text, r.n_chars) for r in pages.extract(table).collect()))
    expected = [(k, f"story {k} about {k * k} second part {k}") for k in [*range(6), 6, 6]]
    expected += [(50, "Welcome to our site story 50 about 2500 second part 50 All rights reserved"), (51, ""), (-1, "x")]
    assert got == sorted((k, t, len(t)) for k, t in expected)
    assert pages.extract(table.limit(0)).count() == 0


def test_template_inside_articles(spark):
    def page(k):
        return f"<body><article><h1>title {k}</h1><div><p>Read this with our app</p></div><p>story {k} about {k * k} and more</p><p>second part {k} of it all</p></article></body>"

    def version(k):
        return f"<body><article><h1>one long title</h1><p>always the same long story</p><p>version {k}</p></article></body>"

    rows = [(k, f"http://one/{k}", page(k)) for k in range(5)] + [(10 + k, f"http://copies/{k}", version(k)) for k in range(5)]
    rows += [(20 + k, f"http://same/{k}", page(9)) for k in range(5)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    for k in range(5):
        assert got[k] == f"title {k} story {k} about {k * k} and more second part {k} of it all"
        assert got[10 + k] == f"one long title always the same long story version {k}"
        assert got[20 + k] == "title 9 Read this with our app story 9 about 81 and more second part 9 of it all"


def test_nested_classes_stand_in_one_slot():
    a, b = 7, 8
    assert pages.in_one_slot([1, a, b, a, b, 2], pages.slot_of([1, a, b, a, b, 2], [1, 2]), [[a, b]]) == {a, b}
    assert pages.in_one_slot([1, a, b, 2, a, b], pages.slot_of([1, a, b, 2, a, b], [1, 2]), [[a, b]]) == set()
    assert pages.in_one_slot([1, a, b, b, a, 2], pages.slot_of([1, a, b, b, a, 2], [1, 2]), [[a, b]]) == set()


def test_copies_are_no_template(spark):
    def page(k):
        return f"<body><div><p>Welcome</p></div><div><p>story {k}</p><p>part {k}</p></div><div><p>All rights</p></div></body>"

    rows = [(1, "http://two/1", page(1)), (2, "http://two/2", page(1)), (3, "http://row/", page(3)), (3, "http://row/", page(3))]
    rows += [(10 + k, f"http://many/{k}", page(7 if k < 7 else k)) for k in range(10)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1] == got[2] == "Welcome story 1 part 1 All rights" and got[3] == "Welcome story 3 part 3 All rights"
    assert all(got[10 + k] == f"story {max(k, 7)} part {max(k, 7)}" for k in range(10))


def test_pages_query(spark, small):
    rows = {r["page_id"]: r["html"] for r in pq.read_table(f"{small}/pages.parquet").to_pylist()}
    got = pages.op9_html_extraction(spark, small).collect()
    assert {r.page_id: r.text for r in got} == {k: pages.main_text(h) for k, h in rows.items()}
    assert all(r.n_chars == len(r.text) > 0 for r in got)


def simhash(text):
    words = [w for w in __import__("re").split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if w]
    if not words:
        return 0
    words += [""] * (5 - len(words))
    votes = np.zeros(64, int)
    for k in range(len(words) - 4):
        h = 42
        for w in words[k : k + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        votes += np.array([1 if h >> b & 1 else -1 for b in range(64)])
    return sum(1 << b for b in range(64) if votes[b] > 0)


def expected_fingerprints(rows):
    order = sorted({d: min(t or "" for e, t in rows if e == d) for d, _ in rows if d is not None}.items(), reverse=True)
    out = {}
    for k, (d, text) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        f, e, x = simhash(text), simhash(edited), simhash(after)
        like = [1 - (f ^ y).bit_count() / 64 for y in (e, x)]
        out[d] = (d, len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{f:016x}", f"{e:016x}", *like)
    return out


def test_fingerprints_against_plain_votes(spark, docs, small, monkeypatch):
    monkeypatch.setattr(fingerprints, "BLOCK_ROWS", 3)  # many blocks, and groups of blocks
    random.seed(4)
    rows = [(d, t) for d, t in zip(*(pq.read_table(f"{small}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text")))][:60]
    rows += [(10_000_000 + k * 977, "tail é " * k) for k in range(7)] + [(-5, None), (-4, ""), (-9, " \n"), (-8, "one"), (-7, "One"), (-6, "\U0001f600" * 9)]
    rows += [rows[3], (rows[5][0], "another text"), (None, "left out"), (7_000_000, "w " * 70_000), (-(2**63), "least"), (2**63 - 1, "most")]
    got = {r.doc_id: tuple(r) for r in fingerprints.compared(docs(rows)).collect()}
    assert got == expected_fingerprints(rows)


def test_fingerprints_of_few_rows(docs):
    assert fingerprints.compared(docs([])).count() == 0
    (one,) = fingerprints.compared(docs([(3, "a b c d e f")])).collect()
    assert tuple(one) == expected_fingerprints([(3, "a b c d e f")])[3] and one.near_next == 1.0
    assert fingerprints.compared(docs([(None, "x")])).count() == 0


def test_near_fingerprints_finds_every_pair_within_the_radius(spark):
    random.seed(6)
    base = [random.getrandbits(64) for _ in range(40)]
    values = set(base)
    for f in base:
        for n in (1, 2, 3, 4, 5):
            values.add(f ^ sum(1 << b for b in random.sample(range(64), n)))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in [*signed, signed[0], None]], "fingerprint bigint")
    pairs = {(a, b): (a ^ b & (1 << 64) - 1) for a in signed for b in signed if a < b}
    for radius, blocks in ((3, 6), (3, 4), (2, 5)):
        expected = {(a, b, ((a ^ b) & (1 << 64) - 1).bit_count()) for a, b in pairs if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
        got = [tuple(r) for r in fingerprints.near_fingerprints(frame, radius, blocks).collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    asked = frame.where(F.col("fingerprint") == signed[1])
    got = {tuple(r) for r in fingerprints.near_fingerprints(frame, queries=asked).collect()}
    assert got == {(signed[1], b, ((signed[1] ^ b) & (1 << 64) - 1).bit_count()) for b in signed if b != signed[1] and ((signed[1] ^ b) & (1 << 64) - 1).bit_count() <= 3}


def test_near_edited_is_nearer_than_the_next(spark, middle):
    got = fingerprints.op1_fingerprints(spark, middle).agg(F.avg("near_edited"), F.avg("near_next")).first()
    assert got[0] > 0.63 and abs(got[1] - 0.5) < 0.02


def test_chat_query_against_sql(spark, small):
    conversations = pq.read_table(f"{small}/conversations.parquet")  # noqa: F841
    expected = sorted(duckdb.sql(chat.OP4_SQL).fetchall())
    assert sorted(tuple(r) for r in chat.op4_chat_format(spark, small).collect()) == expected
