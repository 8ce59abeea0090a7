"""Main text of web pages by equivalence classes of template tokens.

A page is read as a sequence of tokens: tags with the path of elements they stand in, and runs of text with their
path. Over the pages of a host, every token has an occurrence vector, how often it occurs on each page; tokens with
the same vector, present on most pages, form an equivalence class. Vectors are compared by hashed sums, so a host of
any size is aggregated in parallel. A class is valid with two tokens at least. The class that occurs once a page is
the outer template; its tokens, in page order, divide a page into slots, and a valid class whose occurrences all
lie in one slot is nested there. A text run that belongs to a class is template text; what is left is data.

The main text is the data of the slots inside the article element (or ``main``, or an element of that role). Template
text inside the article is left out too, unless it is the larger part of the article: then the host holds many versions
of one article, and all of it stays. Where a page has neither element, the main text is the data of all slots but those
made up of links, without the template text. A nested class counts on the pages where its tokens stand in one slot, in
the same order each time. Elements whose name, role, class or id says that they are no part of an article are left
out anywhere; the ids of headings, paragraphs and sections inside the article don't count. Copies of a page, told by the hash of its text (of its article, if it has one), count once in the vectors, so a
page copied over and over is not taken for a template. A host of fewer than ``FEW`` distinct contents has no vectors to
compare: a page of it is one slot, read by its elements.

Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by
one space. Null html is empty; a null url is the host ''; repeated rows are pages of their own with equal results; an
unclosed element ends with its parent, an unclosed comment or script with the page. An empty table gives no rows.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import slices, text_or_empty
from tidemark.plans.blocks import settle

#: Elements of HTML by kind; fixed values of the standard.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
OUTSIDE = frozenset("nav header footer aside form script style noscript template iframe head title button select option textarea object svg canvas dialog menu audio video input label fieldset".split())
#: Words in a role, class or id that mark what is no part of an article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo menu nav navbar navigation breadcrumb breadcrumbs header footer sidebar aside"
    " notice notices cookie cookies consent popup modal newsletter subscribe signup comment comments disqus reply replies respond share sharing social related"
    " recommended widget toolbar masthead search login contentinfo complementary hidden".split()
)
MAIN = frozenset(("article", "main"))
#: The share of a host's pages a template token is on at least.
SUPPORT = 0.6
#: The distinct contents a host has at least, for a template to be told from them.
FEW = 3

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[a-z]+")
_IMPLIED = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("article main section div body table ul ol dl td th li blockquote nav aside header footer form".split())
#: Inside the article an id on one of these is the target of a link and says nothing else.
_ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 p section".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


class Run:
    """A run of text: its path, whether it is inside the article, whether it is outside any, and its place."""

    __slots__ = ("path", "text", "main", "outside", "block")

    def __init__(self, path: str, text: str, main: bool, outside: bool, block: int):
        self.path, self.text, self.main, self.outside, self.block = path, text, main, outside, block


def _marks(attributes: str, anchored: bool = False) -> tuple[bool, bool]:
    """(outside, main) as an element's attributes say; an ``anchored`` one's id doesn't count."""
    outside = main = False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden":
            outside |= name == "hidden" or value == "true"
        elif name == "role" and value in MAIN:
            main = True
        elif name == "class" or name == "role" or name == "id" and not anchored:
            outside |= any(w in MARKS for w in _WORD.findall(value))
    return outside, main


def read_page(html: str) -> tuple[list[str], list[Run]]:
    """The tokens of a page in order, and its runs of text. A run's token is its path and text."""
    tokens: list[str] = []
    runs: list[Run] = []
    stack: list[tuple[str, str, bool, bool]] = [("", "", False, False)]
    block, at = 0, 0

    def put(text: str) -> None:
        name, path, main, outside = stack[-1]
        if text and not text.isspace():
            tokens.append(f"{path}\t{text}")
        if text:
            runs.append(Run(path, text, main, outside, block))

    def close(name: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == name:
                del stack[k:]
                return

    while at < len(html):
        m = _TAG.search(html, at)
        if m is None:
            put(html[at:] if not re.fullmatch(r"(?s)<[a-zA-Z/!?][^>]*", html[at:]) else "")
            break
        put(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name, attributes = m[2].lower(), m[3]
        if name not in INLINE:
            block += 1
        if m[1]:
            tokens.append(f"{stack[-1][1]}\t/{name}")
            close(name)
            continue
        if name in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in _SCOPE:
                    break
        if name in _IMPLIED:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in _IMPLIED[name]:
                    del stack[k:]
                    break
                if stack[k][0] in _SCOPE:
                    break
        _, path, main, outside = stack[-1]
        said_outside, said_main = _marks(attributes, main and name in _ANCHORED) if attributes else (False, False)
        is_main = main or name in MAIN or said_main
        # a header inside the article holds its title; other such elements are outside anywhere
        is_out = outside or (name in OUTSIDE and not (name == "header" and main)) or (said_outside and name not in ("html", "body", *MAIN))
        path = f"{path}/{name}"
        tokens.append(path)
        if name in VOID or attributes.rstrip().endswith("/") and name not in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            block += 1
            continue
        stack.append((name, path, is_main, is_out))
    return tokens, runs


def token_hash(token: str) -> int:
    return xxhash.xxh64_intdigest(token) - (1 << 63)


def host(url: str = "url") -> Column:
    """The host of a URL as a 64-bit hash, shorter to exchange than its name."""
    return F.xxhash64(F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit(""))))


def own_runs(runs: list[Run]) -> list[Run]:
    """The runs of the article, or where a page has none all that are not outside."""
    inside = [r for r in runs if r.main and not r.outside]
    return inside if any(not r.text.isspace() for r in inside) else [r for r in runs if not r.outside]


def content_hash(runs: list[Run]) -> int:
    """Equal for copies of a page, whatever stands around their articles."""
    return token_hash("\n".join(" ".join(r.text.split()) for r in own_runs(runs) if not r.text.isspace()))


def occurrences(pages: DataFrame) -> DataFrame:
    """(host, page, token, n, place): how often each token is on each page, and where first. Copies of a page, by
    their content, are one page. Every page has the token 0 once."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 1 << 20):
                ids, token, n, place = [], [], [], []
                for text in part.column("html").to_pylist():
                    tokens, runs = read_page(text)
                    first: dict[str, int] = {}
                    for k, t in enumerate(tokens):
                        first.setdefault(t, k)
                    counts = Counter(tokens)
                    ids.append(content_hash(runs))
                    token.append([0, *map(token_hash, counts)])
                    n.append([1, *counts.values()])
                    place.append([-1, *(first[t] for t in counts)])
                lists = [pa.array(x, pa.list_(k)) for x, k in ((token, pa.int64()), (n, pa.int32()), (place, pa.int32()))]
                yield pa.RecordBatch.from_arrays([part.column("host"), pa.array(ids, pa.int64()), *lists], names=["host", "page", "token", "n", "place"])

    rows = pages.select(host().alias("host"), text_or_empty("html").alias("html"))
    read = rows.mapInArrow(make, "host bigint, page bigint, token array<bigint>, n array<int>, place array<int>")
    once = read.groupBy("host", "page").agg(F.min(F.struct("token", "n", "place")).alias("all"))
    return once.select("host", "page", F.inline(F.arrays_zip("all.token", "all.n", "all.place")))


def templates(pages: DataFrame) -> DataFrame:
    """(host, outer, nested): hashes of the tokens of the outer template in page order, and of every nested class in order.
    Hosts of fewer than ``FEW`` distinct contents have none."""
    mark = F.xxhash64("page", "n")
    vectors = occurrences(pages).groupBy("host", "token").agg(
        F.count("*").alias("pages"), F.sum("n").alias("total"), F.bit_xor(mark).alias("v1"), F.sum(F.pmod(mark, F.lit(1 << 40))).alias("v2"), F.avg("place").alias("place")
    )
    vectors = settle(vectors.where("pages > 1 OR token = 0"))
    size = vectors.where("token = 0").select("host", F.col("pages").alias("of")).where(F.col("of") >= FEW)
    vectors = vectors.where("token <> 0")
    often = vectors.join(size, "host").where(F.col("pages") >= F.greatest(F.lit(2.0), F.col("of") * SUPPORT))
    token = F.struct("place", "token")
    classes = often.groupBy("host", "v1", "v2", "pages", "total").agg(F.collect_set(token).alias("tokens")).where(F.size("tokens") > 1)
    once = F.col("pages") == F.col("total")
    return classes.groupBy("host").agg(
        F.array_sort(F.flatten(F.collect_list(F.when(once, F.col("tokens"))))).getField("token").alias("outer"),
        F.transform(F.collect_list(F.when(~once, F.array_sort("tokens"))), lambda c: c.getField("token")).alias("nested"),
    )


def slot_of(tokens: list[int], outer: list[int]) -> dict[int, int]:
    """For each place in a page, the number of outer tokens before it, taking those that keep their order."""
    rank = {t: k for k, t in enumerate(outer)}
    slots, reached = {}, -1
    for place, t in enumerate(tokens):
        k = rank.get(t, -1)
        if k > reached:
            reached = k
        slots[place] = reached
    return slots


def in_one_slot(hashes: list[int], slots: dict[int, int], nested: list[list[int]]) -> set[int]:
    """The tokens of the nested classes whose occurrences on a page stand in one slot, in order again and again."""
    of = {t: k for k, c in enumerate(nested) for t in c}
    seen: dict[int, list[int]] = {}
    for place, t in enumerate(hashes):
        if t in of:
            seen.setdefault(of[t], []).append(place)
    valid: set[int] = set()
    for k, places in seen.items():
        found = [hashes[p] for p in places]
        ranks, start = {t: r for r, t in enumerate(dict.fromkeys(found))}, len(set(found))
        repeats = all(ranks[t] == j % start for j, t in enumerate(found))
        if repeats and len({slots[p] for p in places}) == 1:
            valid.update(nested[k])
    return valid


def data_runs(tokens: list[str], runs: list[Run], outer: list[int], nested: list[list[int]]) -> list[Run]:
    """The runs that hold the main text: those in the article's slots, or else what the template leaves."""
    hashes = [token_hash(t) for t in tokens] if outer or nested else [0] * len(tokens)
    slots = slot_of(hashes, outer)
    fixed = {*outer, *in_one_slot(hashes, slots, nested)}
    inside = [r for r in runs if r.main and not r.outside]
    if any(not r.text.isspace() for r in inside):
        data = [r for r in inside if r.text.isspace() or token_hash(f"{r.path}\t{r.text}") not in fixed] if fixed else inside
        return data if 2 * sum(len(r.text.strip()) for r in data) >= sum(len(r.text.strip()) for r in inside) else inside
    place = {t: k for k, t in reversed(list(enumerate(tokens)))}
    left, sizes, links = [], Counter(), Counter()
    for r in runs:
        token = f"{r.path}\t{r.text}"
        slot, parts = slots.get(place.get(token, -1), -1), r.path.split("/")
        sizes[slot] += len(r.text)
        links[slot] += len(r.text) * ("a" in parts)
        if not r.outside and token_hash(token) not in fixed and not ("a" in parts and "li" in parts):
            left.append((slot, r))
    return [r for slot, r in left if 2 * links[slot] <= sizes[slot]]


def main_text(html: str, outer: list[int] | None = None, nested: list[list[int]] | None = None) -> str:
    """The main text of a page, given its host's template."""
    chosen = data_runs(*read_page(html), outer or [], nested or [])
    blocks: list[str] = []
    last = None
    for r in chosen:
        if blocks and r.block == last:
            blocks[-1] += r.text
        else:
            blocks.append(r.text)
        last = r.block
    texts = (" ".join(references.unescape(b).split()) for b in blocks)
    return " ".join(t for t in texts if t)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of ``pages(page_id, url, html)``, a row for each row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 1 << 20):
                columns = (part.column(c).to_pylist() for c in ("html", "outer", "nested"))
                texts = [main_text(*row) for row in zip(*columns)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", text_or_empty("html").alias("html"), host().alias("host"))
    return rows.join(templates(pages), "host", "left").select("page_id", "url", "html", "outer", "nested").mapInArrow(
        make, "page_id bigint, url string, text string, n_chars bigint"
    )


def op9_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf}/pages.parquet"))
