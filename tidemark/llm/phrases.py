"""Phrase collocations by weighted acyclic automata.

Texts are lower-cased (A-Z only), split at ``[.,;:!?]`` and line ends into pieces and those at spaces and tabs into words. All
counts are of one language; a null language is ``und``, a null text is empty.

An n-gram can't be more frequent than the two shorter ones in it, so n-grams are sifted by the number of words: those
whose parts were frequent are counted by hash (sorted arrays, exchanged by hash range), and those of at least ``least`` are
told to the next round by a table of hash bits of a fixed greatest size. A false hit costs time, never a wrong result.
Then each task counts the n-grams that passed once more, with the words of each, in arrays sorted by hash; those of a hash
range meet, and of each n-gram of at least ``least`` one row with its count goes to its prefix range (a hash of the key up to
the second byte of its last word, so that no common word is a range of its own). So a phrase that every task has is
spelled out as a key once, whatever the number of tasks. The keys of a prefix range become a count transducer. Counts of parts
are looked up by composing the acceptor of the parts asked for in a range with its transducer. N-grams of one task are told
apart by 64-bit hashes, those of different tasks by their words.

A candidate is scored by its worst cut. It is dropped if a longer candidate that contains it is as frequent; then one that
is a word longer is, too, so its two longest parts are compared. Arithmetic is exact (whole numbers and decimals of 38
digits). Every row of a repeated document counts. An empty table, or one without frequent phrases, gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.automata import CountAutomaton, Key
from tidemark.llm.common import slices, text_or_empty
from tidemark.llm.words import byte_runs, mix, word_hashes
from tidemark.plans.blocks import shared_dir

LEAST, LONGEST, TOP = 100, 5, 2000
RANGE_BYTES, HELD, GRAMS = 16 << 20, 1_000_000, 200_000
#: Bytes of texts that are cut into words at once; the work arrays of a task take some sixty times as much.
PART_BYTES = 1 << 19
#: Bits of the table of frequent n-grams, at most 32 MB.
MOST_BITS = 28
SALTS = 32

_BREAKS = np.zeros(256, np.int64)
_BREAKS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 1
_LOWER = np.arange(256, dtype=np.uint16)
_LOWER[65:91] += 32
_LOWER[0] = 256  # a NUL is an ordinary character
_LOWER[[32, 9]] = 0
_LOWER[_BREAKS > 0] = 0
_STEP = np.uint64(0x9E3779B97F4A7C15)


def language_salts(langs: list[str]) -> np.ndarray:
    known = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in set(langs)}
    return np.array([known[x] for x in langs], np.uint64)


class Words:
    """The words of texts: where they start and end, their texts, pieces and hashes."""

    def __init__(self, texts: pa.Array, langs: list[str]):
        raw, offsets = byte_runs(texts)
        self.hash, of = word_hashes(raw, offsets, _LOWER)
        seen = _LOWER[raw] != 0 if len(raw) else np.zeros(0, bool)
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before = np.concatenate([[False], seen[:-1]]) & ~edge[:-1]
        after = np.concatenate([seen[1:], [False]]) & ~edge[1:]
        self.first, self.last = np.flatnonzero(seen & ~before), np.flatnonzero(seen & ~after) + 1
        self.text = np.repeat(np.arange(len(texts)), np.diff(of))
        piece = np.cumsum(_BREAKS[raw])[self.first] if len(raw) else np.zeros(0, np.int64)
        self.joined = (self.text[1:] == self.text[:-1]) & (piece[1:] == piece[:-1])
        self.langs, self.salt = langs, language_salts(langs)
        self._raw, self._bytes = raw, None

    def grams(self, n: int, frequent: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For 1 to n words the first words and the hashes of the n-grams; those that aren't frequent are left out, with
        all longer ones around them, where a table is given."""
        at = np.arange(len(self.hash))
        code = mix(self.hash ^ self.salt[self.text]) if len(at) else self.hash
        for size in range(1, n + 1):
            if size > 1:
                # the two parts overlap in all but their outer words, so what joins their first words joins the whole
                pair = np.flatnonzero((at[1:] == at[:-1] + 1) & self.joined[at[:-1]]) if len(at) > 1 else np.zeros(0, np.int64)
                at, code = at[pair], mix(code[pair] * _STEP + self.hash[at[pair] + size - 1])
            if size <= len(frequent):
                good = np.flatnonzero(known(frequent[size - 1], code))
                at, code = at[good], code[good]
            yield at, code

    def spelled(self, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The sizes and the bytes, one behind the other, of the n-grams whose first words are ``at``; a space parts words."""
        if self._bytes is None:
            low = np.arange(256, dtype=np.uint8)
            low[65:91] += 32
            sizes = self.last - self.first
            self._starts = np.append(0, np.cumsum(sizes + 1))
            self._bytes = np.full(self._starts[-1], 32, np.uint8)
            inside = np.repeat(self.first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            self._bytes[np.repeat(np.arange(len(sizes)), sizes) + np.arange(len(inside))] = low[self._raw[inside]]
        starts, sizes = self._starts[at], self._starts[at + n] - self._starts[at] - 1
        return sizes, self._bytes[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]

    def key(self, at: int, n: int) -> Key:
        return (self.langs[self.text[at]].encode(), *self.spelled(np.array([at]), n)[1].tobytes().split(b" "))


def known(table: np.ndarray, code: np.ndarray) -> np.ndarray:
    bits = np.uint64(len(table) * 8).item().bit_length() - 1
    at = (code >> np.uint64(64 - bits)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def prefix_range(key: Key, ranges: int) -> int:
    return zlib.crc32(b"\n".join((*key[:-1], key[-1][:2]))) % ranges


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes with the sums of their counts."""
    codes, counts = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts[:0]


def sift_shards(n: int, ranges: int, tables: list[Broadcast]):
    """Texts -> hashes and counts of their n-grams whose parts are frequent, by hash range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = [t.value for t in tables]
        borders = np.arange(1, ranges, dtype=np.uint64) * np.uint64((1 << 64) // ranges)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def emit() -> pa.RecordBatch:
            codes, counts = _added(held)
            held.clear()
            cut = np.concatenate([[0], np.searchsorted(codes, borders), [len(codes)]])
            some = np.flatnonzero(np.diff(cut))
            both = [pa.array([x[cut[r] : cut[r + 1]].tobytes() for r in some], pa.binary()) for x in (codes, counts)]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *both], names=["range", "codes", "counts"])

        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                *_, (_, code) = Words(part.column("text"), part.column("lang").to_pylist()).grams(n, frequent)
                code = np.sort(code)
                first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
                held.append((code[first], np.diff(first, append=len(code))))
                size += len(first)
                if size > HELD:
                    held[:] = [_added(held)]
                    size = len(held[0][0])
                    if size > HELD // 2:
                        yield emit()
                        size = 0
        if held:
            yield emit()

    return run


def frequent_codes(least: int):
    """Hashes and counts sorted by range -> the hashes that are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def done() -> pa.RecordBatch:
            codes, counts = _added(held)
            return pa.RecordBatch.from_arrays([pa.array(codes[counts >= least].view(np.int64))], names=["code"])

        for batch in batches:
            for r, codes, counts in zip(batch.column("range").to_pylist(), batch.column("codes"), batch.column("counts")):
                if r != now:
                    if held:
                        yield done()
                    now, held, size = r, [], 0
                # copies, so that no batch stays for the part of it that is held
                held.append((np.frombuffer(codes.as_py(), np.uint64), np.frombuffer(counts.as_py(), np.int64)))
                size += len(held[-1][0])
                if size > 2 * max(HELD, len(held[0][0])) and len(held) > 1:
                    held = [_added(held)]
                    size = len(held[0][0])
        if held:
            yield done()

    return run


def frequent_table(codes: DataFrame, n: int) -> np.ndarray:
    """Hash bits of ``n`` n-grams: the bytes of a table of 2**bits bits, a hash's place being its leading bits."""
    bits = min(MOST_BITS, max(16, (16 * n).bit_length()))
    table = np.zeros(1 << (bits - 6), np.int64)
    at = F.shiftrightunsigned("code", 64 - bits)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(code, {64 - bits}) & 63 AS int))")
    cells = codes.groupBy(F.shiftright(at, 6).alias("cell")).agg(F.bit_or(bit).alias("bits"))
    for batch in cells.toArrow().to_batches():
        table[batch.column("cell").to_numpy()] = batch.column("bits").to_numpy()
    return table.view(np.uint8)


class Counted:
    """N-grams with counts: sorted hashes, and the words of each in order of arrival."""

    def __init__(self) -> None:
        self.codes, self.counts, self.came = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.sizes, self.langs, self.texts, self.known = [], [], [], {}

    def add(self, words: Words, at: np.ndarray, code: np.ndarray, n: int) -> None:
        codes, where, counts = np.unique(code, return_index=True, return_counts=True)
        place = np.searchsorted(self.codes, codes)
        held = np.zeros(len(codes), bool)
        inside = place < len(self.codes)
        held[inside] = self.codes[place[inside]] == codes[inside]
        self.counts[place[held]] += counts[held]
        new = ~held
        first = at[where[new]]
        sizes, text = words.spelled(first, n)
        of = np.array([self.known.setdefault(x, len(self.known)) for x in words.langs], np.int32)
        self.sizes.append(sizes)
        self.langs.append(of[words.text[first]])
        self.texts.append(text)
        came = np.arange(len(first)) + len(self.came)
        self.codes, self.counts, self.came = (np.insert(x, place[new], y) for x, y in ((self.codes, codes[new]), (self.counts, counts[new]), (self.came, came)))

    def cut(self, ranges: int) -> Iterator[dict]:
        """A row of arrays for each range of hashes."""
        if not len(self.codes):
            return
        sizes, langs = np.concatenate(self.sizes)[self.came], np.concatenate(self.langs)[self.came]
        text, ends = spliced(np.concatenate(self.texts), np.concatenate(self.sizes), self.came)
        cut = np.concatenate([[0], np.searchsorted(self.codes, np.arange(1, ranges, dtype=np.uint64) * np.uint64((1 << 64) // ranges)), [len(self.codes)]])
        for r in np.flatnonzero(np.diff(cut)).tolist():
            a, b = cut[r], cut[r + 1]
            arrays = {k: x[a:b].tobytes() for k, x in (("codes", self.codes), ("counts", self.counts), ("sizes", sizes), ("langs", langs))}
            yield {"range": r, "texts": text[ends[a] : ends[b]].tobytes(), "names": list(self.known), **arrays}


def spliced(text: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings of ``sizes``, one behind the other in ``text``, in another order, and where each begins."""
    starts, size = (np.cumsum(sizes) - sizes)[order], sizes[order]
    ends = np.append(0, np.cumsum(size, dtype=np.int64))
    return text[np.repeat(starts - ends[:-1], size) + np.arange(ends[-1])], ends


_COUNTED = pa.schema([("range", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary()), ("sizes", pa.binary()), ("langs", pa.binary()), ("texts", pa.binary()), ("names", pa.list_(pa.string())), ("total", pa.map_(pa.string(), pa.int64()))])
_COUNTED_DDL = "range int, codes binary, counts binary, sizes binary, langs binary, texts binary, names array<string>, total map<string,bigint>"


def shard_counts(ranges: int, tables: list[Broadcast]):
    """Texts -> their frequent n-grams with words and counts, by hash range, and the number of words of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = [t.value for t in tables]
        held, total = Counted(), {}

        def emit() -> pa.RecordBatch:
            found = list(held.cut(ranges)) + [{"range": zlib.crc32(lang.encode()) % ranges, "total": [(lang, n)]} for lang, n in total.items()]
            total.clear()
            return pa.RecordBatch.from_pylist(found, _COUNTED)

        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                langs = part.column("lang").to_pylist()
                words = Words(part.column("text"), langs)
                for text, n in enumerate(np.bincount(words.text, minlength=len(langs)).tolist()):
                    total[langs[text]] = total.get(langs[text], 0) + n
                for size, (at, code) in enumerate(words.grams(len(frequent), frequent), 1):
                    held.add(words, at, code, size)
                if len(held.codes) > HELD:
                    yield emit()
                    held = Counted()
        yield emit()

    return run


def counted_once(least: int, ranges: int):
    """N-grams sorted by hash range -> each frequent one with its count, by prefix range; totals go on as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            names = {x: k for k, x in enumerate(dict.fromkeys(x for row in held for x in row["names"]))}
            langs = np.concatenate([np.array([names[x] for x in row["names"]], np.int32)[np.frombuffer(row["langs"], np.int32)] for row in held])
            codes, counts, sizes = (np.concatenate([np.frombuffer(row[c], kind) for row in held]) for c, kind in (("codes", np.uint64), ("counts", np.int64), ("sizes", np.int64)))
            order = np.argsort(codes, kind="stable")
            text, ends = spliced(np.frombuffer(b"".join(row["texts"] for row in held), np.uint8), sizes, order)
            codes, counts, sizes, langs = codes[order], counts[order], sizes[order], langs[order]
            first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            group = np.repeat(np.arange(len(first)), np.diff(first, append=len(codes)))
            # n-grams of one hash have the same words, or they are told apart
            same = (sizes == sizes[first][group]) & (langs == langs[first][group])
            some = np.flatnonzero(same)
            told, _ = spliced(text, sizes, first[group[some]])
            own, at = spliced(text, sizes, some)
            same[some] = np.add.reduceat(own != told, at[:-1], dtype=np.int64) == 0
            apart = np.zeros(len(first), bool)
            apart[group[~same]] = True
            known, raw = list(names), text.tobytes()
            sums = np.add.reduceat(counts, first)
            found = [(known[langs[k]], raw[ends[k] : ends[k + 1]], n) for k, n in zip(first[~apart & (sums >= least)].tolist(), sums[~apart & (sums >= least)].tolist())]
            odd: dict[tuple[str, bytes], int] = {}
            for k in np.flatnonzero(apart[group]).tolist():
                key = known[langs[k]], raw[ends[k] : ends[k + 1]]
                odd[key] = odd.get(key, 0) + int(counts[k])
            found += [(*key, n) for key, n in odd.items() if n >= least]
            at = [prefix_range((lang.encode(), *words.split(b" ")), ranges) for lang, words, _ in found]
            lang, words, count = zip(*found) if found else ((), (), ())
            return out(at, lang, words, count, [None] * len(at))

        def out(*columns: Iterable) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.binary(), pa.int64(), _TOTAL))], names=["range", "lang", "words", "count", "total"])

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if row["total"]:
                    yield out([row["range"]], [None], [None], [None], [row["total"]])
                    continue
                if row["range"] != now:
                    if held:
                        yield done()
                    now, held = row["range"], []
                held.append(row)
        if held:
            yield done()

    return run


_TOTAL = pa.map_(pa.string(), pa.int64())


def transducers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """N-grams sorted by prefix range -> the count transducer of each range; totals are added up."""
    now, parts, held, total = None, [], [], {}

    def done() -> pa.RecordBatch:
        parts.append(CountAutomaton.build(sorted(held)))
        kept = (parts[0] if len(parts) == 1 else CountAutomaton.union(parts)).to_bytes()
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([kept], pa.binary()), pa.array([list(total.items())], _TOTAL)], names=["range", "counts", "total"])

    for batch in batches:
        for r, lang, words, n, told in zip(*(batch.column(c).to_pylist() for c in ("range", "lang", "words", "count", "total"))):
            if r != now:
                if now is not None:
                    yield done()
                now, parts, held, total = r, [], [], {}
            for x, m in told or []:
                total[x] = total.get(x, 0) + m
            if words is not None:
                held.append(((lang.encode(), *words.split(b" ")), n))
            if len(held) > GRAMS:
                parts.append(CountAutomaton.build(sorted(held)))
                held = []
    if now is not None:
        yield done()


def keys_of(batch: pa.RecordBatch) -> Iterator[tuple[Key, int]]:
    for raw in batch.column("counts").to_pylist():
        yield from CountAutomaton.from_bytes(raw)


def count_phrases(documents: DataFrame, least: int, longest: int) -> tuple[DataFrame, int]:
    """The count transducers of all frequent phrases, (range, counts, total), and the number of ranges."""
    spark = documents.sparkSession
    texts = documents.select(text_or_empty("text").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    ranges = max(8, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES))
    tables: list[Broadcast] = []
    for n in range(1, longest + 1):
        sifted = texts.mapInArrow(sift_shards(n, ranges, tables), "range int, codes binary, counts binary")
        path = shared_dir(spark, f"frequent-{n}")
        sifted.repartition("range").sortWithinPartitions("range").mapInArrow(frequent_codes(least), "code bigint").write.parquet(path)
        codes = spark.read.parquet(path)
        found = codes.count()
        if not found:
            break
        tables.append(spark.sparkContext.broadcast(frequent_table(codes, found)))
    shards = texts.mapInArrow(shard_counts(ranges, tables), _COUNTED_DDL).repartition("range").sortWithinPartitions("range")
    grams = shards.mapInArrow(counted_once(least, ranges), "range int, lang string, words binary, count bigint, total map<string,bigint>")
    path = shared_dir(spark, "counts")
    grams.repartition("range").sortWithinPartitions("range").mapInArrow(transducers, "range int, counts binary, total map<string,bigint>").write.parquet(path)
    return spark.read.parquet(path), ranges


def cuts(ranges: int):
    """Frequent phrases -> a row for each cut: lang, phrase, a, words, k, first part and rest, with the parts' ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, a in keys_of(batch):
                words = [w.decode() for w in key[1:]]
                for k in range(1, len(words)):
                    left, right = key[: k + 1], (key[0], *key[k + 1 :])
                    out.append((key[0].decode(), " ".join(words), a, len(words), k, " ".join(words[:k]), " ".join(words[k:]), prefix_range(left, ranges), prefix_range(right, ranges)))
            if out:
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["lang", "phrase", "a", "words", "k", "first", "rest", "first_range", "rest_range"])

    return run


def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transducers and sorted parts of a range, transducers first -> the counts of the parts, by composition."""
    now, held = None, []

    def answer(asked: Iterable[Key]) -> list[tuple[str, str, int]]:
        wanted = CountAutomaton.build((k, 1) for k in sorted(asked))
        return [(k[0].decode(), b" ".join(k[1:]).decode(), n) for part in held for k, n in part.compose(wanted)]

    for batch in batches:
        out: list[tuple[str, str, int]] = []
        asked: set[Key] = set()
        for r, raw, lang, part in zip(*(batch.column(c).to_pylist() for c in ("range", "counts", "lang", "part"))):
            if r != now:
                out += answer(asked) if asked else []
                now, held, asked = r, [], set()
            if raw is not None:
                held.append(CountAutomaton.from_bytes(raw))
            else:
                asked.add((lang.encode(), *part.encode().split(b" ")))
        out += answer(asked) if asked else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64()))], names=["lang", "part", "f"])


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of ``documents(text, lang)``: the ``top`` phrases of each language."""
    spark = documents.sparkSession
    table, ranges = count_phrases(documents, least, longest)
    totals = table.select(F.explode("total").alias("lang", "n")).groupBy("lang").agg(F.sum("n").alias("n"))
    path = shared_dir(spark, "cuts")
    table.select("counts").mapInArrow(cuts(ranges), "lang string, phrase string, a bigint, words int, k int, first string, rest string, first_range int, rest_range int").write.parquet(path)
    cut = spark.read.parquet(path)

    parts = cut.select(F.inline(F.array(F.struct(F.col("first_range").alias("range"), "lang", F.col("first").alias("part")), F.struct(F.col("rest_range").alias("range"), "lang", F.col("rest").alias("part"))))).distinct()
    none = F.lit(None)
    both = table.select("range", "counts", none.cast("string").alias("lang"), none.cast("string").alias("part")).unionByName(parts.withColumn("counts", none.cast("binary")))
    dealt = both.repartition("range").sortWithinPartitions("range", F.col("counts").isNull(), "lang", "part")
    path = shared_dir(spark, "parts")
    dealt.mapInArrow(look_up, "lang string, part string, f bigint").write.parquet(path)
    counts = spark.read.parquet(path)

    scored = cut.join(counts.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    scored = scored.join(counts.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    inside = F.array(
        F.when((F.col("k") == F.col("words") - 1) & (F.col("l") == F.col("a")), F.col("first")),
        F.when((F.col("k") == 1) & (F.col("r") == F.col("a")), F.col("rest")),
    )
    within = scored.select("lang", F.explode(inside).alias("phrase")).where("phrase IS NOT NULL").distinct()
    score = F.expr("(cast(1000 AS decimal(38,0)) * a * n) div (cast(l AS decimal(38,0)) * r)")
    best = scored.join(totals, "lang").withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    kept = best.join(within, ["lang", "phrase"], "left_anti").select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    few = kept.withColumn("salt", salt).withColumn("place", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf}/documents.parquet"))


OP12_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda x: x <> '') AS words FROM p
), g AS (
  SELECT lang, m, unnest(list_transform(range(1, len(words) - m + 2), lambda i: array_to_string(words[i:i + m - 1], ' '))) AS phrase
  FROM w, range(1, 6) AS t(m) WHERE len(words) >= m
), f AS (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE f >= 100 AND m > 1),
k AS (
  SELECT c.*, k, array_to_string(ws[1:k], ' ') AS first, array_to_string(ws[k + 1:], ' ') AS rest FROM c, range(1, 5) AS t(k) WHERE k < m
), s AS (
  SELECT k.lang, k.phrase, k.a, k.m, k.k, x.f AS l, y.f AS r, n.n, (1000::HUGEINT * k.a * n.n) // (x.f::HUGEINT * y.f) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.phrase = k.first AND x.m = k.k JOIN f y ON y.lang = k.lang AND y.phrase = k.rest AND y.m = k.m - k.k
  JOIN n ON n.lang = k.lang
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
d AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN c ON c.lang = b.lang AND c.m > b.m AND c.a >= b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' '))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM b ANTI JOIN d USING (lang, phrase) QUALIFY rank <= 2000
"""
