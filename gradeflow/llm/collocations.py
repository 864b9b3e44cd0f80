"""Collocations by a multikey quicksort of suffix pointers, cut at a maximum depth.

Every word of a piece starts a suffix of at most ``most_words`` words.  Words are counted
first, then pairs of frequent words: a suffix ends before the first pair that is rare, as no
frequent phrase holds one.  Suffixes are counted where they are found, routed by their leading words (a range partitioning, so
that a frequent beginning is spread over several tasks), and sorted in each task by a
three-way quicksort of pointers, one word at a time.  The pointers equal to a pivot are
all suffixes with one beginning, so their number is the count of that phrase; a
partition with fewer than ``least`` is abandoned, as no longer phrase can be frequent.

Only the first and the last suffix of a task can share a beginning with another task.
Their beginnings are kept at any count and summed over the tasks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.llm.common import mix, steps, stored

LEAST, MOST_WORDS, TOP = 100, 5, 2000
#: Bits of the marks of words and of pairs that may be frequent: what tasks are sent has this bound.
MARK_BITS = 1 << 24
#: Words a task counts before it hands its counts on, and words whose pairs it merges or whose suffixes it cuts at once.
_WORDS, _CHUNK = 500_000, 3_000_000
#: Distinct suffixes sorted by one task, on average.
SORTED = 600_000
#: Copies of each single word's count, so that candidates with one common word meet it in many tasks.
SALTS = 16

_BREAK = b"\xff"  # in no UTF-8 text
_FOLD = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))


def pieces(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased, with a break between pieces."""
    return [w for w in text.translate(_FOLD).replace(_BREAK, b" \xff ").split(b" ") if w] if text else []


def _source(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").cast("binary").alias("text"))


def word_counts(source: DataFrame) -> DataFrame:
    """(lang, word, n): counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, own in found.items():
                own.pop(_BREAK, None)
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own)), pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], names=["lang", "word", "n"])
            found.clear()

        for batch in steps(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found.setdefault(lang, Counter()).update(pieces(text))
            if sum(map(len, found.values())) > _WORDS:
                yield from told()
        yield from told()

    counts = source.mapInArrow(run, "lang string, word binary, n bigint")
    return counts.groupBy("lang", F.col("word").cast("string").alias("word")).agg(F.sum("n").alias("n"))


def _hashed(lang: str, words: list[bytes]) -> np.ndarray:
    start = lang.encode() + b"\0"
    return np.fromiter((xxhash.xxh3_64_intdigest(start + w) for w in words), np.uint64, len(words))


class Marks:
    """A bit per hash of what may be frequent; what is frequent always has its bit."""

    def __init__(self, hashes: DataFrame):
        place = F.col("h").bitwiseAND(MARK_BITS - 1)
        bits = hashes.groupBy(F.shiftright(place, 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 AS INT)))").alias("bits")).toArrow()
        self.bits = np.zeros(MARK_BITS // 64, np.uint64)  # rows: MARK_BITS / 64 at most
        self.bits[bits.column("at").to_numpy()] = bits.column("bits").to_numpy().view(np.uint64)

    def __getitem__(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & np.uint64(MARK_BITS - 1)
        return (self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _word_hashes(counts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_hashed(lang, [word]) for lang, word in zip(batch.column("lang").to_pylist(), batch.column("word").cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], names=["h"])

    return counts.select("lang", "word").mapInArrow(run, "h bigint")


class Coded:
    """Words of one language as numbers from 1, texts added one after the other."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []

    def add(self, words: list[bytes]) -> None:
        coded, known = pa.array(words, pa.binary()).dictionary_encode(), self.known
        place = np.array([known.setdefault(w, len(known) + 1) for w in coded.dictionary.to_pylist()], np.int32)
        self.parts.append(place[coded.indices.to_numpy()])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Coded]]:
    """Words of one language and their breaks, many texts at once."""
    waiting: dict[str, Coded] = {}
    held = 0
    for batch in steps(batches):
        found: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            own = found.setdefault(lang, [])
            own += pieces(text)
            own.append(_BREAK)
        for lang, own in found.items():
            waiting.setdefault(lang, Coded()).add(own)
            held += len(own)
        if held > _CHUNK:
            yield from waiting.items()
            waiting, held = {}, 0
    yield from waiting.items()


class Chunk:
    """Coded words with the hashes of their numbers; which words, and pairs of a word and its next, may be frequent."""

    def __init__(self, lang: str, coded: Coded, mark: Marks):
        self.known, self.ids = list(coded.known), np.concatenate(coded.parts)
        self.hashes = np.r_[np.uint64(0), _hashed(lang, self.known)]
        usual = np.r_[False, mark[self.hashes[1:]] & np.array([w != _BREAK for w in self.known], bool)][self.ids]
        self.pairs = np.flatnonzero(usual[:-1] & usual[1:])  # where they start

    def pair_hashes(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return mix(mix(self.hashes[first]) + self.hashes[second])


def _pairs(source: DataFrame, mark) -> DataFrame:
    """(h, n): pairs of words that may be frequent, by 64 bits of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, coded in _chunks(batches):
            own = Chunk(lang, coded, mark.value)
            wide = len(own.known) + 1
            code, n = np.unique(own.ids[own.pairs].astype(np.int64) * wide + own.ids[own.pairs + 1], return_counts=True)
            if len(code):
                yield pa.RecordBatch.from_arrays([pa.array(own.pair_hashes(code // wide, code % wide).view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])

    return source.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))


def _suffixes(source: DataFrame, mark, pair_mark, depth: int) -> DataFrame:
    """(lang, suffix, n): the suffixes of two or more words, each cut before the first pair that is surely rare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, coded in _chunks(batches):
            own = Chunk(lang, coded, mark.value)
            goes_on = np.zeros(len(own.ids) + depth, bool)
            goes_on[own.pairs] = pair_mark.value[own.pair_hashes(own.ids[own.pairs], own.ids[own.pairs + 1])]
            starts, ids = np.flatnonzero(goes_on), np.r_[own.ids, np.zeros(depth, np.int32)]
            table, alive = np.zeros((len(starts), depth), np.int32), np.ones(len(starts), bool)
            table[:, 0] = ids[starts]
            for k in range(1, depth):
                alive &= goes_on[starts + k - 1]
                table[:, k] = np.where(alive, ids[starts + k], 0)
            text = pa.array([None, *(w if w != _BREAK else None for w in own.known)], pa.binary()).cast(pa.string())
            for lo in range(0, len(table), 50_000):
                part = table[lo : lo + 50_000]
                joined = pc.binary_join_element_wise(*(text.take(pa.array(c)) for c in part.T), " ", null_handling="skip")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), joined], names=["lang", "suffix"])

    # Counted in the tasks first; sampling and routing read these counts, so texts are cut once.
    return source.mapInArrow(run, "lang string, suffix string").groupBy("lang", "suffix").agg(F.count("*").alias("n"))


def frequent_beginnings(table: np.ndarray, n: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(a suffix, depth, count) of every beginning that ``least`` suffixes have or that may go on in another task.

    ``table`` holds a suffix per row: numbers in the order of the words, 0 after its end; ``n`` says how often it
    is there.  Pointers to rows are sorted by three-way partitions on one column at a time.
    """
    edges = []  # the first and the last suffix
    for pick in (np.min, np.max):
        rows = np.arange(len(table))
        for k in range(table.shape[1]):
            column = table[rows, k]
            rows = rows[column == pick(column)] if len(rows) else rows
        edges.append(table[rows[0]].tolist() if len(rows) else [])
    out, order = [], np.arange(len(table))
    stack = [(0, len(table), 0, True, True)] if len(table) else []
    while stack:
        lo, hi, depth, first, last = stack.pop()
        own = order[lo:hi]
        value = table[own, depth]
        pivot = int(np.sort(value[[0, len(value) // 2, -1]])[1])
        low, same, high = own[value < pivot], own[value == pivot], own[value > pivot]
        order[lo:hi] = np.concatenate([low, same, high])
        a, b = lo + len(low), hi - len(high)
        if len(low) and (n[low].sum() >= least or first and edges[0][depth] < pivot or last and edges[1][depth] < pivot):
            stack.append((lo, a, depth, first and edges[0][depth] < pivot, last and edges[1][depth] < pivot))
        if len(high) and (n[high].sum() >= least or first and edges[0][depth] > pivot or last and edges[1][depth] > pivot):
            stack.append((b, hi, depth, first and edges[0][depth] > pivot, last and edges[1][depth] > pivot))
        if pivot:  # 0 is the end of the suffixes
            begins, ends, count = first and edges[0][depth] == pivot, last and edges[1][depth] == pivot, int(n[same].sum())
            if count >= least or begins or ends:
                out.append((int(same[0]), depth + 1, count))
                if depth + 1 < table.shape[1]:
                    stack.append((a, b, depth + 1, begins, ends))
    return out


def _sorted(suffixes: DataFrame, rows: int, least: int, depth: int) -> DataFrame:
    """(lang, phrase, words, f) of all phrases of two or more words that occur ``least`` times; about ``rows`` suffixes are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = [b for b in batches if b.num_rows]
        if not given:
            return
        rows = pa.Table.from_batches(given)
        split = pc.split_pattern(rows.column("suffix").combine_chunks(), " ")
        sizes, flat = pc.list_value_length(split).to_numpy(), pc.list_flatten(split)
        del given
        # The language is the first word of a suffix; words are numbered in the order of their bytes, as Spark sorts them.
        columns = []
        for values in (rows.column("lang").combine_chunks(), flat):
            coded = values.dictionary_encode()
            by_bytes = pc.sort_indices(coded.dictionary.cast(pa.binary())).to_numpy()
            rank = np.empty(len(by_bytes), np.int32)
            rank[by_bytes] = np.arange(1, len(by_bytes) + 1)
            columns.append((rank[coded.indices.to_numpy()], [None, *coded.dictionary.take(pa.array(by_bytes)).to_pylist()]))
        (langs, lang_names), (words, names) = columns
        table = np.zeros((len(sizes), depth + 1), np.int32)
        table[:, 0] = langs
        row = np.repeat(np.arange(len(sizes)), sizes)
        table[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1] = words
        found = [(r, d, c) for r, d, c in frequent_beginnings(table, rows.column("n").to_numpy(), least) if d >= 3]
        if found:
            told = [(lang_names[table[r, 0]], " ".join(names[w] for w in table[r, 1:d]), d - 1, c) for r, d, c in found]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*told), (pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["lang", "phrase", "words", "f"])

    parts = max(int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // SORTED))
    routed = suffixes.repartitionByRange(parts, "lang", F.split("suffix", " "))
    counted = routed.mapInArrow(run, "lang string, phrase string, words int, f bigint")
    return counted.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """All phrases of 2 to ``most_words`` words with at least ``least`` occurrences, and the counts of all words.

    Returns (lang, phrase, words, f) and (lang, word, n), both written tables.
    """
    if most_words < 2 or least < 1:
        raise ValueError("phrases have two or more words and occur at least once")
    source = _source(docs, text, lang)
    counts = stored(word_counts(source), "word_counts")
    send = docs.sparkSession.sparkContext.broadcast
    mark = send(Marks(_word_hashes(counts.where(F.col("n") >= least))))
    pairs = stored(_pairs(source, mark).where(F.col("n") >= least), "pairs")
    pair_mark = send(Marks(pairs.select("h")))
    starts = pairs.agg(F.sum("n")).first()[0] or 0
    return stored(_sorted(_suffixes(source, mark, pair_mark, most_words), starts, least, most_words), "phrases"), counts


def _split_scores(found: DataFrame, counts: DataFrame, total: DataFrame) -> DataFrame:
    """The lowest-scoring cut of every phrase: a, l, r, n, score."""
    words = F.split("phrase", " ")
    cuts = found.select("lang", "phrase", F.col("f").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    ends = F.array(F.struct(F.lit(True).alias("left"), F.array_join(F.slice("w", 1, F.col("k")), " ").alias("part"), (F.col("k") == 1).alias("one")),
                   F.struct(F.lit(False).alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("part"), (F.size("w") - F.col("k") == 1).alias("one")))
    ends = cuts.select("lang", "phrase", "a", "k", F.explode(ends).alias("e")).select("lang", "phrase", "a", "k", "e.*")
    ends = ends.withColumn("salt", F.when(F.col("one"), F.pmod(F.hash("phrase"), F.lit(SALTS))).otherwise(0))
    single = counts.select("lang", F.col("word").alias("part"), F.col("n").alias("f"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("one"))
    known = found.select("lang", F.col("phrase").alias("part"), "f", F.lit(0).alias("salt"), F.lit(False).alias("one")).unionByName(single)
    cut = ends.join(known, ["lang", "part", "salt", "one"]).groupBy("lang", "phrase", "a", "k").agg(F.max(F.when(F.col("left"), F.col("f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("f"))).alias("r"))
    exact = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products of two have 38 digits
    cut = cut.join(total, "lang").withColumn("top", exact("a") * 1000 * exact("n")).withColumn("low", exact("l") * exact("r"))
    cut = cut.withColumn("score", F.expr("top div low").cast("long"))
    least = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("m"))
    return least.select("lang", "phrase", "m.a", "m.l", "m.r", "m.n", "m.score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, most_words: int = MOST_WORDS, top: int = TOP) -> DataFrame:
    """The best collocations of every language: lang, rank, phrase, a, l, r, n, score.

    Words are what blanks and tabs part in the lower-cased (A-Z) pieces between ``.,;:!?`` and line breaks.  a, l
    and r are the occurrences of the phrase and of the two parts of its weakest cut, n all words of the language,
    score floor(1000 a n / (l r)).  A phrase inside a longer one with as many occurrences is left out: one
    word more is enough to ask, as all phrases between the two occur as often.

    Null and empty texts have no words; a null language is ``und``; repeated rows count each; a table without
    frequent phrases gives no row.  Only the two columns named are read, so other columns' names don't matter.
    """
    found, counts = phrases(docs, text, lang, least, most_words)
    words = F.split("phrase", " ")
    inner = F.array(F.slice(words, 1, F.col("words") - 1), F.slice(words, 2, F.col("words") - 1))
    longer = found.where("words > 2").select("lang", F.explode(inner).alias("w"), "f").select("lang", F.array_join("w", " ").alias("phrase"), F.col("f").alias("a"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("a"))
    frequent = counts.where(F.col("n") >= least).select("lang", "word", "n")
    total = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    scored = _split_scores(found, frequent, total).join(longer, ["lang", "phrase", "a"], "left_anti")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", place.cast("long")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
