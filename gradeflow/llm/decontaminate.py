"""Benchmark decontamination by an FM-index per shard of the training texts.

Windows of benchmark words are the phrases; they travel in blocks of bounded
size.  In each task the words of a step of documents become symbols: words that
no phrase contains can't be in an occurrence and only separate.  What is left is
indexed (Burrows-Wheeler transform in a wavelet matrix, sampled suffix
positions), all phrases are searched backwards at once, occurrences are located,
and the covered words merge into removal spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeflow.llm.common import STEP_BYTES, as_bytes, words

WINDOW = 10
#: Phrases of one block, in bytes; more blocks are further passes of the same task over its rows.
BLOCK_BYTES = 16 << 20
#: Symbols indexed at once; longer stretches overlap by a phrase.
SHARD = 1 << 18
SAMPLE = 8
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_RESULT = "n_words bigint, spans array<struct<start:int,end:int>>, items array<string>"
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


class FMIndex:
    """FM-index of a sequence of symbols 1..; 0 is kept for the end."""

    def __init__(self, text: np.ndarray, sample: int = SAMPLE):
        text = np.r_[text, 0]
        n = len(text)
        order = self.suffixes(text)
        last = text[order - 1]
        counts = np.bincount(text)
        self.first = np.r_[0, np.cumsum(counts)]
        # Wavelet matrix of the transform: per bit the zeros before each place.
        self.levels: list[tuple[int, np.ndarray, int]] = []
        row = last
        for bit in range(max(1, int(last.max()).bit_length()) - 1, -1, -1):
            one = (row >> bit & 1).astype(bool)
            zeros = np.r_[0, np.cumsum(~one)].astype(np.int32)
            self.levels.append((bit, zeros, int(zeros[-1])))
            row = np.concatenate([row[~one], row[one]])
        marked = order % sample == 0
        self.marks = np.r_[0, np.cumsum(marked)].astype(np.int32)
        self.sampled = order[marked].astype(np.int32)
        self.size, self.sample = n, sample

    @staticmethod
    def suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix array by doubling the compared length."""
        n = len(text)
        rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
        length = 1
        while True:
            follow = np.zeros(n, np.int64)
            follow[: n - length] = rank[length:] + 1
            key = rank * (n + 1) + follow
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.r_[0, np.cumsum(sorted_key[1:] != sorted_key[:-1])]
            length *= 2
            if rank[order[-1]] == n - 1 or length >= n:
                return order

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place of the transform."""
        start = np.zeros_like(place)
        for bit, zeros, total in self.levels:
            one = (symbol >> bit & 1).astype(bool)
            place = np.where(one, total + place - zeros[place], zeros[place])
            start = np.where(one, total + start - zeros[start], zeros[start])
        return place - start

    def before(self, place: np.ndarray) -> np.ndarray:
        """Row of the suffix that begins one symbol earlier."""
        symbol, start = np.zeros_like(place), np.zeros_like(place)
        for bit, zeros, total in self.levels:
            one = zeros[place + 1] == zeros[place]
            symbol |= one.astype(symbol.dtype) << bit
            place = np.where(one, total + place - zeros[place], zeros[place])
            start = np.where(one, total + start - zeros[start], zeros[start])
        return self.first[symbol] + place - start

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all phrases (rows, right-aligned): which occur, and their rows [low, high)."""
        known = len(self.first) - 1
        alive = np.flatnonzero((phrases < known).all(1))
        low, high = np.zeros(len(alive), np.int64), np.full(len(alive), self.size, np.int64)
        for step in range(1, phrases.shape[1] + 1):
            active = sizes[alive] >= step
            symbol = phrases[alive, -step]
            both = self.rank(np.r_[symbol, symbol], np.r_[low, high])
            low = np.where(active, self.first[symbol] + both[: len(alive)], low)
            high = np.where(active, self.first[symbol] + both[len(alive) :], high)
            keep = low < high
            alive, low, high = alive[keep], low[keep], high[keep]
            if not len(alive):
                break
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the text of rows: walk back to a sampled suffix."""
        out, steps = np.zeros(len(rows), np.int64), 0
        todo, place = np.arange(len(rows)), rows.astype(np.int64)
        while len(todo):
            marked = self.marks[place + 1] > self.marks[place]
            out[todo[marked]] = self.sampled[self.marks[place[marked]]] + steps
            todo, place = todo[~marked], self.before(place[~marked])
            steps += 1
        return out


class Phrases:
    """A block of phrases as symbols, with the items each stands for."""

    def __init__(self, rows: list[tuple[str, list[str]]]):
        split = [p.encode().split(b" ") for p, _ in rows]
        self.items = [i for _, i in rows]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for p in split for w in p}), 1)}
        self.sizes = np.array([len(p) for p in split], np.int64)
        widest = int(self.sizes.max()) if len(rows) else 1
        self.shortest = int(self.sizes.min()) if len(rows) else 1
        self.table = np.zeros((len(rows), widest), np.int64)
        for k, p in enumerate(split):
            self.table[k, widest - len(p) :] = [self.vocabulary[w] for w in p]

    def occurrences(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all occurrences in a sequence where 0 separates, and the phrase of each."""
        inside = np.r_[False, symbols > 0, False]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        keep = ends - starts >= self.shortest
        pieces: list[tuple[int, int]] = []
        places, found = [], []
        filled = 0
        overlap = self.table.shape[1] - 1
        for a, b in zip(starts[keep].tolist(), ends[keep].tolist()):
            while True:
                end = min(b, a + SHARD)
                pieces.append((a, end))
                filled += end - a + 1
                if filled >= SHARD:
                    self._search(symbols, pieces, places, found)
                    pieces, filled = [], 0
                if end == b:
                    break
                a = end - overlap
        if pieces:
            self._search(symbols, pieces, places, found)
        return (np.concatenate(places), np.concatenate(found)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def _search(self, symbols, pieces, places, found) -> None:
        border = len(self.vocabulary) + 1
        text = np.concatenate([np.r_[symbols[a:b], border] for a, b in pieces])
        origin = np.concatenate([np.arange(a, b + 1) for a, b in pieces])
        index = FMIndex(text)
        phrase, low, high = index.search(self.table, self.sizes)
        times = high - low
        if len(phrase):
            rows = np.repeat(low - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())
            places.append(origin[index.locate(rows)])
            found.append(np.repeat(phrase, times))


def phrases(benchmark: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct phrases (window words of an item, or all of a shorter one) and the items that hold each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = [], []
            for name, t in zip(batch.column(0).to_pylist(), batch.column("text").to_pylist()):
                own = words(t)
                for k in range(max(1, len(own) - window + 1) if own else 0):
                    names.append(name)
                    found.append(b" ".join(own[k : k + window]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(found, pa.string())], names=["item", "phrase"])

    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return as_bytes(items, "item", "text").mapInArrow(run, "item string, phrase string").groupBy("phrase").agg(F.sort_array(F.collect_set("item")).alias("items"))


def _mark(batches: Iterator[pa.RecordBatch], block: Phrases, names: list[str], cutting: bool) -> Iterator[pa.RecordBatch]:
    """Add the occurrences of one block to the rows of a task; ``cutting``: and cut all spans so far from the texts."""
    get = block.vocabulary.get
    for batch in batches:
        texts = batch.column("text").to_pylist()
        cuts, size = [0], 0
        for k, t in enumerate(texts):
            size += len(t or b"")
            if size > STEP_BYTES:
                cuts, size = [*cuts, k + 1], 0
        for lo, hi in zip(cuts, [*cuts[1:], len(texts)]):
            if lo == hi:
                continue
            part = batch.slice(lo, hi - lo)
            found = [words(t) for t in texts[lo:hi]]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            begin = np.r_[0, np.cumsum(counts + 1)]
            symbols = np.zeros(begin[-1], np.int64)
            for own, b, n in zip(found, begin.tolist(), counts.tolist()):
                symbols[b : b + n] = [get(w, 0) for w in own]
            places, phrase = block.occurrences(symbols)
            cover = np.zeros(len(symbols) + 1, np.int64)
            np.add.at(cover, places, 1)
            np.add.at(cover, places + block.sizes[phrase], -1)
            before = [(part.column("spans")[k].as_py(), part.column("items")[k].as_py()) if part.column("items")[k].is_valid else ([], []) for k in range(len(found))]
            owner = np.searchsorted(begin, places, "right") - 1
            met: dict[int, set[str]] = {}
            for d, p in set(zip(owner.tolist(), phrase.tolist())):
                met.setdefault(d, set()).update(block.items[p])
            for d in met:
                for s in before[d][0]:
                    cover[begin[d] + s["start"]] += 1
                    cover[begin[d] + s["end"]] -= 1
            hit = np.cumsum(cover)[:-1] > 0
            spans, items = [], []
            for d, (old_spans, old_items) in enumerate(before):
                if d not in met:
                    spans.append(old_spans)
                    items.append(old_items)
                    continue
                own = np.diff(np.r_[0, hit[begin[d] : begin[d] + counts[d]].astype(np.int8), 0])
                spans.append([{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(own == 1), np.flatnonzero(own == -1))])
                items.append(sorted(met[d] | set(old_items)))
            new = {"n_words": pa.array(counts), "spans": pa.array(spans, pa.list_(_SPAN)), "items": pa.array(items, pa.list_(pa.string()))}
            if cutting:
                new["text"] = pa.array([cut(t.decode(), own).encode() if own else t for t, own in zip(texts[lo:hi], spans)], pa.binary())
            yield pa.RecordBatch.from_arrays([new.get(n, part.column(n) if n not in new else None) for n in names], names=names)


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, keep: list[str] = ()) -> DataFrame:
    """Occurrences of benchmark windows per document; documents are not shuffled.

    Returns ``key``, n_words, spans array<struct<start,end>> (merged ranges of hit
    words) and items array<string> (items of occurring windows, sorted as
    strings), and with ``keep`` those columns and the text without the spans, as ``_cut``.  A null text has no words; a null item
    id is ''; items without words have no windows; with an empty benchmark all
    rows are clean.  Repeated rows repeat.
    """
    distinct = phrases(benchmark, item, item_text, window)
    total = distinct.agg(F.sum(F.length("phrase") + F.size("items") * 8)).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK_BYTES))
    distinct = distinct.withColumn("block", F.pmod(F.xxhash64("phrase"), F.lit(blocks)))
    extra = [c for c in keep if c != key]
    fields = [T.StructField(key, docs.schema[key].dataType), *(T.StructField(f"kept_{k}", docs.schema[c].dataType) for k, c in enumerate(extra)), T.StructField("text", T.BinaryType())]
    schema = T.StructType([*fields, *T.StructType.fromDDL(_RESULT).fields])
    names = schema.fieldNames()
    rows = docs.select(
        F.col(key), *(F.col(c).alias(f"kept_{k}") for k, c in enumerate(extra)), F.col(text).cast("string").cast("binary").alias("text"),
        F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(None).cast("array<string>").alias("items"),
    )
    for k in range(blocks):
        block = Phrases([(r["phrase"], r["items"]) for r in distinct.where(F.col("block") == k).select("phrase", "items").toLocalIterator()])

        def run(batches, block=block, cutting=bool(keep) and k == blocks - 1):
            return _mark(batches, block, names, cutting)

        rows = rows.mapInArrow(run, schema)
    return rows.select(key, *(F.col(f"kept_{k}").alias(c) for k, c in enumerate(extra)), "n_words", "spans", "items", *([F.col("text").cast("string").alias("_cut")] if keep else []))


def summary(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and the digest of the items per document."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        key, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def cut(text: str, spans: list[dict]) -> str:
    """The text without the characters from the first to the last word of each span."""
    places = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for s in spans:
        kept.append(text[at : places[s["start"]][0]])
        at = places[s["end"] - 1][1]
    return "".join([*kept, text[at:]])


def without_spans(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with their removal spans cut out; one whose every word is hit goes.

    Columns stay, whatever their names (the row travels as one struct); ``length``
    (where it exists) becomes the new length of a cut text.
    """
    others = [c for c in docs.columns if c != text]
    packed = docs.select(F.col(key).alias("_key"), F.struct(*others).alias("_row"), F.col(text).alias("_text"))
    found = contamination(packed, benchmark, "_key", "_text", keep=["_row"])
    hit = F.size("spans") > 0
    left = F.aggregate("spans", F.col("n_words"), lambda a, s: a - (s["end"] - s["start"]))
    found = found.where(~hit | (left > 0))

    def column(c: str) -> Column:
        if c == text:
            return F.col("_cut").alias(c)
        own = F.col("_row").getField(c)
        if c == length:
            return F.when(hit, F.length("_cut").cast(docs.schema[c].dataType)).otherwise(own).alias(c)
        return own.alias(c)

    return found.select(*(column(c) for c in docs.columns))
