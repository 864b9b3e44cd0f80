"""Toxicity by two Kneser-Ney language models, one of toxic and one of other texts.

A model knows words and pairs of neighbouring words.  A pair's probability is its
discounted count in the class and, for what the discount took, the probability of
the pair in both classes together, which itself backs off to the number of
distinct left words that its right word follows.  A word's own is its discounted
count in the class with the same last backoff.  So the classes share their lower
orders, and only what was learned of a class tells.

A text is scored by the difference of its two log likelihoods, once by words and
once by pairs.  A toxic text need not be toxic throughout: each token is taken
from the toxic model with probability ``TOXIC_SHARE``, from the other one else.
No evidence is dropped, and one rare word can't outweigh a text.  A logistic
regression on both differences and the length gives the score.

Counts are exact and cover all labelled texts outside the held-out fold.  They
are dealt out by the hash of the left word; pairs of the texts to be scored are
packed by blocks of texts and sent to the counts, and sums per text come back.
Where the texts to be scored are those learned from, the same packed pairs give
the counts too (:func:`train_and_score`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import SMALL_STEP_BYTES, Hashes, as_bytes, held_out, mix, sieved, steps, stored, words

DISCOUNT = 0.75
#: Probability that a token of a toxic text is drawn from the toxic model.
TOXIC_SHARE = 0.01
THRESHOLD = 0.3
#: Labelled documents the logistic regression is fitted on at most.
CALIBRATION_DOCS = 20_000
#: Training folds: crc32 of the id modulo 4, less the held-out 2.
FOLDS = (0, 1, 3)
#: Counts are kept per training fold and class: slot 2 * (place in FOLDS) + class.
SLOTS = 2 * len(FOLDS)
#: Model 0 learns from all training folds, model k from all but FOLDS[k - 1].
MODELS = 1 + len(FOLDS)
#: Texts packed together: their bytes and their number at most.
BLOCK_BYTES, BLOCK_DOCS = 28 << 20, 1 << 15
#: Words are known by so many bits of their hash.
BITS = 48
#: Bytes of text per part of the counts, and limits of the number of parts.
PART_BYTES, FEWEST, MOST = 64 << 20, 16, 256
#: A text's mark by its block: its slot, so much more if it is also scored by the other folds, or none.
_CROSSED, _NONE = 8, 255
_START, _END = np.uint64(1), np.uint64(2)
_SUMS = [f"s{i}" for i in range(4 * MODELS + 2)]


# Arrays in a row


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes, equal bytes of all items side by side."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], np.int64).tobytes()
    raw = head + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(packed: bytes) -> list[np.ndarray]:
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at, out = 8 + 16 * n, []
    for size, length in np.frombuffer(raw, np.int64, 2 * n, 8).reshape(-1, 2).tolist():
        planes = np.frombuffer(raw, np.uint8, size * length, at).reshape(size, length)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{size}").ravel())
        at += size * length
    return out


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal items begin, and their lengths."""
    begins = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
    return begins, np.diff(begins, append=len(x))


def _steps_of(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.uint64(0))


@dataclass
class Cells:
    """Counts by first word, second word and owner (a text or a slot), in this order; words are places in ``vocab``."""

    vocab: np.ndarray
    first: np.ndarray
    second: np.ndarray
    owner: np.ndarray
    times: np.ndarray

    @staticmethod
    def summed(vocab: np.ndarray, first: np.ndarray, second: np.ndarray, owner: np.ndarray, owners: int, times: np.ndarray | None = None) -> Cells:
        v, n = np.uint64(max(len(vocab), 1)), np.uint64(max(owners, 1))
        code = first.astype(np.uint64)
        for factor, more in ((v, second), (n, owner)):
            code *= factor
            code += more.astype(np.uint64)
        if times is None:
            code.sort()
            begins, times = _runs(code)
        else:
            order = np.argsort(code)
            code = code[order]
            begins, _ = _runs(code)
            times = np.add.reduceat(times[order].astype(np.int64), begins) if len(begins) else times[:0]
        code = code[begins]
        owner = (code % n).astype(np.int32)
        code //= n
        return Cells(vocab, (code // v).astype(np.int32), (code % v).astype(np.int32), owner, times.astype(np.int32))

    def pair(self) -> np.ndarray:
        """A number for each cell's pair."""
        return self.first.astype(np.int64) * len(self.vocab) + self.second

    def by_part(self, parts: int, *more: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Packed cells of each part that the hash of the first word falls in; ``more`` is told per second word."""
        ends = np.searchsorted(self.first, np.searchsorted(_part(self.vocab, parts), np.arange(parts + 1)))
        for p in np.flatnonzero(np.diff(ends)).tolist():
            f, s, o, t = (x[ends[p] : ends[p + 1]] for x in (self.first, self.second, self.owner, self.times))
            pair, owners = _runs(f.astype(np.int64) * len(self.vocab) + s)
            left, pairs = _runs(f[pair])
            known, place = np.unique(s[pair], return_inverse=True)
            numbers = (x.astype(np.uint32) for x in (pairs, place, owners, o, t, *(m[known] for m in more)))
            yield p, _pack(_steps_of(self.vocab[f[pair][left]]), _steps_of(self.vocab[known]), *numbers)


def _part(word: np.ndarray, parts: int) -> np.ndarray:
    return (word >> np.uint64(BITS - (parts.bit_length() - 1))).astype(np.int64)


@dataclass
class Packed:
    """What one packed row holds: pairs by their words, and cells by their pair."""

    left: np.ndarray  # distinct first words
    at: np.ndarray  # the pair's place in them
    right: np.ndarray  # the pair's second word
    pair: np.ndarray  # of each cell
    owner: np.ndarray
    times: np.ndarray
    more: list[np.ndarray]  # per pair

    @staticmethod
    def read(packed: bytes) -> Packed:
        left, known, pairs, place, owners, owner, times, *more = _unpack(packed)
        left, known = np.cumsum(left, dtype=np.uint64), np.cumsum(known, dtype=np.uint64)
        return Packed(left, np.repeat(np.arange(len(left)), pairs), known[place], np.repeat(np.arange(len(place)), owners), owner.astype(np.int64), times.astype(np.int64), [m[place].astype(np.int64) for m in more])


def _blocks(batches: Iterator[pa.RecordBatch], mark: str) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of texts: their rows without the texts, the marks, their distinct words, and of all words in turn the place there and the text.

    Every text with words has a mark of its begin before them and one of its end after them.
    """
    hashes, held, parts, size, n = Hashes(150_000), [], [], 0, 0

    def block():
        vocab = np.unique(np.concatenate([p[0] for p in parts]))
        at = np.concatenate([np.searchsorted(vocab, p[0]).astype(np.int32)[p[1]] for p in parts])
        return held, np.concatenate([b.column(mark).to_numpy() for b in held]), vocab, at, np.concatenate([p[2] for p in parts])

    for batch in steps(batches, most=SMALL_STEP_BYTES):
        for start in range(0, batch.num_rows, BLOCK_DOCS // 2):
            rows = batch.slice(start, BLOCK_DOCS // 2)
            texts = rows.column("text").to_pylist()
            found = [words(t) for t in texts]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ends = np.cumsum(sizes)
            word = (hashes([w for own in found for w in own]) >> np.uint64(64 - BITS)) | np.uint64(4)
            some = sizes > 0
            # at one place an end comes before the next begin
            word = np.insert(word, np.r_[ends[some], (ends - sizes)[some]], np.repeat([_END, _START], some.sum()))
            if n + len(found) > BLOCK_DOCS:
                yield block()
                held, parts, size, n = [], [], 0, 0
            vocab, at = np.unique(word, return_inverse=True)
            # copies, as a column would keep its whole batch in memory
            held.append(pa.RecordBatch.from_pydict({c: pa.array(rows.column(c).to_pylist(), rows.column(c).type) for c in rows.schema.names if c != "text"}))
            parts.append((vocab, at.astype(np.int32), np.repeat(np.arange(n, n + len(found), dtype=np.int32), np.where(some, sizes + 2, 0))))
            size, n = size + sum(len(t or b"") for t in texts), n + len(found)
            if size > BLOCK_BYTES:
                yield block()
                held, parts, size, n = [], [], 0, 0
    if held:
        yield block()


# Counts


def _counts(labelled: DataFrame, parts: int) -> DataFrame:
    """By part of the left word: the pairs with their counts by slot, and the words with theirs by model and class.

    Pairs meet first by their right word, which tells how many distinct left words it follows.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marked():
            for b in batches:
                slot = np.searchsorted(FOLDS, b.column("fold").to_numpy()) * 2 + (b.column("toxic").to_numpy() != 0)
                yield pa.RecordBatch.from_arrays([b.column("text"), pa.array(slot.astype(np.int32))], names=["text", "slot"])

        for _, slot, vocab, at, owner in _blocks(marked(), "slot"):
            here = owner[1:] == owner[:-1]
            found = list(Cells.summed(vocab, at[1:][here], at[:-1][here], slot[owner[1:][here]], SLOTS).by_part(parts))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], names=["part", "packed"])

    def follow(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        found = [Packed.read(b) for b in rows.column("packed").to_pylist()]
        right, left = (np.concatenate(x) for x in (([f.left[f.at[f.pair]] for f in found]), [f.right[f.pair] for f in found]))
        vocab, at = np.unique(np.concatenate([right, left]), return_inverse=True)
        cells = Cells.summed(vocab, at[len(right) :], at[: len(right)], np.concatenate([f.owner for f in found]), SLOTS, np.concatenate([f.times for f in found]))
        pair, _ = _runs(cells.pair())
        table = _dense(np.repeat(np.arange(len(pair)), np.diff(np.r_[pair, len(cells.first)])), cells.owner, cells.times, len(pair))
        follows = cells.second[pair]
        number = np.bincount(follows, minlength=len(vocab))
        met = np.stack([np.bincount(follows, n, len(vocab)) for k in range(MODELS) for n in _classes(table, k)])
        own = np.flatnonzero(number)
        sums = [*met.sum(1), *np.minimum(met, DISCOUNT).sum(1), number.sum(), len(own)]
        told = [(int(key[0].as_py()), None, _pack(vocab[own], number[own].astype(np.uint32), *met[:, own].astype(np.uint32)), *map(float, sums))]
        told += [(p, b, None, *([0.0] * len(sums))) for p, b in cells.by_part(parts, number)]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*told), [pa.int32(), pa.binary(), pa.binary(), *([pa.float64()] * len(sums))])], names=["part", "pairs", "words", *_SUMS])

    met = labelled.select("fold", "toxic", "text").mapInArrow(pairs, "part int, packed binary").groupBy("part")
    return met.applyInArrow(follow, f"part int, pairs binary, words binary, {', '.join(f'{s} double' for s in _SUMS)}")


def _dense(row: np.ndarray, slot: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row * SLOTS + slot, times, n * SLOTS).reshape(n, SLOTS).astype(np.int32)


def _classes(table: np.ndarray, model: int) -> list[np.ndarray]:
    """Counts of both classes in the folds a model learns from."""
    return [sum(table[:, 2 * f + c] for f in range(len(FOLDS)) if f != model - 1) for c in (0, 1)]


# Likelihoods


def _mixed(ratio: np.ndarray) -> np.ndarray:
    """Log likelihood ratio of a token of a toxic text, of which a share is from the toxic model."""
    return np.log1p(TOXIC_SHARE * np.expm1(np.minimum(ratio, 50.0)))


def _discounted(count: np.ndarray, total: np.ndarray, kinds: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Kneser-Ney: what is left of the count, and the lower order by what was taken; the lower order alone for an unknown context."""
    return np.where(total > 0, (np.maximum(count - DISCOUNT, 0) + DISCOUNT * kinds * lower) / np.maximum(total, 1), lower)


class Table:
    """The counts of one part, as log ratios by word and by pair."""

    def __init__(self, words: list[bytes], totals: list[float] | None, left: np.ndarray, right: np.ndarray, follows: np.ndarray, table: np.ndarray):
        """``follows`` tells per pair how many distinct left words its right word follows, ``table`` its counts by slot."""
        some = [_unpack(b) for b in words]
        self.word, number, *met = (np.concatenate(x) for x in zip(*some)) if some else (np.zeros(0, np.uint64), np.zeros(0), *[np.zeros(0)] * (2 * MODELS))
        self.met, self.number, self.sums = [x.astype(float) for x in met], number.astype(float), np.ones(len(_SUMS)) if totals is None else np.array(totals, float)
        self.right, self.follows, self.table = right, follows.astype(float), table
        self.left, self.at = np.unique(left, return_inverse=True)
        key = _key(left, self.right)
        self.order = np.argsort(key)
        self.key = key[self.order]
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    @staticmethod
    def read(rows: pa.Table) -> Table:
        """From rows of :func:`_counts` with the totals."""
        found = [Packed.read(b) for b in rows.column("pairs").to_pylist() if b is not None]
        cat = lambda xs, kind: np.concatenate([np.zeros(0, kind), *xs])
        left, right = cat([f.left[f.at] for f in found], np.uint64), cat([f.right for f in found], np.uint64)
        before = np.cumsum([0, *(len(f.at) for f in found)])
        table = _dense(cat([f.pair + b for f, b in zip(found, before)], np.int64), cat([f.owner for f in found], np.int64), cat([f.times for f in found], np.int64), len(left))
        words = [b for b in rows.column("words").to_pylist() if b is not None]
        return Table(words, rows.column("totals")[0].as_py() if rows.num_rows else None, left, right, cat([f.more[0] for f in found], np.int64), table)

    def values(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By model ``k``: of the words, of the pairs, and of unknown pairs by their left word."""
        if k not in self.known:
            total, taken = self.sums[2 * k : 2 * k + 2], self.sums[2 * MODELS + 2 * k :][:2]
            all_pairs, all_words = self.sums[-2:]
            shared = lambda number: (number + 0.5) / (all_pairs + 0.5 * (all_words + 1))
            by_word = [(np.maximum(m - DISCOUNT, 0) + taken[c] * shared(self.number)) / total[c] if total[c] else shared(self.number) for c, m in enumerate(self.met[2 * k : 2 * k + 2])]
            n = len(self.left)
            own = _classes(self.table, k)
            both = own[0] + own[1]
            sums, kinds = ([np.bincount(self.at, x, n) for x in xs] for xs in ((*own, both), (own[0] > 0, own[1] > 0, both > 0)))
            lower = _discounted(both, sums[2][self.at], kinds[2][self.at], shared(self.follows))
            # the lower order of a pair new to this model is the same in both classes, so any will do
            lower = np.where(both > 0, lower, 1.0)
            by_pair = [_discounted(own[c], sums[c][self.at], kinds[c][self.at], lower) for c in (0, 1)]
            new = [_discounted(np.zeros(n), sums[c], kinds[c], np.ones(n)) for c in (0, 1)]
            self.known[k] = tuple(_mixed(np.log(x[1]) - np.log(x[0])) for x in (by_word, by_pair, new))
        return self.known[k]

    def sums_of(self, packed: Packed, *models: np.ndarray) -> list[np.ndarray]:
        """Of the texts of a block, by each array of models: the part's share of the ratios by word and by pair; 0 by model -1."""
        outs = [np.zeros((2, len(model))) for model in models]
        if not len(self.key):
            return outs
        word, left, pair = _found(self.word, packed.left), _found(self.left, packed.left), _found(self.key, _key(packed.left[packed.at], packed.right))
        for out, model in zip(outs, models):
            for k in np.unique(model[model >= 0]).tolist():
                by_word, by_pair, new = (np.r_[x, 0.0] for x in self.values(k))
                here = slice(None) if (model == k).all() else model[packed.owner] == k
                owner, times, cell = packed.owner[here], packed.times[here], packed.pair[here]
                of_pair = np.where(pair >= 0, by_pair[self.order[pair]], new[left][packed.at])
                out += [np.bincount(owner, x[cell] * times, len(model)) for x in (by_word[word][packed.at], of_pair)]
        return outs


def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(mix(left) + right)


def _found(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in the sorted ``known``; -1: not there."""
    if not len(known):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, at, -1)


_LISTS = "ids array<{0}>, marks array<int>, sizes array<int>"


def _asked(docs: DataFrame, key: str, parts: int) -> DataFrame:
    """Rows by part: the packed pairs of each block of texts and, once a block, its keys, marks and numbers of words."""
    names = ["part", "block", "packed", "ids", "marks", "sizes", "models"]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, (held, mark, vocab, at, owner) in enumerate(_blocks(batches, "mark")):
            here = owner[1:] == owner[:-1]
            sizes = np.maximum(np.bincount(owner, minlength=len(mark)) - 2, 0)
            found = list(Cells.summed(vocab, at[:-1][here], at[1:][here], owner[1:][here], len(mark)).by_part(parts))
            ids = pa.concat_arrays([b.column(key) for b in held])
            model = _pack(np.where(mark < 0, 0, mark // 2 + 1).astype(np.uint8))
            n = len(found)
            # known by its rows, so that a block dealt out anew in another order fails to meet what the first one sent
            block = xxhash.xxh3_64_intdigest(repr((task, i, ids.to_pylist()))) - (1 << 63)
            one = lambda x: pa.ListArray.from_arrays([0, len(x)], x)
            yield pa.RecordBatch.from_arrays([pa.array([task % parts], pa.int32()), pa.array([block]), pa.array([None], pa.binary()), one(ids), one(pa.array(mark.astype(np.int32))), one(pa.array(sizes.astype(np.int32))), pa.array([None], pa.binary())], names=names)
            if n:
                none = [pa.nulls(n, pa.list_(t)) for t in (ids.type, pa.int32(), pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([block] * n), pa.array([b for _, b in found], pa.binary()), *none, pa.array([model] * n, pa.binary())], names=names)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text", "mark").mapInArrow(asked, f"part int, block bigint, packed binary, {_LISTS.format(kind)}, models binary")


def _ratios(docs: DataFrame, key: str, counts: DataFrame, parts: int) -> DataFrame:
    """Per row: key, mark, its ratios by word and by pair, and its number of words.

    ``mark`` is -1 for a text scored by all counts, or the slot of a training text, scored by the other folds.
    """
    kind = docs.schema[key].dataType.simpleString()
    lists, names = _LISTS.format(kind), ["ids", "marks", "sizes"]

    def answered(left: pa.Table, right: pa.Table) -> pa.Table:
        table = Table.read(left)
        sums = [None if b is None else table.sums_of(Packed.read(b), _unpack(m)[0].astype(np.int64))[0].astype(np.float32).tobytes() for b, m in zip(right.column("packed").to_pylist(), right.column("models").to_pylist())]
        return pa.Table.from_arrays([right.column("block"), pa.array(sums, pa.binary()), *(right.column(c) for c in names)], names=["block", "sums", *names])

    def added(rows: pa.Table) -> pa.Table:
        head = next(i for i, s in enumerate(rows.column("sizes").is_valid().to_pylist()) if s)
        ids, marks, sizes = (rows.column(c)[head].values for c in names)
        total = sum((np.frombuffer(s, np.float32).astype(float) for s in rows.column("sums").to_pylist() if s is not None), np.zeros(2 * len(sizes))).reshape(2, -1)
        return pa.Table.from_arrays([ids, marks, *map(pa.array, total), sizes], names=[key, "mark", "by_word", "by_pair", "size"])

    totals = counts.agg(F.array(*(F.sum(s) for s in _SUMS)).alias("totals"))
    known = counts.select("part", "pairs", "words").crossJoin(F.broadcast(totals))
    met = known.groupBy("part").cogroup(_asked(docs, key, parts).groupBy("part")).applyInArrow(answered, f"block bigint, sums binary, {lists}")
    return met.groupBy("block").applyInArrow(added, f"`{key}` {kind}, mark int, by_word double, by_pair double, size int")


# Counts and likelihoods of one table


def _own_ratios(docs: DataFrame, key: str, marks: DataFrame, parts: int) -> DataFrame:
    """The rows of :func:`_ratios` for all texts, by the counts of the marked ones among them.

    ``marks`` holds id, the slot of a training text and whether it is also scored
    by the other folds.  The pairs of a training text are among those that all
    texts send by their left word, so they travel once, for counts and for
    ratios; only marks follow them, by block.  The left words' parts tell those
    of the right words what they met, and get the numbers of left words back.
    """
    kind = docs.schema[key].dataType.simpleString()
    sums = ", ".join(f"{s} double" for s in _SUMS)
    asked = _asked(docs.withColumn("mark", F.lit(-1)), key, parts).repartition("part")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, ids in zip(b.column("block"), b.column("ids")):
                if ids.is_valid:
                    n = len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block.as_py())), pa.array(np.arange(n, dtype=np.int32)), ids.values], names=["block", "place", "id"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, found in zip(b.column("block").to_pylist(), b.column("found")):
                packed = _pack(found.values.to_numpy().astype(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(parts, dtype=np.int32)), pa.array(["marks"] * parts), pa.array([block] * parts, pa.int64()), pa.array([packed] * parts, pa.binary())], names=["part", "what", "origin", "packed"])

    def learned(rows: pa.Table, others: pa.Table) -> pa.Table:
        found = Learned(rows, _of(others, "marks"))
        number, met = np.bincount(found.second, minlength=len(found.vocab)), [np.bincount(found.second, x, len(found.vocab)) for x in found.table.T]
        part = others.column("part")[0].as_py() if others.num_rows else 0
        told = [(q, part, _pack(_steps_of(found.vocab[own]), number[own].astype(np.uint32), *(m[own].astype(np.uint32) for m in met))) for q, own in found.rights(parts)]
        return pa.Table.from_arrays([pa.array([t[k] for t in told], t_) for k, t_ in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["to", "part", "packed"])

    def followed(rows: pa.Table) -> pa.Table:
        found = [_unpack(b) for b in rows.column("packed").to_pylist()]
        vocab, at = np.unique(np.concatenate([np.cumsum(f[0], dtype=np.uint64) for f in found]), return_inverse=True)
        number, *slots = (np.bincount(at, np.concatenate([f[k] for f in found])) for k in range(1, SLOTS + 2))
        met = np.stack([n for k in range(MODELS) for n in _classes(np.stack(slots, 1), k)])
        to = rows.column("to")[0].as_py()
        totals = [*met.sum(1), *np.minimum(met, DISCOUNT).sum(1), number.sum(), len(vocab)]
        told = [(to, "words", to, _pack(vocab, number.astype(np.uint32), *met.astype(np.uint32)), *map(float, totals))]
        back = np.split(number[at].astype(np.uint32), np.cumsum([len(f[0]) for f in found])[:-1])
        told += [(part, "numbers", to, _pack(n), *([0.0] * len(totals))) for part, n in zip(rows.column("part").to_pylist(), back)]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*told), [pa.int32(), pa.string(), pa.int64(), pa.binary(), *([pa.float64()] * len(totals))])], names=["part", "what", "origin", "packed", *_SUMS])

    def answered(rows: pa.Table, others: pa.Table) -> pa.Table:
        mark = _of(others, "marks")
        totals = next((t for t in others.column("totals").to_pylist() if t is not None), None)
        table = Learned(rows, mark).counted([b for _, b in sorted(_of(others, "numbers").items())], list(_of(others, "words").values()), totals, parts)
        blocks, out = rows.column("block").to_pylist(), []
        for block, packed in zip(blocks, rows.column("packed").to_pylist()):
            if packed is None:
                out.append(None)
                continue
            of = _unpack(mark[block])[0].astype(np.int64)
            crossed = (of != _NONE) & (of >= _CROSSED)
            every, other = table.sums_of(Packed.read(packed), np.zeros(len(of), np.int64), np.where(crossed, of % _CROSSED // 2 + 1, -1))
            out.append(np.concatenate([every.ravel(), other[:, crossed].ravel()]).astype(np.float32).tobytes())
        ids = rows.column("ids")
        known = [mark[b] if i else None for b, i in zip(blocks, ids.is_valid().to_pylist())]
        return pa.Table.from_arrays([rows.column("block"), pa.array(out, pa.binary()), ids, pa.array(known, pa.binary()), rows.column("sizes")], names=["block", "sums", "ids", "marks", "sizes"])

    def added(rows: pa.Table) -> pa.Table:
        head = next(i for i, s in enumerate(rows.column("sizes").is_valid().to_pylist()) if s)
        ids, sizes, of = rows.column("ids")[head].values, rows.column("sizes")[head].values, _unpack(rows.column("marks")[head].as_py())[0]
        n, crossed = len(of), np.flatnonzero((of != _NONE) & (of >= _CROSSED))
        total = sum((np.frombuffer(s, np.float32).astype(float) for s in rows.column("sums").to_pylist() if s is not None), np.zeros(2 * (n + len(crossed))))
        both = np.concatenate([total[: 2 * n].reshape(2, -1), total[2 * n :].reshape(2, -1)], 1)
        at = pa.array(np.r_[np.arange(n), crossed])
        mark = np.r_[np.full(n, -1), of[crossed] % _CROSSED].astype(np.int32)
        return pa.Table.from_arrays([ids.take(at), pa.array(mark), *map(pa.array, both), sizes.take(at)], names=[key, "mark", "by_word", "by_pair", "size"])

    code = F.coalesce(F.col("slot") + F.when(F.col("crossed"), _CROSSED).otherwise(0), F.lit(_NONE))
    marked = asked.mapInArrow(heads, f"block bigint, place int, id {kind}").join(marks, "id", "left").select("block", F.struct("place", code.cast("int").alias("mark")).alias("found"))
    told = marked.groupBy("block").agg(F.array_sort(F.collect_list("found")).alias("found")).select("block", F.col("found.mark").alias("found"))
    told = told.mapInArrow(dealt, "part int, what string, origin bigint, packed binary")
    met = asked.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(learned, "to int, part int, packed binary")
    counts = met.groupBy("to").applyInArrow(followed, f"part int, what string, origin bigint, packed binary, {sums}")
    totals = counts.agg(F.array(*(F.sum(s) for s in _SUMS)).alias("totals"))
    others = counts.select("part", "what", "origin", "packed").crossJoin(F.broadcast(totals)).unionByName(told.withColumn("totals", F.lit(None).cast("array<double>")))
    back = asked.groupBy("part").cogroup(others.groupBy("part")).applyInArrow(answered, f"block bigint, sums binary, ids array<{kind}>, marks binary, sizes array<int>")
    return back.groupBy("block").applyInArrow(added, f"`{key}` {kind}, mark int, by_word double, by_pair double, size int")


def _of(rows: pa.Table, what: str) -> dict[int, bytes]:
    """What is told to a part, by its origin."""
    return {o: b for w, o, b in zip(*(rows.column(c).to_pylist() for c in ("what", "origin", "packed"))) if w == what}


class Learned:
    """The pairs of the training texts whose left word is of one part, with their counts by slot; words are places in ``vocab``."""

    def __init__(self, rows: pa.Table, marks: dict[int, bytes]):
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for block, packed in zip(rows.column("block").to_pylist(), rows.column("packed").to_pylist()):
            if packed is not None:
                f, of = Packed.read(packed), _unpack(marks[block])[0]
                mark = of[f.owner]
                here = mark != _NONE
                pair = f.pair[here]
                found.append((f.left[f.at[pair]], f.right[pair], mark[here].astype(np.int64) % _CROSSED, f.times[here]))
        left, right, slot, times = map(np.concatenate, zip(*found))
        self.vocab, at = np.unique(np.concatenate([left, right]), return_inverse=True)
        cells = Cells.summed(self.vocab, at[: len(left)], at[len(left) :], slot, SLOTS, times)
        pair, sizes = _runs(cells.pair())
        self.first, self.second = cells.first[pair], cells.second[pair]
        self.table = _dense(np.repeat(np.arange(len(pair)), sizes), cells.owner, cells.times, len(pair))

    def rights(self, parts: int) -> list[tuple[int, np.ndarray]]:
        """The distinct right words by their part."""
        own = np.unique(self.second)
        ends = np.searchsorted(_part(self.vocab[own], parts), np.arange(parts + 1))
        return [(q, own[ends[q] : ends[q + 1]]) for q in range(parts) if ends[q] < ends[q + 1]]

    def counted(self, numbers: list[bytes], words: list[bytes], totals: list[float] | None, parts: int) -> Table:
        """With the numbers of left words that the right words follow, in the order of their parts."""
        number = np.zeros(len(self.vocab))
        for (_, own), packed in zip(self.rights(parts), numbers, strict=True):
            number[own] = _unpack(packed)[0]
        return Table(words, totals, self.vocab[self.first], self.vocab[self.second], number[self.second], self.table)


# Score


def _features(by_word: np.ndarray, by_pair: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Both ratios by the length and by its root; and the root's inverse."""
    n = np.maximum(size, 1).astype(np.float64)
    return np.stack([np.ones(len(n)), by_word / n, by_word / np.sqrt(n), by_pair / n, by_pair / np.sqrt(n), np.where(size > 0, 1 / np.sqrt(n), 0)], 1)


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression with a small penalty on centred and scaled features, by Newton steps halved until they help."""
    mean, scale = np.r_[0.0, x[:, 1:].mean(0)], np.r_[1.0, np.maximum(x[:, 1:].std(0), 1e-9)]
    z, w, penalty = (x - mean) / scale, np.zeros(x.shape[1]), 0.1 * np.r_[1e-6, np.ones(x.shape[1] - 1)]
    loss = lambda w: np.logaddexp(0, z @ w).sum() - y @ (z @ w) + 0.5 * penalty @ w**2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) + penalty * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), slope)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        if np.abs(step).max() <= 1e-9:
            break
        w = w - step
    w = w / scale
    return np.r_[w[0] - w @ mean, w[1:]]


def _known(labels: DataFrame, key: str, label: str) -> DataFrame:
    """Labels to learn from: id and toxic."""
    return labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(F.col(label).cast("int")).alias("toxic")).where(~held_out("id"))


def _labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """Training rows: id, text, toxic and fold.

    Labels grow with the documents, so the two meet by a shuffle of the sieved
    texts at every size; a broadcast while the labels are few would make the cost
    jump where they no longer are.
    """
    known = _known(labels, key, label)
    source = as_bytes(docs, key, text).withColumnRenamed(key, "id")
    joined = sieved(source, "id", known.select("id")).join(known.hint("shuffle_hash"), "id")
    return joined.withColumn("fold", F.crc32(F.col("id").cast("string").cast("binary")) % 4)


@dataclass
class Model:
    counts: DataFrame
    parts: int
    calibration: DataFrame  # text and slot of the documents the regression is fitted on


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Count all labelled documents outside the held-out fold.

    All of them give the counts, which Spark makes when a text is scored.  The
    regression is fitted on at most ``CALIBRATION_DOCS`` of them by hash, each
    scored by the counts of the other folds (by the crc32 of the id) than its
    own.  A document labelled more than once counts once, by its largest label;
    null labels and ids are ignored.
    """
    parts = _parts(docs, text)
    fitted_on = as_bytes(docs, key, text).withColumnRenamed(key, "id").join(F.broadcast(_chosen(docs, labels, key, label)), "id").select("text", _slot().alias("mark"))
    return Model(_counts(_labelled(docs, labels, key, text, label), parts), parts, fitted_on)


def _parts(docs: DataFrame, text: str) -> int:
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    return min(max(1 << (size // PART_BYTES).bit_length(), FEWEST), MOST)


def _chosen(docs: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """What the regression is fitted on: id and toxic."""
    return _known(labels, key, label).join(docs.select(F.col(key).alias("id")).distinct(), "id").orderBy(F.xxhash64("id"), "id").limit(CALIBRATION_DOCS)


def _slot() -> F.Column:
    """The slot of a row with id and toxic."""
    return (F.lit(2) * sum((F.when(F.crc32(F.col("id").cast("string").cast("binary")) % 4 == f, i).otherwise(0) for i, f in enumerate(FOLDS)), F.lit(0)) + F.when(F.col("toxic") != 0, 1).otherwise(0)).cast("int")


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Toxicity of every document, by its whole text.

    Returns ``key``, score (0 to 1, higher: more likely toxic) and predicted (1
    from ``THRESHOLD``).  A text without words gets the score of no evidence;
    without labels every score is low.  Repeated rows repeat.
    """
    given = as_bytes(docs, key, text).withColumn("mark", F.lit(-1))
    fitted_on = model.calibration.select(F.lit(None).cast(docs.schema[key].dataType).alias(key), "text", "mark")
    return _calibrated(_ratios(given.unionByName(fitted_on), key, model.counts, model.parts), key)


def train_and_score(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """What ``score(docs, train(docs, labels))`` gives, with each text read and its pairs sent once for both."""
    chosen = _chosen(docs, labels, key, label).select("id", F.lit(True).alias("crossed"))
    marks = _known(labels, key, label).select("id", _slot().alias("slot")).join(F.broadcast(chosen), "id", "left").select("id", "slot", F.coalesce("crossed", F.lit(False)).alias("crossed"))
    return _calibrated(_own_ratios(as_bytes(docs, key, text), key, marks, _parts(docs, text)), key)


def _calibrated(ratios: DataFrame, key: str) -> DataFrame:
    """Scores of the rows of mark -1 by a regression on the others."""
    rows = stored(ratios, "toxic_ratios")
    fitted = rows.where("mark >= 0").select("mark", "by_word", "by_pair", "size").limit(CALIBRATION_DOCS).toPandas()
    toxic = fitted["mark"].to_numpy(np.int64) % 2
    weights = [5.0 if toxic.any() else -5.0, *[0.0] * 5]
    if len(np.unique(toxic)) > 1:
        weights = _logistic(_features(*(fitted[c].to_numpy(float) for c in ("by_word", "by_pair", "size"))), toxic.astype(float)).tolist()
    n = F.greatest(F.col("size"), F.lit(1)).cast("double")
    terms = [w * F.col(c) / d for w, (c, d) in zip(weights[1:], ((c, d) for c in ("by_word", "by_pair") for d in (n, F.sqrt(n))))]
    linear = sum(terms, F.lit(weights[0])) + F.when(F.col("size") > 0, weights[5] / F.sqrt(n)).otherwise(0.0)
    scored = rows.where("mark < 0").select(key, (1 / (1 + F.exp(-linear))).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
