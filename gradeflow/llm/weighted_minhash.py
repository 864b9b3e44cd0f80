"""Near-duplicate documents by improved consistent weighted sampling.

A document is a weighted set of five-word shingles (TF-IDF).  Consistent
weighted samples agree with the probability of the weighted Jaccard similarity;
bands of samples give candidates, and the exact similarity decides.

Equal texts are one class from the start.  In a band every class meets the
smallest class first; what is then one component needs no further pairs, and the
documents of different components that still meet in a band are all compared there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import SMALL_STEP_BYTES, Hashes, as_bytes, mix, sieved, steps, stored, words
from gradeflow.llm.graph import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 3
#: Counters of document frequency (hashed): their table has a fixed size.
COUNTERS = 1 << 18
#: How far rare shingles outweigh common ones: weights lie in [1, 1 + RARITY].  Small, so that
#: a large group of copies, which makes its own shingles common, keeps its similarity.
RARITY = 0.1
#: Documents of one band that meet in one cell; more are spread over pairs of blocks.
BLOCK = 256
_PLACES = 1 << 16
#: Words whose hashes a task remembers at most.
_REMEMBERED = 100_000
#: What :func:`words` finds a word in.
HAS_WORD = "[0-9A-Za-z]|[^\\x00-\\x7F]"


def shingles(texts: list[bytes | None], hashes: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[bytes]]]:
    """Document, hash and frequency of the distinct shingles, sorted by document and hash; and the words.

    A text of one to four words is one shingle.
    """
    found = [words(t) for t in texts]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = hashes([w for own in found for w in own])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(found)), sizes)
    at = np.arange(len(flat))
    code = np.zeros(len(flat), np.uint64)
    left = ends[owner] - at if len(flat) else at
    for k in range(SHINGLE):  # past the end of a short text nothing is added
        inside = left > k
        code[inside] += mix(flat[at[inside] + k] + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    start = np.r_[0, ends[:-1]]
    whole = (left >= SHINGLE) | ((at == (start[owner] if len(flat) else at)) & (sizes[owner] < SHINGLE))
    code, owner = mix(code[whole]), owner[whole]
    order = np.lexsort((code, owner))
    code, owner = code[order], owner[order]
    new = np.r_[True, (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])] if len(code) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return owner[first], code[first], np.diff(np.r_[first, len(code)]), found


class Weights:
    """TF-IDF weights from hashed document frequencies.

    Every counter also holds shingles that share it; their usual share, the
    median of all counters, is taken off again.
    """

    def __init__(self, counts: np.ndarray, documents: int):
        spare = max(0.0, float(np.median(counts)) - 1) if len(counts) else 0.0
        frequency = np.maximum(counts - spare, 1.0)
        scale = np.log(max(documents, 2))
        self.rarity = (1 + RARITY * np.clip(np.log(max(documents, 2) / frequency) / scale, 0, 1)).astype(np.float32)

    def __call__(self, code: np.ndarray, times: np.ndarray) -> np.ndarray:
        return self.rarity[(code % np.uint64(COUNTERS)).astype(np.int64)] * (1 + np.log(times.astype(np.float32)))


class Sampler:
    """Improved consistent weighted sampling with variables looked up by hash."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 20240501):
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2.0, 1.0, (samples, _PLACES)).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, (samples, _PLACES))).astype(np.float32)
        self.beta = rng.random((samples, _PLACES)).astype(np.float32)
        self.odd = rng.integers(1, 1 << 63, samples, dtype=np.uint64) | np.uint64(1)

    def __call__(self, code: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(documents, samples): the sampled shingle and level of each document, as one number."""
        log_w = np.log(weight)
        out = np.empty((len(starts), len(self.odd)), np.uint64)
        place = np.arange(len(code), dtype=np.int64)
        for k, odd in enumerate(self.odd):
            spread = code * odd
            one, two = (spread >> np.uint64(48)).astype(np.int64), (spread >> np.uint64(32) & np.uint64(0xFFFF)).astype(np.int64)
            r, beta = self.r[k][one], self.beta[k][one]
            level = np.floor(log_w / r + beta)
            value = self.log_c[k][two] - r * (level - beta + 1)
            bits = value.view(np.int32).astype(np.int64)
            bits = np.where(bits < 0, bits ^ 0x7FFFFFFF, bits)  # ordered as the values
            best = np.minimum.reduceat(bits << 31 | place, starts) & 0x7FFFFFFF
            out[:, k] = mix(code[best] + level[best].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return out


@cache
def _sampler() -> Sampler:
    """The variables of sampling, drawn once per Python worker."""
    return Sampler()


def _frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Counters of document frequency over all documents, and the number of documents with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = Hashes(_REMEMBERED), np.zeros(COUNTERS + 1, np.int64)
        for batch in steps(batches, most=SMALL_STEP_BYTES):
            owner, code, _, _ = shingles(batch.column("text").to_pylist(), hashes)
            counts[:COUNTERS] += np.bincount((code % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
            counts[COUNTERS] += len(np.unique(owner))
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["place", "n"])

    rows = docs.select("text").mapInArrow(run, "place int, n bigint").groupBy("place").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(COUNTERS + 1, np.int64)
    counts[rows["place"].to_numpy()] = rows["n"].to_numpy()
    return counts[:COUNTERS], int(counts[COUNTERS])


def _signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """Per document: digest of its word sequence, total weight and band keys (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sampler = Hashes(_REMEMBERED), _sampler()
        for batch in steps(batches, most=SMALL_STEP_BYTES):
            owner, code, times, found = shingles(batch.column("text").to_pylist(), hashes)
            weight = weights(code, times)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, np.int64)
            bands, totals = [None] * len(found), np.zeros(len(found))
            if len(starts):
                samples = sampler(code, weight, starts).reshape(len(starts), BANDS, ROWS)
                keys = np.zeros((len(starts), BANDS), np.uint64)
                for k in range(ROWS):
                    keys = mix(keys + samples[:, :, k] + np.arange(1, BANDS + 1, dtype=np.uint64))
                totals[owner[starts]] = np.add.reduceat(weight.astype(np.float64), starts)
                for d, row in zip(owner[starts].tolist(), keys.view(np.int64)):
                    bands[d] = row
            same = [xxhash.xxh3_128_hexdigest(b" ".join(own)) if own else None for own in found]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("own"), pa.array(same, pa.string()), pa.array(totals), pa.array(bands, pa.list_(pa.int64()))], names=["id", "own", "same", "weight", "bands"])

    return docs.mapInArrow(run, "id bigint, own bigint, same string, weight double, bands array<bigint>")


def similarity(one: tuple, two: tuple) -> float:
    """Weighted Jaccard similarity of two documents given as (codes, weights), codes sorted."""
    both, at, to = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    low = np.minimum(one[1][at], two[1][to]).sum(dtype=np.float64)
    return float(low / (one[1].sum(dtype=np.float64) + two[1].sum(dtype=np.float64) - low)) if len(one[0]) or len(two[0]) else 0.0


def _verified(pairs: DataFrame, docs: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """The pairs (a, b) whose documents are similar enough.

    Only texts of documents in pairs are shuffled: their ids are first sieved by
    a broadcast set of id buckets, of a fixed size at most.
    """
    pairs = stored(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    texts = sieved(docs, "id", ids)
    # Ids of repeated rows hold one text here: the smallest.
    texts = texts.groupBy("id").agg(F.min("text").alias("text"))
    joined = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(_REMEMBERED)
        last, left = None, None

        def weighed(text: bytes) -> tuple:
            _, code, times, _ = shingles([text], hashes)
            return code, weights(code, times)

        for batch in batches:
            kept = []
            for a, b, x, y in zip(*(batch.column(c) for c in ("a", "b", "text_a", "text_b"))):
                a, b = a.as_py(), b.as_py()
                if a != last:
                    last, left = a, weighed(x.as_py())
                if similarity(left, weighed(y.as_py())) >= threshold:
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return stored(joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint"), "verified")


def _across(placed: DataFrame, reps: DataFrame, docs: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """Links between different components that meet in a band: every such pair is compared where it meets.

    Pairs are never rows: what leaves a cell is the links that join components.
    A large band is spread over pairs of blocks, and a pair that shares several
    bands is compared in the first.
    """
    sizes = placed.groupBy("band").agg(F.count("*").alias("n"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("long")
    rows = placed.join(sizes, "band").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    ids = placed.select("rep").distinct()
    known = sieved(docs, "id", ids).groupBy("id").agg(F.min("text").alias("text")).join(reps.select(F.col("rep").alias("id"), "bands"), "id")
    rows = rows.join(known.withColumnRenamed("id", "rep"), "rep").select("band", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "root", "bands", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes(_REMEMBERED)
        cell, members, found = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("band", "low", "high", "own", "rep", "root", "bands", "text"))):
                band, low, high, own, rep, root = (x.as_py() for x in row[:6])
                if (band, low, high) != cell:
                    found += compare(cell, members)
                    cell, members = (band, low, high), []
                _, code, times, _ = shingles([row[7].as_py()], hashes)
                members.append((own, rep, root, row[6].as_py(), code, weights(code, times)))
        found += compare(cell, members)
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    def compare(cell: tuple, members: list[tuple]) -> list[tuple[int, int]]:
        if len({m[2] for m in members}) < 2:
            return []
        own, root, bands = (np.array([m[i] for m in members]) for i in (0, 2, 3))
        totals = np.array([m[5].sum(dtype=np.float64) for m in members])
        equal = bands[:, None, :] == bands[None, :, :]
        here = int(np.argmax(bands[0] == cell[0]))
        wanted = np.triu(equal.argmax(2) == here, 1) & (root[:, None] != root[None, :])
        if cell[1] != cell[2]:
            wanted &= own[:, None] != own[None, :]
        # The weight of common shingles, as either document has them, bounds the similarity from above.
        codes, column = np.unique(np.concatenate([m[4] for m in members]), return_inverse=True)
        owner = np.repeat(np.arange(len(members)), [len(m[4]) for m in members])
        value = np.concatenate([m[5] for m in members])
        common = np.zeros(wanted.shape, np.float32)
        for at in range(0, len(codes), 4096):
            part = (column >= at) & (column < at + 4096)
            table = np.zeros((len(members), min(4096, len(codes) - at)), np.float32)
            table[owner[part], column[part] - at] = value[part]
            common += table @ (table > 0).astype(np.float32).T
        bound = np.minimum(common, common.T) * (1 + 1e-4)
        wanted &= bound >= threshold * (totals[:, None] + totals[None, :] - bound)
        leader, links = {}, []

        def lead(r: int) -> int:
            while r in leader:
                r = leader[r]
            return r

        for i, j in zip(*np.nonzero(wanted)):
            one, two = lead(members[i][2]), lead(members[j][2])
            if one != two and similarity(members[i][4:], members[j][4:]) >= threshold:
                leader[max(one, two)] = min(one, two)
                links.append((members[i][1], members[j][1]))
        return links

    cells = rows.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high", "rep")
    return stored(cells.mapInArrow(run, "a bigint, b bigint"), "links_across")


def _row(key: str, text: str) -> F.Column:
    """Key of a row: 64 bits from its id and text, so rows of a null or repeated id are told apart."""
    return F.xxhash64(F.col(key).cast("long"), F.col(text).cast("string").cast("binary"))


def _groups(docs: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """Per row: id (its key), own (its doc id) and first (nameless, own, id), the first row of its group; null without words."""
    source = as_bytes(docs, key, text).select(F.col(key).cast("long").alias("own"), _row(key, "text").alias("id"), "text")
    weights = Weights(*_frequencies(source))
    signed = stored(_signatures(source, weights), "signatures")
    usable = signed.where(F.col("same").isNotNull())
    place = F.struct(F.col("own").isNull().alias("nameless"), "own", "id")
    reps = stored(usable.groupBy("same").agg(F.min(place).alias("first"), F.min("id").alias("rep"), F.first("weight").alias("weight"), F.first("bands").alias("bands")), "representatives")
    banded = reps.select("rep", "weight", F.explode("bands").alias("band"))
    leaders = banded.groupBy("band").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = stored(banded.join(leaders, "band"), "bands")
    lead = reps.select(F.col("rep").alias("leader"), F.col("weight").alias("leader_weight"))
    # The similarity is at most the ratio of the total weights.
    near = F.least("weight", "leader_weight") >= F.greatest("weight", "leader_weight") * (threshold - 1e-6)
    first = met.where("rep != leader").select("rep", "leader", "weight").distinct().join(lead, "leader").where(near)
    links = _verified(first.select(F.col("leader").alias("a"), F.col("rep").alias("b")), source, weights, threshold)
    roots = components(links)
    placed = met.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("band", "rep", "weight", F.coalesce("root", "rep").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("band")
    placed = stored(placed.join(mixed, "band", "left_semi"), "mixed_bands")
    more = _across(placed, reps, source, weights, threshold)
    roots = components(links.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))).unionByName(more))
    placed = reps.select("same", "rep", "first").join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("same", "first", F.coalesce("root", "rep").alias("root"))
    placed = stored(placed, "groups")
    named = placed.select("same", "root").join(placed.groupBy("root").agg(F.min("first").alias("first")), "root").select("same", "first")
    return signed.select("id", "own", "same").join(named, "same", "left")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row per document: ``key`` and class_id, the smallest id of its group of near duplicates.

    Similar means a weighted Jaccard similarity of at least ``threshold``; groups
    are the connected components.  Ids are integers.  Every row is a document by
    its own text, with a null or repeated id as well; class_id is null where no
    row of the group has an id.  A document without words (null or empty text) is
    a class of its own (class_id is its id).
    """
    own = docs.schema[key].dataType
    found = _groups(docs, key, text, threshold)
    return found.select(F.col("own").cast(own).alias(key), F.when(F.col("first").isNull(), F.col("own")).otherwise(F.col("first.own")).cast(own).alias("class_id"))


def first_of_class(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """The documents less near duplicates: of each group the row of the smallest id stays (once).

    A group without ids keeps one row.  Rows without words and without an id all stay.
    """
    bare = F.col(key).isNull() & ~F.coalesce(F.col(text).cast("string").rlike(HAS_WORD), F.lit(False))
    found = _groups(docs.where(~bare), key, text, threshold)
    kept = found.where(F.col("first").isNull() | (F.col("first.id") == F.col("id"))).select(F.col("id").alias("_row")).distinct()
    single = docs.where(~bare).withColumn("_row", _row(key, text)).join(kept, "_row", "left_semi").dropDuplicates(["_row"])
    return single.select(docs.columns).unionByName(docs.where(bare))
