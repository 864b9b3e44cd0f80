"""Document probability over all segmentations into the pieces of an existing vocabulary.

The vocabulary is that of a given model file, and so are its scores.  Scores of a unigram
model are log probabilities; those of a byte-pair model are ranks and are read as weights
1 / (rank + 2).  Bytes are pieces too, so that every text has a segmentation.

A text is a sequence of tokens, each with a word mark before it, and an end.  A token is
either a word learned from the corpus (its count less a discount) or, with the discounted
mass, a string of pieces: the sum over all its segmentations, by a forward recursion in log
space.  Pieces hold a word mark only at their start, so the recursion over a text passes
through every word mark, and the text's probability is the product over its tokens.

The given scores weight the segmentations of all distinct training words; the pieces' expected
numbers there, and the given weights as a prior, are the weights a text is scored with.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as spec

from gradeflow.llm.common import steps, stored

MARK = "▁".encode()
#: The end of a text, counted as a token; words are never empty.
END = b""
#: A word with more than one occurrence in so many is known to every task: there are fewer than that.
FREQUENT = 1 << 18
#: Longer words are known by a digest, so that what tasks are sent has a bound.
LONG = 64
#: Pieces that the given weights count for beside the expected ones.
PRIOR = 30_000.0
#: Words, and bytes of texts, that a task counts before it hands its counts on.
_WORDS, _BYTES = 500_000, 128 << 20

_FOLD = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased, parted by blanks, tabs and line breaks (codes 9 to 13)."""
    return text.translate(_FOLD).split() if text else []


def name(word: bytes) -> bytes:
    """The word, or if it is long a digest that no text holds."""
    return word if len(word) <= LONG else b"\xff" + hashlib.sha256(word).digest()


def existing_weights(model: bytes) -> dict[bytes, float]:
    """Probabilities of the pieces (as bytes), of single bytes and of the end, by the scores of a model file."""
    proto = spec.ModelProto()
    proto.ParseFromString(model)
    normal = [p for p in proto.pieces if p.type in (1, 4)]
    if proto.trainer_spec.model_type == spec.TrainerSpec.UNIGRAM:
        weight = [math.exp(p.score) for p in normal]
    else:
        weight = [1 / (2 - p.score) for p in normal]
    least = min((w for w in weight if w > 1e-8), default=1.0)
    found: dict[bytes, float] = {END: least}
    for piece in (bytes([b]) for b in range(256)):
        found[piece] = least
    for p, w in zip(normal, weight):
        found[p.piece.encode()] = found.get(p.piece.encode(), 0.0) + w
    total = sum(found.values())
    return {p: w / total for p, w in found.items()}


class Lattice:
    """All segmentations of a string into pieces."""

    def __init__(self, weights: dict[bytes, float]):
        self.log = {p: math.log(w) for p, w in weights.items() if w > 0}
        self.end = self.log[END]
        # Ends of pieces that are no pieces themselves: 1, which is no log probability.
        self.known = {p[k:]: 1.0 for p in self.log for k in range(1, len(p))} | self.log

    def forward(self, text: bytes) -> tuple[list[float], list[tuple[list[int], list[float], float]]]:
        """Log probability of every beginning of the text, and where the pieces that end it start, with their shares and these' sum."""
        get, alpha, arcs = self.known.get, [0.0], [([], [], 1.0)]
        for end in range(1, len(text) + 1):
            starts, terms, at = [], [], end
            while at:
                at -= 1
                found = get(text[at:end])
                if found is None:  # no piece ends so, nor does a longer one
                    break
                if found <= 0:
                    starts.append(at)
                    terms.append(alpha[at] + found)
            top = max(terms)
            shares = [exp(t - top) for t in terms]
            total = sum(shares)
            alpha.append(top + log(total))
            arcs.append((starts, shares, total))
        return alpha, arcs

    def marginal(self, word: bytes) -> float:
        """Log probability of a token, over all its segmentations."""
        return self.forward(MARK + word)[0][-1] if word else self.end

    def expected(self, word: bytes, into: dict[bytes, float]) -> None:
        """Add the expected number of every piece in the segmentations of a token."""
        if not word:
            into[END] = into.get(END, 0.0) + 1
            return
        text = MARK + word
        _, arcs = self.forward(text)
        passed, get = [0.0] * (len(text) + 1), into.get  # probability that a segmentation has a bound here
        passed[-1] = 1.0
        for end in range(len(text), 0, -1):
            here = passed[end]
            if here > 1e-9:
                starts, shares, total = arcs[end]
                here /= total
                for at, share in zip(starts, shares):
                    share *= here
                    passed[at] += share
                    piece = text[at:end]
                    into[piece] = get(piece, 0.0) + share


def in_training(doc_id: str, parts: int, out: int) -> F.Column:
    """Whether a document is learned from: the crc32 of its id as text, modulo ``parts``, is not ``out``; so are null ids."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts != out, F.lit(True))


def _counted(source: DataFrame) -> DataFrame:
    """(name, word, c): all tokens of all texts with their number in the training texts; 0 if they are elsewhere only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, other, read = Counter(), set(), 0

        def told() -> pa.RecordBatch:
            words = [*here, *(other - here.keys())]
            return pa.RecordBatch.from_arrays([pa.array([name(w) for w in words], pa.binary()), pa.array(words, pa.binary()), pa.array([here[w] for w in words], pa.int64())], names=["name", "word", "c"])

        for batch in steps(batches):
            for trains, text in zip(batch.column("trains").to_pylist(), batch.column("text").to_pylist()):
                found = tokens(text)
                found.append(END)
                (here if trains else other).update(found)
                read += len(text or b"")
            if len(here) + len(other) > _WORDS or read > _BYTES:
                yield told()
                here, other, read = Counter(), set(), 0
        if here or other:
            yield told()

    counts = source.select("trains", "text").mapInArrow(run, "name binary, word binary, c bigint")
    return counts.groupBy("name").agg(F.min("word").alias("word"), F.sum("c").alias("c"))


def _adapted(words: DataFrame, given: dict[bytes, float]) -> dict[bytes, float]:
    """Weights of the pieces from their expected numbers in all distinct training words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, found = Lattice(given), {}
        for batch in steps(batches, "word"):
            for word in batch.column("word").to_pylist():
                lattice.expected(word, found)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()))], names=["piece", "n"])

    rows = words.select("word").mapInArrow(run, "piece binary, n double").groupBy("piece").agg(F.sum("n").alias("n"))
    seen = {r["piece"] if r["piece"] else END: r["n"] for r in rows.toLocalIterator()}  # the vocabulary at most
    total = math.fsum(seen.values()) + PRIOR
    return {p: (seen.get(p, 0.0) + PRIOR * w) / total for p, w in given.items()}


@dataclass
class Model:
    words: DataFrame  # name, c, base, score (log10) of every token met, a written table
    tokens: int
    distinct: int


def train(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", parts: int = 10, out: int = 0) -> Model:
    """Count the words of the training documents, and give every word met in any document its log10 probability.

    All distinct words are kept in a written table, spread over its files; the driver holds totals and the
    weights of the vocabulary's pieces.  Without training texts all mass is the pieces'.
    """
    with open(model_path, "rb") as f:
        given = existing_weights(f.read())
    words = stored(_counted(_source(docs, key, text, parts, out)), "lm_words")
    here = words.agg(F.sum("c").alias("n"), *(F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2)), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = here["n"] or 0, here["v"] or 0
    discount = here["n1"] / (here["n1"] + 2 * here["n2"]) if here["n1"] and here["n2"] else 0.5
    weights = _adapted(words.where("c > 0"), given)
    floor = math.log10(n + 0.1 * (v + 1))
    left = math.log(discount * v / n) if n else 0.0  # the mass that spelled tokens share

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(weights)
        for batch in steps(batches, "word"):
            c = batch.column("c").to_numpy().astype(np.float64)
            spelled = np.fromiter(map(lattice.marginal, batch.column("word").to_pylist()), np.float64, len(c)) + left
            with np.errstate(divide="ignore"):
                known = np.where(c > 0, np.log(np.maximum(c - discount, 0) / max(n, 1)), -np.inf)
            score = np.logaddexp(known, spelled) / math.log(10)
            yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("c"), pa.array(np.log10(c + 0.1) - floor), pa.array(score)], names=["name", "c", "base", "score"])

    return Model(stored(words.mapInArrow(run, "name binary, c bigint, base double, score double"), "lm_scores"), n, v)


def _source(docs: DataFrame, key: str, text: str, parts: int, out: int) -> DataFrame:
    return docs.select(F.col(key).alias("key"), in_training(key, parts, out).alias("trains"), F.col(text).cast("string").cast("binary").alias("text"))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", parts: int = 10, out: int = 0) -> DataFrame:
    """Per document ``key``, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of its probability).

    ``model`` must have met the documents in :func:`train`.  Frequent words (fewer than 2^18) are looked up in the
    task that reads a text; the others, none of which has more than one occurrence in 2^18, are joined.
    base_score sums log10((c + 0.1) / (N + 0.1 (V + 1))) over the tokens.

    A null text is empty and has the end as its only token.  Repeated rows and null ids give a row each; an empty
    table none.  Words may have any length.  Other columns are not read.
    """
    spark = docs.sparkSession
    usual = model.words.where(F.col("c") * FREQUENT > model.tokens).toArrow()
    kept = spark.sparkContext.broadcast((usual.column("name").to_pylist(), *(usual.column(c).to_numpy() for c in ("base", "score"))))
    kind = docs.schema[key].dataType.simpleString()
    fields = f"row bigint, key {kind}, trains boolean, n bigint, known bigint, base double, score double, name binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, base, logs = kept.value
        at = {w: i for i, w in enumerate(names)}
        base, logs = np.r_[base, 0.0], np.r_[logs, 0.0]
        row = TaskContext.get().partitionId() << 40
        for batch in steps(batches):
            whole, rare = [], []
            for text in batch.column("text").to_pylist():
                found = tokens(text)
                found.append(END)
                if max(map(len, found)) > LONG:
                    found = [name(w) for w in found]
                places = np.array([at.get(w, -1) for w in found])
                missing = Counter([found[i] for i in np.flatnonzero(places < 0).tolist()])
                whole.append((row, len(found), int((places >= 0).sum()), float(base[places].sum()), float(logs[places].sum())))
                rare += [(row, w, n) for w, n in missing.items()]
                row += 1
            if whole:
                rows, n, known, own_base, own_score = zip(*whole)
                yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column("key"), batch.column("trains"), pa.array(n), pa.array(known), pa.array(own_base), pa.array(own_score), pa.nulls(len(rows), pa.binary())], names=_FIELDS)
            for lo in range(0, len(rare), 20_000):
                rows, words, n = zip(*rare[lo : lo + 20_000])
                k = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(rows), pa.nulls(k, batch.column("key").type), pa.nulls(k, pa.bool_()), pa.array(n), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), pa.array(words, pa.binary())], names=_FIELDS)

    parted = stored(_source(docs, key, text, parts, out).mapInArrow(run, fields), "lm_parts")
    whole = parted.where("name is null").select("row", "key", "trains", "n", "known", "base", "score")
    words = model.words.select("name", "c", F.col("base").alias("b"), F.col("score").alias("s"))
    rare = parted.where("name is not null").select("row", "name", "n").join(words, "name")
    rare = rare.select("row", F.lit(None).cast(kind).alias("key"), F.lit(None).cast("boolean").alias("trains"), F.lit(0).cast("bigint").alias("n"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("known"), (F.col("b") * F.col("n")).alias("base"), (F.col("s") * F.col("n")).alias("score"))
    summed = whole.unionByName(rare).groupBy("row").agg(F.max("key").alias(key), F.max("trains").alias("trains"), *(F.sum(c).alias(c) for c in ("n", "known", "base", "score")))
    return summed.select(key, (~F.col("trains")).alias("held_out"), F.col("n").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(model.tokens).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score")


_FIELDS = ["row", "key", "trains", "n", "known", "base", "score", "name"]
