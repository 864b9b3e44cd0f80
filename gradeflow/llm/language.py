"""Language identification of mixed texts.

Script ranges narrow the candidates of a word, character n-grams score it in
each language, and the best sequence of languages under a switching penalty
(Viterbi) labels the spans of a text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import HAS_LETTER, SMALL_STEP_BYTES, as_bytes, held_out, steps, words

UNKNOWN = "und"
ORDERS = (2, 3, 4)
#: Hashed n-grams of a model, per order: the model has a fixed size per language.
BUCKETS = 1 << 16
#: Labelled documents a model is fitted on at most (a classifier's bounded sample).
TRAINING_DOCS = 6000
SWITCH = 16.0
OUT_OF_SCRIPT = -25.0
#: Words whose scores a task remembers, and their bytes, at most (the words of one step come on top).
REMEMBERED, REMEMBERED_BYTES = 200_000, 8 << 20

# First code points of script ranges and their scripts ("" for no letters of a script).
_RANGES = (
    (0x0, ""), (0x41, "Latin"), (0x250, ""), (0x370, "Greek"), (0x400, "Cyrillic"), (0x530, "Armenian"), (0x590, "Hebrew"), (0x600, "Arabic"),
    (0x700, ""), (0x900, "Devanagari"), (0x980, "Bengali"), (0xA00, "Gurmukhi"), (0xA80, "Gujarati"), (0xB00, ""), (0xB80, "Tamil"), (0xC00, "Telugu"),
    (0xC80, "Kannada"), (0xD00, "Malayalam"), (0xD80, ""), (0xE00, "Thai"), (0xE80, ""), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, ""),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x3040, "Kana"), (0x3100, ""), (0x3400, "Han"), (0xA000, ""), (0xAC00, "Hangul"),
    (0xD7B0, ""), (0xF900, "Han"), (0xFB00, ""), (0x20000, "Han"), (0x30000, ""),
)
_STARTS = [r[0] for r in _RANGES]
SCRIPTS = tuple(sorted({s for _, s in _RANGES if s}))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def script(word: str) -> int:
    """Index of the script of a word's first letter, -1 without one."""
    for c in word:
        if c.isalpha():
            name = _RANGES[bisect_right(_STARTS, ord(c)) - 1][1]
            return SCRIPTS.index(name) if name else -1
    return -1


def grams(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words (with a blank at either end), and the word of each."""
    buffer = np.frombuffer(b" " + b" ".join(found) + b"  ", np.uint8).astype(np.int64)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    starts = np.r_[0, np.cumsum(sizes + 1)]  # the blank before each word
    owner = np.repeat(np.arange(len(found)), sizes + 1)
    end = np.repeat(starts[1:] + 1, sizes + 1)  # just past the blank after it
    at = np.arange(len(owner))
    places, owners = [], []
    for k, n in enumerate(ORDERS):
        ok = at + n <= end
        key = np.zeros(int(ok.sum()), np.int64)
        for i in range(n):
            key = key * 263 + buffer[at[ok] + i]
        key = (key * 0x9E3779B1 >> 13) % BUCKETS
        places.append(k * BUCKETS + key)
        owners.append(owner[ok])
    return np.concatenate(places), np.concatenate(owners)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (orders * buckets, languages), log probabilities
    scripts: np.ndarray  # (scripts, languages), whether the language is written in it

    def score(self, found: list[bytes]) -> np.ndarray:
        """Log probability of each word in each language, 0 where it tells nothing.

        One more column is 1 for a word in a script that no learned language is written in.
        """
        place, owner = grams(found)
        out = np.zeros((len(found), len(self.langs)), np.float32)
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner, self.weights[place, k], len(found)) / len(ORDERS)
        kinds = np.array([script(w.decode("utf-8", "replace")) for w in found])
        allowed = self.scripts[kinds]
        out += np.where(allowed, 0.0, OUT_OF_SCRIPT)
        strange = (kinds >= 0) & ~allowed.any(1)
        out[(kinds < 0) | strange] = 0.0
        return np.column_stack([out - out.max(1, keepdims=True), strange]).astype(np.float32)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", most: int = TRAINING_DOCS) -> Model:
    """Fit on at most ``most`` labelled documents outside the held-out fold.

    The sample is the rows of the smallest hashes of the id (and all that share
    the last hash), so it does not depend on order or partitions; each is read whole.  Only its counts (a
    bounded table: n-gram buckets by language) reach the driver.  Without
    labelled rows the model has no languages.
    """
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key)).select(
        F.xxhash64(F.col(key).cast("string")).alias("h"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").cast("binary").alias("text")
    )
    last = labelled.select("h").orderBy("h").limit(most).agg(F.max("h")).first()[0]
    chosen = labelled.where(F.col("h") <= F.lit(last).cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for batch in steps(batches):
            for name, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                seen[name].update(words(t))
        for name, counts in seen.items():
            found = list(counts)
            if not found:
                continue
            times = np.fromiter(counts.values(), np.int64, len(found))
            place, owner = grams(found)
            sums = np.bincount(place, times[owner], len(ORDERS) * BUCKETS).astype(np.int64)
            kinds = np.bincount(np.array([script(w.decode("utf-8", "replace")) for w in found]) + 1, times, len(SCRIPTS) + 1).astype(np.int64)
            used, wrote = np.flatnonzero(sums), np.flatnonzero(kinds[1:])
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(used) + len(wrote))), pa.array(np.r_[used, -1 - wrote]), pa.array(np.r_[sums[used], kinds[1:][wrote]])], names=["lang", "place", "n"]
            )

    counts = chosen.drop("h").mapInArrow(run, "lang string, place bigint, n bigint").groupBy("lang", "place").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    size = len(ORDERS) * BUCKETS
    table = np.zeros((size, len(langs)))
    scripts = np.zeros((len(SCRIPTS), len(langs)))
    for k, name in enumerate(langs):
        own = counts[counts["lang"] == name]
        place, n = own["place"].to_numpy(), own["n"].to_numpy()
        table[place[place >= 0], k] = n[place >= 0]
        scripts[-1 - place[place < 0], k] = n[place < 0]
    for k in range(len(ORDERS)):
        part = table[k * BUCKETS : (k + 1) * BUCKETS]
        part[:] = np.log((part + 0.2) / (part.sum(0) + 0.2 * BUCKETS)) if len(langs) else part
    shares = scripts / np.maximum(scripts.sum(0), 1)
    return Model(langs, table.astype(np.float32), shares >= 0.001)


def best_path(scores: np.ndarray, switch: float) -> np.ndarray:
    """Language of each word on the best path (ties to the earlier language)."""
    total = scores.sum(0, dtype=np.float64)
    main = int(total.argmax())
    gain = np.cumsum(scores - scores[:, main : main + 1], 0, dtype=np.float64)
    low = np.minimum(np.minimum.accumulate(gain, 0), 0.0)
    low = np.vstack([np.zeros((1, scores.shape[1])), low[:-1]])
    # If no stretch gains more than half a switch in any other language, no path with switches beats the main language.
    if (gain - low).max() <= switch / 2:
        return np.full(len(scores), main, np.int16)
    rows = scores.tolist()
    value, back, span = rows[0], [], range(scores.shape[1])
    for row in rows[1:]:
        top = max(value)
        leader, floor = value.index(top), top - switch
        back.append([k if value[k] >= floor else leader for k in span])
        value = [(value[k] if value[k] >= floor else floor) + row[k] for k in span]
    path = [value.index(max(value))]
    for step in reversed(back):
        path.append(step[path[-1]])
    return np.array(path[::-1], np.int16)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", switch: float = SWITCH) -> DataFrame:
    """Languages of every document; one pass over whole texts, no shuffle.

    Returns ``key``, lang (the language of most words; 'und' for a null text, a
    text without letters, or an empty model), score (its share of the words, 0
    for 'und'; words in a script that no learned language is written in are no
    evidence, so a text of such words alone scores 0) and spans array<struct<lang,start,end>> in code points.  Ties go
    to the language that is first in the alphabet; repeated rows repeat.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = as_bytes(docs, key, text).mapInArrow(_labeller(model, key, switch), f"`{key}` {kind}, text binary, lang string, score double, spans array<struct<lang:string,start:bigint,end:bigint>>")
    return rows.drop("text")


def of_one_language(docs: DataFrame, model: Model, least: float, text: str = "text", switch: float = SWITCH) -> DataFrame:
    """The documents whose main language has at least ``least`` of their words; 'und' goes.

    The whole row passes through the task, so nothing is joined; columns stay.
    """
    others = [c for c in docs.columns if c != text]
    packed = docs.select(F.struct(*others).alias("row"), F.col(text).cast("string").cast("binary").alias("text"))
    row = docs.select(F.struct(*others).alias("row")).schema["row"].dataType.simpleString()
    found = packed.mapInArrow(_labeller(model, "row", switch), f"row {row}, text binary, lang string, score double, spans array<struct<lang:string,start:bigint,end:bigint>>")
    kept = found.where((F.col("lang") != UNKNOWN) & (F.col("score") >= least))
    return kept.select(*(F.col("text").cast("string").alias(text) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))


def _labeller(model: Model, key: str, switch: float):
    """The work of a task: languages of its rows; column ``key`` and the text pass through."""
    langs = model.langs
    span = pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def spans(text: str, path: np.ndarray) -> list[dict]:
        cuts = np.flatnonzero(np.diff(path)) + 1
        if not len(cuts):
            return [{"lang": langs[path[0]], "start": 0, "end": len(text)}]
        places = [m.start() for m in _WORD.finditer(text)]
        starts = [0, *(places[c] for c in cuts)]
        return [{"lang": langs[path[c]], "start": a, "end": b} for c, a, b in zip([0, *cuts], starts, [*starts[1:], len(text)])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        held = 0
        table = np.zeros((1024, len(langs) + 1), np.float32)
        for batch in steps(batches, most=SMALL_STEP_BYTES):
            texts = batch.column("text").to_pylist()
            found = [words(t) for t in texts]
            new = {w for own in found for w in own if w not in known}
            size = sum(map(len, new))
            if known and (len(known) + len(new) > REMEMBERED or held + size > REMEMBERED_BYTES):
                known, held, new = {}, 0, {w for own in found for w in own}
                size = sum(map(len, new))
            if new and langs:
                first, last = len(known), len(known) + len(new)
                if last > len(table):  # doubled, so that words are seldom copied
                    table = np.concatenate([table[:first], np.zeros((2 * last - first, len(langs) + 1), np.float32)])
                table[first:last] = model.score(list(new))
                known.update(zip(new, range(first, last)))
                held += size
            rows = []
            for t, own in zip(texts, found):
                whole = (t or b"").decode()
                if not langs or not own or not HAS_LETTER.search(whole):
                    rows.append((UNKNOWN, 0.0, []))
                    continue
                told = table[np.fromiter(map(known.__getitem__, own), np.int64, len(own))]
                path = best_path(told[:, :-1], switch)
                share = np.bincount(path, 1 - told[:, -1], len(langs)) / len(path)
                rows.append((langs[share.argmax()], float(share.max()), spans(whole, path)))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.list_(span))],
                names=[key, "text", "lang", "score", "spans"],
            )

    return run
