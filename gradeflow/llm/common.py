"""Words, batches and durable tables shared by the operators of this package."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.session import new_work_path

#: Bytes of text handled at once inside a task; one longer document is a step of its own.
STEP_BYTES = 4 << 20
#: The same for work that keeps many numbers per word.
SMALL_STEP_BYTES = 1 << 20

_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_FOLD = bytes((b | 0x20 if 0x41 <= b <= 0x5A else b) if b in _KEEP or 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_LINE_FOLD = _FOLD[:10] + b"\n" + _FOLD[11:]


def words(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: A-Z lower-cased; runs of digits, letters and all characters above ASCII."""
    return text.translate(_FOLD).split() if text else []


def folded(text: bytes | None) -> bytes:
    """A text whose words are separated by single-byte blanks and line breaks, for :func:`word_hashes`."""
    return text.translate(_LINE_FOLD) if text else b""


def as_bytes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The two columns an operator reads, the text as UTF-8 bytes; other columns never travel."""
    return docs.select(F.col(key), F.col(text).cast("string").cast("binary").alias("text"))


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their texts pass ``most`` bytes, so that a task's memory has a bound."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.diff(np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset :][: batch.num_rows + 1]) if batch.column(column).type in (pa.binary(), pa.string()) else np.full(batch.num_rows, 1024)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(lo, hi - lo)


class Hashes:
    """64-bit hashes of words; frequent words are remembered, and the memory is emptied when full."""

    def __init__(self, most: int = 300_000):
        self.most, self.known = most, {}

    def __call__(self, found: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        except KeyError:
            if len(known) > self.most:
                known.clear()
            digest = xxhash.xxh3_64_intdigest
            for w in set(found):
                if w not in known:
                    known[w] = digest(w)
            return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def word_hashes(folded: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of all words of a folded text, found in whole arrays.

    Words are runs of bytes above the blank.  Eight bytes at a time go into a
    word's hash; words beyond 64 bytes are hashed one by one.
    """
    inside = np.frombuffer(folded, np.uint8) > 0x20
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    padded = folded + bytes(8)
    eights = np.ndarray(len(folded) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    sizes = ends - starts
    found = sizes.astype(np.uint64)
    rest = np.flatnonzero(sizes <= 64)
    done = 0
    while len(rest):
        left = np.minimum(sizes[rest] - done, 8).astype(np.uint64)
        piece = eights[starts[rest] + done] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - left) * np.uint64(8)))
        found[rest] = mix(found[rest] * np.uint64(0x9E3779B97F4A7C15) ^ piece)
        done += 8
        rest = rest[sizes[rest] > done]
    for k in np.flatnonzero(sizes > 64).tolist():
        found[k] = xxhash.xxh3_64_intdigest(folded[starts[k] : ends[k]])
    return starts, ends, found


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all their bits (a multiply-xorshift step)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def held_out(doc_id) -> F.Column:
    """Whether a document is kept out of training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def in_training(doc_id: int | str | None) -> bool:
    """The same rule for one id."""
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 4 != 2


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from it: lineage ends there."""
    path = new_work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hashed_bucket(key, buckets: int = 1 << 20) -> F.Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def sieved(rows: DataFrame, key, ids: DataFrame, buckets: int = 1 << 20) -> DataFrame:
    """``rows`` less those whose key is surely not in the one column of ``ids``, before a join shuffles them.

    What is broadcast is the set of hash buckets of the ids: ``buckets`` numbers at most.
    """
    used = ids.select(hashed_bucket(ids.columns[0], buckets).alias("_bucket")).distinct()
    return rows.withColumn("_bucket", hashed_bucket(key, buckets)).join(F.broadcast(used), "_bucket", "left_semi").drop("_bucket")


#: Letters by their category: other numerals are none.
HAS_LETTER = regex.compile(r"\p{L}")
