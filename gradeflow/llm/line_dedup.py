"""Line dedup as an exact set-similarity join.

A line is the set of its words.  Equal sets are one class.  Words are ordered by
rarity; two similar lines share a word in their prefixes, so lines meet by prefix
words, pass the length, positional and parity filters, and their Jaccard
similarity is computed from the whole sets.  What leaves a meeting is a link per
line; the components of the links meet once more, in full, where pairs are
counted and never written: a line gets its number of links and earliest partner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import SMALL_STEP_BYTES, as_bytes, folded, hashed_bucket, mix, sieved, steps, stored, word_hashes
from gradeflow.llm.graph import components

SIMILARITY = 0.8
#: Words are known by 48 bits of their hash: enough to tell the words of two lines apart, and smaller to write.
WORD_BITS = (1 << 48) - 1
_WORD_BYTES = 6
#: Hashed counters of word frequency: the order of words needs no more than a fixed table.
COUNTERS = 1 << 18
_HIGH_BITS = 48 - 18
_PIECES = 64
#: Lines of one prefix word that meet in one cell; more are spread over pairs of blocks.
BLOCK = 512
_COLUMNS = 4096
#: Marks beside a position: the line's block is the lower or the upper of a cell of two.
_LOW, _UP = 1 << 30, 1 << 31
#: Lines sorted at once: their number takes the 16 bits beside a word's 48.
_ROWS = 1 << 16
#: Rows of cells compared at once, if the cells are small.
_MEETING = 1 << 16
_LOWEST = -(1 << 63)


def _lines(docs: DataFrame) -> DataFrame:
    """Every line with words: document (id and tag), number, class (digest of its word set) and, once per task, the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: set[bytes] = set()
        for batch in steps(batches, most=SMALL_STEP_BYTES):
            texts = [folded(t) for t in batch.column("text").to_pylist()]
            opens = np.cumsum([0, *(t.count(b"\n") + 1 for t in texts)])  # number of each text's first line in the step
            joined = b"\n".join(texts)
            starts, _, flat = word_hashes(joined)
            flat &= np.uint64(WORD_BITS)
            line = np.searchsorted(np.flatnonzero(np.frombuffer(joined, np.uint8) == 10), starts)
            used, owner = np.unique(line, return_inverse=True)
            for lo in range(0, len(used), _ROWS):
                hi = min(lo + _ROWS, len(used))
                own = slice(*np.searchsorted(owner, [lo, hi]))
                yield told_lines(batch, opens, used[lo:hi], owner[own] - lo, flat[own], told)

    def told_lines(batch: pa.RecordBatch, opens: np.ndarray, used: np.ndarray, owner: np.ndarray, flat: np.ndarray, told: set[bytes]) -> pa.RecordBatch:
        """Rows of the step's lines ``used``, given their words."""
        both = np.sort(owner.astype(np.uint64) << np.uint64(48) | flat)
        both = both[np.r_[True, both[1:] != both[:-1]]]
        owner, flat = (both >> np.uint64(48)).astype(np.int64), both & np.uint64(WORD_BITS)
        counts = np.bincount(owner, minlength=len(used))
        raw, at = flat.tobytes(), 0
        same, first = [], np.zeros(len(used), bool)
        for k, end in enumerate((8 * np.cumsum(counts)).tolist()):
            digest = xxhash.xxh3_128_digest(raw[at:end])
            at = end
            same.append(digest)
            if digest not in told:
                if len(told) > 500_000:
                    told.clear()
                told.add(digest)
                first[k] = True
        doc = np.searchsorted(opens, used, "right") - 1
        sets = _packed(flat[first[owner]], counts[first])
        place = np.where(first, np.cumsum(first) - 1, 0)
        sets = sets.take(pa.array(place, mask=~first))
        taken = pa.array(doc)
        return pa.RecordBatch.from_arrays(
            [batch.column("id").take(taken), batch.column("tag").take(taken), pa.array((used - opens[doc]).astype(np.int32)), pa.array(same, pa.binary()), sets],
            names=["id", "tag", "line", "same", "words"],
        )

    return docs.mapInArrow(run, "id bigint, tag bigint, line int, same binary, words binary")


def _packed(words: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Sets of words, six bytes each: one value a line is cheaper to write and read than a list."""
    data = words.view(np.uint8).reshape(-1, 8)[:, :_WORD_BYTES].tobytes()
    offsets = (_WORD_BYTES * np.r_[0, np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and all words of a column of packed sets without nulls."""
    if not len(column):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, _WORD_BYTES)
    words = np.zeros((len(data), 8), np.uint8)
    words[:, :_WORD_BYTES] = data
    return np.diff(offsets).astype(np.int64) // _WORD_BYTES, words.view("<u8").ravel()


def _count(rows: DataFrame, places) -> np.ndarray:
    """Sum the counters that a task gives for its batches; their table has a fixed size and travels in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            counts += np.bincount(places(batch), minlength=COUNTERS)
        yield told({k: own for k, own in enumerate(counts.reshape(_PIECES, -1)) if own.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, n in zip(batch.column("piece").to_pylist(), batch.column("n")):
                own = n.values.to_numpy()
                sums[piece] = sums[piece] + own if piece in sums else own
        yield told(sums)

    def told(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
        lists = pa.array([own for own in sums.values()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), lists], names=["piece", "n"])

    schema = "piece int, n array<bigint>"
    counts = np.zeros((_PIECES, COUNTERS // _PIECES), np.int64)
    for piece, n in rows.mapInArrow(run, schema).repartition("piece").mapInArrow(add, schema).collect():
        counts[piece] = n
    return counts.ravel()


def _place(word: np.ndarray) -> np.ndarray:
    return (word % np.uint64(COUNTERS)).astype(np.int64)


class Rule:
    """The threshold and the global order of words."""

    def __init__(self, threshold: float, frequency: np.ndarray):
        self.threshold = threshold
        self.place = np.lexsort((np.arange(COUNTERS), frequency)).astype(np.uint64)  # counters from rare to frequent
        self.rank = np.empty(COUNTERS, np.uint64)
        self.rank[self.place.astype(np.int64)] = np.arange(COUNTERS, dtype=np.uint64)
        self.crowd, self.usual = np.zeros(COUNTERS, np.int32), 0

    def gather(self, crowd: np.ndarray) -> None:
        """Take in the number of prefixes that hold each counter's words."""
        self.crowd, self.usual = np.minimum(crowd, (1 << 31) - 1).astype(np.int32), int(np.median(crowd))

    def prefixes(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per prefix word: the row of its line, the word, its position, and per line its size."""
        sizes, flat = _flat(column)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        key = self.rank[_place(flat)] << np.uint64(_HIGH_BITS) | flat // np.uint64(COUNTERS)  # the words' order in 48 bits
        if len(sizes) <= _ROWS:
            key = np.sort(owner.astype(np.uint64) << np.uint64(48) | key) & np.uint64(WORD_BITS)
        else:
            key = key[np.lexsort((key, owner))]
        flat = (key & np.uint64((1 << _HIGH_BITS) - 1)) * np.uint64(COUNTERS) + self.place[(key >> np.uint64(_HIGH_BITS)).astype(np.int64)]
        position = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        length = sizes - np.ceil(self.threshold * sizes - 1e-9).astype(np.int64) + 1
        inside = position < length[owner]
        return owner[inside], flat[inside], position[inside], sizes

    def least(self, total: np.ndarray) -> np.ndarray:
        """Smallest overlap of two sets of together ``total`` words that are similar enough."""
        return np.ceil(self.threshold / (1 + self.threshold) * total - 1e-9)

    def blocks(self, word: np.ndarray) -> np.ndarray:
        """Blocks that the lines of each prefix word are spread over.

        A counter also holds words that share it; their usual number is taken off.
        """
        return -(-np.maximum(self.crowd[_place(word)] - self.usual, 1) // BLOCK)


def _parities(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128 bits per line: whether an odd number of its words falls in each of 128 buckets.

    Two sets differ by at least as many words as their bits differ, and unlike
    marks of presence the bits of long lines don't fill up.
    """
    sizes, flat = _flat(column)
    starts, bit = np.cumsum(sizes) - sizes, flat >> np.uint64(41)
    one = np.uint64(1) << (bit & np.uint64(63))
    return tuple(np.bitwise_xor.reduceat(np.where(half, one, np.uint64(0)), starts) for half in (bit < 64, bit >= 64))


def _short(column: pa.Array) -> np.ndarray:
    """64-bit class numbers from digests."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: len(column) + 1]
    digests = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return digests.reshape(-1, 16)[:, :8].copy().view(">u8").astype(np.uint64).ravel()


def _pairs_of_blocks(blocks: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Copies of each row for the pairs of blocks it takes part in: (row, its block, low block, high block)."""
    own = (mix(short) % blocks.astype(np.uint64)).astype(np.int64)
    row = np.repeat(np.arange(len(blocks)), blocks)
    other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return row, own[row], np.minimum(own[row], other), np.maximum(own[row], other)


def _candidates(sets: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) of class numbers that join all lines that may be similar: at most one per line and cell.

    Lines meet in the cells of their prefix words, known by 48 bits, and lie there by
    size; cells that clash only bring more lines together.  Which pairs pass the filters
    is seen in the cell alone; what leaves it is a link from each line to the
    smallest line it is joined with there.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                part = batch.slice(at, 8192)
                short = _short(part.column("same"))
                owner, word, position, sizes = rule.prefixes(part.column("words"))
                low, high = _parities(part.column("words"))
                paired = rule.crowd[_place(word)] > 1
                owner, word, position = owner[paired], word[paired], position[paired]
                row, block, a, b = _pairs_of_blocks(rule.blocks(word), short[owner])
                own = owner[row]
                cell = np.where(b > 0, mix(word[row] ^ mix((a << 32 | b).view(np.uint64))), word[row]) << np.uint64(16)
                key = cell | np.minimum(sizes[own], 65535).astype(np.uint64)
                side = np.where(a == b, 0, np.where(block == a, _LOW, _UP))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (key.view(np.int64), sizes[own] << 32 | side | position[row], short[own].view(np.int64), low[own].view(np.int64), high[own].view(np.int64))],
                    names=["key", "shape", "short", "low", "high"],
                )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append([batch.column(c).to_numpy() for c in ("key", "shape", "short", "low", "high")])
            n += batch.num_rows
            if n < _MEETING:
                continue
            now = [np.concatenate(x) for x in zip(*waiting)]
            cut = int(np.argmax(now[0] >> 16 == now[0][-1] >> 16))  # the last cell may go on in the next batch
            waiting, n = [[x[cut:] for x in now]], len(now[0]) - cut
            if cut:
                yield found(*(x[:cut] for x in now))
        if waiting:
            yield found(*(np.concatenate(x) for x in zip(*waiting)))

    def found(key, shape, short, low, high) -> pa.RecordBatch:
        once = np.r_[True, (short[1:] != short[:-1]) | (key[1:] != key[:-1])]
        key, shape, short, low, high = (x[once] for x in (key, shape, short, low, high))
        cell, size, position, side = key >> 16, shape >> 32, shape & (_LOW - 1), shape & (_LOW | _UP)
        at, step, root = np.arange(len(cell)), 1, np.arange(len(cell))
        pairs, waiting = [], 0
        while True:
            at = at[at + step < len(cell)]
            at = at[cell[at] == cell[at + step]]
            if not len(at):
                break
            need = rule.least(size[at] + size[at + step])
            able = need <= size[at] - position[at]  # the shared word and what follows it
            at, need = at[able], need[able]  # the lines further on are longer still
            to = at + step
            ok = need <= size[to] - position[to]
            ok &= (side[at] == 0) | (side[at] != side[to])  # lines of one block meet in a cell of their own
            one, two, need = at[ok], to[ok], need[ok]
            apart = sum(np.bitwise_count((x[one] ^ x[two]).view(np.uint64)).astype(np.int64) for x in (low, high))
            ok = apart <= size[one] + size[two] - 2 * need
            pairs.append((one[ok], two[ok]))
            waiting += len(pairs[-1][0])
            if waiting > 1 << 19:
                _join(root, *map(np.concatenate, zip(*pairs)))
                pairs, waiting = [], 0
            step += 1
        if waiting:
            _join(root, *map(np.concatenate, zip(*pairs)))
        root = _roots(root)
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(short[linked]), pa.array(short[root[linked]])], names=["a", "b"])

    rows = sets.select("same", "words").mapInArrow(emit, "key bigint, shape bigint, short bigint, low bigint, high bigint")
    cells = rows.repartition(F.shiftrightunsigned("key", 16)).sortWithinPartitions("key", "shape", "short")  # by cell and size
    return cells.mapInArrow(meet, "a bigint, b bigint").distinct()


def _roots(root: np.ndarray) -> np.ndarray:
    while True:
        up = root[root]
        if (up == root).all():
            return root
        root = up


def _join(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of all pairs (a, b) in place: the smaller root leads."""
    while len(a):
        top = _roots(root)
        root[:] = top
        x, y = top[a], top[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))


def _linked(met: DataFrame, rule: Rule) -> DataFrame:
    """Per class: number of lines similar to it (its own class apart) and the earliest of them.

    Rows of one component meet: in one cell, or in cells of pairs of blocks if
    they are many.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                blocks = -(-part.column("members").to_numpy() // BLOCK)
                row, own, a, b = _pairs_of_blocks(blocks, _short(part.column("same")))
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column("root").take(taken), pa.array(a << 32 | b), pa.array(own), *(part.column(c).take(taken) for c in ("same", "words", "n", "id", "line", "tag"))],
                    names=["root", "pair", "block", "same", "words", "n", "id", "line", "tag"],
                )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows, out = None, [], []
        for batch in batches:
            keys = zip(batch.column("root").to_pylist(), batch.column("pair").to_pylist())
            sizes, flat = _flat(batch.column("words"))
            ends = np.cumsum(sizes).tolist()
            rest = list(zip(*(batch.column(c).to_pylist() for c in ("same", "n", "id", "line", "tag", "block"))))
            for k, key in enumerate(keys):
                if key != cell:
                    out += compare(rows, cell)
                    cell, rows = key, []
                    if len(out) > 20_000:
                        yield told(out)
                        out = []
                if not rows or rows[-1][1][0] != rest[k][0]:
                    rows.append((flat[ends[k] - sizes[k] : ends[k]], rest[k]))
        out += compare(rows, cell)
        yield told(out)

    def told(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["same", "links", "id", "line", "tag"])

    def compare(rows: list, cell: tuple | None) -> list[tuple]:
        """Links of a cell's lines, from their whole word sets; lines of one block meet in that block's own cell only."""
        if len(rows) < 2:
            return []
        across = cell[1] >> 32 != cell[1] & 0xFFFFFFFF
        if len(rows) == 2:
            (one, a), (two, b) = rows
            if across and a[5] == b[5]:
                return []
            overlap = len(set(one.tolist()) & set(two.tolist()))
            similar = overlap >= rule.least(len(one) + len(two))
            return [(a[0], *b[1:5]), (b[0], *a[1:5])] if similar else []
        sizes = np.array([len(w) for w, _ in rows])
        words, column = np.unique(np.concatenate([w for w, _ in rows]), return_inverse=True)
        owner = np.repeat(np.arange(len(rows)), sizes)
        overlap = np.zeros((len(rows), len(rows)), np.float32)
        for at in range(0, len(words), _COLUMNS):
            here = (column >= at) & (column < at + _COLUMNS)
            table = np.zeros((len(rows), min(_COLUMNS, len(words) - at)), np.float32)
            table[owner[here], column[here] - at] = 1
            overlap += table @ table.T
        similar = overlap >= rule.least(sizes[:, None] + sizes[None, :])
        np.fill_diagonal(similar, False)
        if across:
            block = np.array([r[1][5] for r in rows])
            similar &= block[:, None] != block[None, :]
        counts = np.array([r[1][1] for r in rows])
        order = sorted(range(len(rows)), key=lambda k: rows[k][1][2:5])
        out = []
        for k in np.flatnonzero(similar.any(1)).tolist():
            first = order[int(np.argmax(similar[k][order]))]
            out.append((rows[k][1][0], int(counts[similar[k]].sum()), *rows[first][1][2:5]))
        return out

    rows = met.mapInArrow(emit, "root bigint, pair bigint, block bigint, same binary, words binary, n bigint, id bigint, line int, tag bigint")
    cells = rows.repartition("root", "pair").sortWithinPartitions("root", "pair", "same")
    return cells.mapInArrow(verify, "same binary, links bigint, id bigint, line int, tag bigint").groupBy("same").agg(F.sum("links").alias("links"), F.min(F.struct("id", "line", "tag")).alias("partner"))


def links(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row per line that has words: its class, its links, and whether an earlier line is similar.

    Returns ``key``, line_no (from 0), class_doc and class_line (the first line of
    the same word set), n_links (other lines of similarity ``threshold`` or more,
    equal sets included) and removed.  Earlier means a smaller (``key``, line_no);
    a null key counts as the smallest.  Ids are integers.  Null and empty texts and
    lines without words have no row; rows that repeat an id share places, so
    neither is later.
    """
    found = _links(as_bytes(docs, key, text).select(_place_id(key).alias("id"), F.lit(0).cast("long").alias("tag"), "text"), threshold)
    own = docs.schema[key].dataType
    return found.select(
        _given_id("id").cast(own).alias(key), F.col("line").cast("long").alias("line_no"), _given_id("first.id").cast(own).alias("class_doc"),
        F.col("first.line").cast("long").alias("class_line"), "n_links", F.col("later").alias("removed"),
    )


def _place_id(key: str) -> F.Column:
    return F.coalesce(F.col(key).cast("long"), F.lit(_LOWEST))


def _given_id(id_: str) -> F.Column:
    return F.when(F.col(id_) != _LOWEST, F.col(id_))


def _links(source: DataFrame, threshold: float) -> DataFrame:
    """Per line of the rows (id, tag, text): id, tag, line, first (id, line, tag), n_links and later.

    Later means that a similar line has a smaller place (id, line, tag).
    """
    lines = stored(_lines(source), "lines")
    sets = lines.where(F.col("words").isNotNull())
    rule = Rule(threshold, _count(sets.select("words"), lambda batch: _place(_flat(batch.column("words"))[1])))
    rule.gather(_count(sets.select("words"), lambda batch: _place(rule.prefixes(batch.column("words"))[1])))
    grouped = stored(lines.groupBy("same").agg(F.min(F.struct("id", "line", "tag")).alias("first"), F.count("*").alias("n")), "line_classes")

    roots = components(stored(_candidates(sets, rule), "line_candidates")).withColumnRenamed("node", "short")
    members = roots.groupBy("root").agg(F.count("*").alias("members"))
    told = grouped.select("same", _short_column("same").alias("short"), "n", F.col("first.id").alias("id"), F.col("first.line").alias("line"), F.col("first.tag").alias("tag"))
    told = told.join(roots.join(members, "root"), "short").drop("short")
    near = sieved(sets.select("same", "words"), "same", told.select("same")).join(told, "same")
    similar = stored(_linked(near, rule), "line_links")

    place = F.struct("id", "line", "tag")
    classes = grouped.join(similar.hint("shuffle_hash"), "same", "left")  # each class once: no key is hot on this side
    joined = lines.select("id", "line", "tag", "same").join(classes.hint("shuffle_hash"), "same")
    return joined.select(
        "id", "tag", "line", "first", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        ((F.col("first") < place) | F.coalesce(F.col("partner") < place, F.lit(False))).alias("later"),
    )


def _short_column(same: str) -> F.Column:
    """The first eight bytes of a digest as a bigint, as :func:`_short` reads them."""
    return F.conv(F.hex(F.substring(F.col(same), 1, 8)), 16, -10).cast("long")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars", threshold: float = SIMILARITY) -> DataFrame:
    """The documents less every line that has a similar earlier line.

    Every row is a document of its own: rows of a null id, and rows that repeat an
    id with another text, are told apart by a tag from their text, which also
    orders lines of equal id and number.  Only rows equal in id and text share
    their places, so neither is later.  A document all of whose lines with words
    go, goes too; documents without words stay as they are.  ``length`` becomes
    the new length of a changed text.
    """
    bucket = hashed_bucket(F.col(key).cast("long"))
    repeated = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("id")).agg(F.count("*").alias("n")).where("n > 1")
    repeated = stored(repeated.select(hashed_bucket("id").alias("_id_bucket")).distinct(), "repeated_ids").withColumn("_repeated", F.lit(True))
    # Ids that share a bucket with a repeated one are tagged too, which changes nothing.
    tagged = docs.withColumn("_id_bucket", bucket).join(F.broadcast(repeated), "_id_bucket", "left")
    alone = F.col(key).cast("long").isNotNull() & F.col("_repeated").isNull()
    tagged = tagged.withColumn("_tag", F.when(alone, F.lit(0).cast("long")).otherwise(F.xxhash64(F.col(text).cast("string").cast("binary"))))
    found = _links(tagged.select(_place_id(key).alias("id"), F.col("_tag").alias("tag"), F.col(text).cast("string").cast("binary").alias("text")), threshold)
    gone = found.groupBy(F.col("id").alias("_key"), F.col("tag").alias("_key_tag")).agg(F.collect_set(F.when(F.col("later"), F.col("line"))).alias("_gone"), F.bool_and("later").alias("_all")).where(F.size("_gone") > 0)
    matched = tagged.join(gone, (_place_id(key) == F.col("_key")) & (F.col("_tag") == F.col("_key_tag")), "left").where(~F.coalesce("_all", F.lit(False)))
    changed = F.col("_gone").isNotNull()
    left = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda _, k: ~F.array_contains("_gone", k)), "\n")
    out = matched.withColumn("_text", F.when(changed, left).otherwise(F.col(text)))
    new = {text: F.col("_text"), length: F.when(changed, F.length("_text").cast(docs.schema[length].dataType)).otherwise(F.col(length)) if length in docs.columns else None}
    return out.select(*((new[c] if new.get(c) is not None else F.col(c)).alias(c) for c in docs.columns))
