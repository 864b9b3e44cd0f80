"""SentencePiece encoding and decoding with the source bytes of every piece.

The normaliser of a model is a compiled character map (a double array of
prefixes and their replacements).  :class:`Normalizer` applies it by the longest
prefix and records for every normalised byte the source byte it came from, so
that each piece is projected to a span of the original text.

Byte-pair merges never cross the start of a word mark that no piece contains
after another character, nor a character that no piece contains at all.  Texts
are therefore encoded in such units, and units met before are looked up; the ids
are those of one call over the whole text.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as spec

from gradeflow.llm.common import SMALL_STEP_BYTES, steps

MARK = "▁"
MARK_BYTES = MARK.encode()
#: Units remembered by a task; the memory is emptied when full.
REMEMBERED = 200_000


class Normalizer:
    """Longest-prefix normalisation with an alignment to source bytes."""

    def __init__(self, rules: spec.NormalizerSpec, suffix: bool = False):
        self.prefix, self.squeeze, self.escape, self.suffix = rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces, suffix
        chars = rules.precompiled_charsmap
        self.units, self.replacements = None, b""
        if chars:
            size = int.from_bytes(chars[:4], "little")
            self.units = np.frombuffer(chars[4 : 4 + size], "<u4").tolist()
            self.replacements = chars[4 + size :]

    def longest(self, source: bytes, at: int) -> tuple[int, int]:
        """Length of the longest mapped prefix at ``at`` and the place of its replacement, or (0, -1)."""
        units, found = self.units, (0, -1)
        node = 0
        unit = units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for k in range(at, len(source)):
            node ^= source[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != source[k]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found = (k + 1 - at, units[node] & 0x7FFFFFFF)
        return found

    def mapped(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """The text after the character map, and the source byte of each of its bytes (and of its end)."""
        if self.units is None:
            return source, np.arange(len(source) + 1)
        out, origin, at = bytearray(), [], 0
        while at < len(source):
            taken, place = self.longest(source, at)
            if taken:
                new = self.replacements[place : self.replacements.index(b"\0", place)]
            else:
                lead = source[at]
                taken = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = source[at : at + taken]
            out += new
            origin += [at] * len(new)
            at += taken
        return bytes(out), np.array([*origin, len(source)], np.int64)

    def __call__(self, source: bytes) -> tuple[int, np.ndarray]:
        """Length of the normalised text in bytes and, for each of them and the end, the source byte."""
        text, origin = self.mapped(source)
        codes = np.frombuffer(text, np.uint8)
        if self.squeeze:
            blank = codes == 0x20
            keep = ~(blank & np.r_[False, blank[:-1]])
            inner = np.flatnonzero(~blank)
            keep[: inner[0] if len(inner) else len(keep)] = False
            keep[inner[-1] + 1 if len(inner) else 0 :] = False
            codes, origin = codes[keep], np.r_[origin[:-1][keep], origin[-1]]
        wide = np.where(codes == 0x20, len(MARK_BYTES) if self.escape else 1, 1)
        starts = np.repeat(origin[:-1], wide)
        if len(codes) and self.prefix:
            extra = np.full(len(MARK_BYTES) if self.escape else 1, origin[-1] if self.suffix else origin[0])
            starts = np.r_[starts, extra] if self.suffix else np.r_[extra, starts]
        return len(starts), np.r_[starts, origin[-1]]


class Codec:
    """One model in one Python worker."""

    def __init__(self, model: bytes):
        proto = spec.ModelProto()
        proto.ParseFromString(model)
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalize = Normalizer(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix)
        normal = [p.piece for p in proto.pieces if p.type in (1, 4)]
        byte = [p.type == 6 for p in proto.pieces]
        self.width = np.array([1 if b else len(p.piece.encode()) for b, p in zip(byte, proto.pieces)], np.int64)
        # Units hold only where the model makes them safe; else the whole text is one unit.
        plain = proto.normalizer_spec
        self.by_unit = (
            proto.trainer_spec.model_type == spec.TrainerSpec.BPE and proto.trainer_spec.byte_fallback
            and not plain.precompiled_charsmap and plain.add_dummy_prefix and plain.escape_whitespaces
            and not plain.remove_extra_whitespaces and not self.normalize.suffix
            and not any(p.type == 4 for p in proto.pieces) and not any(re.search(f"[^{MARK}]{MARK}", p) for p in normal)
        )
        lone = self.by_unit and not any("\n" in p for p in normal)
        self.by_line = lone
        self.split = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.known: dict[str, bytes] = {}
        self.after_break = self.lib.encode("\n") if lone else []
        self.unknown = self.lib.unk_id()
        self.decimals = [str(i) for i in range(len(proto.pieces))]
        # Without a character map a piece takes its own bytes of the source, a word mark one.
        self.source_width = np.array([1 if b else len(p.piece.encode()) - 2 * p.piece.count(MARK) for b, p in zip(byte, proto.pieces)], np.int64)

    def units(self, text: str) -> list[str]:
        """Units of a text: a word after its blank; a line break and the word after it; or, with a mark first, a blank before a line break."""
        if not text:
            return []
        if self.by_line and "  " not in text and MARK not in text and text[0] != " ":
            return text.replace("\n", " \n").split(" ")
        return [u if u[1:2] == "\n" else u[1:].replace(MARK, " ") for u in self.split(MARK + text.replace(" ", MARK))]

    def _learn(self, new: set[str]) -> None:
        """Encode units not met before, in one call of the library."""
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
        new = list(new)
        blank = np.array([self.lib.piece_to_id(MARK)], np.int32).tobytes()
        for unit, ids in zip(new, self.lib.encode([u[1:] if u[:1] == MARK else u for u in new], num_threads=1)):
            if unit[:1] == "\n" and self.by_line:  # no blank before it
                ids = ids[len(self.after_break) - 1 :]
            self.known[unit] = array("i", ids).tobytes() if unit else blank

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Per text the ids of one call of the library over the whole text."""
        if not self.by_unit:
            yield from (np.array(self.lib.encode(t), np.int32) for t in texts)
            return
        known = self.known
        units = [self.units(t) for t in texts]
        found = [list(map(known.get, own)) for own in units]
        new = {u for own, ids in zip(units, found) for u, x in zip(own, ids) if x is None} if any(None in ids for ids in found) else ()
        if new:
            self._learn(new)
        for own, ids in zip(units, found):
            if None in ids:  # what was found before the memory was emptied stays valid
                ids = [known[u] if x is None else x for u, x in zip(own, ids)]
            yield np.frombuffer(b"".join(ids), np.int32)

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """Source bytes [start, end) of each piece, and whether the pieces cover the normalised text.

        Pieces that split one source character all carry that character's span,
        as do the pieces of an unknown run.
        """
        if not text:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), not len(ids)
        if self.by_unit and MARK not in text:
            ends = np.cumsum(self.source_width[ids]) - 1
            starts = np.r_[0, ends[:-1]]
            return starts, ends, bool(ends[-1] == len(text.encode()))
        normal, origin = self.normalize(text.encode())
        width = self.width[ids]
        if (ids == self.unknown).any():
            width = np.array([len(piece.encode()) for piece in self.lib.encode(text, out_type=str)], np.int64)
        ends = np.cumsum(width)
        if (ends[-1] if len(ends) else 0) != normal:
            return np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64), False
        return origin[ends - width], origin[ends], True


@lru_cache(2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", pieces: bool = True) -> DataFrame:
    """Ids, piece spans and the decoded text of every document: one pass, no shuffle.

    Returns ``key``, ids array<int>, starts / ends array<int> (bytes of the
    source per piece), aligned (the pieces cover the whole normalised text) and
    decoded.  A null text counts as empty: no ids, decoded ''.  Repeated rows
    and null keys give a row each; ``pieces=False`` replaces the arrays by their
    digest (n_tokens, ids_sha256, decoded_sha256, aligned), which a table of
    corpus size can carry.  The model file (bounded: a vocabulary) travels with the task.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    id_type = docs.schema[key].dataType.simpleString()
    digest = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, aligned boolean"
    arrays = "ids array<int>, starts array<int>, ends array<int>, aligned boolean, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in steps(batches, most=SMALL_STEP_BYTES):
            rows = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for t, ids in zip(texts, own.encode(texts)):
                starts, ends, whole = own.spans(t, ids)
                ids = ids.tolist()
                decoded = own.lib.decode(ids) if ids else ""
                if pieces:
                    rows.append((ids, starts, ends, whole, decoded))
                else:
                    rows.append((len(ids), hashlib.sha256(",".join(map(own.decimals.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), whole))
            names = ["ids", "starts", "ends", "aligned", "decoded"] if pieces else ["n_tokens", "ids_sha256", "decoded_sha256", "aligned"]
            kinds = [pa.list_(pa.int32())] * 3 + [pa.bool_(), pa.string()] if pieces else [pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(zip(*rows), kinds))], names=[key, *names])

    source = docs.select(F.col(key), F.col(text).cast("string").alias("text"))
    return source.mapInArrow(run, f"`{key}` {id_type}, {arrays if pieces else digest}")
