"""Image files: sizes from their headers, and processing passes."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T


def image_size(data: bytes) -> tuple[int, int]:
    """(width, height) from the header of a PNG, GIF, BMP, WebP or JPEG file."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26])
        return width, abs(height)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        if data[12:16] == b"VP8X":
            return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        width, height = struct.unpack("<HH", data[26:30])
        return width & 0x3FFF, height & 0x3FFF
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            marker = data[at + 1]
            if marker == 0xFF:  # fill byte
                at += 1
            elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):  # frame header
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            elif marker == 0x01 or 0xD0 <= marker <= 0xD8:  # no length follows
                at += 2
            else:
                at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    raise ValueError("Unable to read image: no size in its header")


def read_dimensions(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, width, height, error) for stored images; bytes stay in their Arrow batch."""
    path_type = files.schema[path].dataType

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = []
            for data in batch[content]:
                try:
                    sizes.append((*image_size(bytes(data or b"")), None))
                except ValueError as error:
                    sizes.append((None, None, str(error)))
            width, height, error = zip(*sizes) if sizes else ((), (), ())
            yield pd.DataFrame(
                {
                    path: batch[path].to_numpy(),
                    "width": pd.array(width, dtype="Int64"),
                    "height": pd.array(height, dtype="Int64"),
                    "error": pd.array(error, dtype=object),
                }
            )

    schema = T.StructType(
        [
            T.StructField(path, path_type),
            T.StructField("width", T.LongType()),
            T.StructField("height", T.LongType()),
            T.StructField("error", T.StringType()),
        ]
    )
    return files.select(path, content).mapInPandas(scan, schema)


def process_images(
    images: DataFrame, transform: Callable[[bytes], bytes], content: str = "content"
) -> DataFrame:
    """Run ``transform`` on every pending image: status, error and payload per image.

    The payload goes to its own column, so that listings do not read it.
    """
    columns = [c for c in images.columns if c not in (content, "processing_status")]
    kept = [f for f in images.schema.fields if f.name in columns]
    added = T.StructType.fromDDL("processing_status string, processing_error string, payload binary")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            status, errors, payloads = [], [], []
            for data in batch[content]:
                try:
                    payloads.append(transform(None if data is None else bytes(data)))
                    status.append("completed")
                    errors.append(None)
                except Exception as error:  # one bad image must not fail the pass
                    payloads.append(None)
                    status.append("failed")
                    errors.append(str(error))
            out = batch[columns].copy()
            out["processing_status"], out["processing_error"], out["payload"] = status, errors, payloads
            yield out

    pending = images.filter(F.col("processing_status") == "pending").select(*columns, content)
    return pending.mapInPandas(run, T.StructType(kept + added.fields))
