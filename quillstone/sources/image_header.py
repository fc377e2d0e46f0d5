"""Sides and orientation of PNG and JPEG files from their headers, without decoding them.

A JPEG is a chain of segments of declared lengths; the walk ends at the frame header (sides), the first orientation tag,
or the first thing that makes no sense. What can't be read is null.
"""

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the two formats.
PNG = b"\x89PNG\r\n\x1a\n"
EXIF = b"Exif\0\0"
ORIENTATION, SHORT = 0x0112, 3
APP1, SCAN, END = 0xE1, 0xDA, 0xD9
FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
BARE = {0x01, *range(0xD0, 0xD9)}
#: Beyond these a file counts as broken.
MOST_SEGMENTS, MOST_TAGS = 4096, 1024


def segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(marker, body) of the segments before a JPEG's scan; the body lacks its length field."""
    at = 2
    for _ in range(MOST_SEGMENTS):
        if at + 1 >= len(data) or data[at] != 0xFF or data[at + 1] in (SCAN, END):
            return
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker in BARE:
            at += 2
        else:
            size = int.from_bytes(data[at + 2 : at + 4], "big")
            if size < 2 or at + 2 + size > len(data):
                return
            yield marker, data[at + 4 : at + 2 + size]
            at += 2 + size


def orientation_tag(body: bytes) -> int | None:
    """The orientation (1 to 8) in an APP1 segment's first directory."""
    tiff = body[len(EXIF) :]
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not body.startswith(EXIF) or order is None or len(tiff) < 8:
        return None
    magic, start = struct.unpack_from(f"{order}HI", tiff, 2)
    if magic != 42 or start + 2 > len(tiff):
        return None
    (tags,) = struct.unpack_from(f"{order}H", tiff, start)
    if not 0 < tags <= MOST_TAGS or start + 2 + 12 * tags > len(tiff):
        return None
    for k in range(tags):
        tag, kind, count, value = struct.unpack_from(f"{order}HHIH", tiff, start + 2 + 12 * k)
        if (tag, kind) == (ORIENTATION, SHORT) and count:
            return value if 1 <= value <= 8 else None
    return None


def header(data: bytes | None) -> tuple[int | None, int | None, int | None]:
    """(width, height, orientation) of a file's bytes."""
    sides, turned = (None, None), None
    if data and data.startswith(PNG) and len(data) >= 24:
        sides = struct.unpack_from(">II", data, 16)
    elif data and data.startswith(b"\xff\xd8\xff"):
        for marker, body in segments(data):
            if marker in FRAMES:
                sides = struct.unpack_from(">HH", body, 1)[::-1] if len(body) >= 5 else sides
                break
            if marker == APP1 and turned is None:
                turned = orientation_tag(body)
    return (*(sides if all(sides) else (None, None)), turned)


def with_header(files: DataFrame) -> DataFrame:
    """``files`` (with content) with width, height, orientation as stored; columns of these names are replaced."""
    @F.pandas_udf("width int, height int, orientation int")
    def read(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([header(c) for c in content], columns=["width", "height", "orientation"]).astype("Int32")

    return files.withColumn("_header", read("content")).withColumns({c: F.col("_header")[c] for c in ("width", "height", "orientation")}).drop("_header")
