"""Header tables, percent rows and image headers on nulls, empty, cut and odd inputs."""

import struct

import pytest
from pyspark.sql import functions as F

from quillstone.operators import photo
from quillstone.sources.image_header import header, with_header

RATES = [0, 400, 1000, 2100]


def receipts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").select("doc_id", photo.tokens(F.col("text")).alias("lines"))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, (None, None, None)), ("", (None, None, None)), ("BASE IVA", (None, None, None)),
        ("BASE CUOTA\n100,00 21,00", (100.0, 21.0, None)),
        ("IVA BASE IVA\n21,00 100,00 21,00", (100.0, 21.0, 21.0)),  # a tie goes to the first column
        ("IVA BASE IVA\n42,00 200,00 21,00", (200.0, 42.0, 21.0)),  # the second column is the rate
        ("BASE IVA\n100,00 17,00", (100.0, 17.0, None)),
        ("BASE IVA\n100,00 A B C 10,00", (100.0, None, 10.0)), ("BASE IVA\n100,00 A B C D 10,00", (None, None, None)),
        ("TIPO CUOTA BASE CUOTA\nX X X X 5,00", (None, None, None)),
        ("TIPO CUOTA\n21,00 5,00\nBASE CUOTA\n10,00 2,10", (10.0, 2.1, None)),  # a run without a base is passed over
    ],
)
def test_header_tables(spark, text, want):
    assert tuple(photo.header_tables(receipts(spark, [text]), RATES).select("t_net", "t_vat", "t_rate").first()) == want


def test_header_tables_keep_rows_and_columns(spark):
    rows = receipts(spark, ["BASE CUOTA\n1,00 2,00"] * 3 + [None]).withColumn("rest", F.lit(1))
    assert photo.header_tables(rows, RATES).columns == ["doc_id", "lines", "rest", "t_net", "t_vat", "t_rate"]
    assert photo.header_tables(rows, RATES).count() == 4
    assert photo.header_tables(rows.limit(0), RATES).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [(None, None), ("", None), ("21 %", None), ("21 % 100,00 21,00 121,00", (100.0, 21.0, 121.0, 21.0)), ("21 % 100,00 21,00 130,00", None), ("33 % 100,00 33,00", None), ("10 % 1,00 5,00\n21 % 100,00 21,00", (100.0, 21.0, None, 21.0))],
)
def test_percent_row(spark, text, want):
    got = receipts(spark, [text]).select(photo.percent_row(F.col("lines"), RATES)).first()[0]
    assert (got and tuple(got)) == want


def jpeg(*segments: tuple[int, bytes]) -> bytes:
    return b"\xff\xd8" + b"".join(struct.pack(">BBH", 0xFF, m, len(b) + 2) + b for m, b in segments)


def exif(value: int, order: str = ">", kind: int = 3) -> bytes:
    return b"Exif\0\0" + (b"MM" if order == ">" else b"II") + struct.pack(f"{order}HIHHHIHH", 42, 8, 1, 0x0112, kind, 1, value, 0)


FRAME = (0xC0, struct.pack(">BHH", 8, 480, 640) + b"\1\0\0")


@pytest.mark.parametrize(
    ("data", "want"),
    [
        (None, (None, None, None)), (b"", (None, None, None)), (b"GIF89a", (None, None, None)), (b"\xff\xd8\xff", (None, None, None)),
        (b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 3, 5), (3, 5, None)), (b"\x89PNG\r\n\x1a\n\0", (None, None, None)),
        (jpeg(FRAME), (640, 480, None)), (jpeg((0xE0, b"x" * 70_00), FRAME), (640, 480, None)), (jpeg((0xC4, b"12345678"), FRAME), (640, 480, None)),
        (jpeg((0xE1, exif(6)), FRAME), (640, 480, 6)), (jpeg((0xE1, exif(8, "<")), FRAME), (640, 480, 8)), (jpeg((0xE1, exif(9)), FRAME), (640, 480, None)),
        (jpeg((0xE1, exif(6, kind=4)), FRAME), (640, 480, None)), (jpeg((0xE1, b"Exif\0\0MM")), (None, None, None)), (jpeg((0xE1, b"http"), (0xE1, exif(3)), FRAME), (640, 480, 3)),
        (b"\xff\xd8\xff\xff" + jpeg(FRAME)[3:], (640, 480, None)), (jpeg(FRAME)[:8], (None, None, None)), (jpeg((0xDA, b"ab"), FRAME), (None, None, None)),
    ],
)
def test_image_header(data, want):
    assert header(data) == want


def test_image_headers_as_columns(spark):
    rows = spark.createDataFrame([(1, bytearray(jpeg((0xE1, exif(6)), FRAME)), "old"), (2, None, "old"), (2, None, "old")], "id int, content binary, width string")
    assert sorted(tuple(r) for r in with_header(rows).drop("content").fillna(-1).collect()) == [(1, 640, 480, 6), (2, -1, -1, -1), (2, -1, -1, -1)]
