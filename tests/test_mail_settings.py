"""Mail containers built here and damaged, settings files, typed JSON, loading, and updates of a remote table."""

import json
import random
import struct

from pyspark.sql import functions as F

from quillstone.operators import entries, evaluation, evidence, loading
from quillstone.sources import files, mail_container, remote_service, settings

SECTOR, MINI, END, FREE, FAT = 512, 64, 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD


def container(tree):
    """A compound file of {name: bytes or dict}; short streams lie in the mini stream."""
    sectors, fat, mini, mini_fat, entries = [], [], b"", [], []

    def put(data):
        first = len(sectors) if data else END
        n = -(-len(data) // SECTOR)
        for k in range(n):
            sectors.append(data[k * SECTOR : (k + 1) * SECTOR].ljust(SECTOR, b"\0"))
            fat.append(len(sectors) if k < n - 1 else END)
        return first

    def put_mini(data):
        nonlocal mini
        first = len(mini_fat)
        n = -(-len(data) // MINI)
        for k in range(n):
            mini += data[k * MINI : (k + 1) * MINI].ljust(MINI, b"\0")
            mini_fat.append(len(mini_fat) + 1 if k < n - 1 else END)
        return first if data else END

    def add(name, node):
        at = len(entries)
        entries.append(None)
        if isinstance(node, dict):
            children = [add(k, v) for k, v in node.items()]
            for a, b in zip(children, children[1:], strict=False):
                entries[a][2] = b  # the next sibling hangs to the right
            entries[at] = [name, 5 if name == "Root Entry" else 1, FREE, children[0] if children else FREE, END, 0]
        else:
            entries[at] = [name, 2, FREE, FREE, put(node) if len(node) >= 4096 else put_mini(node), len(node)]
        return at

    add("Root Entry", tree)
    entries[0][4], entries[0][5] = put(mini), len(mini)
    first_mini = put(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(-(-len(mini_fat) * 4 // SECTOR) * SECTOR, b"\xff"))
    listing = b""
    for name, kind, right, child, start, size in entries:
        raw = name.encode("utf-16-le")
        listing += raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw) + 2, kind, 1, FREE, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)
    directory = put(listing)
    n = 1
    while (len(fat) + n) * 4 > n * SECTOR:
        n += 1
    places = [len(sectors) + k for k in range(n)]
    table = struct.pack(f"<{len(fat) + n}I", *fat, *[FAT] * n).ljust(n * SECTOR, b"\xff")
    head = mail_container.SIGNATURE + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 6 + struct.pack("<III", 0, n, directory) + b"\0" * 4 + struct.pack("<IIIII", 4096, first_mini, 1, END, 0) + struct.pack("<109I", *places, *[FREE] * (109 - n))
    return head + b"".join(sectors) + table


def text(x):
    return x.encode("utf-16-le")


PDF = b"%PDF-1.7 " + bytes(range(256)) * 40
TREE = {
    "__substg1.0_0037001F": text("An invoice"), "__substg1.0_0C1F001E": b"casa@example.com", "__substg1.0_1000001F": text("Dear all,\n\n\n\n\nsee below."),
    "__attach_version1.0_#00000000": {"__substg1.0_3707001F": text('bill "7".pdf'), "__substg1.0_37010102": PDF},
    "__attach_version1.0_#00000001": {"__substg1.0_3704001F": text("logo.gif"), "__substg1.0_37010102": b"GIF89a"}, "__attach_version1.0_#00000002": {"__substg1.0_37010102": b"\x89PNG small"},
}


def test_streams_come_back():
    found = dict(mail_container.streams(container(TREE)))
    flat = {(k,): v for k, v in TREE.items() if isinstance(v, bytes)} | {(k, n): v for k, d in TREE.items() if isinstance(d, dict) for n, v in d.items()}
    assert found == flat


def test_messages(spark):
    plain = container({"__substg1.0_0037001E": b"Only words"})
    rows = [(1, container(TREE)), (2, plain), (3, b"no container"), (4, None), (5, b""), (1, container(TREE))]
    got = mail_container.attachments(spark.createDataFrame([(k, None if c is None else bytearray(c)) for k, c in rows], "k int, content binary"), "k").collect()
    first = sorted((r for r in got if r["k"] == 1), key=lambda r: r["nth"])
    assert len(first) == 4 and [(r["name"], r["kind"], bytes(r["data"])) for r in first[::2]] == [("bill _7_.pdf", "pdf", PDF), ("attachment2.png", "png", b"\x89PNG small")]
    assert first[0]["subject"] == "An invoice" and first[0]["sender"] == "casa@example.com" and first[0]["body"] == "Dear all,\n\nsee below."
    assert [(r["k"], r["subject"], r["nth"]) for r in got if r["k"] != 1] == [(2, "Only words", None)]


def test_damaged_containers_end():
    whole, rng = container(TREE), random.Random(1)
    for _ in range(300):
        broken = bytearray(whole[: rng.randrange(len(whole))] if rng.random() < 0.3 else whole)
        for _ in range(rng.randrange(1, 40)):
            if broken:
                broken[rng.randrange(len(broken))] = rng.choice([0, 1, 254, 255, rng.randrange(256)])
        list(mail_container.message(bytes(broken)))


def test_settings(spark, tmp_path):
    def put(content):
        (tmp_path / "s.json").write_text(content)
        return str(tmp_path / "s.json")

    none = str(tmp_path / "none.json")
    assert tuple(settings.country(spark, put('{"countryCode": "ES"}')).first()) == ("ES", None) and tuple(settings.country(spark, none, F.lit("DE")).first()) == ("DE", None)
    for bad in ('{"countryCode": "Spain"}', "[1]", "{", '"ES"'):
        assert tuple(settings.country(spark, put(bad), F.lit("DE")).first()) == (None, "notASetting"), bad
    assert tuple(settings.country(spark, put("{}")).first()) == (None, None)
    assert [str(settings.acknowledged(spark, put(x)).first()["day"]) for x in ('{"date": "2024-02-29"}', '{"date": "2024-02-31"}', "nothing", "{}")] == ["2024-02-29", "None", "None", "None"]
    assert settings.acknowledged(spark, none).first()["day"] is None
    assert [tuple(r) for r in settings.destinations(spark, put('[{"team": "t", "x": 1}, {"team": "u"}]'), "team string").collect()] == [("t",), ("u",)] and settings.destinations(spark, none, "team string").collect() == []


def test_typed_members(spark):
    cases = [('{"a": {"b": 1}}', "object", ('{"b":1}', None)), ('{"a": [1]}', "object", (None, "notAnObject")), ('{"a": [1, 2]}', "list", ("[1,2]", None)), ('{"a": 1.5}', "identifier", (None, "notAnIdentifier")), ('{"a": 7}', "identifier", ("7", None)), ("{", "list", (None, "notJson")), (None, "list", (None, "notJson")), ("{}", "list", (None, "missing"))]
    for t, kind, want in cases:
        assert tuple(spark.createDataFrame([(t,)], "t string").select(settings.typed(F.col("t"), "$.a", kind).alias("r")).first()["r"]) == want, (t, kind)
    assert tuple(spark.createDataFrame([("{}",)], "t string").select(settings.typed(F.col("t"), "$.a", "list", optional=True).alias("r")).first()["r"]) == (None, None)


def test_loading(spark):
    day = spark.createDataFrame([(None, "a 2024-02-03.pdf"), (None, "31.02.2024"), (None, "05-06-24"), ("1999-01-01", "x"), (None, None)], "d string, n string").select(F.col("d").cast("date").alias("d"), "n")
    assert [str(r[0]) for r in day.select(loading.decide_day(F.col("d"), F.col("n"), True)).collect()] == ["2024-02-03", "None", "2024-06-05", "None", "None"]
    assert {r[0] for r in day.select(loading.decide_day(F.col("d"), F.col("n"))).collect()} == {None}


def test_small_operators(spark):
    pages = spark.createDataFrame([("d", 2, 1, 1), ("d", 1, 1, 2), ("d", 3, 1, 1)], "doc string, i int, width int, height int")
    assert entries.ordered_pages(pages, ["doc"], "i", "height").first()["pages"] == [2, 1, 1] and evaluation.page_sizes(pages, ["doc"]).first()["sizes"] == 2
    assert evaluation.seconds_each(pages.select("doc", F.timestamp_seconds("i").alias("at")), "doc", "at").first()["seconds"] == 2.0
    routes = spark.createDataFrame([(1, True, False), (2, False, True), (3, True, False), (3, False, False), (4, False, False)], "d int, t boolean, image boolean")
    assert {tuple(r) for r in routes.groupBy("d").agg(evidence.route(F.col("t"), F.col("image"))).collect()} == {(1, "pdf-text"), (2, "photo-ocr"), (3, "pdf-mixed"), (4, "pdf-ocr")}
    old, new = (spark.createDataFrame(x, "p string, sha256 string") for x in ([("a", "1"), ("b", "1"), ("c", None), ("d", "1")], [("a", "1"), ("b", "2"), ("c", None), ("e", "1")]))
    assert {tuple(r) for r in files.unchanged(old, new, "p").collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "unchanged"), ("d", "gone"), ("e", "new")}


def test_updates_keep_other_fields(spark, tmp_path):
    remote = remote_service.Folder(str(tmp_path))
    record = remote.create("t", "k", {"A": "1", "B": "2"})
    writer = remote_service.TableWriter({"path": str(tmp_path), "table": "t", "key": "id", "fields": '{"a": "A"}', "report": str(tmp_path), "update": "true"}, remote_service.StructType.fromDDL("id string, a string"), False)
    assert writer._send(remote, record, {"A": "9"}, {}) == ("sent", record) and writer._send(remote, "0" * 64, {"A": "9"}, {}) == ("gone", None)
    assert remote.record("t", record)["fields"] == {"A": "9", "B": "2"} and json.loads(next((tmp_path / "t" / "records").glob("*.json")).read_text())["id"] == record
