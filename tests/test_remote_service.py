"""A remote table in a folder: discovery, lookup, pages, and writes that stay single."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillstone.sources import remote_service
from quillstone.sources.remote_service import RemoteTable

FIELDS = [{"name": "Name", "type": "string"}, {"name": "Total", "type": "number"}, {"name": "Day", "type": "date"}, {"name": "Tags", "type": "choice"}]


@pytest.fixture
def base(spark, tmp_path):
    (tmp_path / "tables.json").write_text(json.dumps([{"name": "bills", "fields": FIELDS}]))
    spark.dataSource.register(RemoteTable)
    return str(tmp_path)


def send(df, base, run, **more):
    df.write.format("remote_table").mode("append").options(table="bills", key="k", fields=json.dumps({"n": "Name", "t": "Total", "d": "Day"}), report=f"{base}/reports/{run}", **more).save(base)
    return json.loads(Path(base, "reports", run, "committed.json").read_text())


def bills(spark, n):
    return spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit("b"), F.col("id")).alias("n"), (F.col("id") / 4).cast("decimal(10,2)").alias("t"), F.when(F.col("id") % 2 == 0, F.lit("2024-02-29").cast("date")).alias("d"), F.lit("secret").alias("unmapped"))


def test_write_twice_read_once(spark, base):
    assert send(bills(spark, 250).repartition(3), base, "a")["counts"] == {"sent": 250}
    assert send(bills(spark, 260).repartition(5), base, "b")["counts"] == {"sent": 260}
    back = spark.read.format("remote_table").option("table", "bills").load(base)
    assert [(f.name, f.dataType.simpleString()) for f in back.schema] == [("_id", "string"), ("Name", "string"), ("Total", "decimal(38,6)"), ("Day", "date"), ("Tags", "string")]
    got = back.collect()
    assert len(got) == 260 and {r["Name"] for r in got} == {f"b{k}" for k in range(260)} and {str(r["Day"]) for r in got} == {"None", "2024-02-29"}
    assert "secret" not in "".join(p.read_text() for p in Path(base, "bills", "records").glob("*.json"))


def test_an_id_is_looked_up(spark, base):
    send(bills(spark, 120), base, "a")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        back = spark.read.format("remote_table").options(table="bills", lookup="true").load(base)
        one = next(r["_id"] for r in back.collect() if r["Name"] == "b7")
        asked = spark.read.format("remote_table").options(table="bills", lookup="true").load(base).filter((F.col("_id") == one) & (F.col("Total") > 1))
        assert [r["Name"] for r in asked.collect()] == ["b7"] and asked.rdd.getNumPartitions() == 1
        assert spark.read.format("remote_table").options(table="bills", lookup="true").load(base).filter("_id = 'none'").collect() == []
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_failed_task_is_tried_again_without_a_second_record(spark, base):
    broken = bills(spark, 40).coalesce(1).withColumn("n", F.when(F.col("k") == 35, F.raise_error(F.lit("lost"))).otherwise(F.col("n")))
    with pytest.raises(Exception, match="lost"):
        send(broken, base, "a")
    assert not Path(base, "reports", "a", "committed.json").exists() and len(list(Path(base, "bills", "records").glob("*.json"))) <= 35
    assert send(bills(spark, 40), base, "b")["counts"] == {"sent": 40} and len(list(Path(base, "bills", "records").glob("*.json"))) == 40


def test_files_are_compared(spark, base):
    rows = bills(spark, 3).withColumns({"f": F.concat("n", F.lit(".pdf")), "m": F.lit("application/pdf"), "c": F.when(F.col("k") < 2, F.encode("n", "UTF-8"))})
    assert send(rows, base, "a", file="f,m,c")["counts"] == {"sent": 3}
    assert sorted(p.name for p in Path(base, "bills", "files").glob("*/*.pdf")) == ["b0.pdf", "b1.pdf"]


class Flaky(remote_service.Folder):
    """Answers are lost: of every second record before it is made, of every third after."""

    def create(self, table, key, fields):
        if int(key) % 2 == 1:
            raise remote_service.Lost("before")
        made = super().create(table, key, fields)
        if int(key) % 3 == 0:
            raise remote_service.Lost("after")
        return made


def test_lost_answers_are_a_third_outcome(base):
    writer = remote_service.TableWriter({"path": base, "table": "bills", "key": "k", "fields": '{"n": "Name"}', "report": base}, remote_service.StructType.fromDDL("k long, n string"), False)
    said = [writer._send(Flaky(base), str(k), {"Name": "x"}, {}) for k in range(6)]
    assert [s[0] for s in said] == ["sent", "uncertain", "sent", "uncertain", "sent", "uncertain"] and all((s[1] is None) == (s[0] == "uncertain") for s in said)


def test_refusals(spark, base):
    with pytest.raises(Exception, match="no table"):
        spark.read.format("remote_table").option("table", "nothing").load(base)
    with pytest.raises(Exception, match="no columns"):
        bills(spark, 1).drop("k").write.format("remote_table").mode("append").options(table="bills", key="k", fields="{}", report=base).save(base)


def test_values_that_are_none_of_their_type():
    assert remote_service._value("x", remote_service.TYPES["number"]) is None and remote_service._value("31.12.", remote_service.TYPES["date"]) is None
    assert remote_service._value({"a": 1}, remote_service.TYPES["string"]) == '{"a": 1}' and remote_service._value(None, remote_service.TYPES["date"]) is None
