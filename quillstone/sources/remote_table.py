"""A remote table of records behind a paged JSON service, as a Spark data source and a batch sink.

The service is anything that answers GET base/records?page=N&perPage=100 with a JSON array of {id, fields} and takes
POST and PUT of {fields}; base may be an http(s) address, or a folder with files page-N.json for tests.
"""

from __future__ import annotations

import itertools
import json
import urllib.request
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PER_PAGE = 100
SCHEMA = "id string, fields map<string,string>, createdAt string, createdBy string, modifiedAt string, sequence bigint"


class Pages(InputPartition):
    def __init__(self, first: int, step: int):
        self.first, self.step = first, step


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.base = options["path"]
        self.token = options.get("token", "")
        self.readers = int(options.get("readers", "4"))
        self.most = int(options["mostPages"]) if "mostPages" in options else None

    def partitions(self) -> list[InputPartition]:
        return [Pages(k, self.readers) for k in range(self.readers)]

    def page(self, n: int) -> list[dict]:
        if self.base.startswith(("http://", "https://")):
            ask = urllib.request.Request(f"{self.base}/records?page={n}&perPage={PER_PAGE}", headers={"Authorization": f"Bearer {self.token}"})
            with urllib.request.urlopen(ask, timeout=30) as got:
                return json.load(got)
        file = Path(self.base, f"page-{n}.json")
        return json.loads(file.read_text(encoding="utf-8")) if file.exists() else []

    def read(self, part: Pages) -> Iterator[tuple]:
        """Every step-th page from its first on, up to a short one; a table of more than mostPages, if set, is an error."""
        for n in itertools.count(part.first, part.step):
            rows = self.page(n)
            if rows and self.most is not None and n >= self.most:
                raise ValueError(f"the table has more than {self.most} pages")
            for r in rows:
                fields = {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in (r.get("fields") or {}).items()}
                yield str(r["id"]), fields, r.get("createdAt"), r.get("createdBy"), r.get("modifiedAt"), r.get("sequence")
            if len(rows) < PER_PAGE:
                return


class RemoteRecords(DataSource):
    """spark.dataSource.register(RemoteRecords); spark.read.format("remote_records").load(base)."""

    @classmethod
    def name(cls) -> str:
        return "remote_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(self.options)


def payloads(rows: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Adds ``payload``: {"fields": {remote name: value}} of the mapped columns that are not null; others are never written."""
    pairs = [F.when(F.col(c).isNotNull(), F.struct(F.lit(name), F.col(c).cast("string"))) for c, name in mapping.items()]
    return rows.withColumn("payload", F.to_json(F.struct(F.map_from_entries(F.array_compact(F.array(*pairs))).alias("fields"))))


def merged(stored: DataFrame, sent: DataFrame) -> DataFrame:
    """id, fields after an update: the sent fields over the stored ones, all others kept."""
    both = stored.select("id", "fields").join(sent.select("id", F.col("fields").alias("sent")), "id", "left")
    kept = F.map_filter("fields", lambda k, _: ~F.map_contains_key(F.coalesce("sent", F.create_map().cast("map<string,string>")), k))
    return both.select("id", F.when(F.col("sent").isNull(), F.col("fields")).otherwise(F.map_concat(kept, "sent")).alias("fields"))


def database_link(base, team, database):
    """Address of a database, with every part encoded."""
    return F.concat_ws("/", base, *[F.url_encode(p) for p in (team, database)])


def record_link(base, team, database, table, record):
    """Address of a record, with every part encoded."""
    return F.concat_ws("/", base, *[F.url_encode(p) for p in (team, database, table, record)])
