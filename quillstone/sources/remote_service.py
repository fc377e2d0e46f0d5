"""Tables of a remote record service: discovered schemas, key lookup, and writes that are sent once and checked.

``spark.read.format("remote_table").option("table", name).load(base)`` and the same format for ``write``. A service answers at
an http(s) address (GET tables, GET table/records?page=, GET and POST table/records, table/records/id/files) or lies in a
folder that all executors see, for tests and local runs.
"""

from __future__ import annotations

import datetime
import decimal
import hashlib
import itertools
import json
import os
import urllib.error
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, InputPartition, WriterCommitMessage
from pyspark.sql.types import DateType, DecimalType, StringType, StructField, StructType

PER_PAGE = 100
ID = "_id"
# Types that a service's fields have, and what they are here; any other is text.
TYPES = {"string": StringType(), "number": DecimalType(38, 6), "date": DateType()}
#: What became of a row: sent; uncertain, as no answer with an id came; incomplete, as its file isn't there as it was sent; gone, as the record to be changed isn't there.
SENT, UNCERTAIN, INCOMPLETE, GONE = "sent", "uncertain", "incomplete", "gone"


class Lost(Exception):
    """A request that may have been carried out, but whose answer says no id."""


class Folder:
    """A service in a folder: tables.json, and table/records/id.json with table/files/id/name beside it."""

    def __init__(self, base: str):
        self.base = Path(urllib.parse.urlparse(base).path if base.startswith("file:") else base)
        self._listed: dict[str, list[str]] = {}

    def tables(self) -> list[dict]:
        return json.loads((self.base / "tables.json").read_text(encoding="utf-8"))

    def page(self, table: str, n: int) -> list[dict]:
        """The pages of one reader are cut from one listing, that of its first page: a listing a page is quadratic."""
        if table not in self._listed:
            where = self.base / table / "records"
            self._listed[table] = sorted(f.removesuffix(".json") for f in os.listdir(where) if f.endswith(".json") and not f.startswith(".")) if where.is_dir() else []
        return [self.record(table, i) for i in self._listed[table][n * PER_PAGE : (n + 1) * PER_PAGE]]

    def record(self, table: str, key: str) -> dict | None:
        file = self.base / table / "records" / f"{hashlib.sha256(key.encode()).hexdigest() if not _is_id(key) else key}.json"
        return json.loads(file.read_text(encoding="utf-8")) if file.exists() else None

    def create(self, table: str, key: str, fields: dict) -> str:
        """A record of a key is there once: whoever comes second finds it."""
        name = hashlib.sha256(key.encode()).hexdigest()
        where = self.base / table / "records"
        if (where / f"{name}.json").exists():
            return name
        where.mkdir(parents=True, exist_ok=True)
        part = where / f".{name}.{uuid.uuid4().hex}"
        part.write_text(json.dumps({"id": name, "fields": fields}, ensure_ascii=False), encoding="utf-8")
        try:
            os.link(part, where / f"{name}.json")
        except FileExistsError:
            pass
        finally:
            part.unlink()
        return name

    def update(self, table: str, record: str, fields: dict) -> bool:
        """The sent fields over those that are there; whether the record is there at all."""
        have = self.record(table, record)
        if have is None or str(have["id"]) != record:
            return False
        where = self.base / table / "records" / f"{record}.json"
        part = where.with_name(f".{record}.{uuid.uuid4().hex}")
        part.write_text(json.dumps({**have, "fields": (have.get("fields") or {}) | fields}, ensure_ascii=False), encoding="utf-8")
        part.replace(where)
        return True

    def attach(self, table: str, record: str, name: str, kind: str, content: bytes) -> None:
        where = self.base / table / "files" / record
        where.mkdir(parents=True, exist_ok=True)
        (where / name).write_bytes(content)
        (where / f"{name}.type").write_text(kind)

    def files(self, table: str, record: str) -> list[dict]:
        where = self.base / table / "files" / record
        return [{"name": p.name, "size": p.stat().st_size, "contentType": p.with_name(f"{p.name}.type").read_text()} for p in where.glob("*") if p.suffix != ".type"]


def _is_id(key: str) -> bool:
    return len(key) == 64 and set(key) <= set("0123456789abcdef")


class Http:
    """The same over http(s). A create carries its key, so that a service which honours it makes one record."""

    def __init__(self, base: str, token: str):
        self.base, self.token = base.rstrip("/"), token

    def _ask(self, path: str, data: bytes | None = None, headers: dict | None = None):
        ask = urllib.request.Request(f"{self.base}/{path}", data=data, headers={"Authorization": f"Bearer {self.token}"} | (headers or {}))
        with urllib.request.urlopen(ask, timeout=30) as got:
            return json.load(got)

    def tables(self) -> list[dict]:
        return self._ask("tables")

    def page(self, table: str, n: int) -> list[dict]:
        return self._ask(f"{urllib.parse.quote(table)}/records?page={n}&perPage={PER_PAGE}")

    def record(self, table: str, key: str) -> dict | None:
        try:
            return self._ask(f"{urllib.parse.quote(table)}/records/{urllib.parse.quote(key, safe='')}")
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return None
            raise

    def create(self, table: str, key: str, fields: dict) -> str:
        try:
            got = self._ask(f"{urllib.parse.quote(table)}/records", json.dumps({"fields": fields}).encode(), {"Content-Type": "application/json", "Idempotency-Key": key})
        except urllib.error.HTTPError:
            raise  # refused: nothing was made
        except (OSError, ValueError) as e:
            raise Lost(str(e)) from e
        if not isinstance(got, dict) or not got.get("id"):
            raise Lost("an answer without an id")
        return str(got["id"])

    def update(self, table: str, record: str, fields: dict) -> bool:
        ask = urllib.request.Request(f"{self.base}/{urllib.parse.quote(table)}/records/{urllib.parse.quote(record, safe='')}", data=json.dumps({"fields": fields}).encode(), headers={"Authorization": f"Bearer {self.token}", "Content-Type": "application/json"}, method="PUT")
        try:
            with urllib.request.urlopen(ask, timeout=30):
                return True
        except urllib.error.HTTPError as e:
            if e.code == 404:
                return False
            raise

    def attach(self, table: str, record: str, name: str, kind: str, content: bytes) -> None:
        self._ask(f"{urllib.parse.quote(table)}/records/{record}/files?name={urllib.parse.quote(name)}", content, {"Content-Type": kind})

    def files(self, table: str, record: str) -> list[dict]:
        return self._ask(f"{urllib.parse.quote(table)}/records/{record}/files")


def service(options: dict):
    base = options["path"]
    return Http(base, options.get("token", "")) if base.startswith(("http://", "https://")) else Folder(base)


@dataclass
class Pages(InputPartition):
    first: int
    step: int
    key: str | None = None


class TableReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.columns, self.key = dict(options), [(f.name, f.dataType) for f in schema], None
        self.readers = int(options.get("readers", "4"))

    def partitions(self) -> list[InputPartition]:
        return [Pages(0, 1, self.key)] if self.key is not None else [Pages(k, self.readers) for k in range(self.readers)]

    def read(self, part: Pages) -> Iterator[tuple]:
        remote, table = service(self.options), self.options["table"]
        if part.key is not None:
            found = remote.record(table, part.key)
            yield from [self._row(found)] if found and str(found["id"]) == part.key else []
            return
        for n in itertools.count(part.first, part.step):
            rows = remote.page(table, n)
            yield from map(self._row, rows)
            if len(rows) < PER_PAGE:
                return

    def _row(self, record: dict) -> tuple:
        fields = record.get("fields") or {}
        return tuple(str(record["id"]) if name == ID else _value(fields.get(name), kind) for name, kind in self.columns)


class LookupReader(TableReader):
    """A reader to which Spark offers its filters, where its configuration lets it."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """An id that is asked for becomes a lookup of one record; Spark applies every other filter itself."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == (ID,) and self.key is None and isinstance(f.value, str):
                self.key = f.value
            else:
                yield f


def _value(x, kind):
    """A field as its column's type; what isn't one is null, not a failed job."""
    try:
        if x is None or isinstance(kind, StringType):
            return x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)
        return decimal.Decimal(str(x)) if isinstance(kind, DecimalType) else datetime.date.fromisoformat(str(x)[:10])
    except (ValueError, decimal.InvalidOperation):
        return None


@dataclass
class Written(WriterCommitMessage):
    """Counts of one task's rows by outcome, and the file that lists them."""

    report: str
    counts: dict


class TableWriter(DataSourceWriter):
    """Sends each row as a record, once, however often its task runs: the record's key is the row's own.

    ``key`` names the column that identifies a row; ``fields`` is JSON, columns to remote names, and nothing else is written.
    With ``update`` the key is a record's id, and the mapped columns that aren't null are laid over its fields, others stay.
    ``file``, if set, names three columns: name, type and content of a file to attach, which is listed again and compared.
    Outcomes lie in reports by task under ``report``; the commit lists those of the tasks that count, and an aborted write
    leaves none that do, while its records stay and are found again by the next.
    """

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        if overwrite:
            raise ValueError("a remote table is appended to")
        self.options, self.names = dict(options), schema.fieldNames()
        self.mapping, self.key = json.loads(options["fields"]), options["key"]
        self.file = options["file"].split(",") if "file" in options else None
        lacking = [c for c in [self.key, *self.mapping, *(self.file or [])] if c not in self.names]
        if lacking:
            raise ValueError(f"no columns {lacking}")

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        remote, task = service(self.options), TaskContext.get()
        name = f"{self.options['report']}/task-{task.partitionId()}-{task.taskAttemptId()}.json"
        Path(name).parent.mkdir(parents=True, exist_ok=True)
        counts: dict = {}
        with open(name, "w", encoding="utf-8") as report:
            for row in rows:
                key = str(row[self.key])
                fields = {to: _plain(row[c]) for c, to in self.mapping.items() if row[c] is not None}
                outcome, record = self._send(remote, key, fields, row)
                counts[outcome] = counts.get(outcome, 0) + 1
                report.write(json.dumps({"key": key, "outcome": outcome, "record": record}) + "\n")
        return Written(name, counts)

    def _send(self, remote, key: str, fields: dict, row) -> tuple[str, str | None]:
        table = self.options["table"]
        if self.options.get("update", "false") == "true":
            return (SENT, key) if remote.update(table, key, fields) else (GONE, None)
        try:
            record = remote.create(table, key, fields)
        except Lost:
            # it may be there: asked for by its key, it is adopted, and it is never made a second time blindly
            found = remote.record(table, key)
            if not found:
                return UNCERTAIN, None
            record = str(found["id"])
        if self.file and row[self.file[2]] is not None:
            name, kind, content = (row[c] for c in self.file)
            content = bytes(content)
            remote.attach(table, record, name, kind, content)
            there = [(f["name"], f["size"], f["contentType"]) for f in remote.files(table, record)]
            if (name, len(content), kind) not in there:
                return INCOMPLETE, record
        return SENT, record

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        total: dict = {}
        for m in done:
            for k, n in m.counts.items():
                total[k] = total.get(k, 0) + n
        out = Path(self.options["report"], "committed.json")
        out.parent.mkdir(parents=True, exist_ok=True)
        out.write_text(json.dumps({"counts": total, "reports": [m.report for m in done]}), encoding="utf-8")

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m is not None:
                Path(m.report).unlink(missing_ok=True)


def _plain(x):
    return float(x) if isinstance(x, decimal.Decimal) else x.isoformat() if isinstance(x, datetime.date) else x


class RemoteTable(DataSource):
    """spark.dataSource.register(RemoteTable), then as a format; see the module."""

    @classmethod
    def name(cls) -> str:
        return "remote_table"

    def schema(self) -> StructType:
        """The table's fields as the service lists them now, after the record's id."""
        for t in service(self.options).tables():
            if t["name"] == self.options["table"]:
                return StructType([StructField(ID, StringType()), *[StructField(f["name"], TYPES.get(f["type"], StringType())) for f in t["fields"]]])
        raise ValueError(f"the service has no table {self.options['table']}")

    def reader(self, schema: StructType) -> DataSourceReader:
        """With the option ``lookup`` an id that is asked for is looked up; spark.sql.python.filterPushdown.enabled has to be true then."""
        return (LookupReader if self.options.get("lookup", "false") == "true" else TableReader)(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TableWriter(self.options, schema, overwrite)
