"""Documents as state machines over a stream: one small entry a document in a value state, refused steps beside it.

The same rules as ``records.replay_entries``, kept from batch to batch. Duplicates are a second machine, keyed by content: it
knows the first document of each content and flags every other one, beside its state and once.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillstone.operators.records import TRANSITIONS
from quillstone.sources.shared import shared_dir

_ENTRY = "state string, revision int, record_id string, reason string"
#: What a machine tells: kind is ``entry`` (where a document stands after a batch) or ``refused`` (one step and why).
_TOLD = "kind string, event_id bigint, to_state string, why string, state string, revision int, record_id string, reason string"


class Machine(StatefulProcessor):
    """Steps of one document, in the order of (ts, event_id) within a batch."""

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", _ENTRY)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, revision, record_id, reason = self.entry.get() if self.entry.exists() else ("pending", 1, None, None)
        told = []
        steps = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        given = lambda x: None if x is None or x != x else x
        for event_id, to, new_id, why_now in zip(steps["event_id"], steps["to_state"], steps["record_id"], steps["reason"], strict=True):
            known = given(new_id) or record_id
            why = "illegalTransition" if to not in TRANSITIONS[state] else "sentWithoutRecord" if to == "sent" and known is None else None
            if why:
                told.append(("refused", int(event_id), to, why, state, revision, record_id, reason))
            else:
                state, revision, record_id, reason = to, revision + 1, known, given(why_now)
        self.entry.update((state, revision, record_id, reason))
        told.append(("entry", None, None, None, state, revision, record_id, reason))
        names = [c.split()[0] for c in _TOLD.split(", ")]
        out = pd.DataFrame(told, columns=names).astype({"event_id": "Int64"})
        out.insert(0, self.key, key[0])
        yield out

    def close(self) -> None:
        pass


class FirstOfContent(StatefulProcessor):
    """Flags every document whose content an earlier one had; a document is flagged once, however often it comes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "doc_id string")
        self.flagged = handle.getMapState("flagged", "doc_id string", "revision int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = self.first.get()[0] if self.first.exists() else None
        out = []
        for doc in pd.concat(list(rows)).sort_values(["ts", "doc_id"])["doc_id"]:
            if first is None:
                first = doc
                self.first.update((first,))
            elif doc != first and not self.flagged.containsKey((doc,)):
                self.flagged.updateValue((doc,), (2,))
                out.append((doc, first, 2))
        yield pd.DataFrame(out, columns=["doc_id", "original", "revision"])

    def close(self) -> None:
        pass


def entries(steps: DataFrame, key: str) -> DataFrame:
    """key and what :class:`Machine` tells of a stream of steps (key, ts, event_id, to_state, record_id, reason)."""
    kind = steps.schema[key].dataType.simpleString()
    return steps.groupBy(key).transformWithStateInPandas(Machine(key), f"{key} {kind}, {_TOLD}", "update", "None")


def duplicate_flags(captured: DataFrame) -> DataFrame:
    """doc_id, original, revision of a stream of captured documents (doc_id, ts, hash) whose content an earlier one had."""
    known = captured.filter("hash is not null").select("hash", F.col("doc_id").cast("string").alias("doc_id"), "ts")
    return known.groupBy("hash").transformWithStateInPandas(FirstOfContent(), "doc_id string, original string, revision int", "append", "None")


def run(stream: DataFrame, mode: str) -> DataFrame:
    """All rows that a stream of files yields until its end, with ``batch``; written in the shared folder by batch, so that a batch that is tried again is there once."""
    spark: SparkSession = stream.sparkSession
    base = f"{shared_dir(spark)}/machine-{uuid.uuid4().hex}"
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider, None)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = (
            stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
            .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{base}/out/batch={n}")).start()
        )
        query.awaitTermination()
    finally:
        spark.conf.unset(provider) if before is None else spark.conf.set(provider, before)
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/out")
    exists = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
    if not exists:  # a stream without files has no batch
        return spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0))
    return spark.read.schema(f"{', '.join(f'`{n}` {t}' for n, t in stream.dtypes)}, batch int").parquet(f"{base}/out")


def settled(told: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(entries, refused) of what :func:`run` brings of machines: each document's last entry, and every refused step."""
    last = told.filter("kind = 'entry'").groupBy(key).agg(F.max_by(F.struct("state", "revision", "record_id", "reason"), "batch").alias("e")).select(key, "e.*")
    return last, told.filter("kind = 'refused'").select(key, "event_id", "to_state", "why", "state")
