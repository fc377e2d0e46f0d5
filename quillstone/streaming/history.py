"""Document states over a stream of events: keyed state, one small tuple a document."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from quillstone.operators.records import TRANSITIONS

_STATE = "state string, revision long, refused long"


def step(key, frames, state: GroupState):
    """Applies a key's new events in (ts, event_id) order and emits where it stands."""
    at, revision, refused = state.get if state.exists else ("pending", 1, 0)
    events = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    for to in events["to_state"]:
        if to in TRANSITIONS[at]:
            at, revision = to, revision + 1
        else:
            refused += 1
    state.update((at, revision, refused))
    yield pd.DataFrame({"doc_key": [key[0]], "state": [at], "revision": [revision], "refused": [refused]})


def states(events: DataFrame, key: str) -> DataFrame:
    """doc_key, state, revision, refused after each micro-batch, of a stream with key, ts, event_id, to_state.

    Late events are applied when they come: a document's order is that of arrival between batches, by time within one.
    """
    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"doc_key {kind}, {_STATE}", _STATE, "update", GroupStateTimeout.NoTimeout)


def session_activity(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Extension: user_id, session start and end, events in it; sessions close ``gap`` after their last event, and events
    later than ``late`` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n")).select("user_id", "s.start", "s.end", "n")


def flag_duplicates(entries: DataFrame, late: str = "1 day") -> DataFrame:
    """Extension: the first entry of each hash within the watermark; use beside, not instead of, the batch duplicate flag."""
    return entries.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["hash"])


def replay_stream(spark: SparkSession, path: str, schema: StructType, names: list[str]) -> DataFrame:
    """user_id, state, revision, refused: a file source read to its end, and the last state of each key.

    Output and checkpoint lie in the shared folder named by spark.checkpoint.dir, or in a temporary one where it is unset.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quillstone-stream-")
    base = f"{base}/history-{uuid.uuid4().hex}"
    to = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 8 + 1).cast("int"))
    read = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, a path may be a file or a folder
    stream = read.select("user_id", "ts", "event_id", to.alias("to_state"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/states/batch={batch_id}")

    query = states(stream, "user_id").writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    seen = spark.read.parquet(f"{base}/states")
    last = seen.groupBy("doc_key").agg(F.max_by(F.struct("state", "revision", "refused"), "batch").alias("s"))
    return last.select(F.col("doc_key").alias("user_id"), "s.*")
