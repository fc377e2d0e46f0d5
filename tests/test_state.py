"""State machines in batch and on streams, review sessions, and orders of any type."""

import random

from pyspark.sql import functions as F

from quillstone.operators import entries, evaluation, heuristics, records, review
from quillstone.sources import files
from quillstone.streaming import machine

STEPS = "user_id long, ts timestamp, event_id long, to_state string, record_id string, reason string"


def plain(steps):
    """(state, revision, record_id, reason), [(event_id, to_state, why, state)] of one document's steps in order."""
    state, revision, record_id, reason, refused = "pending", 1, None, None, []
    for _, event_id, to, new, why_now in steps:
        known = new or record_id
        why = "illegalTransition" if to not in records.TRANSITIONS[state] else "sentWithoutRecord" if to == "sent" and not known else None
        if why:
            refused.append((event_id, to, why, state))
        else:
            state, revision, record_id, reason = to, revision + 1, known, why_now
    return (state, revision, record_id, reason), refused


def random_steps(rng, n):
    path = ["extracting", "reviewing", "sending", "sent", "uncertain", "failed", "queued", "pending"]
    return [(rng.randrange(4), k, rng.choice(path), rng.choice([None, None, f"r{k}"]), rng.choice([None, f"e{k}"])) for k in range(n)]


def frame(spark, rows):
    df = spark.createDataFrame([(u, k, k, to, r, e) for u, k, to, r, e in rows], "user_id long, t long, event_id long, to_state string, record_id string, reason string")
    return df.select("user_id", F.timestamp_seconds("t").alias("ts"), "event_id", "to_state", "record_id", "reason")


def expected(rows):
    return {u: plain([(k, k, to, r, e) for v, k, to, r, e in rows if v == u]) for u in {x[0] for x in rows}}


def test_replay(spark):
    rows = random_steps(random.Random(1), 400) + [(9, 1000 + k, to, None, None) for k, to in enumerate(("extracting", "reviewing", "sending", "sent"))]
    got = {r["user_id"]: ((r["state"], r["revision"], r["record_id"], r["reason"]), [tuple(x)[1:] for x in r["refused"]]) for r in records.replay_entries(frame(spark, rows).repartition(3), "user_id", ["ts", "event_id"]).collect()}
    assert got == expected(rows) and {x[2] for _, refused in got.values() for x in refused} == {"illegalTransition", "sentWithoutRecord"}
    assert records.replay_entries(frame(spark, rows).limit(0), "user_id", ["ts", "event_id"]).collect() == []


def test_a_stream_of_two_batches_equals_the_replay(spark, tmp_path):
    rows = random_steps(random.Random(2), 300)
    inbox = str(tmp_path / "in")
    for part in (rows[:150], rows[150:]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema(frame(spark, rows).schema).option("maxFilesPerTrigger", 1).parquet(inbox)
    told = machine.run(machine.entries(stream, "user_id"), "update")
    assert told.select("batch").distinct().count() == 2
    last, refused = machine.settled(told, "user_id")
    want = expected(rows)
    assert {r["user_id"]: tuple(r)[1:] for r in last.collect()} == {u: w[0] for u, w in want.items()}
    assert sorted(map(tuple, refused.collect())) == sorted((u, *x) for u, w in want.items() for x in w[1])


def test_duplicates_are_flagged_once_over_batches(spark, tmp_path):
    inbox = str(tmp_path / "in")
    for part in ([("a", 1, "x"), ("b", 2, "x"), ("c", 3, "y")], [("b", 4, "x"), ("d", 5, "y"), ("e", 6, None), ("a", 7, "x")]):
        spark.createDataFrame(part, "doc_id string, t long, hash string").select("doc_id", F.timestamp_seconds("t").alias("ts"), "hash").coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema("doc_id string, ts timestamp, hash string").option("maxFilesPerTrigger", 1).parquet(inbox)
    assert sorted(tuple(r)[:3] for r in machine.run(machine.duplicate_flags(stream), "append").collect()) == [("b", "a", 2), ("d", "c", 2)]


def test_review_sessions(spark):
    # (order, action, field, typed, parsed, colour, day)
    rows = [(1, "edit", "f", "x", "x", "green", 1), (2, "unlock", "f", None, None, "green", 1), (3, "edit", "f", "y", "y", "green", 1), (4, "edit", "f", "z", None, "green", 1), (5, "reread", "f", "w", None, "green", 1),
            (6, "edit", "g", "q", "q", "amber", 1), (7, "acknowledge", "g", None, None, "amber", 1), (8, "acknowledge", "g", None, None, "amber", 1), (9, "acknowledge", "g", None, None, "amber", 2), (10, "reread", "h", "v", None, "red", 2), (11, "unlock", "i", None, None, "red", 2)]
    df = spark.createDataFrame([("d", *r) for r in rows], "doc string, at int, action string, field string, typed string, parsed string, colour string, day int")
    taken = review.session(df, "doc", ["at"], "day")
    got = {r["at"]: (r["accepted"], r["acknowledged"]) for r in taken.collect()}
    assert [k for k, v in got.items() if not v[0]] == [1, 4, 8] and [k for k, v in got.items() if v[1]] == [7, 8, 9, 10, 11]
    assert {(r["field"], r["state"], r["value"]) for r in review.session_values(taken, "doc", ["at"]).collect()} == {("f", "edited", "y"), ("g", "edited", "q"), ("h", "present", "v"), ("i", "absent", None)}


def test_orders_of_any_type(spark):
    writes = spark.createDataFrame([("k", 2, "b", 1.0), ("k", 2, "a", 2.0), ("k", 1, "0", 3.0), (None, 1, "x", 4.0), (None, None, "y", 5.0)], "key string, revision int, at string, v double")
    assert sorted(((r["key"], r["revision"], r["v"]) for r in entries.latest(writes, "key", ["at"]).collect()), key=repr) == [("k", 2, 2.0), (None, 1, 4.0)]
    rows = spark.createDataFrame([("g", "x", "2024-01-02"), ("g", "y", "2024-01-01"), ("g", "x", "2024-01-03"), ("g", "y", "2024-01-04")], "g string, v string, at string")
    assert tuple(heuristics.majority(rows, ["g"], "v", "at").first()) == ("g", "y", 2)
    assert heuristics.best_pass(spark.createDataFrame([("d", "p2", "one two"), ("d", "p1", "six ten")], "d string, p string, t string"), "d", "p", "t").first()["p"] == "p1"


def test_queue_and_best(spark):
    rows = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, False), (2, 1, None), (2, 2, False), (None, 5, True), (None, 6, False)], "to int, at int, stop boolean")
    assert sorted(map(repr, ((r["to"], r["at"]) for r in records.queue_prefix(rows, "to", ["at"], F.col("stop")).collect()))) == sorted(map(repr, [(1, 1), (1, 2), (2, 1), (2, 2), (None, 5)]))
    assert {(r["to"], tuple(r["best"])) for r in entries.best_of(rows, "to", [F.desc("at")], "at", 2).collect()} == {(1, (3, 2)), (2, (2, 1)), (None, (6, 5))}


def test_medians(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 3), ("a", 3), ("b", 2), ("b", 5), ("c", None)], "g string, v int")
    assert {tuple(r) for r in evaluation.median_of(rows, "v", ["g"]).collect()} == {("a", 3.0), ("b", 3.5)} and evaluation.median_of(rows, "v").first()[0] == 3.0
    assert evaluation.segmentation(rows.withColumn("text", F.lit("ab")), ["g"]).filter("median_length = 2").count() == 3


def test_files_are_taken_in_once(spark, tmp_path):
    inbox, store, checkpoint = (str(tmp_path / x) for x in ("in", "store", "check"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-1")
    (tmp_path / "in" / "copy.pdf").write_bytes(b"%PDF-1")
    files.intake_stream(spark, inbox, store, checkpoint).awaitTermination()
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF-2")
    (tmp_path / "in" / "again.pdf").write_bytes(b"%PDF-1")
    files.intake_stream(spark, inbox, store, checkpoint).awaitTermination()
    got = spark.read.parquet(store).collect()
    assert sorted(bytes(r["content"]) for r in got) == [b"%PDF-1", b"%PDF-2"] and {r["batch"] for r in got} == {0, 1}
