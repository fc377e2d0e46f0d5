"""Records and their history: duplicates, reconciliation, matching, state machines and the send queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.text import name_normalised, similarity

# The transitions a document may make.
TRANSITIONS = {
    "pending": ["extracting", "failed"],
    "extracting": ["reviewing", "failed"],
    "reviewing": ["queued", "sending"],
    "queued": ["sending"],
    "sending": ["sent", "uncertain", "failed", "queued"],
    "uncertain": ["sending", "sent", "failed"],
    "failed": ["reviewing"],
    "sent": ["reviewing"],
}


def allowed(state: Column, to: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for kv in TRANSITIONS.items() for x in kv])
    return F.coalesce(F.array_contains(F.try_element_at(pairs, state), to), F.lit(False))


def replay(events: DataFrame, key: str, order: list[str], to: str = "to_state") -> DataFrame:
    """key, state, revision, refused: each document's events applied in order from ``pending``.

    A transition that is not allowed is counted and changes nothing; each one that is adds 1 to the revision, from 1 on. A
    document's own events are one array, folded inside the engine.
    """
    start = F.struct(F.lit("pending").alias("state"), F.lit(1).alias("revision"), F.lit(0).alias("refused"))

    def step(a, e):
        ok = allowed(a["state"], e[to])
        return F.struct(F.when(ok, e[to]).otherwise(a["state"]).alias("state"), (a["revision"] + ok.cast("int")).alias("revision"), (a["refused"] + (~ok).cast("int")).alias("refused"))

    done = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, to))).alias("events")).withColumn("r", F.aggregate("events", start, step))
    return done.select(key, "r.*")


def replay_entries(steps: DataFrame, key: str, order: list[str]) -> DataFrame:
    """key, state, revision, record_id, reason, refused (array of struct(order, to_state, why, state)) of each document's steps
    (key, order, to_state, record_id, reason) applied in order from ``pending``.

    A step may bring a record id, which stays with the document, and a reason, which lasts until the next step. A step that
    its state doesn't allow is refused as ``illegalTransition``, and one to ``sent`` of a document that has no record id as
    ``sentWithoutRecord``: it changes nothing and stands in refused. Each step taken adds 1 to the revision, from 1 on.
    """
    kinds = {c: steps.schema[c].dataType.simpleString() for c in order}
    refusal = f"array<struct<{', '.join(f'{c}:{t}' for c, t in kinds.items())}, to_state:string, why:string, state:string>>"
    none = F.lit(None).cast("string")
    start = F.struct(F.lit("pending").alias("state"), F.lit(1).alias("revision"), none.alias("record_id"), none.alias("reason"), F.array().cast(refusal).alias("refused"))

    def step(a, e):
        known = F.coalesce(e["record_id"], a["record_id"])
        why = F.when(~allowed(a["state"], e["to_state"]), "illegalTransition").when((e["to_state"] == "sent") & known.isNull(), "sentWithoutRecord")
        ok = why.isNull()
        told = F.when(ok, a["refused"]).otherwise(F.array_append(a["refused"], F.struct(*[e[c].alias(c) for c in order], e["to_state"].alias("to_state"), why.alias("why"), a["state"].alias("state"))))
        return F.struct(
            F.when(ok, e["to_state"]).otherwise(a["state"]).alias("state"), (a["revision"] + ok.cast("int")).alias("revision"),
            F.when(ok, known).otherwise(a["record_id"]).alias("record_id"), F.when(ok, e["reason"]).otherwise(a["reason"]).alias("reason"), told.alias("refused"),
        )

    own = F.array_sort(F.collect_list(F.struct(*order, "to_state", "record_id", "reason")))
    done = steps.groupBy(key).agg(own.alias("_e")).withColumn("r", F.aggregate("_e", start, step))
    return done.select(key, "r.*")


def duplicates(entries: DataFrame, key: str, content: list[str], sent: Column, newest: list[Column]) -> DataFrame:
    """key, original, criterion: for each entry the newest sent other entry of equal hash, else of equal content.

    ``entries`` has key, hash and the content columns; null hashes and contents with a null match nothing. Candidates are
    bounded to the two newest sent entries a key value before the join, so copies are never paired with each other.
    """
    def first_two(by: list[str]) -> DataFrame:
        whole = F.lit(True)
        for c in by:
            whole &= F.col(c).isNotNull()
        w = Window.partitionBy(*by).orderBy(*newest, F.col(key))
        top = entries.filter(sent & whole).withColumn("_n", F.row_number().over(w)).filter("_n <= 2")
        return top.groupBy(*by).agg(F.max(F.when(F.col("_n") == 1, F.col(key))).alias("_a"), F.max(F.when(F.col("_n") == 2, F.col(key))).alias("_b"))

    out = entries.select(key, "hash", *content)
    for name, by in (("hash", ["hash"]), ("content", content)):
        other = F.when(F.col("_a") != F.col(key), F.col("_a")).otherwise(F.col("_b"))
        out = out.join(first_two(by), by, "left").withColumn(f"_{name}", other).drop("_a", "_b")
    return out.select(key, F.coalesce("_hash", "_content").alias("original"), F.when(F.col("_hash").isNotNull(), "hash").when(F.col("_content").isNotNull(), "content").alias("criterion"))


def reconcile(sends: DataFrame, records: DataFrame, user: str, sent_at: str, created_at: str, seconds: int = 120, fields: str | None = None) -> DataFrame:
    """Sends with candidates (records of the same user created in the window before) and decision: 0 create, 1 adopt, more ask.

    Time is cut into windows as long as the interval; a send meets its own window and the one before by equality, and
    the exact interval is the residual. With ``fields``, a map in both, only records that hold every sent field with an equal
    value are candidates; where fewer than two fields were sent that is too little to adopt, and records in time are asked about.
    """
    bucket = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(seconds * 1_000_000))
    r = records.select(F.col(user).alias("_u"), F.col(created_at).alias("_at"), bucket(F.col(created_at)).alias("_w"), *([F.col(fields).alias("_f")] if fields else []))
    # equal sends are one row with a count, and come back as so many
    counted = sends.groupBy(*sends.columns).agg(F.count("*").cast("int").alias("_copies"))
    s = counted.withColumn("_w", F.explode(F.array(bucket(F.col(sent_at)), bucket(F.col(sent_at)) - 1)))
    inside = (F.col("_at") <= F.col(sent_at)) & (F.col("_at") >= F.col(sent_at) - F.expr(f"interval {seconds} seconds"))
    few = F.lit(False)
    if fields:
        few = F.coalesce(F.size(fields), F.lit(0)) < 2
        inside &= few | F.coalesce(F.forall(F.map_entries(fields), lambda e: F.map_contains_key("_f", e["key"]) & F.col("_f")[e["key"]].eqNullSafe(e["value"])), F.lit(False))
    met = s.join(r, (F.col(user) == F.col("_u")) & (s["_w"] == r["_w"]) & inside, "left").groupBy(*sends.columns, "_copies").agg(F.count("_at").alias("candidates"))
    return met.withColumn("decision", F.when(F.col("candidates") == 0, "create").when((F.col("candidates") == 1) & ~few, "adopt").otherwise("ask")).withColumn("_copies", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copies")


def queue_prefix(queue: DataFrame, destination: str, order: list[str], stops: Column) -> DataFrame:
    """Rows of each destination's queue up to and with the first that stops it, oldest first.

    The first stop is a minimum with partial sums, and rows meet it by equality: a queue of any length needs no sort.
    """
    stop = queue.filter(F.coalesce(stops, F.lit(False))).groupBy(F.col(destination).alias("_to")).agg(F.min(F.struct(*order)).alias("_stop"))
    met = queue.join(stop, F.col(destination).eqNullSafe(F.col("_to")), "left")
    return met.filter(F.col("_stop").isNull() | (F.struct(*order) <= F.col("_stop"))).drop("_to", "_stop")


def retry_plan(state: Column, record_id: Column) -> Column:
    """What a retry does: ``create``, ``resume``, ``decide`` (a person must) or ``refused``."""
    return F.when(state == "queued", "create").when(state == "failed", F.when(record_id.isNull(), "create").otherwise("resume")).when(state == "uncertain", F.when(record_id.isNull(), "decide").otherwise("resume")).otherwise("refused")


def outcome_state(outcome: Column) -> Column:
    return F.when(outcome == "incomplete", "failed").otherwise(outcome)


def failure_of_status(status: Column) -> Column:
    """Failure class of an HTTP status, null for success."""
    return F.when(status.between(200, 299), None).when(status.isin(401, 403), "auth").when(status == 404, "gone").when(status == 429, "throttled").when(status >= 500, "server").otherwise("other")


def typed_matches(core: DataFrame, columns: DataFrame, least: float = 0.0) -> DataFrame:
    """core_field, core_no, field_id, field_no, score: core fields (kind, core_field, core_no, synonyms) and a table's columns
    (kind, field_id, field_no, name) of the same kind, by the best similarity of the name to a synonym.

    The kind is an equality of the join and decides before any name is looked at.
    """
    met = core.join(columns, "kind").withColumn("_name", name_normalised(F.col("name")))
    score = F.array_max(F.transform("synonyms", lambda s: similarity(F.col("_name"), name_normalised(s))))
    return met.select("core_field", "core_no", "field_id", "field_no", F.coalesce(score, F.lit(0.0)).alias("score")).filter(F.col("score") >= least)


def propose_mappings(scored: DataFrame, table: str, threshold: float = 0.85, margin: float = 0.05) -> DataFrame:
    """table, core_field, field_id: greedy one-to-one proposals from ``scored`` (table, core_field, core_no, field_id, field_no, score).

    Best score first, then field order; a candidate is skipped unless it leads every other open field of its core field
    by ``margin``. The steps depend on each other, so a table, which has some tens of columns, is a group.
    """
    def greedy(pdf):
        import pandas as pd

        rows = pdf[pdf["score"] >= threshold].sort_values(["score", "core_no", "field_no"], ascending=[False, True, True])
        proposed, taken = {}, set()
        for r in rows.itertuples():
            if r.core_field in proposed or r.field_id in taken:
                continue
            others = rows[(rows["core_field"] == r.core_field) & (rows["field_id"] != r.field_id) & ~rows["field_id"].isin(taken)]["score"]
            if r.score - (others.max() if len(others) else 0.0) >= margin:
                proposed[r.core_field] = r.field_id
                taken.add(r.field_id)
        return pd.DataFrame([(pdf[table].iloc[0], c, f) for c, f in proposed.items()], columns=[table, "core_field", "field_id"])

    return scored.groupBy(table).applyInPandas(greedy, f"{table} {scored.schema[table].dataType.simpleString()}, core_field string, field_id string")
