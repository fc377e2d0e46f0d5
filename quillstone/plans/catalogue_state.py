"""Queries of documents' states: machines replayed and streamed, duplicates flagged on a stream, review sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import records, review
from quillstone.plans.catalogue import _ALLOWED, _STATES, big, query
from quillstone.streaming import machine

_GIVEN = "case when event_id % 3 = 0 then 'r' || event_id end as record_id, case when event_id % 5 = 0 then 'e' || event_id % 7 end as reason"
_REPLAYED = f"""
with recursive e as (select user_id, event_id, ({_STATES})[cast(event_id % 8 as int) + 1] as t, {_GIVEN}, row_number() over (partition by user_id order by ts, event_id) as n from events),
r as (select user_id, 0 as n, cast(null as bigint) as event_id, 'pending' as s, 1 as revision, cast(null as varchar) as record_id, cast(null as varchar) as reason, cast(null as varchar) as why, cast(null as varchar) as t, 'pending' as was from (select distinct user_id from events)
  union all select user_id, n, event_id, case when why is null then t else was end, revision + (case when why is null then 1 else 0 end), case when why is null then known else old_id end, case when why is null then new_reason else old_reason end, why, t, was
  from (select r.user_id, e.n, e.event_id, e.t, r.s as was, r.revision, coalesce(e.record_id, r.record_id) as known, r.record_id as old_id, e.reason as new_reason, r.reason as old_reason,
    case when not ({_ALLOWED.replace("s = ", "r.s = ").replace("t in", "e.t in")}) then 'illegalTransition' when e.t = 'sent' and coalesce(e.record_id, r.record_id) is null then 'sentWithoutRecord' end as why
    from r join e on e.user_id = r.user_id and e.n = r.n + 1) q)"""
_ENTRIES = f"{_REPLAYED} select user_id, arg_max(s, n) as state, cast(arg_max(revision, n) as bigint) as revision, max(record_id) filter (n = m) as record_id, max(reason) filter (n = m) as reason from (select *, max(n) over (partition by user_id) as m from r) group by 1"
_REFUSED = f"{_REPLAYED} select user_id, event_id, t as to_state, why, was as state from r where why is not null"


def _steps(table_or_stream: DataFrame) -> DataFrame:
    """Steps of each user's document, made from the events."""
    to = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("event_id") % 8 + 1).cast("int"))
    return table_or_stream.select("user_id", "ts", "event_id", to.alias("to_state"), F.expr("case when event_id % 3 = 0 then 'r' || event_id end").alias("record_id"), F.expr("case when event_id % 5 = 0 then 'e' || event_id % 7 end").alias("reason"))


@query(_ENTRIES)
def machine_entries(spark, table):
    """Where each document's steps lead: a record id is needed to be sent, and a reason lasts for one step."""
    return records.replay_entries(_steps(table("events")), "user_id", ["ts", "event_id"]).select("user_id", "state", big("revision").alias("revision"), "record_id", "reason")


@query(_REFUSED)
def machine_refusals(spark, table):
    """Every refused step and why."""
    found = records.replay_entries(_steps(table("events")), "user_id", ["ts", "event_id"]).select("user_id", F.explode("refused").alias("r"))
    return found.select("user_id", "r.event_id", "r.to_state", "r.why", "r.state")


def _streamed(spark, table, name: str):
    path = f"{table.dir}/{name}.parquet"
    return spark.readStream.schema(table(name).schema).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, a path may be a file or a folder


@query(_ENTRIES)
def machine_stream(spark, table):
    """machine_entries over a stream of the events, with a value state a document."""
    told = machine.run(machine.entries(_steps(_streamed(spark, table, "events")), "user_id"), "update")
    return machine.settled(told, "user_id")[0].select("user_id", "state", big("revision").alias("revision"), "record_id", "reason")


@query(_REFUSED)
def machine_stream_refusals(spark, table):
    """The refused steps beside the same stream."""
    told = machine.run(machine.entries(_steps(_streamed(spark, table, "events")), "user_id"), "update")
    return machine.settled(told, "user_id")[1]


@query("""
with h as (select cast(doc_id as varchar) as doc_id, sha256(text) as hash from documents where text is not null), f as (select hash, min(doc_id) as original from h group by 1)
select h.doc_id, f.original, cast(2 as bigint) as revision from h join f using (hash) where h.doc_id <> f.original""")
def duplicate_stream(spark, table):
    """Documents of a stream whose text an earlier one had, flagged once each."""
    captured = _streamed(spark, table, "documents").filter("text is not null").select("doc_id", F.timestamp_seconds(F.lit(0)).alias("ts"), F.sha2("text", 256).alias("hash"))
    return machine.run(machine.duplicate_flags(captured), "append").select("doc_id", "original", big("revision").alias("revision"))


_FIELD = "(['docDate', 'supplierName', 'docNumber', 'grossTotal', 'currency', 'supplierTaxId'])[cast(event_id % 6 as int) + 1]"
_ACTION = "case event_type when 'click' then 'edit' when 'view' then 'unlock' when 'signup' then 'acknowledge' else 'reread' end"
_TYPED = "case event_id % 4 when 0 then '2024-02-30' when 1 then '2024-03-' || lpad(cast(event_id % 28 + 1 as {s}), 2, '0') when 2 then cast(event_id % 100 as {s}) || '.50' else 'usd' end"
_SESSION = f"""
with a as (select user_id, event_id, ts, cast(ts as date) as day, {_ACTION} as action, {_FIELD} as field, {_TYPED.format(s='varchar')} as typed, (['green', 'amber', 'red'])[cast((user_id + event_id % 6) % 3 as int) + 1] as colour from events),
p as (select *, case field when 'docDate' then case when regexp_full_match(typed, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') then cast(try_cast(typed as date) as varchar) end
  when 'grossTotal' then case when regexp_full_match(typed, '[0-9]+[.][0-9]{{2}}') then cast(cast(replace(typed, '.', '') as bigint) as varchar) end when 'currency' then case when typed = 'usd' then 'USD' end else typed end as parsed from a),
w as (select *, coalesce(bool_or(action = 'unlock') over (partition by user_id, field order by ts, event_id rows between unbounded preceding and 1 preceding), false) as unlocked,
  coalesce(bool_or(action = 'acknowledge') over (partition by user_id, day order by ts, event_id rows between unbounded preceding and 1 preceding), false) as before from p),
s as (select *, case action when 'edit' then parsed is not null and (colour <> 'green' or unlocked) when 'acknowledge' then not before else true end as accepted, before or action = 'acknowledge' as acknowledged from w)"""


def _actions(table) -> DataFrame:
    at = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    names = ("docDate", "supplierName", "docNumber", "grossTotal", "currency", "supplierTaxId")
    rows = table("events").select("user_id", "event_id", "ts", F.to_date("ts").alias("day"), F.expr(_ACTION).alias("action"), at(names, F.col("event_id") % 6).alias("field"), F.expr(_TYPED.format(s="string")).alias("typed"), at(("green", "amber", "red"), (F.col("user_id") + F.col("event_id") % 6) % 3).alias("colour"))
    told = review.edit(F.col("field"), F.col("typed"), F.lit("EUR"))
    return rows.withColumn("_edit", told).withColumn("parsed", F.when(F.col("_edit.refusal").isNull(), F.col("_edit.value"))).drop("_edit")


@query(f"""{_SESSION} select user_id, event_id, action, field, accepted, acknowledged from s""")
def review_session(spark, table):
    """What a review session takes of a reviewer's actions: green fields are locked, and one tap a day acknowledges."""
    return review.session(_actions(table), "user_id", ["ts", "event_id"], "day").select("user_id", "event_id", "action", "field", "accepted", "acknowledged")


@query(f"""{_SESSION},
l as (select user_id, field, arg_max(parsed, (ts, event_id)) filter (action = 'edit' and accepted and parsed is not null) as e, arg_max(typed, (ts, event_id)) filter (action = 'reread' and typed is not null) as r from s group by 1, 2)
select user_id, field, case when e is not null then 'edited' when r is not null then 'present' else 'absent' end as state, coalesce(e, r) as value from l""")
def review_values(spark, table):
    """What a session leaves in each field: an edit outlives every second read."""
    taken = review.session(_actions(table), "user_id", ["ts", "event_id"], "day")
    return review.session_values(taken, "user_id", ["ts", "event_id"])
