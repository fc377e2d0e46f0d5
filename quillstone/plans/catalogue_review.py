"""More registered queries: review, countries, lenient readers and stored entries; see catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.functions import amounts, dims, identifiers
from quillstone.functions.text import supplier_normalised
from quillstone.operators import country, entries, evaluation, heuristics, lenient, photo, review
from quillstone.plans import fields
from quillstone.plans.catalogue import _BOX, _MINOR, _WORDS_SQL, big, minor, order_words, query
from quillstone.sources import files, image_header

_M = _MINOR.format("l_extendedprice")
_THOUSANDS, _HUNDREDS = f"cast(cast(floor({_M} / 100000) as bigint) as string)", f"lpad(cast(cast(floor({_M} / 100) as bigint) % 1000 as string), 3, '0')"
_CENTS = f"lpad(cast({_M} % 100 as string), 2, '0')"
#: An amount as printed in several places; the same text in both dialects.
_LOOSE = f"""case l_linenumber % 7 when 0 then 'abc' when 1 then {_THOUSANDS} || '.' || {_HUNDREDS} || ',' || {_CENTS} || ' €' when 2 then {_THOUSANDS} || ',' || {_HUNDREDS} || '.' || {_CENTS}
 when 3 then cast(cast(floor({_M} / 100) as bigint) as string) || ',' || {_CENTS} || ' EUR' when 4 then {_THOUSANDS} || '.' || {_HUNDREDS} when 5 then {_THOUSANDS} || ',' || {_HUNDREDS} || ' usd' else {_THOUSANDS} || ' ' || {_HUNDREDS} || '.' || {_CENTS} end"""


@query(f"""
select l_orderkey, l_linenumber, case l_linenumber % 7 when 0 then null when 4 then floor({_M} / 100.0) when 5 then floor({_M} / 100.0) else {_M} / 100.0 end::double as value from lineitem""")
def loose_amount(spark, table):
    return table("lineitem").select("l_orderkey", "l_linenumber", lenient.last_mark_amount(F.expr(_LOOSE)).alias("value"))


@query(r"""
with r as (select doc_id, regexp_extract_all(text, '\d{1,3}(?:[.\s]\d{3})+(?:,\d{1,2})?|\d+(?:[.,]\d{1,2})?') as raws from documents),
e as (select doc_id, unnest(raws) as raw, unnest(range(len(raws))) as nth from r), t as (select *, regexp_replace(raw, '\s', '', 'g') as s from e)
select doc_id, cast(nth as bigint) as nth, raw, case when abs(v) < 1e12 then round(v, 2) else v end as value from (select *, try_cast(case
  when contains(s, '.') and contains(s, ',') then replace(replace(s, '.', ''), ',', '.')
  when contains(s, ',') then (case when length(split_part(s, ',', -1)) = 3 and length(split_part(s, ',', 1)) <= 3 then replace(s, ',', '') else replace(s, ',', '.') end)
  when contains(s, '.') then (case when length(split_part(s, '.', -1)) = 3 and length(split_part(s, '.', 1)) <= 3 then replace(s, '.', '') else s end)
  else s end as double) as v from t)""")
def text_amounts(spark, table):
    return lenient.found_amounts(table.spread("documents"), "doc_id").select("doc_id", big("nth").alias("nth"), "raw", "value")


_RECEIPT = "'no name' || chr(10) || (case when o_orderkey % 3 = 0 then 'Casa ' || o_orderpriority || ' S.L.' else o_orderpriority end) || chr(10) || (case when o_orderkey % 2 = 0 then 'Factura N F-100' || cast(o_orderkey as string) else 'albaran' end) || chr(10) || (case when o_orderkey % 4 = 1 then '4555 **** ' || lpad(cast(o_orderkey % 10000 as string), 4, '0') else '' end)"


@query("""
select o_orderkey, case when o_orderkey % 2 = 0 then 'F-100' || cast(o_orderkey as varchar) end as number, case when o_orderkey % 4 = 1 then '4555xxxxxx' || lpad(cast(o_orderkey % 10000 as varchar), 4, '0') end as card,
  case when o_orderkey % 3 = 0 then 'Casa ' || o_orderpriority || ' S.L.' else 'no name' end as supplier from orders""")
def receipt_facts(spark, table):
    t = F.col("t")
    return table("orders").select("o_orderkey", F.expr(_RECEIPT).alias("t")).select("o_orderkey", lenient.document_number(t).alias("number"), lenient.card_mask(t).alias("card"), lenient.supplier_line(t).alias("supplier"))


@query("""
select l_orderkey, count(distinct l_returnflag) > 1 as contradictory from lineitem group by 1""")
def contradictory_total(spark, table):
    return table("lineitem").groupBy("l_orderkey").agg(lenient.contradictory(F.col("l_returnflag")).alias("contradictory"))


@query(f"""
select l_orderkey, l_linenumber, case when l_linenumber % 5 in (0, 4) then null when l_linenumber % 5 = 3 then -{_M} else {_M} end as minor from lineitem""")
def canonical_decimal(spark, table):
    text = amounts.format_amount(minor("l_extendedprice"), F.lit(2))
    n = F.col("l_linenumber") % 5
    typed = F.when(n == 0, F.replace(text, F.lit("."), F.lit(","))).when(n == 4, F.concat(text, F.lit("0"))).when(n == 3, F.concat(F.lit("-"), text)).otherwise(text)
    return table("lineitem").select("l_orderkey", "l_linenumber", amounts.parse_decimal(typed, F.lit(2)).alias("minor"))


@query(f"""
with p as (select o_orderkey, {_MINOR.format('o_totalprice')} as a, o_custkey * 1000 as b, case o_orderkey % 3 when 0 then 'EUR' else 'USD' end as ca, case o_custkey % 2 when 0 then 'EUR' else 'USD' end as cb from orders)
select o_orderkey, case when ca = cb then a + b end as plus, case when ca = cb then cast(sign(a - b) as int) end as compared from p""")
def same_currency(spark, table):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table("orders").select("o_orderkey", minor("o_totalprice").alias("a"), (c * 1000).alias("b"), F.when(k % 3 == 0, "EUR").otherwise("USD").alias("ca"), F.when(c % 2 == 0, "EUR").otherwise("USD").alias("cb"))
    both = [F.col(x) for x in ("a", "b", "ca", "cb")]
    return rows.select("o_orderkey", amounts.plus(*both).alias("plus"), amounts.compared(*both).alias("compared"))


@query(f"""
select l_orderkey, cast(sum(floor({_M} * 21 / 100)) as bigint) as tax from lineitem group by 1""")
def tax_total(spark, table):
    return table("lineitem").groupBy("l_orderkey").agg(amounts.total(F.floor(minor("l_extendedprice") * 21 / 100)).alias("tax"))


_FIELDS = "array('docDate', 'supplierName', 'grossTotal', 'currency')"
_TYPED = {
    "docDate": "case when l_linenumber % 2 = 0 then ' ' || substr(cast(l_shipdate as string), 1, 10) else substr(cast(l_shipdate as string), 1, 7) end", "supplierName": "' ' || l_returnflag || ' '",
    "grossTotal": "case when l_linenumber % 3 = 0 then '12,5' else cast(l_suppkey as string) || '.25' end", "currency": "case when l_linenumber % 2 = 0 then 'eur' else 'QQQ' end",
}


@query(f"""
with t as (select l_orderkey, l_linenumber, l_shipdate, l_returnflag, l_suppkey, l_orderkey % 3 = 0 as bare from lineitem)
select l_orderkey, l_linenumber, 'docDate' as field, case when l_linenumber % 2 = 0 then substr(cast(l_shipdate as varchar), 1, 10) end as value, case when l_linenumber % 2 = 1 then 'notADate' end as refusal from t
union all select l_orderkey, l_linenumber, 'supplierName', l_returnflag, null from t
union all select l_orderkey, l_linenumber, 'grossTotal', case when not bare and l_linenumber % 3 > 0 then cast(l_suppkey * 100 + 25 as varchar) end, case when bare then 'amountNeedsCurrency' when l_linenumber % 3 = 0 then 'notAnAmount' end from t
union all select l_orderkey, l_linenumber, 'currency', case when l_linenumber % 2 = 0 then 'EUR' end, case when l_linenumber % 2 = 1 then 'unknownCurrency' end from t""")
def review_edit(spark, table):
    typed = F.array(*[F.struct(F.lit(f).alias("field"), F.expr(t).alias("typed")) for f, t in _TYPED.items()])
    rows = table("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 3 != 0, "EUR").alias("currency"), F.explode(typed).alias("e"))
    done = review.edit(F.col("e.field"), F.col("e.typed"), F.col("currency"))
    return rows.select("l_orderkey", "l_linenumber", "e.field", done.alias("d")).select("l_orderkey", "l_linenumber", "field", "d.*")


_STATE = "case l_linenumber % 3 when 0 then 'absent' when 1 then 'present' else 'edited' end"
_SHADE = "case when l_suppkey % 2 = 0 then 'green' else 'red' end"


@query(f"""
select l_orderkey, l_linenumber, case when s <> 'absent' then l_returnflag end as text, case s when 'absent' then 'red' when 'edited' then 'green' else c end as colour, s = 'edited' as edited, case when s = 'present' then 'read' end as source
from (select *, {_STATE} as s, {_SHADE} as c from lineitem)""")
def review_shown(spark, table):
    shown = review.shown(F.expr(_STATE), F.col("l_returnflag"), F.expr(_SHADE), F.lit("read"))
    return table("lineitem").select("l_orderkey", "l_linenumber", shown.alias("s")).select("l_orderkey", "l_linenumber", "s.*")


@query(f"""
with s as (select l_orderkey, l_linenumber as n, {_STATE} = 'absent' or {_STATE} = 'present' and l_suppkey % 2 = 1 as open from lineitem)
select l_orderkey, cast(coalesce(min(n) filter (open), min(n)) as bigint) as focus from s group by 1""")
def focus_field(spark, table):
    one = review.shown(F.expr(_STATE), F.col("l_returnflag"), F.expr(_SHADE), F.lit("read"))
    rows = table("lineitem").select("l_orderkey", F.col("l_linenumber").alias("no"), one.alias("s"))
    fields = F.collect_list(F.struct("no", F.col("no").alias("field"), "s.text", "s.colour"))
    return rows.groupBy("l_orderkey").agg(fields.alias("f")).select("l_orderkey", big(review.focus(F.col("f"))).alias("focus"))


@query(f"""
select l_orderkey, l_linenumber, l_suppkey % 2 = 0 and l_linenumber % 2 = 0 as collapsed from lineitem""")
def amounts_collapsed(spark, table):
    base, tax = minor("l_extendedprice"), big("l_suppkey")
    shut = review.collapsed(F.array(F.lit("green"), F.expr(_SHADE)), base, tax, base + tax + F.col("l_linenumber") % 2)
    return table("lineitem").select("l_orderkey", "l_linenumber", shut.alias("collapsed"))


@query("""
select o_custkey, case when count(*) = 1 then min(o_orderkey) when bool_or(o_orderkey = o_custkey * 4) then o_custkey * 4 end as choice from orders group by 1""")
def auto_choice(spark, table):
    return table("orders").groupBy("o_custkey").agg(review.choice(F.col("o_orderkey"), F.col("o_custkey") * 4).alias("choice"))


@query("""
select c_custkey, c_custkey in (select o_custkey from orders) as mapped from customer""")
def mapped_fields(spark, table):
    return review.mapped(table("customer").select("c_custkey"), table("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


_TERM_VALUES = ", ".join(f"('{kind}', '{term}')" for kind, term in dict.fromkeys((k, t) for k, _, t, _ in dims.LABELS))


@query(f"""
with t as (select * from (values {_TERM_VALUES}) t(kind, term)), f as (select p_partkey, p_name as field, case p_partkey % 4 when 0 then 'total' when 1 then 'base' when 2 then 'date' else 'other' end as kind from part)
select distinct f.field, coalesce(t.term, f.field) as synonym from f left join t using (kind)""")
def field_synonyms(spark, table):
    kind = F.expr("case p_partkey % 4 when 0 then 'total' when 1 then 'base' when 2 then 'date' else 'other' end")
    return review.synonyms(table("part").select(F.col("p_name").alias("field"), kind.alias("kind")), dims.terms(spark))


@query("""
select conv_id, count(*) filter (role = 'user') as n, case count(*) filter (role = 'user') when 0 then 'refuseNone' when 1 then 'store' else 'refuseSeveral' end as decision from conversations group by 1""")
def shared_batch(spark, table):
    n = F.count(F.when(F.col("role") == "user", 1))
    return table("conversations").groupBy("conv_id").agg(n.alias("n"), review.intake_decision(n).alias("decision"))


_URL = "case page_id % 5 when 0 then url when 1 then 'https://Host-' || cast(page_id as string) || '.example:8443' when 2 then 'https://user@h.example' when 3 then 'https://h' || cast(page_id as string) || '.example/' else 'https://h.example:' || cast(page_id * 1000 as string) end"


@query("""
with u as (select page_id, case page_id % 5 when 0 then url when 1 then 'https://Host-' || cast(page_id as varchar) || '.example:8443' when 2 then 'https://user@h.example' when 3 then 'https://h' || cast(page_id as varchar) || '.example/' else 'https://h.example:' || cast(page_id * 1000 as varchar) end as url from pages),
p as (select page_id, regexp_extract(url, '^https://([A-Za-z0-9][A-Za-z0-9.-]*)(?::([0-9]{1,5}))?/?$', ['host', 'port']) as e, regexp_matches(url, '^https://([A-Za-z0-9][A-Za-z0-9.-]*)(?::([0-9]{1,5}))?/?$') as ok from u),
q as (select page_id, lower(e.host) as host, coalesce(try_cast(nullif(e.port, '') as int), 443) as port, ok from p)
select page_id, case when ok and port between 1 and 65535 then host end as host, case when ok and port between 1 and 65535 then port end as port from q""")
def endpoint_host(spark, table):
    return table("pages").select("page_id", review.endpoint(F.expr(_URL)).alias("e")).select("page_id", "e.host", "e.port")


@query("""
select doc_id, doc_id % 2 = 0 as discards from documents""")
def capture_discard(spark, table):
    name = F.md5(F.col("doc_id").cast("string"))
    return table("documents").select("doc_id", review.may_discard(F.when(F.col("doc_id") % 2 == 0, name).otherwise(F.concat(F.lit("../"), name))).alias("discards"))


@query("""
with w as (select user_id, event_id, event_id * 7 % 50 + 1 as revision from events)
select user_id, event_id, cast(revision as bigint) as revision, revision > coalesce(max(revision) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as accepted from w""")
def versioned_writes(spark, table):
    writes = table("events").select("user_id", "event_id", big(F.col("event_id") * 7 % 50 + 1).alias("revision"))
    return entries.accepted_writes(writes, "user_id", ["event_id"])


@query("""
with w as (select user_id, event_id, event_id * 7 % 50 + 1 as revision from events)
select user_id, event_id, cast(revision as bigint) as revision from w qualify row_number() over (partition by user_id order by revision desc, event_id) = 1""")
def latest_revision(spark, table):
    writes = table("events").select("user_id", "event_id", big(F.col("event_id") * 7 % 50 + 1).alias("revision"))
    return entries.latest(writes, "user_id", ["event_id"])


@query("""
select user_id, count(*) as n, string_agg(event_type, '>' order by ts, event_id) as steps from events group by 1""")
def step_journal(spark, table):
    return entries.journal(table("events"), "user_id", ["ts", "event_id"], "event_type")


@query("""
with f as (select text, min(doc_id) as first from documents where text is not null group by 1)
select d.doc_id, case when f.first < d.doc_id then f.first end as original, coalesce(f.first < d.doc_id, false) as duplicate, 1 + cast(coalesce(f.first < d.doc_id, false) as int) as revision from documents d left join f using (text)""")
def duplicate_flag(spark, table):
    return entries.flag_duplicates(table("documents").select("doc_id", F.sha2("text", 256).alias("hash")), "doc_id", "hash")


@query("""
select doc_id, doc_id % 7 > 0 as readable, case when doc_id % 7 > 0 then lang end as lang, case when doc_id % 7 > 0 then cast(n_chars as bigint) end as n_chars from documents""")
def history_listing(spark, table):
    body = F.to_json(F.struct("lang", F.col("n_chars").cast("long").alias("n_chars")))
    stored = table("documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("{"), body)).otherwise(body).alias("body"))
    return entries.listing(stored, "lang string, n_chars long", "doc_id", "body")


@query("""
select o_orderkey, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as newest, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as oldest from orders""")
def history_order(spark, table):
    return entries.places(table("orders"), "o_custkey", "o_orderkey", "o_orderdate").select("o_orderkey", big("newest").alias("newest"), big("oldest").alias("oldest"))


@query("""
with f as (select l_orderkey, l_linenumber % 3 as page, l_returnflag as v from lineitem qualify row_number() over (partition by l_orderkey, l_linenumber % 3 order by l_suppkey % 2, l_linenumber, l_returnflag) = 1)
select l_orderkey, case when min(v) = max(v) then min(v) end as flag, count(*) as pages from f group by 1""")
def page_reconcile(spark, table):
    rows = table("lineitem").select("l_orderkey", F.expr("l_linenumber % 3").alias("page"), "l_linenumber", F.expr("l_suppkey % 2 = 0").alias("same"), F.col("l_returnflag").alias("flag"))
    return entries.page_readings(rows, "l_orderkey", "page", "l_linenumber", "same", "flag")


@query("""
select conv_id, string_agg(coalesce(text, ''), chr(10) order by turn, coalesce(text, '')) as text from conversations group by 1""")
def pages_joined(spark, table):
    return entries.page_text(table("conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text")), "conv_id", "turn", "text")


_STAGE = "case l_linenumber % 4 when 0 then 'bound' when 1 then 'voted' when 2 then 'solved' else 'refused' end"


@query(f"""
select l_returnflag as field, {_STAGE} as stage, count(*) as n from lineitem group by rollup (1, 2)""")
def trace_stages(spark, table):
    return entries.stage_counts(table("lineitem").select(F.col("l_returnflag").alias("field"), F.expr(_STAGE).alias("stage")))


@query("""
select 'gross' as field, l_returnflag as state, count(*) as n from lineitem group by 2 union all select 'net', l_linestatus, count(*) from lineitem group by 2""")
def field_states(spark, table):
    rows = table("lineitem").select("l_orderkey", F.col("l_returnflag").alias("gross"), F.col("l_linestatus").alias("net"))
    return entries.state_summary(rows, ["gross", "net"], "l_orderkey")


_HINT = "case word_no % 4 when 0 then 'tip' when 2 then 'service_charge' end"


@query(f"""
with {_WORDS_SQL}, t as (select *, {_HINT} as hint, word_no // 3 as line from w where word_no % 2 = 0), f as (select *, word_no // 3 as line from w where word_no % 2 = 1),
m as (select t.doc_id, t.word_no as term_no, t.hint, f.word_no as figure_no, power(greatest(greatest(f.x0, t.x0) - least(f.x1, t.x1), 0), 2) + power(greatest(greatest(f.top, t.top) - least(f.bottom, t.bottom), 0), 2) as far, t.line = f.line as same from t join f using (doc_id)),
b as (select * from m where same or far <= 4000 * 4000 qualify row_number() over (partition by doc_id, term_no order by far, figure_no) = 1)
select doc_id, cast(term_no as bigint) as term_no, hint, cast(figure_no as bigint) as figure_no, cast(figure_no * 100 as bigint) as value from b qualify row_number() over (partition by doc_id, figure_no order by term_no) = 1""")
def surcharge_capture(spark, table):
    words = order_words(table).withColumn("line_no", F.expr("word_no div 3")).withColumn("no", big("word_no"))
    terms = words.filter("word_no % 2 = 0").withColumn("hint", F.expr(_HINT)).withColumnRenamed("no", "term_no")
    figures = words.filter("word_no % 2 = 1").withColumn("value", F.col("no") * 100).withColumnRenamed("no", "figure_no")
    return entries.surcharges(terms, figures, "doc_id", 4000)


_LINE_WORDS = "case l_partkey % 6 when 0 then '28013 Madrid' when 1 then 'ESPAÑA' when 2 then 'Deutschland,' when 3 then 'tel 915550000' when 4 then l_returnflag else 'DE123456789' end"


@query(f"""
with l as (select l_orderkey, l_linenumber * 10000000 + l_partkey as n, l_partkey % 6 as p from lineitem),
a as (select *, p = 0 or coalesce(lag(p) over w = 0, false) or coalesce(lead(p) over w = 0, false) as near from l window w as (partition by l_orderkey order by n)),
c as (select l_orderkey, bool_or(p = 5) as strong, bool_or(near and p = 1) as es, bool_or(near and p = 2) as de from a group by 1)
select l_orderkey, case when strong then 'DE' when es and not de then 'ES' when de and not es then 'DE' end as country, case when strong or (es <> de) then null else 'noEvidence' end as reason from c""")
def country_detect(spark, table):
    lines = table("lineitem").select("l_orderkey", F.expr("l_linenumber * 10000000 + l_partkey").alias("line_no"), F.split(F.expr(_LINE_WORDS), " ").alias("words"))
    return country.detect(lines, ["l_orderkey"], "l_orderkey")


_ANSWER = "case l_suppkey % 4 when 0 then 'ES' when 1 then 'ES' when 2 then 'DE' end"


@query(f"""
with a as (select l_orderkey, case when l_linenumber % 3 > 0 then coalesce('=' || ({_ANSWER}), 'noEvidence') end as a from lineitem)
select l_orderkey, case when count(distinct a) = 1 and min(a) like '=%' then substr(min(a), 2) end as country,
  case when count(a) = 0 then 'noEvidence' when count(distinct a) > 1 then 'conflictingEvidence' when min(a) not like '=%' then min(a) end as reason from a group by 1""")
def country_passes(spark, table):
    found = country.across_passes(F.expr(_ANSWER), F.lit("noEvidence"), F.col("l_linenumber") % 3 > 0)
    return table("lineitem").groupBy("l_orderkey").agg(found.alias("d")).select("l_orderkey", "d.*")


@query(f"""
select l_orderkey, case when count(*) filter (l_linenumber % 2 = 0) = 1 then min({_M}) filter (l_linenumber % 2 = 0) end as amount from lineitem group by 1""")
def single_amount(spark, table):
    return table("lineitem").groupBy("l_orderkey").agg(entries.only_amount(F.when(F.col("l_linenumber") % 2 == 0, minor("l_extendedprice"))).alias("amount"))


@query("""
with p as (select l_orderkey, l_linenumber, cast(l_quantity as bigint) % 5 as size from lineitem), t as (select l_orderkey, count(distinct l_linenumber) as among, min(l_linenumber) as one from (select *, rank() over (partition by l_orderkey order by size desc) as r from p where size >= 2) where r = 1 group by 1)
select l_orderkey, case when among = 1 then one end as choice, cast(among as bigint) as among from t""")
def attachment_choice(spark, table):
    parts = table("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("bigint") % 5).alias("size"))
    return entries.attachments(parts, "l_orderkey", "l_linenumber", "size", 2).select("l_orderkey", "choice", big("among").alias("among"))


@query(f"""
with r as (select lpad(cast(c_custkey as varchar), 8, '0') || substr('{identifiers.NIF_LETTERS}', cast((c_custkey + (case when c_custkey % 3 = 0 then 1 else 0 end)) % 23 as int) + 1, 1) as tax_id, c_custkey, o_orderkey, o_orderdate, o_orderpriority as name, o_orderkey % 2 = 0 as learned from orders join customer on o_custkey = c_custkey)
select tax_id, arg_max(name, (o_orderdate, o_orderkey)) as name from r where learned and c_custkey % 3 > 0 group by 1""")
def supplier_memory(spark, table):
    k = F.col("o_custkey")
    letter = F.substring(F.lit(identifiers.NIF_LETTERS), ((k + F.when(k % 3 == 0, 1).otherwise(0)) % 23 + 1).cast("int"), F.lit(1))
    rows = table("orders").select(F.concat(F.lpad(k.cast("string"), 8, "0"), letter).alias("tax_id"), "o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("name"))
    return entries.supplier_memory(rows, "tax_id", identifiers.nif_valid(F.col("tax_id")), "name", F.col("o_orderkey") % 2 == 0, ["o_orderdate", "o_orderkey"])


@query("""
with a as (select distinct doc_id from documents where lang is not null), b as (select distinct doc_id from labels)
select doc_id, 'found' as missing from (select * from a except select * from b) union all select doc_id, 'expected' from (select * from b except select * from a)""")
def missing_keys(spark, table):
    return entries.missing_both_ways(table("documents").filter("lang is not null"), table("labels"), "doc_id")


@query("""
with l as (select l_orderkey, count(*) as files, sum(l_quantity) as q from lineitem group by 1),
w as (select o_orderkey, list_filter([case when l.files is null then 'noRecord' end, case when l.files = 1 then 'noFile' end, case when l.files is not null and o_orderkey % 9 = 0 then 'noDate' end,
  case when l.files is not null and o_orderkey % 11 = 0 then 'zeroAmount' end, case when l.files is not null and o_orderkey % 4 = 0 then 'unverified' end], lambda x: x is not null) as w from orders left join l on l_orderkey = o_orderkey)
select o_orderkey, array_to_string(w, ',') as warnings from w""")
def read_back(spark, table):
    files = table("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("files"))
    met = table("orders").join(files, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    k = F.col("o_orderkey")
    said = lenient.warnings(F.col("files").isNotNull(), F.coalesce(F.col("files") > 1, F.lit(False)), F.when(k % 9 > 0, F.col("o_orderdate")), F.when(k % 11 > 0, F.col("o_totalprice")), k % 4 > 0)
    return met.select("o_orderkey", F.array_join(said, ",").alias("warnings"))


@query("""
with e as (select event_id, user_id, ts, event_type, event_id % 5 as a, event_id % 3 as b from events)
select s.event_id, count(r.ts) as candidates from (select * from e where event_type = 'purchase') s left join (select * from e where event_type = 'signup') r
  on r.user_id = s.user_id and r.ts <= s.ts and r.ts >= s.ts - interval 2 hours and (r.a = s.a or r.b = s.b) group by 1""")
def reconcile_any_field(spark, table):
    e = table("events").withColumn("f", F.create_map(F.lit("a"), F.col("event_id") % 5, F.lit("b"), F.col("event_id") % 3))
    s, r = e.filter("event_type = 'purchase'"), e.filter("event_type = 'signup'").select(F.col("user_id").alias("u"), F.col("ts").alias("made"), F.col("f").alias("g"))
    inside = (F.col("user_id") == F.col("u")) & (F.col("made") <= F.col("ts")) & (F.col("made") >= F.col("ts") - F.expr("interval 2 hours")) & lenient.any_field_equal(F.col("f"), F.col("g"))
    return s.join(r, inside, "left").groupBy("event_id").agg(F.count("made").alias("candidates"))


@query("""
select count(*) as documents, avg(case when l_linenumber % 4 > 0 then 1.0 else 0 end) as untouched, avg(case when l_suppkey % 2 = 0 then 1.0 else 0 end) as green,
  avg(case when l_linenumber % 3 = 0 then 1.0 else 0 end) as abstained, median(l_quantity) as taps from lineitem""")
def product_metrics(spark, table):
    rows = table("lineitem")
    return evaluation.product_metrics(rows, F.col("l_linenumber") % 4 == 0, F.col("l_suppkey") % 2 == 0, F.col("l_linenumber") % 3 == 0, F.col("l_quantity"))


@query(f"""
select o_orderkey, 'F-' || o_orderkey as number, 'EUR' as currency, {_MINOR.format('o_totalprice')} as gross from orders""")
def einvoice_xml(spark, table):
    total = amounts.format_amount(minor("o_totalprice"), F.lit(2))
    xml = F.concat(F.lit('<Invoice><ID>F-'), F.col("o_orderkey").cast("string"), F.lit('</ID><LegalMonetaryTotal><PayableAmount currencyID="EUR">'), total, F.lit("</PayableAmount></LegalMonetaryTotal></Invoice>"))
    read = heuristics.einvoice(table("orders").select("o_orderkey", xml.alias("xml")), "o_orderkey", "xml")
    return read.select("o_orderkey", "number", "currency", amounts.parse_decimal(F.col("gross"), F.lit(2)).alias("gross"))


@query("""
select s_suppkey, substr(s_name || '/' || cast(s_nationkey as varchar), 1, length(s_name)) as label from supplier""")
def route_base(spark, table):
    return table("supplier").select("s_suppkey", fields.route_base(F.concat_ws("/", "s_name", F.col("s_nationkey").cast("string"))).alias("label"))


@query("""
with m as (select l_orderkey, l_linenumber % 3 as start, l_returnflag as term, l_linenumber from lineitem)
select l_orderkey, string_agg(term, ',' order by start, length(term) desc, term, l_linenumber) as matches from m group by 1""")
def match_order(spark, table):
    rows = table("lineitem").select("l_orderkey", F.struct((F.col("l_linenumber") % 3).alias("start"), (-F.length("l_returnflag")).alias("n"), F.col("l_returnflag").alias("term"), "l_linenumber").alias("m"))
    return rows.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["term"]), ",").alias("matches"))


@query("""
select doc_id, page from (select doc_id, n_chars % 3 as page from documents where n_chars is not null union select doc_id, doc_id % 4 from labels)""")
def page_union(spark, table):
    a = table("documents").filter("n_chars is not null").select("doc_id", (F.col("n_chars") % 3).cast("bigint").alias("page"))
    return entries.pages_of_both(a, table("labels").select("doc_id", (F.col("doc_id") % 4).cast("bigint").alias("page")), "doc_id", "page")


@query("""
select l_orderkey, array_to_string(list(l_returnflag order by l_extendedprice desc, l_linenumber, l_returnflag)[1:3], ',') as best from lineitem group by 1""")
def top_candidates(spark, table):
    found = entries.best_of(table("lineitem"), "l_orderkey", [F.desc("l_extendedprice"), F.col("l_linenumber"), F.col("l_returnflag")], "l_returnflag", 3)
    return found.select("l_orderkey", F.array_join("best", ",").alias("best"))


@query("""
select o_orderkey, o_totalprice <> l.total as differs from orders join (select l_orderkey, sum(l_extendedprice) as total from lineitem group by 1) l on l_orderkey = o_orderkey""")
def total_contrast(spark, table):
    formula = table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("formula"))
    return evaluation.contrast(table("orders"), formula, "o_orderkey", "o_totalprice", "formula")


#: Figures of a line as receipts print them, in cents: net, and 21 % of it.
_NET, _VAT = f"cast({_M} as bigint)", f"cast(floor(({_M} * 21 + 50) / 100) as bigint)"
_PRINTED = "cast(cast(floor({0} / 100) as bigint) as string) || ',' || lpad(cast({0} % 100 as string), 2, '0')"


def _receipts(table, text: str):
    """Lines of orders with lines, the tokens of a receipt; n, v and g in ``text`` are net, tax and total as printed."""
    rows = table("lineitem").select("l_orderkey", "l_linenumber", F.expr(_NET).alias("_n"), F.expr(_VAT).alias("_v")).withColumn("_g", F.expr("_n + _v"))
    rows = rows.withColumns({c: F.expr(_PRINTED.format(f"_{c}")) for c in "nvg"})
    return rows.select("l_orderkey", "l_linenumber", photo.tokens(F.expr(text)).alias("lines"))


@query(f"""
select l_orderkey, l_linenumber, case when k < 2 then n / 100.0 end::double as net, case when k < 2 then v / 100.0 end::double as vat, case k when 0 then (n + v) / 100.0 end::double as gross, case when k < 2 then 21.0 end::double as rate
from (select l_orderkey, l_linenumber, l_linenumber % 4 as k, {_NET} as n, {_VAT} as v from lineitem)""")
def percent_row(spark, table):
    text = "case l_linenumber % 4 when 0 then 'IVA 33 % ' || n || chr(10) || '21 % ' || n || ' ' || v || ' ' || g when 1 then n || ' ' || v || ' 21,00%' when 2 then '21 % ' || n || ' ' || n else n || ' ' || v || ' ' || g end"
    row = photo.percent_row(F.col("lines"), dims.COUNTRIES["ES"]["rates"])
    return _receipts(table, text).select("l_orderkey", "l_linenumber", row.alias("r")).select("l_orderkey", "l_linenumber", *[F.col("r")[c].cast("double").alias(c) for c in ("net", "vat", "gross", "rate")])


@query(f"""
select l_orderkey, l_linenumber, case when k <> 2 then n / 100.0 end::double as net, case when k < 2 then v / 100.0 end::double as vat, case when k < 2 then 21.0 when k = 3 then 10.0 end::double as rate
from (select l_orderkey, l_linenumber, l_linenumber % 4 as k, {_NET} as n, {_VAT} as v from lineitem)""")
def header_table(spark, table):
    text = "case l_linenumber % 4 when 0 then 'BASE TIPO CUOTA' || chr(10) || n || ' 21,00 X ' || v when 1 then 'IVA BASE % IVA TOTAL' || chr(10) || 'A B C 21,00 ' || n || ' ' || v when 2 then 'BASE IVA' || chr(10) || n || ' A B C D ' || v else 'BASE IVA' || chr(10) || n || ' 10,00' end"
    found = photo.header_tables(_receipts(table, text), dims.COUNTRIES["ES"]["rates"])
    return found.select("l_orderkey", "l_linenumber", *[F.col(f"t_{c}").cast("double").alias(c) for c in ("net", "vat", "rate")])


@query("""
select p_partkey, w as width, h as height, case when o between 1 and 8 then o end as orientation, case when o between 5 and 8 then h else w end as shown_width, case when o between 5 and 8 then w else h end as shown_height
from (select p_partkey, cast(p_partkey % 60000 + 1 as int) as w, cast(p_size as int) as h, cast(p_partkey % 10 as int) as o from part)""")
def image_sides(spark, table):
    """JPEG headers made from parts (a fill byte, an EXIF segment of either byte order, a frame), read back."""
    short = lambda c: f"lpad(hex(cast({c} as bigint)), 4, '0')"
    tag = short("p_partkey % 10")
    exif = f"case when p_partkey % 2 = 0 then '4D4D002A00000008' || '0001' || '0112' || '0003' || '00000001' || {tag} || '0000' else '49492A0008000000' || '0100' || '1201' || '0300' || '01000000' || substr({tag}, 3, 2) || substr({tag}, 1, 2) || '0000' end"
    made = f"unhex('FFD8FF' || 'FFE1' || '001E' || '457869660000' || {exif} || 'FFC0' || '000B' || '08' || {short('p_size')} || {short('p_partkey % 60000 + 1')} || '01011100')"
    read = image_header.with_header(table("part").select("p_partkey", F.expr(made).alias("content")))
    shown = files.shown_size(F.col("orientation"), F.col("width"), F.col("height"))
    return read.select("p_partkey", "width", "height", "orientation", shown["width"].alias("shown_width"), shown["height"].alias("shown_height"))
