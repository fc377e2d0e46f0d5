"""Queries of adjudication, dates in running text, e-invoices, labels, probes, rounding and a remote table."""

from __future__ import annotations

import json
import uuid
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import functions as F

from quillstone.functions import amounts, dims
from quillstone.functions.text import label_normalised
from quillstone.operators import adjudicate, einvoices, entries, evaluation, lenient, loading, records, solver
from quillstone.plans import record
from quillstone.plans.catalogue import _MINOR, big, minor, query
from quillstone.plans.catalogue_record import _CENTS, _amounts, _eur, invoice_pages
from quillstone.sources import files, settings
from quillstone.sources.remote_service import RemoteTable
from quillstone.sources.shared import shared_dir

_TWO = "round({}, 2)"
_SPLIT_NET = _TWO.format("g / 100.0::double / (1 + 21.0::double / 100)")


@query(f"""
with o as ({_CENTS}), s as (select *, k % 8 as shape, g / 100.0::double as gd, b / 100.0::double as bd, t / 100.0::double as td, (t + 500) / 100.0::double as odd, {_SPLIT_NET} as net from o)
select k as o_orderkey, case shape when 0 then gd when 1 then gd when 2 then gd when 3 then round(bd + round(bd * 21 / 100, 2), 2) when 4 then gd when 5 then gd when 6 then gd end as gross,
  case shape when 0 then 'label' when 1 then 'label' when 2 then 'label' when 3 then 'derived' when 4 then 'label' when 5 then 'currency_marked' when 6 then 'max_any' end as gross_method,
  case shape when 0 then bd when 1 then net when 2 then bd when 3 then bd end as net, case shape when 0 then 'label+arithmetic' when 1 then 'derived_from_gross' when 2 then 'label_incoherent' when 3 then 'label' end as net_method,
  case shape when 0 then td when 1 then round(gd - net, 2) when 2 then odd when 3 then round(bd * 21 / 100, 2) end as tax, case shape when 0 then 'label+arithmetic' when 1 then 'derived_from_gross' when 2 then 'label_incoherent' when 3 then 'derived_rate' end as tax_method,
  case shape when 0 then 'confirmed' when 1 then 'derived' when 2 then 'incoherent' when 3 then 'derived' when 4 then 'read' when 5 then 'read' when 6 then 'read_weak' else 'missing' end as state,
  case when shape in (0, 1, 3) then 21.0::double end as rate, 'EUR' as currency from s""")
def adjudication(spark, table):
    """Amounts of eight kinds of printed text, each settled by another stage."""
    shape = lambda n: F.col("k") % 8 == n
    text = (
        F.when(shape(0), F.concat(F.lit("BASE "), _eur("b"), F.lit("\nIVA 21% "), _eur("t"), F.lit("\nTOTAL "), _eur("g")))
        .when(shape(1), F.concat(F.lit("IVA 21%\nTOTAL\n\n01/02/2024\n"), _eur("g")))
        .when(shape(2), F.concat(F.lit("BASE "), _eur("b"), F.lit("\nCUOTA "), _eur("(t + 500)"), F.lit("\nTOTAL "), _eur("g")))
        .when(shape(3), F.concat(F.lit("BASE "), _eur("b"), F.lit("\n21,00 %")))
        .when(shape(4), F.concat(F.lit("TOTAL "), _eur("g"), F.lit("\nTOTAL 5,00 TERMINAL 44")))
        .when(shape(5), F.concat(F.lit("pagado "), _eur("g"), F.lit(" EUR\ncambio 1 EUR = 9,99 USD")))
        .when(shape(6), F.concat(F.lit("Ref 123456\ncosas "), _eur("g"), F.lit("\notra 0,07"))).otherwise("nada")
    )
    found = adjudicate.adjudicate(_amounts(table).select(F.col("k").alias("o_orderkey"), text.alias("text")), "o_orderkey")
    return found.select("o_orderkey", "gross", "gross_method", "net", "net_method", "tax", "tax_method", "state", "rate", "currency")


_MONTH = ["ene", "FEB", "mar", "abr", "may", "jun", "jul", "aug", "sept", "oct", "nov", "dic"]


@query(f"""
with e as (select event_id, cast(ts as date) as day, event_id % 4 as form from events), m as (select *, ({_MONTH})[cast(month(day) as int)] as name from e)
select event_id, cast(case form when 3 then null else form end as bigint) as form, case form when 0 then day(day) || '/' || name || '/' || year(day) % 100 when 1 then day(day) || '.' || month(day) || '.' || year(day) else cast(day as varchar) end as raw, day from m where form < 3""")
def text_dates(spark, table):
    """Dates in running text in three forms; days that are none, and years beyond this century, are passed over."""
    month = F.element_at(F.array(*map(F.lit, _MONTH)), F.month("ts"))
    text = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("el "), F.dayofmonth("ts"), F.lit("/"), month, F.lit("/"), (F.year("ts") % 100).cast("string"), F.lit(" o 31.02.2024")))
        .when(F.col("event_id") % 4 == 1, F.concat(F.dayofmonth("ts"), F.lit("."), F.month("ts"), F.lit("."), F.year("ts"), F.lit(" y 1/13/1999")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit("de "), F.date_format("ts", "yyyy-MM-dd"))).otherwise("sin fecha 12")
    )
    found = lenient.found_dates(table("events").select("event_id", text.alias("text")), "event_id")
    return found.select("event_id", big("form").alias("form"), "raw", "day")


def _invoice_xml(k, number, day, total, net, tax):
    """UBL with a prefix for even keys, CII for odd ones; every fifth is of a profile without tax lines, net and supplier's number."""
    full = k % 5 > 0
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    some = lambda value: F.when(full, value).otherwise("")
    lit = F.lit
    ubl = F.concat(
        lit(f'<?xml version="1.0"?><u:Invoice xmlns:u="{einvoices.UBL}Invoice-2" xmlns:c="urn:oasis:names:specification:ubl:schema:xsd:CommonBasicComponents-2">'), tag("c:ID", number), tag("c:IssueDate", day), tag("c:DocumentCurrencyCode", lit("EUR")),
        lit("<u:AccountingSupplierParty><u:Party>"), some(lit("<u:PartyTaxScheme><c:CompanyID>ESB1</c:CompanyID></u:PartyTaxScheme>")), lit("<u:PartyLegalEntity><c:RegistrationName>Casa</c:RegistrationName></u:PartyLegalEntity></u:Party></u:AccountingSupplierParty>"),
        lit("<u:TaxTotal>"), tag("c:TaxAmount", tax), some(F.concat(lit("<u:TaxSubtotal>"), tag("c:TaxableAmount", net), tag("c:TaxAmount", tax), lit("<u:TaxCategory><c:Percent>21</c:Percent></u:TaxCategory></u:TaxSubtotal>"))), lit("</u:TaxTotal>"),
        lit("<u:LegalMonetaryTotal>"), some(tag("c:TaxExclusiveAmount", net)), tag("c:PayableAmount", total), lit("</u:LegalMonetaryTotal></u:Invoice>"),
    )
    cii = F.concat(
        lit(f'<r:CrossIndustryInvoice xmlns:r="{einvoices.CII}100" xmlns="urn:un:unece:uncefact:data:standard:ReusableAggregateBusinessInformationEntity:100"><ExchangedDocument>'), tag("ID", number), lit("<IssueDateTime>"), tag("DateTimeString", F.replace(day, lit("-"), lit(""))), lit("</IssueDateTime></ExchangedDocument><SupplyChainTradeTransaction>"),
        lit("<ApplicableHeaderTradeAgreement><SellerTradeParty><Name>Casa</Name>"), some(lit("<SpecifiedTaxRegistration><ID>ESB1</ID></SpecifiedTaxRegistration>")), lit("</SellerTradeParty></ApplicableHeaderTradeAgreement><ApplicableHeaderTradeSettlement><InvoiceCurrencyCode>EUR</InvoiceCurrencyCode>"),
        some(F.concat(lit("<ApplicableTradeTax>"), tag("CalculatedAmount", tax), tag("BasisAmount", net), lit("<RateApplicablePercent>21</RateApplicablePercent></ApplicableTradeTax>"))), lit("<SpecifiedTradeSettlementHeaderMonetarySummation>"), some(tag("TaxBasisTotalAmount", net)),
        tag("TaxTotalAmount", tax), tag("GrandTotalAmount", total), lit("</SpecifiedTradeSettlementHeaderMonetarySummation></ApplicableHeaderTradeSettlement></SupplyChainTradeTransaction></r:CrossIndustryInvoice>"),
    )
    return F.when(k % 11 == 0, "<Invoice><ID>").when(k % 13 == 0, "<Order/>").when(k % 2 == 0, ubl).otherwise(cii)




@query(f"""
with o as ({_CENTS}), s as (select *, case when k % 11 = 0 or k % 13 = 0 then null when k % 2 = 0 then 'Invoice' else 'CrossIndustryInvoice' end as shape, k % 5 > 0 as full_ from o),
x as (select *, (g // 100) || '.' || lpad(cast(g % 100 as varchar), 2, '0') as gt, (b // 100) || '.' || lpad(cast(b % 100 as varchar), 2, '0') as bt, (t // 100) || '.' || lpad(cast(t % 100 as varchar), 2, '0') as tt from s)
select k as o_orderkey, shape, case when shape is not null then 'F-' || k end as doc_number, case shape when 'Invoice' then cast(day as varchar) when 'CrossIndustryInvoice' then strftime(day, '%Y%m%d') end as doc_date, case when shape is not null then 'EUR' end as currency,
  case when shape is not null and full_ then 'ESB1' end as supplier_tax_id, case when shape is not null then case when full_ then 'present' else 'not_in_xml' end end as tax_id_state, case when shape is not null and full_ then bt end as net, case when shape is not null then case when full_ then 'present' else 'not_in_xml' end end as net_state,
  case when shape is not null then tt end as tax, case when shape is not null then gt end as gross, case when shape is not null then case when full_ then '21:' || bt || ':' || tt else '' end end as tax_lines from x""")
def einvoice_shapes(spark, table):
    """E-invoices of two shapes and two profiles, some malformed or of no known shape; a field that a profile lacks says so."""
    text = lambda c: amounts.format_amount(F.col(c), F.lit(2))
    xml = _invoice_xml(F.col("k"), F.concat(F.lit("F-"), F.col("k").cast("string")), F.date_format("day", "yyyy-MM-dd"), text("g"), text("b"), text("t"))
    read = einvoices.read(_amounts(table).select(F.col("k").alias("o_orderkey"), xml.alias("xml")), "o_orderkey", "xml")
    lines = F.array_join(F.transform("tax_lines", lambda x: F.concat_ws(":", x["rate"], x["base"], x["amount"])), "|")
    return read.select(
        "o_orderkey", "shape", F.col("doc_number.value").alias("doc_number"), F.col("doc_date.value").alias("doc_date"), F.col("currency.value").alias("currency"), F.col("supplier_tax_id.value").alias("supplier_tax_id"), F.col("supplier_tax_id.state").alias("tax_id_state"),
        F.col("net_total.value").alias("net"), F.col("net_total.state").alias("net_state"), F.col("tax_total.value").alias("tax"), F.col("gross_total.value").alias("gross"), lines.alias("tax_lines"),
    )


@query(r"""
select doc_id, regexp_replace(replace(lower(strip_accents(split_part(trim(text), ' ', 1))), 'ß', 'ss'), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') as label from documents""")
def label_words(spark, table):
    """The first word of each document as labels are compared."""
    return table("documents").select("doc_id", label_normalised(F.split_part(F.trim("text"), F.lit(" "), F.lit(1))).alias("label"))


@query(f"""
with m as (select l_orderkey as o_orderkey, case when l_linenumber % 2 = 0 then {_MINOR.format('l_extendedprice')} end as cents from lineitem where l_linenumber > 1),
t as (select o_orderkey, case when o_orderkey % 4 = 0 then null when o_orderkey % 4 = 1 then (select max(cents) from m where m.o_orderkey = orders.o_orderkey) else 1 end as confirmed from orders),
c as (select t.o_orderkey, confirmed, count(m.o_orderkey) as n, count(*) filter (cents = confirmed) as hit from t left join m using (o_orderkey) group by 1, 2)
select o_orderkey, case when confirmed is null then 'not probed' when n = 0 then 'no label found' when hit > 0 then 'yes' else 'no' end as outcome, case when confirmed is null then 0 else n end as occurrences, case when confirmed is null then 0 else hit end as bound from c""")
def probe_outcome(spark, table):
    """Whether a confirmed total stands beside a total label: every line but the first is a label, and every other one has a figure."""
    found = table("lineitem").filter("l_linenumber > 1").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_linenumber") % 2 == 0, minor("l_extendedprice")).alias("cents"))
    most = found.groupBy("o_orderkey").agg(F.max("cents").alias("most"))
    totals = table("orders").select("o_orderkey").join(most, "o_orderkey", "left").select("o_orderkey", F.expr("case o_orderkey % 4 when 0 then null when 1 then most else 1 end").alias("confirmed"))
    got = evaluation.probe_outcomes(found, totals, "o_orderkey", "cents", "confirmed")
    return got.select("o_orderkey", "outcome", big("occurrences").alias("occurrences"), big("bound").alias("bound"))


@query(f"""
with o as ({_CENTS}), r as (select *, k % 7 - 3 as printed from o)
select k as o_orderkey, b as base, t as tax, cast(case when k % 3 = 0 then 0 else printed end as bigint) as rounding, case when k % 3 = 0 then g else g + printed end as gross from r where k % 3 = 0 or abs(printed) <= 2""")
def breakdown_rounding(spark, table):
    """Breakdowns that a printed cash rounding completes; every third document prints none, and one of three cents is too much."""
    rows = _amounts(table).withColumn("printed", F.expr("k % 7 - 3"))
    row = lambda role, value: F.struct(F.lit(role).alias("role"), value.cast("bigint").alias("minor"))
    none = F.col("k") % 3 == 0
    each = F.array(row("base", F.col("b")), row("tax", F.col("t")), row("gross", F.when(none, F.col("g")).otherwise(F.col("g") + F.col("printed"))), F.when(~none, row("rounding", F.col("printed"))))
    operands = rows.select(F.col("k").alias("o_orderkey"), F.explode(F.array_compact(each)).alias("x")).select("o_orderkey", "x.*")
    return solver.with_rounding(operands, 2, "o_orderkey")


@query("""
select cast(s_suppkey as varchar) as number, s_name as name, round(s_acctbal, 2)::double as balance from supplier""")
def remote_round_trip(spark, table):
    """Suppliers sent to a remote table twice and read back by its own schema: each is there once."""
    where = urlparse(f"{shared_dir(spark)}/remote-{uuid.uuid4().hex}")
    base = Path(where.path)
    base.mkdir(parents=True)
    fields = {"Number": "string", "Name": "string", "Balance": "number"}
    (base / "tables.json").write_text(json.dumps([{"name": "suppliers", "fields": [{"name": n, "type": t} for n, t in fields.items()]}]), encoding="utf-8")
    spark.dataSource.register(RemoteTable)
    rows = table.spread("supplier").select("s_suppkey", "s_name", F.col("s_acctbal").cast("decimal(18,2)").alias("s_acctbal"), "s_nationkey")
    sent = rows.write.format("remote_table").mode("append").options(table="suppliers", key="s_suppkey", fields=json.dumps({"s_suppkey": "Number", "s_name": "Name", "s_acctbal": "Balance"}))
    for run in ("first", "second"):
        sent.option("report", f"{base}/reports/{run}").save(str(base))
    back = spark.read.format("remote_table").option("table", "suppliers").load(str(base))
    return back.select(F.col("Number").alias("number"), F.col("Name").alias("name"), F.col("Balance").cast("double").alias("balance"))


@query(f"""
with o as ({_CENTS}), r as (select *, k % 13 = 0 or k % 11 > 0 as es from o)
select k as doc_id, case when k % 29 = 0 then null else 'EUR' end as currency, g as gross, b as net, t as tax, case when k % 19 > 0 then 'read' else 'derived' end as outcome,
  '2100:' || case when k % 19 = 0 then '-:-' else b || ':' || t end as slots, cast(0 as bigint) as discarded, cast(k % 23 = 0 as bigint) as suppressed from r""")
def amounts_facade(spark, table):
    """The amounts of each order's invoice alone, as of one Spanish pass."""
    found = record.solve_amounts(invoice_pages(table), dims.terms(spark), "ES")
    slots = F.array_join(F.transform("slots", lambda s: F.concat_ws(":", *[F.coalesce(s[c].cast("string"), F.lit("-")) for c in ("minor", "base", "tax")])), "|")
    return found.select("doc_id", "currency", "gross", "net", "tax", "outcome", slots.alias("slots"), big("discarded").alias("discarded"), big("suppressed").alias("suppressed"))


@query("""
select conv_id, string_agg(coalesce(role, ''), '>' order by turn nulls first, coalesce(role, '')) as pages from conversations group by 1""")
def pages_ordered(spark, table):
    """A pass's pages in the order of their index."""
    rows = table("conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"))
    return entries.ordered_pages(rows, ["conv_id"], "turn", "role").select("conv_id", F.array_join("pages", ">").alias("pages"))


@query("""
select coalesce(a.doc_id, b.doc_id) as doc_id, case when b.doc_id is null then 'gone' when a.doc_id is null then 'new' when a.h is not distinct from b.h then 'unchanged' else 'changed' end as state
from (select doc_id, sha256(text) as h from documents where doc_id % 7 > 0) a full join (select doc_id, sha256(case when doc_id % 10 = 0 then text || '.' else text end) as h from documents where doc_id % 5 > 0) b using (doc_id)""")
def hash_unchanged(spark, table):
    """Texts hashed twice: every tenth has changed in between, every seventh is new and every fifth gone."""
    docs = table("documents")
    before = docs.filter("doc_id % 7 > 0").select("doc_id", F.sha2("text", 256).alias("sha256"))
    after = docs.filter("doc_id % 5 > 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("sha256"))
    return files.unchanged(before, after, "doc_id")


@query("""
with s as (select source, lang, count(*) as documents, cast(floor(avg(n_chars)) as bigint) as mean from documents group by 1, 2)
select cast(1 as bigint) as line_no, '| source | lang | documents | mean |' as line union all select 2, '| --- | --- | --- | --- |'
union all select row_number() over (order by source nulls first, lang nulls first) + 2, '| ' || coalesce(source, '') || ' | ' || coalesce(lang, '') || ' | ' || documents || ' | ' || coalesce(mean, 0) || ' |' from s""")
def report_rows(spark, table):
    """A report of aggregates by source and language as lines of a table."""
    stats = table("documents").groupBy("source", "lang").agg(F.count("*").alias("documents"), F.coalesce(F.floor(F.avg("n_chars")), F.lit(0)).cast("bigint").alias("mean"))
    return evaluation.report_lines(stats, ["source", "lang"])


_READ = "case when k % 4 in (0, 1) then b / 100.0::double end as net, case when k % 4 = 0 then t / 100.0::double end as tax, case when k % 4 < 3 then g / 100.0::double end as gross, case when k % 4 = 2 and k % 8 = 2 then 21.0::double end as rate, k % 16 = 2 as untaxed"


@query(f"""
with o as ({_CENTS}), r as (select k, day, {_READ} from o), b as (select *, coalesce(net, case when rate > 0 then round(gross / (1 + rate / 100), 2) end) as base from r)
select k as o_orderkey, case when year(day) >= 2000 then day when k % 3 = 0 then date '2024-05-06' end as day, case when untaxed then coalesce(gross, 0) when base is not null then base else coalesce(gross, 0) end as base,
  case when untaxed then 0 when base is not null then coalesce(tax, round(gross - base, 2)) else 0 end as tax from b""")
def loaded_fields(spark, table):
    """What a loader writes of loosely read documents: a plausible date, else that of the file's name, and base and tax."""
    k = F.col("k")
    euros = lambda c: F.col(c) / F.lit(100.0)
    rows = _amounts(table).select("k", "day", F.when(k % 4 < 2, euros("b")).alias("net"), F.when(k % 4 == 0, euros("t")).alias("tax"), F.when(k % 4 < 3, euros("g")).alias("gross"), F.when(k % 8 == 2, 21.0).alias("rate"), (k % 16 == 2).alias("untaxed"))
    name = F.when(k % 3 == 0, "scan 06.05.2024.pdf").otherwise("scan.pdf")
    said = loading.decide_amounts(*[F.col(c) for c in ("net", "tax", "gross", "rate", "untaxed")])
    return rows.select(k.alias("o_orderkey"), loading.decide_day(F.col("day"), name, names_count=True).alias("day"), said.alias("s")).select("o_orderkey", "day", "s.base", "s.tax")


@query("""
select c_custkey, case when c_custkey % 3 > 0 then c_custkey * 10 end as record, n_name as place, coalesce(f.files, '') as files
from customer left join nation on n_nationkey = c_nationkey and c_custkey % 3 > 0 left join (select o_custkey, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as files from orders group by 1) f on f.o_custkey = c_custkey and c_custkey % 3 > 0""")
def log_rebuilt(spark, table):
    """A log of documents with their records by an explicit map, what the records hold, and the files attached to them."""
    customer = table("customer").select("c_custkey", "c_nationkey")
    keys = customer.filter("c_custkey % 3 > 0").select("c_custkey", (F.col("c_custkey") * 10).alias("record"))
    held = customer.join(table("nation"), F.col("n_nationkey") == F.col("c_nationkey")).select((F.col("c_custkey") * 10).alias("record"), F.col("n_name").alias("place"))
    attached = table("orders").select((F.col("o_custkey") * 10).alias("record"), F.col("o_orderpriority").alias("name"))
    found = loading.rebuilt_log(customer.select("c_custkey"), keys, held, attached, "c_custkey", "record", "name")
    return found.select("c_custkey", "record", "place", F.array_join("files", ",").alias("files"))


_JSON = "case event_id % 6 when 0 then '{\"a\": {\"id\": ' || event_id || '}}' when 1 then '{\"a\": {\"id\": \"x' || event_id || '\"}}' when 2 then '{\"a\": {\"id\": [1]}}' when 3 then '{\"a\": {}}' when 4 then '{\"a\"' else '{\"a\": {\"id\": null}}' end"


@query(f"""
select event_id, case event_id % 6 when 0 then cast(event_id as varchar) when 1 then 'x' || event_id end as value, case event_id % 6 when 2 then 'notAnIdentifier' when 3 then 'missing' when 4 then 'notJson' when 5 then 'missing' end as refusal from events""")
def typed_json(spark, table):
    """Identifiers of JSON texts, strings or whole numbers, with why one is refused."""
    return table("events").select("event_id", F.expr(_JSON.replace('\\"', '"')).alias("t")).select("event_id", settings.typed(F.col("t"), "$.a.id", "identifier").alias("r")).select("event_id", "r.*")


@query("""
select s_suppkey, case when s_suppkey % 3 = 2 then '' else 'B' || lpad(cast(s_suppkey as varchar), 7, '0') || (s_suppkey % 10) || ':ES_CIF' end || case when s_suppkey % 2 = 0 then case when s_suppkey % 3 = 2 then '' else '|' end || 'DE' || lpad(cast(s_suppkey as varchar), 9, '0') || ':DE_USTID' else '' end as ids,
  case s_suppkey % 3 when 0 then 'F-100' || s_suppkey when 1 then '12345' || s_suppkey when 2 then 'ABC123' || s_suppkey end as number, case when s_suppkey % 4 = 0 then '4555xxxxxx1234' when s_suppkey % 4 = 1 then 'xxxx9876' end as card from supplier""")
def scanned_facts(spark, table):
    """Tax identifiers, document numbers and masked cards in running text, in each of their forms."""
    k, s = F.col("s_suppkey"), F.col("s_suppkey").cast("string")
    own = F.when(k % 3 == 2, "nada").otherwise(F.concat(F.lit("NIF B-"), F.lpad(s, 7, "0"), F.lit(" "), (k % 10).cast("string")))
    german = F.when(k % 2 == 0, F.concat(F.lit(" USt DE "), F.lpad(s, 9, "0"))).otherwise("")
    number = F.when(k % 3 == 0, F.concat(F.lit("factura F-100"), s)).when(k % 3 == 1, F.concat(F.lit("Nº/fecha documento\n 12345"), s)).otherwise(F.concat(F.lit("Código de control: ABC123"), s))
    card = F.when(k % 4 == 0, "4555 **** 1234").when(k % 4 == 1, "****9876").otherwise("")
    rows = table("supplier").select("s_suppkey", F.concat_ws("\n", card, F.concat(own, german), number).alias("t"))
    rows = rows.withColumn("number", lenient.document_number(F.col("t")))
    # the number of an invoice, as F-10012345, may look like an identifier
    ids = F.array_join(F.transform(lenient.tax_ids(F.col("t"), F.col("number")), lambda x: F.concat_ws(":", x["normalized"], x["kind"])), "|")
    return rows.select("s_suppkey", ids.alias("ids"), "number", lenient.card_mask(F.col("t")).alias("card"))


@query("""
with n as (select distinct lower(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g')) as a, p_partkey % 3 as kind, p_name from part), t as (select * from (values ('total', 0, 'total due'), ('date', 1, 'order key'), ('name', 2, 'cust name')) t(core_field, kind, b)),
p as (select p_name, core_field, a, b, case when length(a) >= length(b) then a else b end as lo, case when length(a) >= length(b) then b else a end as sh from n join t using (kind)),
w as (select *, case when a = b then 1.0 when length(sh) / length(lo) >= 0.5 then (case when contains(lo, sh) then 0.9 else 1 - list_min([levenshtein(sh, substr(lo, k, length(sh))) for k in range(1, length(lo) - length(sh) + 2)]) / length(lo) end) else 1 - levenshtein(a, b) / length(lo) end as whole,
  2 * len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' ')))) / (len(list_distinct(string_split(a, ' '))) + len(list_distinct(string_split(b, ' ')))) as shared from p)
select p_name as name, core_field, round(cast(greatest(whole, shared) as double), 6) as score from w""")
def typed_matches(spark, table):
    """Core fields scored against columns of their own kind alone."""
    core = spark.createDataFrame([(0, "total", 0, ["total due"]), (1, "date", 1, ["order key"]), (2, "name", 2, ["cust name"])], "kind bigint, core_field string, core_no int, synonyms array<string>")
    columns = table("part").select((F.col("p_partkey") % 3).alias("kind"), F.col("p_name").alias("field_id"), F.lit(0).alias("field_no"), F.col("p_name").alias("name")).distinct()
    found = records.typed_matches(core, columns)
    return found.select(F.col("field_id").alias("name"), "core_field", F.round("score", 6).alias("score"))
