"""The registered queries, on the driver's tables, and the same queries in SQL.

No table of invoices is given, so printed forms, identifiers, boxes and readings are derived from keys; every operator
then runs over the whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import amounts, dates, dims, identifiers, text
from quillstone.operators import consensus as votes
from quillstone.operators import binding, confidence, evaluation, evidence, heuristics, layout, negative, photo, records, solver, terms
from quillstone.plans import extract
from quillstone.streaming import history

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """Reads the driver's tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """The table over all cores where it lies in fewer files than that; for work that is heavy by row and shuffles nothing."""
        df, cores = self(name), self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if len(df.inputFiles()) < cores else df


def query(sql: str | None = None):
    """Registers a function of (spark, table reader) under its name, with its equivalent."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def big(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


NIF, CIF = identifiers.NIF_LETTERS, identifiers.CIF_LETTERS
_MINOR = "cast(round({} * 100) as bigint)"


def minor(c: str) -> F.Column:
    return F.expr(_MINOR.format(c))


@query("""
select p_partkey, code, (10 - list_sum([cast(substr(code, k, 1) as int) * (case when k % 2 = 0 then 3 else 1 end) for k in range(1, 13)]) % 10) % 10 = cast(substr(code, 13, 1) as int) as valid
from (select p_partkey, lpad(cast(p_partkey as varchar), 12, '0') || cast(p_partkey % 10 as varchar) as code from part)""")
def ean13_check(spark, table):
    code = F.concat(F.lpad(F.col("p_partkey").cast("string"), 12, "0"), (F.col("p_partkey") % 10).cast("string"))
    return table("part").select("p_partkey", code.alias("code")).withColumn("valid", identifiers.ean13_valid(F.col("code")))


@query("""
select c_custkey, iban, cast(substr(iban, 5) || '1314' || substr(iban, 3, 2) as hugeint) % 97 = 1 as valid
from (select c_custkey, 'DE' || lpad(cast(c_custkey % 97 as varchar), 2, '0') || lpad(cast(c_custkey * 7919 as varchar), 18, '0') as iban from customer)""")
def iban_check(spark, table):
    k = F.col("c_custkey")
    iban = F.concat(F.lit("de "), F.lpad((k % 97).cast("string"), 2, "0"), F.lpad((k * 7919).cast("string"), 18, "0"))
    return table("customer").select("c_custkey", identifiers.iban_normalised(iban).alias("iban")).withColumn("valid", identifiers.iban_valid(F.col("iban")))


@query(f"""
select c_custkey, nif, substr('{NIF}', cast(cast(substr(nif, 1, 8) as int) % 23 as int) + 1, 1) = substr(nif, 9, 1) as valid
from (select c_custkey, lpad(cast(c_custkey * 37 % 100000000 as varchar), 8, '0') || substr('{NIF}', cast(c_custkey % 23 as int) + 1, 1) as nif from customer)""")
def nif_check(spark, table):
    k = F.col("c_custkey")
    nif = F.concat(F.lpad((k * 37 % 100000000).cast("string"), 8, "0"), F.substring(F.lit(NIF), (k % 23 + 1).cast("int"), F.lit(1)))
    return table("customer").select("c_custkey", nif.alias("nif")).withColumn("valid", identifiers.nif_valid(F.col("nif")))


@query(f"""
select c_custkey, nie, substr('{NIF}', cast(cast(translate(substr(nie, 1, 1), 'XYZ', '012') || substr(nie, 2, 7) as int) % 23 as int) + 1, 1) = substr(nie, 9, 1) as valid
from (select c_custkey, substr('XYZ', cast(c_custkey % 3 as int) + 1, 1) || lpad(cast(c_custkey * 11 as varchar), 7, '0') || substr('{NIF}', cast(c_custkey % 23 as int) + 1, 1) as nie from customer)""")
def nie_check(spark, table):
    k = F.col("c_custkey")
    nie = F.concat(F.substring(F.lit("XYZ"), (k % 3 + 1).cast("int"), F.lit(1)), F.lpad((k * 11).cast("string"), 7, "0"), F.substring(F.lit(NIF), (k % 23 + 1).cast("int"), F.lit(1)))
    return table("customer").select("c_custkey", nie.alias("nie")).withColumn("valid", identifiers.nie_valid(F.col("nie")))


@query(f"""
with c as (select s_suppkey, substr('{identifiers.CIF_ISSUERS}', cast(s_suppkey % 17 as int) + 1, 1) || lpad(cast(s_suppkey * 31 as varchar), 7, '0')
             || (case when s_suppkey % 2 = 0 then cast(s_suppkey % 10 as varchar) else substr('{CIF}', cast(s_suppkey % 10 as int) + 1, 1) end) as cif from supplier),
d as (select *, [cast(substr(cif, k, 1) as int) for k in range(2, 9)] as n from c),
s as (select *, (10 - (n[2] + n[4] + n[6] + list_sum([2 * n[k] // 10 + 2 * n[k] % 10 for k in [1, 3, 5, 7]])) % 10) % 10 as control from d)
select s_suppkey, cif, (case when substr(cif, 1, 1) in ('N', 'P', 'Q', 'R', 'S', 'W') then substr('{CIF}', cast(control as int) + 1, 1) else cast(cast(control as int) as varchar) end) = substr(cif, 9, 1) as valid from s""")
def cif_check(spark, table):
    k = F.col("s_suppkey")
    control = F.when(k % 2 == 0, (k % 10).cast("string")).otherwise(F.substring(F.lit(CIF), (k % 10 + 1).cast("int"), F.lit(1)))
    cif = F.concat(F.substring(F.lit(identifiers.CIF_ISSUERS), (k % 17 + 1).cast("int"), F.lit(1)), F.lpad((k * 31).cast("string"), 7, "0"), control)
    return table("supplier").select("s_suppkey", cif.alias("cif")).withColumn("valid", identifiers.cif_valid(F.col("cif")))


_SHAPES = "case c_custkey % 6 when 0 then 'es' || d || '.a' when 1 then 'X-' || substr(d, 1, 7) || 'B' when 2 then 'B ' || substr(d, 1, 7) || '4' when 3 then 'de ' || d || '1' when 4 then d else 'I' || substr(d, 1, 7) || 'C' end"


@query(f"""
with r as (select c_custkey, {_SHAPES} as raw from (select c_custkey, lpad(cast(c_custkey as varchar), 8, '0') as d from customer)),
n as (select c_custkey, translate(upper(raw), ' .-', '') as id from r), o as (select *, case when id like 'ES%' then substr(id, 3) else id end as own from n)
select c_custkey, id, case when regexp_full_match(own, '[0-9]{{8}}[A-Z]') then 'ES_NIF' when regexp_full_match(own, '[XYZ][0-9]{{7}}[A-Z]') then 'ES_NIE'
  when regexp_full_match(own, '[ABCDEFGHJNPQRSUVW][0-9]{{7}}[0-9A-J]') then 'ES_CIF' when regexp_full_match(id, 'DE[0-9]{{9}}') then 'DE_USTID' end as kind from o""")
def taxid_classify(spark, table):
    rows = table("customer").select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("d"))
    rows = rows.select("c_custkey", identifiers.tax_id_normalised(F.expr(_SHAPES)).alias("id"))
    return rows.withColumn("kind", identifiers.tax_id_kind(F.col("id")))


@query(f"""
with r as (select c_custkey, regexp_replace(lpad(cast(c_custkey * 37 % 100000000 as varchar), 8, '0'), '5', 'S') || substr('{NIF}', cast(c_custkey * 37 % 100000000 % 23 as int) + 1, 1) as raw from customer),
c as (select distinct c_custkey, substr(raw, 1, k - 1) || (case substr(raw, k, 1) when 'S' then '5' else 'S' end) || substr(raw, k + 1) as c from r, (select unnest(range(1, 10)) as k) where substr(raw, k, 1) in ('S', '5')),
ok as (select c_custkey, count(*) as n, min(c) as c from c where regexp_full_match(c, '[0-9]{{8}}[A-Z]') and substr('{NIF}', cast(try_cast(substr(c, 1, 8) as int) % 23 as int) + 1, 1) = substr(c, 9, 1) group by 1)
select c_custkey, raw, case when not self and n = 1 then c else raw end as value, case when not self and n = 1 then 'repaired' else 'read' end as provenance
from (select r.*, ok.n, ok.c, regexp_full_match(raw, '[0-9]{{8}}[A-Z]') and coalesce(substr('{NIF}', cast(try_cast(substr(raw, 1, 8) as int) % 23 as int) + 1, 1) = substr(raw, 9, 1), false) as self from r left join ok using (c_custkey))""")
def id_repair(spark, table):
    n = F.col("c_custkey") * 37 % 100000000
    raw = F.concat(F.expr("overlay(d placing 'S' from i for 1)"), F.substring(F.lit(NIF), (n % 23 + 1).cast("int"), F.lit(1)))
    rows = table("customer").select("c_custkey", F.lpad(n.cast("string"), 8, "0").alias("d")).withColumn("i", F.instr("d", "5"))
    rows = rows.select("c_custkey", F.when(F.col("i") > 0, raw).otherwise(F.concat("d", F.substring(F.lit(NIF), (n % 23 + 1).cast("int"), F.lit(1)))).alias("raw"))
    return rows.withColumn("r", identifiers.repair(F.col("raw"), identifiers.nif_valid)).select("c_custkey", "raw", "r.*")


_MARK = "case when l_orderkey % 10 = 0 then (case when l_linenumber % 2 = 0 then ',' else '.' end) when l_orderkey % 2 = 0 then ',' else '.' end"
_PRINTED = f"cast(m // 100 as varchar) || ({_MARK}) || lpad(cast(m % 100 as varchar), 2, '0')"


def printed_lines(table) -> DataFrame:
    rows = table("lineitem").select("l_orderkey", "l_linenumber", minor("l_extendedprice").alias("m"))
    return rows.withColumn("mark", F.expr(_MARK)).withColumn("printed", F.concat(F.expr("cast(m div 100 as string)"), "mark", F.lpad((F.col("m") % 100).cast("string"), 2, "0")))


@query(f"""
select l_orderkey, case when count(distinct mark) = 1 then min(case mark when ',' then 'comma' else 'dot' end) end as convention
from (select l_orderkey, {_MARK} as mark from lineitem) group by 1""")
def decimal_convention(spark, table):
    return printed_lines(table).groupBy("l_orderkey").agg(amounts.agreed(amounts.amount_convention(F.col("printed"))).alias("convention"))


@query(f"""
with p as (select l_orderkey, l_linenumber, {_MINOR.format('l_extendedprice')} as m from lineitem),
q as (select *, {_MARK} as mark from p)
select l_orderkey, l_linenumber, (l_orderkey + l_linenumber) % 4 as form, case (l_orderkey + l_linenumber) % 4 when 0 then m when 1 then -m when 2 then -m end as minor from q""")
def parse_amount(spark, table):
    form = (F.col("l_orderkey") + F.col("l_linenumber")) % 4
    rows = printed_lines(table).withColumn("form", form)
    grouped = F.concat(F.expr("cast(m div 100000 as string)"), F.when(F.col("mark") == ",", ".").otherwise(","), F.lpad(F.expr("cast(m div 100 % 1000 as string)"), 3, "0"), "mark", F.lpad((F.col("m") % 100).cast("string"), 2, "0"))
    shown = F.when(F.col("form") == 0, F.concat(F.lit(" "), grouped)).when(F.col("form") == 1, F.concat("printed", F.lit("-"))).when(F.col("form") == 2, F.concat(F.lit("-"), "printed")).otherwise(F.concat("printed", F.lit("5")))
    convention = F.when(F.col("mark") == ",", "comma").otherwise("dot")
    return rows.select("l_orderkey", "l_linenumber", "form", amounts.parse_amount(shown, convention, F.lit(2)).alias("minor"))


@query("""
select l_orderkey, l_linenumber, cast(round(l_tax * 10000) as bigint) as rate_bp from lineitem""")
def parse_rate(spark, table):
    bp = F.expr("cast(round(l_tax * 10000) as int)")
    shown = F.when(F.col("l_linenumber") % 2 == 0, amounts.rate_text(bp)).otherwise(F.format_string("%d.%02d", F.floor(bp / 100).cast("int"), bp % 100))
    return table("lineitem").select("l_orderkey", "l_linenumber", big(amounts.parse_rate(shown)).alias("rate_bp"))


@query(f"""
select l_orderkey, l_linenumber, cast(m // 100 as varchar) || '.' || lpad(cast(m % 100 as varchar), 2, '0') as shown
from (select l_orderkey, l_linenumber, {_MINOR.format('l_extendedprice')} as m from lineitem)""")
def format_amount(spark, table):
    return table("lineitem").select("l_orderkey", "l_linenumber", amounts.format_amount(minor("l_extendedprice"), F.lit(2)).alias("shown"))


def printed_dates(table) -> DataFrame:
    d, k = F.to_date("o_orderdate"), F.col("o_orderkey") % 3
    shown = F.when(k == 0, F.date_format(d, "dd/MM/yyyy")).when(k == 1, F.date_format(d, "MM-dd-yyyy")).otherwise(F.date_format(d, "yyyy.MM.dd"))
    return table("orders").select("o_orderkey", "o_custkey", d.alias("d"), k.alias("k"), shown.alias("shown"))


@query("""
with d as (select o_custkey, o_orderkey % 3 as k, day(o_orderdate) as d from orders),
e as (select o_custkey, case when k = 2 then 'ymd' when d > 12 then (case k when 0 then 'dmy' else 'mdy' end) end as evidence from d)
select o_custkey, case when count(distinct evidence) = 1 then min(evidence) end as date_order from e group by 1""")
def date_order(spark, table):
    return printed_dates(table).groupBy("o_custkey").agg(amounts.agreed(dates.date_order(F.col("shown"))).alias("date_order"))


@query("""
select o_orderkey, cast(o_orderdate as date) as parsed, case when o_orderkey % 3 = 2 or day(o_orderdate) > 12 then 'unambiguous' else 'ambiguous' end as resolved from orders""")
def parse_date(spark, table):
    order = F.when(F.col("k") == 0, "dmy").when(F.col("k") == 1, "mdy").otherwise("ymd")
    return printed_dates(table).select("o_orderkey", dates.parse_date(F.col("shown"), order).alias("parsed"), dates.resolve_date(F.col("shown")).alias("resolved"))


_RATES = ", ".join(f"('{c}', {r})" for c, row in dims.COUNTRIES.items() for r in row["rates"])


@query(f"""
with p as (select l_orderkey, l_linenumber, case when l_orderkey % 2 = 0 then 'ES' else 'DE' end as country, cast(round(l_tax * 10000) as bigint) as rate_bp from lineitem),
legal as (select * from (values {_RATES}) t(country, rate_bp))
select p.*, legal.rate_bp is not null as admitted from p left join legal using (country, rate_bp)""")
def legal_rate_gate(spark, table):
    printed = table("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 2 == 0, "ES").otherwise("DE").alias("country"), F.expr("cast(round(l_tax * 10000) as bigint)").alias("rate_bp"))
    kept, gone = solver.gate_rates(printed, dims.legal_rates(spark))
    return kept.withColumn("admitted", F.lit(True)).unionByName(gone.withColumn("admitted", F.lit(False)))


@query(f"""
with p as (select l_orderkey, l_linenumber, {_MINOR.format('l_extendedprice')} as base, cast(round(l_tax * 10000) as bigint) as rate from lineitem),
t as (select *, (base * rate + 5000) // 10000 + l_orderkey % 3 as tax from p)
select l_orderkey, l_linenumber, tax, abs(cast(tax as hugeint) * 10000 - cast(base as hugeint) * rate) <= 10000 as within_tolerance from t""")
def tax_tolerance(spark, table):
    rows = table("lineitem").select("l_orderkey", "l_linenumber", minor("l_extendedprice").alias("base"), F.expr("cast(round(l_tax * 10000) as bigint)").alias("rate"))
    rows = rows.withColumn("tax", F.expr("(base * rate + 5000) div 10000 + l_orderkey % 3"))
    return rows.select("l_orderkey", "l_linenumber", "tax", amounts.tax_within_tolerance(F.col("base"), F.col("tax"), F.col("rate")).alias("within_tolerance"))


#: The operands of all lines: a base for each, a fifth of it as tax for the first or all, and their sum as gross for some.
_OPERANDS = f"""
select l_orderkey as doc_id, 'base' as role, {_MINOR.format('l_extendedprice')} as minor from lineitem
union all select l_orderkey, 'tax', floor({_MINOR.format('l_extendedprice')} * 21 / 100) from lineitem where l_linenumber = 1 or l_orderkey % 5 = 0
union all select l_orderkey, 'gross', {_MINOR.format('l_extendedprice')} + floor({_MINOR.format('l_extendedprice')} * 21 / 100) from lineitem where l_orderkey % 3 > 0 and l_linenumber <= l_orderkey % 8"""


def order_operands(table) -> DataFrame:
    line = table("lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n"), minor("l_extendedprice").alias("m"))
    tax = F.floor(F.col("m") * 21 / 100).cast("bigint")
    made = F.array(
        F.struct(F.lit("base").alias("role"), F.col("m").alias("minor")),
        F.struct(F.when(F.expr("n = 1 or doc_id % 5 = 0"), "tax").alias("role"), tax.alias("minor")),
        F.struct(F.when(F.expr("doc_id % 3 > 0 and n <= doc_id % 8"), "gross").alias("role"), (F.col("m") + tax).alias("minor")),
    )
    return line.select("doc_id", F.explode(made).alias("x")).select("doc_id", "x.*").filter("role is not null")


_TRIPLES = f"""
with o as (select distinct doc_id, role, cast(minor as bigint) as minor from ({_OPERANDS})),
t as (select b.doc_id, b.minor as base, t.minor as tax, g.minor as gross from o b join o t on b.doc_id = t.doc_id and b.role = 'base' and t.role = 'tax'
      join o g on g.doc_id = b.doc_id and g.role = 'gross' and g.minor = b.minor + t.minor)"""


@query(_TRIPLES + " select * from t")
def amount_triples(spark, table):
    return solver.triples(order_operands(table))


@query(_TRIPLES + """,
n as (select doc_id, count(*) as n, min(base) as base, min(tax) as tax, min(gross) as gross from t group by 1),
s as (select doc_id, count(distinct minor) filter (role = 'base') as nb, count(distinct minor) filter (role = 'tax') as nt, count(distinct minor) filter (role = 'gross') as ng,
        min(minor) filter (role = 'base') as b, min(minor) filter (role = 'tax') as t, min(minor) filter (role = 'gross') as g from o group by 1),
u as (select doc_id, nb, nt, ng, case when nb = 1 then b end as b, case when nt = 1 then t end as t, case when ng = 1 then g end as g from s),
d as (select *, case when nb = 0 and nt = 1 and ng = 1 then g - t else b end as db, case when nb = 1 and nt = 0 and ng = 1 then g - b else t end as dt, case when nb = 1 and nt = 1 and ng = 0 then b + t else g end as dg,
        nb + nt + ng = 2 and nb <= 1 and nt <= 1 and ng <= 1 as two from u),
e as (select *, two and doc_id % 4 > 0 and coalesce(abs(cast(dt as hugeint) * 10000 - cast(db as hugeint) * 2100) <= 10000, false) as derived from d)
select e.doc_id, case when n.n = 1 then 'read' when n.n > 1 then 'ambiguous' when derived then 'derived' else 'single' end as outcome,
  case when n.n = 1 then n.base when n.n > 1 then null when derived then db else b end as base, case when n.n = 1 then n.tax when n.n > 1 then null when derived then dt else t end as tax,
  case when n.n = 1 then n.gross when n.n > 1 then null when derived then dg else g end as gross
from e left join n using (doc_id)""")
def breakdown_solve(spark, table):
    """Three of four orders print the rate of 21 %; the others derive nothing."""
    operands = order_operands(table)
    return solver.solve(operands, operands.filter("doc_id % 4 > 0").select("doc_id", F.lit(2100).alias("rate_bp")))


@query(f"""
with o as (select distinct doc_id, role, cast(minor as bigint) as minor from ({_OPERANDS})), r as (select distinct doc_id, unnest([2100, 1000, 400]) as rate_bp from o),
f as (select r.doc_id, r.rate_bp, b.minor as base, t.minor as tax from r join o b on b.doc_id = r.doc_id and b.role = 'base' join o t on t.doc_id = r.doc_id and t.role = 'tax'
      where abs(cast(t.minor as hugeint) * 10000 - cast(b.minor as hugeint) * r.rate_bp) <= 10000),
u as (select doc_id, rate_bp, min(base) as base, min(tax) as tax from f group by 1, 2 having count(*) = 1)
select r.doc_id, cast(r.rate_bp as bigint) as rate_bp, u.base, u.tax from r left join u using (doc_id, rate_bp)""")
def tax_slots(spark, table):
    operands = order_operands(table)
    rates = operands.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, (2100, 1000, 400)))).alias("rate_bp"))
    return solver.tax_slots(operands, rates).withColumn("rate_bp", big("rate_bp"))


@query("""
with v as (select l_orderkey, cast(l_quantity as bigint) % 4 as value, count(*) as n from lineitem group by 1, 2),
m as (select *, max(n) over (partition by l_orderkey) as votes, sum(n) over (partition by l_orderkey) as total from v),
g as (select l_orderkey, votes, total, count(*) filter (n = votes) as tops, max(value) filter (n = votes) as lead from m group by 1, 2, 3)
select l_orderkey, case when total = 1 then 'single' when votes >= 2 and tops = 1 then 'agreed' else 'none' end as kind, case when total = 1 or votes >= 2 and tops = 1 then lead end as value,
  case when total = 1 or votes >= 2 and tops = 1 then votes end as votes, cast(total as bigint) as "of" from g""")
def consensus(spark, table):
    readings = table("lineitem").select("l_orderkey", (F.col("l_quantity").cast("bigint") % 4).alias("value"))
    return votes.consensus(readings, ["l_orderkey"])


@query("""
select l_orderkey, case when count(distinct l_returnflag) = 1 then min(l_returnflag) end as flag, case when count(*) = 1 then min(l_linestatus) end as status from lineitem group by 1""")
def unanimity(spark, table):
    return table("lineitem").groupBy("l_orderkey").agg(votes.unanimous(F.col("l_returnflag")).alias("flag"), votes.only(F.col("l_linestatus")).alias("status"))


_TERM_ROWS = [("base", "en", "the"), ("base", "en", "the and"), ("total", "es", "de la"), ("total", "es", "de"), ("total", "fr", "de"), ("tax", "de", "und"), ("tax", "de", "über"), ("tax", "en", "that")]
_TERM_SQL = ", ".join(f"('{k}', '{lang}', '{t}')" for k, lang, t in _TERM_ROWS)
_W = "0-9A-Za-z\\x{80}-\\x{10FFFF}"


@query(f"""
with f as (select doc_id, translate(lower(text), '{dims.FOLD_FROM}', '{dims.FOLD_TO}') as t from documents),
d as (select kind, language, term, translate(lower(term), '{dims.FOLD_FROM}', '{dims.FOLD_TO}') as norm from (values {_TERM_SQL}) x(kind, language, term)),
p as (select doc_id, t, unnest(list_zip(string_split_regex(t, '[{_W}]+'), regexp_extract_all(t, '[{_W}]+'))) as x, generate_subscripts(regexp_extract_all(t, '[{_W}]+'), 1) as k from f),
w as (select doc_id, t, x[2] as word, sum(length(x[1]) + coalesce(length(x[2]), 0)) over (partition by doc_id order by k)::bigint - length(x[2]) + 1 as start from p where x[2] is not null),
m as (select w.doc_id, cast(w.start as bigint) as start, d.*, length(d.norm) as n from w join d on d.norm = w.word or (d.norm like w.word || ' %' and substr(w.t, w.start, length(d.norm)) = d.norm and not regexp_matches(substr(w.t, w.start + length(d.norm), 1), '[{_W}]'))),
b as (select *, max(n) over (partition by doc_id, start) as most from m)
select doc_id, start, term, kind, language from b where n = most""")
def term_match(spark, table):
    own = spark.createDataFrame([(*r, None) for r in _TERM_ROWS], "kind string, language string, term string, hint string")
    found = terms.find_terms(table.spread("documents").select("doc_id", "text"), own, ["doc_id"])
    return found.select("doc_id", big("start").alias("start"), "term", "kind", "language")


#: Boxes of an order's lines: three a printed line, staggered.
_BOX = {"x0": "l_linenumber * 9000 + l_partkey % 500", "top": "(l_linenumber // 3) * 14000 + l_suppkey % 9000", "h": "8000 + l_partkey % 3000"}


def order_words(table) -> DataFrame:
    return table("lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("word_no"), F.concat(F.lit("w"), F.col("l_linenumber").cast("string")).alias("text"),
        F.expr("cast(l_linenumber * 9000 + l_partkey % 500 as int)").alias("x0"), F.expr("cast(l_linenumber * 9000 + l_partkey % 500 + 7000 as int)").alias("x1"),
        F.expr("cast((l_linenumber div 3) * 14000 + l_suppkey % 9000 as int)").alias("top"), F.expr("cast((l_linenumber div 3) * 14000 + l_suppkey % 9000 + 8000 + l_partkey % 3000 as int)").alias("bottom"),
    )


_WORDS_SQL = f"""w as (select l_orderkey as doc_id, l_linenumber as word_no, 'w' || cast(l_linenumber as varchar) as text, {_BOX['x0']} as x0, {_BOX['x0']} + 7000 as x1, {_BOX['top']} as top, {_BOX['top']} + {_BOX['h']} as bottom from lineitem)"""
_LINES_SQL = f"""with recursive {_WORDS_SQL},
s as (select *, row_number() over (partition by doc_id order by top, x0, x1, bottom, text, word_no) as n from w),
r as (select doc_id, n, word_no, text, x0, x1, top, bottom, 0 as line, top as lt, bottom as lb from s where n = 1
  union all select s.doc_id, s.n, s.word_no, s.text, s.x0, s.x1, s.top, s.bottom, case when j then r.line else r.line + 1 end, case when j then least(r.lt, s.top) else s.top end, case when j then greatest(r.lb, s.bottom) else s.bottom end
  from r join s on s.doc_id = r.doc_id and s.n = r.n + 1, lateral (select 2 * (least(r.lb, s.bottom) - greatest(r.lt, s.top)) >= least(r.lb - r.lt, s.bottom - s.top) as j) q)"""


@query(_LINES_SQL + """
select doc_id, cast(line as bigint) as line_no, string_agg(text, ' ' order by x0, word_no) as text, cast(min(x0) as bigint) as x0, cast(max(x1) as bigint) as x1, cast(min(top) as bigint) as top, cast(max(bottom) as bigint) as bottom from r group by 1, 2""")
def line_grouping(spark, table):
    found = layout.lines(order_words(table), ["doc_id"])
    return found.select("doc_id", big("line_no").alias("line_no"), "text", *[big(c).alias(c) for c in ("x0", "x1", "top", "bottom")])


@query(f"""
with {_WORDS_SQL}, n as (select doc_id, word_no // 3 as line_no, min(x0) as x0, max(x1) as x1, min(top) as top, max(bottom) as bottom from w group by 1, 2),
l as (select w.doc_id, w.word_no as label_id, w.x0, w.x1, n.top, n.bottom, n.line_no from w join n on n.doc_id = w.doc_id and n.line_no = w.word_no // 3 where word_no % 3 = 1),
v as (select w.doc_id, w.x0, w.x1, n.x0 as nx0, n.x1 as nx1, n.top, n.line_no, word_no * 100 as value from w join n on n.doc_id = w.doc_id and n.line_no = w.word_no // 3 where word_no % 3 <> 1),
m as (select l.doc_id, l.label_id, v.value, v.top as vt, v.line_no as vl, v.x0 as vx, case when v.line_no = l.line_no and v.x0 >= l.x1 then 0
  when v.top > l.bottom and v.top - l.bottom <= 2 * (l.bottom - l.top) and v.nx1 > l.x0 and v.nx0 < l.x1 and v.x1 > l.x0 then 1 end as tier from l join v using (doc_id))
select doc_id, cast(label_id as bigint) as label_id, cast(value as bigint) as value, tier = 0 as same_line from m where tier is not null
qualify row_number() over (partition by doc_id, label_id order by tier, case when tier = 1 then vt end, case when tier = 1 then vl end, vx, value) = 1""")
def label_binding(spark, table):
    words = order_words(table).withColumn("line_no", F.expr("word_no div 3"))
    lines = words.groupBy("doc_id", "line_no").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"), F.max("bottom").alias("bottom"))
    labels = words.filter("word_no % 3 = 1").withColumnRenamed("word_no", "label_id").drop("text")
    values = words.filter("word_no % 3 <> 1").withColumn("value", big(F.col("word_no") * 100))
    found = binding.bind_labels(labels, values, lines, ["doc_id"])
    return found.select("doc_id", big("label_id").alias("label_id"), "value", "same_line")


@query(f"""
with {_WORDS_SQL}, l as (select doc_id, word_no as label_id, x0, x1, top, bottom, word_no // 3 as line_no from w where word_no % 3 = 1), v as (select doc_id, x0, x1, top, bottom, word_no // 3 as line_no, word_no * 100 as value from w where word_no % 3 <> 1),
m as (select l.doc_id, l.label_id, v.value, v.top as vt, v.x0 as vx, case when v.line_no = l.line_no and v.x0 >= l.x1 then 0 when v.line_no > l.line_no and v.top - l.bottom <= 2 * (l.bottom - l.top) and v.x1 > l.x0 and v.x0 < l.x1 then 1 end as tier from l join v using (doc_id))
select doc_id, cast(label_id as bigint) as label_id, cast(value as bigint) as value, tier = 0 as same_line from m where tier is not null
qualify row_number() over (partition by doc_id, label_id order by tier, case when tier = 1 then vt end, vx, value) = 1""")
def label_probe(spark, table):
    words = order_words(table).withColumn("line_no", F.expr("word_no div 3"))
    labels = words.filter("word_no % 3 = 1").withColumnRenamed("word_no", "label_id").drop("text")
    values = words.filter("word_no % 3 <> 1").withColumn("value", big(F.col("word_no") * 100))
    found = binding.probe_labels(labels, values, ["doc_id"])
    return found.select("doc_id", big("label_id").alias("label_id"), "value", "same_line")


@query(f"""
with {_WORDS_SQL}, o as (select * from w where word_no % 2 = 1), t as (select * from w where word_no % 2 = 0)
select o.doc_id, cast(o.word_no as bigint) as word_no, exists (select 1 from t where t.doc_id = o.doc_id and
  power(greatest(greatest(o.x0, t.x0) - least(o.x1, t.x1), 0), 2) + power(greatest(greatest(o.top, t.top) - least(o.bottom, t.bottom), 0), 2) <= 4000 * 4000) as suppressed from o""")
def negative_context(spark, table):
    words = order_words(table)
    found = negative.flag_context(words.filter("word_no % 2 = 1"), words.filter("word_no % 2 = 0"), ["doc_id"], radius=4000)
    return found.select("doc_id", big("word_no").alias("word_no"), "suppressed")


_SHOWN = ["€", "eur", "EUR", "usd", "$", "total", "XXX"]


@query(f"""
with w as (select o_custkey as doc_id, ({_SHOWN})[cast(case when o_custkey % 2 = 0 then o_orderkey % 3 else o_orderkey % 7 end as int) + 1] as word from orders),
e as (select distinct doc_id, case word when '€' then 'EUR' when '$' then 'USD' else upper(word) end as c from w where word not in ('total', 'XXX'))
select doc_id, case when count(*) = 1 then min(c) end as currency, count(*) as n_codes from e group by 1""")
def currency_evidence(spark, table):
    word = F.element_at(F.array(*map(F.lit, _SHOWN)), (F.when(F.col("o_custkey") % 2 == 0, F.col("o_orderkey") % 3).otherwise(F.col("o_orderkey") % 7) + 1).cast("int"))
    words = table("orders").select(F.col("o_custkey").alias("doc_id"), word.alias("text"))
    return evidence.resolve_currency(evidence.currency_evidence(words, dims.currencies(spark)))


@query("""
with s as (select s_suppkey, case s_suppkey % 5 when 0 then ['ES'] when 1 then ['DE'] when 2 then ['DE', 'ES'] else [] end as strong, s_suppkey % 7 = 0 as no_row,
  case s_nationkey % 4 when 0 then ['ES'] when 1 then ['DE'] when 2 then ['DE', 'ES'] else [] end as medium, s_suppkey % 3 = 0 as other from supplier),
d as (select *, case when len(strong) = 1 and not no_row then strong[1] when len(strong) > 1 and len(list_intersect(strong, medium)) = 1 then list_intersect(strong, medium)[1] when len(strong) = 0 and not no_row and len(medium) = 1 then medium[1] end as country from s)
select s_suppkey, country, case when country is not null then null when no_row and len(strong) = 0 then 'countryWithoutRow' when len(strong) >= 1 then 'conflictingEvidence' when other and len(medium) <> 1 then 'countryWithoutRow' else 'noEvidence' end as reason from d""")
def country_decision(spark, table):
    sets = lambda k: F.expr(f"case {k} when 0 then array('ES') when 1 then array('DE') when 2 then array('DE', 'ES') else cast(array() as array<string>) end")
    s = table("supplier").select("s_suppkey", sets("s_suppkey % 5").alias("strong"), F.expr("s_suppkey % 7 = 0").alias("no_row"), sets("s_nationkey % 4").alias("medium"), F.expr("s_suppkey % 3 = 0").alias("other"))
    return s.select("s_suppkey", evidence.decide_country(F.col("strong"), F.col("no_row"), F.col("medium"), F.col("other")).alias("d")).select("s_suppkey", "d.*")


@query("""
with e as (select doc_id, sha256(text) as hash, lower(trim(source)) as supplier, n_chars as total, doc_id % 2 = 0 as sent from documents where text is not null)
select e.doc_id, coalesce(h.other, c.other) as original, case when h.other is not null then 'hash' when c.other is not null then 'content' end as criterion from e
left join (select a.doc_id, max(b.doc_id) as other from e a join e b on a.hash = b.hash and b.sent and a.doc_id <> b.doc_id group by 1) h using (doc_id)
left join (select a.doc_id, max(b.doc_id) as other from e a join e b on a.supplier = b.supplier and a.total = b.total and b.sent and a.doc_id <> b.doc_id group by 1) c using (doc_id)""")
def duplicates(spark, table):
    docs = table("documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("hash"), text.supplier_normalised(F.col("source")).alias("supplier"), F.col("n_chars").alias("total"))
    return records.duplicates(docs, "doc_id", ["supplier", "total"], F.expr("doc_id % 2 = 0"), [F.col("doc_id").desc()])


_NAMES = ["totalDue", "Total a pagar", "custName", "order key", "p_name", "Betrag gesamt", "iva"]


@query(f"""
with n as (select distinct lower(regexp_replace(p_name, '[^A-Za-z0-9]+', ' ', 'g')) as a from part), t as (select unnest({["total due", "total a pagar", "cust name", "order key", "p name", "betrag gesamt", "iva"]}) as b),
p as (select a, b, case when length(a) >= length(b) then a else b end as lo, case when length(a) >= length(b) then b else a end as sh from n, t),
w as (select *, case when a = b then 1.0 when length(sh) / length(lo) >= 0.5 then (case when contains(lo, sh) then 0.9 else 1 - list_min([levenshtein(sh, substr(lo, k, length(sh))) for k in range(1, length(lo) - length(sh) + 2)]) / length(lo) end) else 1 - levenshtein(a, b) / length(lo) end as whole,
  2 * len(list_intersect(list_distinct(string_split(a, ' ')), list_distinct(string_split(b, ' ')))) / (len(list_distinct(string_split(a, ' '))) + len(list_distinct(string_split(b, ' ')))) as shared from p)
select a as name, b as term, round(cast(greatest(whole, shared) as double), 6) as score from w""")
def field_match_score(spark, table):
    names = table("part").select(text.name_normalised(F.col("p_name")).alias("name")).distinct()
    synonyms = F.array(*[text.name_normalised(F.lit(n)) for n in _NAMES])
    pairs = names.withColumn("term", F.explode(synonyms))
    return pairs.select("name", "term", F.round(text.similarity(F.col("name"), F.col("term")), 6).alias("score"))


@query("""
with f as (select l_orderkey, l_linenumber, l_orderkey % 4 > 0 as passed, case l_linenumber % 4 when 0 then 'doc_number' when 1 then 'amount' when 2 then 'supplier_name' else 'tax_id' end as kind, l_partkey % 3 > 0 as all_read from lineitem)
select l_orderkey, l_linenumber, case when not passed then 'failed' when all_read then 'passed' else 'nonConfirmatory' end as outcome,
  case when kind in ('doc_number', 'supplier_name') then 'amber' when not passed then 'red' when all_read then 'green' else 'amber' end as confidence from f""")
def confidence_case(spark, table):
    kind = F.expr("case l_linenumber % 4 when 0 then 'doc_number' when 1 then 'amount' when 2 then 'supplier_name' else 'tax_id' end")
    operands = F.when(F.expr("l_partkey % 3 > 0"), F.array(F.lit("read"), F.lit("from_xml"))).otherwise(F.array(F.lit("read"), F.lit("derived")))
    rows = table("lineitem").withColumn("outcome", confidence.check_outcome(F.expr("l_orderkey % 4 > 0"), operands))
    return rows.select("l_orderkey", "l_linenumber", "outcome", confidence.confidence(kind, F.col("outcome")).alias("confidence"))


@query("""
select l_orderkey, coalesce(bool_or(l_tax > 0.02), true) as needs_review from (select l_orderkey, case when l_linenumber % 2 = 0 then l_tax end as l_tax from lineitem) group by 1""")
def needs_review(spark, table):
    rows = table("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.expr("if(l_linenumber % 2 = 0, 'present', 'absent')")).alias("s"), F.collect_list(F.expr("if(l_tax > 0.02, 'amber', 'green')")).alias("c"))
    return rows.select("l_orderkey", confidence.needs_review(F.col("s"), F.col("c")).alias("needs_review"))


@query("""
with s as (select event_id, user_id, ts from events where event_type = 'purchase'), r as (select user_id, ts from events where event_type = 'signup')
select s.event_id, s.user_id, count(r.ts) as candidates, case count(r.ts) when 0 then 'create' when 1 then 'adopt' else 'ask' end as decision
from s left join r on r.user_id = s.user_id and r.ts <= s.ts and r.ts >= s.ts - interval 2 hours group by 1, 2""")
def reconcile_interval(spark, table):
    e = table("events")
    found = records.reconcile(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("made")), "user_id", "ts", "made", 7200)
    return found.select("event_id", "user_id", "candidates", "decision")


_STATES = list(records.TRANSITIONS)
_ALLOWED = " or ".join(f"(s = '{a}' and t in ({', '.join(repr(x) for x in b)}))" for a, b in records.TRANSITIONS.items())


_STATE_REPLAY = f"""
with recursive e as (select user_id, ({_STATES})[cast(event_id % 8 as int) + 1] as t, row_number() over (partition by user_id order by ts, event_id) as n from events),
r as (select user_id, 0 as n, 'pending' as s, 1 as revision, 0 as refused from (select distinct user_id from events)
  union all select r.user_id, e.n, case when ok then e.t else r.s end, r.revision + (case when ok then 1 else 0 end), r.refused + (case when ok then 0 else 1 end)
  from r join e on e.user_id = r.user_id and e.n = r.n + 1, lateral (select {_ALLOWED} as ok from (select r.s as s, e.t as t)) q)
select user_id, arg_max(s, n) as state, cast(max(revision) as bigint) as revision, cast(max(refused) as bigint) as refused from r group by 1"""


@query(_STATE_REPLAY)
def state_replay(spark, table):
    to = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("event_id") % 8 + 1).cast("int"))
    found = records.replay(table("events").select("user_id", "ts", "event_id", to.alias("to_state")), "user_id", ["ts", "event_id"])
    return found.select("user_id", "state", big("revision").alias("revision"), big("refused").alias("refused"))


@query("""
select o_custkey, o_orderkey from (select o_custkey, o_orderkey, coalesce(sum(case when o_orderkey % 7 = 0 then 1 else 0 end) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and 1 preceding), 0) as before from orders) where before = 0""")
def queue_prefix(spark, table):
    return records.queue_prefix(table("orders"), "o_custkey", ["o_orderdate", "o_orderkey"], F.expr("o_orderkey % 7 = 0")).select("o_custkey", "o_orderkey")


@query("""
with o as (select o_orderkey, (['queued', 'failed', 'uncertain', 'sent'])[cast(o_orderkey % 4 as int) + 1] as s, case when o_custkey % 2 = 0 then o_custkey end as r, cast(200 + o_orderkey % 8 * 50 + o_custkey % 5 as int) as h from orders)
select o_orderkey, case s when 'queued' then 'create' when 'failed' then (case when r is null then 'create' else 'resume' end) when 'uncertain' then (case when r is null then 'decide' else 'resume' end) else 'refused' end as plan,
  case when h between 200 and 299 then null when h in (401, 403) then 'auth' when h = 404 then 'gone' when h = 429 then 'throttled' when h >= 500 then 'server' else 'other' end as failure from o""")
def retry_plan(spark, table):
    state = F.element_at(F.array(*map(F.lit, ("queued", "failed", "uncertain", "sent"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    status = F.expr("200 + o_orderkey % 8 * 50 + o_custkey % 5")
    return table("orders").select("o_orderkey", records.retry_plan(state, F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey"))).alias("plan"), records.failure_of_status(status).alias("failure"))


@query("""
with w as (select conv_id, turn, trim(regexp_replace(lower(x), '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')) as word from (select conv_id, turn, unnest(string_split_regex(text, '\\s+')) as x from conversations)),
n as (select conv_id, turn, word, count(*) as n from w where word <> '' group by 1, 2, 3), s as (select conv_id, turn, sum(n) as size from n group by 1, 2),
p as (select a.conv_id, a.turn as t1, b.turn as t2, greatest(a.size, b.size) as larger from s a join s b on a.conv_id = b.conv_id and a.turn < b.turn),
m as (select a.conv_id, a.turn as t1, b.turn as t2, sum(least(a.n, b.n)) as shared from n a join n b on a.conv_id = b.conv_id and a.word = b.word and a.turn < b.turn group by 1, 2, 3)
select p.conv_id, cast(p.t1 as bigint) as pass_1, cast(p.t2 as bigint) as pass_2, cast(coalesce(m.shared, 0) as bigint) as shared, cast(p.larger as bigint) as larger from p left join m using (conv_id, t1, t2)""")
def pass_agreement(spark, table):
    words = table("conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pass_id"), F.explode(F.split("text", r"\s+")).alias("text"))
    found = evaluation.pass_agreement(words)
    return found.select(F.col("doc_id").alias("conv_id"), big("pass_1").alias("pass_1"), big("pass_2").alias("pass_2"), big("shared").alias("shared"), big("larger").alias("larger"))


@query("""
select source, lang, count(*) as documents, cast(sum(quality) as bigint) as good, round(avg(toxic), 6) as toxic_share, cast(grouping(source) as bigint) as over_sources, cast(grouping(lang) as bigint) as over_langs
from documents join labels using (doc_id) group by grouping sets ((source, lang), (source), ())""")
def fidelity_grouping_sets(spark, table):
    rows = table("documents").select("doc_id", "source", "lang").join(table("labels"), "doc_id")
    return evaluation.by_levels(rows, [["source", "lang"], ["source"], []], {"documents": F.count("*"), "good": big(F.sum("quality")), "toxic_share": F.round(F.avg("toxic"), 6), "over_sources": big(F.grouping("source")), "over_langs": big(F.grouping("lang"))})


@query("""
with p as (select page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) as host, length(regexp_replace(html, '<[^>]*>', '', 'g')) >= 200 as has_text from pages)
select host, case when bool_and(has_text) then 'pdf-text' when bool_or(has_text) then 'pdf-mixed' else 'pdf-ocr' end as route, count(*) as pages from p group by 1""")
def route_select(spark, table):
    rows = table("pages").select(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), (F.length(F.regexp_replace("html", "<[^>]*>", "")) >= 200).alias("has_text"))
    return rows.groupBy("host").agg(evidence.route(F.col("has_text")).alias("route"), F.count("*").alias("pages"))


@query("""
select event_id, json_valid(props) as valid, cast(len(json_keys(props)) as bigint) as n_keys from events where props is not null""")
def props_json(spark, table):
    rows = table("events").filter("props is not null").withColumn("v", F.try_parse_json("props"))
    return rows.select("event_id", F.col("v").isNotNull().alias("valid"), big(F.size(F.json_object_keys("props"))).alias("n_keys"))


@query("""
select s_suppkey, nullif(lower(regexp_replace(trim(raw), '\\s+', ' ', 'g')), '') as supplier, translate(lower(raw), 'áàâäãåéèêëíìîïóòôöõúùûüñçýÿ', 'aaaaaaeeeeiiiiooooouuuuncyy') as folded
from (select s_suppkey, '  ' || replace(s_name, '#', '   É# ') || case when s_suppkey % 9 = 0 then ' Ñandú' else '' end as raw from supplier)""")
def supplier_normalise(spark, table):
    raw = F.concat(F.lit("  "), F.replace("s_name", F.lit("#"), F.lit("   É# ")), F.expr("if(s_suppkey % 9 = 0, ' Ñandú', '')"))
    return table("supplier").select("s_suppkey", text.supplier_normalised(raw).alias("supplier"), text.folded(raw).alias("folded"))


#: Line numbers repeat within an order; this tells its lines apart.
_ORDER = "l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey * 100 + cast(l_quantity as bigint)"
_LABEL, _AMOUNT = "l_linenumber % 2 = 1", "case when l_quantity > 30 then cast(l_quantity as bigint) end"


@query(f"""
with x as (select l_orderkey, {_ORDER} as line, {_LABEL} as label, {_AMOUNT} as amount, row_number() over (partition by l_orderkey order by {_ORDER}) as n from lineitem),
y as (select a.l_orderkey, a.line, a.n, a.amount, min(b.n) filter (b.amount is not null) as near, min(b.n) filter (b.label) as barrier from x a left join x b on a.l_orderkey = b.l_orderkey and b.n between a.n + 1 and a.n + 3 where a.label group by 1, 2, 3, 4)
select y.l_orderkey, y.line, coalesce(y.amount, case when barrier is null or near < barrier then x.amount end) as value from y left join x on x.l_orderkey = y.l_orderkey and x.n = y.near""")
def lookahead(spark, table):
    rows = table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.expr(_ORDER).alias("line"))
    return heuristics.lookahead(rows, "l_orderkey", "line", F.expr(_LABEL), F.expr(_AMOUNT)).select("l_orderkey", "line", "value")


@query(f"""
with v as (select l_orderkey, l_returnflag as flag, count(*) as votes, min({_ORDER}) as f from lineitem group by 1, 2)
select l_orderkey, flag, votes from v qualify row_number() over (partition by l_orderkey order by votes desc, f) = 1""")
def majority_vote(spark, table):
    return heuristics.majority(table("lineitem").select("l_orderkey", F.col("l_returnflag").alias("flag"), F.expr(_ORDER).alias("line")), ["l_orderkey"], "flag", "line")


@query(f"""
with a as (select l_orderkey, {_MINOR.format('l_extendedprice')} * (case when l_partkey % 7 = 0 then 1000 else 1 end) as m from lineitem), d as (select l_orderkey, quantile_disc(m, 0.5) as median from a group by 1)
select l_orderkey, cast(median as bigint) as median, cast(max(m) as bigint) as largest from a join d using (l_orderkey) where m <= 50 * median group by 1, 2""")
def outlier_cut(spark, table):
    rows = table("lineitem").select("l_orderkey", (minor("l_extendedprice") * F.expr("if(l_partkey % 7 = 0, 1000, 1)")).alias("m"))
    return heuristics.without_outliers(rows, "l_orderkey", "m").select("l_orderkey", big("median").alias("median"), big("largest").alias("largest"))


@query("""
with n as (select conv_id, turn, len(regexp_extract_all(text, '\\p{L}{3,}')) as words from conversations where text is not null)
select conv_id, cast(turn as bigint) as turn, cast(words as bigint) as words from n qualify row_number() over (partition by conv_id order by words desc, turn) = 1""")
def best_pass(spark, table):
    found = heuristics.best_pass(table("conversations").filter("text is not null"), "conv_id", "turn", "text")
    return found.select("conv_id", big("turn").alias("turn"), big("words").alias("words"))


_STATUS = "case when l_partkey % 5 = 0 then 201 when l_partkey % 5 = 1 then 404 when l_partkey % 5 = 2 then 429 else 503 end"


@query(f"""
with a as (select l_orderkey, {_STATUS} as s, row_number() over (partition by l_orderkey order by {_ORDER}) as n from lineitem),
e as (select l_orderkey, coalesce(min(n) filter (not (s = 429 or s >= 500) or n = 4), max(n)) as n from a group by 1)
select l_orderkey, case when s between 200 and 299 then 'sent' when (s = 429 or s >= 500) and a.n < 4 then 'queued' else 'failed' end as outcome, cast(a.n as bigint) as attempts,
  cast(case when (s = 429 or s >= 500) and a.n < 4 then power(2, a.n) - 1 else power(2, a.n - 1) - 1 end as bigint) as waited from a join e using (l_orderkey, n)""")
def scripted_send(spark, table):
    found = heuristics.scripted_send(table("lineitem").select("l_orderkey", F.expr(_ORDER).alias("line"), F.expr(_STATUS).alias("s")), "l_orderkey", "line", "s")
    return found.select("l_orderkey", "outcome", big("attempts").alias("attempts"), big("waited").alias("waited"))


@query("""
select o_custkey, count(*) filter (o_orderkey % 3 = 0) as done, count(*) filter (o_orderkey % 3 <> 0) as open, count(*) filter (o_orderkey % 3 <> 0 and d > 0) as late,
  coalesce(max(case when o_orderkey % 3 <> 0 and d > 0 then d end), 0) as most_days_late from (select *, datediff('day', cast(o_orderdate as date), date '1996-01-01') as d from orders) group by 1""")
def board(spark, table):
    late = F.datediff(F.lit("1996-01-01").cast("date"), F.to_date("o_orderdate")).cast("bigint")
    return heuristics.board(table("orders"), "o_custkey", F.expr("o_orderkey % 3 = 0"), late)


@query("""
select doc_id, text as repaired from documents""")
def repaired_text(spark, table):
    return table("documents").select("doc_id", heuristics.repaired_text(heuristics.misread_text(F.col("text"))).alias("repaired"))


def order_pages(table) -> DataFrame:
    """A page of words for each order: base, tax and total, and for every fifth a tip that is no total.

    Every fourteenth prints the rate without an amount, and the other seventh neither.
    """
    m = minor("o_totalprice")
    eur = lambda c: F.concat(F.expr(f"cast({c} div 100 as string)"), F.lit(","), F.lpad(F.expr(f"cast({c} % 100 as string)"), 2, "0"))
    rows = table.spread("orders").select(F.col("o_orderkey").alias("doc_id"), m.alias("b")).withColumn("t", F.expr("(b * 21 + 50) div 100")).withColumn("g", F.expr("b + t"))
    lines = F.array(
        F.concat(F.lit("BASE "), eur("b")), F.when(F.expr("doc_id % 7 > 0"), F.concat(F.lit("IVA 21 % "), eur("t"))).when(F.expr("doc_id % 14 = 0"), "IVA 21 %"), F.concat(F.lit("TOTAL "), eur("g")),
        F.when(F.expr("doc_id % 5 = 0"), F.lit("TOTAL propina 9,99")),
    )
    line = rows.select("doc_id", F.posexplode(lines).alias("k", "line")).filter("line is not null")
    word = line.select("doc_id", "k", F.posexplode(F.split("line", " ")).alias("n", "text"))
    at = lambda c: F.expr(c).cast("int")
    return word.select("doc_id", F.lit("p").alias("pass_id"), F.lit(0).alias("page_index"), at("k * 10 + n").alias("word_no"), "text", at("n * 90000").alias("x0"), at("n * 90000 + 80000").alias("x1"), at("k * 60000").alias("top"), at("k * 60000 + 10000").alias("bottom"))


@query(f"""
select o_orderkey as doc_id, case when o_orderkey % 7 > 0 then 'read' when o_orderkey % 14 = 0 then 'derived' else 'single' end as outcome, m + (m * 21 + 50) // 100 as gross, m as net,
  case when o_orderkey % 7 > 0 or o_orderkey % 14 = 0 then (m * 21 + 50) // 100 end as tax, o_orderkey % 7 = 0 as needs_review
from (select o_orderkey, {_MINOR.format('o_totalprice')} as m from orders)""")
def text_route(spark, table):
    found = extract.extract(order_pages(table), dims.terms(spark))
    return found.select("doc_id", "outcome", "gross", "net", "tax", "needs_review")


@query(f"""
with o as (select o_orderkey, cast(o_orderdate as date) as d, {_MINOR.format('o_totalprice')} as m from orders)
select o_orderkey as doc_id, case when year(d) >= 2000 then d end as date, m / 100.0::double as net, (m * 21 + 50) // 100 / 100.0::double as vat, (m + (m * 21 + 50) // 100) / 100.0::double as gross, 21.0::double as rate, 'arithmetic' as via from o""")
def photo_read(spark, table):
    """Receipts printed from orders, read by labels and by arithmetic; see the tests for a plain equivalent."""
    m = minor("o_totalprice")
    eur = lambda c: F.concat(F.expr(f"cast({c} div 100 as string)"), F.lit(","), F.lpad(F.expr(f"cast({c} % 100 as string)"), 2, "0"))
    rows = table.spread("orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), m.alias("base")).withColumn("tax", F.expr("(base * 21 + 50) div 100")).withColumn("gross", F.expr("base + tax"))
    text_ = F.concat(F.lit("FACTURA SIMPLIFICADA\nFECHA "), F.date_format("d", "dd/MM/yyyy"), F.lit("\nBASE "), eur("base"), F.lit("\nIVA 21% "), eur("tax"), F.lit("\nTOTAL "), eur("gross"))
    return photo.read_receipts(rows.select(F.col("o_orderkey").alias("doc_id"), text_.alias("text")), dims.COUNTRIES["ES"]["rates"])


@query(_STATE_REPLAY)
def history_stream(spark, table):
    """The last state of each user's document, from events read as a stream; equals state_replay where events arrive in order."""
    return history.replay_stream(spark, f"{table.dir}/events.parquet", table("events").schema, _STATES)


@query("""
with e as (select *, event_id % 2 as half, cast(day(ts) as bigint) as d from events), s as (select * from e where event_type = 'purchase'), r as (select * from e where event_type = 'signup')
select s.event_id, s.user_id, count(r.ts) as candidates, case count(r.ts) when 0 then 'create' when 1 then 'adopt' else 'ask' end as decision
from s left join r on r.user_id = s.user_id and r.ts <= s.ts and r.ts >= s.ts - interval 2 hours and r.half = s.half and r.d = s.d group by 1, 2""")
def reconcile_fields(spark, table):
    """reconcile_interval with every sent field equal as well."""
    e = table("events").withColumn("fields", F.create_map(F.lit("half"), F.col("event_id") % 2, F.lit("day"), F.dayofmonth("ts").cast("bigint")))
    sent, made = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts", "fields"), e.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("made"), "fields")
    return records.reconcile(sent, made, "user_id", "ts", "made", 7200, "fields").select("event_id", "user_id", "candidates", "decision")


@query(f"""
with v as (select l_orderkey, l_returnflag as flag, count(*) as votes, min({_ORDER}) as f from lineitem group by 1, 2),
n as (select *, row_number() over (partition by l_orderkey order by votes desc, f) as n, sum(votes) over (partition by l_orderkey) as total from v)
select l_orderkey, max(flag) filter (n = 1) as flag, max(votes) filter (n = 1) as votes, cast(max(total) as bigint) as "of", max(votes) = max(total) as unanimous,
  max(flag) filter (n = 2) as second, max(votes) filter (n = 2) as second_votes, max(flag) filter (n = 3) as third, max(votes) filter (n = 3) as third_votes from n group by 1""")
def plurality_vote(spark, table):
    found = heuristics.plurality(table("lineitem").select("l_orderkey", F.col("l_returnflag").alias("flag"), F.expr(_ORDER).alias("line")), ["l_orderkey"], "flag", "line")
    at = lambda k, c: F.get("runners_up", F.lit(k))[c]
    return found.select("l_orderkey", "flag", "votes", "of", "unanimous", at(0, "flag").alias("second"), at(0, "votes").alias("second_votes"), at(1, "flag").alias("third"), at(1, "votes").alias("third_votes"))
