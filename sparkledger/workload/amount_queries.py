"""Queries over amounts, dates, ids and meta: NRM*, UDF1."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import MINUS_SIGNS
from ..functions.amounts import (
    amount,
    credit_debit_amount,
    direction_amount,
    eu_number,
    try_amount,
    us_number,
    with_amount_parser,
)
from ..functions.dates import best_format, date_shape, date_text, format_counts, parse_date, readable_text
from ..functions.identity import json_names, random_id, row_json, transaction_id
from ..functions.text import strip_text
from ..operators.normalize import number_occurrences
from ..plans.statements import normalize_statements
from . import views as V
from .registry import query, table

# Prices as text in several notations; the SQL twin is the price itself.
_SIGNED = "CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END"


def _order_texts(spark, d):
    o = V.orders_by_file(spark, d)
    whole, cents = F.floor(F.col("cents") / 100), F.lpad((F.col("cents") % 100).cast("string"), 2, "0")
    us = F.concat(V._grouped(whole, ","), F.lit("."), cents)
    eu = F.concat(V._grouped(whole, "."), F.lit(","), cents)
    sign = F.when(F.col("outgoing"), F.element_at(F.array(F.lit("-"), F.lit("−"), F.lit("–")), (F.col("slot") % 3 + 1).cast("int")))
    sign = F.coalesce(sign, F.lit(""))
    return o.withColumns({"us": us, "eu": eu, "sign": sign})


# What is left of a text when all but digits, signs and marks goes, read as a number.
_BARE_SQL = f"replace(regexp_replace(translate(text, '{MINUS_SIGNS}', '{'-' * len(MINUS_SIGNS)}'), '[^\\p{{Nd}}.,\\-]', '', 'g'), ',', '')"


@query("nrm1_us_amount", f"""SELECT o_orderkey, {_SIGNED} AS amount FROM orders UNION ALL SELECT -1 - doc_id,
 coalesce(CASE WHEN regexp_full_match(bare, '[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN try_cast(bare AS double) END, 0.0)
 FROM (SELECT doc_id, {_BARE_SQL} AS bare FROM documents)""")
def nrm1(spark, d):
    """'$-1,234.56' and the like; whole documents too, most of which are no number and count as 0."""
    texts = _order_texts(spark, d).select(
        "o_orderkey", F.concat(F.lit("USD "), F.col("sign"), F.col("us"), F.lit(" $")).alias("v")
    )
    words = table(spark, d, "documents").select((-1 - F.col("doc_id")).alias("o_orderkey"), F.col("text").alias("v"))
    return texts.unionByName(words).select("o_orderkey", F.coalesce(us_number(F.col("v")), F.lit(0.0)).alias("amount"))


@query("nrm2_eu_amount", f"SELECT o_orderkey, {_SIGNED} AS amount FROM orders")
def nrm2(spark, d):
    v = F.concat(F.col("sign"), F.lit("€ "), F.col("eu"), F.lit(" EUR"))
    return _order_texts(spark, d).select("o_orderkey", F.coalesce(eu_number(v), F.lit(0.0)).alias("amount"))


@query("nrm3_amount_by_locale", f"SELECT o_orderkey, {_SIGNED} AS amount, true AS amount_ok FROM orders")
def nrm3(spark, d):
    """The separator of each row decides; plain numeric columns skip the locale."""
    t = _order_texts(spark, d).withColumn("sep", F.when(F.col("slot") % 2 == 0, ".").otherwise(","))
    plain = F.col("slot") % 4 == 1
    bare = F.concat(F.when(F.col("outgoing"), "-").otherwise(""), F.replace(F.col("us"), F.lit(","), F.lit("")))
    t = t.withColumns({"plain": plain, "v": F.when(plain, bare).when(F.col("sep") == ".", F.concat("sign", "us")).otherwise(F.concat("sign", "eu"))})
    return t.select(
        "o_orderkey",
        amount(F.col("v"), F.col("sep"), F.col("plain")).alias("amount"),
        try_amount(F.col("v"), F.col("sep"), F.col("plain")).isNotNull().alias("amount_ok"),
    )


@query("nrm4_signed", f"SELECT statement_id, sum({_SIGNED}::decimal(18,2))::double AS total FROM (SELECT *, o_custkey AS statement_id FROM orders) GROUP BY 1")
def nrm4(spark, d):
    """Signed column; statement totals per customer."""
    t = _order_texts(spark, d)
    value = amount(F.concat("sign", "us"), F.lit("."))
    return t.groupBy(F.col("o_custkey").alias("statement_id")).agg(
        F.sum(value.cast("decimal(18,2)")).cast("double").alias("total")
    )


@query("nrm5_direction", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN -abs(value) ELSE abs(value) END AS amount FROM events")
def nrm5(spark, d):
    e = table(spark, d, "events")
    text = F.concat(F.lit("  "), F.upper("event_type"), F.lit(" (web) "))
    return e.select("event_id", direction_amount(F.col("value"), text, F.lit("Purchase")).alias("amount"))


@query("nrm6_credit_debit", "SELECT event_id, CASE WHEN event_type IN ('purchase', 'error') THEN -value ELSE value END AS amount FROM events")
def nrm6(spark, d):
    out = F.col("event_type").isin("purchase", "error")
    text = F.col("value").cast("decimal(18,2)").cast("string")
    credit, debit = F.when(~out, text), F.when(out, F.concat(F.lit("-"), text))
    parsed = lambda c: amount(c, F.lit("."))
    return table(spark, d, "events").select("event_id", credit_debit_amount(parsed(credit), parsed(debit)).alias("amount"))


@query("nrm7_strict_amounts", """
SELECT event_id, value AS signed, CASE WHEN event_type = 'purchase' THEN -value ELSE value END AS direction,
 CASE event_type WHEN 'view' THEN value WHEN 'click' THEN value ELSE -value END AS credit_debit, 0.0 AS unreadable FROM events""")
def nrm7(spark, d):
    """Strict variant: equality for the direction, credit wins, no symbol cleaning."""
    text = F.replace(F.col("value").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    parsed = lambda c: amount(c, F.lit(","), mode="strict")
    kind = F.col("event_type")
    credit = F.when(kind.isin("view", "click"), text)
    debit = F.when(kind != "view", text)
    return table(spark, d, "events").select(
        "event_id",
        parsed(F.concat(F.lit(" "), text)).alias("signed"),
        direction_amount(parsed(text), F.when(kind == "error", F.lit(" PURCHASE ")).otherwise(kind), F.lit("Purchase"), "strict").alias("direction"),
        credit_debit_amount(parsed(credit), parsed(debit), "strict").alias("credit_debit"),
        parsed(F.concat(F.lit("€"), text)).alias("unreadable"),
    )




@query("nrm8_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders UNION ALL SELECT -1 - doc_id, NULL FROM documents")
def nrm8(spark, d):
    """One format per customer's statement, found from its rows; other text gives null."""
    o = table(spark, d, "orders")
    kinds = ["yyyy-MM-dd", "yyyyMMdd", "dd.MM.yyyy", "MM/dd/yyyy", "dd-MM-yyyy"]
    kind = (F.col("o_custkey") % 5).cast("int")
    written = F.element_at(F.array(*[F.date_format("o_orderdate", k) for k in kinds]), kind + 1)
    written = F.when(kind == 1, F.concat(written, F.lit(".0"))).otherwise(written)
    rows = o.select("o_orderkey", F.col("o_custkey").alias("statement_id"), written.alias("v"), kind.isin(2, 4).alias("day_first"))
    words = table(spark, d, "documents").select(
        (-1 - F.col("doc_id")).alias("o_orderkey"), F.lit(-1).cast("bigint").alias("statement_id"), F.col("text").alias("v"), F.lit(True).alias("day_first")
    )
    texts = rows.unionByName(words).withColumn("text", date_text(F.col("v"))).withColumn("shape", date_shape(F.col("text")))
    counts = texts.groupBy("statement_id").agg(F.bool_or("day_first").alias("day_first"), *format_counts(F.col("text"), F.col("shape")))
    best = counts.select("statement_id", best_format(F.col("day_first")).alias("date_format"))
    # What goes to its statement's format is the dates, not the documents.
    text = readable_text(F.col("text"), F.col("shape"))
    dated = texts.select("o_orderkey", "statement_id", text.alias("text"), F.when(text.isNotNull(), F.col("shape")).alias("shape"))
    parsed = parse_date(F.col("text"), F.col("shape"), F.col("date_format"))
    return dated.join(best, "statement_id").select("o_orderkey", F.date_format(parsed, "yyyy-MM-dd").alias("date"))


@query("nrm8_spelled_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders")
def nrm8_spelled(spark, d):
    """Order dates with weekday and month spelled in five languages, or as ISO weeks, read back."""
    o = table(spark, d, "orders")
    months = [
        "January February March April May June July August September October November December",
        "januari februari maart april mei juni juli augustus september oktober november december",
        "Januar Februar März April Mai Juni Juli August September Oktober November Dezember",
        "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
        "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
    ]
    days = ["Monday Tuesday Wednesday Thursday Friday Saturday Sunday", "ma di wo do vr za zo", "Mo Di Mi Do Fr Sa So", "lun mar mer jeu ven sam dim", "lunes martes miércoles jueves viernes sábado domingo"]
    pick = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names.split()]), at)
    day, year = F.dayofmonth("o_orderdate").cast("string"), F.year("o_orderdate").cast("string")
    month, weekday = [pick(m, F.month("o_orderdate")) for m in months], [pick(w, F.weekday("o_orderdate") + 1) for w in days]
    week = F.concat(F.expr("extract(YEAROFWEEK FROM o_orderdate)").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("o_orderdate").cast("string"), 2, "0"), F.lit("-"), (F.weekday("o_orderdate") + 1).cast("string"))
    written = [
        F.concat(weekday[0], F.lit(", "), month[0], F.lit(" "), day, F.lit(", "), year),
        F.concat(weekday[1], F.lit(" "), day, F.lit(" "), month[1], F.lit(" "), year),
        F.concat(weekday[2], F.lit("., "), day, F.lit(". "), month[2], F.lit(" "), year),
        F.concat(weekday[3], F.lit(". "), day, F.lit(" "), month[3], F.lit(" "), year),
        F.concat(weekday[4], F.lit(", "), day, F.lit(" de "), month[4], F.lit(" de "), year, F.lit(" 10:30")),
        week,
    ]
    rows = o.select("o_orderkey", F.element_at(F.array(*written), (F.col("o_custkey") % 6).cast("int") + 1).alias("v"))
    return rows.select("o_orderkey", F.substring(date_text(F.col("v")), 1, 10).alias("date"))


ID_SQL = """
, ids AS (SELECT *, sha256(strftime(date, '%Y-%m-%d %H:%M:%S') || amount::decimal(18,2)::varchar || description) AS h FROM txn)"""
UUID_SQL = "h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32]"


@query("nrm9_transaction_id", f"WITH {V.TRANSACTIONS_SQL}{ID_SQL} SELECT line_no, {UUID_SQL} AS transaction_id FROM ids")
def nrm9(spark, d):
    return V.transactions(spark, d).select(
        "line_no", transaction_id(F.col("date"), F.col("amount"), F.col("description")).alias("transaction_id")
    )


@query("nrm9_occurrence", """
WITH e AS (SELECT user_id AS statement_id, event_type AS transaction_id, event_id AS line_no FROM events)
SELECT *, row_number() OVER (PARTITION BY statement_id, transaction_id ORDER BY line_no) AS occurrence FROM e""")
def nrm9_occurrence(spark, d):
    rows = V.event_rows(spark, d).select("statement_id", F.col("description").alias("transaction_id"), "line_no")
    return number_occurrences(rows)


@query("nrm10_random_id", "SELECT count(*) AS n_rows, count(*) AS n_ids, 36::bigint AS id_length FROM orders")
def nrm10(spark, d):
    """Random ids differ from run to run: counted, not compared."""
    ids = table(spark, d, "orders").select("o_orderkey", random_id().alias("id"))
    return ids.agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("id").alias("n_ids"), F.max(F.length("id")).cast("bigint").alias("id_length")
    )


@query("nrm11_description", r"SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS description FROM documents UNION ALL SELECT -1 - page_id, NULL FROM pages")
def nrm11(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("\t "), F.col("text"), F.lit(" \r\n")).alias("v"))
    nulls = table(spark, d, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.lit(None).cast("string").alias("v"))
    return docs.unionByName(nulls).select("doc_id", strip_text(F.col("v")).alias("description"))


@query("nrm12_meta_json", """
WITH o AS (SELECT * FROM orders)
SELECT o_orderkey, '{"Date":"' || strftime(o_orderdate, '%Y-%m-%d') || '","Amount":' || o_totalprice::decimal(18,2)::varchar
 || ',"Text \\"quoted\\"":"' || o_orderpriority || '","Empty":null}' AS meta FROM o""")
def nrm12(spark, d):
    names = F.array(*[F.lit(n) for n in ("Date", "Amount", 'Text "quoted"', "Empty")])
    values = F.array(
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
        F.col("o_orderpriority"), F.lit(None).cast("string"),
    )
    flags = F.array(*[F.lit(b) for b in (False, True, False, True)])
    return table(spark, d, "orders").select("o_orderkey", row_json(json_names(names), values, flags).alias("meta"))


@query("nrm12_statement_meta", "WITH " + V.ORDERS_BY_FILE_SQL + f"""
 SELECT statement_id, slot + CASE style WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 2 END AS line_no,
 CASE style WHEN 0 THEN '{{"Date":"' || strftime(o_orderdate, '%Y-%m-%d') || '","Amount":'
     || CASE WHEN all_small THEN {V._SIGN} || {V._US} ELSE '"' || {V._SIGN} || {V._US} || '"' END || ',"Description":"' || description || '"}}'
  WHEN 1 THEN '{{"Transactiedatum":"' || strftime(o_orderdate, '%d-%m-%Y') || '","Omschrijving":"' || description || '","Transactiebedrag":"' || {V._SIGN} || {V._EU} || '"}}'
  WHEN 2 THEN '{{"Datum":"' || strftime(o_orderdate, '%d.%m.%Y') || '","Betrag":"' || {V._EU} || '","Type":"' || CASE WHEN outgoing THEN 'Debit' ELSE 'Credit' END || '","Verwendungszweck":"' || description || '"}}'
  ELSE '{{"Date":"' || strftime(o_orderdate, '%m/%d/%Y') || '","Description":"' || description || '","Credit":'
     || CASE WHEN outgoing THEN 'null,"Debit":' || {V._PLAIN} ELSE {V._PLAIN} || ',"Debit":null' END || '}}' END AS meta
 FROM o JOIN (SELECT statement_id, bool_and(cents < 100000) AS all_small FROM o GROUP BY 1) USING (statement_id)""")
def nrm12_statement(spark, d):
    """Meta of whole statements; numeric columns print as numbers."""
    return normalize_statements(V.statement_lines(spark, d)).select("statement_id", "line_no", "meta")


@query("udf1_amount_parser", "SELECT o_orderkey, o_totalprice AS amount FROM orders")
def udf1(spark, d):
    """A caller's own parser: apostrophes as thousands marks (1'234.56)."""
    parsers = with_amount_parser("'", lambda c: us_number(F.replace(c, F.lit("'"), F.lit(""))))
    swiss = F.concat(F.lit("CHF "), F.replace(F.col("us"), F.lit(","), F.lit("'")))
    return _order_texts(spark, d).select("o_orderkey", amount(swiss, F.lit("'"), parsers=parsers).alias("amount"))
