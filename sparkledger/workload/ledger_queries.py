"""Queries over ledgers and validation: LED*, AGG5, AGG8, VAL*, SET2, PRJ4, PRJ5, UDF4, STR1."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_text
from ..functions.trades import is_investment, trade_details
from ..operators.entities import alias_table, match_aliases, register_entities
from ..operators.ledger import (
    balances,
    category_as_account,
    generate_splits,
    harmonize_items,
    investment_splits,
    standard_splits,
)
from ..operators.quality import collect_errors, count_failures, mark_quarantine, split_quarantine
from ..plans.statements import statements_to_ledger
from ..sources.statements import write_statements
from ..sources.tables import VersionedTable
from ..streaming.ingest import Learner, ingest_statements
from . import views as V
from .registry import query, table
from .statement_queries import work_dir

TRADES = "WITH " + V.TRADES_SQL


def _day(df):
    return df.withColumn("date", F.date_format("date", "yyyy-MM-dd"))


# One ledger in SQL: the bank side, then the other side.
def splits_sql(standard_only: bool = False) -> str:
    trade = "false" if standard_only else "l_returnflag IN ('A', 'R')"
    return f"""
, sides AS (
 SELECT transaction_id, strftime(date, '%Y-%m-%d') AS date, description, 'Assets:Current:Bank' AS account, amount, 'EUR' AS currency FROM trades
 UNION ALL SELECT transaction_id, strftime(date, '%Y-%m-%d'),
  CASE WHEN {trade} THEN CASE l_returnflag WHEN 'A' THEN 'Buy ' ELSE 'Verkoop ' END || q || '.0 ' || ticker || ' @ ' ELSE description END,
  CASE WHEN {trade} THEN 'Assets:Investments:' || ticker ELSE coalesce(account, 'Expenses:Uncategorized') END,
  CASE WHEN {trade} THEN l_quantity * CASE l_returnflag WHEN 'A' THEN 1 ELSE -1 END ELSE -amount END,
  CASE WHEN {trade} THEN ticker ELSE 'EUR' END FROM trades)"""


# The price at the end of a security text is compared as a number in LED2, not as text here.
SIDES = " SELECT transaction_id, date, description, account, amount, currency, NULL::double AS price FROM sides"


def _sides(df):
    text = F.when(F.col("account").startswith("Assets:Investments:"), F.regexp_replace("description", r"@ [0-9.]+$", "@ ")).otherwise(F.col("description"))
    return _day(df).withColumn("description", text).select("transaction_id", "date", "description", "account", "amount", "currency", "price")


@query("led1_detect_investment", TRADES + ", texts AS (SELECT transaction_id AS id, description FROM trades UNION ALL SELECT doc_id::varchar, text FROM documents) "
       "SELECT id, regexp_matches(lower(description), 'buy|purchase|koop|aankoop|achat|kaufen|sell|sold|verkoop|vente|verkaufen') AS investment FROM texts")
def led1(spark, d):
    t = V.trades(spark, d).select(F.col("transaction_id").alias("id"), "description")
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("description"))
    return t.unionByName(docs).select("id", is_investment(F.col("description")).alias("investment"))


@query("led2_trade_details", TRADES + """ SELECT transaction_id, CASE l_returnflag WHEN 'A' THEN 'Buy' WHEN 'R' THEN 'Verkoop' END AS action,
 CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS quantity, CASE WHEN l_returnflag <> 'N' THEN ticker END AS ticker,
 CASE WHEN l_returnflag <> 'N' THEN l_extendedprice END AS price FROM trades""")
def led2(spark, d):
    """Texts made from line items give the line items back."""
    return V.trades(spark, d).select("transaction_id", trade_details(F.col("description")).alias("t")).select("transaction_id", "t.*")


@query("led3_standard_splits", TRADES + splits_sql(True) + SIDES)
def led3(spark, d):
    return _sides(standard_splits(V.trades(spark, d)))


@query("led4_investment_splits", TRADES + splits_sql() + SIDES)
def led4(spark, d):
    return _sides(investment_splits(V.trades(spark, d)))


@query("led5_generate_splits", TRADES + splits_sql() + SIDES)
def led5(spark, d):
    return _sides(generate_splits(V.trades(spark, d)))


@query("udf4_row_to_rows", TRADES + splits_sql() + " SELECT account, count(*) AS n_rows, sum(amount::decimal(18,2))::double AS total FROM sides GROUP BY 1")
def udf4(spark, d):
    """Rows made by the splitter, totalled by account."""
    s = generate_splits(V.trades(spark, d))
    return s.groupBy("account").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.col("amount").cast("decimal(18,2)")).cast("double").alias("total"))


@query("agg8_balances", TRADES + splits_sql() + " SELECT transaction_id, currency, sum(amount::decimal(18,2))::double AS balance, count(*) AS n_splits FROM sides GROUP BY 1, 2")
def agg8(spark, d):
    return balances(generate_splits(V.trades(spark, d))).withColumn("balance", F.col("balance").cast("double"))


@query("prj4_harmonized_items", "SELECT o_orderkey AS transaction_id, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS description FROM orders")
def prj4(spark, d):
    items = table(spark, d, "orders").withColumn("Datum", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return harmonize_items(items, "Datum", "o_orderpriority").select(F.col("o_orderkey").alias("transaction_id"), "date", "description")


@query("prj5_category_as_account", "SELECT o_orderkey, CASE o_orderpriority WHEN '2-HIGH' THEN NULL ELSE o_orderpriority END AS account FROM orders WHERE o_orderpriority <> '5-LOW'")
def prj5(spark, d):
    """Skipped rows leave; rows without a category stay."""
    p = F.col("o_orderpriority")
    category = F.when(p == "5-LOW", "Skipped").when(p != "2-HIGH", p)
    return category_as_account(table(spark, d, "orders").withColumn("category", category)).select("o_orderkey", "account")


# --- validation -------------------------------------------------------------

def _flawed(spark, d):
    """The trade ledger with missing values spread over it, whole numbers of NaN included."""
    s = generate_splits(V.trades(spark, d))
    bank = F.col("account") == "Assets:Current:Bank"
    return s.withColumns(
        {
            "amount": F.when(bank & (F.col("amount") > 90000), F.lit(float("nan"))).otherwise(F.col("amount")),
            "date": F.when(F.col("description") != "Salary", F.col("date")),
            "currency": F.when(F.col("currency") != "TKAA", F.col("currency")),
            "transaction_id": F.when(F.col("transaction_id").endswith("1-1"), F.lit("")).otherwise(F.col("transaction_id")),
        }
    )


FLAWED_SQL = TRADES + splits_sql() + """
, flawed AS (SELECT CASE WHEN transaction_id LIKE '%1-1' THEN '' ELSE transaction_id END AS transaction_id, account, amount,
  account = 'Assets:Current:Bank' AND amount > 90000 AS bad_amount, description = 'Salary' AS bad_date, currency = 'TKAA' AS bad_currency,
  transaction_id LIKE '%1-1' AS bad_id FROM sides),
checked AS (SELECT *, array_to_string(list_filter([CASE WHEN bad_date THEN 'date: not_null' END, CASE WHEN bad_amount THEN 'amount: not_null' END,
  CASE WHEN bad_currency THEN 'currency: not_null' END, CASE WHEN bad_id THEN 'transaction_id: not_empty' END], lambda e: e IS NOT NULL), '; ') AS errors FROM flawed)"""


@query("val1_row_checks", FLAWED_SQL + " SELECT errors, count(*) AS n_rows FROM checked GROUP BY 1")
def val1(spark, d):
    checked = collect_errors(_flawed(spark, d))
    return checked.groupBy(F.array_join("errors", "; ").alias("errors")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("val2_all_failures", FLAWED_SQL + " SELECT transaction_id, account, errors FROM checked WHERE errors <> ''")
def val2(spark, d):
    bad = split_quarantine(_flawed(spark, d))[1]
    return bad.select("transaction_id", "account", F.array_join("errors", "; ").alias("errors"))


@query("set2_clean_and_quarantine", FLAWED_SQL + " SELECT transaction_id, account, CASE WHEN errors = '' THEN 'clean' ELSE 'quarantine' END AS part FROM checked")
def set2(spark, d):
    clean, bad = split_quarantine(_flawed(spark, d))
    tag = lambda df, part: df.select("transaction_id", "account", F.lit(part).alias("part"))
    return tag(clean, "clean").unionByName(tag(bad, "quarantine"))


@query("val3_quarantine_by_transaction", FLAWED_SQL + """
, bad AS (SELECT DISTINCT transaction_id FROM checked WHERE errors <> '')
SELECT transaction_id, account, CASE WHEN transaction_id IN (SELECT transaction_id FROM bad) THEN 'quarantine' ELSE 'clean' END AS part FROM checked""")
def val3_transaction(spark, d):
    part = F.when(F.col("quarantined"), "quarantine").otherwise("clean")
    return mark_quarantine(_flawed(spark, d), scope="transaction").select("transaction_id", "account", part.alias("part"))


@query("agg5_failure_counts", FLAWED_SQL + """
, failures AS (SELECT unnest(string_split(errors, '; ')) AS e FROM checked WHERE errors <> '')
SELECT string_split(e, ': ')[1] AS column, string_split(e, ': ')[2] AS check, count(*) AS failures FROM failures GROUP BY 1, 2""".replace(" AS column", ' AS "column"').replace(" AS check", ' AS "check"'))
def agg5(spark, d):
    return count_failures(collect_errors(_flawed(spark, d)))


# --- end to end -------------------------------------------------------------

LEDGER_SQL = "WITH " + V.ORDERS_BY_FILE_SQL + """
, signed AS (SELECT statement_id, strftime(o_orderdate, '%Y-%m-%d') AS date, description, CASE WHEN outgoing THEN -o_totalprice ELSE o_totalprice END AS amount,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Expenses:Urgent' WHEN '2-HIGH' THEN 'Expenses:High' WHEN '3-MEDIUM' THEN 'Skipped' ELSE 'Uncategorized' END AS category FROM o)
SELECT statement_id, date, description, 'Assets:Current:Bank' AS account, amount, 'EUR' AS currency FROM signed WHERE category <> 'Skipped'
UNION ALL SELECT statement_id, date, description, category, -amount, 'EUR' FROM signed WHERE category <> 'Skipped'"""


def _priority_aliases(spark, d):
    """Merchants named after the priorities found in the orders."""
    p = F.col("o_orderpriority")
    category = F.when(p == "1-URGENT", "Expenses:Urgent").when(p == "2-HIGH", "Expenses:High").when(p == "3-MEDIUM", "Skipped")
    names = table(spark, d, "orders").select(p.alias("canonical_name"), category.alias("default_category")).distinct()
    return alias_table(names.filter("default_category is not null").withColumn("aliases", F.array("canonical_name")))


@query("val3_statements_to_ledger", LEDGER_SQL)
def val3_ledger(spark, d):
    """Files in four formats to a validated ledger; the SQL side starts at the orders."""
    ledger, _ = statements_to_ledger(V.statement_lines(spark, d), _priority_aliases(spark, d))
    return _day(ledger).select("statement_id", "date", "description", "account", "amount", "currency")


@query("str1_incremental_ingest", "WITH " + V.ORDERS_BY_FILE_SQL + """
, signed AS (SELECT statement_id, strftime(o_orderdate, '%Y-%m-%d') AS date, description, CASE WHEN outgoing THEN -o_totalprice ELSE o_totalprice END AS amount, o_orderpriority FROM o WHERE o_orderpriority IN ('1-URGENT', '2-HIGH'))
SELECT statement_id, date, description, 'Assets:Current:Bank' AS account, amount FROM signed
UNION ALL SELECT statement_id, date, description, 'Expenses:' || o_orderpriority, -amount FROM signed""")
def str1(spark, d):
    """Every statement arrives as a file in one of two deliveries, the first one twice."""
    base = work_dir(spark)
    lines = V.statement_lines(spark, d)
    second = F.col("statement_id") > F.lit("s000000010")
    deliver = lambda rows, name: write_statements(rows, f"{base}/incoming/{name}")

    def resolver(transactions):
        text = clean_text(F.col("description"))
        known = transactions.filter(F.col("description").rlike("^(1-URGENT|2-HIGH)")).select(
            text.alias("cleaned_description"), F.substring_index("description", " ORDER", 1).alias("canonical_name")
        ).distinct()
        return known.select("*", F.concat(F.lit("Expenses:"), F.col("canonical_name")).alias("default_category"), F.lit(1.0).alias("similarity"))

    def take_in():
        ingest_statements(spark, f"{base}/incoming", f"{base}/out", f"{base}/checkpoint", resolver).awaitTermination()

    deliver(lines.filter(~second), "first")
    take_in()
    deliver(lines.filter(second), "second")
    deliver(lines.filter(~second), "again")
    take_in()
    ledger = _day(spark.read.parquet(f"{base}/out/ledger"))
    return ledger.select(
        F.regexp_extract("statement_id", r"statement_id=([^/]+)", 1).alias("statement_id"), "date", "description", "account", "amount"
    )


@query("str1_learned_between_batches", "WITH " + V.ORDERS_BY_FILE_SQL + """
, signed AS (SELECT statement_id, (o_orderkey // 16) % 3 AS delivery, strftime(o_orderdate, '%Y-%m-%d') AS date, description,
   CASE WHEN outgoing THEN -o_totalprice ELSE o_totalprice END AS amount, o_orderpriority FROM o),
hit AS (SELECT * FROM signed WHERE (o_orderpriority = '1-URGENT' AND delivery >= 1) OR (o_orderpriority = '2-HIGH' AND delivery = 2))
SELECT statement_id, date, description, 'Assets:Current:Bank' AS account, amount, 3::bigint AS commits FROM hit
UNION ALL SELECT statement_id, date, description, CASE WHEN delivery = 1 OR o_orderpriority = '2-HIGH' THEN 'Expenses:' || o_orderpriority ELSE 'Expenses:Rush' END, -amount, 3 FROM hit""")
def str1_learned(spark, d):
    """Three deliveries; after each one users name a merchant, which resolves the rows of the later ones.

    After the second delivery the first merchant's category changes too: an upsert by name.
    """
    base = work_dir(spark)
    lines = V.statement_lines(spark, d)
    part = F.substring("statement_id", 2, 9).cast("long") % 3
    schema = "canonical_name string, default_category string, alias string, version bigint"
    said = []
    phonebook = VersionedTable(spark, f"{base}/phonebook", T.StructType.fromDDL("canonical_name string, default_category string, aliases array<string>"))

    def resolve(transactions, merchants):
        texts = transactions.select("description").distinct()
        found = match_aliases(texts, alias_table(merchants), "description")
        return found.select(
            clean_text(F.col("description")).alias("cleaned_description"), "canonical_name", "default_category", F.lit(1.0).alias("similarity")
        ).distinct()

    learner = Learner(phonebook, lambda: spark.createDataFrame(said, schema) if said else None, register_entities, resolve)
    words = {0: [], 1: [("1-URGENT", "Expenses:1-URGENT", "urgent", 1)], 2: [("1-URGENT", "Expenses:Rush", "urgent", 2), ("2-HIGH", "Expenses:2-HIGH", "high", 1)]}
    for delivery, named in words.items():
        said += named
        write_statements(lines.filter(part == delivery), f"{base}/incoming/{delivery}")
        ingest_statements(spark, f"{base}/incoming", f"{base}/out", f"{base}/checkpoint", learner).awaitTermination()
    ledger = _day(spark.read.parquet(f"{base}/out/ledger"))
    return ledger.select(
        F.regexp_extract("statement_id", r"statement_id=([^/]+)", 1).alias("statement_id"), "date", "description", "account", "amount",
        F.lit(len(phonebook.versions())).cast("bigint").alias("commits"),
    )
