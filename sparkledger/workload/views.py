"""Bank-like views over the given tables, each in Spark and in SQL.

``statement lines``: every 16 consecutive orders are one exported file, in one
of four house styles with its own preamble, delimiter, locale and polarity. The
step is narrow: each order row gives its own line, the first one of a file also
the preamble, the header and, in one style, a row with a cell too many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import STOP_WORDS
from .registry import table

ROWS_PER_FILE = 16
PREAMBLES = [
    ["Bank Export", "Customer report", "Date,Amount,Description"],
    ["Spaarbank Voorbeeld", "Overzicht: 2019-05-06", "Klantnr: 770-310-429", "", "Transactiedatum;Omschrijving;Transactiebedrag"],
    ["Kontoauszug", "Datum;Betrag;Type;Verwendungszweck"],
    ["Date\tDescription\tCredit\tDebit", ""],
]
LONG_ROW = "01.01.2020;1,00;Debit;one cell;too many"
LONG_ROW_STYLE = 2


def _grouped(whole: Column, mark: str) -> Column:
    text = whole.cast("string")
    thousands = F.concat(F.floor(whole / 1000).cast("string"), F.lit(mark), F.lpad((whole % 1000).cast("string"), 3, "0"))
    return F.when(whole >= 1000, thousands).otherwise(text)


def orders_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    file_no = F.floor(F.col("o_orderkey") / ROWS_PER_FILE)
    return o.select(
        "*",
        F.format_string("s%09d", file_no).alias("statement_id"),
        (F.col("o_orderkey") % ROWS_PER_FILE).alias("slot"),
        (file_no % 4).cast("int").alias("style"),
        cents.alias("cents"),
        (F.col("o_orderstatus") == "F").alias("outgoing"),
        F.concat(F.col("o_orderpriority"), F.lit(" ORDER "), F.col("o_orderkey").cast("string")).alias("description"),
    )


def statement_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines(statement_id, line_no, line)."""
    o = orders_by_file(spark, sf_dir)
    whole, cents = F.floor(F.col("cents") / 100), F.lpad((F.col("cents") % 100).cast("string"), 2, "0")
    sign = F.when(F.col("outgoing"), F.lit("-")).otherwise(F.lit(""))
    us = F.concat(_grouped(whole, ","), F.lit("."), cents)
    eu = F.concat(_grouped(whole, "."), F.lit(","), cents)
    plain = F.concat(whole.cast("string"), F.lit("."), cents)
    day = lambda fmt: F.date_format("o_orderdate", fmt)
    text = F.col("description")
    bodies = [
        F.concat(day("yyyy-MM-dd"), F.lit(',"'), sign, us, F.lit('",'), text),
        F.concat(day("dd-MM-yyyy"), F.lit(";"), text, F.lit(";"), sign, eu),
        F.concat(
            day("dd.MM.yyyy"), F.lit(";"), eu, F.when(F.col("outgoing"), ";Debit;").otherwise(";Credit;"), text
        ),
        F.concat(
            day("MM/dd/yyyy"), F.lit("\t"), text, F.lit("\t"),
            F.when(F.col("outgoing"), F.concat(F.lit("\t"), plain)).otherwise(F.concat(plain, F.lit("\t"))),
        ),
    ]
    style, slot = F.col("style"), F.col("slot")
    line = lambda no, s: F.struct(no.cast("bigint").alias("line_no"), s.alias("line"))
    choices = []
    for i, (head, body) in enumerate(zip(PREAMBLES, bodies)):
        own = F.array(line(slot + len(head), body))
        top = [line(F.lit(n), F.lit(s)) for n, s in enumerate(head)]
        if i == LONG_ROW_STYLE:
            top.append(line(F.lit(len(head) + ROWS_PER_FILE), F.lit(LONG_ROW)))
        choices.append(F.when(slot == 0, F.concat(F.array(*top), own)).otherwise(own))
    lines = choices[-1]
    for i in reversed(range(len(choices) - 1)):
        lines = F.when(style == i, choices[i]).otherwise(lines)
    return o.select("statement_id", F.explode(lines).alias("l")).select("statement_id", "l.line_no", "l.line")


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\t", "'||chr(9)||'") + "'"


ORDERS_BY_FILE_SQL = """
o AS (
  SELECT *, 's' || lpad((o_orderkey // 16)::varchar, 9, '0') AS statement_id, o_orderkey % 16 AS slot,
         (o_orderkey // 16) % 4 AS style, round(o_totalprice * 100)::bigint AS cents,
         o_orderstatus = 'F' AS outgoing, o_orderpriority || ' ORDER ' || o_orderkey::varchar AS description
  FROM orders)"""

_WHOLE = "(cents // 100)"
_CENTS = "lpad((cents % 100)::varchar, 2, '0')"


def _grouped_sql(mark: str) -> str:
    return (
        f"CASE WHEN {_WHOLE} >= 1000 THEN ({_WHOLE} // 1000)::varchar || '{mark}' || "
        f"lpad(({_WHOLE} % 1000)::varchar, 3, '0') ELSE {_WHOLE}::varchar END"
    )


_US = f"({_grouped_sql(',')} || '.' || {_CENTS})"
_EU = f"({_grouped_sql('.')} || ',' || {_CENTS})"
_PLAIN = f"({_WHOLE}::varchar || '.' || {_CENTS})"
_SIGN = "CASE WHEN outgoing THEN '-' ELSE '' END"
_BODIES_SQL = [
    f"strftime(o_orderdate, '%Y-%m-%d') || ',\"' || {_SIGN} || {_US} || '\",' || description",
    f"strftime(o_orderdate, '%d-%m-%Y') || ';' || description || ';' || {_SIGN} || {_EU}",
    f"strftime(o_orderdate, '%d.%m.%Y') || ';' || {_EU} || CASE WHEN outgoing THEN ';Debit;' ELSE ';Credit;' END || description",
    f"strftime(o_orderdate, '%m/%d/%Y') || chr(9) || description || chr(9) || "
    f"CASE WHEN outgoing THEN chr(9) || {_PLAIN} ELSE {_PLAIN} || chr(9) END",
]


def _lines_sql() -> str:
    parts = []
    for i, (head, body) in enumerate(zip(PREAMBLES, _BODIES_SQL)):
        parts.append(f"SELECT statement_id, (slot + {len(head)})::bigint AS line_no, {body} AS line FROM o WHERE style = {i}")
        top = list(enumerate(head))
        if i == LONG_ROW_STYLE:
            top.append((len(head) + ROWS_PER_FILE, LONG_ROW))
        for n, s in top:
            parts.append(f"SELECT statement_id, {n}::bigint, {_sql_text(s)} FROM o WHERE style = {i} AND slot = 0")
    return "lines AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


LINES_SQL = ORDERS_BY_FILE_SQL + ",\n" + _lines_sql()


# --- free text lines --------------------------------------------------------

FREE_LINES_SQL = r"""
texts AS (
  SELECT 'd' || doc_id::varchar AS statement_id, text AS content FROM documents
  UNION ALL SELECT 'p' || page_id::varchar, html FROM pages),
free AS (
  SELECT statement_id, unnest(parts) AS line, unnest(range(len(parts))) AS line_no
  FROM (SELECT statement_id, string_split_regex(regexp_replace(content, '(\r\n|\n|\r)\z', ''), '\r\n|\n|\r') AS parts
        FROM texts WHERE content <> ''))"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("statement_id"), F.col("text").alias("content")
    )
    p = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("statement_id"), F.col("html").alias("content")
    )
    return d.unionByName(p)


# --- cleaned text in SQL ----------------------------------------------------

def clean_sql(x: str) -> str:
    """The cleaning chain for an engine whose patterns have neither look-around
    nor Unicode word borders: words are marked, then dropped as a whole."""
    def sub(e: str, pattern: str, by: str = "' '") -> str:
        return f"regexp_replace({e}, {pattern}, {by}, 'g')"

    mark = r"chr(1) || '\1' || chr(2)"
    unmark = lambda e: sub(e, r"'[\x01\x02]'", "''")
    e = f"upper(replace({x}, 'ß', 'ss'))"
    e = sub(e, "'([A-Za-z0-9_]+)'", mark)
    e = unmark(sub(e, f"chr(1) || '(?:{'|'.join(STOP_WORDS)})' || chr(2)"))
    e = sub(e, r"'\p{Nd}{1,2}[/-]\p{Nd}{1,2}[/-]\p{Nd}{2,4}'")
    e = sub(e, r"'\p{Nd}{16}'")
    e = sub(e, r"'X{4,}\p{Nd}{4}'")
    e = sub(e, r"'([\p{L}\p{N}_]+)'", mark)
    e = sub(e, "chr(1) || '[A-Z0-9]{10,}' || chr(2)")
    e = unmark(sub(e, r"chr(1) || '\p{Nd}{6,}' || chr(2)"))
    e = sub(e, r"'[^\p{L}\p{N}_\s]'")
    return f"coalesce(trim({sub(e, chr(39) + chr(92) + 's+' + chr(39))}), '')"


def match_key_sql(x: str) -> str:
    return rf"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


# --- transactions, trades, merchants ---------------------------------------

def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions, a statement per customer."""
    o = table(spark, sf_dir, "orders")
    out = F.col("o_orderstatus") == "F"
    return o.select(
        F.col("o_custkey").alias("statement_id"),
        F.col("o_orderkey").alias("line_no"),
        F.col("o_orderdate").cast("timestamp").alias("date"),
        F.when(out, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).alias("amount"),
        F.concat(F.col("o_orderpriority"), F.lit(" "), F.col("o_orderkey").cast("string")).alias("description"),
    )


TRANSACTIONS_SQL = """
txn AS (
  SELECT o_custkey AS statement_id, o_orderkey AS line_no, o_orderdate AS date,
         CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS amount,
         o_orderpriority || ' ' || o_orderkey::varchar AS description
  FROM orders)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as security trades, purchases and salary."""
    ticker = F.concat(
        F.lit("TK"), F.char((F.col("l_suppkey") % 26 + 65)), F.char((F.col("l_partkey") % 26 + 65))
    )
    quantity = F.col("l_quantity").cast("bigint").cast("string")
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    text = (
        F.when(flag == "A", F.concat_ws(" ", F.lit("Buy"), quantity, ticker, F.lit("@"), price))
        .when(flag == "R", F.concat_ws(" ", F.lit("Verkoop"), quantity, ticker, F.lit("@"), F.replace(price, F.lit("."), F.lit(","))))
        .when(status == "O", F.concat(F.lit("Greengrocer Order "), price))
        .otherwise(F.lit("Salary"))
    )
    sign = F.when(flag == "R", 1.0).when((flag == "N") & (status == "F"), 1.0).otherwise(-1.0)
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("transaction_id"),
        F.col("l_shipdate").cast("timestamp").alias("date"),
        text.alias("description"),
        (F.col("l_extendedprice") * sign).alias("amount"),
        F.when(status == "O", F.lit("Expenses:Goods")).alias("account"),
    )


TRADES_SQL = """
trades AS (
  SELECT l_orderkey::varchar || '-' || l_linenumber::varchar AS transaction_id, l_shipdate AS date,
         'TK' || chr((l_suppkey % 26 + 65)::int) || chr((l_partkey % 26 + 65)::int) AS ticker,
         l_quantity, l_extendedprice,
         l_quantity::bigint::varchar AS q, l_extendedprice::decimal(18,2)::varchar AS p, l_returnflag, l_linestatus,
         CASE l_returnflag WHEN 'A' THEN 'Buy ' || q || ' ' || ticker || ' @ ' || p
              WHEN 'R' THEN 'Verkoop ' || q || ' ' || ticker || ' @ ' || replace(p, '.', ',')
              ELSE CASE WHEN l_linestatus = 'O' THEN 'Greengrocer Order ' || p ELSE 'Salary' END END AS description,
         l_extendedprice * CASE WHEN l_returnflag = 'R' OR (l_returnflag = 'N' AND l_linestatus = 'F') THEN 1.0 ELSE -1.0 END AS amount,
         CASE WHEN l_linestatus = 'O' THEN 'Expenses:Goods' END AS account
  FROM lineitem)"""

VECTOR_SIZE = 64


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding as a merchant."""
    return table(spark, sf_dir, "embeddings").select(
        F.format_string("m%09d", F.col("vec_id")).alias("canonical_name"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("default_category"),
        F.col("embedding").cast("array<double>").alias("vector_embedding"),
    )


def noisy_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding mixed with its own reversal: near, not equal, to its merchant."""
    v = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.zip_with(v, F.reverse(v), lambda a, b: a + b * 0.5).alias("vector")
    )


MERCHANTS_SQL = """
merchants AS (
  SELECT 'm' || lpad(vec_id::varchar, 9, '0') AS canonical_name, 'c' || label::varchar AS default_category,
         embedding::double[] AS vector_embedding FROM embeddings)"""
QUERIES_SQL = """
queries AS (
  SELECT vec_id AS query_id,
         list_transform(list_zip(embedding::double[], list_reverse(embedding::double[])), lambda x: x[1] + 0.5 * x[2]) AS vector
  FROM embeddings)"""


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as review items: a statement per user."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("statement_id"),
        F.col("event_id").alias("line_no"),
        F.col("event_id").cast("string").alias("transaction_id"),
        F.col("ts").cast("timestamp").alias("date"),
        F.col("value").alias("amount"),
        F.col("event_type").alias("description"),
        F.upper("event_type").alias("cleaned_description"),
    )
