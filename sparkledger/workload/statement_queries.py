"""Queries over statement files: SRC*, SNK*, HDR*, MAP*, PRJ1-3, PRJ7."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..constants import (
    AMOUNT_KEYWORDS,
    DATE_KEYWORDS,
    DECIMAL_COMMA_KEYWORDS,
    DESCRIPTION_KEYWORDS,
    HEADER_KEYWORDS,
)
from ..functions.identity import header_hash
from ..functions.lines import data_density, keyword_score
from ..operators.layout import (
    bad_rows,
    decide_header,
    detect_header,
    detect_layout,
    header_by_density,
    header_by_keywords,
    numeric_columns,
    join_quoted_lines,
    lay_out,
    parse_rows,
    split_fields,
    table_rows,
)
from ..operators.mapping import (
    find_column,
    infer_decimal_separator,
    infer_polarity,
    is_valid_mapping,
    lookup_mapping,
    resolve_mapping,
    strip_headers,
)
from ..operators.normalize import constant_columns
from ..plans.statements import normalize_statements
from ..session import shared_dir, stage_table
from ..sources.sinks import nan_to_null, write_ledger_csv, write_quarantine, write_records
from ..sources.statements import lines_from_content, read_statements, write_statements
from ..sources.tables import MAPPINGS_SCHEMA, VersionedTable, save_mappings
from . import views as V
from .registry import query, table

LINES = "WITH " + V.LINES_SQL
FREE = "WITH " + V.FREE_LINES_SQL


def work_dir(spark) -> str:
    """A new folder of the shared work space for one run of a query."""
    return f"{shared_dir(spark)}/queries/{uuid.uuid4().hex}"


# --- scans ------------------------------------------------------------------

@query("src1_read_statements", LINES + " SELECT statement_id, count(*) AS n_lines, max(line_no) AS last_line, "
       "md5(string_agg(line, chr(10) ORDER BY line_no)) AS content FROM (SELECT statement_id, line, "
       "row_number() OVER (PARTITION BY statement_id ORDER BY line_no) - 1 AS line_no FROM lines) GROUP BY 1")
def src1(spark, d):
    """Write the statements as files, one folder each, and read them as numbered lines."""
    path = work_dir(spark) + "/incoming"
    write_statements(V.statement_lines(spark, d), path)
    read = read_statements(spark, path).withColumn(
        "statement_id", F.regexp_extract("statement_id", r"statement_id=([^/]+)", 1)
    )
    # Files of this view hold at most 22 lines, so a file's text is a short list.
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n")
    return read.groupBy("statement_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.max("line_no").alias("last_line"), F.md5(text).alias("content")
    )


@query("src2_content_lines", FREE + " SELECT statement_id, line_no::bigint AS line_no, line FROM free")
def src2(spark, d):
    return lines_from_content(V.texts(spark, d), "statement_id", "content")


def _lines(spark, d):
    return lay_out(V.statement_lines(spark, d))


def _layouts(spark, d):
    return detect_layout(V.statement_lines(spark, d))


def _staged_layouts(spark, d):
    """``_layouts`` for queries that need them more than once: the lines are laid out and read once."""
    return stage_table(_layouts(spark, d).select("statement_id", "columns"), "layouts")


# Header places and names of the four house styles, known by construction.
STYLE_SQL = """
, styles AS (
  SELECT * FROM (VALUES
    (0, 2, 'Date,Amount,Description', ',', ['Date','Amount','Description']),
    (1, 4, 'Transactiedatum;Omschrijving;Transactiebedrag', ';', ['Transactiedatum','Omschrijving','Transactiebedrag']),
    (2, 1, 'Datum;Betrag;Type;Verwendungszweck', ';', ['Datum','Betrag','Type','Verwendungszweck']),
    (3, 0, 'Date' || chr(9) || 'Description' || chr(9) || 'Credit' || chr(9) || 'Debit', chr(9), ['Date','Description','Credit','Debit'])
  ) t(style, header_row, header_line, delimiter, columns)),
files AS (SELECT DISTINCT statement_id, style FROM o),
headed AS (SELECT statement_id, style, header_row, header_line, delimiter, columns FROM files JOIN styles USING (style))
"""
HEADED = "WITH " + V.ORDERS_BY_FILE_SQL + STYLE_SQL


@query("src3_delimiter", HEADED + " SELECT statement_id, delimiter FROM headed")
def src3(spark, d):
    return _layouts(spark, d).select("statement_id", "delimiter")


FIELDS_SQL = f"""
 SELECT statement_id, slot + CASE style WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 2 END AS line_no,
  CASE style WHEN 0 THEN [strftime(o_orderdate, '%Y-%m-%d'), {V._SIGN} || {V._US}, description]
   WHEN 1 THEN [strftime(o_orderdate, '%d-%m-%Y'), description, {V._SIGN} || {V._EU}]
   WHEN 2 THEN [strftime(o_orderdate, '%d.%m.%Y'), {V._EU}, CASE WHEN outgoing THEN 'Debit' ELSE 'Credit' END, description]
   ELSE [strftime(o_orderdate, '%m/%d/%Y'), description, CASE WHEN outgoing THEN NULL ELSE {V._PLAIN} END,
         CASE WHEN outgoing THEN {V._PLAIN} END] END AS fields FROM o"""


@query("src4_fields", HEADED + FIELDS_SQL)
def src4(spark, d):
    lines = _lines(spark, d)
    return table_rows(parse_rows(lines, detect_layout(lines))).select("statement_id", "line_no", "fields")


@query("src4_bad_rows", LINES + " SELECT statement_id, line_no, line FROM lines WHERE line LIKE '%;too many'")
def src4_bad(spark, d):
    lines = _lines(spark, d)
    return bad_rows(parse_rows(lines, detect_layout(lines)))


@query("src5_numeric_columns", HEADED + """
 SELECT statement_id, (pos - 1)::bigint AS pos, columns[pos] AS name,
  CASE style WHEN 0 THEN columns[pos] = 'Amount' AND all_small WHEN 3 THEN columns[pos] IN ('Credit', 'Debit') ELSE false END AS is_numeric
 FROM (SELECT *, unnest(range(1, len(columns) + 1)) AS pos FROM headed)
 JOIN (SELECT statement_id, bool_and(cents < 100000) AS all_small FROM o GROUP BY 1) USING (statement_id)""")
def src5(spark, d):
    lines = _lines(spark, d)
    return numeric_columns(table_rows(parse_rows(lines, detect_layout(lines))))


@query("src4_quoted_line_breaks", r"""
SELECT doc_id::varchar AS statement_id, 1::bigint AS line_no,
 array_to_string(string_split_regex(text, '\r\n|\n|\r'), chr(10)) AS cell FROM documents WHERE text <> ''""")
def src4_breaks(spark, d):
    """Every document as one quoted cell under a header: the cell comes back whole."""
    docs = table(spark, d, "documents").filter("text <> ''")
    quoted = F.replace("text", F.lit('"'), F.lit('""'))
    content = F.concat(F.lit('Text,Amount\n"'), quoted, F.lit('",12345678\n'))
    lines = lines_from_content(
        docs.select(F.col("doc_id").cast("string").alias("statement_id"), content.alias("content")), "statement_id", "content"
    )
    layout = lines.groupBy("statement_id").agg((F.max("line_no") + 1).alias("n_lines"))
    layout = layout.select("*", F.lit(0).cast("bigint").alias("header_row"), F.lit(",").alias("delimiter"))
    joined = join_quoted_lines(lines, layout).filter("line_no > 0")
    cell = F.get(split_fields(F.col("line"), F.lit(",")), F.lit(0))
    return joined.select("statement_id", "line_no", cell.alias("cell"))


@query("src6_header_only", HEADED + FIELDS_SQL + " WHERE (o_orderkey // 16) % 3 <> 0")
def src6(spark, d):
    """Every third statement is cut down to preamble and header and gives no rows; nor do empty texts."""
    lines = _lines(spark, d)
    third = F.substring("statement_id", 2, 9).cast("long") % 3 == 0
    headed = detect_header(lines).select("statement_id", "header_row")
    heads = lines.drop("chunk").join(headed, "statement_id").filter(~third | (F.col("line_no") <= F.col("header_row"))).drop("header_row")
    empty = lines_from_content(V.texts(spark, d).withColumn("content", F.lit("")), "statement_id", "content")
    cut = lay_out(heads.unionByName(empty))
    return table_rows(parse_rows(cut, detect_layout(cut))).select("statement_id", "line_no", "fields")


# --- mappings ---------------------------------------------------------------

def _mapping_table(layouts):
    """A stored mapping for the German house style: its amount column is overridden."""
    style = layouts.filter(F.array_contains("columns", "Betrag")).select("columns").distinct()
    mapping = resolve_mapping(style).withColumn("mapping", F.col("mapping").withField("date_col", F.lit("Valuta")))
    return mapping.select("header_hash", "mapping")


HASH_SQL = "md5(array_to_string(columns, chr(1)))"
STORED = HEADED + f", stored AS (SELECT DISTINCT {HASH_SQL} AS header_hash, 'Valuta' AS date_col FROM headed WHERE style = 2)"


@query("src7_read_mapping_cache", STORED + " SELECT * FROM stored")
def src7(spark, d):
    cache = VersionedTable(spark, work_dir(spark) + "/mappings", MAPPINGS_SCHEMA)
    save_mappings(cache, _mapping_table(_layouts(spark, d)))
    return cache.read().select("header_hash", F.col("mapping.date_col").alias("date_col"))


@query("src8_save_mapping_cache", HEADED + f""" SELECT DISTINCT {HASH_SQL} AS header_hash, columns[1] AS date_col,
 2::bigint AS versions FROM headed""")
def src8(spark, d):
    """A second save replaces the stored German mapping and adds the other styles."""
    cache = VersionedTable(spark, work_dir(spark) + "/mappings", MAPPINGS_SCHEMA)
    layouts = _staged_layouts(spark, d)
    save_mappings(cache, _mapping_table(layouts))
    save_mappings(cache, resolve_mapping(layouts))
    n = len(cache.versions())
    return cache.read().select("header_hash", F.col("mapping.date_col").alias("date_col"), F.lit(n).cast("bigint").alias("versions"))


@query("src9_merchants_scan", "WITH " + V.MERCHANTS_SQL + " SELECT canonical_name, default_category, len(vector_embedding)::bigint AS dim FROM merchants")
def src9(spark, d):
    return V.merchants(spark, d).select(
        "canonical_name", "default_category", F.size("vector_embedding").cast("bigint").alias("dim")
    )


def _headers(spark, d):
    return _layouts(spark, d).select("statement_id", "columns")


@query("map1_header_hash", HEADED + f" SELECT statement_id, {HASH_SQL} AS header_hash FROM headed")
def map1(spark, d):
    return _headers(spark, d).select("statement_id", header_hash(F.col("columns")).alias("header_hash"))


def find_sql(keywords, default, source="columns"):
    """Keyword-major search over a list of names in SQL."""
    cases = " ".join(
        f"WHEN len(list_filter({source}, lambda h: contains(lower(h), '{k}'))) > 0 "
        f"THEN list_filter({source}, lambda h: contains(lower(h), '{k}'))[1]"
        for k in keywords
    )
    return f"CASE {cases} ELSE coalesce({source}[{default}], {source}[1]) END"


# Words of free lines serve as header names at volume.
WORDS_SQL = FREE + ", heads AS (SELECT statement_id, line_no::bigint AS line_no, string_split(line, ' ') AS columns FROM free)"


def _free_headers(spark, d):
    lines = lines_from_content(V.texts(spark, d), "statement_id", "content")
    return lines.select("statement_id", "line_no", F.split("line", " ", -1).alias("columns"))


@query("map2_find_column", WORDS_SQL + f" SELECT statement_id, line_no, {find_sql(DESCRIPTION_KEYWORDS, -1)} AS found FROM heads")
def map2(spark, d):
    return _free_headers(spark, d).select(
        "statement_id", "line_no", find_column(F.col("columns"), DESCRIPTION_KEYWORDS, -1).alias("found")
    )


@query("map3_main_columns", HEADED + f""" SELECT statement_id, {find_sql(DATE_KEYWORDS, 1)} AS date_col,
 {find_sql(AMOUNT_KEYWORDS, 2)} AS amount_col, {find_sql(DESCRIPTION_KEYWORDS, -1)} AS desc_col FROM headed""")
def map3(spark, d):
    c = F.col("columns")
    return _headers(spark, d).select(
        "statement_id",
        find_column(c, DATE_KEYWORDS, 0).alias("date_col"),
        find_column(c, AMOUNT_KEYWORDS, 1).alias("amount_col"),
        find_column(c, DESCRIPTION_KEYWORDS, -1).alias("desc_col"),
    )


@query("map4_polarity", WORDS_SQL + """
, found AS (SELECT statement_id, line_no, list_transform(columns, lambda h: lower(h)) AS low, columns FROM heads),
places AS (SELECT *,
  list_position(list_transform(low, lambda h: (contains(h, 'credit') OR contains(h, 'bij')) AND NOT contains(h, 'card')), true) AS c,
  list_position(list_transform(low, lambda h: (contains(h, 'debit') OR contains(h, 'af')) AND NOT contains(h, 'card')), true) AS d,
  list_position(list_transform(low, lambda h: contains(h, 'cd') OR contains(h, 'c/d') OR contains(h, 'direction') OR contains(h, 'type') OR contains(h, 'af_bij')), true) AS b
  FROM found)
SELECT statement_id, line_no, CASE WHEN c > 0 AND d > 0 AND c <> d THEN 'credit_debit' WHEN c > 0 AND d > 0 THEN 'direction'
  WHEN b > 0 THEN 'direction' ELSE 'signed' END AS polarity,
  CASE WHEN c > 0 AND d > 0 AND c <> d THEN NULL WHEN c > 0 AND d > 0 THEN columns[c] WHEN b > 0 THEN columns[b] END AS direction_col
FROM places""")
def map4(spark, d):
    p = infer_polarity(F.col("columns"))
    return _free_headers(spark, d).withColumn("p", p).select(
        "statement_id", "line_no", F.col("p.type").alias("polarity"), F.col("p.direction_col").alias("direction_col")
    )


@query("map5_decimal_separator", WORDS_SQL + f""" SELECT statement_id, line_no,
 CASE WHEN {' OR '.join(f"contains(lower(array_to_string(columns, ' ')), '{k}')" for k in DECIMAL_COMMA_KEYWORDS)} THEN ',' ELSE '.' END AS decimal_separator FROM heads""")
def map5(spark, d):
    return _free_headers(spark, d).select(
        "statement_id", "line_no", infer_decimal_separator(F.col("columns")).alias("decimal_separator")
    )


@query("map6_resolve_mapping", HEADED + """
 SELECT statement_id, CASE style WHEN 2 THEN 'cached' WHEN 1 THEN 'proposed' ELSE 'heuristic' END AS mapping_source,
  CASE style WHEN 2 THEN 'Valuta' ELSE columns[1] END AS date_col,
  CASE style WHEN 0 THEN 'Amount' WHEN 1 THEN 'Transactiebedrag' WHEN 2 THEN 'Betrag' END AS amount_col,
  CASE style WHEN 0 THEN 'Description' WHEN 1 THEN 'Omschrijving' WHEN 2 THEN 'Verwendungszweck' ELSE 'Description' END AS desc_col,
  CASE style WHEN 1 THEN ',' WHEN 2 THEN ',' ELSE '.' END AS decimal_separator,
  CASE style WHEN 2 THEN 'direction' WHEN 3 THEN 'credit_debit' ELSE 'signed' END AS polarity FROM headed""")
def map6(spark, d):
    """Cached, then proposed where valid (padded names, no amount), then heuristic."""
    layouts = _staged_layouts(spark, d)
    heads = resolve_mapping(layouts.select("columns").distinct())
    pad = F.col("mapping").withField("date_col", F.concat(F.lit(" "), F.col("mapping.date_col")))
    dutch = heads.filter(F.array_contains("columns", "Omschrijving")).select("header_hash", pad.alias("mapping"))
    broken = heads.filter(~F.array_contains("columns", "Omschrijving")).select(
        "header_hash", F.col("mapping").withField("desc_col", F.lit("")).alias("mapping")
    )
    out = resolve_mapping(layouts, _mapping_table(layouts), dutch.unionByName(broken))
    m = F.col("mapping")
    return out.select(
        "statement_id", "mapping_source", m["date_col"].alias("date_col"), m["amount_col"].alias("amount_col"),
        m["desc_col"].alias("desc_col"), m["decimal_separator"].alias("decimal_separator"),
        m["polarity"]["type"].alias("polarity"),
    )


@query("jon3_mapping_lookup", STORED + f""" SELECT statement_id, {HASH_SQL} AS header_hash, date_col
 FROM headed LEFT JOIN stored ON {HASH_SQL} = header_hash""")
def jon3(spark, d):
    layouts = _staged_layouts(spark, d)
    hashed = layouts.withColumn("header_hash", header_hash(F.col("columns")))
    return lookup_mapping(hashed, _mapping_table(layouts)).select(
        "statement_id", "header_hash", F.col("cached.date_col").alias("date_col")
    )


@query("prj1_strip_headers", FREE + r""" SELECT statement_id, line_no::bigint AS line_no,
 list_transform(string_split(line, '.'), lambda h: regexp_replace(h, '^\s+|\s+$', '', 'g')) AS columns FROM free""")
def prj1(spark, d):
    lines = lines_from_content(V.texts(spark, d), "statement_id", "content")
    return lines.select("statement_id", "line_no", strip_headers(F.split("line", r"\.", -1)).alias("columns"))


@query("prj7_mapping_validity", WORDS_SQL + f"""
 SELECT statement_id, line_no, coalesce({find_sql(DATE_KEYWORDS, 1)}, '') <> '' AND coalesce(columns[-1], '') <> ''
  AND coalesce(columns[2], '') <> '' AS valid FROM heads""")
def prj7(spark, d):
    """Proposals from free lines: date found by keyword, description last, amount second."""
    c = F.col("columns")
    none = F.lit(None).cast("string")
    proposal = F.struct(
        find_column(c, DATE_KEYWORDS, 0).alias("date_col"), F.try_element_at(c, F.lit(2)).alias("amount_col"),
        F.try_element_at(c, F.lit(-1)).alias("desc_col"), F.lit(".").alias("decimal_separator"),
        F.struct(F.lit("signed").alias("type"), *[none.alias(n) for n in ("direction_col", "outgoing_value", "incoming_value", "credit_col", "debit_col")]).alias("polarity"),
    )
    return _free_headers(spark, d).withColumn("m", proposal).select("statement_id", "line_no", is_valid_mapping(F.col("m")).alias("valid"))


# --- header detection -------------------------------------------------------

def density_sql(line: str) -> str:
    s = rf"regexp_replace({line}, '^\s+|\s+$', '', 'g')"
    digits = r"length(regexp_replace(t, '[^\p{Nd}]', '', 'g'))"
    letters = r"length(regexp_replace(t, '[^\p{L}]', '', 'g'))"
    share = lambda sep: (
        f"CASE WHEN contains(s, {sep}) THEN len(list_filter(string_split(s, {sep}), lambda t: {digits} > 0 AND {digits} >= {letters}))"
        f" / len(string_split(s, {sep})) ELSE 0 END"
    )
    best = f"greatest({share(chr(39) + ';' + chr(39))}, {share(chr(39) + ',' + chr(39))}, {share('chr(9)')}, {share(chr(39) + '|' + chr(39))})"
    return f"""(SELECT CASE WHEN s = '' THEN 0 WHEN regexp_matches(s, '[;,\\t|]') THEN {best}
      ELSE length(regexp_replace(s, '[^\\p{{Nd}}.,;/-]', '', 'g')) / length(s) END::double FROM (SELECT {s} AS s))"""


SCORE_SQL = "(" + " + ".join(f"contains(lower(line), '{k}')::int" for k in HEADER_KEYWORDS) + " + (contains(line, ',') OR contains(line, ';'))::int)"


def window_sql(lines: str) -> str:
    return f"""
, scored AS (SELECT statement_id, line_no, line, {density_sql('line')} AS density, {SCORE_SQL} AS score,
  regexp_matches(line, '[;,\\t|]') AS delimited FROM {lines} WHERE line_no < 20),
tested AS (SELECT *, density >= 0.5 AND length(regexp_replace(line, '^\\s+|\\s+$', '', 'g')) > 5 AND regexp_matches(line, '\\p{{Nd}}') AS is_data FROM scored),
by_density AS (SELECT statement_id, greatest(CASE WHEN bool_or(delimited) THEN min(line_no) FILTER (is_data AND delimited)
   ELSE min(line_no) FILTER (is_data) END - 1,
   CASE WHEN CASE WHEN bool_or(delimited) THEN min(line_no) FILTER (is_data AND delimited) ELSE min(line_no) FILTER (is_data) END IS NOT NULL THEN 0 END)::bigint AS header_row
   FROM tested GROUP BY 1),
by_keywords AS (SELECT statement_id, line_no::bigint AS header_row FROM tested
   QUALIFY row_number() OVER (PARTITION BY statement_id ORDER BY score DESC, line_no) = 1)"""


ALL_LINES = LINES + ", " + V.FREE_LINES_SQL + ", everything AS (SELECT * FROM lines UNION ALL SELECT statement_id, line_no::bigint, line FROM free)"


def _all_lines(spark, d):
    free = lines_from_content(V.texts(spark, d), "statement_id", "content")
    return V.statement_lines(spark, d).unionByName(free)


@query("hdr1_line_density", ALL_LINES + f" SELECT statement_id, line_no, {density_sql('line')} AS density FROM everything")
def hdr1(spark, d):
    return _all_lines(spark, d).select("statement_id", "line_no", data_density(F.col("line")).alias("density"))


@query("hdr2_keyword_score", ALL_LINES + f" SELECT statement_id, line_no, {SCORE_SQL}::bigint AS score FROM everything")
def hdr2(spark, d):
    return _all_lines(spark, d).select("statement_id", "line_no", keyword_score(F.col("line")).cast("bigint").alias("score"))


@query("hdr3_header_by_density", ALL_LINES + window_sql("everything") + " SELECT statement_id, header_row FROM by_density")
def hdr3(spark, d):
    return header_by_density(_all_lines(spark, d))


@query("hdr3_header_by_density_plain", ALL_LINES + window_sql("everything") + """
 SELECT statement_id, CASE WHEN first IS NOT NULL THEN greatest(first - 1, 0) END::bigint AS header_row
 FROM (SELECT statement_id, min(line_no) FILTER (is_data) AS first FROM tested GROUP BY 1)""")
def hdr3_plain(spark, d):
    """Without the structured-only rule."""
    return header_by_density(_all_lines(spark, d), structured_only=False)


@query("hdr4_header_by_keywords", ALL_LINES + window_sql("everything") + " SELECT statement_id, header_row FROM by_keywords")
def hdr4(spark, d):
    return header_by_keywords(_all_lines(spark, d))


@query("hdr5_header_decision", ALL_LINES + window_sql("everything") + """
, filled AS (SELECT statement_id, line_no::bigint AS line_no, line FROM tested WHERE regexp_replace(line, '^\\s+|\\s+$', '', 'g') <> ''),
decided AS (SELECT statement_id, coalesce(d.header_row, k.header_row, 0) AS found FROM by_density d JOIN by_keywords k USING (statement_id))
SELECT statement_id, header_row, header_row <> found AS header_adjusted FROM (
  SELECT statement_id, found, coalesce(max(line_no) FILTER (line_no <= found), min(line_no)) AS header_row
  FROM decided JOIN filled USING (statement_id) GROUP BY 1, 2)""")
def hdr5(spark, d):
    return decide_header(_all_lines(spark, d)).select("statement_id", "header_row", "header_adjusted")


# --- normalised rows and sinks ----------------------------------------------

NORMAL_SQL = "WITH " + V.ORDERS_BY_FILE_SQL + """
, normal AS (SELECT statement_id, slot + CASE style WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 2 END AS line_no,
   strftime(o_orderdate, '%Y-%m-%d') AS date, 'Assets:Bank:Unknown' AS account,
   CASE WHEN outgoing THEN -o_totalprice ELSE o_totalprice END AS amount, 'EUR' AS currency, NULL::double AS price,
   description, true AS amount_ok FROM o)"""


def _normal(spark, d):
    return normalize_statements(V.statement_lines(spark, d)).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("prj2_normalized_rows", NORMAL_SQL + " SELECT * FROM normal")
def prj2(spark, d):
    """Files in four locales and three polarities back to the orders they were made from."""
    return _normal(spark, d).drop("transaction_id", "meta")


@query("prj3_constant_columns", "SELECT o_orderkey, 'Assets:Bank:Unknown' AS account, 'EUR' AS currency, NULL::double AS price FROM orders")
def prj3(spark, d):
    return table(spark, d, "orders").select("o_orderkey").withColumns(constant_columns())


@query("snk1_ledger_csv", NORMAL_SQL + " SELECT statement_id, date, amount, description FROM normal")
def snk1(spark, d):
    path = work_dir(spark) + "/ledger"
    write_ledger_csv(_normal(spark, d).select("statement_id", "date", "amount", "description"), path)
    return spark.read.schema("statement_id string, date string, amount double, description string").option("header", True).csv(path)


@query("snk2_quarantine_csv", LINES + """ SELECT run_id, statement_id, line_no, line FROM lines,
 (VALUES ('run-a'), ('run-b')) r(run_id) WHERE line LIKE '%;too many'""")
def snk2(spark, d):
    """Two runs keep their own rejects; repeating a run does not double them."""
    path = work_dir(spark) + "/quarantine"
    lines = _lines(spark, d)
    rejects = bad_rows(parse_rows(lines, detect_layout(lines)))
    for run in ("run-a", "run-b", "run-a"):
        write_quarantine(rejects, path, run)
    schema = "statement_id string, line_no bigint, line string, run_id string"
    return spark.read.schema(schema).option("header", True).csv(path).select("run_id", "statement_id", "line_no", "line")


RECORD_SQL = """SELECT event_id, json_object('event_type', event_type, 'price', CASE WHEN event_type = 'error' THEN NULL ELSE event_id END)::varchar AS record FROM events"""


@query("snk3_records", RECORD_SQL)
def snk3(spark, d):
    """NaN becomes null in JSON records. Written out and read back as text."""
    path = work_dir(spark) + "/records"
    price = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("event_id").cast("double"))
    rows = nan_to_null(table(spark, d, "events").select("event_id", "event_type", price.alias("price")))
    write_records(rows, path)
    back = spark.read.schema("event_id bigint, event_type string, price double").json(path)
    return back.select("event_id", "event_type", F.col("price").cast("bigint").alias("price")).select(
        "event_id", F.to_json(F.struct("event_type", "price"), {"ignoreNullFields": "false"}).alias("record")
    )
