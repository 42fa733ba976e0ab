"""Queries over descriptions: TXT*, UDF2, JON7-JON10, AGG6, KNW4, SRT3."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import BANNED_TAGS, STOP_WORDS
from ..functions.text import (
    clean_text,
    collapse_spaces,
    drop_banned_tags,
    drop_noise,
    drop_stop_words,
    match_key,
    match_words,
    tokenize,
    upper_text,
)
from ..operators.entities import (
    alias_table,
    apply_context_rules,
    categorize,
    discover_entities,
    find_by_alias,
    match_aliases,
    register_entities,
)
from ..operators.fuzzy import find_similar, find_similar_inside, rank_similar
from . import views as V
from .registry import query, table


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


UPPER_SQL = "upper(replace(text, 'ß', 'ss'))"


@query("txt1_upper", f"SELECT doc_id, {UPPER_SQL} AS text FROM documents")
def txt1(spark, d):
    return _docs(spark, d).select("doc_id", upper_text(F.col("text")).alias("text"))


# Words with their neighbours blank: a stop word is one whole piece between borders.
@query("txt2_stop_words", f"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace({UPPER_SQL}, '([A-Za-z0-9_]+)', chr(1) || '\\1' || chr(2), 'g'),
  chr(1) || '(?:{'|'.join(STOP_WORDS)}|EST|AND)' || chr(2), ' ', 'g'), '[\\x01\\x02]', '', 'g') AS text FROM documents""")
def txt2(spark, d):
    """Also the caller's own stop words (UDF2)."""
    return _docs(spark, d).select("doc_id", drop_stop_words(upper_text(F.col("text")), ["and", "est"]).alias("text"))




@query("txt3_noise", f"SELECT conv_id, turn, {V.clean_sql('text')} AS text FROM conversations")
def txt3(spark, d):
    """Noise patterns; blanks collapsed so that both sides compare."""
    t = drop_noise(drop_stop_words(F.upper("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", collapse_spaces(t).alias("text"))


@query("txt4_collapse_spaces", r"SELECT page_id, trim(regexp_replace(html, '\s+', ' ', 'g')) AS text FROM pages")
def txt4(spark, d):
    return table(spark, d, "pages").select("page_id", collapse_spaces(F.col("html")).alias("text"))


@query("txt5_clean_description", f"SELECT doc_id, {V.clean_sql('text')} AS clean FROM documents UNION ALL SELECT -1 - page_id, {V.clean_sql('html')} FROM pages UNION ALL SELECT NULL, ''")
def txt5(spark, d):
    pages = table(spark, d, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.col("html").alias("text"))
    null_row = spark.range(1).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    rows = _docs(spark, d).unionByName(pages).unionByName(null_row)
    return rows.select("doc_id", clean_text(F.col("text")).alias("clean"))


TOKENS_SQL = r"""list_filter(list_transform(string_split_regex({x}, '[/:*;,-]|\s\s+'), lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')),
 lambda t: length(t) > 1 AND NOT regexp_matches(t, '^[0-9.]+$') AND NOT regexp_matches(t, '^[A-Za-z0-9]{{16,}}$'))"""


@query("txt6_tokens", f"SELECT doc_id, {TOKENS_SQL.format(x='text')} AS tokens FROM documents UNION ALL SELECT -1 - page_id, {TOKENS_SQL.format(x='html')} FROM pages")
def txt6(spark, d):
    pages = table(spark, d, "pages").select((-1 - F.col("page_id")).alias("doc_id"), F.col("html").alias("text"))
    return _docs(spark, d).unionByName(pages).select("doc_id", tokenize(F.col("text")).alias("tokens"))


BANNED_SQL = "[" + ", ".join(f"'{t}'" for t in BANNED_TAGS) + "]"


@query("txt7_banned_tags", f"""SELECT o_orderkey, list_filter(['BEA', 'Betaalpas', o_orderpriority, 'nr', 'Name'], lambda t: NOT list_contains({BANNED_SQL}, upper(t))) AS tokens FROM orders""")
def txt7(spark, d):
    line = F.concat(F.lit("BEA, Betaalpas*"), F.translate("o_orderpriority", "-", "_"), F.lit("*nr:Name/12.50"))
    tokens = F.transform(drop_banned_tags(tokenize(line)), lambda t: F.translate(t, "_", "-"))
    return table(spark, d, "orders").select("o_orderkey", tokens.alias("tokens"))


# --- aliases ----------------------------------------------------------------

# Merchants: every benchmark item is one, known by its first two words and by
# its third to fifth word.
def _entities(spark, d):
    words = match_words(F.col("text"))
    run = lambda a, n: F.array_join(F.slice(words, a, n), "-")
    return table(spark, d, "benchmark").select(
        F.format_string("B%06d", F.col("item_id")).alias("canonical_name"),
        F.concat(F.lit("Cat"), (F.col("item_id") % 7).cast("string")).alias("default_category"),
        F.array(run(1, 2), run(3, 3)).alias("aliases"),
    )


ENTITIES_SQL = f"""
words AS (SELECT item_id, string_split({V.match_key_sql('text')}, ' ') AS w FROM benchmark),
entities AS (SELECT 'B' || lpad(item_id::varchar, 6, '0') AS canonical_name, 'Cat' || (item_id % 7)::varchar AS default_category,
  [array_to_string(w[1:2], '-'), array_to_string(w[3:5], '-')] AS aliases FROM words),
named AS (SELECT canonical_name, default_category, unnest(list_append(aliases, canonical_name)) AS alias FROM entities),
keyed AS (SELECT *, {V.match_key_sql('alias')} AS alias_key FROM named),
alias_keys AS (SELECT alias_key, min(canonical_name) AS canonical_name, arg_min(default_category, canonical_name) AS default_category
  FROM keyed WHERE alias_key <> '' GROUP BY 1)"""


@query("jon7_exact_alias", f"""WITH {ENTITIES_SQL},
names AS (SELECT item_id, '  ' || upper(replace(array_to_string(w[1:2], '-'), 'ß', 'ss')) || ' ' AS name FROM words UNION ALL SELECT -1 - item_id, text FROM benchmark),
exact AS (SELECT lower(trim(alias)) AS a, min(canonical_name) AS canonical_name, arg_min(default_category, canonical_name) AS default_category FROM keyed GROUP BY 1)
SELECT item_id, canonical_name, default_category FROM names LEFT JOIN exact ON lower(trim(name)) = a""")
def jon7(spark, d):
    b = table(spark, d, "benchmark")
    words = match_words(F.col("text"))
    name = F.concat(F.lit("  "), F.upper(F.array_join(F.slice(words, 1, 2), "-")), F.lit(" "))
    names = b.select("item_id", name.alias("name")).unionByName(b.select((-1 - F.col("item_id")).alias("item_id"), F.col("text").alias("name")))
    return find_by_alias(names, _entities(spark, d)).select("item_id", "canonical_name", "default_category")


CONTAINED_SQL = """SELECT {key}, arg_max(canonical_name, (length(alias_key), alias_key)) AS canonical_name,
 arg_max(default_category, (length(alias_key), alias_key)) AS default_category, arg_max(alias_key, (length(alias_key), alias_key)) AS alias_key
 FROM {texts} JOIN alias_keys ON contains(' ' || k || ' ', ' ' || alias_key || ' ') GROUP BY ALL"""


@query("jon8_alias_in_text", f"""WITH {ENTITIES_SQL},
texts AS (SELECT doc_id, {V.match_key_sql('text')} AS k FROM documents)
{CONTAINED_SQL.format(key='doc_id', texts='texts')}""")
def jon8(spark, d):
    """Longest alias inside every document."""
    return match_aliases(_docs(spark, d), alias_table(_entities(spark, d)), "text", "doc_id")


@query("jon8_categorize", f"""WITH {ENTITIES_SQL},
texts AS (SELECT DISTINCT text, {V.match_key_sql('text')} AS k FROM conversations),
hits AS ({CONTAINED_SQL.format(key='text', texts='texts')})
SELECT conv_id, turn, canonical_name AS entity,
 CASE WHEN canonical_name IS NULL THEN 'Uncategorized' WHEN contains(lower(text), 'tion') AND default_category = 'Cat3' THEN 'Override' ELSE default_category END AS category
FROM conversations LEFT JOIN hits USING (text)""")
def jon8_categorize(spark, d):
    """Every conversation turn, with a context rule on some merchants."""
    entities = _entities(spark, d)
    rule = F.array(F.struct(F.lit("TION").alias("contains_keyword"), F.lit("Override").alias("assign_category")))
    rules = entities.filter("default_category = 'Cat3'").select("canonical_name", rule.alias("rules"))
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("description"))
    return categorize(turns, alias_table(entities), rules=rules).select("conv_id", "turn", "entity", "category")


# Edit distance in SQL counts bytes, so both sides compare words without accents.
ACCENTED, PLAIN = "áàâäãéèêëíìîïóòôöõúùûüñçß", "aaaaaeeeeiiiiooooouuuuncs"


def _similar(spark, d):
    words = lambda t: table(spark, d, t).select(F.explode(match_words(F.col("text"))).alias("w")).select(
        F.translate("w", ACCENTED, PLAIN).alias("w")
    ).filter("w <> ''").distinct()
    return find_similar(words("conversations"), words("benchmark"), "w", "w")


SIMILAR_SQL = f"""
words AS (SELECT 'c' AS side, unnest(string_split({V.match_key_sql('text')}, ' ')) AS w FROM conversations
  UNION ALL SELECT 'b', unnest(string_split({V.match_key_sql('text')}, ' ')) FROM benchmark),
sides AS (SELECT DISTINCT side, translate(w, '{ACCENTED}', '{PLAIN}') AS w FROM words WHERE w <> ''),
alike AS (SELECT a.w AS candidate, b.w AS name, 1 - levenshtein(a.w, b.w) / greatest(length(a.w), length(b.w)) AS score
  FROM sides a JOIN sides b ON a.side = 'c' AND b.side = 'b' AND abs(length(a.w) - length(b.w)) <= 0.2 * greatest(length(a.w), length(b.w)) + 1e-9
  WHERE levenshtein(a.w, b.w) <= 0.2 * greatest(length(a.w), length(b.w)) + 1e-9)"""


@query("jon9_fuzzy_suggestions", f"WITH {SIMILAR_SQL} SELECT * FROM alike")
def jon9(spark, d):
    """All words of the conversations against all words of the benchmark items."""
    return _similar(spark, d)


@query("srt3_ranked_suggestions", f"""WITH {SIMILAR_SQL}
SELECT candidate, name, score, row_number() OVER (PARTITION BY candidate ORDER BY score DESC, name) AS rank FROM alike""")
def srt3(spark, d):
    return rank_similar(_similar(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


# Brute force: every run of up to four of a line's words; a name of two words scores 0.9 with no longer one.
INSIDE_SQL = f"""
plain AS (SELECT conv_id, turn, translate({V.match_key_sql('text')}, '{ACCENTED}', '{PLAIN}') AS k FROM conversations),
names AS (SELECT DISTINCT array_to_string(string_split(translate({V.match_key_sql('text')}, '{ACCENTED}', '{PLAIN}'), ' ')[1:2], ' ') AS name FROM benchmark),
lines AS (SELECT DISTINCT k AS line, string_split(k, ' ') AS w FROM plain WHERE k <> ''),
runs AS (SELECT line, i, array_to_string(w[i:i + m - 1], ' ') AS found FROM (SELECT line, w, unnest(range(1, len(w) + 1)) AS i FROM lines), range(1, 5) t(m) WHERE i + m - 1 <= len(w)),
pairs AS (SELECT line, i, found, name, 1 - levenshtein(found, name) / greatest(length(found), length(name)) AS score FROM runs JOIN names
  ON name <> '' AND abs(length(found) - length(name)) <= 0.1 * greatest(length(found), length(name)) + 1e-9
  WHERE levenshtein(found, name) <= 0.1 * greatest(length(found), length(name)) + 1e-9),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY line, name ORDER BY score DESC, i, length(found)) = 1)"""


@query("jon9_name_inside_line", f"WITH {INSIDE_SQL} SELECT line, name, found, score FROM best")
def jon9_inside(spark, d):
    """The first two words of each benchmark item as a name, inside every conversation turn."""
    plain = lambda t: table(spark, d, t).select(F.translate(match_key(F.col("text")), ACCENTED, PLAIN).alias("k")).filter("k <> ''")
    names = plain("benchmark").select(F.substring_index("k", " ", 2).alias("name")).distinct()
    return find_similar_inside(plain("conversations").withColumnRenamed("k", "line"), names, min_score=0.9)


@query("jon10_context_rules", """
SELECT event_id, CASE WHEN contains(lower(props), '"k": 1') THEN 'First' WHEN contains(lower(event_type), 'error') THEN 'Second' ELSE 'Default' END AS category FROM events""")
def jon10(spark, d):
    rule = lambda k, c: F.struct(F.lit(k).alias("contains_keyword"), F.lit(c).alias("assign_category"))
    rules = F.array(rule('"K": 1', "First"), rule("Error", "Second"))
    text = F.concat_ws(" ", "event_type", "props")
    return table(spark, d, "events").select("event_id", apply_context_rules(F.lit("Default"), rules, text).alias("category"))


@query("agg6_discover_entities", f"""
WITH rows AS (SELECT text AS example, lower({V.clean_sql('text')}) AS raw FROM documents WHERE source <> 'src1'),
pairs AS (SELECT DISTINCT raw, example FROM rows WHERE raw <> ''),
firsts AS (SELECT raw, list(example ORDER BY example) AS original_examples FROM
  (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY raw ORDER BY example) <= 3) GROUP BY raw)
SELECT raw, n_rows, original_examples, NULL::varchar AS suggested_name
FROM (SELECT raw, count(*) AS n_rows FROM rows WHERE raw <> '' GROUP BY raw) JOIN firsts USING (raw)""")
def agg6(spark, d):
    """Documents of one source count as categorised; the rest is unknown."""
    docs = table(spark, d, "documents").select(
        F.col("text").alias("description"), F.when(F.col("source") == "src1", "Known").otherwise("Uncategorized").alias("category")
    )
    return discover_entities(docs)


@query("knw4_register_entities", """
WITH changes AS (SELECT 'N' || (p_partkey % 50)::varchar AS canonical_name, p_type AS default_category, p_name AS alias, p_partkey AS version FROM part),
old AS (SELECT 'N' || (s_suppkey % 70)::varchar AS canonical_name, 'Old' AS default_category, s_name AS alias FROM supplier),
aliases AS (SELECT canonical_name, list(alias ORDER BY alias) AS aliases FROM (SELECT canonical_name, alias FROM changes UNION SELECT canonical_name, alias FROM old) GROUP BY 1),
cats AS (SELECT canonical_name, arg_max(default_category, version) AS default_category FROM
  (SELECT canonical_name, default_category, version FROM changes UNION ALL SELECT canonical_name, default_category, -1 FROM old) GROUP BY 1)
SELECT canonical_name, default_category, aliases FROM cats JOIN aliases USING (canonical_name)""")
def knw4(spark, d):
    old = table(spark, d, "supplier").groupBy(F.concat(F.lit("N"), (F.col("s_suppkey") % 70).cast("string")).alias("canonical_name")).agg(
        F.lit("Old").alias("default_category"), F.collect_set("s_name").alias("aliases")
    )
    changes = table(spark, d, "part").select(
        F.concat(F.lit("N"), (F.col("p_partkey") % 50).cast("string")).alias("canonical_name"),
        F.col("p_type").alias("default_category"), F.col("p_name").alias("alias"), F.col("p_partkey").alias("version"),
    )
    return register_entities(old, changes)
