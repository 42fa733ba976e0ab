"""One query for each corpus operator, over its whole table."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytebpe, conversations, decontaminate, language, licenses, mixing, neardup, substrings, tokens, topk, toxicity, urls, whitening
from .registry import query, table


def checksum(column: str):
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


@query("op1_language")
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(checksum("doc_id") % 3 == 1, F.lit(False))
    model = language.learn(docs.filter(~held_out))
    judged = language.identify(docs.select("doc_id", "text"), model)
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.size("lang_spans").alias("n_spans"))


OP2_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(md5(text), '')) AS k,
    CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), weighed AS (
  SELECT *, source_size * 2.0::DOUBLE AS lim,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS weight
  FROM sizes
), levels AS (
  SELECT *, row_number() OVER (ORDER BY lim / weight, source NULLS LAST) AS place,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), opened AS (
  SELECT arg_min(level, place) AS level FROM levels WHERE level * weight < lim
), goals AS (
  SELECT l.source, source_size, least(lim, coalesce(o.level * weight, lim)) AS target,
    CAST(floor(least(lim, coalesce(o.level * weight, lim))) AS BIGINT) AS words
  FROM levels l, opened o
), groups AS (
  SELECT source, k, sum(size)::BIGINT AS size, count(*) AS n FROM docs GROUP BY source, k
), placed AS (
  SELECT g.source, g.k, g.n, g.size, q.source_size, q.target,
    CASE WHEN q.source_size > 0 THEN q.words // q.source_size ELSE 0 END AS epochs,
    CASE WHEN q.source_size > 0 THEN q.words % q.source_size ELSE 0 END AS rest,
    (sum(g.size) OVER (PARTITION BY g.source ORDER BY g.k) - g.size)::BIGINT AS so_far
  FROM groups g JOIN goals q ON g.source IS NOT DISTINCT FROM q.source
)
SELECT d.doc_id, d.size, p.source_size, p.target,
  (p.epochs * d.size + CASE WHEN p.so_far + p.size < p.rest THEN d.size WHEN p.so_far < p.rest THEN (p.rest - p.so_far) // p.n ELSE 0 END)::BIGINT AS taken
FROM docs d JOIN placed p ON d.source IS NOT DISTINCT FROM p.source AND d.k = p.k
"""


@query("op2_mixing", OP2_SQL)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_words(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


OP3_SQL = """
WITH whole AS (
  SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op3_exact_top_k", OP3_SQL)
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.filter(F.coalesce(checksum("doc_id") % 5 != 0, F.lit(False))))
    held_out = F.coalesce(checksum("doc_id") % 5 == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


#: Place of the public vocabulary; another with SPARKLEDGER_VOCABULARY.
VOCABULARY = os.environ.get("SPARKLEDGER_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY)


URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

OP6_SQL = r"""
WITH cut AS (
  SELECT page_id, coalesce(url, '') AS u, instr(coalesce(url, ''), '://') AS p FROM pages
), rests AS (
  SELECT *, CASE WHEN p > 0 THEN substr(u, p + 3) ELSE '' END AS rest FROM cut
), hosts AS (
  SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM rests
), behinds AS (
  SELECT *, substr(rest, length(host) + 1) AS behind FROM hosts
), parts AS (
  SELECT *, regexp_extract(behind, '^[^?#]*') AS path, regexp_extract(behind, '^[^?#]*\?([^#]*)', 1) AS query, string_split(host, '.') AS labels FROM behinds
), tokened AS (
  SELECT row_number() OVER () AS r, page_id, host, path, list_sort(list_distinct(
    (CASE WHEN p > 1 THEN ['scheme:' || translate(substr(u, 1, p - 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')] ELSE [] END)
    || (CASE WHEN labels[-1] <> '' THEN ['tld:' || labels[-1]] ELSE [] END)
    || ['label:' || x FOR x IN labels[:-2] IF x <> '']
    || (CASE WHEN regexp_extract(path, '^/([^/]+)', 1) <> '' THEN ['first:' || regexp_extract(path, '^/([^/]+)', 1)] ELSE [] END)
    || (CASE WHEN regexp_extract(path, '\.([^./]+)$', 1) <> '' THEN ['end:' || regexp_extract(path, '\.([^./]+)$', 1)] ELSE [] END)
    || ['param:' || regexp_extract(x, '^[^=]*') FOR x IN string_split(query, '&') IF regexp_extract(x, '^[^=]*') <> '']
    || (CASE WHEN contains(behind, '#') THEN ['fragment'] ELSE [] END))) AS tokens
  FROM parts
), rules(verdict, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), given AS (
  SELECT t.r, arg_max(h || rules.p, length(h || rules.p)) AS rule, arg_max(verdict, length(h || rules.p)) AS verdict
  FROM tokened t JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, rules.p) GROUP BY t.r
), known AS (
  SELECT doc_id, min(CASE quality WHEN 0 THEN 'block' WHEN 1 THEN 'allow' END) AS label FROM labels GROUP BY doc_id
), labelled AS (
  SELECT t.r, tokens, coalesce(g.verdict, k.label) AS label FROM tokened t LEFT JOIN given g USING (r) LEFT JOIN known k ON k.doc_id = t.page_id
  WHERE coalesce(g.verdict, k.label) IS NOT NULL
), subsets AS (
  SELECT [tokens[i] FOR i IN generate_series(1, len(tokens)) IF (s >> (i - 1)::INT) & 1 = 1] AS x, label
  FROM labelled, LATERAL (SELECT unnest(generate_series(1, (1 << len(tokens)::INT) - 1)) AS s)
), counted AS (
  SELECT x, count(*) AS n, count(*) FILTER (label = 'block') AS b FROM subsets GROUP BY x
), mined AS (
  SELECT x FROM counted WHERE b >= greatest(5, ceil(0.01::DOUBLE * (SELECT count(*) FROM labelled))) AND b::DOUBLE / n >= 0.8
)
SELECT t.page_id, t.host, t.path, g.rule,
  coalesce(g.verdict, CASE WHEN EXISTS (SELECT 1 FROM mined m WHERE list_has_all(t.tokens, m.x)) THEN 'block' ELSE 'allow' END) AS verdict
FROM tokened t LEFT JOIN given g USING (r)
"""


@query("op6_url_filter", OP6_SQL)
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of pages without a rule: the quality label that carries the page's id."""
    quality = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when(F.col("quality") == 0, F.lit("block")).when(F.col("quality") == 1, F.lit("allow")).alias("label"))
    return urls.judge(table(spark, sf_dir, "pages"), quality, URL_RULES)


_NOTICE_ROWS = ", ".join(f"('{name}', '{notice}')" for name, notice in licenses.NOTICES)
_WORDS = r"[x FOR x IN regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{{L}}\p{{N}}]+') IF x <> '']"
_RUNS = "CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN generate_series(1, len(w) - 4)] END"

#: Every window is compared with every notice: the twin finds what the bands may miss with a chance of 1e-4.
OP7_SQL = rf"""
WITH notices AS (
  SELECT license, list_distinct({_RUNS}) AS s FROM (SELECT license, {_WORDS.format("notice")} AS w FROM (VALUES {_NOTICE_ROWS}) v(license, notice))
), parts AS (
  SELECT license, len(s) AS size, unnest(s) AS shingle FROM notices
), runs AS (
  SELECT doc_id, text, {_RUNS} AS s FROM (SELECT DISTINCT doc_id, text, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL)
), places AS (
  SELECT doc_id, text, unnest(s) AS shingle, unnest(generate_series(0, len(s) - 1)) AS pos FROM runs
), hits AS (
  SELECT doc_id, text, license, size, pos, p.shingle, pos // size AS grp FROM places JOIN parts p USING (shingle)
), windows AS (
  SELECT doc_id, text, license, size, count(DISTINCT shingle) AS n, min(pos) AS first_word
  FROM (SELECT *, grp AS win FROM hits UNION ALL SELECT *, grp - 1 FROM hits) GROUP BY doc_id, text, license, size, win
), ranked AS (
  SELECT doc_id, license, n / size::DOUBLE AS containment, first_word::INT AS first_word,
    row_number() OVER (PARTITION BY doc_id, license ORDER BY n DESC, first_word) AS k
  FROM windows WHERE n / size::DOUBLE >= 0.8
)
SELECT doc_id, license, containment, first_word FROM ranked WHERE k = 1
"""


@query("op7_license_scan", OP7_SQL)
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op8_substring_repeats")
def op8_substring_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.find_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op10_near_duplicates")
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_components(table(spark, sf_dir, "documents"), percent=85)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


@query("op9_decontamination")
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: Place of the public ranks of a byte-level vocabulary; another with SPARKLEDGER_RANKS.
RANKS = os.environ.get("SPARKLEDGER_RANKS", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query("op13_byte_bpe")
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bytebpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, forms=["packed"])
    back = bytebpe.decode(encoded, RANKS, ids="packed")
    return back.select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audit(conversations.damage(table(spark, sf_dir, "conversations")), times="times")


@query("op11_embedding_whitening")
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    model = whitening.fit(rows, most=16)
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.values)) if len(model.values) else F.lit(None).cast("array<double>")
    cells = whitening.whiten(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return cells.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
