"""URL filters: given host and path rules, and mined association rules for the rest.

FP-growth mines combinations of URL tokens that go with the label ``block``; rules of
enough support and confidence are kept, those that hold another rule's tokens are
dropped (it matches whenever they do), and the rest match by an inverted index: each
rule is posted under its rarest token, and a URL that has this token is checked for
the others. URLs with equal tokens are matched once. DataFrame functions only.

Host: from the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case.
Path: then up to ``?``, ``#`` or the end. A null URL, or one without ``://``, has
empty host and path and no tokens, fits no rule, and is allowed. Labels other than
``block`` count as not blocked; without labels nothing is mined and nothing blocked.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_table

BLOCK, ALLOW = "block", "allow"
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE = 0.01, 5, 0.8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLOCKED_ITEM = "=block"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """``pages`` with host, path and tokens (distinct, sorted)."""
    address = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(address, "://")
    rest = F.when(at > 0, F.substring(address, at + 3, F.length(address))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    behind = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(behind, "^[^?#]*", 0)
    query = F.regexp_extract(behind, r"^[^?#]*\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    first = F.regexp_extract(path, "^/([^/]+)", 1)
    end = F.regexp_extract(path, r"\.([^./]+)$", 1)
    some = lambda name, value: F.when(value != "", F.array(F.concat(F.lit(name), value))).otherwise(F.array().cast("array<string>"))
    named = lambda name, values: F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(name), x))
    tokens = F.concat(
        some("scheme:", F.when(at > 0, F.translate(F.substring(address, F.lit(1), at - 1), _UPPER, _LOWER)).otherwise(F.lit(""))),
        some("tld:", F.element_at(labels, -1)),
        named("label:", F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0)))),
        some("first:", first),
        some("end:", end),
        named("param:", F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^[^=]*", 0))),
        F.when(F.contains(behind, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>")),
    )
    return pages.withColumns({"host": host, "path": path, "tokens": F.array_sort(F.array_distinct(tokens))})


def rule_for(rules: Sequence[tuple[str, str, str]], host: str = "host", path: str = "path") -> Column:
    """Struct (size, rule, verdict) of the longest of the given (verdict, host, path) rules that fits, or null.

    A rule fits its host and all its subdomains if the path starts with the rule's.
    The rules are part of the query, so they are a bounded list.
    """
    fitting = [
        F.when(
            ((F.col(host) == h) | F.endswith(F.col(host), F.lit("." + h))) & F.startswith(F.col(path), F.lit(p)),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    none = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return F.greatest(none, none, *fitting)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """Rules (tokens, support, confidence) for ``block`` from labelled rows (tokens, label).

    A rule has MIN_COUNT rows at least and ``min_support`` of all; with 0 the count
    alone decides, at all sizes.
    """
    blocked = F.when(F.col("label") == BLOCK, F.array(F.lit(_BLOCKED_ITEM))).otherwise(F.array().cast("array<string>"))
    rows = stage_table(labelled.filter("label is not null").select(F.concat("tokens", blocked).alias("items")), "url-labels")
    n = rows.count()
    least = max(MIN_COUNT, math.ceil(min_support * n))
    if n < least:
        return rows.select(F.col("items").alias("tokens"), F.lit(0.0).alias("support"), F.lit(0.0).alias("confidence")).filter("false")
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=MIN_CONFIDENCE).fit(rows)
    found = model.associationRules.filter(F.col("consequent") == F.array(F.lit(_BLOCKED_ITEM)))
    return found.select(F.array_sort("antecedent").alias("tokens"), "support", "confidence")


def matches(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, rule): every token set of ``sets`` with every rule (a token set) that it contains."""
    seen = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    parts = rules.select(F.col("tokens").alias("rule"), F.explode("tokens").alias("token")).join(seen, "token")
    posted = parts.groupBy("rule").agg(F.min(F.struct("n", "token")).alias("rarest"), F.count("*").alias("known"))
    posted = posted.filter(F.col("known") == F.size("rule")).select("rule", F.col("rarest.token").alias("token"))
    probes = sets.select("tokens", F.explode("tokens").alias("token"))
    return probes.join(posted, "token").filter(F.size(F.array_except("rule", "tokens")) == 0).select("tokens", "rule")


def minimal(rules: DataFrame) -> DataFrame:
    """Rules that hold no other rule."""
    larger = matches(rules.select("tokens"), rules.select("tokens")).filter("tokens <> rule").select("tokens").distinct()
    return rules.join(larger, "tokens", "left_anti")


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]], page_id: str = "page_id", url: str = "url", own_labels: bool = False) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``.

    A page's label, for mining, is the verdict of its rule; where none fits, that of
    ``labels`` (page_id, label). The verdict is the rule's, else ``block`` if a mined rule matches.

    With ``own_labels`` only pages that no given rule decides are mined, by ``labels``
    alone, and MIN_COUNT rows are support enough, so that neither the table's size nor
    what the given rules decide hides a small host.
    """
    parts = with_parts(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")))
    parts = stage_table(parts.withColumn("given", rule_for(rules)).select("page_id", "host", "path", "tokens", "given"), "urls")
    known = labels.groupBy("page_id").agg(F.min("label").alias("label"))
    if own_labels:
        labelled = parts.filter("given is null").join(known, "page_id").select("tokens", "label")
    else:
        labelled = parts.join(known, "page_id", "left").select("tokens", F.coalesce("given.verdict", "label").alias("label"))
    kept = stage_table(minimal(stage_table(mine(labelled, 0.0 if own_labels else MIN_SUPPORT), "url-rules")), "url-rules")
    sets = parts.filter("given is null").select("tokens").distinct()
    blocked = matches(sets, kept.select("tokens")).select("tokens").distinct().withColumn("blocked", F.lit(True))
    mined = F.when(F.col("blocked"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return parts.join(blocked, "tokens", "left").select("page_id", "host", "path", F.col("given.rule").alias("rule"), F.coalesce("given.verdict", mined).alias("verdict"))
