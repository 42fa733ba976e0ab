"""Header names to a column mapping (MAP1-MAP6, PRJ7, JON3).

A mapping depends on the header names alone and is one column expression, so
no join is needed where nothing is cached.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    AMOUNT_KEYWORDS,
    CREDIT_KEYWORDS,
    DATE_KEYWORDS,
    DEBIT_KEYWORDS,
    DECIMAL_COMMA_KEYWORDS,
    DESCRIPTION_KEYWORDS,
    DIRECTION_KEYWORDS,
)
from ..functions.binding import let
from ..functions.identity import header_hash
from ..functions.text import strip_text
from ..sources.tables import MAPPING_TYPE


def strip_headers(headers: Column) -> Column:
    return F.transform(headers, strip_text)


def _keywords(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def find_column(headers: Column, keywords: Sequence[str], default: int) -> Column:
    """First header holding the earliest keyword; else the one at ``default``
    (0-based, negative from the end); else the first."""
    holds = lambda h: F.transform(_keywords(keywords), lambda k: F.contains(F.lower(h), k))
    rank = lambda h: F.array_position(holds(h), F.lit(True))
    ranked = F.transform(headers, lambda h, i: F.struct(rank(h).alias("rank"), i.alias("pos"), h.alias("name")))
    hits = F.filter(ranked, lambda r: r["rank"] > 0)
    place = F.lit(default + 1 if default >= 0 else default)
    return F.coalesce(F.array_min(hits)["name"], F.try_element_at(headers, place), F.try_element_at(headers, F.lit(1)))


def _first_with(headers: Column, keywords: Sequence[str], without: str | None = None) -> Column:
    """struct(pos, name) of the first header holding any keyword, or null."""

    def hit(h: Column) -> Column:
        low = F.lower(h)
        any_ = low.rlike("|".join(r"\Q" + k + r"\E" for k in keywords))
        return any_ & ~F.contains(low, F.lit(without)) if without else any_

    placed = F.transform(headers, lambda h, i: F.struct(i.alias("pos"), h.alias("name")))
    return F.try_element_at(F.filter(placed, lambda p: hit(p["name"])), F.lit(1))


def infer_polarity(headers: Column) -> Column:
    """credit_debit, direction or signed.

    A header such as 'Af Bij' holds a credit and a debit word at once: it is a
    direction column with the values Af and Bij, not two amount columns.
    """
    found = F.struct(
        _first_with(headers, CREDIT_KEYWORDS, without="card").alias("credit"),
        _first_with(headers, DEBIT_KEYWORDS, without="card").alias("debit"),
        _first_with(headers, DIRECTION_KEYWORDS).alias("direction"),
    )
    none = F.lit(None).cast("string")

    def polarity(kind, direction_col=none, out=none, in_=none, credit_col=none, debit_col=none) -> Column:
        return F.struct(
            F.lit(kind).alias("type"),
            direction_col.alias("direction_col"),
            out.alias("outgoing_value"),
            in_.alias("incoming_value"),
            credit_col.alias("credit_col"),
            debit_col.alias("debit_col"),
        )

    def choose(f: Column) -> Column:
        credit, debit, direction = f["credit"], f["debit"], f["direction"]
        both = credit.isNotNull() & debit.isNotNull()
        return (
            F.when(
                both & (credit["pos"] != debit["pos"]),
                polarity("credit_debit", credit_col=credit["name"], debit_col=debit["name"]),
            )
            .when(both, polarity("direction", credit["name"], F.lit("Af"), F.lit("Bij")))
            .when(direction.isNotNull(), polarity("direction", direction["name"], F.lit("Debit"), F.lit("Credit")))
            .otherwise(polarity("signed"))
        )

    return let(found, choose)


def infer_decimal_separator(headers: Column) -> Column:
    text = F.lower(F.array_join(headers, " "))
    return F.when(text.rlike("|".join(DECIMAL_COMMA_KEYWORDS)), F.lit(",")).otherwise(F.lit("."))


def heuristic_mapping(headers: Column) -> Column:
    """Mapping struct of stripped header names."""
    return let(
        infer_polarity(headers),
        lambda polarity: F.struct(
            find_column(headers, DATE_KEYWORDS, 0).alias("date_col"),
            F.when(polarity["type"] != "credit_debit", find_column(headers, AMOUNT_KEYWORDS, 1)).alias("amount_col"),
            find_column(headers, DESCRIPTION_KEYWORDS, -1).alias("desc_col"),
            infer_decimal_separator(headers).alias("decimal_separator"),
            polarity.alias("polarity"),
        ),
    )


def is_valid_mapping(m: Column) -> Column:
    """Date and description are named, and so is what the polarity needs."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    kind = m["polarity"]["type"]
    needed = (
        F.when(kind == "credit_debit", filled(m["polarity"]["credit_col"]) & filled(m["polarity"]["debit_col"]))
        .when(kind == "direction", filled(m["polarity"]["direction_col"]))
        .when(kind == "signed", filled(m["amount_col"]))
        .otherwise(F.lit(True))
    )
    return F.coalesce(filled(m["date_col"]) & filled(m["desc_col"]) & needed, F.lit(False))


def _tidy(m: Column, headers: Column) -> Column:
    """Strip names; a signed mapping without an amount column gets the found one."""
    p = m["polarity"]
    amount = F.when(
        (p["type"] == "signed") & (F.coalesce(m["amount_col"], F.lit("")) == ""),
        find_column(headers, AMOUNT_KEYWORDS, 1),
    ).otherwise(strip_text(m["amount_col"]))
    return F.struct(
        strip_text(m["date_col"]).alias("date_col"),
        amount.alias("amount_col"),
        strip_text(m["desc_col"]).alias("desc_col"),
        m["decimal_separator"].alias("decimal_separator"),
        F.struct(
            p["type"].alias("type"),
            strip_text(p["direction_col"]).alias("direction_col"),
            p["outgoing_value"].alias("outgoing_value"),
            p["incoming_value"].alias("incoming_value"),
            strip_text(p["credit_col"]).alias("credit_col"),
            strip_text(p["debit_col"]).alias("debit_col"),
        ).alias("polarity"),
    )


def lookup_mapping(layouts: DataFrame, mappings: DataFrame, name: str = "cached") -> DataFrame:
    """Left join of a mapping table on ``header_hash``; null where unknown.

    The mapping table has one row per known format. Spark broadcasts it while
    it is small and shuffles both sides otherwise.
    """
    table = mappings.select("header_hash", F.col("mapping").cast(MAPPING_TYPE).alias(name))
    return layouts.join(table, "header_hash", "left")


def resolve_mapping(
    layouts: DataFrame, cached: DataFrame | None = None, proposed: DataFrame | None = None
) -> DataFrame:
    """Adds header_hash, mapping and mapping_source to rows with ``columns``.

    A cached mapping wins as it stands, then a valid proposed one, then the
    heuristic. Both tables are (header_hash, mapping).
    """
    headers = F.col("columns")
    out = layouts.withColumn("header_hash", header_hash(headers))
    own = heuristic_mapping(headers).cast(MAPPING_TYPE)
    mapping, source = own, F.lit("heuristic")
    if proposed is not None:
        out = lookup_mapping(out, proposed, "_proposed")
        good = is_valid_mapping(F.col("_proposed"))
        mapping = F.when(good, _tidy(F.col("_proposed"), headers)).otherwise(mapping)
        source = F.when(good, F.lit("proposed")).otherwise(source)
    if cached is not None:
        out = lookup_mapping(out, cached, "_cached")
        known = F.col("_cached").isNotNull()
        mapping = F.when(known, F.col("_cached")).otherwise(mapping)
        source = F.when(known, F.lit("cached")).otherwise(source)
    return out.withColumns({"mapping": mapping, "mapping_source": source}).drop("_proposed", "_cached")
