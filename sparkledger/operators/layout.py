"""Where a statement's table starts and how its lines split into cells.

HDR3-HDR5, SRC3-SRC6. Every decision is an aggregate per statement over facts of its
first lines; the rows follow by a join on (statement, chunk of lines), so that
one huge statement is spread over many tasks. Lines are laid out once in buckets of
statement and chunk: what is decided comes to them, and their text is not shuffled again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import DENSITY_THRESHOLD, MIN_DATA_LENGTH, SEPARATORS, WINDOW_LINES
from ..functions.amounts import is_plain_number, null_if_missing
from ..functions.binding import let
from ..functions.dates import date_shape, format_counts
from ..functions.lines import data_density, has_digit, has_separator, keyword_score
from ..functions.text import strip_text
from ..session import stage_bucketed, stage_table

CHUNK_LINES = 250_000
MASK_BITS = 62
NOT_BLANK = r"(?U)\S"


# --- lines in place -------------------------------------------------------

def with_chunk(lines: DataFrame) -> DataFrame:
    """Lines with ``chunk``, by their number where the reader gave none. Chunks are in the order of lines."""
    if "chunk" in lines.columns:
        return lines
    return lines.withColumn("chunk", F.floor(F.col("line_no") / CHUNK_LINES).cast("bigint"))


def lay_out(lines: DataFrame) -> DataFrame:
    """lines(statement_id, line_no, line, chunk) in buckets of statement and chunk; those that have a chunk are."""
    if "chunk" in lines.columns:
        return lines
    return stage_bucketed(with_chunk(lines.select("statement_id", "line_no", "line")), "lines", ["statement_id", "chunk"])


def join_statement(lines: DataFrame, per_statement: DataFrame) -> DataFrame:
    """Give every line its statement's row. Rows of a long statement are repeated
    once per chunk of lines, so its lines spread over as many tasks and stay where they lie."""
    met = with_chunk(lines).join(_chunk_rows(per_statement), ["statement_id", "chunk"])
    return met if "chunk" in lines.columns else met.drop("chunk")


# --- header detection -----------------------------------------------------

def score_window(lines: DataFrame, window: int = WINDOW_LINES, all_keywords: bool = True) -> DataFrame:
    """Adds density, keyword score and the data test of the first lines.

    A statement with a delimited data line finds its header by density and asks for no
    keywords: without ``all_keywords`` such lines are not searched for them.
    """
    inside = F.col("line_no") < window
    # Scores are taken of a column that is null beyond the window: later lines
    # cost nothing, and repeated parts of the scores are computed once.
    line = F.col("_line")
    is_data = (
        (F.col("density") >= DENSITY_THRESHOLD) & (F.length(strip_text(line)) > MIN_DATA_LENGTH) & has_digit(line)
    )
    scored = lines.withColumn("_line", F.when(inside, F.col("line"))).withColumns(
        {
            "density": data_density(line),
            "delimited": has_separator(line),
        }
    )
    scored = scored.withColumn("is_data", inside & is_data)
    searched = F.lit(all_keywords) | ~F.coalesce(F.col("is_data") & F.col("delimited"), F.lit(False))
    return scored.withColumn("keyword_score", F.when(searched, keyword_score(line)).otherwise(F.lit(0))).drop("_line")


def _by_density(structured_only: bool) -> Column:
    """Header row from the first data line: the line before it, or line 0.

    With ``structured_only`` a line without a delimiter counts as data only when
    no line of the window has one: 'Account: 123-456-789' is not a data row.
    """
    data_line = F.when(F.col("is_data"), F.col("line_no"))
    first = F.min(data_line)
    if structured_only:
        structured = F.min(F.when(F.col("is_data") & F.col("delimited"), F.col("line_no")))
        first = F.when(F.bool_or("delimited"), structured).otherwise(first)
    return F.greatest(first - 1, F.when(first.isNotNull(), F.lit(0)))


def _by_keywords() -> Column:
    return F.max_by("line_no", F.struct(F.col("keyword_score"), -F.col("line_no")))


def header_by_density(lines: DataFrame, structured_only: bool = True) -> DataFrame:
    """(statement_id, header_row); null where no data line is found."""
    return score_window(lines).groupBy("statement_id").agg(_by_density(structured_only).alias("header_row"))


def header_by_keywords(lines: DataFrame) -> DataFrame:
    """(statement_id, header_row) with the most header keywords, the first on ties."""
    inside = score_window(lines).filter(F.col("line_no") < WINDOW_LINES)
    return inside.groupBy("statement_id").agg(_by_keywords().alias("header_row"))


def decide_header(lines: DataFrame, structured_only: bool = True) -> DataFrame:
    """(statement_id, n_lines, chunks, header_row, header_chunk, header_adjusted).

    One pass with partial aggregation of numbers and flags, no text. The window holds at most 20
    lines per statement. A blank header line is replaced by the last filled line above it;
    if the whole window is blank, the first filled line is the header. Blank statements have none.
    """
    scored = score_window(with_chunk(lines), all_keywords=False)
    inside = F.col("line_no") < WINDOW_LINES
    place = F.struct("line_no", "chunk")
    per_statement = scored.groupBy("statement_id").agg(
        (F.max("line_no") + 1).alias("n_lines"),
        F.sort_array(F.collect_set("chunk")).alias("chunks"),
        F.coalesce(
            _by_density(structured_only),
            F.max_by("line_no", F.when(inside, F.struct("keyword_score", -F.col("line_no")))),
            F.lit(0),
        ).alias("found"),
        F.sort_array(F.collect_list(F.when(inside & (strip_text(F.col("line")) != ""), place))).alias("filled"),
        F.min(F.when(F.col("line").rlike(NOT_BLANK), place)).alias("first_filled"),
    )
    above = F.filter("filled", lambda w: w["line_no"] <= F.col("found"))
    header = F.coalesce(F.try_element_at(above, F.lit(-1)), F.try_element_at("filled", F.lit(1)), F.col("first_filled"))
    return (
        per_statement.withColumn("header", header)
        .filter(F.col("header").isNotNull())
        .select(
            "statement_id",
            "n_lines",
            "chunks",
            F.col("header.line_no").alias("header_row"),
            F.col("header.chunk").alias("header_chunk"),
            (F.col("header.line_no") != F.col("found")).alias("header_adjusted"),
        )
    )


def detect_header(lines: DataFrame, structured_only: bool = True) -> DataFrame:
    """``decide_header`` with ``header_line``, taken from where the lines lie."""
    lines = lay_out(lines)
    decided = decide_header(lines, structured_only).withColumnRenamed("header_chunk", "chunk")
    # An equality would become a key of the join, and the lines would be shuffled by it.
    is_header = F.col("line_no").between(F.col("header_row"), F.col("header_row"))
    found = lines.join(decided, ["statement_id", "chunk"]).filter(is_header)
    return found.select("statement_id", "n_lines", "chunks", "header_row", F.col("line").alias("header_line"), "header_adjusted")


# --- delimiter, columns, cells --------------------------------------------

def choose_delimiter(header_line: Column) -> Column:
    """Most frequent separator outside quotes; '' where there is none."""
    bare = F.regexp_replace(header_line, '"[^"]*"', "")
    count = lambda text, sep: F.length(text) - F.length(F.replace(text, F.lit(sep), F.lit("")))
    ranked = lambda text: [
        F.struct(count(text, sep).alias("n"), F.lit(-i).alias("rank"), F.lit(sep).alias("sep"))
        for i, sep in enumerate(SEPARATORS)
    ]
    none = F.struct(F.lit(0).alias("n"), F.lit(1).alias("rank"), F.lit("").alias("sep"))
    return let(bare, lambda text: F.array_max(F.array(none, *ranked(text)))["sep"])


def _by_delimiter(delimiter: Column, make: Callable[[Column, Column], Column]) -> Column:
    """``make`` of the delimiter and its pattern. Known ones come as literals: other patterns are compiled for each row."""
    chosen = make(delimiter, F.when(delimiter == "|", F.lit(r"\|")).otherwise(delimiter))
    for known in SEPARATORS:
        chosen = F.when(delimiter == known, make(F.lit(known), F.lit(r"\|" if known == "|" else known))).otherwise(chosen)
    return chosen


def split_fields(line: Column, delimiter: Column) -> Column:
    """Cells of a line; quoted cells may contain the delimiter and doubled quotes."""
    sep = F.when(delimiter == "|", F.lit(r"\|")).otherwise(delimiter)
    plain = F.split(line, sep, -1)

    def cells(d: Column, sep_: Column) -> Column:
        cell = F.concat(sep_, F.lit(r'("[^"]*+(?:""[^"]*+)*+"[^'), d, F.lit("]*+|[^"), d, F.lit("]*+)"))
        return F.regexp_extract_all(F.concat(d, line), cell, F.lit(1))

    found = _by_delimiter(delimiter, cells)
    unquote = lambda c: F.when(
        F.startswith(c, F.lit('"')),
        F.replace(F.regexp_replace(c, r'(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*)$', "$1$2"), F.lit('""'), F.lit('"')),
    ).otherwise(c)
    return (
        F.when(delimiter == "", F.array(line))
        .when(F.contains(line, F.lit('"')), F.transform(found, unquote))
        .otherwise(plain)
    )


def has_open_quote(line: Column, delimiter: Column) -> Column:
    """A quoted cell starts in this line and does not end in it.

    What follows the last complete cell begins with a quote.
    """

    def broken(d: Column, sep: Column) -> Column:
        cell = F.concat(F.lit(r'(?:"[^"]*+(?:""[^"]*+)*+"[^'), d, F.lit(r']*+|(?!")[^'), d, F.lit("]*+)"))
        return F.rlike(line, F.concat(F.lit("^(?:"), cell, sep, F.lit(r')*+"[^"]*+(?:""[^"]*+)*+\z')))

    return F.contains(line, F.lit('"')) & (delimiter != "") & _by_delimiter(delimiter, broken)


def column_names(header_line: Column, delimiter: Column) -> Column:
    """Stripped names; empty ones get a name, repeated ones a number."""
    named = F.transform(
        F.transform(split_fields(header_line, delimiter), strip_text),
        lambda n, i: F.when(n == "", F.concat(F.lit("Unnamed: "), i.cast("string"))).otherwise(n),
    )
    seen = lambda names, n, i: F.size(F.filter(F.slice(names, F.lit(1), i), lambda m: m == n))
    suffix = lambda n, k: F.when(k > 0, F.concat(n, F.lit("."), k.cast("string"))).otherwise(n)
    count = lambda names: F.transform(names, lambda n, i: suffix(n, seen(names, n, i)))
    # A numbered name may meet one that was there before: then all get their place.
    by_place = lambda names: F.transform(names, lambda n, i: F.concat(n, F.lit("#"), i.cast("string")))
    unique = lambda names: F.when(F.size(F.array_distinct(names)) == F.size(names), names).otherwise(by_place(names))
    return let(let(named, count), unique)


def detect_layout(lines: DataFrame, structured_only: bool = True) -> DataFrame:
    """``detect_header`` plus the delimiter and the column names."""
    return (
        detect_header(lines, structured_only)
        .withColumn("delimiter", choose_delimiter(F.col("header_line")))
        .withColumn("columns", column_names(F.col("header_line"), F.col("delimiter")))
    )


def _chunk_rows(per_statement: DataFrame) -> DataFrame:
    """One row per statement and chunk."""
    numbered = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_lines") - 1) / CHUNK_LINES).cast("bigint"))
    chunks = F.col("chunks") if "chunks" in per_statement.columns else numbered
    return per_statement.withColumn("chunk", F.explode(chunks)).drop("chunks")


def _last_fixed(fixed: Column, order: str, state: Column, flips: Column) -> Column:
    return F.max(F.when(fixed, F.struct(F.col(order), state.alias("state"), flips.alias("flips"))))


def _state_before(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds ``known`` and ``state``: whether the text is inside a quoted cell before
    each row (a line or a range of lines), or if only known from the row before the
    first, whether that changes.

    A row has ``fixed`` (it ends inside, ``ends``, whatever was before) or ``flip``
    (it turns the state round); a row with neither leaves the state.
    """
    here = Window.partitionBy(*keys).orderBy(order)
    so_far, before = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    turned = df.withColumn("_flips", F.sum(F.col("flip").cast("int")).over(so_far))
    found = turned.withColumn("_last", _last_fixed(F.col("fixed"), order, F.col("ends"), F.col("_flips")).over(before))
    flips = F.col("_flips") - F.col("flip").cast("int") - F.coalesce(F.col("_last.flips"), F.lit(0))
    state = F.coalesce(F.col("_last.state"), F.lit(False)) != (flips % 2 == 1)
    return found.withColumn("known", F.col("_last").isNotNull()).withColumn("state", state).drop("_last", "_flips")


def quoted_parts(lines: DataFrame, layout: DataFrame) -> list[DataFrame]:
    """Put together the lines that a quoted cell with line breaks was cut into.

    Each part has (statement_id, line_no, line, chunk, opened_at); together they are the
    statements' records. Only lines after the header count, and only a quote at the
    start of a cell opens one; a quote inside a cell, or in the preamble, is text. A record
    keeps the number of its first line and has as many lines as its cells need.
    A cell that never closes takes the rest of its statement: its lines come singly under
    their own numbers, with the number of the line that opened it as ``opened_at``, which is null
    for all other rows.

    Each line's effect is known for both states before it (inside a cell or not), so
    a chunk is one row that says for both how it ends and where its last record begins.
    These rows are put in order for each statement; then every chunk joins its own lines where
    they lie. Only pieces of records that run on from chunk to chunk are moved. Statements in which no
    cell stays open pass unchanged.
    """
    lines = lay_out(lines)
    keys = ["statement_id", "chunk"]
    facts = layout.select("statement_id", *[c for c in ("n_lines", "chunks") if c in layout.columns], "header_row", "delimiter")
    line, sep = F.col("line"), F.col("delimiter")
    after = F.col("line_no") > F.col("header_row")
    quoted = join_statement(lines.filter(F.contains(line, F.lit('"'))), facts)
    broken = stage_table(quoted.filter(after & has_open_quote(line, sep)).select("statement_id").distinct(), "open-quotes")
    never = F.lit(None).cast(lines.schema["line_no"].dataType)
    if broken.isEmpty():
        return [lines.select("statement_id", "line_no", "line", "chunk", never.alias("opened_at"))]

    begun = after & has_open_quote(line, sep)
    kept = after & (~F.contains(line, F.lit('"')) | has_open_quote(F.concat(F.lit('"'), line), sep))
    effects = join_statement(lines, facts.join(broken, "statement_id")).select(*keys, "line_no", "line", begun.alias("begun"), kept.alias("kept"))
    effects = effects.select(
        *keys, "line_no", "line",
        (F.col("begun") == F.col("kept")).alias("fixed"), F.col("begun").alias("ends"), (F.col("begun") & ~F.col("kept")).alias("flip"),
    )
    local = _state_before(effects, keys, "line_no")
    inside = lambda open_: F.when(F.col("known"), F.col("state")).otherwise(F.col("state") != open_)
    leaves = lambda open_: F.when(F.col("fixed"), F.col("ends")).otherwise(inside(open_) != F.col("flip"))
    begins = lambda open_: F.max(F.when(~inside(open_), F.col("line_no")))
    closed, opened = F.lit(False), F.lit(True)
    chunks = local.groupBy(*keys).agg(
        begins(closed).alias("begin_closed"), begins(opened).alias("begin_open"),
        F.max_by(leaves(closed), "line_no").alias("from_closed"), F.max_by(leaves(opened), "line_no").alias("from_open"),
    )
    order = Window.partitionBy("statement_id").orderBy("chunk")
    earlier, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("statement_id")
    entered = _state_before(
        chunks.withColumns(
            {
                "fixed": F.col("from_closed") == F.col("from_open"),
                "ends": F.col("from_closed"),
                "flip": F.col("from_closed") & ~F.col("from_open"),
            }
        ),
        ["statement_id"],
        "chunk",
    ).select(*keys, F.col("state").alias("open"), *[F.when(F.col("state"), F.col(f"{c}_open")).otherwise(F.col(f"{c}_closed")).alias(c) for c in ("begin", "from")])
    placed_chunks = entered.select(
        *keys, "open", F.max("begin").over(earlier).alias("carried"),
        F.when(F.max(F.struct("chunk", "from")).over(whole)["from"], F.max("begin").over(whole)).alias("open_from"),
    )
    runs_in = F.when(F.col("open") & ~F.col("carried").eqNullSafe(F.col("open_from")), F.col("carried"))
    placed_chunks = placed_chunks.withColumn("runs_in", runs_in).withColumn("runs_on", F.lead("runs_in").over(order))
    placed_chunks = stage_table(placed_chunks, "quote-chunks")

    so_far = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    placed = local.join(placed_chunks, keys)
    first = F.coalesce(F.max(F.when(~inside(F.col("open")), F.col("line_no"))).over(so_far), F.col("carried"))
    placed = placed.withColumn("_first", first).withColumn("opened_at", F.when(F.col("_first") == F.col("open_from"), F.col("_first")))
    record = F.when(F.col("opened_at").isNotNull(), F.col("line_no")).otherwise(F.col("_first"))
    runs_over = F.coalesce(record == F.col("runs_in"), F.lit(False)) | F.coalesce(record == F.col("runs_on"), F.lit(False))
    text = lambda order_, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order_, value))), lambda p: p[value]), "\n")
    pieces = placed.groupBy(*keys, record.alias("record"), "opened_at", runs_over.alias("runs_over")).agg(text("line_no", "line").alias("line"))
    row = ["statement_id", F.col("record").alias("line_no"), "line", "chunk", "opened_at"]
    touched = _chunk_rows(facts.join(broken, "statement_id")).select(*keys)
    unbroken = lines.join(touched, keys, "left_anti").select("statement_id", "line_no", "line", "chunk", never.alias("opened_at"))
    parts = [unbroken, pieces.filter(~F.col("runs_over")).select(*row)]
    if not placed_chunks.filter("runs_in is not null").isEmpty():
        over = pieces.filter("runs_over").groupBy("statement_id", "record").agg(text("chunk", "line").alias("line"), F.min("chunk").alias("chunk"))
        parts.append(over.withColumn("opened_at", never).select(*row))
    return parts


def join_quoted_lines(lines: DataFrame, layout: DataFrame) -> DataFrame:
    """``quoted_parts`` in one DataFrame; steps that go on joining by statement do so part by part."""
    return reduce(DataFrame.unionByName, quoted_parts(lines, layout))


def parse_rows(lines: DataFrame, layout: DataFrame) -> DataFrame:
    """Data rows with ``fields`` aligned to ``columns`` and the flag ``bad``.

    Blank lines are skipped, short rows padded with null, missing-value
    spellings read as null. Bad rows have more cells than the header or end
    inside a quoted cell that never closes (see ``quoted_parts``); ``line`` keeps their text.
    Lines that such a cell holds are bad rows too, also blank ones; where ``lines`` has
    ``opened_at``, so have they.
    """
    cells = split_fields(F.col("line"), F.col("delimiter"))
    unclosed = F.col("opened_at").isNotNull() if "opened_at" in lines.columns else F.lit(False)
    return (
        join_statement(lines, layout)
        .filter((F.col("line_no") > F.col("header_row")) & (F.col("line").rlike(NOT_BLANK) | unclosed))
        .withColumn("_cells", cells)
        .withColumn(
            "bad",
            unclosed | (F.size("_cells") > F.size("columns")) | has_open_quote(F.col("line"), F.col("delimiter")),
        )
        .withColumn(
            "fields",
            F.transform("columns", lambda _, i: null_if_missing(F.get("_cells", i))),
        )
        .drop("_cells", "n_lines", "chunks", "header_line")
    )


def table_rows(parsed: DataFrame) -> DataFrame:
    return parsed.filter(~F.col("bad")).drop("opened_at")


def bad_rows(parsed: DataFrame) -> DataFrame:
    """(statement_id, line_no, line), with ``opened_at`` where the rows have it."""
    return parsed.filter("bad").select("statement_id", "line_no", "line", *[c for c in parsed.columns if c == "opened_at"])


# --- whole-column facts ---------------------------------------------------

def profile_columns(rows: DataFrame, date_text: Column | None = None) -> DataFrame:
    """(statement_id, text_masks[, date_n*]) over all rows of each statement.

    A column is numeric when none of its filled cells is text. The text columns
    of a row are bits of a whole number and statements are combined by bit-or:
    no row is multiplied by its columns, and partial results are one row per
    statement. A number holds 62 columns; wider statements use several.
    """
    fields = F.col("fields")
    mask = lambda w: F.aggregate(
        F.transform(F.slice(fields, w * MASK_BITS + 1, MASK_BITS), _text_bit),
        F.lit(0).cast("bigint"),
        lambda a, b: a.bitwiseOR(b),
    )
    words = F.sequence(F.lit(0), F.floor((F.size(fields) - 1) / MASK_BITS).cast("int"))
    word = F.explode(F.transform(words, lambda w: F.struct(w.alias("word"), mask(w).alias("mask"))))
    text = F.lit(None).cast("string") if date_text is None else date_text
    per_word = rows.select("statement_id", word.alias("w"), text.alias("date")).select(
        "statement_id", "w.word", "w.mask", F.when(F.col("w.word") == 0, F.col("date")).alias("date")
    )
    counts = [] if date_text is None else format_counts(F.col("date"), F.col("shape"))
    names = [f"date_n{i}" for i in range(len(counts))]
    return (
        per_word.withColumn("shape", date_shape(F.col("date")))
        .groupBy("statement_id", "word")
        .agg(F.bit_or("mask").alias("mask"), *counts)
        .groupBy("statement_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("word", "mask"))).alias("text_masks"),
            *[F.sum(n).alias(n) for n in names],
        )
    )


def _text_bit(cell: Column, place: Column) -> Column:
    is_text = cell.isNotNull() & ~is_plain_number(cell)
    powers = F.array(*[F.lit(1 << b).cast("bigint") for b in range(MASK_BITS)])
    return F.when(is_text, F.get(powers, place)).otherwise(F.lit(0).cast("bigint"))


def numeric_flags(columns: Column, text_masks: Column) -> Column:
    """array<boolean> aligned with ``columns``: true for all-numeric columns."""
    powers = F.array(*[F.lit(1 << b).cast("bigint") for b in range(MASK_BITS)])
    word = lambda i: F.get(text_masks, F.floor(i / MASK_BITS).cast("int"))["mask"]
    return F.transform(columns, lambda _, i: word(i).bitwiseAND(F.get(powers, i % MASK_BITS)) == 0)


def numeric_columns(rows: DataFrame) -> DataFrame:
    """(statement_id, pos, name, is_numeric) for every column of every statement."""
    names = rows.groupBy("statement_id").agg(F.any_value("columns").alias("columns"))
    flags = names.join(profile_columns(rows), "statement_id").select(
        "statement_id", F.posexplode(F.arrays_zip("columns", numeric_flags(F.col("columns"), F.col("text_masks")).alias("flag")))
    )
    return flags.select(
        "statement_id",
        F.col("pos").cast("bigint").alias("pos"),
        F.col("col.columns").alias("name"),
        F.col("col.flag").alias("is_numeric"),
    )
