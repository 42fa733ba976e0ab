"""Fuzzy suggestion of names, for whole texts and for names inside longer lines (JON9, SRT3).

A score is 1 - edits / the longer length. Whole texts meet names on q-grams: every edit spoils at
most q of a name's grams (an insertion q - 1), so of a name's grams a known number can be lost, D. Of any
D + 1 of them one is in the text as it is. Each name is posted under its D + 1 grams that
fewest names have; a text is probed with each of its grams once, so probes grow with its
length. Where a text has the gram says where the name lies, give or take the edits; only
that is scored. Inside a line a name is met by its pieces: cut into one piece more than there can
be edits, one piece is in the line as it is. A piece is found by its first gram and compared
whole on the spot. The results equal comparing all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match_key

FUZZY_MIN_SCORE = 0.8
ROUNDING = 1e-9
#: Gram lengths, the best first. A name takes the first by which it has more grams than can be lost.
GRAMS = (3, 2, 1)
#: Places of a text that share a cell.
CELL = 4
#: Places that are read from one cut of a line.
CUT = 64


def edit_score(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def _edits(length: Column, min_score: float) -> Column:
    return F.floor((1 - min_score) * length + ROUNDING).cast("int")


def _longest(length: Column, min_score: float) -> Column:
    return F.floor(length / min_score + ROUNDING).cast("int")


def _most_lost(length: Column, q: int, min_score: float) -> Column:
    """Grams of a name that a text within the score can lack: q for each edit, less one for each insertion that its length tells of."""
    sizes = F.sequence(length, _longest(length, min_score))
    return F.array_max(F.transform(sizes, lambda m: q * _edits(m, min_score) - (m - length)))


def text_grams(texts: DataFrame, key: str, text: str, sizes: list[int]) -> DataFrame:
    """(key, q, gram, at): every gram of every text, ``at`` its 0-based place; at most len(sizes) rows a character."""

    def of(q: int) -> Column:
        count = F.length(text) - (q - 1)
        places = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(F.lit(q).alias("q"), F.substring(F.col(text), i + 1, F.lit(q)).alias("gram"), i.alias("at")))

    grams = F.concat(*[of(q) for q in sizes])
    return texts.select(key, F.explode(grams).alias("g")).select(key, "g.q", "g.gram", "g.at")


def _named(names: DataFrame, name: str, min_score: float) -> DataFrame:
    """Distinct names with their gram length and how many grams can be lost."""
    sides = names.select(F.col(name).alias("name")).filter(F.length(name) > 0).distinct().withColumn("n", F.length("name"))
    q, lost = F.lit(None).cast("int"), F.lit(None).cast("int")
    for size in reversed(GRAMS):
        most = _most_lost(F.col("n"), size, min_score)
        enough = most + 1 <= F.col("n") - (size - 1)
        q, lost = F.when(enough, F.lit(size)).otherwise(q), F.when(enough, most).otherwise(lost)
    return sides.select("name", "n", q.alias("q"), lost.alias("lost"))


def _sizes(names: DataFrame) -> list[int]:
    """The gram lengths that occur, at most len(GRAMS)."""
    return sorted(r["q"] for r in names.select("q").distinct().collect()) or [1]


def name_postings(names: DataFrame) -> DataFrame:
    """(name, n, q, lost, gram, place): each name of ``_named`` under its ``lost`` + 1 grams that fewest names have."""
    places = F.expr("transform(sequence(0, n - q), i -> struct(substring(name, i + 1, q) as gram, i as place))")
    own = names.select("name", "n", "q", "lost", F.explode(places).alias("g")).select("name", "n", "q", "lost", "g.gram", "g.place")
    shared = own.groupBy("q", "gram").agg(F.count("*").alias("held"))
    rarest = Window.partitionBy("name").orderBy("held", "place")
    ranked = own.join(shared, ["q", "gram"]).withColumn("_r", F.row_number().over(rarest))
    return ranked.filter(F.col("_r") <= F.col("lost") + 1).drop("_r", "held")


def _size_class(length: Column) -> Column:
    return F.floor(2 * F.log2(length)).cast("int")


def find_similar(
    candidates: DataFrame, names: DataFrame, candidate: str = "candidate", name: str = "name",
    min_score: float = FUZZY_MIN_SCORE,
) -> DataFrame:
    """(candidate, name, score) of whole texts with a score of ``min_score`` or more (above 0).

    A gram lies in a name's and a text's place alike, give or take the edits, and their lengths
    are alike: postings say in which cells of places and classes of lengths a text may have it.
    """
    asked = candidates.select(F.col(candidate).alias("candidate")).filter(F.length(candidate) > 0).distinct()
    sides = _named(names, name, min_score)
    grams = text_grams(asked, "candidate", "candidate", _sizes(sides))
    most = _longest(F.col("n"), min_score)
    least = F.ceil(F.col("n") * min_score - ROUNDING).cast("int")
    cell = lambda place: F.floor(F.greatest(place, F.lit(0)) / CELL).cast("int")
    moved = _edits(most, min_score)
    posted = name_postings(sides).withColumn("cell", F.explode(F.sequence(cell(F.col("place") - moved), cell(F.col("place") + moved))))
    posted = posted.withColumn("size", F.explode(F.sequence(_size_class(least), _size_class(most))))
    m, n = F.length("candidate"), F.col("n")
    longer = F.greatest(m, n)
    met = grams.withColumns({"cell": cell(F.col("at")), "size": _size_class(m)}).join(posted, ["q", "gram", "cell", "size"])
    near = met.filter((F.least(m, n) >= longer * min_score - ROUNDING) & (F.abs(F.col("at") - F.col("place")) <= _edits(longer, min_score)))
    pairs = near.select("candidate", "name").distinct()
    score = edit_score(F.col("candidate"), F.col("name"))
    return pairs.withColumn("score", score).filter(F.col("score") >= min_score - ROUNDING)


def name_pieces(names: DataFrame, min_score: float) -> DataFrame:
    """(name, n, q, lost, size, gram, piece, place): the pieces of each name of ``_named``, of which a run within the score has one as it is.

    There is one piece more than there can be edits. A name too short for that comes as its single
    characters: an insertion spoils none of these. ``gram`` is the piece's first ``size`` characters.
    """
    n = F.col("n")
    count = F.least(n, _edits(_longest(n, min_score), min_score) + 1)
    cut = F.expr("transform(sequence(0, pieces - 1), i -> struct(cast(floor(i * n / pieces) as int) as a, cast(floor((i + 1) * n / pieces) as int) as b))")
    cuts = names.withColumn("pieces", count).select("name", "n", "q", "lost", F.explode(cut).alias("c"))
    pieces = cuts.select("name", "n", "q", "lost", F.expr("substring(name, c.a + 1, c.b - c.a)").alias("piece"), F.col("c.a").alias("place"))
    size = F.least(F.length("piece"), F.lit(max(GRAMS)))
    return pieces.withColumn("size", size).withColumn("gram", F.expr("substring(piece, 1, size)"))


def _text_places(texts: DataFrame, key: str, text: str, sizes: list[int], ahead: int) -> DataFrame:
    """(key, at, size, gram, ahead): every gram of every text with the ``ahead`` characters from its 0-based place on.

    Texts are cut first: a place is then counted from its cut, not from the start of a long text.
    """
    cuts = texts.select(key, text, F.explode(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / CUT).cast("int"))).alias("_cut"))
    cuts = cuts.select(key, (F.col("_cut") * CUT).alias("_from"), F.substring(F.col(text), F.col("_cut") * CUT + 1, F.lit(CUT + ahead)).alias("_part"))
    last = F.least(F.length("_part"), F.lit(CUT)) - 1
    places = cuts.select(key, "_from", "_part", F.explode(F.sequence(F.lit(0), last)).alias("_i"))
    places = places.select(key, (F.col("_from") + F.col("_i")).alias("at"), F.substring(F.col("_part"), F.col("_i") + 1, F.lit(ahead)).alias("ahead"))
    if len(sizes) > 1:
        places = places.withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    else:
        places = places.withColumn("size", F.lit(sizes[0]))
    return places.withColumn("gram", F.expr("substring(ahead, 1, size)"))


def find_similar_inside(
    lines: DataFrame, names: DataFrame, line: str = "line", name: str = "name", min_score: float = FUZZY_MIN_SCORE
) -> DataFrame:
    """(line, name, found, score): the run of a line's words that is most like the name, if it scores ``min_score`` or more.

    Lines and names are compared as ``match_key`` spells them: folded, words with one space
    between. The best run is taken, of equal ones the first, then the shorter. A text goes to its hits
    once, by a shuffle: lines of any number never meet in the driver. A hit is a stretch of the line
    about as long as the name, whose runs alone are scored.
    """
    texts = lines.select(F.col(line).alias("line")).filter(F.col(line).isNotNull()).distinct()
    texts = texts.withColumn("_text", match_key(F.col("line"))).filter("_text <> ''").withColumn("_id", F.md5("line"))
    spelled = names.select(F.col(name).alias("name"), match_key(F.col(name)).alias("_name")).filter("_name <> ''").distinct()
    asked = _named(spelled, "_name", min_score)
    pieces = name_pieces(asked, min_score)
    sizes = {r["size"]: r["longest"] for r in pieces.groupBy("size").agg(F.max(F.length("piece")).alias("longest")).collect()} or {1: 1}
    places = _text_places(texts, "_id", "_text", sorted(sizes), max(sizes.values()))
    met = places.join(pieces, ["size", "gram"]).filter(F.startswith("ahead", "piece"))
    # Hits near each other are one stretch of n places.
    part = F.floor((F.col("at") - F.col("place")) / F.col("n")).cast("int")
    hits = met.select("_id", F.col("name").alias("_name"), "n", "q", "lost", part.alias("part")).distinct()
    n, most = F.col("n"), _longest(F.col("n"), min_score)
    reach = _edits(most, min_score)
    low = F.greatest(F.col("part") * n - reach, F.lit(0))
    high = (F.col("part") + 1) * n + reach
    stretch = hits.join(texts.hint("merge"), "_id").select(
        "_id", "_name", "n", "q", "lost", low.alias("low"), most.alias("most"), (high - low).alias("starts"),
        # One place before, to see whether a word starts; as many behind as the longest run needs.
        F.substring(F.concat(F.lit(" "), "_text", F.lit(" ")), low + 1, high - low + most + 2).alias("_part"),
    )
    # A run holds all of the name's grams but those that can be lost; a stretch with fewer has none.
    held = F.expr("size(filter(sequence(0, n - q), i -> contains(_part, substring(_name, i + 1, q))))")
    stretch = stretch.filter(held >= n - F.col("q") + 1 - F.col("lost"))
    places = F.expr("filter(sequence(0, length(_part) - 1), i -> substring(_part, i + 1, 1) = ' ')")
    stretch = stretch.withColumn("_spaces", places).filter(F.size("_spaces") > 1)
    shortest = F.ceil(n * min_score - ROUNDING).cast("int")
    pairs = F.expr(
        "flatten(transform(filter(_spaces, i -> i <= starts), i -> transform(filter(_spaces, j -> j - i - 1 between shortest and most), j -> struct(i as i, j as j))))"
    )
    runs = stretch.withColumn("shortest", shortest).select("_id", "_name", "low", "_part", F.explode(pairs).alias("r"))
    found = runs.select("_id", "_name", (F.col("low") + F.col("r.i")).alias("start"), F.expr("substring(_part, r.i + 2, r.j - r.i - 1)").alias("found"))
    scored = found.withColumn("score", edit_score(F.col("found"), F.col("_name"))).filter(F.col("score") >= min_score - ROUNDING)
    best = F.max_by(F.struct("found", "score"), F.struct(F.col("score"), -F.col("start"), -F.length("found")))
    best = scored.groupBy("_id", "_name").agg(best.alias("b")).select("_id", "_name", "b.*")
    return best.join(texts.select("_id", "line").hint("merge"), "_id").join(spelled, "_name").select("line", "name", "found", "score")


def rank_similar(similar: DataFrame, best: int | None = None, candidate: str = "candidate") -> DataFrame:
    """Suggestions of a candidate in order; Spark keeps ``best`` per task before it shuffles."""
    order = Window.partitionBy(candidate).orderBy(F.col("score").desc(), "name")
    ranked = similar.withColumn("rank", F.row_number().over(order))
    return ranked if best is None else ranked.filter(F.col("rank") <= best)
