import pytest
from pyspark.sql import functions as F

from sparkledger.functions.text import clean_text
from sparkledger.operators.classify import Categorizer, LetterEncoder, TextEmbedder, char_grams, count_runs
from sparkledger.operators.knowledge import ENCODED_SCHEMA, counted_feedback, merchants_from_text, resolve_texts, update_knowledge, upsert_merchants
from sparkledger.operators.learning import Knowledge, learning_round
from sparkledger.operators.review import route
from sparkledger.session import stage_table
from sparkledger.sources.tables import MAPPINGS_SCHEMA, VersionedTable, upsert
from sparkledger.streaming.ingest import Learner, StatementIngest, ingest_statements

SAID = "raw string, name string, category string, version bigint"


def rows_of(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "line_no int, cleaned_description string")
    none = spark.createDataFrame([], "cleaned_description string, canonical_name string, default_category string, similarity double")
    return route(rows, none)


def outcome(df):
    return {r["cleaned_description"]: (r["account"], r["method"]) for r in df.collect()}


def test_rounds_remember_and_learn(spark, tmp_path):
    fuel, tea = [f"LIND FUEL DEPOT {w}" for w in ("NORD", "OST", "WEST", "SUED")], [f"TEAHOUSE KETTLE {w}" for w in ("GRAZ", "LINZ", "WIEN", "WELS")]
    books = [f"BOOKWORM PAPER {w}" for w in ("ALT", "NEU", "MITTE", "RAND")]
    encoder = TextEmbedder.fit(rows_of(spark, *fuel, *tea, *books))
    knowledge = Knowledge.at(spark, str(tmp_path), encoder)
    label = lambda texts, name, category: [(t.lower(), name, category, 1) for t in texts[:2]]
    said = lambda rows: spark.createDataFrame(rows, SAID)

    state = rows_of(spark, *fuel, *tea, *books)
    first = outcome(learning_round(state, said(label(fuel, "Lind", "Fuel") + label(tea, "Teahouse", "Drinks")), knowledge, 0.7, "one"))
    assert {first[t] for t in fuel[:2]} == {("Fuel", "manual_user")} and {first[t] for t in tea[2:]} == {("Drinks", "setfit_v2")}
    assert not any(first[t][0] == "Books" for t in books)

    # The second round says nothing of fuel and tea: its model and its labels still know them.
    second = outcome(learning_round(state, said(label(books, "Bookworm", "Books")), knowledge, 0.6, "two"))
    assert {second[t] for t in fuel[2:]} == {("Fuel", "setfit_v2")} and {second[t] for t in books[2:]} == {("Books", "setfit_v2")}
    assert {second[t] for t in tea[:2]} == {("Drinks", "manual_user")}
    counts = [len(x.versions()) for x in (knowledge.labels, knowledge.merchants, knowledge.models.log)]
    assert counts == [2, 2, 2] and knowledge.labels.read().count() == 6

    # The same round again commits nothing; another reader finds the same model.
    knowledge.learn(said([("other", "X", "Y", 1)]), "two")
    assert [len(x.versions()) for x in (knowledge.labels, knowledge.merchants, knowledge.models.log)] == counts
    again = Knowledge.at(spark, str(tmp_path), encoder).models.latest()
    assert again.trained and again.predict(rows_of(spark, books[3])).first()["category"] == "Books"
    assert {r["canonical_name"] for r in knowledge.merchants.read().collect()} == {"Lind", "Teahouse", "Bookworm"}


def test_two_writers_keep_both_changes(spark, tmp_path):
    table = lambda: VersionedTable(spark, str(tmp_path / "t"), MAPPINGS_SCHEMA)
    row = lambda key: spark.createDataFrame([(key, None)], MAPPINGS_SCHEMA)
    one, other = table(), table()
    one.write(row("a"))
    turns = []

    def slow(stored):
        """While the first writer makes its version, the other one commits."""
        turns.append(stored.count())
        if len(turns) == 1:
            other.update(lambda base: upsert(base, row("b"), "header_hash"))
        return upsert(stored, row("c"), "header_hash")

    assert one.update(slow) == 3 and turns == [1, 2]
    assert sorted(r[0] for r in table().read().collect()) == ["a", "b", "c"]
    assert [r[0] for r in table().read(1).collect()] == ["a"]
    assert one.update(slow, "x") == 4 and one.update(slow, "x") == 4 and table().versions() == [1, 2, 3, 4]


def test_saved_encoder_and_its_version(spark, tmp_path):
    texts = rows_of(spark, "LIND FUEL", "TEAHOUSE", "")
    encoder = TextEmbedder.fit(texts)
    encoder.save(str(tmp_path / "encoder"))
    loaded = TextEmbedder.load(str(tmp_path / "encoder"))
    vectors = lambda e: {r["cleaned_description"]: r["vector"] for r in e.transform(texts).collect()}
    assert loaded.version == encoder.version and vectors(loaded) == vectors(encoder)
    other = TextEmbedder.fit(rows_of(spark, "LIND FUEL", "LIND", "KETTLE"))
    assert other.version != encoder.version and vectors(other) != vectors(encoder)
    seeds = spark.createDataFrame([("Lind", "Fuel", "LIND FUEL")], "name string, category string, description string")
    merchants = merchants_from_text(seeds, encoder)
    assert resolve_texts(texts, merchants, loaded).first()["canonical_name"] == "Lind"
    for wrong in (other, LetterEncoder()):
        with pytest.raises(ValueError, match="encoder"):
            resolve_texts(texts, merchants, wrong)
    letters = LetterEncoder().transform(spark.createDataFrame([("abba",), ("",), (None,)], "cleaned_description string")).collect()
    assert [round(x, 6) for x in letters[0]["vector"][:3]] == [0.707107, 0.707107, 0.0] and set(letters[1]["vector"]) == set(letters[2]["vector"]) == {0.0}


def test_merchants_learned_between_batches(spark, tmp_path):
    incoming, out, said = tmp_path / "in", str(tmp_path / "out"), []
    incoming.mkdir()
    encoder = TextEmbedder.fit(rows_of(spark, "LIND FUEL DEPOT", "TEAHOUSE KETTLE"))
    merchants = VersionedTable(spark, str(tmp_path / "merchants"), ENCODED_SCHEMA)

    def learn(stored, feedback):
        return upsert_merchants(stored, merchants_from_text(feedback, encoder), version="version")

    def resolve(transactions, known):
        return resolve_texts(transactions.select(clean_text(F.col("description")).alias("cleaned_description")), known, encoder)

    feedback = lambda: spark.createDataFrame(said, "name string, category string, description string, version bigint") if said else None
    learner = Learner(merchants, feedback, learn, resolve)

    def run():
        ingest_statements(spark, str(incoming), out, str(tmp_path / "c"), learner).awaitTermination()

    def accounts():
        return {(r["description"], r["account"]) for r in spark.read.parquet(f"{out}/state").collect()}

    head = "Date,Amount,Description\n"
    (incoming / "a.csv").write_text(head + "2023-01-01,-5.50,Lind Fuel Depot\n")
    run()
    assert accounts() == {("Lind Fuel Depot", None)}

    said += [("Lind", "Fuel", "LIND FUEL DEPOT", 1), ("Lind", "Expenses:Fuel", "LIND FUEL DEPOT", 2)]
    (incoming / "b.csv").write_text(head + "2023-02-01,-7.50,Lind Fuel Depot\n2023-02-01,-1.50,Teahouse Kettle\n")
    (incoming / "copy.csv").write_text(head + "2023-01-01,-5.50,Lind Fuel Depot\n")
    run()
    assert accounts() == {("Lind Fuel Depot", None), ("Lind Fuel Depot", "Expenses:Fuel"), ("Teahouse Kettle", None)}
    skipped = spark.read.parquet(f"{out}/skipped").collect()
    assert [r["statement_id"].rsplit("/", 1)[1] for r in skipped] == ["copy.csv"]

    # Batches run again, with more feedback by then, change neither merchants nor rows.
    said += [("Teahouse", "Drinks", "TEAHOUSE KETTLE", 1)]
    before, versions = accounts(), merchants.versions()
    ingest = StatementIngest(spark, out, learner)
    batches = sorted(r[0] for r in spark.read.parquet(f"{out}/state").select("batch").distinct().collect())
    for batch, files in zip(batches, (["a.csv"], ["b.csv", "copy.csv"]), strict=True):
        query_id, batch_id = batch.rsplit("-", 1)
        pieces = spark.read.text([str(incoming / f) for f in files]).select(
            F.col("_metadata.file_path").alias("statement_id"), F.col("_metadata.file_block_start").alias("block_start"), F.col("value").alias("line")
        )
        spark.sparkContext.setLocalProperty("sql.streaming.queryId", query_id)
        ingest(pieces, int(batch_id))
    spark.sparkContext.setLocalProperty("sql.streaming.queryId", None)
    assert accounts() == before and merchants.versions() == versions == [1, 2]


def test_runs_of_characters_in_order(spark):
    """Runs are of characters, also where one takes two units of UTF-16; HashingTF counts them as before."""
    texts = ["LIND FUEL", "A", "", "X\nY", "A\U0001F600B\U0001F600\U0001F601", None]
    want = [[t[i : i + 3] for i in range(len(t) - 2)] if t else [] for t in [None if t is None else f" {t} " for t in texts]]
    want[2] = []
    df = spark.createDataFrame(list(enumerate(texts)), "i int, cleaned_description string")
    assert [r[0] for r in df.orderBy("i").select(char_grams(F.col("cleaned_description"))).collect()] == want
    assert [sum(r["_counts"].values) for r in count_runs(df).orderBy("i").collect()] == [len(w) for w in want]


def test_counted_texts_are_encoded_alike(spark):
    """Rows whose runs were counted and staged give the model and the vectors that texts give."""
    texts = rows_of(spark, "LIND FUEL DEPOT", "TEAHOUSE KETTLE", "LIND", "")
    counted = stage_table(count_runs(texts).drop("cleaned_description"), "runs")
    plain, staged = TextEmbedder.fit(texts), TextEmbedder.fit(counted)
    assert plain.version == staged.version
    vectors = lambda df: sorted(r["vector"] for r in df.collect())
    assert vectors(plain.transform(texts)) == vectors(staged.transform(counted))


def test_training_reads_its_texts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def look(text):
        seen.add(1)
        return text

    rows = [("LIND FUEL", "Fuel"), ("LIND DIESEL", "Fuel"), ("TEA ROOM", "Tea"), ("TEA", "Tea")]
    labelled = spark.createDataFrame(rows, "t string, category string").select(F.udf(look)("t").alias("cleaned_description"), "category")
    model = Categorizer.train(labelled)
    assert model.trained and seen.value <= 2 * len(rows)


def test_feedback_is_counted_once_and_updates_alike(spark):
    labels = spark.createDataFrame(
        [("Lind", "Fuel", "Lind fuel depot", 1), ("Lind", "Cars", "Lind cars", 2), ("Tea", "Tea", "tea room", 1), ("Open", None, "x", 1), ("Blank", "B", "", 1)],
        "entity string, category string, description string, version int",
    )
    counted = counted_feedback(labels)
    encoder = TextEmbedder.fit(counted)
    stored = spark.createDataFrame([], ENCODED_SCHEMA)
    read = lambda df: sorted(map(tuple, df.collect()))
    assert read(update_knowledge(stored, counted, encoder, version="version")) == read(update_knowledge(stored, labels, encoder, version="version"))
    assert {r["canonical_name"]: r["default_category"] for r in update_knowledge(stored, counted, encoder, version="version").collect()} == {"Lind": "Cars", "Tea": "Tea"}
