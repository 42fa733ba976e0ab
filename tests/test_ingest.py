import json
import os

from pyspark.sql import functions as F

from sparkledger.functions.text import clean_text
from sparkledger.sources.statements import number_file_lines
from sparkledger.streaming.ingest import ingest_statements, read_new_statements


def resolver(transactions):
    text = transactions.select(clean_text(F.col("description")).alias("cleaned_description")).distinct()
    return text.filter("cleaned_description = 'SHOP'").select(
        "*", F.lit("The Shop").alias("canonical_name"), F.lit("Expenses:Shop").alias("default_category"), F.lit(1.0).alias("similarity")
    )


def test_incremental_ingest(spark, tmp_path):
    incoming, out = tmp_path / "in", str(tmp_path / "out")
    incoming.mkdir()
    us = "Date,Amount,Description\n2023-01-01,-5.50,Shop\n2023-01-01,-5.50,Shop\n2023-01-02,9.00,Other\n"
    eu = "Kontoauszug\nDatum;Betrag;Text\n13.10.2023;-1.000,25;Shop\n"

    def run(checkpoint):
        ingest_statements(spark, str(incoming), out, str(tmp_path / checkpoint), resolver).awaitTermination()
        read = lambda name: spark.read.parquet(f"{out}/{name}")
        amounts = sorted(r["amount"] for r in read("ledger").filter("account = 'Expenses:Shop'").collect())
        return amounts, read("state").filter("status = 'needs_review'").count()

    (incoming / "a.csv").write_text(us)
    assert run("c1") == ([5.5, 5.5], 1)
    (incoming / "b.csv").write_text(eu)
    (incoming / "copy.csv").write_text(us)
    assert run("c1") == ([5.5, 5.5, 1000.25], 1)
    # A new query over the same files adds nothing.
    assert run("c2") == ([5.5, 5.5, 1000.25], 1)


def test_the_stream_keeps_listings_not_files(spark, tmp_path):
    """Spark's file stream held every file in the driver, and its log named them one by one."""
    incoming, checkpoint = tmp_path / "in", tmp_path / "c"

    def put(name, modified):
        (incoming / name).mkdir(parents=True)
        (incoming / name / "part-0.txt").write_text(f"{name}\n")
        os.utime(incoming / name / "part-0.txt", (modified, modified))

    def run(max_files=None):
        batches = []
        take = lambda new, _: batches.append(sorted(r["line"] for r in number_file_lines(new).collect()))
        stream = read_new_statements(spark, str(incoming), max_files, f"{checkpoint}/listings").writeStream.foreachBatch(take)
        stream.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()
        return batches

    for i in range(12):
        put(f"f{i:02d}", 1_000_000 + i)
    assert run() == [[f"f{i:02d}" for i in range(12)]]
    assert run() == []
    # A name that is new is taken, also if its file is older than all before.
    for i, name in enumerate(("late", "c", "b", "a")):
        put(name, 10 + i)
    assert run(max_files=3) == [["b", "c", "late"], ["a"]]
    logged = [json.loads(line)["path"] for p in (checkpoint / "sources" / "0").iterdir() if not p.name.startswith(".") for line in p.read_text().splitlines()[1:]]
    assert logged and len(logged) < 12 and all("/c/listings/" in p for p in logged)
