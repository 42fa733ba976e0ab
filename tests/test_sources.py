import gzip
import random
from urllib.parse import unquote

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from sparkledger.operators.mapping import resolve_mapping
from sparkledger.sources import files, statements
from sparkledger.sources.sinks import nan_to_null, write_quarantine
from sparkledger.sources.statements import lines_from_content, number_rows, read_statements, write_statements
from sparkledger.sources.tables import MAPPINGS_SCHEMA, VersionedTable, save_mappings, upsert
from sparkledger.streaming.ingest import read_new_statements


def test_line_numbers_across_splits(spark, tmp_path):
    """One file of many splits among small ones keeps exact line numbers."""
    sizes = {"big": 5000, "small": 3, "one": 1}
    for name, n in sizes.items():
        (tmp_path / f"{name}.csv").write_text("".join(f"{name} line {i}\r\n" for i in range(n)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = read_statements(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 1
        rows = lines.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got = {(r["statement_id"].rsplit("/", 1)[1][:-4], r["line_no"]): r["line"] for r in rows}
    assert got == {(name, i): f"{name} line {i}" for name, n in sizes.items() for i in range(n)}


def test_content_lines(spark):
    df = spark.createDataFrame([("a", "x\r\ny\n\nz\n"), ("b", ""), ("c", "one")], "id string, text string")
    rows = lines_from_content(df, "id", "text").orderBy("statement_id", "line_no").collect()
    assert [tuple(r) for r in rows] == [("a", 0, "x"), ("a", 1, "y"), ("a", 2, ""), ("a", 3, "z"), ("c", 0, "one")]


def test_number_rows_of_a_hot_key(spark):
    places = random.Random(1).sample(range(10_000), 600)
    rows = [("hot", p) for p in places] + [("cold", 5), ("cold", 9999)]
    out = number_rows(spark.createDataFrame(rows, "k string, p bigint"), ["k"], "p", "n", width=64).collect()
    hot = {r["p"]: r["n"] for r in out if r["k"] == "hot"}
    assert hot == {p: i + 1 for i, p in enumerate(sorted(places))}
    assert sorted((r["p"], r["n"]) for r in out if r["k"] == "cold") == [(5, 1), (9999, 2)]


def test_versioned_mappings(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "mappings"), MAPPINGS_SCHEMA)
    assert table.read().count() == 0
    heads = spark.createDataFrame([(["Date", "Amount", "Text"],), (["Datum", "Betrag", "Text"],)], "columns array<string>")
    assert save_mappings(table, resolve_mapping(heads)) == 1
    changed = resolve_mapping(heads.limit(1)).withColumn("mapping", F.col("mapping").withField("date_col", F.lit("Other")))
    assert save_mappings(table, changed) == 2
    assert sorted(r["mapping"]["date_col"] for r in table.read().collect()) == ["Datum", "Other"]
    (tmp_path / "mappings" / "version=3").mkdir()  # a write that never finished
    assert table.versions() == [1, 2]


def test_cached_mapping_wins_over_proposed_and_heuristic(spark):
    heads = spark.createDataFrame([(["Date", "Amount", "Text"],)], "columns array<string>")
    own = resolve_mapping(heads)
    named = lambda n: own.select("header_hash", F.col("mapping").withField("date_col", F.lit(n)).alias("mapping"))
    assert resolve_mapping(heads, named("c"), named("p")).first()["mapping"]["date_col"] == "c"
    assert resolve_mapping(heads, None, named(" p ")).first()["mapping"]["date_col"] == "p"
    assert resolve_mapping(heads, None, named("")).first()["mapping_source"] == "heuristic"


def test_upsert_by_version(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1")], "k string, v string")
    new = spark.createDataFrame([("a", "3", 2), ("a", "2", 1), ("c", "9", 1)], "k string, v string, n int")
    assert dict(map(tuple, upsert(old, new, "k", "n").collect())) == {"a": "3", "b": "1", "c": "9"}


def test_quarantine_runs_and_nan(spark, tmp_path):
    rows = spark.createDataFrame([("t", ["date: not_null"])], "transaction_id string, errors array<string>")
    for run in ("1", "2", "1"):
        write_quarantine(rows, str(tmp_path / "q"), run)
    assert spark.read.option("header", True).csv(str(tmp_path / "q")).count() == 2
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert sorted((r[0] is None) for r in nan_to_null(nan).collect()) == [False, True]


@pytest.mark.parametrize("name", ["map6_resolve_mapping", "jon3_mapping_lookup", "src8_save_mapping_cache"])
def test_lines_are_laid_out_once(spark, tmp_path, monkeypatch, name):
    """The stored mapping and the statements take their headers from the same staged layouts."""
    from sparkledger.operators import layout
    from sparkledger.workload import QUERIES

    row = "id as o_orderkey, id as o_custkey, 'F' as o_orderstatus, 12.5D as o_totalprice, timestamp'2024-05-06' as o_orderdate, '1-URGENT' as o_orderpriority"
    spark.range(128).selectExpr(*row.split(", ")).write.parquet(str(tmp_path / "orders.parquet"))
    made, stage = [], layout.stage_bucketed
    monkeypatch.setattr(layout, "stage_bucketed", lambda *a: made.append(a[1]) or stage(*a))
    assert QUERIES[name](spark, str(tmp_path)).count() == (4 if name.startswith("src8") else 8)
    assert made == ["lines"]


def test_statements_are_written_as_files_of_their_own(spark, tmp_path):
    """One folder and file for each statement, named as Spark names them, without the checksums that its writer leaves."""
    rows = [("a", 1, "second"), ("a", 0, "first, ü"), ("b/c d=1", 0, None), (None, 0, "x")]
    write_statements(spark.createDataFrame(rows, "statement_id string, line_no bigint, line string"), str(tmp_path / "in"))
    files = {str(p.relative_to(tmp_path / "in")): p.read_text() for p in (tmp_path / "in").rglob("*") if p.is_file()}
    assert files == {
        "statement_id=a/part-0.txt": "first, ü\nsecond\n", "statement_id=b%2Fc d%3D1/part-0.txt": "\n",
        "statement_id=__HIVE_DEFAULT_PARTITION__/part-0.txt": "x\n",
    }
    read = spark.read.text(str(tmp_path / "in")).collect()
    assert sorted((r["statement_id"] or "", r["value"]) for r in read) == [("", "x"), ("a", "first, ü"), ("a", "second"), ("b/c d=1", "")]
    assert read_statements(spark, str(tmp_path / "in")).count() == 4


@pytest.mark.parametrize("stream", [False, True])
def test_many_folders_are_listed_in_few_tasks(spark, tmp_path, stream):
    """A task for each folder took 24 ms a folder, most of it to start the task."""
    folders = 100
    for i in range(folders):
        (tmp_path / f"in/statement_id=s{i}").mkdir(parents=True)
        (tmp_path / f"in/statement_id=s{i}/part-0.txt").write_text("a\nb\n")
    group, tracker = f"listing-{stream}", spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = read_new_statements(spark, str(tmp_path / "in")) if stream else read_statements(spark, str(tmp_path / "in"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tasks = [tracker.getStageInfo(s).numTasks for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    assert tasks and max(tasks) < folders
    if not stream:
        assert found.count() == 2 * folders


@pytest.mark.parametrize("stream", [False, True])
def test_only_large_and_packed_files_go_to_the_text_reader(spark, tmp_path, monkeypatch, stream):
    """The text reader took 3 ms of a task a file; small files are read in one piece and cut where it cuts, byte for byte."""
    bom = b"\xef\xbb\xbf"
    files = {
        "a.csv": (b"a\nb\r\nc\rd", [b"a", b"b", b"c", b"d"]), "x [1] b%20/b.txt": (b"\r\r\n\n", [b"", b"", b""]),
        "empty.txt": (b"", []), "bom.txt": (bom, []), "c.txt": (bom + b"x\n", [b"x"]), "latin.txt": (b"caf\xe9 \x85\n\xff", [b"caf\xe9 \x85", b"\xff"]),
        "large [x]*.csv": (b"line\r\n" * 50, [b"line"] * 50), "d.GZ": (gzip.compress(b"p\nq\n"), [b"p", b"q"]),
    }
    for name, (content, _) in files.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    monkeypatch.setattr(statements, "SMALL_FILE", 100)
    asked, text = [], DataFrameReader.text
    monkeypatch.setattr(DataFrameReader, "text", lambda self, paths, *a, **k: asked.append(paths) or text(self, paths, *a, **k))
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 100)
    rows = []
    collect = lambda lines: rows.extend(lines.select("statement_id", "line_no", F.col("line").cast("binary")).collect())
    try:
        if stream:
            found = read_new_statements(spark, str(tmp_path / "in")).writeStream.option("checkpointLocation", str(tmp_path / "c"))
            found.trigger(availableNow=True).foreachBatch(lambda new, _: collect(statements.number_file_lines(new))).start().awaitTermination()
        else:
            collect(read_statements(spark, str(tmp_path / "in")))
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    wanted = [((tmp_path / "in" / name).as_uri(), no, line) for name, (_, lines) in files.items() for no, line in enumerate(lines)]
    plain = lambda uri: unquote(uri).replace("file:///", "/").replace("file:/", "/")
    assert sorted((plain(i), no, bytes(line)) for i, no, line in rows) == sorted((plain(i), no, line) for i, no, line in wanted)
    assert [len(paths) for paths in asked] == [2]


def test_tasks_list_and_read_a_mounted_folder(spark, tmp_path, monkeypatch):
    """Spark's listing held all files in the driver; rounds of tasks find the same ones under the same names."""
    names = ["a b", "p%20", "x [1]", "é\xa0n", "h#?", "q'\"{\\", "_h=1", "_hidden", ".dot", "x._COPYING_", *[f"n{i}" for i in range(9)]]
    for name in names:
        (tmp_path / "in" / name / "deep").mkdir(parents=True)
        (tmp_path / "in" / name / f"{name}.txt").write_text(f"{name}\n")
        (tmp_path / "in" / name / "deep" / "d.txt").write_text("d\n")
    load = DataFrameReader.load
    plain = lambda path: load(spark.read.format("binaryFile").option("recursiveFileLookup", "true"), path).select("_metadata.file_path").collect()
    monkeypatch.setattr(files, "FOLDERS_AT_ONCE", 2)
    monkeypatch.setattr(DataFrameReader, "load", lambda self, *a, **k: pytest.fail("listed in the driver"))
    one, pattern = str(tmp_path / "in" / "n0" / "n0.txt"), str(tmp_path / "in" / "n[1-3]")
    for path in (str(tmp_path / "in"), one, pattern, [str(tmp_path / "in"), pattern]):
        found = read_statements(spark, path).collect()
        assert sorted(r["statement_id"] for r in found) == sorted(r[0] for r in plain(path))
    assert {r["line"] for r in read_statements(spark, one).collect()} == {"n0"}
    monkeypatch.undo()
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_statements(spark, str(tmp_path / "none"))
