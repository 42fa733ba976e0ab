import pytest
from helpers import apply, lines_of
from pyspark.sql import functions as F

from sparkledger.functions.lines import data_density, keyword_score
from sparkledger.operators import layout as L

FILES = {
    "standard": ("Date,Amount,Description\n2019-04-11,17.35,Bicycle repair\n2019-04-12,3.20,Newspaper\n", 0, ",", 2),
    "metadata": (
        "Quarterly overview\nClient no. 77120\n~~~~~~~~\nDate;Amount;Valuta\n2019-04-11;17,35;CHF\n2019-04-12;3,20;CHF\n",
        3, ";", 2,
    ),
    "dutch": (
        "Rekeningnummer;Transactiedatum;Eindsaldo;Transactiebedrag;Omschrijving\n"
        "900111;20190411;512.10;-17.35;Fietsenmaker Oost\n"
        "900111;20190412;508.90;-3.2;Krant en koffie\n",
        0, ";", 2,
    ),
    "german": (
        "Umsatzliste April\nInhaberin: Probe Person\nDatum;Betrag;Waehrung;Verwendungszweck\n11.04.2019;-17,35;EUR;Fahrrad\n12.04.2019;88,00;EUR;Zinsen\n",
        2, ";", 2,
    ),
    "spanish": (
        "Movimientos de abril\nCaja de Prueba\nFecha,Importe,Saldo,Concepto\n2019-04-11,-17.35,512.10,Taller de bicicletas\n2019-04-12,-3.20,508.90,Prensa\n",
        2, ",", 2,
    ),
    "emoji": ("WALLET DUMP r7\n  \n🗓 Date;🪙 Amount;🏷 Desc\n2019-04-11;-17.35;Repair\n2019-04-12;-3.20;Paper\n", 2, ";", 2),
    "quoted": (
        'Overview\n"Date, Hour","Amount","Description, Long"\n"2019-04-11, 09:30","17.35","Repair, express"\n"2019-04-12, 10:45","3.20","Paper, daily"\n',
        1, ",", 2,
    ),
    "json": (
        "Host: alpha\nJob: nightly\n~~~~~~~~\nID;JSON_Content;Timestamp\n7;{'k': 55, 's': 'abc'};2019-04-11\n8;{'k': 56, 's': 'def'};2019-04-12",
        3, ";", 2,
    ),
    "edge": ("\n".join([f"Remark {i}" for i in range(18)] + ["Date,Amount,Description", "2019-04-11,17"]), 18, ",", 1),
    "at_threshold": ("Some remark\nFirst_Name1,Second_Name2\n7,label", 1, ",", 1),
    "below_threshold": ("Note\nFirst_Right,Other2\n7zyxwv,abc\n7,abc_longer", 2, ",", 1),
    "text_only": ("Whatever\nDate;Amount;Description\nMon;Ten;Probe\nTue;Six;Probe", 1, ";", 2),
    "long_text": (f"Quarterly overview\nDate,Amount,Description,Category\n2019-04-11,17.35,{'Q' * 220},Bicycle", 1, ",", 1),
    "blank_before_data": ("Date,Amount\n\n2019-04-11,5\n", 0, ",", 1),
    "one_column": ("alone\n987654321\n", 0, "", 1),
    "blank_window": ("\n" * 25 + "Date,Amount,Text\n2019-04-11,5,x\n2019-04-12,6,y\n", 25, ",", 2),
}


@pytest.fixture(scope="module")
def layouts(spark):
    lines = lines_of(spark, **{k: v[0] for k, v in FILES.items()})
    layout = L.detect_layout(lines)
    rows = L.table_rows(L.parse_rows(lines, layout)).groupBy("statement_id").agg(F.count("*").alias("n"))
    return {r["statement_id"]: r for r in layout.join(rows, "statement_id", "left").collect()}


@pytest.mark.parametrize("name", FILES)
def test_header_delimiter_and_rows(layouts, name):
    _, header, delimiter, n = FILES[name]
    row = layouts[name]
    assert (row["header_row"], row["delimiter"], row["n"]) == (header, delimiter, n)


def test_names_of_special_headers(layouts):
    assert layouts["emoji"]["columns"] == ["🗓 Date", "🪙 Amount", "🏷 Desc"]
    assert layouts["quoted"]["columns"] == ["Date, Hour", "Amount", "Description, Long"]
    assert layouts["blank_before_data"]["header_adjusted"]


def test_density_and_keywords(spark):
    dense, head, blank = apply(spark, data_density, ["88.10;2019-04-11;Probe", "Title;Date;Amount", "  "])
    assert dense > 0.5 and head < 0.2 and blank == 0
    assert apply(spark, keyword_score, ["Date;Amount", "nothing", None]) == [3, 0, 0]


def test_undelimited_preamble_is_not_data(spark):
    text = "Sparkasse Probe\nAbgerufen: 2019-05-06\nVertrag: 770-310-429\n\nHinweis\n\nDate;Betrag;Text\n11.04.2019;-17,35;Fahrrad\n"
    lines = lines_of(spark, a=text)
    assert L.header_by_density(lines).first()["header_row"] == 6
    assert L.header_by_density(lines, structured_only=False).first()["header_row"] == 1


def test_malformed_rows(spark):
    lines = lines_of(spark, a="a,b,c\n100,2,3\n4\n5,6,7,8\n\n  \n\"x\"\"y\",,NA\n")
    parsed = L.parse_rows(lines, L.detect_layout(lines))
    fields = [r["fields"] for r in L.table_rows(parsed).orderBy("line_no").collect()]
    assert fields == [["100", "2", "3"], ["4", None, None], ['x"y', None, None]]
    assert [r["line"] for r in L.bad_rows(parsed).collect()] == ["5,6,7,8"]


def test_column_names(spark):
    names = apply(spark, lambda c: L.column_names(c, F.lit(",")), ["a, a ,,a", "a,a.1,a", '"x,y",z'])
    assert names[0] == ["a", "a.1", "Unnamed: 2", "a.2"]
    assert len(set(names[1])) == 3
    assert names[2] == ["x,y", "z"]


def test_numeric_columns_of_wide_statements(spark):
    width = 130
    head = ",".join(f"c{i}" for i in range(width))
    row = ",".join("t" if i in (3, 64, 129) else str(i) for i in range(width))
    lines = lines_of(spark, a=f"{head}\n{row}\n{row}\n")
    flags = L.numeric_columns(L.table_rows(L.parse_rows(lines, L.detect_layout(lines)))).orderBy("pos").collect()
    assert [r["pos"] for r in flags if not r["is_numeric"]] == [3, 64, 129]


def test_empty_input(spark):
    lines = lines_of(spark, a="", b="Date,Amount\n", c="\n\n")
    assert L.table_rows(L.parse_rows(lines, L.detect_layout(lines))).count() == 0


def test_long_statement_is_cut_into_chunks(spark, monkeypatch):
    monkeypatch.setattr(L, "CHUNK_LINES", 7)
    body = "\n".join(f"2023-01-01,{i},text" for i in range(60))
    lines = lines_of(spark, long="Date,Amount,Text\n" + body, short="Date,Amount,Text\n2023-01-01,1,x")
    rows = L.table_rows(L.parse_rows(lines, L.detect_layout(lines))).groupBy("statement_id").count().collect()
    assert dict(map(tuple, rows)) == {"long": 60, "short": 1}


def test_open_quotes(spark):
    cases = ['a;"b;c', 'a;"x;"', '"a""b";c', '5" pipe;b', 'a;"b""', '"a";"b', "plain;row", '"q"x;"y']
    got = apply(spark, lambda c: L.has_open_quote(c, F.lit(";")), cases)
    assert got == [True, False, False, False, True, True, False, True]


def records_of(lines):
    joined = L.join_quoted_lines(lines, L.detect_layout(lines))
    return {(r["statement_id"], r["line_no"]): r["line"] for r in joined.collect()}


def plain_records(text, header, sep):
    """Records of a statement by reading it character by character; a rest that never closes stays in lines."""
    lines, out, at = text.removesuffix("\n").split("\n"), {}, 0
    while at < len(lines):
        first, record = at, lines[at]
        while at > header and at + 1 < len(lines) and is_open(record, sep):
            at += 1
            record += "\n" + lines[at]
        if first > header and is_open(record, sep):
            out |= dict(enumerate(lines[first:], first))
        else:
            out[first] = record
        at += 1
    return out


def is_open(record, sep):
    inside, cell_start, k = False, True, 0
    while k < len(record):
        c = record[k]
        if inside and c == '"':
            if record[k + 1 : k + 2] == '"':
                k += 1
            else:
                inside = False
        elif not inside:
            if c == '"' and cell_start:
                inside = True
            cell_start = c == sep
        k += 1
    return inside


@pytest.mark.parametrize("width", [1, 2, 3, 1 << 18])
def test_cells_with_line_breaks(spark, width, monkeypatch):
    monkeypatch.setattr(L, "CHUNK_LINES", width)
    head = "Date,Amount,Text\n"
    texts = {
        "two": head + '2019-04-11,1.00,"two\n\nlines, here"\n2019-04-12,2.00,plain\n2019-04-13,3.00,"again\nbroken"\n',
        "none": head + "2019-04-11,1.00,x\n",
        "inch": head + '2019-04-11,1.00,5" pipe\n2019-04-12,2.00,y\n2019-04-13,3.00,6" pipe\n',
        "preamble": 'Our "house export\nnote\n' + head + "2019-04-11,1.00,x\n2019-04-12,2.00,y\n",
        "inner": head + '2019-04-11,1.00,"a ""b""\n,""c"" d"\n2019-04-12,2.00,"one","two\nmore"\n2019-04-13,3.00,"x"\n',
        "never": head + '2019-04-11,1.00,x\n2019-04-12,2.00,"open\nrest\nof it\n',
        "turns": head + '2019-04-11,1.00,"a\n","b\n","c\n"\n2019-04-12,2.00,z\n',
    }
    lines = lines_of(spark, **texts)
    got = records_of(lines)
    for name, text in texts.items():
        header = 2 if name == "preamble" else 0
        want = plain_records(text, header, ",")
        assert {n: r for (s, n), r in got.items() if s == name} == want, name


def test_all_records_are_accounted_for(spark):
    from sparkledger.plans.statements import normalize_statements, unreadable_rows

    cell = "\n".join(f"line {i}, more" for i in range(5000))
    rows = [f"2019-04-{d:02d},{d}.00,text" for d in range(1, 10)]
    text = "Date,Amount,Text\n" + "\n".join([*rows[:4], f'2019-04-20,20.00,"{cell}"', '2019-04-21,21.00,5" pipe', *rows[4:], '2019-04-22,1.00,"open', "lost"]) + "\n"
    lines = lines_of(spark, long=text, other="Date,Amount,Text\n2019-04-11,7.00,x\n")
    done = normalize_statements(lines).collect()
    assert sorted(r["amount"] for r in done if r["statement_id"] == "long") == [*map(float, range(1, 10)), 20.0, 21.0]
    assert [r["description"] for r in done if r["amount"] == 20.0] == [cell]
    assert sorted(r["line"] for r in unreadable_rows(lines).collect()) == ['2019-04-22,1.00,"open', "lost"]


@pytest.mark.parametrize("width", [3, 1 << 18])
def test_a_rest_that_never_closes_stays_in_lines(spark, monkeypatch, width):
    from sparkledger.plans.statements import normalize_statements, unreadable_rows

    monkeypatch.setattr(L, "CHUNK_LINES", width)
    rest = [f"2019-05-01,{i}.00,text" if i % 7 else "" for i in range(40)]
    text = "Date,Amount,Text\n" + "\n".join(['2019-04-11,1.00,"two\nlines"', '2019-04-12,2.00,"open', *rest]) + "\n"
    lines = lines_of(spark, long=text, short='Date,Amount,Text\n2019-04-11,7.00,x\n2019-04-12,2.00,"open\nend\n')
    joined = L.join_quoted_lines(lines, L.detect_layout(lines)).collect()
    got = {r["line_no"]: (r["line"], r["opened_at"]) for r in joined if r["statement_id"] == "long"}
    want = {0: ("Date,Amount,Text", None), 1: ('2019-04-11,1.00,"two\nlines"', None), 3: ('2019-04-12,2.00,"open', 3)}
    assert got == want | {4 + i: (x, 3) for i, x in enumerate(rest)}
    assert sorted((r["line_no"], r["line"], r["opened_at"]) for r in joined if r["statement_id"] == "short" and r["line_no"] > 1) == [(2, '2019-04-12,2.00,"open', 2), (3, "end", 2)]
    assert sorted(r["amount"] for r in normalize_statements(lines).collect()) == [1.0, 7.0]
    bad = unreadable_rows(lines).collect()
    assert sorted(r["line_no"] for r in bad if r["statement_id"] == "long") == list(range(3, 44)) and {r["opened_at"] for r in bad} == {2, 3}


@pytest.mark.parametrize("quoted", [False, True])
def test_line_text_is_shuffled_once(spark, monkeypatch, quoted):
    """With broadcasts off, only the layout itself moves text: behind it no exchange has a line column."""
    from sparkledger.plans import statements as P
    from sparkledger.session import stage_table

    cell = '"two\nlines"' if quoted else "text"
    texts = {f"s{i}": "Date,Amount,Text\n" + "\n".join(f"2019-04-{d:02d},{d}.00,{cell}" for d in range(1, 20)) + "\n" for i in range(12)}
    lines = stage_table(lines_of(spark, **texts), "test-lines")
    shuffled = []
    written = L.stage_bucketed
    monkeypatch.setattr(L, "stage_bucketed", lambda *a: shuffled.append(a[1]) or written(*a))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        layouts, parts = P.statement_records(lines)
        decisions = P._decide(layouts, parts, None, None)
        rows = P.table_rows(P.parse_parts(parts, decisions))
        assert rows.count() == 12 * 19 and shuffled == ["lines"]
        for df in (rows, L.detect_header(L.lay_out(P.lay_out(lines)))):
            found = df.select(*df.columns)
            exchanged = _exchanged_columns(found)
            assert exchanged and not any("line" in columns for columns in exchanged)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _exchanged_columns(df):
    """Names of the columns that each shuffle of the plan moves."""
    plan, out, todo = df._jdf.queryExecution().sparkPlan(), [], []
    plan = df.sparkSession._jvm.org.apache.spark.sql.execution.QueryExecution.prepareExecutedPlan(df._jdf.sparkSession(), plan)
    todo = [plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            node = node.initialPlan()
        if node.nodeName() == "Exchange":
            names = node.output()
            out.append([names.apply(i).name() for i in range(names.size())])
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_data_lines_are_not_searched_for_keywords(spark):
    """A delimited data line settles the header by density; only other lines are searched, unless all are asked for."""
    from sparkledger.operators.layout import score_window

    lines = lines_of(spark, a="Date;Amount\n2024-01-01;12,50\nmemo 12345678\n")
    scores = lambda **kw: [r["keyword_score"] for r in score_window(lines, **kw).orderBy("line_no").collect()]
    assert scores() == [3, 1, 1]
    assert scores(all_keywords=False) == [3, 0, 1]
