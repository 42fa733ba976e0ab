import datetime

from helpers import apply, lines_of
from pyspark.sql import functions as F

from sparkledger.functions.amounts import amount, eu_number, us_number
from sparkledger.operators.normalize import number_occurrences
from sparkledger.plans.statements import normalize_statements


def test_us_and_eu_amounts(spark):
    us = ["1234.56", "1,234.56", "$1,234.56", "USD 1,234.56", " 1, 2 34 . 5 6 ", "-€50.00", "−500.00"]
    assert apply(spark, us_number, us) == [1234.56] * 5 + [-50.0, -500.0]
    eu = ["1.234,56", "1 234,56", "€ 1.234,56", "1.234,56 EUR", "1 234,56", "-50,00"]
    assert apply(spark, eu_number, eu) == [1234.56] * 5 + [-50.0]
    for sep in ".,":
        assert apply(spark, lambda c: amount(c, F.lit(sep)), [None, "", "NotANumber", "-", "1-2"]) == [0.0] * 5
    assert apply(spark, lambda c: amount(c, F.lit("."), mode="strict"), ["1,000.5", "$5", " 7 "]) == [1000.5, 0.0, 7.0]


def by_line(df):
    return [r.asDict() for r in df.orderBy("statement_id", "line_no").collect()]


def test_three_polarities_agree(spark):
    lines = lines_of(
        spark,
        a="Date,Description,Amount\n2023-01-01,Salary,1000.00\n2023-01-02,Groceries,-50.00",
        b="Date,Description,Amount,Type\n2023-01-01,Salary,1000.00,Credit\n2023-01-02,Groceries,50.00,Debit",
        c="Date,Description,Credit,Debit\n2023-01-01,Salary,1000.00,\n2023-01-02,Groceries,,50.00",
        d="Datum;Naam;Bedrag;Af Bij\n2023-01-01;Salary;1.000,00;Bij\n2023-01-02;Groceries;50,00;Af",
    )
    rows = by_line(normalize_statements(lines))
    assert [r["amount"] for r in rows] == [1000.0, -50.0] * 4
    assert {r["account"] for r in rows} == {"Assets:Bank:Unknown"} and {r["currency"] for r in rows} == {"EUR"}
    assert len({r["transaction_id"] for r in rows}) == 2  # equal content, equal id
    assert all(len(r["transaction_id"]) == 36 for r in rows)


def test_numeric_column_skips_the_comma_locale(spark):
    text = (
        "Rekeningnummer;Muntsoort;Transactiedatum;Transactiebedrag;Omschrijving\n"
        "546789123;EUR;20240831;-5;Payment 1\n546789123;EUR;20240901.0;-5.95;Payment 2\n"
    )
    rows = by_line(normalize_statements(lines_of(spark, a=text)))
    assert [r["amount"] for r in rows] == [-5.0, -5.95]
    assert [r["date"].date() for r in rows] == [datetime.date(2024, 8, 31), datetime.date(2024, 9, 1)]
    assert rows[1]["meta"] == (
        '{"Rekeningnummer":546789123,"Muntsoort":"EUR","Transactiedatum":20240901.0,"Transactiebedrag":-5.95,"Omschrijving":"Payment 2"}'
    )


def test_one_date_format_per_statement(spark):
    lines = lines_of(
        spark,
        eu="Datum;Betrag;Text\n01.10.2023;1,00;a\n13.10.2023;2,00;b\nsoon;3,00;c",
        us="Date,Amount,Text\n01/10/2023,1.00,a\n02/11/2023,2.00,b",
        de="Datum;Betrag;Text\n01.02.2023;1,00;a\n03.04.2023;x;b",
    )
    rows = by_line(normalize_statements(lines))
    days = {(r["statement_id"], r["description"]): r["date"] and r["date"].strftime("%Y-%m-%d") for r in rows}
    assert days[("eu", "a")] == "2023-10-01" and days[("eu", "b")] == "2023-10-13" and days[("eu", "c")] is None
    assert days[("us", "a")] == "2023-01-10" and days[("de", "a")] == "2023-02-01"
    assert [r["amount_ok"] for r in rows if r["statement_id"] == "de"] == [True, False]


def test_whole_statement(spark):
    text = """
        Sparkasse Probe: Umsatzliste
        Abgerufen: 2019-05-06
        Vertrag: 770-310-429

        Hinweis: ohne Gewaehr.

        Buchungstag;Valuta Date;Booking Text;Betrag EUR;Balance
        11.04.2019;11.04.2019;Fahrrad Ost;-17,35;512,10
        12.04.2019;12.04.2019;Zinsen April;1.088,00;1.600,10
        15.04.2019;15.04.2019;Kiosk;-3,20;1.596,90
        """
    rows = by_line(normalize_statements(lines_of(spark, a=text)))
    assert [r["amount"] for r in rows] == [-17.35, 1088.0, -3.2]
    assert [r["date"].day for r in rows] == [11, 12, 15]
    assert [r["description"] for r in rows] == ["Fahrrad Ost", "Zinsen April", "Kiosk"]


def test_equal_rows_are_counted_up(spark):
    lines = lines_of(spark, a="Date,Amount,Text\n" + "2023-01-01,1,x\n" * 3)
    out = number_occurrences(normalize_statements(lines)).orderBy("line_no").collect()
    assert [r["occurrence"] for r in out] == [1, 2, 3] and len({r["transaction_id"] for r in out}) == 1


def test_dates_with_clock_times(spark):
    from sparkledger.functions.dates import DATE_FORMATS, date_shape, date_text, parse_date

    places = {fmt: i for i, (fmt, _) in enumerate(DATE_FORMATS)}
    cases = [
        ("2019-04-11T12:00:00Z", "yyyy-MM-dd", "2019-04-11 12:00:00"),
        ("2019-04-11 12:00:00.250", "yyyy-MM-dd", "2019-04-11 12:00:00.25"),
        ("2019-04-11 12:00", "yyyy-MM-dd", "2019-04-11 12:00:00"),
        ("2019-04-11T12:00:00.123456+02:00", "yyyy-MM-dd", "2019-04-11 10:00:00.123456"),
        ("2019-04-11 23:30:00 -0130", "yyyy-MM-dd", "2019-04-12 01:00:00"),
        ("20190411 07:05", "yyyyMMdd", "2019-04-11 07:05:00"),
        ("13/4/2019 14:03", "d/M/yyyy", "2019-04-13 14:03:00"),
        ("4/13/2019 2:03 PM", "M/d/yyyy", "2019-04-13 14:03:00"),
        ("13.04.19, 09:30:15", "d.M.yy", "2019-04-13 09:30:15"),
        ("11 Apr 2019 12:15 am", "yyyy-MM-dd", "2019-04-11 00:15:00"),
        ("Apr 11, 2019 08:00", "yyyy-MM-dd", "2019-04-11 08:00:00"),
        ("2019-04-11", "yyyy-MM-dd", "2019-04-11 00:00:00"),
        ("2019-04-11 25:00", "yyyy-MM-dd", None),
        ("2019-04-11 soon", "yyyy-MM-dd", None),
        ("word " * 4000, "yyyy-MM-dd", None),
        (None, "yyyy-MM-dd", None),
    ]
    df = spark.createDataFrame([(i, t, places[f]) for i, (t, f, _) in enumerate(cases)], "i int, t string, f int")
    text = date_text(F.col("t"))
    got = df.select("i", parse_date(text, date_shape(text), F.col("f")).cast("string").alias("d")).orderBy("i").collect()
    assert [r["d"] for r in got] == [want for _, _, want in cases]


def test_dates_by_their_tokens(spark):
    from sparkledger.functions.dates import date_text

    cases = {
        "5 March 2024": "2024-03-05", "5th of March, 2024": "2024-03-05", "March 5, 2024 10:30 PM": "2024-03-05 10:30 PM", "Tuesday 5 Mar 24": "2024-03-05",
        "dinsdag 5 maart 2024": "2024-03-05", "5-mrt-2024": "2024-03-05", "Mi., 15. März 2023": "2023-03-15", "31.Dezember.23": "2023-12-31",
        "mar. 5 mars 2024": "2024-03-05", "le 1er août 2023": "2023-08-01", "15 de agosto de 2023": "2023-08-15", "miércoles, 3 enero 2024": "2024-01-03",
        "2024/Feb/29": "2024-02-29", "29 Feb 2023": "29 Feb 2023", "2024-W10-2": "2024-03-05", "2024W102": "2024-03-05", "2020-W53": "2020-12-28",
        "2021-W53-1": "2021-W53-1", "2024-W10-2T08:00:00Z": "2024-03-05T08:00:00Z", "5 Foo 2024": "5 Foo 2024", "March 2024": "March 2024",
        "1 2 March 2024": "1 2 March 2024", "soon": "soon", "": "", "20240831.0": "20240831", "x " * 400 + "5 March 2024": ("x " * 400 + "5 March 2024"),
        "2019-04-11T12:00:00Z": "2019-04-11T12:00:00Z", "40 March 2024": "40 March 2024", "99999999999 March 2024": "99999999999 March 2024",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string")
    got = {r["t"]: r["d"] for r in df.select("t", date_text(F.col("t")).alias("d")).collect()}
    assert got == cases


def test_own_amount_parser_leaves_the_others_alone(spark):
    from sparkledger.functions.amounts import amount, us_number, with_amount_parser

    parsers = with_amount_parser("'", lambda c: us_number(F.replace(c, F.lit("'"), F.lit(""))))
    df = spark.createDataFrame([("1'234.56", "'"), ("1.234,56", None), ("1.234,56", ",")], "v string, s string")
    assert [r[0] for r in df.select(amount(F.col("v"), F.col("s"), parsers=parsers)).collect()] == [1234.56] * 3
    assert df.filter("s is null").select(amount(F.col("v"), F.col("s"))).first()[0] == 1234.56


def test_documents_do_not_go_along_to_a_format(spark):
    """Only text that a format may read is shuffled to its statement's format."""
    from sparkledger.functions.dates import date_shape, readable_text

    texts = ["2024-01-02", "1/2/24", "20240831", "02.01.2024 10:30", "word " * 5000, "2024-01", "", None]
    got = apply(spark, lambda v: readable_text(v, date_shape(v)), texts)
    assert got == [*texts[:4], None, None, None, None]
