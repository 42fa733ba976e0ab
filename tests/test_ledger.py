import pytest
from pyspark.sql import functions as F

from sparkledger.operators.ledger import balances, category_as_account, generate_splits
from sparkledger.operators.quality import ContractError, count_failures, mark_quarantine, split_quarantine

INPUT = "transaction_id string, date timestamp_ntz, description string, amount double, account string"


def splits(spark, description, amount, account=None):
    df = spark.createDataFrame([("t", None, description, amount, account)], INPUT)
    return {r["currency"] if r["account"].startswith("Assets:Inv") else r["account"]: r for r in generate_splits(df).collect()}


def test_standard_pair(spark):
    s = splits(spark, "Corner Greengrocer", -42.0, "Expenses:Greens")
    assert s["Assets:Current:Bank"]["amount"] == -42.0 and s["Expenses:Greens"]["amount"] == 42.0
    assert "Expenses:Uncategorized" in splits(spark, None, -1.0)


@pytest.mark.parametrize(
    "text, ticker, units, shown",
    [
        ("Buy 12 LNDX @ 31.50", "LNDX", 12.0, "Buy 12.0 LNDX @ 31.5"),
        ("Koop 7 RDH @ 18.00", "RDH", 7.0, "Koop 7.0 RDH @ 18.0"),
        ("Verkoop 7 RDH @ 19,50", "RDH", -7.0, "Verkoop 7.0 RDH @ 19.5"),
        ("aankoop 3 abc @ 1", "ABC", 3.0, "aankoop 3.0 abc @ 1.0"),
        ("SOLD 20000000 XY @ 12345678.25", "XY", -20000000.0, "SOLD 20000000.0 XY @ 12345678.25"),
    ],
)
def test_trades(spark, text, ticker, units, shown):
    s = splits(spark, text, -1500.0)
    assert s["Assets:Current:Bank"]["amount"] == -1500.0 and s["Assets:Current:Bank"]["currency"] == "EUR"
    assert s[ticker]["amount"] == units and s[ticker]["description"] == shown
    assert s[ticker]["account"] == f"Assets:Investments:{ticker}"


@pytest.mark.parametrize("text", ["Greengrocer Order", "Buy 12 LNDX @ 1.234,56", "Buy twelve LNDX @ 5"])
def test_unreadable_trade_gets_a_standard_pair(spark, text):
    assert set(splits(spark, text, -5.0)) == {"Assets:Current:Bank", "Expenses:Uncategorized"}


def test_balance_and_skip(spark):
    df = spark.createDataFrame([("a", -5.1, "Food"), ("b", 7.25, "Skipped"), ("c", 0.3, None)], "transaction_id string, amount double, category string")
    rows = category_as_account(df.withColumns({"date": F.current_timestamp(), "description": F.lit("x")}))
    out = balances(generate_splits(rows)).collect()
    assert sorted(r["transaction_id"] for r in out) == ["a", "c"]
    assert all(r["balance"] == 0 and r["n_splits"] == 2 for r in out)


def ledger(spark):
    row = "transaction_id string, date timestamp_ntz, account string, amount double, currency string, description string, price double, meta string"
    import datetime

    day = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [
            ("a", day, "x", 1.0, "EUR", None, None, None),
            ("a", None, "x", float("nan"), "EUR", None, None, None),
            ("", day, "x", 1.0, "EUR", None, None, None),
            ("b", day, "x", 1.0, "EUR", "d", 1.0, "{}"),
            (None, day, None, None, None, None, None, None),
        ],
        row,
    )


def test_quarantine(spark):
    df = ledger(spark)
    clean, bad = split_quarantine(df)
    assert (clean.count(), bad.count()) == (2, 3)
    errors = sorted(tuple(r["errors"]) for r in bad.collect())
    assert ("date: not_null", "amount: not_null") in errors and ("transaction_id: not_empty",) in errors
    assert {r["column"]: r["failures"] for r in count_failures(bad).collect()}["amount"] == 2
    clean, bad = split_quarantine(df, scope="transaction")
    assert [r["transaction_id"] for r in clean.collect()] == ["b"] and bad.count() == 4
    assert mark_quarantine(df).count() == df.count()


def test_broken_schema_is_refused(spark):
    with pytest.raises(ContractError, match="amount: string instead of double"):
        split_quarantine(ledger(spark).withColumn("amount", F.lit("1")))
    with pytest.raises(ContractError, match="price: missing"):
        split_quarantine(ledger(spark).drop("price"))
    assert split_quarantine(ledger(spark).withColumn("more", F.lit(1)))[0].count() == 2
