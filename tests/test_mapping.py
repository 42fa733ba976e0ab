import pytest
from pyspark.sql import functions as F

from sparkledger.operators.mapping import heuristic_mapping, resolve_mapping

CASES = [
    (["Date", "Amount", "Description"], dict(date_col="Date", amount_col="Amount", desc_col="Description", decimal_separator=".", type="signed")),
    (["Date", "Description", "Credit", "Debit"], dict(type="credit_debit", credit_col="Credit", debit_col="Debit", amount_col=None)),
    (["Date", "Amount", "Type", "Description"], dict(type="direction", direction_col="Type", outgoing_value="Debit")),
    (["Ref", "Transactiedatum", "Transactiebedrag", "Omschrijving"], dict(date_col="Transactiedatum", amount_col="Transactiebedrag", desc_col="Omschrijving", decimal_separator=",")),
    (["Datum", "Betrag", "Verwendungszweck", "Waehrung"], dict(date_col="Datum", amount_col="Betrag", desc_col="Verwendungszweck", decimal_separator=",")),
    (["Fecha", "Importe", "Saldo", "Concepto"], dict(date_col="Fecha", amount_col="Importe", desc_col="Concepto", decimal_separator=",")),
    (["Col1", "Col2", "Col3", "Col4"], dict(date_col="Col1", amount_col="Col2", desc_col="Col4")),
    (["tRaNsAcTiOn dAtE", "vAlUe", "nOtEs"], dict(date_col="tRaNsAcTiOn dAtE", amount_col="vAlUe", desc_col="nOtEs")),
    (["📅 Date", "💰 Amount", "📝 Description"], dict(date_col="📅 Date", amount_col="💰 Amount", desc_col="📝 Description")),
    (["Date", "Billing Amount", "Transaction Amount", "Desc"], dict(amount_col="Billing Amount")),
    (["Date", "Amount"], dict(date_col="Date", amount_col="Amount", desc_col="Amount")),
    (["Datum", "Bedrag"], dict(date_col="Datum", amount_col="Bedrag")),
    (["Datum", "Bedrag", "Af Bij", "Naam"], dict(type="direction", direction_col="Af Bij", outgoing_value="Af", incoming_value="Bij")),
    (["Date", "Credit Card", "Debit", "Amount"], dict(type="signed", amount_col="Amount")),
    (["Only"], dict(date_col="Only", amount_col="Only", desc_col="Only")),
]


@pytest.fixture(scope="module")
def mappings(spark):
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(CASES)], "i int, columns array<string>")
    rows = df.select("i", heuristic_mapping(F.col("columns")).alias("m")).collect()
    return {r["i"]: {**r["m"].asDict(), **r["m"]["polarity"].asDict()} for r in rows}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_heuristics(mappings, i):
    want = CASES[i][1]
    assert {k: mappings[i][k] for k in want} == want


def test_signed_proposal_without_amount_is_completed(spark):
    heads = spark.createDataFrame([(["Date", "Amount", "Text"],)], "columns array<string>")
    p = resolve_mapping(heads).select("header_hash", F.col("mapping").withField("amount_col", F.lit("")).alias("mapping"))
    out = resolve_mapping(heads, proposed=p).first()
    assert out["mapping"]["amount_col"] == "Amount"
