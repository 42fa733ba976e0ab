import re

from helpers import apply

from sparkledger.functions.text import clean_text, drop_banned_tags, strip_text, tokenize


def test_clean_descriptions(spark):
    raw = [
        "PURCHASE 11/04/2019 RADHAUS.DE", "VISA XXXX7001 KIOSK LINZ", "POS AUTH 77031042913355 BROT UND MEHR",
        "pos purchase radhaus", "SUPERMARKET AT", "Bäcker Böhm", None, " ", "2019-04-11 SHOP", "postpaid timer",
    ]
    assert apply(spark, clean_text, raw) == [
        "RADHAUS DE", "KIOSK LINZ", "BROT UND MEHR", "RADHAUS", "AT", "BÄCKER BÖHM", "", "", "20 SHOP", "POSTPAID TIMER",
    ]
    assert apply(spark, lambda c: clean_text(c, ["und mehr", "brot"]), ["BROT und mehr Stand"]) == ["STAND"]


def test_tokens_and_tags(spark):
    lines = ["BEA, Betaalpas SUP*Fietsen van Oost,PAS907", "/TRTP/iDEAL/NAME/radhaus.de/REMI/77031", "NL11PROB0007770310:x;17.35", None]
    assert apply(spark, tokenize, lines) == [
        ["BEA", "Betaalpas SUP", "Fietsen van Oost", "PAS907"], ["TRTP", "iDEAL", "NAME", "radhaus.de", "REMI"], [], [],
    ]
    assert apply(spark, lambda c: drop_banned_tags(tokenize(c)), lines[1:2]) == [["iDEAL", "radhaus.de"]]


def test_strip_like_python(spark):
    texts = ["  a b ", "\x1c\tx\r\n", "", "ok"]
    assert apply(spark, strip_text, texts) == [t.strip() for t in texts]
    assert not re.search(r"\s", "ok")
