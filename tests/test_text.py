import pytest
from pyspark.sql import functions as F

from ticketloom.functions import text as x


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "masked"),
    [
        ("write to jo.b+x@mail.example.co", "write to [email]"),
        ("call +44 20 7946 0958 now", "call [phone] now"),
        ("call (415) 555-0134 now", "call [phone] now"),
        ("order 1234567890 is late", "order 1234567890 is late"),
        ("ref 12 34 567", "ref 12 34 567"),
        ("+1 415 555 0134, +1 415 555 0135", "[phone], [phone]"),
        ("", ""),
    ],
)
def test_mask_contact(spark, raw, masked):
    assert one(spark, raw, x.mask_contact) == masked


def test_near_duplicates_share_a_skeleton(spark):
    assert one(spark, "Cancel order #12345!", x.skeleton) == one(spark, "cancel  order 9", x.skeleton) == "cancel order 0"


def test_keys(spark):
    assert one(spark, "  My  MIRROR\n broke ", x.leak_key) == "my mirror broke"
    assert one(spark, "..Hello there!? ", x.dedupe_key) == "hello there"
    assert one(spark, "Order 12 of 345", x.normalize_text) == "order 0 of 0"
    assert one(spark, "WHERE is MY box", x.caps_ratio) == pytest.approx(0.5)
    assert one(spark, "", x.caps_ratio) == 0.0


@pytest.mark.parametrize(("s", "out"), [(None, "–"), (59.4, "59s"), (90, "2 min"), (5400, "1.5 h"), (86400, "24 h"), (259200, "3.0 days")])
def test_duration(spark, s, out):
    assert spark.createDataFrame([(float(s) if s is not None else None,)], "s double").select(x.human_duration("s")).first()[0] == out


def test_document_text(spark):
    assert one(spark, "a  \r\n\r\n\r\n\r\nb\t\n", x.normalise_document) == "a\n\nb"


@pytest.mark.parametrize(
    ("meta", "text", "name", "title"),
    [("Given", "# Top", "a.md", "Given"), (None, "# Top\n\nx", "a.md", "Top"), ("", "plain", "docs/Warranty_Terms-2.pdf", "Warranty Terms 2"), (None, "", "_.md", "Untitled")],
)
def test_title(spark, meta, text, name, title):
    df = spark.createDataFrame([(meta, text, name)], "m string, t string, f string")
    assert df.select(x.doc_title("m", "t", "f")).first()[0] == title
