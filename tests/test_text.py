import re

import pytest
from pyspark.sql import functions as F

from metricway.functions import phrases as P
from metricway.functions import text as T
from metricway.operators import labels as L
from metricway.sources.bindings import Tables

# The masking rule said again in another engine's words, for the whole documents.
RULE = re.compile(r"(?<![\d$.,])(?<!CALL-)(?<!MBR-)(?<!AGT-)(?:\d{4}(?:[ -]\d{4})+|\d{5,})(?![\d,]|\.\d)")


def brute(text):
    return RULE.sub(lambda m: "****" + re.sub(r"\D", "", m.group())[-4:], text)


@pytest.mark.parametrize("text, want", [
    ("card 1234 5678 9012 3456.", "card ****3456."), ("account 123456789", "account ****6789"),
    ("$1,234,567.89 and 12345.67", "$1,234,567.89 and 12345.67"), ("CALL-00042 MBR-000584 AGT-00123", "CALL-00042 MBR-000584 AGT-00123"),
    ("ending in 0412", "ending in 0412"), ("1234-5678, then", "1234-5678, then"), ("1234-5678-9012, then", "****5678-9012, then")])
def test_masking(spark, text, want):
    assert brute(text) == want
    assert spark.createDataFrame([(text,)], "t string").select(T.mask_accounts(F.col("t"))).first()[0] == want


def test_masking_whole_documents(spark, sf):
    rows = Tables(spark, sf)["documents"].select("text", T.mask_accounts(F.col("text")).alias("m")).collect()
    assert any(r.text != r.m for r in rows)
    assert all(brute(r.text) == r.m for r in rows)


def test_turns(spark):
    rows = spark.createDataFrame([(" MEMBER: hi there AGENT:  yes  MEMBER:\nbye ",), ("no marks",)], "t string")
    got = [r[0] for r in rows.select(T.split_turns(F.col("t"))).collect()]
    assert got == [["MEMBER: hi there", "AGENT: yes", "MEMBER: bye"], ["no marks"]]


@pytest.mark.parametrize("phrase, want", [
    ("2026-04-15", ("2026-04-12", "2026-04-19")), ("April 15th", ("2026-04-12", "2026-04-19")),
    ("in mid April", ("2026-04-08", "2026-04-24")), ("late-march", ("2026-03-18", "2026-04-04")),
    ("since the early part", None), ("during May", ("2026-04-28", "2026-06-04")), ("February 30", None),
    ("2026-02-30", None), ("December", None), ("Sept. 3", None), ("mar 1st", ("2026-02-26", "2026-03-05"))])
def test_periods(spark, phrase, want):
    row = spark.createDataFrame([(phrase,)], "p string").select(P.period(
        F.col("p"), F.lit("2026-01-05").cast("date"), F.lit("2026-07-06").cast("date")).alias("x")).first().x
    assert (None if row is None else (str(row.start), str(row.end))) == want


@pytest.mark.parametrize("question, want", [
    ("What is the rate?", [("rate", 7)]), ("What is the mortgage note rate?", [("rate", 1)]),
    ("the average mortgage note rate", [("rate", 1)]), ("first contact resolution rate", []),
    ("fees and rates", [("fee", 5), ("rate", 7)]), ("overdraft fee", [("fee", 1)]), ("prorated feed", [])])
def test_terms(spark, question, want):
    row = spark.createDataFrame([(question,)], "q string").select(L.matched_terms(F.col("q")).alias("t")).first()
    assert [(t.term, len(t.candidates)) for t in row.t] == want


def test_named_metrics_prefers_the_longer_label(spark):
    q = spark.createDataFrame([("the average mortgage note rate and call volume",)], "q string")
    assert q.select(L.named_metrics(F.col("q"))).first()[0] == ["average_mortgage_note_rate", "call_volume"]


def test_redaction_leaves_no_part(spark):
    row = spark.createDataFrame([("x /home/ann/y abcd.host:99 abcd.host",)], "t string")
    assert row.select(T.redact_values(T.redact_home(F.col("t")), ["abcd.host", "abcd.host:99"])).first()[0] == \
        "x ~/y <redacted> <redacted>"


def test_endings_of_long_numbers(spark):
    accounts = spark.createDataFrame([(123450001,), (987650001,), (123460002,), (7,), (50007,)], "account_id long")
    got = {tuple(r) for r in L.repeated_endings(accounts, "account_id").collect()}
    assert got == {("0001", 2), ("0007", 2)}


def test_view_keeps_a_long_call_id_and_length(spark):
    rows = spark.createDataFrame([(1234567890, "MEMBER: card 1234567890")], "id long, t string")
    view = T.transcript_view({"Call ID": F.col("id"), "Date": F.lit("2026-01-05"), "Agent": F.lit("account 1234567890")},
                             F.lit(12345 * 60), F.col("t"))
    assert rows.select(view).first()[0] == ("Call ID: 1234567890\nDate: 2026-01-05\nDuration: 12345:00 (minutes:seconds)\n"
                                            "Agent: account ****7890\n\nTRANSCRIPT:\nMEMBER: card ****7890")
