import hashlib

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import dates, jsonx, numbers
from palimpsest.functions import text as tx
from palimpsest.operators import analytics, evaluate

CASES = [
    ("£12.85 (with railcard)", "The fare was £12.85", "", True),
    ("£12.85", "£12.80", "", False),
    ("March 3-5, 2022", "from Mar 3 to 5 2022", "", True),
    ("2022-07-25", "July 25", "", True),
    ("2022-07-25", "July 26", "", False),
    ("25 July 2022", "20220725", "", True),
    ("4:00 PM", "16:00", "", False),  # the 24-hour rule also reads 4:00
    ("4:00 PM", "17:00", "", False),
    ("noon", "12:00", "", True),
    ("three sessions", "3", "", False),  # the numbers agree, the words do not
    ("Unknown", "There is no information about it", "", True),
    ("Unknown", "Grace", "", False),
    ("Grace", "not available", "", False),
    ("yes", "no", "", False),
    ("Yes, it was", "yes", "", False),  # two list items
    ("Yes indeed", "yes", "", True),
    ("12 High Street, Oxford", "It is on High Street in Oxford", "", False),  # the number is missing
    ("High Street Oxford", "It is on High Street in Oxford", "", True),
    ("K702AB", "The code: K702AB", "", True),
    ("K702AB", "The code: K703AB", "", False),
    ("tomorrow", "March 02", "Today is 2022-03-01, when?", True),
    ("red, green, blue", "blue, red, green", "", True),
    ("red, green, blue", "blue, red", "", False),
    ("$20", "20 euros", "", False),
    ("A Star Wars-themed event", "star wars-themed event", "", True),
    ("the quick brown fox jumps", "quick brown fox jumps high", "", True),
    ("1,250", "1250", "", True),
    ("Porto", "It was in Porto, Portugal", "", True),
    ("Porto", "Lisbon", "", False),
    ("5 days", "5", "", True),
    ("Between April 20 and April 26", "April 20 to April 26", "", True),
    ("", "", "", True),
]


def test_exact_match(spark):
    df = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(CASES)], "id int, answer string, prediction string, question string")
    got = {r.id: r.exact for r in evaluate.with_exact_match(df).collect()}
    assert {CASES[k][:2]: v for k, v in got.items() if v != CASES[k][3]} == {}


def one(spark, column, *values):
    names = [f"c{k}" for k in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names)).alias("x")).first().x


def test_date_and_time_tokens(spark):
    assert one(spark, dates.answer_dates, "2022-07-25, 20230102, May 3rd to 5th 2021, 7 June, Sept 9, 2020") == ["20220725", "20230102", "20210503-20210505", "20200909", "0607"]
    assert one(spark, dates.answer_times, "9-11 am, 13:45 and 12 p.m.")[0] == "09:00-11:00"
    assert one(spark, dates.record_date, "taken 2021/5 somewhere").isoformat() == "2021-05-01"
    assert str(one(spark, dates.email_timestamp, "Fri, 10 May 2024 14:46:00 +0100")) == "2024-05-10 14:46:00"
    assert str(one(spark, dates.email_timestamp, "5/10/2024, 2:46 PM")) == "2024-05-10 14:46:00"
    assert one(spark, dates.record_date, "2021-02-31") is None


def test_numbers_of_four_digits(spark):
    assert one(spark, numbers.numbers, "1250") == [] and [float(x) for x in one(spark, lambda c: numbers.numbers(c, True), "1250")] == [1250.0]
    assert [float(x) for x in one(spark, numbers.amounts, "$1250")] == [125.0]
    assert [float(x) for x in one(spark, lambda c: numbers.amounts(c, True), "$1250")] == [1250.0]
    assert one(spark, numbers.currencies, "20 pounds or €3") == ["EUR", "GBP"]
    assert one(spark, numbers.codes, "ab12, 25TH, abcd, K702AB, k702ab") == ["AB12", "K702AB"]


def test_lists(spark):
    assert one(spark, evaluate.list_score, "20230401_120000, email00021", "I saw 20230401_120000 and EMAIL00021") == 1.0
    assert one(spark, evaluate.list_score, "a; b", "b and c") == pytest.approx(1 / 3)
    assert one(spark, evaluate.list_score, "", "") == 1.0 and one(spark, evaluate.list_score, "", "x") == 0.0
    assert one(spark, evaluate.list_score, "a, b", "b, c") == one(spark, evaluate.list_score, "b, c", "a, b")


def test_question_types(spark):
    for answer, kind in (("£12.85", "number"), ("March 3 2022 at 9 am", "number"), ("email12, 20230401_120000", "list_recall"), ("unknown", "open_end"), ("Porto", "open_end"), ("", "open_end")):
        assert one(spark, evaluate.question_type, answer) == kind
    assert one(spark, lambda a, w: evaluate.question_type(a, w), "Porto", " Numeric ") == "number"


def test_summary_has_every_kind(spark):
    rows = {r.kind: (r.n, r.correct, r.accuracy) for r in evaluate.summarize_scores(spark.createDataFrame([("number", 2.0), ("odd", 0.5), (None, None)], "qtype string, score double")).collect()}
    assert rows == {"number": (1, 1.0, 1.0), "list_recall": (0, 0.0, 0.0), "open_end": (2, 0.5, 0.25), "all": (3, 1.5, 0.5)}


def test_text_helpers(spark):
    assert one(spark, tx.clean_city, "1 Road\nCity: Porto\nCountry: Portugal") == "Porto, Portugal" and one(spark, tx.clean_city, "Porto") == "Porto"
    assert one(spark, tx.stem, "/a/b.c/20230401_120000.jpg") == "20230401_120000"
    assert one(spark, tx.sender_name, '"Ann Lee" <a@b.co>') == "Ann Lee" and one(spark, tx.sender_name, "ann.lee@b.co") == "Ann Lee"
    assert one(spark, tx.html_to_text, "<p>a &amp; <b>b</b></p><script>x</script><!-- y -->") == "a & b"
    assert one(spark, tx.parse_tags, "Food, a, travel,food") == ["food", "travel"]
    assert [tuple(e) for e in one(spark, tx.parse_entities, "Porto: place\nnone")] == [("Porto", "place")]
    assert one(spark, lambda c: tx.trimmed(c, 3), "ab cd") == "ab ..."
    assert one(spark, tx.evidence_kind, "x.MP4") == "video" and one(spark, tx.evidence_kind, "email1") == "email" and one(spark, tx.evidence_kind, "20230401_120000") == "unknown"


def test_json_helpers(spark):
    assert one(spark, lambda c: jsonx.balanced_object(c), 'x {bad {"a": "}"} y') == '{"a": "}"}'
    assert one(spark, jsonx.greedy_object, "<think>{1}</think> a {2} b") == "{2}"
    assert one(spark, jsonx.judged, "incorrect") is True and one(spark, jsonx.judged, '{"accuracy": false}') is False
    assert one(spark, jsonx.support, "Fully supported") == "fully"


USAGE = "run string, pos long, group_id string, input long, output long, total long, cache_read long, cache_creation long, uncached long, cost double"


def test_usage_totals(spark):
    row = lambda run, pos, group, total: (run, pos, group, total, None, total, None, None, None, None)
    rows = [row("a", 1, "g", 5), row("a", 2, "g", 9), row("a", 3, "h", 1), row("b", 1, None, 10), row("b", 2, None, 20), row("b", 3, None, 30), row("c", 1, None, 7), row("c", 2, None, 3), row("c", 3, None, 7)]
    got = {r.run: (r.total, r.output) for r in analytics.usage_totals(spark.createDataFrame(rows, USAGE), ["run"]).collect()}
    assert got == {"a": (10, None), "b": (30, None), "c": (10, None)}


def test_longest_prefix(spark):
    models = spark.createDataFrame([("gpt-5-mini",), ("gpt-5",), ("other",)], "model string")
    prices = spark.createDataFrame([("gpt", 1.0), ("gpt-5", 2.0), ("gpt-5-mini", 3.0)], "prefix string, rate double")
    assert {r.model: r.rate for r in analytics.price_of(models, prices).collect()} == {"gpt-5-mini": 3.0, "gpt-5": 2.0}


def test_prices_are_sent_not_models(spark):
    models = spark.createDataFrame([("gpt-5",), ("",), (None,)], "model string")
    prices = spark.createDataFrame([("gpt", 1.0), ("", 0.5)], "prefix string, rate double")
    found = analytics.price_of(models, prices)
    assert {(r.model, r.rate) for r in found.collect()} == {("gpt-5", 1.0), ("", 0.5)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan


def test_long_pages_keep_their_length(spark, tmp_path):
    from palimpsest.plans import textual

    pages = [(1, "<p>" + "a" * 60_000 + "</p>"), (2, "<b>b</b>"), (3, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.n, r.text_sha256) for r in textual.html_to_text(spark, str(tmp_path)).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {1: (60_000, digest("a" * 50_000 + "...")), 2: (1, digest("b")), 3: (None, None)}
