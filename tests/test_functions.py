import hashlib

import pytest
from pyspark.sql import functions as F

from chronolore.functions import dates, ids, text, vectors


def value(spark, column, **inputs):
    return spark.createDataFrame([tuple(inputs.values())], [*inputs]).select(column.alias("v")).first()["v"] if inputs else spark.range(1).select(column.alias("v")).first()["v"]


def of(spark, f, x):
    return spark.createDataFrame([(x,)], "x string").select(f(F.col("x")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("f", "given", "wanted"),
    [
        (text.normalise, " A\t\n b  C ", "a b c"),
        (text.normalise_name, "  José-María O'Neil 3 ", "josmara oneil 3"),
        (text.keywords, "When does Harbour premiere? (the doc series, the DOC)", ["harbour", "premiere", "doc", "series"]),
        (text.keyword_query, "Who owns the launch plan?", "owns OR launch OR plan"),
        (text.keyword_query, "?? a an", ""),
        (text.salient_terms, "On May 4 and 2026/05/04 Alexandra said no to Bo. Alexandra!", ["4", "2026/05/04", "Alexandra"]),
        (text.opening_sentence, "  First one. Second.", "First one."),
        (text.opening_sentence, "no stop", "no stop"),
        (text.clean_mention, " Speaker 2. ", "Speaker 2"),
        (text.clean_mention, "Alexandra Petrova.", "Alexandra Petrova"),
        (text.clean_mention, "Priya R.", "Priya R."),
        (text.clean_mention, "Dana O.,", "Dana O."),
        (text.clean_mention, " ,;: ", None),
        (text.clean_mention, None, None),
        (text.blank_to_null, " \t", None),
        (text.blank_to_null, " a ", "a"),
        (text.null_to_blank, None, ""),
        (text.unwrap_fence, '```json\n{"a": 1}\n```', '{"a": 1}'),
        (text.unwrap_fence, " plain ", "plain"),
        (text.answer_name, "Mira Solano — she spoke first", "Mira Solano"),
        (text.slug, 'a/b: "c" #d [e]  f.', "a b c d e f"),
        (text.wikilink, "x.", "[[x]]"),
        (text.slug, "y" * 150, "y" * 100),
        (lambda c: text.ellipsis(c, 10), "abcdefghijk", "abcdefg..."),
        (lambda c: text.ellipsis(c, 11), "abcdefghijk", "abcdefghijk"),
        (text.rejection_class, "RISK requires EVIDENCE", "missing required field"),
        (text.rejection_class, "the quote is ungrounded and requires", "ungrounded quote"),
        (text.rejection_class, "z" * 60, "z" * 40),
        (text.citations, "Yes [1], and [7] and [1], not [x].", [1, 7]),
        (text.label_of, "ACTION_ITEM", "ActionItem"),
        (dates.cue_offset_ms, "01:02:03.004", 3723004),
        (dates.cue_offset_ms, "02:03,5", 123500),
        (lambda c: dates.message_ts(c).cast("string"), "1770800000.000100", "2026-02-11 08:53:20.0001"),
        (lambda c: dates.message_ts(c).cast("string"), "0", "1970-01-01 00:00:00"),
        (lambda c: dates.instant_of(c).cast("string"), "2026-04-08T10:00:00Z", "2026-04-08 10:00:00"),
        (lambda c: dates.instant_of(c).cast("string"), "2026-04-08", "2026-04-08 00:00:00"),
        (dates.instant_of, "April", None),
        (dates.date_of, "2026-13-40", None),
        (lambda c: dates.date_of(c).cast("string"), " 2026-04-08 and more", "2026-04-08"),
    ],
)
def test_text_and_dates(spark, f, given, wanted):
    assert of(spark, f, given) == wanted


@pytest.mark.parametrize(("answer", "wanted"), [("It is June 1.", 1.0), ("It is June 15.", 0.5), ("", 0.0)])
def test_term_coverage_is_by_whole_words(spark, answer, wanted):
    assert value(spark, text.term_coverage(F.col("a"), F.lit("June 1.")), a=answer) == wanted


def test_match_name(spark):
    people = F.array(F.lit("Alex Brandt"), F.lit("Alex Rowe"))
    assert value(spark, text.match_name(F.lit("alex rowe - he said so"), people)) == "Alex Rowe"
    assert value(spark, text.match_name(F.lit("Alex"), people)) == "Alex Brandt"
    assert value(spark, text.match_name(F.lit("Unknown"), people)) is None


def test_parse_grants():
    assert text.parse_grants(" slack:C1, ,zoom:ops,slack:C1") == ["slack:C1", "zoom:ops"] and text.parse_grants(None) == []


def test_as_of_and_closing(spark):
    assert str(value(spark, dates.as_of("2026-04-15"))) == "2026-04-15 00:00:00" and value(spark, dates.as_of(None)) is None
    assert str(value(spark, dates.closed_at(dates.as_of("2026-04-15"), dates.as_of("2026-04-01")))) == "2026-04-15 00:00:00"


def test_vectors(spark):
    array = lambda *x: F.array(*[F.lit(float(v)).cast("float") for v in x])
    assert value(spark, vectors.cosine(array(1, 0, 0), array(3, 4, 0))) == pytest.approx(0.6)
    assert value(spark, vectors.cosine(array(0, 0), array(1, 1))) == 0.0
    assert value(spark, vectors.cosine(array(1, 0), array(1, 0, 5))) == pytest.approx(1 / 26**0.5)
    assert value(spark, vectors.ratio(F.lit(0), F.lit(0), 1.0)) == 1.0 and vectors.clamp(99, 1, 25) == 25


def test_ids(spark):
    digest = hashlib.sha256(b"ep\0RISK\0null").hexdigest()[:24]
    assert value(spark, ids.fact_id(F.lit("ep"), F.lit("RISK"), F.lit(None).cast("string"))) == f"fact:{digest}"
    assert value(spark, ids.person_id(F.lit(" A@B.test"), F.lit("x"))) == "person:email:a@b.test"
    assert value(spark, ids.person_id(F.lit(""), F.lit("Ann Lee"))) == "person:name:ann lee"
    rows = spark.createDataFrame([(1, "s:b", "two"), (0, "s:a", "one")], "o int, s string, t string")
    got = rows.agg(ids.content_hash(F.col("o"), F.col("s"), F.col("t"))).first()[0]
    assert got == hashlib.sha256(b"s:a\0one\0s:b\0two\0").hexdigest()
