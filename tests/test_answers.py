import json
import random
from datetime import date, datetime

import pytest
from frames import rows
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from recordlens.operators import answers, grounding
from recordlens.plans import audit

_draw = random.Random(23)
GAPS = [" ", " ", "  ", "\t", "\n\n", "\r\n ", " \n"]
WORDS = [f"{_draw.choice(['pin', 'cog', 'Shaft', 'rim'])}{k}" for k in range(24)]
BODY = "".join(word + _draw.choice(GAPS) for word in WORDS[:-4]) + " ".join(WORDS[-4:]) + "."
LAST = " ".join(WORDS[-4:]) + "."


def locate(spark, *pairs):
    df = spark.createDataFrame([(i, b, q) for i, (b, q) in enumerate(pairs)], "i long, body string, quote string")
    return grounding.locate_quotes(df).orderBy("i").collect()


@pytest.mark.parametrize("body, quote, cut", [
    (BODY, LAST, LAST), *[(BODY, " ".join(WORDS[i:j]), BODY[BODY.index(WORDS[i]):BODY.index(WORDS[j - 1]) + len(WORDS[j - 1])])
                          for i, j in ((0, 3), (5, 14), (9, 20), (0, 20))],
    ("😀😀 the valve (x.y) stuck", "valve  (x.y)", "valve (x.y)"),
    ("a no break", "no\tbreak", "no break"),
    (r"cost $5 [a-z]* \d+ ^|{2}?", r"$5 [a-z]* \d+ ^|{2}?", r"$5 [a-z]* \d+ ^|{2}?"),
    ("😀é said 😀é again", " 😀é   again", "😀é again"),
])
def test_quotes_found(spark, body, quote, cut):
    (r,) = locate(spark, (body, quote))
    assert r["reason"] is None and body[r["start_offset"]:r["end_offset"]] == cut


@pytest.mark.parametrize("body, quote, reason", [
    (BODY, LAST.upper(), grounding.NOT_FOUND), (BODY, WORDS[2] + WORDS[3], grounding.NOT_FOUND),
    (BODY, "", grounding.EMPTY_QUOTE), (BODY, "   \n\t ", grounding.EMPTY_QUOTE), ("xay", "x.y", grounding.NOT_FOUND),
    ("", "x", grounding.NOT_FOUND),
])
def test_quotes_not_found(spark, body, quote, reason):
    (r,) = locate(spark, (body, quote))
    assert r["reason"] == reason and r["start_offset"] is None


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.text(alphabet="ab. \n(😀\xa0", max_size=40), st.integers(0, 20), st.integers(1, 20)), min_size=20, max_size=20))
def test_any_span_is_found_and_slices_back(spark, drawn):
    pairs = [(b, b[i:i + n]) for b, i, n in drawn]
    norm = lambda s: " ".join(s.split())
    for (body, quote), r in zip(pairs, locate(spark, *pairs)):
        if not norm(quote):
            assert r["reason"] == grounding.EMPTY_QUOTE
        else:
            assert norm(body[r["start_offset"]:r["end_offset"]]) == norm(quote)
            assert norm(body).index(norm(quote)) == len(norm(body[:r["start_offset"]] + "|")) - 1


@pytest.mark.parametrize("a_pass", [1, 3, 2000])
def test_many_quotes_of_a_body_in_one_pass(spark, a_pass):
    """Spans of every depth, right, changed and blank, over bodies of any white space: as each alone."""
    draw = random.Random(a_pass)
    letters = ["a", "b", "é", "😀", "(", ".", " ", "  ", "\n", "\u3000 ", "\t"]
    bodies = [(k, "".join(draw.choice(letters) for _ in range(draw.choice([0, 3, 60, 400])))) for k in range(12)] + [(99, None), (98, "x" + " " * 70 + "y z")]
    quotes = set()
    for k, body in bodies:
        for _ in range(25):
            first = draw.randrange(len(body or "a"))
            span = (body or "")[first:first + draw.randint(1, 30)]
            quotes.add((str(k), draw.choice([span, f" {span}\n", span.replace(" ", "  "), span + "q", ""])))
    quotes |= {("98", "x y"), ("98", "x  y z"), ("98", "y z"), ("99", "a"), ("1000", "a")}
    pairs = spark.createDataFrame(sorted(quotes), "document_id string, quote string")
    stored = spark.createDataFrame(bodies, "document_id long, body string")
    alone = grounding.locate_quotes(pairs.join(stored.select(grounding.as_text("document_id"), "body"), "document_id", "left")).drop("body")
    columns = ["document_id", "quote", "start_offset", "end_offset", "reason"]
    assert rows(grounding.locate_in_bodies(pairs, stored, a_pass), *columns) == rows(alone, *columns)


def checked(spark, citations, shown, bodies):
    return grounding.check_citations(
        spark.createDataFrame(citations, "answer_id long, pos int, document_id string, quote string"),
        spark.createDataFrame(shown, "answer_id long, document_id long"),
        spark.createDataFrame(bodies, "document_id long, body string"),
    )


BODIES = [(1, BODY), (2, "Brakes failed."), (3, "Not shown.")]


def test_citation_check(spark):
    got = checked(spark, [
        (1, 0, "1", LAST), (1, 1, "2", "brakes failed"), (1, 2, "2", "Brakes failed."),
        (1, 3, " ", "Brakes failed."), (1, 4, "3", "Not shown."), (1, 5, "x9", ""), (1, 6, "2", " "),
        (2, 0, "2", "Brakes failed."), (3, 0, "77", "Brakes failed."),
    ], [(1, 1), (1, 2), (2, 2), (2, 3), (3, 2)], BODIES)
    assert rows(got, "answer_id", "pos", "reason") == sorted([
        (1, 0, None), (1, 1, grounding.NOT_FOUND), (1, 2, None), (1, 3, grounding.MISSING_DOCUMENT_ID),
        (1, 4, grounding.UNKNOWN_DOCUMENT), (1, 5, grounding.UNKNOWN_DOCUMENT), (1, 6, grounding.EMPTY_QUOTE),
        (2, 0, None), (3, 0, grounding.UNKNOWN_DOCUMENT)], key=lambda r: tuple((v is not None, str(v)) for v in r))
    assert got.where("reason is not null and start_offset is not null").count() == 0
    assert rows(grounding.citation_accounting(got)) == [(1, 7, 2, 5, True), (2, 1, 1, 0, True), (3, 1, 0, 1, False)]
    assert grounding.faithfulness(got).first()["label"] == "3 / 9 (33.3%)"
    none = grounding.faithfulness(got.where("false")).first()
    assert none["faithfulness"] is None and none["label"] == "no citations emitted"
    around = grounding.citation_context(got.where("verified and answer_id = 1 and pos = 0"), spark.createDataFrame(
        BODIES, "document_id long, body string")).first()
    assert around["before"] + around["highlighted"] + around["after"] == BODY and around["highlighted"] == LAST


def test_bad_ranges_highlight_nothing(spark):
    v = spark.createDataFrame([(1, 0, "2", 5, 5), (1, 1, "2", 0, 99), (1, 2, "2", None, None)],
                              "answer_id long, pos int, document_id string, start_offset int, end_offset int")
    got = grounding.citation_context(v, spark.createDataFrame(BODIES, "document_id long, body string"))
    assert rows(got, "before", "highlighted", "after") == [("Brakes failed.", "", "")] * 3


def test_cited_and_uncited_records(spark):
    docs = spark.createDataFrame([(1, "complaint", "c1"), (2, "recall", "17V1"), (3, "investigation", "EA1")],
                                 "document_id long, kind string, external_id string")
    c = spark.createDataFrame([(1, 3, "3", True), (1, 0, "1", True), (1, 1, "2", True), (1, 4, "2", True), (1, 2, "3", False)],
                              "answer_id long, pos int, document_id string, verified boolean")
    cited = grounding.cited_records(c, docs)
    assert rows(cited, "pos", "kind", "external_id") == [(1, "recall", "17V1"), (3, "investigation", "EA1")]
    pool = spark.createDataFrame([(1, "17V1"), (1, "18V2"), (2, "17V1")], "answer_id long, external_id string")
    assert rows(grounding.uncited_matches(pool, cited)) == [(1, "18V2"), (2, "17V1")]


def test_parse_answers(spark):
    good = {"answer": "It leaks.", "isKnownPattern": True, "linkedCampaigns": ["17V1", "", 3, None],
            "citations": [{"documentId": "RECORD 1886", "quote": "q"}, "junk", {"quote": "x"}, {"documentId": 7}]}
    replies = [json.dumps(good), "", "nope", "[1]", '{"answer": " "}', '{"answer": 5}', '{"citations": []}',
               '{"answer": "a", "isKnownPattern": "true", "citations": {}}', None, '"text"']
    a, c, f = answers.parse_answers(spark.createDataFrame(list(enumerate(replies)), "answer_id long, reply string"))
    assert rows(a) == [(0, "It leaks.", True, ["17V1"]), (7, "a", False, [])]
    assert rows(c) == [(0, 0, "1886", "q"), (0, 2, "", "x"), (0, 3, "", "")]
    bad, missing = answers.MALFORMED_JSON, answers.MISSING_ANSWER
    assert rows(f) == [(1, bad), (2, bad), (3, bad), (4, missing), (5, missing), (6, missing), (8, bad), (9, bad)]


def test_evidence_order_and_context(spark):
    r = spark.createDataFrame([(1, "10", "recall", "17V1", date(2017, 1, 2), "Ten."), (1, "9", "complaint", "c", None, "Nine."),
                               (1, "x", "complaint", "z", None, "X.")],
                              "query_id long, document_id string, kind string, external_id string, filed_on date, body string")
    assert rows(answers.evidence_order(r), "pos", "document_id") == [(1, "9"), (2, "10"), (3, "x")]
    q = spark.createDataFrame([(1, "2013 Explorer", " why? ")], "query_id long, display_name string, text string")
    assert answers.build_contexts(q, r.where("document_id <> 'x'")).first()["context"] == (
        "Vehicle: 2013 Explorer\n\nRecords:\n"
        "\n\nRECORD 9\nkind: complaint\nnhtsa id: c\nfiled: unknown\ntext: Nine.\n"
        "\n\nRECORD 10\nkind: recall\nnhtsa id: 17V1\nfiled: 2017-01-02\ntext: Ten.\n"
        "\nQuestion: why?")


def test_answerer_seam(spark):
    contexts = spark.createDataFrame([(i, f"c{i}") for i in range(40)], "query_id long, context string")
    got = answers.answer(contexts, lambda batch: [c.upper() for c in batch], batch=16)
    assert rows(got) == sorted(((i, f"C{i}") for i in range(40)), key=lambda r: str(r[0]))
    with pytest.raises(Exception, match="received 1 replies"):
        answers.answer(contexts, lambda batch: ["one"]).collect()


def test_audit(spark, tmp_path):
    questions = spark.createDataFrame([(i, 1, f"question {i}") for i in range(1, 7)], "query_id long, vehicle_id long, text string")
    shown = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4, 6)], "query_id long, document_id long")
    cite = lambda d, q: {"documentId": d, "quote": q}
    reply = lambda *c: json.dumps({"answer": "Yes.", "isKnownPattern": True, "citations": c, "linkedCampaigns": ["17V1"]})
    replies = spark.createDataFrame([
        (1, reply(cite("1", LAST), cite("1", "made up")), None), (2, reply(cite("1", "made up")), None),
        (3, None, "The model declined to answer this question."), (4, "broken", None), (5, reply(), None),
    ], "query_id long, reply string, refusal string")
    audited, _ = audit.audit_answers(questions, shown, replies, spark.createDataFrame(BODIES, "document_id long, body string"))
    got = {r["answer_id"]: (r["answer_text"], r["is_grounded"], r["is_known_pattern"], r["linked_campaigns"],
                            r["verified_citation_count"], r["dropped_citation_count"]) for r in audited.collect()}
    none = (False, False, [], 0)
    assert got == {
        1: ("Yes.", True, True, ["17V1"], 1, 1), 2: (grounding.NO_EVIDENCE, *none, 1),
        3: ("The model declined to answer this question.", *none, 0), 4: (answers.MALFORMED_JSON, *none, 0),
        5: (audit.NO_RECORDS, *none, 0), 6: (answers.MALFORMED_JSON, *none, 0)}
    audit.append_answers(audited, str(tmp_path / "answers"), datetime(2026, 1, 1))
    stored = spark.read.parquet(str(tmp_path / "answers")).where("answer_id = 1").first()
    assert json.loads(stored["answer_json"])["AnswerText"] == "Yes." and stored["verified_citation_count"] == 1


def test_pools_fall_back_to_keywords(spark):
    from test_search import CORPUS, VEHICLE, record

    plain = spark.createDataFrame([
        record(i, 1, f"e{i}", "A", None, "loud engine noise", kind="recall" if i < 6 else "complaint") for i in range(30)], CORPUS)
    corpus = plain.withColumn("embedding", F.lit(None).cast("array<float>"))
    vehicles = spark.createDataFrame([(1, None, None, None)], VEHICLE)
    asked = spark.createDataFrame([(5, 1, "engine noise", None, None)],
                                  "query_id long, vehicle_id long, text string, mode string, embedding array<float>")
    wide, campaigns = audit.evidence_pools(asked, vehicles, corpus)
    assert sorted(r["document_id"] for r in wide.collect()) == list(range(12))
    assert sorted(r["document_id"] for r in campaigns.collect()) == [0, 1, 2, 3]
    assert answers.merge_pools(wide, campaigns).count() == 12
