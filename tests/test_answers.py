"""Checks of model answers, questions and citations, and the brief's topics and meeting."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from kgloom.functions import answers
from kgloom.plans import people
from kgloom.sources import parsers


def said(spark, f, value):
    return spark.createDataFrame([(value,)], "a string").select(f(F.col("a")).alias("x")).first().x


def test_entities_and_triples(spark):
    answer = json.dumps({
        "entities": [{"name": "a", "type": "Project", "confidence": 3}, {"name": 5}, {"type": "Person"}, "x", {"name": "b", "type": "Zebra", "confidence": "no"}, {"name": "n" * 513}, {"name": "c", "type": 1, "confidence": -1}],
        "triples": [{"subject": "a", "predicate": "USES", "object": "b"}, {"subject": "a", "predicate": 1, "object": "b"}, {"subject": "a", "object": "b"}, None, {"subject": "s" * 513, "predicate": "p", "object": "o"}],
    })
    assert [tuple(e) for e in said(spark, answers.entities, answer)] == [("a", "Project", 1.0), ("b", "Concept", 0.75), ("c", "Concept", 0.0)]
    assert [tuple(t) for t in said(spark, answers.triples, answer)] == [("a", "USES", "b")]


@pytest.mark.parametrize("answer", [None, "", "no json", "[1]", '{"entities": {"name": "a"}}', '{"entities": null}'])
def test_answers_without_entities(spark, answer):
    assert said(spark, answers.entities, answer) == [] and said(spark, answers.triples, answer) == []


def test_image_answers(spark):
    body = json.dumps({"description": "d" * 5001, "visible_text": 7, "entities": [{"name": "x", "type": "T"}, {"name": " "}, {"name": "y", "type": 3}]})
    got = said(spark, answers.image_answer, f"```json\n{body}\n```")
    assert got.description == "d" * 5000 and got.visible_text == ""
    assert [tuple(e) for e in got.entities] == [("x", "T", 0.8), ("y", "Concept", 0.8)]
    chunk = lambda a: said(spark, lambda c: answers.image_chunk(answers.image_answer(c)), a)
    assert chunk('{"description": "a", "visible_text": "b"}') == "a\n\nb" and chunk("{}") is None


def test_questions_and_citations(spark):
    assert said(spark, lambda c: answers.refers_back(c, F.lit(2)), "And what about THAT one?")
    assert not said(spark, lambda c: answers.refers_back(c, F.lit(0)), "what is it")
    assert not said(spark, lambda c: answers.refers_back(c, F.lit(2)), "italic thistles")
    assert [said(spark, answers.is_citation, t) for t in ("a/b", "note", "msg-1", "x" * 21, "x" * 20)] == [True, False, True, True, False]
    assert said(spark, lambda c: answers.fuzzy_query(F.array(c, F.lit("b a"))), "a:b  C++") == r"C\+\+~ a\:b~ a~ b~"


def test_meeting_and_topics(spark):
    nodes = spark.createDataFrame([("CalendarEvent", "c", {"start_time": "2026-01-01"}), ("Person", "p", {"email": "p@x.org", "name": "P"}), ("Person", "q", {"name": "Q"}), ("Attachment", "f", {"title": "F"}), ("Email", "new", {"date": "2026-04-01T00:00:00Z"}), ("Email", "old", {"date": "2025-04-01T00:00:00Z"})], "label string, source_id string, props map<string,string>")
    edges = spark.createDataFrame([("CalendarEvent", "c", "ATTENDED_BY", "Person", "p"), ("CalendarEvent", "c", "ORGANIZED_BY", "Person", "q"), ("Attachment", "f", "ATTACHED_TO", "CalendarEvent", "c"), *(row for m in ("new", "old") for row in (("Person", "p", "SENT", "Email", m), ("Email", m, "TAGGED", "Topic", f"of {m}")))], "src_label string, src_id string, rel string, dst_label string, dst_id string")
    got = people.meeting_context("c", nodes, edges).collect()
    assert len(got) == 1 and got[0].summary == "(no summary)" and got[0].attendees == ["Q", "p@x.org"] and got[0].attachments == ["F"]
    assert people.meeting_context("none", nodes, edges).count() == 0
    me = spark.createDataFrame([("p",)], "source_id string")
    assert [tuple(r) for r in people.active_topics(me, nodes, edges, datetime(2026, 1, 1, tzinfo=timezone.utc)).collect()] == [("of new", 1)]


def test_references_from_chunks(spark):
    chunks = spark.createDataFrame([("a", 1, "and omnifocus://task/7."), ("a", 0, "see gmail://x/message/1, gmail://x/message/1"), ("omnifocus://9", 0, "me: omnifocus://9"), ("b", 0, None)], "source_id string, chunk_index int, text string")
    got = sorted(map(tuple, parsers.references(chunks).collect()))
    assert got == [("a", "REFERENCES", "Email", "gmail://x/message/1"), ("a", "REFERENCES", "Task", "omnifocus://7")]
