"""What comes back from models, checked and shaped as Column expressions, and tests of questions and citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Entity types, limits, defaults, words that refer back, characters that a full-text query escapes.
ENTITY_TYPES = ("Person", "Technology", "Project", "Organization", "Concept", "Location")
LONGEST_NAME, CONFIDENCE, IMAGE_CONFIDENCE = 512, 0.75, 0.80
LONGEST_DESCRIPTION, LONGEST_VISIBLE_TEXT = 5_000, 10_000
REFERS_BACK = r"(?i)\b(?:it|that|this|them|those|these|more|also|first|second|third|fourth|fifth|last|previous|above|mentioned)\b"
QUERY_SPECIAL = r"([+\-&|!(){}\[\]^\"~*?:\\/])"
CITED_BEGINNINGS = ("msg-", "file-", "source-")


def _is(value: Column, path: str, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.variant_get(value, path, "variant")).startswith(kind), F.lit(False))


def _string(value: Column, path: str) -> Column:
    """The string there, null if there is none or something else."""
    return F.when(_is(value, path, "STRING"), F.variant_get(value, path, "string"))


def _items(answer: Column, path: str) -> Column:
    """An array of the objects listed there; anything else in the list goes, and what is no list is empty."""
    value = F.try_parse_json(answer)
    items = F.when(_is(value, path, "ARRAY"), F.try_variant_get(value, path, "array<variant>"))
    return F.coalesce(F.filter(items, lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))), F.array().cast("array<variant>"))


def entities(answer: Column) -> Column:
    """Entities (name, type, confidence) of an extraction: names that are no string or too long go, unknown types are concepts, confidences are clamped."""

    def one(x: Column) -> Column:
        kind = _string(x, "$.type")
        return F.struct(
            _string(x, "$.name").alias("name"),
            F.when(kind.isin(*ENTITY_TYPES), kind).otherwise("Concept").alias("type"),
            T.clamp_confidence(F.try_variant_get(x, "$.confidence", "double"), CONFIDENCE).alias("confidence"),
        )

    return F.filter(F.transform(_items(answer, "$.entities"), one), lambda e: F.length(e["name"]) <= LONGEST_NAME)


def triples(answer: Column) -> Column:
    """Triples (subject, predicate, object) whose three parts are strings of at most the longest name."""
    parts = ("subject", "predicate", "object")
    shaped = F.transform(_items(answer, "$.triples"), lambda x: F.struct(*(_string(x, f"$.{k}").alias(k) for k in parts)))
    return F.filter(shaped, lambda t: (F.length(t["subject"]) <= LONGEST_NAME) & (F.length(t["predicate"]) <= LONGEST_NAME) & (F.length(t["object"]) <= LONGEST_NAME))


def unfenced(answer: Column) -> Column:
    """An answer without the code fence around it."""
    blanks = F.lit(" \t\r\n")
    body = F.trim(answer, blanks)
    lines = F.split(body, "\n")
    inner = F.filter(F.slice(lines, 2, F.size(lines)), lambda x: F.trim(x) != "```")
    return F.when(body.startswith("```"), F.trim(F.array_join(inner, "\n"), blanks)).otherwise(body)


def image_answer(answer: Column) -> Column:
    """description, visible_text and entities (name, type, confidence) of what a model says of an image; strings are cut, anything else is empty."""
    body = unfenced(answer)
    value = F.try_parse_json(body)
    text = lambda path, most: F.coalesce(F.substring(_string(value, path), 1, most), F.lit(""))
    shaped = F.transform(_items(body, "$.entities"), lambda x: F.struct(_string(x, "$.name").alias("name"), F.coalesce(_string(x, "$.type"), F.lit("Concept")).alias("type"), F.lit(IMAGE_CONFIDENCE).alias("confidence")))
    named = F.filter(shaped, lambda e: (F.trim(e["name"]) != "") & (F.length(e["name"]) <= LONGEST_NAME))
    return F.struct(text("$.description", LONGEST_DESCRIPTION).alias("description"), text("$.visible_text", LONGEST_VISIBLE_TEXT).alias("visible_text"), named.alias("entities"))


def image_chunk(found: Column) -> Column:
    """The text to index for an image; null if the model said nothing."""
    said = F.filter(F.array(found["description"], found["visible_text"]), lambda x: x != "")
    return F.when(F.size(said) > 0, F.array_join(said, "\n\n"))


def refers_back(question: Column, turns: Column) -> Column:
    """Whether a question needs its conversation: there is one, and the question points to it."""
    return (turns > 0) & question.rlike(REFERS_BACK)


def is_citation(text: Column) -> Column:
    """Whether bracketed text looks like a source id."""
    looks = text.contains("/") | (F.length(text) > 20)
    for beginning in CITED_BEGINNINGS:
        looks = looks | text.startswith(beginning)
    return looks


def fuzzy_query(names: Column) -> Column:
    """A full-text query of all words of an array of names, each escaped and marked fuzzy; words in order, once each."""
    words = F.filter(F.flatten(F.transform(names, lambda n: F.split(F.trim(n), r"\s+"))), lambda w: w != "")
    return F.array_join(F.array_sort(F.array_distinct(F.transform(words, lambda w: F.concat(F.regexp_replace(w, QUERY_SPECIAL, r"\\$1"), F.lit("~"))))), " ")
