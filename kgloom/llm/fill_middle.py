"""Fill-in-the-middle texts: a document is cut at two token borders, and prefix, suffix and middle are written in another order.

Tokens are those of the ``tokenizers`` library's ``Split`` pre-tokenizer with every match isolated; it needs no training. It gives each token's
code-point offsets, so the length of that array is n, and the ends of prefix and middle are the offsets of two ranks, the smaller and the larger of two draws. The draws come from a
hash of ``SEED`` and doc_id alone, so reruns and lost executors give the same cuts. One Arrow pass, no shuffle: a text is held with its offsets and nothing else.

Forms: ``plain`` (the text as it is), ``psm`` (``<P>`` prefix ``<S>`` suffix ``<M>`` middle) and ``spm`` (``<S>`` suffix ``<P>`` prefix ``<M>`` middle). ``restored`` undoes each.

Defined cases: a null text is an empty one; empty texts and texts that spell a mark stay plain; a text of one token can have empty parts; a null doc_id draws as an empty
id; repeated rows give repeated results; texts of any length are cut whole; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Blanks that may lead a word, and the word; or the blanks at the end. The group is atomic: no blank that it took could begin a word.
TOKEN = r"(?>[\x20\x09-\x0D]*)[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = MARKS = "<P>", "<S>", "<M>"
#: Shares in percent: texts that are cut at all, and of these the ones whose suffix comes first.
SEED, CUT, SUFFIX_FIRST = 42, 50, 80
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@lru_cache(maxsize=4)
def _splitter(pattern: str):
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(pattern), "isolated")


def token_ends(text: str, pattern: str = TOKEN) -> list[int]:
    """Where each token ends, in code points."""
    return [end for _, (_, end) in _splitter(pattern).pre_tokenize_str(text)]


def draws(doc_id: int | None, seed: int = SEED) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def cut_at(ends: list[int], one: int, other: int) -> tuple[int, int]:
    """The offsets that end prefix and middle: those of two ranks from 0 to the number of tokens."""
    low, high = sorted((one % (len(ends) + 1), other % (len(ends) + 1)))
    offsets = [0, *ends]
    return offsets[low], offsets[high]


def transform(doc_id: int | None, text: str, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> tuple:
    """n, form, the lengths of prefix and middle (none if plain) and the output."""
    ends = token_ends(text)
    one, other, whether, order = draws(doc_id, seed)
    if not text or any(m in text for m in MARKS) or whether % 100 >= cut:
        return len(ends), "plain", None, None, text
    a, b = cut_at(ends, one, other)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < suffix_first:
        return len(ends), "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return len(ends), "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, cut: int = CUT, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """The columns of ``SCHEMA``, a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in batches:
            ids = batch.column("doc_id")
            rows = [transform(k, t.as_py() or "", cut, suffix_first, seed) for k, t in zip(ids.to_pylist(), batch.column("text"))]
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds))], [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The exact text again. No part spells a mark and no mark can overlap itself or another, so the marks are just those that were written."""
    part = lambda k: F.get(F.split(output, "|".join(MARKS), -1), F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
