"""Chunkers and token windows: sequential rules, run per text or session in Arrow batches."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP, LEAST = 512, 64, 100
#: Characters of chunks that a task holds before it gives them on.
OUT_CHARS = 1 << 20
CHUNKS = pa.schema([("chunk_id", pa.string()), ("source_id", pa.string()), ("chunk_index", pa.int32()), ("text", pa.string())])
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
# Fixed value: how a rendered message begins; replies in a thread are indented.
_MESSAGE = re.compile(r"^(?:  )?\[\d{2}:\d{2} UTC\]", re.MULTILINE)


def chunk_bounds(ends: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Chunks as (first word, word after the last), from where each sentence ends. A chunk takes the sentences that end within ``size`` words of its start, one at least,
    and starts ``overlap`` words before the end of the one before, if that has so many."""
    out, first, done = [], 0, 0
    while done < len(ends):
        done = max(done + 1, bisect_right(ends, first + size))
        out.append((first, ends[done - 1]))
        first = ends[done - 1] - (overlap if 0 < overlap <= ends[done - 1] - first else 0)
    return out


def joined_short(bounds: list[tuple[int, int]], size: int, least: int) -> list[list[tuple[int, int]]]:
    """Chunks under ``least`` words put to the one before, and a first one that stays short to the next, up to 1.5 times the size together."""
    length = lambda parts: sum(e - s for s, e in parts)
    fits = lambda parts, more: length(parts) + length(more) <= int(size * 1.5)
    groups: list[list[tuple[int, int]]] = []
    for part in bounds:
        short = groups and length([part]) < least and fits(groups[-1], [part])
        groups[-1:] = [groups[-1] + [part]] if short else groups[-1:] + [[part]]
    if len(groups) > 1 and length(groups[0]) < least and fits(*groups[:2]):
        groups = [groups[0] + groups[1], *groups[2:]]
    return groups


def chunk_text(text: str | None, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> list[str]:
    """Chunks of whole sentences of about ``size`` words, each beginning with the last ``overlap`` of the one before; short ones join a neighbour."""
    sentences = [s.split() for s in _SENTENCE.split(text or "")]
    words = list(chain.from_iterable(sentences))
    ends = [n for n, s in zip(accumulate(map(len, sentences)), sentences) if s]
    return [" ".join(chain.from_iterable(words[s:e] for s, e in group)) for group in joined_short(chunk_bounds(ends, size, overlap), size, least)]


def message_blocks(text: str) -> list[str]:
    """A rendered chat text at its ``[HH:MM UTC]`` headers; what comes before the first is a block too."""
    starts = [m.start() for m in _MESSAGE.finditer(text)]
    bounds = sorted({0, *starts, len(text)})
    blocks = [text[a:b].strip("\n") if a not in starts else text[a:b].rstrip("\n") for a, b in zip(bounds, bounds[1:])]
    return [b for b in blocks if b.strip()]


def chunk_messages(text: str | None, size: int = SIZE, overlap: int = 3) -> list[str]:
    """Chunks of whole messages ending at the boundary nearest to ``size`` words (the earlier of two alike); the next shares ``overlap`` messages but always gets on."""
    blocks = message_blocks(text or "")
    total = [0, *accumulate(len(b.split()) for b in blocks)]
    out, first = [], 0
    while first < len(blocks):
        under = bisect_right(total, total[first] + size) - 1
        gap = lambda at: abs(total[at] - total[first] - size)
        end = max(under, first + 1) if under in (first, len(blocks)) else min((under, under + 1), key=gap)
        out.append("\n".join(blocks[first:end]))
        first = len(blocks) if end == len(blocks) else max(end - max(0, overlap), first + 1)
    return out


def _framed(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, CHUNKS)], schema=CHUNKS)


def _chunked(chunker):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for i, t in zip(batch.column(0), batch.column(1)):
                i = i.as_py()
                new = [(f"{i}:chunk:{k}", i, k, c) for k, c in enumerate(chunker(t.as_py()))]
                rows += new
                held += sum(len(r[3]) for r in new)
                if held >= OUT_CHARS:
                    yield _framed(rows)
                    rows, held = [], 0
            yield _framed(rows)

    return run


def chunks(docs: DataFrame, chunker=chunk_text, id_col: str = "source_id", text_col: str = "text") -> DataFrame:
    """chunk_id, source_id, chunk_index and text for each chunk of each document. Texts are taken from a batch one by one and chunks given on from ``OUT_CHARS`` characters."""

    return docs.select(F.col(id_col).cast("string").alias("source_id"), F.col(text_col).alias("text")).mapInArrow(_chunked(chunker), "chunk_id string, source_id string, chunk_index int, text string")


def estimate(text: str | None) -> int:
    return max(1, len(text) // 4) if text else 0


def window_bounds(times: list[float], texts: list[str | None], gap: float = 1800, most: int = 512, overlap: int = 3, begin: int = 1) -> list[tuple[int, int, int]]:
    """(first, end, opener) of the windows of messages in order: ``opener`` is the message that began it, before which come those carried over.

    The ``begin`` first messages are an open window as it was carried over with its opener: they do not close it.
    """
    total = [0, *accumulate(estimate(text) for text in texts)]
    first, opener, bounds = 0, 0, []
    for at in range(max(1, begin), len(times)):
        apart = times[at] - times[at - 1] > gap
        if apart or total[at + 1] - total[first] >= most:
            bounds.append((first, at, opener))
            first, opener = at if apart else max(first, at - max(0, overlap)), at
    return [b for b in [*bounds, (first, len(times), opener)] if b[0] < b[1]]


def split_windows(times: list[float], texts: list[str | None], gap: float = 1800, most: int = 512, overlap: int = 3) -> list[list[int]]:
    """Positions of the messages in each window: a longer gap closes one; so does reaching ``most`` tokens, and then the next begins with the last ``overlap`` messages."""
    order = sorted(range(len(times)), key=times.__getitem__)
    found = window_bounds([times[k] for k in order], [texts[k] for k in order], gap, most, overlap)
    return [order[s:e] for s, e, _ in found]
