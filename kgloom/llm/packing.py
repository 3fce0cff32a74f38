"""Packing token ids into sequences: first-fit decreasing with a tournament tree of bin capacities, in randomised groups.

A document is its token ids and then the end id. It is cut into pieces of ``SEQUENCE`` ids and a rest. Pieces are dealt by a hash of document and start
to groups of about ``GROUP`` pieces; each group is packed by itself, largest piece first, each into the first open bin that has room. The
tree's leaves are the bins' free space and each node holds the larger of its children, so that bin is found by one descent.

Ids are those of the tokenizer file (``tokenizers``); the same vocabulary as ranks is encoded by ``tiktoken``, which gives the same ids several times
faster. A text that spells a special token goes to ``tokenizers`` itself.

Defined cases: null and empty texts are the end id alone; a text of any length is cut into as many pieces as it needs; repeated rows are packed
as often as they occur, numbered so that many of them share no group; ties in length go by document and start; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored
from .mixing import numbered_repeats

SEQUENCE, END_ID, GROUP, SEED = 2048, 1, 4096, 29
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
SCHEMA = PIECES + ", sequence_id long, offset long"


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies; another path is passed through."""
    import public_tokenizers

    return name if "/" in name else public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _encoder(tokenizer: str, ranks: str | None):
    """A function from text to ids as unsigned 32-bit numbers."""
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer_file(tokenizer))
    special = [t.content for t in exact.get_added_tokens_decoder().values()]
    by_rules = lambda text: np.array(exact.encode(text, add_special_tokens=False).ids, dtype="<u4")
    if ranks is None:
        return by_rules
    import public_tokenizers
    import tiktoken

    with open(tokenizer_file(ranks), "rb") as lines:
        merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
    return lambda text: by_rules(text) if any(s in text for s in special) else np.array(fast.encode_ordinary(text), dtype="<u4")


def token_ids(text: str | None, tokenizer: str = TOKENIZER, ranks: str | None = RANKS) -> np.ndarray:
    return np.append(_encoder(tokenizer, ranks)(text or ""), np.uint32(END_ID)).astype("<u4")


def cut(ids: np.ndarray, size: int = SEQUENCE) -> list[tuple[int, int, int]]:
    """start, length and CRC-32 of each piece."""
    return [(k, len(part := ids[k : k + size]), zlib.crc32(part.tobytes())) for k in range(0, len(ids), size)]


class Tournament:
    """First-fit bins. ``put`` gives the first bin with room and where its free space begins."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, math.ceil(math.log2(max(1, most))))
        self.room, self.capacity = [capacity] * (2 * self.leaves), capacity

    def put(self, size: int) -> tuple[int, int]:
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < size:
                k += 1
        at, offset = k - self.leaves, self.capacity - room[k]
        room[k] -= size
        while k > 1:
            k //= 2
            room[k] = max(room[2 * k], room[2 * k + 1])
        return at, offset


def first_fit_decreasing(lengths: list[int], capacity: int = SEQUENCE) -> list[tuple[int, int]]:
    """Bin and offset of each length; lengths come largest first."""
    tree = Tournament(len(lengths), capacity)
    return [tree.put(n) for n in lengths]


def _pack_group(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
    placed = first_fit_decreasing(group["length"].tolist())
    group["sequence_id"] = (np.int64(group["part"].iloc[0]) << 32) + np.array([p[0] for p in placed], dtype=np.int64)
    group["offset"] = np.array([p[1] for p in placed], dtype=np.int64)
    return group.drop(columns=["part", "again"])


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str | None = RANKS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = token_ids(text.as_py(), tokenizer, ranks)
                rows += [(doc_id, *piece, len(ids)) for piece in cut(ids)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, group: int = GROUP) -> DataFrame:
    """The columns of ``SCHEMA``: a row for each piece, with its sequence and its place there."""
    cut_up = numbered_repeats(Stored(pieces(docs, tokenizer, ranks), "pieces").df, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
    groups = max(1, math.ceil(cut_up.count() / group))
    dealt = cut_up.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "again", F.lit(SEED)), F.lit(groups)))
    return dealt.groupBy("part").applyInPandas(_pack_group, SCHEMA)
