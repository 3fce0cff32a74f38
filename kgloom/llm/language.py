"""Language by compression: zstandard with a raw-content dictionary for each language; the smallest result wins.

A dictionary is text of one language from a bounded sample of learning rows (``SAMPLE_ROWS`` for each language, lowest id
hashes first, ``DICTIONARY_BYTES`` in all). Every language that occurs is learned: where there are more than 128, they share ``ALL_BYTES`` evenly, with fewer
rows each, so all dictionaries together are at most 24 MB. Encoders are held for ``GROUP`` languages at a time; a text keeps its two least totals from group to group. A text is encoded in blocks of ``BLOCK`` bytes, each by itself, so that a
long text cannot teach the encoder its language and every dictionary works alike at any length. All blocks of the whole
text count. Texts and dictionaries are lower-cased and freed of ASCII digits and punctuation first. The score is the margin of the smallest total over the next, as a share of the next (0 to 1). A text whose margin
is under ``MARGIN`` is rejected; its nearest language is reported beside the flag.

Defined cases: a null text, or one without any letter, is ``und`` with score 0 and rejected; rows without lang are not learned
from; one learned language wins with score 0 and isn't rejected; with none every text is ``und``; ties go to the language first
by code point; repeated rows are classified alike. lang, source and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, crc_of_id

SAMPLE_ROWS, DICTIONARY_BYTES, ALL_BYTES, GROUP, BLOCK, LEVEL, MARGIN = 256, 192 << 10, 24 << 20, 64, 2048, 6, 0.002
HELD_OUT_FOLD, FOLDS = 0, 5
UNKNOWN = "und"
_DROPPED = bytes(c for c in range(33, 127) if not chr(c).isalpha())
SCHEMA = "doc_id long, lang_pred string, score double, rejected boolean"


def letters(text: str) -> bytes:
    """Lower-case UTF-8 without ASCII digits and punctuation."""
    return text.lower().encode().translate(None, _DROPPED)


def learn_dictionaries(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = DICTIONARY_BYTES, every: int = ALL_BYTES) -> dict[str, bytes]:
    """Raw dictionary content for each language. At most ``rows`` texts a language, each cut to its share of twice ``size``, reach the driver; ``every`` bounds all dictionaries together."""
    learn = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(crc_of_id(), F.lit(FOLDS)) != HELD_OUT_FOLD))
    # the lowest hashes of each language, gathered before any shuffle: a bounded buffer for each language and task
    key = F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id"))
    ids = learn.groupBy("lang", (F.xxhash64("doc_id") % 4096).alias("salt")).agg(F.min(key).alias("k"))
    of_language = Stored(ids.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list("k")), 1, rows).alias("ks")), "languages")
    languages = max(1, of_language.df.count())
    size = max(1, min(size, every // languages))
    rows = max(1, min(rows, size // 512))
    part = F.substring("text", 1, max(1, 2 * size // rows))  # of a sample row for learning only: predictions read whole texts
    chosen = of_language.df.select("lang", F.explode(F.slice("ks.doc_id", 1, rows)).alias("doc_id"))  # at most every / 512 pairs, or one a language
    texts = learn.select("doc_id", "lang", part.alias("part")).join(F.broadcast(chosen) if languages * rows <= every // 512 else chosen, ["doc_id", "lang"])
    got: dict[str, list] = {}
    for row in texts.distinct().collect():  # languages * rows parts of texts
        got.setdefault(row["lang"], []).append((row["doc_id"], row["part"]))
    of_language.drop()
    return {lang: letters("\n".join(t for _, t in sorted(parts)))[:size] for lang, parts in sorted(got.items())}


@lru_cache(maxsize=4)
def _encoders(dictionaries: tuple[tuple[str, bytes], ...]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, content in dictionaries:
        # under eight bytes a raw dictionary cannot be loaded
        learned = zstandard.ZstdCompressionDict(content.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        learned.precompute_compress(level=LEVEL)
        out.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=learned, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def classify_all(texts: list[str | None], dictionaries: tuple[tuple[str, bytes], ...], margin: float = MARGIN) -> list[tuple[str, float, bool]]:
    """The language of each text, the score and whether it is rejected."""
    raws = [letters(t) if t and any(c.isalpha() for c in t) else None for t in texts]
    least: list[list[tuple[int, str]]] = [[] for _ in texts]
    for first in range(0, len(dictionaries), GROUP):
        encoders = _encoders(dictionaries[first : first + GROUP])
        for k, raw in enumerate(raws):
            if raw is not None:
                blocks = [raw[at : at + BLOCK] for at in range(0, len(raw), BLOCK)]
                least[k] = sorted([*least[k], *((sum(len(encoder.compress(b)) for b in blocks), lang) for lang, encoder in encoders)])[:2]
    out = []
    for two in least:
        if not two:
            out.append((UNKNOWN, 0.0, True))
        elif len(two) == 1:
            out.append((two[0][1], 0.0, False))
        else:
            score = (two[1][0] - two[0][0]) / max(1, two[1][0])
            out.append((two[0][1], score, score < margin))
    return out


def classify(text: str | None, dictionaries: tuple[tuple[str, bytes], ...], margin: float = MARGIN) -> tuple[str, float, bool]:
    return classify_all([text], dictionaries, margin)[0]


def identify_languages(docs: DataFrame, dictionaries: dict[str, bytes] | None = None) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every document; dictionaries are learned from ``docs`` when not given."""
    content = tuple(sorted((learn_dictionaries(docs) if dictionaries is None else dictionaries).items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score, rejected = zip(*classify_all(batch.column("text").to_pylist(), content)) if batch.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def keep_identified(docs: DataFrame, dictionaries: dict[str, bytes] | None = None) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns. The text is classified where the row is: nothing is joined."""
    content = tuple(sorted((learn_dictionaries(docs) if dictionaries is None else dictionaries).items()))
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not rejected for _, _, rejected in classify_all(batch.column(text_at).to_pylist(), content)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
