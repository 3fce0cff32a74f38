"""The pipeline's stages against brute force, and its columns."""

from collections import Counter

import corpus_pipeline
from kgloom.llm import language, mixing, packing, queries, simhash

from .test_documents import brute_components, brute_fingerprint, brute_lines, sentences


def documents(rng):
    rows = []
    for k in range(160):
        lang = ("en", "de", "fr")[k % 3]
        text = "\n".join(sentences(lang, 12, rng) for _ in range(rng.randrange(1, 6)))
        rows.append((k, text, lang, "s%d" % (k % 4)))
    rows += [(200, rows[0][1], "en", "s0"), (201, None, None, None), (202, "", "en", "s1"), (203, "!!! 12", "en", "s2"), (200, rows[0][1], "en", "s0")]
    return rows


def test_stages(spark, table, tmp_path):
    import random

    docs = table(documents(random.Random(31)))
    columns = docs.columns
    kept = corpus_pipeline.identify_language(spark, docs, "")
    rejected = {r.doc_id for r in language.identify_languages(docs).collect() if r.rejected}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - rejected and {201, 202, 203} <= rejected
    kept.write.parquet(str(tmp_path / "1"))
    kept = spark.read.parquet(str(tmp_path / "1"))

    lines = corpus_pipeline.remove_repeated_lines(spark, kept, "")
    want = brute_lines([(r.doc_id, r.text) for r in kept.collect()])
    assert lines.columns == columns and lines.schema == kept.schema
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert all(r.text == want[r.doc_id, texts[r.doc_id]] and r.n_chars == len(r.text) for r in lines.collect()) and lines.count() == kept.count()
    lines.write.parquet(str(tmp_path / "2"))
    lines = spark.read.parquet(str(tmp_path / "2"))

    single = corpus_pipeline.remove_near_duplicates(spark, lines, "")
    groups = brute_components({r.doc_id: brute_fingerprint(r.text) for r in lines.collect()})
    assert single.columns == columns and {r.doc_id for r in single.collect()} == set(groups.values())
    single.write.parquet(str(tmp_path / "3"))
    single = spark.read.parquet(str(tmp_path / "3"))

    mixed = corpus_pipeline.mix_sources(spark, single, "")
    copies = Counter()
    for r in mixing.mix(single).collect():
        copies[r.doc_id] += r.copies
    assert mixed.columns == columns and Counter(r.doc_id for r in mixed.collect()) == +copies
    mixed.write.parquet(str(tmp_path / "4"))
    mixed = spark.read.parquet(str(tmp_path / "4"))

    packed = corpus_pipeline.pack_sequences(spark, mixed, "")
    assert sum(r.length for r in packed.collect()) == sum(len(packing.token_ids(r.text)) for r in mixed.collect())


def test_run_on_a_table(spark, table, tmp_path):
    import random

    table(documents(random.Random(32))).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == [c.split()[0] for c in packing.SCHEMA.split(", ")]


def test_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 14)) and set(queries.ORACLE) <= set(queries.QUERIES)
    assert simhash.RADIUS == 2
