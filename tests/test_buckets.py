"""Bucketed tables, ingest into them, and component labels kept batch by batch."""

import random
from datetime import datetime, timedelta

import pytest

from kgloom.streaming import buckets, ingest, labels

EVENT = "source_id string, source_type string, operation string, text string, enqueued_at timestamp"
PAIR = "a string, b string"


def batch(spark, rows, day=0):
    return spark.createDataFrame([(i, "files", op, text, datetime(2026, 1, 1) + timedelta(days=day, seconds=k)) for k, (i, op, text) in enumerate(rows)], EVENT)


def contents(store, names=tuple(ingest.TABLES)):
    return {n: sorted(map(str, store.read(n).collect())) for n in names}


FIRST = [(f"d{k}", "created", f"text {k} of u{k % 5}@x.org") for k in range(40)] + [("d1", "modified", "refers to gmail://m/message/1")]
SECOND = [("d0", "deleted", None), ("d3", "modified", "now v@y.org"), ("d4", "created", "text 4 of u4@x.org"), ("new", "created", None), (None, "created", "no id z@z.org")]


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    """The plain store after both batches, and the folder of a bucketed one after the first."""
    root = tmp_path_factory.mktemp("stores")
    plain = ingest.Store(spark, f"file://{root}/plain")
    for k, rows in enumerate((FIRST, SECOND)):
        ingest.apply_batch(plain, batch(spark, rows, k))
    store = buckets.graph_store(spark, f"file://{root}/buckets", 16)
    buckets.apply_batch(store, batch(spark, FIRST))
    return contents(plain), root / "buckets"


def test_a_dead_batch_leaves_all_as_it_was_and_may_run_again(spark, filled, monkeypatch):
    want, folder = filled
    path = f"file://{folder}"
    before = contents(buckets.graph_store(spark, path, 99))  # the number of buckets is the first write's

    class Dying:
        def __init__(self, fs, step):
            self.fs, self.step = fs, step

        def __getattr__(self, name):
            if name == self.step:
                raise KeyboardInterrupt(name)
            return getattr(self.fs, name)

    for step in ("listStatus", "create", "rename"):
        store = buckets.graph_store(spark, path)
        heads, names = store._heads(), store._names()
        store._heads, store._names = lambda heads=heads: heads, lambda head=None, names=names: names
        store._fs = Dying(store._fs, step)
        with pytest.raises(KeyboardInterrupt):
            buckets.apply_batch(store, batch(spark, SECOND, 1))
        assert contents(buckets.graph_store(spark, path)) == before
    store = buckets.graph_store(spark, path)
    assert store.buckets == 16
    old = {b: p for b, p in store._parts("chunks").items()}
    buckets.apply_batch(store, batch(spark, SECOND, 1))
    assert contents(store) == want
    # of the sixteen buckets of chunks those of d0, d3 and new were written
    moved = {b for b, p in store._parts("chunks").items() if old.get(b) != p} | (set(old) - set(store._parts("chunks")))
    assert 0 < len(moved) <= 3
    buckets.apply_batch(store, batch(spark, SECOND, 1))
    assert contents(store) == want
    buckets.apply_batch(store, batch(spark, []))
    assert contents(store) == want
    # nothing is left but what the last two heads name
    heads = store._heads()
    named = set().union(*(store._named(store._names(h)) for h in heads))
    found = {f"{v.name}/{p.name}" for v in folder.iterdir() if v.is_dir() for p in v.iterdir() if p.name.startswith("_bucket=")}
    assert len(heads) == 2 and found == named


def test_edges_into_a_deleted_document_go(spark, tmp_path):
    one, two = ingest.Store(spark, f"file://{tmp_path}/a"), buckets.graph_store(spark, f"file://{tmp_path}/b", 8)
    for rows in ([("gmail://m/message/1", "created", "a mail"), ("n", "created", "see gmail://m/message/1")], [("gmail://m/message/1", "deleted", None)]):
        ingest.apply_batch(one, batch(spark, rows))
        buckets.apply_batch(two, batch(spark, rows))
    assert two.read("edges").count() == 0 and contents(two) == contents(one)


def test_appended_buckets_are_made_one(spark, tmp_path):
    store = buckets.BucketStore(spark, f"file://{tmp_path}/s", {"t": "k string, v int"}, {"t": "k"}, 2)
    row = spark.createDataFrame([("x", 1)], "k string, v int")
    for _ in range(buckets.MOST_PARTS):
        store.commit({}, {"t": row})
    assert store.read("t").count() == buckets.MOST_PARTS
    store.commit({}, {"t": row})
    assert store.read("t").count() == 1 and max(map(len, store._parts("t").values())) == 1
    store.upsert("t", spark.createDataFrame([("x", 2), ("y", 3)], "k string, v int"), ["k"])
    assert sorted(map(tuple, store.read("t").collect())) == [("x", 2), ("y", 3)]
    with pytest.raises(ValueError):
        store.commit({"t": (row, {0, 1} - store.touched(row, "k"))})


def brute(ids, pairs):
    label = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_labels_equal_a_full_run_after_adds_splits_and_blocks(spark, tmp_path):
    rng = random.Random(3)
    kept = labels.Labels(spark, f"file://{tmp_path}/l", 8)
    pairs, blocked, ids = set(), set(), set()
    name = lambda: f"p{rng.randrange(60):02d}"
    for step in ("add", "add", "remove", "block", "add"):
        if step == "add":
            new = {(name(), name()) for _ in range(22)} | {(a, b) for a, b in list(blocked)[:2]}
            kept.add(spark.createDataFrame(sorted(new) + [(None, "p01"), ("p02", "p02")], PAIR))
            fresh = {tuple(sorted(p)) for p in new if p[0] != p[1]} - blocked
            pairs |= fresh
            ids |= {i for p in fresh for i in p}
        else:
            gone = set(rng.sample(sorted(pairs), 6))
            kept.remove(spark.createDataFrame([(b, a) for a, b in gone] + [("p98", "p99")], PAIR), block=step == "block")
            pairs -= gone
            blocked |= gone if step == "block" else set()
        assert {r.id: r.component for r in kept.table().collect()} == brute(ids, pairs)
    assert {(r.id, r.component) for r in kept.store.read("members").collect()} == set(brute(ids, pairs).items())
    kept.add(spark.createDataFrame([], PAIR))
    assert kept.table().count() == len(ids)


def test_a_batch_stores_only_texts_that_are_read_again(spark, tmp_path, monkeypatch):
    import contextlib

    from kgloom.streaming import buckets

    stored, kept = [], buckets.staged

    @contextlib.contextmanager
    def watched(session):
        with kept(session) as put:

            def seen(df, label="step"):
                table = put(df, label)
                if "text" in table.columns:
                    stored.append((label, sorted((r.source_id, r.text) for r in table.select("source_id", "text").where("text IS NOT NULL").collect())))
                return table

            yield seen

    monkeypatch.setattr(buckets, "staged", watched)
    store = buckets.graph_store(spark, str(tmp_path / "store"), 4)
    frame = lambda rows: spark.createDataFrame(rows, "source_id string, source_type string, operation string, text string, enqueued_at string").selectExpr("source_id", "source_type", "operation", "text", "cast(enqueued_at AS timestamp) AS enqueued_at")
    buckets.apply_batch(store, frame([(k, "files", "created", f"text {k}", "2026-01-01") for k in "abc"]))
    stored.clear()
    buckets.apply_batch(store, frame([("a", "files", "modified", "text a", "2026-01-02"), ("b", "files", "modified", "other", "2026-01-02"), ("c", "files", "deleted", "text c", "2026-01-02")]))
    assert stored == [("batch", [("b", "other")]), ("chunks", [("b", "other")])]
    assert sorted((r.source_id, str(r.indexed_at)[:10]) for r in store.read("nodes").collect()) == [("a", "2026-01-02"), ("b", "2026-01-02")]
    assert [(r.source_id, r.text) for r in store.read("chunks").orderBy("source_id").collect()] == [("a", "text a"), ("b", "other")]
