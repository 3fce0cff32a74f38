"""Snapshots, feeds, parsers, ingest and streams."""

import base64
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kgloom.operators import clustering
from kgloom.sources import feeds, parsers, snapshots
from kgloom.streaming import ingest, sessions


def test_file_diff(spark):
    now = [("/a", "h1", 1, 10), ("/b", "h2", 2, 10), ("/c", "", 3, 10), ("/new", "h", 1, 1)]
    old = [("/a", "h1", 1, 99), ("/b", "hx", 2, 10), ("/c", "", 4, 10), ("/gone", "h", 1, 1)]
    make = lambda rows: spark.createDataFrame(rows, "path string, sha256 string, mtime_ns long, size long")
    got = {r.path: r.operation for r in snapshots.file_changes(make(now), make(old)).collect()}
    assert got == {"/b": "modified", "/c": "modified", "/new": "created", "/gone": "deleted"}


def test_task_diff_ignores_tag_order(spark):
    make = lambda tags, name: spark.createDataFrame([("t", name, tags)], "source_id string, name string, tags array<string>")
    assert snapshots.task_changes(make(["a", "b"], "n"), make(["b", "a"], "n"), ("name",)).count() == 0
    assert snapshots.task_changes(make(["a"], "n"), make(["a"], "m"), ("name",)).first().operation == "modified"


def test_scan(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.md").write_text("hello")
    (tmp_path / ".obsidian").mkdir()
    (tmp_path / ".obsidian" / "b.md").write_text("no")
    (tmp_path / "big.md").write_text("y" * 100)
    got = {r.path.rsplit("/", 1)[1]: r.sha256 for r in snapshots.scan_files(spark, str(tmp_path), "*.md", max_bytes=50).collect()}
    assert got["big.md"] == "" and len(got["a.md"]) == 64
    assert "b.md" not in {r.path.rsplit("/", 1)[1] for r in snapshots.scan_vault(spark, str(tmp_path)).collect()}


def test_feeds(spark, tmp_path):
    feeds.register(spark)
    body = lambda s: base64.urlsafe_b64encode(s.encode()).decode()
    headers = [{"name": "Subject", "value": "Hi"}, {"name": "From", "value": "Ann <Ann@GoogleMail.com>"}, {"name": "To", "value": "b@x.org, C <c@x.org>"}]
    parts = [{"mimeType": "multipart/alternative", "parts": [{"mimeType": "text/html", "body": {"data": body("<p>h</p>")}}, {"mimeType": "text/plain", "body": {"data": body("see d@x.org")}}]}, {"mimeType": "application/pdf", "filename": "a.pdf", "body": {"size": 5}}]
    (tmp_path / "0.json").write_text(json.dumps({"id": "m1", "threadId": "t1", "historyId": "9", "payload": {"mimeType": "multipart/mixed", "headers": headers, "parts": parts}}))
    items = spark.read.format("paged_feed").option("path", str(tmp_path)).load()
    mail = feeds.mail_messages(items, "me")
    row = mail.first()
    assert (row.source_id, row.plain, row.html, row.history_id, row.attachments[0].name) == ("gmail://me/message/m1", "see d@x.org", "<p>h</p>", 9, "a.pdf")
    edges = {(r.src_id, r.rel, r.dst_id) for r in parsers.parse("gmail", mail).collect()}
    me = "gmail://me/message/m1"
    assert {("person:ann@gmail.com", "SENT", me), (me, "TO", "person:b@x.org"), (me, "TO", "person:c@x.org"), (me, "MENTIONS", "person:d@x.org"), (me, "PART_OF", "gmail://me/thread/t1"), (me + "/attachment/a.pdf", "ATTACHED_TO", me)} == edges


def test_calendar(spark):
    item = {"id": "e1", "status": "confirmed", "summary": "S", "start": {"dateTime": "2026-04-27T10:00:00Z"}, "end": {"date": "2026-04-28"}, "organizer": {"email": "O@x.org"}, "creator": {"email": "c@x.org"}, "attendees": [{"email": "me@x.org", "self": True}, {"email": "a@x.org"}], "recurringEventId": "r1"}
    gone = {"id": "e2", "status": "cancelled"}
    events = feeds.calendar_events(spark.createDataFrame([(json.dumps(i),) for i in (item, gone)], "item string"), "me")
    assert {r.source_id[-2:]: r.operation for r in events.collect()} == {"e1": "created", "e2": "deleted"}
    edges = {(r.src_id.rsplit("/", 2)[-2] + "/" + r.src_id.rsplit("/", 1)[-1], r.rel, r.dst_id) for r in parsers.parse("google_calendar", events).collect()}
    assert edges == {("event/e1", "INSTANCE_OF", "google-calendar://me/series/r1"), ("series/r1", "ORGANIZED_BY", "person:o@x.org"), ("series/r1", "ATTENDED_BY", "person:a@x.org"), ("series/r1", "CREATED_BY", "person:c@x.org")}


def test_chat(spark):
    msgs = [("1.0", "U1", None, "hi <@U2> at a@x.org"), ("2.0", "U3", "channel_join", "joined"), ("3.0", "U4", "bot_message", " ")]
    df = spark.createDataFrame([("slack://T/C/window/1-3", "T", "C", msgs)], "source_id string, team_id string, channel_id string, messages array<struct<ts:string,user:string,subtype:string,text:string>>")
    edges = {(r.rel, r.dst_id) for r in parsers.parse("slack", df).collect()}
    assert edges == {("SENT_BY", "slack-user:T/U1"), ("MENTIONS", "slack-user:T/U2"), ("IN_CHANNEL", "slack://T/C"), ("MENTIONS", "person:a@x.org")}


def test_notes_tasks_commits_apps(spark):
    note = spark.createDataFrame([("/v/n.md", "/v", "---\ntitle: x\n---\nSee [[Other Note|o]] #tag `#code` mail a@x.org ![[pic.png]]")], "source_id string, vault string, text string")
    edges = {(r.rel, r.dst_id) for r in parsers.parse("obsidian", note).collect()}
    assert edges == {("LINKS_TO", "/v/Other Note.md"), ("TAGGED_BY_USER", "tag"), ("MENTIONS", "person:a@x.org")}
    assert note.select(parsers.embeds(F.col("text")).alias("e")).first().e == ["pic.png"]
    task = spark.createDataFrame([("t", "Ask @Bob", "b@x.org", ["People/Ann", "x"], "P", None)], "source_id string, name string, note string, tags array<string>, project string, parent string")
    got = {(r.rel, r.dst_id, r.confidence) for r in parsers.parse("omnifocus", task).collect()}
    assert {("MENTIONS", "name:Bob", 0.9), ("MENTIONS", "name:Ann", 0.95), ("MENTIONS", "person:b@x.org", 1.0), ("IN_PROJECT", "P", 1.0), ("TAGGED", "x", 1.0)} <= got
    commit = spark.createDataFrame([("c", "A@x.org", "/r", ["f.py"])], "source_id string, author_email string, repository string, changed_files array<string>")
    assert {(r.src_id, r.rel, r.dst_id) for r in parsers.parse("repositories", commit).collect()} == {("person:a@x.org", "AUTHORED", "c"), ("c", "PART_OF", "/r"), ("c", "MODIFIED", "/r/f.py")}
    app = spark.createDataFrame([("a", "Dev", ["git"], "brew")], "source_id string, category string, binaries array<string>, installed_via string")
    assert parsers.parse("apps", app).count() == 3


def test_manifests():
    deps = parsers.manifest_dependencies
    assert deps("x/Cargo.toml", '[dependencies]\nserde = "1"\ntokio = { version = "2" }\n[dev-dependencies]\nt = "3"') == [("serde", "1", "runtime", "cargo"), ("tokio", "2", "runtime", "cargo"), ("t", "3", "dev", "cargo")]
    assert deps("pyproject.toml", '[project]\ndependencies = ["a>=1; python_version>\'3\'", "b[x]==2"]') == [("a", ">=1", "runtime", "pypi"), ("b", "==2", "runtime", "pypi")]
    assert deps("package.json", '{"dependencies": {"l": "^4"}}') == [("l", "^4", "runtime", "npm")] and deps("package.json", "{") == []
    assert deps("go.mod", "module m\nrequire (\n\ta/b v1.0.0\n\tc/d v2.0.0 // indirect\n)\nrequire e/f v3.0.0") == [("a/b", "v1.0.0", "runtime", "go"), ("c/d", "v2.0.0", "indirect", "go"), ("e/f", "v3.0.0", "runtime", "go")]
    assert deps("p.csproj", '<PackageReference Include="N" Version="1.2" />') == [("N", "1.2", "runtime", "nuget")] and deps("packages.config", '<package id="M" version="3" />') == [("M", "3", "runtime", "nuget")]


def test_sessions_on_a_stream_match_the_batch(spark, tmp_path):
    at = datetime(2026, 1, 1)
    rows = [(u, at + timedelta(seconds=s), "x" * 8) for u in (1, 2) for s in (0, 100, 1899, 5000, 5001)]
    spark.createDataFrame(rows, "user long, ts timestamp, text string").write.parquet(str(tmp_path / "in"))
    flush = [(9, at + timedelta(days=9), "")]
    spark.createDataFrame(flush, "user long, ts timestamp, text string").write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = sessions.stream_sessions(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), "user")
    q = stream.writeStream.outputMode("append").format("memory").queryName("sess").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.user, r.first_ts, r.messages) for r in spark.table("sess").collect()}
    want = {(r.user, r.first_ts, r.messages) for r in sessions.sessions(batch, "user").collect() if r.user != 9}
    assert got == want and len(want) == 4


EVENT = "source_id string, source_type string, operation string, text string, enqueued_at timestamp"


def events(rows):
    return [(i, "files", op, text, datetime(2026, 1, 1) + timedelta(seconds=k)) for k, (i, op, text) in enumerate(rows)]


FIRST = [("a", "created", "mail x@y.org. " + "word " * 20), ("b", "created", "b text"), ("a", "modified", "now z@y.org")]
SECOND = [("b", "deleted", None), ("a", "created", "now z@y.org"), ("c", "created", "c text gmail://m/message/1")]


def snapshot(store):
    return {name: sorted(map(str, store.read(name).drop("indexed_at").collect())) for name in ingest.TABLES}


def test_ingest_in_batches_gives_the_same_tables(spark, tmp_path):
    for name, parts in (("one", [FIRST + SECOND]), ("two", [FIRST, SECOND]), ("again", [FIRST, SECOND, SECOND])):
        (tmp_path / name).mkdir()
        store = ingest.Store(spark, str(tmp_path / name))
        k = 0
        for part in parts:
            ingest.apply_batch(store, spark.createDataFrame([(*e[:4], e[4] + timedelta(days=k)) for e in events(part)], EVENT))
            k += 1
        if name == "one":
            want = snapshot(store)
        else:
            assert snapshot(store) == want
    ids = {r.source_id for r in ingest.Store(spark, str(tmp_path / "two")).read("nodes").collect()}
    rels = {(r.src_id, r.rel, r.dst_id) for r in ingest.Store(spark, str(tmp_path / "two")).read("edges").collect()}
    assert ids == {"a", "c"} and rels == {("a", "MENTIONS", "person:z@y.org"), ("c", "REFERENCES", "gmail://m/message/1")}


def test_ingest_from_a_stream(spark, tmp_path):
    spark.createDataFrame(events(FIRST), EVENT).write.parquet(str(tmp_path / "in"))
    (tmp_path / "store").mkdir()
    store = ingest.Store(spark, str(tmp_path / "store"))
    ingest.start(spark.readStream.schema(EVENT).parquet(str(tmp_path / "in")), store, str(tmp_path / "cp")).awaitTermination(120)
    assert {r.source_id for r in store.read("nodes").collect()} == {"a", "b"} and store.read("vectors").count() == 2


def test_clusters_of_separable_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    centres = rng.normal(0, 10, (3, 48))
    rows = [(k, (centres[k % 3] + rng.normal(0, 0.1, 48)).tolist()) for k in range(90)]
    df = spark.createDataFrame(rows, "id long, vector array<float>")
    found = {r.id: r.cluster for r in clustering.cluster_embeddings(df, k=3).collect()}
    assert len({found[0], found[1], found[2]}) == 3 and all(found[k] == found[k % 3] for k in range(90))
    assert clustering.cluster_embeddings(df.limit(5)).count() == 0


def test_mail_parts_at_any_depth(spark):
    import base64
    import json

    encoded = lambda s: base64.urlsafe_b64encode(s.encode()).decode()
    leaf = {"mimeType": "text/plain", "body": {"data": encoded("deep ünder")}}
    for kind in ("multipart/alternative", "multipart/related", "multipart/mixed", "multipart/mixed"):
        leaf = {"mimeType": kind, "body": {}, "parts": [leaf, {"mimeType": "application/pdf", "filename": f"{kind[10:]}.pdf", "body": {"size": 9}}]}
    item = json.dumps({"id": "m", "threadId": "t", "historyId": "5", "payload": {**leaf, "headers": [{"name": "Subject", "value": "s"}]}})
    row = feeds.mail_messages(spark.createDataFrame([(item,), (json.dumps({"id": "n"}),)], "item string"), "a").orderBy("source_id").collect()
    assert row[0].plain == "deep ünder" and {a.name for a in row[0].attachments} == {"alternative.pdf", "related.pdf", "mixed.pdf"} and row[0].subject == "s"
    assert row[1].plain is None and row[1].attachments == []


def test_store_keeps_its_tables_when_a_write_dies(spark, tmp_path, monkeypatch):
    store = ingest.Store(spark, f"file://{tmp_path}/store")
    rows = lambda n: spark.createDataFrame([(f"c{k}", "d", k, "t") for k in range(n)], ingest.TABLES["chunks"])
    store.write(chunks=rows(2))

    class Dying:
        """A file system that fails at the step named."""

        def __init__(self, fs, step):
            self.fs, self.step = fs, step

        def __getattr__(self, name):
            if name == self.step:
                raise KeyboardInterrupt(name)
            return getattr(self.fs, name)

    for step in ("create", "rename", "delete"):
        broken = ingest.Store(spark, f"file://{tmp_path}/store")
        broken._fs = Dying(broken._fs, step)
        with pytest.raises(KeyboardInterrupt):
            broken.write(chunks=rows(7))
            broken.write(chunks=rows(7))
            broken.write(chunks=rows(7))
        assert store.read("chunks").count() == (7 if step == "delete" else 2)
    store.write(chunks=rows(3))
    store.write(chunks=rows(4))
    assert store.read("chunks").count() == 4 and len([p for p in (tmp_path / "store").iterdir() if p.name.startswith("chunks")]) == 2
