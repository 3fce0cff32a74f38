"""Person, itinerary, identity, writer and queue operators on two small graphs and tables."""

import random
from collections import defaultdict
from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from kgloom.operators import filters, graph, identity, queue as Q, writers
from kgloom.plans import people, search

NOW = datetime(2026, 4, 27, 12, tzinfo=timezone.utc)


def iso(days=0, hours=0):
    return (NOW - timedelta(days=days, hours=hours)).isoformat()


@pytest.fixture(scope="module")
def seed(spark):
    nodes, edges = [], []
    node = lambda label, i, **p: nodes.append((label, i, {k: str(v) for k, v in p.items()}))
    edge = lambda a, i, rel, b, j: edges.append((a, i, rel, b, j))
    for i, name in (("alice", "Alice"), ("alice.alt", "Alice A."), ("bob", "Bob"), ("carol", "Carol"), ("me", "Me")):
        node("Person", i, name=name, is_self=str(i == "me").lower())
    for i, days, subject in (("e1", 0, "Re: weekly sync"), ("e2", 1, "Project"), ("e3", 5, "Travel plans"), ("e4", 90, "Old thread")):
        node("Email", i, subject=subject, date=iso(days))
    node("CalendarEvent", "cal1", summary="Project kickoff", start_time=iso(0, 3))
    node("SlackMessage", "s1", channel_id="C1", channel_name="eng", first_ts="1777280000.000100", last_ts="1777280100.000100")
    for i, status, due, flagged in (("t1", "active", "2026-05-01", "true"), ("t2", "completed", "2026-05-01", "false"), ("t3", "dropped", "", "false"), ("t4", None, None, "false"), ("t5", "active", "2026-04-30", "false")):
        node("Task", i, name=f"task {i}", flagged=flagged, modification_date=iso(2), **{k: v for k, v in (("status", status), ("due_date", due)) if v})
    node("Project", "work", name="Work")
    node("Tag", "urgent", name="urgent")
    for i, days in (("a.md", 0), ("c.md", 1), ("b.md", 14)):
        node("File", i, title=i, modified_at=iso(days))
    for mail in ("e1", "e2", "e3"):
        edge("Person", "alice", "SENT", "Email", mail)
    edge("Email", "e4", "TO", "Person", "alice.alt")
    for mail in ("e1", "e2"):
        edge("Email", mail, "TO", "Person", "bob")
    edge("CalendarEvent", "cal1", "ATTENDED_BY", "Person", "alice")
    edge("CalendarEvent", "cal1", "ATTENDED_BY", "Person", "bob")
    edge("SlackMessage", "s1", "SENT_BY", "Person", "alice")
    edge("SlackMessage", "s1", "MENTIONS", "Person", "me")
    for t in ("t1", "t2", "t3", "t4", "t5"):
        edge("Task", t, "MENTIONS", "Person", "alice" if t != "t5" else "alice.alt")
    edge("Task", "t1", "IN_PROJECT", "Project", "work")
    edge("Task", "t1", "TAGGED", "Tag", "urgent")
    for f in ("a.md", "b.md", "c.md"):
        edge("File", f, "MENTIONS", "Person", "alice")
    for d, topic in (("e1", "Q2 planning"), ("e2", "Q2 planning"), ("cal1", "Q2 planning"), ("e3", "Travel")):
        edge("Email" if d[0] == "e" else "CalendarEvent", d, "TAGGED", "Topic", topic)
    edge("Person", "alice", "SAME_AS", "Person", "alice.alt")
    edge("Email", "e1", "PART_OF", "Thread", "th1")
    edge("Email", "e2", "PART_OF", "Thread", "th1")
    n = spark.createDataFrame(nodes, "label string, source_id string, props map<string,string>").cache()
    e = spark.createDataFrame(edges, "src_label string, src_id string, rel string, dst_label string, dst_id string").cache()
    return n, e, graph.cluster_of("alice", e.where("rel = 'SAME_AS'"))


def test_cluster(seed):
    assert sorted(r.source_id for r in seed[2].collect()) == ["alice", "alice.alt"]


def test_profile(seed):
    nodes, edges, cluster = seed
    p = people.profile(cluster, nodes, edges, NOW - timedelta(hours=36))
    titles = [r.title for r in p["recent_interactions"].collect()]
    assert "Re: weekly sync" in titles and "Project kickoff" in titles and "Travel plans" not in titles and "Old thread" not in titles
    assert [(r.topic_name, r.doc_count) for r in p["top_topics"].collect()] == [("Q2 planning", 3), ("Travel", 1)]
    related = {r.other_id: r.shared_count for r in p["related_people"].collect()}
    assert related["bob"] == 3 and "alice.alt" not in related and related["me"] == 1
    tasks = p["open_tasks"].collect()
    assert [(t.task_id, t.project, t.tags, t.flagged) for t in tasks] == [("t1", "Work", ["urgent"], True), ("t5", None, None, False), ("t4", None, None, False)]
    assert [r.source_id for r in p["files"].collect()] == ["a.md", "c.md", "b.md"]
    assert p["total"].first().total == 14


def test_brief_sections(seed, spark):
    nodes, edges, cluster = seed
    threads = people.outstanding_threads(cluster, nodes, edges, NOW - timedelta(days=30)).collect()
    assert [(t.thread, t.subject) for t in threads] == [("th1", "Re: weekly sync")]
    me = spark.createDataFrame([("me",)], "source_id string")
    assert [r.source_id for r in people.unanswered_mentions(cluster, nodes, edges, me).collect()] == ["s1"]
    assert people.source_count(cluster, nodes, edges).first().sources == 5


def test_itinerary(seed, spark):
    nodes, edges, _ = seed
    members = graph.components(edges.where("rel = 'SAME_AS'").select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")))
    day = people.itinerary(nodes, edges, members, date(2026, 4, 27))
    events = day["events"].collect()
    assert [(e.title, e.attendees, e.is_self_only) for e in events] == [("Project kickoff", ["alice", "bob"], False)]
    assert [t.source_id for t in day["tasks"].orderBy("rank").collect()] == ["t1", "t5", "t4"]
    assert [(t.kind, t.unit) for t in day["threads"].collect()] == [("email", "th1")]
    assert "task t1" in people.brief(day["events"], day["tasks"], day["threads"]).first().brief
    assert people.events_for_day(nodes, edges, date(2026, 4, 28)).count() == 0


# --- graph algorithms against brute force


def test_components_and_closure(spark):
    rng = random.Random(3)
    pairs = sorted({tuple(sorted((rng.randrange(60), rng.randrange(60)))) for _ in range(45)})
    root = {k: k for p in pairs for k in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(pairs, "a long, b long")
    loops = {a for a, b in pairs if a == b} - {k for a, b in pairs if a != b for k in (a, b)}
    assert {r.id: r.component for r in graph.components(df).collect()} == {k: find(k) for k in root if k not in loops}
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    want = set()
    for a in near:
        reach = {a: 0}
        level = {a}
        for n in range(1, 5):
            level = {c for b in level for c in near[b]} - reach.keys()
            reach |= {c: n for c in level}
        want |= {(a, b) for b, n in reach.items() if a < b and n > 1}
    never = spark.createDataFrame([next(iter(sorted(want)))[::-1]], "a long, b long")
    assert {(r.a, r.b) for r in graph.closure(df, never).collect()} == want - {next(iter(sorted(want)))}


def test_nearby(spark):
    rng = random.Random(4)
    at = lambda n: [(k, rng.uniform(-0.05, 0.05), rng.uniform(-0.05, 0.05)) for k in range(n)]
    a, b = at(80), at(60)
    got = graph.nearby(spark.createDataFrame(a, "id long, lat double, lon double"), spark.createDataFrame(b, "id long, lat double, lon double"))
    assert {(r.point, r.place) for r in got.collect()} == {(i, j) for i, x, y in a for j, u, v in b if abs(x - u) < 0.005 and abs(y - v) < 0.005}


# --- identity


def persons(spark):
    rows = [("p1", "Alice Johnson", "a@GoogleMail.com", None), ("p2", "Alice Johnso", "x@y.org", None), ("p3", "A", "a+z@gmail.com", "U1"), ("p4", "Bo", None, "U1"), ("p5", "Alice Johnson", None, None)]
    return spark.createDataFrame([(i, n, m, "T", u) for i, n, m, u in rows], "source_id string, name string, email string, team_id string, slack_user_id string")


def test_reconcile(spark):
    none = spark.createDataFrame([], "a string, b string")
    found = identity.reconcile(persons(spark), none, none).collect()
    kinds = defaultdict(set)
    for r in found:
        kinds[r.match_type].add((r.src_id, r.dst_id))
    assert kinds["email"] == {("p1", "p3")} and kinds["slack_user_id"] == {("p3", "p4")} and kinds["fuzzy_name"] == {("p1", "p2"), ("p1", "p5")}
    assert ("p2", "p5") in kinds["transitive_closure"] and ("p1", "p4") in kinds["transitive_closure"]
    blocked = identity.reconcile(persons(spark), none, spark.createDataFrame([("p3", "p1")], "a string, b string")).collect()
    assert ("p1", "p3") not in {(r.src_id, r.dst_id) for r in blocked}


def test_find_person(spark):
    find = lambda s: [r.source_id for r in identity.find_person(s, persons(spark)).collect()]
    assert sorted(find("A@gmail.com")) == ["p1", "p3"] and sorted(find("slack-user:T/U1")) == ["p3", "p4"] and find("johnson alice") == ["p1", "p5", "p2"] and find("Zed") == []


def test_cross_source_uses_each_once(spark):
    left = [("Ann", None), ("ann", None), ("Bert Q", "B@x.org"), ("Alice Johnson", None), ("Cy", "not an address")]
    right = [("ANN", None), ("Someone", "b@x.org"), ("Alice Johnso", None), ("Alice Johnsa", None), ("Dee", "not an address")]
    rows = [("k", n, m, source, pos) for source, people in (("s1", left), ("s2", right)) for pos, (n, m) in enumerate(people)] + [("other", "ANN", None, "s2", 0)]
    got = identity.cross_source(spark.createDataFrame(rows, "block string, name string, email string, source string, pos int"), "block").collect()
    assert {(r.entity_a, r.entity_b, r.confidence, r.match_type) for r in got} == {("Ann", "ANN", 1.0, "exact"), ("Bert Q", "Someone", 0.95, "email"), ("Alice Johnson", "Alice Johnso", 0.96, "fuzzy")} and len(got) == 3


def test_wishes_are_granted_in_turn():
    """A later left one's better wish waits; one whose wishes are all taken gets none."""
    wishes = [(0, 2, -90.0, 5), (0, 2, -95.0, 4), (1, 0, -100.0, 4), (1, 2, -91.0, 5), (2, 2, -99.0, 4)]
    assert [w[:1] + w[3:] for w in identity.in_turn(wishes)] == [(0, 4), (1, 5)]


def test_self_identity_makes_missing_persons(spark):
    people = spark.createDataFrame([("p2", "Me", "Me+work@googlemail.com"), ("p1", "M", "me@gmail.com"), ("p3", "You", "you@x.org")], "source_id string, name string, email string")
    everyone, edges = identity.self_identity(people, ["me+x@gmail.com", "other@x.org"], "My Name")
    assert {(r.source_id, r.name, r.is_self) for r in everyone.collect()} == {("p2", "Me", True), ("p1", "My Name", True), ("p3", "You", False), ("person:other@x.org", None, True)}
    assert {(r.src_id, r.dst_id) for r in edges.collect()} == {("p1", "p2"), ("p1", "person:other@x.org")}


def test_resolve_in_order(spark):
    known = [{"name": "Project Apollo", "type": "Project", "confidence": 0.96}, {"name": "Project Apolla", "type": "Concept", "confidence": 0.5}]
    got = identity.resolve_document([{"name": "PROJECT APOLLA", "type": "X"}, {"name": "Project Apollos", "type": None}, {"name": "New", "type": "Y"}], known)
    assert [(r["name"], r["merged_into"]) for r in got] == [("Project Apolla", "Project Apolla"), ("Project Apollo", "Project Apollo"), ("New", None)]
    e = spark.createDataFrame([("d", 0, "project apollos", None, 0.8), ("e", 0, "Other", "Z", 0.4)], "doc_id string, pos int, name string, type string, confidence double")
    k = spark.createDataFrame([(x["name"], x["type"], x["confidence"]) for x in known], "name string, type string, confidence double")
    assert {(r.doc_id, r.name) for r in identity.resolve_entities(e, k).collect()} == {("d", "Project Apollo"), ("e", "Other")}


def test_bridge(spark):
    entities = spark.createDataFrame([("entity:1", "Alice Johnson", "Person"), ("entity:2", "Alice Johnson", "Concept"), ("entity:3", "johnson alice", "Person")], "source_id string, name string, type string")
    assert {(r.src_id, r.dst_id) for r in identity.bridge_entities(entities, persons(spark)).collect()} == {("entity:1", "p1"), ("entity:3", "p1")}


def test_bridge_when_a_right_name_is_on_the_left_too(spark):
    entities = spark.createDataFrame([("e1", "Jon Smith", "Person"), ("e2", "John Smith", "Person")], "source_id string, name string, type string")
    found = identity.bridge_entities(entities, spark.createDataFrame([("p", "John Smith")], "source_id string, name string"))
    assert {(r.src_id, r.dst_id) for r in found.collect()} == {("e1", "p"), ("e2", "p")}


def test_blocked_hub_keeps_links(spark):
    rows = spark.createDataFrame([(k, "x@y.z") for k in ("1", "2", "3", "4")], "source_id string, email string")
    edges = lambda *blocks: {(r.src_id, r.dst_id) for r in identity.by_email(rows, spark.createDataFrame(blocks, "a string, b string")).collect()}
    assert edges(("3", "1")) == {("1", "2"), ("1", "4"), ("2", "3")}
    assert edges(("1", "2"), ("1", "3"), ("4", "1")) == {("2", "3"), ("2", "4")}
    named = spark.createDataFrame([(k, "Ann Example") for k in ("1", "2", "3")], "source_id string, name string")
    assert {(r.src_id, r.dst_id) for r in identity.by_name(named, spark.createDataFrame([("1", "3")], "a string, b string")).collect()} == {("1", "2"), ("2", "3")}


def test_curation(spark):
    edges = spark.createDataFrame([("Person", "a", "SAME_AS", "Person", "b")], "src_label string, src_id string, rel string, dst_label string, dst_id string")
    left, never = identity.split(edges, spark.createDataFrame([], "a string, b string"), "b", "a")
    assert left.count() == 0 and identity.confirm(left, never, "a", "b").count() == 0 and identity.merge(left, never, "a", "c").count() == 1


# --- writers and queue


def test_nodes_and_entities(spark):
    old = spark.createDataFrame([("File", "f", {"a": "1", "b": "2"}, datetime(2020, 1, 1))], "label string, source_id string, props map<string,string>, indexed_at timestamp")
    new = spark.createDataFrame([("File", "f", {"b": "3"}), ("File", "g", {"c": "4"})], "label string, source_id string, props map<string,string>")
    got = {r.source_id: r for r in writers.upsert_nodes(old, new, F.lit(datetime(2021, 1, 1))).collect()}
    assert got["f"].props == {"a": "1", "b": "3"} and got["g"].props == {"c": "4"} and got["f"].indexed_at == datetime(2021, 1, 1)
    e = writers.upsert_entities(spark.createDataFrame([("x", "Old", 0.8)], "name string, type string, confidence double"), spark.createDataFrame([("x", "Same", 0.8, 1), ("y", "A", 0.5, 1), ("y", "B", 0.5, 0)], "name string, type string, confidence double, seq long"))
    assert {(r.name, r.type) for r in e.collect()} == {("x", "Old"), ("y", "B")}


def test_stale_and_deleted(spark):
    edges = spark.createDataFrame([("File", "f", "MENTIONS", "Person", "p", True), ("File", "f", "LINKS_TO", "File", "g", False), ("File", "g", "MENTIONS", "Person", "q", True)], "src_label string, src_id string, rel string, dst_label string, dst_id string, hint boolean")
    new = edges.where("src_id = 'f' AND hint").withColumn("dst_id", F.lit("z"))
    assert {(r.src_id, r.dst_id) for r in writers.replace_hints(edges, new).collect()} == {("f", "z"), ("f", "g"), ("g", "q")}
    assert {r.dst_id for r in writers.stale_edges(edges, new).collect()} == {"p", "g"}
    gone = spark.createDataFrame([("g",)], "source_id string")
    rows = spark.createDataFrame([("f",), ("g",)], "source_id string")
    nodes, e, chunks, vectors = writers.delete_documents(gone, rows, edges, rows, rows)
    assert e.count() == 1 and nodes.count() == chunks.count() == vectors.count() == 1


def test_queue(spark):
    q = spark.createDataFrame([("1", "a", "processing", 2, None), ("2", "b", "pending", 0, None), ("3", "c", "failed", 3, "x")], "id string, source_id string, status string, attempts int, error string")
    done, failed = q.where("id = '2'"), spark.createDataFrame([("1", "boom")], "id string, error string")
    assert [(r.id, r.status, r.attempts) for r in Q.finish(q, done, failed).orderBy("id").collect()] == [("1", "failed", 3), ("3", "failed", 3)]
    assert Q.recover(q).where("status = 'pending'").count() == 2 and Q.retry(q).where("attempts = 0").count() == 2


@pytest.mark.parametrize("path, patterns, want", [("/h/Library/Uni/a.pdf", ["Library/Uni"], True), ("/h/LibraryUni/a.pdf", ["Library/Uni"], False), ("/h/node_modules/x.js", ["node_modules/"], True), ("/h/a.tmp", ["*.tmp"], True), ("/h/a.tmpx", ["*.tmp"], False), ("/h/üni/a", ["üni"], True), ("/h/a", [], False), ("/h/Lib2/Uni/a", ["Lib?/U*"], True)])
def test_globs(spark, path, patterns, want):
    assert spark.range(1).select(filters.matches_any(F.lit(path), patterns).alias("x")).first().x is want


def test_read_only(spark):
    assert filters.read_only(spark, "SELECT 'drop table x' AS a -- note").first().a == "drop table x"
    for bad in ("DROP TABLE x", "INSERT INTO x VALUES (1)", "CREATE TABLE t AS SELECT 1", "SET a=b", "WITH a AS (SELECT 1) INSERT INTO x SELECT * FROM a"):
        with pytest.raises(Exception):
            filters.read_only(spark, bad)
    for bad in ("SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT java_method('java.lang.System', 'nanoTime')", "SELECT * FROM parquet.`/tmp/x`", "SELECT a FROM (SELECT 1 AS a) WHERE a IN (SELECT value FROM text.`/etc/hosts`)"):
        with pytest.raises(ValueError):
            filters.read_only(spark, bad)
    assert filters.read_only(spark, "SELECT '--not a comment' AS a LIMIT 3;").first().a == "--not a comment"
    assert filters.read_only(spark, "SELECT id FROM range(5000)").count() == 1000


def test_binary_and_hybrid(spark):
    rows = spark.createDataFrame([(bytearray(b"%PDF-1"),), (bytearray(b"plain text"),), (bytearray(b"\xff\xfe\xfd" * 9),)], "b binary")
    assert [r.x for r in rows.select(filters.looks_binary(F.col("b")).alias("x")).collect()] == [True, False, True]
    g = spark.createDataFrame([(1, "x")], "pos int, source_id string")
    v = spark.createDataFrame([(1, "x", "2026-01-01"), (2, "j/Journal/y", "2026-01-02T00:00:00Z"), (3, "journal/z", ""), (4, "w", "2026-01-02"), (5, "journal/q", "2020-01-01")], "pos int, source_id string, date string")
    got = search.hybrid_merge(g, v, (date(2026, 1, 1), date(2026, 1, 31)), ["journal"]).orderBy("lane", "pos").collect()
    assert [(r.lane, r.source_id) for r in got] == [(0, "x"), (1, "j/Journal/y"), (1, "journal/z")]


def test_confidences_are_clamped_before_names_are_resolved(spark):
    e = spark.createDataFrame([("d", 0, "Apollo", "X", None), ("d", 1, "Borealis", "X", 7.0), ("d", 2, "Cassini", "X", float("nan")), ("d", 3, "Delphi", "X", -1.0)], "doc_id string, pos int, name string, type string, confidence double")
    k = spark.createDataFrame([("Apollo", "T", None), ("Borealis", "T", 0.2), ("Delphi", "T", 9.0)], "name string, type string, confidence double")
    got = {r.name: r.confidence for r in identity.resolve_entities(e, k).collect()}
    assert got == {"Apollo": 0.75, "Borealis": 1.0, "Cassini": 0.75, "Delphi": 1.0}


def test_many_wishes_take_linear_time():
    import time

    wishes = [(a, 0, -1.0, b) for a in range(30_000) for b in (a, a + 1)]
    began = time.time()
    assert [w[3] for w in identity.in_turn(wishes)] == list(range(30_000))
    assert time.time() - began < 2


def test_edges_meet_a_persons_documents_before_they_are_made_distinct(spark):
    from kgloom.plans import people

    mails = spark.range(3000).selectExpr("'Email' AS src_label", "concat('m', id % 1000) AS src_id", "'MENTIONS' AS rel", "'Person' AS dst_label", "concat('p', id % 7) AS dst_id").distinct()
    tagged = spark.range(3000).selectExpr("'Email' AS src_label", "concat('m', id % 1000) AS src_id", "'TAGGED' AS rel", "'Topic' AS dst_label", "concat('t', id % 3) AS dst_id").distinct()
    edges, cluster = mails.unionByName(tagged), spark.createDataFrame([("p1",)], "source_id string")
    both, want = mails.select("src_id", "dst_id").collect(), {}
    own = {r.src_id for r in both if r.dst_id == "p1"}
    for r in both:
        if r.src_id in own and r.dst_id != "p1":
            want[r.dst_id] = want.get(r.dst_id, 0) + 1
    first = sorted(want.items(), key=lambda x: (-x[1], x[0]))[:5]
    for found, rows in ((people.related_people(cluster, edges), first), (people.top_topics(cluster, edges), None)):
        got = [tuple(r) for r in found.collect()]
        assert got == rows if rows is not None else sum(n for _, n in got) >= len(own)
        lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
        depth = lambda line: next(k for k, c in enumerate(line) if c.isalpha())
        semi = [k for k, x in enumerate(lines) if "Join LeftSemi" in x]
        assert semi
        for k in semi:
            below = lines[k + 1 :]
            below = below[: next((n for n, x in enumerate(below) if depth(x) <= depth(lines[k])), len(below))]
            assert not any("Aggregate" in x for x in below)
