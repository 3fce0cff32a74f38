import itertools
import plistlib
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from kgloom.operators import fulltext
from kgloom.plans import people, search
from kgloom.sources import parsers, repositories


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def test_near_words_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    left, right = ({"".join(rng.choice("aéb語") for _ in range(rng.randint(1, 9))) for _ in range(120)} for _ in range(2))
    want = {(a, b) for a, b in itertools.product(left, right) if edits(a, b) <= 2 and edits(a, b) < min(len(a), len(b))}
    frame = lambda ws: spark.createDataFrame([(w,) for w in ws], "word string")
    got = [tuple(r) for r in fulltext.near_words(frame(left), frame(right)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200


def test_words_that_begin_alike_meet_about_as_often_as_they_are_near(spark):
    numbers = spark.range(2000).selectExpr("lpad(cast(id AS string), 9, '0') AS word")
    asked = numbers.where("word < 40")
    found = fulltext.near_words(asked, numbers)
    names = [f"{k:09d}" for k in range(2000)]
    assert {tuple(r) for r in found.collect()} == {(a, b) for a in names[:40] for b in names if edits(a, b) <= 2}
    # all of these numbers share their first piece: by pieces every one of the 80,000 pairs meets
    assert found.count() < fulltext._meetings(asked, numbers, False).count() < 40_000


def test_candidates_by_fuzzy_word(spark):
    known = spark.createDataFrame([("Kubernetes", "Technology", 0.9), ("Jon Smith", None, None), ("", None, None), (None, None, None)], "name string, type string, confidence double")
    names = spark.createDataFrame([(1, "Kubernets"), (1, None), (2, "Smyth & Co"), (3, "unknown")], "doc int, name string")
    got = {tuple(r) for r in fulltext.candidates(names, fulltext.word_index(known), known, ["doc"]).collect()}
    assert got == {(1, "Kubernetes", "Technology", 0.9), (2, "Jon Smith", "Concept", 0.75)}


def _vectors(spark):
    rows = [(f"d{k}", "slack" if k % 2 else "gmail", f"text {k}", "", [1.0, float(k)]) for k in range(8)]
    return spark.createDataFrame(rows, "source_id string, source_type string, text string, date string, vector array<double>")


def test_search_covers_graph_first(spark):
    graph = spark.createDataFrame([(1, "d1", "one"), (2, "d9", "nine")], "pos int, source_id string, line string")
    found = search.search("q", graph, _vectors(spark), lambda texts: [[1.0, 0.0]], k=3)
    assert [(r.lane, r.source_id, r.line) for r in found.collect()] == [(0, "d1", "one"), (0, "d9", "nine"), (1, "d0", "text 0"), (1, "d2", "text 2")]
    page = search.search_page(found).first().text
    assert page == "[Graph context]\n- one\n- nine\n\n[Semantic context]\n- [gmail] d0\n  text 0\n- [gmail] d2\n  text 2\n\n[Sources]\nd1\nd9\nd0\nd2"


def test_search_reranks_and_filters(spark):
    none = spark.createDataFrame([], "pos int, source_id string, line string")
    last_first = lambda q, texts: [float(t.split()[1]) for t in texts]
    found = search.search("q", none, _vectors(spark), lambda texts: [[1.0, 0.0]], k=2, source_type="gmail", scorer=last_first)
    assert [r.source_id for r in found.orderBy("lane", "pos").collect()] == ["d6", "d4"]
    with pytest.raises(ValueError):
        search.search("  ", none, _vectors(spark), lambda texts: [[1.0, 0.0]])
    empty = search.search("q", none, _vectors(spark).limit(0), lambda texts: [[1.0, 0.0]])
    assert search.search_page(empty).first().text == search.NOTHING


def test_front_matter(spark):
    text = "---\ntitle: \"A: b\"\ntags: [one, '#two', ]\naliases:\n  - x y\n  - 'z'\ncategories: People\nemails: [Me+a@GoogleMail.com, nobody]\nsource_url: https://e.org\n---\n#body [[Other]]\n"
    rows = spark.createDataFrame([("v/Jo.md", "v", text), ("v/none.md", "v", "---\nno end"), ("v/null.md", "v", None)], "source_id string, vault string, text string")
    one, two, three = parsers.note_properties(rows).orderBy("source_id").collect()
    assert (one.title, one.tags, one.aliases, one.categories, one.emails) == ("A: b", ["one", "two"], ["x y", "z"], ["People"], ["me@gmail.com"])
    assert one.web_clip and one.source_url == "https://e.org" and not two.web_clip and two.title is None and three.title is None
    edges = {(r.rel, r.dst_id) for r in parsers.notes(rows).collect()}
    assert edges == {("LINKS_TO", "v/Other.md"), ("TAGGED_BY_USER", "body"), ("TAGGED_BY_USER", "one"), ("TAGGED_BY_USER", "two"), ("TAGGED_BY_USER", "omnifocus-tag:People/Jo"), ("MENTIONS", "person:me@gmail.com")}


def _run(folder, *args):
    subprocess.run(["git", "-C", str(folder), "-c", "user.name=A B", "-c", "user.email=a@b.org", *args], check=True, capture_output=True)


def test_repositories(spark, tmp_path):
    repo = tmp_path / "one"
    for name in ("one", "skipped", "plain"):
        (tmp_path / name).mkdir()
        if name != "plain":
            _run(tmp_path / name, "init", "-q")
    (repo / "ä.md").write_text("hello\n")
    (repo / "b.bin").write_bytes(b"\0\1")
    (repo / "c.py").write_text("x = 1\n")
    _run(repo, "add", "-A")
    _run(repo, "commit", "-q", "-m", "first\n\nbody")
    found = repositories.discover(spark, [str(tmp_path), str(tmp_path / "gone")], exclude=("skip*",)).collect()
    assert [(r.repository, r.name, r.remote) for r in found] == [(str(repo), "one", None)]
    first = found[0]["head"]
    frame = lambda head, before: spark.createDataFrame([(str(repo), head, before)], "repository string, head string, before string")
    files = {r.path: (r.operation, r.text, r.index_only, r["size"]) for r in repositories.file_events(frame(first, None), exclude=("*.py",)).collect()}
    assert files == {"ä.md": ("created", "hello\n", False, 6), "b.bin": ("created", None, True, 2)}
    (repo / "ä.md").write_text("more\n")
    (repo / "b.bin").unlink()
    (repo / "d.txt").write_text("d")
    _run(repo, "add", "-A")
    _run(repo, "commit", "-q", "-m", "second")
    head = repositories.discover(spark, [str(repo)]).first()["head"]
    changed = {(r.path, r.operation, r.text) for r in repositories.file_events(frame(head, first)).collect()}
    assert changed == {("ä.md", "modified", "more\n"), ("b.bin", "deleted", None), ("d.txt", "created", "d")}
    assert repositories.file_events(frame(head, "0" * 40)).count() == 3  # an unknown revision: all files
    commits = repositories.commit_events(frame(head, None)).collect()
    assert [(r.text, r.author_name, r.author_email, sorted(r.changed_files)) for r in commits] == [("second", "A B", "a@b.org", ["b.bin", "d.txt", "ä.md"]), ("first\n\nbody", "A B", "a@b.org", ["b.bin", "c.py", "ä.md"])]
    known = spark.createDataFrame([(f"commit:{repo}:{first}",)], "source_id string")
    assert [r.sha for r in repositories.commit_events(frame(head, None), known).collect()] == [head]
    assert [r.sha for r in repositories.commit_events(frame(head, first)).collect()] == [head]
    here = repositories.discover(spark, [str(repo)])
    cursors = lambda at: spark.createDataFrame([(str(repo), at)], "repository string, head string")
    assert repositories.since(here, cursors(head)).count() == 0 and repositories.since(here, cursors(first)).first().before == first


def test_bundles(spark, tmp_path):
    for path, told in (("A.app", {"CFBundleName": "A", "CFBundleIdentifier": "org.a", "CFBundleShortVersionString": "1.0"}), ("Utilities/B.app", {}), ("Utilities/deep/C.app", {}), ("D.app", None)):
        (tmp_path / path / "Contents").mkdir(parents=True)
        (tmp_path / path / "Contents" / "Info.plist").write_bytes(b"broken" if told is None else plistlib.dumps(told))
    (tmp_path / "Link.app").symlink_to(tmp_path / "A.app")
    got = {(r.name, r.bundle_id, r.version, len(r.sha256)) for r in repositories.bundles(spark, [str(tmp_path)]).collect()}
    assert got == {("A", "org.a", "1.0", 64), ("B", "", "", 64)}


def test_brief_text(spark):
    one = lambda schema, *rows: spark.createDataFrame(list(rows), schema)
    sections = dict(
        sources=one("sources int", (2,)),
        tasks=one("task_id string, title string, project string, due string, flagged boolean", ("t1", "Plan", None, None, False), ("t2", "Pay", "Home", "2024-01-02", True)),
        threads=one("thread string, subject string, last_date string"),
        chats=one("channel string, last_ts string, text string", ("dev", "17.5", "a\nb" + "x" * 300), ("ops", "16.5", None)),
        topics=one("topic_name string, doc_count long", ("spark", 3)),
    )
    text = people.brief_text("Jo", "jo@x.org", **sections, since_label="7d").first().text
    assert text == (
        "[Identity]\nJo <jo@x.org> — 2 sources\n\n[Open OmniFocus tasks (2)]\n- Pay (project: Home) due 2024-01-02 [flagged]\n- Plan\n\n[Outstanding email threads (last 7d, 0)]\n(none)\n\n"
        f"[Unresolved Slack mentions of you (last 7d, 2)]\n- #dev @ 17.5 — a b{'x' * 197}…\n- #ops @ 16.5\n\n[Top active topics (last 7d)]\n- spark (3 docs)\n"
    )
    meeting = one("event_id string, summary string, description string, location string, start_time string, attendees array<string>, attachments array<string>", ("e", "Sync", " why ", None, "2024", ["a", "b"], []))
    text = people.brief_text("", "", **sections, since_label="7d", note=" kind ", meeting=meeting.withColumn("location", F.lit(None).cast("string"))).first().text
    assert text.startswith("[Identity]\n(unnamed) — 2 sources\n") and text.endswith("[Obsidian People note]\nkind\n\n[Upcoming meeting context]\nEvent: Sync\nWhen: 2024\nAttendees: a, b\nDescription:\nwhy\n")


def test_embedding_falls_back_on_long_texts():
    from kgloom.functions import vectors as V

    def model(texts):
        if any(len(t) > 600 for t in texts):
            raise V.ContextOverflow
        return [[float(len(t))] for t in texts]

    assert V.embed_texts(model, ["ab", "x" * 700, "c"]) == [[2.0], [500.0], [1.0]] and V.embed_texts(model, []) == []
    assert V.fitted("a " * 4000) == ("a " * 3000)[:-1] and V.fitted("x" * 7000) == "x" * 6000 and V.fitted("a b") == "a b"

    def none(texts):
        raise V.ContextOverflow

    assert V.embed_texts(none, ["a"]) == [None]
    with pytest.raises(ValueError):
        V.embed_texts(lambda texts: [], ["a"])


def test_a_failing_scorer_keeps_the_order(spark):
    from kgloom.functions import vectors as V

    rows = spark.createDataFrame([(k, f"t{k}") for k in range(4)], "pos int, text string").coalesce(1)

    def broken(question, texts):
        raise RuntimeError("gone")

    for scorer in (broken, lambda q, texts: [1.0]):
        got = V.rerank(rows, "q", 3, 0.5, scorer=scorer).collect()
        assert [(r.pos, r.rerank_score) for r in got] == [(0, None), (1, None), (2, None)]


def test_scan_and_stream_of_files(spark, tmp_path):
    from kgloom.sources import snapshots

    (tmp_path / "in" / "deep").mkdir(parents=True)
    for name, size in (("a.md", 5), ("deep/b.md", 50), ("c.txt", 1)):
        (tmp_path / "in" / name).write_text("x" * size)
    got = {r.path.rsplit("/", 1)[1]: (r["size"], len(r.sha256)) for r in snapshots.scan_files(spark, str(tmp_path / "in"), max_bytes=10, index_only=F.col("path").endswith(".txt")).collect()}
    assert got == {"a.md": (5, 64), "b.md": (50, 0), "c.txt": (1, 0)}
    query = snapshots.new_files(spark, str(tmp_path / "in"), "*.md").writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).format("parquet").start(str(tmp_path / "out"))
    query.awaitTermination(60)
    assert {(r.source_id.rsplit("/", 1)[1], r.operation, len(r.content)) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a.md", "created", 5), ("b.md", "created", 50)}


def test_entities_alike_in_meaning(spark):
    from kgloom.operators import identity

    near = {"Machine Learning": [1.0, 0.0], "ML": [0.99, 0.1], "Cooking": [0.0, 1.0], "Odd": [float("nan"), 1.0], "Statistics": [0.9, 0.435]}
    e = spark.createDataFrame([("d", 0, "ML", None, 0.8), ("d", 1, "Cooking", "X", 0.5), ("e", 0, "machine learning", None, 0.5), ("e", 1, "Odd", None, 0.5), ("f", 0, "ML", None, 0.5)], "doc_id string, pos int, name string, type string, confidence double")
    k = spark.createDataFrame([("Machine Learning", "Concept", 0.9), ("Statistics", "Concept", 0.9)], "name string, type string, confidence double")
    got = {(r.doc_id, r.name, r.merged_into, r.same_as) for r in identity.resolve_entities(e, k, lambda texts: [near[t] for t in texts]).collect()}
    assert got == {("d", "ML", None, "Machine Learning"), ("d", "Cooking", None, None), ("e", "Machine Learning", "Machine Learning", None), ("e", "Odd", None, None), ("f", "ML", None, "Machine Learning")}


def test_neighbours_in_blocks_are_those_at_once(spark, monkeypatch):
    from kgloom.functions import vectors as V

    rng = random.Random(3)
    rows = spark.createDataFrame([(f"s{k % 30}", [rng.gauss(0, 1) for _ in range(4)]) for k in range(40)], "source_id string, vector array<double>")
    found = lambda: sorted(tuple(r) for r in V.neighbours(rows, rows, 3, 0.5).collect())
    at_once = found()
    monkeypatch.setattr(V, "SEED_BLOCK", 7)
    assert found() == at_once and len(at_once) > 30


def test_first_values_hold_no_more_than_they_keep(spark):
    rows = spark.createDataFrame([(None if k % 7 == 0 else "abc"[k % 3], f"{k % 50:03}") for k in range(400)] + [("z", None), ("a", "000")], "source_type string, source_id string")
    got = {r.source_type: (r.n, r.ids) for r in search.source_groups(rows).collect()}
    want = {}
    for r in rows.collect():
        want.setdefault(r.source_type, [0, set()])
        want[r.source_type][0] += 1
        want[r.source_type][1] |= {r.source_id} - {None}
    assert got == {k: (n, ",".join(sorted(ids)[:3])) for k, (n, ids) in want.items()}
    plan = search.first_values(rows, "source_type", "source_id", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # in each task, and after the shuffle
