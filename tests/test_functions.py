"""Scalar functions on small tables."""

from datetime import date, datetime, timezone

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from kgloom.functions import chunking, fuzzy, text as T, times, vectors as V

NOW = datetime(2026, 4, 27, 12, tzinfo=timezone.utc)


def one(spark, f, *values):
    """f of literal strings (None: null string)."""
    return spark.range(1).select(f(*(F.lit(v) if v is not None else F.lit(None).cast("string") for v in values)).alias("x")).first().x


@pytest.mark.parametrize(
    "raw, want",
    [
        (" Alice+Work@GoogleMail.com ", "alice@gmail.com"),
        ("alice@gmail.com", "alice@gmail.com"),
        ("Bob+tag@Example.com", "bob+tag@example.com"),
        ('"a@b"@example.com', '"a@b"@example.com'),
        ("No At", "no at"),
        ("", ""),
        (None, None),
    ],
)
def test_canonical_email(spark, raw, want):
    assert one(spark, T.canonical_email, raw) == want


def test_emails_are_distinct_and_in_order(spark):
    assert one(spark, T.emails, "b@x.org, A@x.org; b@X.org a@@x c@x") == ["b@x.org", "a@x.org"]


def test_source_links(spark):
    text = "see gmail://a/message/m1. (omnifocus://task/T9) obsidian://open?vault=My%20V&file=a%2Fb.md https://x?ref=slack://no https://Terra.slack.com/archives/C1/p1715800000123456?thread_ts=1 gmail://a/message/m1"
    got = one(spark, lambda t: T.source_links(t, {"My V": "/v"}, {"terra": "T1"}), text)
    assert [(r.object_id, r.object_label) for r in got] == [("gmail://a/message/m1", "Email"), ("omnifocus://T9", "Task"), ("/v/a/b.md", "File"), ("slack://T1/C1/1715800000.123456", "SlackMessage")]


def test_unknown_workspace_has_an_empty_team(spark):
    assert one(spark, lambda u: T.permalink_id(u, {}), "https://w.slack.com/archives/C1/p1715800000123456") == "slack:///C1/1715800000.123456"


@pytest.mark.parametrize("raw, want", [("a\x00b c", "a b c"), ("# head", "`# head`"), ("`x`", "`x`"), ("x" * 300, "x" * 199 + "…"), ("", ""), ("  a   b ", "a b")])
def test_inline_name_is_idempotent(spark, raw, want):
    assert one(spark, T.inline_name, raw) == want
    assert one(spark, T.inline_name, want) == want


def test_sizes(spark):
    f = lambda n, s: one(spark, lambda _: T.human_size(F.lit(n), s), "")
    assert [f(n, "mail") for n in (-1, 512, 2048, 3 << 20, 5 << 30)] == ["0 B", "512 B", "2.0 KB", "3.0 MB", "5.0 GB"]
    assert [f(n, "calendar") for n in (0, 512, 5 << 30)] == ["size unknown", "512 B", "5120.0 MB"]
    assert [f(n, "chat") for n in (0, 5 << 40)] == ["0 B", "5.0 TB"]


def test_html(spark):
    assert one(spark, T.html_text, "<p>a<b>b</b></p>\n<script>x()</script><style>y</style> <br> &lt;c&gt; &amp;lt;") == "a\nb\n<c> &lt;"


def test_names_json_and_redaction(spark):
    assert one(spark, T.short_name, "n" * 256) == "n" * 256 and len(one(spark, T.short_name, "n" * 257)) == 256
    assert one(spark, T.lenient_json, '<think>{"no": 1}</think> sure: {"a": {"b": 2}} done') == '{"a": {"b": 2}}' and one(spark, T.lenient_json, "none") is None
    assert one(spark, T.without_credentials, "bolt://u:p@h:1 token=abc") == "bolt://***@h:1 token=<REDACTED>"
    assert one(spark, T.cut_at_word, "word " * 2000).endswith("word") and len(one(spark, T.cut_at_word, "word " * 2000)) <= 6000
    assert one(spark, T.clickable, "gmail://a/message/m1") == "https://mail.google.com/mail/u/0/#all/m1" and one(spark, T.clickable, "x") is None
    assert [one(spark, T.mime_label, m) for m in ("image/png", "a/zip", "", "odd")] == ["PNG", "ZIP", "FILE", "ODD"]


@pytest.mark.parametrize("c, want", [("0.5", 0.5), ("7", 1.0), ("-1", 0.0), ("NaN", 0.75), (None, 0.75)])
def test_confidence(spark, c, want):
    assert one(spark, T.clamp_confidence, c) == want


@pytest.mark.parametrize("text, hours", [("24h", 24), ("7d", 168), ("2w", 336), ("3m", 2160), ("now", 0), ("last week", 168)])
def test_relative_time(text, hours):
    assert (NOW - times.relative_time(text, NOW)).total_seconds() == hours * 3600


def test_other_times():
    assert times.relative_time("yesterday", NOW) == datetime(2026, 4, 26, tzinfo=timezone.utc)
    assert times.relative_time("2026-03-01", NOW) == times.relative_time("2026-03-01T00:00:00Z", NOW) == datetime(2026, 3, 1, tzinfo=timezone.utc)
    with pytest.raises(ValueError):
        times.relative_time("soon", NOW)


WEDNESDAY = date(2031, 10, 15)


@pytest.mark.parametrize(
    "question, want",
    [
        ("Today's meetings, please", (WEDNESDAY, WEDNESDAY)),
        ("what came in yesterday?", (date(2031, 10, 14),) * 2),
        ("who wrote this week", (date(2031, 10, 13), WEDNESDAY)),
        ("(this month)", (date(2031, 10, 1), WEDNESDAY)),
        ("everything this year", (date(2031, 1, 1), WEDNESDAY)),
        ("the past 12 days", (date(2031, 10, 4), WEDNESDAY)),
        ("over the previous fourteen days", (date(2031, 10, 2), WEDNESDAY)),
        ("last thirty days of notes", (date(2031, 9, 16), WEDNESDAY)),
        ("past three weeks", (date(2031, 9, 25), WEDNESDAY)),
        ("last week", (date(2031, 10, 9), WEDNESDAY)),
        ("last year", (date(2030, 10, 16), WEDNESDAY)),
        ("last month or yesterday", (date(2031, 10, 14),) * 2),
        ("last eleven days", None),
        ("What came in today—and when?", (WEDNESDAY, WEDNESDAY)),
        ("yesterday/tomorrow", (date(2031, 10, 14),) * 2),
        ("today…", (WEDNESDAY, WEDNESDAY)),
        ("what of “last week”", (date(2031, 10, 9), WEDNESDAY)),
        ("today's mail", (WEDNESDAY, WEDNESDAY)),
        ("the last-week report", None),
        ("last, week", None),
        ("a_today", None),
        ("at last a week", None),
        ("this day", None),
        ("", None),
    ],
)
def test_question_window(question, want):
    assert times.question_window(question, WEDNESDAY) == want


def test_journal():
    asked = {"show the journal": True, "Journaled thoughts": True, "my journals?": True, "journaling.": True, "a journalist": False, "adjournal": False, "": False}
    assert {q: times.asks_for_journal(q) for q in asked} == asked


def test_mixed_timestamps(spark):
    at = lambda v: one(spark, times.mixed_timestamp, v)
    want = datetime(2026, 4, 27, 10, 0)
    forms = ["2026-04-27T10:00:00Z", "2026-04-27T12:00:00+02:00", "2026-04-27T10:00:00", "1777284000.000000", "Mon, 27 Apr 2026 10:00:00 +0000"]
    assert [at(v) for v in forms] == [want] * 5
    assert at("2026-04-27") == datetime(2026, 4, 27) and at("") is None and at("never") is None


def test_local_day(spark):
    inside = lambda v: one(spark, lambda c: times.starts_in_window(c, date(2026, 4, 27), "America/Los_Angeles"), v)
    assert [inside(v) for v in ("2026-04-27", "2026-04-28T06:59:00Z", "2026-04-28T07:00:00Z", "2026-04-27T06:00:00Z", "2026-04-28")] == [True, True, False, False, False]


def test_exif(spark):
    assert [one(spark, times.exif_date, v) for v in ("2024:06:15 14:30:00", "2024-06-15", "0000:00:00 00:00:00", "odd", "2024-06-15T01:02:03")] == ["2024-06-15T14:30:00", "2024-06-15", None, None, "2024-06-15T01:02:03"]
    degrees = lambda d, m, s, r: one(spark, lambda _: times.decimal_degrees(F.lit(d), F.lit(m), F.lit(s), F.lit(r)), "")
    assert degrees(10.0, 30.0, 0.0, "S") == -10.5 and degrees(91.0, 0.0, 0.0, "N") is None and degrees(0.0, 0.0, 0.0, "E") is None and degrees(91.0, 0.0, 0.0, "E") == 91.0


# --- fuzzy names


@pytest.mark.parametrize(
    "a, b, want",
    [("Alice Johnson", "Alice Johnso", 96.0), ("Markus Smith", "M. Smith", 70.0), ("Alic Example", "Alice Example", 96.0), ("Alic Example", "Alicia Example", 92.31), ("AWS", "AMS", 66.67), ("Smith Alice", "alice smith", 100.0)],
)
def test_token_sort_ratio(spark, a, b, want):
    assert round(one(spark, fuzzy.token_sort_ratio, a, b), 2) == want


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        above = row[:]
        for j, y in enumerate(b):
            row[j + 1] = above[j] + 1 if x == y else max(above[j + 1], row[j])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abcé ", max_size=80), st.text("abcé ", max_size=80))
def test_lcs_length(a, b):
    assert fuzzy.lcs_length(a, b) == brute_lcs(a, b)


def test_blocking_loses_no_pair(spark):
    import random

    rng = random.Random(1)
    base = ["anna berg", "carl dietz", "emma frank", "gustav hein", "ida jansen", "karl lund"]
    names = []
    for _ in range(150):
        n = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            n[rng.randrange(len(n))] = rng.choice("abcdefghij ")
        names.append("".join(n).title() if rng.random() < 0.5 else "".join(reversed("".join(n).split(" "))) if rng.random() < 0.1 else "".join(n))
    rows = list(enumerate(names))
    got = {(r.a, r.b): r.score for r in fuzzy.similar_pairs(spark.createDataFrame(rows, "id long, name string"), 88.0).collect()}
    sort = lambda n: " ".join(sorted(n.lower().split()))
    need = lambda n: 100.0 if len(n.strip()) < 4 else 95.0 if len(n.strip()) < 6 else 88.0
    first = {}
    for i, n in rows:
        first.setdefault(sort(n), i)
    want = {}
    for i, a in rows:
        for j, b in rows:
            if i < j:
                x, y = sort(a), sort(b)
                score = fuzzy.ratio(x, y)
                if x == y and first[x] == i or x != y and first[x] == i and first[y] == j and score >= max(need(a), need(b)):
                    want[i, j] = score
    assert got == pytest.approx(want) and len(want) > 20


# --- chunks and windows


def words(n, w="w"):
    return " ".join([w] * (n - 1)) + f" {w}."


def test_chunks_overlap_and_merge():
    assert chunking.chunk_text("") == chunking.chunk_text(None) == chunking.chunk_text("  ") == []
    got = chunking.chunk_text(" ".join([words(200)] * 6))
    assert [len(c.split()) for c in got] == [400, 464, 464]
    assert [len(c.split()) for c in chunking.chunk_text(words(700))] == [700]
    assert [len(c.split()) for c in chunking.chunk_text(words(500) + " " + words(60), overlap=0)] == [560]


def test_message_chunks():
    text = "\n".join(f"[10:0{k} UTC] u: {words(100)}" for k in range(8))
    got = chunking.chunk_messages(text, 512, 3)
    assert all(c.startswith("[10:0") for c in got) and [c.count("UTC]") for c in got] == [5, 5, 4]
    assert chunking.chunk_messages("no header") == ["no header"] and chunking.chunk_messages("") == []
    assert [c.count("UTC]") for c in chunking.chunk_messages(text, 50, 3)] == [1] * 8


def test_indented_replies_are_messages():
    text = "[08:15 UTC] ann: question\n  [08:16 UTC] bob: answer\nwith a second line\n    [08:17 UTC] quoted deeper\n  [08:18 UTC] cy: thanks"
    assert [b.split()[2] for b in chunking.message_blocks(text)] == ["ann:", "bob:", "cy:"]


def slow_chunks(text, size, overlap, least):
    """The rules word by word."""
    import re as r

    done, held = [], []
    for sentence in r.split(r"(?<=[.!?])\s+", text):
        if held and sentence.split() and len(held) + len(sentence.split()) > size:
            done.append(held)
            held = held[len(held) - overlap :] if 0 < overlap <= len(held) else []
        held = held + sentence.split()
    done += [held] if held else []
    k = 1
    while k < len(done):
        if len(done[k]) < least and len(done[k - 1]) + len(done[k]) <= int(1.5 * size):
            done[k - 1] = done[k - 1] + done.pop(k)
        else:
            k += 1
    if len(done) > 1 and len(done[0]) < least and len(done[0]) + len(done[1]) <= int(1.5 * size):
        done[0] += done.pop(1)
    return [" ".join(d) for d in done]


def slow_windows(times_, sizes, gap, most, overlap):
    out, held = [], []
    for k in sorted(range(len(times_)), key=lambda i: times_[i]):
        if held and times_[k] - times_[held[-1]] > gap:
            out, held = out + [held], []
        elif held and sum(sizes[j] for j in held) + sizes[k] >= most:
            out, held = out + [held], held[len(held) - min(overlap, len(held)) :]
        held = held + [k]
    return out + [held] if held else out


def test_chunks_and_windows_match_slow_versions():
    import random

    rng = random.Random(2)
    for _ in range(150):
        text = " ".join(words(rng.randrange(1, 30), "w") for _ in range(rng.randrange(0, 25)))
        size, overlap, least = rng.randrange(5, 40), rng.randrange(0, 12), rng.randrange(0, 20)
        assert chunking.chunk_text(text, size, overlap, least) == slow_chunks(text, size, overlap, least)
        at, sizes = [rng.randrange(0, 60) for _ in range(rng.randrange(0, 25))], [rng.randrange(1, 12) for _ in range(25)]
        got = chunking.split_windows(at, ["x" * 4 * n for n in sizes[: len(at)]], 5, 20, overlap % 4)
        assert got == slow_windows(at, sizes, 5, 20, overlap % 4)


def test_office_types_have_labels(spark):
    named = {"application/msword": "DOC", "application/zip": "ZIP", "application/vnd.ms-excel": "XLS", "application/x-tar": "X-TAR", "": "FILE"}
    assert {m: one(spark, T.mime_label, m) for m in named} == named


def test_windows():
    split = chunking.split_windows
    assert split([], []) == [] and split([0, 1800, 3601], ["a"] * 3) == [[0, 1], [2]]
    assert split([0, 1, 2, 3, 4], ["x" * 800] * 5, overlap=3) == [[0, 1], [0, 1, 2], [0, 1, 2, 3], [1, 2, 3, 4]]
    assert split([0, 1, 2, 3], ["x" * 1024] * 4, overlap=0) == [[0], [1], [2], [3]]


# --- vectors


def test_cosine_and_rerank(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", [1.0, 1.0])], "source_id string, vector array<float>")
    assert [(r.source_id, round(r.score, 3)) for r in V.top_k(df, V.literal([1, 0]), 3).collect()] == [("a", 1.0), ("c", 0.707), ("b", 0.0)]
    rows = spark.createDataFrame([(0, "red apple"), (1, "green tea"), (2, "red tea"), (3, None)], "pos int, text string")
    assert [r.pos for r in V.rerank(rows, "red tea", 3, 0.1).collect()] == [2, 0, 1] and V.rerank(rows, "red", 0).count() == 0
    assert V.clamp_k(0) == 1 and V.clamp_k(5000) == 1000


@pytest.mark.parametrize("ending, mime", [*T.EXTENSION_MIMES.items(), ("exe", "application/octet-stream")])
def test_every_ending(spark, ending, mime):
    paths = [(f"/a.b/x.{ending}", mime), (f"x.{ending.upper()}", mime), (f"/a/.{ending}", "application/octet-stream"), (f"x.{ending}/y", "application/octet-stream")]
    got = spark.createDataFrame(paths, "p string, want string").select(T.mime_of_path(F.col("p")), "want").collect()
    assert all(r[0] == r[1] for r in got)


def test_two_queries_of_one_name_are_refused():
    from kgloom import queries

    def timeline_all(spark, sf_dir):
        return None

    with pytest.raises(ValueError):
        queries.query()(timeline_all)


def test_times_in_columns(spark):
    import datetime

    now = datetime.datetime(2031, 5, 14, 15, 30, tzinfo=datetime.timezone.utc)
    rows = spark.createDataFrame([("24h",), ("no time",), (None,), ("24h",)], "said string")
    got = rows.select(times.relative_times(F.col("said"), now).alias("t"), times.question_windows(F.col("said"), now.date()).alias("w")).collect()
    assert [r.t for r in got] == [datetime.datetime(2031, 5, 13, 15, 30), None, None, datetime.datetime(2031, 5, 13, 15, 30)]
    assert all(r.w["first"] is None for r in got)


def test_chunks_are_given_on_in_small_batches(monkeypatch):
    import pyarrow as pa

    from kgloom.functions import chunking

    monkeypatch.setattr(chunking, "OUT_CHARS", 2000)
    texts = [None, "", *(f"Word {k} stands here. " * (5 * k) for k in range(60))]
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(len(texts))]), pa.array(texts)], names=["source_id", "text"])
    out = list(chunking._chunked(chunking.chunk_text)(iter([batch])))
    assert len(out) > 10
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert got == [(f"{i}:chunk:{k}", str(i), k, c) for i, t in enumerate(texts) for k, c in enumerate(chunking.chunk_text(t))]
