"""Chat windows: the batch against plain Python, the stream against the batch in any order of changes."""

import random
from types import SimpleNamespace

import pandas as pd
import pytest

from kgloom.streaming import chats

SCHEMA = "channel string, message string, at double, version double, gone boolean, text string"


def changes_of(seed, size, channels="AB", step=700):
    r, out = random.Random(seed), []
    for n in range(size):
        posted = (r.choice(channels), f"m{n}", round(r.randrange(size * step // 2) + r.random(), 6), 0.0, False, "w" * r.choice([0, 4, 30, 90]))
        out.append(posted)
        out += [(*posted[:3], float(v + 1), r.random() < 0.4, "e" * r.choice([0, 8, 60])) for v in range(r.choice([0, 0, 1, 2]))]
    r.shuffle(out)
    return out


def plain(changes, most, overlap, gap):
    """The windows as defined, message by message."""
    now = {}
    for channel, message, at, version, gone, text in changes:
        if channel is None or at is None:
            continue
        name, state = (channel, round(at * 10**6), message or ""), (float("-inf") if version is None else version, bool(gone), text or "")
        now[name] = max(now.get(name, state), state)
    out = set()
    for channel in {n[0] for n in now}:
        window, before = [], None
        rows = sorted((n[1], n[2], s[2]) for n, s in now.items() if n[0] == channel and not s[1])
        for row in rows + [None]:
            size = sum(max(1, len(t) // 4) if t else 0 for _, _, t in window + ([row] if row else []))
            apart = row is not None and before is not None and row[0] - before > gap * 10**6
            if window and (row is None or apart or size >= most):
                out.add((channel, chats.window_name(window[0][:2], window[-1][:2]), len(window), "\n".join(t for _, _, t in window)))
                window = [] if row is None or apart or not overlap else window[-overlap:]
            if row is not None:
                window.append(row)
                before = row[0]
    return out


def rows_of(df):
    return {(r.channel, r.window_id, r.messages, r.text) for r in df.collect()}


class Kept:
    """A map or value of state in memory."""

    def __init__(self):
        self.of = {}
        self.reads = 0

    def getValue(self, key):
        self.reads += 1
        return self.of[key]

    def containsKey(self, key):
        return key in self.of

    def updateValue(self, key, value):
        self.of[key] = value

    def removeKey(self, key):
        del self.of[key]

    def exists(self):
        return bool(self.of)

    def get(self):
        return self.of[()]

    def update(self, value):
        self.of[()] = value


def processor(most, overlap, gap):
    p = chats.ChatWindows(most, overlap, gap, None)
    p.init(SimpleNamespace(getMapState=lambda *a: Kept(), getValueState=lambda *a: Kept()))
    return p


def feed(p, channel, changes, left):
    """Runs one batch and keeps the windows left standing; an operation that does not fit them fails."""
    frame = pd.DataFrame(changes, columns=["channel", "message", "at", "version", "gone", "text"])
    for out in p.handleInputRows((channel,), iter([frame]), None):
        for row in out.itertuples():
            if row.operation == "deleted":
                left.pop(row.window_id)
            elif row.operation in ("created", "modified"):
                assert row.window_id not in left
                left[row.window_id] = (row.messages, row.text)


@pytest.mark.parametrize("seed", range(60))
def test_any_order_and_any_batches_give_the_windows_as_defined(seed):
    r = random.Random(seed)
    most, overlap, gap = r.choice([5, 20, 50, 512]), r.choice([0, 1, 3]), r.choice([600, 1800])
    changes, p, left = changes_of(seed, r.choice([3, 12, 60]), "A", r.choice([100, 700, 2500])), processor(most, overlap, gap), {}
    done = 0
    while done < len(changes):
        size = r.choice([1, 2, 7, 40])
        feed(p, "A", changes[done : done + size], left)
        done += size
        assert {("A", k, *v) for k, v in left.items()} == plain(changes[:done], most, overlap, gap)
    feed(p, "A", changes, again := dict(left))
    assert again == left  # repeats change nothing


def test_gap_is_strict_and_an_edit_deletes_before_it_gives_anew():
    p = processor(512, 3, 1800)
    frame = lambda *rows: iter([pd.DataFrame(rows, columns=["channel", "message", "at", "version", "gone", "text"])])
    first = next(p.handleInputRows(("C",), frame(("C", "a", 0.1, 0.0, False, "x"), ("C", "b", 1800.1, 0.0, False, "y"), ("C", "c", 3600.100001, 0.0, False, "z")), None))
    assert first.messages.tolist() == [2, 1] and first.operation.tolist() == ["created"] * 2
    second = next(p.handleInputRows(("C",), frame(("C", "b", 1800.1, 1.0, False, "edited")), None))
    assert second.operation.tolist() == ["deleted", "modified"] and second.window_id.nunique() == 1 and second.seq.tolist() == [2, 3]
    third = next(p.handleInputRows(("C",), frame(("C", "b", 1800.1, 2.0, True, None), ("C", "q", None, 2.0, True, None)), None))
    assert third.operation.tolist() == ["skipped", "deleted", "created"] and third.messages.tolist()[-1] == 1


def test_a_message_at_the_end_reads_few_slots_of_a_channel_that_never_pauses():
    p, left = processor(40, 1, 1800), {}
    feed(p, "C", [("C", f"{n}", n * 900.0, 0.0, False, "w" * 40) for n in range(2000)], left)
    before = p.slots.reads
    feed(p, "C", [("C", "2000", 2000 * 900.0, 0.0, False, "w" * 40)], left)
    assert p.slots.reads - before < 10


def test_stream_and_batch_agree(spark, tmp_path):
    changes = changes_of(5, 80) + [(None, "x", 1.0, 0.0, False, "t"), ("A", "y", None, 0.0, True, "t"), ("A", None, 3.0, None, None, None)]
    want = plain(changes, 30, 2, 1800)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    where, run = str(tmp_path / "in"), 0
    for part in (changes[:60], changes[60:]):  # the second query goes on from the first one's checkpoint
        spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(where)
        stream = chats.stream_chat_windows(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 2).parquet(where), 30, 2)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(240) and q.exception() is None
    log = spark.read.parquet(str(tmp_path / "out"))
    assert rows_of(chats.standing(log)) == want == rows_of(chats.chat_windows(spark.createDataFrame(changes, SCHEMA), 30, 2))
    assert log.where("operation = 'skipped'").count() == 2 and log.groupBy("channel", "seq").count().where("count > 1").count() == 0
    assert chats.chat_windows(spark.createDataFrame([], SCHEMA)).count() == 0
