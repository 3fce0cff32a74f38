"""Windows of chat messages under edits and deletions: from a table of changes, and kept on a stream.

A change is a row (channel string, message string, at double, version double, gone boolean, text string): ``at`` is when the message was sent, in seconds (counted in whole microseconds), and
stays; ``version`` is when the change was made. A message is known by channel, ``at`` and ``message`` (null: ''), and its greatest (version, gone, text) counts, so
changes may come in any order and more than once. Null texts are empty, null versions come before all others, a null ``gone`` is false. A change without a channel or
``at`` names no message: the batch leaves it out, the stream gives it back as ``skipped``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.chunking import window_bounds
from .sessions import GAP, MICROS, MOST, OVERLAP, gap_sessions

WINDOWS = "channel string, window_id string, first_at double, last_at double, messages int, text string"
OPERATIONS = "channel string, seq long, operation string, window_id string, first_at double, last_at double, messages int, text string"


def window_name(first: tuple[int, str], last: tuple[int, str]) -> str:
    """Name of a window by its first and last message (microseconds, message)."""
    return "window/" + "-".join(f"{at // MICROS}.{at % MICROS:06d}{message}" for at, message in (first, last))


def latest(changes: DataFrame) -> DataFrame:
    """The messages as they stand: one aggregate by message, so that partial results are made before the shuffle; deleted ones go."""
    state = F.struct(F.col("version").cast("double").alias("version"), F.coalesce("gone", F.lit(False)).alias("gone"), F.coalesce("text", F.lit("")).alias("text"))
    named = changes.where(F.col("channel").isNotNull() & F.col("at").isNotNull())
    now = named.groupBy(F.col("channel").cast("string").alias("channel"), F.round(F.col("at").cast("double"), 6).alias("at"), F.coalesce(F.col("message").cast("string"), F.lit("")).alias("message")).agg(F.max(state).alias("now"))
    return now.where(~F.col("now.gone")).select("channel", "at", "message", F.col("now.text").alias("text"))


def chat_windows(changes: DataFrame, most: int = MOST, overlap: int = OVERLAP, gap: int = GAP) -> DataFrame:
    """Windows of the messages as they stand. A group is a session, found without bringing a channel into one task; only within a session is the budget sequential."""
    live = gap_sessions(latest(changes), "channel", "at", gap)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["at", "message"]).reset_index(drop=True)
        keys, texts = [(round(at * MICROS), m) for at, m in zip(group["at"], group["message"], strict=True)], group["text"].tolist()
        found = window_bounds([k[0] for k in keys], texts, gap * MICROS, most, overlap)
        rows = [(group["channel"][0], window_name(keys[s], keys[e - 1]), keys[s][0] / MICROS, keys[e - 1][0] / MICROS, e - s, "\n".join(texts[s:e])) for s, e, _ in found]
        return pd.DataFrame(rows, columns=["channel", "window_id", "first_at", "last_at", "messages", "text"])

    return live.groupBy("channel", "session").applyInPandas(run, WINDOWS)


class ChatWindows(StatefulProcessor):
    """Keeps a channel's messages and given windows in slots as long as the gap, so that an empty slot always parts two sessions.

    A change reads its slot, goes left to the last window that was opened before the changed message and right to the next empty slot; nothing else of the channel is
    read. Windows that are no longer as given are deleted, then given anew. ``keep_ms`` forgets a slot so long after its last change (None: never); a later
    change of a forgotten message makes a window of its own.
    """

    def __init__(self, most: int, overlap: int, gap: int, keep_ms: int | None):
        self.most, self.overlap, self.gap, self.keep_ms = most, overlap, gap, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.slots = handle.getMapState("slots", "slot long", "at array<long>, message array<string>, version array<double>, gone array<boolean>, text array<string>", self.keep_ms)
        self.given = handle.getMapState("given", "slot long", "window_id array<string>, first_at array<long>, first array<string>, opened_at array<long>, opened array<string>, mark array<long>", self.keep_ms)
        self.seq = handle.getValueState("seq", "seq long")

    def slot(self, at: int) -> int:
        return at // (self.gap * MICROS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        channel, out = key[0], []
        for batch in rows:
            bad = batch["at"].isna() | (channel is None)
            out += [("skipped", m, None, None, 0, t) for m, t in zip(batch["message"][bad], batch["text"][bad], strict=True)]
            touched = self.take(batch[~bad])
            while touched:
                done, found = self.solve(touched[0])
                out += found
                touched = [k for k in touched if self.slot(k[0]) > done]
        if not out:
            return
        seq = self.seq.get()[0] if self.seq.exists() else 0
        self.seq.update((seq + len(out),))
        yield pd.DataFrame([(channel, seq + n, *row) for n, row in enumerate(out)], columns=["channel", "seq", "operation", "window_id", "first_at", "last_at", "messages", "text"])

    def take(self, batch: pd.DataFrame) -> list[tuple[int, str]]:
        """Puts the changes into their slots; gives the messages that they alter, in order."""
        by_slot: dict[int, list] = {}
        for at, message, version, gone, text in batch[["at", "message", "version", "gone", "text"]].itertuples(index=False):
            state = (float("-inf") if pd.isna(version) else float(version), bool(gone) if not pd.isna(gone) else False, "" if pd.isna(text) else text)
            name = round(at * MICROS), "" if pd.isna(message) else message
            by_slot.setdefault(self.slot(name[0]), []).append((name, state))
        touched = set()
        for slot, changes in by_slot.items():
            held = self.held(slot)
            before = len(touched)
            for name, state in changes:
                if name not in held or held[name] < state:
                    held[name] = state
                    touched.add(name)
            if len(touched) > before:
                names = sorted(held)
                self.slots.updateValue((slot,), ([n[0] for n in names], [n[1] for n in names], *([held[n][i] for n in names] for i in range(3))))
        return sorted(touched)

    def held(self, slot: int) -> dict[tuple[int, str], tuple[float, bool, str]]:
        value = self.slots.getValue((slot,)) if self.slots.containsKey((slot,)) else None
        return {} if value is None else {(at, m): (v, g, t) for at, m, v, g, t in zip(*value, strict=True)}

    def windows(self, slot: int) -> list[tuple]:
        """Windows given that begin in this slot: (opened, first, name, mark)."""
        value = self.given.getValue((slot,)) if self.given.containsKey((slot,)) else None
        return [] if value is None else [((oa, o), (fa, f), name, mark) for name, fa, f, oa, o, mark in zip(*value, strict=True)]

    def solve(self, change: tuple[int, str]) -> tuple[int, list[tuple]]:
        """Windows from the last one opened before ``change`` to the next empty slot, against those given; and the last slot looked at."""
        low = self.slot(change[0])
        held, old = {low: self.held(low)}, {low: self.windows(low)}
        while not any(w[0] < change for w in old[low]) and (left := self.held(low - 1)):
            low -= 1
            held[low], old[low] = left, self.windows(low)
        high = self.slot(change[0])
        while right := self.held(high + 1):
            high += 1
            held[high], old[high] = right, self.windows(high)
        live = sorted((name, text) for slot in held.values() for name, (_, gone, text) in slot.items() if not gone)
        names = [name for name, _ in live]
        at = {name: n for n, name in enumerate(names)}
        was = sorted(w for slot in old.values() for w in slot)
        whole = [w for w in was if w[0] < change and w[0] in at and w[1] in at]
        begin, step = (at[whole[-1][1]], at[whole[-1][0]] - at[whole[-1][1]] + 1) if whole else (0, 1)
        names, texts = names[begin:], [text for _, text in live[begin:]]
        if whole:
            was = [w for w in was if w[0] >= whole[-1][0]]
        now = {}
        for s, e, opened in window_bounds([n[0] for n in names], texts, self.gap * MICROS, self.most, self.overlap, step):
            text = "\n".join(texts[s:e])
            name = window_name(names[s], names[e - 1])
            opener = whole[-1][0] if whole and s == 0 and opened == 0 else names[opened]
            now[name] = ((opener, names[s], name, zlib.crc32(repr((e - s, text)).encode("utf-8", "surrogatepass"))), (names[s][0] / MICROS, names[e - 1][0] / MICROS, e - s, text))
        marks = {w[2]: w[3] for w in was}
        out = [("deleted", name, None, None, 0, None) for name in marks if name not in now or now[name][0][3] != marks[name]]
        out += [("modified" if name in marks else "created", name, *row) for name, (w, row) in now.items() if marks.get(name) != w[3]]
        gone_from = {self.slot(w[1][0]) for w in was}
        for slot in gone_from | {self.slot(w[1][0]) for w, _ in now.values()}:
            kept = sorted({w for w in old.get(slot, []) if w not in was} | {w for w, _ in now.values() if self.slot(w[1][0]) == slot})
            if kept:
                self.given.updateValue((slot,), ([w[2] for w in kept], [w[1][0] for w in kept], [w[1][1] for w in kept], [w[0][0] for w in kept], [w[0][1] for w in kept], [w[3] for w in kept]))
            elif slot in old and old[slot]:
                self.given.removeKey((slot,))
        return high, out

    def close(self) -> None:
        pass


def stream_chat_windows(changes: DataFrame, most: int = MOST, overlap: int = OVERLAP, gap: int = GAP, keep_ms: int | None = None) -> DataFrame:
    """Operations on windows (created, modified, deleted, skipped), numbered by channel in ``seq``: a changed window is deleted, then given again.

    After each micro-batch the windows left standing (``standing``) are those of ``chat_windows`` over all changes so far, whatever their order. A channel's changes
    of one batch go to one task, which reads only the slots around them: set ``maxFilesPerTrigger`` or its like for a hot channel. Needs the RocksDB state store. With ``keep_ms`` Spark runs
    batches without data too (to forget), so such a query does not end by itself under ``availableNow``.
    """
    rows = changes.select(F.col("channel").cast("string").alias("channel"), F.col("message").cast("string").alias("message"), F.col("at").cast("double").alias("at"), F.col("version").cast("double").alias("version"), F.col("gone").cast("boolean").alias("gone"), F.col("text").cast("string").alias("text"))
    return rows.groupBy("channel").transformWithStateInPandas(ChatWindows(most, overlap, gap, keep_ms), OPERATIONS, "append", "ProcessingTime" if keep_ms else "None")


def standing(operations: DataFrame) -> DataFrame:
    """The windows left by a log of operations: the last one of each window counts."""
    last = operations.where("operation <> 'skipped'").groupBy("channel", "window_id").agg(F.max_by(F.struct("operation", "first_at", "last_at", "messages", "text"), "seq").alias("now"))
    return last.where("now.operation <> 'deleted'").select("channel", "window_id", "now.first_at", "now.last_at", "now.messages", "now.text")
