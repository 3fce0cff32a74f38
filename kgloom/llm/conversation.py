"""Repair of conversations: the cheapest edits that give every conversation the turns ``(s?(ua)+)?``.

A conversation is a path through a DAG whose nodes are (rows passed, state), the state being what was written last: nothing, system, user or assistant. Arcs are the edits of a
row (Keep, Rerole, Delete) and Insert, which passes none. Costs from the start (forward) and to the end (backward) tell the tight arcs: those whose forward cost,
own cost and backward cost add up to the least total. Every path of tight arcs is a cheapest repair; a frontier of states walks them and takes the least letter that leads on.

A conversation of any length is worked on in chunks of at most ``CHUNK`` rows: rows are sorted into ranges, and each chunk of a conversation gives a matrix of
least costs between its first and last states. The matrices of a conversation are combined to the costs at its chunks' borders, with which each chunk finds its own tight
arcs and walks from every state that it may be entered in; a last small step strings the chunks' walks together. So a conversation that holds a third of all rows is no task
of its own. Only roles, faults and hashes are sorted; texts are shuffled once, to the edits that keep them.

Defined cases: a null role or text is one space, and so is a null id or turn where a row's damage is drawn; a null conv_id is one conversation; null turns come first; rows
of one turn go by role, then by the SHA-256 of their text, and equal rows are duplicates of the first; an empty role has no initial and fits no state; a conversation with
no rows left has no edits; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Stored, shuffle_partitions

CHUNK_BITS = 16
CHUNK = 1 << CHUNK_BITS
SEED = 17
NEVER = 1 << 60
KEEP, REROLE, DELETE, INSERT, UNFINISHED = 0, 1, 2, 5, 5
OPEN, SYSTEM, USER, ASSISTANT = STATES = range(4)
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: The state after a row of that initial, and the state that a user's or assistant's turn leads to.
KEPT = {(OPEN, "s"): SYSTEM, (OPEN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
WRITTEN = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: What is left to insert once all rows have passed.
AT_END = (0, 2 * INSERT, INSERT, 0)

SUMMARY = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), *((n, pa.int64()) for n in ("n_blank", "n_duplicate", "n_truncated", "n_illegal")), ("opens", pa.string()), ("closes", pa.string()), ("costs", pa.list_(pa.int64()))])
BORDERS = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("alone", pa.bool_()), ("last", pa.bool_()), ("forward", pa.list_(pa.int64())), ("backward", pa.list_(pa.int64())), ("cost", pa.int64()), ("illegal", pa.int64())])
EDIT = pa.struct([("at", pa.int64()), ("k", pa.int32()), ("edit", pa.string()), ("role", pa.string())])
WALKS = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("alone", pa.bool_()), ("enters", pa.int32()), ("leaves", pa.int32()), ("edits", pa.list_(EDIT))])
CHOSEN = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int64()), ("enters", pa.int32())])
DIGEST = pa.schema([("conv_id", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])


# --- a chunk's arcs


def arcs(state: int, initial: str, fault: int) -> list[tuple[str, int, int]]:
    """letter, state and cost of each edit of a row."""
    out = [("D", state, DELETE)]
    if fault in (NONE, TRUNCATED):
        more = UNFINISHED if fault == TRUNCATED else 0
        if (state, initial) in KEPT:
            out.append(("K", KEPT[state, initial], KEEP + more))
        out.append(("R", WRITTEN[state], REROLE + more))
    return out


_ARCS: dict = {}


def _arcs(initial: str, fault: int) -> list[list[tuple[str, int, int]]]:
    """The arcs from each state."""
    key = initial if initial in ("s", "u", "a") else "", fault
    if key not in _ARCS:
        _ARCS[key] = [arcs(state, *key) for state in STATES]
    return _ARCS[key]


def inserted_before(costs: list[int]) -> list[int]:
    """Least costs of the states after any number of insertions: no more than two pay."""
    user = min(costs[USER], INSERT + min(costs[OPEN], costs[SYSTEM], costs[ASSISTANT]))
    return [costs[OPEN], costs[SYSTEM], user, min(costs[ASSISTANT], INSERT + user)]


def forward(costs: list[int], rows: list[tuple[str, int]]) -> list[list[int]]:
    """Costs of the states before each row and after the last; insertions come before a row."""
    out = [costs]
    for initial, fault in rows:
        before, after = inserted_before(out[-1]), [NEVER] * 4
        for state, leads in zip(STATES, _arcs(initial, fault)):
            for _, to, cost in leads:
                after[to] = min(after[to], before[state] + cost)
        out.append(after)
    return out


def backward(costs: list[int], rows: list[tuple[str, int]]) -> list[list[int]]:
    """Costs from the states before each row, and after the last, to the end."""
    out = [costs]
    for initial, fault in reversed(rows):
        passed = [min(cost + out[-1][to] for _, to, cost in leads) for leads in _arcs(initial, fault)]
        user, assistant = min(passed[USER], INSERT + passed[ASSISTANT]), min(passed[ASSISTANT], INSERT + passed[USER])
        out.append([min(passed[OPEN], INSERT + user), min(passed[SYSTEM], INSERT + user), user, assistant])
    return out[::-1]


def tight(i: int, state: int, row: tuple[str, int] | None, before: list[list[int]], after: list[list[int]], total: int) -> list[tuple[str, int, int]]:
    """letter, rows passed and state of the optimal arcs from a node. ``before`` has the costs with insertions."""
    here = before[i][state]
    out = [] if row is None else [(letter, i + 1, to) for letter, to, cost in _arcs(*row)[state] if here + cost + after[i + 1][to] == total]
    if here + INSERT + after[i][WRITTEN[state]] == total:
        out.append(("I", i, WRITTEN[state]))
    return out


def walk(enters: int, rows: list[tuple[str, int]], before: list[list[int]], after: list[list[int]], total: int) -> tuple[list[list[tuple[str, str | None]]], int]:
    """For each row the letters up to its own, each with the role it writes (none where the row's stays), and the state at the end."""
    i, frontier, out = 0, {enters}, [[] for _ in rows]
    while i < len(rows):
        leads = [a for state in frontier for a in tight(i, state, rows[i], before, after, total)]
        letter = min(a[0] for a in leads)
        at, frontier = i, {to for name, _, to in leads if name == letter}
        i = next(n for name, n, _ in leads if name == letter)
        out[at].append((letter, ROLE[min(frontier)] if letter in "IR" else None))
    return out, min(frontier)


def closing(state: int) -> list[tuple[str, str]]:
    """The insertions after the last row."""
    out = []
    while AT_END[state]:
        state = WRITTEN[state]
        out.append(("I", ROLE[state]))
    return out


# --- streams of sorted rows


def _groups(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[list[dict]]:
    rows, held = [], None
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if rows and key != held:
                yield rows
                rows = []
            held = key
            rows.append(row)
    if rows:
        yield rows


def _sent(rows: Iterable[dict], schema: pa.Schema, most: int = 2048) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 1 + len(row.get("edits", ()))
        if size >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _of(rows: list[dict]) -> list[tuple[str, int]]:
    return [(r["initial"], r["fault"]) for r in rows]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each() -> Iterator[dict]:
        for rows in _groups(batches, "chunk", "conv_id"):
            initials, faults, arcs_of = [r["initial"] for r in rows], [r["fault"] for r in rows], _of(rows)
            costs = [c for state in STATES for c in forward([0 if s == state else NEVER for s in STATES], arcs_of)[-1]]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            yield {"conv_id": rows[0]["conv_id"], "chunk": rows[0]["chunk"], "n_blank": faults.count(BLANK), "n_duplicate": faults.count(DUPLICATE), "n_truncated": faults.count(TRUNCATED), "n_illegal": illegal, "opens": initials[0], "closes": initials[-1], "costs": [min(c, NEVER) for c in costs]}

    return _sent(each(), SUMMARY)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs at both ends of each chunk of a conversation, by its chunks' matrices."""

    def each() -> Iterator[dict]:
        for chunks in _groups(batches, "conv_id"):
            start, end = [[0, NEVER, NEVER, NEVER]], [list(AT_END)]
            for c in chunks:
                start.append([min(start[-1][s] + c["costs"][4 * s + t] for s in STATES) for t in STATES])
            for c in reversed(chunks):
                end.append([min(c["costs"][4 * s + t] + end[-1][t] for t in STATES) for s in STATES])
            end.reverse()
            joints = sum(a["closes"] + b["opens"] not in ("su", "ua", "au") for a, b in zip(chunks, chunks[1:]))
            for k, c in enumerate(chunks):
                yield {"conv_id": c["conv_id"], "chunk": c["chunk"], "alone": len(chunks) == 1, "last": k == len(chunks) - 1, "forward": [min(x, NEVER) for x in start[k]], "backward": [min(x, NEVER) for x in end[k + 1]], "cost": end[0][OPEN], "illegal": c["n_illegal"] + (0 if k else joints)}

    return _sent(each(), BORDERS)


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def each() -> Iterator[dict]:
        for rows in _groups(batches, "chunk", "conv_id"):
            head, arcs_of = rows[0], _of(rows)
            before = [inserted_before(costs) for costs in forward(head["forward"], arcs_of)]
            after = backward(head["backward"], arcs_of)
            for enters in STATES:
                if head["forward"][enters] + after[0][enters] != head["cost"]:
                    continue
                letters, leaves = walk(enters, arcs_of, before, after, head["cost"])
                if head["last"]:
                    letters[-1] += closing(leaves)
                edits = [{"at": r["at"], "k": k, "edit": letter, "role": role} for r, own in zip(rows, letters) for k, (letter, role) in enumerate(own)]
                yield {"conv_id": head["conv_id"], "chunk": head["chunk"], "alone": head["alone"], "enters": enters, "leaves": leaves, "edits": edits}

    return _sent(each(), WALKS)


def _strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each chunk of a conversation is entered: the one that the chunk before leaves."""

    def each() -> Iterator[dict]:
        for rows in _groups(batches, "conv_id"):
            state, walks = OPEN, {(r["chunk"], r["enters"]): r["leaves"] for r in rows}
            for chunk in sorted({r["chunk"] for r in rows}):
                yield {"conv_id": rows[0]["conv_id"], "chunk": chunk, "enters": state}
                state = walks[chunk, state]

    return _sent(each(), CHOSEN)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letters and hash of each conversation, row by row: no text is held."""

    def each() -> Iterator[dict]:
        held, audit, digest, first = None, None, None, True
        done = lambda: {"conv_id": held, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}
        for batch in batches:
            for conv_id, edit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text"))):
                if audit is None or conv_id != held:
                    if audit is not None:
                        yield done()
                    held, audit, digest, first = conv_id, [], hashlib.sha256(), True
                audit.append(edit)
                if edit != "D":
                    digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
        if audit is not None:
            yield done()

    return _sent(each(), DIGEST)


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>", pa.list_(EDIT): "array<struct<at:long,k:int,edit:string,role:string>>"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


# --- tables


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after each row's damage, drawn from its id and turn."""
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), written("role").alias("role"), written("text").alias("text"))
    kind = F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(0), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1))
    return rows.withColumn("kind", kind).withColumn("time", F.explode(times)).select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def _hash(text: str = "text") -> Column:
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def lines(rows: DataFrame) -> DataFrame:
    """Every row without its text, with ``at`` (rising in the order of conversations and turns), its chunk, initial and fault. Stored."""
    filled = F.col("text").rlike(WORD)
    ended = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1).isin(".", "!", "?")
    short = rows.select("conv_id", "turn", "role", _hash().alias("hash"), F.when(~filled, BLANK).when(~ended, TRUNCATED).otherwise(NONE).alias("found"))
    # equal rows are interchangeable: a draw spreads many of them over ranges
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "hash", "salt"]
    ranges = short.withColumn("salt", F.rand(SEED)).repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    placed = Stored(ranges.drop("salt").withColumn("at", F.monotonically_increasing_id()), "placed").df
    first = placed.where(F.col("found") != BLANK).groupBy("conv_id", "role", "hash").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "hash")), "first")
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("hash") == F.col("_hash"))
    fault = F.when((F.col("found") != BLANK) & (F.col("at") > F.col("first")), DUPLICATE).otherwise(F.col("found"))
    return Stored(placed.join(first, same, "left").select("conv_id", "turn", "role", "hash", "at", F.shiftright("at", CHUNK_BITS).alias("chunk"), F.substring("role", 1, 1).alias("initial"), fault.alias("fault")), "lines").df


def _by_chunk(rows: DataFrame) -> DataFrame:
    return rows.repartition("chunk").sortWithinPartitions("chunk", "at")


def _by_conversation(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _same(one: DataFrame, other: DataFrame, *keys: str) -> tuple[DataFrame, Column]:
    """``other`` with its keys renamed, and the condition that they equal those of ``one``; null is a key of its own."""
    renamed = other.withColumnsRenamed({k: f"_{k}" for k in keys})
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return renamed, condition


class Repair:
    """``lines`` (a row for each damaged row with its fault), ``chunks`` (counts and costs) and ``edits`` (conv_id, at, k, edit and the role written, in order of at and k)."""

    def __init__(self, rows: DataFrame):
        self.rows, self.lines = rows, lines(rows)
        small = self.lines.select("conv_id", "chunk", "at", "initial", "fault")
        self.chunks = Stored(_by_chunk(small).mapInArrow(_summaries, _ddl(SUMMARY)), "chunks").df
        self.borders = Stored(_by_conversation(self.chunks, "chunk").mapInArrow(_borders, _ddl(BORDERS)), "borders").df
        borders, same = _same(small, self.borders, "conv_id", "chunk")
        walks = Stored(_by_chunk(small.join(borders, same).drop("_conv_id", "_chunk", "illegal")).mapInArrow(_walks, _ddl(WALKS)), "walks").df
        split = walks.where("not alone").select("conv_id", "chunk", "enters", "leaves")
        strung, same = _same(walks, _by_conversation(split, "chunk").mapInArrow(_strung, _ddl(CHOSEN)), "conv_id", "chunk", "enters")
        taken = walks.where("alone").unionByName(walks.where("not alone").join(strung, same, "left_semi"))
        self.edits = taken.select("conv_id", F.explode("edits").alias("e")).select("conv_id", "e.*")

    def repaired(self) -> DataFrame:
        """conv_id, at, k, edit, role and text: every edit in order of at and k. Deleted rows have neither role nor text, inserted ones an empty text."""
        lines, same = _same(self.edits, self.lines.select("at", F.col("role").alias("old"), "hash"), "at")
        kept = self.edits.where(F.col("edit").isin("K", "R")).join(lines, same).drop("_at")
        # a text that is kept is the first of its role: texts are gathered once for each
        texts = self.rows.withColumn("hash", _hash()).withColumnRenamed("role", "old").groupBy("conv_id", "old", "hash").agg(F.any_value("text").alias("text"))
        texts, same = _same(kept, texts, "conv_id", "old", "hash")
        kept = kept.join(texts, same).select("conv_id", "at", "k", "edit", F.coalesce("role", "old").alias("role"), "text")
        rest = self.edits.where(F.col("edit").isin("I", "D")).select("conv_id", "at", "k", "edit", "role", F.when(F.col("edit") == "I", "").alias("text"))
        return kept.unionByName(rest)


def repair(conversations: DataFrame) -> Repair:
    return Repair(damaged(conversations))


def repair_report(conversations: DataFrame) -> DataFrame:
    """A row for each conversation: gaps, blank, duplicate, truncated, illegal, cost, audit (the edits' letters) and the hash of the repaired rows."""
    done = repair(conversations)
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    turns = done.lines.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    counts = done.chunks.groupBy("conv_id").agg(*(F.sum(f"n_{n}").alias(n) for n in ("blank", "duplicate", "truncated")))
    costs = done.borders.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.max("cost").alias("cost"))
    digests = _by_conversation(done.repaired(), "at", "k").mapInArrow(_digests, _ddl(DIGEST))
    out = ids
    for table in (turns, counts, costs, digests):
        table, same = _same(out, table, "conv_id")
        out = out.join(table, same, "left").drop("_conv_id")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
