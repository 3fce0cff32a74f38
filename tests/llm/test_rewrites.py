"""Passage removal, fill-in-the-middle and conversation repair against brute force and exact round trips."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.llm import conversation, fill_middle, oracles, passages, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(n, rng, pool=60):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


# --- passages


def plain_removal(rows):
    """{row number: kept words} by comparing all phrases in order; equal rows are one document."""
    keyed = sorted({r[:2] for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, out = set(), {}
    for doc_id, text in keyed:
        own = WORD.findall(text or "")
        gone = set()
        for s in range(len(own) - 19):
            phrase = tuple(own[s : s + 20])
            if phrase in seen:
                gone |= set(range(s, s + 20))
            seen.add(phrase)
        out[doc_id, text] = (len(own), len(gone), " ".join(w for k, w in enumerate(own) if k not in gone))
    return out


def passage_rows():
    rng = random.Random(5)
    shared = words(25, rng)
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "a " * 300), (5, "a " * 19), (6, "ä\x85b c \x0b\x1cd")]
    rows += [(10 + k, " ".join([*words(40, rng), *shared, *words(30, rng)])) for k in range(12)]
    # a phrase of exactly twenty words, copies, parts of parts, and a factor that straddles two sources
    rows += [(30, " ".join(shared[:20])), (31, "\n".join(shared[1:21])), (32, " ".join(shared[:19]))]
    one, other = words(60, rng), words(60, rng)
    rows += [(40, " ".join(one)), (41, " ".join(other)), (42, " ".join(one[10:50] + other[5:45])), (43, " ".join(words(5, rng) + one[35:50] + other[5:20])), (44, " ".join(one[40:50] + other[5:16]))]
    rows += [(50, rows[6][1]), (50, rows[6][1]), (51, rows[7][1] + " tail")]
    rows += [(None, " ".join(other))]
    return rows


def test_passages_against_all_phrases(table):
    rows = passage_rows()
    want = plain_removal(rows)
    got = passages.passage_report(table(rows).withColumns({c: F.lit("x") for c in ("hash", "base", "at", "d", "spans", "source", "_hash")})).collect()
    assert len(got) == len(rows)
    left = {k: v for k, v in want.items()}
    for doc_id, text in rows:
        assert (doc_id, *left[doc_id, text]) in {tuple(r) for r in got}
    # the row without an id comes first, so the one with the same words loses them
    assert left[41, rows[[r[0] for r in rows].index(41)][1]][1] == 60


def test_passages_against_all_phrases_of_few_words(table):
    rng = random.Random(8)
    rows = [(k, " ".join(words(rng.randrange(0, 120), rng, pool=1 + k % 3))) for k in range(60)]
    got = {r.doc_id: tuple(r)[1:] for r in passages.passage_report(table(rows)).collect()}
    assert got == {k[0]: v for k, v in plain_removal(rows).items()}


def test_passages_against_sql(spark, table, tmp_path):
    rows = [r for r in passage_rows() if r[0] not in (None, 50)]
    table(rows).write.parquet(str(tmp_path / "documents.parquet"))
    documents = duckdb.connect()
    documents.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, queries.op11_passages(spark, str(tmp_path)).collect())) == sorted(documents.sql(oracles.PASSAGES).fetchall())


def test_dedup_passages_keeps_other_columns(table):
    rows = passage_rows()
    docs = table(rows).withColumns({"d": F.lit(1), "spans": F.lit("s")})
    got = passages.dedup_passages(docs)
    assert got.columns == docs.columns
    want = plain_removal(rows)
    for r in got.collect():
        assert (r.d, r.spans) == (1, "s") and r.n_chars == (None if r.text is None else len(r.text))
        assert r.text is None or any(r.text == v[2] for k, v in want.items() if k[0] == r.doc_id)


def test_equal_phrases_choose_equal_runs():
    rng = random.Random(2)
    own = [w.encode() for w in words(400, rng, pool=3)]
    hashes = passages.word_hashes(own)
    runs, at = passages.anchors(hashes)
    chosen = dict(zip(at.tolist(), runs.tolist()))
    assert len(at) == len(set(at.tolist()))
    stands = {}
    for s in range(len(own) - 19):
        inside = {chosen[k] for k in range(s, s + 11) if k in chosen}
        least = min(np.uint64(x) for x in np.array(sorted(inside), np.int64).view(np.uint64))
        assert stands.setdefault(tuple(own[s : s + 20]), least) == least


@pytest.mark.parametrize("size", [1, 2, 10, 20, 23])
def test_run_hashes_are_polynomials(size):
    hashes = passages.word_hashes([b"%d" % k for k in range(40)])
    base = passages._BASES[1]
    want = [sum(int(h) * pow(base, size - 1 - j, 1 << 64) for j, h in enumerate(hashes[i : i + size])) % (1 << 64) for i in range(40 - size + 1)]
    assert (passages.run_hashes(hashes, size, base) == passages.mixed(np.array(want, np.uint64))).all()


def test_factors_end_where_source_or_text_breaks_off():
    first, n = passages.parse(np.array([3, 4, 5, 6, 9, 10]), np.array([70, 71, 90, 91, 92, 93]))
    assert list(zip(first.tolist(), n.tolist())) == [(0, 2), (2, 2), (4, 2)]
    assert [len(x) for x in passages.parse(np.zeros(0, np.int32), np.zeros(0, np.int64))] == [0, 0]


def test_factors_go_on_over_batches():
    import pyarrow as pa

    names = ["base", "start", "source"]
    rows = [(0, k, 100 + k) for k in range(5)] + [(50, k, 100 + k) for k in range(5, 9)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + 2])], names) for k in range(0, len(rows), 2)]
    out = [tuple(r.values()) for b in passages._parse_documents(iter(batches)) for r in b.to_pylist()]
    assert out == [(0, 0, 24, 100), (50, 5, 23, 105)]


# --- fill-in-the-middle

ODD_TEXTS = [None, "", " ", "a", "  a  ", "ab cd \x85ef\x1cg  ", "x<P>y", "<S>", "\x0b\x0c", "<", "<<P", "a <", "😀 é\n\n ß", "w " * 3000]


def token_lists(text):
    return [m.group() for m in re.finditer(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)]


def test_tokens_are_those_of_the_pattern():
    for text in ODD_TEXTS:
        assert fill_middle.token_ends(text or "") == list(itertools.accumulate(map(len, token_lists(text or ""))))
    assert fill_middle.token_ends("a" + " " * 3_000_000) == [1, 3_000_001]


def test_fill_in_middle_against_brute_force(table):
    rows = [(k, t) for k, t in enumerate(ODD_TEXTS * 12)] + [(7, "again"), (7, "again"), (None, "no id at all")]
    got = fill_middle.fill_in_middle(table(rows).withColumns({c: F.lit(0) for c in ("n", "form", "output", "h1")}))
    back = got.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(back) == len(rows)
    forms = set()
    for (doc_id, text), r in zip(rows, back):
        text = text or ""
        tokens = token_lists(text)
        digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
        low, high = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
        p, m, s = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
        form = "plain" if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50 else "spm" if h4 % 100 < 80 else "psm"
        want = {"plain": text, "spm": f"<S>{s}<P>{p}<M>{m}", "psm": f"<P>{p}<S>{s}<M>{m}"}[form]
        lengths = (None, None) if form == "plain" else (len(p), len(m))
        assert (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) == (doc_id, len(tokens), form, *lengths, want, text)
        forms.add(form)
    assert forms == {"plain", "spm", "psm"}


def test_fill_in_middle_against_sql(spark, table, tmp_path):
    table(list(enumerate(ODD_TEXTS * 5))).write.parquet(str(tmp_path / "documents.parquet"))
    documents = duckdb.connect()
    documents.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(str, map(tuple, queries.op12_fill_middle(spark, str(tmp_path)).collect()))) == sorted(map(str, documents.sql(oracles.FILL_MIDDLE).fetchall()))


# --- conversations


def damage(rows):
    out = []
    for conv_id, turn, role, text in rows:
        name = lambda x: " " if x is None else x
        kind = zlib.crc32(f"{name(conv_id)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv_id, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def cheapest(lines):
    """Least (cost, letters, rows) by a search that expands the least path first: its own method, no tables of costs."""
    queue, done = [(0, "", 0, 0, ())], set()
    while queue:
        cost, letters, i, state, out = heapq.heappop(queue)
        if i == len(lines) and state in (0, 3):
            return cost, letters, out
        if (i, state) in done:
            continue
        done.add((i, state))
        writes = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}[state]
        heapq.heappush(queue, (cost + 5, letters + "I", i, writes[0], (*out, f"{writes[1]}:")))
        if i < len(lines):
            role, text, fault = lines[i]
            heapq.heappush(queue, (cost + 2, letters + "D", i + 1, state, out))
            if fault in ("", "truncated"):
                more = 5 * (fault == "truncated")
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, role[:1]))
                if to:
                    heapq.heappush(queue, (cost + more, letters + "K", i + 1, to, (*out, f"{role}:{text}")))
                heapq.heappush(queue, (cost + 1 + more, letters + "R", i + 1, writes[0], (*out, f"{writes[1]}:{text}")))


def plain_repair(rows):
    out = {}
    after = damage(rows)
    for conv_id in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv_id), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
        seen, lines, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in own:
            filled = WORD.findall(text)
            fault = "blank" if not filled else "duplicate" if (role, text) in seen else "" if filled[-1][-1] in ".!?" else "truncated"
            seen.add((role, text))
            lines.append((role, text, fault))
            if fault:
                counts[fault] += 1
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, letters, written = cheapest(lines)
        out[conv_id] = (gaps, *counts.values(), illegal, cost, letters, hashlib.sha256("\n".join(written).encode()).hexdigest())
    return out


def conversation_rows():
    rng = random.Random(11)
    rows = []
    for conv_id in range(120):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool"])
            text = rng.choice(["Hi.", "Yes!", "no end", "", None, " \n", "Well?", "Ä. ", f"{conv_id}.", f"{turn}. "])
            rows.append((conv_id, rng.choice([turn, turn, turn * 3, None]), role, text))
    rows += [(500, k, ("user", "assistant")[k % 2], f"{k}.") for k in range(300)]
    rows += [(501, 1, "user", "same.")] * 40 + [(None, 1, "user", "x."), (None, None, "assistant", "y")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("bits", [conversation.CHUNK_BITS, 1, 3])
def test_repair_against_a_search(spark, bits, monkeypatch):
    monkeypatch.setattr(conversation, "CHUNK_BITS", bits)
    rows = conversation_rows()
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("at", "hash", "kind", "fault", "chunk", "edit", "alone", "first")})
    got = {r.conv_id: tuple(r)[1:] for r in conversation.repair_report(docs).collect()}
    assert got == plain_repair(rows)


def test_repair_against_sql(spark, tmp_path):
    spark.createDataFrame(conversation_rows(), SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = queries.op13_conversations(spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.sql(oracles.REPAIR).fetchall()))


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "a."), (1, 2, "assistant", "b"), (1, 3, "user", "c.")]
    got = conversation.Repair(spark.createDataFrame(rows, SCHEMA)).repaired().orderBy("at", "k").collect()
    # the third row can't be kept for less than five, nor can the last then be an answer's question
    assert [(r.edit, r.role, r.text) for r in got] == [("K", "user", "a."), ("D", None, None), ("D", None, None), ("R", "assistant", "c.")]


def test_frontier_walks_only_optimal_arcs():
    rng = random.Random(4)
    for _ in range(300):
        rows = [(rng.choice("suax"), rng.randrange(4)) for _ in range(rng.randrange(0, 7))]
        start, end = [0] + [conversation.NEVER] * 3, list(conversation.AT_END)
        before = [conversation.inserted_before(c) for c in conversation.forward(start, rows)]
        after = conversation.backward(end, rows)
        if not rows:
            continue
        letters, leaves = conversation.walk(0, rows, before, after, after[0][0])
        letters[-1] += conversation.closing(leaves)
        faults = ("", "blank", "duplicate", "truncated")
        cost, want, _ = cheapest([(x, "t", faults[f]) for x, f in rows])
        assert (after[0][0], "".join(x for row in letters for x, _ in row)) == (cost, want)


# --- secrets: the SQL of the whole rule on rows that need it


def secret_rows():
    rng = random.Random(21)
    draw = lambda n, chars: "".join(rng.choice(chars) for _ in range(n))
    low = "abcdefghijklmnopqrstuvwxyz0123456789"
    mixed = low + low.upper() + "+/_-"
    key = lambda n: draw(n, mixed)
    rows = [f"the key {key(40)} is here", key(24) + " " + key(19) + " " + key(20), draw(60, "0123456789abcdef"), draw(64, "0123456789ABCDEF") + " x"]
    rows += [f"{key(26)}example{key(26)}", f"{key(30)}xxxxxx{key(9)}", f"{key(28)}AAAaAAAA{key(30)}", f"EXAMPLE{key(25)}", f"{key(30)}0123456789{key(30)} ä😀 {key(33)}"]
    rows += [f"password={key(30)} and {key(30)}", f"{key(25)}token={key(40)}", f"AKIA{draw(20, low.upper())}{key(30)}", f"{key(30)}AKIA{draw(16, 'ABCDEFGH2345')}/{key(25)}", f"{key(22)}{draw(30, '0123456789abcdef')}{key(22)}"]
    rows += ["123e4567-e89b-42d3-a456-426614174000", "a" * 50, "Supercalifragilisticexpialidociouswords", "1234567890123456789012345", None, "", f"secret: 'x' api_key = \"{key(50)}\""]
    for _ in range(60):
        parts = [key(rng.randrange(5, 45)) for _ in range(4)] + ["example", "placeholder", "xxxxxxx", "token=", "password: ", "zzzzzzzzz", " ", " word ", "AKIA", "\n", draw(26, "0123456789abcdef"), "é"]
        rows.append("".join(rng.choice(parts) for _ in range(rng.randrange(2, 9))))
    return list(enumerate(rows))


def test_secrets_against_sql_where_windows_matter(spark, table, tmp_path):
    table(secret_rows()).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = {r[0]: tuple(r) for r in queries.op3_secrets(spark, str(tmp_path)).collect()}
    want = {r[0]: r for r in con.sql(queries.ORACLE["op3_secrets"]).fetchall()}
    assert got == want
    kinds = {k.split(":")[0] for r in got.values() for k in r[5].split(",") if k}
    assert kinds == {"assign", "access", "hex", "entropy", "rest"} and sum(r[6] for r in got.values()) > 40
