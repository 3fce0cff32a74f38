"""Words within two edits, exchanges included, and names ranked by them, against brute force."""

import math
import random
import re
from collections import Counter

from kgloom.operators import ranked_words as R


def osa(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def damaged(word, rng):
    for _ in range(rng.randrange(4)):
        k = rng.randrange(len(word) + 1)
        kind = rng.randrange(4)
        word = [word[:k] + word[k + 1 :], word[:k] + "ü" + word[k:], word[:k] + "x" + word[k + 1 :], word[:k] + word[k : k + 2][::-1] + word[k + 2 :]][kind]
    return word


def test_near_words_equal_all_pairs(spark):
    rng = random.Random(8)
    left = ["".join(rng.choice("abé") for _ in range(rng.choice((1, 2, 3, 5, 12, 13, 14, 15, 16, 40)))) for _ in range(60)] + ["ca", "abcdefghijklmnop"]
    right = [w for w in (damaged(rng.choice(left), rng) for _ in range(150)) if w] + ["abc", "ac", "badcefghijklmnop"]
    frame = lambda words: spark.createDataFrame([(w,) for w in words], "word string")
    got = [tuple(r) for r in R.near_words(frame(left), frame(right)).collect()]
    want = {(a, b, osa(a, b)) for a in left for b in right if osa(a, b) <= 2 and osa(a, b) < min(len(a), len(b))}
    assert set(got) == want and len(got) == len(want)
    assert ("abcdefghijklmnop", "badcefghijklmnop", 2) in want and ("ca", "ac", 1) in want and not any(x[:2] == ("ca", "abc") for x in want)


def test_numbers_meet_without_python_and_keep_exchanges(spark):
    frame = lambda words: spark.createDataFrame([(w,) for w in words], "word string")
    rng = random.Random(3)
    left = [f"{rng.randrange(3000):07d}" for _ in range(30)] + ["a", "ab", "ba", "abc", "cab", "abcd", "badc"]
    right = [f"{k:07d}" for k in range(0, 3000, 3)] + ["b", "ba", "bac", "acb", "cabx", "bxa", "bdac", "badc", "x", "bad"]
    found = R.near_words(frame(left), frame(right))
    got = [tuple(r) for r in found.collect()]
    want = {(a, b, osa(a, b)) for a in left for b in right if osa(a, b) <= 2 and osa(a, b) < min(len(a), len(b))}
    assert set(got) == want and len(got) == len(want)
    short = R._met_by_patterns(frame(left), frame(right), True)
    assert "EvalPython" not in short._jdf.queryExecution().executedPlan().toString()


def test_ranked_candidates_equal_brute_force(spark):
    names = ["Spark Summit Berlin", "Spark", "spark spark event", "Kafka Summit", "Berlin office", "!!", "Ünder", None]
    entities = spark.createDataFrame([(n, None if k % 2 else "Event", None if k % 3 else 0.5) for k, n in enumerate(names)], "name string, type string, confidence double")
    asked = {"a": ["Sprak sumit"], "b": ["zzzzzz"], "c": ["berlin", "Office!"], "d": [None], None: ["ünedr"]}
    rows = [(k, n) for k, ns in asked.items() for n in ns]
    got = {(r.k, r.name): r for r in R.candidates(spark.createDataFrame(rows, "k string, name string"), R.build(entities), entities, ["k"]).collect()}
    words = {n: re.findall(r"[^\W_]+", n.lower()) for n in names if n}
    words = {n: w for n, w in words.items() if w}
    mean = sum(map(len, words.values())) / len(words)
    frequency = Counter(w for ws in words.values() for w in set(ws))
    want = {}
    for k, ns in asked.items():
        for q in {w for n in ns if n for w in re.findall(r"[^\W_]+", n.lower())}:
            for near, n in frequency.items():
                if osa(q, near) <= 2 and osa(q, near) < min(len(q), len(near)):
                    idf = math.log(1 + (len(words) - n + 0.5) / (n + 0.5)) * (1 - osa(q, near) / min(len(q), len(near)))
                    for name, ws in words.items():
                        if t := ws.count(near):
                            want[k, name] = want.get((k, name), 0) + idf * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * len(ws) / mean))
    assert {x for x in got if x[1] is not None} == set(want) and all(abs(got[x].score - s) < 1e-9 for x, s in want.items())
    assert {x[0] for x in got if x[1] is None} == {"b", "d"} and (None, "Ünder") in want
    assert got["a", "Spark"].type == "Concept" and got["a", "Spark Summit Berlin"].type == "Event" and got["a", "Spark"].confidence == 0.75
    assert R.candidates(spark.createDataFrame([], "k string, name string"), R.build(entities), entities, ["k"]).count() == 0
    assert [r.name for r in R.candidates(spark.createDataFrame(rows, "k string, name string"), R.build(entities.limit(0)), entities, ["k"]).collect()] == [None] * 5
