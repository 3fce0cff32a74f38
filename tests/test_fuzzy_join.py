"""Similar names against all pairs, for floors with runs of three and of two characters, and with single ones."""

import itertools
import random

import pytest

from kgloom.functions import fuzzy

PARTS = ["an", "na", "li", "mar", "jo", "e", "ö", "st", "ko", "ri", "ab", "ba", "x"]


def names_of(seed, size):
    r = random.Random(seed)
    out = [None, "", "  ", "a", "ab", "abc"]
    for _ in range(size):
        name = " ".join("".join(r.choice(PARTS) for _ in range(r.randint(1, 7))) for _ in range(r.randint(1, 3)))
        out.append(name)
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(name) + 1)
            name = name[:k] + r.choice(["", "e", "na"]) + name[k + r.randint(0, 2) :]
            out.append(name)
    return out


def least(name, floor, by_length):
    n = len(name.strip(" "))
    return max(floor, 100.0 if n < 4 else 95.0 if n < 6 else 88.0) if by_length else floor


@pytest.mark.parametrize(("floor", "by_length"), [(95.0, True), (88.0, False), (81.0, False), (60.0, False)])
def test_blocking_loses_no_pair(spark, floor, by_length):
    rows = list(enumerate(names_of(int(floor), 50)))
    key = lambda name: " ".join(sorted(t for t in name.lower().split() if t))
    heads = {}
    for n, name in rows:
        if name and key(name):
            heads.setdefault(key(name), (n, name))
    want = set()
    for (ka, (a, name_a)), (kb, (b, name_b)) in itertools.combinations(sorted(heads.items(), key=lambda h: h[1]), 2):
        if fuzzy.ratio(ka, kb) >= max(least(name_a, floor, by_length), least(name_b, floor, by_length)):
            want.add((a, b))
    want |= {(heads[key(name)][0], n) for n, name in rows if name and key(name) and heads[key(name)][0] != n}
    got = [(r.a, r.b) for r in fuzzy.similar_pairs(spark.createDataFrame(rows, "id long, name string"), floor, by_length=by_length).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_of_no_names(spark):
    assert fuzzy.similar_pairs(spark.createDataFrame([], "id long, name string"), 88.0).count() == 0
