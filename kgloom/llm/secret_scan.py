"""Secret scans in SQL functions: fixed patterns, and sliding-window Shannon entropy for each character class.

Base spans are the leftmost non-overlapping matches of three patterns; those that are too short go after matching. Candidates of the method are maximal runs of a
character class (``CLASSES``) of at least ``WINDOW`` characters. A window slides over each: its counts, one for each character of the class, are kept, and a step lowers that of the
character that leaves and raises that of the one that enters; the sum of c * log2(c) moves with them, and entropy = log2(W) - sum / W. Windows at or over the class's
threshold that hold no allowed part (``PART``: alphabets, placeholders) are merged, over all classes, into spans of kind ``entropy``. Allowed parts and base spans, which
are reported already, are cut out of a merged span; what remains of it is kept, unless it, or the merged span, is allowed as a whole (plain words, plain numbers, UUIDs).
What base spans leave of a merged span is of kind ``rest``, so ``entropy`` and n_entropy mean spans that no base span touches.

Everything is one projection: no shuffle, no Python. Positions are code points, ends exclusive. Positions are running totals, overlaps are found by binary search and long
strings are walked in blocks, so the cost follows the text's length (times its logarithm), not its square.

Defined cases: a null text is empty and has no span; every text is scanned whole; repeated rows give repeated results; an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import SPANS, let, overlapping, running, union, without

#: The base patterns, in the order of kinds, and the least length of what they match.
KEYWORDS = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
HEAD = rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?"""
ASSIGN = HEAD + "([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
LEAST_VALUE = 6
KINDS = ("assign", "access", "hex", "entropy", "rest")

WINDOW = 20
#: Characters of a candidate that are walked at a time: a character's place costs a walk from the start of its block, so blocks keep long candidates linear.
BLOCK = 512
#: Class: its characters and the entropy in bits that a window must reach.
CLASSES = {"hex": ("[0-9A-Fa-f]", 3.0), "alphanumeric": ("[A-Za-z0-9]", 3.7), "base64": ("[A-Za-z0-9+/_-]", 3.9)}
DIGITS, LETTERS = string.digits, string.ascii_letters
ALPHABETS = {"hex": DIGITS + "ABCDEFabcdef", "alphanumeric": DIGITS + LETTERS, "base64": DIGITS + LETTERS + "+/_-"}
#: Strings that are no secrets: three that are so as a whole, and parts that are so wherever they occur.
ALLOWED = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)0123456789|abcdefghij|example|placeholder|changeme|x{6}|(.)\1{7}",
)
WHOLE, PART = ALLOWED[:-1], ALLOWED[-1]


def _found(text: Column, pattern: str, keep=lambda m: F.lit(True)) -> Column:
    """start, end and string of each match, in order. The text between matches and the matches add up to positions."""

    def placed(x: Column) -> Column:
        lengths = F.zip_with(x["pieces"], x["matches"], lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0)))
        spans = F.zip_with(running(lengths, lambda a, b: a + b), x["matches"], lambda e, m: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m")))
        return F.filter(spans, lambda f: f["m"].isNotNull() & keep(f["m"]))  # what follows the last match has none

    return let(text, lambda t: let(F.struct(F.split(t, pattern, -1).alias("pieces"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("matches")), placed))


def _blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))


def _cut(blocks: Column, s: Column, e: Column) -> Column:
    """The characters from s to e of a text in blocks: the walk to them begins at their own block."""
    first = F.floor(s / BLOCK).cast("int")
    last = F.floor((e - 1) / BLOCK).cast("int")
    return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), s - first * BLOCK + 1, e - s)


def _high(candidate: Column, threshold: float, alphabet: str = ALPHABETS["base64"]) -> Column:
    """Runs (s, e), relative to the candidate, of windows whose entropy reaches the threshold and that hold no allowed part.

    The window's counts are kept in a string with a place for each character of the alphabet: a step lowers the count of the character that leaves by one and
    raises that of the one that enters, and moves the sum of c * log2(c) by the two differences.
    """
    most = WINDOW * (math.log2(WINDOW) - threshold) + 1e-9
    size = lambda c: c * math.log2(c) if c else 0.0
    #: What the sum gains when a count rises from c, by c + 1; counts are written as characters from @ (none) on.
    gains = F.expr(f"array({', '.join(f'{size(c + 1) - size(c)!r}D' for c in range(WINDOW))})")
    written = "".join(chr(64 + c) for c in range(WINDOW + 1))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit("@" * len(alphabet)).alias("counts"), F.lit("").alias("hits"))

    def walked(places: Column) -> Column:
        def step(state: Column, k: Column) -> Column:
            enters, leaves = F.get(places, k - 1), F.get(places, k - 1 - WINDOW)
            full = k > WINDOW
            same = full & (enters == leaves)
            slot = lambda place: F.substring(state["counts"], place, F.lit(1))
            rise = F.overlay(state["counts"], F.translate(slot(enters), written[:-1], written[1:]), enters)
            moved = F.when(full, F.overlay(rise, F.translate(slot(leaves), written[1:], written[:-1]), leaves)).otherwise(rise)
            gained = F.get(gains, F.ascii(slot(enters)) - 64) - F.when(full, F.get(gains, F.ascii(slot(leaves)) - 65)).otherwise(0.0)
            total = F.when(same, state["sum"]).otherwise(state["sum"] + gained)
            hit = (k >= WINDOW) & (total <= most) & ~F.substring(candidate, k - WINDOW + 1, F.lit(WINDOW)).rlike(PART)
            return F.struct(total.alias("sum"), F.when(same, state["counts"]).otherwise(moved).alias("counts"), F.concat(state["hits"], F.when(hit, "1").otherwise("0")).alias("hits"))

        return F.aggregate(F.sequence(F.lit(1), F.size(places)), start, step)["hits"]

    places = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c))
    hits = F.when(F.length(candidate) >= WINDOW, let(places, walked)).otherwise("")
    return union(F.transform(_found(hits, "1+"), lambda f: F.struct((f["s"] + 1 - WINDOW).alias("s"), f["e"].alias("e"))))


def _high_in_blocks(candidate: Column, threshold: float, alphabet: str) -> Column:
    """As ``_high``, block by block: each block goes on into the next one by a window less one character, so that every window lies in the block it starts in."""

    def in_blocks(parts: Column) -> Column:
        blocks = F.zip_with(parts, F.slice(parts, F.lit(2), F.size(parts)), lambda part, following: F.concat(part, F.coalesce(F.substring(following, 1, WINDOW - 1), F.lit(""))))
        shifted = lambda block, i: F.transform(_high(block, threshold, alphabet), lambda h: F.struct((h["s"] + i * BLOCK).alias("s"), (h["e"] + i * BLOCK).alias("e")))
        return F.flatten(F.transform(blocks, shifted))

    return let(_blocks(candidate), in_blocks)


def _entropy_spans(run: Column, base: Column, starts: Column, ends: Column) -> Column:
    """Spans of one candidate of the widest class; the other classes' candidates lie within it. ``base``: all base spans, merged, and their ends."""

    def of_class(name: str) -> Column:
        chars, threshold = CLASSES[name]
        runs = F.array(F.struct(F.lit(0).alias("s"), run["e"].alias("e"), run["m"].alias("m"))) if name == "base64" else _found(run["m"], f"{chars}{{{WINDOW},}}", keep=_mixed)
        # lambdas of one parameter only: a second one would be given the element's index
        placed = lambda r: F.transform(_high_in_blocks(r["m"], threshold, ALPHABETS[name]), lambda h: F.struct((r["s"] + h["s"]).alias("s"), (r["s"] + h["e"]).alias("e")))
        return F.flatten(F.transform(runs, placed))

    def spans(blocks: Column) -> Column:
        def suspicious(x: Column) -> Column:
            return let(_cut(blocks, x["s"], x["e"]), lambda string: ~(string.rlike(WHOLE[0]) | string.rlike(WHOLE[1]) | string.rlike(WHOLE[2])))

        def remains(x: Column) -> Column:
            # an allowed part may begin before the span or end after it: windows that hold it whole are not in the span
            first = F.greatest(x["s"] - WINDOW, F.lit(0))
            allowed = F.transform(_found(_cut(blocks, first, F.least(x["e"] + WINDOW, run["e"] - run["s"])), PART), lambda f: F.struct((first + f["s"]).alias("s"), (first + f["e"]).alias("e")))
            inside = F.filter(allowed, lambda f: (f["s"] < x["e"]) & (x["s"] < f["e"]))
            in_text = F.struct((run["s"] + x["s"]).alias("s"), (run["s"] + x["e"]).alias("e"))
            taken = F.transform(overlapping(in_text, base, starts, ends), lambda b: F.struct((b["s"] - run["s"]).alias("s"), (b["e"] - run["s"]).alias("e")))
            return let(taken, lambda b: kept(x, inside, b))

        def kept(x: Column, inside: Column, taken: Column) -> Column:
            left = F.filter(without(x, union(F.concat(inside, taken))), suspicious)
            kind = F.when(F.size(taken) > 0, KINDS.index("rest")).otherwise(KINDS.index("entropy"))
            return F.transform(left, lambda k: F.struct((run["s"] + k["s"]).alias("s"), kind.alias("kind"), (run["s"] + k["e"]).alias("e")))

        return F.flatten(F.transform(F.filter(union(F.concat(*map(of_class, CLASSES))), suspicious), remains))

    return let(_blocks(run["m"]), spans)


def _mixed(m: Column) -> Column:
    return m.rlike("[0-9]") & m.rlike("[A-Za-z]")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_entropy for every row of ``docs``."""
    text = F.col("_text")
    empty = F.array().cast("array<struct<s:int,e:int,m:string>>")
    # matching is worked out only where a cheaper test of the whole text says that there may be a match
    value = lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= LEAST_VALUE
    assign = F.when(text.rlike(HEAD), _found(text, ASSIGN, value)).otherwise(empty)
    access = F.when(text.contains("AKIA"), _found(text, ACCESS)).otherwise(empty)
    hex_ = F.when(text.rlike(HEX), _found(text, HEX)).otherwise(empty)
    label = lambda spans, kind: F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("kind"), x["e"].alias("e")))
    written = lambda spans: F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["s"], x["e"])), ",")
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("_text")).select("doc_id", "_text", assign.alias("_assign"), access.alias("_access"), hex_.alias("_hex"))
    base = found.withColumn("_base", F.concat(label(F.col("_assign"), 0), label(F.col("_access"), 1), label(F.col("_hex"), 2)))
    nothing = F.array().cast("array<struct<s:int,kind:int,e:int>>")
    run = f"{CLASSES['base64'][0]}{{{WINDOW},}}"
    runs = base.withColumn("_runs", F.when(text.rlike(run), _found(text, run, keep=_mixed)).otherwise(empty))
    islands = runs.withColumn("_islands", F.when(F.size("_runs") > 0, union(F.transform("_base", lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"))))).otherwise(F.array().cast(SPANS)))
    edges = islands.withColumns({"_starts": F.transform("_islands", lambda b: b["s"]), "_ends": F.transform("_islands", lambda b: b["e"])})
    found_more = F.flatten(F.transform("_runs", lambda r: _entropy_spans(r, F.col("_islands"), F.col("_starts"), F.col("_ends"))))
    more = edges.withColumn("_more", F.when(F.size("_runs") > 0, found_more).otherwise(nothing))
    return more.select(
        "doc_id",
        F.size("_assign").cast("long").alias("n_assign"),
        F.size("_access").cast("long").alias("n_access"),
        F.size("_hex").cast("long").alias("n_hex"),
        F.sha2(written(F.col("_base")), 256).alias("base_sha256"),
        written(F.concat("_base", "_more")).alias("spans"),
        F.size(F.filter("_more", lambda x: x["kind"] == KINDS.index("entropy"))).cast("long").alias("n_entropy"),
    )
