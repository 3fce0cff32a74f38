"""Names found by words that are spelt alike: an index of words, and equi-joins that find every word within two edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Edits that a fuzzy word allows, type and confidence of an entity that has none.
MOST_EDITS, TYPE, CONFIDENCE = 2, "Concept", 0.75


def words(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def word_index(entities: DataFrame, name_col: str = "name") -> DataFrame:
    """(word, name): a row for each word of each name; stored once, it answers any number of queries."""
    return entities.where(F.col(name_col).isNotNull()).select(F.explode(words(F.col(name_col))).alias("word"), F.col(name_col).alias("name")).distinct()


def _pieces(word: Column, count: int) -> Column:
    """A word in ``count`` pieces. Edits that break fewer leave one whole, and at most two places from where it was. Empty pieces are left out (see ``near_words``)."""
    n = F.length(word)
    cut = lambda k: F.floor(n * k / count).cast("int")
    parts = F.transform(F.array(*map(F.lit, range(count))), lambda k: F.struct(k.alias("k"), cut(k).alias("at"), F.substring(word, cut(k) + 1, cut(k + 1) - cut(k)).alias("piece")))
    return F.filter(parts, lambda p: p["piece"] != "")


def _met_by_pieces(left: DataFrame, right: DataFrame, count: int = 3, shortest: int = 1) -> DataFrame:
    """(word, near) that share a piece of the right word, by its number, that word's length and a place in reach."""
    b = right.select(F.col("word").alias("near")).distinct().withColumn("n", F.length("near")).select("near", "n", F.inline(_pieces(F.col("near"), count)))
    a = left.select("word").distinct().withColumn("m", F.length("word"))
    # every length in reach, and in it every place in reach of every piece
    reach = a.select("word", F.explode(F.sequence(F.greatest(F.lit(1), F.col("m") - MOST_EDITS), F.col("m") + MOST_EDITS)).alias("n")).where(F.col("n") >= shortest)
    cut = lambda k: F.floor(F.col("n") * k / count).cast("int")
    placed = reach.select("word", "n", F.explode(F.array(*map(F.lit, range(count)))).alias("k")).withColumn("at", cut(F.col("k"))).withColumn("size", cut(F.col("k") + 1) - F.col("at")).where("size > 0")
    probes = placed.select("word", "n", "k", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - MOST_EDITS), F.col("at") + MOST_EDITS)).alias("p"), "size")
    probes = probes.select("word", "n", "k", F.expr("substring(word, p + 1, size)").alias("piece"), "size").where("length(piece) = size").distinct()
    return probes.join(b, ["n", "k", "piece"]).select("word", "near").distinct()


#: What stands for any one character in a pattern; no word has it.
ANY = "\0"
#: Words of up to SHORT characters meet by patterns and those from LONG by pieces; pairs that differ by two characters at most fall into one of both.
SHORT, LONG = 14, 13


def _less_one(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def _each(words: Column, of) -> Column:
    return F.array_distinct(F.flatten(F.transform(words, of)))


def _hidden(word: Column) -> Column:
    """A word with each of its characters hidden: what is left, and the character."""
    one = lambda i: F.struct(F.concat(F.substring(word, F.lit(1), i - 1), F.lit(ANY), F.substring(word, i + 1, F.length(word))).alias("of"), F.substring(word, i, F.lit(1)).alias("x"), F.lit("").alias("y"))
    return F.transform(F.sequence(F.lit(1), F.length(word)), one)


def _hidden_twice(word: Column) -> Column:
    n = F.length(word)

    def two(i: Column, j: Column) -> Column:
        left = F.concat(F.substring(word, F.lit(1), i - 1), F.lit(ANY), F.substring(word, i + 1, j - i - 1), F.lit(ANY), F.substring(word, j + 1, n))
        return F.struct(left.alias("of"), F.substring(word, i, F.lit(1)).alias("x"), F.substring(word, j, F.lit(1)).alias("y"))

    return F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(i + 1, n), lambda j: two(i, j))))


def _exchanged(word: Column, start: Column | None = None) -> Column:
    """A word with each two neighbours exchanged that differ, those from ``start`` on, and the place of the first."""
    n, start = F.length(word), F.lit(1) if start is None else start
    swap = lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.lit(1)), F.substring(word, i, F.lit(1)), F.substring(word, i + 2, n))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: (i >= start) & (i < n) & (F.substring(word, i, F.lit(1)) != F.substring(word, i + 1, F.lit(1))))
    return F.transform(places, lambda i: F.struct(swap(i).alias("word"), i.alias("at")))


def _patterns(word: Column, others: Column, asked: bool, exchanges: bool) -> Column:
    """How a word may meet words of the lengths ``others``: a kind and a pattern, the characters hidden in it, and how many edits that stands for. Kinds that no length calls for are left out."""
    n, none = F.length(word), F.array().cast("array<struct<key:string,x:string,y:string,edits:int,head:string,tail:string>>")

    def told(kind: str, edits: int, of: Column, x: Column | None = None, y: Column | None = None, head: Column | None = None, tail: Column | None = None) -> Column:
        text = lambda c: F.lit(None).cast("string") if c is None else c
        return F.struct(F.concat(F.lit(kind), of).alias("key"), text(x).alias("x"), text(y).alias("y"), F.lit(edits).alias("edits"), text(head).alias("head"), text(tail).alias("tail"))

    plain = lambda kind, edits, words: F.transform(words, lambda w: told(kind, edits, w))
    hidden = lambda kind, edits, found: F.transform(found, lambda h: told(kind, edits, h["of"], h["x"], h["y"]))
    veiled = lambda words: _each(words, lambda w: F.transform(_hidden(w), lambda h: h["of"]))
    less_two = lambda: _each(_less_one(word), _less_one)
    by = lambda more, least, found: F.when(F.array_contains(others, n + more) & (F.least(n, n + more) >= least), found).otherwise(none)
    itself, one = F.array(word), F.array_distinct(_less_one(word))
    # L and l, T and t: kinds by which word is the longer one, that asked for or the other
    longer, shorter, twice, half = ("L", "l", "T", "t") if asked else ("l", "L", "t", "T")
    parts = [
        by(0, 1, plain("0", 0, itself)),
        by(0, 2, hidden("1", 1, _hidden(word))),
        by(0, 3, hidden("2", 2, _hidden_twice(word))),
        by(0, 3, plain("D", 2, one)),
        by(-1, 2, plain(longer, 1, one)),
        by(1, 2, plain(shorter, 1, itself)),
        by(-1, 3, plain(longer + "?", 2, veiled(one))),
        by(1, 3, plain(shorter + "?", 2, veiled(itself))),
        by(-2, 3, plain(twice, 2, less_two())),
        by(2, 3, plain(half, 2, itself)),
    ]
    if asked and exchanges:
        swapped = _exchanged(word)
        again = F.flatten(F.transform(swapped, lambda s: F.transform(_exchanged(s["word"], s["at"] + 2), lambda t: t["word"])))
        # no part is edited twice: what is put in comes after the exchanged two or before them
        apart = lambda s: told(shorter, 2, s["word"], head=F.substring(s["word"], F.lit(1), s["at"] + 1), tail=F.substring(s["word"], s["at"], n))
        parts += [
            by(0, 2, plain("0", 1, F.transform(swapped, lambda s: s["word"]))),
            by(0, 3, plain("0", 2, again)),
            by(0, 3, F.flatten(F.transform(swapped, lambda s: hidden("1", 2, _hidden(s["word"]))))),
            by(1, 3, F.transform(swapped, apart)),
            by(-1, 3, plain(longer, 2, _each(swapped, lambda s: _less_one(s["word"])))),
        ]
    return F.concat(*parts)


def _meetings(left: DataFrame, right: DataFrame, exchanges: bool) -> DataFrame:
    """Rows of words that share a pattern."""
    # few bytes make many pairs, so the parts are not joined by their size
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = left.select("word").distinct().repartition(parts, "word"), right.select(F.col("word").alias("near")).distinct().repartition(parts, "near")
    lengths = lambda words, name: F.broadcast(words.agg(F.collect_set(F.length(name)).alias("lengths")))  # noqa: E731  one row of at most SHORT numbers
    asks = a.crossJoin(lengths(b, "near")).select("word", F.inline(_patterns(F.col("word"), F.col("lengths"), True, exchanges)))
    answers = b.crossJoin(lengths(a, "word")).select("near", F.inline(_patterns(F.col("near"), F.col("lengths"), False, exchanges))).select("near", "key", F.col("x").alias("u"), F.col("y").alias("v"))
    return asks.repartition(parts, "key").join(answers.repartition(parts, "key"), "key")


def _met_by_patterns(left: DataFrame, right: DataFrame, exchanges: bool) -> DataFrame:
    """(word, near, edits) of all words within two edits, fewer than either has characters, and no others. Equal words and words of one length that differ in one or two places meet once,
    on what is left of them when just these places are hidden; so what is met is about what is found, however alike the words begin."""
    differ = (F.col("x").isNull() | (F.col("x") != F.col("u"))) & (F.col("y").isNull() | (F.col("y") == "") | (F.col("y") != F.col("v")))
    apart = F.col("head").isNull() | F.col("near").startswith(F.col("head")) | F.col("near").endswith(F.col("tail"))
    return _meetings(left, right, exchanges).where(differ & apart).groupBy("word", "near").agg(F.min("edits").alias("edits"))


def near_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """(word, near) of all words of ``right`` that are at most two edits, and fewer edits than either has characters, from one of ``left``.

    Nothing is compared with everything and nothing is lost: short words meet on patterns that stand for their edits, long ones on a piece of the right word, its number and that word's length.
    """
    edits = F.levenshtein("word", "near")
    short, long = (lambda df: df.where(F.length("word") <= SHORT)), (lambda df: df.where(F.length("word") >= LONG))
    by_pieces = _met_by_pieces(long(left), long(right), 3, LONG).where((edits <= MOST_EDITS) & (F.greatest(F.length("word"), F.length("near")) > SHORT))
    return _met_by_patterns(short(left), short(right), False).select("word", "near").unionByName(by_pieces)


def candidates(names: DataFrame, index: DataFrame, entities: DataFrame, by: list[str]) -> DataFrame:
    """Entities (name, type, confidence) of which a word is near one of the names wanted by each key ``by``. A key whose names have no near entity gets none:
    the caller then takes all of them, as it does where no index answers. Rows without a type or confidence get the defaults."""
    wanted = names.select(*by, F.explode(words(F.col("name"))).alias("word")).distinct()
    named = near_words(wanted, index).join(index.select(F.col("word").alias("near"), "name"), "near").select("word", "name")
    hits = named.join(wanted, "word").select(*by, "name").distinct()
    told = entities.select("name", F.coalesce("type", F.lit(TYPE)).alias("type"), F.coalesce("confidence", F.lit(CONFIDENCE)).alias("confidence"))
    return hits.join(told, "name").select(*by, "name", "type", "confidence")
