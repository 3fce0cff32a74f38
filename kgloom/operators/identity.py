"""Identity resolution: pairs by mail, chat id and name, bridges to persons, cross-source matches, curation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy, text as T, vectors as V
from ..tables import written
from . import graph

PERSON_FLOOR, BRIDGE_FLOOR, FIND_FLOOR, COSINE_FLOOR = 95.0, 93.0, 90.0, 0.92


def same_as(pairs: DataFrame, kind: str, confidence: Column | float = 1.0) -> DataFrame:
    """Identity edges of pairs (a, b)."""
    value = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return pairs.select(
        F.lit("Person").alias("src_label"), F.col("a").alias("src_id"), F.lit("SAME_AS").alias("rel"), F.lit("Person").alias("dst_label"), F.col("b").alias("dst_id"),
        F.lit(kind).alias("match_type"), value.alias("confidence"), F.lit(True).alias("cross_source"),
    )


def _unblocked(pairs: DataFrame, never: DataFrame, how: str = "left_anti") -> DataFrame:
    """Pairs (a, b) that ``never`` does not hold either way round; ``left_semi``: those that it does hold."""
    both = never.select("a", "b").unionByName(never.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    return pairs.join(both, ["a", "b"], how)


def by_key(persons: DataFrame, key: Column, kind: str, never: DataFrame | None = None, id_col: str = "source_id") -> DataFrame:
    """Identity edges among persons of one key. Each is tied to the least of the group, not to all: components are the same, and k persons cost k - 1 edges.

    Persons blocked with the least one are tied to the least of its partners they are not blocked with, and are then a group of their own, until none is left.
    """
    keyed = persons.select(F.col(id_col).alias("b"), key.alias("key")).where("key IS NOT NULL AND key <> ''")
    tied = lambda group: group.join(group.groupBy("key").agg(F.min("b").alias("a"), F.count("*").alias("n")).where("n > 1"), "key").where("a <> b").select("key", "a", "b")
    pairs = tied(keyed)
    if never is None:
        return same_as(pairs.select("a", "b"), kind)
    out = _unblocked(pairs, never).select("a", "b")
    while True:
        rest = written(_unblocked(pairs, never, "left_semi").select("key", "b").distinct(), "blocked")
        if rest.isEmpty():
            return same_as(out.distinct(), kind)
        partners = _unblocked(pairs, never).select("key", F.col("b").alias("a"))
        links = _unblocked(rest.join(partners, "key").where("a <> b"), never).groupBy("key", "b").agg(F.min("a").alias("a"))
        pairs = written(tied(rest), "tied")
        out = out.unionByName(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).unionByName(_unblocked(pairs, never).select("a", "b"))


def by_email(persons: DataFrame, never: DataFrame | None = None) -> DataFrame:
    return by_key(persons, T.canonical_email(F.col("email")), "email", never)


def by_chat_id(persons: DataFrame, never: DataFrame | None = None) -> DataFrame:
    return by_key(persons, F.when(F.col("slack_user_id").isNotNull(), F.concat_ws("/", "team_id", "slack_user_id")), "slack_user_id", never)


def by_name(persons: DataFrame, never: DataFrame | None = None) -> DataFrame:
    """Fuzzy names at 95 or what their length asks for. Equal names keep their links where blocks hit the first; similar ones are tied through the first of each name alone."""
    pairs = fuzzy.similar_pairs(persons, PERSON_FLOOR, "source_id", "name")
    if never is not None:
        equal = by_key(persons, fuzzy.token_sorted(F.col("name")), "fuzzy_name", never).select(F.col("src_id").alias("a"), F.col("dst_id").alias("b"), F.lit(100.0).alias("score"))
        pairs = _unblocked(pairs, never).select("a", "b", "score").unionByName(equal).distinct()
    return same_as(pairs, "fuzzy_name", F.col("score") / 100.0)


def longest_names(persons: DataFrame, key: Column) -> DataFrame:
    """The longest name of each key, the first of equals by id."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc(F.length("name")), "source_id")) == 1
    return persons.withColumn("key", key).where("key IS NOT NULL AND name IS NOT NULL").withColumn("best", rank).where("best").select("key", "name")


def best_matches(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """Each left name's best right name at or over the floor and its own threshold, ties to the first: (left_id, right_id, score)."""
    tagged = left.select(F.concat(F.lit("l:"), "id").alias("id"), "name").unionByName(right.select(F.concat(F.lit("r:"), "id").alias("id"), "name"))
    keyed = tagged.withColumn("key", fuzzy.token_sorted(F.col("name"))).where("key <> ''")
    # prepared names are compared, whichever side holds them; then every left row gets its name's matches
    pairs = fuzzy.similar_pairs(keyed.groupBy("key").agg(F.min_by("name", "id").alias("name")).withColumnRenamed("key", "id"), floor)
    both = pairs.select(F.col("a").alias("key"), F.col("b").alias("near"), "score").unionByName(pairs.select(F.col("b").alias("key"), F.col("a").alias("near"), "score"))
    own = keyed.where(F.col("id").startswith("l:")).select("id", "key")
    heads = keyed.where(F.col("id").startswith("r:")).groupBy("key").agg(F.min("id").alias("hit"))
    equal = own.join(heads, "key").select("id", "hit", F.lit(100.0).alias("score"))
    near = own.join(both, "key").join(heads.withColumnRenamed("key", "near"), "near").select("id", "hit", "score")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "hit")) == 1
    best = equal.unionByName(near).distinct().withColumn("best", rank).where("best")
    return best.select(F.substring("id", 3, 1 << 20).alias("left_id"), F.substring("hit", 3, 1 << 20).alias("right_id"), "score")


def bridge_entities(entities: DataFrame, persons: DataFrame) -> DataFrame:
    """Entities of type Person tied to the person of most similar name."""
    found = best_matches(entities.where("type = 'Person'").select(F.col("source_id").alias("id"), "name"), persons.select(F.col("source_id").alias("id"), "name"), BRIDGE_FLOOR)
    return same_as(found.select(F.col("left_id").alias("a"), F.col("right_id").alias("b"), "score"), "entity_person_bridge", F.col("score") / 100.0)


def in_turn(wishes: list[tuple]) -> list[tuple]:
    """Of wishes (left position, stage, -score, right position, ...): each left one in turn gets its first wish that is still free."""
    got, taken = {}, set()
    for wish in sorted(wishes):
        if wish[0] not in got and wish[3] not in taken:
            got[wish[0]] = wish
            taken.add(wish[3])
    return list(got.values())


#: Stages of a match across sources, in order, and the confidence of the first two; a fuzzy match has its ratio's.
STAGES = ("exact", "email", "fuzzy")
EXACT, BY_EMAIL, LEAST_RATIO = 1.0, 0.95, 88.0


def cross_source(entities: DataFrame, block: str, least: float = 0.0) -> DataFrame:
    """One-to-one matches between the sources of each block (name, email, source, pos): by equal name, else by address, else by most similar name; in order of pos.

    Wishes come from equi-joins, and from similar names that were found whatever the block; only they, not the entities, are gathered for a pair of sources.
    """
    e = entities.select(F.col(block).cast("string").alias("block"), "source", F.col("pos").cast("long").alias("pos"), "name", F.lower(F.trim("email")).alias("mail"), F.lower("name").alias("low"), fuzzy.token_sorted(F.col("name")).alias("key"))
    mail = F.when(T.valid_email(F.col("mail")), F.col("mail"))
    left = e.select("block", F.col("source").alias("source_a"), F.col("pos").alias("at_a"), F.col("name").alias("entity_a"), F.col("low").alias("low_a"), mail.alias("mail_a"), F.col("key").alias("key_a"))
    right = e.select(F.col("block").alias("in"), F.col("source").alias("source_b"), F.col("pos").alias("at_b"), F.col("name").alias("entity_b"), F.col("low").alias("low_b"), mail.alias("mail_b"), F.col("key").alias("key_b"))
    # of equal names or addresses in a source the last one is meant
    last = lambda key: right.where(F.col(key).isNotNull()).groupBy("in", "source_b", key).agg(F.max_by(F.struct("at_b", "entity_b"), "at_b").alias("r")).select("in", "source_b", key, "r.*")
    here = (F.col("block") == F.col("in")) & (F.col("source_a") < F.col("source_b"))
    wish = lambda df, stage, score: df.select("block", "source_a", "source_b", "at_a", F.lit(stage).alias("stage"), score.alias("score"), "at_b", "entity_a", "entity_b")
    exact = wish(left.join(last("low_b"), here & (F.col("low_a") == F.col("low_b"))), 0, F.lit(100 * EXACT))
    mailed = wish(left.join(last("mail_b"), here & (F.col("mail_a") == F.col("mail_b"))), 1, F.lit(100 * BY_EMAIL))
    keys = e.where("key <> ''").groupBy("key").agg(F.min("name").alias("name")).withColumnRenamed("key", "id")
    pairs = fuzzy.similar_pairs(keys, LEAST_RATIO, by_length=False)
    near = pairs.select("a", "b", "score").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")).unionByName(keys.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(100.0).alias("score")))
    alike = left.join(near, F.col("key_a") == F.col("a")).join(right, here & (F.col("key_b") == F.col("b")))
    fuzzed = wish(alike.where((F.col("score") >= fuzzy.threshold(F.col("entity_a"))) & (F.col("score") >= 100 * least)), 2, F.col("score"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        names = dict(zip(group["at_a"], group["entity_a"])), dict(zip(group["at_b"], group["entity_b"]))
        got = in_turn(list(zip(group["at_a"], group["stage"], -group["score"], group["at_b"])))
        rows = [(group["block"].iloc[0], names[0][a], names[1][b], -score / 100, STAGES[stage]) for a, stage, score, b in got]
        return pd.DataFrame(rows, columns=["block", "entity_a", "entity_b", "confidence", "match_type"])

    return exact.unionByName(mailed).unionByName(fuzzed).groupBy("block", "source_a", "source_b").applyInPandas(run, "block string, entity_a string, entity_b string, confidence double, match_type string")


def resolve_document(new: list[dict], known: list[dict]) -> list[dict]:
    """Names of one document: known by lower case, else most similar of anchors (confidence of .95 or more), then of all; a fuzzy hit is known to later rows."""
    table = {k["name"].lower(): dict(k) for k in known}
    out = []
    for one in new:
        low, confidence = one["name"].lower(), one.get("confidence", 0.75)
        hit = table.get(low)
        if hit is None:
            need = 100.0 if len(low.strip()) < 4 else 95.0 if len(low.strip()) < 6 else 88.0
            sort = lambda n: " ".join(sorted(n.lower().split()))
            for pool in ([k for k in known if k.get("confidence", 0.75) >= 0.95], known):
                score, neg = max(((fuzzy.ratio(sort(low), sort(k["name"])), -j) for j, k in enumerate(pool)), default=(0.0, 0))
                if score >= need:
                    hit = pool[-neg]
                    table[low] = dict(hit)
                    break
        merged = None if hit is None else hit["name"]
        out.append({"name": merged or one["name"], "type": one.get("type") or (hit or {}).get("type", "Concept"), "confidence": max(confidence, hit.get("confidence", 0.75)) if hit else confidence, "merged_into": merged})
    return out


def same_by_embedding(names: DataFrame, known: DataFrame, embedder: V.Embedder) -> DataFrame:
    """(name, same_as, score): the known name of highest cosine over the floor for each new name, ties by name. The new names are a batch's and are held in blocks against all known ones."""
    embedded = lambda df: V.embed_column(df.select("name").where("name IS NOT NULL").distinct(), embedder, text_col="name").where("vector IS NOT NULL")
    best = V.neighbours(embedded(names), embedded(known), 1, COSINE_FLOOR, id_col="name")
    return best.where(F.col("score") > COSINE_FLOOR).select(F.col("seed").alias("name"), F.col("hit").alias("same_as"), "score")


def resolve_entities(entities: DataFrame, known: DataFrame, embedder: V.Embedder | None = None) -> DataFrame:
    """``resolve_document`` for each document's entities, with confidences from 0 to 1 (none is 0.75); candidates are the known names that are equal or similar to one of the document's, found by blocking that loses none.

    With an ``embedder`` a name that is merged into none gets the known one of nearest meaning as ``same_as``: both names stay.
    """
    entities, known = (df.withColumn("confidence", T.clamp_confidence(F.col("confidence"))) for df in (entities, known))
    keyed = lambda df: df.withColumn("key", fuzzy.token_sorted(F.col("name"))).where("key <> ''")
    named, old = keyed(entities).select("doc_id", "key").distinct(), keyed(known)
    keys = keyed(entities.select("name").unionByName(known.select("name"))).groupBy("key").agg(F.min("name").alias("name")).withColumnRenamed("key", "id")
    pairs = fuzzy.similar_pairs(keys, LEAST_RATIO, by_length=False)
    near = pairs.select(F.col("a").alias("key"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("key"), F.col("a").alias("near"))).unionByName(keys.select(F.col("id").alias("key"), F.col("id").alias("near")))
    candidates = named.join(near, "key").drop("key").withColumnRenamed("near", "key").join(old, "key").select("doc_id", "name", "type", "confidence").distinct()
    e = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "type", "confidence"))).alias("new"))
    c = candidates.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("name", "type", "confidence"))).alias("known"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, new, old in zip(batch["doc_id"], batch["new"], batch["known"]):
                rows += [(doc, r["name"], r["type"], r["confidence"], r["merged_into"]) for r in resolve_document([dict(x) for x in new], [dict(x) for x in (old if old is not None else [])])]
            yield pd.DataFrame(rows, columns=["doc_id", "name", "type", "confidence", "merged_into"])

    merged = e.join(c, "doc_id", "left").mapInPandas(run, "doc_id string, name string, type string, confidence double, merged_into string")
    if embedder is None:
        return merged.withColumn("same_as", F.lit(None).cast("string"))
    near = same_by_embedding(merged.where("merged_into IS NULL"), known, embedder).select("name", "same_as")
    told = merged.join(near.withColumnRenamed("name", "_name"), F.col("merged_into").isNull() & (F.col("name") == F.col("_name")), "left")
    return told.select(*merged.columns, "same_as")


def self_identity(persons: DataFrame, mails: list[str], name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All persons with my addresses, those that are missing included, and the edges that make one of them.

    Persons get is_self; the first of mine by id is the one that survives and gets ``name`` where one is given.
    """
    spark = persons.sparkSession
    own = spark.createDataFrame([(m,) for m in mails], "raw string").select(T.canonical_email(F.col("raw")).alias("mail")).where("mail <> ''").distinct()  # a person's few addresses
    held = persons.withColumn("mail", T.canonical_email(F.col("email")))
    missing = own.join(held.select("mail").distinct(), "mail", "left_anti").select(F.concat(F.lit("person:"), "mail").alias("source_id"), F.col("mail").alias("email"), "mail")
    everyone = held.unionByName(missing, allowMissingColumns=True).join(own.withColumn("is_self", F.lit(True)), "mail", "left").withColumn("is_self", F.coalesce("is_self", F.lit(False))).drop("mail")
    mine = everyone.where("is_self")
    first = mine.agg(F.min("source_id").alias("_first"))  # one row
    if name is not None:
        everyone = everyone.join(F.broadcast(first), F.col("source_id") == F.col("_first"), "left").withColumn("name", F.when(F.col("_first").isNotNull(), F.lit(name)).otherwise(F.col("name"))).drop("_first")
    return everyone, by_key(mine, F.lit("self"), "self_identity")


def reconcile(persons: DataFrame, existing: DataFrame, never: DataFrame, mails: list[str] | None = None) -> DataFrame:
    """The whole chain: mail, chat id, name, self, then closure over all of it; blocked pairs get no edge."""
    found = by_email(persons, never).unionByName(by_chat_id(persons, never)).unionByName(by_name(persons, never))
    if mails:
        found = found.unionByName(self_identity(persons, mails)[1])
    pairs = found.select(F.col("src_id").alias("a"), F.col("dst_id").alias("b")).unionByName(existing.select("a", "b")).distinct()
    return found.unionByName(same_as(graph.closure(pairs, never), "transitive_closure", F.lit(None).cast("double")))


def identifier(raw: str) -> tuple[str, str]:
    """Kind (email, chat, name) and value of what a caller typed."""
    s = raw.strip()
    if s.startswith("slack-user:"):
        return "chat", s
    return ("email", s.lower()) if "@" in s and " " not in s else ("name", s)


def find_person(raw: str, persons: DataFrame) -> DataFrame:
    """Persons that an identifier means, best first: by mail, chat id, or a name of 90 and more. More than one: ambiguous."""
    kind, value = identifier(raw)
    if kind == "email":
        return persons.where(T.canonical_email(F.col("email")) == T.canonical_email(F.lit(value))).withColumn("score", F.lit(100.0))
    if kind == "chat":
        return persons.where(F.concat(F.lit("slack-user:"), F.concat_ws("/", "team_id", "slack_user_id")) == value).withColumn("score", F.lit(100.0))
    return persons.withColumn("score", fuzzy.token_sort_ratio(F.col("name"), F.lit(value))).where(F.col("score") >= FIND_FLOOR).orderBy(F.desc("score"), "source_id")


def neighbours(cluster: DataFrame, identity_edges: DataFrame) -> DataFrame:
    """Members of a cluster with the edge that ties them: match type, confidence, whether across sources."""
    both = identity_edges.select(F.col("dst_id").alias("member"), "src_id", "match_type", "confidence", "cross_source").unionByName(identity_edges.select(F.col("src_id").alias("member"), F.col("dst_id").alias("src_id"), "match_type", "confidence", "cross_source"))
    return cluster.select(F.col("source_id").alias("member")).join(both, "member", "left")


def split(edges: DataFrame, never: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """The pair's identity edge removed and a block set."""
    pair = F.array_sort(F.array("src_id", "dst_id")) == F.array(*map(F.lit, sorted((a, b))))
    block = edges.sparkSession.createDataFrame([tuple(sorted((a, b)))], "a string, b string")
    return edges.where(~((F.col("rel") == "SAME_AS") & pair)), never.select("a", "b").unionByName(block).distinct()


def confirm(edges: DataFrame, never: DataFrame, a: str, b: str) -> DataFrame:
    """An identity edge by hand; a block on the pair dominates."""
    lo, hi = sorted((a, b))
    pair = edges.sparkSession.createDataFrame([(lo, hi)], "a string, b string").join(never.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    return edges.unionByName(same_as(pair, "manual"), allowMissingColumns=True)


merge = confirm
