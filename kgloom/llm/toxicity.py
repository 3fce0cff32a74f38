"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

1. *Voters.* From a bounded sample of labelled rows (``LABEL_ROWS``, lowest id hashes first) the words and word beginnings
   most telling of the label become voters: each fires on a document that holds its word or beginning, else abstains.
   A few fixed pattern voters (shouting, repeated marks, drawn-out letters) join them.
2. *Label model.* Every voter, pattern or word, has a rate of firing given toxic and one given clean. Both start from the labelled
   sample and are then estimated by expectation and maximisation over the votes of all documents: a voter's rates follow from how far
   the others agree with it. The labelled sample is the anchor: its counts go in with the weight ``ANCHOR`` of all documents, and the
   prior is its own. Voters that fire together more often than the label explains are correlated: the strongest such ties form a forest
   (by mutual information given the label), and a voter with a parent there has one rate where the parent fires and one where it does not, for each label, estimated in
   the same rounds. A voter that only repeats its parent so adds nothing. This gives every document a posterior from its votes.
3. *Classifier.* A logistic regression over the telling words and beginnings is trained on the posteriors of a bounded
   sample of documents (``TRAIN_ROWS`` from either side of the prior) and scores every document.

The text is read once for all documents (and once for the labelled sample); what later steps need of it is a short array.
Whole texts are used. Labels come only from rows with ``crc32(doc_id) % 3 != 1``; lang, source and doc_id are no inputs.

Defined cases: null and empty texts fire no voter and score the classifier's base rate; without any labelled row of both kinds there is
no voter and every score is 0; repeated rows are scored alike; repeated labels of one id count as toxic if any is.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, crc_of_id, utf8

#: Bounds: labelled rows that choose voters, features kept, word voters, documents from each side that train the classifier.
LABEL_ROWS, FEATURES, WORD_VOTERS, TRAIN_ROWS = 12_000, 2_048, 96, 8_000
HASH_BITS, BEGINNINGS, LEAST_DOCS = 22, (4, 5, 6), 4
#: A term counts as seen in so many more clean documents than it was; a voter fires on that share of toxic ones at least.
DOUBT, LEAST_SHARE = 1.5, 0.02
#: Share of toxic documents among those that a word voter fires on.
LEAST_PRECISION = 0.8
CUT_OFF = 0.7
#: Weight of the labelled sample in the label model, as a share of all documents; rounds of its estimation.
ANCHOR, ROUNDS = 0.2, 8
#: A tie counts when the correlation of two voters given the label is at least this, and twice its information over all documents at least that (a chance of about 1e-7 without a tie).
LEAST_TIE, LEAST_EVIDENCE = 0.1, 32.0
HELD_OUT_FOLD, FOLDS = 1, 3
PATTERNS = ("shouting", "repeated marks", "drawn-out letters")
_MARKS, _DRAWN = re.compile(rb"[!?]{3,}"), re.compile(rb"([a-z])\1{3}", re.IGNORECASE)
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’¡¿…"


def document_terms(text: str) -> set[str]:
    """Lower-case words without punctuation at the ends, and their beginnings (marked by a trailing ``*``)."""
    words = {w.strip(_EDGE) for w in set(text.lower().split())}
    words.discard("")
    terms = set(words)
    for n in BEGINNINGS:
        terms.update([w[:n] + "*" for w in words if len(w) > n])
    return terms


def pattern_votes(raw: bytes) -> list[int]:
    words = raw.split()
    shouted = sum(len(w) > 2 and w.isupper() for w in words)
    fires = (shouted > 3 and shouted * 3 > len(words), b"!" in raw and bool(_MARKS.search(raw)), bool(_DRAWN.search(raw)))
    return [k for k, fired in enumerate(fires) if fired]


def slot(term: str) -> int:
    return zlib.crc32(term.encode()) >> (32 - HASH_BITS)


def _sample_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for first in range(0, whole.num_rows, 256):
            batch = whole.slice(first, 256)
            texts = [raw.as_py() for raw in batch.column("raw")]
            terms = [sorted({slot(t) for t in document_terms(raw.decode(errors="replace"))}) + [(1 << HASH_BITS) + k for k in pattern_votes(raw)] for raw in texts]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(terms, pa.list_(pa.int32()))], ["toxic", "terms"])


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = LABEL_ROWS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Labels and hashed terms, then the pattern voters that fire (numbered after all hashes), of at most ``rows`` labelled documents outside the held-out fold."""
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (F.pmod(crc_of_id(), F.lit(FOLDS)) != HELD_OUT_FOLD))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    texts = docs.select("doc_id", utf8("text").alias("raw")).join(F.broadcast(chosen), "doc_id")  # at most `rows` pairs of numbers
    got = texts.select("toxic", "raw").mapInArrow(_sample_terms, "toxic int, terms array<int>").toArrow()
    return got["toxic"].to_numpy(), [np.asarray(t, dtype=np.int64) for t in got["terms"].to_pylist()]


@dataclass
class Voters:
    """Slots of the kept terms, most telling first; the first ``words`` vote, and then the patterns."""

    slots: np.ndarray
    words: int
    prior: float
    fires_toxic: np.ndarray
    fires_clean: np.ndarray
    #: Shares of the documents of either label that each pair fires on; none are known: as if the label explained them all.
    pairs_toxic: np.ndarray | None = None
    pairs_clean: np.ndarray | None = None
    #: The labelled documents' votes: how many of either label (clean, toxic) have just these.
    sample: dict[tuple[int, ...], list[int]] = field(default_factory=dict)

    def __post_init__(self):
        self.pairs_toxic = np.outer(self.fires_toxic, self.fires_toxic) if self.pairs_toxic is None else self.pairs_toxic
        self.pairs_clean = np.outer(self.fires_clean, self.fires_clean) if self.pairs_clean is None else self.pairs_clean

    @property
    def votes(self) -> int:
        return self.words + len(PATTERNS)

    def fired(self, found: list[int]) -> list[int]:
        """The voters among found features."""
        first = len(self.slots)
        return [v if v < self.words else v - first + self.words for v in found if v < self.words or v >= first]


def _voters(toxic: np.ndarray, terms: list[np.ndarray], order: np.ndarray, in_toxic: np.ndarray, share_toxic: np.ndarray, least: float) -> np.ndarray:
    """The terms that vote. One that mostly repeats an earlier voter must be as telling where that one abstains: ``lose*`` may not vote for what ``loser`` found."""
    place = {int(s): k for k, s in enumerate(order)}
    holds: list[list[int]] = [[] for _ in order]
    for doc, found in enumerate(terms):
        for s in found:
            if (k := place.get(int(s))) is not None:
                holds[k].append(doc)
    sets, chosen = [set(h) for h in holds], []
    is_toxic = toxic == 1
    for k, s in enumerate(order):
        if len(chosen) == WORD_VOTERS:
            break
        if in_toxic[s] < least or share_toxic[s] < LEAST_PRECISION:
            continue
        alone = set(sets[k])
        for c in chosen:
            if len(sets[k] & sets[c]) >= 0.6 * len(sets[k]):
                alone -= sets[c]
        n_alone = sum(bool(is_toxic[d]) for d in alone)
        if len(alone) - n_alone <= 1 + n_alone / 4:
            chosen.append(k)
    return order[np.array(chosen, dtype=np.int64)]


def choose_voters(toxic: np.ndarray, terms: list[np.ndarray]) -> Voters | None:
    n_toxic, n_clean = int((toxic == 1).sum()), int((toxic == 0).sum())
    if not n_toxic or not n_clean:
        return None
    # only slots that occur are counted; the patterns follow after them
    first_pattern = 1 << HASH_BITS
    seen, at = np.unique(np.concatenate([np.empty(0, np.int64), *terms]), return_inverse=True)
    label = np.repeat(toxic, [len(t) for t in terms])
    in_toxic, in_clean = (np.bincount(at[label == y], minlength=len(seen)) for y in (1, 0))
    is_term = seen < first_pattern
    p, q = (in_toxic + 0.5) / (n_toxic + 1), (in_clean + DOUBT) / (n_clean + 1)
    lift = np.log(p / q)
    share_toxic = in_toxic / np.maximum(in_toxic + in_clean, 1)
    weight = np.where(is_term & (in_toxic >= LEAST_DOCS) & (share_toxic > 0.5), lift * np.sqrt(in_toxic), 0)
    order = np.argsort(-weight, kind="stable")[:FEATURES]
    order = order[weight[order] > 0]
    places = np.split(at, np.cumsum([len(t) for t in terms])[:-1]) if terms else []
    telling = _voters(toxic, places, order, in_toxic, share_toxic, max(LEAST_DOCS, LEAST_SHARE * n_toxic))
    slots = seen[np.concatenate([telling, order[~np.isin(order, telling)]])]
    # a pattern that the sample hardly holds tells little: both rates lean on half a document at its rate over both labels
    of_pattern = lambda counts: np.array([counts[seen == first_pattern + k].sum() for k in range(len(PATTERNS))])
    of_toxic, of_clean = of_pattern(in_toxic), of_pattern(in_clean)
    either = (of_toxic + of_clean + 0.5) / (n_toxic + n_clean + 1)
    rates = lambda r, of, n: np.concatenate([r[telling], (of + 0.5) / (n + 0.5 / either)])
    place = {int(s): k for k, s in enumerate(seen[telling])} | {first_pattern + k: len(telling) + k for k in range(len(PATTERNS))}
    pairs, sample = np.zeros((2, len(place), len(place))), {}
    for y, found in zip(toxic, terms):
        fired = sorted(place[s] for s in found.tolist() if s in place)
        pairs[int(y)][np.ix_(fired, fired)] += 1
        sample.setdefault(tuple(fired), [0, 0])[int(y)] += 1
    return Voters(slots, len(telling), n_toxic / (n_toxic + n_clean), rates(p, of_toxic, n_toxic), rates(q, of_clean, n_clean), pairs[1] / n_toxic, pairs[0] / n_clean, sample)


def _features(voters: Voters):
    place = {int(s): k for k, s in enumerate(voters.slots)}
    first_pattern = len(voters.slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a word seen before needs no hashing again; the memory is bounded by its size limit
        known: dict[str, tuple[int, ...]] = {}
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                found = []
                for raw in batch.column("raw"):
                    raw = raw.as_py()
                    here: set[int] = set()
                    for word in set(raw.decode(errors="replace").lower().split()):
                        got = known.get(word)
                        if got is None:
                            got = tuple(place[s] for s in map(slot, document_terms(word)) if s in place)
                            if len(known) < 400_000:
                                known[word] = got
                        if got:
                            here.update(got)
                    here.update(first_pattern + k for k in pattern_votes(raw))
                    found.append(sorted(here))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "found"])

    return run


def vote_counts(found: DataFrame, voters: Voters) -> tuple[int, np.ndarray]:
    """Over all documents: their number, and how many each pair of voters (a voter with itself too) fires on."""
    k = voters.votes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = np.zeros((k, k), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for row in batch.column("found").to_pylist():
                if row:
                    at = voters.fired(row)
                    pairs[np.ix_(at, at)] += 1
        i, j = np.nonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()), pa.array(np.append(pairs[i, j], n), pa.int64())], ["i", "j", "n"])

    total, out = 0, np.zeros((k, k))
    for i, j, n in found.mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # k * k rows at most
        if i < 0:
            total = n
        else:
            out[i, j] = n
    return total, out


@dataclass
class LabelModel:
    """Log-odds of the prior, and each voter's rates of firing given either label: where its parent is silent (or it has none, -1), and where its parent fires."""

    base: float
    toxic: np.ndarray
    clean: np.ndarray
    parent: np.ndarray
    toxic_after: np.ndarray
    clean_after: np.ndarray
    #: What part of a silence counts where some voter fires: authors choose a few of many words, of one language, so silences are not independent given the label as the rates have it.
    quiet: float = 1.0

    def __post_init__(self):
        odds = lambda t, c: (np.log(t / c), np.log((1 - t) / (1 - c)))
        self.vote, silent = odds(self.toxic, self.clean)
        self.vote_after, silent_after = odds(self.toxic_after, self.clean_after)
        self.silent, self.silent_after = silent * self.quiet, silent_after * self.quiet
        self.children = [np.nonzero(self.parent == k)[0].tolist() for k in range(len(self.parent))]
        self.none, self.some = self.base + float(silent.sum()), self.base + float(self.silent.sum())
        self.known: dict[tuple[int, ...], float] = {}

    def logit(self, fired: list[int]) -> float:
        """Of the posterior, from the voters that fired and those that did not."""
        key = tuple(fired)
        if (out := self.known.get(key)) is None:
            out, among = self.some if fired else self.none, set(fired)
            for j in fired:
                out += float((self.vote_after if self.parent[j] in among else self.vote)[j] - self.silent[j])
                out += sum(float(self.silent_after[c] - self.silent[c]) for c in self.children[j] if c not in among)
            if len(self.known) < 100_000:
                self.known[key] = out
        return out


def correlated(n: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The parent of each voter, -1 for none: a maximum spanning forest of the ties, each tree rooted at its first voter.

    ``n`` holds the documents of both labels, ``pairs`` for each label how many of them each pair of voters fires on.
    """
    k = pairs.shape[1]
    information, correlation, total = np.zeros((k, k)), np.zeros((k, k)), max(float(n.sum()), 1e-9)
    for of, joint in zip(n, pairs):
        if of <= 0:
            continue
        both, one = joint / of, np.clip(np.diag(joint) / of, 1e-12, 1 - 1e-12)
        x, y = one[:, None], one[None, :]
        for cell, free in ((both, x * y), (x - both, x * (1 - y)), (y - both, (1 - x) * y), (1 - x - y + both, (1 - x) * (1 - y))):
            information += of / total * np.where(cell > 1e-12, cell * np.log(np.maximum(cell, 1e-12) / free), 0)
        correlation += of / total * (both - x * y) / np.sqrt(x * (1 - x) * y * (1 - y))
    parent, tree = np.full(k, -1), np.arange(k)
    ties: list[list[int]] = [[] for _ in range(k)]
    i, j = np.nonzero(np.triu((correlation >= LEAST_TIE) & (2 * total * information >= LEAST_EVIDENCE), 1))
    for at in np.argsort(-information[i, j], kind="stable"):
        a, b = int(i[at]), int(j[at])
        if tree[a] != tree[b]:
            ties[a].append(b)
            ties[b].append(a)
            tree[tree == max(tree[a], tree[b])] = min(tree[a], tree[b])
    for root in np.unique(tree):
        stack = [int(root)]
        while stack:
            one = stack.pop()
            for other in ties[one]:
                if other != parent[one]:
                    parent[other] = one
                    stack.append(other)
    return parent


def vote_sets(found: DataFrame, voters: Voters) -> DataFrame:
    """votes (the voters that fire) and n, the number of documents with just these votes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([voters.fired(r) for r in batch.column("found").to_pylist()], pa.list_(pa.int32()))], ["votes"])

    return found.mapInArrow(run, "votes array<int>").groupBy("votes").agg(F.count("*").alias("n"))


def expected_counts(sets: DataFrame, model: LabelModel) -> tuple[float, np.ndarray]:
    """Over all documents: how many are toxic by the model, and how many of these each pair of voters (a voter with itself too) fires on."""
    k = len(model.vote)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, total = np.zeros((k, k)), 0.0
        for batch in batches:
            for votes, n in zip(batch.column("votes").to_pylist(), batch.column("n").to_pylist()):
                weight = n / (1 + np.exp(-model.logit(votes)))
                total += weight
                if votes:
                    sums[np.ix_(votes, votes)] += weight
        i, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()), pa.array(np.append(sums[i, j], total))], ["i", "j", "n"])

    total, out = 0.0, np.zeros((k, k))
    for i, j, n in sets.mapInArrow(run, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # k * k rows at most
        if i < 0:
            total = n
        else:
            out[i, j] = n
    return total, out


def counted_silence(model: LabelModel, sample: dict[tuple[int, ...], list[int]]) -> LabelModel:
    """The model with the part of a silence under which the labelled sample is likeliest; all of it without a sample."""

    def loss(of: LabelModel) -> float:
        z = np.array([of.logit(list(fired)) for fired in sample])
        clean, toxic = np.array(list(sample.values()), dtype=float).T
        return float((toxic * np.logaddexp(0, -z) + clean * np.logaddexp(0, z)).sum())

    return min((replace(model, quiet=part / 10) for part in range(10, -1, -1)), key=loss) if sample else model


def fit_label_model(voters: Voters, n: int, pairs: np.ndarray, expect, rounds: int = ROUNDS) -> LabelModel:
    """Rates and correlations from the votes of all documents, anchored by the labelled sample's.

    ``expect`` gives a model's expected counts over all documents (``expected_counts``). A round takes them under the rates so far and makes the rates anew; the forest is
    that of the first round's counts.
    """
    prior, k = voters.prior, voters.votes
    base, anchor = float(np.log(prior / (1 - prior))), ANCHOR * n
    kept = lambda r: np.clip(r, 1e-6, 0.999)
    alone = np.full(k, -1)
    model = LabelModel(base, *map(kept, (voters.fires_toxic, voters.fires_clean)), alone, *map(kept, (voters.fires_toxic, voters.fires_clean)))
    parent = None

    def counts(of: float, joint: np.ndarray, share: float, fires: np.ndarray, sample: np.ndarray) -> tuple:
        """Of one label: documents, each voter's, its parent's, and those of both."""
        own, up = np.diag(joint) + anchor * share * fires, np.where(parent >= 0, parent, np.arange(k))
        together = joint[np.arange(k), up] + anchor * share * sample[np.arange(k), up]
        return of + anchor * share, own, own[up], np.minimum(together, np.minimum(own, own[up]))

    def rates(labels: tuple[tuple, tuple]) -> list[np.ndarray]:
        """Of toxic and clean documents: rates where the parent is silent, then where it fires. They lean on one document at the rate over both labels, so a voter that hardly fires otherwise than its parent tells nothing."""
        alone, after = [(own - both, held - up) for held, own, up, both in labels], [(both, up) for _, _, up, both in labels]
        lean = lambda pair: sum(x for x, _ in pair) / np.maximum(sum(y for _, y in pair), 1e-9)
        smooth = lambda pair: [(x + lean(pair)) / (y + 1) for x, y in pair]
        return [kept(np.where(parent >= 0, x, own / held)) for part in (alone, after) for x, (held, own, _, _) in zip(smooth(part), labels)]

    for _ in range(rounds if n else 0):
        n_toxic, by_pair = expect(model)
        rest = np.maximum(pairs - by_pair, 0)
        if parent is None:
            parent = correlated(np.array([n_toxic + anchor * prior, n - n_toxic + anchor * (1 - prior)]), np.stack([by_pair + anchor * prior * voters.pairs_toxic, rest + anchor * (1 - prior) * voters.pairs_clean]))
        toxic, clean, toxic_after, clean_after = rates((counts(n_toxic, by_pair, prior, voters.fires_toxic, voters.pairs_toxic), counts(n - n_toxic, rest, 1 - prior, voters.fires_clean, voters.pairs_clean)))
        model = counted_silence(LabelModel(base, toxic, clean, parent, toxic_after, clean_after), voters.sample)
    return model


def train(rows: list[list[int]], posterior: np.ndarray, weight: np.ndarray, size: int, rounds: int = 800) -> np.ndarray:
    """Logistic regression on soft labels by full-batch gradient steps with momentum; the last coefficient is the base."""
    at = np.concatenate([np.empty(0, np.int64), *(np.asarray(r, np.int64) for r in rows)])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, speed, total = np.zeros(size + 1), np.zeros(size + 1), weight.sum()
    w[-1] = np.log(max(1e-3, (posterior * weight).sum() / total) / max(1e-3, 1 - (posterior * weight).sum() / total))
    share = np.bincount(at, weight[row], size) / total
    for _ in range(rounds):
        z = w[-1] + np.bincount(row, w[at], len(rows))
        gap = (1 / (1 + np.exp(-z)) - posterior) * weight / total
        step = np.append((np.bincount(at, gap[row], size) + 5e-5 * w[:-1]) / (share + 1e-3), gap.sum())
        speed = 0.9 * speed - 0.05 * step
        w += speed
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, posterior (the label model's) and n_votes for every document."""
    toxic, terms = labelled_sample(docs, labels)
    voters = choose_voters(toxic, terms)
    held_out = F.pmod(crc_of_id(), F.lit(FOLDS)) == HELD_OUT_FOLD
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    if voters is None:
        return docs.select(doc_id, F.coalesce(held_out, F.lit(False)).alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit(0.0).alias("posterior"), F.lit(0).alias("n_votes"))
    found = Stored(docs.select(doc_id, utf8("text").alias("raw")).mapInArrow(_features(voters), "doc_id long, found array<int>"), "toxicity").df
    n, pairs = vote_counts(found, voters)
    sets = Stored(vote_sets(found, voters), "votes").df
    model = fit_label_model(voters, n, pairs, lambda model: expected_counts(sets, model))
    size, first = len(voters.slots) + len(PATTERNS), len(voters.slots)
    sides = _sample_sides(found, voters, model)
    weight = np.array([share for _, _, share in sides])
    w = train([r for r, _, _ in sides], 1 / (1 + np.exp(-np.array([z for _, z, _ in sides]))), weight, size) if sides else np.append(np.zeros(size), model.none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("found")
            lengths = np.diff(at.offsets.to_numpy())
            flat, row = at.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(batch.num_rows), lengths)
            logistic = lambda z: 1 / (1 + np.exp(-z))
            fired = [voters.fired(r) for r in at.to_pylist()]
            posterior = logistic(np.array([model.logit(f) for f in fired]))
            score = logistic(w[-1] + np.bincount(row, w[flat], batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(posterior), pa.array([len(f) for f in fired], pa.int32())], ["doc_id", "score", "posterior", "n_votes"])

    scored = found.mapInArrow(run, "doc_id long, score double, posterior double, n_votes int")
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= CUT_OFF).cast("int").alias("predicted"), "posterior", "n_votes")


def _sample_sides(found: DataFrame, voters: Voters, model: LabelModel) -> list[tuple[list[int], float, float]]:
    """Documents that train the classifier: at most ``TRAIN_ROWS`` with a posterior above a half and as many below, by id hash, each with the weight that restores its side's share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logit = [model.logit(voters.fired(r)) for r in batch.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("found"), pa.array(logit, pa.float64())], ["doc_id", "found", "logit"])

    rated = found.mapInArrow(run, "doc_id long, found array<int>, logit double")
    out = []
    for side in (F.col("logit") > 0, F.col("logit") <= 0):
        part = rated.where(side)
        rows = part.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS).select("found", "logit").collect()
        share = part.count() / max(1, len(rows))
        out += [(r["found"], r["logit"], share) for r in rows]
    return out
