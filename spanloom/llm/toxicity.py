"""Toxicity by a learned lexicon, a Levenshtein automaton over its trie, and the context of each hit.

From a sample of about PER_CLASS labelled documents of either class (the bound of the classifier's sample; drawn by a
hash of doc_id) the lexicon takes the TERMS words whose documents are toxic most beyond chance (G-test), if they stand before unlike words. Words of
texts run through an automaton: its states are sets of (trie node, edits so far), made when first met; terms
of five letters and more allow one edit. A hit counts by its term's weight, apart for exact and misspelled ones and,
by the window of words around it, for quoted and direct ones. A logistic regression on these sums, fitted to the
same sample and set back to the classes' true shares, gives the score.

Words are split at white space (Unicode's) and stripped of STRIP, in learning and scoring alike; a text without white space is one word.
Terms have 3 to 40 letters; words of any length are held against them.

Null and empty texts have no hit and score the base rate. No labels: all scores are 0. A doc_id with several labels
counts as toxic if any says so; of several texts of one doc_id the greatest is learned from, and each is scored. Null ids are never learned
from nor held out. Ties in the lexicon: by word. Repeated rows: the same result each. Very long texts: whole, in time proportional to their
length. Other columns, whatever their names, aren't read. Empty table: an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import rows_of, stash

PER_CLASS = 6000
TERMS = 300
LEAST_G = 22.0
CONTEXTS = 10
ONE_EDIT_FROM = 5
NEAR = 4
THRESHOLD = 0.3
KNOWN_WORDS = 300_000
KNOWN_STATES = 50_000  # of the automaton, made anew when there are more
STRIP = ".,;:!?()[]{}<>|#*$%&\"'“”„«»‘’`-_~=+/\\"
QUOTES = frozenset("\"“”„«»‘’")
#: Fixed words that report speech, and that address a reader.
REPORTS = frozenset("said says say quoted quote wrote writes called calls word words term reported told".split())
ADDRESSES = frozenset("you your youre you're u ur du dein tu ton vous votre tú usted".split())


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


class Automaton:
    """All words within the allowed edits of a lexicon's term. find(word): (term's number, edits) of the best one, or None."""

    def __init__(self, terms: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.end: list[int] = [-1]
        self.terms = terms
        for k, term in enumerate(terms):
            node = 0
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.end.append(-1)
                node = self.next[node][c]
            if self.end[node] < 0:
                self.end[node] = k
        self._begin()

    def _begin(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[tuple[int, int] | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, some: set[tuple[int, int]]) -> int:
        least: dict[int, int] = {}
        for node, edits in some:
            if edits < least.get(node, 2):
                least[node] = edits
        for node, edits in list(least.items()):  # a term's letter may be missing
            if edits == 0:
                for child in self.next[node].values():
                    least[child] = min(1, least.get(child, 2))
        key = frozenset(least.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = sorted((e, self.end[n]) for n, e in key if self.end[n] >= 0 and (e == 0 or len(self.terms[self.end[n]]) >= ONE_EDIT_FROM))
            self.found.append((ends[0][1], ends[0][0]) if ends else None)
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        some = set()
        for node, edits in self.sets[state]:
            if (child := self.next[node].get(c)) is not None:
                some.add((child, edits))
            if edits == 0:
                some.add((node, 1))
                some.update((child, 1) for child in self.next[node].values())
        to = self._state(some) if some else -1
        if len(self.steps[state]) < 4096:
            self.steps[state][c] = to
        return to

    def find(self, word: str) -> tuple[int, int] | None:
        if len(self.sets) > KNOWN_STATES:
            self._begin()
        state = self.start
        for c in word:
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return None
        return self.found[state]


FEATURES = 6


class Scorer:
    def __init__(self, terms: list[str], weights: list[float]):
        self.automaton, self.weights, self.known = Automaton(terms), weights, {}

    def _hit(self, word: str) -> tuple[int, int] | None:
        try:
            return self.known[word]
        except KeyError:
            if len(self.known) > KNOWN_WORDS:
                self.known.clear()
            hit = self.automaton.find(word.strip(STRIP))
            if len(word) < 100:
                self.known[word] = hit
            return hit

    def features(self, text: str | None) -> list[float]:
        """Weights of direct exact hits, of direct misspelled ones, of quoted ones, of hits near an address; unlike terms; hits in 100 words."""
        words = words_of(text)
        if not any(map(self._hit, set(words))):
            return [0.0] * FEATURES
        sums, terms, hits = [0.0] * 4, set(), 0
        for k, word in enumerate(words):
            if (hit := self._hit(word)) is not None:
                near = words[max(0, k - NEAR) : k + NEAR + 1]
                quoted = not QUOTES.isdisjoint(word) or sum(not QUOTES.isdisjoint(w) for w in near) > 1 or not REPORTS.isdisjoint(near)
                weight = self.weights[hit[0]]
                sums[2 if quoted else hit[1]] += weight
                if not ADDRESSES.isdisjoint(near):
                    sums[3] += weight
                terms.add(hit[0])
                hits += 1
        return [*np.log1p(np.maximum(sums, 0)).tolist(), np.log1p(len(terms)), min(1.0, 100 * hits / len(words) / 10)]


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients, the constant last, by Newton's method."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w, pull = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, ridge), 1e-3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(pull), x.T @ (p - y) + pull * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[list[str], list[float], np.ndarray | None]:
    """Terms, their weights, and the regression's coefficients."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max(F.least(F.col("toxic"), F.lit(1))).alias("toxic"))
    known = stash(known)
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return [], [], None
    bound = F.when(F.col("toxic") == 1, -(-(per_class << 20) // counts[1])).otherwise(-(-(per_class << 20) // counts[0]))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < bound)  # about 2 x per_class rows: broadcast
    sample = docs.where("doc_id is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    sample = stash(sample.groupBy("doc_id").agg(F.max(F.struct("toxic", F.coalesce("text", F.lit("")).alias("text"))).alias("x")).select("x.*"))
    size = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return [], [], None

    def bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_of(batches, 4 << 20):
            made = [[w.strip(STRIP) for w in words_of(x.as_py())] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.string()))], ["toxic", "w"])

    split = sample.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(bare, "toxic int, w array<string>")
    word = split.select("toxic", F.explode(F.array_distinct("w")).alias("word")).where("length(word) between 3 and 40")
    word = word.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where("a >= 3")
    n1, n0 = size[1], size[0]
    part = lambda x, y: F.when(x > 0, x * F.log(x / y)).otherwise(0.0)
    a, b, n = F.col("a"), F.col("b"), n1 + n0
    g = 2 * (part(a, (a + b) * n1 / n) + part(b, (a + b) * n0 / n) + part(n1 - a, (n - a - b) * n1 / n) + part(n0 - b, (n - a - b) * n0 / n))
    weight = F.log((a + 0.5) / (n1 + 1)) - F.log((b + 0.5) / (n0 + 1))
    likely = word.select("word", "a", g.alias("g"), weight.alias("weight")).where(f"g >= {LEAST_G} and weight >= 1")
    likely = stash(likely)
    few = likely.count() <= 100_000  # some 60 bytes each: broadcast, so that no frequent word's places meet in one task
    # words of one text and its copies stand before the same word each time
    pairs = split.where("toxic = 1").select(F.explode(F.transform("w", lambda w, k: F.struct(w.alias("word"), F.get("w", k + 1).alias("after")))).alias("x")).select("x.*")
    apart = pairs.join(F.broadcast(likely) if few else likely, "word").groupBy("word", "a", "g", "weight").agg(F.count_distinct("after").alias("contexts"))
    top = apart.where(f"contexts >= least(0.6 * a, {CONTEXTS})").orderBy(F.desc("g"), "word").limit(TERMS).collect()
    terms, weights = [r["word"] for r in top], [r["weight"] for r in top]
    schema = "toxic int, " + ", ".join(f"f{k} double" for k in range(FEATURES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms, weights)
        for batch in rows_of(batches, 4 << 20):
            made = np.array([scorer.features(x.as_py()) for x in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in made.T)], ["toxic", *(f"f{k}" for k in range(FEATURES))])

    rows = sample.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(run, schema).toPandas()
    y = rows["toxic"].to_numpy(float)
    fitted = _regression(rows.drop(columns="toxic").to_numpy(float), y)
    fitted[-1] += np.log(counts[1] / counts[0]) - np.log(n1 / n0)
    return terms, weights, fitted


def op4(docs: DataFrame, labels: DataFrame) -> DataFrame:
    terms, weights, fitted = learn(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(terms, weights)
        for batch in rows_of(batches, 4 << 20):
            if fitted is None:
                score = np.zeros(batch.num_rows)
            else:
                made = np.array([scorer.features(x.as_py()) for x in batch.column(2)])
                score = 1 / (1 + np.exp(-np.clip(made @ fitted[:-1] + fitted[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
