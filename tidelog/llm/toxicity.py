"""Toxicity: an automaton of misspelled lexicon terms, and the windows around what it finds.

Terms are learned: words, and stems of words (``abcd*``: any ending), that occur in many different contexts of toxic training
texts and in hardly any of others (contexts, not documents, so that copies of one text count once). Their trie is intersected with Levenshtein automata (1 edit from
5 letters, 2 from 9; of a stem, whose distance is that of the nearest beginning of the word) into one deterministic automaton, whose states are sets of (trie node, edits) and are built
when first reached. A word that training texts use as others do is no misspelling of a stem. Words near a hit are weighed too (learned from windows around hits in toxic and other texts), as is
whether the hit stands in quotation marks; a logistic regression turns these into a score.

Training reads a bounded sample: at most ``MAX_TRAIN`` labelled documents, those of smallest hash (of a hash, the smaller id); of rows that
share an id, the text of the smallest hash. All terms and context words with enough evidence in it are kept, whatever their number and length. Labels,
language, source and id are not inputs of a score. Null or empty texts have no hits and get a score as any text without hits, as do rows
without an id (never held out); without usable labels the score is 0. Between terms at one distance the first listed (the stronger) counts.
Repeated rows are scored each; an empty table gives no rows; texts are read whole. Other columns are not read, so their names may be any.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.batches import bounded_batches
from tidelog.llm.words import Hasher, Words, chunks, distinct
from tidelog.plans.scratch import keep

#: Labelled documents to learn from, distinct contexts that a term needs.
MAX_TRAIN, MIN_CONTEXTS = 20_000, 5
#: Times likelier in toxic texts than in others, and standard deviations above what chance gives.
LEAST_LIFT, LEAST_Z = 6.0, 8.0
#: Letters of a stem.
STEM = (4, 8)
REACH = 4
THRESHOLD = 0.7

_TRIM = ".,;:!?\"'()[]{}<>|=*#&%$-_«»“”„‘’…"
_QUOTES = "\"“”„«»"
_LEET = str.maketrans("0134578@$", "oieastbas")


def plain(word: str) -> str:
    """Lower case without punctuation around it; digits and signs that stand for letters are read as these."""
    word = word.strip(_TRIM).lower()
    return word.translate(_LEET) if not word.isalpha() and any(c.isalpha() for c in word) else word


def allowed_edits(term: str) -> int:
    letters = len(term.removesuffix("*"))
    return 0 if letters < 5 else 1 if letters < 9 else 2


class FuzzyLexicon:
    """Trie of terms x Levenshtein automata as one automaton; ``match`` gives the nearest term and its distance."""

    MAX_STATES = 200_000

    def __init__(self, terms: list[str], known: frozenset[str] = frozenset()) -> None:
        self.terms, self.known = terms, known
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.most: list[int] = [0]  # edits that some term below allows
        for i, term in enumerate(terms):
            node, edits = 0, allowed_edits(term)
            self.most[0] = max(self.most[0], edits)
            for c in term.removesuffix("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.most.append(0)
                node = self.children[node][c]
                self.most[node] = max(self.most[node], edits)
            self.ends[node] = i
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[int, int] | None] = []
        self.whole: list[tuple[int, int] | None] = []  # the same without stems, for known words
        self.final: list[bool] = []  # a stem is complete without edits: any ending will do
        self.number({(0, 0)})

    def number(self, states: set[tuple[int, int]]) -> int:
        """The state of a set, closed under skipping letters of terms; -1 for none."""
        best: dict[int, int] = {}
        stack = list(states)
        while stack:
            node, edits = stack.pop()
            if edits > self.most[node] or best.get(node, 99) <= edits:
                continue
            best[node] = edits
            stack += [(child, edits + 1) for child in self.children[node].values()]
        if not best:
            return -1
        key = frozenset(best.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            hits = [(edits, self.ends[node]) for node, edits in key if self.ends[node] >= 0 and edits <= allowed_edits(self.terms[self.ends[node]])]
            stems = [h for h in hits if h[0] == 0 and self.terms[h[1]].endswith("*")]
            self.accepts.append(min(stems or hits) if hits else None)
            self.whole.append(min((h for h in hits if not self.terms[h[1]].endswith("*")), default=None))
            self.final.append(bool(stems))
        return self.numbers[key]

    def complete(self, node: int, edits: int) -> bool:
        """Whether a stem ends at the node within its edits; what such a node leads on to is never nearer than the stem."""
        term = self.terms[self.ends[node]] if self.ends[node] >= 0 else ""
        return term.endswith("*") and edits <= allowed_edits(term)

    def step(self, state: int, c: str) -> int:
        after: set[tuple[int, int]] = set()
        for node, edits in self.sets[state]:
            after.add((node, edits if self.complete(node, edits) else edits + 1))  # of an ending, or a letter too many
            for own, child in self.children[node].items():
                after.add((child, edits if own == c else edits + 1))
        self.steps[state][c] = to = self.number(after)
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        """(distance, term) or None."""
        state = 0
        for c in word:
            to = self.steps[state].get(c)
            state = self.step(state, c) if to is None else to
            if state < 0:
                return None
            if self.final[state]:
                return self.accepts[state]
        return self.whole[state] if word in self.known else self.accepts[state]


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    context: dict[str, float] = field(default_factory=dict)
    coefficients: list[float] = field(default_factory=list)
    known: frozenset[str] = frozenset()


N_FEATURES = 8


def hits_of(batch: pa.RecordBatch, lexicon: FuzzyLexicon, hasher: Hasher):  # noqa: ANN201
    """For each slice of a batch and each text of it: its words (as bytes), number of words, and hits (position, distance, term)."""
    for part, data, offsets in chunks(batch):
        w = Words(data, offsets)
        raw = data.tobytes()
        where, which = distinct(hasher, data, w.starts, w.ends)
        found = [lexicon.match(plain(raw[a:b].decode("utf-8", "replace"))) for a, b in zip(w.starts[where].tolist(), w.ends[where].tolist(), strict=True)]
        hit = np.array([f is not None for f in found], bool)
        if len(lexicon.sets) > lexicon.MAX_STATES:
            lexicon.reset()
        at = np.flatnonzero(hit[which]) if len(which) else np.empty(0, np.int64)
        owner = np.searchsorted(w.first, at, side="right") - 1
        cut = np.searchsorted(owner, np.arange(part.num_rows + 1))
        word = lambda i: raw[w.starts[i] : w.ends[i]].decode("utf-8", "replace")  # noqa: B023, E731
        for i in range(part.num_rows):
            own = [(int(p), *found[which[p]]) for p in at[cut[i] : cut[i + 1]]]
            yield int(w.first[i]), int(w.first[i + 1]), word, own


def window_words(lo: int, hi: int, word, p: int) -> list[str]:  # noqa: ANN001
    return [plain(word(j)) for j in range(max(lo, p - REACH), min(hi, p + REACH + 1)) if j != p]


def is_quoted(lo: int, hi: int, word, p: int) -> bool:  # noqa: ANN001
    """Whether a quotation is open at word p: an odd number of marks in the window before it, and one in the window after."""
    before = "".join(word(j) for j in range(max(lo, p - REACH), p)) + word(p)[:1]
    after = word(p)[-1:] + "".join(word(j) for j in range(p + 1, min(hi, p + REACH + 1)))
    return sum(before.count(q) for q in _QUOTES) % 2 == 1 and any(q in after for q in _QUOTES)


def features(lo: int, hi: int, word, hits: list[tuple[int, int, int]], model: Model) -> list[float]:  # noqa: ANN001
    """Of one text. Quoted hits have a weight of their own and count nowhere else: what a text cites is not what it says."""
    weight = quoted = fuzzy = used = 0.0
    around: list[float] = []
    for p, distance, term in hits:
        own = model.weights[term] / (1 + distance)
        if is_quoted(lo, hi, word, p):
            quoted += own
            continue
        weight += own
        around.append(sum(model.context.get(x, 0.0) for x in window_words(lo, hi, word, p)))
        fuzzy += distance > 0
        used += 1
    n = hi - lo
    return [1.0, math.log1p(weight), math.log1p(quoted), math.log1p(fuzzy), float(weight > 0), max(-5.0, min(5.0, sum(around) / len(around))) if around else 0.0, min(1.0, 20 * used / n) if n else 0.0, math.log1p(n) / 10]


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps with a quadratic penalty."""
    beta = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * penalty
    ridge[0, 0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """toxic, text to word, context (its neighbours), toxic."""
    for batch in batches:
        words, around, labels = [], [], []
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            own = ["", *(plain(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")), ""]
            rows = {(own[i], own[i - 1] + " " + own[i + 1]) for i in range(1, len(own) - 1) if len(own[i]) >= 3}
            words += [r[0] for r in rows]
            around += [r[1] for r in rows]
            labels += [toxic] * len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(around, pa.string()), pa.array(labels, pa.int32())], names=["word", "around", "toxic"])


def chosen_terms(rows: list) -> list[tuple[str, float]]:
    """Words and stems (term, contexts t, odds), the strongest first, without those that a chosen stem covers. A stem
    is made as long as it can be without losing a tenth of its contexts, and gives way to a word that has most of them."""
    longer_of: dict[str, list[tuple[int, str]]] = {}  # stems by what they are without their last letter
    best_word: dict[str, int] = {}  # most contexts of a word with this beginning
    for r in rows:
        body = r["word"].removesuffix("*")
        if r["word"].endswith("*"):
            longer_of.setdefault(body[:-1], []).append((r["t"], body))
        else:
            for k in range(STEM[0], min(STEM[1], len(body)) + 1):
                best_word[body[:k]] = max(best_word.get(body[:k], 0), r["t"])
    out: list[tuple[str, float]] = []
    stems: set[str] = set()
    for r in sorted(rows, key=lambda r: (-r["t"] * r["odds"], len(r["word"]), r["word"])):
        term, body = r["word"], r["word"].removesuffix("*")
        if any(body[:k] in stems for k in range(STEM[0], min(STEM[1], len(body)) + 1)):
            continue
        if term.endswith("*"):
            while longer := max((x for x in longer_of.get(body, ()) if x[0] >= 0.9 * r["t"]), default=None):
                body = longer[1]
            term = body + "*"
            if body in stems or 1.3 * best_word.get(body, 0) >= r["t"]:
                continue
            stems.add(body)
        out.append((term, float(r["odds"])))
    return out


def _log_odds(counts: DataFrame, least: int, stems: bool = False) -> DataFrame:
    """word, toxic, n to word, t, odds (smoothed, on the whole table), z; with stems, also for the beginnings of words."""
    wide = counts.groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("o"))
    wide = keep(wide, "odds")
    t, o = wide.agg(F.sum("t"), F.sum("o")).first()
    odds = F.log((F.col("t") + 0.5) / F.lit(float((t or 0) + 1))) - F.log((F.col("o") + 0.5) / F.lit(float((o or 0) + 1)))
    if stems:
        lo, hi = STEM
        own = F.explode(F.expr(f"transform(sequence({lo}, least({hi}, length(word))), k -> concat(left(word, k), '*'))"))
        begun = wide.where((F.length("word") >= lo) & ~F.contains("word", F.lit("*"))).select(own.alias("word"), "t", "o").groupBy("word").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
        wide = wide.where(~F.endswith("word", F.lit("*"))).unionByName(begun)
    chance = (F.col("t") + F.col("o")) * F.lit(float(t or 0) / max(1.0, float((t or 0) + (o or 0))))
    return wide.where(F.col("t") + F.col("o") >= least).withColumn("odds", odds).withColumn("z", (F.col("t") - chance) / F.sqrt(F.greatest(chance, F.lit(1e-9))))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """text, toxic of at most ``most`` labelled documents outside the held-out third, one row a document."""
    seen = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    few = seen.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    few = few.withColumnRenamed("doc_id", "__id")
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(few), F.col("doc_id") == F.col("__id"))
    return found.groupBy("__id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    bounded_batches(docs.sparkSession)
    train = keep(training_rows(docs, labels, most), "train")
    counts = train.mapInArrow(contexts, "word string, around string, toxic int").distinct().groupBy("word", "toxic").agg(F.count(F.lit(1)).alias("n"))
    counts = keep(counts, "counts")
    found = _log_odds(counts, MIN_CONTEXTS, stems=True).where((F.col("odds") >= math.log(LEAST_LIFT)) & (F.col("z") >= LEAST_Z) & (F.col("t") >= MIN_CONTEXTS))
    terms = chosen_terms(found.collect())  # of the words of the sample
    model = Model([t for t, _ in terms], [w for _, w in terms])
    if not terms:
        return model

    def near_stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = FuzzyLexicon([t for t in model.terms if t.endswith("*")])
        for batch in batches:
            rows = [w for w in batch.column("word").to_pylist() if (found := lexicon.match(w)) and found[0]]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["word"])

    if any(t.endswith("*") for t in model.terms):
        used = _log_odds(counts, 1).where((F.col("o") > 0) & (F.col("odds") < math.log(LEAST_LIFT))).select("word")
        model.known = frozenset(r["word"] for r in used.mapInArrow(near_stems, "word string").collect())

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, hasher = FuzzyLexicon(model.terms, model.known), Hasher()
        for batch in batches:
            labels_, rows = batch.column("toxic").to_pylist(), []
            for (lo, hi, word, hits), toxic in zip(hits_of(batch, lexicon, hasher), labels_, strict=True):
                rows += [(x, toxic) for x in {x for p, _, _ in hits for x in window_words(lo, hi, word, p)} if x]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], names=["word", "toxic"])

    near = _log_odds(train.mapInArrow(around, "word string, toxic int").groupBy("word", "toxic").agg(F.count(F.lit(1)).alias("n")), MIN_CONTEXTS)
    model.context = {r["word"]: max(-2.0, min(2.0, float(r["odds"]))) for r in near.orderBy("word").collect()}  # of the words near the sample's hits

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, hasher = FuzzyLexicon(model.terms, model.known), Hasher()
        for batch in batches:
            rows = [features(lo, hi, word, hits, model) for lo, hi, word, hits in hits_of(batch, lexicon, hasher)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    rows = train.mapInArrow(measured, "x array<double>, toxic int").toPandas()  # at most MAX_TRAIN rows of N_FEATURES
    model.coefficients = [float(c) for c in fit(np.array(rows["x"].tolist()).reshape(-1, N_FEATURES), rows["toxic"].to_numpy(float))]
    return model


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, hasher = FuzzyLexicon(model.terms, model.known), Hasher()
        beta = np.array(model.coefficients)
        for batch in batches:
            out, n = [], []
            for lo, hi, word, hits in hits_of(batch, lexicon, hasher):
                x = float(np.dot(features(lo, hi, word, hits, model), beta)) if len(beta) else -math.inf
                out.append(1 / (1 + math.exp(-x)) if x > -700 else 0.0)
                n.append(len(hits))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.float64()), pa.array(n, pa.int64())], names=["doc_id", "score", "n_hits"])

    bounded_batches(docs.sparkSession)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    found = slim.mapInArrow(scored, f"doc_id {kind}, score double, n_hits long")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")
