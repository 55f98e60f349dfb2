"""Toxicity by a counterfactual-regularised classifier.

A text's logit is the intercept plus the weights of its different words; a word's weight is the sum over its features,
the word itself and its beginnings of ``PREFIXES`` letters, hashed.  Weights are fitted by proximal gradient steps: the
logistic loss, an L1 term that leaves what does not tell labels apart at exactly zero (so a long clean text adds up to
nothing), and a counterfactual term: in each labelled sentence identity terms are swapped for the others of their group,
and the squared change of the score is penalised.  So a group that is mentioned more often in toxic rows does not become
toxic by its name, and neutral mentions of it are left alone.

Fitting uses a bounded sample: ``TOXIC_ROWS`` and ``CLEAN_ROWS`` rows, those of the smallest md5 of their id, without
texts over ``LONGEST_FITTED`` characters, and ``SWAPS`` swapped sentences.  Scoring covers every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlog.llm.columns import field, map_batches, slices, texts_of, without

TOXIC_ROWS, CLEAN_ROWS = 2_000, 4_000
LONGEST_FITTED = 32_768
SWAPS = 50_000
PREFIXES = (3, 4, 5, 6)
BUCKETS = 1 << 18
LEAST_ROWS = 3  # a feature in fewer fitted rows has no weight
STEPS = 150
SPARSE = 2e-3  # weight of the L1 term
FAIR = 5.0  # weight of the counterfactual term
HELD_WORDS = 500_000  # known words of a task

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[^.!?\n]+")

# Identity terms; those of one line are swapped for each other, the first is the neutral one.
IDENTITY_TERMS = (
    ("people", "women", "men", "girls", "boys"),
    ("person", "woman", "man", "girl", "boy"),
    ("people", "christians", "muslims", "jews", "hindus", "buddhists", "catholics", "atheists"),
    ("religious", "christian", "muslim", "jewish", "hindu", "buddhist", "catholic", "atheist"),
    ("local", "african", "american", "arab", "asian", "black", "chinese", "european", "indian", "latino", "mexican", "white"),
    ("people", "immigrants", "refugees", "foreigners", "natives"),
    ("straight", "bisexual", "gay", "homosexual", "heterosexual", "lesbian", "queer", "trans", "transgender"),
    ("healthy", "blind", "deaf", "disabled", "autistic"),
    ("adult", "old", "elderly", "young", "teenage"),
    ("personas", "mujeres", "hombres", "cristianos", "musulmanes", "judíos", "inmigrantes"),
    ("personnes", "femmes", "hommes", "chrétiens", "musulmans", "juifs", "immigrés"),
    ("menschen", "frauen", "männer", "christen", "muslime", "juden", "einwanderer"),
)


@dataclass(frozen=True)
class Model:
    buckets: tuple[int, ...]  # features with a weight
    weights: tuple[float, ...]
    intercept: float


def _bucket(feature: str) -> int:
    import zlib

    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % BUCKETS


def features(word: str) -> list[int]:
    return [_bucket(word), *(_bucket("^" + word[:n]) for n in PREFIXES if len(word) > n)]


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def swapped(text: str, groups: Sequence[Sequence[str]] = IDENTITY_TERMS) -> list[tuple[set[str], set[str]]]:
    """(words that go, words that come) of each sentence whose identity terms are swapped, one term at a time."""
    groups_of: dict[str, list] = {}
    for group in groups:
        for term in group:
            groups_of.setdefault(term, []).append(group)
    out = []
    for sentence in SENTENCE.findall(text.lower()):
        words = set(WORD.findall(sentence))
        for term in sorted(words & groups_of.keys()):
            for other in sorted({o for group in groups_of[term] for o in group} - words):
                out.append(({term}, {other}))
    return out


class _Words:
    """Numbers for words, and the features of each as one flat list."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.features: list[int] = []
        self.sizes: list[int] = []

    def __call__(self, words) -> list[int]:
        out = []
        for word in sorted(words):
            n = self.number.get(word)
            if n is None:
                n = self.number[word] = len(self.sizes)
                made = features(word)
                self.features += made
                self.sizes.append(len(made))
            out.append(n)
        return out


def fit_texts(
    rows: list[tuple[str, int]], groups: Sequence[Sequence[str]] = IDENTITY_TERMS, fair: float = FAIR, rate: float | None = None,
) -> Model:
    """Fit on (text, label) rows; ``rate`` is the share of label 1 where the rows come from (default: their own).

    With only one label, or none, every text gets that label's share (a half without labels).
    """
    import numpy as np

    y = np.array([label for _, label in rows], float)
    if not len(y) or y.min() == y.max():
        return Model((), (), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    words = _Words()
    found = [np.array(words(words_of(text)), np.int64) for text, _ in rows]
    at, word = np.repeat(np.arange(len(rows)), [len(f) for f in found]), np.concatenate(found)
    swaps = [s for text, _ in rows for s in swapped(text, groups)][:SWAPS]
    gone, come = (np.array([n for s in swaps for n in words(s[side])], np.int64) for side in (0, 1))
    count = len(words.sizes)
    has, feature = np.repeat(np.arange(count), words.sizes), np.array(words.features, np.int64)
    common = np.bincount(feature, np.bincount(word, minlength=count)[has], BUCKETS) >= LEAST_ROWS
    has, feature = has[common[feature]], (np.cumsum(common) - 1)[feature[common[feature]]]
    used = np.flatnonzero(common)

    def of_words(v):
        return np.bincount(has, v[feature], count)

    def to_features(v):
        return np.bincount(feature, v[has], len(used))

    # rows of either label count alike, so that few toxic rows are enough; the intercept is set right at the end
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    fair_share = 2 * fair / max(1, len(swaps))
    # a diagonal bound on the curvature gives every feature its own step
    size = np.bincount(has, minlength=count)
    load = np.bincount(at, size[word], len(y))
    curve = to_features(np.bincount(word, 0.25 * (share * load)[at], count)) + 1e-9
    if len(swaps):
        reach = fair_share * (size[gone] + size[come])
        curve += to_features(np.bincount(gone, reach, count) + np.bincount(come, reach, count))
    w, before, b, momentum = np.zeros(len(used)), np.zeros(len(used)), 0.0, 1.0
    for _ in range(STEPS):
        faster = (1 + np.sqrt(1 + 4 * momentum ** 2)) / 2
        v = w + (momentum - 1) / faster * (w - before)
        momentum = faster
        each = of_words(v)
        error = share * (1 / (1 + np.exp(-np.clip(b + np.bincount(at, each[word], len(y)), -30, 30))) - y)
        slope = np.bincount(word, error[at], count)
        if len(swaps):
            change = fair_share * (each[gone] - each[come])
            slope += np.bincount(gone, change, count) - np.bincount(come, change, count)
        before, w = w, v - to_features(slope) / curve
        w = np.sign(w) * np.maximum(np.abs(w) - SPARSE / curve, 0)
        b -= 2 * error.sum()
    logit = np.bincount(at, of_words(w)[word], len(y))
    rate = y.mean() if rate is None else rate
    slope, b = _calibrated(logit, y, 2 * share * np.where(y == 1, rate, 1 - rate))
    some = np.flatnonzero(w)
    return Model(tuple(used[some].tolist()), tuple((slope * w[some]).tolist()), b)


def _calibrated(logit, y, share) -> tuple[float, float]:
    """Slope and intercept that make logits chances among rows of the given weights; short steps, as labels may be separable."""
    import numpy as np

    x, theta = np.column_stack([logit, np.ones(len(y))]), np.zeros(2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (share * (p - y)) + 1e-3 * theta
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), slope)
        theta = theta - step * min(1.0, 1 / np.abs(step).max())
    return float(max(theta[0], 1e-3)), float(theta[1])


def fit(
    documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    use: Column | None = None, groups: Sequence[Sequence[str]] = IDENTITY_TERMS, fair: float = FAIR,
) -> Model:
    """Fit on rows of ``labels`` (of label 0 or 1, and where ``use``, over its columns, holds) that have a text.

    The sample of ids is bounded, so it is broadcast; an id with several labels counts with the largest, one with several
    texts with the smallest.  Rows with null ids or null texts are not learnt from; empty tables give a half to every text.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
    known = known.filter(use) if use is not None else known
    known = known.groupBy(F.col(doc_id).alias("id")).agg(F.max(label).cast("int").alias("label"))
    known = known.withColumn("place", F.md5(F.col("id").cast("string")))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    toxic, clean = (known.filter(F.col("label") == kind).orderBy("place", "id").limit(n) for kind, n in ((1, TOXIC_ROWS), (0, CLEAN_ROWS)))
    picked = toxic.unionByName(clean)  # each a top-k: no task sees all rows of a label
    texts = documents.select(documents[doc_id].alias("id"), documents[text].alias("text")).filter(F.length("text") <= LONGEST_FITTED)
    rows = texts.join(F.broadcast(picked), "id").groupBy("id", "label", "place").agg(
        F.min("text").alias("text")).collect()  # at most TOXIC_ROWS + CLEAN_ROWS
    rows.sort(key=lambda r: (r.place, r.id))
    rate = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit_texts([(r.text, r.label) for r in rows], groups, fair, min(max(rate, 1e-4), 1 - 1e-4))


def scorer(model: Model):
    """text -> chance of label 1.  Weights of words are kept, up to ``HELD_WORDS`` of them."""
    from math import exp

    weight = dict(zip(model.buckets, model.weights, strict=True))
    held: dict[str, float] = {}

    def chance(text: str) -> float:
        total, missing = model.intercept, []
        for word in words_of(text):
            w = held.get(word)
            if w is None:
                missing.append(word)
            else:
                total += w
        for word in missing:
            w = sum(weight.get(f, 0.0) for f in features(word))
            total += w
            if len(held) < HELD_WORDS:
                held[word] = w
        return 1 / (1 + exp(-min(max(total, -30), 30)))

    return chance


def score(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """Add ``out``, the chance (0 to 1) of label 1, instead of a column of that name; null is scored as the empty text.

    One pass, nothing is shuffled: repeated rows score alike, very long texts are read whole, an empty table stays empty.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept = without(df.columns if keep is None else keep, [out])
    schema = T.StructType([*(field(df, c) for c in kept), T.StructField(out, T.DoubleType(), False)])
    width = len(kept)

    def make(batches):
        import pyarrow as pa

        chance = scorer(sent.value)
        for batch in batches:
            for part in slices(batch, width):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:width], pa.array(list(map(chance, texts_of(part.column(width)))), pa.float64())], names=schema.names)

    return map_batches(df.select(*(df[c] for c in kept), df[text].alias("__text")), make, schema)
