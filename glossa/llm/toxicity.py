"""Toxicity by multiple-instance learning: only documents carry labels, sentences are the instances.

A sentence's probability is a logistic score of its words (each word and its prefixes are features); a document's
is their noisy-or, ``1 - prod(1 - p)``. The weights are fitted on document labels by gradient descent on the
noisy-or likelihood, so the model itself finds which sentences made a document toxic, and scoring reports them.

The model is fitted on a bounded sample: at most ``per_class`` labelled documents of each label (by hash order of
``doc_id``), reweighted to the true shares, with every feature whose document counts in the sample are significant. Features
come from Spark; the driver sees the selected ones and, of each sampled document, the sentences that hold any. The fitted model
is a number for each feature and is broadcast; scoring is one pass over all rows without a shuffle.

Defined results: a null or empty text has no sentence with words and gets the score of one plain sentence; a null
``doc_id`` is never held out and never learnt from; labels that are null are ignored, a document labelled twice is
toxic if any row says so; without labels of both kinds every score is the share of toxic labels (0 if none);
repeated rows are scored each; an empty table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import map_docs, store, with_fields

FOLDS, HELD_OUT = 4, 2
#: Labelled documents of each label the model is fitted on.
PER_CLASS = 4000
MIN_DOCS, MIN_Z = 4, 4.0
PREFIXES = range(3, 9)
THRESHOLD = 0.3
#: Words a worker keeps scored; clearing the cache never changes a score.
CACHE_WORDS = 300_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"\w+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def features(word: str) -> list[str]:
    """The whole word, marked at its end, and its prefixes."""
    return [word + "$", *(word[:k] for k in PREFIXES if k <= len(word))]


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, distinct lower-cased words) of each sentence that has a word."""
    found = ((m.start(), m.end(), sorted(set(_WORD.findall(m.group().lower())))) for m in _SENTENCE.finditer(text))
    return [s for s in found if s[2]]


# ---- the sample ---------------------------------------------------------------------------------

def training_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(text, toxic, weight): at most ``per_class`` documents of each label, outside the held-out fold, one row each (of a
    repeated ``doc_id`` that whose text has the smallest hash); a weight is the number of labelled documents that a
    sampled one stands for."""
    label = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
             .groupBy(F.col("doc_id").cast("long").alias("mil_doc")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    have = docs.select(F.col("doc_id").cast("long").alias("mil_doc")).distinct()
    label = store(label.join(have, "mil_doc", "left_semi"))
    share = {r["toxic"]: r["n"] for r in label.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("mil_doc")
    parts = [label.filter(F.col("toxic") == t).orderBy(order, "mil_doc").limit(per_class)
             .withColumn("weight", F.lit(n / min(n, per_class))) for t, n in share.items()]
    if not parts:
        return docs.select("text", F.lit(0).alias("toxic"), F.lit(1.0).alias("weight")).limit(0)
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.union(p)
    # at most 2 * per_class rows of three numbers: a proven bound for the broadcast
    met = docs.join(F.broadcast(chosen), docs["doc_id"].cast("long") == chosen["mil_doc"])
    one = met.groupBy("mil_doc", "toxic", "weight").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("row"))
    return one.select("row.text", "toxic", "weight")


def _feature_docs(batches):
    for b in batches:
        rows: Counter[tuple[str, int]] = Counter()
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            seen = {f for w in set(_WORD.findall((text or "").lower())) for f in features(w)}
            rows.update((f, toxic) for f in seen)
        names, toxic = zip(*rows) if rows else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(toxic, pa.int32()),
                                          pa.array(list(rows.values()), pa.int64())], names=["f", "toxic", "n"])


def select_features(sample: DataFrame, n_pos: int, n_neg: int) -> list[str]:
    """Features significantly more frequent in toxic documents: the z of their log odds (smoothed by a half)."""
    n = (map_docs(sample.select("text", "toxic"), _feature_docs, "f string, toxic int, n long").groupBy("f")
         .agg(F.coalesce(F.sum(F.when(F.col("toxic") == 1, F.col("n"))), F.lit(0)).alias("a"),
              F.coalesce(F.sum(F.when(F.col("toxic") == 0, F.col("n"))), F.lit(0)).alias("b")))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    c, d = n_pos - F.col("a") + 0.5, n_neg - F.col("b") + 0.5
    z = (F.log(a / c) - F.log(b / d)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    # the smoothed z is bounded by the rarer cell, so rare but pure features are measured by their expected count
    pure = (F.col("a") * n_neg - F.col("b") * n_pos) / F.sqrt(F.lit(float(n_pos) * n_neg) * (F.col("a") + F.col("b")))
    rows = (n.filter(F.col("a") >= MIN_DOCS).withColumn("z", F.greatest(z, pure)).filter(F.col("z") >= MIN_Z)
            .select("f").collect())
    return sorted(r["f"] for r in rows)


def _bags(chosen):
    def run(batches):
        index = {f: i for i, f in enumerate(chosen.value)}
        for b in batches:
            plain, ids, sizes, times = [], [], [], []
            for text in b.column(0).to_pylist():
                bags, empty = Counter(), 0
                for _, _, words in sentences(text or ""):
                    found = [index[f] for w in words for f in features(w) if f in index]
                    empty += not found
                    if found:
                        bags[tuple(sorted(found))] += 1
                plain.append(max(empty, 0 if bags else 1))
                ids.append([i for bag in bags for i in bag])
                sizes.append([len(bag) for bag in bags])
                times.append(list(bags.values()))
            yield pa.RecordBatch.from_arrays(
                [b.column(1), b.column(2), pa.array(plain, pa.int64()), pa.array(ids, pa.list_(pa.int32())),
                 pa.array(sizes, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))],
                names=["toxic", "weight", "plain", "ids", "sizes", "times"])
    return run


# ---- the model ----------------------------------------------------------------------------------

@dataclass
class Model:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)
    constant: float | None = None  # the score of every document where nothing can be learnt

    def word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features(word))


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _softplus(z):
    return np.logaddexp(0, z)


def fit_bags(rows: list, n_features: int, rounds: int = 400, rate: float = 0.3, l2: float = 1e-4) -> tuple[float, np.ndarray]:
    """Bias and weights by full-batch Adam on the noisy-or log likelihood plus an L2 term. A row's sentences are its distinct
    bags, met ``times`` (once each if not given).

    log(1 - P) of a document is minus the sum of softplus(z) over its sentences, so a clean document pulls every
    sentence down by p, and a toxic one pulls each up by p * (1 - P) / P."""
    y = np.array([r["toxic"] for r in rows], float)
    weight = np.array([r["weight"] for r in rows])
    weight /= weight.sum()
    plain = np.array([r["plain"] for r in rows], float)
    sizes = [n for r in rows for n in r["sizes"]]
    doc = np.repeat(np.arange(len(rows)), [len(r["sizes"]) for r in rows])
    times = np.array([n for r in rows for n in (r["times"] if "times" in r else [1] * len(r["sizes"]))], float)
    ids = np.array([i for r in rows for i in r["ids"]], int)
    sent = np.repeat(np.arange(len(sizes)), sizes)
    theta = np.zeros(n_features + 1)
    theta[-1] = -5.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        w, b = theta[:-1], theta[-1]
        z = b + np.bincount(sent, w[ids], len(sizes))
        clean = plain * _softplus(b) + np.bincount(doc, times * _softplus(z), len(rows))  # -log(1 - P)
        p_doc = -np.expm1(-clean)
        pull = weight * np.where(y == 1, -np.exp(-clean) / np.maximum(p_doc, 1e-12), 1.0)
        g_sent = times * pull[doc] * _sigmoid(z)
        grad = np.append(np.bincount(ids, g_sent[sent], n_features) + l2 * w / n_features,
                         g_sent.sum() + (pull * plain).sum() * _sigmoid(b))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - rate * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return float(theta[-1]), theta[:-1]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    sample = store(training_sample(docs, labels, per_class))
    seen = {r["toxic"]: (r["n"], r["w"]) for r in
            sample.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect()}
    if not (seen.get(1) and seen.get(0)):
        return Model(0.0, constant=1.0 if seen.get(1) else 0.0)
    chosen = select_features(sample, seen[1][0], seen[0][0])
    sc = docs.sparkSession.sparkContext
    bags = map_docs(sample, _bags(sc.broadcast(chosen)), "toxic int, weight double, plain long, ids array<int>, sizes array<int>, times array<int>")
    bias, weights = fit_bags(bags.collect(), len(chosen))
    return Model(bias, {f: float(w) for f, w in zip(chosen, weights, strict=True) if w})


# ---- scoring ------------------------------------------------------------------------------------

class _WordWeights(dict):
    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found = self.model.word(word)
        return found


def score_text(text: str, weight_of, model: Model, threshold: float = THRESHOLD):
    """(noisy-or score, number of sentences, offending sentences as (start, end, score)).

    A text none of whose words has a weight needs only its number of sentences."""
    low = text.lower()
    if not any(map(weight_of, set(_WORD.findall(low)))):
        n = max(1, sum(1 for m in _SENTENCE.finditer(text) if _WORD.search(m.group())))
        return -math.expm1(-n * float(_softplus(model.bias))), n, []
    found = sentences(text)
    clean, offending = 0.0, []
    for start, end, words in found:
        z = model.bias + sum(map(weight_of, words))
        clean += float(_softplus(z))
        p = float(_sigmoid(z))
        if p >= threshold:
            offending.append((start, end, p))
    return -math.expm1(-clean), len(found), offending


OFFENDING = "array<struct<start:int,end:int,score:double>>"


def _score(model, text_at: int, threshold: float, names: list[str]):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        m = model.value
        weight_of = _WordWeights(m).__getitem__
        for b in batches:
            texts = b.column(text_at).to_pylist()
            out = [score_text(t or "", weight_of, m, threshold) for t in texts]
            scores = [o[0] if m.constant is None else m.constant for o in out]
            spans = [[{"start": s, "end": e, "score": p} for s, e, p in o[2]] for o in out]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array(spans, kind)], names=names)
    return run


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` plus held_out, score, predicted and offending (character spans of sentences over the threshold)."""
    docs = docs.drop("held_out", "score", "predicted", "offending")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = with_fields(docs.schema, ("score", "double"), ("offending", OFFENDING))
    scored = map_docs(docs, _score(shared, docs.columns.index("text"), threshold, schema.names), schema)
    return scored.select(*docs.columns, held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")


def classify(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """Fit on the labels and score every row of ``docs``."""
    return score_documents(docs, fit(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), **bounds))
