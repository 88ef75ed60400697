"""Toxicity classifier with counterfactual regularisation.

A logistic model over the words and word beginnings that a text holds. Besides fitting the labels, training penalises
the change of a sentence's logit when its identity terms are swapped: for every sampled sentence that names a group, the term is replaced by
the other terms of its category and by a neutral word, and the squared change of the logit is added to the loss. So the weights of group
mentions are pulled together and towards a neutral word's, and neutral mentions don't raise the score.

The model is fitted on a bounded sample of labelled rows (SAMPLE_ROWS per class, by a hash of the id); features come from that sample alone, and the
driver receives only the sample's selected features. Both classes weigh as TOXIC_WEIGHT says whatever their numbers are, so that a score means
the same on tables of any size. Every whole text is scored, by executors, without a shuffle.

Defined results: a null or empty text gets the score of a text without features; a text of any length is scored as a whole; texts with the same
words tie; a label of a document without a row is not used; of contradicting
labels of a document the toxic one counts, null labels are ignored; if a class has no labelled row, every score is the share of toxic rows
(0 if there is none); repeated rows get equal scores; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import held_out, map_batches, strings, tidied

#: Labelled rows of each class that are sampled, features of the model, and rows of a class that a feature needs.
SAMPLE_ROWS, MAX_FEATURES, MIN_ROWS = 6000, 4000, 5
#: Least likelihood ratio of a feature.
MIN_RATIO = 15.0
#: Strength of the counterfactual penalty and of the ridge; steps of training; share of the toxic rows in the loss.
COUNTERFACTUAL, RIDGE, STEPS, TOXIC_WEIGHT = 1.0, 1e-5, 400, 0.3

#: Identity terms by category; the first of each is the neutral word.
IDENTITY = {
    "gender": ("person", "woman", "man", "girl", "boy", "transgender", "nonbinary"),
    "genders": ("people", "women", "men", "girls", "boys"),
    "faith": ("believer", "muslim", "christian", "jew", "hindu", "buddhist", "sikh", "atheist"),
    "faiths": ("believers", "muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists"),
    "origin": ("foreign", "african", "arab", "asian", "european", "latino", "mexican", "chinese", "jewish", "islamic"),
    "orientation": ("single", "gay", "lesbian", "bisexual", "straight", "queer"),
    "ability": ("ill", "blind", "deaf", "disabled", "autistic"),
    "de": ("mensch", "frau", "mann", "muslima", "jude", "christ", "schwuler"),
    "fr": ("personne", "femme", "homme", "musulman", "juif", "chrétien"),
    "es": ("persona", "mujer", "hombre", "musulmán", "judío", "cristiano"),
}
_CATEGORY = {term: terms for terms in IDENTITY.values() for term in terms}
_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def features(words: Iterable[str]) -> set[str]:
    """A text's features: its words, and the first 4 and 5 letters of longer ones. Identity terms have no beginnings."""
    own = set(words)
    out = set(own)
    for w in own:
        if len(w) > 4 and w not in _CATEGORY:
            out.add(w[:4] + "*")
            out.add(w[:5] + "*")
    return out


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def counterfactuals(text: str) -> Iterator[tuple[list[str], list[str]]]:
    """(sentence's words, words after a swap) for the sentences that hold identity terms."""
    for sentence in _SENTENCE.split(text):
        words = words_of(sentence)
        named = [w for w in set(words) if w in _CATEGORY]
        for term in named:
            for other in _CATEGORY[term]:
                if other != term:
                    yield words, [other if w == term else w for w in words]


class Model:
    """Weights by feature, and the bias."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.whole = {f for f in weights if not f.endswith("*")}
        self.starts = {f[:-1] for f in weights if f.endswith("*")}

    def logit(self, words: list[str]) -> float:
        own = set(words)
        total, weights = self.bias, self.weights
        found = own & self.whole
        if self.starts:
            longer = [w for w in own if len(w) > 4 and w not in _CATEGORY]
            found |= {s + "*" for s in self.starts.intersection([w[:4] for w in longer])}
            found |= {s + "*" for s in self.starts.intersection([w[:5] for w in longer])}
        for f in sorted(found):  # in one order, so that equal texts have equal scores
            total += weights[f]
        return total

    def score(self, text: str) -> float:
        z = self.logit(words_of(text))
        return 1.0 / (1.0 + math.exp(-z)) if z > -700 else 0.0


Swap = tuple[tuple[int, ...], tuple[int, ...]]


def fit(
    rows: list[tuple[list[int], int]], swaps: dict[Swap, int], names: list[str], penalty: float = COUNTERFACTUAL, steps: int = STEPS, toxic_weight: float = TOXIC_WEIGHT
) -> Model:
    """Full-batch training on (features, label) rows and on swaps (features that go and that come, and how often), by Adam."""
    n = len(names)
    y = np.array([label for _, label in rows], dtype=float)
    at = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    col = np.concatenate([np.array(f, dtype=int) for f, _ in rows]) if rows else np.zeros(0, int)
    weight = np.where(y > 0, toxic_weight / max(1, y.sum()), (1 - toxic_weight) / max(1, (1 - y).sum()))
    # A swap's change of logit is linear in the weights: minus what goes, plus what comes.
    pairs = sorted(swaps)
    often = np.array([swaps[p] for p in pairs], dtype=float)
    p_at = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs])
    p_col = np.concatenate([np.array(a + b, dtype=int) for a, b in pairs]) if pairs else np.zeros(0, int)
    p_sign = np.concatenate([np.r_[-np.ones(len(a)), np.ones(len(b))] for a, b in pairs]) if pairs else np.zeros(0)
    w, bias = np.zeros(n), 0.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, steps + 1):
        z = np.bincount(at, w[col], minlength=len(rows)) + bias
        gap = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * weight
        grad = np.bincount(col, gap[at], minlength=n) + RIDGE * w
        if len(pairs):
            change = np.bincount(p_at, w[p_col] * p_sign, minlength=len(pairs)) * often
            grad += 2 * penalty / often.sum() * np.bincount(p_col, change[p_at] * p_sign, minlength=n)
        g = np.r_[grad, gap.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if x}, float(bias))


def _likelihood(n_toxic: int, n_clean: int) -> Column:
    """The likelihood ratio of a feature (columns toxic and clean: rows that hold it) against independence of the label."""
    n, total = F.col("toxic") + F.col("clean"), n_toxic + n_clean
    cells = (
        (F.col("toxic"), n * (n_toxic / total)), (F.col("clean"), n * (n_clean / total)),
        (n_toxic - F.col("toxic"), (total - n) * (n_toxic / total)), (n_clean - F.col("clean"), (total - n) * (n_clean / total)),
    )
    parts = [F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0)) for seen, expected in cells]
    return 2 * (parts[0] + parts[1] + parts[2] + parts[3])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", penalty: float = COUNTERFACTUAL) -> Model:
    """A model from a bounded sample of the labelled rows that aren't held out."""
    rated = (
        labels.filter(~held_out(id_col) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("_id"))
        .agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    )
    order = F.xxhash64("_id")
    sample = None
    for label in (0, 1):
        part = rated.filter(F.col("_label") == label).orderBy(order, "_id").limit(SAMPLE_ROWS)
        sample = part if sample is None else sample.unionByName(part)
    # At most 2 * SAMPLE_ROWS ids are sent to the executors; equal texts count once.
    texts = (
        docs.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
        .join(F.broadcast(sample), "_id")
        .groupBy(F.sha2("_text", 256))
        .agg(F.max("_label").alias("label"), F.any_value("_text").alias("text"))
        .select("label", "text")
        .persist()
    )
    try:
        totals = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
        n_clean, n_toxic = totals.get(0, 0), totals.get(1, 0)
        if not n_clean or not n_toxic:
            share = n_toxic / max(1, n_clean + n_toxic)
            return Model({}, 50.0 if share else -50.0)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: tuple[Counter[str], Counter[str]] = (Counter(), Counter())
            for batch in batches:
                for label, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                    seen[label].update(features(words_of(text)))
            names = sorted(seen[0].keys() | seen[1].keys())
            for i in range(0, len(names), 50_000):
                part = names[i : i + 50_000]
                yield pa.RecordBatch.from_pydict({"feature": part, "toxic": [seen[1][f] for f in part], "clean": [seen[0][f] for f in part]})

        counts = texts.mapInArrow(tidied(count), "feature string, toxic bigint, clean bigint").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        # Features that are more frequent in toxic rows, those with the largest likelihood ratio; and the identity terms.
        own = F.col("feature").isin(*_CATEGORY)
        likely = counts.filter((F.col("toxic") + F.col("clean") >= MIN_ROWS) & (F.col("toxic") * n_clean > F.col("clean") * n_toxic) & ~own)
        ranked = likely.withColumn("g", _likelihood(n_toxic, n_clean)).filter(F.col("g") > MIN_RATIO).orderBy(F.desc("g"), "feature").limit(MAX_FEATURES)
        names = sorted(r["feature"] for r in ranked.select("feature").collect()) + sorted(_CATEGORY)
        index = {f: i for i, f in enumerate(names)}

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows of a label and features, and rows of a swap's features and its count, which are few different ones."""
            schema = pa.schema([("label", pa.int32()), ("own", pa.list_(pa.int32())), ("come", pa.list_(pa.int32())), ("n", pa.int64())])
            swaps: Counter[Swap] = Counter()
            for batch in batches:
                out = []
                for label, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                    out.append({"label": label, "own": sorted(index[f] for f in features(words_of(text)) if f in index)})
                    for a, b in counterfactuals(text):
                        before, after = set(a) & _CATEGORY.keys(), set(b) & _CATEGORY.keys()
                        swaps[tuple(sorted(index[f] for f in before - after)), tuple(sorted(index[f] for f in after - before))] += 1
                yield pa.RecordBatch.from_pylist(out, schema=schema)
            yield pa.RecordBatch.from_pylist([{"own": a, "come": b, "n": n} for (a, b), n in sorted(swaps.items())], schema=schema)

        got = texts.mapInArrow(tidied(vectors), "label int, own array<int>, come array<int>, n bigint").collect()  # bounded by the sample
    finally:
        texts.unpersist()
    rows = sorted([(r["own"], r["label"]) for r in got if r["n"] is None], key=lambda x: (x[1], x[0]))
    swaps: Counter[Swap] = Counter()
    for r in got:
        if r["n"] is not None:
            swaps[tuple(r["own"]), tuple(r["come"])] += r["n"]
    return fit(rows, swaps, names, penalty)


@functools.lru_cache(maxsize=2)
def _model(key: tuple[tuple[tuple[str, float], ...], float]) -> Model:
    return Model(dict(key[0]), key[1])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; the model is bounded by MAX_FEATURES."""
    kind = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
    key = (tuple(sorted(model.weights.items())), model.bias)

    def make() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        own = _model(key)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            scores = [own.score(t) for t in strings(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], schema=kind
            )

        return each

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return map_batches(source, make, "doc_id bigint, held_out boolean, score double, predicted int")


def toxic_column(model: Model, text_col: str = "text") -> Column:
    """A boolean column: whether the text's score is 0.5 or more (an Arrow UDF)."""
    key = (tuple(sorted(model.weights.items())), model.bias)

    @F.arrow_udf("boolean")
    def toxic(texts: pa.Array) -> pa.Array:
        own = _model(key)
        return pa.array([own.score(t) >= 0.5 for t in strings(texts)], pa.bool_())

    return toxic(F.col(text_col))
