"""Toxicity: cumulative-link ordinal regression over sparse word features."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .labelled import training_texts
from .scratch import materialize

#: About so many labelled rows are used to fit, and at most so many words become features.
TRAIN_ROWS = 12_000
MAX_FEATURES = 4096
MIN_DOCS, MIN_Z = 4, 4.0
GRADES = 4
PREFIXES = (4, 5, 6)
STEPS, RATE, RIDGE = 400, 0.1, 2e-4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: ASCII that is neither letter nor digit.
_BETWEEN = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and of its beginnings of PREFIXES bytes (0 where the word is no longer than that), and the rows' offsets in them.

    Case of ASCII and Latin-1 letters is folded. Beginnings catch words that are inflected or made up.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = _LOWER[data]
    upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    low[upper] += 0x20
    starts, ends, firsts = tk.words(low, offsets, _BETWEEN)
    out = np.zeros((len(starts), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = tk.span_hash(low, starts, ends)
    for j, size in enumerate(PREFIXES):
        longer = np.flatnonzero(ends - starts > size)
        out[longer, 1 + j] = tk.mix(tk.span_hash(low, starts[longer], starts[longer] + size) + np.uint64(size))
    return out.ravel(), firsts * out.shape[1]


@dataclass
class OrdinalModel:
    """P(grade <= k) = sigmoid(cuts[k] - x w): one weight vector for all cuts. words: sorted hashes of the features."""

    words: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def features(self, hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, feature and value (1 + log of the count) of all that is not zero."""
        if not len(self.words) or not len(hashes):
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0)
        place = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        hit = np.flatnonzero(self.words[place] == hashes)
        row = np.searchsorted(firsts, hit, side="right") - 1
        pairs, n = np.unique(row * len(self.words) + place[hit], return_counts=True)
        return pairs // len(self.words), pairs % len(self.words), 1 + np.log(n)

    def exceed(self, eta: np.ndarray) -> np.ndarray:
        """P(grade > k) for each cut k."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - eta[:, None], -40, 40)))

    def eta(self, hashes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        row, feature, value = self.features(hashes, firsts)
        return np.bincount(row, self.weights[feature] * value, minlength=len(firsts) - 1)


def fit_ordinal(row: np.ndarray, feature: np.ndarray, value: np.ndarray, n_features: int, grades: np.ndarray, n_grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing cuts by Adam on the penalised log likelihood."""
    n = len(grades)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=n_grades))[:-1] / max(1, n), 1e-4, 1 - 1e-4)
    cuts = np.log(share / (1 - share))
    theta = np.concatenate([np.zeros(n_features), cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, gaps = theta[:n_features], np.exp(np.clip(theta[n_features + 1 :], -10, 5))
        cuts = np.concatenate([theta[n_features : n_features + 1], theta[n_features] + np.cumsum(gaps)])
        eta = np.bincount(row, w[feature] * value, minlength=n)
        edges = np.concatenate([np.full((n, 1), -40.0), cuts[None, :] - eta[:, None], np.full((n, 1), 40.0)], axis=1)
        cdf = 1 / (1 + np.exp(-np.clip(edges, -40, 40)))
        slope = cdf * (1 - cdf)
        slope[:, 0] = slope[:, -1] = 0
        at = np.arange(n)
        p = np.maximum(cdf[at, grades + 1] - cdf[at, grades], 1e-12)
        up, down = slope[at, grades + 1] / p, slope[at, grades] / p
        d_eta = (up - down) / n  # of the negative log likelihood
        d_cuts = np.bincount(grades, -up, minlength=n_grades)[:-1] / n + np.bincount(grades, down, minlength=n_grades)[1:] / n
        grad = np.concatenate([np.bincount(feature, value * d_eta[row], minlength=n_features) + RIDGE * w, [d_cuts.sum()], np.cumsum(d_cuts[::-1])[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        rate = RATE * (1 - step / (STEPS + 1))
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    w, gaps = theta[:n_features], np.exp(np.clip(theta[n_features + 1 :], -10, 5))
    return w, np.concatenate([theta[n_features : n_features + 1], theta[n_features] + np.cumsum(gaps)])


def standing(docs: np.ndarray, hits: np.ndarray, share: float) -> np.ndarray:
    """How many standard errors the share of toxic texts (hits of docs) of a word lies from the mean share."""
    return (hits - docs * share) / np.sqrt(docs * share * (1 - share))


def no_model(toxic: np.ndarray, n_grades: int) -> OrdinalModel:
    """Of no labels, or labels of one kind: all texts have that one."""
    cut = -40.0 if len(toxic) and toxic[0] else 40.0
    return OrdinalModel(np.zeros(0, np.uint64), np.zeros(0), np.full(n_grades - 1, cut))


def train(words: np.ndarray, row: np.ndarray, feature: np.ndarray, value: np.ndarray, toxic: np.ndarray, n_grades: int = GRADES) -> OrdinalModel:
    """Fit on the features (row, index in words, value) of texts and their 0/1 labels.

    A label says toxic or not. The grades of toxic texts are equal parts of them, from 1 (least) to n_grades - 1, by how much of
    the vocabulary of toxic texts they hold: the summed values of features whose share of toxic texts is MIN_Z standard errors above
    the mean. That is counted before any fit; no label says it, so severity orders texts by it and is no judgement of a reader.
    """
    toxic = np.asarray(toxic).astype(np.int64)
    if not len(toxic) or toxic.min() == toxic.max():
        return no_model(toxic, n_grades)
    docs, hits = np.bincount(feature, minlength=len(words)), np.bincount(feature, toxic[row], minlength=len(words))
    leaning = standing(np.maximum(docs, 1), hits, toxic.mean()) >= MIN_Z
    evidence = np.bincount(row, leaning[feature] * value, minlength=len(toxic))[toxic == 1]
    steps = np.quantile(evidence, np.arange(1, n_grades - 1) / (n_grades - 1))
    grades = np.zeros(len(toxic), np.int64)
    grades[toxic == 1] = 1 + np.searchsorted(steps, evidence, side="left")
    weights, cuts = fit_ordinal(row, feature, value, len(words), grades, n_grades)
    return OrdinalModel(words, weights, cuts)


def _occurrences(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to (word, docs, hits): texts with the word, and toxic ones, summed in a slice."""
    for batch in batches:
        labels = batch.column(0).to_numpy()
        for first, last, data, offsets in tk.slices(batch.column(1)):
            hashes, at = word_features(data, offsets)
            row = tk.row_of(at)
            order = np.lexsort((row, hashes))
            hashes, row = hashes[order], row[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
            hashes, hit = hashes[new & (hashes > 0)], labels[first:last][row[new & (hashes > 0)]]
            words, which, docs = np.unique(hashes, return_inverse=True, return_counts=True)
            hits = np.bincount(which, hit, minlength=len(words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(docs, pa.int64()), pa.array(hits)], names=["word", "docs", "hits"])


def fit(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int = TRAIN_ROWS) -> OrdinalModel:
    """Learn from labels (doc_id and a 0/1 column) where usable holds, about `rows` of them chosen by a hash of doc_id.

    Words and beginnings become features if they are in MIN_DOCS of these texts or more and their share of toxic texts is MIN_Z
    standard errors from the mean; Spark counts them, and the MAX_FEATURES that stand out most come to the driver, with their
    values in these texts. Null labels and labels of no document are left out; of a repeated doc_id one text and the greatest
    label count.
    """
    # About `rows` texts, read by three jobs.
    texts = materialize(training_texts(docs, labels, label, usable, rows, 5), "labelled")
    counts = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    n, toxic = sum(counts.values()), counts.get(1, 0)
    if not 0 < toxic < n:
        return no_model(np.ones(1) if toxic else np.zeros(0), GRADES)
    p = toxic / n
    seen = tk.small_batches(texts).mapInArrow(_occurrences, "word bigint, docs bigint, hits bigint").groupBy("word").agg(F.sum("docs").alias("docs"), F.sum("hits").alias("hits"))
    z = F.abs(F.col("hits") - F.col("docs") * p) / F.sqrt(F.col("docs") * (p * (1 - p)))
    chosen = seen.filter(F.col("docs") >= MIN_DOCS).withColumn("z", z).filter(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "word").limit(MAX_FEATURES)
    words = np.sort(np.array([r["word"] for r in chosen.select("word").collect()], np.int64).view(np.uint64))
    blank = OrdinalModel(words, np.zeros(len(words)), np.zeros(1))

    def values(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in tk.slices(batch.column(1)):
                row, feature, value = blank.features(*word_features(data, offsets))
                at = np.searchsorted(row, np.arange(last - first + 1))
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x)) for x in (feature.astype(np.int32), value)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *lists], names=["label", "feature", "value"])

    got = texts.mapInArrow(values, "label int, feature array<int>, value array<double>").collect()
    got.sort(key=lambda r: (r["label"], r["feature"], r["value"]))
    row = np.repeat(np.arange(len(got)), [len(r["feature"]) for r in got])
    flat = lambda name, kind: np.array([v for r in got for v in r[name]], kind)
    return train(words, row, flat("feature", np.int64), flat("value", float), np.array([r["label"] for r in got]))


def grade(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """docs with severity (double, the expected grade), grade (int, the likeliest), toxic (int, 1 if P(grade > 0) >= 0.5) and kept (toxic = 0).

    A null, empty or wordless text has the severity of a text without features. Whole texts count, of any length; all
    other columns stay, and the four are replaced.
    """

    def make():
        def work(data: np.ndarray, offsets: np.ndarray) -> list:
            above = model.exceed(model.eta(*word_features(data, offsets)))
            each = np.concatenate([np.ones((len(above), 1)), above], axis=1) - np.concatenate([above, np.zeros((len(above), 1))], axis=1)
            toxic = above[:, 0] >= 0.5
            return [above.sum(axis=1), each.argmax(axis=1).astype(np.int32), toxic.astype(np.int32), ~toxic]

        return work

    return tk.append_columns(docs, "text", "severity double, grade int, toxic int, kept boolean", make)


def _remainder() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5))


def op5_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """grade over all documents, learned from the labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic", _remainder() != 0)
    return grade(docs.select("doc_id", (_remainder() == 0).alias("held_out"), "text"), model).drop("text")
