"""Quality classifier: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .labelled import training_texts

PASSAGE_WORDS = 64
#: About so many labelled documents are used to fit, and of each at most so many passages, spread over the text.
TRAIN_ROWS, TRAIN_PASSAGES = 8000, 64
HIDDEN, GATES = 24, 16
#: Words and pairs of words are hashed to so many learned vectors.
BUCKETS = 1 << 13
EPOCHS, BATCH, RATE, DECAY = 16, 128, 0.01, 1e-4
#: The share of a passage's word vectors left out at a step of training.
DROPOUT = 0.3


def _classes() -> np.ndarray:
    """For each byte its class: 0 lower case, 1 upper case, 2 digit, 3 symbol, 4 shout, 5 stop, 6 other sign, 7 beyond ASCII, 8 line feed, 9 space."""
    out = np.full(256, 6, np.uint8)
    out[ord("a") : ord("z") + 1] = 0
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("0") : ord("9") + 1] = 2
    out[list(b"#*$%&|<>")] = 3
    out[list(b"!?")] = 4
    out[list(b".,;:")] = 5
    out[0x80:] = 7
    out[tk.IS_SPACE] = 9
    out[0x0A] = 8
    return out


CLASS = _classes()
N_CLASSES = 10
N_FEATURES = N_CLASSES + 12


@dataclass
class Passages:
    """What a passage (so many words in a row) is encoded by: shape holds a vector of counts; tokens the buckets of its words and pairs of words.

    Passage p has the tokens first_token[p] to first_token[p + 1]; row r has the passages first[r] to first[r + 1].
    """

    shape: np.ndarray
    tokens: np.ndarray
    first_token: np.ndarray
    first: np.ndarray

    def take(self, passages: np.ndarray, first: np.ndarray) -> Passages:
        """These passages, for rows that begin at first."""
        sizes = np.diff(self.first_token)[passages]
        return Passages(self.shape[passages], self.tokens[tk.ragged(self.first_token[passages], sizes)], np.concatenate([[0], np.cumsum(sizes)]), first)


def encode_passages(data: np.ndarray, offsets: np.ndarray, size: int = PASSAGE_WORDS) -> Passages:
    """The passages of a slice of rows; a row without words has one passage of zeros and no tokens."""
    starts, ends, firsts = tk.words(data, offsets)
    n_words = np.diff(firsts)
    n_passages = np.maximum(1, -(-n_words // size))
    first_passage = np.concatenate([[0], np.cumsum(n_passages)])
    total = int(first_passage[-1])
    out = np.zeros((total, N_FEATURES), np.float32)
    if not len(starts):
        return Passages(out, np.zeros(0, np.int16), np.zeros(total + 1, np.int64), first_passage)
    row = tk.row_of(firsts)
    passage = first_passage[row] + (np.arange(len(starts)) - firsts[row]) // size
    heads = np.flatnonzero(np.diff(passage, prepend=-1))
    own = passage[heads]
    tails = np.append(heads[1:], len(starts))
    words = (tails - heads).astype(np.float32)
    # From a passage's first byte to the next one's, or to the end of the row.
    begin = starts[heads]
    last = np.append(row[heads[1:]] != row[heads[:-1]], True)
    stop = np.where(last, offsets[row[heads] + 1], np.append(begin[1:], len(data)))
    chars = (stop - begin).astype(np.float32)
    kinds = CLASS[data]
    for j in range(N_CLASSES):
        upto = np.concatenate([[0], np.cumsum(kinds == j, dtype=np.int64)])
        out[own, j] = (upto[stop] - upto[begin]) / chars
        if j in (1, 3):
            held = (upto[ends] - upto[starts]).astype(np.float32)
            upper, symbols = (held, None) if j == 1 else (upper, held)
    length = (ends - starts).astype(np.float32)
    hashes = tk.span_hash(data, starts, ends)
    at = N_CLASSES

    def mean(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values.astype(np.float32), heads) / words

    average = mean(length)
    again = tk.repeats(tk.mix(hashes ^ tk.mix(passage.astype(np.uint64) + np.uint64(1))))
    same = np.zeros(len(starts), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (passage[1:] == passage[:-1])
    head_byte, end_byte = data[starts], data[ends - 1]
    features = [
        np.log1p(words),
        average,
        np.sqrt(np.maximum(0, mean(length**2) - average**2)),
        np.log(np.maximum.reduceat(length, heads)),
        mean(length <= 2),
        mean(again),
        mean(same),
        mean((CLASS[head_byte] == 1)),
        mean((upper >= 2) & (upper >= 0.6 * length)),
        mean(symbols > 0),
        mean(CLASS[end_byte] == 5),
        mean(CLASS[end_byte] == 4),
    ]
    for j, values in enumerate(features):
        out[own, at + j] = values
    # Each word, and each word with the one before it in the passage.
    before = np.zeros(len(starts), np.uint64)
    before[1:] = hashes[:-1]
    before[heads] = 0
    tokens = np.stack([hashes, tk.mix(before * np.uint64(3) + hashes)], axis=1) >> np.uint64(64 - BUCKETS.bit_length() + 1)
    sizes = np.zeros(total, np.int64)
    sizes[own] = 2 * (tails - heads)
    return Passages(out, tokens.astype(np.int16).ravel(), np.concatenate([[0], np.cumsum(sizes)]), first_passage)


def bag_sums(vectors: np.ndarray, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per passage the sum of its tokens' vectors over the root of their number; zeros without tokens."""
    sizes = np.diff(first)
    out = np.zeros((len(sizes), vectors.shape[1]), vectors.dtype)
    full = np.flatnonzero(sizes)
    if len(full):
        out[full] = np.add.reduceat(vectors[tokens], first[full], axis=0) / np.sqrt(sizes[full])[:, None].astype(vectors.dtype)
    return out


@dataclass
class AttentionModel:
    """Passage h = tanh(x W + e + b), attention a = softmax(tanh(h V) * sigmoid(h U) q), document z = sum a h, score = sigmoid(z w + c).

    x is a passage's scaled shape, e the sum of the learned vectors E of its tokens over the root of their number.
    """

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def _forward(self, x: np.ndarray, words: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        h = np.tanh(x @ p["W"] + words + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["q"]
        row = tk.row_of(first)
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[row])
        a = e / np.add.reduceat(e, first[:-1])[row]
        z = np.add.reduceat(h * a[:, None], first[:-1], axis=0)
        logit = np.clip(z @ p["w"] + p["c"], -30, 30)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "row": row, "score": 1 / (1 + np.exp(-logit))}

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def score(self, passages: Passages) -> np.ndarray:
        words = bag_sums(self.weights["E"], passages.tokens, passages.first_token)
        return self._forward(self._scaled(passages.shape), words, passages.first)["score"]

    def gradient(self, x: np.ndarray, tokens: np.ndarray, first_token: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss; x is scaled already."""
        p = self.weights
        f = self._forward(x, bag_sums(p["E"], tokens, first_token), first)
        row, a, h = f["row"], f["a"], f["h"]
        d_logit = (f["score"] - y) / len(y)
        d_z = d_logit[:, None] * p["w"]
        d_h = d_z[row] * a[:, None]
        d_a = (d_z[row] * h).sum(axis=1)
        d_e = a * (d_a - np.add.reduceat(a * d_a, first[:-1])[row])
        gate = d_e[:, None] * p["q"]
        d_t, d_s = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
        d_h += d_t @ p["V"].T + d_s @ p["U"].T
        d_x = d_h * (1 - h**2)
        share = (d_x / np.sqrt(np.maximum(1, np.diff(first_token)))[:, None])[tk.row_of(first_token)]
        vectors = np.stack([np.bincount(tokens, column, minlength=len(p["E"])) for column in share.T], axis=1)
        return {"W": x.T @ d_x, "E": vectors, "b": d_x.sum(axis=0), "V": h.T @ d_t, "U": h.T @ d_s, "q": (f["t"] * f["s"]).T @ d_e, "w": f["z"].T @ d_logit, "c": d_logit.sum()}


def train(bags: Passages | None, y: np.ndarray, seed: int = 6, epochs: int = EPOCHS) -> AttentionModel:
    """Fit by Adam on the passages of documents with a 0/1 label each. No document, or labels of one kind: a constant score."""
    rng = np.random.Generator(np.random.PCG64(seed))
    stacked = bags.shape if bags is not None else np.zeros((1, N_FEATURES), np.float32)
    model = AttentionModel(stacked.mean(axis=0), stacked.std(axis=0) + 1e-3)
    shapes = {"W": (N_FEATURES, HIDDEN), "E": (BUCKETS, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATES), "U": (HIDDEN, GATES), "q": (GATES,), "w": (HIDDEN,), "c": ()}
    p = model.weights
    for name, shape in shapes.items():
        p[name] = rng.normal(0, 1 / np.sqrt(shape[0]), shape) if name in "WVUqw" else np.zeros(shape)
    if bags is None or not len(y) or y.min() == y.max():
        p["w"] *= 0
        p["c"] = np.float64(0 if not len(y) else 4 * (2 * y[0] - 1))
        return model
    scaled = model._scaled(bags.shape).astype(np.float64)
    share = y.mean()
    p["c"] = np.log(share / (1 - share))
    m, v, step = {k: np.zeros(s) for k, s in shapes.items()}, {k: np.zeros(s) for k, s in shapes.items()}, 0
    sizes = np.diff(bags.first)
    for epoch in range(epochs):
        order, rate = rng.permutation(len(y)), RATE * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            passages = tk.ragged(bags.first[some], sizes[some])
            part = bags.take(passages, np.concatenate([[0], np.cumsum(sizes[some])]))
            kept = rng.random(len(part.tokens)) >= DROPOUT
            upto = np.concatenate([[0], np.cumsum(kept)])[part.first_token]
            g = model.gradient(scaled[passages], part.tokens[kept], upto, part.first, y[some])
            step += 1
            for k in shapes:
                grad = g[k] + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    p["E"] = p["E"].astype(np.float32)
    return model


def _encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to (label, shape, tokens, sizes) as bytes, of at most TRAIN_PASSAGES passages of a text."""
    for batch in batches:
        for first, last, data, offsets in tk.slices(batch.column(1)):
            all_of = encode_passages(data, offsets)
            columns: list[list[bytes]] = [[], [], []]
            for a, b in zip(all_of.first[:-1], all_of.first[1:]):
                some = all_of.take(np.unique(np.linspace(a, b - 1, min(b - a, TRAIN_PASSAGES)).astype(np.int64)), np.zeros(1, np.int64))
                for column, x in zip(columns, (some.shape, some.tokens, np.diff(some.first_token).astype(np.int32))):
                    column.append(np.ascontiguousarray(x).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *(pa.array(c, pa.binary()) for c in columns)], names=["label", "shape", "tokens", "sizes"])


def _joined(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The items of a column of bytes one after the other, without a copy of their own, and how many each row has."""
    array = column.combine_chunks()
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(kind), np.diff(at) // np.dtype(kind).itemsize


def _bags(got: pa.Table) -> tuple[Passages, np.ndarray]:
    """The passages and labels of rows of _encode, in an order that the rows alone decide."""
    got = got.sort_by([(c, "ascending") for c in ("label", "shape", "tokens")])
    shape, tokens = _joined(got["shape"], np.float32)[0].reshape(-1, N_FEATURES), _joined(got["tokens"], np.int16)[0]
    sizes, n_passages = _joined(got["sizes"], np.int32)
    first = np.concatenate([[0], np.cumsum(n_passages)])
    return Passages(shape, tokens, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), first), got["label"].to_numpy().astype(float)


def fit(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int = TRAIN_ROWS) -> AttentionModel:
    """Learn from the labels (doc_id and a 0/1 column) where usable holds; about `rows` of them, chosen by a hash of doc_id.

    The driver gets at most TRAIN_PASSAGES encoded passages of each of these texts (350 bytes a passage), as Arrow, and gives
    the memory back. Labels that are null or of no document are left out; of a repeated doc_id one text and the greatest label count.
    """
    got = tk.small_batches(training_texts(docs, labels, label, usable, rows, 6)).mapInArrow(_encode, "label int, shape binary, tokens binary, sizes binary").toArrow()
    if not got.num_rows:
        return train(None, np.zeros(0))
    bags, y = _bags(got)
    del got
    model = train(bags, y)
    del bags
    tk.give_back()
    return model


FIELDS = "score double, predicted int"


def _scorer(model: AttentionModel):
    def make():
        def work(data: np.ndarray, offsets: np.ndarray) -> list:
            s = model.score(encode_passages(data, offsets))
            return [s, (s >= 0.5).astype(np.int32)]

        return work

    return make


def score(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """docs with score (double, 0 to 1, higher: better) and predicted (int, 1 if score >= 0.5).

    A null, empty or blank text is one passage of zeros without words and has a score as well. Whole texts count, of any
    length; all other columns stay, and score and predicted are replaced.
    """

    return tk.append_columns(docs, "text", FIELDS, _scorer(model))


def _remainder() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(3))


def op6_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score over all documents, learned from the labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", _remainder() != 1)
    return score(docs.select("doc_id", (_remainder() == 1).alias("held_out"), "text"), model).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the documents that the classifier accepts."""
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", _remainder() != 1)
    found = tk.small_batches(docs).withColumn("__quality", tk.kernel(FIELDS, _scorer(model), F.col("text")))
    return found.filter("__quality.predicted = 1").drop("__quality")
