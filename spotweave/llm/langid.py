"""Language identification by bit-sliced Bloom filters over letter n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .scratch import materialize, release

ORDERS = (3, 4)
BITS = 20
PROBES = 3
DOCS_A_LANGUAGE = 1500
#: An n-gram belongs to a language in which it has at least this share of its highest rate, and so many occurrences (or as
#: many as the language has distinct texts, if those are fewer).
MIN_SHARE = 0.3
MIN_COUNT = 3
#: The driver gets at most so many n-grams: of each language its most frequent ones, in equal parts.
MAX_GRAMS = 4_000_000
#: Languages in one word of a mask.
WORD = 64
UNKNOWN = "und"


def gram_hashes(data: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...] = ORDERS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the 64-bit hashes of the n-grams of all rows and the rows' offsets in them.

    Text is lower-cased letters; each run of anything else is one blank, and each row has a blank at either end. An
    n-gram has no blank inside.
    """
    points, at = tk.code_points(data, offsets)
    n_rows = len(at) - 1
    # A blank before each row, and one at the end of all: it ends each row as well.
    symbols = np.zeros(len(points) + n_rows + 1, np.uint32)
    symbols[np.arange(len(points)) + np.repeat(np.arange(1, n_rows + 1), np.diff(at))] = tk.Letters.get()[points]
    heads = at + np.arange(n_rows + 1)
    solid = symbols > 0
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    keep[heads] = True
    upto = np.concatenate([[0], np.cumsum(keep)])
    symbols, heads = symbols[keep].astype(np.uint64), upto[heads]
    blank = symbols == 0
    out = []
    for n in orders:
        size = max(0, len(symbols) - n + 1)
        h = np.full(size, n, np.uint64)
        good = np.ones(size, bool)
        for i in range(n):
            h = h * np.uint64(tk.BASE) + symbols[i : i + size]
            if 0 < i < n - 1:
                good &= ~blank[i : i + size]
        # A blank at the head of the next row stays the last of an n-gram; an n-gram of blanks alone has n of at most 2.
        count = np.concatenate([[0], np.cumsum(good)])
        out.append((tk.mix(h[good]), count[np.minimum(heads, size)]))
    return out


@dataclass
class LanguageFilters:
    """planes[w, p] has a bit for each of the w-th WORD languages whose Bloom filter has position p set; false_rate is of each language."""

    languages: list[str]
    planes: np.ndarray
    false_rate: np.ndarray

    def masks(self, hashes: np.ndarray) -> np.ndarray:
        """Per word and n-gram a bit for each language whose filter holds it, all languages of a word at once."""
        low = np.uint64((1 << BITS) - 1)
        out = self.planes[:, (hashes & low).astype(np.int64)]
        for i in range(1, PROBES):
            out &= self.planes[:, ((hashes >> np.uint64(BITS * i)) & low).astype(np.int64)]
        return out

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row and language the n-grams that its filter holds, corrected for false positives; per row the n-grams."""
        rows, width = len(offsets) - 1, len(self.languages)
        found, total = np.zeros((rows, width)), np.zeros(rows)
        for hashes, at in gram_hashes(data, offsets):
            total += np.diff(at)
            for w, masks in enumerate(self.masks(hashes)):
                here = min(WORD, width - w * WORD)
                if here <= 8:
                    pairs = tk.row_of(at) * (1 << here) + masks.astype(np.int64)
                    by_mask = np.bincount(pairs, minlength=rows << here).reshape(rows, 1 << here)
                    found[:, w * WORD : w * WORD + here] += by_mask @ ((np.arange(1 << here)[:, None] >> np.arange(here)) & 1)
                    continue
                one = masks.dtype.type(1)
                for j in range(here):
                    found[:, w * WORD + j] += tk.row_sums((masks >> masks.dtype.type(j)) & one, at)
        return np.maximum(0, (found - total[:, None] * self.false_rate) / (1 - self.false_rate)), total

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        hits, total = self.hits(data, offsets)
        if not self.languages:
            return [UNKNOWN] * len(total), np.zeros(len(total))
        best = hits.argmax(axis=1)
        score = np.clip(hits[np.arange(len(best)), best] / np.maximum(total, 1), 0, 1)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best, total)], score


def build(lang: np.ndarray, grams: np.ndarray, n: np.ndarray, languages: list[str], least: np.ndarray | None = None) -> LanguageFilters:
    """Filters from occurrences n of n-grams (hashes, as signed longs or not) in languages (by number); least has the occurrences needed if not MIN_COUNT."""
    width = len(languages)
    kind = np.uint8 if width <= 8 else np.uint64
    planes = np.zeros((max(1, -(-width // WORD)), 1 << BITS), kind)
    if len(lang):
        order = np.argsort(grams, kind="stable")
        lang, keys, n = lang[order], grams[order].astype(np.int64).view(np.uint64), n[order]
        rate = n / np.bincount(lang, n, minlength=width)[lang]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        highest = np.repeat(np.maximum.reduceat(rate, heads), np.diff(np.append(heads, len(keys))))
        member = (n >= (np.full(width, MIN_COUNT) if least is None else least)[lang]) & (rate >= MIN_SHARE * highest)
        lang, keys = lang[member], keys[member]
        for i in range(PROBES):
            place = ((keys >> np.uint64(BITS * i)) & np.uint64((1 << BITS) - 1)).astype(np.int64)
            np.bitwise_or.at(planes, (lang // WORD, place), np.left_shift(kind(1), (lang % WORD).astype(kind)))
    fill = np.array([((planes[j // WORD] >> kind(j % WORD)) & kind(1)).mean() for j in range(width)])
    return LanguageFilters(languages, planes, fill**PROBES)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, n-gram, occurrences), summed in a slice."""
    for batch in batches:
        code = batch.column(0).to_numpy()
        for first, last, data, offsets in tk.slices(batch.column(1)):
            for hashes, at in gram_hashes(data, offsets):
                own = code[first:last][tk.row_of(at)]
                for j in np.unique(own):
                    grams, n = np.unique(hashes[own == j], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), j, np.int32)), pa.array(grams.view(np.int64)), pa.array(n, pa.int64())], names=["id", "gram", "n"])


def _thresholds(grams: DataFrame, n_languages: int) -> list[tuple[int, int, int]]:
    """(id, last, share) for the MAX_GRAMS / n_languages most frequent n-grams of each language, by a histogram of n.

    All that occur more than `last` times are among them, and of those that occur so often a share in millionths, chosen by a hash.
    """
    most = max(1, MAX_GRAMS // n_languages)
    held: dict[int, int] = {}
    out: dict[int, tuple[int, int]] = {}
    for r in sorted(grams.groupBy("id", "n").count().collect(), key=lambda r: -r["n"]):
        before = held.get(r["id"], 0)
        if before < most:
            out[r["id"]] = (r["n"], min(1_000_000, 1_000_000 * (most - before) // r["count"]))
        held[r["id"]] = before + r["count"]
    return [(i, *v) for i, v in sorted(out.items())]


def fit(docs: DataFrame, train: Column, docs_a_language: int = DOCS_A_LANGUAGE) -> LanguageFilters:
    """Learn the filters from text and lang of the rows where train holds and neither is null.

    About docs_a_language distinct texts of each language are used, each once however many copies there are; of a language
    with fewer, all are. Of their n-grams the driver gets MAX_GRAMS at most. There may be any number of languages; a filter
    takes 2**BITS bits.
    """
    rows = docs.filter(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    hashed = rows.select("lang", F.xxhash64("text", F.lit(10)).alias("hash"))
    sizes = {r["lang"]: r["count"] for r in hashed.distinct().groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not sizes:
        return build(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), [])
    # A row for each language, as the model has.
    known = [(i, k, int(1_000_000 * min(1, docs_a_language / sizes[k])) + 1, min(MIN_COUNT, sizes[k])) for i, k in enumerate(languages)]
    known = docs.sparkSession.createDataFrame(known, "id int, lang string, share int, least int")
    chosen = rows.select("lang", "text").join(F.broadcast(known), "lang").filter(F.pmod(F.xxhash64("text", F.lit(10)), F.lit(1_000_000)) < F.col("share"))
    some = chosen.select("id", "text").distinct()
    counted = tk.small_batches(some).mapInArrow(_count, "id int, gram bigint, n bigint").groupBy("id", "gram").agg(F.sum("n").alias("n"))
    often = materialize(counted.join(F.broadcast(known.select("id", "least")), "id").filter("n >= least").drop("least"), "letter-grams")
    enough = _thresholds(often, len(languages))
    some = often.join(F.broadcast(docs.sparkSession.createDataFrame(enough, "id int, last bigint, share int")), "id")
    own = (F.col("n") > F.col("last")) | ((F.col("n") == F.col("last")) & (F.pmod(F.xxhash64("gram"), F.lit(1_000_000)) < F.col("share")))
    found = some.filter(own).select("id", "gram", "n").toArrow()
    release(often)
    least = np.array([min(MIN_COUNT, sizes[k]) for k in languages])
    model = build(found["id"].to_numpy().astype(np.int64), found["gram"].to_numpy(), found["n"].to_numpy(), languages, least)
    del found
    tk.give_back()
    return model


FIELDS = "lang_pred string, score double"


def _predictor(model: LanguageFilters):
    def make():
        def work(data: np.ndarray, offsets: np.ndarray) -> list:
            names, score = model.predict(data, offsets)
            return [pa.array(names, pa.string()), score]

        return work

    return make


def identify(docs: DataFrame, model: LanguageFilters) -> DataFrame:
    """docs with lang_pred (string) and score (double, the share of n-grams that the language's filter holds).

    A null, empty or letterless text gives und and 0; with no language learned all give und. Equal counts go to
    the first language by name. Whole texts count, of any length. Other columns stay; lang_pred and score are
    replaced.
    """

    return tk.append_columns(docs, "text", FIELDS, _predictor(model))


def _remainder(by: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(by))


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify over all documents, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = _remainder(5) == 0
    model = fit(docs, ~held_out)
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


MIN_SCORE = 0.3


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: documents in a learned language. Gone are und and texts of which few n-grams belong to any language."""
    model = fit(docs, _remainder(5) != 0)
    found = tk.small_batches(docs).withColumn("__language", tk.kernel(FIELDS, _predictor(model), F.col("text")))
    return found.filter((F.col("__language.lang_pred") != UNKNOWN) & (F.col("__language.score") >= MIN_SCORE)).drop("__language")
