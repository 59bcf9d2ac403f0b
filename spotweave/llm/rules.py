"""Quality rules: counts of a text, and perplexity bands of each language under a modified Kneser-Ney model."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textkernel as tk
from .scratch import materialize, release

ORDER = 5
#: A symbol is a code point: 0 stands before a text, a run of white space is one space, the character U+0000 is NUL.
SYMBOL_BITS = 21
SYMBOL = (1 << SYMBOL_BITS) - 1
NUL = 0x110000
N_SYMBOLS = NUL + 1
#: n-grams of the model that a task holds at once (12 bytes each, 96 MB); a larger model is scored range by range.
SHARD_ROWS = 8_000_000
#: A text is kept from so many robust deviations below to so many above its language's median log perplexity, at least
#: MIN_SPREAD wide each. Chosen on labelled rows; see README.
BAND_LOW, BAND_HIGH = 3.5, 3.0
MIN_SPREAD = 0.01
#: The perplexity of short texts varies more: deviations grow by the root of 1 + SHORT_WORDS / words.
SHORT_WORDS = 100
BASE_FIELDS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

_SIGN = np.zeros(256, bool)
_SIGN[list(b"#*$%&|<>")] = True


def _repeat_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Per row the words in a 3-word window that the same text holds twice or more, of the words' starts and ends and the rows' first words."""
    hashes = tk.span_hash(data, starts, ends)
    row = tk.row_of(firsts)
    covered = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        head = np.flatnonzero(row[2:] == row[:-2])
        window = hashes[head] * np.uint64(3) + tk.mix(hashes[head + 1]) * np.uint64(5) + tk.mix(hashes[head + 2] + np.uint64(7)) * np.uint64(9)
        keys = tk.mix(window ^ tk.mix(row[head].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(keys)
        equal = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(head), bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        for i in range(3):
            covered[head[twice] + i] = True
    return tk.row_sums(covered, firsts)


def failing(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which rows are base_failed, without the counts that do not tell."""
    starts, ends, firsts = tk.words(data, offsets)
    return base_failed(np.diff(firsts), _repeat_words(data, starts, ends, firsts))


def base_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Per row the columns of BASE_FIELDS."""
    starts, ends, firsts = tk.words(data, offsets)
    n_words = np.diff(firsts)
    if not len(starts):
        return [n_words.astype(np.int64)] + [np.zeros(len(n_words), np.int64) for _ in range(4)]
    solid = ~tk.IS_SPACE[data]
    chars = tk.row_sums(solid & ((data & 0xC0) != 0x80), offsets)
    symbols = tk.row_sums(_SIGN[data], offsets)
    # Lines: from a row's start, or after a line feed, to the next line feed or the row's end.
    feeds = np.flatnonzero(data == 0x0A)
    line_row = np.concatenate([np.arange(len(n_words)), np.searchsorted(offsets, feeds, side="right") - 1])
    begin = np.concatenate([offsets[:-1], feeds + 1])
    order = np.lexsort((begin, line_row))
    line_row, begin = line_row[order], begin[order]
    last = np.append(line_row[1:] != line_row[:-1], True)
    stop = np.where(last, offsets[line_row + 1], np.append(begin[1:], 0) - 1)
    worded = np.searchsorted(starts, begin) < np.searchsorted(starts, stop)
    line_row, line_hash = line_row[worded], tk.span_hash(data, begin[worded], stop[worded])
    again = tk.repeats(tk.mix(line_hash ^ tk.mix(line_row.astype(np.uint64) + np.uint64(1))))
    dup_lines = np.bincount(line_row[again], minlength=len(n_words))
    return [n_words, chars, symbols, dup_lines, _repeat_words(data, starts, ends, firsts)]


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of the slice and the rows' offsets in them."""
    points, at = tk.code_points(data, offsets)
    out = points.astype(np.int64)
    blank = (out == 0x20) | ((out >= 0x09) & (out <= 0x0D))
    out[blank] = 0x20
    out[out == 0] = NUL
    keep = np.ones(len(out), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[at[:-1][np.diff(at) > 0]] = True
    upto = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], upto[at]


def language_code(langs: pa.Array) -> np.ndarray:
    """Of each language a number below 2**21, by its name alone; null is a language of its own."""
    names = langs.cast(pa.string()).dictionary_encode()
    codes = np.array([zlib.crc32(f"language {x.as_py()}".encode()) & SYMBOL for x in names.dictionary] or [0], np.int64)
    return np.where(langs.is_valid().to_numpy(zero_copy_only=False), codes[names.indices.fill_null(0).to_numpy()], SYMBOL)


def _numbered(codes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes (numbers below 2**bits) in order, and which of them each one is."""
    width = len(codes).bit_length()
    if bits + width > 63:
        return np.unique(codes, return_inverse=True)
    # Code and place in one number: sorting numbers takes a fraction of the time of sorting places by them.
    both = np.sort((codes << width) | np.arange(len(codes)))
    order, ordered = both & ((1 << width) - 1), both >> width
    new = np.ones(len(codes), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    which = np.empty(len(codes), np.int64)
    which[order] = np.cumsum(new) - 1
    return ordered[new], which


def distinct_grams(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, which, at): the distinct n-grams of a slice, which of them ends at each symbol, and the rows' offsets in that.

    high holds language and two symbols, low three, 21 bits each: exact code points of any alphabet.
    """
    found, at = symbols(data, offsets)
    # The slice's own symbols and languages are numbered, so that an n-gram of them is one number.
    there = np.zeros(N_SYMBOLS, bool)
    there[found] = True
    there[0] = True
    alphabet = np.flatnonzero(there)
    number = np.empty(N_SYMBOLS, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    names, language = np.unique(langs, return_inverse=True)
    bits = max(1, int(len(alphabet) - 1).bit_length())
    all_bits = ORDER * bits + max(1, int(len(names)).bit_length())
    if all_bits > 63:  # thousands of different characters in half a megabyte
        place = np.arange(len(found)) - np.repeat(at[:-1], np.diff(at))
        columns = [np.repeat(langs, np.diff(at))] + [np.where(place >= back, np.roll(found, back), 0) for back in range(ORDER - 1, -1, -1)]
        rows, which = np.unique(np.stack(columns, axis=1), axis=0, return_inverse=True)
        parts = rows.T
        which = which.ravel()
    else:
        small = number[found]
        codes = small.copy()
        for back in range(1, ORDER):
            codes[back:] |= small[:-back] << (bits * back)
        # A row's first symbols have 0 before them, not the end of the row before.
        few = np.minimum(np.diff(at), ORDER - 1)
        early = tk.ragged(at[:-1], few)
        codes[early] &= (1 << (bits * (early - np.repeat(at[:-1], few) + 1))) - 1
        codes |= np.repeat(language << (ORDER * bits), np.diff(at))
        codes, which = _numbered(codes, all_bits)
        low = (1 << bits) - 1
        parts = [names[codes >> (ORDER * bits)]] + [alphabet[(codes >> (bits * back)) & low] for back in range(ORDER - 1, -1, -1)]
    high = (parts[0] << (2 * SYMBOL_BITS)) | (parts[1] << SYMBOL_BITS) | parts[2]
    return high, (parts[3] << (2 * SYMBOL_BITS)) | (parts[4] << SYMBOL_BITS) | parts[5], which, at


def gram_hash(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return tk.mix(high.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + tk.mix(low.astype(np.uint64)))


def base_failed(n_words, n_repeat_words):
    """Of columns or arrays: whether texts with these counts fail."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def count_grams(rows: DataFrame, sound_only: bool = False) -> DataFrame:
    """(high, low, n) of all texts of rows (lang, text), counted in tasks and summed by Spark; see distinct_grams.

    With sound_only, n-grams of texts that are base_failed are there but count nothing.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64) for _ in range(3)]
        waiting: list[list[np.ndarray]] = []
        size = 0

        def merge() -> None:
            nonlocal held, waiting, size
            high, low, n = (np.concatenate(c) for c in zip(held, *waiting))
            order = np.lexsort((low, high))
            high, low, n = high[order], low[order], n[order]
            new = np.ones(len(high), bool)
            new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
            heads = np.flatnonzero(new)
            held = [high[heads], low[heads], np.add.reduceat(n, heads) if len(heads) else n]
            waiting, size = [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["high", "low", "n"])

        for batch in batches:
            langs = language_code(batch.column(0))
            for first, last, data, offsets in tk.slices(batch.column(1)):
                high, low, which, at = distinct_grams(data, offsets, langs[first:last])
                if sound_only:
                    which = which[~np.repeat(failing(data, offsets), np.diff(at))]
                waiting.append([high, low, np.bincount(which, minlength=len(high)).astype(np.int64)])
                size += len(high)
                if size > 1_000_000:
                    merge()
                    if len(held[0]) > 2_000_000:
                        yield out()
                        held = [c[:0] for c in held]
        merge()
        if len(held[0]):
            yield out()

    parts = tk.small_batches(rows.select("lang", "text")).mapInArrow(count, "high bigint, low bigint, n bigint")
    return parts.groupBy("high", "low").agg(F.sum("n").alias("n"))


#: Of each order the word that holds the first symbol, and where.
_FIRST = {5: ("high", 1), 4: ("high", 0), 3: ("low", 2), 2: ("low", 1)}


def _suffix(order: int) -> list[Column]:
    """high and low without the first symbol."""
    word, place = _FIRST[order]
    clear = F.lit(~(SYMBOL << (place * SYMBOL_BITS)))
    return [F.col(c).bitwiseAND(clear).alias(c) if c == word else F.col(c) for c in ("high", "low")]


def _discounts(level: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3): modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from how many n-grams have counts 1 to 4."""
    lang = F.shiftright("high", 2 * SYMBOL_BITS).alias("lang")
    tallies = level.groupBy(lang).agg(*(F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)))
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.0)

    def one(i: int) -> Column:
        raw = F.when(F.col(f"n{i}") > 0, i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(i / 2)
        return F.least(F.greatest(raw, F.lit(0.05)), F.lit(i - 0.05)).alias(f"d{i}")

    return tallies.select("lang", one(1), one(2), one(3))


def kneser_ney(grams: DataFrame) -> DataFrame:
    """(high, low, logp) for each counted n-gram: the natural logarithm of its interpolated modified Kneser-Ney probability.

    n-grams of the highest order seen once carry no mass of their own (the usual cut-off), so a text does not
    vouch for itself; what they had goes to the lower order. Lower orders count distinct left neighbours. All
    is joins and windows by context, of at most as many rows as the language has characters.
    """
    levels = {ORDER: grams}
    for order in range(ORDER, 1, -1):
        kept = F.col("n") >= (2 if order == ORDER else 1)
        # Neighbours before the text: a text's first n-grams count as they are.
        levels[order - 1] = levels[order].select(*_suffix(order), kept.cast("long").alias("n")).groupBy("high", "low").agg(F.sum("n").alias("n"))
    below: DataFrame | None = None
    for order in range(1, ORDER + 1):
        level = levels[order]
        # At most 2**21 languages of 40 bytes; in practice some hundred.
        level = level.join(F.broadcast(_discounts(level)), F.shiftright("high", 2 * SYMBOL_BITS) == F.col("lang"))
        n = F.col("n")
        one = F.lit(1.0) if order == ORDER else F.col("d1")
        cut = F.when(n == 0, 0.0).when(n == 1, one).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        level = level.select("high", "low", "n", cut.alias("__cut"), F.shiftright("low", SYMBOL_BITS).alias("__context"))
        by = Window.partitionBy("high", "__context")
        level = level.withColumn("__total", F.sum("n").over(by)).withColumn("__free", F.sum("__cut").over(by))
        own = F.when(F.col("__total") > 0, (n - F.col("__cut")) / F.col("__total")).otherwise(0.0)
        share = F.when(F.col("__total") > 0, F.col("__free") / F.col("__total")).otherwise(1.0)
        if below is None:
            below = level.select("high", "low", (own + share / N_SYMBOLS).alias("p"))
        else:
            lower = below.select(F.col("high").alias("__high"), F.col("low").alias("__low"), F.col("p").alias("__lower"))
            high, low = _suffix(order)
            level = level.select("high", "low", own.alias("__own"), share.alias("__share"), high.alias("__high"), low.alias("__low"))
            below = level.join(lower, ["__high", "__low"]).select("high", "low", (F.col("__own") + F.col("__share") * F.col("__lower")).alias("p"))
    return below.select("high", "low", F.log("p").cast("float").alias("logp"))


def _look_up(grams: np.ndarray, hashes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Of each gram the value of its hash, 0 where the sorted hashes don't have it; asked for in order, so that the search stays in the processor's cache."""
    out = np.zeros(len(grams), np.float32)
    if len(hashes):
        order = np.argsort(grams)
        asked = grams[order]
        place = np.minimum(np.searchsorted(hashes, asked), len(hashes) - 1)
        out[order] = np.where(hashes[place] == asked, values[place], np.float32(0))
    return out


def _summer(shared: Broadcast, with_counts: bool):
    """make() for append_columns: [the counts,] the sum of logs over a text's n-grams that are among the sorted hashes, and its symbols."""

    def make():
        hashes, values = shared.value

        def work(data: np.ndarray, offsets: np.ndarray, langs: pa.Array) -> list:
            high, low, which, at = distinct_grams(data, offsets, language_code(langs))
            grams = gram_hash(high, low)
            found = _look_up(grams, hashes, values)
            sums = [tk.row_sums(found.astype(np.float64)[which], at), np.diff(at)]
            return (base_counts(data, offsets) if with_counts else []) + sums

        return work

    return make


def _range(model: DataFrame, i: int, n: int) -> Broadcast:
    """Part i of n of the model as sorted hashes and logs on all executors; a hash deals the n-grams evenly."""
    table = model.filter(F.pmod(F.xxhash64("high", "low"), F.lit(n)) == i).toArrow()
    hashes, logs = gram_hash(table["high"].to_numpy(), table["low"].to_numpy()), table["logp"].to_numpy()
    order = np.argsort(hashes)
    return model.sparkSession.sparkContext.broadcast((hashes[order], logs[order]))


SUMS = "__total double, __chars bigint"


def measure(docs: DataFrame, shard_rows: int = SHARD_ROWS, sound_only: bool = False) -> DataFrame:
    """docs (lang, text, ...) without text, with the columns of BASE_FIELDS and log_ppl.

    log_ppl is the mean of -log p over the characters, under the model of the text's language, counted over all of
    docs, or with sound_only over those that are not base_failed; null for a text without characters. A null lang is a
    language of its own. The model goes to the executors as sorted arrays of at most about shard_rows n-grams. A larger one
    goes range by range: each is sent, all texts are summed over it, the sums are written and the range is dropped before
    the next, so driver and executors never hold more than one.
    """
    taken = [f.split()[0] for f in BASE_FIELDS.split(", ")] + ["log_ppl"]
    docs = docs.drop(*taken)
    others = [c for c in docs.columns if c != "text"]
    grams = materialize(count_grams(docs, sound_only), "grams")
    model = materialize(kneser_ney(grams), "model")
    release(grams)
    n_ranges = max(1, -(-model.count() // shard_rows))
    rows = docs.select(F.struct(*others).alias("__row"), F.col("lang").alias("__lang"), "text")
    if n_ranges == 1:
        out = tk.append_columns(rows, "text", f"{BASE_FIELDS}, {SUMS}", _summer(_range(model, 0, 1), True), "__lang").drop("text")
    else:
        rows = materialize(rows.withColumn("__row_id", F.monotonically_increasing_id()), "texts")
        out = tk.append_columns(rows, "text", BASE_FIELDS, lambda: base_counts).drop("text", "__lang")
        sums: DataFrame | None = None
        for i in range(n_ranges):
            part = _range(model, i, n_ranges)
            found = tk.append_columns(rows.select("__row_id", "__lang", "text"), "text", SUMS, _summer(part, False), "__lang")
            found = materialize(found.drop("text", "__lang"), "sums")
            part.destroy()
            sums = found if sums is None else sums.unionByName(found)
        sums = sums.groupBy("__row_id").agg(F.sum("__total").alias("__total"), F.max("__chars").alias("__chars"))
        out = out.join(sums, "__row_id")
    log_ppl = F.when(F.col("__chars") > 0, -F.col("__total") / F.col("__chars"))
    return out.select(*(F.col(f"__row.{c}").alias(c) for c in others), *taken[:-1], log_ppl.alias("log_ppl"))


def judge(docs: DataFrame, low: float = BAND_LOW, high: float = BAND_HIGH) -> DataFrame:
    """docs (lang, text, ...) without text, with the columns of BASE_FIELDS, base_failed, log_ppl, band_low, band_high and kept.

    Words are runs of other bytes than space, tab to carriage return; see base_counts. base_failed: under 50
    words, or over half of the words in 3-word windows that come again. kept: not base_failed, and the text's log
    perplexity lies in its language's band, from low robust deviations below the median to high above it, both of all
    texts of that language that are not base_failed, and wider for shorter texts; of these alone the model is counted. Null
    or empty texts fail; equal rows have equal results; a language with one text keeps it. Other columns stay; the new ones
    replace columns of the same names.
    """
    docs = docs.drop("base_failed", "band_low", "band_high", "kept")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    measured = materialize(measure(docs, sound_only=True).withColumn("base_failed", failed), "measured")
    wider = F.sqrt(1 + SHORT_WORDS / F.greatest("n_words", F.lit(1)))
    # The model's number of a language (language_code), so there are at most 2**21 rows of bands.
    code = F.crc32(F.concat(F.lit("language "), F.col("lang").cast("string")).cast("binary")).bitwiseAND(F.lit(SYMBOL))
    lang = F.coalesce(code, F.lit(SYMBOL)).alias("__lang")
    sound = measured.filter(~F.col("base_failed")).select(lang, "log_ppl", wider.alias("__wider"))
    middle = sound.groupBy("__lang").agg(F.percentile_approx("log_ppl", 0.5, 10_000).alias("__mid"))
    off = F.percentile_approx(F.abs(F.col("log_ppl") - F.col("__mid")) / F.col("__wider"), 0.5, 10_000)
    spread = sound.join(F.broadcast(middle), "__lang").groupBy("__lang", "__mid").agg(off.alias("__off"))
    bands = spread.select("__lang", "__mid", F.greatest(1.4826 * F.col("__off"), F.lit(MIN_SPREAD)).alias("__width"))
    out = measured.select("*", lang).join(F.broadcast(bands), "__lang", "left").withColumn("__width", F.col("__width") * wider)
    out = out.withColumns({"band_low": F.col("__mid") - F.lit(low) * F.col("__width"), "band_high": F.col("__mid") + F.lit(high) * F.col("__width")})
    inside = F.coalesce(F.col("log_ppl").between(F.col("band_low"), F.col("band_high")), F.lit(False))
    return out.drop("__lang", "__mid", "__width").withColumn("kept", ~F.col("base_failed") & inside)


def op7_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs.select("doc_id", "lang", "text"))
