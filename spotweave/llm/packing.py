"""Packing of token sequences: best-two-fit over the histogram of lengths."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .chunkcache import ChunkCache
from .ranks import gapless_rank
from .scratch import materialize

CAPACITY = 2048
END_ID = 0
TOKENIZER = "byte_bpe_50k.json"
#: Two noncharacters, put between chunks.
BETWEEN = "\uFDD0\uFDD1"
BETWEEN_BYTES = BETWEEN.encode()
#: The split pattern of byte-level BPE with 50,257 ids, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass
class BpeFile:
    """What a byte-level BPE file of the tokenizers library holds: ids of byte strings, and of special tokens."""

    ranks: dict[bytes, int]
    special: dict[str, int]


def load(path: str) -> BpeFile:
    """Read on the driver; tasks get what it holds."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    visible = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in visible}
    byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return BpeFile({bytes(byte_of[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}, special)


class ByteBpe(ChunkCache):
    """Ids of a byte-level BPE file of the tokenizers library, each distinct chunk of text encoded once.

    Chunks are cut where the file's split pattern cuts in any context: before a single space, and before and
    after a single line feed, that stand between other bytes than white space. A chunk's ids come from tiktoken
    over the file's own vocabulary, with the file's special tokens; they equal the library's.
    """

    def __init__(self, file: BpeFile) -> None:
        import tiktoken

        self.special = file.special
        self.between = max(max(file.ranks.values()), *file.special.values(), 0) + 1
        self.codec = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=file.ranks, special_tokens=file.special | {BETWEEN: self.between})
        super().__init__()

    def encode_chunks(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if any(BETWEEN_BYTES in t for t in texts):
            parts = [self.codec.encode_to_numpy(t.decode("utf-8", "replace"), allowed_special=set(self.special), disallowed_special=()) for t in texts]
            return np.concatenate(parts), np.array([len(p) for p in parts])
        # One call for all, with a special id of our own between them.
        got = self.codec.encode_to_numpy(BETWEEN_BYTES.join(texts).decode("utf-8", "replace"), allowed_special="all")
        stops = np.flatnonzero(got == self.between)
        return np.delete(got, stops), np.diff(np.concatenate([[-1], stops, [len(got)]])) - 1

    def chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        space = tk.IS_SPACE[data]
        space |= (data >= 0x1C) & (data <= 0x1F)
        at = np.flatnonzero((data == 0x20) | (data == 0x0A))
        at = at[(at > 0) & (at < n - 1)]
        # White space beyond ASCII starts with these bytes; a cut beside their blocks is left out.
        wide = np.zeros(256, bool)
        wide[[0xC2, 0xE1, 0xE2, 0xE3]] = True
        good = ~space[at - 1] & ~space[at + 1] & ~wide[data[at + 1]]
        good &= ~wide[data[np.maximum(at - 2, 0)]] & ~wide[data[np.maximum(at - 3, 0)]]
        at = at[good]
        cut = np.zeros(n, bool)
        cut[at] = True
        cut[at[data[at] == 0x0A] + 1] = True
        # A cut needs both neighbours in its own row.
        edge = offsets[(offsets > 0) & (offsets < n)]
        cut[edge] = False
        cut[edge - 1] = False
        single = edge[data[edge] == 0x0A] + 1
        cut[single[(single < n)]] = False
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut)
        return starts, np.searchsorted(starts, offsets)


def _piece_schema(with_ids: bool) -> str:
    return "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids


def _cutter(file: BpeFile, capacity: int, with_ids: bool):
    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ByteBpe(file)
        for batch in batches:
            for first, last, data, offsets in tk.slices(batch.column(1)):
                ids, at = codec.encode(data, offsets)
                # Each row's ids and then END_ID.
                lengths = np.diff(at) + 1
                starts = np.concatenate([[0], np.cumsum(lengths)])
                full = np.full(starts[-1], END_ID, np.uint32)
                full[np.arange(len(ids)) + tk.row_of(at)] = ids
                n_pieces = -(-lengths // capacity)
                row = np.repeat(np.arange(last - first), n_pieces)
                piece = tk.ragged(np.zeros(len(n_pieces), np.int64), n_pieces)
                head = lengths - (n_pieces - 1) * capacity
                begin = np.where(piece > 0, head[row] + (piece - 1) * capacity, 0)
                size = np.where(piece > 0, capacity, head[row])
                low = starts[row] + begin
                view = memoryview(full.astype("<u4").view(np.uint8))
                crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(low.tolist(), (low + size).tolist())]
                columns = [batch.column(0).slice(first, last - first).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(begin, pa.int64()), pa.array(size, pa.int64()), pa.array(crcs, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:  # pieces of a row follow each other, so that the pieces' ids are all ids in order
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(low, starts[-1]), pa.int32()), pa.array(full.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return cut


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    """Bins as (how many, lengths in one of them), for so many items of each length.

    A bin takes the longest item that fits, again and again; then its shortest item gives way to the two left
    items that together fill the larger gap best, if they fill it better. Bins with equal contents are made at
    once, for as long as the single steps would repeat, so the work depends on the lengths, not on the items.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    out: list[tuple[int, list[int]]] = []
    lengths = [int(x) for x in np.flatnonzero(left)]
    while lengths:
        used: Counter[int] = Counter()
        gap, at = capacity, len(lengths) - 1
        while gap and at >= 0:
            at = min(at, bisect_right(lengths, gap) - 1)
            if at < 0:
                break
            n = min(gap // lengths[at], int(left[lengths[at]]))
            used[lengths[at]] += n
            gap -= n * lengths[at]
            at -= 1
        need = Counter(used)
        if gap:
            least = min(used)
            room = gap + least
            free = left[: room + 1].copy()
            for length, n in used.items():
                if length <= room:
                    free[length] -= n
            have = np.flatnonzero(free > 0)
            if len(have):
                latest = np.zeros(room + 1, np.int64)
                latest[have] = have
                np.maximum.accumulate(latest, out=latest)
                # The second is at most the first; an item alone can't be both.
                limit = np.minimum(room - have, have - (free[have] < 2))
                second = np.where(limit > 0, latest[np.maximum(limit, 0)], 0)
                total = np.where(second > 0, have + second, 0)
                best = int(len(total) - 1 - np.argmax(total[::-1]))
                if total[best] > least:
                    used[least] -= 1
                    for length in (int(have[best]), int(second[best])):
                        used[length] += 1
                        need[length] += 1
        items = {length: n for length, n in used.items() if n}
        times = 1 + min((int(left[length]) - need[length]) // n for length, n in items.items())
        for length, n in items.items():
            left[length] -= times * n
            if not left[length]:
                lengths.remove(length)
        out.append((times, [x for length in sorted(items, reverse=True) for x in [length] * items[length]]))
    return out


def plan_table(spark: SparkSession, bins: list[tuple[int, list[int]]]) -> tuple[DataFrame, int]:
    """Where the items of each length go, by rank, and the number of bins.

    Item number r of its length, first <= r < beyond: bin first_bin + (r - first) div each, place
    offset + ((r - first) mod each) * length. Its rows depend on the lengths there are, not on the items.
    """
    rows, done, n = [], Counter(), 0
    for times, items in bins:
        offset = 0
        for length, each in Counter(items).items():
            rows.append({"l": length, "f": done[length], "b": done[length] + times * each, "e": each, "n": n, "o": offset})
            done[length] += times * each
            offset += each * length
        n += times
    schema = "array<struct<l: bigint, f: bigint, b: bigint, e: bigint, n: bigint, o: bigint>>"
    table = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), schema)).alias("r"))
    names = {"l": "length", "f": "__from", "b": "__beyond", "e": "__each", "n": "__bin", "o": "__offset"}
    return table.select(*(F.col(f"r.{k}").alias(v) for k, v in names.items())), n


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pack docs (doc_id, text) into sequences of at most capacity tokens.

    A document is its ids and then id 0; a null or empty text is id 0 alone. Only documents beyond capacity are
    cut: a shorter first piece, if any, then pieces of capacity tokens, each a sequence of its own. Returns per
    piece doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with with_ids the piece's ids.
    Null, equal or repeated doc_ids are all kept, row by row; other columns of docs are left out; an empty table
    gives an empty result. The driver sees the histogram of lengths (capacity rows at most) and sends back a
    plan whose size depends on capacity alone; pieces find their place by rank inside their length.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = tk.small_batches(narrow).mapInArrow(_cutter(load(tokenizer_path), capacity, with_ids), _piece_schema(with_ids))
    pieces = materialize(pieces.withColumn("__rid", F.monotonically_increasing_id()), "pieces")
    own = F.col("length") == capacity
    counts = {r["length"]: r["count"] for r in pieces.filter(~own).groupBy("length").count().collect()}
    table, _ = plan_table(spark, best_two_fit(counts, capacity))
    ranked = gapless_rank(pieces.filter(~own), "length", "__rid", max(counts.values(), default=0), "__rank", 7)
    at = F.col("__rank") - F.col("__from")
    placed = (
        ranked.join(F.broadcast(table), "length")
        .filter((F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__beyond")))
        .withColumn("sequence_id", F.col("__bin") + F.expr("(__rank - __from) div __each"))
        .withColumn("offset", F.col("__offset") + F.pmod(at, F.col("__each")) * F.col("length"))
    )
    # Full pieces: below zero, by row number.
    alone = pieces.filter(own).withColumn("sequence_id", -1 - F.col("__rid")).withColumn("offset", F.lit(0).cast("long"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "sequence_id", "offset"]
    return placed.select(columns).unionByName(alone.select(columns))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves (sequence_id, ids) of pack(..., with_ids=True); at most capacity ids in each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack over all documents."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_file(TOKENIZER))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: the pieces of all documents that are left, each with its sequence."""
    return pack(docs, tokenizer_file(TOKENIZER))
