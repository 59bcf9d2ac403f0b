"""SentencePiece encoding and decoding: a Viterbi lattice in numpy, for words of equal length together."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkernel as tk
from .chunkcache import ChunkCache
from .families import list_column

TOKENIZER = "piece_bpe_32k.model"
SLICE_BYTES = 1 << 20
#: Kinds of pieces and of models in the file, fixed values.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
BLANK = "▁"
NONE, RAW, START = -1, -2, -3
FAR = np.int64(1) << 60
PAIR_SLOTS = 1 << 21
#: The first bits of a key that say whether some piece may have it.
FIRST_BITS = 20
UNKNOWN_PENALTY = 10.0


def _message(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """The fields (number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        head = varint()
        if head & 7 == 0:
            yield head >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(head & 7)
        if size is None:
            size = varint()
        yield head >> 3, data[at : at + size]
        at += size


class Pieces:
    """What a model file says: pieces, scores, kinds, and for BPE how each piece is made; plain arrays, small enough to ship with tasks."""

    def __init__(self, data: bytes, kind: int | None = None) -> None:
        self.text: list[str] = []
        self.score: list[float] = []
        self.kinds: list[int] = []
        trainer: dict = {}
        normalizer: dict = {}
        for number, value in _message(data):
            if number == 1:
                piece = dict(_message(value))
                self.text.append(piece[1].decode("utf-8"))
                self.score.append(struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_message(value))
            elif number == 3:
                normalizer = dict(_message(value))
        self.kind = kind or trainer.get(3, UNIGRAM)
        if normalizer.get(2) or normalizer.get(4, 1) or self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models that leave text and spaces as they are")
        if USER_DEFINED in self.kinds:
            raise ValueError("models with user-defined symbols are not read")
        self.dummy = bool(normalizer.get(3, 1))
        self.byte_id = {int(t[1:-1], 16): i for i, (t, k) in enumerate(zip(self.text, self.kinds)) if k == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        own = [i for i, k in enumerate(self.kinds) if k == NORMAL]
        self.id_of = {self.text[i]: i for i in own}
        self.longest = max((len(self.text[i]) for i in own), default=1)
        if self.kind == BPE:
            self._derive()
        used = [i for i in own if self.kind == UNIGRAM or i in self.reachable]
        points = [np.frombuffer(self.text[i].encode("utf-32-le"), np.uint32) for i in used]
        keys = np.array([self._key(p) for p in points], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(used, np.int64)[order]
        assert len(np.unique(keys)) == len(keys)
        self.has_feed = any("\n" in self.text[i] for i in own)

    @staticmethod
    def _key(points: np.ndarray) -> np.uint64:
        h = 0
        for p in points.tolist():
            h = (h * tk.BASE + p + 1) & 0xFFFFFFFFFFFFFFFF
        return tk.mix(np.array([h], np.uint64))[0]

    def _merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merge the best pair, the leftmost of equals, until none is a piece; the parts, and the last pair."""
        parts, last = list(text), None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.id_of.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.score[piece] > best):
                    best, at = self.score[piece], i
            if at < 0:
                break
            last = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, last

    def _derive(self) -> None:
        """Each piece's last merge and the order of merges (1, 2 ...; 0 for single characters)."""
        n = len(self.text)
        order = {s: r for r, s in enumerate(sorted({self.score[i] for t, i in self.id_of.items() if len(t) > 1}, reverse=True), 1)}
        self.order = np.zeros(n, np.int64)
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.reachable: set[int] = set()
        for text, i in self.id_of.items():
            if len(text) == 1:
                self.reachable.add(i)
                continue
            if not text.strip(BLANK):
                continue  # runs of blanks are cut by rule
            parts, last = self._merge(text)
            if len(parts) == 1:
                self.reachable.add(i)
                self.order[i] = order[self.score[i]]
                self.left[i], self.right[i] = self.id_of[last[0]], self.id_of[last[1]]
        self.runs = sorted((len(t) for t in self.id_of if not t.strip(BLANK)), reverse=True)
        pairs = {}
        for text, i in self.id_of.items():
            if i in self.reachable:
                for cut in range(1, len(text)):
                    a, b = self.id_of.get(text[:cut]), self.id_of.get(text[cut:])
                    if a is not None and b is not None:
                        pairs[a * n + b] = self.order[i]
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_order = np.array([pairs[k] for k in sorted(pairs)], np.int64)

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging first + second leaves these two pieces.

        The merges are undone from the last one, on whichever side it was: before each, the pieces that met at the
        border must not have had a merge of their own that came earlier (on the left, as early).
        """
        n = len(self.text)
        out = np.ones(len(first), bool)
        at = np.arange(len(first))
        a, b, limit = first.copy(), second.copy(), np.full(len(first), FAR)
        while len(at):
            key = a * n + b
            place = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            bad = (self.pair_keys[place] == key) & (self.pair_order[place] < limit)
            out[at[bad]] = False
            left = self.order[a] > self.order[b]
            more = ~bad & (np.maximum(self.order[a], self.order[b]) > 0)
            limit = np.where(left, self.order[a], self.order[b] + 1)[more]
            at, left, a, b = at[more], left[more], a[more], b[more]
            a, b = np.where(left, self.right[a], a), np.where(left, b, self.left[b])
        return out


class SentencePiece(ChunkCache):
    """Ids as the library gives them, for unigram models by the scores and for BPE models by the merges.

    Both are paths through one lattice: a unigram path has the greatest sum of scores; a BPE path is the one path on
    which all neighbours are compatible (see Pieces.compatible), its score 0 and that of all others minus infinity.
    """

    def __init__(self, pieces: Pieces) -> None:
        super().__init__()
        self.p = pieces
        self.seen = np.full(PAIR_SLOTS, -1, np.int64)
        self.verdict = np.zeros(PAIR_SLOTS, bool)
        self.cut = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")
        self.scores = np.array(pieces.score)
        self.lowest = min((s for s, k in zip(pieces.score, pieces.kinds) if k == NORMAL), default=0.0) - UNKNOWN_PENALTY
        self.maybe = np.zeros(1 << FIRST_BITS, bool)
        self.maybe[pieces.keys >> np.uint64(64 - FIRST_BITS)] = True

    def chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        blank = data == 0x20
        cut = np.zeros(n, bool)
        cut[1:] = blank[1:] & ~blank[:-1]
        if not self.p.has_feed:
            feed = data == 0x0A
            cut |= feed
            cut[1:] |= feed[:-1]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut)
        return starts, np.searchsorted(starts, offsets)

    def encode_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As encode, with the blank that the model puts before a text."""
        if self.p.dummy:
            sizes = np.diff(offsets)
            new = np.concatenate([[0], np.cumsum(sizes + (sizes > 0))])
            wide = np.full(new[-1], 0x20, np.uint8)
            row = np.repeat(np.arange(len(sizes)), sizes)
            wide[np.arange(len(data)) + new[row] + 1 - offsets[row]] = data
            data, offsets = wide, new
        return self.encode(data, offsets)

    def encode_chunks(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        plain = [t.decode("utf-8", "replace").replace(" ", BLANK) for t in texts]
        parts: list[str] = []
        count = np.ones(len(plain), np.int64)
        for i, s in enumerate(plain):
            if s.find(BLANK, 1) < 0:
                parts.append(s)
            else:
                some = self.cut.findall(s)
                count[i] = len(some)
                parts.extend(some)
        by_length: dict[int, list[int]] = {}
        extra: dict[int, int] = {}
        for i, s in enumerate(parts):
            if s.startswith(BLANK * 2) and self.p.kind == BPE:
                word = s.lstrip(BLANK)
                extra[i] = len(s) - len(word) - (1 if word else 0)
                s = BLANK + word if word else ""
                parts[i] = s
                if not word:
                    continue
            by_length.setdefault(len(s), []).append(i)
        first, sizes = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        found: list[np.ndarray] = []
        special, used = set(extra), 0
        for length, some in by_length.items():
            points = np.frombuffer("".join([parts[i] for i in some]).encode("utf-32-le"), np.uint32).reshape(len(some), length)
            flat, many = self._viterbi(points)
            upto, which = np.cumsum(many), np.array(some)
            first[which], sizes[which] = used + upto - many, many
            special.update(which[np.searchsorted(upto, np.flatnonzero(flat == RAW), side="right")].tolist())
            found.append(flat)
            used += len(flat)
        ids = np.concatenate(found) if found else np.zeros(0, np.int64)
        changed = []
        for i in sorted(special):
            part = ids[first[i] : first[i] + sizes[i]]
            if (part == RAW).any():
                part = self._raw(parts[i], part)
            if i in extra:
                part = self._run(extra[i], part)
            changed.append(part)
            first[i], sizes[i] = used, len(part)
            used += len(part)
        ids = np.concatenate([ids, *changed])
        upto = np.concatenate([[0], np.cumsum(count)])
        return ids[tk.ragged(first, sizes)], np.add.reduceat(sizes, upto[:-1]) if len(sizes) else sizes

    def _run(self, blanks: int, rest: np.ndarray) -> np.ndarray:
        """Blanks before a word: one that its word does not take joins them; the longest pieces come first."""
        if len(rest) and self.p.text[rest[0]] == BLANK:
            blanks, rest = blanks + 1, rest[1:]
        out = []
        while blanks:
            size = next(r for r in self.p.runs if r <= blanks)
            out.append(self.p.id_of[BLANK * size])
            blanks -= size
        return np.concatenate([np.array(out, np.int64), rest])

    def _raw(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Characters without a piece as bytes."""
        out, at = [], 0
        for i in ids.tolist():
            if i != RAW:
                out.append(i)
                at += len(self.p.text[i])
                continue
            if self.p.byte_id:
                out.extend(self.p.byte_id[b] for b in text[at].encode("utf-8", "replace"))
            elif not out or out[-1] != self.p.unknown:
                out.append(self.p.unknown)
            at += 1
        return np.array(out, np.int64)

    def _fits(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """compatible() with a memory; the start and characters without a piece go with anything."""
        out = (first < 0) | (second < 0)
        both = np.flatnonzero(~out)
        key = first[both] * len(self.p.text) + second[both]
        slot = (key * 2654435761) % PAIR_SLOTS
        miss = np.flatnonzero(self.seen[slot] != key)
        known = self.verdict[slot]
        if len(miss):
            new, which = np.unique(key[miss], return_inverse=True)
            verdict = self.p.compatible(new // len(self.p.text), new % len(self.p.text))
            at = (new * 2654435761) % PAIR_SLOTS
            self.seen[at], self.verdict[at] = new, verdict
            known[miss] = verdict[which]
        out[both] = known
        return out

    def _viterbi(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length (rows of code points), one after the other, and how many each has."""
        p, (rows, n) = self.p, points.shape
        powers = np.array([pow(tk.BASE, k, 1 << 64) for k in range(min(n, p.longest) + 1)], np.uint64)
        prefix = np.zeros((rows, n + 1), np.uint64)
        for i in range(n):
            prefix[:, i + 1] = prefix[:, i] * np.uint64(tk.BASE) + points[:, i].astype(np.uint64) + np.uint64(1)
        token = np.full((rows, n + 1), NONE, np.int64)
        step = np.zeros((rows, n + 1), np.int64)
        score = np.zeros((rows, n + 1))
        token[:, 0] = START
        for i in range(1, n + 1):
            # Longest first, so that the first of equal maxima is the one that starts first.
            sizes = np.arange(min(i, p.longest), 0, -1)
            h = tk.mix(prefix[:, i : i + 1] - prefix[:, i - sizes] * powers[sizes][None, :])
            ids = np.full(h.shape, NONE, np.int64)
            row, column = np.nonzero(self.maybe[h >> np.uint64(64 - FIRST_BITS)])
            key = h[row, column]
            place = np.minimum(np.searchsorted(p.keys, key), len(p.keys) - 1)
            ids[row, column] = np.where(p.keys[place] == key, p.ids[place], NONE)
            ids[:, -1][ids[:, -1] == NONE] = RAW
            value = np.full(ids.shape, -np.inf)
            row, column = np.nonzero(ids != NONE)
            here, before = ids[row, column], i - sizes[column]
            if p.kind == BPE:
                value[row, column] = np.where(self._fits(token[row, before], here), 0.0, -np.inf)
            else:
                value[row, column] = score[row, before] + np.where(here == RAW, self.lowest, self.scores[here])
            best = value.argmax(axis=1)
            every = np.arange(rows)
            token[:, i], step[:, i], score[:, i] = ids[every, best], sizes[best], value[every, best]
        out = np.full((rows, n), NONE, np.int64)
        at, place = np.full(rows, n), n
        while (at > 0).any():
            place -= 1
            live = np.flatnonzero(at > 0)
            out[live, place] = token[live, at[live]]
            at[live] -= step[live, at[live]]
        return out[out != NONE], (out != NONE).sum(axis=1)


class Decoder:
    """Bytes of ids: pieces with blanks as spaces, byte pieces as they are, without the blank put before a text."""

    def __init__(self, pieces: Pieces) -> None:
        parts = []
        for text, kind in zip(pieces.text, pieces.kinds):
            if kind == BYTE:
                parts.append(bytes([int(text[1:-1], 16)]))
            elif kind == CONTROL:
                parts.append(b"")
            elif kind == UNKNOWN:
                parts.append(" ⁇ ".encode())
            else:
                parts.append(text.replace(BLANK, " ").encode())
        self.lengths = np.array([len(b) for b in parts], np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.dummy = pieces.dummy

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' bytes one after the other, and their offsets."""
        lengths = self.lengths[ids]
        data = self.bytes[tk.ragged(self.first[ids], lengths)]
        at = np.concatenate([[0], np.cumsum(lengths)])[offsets]
        if self.dummy and len(data):
            head = at[:-1][np.diff(at) > 0]
            drop = np.zeros(len(data), bool)
            drop[head] = data[head] == 0x20
            at = at - np.concatenate([[0], np.cumsum(drop)])[at]
            data = data[~drop]
        return data, at


def load(path: str, kind: int | None = None) -> Pieces:
    with open(path, "rb") as f:
        return Pieces(f.read(), kind)


def _texts(data: np.ndarray, upto: np.ndarray) -> pa.Array:
    raw = data.tobytes()
    return pa.array([raw[a:b].decode("utf-8", "replace") for a, b in zip(upto[:-1].tolist(), upto[1:].tolist())], pa.string())


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", back: str | None = None) -> DataFrame:
    """docs with ids (array<int>), as the library's encode gives them. A null or empty text has no ids; all rows and other columns stay, ids is replaced.

    With back, the column of that name holds what decode makes of the ids, by the same worker: a task has one.
    """

    def make():
        codec, decoder = SentencePiece(pieces), Decoder(pieces) if back else None

        def work(data: np.ndarray, offsets: np.ndarray) -> list:
            ids, upto = codec.encode_rows(data, offsets)
            out = [pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids.astype(np.int32)))]
            return out + [_texts(*decoder.decode(ids, upto))] if decoder else out

        return work

    return tk.append_columns(docs, text, "ids array<int>" + (f", `{back}` string" if back else ""), make, limit=SLICE_BYTES)


def decode(rows: DataFrame, pieces: Pieces, ids: str = "ids", out: str = "text") -> DataFrame:
    """rows with out (string) from their ids; null ids give an empty text, bytes that are no UTF-8 become U+FFFD. out is replaced."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = Decoder(pieces)
        for column in batches:
            values, lengths = list_column(pa.chunked_array([column.fill_null([])]))
            yield _texts(*decoder.decode(values.astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])))

    text = F.arrow_udf(run, T.StringType()).asNondeterministic()
    names = [F.col(f"`{c}`") for c in rows.columns if c != out]
    return tk.small_batches(rows).select(*names, text(F.col(ids)).alias(out))


def op3_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its ids, their number, and round_trip: decoding them gives the text back (null: empty)."""
    from .packing import tokenizer_file

    pieces = load(tokenizer_file(TOKENIZER))
    back = encode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), pieces, back="back")
    return back.select(F.col("doc_id").cast("long").alias("doc_id"), F.size("ids").cast("long").alias("n_ids"), "ids", (F.col("back") == F.coalesce("text", F.lit(""))).alias("round_trip"))
