"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces come from a public SentencePiece model file, whose path is a parameter; nothing is trained
here. The file's own scores are merge ranks, so a piece of rank r gets the log score
``-log(r + OFFSET)`` (Zipf's law over ranks). The best segmentation of a text has the largest sum of
log scores. A character that no piece covers costs ten below the worst piece and is written as the
pieces of its UTF-8 bytes.

Text is normalised as the model file says for this vocabulary: a leading white-space marker, every
space a marker, nothing else changed. No piece has a marker behind another character, so the best
segmentation falls apart at each start of a run of markers: segments are solved one by one and
remembered, up to a bound. Unknown segments of a batch are solved together, one numpy step for each
place and piece length. Segments of more than ``LONGEST`` characters (text without spaces) are walked one by one
through the same arrays, with the same comparisons in the same order. Of equal sums the one with the longest last
piece is taken, at every place.

Decoding joins the pieces, turns markers into spaces, byte pieces into bytes, and takes off the leading
space. A marker character in the text itself is written as bytes, so every text comes back exactly.

Nulls encode to null, an empty text to no pieces. Texts of any length are worked on whole; some 30 bytes a
character are held for a segment while it is solved. Repeated rows get equal results, a row each; an empty table
gives an empty result. Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARKER = "▁"
OFFSET = 2.7
#: Segments that a worker remembers, and the length above which one is not.
REMEMBERED, LONGEST = 150_000, 48
#: Cells (segments * length) that are solved in one go.
CELLS = 1 << 18


class DoubleArray:
    """A trie in two arrays: from state s, character code c leads to base[s] + c if check there is s."""

    def __init__(self, pieces: list[np.ndarray], codes: int) -> None:
        size = 1 << 16
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.codes, self.turn, self.slots = codes, 0, None
        self.check[0] = 0
        order = sorted(range(len(pieces)), key=lambda i: pieces[i].tolist())
        self._place(0, [(pieces[i].tolist(), i) for i in order])

    def _grow(self, need: int) -> None:
        while need >= len(self.base):
            for name, empty in (("base", 0), ("check", -1), ("value", -1)):
                old = getattr(self, name)
                setattr(self, name, np.concatenate([old, np.full(len(old), empty, np.int32)]))

    def _place(self, top: int, pieces: list) -> None:
        todo = [(top, 0, pieces)]
        while todo:
            state, depth, own = todo.pop()
            below: dict[int, list] = {}
            for item in own:
                if len(item[0]) == depth:
                    self.value[state] = item[1]
                else:
                    below.setdefault(item[0][depth], []).append(item)
            if not below:
                continue
            labels = np.array(sorted(below))
            base = self._room(labels)
            self.base[state] = base
            self.check[base + labels] = state
            todo += [(base + c, depth + 1, below[c]) for c in below]

    def _room(self, labels: np.ndarray) -> int:
        """The first base that puts every label on a free slot."""
        while True:
            if self.turn % 256 == 0:
                self.slots = np.flatnonzero(self.check[: -self.codes] == -1)
            self.turn += 1
            for start in range(0, len(self.slots), 256):
                bases = self.slots[start : start + 256] - labels[0]
                bases = bases[bases > 0]
                fits = (self.check[bases[:, None] + labels] == -1).all(axis=1)
                if fits.any():
                    return int(bases[fits.argmax()])
            self._grow(len(self.check))
            self.turn = 0

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Next states; -1 where there is none. Code 0 is no character of any piece."""
        to = self.base[states] + codes
        return np.where((codes > 0) & (self.check[to] == states), to, -1)


class Pieces:
    """A vocabulary with its trie, scores and byte pieces."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.texts = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(self.texts)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        if any(c == MARKER and p != MARKER for i in plain for p, c in zip(self.texts[i], self.texts[i][1:], strict=False)):
            raise ValueError("a piece has a marker behind another character")
        self.byte_ids = np.zeros(256, np.int32)
        for i, text in enumerate(self.texts):
            if sp.is_byte(i):
                self.byte_ids[int(text[3:5], 16)] = i
        self.scores = np.full(len(self.texts), -np.inf)
        self.scores[plain] = -np.log(np.arange(len(plain)) + OFFSET)
        self.unknown = self.scores[plain].min() - 10
        letters = sorted({c for i in plain for c in self.texts[i]})
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.trie = DoubleArray([self.code[[ord(c) for c in self.texts[i]]] for i in plain], len(letters) + 1)
        self.ids = np.array(plain, np.int32)
        self.longest = max(len(self.texts[i]) for i in plain)
        self.decoded = [t.replace(MARKER, " ").encode() for t in self.texts]
        for b, i in enumerate(self.byte_ids):
            self.decoded[i] = bytes([b])
        self.byte_pieces = self.byte_ids.tolist()
        self.known: dict[str, bytes] = {}  # piece ids as bytes, which take less room than arrays and are joined faster
        #: What a walk reads, value by value.
        self.cells = [memoryview(v) for v in (self.trie.base, self.trie.check, self.trie.value, self.ids, self.scores[self.ids])]

    def solve(self, segments: list[str]) -> list[np.ndarray]:
        """Best piece ids of each segment. The lone marker stands for a space; a private-use stand-in never occurs."""
        n, width = len(segments), max(map(len, segments))
        points = np.zeros((n, width), np.int64)
        for row, s in zip(points, segments, strict=True):
            row[: len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.code[points]
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        taken, length = np.full((n, width + 1), -1, np.int32), np.zeros((n, width + 1), np.int32)
        sizes = np.array(list(map(len, segments)))
        for start in range(width):
            rows = np.flatnonzero(sizes > start)
            alone = best[rows, start] + self.unknown
            better = alone > best[rows, start + 1]
            best[rows[better], start + 1], taken[rows[better], start + 1], length[rows[better], start + 1] = alone[better], -1, 1
            states = np.zeros(len(rows), np.int32)
            for end in range(start + 1, min(width, start + self.longest) + 1):
                states = self.trie.step(states, codes[rows, end - 1])
                alive = states >= 0
                rows, states = rows[alive], states[alive]
                if not len(rows):
                    break
                piece = self.trie.value[states]
                at, ids = rows[piece >= 0], self.ids[piece[piece >= 0]]
                score = best[at, start] + self.scores[ids]
                better = score > best[at, end]
                at, ids = at[better], ids[better]
                best[at, end], taken[at, end], length[at, end] = score[better], ids, end - start
        return self._read_all(segments, sizes, taken, length)

    def _read_all(self, segments: list[str], sizes: np.ndarray, taken: np.ndarray, length: np.ndarray) -> list[np.ndarray]:
        """Piece ids along the best ways of many segments, all followed together; those with byte pieces are read one by one."""
        at, rows, ways = sizes.copy(), np.arange(len(segments)), []
        counts, bytewise = np.zeros(len(segments), np.int64), np.zeros(len(segments), bool)
        while len(rows):
            ids = taken[rows, at[rows]]
            ways.append((rows, ids))
            counts[rows] += 1
            bytewise[rows[ids < 0]] = True
            at[rows] -= length[rows, at[rows]]
            rows = rows[at[rows] > 0]
        ends = np.cumsum(counts)
        flat = np.empty(int(ends[-1]), np.int32)
        for back, (rows, ids) in enumerate(ways, 1):
            flat[ends[rows] - back] = ids
        out = [flat[start:end] for start, end in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
        for k in np.flatnonzero(bytewise):
            out[k] = self._read(segments[k], taken[k], length[k])
        return out

    def walk(self, segment: str) -> np.ndarray:
        """Best piece ids of one segment of any length."""
        base, check, value, ids, worth = self.cells
        n = len(segment)
        codes = memoryview(self.code[np.frombuffer(segment.encode("utf-32-le", "surrogatepass"), np.uint32)])
        scores, taken, length = np.full(n + 1, -np.inf), np.full(n + 1, -1, np.int32), np.zeros(n + 1, np.int32)
        scores[0] = 0
        best, last, size, unknown = memoryview(scores), memoryview(taken), memoryview(length), float(self.unknown)
        for start in range(n):
            here, state = best[start], 0
            if here + unknown > best[start + 1]:
                best[start + 1], last[start + 1], size[start + 1] = here + unknown, -1, 1
            for end in range(start, n):
                code = codes[end]
                to = base[state] + code
                if not code or check[to] != state:
                    break
                state, piece = to, value[to]
                if piece >= 0:
                    score = here + worth[piece]
                    if score > best[end + 1]:
                        best[end + 1], last[end + 1], size[end + 1] = score, ids[piece], end + 1 - start
        return self._read(segment, taken, length)

    def _read(self, segment: str, taken: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Piece ids along the best way, which is followed from its end."""
        found, at = [], len(segment)
        last, size = memoryview(np.ascontiguousarray(taken)), memoryview(np.ascontiguousarray(length))
        while at:
            step = size[at]
            if last[at] >= 0:
                found.append(last[at])
            else:
                found += map(self.byte_pieces.__getitem__, reversed(segment[at - step : at].replace(STAND_IN, MARKER).encode("utf-8", "surrogatepass")))
            at -= step
        return np.array(found[::-1], np.int32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Piece ids of each text."""
        parts = [cut(t) for t in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        fresh = sorted(set().union(*parts).difference(known), key=len)
        own = {s: self.walk(s).tobytes() for s in fresh if len(s) > LONGEST}
        long = list(own)
        del fresh[len(fresh) - len(long) :]  # the longest stand last
        start = 0
        while start < len(fresh):
            end = start + 1
            while end < len(fresh) and (end + 1 - start) * len(fresh[end]) <= CELLS:
                end += 1
            own |= zip(fresh[start:end], (v.tobytes() for v in self.solve(fresh[start:end])), strict=True)
            start = end
        known |= own
        out = [np.frombuffer(b"".join(map(known.__getitem__, p)), np.int32) for p in parts]
        for s in long:
            del known[s]
        return out

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.decoded.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogatepass")


#: What a marker character of the text itself is while segments are solved: a code point that is no character.
STAND_IN = "\U0010ffff"


def cut(text: str) -> list[str]:
    """Segments of a text: cut before each run of spaces. Their concatenation is the normalised text."""
    if not text:
        return []
    words = text.replace(MARKER, STAND_IN).split(" ")
    out, markers = [], MARKER
    for k, w in enumerate(words):
        if w or k + 1 == len(words):
            out.append(markers + w)
            markers = MARKER
        else:
            markers += MARKER
    return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Pieces:
    return Pieces(path)


#: Characters that are worked on together, and handed on together.
PORTION = 600_000


def _encode(path: str, columns: int, schema: pa.Schema):
    """Batches whose last column is the text: the other columns and the encoding, a portion at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary(path)
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(columns)), 0).to_numpy()
            start = 0
            while start < len(batch):
                end, held = start + 1, int(sizes[start])
                while end < len(batch) and held + int(sizes[end]) <= PORTION:
                    held += int(sizes[end])
                    end += 1
                part = batch.slice(start, end - start)
                texts = part.column(columns).to_pylist()
                at = [k for k, t in enumerate(texts) if t is not None]
                ids, back, sha = ([None] * len(texts) for _ in range(3))
                for k, found in zip(at, own.encode([texts[k] for k in at]), strict=True):
                    decoded = own.decode(found)
                    ids[k], back[k], sha[k] = found, decoded == texts[k], hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()
                counts = [None if v is None else len(v) for v in ids]
                offsets = np.concatenate(([0], np.cumsum([n or 0 for n in counts]))).astype(np.int32)
                values = np.concatenate([v for v in ids if v is not None] or [np.zeros(0, np.int32)])
                missing = pa.array([v is None for v in ids])
                pieces = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), mask=missing)
                made = [pieces.cast(schema.field("piece_ids").type), pa.array(counts, pa.int32()), pa.array(back, pa.bool_()), pa.array(sha, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:columns], *made], names=schema.names)
                start = end

    return run


def encoded(docs: DataFrame, path: str = VOCABULARY, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """The named columns (all but the text) with piece_ids, n_pieces, round_trip and decoded_sha256 (of the decoded text)."""
    columns = [c for c in docs.columns if c != text] if columns is None else columns
    rows = docs.select(*(F.col(f"`{c}`") for c in columns), F.col(f"`{text}`").cast("string").alias("_text"))
    made = T.StructType([T.StructField("piece_ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.IntegerType()), T.StructField("round_trip", T.BooleanType()), T.StructField("decoded_sha256", T.StringType())])
    schema = T.StructType(rows.schema.fields[:-1] + made.fields)
    names = pa.schema([pa.field(f.name, pa.list_(pa.int32()) if f.name == "piece_ids" else pa.null()) for f in schema.fields])
    return rows.mapInArrow(_encode(path, len(columns), names), schema)


def decoded(rows: DataFrame, path: str = VOCABULARY, ids: str = "piece_ids") -> DataFrame:
    """``rows`` with text_back, the text of their piece ids."""
    from typing import Iterator as It

    import pandas as pd

    def run(batches):
        own = vocabulary(path)
        for batch in batches:
            yield pd.Series([None if v is None else own.decode(np.asarray(v, np.int32)) for v in batch])

    run.__annotations__ = {"batches": It[pd.Series], "return": It[pd.Series]}
    return rows.withColumn("text_back", F.pandas_udf(run, "string")(F.col(f"`{ids}`")))
