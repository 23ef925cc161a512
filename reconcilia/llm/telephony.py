"""Telephony audio as media columns.

A payload of bytes is one second for every 8000 bytes of G.711 audio. It is stored as a RIFF/WAVE
file of 8-bit mu-law samples, without loss, in a binary column, and beside it the same audio resampled: a
RIFF/WAVE file of 16 kHz, 16-bit PCM. Both are read back from their columns, chunk by chunk, never by a fixed offset.
From the bytes read back come

* mu-law and A-law PCM by 256-entry lookup tables built from the G.711 rule,
* IMA ADPCM PCM: the same bytes seen as 64-byte blocks (4 bytes of state, 120 four-bit steps),
  decoded with numpy across all blocks at once, step by step,
* a checksum of the resampled PCM: each sample, then the mean of it and the next.

The columns are made and read in one job; where they are to outlive it, the caller writes ``stored``.

Null texts count as empty. Every payload has at least one block of 64 bytes; zeros fill the last.
Equal texts give equal values in every column. Texts of any length are stored whole. Repeated rows stay apart; an empty
table gives an empty result. Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from reconcilia.llm.common import columns_of

BLOCK = 64
RATE = 8000
MULAW_FORMAT = 7
#: Blocks that ADPCM decoding holds at a time.
BLOCKS = 1 << 15

# Step index changes of IMA ADPCM by code.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


@lru_cache(maxsize=1)
def steps() -> np.ndarray:
    """The 89 ADPCM step sizes: each a tenth above the one before, from 7, as the format lists them."""
    # IMA ADPCM step table.
    return np.array([
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
        1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
        7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ], np.int32)


@lru_cache(maxsize=1)
def mulaw_table() -> np.ndarray:
    """PCM of each mu-law byte: inverted bits, sign, 3-bit exponent, 4-bit mantissa, bias 132."""
    u = ~np.arange(256) & 255
    size = ((u & 15) * 8 + 132 << (u >> 4 & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


@lru_cache(maxsize=1)
def alaw_table() -> np.ndarray:
    """PCM of each A-law byte: even bits inverted, sign, 3-bit exponent, 4-bit mantissa."""
    a = np.arange(256) ^ 0x55
    exponent, size = a >> 4 & 7, (a & 15) * 16 + 8
    size = np.where(exponent == 0, size, size + 256 << np.maximum(exponent - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


def payload_of(text: str | None) -> bytes:
    body = (text or "").encode("utf-8", "surrogatepass")
    return body + bytes(BLOCK - len(body) if not body else -len(body) % BLOCK)


PCM_FORMAT = 1


def wave_file(samples: bytes, form: int = MULAW_FORMAT, rate: int = RATE) -> bytes:
    """A mono RIFF/WAVE file: 8-bit mu-law samples, with the fact chunk that such files carry, or 16-bit PCM."""
    width = 1 if form == MULAW_FORMAT else 2
    head = struct.pack("<HHIIHH", form, 1, rate, rate * width, width, 8 * width)
    chunks = [(b"fmt ", head + b"\0\0" if form == MULAW_FORMAT else head)]
    chunks += [(b"fact", struct.pack("<I", len(samples)))] if form == MULAW_FORMAT else []
    body = b"WAVE" + b"".join(name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2) for name, data in [*chunks, (b"data", samples)])
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wave_samples(media: bytes, form: int = MULAW_FORMAT) -> bytes:
    """The sample bytes of such a file; raises on any other."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, found = 12, None
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            found = struct.unpack_from("<HHIIHH", media, at + 8)
        elif name == b"data":
            if found is None or (found[0], found[1], found[5]) != (form, 1, 8 if form == MULAW_FORMAT else 16):
                raise ValueError("not mono of that format")
            return media[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


def adpcm_sums(payloads: list[bytes]) -> np.ndarray:
    """For each payload: sum of samples, of their sizes, and peak size of its ADPCM blocks."""
    per = np.array([len(p) // BLOCK for p in payloads])
    flat = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, BLOCK)
    sums = np.empty((len(flat), 3), np.int64)
    for start in range(0, len(flat), BLOCKS):
        pcm = adpcm_pcm(flat[start : start + BLOCKS]).astype(np.int32)
        size = np.abs(pcm)
        sums[start : start + BLOCKS] = np.stack([pcm.sum(axis=0), size.sum(axis=0), size.max(axis=0)], axis=1)
    edges = np.concatenate(([0], per.cumsum()[:-1]))
    return np.column_stack([np.add.reduceat(sums[:, 0], edges), np.add.reduceat(sums[:, 1], edges), np.maximum.reduceat(sums[:, 2], edges)])


def adpcm_pcm(blocks: np.ndarray) -> np.ndarray:
    """Samples of IMA ADPCM blocks (rows of bytes): one column for each block, decoded side by side."""
    sample = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), np.uint8)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = sample
    table = steps()
    # difference of a code at each step index: step/8 + step/4 + step/2 + step by its bits, signed by bit 3
    change = (table[:, None] >> 3) + sum(np.where(np.arange(16) & bit, table[:, None] >> shift, 0) for bit, shift in ((4, 0), (2, 1), (1, 2)))
    change = np.where(np.arange(16) & 8, -change, change).astype(np.int32).ravel()
    follow = np.clip(np.arange(89)[:, None] + INDEX_CHANGE, 0, 88).astype(np.int32).ravel()
    for k, code in enumerate(codes):
        key = index * 16 + code
        sample = np.clip(sample + change[key], -32768, 32767)
        index = follow[key]
        out[k + 1] = sample
    return out


def resampled(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: each sample, then the mean of it and the next (the last one is repeated)."""
    out = np.empty(2 * len(pcm), "<i2")
    out[0::2] = pcm
    wide = pcm.astype(np.int32)
    out[1::2] = wide + np.append(wide[1:], wide[-1:]) >> 1
    return out


MEDIA_DDL = "doc_id long, n_bytes long, media binary, resampled binary"
MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("resampled", pa.binary())])
#: Payload bytes worked on together.
PORTION = 2 << 20


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = mulaw_table()
    rows: list[tuple] = []
    held = 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            payload = payload_of(text)
            pcm = resampled(table[np.frombuffer(payload, np.uint8)]).tobytes()
            rows.append((doc, len((text or "").encode("utf-8", "surrogatepass")), wave_file(payload), wave_file(pcm, PCM_FORMAT, 2 * RATE)))
            held += len(payload)
            if held > PORTION:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), MEDIA, strict=True)], schema=MEDIA)
                rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), MEDIA, strict=True)], schema=MEDIA)


def stored(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, media (every text as a mu-law WAVE file), resampled (its audio as a 16 kHz PCM WAVE file)."""
    return docs.select(columns_of(docs, doc_id)[0].cast("long").alias("doc_id"), columns_of(docs, text)[0].cast("string").alias("text")).mapInArrow(_store, MEDIA_DDL)


FEATURES = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
FEATURES_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def level_words(name: str, pcm: np.ndarray) -> str:
    """Mean power and peak size of samples."""
    wide = pcm.astype(np.int64)
    return f"{name}={int((wide * wide).sum()) // len(pcm)}:{int(np.abs(wide).max())}"


def feature_rows(medias: list[bytes], others: list[bytes]) -> list[tuple]:
    """Payload and audio features of stored files, all from the bytes read back."""
    payloads = [wave_samples(m) for m in medias]
    rows = []
    for media, payload, other, adpcm in zip(medias, payloads, others, adpcm_sums(payloads), strict=True):
        codes = np.frombuffer(payload, np.uint8)
        words = [level_words("mu", mulaw_table()[codes]), level_words("a", alaw_table()[codes]), "adpcm=" + ":".join(str(int(x)) for x in adpcm)]
        words.append(f"pcm16k={zlib.crc32(wave_samples(other, PCM_FORMAT)):08x}")
        rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), " ".join(words)))
    return rows


def _analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(FEATURES)
    for batch in batches:
        ids, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        start = held = 0
        for i, media in enumerate(batch.column(2)):
            held += len(media.as_buffer())
            if held > PORTION or i + 1 == len(ids):
                rows = feature_rows(*(batch.column(c).slice(start, i + 1 - start).to_pylist() for c in (2, 3)))
                names = [ids[start : i + 1], sizes[start : i + 1], *zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(names, schema, strict=True)], schema=schema)
                start, held = i + 1, 0


def features(media: DataFrame) -> DataFrame:
    """Digest columns of ``stored`` rows."""
    return media.select("doc_id", "n_bytes", "media", "resampled").mapInArrow(_analyse, FEATURES_DDL)
