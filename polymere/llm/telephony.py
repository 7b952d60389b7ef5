"""Telephony audio: mu-law, A-law and IMA ADPCM payloads to resampled 16-bit PCM.

mu-law and A-law bytes are expanded through tables of 256 entries. ADPCM blocks
(four bytes of header, then two samples a byte, low half first) depend on their
own header only, so the blocks of all payloads advance together, one numpy step
for each sample of a block. Payloads are then resampled by a polyphase
windowed-sinc filter, all of them in one run, set apart by zeros; no sum depends
on which payloads share the run.

Defined results: a null payload, or an unknown or null codec, gives null n_samples
and pcm; an empty payload gives no samples. A last ADPCM block may be short; one
without a whole header gives none. Audio beyond the 2 GB that a value can hold
is null too. A null id is carried as it is, one that is no whole number is null,
and a repeated row gives its audio again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CODECS = ("mulaw", "alaw", "ima_adpcm")
HALF_TAPS = 8
CHUNK = 1 << 20
#: Bytes of a value that Spark can hold.
LONGEST = (1 << 31) - 64


def _mulaw() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    x = ((((u & 15) << 3) + 0x84) << ((u >> 4) & 7)) - 0x84
    return np.where(u & 0x80, -x, x).astype(np.int16)


def _alaw() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    exponent, mantissa = (a >> 4) & 7, a & 15
    x = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(a & 0x80, x, -x).astype(np.int16)


EXPAND = np.concatenate([_mulaw(), _alaw()])
STEPS = [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767]
_s = np.array(STEPS)[:, None]
_n = np.arange(16)[None, :]
_DIFF = ((_s >> 3) + np.where(_n & 1, _s >> 2, 0) + np.where(_n & 2, _s >> 1, 0) + np.where(_n & 4, _s, 0)) * np.where(_n & 8, -1, 1)
_DIFF = np.ascontiguousarray(_DIFF).astype(np.int32)
_MOVE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
_NEXT = np.clip(np.arange(89)[:, None] + _MOVE[None, :], 0, 88).astype(np.int32)


def decode_adpcm(payloads: list[np.ndarray], block: int) -> list[np.ndarray]:
    """16-bit samples of each payload."""
    blocks = [math.ceil(len(p) / block) if len(p) else 0 for p in payloads]
    blocks = [n - 1 if n and len(p) - (n - 1) * block < 4 else n for n, p in zip(blocks, payloads)]
    total = sum(blocks)
    if not total:
        return [np.zeros(0, np.int16) for _ in payloads]
    raw = np.zeros((total, block), np.uint8)
    at = 0
    for n, p in zip(blocks, payloads):
        flat = p[: n * block]
        raw[at : at + n].reshape(-1)[: len(flat)] = flat
        at += n
    samples = 1 + 2 * (block - 4)
    out = np.empty((samples, total), np.int16)
    value = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(raw[:, 2], 88).astype(np.int32)
    out[0] = value
    codes = np.ascontiguousarray(raw[:, 4:].T)
    for k in range(1, samples):
        byte = codes[(k - 1) >> 1]
        code = (byte & 15 if k & 1 else byte >> 4).astype(np.int32)
        value = np.clip(value + _DIFF[index, code], -32768, 32767)
        index = _NEXT[index, code]
        out[k] = value
    out = np.ascontiguousarray(out.T)
    result, at = [], 0
    for n, p in zip(blocks, payloads):
        have = (n - 1) * samples + 1 + 2 * (min(len(p) - (n - 1) * block, block) - 4) if n else 0
        result.append(out[at : at + n].reshape(-1)[:have])
        at += n
    return result


def filter_bank(up: int, down: int, half: int = HALF_TAPS) -> tuple[list[int], np.ndarray]:
    """For each of `up` phases: its offset in input samples, and its taps from offset + 1 - width to offset + width."""
    cut = min(1.0, up / down)
    width = math.ceil(half / cut)
    offsets = [p * down // up for p in range(up)]
    taps = np.zeros((up, 2 * width), np.float32)
    for p in range(up):
        u = np.arange(1 - width, width + 1) - (p * down % up) / up
        h = np.sinc(cut * u) * np.where(np.abs(u) < width, 0.5 + 0.5 * np.cos(np.pi * u / width), 0)
        taps[p] = h / h.sum()
    return offsets, taps


def resample(signals: list[np.ndarray], up: int, down: int) -> list[np.ndarray]:
    """Each 16-bit signal at up / down times its rate, with ceil(n * up / down) samples."""
    offsets, taps = filter_bank(up, down)
    width = taps.shape[1] // 2
    lead = math.ceil(width / down) * down
    spans, at = [], 0
    for s in signals:
        spans.append(at + lead)
        at += lead + math.ceil((len(s) + width + down) / down) * down
    x = np.zeros(at + lead + down, np.float32)
    for start, s in zip(spans, signals):
        x[start : start + len(s)] = s
    n = at // down
    y = np.empty((n, up), np.int16)
    piece = 1 << 15  # stays in cache
    for j in range(0, n, piece):
        m = min(piece, n - j)
        for p in range(up):
            total = np.zeros(m, np.float32)
            for t, c in enumerate(taps[p]):
                if c:
                    a = j * down + offsets[p] + t + 1 - width
                    if a < 0:  # before the first signal all is zero
                        skip = -(-(-a) // down)
                        total[skip:] += c * x[a + skip * down : a + m * down : down][: m - skip] if skip < m else 0
                    else:
                        total += c * x[a : a + m * down : down][:m]
            y[j : j + m, p] = np.clip(np.rint(total), -32768, 32767)
    y = y.reshape(-1)
    return [y[start // down * up : start // down * up + math.ceil(len(s) * up / down)] for start, s in zip(spans, signals)]


def decode(payloads: list[np.ndarray | None], codecs: list[str | None], rate_in: int, rate_out: int, block: int) -> list[np.ndarray | None]:
    """Resampled PCM of each payload; None for null payloads and unknown codecs."""
    pcm: list[np.ndarray | None] = [None] * len(payloads)
    adpcm = [i for i, c in enumerate(codecs) if c == "ima_adpcm" and payloads[i] is not None]
    for i, s in zip(adpcm, decode_adpcm([payloads[i] for i in adpcm], block)):
        pcm[i] = s
    for i, (p, c) in enumerate(zip(payloads, codecs)):
        if p is not None and c in ("mulaw", "alaw"):
            pcm[i] = EXPAND[256 * (c == "alaw") :][p]
    if rate_in != rate_out:
        there = [i for i, s in enumerate(pcm) if s is not None]
        g = math.gcd(rate_in, rate_out)
        for i, s in zip(there, resample([pcm[i] for i in there], rate_out // g, rate_in // g)):
            pcm[i] = s
    return pcm


def n_samples(n_bytes: int, codec: str | None, rate_in: int, rate_out: int, block: int) -> int:
    """Samples at rate_out of a payload of n_bytes."""
    n = n_bytes
    if codec == "ima_adpcm":
        whole, rest = divmod(n_bytes, block)
        n = whole * (1 + 2 * (block - 4)) + (1 + 2 * (rest - 4) if rest >= 4 else 0)
    return -(-n * rate_out // rate_in)


def _binary(pcm: list[np.ndarray | None], kind: pa.DataType) -> pa.Array:
    """Samples as a binary column, by its buffers: pyarrow doesn't release memory views that it makes values of."""
    there = np.array([s is not None for s in pcm], bool)
    offsets = np.concatenate([[0], np.cumsum([0 if s is None else 2 * len(s) for s in pcm])]).astype(np.int64)
    data = np.concatenate([np.zeros(0, np.int16), *[s for s in pcm if s is not None]]).astype("<i2", copy=False)
    known = pa.py_buffer(np.packbits(there, bitorder="little"))
    large = pa.types.is_large_binary(kind)
    return pa.Array.from_buffers(kind, len(pcm), [known, pa.py_buffer(offsets if large else offsets.astype(np.int32)), pa.py_buffer(data)])


def store_pcm(df: DataFrame, id_column: str, payload: str, codec: str, rate_in: int = 8000, rate_out: int = 16000, block: int = 256) -> DataFrame:
    """(id, codec, sample_rate, n_samples, pcm) of each row of df, pcm being little-endian 16-bit mono."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = b.column("payload")
            length = pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            turn = (np.cumsum(length) - length) // CHUNK
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(turn)) + 1, [len(data)]])
            for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                names = part.column("codec").to_pylist()
                fits = [2 * n_samples(int(n), c, rate_in, rate_out, block) <= LONGEST for n, c in zip(length[lo:hi], names)]
                pcm = decode([None if not v.is_valid or not ok else np.frombuffer(v.as_buffer(), np.uint8) for v, ok in zip(part.column("payload"), fits)], names, rate_in, rate_out, block)
                n = pa.array([None if s is None else len(s) for s in pcm], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("codec"), pa.array(np.full(len(pcm), rate_out, np.int32)), n, _binary(pcm, data.type)], ["id", "codec", "sample_rate", "n_samples", "pcm"])

    rows = df.select(F.col(id_column).try_cast("bigint").alias("id"), F.col(payload).cast("binary").alias("payload"), F.col(codec).cast("string").alias("codec"))
    return rows.mapInArrow(run, "id bigint, codec string, sample_rate int, n_samples bigint, pcm binary").withColumnRenamed("id", id_column)
