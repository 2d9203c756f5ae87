"""Telephony audio: mu-law, A-law and IMA ADPCM payloads in WAV containers.

Companded samples expand by lookup tables; ADPCM blocks decode step by step across all
blocks at once; expanded PCM is resampled by linear interpolation. A null text is empty;
an empty one has a payload of one unit of spaces; equal texts give equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pieces, text_docs

UNIT = 192
RATE = 8000
PCM, MU_LAW, A_LAW, IMA_ADPCM = 1, 7, 6, 17
#: Fixed values of the IMA ADPCM format: step sizes and index changes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
CHANGES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def mu_law_table() -> np.ndarray:
    """16-bit samples of the 256 mu-law codes (G.711)."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    """16-bit samples of the 256 A-law codes (G.711)."""
    code = np.arange(256) ^ 0x55
    segment, size = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(segment == 0, size + 8, (size + 0x108) << np.maximum(segment - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def _ima_tables() -> tuple[np.ndarray, np.ndarray]:
    index, code = np.divmod(np.arange(89 * 16), 16)
    step = STEPS[index]
    diff = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    return np.where(code & 8, -diff, diff).astype(np.int32), (np.clip(index + CHANGES[code], 0, 88) * 16).astype(np.int32)


_MU, _A = mu_law_table(), a_law_table()
_DIFF, _NEXT = _ima_tables()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """(blocks, samples) PCM of mono IMA ADPCM blocks: a 16-bit predictor, an index, one spare byte, then nibbles, low first."""
    n, size = blocks.shape
    out = np.empty((2 * (size - 4) + 1, n), np.int16)
    now = (blocks[:, 0].astype(np.int32) | (blocks[:, 1].astype(np.int32) << 8)).astype(np.uint16).view(np.int16).astype(np.int32)
    at = np.minimum(blocks[:, 2], 88).astype(np.int32) * 16
    out[0] = now
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    for i in range(size - 4):
        for k, code in ((1, codes[i] & 15), (2, codes[i] >> 4)):
            cell = at + code
            now = np.clip(now + _DIFF[cell], -32768, 32767)
            at = _NEXT[cell]
            out[2 * i + k] = now
    return out.T


def resample_double(pcm: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Twice the rate by linear interpolation within each recording; the last sample repeats."""
    after = np.append(pcm[1:], pcm[-1:]).astype(np.int32)
    last = cuts[1:] - 1
    after[last] = pcm[last]
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1::2] = (pcm.astype(np.int32) + after) >> 1
    return out


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def write_wav(data: bytes, tag: int = MU_LAW, rate: int = RATE, bits: int = 8) -> bytes:
    """A mono WAV file whose samples are the bytes as they are."""
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate * bits // 8, bits // 8, bits, 0)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, len(data) * 8 // bits) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, bytes]:
    """Format tag, rate and stored bytes; raises ValueError on anything else than a whole WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE" or struct.unpack_from("<I", media, 4)[0] != len(media) - 8:
        raise ValueError("not a whole WAV file")
    at, tag, rate = 12, None, None
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif kind == b"data":
            if tag is None or at + 8 + size > len(media):
                break
            return tag, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no format or no data")


def expand(tag: int, data: bytes) -> np.ndarray:
    """PCM of stored bytes in one of the three formats."""
    codes = np.frombuffer(data, np.uint8)
    if tag == IMA_ADPCM:
        return decode_ima(codes.reshape(-1, UNIT)).ravel()
    return {MU_LAW: _MU, A_LAW: _A}[tag][codes]


def _told(pcm: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int, int]]:
    """Peak, energy and sign changes of each recording."""
    wide = pcm.astype(np.int64)
    peak = np.maximum.reduceat(np.abs(wide), cuts[:-1])
    energy = np.add.reduceat(wide * wide, cuts[:-1])
    turn = np.zeros(len(pcm), np.int64)
    turn[1:] = (pcm[1:] < 0) != (pcm[:-1] < 0)
    turn[cuts[:-1]] = 0
    return list(zip(peak.tolist(), energy.tolist(), np.add.reduceat(turn, cuts[:-1]).tolist(), strict=True))


def media_features(payloads: list[bytes]) -> tuple[list[str], list[bytes]]:
    """A line for each payload, from its mu-law, A-law and ADPCM reading and its resampled PCM, and that PCM."""
    if not payloads:
        return [], []
    codes = np.frombuffer(b"".join(payloads), np.uint8)
    cuts = np.cumsum([0, *map(len, payloads)])
    mu = _MU[codes]
    ima = decode_ima(codes.reshape(-1, UNIT))
    double = resample_double(mu, cuts).tobytes()
    pcm = [double[4 * s : 4 * e] for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    rows = zip(_told(mu, cuts), _told(_A[codes], cuts), _told(ima.ravel(), cuts // UNIT * ima.shape[1]), pcm, strict=True)
    line = lambda name, x: f"{name}:{x[0]}:{x[1]}:{x[2]}"
    return [f"{line('mu', m)};{line('a', a)};{line('ima', i)};pcm{2 * RATE}:{zlib.crc32(p):08x}" for m, a, i, p in rows], pcm


#: Columns of the operator; media and pcm are the stored WAV files.
MEDIA = "doc_id long, n_bytes long, payload binary, media binary, feature string, pcm binary"
_DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, limit=1 << 20):
            texts = part.column(1).to_pylist()
            media = [write_wav(payload_of(t)) for t in texts]
            back = [read_wav(m)[2] for m in media]
            lines, pcm = media_features(back)
            files = [write_wav(p, PCM, 2 * RATE, 16) for p in pcm]
            size = [len((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            columns = [part.column(0), pa.array(size, pa.int64()), pa.array(back, pa.binary()), pa.array(media, pa.binary()), pa.array(lines, pa.string()), pa.array(files, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "payload", "media", "feature", "pcm"])


def stored_media(docs: DataFrame) -> DataFrame:
    """Every text stored as mu-law audio and read back, its features, and its resampled 16-bit PCM as a WAV file."""
    return text_docs(docs).mapInArrow(_stored, MEDIA)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = lambda files: pa.array([hashlib.sha256(f).hexdigest() for f in files], pa.string())
    size = lambda files: pa.array([len(f) for f in files], pa.int64())
    for b in _stored(batches):
        payload, media, pcm = (b.column(i).to_pylist() for i in (2, 3, 5))
        if any(read_wav(f)[:2] != (PCM, 2 * RATE) for f in pcm):
            raise ValueError("stored PCM does not read back")
        columns = [b.column(0), b.column(1), size(payload), digest(payload), pa.array([zlib.crc32(p[-16:]) for p in payload], pa.int64()), size(media), digest(media), b.column(4), size(pcm), digest(pcm)]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _DIGESTS.split(", ")])


def media_columns(docs: DataFrame) -> DataFrame:
    """Sizes, digests and features of ``stored_media``, taken in the worker that stores it, so that no audio leaves it."""
    return text_docs(docs).mapInArrow(_digests, _DIGESTS)


def resampled_pcm(docs: DataFrame) -> DataFrame:
    """doc_id and the resampled 16-bit PCM of each text's mu-law reading, as a WAV file."""
    return stored_media(docs).select("doc_id", "pcm")
