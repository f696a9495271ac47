"""Telephony audio columns: G.711 and ADPCM decoding, resampling, WAV containers.

Mu-law and A-law bytes expand through 256-entry lookup tables, IMA ADPCM blocks
are decoded with numpy one sample position at a time across all blocks of a
batch, and PCM is resampled by linear interpolation and stored as WAV again.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import small_batches
from .frames import without

RATE = 8000
#: Payload unit in bytes; the query pads texts to a positive multiple of it.
UNIT = 576
#: Bytes of an ADPCM block: a header of 4 and two samples in each later byte.
ADPCM_BLOCK = 72
#: Payload bytes whose ADPCM blocks are decoded at once.
TOGETHER = 1 << 20
#: WAV format tags (fixed values).
PCM_TAG, ALAW_TAG, MULAW_TAG, ADPCM_TAG = 1, 6, 7, 17
#: IMA ADPCM index moves by code (fixed values).
INDEX_MOVE = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)


def mulaw_table() -> np.ndarray:
    """16-bit sample of each mu-law byte: complement, then 3-bit exponent, 4-bit mantissa, bias 132."""
    code = ~np.arange(256, dtype=np.int32) & 255
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit sample of each A-law byte: even bits inverted, sign bit set for positive."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, code & 15
    size = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 264) << np.maximum(exponent - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


#: IMA ADPCM step sizes (fixed values).
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
        130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
        1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
        8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ],
    np.int32,
)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of mono IMA blocks: ``blocks`` is (n, block bytes) uint8, the result (n, samples) int16.

    The loop runs over the sample positions of a block; each step handles all blocks.
    """
    head = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    codes = np.empty((blocks.shape[1] - 4) * 2 * len(blocks), np.uint8).reshape(-1, len(blocks))
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    grow = np.where(np.arange(16) & 8, -1, 1).astype(np.int32)
    out[0] = value = head
    for k, code in enumerate(codes):
        step = STEPS[index]
        # the standard's sum of shifted steps: an eighth, and a whole, half and quarter for bits 4, 2 and 1
        delta = (step >> 3) + step * (code >> 2 & 1) + (step >> 1) * (code >> 1 & 1) + (step >> 2) * (code & 1)
        value = np.clip(value + delta * grow[code], -32768, 32767)
        index = np.clip(index + INDEX_MOVE[code], 0, 88)
        out[k + 1] = value
    return out.T


def resample(pcm: np.ndarray, source: int, target: int) -> np.ndarray:
    """Linear interpolation from one rate to another; the last sample is held. Empty stays empty."""
    if source == target or not len(pcm):
        return pcm
    n = len(pcm) * target // source
    at = np.arange(n, dtype=np.int64) * source
    left, rest = at // target, at % target
    right = np.minimum(left + 1, len(pcm) - 1)
    a, b = pcm[left].astype(np.int64), pcm[right].astype(np.int64)
    return (a + ((b - a) * rest) // target).astype(np.int16)


@dataclass(frozen=True)
class Wave:
    """What a mono RIFF/WAVE file holds: format tag, rate, bytes of a block, payload."""

    tag: int
    rate: int
    block: int
    payload: bytes


def wav_bytes(payload: bytes, tag: int, rate: int, bits: int, block: int | None = None) -> bytes:
    """A mono RIFF/WAVE file around ``payload``; ``block`` is given for ADPCM, whose blocks hold many samples."""
    width = block or bits // 8
    samples = (width - 4) * 2 + 1 if tag == ADPCM_TAG else 1
    fmt = struct.pack("<HHIIHH", tag, 1, rate, rate * width // samples, width, bits)
    if tag == ADPCM_TAG:
        fmt += struct.pack("<HH", 2, samples)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body) + len(payload) % 2) + body + b"\0" * (len(payload) % 2)


def wav_read(media: bytes) -> Wave:
    """The contents of a RIFF/WAVE file; raises ValueError on anything else."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, head = 12, None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if at + 8 + size > len(media):
            raise ValueError("damaged WAVE file")
        if name == b"fmt " and size >= 16:
            head = struct.unpack_from("<HHIIH", media, at + 8)
        elif name == b"data":
            if head is None:
                raise ValueError("no format chunk")
            return Wave(head[0], head[2], head[4], media[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def law_tables() -> dict[int, np.ndarray]:
    return {MULAW_TAG: mulaw_table(), ALAW_TAG: alaw_table()}


def expand(wave: Wave, tables: dict[int, np.ndarray]) -> np.ndarray:
    """int16 samples of a file in mu-law, A-law, IMA ADPCM (whole blocks) or little-endian PCM; ValueError for other formats."""
    if wave.tag == PCM_TAG:
        return np.frombuffer(wave.payload[: len(wave.payload) // 2 * 2], "<i2")
    if wave.tag == ADPCM_TAG:
        if wave.block <= 4:
            raise ValueError("no samples in a block")
        return decode_together([wave.payload], wave.block)[0].reshape(-1)
    if wave.tag not in tables:
        raise ValueError(f"format {wave.tag}")
    return tables[wave.tag][np.frombuffer(wave.payload, np.uint8)]


def resampled(wave: Wave, samples: np.ndarray, target_rate: int) -> bytes:
    """A 16-bit PCM file of the samples at another rate."""
    return wav_bytes(resample(samples, wave.rate, target_rate).astype("<i2").tobytes(), PCM_TAG, target_rate, 16)


def store_texts(df: DataFrame, text: str = "text", law: str = "mulaw", unit: int = UNIT, rate: int = RATE) -> DataFrame:
    """Add ``n_bytes`` and ``media``: the text's UTF-8 bytes, padded with 255 to a positive multiple of
    ``unit``, as the samples of a mu-law or A-law WAV file. Null texts count as empty; rows are independent,
    equal texts give equal media, and columns named like the added ones are replaced."""
    small_batches(df.sparkSession)
    tag = {"mulaw": MULAW_TAG, "alaw": ALAW_TAG}[law]

    @F.arrow_udf("binary")
    def media(texts: pa.Array) -> pa.Array:
        def made(raw: bytes) -> bytes:
            padding = -len(raw) % unit if raw else unit
            return wav_bytes(raw + b"\xff" * padding, tag, rate, 8)

        return pa.array((made(x.as_py() or b"") for x in texts), pa.binary())

    plain = F.coalesce(F.col(text), F.lit(""))
    kept = without(df, {"n_bytes", "media"} - {text}).columns
    return df.select(*[F.col(f"`{c}`") for c in kept], F.octet_length(plain).cast("long").alias("n_bytes"), media(plain.cast("binary")).alias("media"))


def pcm(media: Column, target_rate: int = 16000) -> Column:
    """Resampled 16-bit PCM WAV of a G.711, ADPCM or PCM WAV column; null for null or damaged media."""
    tables = law_tables()

    @F.arrow_udf("binary")
    def decoded(files: pa.Array) -> pa.Array:
        def made(media: bytes | None) -> bytes | None:
            try:
                wave = wav_read(media or b"")
                return resampled(wave, expand(wave, tables), target_rate)
            except ValueError:
                return None

        return pa.array((made(x.as_py()) for x in files), pa.binary())

    return decoded(media)


READ_BACK = T.StructType(
    [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("pcm", T.BinaryType()),
    ]
)


def _level(samples: np.ndarray) -> str:
    wide = samples.astype(np.int64)
    rms = float(np.sqrt(np.mean(wide * wide))) if len(wide) else 0.0
    return f"rms={rms:.4f} peak={int(np.abs(wide).max(initial=0))} zc={int(np.count_nonzero(np.diff(np.signbit(samples))))}"


def sound_features(wave: Wave, samples: np.ndarray, adpcm: np.ndarray, tables: dict[int, np.ndarray]) -> str:
    """Level, peak and zero crossings of the sound, and checksums of the payload's readings by either law and as ADPCM."""
    read = [f"{name}={zlib.crc32(tables[tag][np.frombuffer(wave.payload, np.uint8)].astype('<i2').tobytes()):08x}" for name, tag in (("mulaw", MULAW_TAG), ("alaw", ALAW_TAG))]
    return " ".join([_level(samples), *read, f"adpcm={zlib.crc32(np.ascontiguousarray(adpcm, '<i2').tobytes()):08x}"])


def decode_together(payloads: list[bytes], block: int = ADPCM_BLOCK) -> list[np.ndarray]:
    """ADPCM samples of each payload, its whole blocks only; the blocks of all payloads are decoded at once."""
    counts = [len(x) // block for x in payloads]
    joined = b"".join(x[: n * block] for x, n in zip(payloads, counts, strict=True))
    sound = decode_adpcm(np.frombuffer(joined, np.uint8).reshape(-1, block))
    return np.split(sound, np.cumsum(counts)[:-1]) if counts else []


def read_back(media: Column, target_rate: int = 16000, tail: int = 32) -> Column:
    """Struct of digests, features and resampled PCM of a stored WAV column, computed from its bytes; null for null media.

    ``feature`` describes the decoded sound, ``pcm`` is a 16-bit WAV file of it at ``target_rate``; equal media give equal values.
    Damaged media raise ValueError: what this library stored must be readable.
    """
    tables = law_tables()

    @F.arrow_udf(READ_BACK)
    def digest(files: pa.Array) -> pa.Array:
        stored = [x.as_py() for x in files]
        read = [wav_read(x) if x is not None else None for x in stored]
        rows: list[dict | None] = [None] * len(read)
        group: list[int] = []
        for at in range(len(read) + 1):
            size = sum(len(read[k].payload) for k in group)
            if at == len(read) or size > TOGETHER:
                for k, adpcm in zip(group, decode_together([read[k].payload for k in group]), strict=True):
                    wave, media = read[k], stored[k]
                    samples = expand(wave, tables)
                    rows[k] = {
                        "payload_bytes": len(wave.payload),
                        "payload_sha256": hashlib.sha256(wave.payload).hexdigest(),
                        "tail_crc32": zlib.crc32(wave.payload[-tail:]),
                        "media_bytes": len(media),
                        "media_sha256": hashlib.sha256(media).hexdigest(),
                        "feature": sound_features(wave, samples, adpcm, tables),
                        "pcm": resampled(wave, samples, target_rate),
                    }
                group = []
            if at < len(read) and read[at] is not None:
                group.append(at)
        kinds = {T.StringType: pa.string(), T.LongType: pa.int64(), T.BinaryType: pa.binary()}
        return pa.array(rows, pa.struct([(f.name, kinds[type(f.dataType)]) for f in READ_BACK]))

    return digest(media)
