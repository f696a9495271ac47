from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import queries, telephony


def slow_adpcm(block):
    """One block, one sample at a time."""
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.STEPS[index])
            delta = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - delta if code & 8 else value + delta))
            index = max(0, min(88, index + int(telephony.INDEX_MOVE[code])))
            out.append(value)
    return out


def test_adpcm_blocks_match_a_sample_loop():
    data = np.frombuffer(np.random.default_rng(1).bytes(72 * 9), np.uint8).reshape(9, 72)
    assert telephony.decode_adpcm(data).tolist() == [slow_adpcm(bytes(b)) for b in data]


def test_law_tables():
    mu, a = telephony.mulaw_table(), telephony.alaw_table()
    # known points of the standard: silence, smallest and largest levels
    assert (mu[0xFF], mu[0x7F], mu[0x80], mu[0x00]) == (0, 0, 32124, -32124)
    assert (a[0xD5], a[0x55], a[0xAA], a[0x2A]) == (8, -8, 32256, -32256)
    assert len(set(mu.tolist())) == 255 and len(set(a.tolist())) == 256


def test_resampling():
    x = np.array([0, 10, 20, -20], np.int16)
    assert telephony.resample(x, 8000, 16000).tolist() == [0, 5, 10, 15, 20, 0, -20, -20]
    assert telephony.resample(x, 8000, 4000).tolist() == [0, 20]
    assert telephony.resample(x[:0], 8000, 16000).tolist() == []


def test_wav_round_trip_and_damage():
    for payload in (b"", b"a", b"abcd" * 100):
        assert telephony.wav_read(telephony.wav_bytes(payload, telephony.MULAW_TAG, 8000, 8)) == telephony.Wave(7, 8000, 1, payload)
    for bad in (b"", b"RIFF", telephony.wav_bytes(b"abc", 7, 8000, 8)[:-3]):
        with pytest.raises(ValueError):
            telephony.wav_read(bad)


def check(df):
    stored = telephony.store_texts(df)
    rows = stored.select("text", "n_bytes", "media", telephony.read_back(F.col("media")).alias("r")).collect()
    for x in rows:
        raw = (x.text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert x.n_bytes == len(raw) and x.r.payload_bytes == len(payload) and len(payload) % 576 == 0
        assert x.r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert x.r.tail_crc32 == zlib.crc32(payload[-32:])
        assert x.r.media_sha256 == hashlib.sha256(x.media).hexdigest() and x.r.media_bytes == len(x.media)
        samples = telephony.mulaw_table()[np.frombuffer(payload, np.uint8)]
        adpcm = np.array([slow_adpcm(payload[k : k + 72]) for k in range(0, min(len(payload), 7200), 72)], "<i2")
        wide = samples.astype(int).tolist()
        slow = [v for k, a in enumerate(wide) for v in (a, a + (wide[min(k + 1, len(wide) - 1)] - a) // 2)]
        assert telephony.wav_read(x.r.pcm) == telephony.Wave(1, 16000, 2, np.array(slow, "<i2").tobytes())
        assert f"alaw={zlib.crc32(telephony.alaw_table()[np.frombuffer(payload, np.uint8)].astype('<i2').tobytes()):08x}" in x.r.feature
        assert f"peak={np.abs(samples.astype(int)).max()}" in x.r.feature
        if len(payload) <= 7200:
            assert x.r.feature.endswith(f"adpcm={zlib.crc32(adpcm.tobytes()):08x}")
    by_text = {}
    for x in rows:
        assert by_text.setdefault(x.text or "", x.r) == x.r


def test_documents(documents):
    check(documents)


def test_messy_rows_and_clashing_columns(messy, clashing, empty):
    check(messy)
    assert "score" in telephony.store_texts(clashing).columns
    check(clashing)
    assert telephony.store_texts(empty).select(telephony.read_back(F.col("media"))).collect() == []


def test_pcm_column(spark):
    files = [(telephony.wav_bytes(b"\xff\x80", telephony.MULAW_TAG, 8000, 8),), (b"junk",), (None,)]
    rows = spark.createDataFrame(files, "media binary").select(telephony.pcm(F.col("media")).alias("p")).collect()
    wave = telephony.wav_read(rows[0].p)
    assert (wave.tag, wave.rate) == (1, 16000) and np.frombuffer(wave.payload, "<i2").tolist() == [0, 16062, 32124, 32124]
    assert rows[1].p is None and rows[2].p is None


def test_pcm_of_a_law_and_adpcm_files(spark):
    sound = np.random.default_rng(5).bytes(72 * 3 + 10)
    files = [telephony.wav_bytes(sound, telephony.ALAW_TAG, 8000, 8), telephony.wav_bytes(sound, telephony.ADPCM_TAG, 16000, 4, 72), telephony.wav_bytes(sound, 99, 8000, 8)]
    df = spark.createDataFrame([(k, f) for k, f in enumerate(files)], "k long, media binary")
    got = {r.k: r.p for r in df.select("k", telephony.pcm(F.col("media")).alias("p")).collect()}
    a = telephony.alaw_table()[np.frombuffer(sound, np.uint8)]
    assert np.frombuffer(telephony.wav_read(got[0]).payload, "<i2")[::2].tolist() == a.tolist()
    adpcm = [v for k in range(3) for v in slow_adpcm(sound[72 * k : 72 * k + 72])]
    assert np.frombuffer(telephony.wav_read(got[1]).payload, "<i2").tolist() == adpcm and got[2] is None


def test_query_has_a_row_for_each_document(spark, sf, documents):
    made = queries.op4_telephony_audio(spark, sf)
    assert made.count() == documents.count()
    for r in made.limit(50).collect():
        assert (len(r.pcm), hashlib.sha256(r.pcm).hexdigest()) == (r.pcm_bytes, r.pcm_sha256) and telephony.wav_read(r.pcm).rate == 16000
