import hashlib
import zlib

import numpy as np
import pyarrow as pa

from wordloom.llm import audio


def test_contract(spark, tmp_path):
    docs = [(1, None), (2, ""), (3, "a"), (4, "x" * 64), (5, "é" * 40), (6, "long text " * 5000), (7, "long text " * 5000), (7, "a")]
    spark.createDataFrame([(i, t, "m") for i, t in docs], "doc_id long, text string, media string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = audio.op10_audio(spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    seen = {}
    for x in rows:
        own = [t for i, t in docs if i == x.doc_id and len((t or "").encode()) == x.n_bytes]
        raw = (own[0] or "").encode()
        pad = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        wav = audio.to_wav(pad)
        assert (x.media_bytes, x.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
        assert seen.setdefault(raw, x.feature) == x.feature


def slow_mels(samples):
    x = np.frombuffer(samples, np.uint8) / 128 - 1.0
    h = audio.polyphase()
    total = -(-len(x) * audio.UP // audio.DOWN)
    n = 1 + max(0, -(-(total - audio.WIN) // audio.HOP))
    y = []  # of x with zeros beyond its ends
    for k in range((n - 1) * audio.HOP + audio.WIN):
        s, phase = k * audio.DOWN // audio.UP - audio.TAPS // 2, k * audio.DOWN % audio.UP
        y.append(sum(h[phase][t] * x[s + t] for t in range(audio.TAPS) if 0 <= s + t < len(x)))
    y = np.array(y)
    out = []
    for f in range(n):
        w = y[f * audio.HOP : f * audio.HOP + audio.WIN] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(audio.WIN) / audio.WIN))
        out.append(np.log(np.abs(np.fft.rfft(w, audio.FFT)) ** 2 @ audio.mel_bank(12000) + 1e-6))
    return np.array(out)


def test_mels_against_loops(monkeypatch):
    r = np.random.default_rng(0)
    for n in (64, 448, 6400):
        s = r.integers(0, 256, n, dtype=np.uint8).tobytes()
        want = slow_mels(s)
        for at_once in (8192, 3):
            monkeypatch.setattr(audio, "FRAMES_AT_ONCE", at_once)
            got = np.concatenate(list(audio.log_mels(s)))
            assert got.shape == want.shape and np.allclose(got, want, atol=1e-3)


def test_resampling_keeps_low_tones():
    t = np.arange(4000) / audio.RATE
    y = audio.resampled(np.sin(2 * np.pi * 440 * t), 0, 2000, audio.polyphase())
    spectrum = np.abs(np.fft.rfft(y[200:1800] * np.hanning(1600)))
    assert abs(spectrum.argmax() * 12000 / 1600 - 440) < 8
    p = audio.polyphase(3, 2)
    z = audio.resampled(np.ones(400), 60, 300, p, 3, 2)
    assert np.allclose(z, 1)


def test_hysteresis():
    e = np.array([0, 0, 0, 10, 10, 4, 4, 10, 1, 4, 4, 0, 0, 10, 0, 0.0])
    assert audio.active(e) == [(3, 8), (13, 14)]
    assert audio.active(np.ones(5)) == [(0, 5)]


def test_feature_end_to_end(spark, tmp_path):
    """The query's feature string, from loops over the text's bytes."""
    text = "".join(("loud ~~~ÿÿ " if k // 40 % 2 else "aaaa ") for k in range(900))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = dict(x.split("=") for x in audio.op10_audio(spark, str(tmp_path)).first().feature.split(";"))
    mel = slow_mels(audio.payload_of(text)).astype(np.float32)
    spans = audio.active(mel.mean(1, dtype=np.float64))
    real = np.concatenate([mel[a:b] for a, b in spans]).astype(np.float64).reshape(-1, 8, audio.MELS // 8).mean(2)
    assert int(got["segments"]) == len(spans) > 1
    assert int(got["patches"]) == sum(-(-(b - a) // audio.PATCH) for a, b in spans)
    assert abs(float(got["active_s"]) - sum(b - a for a, b in spans) * audio.HOP / 12000) < 1e-3
    stats = [tuple(map(float, x.split("/"))) for x in got["bands"].split(",")]
    assert np.allclose(stats, np.stack([real.mean(0), real.std(0)], 1), atol=2e-3)
    table = audio.unpack(audio.pack(mel, spans, at_once=2))
    values = np.concatenate([c.to_numpy_ndarray() for c in table["patch"].chunks])
    assert values.shape == (int(got["patches"]), audio.PATCH, audio.MELS) and np.array_equal(values[0][: spans[0][1] - spans[0][0]], mel[spans[0][0] : spans[0][0] + audio.PATCH][: spans[0][1] - spans[0][0]])


def test_tensors(spark):
    docs = spark.createDataFrame([(1, "ab" * 40000), (2, None)], "doc_id long, text string")
    table = audio.tensors(audio.encode(docs)).toArrow()
    t = audio.as_tensors(table)
    assert t.type.shape == [audio.PATCH, audio.MELS] and len(t) == table.num_rows > 1
    assert all(0 <= a < b for a, b in zip(table["start_s"].to_pylist(), table["end_s"].to_pylist(), strict=True))
    assert isinstance(t, pa.FixedShapeTensorArray)
    assert audio.tensors(audio.encode(docs.limit(0))).count() == 0
    rows = {r.doc_id: r for r in audio.stored(docs.withColumn("media", docs.doc_id)).collect()}
    assert bytes(rows[1].media) == audio.to_wav(b"ab" * 40000) and audio.unpack(bytes(rows[1].tensors)).num_rows > 0 and rows[2].n_bytes == 0
