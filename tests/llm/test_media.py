import hashlib
import io
import wave
import zlib

import numpy as np

from folio.llm import media


def test_payloads():
    for n in (0, 1, 63, 64, 65, 128):
        out = media.payload(b"x" * n)
        assert out[:n] == b"x" * n and set(out[n:]) <= {0} and len(out) % 64 == 0 and len(out) == max(64, -(-n // 64) * 64)
        assert media.from_wav(media.to_wav(out)) == out


def test_blocks_leave_no_seams(monkeypatch):
    samples = np.random.default_rng(1).integers(0, 256, 50_000, dtype=np.uint8)
    whole = media.fingerprint(samples)
    monkeypatch.setattr(media, "BLOCK_FRAMES", 7)
    assert all((a == b).all() for a, b in zip(whole, media.fingerprint(samples)))


def test_a_tone_peaks_at_its_frequency():
    t = np.arange(4096)
    samples = (128 + 100 * np.sin(2 * np.pi * t * 32 / media.FRAME) * (t > 2000)).astype(np.uint8)
    assert 32 in media.peaks(samples)[1].tolist()


def test_rows(odd, odd_rows, nothing):
    got = {(r.doc_id, r.n_bytes, r.payload_sha256): r for r in media.media_features(odd).collect()}
    features = {}
    for row in odd_rows:
        raw = (row[1] or "").encode()
        held = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[row[0], len(raw), hashlib.sha256(held).hexdigest()]
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, media.RATE, 0, "NONE", ""))
            w.writeframes(held)
        assert (r.payload_bytes, r.tail_crc32) == (len(held), zlib.crc32(held[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(out.getvalue()), hashlib.sha256(out.getvalue()).hexdigest())
        assert features.setdefault(raw, r.feature) == r.feature
    assert media.media_features(nothing).count() == 0
    stored = media.media_column(odd).collect()
    assert len(stored) == len(odd_rows) and all(len(r.codes) == len(r.times) for r in stored)


def test_fingerprints_equal_a_loop_over_frames(odd, odd_rows):
    """Frames, peaks and pairs one at a time, the transform by numpy; features of the query from these."""
    got = {(r.doc_id, r.n_bytes): r.feature for r in media.media_features(odd).collect()}
    for row in odd_rows:
        raw = (row[1] or "").encode()
        if len(raw) > 4_000:
            continue
        held = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        samples = [b - 128 for b in held]
        m = []
        for lo in range(0, max(1, len(samples) - media.FRAME + media.HOP), media.HOP):
            frame = np.array((samples[lo : lo + media.FRAME] + [0] * media.FRAME)[: media.FRAME], np.float32)
            m.append(np.abs(np.fft.rfft(frame * np.hanning(media.FRAME).astype(np.float32))).astype(np.float32))
            m[-1][0] = 0
        tops = []
        for t, own in enumerate(m):
            for f in range(len(own)):
                left, right = own[max(0, f - media.NEAR) : f], own[f + 1 : f + 1 + media.NEAR]
                if own[f] > media.ABOVE * own.mean() and all(own[f] > left) and all(own[f] >= right) and (t == 0 or own[f] > m[t - 1][f]) and (t + 1 == len(m) or own[f] >= m[t + 1][f]):
                    tops.append((t, f))
        pairs = []
        for i, (t, f) in enumerate(tops):
            pairs += [(t, f << 16 | g << 8 | u - t) for u, g in tops[i + 1 : i + 1 + media.FAN] if u - t <= media.SPAN]
        pairs.sort()
        shape = hashlib.sha256(np.array([c for _, c in pairs], "<i4").tobytes() + np.array([t for t, _ in pairs], "<i4").tobytes()).hexdigest()
        assert got[row[0], len(raw)] == f"pairs={len(pairs)};sha256={shape}", row[0]
