"""Many images at once, against the kernel that takes one after the other."""

import random

import numpy as np
import pytest
from mosaiq.codec import WebpError, alpha, batch, container, huffman, lossless, lz, riff
from mosaiq.codec.lossless import Image, Options

PLAIN = {"subtract_green": False, "predictor": False, "color_index": False, "lz77": False, "color_cache": False}
OPTIONS = [{}, {"color": True, "predictor_modes": tuple(range(14))}, PLAIN, PLAIN | {"lz77": True, "color_cache": True, "subtract_green": True}, PLAIN | {"color_cache": True}]


def pictures():
    rng = random.Random(8)
    of = lambda n, pool: b"".join(bytes(rng.choice(pool)) for _ in range(n))
    pool = [tuple(rng.randrange(256) for _ in range(4)) for _ in range(30)]
    sizes = [(1, 1), (1, 9), (9, 1), (2, 2), (3, 2), (16, 1), (16, 40), (100, 90), (17, 33), (64, 64)]
    images = [Image(bytes(4 * w * h), w, h) for w, h in sizes] + [Image(rng.randbytes(4 * w * h), w, h) for w, h in sizes] + [Image(of(w * h, pool), w, h) for w, h in sizes]
    for _ in range(60):  # as texts are
        n = rng.randrange(1, 60)
        images.append(Image((" ".join(rng.choice(["data", "of", "the", "image", "row", "x"]) for _ in range(16 * n)).encode() * 2)[: 64 * n].ljust(64 * n, b"\0"), 16, n))
    mixed = of(50, pool) * 180
    return [*images, Image(mixed, 100, 90), Image(mixed[:4000] + rng.randbytes(4000) + mixed[:4000], 50, 60)]


@pytest.mark.parametrize("on", OPTIONS)
def test_batches_equal_the_kernel(on, monkeypatch):
    images, options = pictures(), Options(**on)
    want = [lossless.encode(i, options) for i in images]
    assert batch.encode(images, options) == want
    monkeypatch.setattr(batch, "CHUNK", 3000)
    assert batch.encode(images, options) == want and batch.encode([], options) == []
    for few in (1, 40, 10**6):
        monkeypatch.setattr(batch, "FEW", few)
        got = batch.decode(want)
        assert [(i.data, i.width, i.height) for i in got] == [(i.data, i.width, i.height) for i in images]


def test_most_images_do_without_the_kernel(monkeypatch):
    images = [i for i in pictures() if len({i.data[k : k + 4] for k in range(0, len(i.data), 4)}) > 16 and min(i.width, i.height) > 1]
    files = batch.encode(images)
    monkeypatch.setattr(lossless, "encode", None)
    monkeypatch.setattr(lossless, "decode", None)
    assert batch.encode(images) == files and [i.data for i in batch.decode(files)] == [i.data for i in images]


def test_damaged_streams_read_as_the_kernel_reads_them():
    rng, files = random.Random(4), []
    for i in pictures()[10:]:
        good = bytearray(lossless.encode(i))
        for _ in range(4):
            bad = bytearray(good)
            for _ in range(rng.randrange(1, 4)):
                bad[rng.randrange(5, len(bad))] ^= 1 << rng.randrange(8)
            files.append(bytes(bad[: rng.randrange(5, len(bad) + 1)] if rng.random() < 0.3 else bad))
    for strict in (False, True):
        for data, got in zip(files, batch.decode(files, strict=strict), strict=True):
            try:
                want = lossless.decode(data, strict=strict).data
            except (WebpError, IndexError):
                want = None
            assert (None if isinstance(got, WebpError) else got.data) == want


def test_code_lengths_of_many_codes():
    rng = np.random.default_rng(3)
    rows = [rng.integers(0, 5, 40), rng.integers(0, 1000, 300), np.array([0, 7]), np.array([1, 1]), (1.6 ** np.arange(26)).astype(np.int64) + 1, np.ones(256, np.int64)]
    for limit in (9, 15):
        code, symbol = np.concatenate([np.full(np.count_nonzero(r), i) for i, r in enumerate(rows)]), np.concatenate([np.flatnonzero(r) for r in rows])
        got = batch.code_lengths(code, np.concatenate([r[r > 0] for r in rows]), limit)
        for i, r in enumerate(rows):
            assert got[code == i].tolist() == huffman.code_lengths(r, limit)[r > 0].tolist()
            lengths = np.zeros(len(r), np.int64)
            lengths[symbol[code == i]] = got[code == i]
            codes = batch.reversed_codes(batch.canonical(code, got)[code == i], got[code == i])
            assert codes.tolist() == huffman.canonical(lengths)[symbol[code == i]].tolist()


def test_matches_are_the_newest_and_the_longest():
    rng = np.random.default_rng(2)
    sizes = np.array([400, 1, 3, 900, 6000])
    argb = rng.integers(0, 3, sizes.sum()).astype(np.uint32)
    argb[1400:] = 7
    back = batch.earlier(argb, sizes)
    length, start = batch.match_lengths(argb, sizes, back), 0
    for n in sizes.tolist():
        a = argb[start : start + n]
        seen = {}
        for i in range(n):
            key = tuple(a[i : i + 3])
            want = i - seen[key] if len(key) == 3 and key in seen else 0
            assert back[start + i] == want
            if want and (n < 1000 or i % 97 == 0):
                m = 3
                while i + m < n and m < lz.MAX_LENGTH and a[i + m] == a[i + m - want]:
                    m += 1
                assert length[start + i] == m
            if len(key) == 3:
                seen[key] = i
        start += n


def test_animations():
    images = [i for i in pictures() if i.width < 100]
    place = {"x": 0, "y": 0, "duration_ms": 5}
    files = container.encode_animations([([(i, place), (i, place | {"blend": "replace"})], 100, 100, k, 0) for k, i in enumerate(images)])
    assert files == [container.encode_animation([(i, place), (i, place | {"blend": "replace"})], 100, 100, k, 0) for k, i in enumerate(images)]
    frames = [f for c in files for f in riff.parse_animation(c).frames]
    assert [i.data for i in container.decode_frames(frames)] == [i.data for i in images for _ in range(2)]


def test_alpha_planes():
    rng = np.random.default_rng(1)
    planes = [rng.integers(0, m, (h, w)).astype(np.uint8) for w, h, m in ((1, 1, 9), (16, 30, 256), (7, 9, 3), (16, 12, 90))]
    sides = [p.shape[1] for p in planes], [p.shape[0] for p in planes]
    chunks = alpha.encode_alphas([p.ravel() for p in planes], *sides)
    assert chunks == [alpha.encode_alpha(p.ravel(), *p.shape[::-1]) for p in planes]
    assert all((a == p.ravel()).all() for a, p in zip(alpha.decode_alphas(chunks, *sides), planes, strict=True))
    bad = alpha.decode_alphas([b"", b"\x03abc", b"\x01", chunks[1]], [16] * 4, [30] * 4)
    assert [isinstance(b, WebpError) for b in bad[:2]] == [True, True] and (bad[3] == planes[1].ravel()).all()
