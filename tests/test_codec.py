"""Codec kernels: exact round trips, size bounds, headers, damaged input."""

import itertools
import math
import random

import numpy as np
import pytest

from mosaiq.codec import WebpError, alpha, container, huffman, lossless, lossy, riff
from mosaiq.codec import transforms as tf
from mosaiq.codec.bits import BitReader, pack


def image(fill, w, h):
    return lossless.Image(bytes(int(v) % 256 for y in range(h) for x in range(w) for v in fill(x, y)), w, h)


def photo(w, h):
    wave = lambda x, y, b: max(0, min(255, b + 60 * math.sin(0.1 * x) + 40 * math.cos(0.13 * y)))
    return image(lambda x, y: (wave(x, y, 100), wave(x, y, 110), wave(x, y, 105), 255), w, h)


IMAGES = {
    "one_px": image(lambda x, y: (42, 84, 168, 200), 1, 1),
    "zeros": image(lambda x, y: (0, 0, 0, 0), 2, 2),
    "solid": image(lambda x, y: (200, 100, 50, 255), 4, 4),
    "gradient": image(lambda x, y: (32 * x, 32 * y, 128, 255), 8, 8),
    "distinct": image(lambda x, y: (37 * (16 * y + x), 73 * (16 * y + x), 113 * (16 * y + x), 255), 16, 16),
    "alpha": image(lambda x, y: (8 * x, 8 * y, 128, 50 + (x + y) % 200), 32, 32),
    "wide": image(lambda x, y: (3 * x, 5 * y, x * y, 255), 100, 10),
    "tall": image(lambda x, y: (3 * x, 5 * y, x * y, 255), 10, 100),
    "row": image(lambda x, y: (x, 128, 200, 255), 256, 1),
    "overlap": image(lambda x, y: (255, 0, 0, 255) if x % 2 else (0, 0, 255, 255), 8, 1),
    "palette": image(lambda x, y: ((17 * x + 13 * y) % 8 * 30, (17 * x + 13 * y) % 8, 9, 255), 48, 48),
    "noise": lossless.Image(np.random.default_rng(0).integers(0, 256, 4 * 97 * 51, dtype=np.uint8).tobytes(), 97, 51),
    "photo": photo(60, 56),
}


@pytest.mark.parametrize("name", IMAGES)
def test_lossless_round_trip(name):
    source = IMAGES[name]
    for sg, pr, co, ci, lz, cc in itertools.product((False, True), repeat=6):
        o = lossless.Options(subtract_green=sg, predictor=pr, color=co, color_index=ci, lz77=lz, color_cache=cc, predictor_modes=(11,) if sg else tuple(range(14)))
        assert lossless.decode(lossless.encode(source, o), strict=True).data == source.data


def test_sizes():
    off = {"subtract_green": False, "predictor": False, "color_index": False, "lz77": False, "color_cache": False}
    size = lambda i, **on: len(lossless.encode(i, lossless.Options(**off | on)))
    motif = image(lambda x, y: ((60, 70, 80, 255), (1, 2, 3, 255), (9, 200, 3, 255), (90, 9, 99, 255))[x % 16 // 4], 64, 64)
    related = image(lambda x, y: ((7 * x + 11 * y + 5), 7 * x + 11 * y, 7 * x + 11 * y + 251, 255), 32, 32)
    assert size(motif, lz77=True) < size(motif) / 2
    assert size(related, subtract_green=True) < size(related)
    assert size(IMAGES["palette"], color_cache=True, cache_bits=4) < size(IMAGES["palette"])
    smooth, p = image(lambda x, y: (4 * x, 4 * y, 128, 255), 64, 64), photo(96, 96)
    assert size(smooth, predictor=True) < size(smooth) / 3
    assert len(lossless.encode(p)) < size(p) / 2
    assert size(IMAGES["palette"], color_index=True) < 0.6 * size(IMAGES["palette"])


def test_far_match():
    rng = np.random.default_rng(1)
    rows = rng.integers(0, 256, (600, 600, 4), dtype=np.uint8)
    rows[-10:] = rows[:10]
    i = lossless.Image(rows.tobytes(), 600, 600)
    assert lossless.decode(lossless.encode(i, lossless.Options(predictor=False))).data == i.data


def test_alpha_flag_follows_pixels():
    assert riff.image_info(riff.parse_riff(container.encode(IMAGES["alpha"]))).has_alpha
    assert not riff.image_info(riff.parse_riff(container.encode(IMAGES["solid"]))).has_alpha
    extended = riff.image_info(riff.parse_riff(container.encode(IMAGES["alpha"], extended=True)))
    assert (extended.width, extended.height, extended.has_alpha, extended.is_extended) == (32, 32, True, True)


def test_containers():
    for parts in ([b"12345"], [b"abc"], [b"1", b"22", b"4444"]):
        content = riff.build_riff([(f"CH{i:02d}", d) for i, d in enumerate(parts)])
        found = riff.parse_riff(content)
        assert [bytes(c.data) for c in found] == parts and [c.size for c in found] == list(map(len, parts))
        assert all(content[c.offset : c.offset + c.size] == bytes(c.data) for c in found)
        assert int.from_bytes(content[4:8], "little") == len(content) - 8
    cut = b"RIFF\x10\0\0\0WEBPVP8L\xff\xff\xff\xff1234"
    assert [(c.size, bytes(c.data)) for c in riff.parse_riff(cut)] == [(0xFFFFFFFF, b"1234")]
    for bad in (b"", b"RIFF", b"RIFX\0\0\0\0WEBP", b"RIFF\0\0\0\0WAVE"):
        with pytest.raises(WebpError):
            riff.parse_riff(bad)


def test_lossy_header():
    head = b"\x10\0\0\x9d\x01\x2a\x40\0\x30\0"
    info = riff.vp8_info(head)
    assert (info.width, info.height, info.is_lossless) == (64, 48, False)
    for bad in (head[:9], b"\x11" + head[1:], head[:3] + bytes(3) + head[6:]):
        with pytest.raises(WebpError):
            riff.vp8_info(bad)


def test_animation():
    frames = [(IMAGES["alpha"], {"x": 2, "y": 4, "duration_ms": 100}), (IMAGES["solid"], {"x": 0, "y": 0, "duration_ms": 7, "blend": "replace", "dispose": "background"})]
    found = riff.parse_animation(container.encode_animation(frames, 40, 40, 3, 0x11223344))
    assert (found.width, found.height, found.loop_count, found.background_argb) == (40, 40, 3, 0x11223344)
    assert [(f.x, f.y, f.duration_ms, f.blend, f.dispose) for f in found.frames] == [(2, 4, 100, "overlay", "none"), (0, 0, 7, "replace", "background")]
    assert [container.decode_frame(f).data for f in found.frames] == [i.data for i, _ in frames]
    with pytest.raises(WebpError):
        riff.parse_animation(container.encode(IMAGES["solid"]))


def plain_unfilter(plane, kind, w, h):
    out = [0] * (w * h)
    for i, v in enumerate(plane):
        x, y = i % w, i // w
        left = out[i - 1] if x else 0
        top = out[i - w] if y else 0
        p = 0
        if kind and y == 0:
            p = left
        elif kind == 1:
            p = left if x else top
        elif kind == 2:
            p = top
        elif kind == 3:
            p = max(0, min(255, left + top - out[i - w - 1])) if x else top
        out[i] = (v + p) % 256
    return out


def test_alpha_filters():
    rng = np.random.default_rng(2)
    for w, h in ((1, 1), (7, 5), (1, 9), (30, 4)):
        plane = rng.integers(0, 256, w * h).astype(np.uint8)
        for kind in range(4):
            assert alpha.unfilter(plane, kind, w, h).tolist() == plain_unfilter(plane.tolist(), kind, w, h)
        assert alpha.decode_alpha(alpha.encode_alpha(plane, w, h), w, h).tolist() == plane.tolist()
    for bad in (b"", b"\x40", b"\0abc", b"\2"):
        with pytest.raises(WebpError):
            alpha.decode_alpha(bad, 5, 5)


def test_prefix_codes():
    rng = random.Random(4)
    for _ in range(60):
        counts = np.array([rng.choice([0, 1, 2, 1000, 2**rng.randint(0, 30)]) for _ in range(rng.randint(1, 280))])
        lengths = huffman.code_lengths(counts)
        assert lengths.max(initial=0) <= 15 and ((lengths > 0) == (counts > 0)).all()
        out = huffman.BitWriter()
        huffman.write_code(out, lengths)
        table = huffman.read_code(BitReader(out.bytes()), len(counts))
        used = np.flatnonzero(lengths).tolist()
        codes = huffman.canonical(lengths)
        if len(used) > 1:
            some = [rng.choice(used) for _ in range(50)]
            bits = BitReader(pack(codes[some], lengths[some]))
            assert [table.read(bits) for _ in some] == some
    for bad in ([1, 1, 1], [2, 2], []):
        with pytest.raises(WebpError):
            huffman.Table(np.array(bad, np.int64))


def test_color_transform_inverse():
    source = tf.from_rgba(IMAGES["photo"].data)
    done, elements = tf.color_forward(source, 60, 56, 3)
    assert (tf.color_inverse(done, elements, 60, 56, 3) == source).all()


def test_arithmetic_coder():
    rng = random.Random(1)
    for n in (0, 1, 7, 500):
        ps = [rng.choice([1, 50, 128, 200, 255]) for _ in range(n)]
        bits = [int(rng.random() * 256 >= p) for p in ps]
        out = lossy.BoolEncoder()
        for b, p in zip(bits, ps, strict=True):
            out.put(b, p)
        out.signed(-5, 4)
        out.literal(77, 7)
        back = lossy.BoolDecoder(out.finish())
        assert [back.get(p) for p in ps] == bits and back.signed(4) == -5 and back.literal(7) == 77


def test_block_transforms():
    rng = np.random.default_rng(0)
    blocks = rng.integers(-255, 256, (200, 4, 4))
    assert np.abs(lossy.inverse_dct(lossy.forward_dct(blocks)) - blocks).max() <= 2  # half a unit a coefficient, and the inverse's own rounding
    dc = rng.integers(-4000, 4000, (200, 4, 4))
    assert np.abs(lossy.inverse_wht(lossy.forward_wht(dc)) - dc).max() <= 2
    assert np.abs(lossy.forward_dct(np.zeros((4, 4)))).max() <= 1  # rounding alone


def test_colour_planes():
    grey = np.full((9, 5, 4), 128, np.uint8)
    y, u, v = lossy.rgb_to_yuv(grey)
    assert y.shape == (16, 16) and u.shape == (8, 8) and set(u.ravel()) == {128} == set(v.ravel())
    back = lossy.yuv_to_rgb(y[:9, :5], lossy.upsample(u, 5, 9), lossy.upsample(v, 5, 9))
    assert np.abs(back.astype(int) - 128).max() <= 2
    assert [container.quality_index(q) for q in (0, 10, 40, 75, 80, 95, 100)] == [127, 114, 76, 32, 25, 6, 0]


def test_damaged_input_raises_or_returns():
    rng = random.Random(9)
    good = container.encode(IMAGES["photo"])
    cases = [bytes(rng.randrange(256) for _ in range(256)) for _ in range(200)]
    cases += [riff.build_riff([("VP8L", b"\x2f" + bytes([rng.randrange(256), rng.randrange(2), 0, rng.randrange(32)]) + bytes(rng.randrange(256) for _ in range(60)))]) for _ in range(100)]
    for _ in range(100):
        broken = bytearray(good)
        broken[rng.randrange(25, len(good))] ^= 1 << rng.randrange(8)
        cases.append(bytes(broken[: rng.choice([len(good), rng.randrange(20, len(good))])]))
    for c in cases:
        try:
            container.decode(c, max_pixels=1 << 16)
        except WebpError:
            pass
    with pytest.raises(WebpError):
        container.decode(riff.build_riff([("VP8L", b"\x2f\xff\xff\xff\x0f")]), max_pixels=1000)
    with pytest.raises(WebpError):
        lossless.encode(lossless.Image(b"", 0, 1))
