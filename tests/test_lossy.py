"""The lossy stream under tables made by a rule: bounded errors, and the decoder's parts against plain forms."""

import json
import random

import numpy as np
import pytest

from mosaiq.codec import WebpError, container, lossless, riff
from mosaiq.codec import lossy as k
from mosaiq.codec import lossy_stream as ls
from mosaiq.codec.alpha import encode_alpha


def tables():
    rng = np.random.default_rng(5)
    steps = np.minimum(4 + np.arange(128) + np.arange(128) ** 2 // 200, 157)
    return ls.Tables(rng.integers(1, 256, (4, 8, 3, 11)), rng.integers(200, 256, (4, 8, 3, 11)), rng.integers(1, 256, (10, 10, 9)), steps, steps + steps // 2)


def image(fill, w, h):
    return lossless.Image(bytes(int(v) % 256 for y in range(h) for x in range(w) for v in (*fill(x, y), 255)), w, h)


IMAGES = [image(lambda x, y: (128, 128, 128), 16, 16), image(lambda x, y: (8 * x % 256, 128, 200), 32, 32), image(lambda x, y: (10 * x, 15 * y % 256, 100), 25, 17), image(lambda x, y: (200, 40, 40), 19, 33), image(lambda x, y: (7 * x % 256, 7 * y % 256, 3 * (x + y) % 256), 48, 48)]


@pytest.mark.parametrize("i", range(len(IMAGES)))
def test_round_trip_error(i):
    source = np.frombuffer(IMAGES[i].data, np.uint8).reshape(-1, 4).astype(int)
    errors = []
    for q in (0, 40, 127):
        back = ls.decode(ls.encode(IMAGES[i], q, tables()), tables())
        assert (back.width, back.height) == (IMAGES[i].width, IMAGES[i].height)
        got = np.frombuffer(back.data, np.uint8).reshape(-1, 4).astype(int)
        assert (got[:, 3] == 255).all()
        errors.append(np.abs(got - source)[:, :3].mean())
    assert errors[0] < (3 if i in (0, 3) else 30) and errors[0] <= errors[2] + 1


def test_luma_is_close_at_best_quality():
    y, _, _ = k.rgb_to_yuv(np.frombuffer(IMAGES[4].data, np.uint8).reshape(48, 48, 4))
    back = ls.decode(ls.encode(IMAGES[4], 0, tables()), tables())
    y2, _, _ = k.rgb_to_yuv(np.frombuffer(back.data, np.uint8).reshape(48, 48, 4))
    assert np.abs(y.astype(int) - y2).mean() < 6


def test_container_with_alpha(tmp_path):
    t = tables()
    (tmp_path / "t.json").write_text(json.dumps({n: getattr(t, n).tolist() for n in ("coefficients", "updates", "sub_modes", "dc", "ac")}))
    alpha = np.arange(25 * 17, dtype=np.uint8)
    content = container.encode_lossy(lossless.Image(np.concatenate([np.frombuffer(IMAGES[2].data, np.uint8).reshape(-1, 4)[:, :3], alpha[:, None]], axis=1).tobytes(), 25, 17), 90, str(tmp_path / "t.json"))
    assert [c.four_cc for c in riff.parse_riff(content)] == ["VP8X", "ALPH", "VP8 "]
    back = container.decode(content, tables=str(tmp_path / "t.json"))
    assert np.frombuffer(back.data, np.uint8)[3::4].tolist() == alpha.tolist()
    opaque = container.encode_lossy(IMAGES[2], 90, str(tmp_path / "t.json"))
    assert [c.four_cc for c in riff.parse_riff(opaque)] == ["VP8 "]
    with pytest.raises(WebpError):
        container.decode(opaque)
    assert encode_alpha(alpha, 25, 17)[0] == 1


def test_header_partitions_and_damage():
    t, good = tables(), ls.encode(IMAGES[1], 20, tables())
    h, _, rest = ls.read_header(good, t)
    assert (h.width, h.height, h.q, h.partitions, h.level) == (32, 32, 20, 1, 0) and rest < len(good)
    rng = random.Random(3)
    for _ in range(40):
        broken = bytearray(good)
        broken[rng.randrange(len(good))] ^= 1 << rng.randrange(8)
        try:
            i = ls.decode(bytes(broken[: rng.choice([len(good), rng.randrange(len(good))])]), t) if broken[6:10] == good[6:10] else None
            assert i is None or len(i.data) == 4 * i.width * i.height
        except WebpError:
            pass


def test_sub_predictions():
    flat = np.full(13, 77)
    for mode in ls.SUB_MODES:
        assert (ls.predict_sub(flat, mode) == 77).all()
    ramp = np.arange(13) * 4
    assert (ls.SUB_WEIGHTS["ld"].sum(axis=1) == 4).all()
    rd = ls.predict_sub(ramp, "rd")
    assert (np.diag(rd) == ramp[4]).all() and rd[0, 3] == ramp[7] and rd[3, 0] == ramp[1]
    assert (ls.predict_sub(ramp, "ve")[2] == ramp[5:9]).all()


def test_edge_filter():
    step = np.tile(np.array([100, 100, 100, 100, 110, 110, 110, 110]), (16, 1))
    for outer, simple in ((True, False), (False, False), (True, True)):
        done = step.copy()
        ls.filter_edge(done, 63, 20, 1, outer, simple)
        assert (np.abs(np.diff(done, axis=1)).max() < 10) and (done[:, [0, 7]] == step[:, [0, 7]]).all()
    steep = np.tile(np.array([0, 0, 0, 0, 255, 255, 255, 255]), (4, 1))
    done = steep.copy()
    ls.filter_edge(done, 63, 20, 1, True, False)
    assert (done == steep).all()
    assert k.filter_strength(0, 3) == (0, 0, 0) and k.filter_strength(63, 0) == (189, 63, 2) and k.filter_strength(20, 5) == (44, 4, 1)
