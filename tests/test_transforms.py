import numpy as np
import pytest

from veriloom.functions.stats import rng_for
from veriloom.operators import transforms as t


def picture(h=96, w=128, seed=0):
    rng = np.random.default_rng(seed)
    base = t._resized(rng.random((8, 8, 3)), h, w)
    return np.clip(base, 0, 1)


@pytest.mark.parametrize("name", [n for n, (_, steps) in t.IMAGE_LADDER.items() if all(s in t.OPERATIONS for s, _ in steps)])
def test_ladder_entries_run(name):
    y = t.apply_steps(picture(), t.IMAGE_LADDER[name][1], rng_for(name))
    assert y.ndim == 3 and y.min() >= -1e-9 and y.max() <= 1 + 1e-9


def test_ladders_have_the_known_sizes_and_shapes():
    assert (len(t.IMAGE_LADDER), len(t.AUDIO_LADDER), len(t.VIDEO_LADDER)) == (36, 21, 25)
    x = picture()
    assert t.apply_steps(x, [("crop", (0.5,))], None).shape == (48, 64, 3) and t.apply_steps(x, [("resize", (0.5, 0.5))], None).shape == (48, 64, 3)
    assert t.apply_steps(x, [("rotate", (90,))], None).shape == (128, 96, 3) and t.apply_steps(x, [("pad", (0.25, 1.0))], None).shape == (144, 192, 3)


def test_missing_provider_and_provided_codec():
    with pytest.raises(LookupError, match="jpeg"):
        t.apply_steps(picture(), [("jpeg", (75,))], None)
    t.provide("webp", lambda x, rng, q: x * q / 100)
    assert np.allclose(t.apply_steps(picture(), [("webp", (50,))], None), picture() / 2)
    del t.OPERATIONS["webp"]


@pytest.mark.parametrize("kind", ["ahash", "dhash", "phash", "whash", "blockmean"])
def test_hashes_repeat_survive_scaling_and_separate(kind):
    a = t.image_hash(picture(), kind)
    assert (a == t.image_hash(picture(), kind)).all()
    assert (a == t.image_hash(t.apply_steps(picture(), [("resize", (0.5, 0.5))], None), kind)).mean() > 0.9
    assert (a == t.image_hash(picture(seed=1), kind)).mean() < 0.8


def test_colour_moments():
    m = t.colour_moments(np.ones((4, 4, 3)) * 0.5)
    assert m[:3] == pytest.approx([0.5] * 3) and m[3:] == pytest.approx([0] * 6, abs=1e-6)


@pytest.mark.parametrize("area", [0.01, 0.03, 0.1, 0.25])
def test_blob_area(area):
    m = t.blob_mask(np.ones((400, 600), bool), area, rng_for("blob", area))
    assert abs(m.mean() - area) <= 0.35 * area


@pytest.mark.parametrize("kind", ["splice", "copymove", "recolor", "box"])
def test_edits_stay_inside_the_mask(kind):
    x, rng = np.random.default_rng(3).random((200, 300, 3)), rng_for(kind)
    m = t.blob_mask(t.content_map(x), 0.05, rng)
    y = t.edit(x, m, kind, rng)
    ys, xs = np.nonzero(m)
    box = np.zeros_like(m)
    box[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] = True
    assert np.abs(y - x)[~(box if kind == "box" else m)].max() == 0 and np.abs(y - x)[m].mean() > 0.02


def test_sounds():
    rng = np.random.default_rng(0)
    y = rng.normal(0, 0.1, 5000)
    noisy = t.mix_at(y, rng.normal(size=3000), 10)
    assert 10 * np.log10((y**2).mean() / ((noisy - y) ** 2).mean()) == pytest.approx(10, abs=0.2)
    part, start = t.excerpt(y, 1000, rng_for("k"))
    assert (part == y[start : start + 1000]).all() and start == t.excerpt_start("k", 5000, 1000)
    assert t.best_shift(y[:2000], np.concatenate([np.zeros(37), y])) == 37 and t.excerpt(y[:10], 100, rng)[1] == 0


def test_images_in_spark(spark):
    x = (picture(16, 16) * 255).astype(np.uint8)
    df = spark.createDataFrame([("a", bytearray(x.tobytes()), 16, 16), ("b", None, 16, 16), ("c", bytearray(b"xx"), 16, 16)], "k string, c binary, h int, w int")
    ladder = {n: t.IMAGE_LADDER[n] for n in ("none", "crop50", "noise0.05")}
    got = {(r.k, r.attack): r for r in t.transform_images(df, ladder, "k", "c", "h", "w").collect()}
    assert len(got) == 9 and got["a", "none"].content == x.tobytes() and (got["a", "crop50"].height, got["a", "crop50"].width) == (8, 8)
    assert got["b", "none"].content is None and got["c", "none"].content is None
    again = {(r.k, r.attack): r.content for r in t.transform_images(df, ladder, "k", "c", "h", "w").collect()}
    assert again["a", "noise0.05"] == got["a", "noise0.05"].content
