"""Transformation ladders and edits of images and sounds, and image hashes, in numpy.

A ladder entry is a family and a list of steps, each an operation and its
parameters. Operations that need a codec, a font or an augmentation library are
left to providers: ``provide`` registers one under the operation's name, and
without it the step fails with a clear error.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.functions.stats import rng_for

Step = tuple[str, tuple[Any, ...]]

#: Names, families and steps of the image ladder.
IMAGE_LADDER: dict[str, tuple[str, list[Step]]] = {
    "none": ("none", []),
    "jpeg75": ("compression", [("jpeg", (75,))]), "jpeg50": ("compression", [("jpeg", (50,))]), "jpeg30": ("compression", [("jpeg", (30,))]), "webp50": ("compression", [("webp", (50,))]),
    "resize0.5": ("scale", [("resize", (0.5, 0.5))]), "resize0.25": ("scale", [("resize", (0.25, 0.25))]), "squash0.75": ("scale", [("resize", (1.0, 0.75))]),
    "crop90": ("crop", [("crop", (0.9,))]), "crop70": ("crop", [("crop", (0.7,))]), "crop50": ("crop", [("crop", (0.5,))]), "crop30": ("crop", [("crop", (0.3,))]), "crop50off": ("crop", [("crop_anywhere", (0.5,))]),
    "rot5": ("geometric", [("rotate", (5,))]), "rot15": ("geometric", [("rotate", (15,))]), "rot90": ("geometric", [("rotate", (90,))]), "hflip": ("geometric", [("hflip", ())]), "perspective": ("geometric", [("perspective", (40,))]),
    "pad25": ("geometric", [("pad", (0.25, 1.0))]), "skew": ("geometric", [("skew", (0.4,))]),
    "bright1.4": ("photometric", [("brightness", (1.4,))]), "bright0.6": ("photometric", [("brightness", (0.6,))]), "contrast0.5": ("photometric", [("contrast", (0.5,))]), "gray": ("photometric", [("gray", ())]),
    "sat2": ("photometric", [("saturation", (2.0,))]), "gamma0.6": ("photometric", [("gamma", (0.6,))]), "blur2": ("photometric", [("blur", (2.0,))]), "noise0.05": ("photometric", [("noise", (0.05,))]), "pixelize0.3": ("photometric", [("pixelize", (0.3,))]),
    "text": ("overlay", [("text", ())]), "emoji0.3": ("overlay", [("emoji", (0.3,))]), "meme": ("overlay", [("meme", ())]), "screenshot": ("overlay", [("screenshot", ())]), "background0.5": ("overlay", [("background", (0.5,))]),
    "social": ("chain", [("resize", (0.5, 0.5)), ("jpeg", (70,)), ("crop", (0.9,))]),
    "recapture": ("chain", [("perspective", (25,)), ("blur", (1.2,)), ("noise", (0.02,)), ("gamma", (0.85,)), ("jpeg", (80,))]),
}
#: Names and families of the audio and video ladders, whose steps mostly run in an external codec.
AUDIO_LADDER = {
    "none": "none", "mp3_64": "codec", "aac_64": "codec", "opus_24": "codec", "resample_8k": "codec", "noise_20db": "noise", "noise_10db": "noise", "babble_10db": "noise", "babble_0db": "noise",
    "phone": "filter", "lowpass_2k": "filter", "compressor": "filter", "reverb": "filter", "pitch+2": "time-pitch", "tempo_0.9": "time-pitch", "tempo_1.1": "time-pitch", "speed_1.05": "time-pitch",
    "excerpt10": "excerpt", "excerpt5": "excerpt", "excerpt10_mp3_noise20": "chain", "rerecord": "chain",
}
VIDEO_LADDER = {
    "none": "none", "h264_crf28": "codec", "h264_crf35": "codec", "h265_crf32": "codec", "resize0.5": "scale", "resize0.25": "scale", "crop75": "crop", "crop50": "crop", "hflip": "geometric", "rot90": "geometric", "rot5": "geometric", "letterbox": "geometric",
    "gray": "photometric", "bright": "photometric", "contrast": "photometric", "blur3": "photometric", "noise": "photometric", "text": "overlay", "logo": "overlay", "pip": "overlay", "fps15": "temporal", "speed1.25": "temporal", "excerpt2.5": "temporal", "insert": "temporal", "screenrec": "chain",
}

EXTERNAL = ("jpeg", "webp", "perspective", "text", "emoji", "meme", "screenshot", "background", "inpaint")
OPERATIONS: dict[str, Callable] = {}


def operation(f: Callable) -> Callable:
    OPERATIONS[f.__name__.removeprefix("op_")] = f
    return f


def provide(name: str, f: Callable) -> None:
    """Register ``f(image, rng, *parameters)`` as the operation ``name``, such as a codec."""
    OPERATIONS[name] = f


def apply_steps(x: np.ndarray, steps: list[Step], rng: np.random.Generator) -> np.ndarray:
    """An image of floats in [0, 1], height by width by channel, after all steps; shapes may change."""
    for name, parameters in steps:
        if name not in OPERATIONS:
            raise LookupError(f"the operation {name} needs a provider, see transforms.provide")
        x = OPERATIONS[name](x, rng, *parameters)
    return x


def _cubic(t: np.ndarray) -> np.ndarray:
    t, a = np.abs(t), -0.5
    near = ((a + 2) * t - (a + 3)) * t * t + 1
    far = (((t - 5) * t + 8) * t - 4) * a
    return np.where(t < 1, near, np.where(t < 2, far, 0.0))


def resample_matrix(n: int, m: int) -> np.ndarray:
    """Weights (m, n) of cubic resampling from n to m samples, widened when shrinking so that nothing aliases."""
    scale = max(n / m, 1.0)
    centre = (np.arange(m) + 0.5) * n / m - 0.5
    w = _cubic((np.arange(n)[None, :] - centre[:, None]) / scale)
    return w / w.sum(1, keepdims=True)


def _resized(x: np.ndarray, h: int, w: int) -> np.ndarray:
    y = np.tensordot(resample_matrix(x.shape[0], h), x, axes=(1, 0))
    return np.clip(np.moveaxis(np.tensordot(resample_matrix(x.shape[1], w), y, axes=(1, 1)), 0, 1), 0, 1)


@operation
def op_resize(x: np.ndarray, rng: np.random.Generator, sy: float, sx: float) -> np.ndarray:
    side = lambda n, s: n if s == 1.0 else max(8, round(n * s))
    return _resized(x, side(x.shape[0], sy), side(x.shape[1], sx))


def _window(x: np.ndarray, keep: float, at: Callable[[int], int]) -> np.ndarray:
    h, w = (max(1, round(n * keep)) for n in x.shape[:2])
    top, left = at(x.shape[0] - h), at(x.shape[1] - w)
    return x[top : top + h, left : left + w]


@operation
def op_crop(x: np.ndarray, rng: np.random.Generator, keep: float) -> np.ndarray:
    return _window(x, keep, lambda room: room // 2)


@operation
def op_crop_anywhere(x: np.ndarray, rng: np.random.Generator, keep: float) -> np.ndarray:
    return _window(x, keep, lambda room: int(rng.integers(0, room + 1)))


@operation
def op_rotate(x: np.ndarray, rng: np.random.Generator, degrees: float) -> np.ndarray:
    """Counter-clockwise, on a canvas that holds the whole picture, black outside; linear between pixels."""
    if degrees % 90 == 0:
        return np.rot90(x, int(degrees // 90) % 4).copy()
    a = np.deg2rad(degrees)
    c, s = np.cos(a), np.sin(a)
    h, w = x.shape[:2]
    hh, ww = int(np.ceil(abs(h * c) + abs(w * s))), int(np.ceil(abs(w * c) + abs(h * s)))
    v, u = np.mgrid[0:hh, 0:ww]
    v, u = v - (hh - 1) / 2, u - (ww - 1) / 2
    return _sample(x, s * u + c * v + (h - 1) / 2, c * u - s * v + (w - 1) / 2)


def _sample(x: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    r0, c0 = np.floor(row).astype(int), np.floor(col).astype(int)
    out = np.zeros((*row.shape, *x.shape[2:]))
    for dr in (0, 1):
        for dc in (0, 1):
            r, c = r0 + dr, c0 + dc
            weight = (1 - np.abs(row - r)) * (1 - np.abs(col - c))
            inside = (r >= 0) & (r < x.shape[0]) & (c >= 0) & (c < x.shape[1])
            part = x[np.clip(r, 0, x.shape[0] - 1), np.clip(c, 0, x.shape[1] - 1)]
            weight = np.where(inside, weight, 0.0)
            out += part * (weight[..., None] if x.ndim == 3 else weight)
    return out


@operation
def op_hflip(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return x[:, ::-1]


@operation
def op_pad(x: np.ndarray, rng: np.random.Generator, share: float, value: float) -> np.ndarray:
    py, px = (round(n * share) for n in x.shape[:2])
    return np.pad(x, ((py, py), (px, px), *[(0, 0)] * (x.ndim - 2)), constant_values=value)


@operation
def op_skew(x: np.ndarray, rng: np.random.Generator, factor: float) -> np.ndarray:
    h, w = x.shape[:2]
    v, u = np.mgrid[0:h, 0 : w + round(factor * h)].astype(float)
    return _sample(x, v, u - factor * v)


@operation
def op_brightness(x: np.ndarray, rng: np.random.Generator, k: float) -> np.ndarray:
    return np.clip(x * k, 0, 1)


@operation
def op_contrast(x: np.ndarray, rng: np.random.Generator, k: float) -> np.ndarray:
    return np.clip(_luma(x).mean() * (1 - k) + x * k, 0, 1)


def _luma(x: np.ndarray) -> np.ndarray:
    return x if x.ndim == 2 else x @ np.array([0.299, 0.587, 0.114])


@operation
def op_gray(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    return x if x.ndim == 2 else np.repeat(_luma(x)[..., None], 3, axis=2)


@operation
def op_saturation(x: np.ndarray, rng: np.random.Generator, k: float) -> np.ndarray:
    g = op_gray(x, rng)
    return np.clip(g + (x - g) * k, 0, 1)


@operation
def op_gamma(x: np.ndarray, rng: np.random.Generator, g: float) -> np.ndarray:
    return np.clip(x, 0, 1) ** g


@operation
def op_noise(x: np.ndarray, rng: np.random.Generator, sigma: float) -> np.ndarray:
    return np.clip(x + rng.normal(0, sigma, x.shape), 0, 1)


@operation
def op_blur(x: np.ndarray, rng: np.random.Generator, sigma: float) -> np.ndarray:
    k = np.arange(-int(3 * sigma + 1), int(3 * sigma + 1) + 1)
    k = np.exp(-(k**2) / (2 * sigma**2))
    k /= k.sum()
    for axis in (0, 1):
        p = np.pad(x, [(len(k) // 2,) * 2 if a == axis else (0, 0) for a in range(x.ndim)], mode="edge")
        x = sum(w * np.take(p, np.arange(i, i + x.shape[axis]), axis=axis) for i, w in enumerate(k))
    return x


@operation
def op_pixelize(x: np.ndarray, rng: np.random.Generator, ratio: float) -> np.ndarray:
    h, w = (max(1, round(n * ratio)) for n in x.shape[:2])
    small = _resized(x, h, w)
    return small[np.arange(x.shape[0]) * h // x.shape[0]][:, np.arange(x.shape[1]) * w // x.shape[1]]


def mix_at(y: np.ndarray, other: np.ndarray, snr_db: float) -> np.ndarray:
    """A sound with another one, repeated to its length, added at a signal-to-noise ratio."""
    other = np.resize(other, len(y)).astype(float)
    power = np.mean(y.astype(float) ** 2) / (np.mean(other**2) + 1e-12) / 10 ** (snr_db / 10)
    return np.clip(y + other * np.sqrt(power), -1, 1)


def excerpt(y: np.ndarray, n: int, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """``n`` samples of a sound and where they start; a shorter sound stays whole."""
    if len(y) <= n:
        return y, 0
    start = int(rng.integers(0, len(y) - n))
    return y[start : start + n], start


def excerpt_start(key: str, length: int, n: int) -> int:
    """Where the excerpt of a key's sound starts, drawn again from its generator."""
    return excerpt(np.empty(length), n, rng_for(key))[1]


def best_shift(ref: np.ndarray, out: np.ndarray, most: int = 4096) -> int:
    """The first shift below ``most`` with the largest dot product of the overlap; 0 if none fits."""
    n = min(len(ref), len(out), 32768)
    last = min(most, len(out) - n + 1)
    return int(np.argmax([float(ref[:n] @ out[s : s + n]) for s in range(last)])) if last > 0 else 0


def content_map(x: np.ndarray, side: int = 15) -> np.ndarray:
    """Pixels whose local spread, in 8-bit steps, exceeds 4 and the 40th percentile."""
    g = np.pad(_luma(x) * 255, side // 2, mode="reflect")
    box = np.lib.stride_tricks.sliding_window_view(g, (side, side))
    spread = box.std(axis=(2, 3))
    return spread > max(4.0, float(np.percentile(spread, 40)))


def blob_mask(content: np.ndarray, area: float, rng: np.random.Generator) -> np.ndarray:
    """A mask of about ``area`` of the picture: one to four ellipses around a point of the content, grown or shrunk until they fit."""
    h, w = content.shape
    ys, xs = np.nonzero(content)
    at = int(rng.integers(0, len(ys))) if len(ys) else 0
    cy, cx = (ys[at], xs[at]) if len(ys) else (h // 2, w // 2)
    n = int(rng.integers(1, 5))
    r = np.sqrt(area * h * w / n / np.pi)
    shapes = [(*(rng.uniform(0.6, 1.6, 2) * r), *rng.normal(0, 0.6 * r, 2), rng.uniform(0, np.pi)) for _ in range(n)]
    v, u = np.mgrid[0:h, 0:w]

    def drawn(scale: float) -> np.ndarray:
        m = np.zeros((h, w), bool)
        for ay, ax, oy, ox, turn in shapes:
            dy, dx = v - cy - oy * scale, u - cx - ox * scale
            a, b = dx * np.cos(turn) + dy * np.sin(turn), dy * np.cos(turn) - dx * np.sin(turn)
            m |= (a / max(1.0, ax * scale)) ** 2 + (b / max(1.0, ay * scale)) ** 2 <= 1
        return m

    lo, hi = 0.05, 8.0
    for _ in range(24):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if drawn(mid).mean() < area else (lo, mid)
    return drawn((lo + hi) / 2)


def edit(x: np.ndarray, mask: np.ndarray, kind: str, rng: np.random.Generator, donor: np.ndarray | None = None) -> np.ndarray:
    """The picture edited inside the mask: splice, copymove, recolor, box, or inpaint by a provider."""
    h, w = mask.shape
    if kind == "splice":
        new = _resized(donor, h, w) if donor is not None else rng.random(x.shape)
    elif kind == "copymove":
        new = np.roll(x, (int(rng.integers(h // 4, h // 3 + 1)), int(rng.integers(-w // 3, w // 3 + 1))), axis=(0, 1))
    elif kind == "recolor":
        new = x[..., rng.permutation([1, 2, 0])] * 0.8 + 0.1 * rng.random(x.shape[-1])
    elif kind == "box":
        ys, xs = np.nonzero(mask)
        mask = np.zeros_like(mask)
        if len(ys):
            mask[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1] = True
        new = np.broadcast_to(rng.random(x.shape[-1]), x.shape)
    else:
        new = apply_steps(x, [(kind, ())], rng)
    return np.where(mask[..., None], new, x)


def _dct_rows(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi / n * (np.arange(n) + 0.5)[None, :] * np.arange(k)[:, None])


def image_hash(x: np.ndarray, kind: str, side: int = 8) -> np.ndarray:
    """``side`` squared bits: ahash (above the mean), dhash (rising to the right), phash (low frequencies above their median), whash (Haar averages above their median), blockmean (16 by 16 means above their median)."""
    g = _luma(x)
    if kind == "dhash":
        s = _resized(g, side, side + 1)
        return (s[:, 1:] > s[:, :-1]).ravel()
    if kind == "phash":
        s = _resized(g, 4 * side, 4 * side) * 255
        low = _dct_rows(4 * side, side) @ s @ _dct_rows(4 * side, side).T
        return (low > np.median(low)).ravel()
    s = _resized(g, side if kind == "ahash" else 16 if kind == "blockmean" else 8 * side, side if kind == "ahash" else 16 if kind == "blockmean" else 8 * side)
    if kind == "whash":
        s = s.reshape(side, 8, side, 8).mean(axis=(1, 3))
        s = s - s.mean()
    return (s > (s.mean() if kind == "ahash" else np.median(s))).ravel()


def colour_moments(x: np.ndarray) -> np.ndarray:
    """Mean, spread and skew of each channel."""
    flat = x.reshape(-1, x.shape[-1])
    m, d = flat.mean(0), flat - flat.mean(0)
    return np.concatenate([m, np.sqrt((d**2).mean(0)), np.cbrt((d**3).mean(0))])


def transform_images(items: DataFrame, ladder: dict[str, tuple[str, list[Step]]], key: str, content: str, height: str, width: str) -> DataFrame:
    """(key, attack, family, height, width, content): raw 8-bit RGB images under every entry of the ladder.

    Each draws from the generator of (attack, key), so copies of one source get
    the same draw. An image of another size than height * width * 3 bytes, and a
    null one, gives null content.
    """
    entries = F.explode(F.array(*[F.struct(F.lit(a).alias("attack"), F.lit(f).alias("family")) for a, (f, _) in ladder.items()]))

    @F.pandas_udf("height int, width int, content binary")
    def run(k: pd.Series, a: pd.Series, c: pd.Series, h: pd.Series, w: pd.Series) -> pd.DataFrame:
        out = []
        for key_, attack, raw, hh, ww in zip(k, a, c, h, w, strict=True):
            if raw is None or hh * ww * 3 != len(raw):
                out.append((None, None, None))
                continue
            x = np.frombuffer(raw, np.uint8).reshape(int(hh), int(ww), 3) / 255.0
            y = apply_steps(x, ladder[attack][1], rng_for(attack, key_))
            out.append((y.shape[0], y.shape[1], np.clip(np.round(y * 255), 0, 255).astype(np.uint8).tobytes()))
        return pd.DataFrame(out, columns=["height", "width", "content"])

    e = items.withColumn("__e", entries)
    return e.select(key, F.col("__e.attack").alias("attack"), F.col("__e.family").alias("family"), run(F.col(key).cast("string"), "__e.attack", content, height, width).alias("__o")).select(key, "attack", "family", "__o.height", "__o.width", "__o.content")
