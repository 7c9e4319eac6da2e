"""Pixel operators over vectors and small grey images, in Arrow batches or plain expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def median_bits(values: Column) -> Column:
    """64-bit hash of 64 values: bit i is set where value i exceeds the 32nd smallest."""
    cut = F.element_at(F.sort_array(values), 32)
    return _pack(F.transform(values, lambda x: (x > cut).cast("bigint")))


def gradient_bits(values: Column) -> Column:
    """64-bit hash of 64 values: bit i is set where value i exceeds its right neighbour, cyclically."""
    return _pack(F.transform(values, lambda x, i: (x > F.element_at(values, ((i + 1) % 64 + 1).cast("int"))).cast("bigint")))


def _pack(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))


def to_uint8(values: Column) -> Column:
    """Values scaled to 0..255 over their range, half to even; a constant image is 0."""
    lo, hi = F.array_min(values), F.array_max(values)
    return F.when(hi > lo, F.transform(values, lambda x: F.bround(255.0 * (x - lo) / (hi - lo)).cast("int"))).otherwise(F.transform(values, lambda x: F.lit(0)))


def _otsu(img) -> float | None:
    """The grey level that best separates those above from those up to it."""
    if img is None or len(img) == 0:
        return None
    h = np.bincount(np.asarray(img, np.int64).clip(0, 255), minlength=256).astype(float)
    w = h.cumsum()
    m = (h * np.arange(256)).cumsum()
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w - m * w[-1]) ** 2 / (w * (w[-1] - w))
    return float(np.nanargmax(np.where(np.isfinite(between), between, -1)))


@pandas_udf(T.DoubleType())
def otsu_threshold(images: pd.Series) -> pd.Series:
    """Threshold that best separates the grey levels of each image (array of 0..255), NULL for empty ones."""
    return images.map(_otsu)


def window_means(x: np.ndarray, size: int) -> np.ndarray:
    """Mean of every ``size`` x ``size`` window that lies inside an image."""
    c = np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    return (c[size:, size:] - c[:-size, size:] - c[size:, :-size] + c[:-size, :-size]) / (size * size)


def ssim_of(x: np.ndarray, y: np.ndarray, size: int = 7, span: float = 255.0) -> float:
    """Structural similarity of two grey images: the mean over all windows, with sample (co)variances.

    Images smaller than a window are compared over the largest window that fits.
    """
    size = min(size, *x.shape)
    n = size * size
    mx, my = window_means(x, size), window_means(y, size)
    scale = n / (n - 1) if n > 1 else 1.0
    vx, vy, cov = (scale * (window_means(u * w, size) - mu * mw) for u, w, mu, mw in ((x, x, mx, mx), (y, y, my, my), (x, y, mx, my)))
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return float((((2 * mx * my + c1) * (2 * cov + c2)) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean())


@pandas_udf(T.DoubleType())
def ssim(a: pd.Series, b: pd.Series, width: pd.Series) -> pd.Series:
    """Structural similarity of grey images given as arrays in rows of ``width``, NULL where they can't be compared."""

    def one(x, y, w):
        if x is None or y is None or len(x) != len(y) or len(x) == 0 or not w or len(x) % int(w):
            return None
        return ssim_of(np.asarray(x, float).reshape(-1, int(w)), np.asarray(y, float).reshape(-1, int(w)))

    return pd.Series([one(x, y, w) for x, y, w in zip(a, b, width, strict=True)])


#: Half-open bins of similarity.
SSIM_BINS = ((0.0, 0.5), (0.5, 0.8), (0.8, 0.9), (0.9, 0.95), (0.95, 1.01))


def ssim_bins(pairs: DataFrame, value: str = "ssim", distance: str = "distance") -> DataFrame:
    """(bin, n, mean_distance, share_095): matched pairs by similarity, and the share of these at 0.95 and above.

    Pairs without a similarity and those below 0 are in no bin.
    """
    v = F.col(value)
    name = F.lit(None).cast("string")
    for lo, hi in SSIM_BINS:
        name = F.when((v >= lo) & (v < hi), f"[{lo:g},{hi:g})").otherwise(name)
    all_ = Window.partitionBy()  # one row per bin
    g = pairs.where(v >= SSIM_BINS[0][0]).groupBy(name.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(distance), 6).alias("mean_distance"), F.count_if(v >= 0.95).alias("_hi"))
    return g.select("bin", "n", "mean_distance", F.round(F.sum("_hi").over(all_) / F.sum("n").over(all_), 6).alias("share_095"))


def _components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of the 4-connected parts of a mask, by passing on the largest label until nothing changes."""
    label = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    while True:
        grown = label.copy()
        grown[1:] = np.maximum(grown[1:], label[:-1])
        grown[:-1] = np.maximum(grown[:-1], label[1:])
        grown[:, 1:] = np.maximum(grown[:, 1:], label[:, :-1])
        grown[:, :-1] = np.maximum(grown[:, :-1], label[:, 1:])
        grown = np.where(mask, grown, 0)
        grown = np.where(mask, np.concatenate([[0], grown.ravel()])[grown], 0)  # the label of the labelled pixel
        if (grown == label).all():
            return label
        label = grown


def brain_mask(image: np.ndarray, least: float = 0.02) -> np.ndarray:
    """Foreground of a grey image: above Otsu's threshold, its largest part, holes filled.

    Where that covers less than ``least`` of the image, everything above zero counts.
    """
    cut = _otsu(image.ravel())
    mask = image > cut if cut is not None else image > 0
    if mask.any():
        parts = _components(mask)
        ids, sizes = np.unique(parts[parts > 0], return_counts=True)
        mask = parts == ids[sizes.argmax()]
        outside = _components(np.pad(~mask, 1, constant_values=True))
        mask = (outside != outside[0, 0])[1:-1, 1:-1]
    return mask if mask.mean() >= least else image > 0


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """An image at another size: each pixel is the mean of the pixels it covers, weighted by area."""

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.arange(m + 1) * n / m
        lo, hi = edges[:-1, None], edges[1:, None]
        at = np.arange(n)[None]
        return np.clip(np.minimum(hi, at + 1) - np.maximum(lo, at), 0, None) / (n / m)

    return weights(image.shape[0], height) @ image @ weights(image.shape[1], width).T


def variant(image: np.ndarray, mask: np.ndarray, kind: str, size: int = 64) -> np.ndarray:
    """``full``, ``brain`` (the mask's bounding box, zero outside the mask) or ``background`` (zero inside), resized."""
    if kind == "brain" and mask.any():
        rows, cols = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
        image = np.where(mask, image, 0)[rows[0] : rows[-1] + 1, cols[0] : cols[-1] + 1]
    elif kind == "background":
        image = np.where(mask, 0, image)
    return resized(image.astype(float), size, size)


def hashes_of(image: np.ndarray) -> tuple[int, int]:
    """(p, d) of a grey image: low frequencies above their median, and brightness rising to the right, as signed 64 bits."""
    small = resized(image.astype(float), 32, 32)
    wave = np.cos(np.pi / 32 * (np.arange(32)[None] + 0.5) * np.arange(8)[:, None])
    low = wave @ small @ wave.T
    across = resized(image.astype(float), 8, 9)
    pack = lambda bits: int(np.packbits(bits.ravel()).view(">i8")[0])
    return pack(low > np.median(low)), pack(across[:, 1:] > across[:, :-1])


def image_rows(spark, root: str) -> DataFrame:
    """(path, width, height, mode, p, d) of all images below a folder that can be decoded; others are left out."""
    raw = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(root)
    fields = raw.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [hashes_of(grey(d, w, h, c)) for d, w, h, c in zip(b["data"], b["width"], b["height"], b["channels"], strict=True)]
            modes = b["channels"].map({1: "L", 3: "RGB", 4: "RGBA"})
            yield pd.DataFrame({"path": b["path"], "width": b["width"], "height": b["height"], "mode": modes, "p": [p for p, _ in found], "d": [d for _, d in found]})

    return fields.mapInPandas(run, "path string, width int, height int, mode string, p bigint, d bigint")


def grey(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Brightness of decoded pixels, whose colours come as blue, green, red (and alpha)."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    return x[:, :, 0] if channels == 1 else np.floor(x[:, :, 2] * 0.299 + x[:, :, 1] * 0.587 + x[:, :, 0] * 0.114)


def occlusion_heat(image: np.ndarray, score: Callable[[np.ndarray], np.ndarray], patch: int = 32, stride: int = 16, fill: float = 0.0) -> np.ndarray:
    """How much the score of an image falls where a patch is covered, averaged over the patches that cover a pixel.

    ``score`` takes a stack of images. Patches start every ``stride`` pixels; the last ones end at the border.
    """
    h, w = image.shape
    patch = min(patch, h, w)
    at = lambda n: sorted({*range(0, n - patch + 1, stride), n - patch})
    places = [(y, x) for y in at(h) for x in at(w)]
    copies = np.repeat(image[None], len(places), 0)
    for i, (y, x) in enumerate(places):
        copies[i, y : y + patch, x : x + patch] = fill
    drops = score(image[None])[0] - score(copies)
    heat, seen = np.zeros((h, w)), np.zeros((h, w))
    for (y, x), d in zip(places, drops, strict=True):
        heat[y : y + patch, x : x + patch] += d
        seen[y : y + patch, x : x + patch] += 1
    return heat / np.maximum(seen, 1)


def occlusion_maps(df: DataFrame, item: str, image: str, width: int, score: Callable[[np.ndarray], np.ndarray], **options) -> DataFrame:
    """(item, heat): occlusion heat maps of images given as arrays in rows of ``width``; others than that have NULL."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            heats = [None if x is None or len(x) == 0 or len(x) % width else occlusion_heat(np.asarray(x, float).reshape(-1, width), score, **options).ravel() for x in b[image]]
            yield pd.DataFrame({item: b[item], "heat": pd.Series(heats, dtype=object)})

    return df.select(item, image).mapInPandas(run, f"{item} {df.schema[item].dataType.simpleString()}, heat array<double>")


def attribution_scores(heat: Column, mask: Column) -> dict[str, Column]:
    """Scores of a heat map against a 0/1 mask of equal length: the share of energy outside and in the mask, its excess
    over the mask's area and ratio to it, whether the peak hits, and the overlap with as many hottest pixels."""
    n = F.size(heat)
    total = F.aggregate(heat, F.lit(0.0), lambda a, x: a + x)
    inside = F.aggregate(F.zip_with(heat, mask, lambda h, m: h * m), F.lit(0.0), lambda a, x: a + x)
    size = F.aggregate(mask, F.lit(0), lambda a, m: a + m.cast("int"))
    top = F.try_element_at(F.sort_array(heat, asc=False), F.greatest(size, F.lit(1)))
    hot = F.transform(heat, lambda h: (h >= top).cast("int"))
    both = F.aggregate(F.zip_with(hot, mask, lambda h, m: h * m.cast("int")), F.lit(0), lambda a, x: a + x)
    union = F.aggregate(F.zip_with(hot, mask, lambda h, m: F.greatest(h, m.cast("int"))), F.lit(0), lambda a, x: a + x)
    area, energy = F.try_divide(size, n), F.try_divide(inside, total)
    return {"background_frac": 1 - energy, "excess": energy - area, "mask_area": area, "mask_energy": energy, "concentration": F.try_divide(energy, area), "pointing_hit": F.get(mask, F.array_position(heat, F.array_max(heat)).cast("int") - 1) == 1, "iou": F.try_divide(both, union)}
