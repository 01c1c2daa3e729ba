"""Page segmentation of ordered frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_CUT, SSIM_CUT = 20, 0.7


def compared(pash: Column, ssim: Column, shape: Column, before: Column) -> tuple[Column, Column]:
    """Both measures, -1 where the frame has another shape than the one before it; null where there is none before."""
    other = F.coalesce(shape != before, F.lit(False))
    first = before.isNull()
    return F.when(other, -1).when(~first, pash), F.when(other, -1.0).when(~first, ssim)


def is_cut(pash: Column, ssim: Column, hash_cut: float = HASH_CUT, ssim_cut: float = SSIM_CUT) -> Column:
    """Whether a page ends before this frame. Frames not compared (null) or of another shape (-1, -1) never cut."""
    compared = pash.isNotNull() & ssim.isNotNull() & ~((pash == -1) & (ssim == -1))
    return F.coalesce(compared & ((pash >= hash_cut) | (ssim < ssim_cut)), F.lit(False))


def number_pages(frames: DataFrame, keys: list[str], order: list[str], cut: str = "cut") -> DataFrame:
    """``page``: 1 and the cuts so far."""
    so_far = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return frames.withColumn("page", (1 + F.sum(F.col(cut).cast("int")).over(so_far)).cast("int"))


def page_ends(numbered: DataFrame, keys: list[str], frame: str = "screenshot_id") -> DataFrame:
    return numbered.groupBy(*keys, "page").agg(F.max(frame).alias("page_end"))


def compare_frames(frames: DataFrame, keys: list[str], compare: Callable[[pd.DataFrame], pd.DataFrame], schema: str = "pash int, ssim double") -> DataFrame:
    """Each frame against the one before it. ``compare`` gets batches with path and previous_path and returns pash and ssim;
    only paths go through the shuffle, pixels are loaded in the batch that needs them."""
    before = Window.partitionBy(*keys).orderBy("screenshot_id")
    paired = frames.withColumn("previous_path", F.lag("path").over(before))
    columns = paired.schema

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = compare(pdf)
            yield pdf.assign(**{c: made[c] for c in made.columns})

    spec = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in columns] + [schema])
    return paired.mapInPandas(each, spec)


def perceptual_hash(image, size: int = 8) -> int:
    """size * size bits (64), the first lowest: low frequencies of the image's cosine transform against their median.

    Grey is luma (ITU-R 601); the image is brought to 4 * size rows and columns by averaging areas.
    """
    import numpy as np

    grey = np.asarray(image, dtype=np.float64)
    grey = grey[..., :3] @ np.array([0.299, 0.587, 0.114]) if grey.ndim == 3 else grey
    side = 4 * size

    def areas(n):
        """What each of ``side`` equal parts of n pixels takes of each pixel."""
        edges, at = np.linspace(0, n, side + 1), np.arange(n)
        share = np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at)
        return np.clip(share, 0, None) * side / n

    small = areas(grey.shape[0]) @ grey @ areas(grey.shape[1]).T
    k, n = np.arange(side)[:, None], np.arange(side)[None]
    basis = np.cos(np.pi * k * (2 * n + 1) / (2 * side))
    low = (basis @ small @ basis.T)[:size, :size]
    bits = (low > np.median(low)).ravel()
    return sum(1 << i for i, b in enumerate(bits.tolist()) if b)


def signed(bits: int) -> int:
    """64 bits as a column of longs holds them."""
    return bits - (1 << 64) if bits >> 63 else bits


def ssim(a, b, window: int = 51, span: float = 255.0) -> float:
    """Mean structural similarity over square windows, channels averaged. An image smaller than a window is an error."""
    import numpy as np

    a, b = (np.atleast_3d(np.asarray(x, dtype=np.float64)) for x in (a, b))
    w = window
    if min(a.shape[:2]) < w:
        raise ValueError(f"{a.shape[0]} x {a.shape[1]} is smaller than a window of {w}")

    def mean(x):
        s = np.pad(x, ((1, 0), (1, 0), (0, 0))).cumsum(0).cumsum(1)
        return (s[w:, w:] - s[:-w, w:] - s[w:, :-w] + s[:-w, :-w]) / (w * w)

    n = w * w / (w * w - 1)
    ma, mb = mean(a), mean(b)
    va, vb, cov = n * (mean(a * a) - ma * ma), n * (mean(b * b) - mb * mb), n * (mean(a * b) - ma * mb)
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())
