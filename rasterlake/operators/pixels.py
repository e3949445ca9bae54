"""Statistics of one decoded picture, and the same as DataFrame aggregates over a table of pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLOUR_CAP, TOP = 65_536, 8
_PLACES, _FIRST = np.array([65_536, 256, 1], np.uint32), np.array([True])


def analyse(pixels: np.ndarray, file_size: int) -> dict:
    """pixels: (height, width, 2 to 4 channels or 1). Entropy is of the red channel; `entropy` leaves value 0 out of the sum but not out of the
    number of pixels, `entropy_full` does not leave it out."""
    height, width, channels = pixels.shape
    alpha = pixels[..., -1] if channels in (2, 4) else None
    rgb = np.repeat(pixels[..., :1], 3, axis=2) if channels < 3 else pixels[..., :3]
    flat = np.ascontiguousarray(rgb).reshape(-1, 3)
    n = len(flat)
    packed = np.sort(flat.astype(np.uint32) @ _PLACES)
    start = np.flatnonzero(np.concatenate([_FIRST, packed[1:] != packed[:-1]]))
    colours, counts = packed[start], np.diff(start, append=n)
    top = np.lexsort((colours, -counts))[:TOP]
    reds = np.bincount(flat[:, 0], minlength=256)
    some = reds.nonzero()[0]
    share = reds[some] / n
    part = -share * np.log2(share) + 0.0  # no negative zero
    low, high = flat.min(axis=0), flat.max(axis=0)
    return {
        "decoded": True, "error": "", "width": width, "height": height, "pixel_count": n, "distinct_colors": min(len(colours), COLOUR_CAP), "distinct_colors_capped": len(colours) > COLOUR_CAP,
        "used_channel_bits": int(high.max()).bit_length(), "grayscale": bool((flat[:, 0] == flat[:, 1]).all() and (flat[:, 1] == flat[:, 2]).all()), "has_alpha": alpha is not None, "alpha_used": bool(alpha is not None and (alpha != 255).any()),
        "min_channel": low.astype(float).tolist(), "max_channel": high.astype(float).tolist(), "mean_channel": flat.mean(axis=0).tolist(), "entropy": float(part[some > 0].sum()), "entropy_full": float(part.sum()),
        "compression_ratio": file_size / (pixels.size + n), "top_colors": [{"rgb": int(colours[i]), "percent": float(counts[i] * 100 / n)} for i in top], "red_histogram": reds,
    }


def relational(pixels: DataFrame, *keys: str) -> DataFrame:
    """The same over rows (keys, r, g, b): one row for each picture, without Python."""
    rgb = F.shiftleft("r", 16).bitwiseOR(F.shiftleft("g", 8)).bitwiseOR(F.col("b"))
    worst: Column = F.greatest("r", "g", "b")
    return pixels.groupBy(*keys).agg(
        F.count("*").alias("pixel_count"), F.least(F.count_distinct(rgb), F.lit(COLOUR_CAP)).alias("distinct_colors"), F.every((F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))).alias("grayscale"),
        *(f(c).alias(f"{n}_{c}") for c in "rgb" for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))), F.max(F.when(worst > 0, F.length(F.bin(worst))).otherwise(0)).alias("used_channel_bits"),
    )
