"""Frame quality: the gate's rules, the score, and measurements of decoded images."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

# Bounds of the gate.
BLUR, MAYBE_BLUR, ML_BLUR, GLARE, MAYBE_GLARE, ML_GLARE, AREA = 70.0, 140.0, 0.90, 0.08, 0.03, 0.95, 0.10
# What full marks take, and the weights of sharpness, glare and presence.
SHARP, PRESENT, MARKS = 350.0, 0.45, (0.45, 0.30, 0.25)


def reason(lap: Column, glare: Column, area: Column, card_like: Column, ml_blurry: Column, ml_glare: Column) -> Column:
    """Why a frame is turned away, by the first rule that fits; null if it passes. A frame without measurements is empty."""
    return (
        F.when(lap.isNull() | glare.isNull() | area.isNull(), "empty")
        .when(lap < BLUR, "blurry")
        .when((ml_blurry > ML_BLUR) & (lap < MAYBE_BLUR), "probably blurry")
        .when(glare > GLARE, "glare")
        .when((ml_glare > ML_GLARE) & (glare > MAYBE_GLARE), "probably glare")
        .when((area < AREA) & ~F.coalesce(card_like, F.lit(False)), "no card")
    )


def score(lap: Column, glare: Column, area: Column, card_like: Column) -> Column:
    """Marks from 0 to 100 of a frame that passes, of two digits."""
    sharp, clear = F.least(lap / SHARP, F.lit(1.0)), F.greatest(F.lit(0.0), 1 - glare / GLARE)
    present = F.when(card_like, 1.0).otherwise(F.least(area / PRESENT, F.lit(1.0)))
    return F.floor(100 * (sharp * MARKS[0] + clear * MARKS[1] + present * MARKS[2]) * 100 + 0.5) / F.lit(100.0)


def gate(frames: DataFrame) -> DataFrame:
    """The frames with ``reason`` and ``quality`` (0 where turned away)."""
    r = reason(*map(F.col, ("lap", "glare", "area", "card_like", "ml_blurry", "ml_glare")))
    return frames.withColumn("reason", r).withColumn("quality", F.when(F.col("reason").isNull(), score(*map(F.col, ("lap", "glare", "area", "card_like")))).otherwise(0.0))


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in ("laplacian", "glare", "aspect")]))
def image_metrics(pixels: pd.Series, height: pd.Series, width: pd.Series, channels: pd.Series) -> pd.DataFrame:
    """Variance of the Laplacian, share of pixels over 250, and short by long side, of images in Spark's layout (rows of BGR)."""
    out = []
    for data, h, w, c in zip(pixels, height, width, channels):
        if h <= 0 or w <= 0 or not data:
            out.append((None, None, None))
            continue
        image = np.frombuffer(data, np.uint8).reshape(h, w, c).astype(np.float64)
        grey = image[..., 0] if c == 1 else np.round(image[..., :3] @ np.array([0.114, 0.587, 0.299]))
        wide = np.pad(grey, 1, mode="reflect") if min(h, w) > 1 else np.pad(grey, 1, mode="edge")
        edges = wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * grey
        out.append((float(edges.var()), float((grey > 250).mean()), min(h, w) / max(h, w)))
    return pd.DataFrame(out, columns=["laplacian", "glare", "aspect"])
