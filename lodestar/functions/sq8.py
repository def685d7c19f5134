"""8-bit scalar quantisation as Column expressions and in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranges below this count as this.
FLOOR = 1e-12


def _triples(values, lows, highs) -> Column:
    return F.arrays_zip(values.cast("array<double>").alias("v"), lows.cast("array<double>").alias("lo"), highs.cast("array<double>").alias("hi"))


def encode(vector: Column, lows: Column, highs: Column) -> Column:
    """Codes 0 to 255 of each entry within its dimension's range; halves round up, NaN and constant dimensions give 0."""
    step = lambda t: F.round((t["v"] - t["lo"]) / F.greatest(t["hi"] - t["lo"], F.lit(FLOOR)) * 255)
    code = lambda t: F.when(F.isnan(t["v"]), F.lit(0.0)).otherwise(F.least(F.greatest(step(t), F.lit(0.0)), F.lit(255.0)))
    return F.transform(_triples(vector, lows, highs), lambda t: code(t).cast("smallint"))


def decode(codes: Column, lows: Column, highs: Column) -> Column:
    return F.transform(_triples(codes, lows, highs), lambda t: t["lo"] + (t["hi"] - t["lo"]) / 255 * t["v"])


def adc_l2_sq(query: Column, codes: Column, lows: Column, highs: Column) -> Column:
    """Squared distance of a plain query to codes. A constant dimension adds nothing, however far the query is in it."""
    zipped = F.arrays_zip(query.cast("array<double>").alias("q"), codes.cast("array<double>").alias("v"), lows.cast("array<double>").alias("lo"), highs.cast("array<double>").alias("hi"))

    def term(t):
        alpha = (t["hi"] - t["lo"]) / 255
        d = alpha * ((t["q"] - t["lo"]) / F.greatest(alpha, F.lit(FLOOR)) - t["v"])
        return d * d

    return F.aggregate(F.transform(zipped, term), F.lit(0.0), lambda s, v: s + v)


def encode_block(x: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        r = np.floor((x - lows) / np.maximum(highs - lows, FLOOR) * 255 + 0.5)
    return np.clip(np.nan_to_num(r, nan=0.0, posinf=255.0, neginf=0.0), 0, 255).astype(np.int16)


def decode_block(codes: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    return lows + (highs - lows) / 255 * codes


def adc_block(q: np.ndarray, codes: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Distances, row by row, of queries to codes of the same shape."""
    alpha = (highs - lows) / 255
    d = alpha * ((q - lows) / np.maximum(alpha, FLOOR) - codes)
    return np.sqrt((d * d).sum(axis=1))
