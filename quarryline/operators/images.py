"""Images as arrays of numbers: resizing by area or between pixels, and the range of a model's input."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def area_weights(n: int, m: int):
    """Matrix of m rows that average n pixels, each pixel by the part of it that a new one covers."""
    import numpy as np

    edge = np.arange(m + 1) * n / m
    cell = np.arange(n)
    cover = np.minimum(edge[1:, None], cell + 1) - np.maximum(edge[:-1, None], cell)
    return np.clip(cover, 0, None) * m / n


def linear_weights(n: int, m: int):
    """Matrix of m rows that mix the two pixels next to each new centre."""
    import numpy as np

    centre = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
    low = np.floor(centre).astype(int)
    high = np.minimum(low + 1, n - 1)
    out = np.zeros((m, n))
    np.add.at(out, (np.arange(m), low), 1 - (centre - low))
    np.add.at(out, (np.arange(m), high), centre - low)
    return out


def resized(df: DataFrame, row: str, pixels: str, width: int, height: int, to: tuple[int, int], how: str = "area") -> DataFrame:
    """``row, pixels`` of grey images of one size, resized to (width, height); an array of another length gives null."""
    if how not in ("area", "linear"):
        raise ValueError("how is area or linear")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        make = area_weights if how == "area" else linear_weights
        across, down = make(width, to[0]), make(height, to[1])
        for pdf in batches:
            out = []
            for values in pdf["pixels"]:
                fits = values is not None and len(values) == width * height
                out.append((down @ np.asarray(values, float).reshape(height, width) @ across.T).ravel() if fits else None)
            yield pd.DataFrame({"row": pdf["row"], "pixels": out})

    return df.select(F.col(row).alias("row"), F.col(pixels).cast("array<double>").alias("pixels")).mapInPandas(run, "row long, pixels array<double>")


def model_range(pixels: Column) -> Column:
    """Bytes from 0 to 255 as numbers from -1 to 1, rounded half up to whole bytes first."""
    return F.transform(pixels, lambda v: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor(v + 0.5).cast("double"))) / 127.5 - 1.0)
