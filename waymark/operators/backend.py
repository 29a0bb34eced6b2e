"""Boundary to labelling back-ends: Python objects that label batches of points.

A back-end has infer(points) with points as an array of rows (x, y, z); it returns labels, or
labels and confidences, or a dictionary of both.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class HeightBands:
    """A back-end that labels by height bands, for tests and as a pattern."""

    def infer(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = points[:, 2]
        return np.searchsorted([1.0, 2.0, 4.0], z, side="right"), np.clip(1 - np.abs(z - 2) / 10, 0, 1)


def _normal(made: Any, n: int) -> tuple[np.ndarray, np.ndarray]:
    labels, conf = (made["labels"], made.get("confidence")) if isinstance(made, dict) else made if isinstance(made, tuple) else (made, None)
    labels = np.asarray(labels)
    if len(labels) != n:
        raise ValueError(f"the back-end gave {len(labels)} labels for {n} points")
    return labels.astype(np.int32), np.ones(n) if conf is None else np.asarray(conf, float)


def label_points(df: DataFrame, backend: str, keep: list[str]) -> DataFrame:
    """keep, label and conf of points by a back-end named "module:Class", made once per task and fed Arrow batches."""

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        module, _, name = backend.partition(":")
        made = getattr(importlib.import_module(module), name)()
        for p in parts:
            labels, conf = _normal(made.infer(p[["x", "y", "z"]].to_numpy(float)), len(p))
            yield p[keep].assign(label=labels, conf=conf)

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.select(*keep, *[c for c in "xyz" if c not in keep]).mapInPandas(run, f"{kinds}, label int, conf double")
