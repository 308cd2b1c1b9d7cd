"""Distributed randomised SVD of a sparse row matrix."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

_SUMS = "part int, total array<double>"


def _sum_rows(rows: DataFrame, f: Callable[[pd.DataFrame], np.ndarray], height: int) -> np.ndarray:
    """Sum over all rows of the matrix ``f(batch)``; partial sums meet by row of the result."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                m = f(pdf)
                total = m if total is None else total + m
        if total is not None:
            yield pd.DataFrame({"part": np.arange(height, dtype=np.int32), "total": list(total)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": pdf["part"].iloc[:1].to_numpy(), "total": [np.sum(np.stack(list(pdf["total"])), axis=0)]})

    out = rows.mapInPandas(partial, _SUMS).groupBy("part").applyInPandas(add, _SUMS).toPandas().sort_values("part")
    return np.stack(list(out["total"])) if len(out) else np.zeros((height, 0))


def _product(pdf: pd.DataFrame, right: np.ndarray) -> np.ndarray:
    out = np.zeros((len(pdf), right.shape[1]))
    for i, (terms, weights) in enumerate(zip(pdf["terms"], pdf["weights"])):
        out[i] = np.asarray(weights) @ right[np.asarray(terms, np.int64)]
    return out


def randomized_svd(rows: DataFrame, n_terms: int, rank: int, *, oversample: int = 16, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors (n_terms x k) and singular values of ``rows(terms array<int>, weights array<double>)``.

    Range finder with a Gaussian sketch, orthonormalised through the Cholesky factor of its Gram
    matrix.  Rows stay where they are: what is gathered are sums of the sketch's width by the number
    of terms, never anything per row.
    """
    width = min(n_terms, rank + oversample)
    omega = np.random.default_rng(seed).standard_normal((n_terms, width))

    def gram(pdf: pd.DataFrame) -> np.ndarray:
        y = _product(pdf, omega)
        return y.T @ y

    g = _sum_rows(rows, gram, width)
    values, vectors = np.linalg.eigh(g)
    sound = values > values.max() * 1e-10
    whiten = omega @ (vectors[:, sound] / np.sqrt(values[sound]))  # A @ whiten has orthonormal columns

    def project(pdf: pd.DataFrame) -> np.ndarray:
        q = _product(pdf, whiten)
        out = np.zeros((q.shape[1], n_terms))
        for qi, terms, weights in zip(q, pdf["terms"], pdf["weights"]):
            out[:, np.asarray(terms, np.int64)] += np.outer(qi, weights)
        return out

    b = _sum_rows(rows, project, whiten.shape[1])
    values, vectors = np.linalg.eigh(b @ b.T)
    order = np.argsort(values)[::-1][:rank]
    order = order[values[order] > values.max() * 1e-10]
    singular = np.sqrt(values[order])
    return (b.T @ vectors[:, order]) / singular, singular
