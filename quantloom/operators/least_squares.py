"""Least squares by tree QR: the rows of each partition are reduced to a triangle, and triangles to one.

A triangle has the singular values of the rows it stands for, so columns that are nearly dependent are told apart
as in the rows themselves; sums of products would square their condition.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Singular values below this share of the largest count as 0, as rounding leaves about so much of one that is 0.
NEGLIGIBLE = 1e-14
#: Triangles that meet at once.
SPREAD = 64


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of the rows, or the rows themselves if there are no more than columns."""
    return np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows


def triangles(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """by, r and n for each group and batch of rows; r: its triangle, row by row. Rows with a missing value don't count."""
    by = list(by)
    df = df.select(*by, *(F.col(c).cast("double").alias(c) for c in columns)).na.drop("any", subset=list(columns))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)

    def reduce(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            values = pdf[list(columns)].to_numpy(float)
            groups = pdf.groupby(by, sort=False, dropna=False).indices.items() if by else [((), np.arange(len(pdf)))]
            keys, held, sizes = [], [], []
            for key, at in groups:
                keys.append(key if isinstance(key, tuple) else (key,))
                held.append(triangle(values[at]).ravel())
                sizes.append(len(at))
            out = pd.DataFrame(keys, columns=by) if by else pd.DataFrame(index=range(len(held)))
            yield out.assign(r=held, n=sizes)

    return df.mapInPandas(reduce, ", ".join(filter(None, (kinds, "r array<double>, n long"))))


def joined(rs, k: int) -> np.ndarray:
    return triangle(np.concatenate([np.asarray(r, float).reshape(-1, k) for r in rs]))


def merged(parts: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """by, r and n: one triangle a group with rows, merged in two levels so that no row holds those of all partitions of a large input."""
    by = list(by)
    kinds = [f"`{c}` {parts.schema[c].dataType.simpleString()}" for c in by]

    def reduce(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(r=[joined(rs, k).ravel() for rs in pdf["rs"]])[[*by, "r", "n"]]

    def level(df: DataFrame, keys: list) -> DataFrame:
        met = df.groupBy(*keys).agg(F.collect_list("r").alias("rs"), F.sum("n").alias("n")).filter("n > 0").select(*by, "rs", "n")
        return met.mapInPandas(reduce, ", ".join([*kinds, "r array<double>", "n long"]))

    salted = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SPREAD)))
    return level(level(salted, [*by, "_salt"]), by)


def fitted(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The coefficients of least norm and the pseudo-inverse of X'X from the triangle of (X, y) with k columns of X."""
    inverse = np.linalg.pinv(r[:, :k], rcond=NEGLIGIBLE)
    return inverse @ r[:, k], inverse @ inverse.T


def least_squares(df: DataFrame, y: str, x: Sequence[str], by: Sequence[str] = (), intercept: bool = True) -> DataFrame:
    """by, alpha (with an intercept), a column for each of x, xx (the pseudo-inverse of X'X, row by row) and n for each group.

    Of several solutions that with the least norm; rows with a missing value don't count, groups without complete
    rows have no result.
    """
    by, names = list(by), [*(["alpha"] if intercept else []), *x]
    inner = [f"_x{i}" for i in range(len(x))]
    shown = df.select(*by, *([F.lit(1.0).alias("_one")] if intercept else []), *(F.col(c).alias(i) for c, i in zip(x, inner, strict=True)), F.col(y).alias("_y"))
    columns, k = [*(["_one"] if intercept else []), *inner, "_y"], len(names)
    one = merged(triangles(shown, columns, by), by, k + 1)
    kinds = [f"`{c}` {one.schema[c].dataType.simpleString()}" for c in by]

    def solve(batches):
        for pdf in batches:
            if len(pdf):
                fits = [fitted(np.asarray(r, float).reshape(-1, k + 1), k) for r in pdf["r"]]
                coefficients = pd.DataFrame(np.array([f[0] for f in fits]), columns=names, index=pdf.index)
                yield pd.concat([pdf[by], coefficients, pd.DataFrame({"xx": [f[1].ravel() for f in fits], "n": pdf["n"]})], axis=1)

    return one.mapInPandas(solve, ", ".join([*kinds, *(f"`{c}` double" for c in names), "xx array<double>", "n long"]))


def windowed(df: DataFrame, y: str, x: Sequence[str], window: int, by: Sequence[str] = ()) -> DataFrame:
    """by, date, alpha and betas at the end of each full window, from the window's own rows.

    df: framed, with by, date, y and x; a block's windows are solved together in a task.
    """
    by, names, k = list(by), ["alpha", *x], len(x) + 1

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at").reset_index(drop=True)
        keys = [*by, "date"]
        if len(pdf) < window:
            return pdf[keys][:0].assign(**{c: np.empty(0) for c in names})
        values = pdf[[y, *x]].to_numpy(float)
        good = ~np.isnan(values).any(axis=1)
        z = np.where(good[:, None], np.c_[np.ones(len(values)), values[:, 1:]], 0.0)
        rows = np.lib.stride_tricks.sliding_window_view(z, window, axis=0).swapaxes(1, 2)
        target = np.lib.stride_tricks.sliding_window_view(np.where(good, values[:, 0], 0.0), window)
        some = np.lib.stride_tricks.sliding_window_view(good, window).any(axis=1) & pdf["_own"].to_numpy()[window - 1 :]
        at, out = np.flatnonzero(some), np.empty((some.sum(), k))
        for i in range(0, len(at), 256):
            part = at[i : i + 256]
            out[i : i + 256] = (np.linalg.pinv(rows[part], rcond=NEGLIGIBLE) @ target[part][:, :, None])[:, :, 0]
        found = pdf[keys].iloc[at + window - 1].reset_index(drop=True)
        return pd.concat([found, pd.DataFrame(out, columns=names)], axis=1)

    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (*by, "date")]
    chosen = df.select(*by, "_block", "_at", "_own", "date", *(F.col(c).cast("double").alias(c) for c in (y, *x)))
    return chosen.groupBy(*by, "_block").applyInPandas(solve, ", ".join([*kinds, *(f"`{c}` double" for c in names)]))
