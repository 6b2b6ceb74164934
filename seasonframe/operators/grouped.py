"""Many modelling problems in one job: ridge per key, tuned and fitted without a loop over keys.

Tasks add up cross products per key and fold, whatever the number of keys; a key's folds are a
handful of small matrices, on which tuning and fitting are algebra. No key's rows are gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .moments import MATRIX_BYTES, Moments, quoted, ridge_cv_error, ridge_fit
from .splits import contiguous_folds


def grouped_moments(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str,
                    group: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(keys, grp, val): the upper half of the cross products of (1, z, label) per key and group;
    and the center and scale that make features z. Rows with a null feature or label are left out;
    a null key is a key like any other."""
    keys, features, d = list(keys), list(features), len(features)
    if 8 * (d + 2) ** 2 > MATRIX_BYTES:
        raise ValueError(f"{d} features: the cross products take over {MATRIX_BYTES} bytes")
    rows = df.select(*quoted(keys), F.col(group).cast("int").alias("grp"), *(
        F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(quoted([*features, label])))
    ).na.drop(subset=[f"x{i}" for i in range(d + 1)])
    stats = rows.agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(d)],
                     *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(d)], F.lit(1)).first()
    center = np.array([stats[f"m{i}"] or 0.0 for i in range(d)])
    scale = np.array([stats[f"s{i}"] or 1.0 for i in range(d)])
    upper = np.triu_indices(d + 2)

    def products(batches):
        for pdf in batches:  # a batch's sums at a time, so that no task holds all keys
            x = pdf[[f"x{i}" for i in range(d + 1)]].to_numpy(float)
            z = np.column_stack([np.ones(len(x)), (x[:, :d] - center) / scale, x[:, d]])
            out = []
            for key, at in pdf.groupby([*keys, "grp"], dropna=False).indices.items():
                block = z[at]
                out.append((*(None if v != v else v for v in key), (block.T @ block)[upper]))
            yield pd.DataFrame(out, columns=[*keys, "grp", "val"])

    kinds = ", ".join(f"`{k}` {t}" for k, t in rows.select(*quoted(keys)).dtypes)
    summed = rows.mapInPandas(products, f"{kinds}, grp int, val array<double>").groupBy(
        *quoted(keys), "grp").agg(Summarizer.sum(array_to_vector("val")).alias("val"))
    return summed.withColumn("val", vector_to_array("val")), center, scale


def grouped_ridge(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str,
                  alphas: Sequence[float], k: int = 5, order=("IDREGION", "FYEAR")) -> DataFrame:
    """(keys, ALPHA, CV_ERROR, INTERCEPT, WEIGHTS, N): ridge on standardised features for each key.

    The penalty with the least mean squared error over k contiguous folds of the key's rows (the
    first of equals), then a fit on all of them. Folds that would leave nothing to train on or to
    validate are left out; with none left the first penalty is taken and CV_ERROR is null. A key
    without a row that has all values has no line.
    """
    keys, features = list(keys), list(features)
    known = df.na.drop(subset=[*features, label])
    sums, center, scale = grouped_moments(
        contiguous_folds(known, k, order, keys), keys, features, label, "FOLD")
    upper = np.triu_indices(len(features) + 2)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        groups = {}
        for grp, val in zip(pdf["grp"], pdf["val"]):
            matrix = np.zeros((len(features) + 2,) * 2)
            matrix[upper] = val
            matrix.T[upper] = matrix[upper]
            groups[int(grp)] = matrix
        moments = Moments(tuple(features), center, scale, groups)
        folds = [(tuple(g for g in groups if g != j), (j,)) for j in sorted(groups)]
        folds = [f for f in folds if f[0]]
        errors = [ridge_cv_error(moments, a, folds, [features] * len(folds)) if folds else np.nan
                  for a in alphas]
        best = int(np.nanargmin(errors)) if folds else 0
        line = ridge_fit(moments, alphas[best])
        out = pdf[keys].head(1).copy()
        out["ALPHA"], out["CV_ERROR"] = float(alphas[best]), errors[best]
        out["INTERCEPT"], out["WEIGHTS"] = line.intercept, [list(line.weights)]
        out["N"] = int(round(moments.total()[0, 0]))
        return out

    kinds = ", ".join(f"`{c}` {t}" for c, t in sums.select(*quoted(keys)).dtypes)
    return sums.groupBy(*quoted(keys)).applyInPandas(
        solve, f"{kinds}, ALPHA double, CV_ERROR double, INTERCEPT double, "
               "WEIGHTS array<double>, N long")


def with_lines(df: DataFrame, lines: DataFrame, keys: Sequence[str], features: Sequence[str],
               output: str = "YIELD_PRED") -> DataFrame:
    """df with ALPHA and the prediction of its key's line; null where there is no line or value."""
    keys = list(keys)
    own = lines.select(*(F.col(f"`{c}`").alias(f"_line{i}") for i, c in enumerate(keys)), "ALPHA",
                       "INTERCEPT", "WEIGHTS")
    same = F.lit(True)
    for i, c in enumerate(quoted(keys)):
        same = same & F.col(c).eqNullSafe(F.col(f"_line{i}"))
    value = F.col("INTERCEPT")
    for i, c in enumerate(quoted(features)):
        value = value + F.col("WEIGHTS")[i] * F.col(c)
    return df.join(own, same, "left").select(*quoted(df.columns), "ALPHA", value.alias(output))
