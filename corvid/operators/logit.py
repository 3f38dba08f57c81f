"""Degree-2 polynomial logistic regression.

``fit_poly_logit`` uses Spark ML (L-BFGS, gradients aggregated on executors);
``certified_fit`` takes Newton steps until it can bound the distance from the optimum.  Scoring
with known coefficients is a plain column expression, so it runs inside
whole-stage codegen and can be written in SQL as well."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel, cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.operators.encode import poly2_terms
from corvid.session import materialize

# executors need numpy and pyarrow, not this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def fit_poly_logit(train: DataFrame, feature_cols: Sequence[str], label_col: str, C: float = 1e-5,
                   degree: int = 2, max_iter: int = 100, tol: float = 1e-6,
                   rows_per_partition: int = 2_000_000) -> PipelineModel:
    """L2-L4: polynomial expansion + L2-penalised logistic regression with a
    free intercept and no feature scaling.  ``C`` is the inverse penalty on the
    summed loss, so Spark's mean-loss ``regParam`` is ``1 / (C * n)``.  The
    constant polynomial term is left out: next to the free intercept its
    penalised weight is 0 at the optimum.

    The numeric columns are computed and stored once, at the input's full
    parallelism.  Every optimiser step is one pass over them, so the stored rows
    are then read by tasks of about ``rows_per_partition`` rows: many tiny
    partitions would only add overhead to each step."""
    data = materialize(train.select(*feature_cols, F.col(label_col).cast("double").alias(label_col)))
    n = data.count()
    data = data.coalesce(max(1, -(-n // rows_per_partition)))
    # the optimiser reads the rows once per step: keep them (spills to disk when large)
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    assembler = VectorAssembler(inputCols=list(feature_cols), outputCol="_raw", handleInvalid="keep")
    poly = PolynomialExpansion(degree=degree, inputCol="_raw", outputCol="_poly")
    lr = LogisticRegression(featuresCol="_poly", labelCol=label_col, regParam=1.0 / (C * n),
                            elasticNetParam=0.0, standardization=False, fitIntercept=True,
                            maxIter=max_iter, tol=tol)
    try:
        return Pipeline(stages=[assembler, poly, lr]).fit(data)
    finally:
        data.unpersist()


def predict_proba(model: PipelineModel, df: DataFrame, prob_col: str = "p", pred_col: str = "prediction") -> DataFrame:
    """Class-1 probability and the hard prediction (cut 0.5)."""
    out = model.transform(df)
    out = out.withColumn(prob_col, vector_to_array(F.col("probability"))[1])
    keep = [c for c in df.columns] + [prob_col, pred_col]
    return out.select(*keep)


def linear_terms(feature_cols: Sequence[str | Column], degree: int = 2) -> list[Column]:
    """The feature terms in the order the coefficients use (no bias)."""
    if degree == 1:
        return [F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in feature_cols]
    return [c for _, c in poly2_terms(feature_cols, include_bias=False)]


def logistic_score(feature_cols: Sequence[str | Column], intercept: float, coefs: Sequence[float],
                   degree: int = 2) -> Column:
    """L6 with given coefficients: sigmoid(intercept + sum coef_i * term_i),
    terms summed left to right."""
    terms = linear_terms(feature_cols, degree)
    if len(terms) != len(coefs):
        raise ValueError(f"{len(terms)} terms but {len(coefs)} coefficients")
    z = F.lit(float(intercept))
    for t, w in zip(terms, coefs):
        z = z + F.lit(float(w)) * t
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def coefficients(model: PipelineModel) -> tuple[float, list[float]]:
    lr = model.stages[-1]
    return float(lr.intercept), [float(x) for x in lr.coefficients.toArray()]


def spark_poly2_order(n: int) -> list[tuple[int, ...]]:
    """Monomials of Spark's degree-2 ``PolynomialExpansion`` in output order:
    for each input j, x_j followed by x_i * x_j for i <= j."""
    out: list[tuple[int, ...]] = []
    for j in range(n):
        out.append((j,))
        out += [(i, j) for i in range(j + 1)]
    return out


def conventional_coefficients(model: PipelineModel, n_features: int) -> tuple[float, list[float]]:
    """The fitted degree-2 model's (intercept, coefficients) in the order of
    ``linear_terms`` / ``logistic_score`` (inputs, then x_i * x_j, i <= j), so
    a trained model can be applied as a plain column expression."""
    b0, w = coefficients(model)
    by_term = dict(zip(spark_poly2_order(n_features), w))
    order = [(j,) for j in range(n_features)] + [(i, j) for i in range(n_features) for j in range(i, n_features)]
    return b0, [by_term[t] for t in order]


def penalised_gradient(df: DataFrame, feature_cols: Sequence[str], label_col: str, intercept: float,
                       coefs: Sequence[float], C: float, degree: int = 2) -> DataFrame:
    """(term, gradient): the gradient of the penalised summed loss at given
    coefficients, one row per term; all 0 at the optimum (the intercept is free).
    One aggregate over the rows, independent of the optimiser."""
    names = ["intercept"] + ([n for n, _ in poly2_terms(feature_cols, include_bias=False)] if degree == 2 else list(feature_cols))
    terms = [F.lit(1.0), *linear_terms(feature_cols, degree)]
    miss = logistic_score(feature_cols, intercept, coefs, degree) - F.col(label_col).cast("double")
    sums = df.agg(*[F.sum(miss * t).alias(f"g{i}") for i, t in enumerate(terms)])
    penalty = [0.0, *(float(w) / C for w in coefs)]
    rows = F.array(*[F.struct(F.lit(n).alias("term"), (F.col(f"g{i}") + F.lit(penalty[i])).alias("gradient")) for i, n in enumerate(names)])
    return sums.select(F.inline(rows))


@dataclass(frozen=True)
class CertifiedFit:
    """Coefficients in the order of ``linear_terms``, and what is known about the optimum: its distance
    from them is at most ``radius`` in the norm of the Hessian, whose inverse is ``inverse`` (intercept first)."""

    intercept: float
    coefs: list[float]
    degree: int
    radius: float
    inverse: np.ndarray
    steps: int

    def error(self, feature_cols: Sequence[str | Column]) -> Column:
        """Largest possible distance of a row's probability from that of the optimum (the sigmoid rises by 1/4 at most)."""
        terms = [F.lit(1.0), *linear_terms(feature_cols, self.degree)]
        return F.lit(self.radius / 4) * F.sqrt(_square_norm(terms, self.inverse))

    def probability(self, feature_cols: Sequence[str | Column], within: float = 1e-8) -> Column:
        """Probability of class 1, known to ``within``; a row for which that is not guaranteed is an error,
        a missing feature gives NULL."""
        p = logistic_score(feature_cols, self.intercept, self.coefs, self.degree)
        err = self.error(feature_cols)
        return F.when(err > within, F.raise_error(F.lit(f"probability not known to {within}")).cast("double")).otherwise(p)


def _square_norm(terms: Sequence[Column], m: np.ndarray) -> Column:
    """x' M x for the row of terms x."""
    total = F.lit(0.0)
    for i, t in enumerate(terms):
        inner = F.lit(float(m[i, i])) * t
        for j in range(i + 1, len(terms)):
            inner = inner + F.lit(2.0 * float(m[i, j])) * terms[j]
        total = total + t * inner
    return F.greatest(total, F.lit(0.0))


def certified_fit(train: DataFrame, feature_cols: Sequence[str], label_col: str, C: float = 1e-5, degree: int = 2,
                  tol: float = 1e-9, most_steps: int = 100, rows_per_partition: int = 2_000_000) -> CertifiedFit:
    """L2-L4 with a proof: the model of ``fit_poly_logit``, and a bound on its distance from the exact optimum.

    The terms are computed and stored once.  A step is two passes over them, which send a few sums a task:
    gradient g and Hessian H of the penalised summed loss, then the largest norm R of a row under H^-1.  With
    v = |g| under H^-1, the third derivative of the logistic loss (at most its second) keeps the Hessian within
    exp(+-R t) over a distance t, hence the optimum within -ln(1 - R v) / R where R v < 1.  The fit ends when that
    fixes the log-odds of all training rows to ``tol``; until then it takes Newton steps, shortened to
    ln(1 + R v) / (R v) so that the loss falls from any start.

    Rows with a missing feature or label take no part.  No rows, or an optimum that does not exist (one class
    only), are a ValueError."""
    terms = linear_terms(feature_cols, degree)
    m = len(terms) + 1
    rows = materialize(train.select(*[t.alias(f"x{i}") for i, t in enumerate(terms, 1)], F.col(label_col).cast("double").alias("y")).dropna())
    n = rows.count()
    if n == 0:
        raise ValueError("no complete training rows")
    rows = rows.coalesce(max(1, -(-n // rows_per_partition)))
    theta, penalty = np.zeros(m), np.array([0.0] + [1.0 / C] * (m - 1))
    for step in range(most_steps):
        g, h = _gradient_and_hessian(rows, theta)
        g, h = g + penalty * theta, h + np.diag(penalty)
        if not np.all(np.isfinite(h)) or np.any(np.diag(h) <= 0):
            break
        scale = 1 / np.sqrt(np.diag(h))  # unit diagonal: terms of very different size
        inverse = np.linalg.inv(h * np.outer(scale, scale)) * np.outer(scale, scale)
        v = math.sqrt(max(float(g @ inverse @ g), 0.0))
        largest = math.sqrt(_largest_norm(rows, inverse))
        rv = largest * v
        if rv < 1 and -math.log1p(-rv) <= tol:
            return CertifiedFit(float(theta[0]), [float(w) for w in theta[1:]], degree, -math.log1p(-rv) / largest, inverse, step)
        theta = theta - min(1.0, math.log1p(rv) / rv) * (inverse @ g)
    raise ValueError(f"no optimum certified within {most_steps} steps: it may not exist (one class only)")


def _matrix(batch) -> np.ndarray:
    """Rows of terms of an Arrow batch (x1, x2, ..., y), the intercept's 1 first."""
    columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns - 1)]
    return np.column_stack([np.ones(batch.num_rows), *columns])


def _gradient_and_hessian(rows: DataFrame, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the unpenalised summed loss.  A task sends one number for each entry; they are added up in Spark."""
    m = len(theta)

    def sums(batches):
        import pyarrow as pa

        total = np.zeros(m + m * m)
        for b in batches:
            x, y = _matrix(b), b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            with np.errstate(over="ignore"):
                p = 1 / (1 + np.exp(-(x @ theta)))
            total[:m] += x.T @ (p - y)
            total[m:] += ((x * (p * (1 - p))[:, None]).T @ x).ravel()
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(m + m * m), pa.int32()), "v": pa.array(total)})

    out = np.zeros(m + m * m)
    for r in rows.mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out[:m], out[m:].reshape(m, m)


def _largest_norm(rows: DataFrame, inverse: np.ndarray) -> float:
    """Largest x' M x of all rows, one number from each task."""
    def top(batches):
        import pyarrow as pa

        best = 0.0
        for b in batches:
            if b.num_rows:
                x = _matrix(b)
                best = max(best, float(((x @ inverse) * x).sum(axis=1).max()))
        yield pa.RecordBatch.from_pydict({"v": pa.array([best])})

    return rows.mapInArrow(top, "v double").agg(F.max("v")).first()[0]
