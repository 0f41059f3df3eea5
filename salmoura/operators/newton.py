"""Weighted logistic regressions by Newton steps, many of them at once.

A step of every problem is one aggregation over the rows: each row takes part in the problems whose left-out fold is not its
own, and adds to the loss, the gradient and the curvature of each. With d features these are (d + 1)(d + 4) / 2 + 1 sums a
problem, so partial sums are a few rows a task however many rows there are. The equations are solved on the driver.

The loss is the weighted log loss plus half the squared length of the weights; features are standardised logarithms, the
intercept is free. A step that does not lower the loss is halved.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from salmoura import names as N

STEPS = 60
CLOSE = 1e-9  # a step this small is the last: what it leaves is its square


@dataclass(frozen=True)
class Problem:
    """One regression: its features with (mean, deviation) of their logarithms, rows per class, and the fold left out."""

    features: tuple[str, ...]
    moments: tuple[tuple[float, float], ...]
    counts: tuple[int, int]
    left_out: int | None = None

    def weight(self, label: int) -> float:
        return sum(self.counts) / (2.0 * self.counts[label])


def _sums(data: DataFrame, problems: dict[int, Problem], at: dict[int, np.ndarray], every: Sequence[str]) -> dict[int, dict]:
    """Loss, gradient and curvature of each problem at its weights, by one pass over ``data``."""
    def asked(q: int, p: Problem) -> Column:
        where = {f: i for i, f in enumerate(p.features)}
        parts = [F.lit(q).alias("q"), F.lit(p.left_out).cast("int").alias("out"), F.lit(float(at[q][-1])).alias("b"),
                 F.lit(p.weight(0)).alias("w0"), F.lit(p.weight(1)).alias("w1")]
        for i, f in enumerate(every):  # a feature that is not the problem's counts as 0
            mean, deviation = p.moments[where[f]] if f in where else (0.0, float("inf"))
            weight = float(at[q][where[f]]) if f in where else 0.0
            parts += [F.lit(float(mean)).alias(f"m{i}"), F.lit(float(deviation)).alias(f"s{i}"), F.lit(weight).alias(f"c{i}")]
        return F.struct(*parts)

    fold = F.col("FOLD").cast("int") if "FOLD" in data.columns else F.lit(None).cast("int")
    rows = data.select(
        F.col(N.TARGET).cast("double").alias("y"), fold.alias("fold"),
        *[F.log10(N.col(f)).alias(f"x{i}") for i, f in enumerate(every)],
        F.explode(F.array(*[asked(q, p) for q, p in problems.items()])).alias("p"),
    ).filter(F.col("p.out").isNull() | (F.col("fold") != F.col("p.out")))
    z = rows.select(
        "y", "p", *[((F.col(f"x{i}") - F.col(f"p.m{i}")) / F.col(f"p.s{i}")).alias(f"z{i}") for i in range(len(every))]
    )
    margin = reduce(lambda a, i: a + F.col(f"p.c{i}") * F.col(f"z{i}"), range(len(every)), F.col("p.b"))
    scored = z.withColumn("t", margin).select(
        F.col("p.q").alias("q"), "y", "t", F.when(F.col("y") == 1, F.col("p.w1")).otherwise(F.col("p.w0")).alias("w"),
        (1 / (1 + F.exp(-F.col("t")))).alias("p"), *[f"z{i}" for i in range(len(every))],
    )
    y, t, w, p = (F.col(c) for c in ("y", "t", "w", "p"))
    factors = [*[F.col(f"z{i}") for i in range(len(every))], F.lit(1.0)]
    loss = w * (F.log1p(F.exp(-F.abs(t))) + F.greatest(t, F.lit(0.0)) - y * t)
    size = len(factors)
    found = scored.groupBy("q").agg(
        F.sum(loss).alias("loss"), *[F.sum(w * (p - y) * factors[i]).alias(f"g{i}") for i in range(size)],
        *[F.sum(w * p * (1 - p) * factors[i] * factors[j]).alias(f"h{i}_{j}") for i in range(size) for j in range(i, size)],
    ).collect()  # a row a problem
    return {r["q"]: r.asDict() for r in found}


def solve(data: DataFrame, problems: Sequence[Problem]) -> list[tuple[tuple[float, ...], float]]:
    """(weights, intercept) of each problem. ``data`` has the class, the features (above zero) and, where a problem leaves out
    a fold, ``FOLD``; it is read once a step."""
    every = sorted({f for p in problems for f in p.features})
    left = dict(enumerate(problems))
    at = {q: np.zeros(len(p.features) + 1) for q, p in left.items()}
    best: dict[int, tuple[float, np.ndarray, np.ndarray]] = {}  # loss, weights, step from there
    done: dict[int, np.ndarray] = {}
    for _ in range(STEPS):
        sums = _sums(data, left, at, every)
        for q, p in list(left.items()):
            where = [every.index(f) for f in p.features] + [len(every)]
            ridge = np.diag([1.0] * len(p.features) + [0.0])
            row, b = sums[q], at[q]
            loss = row["loss"] + b @ ridge @ b / 2
            if q in best and not loss <= best[q][0] * (1 + 1e-12):
                before, start, step = best[q]
                best[q] = (before, start, step / 2)
                if np.abs(step).max() < CLOSE:  # no lower place within the numbers' precision
                    done[q] = start
                    del left[q]
                else:
                    at[q] = start - step / 2
                continue
            curvature = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in where] for i in where]) + ridge
            step = np.linalg.solve(curvature, np.array([row[f"g{i}"] for i in where]) + ridge @ b)
            best[q] = (loss, b, step)
            at[q] = b - step
            if np.abs(step).max() < CLOSE * (1 + np.abs(b).max()):
                done[q] = at[q]
                del left[q]
        if not left:
            return [(tuple(map(float, done[q][:-1])), float(done[q][-1])) for q in range(len(problems))]
    raise ValueError(f"no minimum after {STEPS} Newton steps")
