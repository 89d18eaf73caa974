"""Lazily regularized AdaGrad over a DataFrame of weights (k, w, q, u); keys that are absent have the initial state."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge import functions as L


@dataclass(frozen=True)
class AdaGrad:
    """norm 2 or 1 chooses the regularizer, anything else none; initial: w, q (u is 0)."""

    eta: float = 0.1
    c: float = 1e-8
    norm: int = 2
    initial_w: float = -0.1
    initial_q: float = 1e-4

    def caught_up(self, w: Column, q: Column, u: Column, step: int) -> Column:
        """w after the regularization of the steps since u; a u ahead of step changes nothing."""
        steps = F.greatest(F.lit(step) - u, F.lit(0))
        root = F.sqrt(q)
        if self.norm == 2:
            return w * F.pow(root / (self.eta * self.c + root), steps)
        if self.norm == 1:
            return L.sign(w) * F.greatest(F.lit(0.0), F.abs(w) - self.eta * self.c * steps / root)
        return w

    def updated(self, w: Column, q: Column, g: Column) -> Column:
        """w after a step down the gradient g; q already holds g squared."""
        root = F.sqrt(q)
        if self.norm == 2:
            return (w * root - self.eta * g) / (self.eta * self.c + root)
        moved = w - self.eta * g / root
        if self.norm == 1:
            return L.sign(moved) * F.greatest(F.lit(0.0), F.abs(moved) - self.eta * self.c / root)
        return moved

    def step(self, weights: DataFrame, gradient: DataFrame, step: int) -> DataFrame:
        """Weights after one batch step with the gradient (k, g) of the loss, as joins and expressions over touched keys."""
        both = weights.join(gradient, "k", "full").select("k", "g", F.coalesce("w", F.lit(self.initial_w)).alias("w"), F.coalesce("q", F.lit(self.initial_q)).alias("q"), F.coalesce("u", F.lit(0)).alias("u"))
        touched = F.col("g").isNotNull()
        both = both.withColumn("w", F.when(touched, self.caught_up(F.col("w"), F.col("q"), F.col("u"), step)).otherwise(F.col("w")))
        both = both.withColumn("q", F.col("q") + F.coalesce(F.col("g") * F.col("g"), F.lit(0.0)))
        return both.select("k", F.when(touched, self.updated(F.col("w"), F.col("q"), F.col("g"))).otherwise(F.col("w")).alias("w"), "q", F.when(touched, F.lit(step + 1)).otherwise(F.col("u")).cast("int").alias("u"))

    def finalize(self, weights: DataFrame, step: int) -> DataFrame:
        """All weights brought up to step."""
        return weights.select("k", self.caught_up(F.col("w"), F.col("q"), F.col("u"), step).alias("w"), "q", F.greatest(F.col("u"), F.lit(step)).cast("int").alias("u"))

    def reset(self, weights: DataFrame) -> DataFrame:
        return weights.select("k", "w", F.lit(self.initial_q).alias("q"), F.lit(0).alias("u"))
