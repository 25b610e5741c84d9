"""Learning rates and numbers of steps as scalar expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def warmup(step: Column, steps: int, factor: float = 0.001, method: str = "linear") -> Column:
    part = step / F.lit(float(steps))
    rising = {"constant": F.lit(factor), "linear": factor * (1 - part) + part, "burnin": F.pow(part, F.lit(4.0))}[method]
    return F.when(step >= steps, F.lit(1.0)).otherwise(rising)


def linear_decay(step: Column, start: int, end: int, last_factor: float = 0.003) -> Column:
    part = (step - start) / F.lit(float(end - start))
    return F.when(step <= start, F.lit(1.0)).otherwise(last_factor * part + 1 - part)


def warmup_linear_decay(base: float, step: Column, steps: int = 10, end: int = 300, factor: float = 0.001, last_factor: float = 0.003, method: str = "linear") -> Column:
    return base * warmup(step, steps, factor, method) * linear_decay(step, steps, end, last_factor)


def cosine(base: float, step: Column, steps: int, warmup_ratio: float) -> Column:
    """Linear warm-up, then half a cosine down to 0."""
    first = int(steps * warmup_ratio)
    part = (step - first) / F.lit(float(max(1, steps - first)))
    return base * F.when(step < first, step / F.lit(float(max(1, first)))).otherwise(F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.lit(math.pi) * part))))


def constant(base: float, step: Column, steps: int, warmup_ratio: float) -> Column:
    first = int(steps * warmup_ratio)
    return base * F.when(step < first, step / F.lit(float(max(1, first)))).otherwise(F.lit(1.0))


def training_steps(examples: Column, batch: int, devices: int, accumulate: int, epochs: int) -> Column:
    return (F.ceil(examples / F.lit(float(batch * devices * accumulate))) * epochs).cast("long")
