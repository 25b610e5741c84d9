"""Arrays of numbers: soft maxima, losses, positions, normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boxframe.operators.matching import let

# What forbidden scores are set to, by use.
MASKED, FORCED = -10000.0, -1e20


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def log_softmax(logits: Column) -> Column:
    """Shifted by the largest logit, so that no exponential overflows."""
    return let(F.array_max(logits), lambda m: let(m + F.ln(total(F.transform(logits, lambda x: F.exp(x - m)))), lambda n: F.transform(logits, lambda x: x - n)))


def masked(logits: Column, forbidden: Column, value: float = MASKED) -> Column:
    return F.zip_with(logits, forbidden, lambda x, no: F.when(no, F.lit(value)).otherwise(x))


def argmax(values: Column) -> Column:
    """Place of the largest value, the first of equal ones."""
    return F.array_position(values, F.array_max(values)) - 1


def greedy(log_probs: Column, usable: int | None = None) -> Column:
    """(token, score): the best token; ``usable`` leaves out the tokens from there on."""
    known = log_probs if usable is None else F.slice(log_probs, 1, usable)
    return F.struct(argmax(known).alias("token"), F.array_max(known).alias("score"))


def top_k(values: Column, k: int) -> Column:
    """The ``k`` largest as (place, value), largest first, of equal ones the first."""
    ranked = F.sort_array(F.transform(values, lambda x, i: F.struct((-x).alias("less"), i.cast("long").alias("place"))))
    return F.transform(F.slice(ranked, 1, k), lambda r: F.struct(r["place"].alias("place"), (-r["less"]).alias("value")))


def sampled(logits: Column, seed: Column, temperature: float = 1.0, k: int | None = None) -> Column:
    """A token drawn from the ``k`` best, by the Gumbel maximum of hashed uniforms; the best one for temperature 0 or k 1."""
    if temperature == 0 or k == 1:
        return argmax(logits)
    place = top_k(logits, k) if k else F.transform(logits, lambda x, i: F.struct(i.cast("long").alias("place"), x.alias("value")))
    u = lambda i: (F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), i.cast("string"))), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    noisy = F.transform(place, lambda p: F.struct((p["value"] / temperature - F.ln(-F.ln(u(p["place"])))).alias("noisy"), p["place"].alias("place")))
    return F.array_max(noisy)["place"]


def end_length(tokens: Column, eos: int, most: int | None = None) -> Column:
    """Tokens before the first end token; 0 if there's none (or ``most``, where ends aren't said)."""
    at = F.array_position(tokens, F.lit(eos).cast("long"))
    return F.when(at > 0, at - 1).otherwise(F.lit(0 if most is None else most)).cast("long")


def nll(log_probs: Column, target: Column, ignored: list[int] | None = None) -> Column:
    """Loss of one target; null where it's ignored, so that averages leave it out."""
    loss = -F.get(log_probs, target.cast("int"))
    return F.when(target.isin(ignored), F.lit(None)).otherwise(loss) if ignored else loss


def smoothed_kl(log_probs: Column, target: Column, smoothing: float, ignore: int) -> Column:
    """Divergence from the smoothed target: s / (V - 2) everywhere, 0 at ``ignore``, 1 - s at the target; 0 for ignored targets."""
    classes = F.size(log_probs)
    low = F.lit(smoothing) / (classes - 2)
    p = lambda i: F.when(i == target, F.lit(1 - smoothing)).when(i == ignore, F.lit(0.0)).otherwise(low)
    part = F.transform(log_probs, lambda q, i: let(p(i), lambda w: F.when(w > 0, w * (F.ln(w) - q)).otherwise(F.lit(0.0))))
    return F.when(target == ignore, F.lit(0.0)).otherwise(total(part))


def sine_position(place: Column, features: int, temperature: float = 10000.0, scale: float | None = None, last: Column | None = None) -> Column:
    """``features`` numbers of a place on one axis: sine and cosine of it over rising periods."""
    at = place if scale is None else place / (last + 1e-6) * scale
    angle = lambda i: at / F.pow(F.lit(temperature), 2.0 * F.floor(i / 2) / features)
    return F.transform(F.sequence(F.lit(0), F.lit(features - 1)), lambda i: F.when(i % 2 == 0, F.sin(angle(i))).otherwise(F.cos(angle(i))))


def sinusoid(place: Column, features: int) -> Column:
    """1-D encoding of a position: e^(-(2i) ln 10000 / features) periods."""
    rate = lambda i: F.exp(-(2 * F.floor(i / 2)) * F.ln(F.lit(10000.0)) / features)
    return F.transform(F.sequence(F.lit(0), F.lit(features - 1)), lambda i: F.when(i % 2 == 0, F.sin(place * rate(i))).otherwise(F.cos(place * rate(i))))


def frozen_norm(values: Column, mean: float, variance: float, weight: float, bias: float, eps: float = 1e-5) -> Column:
    scale = weight / (variance + eps) ** 0.5
    return F.transform(values, lambda x: x * F.lit(scale) + F.lit(bias - mean * scale))


def windows(values: Column, size: int) -> Column:
    """Cut into windows of ``size``; undone by ``flatten``."""
    starts = F.sequence(F.lit(1), F.size(values), F.lit(size))
    return F.transform(starts, lambda i: F.slice(values, i, F.lit(size)))
