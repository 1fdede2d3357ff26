"""Probability vectors and one-hot labels held in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import col, let

CE_FLOOR = 1e-20


def to_categorical(c: Column | str, k: int) -> Column:
    """Class id to one-hot array of length ``k``."""
    c = col(c)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda x: (x == c).cast("float"))


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def scaled(v: Column) -> Column:
    """The vector divided by its sum."""
    return let(v, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def softmax(logits: Column | str) -> Column:
    shifted = let(col(logits), lambda z: let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top))))
    return scaled(shifted)


def log_sum_exp(logits: Column | str) -> Column:
    z = col(logits)
    return let(F.array_max(z), lambda top: top + F.log(total(F.transform(z, lambda x: F.exp(x - top)))))


def vector_loss(onehot: Column | str, logits: Column | str, kind: str, reduction: str = "mean") -> Column:
    """Cross-entropy (``ce``), total variation (``l1``) or Brier loss of softmax(logits) against a one-hot target."""
    onehot, logits = col(onehot), col(logits)
    if kind == "ce":
        parts = let(log_sum_exp(logits), lambda lse: F.zip_with(onehot, logits, lambda t, x: t.cast("double") * (lse - x)))
    elif kind == "l1":
        parts = F.zip_with(onehot, softmax(logits), lambda t, x: F.abs(x - t))
    elif kind == "brier":
        parts = F.zip_with(onehot, softmax(logits), lambda t, x: (x - t) * (x - t))
    else:
        raise ValueError("vector_loss kind must be 'ce', 'l1' or 'brier'")
    if reduction == "none":
        return parts
    return total(parts) / F.size(logits) if reduction == "mean" else total(parts)


def entropy(p: Column | str) -> Column:
    """Entropy in nats of a non-negative vector after scaling it to sum 1; ``0 ln 0`` is 0."""
    parts = F.transform(scaled(col(p)), lambda x: F.when(x > 0, -x * F.log(x)).otherwise(F.lit(0.0)))
    return total(parts)


def argmax(v: Column | str) -> Column:
    """0-based position of the first maximum."""
    v = col(v)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def brier(y: Column | str, p: Column | str) -> Column:
    """Squared distance between the vector and the one-hot class ``y``."""
    y, p = col(y), col(p)
    return total(F.transform(p, lambda x, i: F.pow((i == y).cast("double") - x, F.lit(2.0))))


def cross_entropy(y: Column | str, p: Column | str, floor: float = CE_FLOOR) -> Column:
    """``-ln p[y]`` with the probability floored."""
    return -F.log(F.greatest(F.get(col(p), col(y).cast("int")), F.lit(floor)))
