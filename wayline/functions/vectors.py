"""Column expressions on arrays of doubles; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column) -> Column:
    """Rounded to 6 decimals, without negative zero."""
    return F.round(c, 6) + F.lit(0.0)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos; null if either norm is below 1e-8."""
    n = norm(a) * norm(b)
    return F.when((norm(a) >= 1e-8) & (norm(b) >= 1e-8), 1 - dot(a, b) / n)


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(F.arrays_zip(e.alias("e")), lambda s: s["e"] / total(e))


def topk(z: Column, k: int) -> Column:
    """The k largest as structs (feature, value), by value descending, then index."""
    pairs = F.transform(z, lambda x, i: F.struct((-x).alias("neg"), i.alias("feature"), x.alias("value")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda s: F.struct(s["feature"].alias("feature"), s["value"].alias("value")))


def kl_divergence(p: Column, q: Column, eps: float = 1e-10) -> Column:
    """sum p (ln p - ln q), eps added to both and not renormalised."""
    return total(F.zip_with(p, q, lambda a, b: (a + eps) * (F.ln(a + eps) - F.ln(b + eps))))


def effect_sparsity(e: Column) -> Column:
    """n sum(e^2) / (sum|e|)^2: 1 for equal effects, n for one; 0 if all are tiny."""
    size = total(F.transform(e, lambda x: F.abs(x)))
    return F.when(size < 1e-10, F.lit(0.0)).otherwise(F.size(e) * total(F.transform(e, lambda x: x * x)) / (size * size + 1e-10))


def implied_timescale(lam: Column, lag: int) -> Column:
    """-lag / ln(lam) inside (0, 1), else infinity."""
    return F.when((lam > 0) & (lam < 1), -lag / F.ln(lam)).otherwise(F.lit(float("inf")))


def membership_entropy(m: Column, eps: float = 1e-10) -> Column:
    """-sum m ln m of a row whose entries get eps and are normalised."""
    shifted = F.transform(m, lambda x: x + eps)
    s = total(shifted)
    return -total(F.transform(shifted, lambda x: x / s * F.ln(x / s)))
