"""Vector and token-set similarity, decay and boosts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LIFE_DAYS = 90
DECAY = 0.693


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 for a zero vector or vectors of different sizes. Norms may be given, computed once per row."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    return F.when((F.size(a) == F.size(b)) & (na > 0) & (nb > 0), dot(a, b) / (na * nb)).otherwise(0.0)


def tokens(text: Column) -> Column:
    """Distinct lower-case words of two characters or more, punctuation trimmed."""
    words = F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\r\n]+"), lambda w: F.regexp_replace(w, r"^[^a-z0-9]+|[^a-z0-9]+$", ""))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


def temporal_decay(created: Column, as_of: Column) -> Column:
    """Halves every HALF_LIFE_DAYS whole days; 0.5 if unknown, 1 for the future."""
    age = F.datediff(as_of, created)
    return F.when(created.isNull(), 0.5).when(age <= 0, 1.0).otherwise(F.exp(F.lit(-DECAY) * age / HALF_LIFE_DAYS))


def confidence_boost(score: Column, confidence: Column) -> Column:
    return score * (0.7 + 0.3 * confidence)


def prove_boost(status: Column) -> Column:
    return F.when(status == "verified", 1.3).when(status == "not_reproduced", 0.6).otherwise(1.0)


def relation_type(a_type: Column, b_type: Column, a_category: Column, b_category: Column) -> Column:
    return F.when(a_type == b_type, "same_issue").when(a_category == b_category, "related_compliance").otherwise("similar")


def estimated_tokens(text: Column, multiplier: float = 1.0) -> Column:
    """A quarter of the characters, at least 0, times a safety factor."""
    return F.floor(F.floor(F.length(F.coalesce(text, F.lit(""))) / 4) * multiplier)
