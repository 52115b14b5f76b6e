"""Scalar expressions: proximity, translation scores, similarity of histograms, bases and k-mers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def near(lat: Column, lon: Column, lat0, lon0, miles: float = 30.0) -> Column:
    """Within `miles` of a point by the flat approximation around latitude 40; an unknown coordinate is not near."""
    dx, dy = (lon - lon0) * 0.91, (lat - lat0) * 1.15
    return F.coalesce(F.sqrt(dx * dx + dy * dy) <= miles, F.lit(False))


def translation_score(h: Column, r: Column, t: Column, gamma: float = 1.0) -> Column:
    """gamma - |h + r - t|, summed in double precision; null where any of them is null."""
    parts = F.zip_with(F.zip_with(h, r, lambda a, b: a.cast("double") + b.cast("double")), t, lambda a, b: F.abs(a - b.cast("double")))
    return F.lit(gamma) - F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def norm(v: list[Column]) -> Column:
    return F.sqrt(sum((x.cast("double") * x for x in v[1:]), v[0].cast("double") * v[0]))


def histogram_similarity(a: list[Column], b: list[Column], norms: tuple[Column, Column] | None = None) -> Column:
    """sqrt(sum of squared minima) * dot / (|a| |b|), 0 where either is zero; norms where they are known already."""
    total = lambda xs: sum(xs[1:], xs[0])
    least = F.sqrt(total([F.least(x, y).cast("double") * F.least(x, y) for x, y in zip(a, b, strict=True)]))
    dot = total([x.cast("double") * y for x, y in zip(a, b, strict=True)])
    na, nb = norms or (norm(a), norm(b))
    return F.when((na > 0) & (nb > 0), least * dot / (na * nb)).otherwise(0.0)


def kmers(text: Column, k: int) -> Column:
    """All substrings of k bases; those with another letter are left out.

    The text is first cut in pieces that overlap by k - 1 bases, in one pass, as a substring is found by walking there
    from the start: on the whole text that would cost the square of its length.
    """
    step = max(32, 2 * k)
    pieces = F.regexp_extract_all(text, F.lit(f"(?=([ACTG]{{{k},{step + k - 1}}}))[ACTG]{{1,{step}}}"), F.lit(1))
    return F.flatten(F.transform(pieces, lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - (k - 1)), lambda i: F.substring(p, i, F.lit(k)))))


def code_order(text: Column) -> Column:
    """Sorts like the two-bit codes A C T G."""
    return F.translate(text, "ACTG", "0123")


def prefix_merge(key: Column, affix: Column, size: int) -> tuple[Column, Column]:
    """(new key, new affix) where an affix stands before a key: the first `size` bases of both, and what follows."""
    whole = F.concat(affix, key)
    return F.substring(whole, 1, size), F.substring(whole, F.lit(size + 1), F.length(whole))


def suffix_merge(key: Column, affix: Column, size: int) -> tuple[Column, Column]:
    """(new key, new affix) where an affix follows a key: the last `size` bases of both, and what leads to them."""
    whole = F.concat(key, affix)
    return F.right(whole, F.lit(size)), F.left(whole, F.length(whole) - size)


def us_date(text: Column) -> Column:
    """M/D/YYYY with or without padding; anything else is null."""
    return F.to_date(F.try_to_timestamp(text, F.lit("M/d/yyyy")))


def visits(count: Column, coverage: float) -> Column:
    return F.ceil(count / F.lit(float(coverage))).cast("long")
