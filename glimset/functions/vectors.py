"""Vector functions as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glimset.schemas import DIMENSION


def euclidean(a: Column, b: Column) -> Column:
    """The distance of two vectors, summed from left to right; an error if their lengths differ, null if one is null."""
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, d: s + d)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different lengths"))).otherwise(F.sqrt(squares))


def with_dimension(v: Column, dimension: int = DIMENSION) -> Column:
    """The vector itself, or an error if it doesn't have ``dimension`` components."""
    said = F.concat(F.lit(f"expected {dimension} components, found "), F.size(v).cast("string"))
    return F.when(F.size(v) == dimension, v).when(v.isNotNull(), F.raise_error(said))


def to_csv(v: Column) -> Column:
    """The components, separated by commas."""
    return F.array_join(F.transform(v, lambda x: x.cast("string")), ",")


def to_literal(v: Column) -> Column:
    """The components in braces."""
    return F.concat(F.lit("{"), to_csv(v), F.lit("}"))


def parse_csv(text: Column, dimension: int | None = DIMENSION) -> Column:
    """A vector from comma-separated text: blanks around parts and empty parts at the end don't count."""
    parts = F.split(F.regexp_replace(F.trim(text), ",+$", ""), ",")
    v = F.transform(parts, lambda x: F.trim(x).cast("double"))
    return v if dimension is None else with_dimension(v, dimension)


def quantize_sig6(v: Column) -> Column:
    """Components as they come back from text of six significant digits."""
    return F.transform(v, lambda x: F.format_string("%.6g", x).cast("double"))


def widened(v: Column) -> Column:
    """A float vector as doubles."""
    return v.cast("array<double>")


def first_vector(vectors: Column) -> Column:
    """The first of an array of vectors, null if there is none."""
    return F.get(vectors, 0)
