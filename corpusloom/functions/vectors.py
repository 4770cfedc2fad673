"""Vector expressions on ``array<float>`` columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import col


def as_double(vector: Column | str) -> Column:
    return col(vector).cast("array<double>")


def inner_product(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def squared_l2(a: Column | str, b: Column | str) -> Column:
    squares = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.aggregate(squares, F.lit(0.0), lambda total, x: total + x)


def l2_norm(vector: Column | str) -> Column:
    squares = F.aggregate(as_double(vector), F.lit(0.0), lambda total, x: total + x * x)
    return F.sqrt(squares)


def normalized(vector: Column | str) -> Column:
    """Unit-length copy; the zero vector stays as it is."""
    vector = as_double(vector)
    norm = l2_norm(vector)
    bound = F.transform(F.array(norm), lambda n: F.when(n == 0, vector).otherwise(F.transform(vector, lambda x: x / n)))
    return F.element_at(bound, 1)
