"""Scalar rules: bands, ages, fit scores, vectors and display rounding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lower edges of the price bands, age bands, days in a year.
PRICE_EDGES = [1_000_000, 2_500_000, 5_000_000, 10_000_000, 20_000_000, 40_000_000]
AGE_EDGES = [23, 27, 31]
AGE_BANDS = ["under 23", "23 to 26", "27 to 30", "31 and over"]
YEAR = 365.25
# Weights of the eight products in a fit score, over six.
FIT_WEIGHTS = {
    "pressing": 1.0, "possession": 1 / 3, "buildup": 1 / 3, "width": 1.0, "verticality": 1 / 3,
    "depth": 1.0, "dribble": 1.0, "creation": 1.0,
}


def band(price: Column, edges: Sequence[float] = tuple(PRICE_EDGES)) -> Column:
    """How many edges a price reaches; an edge belongs to the band above it."""
    reached = [F.when(price >= e, 1).otherwise(0) for e in edges]
    return F.when(price.isNotNull(), sum(reached[1:], reached[0]))


def age(on: Column, born: Column) -> Column:
    return F.datediff(on, born) / YEAR


def age_band(years: Column) -> Column:
    out = F.when(years < AGE_EDGES[0], AGE_BANDS[0])
    for edge, name in zip(AGE_EDGES[1:], AGE_BANDS[1:]):
        out = out.when(years < edge, name)
    return out.when(years.isNotNull(), AGE_BANDS[-1])


def vector(columns: Sequence[str]) -> Column:
    """Scores as an array, a missing one 0."""
    return F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0))
                     for c in columns])


def missing_places(columns: Sequence[str]) -> Column:
    """Positions of the missing scores."""
    cells = F.array(*[F.when(F.col(c).isNull(), i) for i, c in enumerate(columns)])
    return F.filter(cells, lambda x: x.isNotNull())


def fit_score(products: dict[str, Column]) -> Column:
    parts = [products[d] * w for d, w in FIT_WEIGHTS.items()]
    return sum(parts[1:], parts[0]) / 6


def fixed(value: Column, places: int) -> Column:
    """Halves away from zero on the decimal digits."""
    return F.round(value, places)


def rounded_even(value: Column, places: int) -> Column:
    """Halves to the even digit, on the decimal digits."""
    return F.bround(value, places)


def expected_reciprocal_rank(m: Column) -> Column:
    """Mean of 1/rank over ranks 1 to m."""
    return F.aggregate(F.sequence(F.lit(1), m.cast("int")), F.lit(0.0), lambda s, x: s + 1 / x) / m


def distance(a: Column, b: Column) -> Column:
    square = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
