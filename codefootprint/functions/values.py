"""Values shown in reports: sizes, grades, scores, impact and locations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..catalog.dimensions import GRADE_BANDS

# Scale of the score and the illustrative impact factors.
DEFAULT_K = 1.0
MIN_KLOC = 0.1
KWH_PER_POINT = 0.05
KG_CO2_PER_KWH = 0.30


def exact_round(value: Column, digits: int = 1) -> Column:
    """Rounds a non-negative double by its exact binary value, true ties to the even digit.

    ``round`` and ``bround`` look at the shortest decimal form, so 92.45, whose double lies above it, or 0.25, a
    true tie, can come out a digit off. Here the fraction is split into two parts that multiply without error, which
    makes the comparison with the midpoint exact.
    """
    scale = 10**digits
    whole = F.floor(value).cast("double")
    fraction = value - whole
    high = F.floor(fraction * 2.0**26) / 2.0**26
    low = fraction - high
    step = F.floor(fraction * scale).cast("double")
    below, above = step * 2 + 1 - high * (2 * scale), low * (2 * scale)
    up = (above > below) | ((above == below) & (step % 2 == 1))
    return (whole * scale + step + F.when(up, 1.0).otherwise(0.0)) / scale


def human_size_sql(size: str) -> str:
    """``512 B``, ``1.5 KB``, ``3.0 MB``, ``2.0 GB``."""

    def in_unit(power: int, unit: str) -> str:
        # Sizes divided by a power of two are exact, so banker's rounding of the decimal form is exact too.
        return f"format_string('%.1f {unit}', bround(CAST({size} AS DOUBLE) / {1024**power}, 1))"

    return (
        f"CASE WHEN {size} < 1024 THEN format_string('%d B', {size}) WHEN {size} < {1024**2} THEN {in_unit(1, 'KB')} "
        f"WHEN {size} < {1024**3} THEN {in_unit(2, 'MB')} ELSE {in_unit(3, 'GB')} END"
    )


def human_size(size: str) -> Column:
    return F.expr(human_size_sql(size))


def clamp_score(density: Column, k: float | Column = DEFAULT_K) -> Column:
    weight = k if isinstance(k, Column) else F.lit(float(k))
    return exact_round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.lit(100.0) - weight * density)), 1)


def grade_columns(score: Column) -> dict[str, Column]:
    """Letter, colour and label of the first band the score reaches; the last band takes the rest."""

    def pick(position: int) -> Column:
        chain = F
        for band in GRADE_BANDS[:-1]:
            chain = chain.when(score >= band[1], F.lit(band[position]))
        return chain.otherwise(F.lit(GRADE_BANDS[-1][position]))

    return {"grade": pick(0), "grade_color": pick(2), "grade_label": pick(3)}


def impact_columns(penalty: Column) -> dict[str, Column]:
    """Illustrative energy and emissions of a penalty, unrounded."""
    kwh = penalty * F.lit(KWH_PER_POINT)
    return {"kwh": kwh, "kg_co2": kwh * F.lit(KG_CO2_PER_KWH)}


def location(path: str, line: str) -> Column:
    return F.expr(f"IF({line} > 0, concat({path}, ':', {line}), {path})")
