"""Column expressions of the model. All of them stay inside whole-stage code generation."""
from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from showerframe.schema import DETECTORS, E_EDGES, EM_PDG


def real(column: Column, f32: bool) -> Column:
    """Round to the working precision. Spark widens float division, square roots and products with literals to
    double; rounding that double result once equals the float operation."""
    return column.cast("float" if f32 else "double")


def number(value: float, f32: bool) -> Column:
    """A literal in the working precision, so that comparisons do not widen (1.1f <= 1.1 is false)."""
    return real(F.lit(float(value)), f32)


#: Energies are added in units of 2**-60, told in two whole numbers: above and below 2**-10.
_COARSE, _FINE, MOST_ENERGY = 2**10, 2**50, float(2**43)


def units(energy: Column) -> Column:
    """Energy as a whole number of 2**-60, whose sums are exact in any order. Double-precision values from 2**-8 and single-precision
    ones from 2**-37 are kept to the last bit, smaller ones to 2**-60. Values that are no number or reach ``MOST_ENERGY`` are an
    error rather than a gap in a sum; a null stays null."""
    x = energy.cast("double") * float(_COARSE)
    high = F.floor(x)
    low = F.floor((x - high.cast("double")) * float(_FINE))
    whole = (high.cast("decimal(16,0)") * F.lit(Decimal(_FINE)) + low.cast("decimal(16,0)")).cast("decimal(32,0)")
    wrong = F.raise_error(F.concat(F.lit("not an energy that can be added: "), energy.cast("string"))).cast("decimal(32,0)")
    return F.when(F.abs(energy.cast("double")) < MOST_ENERGY, whole).when(energy.isNotNull(), wrong)


def exact(total: Column) -> Column:
    """A sum of ``units`` as a double, rounded once."""
    return total.cast("double") / float(_COARSE * _FINE)


def by_detector(det: Column, values) -> Column:
    """One value per accepted detector id, NULL elsewhere."""
    first, *rest = list(zip(DETECTORS, values))
    return reduce(lambda c, dv: c.when(det == dv[0], dv[1]), rest, F.when(det == first[0], first[1]))


def energy_bin(energy: Column) -> Column:
    """Index of the left-closed energy bin; anything below the second edge is bin 0."""
    _, low, mid, high = E_EDGES
    return F.when(energy < low, 0).when(energy < mid, 1).when(energy < high, 2).otherwise(3)


def is_em(pdg: Column, kind: Column) -> Column:
    return F.abs(pdg).isin(*EM_PDG) | (kind == 1)


def ratio(num: Column, den: Column) -> Column:
    """num / den, NaN where the denominator is not positive. ANSI division would raise on zero."""
    return F.when(den > 0, num / den).otherwise(F.lit(float("nan")))


def guarded(num: Column, den: Column) -> Column:
    """num / den, 0 where the denominator is not positive or absent."""
    return F.when(den > 0, F.coalesce(num, F.lit(0.0)) / den).otherwise(F.lit(0.0))


def finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def finite_mean(*values: Column, empty: float) -> Column:
    """Mean of the finite values of a row, ``empty`` if there is none."""
    total = reduce(lambda a, b: a + b, [F.when(finite(v), v).otherwise(0.0) for v in values])
    count = reduce(lambda a, b: a + b, [F.when(finite(v), 1).otherwise(0) for v in values])
    return F.when(count > 0, total / F.greatest(count, F.lit(1))).otherwise(F.lit(float(empty)))


def share_weight(multiplicity: Column) -> Column:
    """Fraction of a group that one of its holders takes: 1 / multiplicity, 1 if that is not positive."""
    return F.when(multiplicity > 0, 1.0 / F.greatest(multiplicity.cast("double"), F.lit(1e-9))).otherwise(F.lit(1.0))
