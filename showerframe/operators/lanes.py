"""Many settings in one pass.

The two sides of an event are clustered apart, and so are the settings: setting k works on the sides 2k and 2k + 1, its
lane. All keys of the clustering hold the event and the side, so densities, links, roots and numbers of all settings come
from the same jobs; what a setting changes (radii, thresholds, cell widths) is picked per row by its lane."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showerframe.functions.scalars import real
from showerframe.operators.points import coordinates
from showerframe.params import Params


def lane() -> Column:
    return F.shiftright(F.col("side"), 1)


class Lanes:
    """The settings of one pass; they share the working precision."""

    def __init__(self, settings: Sequence[Params]):
        self.all = list(settings)
        if len({p.f32 for p in self.all}) != 1:
            raise ValueError("the settings of one pass share the working precision")
        self.f32 = self.all[0].f32

    @classmethod
    def of(cls, settings: "Params | Lanes") -> "Lanes":
        return settings if isinstance(settings, Lanes) else cls([settings])

    def values(self, of: Callable[[Params], object] | Sequence | float) -> list:
        """One Python value per lane: of a function, a list, or the same for all."""
        if callable(of):
            return [of(p) for p in self.all]
        return list(of) if isinstance(of, (list, tuple)) else [of] * len(self.all)

    def pick(self, columns: Sequence[Column]) -> Column:
        """The lane's column of the row."""
        return columns[0] if len(columns) == 1 else F.element_at(F.array(*columns), lane() + 1)

    def each(self, of) -> Column:
        values = self.values(of)
        return F.lit(values[0]) if len(set(values)) == 1 else self.pick([F.lit(v) for v in values])

    def number(self, of) -> Column:
        """``each`` in the working precision."""
        return real(self.each([float(v) for v in self.values(of)]), self.f32)

    @property
    def sigmas(self) -> list[list[float]]:
        """Distinct sigmas of each lane in units of its smallest."""
        return [[s / min(p.sigmaT) for s in sorted(set(p.sigmaT))] for p in self.all]

    @property
    def reach(self) -> list[float]:
        return [p.reach for p in self.all]

    def coordinates(self, pts: DataFrame) -> DataFrame:
        """``points.coordinates`` in every lane; settings with the same coordinates share their computation."""
        setups: dict[tuple, list[int]] = {}
        for k, p in enumerate(self.all):
            setups.setdefault(_setup(p), []).append(k)
        parts = []
        for lanes in setups.values():
            found = coordinates(pts, self.all[lanes[0]])
            if len(self.all) > 1:
                found = (found.withColumn("lane", F.explode(F.array(*[F.lit(k) for k in lanes])))
                         .withColumn("side", F.col("side") + 2 * F.col("lane")).drop("lane"))
            parts.append(found)
        out = parts[0]
        for more in parts[1:]:
            out = out.unionByName(more)
        return out

    def sharing(self) -> list[list[int]]:
        """Per lane the lanes whose energy sums within ``dc`` it stands for: those with equal coordinates and radius, at the
        first of them; none at the others."""
        first: dict[tuple, int] = {}
        out: list[list[int]] = [[] for _ in self.all]
        for k, p in enumerate(self.all):
            out[first.setdefault((_setup(p), p.dc), k)].append(k)
        return out


def _setup(p: Params) -> tuple:
    return (p.sigmaT, p.layerScale, max(p.dc, p.outlierDistance), p.f32, p.fma)
