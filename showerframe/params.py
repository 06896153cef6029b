"""Settings of the density clustering."""
from __future__ import annotations

from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class Params:
    """Field names are the keys of a settings file; defaults are the standard configuration (fixed values)."""

    dc: float = 1.0
    rhoc: float = 0.8
    outlierDistance: float = 2.8
    seedingDistance: float = 2.8
    sigmaT: tuple[float, float, float] = (0.003, 0.006, 0.012)
    layerScale: float = 6.0
    rhocEtaExponent: float = 2.0
    rhocPivotRadius: float = 0.42
    minNumLayerCluster: int = 2
    f32: bool = True
    fma: bool = False

    def with_(self, **changes) -> "Params":
        return replace(self, **changes)

    def as_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_setting(cls, setting: dict) -> "Params":
        """Params of one settings record: ``name`` is not a field, lists become tuples, unknown keys raise."""
        fields = {k: tuple(v) if isinstance(v, list) else v for k, v in setting.items() if k != "name"}
        return cls(**fields)

    @property
    def reach(self) -> float:
        """Largest distance at which two points can matter to each other."""
        return max(self.outlierDistance, self.seedingDistance, self.dc)


DEFAULT = Params()
