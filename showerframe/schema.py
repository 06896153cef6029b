"""Table schemas, fixed values of the data model, and the bundle of tables of a sample."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

# Fixed values of the data model.
DETECTORS = (8, 9, 10)            # accepted detector ids, in the order of Params.sigmaT
LAST_LAYER = 47                   # layers per side
SIZE_CUT_ALGOS = (6, 7, 8)        # algo ids that the lc_all level accepts without their mask
EM_PDG = (11, 22, 111)
LEVELS = ("lc", "lc_all", "rh")
CLASSES = ("EM", "HAD")
E_EDGES = (0.0, 5.0, 30.0, 150.0)  # left-closed energy bins; the last one is open
BIN_TAGS = ("E0-5", "E5-30", "E30-150", "E150-inf")
DEFAULT_FRAC = 0.5

SUM_KEYS = (
    "k_num", "k_den", "k_floor", "e_num", "e_den", "f_c", "f_cn", "lost_other", "lost_none",
    "n_targets", "n_targets_obj", "n_obj", "pu_sig", "pu_den", "pu_eps_num", "pu_eps_den",
    "n_pu_obj", "n_noise_obj", "events",
)


def _struct(spec: str) -> T.StructType:
    types = {"l": T.LongType(), "i": T.IntegerType(), "f": T.FloatType(), "d": T.DoubleType(), "s": T.StringType()}
    return T.StructType([T.StructField(n, types[t]) for n, t in (c.split(":") for c in spec.split())])


SCHEMAS = {
    "event": _struct("event_id:l file_ordinal:l entry:l"),
    "lc": _struct("event_id:l lc:l E:f x:f y:f z:f layer:i side:i det:i algo:i seed:l mask:f"),
    "rh": _struct("event_id:l rh:l id:l E:f x:f y:f z:f layer:i det:i lc:l noTruthE:f"),
    "lch": _struct("event_id:l lc:l rh:l frac:d"),
    "atom": _struct("event_id:l atom:l id:l pdg:i parent:l unit:l"),
    "un": _struct("event_id:l unit:l id:l pdg:i kind:i signal:i bx:i evt:l depE:f"),
    "tra": _struct("event_id:l rh:l atom:l E:d"),
    "assign": _struct("event_id:l lc:l label:l"),
    "trackster_lc": _struct("event_id:l collection:s ts:l pos:l lc:l weight:d"),
}
REQUIRED = ("event", "lc", "rh", "lch", "atom", "un", "tra")
OPTIONAL = ("assign", "trackster_lc")


@dataclass(frozen=True)
class EventTables:
    """The long tables of one sample. ``assign`` and ``trackster_lc`` exist only where they were stored; an empty
    trackster keeps one ``trackster_lc`` row whose ``lc`` is NULL, so that it still counts as an object."""

    event: DataFrame
    lc: DataFrame
    rh: DataFrame
    lch: DataFrame
    atom: DataFrame
    un: DataFrame
    tra: DataFrame
    assign: DataFrame | None = None
    trackster_lc: DataFrame | None = None

    def __post_init__(self):
        for name in REQUIRED + OPTIONAL:
            df = getattr(self, name)
            if df is not None:
                check_columns(df, SCHEMAS[name].names, name, optional=("file_ordinal", "entry"))

    @property
    def spark(self) -> SparkSession:
        return self.event.sparkSession

    def filtered(self, condition: Column) -> "EventTables":
        """The same sample restricted to the rows of every table that meet ``condition``."""
        return EventTables(**{n: None if getattr(self, n) is None else getattr(self, n).filter(condition)
                              for n in REQUIRED + OPTIONAL})

    def only_events(self, events: DataFrame) -> "EventTables":
        """The same sample restricted to the ``event_id`` values of ``events``."""
        keep = events.select("event_id")
        return EventTables(**{
            n: None if getattr(self, n) is None else getattr(self, n).join(keep, "event_id", "left_semi")
            for n in REQUIRED + OPTIONAL
        })


def check_columns(df: DataFrame, required, what: str, optional=()) -> None:
    """Raise before any job if a required column is missing, naming up to four of them."""
    missing = [c for c in required if c not in set(df.columns) and c not in optional]
    if missing:
        raise ValueError(f"{what}: missing columns {missing[:4]}{'...' if len(missing) > 4 else ''}")
