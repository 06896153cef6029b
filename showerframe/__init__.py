"""showerframe: scoring of clusterings of sparse energy deposits, as Spark jobs.

Every relation of the model (cells, weighted cell groups, truth contributions, units, object collections) is one long
DataFrame with ``event_id`` in its key, and all events are processed at once.
"""
from showerframe.params import DEFAULT, Params
from showerframe.schema import EventTables
from showerframe.session import session, tune
from showerframe.workspace import Workspace

__all__ = ["DEFAULT", "EventTables", "Params", "Workspace", "session", "tune"]
__version__ = "0.1.0"
