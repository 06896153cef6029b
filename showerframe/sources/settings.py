"""Settings files and result files."""
from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showerframe.operators.summary import metric_names
from showerframe.params import Params
from showerframe.schema import BIN_TAGS


def read_settings(path: str) -> list[dict]:
    """List of settings records; each is checked here, so that a bad key fails before any job starts."""
    with open(path) as f:
        settings = json.load(f)
    for setting in settings:
        Params.from_setting(setting)
    return settings


def to_dict(long_summary: DataFrame) -> dict[str, dict[str, float]]:
    """{setting: {metric: value}} of a long summary. Its size is 46 rows per setting, whatever the data."""
    rows = long_summary.select("setting", "metric", "value").collect()
    out: dict[str, dict] = {}
    for row in rows:
        out.setdefault(row["setting"], {})[row["metric"]] = (
            int(row["value"]) if row["metric"] == "events" else row["value"])
    return {name: {m: values[m] for m in metric_names() if m in values} for name, values in out.items()}


def write_json(long_summary: DataFrame, path: str) -> None:
    """Undefined metrics are written as a bare NaN."""
    with open(path, "w") as f:
        json.dump(to_dict(long_summary), f, indent=1)


def pivot(long_summary: DataFrame, settings: list[str]) -> DataFrame:
    """metric x setting table."""
    return long_summary.groupBy("metric").pivot("setting", settings).agg(F.first("value"))


def render(long_summary: DataFrame, names: list[str]) -> str:
    """Markdown table, one row per setting, without the metrics per energy bin, which only the result file holds."""
    table = to_dict(long_summary)
    shown = [m for m in metric_names() if not any(m.endswith(tag) for tag in BIN_TAGS)]
    cells = [["setting", *shown]] + [[n, *(f"{table[n][m]:.5g}" for m in shown)] for n in names if n in table]
    rows = ["| " + " | ".join(r) + " |" for r in cells]
    return "\n".join([rows[0], "|-" * len(cells[0]) + "|", *rows[1:]])
