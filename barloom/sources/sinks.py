"""Small results as files for people: CSV and JSON. Large ones are written by Spark's own writers.

What goes through these functions is bounded by its report: signals of a date, ranked runs, a check's findings.
"""

from __future__ import annotations

import csv
import json
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame

MOST = 100_000  # rows of a report


def rows_of(df: DataFrame, most: int = MOST) -> list[dict]:
    """All rows; an error where there are more than a report holds."""
    rows = [r.asDict(recursive=True) for r in df.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them with df.write")
    return rows


def write_csv(df: DataFrame, path: str) -> int:
    """One CSV file with a header line, nulls empty; the number of rows."""
    rows = rows_of(df)
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        out = csv.DictWriter(f, df.columns)
        out.writeheader()
        out.writerows(rows)
    return len(rows)


def write_json(path: str, value: Mapping[str, object]) -> None:
    """One JSON document; frames among the values become lists of objects."""
    plain = {k: rows_of(v) if isinstance(v, DataFrame) else v for k, v in value.items()}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(plain, ensure_ascii=False, indent=2, allow_nan=False, default=str) + "\n", encoding="utf-8")


def best_parameters(ranked: DataFrame, runs: list[dict], top: int = 10) -> list[dict]:
    """The parameters of the best runs with their metrics, by place."""
    known = {r["run_id"]: {k: v for k, v in r.items() if k != "run_id"} for r in runs}
    best = rows_of(ranked.orderBy("place").limit(top))
    return [{"place": r["place"], "run_id": r["run_id"], "parameters": known.get(r["run_id"], {}), "metrics": {k: v for k, v in r.items() if k not in ("place", "run_id")}} for r in best]
