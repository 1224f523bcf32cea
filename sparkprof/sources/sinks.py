"""Writing reports: one folder per view."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sparkprof.sources.delimited import write_csv
from sparkprof.sources.json_records import write_json_records

FORMATS = ("csv", "json", "parquet")


def write_views(views: dict[str, DataFrame], path: str, format: str = "csv") -> dict[str, str]:
    """Writes each view below ``path`` and returns the folder of each."""
    if format not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}")
    folders = {name: f"{path.rstrip('/')}/{name}" for name in views}
    for name, view in views.items():
        if format == "csv":
            write_csv(view, folders[name])
        elif format == "json":
            write_json_records(view, folders[name])
        else:
            view.write.parquet(folders[name])
    return folders
