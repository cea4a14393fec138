"""Small driver-side outputs: reports, archives and the progress cursor."""

from __future__ import annotations

import json
import os
import zipfile

from pyspark.sql import DataFrame

MAX_ROWS = 10_000


def markdown(df: DataFrame, digits: int = 4) -> str:
    """A table of an aggregate; more than :data:`MAX_ROWS` rows are refused."""
    rows = df.limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError("a report holds aggregates, not records")
    show = lambda v: "" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)]) + "\n"


def zip_folder(folder: str, target: str, prefix: str = "predictions") -> int:
    """Pack the JSON lines files below a local folder under a fixed prefix; returns their number."""
    n = 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for at, _, names in sorted(os.walk(folder)):
            for name in sorted(names):
                if name.endswith((".json", ".jsonl")):
                    full = os.path.join(at, name)
                    z.write(full, f"{prefix}/{os.path.relpath(full, folder)}")
                    n += 1
    return n


def load_progress(path: str) -> dict:
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def save_progress(path: str, progress: dict) -> None:
    """Written beside and renamed, so that a reader never sees half of it."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as f:
        json.dump(progress, f, ensure_ascii=False, sort_keys=True)
    os.replace(f"{path}.tmp", path)
