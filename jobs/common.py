"""What the jobs share: configs, logs, and the split that a config describes."""

from __future__ import annotations

import json
import logging
from pathlib import Path
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def load_config(path: str | Path | None, job: str) -> dict[str, Any]:
    """A job's settings: a JSON file, by default the one beside the job."""
    return json.loads(Path(path or Path(__file__).with_name(f"{job}.json")).read_text())


def logger(job: str) -> logging.Logger:
    return logging.getLogger(f"jobs.{job}")


def split_column(split: dict[str, Any]) -> Column:
    """train, valid or test: a column that names it, or the key modulo ``parts``, of which the first ``train`` are train and
    the next ``valid`` are valid. A row without key is in test."""
    if "column" in split:
        return F.col(split["column"])
    part = F.pmod(F.expr(str(split["key"])), F.lit(split["parts"]))
    return F.when(part < split["train"], "train").when(part < split["train"] + split["valid"], "valid").otherwise("test")
