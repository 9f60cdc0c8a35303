"""Market-depth analytics on Spark."""

from __future__ import annotations

import re
import tempfile
from pathlib import Path


def find_here(spark) -> None:
    """Let Python workers find this package where the driver does, unless the session says otherwise."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))


def shared_dir(spark) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset, a session whose master is local gets a temporary folder of its own; any other
    is an error, as executors would write to disks that the others do not see.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidebook-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")
