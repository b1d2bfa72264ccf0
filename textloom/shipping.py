"""Making this package known to the Python workers of a session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the workers a copy of the package, unless they find it by themselves.

    They do where PYTHONPATH names its folder, and on a local master that was started in that
    folder.  Otherwise a zip of the sources is handed out by the session's own file server.
    """
    sc = spark.sparkContext
    paths = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    at_home = sc.master.startswith("local[") and os.path.realpath(os.getcwd()) == str(ROOT)
    if str(ROOT) in paths or at_home or sc.applicationId in _done or not ROOT.is_dir():
        return
    target = os.path.join(tempfile.mkdtemp(prefix="textloom-"), "textloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "textloom").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(target)
    _done.add(sc.applicationId)
