"""Making this package importable in Python workers that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package's code to the session, once, unless ``PYTHONPATH`` or an installation has it already."""
    sc = spark.sparkContext
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(_ROOT) in on_path or sc.applicationId in _shipped or not (_ROOT / "rowgrove").is_dir():
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="rowgrove-code-"), "rowgrove_code.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted((_ROOT / "rowgrove").rglob("*")):
            if f.suffix in {".py", ".npz", ".json"}:
                z.write(f, f.relative_to(_ROOT))
    sc.addPyFile(archive)
    _shipped.add(sc.applicationId)
