"""A document-analytics engine of DataFrame operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def ship(spark) -> None:
    """Makes this package importable by Python workers: through PYTHONPATH if it names the repository, else by an archive that
    Spark hands to the executors.  Call it before an operator is built."""
    context = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_loom_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="loom-"), "corpusloom_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted((ROOT / "corpusloom").rglob("*.py")):
            z.write(path, path.relative_to(ROOT))
    context.addPyFile(archive)
    context._loom_shipped = True
