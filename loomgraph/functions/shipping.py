"""Sends this package to Python workers, so executors need no copy of it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path


def ship(spark) -> None:
    """Once a Spark context."""
    sc = spark.sparkContext
    if getattr(sc, "_loomgraph_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="loomgraph-")) / "loomgraph.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))
    sc._loomgraph_sent = True
