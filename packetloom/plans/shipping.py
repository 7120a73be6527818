"""Makes the library importable for Python workers."""

from __future__ import annotations

import os
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from packetloom.plans.staging import shared_folder

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once a session: the library's place joins the workers' path; on a cluster a zip of it goes to all executors."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[2]
    paths = sc.environment.get("PYTHONPATH", "").split(os.pathsep)
    if str(root) not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([str(root), *filter(None, paths)])
    if not sc.master.startswith("local"):
        folder = shared_folder(spark).removeprefix("file://")
        if "://" not in folder:
            os.makedirs(folder, exist_ok=True)
            target = f"{folder}/packetloom-{uuid.uuid4().hex}.zip"
            with zipfile.ZipFile(target, "w") as z:
                for p in sorted((root / "packetloom").rglob("*.py")):
                    z.write(p, p.relative_to(root))
            sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
