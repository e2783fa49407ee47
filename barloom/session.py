"""Sessions, and the package's way to the Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package: sends it with ``addPyFile`` unless PYTHONPATH has it already."""
    sc = spark.sparkContext
    on_path = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if str(_PACKAGE.parent) in on_path or getattr(sc, "_barloom_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="barloom-")) / "barloom.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent).as_posix())
    sc.addPyFile(str(target))
    sc._barloom_shipped = True


def build_session(app: str = "barloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and the settings that the operators assume."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false"} | conf
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    ship(spark)
    return spark
