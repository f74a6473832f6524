"""Spark session settings the package is written for."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app_name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the settings this package expects.

    ``conf`` entries use ``__`` for dots, e.g. ``spark__ui__enabled="false"``.
    """
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master is not None:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def send_package(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever they run; once per application."""
    context = spark.sparkContext
    if getattr(context, "_tidemark_sent", None) is None:
        root = Path(__file__).resolve().parent
        folder = Path(tempfile.mkdtemp(prefix="package-"))
        target = folder / "tidemark-package.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for path in sorted(root.rglob("*.py")):
                archive.write(path, path.relative_to(root.parent))
        context.addPyFile(str(target))
        context._tidemark_sent = str(target)
    return spark
