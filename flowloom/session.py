"""Session construction and table loading."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def visible(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package from where the driver does; clusters install it or ship it with --py-files."""
    known, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    if root not in known.get("PYTHONPATH", "").split(":"):
        known["PYTHONPATH"] = ":".join(filter(None, (root, known.get("PYTHONPATH", ""))))
    return spark


def build_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A UTC local session for tests and benchmarks; clusters bring their own session."""
    return visible(
        SparkSession.builder.master(f"local[{cores}]")
        .appName("flowloom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
