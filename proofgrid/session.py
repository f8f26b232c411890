"""Session and table helpers shared by queries, tests and the bench."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benches; on a cluster the caller brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("proofgrid")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder; columns and filters are pruned by Catalyst at the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once a context, so that Python workers can import it wherever they run."""
    import pathlib
    import tempfile
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_proofgrid_shipped", False):
        return
    here = pathlib.Path(__file__).parent
    name = f"{tempfile.mkdtemp(prefix='proofgrid-')}/proofgrid_package.zip"
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in here.rglob("*.py"):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(name)
    sc._proofgrid_shipped = True
