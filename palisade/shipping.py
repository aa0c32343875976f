"""Make the package importable on executors that do not have it installed."""

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once per application (as ``--py-files`` would)."""
    sc = spark.sparkContext
    package = Path(__file__).resolve().parent
    if sc.applicationId in _shipped or not package.is_dir():
        return
    folder = tempfile.mkdtemp(prefix="palisade-package-")  # only the driver reads it; Spark serves it to executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder, f"{package.name}.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)
