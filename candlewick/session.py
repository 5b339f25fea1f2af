"""What a Spark application needs once: the package's sources on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package's sources to the executors, once for each application, so that it need not be installed there."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent
        if package.is_dir():
            target = Path(tempfile.mkdtemp(prefix="candlewick-")) / f"{package.name}.zip"
            with zipfile.ZipFile(target, "w") as z:
                for p in sorted(package.rglob("*.py")):
                    z.write(p, p.relative_to(package.parent))
            context.addPyFile(str(target))
        _SHIPPED.add(context.applicationId)
    return spark
