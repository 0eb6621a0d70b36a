"""Sessions: the settings this library is written for, and shipping it to executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch: texts are long, so that batches of Spark's usual number of rows would take much of a worker's memory.
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors of a session, once: its functions run inside their tasks. Bounds Arrow batches by bytes, unless the session does."""
    if int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_CONF))) > BATCH_BYTES:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = os.path.dirname(os.path.abspath(__file__))
        to = os.path.join(tempfile.mkdtemp(prefix="eventloom-"), "eventloom.zip")
        with zipfile.ZipFile(to, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        at = os.path.join(folder, name)
                        z.write(at, os.path.relpath(at, os.path.dirname(root)))
        spark.sparkContext.addPyFile(to)
        _shipped.add(app)
    return spark


def session(name: str = "eventloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; what is given overrides."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for k, v in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(k, v)
    return ship(builder.getOrCreate())
