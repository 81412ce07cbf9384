"""What a session needs: the package on the executors, and a folder that all share."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Nothing is done where workers find the package already (``PYTHONPATH`` or the working
    directory); otherwise a zip of the sources is added to the context once.
    """
    places = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if any(p and os.path.realpath(p) == os.path.realpath(_ROOT) for p in places):
        return
    context = spark.sparkContext
    if getattr(context, "_quillon_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="quillon-code-")) / "quillon_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((_ROOT / "quillon").rglob("*.py")):
            z.write(f, f.relative_to(_ROOT))
    context.addPyFile(str(target))
    context._quillon_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The application's folder below ``spark.checkpoint.dir``, as a full URI.

    Only where that setting is absent and the master is local (tests on one machine) a
    temporary folder is made and set as the checkpoint folder; on a cluster, whose
    executors would each write to their own disk, it is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        made = context._jsc.sc().getCheckpointDir()
        base = made.get() if made.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillon-checkpoints-")
        context.setCheckpointDir(base)
    path = context._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/quillon-{context.applicationId}")
    full = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full
