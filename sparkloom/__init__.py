"""sparkloom: retrieval and document analytics as PySpark DataFrame operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

__version__ = "0.1.0"
_shipped: set[str] = set()


def ship(spark) -> None:
    """Sends this package, and corpus_pipeline.py beside it, to the Python workers of the session, once
    for each application. Spark fetches the archive from the driver; nothing is read from a shared path."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    top = os.path.dirname(here)
    folder = tempfile.mkdtemp(prefix="sparkloom-")  # the driver serves the archive from here as executors come
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = os.path.join(folder, "sparkloom.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(root, name)
                    z.write(path, os.path.relpath(path, top))
        extra = os.path.join(top, "corpus_pipeline.py")
        if os.path.exists(extra):
            z.write(extra, "corpus_pipeline.py")
    context.addPyFile(archive)
    _shipped.add(context.applicationId)
