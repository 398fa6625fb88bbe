"""Sends this package to the Python workers of a session that was started without it."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile

_sent: set[str] = set()


def ship(spark) -> None:
    """Adds the package to the session's files, once."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-ship-"), "folioscope.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(os.path.dirname(os.path.abspath(__file__))):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)


def shipped(query):
    """``query`` after the package has been sent; its first argument is the session."""

    @functools.wraps(query)
    def run(spark, *rest):
        ship(spark)
        return query(spark, *rest)

    return run
