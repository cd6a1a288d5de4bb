"""Versions of a table that become visible by one step, whatever a failure leaves behind.

Data are written to a folder that nobody reads yet.  A commit is a small file under
a number, which names that folder; it appears under its number by a rename that
never replaces one, so of two writers that race for a number one loses.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from goldseam.config import EngineError


class Conflict(EngineError):
    """Another writer has committed in between."""


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def claim(spark: SparkSession, path: str, content: str) -> bool:
    """Create a file with this content unless one of that name is there; whether it was created."""
    jvm = spark._jvm
    at, fs = _fs(spark, path)
    staged = jvm.org.apache.hadoop.fs.Path(f"{path.rsplit('/', 1)[0]}/_staged-{uuid.uuid4().hex}")
    out = fs.create(staged, True)
    out.write(bytearray(content.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(staged), fs.makeQualified(at), none)
    except Py4JJavaError as e:
        if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        fs.delete(staged, False)
        return False
    return True


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, in order; none if it isn't there."""
    at, fs = _fs(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def content(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def commits(spark: SparkSession, root: str) -> list[int]:
    """The numbers that are committed."""
    return [int(n) for n in names(spark, f"{root}/commits") if n.isdigit()]


def folder(spark: SparkSession, root: str, number: int) -> str:
    """Where a committed version lies."""
    return f"{root}/versions/{content(spark, f'{root}/commits/{number:012}')}"


def staged(root: str) -> tuple[str, str]:
    """(name, path) of a folder for a version to come."""
    name = uuid.uuid4().hex
    return name, f"{root}/versions/{name}"


def commit(spark: SparkSession, root: str, number: int, name: str) -> None:
    """Make a staged folder the version of that number; Conflict if there is one."""
    if not claim(spark, f"{root}/commits/{number:012}", name):
        raise Conflict(f"version {number} of {root} is there already")
