"""Small files that several drivers agree on: made whole or not at all, by one of them."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Make the file ``path`` with this text, unless it is there. Of several drivers
    that try at once exactly one gets True, and no reader sees half a file.

    The text is written beside it and then given its name, which fails if the name
    is taken: by a hard link on a file system of this machine, by a rename elsewhere
    (the file system must refuse to rename onto a file, as HDFS does)."""
    at, files = _hadoop(spark, path)
    spare = f"{path}.{uuid.uuid4().hex}.tmp"
    if files.getScheme() == "file":
        own, target = (_hadoop(spark, p)[0].toUri().getPath() for p in (spare, path))
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(own, "x", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(own, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
        return True
    beside, _ = _hadoop(spark, spare)
    out = files.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    if files.exists(at) or not files.rename(beside, at):
        files.delete(beside, False)
        return False
    return True


def names(spark: SparkSession, folder: str, suffix: str) -> list[str]:
    """Names of the files in a folder that end so, sorted; none if it isn't there."""
    at, files = _hadoop(spark, folder)
    if not files.exists(at):
        return []
    found = [status.getPath().getName() for status in files.listStatus(at)]
    return sorted(name for name in found if name.endswith(suffix))


def text_of(spark: SparkSession, path: str) -> str:
    at, files = _hadoop(spark, path)
    stream = files.open(at)
    try:
        return bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
    finally:
        stream.close()
