"""Small files that are put in place only if they are not there yet.

On a distributed file system or an object store, creating without overwriting is decided by the store. On a local disk the file is
linked to its name when it is complete, since Hadoop's local file system looks first and creates afterwards.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def files(spark: SparkSession, path: str):
    """Spark's view of the file system that a path is on, and of the path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def names(spark: SparkSession, folder: str, empty: bool = True) -> list[str]:
    """What is in a folder, nothing if there is none; with `empty=False` without files of no bytes."""
    system, place = files(spark, folder)
    found = system.listStatus(place) if system.exists(place) else []
    return [x.getPath().getName() for x in found if empty or x.isDirectory() or x.getLen() > 0]


def put(spark: SparkSession, path: str, content: Mapping[str, int | str | None]) -> bool:
    """Create a file with the content as a line of JSON; False if there is one of that name."""
    system, place = files(spark, path)
    system.mkdirs(place.getParent())
    line = (json.dumps({k: v for k, v in content.items() if v is not None}) + "\n").encode()
    if system.getUri().getScheme() == "file":
        return _link(system.makeQualified(place).toUri().getPath(), line)
    try:
        stream = system.create(place, False)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getName().endswith("FileAlreadyExistsException"):
            return False
        raise
    stream.write(bytearray(line))
    stream.close()
    return True


def _link(path: str, line: bytes) -> bool:
    with tempfile.NamedTemporaryFile(dir=os.path.dirname(path), prefix=".draft-") as draft:
        draft.write(line)
        draft.flush()
        try:
            os.link(draft.name, path)
        except FileExistsError:
            return False
    return True


def read(spark: SparkSession, path: str) -> dict[str, int | str]:
    return spark.read.json(path).first().asDict()
