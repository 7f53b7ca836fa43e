"""Files that appear whole and once, whoever else writes them."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class AlreadyThere(Exception):
    """Another writer was first."""


def create_once(spark: SparkSession, path: str, content: bytes) -> None:
    """Writes a file beside path and gives it that name, if no file has it: of several writers one gets through, and no
    reader sees a part. On the local file system by a hard link, which never replaces; elsewhere by a rename that the
    file system refuses where the name is taken."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    made = jvm.org.apache.hadoop.fs.Path(place.getParent(), f".new-{uuid.uuid4().hex}")
    stream = fs.create(made, False)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
    try:
        if fs.getScheme() == "file":
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(place), local(made))
        else:
            no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(made, place, no_options)
    except Exception as e:
        if fs.exists(place):
            raise AlreadyThere(path) from e
        raise
    finally:
        fs.delete(made, False)
