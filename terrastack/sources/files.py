"""Files through Hadoop's file systems, so that every path Spark reads works on the driver too."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def listed(spark: SparkSession, path: str) -> list[str]:
    _, p, fs = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    jvm, p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Whole or not at all: a temporary file, renamed."""
    jvm, p, fs = _fs(spark, path)
    part = _written(jvm, fs, path, text)
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    # one step: a reader finds the old file or the new one
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(part), fs.makeQualified(p), over)


def _written(jvm, fs, path: str, text: str):
    part = jvm.org.apache.hadoop.fs.Path(path + f".{jvm.java.util.UUID.randomUUID()}")
    stream = fs.create(part, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    return part


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Like ``write_text``, but of several writers the first one's file stays; the others discard theirs (False)."""
    jvm, p, fs = _fs(spark, path)
    part = _written(jvm, fs, path, text)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(part), fs.makeQualified(p), none)
    except Py4JJavaError as e:
        fs.delete(part, False)
        if not fs.exists(p):
            raise OSError(f"can't rename to {path}") from e
        return False
    return True


def rename(spark: SparkSession, old: str, new: str) -> bool:
    jvm, p, fs = _fs(spark, old)
    return bool(fs.rename(p, jvm.org.apache.hadoop.fs.Path(new)))


def delete(spark: SparkSession, path: str) -> bool:
    _, p, fs = _fs(spark, path)
    return bool(fs.delete(p, True))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; where none is set, a temporary one for a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="scratch-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"
