"""Small files beside tables, through the file system that Spark itself uses for a path."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the one that ``spark.checkpoint.dir`` names and all executors share.

    Where it is unset, a local master gets a temporary folder; any other master is an error.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{found.rstrip('/')}/tables-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, folder: str, folders: bool = False) -> list[str]:
    """Names in a folder, of folders only if so asked; none where it is missing."""
    where, fs = _at(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(where) if f.isDirectory() or not folders) if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = _at(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, text: str, path: str) -> bool:
    """Write a file whole under another name and rename it to ``path``; False where that exists already."""
    folder, _, name = path.rpartition("/")
    where, fs = _at(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/.{name}-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
    try:
        # without the option to overwrite, the file system itself refuses a second writer
        context.rename(fs.makeQualified(draft), fs.makeQualified(where), spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Py4JJavaError as error:
        fs.delete(draft, False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise


def delete(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)
