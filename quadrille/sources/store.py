"""Files by URI, from the driver or an executor: local paths, HDFS, object stores."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of the session that all machines see (spark.checkpoint.dir); where none is set a temporary one, in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/quadrille-{spark.sparkContext.applicationId}"


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one; it goes when the driver's JVM ends in good order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/quadrille-{uuid.uuid4().hex[:12]}-{label}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return path.toString()


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":/" in uri else os.path.abspath(uri))


def read_bytes(uri: str, start: int = 0, size: int | None = None) -> bytes:
    store, path = opened(uri)
    with store.open_input_file(path) as f:
        f.seek(start)
        return f.read(size) if size is not None else f.read()


def write_bytes(uri: str, data: bytes) -> None:
    """Write under a name of its own, then move: a reader never sees half a file, and a repeated task ends the same."""
    store, path = opened(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{os.getpid()}.{os.urandom(4).hex()}.part"
    with store.open_output_stream(part, compression=None) as out:
        out.write(data)
    store.move(part, path)


def listed(uri: str, extensions: tuple[str, ...], recursive: bool = True) -> list[tuple[str, int]]:
    """(path, bytes) of one file, or of those below a folder with one of the extensions in either case."""
    store, path = opened(uri)
    info = store.get_file_info(path)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == fs.FileType.File:
        return [(uri, info.size)]
    prefix = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
    found = [f for f in store.get_file_info(fs.FileSelector(path, recursive=recursive)) if f.type == fs.FileType.File]
    return sorted((prefix + f.path, f.size) for f in found if f.path.rpartition(".")[2].lower() in extensions)
