"""Files in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.shipping import ship


def checkpoint_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset (tests) one of our own is set."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if not root and current.isDefined():
        return current.get()
    if not root:
        root = "file://" + os.path.join(os.getcwd(), "spark-warehouse", "checkpoints")
    if not current.isDefined():
        sc.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


_folders: list[str] = []


def new_folder(spark: SparkSession, tag: str) -> str:
    """URI of a new, empty place in the shared folder for files of one run; it goes when the application ends, or scope() before."""
    uri = f"{checkpoint_root(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    ship(spark)
    fs, path = _fs(uri)
    fs.create_dir(path, recursive=True)
    _folders.append(uri)
    return uri


def table(df: DataFrame, uri: str) -> DataFrame:
    """df as a table in the shared folder: lineage is cut, and lost executors lose nothing of it."""
    df.write.mode("overwrite").parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def remove(uri: str) -> None:
    """Delete a folder of new_folder() and all that is in it."""
    fs, path = _fs(uri)
    if fs.get_file_info(path).type.name != "NotFound":
        fs.delete_dir(path)
    if uri in _folders:
        _folders.remove(uri)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """At the end, delete the folders that were made inside: what was computed from them has to be written by then."""
    before = set(_folders)
    try:
        yield
    finally:
        for uri in [x for x in _folders if x not in before]:
            remove(uri)


@atexit.register
def _remove_all() -> None:
    for uri in list(_folders):
        with contextlib.suppress(OSError):
            remove(uri)


#: A key of more than SMALL rows and more than 1 / SHARE of all is joined by a broadcast; at most SHARE keys are.
SHARE, SMALL = 1 << 14, 1 << 12


def hot_rows(total: int) -> int:
    """Rows of one key beyond which it is hot among total rows."""
    return max(SMALL, total // SHARE)


def attached(rows: DataFrame, counted: DataFrame, keys: list[str], largest: int, total: int, how: str = "inner") -> DataFrame:
    """rows with the columns of counted, which has one row and the number c of rows, at most largest, for each of the non-null
    keys. The hot ones among total rows are broadcast, which are at most SHARE."""
    most = hot_rows(total)
    if largest <= most:
        return rows.join(counted, keys, how)
    hot = F.broadcast(counted.where(F.col("c") > most))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(counted.where(F.col("c") <= most), keys, how))


def _fs(uri: str):
    from pyarrow import fs

    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parsed.path)
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, payload: bytes | memoryview) -> None:
    """Write a file under a name of this attempt, then rename it: a retried task ends with the same whole file."""
    fs, path = _fs(uri)
    attempt = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(attempt) as out:
        out.write(payload)
    fs.move(attempt, path)


def listing(uri: str, suffix: str) -> list[str]:
    """Sorted URIs of the files in a folder whose names end in suffix."""
    from pyarrow import fs as pafs

    fs, path = _fs(uri)
    names = [x.base_name for x in fs.get_file_info(pafs.FileSelector(path)) if x.base_name.endswith(suffix)]
    return [f"{uri}/{n}" for n in sorted(names)]


def mapped(uri: str, dtype, offset: int = 0, count: int = -1) -> np.ndarray:
    """Array over a memory-mapped file; a file in a store that can't be mapped is first fetched by the worker."""
    parsed = urlparse(uri)
    path = unquote(parsed.path) if parsed.scheme in ("", "file") else _fetched(uri)
    n = os.path.getsize(path) - offset
    size = np.dtype(dtype).itemsize
    count = n // size if count < 0 else count
    if not count:
        return np.zeros(0, dtype)
    return np.memmap(path, dtype=dtype, mode="r", offset=offset, shape=(count,))


#: Files that a worker keeps mapped at once; the system allows some 65,000 mappings to a process.
MAPPED = 4096


def forget(held: dict) -> None:
    """Make room in a dictionary of mapped files: the one that came first goes."""
    while len(held) >= MAPPED:
        held.pop(next(iter(held)))


def part_bits(texts: DataFrame, part_bytes: int) -> int:
    """Bits that number the parts of a table over the column text, so that a part covers part_bytes of text at any size."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(3, (-(-size // part_bytes) - 1).bit_length())


_local: dict[str, str] = {}


def _fetched(uri: str) -> str:
    if uri not in _local:
        fs, path = _fs(uri)
        folder = tempfile.mkdtemp(prefix="mapped-")
        atexit.register(shutil.rmtree, folder, True)
        target = os.path.join(folder, os.path.basename(path))
        with fs.open_input_stream(path) as src, open(target, "wb") as out:
            shutil.copyfileobj(src, out, 1 << 20)
        _local[uri] = target
    return _local[uri]
