"""Small files and renames on whatever file system a path is of."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write aside and rename, so that a reader never sees half a file."""
    fs, p = _fs(spark, path)
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    sc = spark.sparkContext
    rename = sc._jvm.org.apache.hadoop.fs.Options.Rename
    how = sc._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    files = sc._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
    files.rename(fs.makeQualified(aside), fs.makeQualified(p), how)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the checkpoint folder that executors share, or on one machine in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/tidewell-{name}-{uuid.uuid4().hex}"


def _mounted(fs, path) -> str | None:
    """Where the machines' own file systems have a path, if they do."""
    return fs.makeQualified(path).toUri().getPath() if fs.getUri().getScheme() == "file" else None


def data_files(spark: SparkSession, folder: str) -> list[str]:
    """The data files of a folder that have any bytes, by name."""
    fs, p = _fs(spark, folder)
    return sorted(f.getPath().toString() for f in fs.listStatus(p) if not f.getPath().getName().startswith(("_", ".")) and f.getLen())


@contextmanager
def local_file(spark: SparkSession, path: str) -> Iterator[str]:
    """A file as one of this machine; a copy, where one is needed, lasts as long as the context."""
    fs, p = _fs(spark, path)
    if (found := _mounted(fs, p)) is not None:
        yield found
        return
    with tempfile.TemporaryDirectory(prefix="tidewell-") as here:
        copy = f"{here}/part"
        fs.copyToLocalFile(False, p, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{copy}"), True)
        yield copy


def mounted(spark: SparkSession, path: str) -> str:
    """Where all machines have mounted a path, for a file that isn't written by this file system."""
    if (found := _mounted(*_fs(spark, path))) is None:
        raise RuntimeError(f"{path} is on no file system that the machines have mounted")
    return found


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def moved(spark: SparkSession, old: str, new: str) -> None:
    """Rename a file into a folder that may be new."""
    fs, p = _fs(spark, old)
    to = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new)
    fs.mkdirs(to.getParent())
    if not fs.rename(p, to):
        raise OSError(f"{old} can't be moved to {new}")


def swap(spark: SparkSession, staged: str, target: str) -> None:
    """Put ``staged`` in the place of ``target``; what was there goes only when the new is in place."""
    fs, new = _fs(spark, staged)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    old, aside = path(target), path(f"{target.rstrip('/')}.old-{uuid.uuid4().hex}")
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        raise OSError(f"{target} can't be moved aside")
    if not had and old.getParent() is not None:
        fs.mkdirs(old.getParent())
    if not fs.rename(new, old):
        if had:
            fs.rename(aside, old)
        raise OSError(f"{target} can't be replaced")
    if had:
        fs.delete(aside, True)


def _data(name: str, suffix: str) -> bool:
    own = name.rsplit("/", 1)[-1]
    return own.endswith(suffix) and not own.startswith(("_", "."))


def listed(spark: SparkSession, path: str, suffix: str = "") -> list[str]:
    """The full names of data files below a folder."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    found, it = [], fs.listFiles(p, True)
    while it.hasNext():
        found.append(it.next().getPath().toString())
    return sorted(f for f in found if _data(f, suffix))


def newer(spark: SparkSession, path: str, suffix: str, than: int) -> tuple[list[str], int]:
    """Data files below a folder that changed after a time (milliseconds), and the time of the newest of all."""
    fs, p = _fs(spark, path)
    found = []
    if fs.exists(p):
        it = fs.listFiles(p, True)
        while it.hasNext():
            status = it.next()
            found.append((status.getPath().toString(), status.getModificationTime()))
    found = [(f, at) for f, at in found if _data(f, suffix)]
    return sorted(f for f, at in found if at > than), max((at for _, at in found), default=0)


def below(spark: SparkSession, path: str, names: list[str], *, uri: bool = False) -> list[str]:
    """The parts of files' or folders' full names (or URIs, whose letters may be escaped) after the folder ``path``."""
    fs, p = _fs(spark, path)
    base = fs.makeQualified(p).toUri().getPath().rstrip("/") + "/"
    out = []
    for name in names:
        full = re.sub(r"^[A-Za-z][\w+.-]*:(?://[^/]*)?", "", name)
        full = unquote(full) if uri else full
        if not full.startswith(base):
            raise ValueError(f"{name} is not below {path}")
        out.append(full[len(base) :])
    return out


def joined(spark: SparkSession, path: str, name: str) -> str:
    """A path below a folder, with the signs of patterns in ``name`` taken as they are."""
    escaped = "".join(f"\\{c}" if c in "{}[]*?\\" else c for c in name)
    return f"{path.rstrip('/')}/{escaped}"
