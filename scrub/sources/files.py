"""Files of a tree as a table, hidden ones too.

Spark's own file readers pass over names that begin with ``.`` or ``_``, the very files that matter here. So folders are listed by tasks, all
folders of one depth in one round, a row for each: one huge folder of folders is many tasks. Files are read where the tasks run. Local paths
are taken as they are; other URIs (hdfs, s3, gs, abfs) go through the file systems of pyarrow, with the credentials that these find on the executors.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterable, Iterator
from typing import Any, BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import written
from ..operators.content import MAX_TEXT
from ..operators.paths import classify_name, prune_ignored_dirs

LISTED = "path string, size long, mtime_ns long, is_symlink boolean, problem string"
#: Bytes of a file that are read at once, and bytes of contents that a worker holds before it hands them on.
BLOCK, HELD = 1 << 20, 8 << 20


class Folder:
    """A folder that all executors see, by a path or URI."""

    def __init__(self, root: str):
        self.root = root.removeprefix("file://").removeprefix("file:").rstrip("/") or "/"
        self.fs: Any = None
        if "://" in self.root:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(self.root)
            self.root = self.root.rstrip("/")

    def list(self, folder: str) -> Iterator[tuple]:
        """(name, size, mtime_ns, is_symlink, is_dir, problem) of what lies in a folder, by its path below the root. Links are not followed."""
        if self.fs is not None:
            from pyarrow import fs

            for info in self.fs.get_file_info(fs.FileSelector(f"{self.root}/{folder}" if folder else self.root)):
                yield info.base_name, info.size, info.mtime_ns, False, info.type == fs.FileType.Directory, None
            return
        with os.scandir(os.path.join(self.root, folder)) as entries:
            for e in entries:
                try:
                    stat = e.stat(follow_symlinks=False)
                    yield e.name, stat.st_size, stat.st_mtime_ns, e.is_symlink(), e.is_dir(follow_symlinks=False), None
                except OSError as x:
                    yield e.name, None, None, None, False, x.strerror

    def open(self, path: str) -> BinaryIO:
        return self.fs.open_input_stream(f"{self.root}/{path}") if self.fs is not None else open(os.path.join(self.root, path), "rb")

    def write(self, path: str, content: bytes, staging: str) -> None:
        """A file, whole or not at all: it is written beside the tree, below ``staging``, and moved to its place."""
        target, part = f"{self.root}/{path}", f"{self.root}{staging}/{uuid.uuid4().hex}"
        if self.fs is not None:
            self.fs.create_dir(target.rpartition("/")[0], recursive=True)
            self.fs.create_dir(part.rpartition("/")[0], recursive=True)
            with self.fs.open_output_stream(part) as f:
                f.write(content)
            self.fs.move(part, target)
            return
        os.makedirs(os.path.dirname(target), exist_ok=True)
        os.makedirs(os.path.dirname(part), exist_ok=True)
        with open(part, "wb") as f:
            f.write(content)
        os.replace(part, target)

    def discard(self, staging: str) -> None:
        """What lost tasks left below ``staging``."""
        if self.fs is None:
            shutil.rmtree(self.root + staging, ignore_errors=True)
            return
        from pyarrow import fs

        if self.fs.get_file_info(self.root + staging).type == fs.FileType.Directory:
            self.fs.delete_dir(self.root + staging)


def list_files(spark: SparkSession, root: str, partitions: int | None = None) -> DataFrame:
    """(path relative to root, size, mtime_ns, is_symlink, problem) of all files below a folder that all executors see.

    Links are listed, not followed; what can't be read has a problem. There are as many rounds as the tree is deep; each is written to
    the shared folder, so that no round is run twice. The driver gets the number of folders of a round only.
    """

    def walk(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Folder(root)
        for frame in frames:
            for folder in frame["folder"]:
                try:
                    rows = [(f"{folder}/{name}" if folder else name, *rest) for name, *rest in tree.list(folder)]
                except OSError as x:
                    rows = [(folder, None, None, None, False, x.strerror or str(x))]
                yield pd.DataFrame(rows, columns=["path", "size", "mtime_ns", "is_symlink", "is_dir", "problem"])

    most, rounds = partitions or 4 * spark.sparkContext.defaultParallelism, []
    folders, n = spark.createDataFrame([("",)], "folder string"), 1
    while n:
        entries = written(folders.repartition(min(n, most)).mapInPandas(walk, LISTED.replace("problem", "is_dir boolean, problem")), "listing")
        rounds.append(entries.filter("not is_dir").drop("is_dir"))
        folders = entries.filter("is_dir").select(F.col("path").alias("folder"))
        n = folders.count()
    top = rounds[0].filter("path = ''").first()
    if top:
        raise OSError(f"{root} can't be listed: {top['problem']}")
    out = rounds[0]
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out


def read_file(file: BinaryIO, keep: int = MAX_TEXT + 1) -> tuple[bytes, str]:
    """(the first ``keep`` bytes, SHA-256 of all) of a file, in one pass that holds no more than these and a block."""
    digest, head, size = hashlib.sha256(), [], 0
    while block := file.read(BLOCK):
        digest.update(block)
        if size < keep:
            head.append(block[: keep - size])
            size += len(head[-1])
    return b"".join(head), digest.hexdigest()


def read_content(files: DataFrame, root: str) -> DataFrame:
    """The listed files with content (its first bytes, one more than are scanned at most) and sha256 of the whole file.

    Files that their name excludes, and links, aren't opened, and what can't be read has neither (null).
    """

    def read(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Folder(root)
        for f in frames:
            wanted, begin, held = f.pop("_read"), 0, 0
            found: list[tuple[bytes | None, str | None]] = []
            for i, (path, yes) in enumerate(zip(f["path"], wanted, strict=True)):
                try:
                    if yes:
                        with tree.open(path) as x:
                            found.append(read_file(x))
                    else:
                        found.append((None, None))
                except OSError:
                    found.append((None, None))
                held += len(found[-1][0] or b"")
                if held > HELD or i + 1 == len(f):
                    yield f.iloc[begin : i + 1].assign(content=[c for c, _ in found], sha256=[h for _, h in found])
                    begin, held, found = i + 1, 0, []

    excluded = classify_name(F.col("path"))["status"].eqNullSafe("EXCLUDE") | F.coalesce("is_symlink", F.lit(True))
    return files.withColumn("_read", ~excluded).mapInPandas(read, f"{LISTED}, content binary, sha256 string")


def read_tree(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(files with content outside ignored folders, the ignored folders)."""
    kept, dirs = prune_ignored_dirs(list_files(spark, root))
    return read_content(kept.select("path", "size", "mtime_ns", "is_symlink", "problem"), root), dirs


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """A table of fewer input splits than ``partitions`` (the session's cores by default), its rows dealt out to so many; others stay as they are.

    A small file of one row group is one task, however many cores wait. Only such tables are moved, once; large ones have more splits than that.
    """
    wanted = partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def corpus_from_table(df: DataFrame, id_col: str, text_col: str, path_col: str | None = None, partitions: int | None = None) -> DataFrame:
    """Any table of texts as a corpus (id, text, path). With ``partitions`` a table of fewer splits is dealt out to so many (``spread``)."""
    path = F.col(path_col) if path_col else F.col(id_col).cast("string")
    out = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), path.alias("path"))
    return spread(out, partitions) if partitions else out
