"""Writers. None overwrites anything, and none writes into what it reads."""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scratch import written
from .files import Folder


def _plain(path: str) -> str:
    return posixpath.normpath(path.removeprefix("file://").removeprefix("file:"))


def refuse_overlap(source: str, destination: str) -> None:
    """Raise if one path is the other or lies in it."""
    a, b = _plain(source), _plain(destination)
    if a == b or a.startswith(b.rstrip("/") + "/") or b.startswith(a.rstrip("/") + "/"):
        raise ValueError("source and destination overlap")


def write_plan(files: DataFrame, dirs: DataFrame, run: DataFrame, out: str, root: str) -> None:
    """The three tables of a plan or verification, below a new folder outside the scanned root."""
    a, b = _plain(root), _plain(out)
    if b == a or b.startswith(a.rstrip("/") + "/"):
        raise ValueError("the output lies in the scanned root")
    for name, df in (("files", files), ("dirs", dirs), ("run", run)):
        df.write.mode("errorifexists").parquet(f"{out}/{name}")


def run_record(spark: SparkSession, root: str, mode: str, clean: bool | None = None, term_sources: tuple[str, ...] = (), accepted: tuple[str, ...] = ()) -> DataFrame:
    """One row that says of a plan or verification what it is of, how and when it was made, and whether it came out clean."""
    row = (root, mode, datetime.now(timezone.utc), list(term_sources), list(accepted), clean)
    return spark.createDataFrame([row], "root string, mode string, at timestamp, term_sources array<string>, accepted array<string>, clean boolean")


def write_release(copies: DataFrame, content: DataFrame, source: str, destination: str) -> None:
    """Content of the files that the copy plan copies, to a new place."""
    refuse_overlap(source, destination)
    copies.filter("decision = 'copy'").select("path").join(content, "path").write.mode("errorifexists").parquet(destination)


def _outside(path: str | None) -> bool:
    """Whether a path isn't one below a folder: absolute, with a drive, empty, or with parts that lead up or nowhere."""
    parts = (path or "").replace("\\", "/").split("/")
    return parts[0].endswith(":") or "\0" in (path or "") or any(p in ("", ".", "..") for p in parts)


def write_tree(files: DataFrame, root: str) -> DataFrame:
    """Write (path, content) as files below a new or empty folder that all executors see; returns (path, size, sha256, problem).

    A row of null content, or with a path that would leave the folder, is not written and has a problem. Two rows of one path are
    an error before anything is written. Each file is moved to its place when it is whole, so a task that runs again after a loss writes
    the same files anew, and none is ever seen in part. What is returned was written once and is read back. Shuffles paths only.
    """
    tree, staging = Folder(root), f".writing-{uuid.uuid4().hex}"
    try:
        if next(iter(tree.list("")), None):
            raise FileExistsError(f"{root} is not empty")
    except FileNotFoundError:
        pass
    twice = files.groupBy(F.replace("path", F.lit("\\"), F.lit("/")).alias("path")).count().filter("count > 1 and path is not null").first()
    if twice:
        raise ValueError(f"two files of one path: {twice['path']}")

    def put(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        there = Folder(root)
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                problem = "the path leads out of the folder" if _outside(path) else "no content" if content is None else None
                if problem is None:
                    try:
                        there.write(path.replace("\\", "/"), bytes(content), staging)
                    except (FileExistsError, IsADirectoryError, NotADirectoryError) as x:  # the path of one file is a folder of another
                        problem = x.strerror or str(x)
                rows.append((path, None, None, problem) if problem else (path, len(content), hashlib.sha256(content).hexdigest(), None))
            yield pd.DataFrame(rows, columns=["path", "size", "sha256", "problem"]).astype({"size": "Int64"})

    try:
        return written(files.select("path", "content").mapInPandas(put, "path string, size long, sha256 string, problem string"), "tree")
    finally:
        tree.discard(staging)


def write_protected(hashes: DataFrame, counts: DataFrame, out: str) -> None:
    """Sorted distinct hashes, with ``pair`` and ``first`` if they have them, and counts; the key is kept elsewhere, by whoever made it."""
    hashes.select(*(c for c in ("hash", "pair", "first", "third") if c in hashes.columns)).distinct().sort("hash").write.mode("errorifexists").parquet(f"{out}/hashes")
    counts.write.mode("errorifexists").parquet(f"{out}/counts")


def next_free_version(spark: SparkSession, destination: str) -> str:
    """The path itself, or with -v2, -v3, ...: the first that does not exist."""
    jvm = spark.sparkContext._jvm
    n = 1
    while True:
        path = destination if n == 1 else f"{destination}-v{n}"
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return path
        n += 1


def encrypt_terms(store: DataFrame, key: Column) -> DataFrame:
    """(list, value BINARY): AES-GCM with a random nonce for each value, bound to the list's name."""
    return store.select("list", F.aes_encrypt(F.col("value"), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), F.concat(F.lit("item:"), F.col("list"))).alias("value"))


def decrypt_terms(store: DataFrame, key: Column) -> DataFrame:
    """(list, value): null where key, list or bytes aren't those of the encryption."""
    return store.select("list", F.try_aes_decrypt(F.col("value"), key, F.lit("GCM"), F.lit("DEFAULT"), F.concat(F.lit("item:"), F.col("list"))).cast("string").alias("value"))
