"""Folders of any store that Spark reaches: names, and renames that either
happen whole or not at all (on stores whose rename is atomic, as HDFS's is;
object stores need a committer of their own)."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import SparkSession


def path_of(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def system(spark: SparkSession, path: str):
    return path_of(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return system(spark, path).exists(path_of(spark, path))


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    return [f.getPath().getName() for f in system(spark, folder).listStatus(path_of(spark, folder))] if exists(spark, folder) else []


def delete(spark: SparkSession, path: str) -> None:
    system(spark, path).delete(path_of(spark, path), True)


def put(spark: SparkSession, aside: str, final: str) -> bool:
    """Renames ``aside`` to ``final``; False, with nothing changed, if there is
    something already."""
    jvm = spark._jvm
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    source = path_of(spark, aside)
    qualified = system(spark, aside).makeQualified(source)
    if exists(spark, final):
        return False
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), spark._jsc.hadoopConfiguration()).rename(source, path_of(spark, final), none)
    except Exception as e:
        if "FileAlreadyExists" in str(e) or "cannot overwrite" in str(e) or "not empty" in str(e):
            return False
        raise
    return True


def publish(spark: SparkSession, folder: str, outputs: Mapping[str, Callable[[str], None]]) -> None:
    """Publishes several results of one build together.

    Each writer of ``outputs`` (name: writer of a path) writes aside. Only when
    all have, and nothing but folders stands where the results go, are the old
    results moved away and the new ones into place; if any step fails, what was
    moved goes back and the old set stands as it was."""
    token = uuid.uuid4().hex
    aside, away = f"{folder}/.writing-{token}", f"{folder}/.replaced-{token}"
    system(spark, folder).mkdirs(path_of(spark, folder))
    moved, placed = [], []
    try:
        for name, write in outputs.items():
            write(f"{aside}/{name}")
        for name in outputs:
            if not exists(spark, f"{aside}/{name}"):
                raise FileNotFoundError(f"nothing was written for {name}")
            final = path_of(spark, f"{folder}/{name}")
            if exists(spark, f"{folder}/{name}") and not system(spark, folder).getFileStatus(final).isDirectory():
                raise FileExistsError(f"{name} is a file of something else")
        system(spark, folder).mkdirs(path_of(spark, away))
        for name in outputs:
            if exists(spark, f"{folder}/{name}"):
                move(spark, f"{folder}/{name}", f"{away}/{name}")
                moved.append(name)
            move(spark, f"{aside}/{name}", f"{folder}/{name}")
            placed.append(name)
    except BaseException:
        for name in placed:
            delete(spark, f"{folder}/{name}")
        for name in moved:
            move(spark, f"{away}/{name}", f"{folder}/{name}")
        raise
    finally:
        delete(spark, aside)
        delete(spark, away)


def move(spark: SparkSession, source: str, final: str) -> None:
    if not put(spark, source, final):
        raise FileExistsError(final)
