"""A log of commits in a shared folder: each version is a small file that exactly one writer can put there."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer has committed the version."""


class Log:
    """The commits of a store. What a commit names was written before, so readers that start from the log see all of it or nothing.

    folder: any that Hadoop's file systems reach and that renames files as one step.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def commits(self) -> list[dict]:
        """The log in order, a dictionary a commit, with its version from 1 on."""
        fs, path = self._path("commits")
        if not fs.exists(path) or not len(fs.listStatus(path)):
            return []
        lines = self.spark.read.text(f"{self.folder}/commits").collect()
        return sorted((json.loads(r["value"]) for r in lines), key=lambda c: c["version"])

    def new_folder(self) -> str:
        """A folder of no other writer's, for what a commit will name."""
        return f"{self.folder}/data/{uuid.uuid4().hex}"

    def remove(self, folder: str) -> None:
        fs, path = self._path("")
        fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder), True)

    def commit(self, entry: dict) -> None:
        """Puts entry["version"] there unless it is: the file is written aside and renamed, which fails if another has the name."""
        fs, aside = self._path(f"aside/{uuid.uuid4().hex}")
        _, path = self._path(f"commits/{entry['version']:012d}")
        out = fs.create(aside)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        fs.mkdirs(path.getParent())
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        options = self.spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        options[0] = hadoop.Options.Rename.NONE
        try:
            hadoop.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(aside), fs.makeQualified(path), options)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                raise Conflict(entry["version"]) from None
            raise
