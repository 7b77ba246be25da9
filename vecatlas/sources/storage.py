"""Marks and folders through Hadoop's file system API, so that every Spark storage works."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Storage:
    def __init__(self, spark: SparkSession) -> None:
        self._spark = spark

    def _at(self, path: str):
        place = self._spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self._spark._jsc.hadoopConfiguration()), place

    def exists(self, path: str) -> bool:
        fs, place = self._at(path)
        return fs.exists(place)

    def names(self, folder: str) -> list[str]:
        fs, place = self._at(folder)
        names = [entry.getPath().getName() for entry in fs.listStatus(place)] if fs.exists(place) else []
        return sorted(name for name in names if not name.startswith((".", "_")))

    def touch(self, path: str) -> None:
        fs, place = self._at(path)
        fs.create(place, True).close()

    def delete(self, path: str) -> None:
        fs, place = self._at(path)
        fs.delete(place, True)
