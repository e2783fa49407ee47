"""A table of one row a key that is upserted on disk, in versions.

The rows lie in parts, each a folder of Parquet files. A version is a small file that names the folder of each part;
an upsert writes only the parts that get rows, beside the old ones, and then puts the next version's file in
place by a rename, last. Readers take the highest version that is there, so they never see half of an upsert: a
writer that dies before the rename leaves the table as it was. Two writers can't make the same version: the
rename of the second one fails, as its name is taken. (A store whose renames aren't atomic needs one writer.)
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.operators.merge import keep_first


class Conflict(RuntimeError):
    """Another writer has made this version."""


@dataclass(frozen=True)
class Versioned:
    """``keys`` name a row, the greatest ``version`` of a key counts (of equal ones the one that came last), and ``part`` tells a row's part.

    Parts should follow what is written together, such as a month, and be few enough to list: a version's file has a
    line for each. Rows with null keys are keys of their own.
    """

    spark: SparkSession
    path: str
    schema: str
    keys: tuple[str, ...] = ("symbol", "day_us")
    version: str = "version"
    part: str = "date_format(timestamp_micros(day_us), 'yyyy-MM')"

    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, folder = self._fs(f"{self.path}/versions")
        if not fs.exists(folder):
            return []
        names = (re.fullmatch(r"(\d+)\.json", s.getPath().getName()) for s in fs.listStatus(folder))
        return sorted(int(m[1]) for m in names if m)

    def parts(self, number: int | None = None) -> dict[str, str]:
        """The folder of each part in a version, the last one by default."""
        have = self.versions()
        if not have:
            return {}
        text = self.spark.read.text(f"{self.path}/versions/{have[-1] if number is None else number:08d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _rows(self, parts: dict[str, str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{folder}" for folder in parts.values()))

    def read(self, number: int | None = None) -> DataFrame:
        return self._rows(self.parts(number))

    def upsert(self, new: DataFrame) -> int:
        """Merges rows into the parts that they belong to; returns the number of the version that has them."""
        have = self.versions()
        before, number = self.parts(have[-1]) if have else {}, (have[-1] if have else 0) + 1
        names = StructType.fromDDL(self.schema).fieldNames()
        new = new.select(*names)
        part: Column = F.coalesce(F.expr(self.part), F.lit("none"))
        touched = [r[0] for r in new.select(part).distinct().collect()]  # as many as parts get rows
        old = self._rows({k: v for k, v in before.items() if k in touched})
        both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
        rows = keep_first(both, self.keys, [F.desc_nulls_last(self.version), F.desc("__new")]).drop("__new")
        folder = f"parts/{uuid.uuid4().hex}"
        rows.withColumn("__part", part).repartition("__part").write.partitionBy("__part").parquet(f"{self.path}/{folder}")
        fs, root = self._fs(f"{self.path}/{folder}")
        made = {self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath().getName()).toString(): None for s in fs.listStatus(root) if s.isDirectory()}
        unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        after = before | {unescape(n.removeprefix("__part=")): f"{folder}/{n}" for n in made}
        self._put(number, json.dumps(after))
        return number

    def _put(self, number: int, text: str) -> None:
        fs, at = self._fs(f"{self.path}/versions/{number:08d}.json")
        _, temp = self._fs(f"{self.path}/versions/_{uuid.uuid4().hex}")
        out = fs.create(temp, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if fs.exists(at) or not fs.rename(temp, at):
            fs.delete(temp, False)
            raise Conflict(f"version {number} has been made by another writer")

    def forget(self, keep: int = 2) -> int:
        """Drops versions but the last ``keep``, and folders that no kept version names; returns how many folders went. Not while readers use old versions."""
        have = self.versions()
        kept = {folder.split("/")[1] for n in have[-keep:] for folder in self.parts(n).values()}
        for n in have[:-keep]:
            fs, p = self._fs(f"{self.path}/versions/{n:08d}.json")
            fs.delete(p, False)
        fs, root = self._fs(f"{self.path}/parts")
        gone = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName() not in kept] if fs.exists(root) else []
        for p in gone:
            fs.delete(p, True)
        return len(gone)
