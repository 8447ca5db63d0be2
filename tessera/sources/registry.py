"""Named sources: kind, options and fingerprint in a table, read by name in this session or a later one."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

SCHEMA = "name string, kind string, path string, options string, columns string, fingerprint string, place long"


class SourceRegistry:
    """Sources below a folder: register(), read(), list(), objects(). Every kind that Spark reads, and Python data sources, are kinds."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def add_kind(self, source: type[DataSource]) -> str:
        """Makes a Python data source known to the session; its partitions are read in as many tasks."""
        self.spark.dataSource.register(source)
        return source.name()

    @property
    def table(self) -> DataFrame:
        """The sources, of each name the one registered last."""
        try:
            every = self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/sources/*")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)
        last = every.groupBy("name").agg(F.max_by(F.struct(*every.columns), "place").alias("x"))
        return last.select("x.*")

    def register(self, name: str, kind: str, path: str | None = None, **options) -> str:
        """Registers or replaces a source; returns its fingerprint, a digest of kind, path, options and columns."""
        df = self._read(kind, path, options)
        columns = json.dumps([[f.name, f.dataType.simpleString()] for f in df.schema.fields])
        said = json.dumps(options, sort_keys=True, default=str)
        print_ = hashlib.sha256(json.dumps([kind, path, said, columns]).encode()).hexdigest()
        place = (self.table.agg(F.max("place")).first()[0] or 0) + 1
        self.spark.createDataFrame([(name, kind, path, said, columns, print_, place)], SCHEMA).coalesce(1).write.parquet(f"{self.folder}/sources/{uuid.uuid4().hex}")
        return print_

    def _read(self, kind: str, path: str | None, options: dict) -> DataFrame:
        reader = self.spark.read.format(kind).options(**options)
        return reader.load(path) if path else reader.load()

    def read(self, name: str) -> DataFrame:
        """The source's rows; raises for an unknown name, and where its columns are no longer those registered."""
        r = self.table.where(F.col("name") == name).first()
        if r is None:
            raise ValueError(f"no source named {name!r}")
        df = self._read(r["kind"], r["path"], json.loads(r["options"]))
        now = json.dumps([[f.name, f.dataType.simpleString()] for f in df.schema.fields])
        if now != r["columns"]:
            raise ValueError(f"{name!r} has other columns than when it was registered: {now}")
        return df

    def objects(self) -> DataFrame:
        """name, column_name, data_type for each column of each source."""
        parsed = F.from_json("columns", "array<array<string>>")
        return self.table.select("name", F.explode(parsed).alias("c")).select("name", F.col("c")[0].alias("column_name"), F.col("c")[1].alias("data_type"))
