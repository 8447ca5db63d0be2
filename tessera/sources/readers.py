"""Readers and writers: text tables with a guessed separator, JSON and GeoJSON, archives, workbooks, snapshots, queries."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sniff_separator(spark: SparkSession, path: str) -> str | None:
    """; tab or , by the first ten lines; None for white space."""
    lines = [r[0] for r in spark.read.text(path).limit(10).collect() if r[0].strip()]
    for sep in (";", "\t", ","):
        if lines and all(sep in x for x in lines):
            return sep
    return None


def read_table(spark: SparkSession, path: str, kind: str | None = None, **options) -> DataFrame:
    """A table by its ending: csv, txt (also .gz), tsv, data and names (no header), parquet, json, geojson, orc."""
    kind = kind or path.lower().removesuffix(".gz").rpartition(".")[2]
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind == "orc":
        return spark.read.orc(path)
    if kind == "json":
        return read_json(spark, path)
    if kind == "geojson":
        return read_geojson(spark, path)
    header = kind not in ("data", "names")
    sep = "\t" if kind == "tsv" else options.pop("sep", None) or sniff_separator(spark, path)
    if sep is None:
        return read_whitespace(spark, path, header)
    return spark.read.csv(path, sep=sep, header=header, inferSchema=options.pop("inferSchema", True), **options)


def read_whitespace(spark: SparkSession, path: str, header: bool) -> DataFrame:
    lines = spark.read.text(path).where("trim(value) <> ''")
    first = lines.first()[0].split()
    names = first if header else [f"_c{i}" for i in range(len(first))]
    rows = lines.select(F.split(F.trim("value"), r"\s+").alias("p"))
    rows = rows.where(F.col("p") != F.array(*map(F.lit, first))) if header else rows
    return rows.select(*(F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names)))


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as columns named a.b."""
    def leaves(schema: T.StructType, path: list[str]):
        for f in schema:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, [*path, f.name])
            else:
                yield [*path, f.name]

    return df.select(*(F.col(".".join(f"`{x}`" for x in p)).alias(".".join(p)) for p in leaves(df.schema, [])))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.json(path, multiLine=True)
    if "results" in df.columns and isinstance(df.schema["results"].dataType, T.ArrayType):
        df = df.select(F.explode("results").alias("r")).select("r.*")
    return flatten(df)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    f = spark.read.json(path, multiLine=True).select(F.explode("features").alias("f"))
    at = F.col("f.geometry.coordinates")
    return f.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.get(at, F.lit(0)).alias("longitude"), F.get(at, F.lit(1)).alias("latitude"), F.get(at, F.lit(2)).alias("elevation_or_depth"))


def read_zip(spark: SparkSession, path: str, suffix: str = ".csv") -> DataFrame:
    """(path, member, line_no, line) of the archives' members with the suffix; one archive is one task's work."""
    def run(batches: Iterator) -> Iterator:
        import io
        import zipfile

        import pandas as pd

        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for m in sorted(x for x in z.namelist() if x.endswith(suffix)):
                        lines = z.read(m).decode("utf-8", "replace").splitlines()
                        yield pd.DataFrame({"path": p, "member": m, "line_no": range(len(lines)), "line": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, line_no long, line string")


def list_zip(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator) -> Iterator:
        import io
        import zipfile

        import pandas as pd

        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                infos = zipfile.ZipFile(io.BytesIO(content)).infolist()
                yield pd.DataFrame({"path": p, "member": [i.filename for i in infos], "compressed_size": [i.compress_size for i in infos], "file_size": [i.file_size for i in infos]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, compressed_size long, file_size long")


def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row_no, cells) of workbooks; the executors need openpyxl."""
    def run(batches: Iterator) -> Iterator:
        import io

        import pandas as pd
        from openpyxl import load_workbook

        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"]):
                book = load_workbook(io.BytesIO(content), read_only=True)
                for s in book.worksheets:
                    rows = [[None if v is None else str(v) for v in r] for r in s.iter_rows(values_only=True)]
                    yield pd.DataFrame({"path": p, "sheet": s.title, "row_no": range(len(rows)), "cells": rows})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, sheet string, row_no long, cells array<string>")


def query_source(spark: SparkSession, statement: str, params: dict | None = None, views: dict[str, DataFrame] | None = None) -> DataFrame:
    """A SQL statement with named parameters over views."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(statement, args=params or {})


def read_jdbc(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def query_fingerprint(spark: SparkSession, source: str, statement: str, params: dict | None = None, store: bool = True) -> DataFrame:
    """One lineage row: hash of source, query and parameters; the text only where it may be stored."""
    digest = hashlib.sha256(json.dumps({"source": source, "query": statement, "params": params or {}}, sort_keys=True).encode()).hexdigest()
    return spark.createDataFrame([(source, digest, statement if store else None, sorted(params or {}), store)], "source string, fingerprint string, query string, param_names array<string>, replayable boolean")


def preview_source(df: DataFrame, n: int = 100) -> DataFrame:
    return df.limit(n)


def list_objects(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t.name, t.tableType, t.isTemporary) for t in spark.catalog.listTables()], "name string, kind string, temporary boolean")


def write_snapshot(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Parquet and one metadata row; maps become JSON text."""
    maps = {f.name: F.to_json(f.name) for f in df.schema if isinstance(f.dataType, T.MapType)}
    df.withColumns(maps).write.mode(mode).parquet(path)
    back = df.sparkSession.read.parquet(path)
    return back.agg(F.lit(path).alias("path"), F.count("*").alias("rows"), F.lit(len(back.columns)).alias("columns"))


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
