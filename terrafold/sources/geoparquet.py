"""GeoParquet: Parquet with a geo key in the footers. Scans, pruning and row-group filters are Spark's own.

Reading attaches the key's column metadata to the geometry columns. Writing adds a covering box column, on which a
filter can skip row groups, and writes the key through a footer rewrite of each finished file.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import columns as C
from terrafold.session import ship

VERSION = "1.1.0"


def _files(spark: SparkSession, path: str) -> list[str]:
    """Parquet files below a path, listed by Spark's file index (works in any store that Spark reads)."""
    return list(spark.read.parquet(path).inputFiles())


def metadata(file: str) -> dict:
    """The geo key of one file; empty if it has none."""
    fs, name = pafs.FileSystem.from_uri(file)
    found = (pq.read_metadata(name, filesystem=fs).metadata or {}).get(b"geo")
    return json.loads(found) if found else {}


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table; geometry columns keep WKB and carry encoding and crs in their column metadata."""
    ship(spark)
    df = spark.read.parquet(path)
    files = df.inputFiles()
    columns = metadata(files[0]).get("columns", {}) if files else {}
    for name, about in columns.items():
        if name in df.columns:
            df = df.withMetadata(name, {"encoding": about.get("encoding", "WKB"), "geometry_types": json.dumps(about.get("geometry_types", [])), "crs": json.dumps(about["crs"]) if about.get("crs") is not None else ""})
    return df


def write(df: DataFrame, path: str, geometry: str = "geometry", covering: bool = True, crs: dict | None = None, mode: str = "errorifexists") -> None:
    """Write df with its geo key; covering adds a struct column named bbox, so df must not have one. Appending leaves older files as they are."""
    spark = df.sparkSession
    ship(spark)
    if covering and "bbox" in [c.lower() for c in df.columns]:
        raise ValueError("df has a column named bbox: rename it or write with covering=False")
    before = set(_files(spark, path)) if mode == "append" else set()
    if covering:
        df = df.withColumn("bbox", C.box2d(geometry))
    df.write.mode(mode).parquet(path)
    files = [f for f in _files(spark, path) if f not in before]
    about: dict = {"encoding": "WKB", "geometry_types": []}
    if crs is not None:
        about["crs"] = crs
    if covering:
        about["covering"] = {"bbox": {k: ["bbox", k] for k in ("xmin", "ymin", "xmax", "ymax")}}
    key = json.dumps({"version": VERSION, "primary_column": geometry, "columns": {geometry: about}})

    def stamp(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in frames:
            for file in rb.column(0).to_pylist():
                fs, name = pafs.FileSystem.from_uri(file)
                with fs.open_input_file(name) as src:
                    old = pq.ParquetFile(src)
                    schema = old.schema_arrow.with_metadata({**(old.schema_arrow.metadata or {}), **{k: v for k, v in (old.metadata.metadata or {}).items() if k != b"ARROW:schema"}, b"geo": key.encode()})
                    with fs.open_output_stream(f"{name}.tmp") as out, pq.ParquetWriter(out, schema) as w:
                        for k in range(old.num_row_groups):  # a row group at a time
                            w.write_table(old.read_row_group(k).cast(schema))
                fs.move(f"{name}.tmp", name)
                folder, _, base = name.rpartition("/")
                crc = fs.get_file_info(f"{folder}/.{base}.crc")
                if crc.type == pafs.FileType.File:  # Hadoop's checksum of the former content
                    fs.delete_file(crc.path)
            yield pa.RecordBatch.from_pydict({"n": [rb.num_rows]})

    if files:
        todo = spark.createDataFrame([(f,) for f in files], "file string").repartition(len(files))
        todo.mapInArrow(stamp, "n long").agg(F.sum("n")).collect()


def read_box(spark: SparkSession, path: str, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Rows whose covering box meets a box; the comparisons reach the Parquet scan."""
    b = F.col("bbox")
    return read(spark, path).where((b["xmin"] <= x1) & (b["xmax"] >= x0) & (b["ymin"] <= y1) & (b["ymax"] >= y0))
