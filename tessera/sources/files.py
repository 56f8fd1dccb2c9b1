"""Reading and writing of points, grids, lookup tables, stages and models."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POINTS = "point_id long, age int, lon double, lat double, weight double"
c = F.col


def read_points(spark: SparkSession, source: str | DataFrame, schema: str = POINTS) -> DataFrame:
    """A CSV path or a DataFrame; NaN becomes NULL."""
    df = source if isinstance(source, DataFrame) else spark.read.schema(schema).csv(source, header=True)
    return df.withColumns({f.name: F.nanvl(f.name, F.lit(None)) for f in df.schema if f.dataType.simpleString() in ("double", "float")})


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    writer.csv(path, header=True) if form == "csv" else writer.parquet(path)


def write_grid(grid: DataFrame, root: str, name: str, kind: str = "float") -> None:
    """One folder for each layer and age; values as 32-bit floats unless asked otherwise."""
    grid.withColumn("value", c("value").cast(kind)).write.mode("overwrite").partitionBy("age").parquet(f"{root}/{name}")


def read_grid(spark: SparkSession, root: str, name: str, ages: list[int] | None, required: bool = True) -> DataFrame | None:
    """A layer, only the folders of the wanted ages; None for a missing layer that isn't required.

    A wanted age without a folder is an error. The carbonate layer is 0 for ages over 170.
    """
    path = f"{root}/{name}"
    try:
        grid = spark.read.parquet(path)
    except AnalysisException as e:
        if required or e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    if ages is not None:
        have = {r["age"] for r in grid.select("age").distinct().collect()}  # one row for each folder
        if missing := sorted(set(ages) - have):
            raise FileNotFoundError(f"{path}: no ages {missing}")
        grid = grid.where(c("age").isin(ages))
    if name == "carbonate_thickness":
        grid = grid.withColumn("value", F.when(c("age") > 170, F.lit(0.0)).otherwise(c("value")))
    return grid


def read_lookup(spark: SparkSession, path: str, table_id: int, skip: int = 12) -> DataFrame:
    """A text table of temperature, pressure and value after some header lines; nodes are numbered.

    Such a file is one small table; its numbers go through windows over its distinct axes.
    """
    numeric = r"^\s*[-+0-9.eE]+\s+[-+0-9.eE]+\s+[-+0-9.eE]+\s*$"
    lines = spark.read.text(path).where(c("value").rlike(numeric))
    parts = F.split(F.trim("value"), r"\s+")
    rows = lines.select(parts[0].cast("double").alias("t_k"), parts[1].cast("double").alias("p_bar"), parts[2].cast("double").alias("v"))
    number = lambda x, out: rows.select(x).distinct().withColumn(out, (F.row_number().over(Window.orderBy(x)) - 1).cast("int"))
    out = rows.join(F.broadcast(number("p_bar", "p_idx")), "p_bar").join(F.broadcast(number("t_k", "t_idx")), "t_k")
    return out.select(F.lit(table_id).alias("table_id"), "p_idx", "t_idx", "p_bar", "t_k", c("v").alias("value"))


def materialise_once(spark: SparkSession, root: str, name: str, config: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The stage's table if it was written in full for this configuration, else built, written and read.

    A folder without the mark that Spark leaves after the last task is what a lost run left behind.
    """
    digest = hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]
    path = f"{root}/{name}-{digest}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(kind: type, path: str):
    return kind.load(path)
