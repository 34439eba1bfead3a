"""Readers and writers of the fact tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fareindex.operators.audit import upsert
from fareindex.operators.indexing import base_snapshot
from fareindex.sources.schema import INDEX_POINTS, RAW_QUOTES


def read_raw_quotes(spark: SparkSession, path: str, schema: str = RAW_QUOTES) -> DataFrame:
    """The hourly feed YYYY/MM/DD/HH.jsonl. Lines that are not JSON are kept in `corrupt`; `obs_date` is the day of collection."""
    rows = spark.read.schema(f"{schema}, corrupt string").option("columnNameOfCorruptRecord", "corrupt").json(f"{path}/*/*/*/*.jsonl")
    return with_defaults(rows).withColumn("obs_date", F.to_date("collected_at"))


def with_defaults(rows: DataFrame) -> DataFrame:
    """Older tables lack is_synthetic, which is then false."""
    given = F.coalesce("is_synthetic", F.lit(False)) if "is_synthetic" in rows.columns else F.lit(False)
    return rows.withColumn("is_synthetic", given)


def write_quotes(df: DataFrame, path: str, mode: str = "append", files_per_day: int = 16, rows_per_file: int = 4_000_000, commit: str | None = None) -> None:
    """Appends by day. A day's rows are dealt by route to `files_per_day` tasks at most, so it is neither one task nor many small files.

    With `commit`, a name of this batch, rows go to a partition of that name
    within their day, which a second write of the same batch replaces: a batch
    that is delivered again changes nothing. A table is written with names
    always or never.
    """
    deal = F.pmod(F.xxhash64("route_id", "lead_time"), F.lit(files_per_day))
    dealt = df.repartition("obs_date", deal)
    if commit is None:
        dealt.write.partitionBy("obs_date").option("maxRecordsPerFile", rows_per_file).mode(mode).parquet(path)
    else:
        named = dealt.withColumn("commit", F.lit(commit)).write.partitionBy("obs_date", "commit").option("maxRecordsPerFile", rows_per_file)
        named.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_quotes(spark: SparkSession, path: str) -> DataFrame:
    return with_defaults(spark.read.option("mergeSchema", "true").parquet(path))


def read_reference_series(spark: SparkSession, path: str, sector: str = "Combined") -> DataFrame:
    """(period, value) of one sector of the official series' nested JSON."""
    shape = "series struct<airfare_item array<struct<sector string, period string, `index` double>>>"
    items = spark.read.schema(shape).json(path, multiLine=True).select(F.explode("series.airfare_item").alias("i"))
    return items.where(F.col("i.sector") == sector).select("i.period", F.col("i.index").alias("value"))


def _matches(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that fit a glob, as the file system of the path lists them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or [])


def stored_values(spark: SparkSession, path: str, column: str = "obs_date") -> list[str]:
    """The values of a stored table's first partition column, in order, from its folders alone: no file is read."""
    return sorted(p.rsplit("=", 1)[1] for p in _matches(spark, f"{path}/{column}=*"))


def committed_days(spark: SparkSession, path: str, commit: str) -> list[str]:
    """The days that a batch of this name has written."""
    return sorted(p.rsplit("/", 2)[1].split("=", 1)[1] for p in _matches(spark, f"{path}/obs_date=*/commit={commit}"))


def store_quotes(clean: DataFrame, path: str | None = None, day: str = "obs_date", files_per_day: int = 16) -> str:
    """Clean quotes stored by day; the folder. Without `path` it lies in the shared one.

    Daily views read the partition of their day. The latest day is the last of
    `stored_values`, so none of them needs the cleaning funnel to find it.
    """
    path = path or f"{shared_folder(clean.sparkSession)}/quotes-{uuid.uuid4().hex}"
    deal = F.pmod(F.xxhash64("route_id", "lead_time"), F.lit(files_per_day))
    clean.repartition(day, deal).write.partitionBy(day).parquet(path)
    return path


def latest_quotes(spark: SparkSession, path: str, day: str = "obs_date") -> DataFrame:
    """The quotes of the last stored day; of an empty store none."""
    days = stored_values(spark, path, day)
    stored = spark.read.parquet(path)
    return stored.where(F.col(day) == F.to_date(F.lit(days[-1]))) if days else stored


def _versions(spark: SparkSession, path: str) -> dict[str, str]:
    """month -> the folder of its newest version. A version counts once its job has committed (its _SUCCESS is there)."""
    done = {p.rsplit("/", 1)[0] for p in _matches(spark, f"{path}/version=*/_SUCCESS")}
    months: dict[str, str] = {}
    for folder in _matches(spark, f"{path}/version=*/month=*"):  # in order of versions
        version, month = folder.rsplit("/", 1)
        if version in done:
            months[month] = folder
    return months


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """The points of every month in its newest version."""
    schema = f"{INDEX_POINTS}, month string"
    months = _versions(spark, path)
    if not months:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(*months.values())


def upsert_points(spark: SparkSession, path: str, new: DataFrame, key: str = "date") -> None:
    """Writes the months that `new` touches as a new version, each with its other dates kept.

    Nothing that is stored changes: the version is a folder of its own, and
    readers see it when its job commits, which is one file's creation. A write
    that fails leaves the points as they were. Two writers at once can't both
    have the same version: the second one fails.
    """
    rows = new.withColumn("month", F.date_format(key, "yyyy-MM"))
    stored = read_points(spark, path)
    touched = stored.join(rows.select("month").distinct(), "month", "left_semi")
    merged = upsert(touched.select(*[c for c in rows.columns if c in touched.columns]), rows, (key,))
    last = _matches(spark, f"{path}/version=*")
    version = int(last[-1].rsplit("=", 1)[1]) + 1 if last else 1
    merged.repartition("month").write.partitionBy("month").mode("errorifexists").parquet(f"{path}/version={version:09d}")


def forget_versions(spark: SparkSession, path: str) -> int:
    """Deletes the versions' months that newer ones replace, and versions that never committed; how many folders went. For quiet hours: a reader may still hold an old one."""
    kept = set(_versions(spark, path).values())
    done = {p.rsplit("/", 1)[0] for p in _matches(spark, f"{path}/version=*/_SUCCESS")}
    old = [f for f in _matches(spark, f"{path}/version=*/month=*") if f not in kept]
    old += [v for v in _matches(spark, f"{path}/version=*") if v not in done]
    for folder in old:
        where = spark._jvm.org.apache.hadoop.fs.Path(folder)
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    return len(old)


def load_or_seed_base(spark: SparkSession, path: str, prices: DataFrame, base: str, **options) -> DataFrame:
    """The stored base snapshot; the first call computes and stores it."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        base_snapshot(prices, base, **options).write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. Where none is set, a local one serves a local session only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def store_cells(cells: DataFrame, path: str | None = None) -> DataFrame:
    """The cell table, written once and read back: all that is made of it, however often it is used, costs one cleaning funnel.

    Cells are days x routes x lead windows, a small part of the quotes. Without
    `path` the table goes to the shared folder.
    """
    spark = cells.sparkSession
    path = path or f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    cells.write.parquet(path)
    return spark.read.schema(cells.schema).parquet(path)


def write_backtest_csv(table: DataFrame, path: str) -> None:
    """One headed file: the table has a row per month."""
    table.coalesce(1).write.mode("overwrite").csv(path, header=True)
