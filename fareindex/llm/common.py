"""Shared plumbing: read documents, map texts in Arrow batches, checkpoint."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_ROWS, SLICE_BYTES = 256, 16_000_000  # where a slice of a batch ends
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
MOST_BATCH_BYTES = 4 << 20  # a batch lies in the JVM and in its Python worker at once


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS):
    """Parts of a batch, of so many rows and about SLICE_BYTES at most."""
    lo = 0
    while lo < batch.num_rows:
        part = batch.slice(lo, rows)
        while part.num_rows > 1 and part.nbytes > SLICE_BYTES:
            part = part.slice(0, part.num_rows // 2)
        yield part
        lo += part.num_rows


def small_batches(spark: SparkSession) -> None:
    """Where the session says nothing of the bytes of an Arrow batch, make it `MOST_BATCH_BYTES`; a longer row is a batch alone."""
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(MOST_BATCH_BYTES))


def map_texts(
    df: DataFrame,
    start: Callable[[], Callable[[list], dict]],
    new: str,
    keep: Iterable[str] | None = None,
    text: str = "text",
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """`df[keep]` plus the `new` columns (DDL) that are computed from `text`.

    `start()` runs once per task and returns a function from a list of texts
    (None for null) to a dict of equally long lists. Rows go to it in slices of
    `rows`, fewer where texts are long, so a task holds few texts at a time.
    """
    keep = list(df.columns if keep is None else keep)
    fields = struct(new)
    schema = T.StructType([df.schema[k] for k in keep] + list(fields))
    arrow = to_arrow_schema(fields)
    sent = df.select(*dict.fromkeys([*keep, text]))
    small_batches(df.sparkSession)

    def run(batches):
        work = start()
        for batch in batches:
            for part in slices(batch, rows):
                out = work(part.column(text).to_pylist())
                columns = [part.column(k) for k in keep]
                columns += [pa.array(out[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, *arrow.names])

    return sent.mapInArrow(run, schema)


def gather_texts(
    df: DataFrame, start: Callable[[], tuple[Callable[[dict], None], Callable[[bool], dict | None]]], new: str
) -> DataFrame:
    """Rows that each task gathers from its batches.

    `start()` returns (`add`, `flush`). `add` gets the columns of a slice as
    lists; `flush(last)` returns rows as a dict of lists, or None while little
    is held. A task's state stays bounded by what `flush` lets it hold.
    """
    schema = struct(new)
    arrow = to_arrow_schema(schema)
    small_batches(df.sparkSession)

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], names=arrow.names)

    def run(batches):
        add, flush = start()
        for batch in batches:
            for part in slices(batch):
                add(part.to_pydict())
                if (out := flush(False)) is not None:
                    yield rows(out)
        if (out := flush(True)) is not None:
            yield rows(out)

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local one serves a local session only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` as a table written once to the shared folder: no lineage, and any executor may be lost."""
    path = f"{shared_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the decimal id, mod 5, is 0. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def hashed_share(*cols: str, seed: str = "") -> Column:
    """A repeatable number in [0, 1) for each row."""
    h = F.xxhash64(*[F.col(c) for c in cols], F.lit(seed))
    return F.pmod(h, F.lit(1 << 30)) / float(1 << 30)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
