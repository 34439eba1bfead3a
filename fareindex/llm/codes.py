"""Vector codes: each vector's 16 parts as indexes into codebooks, learnt by exact integer rounds under norm-of-sum bounds.

A part keeps, for each group of entries, a lower bound of its distance to the
entries that it isn't assigned to, with the round in which it was computed. All
codebooks stay (they are of fixed size), so a bound is lowered by how far its
entries have moved in sum since then, the net displacement, which is never more
than the sum of the single moves. Only groups whose bound doesn't exceed the
distance to the assigned entry are scanned again. A round reads one table and
writes the next, so a lost executor costs its own tasks only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareindex.llm.common import checkpointed, free_name, slices, small_batches, struct

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
GROUP = 8  # entries that share a bound
LARGEST = 1 << 26  # components are cut to this size, so that squared distances and sums stay whole numbers of 64 bits
SLACK = 1e-9  # relative error granted to square roots


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances (point, entry)."""
    out = np.zeros((len(points), len(entries)), np.int64)
    for k in range(points.shape[1]):
        apart = points[:, k, None] - entries[:, k]
        out += apart * apart
    return out


def _lower(distances: np.ndarray) -> np.ndarray:
    """Square roots as 16-bit floats that are not above them."""
    with np.errstate(over="ignore"):
        root = np.sqrt(distances.astype(float)) * (1 - SLACK)
        short = np.minimum(root, 65_504).astype(np.float16)
    return np.where(short.astype(float) > root, np.nextafter(short, np.float16(-np.inf)), short)


def displacements(history: np.ndarray, part: int) -> np.ndarray:
    """(round, group): how far an entry of the group moved at most from that round to the last, in a straight line."""
    now = history[-1, part]
    moved = np.sqrt(((history[:, part] - now).astype(float) ** 2).sum(axis=2)) * (1 + SLACK)
    return np.stack([moved[:, lo : lo + GROUP].max(axis=1) for lo in range(0, len(now), GROUP)], axis=1)


def assign(points: np.ndarray, history: np.ndarray, part: int, before=None):
    """Nearest entries of the last codebook, ties to the lower index.

    `before`: (code, bound, stamp) of an earlier round; None scans everything.
    Returns code, squared distance, bound, stamp and the number of distances
    that were computed beside those to the entries already assigned.
    """
    entries, last = history[-1, part], len(history) - 1
    edges = range(0, len(entries), GROUP)
    rows = np.arange(len(points))
    if before is None:
        code, nearest = np.zeros(len(points), np.int64), squared(points, entries[:1])[:, 0]
        bound, stamp = np.zeros((len(points), len(edges)), np.float16), np.zeros((len(points), len(edges)), np.uint8)
        open_ = np.ones((len(points), len(edges)), bool)
    else:
        code, bound, stamp = (x.copy() for x in before)
        apart = points - entries[code]
        nearest = (apart * apart).sum(axis=1)
        moved = displacements(history, part)
        lowered = bound.astype(float) - moved[stamp, np.arange(len(edges))]
        open_ = np.sqrt(nearest.astype(float))[:, None] * (1 + SLACK) >= lowered
    old, from_old = code.copy(), nearest.copy()
    scanned, work = {}, 0
    for g, lo in enumerate(edges):
        if len(at := np.flatnonzero(open_[:, g])):
            scanned[g] = at, (found := squared(points[at], entries[lo : lo + GROUP]))
            work += found.size
            pick = found.argmin(axis=1)
            least = found[np.arange(len(at)), pick]
            better = (least < nearest[at]) | (least == nearest[at]) & (lo + pick < code[at])
            code[at] = np.where(better, lo + pick, code[at])
            nearest[at] = np.minimum(least, nearest[at])
    far = np.iinfo(np.int64).max
    for g, (at, found) in scanned.items():
        own = code[at] - g * GROUP
        inside = np.flatnonzero((own >= 0) & (own < found.shape[1]))
        found[inside, own[inside]] = far
        bound[at, g], stamp[at, g] = _lower(found.min(axis=1)), last
    left = rows[(old != code) & ~open_[rows, old // GROUP]] if before is not None else rows[:0]
    if len(left):  # an entry left by its point joins those that its group's bound is for
        g = old[left] // GROUP
        lowered = np.maximum(bound[left, g].astype(float) - moved[stamp[left, g], g], 0)
        bound[left, g], stamp[left, g] = np.minimum(_lower(from_old[left]), _lower(lowered**2)), last
    return code, nearest, bound, stamp, work


def _matrix(column: pa.Array, kind, shape: tuple) -> np.ndarray:
    """Rows of equally long binaries."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, *shape)


def _binaries(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def _assigned(table: DataFrame, history: np.ndarray) -> DataFrame:
    """`table` (at, x and perhaps code, bound, stamp) with those columns for the last codebook, and `error`."""
    parts, width = history.shape[1], history.shape[3]
    groups = -(-history.shape[2] // GROUP)
    again = "code" in table.columns
    small_batches(table.sparkSession)
    history = table.sparkSession.sparkContext.broadcast(history)

    def run(batches):
        books = history.value
        for batch in batches:
            for part in slices(batch, 4_096):
                points = _matrix(part.column("x"), np.int32, (parts, width)).astype(np.int64)
                n = len(points)
                if again:
                    code = _matrix(part.column("code"), np.uint8, (parts,)).astype(np.int64)
                    bound = _matrix(part.column("bound"), np.float16, (parts, groups))
                    stamp = _matrix(part.column("stamp"), np.uint8, (parts, groups))
                done = [assign(points[:, p], books, p, (code[:, p], bound[:, p], stamp[:, p]) if again else None) for p in range(parts)]
                codes, nearest, bounds, stamps = (np.stack([d[k] for d in done], axis=1) for k in range(4))
                columns = [part.column("at"), part.column("x"), _binaries(codes.astype(np.uint8)), _binaries(bounds), _binaries(stamps)]
                work = np.zeros(n, np.int64)
                work[:1] = sum(d[4] for d in done)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(nearest.sum(axis=1)), pa.array(work)], names=["at", "x", "code", "bound", "stamp", "error", "work"])

    new = struct("code binary, bound binary, stamp binary, error long, work long")
    return table.mapInArrow(run, T.StructType([table.schema["at"], table.schema["x"], *new]))


def _sums(table: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """(part, entry, width + 1): sums of the components of the points of each entry, and their number; each task adds up its own first."""
    small_batches(table.sparkSession)

    def run(batches):
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for part in slices(batch, 4_096):
                points = _matrix(part.column("x"), np.int32, (parts, width)).astype(np.int64)
                code = _matrix(part.column("code"), np.uint8, (parts,))
                for p in range(parts):
                    np.add.at(total[p], code[:, p], np.pad(points[:, p], ((0, 0), (0, 1)), constant_values=1))
        flat = total.reshape(-1)
        cells = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(flat[cells])], names=["cell", "sum"])

    out = np.zeros(parts * entries * (width + 1), np.int64)
    for cell, value in table.select("x", "code").mapInArrow(run, "cell long, sum long").groupBy("cell").agg(F.sum("sum")).collect():  # of fixed size
        out[cell] = value
    return out.reshape(parts, entries, width + 1)


def vector_codes(
    table: DataFrame, vector: str = "embedding", order: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(`table`'s rows with a usable vector plus `code` binary and `error` long, all codebooks (round, part, entry, width), the work of each round).

    Rows whose vector is null, or holds nulls or numbers that aren't finite, go.
    Components are floor(256 x), cut to 2^26 in size. The first codebook is of
    the first rows by `order`, nulls last, ties by components; fewer rows give
    fewer entries. Vectors that aren't as long as the first one, or whose length
    isn't a multiple of `parts`, have null code and error and count nowhere.
    Repeated rows count again; an empty table gives no row and no codebook.
    New columns get longer names where `table` has theirs.
    """
    spark = table.sparkSession
    if entries > 256:
        raise ValueError("an index takes one byte")
    finite = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))
    whole = F.transform(vector, lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))
    kept = table.where(finite)
    own = free_name(kept, "components")
    rows = checkpointed(kept.withColumn(own, whole))
    at = F.struct(*[F.col(f"`{c}`") for c in kept.columns])
    first = rows.select(F.col(f"`{order}`").alias("id"), F.col(own).alias("x")).orderBy(F.asc_nulls_last("id"), "x").limit(entries).collect()
    width = len(first[0]["x"]) // parts if first and len(first[0]["x"]) % parts == 0 else 0
    fits = F.lit(bool(width)) & (F.size(own) == F.lit(width * parts))
    code, error = free_name(kept, "code"), free_name(kept, "error")
    unfit = rows.where(~fits).select(*[F.col(f"`{c}`") for c in kept.columns], F.lit(None).cast("binary").alias(code), F.lit(None).cast("long").alias(error))
    if not width:
        return unfit, np.zeros((0, parts, 0, 0), np.int64), spark.createDataFrame([], "round int, work long")
    start = np.array([r["x"] for r in first if len(r["x"]) == width * parts], np.int64).reshape(-1, parts, width).transpose(1, 0, 2)
    history = start[None]

    def packed(batches):
        for batch in batches:
            for part in slices(batch, 4_096):
                flat = part.column("x").flatten().to_numpy().astype(np.int32).reshape(-1, width * parts)
                yield pa.RecordBatch.from_arrays([part.column("at"), _binaries(flat)], names=["at", "x"])

    fitting = rows.where(fits).select(at.alias("at"), F.col(own).alias("x"))
    now = fitting.mapInArrow(packed, T.StructType([fitting.schema["at"], *struct("x binary")]))
    work = []
    for k in range(rounds + 1):
        now = checkpointed(_assigned(now if k == 0 else now.select("at", "x", "code", "bound", "stamp"), history))
        work.append((k, now.agg(F.sum("work")).first()[0]))
        if k < rounds:
            sums = _sums(now, parts, history.shape[2], width)
            n = sums[:, :, -1:]
            history = np.concatenate([history, np.where(n > 0, sums[:, :, :-1] // np.maximum(n, 1), history[-1])[None]])
    coded = now.select("at.*", F.col("code").alias(code), F.col("error").alias(error))
    return coded.unionByName(unfit), history, spark.createDataFrame(work, "round int, work long")


def codebook_digest(codebook: np.ndarray) -> str:
    """sha256 of the components as decimals, comma-joined, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, codebook.reshape(-1).tolist())).encode()).hexdigest()


def code_digest(table: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256; cases as in `vector_codes`, null labels together."""
    coded, history, _ = vector_codes(table.select("vec_id", "embedding", "label"))
    coded = checkpointed(coded.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"))
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    found = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    final = history[-1] if len(history) else np.zeros(0, np.int64)
    return found.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(final)).alias("codebooks_sha256"))
