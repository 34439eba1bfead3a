"""SimHash near-duplicates through covering locality-sensitive hashing.

Fingerprints within `RADIUS` bits are found with 2^(RADIUS+1) - 1 bit masks built
so that every such pair agrees on all kept bits of at least one mask. Members of
a small bucket are compared there and give a spanning forest of links, not pairs;
those of a crowded bucket meet at the points one bit away from them.

Two bits hold copies and nearly equal texts. `keep_representatives` also links
texts whose sets of shingles are alike (`SIMILAR`): such texts differ in about
ten bits, which would take 2,047 masks, so candidates for these come from the
bands of `minhash`: first those at the ends of a band's bucket, then all that
buckets still hold apart, each decided on whole sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareindex.llm.common import checkpointed, free_name, map_texts, slices

RADIUS = 2
SEED = 42
SHINGLE = 3
BITS = 64
SLICE_SHINGLES = 1 << 16  # shingles whose bits are counted at once
COMPARED = 1_024  # prints of a bucket that are compared with each other; more meet at points
SIMILAR = 0.8  # least share of common shingles of a similar pair
BROADCAST_ROWS = 1_000_000  # of two or three numbers each
FEW_LINKS = 250_000  # links of two keys each that one task takes
SALTS = 64  # parts of a crowded band or of the pairs of one text


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 digests of all word shingles, one row of 8 bytes each; fewer words than a shingle are one, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros((0, 8), np.uint8)
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = xxhash.xxh64_digest(line, SEED)
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-shingle].tolist()]
        stops = (ends[shingle - 1 :] - 1).tolist()
        digest = xxhash.xxh64_digest
        hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(starts, stops)])
    return np.frombuffer(hashes, np.uint8).reshape(-1, 8)


def majority_bits(rows: np.ndarray) -> int:
    """64 bits, each 1 if set in over half the rows; 0 without rows."""
    ones = np.zeros(BITS, np.int64)
    for lo in range(0, len(rows), SLICE_SHINGLES):
        ones += np.unpackbits(rows[lo : lo + SLICE_SHINGLES], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(rows)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 majority bits over the XXH64 of all word shingles, repeats included; 0 without words."""
    return majority_bits(shingle_hashes(text, shingle))


def similarity(one: str | None, other: str | None, shingle: int) -> float:
    """Common over all distinct word shingles of two texts."""
    a, b = (np.unique(shingle_hashes(t, shingle).view(np.uint64)) for t in (one, other))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Bit i gets a nonzero vector m(i) of radius+1 bits; mask v keeps the bits with odd parity of m(i) & v.

    The vectors of `radius` differing bits cannot span all dimensions, so some
    v is orthogonal to each of them and its mask keeps none of these bits.
    """
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(docs: DataFrame, keep: list[str], name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """`docs[keep]` with the signed fingerprint of each whole text; `name` must not be in `keep`."""

    def start():
        return lambda texts: {name: [_signed(fingerprint(t, shingle)) for t in texts]}

    return map_texts(docs, start, f"`{name}` long", keep)


def _forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): each print with the least one that steps of at most `radius` bits among `prints` lead to, where that is another."""
    prints = np.sort(prints)
    near = np.bitwise_count((prints[:, None] ^ prints).view(np.uint64)) <= radius
    root, before = np.arange(len(prints)), None
    while before is None or (root != before).any():
        before = root
        root = np.where(near, root, len(prints)).min(axis=1)
        root = root[root]
    moved = root != np.arange(len(prints))
    return prints[moved], prints[root[moved]]


def _bucket_links(batches, radius: int = RADIUS):
    for batch in batches:
        for part in slices(batch):
            found = [_forest(row.values.to_numpy(), radius) for row in part.column("fps")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(side)) for side in zip(*found)], names=["a", "b"])


def fingerprint_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a > b) that connect all distinct `fp` within `radius` = 2 bits of each other.

    Rows made: masks x prints. Up to `COMPARED` prints of a bucket are compared
    in one task. Prints of a larger bucket make 1 + (bits not kept) rows more:
    two of its members are within 2 bits exactly if they meet at a point within
    one bit of both, so joining each member to the least fp there keeps what is
    reachable and adds nothing that is not.
    """
    assert radius == 2, "meeting points one bit away cover two bits"
    masks = covering_masks(radius)
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)]))
    keyed = prints.select("fp", table.alias("t")).select("fp", "t.mask", "t.key")
    full = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    crowd = keyed.join(full, ["mask", "key"])
    small = crowd.where(F.col("n") <= COMPARED).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
    compared = small.select("fps").mapInArrow(_bucket_links, "a long, b long")
    free = [[0] + [1 << i for i in range(BITS) if not m >> i & 1] for m in masks]
    flips = F.array(*[F.array(*[F.lit(_signed(x)).cast("long") for x in row]) for row in free])
    points = crowd.where(F.col("n") > COMPARED).select("fp", "mask", F.explode(F.transform(F.element_at(flips, F.col("mask") + 1), lambda x: x.bitwiseXOR(F.col("fp")))).alias("point"))
    met = points.groupBy("mask", "point").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1").select("mask", "point", "least")
    meeting = points.join(met, ["mask", "point"]).where("fp > least").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    return compared.union(meeting).distinct()


def _small(written: DataFrame) -> DataFrame:
    """A written table of a few numbers a row: to be broadcast up to `BROADCAST_ROWS`, joined by a shuffle beyond."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def _end_pairs(sets: DataFrame) -> DataFrame:
    """(one, other), one < other: each set with the first and the last of every bucket that it is in, in one of four orders. Crowded keys are dealt in `SALTS` parts."""
    keyed = sets.select("v", "fp", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    place = F.xxhash64("v", F.col("key") % 4)
    crowd = checkpointed(keyed.join(shared, "key").select("key", F.pmod(F.xxhash64("v"), F.lit(SALTS)).alias("salt"), F.struct(place.alias("place"), "v", "fp").alias("t")))
    ends = lambda lo, hi: (F.min(lo).alias("lo"), F.max(hi).alias("hi"))
    parts = crowd.groupBy("key", "salt").agg(*ends("t", "t"))
    spread = parts.select("key", "salt").join(parts.groupBy("key").agg(*ends("lo", "hi")), "key")
    pairs = crowd.join(spread, ["key", "salt"]).select("t", F.explode(F.array("lo", "hi")).alias("u")).where("t.v != u.v and t.fp != u.fp")
    return checkpointed(pairs.select(F.least("t.v", "u.v").alias("one"), F.greatest("t.v", "u.v").alias("other")).distinct())


def similar_links(sets: DataFrame, docs: DataFrame, links: DataFrame, shingle: int) -> DataFrame:
    """`links` and those that connect all fingerprints of texts with a similarity of `SIMILAR` or more, as (a, b), a > b.

    `sets`: `row`, `fp` and the `minhash` signature of each distinct set of
    shingles; `docs`: `row` and `text`. Pairs at the ends of buckets link most.
    Buckets whose sets are in several classes by then are settled exactly: every
    pair in them that may be similar is decided on whole sets, however large the
    bucket. What is lost is what shares none of the bands (3e-6 at 0.8) or is
    underestimated by 5 standard deviations (3e-7).
    """
    from fareindex.llm import minhash  # which uses this module

    def of_prints(pairs):
        fp = checkpointed(sets.select("v", "fp").join(_small(checkpointed(pairs.select(F.explode(F.array("one", "other")).alias("v")).distinct())), "v"))
        found = pairs.join(fp.toDF("one", "a"), "one").join(fp.toDF("other", "b"), "other")
        return found.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))

    pairs = _end_pairs(sets)
    whole = minhash.whole_sets(pairs.select(F.explode(F.array("one", "other")).alias("v")), sets, docs, None, shingle)
    checked = minhash.confirmed(pairs, whole)
    links = links.union(of_prints(checked.where("similar").select("one", "other"))).distinct()
    roots = components(links).withColumnRenamed("a", "fp")
    rooted = sets.join(_small(roots), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    apart = minhash.open_members(rooted, 0, minhash.BANDS)
    whole = minhash.whole_sets(apart.select("m.v"), sets, docs, whole, shingle)
    last = checkpointed(minhash.settled(apart, whole, checked).select("one", "other"))
    return roots.select(F.col("fp").alias("a"), F.col("root").alias("b")).union(of_prints(last)).distinct()


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(a, root): for every linked vertex, the smallest vertex reachable.

    Alternating large-star and small-star steps: each replaces a vertex's links
    by links to its least neighbour, so hubs shrink instead of multiplying.
    Every round is checkpointed; it ends when a round changes nothing. Up to
    `FEW_LINKS` links (no round adds any) are read as one partition, whose rounds
    need no shuffle; more are dealt by vertex.
    """
    edges = checkpointed(links)
    few = edges.count() <= FEW_LINKS
    before = None
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("v", "u")
        both = both.coalesce(1) if few else both
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = checkpointed(small.where("a != b").distinct())
        key = F.xxhash64("a", "b")
        now = edges.agg(F.count("*"), F.bit_xor(key), F.sum(F.shiftrightunsigned(key, 20))).first()  # 128 bits and the number
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select("a", F.col("b").alias("root"))


def near_duplicate_classes(docs: DataFrame, keep: list[str], fp: str = "fp", name: str = "component_id", shingle: int = SHINGLE) -> DataFrame:
    """`docs[keep]` with `fp` and `name`, the least doc_id linked to it by chains of close fingerprints.

    Null and wordless texts have fingerprint 0 and link like any other. A null
    doc_id names a class only if it has no other. Repeated rows and copies are
    reduced to distinct fingerprints before anything is matched; texts of any
    length are read whole; an empty table gives no row. Where `keep` has `fp` or
    `name` already, the new column's name is lengthened.
    """
    kept = docs.select(*keep)
    fp = free_name(kept, fp)
    name = free_name(kept.withColumn(fp, F.lit(0)), name)
    own = free_name(kept, "own_id")
    marked = checkpointed(with_fingerprint(docs.withColumn(own, F.col("doc_id")), [*keep, own], fp, shingle))
    classes = _classes(marked.select(F.col(fp).alias("fp"), F.col(own).alias("id")), F.min("id"), "least")
    return marked.join(classes.select(F.col("fp").alias(fp), F.col("least").alias(name)), fp).select(*keep, fp, name)


def _classes(marked: DataFrame, pick, name: str, links: DataFrame | None = None) -> DataFrame:
    """(fp, name): what the aggregate `pick` gives over the class of each fp, chained by `links`, else by close prints; min-like aggregates only."""
    prints = marked.groupBy("fp").agg(pick.alias("own"))
    roots = components(fingerprint_links(prints.select("fp")) if links is None else links).withColumnRenamed("a", "fp")
    of = prints.join(roots, "fp", "left").select("fp", "own", F.coalesce("root", "fp").alias("root"))
    return of.join(of.groupBy("root").agg(F.min("own").alias(name)), "root").select("fp", name)


def simhash_digest(docs: DataFrame) -> DataFrame:
    """Fingerprint and class of every document; cases as in `near_duplicate_classes`."""
    found = near_duplicate_classes(docs.select("doc_id", "text"), ["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row of each near-duplicate class: that with the least doc_id, then text hash; of repeated rows one.

    Classes are chained by fingerprints within 2 bits and by texts with a
    similarity of 0.8 or more, both over shingles of `shingle` words. Rows with
    a null doc_id come last; null and wordless texts are one class. Columns are
    those of `docs`, whatever their names; an empty table stays empty.
    """
    from fareindex.llm import minhash  # which uses this module

    names = docs.columns
    rank = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("id"), F.xxhash64("text").alias("hash"))
    row = free_name(docs, "row_rank")

    def start():
        def work(texts):
            rows = [shingle_hashes(t, shingle) for t in texts]
            return {"fp": [_signed(majority_bits(r)) for r in rows], **minhash.signatures([np.unique(r.view(np.uint64)) for r in rows])}

        return work

    marked = checkpointed(map_texts(docs.select("text", rank.alias("rank")), start, f"fp long, {minhash.SIGNATURE}", ["rank"]))
    prints = checkpointed(marked.groupBy("fp").agg(F.min("rank").alias("rank")))
    first = F.min(F.struct(F.col("rank").alias("row"), "fp", "n", "packed", "keys")).alias("t")
    sets = checkpointed(marked.where("v is not null").groupBy("v").agg(first).select("v", "t.*"))
    several = marked.where("v is not null").groupBy("v").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b != most").select("v", "b")
    same = marked.select("v", F.col("fp").alias("a")).join(_small(checkpointed(several)), "v").where("a != b").select("a", "b")
    near = checkpointed(fingerprint_links(prints.select("fp")).union(same))
    links = similar_links(sets, docs.select(rank.alias("row"), "text"), near, shingle)
    chosen = checkpointed(_classes(prints, F.min("rank"), "best", links).select(F.col("best").alias(row)).distinct())
    return docs.withColumn(row, rank).join(_small(chosen), row, "left_semi").dropDuplicates([row]).select(*names)
