"""MinHash near-duplicates on b-bit signatures: candidates share a band of minima, bits estimate their similarity, whole sets confirm it.

Equal sets are one vertex from the start. Within a bucket of a band no list of
pairs is made: a task joins the members by the most similar pairs (a spanning
forest under the estimate), these are confirmed on whole sets, and buckets whose
members are linked by now are done. The first bands do so before all of them,
which then only deal with what is apart. What is still open is settled exactly:
pair by pair where a bucket has few open pairs, in blocks of whole sets where it
has many. So no link is lost of those that a band and the estimate let through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from fareindex.llm.common import checkpointed, free_name, map_texts, slices, small_batches, struct
from fareindex.llm.simhash import components, shingle_hashes

SHINGLE, PERCENT = 2, 80
BANDS, BAND_ROWS = 32, 5  # a pair at 0.8 shares a band with probability 1 - 3e-6
HASHES, BITS = 256, 2  # minima in a signature, low bits of each
SEED = 42
SIGNATURE = "n long, v binary, packed binary, keys array<long>"  # columns of `signatures`
FIRST = 4  # bands that are worked off before the others
#: Equal codes of a pair at the least similarity, less 5 standard deviations; by chance alone a code in four is equal.
EQUAL = 2.0**-BITS + (1 - 2.0**-BITS) * PERCENT / 100
MATCHES = int(HASHES * EQUAL - 5 * (HASHES * EQUAL * (1 - EQUAL)) ** 0.5)
MEMBERS = 1_024  # of a bucket in one task; more are dealt in blocks
SET_SIZES = 1 << 19  # shingles of the whole sets in one task
FEW = 64  # open pairs of a bucket that are listed
ROUNDS = 1  # of forests over all bands, before the rest is settled
SALTS = 64
BROADCAST_ROWS = 1_000_000


@cache
def _orders() -> tuple[np.ndarray, np.ndarray]:
    factor, shift = np.random.default_rng(SEED).integers(1, 1 << 63, (2, HASHES), np.uint64)
    return factor << np.uint64(1) | np.uint64(1), shift


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles; fewer words are one shingle, no words none."""
    return np.unique(shingle_hashes(text, shingle).view(np.uint64).reshape(-1))


def minima(hashes: np.ndarray) -> np.ndarray:
    """The least value of the set under each of `HASHES` orders."""
    factor, shift = _orders()
    least = np.full(HASHES, (1 << 64) - 1, np.uint64)
    for lo in range(0, len(hashes), 1 << 10):
        least = np.minimum(least, (hashes[lo : lo + (1 << 10), None] * factor + shift).min(axis=0))
    return least


def packed(least: np.ndarray) -> bytes:
    """`BITS` bits of each minimum, mixed first; all first bits, then all second ones."""
    mixed = least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)
    planes = [np.packbits((mixed >> np.uint64(b) & np.uint64(1)).astype(np.uint8)).tobytes() for b in range(BITS)]
    return b"".join(planes)


def matches(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Equal codes of signatures (rows of 64-bit words), by bit counts."""
    apart = one ^ others
    planes = apart.reshape(*apart.shape[:-1], BITS, -1)
    unequal = planes[..., 0, :]
    for b in range(1, BITS):
        unequal = unequal | planes[..., b, :]
    return HASHES - np.bitwise_count(unequal).sum(axis=-1, dtype=np.int64)


def estimate(equal) -> np.ndarray:
    """Similarity from equal codes, corrected for those equal by chance."""
    return (np.asarray(equal) / HASHES - 2.0**-BITS) / (1 - 2.0**-BITS)


def _keys(least: np.ndarray) -> list[int]:
    bands = least[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(bands)], np.uint64).view(np.int64).tolist()


def signatures(sets: list[np.ndarray]) -> dict:
    """Size, digest, packed minima and band keys of each set of shingles; an empty set has no digest and no keys."""
    least = [minima(s) for s in sets]
    return {
        "n": [len(s) for s in sets],
        "v": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
        "packed": [packed(x) for x in least],
        "keys": [_keys(x) if len(s) else [] for x, s in zip(least, sets)],
    }


def _sized(n: np.ndarray, one, others) -> np.ndarray:
    """Whether the sizes of two sets allow the least similarity."""
    return 100 * np.minimum(n[one], n[others]) >= PERCENT * np.maximum(n[one], n[others])


def forest(codes: np.ndarray, n: np.ndarray, root: np.ndarray) -> list[tuple[int, int, int]]:
    """(one, other, matches): the pairs that join members of different roots, the most alike first, as far as they may be similar."""
    size = len(codes)
    best, by = np.full(size, -1), np.zeros(size, np.int64)
    out, found = np.ones(size, bool), []
    while out.any():
        now = int(np.argmax(np.where(out, best, -2)))
        if best[now] >= MATCHES:
            found.append((int(by[now]), now, int(best[now])))
        for k in np.flatnonzero(out & (root == root[now])):
            out[k] = False
            like = np.where(out & _sized(n, k, slice(None)), matches(codes[k], codes), -1)
            nearer = like > best
            best[nearer], by[nearer] = like[nearer], k
    return found


def open_pairs(codes: np.ndarray, n: np.ndarray, root: np.ndarray) -> list[tuple[int, int, int]]:
    """(one, other, matches) of all pairs of different roots that may be similar."""
    found = []
    for k in range(len(codes) - 1):
        like = matches(codes[k], codes[k + 1 :])
        at = np.flatnonzero((like >= MATCHES) & (root[k + 1 :] != root[k]) & _sized(n, k, slice(k + 1, None)))
        found += [(k, int(k + 1 + j), int(like[j])) for j in at]
    return found


def linked(one: np.ndarray, other: np.ndarray) -> bool:
    both = len(np.intersect1d(one, other, assume_unique=True))
    return 100 * both >= PERCENT * (len(one) + len(other) - both)


def _dealt(members: DataFrame, weight, limit: int, star: bool = False) -> DataFrame:
    """Groups (key, members): buckets up to `limit` whole, larger ones as pairs of blocks, so that every two members meet.

    With `star`, each block of a large bucket meets the first one only, which
    takes twice its rows. `members`: key and struct `m` with v, packed, n, root, perhaps more.
    """
    total = checkpointed(members.groupBy("key").agg(F.ceil(F.sum(weight) / limit).alias("blocks")).where("blocks > 1"))
    if total.isEmpty():
        return members.groupBy("key").agg(F.collect_list("m").alias("members"))
    own = F.pmod(F.xxhash64("m.v"), F.col("blocks"))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: j != own)
    others = F.when(own > 0, F.array(F.lit(0).cast("long"))).otherwise(others) if star else others
    crowded = members.join(_small(total), "key").withColumn("other", F.explode(others))
    crowded = crowded.select("key", F.least(own, "other").alias("lo"), F.greatest(own, "other").alias("hi"), "m")
    whole = members.join(_small(total), "key", "left_anti").select("key", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"), "m")
    return whole.union(crowded).groupBy("key", "lo", "hi").agg(F.collect_list("m").alias("members")).select("key", "members")


def _small(written: DataFrame) -> DataFrame:
    """A written table of a few numbers a row: to be broadcast up to `BROADCAST_ROWS`, joined by a shuffle beyond."""
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def _in_groups(groups: DataFrame, work: Callable[..., list[tuple]], new: str) -> DataFrame:
    """`new` rows of each group. `work` gets its key and its members' columns."""
    small_batches(groups.sparkSession)
    schema = to_arrow_schema(struct(new))

    def run(batches):
        for batch in batches:
            for part in slices(batch):
                rows = []
                keys, lists = part.column("key").to_pylist(), part.column("members")
                for k, key in enumerate(keys):
                    group = lists[k].values
                    v = group.field("v").to_pylist()
                    codes = np.frombuffer(b"".join(group.field("packed").to_pylist()), np.uint64).reshape(len(v), -1)
                    known: dict[bytes, int] = {}
                    root = np.array([known.setdefault(r, len(known)) for r in group.field("root").to_pylist()])
                    if len(known) > 1:
                        rows += work(key, v, codes, group.field("n").to_numpy(), root, group)
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, row)) for row in rows], schema=schema)

    return groups.mapInArrow(run, struct(new))


def _proposals(members: DataFrame) -> DataFrame:
    """(one, other), one < other: pairs that would join each bucket; of a crowd, each block with the first one."""

    def work(key, v, codes, n, root, group):
        return [(min(v[a], v[b]), max(v[a], v[b])) for a, b, _ in forest(codes, n, root)]

    return _in_groups(_dealt(members, F.lit(1), MEMBERS, star=True), work, "one binary, other binary").distinct()


def confirmed(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """(one, other, similar) of each pair of a written table, decided on whole sets; texts with many pairs are dealt in `SALTS` parts.

    Up to `BROADCAST_ROWS` pairs go to the sets, so that only the sets they name are shuffled.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("one"), F.lit(SALTS)))
    here = F.broadcast if pairs.count() <= BROADCAST_ROWS else lambda df: df
    others = whole.toDF("other", "right").join(here(salted.select("other", "salt").distinct()), "other")
    sides = whole.toDF("one", "left").join(here(salted), "one").join(others, ["other", "salt"]).select("one", "other", "left", "right")

    def check(batches):
        for batch in batches:
            for part in slices(batch):
                left, right = part.column("left"), part.column("right")
                like = [linked(left[k].values.to_numpy(), right[k].values.to_numpy()) for k in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("one"), part.column("other"), pa.array(like, pa.bool_())], names=["one", "other", "similar"])

    small_batches(pairs.sparkSession)
    return checkpointed(sides.mapInArrow(check, "one binary, other binary, similar boolean"))


def _still_open(members: DataFrame, links: DataFrame) -> DataFrame:
    """`members` with their new roots, of the buckets that have more than one."""
    m = _rooted(members.select("key", "m.v", "m.packed", "m.n"), links)
    keys = m.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    return checkpointed(m.join(_small(checkpointed(keys)), "key").select("key", F.struct("v", "packed", "n", "root").alias("m")))


def settled(members: DataFrame, whole: DataFrame, checked: DataFrame | None) -> DataFrame:
    """(one, other): links of all open pairs that a bucket still has, of a crowd a forest of them; `checked` pairs need not be looked at again."""

    def look(key, v, codes, n, root, group):
        pairs = open_pairs(codes, n, root)
        if len(pairs) <= FEW:
            return [(None, min(v[a], v[b]), max(v[a], v[b])) for a, b, _ in pairs]
        return [(key, v[k], None) for k in sorted({k for p in pairs for k in p[:2]})]

    found = checkpointed(_in_groups(_dealt(members, F.lit(1), MEMBERS), look, "key long, one binary, other binary"))
    few = found.where("key is null").select("one", "other").distinct()
    few = checkpointed(few if checked is None else few.join(checked.select("one", "other"), ["one", "other"], "left_anti"))
    links = confirmed(few, whole).where("similar").select("one", "other")
    if found.where("key is not null").isEmpty():
        return links
    crowd = found.where("key is not null").select("key", F.col("one").alias("v")).distinct()
    flat = members.select("key", "m.v", "m.packed", "m.n", "m.root").join(crowd, ["key", "v"]).join(whole, "v")
    many = checkpointed(flat.select("key", F.struct("v", "packed", "n", "root", "shingles").alias("m")))

    def join(key, v, codes, n, root, group):
        sets, out = group.field("shingles"), []
        for a, b, _ in sorted(open_pairs(codes, n, root), key=lambda p: -p[2]):
            if root[a] != root[b] and linked(sets[a].values.to_numpy(), sets[b].values.to_numpy()):
                root[root == root[b]] = root[a]
                out.append((min(v[a], v[b]), max(v[a], v[b])))
        return out

    return links.union(_in_groups(_dealt(many, F.col("m.n"), SET_SIZES), join, "one binary, other binary"))


def near_duplicates(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """`docs[keep]` with n_shingles, component_id (the least doc_id that links lead to) and kept.

    Texts whose sets of 2-word shingles have a similarity of 0.8 or more are
    linked. Null, empty and wordless texts have no shingles and no links. Of
    repeated rows each is returned; a null doc_id names a class only if it has
    no other, and is kept only then. Long texts are read whole; an empty table
    gives no row. New columns get longer names where `keep` has theirs.
    """
    keep = list(docs.columns if keep is None else keep)
    names = []
    for new in ("n_shingles", "component_id", "kept"):
        names.append(free_name(docs.select(*keep, *[F.lit(0).alias(n) for n in names]), new))
    id_, text = F.col("doc_id"), F.col("text")
    row = F.struct(F.coalesce(id_, F.lit((1 << 63) - 1)).alias("id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(1), text).alias("g"))

    def start():
        return lambda texts: signatures([shingle_set(t) for t in texts])

    sent = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), id_.alias("id"), row.alias("row"), text.alias("text"))
    marked = checkpointed(map_texts(sent, start, SIGNATURE, ["kept", "id", "row"]))
    worded = marked.where("v is not null")
    texts = checkpointed(worded.groupBy("v").agg(F.min(F.struct("row", "n", "packed", "keys")).alias("t"), F.min("id").alias("id")).select("v", "t.*", "id"))
    links = _links(texts, docs.select(row.alias("row"), text.alias("text")))
    roots = components(links).select(F.col("a").alias("v"), "root")
    of = texts.select("v", "id").join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
    named = of.join(of.groupBy("root").agg(F.min("id").alias("component")), "root").select("v", "component")
    found = marked.select("kept", "id", "n", "v").join(named, "v", "left")
    component = F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component"))
    return found.select("kept.*", F.col("n").alias(names[0]), component.alias(names[1]), F.col("id").eqNullSafe(component).alias(names[2]))


def open_members(texts: DataFrame, lo: int, hi: int) -> DataFrame:
    """(key, m): members of the buckets of bands lo to hi with more than one root, each bucket once; `texts`: v, packed, n, keys, root."""
    keyed = texts.select("v", "root", F.explode(F.slice("keys", lo + 1, hi - lo)).alias("key"))
    own, root = F.xxhash64("v"), F.xxhash64("root")  # what tells buckets apart is one number where a text is alone in its bucket
    tags = {"x": F.bit_xor(own), "y": F.min(own), "z": F.max(own)}
    counted = keyed.groupBy("key").agg(F.count("*").alias("size"), F.min(root).alias("least"), F.max(root).alias("most"), *[c.alias(k) for k, c in tags.items()])
    counted = counted.where("least != most").groupBy("size", *tags).agg(F.min("key").alias("key"))  # equal buckets of several bands once
    buckets = checkpointed(counted.select("key"))
    if buckets.count() <= BROADCAST_ROWS:  # then nothing is shuffled, and the signature can come along
        found = texts.select("v", "root", "packed", "n", F.explode(F.slice("keys", lo + 1, hi - lo)).alias("key")).join(F.broadcast(buckets), "key")
    else:
        found = keyed.join(buckets, "key").join(texts.select("v", "packed", "n"), "v")
    return checkpointed(found.select("key", F.struct("v", "packed", "n", "root").alias("m")))


def _rooted(texts: DataFrame, links: DataFrame | None) -> DataFrame:
    if links is None:
        return texts.withColumn("root", F.col("v"))
    roots = components(links).select(F.col("a").alias("v"), "root")
    return texts.join(_small(roots), "v", "left").withColumn("root", F.coalesce("root", "v"))


def whole_sets(used: DataFrame, texts: DataFrame, docs: DataFrame, before: DataFrame | None, shingle: int = SHINGLE) -> DataFrame:
    """(v, shingles): `before` and the sets of the v in `used` that it lacks; `texts`: row, v; `docs`: row, text."""
    used = used.distinct()
    used = used if before is None else used.join(before.select("v"), "v", "left_anti")
    rows = checkpointed(texts.select("row", "v").join(used, "v"))

    def start():
        return lambda texts: {"shingles": [shingle_set(t, shingle).view(np.int64) for t in texts]}

    found = checkpointed(map_texts(docs.join(_small(rows), "row"), start, "shingles array<long>", ["v"]))
    if found.count() != rows.count():  # repeated rows
        found = checkpointed(found.groupBy("v").agg(F.first("shingles").alias("shingles")))
    return found if before is None else before.union(found)


def _links(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b), a > b: links that connect all similar vertices; `texts`: v, row, n, packed, keys; `docs`: row, text.

    The first bands link most copies, so that all of them together only deal with buckets whose members are still apart.
    """
    checked = links = whole = None
    for bands, rounds in ((FIRST, 1), (BANDS, ROUNDS)):
        now = open_members(_rooted(texts, links), 0, bands)
        whole = whole_sets(now.select("m.v"), texts, docs, whole)
        for _ in range(rounds):
            pairs = _proposals(now)
            pairs = checkpointed(pairs if checked is None else pairs.join(checked.select("one", "other"), ["one", "other"], "left_anti"))
            if pairs.isEmpty():
                break
            done = confirmed(pairs, whole)
            checked = done if checked is None else checked.union(done)
            new = done.where("similar").select(F.col("other").alias("a"), F.col("one").alias("b"))
            if new.isEmpty():
                break
            links = new if links is None else links.union(new)
            if bands == BANDS:
                now = _still_open(now, links)
    last = checkpointed(settled(now, whole, checked).select(F.col("other").alias("a"), F.col("one").alias("b")))
    return last if links is None else links.union(last)


def minhash_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; cases as in `near_duplicates`."""
    found = near_duplicates(docs.select("doc_id", "text"), ["doc_id"])
    return found.select("doc_id", "n_shingles", "component_id", "kept")
