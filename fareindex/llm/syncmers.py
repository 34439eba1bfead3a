"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A document's k-mers are runs of K word pieces; one is an anchor if the least hash
of its inner runs of S pieces lies at either edge. Whether a k-mer is chosen
depends on the k-mer only, so a passage keeps its anchors wherever it moves and
whatever surrounds it. A fingerprint is all distinct anchors with their first
positions. Two are matched by position: an anchor that both hold counts where a
neighbouring one is shifted by as many pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fareindex.llm.common import free_name

K, S = 5, 2
WIDE = r"฀-໿぀-鿿\x{20000}-\x{323AF}"  # scripts without spaces between words: each character is a piece
PIECE = rf"[^\s{WIDE}]{{1,16}}|[{WIDE}]"  # longer runs are cut into pieces of 16
BUCKET_ROWS = 1_000
MOST_BUCKETS = 1 << 16  # beyond this many, buckets have more rows, which Spark sorts on disk


def with_anchors(df: DataFrame, text: str, name: str) -> DataFrame:
    """`df` with `name`: array of (anchor, position) structs, one for each distinct anchor at its first place, by anchor.

    Positions count pieces. K - 1 empty pieces stand before and after the text,
    so the shortest texts have k-mers too; without a piece, or for null, the
    array is empty.
    """
    p, h, at = (f"{name}_{x}" for x in ("pieces", "hashes", "found"))
    inner = K - S  # index of the last inner run of a k-mer
    pad = F.array_repeat(F.lit(""), K - 1)

    def get(i: Column) -> Column:
        return F.get(F.col(h), i)

    def is_closed(i: Column) -> Column:
        edge = F.least(get(i), get(i + inner))
        return edge <= F.least(*[get(i + j) for j in range(1, inner)])

    n = F.size(p)
    out = df.withColumn(p, F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PIECE), F.lit(0)))
    out = out.withColumn(p, F.when(n > 0, F.concat(pad, p, pad)).otherwise(F.array().cast("array<string>")))
    runs = F.transform(F.sequence(F.lit(0), n - S), lambda i: F.xxhash64(*[F.get(F.col(p), i + j) for j in range(S)]))
    out = out.withColumn(h, F.when(n > 0, runs))
    chosen = F.filter(F.sequence(F.lit(0), n - K), is_closed)
    each = F.transform(chosen, lambda i: F.struct(F.xxhash64(*[get(i + j) for j in range(inner + 1)]).alias("anchor"), (i - (K - 1)).alias("position")))
    out = out.withColumn(at, F.when(n > 0, F.sort_array(each)))
    first = F.filter(at, lambda x, i: (i == 0) | (F.get(F.col(at), i - 1)["anchor"] != x["anchor"]))
    return out.withColumn(name, F.coalesce(first, F.array().cast("array<struct<anchor:bigint,position:int>>"))).drop(p, h, at)


def with_match(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """`df` with `name`: the anchors that two fingerprints share, as (position in a, shift to its position in b), by position."""
    merged, own = f"{name}_merged", lambda c, side: F.transform(c, lambda x: F.struct(x["anchor"].alias("anchor"), F.lit(side).alias("side"), x["position"].alias("position")))
    after = lambda i: F.get(F.col(merged), i + 1)
    both = F.transform(
        merged,
        lambda x, i: F.when(after(i)["anchor"] == x["anchor"], F.struct(x["position"].alias("position"), (after(i)["position"] - x["position"]).alias("shift"))),
    )
    out = df.withColumn(merged, F.sort_array(F.concat(own(a, 0), own(b, 1))))
    return out.withColumn(name, F.sort_array(F.array_compact(both))).drop(merged)


def likeness(a: str, b: str, match: str) -> Column:
    """Anchors of `match` that lie in line with the one before or after, as a share of the anchors of both; 1 if both have none."""
    shift = lambda i: F.get(F.col(match), i)["shift"]
    agrees = lambda x, i: F.coalesce(shift(i) == x["shift"], F.lit(True))  # noqa: E731  # no neighbour on this side: nothing disagrees
    chained = F.size(F.filter(match, lambda x, i: agrees(x, i - 1) | agrees(x, i + 1)))
    size = F.size(a) + F.size(b)
    return F.when(size == 0, F.lit(1.0)).otherwise(2.0 * chained / F.greatest(size, F.lit(1)))


def written(column: str) -> Column:
    """A digest of every anchor and its position."""
    each = F.transform(F.col(column), lambda x: F.concat_ws(":", F.hex(x["anchor"]), x["position"].cast("string")))
    return F.sha2(F.array_join(each, ","), 256)


def number_of_bounds(bounds: list[int], k: Column) -> Column:
    """How many of the sorted `bounds` are at most `k`: first by the block, then within it."""
    step = max(1, int(len(bounds) ** 0.5))
    literal = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    block = F.size(F.filter(literal(bounds[::step]), lambda c: c <= k))
    inside = F.size(F.filter(F.slice(literal(bounds), (block - 1) * step + 1, step), lambda c: c <= k))
    return F.when(k.isNull() | (k < bounds[0]), 0).otherwise((block - 1) * step + inside)


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id") -> DataFrame:
    """`docs` with `next_<c>`: column c of the next row by ascending key (ties by `columns`); after the last, the first.

    A row without a key is its own successor. Rows are cut into key ranges at
    approximate quantiles, which are keys of the table. The first rows of each
    range also go to the range before, so every range finds its last row's
    successor without one global sort.
    """
    bucket, guest, place = (free_name(docs, c) for c in ("bucket", "guest", "place"))
    size = docs.agg(F.count(key).alias("n"), F.min(key).alias("least")).first()
    buckets = max(1, min(MOST_BUCKETS, size["n"] // BUCKET_ROWS))
    cuts = []
    if buckets > 1:
        shares = [i / buckets for i in range(1, buckets)]
        found = docs.agg(F.percentile_approx(key, shares, max(10_000, 10 * buckets)).alias("cuts")).first()["cuts"]
        cuts = sorted(set(found) - {size["least"]})
    k = F.col(key)
    own = number_of_bounds(cuts, k) if cuts else F.lit(0)
    starts = [size["least"], *cuts]  # of each bucket
    leads = k == F.get(F.split(F.lit(",".join(map(str, starts))), ",").cast("array<bigint>"), F.col(bucket))
    before = F.when(F.col(bucket) == 0, len(cuts)).otherwise(F.col(bucket) - 1)
    at_home = F.struct(F.col(bucket).cast("int").alias(bucket), F.lit(0).alias(guest))
    places = F.when(F.coalesce(leads, F.lit(False)), F.array(at_home, F.struct(before.cast("int").alias(bucket), F.lit(1).alias(guest)))).otherwise(F.array(at_home))
    placed = docs.where(k.isNotNull()).withColumn(bucket, own).withColumn(place, F.explode(places))
    order = W.partitionBy(f"{place}.{bucket}").orderBy(f"{place}.{guest}", k, *columns)
    found = placed.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).where(F.col(place)[guest] == 0).drop(bucket, place)
    return found.unionByName(docs.where(k.isNull()).withColumns({f"next_{c}": F.col(c) for c in columns}))


def syncmer_digest(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next document's are.

    The edited text has its last half (rounded down) replaced by as many code
    points of the next document. Null counts as empty; a lone document and a row
    with a null doc_id are their own successors; repeated rows are each other's
    successors; texts of any length keep every anchor; an empty table gives no
    row. Other columns of `docs` don't matter.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half))
    out = with_next(base, ["text"]).withColumns({"n_chars": n.cast("long"), "edited": edited})
    for text, anchors in (("text", "own"), ("next_text", "after"), ("edited", "changed")):
        out = with_anchors(out, text, anchors)
    out = out.withColumn("edited_sha256", F.sha2("edited", 256)).drop("text", "next_text", "edited")
    out = with_match(with_match(out, "own", "changed", "match_edited"), "own", "after", "match_next")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written("own").alias("fingerprint"),
        written("changed").alias("edited_fingerprint"),
        likeness("own", "changed", "match_edited").alias("near_edited"),
        likeness("own", "after", "match_next").alias("near_next"),
        F.size("own").cast("long").alias("n_anchors"),
        F.size("match_next").cast("long").alias("shared_next"),
    )
