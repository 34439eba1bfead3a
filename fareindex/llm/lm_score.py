"""Cross-entropy difference of matched language models.

A target and a background bigram model share one vocabulary, that of all words
of the corpus, and one estimator; each document is scored by the mean difference
of its tokens' losses. Documents are gathered in blocks, and three shuffles of
packed rows follow. A block sends each distinct bigram once, with its counts, to
one of many parts, dealt by hash, which sum them over all blocks; it sends its
words to buckets, which sum what each word's unigram and bigrams add up to. Sums
return to the blocks, where each document's losses are worked out. Nothing that
grows with the corpus is broadcast or collected, and a frequent bigram costs one
entry a block, not one a document.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareindex.llm.common import free_name, slices, struct

START = 1  # the key of what stands before a text's first word; words have keys from 2 ** 47 up
PART_CHARS = 24_000_000  # characters whose bigrams make up a part
PARTS_PER_BUCKET = 4
BLOCK_TOKENS, BLOCK_TEXTS = 1_500_000, 100_000  # where a block ends
BROADCAST_LABELS = 1_000_000  # labels of quality that may be broadcast; more are joined by a shuffle
WORDS = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


class Numbers(dict):
    """Numbers words in the order in which they come up, from 1."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self) + 1
        return number


def word_key(word: str) -> int:
    """47 bits of a word's hash, with bit 47 set: two of ten million words share a key with a chance of about 0.3."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> 17 | 1 << 47


def compressed(x: np.ndarray) -> bytes:
    """The length, then the bytes of `x` by significance, as Zstandard."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def restored(data: bytes, kind: str) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def joined(rows: list[dict], name: str, kind: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[restored(r[name], kind) for r in rows]])


def as_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


# Rows of the shuffles: where they go next (blocks count down from -1), what they are, of which block, which part or
# bucket, and packed columns.
BIGRAMS, WORD_ROWS, OWN, COUNTS, KINDS, TOTALS = range(6)
ROW = "to long, kind int, block long, number long, " + ", ".join(f"x{i} binary" for i in range(7))


def packed(rows: list[tuple]) -> pa.Table:
    """Rows given as (to, kind, block, number, packed columns...)."""
    names = [f.split()[0] for f in ROW.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 7]
    full = [(*r, *[None] * (len(names) - len(r))) for r in rows]
    return pa.table([pa.array([r[i] for r in full], k) for i, k in enumerate(kinds)], names=names)


def ranked_bigrams(tokens: np.ndarray, sizes: np.ndarray, start: int, residue: np.ndarray, grid: int):
    """A block's distinct bigrams by part, then words: (word before, word, part), and each token's place among them."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = start
    code, pair = np.unique(before * len(residue) + tokens, return_inverse=True)
    a, b = np.divmod(code, len(residue))
    part = residue[a] * grid + residue[b]
    order = np.argsort(part, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return a[order], b[order], part[order], rank[pair]


def block_rows(block: int, kept: pa.Table, sides: list, texts: list[np.ndarray], words: Numbers, grid: int, buckets: int) -> pa.Table:
    """A block of documents as rows for the parts, for the buckets, and for its own return."""
    keys = np.array([START, *map(word_key, words)], np.int64)
    order = np.lexsort((keys, keys % buckets))  # words are numbered anew by bucket, then key
    keys, number = keys[order], np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    sizes, start = np.array([len(t) for t in texts], np.int64), int(number[0])
    tokens, residue = number[np.concatenate(texts)], keys % grid
    a, b, part, pair = ranked_bigrams(tokens, sizes, start, residue, grid)
    side = np.array(sides, bool)[np.repeat(np.arange(len(sizes)), sizes)]
    n = [np.bincount(pair[side == s], minlength=len(a)) for s in (False, True)]
    rows = []
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for lo, hi in zip(cuts, [*cuts[1:], len(part)]):
        first, before = np.unique(a[lo:hi], return_inverse=True)
        second, after = np.unique(b[lo:hi], return_inverse=True)
        columns = (keys[first], keys[second], before.astype("<u4"), after.astype("<u4"), *[x[lo:hi].astype("<u4") for x in n])
        rows.append((int(part[lo]), BIGRAMS, block, int(part[lo]), *map(compressed, columns)))
    sums = [np.bincount(w, x, len(keys)).astype("<u8") for w in (a, b) for x in n]
    ends = np.searchsorted(keys % buckets, np.arange(buckets + 1))
    for k, (lo, hi) in enumerate(zip(ends, ends[1:])):
        rows.append((-1 - block, WORD_ROWS, block, k, *map(compressed, (keys[lo:hi], *[x[lo:hi] for x in sums]))))
    rows.append((-1 - block, OWN, block, start, as_bytes(kept), *map(compressed, (sizes, tokens.astype("<u4"), residue.astype("<u2")))))
    return packed(rows)


def dealt_blocks(sided: DataFrame, keep: list[str], text: str, side: str, grid: int, buckets: int) -> DataFrame:
    def run(batches):
        held, sides, texts, words, size = [], [], [], Numbers(), 0
        block = TaskContext.get().partitionId() << 32

        def rows():
            return block_rows(block, pa.Table.from_batches(held), sides, texts, words, grid, buckets).combine_chunks().to_batches()

        for batch in batches:
            for piece in slices(batch):
                held.append(piece.select(keep))
                sides += piece.column(side).to_pylist()
                for t in piece.column(text).to_pylist():
                    found = words_of(t)
                    texts.append(np.fromiter(map(words.__getitem__, found), np.int64, len(found)))
                    size += len(found)
                if size >= BLOCK_TOKENS or len(texts) >= BLOCK_TEXTS:
                    yield from rows()
                    held, sides, texts, words, size = [], [], [], Numbers(), 0
                    block += 1
        if texts:
            yield from rows()

    return sided.mapInArrow(run, ROW)


def losses(counts: np.ndarray, seen: np.ndarray, kinds: np.ndarray, n: np.ndarray, total: float, size: int) -> np.ndarray:
    """-log2 P(word | word before) by Witten-Bell interpolation with add-one unigrams."""
    kinds = np.maximum(kinds, 1)
    return -np.log2((counts + kinds * (n + 1) / (total + size)) / (seen + kinds))


def sum_bigrams(rows: list[dict], buckets: int) -> list[tuple]:
    """Of a part: each block's bigrams with their counts in the corpus, and how many kinds of bigram begin with each word."""
    entries = np.array([int.from_bytes(r["x2"][:8], "little") for r in rows])

    def placed(words: str, at: str):
        held = np.array([int.from_bytes(r[words][:8], "little") for r in rows])
        found, place = np.unique(joined(rows, words, "<i8"), return_inverse=True)
        return found, place[joined(rows, at, "<u4") + np.repeat(np.cumsum(held) - held, entries)]

    first, a = placed("x0", "x2")
    second, b = placed("x1", "x3")
    code, pair = np.unique(a * len(second) + b, return_inverse=True)
    counts = [np.bincount(pair, joined(rows, x, "<u4"), len(code)).astype("<u8") for x in ("x4", "x5")]
    out = []
    ends = np.cumsum(entries)
    for r, lo, hi in zip(rows, ends - entries, ends):
        out.append((-1 - r["block"], COUNTS, r["block"], r["number"], *[compressed(c[pair[lo:hi]]) for c in counts]))
    kinds = [np.bincount(code // len(second), c > 0, len(first)).astype("<u8") for c in counts]
    for k in np.unique(first % buckets):
        at = first % buckets == k
        out.append((int(k), KINDS, None, int(k), compressed(first[at]), *[compressed(x[at]) for x in kinds]))
    return out


def sum_words(rows: list[dict]) -> list[tuple]:
    """Of a bucket: the sums of each block's words over the corpus, and what all words of the bucket add up to."""
    mine, kinds = ([r for r in rows if r["kind"] == k] for k in (WORD_ROWS, KINDS))
    words, place = np.unique(joined(mine, "x0", "<i8"), return_inverse=True)
    sums = [np.bincount(place, joined(mine, x, "<u8"), len(words)) for x in ("x1", "x2", "x3", "x4")]  # seen, seen, n, n
    at = np.searchsorted(words, joined(kinds, "x0", "<i8"))
    sums += [np.bincount(at, joined(kinds, x, "<u8"), len(words)) for x in ("x1", "x2")]
    whole = np.array([sums[2].sum(), sums[3].sum(), len(words) - int(START in words)], "<u8")
    out, lo = [], 0
    for r in mine:
        hi = lo + int.from_bytes(r["x0"][:8], "little")
        out.append((-1 - r["block"], TOTALS, r["block"], r["number"], *[compressed(x[place[lo:hi]].astype("<u8")) for x in sums], compressed(whole)))
        lo = hi
    return out


def block_scores(rows: list[dict], grid: int, names: list[str]) -> pa.Table:
    """What a block kept of its documents, with the token count and mean losses of each."""
    own = next(r for r in rows if r["kind"] == OWN)
    kept = pa.ipc.open_stream(own["x0"]).read_all()
    sizes, tokens, residue = (restored(own[x], k).astype(np.int64) for x, k in (("x1", "<i8"), ("x2", "<u4"), ("x3", "<u2")))
    a, b, _, pair = ranked_bigrams(tokens, sizes, own["number"], residue, grid)
    parts, totals = (sorted((r for r in rows if r["kind"] == k), key=lambda r: r["number"]) for k in (COUNTS, TOTALS))
    total = np.sum([restored(r["x6"], "<u8") for r in totals], axis=0, dtype=np.int64)
    sums = [joined(totals, f"x{i}", "<u8").astype(float) for i in range(6)]
    owner, columns = np.repeat(np.arange(len(sizes)), sizes), [pa.array(sizes)]
    for s in (1, 0):
        loss = losses(joined(parts, f"x{s}", "<u8"), sums[s][a], sums[4 + s][a], sums[2 + s][b], total[s], total[2] + 2)  # and <unk>, <s>, which the unigrams never saw
        columns.append(pa.array(np.bincount(owner, loss[pair], len(sizes)) / np.maximum(sizes, 1)))
    return pa.table([*kept.columns, *columns], names=[*kept.column_names, *names])


def score_blocks(blocks: DataFrame, grid: int, buckets: int, schema: T.StructType) -> DataFrame:
    """What the blocks kept of each document, then (last in `schema`) its token count and mean losses, target and background."""

    def passed(table: pa.Table, *kinds: int) -> list[tuple]:
        return [tuple(r.values()) for r in table.to_pylist() if r["kind"] in kinds]

    def in_parts(table: pa.Table) -> pa.Table:
        pairs = [r for r in table.to_pylist() if r["kind"] == BIGRAMS]
        words = [(r[3], *r[1:]) for r in passed(table, WORD_ROWS)]
        return packed((sum_bigrams(pairs, buckets) if pairs else []) + words + passed(table, OWN))

    def in_buckets(table: pa.Table) -> pa.Table:
        words = [r for r in table.to_pylist() if r["kind"] in (WORD_ROWS, KINDS)]
        return packed((sum_words(words) if words else []) + passed(table, OWN, COUNTS))

    def in_blocks(table: pa.Table) -> pa.Table:
        return block_scores(table.to_pylist(), grid, schema.names[-3:])

    summed = blocks.groupBy("to").applyInArrow(in_parts, ROW).groupBy("to").applyInArrow(in_buckets, ROW)
    return summed.groupBy("to").applyInArrow(in_blocks, schema)


def cross_entropy_difference(docs: DataFrame, is_target: Column, keep: list[str]) -> DataFrame:
    """`docs[keep]` with n_tokens and mean losses in bits a token; lower `score` is more like the target.

    Both models are made from all rows of `docs`, split by the boolean
    `is_target` (null: background), and every row is scored by its whole text.
    Null, empty and wordless texts have 0 tokens and all values 0; repeated rows
    count and are scored each; a very long text is a block of its own size; an
    empty table gives no row. Columns of `docs` other than `keep` don't matter;
    `keep` must not hold the names of the new columns.
    """
    if clash := {"n_tokens", "target_loss", "background_loss", "score"} & {c.lower() for c in keep}:
        raise ValueError(f"keep holds {clash}")
    side = free_name(docs, "of_target")
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    grid = math.isqrt(size // PART_CHARS) + 1  # parts along each side: by the word before, and by the word
    buckets = 1 + grid * grid // PARTS_PER_BUCKET
    sided = docs.withColumn(side, F.coalesce(is_target, F.lit(False))).select(*dict.fromkeys([*keep, "text"]), side)
    blocks = dealt_blocks(sided, keep, "text", side, grid, buckets)
    schema = T.StructType([*docs.select(*keep).schema, *struct("n_tokens long, target_loss double, background_loss double")])
    found = score_blocks(blocks, grid, buckets, schema)
    return found.withColumn("score", F.col("target_loss") - F.col("background_loss"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Target: documents labelled of quality. Background: all others, those with a null doc_id too.

    Labels are broadcast if there are BROADCAST_LABELS at most, else joined by a
    shuffle. Other cases as in `cross_entropy_difference`.
    """
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("of_quality", F.lit(True))
    if good.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        good = F.broadcast(good)
    sided = docs.select("doc_id", "text").join(good, "doc_id", "left")
    return cross_entropy_difference(sided, F.col("of_quality"), ["doc_id"])
