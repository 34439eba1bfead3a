"""Sequence packing by lexical retrieval.

Document frequencies and the mean length are those of the whole corpus. Documents
are sorted by their strongest terms under them and cut into shards of bounded
size, so like documents meet at every size of the corpus. A shard holds a BM25
inverted index over its documents' token ids; each seed document's strongest
terms fetch the nearest unused documents, again and again while any match, which
greedily fill the rest of its window. The
last one is cut to fit and its remainder seeds the next window, so windows are
full; what is left at the end of a shard is cut into powers of two.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from fareindex.llm.common import checkpointed, gather_texts, hashed_share, map_texts, slices, struct

WINDOW = 2048
END = 1
SHARD_DOCS = 1024
SHARD_TOKENS = 1 << 21  # a shard ends at so many documents or tokens, whichever comes first
RANGE_SHARDS = 8  # shards that a task cuts one after another
MOST_RANGES = 20_000  # beyond this many, ranges hold more shards; a task still holds one shard at a time
SAMPLE_PER_RANGE = 200  # documents whose keys place the ranges' bounds, for each range
TERMS = 1 << 16
K1, B = 1.2, 0.75
QUERY_TERMS, NEIGHBOURS = 16, 24  # terms of a query; documents that one query fetches
KEY_TERMS = 4  # strongest terms that order the documents, 16 bits each


@lru_cache(maxsize=2)
def _encoder(path: str):
    """`path` + ".json" as a tokenizers file, and its ranks (".tiktoken"), which give the same ids faster."""
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(f"{path}.json")
    with open(f"{path}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    special = [t.content for t in full.get_added_tokens_decoder().values()]
    return full, fast, special


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")).removesuffix(".json")


def token_ids(text: str, path: str) -> np.ndarray:
    """The text's ids and END. Texts with a special token's own string take the tokenizers library itself."""
    full, fast, special = _encoder(path)
    if any(s in text for s in special):
        ids = full.encode(text, add_special_tokens=False).ids
    else:
        ids = fast.encode_to_numpy(text)
    if len(ids) and np.max(ids) >= TERMS:
        raise ValueError(f"ids are stored in 16 bits; the tokenizer of {path} has more")
    return np.append(ids, END).astype(np.uint16)


def term_counts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, term, tf) of each document's distinct terms, by owner, then term."""
    owner = np.repeat(np.arange(len(docs), dtype=np.uint64), [len(d) for d in docs])
    code = np.sort(owner << np.uint64(16) | np.concatenate(docs).astype(np.uint64))
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    tf = np.diff(np.r_[first, len(code)])
    return (code[first] >> np.uint64(16)).astype(np.int64), (code[first] & np.uint64(0xFFFF)).astype(np.int64), tf


def strongest(owner: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """Places of the `k` largest weights of each of n owners, strongest first (ties: by place), -1 where there are fewer or none above 0."""
    order = np.lexsort((-weight, owner))
    begins = np.searchsorted(owner, np.arange(n))
    nth = np.arange(len(owner)) - begins[owner]
    out = np.full((n, k), -1)
    good = (nth < k) & (weight[order] > 0)
    out[owner[good], nth[good]] = order[good]
    return out


class Corpus:
    """What BM25 knows of all documents: their number, mean length, and how many hold each term."""

    def __init__(self, n: int, mean_length: float, df: np.ndarray):
        self.n, self.mean_length, self.df = n, mean_length, df
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))

    @classmethod
    def of(cls, docs: list[np.ndarray]) -> Corpus:
        df = np.bincount(term_counts(docs)[1], minlength=TERMS)
        return cls(len(docs), sum(map(len, docs)) / len(docs), df)

    def weights(self, terms: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean_length))

    def likeness(self, docs: list[np.ndarray]) -> np.ndarray:
        """Each document's strongest terms that others hold too, strongest first, as a signed 64-bit number."""
        owner, terms, tf = term_counts(docs)
        weight = np.where(self.df[terms] > 1, self.weights(terms, tf, np.array([len(d) for d in docs])[owner]), 0.0)
        top = strongest(owner, weight, len(docs), KEY_TERMS)
        found = np.where(top >= 0, terms[top], 0)
        key = found[:, 0].astype(np.int64) - (TERMS >> 1)
        for j in range(1, KEY_TERMS):
            key = key << 16 | found[:, j]
        return key


def corpus_of(counted: DataFrame) -> Corpus:
    """Sums the tasks' document frequencies; TERMS + 2 sums at most reach the driver."""

    def start():
        sums = np.zeros(TERMS + 2, np.int64)

        def add(part):
            for x in part["ids"]:
                sums[:] += np.frombuffer(x, np.int64)

        def flush(last):
            return {"sums": [sums.tobytes()]} if last else None

        return add, flush

    total = np.zeros(TERMS + 2, np.int64)
    for r in gather_texts(counted.select("ids"), start, "sums binary").collect():
        total += np.frombuffer(r["sums"], np.int64)
    return Corpus(int(total[TERMS]), total[TERMS + 1] / max(total[TERMS], 1), total[:TERMS])


class ShardIndex:
    """BM25 over one shard: postings by term, and each document's strongest terms."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus):
        owner, terms, tf = term_counts(docs)
        df = np.bincount(terms, minlength=TERMS)
        weight = corpus.weights(terms, tf, np.array([len(d) for d in docs], float)[owner])
        shared = np.where(df[terms] > 1, weight, 0.0)  # terms of no other document here fetch nothing
        self.n, self.queries = len(docs), [terms[t[t >= 0]] for t in strongest(owner, shared, len(docs), QUERY_TERMS)]
        order = np.argsort(terms, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.first = np.concatenate([[0], np.cumsum(df)])

    def neighbours(self, doc: int, unused: np.ndarray) -> list[int]:
        """The unused documents that score best against `doc`'s strongest terms, best first."""
        spans = [(self.first[t], self.first[t + 1]) for t in self.queries[doc].tolist()]
        if not spans:
            return []
        owner = np.concatenate([self.owner[a:b] for a, b in spans])
        score = np.bincount(owner, np.concatenate([self.weight[a:b] for a, b in spans]), self.n) * unused
        k = min(NEIGHBOURS, self.n - 1)
        top = np.argpartition(-score, k)[: k + 1]
        top = top[score[top] > 0]
        return top[np.lexsort((top, -score[top]))].tolist()


def pack_shard(docs: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length); all full but the last few, which have a power of two each."""
    index = ShardIndex(docs, corpus or Corpus.of(docs))
    unused = np.ones(len(docs), bool)
    waiting = iter(range(len(docs)))
    sequences, now, room = [], [], window
    carry: tuple[int, int] | None = None  # the document that goes on, and where

    def put(doc: int, start: int) -> tuple[int, int] | None:
        nonlocal now, room
        total = len(docs[doc])
        while start < total:
            take = min(room, total - start)
            now.append((doc, start, take))
            start, room = start + take, room - take
            if not room:
                sequences.append(now)
                now, room = [], window
                if total - start < window:
                    break
        return (doc, start) if start < total else None

    while True:
        if carry is None:
            seed = next((d for d in waiting if unused[d]), None)
            if seed is None:
                break
            unused[seed] = False
            carry = (seed, 0)
        seed = carry[0]
        carry = put(*carry)
        while carry is not None and not now and len(docs[carry[0]]) - carry[1] >= window:
            carry = put(*carry)
        if not now:
            continue
        while now and carry is None and (found := index.neighbours(seed, unused)):
            for doc in found:
                unused[doc] = False
                carry = put(doc, 0)
                if not now or carry is not None:
                    break
        # a window that all its neighbours do not fill goes on with the next seed
    left = [list(p) for p in now]
    size = sum(p[2] for p in left)
    for bit in reversed(range(size.bit_length())):
        if size >> bit & 1:
            part, need = [], 1 << bit
            while need:
                doc, start, length = left[0]
                take = min(need, length)
                part.append((doc, start, take))
                need -= take
                if take == length:
                    left.pop(0)
                else:
                    left[0] = [doc, start + take, length - take]
            sequences.append(part)
    return sequences


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def coded_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, row, ids), and one row for each task (row null) whose `ids` are its document frequencies, documents and tokens."""
    sent = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    schema = T.StructType([sent.schema["doc_id"], T.StructField("row", T.LongType()), T.StructField("ids", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        sums = np.zeros(TERMS + 2, np.int64)
        for batch in batches:
            for piece in slices(batch):
                ids = [token_ids(t or "", path) for t in piece.column("text").to_pylist()]
                sums[:TERMS] += np.bincount(term_counts(ids)[1], minlength=TERMS)
                sums[TERMS:] += len(ids), sum(map(len, ids))
                columns = [piece.column("doc_id"), piece.column("row"), pa.array([x.tobytes() for x in ids], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((None, None, sums.tobytes()), arrow)], schema=arrow)

    return sent.mapInArrow(run, schema)


def range_bounds(coded: DataFrame, corpus: Corpus, shared, ranges: int) -> np.ndarray:
    """Likeness keys that cut the documents into `ranges`, from a sample by hash; a frequent key is there several times."""
    share = min(1.0, SAMPLE_PER_RANGE * ranges / max(corpus.n, 1))

    def keys():
        return lambda rows: {"likeness": shared.value.likeness([np.frombuffer(x, np.uint16) for x in rows]).tolist()}

    sampled = coded.where(hashed_share("row", seed="ranges") < share)
    cuts = [i / ranges for i in range(1, ranges)]
    found = map_texts(sampled, keys, "likeness long", [], "ids").agg(F.percentile_approx("likeness", cuts, 20 * ranges)).first()[0]
    return np.array(found or [], np.int64)


def pack(docs: DataFrame, tokenizer: str | None = None, shard_docs: int = SHARD_DOCS, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document, with the piece's token ids if `with_ids`.

    Documents are sorted by the likeness of their texts, then by a hash of the
    row, and cut into ranges, then into shards of about `shard_docs` rows and at
    most SHARD_TOKENS tokens (a longer text is a shard by itself). Copies of one
    text, a third of all rows or more, are spread over as many ranges as they
    fill. Null text is empty and gives the one END token; repeated rows are
    packed each; a null doc_id stays null; an empty table gives no row. Other
    columns of `docs` don't matter.
    """
    path = tokenizer or default_tokenizer()
    every = checkpointed(coded_documents(docs, path))
    corpus = corpus_of(every.where("row is null"))
    coded = every.where("row is not null")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(corpus)
    ranges = min(MOST_RANGES, max(1, -(-corpus.n // (RANGE_SHARDS * shard_docs))))
    bounds = range_bounds(coded, corpus, shared, ranges) if ranges > 1 else np.zeros(0, np.int64)
    cuts = spark.sparkContext.broadcast(bounds)

    def keyed(batches):
        for batch in batches:
            for piece in slices(batch):
                likeness = shared.value.likeness([np.frombuffer(x, np.uint16) for x in piece.column("ids").to_pylist()])
                low, high = (np.searchsorted(cuts.value, likeness, side) for side in ("left", "right"))
                spread = piece.column("row").to_numpy() % (high - low + 1)  # over the ranges that its key fills
                added = [pa.array(likeness, pa.int64()), pa.array(low + spread, pa.int32())]
                yield pa.RecordBatch.from_arrays([*piece.columns, *added], names=[*piece.schema.names, "likeness", "range"])

    keys = T.StructType([*coded.schema, *struct("likeness long, range int")])
    dealt = coded.mapInArrow(keyed, keys).repartitionById(ranges, F.col("range")).sortWithinPartitions("likeness", "row").select("doc_id", "ids")
    schema = struct(PIECES + (", ids array<int>" if with_ids else ""))
    arrow = to_arrow_schema(schema)

    def packed(names: list, docs: list[np.ndarray], shard: int) -> pa.RecordBatch:
        out = []
        for k, sequence in enumerate(pack_shard(docs, corpus=shared.value)):
            at = 0
            for doc, lo, n in sequence:
                piece = docs[doc][lo : lo + n]
                row = (names[doc], lo, n, zlib.crc32(piece.astype("<u4").tobytes()), len(docs[doc]), (shard << 24) | k, at)
                out.append((*row, piece.astype(np.int32)) if with_ids else row)
                at += n
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    def run(batches):
        shard, names, texts, size = TaskContext.get().partitionId() << 16, [], [], 0
        for batch in batches:
            for name, x in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                if texts and (len(texts) >= shard_docs or size + len(x) // 2 > SHARD_TOKENS):
                    yield packed(names, texts, shard)
                    shard, names, texts, size = shard + 1, [], [], 0
                names.append(name)
                texts.append(np.frombuffer(x, np.uint16))
                size += len(texts[-1])
        if texts:
            yield packed(names, texts, shard)

    return dealt.mapInArrow(run, schema)
