"""Phrase collocations: counts of word sequences in burst tries, kept level by level, and the phrases whose parts hardly occur apart.

A task counts in a `HatTrie` and spills whole subtrees as runs; runs are
merged by Spark in partitions of equal prefixes. A phrase can only be frequent
if its words and pairs are, so words are counted first, then pairs of frequent
words, then longer phrases of frequent pairs. What is frequent reaches the tasks
as a bitmap of hashes of at most `MOST_BITS` bits: it lets too much through at
times, never too little, and counts are exact at every size.
"""

from __future__ import annotations

import string
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fareindex.llm.common import checkpointed, gather_texts, map_texts

LEAST = 30  # occurrences of a candidate
LONGEST = 4  # words of a candidate
TOP = 2_000  # phrases reported for each language
CONTAINED = 80  # per cent of a phrase's occurrences that lie in a longer candidate
HELD = 1 << 19  # phrases that a task holds before it spills
BURST = 1 << 12  # keys of a container before it bursts
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 30
PARTS = 1 << 12  # partitions of merged runs; more where shuffles have many
ROOTS, SALTS = 1 << 20, 64  # a partition is that of a hash of the first word, and of one of the second in so many
BUFFERED = 1 << 20  # words that wait for being counted together
FOLD = bytes.maketrans(string.ascii_uppercase.encode() + b",;:!?\n\x0b\x0c\r", string.ascii_lowercase.encode() + b"." * 9)  # separators become "."


class HatTrie:
    """Counts of sequences of word ids.

    Under each first id lies a hash container of what follows. A container of
    more than `burst` keys becomes a node with a container for each second id,
    where anything follows that. What follows is a tuple; in a trie of pairs
    it may be the second id itself.
    """

    def __init__(self, burst: int = BURST):
        self.top: dict[int, dict] = {}
        self.nodes: set[int] = set()
        self.size, self.most = 0, burst

    def add(self, first: int, rests: list[tuple], counts: list[int]) -> None:
        """Distinct sequences that begin with `first`, as what follows it, and their numbers."""
        at = self.top.setdefault(first, {})
        if first in self.nodes:
            for rest, n in zip(rests, counts):
                low = at.setdefault(rest[0], {})
                self.size += rest[1:] not in low
                low[rest[1:]] = low.get(rest[1:], 0) + n
            return
        before, get = len(at), at.get
        if before:
            for rest, n in zip(rests, counts):
                at[rest] = get(rest, 0) + n
        else:
            at.update(zip(rests, counts))
        self.size += len(at) - before
        if len(at) > self.most and isinstance(rests[0], tuple) and len(rests[0]) > 1:
            node: dict = {}
            for rest, n in at.items():
                node.setdefault(rest[0], {})[rest[1:]] = n
            self.top[first] = node
            self.nodes.add(first)

    def take(self, first: int) -> tuple[list[tuple], list[int]]:
        """The subtree of a first id, which leaves the trie: what follows it, and the numbers."""
        at = self.top.pop(first)
        if first in self.nodes:
            self.nodes.discard(first)
            rests = [(second, *rest) for second, low in at.items() for rest in low]
            counts = [n for low in at.values() for n in low.values()]
        else:
            rests, counts = list(at), list(at.values())
        self.size -= len(rests)
        return rests, counts

    def largest(self) -> list[int]:
        """First ids, those of the largest subtrees first."""
        size = {k: sum(map(len, v.values())) if k in self.nodes else len(v) for k, v in self.top.items()}
        return sorted(size, key=size.get, reverse=True)


class Bitmap:
    """Places of frequent phrases; `bits` is a power of two."""

    def __init__(self, bits: int, data: bytes):
        self.mask, self.raw, self.data = np.uint64(bits - 1), data, np.frombuffer(data, np.uint8)

    def __contains__(self, one: int) -> bool:
        at = one & int(self.mask)
        return bool(self.raw[at >> 3] >> (at & 7) & 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(lang + b"\n" + word)


def joined(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Hashes of pairs from those of their words."""
    with np.errstate(over="ignore"):
        mixed = (first * np.uint64(0x9E3779B97F4A7C15) ^ second) * np.uint64(0xC2B2AE3D27D4EB4F)
    return mixed ^ mixed >> np.uint64(29)


def frequent(counted: DataFrame):
    """A broadcast `Bitmap` of the words or pairs of `counted`: 16 bits for each, rounded up to a power of two, within LEAST_BITS and MOST_BITS."""
    spark = counted.sparkSession
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * counted.count()).bit_length()))

    def start():
        def work(rows):
            out = []
            for r in rows:
                lang, *words = r["lang"].encode(), *r["phrase"].encode().split(b" ")
                h = np.array([word_hash(lang, w) for w in words], np.uint64)
                out.append(int((h if len(h) == 1 else joined(h[:1], h[1:]))[0]) & (bits - 1))
            return {"at": out}

        return work

    at = F.col("at") + 1
    places = map_texts(counted.select(F.struct("lang", "phrase").alias("p")), start, "at long", [], "p")
    chunks = places.select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit"))
    data = bytearray(bits // 8)
    for bucket, chunk in chunks.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("chunk")).toLocalIterator():
        data[(bucket - 1) * 4096 : bucket * 4096] = chunk
    return spark.sparkContext.broadcast((bits, bytes(data)))


def words_of(text: bytes) -> list[bytes]:
    """Words, A-Z in lower case, and a "." between pieces, which no word holds."""
    return text.translate(FOLD).replace(b".", b" . ").split()


class Numbers(dict):
    """Ids of a language's words from their first sight; -1 for those that `known` lacks and between pieces."""

    def __init__(self, lang: bytes, names: list, hashes: list, langs: list, known: Bitmap | None):
        super().__init__({b".": -1})
        self.lang, self.names, self.hashes, self.langs, self.known = lang, names, hashes, langs, known

    def __missing__(self, word: bytes) -> int:
        h = word_hash(self.lang, word)
        if self.known is not None and h not in self.known:
            self[word] = -1
            return -1
        self.names.append(word)
        self.hashes.append(h)
        self.langs.append(self.lang)
        self[word] = k = len(self.names) - 1
        return k


def sequences(line: np.ndarray, sizes: range, linked: np.ndarray):
    """(ids, number) of the distinct runs of each of `sizes` ids in `line` all of whose neighbours are `linked`: rows and counts."""
    if sizes.start == 1:
        times = np.bincount(line + 1)[1:]
        found = np.flatnonzero(times)
        yield found[:, None], times[found]
        return
    ok, rank, rows = linked, line[:-1], None
    for size in range(2, sizes.stop):
        if size > 2:
            ok = ok[:-1] & linked[size - 2 :]
            rank = rank[:-1]
        at = np.flatnonzero(ok)
        code = rank[at] << 32 | line[at + size - 1]
        if last_size := size + 1 == sizes.stop:
            code, n = np.unique(code, return_counts=True)
        else:
            code, place, n = np.unique(code, return_inverse=True, return_counts=True)
        first, last = code >> 32, code & 0xFFFFFFFF
        rows = np.column_stack([first, last]) if rows is None else np.column_stack([rows[first], last])
        if not last_size:
            rank = rank.copy()
            rank[at] = place
        if size in sizes:
            yield rows, n


def _counts(docs: DataFrame, lengths: range, least: int = LEAST, words=None, pairs=None, held: int = HELD, burst: int = BURST) -> DataFrame:
    """(lang, phrase, f) of the phrases of so many words with f >= `least`, all of whose words and pairs are in the bitmaps; of single words also '' with their number."""
    parts = max(PARTS, 16 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def start():
        known, pairing = (b and Bitmap(*b.value) for b in (words, pairs))
        trie, numbers, names, hashes, langs = HatTrie(burst), {}, [], [], []
        totals: Counter = Counter()
        tally = np.zeros(0, np.int64)  # of single words, by id
        waiting: list[np.ndarray] = []

        def settle():
            line = np.concatenate([*waiting, np.array([-1])])
            waiting.clear()
            linked = (line[:-1] >= 0) & (line[1:] >= 0)
            if pairing is not None and linked.any():
                h, at = np.array(hashes, np.uint64), np.flatnonzero(linked)
                linked[at] = pairing.holds(joined(h[line[at]], h[line[at + 1]]))
            for rows, n in sequences(line, lengths, linked):
                if lengths.start == 1:
                    tally.resize(len(names), refcheck=False)
                    tally[rows[:, 0]] += n
                    continue
                cuts = np.flatnonzero(np.diff(rows[:, 0])) + 1
                rests, numbers_of = rows[:, 1].tolist() if lengths.stop == 3 else list(zip(*rows[:, 1:].T.tolist())), n.tolist()
                starts = [0, *cuts.tolist()] if len(rows) else []
                for lo, hi, one in zip(starts, [*starts[1:], len(rows)], rows[starts, 0].tolist()):
                    trie.add(one, rests[lo:hi], numbers_of[lo:hi])

        def add(columns):
            of: dict[bytes, list] = {}
            for lang, text in zip(columns["lang"], columns["text"]):
                of.setdefault(lang, []).append(text)
            for lang, texts in of.items():
                if lang not in numbers:
                    numbers[lang] = Numbers(lang, names, hashes, langs, known)
                found = words_of(b".".join([*texts, b""]))
                line = np.fromiter(map(numbers[lang].__getitem__, found), np.int64, len(found))
                if lengths.start == 1:
                    totals[lang] += int((line >= 0).sum())
                waiting.append(line)

        def runs(firsts):
            """Runs, one for each language and partition: phrases and numbers of the subtrees."""
            of: dict[bytes, tuple[list, list, list, list]] = {}
            hashed = np.array(hashes, np.uint64)
            roots, salts = ((hashed % np.uint64(n)).astype(np.int64) for n in (ROOTS, SALTS))
            spaced = [b" " + name for name in names if firsts].__getitem__
            if lengths.start == 1:
                times = tally.tolist()
                for lang, ids in numbers.items():
                    if own := [k for k in ids.values() if k >= 0]:
                        of[lang] = [names[k] for k in own], own, [], [times[k] for k in own]
            for first in firsts:
                rests, counts = trie.take(first)
                phrase, begun, second, number = of.setdefault(langs[first], ([], [], [], []))
                begin = names[first]
                if lengths.stop == 3:
                    phrase += [begin + spaced(k) for k in rests]
                    second += rests
                else:
                    phrase += [begin + b"".join(map(spaced, rest)) for rest in rests]
                    second += [rest[0] for rest in rests]
                begun += [first] * len(rests)
                number += counts
            out = {"lang": [], "part": [], "phrases": [], "numbers": []}
            for lang, (phrase, begun, second, number) in of.items():
                part = (roots[begun] * SALTS + (salts[second] if second else 0)) % parts
                order = np.argsort(part, kind="stable")
                starts = [0, *(np.flatnonzero(np.diff(part[order])) + 1).tolist()]
                at = order.tolist()
                own = [phrase[i] for i in at]
                out["phrases"] += [b"\n".join(own[lo:hi]) for lo, hi in zip(starts, [*starts[1:], len(at)])]
                held_bytes = np.array(number, np.int64)[order].tobytes()
                out["lang"] += [lang] * len(starts)
                out["part"] += part[order[starts]].tolist()
                out["numbers"] += [held_bytes[8 * lo : 8 * hi] for lo, hi in zip(starts, [*starts[1:], len(at)])]
            return out

        def flush(last):
            if waiting and (last or sum(map(len, waiting)) >= BUFFERED):
                settle()
            everything = last or not waiting and sum(map(len, numbers.values())) > 2 * held
            if not everything and trie.size <= held:
                return None
            firsts, kept = [], trie.size
            for first in trie.largest():
                if not everything and kept <= held // 2:
                    break
                firsts.append(first)
                kept -= sum(map(len, trie.top[first].values())) if first in trie.nodes else len(trie.top[first])
            out = runs(firsts)
            if everything:
                tally.resize(0, refcheck=False)
                for column in (numbers, names, hashes, langs):
                    column.clear()
            if last:
                for lang, n in totals.items():
                    for name, value in (("lang", lang), ("part", 0), ("phrases", b""), ("numbers", np.int64(n).tobytes())):
                        out[name].append(value)
            return out

        return add, flush

    sent = docs.select(F.coalesce("lang", F.lit("und")).cast("binary").alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    spilled = gather_texts(sent, start, "lang binary, part int, phrases binary, numbers binary")
    dealt = spilled.repartition("part").sortWithinPartitions("part", "lang")
    return dealt.mapInArrow(_merged(least), "lang string, phrase string, f long")


def _merged(least: int):
    """Merges the runs of each partition and language, which follow one another; keeps phrases of `least` occurrences, and ''."""

    def run(batches):
        before, held = None, {}

        def kept():
            found = [(p, n) for p, n in held.items() if n >= least or not p]
            columns = [[before[0].decode()] * len(found), [p.decode() for p, _ in found], [n for _, n in found]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=["lang", "phrase", "f"])

        for batch in batches:
            for lang, part, phrases, numbers in zip(*(batch.column(c).to_pylist() for c in ("lang", "part", "phrases", "numbers"))):
                if before != (lang, part):
                    if held:
                        yield kept()
                    before, held = (lang, part), {}
                numbers, phrases = np.frombuffer(numbers, np.int64).tolist(), phrases.split(b"\n")
                if held:
                    get = held.get
                    for phrase, n in zip(phrases, numbers):
                        held[phrase] = get(phrase, 0) + n
                else:
                    held = dict(zip(phrases, numbers))
        if held:
            yield kept()

    return run


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, held: int = HELD, burst: int = BURST) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of all phrases of 1 to `longest` words with f >= `least`, (lang, n) of every language with words)."""
    words = checkpointed(_counts(docs, range(1, 2), least, held=held, burst=burst))
    totals = words.where("phrase = ''").groupBy("lang").agg(F.sum("f").alias("n"))
    found = words = words.where("phrase <> ''")
    if longest > 1:
        known = frequent(words)
        pairs = checkpointed(_counts(docs, range(2, 3), least, known, held=held, burst=burst))
        found = found.union(pairs)
        if longest > 2:
            longer = checkpointed(_counts(docs, range(3, longest + 1), least, known, frequent(pairs), held, burst))
            found = found.union(longer)
    return found, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Each language's first `top` phrases: lang, rank, phrase, a, l, r, n, score.

    A null text is empty, a null lang `und`; repeated rows count again. A
    language without candidates, and an empty table, give no row. Of `docs` only
    `lang` and `text` are read, so other columns may have any name.
    """
    found, totals = phrase_counts(docs, least, longest)
    named = found.withColumn("words", F.split("phrase", " "))
    size = F.size("words")
    candidates = named.where(size > 1).select("lang", "phrase", "words", F.col("f").alias("a"))
    part = lambda start, stop: F.array_join(F.slice("words", start + 1, stop - start), " ")
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(0), F.col("k")).alias("first"), part(F.col("k"), size).alias("rest"))
    halves = lambda name, f: found.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    cut = cuts.join(halves("first", "l"), ["lang", "first"]).join(halves("rest", "r"), ["lang", "rest"])
    score = F.expr("cast(a as decimal(20,0)) * 2000000bd div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    scored = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))

    inner = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.array_join(F.slice("words", i, n), " ")))))
    longest_of = candidates.where(size > 2).select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    free = scored.join(longest_of, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (F.col("outer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * CONTAINED))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = free.select("lang", "phrase", "a", "cut.*").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
