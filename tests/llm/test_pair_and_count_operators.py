"""Vector codes, MinHash links and collocations against brute force and against their SQL."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fareindex.llm import codes, minhash, phrases
from fareindex.llm import queries as q

DDL = "doc_id long, text string, lang string, n_shingles long, kept string, f long"


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))


def shingles_of(text):
    w = words_of(text)
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def classes(rows):
    """doc_id -> (set size, least id reachable), by all pairs."""
    sets = [(i, shingles_of(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, x), (b, y) in combinations(sets, 2):
        if x and y and 100 * len(x & y) >= 80 * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {i: (len(s), find(i)) for i, s in sets}


def near_copies():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(900)]
    texts = [None, "", " \t\n", "one", "ONE", "one two", "日本語 語", "x " * 9_000, " ".join(rng.choices(vocabulary, k=6_000))]
    for size in (12, 60, 300):
        base = rng.choices(vocabulary, k=size)
        texts += [" ".join(base)] * 4
        for changed in range(1, size // 8):
            other = list(base)
            for k in rng.sample(range(size), changed):
                other[k] = rng.choice(vocabulary)
            texts.append(" ".join(other))
    chain = rng.choices(vocabulary, k=100)
    for k in range(12):  # each is alike to the next, the ends aren't alike
        chain = chain[8:] + rng.choices(vocabulary, k=8)
        texts.append(" ".join(chain))
    star = rng.choices(vocabulary, k=120)
    for k in range(60):  # alike to their middle, hardly to each other
        other = list(star)
        for j in rng.sample(range(120), 6):
            other[j] = rng.choice(vocabulary)
        texts.append(" ".join(other))
    texts.append(" ".join(star))
    return list(enumerate(texts))


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, 7, "x", 1) for i, t in rows], DDL)


def test_minhash_links_are_those_of_all_pairs(spark):
    rows = near_copies()
    want = classes(rows)
    got = minhash.near_duplicates(table(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles_"], r["component_id"]) for r in got} == want
    assert all(r["kept_"] == (r["doc_id"] == r["component_id"]) and r["n_shingles"] == 7 for r in got)


def test_minhash_crowds_are_settled_exactly(spark, monkeypatch):
    """Buckets of over 16 members go in blocks, and open pairs past 2 by whole sets; a crowd at 0.6 to 0.8 stays mostly apart."""
    monkeypatch.setattr(minhash, "MEMBERS", 16)
    monkeypatch.setattr(minhash, "SET_SIZES", 1_000)
    monkeypatch.setattr(minhash, "FEW", 2)
    monkeypatch.setattr(minhash, "ROUNDS", 1)
    rng = random.Random(8)
    base = [f"b{i}" for i in range(150)]
    rows = near_copies()
    for k in range(150):
        other = list(base)
        for j in rng.sample(range(150), rng.choice([3, 9, 14])):
            other[j] = f"n{rng.randrange(4_000)}"
        rows.append((1_000 + k, " ".join(other)))
    want = classes(rows)
    got = minhash.near_duplicates(table(spark, rows), ["doc_id"]).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_minhash_proposals_of_a_crowd_take_few_rows(spark):
    """A bucket of many blocks is dealt for its forest in about twice its rows, not in each pair of blocks; every block meets the first."""
    members = spark.range(200).selectExpr("7L as key", "struct(cast(cast(id as string) as binary) as v, id as n) as m")
    groups = [[m["v"] for m in r["members"]] for r in minhash._dealt(members, F.lit(1), 16, star=True).collect()]
    assert len(groups) == 12 and sum(map(len, groups)) <= 3 * 200
    assert len(set.union(*map(set, groups))) == 200 and set.intersection(*map(set, groups))


def test_minhash_estimates_similarity():
    rng = np.random.default_rng(2)
    for share in (0.2, 0.5, 0.8, 0.95):
        found = []
        for _ in range(40):
            both, left, right = np.split(rng.integers(0, 1 << 63, 2_000).astype(np.uint64), [int(2_000 * share), int(1_000 + 1_000 * share)])
            sides = [np.frombuffer(minhash.packed(minhash.minima(np.concatenate([both, x]))), np.uint64) for x in (left, right)]
            found.append(float(minhash.estimate(minhash.matches(*sides))))
        assert abs(np.mean(found) - share) < 0.02 and np.std(found) < 0.06


def test_minhash_repeats_nulls_and_empty_tables(spark):
    rows = [(5, "a b c"), (5, "a b c"), (3, "A b  c"), (None, "a b c"), (None, "only null ids"), (None, None), (9, None), (9, "")]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.minhash_digest(table(spark, rows)).collect())
    assert got == Counter([(5, 2, 3, False), (5, 2, 3, False), (3, 2, 3, True), (None, 2, 3, False), (None, 2, None, True), (None, 0, None, True), (9, 0, 9, True), (9, 0, 9, True)])
    assert minhash.minhash_digest(table(spark, []).where("false")).collect() == []


def plain_codes(rows, parts=16, entries=64, rounds=2):
    kept = sorted((i is None, i, [int(np.floor(float(np.float32(x)) * 256)) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v))
    points = np.array([v for *_, v in kept], np.int64).reshape(len(kept), parts, -1)
    books = points[:entries].copy()
    for k in range(rounds + 1):
        apart = ((points[:, None] - books[None]) ** 2).sum(axis=-1)
        code = apart.argmin(axis=1)
        if k < rounds:
            new = books.copy()
            for p in range(parts):
                for e in range(len(books)):
                    if (code[:, p] == e).any():
                        new[e, p] = points[code[:, p] == e, p].sum(axis=0) // (code[:, p] == e).sum()
            books = new
    error = apart.min(axis=1).sum(axis=1)
    return {i: (bytes(c.astype(np.uint8)), int(e)) for (_, i, _), c, e in zip(kept, code, error)}, books.transpose(1, 0, 2)


@pytest.mark.parametrize("n, width", [(700, 2), (40, 1), (300, 5)])
def test_codes_equal_plain_rounds(spark, n, width):
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(20, 16 * width))
    rows = [(i, [float(x) for x in (centres[i % 20] + rng.normal(size=16 * width) * 0.1).astype(np.float32)]) for i in range(n)]
    rows += [(10_000 + i, list(rows[i][1])) for i in range(20)]  # ties
    bad = [(20_000, None), (20_001, [None] * 16 * width), (20_002, [float("nan")] * 16 * width), (20_003, [float("inf")] * 16 * width)]
    want, books = plain_codes(rows)
    table = spark.createDataFrame([(i, v, i % 3 if v and i % 7 else None, "c", 1.5) for i, v in rows + bad], "vec_id long, embedding array<float>, label int, code string, error double").repartition(5)
    found, history, work = codes.vector_codes(table)
    assert {r["vec_id"]: (bytes(r["code_"]), r["error_"]) for r in found.collect()} == want
    assert (history[-1] == books).all() and len(history) == 3
    done = [r["work"] for r in work.orderBy("round").collect()]
    assert done[1] < done[0] and done[2] < done[0]
    digest = codes.code_digest(table).collect()
    errors = defaultdict(int)
    for r in table.collect():
        errors[r["label"]] += want.get(r["vec_id"], (0, 0))[1]
    label = {r["vec_id"]: r["label"] for r in table.collect()}
    assert all(r["label_error"] == errors[label[r["vec_id"]]] and r["code"] == want[r["vec_id"]][0].hex() for r in digest)


def test_net_displacement_is_tighter_than_drifts_and_bounds_hold():
    rng = np.random.default_rng(4)
    points = rng.integers(-500, 500, (400, 3))
    history = rng.integers(-500, 500, (1, 1, 30, 3))
    state = codes.assign(points, history, 0)
    for _ in range(5):
        history = np.concatenate([history, history[-1:] + rng.integers(-40, 40, (1, 1, 30, 3))])
        state = codes.assign(points, history, 0, state[:1] + state[2:4])
        apart = codes.squared(points, history[-1, 0])
        assert (state[0] == apart.argmin(axis=1)).all() and (state[1] == apart.min(axis=1)).all()
        moved = codes.displacements(history, 0)
        steps = np.sqrt(((history[1:, 0] - history[:-1, 0]) ** 2).sum(axis=2))
        assert (moved[0] <= [steps[:, lo : lo + codes.GROUP].sum(axis=0).max() + 1e-6 for lo in range(0, 30, codes.GROUP)]).all()
        apart[np.arange(400), state[0]] = 1 << 60
        for g in range(state[2].shape[1]):
            least = np.sqrt(apart[:, g * codes.GROUP : (g + 1) * codes.GROUP].min(axis=1))
            assert (state[2][:, g].astype(float) - moved[state[3][:, g], g] <= least + 1e-6).all()


def test_codes_of_odd_tables(spark):
    ddl = "vec_id long, embedding array<float>, label int"
    assert codes.code_digest(spark.createDataFrame([], ddl)).collect() == []
    few = spark.createDataFrame([(None, [1.0] * 16, None), (2, [3e38] * 16, None), (1, [0.5] * 16, 4), (3, [1.0] * 15, 4), (4, [], 4)], ddl)
    got = {r["vec_id"]: (r["code"], r["error"]) for r in codes.code_digest(few).collect()}
    assert got == {1: ("00" * 16, 0), 2: ("01" * 16, 0), None: ("02" * 16, 0), 3: (None, None), 4: (None, None)}


def plain_collocations(rows, least, top=2000):
    counts, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode())):
            w = re.findall(rb"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            counts.update((lang or "und", *w[i : i + k]) for k in range(1, 5) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in counts.items() if len(p) > 2 and a >= least}
    found = defaultdict(list)
    for (lang, *w), a in candidates.items():
        score, k = min((2_000_000 * a // (counts[lang, *w[:k]] + counts[lang, *w[k:]]), k) for k in range(1, len(w)))
        inside = any(o[0] == lang and len(o) > len(w) + 1 and 100 * f >= 80 * a and any(list(o[i : i + len(w)]) == w for i in range(1, len(o) - len(w) + 1)) for o, f in candidates.items())
        if not inside:
            found[lang].append((-score, -a, b" ".join(w), counts[lang, *w[:k]], counts[lang, *w[k:]]))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, ps in found.items() for i, (s, a, p, l, r) in enumerate(sorted(ps)[:top], 1)}


def prose():
    rng = random.Random(6)
    words = ["New", "york", "the", "of", "Ünï", "日本", "a b", "x\x1fy"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", ".\n"]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = [(rng.choice(["en", "de", None, "und"]), t) for t in texts]
    return rows + [("en", None), ("en", ""), ("fr", "..,;"), ("fr", "rare words here"), ("en", "very long " * 5_000)]


@pytest.mark.parametrize("held, burst", [(1 << 19, 1 << 12), (40, 3)])
def test_collocations_equal_plain_counts(spark, monkeypatch, held, burst):
    """With small tries, subtrees burst and are spilled again and again."""
    rows = prose()
    plain = phrases.phrase_counts
    monkeypatch.setattr(phrases, "phrase_counts", lambda docs, least, longest: plain(docs, least, longest, held, burst))
    docs = spark.createDataFrame([(i, t, lang, 0, "", 0) for i, (lang, t) in enumerate(rows)], DDL).repartition(3)
    got = {tuple(r) for r in phrases.collocations(docs, least=5).collect()}
    assert got == plain_collocations(rows, 5) and len(got) > 50
    assert phrases.collocations(docs.where("false")).collect() == []


def test_single_words_are_counted_without_containers(spark, monkeypatch):
    """Words are counted by id; only phrases of two or more words go into the trie."""
    monkeypatch.setattr(phrases.HatTrie, "add", lambda *a: pytest.fail("a container for a single word"))
    gather, tasks = phrases.gather_texts, []
    monkeypatch.setattr(phrases, "gather_texts", lambda df, start, new: tasks.append(start) or gather(df, start, new))
    docs = spark.createDataFrame([("en", "x")], "lang string, text string")
    phrases._counts(docs, range(1, 2))
    add, flush = tasks[0]()
    want = Counter()
    for k in range(3):
        texts = [f"a b w{i % 7} a. b" for i in range(40 * k)]
        add({"lang": [b"en"] * len(texts), "text": [t.encode() for t in texts]})
        want.update(w for t in texts for w in t.replace(".", "").split())
    out = flush(True)
    got = Counter()
    for run, numbers in zip(out["phrases"], out["numbers"]):
        assert run.split(b"\n") == sorted(run.split(b"\n"))
        got.update({w.decode(): int(n) for w, n in zip(run.split(b"\n"), np.frombuffer(numbers, np.int64))})
    assert got.pop("") == want.total() and got == want


def test_burst_trie_keeps_counts():
    rng = random.Random(1)
    trie, want = phrases.HatTrie(burst=4), Counter()
    for _ in range(5_000):
        key = tuple(rng.randrange(6) for _ in range(rng.choice([3, 4])))
        trie.add(key[0], [key[1:]], [2])
        want[key] += 2
    assert trie.size == len(want) and trie.nodes
    got = {}
    for first in trie.largest():
        got |= {(first, *rest): n for rest, n in zip(*trie.take(first))}
    assert got == want and trie.size == 0


@pytest.mark.parametrize("name", ["op11_codes", "op12_minhash", "op13_phrases"])
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = q.queries()[name](spark, sf)
    rel = con.sql(q.oracle_sql()[name])
    assert sorted(rel.columns) == sorted(df.columns)
    want = rel.select(*[f'"{c}"' for c in df.columns]).fetchall()
    assert Counter(map(tuple, df.collect())) == Counter(want) and want


def test_trie_of_pairs_takes_bare_ids():
    trie = phrases.HatTrie(burst=2)
    trie.add(1, [2, 3, 4], [5, 6, 7])
    trie.add(1, [3, 9], [1, 1])
    assert trie.size == 4
    assert dict(zip(*trie.take(1))) == {2: 5, 3: 7, 4: 7, 9: 1} and trie.size == 0
