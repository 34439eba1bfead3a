"""Each operator against a brute-force version, on small rows and on a whole table."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_checks import check_packing, reference_print

from fareindex.llm import langid, media, packing, secret_scan, simhash, toxicity
from fareindex.llm import queries as q

DDL = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, other scripts and clashing columns."""
    rng = random.Random(3)
    words = ["der", "la", "the", "of", "x1", "Ünï", "日本語", "a+b", "e@mail.com"]
    texts = [None, "", " ", "\n\t", "one", "one two", "one two three", "…!?", "a" * 30_000, " ".join(rng.choices(words, k=9_000))]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(60)]
    base = " ".join(rng.choices([f"w{i}" for i in range(500)], k=200))
    texts += [base] * 30 + [base + " tail"] * 3
    rows = [(i, t, rng.choice(["en", "fr", None]), "s", None, 0.5, 7) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id", "en", None, None, None, None), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2) for i in range(50)] + [(None, None, None), (3, None, None)], "doc_id long, quality int, toxic int")


def table(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_media_round_trip(spark, docs, sf):
    for df in (docs, table(spark, sf)):
        source = df.select("doc_id", "text").collect()
        got = media.media_digest(df, ["doc_id"]).collect()
        assert len(got) == len(source)
        want = Counter()
        for r in source:
            raw = (r["text"] or "").encode()
            padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
            want[r["doc_id"], len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])] += 1
        assert want == Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got)
        assert all(r["keyframes"][0]["end"] - r["keyframes"][0]["start"] == 64 for r in got)


def test_media_reads_other_layouts():
    payload = bytes(range(256)) * 40
    data = media.wrap_samples(payload)
    assert media.read_samples(data, media.parse_media(data)["tracks"][0]) == payload
    for cut in range(0, len(data), 37):
        media.describe(data[:cut])
    broken = bytearray(data)
    rng = random.Random(1)
    for _ in range(300):
        broken[rng.randrange(700)] = rng.randrange(256)
        media.describe(bytes(broken))
    tables = data.index(b"stbl")
    for _ in range(4_000):  # one byte of the sample tables at a time
        broken = bytearray(data)
        broken[rng.randrange(tables, tables + 700)] = rng.randrange(256)
        found = media.parse_media(bytes(broken))
        assert all((t["keys"] >= 0).all() and len(media.read_samples(bytes(broken), t)) == t["sizes"].sum() for t in found["tracks"])
    assert media.describe(None) == "-|error=empty"
    deep = b"\0\0\0\x08free"
    for _ in range(3000):
        deep = (len(deep) + 8).to_bytes(4, "big") + b"moov" + deep
    assert "no track" in media.describe(deep)


def test_media_fragments():
    box, full, pack = media._box, media._full, struct.pack
    data = bytearray(media.wrap_samples(b"\1" * 128))
    trex = full(b"trex", pack(">5I", 1, 1, 7, 3, 0))
    at = data.index(b"moov") - 4
    size = int.from_bytes(data[at : at + 4], "big")
    mvex = box(b"mvex", trex)
    data[at : at + 4] = (size + len(mvex)).to_bytes(4, "big")
    data[at + size : at + size] = mvex
    co = data.index(b"co64") + 12
    data[co : co + 8] = (int.from_bytes(data[co : co + 8], "big") + len(mvex)).to_bytes(8, "big")
    tfhd = box(b"tfhd", pack(">II", 0x20000, 1))
    trun = lambda offset: box(b"trun", pack(">IIi4I", 0x205 - 4 | 0x400, 2, offset, 5, 0, 6, 0x10000))  # noqa: E731  # sizes and flags of two samples
    moof = lambda offset: box(b"moof", box(b"traf", tfhd, trun(offset)))
    tail = moof(len(moof(0)) + 8) + box(b"mdat", b"helloworlds")
    track = media.parse_media(bytes(data) + tail)["tracks"][0]
    assert media.read_samples(bytes(data) + tail, track) == b"\1" * 128 + b"helloworlds"
    assert track["sizes"].tolist() == [64, 64, 5, 6] and track["keys"].tolist() == [0, 2] and track["ticks"] == 2_000 + 14
    rng = random.Random(2)
    for _ in range(2_000):
        broken = bytearray(data + tail)
        broken[rng.randrange(len(data), len(broken))] = rng.randrange(256)
        media.describe(bytes(broken))


def test_simhash_matches_all_pairs(spark, docs, sf):
    for df in (docs, table(spark, sf)):
        rows = df.select("doc_id", "text").collect()
        prints = [reference_print(r["text"]) for r in rows]
        root = list(range(len(rows)))

        def find(i):
            while root[i] != i:
                i = root[i]
            return i

        a = np.array(prints, dtype=np.uint64)
        for i in range(len(a)):
            for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 2):
                x, y = find(i), find(int(j))
                root[max(x, y)] = min(x, y)
        least = defaultdict(list)
        for i, r in enumerate(rows):
            if r["doc_id"] is not None:
                least[find(i)].append(r["doc_id"])
        want = Counter((r["doc_id"], f"{prints[i]:016x}", min(least[find(i)], default=None)) for i, r in enumerate(rows))
        assert want == Counter(map(tuple, simhash.simhash_digest(df).collect()))


def test_simhash_links_and_masks(spark):
    masks = simhash.covering_masks()
    rng = random.Random(5)
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)
    prints = set()
    for _ in range(40):  # crowded buckets: many prints around few centres
        c = rng.getrandbits(64)
        prints |= {c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.5) << rng.randrange(64) for _ in range(40)}
    prints = sorted(prints)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for i, p in enumerate(prints):
        for o in prints[:i]:
            if (p ^ o).bit_count() <= 2:
                root[find(p)] = find(o)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    found = {r["a"]: r["root"] for r in simhash.components(simhash.fingerprint_links(df)).collect()}
    classes = defaultdict(set)
    for p in prints:
        classes[find(p)].add(simhash._signed(p))
    for members in classes.values():
        assert {found.get(m, m) for m in members} == {min(members)}


def test_representatives_keep_one_row_of_each_class(spark, docs, empty):
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    rows = docs.select("doc_id", "text").collect()
    assert kept.count() <= simhash.near_duplicate_classes(docs, [], shingle=5).select("component_id").distinct().count()
    assert 30 < kept.count() < len(rows) - 30
    assert simhash.keep_representatives(empty).count() == 0
    clashing = simhash.near_duplicate_classes(docs, ["doc_id", "fp"])
    assert clashing.columns == ["doc_id", "fp", "fp_", "component_id"] and clashing.count() == len(rows)
    assert simhash.near_duplicate_classes(docs.withColumnRenamed("lang", "component_id"), ["component_id"]).columns == ["component_id", "fp", "component_id_"]


def test_similar_texts_go_and_less_similar_ones_stay(spark):
    rng = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in range(400)]
    texts = []
    for _ in range(60):  # an edit in 30 words: similarity about 0.7 to the first; then two edits of 200 words to one of these
        first = rng.choices(vocabulary, k=200)
        variants = [[rng.choice(vocabulary) if rng.random() < 1 / 30 else w for w in first] for _ in range(4)]
        copy = list(variants[-1])
        for at in rng.sample(range(200), 2):
            copy[at] = "edited"
        texts += [" ".join(t) for t in [first, *variants, copy]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_representatives(df).collect()}
    root = list(range(len(texts)))
    for lo in range(0, len(texts), 6):
        for i in range(lo, lo + 6):
            for j in range(lo, i):
                if simhash.similarity(texts[i], texts[j], 5) >= 0.8:
                    x, y = root[i], root[j]
                    root = [min(x, y) if r in (x, y) else r for r in root]
    assert kept == set(root) and len(kept) <= 300


def test_crowded_buckets_give_the_same_links(spark, monkeypatch):
    rng = random.Random(9)
    prints = {simhash._signed(1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ c) for c in (7, 1 << 63 | 5) for _ in range(80)}
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = []
    for most in (simhash.COMPARED, 1):
        monkeypatch.setattr(simhash, "COMPARED", most)
        found.append({(r["a"], r["root"]) for r in simhash.components(simhash.fingerprint_links(df)).collect()})
    assert found[0] == found[1] and found[0]


def test_long_texts_have_whole_fingerprints():
    text = " ".join(f"w{i % 977} {i}" for i in range(60_000))
    assert simhash.fingerprint(text) == reference_print(text) and simhash.fingerprint(text, 5) == reference_print(text, 5)


def test_packing_deals_copies_to_one_shard(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices([f"{a}{b}" for a in ("stone", "river", "cloud", "market") for b in range(400)], k=300)) for _ in range(200)]
    df = spark.createDataFrame([(i, texts[i % 200]) for i in range(400)], "doc_id long, text string")
    shards = defaultdict(set)
    for p in packing.pack(df, shard_docs=20).collect():
        shards[p["doc_id"]].add(p["sequence_id"] >> 24)
    assert len(set().union(*shards.values())) >= 10
    assert np.mean([shards[i] == shards[i + 200] for i in range(200)]) > 0.8


def test_packing_fetches_all_that_match():
    like, other = np.full(20, 7, np.uint16), np.full(20, 9, np.uint16)
    sequences = packing.pack_shard([like, other] * 60, window=1200)
    assert [{d % 2 for d, *_ in s} for s in sequences[:2]] == [{0}, {1}]


def test_packing_places_every_id_once(spark, docs, empty, sf):
    more = spark.createDataFrame([(900, "a   b \n \n c  ", ), (901, "x <|endoftext|> y")], "doc_id long, text string")
    for df in (docs.select("doc_id", "text").union(more), table(spark, sf).select("doc_id", "text")):
        check_packing(df.collect(), packing.pack(df).collect())
    assert packing.pack(empty).count() == 0


def test_packing_puts_like_documents_together():
    rng = np.random.default_rng(0)
    shard = [np.concatenate([[rng.integers(0, 40) + 100 * (i % 8) for _ in range(300)], [1]]).astype(np.uint16) for i in range(160)]
    rng.shuffle(shard)
    topic = [int(np.bincount(d[:-1] // 100).argmax()) for d in shard]
    together = [len({topic[d] for d, *_ in s}) for s in packing.pack_shard(shard) if len(s) > 3]
    assert np.mean(together) < 2.5


BASE = (
    (r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 8),
    (r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 16),
    (r"[0-9a-f]+", lambda m: len(m.group()) >= 32),
)


def test_secret_base_spans(spark, docs, sf):
    rng = random.Random(2)
    pieces = ["password", "Secret", "TOKEN", "api_key", "apiKey", '"', "'", ":", "=", " ", "AKIA", "ABCDEF0123456789", "deadbeef01234567", "abcdef" * 6, "x", "\n", "é", "K", "ſecret", "xAKIA", "hunter2hunter2"]
    rows = [(1000 + i, "".join(rng.choices(pieces, k=rng.randint(3, 30)))) for i in range(400)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string")).union(table(spark, sf).selectExpr("doc_id + 5000", "text"))
    want = Counter()
    for r in df.collect():
        spans = sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(BASE) for m in re.finditer(p, r["text"] or "") if ok(m))
        line = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        n = Counter(k for _, k, _ in spans)
        want[r["doc_id"], n[0], n[1], n[2], hashlib.sha256(line.encode()).hexdigest()] += 1
    got = secret_scan.secret_digest(df).collect()
    assert want == Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got)


def test_randomness_battery():
    rng = random.Random(9)
    for alphabet in ("0123456789abcdef", secret_scan.ALPHABETS[6][1], secret_scan.ALPHABETS[7][1]):
        p = [secret_scan.battery(t, secret_scan.infer_encoding(t)) for t in ("".join(rng.choices(alphabet, k=48)) for _ in range(500))]
        assert np.mean(np.array(p) < 0.01) < 0.05
    prose = secret_scan.codes("the ringing of a station in under an endless, hundred-handed table " * 50)
    ordinary = secret_scan.Ordinary(np.bincount(prose[:-1] << 7 | prose[1:], minlength=1 << 14))
    for regular in ("abcabcabcabcabcabcabcabc", "a" * 40, "0123456789abcdef0123456789abcdef", "theringationhendereable"):
        name = secret_scan.infer_encoding(regular)
        assert secret_scan.battery(regular, name) < 0.01 or ordinary.surprise(regular, name) < 5
    assert ordinary.surprise("x9Qz7Kp2Lm4Vb8Nc", "base62") > ordinary.surprise("theunderhandedtab", "base62") + 30


def test_secret_candidates_are_cut_where_no_alphabet_holds_them():
    cut = lambda t: [(a, b, x) for a, b, x in secret_scan.candidates(secret_scan.runs(t))]
    key = "q8Zk2Lm9Xw4Vb7Nc1Rt5"
    assert cut(f"session={key};") == [(8, 28, key)]
    assert cut(f"GITHUB_PAT_IS_HERE=ghp_{key}==") == [(0, 19, "GITHUB_PAT_IS_HERE="), (19, 45, f"ghp_{key}==")]
    assert (8, 30, f"x-{key}") in cut(f"/a_b/cd/x-{key}/e+f")
    assert cut("1234567890123456") == [(0, 16, "1234567890123456")]


def test_random_tokens_after_an_equals_sign(spark):
    rng = random.Random(8)
    digits, mixed = secret_scan.ALPHABETS[0][1], secret_scan.ALPHABETS[6][1]
    rows = [(i, "plain text of words with a path /usr/local_share/some-thing and=then some_long_identifier_name " * 3) for i in range(200)]
    rows += [(500 + i, f"sid={''.join(rng.choices(mixed, k=40))}&x /a-b/{''.join(rng.choices(mixed, k=30))}/c+d_e {''.join(rng.choices(digits, k=60))}") for i in range(20)]
    found = {r["doc_id"]: r["spans"] for r in secret_scan.secret_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(found[i] == "" for i in range(200))
    assert sum(found[500 + i].count("random") for i in range(20)) >= 35  # of 40: long digits follow the corpus's own digits
    assert sum(found[500 + i].startswith("random:4:44") for i in range(20)) >= 17


def test_many_secrets_in_one_long_text():
    prose = secret_scan.codes("some ordinary words " * 9)
    judge = secret_scan.Judge(secret_scan.Ordinary(np.bincount(prose[:-1] << 7 | prose[1:], minlength=1 << 14)))
    text = " ".join(f"password={i:08d}abc and {hashlib.sha256(str(i).encode()).hexdigest()}" for i in range(20_000))
    base, every = secret_scan.find_secrets(text, judge, [5] * 4)
    assert len(base) == 40_000 and every == base


def test_random_tokens_are_added_and_masked(spark, empty):
    rng = random.Random(4)
    alphabet = secret_scan.ALPHABETS[6][1]
    rows = [(i, "this is plain text with verylongcompoundwordsinside and-some-hyphenated-words-too " * 3) for i in range(200)]
    keys = ["".join(rng.choices(alphabet, k=40)) for _ in range(20)]
    rows += [(500 + i, f"see {k} here") for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in secret_scan.secret_digest(df).collect()}
    assert all(found[i] == "" for i in range(200))
    assert sum(found[500 + i] == "random:4:44" for i in range(20)) >= 17
    masked = {r["doc_id"]: r["text"] for r in secret_scan.mask_secrets(df).collect()}
    assert sum(masked[500 + i] == "see <random> here" for i in range(20)) >= 17
    assert secret_scan.secret_digest(empty).count() == 0


def test_language_accuracy_and_edges(spark, docs, empty, sf):
    truth = {r["doc_id"]: r["lang"] for r in table(spark, sf).select("doc_id", "lang").collect()}
    got = [r for r in langid.language_digest(table(spark, sf)).collect()]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    rows = docs.select("doc_id", "text").collect()
    out = langid.language_digest(docs).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    blank = {r["doc_id"] for r in rows if r["doc_id"] is not None and not any(map(str.isalpha, r["text"] or ""))}
    assert blank and all((r["lang_pred"] == "und") == (r["doc_id"] in blank) for r in out if r["doc_id"] is not None)
    assert langid.language_digest(empty).count() == 0
    unlabelled = langid.language_digest(docs.selectExpr("doc_id", "text", "cast(null as string) lang"))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}
    assert langid.keep_identified(docs).columns == docs.columns


def test_toxicity_accuracy_and_edges(spark, docs, labels, empty, sf):
    big = sf.replace("sf0.01", "sf0.1")  # sf0.01 holds out six toxic documents, too few for a rate
    marks = spark.read.parquet(f"{big}/labels.parquet")
    truth = {r["doc_id"]: r["toxic"] for r in marks.collect()}
    got = toxicity.toxicity_digest(table(spark, big), marks).collect()
    assert len(got) == table(spark, big).count()
    held = [(r["predicted"], truth[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([a == b for a, b in held]) > 0.96  # always answering 0 is right for 0.88
    assert np.mean([a for a, b in held if b]) > 0.8 and np.mean([b for a, b in held if a]) > 0.8
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in got)
    out = toxicity.toxicity_digest(docs, labels).collect()
    assert len(out) == docs.count() and all(r["score"] is not None for r in out)
    assert toxicity.toxicity_digest(empty, labels).count() == 0
    for nothing in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1")):
        assert {r["score"] < 0.5 for r in toxicity.toxicity_digest(docs, nothing).collect()} == {True}
        assert toxicity.keep_civil(docs, nothing).count() == docs.count()
    assert toxicity.keep_civil(docs, labels).columns == docs.columns


def test_long_texts_are_pooled_as_a_whole():
    rng = np.random.default_rng(0)
    shapes = {k: rng.normal(size=(k * toxicity.WIDTH, n)).astype(np.float32) for k, n in toxicity.FILTERS.items()}
    net = toxicity.Network(np.zeros((1, 1)), shapes, {k: np.ones(n, np.float32) for k, n in toxicity.FILTERS.items()}, rng.normal(size=48).astype(np.float32), 0.1)
    for n in (0, 1, 2, 3, 4095, 4096, 4097, 4098, 4099, 8192, 8193, 9000):
        x = rng.normal(-1, 1, (max(n, 1), toxicity.WIDTH)).astype(np.float32)
        whole = float(np.maximum(net.pools(x)[0], 0) @ net.out + net.out_bias)
        assert net.logit(x) == pytest.approx(whole, abs=1e-4)


def test_ftrl_matches_a_plain_loop():
    rng = np.random.default_rng(3)
    x = [(np.sort(rng.choice(langid.BUCKETS, 6, replace=False)), rng.random(6)) for _ in range(40)]
    y = rng.integers(0, 3, 40).tolist()
    w, bias = langid.train_ftrl(x, y, 3)
    z, n = {}, {}

    def weight(key):
        a = z.get(key, 0.0)
        return 0.0 if abs(a) <= langid.L1 else -(a - np.sign(a) * langid.L1) / ((langid.BETA + n.get(key, 0.0) ** 0.5) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(7)
    for _ in range(langid.EPOCHS):
        for i in order.permutation(40):
            at = [*x[i][0].tolist(), langid.BUCKETS]
            v = [*x[i][1].tolist(), 1.0]
            w_now = {(k, c): weight((k, c)) for k in at for c in range(3)}
            s = np.array([sum(a * w_now[k, c] for k, a in zip(at, v)) for c in range(3)])
            p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            for k, a in zip(at, v):
                for c in range(3):
                    g = a * (p[c] - (c == y[i]))
                    before = n.get((k, c), 0.0)
                    z[k, c] = z.get((k, c), 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / langid.ALPHA * w_now[k, c]
                    n[k, c] = before + g * g
    for k, c in z:
        assert (bias[c] if k == langid.BUCKETS else w[k, c]) == pytest.approx(weight((k, c)), abs=1e-6)


def test_every_label_is_a_class(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}" * 8, f"l{i:03d}") for i in range(230)]
    model = langid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.languages) == 230


def test_queries_are_registered():
    assert set(q.oracle_sql()) <= set(q.queries())
