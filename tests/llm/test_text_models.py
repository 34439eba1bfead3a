"""Pieces, language models, personal data and syncmers against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fareindex.llm import lm_score, pieces, pii, syncmers

DDL = "doc_id long, text string, lang string, score double, ids int, own int, bucket int"


def edge_rows():
    rng = random.Random(8)
    words = ["Alpha", "beta", "gamma,", "日本語のテキスト", "a▁b", "ñandú", "x" * 40, "\n", "  ", "0123", "a@b.co", "+1 (377) 555-0271"]
    texts = [None, "", " ", "  two", "a▁b ▁", "\x00\x01", "é", "😀 ok", "y" * 50_000, " ".join(rng.choices(words, k=6_000))]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(80)]
    rows = [(i, t, "en", 0.1, 1, 2, 3) for i, t in enumerate(texts)]
    return rows + [rows[12], rows[12], (None, "no id here", None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(edge_rows(), DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def table(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def unigram_processor():
    """The library's own Viterbi over the same pieces and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(pieces.default_pieces(), "rb").read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def test_pieces_match_library_viterbi(spark, table):
    sp = unigram_processor()
    model = pieces.load_pieces(pieces.default_pieces())
    score = {i: sp.get_score(i) for i in range(sp.get_piece_size())}
    # by line: an unknown character's penalty would drown the library's 32-bit sums
    texts = [line for r in table.select("text").limit(300).collect() for line in r["text"].split("\n")]
    for text, ours in zip(texts, model.encode(texts)):
        if not text:
            continue
        theirs = sp.nbest_encode_as_ids(text, 2)[0]  # its lattice; encode() takes a shortcut that misses better paths
        assert math.isclose(sum(score[i] for i in ours), sum(score[i] for i in theirs), rel_tol=1e-6)


def test_pieces_match_brute_force_viterbi():
    rng = random.Random(1)
    alphabet = {"".join(rng.choices("abc", k=n)): -rng.random() * n for n in (1, 2, 2, 3, 3, 3, 4, 4) for _ in range(3)}
    table = {w: (s, i + 300) for i, (w, s) in enumerate([("▁", -1.0), ("▁a", -0.7), ("▁ab", -1.1), *alphabet.items()])}
    model = pieces.PieceModel(table, {b: b for b in range(256)}, 0)

    def best(word):
        if not word:
            return 0.0
        options = [table[word[i:]][0] + best(word[:i]) for i in range(len(word)) if word[i:] in table]
        return max([*options, model.unknown_score + best(word[:-1])])

    words = ["▁" + "".join(rng.choices("abcd", k=rng.randint(0, 8))) for _ in range(300)]
    by_id = {i: s for s, i in table.values()}
    for word, ids in model.segment(list(set(words))).items():
        assert math.isclose(sum(by_id.get(i, model.unknown_score) for i in ids), best(word), abs_tol=1e-9)


def test_pieces_round_trip(spark, docs, empty, table):
    for df in (docs, table):
        got = pieces.piece_digest(df).collect()
        assert len(got) == df.count() and all(r["exact"] for r in got)
        want = Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in df.select("doc_id", "text").collect())
        assert want == Counter((r["doc_id"], r["decoded_sha256"]) for r in got)
    assert pieces.piece_digest(empty).count() == 0
    back = pieces.decode_ids(pieces.encode_texts(docs.select("doc_id", "text"), ["doc_id"]), ["doc_id"])
    assert Counter(map(tuple, back.collect())) == Counter((r["doc_id"], r["text"] or "") for r in docs.collect())


def brute_losses(texts, vocabulary):
    size = len(vocabulary)
    ids = {w: i for i, w in enumerate(vocabulary) if i > 1}
    pairs, uni = Counter(), Counter()
    for t in texts:
        x = [1, *(ids.get(w, 0) for w in re.findall(r"\w+", (t or "").lower()))]
        pairs.update(zip(x, x[1:]))
        uni.update(x[1:])
    total = sum(uni.values())
    seen, kinds = Counter(), Counter()
    for (a, _), n in pairs.items():
        seen[a] += n
        kinds[a] += 1

    def loss(a, b):
        k = max(kinds[a], 1)
        return -math.log2((pairs[a, b] + k * (uni[b] + 1) / (total + size)) / (seen[a] + k))

    return loss, ids


def test_lm_scores_match_brute_force(spark, docs, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 90, 3)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = lm_score.quality_scores(docs, labels).collect()
    rows = docs.select("doc_id", "text").collect()
    good = {i for i in range(0, 90, 3) if i % 2}
    vocabulary = ["", "", *{w for r in rows for w in re.findall(r"\w+", (r["text"] or "").lower())}]
    sides = [brute_losses([r["text"] for r in rows if (r["doc_id"] in good) == side], vocabulary) for side in (True, False)]
    want = defaultdict(list)
    for r in rows:
        x = [1, *(sides[0][1].get(w, 0) for w in re.findall(r"\w+", (r["text"] or "").lower()))]
        a, b = (sum(loss(*p) for p in zip(x, x[1:])) / max(len(x) - 1, 1) for loss, _ in sides)
        want[r["doc_id"]].append((len(x) - 1, a, b, a - b))
    assert len(got) == len(rows)
    for r in got:
        assert any(np.allclose(tuple(r)[1:], w, atol=1e-4) for w in want[r["doc_id"]])
    assert lm_score.quality_scores(empty, labels).count() == 0
    assert lm_score.quality_scores(docs, labels.limit(0)).count() == len(rows)


PATTERNS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.sub(r"\D", "", s)) <= 19 and pii.luhn(re.sub(r"\D", "", s))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.findall("[0-9]", s)) <= 15),
)


def brute_spans(text):
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(PATTERNS) for m in re.finditer(p, text) if ok(m.group()))


def test_base_spans_match_patterns(table):
    rng = random.Random(6)
    parts = ["a", "b.c", "@", ".", "-", " ", "_", "+", "1", "12", "255", "256", "192.168.0.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (377) 555-0271", "(", ")", "é", "x@y.z", "\n", "007"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 14)))
        assert pii.base_spans(text) == brute_spans(text), text
    found = 0
    for r in table.select("text").collect():
        assert pii.base_spans(r["text"]) == brute_spans(r["text"])
        found += len(pii.base_spans(r["text"]))
    assert found > 20
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_disclosing_terms_match_brute_force(spark, docs, empty):
    rng = random.Random(7)
    filler = [f"{a}{b}word" for a in "abcdefgh" for b in "klmnopqr"]
    rows = [(i, " ".join(rng.choices(filler, k=20))) for i in range(300)]
    for i in range(12):
        rows.append((400 + i, f"{' '.join(rng.choices(filler, k=5))} codename Zanzibar mail jo{i % 2}@corp.example now {' '.join(rng.choices(filler, k=5))}"))
    rows += [(500, "the İstanbul office of ann@one.example, wordless akwordy"), (501, "akwordish "), (502, "akwordier")]
    df = spark.createDataFrame(rows, "doc_id long, text string").union(docs.where("doc_id is not null").dropDuplicates(["doc_id"]).selectExpr("doc_id + 1000", "text"))
    got = {r["doc_id"]: r for r in pii.personal_data_digest(df).collect()}
    source = df.collect()
    texts = [r["text"] or "" for r in source]
    total = len(texts)
    gram_docs, entity_docs, together = Counter(), Counter(), Counter()
    cases = []
    for t in texts:
        words = {w.lower() for w in re.findall(r"[^\W_]{3,}", t)}
        gram_docs.update({g for w in words for g in (w, w[:5] + "*" if len(w) > 5 else w, w[:3] + "*" if len(w) > 3 else w)})
        spans = brute_spans(t)
        held = {pii.entity_key(k, t[a:b]) for a, k, b in spans}
        free = [m for m in re.finditer(r"[^\W_]{3,}", t) if not any(a < m.end() and m.start() < b for a, _, b in spans)] if spans else []
        entity_docs.update(held)
        mine = {m.group().lower() for m in free}
        together.update({(e, g) for e in held for w in mine for g in (w, w[:5] + "*" if len(w) > 5 else w, w[:3] + "*" if len(w) > 3 else w)})
        cases.append((spans, held, free))

    def bad(entity, gram):
        info = -math.log(entity_docs[entity] / total)
        chance = (min(together[entity, gram], gram_docs[gram]) + entity_docs[entity] / total) / (gram_docs[gram] + 1)
        return (math.log(chance) + info) / info >= 0.8

    for r, (spans, held, free) in zip(source, cases):
        terms = [(m.start(), 4, m.end()) for m in free if any(bad(e, m.group().lower()) for e in held)]
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted([*spans, *terms]))
        assert got[r["doc_id"]]["spans"] == line
    assert all("term" in got[400 + i]["spans"] for i in range(12))
    assert all("term" not in got[i]["spans"] for i in range(300))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df).collect()}
    assert "Zanzibar" not in clean[400] and "jo0@corp.example" not in clean[400] and clean[70] == rows[70][1]
    assert "stanbul" not in clean[500] and "<email>" in clean[500]
    assert pii.personal_data_digest(empty).count() == 0
    assert pii.sanitise(docs).columns == docs.columns and pii.sanitise(docs).count() == docs.count()


def test_terms_give_way_to_their_longest_safe_stem(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["merchant", "merciful", "meridian", "river", "stone"], k=9))) for i in range(400)]
    rows += [(900, "a mercenary wrote to jo@corp.example about zanzibar"), (901, "mercantile stone")]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    words = clean[900].split(" ")
    assert words[1] == "mer*" or words[1] == "merce*"
    assert words[-1] == "" and words[4] == "<email>"
    assert clean[901] == "mercantile stone"


def brute_anchors(spark, texts):
    """Each text's anchors and first positions by plain loops; hashes come from Spark's xxhash64, looked up by their input."""
    from pyspark.sql import functions as F

    wide = "\u0e00-\u0eff\u3040-\u9fff\U00020000-\U000323af"
    cut = [re.findall(f"[^ \\t\\n\\x0b\\f\\r{wide}]{{1,16}}|[{wide}]", t) for t in texts]
    cut = [[""] * 4 + c + [""] * 4 if c else [] for c in cut]
    pairs = sorted({p for c in cut for p in zip(c, c[1:])})
    h2 = {(r["a"], r["b"]): r["h"] for r in spark.createDataFrame(pairs or [("", "")], "a string, b string").withColumn("h", F.xxhash64("a", "b")).collect()}
    chosen = []
    for c in cut:
        h = [h2[p] for p in zip(c, c[1:])]
        chosen.append([(i - 4, tuple(h[i : i + 4])) for i in range(len(c) - 4) if min(h[i : i + 4]) in (h[i], h[i + 3])])
    quads = sorted({q for c in chosen for _, q in c})
    h4 = {tuple(r)[:4]: r["h"] for r in spark.createDataFrame(quads or [(0, 0, 0, 0)], "a long, b long, c long, d long").withColumn("h", F.xxhash64("a", "b", "c", "d")).collect()}
    out = []
    for c in chosen:
        first = {}
        for i, q in c:
            first.setdefault(h4[q], i)
        out.append(first)
    return out


def brute_likeness(a, b):
    if not a and not b:
        return 1.0
    shifts = [b[x] - i for i, x in sorted((i, x) for x, i in a.items()) if x in b]
    chained = sum(1 for i, s in enumerate(shifts) if i == 0 or i == len(shifts) - 1 or s in (shifts[i - 1], shifts[i + 1]))
    return 2 * chained / (len(a) + len(b))


def test_syncmers_match_brute_force(spark, docs, empty, table, monkeypatch):
    monkeypatch.setattr(syncmers, "BUCKET_ROWS", 7)
    for df in (docs.where("doc_id is not null").dropDuplicates(["doc_id"]), table):
        rows = sorted(((r["doc_id"], r["text"] or "") for r in df.collect()))
        texts = [t for _, t in rows]
        after = texts[1:] + texts[:1]
        edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, after)]
        own, changed = brute_anchors(spark, texts), brute_anchors(spark, edited)
        hexed = lambda s: hashlib.sha256(",".join(f"{x & (1 << 64) - 1:X}:{i}" for x, i in sorted(s.items())).encode()).hexdigest()
        want = {}
        for i, (d, t) in enumerate(rows):
            want[d] = (len(t), hashlib.sha256(edited[i].encode()).hexdigest(), hexed(own[i]), hexed(changed[i]), brute_likeness(own[i], changed[i]), brute_likeness(own[i], own[(i + 1) % len(rows)]))
        got = syncmers.syncmer_digest(df).collect()
        assert len(got) == len(rows)
        for r in got:
            assert tuple(r)[1:5] == want[r["doc_id"]][:4] and np.allclose(tuple(r)[5:7], want[r["doc_id"]][4:])
    assert syncmers.syncmer_digest(docs).count() == docs.count()
    assert syncmers.syncmer_digest(empty).count() == 0
    one = syncmers.syncmer_digest(docs.limit(1)).first()
    assert one["near_next"] == 1.0
    clashing = syncmers.with_next(docs.withColumnRenamed("own", "guest"), ["text"])
    assert {"bucket", "guest", "next_text"} <= set(clashing.columns) and clashing.where("bucket = 3").count() == docs.where("bucket = 3").count()


def test_a_moved_passage_keeps_its_anchors(spark):
    rng = random.Random(4)
    words = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passage = words(60)
    rows = [(f"{words(500)} {passage} {words(700)}", f"{words(90)} {passage} {words(40)}"), ("a bc", "a bc"), ("one two", "three four"), (None, "")]
    df = spark.createDataFrame(rows, "x string, y string")
    df = syncmers.with_match(syncmers.with_anchors(syncmers.with_anchors(df, "x", "a"), "y", "b"), "a", "b", "m")
    got = df.select("m", syncmers.likeness("a", "b", "m").alias("near")).collect()
    assert len(got[0]["m"]) > 20 and {s["shift"] for s in got[0]["m"]} == {-410} and all(500 <= s["position"] < 560 for s in got[0]["m"])
    assert got[1]["near"] == 1.0 and got[2]["near"] < 0.8 and got[3]["near"] == 1.0


def test_syncmers_are_native(spark, table):
    plan = syncmers.syncmer_digest(table)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_lm_vocabulary_grows_with_the_corpus(spark):
    """Rare words keep losses of their own however many words are more frequent."""
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{k}" for k in rng.sample(range(1_500), 60))) for i in range(200)]
    rows += [(1000 + i, "rarely seenword") for i in range(3)] + [(2000 + i, "other plainword") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1000 + i, 1, 0) for i in range(3)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in lm_score.quality_scores(df, labels).collect()}
    vocabulary = ["", "", *{w for _, t in rows for w in t.split()}]
    sides = [brute_losses([t for d, t in rows if (1000 <= d < 1003) == side], vocabulary) for side in (True, False)]
    for d, t in rows:
        x = [1, *(sides[0][1][w] for w in t.split())]
        want = [sum(loss(*p) for p in zip(x, x[1:])) / (len(x) - 1) for loss, _ in sides]
        assert np.allclose((got[d]["target_loss"], got[d]["background_loss"]), want, atol=1e-6)
    assert got[1000]["score"] < got[2000]["score"] - 1


def test_terms_far_from_their_entity_are_taken_out(spark):
    rng = random.Random(3)
    filler = [f"{a}{b}word" for a in "abcdefgh" for b in "klmnopqr"]
    rows = [(i, " ".join(rng.choices(filler, k=40))) for i in range(300)]
    rows += [(400 + i, f"zanzibar {' '.join(rng.choices(filler, k=30))} jo@corp.example {' '.join(rng.choices(filler, k=30))} Zanzibar") for i in range(6)]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("zanzibar" not in clean[400 + i].lower() for i in range(6))
    assert all(clean[i] == rows[i][1] for i in range(300))


def test_toxicity_vectors_after_the_vocabulary_is_cleared():
    from fareindex.llm import toxicity

    none = np.zeros((0, 5), np.int64)
    model = toxicity.ToxicityModel([toxicity.train_network([], none, [], seed) for seed in range(2)])  # random starts
    scorer = toxicity.Scorer(model)
    scorer.vocab.limit = 10
    parts = [[" ".join(f"w{i}" for i in range(lo, hi))] for lo, hi in ((0, 20), (100, 160), (5, 12), (150, 400))]
    for part in parts + parts:
        fresh = toxicity.Scorer(model)
        assert np.allclose(scorer.logits(part), fresh.logits(part), atol=1e-5)
        assert not scorer.vocab.rows
