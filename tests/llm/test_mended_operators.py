"""Personal data in crowded texts, a model that doesn't depend on dealing, and the network against plain loops and numeric gradients."""

import itertools
import random

import numpy as np
import pytest

from fareindex.llm import pii, secret_scan, simhash, toxicity


def test_a_text_of_twenty_thousand_addresses(spark):
    rng = random.Random(2)
    filler = [f"{a}{b}word" for a in "abcdefgh" for b in "klmnopqr"]
    rows = [(i, " ".join(rng.choices(filler, k=30))) for i in range(300)]
    rows.append((900, " ".join(f"u{i}@corp{i}.example" for i in range(20_000)) + " zanzibar quagga " + " ".join(rng.choices(filler, k=200))))
    rows += [(901 + i, f"u{i}@corp{i}.example {rng.choice(filler)}{' zanzibar' if i == 0 else ''}") for i in range(5)]
    got = {r["doc_id"]: r for r in pii.personal_data_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[900]["n_email"] == 20_000 and got[900]["n_terms"] == 2 and got[901]["n_terms"] == 1
    assert sum(got[i]["n_terms"] for i in range(300)) == 0


def test_a_footer_in_a_third_of_all_texts(spark, monkeypatch):
    """Terms and entities of very many documents take the broadcast side of the join; the result is that of the plain one."""
    rng = random.Random(4)
    filler = [f"{a}{b}word" for a in "abcdefgh" for b in "klmnopqr"]
    rows = [(i, f"{' '.join(rng.choices(filler, k=8))}{' colophon desk@press.example' if i % 3 == 0 else ''}{f' vault{i % 7} jo{i}@corp.example' if i % 50 == 0 else ''}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    digest = lambda: sorted(tuple(r) for r in pii.personal_data_digest(df).collect())
    plain = digest()
    monkeypatch.setattr(pii, "HOT", 20)
    assert digest() == plain
    assert all("term" in spans for i, *_, spans, n, m in plain if i % 3 == 0)


def test_ordinary_text_is_the_same_however_rows_are_dealt(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    docs = docs.union(spark.createDataFrame([(None,), ("",), ("a",), ("日本",)], "text string"))
    one, seven = (secret_scan.ordinary_text(docs.repartition(n)).nats for n in (1, 7))
    assert (one == seven).all()
    want = np.zeros(1 << 14)
    for r in docs.collect():
        x = [ord(c) if ord(c) < 128 else 0 for c in r["text"] or ""]
        np.add.at(want, [a << 7 | b for a, b in zip(x, x[1:])], 1)
    assert np.allclose(secret_scan.Ordinary(want).nats, one)


def network(seed):
    net = toxicity.train_network([], np.zeros((0, 5), np.int64), [], seed)
    net.embedding = net.embedding.astype(float)
    net.out = net.out.astype(float)
    net.filters = {k: v.astype(float) for k, v in net.filters.items()}
    net.biases = {k: np.random.default_rng(seed).normal(0, 0.2, len(v)) for k, v in net.biases.items()}
    return net


def plain_logit(net, x):
    """Word by word, filter by filter; texts shorter than a filter are padded with zeros."""
    pooled = []
    for k, w in net.filters.items():
        padded = [list(v) for v in x] + [[0.0] * toxicity.WIDTH] * max(0, k - len(x))
        for f in range(w.shape[1]):
            best = max(sum(padded[i + j][d] * w[j * toxicity.WIDTH + d, f] for j in range(k) for d in range(toxicity.WIDTH)) for i in range(len(padded) - k + 1))
            pooled.append(max(best + net.biases[k][f], 0.0))
    return sum(p * o for p, o in zip(pooled, net.out)) + net.out_bias


@pytest.mark.parametrize("n", [1, 2, 6])
def test_network_equals_plain_loops(n):
    net = network(n)
    x = np.random.default_rng(n).normal(size=(n, toxicity.WIDTH))
    assert net.logit(x) == pytest.approx(plain_logit(net, x), abs=1e-9)


@pytest.mark.parametrize("n, label", [(0, 1.0), (1, 0.0), (5, 1.0), (9, 0.0)])
def test_gradient_equals_differences(n, label):
    net, rng = network(3), np.random.default_rng(n)
    rows = rng.integers(0, 40, (n, 5))
    keep = (rng.random(len(net.out)) > 0.2) / 0.8
    params = {"e": net.embedding, "o": net.out, "ob": np.array([0.3])} | {f"w{k}": v for k, v in net.filters.items()} | {f"b{k}": v for k, v in net.biases.items()}

    def loss():
        x = params["e"][rows].sum(1) if n else np.zeros((1, toxicity.WIDTH))
        z = np.maximum(net.pools(x)[0], 0) * keep @ params["o"] + params["ob"][0]
        return 0.7 * (np.log1p(np.exp(z)) - label * z)

    grad, words, by = toxicity.gradient(net, params, rows, label, 0.7, keep)
    grad["e"] = np.zeros_like(params["e"])
    for w, g in zip(words, by):
        np.add.at(grad["e"], w.ravel(), np.repeat(g, 5, axis=0))
    for name, value in params.items():
        flat, own = value.reshape(-1), grad[name].reshape(-1)
        places = set(rng.integers(0, min(len(flat), 40 * toxicity.WIDTH), 30).tolist()) | set(np.argsort(-np.abs(own))[:10].tolist())
        for at in places:
            was = flat[at]
            flat[at] = was + 1e-6
            high = loss()
            flat[at] = was - 1e-6
            low = loss()
            flat[at] = was
            assert own[at] == pytest.approx((high - low) / 2e-6, abs=1e-6), (name, at)


def test_components_are_the_same_in_one_partition_and_dealt(spark, monkeypatch):
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(60), 2), reverse=True)) for _ in range(45)}
    root = list(range(60))
    for _ in root:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    want = {(a, r) for a, r in enumerate(root) if a != r}
    links = spark.createDataFrame(sorted(pairs), "a long, b long")
    for few in (simhash.FEW_LINKS, 0):
        monkeypatch.setattr(simhash, "FEW_LINKS", few)
        assert {tuple(r) for r in simhash.components(links).collect()} == want


def test_partners_in_a_crowd_of_less_similar_texts_are_found(spark):
    """Each of 200 pairs at 0.85 stands in every bucket among texts at 0.72 to 0.79, so its partner is seldom the first or last there."""
    base = [f"w{i}" for i in range(204)]
    rows = []
    for k, (i, j) in enumerate(list(itertools.combinations(range(22), 2))[:200]):
        for side in "ab":
            words = list(base)
            for at in (9 * i + 4, 9 * j + 4):
                words[at : at + 4] = [f"{side}{k}x{at + n}" for n in range(4)]
            rows.append((2 * k + (side == "b"), " ".join(words)))
    texts = dict(rows)
    assert simhash.similarity(texts[0], texts[1], 5) > 0.8 > simhash.similarity(texts[0], texts[2], 5)
    kept = simhash.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
    prints, root = [simhash.fingerprint(t, 5) for t in texts.values()], list(range(400))
    for a, b in itertools.combinations(range(400), 2):
        if a // 2 == b // 2 or (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    assert {r["doc_id"] for r in kept.collect()} == set(root)
