"""Toxicity scores from a convolutional text classifier.

Words become sums of hashed embeddings (the word and its character prefixes and
suffix), filters of several widths slide over them and are max-pooled over the
whole text, and a logistic layer reads the pools. Everything is trained in numpy
on a bounded labelled sample. Each language, as far as it can be told from the
text alone, has its own threshold, and scores are shifted so that it lies at 0.5.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fareindex.llm.common import free_name, hashed_share, is_held_out, map_texts
from fareindex.llm.langid import LanguageModel, fit_languages

SAMPLE_PER_CLASS = 2_400  # bound on the labelled rows of each class that the network is trained on
SAMPLE_CHARS = 40_000_000  # bound on the characters of that sample
UNTOLD = -1.0  # logit of every text where there is nothing to learn from
BUCKETS, WIDTH = 1 << 15, 16
FILTERS = {1: 32, 2: 8, 3: 8}
NETWORKS = 3
EPOCHS, LEAST_STEPS, BATCH, RATE = 2, 550, 16, 0.015
CHUNK_WORDS = 4096  # words in memory at once; pools are combined over chunks, which overlap
SHRINKAGE = 10.0  # positives that a language needs to count as much as the prior
LEAST_WORD = re.compile(r"\w+")


def word_hashes(word: str) -> list[int]:
    """Hashes of a lower-cased word: itself, its prefixes of 4 to 6 letters, its last 4."""
    crc, long = zlib.crc32, word.encode("utf-8", "surrogatepass")
    return [crc(long, 1), *(crc(word[:n].encode("utf-8", "surrogatepass"), n) for n in (4, 5, 6)), crc(word[-4:].encode("utf-8", "surrogatepass"), 2)]


class Vocabulary:
    """Word to number; `rows` holds the hashes of words since the last `take`. Cleared when full, so a worker's memory is bounded."""

    def __init__(self, limit: int = 1 << 16):
        self.limit, self.ids, self.rows = limit, {}, []

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.ids) > self.limit:
            self.ids, self.rows = {}, []
        ids = self.ids
        for w in set(words).difference(ids):
            ids[w] = len(ids)
            self.rows.append(word_hashes(w))
        return np.fromiter(map(ids.__getitem__, words), np.int64, len(words))

    def take(self) -> np.ndarray:
        """Bucket ids of the words that are new since the last call; theirs are the highest numbers."""
        rows, self.rows = np.array(self.rows, np.int64).reshape(-1, 5) % BUCKETS, []
        return rows


@dataclass
class Network:
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width * WIDTH, n)
    biases: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float

    def pools(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Max of each filter over the word vectors x, and where it is."""
        top, at = [], []
        for k, w in self.filters.items():
            y = x if len(x) >= k else np.concatenate([x, np.zeros((k - len(x), WIDTH), x.dtype)])
            n = len(y) - k + 1
            z = sum(y[j : j + n] @ w[j * WIDTH : (j + 1) * WIDTH] for j in range(k))
            best = z.argmax(0)
            top.append(z[best, np.arange(z.shape[1])] + self.biases[k])
            at.append(best)
        return np.concatenate(top), np.concatenate(at)

    def logit(self, vectors: np.ndarray) -> float:
        best = None
        lap = max(self.filters) - 1  # words that a chunk shares with the next: no window is cut, and none is made of padding
        for lo in range(0, max(len(vectors) - lap, 1), CHUNK_WORDS):
            top = self.pools(vectors[lo : lo + CHUNK_WORDS + lap])[0]
            best = top if best is None else np.maximum(best, top)
        return float(np.maximum(best, 0) @ self.out + self.out_bias)


@dataclass
class ToxicityModel:
    networks: list[Network]  # trained from different starts; their logits are averaged; none: every text scores alike
    languages: LanguageModel | None = None
    thresholds: dict[str, float] = field(default_factory=dict)  # a logit for each language


def words_of(text: str | None) -> list[str]:
    return LEAST_WORD.findall((text or "").lower())


def train(texts: list[str], labels: list[int]) -> ToxicityModel:
    if len(set(labels)) < 2:
        return ToxicityModel([])
    vocab = Vocabulary(1 << 60)
    docs = [vocab(words_of(t)) for t in texts]
    buckets = vocab.take()
    return ToxicityModel([train_network(docs, buckets, labels, seed) for seed in range(NETWORKS)])


def gradient(model: Network, params: dict, rows: np.ndarray, label: float, weight: float, keep: np.ndarray):
    """Of `weight` times the logistic loss of one document: (by parameter but the embedding, buckets of words, what each word's vector gets).

    rows: five buckets for each word; keep: what each pooled filter is multiplied by.
    """
    x = params["e"][rows].sum(1) if len(rows) else np.zeros((1, WIDTH), params["e"].dtype)
    top, at = model.pools(x)
    dropped = np.maximum(top, 0) * keep
    p = 1 / (1 + np.exp(-np.clip(dropped @ params["o"] + params["ob"][0], -30, 30)))
    g = (p - label) * weight
    grad = {"o": g * dropped, "ob": np.array([g])}
    back = g * params["o"] * keep * (top > 0)
    touched, touched_by, f = [], [], 0
    for k, w in model.filters.items():
        n = w.shape[1]
        b, where = back[f : f + n], at[f : f + n]
        f += n
        grad[f"b{k}"] = b
        into = grad[f"w{k}"] = np.zeros_like(w)
        live = np.flatnonzero(b)
        for j in range(k):
            at_word = where[live] + j
            c, r = live[at_word < len(x)], at_word[at_word < len(x)]
            into[j * WIDTH : (j + 1) * WIDTH, c] += b[c] * x[r].T
            if len(rows):
                touched.append(rows[r])
                touched_by.append(b[c][:, None] * w[j * WIDTH : (j + 1) * WIDTH, c].T)
    return grad, touched, touched_by


def train_network(docs: list[np.ndarray], buckets: np.ndarray, labels: list[int], seed: int) -> Network:
    """Adam on the logistic loss, both classes weighing the same. docs: rows of `buckets` for each word."""
    rng = np.random.default_rng(seed)
    model = Network(
        rng.normal(0, 0.3, (BUCKETS, WIDTH)).astype(np.float32),
        {k: rng.normal(0, (k * WIDTH) ** -0.5, (k * WIDTH, n)).astype(np.float32) for k, n in FILTERS.items()},
        {k: np.zeros(n, np.float32) for k, n in FILTERS.items()},
        rng.normal(0, 0.3, sum(FILTERS.values())).astype(np.float32),
        0.0,
    )
    y = np.array(labels, np.float32)
    share = float(y.mean()) if len(y) else 0.5
    weight = np.where(y == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
    params = {"e": model.embedding, "o": model.out, "ob": np.zeros(1, np.float32)} | {f"w{k}": v for k, v in model.filters.items()} | {f"b{k}": v for k, v in model.biases.items()}
    first, second = ({k: np.zeros_like(v) for k, v in params.items()} for _ in range(2))
    step, batch = 0, BATCH
    epochs = max(EPOCHS, LEAST_STEPS * batch // len(docs)) if len(docs) else 0
    total = epochs * -(-len(docs) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for lo in range(0, len(order), batch):
            grad = {k: np.zeros_like(v) for k, v in params.items() if k != "e"}
            touched, touched_by = [], []
            part = order[lo : lo + batch]
            for i in part:
                rows = buckets[docs[i]] if len(docs[i]) else np.zeros((0, 5), np.int64)
                keep = ((rng.random(len(model.out)) > 0.2) / 0.8).astype(np.float32)  # dropout
                own, words, by = gradient(model, params, rows, y[i], weight[i] / len(part), keep)
                for k, g in own.items():
                    grad[k] += g
                touched += words
                touched_by += by
            step += 1
            fix = RATE * (1 - 0.9 * step / total) * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for k, g in grad.items():
                g = g + 1e-5 * params[k]
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                params[k] -= (fix * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
            if touched:
                at, inverse = np.unique(np.concatenate(touched).ravel(), return_inverse=True)
                g = np.zeros((len(at), WIDTH), np.float32)
                np.add.at(g, inverse, np.repeat(np.concatenate(touched_by), 5, axis=0))
                first["e"][at] += 0.1 * (g - first["e"][at])
                second["e"][at] += 0.001 * (g * g - second["e"][at])
                params["e"][at] -= fix * first["e"][at] / (np.sqrt(second["e"][at]) + 1e-8)
    model.out_bias = float(params["ob"][0])
    return model


def best_threshold(logits: np.ndarray, y: np.ndarray, prior: float) -> float:
    """The cut with the most F1 (among those that share it, the nearest to `prior`), drawn to `prior` while positives are few."""
    if not len(y) or not y.any() or y.all():
        return prior
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    at = int(f1.argmax())
    high = logits[order[at]]
    low = logits[order[at + 1]] if at + 1 < len(order) else min(prior, high) - 1
    margin = 0.1 * (high - low)
    cut, n = np.clip(prior, low + margin, high - margin), float(y.sum())
    return float((n * cut + SHRINKAGE * prior) / (n + SHRINKAGE))


class Scorer:
    """Scores lists of texts in a task; vectors of known words are kept."""

    def __init__(self, model: ToxicityModel):
        self.model, self.vocab = model, Vocabulary()
        self.embedding = np.concatenate([np.zeros((BUCKETS, 0), np.float32), *[net.embedding for net in model.networks]], axis=1)
        self.vectors = np.zeros((1024, len(model.networks) * WIDTH), np.float32)

    def logits(self, texts: list) -> list[float]:
        if not self.model.networks:
            return [UNTOLD] * len(texts)
        words = [words_of(t) for t in texts]
        ids = self.vocab([w for part in words for w in part])
        new, n = self.vocab.take(), len(self.vocab.ids)
        if n > len(self.vectors):
            self.vectors = np.resize(self.vectors, (2 * n, self.vectors.shape[1]))
        for lo in range(0, len(new), 8192):
            some, at = new[lo : lo + 8192], n - len(new) + lo
            self.vectors[at : at + len(some)] = sum(self.embedding[some[:, j]] for j in range(5))
        out, lo = [], 0
        for part in words:
            at, lo = ids[lo : lo + len(part)], lo + len(part)
            x = self.vectors[at] if len(at) else np.zeros((1, self.vectors.shape[1]), np.float32)
            nets = self.model.networks
            out.append(sum(net.logit(x[:, i * WIDTH : (i + 1) * WIDTH]) for i, net in enumerate(nets)) / len(nets))
        return out

    def scores(self, texts: list) -> list[float]:
        known = self.model.languages
        names = known.predict(texts)[0] if known else [""] * len(texts)
        cuts = self.model.thresholds
        shifted = [z - cuts.get(name, cuts.get("", 0.0)) for z, name in zip(self.logits(texts), names)]
        return [float(1 / (1 + np.exp(-np.clip(z, -30, 30)))) for z in shifted]


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int, most_chars: int = SAMPLE_CHARS) -> list:
    """Labelled (doc_id, text, toxic), picked by hash: `per_class` ids of each class and `most_chars` characters at most.

    Only ids and lengths are compared first; a text that would go beyond the
    bound is left out of the sample.
    """
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.withColumn("u", hashed_share("doc_id", seed="toxicity"))
    drawn = [marks.where(F.col("toxic") == c).orderBy("u", "doc_id").limit(per_class) for c in (0, 1)]
    ids = drawn[0].union(drawn[1])  # 2 * per_class rows at most
    hit = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("hash")).join(F.broadcast(ids), "doc_id")
    sizes = hit.groupBy("doc_id", "hash").agg(F.min("u").alias("u"), F.max(F.length("text")).alias("chars")).orderBy("u", "doc_id", "hash").limit(3 * per_class).collect()
    chosen, left = [], most_chars
    for r in sizes:
        if r["chars"] <= left:
            chosen.append((r["doc_id"], r["hash"]))
            left -= r["chars"]
    if not chosen:
        return []
    picked = docs.sparkSession.createDataFrame(chosen, T.StructType([docs.schema["doc_id"], T.StructField("hash", T.LongType())]))
    rows = hit.join(F.broadcast(picked), ["doc_id", "hash"]).select("doc_id", "hash", "text", "toxic").dropDuplicates(["doc_id", "hash"]).collect()
    return sorted(rows, key=lambda r: (xxhash.xxh64_intdigest(str(r["doc_id"])), r["text"]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> ToxicityModel:
    """Train on the labelled sample; a fifth of it sets the thresholds.

    Rows without a label, text or id teach nothing. Without labelled rows of both
    classes nothing can be told apart: every text then gets the same score, under
    a half. The language that picks a threshold is learned from all of `docs`.
    """
    rows = labelled_sample(docs, labels, per_class)
    rest = [r for i, r in enumerate(rows) if i % 5 == 0]
    fit = [r for i, r in enumerate(rows) if i % 5]
    model = train([r["text"] for r in fit], [r["toxic"] for r in fit])
    if not model.networks:
        return model
    model.languages = fit_languages(docs)
    logits, y = np.array(Scorer(model).logits([r["text"] for r in rest])), np.array([r["toxic"] for r in rest])
    names = np.array(model.languages.predict([r["text"] for r in rest])[0])
    model.thresholds[""] = best_threshold(logits, y, 0.0)
    for name in sorted(set(names)):
        at = names == name
        model.thresholds[str(name)] = best_threshold(logits[at], y[at], model.thresholds[""])
    return model


def toxicity(docs: DataFrame, model: ToxicityModel, keep: list[str], score: str = "score") -> DataFrame:
    """`docs[keep]` with `score` in 0 to 1 from the whole text.

    The model is of fixed size and broadcast. Null and wordless texts count as
    empty and are scored like any other; equal texts score alike; very long texts
    are pooled in chunks that give what the whole would; an empty table gives no
    row. `score` must not be a name in `keep`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        scorer = Scorer(shared.value)
        return lambda texts: {score: scorer.scores(texts)}

    return map_texts(docs, start, f"`{score}` double", keep)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learned from the rows outside the held-out fifth, applied to all; cases as in `toxicity` and `fit_toxicity`."""
    model = fit_toxicity(docs.where(~is_held_out()), labels.where(~is_held_out()))
    found = toxicity(docs, model, ["doc_id"])
    return found.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score under 0.5, with their columns; without labels of both classes, all of them.

    Other cases as in `toxicity`; names in `docs` don't clash with the score's.
    """
    score = free_name(docs, "toxicity_score")
    return toxicity(docs, fit_toxicity(docs, labels), docs.columns, score).where(F.col(score) < 0.5).select(*docs.columns)
