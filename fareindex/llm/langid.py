"""Language identification.

Sparse multinomial logistic regression on TF-IDF character n-grams (orders 1 to
3, hashed), trained with follow-the-regularised-leader and elastic-net
penalties, then temperature-calibrated. Document frequencies are counted over
every learning document; the weights are fitted on a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareindex.llm.common import free_name, gather_texts, hashed_share, is_held_out, map_texts

BUCKETS = 1 << 15
SAMPLE_PER_LANGUAGE = 300  # bound on the labelled rows of each language that weights are fitted on
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-4, 1e-3
UNDETERMINED = "und"

_ASCII = np.full(128, 32, np.uint32)
_ASCII[97:123] = np.arange(97, 123)


def ngram_buckets(text: str) -> np.ndarray:
    """The bucket of each character n-gram of the lower-cased text. ASCII other than letters counts as space."""
    u = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    u = np.where(u < 128, _ASCII[np.minimum(u, 127)], u)
    if not len(u):
        return np.zeros(0, np.int64)
    a = u * np.uint32(0x9E3779B1)
    b = a[:-1] * np.uint32(0x85EBCA6B) + u[1:] * np.uint32(0xC2B2AE35)
    c = b[:-1] * np.uint32(0x27D4EB2F) + u[2:] * np.uint32(0x165667B1)
    h = np.concatenate([a, b, c])
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(17)).astype(np.int64)


def counts(text: str | None) -> np.ndarray:
    return np.bincount(ngram_buckets(text or ""), minlength=BUCKETS)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray  # of each bucket
    weights: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, tf: np.ndarray) -> np.ndarray:
        """tf: document x bucket."""
        x = tf * self.idf
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        return (x @ self.weights) / np.maximum(norm, 1e-12)[:, None] + self.bias

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        """A language and its calibrated probability; `und` and 0 for null or letterless texts."""
        names, scores = [], []
        for lo in range(0, len(texts), 32):
            part = texts[lo : lo + 32]
            lettered = [t is not None and any(map(str.isalpha, t)) for t in part]
            if not self.languages:
                names += [UNDETERMINED] * len(part)
                scores += [0.0] * len(part)
                continue
            p = softmax(self.logits(np.stack([counts(t) for t in part]).astype(np.float32)) / self.temperature)
            best = p.argmax(1)
            for ok, k, row in zip(lettered, best, p):
                names.append(self.languages[k] if ok else UNDETERMINED)
                scores.append(float(min(1.0, row[k])) if ok else 0.0)
        return names, scores


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Over all of `docs`: in how many documents each bucket occurs, and how many there are."""

    def start():
        seen, n = np.zeros(BUCKETS, np.int64), [0]

        def add(part):
            for t in part["text"]:
                seen[:] += counts(t) > 0
                n[0] += 1

        def flush(last):
            at = np.flatnonzero(seen)
            return {"bucket": [*at.tolist(), -1], "n": [*seen[at].tolist(), n[0]]} if last else None

        return add, flush

    rows = gather_texts(docs.select("text"), start, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1, np.int64)
    df[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return df[:BUCKETS], int(df[BUCKETS])


def train_ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: list[int], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by per-coordinate FTRL-proximal with L1 and L2 penalties."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(z, n):
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(x)):
            at, v = x[i]
            at, v = np.append(at, BUCKETS), np.append(v, 1.0)  # the last is the bias
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            g = softmax((v @ w)[None])[0]
            g[y[i]] -= 1
            g = v[:, None] * g
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at], n[at] = zi + g - step * w, ni + g * g
    w = weights(z, n)
    return w[:BUCKETS].astype(np.float32), w[BUCKETS].astype(np.float32)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden-section search on its logarithm.

    Targets are smoothed by one pseudo-count per class, so a sample without an
    error does not make the model certain of everything.
    """
    n, classes = logits.shape if logits.ndim == 2 else (0, 0)
    if not n or classes < 2:
        return 1.0
    target = np.full((n, classes), 1 / (n + classes))
    target[np.arange(n), y] += n / (n + classes)

    def loss(s):
        return -(target * np.log(np.maximum(softmax(logits / np.exp(s)), 1e-12))).sum(1).mean()

    a, b, r = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit_languages(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Learn from `text` and `lang` of the rows of `docs` whose lang and text are not null.

    Every label is a class, however rare; the model grows with their number.
    Weights see about `per_language` rows of each, picked by hash (that bound is
    doubled at most), three quarters for fitting and a quarter for the
    temperature. Inverse document frequencies cover all rows. Without labels the
    model knows no language and says `und`.
    """
    docs = docs.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    sizes = docs.groupBy("lang").count().collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return LanguageModel([], np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    share = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], min(1.0, per_language / r["count"]))])
    u = hashed_share("doc_id", "text", "lang", seed="language")
    drawn = docs.withColumn("u", u).where(F.col("u") < share[F.col("lang")])

    def start():
        def features(texts):
            found = [counts(t) for t in texts]
            at = [np.flatnonzero(c) for c in found]
            return {"at": [a.astype("<i4").tobytes() for a in at], "tf": [c[a].astype("<f4").tobytes() for c, a in zip(found, at)]}

        return features

    found = map_texts(drawn, start, "at binary, tf binary", ["u", "lang"])
    rows = found.orderBy("u", "lang", "at").limit(2 * per_language * len(languages)).collect()
    df, total = _document_frequencies(docs)
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    x, y = [], []
    for r in rows:
        at, tf = np.frombuffer(r["at"], "<i4"), np.frombuffer(r["tf"], "<f4")
        v = tf * idf[at]
        if len(at):
            x.append((at, (v / np.sqrt(v @ v)).astype(np.float64)))
            y.append(languages.index(r["lang"]))
    fit = [i for i in range(len(x)) if i % 4]
    weights, bias = train_ftrl([x[i] for i in fit], [y[i] for i in fit], len(languages))
    model = LanguageModel(languages, idf, weights, bias)
    rest = [i for i in range(len(x)) if i % 4 == 0]
    logits = np.array([x[i][1] @ weights[x[i][0]] + bias for i in rest])
    model.temperature = calibrate(logits, np.array([y[i] for i in rest]))
    return model


def identify(docs: DataFrame, model: LanguageModel, keep: list[str], pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """`docs[keep]` with the predicted language and its probability.

    The model (BUCKETS x languages floats) is broadcast. Null and letterless
    texts get `und` and 0; equal texts get equal values; texts of any length are
    read whole; an empty table gives no row. `pred` and `score` must not be names
    in `keep`.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        model = shared.value

        def work(texts):
            names, scores = model.predict(texts)
            return {pred: names, score: scores}

        return work

    return map_texts(docs, start, f"`{pred}` string, `{score}` double", keep)


def language_digest(docs: DataFrame) -> DataFrame:
    """Learned from the rows outside the held-out fifth (a null doc_id counts as the empty text there), applied to all; cases as in `identify`."""
    model = fit_languages(docs.where(~is_held_out()))
    return identify(docs, model, ["doc_id"]).withColumn("held_out", is_held_out())


def keep_identified(docs: DataFrame, floor: float = 0.3) -> DataFrame:
    """The documents whose language is determined with probability `floor` or more, with their columns.

    Null, empty and letterless texts go; names in `docs` don't clash with the
    prediction's. Without labels no language is known and every document goes.
    """
    pred, score = free_name(docs, "language_found"), free_name(docs, "language_score")
    found = identify(docs, fit_languages(docs), docs.columns, pred, score)
    return found.where((F.col(pred) != UNDETERMINED) & (F.col(score) >= floor)).select(*docs.columns)
