"""Secret scans.

Credentials of known shapes are found by pattern. Other long tokens pass a
battery of randomness tests (chi-squared uniformity over the inferred alphabet,
runs about the median symbol, lag-one serial correlation); those that look
random are reported when false-discovery control, run over the candidates of the
whole table within bands of length, finds them too surprising for ordinary text,
which is a first-order model of characters counted over all documents.
"""

from __future__ import annotations

import hashlib
import math
import re
import string
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareindex.llm.common import gather_texts, map_texts

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
LONG = re.compile(r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{16,}")
PART = re.compile(r"[A-Za-z0-9+/_-]{16,}=*")  # of a run: what stands between inner "="
PIECE = re.compile(r"[A-Za-z0-9_-]{16,}")
KNOWN_CHARS, KNOWN_TOKENS = 128, 20_000  # length and number of the tokens whose verdict a task remembers
LEAST_RANDOM = 0.01  # p-value under which a token is too regular to be random
FDR = 1e-3
BINS, BIN_NATS = 64, 1.0  # histogram of -ln p in each band

ALPHABETS = (
    ("digits", string.digits),
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("base32", string.ascii_uppercase + "234567"),
    ("lower36", string.digits + string.ascii_lowercase),
    ("upper36", string.digits + string.ascii_uppercase),
    ("base62", string.digits + string.ascii_letters),
    ("base64", string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"),
    ("base64url", string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_"),
)
_INDEX = {name: {c: i for i, c in enumerate(alphabet)} for name, alphabet in ALPHABETS}


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared_tail(x: float, k: int) -> float:
    """Upper tail by the Wilson-Hilferty cube-root approximation."""
    if x <= 0:
        return 1.0
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


def infer_encoding(token: str) -> str | None:
    """The smallest alphabet that holds all of the token (padding aside)."""
    used = set(token.rstrip("="))
    return next((name for name, index in _INDEX.items() if used <= index.keys()), None)


def battery(token: str, encoding: str) -> float:
    """One p-value for "the symbols are uniform and independent": the least of the tests', Bonferroni-corrected."""
    index = _INDEX[encoding]
    x = np.array([index[c] for c in token.rstrip("=")], float)
    n, size = len(x), len(index)
    cells = min(size, max(2, n // 5))  # at least five expected in each cell
    seen = np.bincount((x * cells // size).astype(int), minlength=cells)
    share = np.bincount((np.arange(size) * cells // size), minlength=cells) / size
    p = [chi_squared_tail(float(((seen - n * share) ** 2 / (n * share)).sum()), cells - 1)]
    repeats = n - len(set(token[:n]))
    mean = n - size * (1 - (1 - 1 / size) ** n)
    spread = max(size * ((1 - 1 / size) ** n) + size * (size - 1) * (1 - 2 / size) ** n - (size * (1 - 1 / size) ** n) ** 2, 0.25)
    p.append(normal_tail((repeats - mean) / math.sqrt(spread)))  # uniformity where cells are sparse
    high = x >= size / 2
    a, b = int(high.sum()), int(n - high.sum())
    if a and b:
        runs, expected = 1 + int((high[1:] != high[:-1]).sum()), 1 + 2 * a * b / n
        variance = (expected - 1) * (expected - 2) / max(n - 1, 1)
        p.append(normal_tail((runs - expected) / math.sqrt(variance)) if variance > 0 else 1.0)
    else:
        p.append(2.0 ** (1 - n))
    y = x - x.mean()
    p.append(normal_tail(float(y[1:] @ y[:-1]) / max(float(y @ y), 1e-9) * math.sqrt(n)))
    return min(1.0, len(p) * min(p))


class Ordinary:
    """First-order model of the characters of all documents: ASCII codes, any other character as code 0. Bigrams are
    smoothed towards the single characters."""

    def __init__(self, pairs: np.ndarray):
        pairs = pairs.reshape(128, 128).astype(float)
        single = (pairs.sum(0) + 1) / (pairs.sum() + 128)
        self.nats = -np.log((pairs + 32 * single) / (pairs.sum(1, keepdims=True) + 32))

    def surprise(self, token: str, encoding: str) -> float:
        """-ln p of the token under ordinary text: the likelihood ratio of uniform symbols to it.

        A ratio R has mean 1 under the ordinary model, so p = min(1, 1/R) is a
        valid p-value at every length, and a short token cannot gather enough.
        """
        x = codes(f" {token.rstrip('=')}")
        return float(self.nats[x[:-1], x[1:]].sum()) - (len(x) - 1) * math.log(len(_INDEX[encoding]))


def codes(text: str) -> np.ndarray:
    """One code for each character: its own if ASCII, else 0."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(x < 128, x, 0).astype(np.int64)


def ordinary_text(docs: DataFrame) -> Ordinary:
    """Counted within every text alone, so however the rows are dealt; 128 x 128 sums for each task reach the driver."""

    def start():
        pairs = np.zeros(1 << 14, np.int64)

        def add(part):
            texts = [t for t in part["text"] if t]
            x = codes("".join(texts))
            found = x[:-1] << 7 | x[1:]
            ends = np.cumsum([len(t) for t in texts])[:-1]
            pairs[:] += np.bincount(np.delete(found, ends - 1) if len(ends) else found, minlength=1 << 14)

        def flush(last):
            return {"pairs": [pairs.tobytes()]} if last else None

        return add, flush

    total = np.zeros(1 << 14, np.int64)
    for r in gather_texts(docs.select("text"), start, "pairs binary").collect():
        total += np.frombuffer(r["pairs"], np.int64)
    return Ordinary(total)


class Judge:
    """Judges tokens; remembers short ones."""

    def __init__(self, ordinary: Ordinary):
        self.ordinary, self.known = ordinary, {}

    def __call__(self, token: str) -> tuple[int, int] | None:
        """(length band, bin of -ln p), or None if the token is not random in its encoding."""
        if len(token) > KNOWN_CHARS:
            return self.judged(token)
        if token not in self.known:
            if len(self.known) >= KNOWN_TOKENS:
                self.known = {}
            self.known[token] = self.judged(token)
        return self.known[token]

    def judged(self, token: str) -> tuple[int, int] | None:
        encoding = infer_encoding(token)
        nats = self.ordinary.surprise(token, encoding)
        if nats <= 0 or battery(token, encoding) < LEAST_RANDOM:
            return None
        return band(len(token)), min(BINS - 1, int(nats / BIN_NATS))


def band(length: int) -> int:
    """16-23, 24-31, 32-63, 64 and more characters."""
    return (length >= 24) + (length >= 32) + (length >= 64)


BANDS = 4


def runs(text: str) -> list[tuple[int, int, str]]:
    """(start, end, token) of each run of 16 or more token characters."""
    return [(m.start(), m.end(), m.group()) for m in LONG.finditer(text)]


def candidates(found: list[tuple[int, int, str]]):
    """(start, end, token) of what is tested: the runs' parts of LEAST characters between inner "=", each cut at "/" and "+" if no alphabet holds it whole."""
    for lo, _, run in found:
        for m in PART.finditer(run):
            if infer_encoding(m.group()):
                yield lo + m.start(), lo + m.end(), m.group()
            else:
                for n in PIECE.finditer(m.group()):
                    yield lo + m.start() + n.start(), lo + m.start() + n.end(), n.group()


def base_spans(text: str, tokens: list[tuple[int, int, str]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterned secrets. Long hex and access keys lie within token runs."""
    spans = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    for lo, _, token in tokens:
        if "AKIA" in token:
            spans += [(lo + m.start(), 1, lo + m.end()) for m in ACCESS.finditer(token) if len(m.group()) >= 16]
        if len(token) >= 32:
            spans += [(lo + m.start(), 2, lo + m.end()) for m in HEX.finditer(token)]
    return sorted(spans)


def discovery_cuts(docs: DataFrame, ordinary: Ordinary, level: float = FDR) -> list[int]:
    """For each band of length, the least bin that Benjamini-Hochberg at `level` rejects.

    The number of tests is that of all tested tokens of the table in the band, so
    the bar rises with the amount of text. What is gathered is a histogram of
    fixed size for each task.
    """

    def start():
        tests, found, judge = np.zeros(BANDS, np.int64), np.zeros((BANDS, BINS), np.int64), Judge(ordinary)

        def add(part):
            for text in part["text"]:
                for _, _, token in candidates(runs(text or "")):
                    tests[band(len(token))] += 1
                    if verdict := judge(token):
                        found[verdict] += 1

        def flush(last):
            if not last:
                return None
            cells = [(b, -1, int(tests[b])) for b in range(BANDS)] + [(int(b), int(i), int(found[b, i])) for b, i in np.argwhere(found)]
            return dict(zip(("band", "bin", "n"), map(list, zip(*cells))))

        return add, flush

    rows = gather_texts(docs.select("text"), start, "band int, bin int, n long").groupBy("band", "bin").agg(F.sum("n").alias("n")).collect()
    tests, found = np.zeros(BANDS, np.int64), np.zeros((BANDS, BINS), np.int64)
    for r in rows:
        if r["bin"] < 0:
            tests[r["band"]] = r["n"]
        else:
            found[r["band"], r["bin"]] = r["n"]
    cuts = []
    for b in range(BANDS):
        hits = np.cumsum(found[b][::-1])[::-1]  # tokens with this bin or more
        p = np.exp(-BIN_NATS * np.arange(BINS))
        ok = [i for i in range(BINS) if hits[i] and p[i] * tests[b] <= level * hits[i]]
        cuts.append(min(ok, default=BINS))
    return cuts


def find_secrets(text: str | None, judge: Judge, cuts: list[int]) -> tuple[list, list]:
    """Patterned spans, and all spans, as (start, kind, end) in order. A random token is added where no patterned span overlaps it."""
    text = text or ""
    found = runs(text)
    base = base_spans(text, found)
    covered: list[list[int]] = []  # disjoint, in order
    for a, _, b in base:
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    starts = [a for a, _ in covered]
    more = []
    for lo, hi, token in candidates(found):
        at = bisect_right(starts, hi - 1) - 1  # the last that starts before the token ends
        if (at < 0 or covered[at][1] <= lo) and (v := judge(token)) and v[1] >= cuts[v[0]]:
            more.append((lo, 3, hi))
    return base, sorted(base + more)


def written(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def secret_digest(docs: DataFrame) -> DataFrame:
    """Spans of every text, in code points.

    Null counts as empty; repeated rows give repeated results; very long texts
    are scanned whole, in time linear in their length; an empty table gives no
    row; other columns of `docs` don't matter.
    """
    ordinary = ordinary_text(docs)
    cuts = discovery_cuts(docs, ordinary)

    def start():
        judge = Judge(ordinary)

        def work(texts):
            rows = []
            for t in texts:
                base, every = find_secrets(t, judge, cuts)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(written(base).encode()).hexdigest(), written(every)))
            return dict(zip(("n_assign", "n_access", "n_hex", "base_sha256", "spans"), map(list, zip(*rows))))

        return work

    return map_texts(docs, start, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", ["doc_id"])


def masked(text: str | None, judge: Judge, cuts: list[int]) -> str | None:
    """The text with each secret replaced by <kind>; overlapping spans become one, named by the first."""
    if text is None:
        return None
    out, at = [], 0
    for a, k, b in find_secrets(text, judge, cuts)[1]:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k]}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with secrets masked in `text`, and `n_chars`, if there, set anew. A null text stays null; cases as in `secret_digest`."""
    ordinary = ordinary_text(docs)
    cuts = discovery_cuts(docs, ordinary)
    rest = [c for c in docs.columns if c != "text"]

    def start():
        judge = Judge(ordinary)
        return lambda texts: {"text": [masked(t, judge, cuts) for t in texts]}

    out = map_texts(docs, start, "text string", rest)
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
