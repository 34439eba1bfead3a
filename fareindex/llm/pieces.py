"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A model's pieces and scores come from a file; nothing is trained. Text is marked
(each space becomes U+2581, one more in front) and cut before each mark and on
both sides of each character that no longer piece holds, as any segmentation is.
The distinct words of a batch are sorted, which lays them out as a trie in
depth-first order: forward scores of the prefix that a word shares with the one
before are kept, and only its new characters are scored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame

from fareindex.llm.common import map_texts

MARK = "▁"
LITERAL = "\ud800"  # stands for a mark that the text itself holds; no valid text has it
UNKNOWN_PENALTY = 10.0
BATCH_ROWS = 2_048  # rows whose new words are sorted together
CACHE_CHARS, CACHE_WORDS = 32, 300_000  # the length and number of the words that a task remembers


@lru_cache(maxsize=2)
def load_pieces(path: str) -> "PieceModel":
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    bytes_ = {int(sp.id_to_piece(i)[1:-1], 16): i for i in ids if sp.is_byte(i)}
    plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return PieceModel({sp.id_to_piece(i): (sp.get_score(i), i) for i in plain}, bytes_, sp.unk_id())


def default_pieces() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class PieceModel:
    """pieces: piece -> (score, id). byte_ids: byte -> id, maybe empty."""

    def __init__(self, pieces: dict[str, tuple[float, int]], byte_ids: dict[int, int], unknown: int):
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses a word mark; words can't be told apart")
        self.byte_ids, self.unknown = byte_ids, unknown
        self.unknown_score = min((s for s, _ in pieces.values()), default=0.0) - UNKNOWN_PENALTY
        # pieces as a trie from their last character to their first: character -> (next, score, id or -1)
        self.backwards: dict = {}
        for piece in sorted(pieces, key=len):
            node = self.backwards
            for c in piece[:0:-1]:
                node = node.setdefault(c, ({}, 0.0, -1))[0]
            node[piece[0]] = (node.get(piece[0], ({},))[0], *pieces[piece])
        inner = "".join(sorted(set().union(*(p for p in pieces if len(p) > 1)) - {MARK}))
        self.word = re.compile(f"{MARK}+[{re.escape(inner)}]*|[{re.escape(inner)}]+|[^{MARK}]" if inner else f"{MARK}+|[^{MARK}]", re.S)
        self.longest = max(map(len, pieces), default=1)
        self.text = {i: p.replace(MARK, " ") for p, (_, i) in pieces.items()}
        self.byte = {i: b for b, i in byte_ids.items()}
        self.cache: dict[str, list[int]] = {}

    def segment(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of each word: the segmentation with the highest total score; on ties the longer last piece."""
        out, before = {}, ""
        best, back = [0.0], [(0, -1)]  # for each prefix of the current trie path
        root, longest = self.backwards, self.longest
        for word in sorted(words):
            shared = 0
            for a, b in zip(word, before):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                top, link = best[end - 1] + self.unknown_score, (end - 1, -1)
                node, at = root, end
                for c in word[end - 1 :: -1] if end <= longest else word[end - 1 : end - 1 - longest : -1]:
                    if c not in node:
                        break
                    node, score, i = node[c]
                    at -= 1
                    if i >= 0 and best[at] + score >= top:
                        top, link = best[at] + score, (at, i)
                best.append(top)
                back.append(link)
            ids, at = [], len(word)
            while at:
                start, i = back[at]
                ids += [i] if i >= 0 else self.fallback(word[start])[::-1]
                at = start
            out[word] = ids[::-1]
            before = word
        return out

    def fallback(self, c: str) -> list[int]:
        raw = (MARK if c == LITERAL else c).encode("utf-8", "surrogatepass")
        return [self.byte_ids[b] for b in raw] if self.byte_ids else [self.unknown]

    def encode(self, texts: list) -> list[list[int]]:
        """Ids of each text; null and empty texts have none."""
        cut = [self.word.findall(f" {t}".replace(MARK, LITERAL).replace(" ", MARK)) if t else [] for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        cache = self.cache
        new = self.segment(list(set().union(*cut).difference(cache)))
        long = {w: ids for w, ids in new.items() if len(w) > CACHE_CHARS}  # for this batch only
        cache.update(new)
        out = [list(chain.from_iterable(map(cache.__getitem__, words))) for words in cut]
        for w in long:
            del cache[w]
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids: byte runs are read as UTF-8, the first space is the mark in front."""
        try:
            return "".join(map(self.text.__getitem__, ids))[1:]
        except KeyError:
            pass
        raw = b"".join(bytes([self.byte[i]]) if i in self.byte else self.text.get(i, "�").encode("utf-8", "surrogatepass") for i in ids)
        return raw.decode("utf-8", "replace")[1:]


def encode_texts(docs: DataFrame, keep: list[str], model: str | None = None, ids: str = "ids") -> DataFrame:
    """`docs[keep]` with the piece ids of each whole text; `ids` must not be in `keep`.

    Null and empty texts have no ids; repeated rows give repeated results; texts
    may have any length; an empty table gives no row.
    """
    path = model or default_pieces()

    def start():
        pieces = load_pieces(path)
        return lambda texts: {ids: pieces.encode(texts)}

    return map_texts(docs, start, f"`{ids}` array<int>", keep, rows=BATCH_ROWS)


def decode_ids(rows: DataFrame, keep: list[str], model: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """`rows[keep]` with the text of each list of ids; `text` must not be in `keep`.

    Null ids give null, none the empty text; ids that the model lacks give the
    replacement character; an empty table gives no row.
    """
    path = model or default_pieces()

    def start():
        pieces = load_pieces(path)
        return lambda lists: {text: [None if x is None else pieces.decode(x) for x in lists]}

    return map_texts(rows, start, f"`{text}` string", keep, ids)


def piece_digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Ids of every whole text, and whether decoding gives the text back.

    Null and empty texts have no ids; repeated rows give repeated results; what a
    task remembers is bounded by CACHE_CHARS and CACHE_WORDS, however long the
    texts; an empty table gives no row; other columns of `docs` don't matter.
    """
    path = model or default_pieces()

    def start():
        pieces = load_pieces(path)

        def work(texts):
            ids = pieces.encode(texts)
            back = [pieces.decode(x) for x in ids]
            return {
                "n_tokens": list(map(len, ids)),
                "ids": ids,
                "decoded_sha256": [hashlib.sha256(b.encode("utf-8", "surrogatepass")).hexdigest() for b in back],
                "exact": [b == (t or "") for b, t in zip(back, texts)],
            }

        return work

    return map_texts(docs, start, "n_tokens long, ids array<int>, decoded_sha256 string, exact boolean", ["doc_id"], rows=BATCH_ROWS)
