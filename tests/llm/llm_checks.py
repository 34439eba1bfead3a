"""Brute-force versions that several tests share."""

import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash


def reference_print(text, n=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_packing(rows, got):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = {}
    for r in rows:
        want.setdefault(r["doc_id"], []).append([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1])
    pieces = defaultdict(list)
    for p in got:
        pieces[p["doc_id"]].append(p)
    assert pieces.keys() == want.keys()
    for doc, parts in pieces.items():
        if len(want[doc]) == 1:
            ids, at = want[doc][0], 0
            for p in sorted(parts, key=lambda p: p["start"]):
                assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
                assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
                at += p["length"]
            assert at == len(ids)
        else:
            assert sum(p["length"] for p in parts) == sum(map(len, want[doc]))
    sequences = defaultdict(list)
    for p in got:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at.bit_count() == 1
