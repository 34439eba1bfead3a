"""Personal data, and the terms that give it away.

E-mail addresses, IP addresses, card and phone numbers are found by pattern: the
protected entities. Over the whole corpus, the documents that hold both a term and
an entity are counted against those in which the term and the entity occur. The
pointwise mutual information of the two, as a share of the entity's own
information content, is how much of the entity the term discloses. A term above a
threshold gives way to the longest of its stems that discloses less, in a
hierarchy of stems counted over the same corpus; if every stem discloses as much,
it is removed.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareindex.llm.common import checkpointed, free_name, gather_texts, map_texts

KINDS = ("email", "ip", "card", "phone", "term")
TERM = len(KINDS) - 1
STEMS = (5, 3)  # lengths of the stems that a term may be generalised to
UNSEEN = 1.0  # documents with the term alone that are assumed besides those seen, so that rare terms are judged with care
DISCLOSURE = 0.8  # share of the entity's information that a term may carry
HELD_TERMS = 400_000
HOT = 1_000  # documents of a term or entity that may be broadcast
BROADCAST_ROWS = 1_000_000

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W_]{3,}")


def luhn(digits: str) -> bool:
    double = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(double[int(d)] if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _emails(text: str):
    """Leftmost matches, found from each "@": a match starts where the run of local characters before it does."""
    free = 0
    at = text.find("@")
    while at >= 0:
        if at >= free and (m := _DOMAIN.match(text, at)):
            lo = at
            while lo > free and _LOCAL.match(text[lo - 1]):
                lo -= 1
            if lo < at:
                yield lo, m.end()
                free = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterned entities, in order."""
    spans = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        if "+" in text:
            spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m.group())) <= 15]
    return sorted(spans)


def stems(term: str) -> list[str]:
    """The term's generalisations, finest first."""
    return [f"{term[:n]}*" for n in STEMS if n < len(term)]


def entity_key(kind: int, value: str) -> int:
    """A signed 64-bit key of a kind and its value without punctuation and case."""
    plain = value.lower() if kind < 2 else "".join(_DIGITS.findall(value))
    return int.from_bytes(xxhash.xxh64_digest(f"{kind}:{plain}".encode()), "big", signed=True)


def terms_of(text: str) -> set[str]:
    return {w.lower() for w in set(_WORD.findall(text))}


def located_terms(text: str, spans: list[tuple[int, int, int]]) -> dict[str, list[tuple[int, int]]]:
    """Where each term stands outside the entities."""
    out: dict[str, list[tuple[int, int]]] = {}
    at = 0
    for m in _WORD.finditer(text):
        while at < len(spans) and spans[at][2] <= m.start():
            at += 1
        if at == len(spans) or m.end() <= spans[at][0]:
            out.setdefault(m.group().lower(), []).append(m.span())
    return out


SPANS = "array<struct<start:int,end:int>>"
BASE = (
    "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:int,kind:int,end:int>>, "
    f"entities array<long>, terms array<struct<term:string,at:{SPANS}>>, grams array<string>"
)


def find_entities(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`docs[keep]` with counts and spans of the patterned entities, and where there are any, the distinct ones, the terms, and terms and stems."""
    names = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "entities", "terms", "grams")

    def start():
        def work(texts):
            rows = []
            for t in texts:
                spans = base_spans(t or "")
                kinds = [k for _, k, _ in spans]
                line = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
                found = located_terms(t, spans) if spans else {}
                keys = sorted({entity_key(kind, t[a:b]) for a, kind, b in spans})
                terms = [{"term": w, "at": [{"start": a, "end": b} for a, b in at]} for w, at in found.items()]
                grams = sorted({g for w in found for g in (w, *stems(w))})
                rows.append((*map(kinds.count, range(TERM)), hashlib.sha256(line.encode()).hexdigest(), [{"start": a, "kind": k, "end": b} for a, k, b in spans], keys, terms, grams))
            return dict(zip(names, map(list, zip(*rows))))

        return work

    return map_texts(docs, start, BASE, keep)


def gram_frequencies(docs: DataFrame) -> DataFrame:
    """(gram, gram_docs): in how many documents each term, and each stem, occurs."""

    def start():
        held = Counter()

        def add(part):
            for t in part["text"]:
                terms = terms_of(t or "")
                held.update(terms)
                for n in STEMS:
                    held.update({f"{w[:n]}*" for w in terms if n < len(w)})

        def flush(last):
            if not held or not last and len(held) < HELD_TERMS:
                return None
            out = {"gram": list(held), "n": list(held.values())}
            held.clear()
            return out

        return add, flush

    return gather_texts(docs.select("text"), start, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("gram_docs"))


def disclosure(together: Column, gram_docs: Column, entity_docs: Column, total: Column) -> Column:
    """PMI(entity, term) / information of the entity: 1 if the term implies it, 0 if it says nothing.

    The chance of the entity given the term is smoothed by UNSEEN documents that
    hold the entity as often as any other document.
    """
    information = -F.log(entity_docs / total)
    chance = (F.least(together, gram_docs) + UNSEEN * entity_docs / total) / (gram_docs + UNSEEN)
    return F.when(information > 0, (F.log(chance) + information) / information).otherwise(F.lit(0.0))


def _with_counts(rows: DataFrame, counts: DataFrame, key: str, number: str, documents: int) -> DataFrame:
    """`rows` joined to written `counts` on `key`, wherever one key has a large part of all rows.

    Keys in over HOT documents and a thousandth of all are at most a thousand
    times as many as a document has on average: they are broadcast, if counted
    to be few, and their rows stay where they are. The others have few rows each.
    """
    hot = checkpointed(counts.where(F.col(number) > max(HOT, documents // 1000)))
    if not 0 < hot.count() <= BROADCAST_ROWS:
        return rows.join(counts, key)
    here = rows.join(F.broadcast(hot), key)
    return here.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(counts, key))


def disclosing_pairs(docs: DataFrame, entities: DataFrame, row: str, threshold: float = DISCLOSURE) -> tuple[DataFrame, DataFrame]:
    """((row, entity, gram) where they occur together and may disclose, (entity, gram) that disclose).

    Entities with the same documents have the same terms, so `entity` is such a
    class: a text of thousands of addresses that stand nowhere else has one. An
    entity of k documents can't be disclosed by a gram of more than `most_docs`
    documents, even if it occurs in all k. Grams that occur in more than any
    entity of their document allows leave before they meet the entities.
    """
    documents = docs.count()
    total = F.lit(float(documents))
    some = entities.where(F.size("entities") > 0)
    held = some.select(row, F.explode("entities").alias("value"))
    tags = [F.bit_xor(F.xxhash64(row)).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), row)).alias("y")]
    holds = checkpointed(held.groupBy("value").agg(F.count("*").alias("entity_docs"), *tags))
    classes = _with_counts(held, holds, "value", "entity_docs", documents).select(row, F.struct("entity_docs", "x", "y").alias("entity")).distinct()
    chance = F.col("entity.entity_docs") / total
    most_docs = (F.col("entity.entity_docs") + UNSEEN * chance) / F.pow(chance, F.lit(1 - threshold)) * (1 + 1e-9) - UNSEEN
    known = checkpointed(classes.withColumn("entity_most", F.when(chance < 1, most_docs)))
    allowed = known.groupBy(row).agg(F.max("entity_most").alias("most_docs"))
    grams = some.select(row, "grams").join(allowed, row).select(row, "most_docs", F.explode("grams").alias("gram"))
    rare = _with_counts(grams, checkpointed(gram_frequencies(docs)), "gram", "gram_docs", documents).where("gram_docs <= most_docs")
    pairs = checkpointed(rare.select(row, "gram", "gram_docs").join(known, row).where("gram_docs <= entity_most").select(row, "entity", "gram", "gram_docs"))
    together = pairs.groupBy("entity", "gram").agg(F.count("*").alias("together"), F.first("gram_docs").alias("gram_docs"))
    share = disclosure(F.col("together"), F.col("gram_docs"), F.col("entity.entity_docs"), total)
    return pairs.select(row, "entity", "gram"), checkpointed(together.where(share >= threshold).select("entity", "gram"))


def disclosing_terms(grams: DataFrame) -> DataFrame:
    """(entity, term, form): the terms among `grams`, each with its longest stem that is not among them, or "" if all are."""
    bad = grams.where(~F.col("gram").endswith("*")).withColumnRenamed("gram", "term")
    form = F.lit("")
    for n in reversed(STEMS):
        stem = F.concat(F.substring("term", 1, n), F.lit("*"))
        seen = grams.select("entity", F.col("gram").alias(f"stem_{n}"), F.lit(True).alias(f"bad_{n}"))
        bad = bad.withColumn(f"stem_{n}", stem).join(seen, ["entity", f"stem_{n}"], "left")
        form = F.when((F.length("term") > n) & F.col(f"bad_{n}").isNull(), F.col(f"stem_{n}")).otherwise(form)
    return bad.select("entity", "term", form.alias("form"))


def find_personal_data(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`docs[keep]` with base counts and spans, and `terms`: array of (start, kind, end, form).

    Terms are reported wherever they stand in the documents that hold an entity
    they disclose; a document without entities has none. Of several entities, the
    one that asks for the shortest form decides. Null counts as empty; repeated
    rows count and are reported each; texts are judged whole, however long and
    with however many entities; an empty table gives no row.
    """
    row = free_name(docs, "row_key")
    marked = docs.withColumn(row, F.monotonically_increasing_id())  # written at once, so it stays
    entities = checkpointed(find_entities(marked, [*keep, row]))
    pairs, bad = disclosing_pairs(docs, entities, row)
    forms = checkpointed(disclosing_terms(bad))
    near = pairs.withColumnRenamed("gram", "term").join(forms, ["entity", "term"]).groupBy(row, "term").agg(F.min_by("form", F.length("form")).alias("form"))
    placed = entities.where(F.size("entities") > 0).select(row, F.explode("terms").alias("t")).select(row, "t.term", "t.at").join(near, [row, "term"])
    spans = F.transform("at", lambda a: F.struct(a["start"].alias("start"), F.lit(TERM).alias("kind"), a["end"].alias("end"), F.col("form").alias("form")))
    terms = placed.groupBy(row).agg(F.flatten(F.collect_list(spans)).alias("terms"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,form:string>>")
    return entities.drop("entities", "terms", "grams").join(terms, row, "left").withColumn("terms", F.coalesce("terms", none)).drop(row)


def written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data_digest(docs: DataFrame) -> DataFrame:
    """Counts, the digest of the patterned spans, and all spans of every text; cases as in `find_personal_data`."""
    found = find_personal_data(docs.select("doc_id", "text"), ["doc_id"])
    terms = F.transform("terms", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        written(F.concat("base", terms)).alias("spans"),
        F.size("terms").cast("long").alias("n_terms"),
        F.size(F.filter("terms", lambda s: s["form"] != "")).cast("long").alias("n_generalised"),
    )


def redact(text: str | None, spans: list[dict]) -> str | None:
    """The text with entities replaced by <kind> and terms by their form."""
    if text is None:
        return None
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["kind"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{KINDS[s['kind']]}>" if s["kind"] != TERM else s["form"]]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """`docs` with personal data and disclosing terms taken out of `text`; a null text stays null.

    Rows are matched by 128 bits of (doc_id, text), so repeated rows are treated alike;
    other columns are kept whatever their names. Cases as in `find_personal_data`.
    """
    row, spans = free_name(docs, "row_key"), free_name(docs, "found_spans")
    marked = docs.withColumn(row, F.struct(F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "doc_id", "text").alias("b")))
    found = find_personal_data(marked.select("doc_id", "text", row), [row])
    lifted = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit("").alias("form")))
    plans = found.select(row, F.concat(lifted, "terms").alias(spans)).where(F.size(spans) > 0).dropDuplicates([row])
    both = marked.join(plans, row, "left").withColumn(spans, F.struct(F.col("text").alias("text"), F.col(spans).alias("spans")))

    def start():
        return lambda rows: {"text": [redact(r["text"], r["spans"] or []) for r in rows]}

    rest = [c for c in docs.columns if c != "text"]
    return map_texts(both, start, "text string", rest, spans).select(*docs.columns)
