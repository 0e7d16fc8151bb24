"""PII detection with information-theoretic sanitisation.

Patterns find e-mail addresses, IP addresses, payment cards, phone numbers and
assigned secrets: the protected entities, each with its kind as a further
entity. A term discloses an entity if the corpus says so by two measures over
whole texts (rows that have the term, the entity, or both):

- strength: who sees the term still lacks at most ``residue`` bits to know the
  entity, -log2 P(e | t) <= residue with P(e | t) = both / (term + PRIOR);
- evidence: the information that the term gives of the entity, summed over
  independent texts that have both, log2(P(e | t) / P(e)) each, exceeds the
  choice among all pairs that were looked at, log2(pairs), by ``margin`` bits.

Texts are independent if they share none of three smallest shingle hashes, so
copies and near copies of one text are one piece of evidence at most, and a
pair seen in one text alone never discloses. Disclosing terms become spans of
kind ``term`` wherever they stand, with an entity or without; in sanitised
text entities and terms are generalised to their kind, or removed.

Defined results: null texts are empty; repeated rows are found each; two spans
of different kinds that overlap are both reported and sanitised as one; words
that touch an entity are no terms, nor are those without a letter or digit.
"""

from __future__ import annotations

import bisect
import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise
from .words import portions, split_words

KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match begins at the start of a run of digits, and whole runs are taken, so that long runs are read once
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# a quoted run that is assigned to a name; it needs letters and digits
_SECRET = re.compile(r"""(?<=[=:])[\x20]*["']([0-9A-Za-z+/_=-]{20,})["']""")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain: for each @, all local characters before it, no further back than the last match."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and _LOCAL.match(text, a - 1):
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            out.append((a, last := m.end()))
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start."""
    if not text:
        return []
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        parts = [x.lstrip("0") or "0" for x in m[0].split(".")]
        if all(len(x) < 4 and int(x) <= 255 for x in parts):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0]) if m.end() - m.start() <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(secret, start, end) of the runs between the quotes."""
    if not text:
        return []
    return [("secret", *m.span(1)) for m in _SECRET.finditer(text) if re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1])]


def terms_of(text: str, spans: list[tuple[str, int, int]]) -> list[str]:
    """The different terms of a text, without words that touch a span."""
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts, taken = [a for a, _ in words], set()
    for _, a, b in spans:
        taken.update(range(_first_after(words, a), bisect.bisect_left(starts, b)))
    return sorted({t for k, (a, b) in enumerate(words) if k not in taken and (t := term(text[a:b]))})


_TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
_UPPER = {c: c + 32 for c in range(65, 91)}


def term(word: str) -> str:
    """A word as a term: A-Z lower-cased, without ASCII marks at its ends."""
    return word.translate(_UPPER).strip(_TRIM)


def _first_after(words: list[tuple[int, int]], a: int) -> int:
    """The first word that ends after a."""
    lo, hi = 0, len(words)
    while lo < hi:
        mid = (lo + hi) // 2
        if words[mid][1] > a:
            hi = mid
        else:
            lo = mid + 1
    return lo

#: Texts that are added to those with a term, none of which has the entity.
PRIOR = 2.0
#: Bytes of texts that are worked on at once.
PORTION = 3_000_000
#: Terms in one broadcast; more go in several, one after another.
TERMS = 200_000
FOUND = "entities array<string>, terms array<string>, k0 long, k1 long, k2 long"
_SCALES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def text_keys(names: list[str], at: np.ndarray, bounds: np.ndarray, n: int = 5) -> np.ndarray:
    """Three keys a text: smallest hashes of its n-word shingles (of all its words, if fewer). Two texts share one with the probability of their shingles' similarity."""
    import xxhash

    words = np.fromiter(map(xxhash.xxh64_intdigest, names), np.uint64, len(names))[at]
    sizes = np.diff(bounds)
    out = np.zeros((len(sizes), 3), np.uint64)
    if not len(words):
        return out.view(np.int64)
    rolled = np.zeros(len(words), np.uint64)
    for k in range(n):
        part = words[k:]
        rolled[: len(part)] = rolled[: len(part)] * np.uint64(0x100000001B3) + part
    # only the first place of a short text counts; it takes in the words of the next text, so it is made of its own
    starts = np.arange(len(words)) + n
    text = np.repeat(np.arange(len(sizes)), sizes)
    good = (starts <= bounds[1:][text]) | (np.arange(len(words)) == bounds[:-1][text])
    for t in np.flatnonzero((sizes > 0) & (sizes < n)).tolist():
        own = np.uint64(len(words[bounds[t] : bounds[t + 1]]))
        for w in words[bounds[t] : bounds[t + 1]]:
            own = (own * np.uint64(0x100000001B3) + w) & np.uint64(0xFFFFFFFFFFFFFFFF)
        rolled[bounds[t]] = own
    some = np.flatnonzero(sizes)
    for k, scale in enumerate(_SCALES):
        h = (rolled ^ (rolled >> np.uint64(31))) * scale
        h ^= h >> np.uint64(29)
        h[~good] = np.iinfo(np.uint64).max
        out[some, k] = np.minimum.reduceat(h, bounds[:-1][some])
    return out.view(np.int64)


def entities(docs: DataFrame) -> DataFrame:
    """Texts of docs (text) that have an entity: their entities and kinds, their terms, and three keys."""

    def run(batches):
        for batch in batches:
            for part in portions(batch, size=PORTION):
                texts, found = [], []
                for t in part["text"].to_pylist():
                    spans = base_spans(t) + secret_spans(t)
                    if spans:
                        texts.append(t)
                        found.append(spans)
                if not texts:
                    continue
                with np.errstate(over="ignore"):
                    keys = text_keys(*split_words(texts))
                names = [sorted({f"{k}:{t[a:b].translate(_UPPER)}" for k, a, b in s} | {k for k, *_ in s}) for t, s in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.list_(pa.string())), pa.array([terms_of(t, s) for t, s in zip(texts, found, strict=True)], pa.list_(pa.string())), *(pa.array(keys[:, k]) for k in range(3))], ["entities", "terms", "k0", "k1", "k2"])

    return docs.select("text").mapInArrow(lean(run), FOUND)


def count_terms(docs: DataFrame, wanted) -> DataFrame:
    """(term, n): rows of docs (text) that have the term. wanted: a broadcast of the terms to count, None for all. Tasks sum before the shuffle."""

    def run(batches):
        only = None if wanted is None else set(wanted.value)
        for batch in batches:
            for part in portions(batch, size=PORTION):
                names, at, bounds = split_words(part["text"].to_pylist())
                place: dict[str, int] = {}
                trimmed = [x.strip(_TRIM) for x in names]
                own = np.array([place.setdefault(x, len(place)) if only is None or x in only else -1 for x in trimmed], np.int64)
                if not place:
                    continue
                own = own[at]
                hit = np.flatnonzero(own >= 0)
                pairs = np.unique(np.repeat(np.arange(part.num_rows), np.diff(bounds))[hit] * len(place) + own[hit])
                yield pa.RecordBatch.from_arrays([pa.array(list(place), pa.string()), pa.array(np.bincount(pairs % len(place), minlength=len(place)))], ["term", "n"])

    return docs.select("text").mapInArrow(lean(run), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def independent(found: DataFrame) -> DataFrame:
    """(entity, terms) of the rows that are the first of each of their three keys, for each of their entities."""
    rows = materialise(found.withColumn("row", F.monotonically_increasing_id()), "entity-texts")
    kept = rows.select("row", "k0", "k1", "k2")
    for k in ("k0", "k1", "k2"):
        kept = kept.join(kept.groupBy(k).agg(F.min("row").alias("row")).select("row"), "row", "left_semi")
    return rows.join(materialise(kept.select("row"), "independent"), "row", "left_semi").select(F.explode("entities").alias("entity"), "terms")


def disclosing(docs: DataFrame, residue: float = 1.0, margin: float = 7.0) -> DataFrame:
    """(entity, term) pairs over both thresholds in docs (text), the corpus; an entity is kind:value or a kind."""
    found = materialise(entities(docs), "entities")
    spark, total = docs.sparkSession, docs.count()
    alone = materialise(independent(found), "independent-texts")
    # no pair can have more independent texts than its entity
    seen = alone.groupBy("entity").agg(F.count("*").alias("u_e")).where("u_e > 1").select("entity")
    seen = materialise(seen, "repeated-entities")
    pairs = materialise(alone.join(seen, "entity", "left_semi").select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("u_et")), "pairs")
    looked = pairs.count()
    rows = found.select(F.explode("entities").alias("entity"), "terms").join(seen, "entity", "left_semi")
    n_e = rows.groupBy("entity").agg(F.count("*").alias("n_e"))
    p_e, least = F.col("n_e") / F.lit(max(total, 1)), math.log2(max(looked, 1)) + margin

    def enough(pairs: DataFrame, n) -> DataFrame:
        """Pairs over both thresholds if n rows had the term."""
        p_et = F.col("n_et") / (n + PRIOR)
        return pairs.where((-F.log2(p_et) <= residue) & (F.col("u_et") * F.log2(p_et / p_e) >= least))

    # what can't have the evidence with a strength of 1, or the strength by the texts with entities alone, needs no count over the corpus
    pairs = pairs.where("u_et > 1").join(n_e, "entity").where(F.col("u_et") * -F.log2(p_e) >= least)
    n_et = rows.select("entity", F.explode("terms").alias("term")).join(pairs, ["entity", "term"]).groupBy("entity", "term", "u_et", "n_e").agg(F.count("*").alias("n_et"))
    n_et = materialise(n_et, "pair-counts")
    within = found.select(F.explode("terms").alias("term")).join(n_et.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("within"))
    n_et = materialise(enough(n_et.join(within, "term"), F.col("within")), "candidates")
    some = n_et.select("term").distinct().limit(TERMS + 1).toArrow()["term"].to_pylist()  # bounded by the limit; beyond it all terms are counted
    if not some:
        return n_et.select("entity", "term")
    counted = count_terms(docs, spark.sparkContext.broadcast(some) if len(some) <= TERMS else None)
    return materialise(enough(n_et.join(counted, "term"), F.col("n")).select("entity", "term"), "disclosing")


def blocks_of(pairs: DataFrame) -> list[list[str]]:
    """The terms of pairs, in blocks of TERMS at most."""
    terms, at, out = pairs.select("term").distinct().orderBy("term"), None, []
    while True:
        part = [r["term"] for r in (terms if at is None else terms.where(F.col("term") > at)).limit(TERMS).collect()]  # TERMS rows at most
        if part:
            out.append(part)
        if len(part) < TERMS:
            return out
        at = part[-1]


def term_spans(texts: list[str | None], told: set[str]) -> list[str]:
    """Spans of disclosing terms in each text, as kind:start:end, comma-joined; words that touch an entity are no terms."""
    out = [""] * len(texts)
    if not told:
        return out
    names, at, bounds = split_words(texts)
    hit = np.array([x.strip(_TRIM) in told for x in names], bool)
    if not hit.any():
        return out
    places = np.concatenate([[0], np.cumsum(hit[at])])
    for k in np.flatnonzero(places[bounds[1:]] > places[bounds[:-1]]).tolist():
        text = texts[k]
        spans = base_spans(text) + secret_spans(text)
        found = []
        for m in _WORD.finditer(text):
            if term(m[0]) in told and not any(a < m.end() and m.start() < b for _, a, b in spans):
                inside = m[0].translate(_UPPER)
                begin = m.start() + len(inside) - len(inside.lstrip(_TRIM))
                found.append(("term", begin, begin + len(term(m[0]))))
        out[k] = joined(found)
    return out


def with_terms(rows: DataFrame, blocks: list[list[str]]):
    """(rows (kept struct, text, terms string) with the spans of all blocks of terms but the last added, a broadcast of the last). Few corpora have a second block."""
    spark = rows.sparkSession
    for block in blocks[:-1]:
        shared = spark.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            told = set(shared.value)
            for batch in batches:
                for part in portions(batch, size=PORTION):
                    more = [",".join(x for x in (old, new) if x) for old, new in zip(part["terms"].to_pylist(), term_spans(part["text"].to_pylist(), told), strict=True)]
                    yield pa.RecordBatch.from_arrays([part["kept"], part["text"], pa.array(more, pa.string())], ["kept", "text", "terms"])

        rows = rows.mapInArrow(lean(run), rows.schema)
    return rows, spark.sparkContext.broadcast(blocks[-1] if blocks else [])


def find(docs: DataFrame, residue: float = 1.0, margin: float = 7.0) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base, more for docs (doc_id, text); base and more list spans as kind:start:end, comma-joined, more has secrets and then terms."""
    blocks = blocks_of(disclosing(docs, residue, margin))
    rows = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("kept"), "text", F.lit("").alias("terms"))
    rows, last = with_terms(rows, blocks)

    def run(batches):
        told = set(last.value)
        for batch in batches:
            for part in portions(batch, size=PORTION):
                texts = part["text"].to_pylist()
                spans = [base_spans(t) for t in texts]
                counts = [pa.array([sum(s[0] == k for s in x) for x in spans], pa.int64()) for k in KINDS]
                more = [",".join(x for x in (joined(secret_spans(t)), *own) if x) for t, *own in zip(texts, part["terms"].to_pylist(), term_spans(texts, told), strict=True)]
                yield pa.RecordBatch.from_arrays([pc.struct_field(part["kept"], "doc_id"), *counts, pa.array([joined(x) for x in spans], pa.string()), pa.array(more, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "more"])

    return rows.mapInArrow(lean(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, more string")


def replace_spans(text: str, spans: str, keep_kind: bool = True) -> str:
    """The text with its spans (kind:start:end, comma-joined) generalised to <KIND>, or removed. Overlapping spans become one, of the first kind."""
    out, last = [], 0
    found = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in spans.split(",") if x))
    for a, b, kind in found:
        if a >= last:
            out += [text[last:a], f"<{kind.upper()}>" if keep_kind else ""]
        last = max(last, b)
    return "".join([*out, text[last:]])


def sanitise(docs: DataFrame, residue: float = 1.0, margin: float = 7.0, keep_kind: bool = True) -> DataFrame:
    """docs (text, ...) with sanitised texts and all other columns as they were; a null text stays null where nothing is found. Texts are never shuffled."""
    blocks = blocks_of(disclosing(docs, residue, margin))
    others = [c for c in docs.columns if c != "text"]
    kept = F.struct(F.lit(0).alias("at"), *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)))
    rows, last = with_terms(docs.select(kept.alias("kept"), "text", F.lit("").alias("terms")), blocks)

    def swap(batches):
        told = set(last.value)
        for batch in batches:
            for part in portions(batch, size=PORTION):
                texts = part["text"].to_pylist()
                texts = [t if t is None else replace_spans(t, ",".join([joined(base_spans(t) + secret_spans(t)), *more]), keep_kind) for t, *more in zip(texts, part["terms"].to_pylist(), term_spans(texts, told), strict=True)]
                yield pa.RecordBatch.from_arrays([part["kept"], pa.array(texts, pa.string())], ["kept", "text"])

    rows = rows.mapInArrow(lean(swap), rows.select("kept", "text").schema)
    place = {c: k for k, c in enumerate(others)}
    return rows.select(*(F.col("text") if c == "text" else F.col(f"kept.c{place[c]}").alias(c) for c in docs.columns))
