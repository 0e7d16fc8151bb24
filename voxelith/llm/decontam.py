"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores, for each shard of documents, the postings (global word
positions) of all their terms; it knows no benchmark, so a stored index serves
any number of them. ``match`` searches it for the windows of a benchmark, shard
by shard: for each phrase it begins with the list of the phrase's rarest term
in the corpus and intersects it with the offset-adjusted lists of the others,
rarest first. Postings never leave their shard, so nothing is shuffled but the
counts of the test terms.

Defined results: null or empty texts have no words and no hits; items without
words have no windows; repeated items count once by id; a null item id is read
as the empty string; repeated or null document ids stay rows of their own.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, materialise

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
SHARD = "doc_ids array<bigint>, doc_ends array<bigint>, terms array<string>, counts array<int>, postings binary"
_SHARD = pa.schema([("doc_ids", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("postings", pa.binary())])
HIT = "shard bigint, at bigint, doc_id bigint, n_words bigint, spans array<struct<a:bigint,b:bigint>>, items array<string>"
_HIT = pa.schema([("shard", pa.int64()), ("at", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))])
#: Windows in one broadcast block; larger benchmarks are searched block by block.
BLOCK = 200_000


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


#: Bytes of words as they are, capitals in lower case, all others blank. The bytes of non-ASCII characters are all words'.
_BYTES = bytes(k + 32 if 65 <= k <= 90 else k if 48 <= k <= 57 or 97 <= k <= 122 or k >= 128 else 32 for k in range(256))


def raw_words(text: bytes) -> list[bytes]:
    """``words`` of a text in UTF-8."""
    return text.translate(_BYTES).split()


def windows(text: str | None, n: int = 10) -> list[tuple[str, ...]]:
    w = words(text)
    return [tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]


def build_index(docs: DataFrame, shard_words: int = 1_000_000) -> DataFrame:
    """Shards of docs (doc_id, text), of about so many words, with the postings of every term. ``shard`` is a number of the row: write the index before it is searched."""

    def build(batches):
        # words wait in Arrow, not as objects; few of the newest aside
        ids, ends, held, parts, size = [], [], [], [], 0

        def shard():
            parts.append(pa.array(held, pa.binary()))
            found = pa.concat_arrays(parts).dictionary_encode()
            codes = found.indices.to_numpy().astype(np.int64)
            keys = codes << 32 | np.arange(len(codes))
            keys.sort()
            terms = found.dictionary.cast(pa.string())
            row = {"doc_ids": ids, "doc_ends": ends, "counts": np.bincount(codes, minlength=len(terms)), "postings": keys.astype("<u4").tobytes()}
            own = pa.ListArray.from_arrays(pa.array([0, len(terms)], pa.int32()), terms)
            return pa.RecordBatch.from_arrays([own if f.name == "terms" else pa.array([row[f.name]], f.type) for f in _SHARD], schema=_SHARD)

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                own = raw_words(text.as_buffer().to_pybytes()) if text.is_valid else ()
                held.extend(own)
                size += len(own)
                ids.append(doc)
                ends.append(size)
                if size >= shard_words or len(ids) >= 20_000:
                    yield shard()
                    ids, ends, held, parts, size = [], [], [], [], 0
                elif len(held) >= 50_000:
                    parts.append(pa.array(held, pa.binary()))
                    held = []
        if ids:
            yield shard()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(build), SHARD).withColumn("shard", F.monotonically_increasing_id())


def term_counts(index: DataFrame, terms) -> DataFrame:
    """term, n: how often each of terms, a broadcast of distinct strings, stands in the corpus. Terms of the shards that aren't asked for stay in their tasks."""

    def count(batches):
        asked = pa.array(terms.value, pa.string())
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            for own, counts in zip(batch["terms"], batch["counts"], strict=True):
                found = pc.index_in(asked, value_set=own.values).fill_null(-1).to_numpy()
                total[found >= 0] += counts.values.to_numpy()[found[found >= 0]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([asked.take(pa.array(some)), pa.array(total[some])], ["term", "n"])

    return index.select("terms", "counts").mapInArrow(lean(count), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


class Lists(Mapping):
    """The positions of the terms that are asked for in a shard, each taken from the postings when first read."""

    def __init__(self, flat: np.ndarray, ends: np.ndarray, places: dict[str, int]):
        self.flat, self.ends, self.places, self.read = flat, ends, places, {}

    def __getitem__(self, term: str) -> np.ndarray:
        if term not in self.read:
            c = self.places[term]
            self.read[term] = self.flat[self.ends[c] : self.ends[c + 1]].astype(np.int64)
        return self.read[term]

    def __contains__(self, term) -> bool:
        return term in self.places

    def __iter__(self):
        return iter(self.places)

    def __len__(self) -> int:
        return len(self.places)


def intersect(lists: Mapping[str, np.ndarray], phrase: tuple[str, ...], order: Iterable[int]) -> np.ndarray:
    """Start positions of the phrase: offset-adjusted lists, in the order given (rarest first)."""
    starts = None
    for k in order:
        own = lists.get(phrase[k])
        if own is None:
            return np.empty(0, np.int64)
        if starts is None:
            starts = own - k
            continue
        found = np.searchsorted(own, starts + k)
        found[found == len(own)] = 0
        starts = starts[own[found] == starts + k]
        if not len(starts):
            break
    return starts


def near(lists: Mapping[str, np.ndarray], phrase: tuple[str, ...], order: list[int], slop: int, ends: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Shortest spans [a, b) of at most len(phrase) + slop words with all distinct terms in any order, one from each position of the rarest term. ends: where documents end; no span crosses one."""
    terms, width, out = [phrase[k] for k in order], len(phrase) + slop, set()
    distinct = list(dict.fromkeys(terms))
    if any(t not in lists for t in distinct):
        return []
    for p in lists[distinct[0]].tolist():
        d = 0 if ends is None else int(np.searchsorted(ends, p, "right"))
        begin, end = 0 if not d else int(ends[d - 1]), p + width if ends is None else int(ends[d])
        around = sorted({q for t in distinct for q in lists[t][np.searchsorted(lists[t], max(p - width + 1, begin)) : np.searchsorted(lists[t], p, "right")].tolist()})
        best = None
        for a in around:
            last = a
            for t in distinct:
                i = np.searchsorted(lists[t], a)
                if i == len(lists[t]):
                    break
                last = max(last, int(lists[t][i]))
            else:
                if p <= last < end and last - a < width and (best is None or last + 1 - a < best[1] - best[0]):
                    best = (a, last + 1)
        if best:
            out.add(best)
    return sorted(out)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def search(index: DataFrame, phrases, slop: int | None = None) -> DataFrame:
    """One row a document: its words, the word spans inside matches (merged) and the items that match. ``shard`` and ``at`` tell its place in the index.

    phrases: a broadcast of {rarest term: [(words, offsets from the rarest, [item ids])]}. slop: None for exact phrases, else so many words more for proximity.
    """

    def find(batches):
        by_first = phrases.value
        names = sorted({t for own in by_first.values() for phrase, _, _ in own for t in phrase})
        asked = pa.array(names, pa.string())
        for batch in batches:
            for k in range(batch.num_rows):
                starts = np.concatenate([[0], np.cumsum(batch["counts"][k].values.to_numpy(), dtype=np.int64)])
                places = pc.index_in(asked, value_set=batch["terms"][k].values).to_pylist()
                lists = Lists(np.frombuffer(batch["postings"][k].as_buffer(), "<u4"), starts, {t: c for t, c in zip(names, places, strict=True) if c is not None})
                ids, ends = batch["doc_ids"][k].as_py(), np.array(batch["doc_ends"][k].as_py(), np.int64)
                spans, items = defaultdict(list), defaultdict(set)
                for phrase, order, own in (x for t in lists for x in by_first.get(t, ())):
                    if slop is None:
                        pairs = [(a, a + len(phrase)) for a in intersect(lists, phrase, order).tolist()]
                    else:
                        pairs = near(lists, phrase, order, slop, ends)
                    for a, b in pairs:
                        d = int(np.searchsorted(ends, a, "right"))
                        if a >= 0 and b <= ends[d]:
                            spans[d].append((a, b))
                            items[d].update(own)
                begins = np.concatenate([[0], ends[:-1]])
                for at in range(0, len(ids), 5000):
                    part = range(at, min(at + 5000, len(ids)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([batch["shard"][k].as_py()] * len(part), pa.int64()),
                            pa.array(part, pa.int64()),
                            pa.array([ids[d] for d in part], pa.int64()),
                            pa.array([int(ends[d] - begins[d]) for d in part], pa.int64()),
                            pa.array([[{"a": a - int(begins[d]), "b": b - int(begins[d])} for a, b in _merge(spans.get(d, []))] for d in part], _HIT.field("spans").type),
                            pa.array([sorted(items.get(d, ())) for d in part], pa.list_(pa.string())),
                        ],
                        schema=_HIT,
                    )

    return index.mapInArrow(lean(find), HIT)


def match(index: DataFrame, benchmark: DataFrame, n: int = 10, slop: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row a document of a written index: doc_id, n_words, n_hit, spans, items. benchmark: (item_id, text).

    The benchmark is read by the driver, block after block, and no block is over ``block`` windows; the results of several blocks are put together by the document's place in the index.
    """
    spark = index.sparkSession
    found, out = defaultdict(set), []

    def flush() -> None:
        total = {r["term"]: r["n"] for r in term_counts(index, spark.sparkContext.broadcast(sorted({t for w in found for t in w}))).toLocalIterator()}
        by_first = defaultdict(list)
        for w, own in found.items():
            if all(t in total for t in w):
                order = sorted(range(len(w)), key=lambda i, w=w: (total[w[i]], i))
                by_first[w[order[0]]].append((w, order, sorted(own)))
        out.append(search(index, spark.sparkContext.broadcast(dict(by_first)), slop))
        found.clear()

    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text").toLocalIterator():
        for w in windows(r["text"], n):
            found[w].add(r["item_id"])
            if len(found) >= block:
                flush()
    if found or not out:
        flush()
    hits = out[0]
    if len(out) > 1:
        every = out[0]
        for x in out[1:]:
            every = every.unionByName(x)
        hits = every.groupBy("shard", "at").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        hits = hits.withColumn(
            "spans",
            F.expr("aggregate(spans, cast(array() as array<struct<a:bigint,b:bigint>>), (s, x) -> CASE WHEN size(s) > 0 AND x.a <= element_at(s, -1).b THEN concat(slice(s, 1, size(s) - 1), array(struct(element_at(s, -1).a AS a, greatest(element_at(s, -1).b, x.b) AS b))) ELSE concat(s, array(x)) END)"),
        )
    return hits.withColumn("n_hit", F.expr("aggregate(spans, 0L, (s, x) -> s + x.b - x.a)")).select("doc_id", "n_words", "n_hit", "spans", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 10, slop: int | None = None, block: int = BLOCK) -> DataFrame:
    """``match`` against an index of docs (doc_id, text) that is written for it."""
    return match(materialise(build_index(docs), "postings"), benchmark, n, slop, block)


def items_sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
