"""SimHash near-dedup with a byte-position inverted index and count filtering.

Two 64-bit fingerprints at most r <= 2 bits apart share at least m = 8 - r of
their 8 bytes in place. The index has a posting list for each set of m byte
positions and their values; two fingerprints meet in a list exactly if their
tally of shared positional bytes reaches the guaranteed minimum m. A list holds
at most 256 ** r different fingerprints, however many documents there are. This
departs from lists of single bytes, which would hold n / 256 documents each and
make all their pairs; the count filter is applied to each pair that a list
proposes, before its bits are compared. In a list, members are verified and linked to a spanning forest in time linear in
its length once it's long, so no list makes all its pairs.

Documents are first grouped by fingerprint, so exact copies never meet in a
list. Components are found by contraction of the links, with each round in a
written table.

Defined results: null or empty texts have fingerprint zero and link like any
other; repeated doc_ids are rows of their own; a component without any
non-null doc_id has a null component_id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

SEED = 42
_SMALL = 48


def shingles(text: str | None, n: int = 3) -> list[bytes]:
    w = (text or "").encode().lower().split()
    if len(w) <= n:
        return [b" ".join(w)] if w else []
    return list(map(b" ".join, zip(*(w[i:] for i in range(n)), strict=False)))


def fingerprint(text: str | None, n: int = 3) -> int:
    """The unsigned fingerprint."""
    import xxhash

    found = shingles(text, n)
    if not found:
        return 0
    hashed, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(found), 1 << 16):
        part = found[i : i + (1 << 16)]
        h = np.fromiter((hashed(s, SEED) for s in part), np.uint64, len(part)).astype(">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(found)).tobytes(), "big")


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, fp (signed 64 bits) of docs (doc_id, text)."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), n) for t in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def tally(a: int, b: int) -> int:
    """Bytes that two fingerprints share in place."""
    return (a ^ b).to_bytes(8, "big").count(0)


def forest(members: np.ndarray, r: int) -> list[tuple[int, int]]:
    """Links that join all members (distinct unsigned fingerprints) as all links at most r bits apart would."""
    out: list[tuple[int, int]] = []
    values = members.tolist()
    root = list(range(len(values)))

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def link(a: int, b: int) -> None:
        x, y = top(a), top(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((values[a], values[b]))

    if len(values) <= _SMALL:
        x = members[:, None] ^ members[None, :]
        shared = (x[..., None].view(np.uint8).reshape(*x.shape, 8) == 0).sum(-1)
        for a, b in zip(*np.nonzero(np.triu((shared >= 8 - r) & (np.bitwise_count(x) <= r), 1)), strict=True):
            link(int(a), int(b))
        return out
    place = {v: k for k, v in enumerate(values)}
    free = int(np.bitwise_or.reduce(members ^ members[0]))  # the bits in which members differ: at most 8 * r
    flips = [1 << b for b in range(64) if free >> b & 1]
    near = [sum(c) for k in range(1, r + 1) for c in combinations(flips, k)]
    for k, v in enumerate(values):
        for x in near:
            other = place.get(v ^ x)
            if other is not None and other < k and tally(v, values[other]) >= 8 - r:
                link(k, other)
    return out


def links(distinct: DataFrame, r: int = 2) -> DataFrame:
    """Links (a, b) among distinct fingerprints (fp), a spanning forest of each posting list."""
    if not 0 <= r <= 2:
        raise ValueError("the index holds for at most 2 differing bits")
    keys = []
    for k, kept in enumerate(combinations(range(8), 8 - r)):
        mask = sum(0xFF << 8 * p for p in kept)
        keys.append(F.struct(F.lit(k).cast("byte").alias("k"), F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long")).alias("v")))
    postings = distinct.select("fp", F.explode(F.array(*keys)).alias("x")).select("fp", "x.k", "x.v")
    lists = postings.groupBy("k", "v").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def run(batches):
        for batch in batches:
            found = []
            for x in batch["fps"]:
                found += forest(np.unique(x.values.to_numpy(zero_copy_only=False).view(np.uint64)), r)
            ends = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    return lists.mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b): the smallest node that it reaches.

    Each round every node takes its smallest neighbour as parent, parents are followed to the top by doubling, and the links between different tops go on. A round leaves at most half of the nodes that still have links, and doubling takes the logarithm of a chain's length.
    """
    edges = materialise(edges, "links")
    nodes = edges.select("a").union(edges.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("root"))
    nodes = materialise(nodes, "roots")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        parent = materialise(parent, "parents")
        moved = True
        while moved:
            up = parent.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            higher = materialise(parent.join(up, "p").select("a", "pp", (F.col("pp") != F.col("p")).alias("moved")), "grandparents")
            moved = not higher.where("moved").isEmpty()
            parent = higher.select("a", F.col("pp").alias("p"))
        parent = parent.withColumnRenamed("p", "pp")
        nodes = materialise(nodes.join(parent, nodes["root"] == parent["a"], "left").select("node", F.coalesce("pp", "root").alias("root")), "roots")
        x, y = parent.select("a", F.col("pp").alias("x")), parent.select(F.col("a").alias("b"), F.col("pp").alias("y"))
        edges = materialise(edges.join(x, "a").join(y, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    return nodes


def near_duplicates(docs: DataFrame, n: int = 3, r: int = 2) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable) for every row of docs (doc_id, text)."""
    rows = materialise(fingerprints(docs, n), "fingerprints")
    first = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(first.select("fp"), r))
    joined = first.join(roots, first["fp"] == roots["node"], "left").select("fp", "first_id", "root")
    joined = materialise(joined, "rooted")
    least = joined.where("root IS NOT NULL").groupBy("root").agg(F.min("first_id").alias("least_id"))
    least = materialise(least, "components")
    ids = materialise(joined.join(least, "root", "left").select("fp", F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("least_id")).alias("component_id")), "component-ids")
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id")
