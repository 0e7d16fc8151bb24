"""Packing by vector bin packing with the dot-product heuristic.

Examples are placed into sequences under three limits at once: tokens,
segments and loss-bearing tokens. The next example for a sequence is the one,
among those that fit, whose demand vector has the largest dot product with
what the sequence has left. When none fits whole, the longest is cut to fill
it. What is left over at the end of a partition, or of a sequence that is out
of segments, is cut into sequences whose lengths are powers of two, which need
no padding.

Documents are packed partition by partition, in the order read, with a bounded
pool, so nothing is shuffled and a lost task gives the same pieces again.

Defined results: a null text is the end id alone; repeated rows are packed
each; a document of more than a whole sequence fills sequences of its own.
"""

from __future__ import annotations

import sys
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

LENGTH, SEGMENTS, END = 2048, 256, 1
POOL = 256
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
_PIECE = pa.schema([(x.split(" ")[0], pa.int64()) for x in PIECE.split(", ")])
TOKENIZERS = "/opt/tokenizers"


def tokenizer_path(name: str = "word_bpe_49k.json", folder: str = TOKENIZERS) -> str:
    if folder not in sys.path:
        sys.path.append(folder)
    import public_tokenizers

    return public_tokenizers.path(name)


def token_bytes(texts: list[str | None], path: str) -> list[bytes]:
    """The ids of texts as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and case. A text with what may be a special token is encoded as it stands.
    """
    from .words import table

    tool, raw = table(path), [t or "" for t in texts]
    special = [k for k, t in enumerate(raw) if "<|" in t]
    out = list(tool.ids(["" if "<|" in t else t for t in raw]))
    for k, ids in zip(special, tool.encode_each([raw[k] for k in special]), strict=True):
        out[k] = ids
    return out


@dataclass
class Item:
    """ids[start:] of a document that are still to be placed. Tokens from loss_from on bear loss."""

    doc_id: int | None
    ids: bytes
    start: int
    loss_from: int = 0

    @property
    def tokens(self) -> int:
        return len(self.ids) // 4 - self.start

    def loss(self, a: int, b: int) -> int:
        return max(0, b - max(a, self.loss_from))

    @property
    def demand(self) -> tuple[int, int, int]:
        n = len(self.ids) // 4
        return n - self.start, 1, self.loss(self.start, n)


@dataclass
class Packer:
    """Places items; finished pieces gather in ``rows`` as tuples of PIECE."""

    first_id: int
    limits: tuple[int, int, int] = (LENGTH, SEGMENTS, LENGTH)
    pool: list[Item] = field(default_factory=list)
    wants: list[tuple[float, float, float]] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    made: int = 0

    def add(self, item: Item) -> None:
        length, _, loss = self.limits
        while item.tokens >= length and item.loss(item.start, item.start + length) <= loss:
            self._emit([(item, item.start, length)])
            item.start += length
        if item.tokens:
            self.pool.append(item)
            self.wants.append(self._want(item))
            if len(self.pool) >= POOL:
                self.pack(POOL // 2)

    def pack(self, keep: int = 0) -> None:
        while len(self.pool) > keep:
            self._bin()

    def _want(self, item: Item) -> tuple[float, float, float]:
        a, b, c = item.demand
        return a / self.limits[0], b / self.limits[1], c / self.limits[2]

    def _bin(self) -> None:
        demand, left, got, taken = np.array(self.wants), np.ones(3), [], []
        while True:
            # the dot product with what is left; items that don't fit, or are taken, count as less than nothing
            worth = np.where((demand > left + 1e-12).any(1), -1.0, demand @ left)
            k = int(worth.argmax()) if len(worth) else -1
            if k < 0 or worth[k] < 0:
                break
            item = self.pool[k]
            got.append((item, item.start, item.tokens))
            left = left - demand[k]
            taken.append(k)
            demand[k] = 9.0
        for k in sorted(taken, reverse=True):
            del self.pool[k], self.wants[k]
        rest = self.pool
        room = self.limits[0] - sum(n for *_, n in got)
        bear = self.limits[2] - sum(i.loss(a, a + n) for i, a, n in got)
        if room and rest and len(got) < self.limits[1]:
            at = max(range(len(rest)), key=lambda i: self.wants[i][0])
            item = rest[at]
            n = min(room, item.tokens)
            n = min(n, max(0, item.loss_from - item.start) + bear)
            if n > 0:
                got.append((item, item.start, n))
                item.start += n
                if item.tokens:
                    self.wants[at] = self._want(item)
                else:
                    del self.pool[at], self.wants[at]
        if not got:
            raise ValueError("an item fits no empty sequence")
        self._emit(got)

    def _emit(self, got: list[tuple[Item, int, int]]) -> None:
        """A full sequence as it is; a shorter one cut into powers of two."""
        length = self.limits[0]
        total, at, here = sum(n for *_, n in got), 0, 0
        size = total if total == length else 1 << total.bit_length() - 1
        for item, start, n in got:
            while n:
                take = min(n, size - here)
                ids = item.ids[4 * start : 4 * (start + take)]
                self.rows.append((item.doc_id, start, take, zlib.crc32(ids), len(item.ids) // 4, self.first_id + self.made, here, item.loss(start, start + take)))
                start, n, here, at = start + take, n - take, here + take, at + take
                if here == size:
                    self.made += 1
                    here, size = 0, 1 << (total - at).bit_length() - 1 if total > at else 0


def pack(docs: DataFrame, path: str | None = None, limits: tuple[int, int, int] = (LENGTH, SEGMENTS, LENGTH), loss_from: str | None = None) -> DataFrame:
    """Pieces of docs (doc_id, text): rows of PIECE. path: a tokenizer file, the same on every machine; loss_from: a column with the first loss-bearing token of each row, all bear loss if none.

    A sequence id is its partition's number times 2**40 and a running number.
    """
    path = path or tokenizer_path()
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.coalesce(F.col(loss_from).cast("long"), F.lit(0)) if loss_from else F.lit(0).cast("long")).alias("loss_from"))

    def run(batches):
        from pyspark import TaskContext

        from .words import portions

        packer, end = Packer(TaskContext.get().partitionId() << 40, limits), np.array([END], "<u4").tobytes()
        for batch in batches:
            for part in portions(batch):
                for doc, ids, bears in zip(part["doc_id"].to_pylist(), token_bytes(part["text"].to_pylist(), path), part["loss_from"].to_pylist(), strict=True):
                    packer.add(Item(doc, ids + end, 0, bears))
                if len(packer.rows) >= 20_000:
                    yield _batch(packer.rows)
                    packer.rows = []
        packer.pack()
        if packer.rows:
            yield _batch(packer.rows)

    return chosen.mapInArrow(lean(run, keeps=True), PIECE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_PIECE)
