"""Subword ids of texts by way of their words, which are kept in tables of bounded size.

Right for tokenizers that drop case and white space, and never join ids over
white space or over the place where a run of ASCII marks follows an ASCII
letter, as the one that the packing query uses: each different stretch between
white space is encoded once, without the marks that end it, and kept. Texts
are split and their words told apart in Arrow; Python sees different words only.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
#: Entries of a table, and those that stay when it's full: the first ones, which come most often.
MOST, STAY = 350_000, 250_000
#: Words of letters that go to the tokenizer at once.
TOGETHER = 500
#: Bytes of texts that are worked on at once, but one text at least.
PORTION = 12_000_000
_TABLES: dict[str, WordTable] = {}


def split_words(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(different words, place of each word of the texts among them, bounds of the texts): stretches between ASCII white space, A-Z lower-cased. A null text has no words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(pa.array(texts, pa.large_string()), "")))
    bounds = np.asarray(lists.offsets)
    words = lists.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
    names, at, bounds = words.dictionary.to_pylist(), words.indices.to_numpy(), bounds - bounds[0]
    if "" in names:  # white space at either end of a text
        real = at != names.index("")
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        at = at[real]
    return names, at, bounds


def portions(batch: pa.RecordBatch, column: str = "text", size: int = PORTION) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about so many bytes."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, end - at)
        at = end


class WordTable:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one thread a task
        from tokenizers import Tokenizer

        self.tool, self.known = Tokenizer.from_file(path), {"": b""}
        vocabulary = self.tool.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True

    def encode_each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, words: list[str]) -> list[bytes]:
        """The ids of each word. Words of letters go to the tokenizer many at a time and are told apart by the tokens that end a word."""
        if not self.ends.any():
            return self.encode_each(words)
        out: list[bytes] = [b""] * len(words)
        letters, rest = [], []
        for k, w in enumerate(words):
            (letters if w.isalpha() else rest).append(k)
        for at in range(0, len(letters), TOGETHER):
            part = letters[at : at + TOGETHER]
            ids = np.array(self.tool.encode_batch_fast([" ".join([words[k] for k in part])], add_special_tokens=False)[0].ids, "<u4")
            stops = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(stops) != len(part) or stops[-1] != 4 * len(ids):  # each word has one end at least, so some word is split in two
                rest += part
                continue
            data, begin = ids.tobytes(), 0
            for k, stop in zip(part, stops, strict=True):
                out[k] = data[begin:stop]
                begin = stop
        for at in range(0, len(rest), TOGETHER):
            part = rest[at : at + TOGETHER]
            for k, ids in zip(part, self.encode_each([words[k] for k in part]), strict=True):
                out[k] = ids
        return out

    def of_words(self, words: list[str]) -> list[bytes]:
        """The ids of different words, kept for later."""
        if len(self.known) > MOST:
            self.known = dict(islice(self.known.items(), STAY))
        known = self.known
        out = list(map(known.get, words))
        missing = [k for k, ids in enumerate(out) if ids is None]
        whole, parts = {}, {}
        for k in missing:
            w = words[k]
            if not w.isalpha() and len(base := w.rstrip(MARKS)) < len(w) and base and base[-1].isascii() and base[-1].isalpha():
                parts[k] = base, w[len(base) :]
                whole[base] = whole[w[len(base) :]] = None
            else:
                whole[w] = None
        new = [w for w in whole if w not in known]
        known.update(zip(new, self.encode(new), strict=True))
        for k in missing:
            if k in parts:
                base, end = parts[k]
                known[words[k]] = known[base] + known[end]
            out[k] = known[words[k]]
        return out

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        names, at, ends = split_words(texts)
        each = self.of_words(names)
        flat, sizes = np.frombuffer(b"".join(each), "<u4"), np.fromiter(map(len, each), np.int64, len(each)) // 4
        starts = np.cumsum(sizes) - sizes
        own = sizes[at]
        stops = np.cumsum(own)
        places = np.repeat(starts[at] - stops + own, own)
        places += np.arange(len(places))
        data = flat[places].tobytes()
        bounds = (4 * np.concatenate([[0], stops])[ends]).tolist()
        return (data[a:b] for a, b in zip(bounds, bounds[1:], strict=False))


def table(path: str) -> WordTable:
    """The table of a tokenizer file in this process."""
    if path not in _TABLES:
        _TABLES[path] = WordTable(path)
    return _TABLES[path]


def forget() -> None:
    """Drops the tables of this process."""
    _TABLES.clear()
