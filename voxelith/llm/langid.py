"""Language identification by compression.

A text is compressed, in whole chunks, with one zstandard raw-content
dictionary for each language; the language with the smallest total is chosen,
and the choice counts as rejected if the margin to the next is narrow.
Dictionaries are built from a bounded number of labelled texts for each
language (``samples``, whole texts of 40 to ``per_sample`` characters): those with the
smallest hash of their text, so that copies count once.

Defined results: null texts and texts without a letter are ``und`` with score
0; without learned languages every text is ``und``; ties go to the language
that is commonest among the labelled texts, then to the first by name.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 4096
_REST = re.compile(r"[\W\d_]+")


def learn(labelled: DataFrame, samples: int = 48, per_sample: int = 65_536) -> list[tuple[str, bytes, int]]:
    """(language, dictionary, labelled texts) of labelled (text, lang), commonest first. At most about 8 * samples texts of a language, of per_sample characters at most, reach the driver at once; a language with fewer different texts than asked gives all of them."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # the k smallest hashes: a cut that lets about 8 k texts of each language pass, raised where copies leave too few
    share, wide = {lang: min(1.0, 8 * samples / n) for lang, n in counts.items()}, 1 << 40
    found: dict[str, list[str]] = {}
    while len(found) < len(counts):
        cut = F.lit(0.0)
        for lang, x in share.items():
            if lang not in found:
                cut = F.when(F.col("lang") == lang, F.lit(x * wide)).otherwise(cut)
        part = rows.where(F.length("text").between(40, per_sample)).withColumn("h", F.xxhash64("text")).where(F.pmod("h", F.lit(wide)) < cut)
        part = part.groupBy("lang", "h").agg(F.min("text").alias("s"))
        got: dict[str, list] = {}
        for r in part.collect():  # about 8 * samples rows a language
            got.setdefault(r["lang"], []).append((r["h"] % wide, r["h"], r["s"]))
        for lang in [x for x in share if x not in found]:
            if len(got.get(lang, [])) >= samples or share[lang] >= 1:
                found[lang] = [s for *_, s in sorted(got.get(lang, []))[:samples]]
            share[lang] = min(1.0, share[lang] * 8)
    return [(lang, "".join(map(letters, found[lang])).encode(), counts[lang]) for lang in sorted(found, key=lambda x: (-counts[x], x))]


def compressors(model: list[tuple[str, bytes, int]], level: int = 3) -> list:
    import zstandard as z

    out = []
    for lang, data, _ in model:
        own = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=level)
        out.append((lang, z.ZstdCompressor(level=level, dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False)))
    return out


def letters(text: str) -> str:
    """Words of letters in lower case, with a blank between; whatever isn't a letter tells nothing of the language."""
    return f" {_REST.sub(' ', text.lower()).strip()} "


def chunks(text: str, size: int = CHUNK) -> list[bytes]:
    data = text.encode()
    return [data[i : i + size] for i in range(0, len(data), size)]


def classify(text: str | None, tools: list) -> tuple[str, float, float]:
    """(language, score, margin): the margin is the share of bytes saved over the next best; the score grows from 1/2 to 1 with it."""
    if not tools or not text or not any(map(str.isalpha, text)):
        return "und", 0.0, 0.0
    parts = chunks(letters(text))
    sizes = [sum(len(c.compress(p)) for p in parts) for _, c in tools]
    best = min(range(len(sizes)), key=sizes.__getitem__)
    rest = min((s for k, s in enumerate(sizes) if k != best), default=2 * sizes[best])
    margin = (rest - sizes[best]) / max(rest, 1)
    return tools[best][0], 1 / (1 + math.exp(-60 * margin)), margin


def predict(docs: DataFrame, model: list[tuple[str, bytes, int]], narrow: float = 0.005, level: int = 3) -> DataFrame:
    """doc_id, lang_pred, score, rejected (the margin is under ``narrow``) of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        tools = compressors(shared.value, level)
        for batch in batches:
            found = [classify(t.as_py(), tools) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[0] == "und" or x[2] < narrow for x in found])],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
