"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` evaluates every rule once for each document and stores the
measurements with one bit for each failed rule. Policies are versioned masks
over those bits; applying one, comparing versions or measuring what each rule
alone rejects reads the ledger and no text.

Defined results: a null or empty text has no words and fails ``few_words``;
ratios of a text without words are 0. Repeated windows are told apart by their
64-bit hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WINDOW = 8

#: name: SQL over the measurements, true if the document fails. The bit is the place in this list; append only.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "10 * word_chars < 25 * n_words",
    "long_words": "word_chars > 15 * n_words",
    "exclamations": "10 * n_exclaims > 3 * n_words",
    "capitals": "10 * n_capitals > 4 * word_chars",
    "digits": "10 * n_digits > 5 * word_chars",
}
BASE = ("few_words", "repeated_windows")
#: Rules that reject, by policy version.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": BASE,
    "v2": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "exclamations"),
    "v3": tuple(RULES),
}
CURRENT = "v3"


def bit(rule: str) -> int:
    return 1 << list(RULES).index(rule)


def mask_of(rules) -> int:
    return sum(bit(r) for r in set(rules))


def measure(docs: DataFrame, *keep: str) -> DataFrame:
    """Measurements of docs (doc_id, text) and the mask of failed rules; ``keep`` names further columns to carry along."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lists = docs.select(
        "doc_id", *keep, text.alias("_t"),
        F.array_remove(F.split(text, SPACE), "").alias("_w"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("_l"),
    )
    # each array is used more than once in the next step, so that it's computed once and not inside a lambda
    hashes = lists.select(
        "doc_id", *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("_t", F.lit("!")).cast("long").alias("n_exclaims"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count("_t", F.lit("[0-9]")).cast("long").alias("n_digits"),
        F.expr(f"CASE WHEN size(_w) > {WINDOW} THEN transform(sequence(1, size(_w) - {WINDOW - 1}), i -> xxhash64(slice(_w, i, {WINDOW}))) END").alias("_h"),
    )
    rest = [c for c in hashes.columns if c != "_h"]
    # (hash, place) of all windows in order of the hash, only where some hash comes twice
    ordered = hashes.select(*rest, F.expr("CASE WHEN size(array_distinct(_h)) < size(_h) THEN array_sort(arrays_zip(_h, sequence(1, size(_h)))) END").alias("_s"))
    starts = ordered.select(
        *rest,
        F.expr("array_sort(transform(filter(sequence(1, size(_s)), i -> (i > 1 AND element_at(_s, i)._h = element_at(_s, greatest(i - 1, 1))._h) OR (i < size(_s) AND element_at(_s, i)._h = element_at(_s, least(i + 1, size(_s)))._h)), i -> element_at(_s, i)['1']))").alias("_p"),
    )
    covered = F.expr(f"coalesce({WINDOW} + aggregate(sequence(1, size(_p)), 0L, (s, i) -> s + CASE WHEN i < size(_p) THEN least({WINDOW}, element_at(_p, least(i + 1, size(_p))) - element_at(_p, i)) ELSE 0 END), 0L)")
    counted = starts.select(*rest, covered.alias("n_repeat_words"))
    # a generator stands between the measurements and whatever is filtered by them: a filter that moved below it would measure inside its condition
    names = [c for c in counted.columns if c not in ("doc_id", *keep)]
    return counted.select("doc_id", *keep, F.inline(F.array(F.struct(*names, failures().alias("failed")))))


def failures() -> Column:
    """The mask of the failed rules, over the measurements."""
    total = F.lit(0).cast("long")
    for rule, sql in RULES.items():
        total = total.bitwiseOR(F.expr(f"CASE WHEN {sql} THEN {bit(rule)}L ELSE 0L END"))
    return total


def ledger(docs: DataFrame, *keep: str) -> DataFrame:
    """One row a document: measurements and ``failed``, the mask of all failed rules."""
    return measure(docs, *keep)


def rejected(policy: str = CURRENT) -> Column:
    return F.col("failed").bitwiseAND(mask_of(POLICIES[policy])) != 0


def apply_policy(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    return rows.withColumn("kept", ~rejected(policy))


def ablation(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, and documents that it alone rejects. One pass of bitwise sums over the ledger."""
    full, names = mask_of(POLICIES[policy]), POLICIES[policy]
    sums = []
    for r in names:
        sums += [F.count_if(F.col("failed").bitwiseAND(bit(r)) != 0).alias(f"f_{r}"), F.count_if(F.col("failed").bitwiseAND(full) == bit(r)).alias(f"o_{r}")]
    row = rows.agg(F.count("*").alias("n_docs"), F.count_if(F.col("failed").bitwiseAND(full) != 0).alias("n_rejected"), F.bit_or("failed").alias("any_failed"), *sums)
    stack = ", ".join(f"'{r}', f_{r}, o_{r}" for r in names)
    return row.select("n_docs", "n_rejected", "any_failed", F.expr(f"stack({len(names)}, {stack}) AS (rule, n_failed, n_only)"))
