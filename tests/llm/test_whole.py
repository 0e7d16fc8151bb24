"""Whole results where an earlier version gave less: near copies, long turns, blocks of windows, far terms, whole texts."""

import zlib
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from voxelith.llm import chat, decontam, langid, lm, packing, queries, simhash



DOC = "doc_id long, text string"


def brute_near(texts, n=5):
    """Component of each text, by exact Jaccard similarity of word shingles."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set())
    root = list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(k) for k in range(len(texts))]


def test_near_dedup_reaches_the_threshold(spark):
    import corpus_pipeline as P

    rng = np.random.default_rng(3)
    texts = [None, "", "one", "One", "a b c d e f", "a b c d e g"]
    for _ in range(12):
        base = [f"w{k}" for k in rng.integers(0, 900, int(rng.integers(25, 120)))]
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(1, 9))):
            copy = list(base)
            for k in rng.integers(0, len(copy), int(rng.integers(1, 5))):
                copy[k] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(copy))
    line = " ".join(f"common{k}" for k in range(12))
    texts += [f"{line} " + " ".join(f"y{rng.integers(0, 10**6)}" for _ in range(m)) for m in (2, 2, 3, 4, 30, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC).repartition(3)
    want = sorted(set(brute_near(texts)))
    assert sorted(r.doc_id for r in P.near_dedup(spark, docs, "").collect()) == want
    assert 20 < len(want) < len(texts)


def test_a_pair_below_the_threshold_is_made_about_once(spark, monkeypatch):
    from voxelith.llm import common, neardup

    rng = np.random.default_rng(11)
    base, texts = [f"w{k}" for k in range(600)], []
    for _ in range(30):  # far enough from each other not to be linked, but with most shingles in common
        copy = list(base)
        for k in rng.choice(range(5, 595, 6), 10, replace=False):
            copy[k] = f"x{rng.integers(0, 10**6)}"
        texts.append(" ".join(copy))
    for k in range(4):
        texts.append(" ".join([*texts[k].split()[:-1], "end"]))
    made, plain = [], neardup.verified

    def counted(pairs, *args):
        pairs = common.materialise(pairs, "made")
        made.append((pairs.count(), pairs.distinct().count()))
        return plain(pairs, *args)

    monkeypatch.setattr(neardup, "verified", counted)
    keyed = common.materialise(spark.createDataFrame(list(enumerate(texts)), "row long, text string").repartition(3), "keyed")
    got = {r.row: r.component for r in neardup.near_copies(keyed).collect()}
    want = brute_near(texts)
    assert len(set(want)) > 20
    assert {frozenset(k for k in got if got[k] == c) for c in set(got.values())} == {frozenset(k for k, x in enumerate(want) if x == c) for c in set(want)}
    rows, distinct = made[-1]
    assert distinct > 100 and rows < 2 * distinct


def test_one_index_serves_any_benchmark(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"t{k}" for k in rng.integers(0, 40, int(rng.integers(0, 60)))) for _ in range(40)] + [None, "", "Caf\u00e9 \u00a0NA\u00cfVE x-Y\u20039 " * 6]
    docs = spark.createDataFrame([(k % 30, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    assert all([w.decode() for w in decontam.raw_words(t.encode())] == decontam.words(t) for t in texts if t)
    index = decontam.materialise(decontam.build_index(docs, shard_words=200), "index")
    assert sum(r.n for r in decontam.term_counts(index, spark.sparkContext.broadcast(sorted({w for t in texts for w in decontam.words(t)}))).collect()) == sum(len(decontam.words(t)) for t in texts)
    for own in (texts[:3], texts[20:24] + texts[-1:]):
        bench = spark.createDataFrame([(f"i{k}", t) for k, t in enumerate(own)], "item_id string, text string")
        items = [(f"i{k}", w) for k, t in enumerate(own) for w in set(decontam.windows(t))]
        want = Counter()
        for k, t in enumerate(texts):
            w = decontam.words(t)
            hits = [(i, a, a + len(g)) for i, g in items for a in range(len(w) - len(g) + 1) if tuple(w[a : a + len(g)]) == g]
            want[k % 30, len(w), len({p for _, a, b in hits for p in range(a, b)}), tuple(sorted({i for i, _, _ in hits}))] += 1
        for block in (3, 1000):
            assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontam.match(index, bench, 10, block=block).collect()) == want


def test_sketches_never_differ_in_more_than_the_sets():
    from voxelith.llm import neardup

    rng = np.random.default_rng(5)
    for size in (0, 1, 40, 300, 3000, 40_000):
        a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
        for other in (0, size // 7, 9 * size):
            b = np.unique(np.concatenate([a[size // 9 :], rng.integers(0, 2**64, other, dtype=np.uint64)]))
            x, y = neardup.sketch(a).tobytes(), neardup.sketch(b).tobytes()
            assert neardup.apart(x, y) == neardup.apart(y, x) <= len(np.setxor1d(a, b))
        assert neardup.apart(x, x) == 0
    far = [neardup.sketch(np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))).tobytes() for _ in range(2)]
    assert 9 * neardup.apart(*far) > 6000  # unrelated large sets are told apart


def test_near_dedup_keeps_null_and_repeated_ids(spark):
    import corpus_pipeline as P

    rows = [(None, "a text that stands alone here"), (1, "first of two other texts"), (1, "nothing like the one before it"), (2, "first of two other texts")]
    got = [tuple(r) for r in P.near_dedup(spark, spark.createDataFrame(rows, DOC), "").collect()]
    assert sorted(got, key=str) == sorted(rows[:3], key=str)


def test_lm_trains_on_all_words_and_ends(spark, monkeypatch):
    path = packing.tokenizer_path("byte_bpe_50k.tiktoken")
    texts = [" ".join(f"word{i % 7} Tail{i % 5}" for i in range(n)) for n in (3, 20, 100, 4000)] + ["", None, " \n lead and trail\t"]
    docs = spark.createDataFrame([(t, ("x", None)[k % 2]) for k, t in enumerate(texts)], "text string, lang string").repartition(3)
    count = Counter(w for t in texts for w in [*(t or "").lower().split(), "\n"])
    got = Counter()
    for r in lm.count_words(lm.modes_of(docs, "lang")[0], 1).collect():
        got[r.word] += r.n
    assert got == count
    trained, plain = Counter(), lm.gradients

    def spy(df, label):
        if label == "weights":
            trained["steps"] += 1
        return materialise(df, label)

    materialise = lm.materialise
    monkeypatch.setattr(lm, "materialise", spy)
    model = lm.fit(docs, path, "lang")
    assert model["tokens"] == sum(count.values()) and model["distinct"] == len(count) and trained["steps"] == lm.ROUNDS and plain is lm.gradients


def test_lm_batches_end_at_few_megabytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "64MB")
    try:
        docs = spark.createDataFrame([(1, "one two"), (2, None)], DOC)
        assert lm.score(docs, packing.tokenizer_path("byte_bpe_50k.tiktoken")).count() == 2
        assert spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() == 4 << 20
    finally:
        spark.conf.set(name, before)


def test_workers_drop_what_other_work_left():
    from voxelith.llm import common, words

    def seen(batches):
        yield len(words._TABLES)

    kept = dict(words._TABLES)
    try:
        words._TABLES["a path"] = None
        assert list(common.lean(seen, keeps=True)([])) == [len(kept) + 1]
        assert list(common.lean(seen)([])) == [0]
    finally:
        words._TABLES.update(kept)


def test_lm_deals_whole_counts_to_steps(spark):
    rows = [(f"w{k}", k % 2, n) for k, n in enumerate([1, 64, 65, 200, 300_000])]
    words = spark.createDataFrame(rows + [(f"x{k}", 1, 1) for k in range(9000)], "word string, mode int, n long")
    slots, _, _ = lm.deal(words)
    sums = {r["word"]: (r["n"], r["k"]) for r in slots.groupBy("word").agg(F.sum("n").alias("n"), F.countDistinct("trainer", "step").alias("k")).collect()}
    assert all(abs(sums[w][0] - n) < 1e-6 for w, _, n in rows) and sums["w4"][1] > sums["w3"][1] > sums["w0"][1] == 1


def test_lm_scores_do_not_depend_on_partitions_or_the_broadcast_bound(spark):
    path = packing.tokenizer_path("byte_bpe_50k.tiktoken")
    rng = np.random.default_rng(5)
    texts = [" ".join("".join(chr(97 + c) for c in rng.integers(0, 26, int(rng.integers(3, 12)))) for _ in range(60)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    runs = [{r.doc_id: (r.score, r.base_score, r.n_known) for r in lm.score(d, path, known=k).collect()} for d, k in ((docs.coalesce(1), 400_000), (docs.repartition(8), 400_000), (docs.coalesce(1), 50))]
    for other in runs[1:]:
        assert all(np.allclose(runs[0][d], other[d], rtol=1e-6) for d in runs[0])


def test_attention_between_words_is_that_of_a_plain_loop():
    rng = np.random.default_rng(3)
    told = np.vstack([rng.normal(0, 1, (30, 3)), np.zeros((1, 3))]).astype(np.float32)
    sizes, gate = [0, 1, 31, 32, 33, 200], {"salience": 0.5, "decay": 0.02}
    at = rng.integers(0, 31, sum(sizes))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    got, k = lm.weighed(told, at, bounds, gate), 0
    for a, b in zip(bounds, bounds[1:]):
        for t in range(b - a + 1):
            top, low = np.zeros(3), 1.0
            for j in range(max(0, t // lm.BLOCK * lm.BLOCK - lm.BLOCK), t):
                e = told[at[a + j]]
                if e.max() > 0:
                    weight = np.exp(gate["salience"] * e.max() - gate["decay"] * (t - j))
                    top, low = top + weight * e, low + weight
            assert np.allclose(got[k], top / low, atol=1e-4)
            k += 1


def text_model(rng):
    w = {k: x.astype(np.float64) for k, x in lm.text_weights(rng.integers(1, 50, lm.CLASSES)).items()}
    for k in ("u", "near", "b", "ib"):
        w[k] = rng.normal(0, 0.3, w[k].shape)
    return w


def test_lm_between_words_is_a_plain_causal_attention():
    rng = np.random.default_rng(4)
    w, sizes, deep = text_model(rng), [1, 5, 0, 32, 33, 64, 100, 150], lm.WIDTH // lm.HEADS
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    out = rng.integers(0, lm.CLASSES, bounds[-1])
    for size in (1, 3, 64):
        got = lm.class_logs(w, out, bounds, size)
        for a, b in zip(bounds, bounds[1:]):
            inp = np.concatenate([[lm.BEFORE], out[a:b]])
            q, k, v = (w["e"][inp] @ w["qkv"]).reshape(-1, 3, lm.HEADS, deep).transpose(1, 2, 0, 3)
            for t in range(b - a):
                seen = np.arange(max(0, t // lm.SPAN * lm.SPAN - lm.SPAN), t + 1)
                mixed = []
                for h in range(lm.HEADS):
                    x = np.exp(k[h, seen] @ q[h, t] / np.sqrt(deep) + w["near"][h, t - seen])
                    mixed.append(x / x.sum() @ v[h, seen])
                z = w["e"][inp[t]] + np.concatenate(mixed) @ w["o"]
                z = z + np.maximum(z @ w["i"] + w["ib"], 0) @ w["j"]
                p = np.exp(z @ w["u"] + w["b"])
                assert abs(got[a + t] - np.log(p[out[a + t]] / p.sum())) < 1e-5


def test_lm_gradients_between_words():
    rng = np.random.default_rng(6)
    w, bounds = text_model(rng), np.array([0, 3, 40, 140])
    out, weights = rng.integers(0, 40, 140), rng.random(140)
    loss = lambda: -float((weights * lm.class_logs(w, out, bounds)).sum() / weights.sum())
    g = lm.text_gradients(w, out, bounds, weights)
    assert set(g) == set(w)
    for k in g:
        for i in (np.unravel_index(np.abs(g[k]).argmax(), g[k].shape), np.unravel_index(rng.integers(g[k].size), g[k].shape)):
            keep, e = w[k][i], 1e-4
            w[k][i] = keep + e
            hi = loss()
            w[k][i] = keep - e
            lo = loss()
            w[k][i] = keep
            assert abs((hi - lo) / (2 * e) - g[k][i]) < 1e-7 + 0.01 * abs(g[k][i]), k


def test_lm_trains_between_words_on_every_place_once():
    import pyarrow as pa

    rng = np.random.default_rng(8)
    texts = [rng.integers(0, lm.CLASSES, n).astype(np.uint8) for n in (1, 70, 5000, 3, 20_000)]
    rows = pa.RecordBatch.from_pydict({"trainer": pa.array([0, 0, 0, 1, 1], pa.int32()), "ids": [x.tobytes() for x in texts], "weight": [1.0, 2.0, 1.0, 1.0, 1.0]})
    got = {0: [], 1: []}
    for trainer, out, bounds, weights in lm.text_steps(iter([rows.slice(0, 2), rows.slice(2)])):
        assert bounds[-1] == len(out) == len(weights)
        got[trainer] += list(zip(out[weights > 0].tolist(), weights[weights > 0].tolist()))
    want = [[(c, float(k == 1) + 1) for k in own for c in texts[k].tolist()] for own in ((0, 1, 2), (3, 4))]
    assert [got[0], got[1]] == want
    # a piece of a long text has the keys that it has in the whole text
    w, (part, weights) = text_model(rng), list(lm.pieces(texts[2], 1.0))[1]
    whole, cut = lm.class_logs(w, texts[2].astype(int), np.array([0, 5000])), lm.class_logs(w, part, np.array([0, len(part)]))
    assert np.allclose(whole[lm.PLACES : 2 * lm.PLACES], cut[weights > 0], atol=1e-5)


def test_lm_score_depends_on_the_words_before(spark):
    """Words come in a fixed turn in training: the same words in another order are less likely."""
    path = packing.tokenizer_path("byte_bpe_50k.tiktoken")
    names, rng = ["alpha", "beta", "gamma", "delta", "epsilon"], np.random.default_rng(9)
    texts = [" ".join(names[(i + k) % 5] for i in range(200)) for k in range(5) for _ in range(60)]
    turn, mixed = texts[0].split(), rng.permutation(texts[0].split()).tolist()
    rows = [(k, t) for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 5 != 1]
    held = [k for k in range(1000, 2000) if zlib.crc32(str(k).encode()) % 5 == 1][:2]
    docs = spark.createDataFrame([*rows, (held[0], " ".join(turn)), (held[1], " ".join(mixed))], DOC)
    got = {r.doc_id: r for r in lm.score(docs, path).collect()}
    a, b = (got[k] for k in held)
    assert a.held_out and b.held_out and abs(a.base_score - b.base_score) < 1e-6 and a.n_known == b.n_known == 201
    assert a.score > b.score + 25 and a.score > a.base_score + 25


def test_long_and_null_turns_keep_their_lines_in_order(spark, tmp_path):
    body = [f"{9999 - k} of many" for k in range(1500)]
    turns = [(1, 0, "user", "what is it?"), (1, 1, "assistant", "\n".join(body)), (1, 2, "user", "and then?"), (2, 0, "user", "hello?"), (2, None, "assistant", "the end")]
    turns += [(c, t, ("user", "assistant")[t % 2], "what?" if t % 2 == 0 else "a long answer\nof lines") for c in range(3, 15) for t in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op4_chat_format(spark, str(tmp_path)).collect()
    lines = [x for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.line_no) for x in r.rendered.split("\n") if x.endswith("of many")]
    assert [x.split(": ")[-1] for x in lines][1:] == body[1:]
    assert sum(r.n_lines for r in got if r.conv_id == 2) == 2 and any("the end" in r.rendered for r in got if r.conv_id == 2)


def test_blocks_of_windows_give_the_rows_of_one_block(spark):
    rows = [(None, "alpha beta"), (None, "gamma delta"), (5, "alpha beta gamma delta"), (5, "none of it"), (5, "none of it"), (6, None)]
    docs = spark.createDataFrame(rows, DOC)
    bench = spark.createDataFrame([("a", "alpha beta"), ("b", "gamma delta"), ("c", "of it")], "item_id string, text string")
    one, many = (Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(map(tuple, r.spans))) for r in decontam.decontaminate(docs, bench, 10, block=b).collect()) for b in (100, 1))
    assert one == many and sum(one.values()) == len(rows)


def test_proximity_keeps_a_longer_span_inside_a_document(spark):
    docs = spark.createDataFrame([(1, "x b"), (2, "a y y b")], DOC).coalesce(1)
    bench = spark.createDataFrame([("i", "a b")], "item_id string, text string")
    got = {r.doc_id: r.n_hit for r in decontam.decontaminate(docs, bench, 10, slop=2).collect()}
    assert got == {1: 0, 2: 4}


def test_decontamination_stage_by_row(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([("i", "alpha beta gamma")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "alpha beta gamma"), (None, "a clean text"), (1, "alpha beta gamma too"), (1, "another clean text")]
    got = [tuple(r) for r in P.decontamination(spark, spark.createDataFrame(rows, DOC), str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([rows[1], rows[3]], key=str)



def test_stages_take_empty_tables(spark):
    import corpus_pipeline as P

    none = spark.createDataFrame([], DOC)
    assert P.near_dedup(spark, none, "").count() == 0 and P.decontamination(spark, none, "/root/testdata/sf0.001").count() == 0


def test_stages_carry_clashing_columns_and_null_ids(spark, tmp_path):
    import corpus_pipeline as P

    bench = [("b", "one two three four five six seven eight nine ten eleven")]
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    body = " ".join(f"word{chr(97 + k % 26)}{k}x" for k in range(40))
    other = " ".join(f"other{chr(97 + k % 26)}{k}y" for k in range(40))
    rows = [(None, body), (7, body), (7, other), (None, other + " " + bench[0][1]), (8, None), (None, "mail a@b.com " + " ".join(f"third{chr(97 + k % 26)}z" for k in range(30)))]
    extra = ["n_words", "failed", "_w", "_row", "_base", "row", "kept", "terms", "entity", "c0"]
    docs = spark.createDataFrame([(a, b, *(f"{k}-{c}" for c in extra)) for k, (a, b) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{c} string" for c in extra))
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        docs = spark.createDataFrame(after.collect(), docs.schema)
    got = {r["n_words"].split("-")[0]: r for r in docs.collect()}
    assert sorted(got) == ["1", "2", "5"]  # few words; a copy; a benchmark passage
    assert got["5"].text.startswith("mail <EMAIL> ") and got["5"]["_w"] == "5-_w" and got["5"].doc_id is None
    assert P.STAGES[-1][1](spark, docs, str(tmp_path)).select("doc_id").distinct().count() == 3 - 1


def test_a_chain_of_links_takes_few_rounds(spark, monkeypatch):
    written = []
    plain = simhash.materialise
    monkeypatch.setattr(simhash, "materialise", lambda df, label: (written.append(label), plain(df, label))[1])
    edges = spark.createDataFrame([(k, k + 1) for k in range(299)], "a long, b long")
    roots = simhash.components(edges).collect()
    assert len(roots) == 300 and {r.root for r in roots} == {0} and written.count("parents") <= 3


def test_numerals_are_no_letters():
    tools = langid.compressors([("en", b" the and of to in is that ", 1), ("de", b" der die und das ist ein ", 1)])
    assert langid.classify("½ ²³ ① 12", tools)[0] == "und" and langid.classify("the and", tools)[0] == "en"


def test_batches_of_the_pipeline_are_small(spark):
    import corpus_pipeline as P

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        P.staged(lambda spark, docs, sf_dir: docs)(spark, spark.range(1), "")
        wide = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('x', 8000) AS text")

        def sizes(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

        got = wide.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in got) == 3000 and max(r["size"] for r in got) < 1.1 * P.BATCH_BYTES
    finally:
        spark.conf.unset(name)


def test_index_of_a_large_shard(spark):
    texts = [" ".join(f"t{(k * j) % 97}" for j in range(30_000)) for k in range(1, 6)] + [None, "last one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    row = decontam.build_index(docs).collect()
    assert len(row) == 1 and row[0].doc_ends == [30_000, 60_000, 90_000, 120_000, 150_000, 150_000, 150_002]
    words = [w for t in texts for w in decontam.words(t)]
    at, flat = 0, np.frombuffer(row[0].postings, "<u4")
    for term, n in zip(row[0].terms, row[0].counts, strict=True):
        assert flat[at : at + n].tolist() == [k for k, w in enumerate(words) if w == term]
        at += n
    assert at == len(words)


def test_packing_keeps_small_word_tables():
    """A table of 600,000 different words stays below 60 MB, and words that it has dropped get the same ids again."""
    import sys

    from voxelith.llm import packing, words

    tool = words.WordTable(packing.tokenizer_path())
    for k in range(10):
        list(tool.ids([" ".join(f"w{i}q" for i in range(60_000 * k, 60_000 * (k + 1)))]))
    size = sys.getsizeof(tool.known) + sum(sys.getsizeof(w) + sys.getsizeof(ids) for w, ids in tool.known.items())
    assert size < 60_000_000
    text = "w7q the words w310000q, w599999q and naïve Ünïcode 雪!"
    assert list(tool.ids([text])) == tool.encode_each([text])
