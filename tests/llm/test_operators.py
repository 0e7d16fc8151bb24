"""Edge rows: nulls, empty and long texts, ties, repeated rows, extra columns with clashing names, empty tables; each against a brute-force version."""

import base64
import gzip
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.test_whole import brute_near
from voxelith.llm import chat, decontam, langid, lm, packing, pii, quality, simhash, url_filter, warc

LONG = " ".join(f"word{i % 977} Tail{i % 13}" for i in range(6000))
COPY = "the quick brown fox jumps over the lazy dog near the old river bank on a cold morning in may while birds sing"
TEXTS = [
    None, "", "   \n\t ", "one", "two Words", COPY, COPY, COPY.replace("cold", "warm"), COPY.upper(), LONG, LONG + " end",
    "mail me at a.b@mail.example.com or +1 (555) 010-9999, ip 10.0.0.255 not 300.1.1.1, card 4111 1111 1111 1111 and 4111111111111112",
    "a@b@c.de @x.y x@y. 1.2.3.4.5.6.7.8 0000000255.1.1.1 " + "9" * 5000, "line\nline\n\nother\nline", "é ñ <|endoftext|> 's don't ÀÉ 3.14", ("a b c d e f g h " * 4).strip(), "\u00a0nbsp\u2028sep", "%%% ### *** &&& |||",
]
DOC = "doc_id long, text string, lang string, source string, n_chars long, n_words string, fp string, row string, failed int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", 1, "clash", "clash", "clash", 5) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id here", None, None, None, None, None, None, None), (5, COPY, "en", "s", 1, None, None, None, None), (5, COPY, "en", "s", 1, None, None, None, None)]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOC)


def rows_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# --- 1


def test_arc_versions_and_faults():
    for v in (1, 2):
        a = warc.arc_archive("x.arc", v, [(7, "http://a b/\n", b"hi\r\n\r\nyou"), (None, None, b"")])
        for data in (a, gzip.compress(a)):
            got = list(warc.parse_arc("x", data))
            assert [(r["key"], r["payload"], r["arc_version"]) for r in got] == [(7, b"hi\r\n\r\nyou", v), (None, b"", v)]
        assert list(warc.parse_arc("x", a[:-3]))[-1]["error"] and list(warc.parse_arc("x", a + b"\nrubbish\n"))[-1]["error"] and not list(warc.parse_arc("x", b""))
    for k in (0, 5, -1, 2**63 - 1, -(2**63)):
        assert warc.uuid_key(warc.record_uuid(k, "a")) == k
    assert warc.uuid_key(warc.record_uuid(None, "a")) is None


def test_warc_round_trip(spark):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é\r\n\r\nWARC/1.1\r\n", "<p>a</p>", "x" * 300_000]
    rows = [(i, f"http://h/{i}" if i else None, h, "clash") for i, h in enumerate(html)] + [(5, "http://h/5", "<p>a</p>", "c"), (None, "http://n/", "<p>a</p>", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    got = warc.convert(warc.pages_as_arc(pages, 2)).collect()
    by = defaultdict(list)
    for i, _, h, _ in rows:
        by[(h or "").encode()].append(i)
    want = Counter()
    for data, ids in by.items():
        top = max(i for i in ids if i is not None)
        for i in ids:
            d = base64.b32encode(hashlib.sha1(data).digest()).decode()
            want[(i, len(data), d, *(("response", None) if i in (top, None) else ("revisit", top)))] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want and all(r.verified for r in got)
    assert warc.convert(warc.pages_as_arc(pages.limit(0))).count() == 0
    assert warc.convert(warc.pages_as_arc(pages), min_bytes=10**9).where("record_type <> 'response'").count() == 0


# --- 2


def test_urls(spark):
    urls = [None, "nothing", "http://Sub.Example.ORG/es/1?x", "http://example.org/en/12", "https://a.com/fr/x#f", "ftp://com/de/1", "http://org", "http://xorg/", "http://b.net/p/1", "x://y://z/w"]
    urls += [f"http://s.net/bad/{i}" for i in range(40)] + [f"http://s.net/good/{i}" for i in range(40)]
    pages = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(i, int(10 <= i < 50)) for i in range(10, 90)] + [(12, 0), (9999, 1)], "page_id long, bad int")
    got = {r.page_id: r for r in url_filter.judge(pages, labels).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, s) for s, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fits)[1] if fits else None
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        if fits:
            assert got[i].verdict == max(fits)[2]
    assert all(got[i].verdict == "block" for i in range(10, 50)) and all(got[i].verdict == "allow" for i in range(50, 90))
    assert url_filter.judge(pages.limit(0), labels).count() == 0 and url_filter.judge(pages, labels.limit(0)).where("verdict = 'block' AND rule IS NULL").count() == 0


# --- 3


def brute_hits(text, items, n=10):
    w = decontam.words(text)
    hit, own = set(), set()
    for k, t in items:
        for x in decontam.windows(t, n):
            for i in range(len(w) - len(x) + 1):
                if tuple(w[i : i + len(x)]) == x:
                    hit.update(range(i, i + len(x)))
                    own.add(k or "")
    return len(w), len(hit), sorted(own)


@pytest.mark.parametrize("block", [10**6, 3])
def test_decontamination(spark, docs, empty, block):
    items = [("a", COPY), ("b", "one"), (None, "two words"), ("d", None), ("e", ""), ("f", "word5 tail5 word6"), ("a", "brown fox")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontam.decontaminate(docs, bench, 10, block=block).collect())
    want = Counter((d, *(x if not isinstance(x, list) else tuple(x) for x in brute_hits(t, items))) for d, t in rows_of(docs))
    assert (got if block > 3 else set(got)) == (want if block > 3 else set(want))
    if block > 3:
        assert decontam.decontaminate(empty, bench).count() == 0 and decontam.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_proximity():
    rng = np.random.default_rng(0)
    for _ in range(40):
        w = [f"t{k}" for k in rng.integers(0, 6, 60)]
        lists = {t: np.array([i for i, x in enumerate(w) if x == t]) for t in set(w)}
        phrase, slop = ("t0", "t1", "t2"), int(rng.integers(0, 4))
        spans = decontam.near(lists, phrase, [0, 1, 2], slop)
        width = 3 + slop
        some = any({"t0", "t1", "t2"} <= set(w[i : i + width]) for i in range(len(w)))
        assert bool(spans) == some
        assert all({"t0", "t1", "t2"} <= set(w[a:b]) and b - a <= width for a, b in spans)


# --- 4


def test_viterbi_in_blocks_is_one_pass():
    rng = np.random.default_rng(1)
    model = {k: np.log(x / x.sum(-1, keepdims=True)) for k, x in {"start": rng.random(chat.K), "move": rng.random((chat.K, chat.K)), "emit": rng.random((chat.K, chat.SYMBOLS))}.items()}
    obs = rng.integers(0, chat.SYMBOLS, 57)
    whole = chat.trace(obs, model, None, None)
    parts = np.split(obs, [10, 11, 40])
    first = model["start"] + model["emit"][:, parts[0][0]]
    for o in parts[0][1:]:
        first = (first[:, None] + model["move"]).max(0) + model["emit"][:, o]
    ends = chat.chain([chat.block_matrix(p, model) for p in parts[1:]], first)
    got = sum((chat.trace(p, model, b, e) for p, b, e in zip(parts, [None, *ends[:-1]], ends, strict=True)), [])
    assert got == whole


def test_transcripts(spark):
    turns = [(c, t, ("user", "assistant")[t % 2], f"what is {t}?" if t % 2 == 0 else "It is a long answer with many words.\nsecond line " * 4) for c in range(12) for t in range(8)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    lines = chat.transcript_lines(rows)
    model = chat.learn(lines.withColumn("line_no", lines["turn"]))
    raw = lines.selectExpr("conv_id", "turn * 64 + k AS line_no", "text")
    got = chat.render(chat.decode(raw, model, 128), 128).collect()
    right = sum(r.role == ("user", "assistant")[r.line_no // 64 % 2] for r in got)
    assert right >= 0.9 * len(got) and abs(len(got) - 96) <= 10
    assert all(r.rendered.startswith(f"<|{r.role}|>\n") and r.rendered.endswith("\n<|end|>\n") for r in got)
    odd = spark.createDataFrame([(None, 0, None), (1, 0, "User: hi"), (1, 0, "User: hi"), (1, 1, "")], "conv_id long, line_no long, text string")
    assert sum(r.n_lines for r in chat.render(chat.decode(odd, model)).collect()) == 4
    assert chat.render(chat.decode(odd.limit(0), model)).count() == 0


# --- 5


def test_lm(spark, docs, empty):
    path = packing.tokenizer_path("byte_bpe_50k.tiktoken")
    got = lm.score(docs, path, known=20).collect()
    data = rows_of(docs)
    words = {i: [*(t or "").encode().lower().split(), b"\n"] for i, (_, t) in enumerate(data)}
    out = [zlib.crc32(str("" if d is None else d).encode()) % 5 == 1 for d, _ in data]
    c = Counter(w for i, ws in words.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    want = Counter((d, out[i], len(words[i]), sum(w in c for w in words[i]), n, round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words[i]), 5)) for i, (d, _) in enumerate(data))
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got) and lm.score(empty, path).count() == 0


def test_lm_gradients_and_sums():
    rng = np.random.default_rng(2)
    n = lm.GROUPS * lm.SLOTS
    pairs = np.zeros((3, n + 1, n))
    for a in (0, 5, 9, 40, lm.BEGIN):
        pairs[:, a] = rng.integers(0, 5, (3, n))
    w = {k: x.astype(np.float64) for k, x in lm.start_weights(pairs).items()}
    w["g"], w["s"] = (rng.normal(0, 0.3, w[k].shape) for k in "gs")
    words = [np.append(rng.integers(0, 60, k), lm.STOP) for k in (1, 3, 7, 15, 21, 45)] + [np.array([lm.FIN])]
    flat, stops = np.concatenate(words), np.cumsum([len(x) for x in words])
    modes, weights = np.arange(len(words)) % 3, rng.random(len(words)) + 0.5
    f = lm.windows(flat, stops, modes)
    assert f["scored"].sum() == len(flat) and np.array_equal(f["out"][f["scored"]], flat)  # each token is scored once, in order
    sizes = np.diff(np.concatenate([[0], stops]))
    loss = lambda: -float((weights * lm.word_logs(w, flat, stops, modes)).sum() / (weights * sizes).sum())
    g = lm.gradients(w, flat, stops, modes, weights)
    assert set(g) == set(w) - set(lm.FIXED)
    for k in g:
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        keep, e = w[k][i], 1e-4
        w[k][i] = keep + e
        hi = loss()
        w[k][i] = keep - e
        lo = loss()
        w[k][i] = keep
        assert abs((hi - lo) / (2 * e) - g[k][i]) < 1e-6 + 0.01 * abs(g[k][i]), k
    # the classes that may come after 5, 9 have probabilities that sum to one
    flat = np.concatenate([[5, 9, t] for t in range(n)])
    upto = lm.word_logs(w, np.array([5, 9]), np.array([2]), np.array([1]))[0]
    assert abs(np.exp(lm.word_logs(w, flat, np.arange(3, 3 * n + 1, 3), np.ones(n, int)) - upto).sum() - 1) < 1e-6
    # a word's log does not depend on later words or on the words scored with it
    one = [lm.word_logs(w, x, np.array([len(x)]), modes[k : k + 1])[0] for k, x in enumerate(words)]
    assert np.allclose(one, lm.word_logs(w, np.concatenate(words), stops, modes))


# --- 6


def brute_quality(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    g = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    rep = {p for i in range(len(w) - 7) if g[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)


def test_quality(spark, docs, empty):
    rows = quality.apply_policy(quality.ledger(docs)).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == Counter((d, *brute_quality(t)) for d, t in rows_of(docs))
    for r in rows:
        assert bool(r.failed & 3) == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) and r.kept == (r.failed & quality.mask_of(quality.POLICIES["v3"]) == 0)
    a = quality.ablation(quality.ledger(docs)).collect()
    assert {r.rule for r in a} == set(quality.RULES) and all(r.n_only == sum(x.failed == quality.bit(r.rule) for x in rows) for r in a)
    assert quality.ledger(empty).count() == 0
    kept = quality.ledger(docs, "text").where(~quality.rejected())
    assert kept.count() == sum(r.kept for r in rows)


# --- 7


def test_language(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = langid.learn(docs.where(~held))
    lang = {r.doc_id: r.lang for r in docs.where(held).collect()}
    got = langid.predict(docs.where(held), model).collect()
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !!"), (None, "the and of")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(odd, model).collect()} | {None: 0} == {1: "und", 2: "und", 3: "und", None: 0}
    assert langid.learn(docs.limit(0)) == [] and {r.lang_pred for r in langid.predict(odd, []).collect()} == {"und"}


# --- 8


def brute_components(fps):
    top = list(range(len(fps)))

    def root(a):
        while top[a] != a:
            a = top[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(fps))]


def test_simhash(spark, docs, empty):
    data = rows_of(docs)
    fps = [simhash.fingerprint(t) for _, t in data]
    roots, ids = brute_components(fps), defaultdict(list)
    for (d, _), r in zip(data, roots, strict=True):
        ids[r].append(d)
    want = Counter((d, f - (1 << 64) if f >> 63 else f, min((x for x in ids[r] if x is not None), default=None)) for (d, _), f, r in zip(data, fps, roots, strict=True))
    assert Counter((r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.fingerprint("") == 0 and simhash.fingerprint("A b") == simhash.fingerprint("a  B")


def test_forest_of_long_lists():
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 2**63))
    near = np.unique(np.array([base ^ sum(1 << int(b) for b in rng.choice(16, rng.integers(0, 9), False)) for _ in range(400)], np.uint64))
    assert len(near) > simhash._SMALL
    want = brute_components(near.tolist())
    top = {v: v for v in near.tolist()}

    def root(a):
        while top[a] != a:
            a = top[a]
        return a

    for a, b in simhash.forest(near, 2):
        assert (a ^ b).bit_count() <= 2
        top[root(a)] = root(b)
    assert len({root(v) for v in near.tolist()}) == len(set(want))


def test_components_of_a_path(spark):
    n = 200
    order = np.random.default_rng(4).permutation(n).tolist()
    edges = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in zip(order, order[1:], strict=False) if a != 50], "a long, b long")
    cut = order.index(50)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert all(roots[x] == min(order[: cut + 1]) for x in order[: cut + 1]) and all(roots[x] == min(order[cut + 1 :]) for x in order[cut + 1 :]) if 0 < cut < n - 2 else roots


# --- 9


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tool = Tokenizer.from_file(path)
    want = Counter()
    for d, t in rows_of(docs):
        ids = np.array([*tool.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[(d, len(ids))] += 1
    for limits in ((2048, 256, 2048), (64, 4, 40)):
        rows = packing.pack(docs, path, limits).collect()
        seqs = defaultdict(list)
        for r in rows:
            seqs[r.sequence_id].append(r)
        for s in seqs.values():
            s.sort(key=lambda r: r.offset)
            assert [r.offset for r in s] == np.cumsum([0, *(r.length for r in s[:-1])]).tolist()
            n = sum(r.length for r in s)
            assert n <= limits[0] and n & (n - 1) == 0 and len(s) <= limits[1] and sum(r.loss_tokens for r in s) <= limits[2]
        total = Counter()
        for r in rows:
            total[r.doc_id] += r.length
        assert total == Counter({d: sum(n * k for (e, n), k in want.items() if e == d) for d, _ in want})
    one = {(r.start, r.length): r.ids_crc32 for r in packing.pack(docs.where("doc_id = 9"), path).collect()}
    ids = np.array([*tool.encode(LONG, add_special_tokens=False).ids, 1], "<u4")
    assert all(zlib.crc32(ids[a : a + n].tobytes()) == c for (a, n), c in one.items())
    assert packing.pack(empty, path).count() == 0


# --- 10

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = {"email": lambda s: True, "ip": lambda s: all(int(x) <= 255 for x in s.split(".")), "card": lambda s: 13 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), "phone": lambda s: 9 <= len(digits(s)) <= 15}
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if ok[k](m[0])]


def test_patterns_against_plain_regexes():
    rng = np.random.default_rng(5)
    letters = list("a1.@-+ 0925()%x")
    for _ in range(3000):
        t = "".join(rng.choice(letters, rng.integers(0, 40)))
        assert pii.base_spans(t) == brute_pii(t), t
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == []
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_pii(spark, docs, empty):
    short = docs.where("doc_id IS NULL OR doc_id <> 12")
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base) for r in pii.find(short).collect())
    want = Counter()
    for d, t in rows_of(short):
        s = brute_pii(t)
        want[(d, *(sum(x[0] == k for x in s) for k in pii.KINDS), pii.joined(s))] += 1
    assert got == want and pii.find(empty).count() == 0


def brute_disclosing(texts, residue=1.0, margin=7.0):
    """Both measures over texts of which no two are alike."""
    spans = [pii.base_spans(t) + pii.secret_spans(t) for t in texts]
    terms = [set(pii.terms_of(t, s)) for t, s in zip(texts, spans)]
    every = [{pii.term(w) for w in t.split()} for t in texts]
    ents = [{f"{k}:{t[a:b].lower()}" for k, a, b in s} | {k for k, *_ in s} for t, s in zip(texts, spans)]
    n_e, n_et = Counter(e for x in ents for e in x), Counter((e, w) for x, ws in zip(ents, terms) for e in x for w in ws)
    looked = sum(1 for e, _ in n_et if n_e[e] > 1)
    out = set()
    for (e, w), n in n_et.items():
        p = n / (sum(w in x for x in every) + pii.PRIOR)
        if n > 1 and -np.log2(p) <= residue and n * np.log2(p / (n_e[e] / len(texts))) >= np.log2(looked) + margin:
            out.add((e, w))
    return out


def test_disclosing_terms(spark):
    rng = np.random.default_rng(4)
    noise = lambda k: " ".join(f"n{x}" for x in rng.integers(0, 400, k))
    rows = [(i, f"{noise(12)} Zorp, {noise(3)} x@y.com {noise(9)}") for i in range(6)] + [(10 + i, f"{noise(30)} {i}") for i in range(400)]
    rows += [(500 + i, f"copy only copied a@b.com and copying these words of one text {i % 3}") for i in range(50)]  # copies and near copies
    rows += [(600 + i, f'{noise(9)} passkey = "{i}a8f3cc0129bd77e0a1{i}" {noise(9)}') for i in range(10)] + [(700, "a zorp without an address (zorp)"), (701, None), (702, "")]
    docs = spark.createDataFrame([(a, b, "k") for a, b in rows], "doc_id long, text string, _row string")
    plain = docs.where("doc_id < 500 OR doc_id BETWEEN 600 AND 700")
    want = brute_disclosing([t for d, t in rows if d < 500 or 600 <= d <= 700])
    assert {tuple(r) for r in pii.disclosing(plain).collect()} == want and ("email:x@y.com", "zorp") in want and ("secret", "passkey") in want
    more = {r.doc_id: r.more for r in pii.find(docs).collect()}
    text = dict(rows)
    for i in range(6):
        a = text[i].index("Zorp")
        assert more[i] == f"term:{a}:{a + 4}"
    assert more[700] == "term:2:6,term:27:31" and all("secret:" in more[600 + i] and "term:" in more[600 + i] for i in range(10))
    assert not any(more[500 + i] or more[10 + i] for i in range(50)) and more[701] == more[702] == ""
    clean = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    assert clean[0].text == text[0].replace("Zorp", "<TERM>").replace("x@y.com", "<EMAIL>") and clean[10].text == text[10] and clean[500]._row == "k"
    assert clean[700].text == "a <TERM> without an address (<TERM>)" and clean[701].text is None and len(clean) == len(rows)
    pii_terms = pii.TERMS
    try:
        pii.TERMS = 1  # one block for each term
        assert {r.doc_id: sorted(r.more.split(",")) for r in pii.find(docs).collect()} == {d: sorted(m.split(",")) for d, m in more.items()}
    finally:
        pii.TERMS = pii_terms


def test_pipeline(spark):
    import corpus_pipeline as P

    sf, docs = "/root/testdata/sf0.001", spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    names, before = [n for n, _ in P.STAGES], docs
    assert names == ["quality_rules", "near_dedup", "decontamination", "pii", "packing"]
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, before, sf)
        assert after.columns == docs.columns
        after = spark.createDataFrame(after.collect(), docs.schema)
        if name == "near_dedup":
            # texts that share 0.8 of their five-word shingles, as the stage is asked for
            had = sorted(before.collect(), key=lambda r: r.doc_id)
            assert sorted(r.doc_id for r in after.collect()) == sorted({had[k].doc_id for k in brute_near([r.text for r in had])})
        if name == "decontamination":
            items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            grams = {w for _, t in items for w in decontam.windows(t)}
            keep = sorted(r.doc_id for r in before.collect() if not any(tuple(w[i : i + n]) in grams for w in [decontam.words(r.text)] for n in {len(g) for g in grams} for i in range(len(w) - n + 1)))
            assert sorted(r.doc_id for r in after.collect()) == keep
        if name == "pii":
            assert all(not brute_pii(r.text) for r in after.collect())
        before = after
    assert P.STAGES[-1][1](spark, before, sf).select("doc_id").distinct().count() == before.count()
    none = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, sf).count() == 0
