"""Operators of finquill.llm against brute force, round trips or held-out accuracy."""

import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("finquill.llm")

from pyspark.sql import functions as F  # noqa: E402

from finquill.llm import ann, components, decontamination, language_id, line_dedup, ngram_join, pii, quality, sentencepiece_bpe, toxicity, warc  # noqa: E402

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, node long"


@pytest.fixture(scope="module")
def docs(spark):
    """Small documents with copies, near copies, nulls, empties, ties and clashing columns."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(60)] for _ in range(40)]
    texts = [" ".join(b) for b in base]
    for k in range(60):  # near copies with one to three changed words
        b = list(base[k % 6])
        for _ in range(1 + k % 3):
            b[r.randrange(len(b))] = r.choice(words)
        texts.append(" ".join(b))
    texts += [texts[0], texts[0].upper(), "one two", "one two", "", None, "  ", "a\nb\na\n\nb", "Ü é x " * 4, "long " * 5000]
    rows = [(i, t, "en", "s", len(t or ""), 0.5, 1) for i, t in enumerate(texts)]
    rows.append(rows[3])  # a repeated row
    return spark.createDataFrame(rows, DOCS)


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_ngram_join(spark, docs, monkeypatch):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_components(rows)
    got = ngram_join.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert sum(n > 0 and i != c for i, (n, c) in want.items()) > 20
    monkeypatch.setattr(ngram_join, "CHUNK", 8)  # large clusters go by chunks
    monkeypatch.setattr(ngram_join, "PAIRED", 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect()} == want
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_ngram_join_empty(spark):
    assert ngram_join.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (100, 101), (5, 5), (200, 150), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(31), 0) | {100: 100, 101: 100, 200: 150, 150: 150}


def test_line_dedup(spark):
    line = "the quick brown fox jumps over the lazy dog near the river bank on a sunny day with all of its many friends and foes"
    texts = [f"{line}\nalpha beta", f"{line.upper()}  \ngamma", line, None, "", "x\n\nx\ny", "gamma", f"{line} "]
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)] + [(None, "gamma", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.n_lines, r.n_removed, list(r.removed)) for r in line_dedup.line_report(df).collect() if r.doc_id is not None}
    assert got == {0: (2, 0, []), 1: (2, 1, [0]), 2: (1, 1, [0]), 3: (0, 0, []), 4: (1, 0, []), 5: (4, 1, [2]), 6: (1, 1, [0]), 7: (1, 1, [0])}
    kept = {r.doc_id: (r.text, r.n_chars) for r in line_dedup.drop_lines(df).collect()}
    assert kept == {0: (texts[0], len(texts[0])), 1: ("gamma", 5), 3: (None, 0), 4: ("", 0), 5: ("x\n\ny", 4), None: ("gamma", 5)}


def _simhash(words, mask=(1 << 64) - 1):
    votes = [0] * 64
    for w in words:
        for b in range(64):
            votes[b] += w >> b & 1
    return sum(1 << b for b in range(64) if votes[b] > len(words) // 2) & mask


def test_simhash(spark):
    r = random.Random(1)
    lines = [" ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(r.randint(1, 90))) for _ in range(100)]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    hashed = line_dedup.with_simhash(df).select("line", "s", F.transform(F.array_distinct(F.split("line", " ")), lambda w: F.xxhash64(w)).alias("h"))
    for row in hashed.collect():
        assert row.s % (1 << 64) == _simhash([h % (1 << 64) for h in row.h])


def test_sentencepiece(spark, docs):
    sentencepiece = pytest.importorskip("sentencepiece")
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in sentencepiece_bpe.encode_decode(docs, path).collect():
        text = docs_text(docs)[r.doc_id] or ""
        assert list(r.ids) == sp.encode(text)
        assert r.decoded == sp.decode(list(r.ids))
    model = sentencepiece_bpe.Model(sentencepiece_bpe.read_model(path))
    rng = random.Random(2)
    texts = ["".join(rng.choice("aberst 01.,é\n中😀▁\x00") for _ in range(rng.randint(0, 80))) for _ in range(300)] + [" " * 700 + "x", "ab" * 900]
    flat, counts = model.encode(texts)
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == sp.encode(texts)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), 1, 2, 0]) for _ in range(rng.randint(1, 9))]
        assert model.decode(ids) == sp.decode(ids)


def docs_text(docs, cache={}):  # noqa: B006
    if not cache:
        cache.update({r.doc_id: r.text for r in docs.collect()})
    return cache


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_hits(text, items, window=10):
    def words_of(t):
        return WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))

    words, hit, found = words_of(text), set(), set()
    for name, item in items:
        w = words_of(item)
        n = min(window, len(w))
        for g in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else ():
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) == g:
                    hit.update(range(i, i + n))
                    found.add(str(name))
    return len(words), len(hit), sorted(found)


def test_decontamination(spark, monkeypatch):
    r = random.Random(3)
    words = ["a", "b", "c", "É", "d1"]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([0, 1, 3, 9, 10, 14])))) for i in range(8)] + [(9, None), (8, "a b"), (8, "a b")]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) for _ in range(60)]
    texts += [items[5][1].upper() + ".", "x " + (items[4][1] or "") + " y", None, "", "z " * 3000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, contaminated string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (200_000, 20):
        monkeypatch.setattr(decontamination, "AUTOMATON_WORDS", limit)
        for row in decontamination.find_contamination(docs, bench).collect():
            x = row.contamination
            assert (x.n_words, sum(s.end - s.start for s in x.spans), list(x.item_ids)) == brute_hits(texts[row.doc_id], items)
    none = decontamination.find_contamination(docs, bench.where("item_id = 9")).collect()
    assert all(not row.contamination.spans for row in none)
    long_item = spark.createDataFrame([(1, " ".join(f"q{i}" for i in range(12)))], "item_id long, text string")
    text = "keep this " + " ".join(f"Q{i}" for i in range(12)) + ", and " + " ".join(f"k{i}" for i in range(30))
    mixed = spark.createDataFrame([(1, text, 0), (2, " ".join(f"q{i}" for i in range(12)), 0), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    kept = {x.doc_id: x.text for x in decontamination.decontaminate(mixed, long_item).collect()}
    assert kept == {1: "keep this , and " + " ".join(f"k{i}" for i in range(30)), 3: "clean"}


def test_pii(spark):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def brute(t):
        digits = {m.span(): re.sub("[^0-9]", "", m[0]) for p in (card, phone) for m in p.finditer(t)}
        out = [(m.start(), 0, m.end()) for m in email.finditer(t)]
        out += [(m.start(), 1, m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [(m.start(), 2, m.end()) for m in card.finditer(t) if 14 <= len(d := digits[m.span()]) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0]
        out += [(m.start(), 3, m.end()) for m in phone.finditer(t) if 10 <= len(digits[m.span()]) <= 15]
        return sorted(out)

    r = random.Random(4)
    texts = ["".join(r.choice(a) for _ in range(r.randint(0, 40))) for a in ("a@.b-1 ", "0123.@a", " +0123456789().-", "4 1-", "@.é1") for _ in range(400)]
    texts += ["card 4111 1111 1111 1111, mail é.x@a.bc", "IBAN DE89 3704 0044 0532 0130 00 end", "9" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)) + [(10**6, None)], "doc_id long, text string")
    for row in pii.pii_spans(df).collect():
        got = [(s.start, pii.BASE.index(s.kind), s.end) for s in row.spans if s.kind in pii.BASE]
        assert got == (brute(texts[row.doc_id]) if row.doc_id < 10**6 else [])
    assert pii.find(texts[-2])[0][2] == "iban" and pii.find("mail a@b.cd")[0][3] > pii.find("sample a@b.cd")[0][3]
    assert pii.mask("to a@b.cd now") == "to <email> now"


def test_warc(spark):
    rows = [(5, "http://a/ b\n", "same"), (3, "http://c", "same"), (7, None, None), (8, "u", ""), (9, "é", "ünï" * 1000), (5, "http://a/ b\n", "same")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha string")
    got = warc.archive_round_trip(pages).collect()
    assert len(got) == len(rows) and all(r.intact for r in got)
    first = {"same": 3, "": 7, "ünï" * 1000: 9}
    for r in got:
        html = next(h for p, _, h in rows if p == r.page_id) or ""
        want = ("response", None) if first[html] == r.page_id else ("revisit", first[html])
        assert (r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) == (*want, len(html.encode()), warc.digest_of(html.encode()))
    assert list(warc.ranges([("f", 0, 10), ("f", 10, 5), ("f", 10**6, 5), ("g", 0, 1)])) == [("f", 0, 15, 0, 2), ("f", 10**6, 10**6 + 5, 2, 3), ("g", 0, 1, 3, 4)]
    head, http, payload = warc.parse(gzip.decompress(gzip.compress(warc.record(1, "u", b"x\r\n\r\ny", "D", None, False))))
    assert payload == b"x\r\n\r\ny" and http["Content-Length"] == "6" and head["WARC-Type"] == "response"


def test_nearest_neighbours(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(600, 16))
    x[300:340] = x[0]  # a third of the queries' neighbourhoods are copies
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    bad = [(1000, None), (1100, [0.0] * 16), (1200, [float("nan")] * 16), (1300, [1.0, None] * 8), (1400, [1.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = {}
    for row in ann.self_search(df).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    assert sorted(got) == [0, 100, 200, 300, 400, 500]
    found = total = 0
    for q, hits in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        order = [int(i) for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        assert [k for k, _, _ in sorted(hits)] == list(range(1, 11))
        assert all(abs(s - d[v]) < 1e-9 for _, v, s in hits)
        found += len({v for _, v, _ in hits} & set(order))
        total += 10
    assert found / total >= 0.9
    few = ann.self_search(df.where("vec_id in (0, 1, 2)")).orderBy("rank").collect()
    assert [row["rank"] for row in few] == [1, 2]


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return docs.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").select("doc_id", "text", "lang", "quality", "toxic").collect()


def held(doc_id, modulus, rest):
    return zlib.crc32(str(doc_id).encode()) % modulus == rest


def test_quality_accuracy(labelled):
    rows = labelled[::2]
    x = np.array([quality.statistics((r.text or "").encode()) for r in rows])
    y = np.array([r.quality for r in rows], float)
    out = np.array([held(r.doc_id, 5, 0) for r in rows])
    model = quality.Forest.fit(x[~out], y[~out])
    assert ((model.score(x[out]) >= quality.DECISION) == (y[out] == 1)).mean() >= 0.97
    assert quality.Forest.fit(x[:0], y[:0]).score(x[:2]).tolist() == [1.0, 1.0]
    assert len(quality.statistics(b"")) == len(quality.STATISTICS)


def test_language_accuracy(labelled):
    model = language_id.LanguageModel.train([(r.lang, r.text) for r in labelled[:1500] if not held(r.doc_id, 4, 2)])
    test = [r for r in labelled if held(r.doc_id, 4, 2)][:400]
    got = model.predict([r.text for r in test])
    assert np.mean([p[0] == r.lang for p, r in zip(got, test, strict=True)]) >= 0.98
    assert [p[0] for p in model.predict([None, "", "12 !"])] == ["und"] * 3
    en, de = (next(r.text for r in test if r.lang == x and len(r.text) > 800)[:800] for x in ("en", "de"))
    assert {x for x, _ in model.predict([en + " " + de])[0][2]} == {"en", "de"}
    assert language_id.LanguageModel.train([]).predict(["abc"])[0][0] == "und"


def test_toxicity_accuracy(labelled):
    rows = [r for r in labelled if r.lang == "en"][:1000]
    own = [r for r in rows if not held(r.doc_id, 3, 1)]
    model = toxicity.ConvNet().fit([r.text for r in own], np.array([r.toxic for r in own], np.float32), [r.lang for r in own])
    test = [r for r in rows if held(r.doc_id, 3, 1)]
    got = np.array([model.score(model.vectors([toxicity._features(w) for w in toxicity.words_of(r.text)])) for r in test]) >= toxicity.DECISION
    y = np.array([r.toxic for r in test]) == 1
    assert (got == y).mean() >= 0.93
    assert toxicity.ConvNet().fit([], np.zeros(0, np.float32), []).score(np.zeros((0, toxicity.DIM))) == 0.0


def test_classifiers_on_frames(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    always = F.lit(True)
    n = docs.count()
    assert quality.score(docs, quality.train(docs, labels, always)).where("score between 0 and 1").count() == n
    assert quality.keep_good(docs, quality.Forest(constant=1.0)).columns == docs.columns
    assert toxicity.score(docs, toxicity.train(docs, labels, always)).where("score between 0 and 1").count() == n
    assert language_id.identify(docs, language_id.train(docs, always)).count() == n
    empty = docs.limit(0)
    assert quality.score(empty, quality.train(empty, labels, always)).count() == 0
    assert toxicity.score(empty, toxicity.train(empty, labels.limit(0), always)).count() == 0
    assert language_id.identify(empty, language_id.train(empty, always)).count() == 0


def test_pipeline_shape(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "sentencepiece"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    source = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert 0 < len(out) <= len(source) and {r.doc_id for r in out} <= set(source)
    assert all(r.n_tokens == len(r.ids) for r in out)
    assert all(set(r.text.split("\n")) <= set(source[r.doc_id].split("\n")) or len(r.text) < len(source[r.doc_id]) for r in out)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
