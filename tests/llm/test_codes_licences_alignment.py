"""Vector codes, licence scans and alignment of tokenizers against plain computations, and their edge cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

pytest.importorskip("finquill.llm")

from pyspark.sql import functions as F  # noqa: E402

from finquill.llm import alignment, licences, vector_codes  # noqa: E402
from finquill.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a\n\n b", "a \n \nb", "x\t y", "\n", "a\x1c b\x1c  c", "tab\there", "it's we'll 12345 x1y2", "▁", "a▁b", "Ünï 中文字符 😀😀", "<|endoftext|> and </s> <s>",
    "  nbsp  em", "x" * 3000, "中" * 2000, "a\r\n  b\r\n", "ends with newline\n", "\x00 \x01", "é combining", "repeated repeated repeated", "مرحبا بالعالم",
]


# -- vector codes ---------------------------------------------------------------------------
def plain_codes(rows, parts, entries, rounds):
    kept = [(i, [min(max(math.floor(256 * c), -(10**9)), 10**9) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dims]
    edges = [dims * p // parts for p in range(parts + 1)]
    books = [[v[a:b] for _, v in kept[:entries]] for a, b in zip(edges, edges[1:])]

    def nearest(book, q):
        return min((sum((x - y) ** 2 for x, y in zip(q, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        new = []
        for p, book in enumerate(books):
            groups = defaultdict(list)
            for _, v in kept:
                groups[nearest(book, v[edges[p] : edges[p + 1]])[1]].append(v[edges[p] : edges[p + 1]])
            new.append([[sum(c) // len(groups[k]) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(book)])
        books = new
    out = [(i, *zip(*[nearest(book, v[edges[p] : edges[p + 1]])[::-1] for p, book in enumerate(books)])) for i, v in kept]
    return sorted(((i if i is not None else -1, list(c), sum(d)) for i, c, d in out), key=str), books


@pytest.mark.parametrize("dims", [16, 21, 5])
def test_codes_against_plain(spark, dims):
    r = random.Random(dims)
    rows = [(i, [r.choice([r.gauss(0, 1), 0.0, -0.5]) for _ in range(dims)]) for i in range(120)]
    rows += [(3, [0.25] * dims), (3, [0.25] * dims), (None, [1.0] * dims), (500, None), (501, [float("nan")] * dims), (502, [None] * dims), (503, [float("inf")] + [0.0] * (dims - 1)), (504, []), (505, [1.0] * (dims + 1)), (7, [3e5] * dims)]
    df = spark.createDataFrame([(i, v, i and i % 3) for i, v in rows], "vec_id long, embedding array<float>, label int")
    vectors = vector_codes.kept(df)
    books = vector_codes.learn(vectors, 8, 10, 2)
    want, plain = plain_codes([(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows], 8, 10, 2)
    got = vector_codes.encode(vectors, books).collect()
    assert sorted(((x.vec_id if x.vec_id is not None else -1, x.codes, x.error) for x in got), key=str) == want
    assert [b.tolist() for b in books.parts] == plain
    sums = defaultdict(int)
    for x in got:
        sums[x.label] += x.error
    assert all(x.label_error == sums[x.label] for x in vector_codes.with_label_error(vector_codes.encode(vectors, books)).collect())
    assert vector_codes.decode(got[0].codes, books).shape == (dims,)


def test_codes_of_nothing(spark):
    none = spark.createDataFrame([(1, None, "x")], "vec_id long, embedding array<double>, label string")
    vectors = vector_codes.kept(none)
    assert vector_codes.learn(vectors) is None and vector_codes.with_label_error(vector_codes.encode(vectors, None)).count() == 0


def test_cells_bound_distances():
    r = np.random.default_rng(2)
    entries, queries = r.integers(-300, 300, (64, 4)), r.integers(-400, 400, (500, 4))
    entry, distance = vector_codes.Cells(entries).nearest(queries)
    exact = ((queries[:, None] - entries[None]) ** 2).sum(2)
    assert (entry == exact.argmin(1)).all() and (distance == exact.min(1)).all()


def test_code_query_against_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{DATA}/embeddings.parquet')")
    want = c.sql(ORACLE_SQL["op11_vector_codes"])
    got = QUERIES["op11_vector_codes"](spark, DATA)
    assert sorted(tuple(r[x] for x in want.columns) for r in got.collect()) == sorted(want.fetchall())


# -- licences ---------------------------------------------------------------------------------
def test_licence_query_against_plain(spark):
    word, lower = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op12_licences"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        words = word.findall((texts[r.doc_id] or "").translate(lower))
        hits = sorted((i, label) for p, label in licences.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        want = (len(words), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(sorted({x for _, x in hits})))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


@pytest.mark.parametrize(
    ("line", "valid", "labels", "level"),
    [
        ("MIT", True, ["mit"], 0),
        ("(MIT OR Apache-2.0) AND GPL-2.0-or-later", True, ["apache", "gpl", "mit"], 2),
        ("MIT or GPL-3.0-only and LGPL-2.1", True, ["gpl", "lgpl", "mit"], 0),
        ("GPL-2.0+ WITH Classpath-exception-2.0 */", True, ["gpl"], 1),
        ("MIT/Apache-2.0", True, ["apache", "mit"], 0),
        ("LicenseRef-Own", True, [], 3),
        ("(MIT", False, ["mit"], 3),
        ("AND MIT", False, ["mit"], 3),
        ("MIT OR", True, ["mit"], 0),
        ("MIT see the file", True, ["mit"], 0),
        ("((MIT))", True, ["mit"], 0),
        ("()", False, [], 3),
    ],
)
def test_expressions(line, valid, labels, level):
    found = licences.scan(f"// SPDX-License-Identifier: {line}\nMIT\n".encode())
    (e,) = found.expressions
    assert (e.valid, sorted(e.labels), e.level) == (valid, labels, level)


def test_notices():
    def labels(text):
        return sorted(licences.scan(text.encode()).labels)

    assert labels("Licensed under CC BY-NC 4.0.") == ["cc-by-nc"]  # the longer notice alone
    assert labels("the GNU Lesser General Public License") == ["gpl", "lgpl"]  # base places always count
    assert labels("license: see the file") == [] and labels("License: MIT") == ["mit"]
    long = licences.scan(("mit license " * 50_000).encode())
    assert len(long.base) == 50_000 and long.base[-1] == (99_998, "mit") and long.score == pytest.approx(0.7)
    deep = licences.scan(("SPDX-License-Identifier: " + "(" * 20_000 + "MIT" + ")" * 20_000).encode())
    assert deep.expressions[0].valid and deep.labels == {"mit"}


def test_licences_of_odd_rows(spark):
    df = spark.createDataFrame([(None, "MIT License", 1), (1, None, 2), (1, "", 3), (2, "mit-license é MIT\nLicense", 4), (2, "mit-license é MIT\nLicense", 4)], "doc_id long, text string, labels int")
    got = sorted(((r.doc_id or 0, r.n_words, [b.word for b in r.base], r.labels) for r in licences.licence_scan(df).collect()), key=str)
    assert got == sorted([(0, 2, [0], ["mit"]), (1, 0, [], []), (1, 0, [], []), *[(2, 5, [0, 3], ["mit"])] * 2], key=str)
    assert licences.licence_scan(df.limit(0)).count() == 0


# -- alignment ---------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def libraries():
    tokenizers, sentencepiece, public = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    a = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    return a, b, public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")


def plain_alignment(text, a, b):
    """Ids of both sides, groups and links by walking through the text's bytes."""
    sign = alignment._byte_of_sign()
    want = (" " + (text or "")).encode()
    x = a.encode(want.decode(), add_special_tokens=False).ids
    y = b.encode(text or "")
    xs = [bytes(sign[c] for c in a.id_to_token(i)) for i in x]
    ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    if not text or b"".join(xs) != want or b"".join(ys) != want:
        return 0, 0, 0, [], ""
    ends_x, ends_y = np.cumsum([len(t) for t in xs]).tolist(), np.cumsum([len(t) for t in ys]).tolist()
    links, groups, i, j, i0, j0 = [], [], 0, 0, 0, 0
    while i < len(x):
        links.append((x[i], y[j]))
        e, f = ends_x[i], ends_y[j]
        i, j = i + (e <= f), j + (f <= e)
        if e == f:
            groups.append(",".join(map(str, x[i0:i])) + "|" + ",".join(map(str, y[j0:j])))
            i0, j0 = i, j
    return len(x), len(y), len(groups), links, ";".join(groups)


def check(got, texts, a, b):
    plain = {k: plain_alignment(t, a, b) for k, t in texts.items()}
    counts = Counter(p for v in plain.values() for p in set(v[3]))
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    assert len(got) == len(plain)
    for r in got:
        n_a, n_b, n_groups, links, groups = plain[r.doc_id]
        want = (n_a, n_b, n_groups, len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links))
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == want, texts[r.doc_id]
        assert r.groups == groups


@pytest.mark.parametrize("frequent", [1 << 20, 5])
def test_alignment_of_odd_texts(spark, libraries, monkeypatch, frequent):
    a, b, a_path, b_path = libraries
    monkeypatch.setattr(alignment, "FREQUENT", frequent)  # the rare pairs' join is as exact
    r = random.Random(4)
    bits = [" ", "  ", "\n", "\t", " ", "\x1c", "the", "Hello", "中", "😀", "é", "12", "'s", ".", "▁", "zqx"]
    texts = dict(enumerate([*ODD, *("".join(r.choice(bits) for _ in range(r.randint(1, 40))) for _ in range(150))]))
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, _row string").repartition(3)
    check(alignment.with_counts(alignment.align(alignment.tokenise(df, a_path, b_path))).collect(), texts, a, b)


def test_alignment_query(spark, libraries):
    a, b, *_ = libraries
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["op13_alignment"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n_a, n_b, n_groups, links, groups = plain_alignment(texts[r.doc_id], a, b)
        assert (r.n_a, r.n_b, r.n_groups, r.n_links) == (n_a, n_b, n_groups, len(links))
        assert r.groups_sha256 == (hashlib.sha256(groups.encode()).hexdigest() if n_a else "")


def test_alignment_of_no_rows_and_repeated_ids(spark, libraries):
    *_, a_path, b_path = libraries
    df = spark.createDataFrame([(1, "the cat"), (1, "the cat"), (1, "other"), (None, "the cat"), (2, None)], "doc_id long, text string")
    rows = alignment.with_counts(alignment.align(alignment.tokenise(df, a_path, b_path))).collect()
    assert sorted((r.doc_id or 0, r.n_links, r.count_sum) for r in rows) == [(0, 2, 6), (1, 1, 1), (1, 2, 6), (1, 2, 6), (2, 0, 0)]
    assert alignment.with_counts(alignment.align(alignment.tokenise(df.where(F.lit(False)), a_path, b_path))).count() == 0


def test_small_memory_gives_the_same(libraries, monkeypatch):
    *_, a_path, b_path = libraries
    data = [open(p, "rb").read() for p in (a_path, b_path)]
    texts = [t for t in ODD if t] * 2
    whole = alignment.Pair(*data).tokenise(texts)
    monkeypatch.setattr(alignment, "LEARN", 3)
    monkeypatch.setattr(alignment, "MEMORY_PIECES", 1)
    pair = alignment.Pair(*data)
    pair.tokenise(texts[:5])
    again = pair.tokenise(texts)

    def of(out):
        pieces = [(tuple(out["a_ids"][i:j]), tuple(out["b_ids"][k:m])) for i, j, k, m in zip(np.r_[0, out["a_upto"][:-1]], out["a_upto"], np.r_[0, out["b_upto"][:-1]], out["b_upto"])]
        return [pieces[p] for p in out["pieces"]], out["upto"].tolist()

    assert of(whole) == of(again)


def test_pieces_are_read_by_place_and_cut_in_small_parts(spark, libraries, monkeypatch):
    a, b, a_path, b_path = libraries
    monkeypatch.setattr(alignment, "CUT", 7)
    texts = dict(enumerate([*ODD, "hello unbelievably hello", "a\u2581b", None, ""]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    tokens = alignment.tokenise(df, a_path, b_path)
    assert tokens.columns == ["docs", "items"]  # tokens of each distinct piece, not sliced from arrays of all pieces
    check(alignment.with_counts(alignment.align(tokens)).collect(), texts, a, b)
