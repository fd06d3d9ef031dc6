"""The opN_ queries themselves: every column against the library, SQL or a plain computation."""

import hashlib
import zlib

import duckdb
import pytest

pytest.importorskip("finquill.llm")

from finquill.llm import pii  # noqa: E402
from finquill.llm.queries import ORACLE_SQL, QUERIES  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_sentencepiece_digests(spark, texts):
    sentencepiece, public_tokenizers = pytest.importorskip("sentencepiece"), pytest.importorskip("public_tokenizers")
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = QUERIES["op10_sentencepiece"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = sp.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_pii_digests(spark, texts):
    for r in QUERIES["op6_pii"](spark, DATA).collect():
        found = sorted((s[0], s[2], s[1]) for s in pii.find(texts[r.doc_id]))
        base = [(s, pii.BASE.index(k), e) for s, k, e in found if k in pii.BASE]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(b[1] == k for b in base) for k in range(4))
        assert r.base_sha256 == sha(",".join(f"{pii.BASE[k]}:{s}:{e}" for s, k, e in sorted(base)))
        assert len(r.spans.split(",") if r.spans else []) == len(found)


def test_decontamination_digests(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    want = c.sql(ORACLE_SQL["op7_decontamination"])
    got = QUERIES["op7_decontamination"](spark, DATA)
    assert sorted(tuple(r[x] for x in want.columns) for r in got.collect()) == sorted(want.fetchall())


def test_predictions(spark, texts):
    for name, modulus, rest, cut in (("op3_quality", 5, 0, 0.3), ("op1_toxicity", 3, 1, 0.7)):
        rows = QUERIES[name](spark, DATA).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest)
            assert 0 <= r.score <= 1 and r.predicted == (r.score >= cut)
