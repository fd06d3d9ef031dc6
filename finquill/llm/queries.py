"""Queries opN_<name>: each applies its operator to a whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from finquill.llm.common import table, text_remainder


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finquill.llm.toxicity import DECISION, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, table(spark, sf_dir, "labels"), text_remainder(F.col("doc_id"), 3) != 1)
    return score(docs, model).select(
        "doc_id",
        F.coalesce(text_remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= DECISION).cast("int").alias("predicted"),
        "threshold",
        "flagged",
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finquill.llm.line_dedup import line_report

    out = line_report(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finquill.llm.quality import DECISION, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), text_remainder(F.col("doc_id"), 5) != 0)
    return score(docs, model).select(
        "doc_id",
        F.coalesce(text_remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= DECISION).cast("int").alias("predicted"),
    )


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finquill.llm.ann import self_search

    return self_search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finquill.llm.language_id import identify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, text_remainder(F.col("doc_id"), 4) != 2)
    return identify(docs, model).select(
        "doc_id",
        F.coalesce(text_remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        F.array_join(F.transform("mixture", lambda x: F.concat_ws(":", x["lang"], x["share"].cast("string"))), ",").alias("mixture"),
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finquill.llm.pii import BASE, pii_spans, spans_text

    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return pii_spans(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *map(count, BASE),
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(spans).alias("spans"),
        F.coalesce(F.array_max(F.transform(spans, lambda s: s["score"])), F.lit(0.0)).alias("top_score"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finquill.llm.decontamination import find_contamination

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    x = F.col("contamination")
    n_hit = F.aggregate(x["spans"], F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))
    return find_contamination(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        x["n_words"].alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(x["item_ids"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(x["item_ids"], ","), 256).alias("items_sha256"),
        (F.size(x["spans"]) > 0).alias("contaminated"),
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finquill.llm.warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finquill.llm.ngram_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from finquill.llm.sentencepiece_bpe import encode_decode

    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finquill.llm.vector_codes import encode, hex_code, kept, learn, with_label_error

    vectors = kept(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    books = learn(vectors)
    return with_label_error(encode(vectors, books)).select(
        "vec_id", hex_code(F.col("codes")).alias("code"), "error", "label_error", F.lit(books.sha256() if books else "").alias("codebooks_sha256")
    )


def op12_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from finquill.llm.licences import licence_scan

    places = F.transform("base", lambda b: b["word"])
    return licence_scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"]))), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
        F.size("expressions").cast("long").alias("n_expressions"),
        F.array_max(F.transform("expressions", lambda e: e["level"])).alias("level"),
    )


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from finquill.llm.alignment import align, tokenise, with_counts

    tokens = tokenise(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    return with_counts(align(tokens).withColumn("groups_sha256", digest).drop("groups"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality": op3_quality,
    "op4_nearest_neighbours": op4_nearest_neighbours,
    "op5_language_id": op5_language_id,
    "op6_pii": op6_pii,
    "op7_decontamination": op7_decontamination,
    "op8_warc": op8_warc,
    "op9_ngram_join": op9_ngram_join,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_vector_codes": op11_vector_codes,
    "op12_licences": op12_licences,
    "op13_alignment": op13_alignment,
}



def _codes_sql(rounds: int) -> str:
    """Codebooks, their rounds and the last assignment; ``b0`` to ``b{rounds}`` are the codebooks, ``a0`` on the assignments."""
    steps = ""
    for k in range(rounds + 1):
        steps += f"""
        d{k} AS (SELECT x.vec_id, x.label, x.part, b.entry, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN b{k} b USING (part, place) GROUP BY ALL),
        a{k} AS (SELECT vec_id, label, part, entry, d FROM d{k} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1),"""
        if k < rounds:
            steps += f"""
        m{k} AS (SELECT x.part, a.entry, x.place, CAST(floor(sum(x.v) / count(*)) AS BIGINT) AS v FROM x JOIN a{k} a USING (vec_id, part) GROUP BY ALL),
        b{k + 1} AS (SELECT b.part, b.entry, b.place, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (part, entry, place)),"""
    return f"""
        WITH kept AS (SELECT vec_id, label, embedding AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
        x AS (SELECT vec_id, label, (i - 1) // (n // 16) AS part, (i - 1) % (n // 16) AS place, CAST(floor(256 * CAST(e[i] AS DOUBLE)) AS BIGINT) AS v
            FROM (SELECT vec_id, label, e, len(e) AS n, unnest(range(1, len(e) + 1)) AS i FROM kept)),
        first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64),
        b0 AS (SELECT x.part, f.entry, x.place, x.v FROM x JOIN first f USING (vec_id)),{steps}
        codes AS (SELECT vec_id, label, string_agg(lower(lpad(hex(entry), 2, '0')), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY ALL)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, place)) FROM b{rounds}) AS codebooks_sha256
        FROM codes
    """


#: Where SQL can express the operator over whole tables.
ORACLE_SQL: dict[str, str] = {
    "op11_vector_codes": _codes_sql(rounds=2),
    "op8_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p),
        b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: (['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111',
            '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'])[strpos('0123456789abcdef', substr(hex, i, 1))]), '') AS bits FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
                16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
                + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT) AS INT), 1)), '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM b
    """,
    "op7_decontamination": """
        WITH bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
            FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM bw WHERE len(w) > 0)),
        dw AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        sizes AS (SELECT DISTINCT n FROM win),
        grams AS (SELECT rid, s.n, unnest(range(1, len(w) - s.n + 2)) AS i, w FROM dw, sizes s WHERE len(w) >= s.n),
        hits AS (SELECT DISTINCT x.rid, x.i, x.n, win.item_id FROM (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM grams) x JOIN win ON win.n = x.n AND win.g = x.g),
        words AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY rid),
        items AS (SELECT rid, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY rid)
        SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM dw LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
    """,
    "op9_ngram_join": """
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0))),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
        r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
        SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.a = w.doc_id GROUP BY w.doc_id
    """,
}
