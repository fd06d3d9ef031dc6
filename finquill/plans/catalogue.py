"""Named queries over the driver tables, each with the SQL that gives the same rows.

Q holds the callables, SQL the statements; the names match.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from finquill.functions import scalars
from finquill.operators import derive, merge, quality, report, sequence, text
from finquill.plans.named import SQL, Q, query  # noqa: F401
from finquill.plans.statement import FY_SQL, ST, load, statement

YEARS = ["1995-96", "1996-97", "1997-98"]


# ---- yearly tables, growth and projections --------------------------------
_PIVOT = ", ".join(f"round(max(CASE WHEN fy = '{fy}' THEN net_sales END), 2) AS fy_{fy.replace('-', '_')}" for fy in YEARS)


@query(f"{ST} SELECT company, {_PIVOT} FROM st GROUP BY company")
def fy_revenue_pivot(spark, sf):
    st = statement(spark, sf, ["net_sales"])
    return st.groupBy("company").agg(*[F.round(F.max(F.when(F.col("fy") == fy, F.col("net_sales"))), 2).alias(f"fy_{fy.replace('-', '_')}") for fy in YEARS])


@query(f"{ST}, l AS (SELECT company, fy, net_sales AS value, lag(net_sales) OVER (PARTITION BY company ORDER BY fy) AS b FROM st) SELECT company, fy, value, round((value - b) / nullif(abs(b), 0), 4) AS growth FROM l")
def sales_growth(spark, sf):
    return report.growth_by_year(statement(spark, sf, ["net_sales"]).withColumnRenamed("net_sales", "value"), ["company"])


_VEC = f"{ST}, v AS (SELECT company, {', '.join(f'max(CASE WHEN fy = {chr(39)}{fy}{chr(39)} THEN {{f}} END) AS v{k}' for k, fy in enumerate(YEARS, 1))} FROM st GROUP BY company)"
_RATE = ", r AS (SELECT *, CASE WHEN v1 <> 0 AND v2 <> 0 THEN (v2 - v1) / abs(v1) END AS a, CASE WHEN v2 <> 0 AND v3 <> 0 THEN (v3 - v2) / abs(v2) END AS b FROM v)"
_GROWTH = "coalesce((coalesce(a, 0) + coalesce(b, 0)) / nullif(CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT), 0), 0.1)"
_PROJECT = ", g AS (SELECT *, greatest(-0.5, least({g}, {hi})) AS growth, coalesce(nullif(v3, 0), nullif(v2, 0), nullif(v1, 0), 0) AS base FROM r), p AS (SELECT *, round(base * (1 + growth), 4) AS p1 FROM g) SELECT company, round(growth, 6) AS growth, p1, round(p1 * (1 + growth), 4) AS p2 FROM p"


def _vector(spark, sf, field):
    return report.year_vector(statement(spark, sf, [field]).select("company", "fy", F.col(field).alias("value")), ["company"], YEARS)


@query(_VEC.replace("{f}", "net_sales") + _RATE + _PROJECT.replace("{g}", _GROWTH).replace("{hi}", "0.5"))
def avg_growth_projection(spark, sf):
    return report.project(_vector(spark, sf, "net_sales")).select("company", F.round("growth", 6).alias("growth"), "p1", "p2")


@query(_VEC.replace("{f}", "term_liabilities") + _RATE + _PROJECT.replace("{g}", _GROWTH).replace("{hi}", "0.0"))
def declining_projection(spark, sf):
    return report.project_declining(_vector(spark, sf, "term_liabilities")).select("company", F.round("growth", 6).alias("growth"), "p1", "p2")


@query(
    f"{ST}, v AS (SELECT company, "
    + ", ".join(f"max(CASE WHEN fy = '{fy}' THEN cost_of_sales END) AS v{k}, max(CASE WHEN fy = '{fy}' THEN net_sales END) AS s{k}" for k, fy in enumerate(YEARS, 1))
    + " FROM st GROUP BY company), p AS (SELECT company, v1 / nullif(s1, 0) AS a, v2 / nullif(s2, 0) AS b, v3 / nullif(s3, 0) AS c, s3 FROM v), q AS (SELECT company, s3, coalesce((coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif(CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT) + CAST(c IS NOT NULL AS INT), 0), 0) AS share FROM p) SELECT company, round(share, 6) AS share, round(share * s3 * 1.1, 2) AS p1, round(share * s3 * 1.21, 2) AS p2 FROM q"
)
def ratio_projection(spark, sf):
    st = statement(spark, sf, ["cost_of_sales", "net_sales"])
    cells = [F.max(F.when(F.col("fy") == fy, F.col(c))).alias(f"{a}{k}") for k, fy in enumerate(YEARS, 1) for a, c in (("v", "cost_of_sales"), ("s", "net_sales"))]
    out = report.project_by_share(st.groupBy("company").agg(*cells).withColumn("sp1", F.col("s3") * 1.1).withColumn("sp2", F.col("s3") * 1.21))
    return out.select("company", F.round("share", 6).alias("share"), F.round(F.col("share") * F.col("s3") * 1.1, 2).alias("p1"), F.round(F.col("share") * F.col("s3") * 1.21, 2).alias("p2"))


@query(f"SELECT DISTINCT {FY_SQL.format('o_orderdate')} AS fy FROM orders")
def financial_years(spark, sf):
    return merge.financial_years(load(spark, sf, "orders").select(scalars.fy_label(F.col("o_orderdate")).alias("fy")))


# ---- merging --------------------------------------------------------------
# an order is a document, its customer the company, its priority the field; it is primary for its own year
_CAND = (
    "SELECT o_custkey AS company, o_orderpriority AS field, o_orderkey AS doc_ord, o_totalprice AS value, "
    "CAST(o_orderkey % 7 AS DOUBLE) / 10 AS confidence, o_orderkey % 3 = 0 AS is_primary, " + FY_SQL.format("o_orderdate") + " AS fy FROM orders"
)


def _candidates(spark, sf):
    o = load(spark, sf, "orders")
    return o.select(
        F.col("o_custkey").alias("company"), F.col("o_orderpriority").alias("field"), F.col("o_orderkey").alias("doc_ord"), F.col("o_totalprice").alias("value"),
        ((F.col("o_orderkey") % 7).cast("double") / 10).alias("confidence"), (F.col("o_orderkey") % 3 == 0).alias("is_primary"), scalars.fy_label(F.col("o_orderdate")).alias("fy"),
    )


_BEST = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company, field, fy ORDER BY is_primary DESC, confidence DESC, doc_ord) AS r FROM ({_CAND})) WHERE r = 1)"


@query(f"SELECT company, field, fy, value, confidence, doc_ord, is_primary FROM {_BEST}")
def merge_best_of_documents(spark, sf):
    return merge.best_of_documents(_candidates(spark, sf), ["company", "field", "fy"])


@query(f"WITH m AS {_BEST} SELECT c.company, y.fy, f.field, m.value, m.doc_ord FROM (SELECT DISTINCT company FROM ({_CAND})) c CROSS JOIN (SELECT DISTINCT fy FROM ({_CAND})) y CROSS JOIN (SELECT DISTINCT field FROM ({_CAND})) f LEFT JOIN m ON m.company = c.company AND m.fy = y.fy AND m.field = f.field")
def merge_scaffold(spark, sf):
    c = _candidates(spark, sf)
    out = merge.scaffold(merge.best_of_documents(c, ["company", "field", "fy"]), c.select("field").distinct(), c.select("company").distinct(), c.select("fy").distinct())
    return out.select("company", "fy", "field", "value", "doc_ord")


@query(f"WITH m AS {_BEST} SELECT f.company, count(m.value) AS found, count(*) AS total, round(count(m.value) * 100.0 / count(*), 1) AS coverage FROM (SELECT c.company, y.fy, f.field FROM (SELECT DISTINCT company FROM ({_CAND})) c CROSS JOIN (SELECT DISTINCT fy FROM ({_CAND})) y CROSS JOIN (SELECT DISTINCT field FROM ({_CAND})) f) f LEFT JOIN m ON m.company = f.company AND m.fy = f.fy AND m.field = f.field GROUP BY f.company")
def coverage(spark, sf):
    full = merge_scaffold(spark, sf)
    return full.groupBy("company").agg(F.count("value").alias("found"), F.count("*").alias("total")).withColumn("coverage", F.round(F.col("found") * 100.0 / F.col("total"), 1))


_CHUNKS = "SELECT l_partkey AS field, l_orderkey * 10 + l_linenumber AS chunk_ord, max(l_extendedprice) AS value, max(l_discount) * 10 AS confidence FROM lineitem GROUP BY l_partkey, l_orderkey, l_linenumber"


@query(f"SELECT field, value, confidence, chunk_ord FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY confidence DESC, chunk_ord) AS r FROM ({_CHUNKS}) WHERE confidence > 0) WHERE r = 1")
def chunk_best_value(spark, sf):
    rows = load(spark, sf, "lineitem").groupBy("l_partkey", "l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("value"), (F.max("l_discount") * 10).alias("confidence"))
    rows = rows.select(F.col("l_partkey").alias("field"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_ord"), "value", "confidence")
    return merge.best_of_chunks(rows, ["field"])


# ---- derived measures and report sections ---------------------------------
_DERIVED = [t for t, _ in derive.LEVELS]
_STEPS = ST + "".join(
    f", d{k} AS (SELECT *, {derive.to_sql(f)} AS {t} FROM {'st' if k == 0 else f'd{k - 1}'})" for k, (t, f) in enumerate(derive.LEVELS)
)


@query(_STEPS + " SELECT company, fy, " + ", ".join(f"round({t}, 4) AS {t}" for t in _DERIVED) + f" FROM d{len(_DERIVED) - 1}")
def derived_measures(spark, sf):
    return derive.derive(statement(spark, sf)).select("company", "fy", *[F.round(t, 4).alias(t) for t in _DERIVED])


@query(_STEPS + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT company, fy, '{t}' AS field, round(CAST({t} AS DOUBLE), 4) AS value FROM d{len(_DERIVED) - 1}" for t in _DERIVED) + ")")
def derived_long(spark, sf):
    wide = derive.derive(statement(spark, sf)).select("company", "fy", *[F.round(F.col(t).cast("double"), 4).alias(t) for t in _DERIVED])
    return derive.to_long(wide, ["company", "fy"], _DERIVED)


def _section_query(name: str, public: str):
    def run(spark, sf):
        return report.section(statement(spark, sf), name)

    run.__name__ = public
    query(f"{ST} {report.section_sql(name)}")(run)


for _name, _public in (("operating", "report_cascade"), ("liabilities", "liabilities"), ("assets", "assets"), ("working_capital", "working_capital"), ("fund_flow", "fund_flow"), ("break_even", "break_even"), ("dscr", "dscr"), ("ratios", "ratio_analysis"), ("indicators", "key_indicators")):
    _section_query(_name, _public)


# ---- data quality ---------------------------------------------------------
@query(f"{ST}, x AS (SELECT company, fy, round(abs(total_assets - (current_liabilities + term_liabilities + (capital + reserves))) / nullif(abs(current_liabilities + term_liabilities + (capital + reserves)), 0), 4) AS diff FROM st) SELECT company, fy, diff, CASE WHEN diff > 0.05 THEN 'high' WHEN diff > 0.02 THEN 'medium' ELSE 'passed' END AS severity FROM x")
def accounting_identity(spark, sf):
    return quality.accounting_identity(statement(spark, sf).withColumn("net_worth", F.col("capital") + F.col("reserves")))


@query(f"{ST} SELECT company, fy, -net_sales AS net_sales FROM st WHERE company >= 'NATION_2' AND net_sales > 0")
def sign_check(spark, sf):
    return quality.sign_check(statement(spark, sf).withColumn("net_sales", F.expr("case when company < 'NATION_2' then net_sales else -net_sales end")))


@query(f"{ST}, x AS (SELECT company, fy, CASE WHEN company > 'NATION_5' THEN -pbt ELSE pbt END AS pbt, CASE WHEN company < 'NATION_15' THEN pbt * 1.2 ELSE pat END AS pat FROM st) SELECT company, fy, CASE WHEN pbt < 0 THEN 'loss_but_pat' ELSE 'pat_above_pbt' END AS finding FROM x WHERE (pbt < 0 AND pat > 0) OR (pbt > 0 AND pat > 1.1 * pbt)")
def pbt_pat_check(spark, sf):
    st = statement(spark, sf, ["pbt", "pat"]).withColumn("pat", F.expr("case when company < 'NATION_15' then pbt * 1.2D else pat end"))
    return quality.profit_consistency(st.withColumn("pbt", F.expr("case when company > 'NATION_5' then -pbt else pbt end")))


@query(f"{ST}, x AS (SELECT company, fy, greatest(net_sales, total_assets) / (net_sales / CASE WHEN company < 'NATION_2' THEN 20000 ELSE 2 END) AS spread FROM st) SELECT company, fy, round(spread, 2) AS spread FROM x WHERE spread > 10000")
def unit_outlier(spark, sf):
    st = statement(spark, sf, ["net_sales", "total_assets"]).withColumn("capital", F.expr("net_sales / case when company < 'NATION_2' then 20000 else 2 end"))
    return quality.unit_spread(st, ["net_sales", "total_assets", "capital"])


@query(f"SELECT company, field, fy, doc_ord, confidence FROM {_BEST} WHERE confidence < 0.75")
def low_confidence(spark, sf):
    found = merge.best_of_documents(_candidates(spark, sf), ["company", "field", "fy"])
    return quality.low_confidence(found).select("company", "field", "fy", "doc_ord", "confidence")


_LINES = "SELECT l_orderkey, sum(CAST(round(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100) AS BIGINT)) AS cents, count(*) AS n FROM lineitem GROUP BY l_orderkey"


@query(f"SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) - cents AS diff_cents FROM orders JOIN ({_LINES}) ON o_orderkey = l_orderkey WHERE abs(CAST(round(o_totalprice * 100) AS BIGINT) - cents) > 100")
def invoice_amount_check(spark, sf):
    line = F.expr("cast(round(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100) as bigint)")
    sums = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(line).alias("cents"))
    out = load(spark, sf, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey"))
    return out.select("o_orderkey", (F.expr("cast(round(o_totalprice * 100) as bigint)") - F.col("cents")).alias("diff_cents")).where("abs(diff_cents) > 100")


@query("SELECT l_suppkey, l_quantity, l_discount, CAST(r AS INT) AS repeat_no FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_quantity, l_discount ORDER BY l_orderkey) AS r FROM lineitem) WHERE r > 1")
def duplicate_line_items(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_discount", "l_orderkey")
    return quality.repeated_rows(rows, ["l_suppkey", "l_quantity", "l_discount"], ["l_orderkey"]).drop("l_orderkey")


@query("SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS repeat_no FROM lineitem) WHERE repeat_no > 1")
def repeated_line_numbers(spark, sf):
    rows = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return quality.repeated_rows(rows, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])


# events of a user are a bank statement; every 50th balance is wrong by 5.00
_BANK = """b0 AS (SELECT user_id, event_id, row_number() OVER w AS idx, CASE WHEN event_id % 2 = 0 THEN CAST(round(value * 100) AS BIGINT) ELSE 0 END AS credit,
    CASE WHEN event_id % 2 = 0 THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END AS debit FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    bank AS (SELECT user_id, idx, credit, debit, sum(credit - debit) OVER (PARTITION BY user_id ORDER BY idx) + CASE WHEN event_id % 50 = 0 THEN 500 ELSE 0 END AS balance FROM b0)"""


def _bank(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    cents = F.round(F.col("value") * 100).cast("bigint")
    even = F.col("event_id") % 2 == 0
    rows = load(spark, sf, "events").select("user_id", "ts", "event_id", F.when(even, cents).otherwise(0).alias("credit"), F.when(even, 0).otherwise(cents).alias("debit"))
    rows = rows.withColumn("idx", F.row_number().over(w)).withColumn("balance", F.sum(F.col("credit") - F.col("debit")).over(w) + F.when(F.col("event_id") % 50 == 0, 500).otherwise(0))
    return rows.select("user_id", "idx", "credit", "debit", "balance")


@query(f"WITH {_BANK}, p AS (SELECT *, lag(balance) OVER w + credit - debit AS up, lag(balance) OVER w - lag(credit) OVER w + lag(debit) OVER w AS down FROM bank WINDOW w AS (PARTITION BY user_id ORDER BY idx)), v AS (SELECT *, coalesce(sum(CAST(abs(balance - up) <= 100 AS INT)) OVER (PARTITION BY user_id), 0) >= coalesce(sum(CAST(abs(balance - down) <= 100 AS INT)) OVER (PARTITION BY user_id), 0) AS ascending FROM p) SELECT user_id, CAST(idx AS INT) AS idx, CAST(balance AS BIGINT) AS balance, CAST(CASE WHEN ascending THEN up ELSE down END AS BIGINT) AS expected, ascending FROM v WHERE CASE WHEN ascending THEN abs(balance - up) > 100 ELSE abs(balance - down) > 100 END")
def bank_balance_progression(spark, sf):
    return quality.balance_progression(_bank(spark, sf), "user_id")


@query(f"WITH {_BANK} SELECT user_id, CAST(sum(debit) AS BIGINT) AS debits, CAST(sum(credit) AS BIGINT) AS credits, CAST(arg_max(balance, idx) AS BIGINT) AS closing FROM bank GROUP BY user_id")
def bank_summary(spark, sf):
    return _bank(spark, sf).groupBy("user_id").agg(F.sum("debit").alias("debits"), F.sum("credit").alias("credits"), F.max_by("balance", "idx").alias("closing"))


@query("SELECT o_orderkey AS doc_id, CAST(least(CASE WHEN o_totalprice IS NOT NULL THEN 0.95 ELSE 0.0 END, CASE WHEN o_orderkey % 4 = 0 THEN 0.4 ELSE 1.0 END) AS DOUBLE) AS confidence FROM orders")
def field_confidence(spark, sf):
    o = load(spark, sf, "orders")
    values = o.select(F.col("o_orderkey").alias("doc_id"), F.lit("total").alias("field"), F.col("o_totalprice").cast("string").alias("value"))
    issues = o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("doc_id"), F.lit("total").alias("field"), F.lit(0.4).alias("confidence"))
    return quality.field_confidence(values, issues).select("doc_id", "confidence")


@query("SELECT 'c_acctbal' AS field, count(*) FILTER (c_acctbal IS NULL OR c_acctbal < 0) AS missing FROM customer UNION ALL SELECT 'c_mktsegment', count(*) FILTER (c_mktsegment IS NULL OR trim(c_mktsegment) = '') FROM customer")
def required_fields(spark, sf):
    c = load(spark, sf, "customer")
    wide = c.agg(F.count_if(F.col("c_acctbal").isNull() | (F.col("c_acctbal") < 0)).alias("c_acctbal"), F.count_if(F.col("c_mktsegment").isNull() | (F.trim("c_mktsegment") == "")).alias("c_mktsegment"))
    return wide.unpivot([], ["c_acctbal", "c_mktsegment"], "field", "missing")


# ---- order-sensitive ------------------------------------------------------
@query("WITH s AS (SELECT user_id, event_id, CAST(CASE WHEN abs(epoch(ts) - lag(epoch(ts)) OVER w) > 86400 THEN 1 ELSE 0 END AS INT) AS st, ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, CAST(sum(st) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS row_group FROM s")
def row_grouping_islands(spark, sf):
    e = load(spark, sf, "events").select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return sequence.islands(e, ["user_id"], ["ts", "event_id"], "at", 86_400_000_000).select("user_id", "event_id", "row_group")


@query("WITH s AS (SELECT user_id, event_id, ts, sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events) SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - 1) % 2 = 1 AS consumed FROM s")
def continuation_merge(spark, sf):
    e = load(spark, sf, "events").select("user_id", "event_id", "ts", "event_type")
    return sequence.merge_continuations(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view").select("user_id", "event_id", "consumed")


@query("SELECT p.event_id, (SELECT max_by(s.event_id, (s.ts, s.event_id)) FROM events s WHERE s.event_type = 'signup' AND s.user_id = p.user_id AND s.ts <= p.ts) AS last_note FROM events p WHERE p.event_type = 'purchase'")
def active_note_asof(spark, sf):
    e = load(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    notes = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("note"))
    return sequence.as_of(e.where("event_type = 'purchase'").select("user_id", "ts", "event_id"), notes, ["user_id"], "ts", "note").select("event_id", "last_note")


@query("SELECT DISTINCT l_orderkey, o_orderkey, a - b AS diff FROM (SELECT l_orderkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS a FROM lineitem) JOIN (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS b FROM orders) ON a > b - 5 AND a < b + 5")
def near_value_match(spark, sf):
    a = load(spark, sf, "lineitem").select("l_orderkey", F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("a"))
    b = load(spark, sf, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("b"))
    return sequence.band_differences(a, b, ["l_orderkey", "o_orderkey"], "a", "b", 5)


@query("SELECT conv_id, turn, role FROM (SELECT *, turn >= 3 AND turn <= 5 AS i, max(CAST(turn >= 3 AND turn <= 5 AS INT)) OVER (PARTITION BY conv_id) AS y FROM conversations) WHERE i OR y = 0")
def page_trim_fallback(spark, sf):
    return sequence.trim_range(load(spark, sf, "conversations"), ["conv_id"], "turn", F.lit(3), F.lit(5)).select("conv_id", "turn", "role")


# ---- texts ----------------------------------------------------------------
_CHUNKED = "(SELECT doc_id, i AS chunk_idx, substr(text, i * 4500 + 1, 6000) AS chunk, n FROM (SELECT doc_id, text, CAST(greatest(1, ceil((length(text) - 6000) / 4500.0) + 1) AS BIGINT) AS n, unnest(range(CAST(greatest(1, ceil((length(text) - 6000) / 4500.0) + 1) AS BIGINT))) AS i FROM documents))"


def _chunked(spark, sf):
    return text.chunks(load(spark, sf, "documents").select("doc_id", "text"))


@query(f"SELECT doc_id, CAST(chunk_idx AS INT) AS chunk_idx, length(chunk) AS n_chars, sha256(chunk) AS sha FROM {_CHUNKED}")
def chunk_windows(spark, sf):
    return _chunked(spark, sf).select("doc_id", "chunk_idx", F.char_length("chunk").cast("bigint").alias("n_chars"), F.sha2("chunk", 256).alias("sha"))


_WORDS = ["license", "released", "copyright", "work", "terms", "the", "einer", "para", "dans", "license"]
_SCORE = "least(100, 8 * (" + " + ".join(f"CAST(contains(lower(chunk), '{w}') AS INT)" for w in _WORDS) + "))"


@query(f"SELECT doc_id, CAST(chunk_idx AS INT) AS chunk_idx, {_SCORE} AS score FROM {_CHUNKED}")
def section_relevance(spark, sf):
    return _chunked(spark, sf).select("doc_id", "chunk_idx", text.relevance(F.col("chunk"), _WORDS).alias("score"))


@query(f"SELECT doc_id, CAST(chunk_idx AS INT) AS chunk_idx, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, chunk_idx) AS r FROM (SELECT doc_id, chunk_idx, {_SCORE} AS score FROM {_CHUNKED}) WHERE score > 0) WHERE r <= 3")
def topk_chunks(spark, sf):
    return text.top_chunks(section_relevance(spark, sf), ["doc_id"], 3)


@query(f"SELECT c.doc_id, CAST(c.chunk_idx AS INT) AS chunk_idx FROM {_CHUNKED} c WHERE c.n <= 2 OR EXISTS (SELECT 1 FROM range(2) t(i) WHERE c.chunk_idx = t.i * c.n // 2)")
def spread_fallback(spark, sf):
    rows = _chunked(spark, sf).select("doc_id", "chunk_idx")
    n = rows.groupBy("doc_id").agg(F.count("*").alias("n"))
    return text.spread(rows.join(n, "doc_id"), ["doc_id"], "chunk_idx", F.col("n"), 2).select("doc_id", "chunk_idx")


def _sql_hits(column: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains(lower({column}), '{w.replace(chr(39), chr(39) * 2)}') AS INT)" for w in words) + ")"


_KIND = "SELECT conv_id, turn, s, kind FROM (SELECT conv_id, turn, s, kind, row_number() OVER (PARTITION BY conv_id, turn, text ORDER BY s DESC, o) AS r FROM (" + " UNION ALL ".join(
    f"SELECT conv_id, turn, text, {k} AS o, '{name}' AS kind, {_sql_hits('text', words)} AS s FROM conversations" for k, (name, words) in enumerate(text.DOCUMENT_WORDS.items())
) + ")) WHERE r = 1"


@query(f"SELECT conv_id, turn, CASE WHEN s >= 2 THEN kind ELSE 'unknown' END AS kind, CAST(CASE WHEN s >= 2 THEN round(least(0.95, 0.55 + 0.1 * s), 2) ELSE 0.2 END AS DOUBLE) AS confidence FROM ({_KIND})")
def doc_type_classify(spark, sf):
    kind, confidence = text.document_kind(F.col("text"))
    return load(spark, sf, "conversations").select("conv_id", "turn", kind.alias("kind"), confidence.cast("double").alias("confidence"))


@query(f"SELECT page_id, {_sql_hits('html', text.REJECTED_PAGES)} > 0 AND {_sql_hits('html', text.STATEMENT_WORDS)} = 0 AS rejected, contains(lower(html), 'nicht') AND NOT contains(lower(html), 'dans') AS german FROM pages")
def page_reject(spark, sf):
    return load(spark, sf, "pages").select("page_id", text.is_rejected_page(F.col("html")).alias("rejected"), text.is_rejected_page(F.col("html"), ["nicht"], ["dans"]).alias("german"))


@query("SELECT doc_id, CASE WHEN contains(lower(text), 'crore') THEN 'Crores' WHEN contains(lower(text), 'thousand') THEN 'Thousands' ELSE 'Lakhs' END AS unit FROM documents")
def unit_detect(spark, sf):
    return load(spark, sf, "documents").select("doc_id", text.unit(F.col("text")).alias("unit"))


@query("WITH y AS (SELECT o_custkey, year(o_orderdate) AS year, count(*) AS n, min(o_orderkey) AS seen FROM orders GROUP BY ALL) SELECT o_custkey, CAST(year AS INT) AS year, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, seen) AS r FROM y) WHERE r = 1")
def fy_mode(spark, sf):
    found = load(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("seen"))
    return text.year_mode(found, ["o_custkey"])


@query("WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), y AS (SELECT doc_id, l, list_position(list_transform(l, lambda s: contains(lower(s), 'license')), true) AS p FROM x) SELECT doc_id, CAST(p AS INT) AS line_no, array_to_string(l[greatest(1, p - 2):p + 3], chr(10)) AS snippet FROM y WHERE p > 0")
def field_snippets(spark, sf):
    lines = load(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return text.snippets(lines, "license").select("doc_id", "line_no", "snippet")


@query("SELECT lower(trim(p_name)) AS label, min(p_partkey) AS p_partkey FROM part WHERE trim(p_name) <> '' GROUP BY 1")
def first_labels(spark, sf):
    rows = merge.first_of_labels(load(spark, sf, "part").select("p_partkey", F.col("p_name").alias("label")), [], ["p_partkey"])
    return rows.select(F.lower(F.trim("label")).alias("label"), "p_partkey")


# ---- scalar functions -----------------------------------------------------
@query(r"SELECT c_custkey, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(c_name)), '[^\p{L}\p{N}_\s-]', '', 'g'), '[\s_]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'unknown-company') AS slug FROM customer")
def slugify(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", scalars.slugify(F.col("c_name")).alias("slug"))


@query("SELECT sha256(text) AS sha, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def content_dedup(spark, sf):
    return load(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


@query("SELECT doc_id, substr(sha256(lang || '|' || CAST(n_chars AS VARCHAR) || '|None|' || source), 1, 16) AS fingerprint FROM documents")
def fingerprint(spark, sf):
    return load(spark, sf, "documents").select("doc_id", scalars.fingerprint(F.col("lang"), F.col("n_chars"), F.lit(None), F.col("source")).alias("fingerprint"))


@query(r"SELECT doc_id, len(list_filter(list_transform(regexp_split_to_array(trim(text, chr(32) || chr(10) || chr(9)), '\s+'), lambda t: regexp_replace(t, '[,.;:]+$', '')), lambda t: regexp_matches(t, '^(\(?[-–—]?\d[\d,.]*\)?%?|[-–—])$'))) AS n_tokens FROM documents")
def numeric_tokens(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.size(scalars.numeric_tokens(F.col("text"))).cast("bigint").alias("n_tokens"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN -o_totalprice ELSE o_totalprice END AS amount FROM orders")
def amount_parse(spark, sf):
    price = F.col("o_totalprice")
    shown = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("("), F.format_number(price, 2), F.lit(")"))).otherwise(F.concat(F.lit("₹ "), F.format_number(price, 2)))
    return load(spark, sf, "orders").select("o_orderkey", scalars.parse_amount(shown).alias("amount"))


@query("SELECT o_orderkey, o_orderkey % 4 <> 3 AS valid FROM orders")
def date_validity(spark, sf):
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    shown = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.date_format(d, "MMM dd, yyyy")).otherwise(F.date_format(d, "yyyy-'13'-dd"))
    return load(spark, sf, "orders").select("o_orderkey", scalars.is_date(shown).alias("valid"))


@query("SELECT c_custkey, c_mktsegment IN ('INR', 'USD') OR length(c_mktsegment) <= 4 AS segment_ok, c_custkey % 2 = 0 AS code_ok FROM customer")
def currency_validity(spark, sf):
    code = F.when(F.col("c_custkey") % 2 == 0, "usd").otherwise("XYZ12")
    return load(spark, sf, "customer").select("c_custkey", scalars.is_currency(F.col("c_mktsegment")).alias("segment_ok"), scalars.is_currency(code).alias("code_ok"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf):
    return load(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


# ---- registry, jobs, costs, audit, injection ------------------------------
@query("SELECT source AS company_slug, count(*) AS n_documents, sum(n_chars) AS size_bytes, sum(count(*)) OVER () AS total_documents FROM documents GROUP BY source")
def registry_listing(spark, sf):
    from finquill.operators.registry import listing

    docs = load(spark, sf, "documents").select(F.col("source").alias("company_slug"), "doc_id", F.col("n_chars").alias("size_bytes"))
    return listing(docs)


@query("SELECT user_id, count(*) FILTER (event_type = 'purchase') AS progress, count(*) AS total, CAST(round(count(*) FILTER (event_type = 'purchase') * 100.0 / greatest(count(*), 1)) AS INT) AS percent FROM events GROUP BY user_id")
def job_progress(spark, sf):
    from finquill.operators.registry import percent

    jobs = load(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("progress"), F.count("*").alias("total"))
    return jobs.withColumn("percent", percent(F.col("progress"), F.col("total")))


@query("WITH j AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'running' ELSE 'failed' END AS status, event_id % 2 = 0 AS same FROM events) SELECT user_id, min(event_id) AS job_id FROM j WHERE status = 'running' OR (status = 'done' AND same) GROUP BY user_id")
def job_reuse(spark, sf):
    from finquill.operators.registry import reusable

    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "signup", "running").otherwise("failed")
    ids = F.when(F.col("event_id") % 2 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a")))
    jobs = load(spark, sf, "events").select("user_id", F.col("event_id").alias("job_id"), status.alias("status"), ids.alias("doc_ids"))
    return reusable(jobs, "user_id", ["a", "b"])


@query("WITH p AS (SELECT source, CAST(greatest(0, ceil(n_chars / 3000.0)) AS BIGINT) AS pages FROM documents) SELECT source, sum(pages) AS pages, round((sum(pages) * 1700 * 0.15 + sum(pages) * 900 * 0.6) / 1000000, 4) AS ocr_cost, round((count(*) * 190 * 1800 * 2.5 + count(*) * 190 * 350 * 10.0) / 1000000, 4) AS extraction_cost FROM p GROUP BY source")
def cost_estimate(spark, sf):
    from finquill.operators.registry import cost

    docs = load(spark, sf, "documents").select("source", F.greatest(F.lit(0), F.ceil(F.col("n_chars") / 3000.0)).cast("bigint").alias("pages"))
    return cost(docs, ["source"], (0.15, 0.60), (2.50, 10.00))


@query("WITH x AS (SELECT o_orderpriority, CASE WHEN abs(d) <= 5 THEN 'VERIFIED' WHEN abs(d) <= 10000 THEN 'ROUNDING_MISMATCH' ELSE 'NOT_FOUND' END AS status FROM (SELECT o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) - cents AS d FROM orders JOIN (" + _LINES + ") ON o_orderkey = l_orderkey)) SELECT status, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS share FROM x GROUP BY status")
def audit_status(spark, sf):
    from finquill.operators.registry import audit_shares

    line = F.expr("cast(round(l_extendedprice * (1 - l_discount) * (1 + l_tax) * 100) as bigint)")
    sums = load(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(line).alias("cents"))
    d = F.abs(F.round(F.col("o_totalprice") * 100).cast("bigint") - F.col("cents"))
    status = F.when(d <= 5, "VERIFIED").when(d <= 10_000, "ROUNDING_MISMATCH").otherwise("NOT_FOUND")
    return audit_shares(load(spark, sf, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey")).select(status.alias("status")))


@query("SELECT n_nationkey AS row_no, CAST(CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey * 10 WHEN s.v IS NOT NULL THEN s.v ELSE 0 END AS DOUBLE) AS value, CASE WHEN n_nationkey % 5 = 0 THEN 'override' WHEN s.v IS NOT NULL THEN 'value' ELSE 'default' END AS origin FROM nation LEFT JOIN (SELECT s_nationkey, CAST(count(*) AS DOUBLE) AS v FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey")
def sheet_injection(spark, sf):
    from finquill.operators.registry import inject

    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("row_no"))
    values = load(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("row_no")).agg(F.count("*").cast("double").alias("value"))
    overrides = n.where("row_no % 5 = 0").select("row_no", (F.col("row_no") * 10).cast("double").alias("override"))
    return inject(n.withColumn("default", F.lit(0.0)), values, overrides)


# ---- procedural corner: no SQL --------------------------------------------
@query()
def json_repair(spark, sf):
    from finquill.functions.procedural import repair_json

    broken = load(spark, sf, "events").select("event_id", F.expr("substring(props, 1, length(props) - 1)").alias("raw"))
    return broken.select("event_id", repair_json("raw").alias("json")).select("event_id", "json", F.get_json_object("json", "$.k").alias("k"))


@query()
def html_tables(spark, sf):
    from finquill.functions.procedural import html_cells

    listed = load(spark, sf, "pages").select("page_id", F.regexp_replace(F.regexp_replace(F.regexp_extract("html", r"(?s)<nav>(.*?)</nav>", 1), "<ul>|</ul>", ""), r"<li>(.*?)</li>", "<tr><td rowspan=\"2\">$1</td></tr>").alias("rows"))
    return html_cells(listed.select("page_id", F.concat(F.lit("<table>"), "rows", F.lit("</table>")).alias("html")), "page_id")


@query()
def fuzzy_match(spark, sf):
    from finquill.functions.procedural import token_set_ratio

    p = load(spark, sf, "part").select("p_partkey", "p_name")
    aliases = F.explode(F.array(F.lit("green part"), F.lit("small red part"))).alias("alias")
    return p.select("p_partkey", "p_name", aliases).select("p_partkey", "alias", token_set_ratio("p_name", "alias").alias("score")).where("score >= 72")


@query()
def note_references(spark, sf):
    from finquill.functions.procedural import note_refs

    from finquill.plans.paging import pages

    found = pages(spark, sf).select("page", note_refs("text").alias("refs"))
    return found.select("page", F.explode("refs").alias("r")).select("page", "r.note", "r.at", "r.context")


@query()
def jammed_labels(spark, sf):
    from finquill.functions.procedural import split_labels

    pairs = load(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit(" Trade Receivables "), "n_name", F.lit(" Other Non Current Assets Total Income")).alias("cell"))
    return pairs.select("n_nationkey", split_labels("cell").alias("labels")).select("n_nationkey", F.posexplode("labels").alias("at", "label"))


