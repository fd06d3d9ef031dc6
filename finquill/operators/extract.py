"""Fields from candidate rows: hints, the rule extractor, normalised entries, a second pass, injection.

Catalogues (fields, terms) are tables of their own; candidates meet them by containment, looked up
by rare parts of the terms (see ``containment``).  Null labels match nothing; entries without a value are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finquill.operators.containment import both_ways
from finquill.sources.steps import written

FIRST_BATCH, SECOND_BATCH = 4, 8
HINTS = 5
# Texts that stand for no value.
NO_VALUE = ("", "null", "None", "N/A", "NA", "-")
_FLOAT = r"^-?(\d+\.?\d*|\.\d+)$"


def known_fields(extraction: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Rows of (section, field) pairs that the catalogue has."""
    return extraction.join(catalogue.select("section", "field").distinct(), ["section", "field"], "left_semi")


def catalogue_by_section(catalogue: DataFrame) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "field"))), lambda x: x["field"])
    return catalogue.groupBy("section").agg(F.count("*").alias("n_fields"), ordered.alias("fields"))


def batches(catalogue: DataFrame, size: int = FIRST_BATCH) -> DataFrame:
    """batch (from 0) of each field: ``size`` fields of a section in their order."""
    place = F.row_number().over(Window.partitionBy("section").orderBy("ord"))
    return catalogue.withColumn("batch", F.floor((place - 1) / size).cast("int"))


def known_terms(*tables: DataFrame) -> DataFrame:
    """Distinct lower-case terms of all tables (field, term)."""
    out = tables[0].select(F.lower(F.trim("term")).alias("term"))
    for t in tables[1:]:
        out = out.unionByName(t.select(F.lower(F.trim("term")).alias("term")))
    return out.where("term <> ''").distinct()


def entity_terms(base: DataFrame, overlay: DataFrame, entity: str) -> DataFrame:
    """Terms of all companies and those of one kind of company, as a bag (a term listed twice counts twice)."""
    return base.select("field", "term").unionByName(overlay.where(F.col("entity_type") == entity).select("field", "term"))


def matched(candidates: DataFrame, terms: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """candidates with the fields of which a term is in the label or the label is in a term; only ``pages`` (doc, page) if given."""
    rows = candidates if pages is None else candidates.join(pages.select("doc", "page").distinct(), ["doc", "page"], "left_semi")
    return rows.withColumn("__label", F.lower("label")).join(label_fields(rows, terms, ["field"]), "__label").drop("__label").distinct()


def label_fields(candidates: DataFrame, terms: DataFrame, what: list[str]) -> DataFrame:
    """(__label, what ...) of candidates' labels in lower case with what the terms say that they contain or are in."""
    known = terms.select(*what, F.lower("term").alias("__term")).distinct()
    return both_ways(candidates.select(F.lower("label").alias("__label")), "__label", known, "__term").join(known, "__term").select("__label", *what).distinct()


def hints(candidates: DataFrame, terms: DataFrame, pages: DataFrame | None = None, limit: int = HINTS) -> DataFrame:
    """The first ``limit`` different matches (label and values) of each document and field, numbered in candidate order."""
    same = ["doc", "field", "label", "current_value", "previous_value"]
    one = matched(candidates, terms, pages).groupBy(*same).agg(F.min(F.struct("pos", "page")).alias("__first"))
    place = F.row_number().over(Window.partitionBy("doc", "field").orderBy("__first.pos", "label", "current_value", "previous_value"))
    return one.withColumn("place", place).where(F.col("place") <= limit).select(*same, F.col("__first.page").alias("page"), F.col("__first.pos").alias("pos"), "place")


def hint_text(hinted: DataFrame) -> DataFrame:
    """A text of each document's and field's hints."""
    line = F.format_string("  - Label: %s | Current: %s | Previous: %s (Page %d)", "label", F.coalesce("current_value", F.lit("None")), F.coalesce("previous_value", F.lit("None")), "page")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"])
    return hinted.groupBy("doc", "field").agg(F.concat(F.lit("Field '"), F.first("field"), F.lit("' matches in table:\n"), F.array_join(listed, "\n")).alias("hints"))


def bare_number(text: Column) -> Column:
    """What is left of digits, points and minus signs, if it is a number."""
    s = F.regexp_replace(text, r"[^\d.\-]", "")
    return F.when(s.rlike(_FLOAT), s.try_cast("double"))


def from_hints(hinted: DataFrame) -> DataFrame:
    """The rule extractor: the first hint of a field gives its values, with confidence 0.95."""
    best = hinted.where("place = 1")
    return best.select("doc", "field", bare_number(F.col("current_value")).alias("current"), bare_number(F.col("previous_value")).alias("previous"), F.lit(0.95).alias("confidence"), F.col("label").alias("evidence"), "page")


def normalised(value: Column, confidence: Column) -> Column:
    """The number of an entry: sums of amounts are added, other signs dropped, words for nothing are null.

    Parenthesised amounts are negative.  A 0 without any confidence is no value.
    """
    s = F.trim(value)
    sums = s.rlike(r"^[\d\s.+\-*/()]+$") & s.contains("+") & ~s.contains("*") & ~s.contains("/")
    parts = F.filter(F.transform(F.split(s, r"\+"), lambda p: F.regexp_replace(p, r"[^\d.\-]", "")), lambda p: p != "")
    total = F.aggregate(F.transform(parts, lambda p: F.when(p.rlike(_FLOAT), p.try_cast("double"))), F.lit(0.0), lambda a, x: a + x)
    single = bare_number(s)
    signed = F.when(s.rlike(r"^\(.*\)$") & (single > 0), -single).otherwise(single)
    number = F.when(s.isin(*NO_VALUE), None).when(sums, F.coalesce(total, signed)).otherwise(signed)
    return F.when(~((number == 0) & (F.coalesce(confidence, F.lit(0.0)) == 0)), number)


def entries(raw: DataFrame) -> DataFrame:
    """(keys ..., value, confidence with two decimals, evidence of at most 300 characters); a missing entry says so."""
    out = raw.withColumn("value", normalised(F.col("value"), F.col("confidence")))
    out = out.withColumn("evidence", F.when(F.col("evidence").isNull() & F.col("confidence").isNull(), "not extracted").otherwise(F.substring(F.coalesce("evidence", F.lit("")), 1, 300)))
    return out.withColumn("confidence", F.round(F.coalesce("confidence", F.lit(0.0)), 2))


def null_fields(wide: DataFrame) -> DataFrame:
    """Fields without a value in either year."""
    return wide.groupBy("doc", "field").agg(F.max(F.coalesce("current", "previous").isNotNull().cast("int")).alias("__has")).where("__has = 0").select("doc", "field")


def second_pass(first: DataFrame, second: DataFrame) -> DataFrame:
    """Values of the second pass where the first has none in either year; others stay, whatever the confidences."""
    new = second.select("doc", "field", F.col("current").alias("__c"), F.col("previous").alias("__p"))
    both = first.join(new, ["doc", "field"], "left")
    empty = F.col("current").isNull() & F.col("previous").isNull()
    return both.select("doc", "field", F.when(empty, F.col("__c")).otherwise(F.col("current")).alias("current"), F.when(empty, F.col("__p")).otherwise(F.col("previous")).alias("previous"), (empty & F.coalesce("__c", "__p").isNotNull()).alias("from_second"))


def extracted(candidates: DataFrame, terms: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Every document and field of the catalogue with the rule extractor's values (null: not found)."""
    frame = candidates.select("doc").distinct().join(catalogue.select("field").distinct())
    return frame.join(from_hints(hints(candidates, terms)), ["doc", "field"], "left")


def coverage(wide: DataFrame) -> DataFrame:
    """Found fields of each document, all fields, and their share in percent with one decimal."""
    return wide.groupBy("doc").agg(F.count_if(F.coalesce("current", "previous").isNotNull()).alias("found"), F.count("*").alias("total")).withColumn("coverage", F.round(F.col("found") * 100.0 / F.col("total"), 1))


def strict_amount(text: Column) -> Column:
    """An amount with decimals; note numbers, zeros and whole numbers are none; 772,16 is read as 772.16."""
    s = F.trim(text)
    negative = s.startswith("(") & s.endswith(")")
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"^[()]+|[()]+$", ""), " ", ""), r"^[^0-9]+", "")
    comma = bare.contains(",") & ~bare.contains(".")
    spelled = F.when(comma & bare.rlike(r",\d{2}$"), F.replace(bare, F.lit(","), F.lit("."))).otherwise(F.replace(bare, F.lit(","), F.lit("")))
    value = F.when(spelled.rlike(r"^\d*\.\d*$") & spelled.rlike(r"\d"), spelled.try_cast("double"))
    return F.when(value != 0, F.when(negative, -value).otherwise(value))


def amounts_in(text: Column) -> Column:
    """All amounts with decimals of a line."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\d,]+\.\d+"), F.lit(0))
    return F.filter(F.transform(found, strict_amount), lambda v: v.isNotNull())


def without_amounts(text: Column) -> Column:
    """The label of a line: amounts, pipes and a closing dash go, spaces are single."""
    s = F.regexp_replace(F.regexp_replace(text, r"\([\d,]+\.?\d*\)", " "), r"[\d,]+\.?\d*", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\|", " "), r"\s+-\s*$", " "), r"\s+", " "))


def synonym_lines(synonyms: DataFrame, fields: list[str]) -> DataFrame:
    """Synonyms of the fields asked for: those of which the name is in a field or a field is in the name."""
    name = F.lower("name")
    asked = F.array(*[F.lit(f.lower()) for f in fields])
    return synonyms.where(F.exists(asked, lambda f: F.contains(name, f) | F.contains(f, name)))


def entity_context(documents: DataFrame, guides: DataFrame) -> DataFrame:
    """A document's kind of company with the guide for it, and the uploader's notes if there are some."""
    rows = documents.join(guides, "entity_type", "left")
    notes = F.when(F.trim("notes") != "", F.concat(F.lit("Notes: "), F.trim("notes")))
    return rows.select("doc", F.concat_ws("\n", F.concat(F.lit("Entity type: "), "entity_type"), "guide", notes).alias("context"))


def old_matches(rows: DataFrame, aliases: DataFrame, score: Column, least: float = 72, best: int = 5) -> DataFrame:
    """field of each row: of its ``best`` aliases by ``score`` (at least ``least``) the first that isn't excluded; the first row wins a field.

    Labels with the word asset never are deferred tax liabilities.  ``aliases`` is a short catalogue; ``score``
    is of label and alias.  Each distinct label is compared once, whatever the rows; the pairs that
    count are written (``steps.clear`` deletes them), so Spark knows their true size before it deals rows by label.
    """
    alike = rows.select("label").distinct().join(aliases).withColumn("score", score).where(F.col("score") >= least)
    alike = written(alike.withColumnRenamed("label", "__label"), "label-scores")
    met = rows.join(alike, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
    met = met.withColumn("__place", F.row_number().over(Window.partitionBy("doc", "pos").orderBy(F.desc("score"), "field"))).where(F.col("__place") <= best)
    excluded = F.lower("label").contains("asset") & (F.col("field") == "Deferred Tax Liabilities")
    one = met.where(~excluded).withColumn("__first", F.row_number().over(Window.partitionBy("doc", "pos").orderBy("__place"))).where("__first = 1")
    return one.withColumn("__row", F.row_number().over(Window.partitionBy("doc", "field").orderBy("pos"))).where("__row = 1").drop("__place", "__first", "__row")


# ---- injection into sheet rows --------------------------------------------
def year_keys(year: int) -> list[str]:
    """Spellings under which a year's value may stand, in order."""
    short = str(year % 100).zfill(2)
    return [short, str(year), f"{year - 1}-{short}", f"{year - 1}-{year}"]


def moved(formula: Column, source: str, target: str) -> Column:
    """References to column ``source`` moved to ``target``."""
    return F.regexp_replace(formula, rf"\b{source}(\d+)\b", f"{target}$1")


def injected(sheet_map: DataFrame, values: DataFrame, overrides: DataFrame, year: int, formulas: DataFrame, source: str, target: str) -> DataFrame:
    """(row_no, value, formula, origin) of all rows: override, configured formula, value (first spelling of
    the year that has one), default; overrides of rows outside the map; formulas copied for all other rows.
    """
    keys = F.array(*[F.lit(k) for k in year_keys(year)])
    found = values.where("value is not null").withColumn("__k", F.array_position(keys, F.col("year_key"))).where("__k > 0")
    best = found.groupBy("section", "field").agg(F.min_by("value", "__k").alias("__value"))
    mapped = sheet_map.join(best, ["section", "field"], "left").withColumn("__mapped", F.lit(True))
    rows = mapped.join(overrides.select("row_no", F.col("value").alias("__override")), "row_no", "full_outer").join(formulas.select("row_no", F.col("formula").alias("__copied")), "row_no", "full_outer")
    handled = F.coalesce("__mapped", F.lit(False)) | F.col("__override").isNotNull()
    origin = F.when(F.col("__override").isNotNull(), "override").when(F.col("formula").isNotNull(), "formula").when(F.col("__value").isNotNull(), "value").when(F.col("default").isNotNull(), "default").when(~handled & F.col("__copied").isNotNull(), "copied")
    rows = rows.withColumn("origin", origin)
    formula = F.when(F.col("origin") == "formula", F.col("formula")).when(F.col("origin") == "copied", F.col("__copied"))
    value = F.when(F.col("origin").isin("override", "value", "default"), F.coalesce("__override", "__value", "default"))
    return rows.where("origin is not null").select("row_no", value.alias("value"), moved(formula, source, target).alias("formula"), "origin")
