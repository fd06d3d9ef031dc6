"""Table cells, scanned words and candidate rows.

Tables come as cells (table keys, row_no, col_no, text).  Roles of columns are votes, so a table is
one aggregate by column and one by table; rows of a table are never gathered in one place.  Null
cells count as empty; a table without votes has the default roles.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from finquill.operators.sequence import islands, merge_continuations

#: Rows of a table that are looked at for its header.
HEADER_ROWS = 3
#: Shares of the page's width: labels end, current values begin and end.
LABEL_END, CURRENT_FROM, CURRENT_TO = 54, 60, 77
# Words of label columns, and beginnings of labels that go on from the row above.
LABEL_WORDS = ("particular", "asset", "liabilit", "equity", "description")
CONTINUATIONS = ("- term", "-term", "term borrowings", "term provisions", "term loans", "enterprises")


def _year_vote(text: Column, year: Column) -> Column:
    four = year.cast("string")
    pattern = F.concat(F.lit(r"\b("), four, F.lit("|"), F.substring(four, 3, 2), F.lit(r")\b"))
    return F.regexp_like(text, pattern) | (text.contains("31st march") & F.contains(text, four))


def column_roles(cells: DataFrame, keys: list[str], current: Column, previous: Column) -> DataFrame:
    """current_col, previous_col, label_col and note_col (-1: none) of each table.

    The most votes of the first rows win, of equal ones the cell seen first.  Without a
    voted label column it is the one with most letters below the header (values' columns aside).
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    head = F.col("row_no") < HEADER_ROWS
    at = F.struct("row_no", "col_no")
    votes = {
        "cur": head & _year_vote(low, current),
        "prev": head & _year_vote(low, previous),
        "label": head & reduce(or_, [low.contains(w) for w in LABEL_WORDS]),
        "note": head & low.contains("note"),
    }
    letters = F.sum(F.when(~head, F.char_length(F.regexp_replace(low, r"[^\p{L}]", ""))).otherwise(0))
    counted = [F.count_if(v).alias(f"__n_{k}") for k, v in votes.items()] + [F.min(F.when(v, at)).alias(f"__at_{k}") for k, v in votes.items()]
    each = cells.groupBy(*keys, "col_no").agg(letters.alias("__letters"), *counted)

    def winner(k: str) -> Column:
        first = F.col(f"__at_{k}")
        return F.max_by("col_no", F.when(F.col(f"__n_{k}") > 0, F.struct(F.col(f"__n_{k}"), -first["row_no"], -first["col_no"])))

    one = each.groupBy(*keys).agg(*[winner(k).alias(f"__{k}") for k in votes], (F.max("col_no") + 1).alias("__width"), F.collect_list(F.struct(F.col("__letters").alias("n"), (-F.col("col_no")).alias("c"))).alias("__by_letters"))
    now = F.coalesce("__cur", F.when(F.col("__width") > 1, 1).otherwise(0))
    last = F.coalesce("__prev", F.when(F.col("__width") > 2, 2).otherwise(-1))
    one = one.withColumn("current_col", now).withColumn("previous_col", last)
    free = F.filter("__by_letters", lambda x: (-x["c"] != F.col("current_col")) & (-x["c"] != F.col("previous_col")))
    most = F.coalesce(-F.array_max(free)["c"], F.lit(0))
    return one.select(*keys, "current_col", "previous_col", F.coalesce("__label", most).alias("label_col"), F.coalesce("__note", F.lit(-1)).alias("note_col"))


def candidates(cells: DataFrame, roles: DataFrame, keys: list[str], is_header: Column) -> DataFrame:
    """(keys, row_no, label, note, current_value, previous_value) of table rows with a label and a value.

    Header rows, of which a cell satisfies ``is_header``, are left out.
    """
    rows = cells.join(roles, keys)

    def of(role: str) -> Column:
        return F.max(F.when(F.col("col_no") == F.col(role), F.nullif(F.trim("text"), F.lit(""))))

    wide = rows.groupBy(*keys, "row_no").agg(of("label_col").alias("label"), of("note_col").alias("note"), of("current_col").alias("current_value"), of("previous_col").alias("previous_value"), F.max(is_header.cast("int")).alias("__head"))
    return wide.where("__head = 0 and label is not null and coalesce(current_value, previous_value) is not null").drop("__head")


def prose_candidates(lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """(keys, label, current_value, previous_value) of lines that end in one or two amounts."""
    amount = r"(\(?-?\d[\d,]*(?:\.\d+)?\)?)"
    two, one = rf"^(.*?[A-Za-z].*?)\s+{amount}\s+{amount}\s*$", rf"^(.*?[A-Za-z].*?)\s+{amount}\s*$"
    text = F.col(line)
    rows = lines.select(*keys, text.alias("__line")).where(F.col("__line").rlike(one))
    pair = F.col("__line").rlike(two)

    def part(k: int) -> Column:
        return F.when(pair, F.regexp_extract("__line", two, k)).otherwise(F.regexp_extract("__line", one, k) if k < 3 else F.lit(None))

    return rows.select(*keys, F.trim(part(1)).alias("label"), part(2).alias("current_value"), part(3).alias("previous_value"))


def align_labels(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, at, k, label, value): values of rows after a jammed label cell with its labels one by one.

    ``rows`` has labels (array or null) and vals (array).  A running count numbers the label
    cells, a running sum of values points at the label; values beyond the labels have none.
    """
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    opened = rows.withColumn("__cell", F.sum((F.size(F.coalesce("labels", F.array().cast("array<string>"))) > 0).cast("int")).over(w))
    inner = Window.partitionBy(*keys, "__cell").orderBy(at)
    before = F.coalesce(F.sum(F.size("vals")).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = F.first("labels", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0))
    each = opened.withColumn("__before", before).withColumn("__known", known).where("__cell > 0")
    each = each.select(*keys, at, "__before", "__known", F.posexplode("vals").alias("k", "value"))
    return each.select(*keys, at, "k", F.get("__known", (F.col("__before") + F.col("k")).cast("int")).alias("label"), "value")


def usable_words(words: DataFrame, least: int = 40) -> DataFrame:
    return words.where((F.col("conf") >= least) & (F.trim("text") != ""))


def scanned_rows(words: DataFrame, keys: list[str], gap: float = 10) -> DataFrame:
    """(keys, row_group, label, current_text, previous_text, raw) of words (top, left, x_pct, text): rows by jumps in height, columns by place."""
    grouped = islands(words, keys, ["top", "left"], "top", gap)

    def joined(which: Column) -> Column:
        kept = F.filter(F.array_sort(F.collect_list(F.struct("left", "x_pct", "text"))), lambda x: which_of(which, x))
        return F.array_join(F.transform(kept, lambda x: x["text"]), " ")

    def which_of(which, x):
        return which(x["x_pct"])

    return grouped.groupBy(*keys, "row_group").agg(
        joined(lambda p: p < LABEL_END).alias("label"),
        joined(lambda p: (p >= CURRENT_FROM) & (p <= CURRENT_TO)).alias("current_text"),
        joined(lambda p: p > CURRENT_TO).alias("previous_text"),
        joined(lambda p: F.lit(True)).alias("raw"),
    )


def joined_rows(rows: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Rows with a continuation joined to the one above: labels and raw lines together, values of the second first."""
    w = Window.partitionBy(*keys).orderBy(at)
    low, above = F.lower(F.trim("label")), F.lag(F.lower(F.trim("label"))).over(w)
    goes_on = reduce(or_, [low.startswith(p) for p in CONTINUATIONS]) | (above.isin("long", "short") & (low.startswith("-") | low.startswith("term")))
    marked = merge_continuations(rows, keys, [at], above.isNotNull() & goes_on)
    after = {c: F.lead(c).over(w) for c in ("consumed", "label", "current_text", "previous_text", "raw")}
    pair = F.coalesce(after["consumed"], F.lit(False))
    marked = marked.withColumn("__pair", pair).withColumns({f"__{c}": v for c, v in after.items() if c != "consumed"})

    def both(c: str) -> Column:
        return F.when(F.col("__pair"), F.trim(F.concat_ws(" ", c, f"__{c}"))).otherwise(F.col(c)).alias(c)

    def second(c: str) -> Column:
        return F.when(F.col("__pair"), F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")), F.col(c))).otherwise(F.col(c)).alias(c)

    return marked.where("not consumed").select(*keys, at, both("label"), second("current_text"), second("previous_text"), both("raw"))
