"""Fuzzy line deduplication in DataFrame operations only.

1. Lines are normalised (trimmed, lower case) and named by a 128-bit hash.  Equal lines
   are grouped by partial aggregates that keep the first occurrence.
2. Pigeonhole blocks.  A line is cut into runs of whole words, from its start and from
   its end; each run's number and words make a block (see ``with_blocks``).  Two lines of
   which fewer words differ than there are blocks share one, wherever the changes are.
   Lines are joined on equal blocks.
3. In a block every line is compared with the smallest one.  Lines unlike it (strays) are
   also compared with the lines of the block that aren't in their group by then and are near
   by SimHash and length, each pair in one block only (see ``_meetings``); others can't join
   groups.  Before that, the groups of blocks of more
   than MEET lines are joined in rounds: the block, and what divides it (see ``with_parts``),
   compare all lines with one line after the other while that links something.  The rounds
   only save pairs within groups; what they miss is found by the comparisons after them.
4. SimHash.  Lines that meet get a 64-bit SimHash of all their words.  Pairs more than
   ``HAMMING`` bits apart aren't alike; the others are verified: 1 - edit distance /
   longer length must reach ``LIKE``.
5. Components of verified pairs and equal lines keep their first occurrence; other
   occurrences are removed.

Blocks are cut from the words, not from the SimHash: one changed word of twenty flips
about 8 of 64 bits, so blocks of SimHash bits that stay selective at 1e11 lines find a
third of the lines with one changed word only (figures in the README).

Edge cases: null texts have no lines and stay null; blank lines are never removed;
a document all of whose lines go keeps an empty text (``drop_lines`` can drop it);
rows that repeat a doc_id and a text are one document, rows of one doc_id with other
texts are documents of their own, ordered by a hash of the text; rows with a null
doc_id are left as they are; very long lines are whole; other columns are kept,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finquill.llm.common import cut, remove
from finquill.llm.components import components

LIKE = 0.8
#: SimHash bits in which lines that are alike may differ.
HAMMING = 20
#: Least words of a run, and runs from either end of a line.
SEGMENT = 4
RUNS = 4
#: Lines of up to so many words are also joined without one of them.
SHORT = 2 * SEGMENT
#: The filter of keys has 2**FILTER_BITS cells of 64 bits (some 10 MB in memory).
FILTER_BITS = 18
#: Lines of a block above which its groups are first joined in rounds.
MEET = 32
#: Least characters of a word that two lines are aligned by.
ANCHOR = 5
#: Bits of SimHash vote counters, for lines of few to very many words.
SLICES = (5, 7, 16)


def normalised(line: Column) -> Column:
    return F.lower(F.trim(line))


def with_simhash(lines: DataFrame, column: str = "line") -> DataFrame:
    """``lines`` with ``s``, the 64-bit SimHash of a line's distinct words, all of them.

    Votes are counted for all 64 bits at once with bit-sliced counters, of as many slices
    as the line's words need.  A line of 2**16 distinct words or more has no SimHash (null),
    which rules nothing out.
    """
    # hashed here, since a lambda's terms are worked out again wherever they occur
    hashes = F.transform(F.split(column, " "), lambda word: F.xxhash64(word))
    rows = lines.withColumn("_words", F.array_distinct(hashes)).withColumn("_n", F.size("_words"))

    def votes(slices: int) -> Column:
        def add(acc: Column, word: Column) -> Column:
            parts, carry = [], word
            for k in range(slices):
                parts.append(acc[f"c{k}"].bitwiseXOR(carry).alias(f"c{k}"))
                carry = carry.bitwiseAND(acc[f"c{k}"])
            return F.struct(*parts)

        zero = F.struct(*[F.lit(0).cast("long").alias(f"c{k}") for k in range(slices)])

        def majority(acc: Column) -> Column:
            # votes > half, for all bits at once: compare the sliced counters with n // 2
            half, more, same = F.floor(F.col("_n") / 2), F.lit(0).cast("long"), F.lit(-1).cast("long")
            for k in reversed(range(slices)):
                bit = -F.shiftright(half, k).bitwiseAND(F.lit(1).cast("long"))
                more = more.bitwiseOR(same.bitwiseAND(acc[f"c{k}"]).bitwiseAND(F.bitwise_not(bit)))
                same = same.bitwiseAND(F.bitwise_not(acc[f"c{k}"].bitwiseXOR(bit)))
            return more

        return F.aggregate("_words", zero, add, majority)

    s = None
    for slices in SLICES:
        fits = F.col("_n") < 1 << slices
        s = F.when(fits, votes(slices)) if s is None else s.when(fits, votes(slices))
    return rows.withColumn("s", s).drop("_words", "_n")


def _length_of(n: Column) -> Column:
    return F.greatest(F.lit(SEGMENT), F.call_function("shiftleft", F.lit(1), F.length(F.bin(n.cast("long"))) - 3))


def with_blocks(lines: DataFrame, column: str = "line") -> DataFrame:
    """``lines`` with the column blocks, an array of hashes.

    From 2 * SEGMENT words on: the first RUNS and the last RUNS runs of L words, numbered
    from their end; L is SEGMENT up to 31 words and doubles whenever the words do, so a
    line of 4 * SEGMENT words or more has at least RUNS runs.  A line whose words are
    just above a doubling also has the runs of half the length, so that a line some words
    shorter meets it.  Up to SHORT words: the line itself and the line without each word;
    of a word too long to be replaced as a whole, a half stays.

    Words and lengths are columns of their own, so that they are computed once.  Runs are cut
    at spaces; only short lines are split into words.
    """

    spaces = F.octet_length(column) - F.octet_length(F.replace(F.col(column), F.lit(" "), F.lit("")))
    rows = lines.withColumn("_n", spaces + 1).withColumn("_w", F.when(F.col("_n") <= SHORT, F.split(column, " ")))
    rows = rows.withColumn("_usual", _length_of(F.col("_n"))).withColumn("_less", _length_of(F.floor(F.col("_n") * LIKE)))
    w, n = F.col("_w"), F.col("_n")

    def upto(text: Column, words: Column) -> Column:
        return F.call_function("substring_index", text, F.lit(" "), words.cast("int"))

    keys = []
    for size, wanted in ((F.col("_usual"), F.lit(True)), (F.col("_less"), F.col("_less") != F.col("_usual"))):
        for k in range(RUNS):
            fit = wanted & (n >= 2 * SEGMENT) & (n >= size * (k + 1))
            keys.append(F.when(fit, F.xxhash64(F.lit(1), size, F.lit(k), upto(upto(F.col(column), size * (k + 1)), -size))))
            keys.append(F.when(fit, F.xxhash64(F.lit(2), size, F.lit(k), upto(upto(F.col(column), -size * (k + 1)), size))))

    def without(word: Column, i: Column) -> Column:
        def key(*instead: Column) -> Column:
            return F.xxhash64(F.lit(3), F.concat(F.slice(w, F.lit(1), i), F.array(*instead).cast("array<string>"), F.slice(w, i + 2, F.lit(SHORT))))

        m = F.char_length(word)
        # the halves of a word of m characters and of one of m - 1, so that one character may be new
        sizes = [F.floor(m / 2).cast("int"), F.floor((m - 1) / 2).cast("int")]
        halves = [key(F.concat(F.lit("\x01"), F.substring(word, F.lit(1), k))) for k in sizes]
        halves += [key(F.concat(F.lit("\x02"), F.substring(word, m - k + 1, k))) for k in (m - sizes[0], m - 1 - sizes[1])]
        return F.when(m <= F.char_length(F.col(column)) * (1 / LIKE - 1) + 1, F.array(key())).otherwise(F.array_distinct(F.array(*halves)))

    none = F.array().cast("array<bigint>")
    short = F.when(n <= SHORT, F.concat(F.array(F.xxhash64(F.lit(3), w)), F.flatten(F.transform(w, without)))).otherwise(none)
    rows = rows.withColumn("_runs", F.array(*keys)).withColumn("_short", short)
    return rows.withColumn("blocks", F.concat(F.array_compact("_runs"), "_short")).drop("_w", "_n", "_usual", "_less", "_runs", "_short")


def with_parts(lines: DataFrame, column: str = "line") -> DataFrame:
    """``lines`` with the column parts, an array of hashes that divide a block.

    Runs of half the length of ``with_blocks``, twice as many from either end, so lines that
    share a block and have fewer changed words than RUNS share some of them too; single words
    up to SHORT words.
    """
    rows = lines.withColumn("_w", F.split(column, " ")).withColumn("_n", F.size("_w"))
    rows = rows.withColumn("_usual", _length_of(F.col("_n"))).withColumn("_less", _length_of(F.floor(F.col("_n") * LIKE)))
    w, n = F.col("_w"), F.col("_n")
    keys = []
    for length, wanted in ((F.col("_usual"), F.lit(True)), (F.col("_less"), F.col("_less") != F.col("_usual"))):
        size = F.when(n <= SHORT, F.lit(1)).otherwise(F.shiftright(length, 1))
        for k in range(2 * RUNS):
            fit = wanted & (n >= size * (k + 1))
            keys.append(F.when(fit, F.xxhash64(F.lit(4), size, F.lit(k), F.slice(w, size * k + 1, size))))
            keys.append(F.when(fit, F.xxhash64(F.lit(5), size, F.lit(k), F.slice(w, n - size * (k + 1) + 1, size))))
    return rows.withColumn("parts", F.array_distinct(F.array_compact(F.array(*keys)))).drop("_w", "_n", "_usual", "_less")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, at, line) of every line that isn't blank, normalised; mark is a hash of the text."""
    rows = docs.where("doc_id is not null and text is not null")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    return rows.where(F.trim("raw") != "").select("doc_id", "mark", "at", normalised(F.col("raw")).alias("line"))


def _filter_of(keys: DataFrame) -> DataFrame:
    """A bit for each ``key``: (cell, bits), at most 2**FILTER_BITS rows, written."""
    cell, bit = _cell_and_bit()
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    return cut(keys.select(cell.alias("cell"), one.alias("bits")).groupBy("cell").agg(F.bit_or("bits").alias("bits")), "key-filter")


def _cell_and_bit() -> tuple[Column, Column]:
    h = F.xxhash64("key")
    return h.bitwiseAND(F.lit((1 << FILTER_BITS) - 1).cast("long")), F.shiftrightunsigned(h, FILTER_BITS).bitwiseAND(F.lit(63).cast("long")).cast("int")


def _maybe(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` may be marked: all that are, and few others while the filter isn't full.

    The filter has a fixed size, so it is broadcast; beyond it rows only go to a shuffle that
    would else take all of them.
    """
    cell, bit = _cell_and_bit()
    met = rows.withColumn("cell", cell).join(F.broadcast(marked), "cell")
    return met.where(F.call_function("shiftrightunsigned", "bits", bit).bitwiseAND(F.lit(1).cast("long")) == 1).select(*rows.columns)


def _allowed() -> Column:
    return F.floor(F.greatest("a_n", "b_n") * (1 - LIKE) + 1e-9)


def _near() -> Column:
    """Whether lengths and SimHash let ``a`` and ``b`` be alike; short lines have too few words for a SimHash."""
    short = F.least("a_words", "b_words") < 2 * SEGMENT
    return (F.abs(F.col("a_n") - F.col("b_n")) <= _allowed()) & (short | F.coalesce(F.bit_count(F.col("a_s").bitwiseXOR(F.col("b_s"))) <= HAMMING, F.lit(True)))


def _similar(pairs: DataFrame) -> DataFrame:
    """``pairs`` (a and b with their sides' columns) with alike.

    What lies between the common first and last words decides.  Its length bounds the
    distance from above, and where as many words differ one by one, so do their
    lengths.  So do the distances of what lies between the longer words that both have, if
    these stand in one order.  Only other pairs need the distance itself, of these middles.
    """
    x, y = F.col("_x"), F.col("_y")
    rows = pairs.withColumn("_x", F.split("a", " ")).withColumn("_y", F.split("b", " ")).withColumn("_least", F.least(F.size(x), F.size(y)))
    rows = rows.withColumn("_ahead", F.array_position(F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q)), True).cast("int"))
    rows = rows.withColumn("_ahead", F.when(F.col("_ahead") > 0, F.col("_ahead") - 1).otherwise(F.col("_least")))
    rows = rows.withColumn("_behind", F.array_position(F.zip_with(F.reverse(x), F.reverse(y), lambda p, q: ~p.eqNullSafe(q)), True).cast("int"))
    rows = rows.withColumn("_behind", F.least(F.when(F.col("_behind") > 0, F.col("_behind") - 1).otherwise(F.col("_least")), F.col("_least") - F.col("_ahead")))
    middle = [F.slice(w, F.col("_ahead") + 1, F.size(w) - F.col("_ahead") - F.col("_behind")) for w in (x, y)]
    rows = rows.withColumn("_x", middle[0]).withColumn("_y", middle[1]).withColumn("_a", F.array_join("_x", " ")).withColumn("_b", F.array_join("_y", " "))
    differing = F.zip_with(x, y, lambda p, q: F.when(p == q, 0).otherwise(F.greatest(F.char_length(p), F.char_length(q))))
    one_by_one = (F.size(x) == F.size(y)) & (F.aggregate(differing, F.lit(0), lambda n, d: n + d) <= _allowed())
    # one side of the middles may lack a space at the seam, hence 1
    whole = F.greatest(F.char_length("_a"), F.char_length("_b")) + 1 <= _allowed()
    exact = F.call_function("levenshtein", F.when(F.col("_cut"), F.col("_a")).otherwise(F.col("a")), F.when(F.col("_cut"), F.col("_b")).otherwise(F.col("b")), _allowed().cast("int")) >= 0
    # with an empty middle a space of the seam is missing on that side: the whole lines are compared
    rows = rows.withColumn("_cut", (F.size(x) > 0) & (F.size(y) > 0))
    rows = rows.withColumn("_sure", whole | one_by_one)
    # words of both, in one order, cut the middles into gaps that are compared one by one
    rows = rows.withColumn("_both", F.when(~F.col("_sure") & F.col("near"), F.array_intersect(F.filter("_x", lambda w: F.char_length(w) >= ANCHOR), "_y")))
    rows = rows.withColumns({f"_{k}_in": F.filter(w, lambda w: F.array_contains("_both", w)) for k, w in (("a", x), ("b", y))})
    in_order = F.col("_cut") & (F.size("_both") > 0) & (F.col("_a_in") == F.col("_b_in")) & ~F.contains("_a", F.lit("\x01")) & ~F.contains("_b", F.lit("\x01"))

    def gaps(words: Column) -> Column:
        return F.split(F.array_join(F.transform(words, lambda w: F.when(F.array_contains("_both", w), F.lit("\x01")).otherwise(w)), " "), "\x01")

    def apart(p: Column, q: Column) -> Column:
        # a gap above what is allowed is left to the distance of the middles
        return F.when(p == q, 0).when(F.greatest(F.char_length(p), F.char_length(q)) <= _allowed(), F.levenshtein(p, q)).otherwise(1 << 20)

    rows = rows.withColumn("_apart", F.when(in_order, F.aggregate(F.zip_with(gaps(x), gaps(y), apart), F.lit(0).cast("long"), lambda n, d: n + d)))
    aligned = F.coalesce(F.col("_apart") <= _allowed(), F.lit(False))
    return rows.withColumn("alike", F.col("_sure") | aligned | exact)


def _verified(pairs: DataFrame, texts: DataFrame, what: str) -> DataFrame:
    """(a, b, alike) of pairs of keys, written."""
    one, other = (texts.select("key", "n", "words", "s", "line").toDF(f"_{x}", f"{k}_n", f"{k}_words", f"{k}_s", f"_{k}") for x, k in (("x", "a"), ("y", "b")))
    met = pairs.join(one, pairs.a == one["_x"]).join(other, pairs.b == other["_y"])
    met = met.select(F.col("_x").alias("a_key"), F.col("_y").alias("b_key"), F.col("_a").alias("a"), F.col("_b").alias("b"), _near().alias("near"), "a_n", "b_n")
    # what is too far by length or SimHash is settled: without its texts nothing is worked out
    met = met.select("a_key", "b_key", "near", "a_n", "b_n", F.when(F.col("near"), F.col("a")).alias("a"), F.when(F.col("near"), F.col("b")).alias("b"))
    rows = _similar(met).select("a_key", "b_key", (F.col("near") & F.coalesce("alike", F.lit(False))).alias("alike"))
    return cut(rows.toDF("a", "b", "alike"), what)


def similar_lines(seen: DataFrame, docs: DataFrame, whole: DataFrame) -> DataFrame | None:
    """Edges (a, b) between keys of distinct lines that give the components of all similar pairs found."""
    spark = docs.sparkSession
    sides = seen.select(F.explode("blocks").alias("block"), "key")
    met = sides.groupBy("block").agg(F.min("key").alias("rep"), F.max("key").alias("top")).where("rep <> top")
    met = cut(met.select("block", "rep"), "line-blocks")
    if not met.limit(1).count():
        remove(spark, met)
        return None
    marked = _filter_of(met.select(F.col("block").alias("key")))
    # members of a block, its smallest line left out
    members = _maybe(sides.select(F.col("block").alias("key"), F.col("key").alias("line_key")), marked).select(F.col("key").alias("block"), F.col("line_key").alias("key"))
    members = cut(members.join(met, "block").where("key <> rep").select("block", "rep", "key").distinct(), "line-members")
    remove(spark, met, marked)
    pairs = cut(members.select(F.col("rep").alias("a"), F.col("key").alias("b")).distinct(), "line-pairs")
    # texts and SimHash of the lines that meet, read from their first occurrence
    touched = cut(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct(), "line-keys")
    marked = _filter_of(touched)
    lines = _maybe(lines_of(docs).withColumn("key", F.xxhash64("line", F.lit(1))), marked)
    where = whole.select("key", "first").join(touched, "key").select("key", "first.doc_id", "first.mark", "first.at")
    found = lines.join(where, ["key", "doc_id", "mark", "at"]).select("key", "line").dropDuplicates(["key"])
    found = cut(found.select("key", "line", F.char_length("line").alias("n"), F.size(F.split("line", " ")).alias("words")), "line-found")
    remove(spark, touched, marked)
    texts = cut(with_simhash(found), "line-texts")
    remove(spark, found)
    star = _verified(pairs, texts, "line-stars")
    remove(spark, pairs)
    groups = components(star.where("alike").select("a", "b"))
    # lines unlike the smallest one of a block meet its other lines, but for those already in their group
    parts = texts.select("key", "n", "words", "s").join(groups, texts.key == groups.node, "left")
    parts = cut(parts.select("key", "n", "words", "s", F.coalesce("component", "key").alias("part")), "line-parts")
    remove(spark, groups)
    stray = members.join(star.where("not alike").select(F.col("a").alias("rep"), F.col("b").alias("key")), ["rep", "key"])
    stray = cut(stray.select("block", "key"), "line-strays")
    sizes = members.join(stray.select("block").distinct(), "block").groupBy("block").agg(F.count("*").alias("size"))
    sizes = cut(sizes, "line-sizes")
    linked = []
    if sizes.where(F.col("size") > MEET).limit(1).count():
        large = cut(members.select("block", "key").join(sizes.where(F.col("size") > MEET), "block").select("block", "key"), "line-large")
        # written, since a filter on parts would be worked out on all texts
        halves = cut(with_parts(texts.join(large.select("key").distinct(), "key").select("key", "line")).select("key", "parts"), "line-halves")
        divided = large.join(halves, "key").select(F.explode("parts").alias("run"), "block", "key")
        divided = cut(divided.select(F.xxhash64("block", "run").alias("block"), "key").distinct(), "line-divided")
        hot = divided.join(divided.groupBy("block").agg(F.count("*").alias("size")).where("size > 1"), "block").select("block", "key")
        hot = cut(large.unionByName(hot), "line-hot")
        remove(spark, large, halves, divided)
        linked, parts = _linked_in_rounds(hot, texts, parts)
    rest = cut(_meetings(members.join(sizes.select("block"), "block").select("block", "key"), stray, parts), "line-rest-pairs")
    more = _verified(rest, texts, "line-rest")
    edges = star.where("alike").select("a", "b").unionByName(more.where("alike").select("a", "b"))
    for links in linked:
        edges = edges.unionByName(links.where("alike").select("a", "b"))
    edges = cut(edges, "line-edges")
    remove(spark, members, texts, parts, star, stray, sizes, rest, more, *linked)
    return edges


def _meetings(members: DataFrame, stray: DataFrame, parts: DataFrame) -> DataFrame:
    """(a, b) of lines near each other and of other groups, one of them a stray of a block that has both.

    A pair is made once, in the smallest such block, however many blocks it shares.
    """
    told = members.withColumn("_stray", F.lit(False)).unionByName(stray.select("block", "key").withColumn("_stray", F.lit(True)))
    of = told.groupBy("key").agg(F.collect_set(F.when(~F.col("_stray"), F.col("block"))).alias("all"), F.collect_set(F.when(F.col("_stray"), F.col("block"))).alias("strays"))
    rows = of.join(parts, "key")
    one = rows.select(F.explode("strays").alias("block"), *_as("a"), F.col("all").alias("a_all"), F.col("strays").alias("a_strays"))
    other = rows.select(F.explode("all").alias("block"), *_as("b"), F.col("all").alias("b_all"), F.col("strays").alias("b_strays"))
    # both strays of the block: one order only
    order = (F.col("a") < F.col("b")) | ~F.array_contains("b_strays", F.col("block"))
    first = F.least(F.array_min(F.array_intersect("a_strays", "b_all")), F.array_min(F.array_intersect("a_all", "b_strays")))
    met = one.join(other.withColumnRenamed("block", "_block"), (F.col("block") == F.col("_block")) & (F.col("a_part") != F.col("b_part")) & order & _near() & (F.col("block") == first))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _linked_in_rounds(hot: DataFrame, texts: DataFrame, parts: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(a, b, alike) of each round, and ``parts`` by then; ``hot`` and ``parts`` are removed.

    In each round each block of ``hot`` chooses a line by a hash and compares it with its lines
    of other groups; a block in which that links nothing is done.
    """
    spark, edges, k = hot.sparkSession, [], 0
    while True:
        here = cut(hot.join(parts.select("key", "part"), "key"), "line-open")
        remove(spark, hot)
        chosen = here.groupBy("block").agg(F.max_by(F.struct("key", "part"), F.xxhash64("key", "block", F.lit(k))).alias("rep"))
        chosen = cut(chosen.select("block", F.col("rep.key").alias("rep"), F.col("rep.part").alias("rep_part")), "line-chosen")
        met = here.join(chosen, "block").where("part <> rep_part").select("block", F.least("key", "rep").alias("a"), F.greatest("key", "rep").alias("b"))
        met = cut(met, "line-met")
        pairs = cut(met.select("a", "b").distinct(), "line-round-pairs")
        links = _verified(pairs, texts, "line-round")
        edges.append(links)
        remove(spark, chosen, pairs)
        if not links.where("alike").limit(1).count():
            remove(spark, here, met)
            return edges, parts
        busy = met.join(links.where("alike"), ["a", "b"]).select("block").distinct()
        hot = cut(here.join(busy, "block").select("block", "key"), "line-hot")
        # groups that a link joins become one
        part_of = parts.select("key", "part")
        joined = links.where("alike").join(part_of.toDF("a", "x"), "a").join(part_of.toDF("b", "y"), "b")
        merged = components(joined.select(F.col("x").alias("a"), F.col("y").alias("b")))
        after = parts.join(merged, parts.part == merged.node, "left").select("key", "n", "words", "s", F.coalesce("component", "part").alias("part"))
        after = cut(after, "line-parts")
        remove(spark, here, met, merged, parts)
        parts, k = after, k + 1


def _as(name: str) -> list[Column]:
    return [F.col("key").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("n", "words", "s", "part")]]


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, at) of every line occurrence to remove, written."""
    spark = docs.sparkSession
    seen = with_blocks(lines_of(docs)).select("doc_id", "mark", "at", F.xxhash64("line", F.lit(1)).alias("key"), F.xxhash64("line", F.lit(2)).alias("key2"), "blocks")
    seen = cut(seen, "lines")
    whole = cut(seen.groupBy("key", "key2").agg(F.min(F.struct("doc_id", "mark", "at")).alias("first"), F.count("*").alias("times")), "distinct-lines")
    edges = similar_lines(seen, docs, whole)
    if edges is None:
        named = whole.select("key", "key2", "first", "times", F.lit(None).cast("long").alias("component"))
        groups = None
    else:
        groups = components(edges)
        named = whole.join(groups, whole.key == groups.node, "left").select("key", "key2", "first", "times", "component")
    named = cut(named.where("times > 1 or component is not null"), "repeated-lines")
    remove(spark, whole, edges, groups)
    least = cut(named.where("component is not null").groupBy("component").agg(F.min("first").alias("least")), "first-lines")
    kept = named.join(least, "component", "left").select("key", "key2", F.coalesce("least", "first").alias("keep"))
    kept = cut(kept, "kept-lines")
    remove(spark, named, least)
    marked = _filter_of(kept.select("key"))
    gone = _maybe(seen.select("key", "key2", "doc_id", "mark", "at"), marked).join(kept, ["key", "key2"])
    gone = cut(gone.where("not (doc_id = keep.doc_id and mark = keep.mark and at = keep.at)").select("doc_id", "mark", "at").distinct(), "removed-lines")
    remove(spark, seen, kept, marked)
    return gone


def _removed(docs: DataFrame) -> DataFrame:
    """(_id, _mark, _gone): the numbers of removed lines of each document that has some."""
    gone = duplicate_lines(docs)
    return gone.groupBy(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark")).agg(F.sort_array(F.collect_list("at")).alias("_gone"))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and removed (line numbers from 0, ascending) of each document."""
    gone = _removed(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n"))
    rows = rows.select("doc_id", "mark", F.greatest("n", F.lit(0)).cast("long").alias("n_lines"))
    found = rows.join(gone, (rows.doc_id == gone["_id"]) & (rows.mark == gone["_mark"]), "left")
    removed = F.coalesce("_gone", F.array().cast("array<int>"))
    return found.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def drop_lines(docs: DataFrame, keep_emptied: bool = False) -> DataFrame:
    """``docs`` in their own columns without removed lines; n_chars, if there, is counted anew.

    Documents that lose all their lines go, unless ``keep_emptied``.
    """
    gone = _removed(docs)
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))  # columns of any name are safe within a struct
    row = row.withColumn("id", F.col("row.doc_id").cast("long")).withColumn("mark", F.xxhash64("row.text"))
    rows = row.join(gone, (row.id == gone["_id"]) & (row.mark == gone["_mark"]), "left")
    kept = F.array_join(F.filter(F.split("row.text", "\n"), lambda line, i: ~F.array_contains("_gone", i)), "\n")
    rows = rows.select("row", "_gone", F.when(F.col("_gone").isNull(), F.col("row.text")).otherwise(kept).alias("kept"))
    if not keep_emptied:
        rows = rows.where("_gone is null or trim(kept) <> ''")
    kinds = dict(docs.dtypes)
    made = {"text": F.col("kept")}
    if "n_chars" in kinds:
        made["n_chars"] = F.when(F.col("_gone").isNull(), F.col("row.n_chars")).otherwise(F.char_length("kept").cast(kinds["n_chars"]))
    return rows.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
