"""Filter interaction audit by higher-order folds.

Each row becomes a mask of the filters it fails; rows are counted by part and mask, so
that a part has at most 2^filters mask cells however many rows it holds.  A cell folds
across the array of all orders (a literal, which travels with the plan): `aggregate`
walks one order and `transform` walks the orders, which gives a struct of counts for
each order and step, weighted by the cell's rows.  The cells of a part are merged by
elementwise sums.  Counts of labels and of copies are aggregated before they are joined,
and no text is shuffled.

Defined results: a null text counts as empty; a null part as ''; of equal texts those
with the least id pass filter E, all of them if several rows share that id, and null ids
come after all others (rows without an id don't fail by one another); labels of several
rows count when any of them is 1; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import materialise, text_or_empty
from scholia.operators.lines import once

#: the filters by letter, in the order of their bits in a mask; E is set where copies are counted.
LETTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(text: Column) -> Column:
    """The bits of A to D: few words, repetitive words, many capitals, a symbol."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))

    def bits(w: Column) -> Column:
        fails = (
            F.size(w) < LEAST_WORDS,
            100 * F.size(F.array_distinct(w)) < LEAST_DISTINCT * F.size(w),
            100 * capitals > MOST_CAPITALS * F.length(text),
            text.rlike(r"[#$%&*|]"),
        )
        return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))

    # the words are bound once: an array of one element is folded over them
    return F.get(F.transform(F.array(words), bits), F.lit(0))


def mask_cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: rows of each part by the filters they fail, and those of them labelled good and toxic."""
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    rows = once(rows, "id", "part", mask=text_mask(text), digest=F.unhex(F.sha2(text, 256)))
    rows = rows.join(materialise(marks, "audit-labels"), "id", "left")
    told = rows.withColumns({k: F.coalesce(k, F.lit(False)) for k in ("good", "toxic")})
    # rows by id first, so that the least id is known with its number of rows, then equal texts by part and label
    kinds = ("digest", "mask", "part", "good", "toxic")
    by_id = told.groupBy(*kinds, "id").agg(F.count(F.lit(1)).alias("n"))
    place = F.struct(F.col("id").isNull().alias("none"), F.col("id"))
    alike = by_id.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min(F.struct(place.alias("place"), "n")).alias("least"))
    # a text meets itself here once a part and label, not once a row
    first = F.min("least.place").over(Window.partitionBy("digest"))
    none = F.col("least.place.none")
    passing = F.when(F.col("first") != F.col("least.place"), 0).when(none, F.col("n")).otherwise(F.col("least.n"))
    split = alike.withColumn("first", first).select("mask", "part", "good", "toxic", passing.alias("passing"), (F.col("n") - passing).alias("failing"))
    copies = 1 << LETTERS.index("E")
    cells = split.select("part", "good", "toxic", F.inline(F.array(
        F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")), F.struct((F.col("mask") + copies).alias("mask"), F.col("failing").alias("n")))))
    return cells.where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), *[F.sum(F.when(F.col(k), F.col("n")).otherwise(0)).alias(k) for k in ("good", "toxic")])


def fold_cell(mask: Column, n: Column, good: Column, toxic: Column, letters: str = LETTERS) -> Column:
    """A cell's counts for each order and step: an array of structs, orders in lexicographic order, steps within."""
    orders = F.array(*[F.array(*[F.lit(1 << letters.index(x)) for x in o]) for o in permutations(letters)])
    zero = F.lit(0).cast("long")
    counts = "struct<" + ",".join(f"{c}:long" for c in COUNTS) + ">"
    start = F.struct(F.lit(False).alias("gone"), F.array().cast(f"array<{counts}>").alias("steps"))

    def step(acc: Column, bit: Column) -> Column:
        fails = mask.bitwiseAND(bit) != 0
        here = fails & ~acc["gone"]
        gone = acc["gone"] | fails
        told = F.struct(
            F.when(gone, zero).otherwise(n).alias("kept"), F.when(here, n).otherwise(zero).alias("removed"), F.when(fails & acc["gone"], n).otherwise(zero).alias("redundant"),
            F.when(mask == bit, n).otherwise(zero).alias("unique_fails"), F.when(here, good).otherwise(zero).alias("good_lost"), F.when(here, toxic).otherwise(zero).alias("toxic_lost"),
        )
        return F.struct(gone.alias("gone"), F.concat(acc["steps"], F.array(told)).alias("steps"))

    return F.flatten(F.transform(orders, lambda order: F.aggregate(order, start, step, lambda acc: acc["steps"])))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step and the counts: a row for each part, order of the filters and step."""
    cells = mask_cells(docs, labels, id_col, text_col, part_col)
    folded = cells.select("part", fold_cell(F.col("mask"), F.col("n"), F.col("good"), F.col("toxic")).alias("steps"))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: F.struct(*[(x[c] + y[c]).alias(c) for c in COUNTS]))
    # at most 2^filters arrays a part
    merged = folded.groupBy("part").agg(F.collect_list("steps").alias("s")).select("part", F.aggregate(F.slice("s", 2, 1 << len(LETTERS)), F.get("s", F.lit(0)), add).alias("steps"))
    steps = merged.select("part", F.posexplode("steps").alias("pos", "x"))
    names = F.array(*map(F.lit, ("".join(o) for o in permutations(LETTERS))))
    size = len(LETTERS)
    order, at = F.get(names, F.floor(F.col("pos") / size).cast("int")), F.col("pos") % size
    told = steps.select("part", order.alias("filter_order"), (at + 1).alias("step"), *[F.col(f"x.{c}").alias(c) for c in COUNTS])
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    return told.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", letter)))
