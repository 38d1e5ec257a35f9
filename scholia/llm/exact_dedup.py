"""Exact dedup through a log-structured merge index.  DataFrame functions only.

A memtable is what a task reads, dealt to one of RUNS runs.  It is flushed as one entry
per digest, sorted by digest within the run, and each run gets a bitmap filter sized by the
number of entries.  Compaction goes level by level: FANOUT runs at a time become one run of
the next level.  An entry is looked up in the filters of the runs it is merged with: if none
of them can have its digest, it passes to the next level as it is, without a shuffle; the
others are merged, which keeps one identifier per digest.  At the top, a digest with more
than one row is a hit; hits are verified on their bytes, with `min(text) = max(text)` per
digest, which pre-aggregates in every task, so a group with a third of all rows is no
hot spot.  Digests that fail are regrouped by the text itself.

Defined results: a null text counts as empty; null ids lose to any other id and a
group of null ids keeps null; repeated rows count in group_size and each of them is
returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import materialise, text_or_empty

#: runs of the first level, and runs that are merged into one of the next.
RUNS, FANOUT = 16, 4
#: a filter has BITS_A_DIGEST bits for each digest that was counted, and all filters of a level together are between these
#: bounds (4 KB a run to 256 MB, in rows of BITMAP_BITS); beyond the upper one they let more through, and results stay the same.
BITS_A_DIGEST, LEAST_BITS, MOST_BITS = 16, 1 << 15, 1 << 31
BITMAP_BITS = 32_768


@dataclass
class Level:
    """Runs of one level: run, digest, keep_id, n (and, from the second level on, merged), sorted by digest within a run."""

    runs: DataFrame
    number: int


@dataclass
class MergeIndex:
    levels: list[Level]  # from the memtables to one run

    @property
    def top(self) -> DataFrame:
        return self.levels[-1].runs

    def passed(self) -> list[tuple[int, int]]:
        """(entries looked up in filters, entries that these let pass without a merge), by level."""
        return [(a.runs.count(), b.runs.where("NOT merged").count()) for a, b in zip(self.levels, self.levels[1:])]


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _slot(digest: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(bits))


def _bit(bitmap: Column, slot: Column) -> Column:
    """Whether a bitmap of a bucket has the bit of a slot."""
    octet = F.conv(F.hex(F.substring(bitmap, (F.floor(slot / 8) % (BITMAP_BITS // 8)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(octet, (slot % 8).cast("int")) == 1


@dataclass
class Filter:
    """A bitmap over hashed digests, as rows (bucket, bitmap) of 4 KB; no false negatives."""

    rows: DataFrame
    bits: int

    def flagged(self, df: DataFrame, digest: str, flag: str) -> DataFrame:
        """df with a column that says whether the digest can be among those of the filter.
        The bitmaps are broadcast: MOST_BITS bounds them."""
        slot = _slot(F.col(digest), self.bits)
        bits = F.broadcast(self.rows.select(F.col("bucket").alias("__bucket"), F.col("bitmap").alias("__bitmap")))
        met = df.join(bits, F.bitmap_bucket_number(slot + 1) == F.col("__bucket"), "left")
        return met.withColumn(flag, F.coalesce(_bit(F.col("__bitmap"), slot), F.lit(False))).drop("__bucket", "__bitmap")


def _bitmaps(df: DataFrame, digest: str, bits: int, *by: str) -> DataFrame:
    slot = _slot(F.col(digest), bits) + 1
    return df.groupBy(*by, F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bitmap"))


def _bits_for(digests: int, runs: int = 1) -> int:
    """Bits of each of the filters of so many runs of a level, by the digests in a run."""
    bits = LEAST_BITS
    while bits * runs < MOST_BITS and bits < BITS_A_DIGEST * digests:
        bits *= 2
    return bits


def sized_filter(digests: DataFrame, digest: str = "digest") -> Filter:
    """A filter of the digests of a (written) table, sized by their number."""
    bits = _bits_for(digests.count())
    return Filter(materialise(_bitmaps(digests, digest, bits), "lsm-filter"), bits)


def entries(docs: DataFrame, digest=sha256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), digest(text_or_empty(text_col)).alias("digest"))


def build_index(docs: DataFrame, digest=sha256, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", runs: int = RUNS, fanout: int = FANOUT) -> MergeIndex:
    """Flush memtables to sorted runs with filters, then compact the runs level by level."""
    pick = {"smallest": F.min, "largest": F.max}[keep]
    # the flushed rows say which run a memtable went to, so it does not matter if a task that runs again deals anew
    dealt = entries(docs, digest, id_col, text_col).withColumn("run", F.pmod(F.spark_partition_id(), F.lit(runs)))
    flushed = dealt.groupBy("run", "digest").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    levels = [Level(materialise(flushed.sortWithinPartitions("run", "digest"), "lsm-runs"), runs)]
    while levels[-1].number > 1:
        levels.append(compact(levels[-1], keep, fanout))
    return MergeIndex(levels)


def compact(level: Level, keep: str = "smallest", fanout: int = FANOUT) -> Level:
    """The next level.  Entries that no filter of a run merged with theirs can have pass as they are."""
    pick = {"smallest": F.min, "largest": F.max}[keep]
    bits = _bits_for(level.runs.count() // level.number + 1, level.number)
    filters = materialise(_bitmaps(level.runs, "digest", bits, "run"), "lsm-filters")
    # of each bucket the bitmaps of all runs: as many bytes as MOST_BITS bounds, so they are broadcast
    side = filters.groupBy(F.col("bucket").alias("__bucket")).agg(F.collect_list(F.struct("run", "bitmap")).alias("__filters"))
    slot, into = _slot(F.col("digest"), bits), lambda run: F.floor(run / fanout).cast("int")
    met = level.runs.select("run", "digest", "keep_id", "n").join(F.broadcast(side), F.bitmap_bucket_number(slot + 1) == F.col("__bucket"))
    own = F.struct(F.col("run").alias("run"), into(F.col("run")).alias("into"))
    met = met.withColumn("__own", own)
    others = F.filter("__filters", lambda f: (f["run"] != F.col("__own.run")) & (into(f["run"]) == F.col("__own.into")))
    told = met.select(F.col("__own.into").alias("run"), "digest", "keep_id", "n", F.exists(others, lambda f: _bit(f["bitmap"], slot)).alias("merged"))
    told = materialise(told, "lsm-probed")
    merged = told.where("merged").groupBy("run", "digest").agg(pick("keep_id").alias("keep_id"), F.sum("n").alias("n")).withColumn("merged", F.lit(True))
    runs = told.where("NOT merged").unionByName(merged).sortWithinPartitions("run", "digest")
    return Level(materialise(runs, "lsm-runs"), -(-level.number // fanout))


def probe(docs: DataFrame, index: MergeIndex, digest=sha256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """New documents whose digest the index has: doc_id, digest, keep_id.
    The filter of the top run drops most new digests before the join."""
    new = sized_filter(index.top).flagged(entries(docs, digest, id_col, text_col), "digest", "may")
    return new.where("may").drop("may").join(index.top.select("digest", "keep_id"), "digest")


def exact_groups(docs: DataFrame, digest=sha256, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest, keep_id, group_size for every row of docs."""
    hits = materialise(build_index(docs, digest, keep, id_col, text_col).top.where("n > 1").select("digest", "keep_id", "n"), "lsm-hits")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = sized_filter(hits).flagged(rows.withColumn("digest", digest(F.col("text"))), "digest", "may")
    suspects = rows.where("may").drop("may")
    unequal = materialise(
        suspects.groupBy("digest").agg(F.min("text").alias("lo"), F.max("text").alias("hi")).where("lo != hi").select("digest"),
        "lsm-unequal",
    )
    # rows that the filter clears are alone; of the others those whose digest only shares a bit with a hit are, too
    alone = rows.where("NOT may").select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    met = suspects.drop("text").join(hits, "digest", "left")
    met = met.select("doc_id", "digest", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("group_size"))
    placed = alone.unionByName(met)
    if unequal.isEmpty():
        return placed
    pick = {"smallest": F.min, "largest": F.max}[keep]
    split = suspects.join(unequal, "digest", "left_semi")
    classes = split.groupBy("digest", "text").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    again = split.join(classes, ["digest", "text"]).select("doc_id", "digest", "keep_id", "group_size")
    return placed.join(unequal, "digest", "left_anti").select(again.columns).unionByName(again)


def deduplicate(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """docs without the rows that lose; of rows with equal id and text one stays.

    Rows that the hit filter clears pass without a shuffle of their text.
    """
    groups = materialise(exact_groups(docs, keep=keep), "lsm-groups")
    hits = sized_filter(materialise(groups.where("group_size > 1").select("digest").distinct(), "lsm-hits"))
    marked = hits.flagged(docs.withColumn("__digest", sha256(text_or_empty())), "__digest", "__may")
    # digests that only share a bit with a hit are winners of their own; id and digest together are no hot key
    winners = hits.flagged(groups, "digest", "__m").where("__m").select(F.col("digest").alias("__d"), F.col("keep_id").alias("__keep")).distinct()
    kept = marked.where("__may").join(
        winners, (F.col("__digest") == F.col("__d")) & F.col("doc_id").eqNullSafe(F.col("__keep")), "left_semi"
    ).dropDuplicates(["doc_id", "__digest"])
    return marked.where("NOT __may").unionByName(kept).select(docs.columns)
