"""Benchmark decontamination as a prefix-filtered set join.  DataFrame functions only.

A benchmark window is a run of `width` item words (all of a shorter item); its tokens are
its shingles of SHINGLE words (one of all words of a shorter window), each known by a hash.  Shingles are
ordered by rarity over all documents; since containment must be whole, a window's necessary
prefix is its rarest shingle alone.  A document position is a candidate if its shingle is
such a prefix token; its neighbourhood of width words on either side goes along, so
the text itself is never shuffled.  Length and positional bounds (the window must fit
around the position) prune candidates, and the words are compared, so hashes decide nothing.

Defined results: null texts have no words; items without words have no windows;
null and repeated ids of documents keep a row per input row; empty tables give no
hits or no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import materialise, text_or_empty

WIDTH, SHINGLE = 13, 3
#: a filter has SLOTS_A_TOKEN bytes for each token counted, between these bounds (64 KB to 16 MB); with more
#: than half a million tokens it lets more positions through, and results stay the same.
SLOTS_A_TOKEN, LEAST_SLOTS, MOST_SLOTS = 32, 1 << 16, 1 << 24
#: a table is broadcast only if its rows, written as JSON, have at most so many bytes; a larger one is joined by shuffle.
BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text_col: str = "text") -> Column:
    lowered = F.translate(text_or_empty(text_col), UPPER, LOWER)
    return F.filter(F.split(lowered, SPACES, -1), lambda w: w != "")


def shingle_keys(w: Column, size: int) -> Column:
    """The hash of the shingle of `size` words at each place of an array of words; null where fewer are left."""
    places = F.size(w) - size
    return F.transform(w, lambda x, i: F.when(i <= places, F.xxhash64(F.lit(size), x, *[F.get(w, i + j) for j in range(1, size)])))


def key_filter(tokens: DataFrame):
    """A test whether a key can be among tokens.key; a byte for each slot, sized by the number of tokens."""
    slots = LEAST_SLOTS
    while slots < MOST_SLOTS and slots < SLOTS_A_TOKEN * tokens.count():
        slots *= 2
    slot = lambda c: F.pmod(c, F.lit(slots)).cast("int")
    at = slot(F.col("key")).cast("long") + 1
    rows = tokens.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap")).collect()
    octets = np.zeros(slots, np.uint8)  # at most MOST_SLOTS
    for r in rows:
        begin = (r["bucket"] - 1) * len(r["bitmap"]) * 8
        octets[begin : begin + len(r["bitmap"]) * 8] = np.unpackbits(np.frombuffer(r["bitmap"], np.uint8), bitorder="little")
    told = F.lit(octets.tobytes())
    return lambda key: F.substring(told, slot(key) + 1, F.lit(1)) == F.lit(b"\x01")


def small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if its rows are within BROADCAST_BYTES."""
    size = df.select(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def item_windows(benchmark: DataFrame, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, n (words in the window), window (array of words)."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words(text_col).alias("w")).where(F.size("w") > 0)
    n = F.size("w")
    return items.select(
        "item_id", F.least(n, F.lit(width)).alias("n"), F.explode(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1)))).alias("at"), "w"
    ).select("item_id", "n", F.expr("slice(w, at, n)").alias("window"))


def token_counts(docs: DataFrame, of: DataFrame, size: int) -> DataFrame:
    """key, df: documents that hold each shingle of `of` (column key), over all documents."""
    can_be = key_filter(of)
    keys = docs.select(words().alias("w")).select(shingle_keys(F.col("w"), size).alias("keys"))
    held = keys.select(F.explode(F.array_distinct(F.filter("keys", can_be))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    return of.join(held, "key", "left").select("key", F.coalesce("df", F.lit(0)).alias("df"))


def prefixes(windows: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """The rarest shingle of each distinct window, ties by key: key, at (its first offset), n, window, items, df."""
    distinct = materialise(windows.groupBy("n", "window").agg(F.sort_array(F.collect_set("item_id")).alias("items")), "windows-distinct")
    spread = distinct.select("n", "window", "items", F.posexplode(shingle_keys(F.col("window"), size)).alias("at", "key")).where("key IS NOT NULL")
    counts = token_counts(docs, materialise(spread.select("key").distinct(), "tokens"), size)
    # the rarest by an aggregate: a window's shingles are few, and no window function sorts the table
    best = spread.join(counts, "key").groupBy("n", "window").agg(F.min(F.struct("df", "key", "at")).alias("b"), F.first("items").alias("items"))
    return best.select("b.key", "b.at", "n", "window", "items", "b.df")


def find_windows(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """Occurrences of windows: row (the document), at (first word), n, items."""
    windows = materialise(item_windows(benchmark, width), "windows")
    size = F.least("n", F.lit(SHINGLE))
    sizes = [r[0] for r in windows.select(size).distinct().orderBy(size).collect()]  # at most SHINGLE of them
    found = [_find(docs, windows.where(size == k), k, width) for k in sizes]
    if not found:
        kind = windows.schema["item_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"row binary, at int, n int, items array<{kind}>")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _find(docs: DataFrame, windows: DataFrame, size: int, width: int) -> DataFrame:
    index = materialise(prefixes(windows, docs, size), "prefixes").where("df > 0")
    can_be = key_filter(index.select("key"))
    pad = width - 1
    near = docs.select("row", words().alias("w")).select("row", "w", shingle_keys(F.col("w"), size).alias("keys")).select(
        "row",
        F.explode(
            F.filter(
                F.transform(
                    "keys",
                    lambda x, i: F.when(
                        can_be(x),
                        F.struct(
                            i.alias("pos"), x.alias("key"), F.least(i, F.lit(pad)).alias("before"),
                            F.slice("w", F.greatest(i - pad + 1, F.lit(1)), F.least(i, F.lit(pad)) + pad + 1).alias("around"),
                        ),
                    ),
                ),
                lambda s: s.isNotNull(),
            )
        ).alias("c"),
    ).select("row", "c.*")
    met = near.join(small(index), "key")
    fits = (F.col("before") >= F.col("at")) & (F.size("around") >= F.col("before") - F.col("at") + F.col("n"))
    same = F.expr("slice(around, before - at + 1, n) = window")
    return met.where(fits & same).select("row", (F.col("pos") - F.col("at")).alias("at"), "n", "items")


def covered(starts: Column) -> Column:
    """Words covered by sorted (at, n) spans."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("sum")),
        lambda a, x: F.struct(
            F.greatest(a["upto"], x["at"] + x["n"]).alias("upto"),
            (a["sum"] + F.greatest(x["at"] + x["n"] - F.greatest(a["upto"], x["at"]), F.lit(0))).alias("sum"),
        ),
        lambda a: a["sum"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, digest, n_words, n_hit, items (sorted as strings), contaminated.

    Equal texts have equal hits, so spans are gathered by digest of the text; each
    distinct span once.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).withColumn("row", F.unhex(F.sha2("text", 256)))
    found = find_windows(rows, benchmark, width).groupBy("row", "at", "n").agg(F.first("items").alias("items"))
    # written first: the join below then stands between two plain shuffles, which Spark can split
    per_text = materialise(found.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("at", "n"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    ).select("row", covered(F.col("spans")).alias("n_hit"), F.sort_array(F.transform("items", lambda x: x.cast("string"))).alias("items")), "hits")
    n_words = F.size(words("text")).cast("long")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select("doc_id", "row", n_words.alias("n_words")).join(per_text, "row", "left").select(
        "doc_id", F.col("row").alias("digest"), "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: int = 20) -> DataFrame:
    """docs without the contaminated rows."""
    bad = contamination(docs, benchmark, width, share).where("contaminated").select(F.col("digest").alias("__bad")).distinct()
    return docs.withColumn("__digest", F.unhex(F.sha2(text_or_empty(), 256))).join(
        small(materialise(bad, "contaminated")), F.col("__digest") == F.col("__bad"), "left_anti"
    ).drop("__digest")
