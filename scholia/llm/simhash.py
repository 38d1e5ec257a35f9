"""SimHash near-dedup by meet-in-the-middle ball hashing.

Each distinct fingerprint emits itself and its 64 one-bit variants: half of the
radius of 2.  Rows meet on the variant; two fingerprints that share one differ in
at most 2 bits, and any two that differ in at most 2 bits share one.  A variant's
members are kept as a mask of the flipped bits (a long), so grouping is a plain
hash aggregate, a group has at most 65 members, and it links them as a star.

Defined results: null and blank texts have fingerprint zero; a text of fewer words
than a shingle is one shingle; null and repeated ids keep a row per input row, a
component's id is its least non-null id; empty tables give no rows; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm.common import materialise, row_key
from scholia.llm.components import connected_components

SHINGLE, RADIUS, SEED = 3, 2, 42
#: distinct fingerprints whose variants one task emits.
FINGERPRINTS_A_TASK = 20_000
#: shingle hashes unpacked at a time.
BLOCK = 16_384


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text, as a signed long."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    h = np.fromiter((xxhash.xxh64_intdigest(g, seed) for g in grams), "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), BLOCK):
        bits = np.unpackbits(h[k : k + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    packed = np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little")
    return int(packed.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k (digest of id and text), fp for every row."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle, seed) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("k"), pa.array(fps, pa.int64())], names=["doc_id", "k", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), row_key(id_col, text_col).alias("k"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, k binary, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """Star edges (u, v) between the distinct fingerprints fp at most RADIUS bits apart."""
    variants = distinct.select(
        F.expr("inline(transform(sequence(-1, 63), i -> named_struct("
               "'variant', if(i < 0, fp, fp ^ shiftleft(1L, i)), 'mask', if(i < 0, 0L, shiftleft(1L, i)), 'own', i < 0)))")
    )
    met = variants.groupBy("variant").agg(F.bit_or("mask").alias("mask"), F.max("own").alias("own"))
    met = met.where("bit_count(mask) + int(own) > 1")
    members = met.select(
        F.expr("array_sort(concat(if(own, array(variant), array()), transform("
               "filter(sequence(0, 63), i -> shiftright(mask, i) & 1 = 1), i -> variant ^ shiftleft(1L, i))))").alias("m")
    )
    stars = members.select(F.expr("m[0]").alias("v"), F.explode(F.expr("slice(m, 2, size(m))")).alias("u"))
    return stars.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS).select("u", "v").distinct()


def _grouped(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k, fp, component (of its least node), component_id for every row.

    A node is a fingerprint with its least id before it, so that the least node of a component has the component's id
    and no component meets in one place, however large it is."""
    fps = materialise(fingerprints(docs, shingle, seed, id_col, text_col), "simhash-fps")
    node = F.struct(F.col("least").isNull().alias("none"), F.col("least"), F.col("fp"))
    distinct = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")).select("fp", node.alias("node")), "simhash-distinct")
    # the rows are small, but each becomes 65: they are dealt out by their number, not by their bytes
    spread = distinct.select("fp").repartition(distinct.count() // FINGERPRINTS_A_TASK + 1)
    found = materialise(links(spread), "simhash-links")
    ends = {c: distinct.select(F.col("fp").alias(c), F.col("node").alias(f"{c}_node")) for c in ("u", "v")}
    edges = found.join(ends["u"], "u").join(ends["v"], "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    nodes = connected_components(edges)
    placed = distinct.join(nodes, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    of_fp = materialise(placed.withColumn("component_id", F.col("component.least")), "simhash-components")
    return fps.join(of_fp, "fp").select("doc_id", "k", "fp", "component", "component_id")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id for every row."""
    return _grouped(docs, shingle, seed, id_col, text_col).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: that with the least id; of rows that share it, the one with the least hash."""
    stay = _grouped(docs).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component").agg(F.min("k").alias("__k"))
    marked = docs.withColumn("__k", row_key("doc_id", "text"))
    return marked.join(materialise(stay.select("__k"), "simhash-stay"), "__k", "left_semi").dropDuplicates(["__k"]).select(docs.columns)
