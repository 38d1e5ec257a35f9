"""Secret scan over an incremental blob ledger.  DataFrame functions only.

Every version of a text is content-addressed (sha256).  The ledger holds the
(blob, rule, rule version) pairs that were scanned; only unseen pairs are scanned,
each blob once however many paths hold it, and findings are joined back to all
paths.  Findings of a rule's earlier versions stay in the history but count for no path once the rule has a
newer version.  Only texts that some rule matches move between tasks: a text without
any match has nothing to find, and its blob is booked from its digest alone.  Positions come from the gaps that `split` leaves between the matches, so
no Python runs; they are code points, end exclusive.

Defined results: a null text counts as empty and has no findings; null and
repeated ids keep one result row for each input row; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.llm.common import materialise, text_or_empty


@dataclass(frozen=True)
class Rule:
    kind: str
    version: int
    pattern: str
    group: int  # the group whose length counts
    min_length: int


def either_case(word: str) -> str:
    """A pattern for word in either ASCII case, without case folding of other letters."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))

#: Fixed patterns of the contract.  For hex the run length is in the pattern: a match is
#: a whole run either way, and short runs are everywhere in prose.
RULES = (
    Rule("assign", 1, rf"""({_KEYS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)


def blob_id(text_col: str = "text") -> Column:
    return F.unhex(F.sha2(text_or_empty(text_col), 256))


def unseen_pairs(docs: DataFrame, ledger: DataFrame | None, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """blob_id, path (the id that stands for the blob), kinds (rules still to run)."""
    blobs = docs.select(F.col(id_col).alias("path"), blob_id(text_col).alias("blob_id")).groupBy("blob_id").agg(F.min("path").alias("path"))
    known = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        return blobs.withColumn("kinds", F.transform(known, lambda r: r["kind"]))
    pairs = blobs.select("*", F.explode(known).alias("r")).select("blob_id", "path", "r.kind", "r.version")
    return (
        pairs.join(ledger.select("blob_id", "kind", "version"), ["blob_id", "kind", "version"], "left_anti")
        .groupBy("blob_id", "path")
        .agg(F.collect_set("kind").alias("kinds"))
    )


def _pieces(rule: Rule, no: int) -> Column:
    """For a text: an array of (kind_no, i, gap, width, ok), one per match."""
    text, p = F.col("text"), F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, p, F.lit(0))
    counted = whole if rule.group == 0 else F.regexp_extract_all(text, p, F.lit(rule.group))
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole))
    zipped = F.arrays_zip(gaps.alias("g"), whole.alias("m"), counted.alias("c"))
    pieces = F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(no).alias("kind_no"), i.alias("i"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("width"),
            (F.length(x["c"]) >= rule.min_length).alias("ok"),
        ),
    )
    none = F.lit(None).cast("array<struct<kind_no:int,i:int,gap:int,width:int,ok:boolean>>")
    return F.coalesce(F.when(F.array_contains("kinds", rule.kind) & text.rlike(rule.pattern), pieces), none, F.array().cast(
        "array<struct<kind_no:int,i:int,gap:int,width:int,ok:boolean>>"))


def scan_blobs(docs: DataFrame, todo: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of the unseen pairs: blob_id, kind, version, kind_no, start, end."""
    some = F.lit(False)
    for r in rules:
        some = some | text_or_empty(text_col).rlike(r.pattern)
    texts = docs.where(some).select(F.col(id_col).alias("path"), blob_id(text_col).alias("blob_id"), text_or_empty(text_col).alias("text"))
    need = todo.select(F.col("blob_id").alias("b"), F.col("path").alias("p"), "kinds")
    chosen = texts.join(need, (F.col("blob_id") == F.col("b")) & F.col("path").eqNullSafe(F.col("p"))).select("blob_id", "text", "kinds")
    pieces = chosen.select("blob_id", F.explode(F.flatten(F.array(*[_pieces(r, k) for k, r in enumerate(rules)]))).alias("x"))
    # a row given twice has its blob scanned twice: one finding of each place stays
    pieces = pieces.select("blob_id", "x.*").dropDuplicates(["blob_id", "kind_no", "i"])
    upto = Window.partitionBy("blob_id", "kind_no").orderBy("i")
    start = F.sum("gap").over(upto) + F.coalesce(F.sum("width").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    versions = F.array(*[F.lit(r.version) for r in rules])
    return (
        pieces.withColumn("start", start)
        .where("ok")
        .select(
            "blob_id", F.get(kinds, "kind_no").alias("kind"), F.get(versions, "kind_no").alias("version"), "kind_no",
            "start", (F.col("start") + F.col("width")).alias("end"),
        )
    )


def scan(docs: DataFrame, ledger: DataFrame | None = None, history: DataFrame | None = None, rules=RULES, id_col: str = "doc_id", text_col: str = "text"):
    """(findings of all blobs known, ledger with the pairs just scanned added)."""
    todo = materialise(unseen_pairs(docs, ledger, rules, id_col, text_col), "ledger-todo")
    findings = materialise(scan_blobs(docs, todo, rules, id_col, text_col), "ledger-findings")
    versions = F.create_map(*[x for r in rules for x in (F.lit(r.kind), F.lit(r.version))])
    scanned = todo.select("blob_id", F.explode("kinds").alias("kind")).withColumn("version", versions[F.col("kind")])
    if history is not None:
        findings = findings.unionByName(history)
    if ledger is not None:
        scanned = scanned.unionByName(ledger.select("blob_id", "kind", "version"))
    return findings, scanned


def store(findings: DataFrame, ledger: DataFrame, path: str) -> None:
    """Write the findings and the ledger of a scan to a folder of its own, for the next one."""
    findings.write.parquet(f"{path}/findings")
    ledger.write.parquet(f"{path}/ledger")


def reopen(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The findings and the ledger that store() wrote."""
    return spark.read.parquet(f"{path}/findings"), spark.read.parquet(f"{path}/ledger")


def current(findings: DataFrame, rules=RULES) -> DataFrame:
    """Findings of the rules' present versions."""
    now = F.lit(False)
    for r in rules:
        now = now | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
    return findings.where(now)


def findings_by_path(docs: DataFrame, findings: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, a count per kind, and the sorted spans."""
    spans = current(findings, rules).groupBy("blob_id").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind_no", "kind", "end"))).alias("found"),
        *[F.count_if(F.col("kind") == r.kind).alias(f"n_{r.kind}") for r in rules],
    )
    spans = spans.select(
        "blob_id", *[f"n_{r.kind}" for r in rules],
        F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
    )
    # written first, so that a blob that many paths hold can be split in the join
    spans = materialise(spans, "ledger-spans")
    paths = docs.select(F.col(id_col).alias("doc_id"), blob_id(text_col).alias("blob_id"))
    return paths.join(spans, "blob_id", "left").select(
        "doc_id", *[F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules],
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
