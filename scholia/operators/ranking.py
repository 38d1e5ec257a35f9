"""Dedupe, candidate search and ranking of papers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import blank_to_null, strip
from scholia.sources.io import scratch

# Fixed words of the composite score.
NATIONAL_FUNDS = ("国家自然科学基金", "国家重点研发")
#: letters that are counted in titles: an edit changes at most two of the counts, each by one.
COUNTED = " aeinrt"
#: rows of a block of theses, rows of a slice of papers where all pairs or the best are kept, theses and papers scored at a time.
THESES, PAIR_PAPERS, BEST_PAPERS, STEP = 8_192, 16_384, 32_768, 256
#: slices of papers (all pairs) or blocks of theses (the best) made if there are rows enough, so that few rows are spread too; the most
#: tasks that blocks and slices meet in.
LEAST_SLICES, LEAST_BLOCKS, MOST_TASKS = 24, 8, 4_096
#: queries of a search that are broadcast (a few hundred bytes each), and the parts of a language beyond.
MOST_QUERIES, SALTS = 10_000, 64
KNOWN_INSTITUTIONS = ("清华", "北大", "中科院", "复旦", "上海交大", "浙大", "中南大学", "华中科技")


def dedupe_papers(papers: DataFrame, title: str = "Title", year: str = "PublicationYear", order: str = "pos") -> DataFrame:
    """The first row, by `order`, of each lower-cased trimmed title and year; null titles share a key."""
    key = F.concat(F.lower(strip(title)), F.lit("|"), F.coalesce(F.col(year).cast("string"), F.lit("")))
    first = Window.partitionBy("__key").orderBy(order)
    return papers.withColumn("__key", key).withColumn("__rn", F.row_number().over(first)).where("__rn = 1").drop("__key", "__rn")


def _part_keys(titles: DataFrame, most: int, probe: bool) -> DataFrame:
    """pos, key: a title's parts of about equal length, one more than `most`, each with its number and the title's length; or (probe) what
    stands where such a part may stand in it for a partner that is up to `most` shorter, and whether the partner is shorter."""
    size, keys, n = F.col("size"), [], most + 1
    for less in range(n if probe else 1):
        whole = size - less
        base, first = F.floor(whole / n).cast("int"), n - whole % n  # from part `first` on they are a character longer
        for k in range(n):
            length = base + (first <= k).cast("int")
            begun = base * k + F.greatest(k - first, F.lit(0))
            # edits left of a part are at most k where the parts before it all differ, and those right of it at most n - 1 - k
            for by in range(max(-k, less - (most - k)), min(k, less + most - k) + 1) if probe else [0]:
                at = begun + by
                key = F.when((at >= 0) & (at + length <= size), F.xxhash64(F.lit(k), whole, F.substring("title", at + 1, length)))
                keys.append(F.struct(key.alias("key"), *([F.lit(less > 0).alias("shorter")] if probe else [])))
    return titles.select("pos", F.inline(F.array_distinct(F.array(*keys)))).where("key IS NOT NULL")


def _deletion_keys(titles: DataFrame, most: int) -> DataFrame:
    """pos, key: each title with up to `most` characters left out."""
    without = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
    keys = F.array("title")
    for _ in range(most):
        keys = F.array_distinct(F.concat(keys, F.flatten(F.transform(keys, without))))
    return titles.select("pos", F.explode(F.transform(keys, lambda x: F.xxhash64(x))).alias("key"))


def near_titles(papers: DataFrame, most: int = 2, title: str = "Title", order: str = "pos", part: int = 6, in_bytes: bool = False) -> DataFrame:
    """D1, as an extra: pos, other, distance: pairs of unlike titles (trimmed, in lower case; each by its first row in `order`) that at most
    `most` edits tell apart; all of them, and no others.  An edit is one of a character, or of a byte in UTF-8 if `in_bytes`.

    Of the parts of the shorter of two titles within so many edits, one more than the edits, one stands unchanged in the longer,
    near its own place.  So a title gives a fixed number of keys, however long it is; only keys and positions are shuffled, and the titles
    of those that meet.  Titles with parts of fewer than `part` characters share what is left when up to `most` characters are taken out.
    Candidates whose letters differ by no more than that are verified by an edit distance that stops at `most`.  Copies of a title are one; blank and null titles have no
    partner."""
    spark = papers.sparkSession
    folded = F.lower(strip(title))
    titles = papers.select(F.col(order).alias("pos"), folded.alias("title")).where("title != ''").groupBy("title").agg(F.min("pos").alias("pos"))
    if in_bytes:  # each byte as a character of its own
        titles = titles.select(F.decode(F.encode("title", "UTF-8"), "ISO-8859-1").alias("title"), "pos")
    counts = F.array(*[F.length("title") - F.length(F.replace("title", F.lit(c), F.lit(""))) for c in COUNTED])
    titles = titles.withColumns({"size": F.length("title"), "counts": counts})
    titles.write.parquet(path := scratch(spark, "titles"))
    titles = spark.read.schema(titles.schema).parquet(path)
    least = (most + 1) * part
    long, short = titles.where(F.col("size") >= least), _deletion_keys(titles.where(F.col("size") < least + most), most)
    own, tried = (_part_keys(long, most, probe).withColumnRenamed("pos", p) for p, probe in (("a", False), ("b", True)))
    left, right = (short.withColumnRenamed("pos", p) for p in "ab")
    met = own.join(tried, "key").where("shorter OR a < b").select("a", "b").unionByName(left.join(right, "key").where("a < b").select("a", "b"))
    # few bytes but much work: not to be put into few tasks
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = met.select(F.least("a", "b").alias("pos"), F.greatest("a", "b").alias("other")).repartition(spread, "pos", "other").distinct()
    one, two = (titles.select(F.col("pos").alias(p), F.col("title").alias(t), F.col("counts").alias(c)) for p, t, c in (("pos", "x", "cx"), ("other", "y", "cy")))
    unlike = F.aggregate(F.zip_with("cx", "cy", lambda a, b: F.abs(a - b)), F.lit(0), lambda s, d: s + d)
    told = pairs.join(one, "pos").join(two, "other").where(unlike <= 2 * most).withColumn("distance", F.levenshtein("x", "y", most))
    return told.where("distance >= 0").select("pos", "other", "distance")


def union_languages(by_lang: dict[str, DataFrame]) -> DataFrame:
    """All rows, with their language as a column."""
    out = None
    for lang, df in by_lang.items():
        df = df.withColumn("lang", F.lit(lang))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(theses: DataFrame, papers: DataFrame, keys=("thesis_id", "lang"), vector: str = "embedding") -> DataFrame:
    """D3: keys, paper_id, similarity of each thesis to the papers under its keys; null for a zero vector.
    Norms are taken once a row, before the join."""
    norm = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    t = theses.select(*keys, F.col(vector).alias("tv"), norm(vector).alias("tn"))
    p = papers.select(*keys, "paper_id", F.col(vector).alias("pv"), norm(vector).alias("pn"))
    both = t.join(p, list(keys))
    size = F.col("tn") * F.col("pn")
    return both.select(*keys, "paper_id", F.when(size > 0, dot(F.col("tv"), F.col("pv")) / size).alias("similarity"))


def top_papers(similar: DataFrame, n: int = 30, keys=("thesis_id", "lang")) -> DataFrame:
    """The n most similar papers under each key, ties by paper_id, nulls last."""
    best = Window.partitionBy(*keys).orderBy(F.col("similarity").desc_nulls_last(), "paper_id")
    return similar.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def _matrix(vectors: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows padded with zeros, their norms and lengths; the length of a null vector, or of one with a null, is -1."""
    flat, size = pc.list_flatten(vectors), pc.list_value_length(vectors).to_numpy()
    if len(size) and not vectors.null_count and not flat.null_count and (size == size[0]).all():
        out = flat.to_numpy().astype(float).reshape(len(size), size[0])
        return out, np.sqrt(_dots(out, out, each=True)), size
    rows = vectors.to_pylist()
    size = np.array([-1 if v is None or None in v else len(v) for v in rows], np.int64)
    out = np.zeros((len(rows), max(size.max(initial=0), 0)))
    for k, v in enumerate(rows):
        if size[k] > 0:
            out[k, : size[k]] = v
    return out, np.sqrt(_dots(out, out, each=True)), size


def _dots(a: np.ndarray, b: np.ndarray, each: bool = False) -> np.ndarray:
    """Sums of products, added from the left as `dot` does: equal vectors give equal sums wherever they stand."""
    out = np.zeros(len(a) if each else (len(a), len(b)))
    for k in range(min(a.shape[1], b.shape[1])):
        out += a[:, k] * b[:, k] if each else a[:, k, None] * b[None, :, k]
    return out


def _scored(theses: tuple, papers: tuple) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First thesis, first paper, similarities and where they are null, of STEP theses to STEP papers at a time; a thesis' papers in order."""
    (t, tn, ts), (p, pn, ps) = theses, papers
    for top in range(0, len(t), STEP):
        mine = slice(top, top + STEP)
        for at in range(0, len(p), STEP):
            part = slice(at, at + STEP)
            norms = tn[mine, None] * pn[None, part]
            null = (norms == 0) | (ts[mine, None] != ps[None, part]) | (ts[mine, None] < 0)
            with np.errstate(all="ignore"):
                yield top, at, np.where(null, 0.0, _dots(t[mine], p[part]) / norms), null


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each value of `g`, which is sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        g = batch["g"].to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(g)) + 1).tolist(), len(g)]
        for a, b in zip(edges, edges[1:]):
            if a < b:
                if held and held[-1]["g"][0].as_py() != g[a]:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _by_blocks(theses: DataFrame, papers: DataFrame, slice_rows: int, score: Callable, vector: str, least_blocks: int = 1, least_slices: int = 1) -> DataFrame:
    """thesis_id, paper_id, lang, similarity: what score(theses, papers) gives, a table at a time, of each block of theses and each slice of
    papers.  Blocks and slices are of bounded size, as their numbers follow the rows counted; papers are repeated once a
    block, theses once a slice, so blocks are as large as a task may hold."""
    parts = lambda n, size, least: max(math.ceil(n / size), min(math.ceil(n / STEP), least), 1)
    blocks, slices = parts(theses.count(), THESES, least_blocks), parts(papers.count(), slice_rows, least_slices)
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    t = theses.select(F.lit(True).alias("thesis"), "thesis_id", F.col(vector).alias("v"), dealt("thesis_id", blocks).alias("b"), every(slices).alias("s"))
    p = papers.select(F.lit(False).alias("thesis"), "paper_id", "lang", F.col(vector).alias("v"), dealt("paper_id", slices).alias("s"), every(blocks).alias("b"))
    both = t.unionByName(p, allowMissingColumns=True).withColumn("g", F.col("b") * slices + F.col("s")).drop("b", "s")
    tasks = min(blocks * slices, MOST_TASKS)
    met = both.repartitionById(tasks, F.pmod("g", F.lit(tasks)).cast("int")).sortWithinPartitions("g")

    def run(batches):
        for rows in _groups(batches):
            yield from (x for told in score(rows.filter(rows["thesis"]), rows.filter(pc.invert(rows["thesis"]))) for x in told.to_batches())

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return met.mapInArrow(run, f"thesis_id {kind(theses, 'thesis_id')}, paper_id {kind(papers, 'paper_id')}, lang {kind(papers, 'lang')}, similarity double")


def all_similarities(theses: DataFrame, papers: DataFrame, vector: str = "embedding") -> DataFrame:
    """D3 without candidate lists: thesis_id, paper_id, lang, similarity of every thesis (thesis_id, embedding) to every
    paper (paper_id, lang, embedding)."""

    def score(t: pa.Table, p: pa.Table) -> Iterator[pa.Table]:
        t, p = t.combine_chunks(), p.combine_chunks()
        for top, at, sim, null in _scored(_matrix(t["v"]), _matrix(p["v"])):
            m, n = sim.shape
            row, col = np.repeat(np.arange(top, top + m), n), np.tile(np.arange(at, at + n), m)
            yield pa.table({"thesis_id": t["thesis_id"].take(row), "paper_id": p["paper_id"].take(col), "lang": p["lang"].take(col), "similarity": pa.array(sim.ravel(), mask=null.ravel())})

    return _by_blocks(theses, papers, PAIR_PAPERS, score, vector, least_slices=LEAST_SLICES)


def all_top_papers(theses: DataFrame, papers: DataFrame, n: int = 30, vector: str = "embedding") -> DataFrame:
    """D4 without candidate lists: the n papers of each language most similar to each thesis, as top_papers ranks them.
    A slice keeps n of each language and thesis while it goes along, so only those are shuffled."""

    def score(t: pa.Table, p: pa.Table) -> Iterator[pa.Table]:
        t, p = t.combine_chunks(), p.combine_chunks().sort_by("paper_id")
        names = p["lang"].combine_chunks().dictionary_encode(null_encoding="encode") if len(p) else None
        these = _matrix(t["v"])
        for k in range(len(names.dictionary) if len(p) and len(t) else 0):
            mine = p.take(np.flatnonzero(names.indices.to_numpy() == k))
            where = best = None
            for top, at, sim, null in _scored(these, _matrix(mine["v"])):
                # nulls go last, NaN first, as Spark sorts; a stable sort leaves ties by paper_id
                order = np.where(null, np.inf, np.where(np.isnan(sim), -np.inf, -sim))
                place = np.broadcast_to(np.arange(at, at + sim.shape[1]), sim.shape)
                where, best = (np.hstack([where, place]), np.hstack([best, order])) if at else (place, order)
                first = np.argsort(best, axis=1, kind="stable")[:, :n]
                where, best = np.take_along_axis(where, first, 1), np.take_along_axis(best, first, 1)
                if at + STEP >= len(mine):
                    row, col, b = np.repeat(np.arange(top, top + len(where)), where.shape[1]), where.ravel(), best.ravel()
                    yield pa.table({"thesis_id": t["thesis_id"].take(row), "paper_id": mine["paper_id"].take(col), "lang": mine["lang"].take(col), "similarity": pa.array(np.where(b == -np.inf, np.nan, -b), mask=b == np.inf)})

    return top_papers(_by_blocks(theses, papers, BEST_PAPERS, score, vector, least_blocks=LEAST_BLOCKS), n)


def matching_papers(queries: DataFrame, papers: DataFrame, fields: dict[str, list[str]], default_cutoff: str = "20220101") -> DataFrame:
    """qid, pos, pub_date: papers of the query's language, published by its cut-off, whose field holds all of `all`,
    one of `any` (if given) and none of `none`; every one, without a rank.

    queries: qid, lang, cutoff, field, all, any, none.  fields maps a field code to the columns it searches.
    Papers stay where they are: up to MOST_QUERIES queries, counted first, are broadcast.  More of them meet the papers by
    language and a paper's share of SALTS, so that no language is one task; terms are short-circuited either way, the
    longest (the rarest, as a rule) first.
    """
    texts = papers.select("pos", "lang", "pub_date", *[F.lower(F.concat_ws("\n", *cols)).alias(f"f_{code}") for code, cols in fields.items()])
    lowered = {c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda w: F.lower(w)) for c in ("all", "any", "none")}
    longest_first = lambda c: F.reverse(F.array_sort(F.transform(c, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))).getField("w")
    asked = queries.select("qid", "lang", "field", F.coalesce("cutoff", F.lit(default_cutoff)).alias("cutoff"), *[longest_first(c).alias(k) for k, c in lowered.items()])
    if queries.limit(MOST_QUERIES + 1).count() <= MOST_QUERIES:
        met = texts.join(F.broadcast(asked), "lang")
    else:
        share = F.pmod(F.xxhash64("pos"), F.lit(SALTS)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        met = texts.withColumn("salt", share).join(asked.withColumn("salt", every), ["lang", "salt"])
    met = met.where(F.date_format("pub_date", "yyyyMMdd") <= F.col("cutoff"))
    hay = F.coalesce(*[F.when(F.col("field") == code, F.col(f"f_{code}")) for code in fields])
    has = lambda w: F.instr(hay, w) > 0
    ok = F.forall("all", has) & ((F.size("any") == 0) | F.exists("any", has)) & ~F.exists("none", has)
    return met.where(ok).select("qid", "pos", "pub_date")


def search_papers(queries: DataFrame, papers: DataFrame, fields: dict[str, list[str]], n: int = 50, default_cutoff: str = "20220101") -> DataFrame:
    """Qid, paper pos, rank: the matching papers, newest first, n a query."""
    newest = Window.partitionBy("qid").orderBy(F.col("pub_date").desc(), "pos")
    met = matching_papers(queries, papers, fields, default_cutoff)
    return met.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n).select("qid", "pos", "rank")


def query_verdict(queries: DataFrame, results: DataFrame, most: int = 200) -> DataFrame:
    """Qid, n, verdict from all matches (qid): expand if nothing was found, narrow if over `most`, else valid."""
    n = results.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    told = queries.select("qid").distinct().join(n, "qid", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n"))
    return told.withColumn("verdict", F.when(F.col("n") == 0, "expand").when(F.col("n") > most, "narrow").otherwise("valid"))


def rounds_until(rounds: DataFrame, most: int = 500, max_rounds: int = 5, keys=("thesis_id", "lang")) -> DataFrame:
    """Rounds begun before the results so far reached `most`, and no later than max_rounds."""
    so_far = F.sum("n").over(Window.partitionBy(*keys).orderBy("round").rowsBetween(Window.unboundedPreceding, -1))
    return rounds.withColumn("before", F.coalesce(so_far, F.lit(0))).where((F.col("before") < most) & (F.col("round") <= max_rounds))


def missing_references(top: DataFrame, refs: DataFrame | None = None, per_lang: int = 3, most: int = 6) -> DataFrame:
    """Up to `most` suggested papers a thesis, `per_lang` a language.  With refs (thesis_id, title), papers whose
    normalised title is among the references are left out first."""
    if refs is not None:
        known = refs.select("thesis_id", F.lower(strip("title")).alias("t")).distinct()
        top = top.join(known, (top["thesis_id"] == known["thesis_id"]) & (F.lower(strip("Title")) == known["t"]), "left_anti")
    by_lang = Window.partitionBy("thesis_id", "lang").orderBy("rank")
    picked = top.withColumn("r", F.row_number().over(by_lang)).where(F.col("r") <= per_lang)
    return picked.withColumn("n", F.row_number().over(Window.partitionBy("thesis_id").orderBy("lang", "r"))).where(F.col("n") <= most).drop("r", "n")


def paper_score(as_of: int = 2025) -> Column:
    """0.1 a download, 5 a citation, 50 if funded, 100 a national fund, 30 a known institution, 50 or 20 for recency."""
    some = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(0)
    named = lambda arr, words: F.coalesce(
        F.size(F.filter(arr, lambda x: x.rlike("|".join(words)))), F.lit(0)
    )
    national = F.when(F.size("Funds") > 0, named(F.col("Funds.title"), NATIONAL_FUNDS)).otherwise(0)
    known = F.when(F.size("Affiliations") > 0, named(F.col("Affiliations.name"), KNOWN_INSTITUTIONS)).otherwise(0)
    year = F.col("PublicationYear").try_cast("int")
    recent = F.when(year >= as_of - 2, 50).when(year >= as_of - 5, 20).otherwise(0)
    return (
        F.coalesce(some("Metrics.download_count"), F.lit(0)) * 0.1 + F.coalesce(some("Metrics.citation_count"), F.lit(0)) * 5
        + F.when(F.size("Funds") > 0, 50).otherwise(0) + national * 100 + known * 30 + recent
    )


def score_papers(papers: DataFrame, n: int = 20, as_of: int = 2025) -> DataFrame:
    """The n papers of the largest score, ties by pos."""
    return papers.withColumn("score", F.round(paper_score(as_of), 6)).orderBy(F.col("score").desc(), "pos").limit(n)


def best_candidate(candidates: DataFrame, lengths: dict[str, tuple[int, int]], longest=("title_cn", "title_en")) -> DataFrame:
    """doc_id, field, value from rows (doc_id, field, n, value): the first of a length in the field's bounds; without
    one, the longest for titles and the first for other fields."""
    bounds = F.create_map(*[x for f, (lo, hi) in lengths.items() for x in (F.lit(f), F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))])
    b, size = bounds[F.col("field")], F.length("value")
    fits = F.coalesce(size.between(b["lo"], b["hi"]), F.lit(True))
    fallback = F.when(~fits & F.col("field").isin(*longest), -size).otherwise(0)
    best = Window.partitionBy("doc_id", "field").orderBy(fits.desc(), fallback, "n")
    return candidates.withColumn("r", F.row_number().over(best)).where("r = 1").select("doc_id", "field", "value")


def long_form(df: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """key, field, value rows of the fields that are not blank."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), blank_to_null(F.col(f).cast("string")).alias("value")) for f in fields])
    return df.select(key, F.explode(pairs).alias("x")).select(key, "x.field", "x.value").where("value IS NOT NULL")


def compare_extractions(a: DataFrame, b: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """Key, field, status (only_a, only_b, differs) for fields that differ between two runs."""
    la = long_form(a, fields, key).withColumnRenamed("value", "va")
    lb = long_form(b, fields, key).withColumnRenamed("value", "vb")
    both = la.join(lb, [key, "field"], "full_outer").where(~F.col("va").eqNullSafe(F.col("vb")))
    return both.select(key, "field", F.when(F.col("vb").isNull(), "only_a").when(F.col("va").isNull(), "only_b").otherwise("differs").alias("status"))


def improvement(a: DataFrame, b: DataFrame, fields: list[str], key: str = "doc_id", total: int = 33) -> DataFrame:
    """Fields filled before and after, their difference and its share of `total`, and the fields that were gained."""
    la, lb = long_form(a, fields, key).withColumn("a", F.lit(1)).drop("value"), long_form(b, fields, key).withColumn("b", F.lit(1)).drop("value")
    both = la.join(lb, [key, "field"], "full_outer")
    return both.groupBy(key).agg(
        F.count("a").alias("before"), F.count("b").alias("after"), (F.count("b") - F.count("a")).alias("delta"),
        F.round((F.count("b") - F.count("a")) / total, 9).alias("rate"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("a").isNull(), F.col("field")))), ",").alias("gained"),
    )


def fill_from(a: DataFrame, b: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """A with its blank fields filled from b."""
    other = b.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    return a.join(other, key, "left").select(
        *[F.coalesce(blank_to_null(F.col(c)), F.col(f"__{c}")).alias(c) if c in fields else F.col(c) for c in a.columns]
    )
