"""Scores of literature reviews and of extractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.papers import research_layers
from scholia.functions.text import blank_to_null, count_references, strip
from scholia.operators.bibliometrics import year_of
from scholia.operators.ranking import long_form

# Fixed words of authoritative venues.
AUTHORITY = ("ieee", "acm", "学报", "journal", "transactions")


def band(c: Column, *steps: tuple[float, str], otherwise: str) -> Column:
    out = None
    for least, name in steps:
        out = F.when(c >= least, name) if out is None else out.when(c >= least, name)
    return out.otherwise(otherwise)


def over(c: Column, *steps: tuple[float, str], otherwise: str) -> Column:
    """As band, with `greater than`."""
    out = None
    for least, name in steps:
        out = F.when(c > least, name) if out is None else out.when(c > least, name)
    return out.otherwise(otherwise)


def review_rating(theses: DataFrame, papers: DataFrame) -> DataFrame:
    """thesis_id, ratings of coverage, depth and relevance, an overall class and suggestions, from theses
    (thesis_id, references as text, review) and the number of papers found for each."""
    n = papers.groupBy("thesis_id").agg(F.count(F.lit(1)).alias("papers"), F.count_if(F.col("lang") == "Chinese").alias("chinese"))
    t = theses.select("thesis_id", count_references(F.col("references")).alias("refs"), F.length(F.coalesce("review", F.lit(""))).alias("size"))
    j = t.join(n, "thesis_id", "left").fillna(0, ["papers", "chinese"])
    ratio, size = F.col("refs") / F.greatest("papers", F.lit(1)), F.col("size")
    suggestions = F.array_compact(F.array(
        F.when(ratio < 0.1, "more references"), F.when((size > 0) & (size < 1500), "deeper review"), F.when(F.col("papers") < 15, "wider search")
    ))
    return j.select(
        "thesis_id", "refs", "papers", F.round(ratio, 9).alias("ratio"), over(ratio, (0.3, "excellent"), (0.1, "good"), otherwise="weak").alias("coverage"),
        over(size, (2000, "excellent"), (1000, "good"), otherwise="weak").alias("depth"), over(F.col("chinese"), (20, "excellent"), (10, "good"), otherwise="weak").alias("relevance"),
        F.when((ratio > 0.3) & (size > 2000), "excellent").when((ratio > 0.1) & (size > 1000), "good").otherwise("improvable").alias("overall"),
        F.when(F.size(suggestions) > 0, F.array_join(suggestions, ", ")).otherwise("keep").alias("suggestions"),
    )


def coverage_level(theses: DataFrame, papers: DataFrame) -> DataFrame:
    """Share of references to papers found, at most 1, and its level."""
    n = papers.groupBy("thesis_id").agg(F.count(F.lit(1)).alias("papers"))
    lines = F.size(F.filter(F.split(F.coalesce("references", F.lit("")), "\n"), lambda x: strip(x) != ""))
    ratio = F.least(F.lit(1.0), F.col("refs") / F.greatest(F.coalesce("papers", F.lit(0)), F.lit(1)))
    j = theses.select("thesis_id", lines.alias("refs")).join(n, "thesis_id", "left")
    return j.select("thesis_id", F.round(ratio, 9).alias("ratio"), band(ratio, (0.7, "excellent"), (0.5, "good"), (0.3, "fair"), otherwise="weak").alias("level"))


def review_depth(papers: DataFrame, by: str = "thesis_id", as_of: int = 2025) -> DataFrame:
    """layers/4 * 40 + share with 3+ keywords * 30 + share of five years * 20 + share of authoritative venues * 10."""
    flags = research_layers()
    year = year_of(F.col("PublicationYear"), 0, 9999)
    told = papers.select(
        by, *[v.cast("int").alias(k) for k, v in flags.items()],
        F.coalesce(F.size(F.split("KeyWords", ";;")) >= 3, F.lit(False)).cast("int").alias("rich"), F.coalesce(as_of - year <= 5, F.lit(False)).cast("int").alias("recent"),
        F.coalesce(F.lower("Source.title").rlike("|".join(AUTHORITY)), F.lit(False)).cast("int").alias("authority"),
    )
    sums = told.groupBy(by).agg(*[F.max(k).alias(k) for k in flags], *[F.avg(k).alias(k) for k in ("rich", "recent", "authority")], F.count(F.lit(1)).alias("papers"))
    layers = sum((F.coalesce(F.col(k), F.lit(0)) for k in flags), F.lit(0))
    score = layers / 4 * 40 + F.col("rich") * 30 + F.col("recent") * 20 + F.col("authority") * 10
    return sums.select(
        by, "papers", layers.alias("layers"), F.round(score, 9).alias("score"),
        band(score, (85, "excellent"), (70, "good"), (55, "medium"), (40, "fair"), otherwise="weak").alias("level"),
    )


def relevance_level(similar: DataFrame, by: str = "thesis_id", least: float = 0.6, constant: float | None = None) -> DataFrame:
    """Share of papers of at least `least` similarity (or a constant share) and its level."""
    share = F.avg((F.col("similarity") >= least).cast("int")) if constant is None else F.max(F.lit(constant))
    told = similar.groupBy(by).agg(F.round(share, 9).alias("share"))
    return told.select(by, "share", band(F.col("share"), (0.8, "high"), (0.6, "fair"), (0.4, "partial"), otherwise="weak").alias("level"))


def reference_years(theses: DataFrame, as_of: int = 2025) -> DataFrame:
    """thesis_id, year: every four-digit year from 1900 to as_of in the references."""
    years = F.regexp_extract_all("references", F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    return theses.select("thesis_id", F.explode(years).alias("y")).select("thesis_id", F.col("y").cast("int").alias("year")).where(F.col("year") <= as_of)


def timeliness(years: DataFrame, by: str = "thesis_id", as_of: int = 2025) -> DataFrame:
    """Share of years within five and two of as_of, mean age and level, from rows (by, year)."""
    age = as_of - F.col("year")
    told = years.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg((age <= 5).cast("int")).alias("recent"), F.avg((age <= 2).cast("int")).alias("latest"), F.round(F.avg(age), 9).alias("mean_age")
    )
    r, v = F.col("recent"), F.col("latest")
    level = F.when((r >= 0.6) & (v >= 0.3), "excellent").when((r >= 0.4) & (v >= 0.2), "good").when(r >= 0.3, "fair").otherwise("weak")
    return told.select(by, "n", F.round(r, 9).alias("recent"), F.round(v, 9).alias("latest"), "mean_age", level.alias("level"))


def filled(fields: list[str]) -> Column:
    """How many of the fields are not blank."""
    return sum((F.when(blank_to_null(F.col(f).cast("string")).isNotNull(), 1).otherwise(0) for f in fields), F.lit(0))


def extraction_quality(df: DataFrame, fields: list[str], title: str, n_refs: Column, key: str = "doc_id") -> DataFrame:
    """Fields filled, their share, and quality = 0.6 share + 0.2 with a title + 0.2 with over ten references."""
    share = F.least(F.lit(1.0), filled(fields) / len(fields))
    quality = share * 0.6 + F.when(blank_to_null(F.col(title)).isNotNull(), 0.2).otherwise(0.0) + F.when(n_refs > 10, 0.2).otherwise(0.0)
    return df.select(key, filled(fields).alias("filled"), F.round(share, 9).alias("confidence"), F.round(quality, 9).alias("quality"))


def section_insights(sections: DataFrame, per_kind: int = 2, most: int = 10) -> DataFrame:
    """doc_id, rank, section, kind, insight: up to two strengths and two suggestions of each section, and a flag for
    scores below 6; ten a document.  sections: doc_id, ord, section, score, strengths, suggestions."""
    entry = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("insight"))
    low = F.when(F.col("score") < 6, F.array(F.struct(F.lit("low_score").alias("kind"), F.col("score").cast("string").alias("insight"))))
    parts = [F.transform(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, per_kind), entry(k)) for c, k in (("strengths", "strength"), ("suggestions", "suggestion"))]
    parts.append(F.coalesce(low, F.array().cast("array<struct<kind:string,insight:string>>")))
    rows = sections.select("doc_id", "ord", "section", F.posexplode(F.concat(*parts)).alias("k", "x")).select("doc_id", "ord", "section", "k", "x.*")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "k")))
    return ranked.where(F.col("rank") <= most).drop("k")


def evaluation_summary(theses: DataFrame, **parts: DataFrame) -> DataFrame:
    """One row a thesis with all columns of the parts, each prefixed by its name."""
    out = theses.select("thesis_id")
    for name, part in parts.items():
        out = out.join(part.select("thesis_id", *[F.col(c).alias(f"{name}_{c}") for c in part.columns if c != "thesis_id"]), "thesis_id", "left")
    return out


def validate_fields(df: DataFrame, number: str, author: str, title: str, key: str = "doc_id") -> DataFrame:
    """Flags for a number of 8-20 capitals and digits, a name of 2-8 characters and a title of 10 or more, and what failed;
    a blank field passes."""
    ok = {
        "number": ~F.coalesce(blank_to_null(F.col(number)).isNotNull() & ~F.col(number).rlike("^[A-Z0-9]{8,20}$"), F.lit(False)),
        "author": ~F.coalesce(blank_to_null(F.col(author)).isNotNull() & ~F.length(author).between(2, 8), F.lit(False)),
        "title": ~F.coalesce(blank_to_null(F.col(title)).isNotNull() & (F.length(title) < 10), F.lit(False)),
    }
    failed = F.array_join(F.array_compact(F.array(*[F.when(~v, k) for k, v in ok.items()])), ",")
    return df.select(key, *[v.alias(f"{k}_ok") for k, v in ok.items()], failed.alias("failed"))


# Fixed weights: of six core fields, and of the second scheme.
CORE = {"title_cn": (0.15, 0), "author_cn": (0.10, 0), "university_cn": (0.10, 0), "degree_level": (0.08, 0), "abstract_cn": (0.12, 500), "references": (0.10, 50)}
SECOND = {"title_cn": (0.2, 10), "author_cn": (0.15, 0), "abstract_cn": (0.25, 500), "references": (0.2, 50)}


def weighted_confidence(df: DataFrame, fields: list[str], weights: dict = CORE, second: bool = False, key: str = "doc_id") -> DataFrame:
    """A weight for each field over its length, plus up to 0.35 for completeness, at most 1; or by the second scheme
    0.2 for over 15 fields, with quality = 0.4 completeness + 0.6 confidence.  Missing fields are listed."""
    have = [c for c in weights if c in df.columns]
    base = sum((F.when(F.length(strip(F.col(c).cast("string"))) > weights[c][1], weights[c][0]).otherwise(0.0) for c in have), F.lit(0.0))
    share = filled(fields) / len(fields)
    bonus = F.when(filled(fields) > 15, 0.2).otherwise(0.0) if second else F.least(F.lit(0.35), share * 0.35)
    confidence = F.least(F.lit(1.0), base + bonus)
    missing = F.array_join(F.array_compact(F.array(*[F.when(blank_to_null(F.col(f).cast("string")).isNull(), f) for f in fields])), ",")
    return df.select(
        key, F.round(share, 9).alias("completeness"), F.round(confidence, 9).alias("confidence"), F.round(share * 0.4 + confidence * 0.6, 9).alias("quality"), missing.alias("missing")
    )


def fill_rates(df: DataFrame, fields: list[str], key: str = "doc_id") -> DataFrame:
    """Field, share of rows that have it, mean length of those."""
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    told = long_form(df, fields, key).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("value")), 9).alias("mean_length"))
    return told.crossJoin(F.broadcast(total)).select("field", F.round(F.col("n") / F.col("rows"), 9).alias("rate"), "mean_length")  # total is one row
