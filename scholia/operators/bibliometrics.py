"""Bibliometric aggregates over paper records.

Counts are long tables (metric, name, n).  Ties of a top list go by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.papers import fund_source, institution_type, is_person_name, paper_keywords, theme_category
from scholia.functions.text import blank_to_null, strip


def top(counts: DataFrame, n: int, name: str = "name", of: str = "n") -> DataFrame:
    """The n largest counts; a sort with a limit, which keeps n rows a task."""
    return counts.orderBy(F.col(of).desc(), F.col(name)).limit(n)


def counted(rows: DataFrame, name: Column) -> DataFrame:
    return rows.select(blank_to_null(name.cast("string")).alias("name")).where("name IS NOT NULL").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def _tagged(metric: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(metric).alias("metric"), "name", F.col("n").cast("long").alias("n"))


def _distinct(metric: str, rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(metric).alias("metric"), F.lit(None).cast("string").alias("name"), "n")


def _union(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def year_of(c: Column, low: int = 1900, high: int = 2030) -> Column:
    """A publication year as an int, null outside low..high or where it is no number."""
    year = F.floor(c.try_cast("double")).cast("int")
    return F.when(year.between(low, high), year)


def journal_stats(p: DataFrame, n: int = 15) -> DataFrame:
    """A1: top journals, source types, distinct journals."""
    journals = counted(p, F.col("Journal"))
    return _union(_tagged("journal", top(journals, n)), _tagged("type", counted(p, F.col("Source.type"))), _distinct("distinct_journals", journals))


def _ranked(counts: DataFrame, limits: dict[str, int]) -> DataFrame:
    """The largest counts (metric, name, n) of each metric, as many as its limit."""
    limit = None
    for k, v in limits.items():
        limit = F.when(F.col("metric") == k, v) if limit is None else limit.when(F.col("metric") == k, v)
    r = F.row_number().over(Window.partitionBy("metric").orderBy(F.col("n").desc(), "name"))
    return counts.withColumn("r", r).where(F.col("r") <= max(limits.values())).where(F.col("r") <= limit).select("metric", "name", F.col("n").cast("long").alias("n"))


def _totals(counts: DataFrame, **made: Column) -> DataFrame:
    """One row (metric, null, n) for each aggregate over all counts."""
    one = counts.agg(*[F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in made.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.lit(None).cast("string").alias("name"), F.col(k).alias("n")) for k in made])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def _authors(p: DataFrame) -> DataFrame:
    return p.select("pos", "FirstAuthor", F.explode("Authors").alias("a")).select("pos", "a.name", "a.corresponding")


def author_stats(p: DataFrame, n: int = 20, n_corresponding: int = 10) -> DataFrame:
    """A2: top authors, top corresponding authors, distinct numbers of both, from one count by metric and name."""
    named = p.select(F.explode("Authors").alias("a")).select("a.name", "a.corresponding").where(blank_to_null(F.col("name")).isNotNull())
    metric = F.explode(F.array_compact(F.array(F.lit("author"), F.when(F.col("corresponding"), "corresponding"))))
    counts = named.select(metric.alias("metric"), "name").groupBy("metric", "name").agg(F.count(F.lit(1)).alias("n"))
    return _ranked(counts, {"author": n, "corresponding": n_corresponding}).unionByName(
        # of the same columns as above, so that the counts are shuffled once for both
        _totals(counts, distinct_authors=F.count_if((F.col("metric") == "author") & (F.col("n") > 0)), distinct_corresponding=F.count_if((F.col("metric") == "corresponding") & (F.col("n") > 0)))
    )


def affiliation_stats(p: DataFrame, n: int = 20) -> DataFrame:
    """A3: top affiliations and their number."""
    found = counted(p.select(F.explode("Affiliations.name").alias("name")), F.col("name"))
    return _union(_tagged("affiliation", top(found, n)), _distinct("distinct_affiliations", found))


def core_index_stats(p: DataFrame) -> DataFrame:
    """A4: papers by core index, and mentions in all."""
    found = counted(p.select(F.explode("CoreJournalIndexes.name").alias("name")), F.col("name"))
    total = found.agg(F.sum("n").alias("n")).select(F.lit("total").alias("metric"), F.lit(None).cast("string").alias("name"), "n")
    return _union(_tagged("core_index", found), total)


def subject_stats(p: DataFrame, n1: int = 10, n2: int = 15) -> DataFrame:
    """A5: subjects of both levels by one pass over grouping sets."""
    subjects = p.select(F.col("Repository.subject_category_1").alias("s1"), F.col("Repository.subject_category_2").alias("s2"))
    sets = subjects.groupingSets([["s1"], ["s2"]], "s1", "s2").agg(F.grouping("s1").alias("level2"), F.count(F.lit(1)).alias("n"))
    named = sets.select("level2", blank_to_null(F.coalesce("s1", "s2")).alias("name"), "n").where("name IS NOT NULL")
    one, two = named.where("level2 = 0"), named.where("level2 = 1")
    return _union(_tagged("subject_1", top(one, n1)), _tagged("subject_2", top(two, n2)), _distinct("distinct_1", one), _distinct("distinct_2", two))


def year_stats(p: DataFrame) -> DataFrame:
    """Papers by year, first and last year, distinct years."""
    years = p.select(year_of(F.col("PublicationYear")).alias("y")).where("y IS NOT NULL").groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    ends = years.agg(F.min("y").alias("earliest"), F.max("y").alias("latest"), F.count(F.lit(1)).alias("span")).select(
        F.explode(F.create_map(*[x for k in ("earliest", "latest", "span") for x in (F.lit(k), F.col(k).cast("long"))])).alias("metric", "n")
    )
    return _union(
        _tagged("year", years.select(F.col("y").cast("string").alias("name"), "n")),
        ends.where("n IS NOT NULL").select("metric", F.lit(None).cast("string").alias("name"), "n"),
    )


def citation_stats(p: DataFrame, strict: bool = False) -> DataFrame:
    """Sum, mean and maximum of citations and downloads, a missing one counting 0.
    strict leaves out papers whose year is no number from 1900 to 2030."""
    if strict:
        p = p.where(year_of(F.col("PublicationYear")).isNotNull() | blank_to_null(F.col("PublicationYear")).isNull())
    cited, loaded = (F.coalesce(F.col(f"Metrics.{k}"), F.lit(0)) for k in ("citation_count", "download_count"))
    return p.agg(*[
        f(c).cast(t).alias(f"{k}_{n}") for k, c in (("citations", cited), ("downloads", loaded))
        for n, f, t in (("sum", F.sum, "long"), ("mean", F.avg, "double"), ("max", F.max, "long"))
    ])


def paper_totals(p: DataFrame) -> DataFrame:
    """Papers, and those with a core index, citations and funds, by language and in all."""
    return p.rollup("lang").agg(
        F.count(F.lit(1)).alias("papers"), F.count_if(F.size("CoreJournalIndexes") > 0).alias("with_core_index"),
        F.count_if(F.coalesce(F.col("Metrics.citation_count"), F.lit(0)) > 0).alias("with_citations"), F.count_if(F.size("Funds") > 0).alias("with_funds"),
    )


def author_network(p: DataFrame) -> DataFrame:
    """Papers with a person as author, corresponding mentions, and top lists of persons, from one count by metric and name."""
    row = lambda metric, name: F.struct(F.lit(metric).alias("metric"), name.alias("name"))
    people = F.filter("Authors", lambda a: is_person_name(a["name"]))
    first = F.when((F.size("Authors") > 0) & is_person_name(F.col("FirstAuthor")), blank_to_null(F.col("FirstAuthor")))
    told = lambda found: F.concat(
        F.transform(found, lambda a: row("author", a["name"])), F.transform(F.filter(found, lambda a: a["corresponding"]), lambda a: row("corresponding", a["name"])),
        F.array_compact(F.array(F.when(first.isNotNull(), row("first_author", first)), F.when(F.size(found) > 0, row("paper", F.lit(""))))),
    )
    told = F.get(F.transform(F.array(people), told), F.lit(0))  # the people are found once a paper
    counts = p.select("FirstAuthor", F.coalesce("Authors", F.array().cast(p.schema["Authors"].dataType)).alias("Authors")).select(F.explode(told).alias("x")).groupBy("x.metric", "x.name").agg(F.count(F.lit(1)).alias("n"))
    of = lambda m: F.sum(F.when(F.col("metric") == m, F.col("n")))
    # the metric without a limit drops out of the ranking, not of the counts, which are shuffled once for both parts
    return _ranked(counts, {"author": 8, "corresponding": 5, "first_author": 5}).unionByName(
        _totals(counts, papers_with_authors=of("paper"), corresponding_total=of("corresponding"))
    )


def institution_profile(p: DataFrame) -> DataFrame:
    """A10: papers with institutions, top institutions, their number and types."""
    named = p.select(F.explode("Affiliations.name").alias("name"))
    found = counted(named, F.col("name"))
    return _union(
        _tagged("institution", top(found, 10)), _tagged("type", counted(named, institution_type(F.col("name")))),
        _distinct("distinct_institutions", found), _distinct("papers_with_institutions", p.where(F.size("Affiliations") > 0)),
    )


def venue_profile(p: DataFrame) -> DataFrame:
    """Top venues, source types, and the latest eight years with their papers."""
    years = counted(p, F.coalesce(blank_to_null(F.col("Source.year")), F.col("PublicationYear")))
    return _union(
        _tagged("venue", top(counted(p, F.coalesce(blank_to_null(F.col("Source.title")), F.col("Journal"))), 8)),
        _tagged("type", counted(p.where("Source IS NOT NULL"), F.coalesce(blank_to_null(F.col("Source.type")), F.lit("Unknown")))),
        _tagged("year", years.orderBy(F.col("name").desc()).limit(8)),
    )


def funding_profile(p: DataFrame) -> DataFrame:
    """Source of funds: count and percent of funded papers, with the share funded and its band."""
    base = p.agg(F.count(F.lit(1)).alias("papers"), F.count_if(F.size("Funds") > 0).alias("funded"))
    kinds = p.select(F.explode("Funds.title").alias("t")).where(blank_to_null(F.col("t")).isNotNull()).groupBy(fund_source(F.col("t")).alias("fund")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("funded") * 100.0 / F.col("papers")
    return kinds.crossJoin(F.broadcast(base)).select(  # base is one row
        "fund", "n", F.round(F.col("n") * 100.0 / F.col("funded"), 6).alias("percent"), F.round(share, 6).alias("funded_percent"),
        F.when(share > 70, "high").when(share > 40, "medium").otherwise("low").alias("density"),
    )


def impact_profile(p: DataFrame) -> DataFrame:
    """Over positive counts: sum, mean, maximum and how many exceed twice the mean."""
    found = p.select(F.explode(F.create_map(
        F.lit("downloads"), F.col("Metrics.download_count").cast("long"), F.lit("citations"), F.col("Metrics.citation_count").cast("long")
    )).alias("metric", "v")).where("v > 0")
    # papers by value, counted once: both steps below read these counts
    values = found.groupBy("metric", "v").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum(F.col("v") * F.col("n"))
    base = values.groupBy("metric").agg(total.alias("total"), (total / F.sum("n")).alias("mean"), F.max("v").alias("largest"), F.sum("n").alias("papers"))
    high = values.join(F.broadcast(base.select("metric", "mean")), "metric").groupBy("metric").agg(F.sum(F.when(F.col("v") > 2 * F.col("mean"), F.col("n")).otherwise(0)).alias("high"))  # base has two rows
    return base.join(high, "metric")


def keyword_trends(p: DataFrame, n: int = 12, years: int = 3, per_year: int = 3) -> DataFrame:
    """Top keywords with percent of papers, and the top of each of the latest years."""
    # papers are gone through once: a null name stands for the paper itself
    names = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(paper_keywords(), F.array().cast("array<string>")))
    counts = p.select(F.col("PublicationYear").alias("year"), F.explode(names).alias("name")).groupBy("year", "name").agg(F.count(F.lit(1)).alias("n"))
    scope = lambda whole, c: F.struct(F.lit(whole).alias("whole"), c.alias("scope"))
    scopes = F.array_compact(F.array(scope(True, F.lit("all")), F.when(blank_to_null(F.col("year")).isNotNull(), scope(False, F.col("year")))))
    sums = counts.select(F.explode(scopes).alias("s"), "name", "n").groupBy("s.whole", "s.scope", "name").agg(F.sum("n").alias("n")).withColumn("paper", F.col("name").isNull())
    best = Window.partitionBy("whole", "scope", "paper").orderBy(F.col("n").desc(), "name")
    ranked = sums.withColumn("r", F.row_number().over(best)).where(F.col("r") <= max(n, per_year)).where(F.col("r") <= F.when(F.col("whole"), n).otherwise(per_year))
    # what is left are a few rows a year
    told = ranked.withColumn("papers", F.max(F.when(F.col("whole") & F.col("paper"), F.col("n"))).over(Window.partitionBy(F.lit(0)))).where("NOT paper")
    latest = F.dense_rank().over(Window.partitionBy("whole").orderBy(F.col("scope").desc()))
    return told.withColumn("d", latest).where(F.col("whole") | (F.col("d") <= years)).select(
        "scope", "name", "n", F.when(F.col("whole"), F.round(F.col("n") * 100.0 / F.col("papers"), 6)).alias("percent"))


def theme_rows(p: DataFrame) -> DataFrame:
    """lang, theme: keyword strings split on ;; for Chinese and ; otherwise."""
    parts = F.when(F.col("lang") == "Chinese", F.split("KeyWords", ";;")).otherwise(F.split("KeyWords", ";"))
    return p.select("lang", F.explode(parts).alias("t")).select("lang", strip("t").alias("theme")).where("theme != ''")


def theme_stats(p: DataFrame) -> DataFrame:
    """Mentions of each theme by language."""
    return theme_rows(p).groupBy("lang", "theme").agg(F.count(F.lit(1)).alias("n"))


def top_themes(p: DataFrame, n: int = 10) -> DataFrame:
    """Top themes over all languages."""
    return top(theme_rows(p).groupBy(F.col("theme").alias("name")).agg(F.count(F.lit(1)).alias("n")), n)


def hotspots(p: DataFrame) -> DataFrame:
    """Theme mentions by category, with their share of those that have one."""
    n = theme_rows(p).select(theme_category(F.col("theme")).alias("category")).where("category IS NOT NULL").groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("category", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))  # one row


def recent_share(p: DataFrame, since: int = 2020) -> DataFrame:
    """Share of papers from `since` on, first and last year, by language and in all."""
    y = year_of(F.col("PublicationYear"))
    return p.rollup("lang").agg(
        F.avg(F.when(y >= since, 1.0).otherwise(0.0)).alias("recent"), F.min(y).alias("earliest"), F.max(y).alias("latest"),
        (F.max(y) - F.min(y) + 1).alias("years"),
    )


def stage_counts(stages: DataFrame) -> DataFrame:
    """Papers by stage and language with all subtotals, from rows stage, lang."""
    return stages.cube("stage", "lang").agg(F.count(F.lit(1)).alias("n"))


def metadata_report(p: DataFrame) -> DataFrame:
    """Latest ten years; top authors and affiliations of more than one paper; top subjects."""
    # papers are gone through once
    item = lambda metric, c: F.struct(F.lit(metric).alias("metric"), c.cast("string").alias("name"))
    items = lambda metric, c: F.coalesce(F.transform(c, lambda x: item(metric, x)), F.array().cast("array<struct<metric string, name string>>"))
    own = F.array(item("year", year_of(F.col("PublicationYear"))), item("subject_1", F.col("Repository.subject_category_1")))
    named = p.select(F.explode(F.concat(own, items("author", F.col("Authors.name")), items("affiliation", F.col("Affiliations.name")))).alias("x"))
    counts = named.select("x.metric", blank_to_null(F.col("x.name")).alias("name")).where("name IS NOT NULL").groupBy("metric", "name").agg(F.count(F.lit(1)).alias("n"))
    latest = F.when(F.col("metric") == "year", F.col("name")).desc()
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("metric").orderBy(latest, F.col("n").desc(), "name"))).where("r <= 10")
    return ranked.where(F.when(F.col("metric") == "subject_1", F.col("r") <= 8).otherwise((F.col("metric") == "year") | (F.col("n") > 1))).select("metric", "name", "n")


def theme_lookup(p: DataFrame, terms: list[str]) -> DataFrame:
    """Mentions of the given terms among the themes, by language."""
    return theme_rows(p).where(F.col("theme").isin(terms)).groupBy("lang", "theme").agg(F.count(F.lit(1)).alias("n"))


def literature_context(p: DataFrame, by: str = "thesis_id", themes: int = 5, titles: int = 2, cap: int = 800) -> DataFrame:
    """One short text per thesis: counts, top themes, recent share, and titles."""
    rank = Window.partitionBy(by)
    y = year_of(F.col("PublicationYear"))
    counts = p.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(y >= 2020, 1.0).otherwise(0.0)).alias("recent"))
    parts = F.when(F.col("lang") == "Chinese", F.split("KeyWords", ";;")).otherwise(F.split("KeyWords", ";"))
    named = p.select(by, F.explode(parts).alias("t")).select(by, strip("t").alias("theme")).where("theme != ''").groupBy(by, "theme").agg(F.count(F.lit(1)).alias("m"))
    best = named.withColumn("r", F.row_number().over(rank.orderBy(F.col("m").desc(), "theme"))).where(F.col("r") <= themes)
    best = best.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "theme"))), lambda x: x["theme"]), ", ").alias("themes"))
    first = p.withColumn("r", F.row_number().over(rank.orderBy("pos"))).where(F.col("r") <= titles)
    first = first.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "Title"))), lambda x: x["Title"]), "; ").alias("titles"))
    whole = counts.join(best, by, "left").join(first, by, "left")
    text = F.concat_ws(
        " | ", F.concat(F.lit("papers: "), F.col("n").cast("string")), F.concat(F.lit("themes: "), F.coalesce("themes", F.lit(""))),
        F.concat(F.lit("recent: "), F.round(F.col("recent") * 100).cast("int").cast("string"), F.lit("%")), F.concat(F.lit("titles: "), F.coalesce("titles", F.lit(""))),
    )
    return whole.select(by, F.substring(text, 1, cap).alias("context"))
