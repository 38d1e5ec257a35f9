"""Documents cut into sections, batches and chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from scholia.functions.text import SPACE, blank_to_null, is_chinese, section_type, strip
from scholia.operators.lines import doc_window, each_text, in_order, lines_of

# Fixed patterns of title lines, in this order; the last two take unnumbered lines.
NUMBERED_TITLES = (
    r"^(\d+(?:\.\d+)*\.?)\s*(.+?)(?:\s*\.{3,}.*)?$",
    r"^([一二三四五六七八九十百]+[、．.]|（[一二三四五六七八九十百]+）)\s*(.+?)(?:\s*\.{3,}.*)?$",
    r"^([IVX]+[\.、]|[A-Z][\.、])\s*(.+?)(?:\s*\.{3,}.*)?$",
)
PLAIN_TITLE = r"^(?:[A-Z][A-Z\s]+|[^\w\s]*.{1,50}[^\w\s]*)$"
HEADER = "论文开头"
IMPORTANT = ("abstract", "introduction", "methodology", "experiment", "results", "conclusion")


def detect_language(docs: DataFrame, sample: int = 100) -> DataFrame:
    """doc_id, other (much text that is not Chinese), language, from the first `sample` lines.

    A line of 3+ characters is Tibetan (3+ such letters), English (3+ words, under 3 Han) or other.
    The last Tibetan or English line names the language; Tibetan if over a fifth of the lines are.
    """
    lines = lines_of(docs, sample).select("doc_id", "line_no", strip("line").alias("line")).where(F.length("line") >= 3)
    tibetan = F.regexp_count("line", F.lit(r"[\x{0f00}-\x{0fff}]")) > 2
    english = (F.regexp_count("line", F.lit(r"\b[a-zA-Z]{4,}\b")) > 2) & (F.regexp_count("line", F.lit(r"[\x{4e00}-\x{9fff}]")) < 3)
    tagged = lines.select(
        "doc_id", "line_no", F.when(tibetan, "tibetan").when(english, "english").when(~is_chinese(F.col("line"), 0.15), "other").alias("tag")
    )
    named = F.when(F.col("tag").isin("tibetan", "english"), F.col("line_no"))
    per_doc = tagged.groupBy("doc_id").agg(
        F.avg((F.coalesce("tag", F.lit("")) == "tibetan").cast("int")).alias("t"), F.avg(F.col("tag").isNotNull().cast("int")).alias("o"),
        F.max_by("tag", named).alias("last"), F.max((F.col("tag") == "other").cast("int")).alias("any_other"),
    )
    told = per_doc.select(
        "doc_id", ((F.col("t") > 0.2) | (F.col("o") > 0.4)).alias("other"),
        F.when(F.col("t") > 0.2, "tibetan").otherwise(F.coalesce("last", F.when(F.col("any_other") == 1, "other"), F.lit("unknown"))).alias("language"),
    )
    return docs.select("doc_id").join(told, "doc_id", "left").select(
        "doc_id", F.coalesce("other", F.lit(False)).alias("other"), F.coalesce("language", F.lit("unknown")).alias("language")
    )


def language_gate(docs: DataFrame) -> DataFrame:
    """doc_id, accepted language (chinese, english, or null where the document is turned away)."""
    head = F.substring("text", 1, 5000)
    words = F.filter(F.split(head, r"(?U)\s+"), lambda w: w != "")
    ascii_share = F.size(F.filter(words, lambda w: ~w.rlike(r"[^\x00-\x7F]"))) / F.greatest(F.size(words), F.lit(1))
    joined = docs.join(detect_language(docs), "doc_id")
    accepted = F.when(F.col("other"), F.when(F.col("language") == "english", "english")).otherwise(
        F.when(is_chinese(head, 0.2), "chinese").when(ascii_share > 0.5, "english")
    )
    return joined.select("doc_id", accepted.alias("accepted"))


def title_struct(line: Column, plain: bool = True) -> Column:
    """struct(title, section_type, level) of a title line, else null.  plain: unnumbered lines of
    up to about 50 characters count, as the original rule has it."""
    ok = F.length(line).between(2, 100)

    def made(title, level):
        return F.struct(title.alias("title"), section_type(title).alias("section_type"), F.lit(level).alias("level") if isinstance(level, int) else level.alias("level"))

    out = F.when(~ok, None)
    for p in NUMBERED_TITLES:
        number, title = F.regexp_extract(line, "(?iU)" + p, 1), strip(F.regexp_extract(line, "(?iU)" + p, 2))
        out = out.when(line.rlike("(?iU)" + p), made(title, F.when(number.contains("."), 2).otherwise(1)))
    if plain:
        out = out.when(line.rlike("(?iU)" + PLAIN_TITLE), made(line, F.when(line.contains("."), 2).otherwise(1)))
    return out.when(section_type(line) != "unknown", made(line, 2))


def detect_titles(lines: DataFrame, plain: bool = True) -> DataFrame:
    line = strip("line")
    return lines.select("doc_id", "line_no", title_struct(line, plain).alias("t")).where("t IS NOT NULL").select("doc_id", "line_no", "t.*")


def parse_sections(docs: DataFrame, plain: bool = True, title: Column | None = None) -> DataFrame:
    """doc_id, ord, title, content, section_type, level.  A title line opens a section; its lines up to the
    next are its content; text before the first is a header.  Sections without content are dropped."""
    lines = lines_of(docs).select("doc_id", "line_no", strip("line").alias("line")).where("line != ''")
    t = title if title is not None else title_struct(F.col("line"), plain)
    told = lines.withColumn("t", t).withColumn("grp", F.sum(F.col("t").isNotNull().cast("int")).over(doc_window("line_no")))
    told = told.withColumn("lead", F.max((F.col("grp") == 0).cast("int")).over(Window.partitionBy("doc_id")))
    body = F.when(F.col("t").isNull(), F.concat("line", F.lit("\n")))
    grouped = told.groupBy("doc_id", "grp").agg(
        F.max(F.struct(F.col("t").isNotNull().alias("is_title"), "t")).alias("x"), F.max("lead").alias("lead"),
        F.array_join(F.array_compact(in_order(body, "line_no")), "").alias("content"),
    )
    return grouped.where("content != ''").select(
        "doc_id", (F.col("grp") + F.col("lead")).cast("int").alias("ord"), F.coalesce("x.t.title", F.lit(HEADER)).alias("title"), "content",
        F.coalesce("x.t.section_type", F.lit("header")).alias("section_type"), F.coalesce("x.t.level", F.lit(1)).alias("level"),
    )


def _edges(c: Column) -> Column:
    """What is needed of a text to know how long it is without white space at its ends, wherever it is joined to others."""
    total, whole = F.length(c), strip(c)
    lead = total - F.length(F.ltrim(c, F.lit(SPACE)))
    return F.struct(total.alias("total"), lead.alias("lead"), F.when(whole == "", total).otherwise(total - lead - F.length(whole)).alias("trail"))


def _joined(x: Column, y: Column) -> Column:
    """The edges of two texts, one after the other."""
    return F.struct(
        (x["total"] + y["total"]).alias("total"), F.when(x["lead"] == x["total"], x["total"] + y["lead"]).otherwise(x["lead"]).alias("lead"),
        F.when(y["trail"] == y["total"], y["total"] + x["trail"]).otherwise(y["trail"]).alias("trail"),
    )


def merge_small_sections(sections: DataFrame, least: int = 200) -> DataFrame:
    """A section under `least` characters takes the next one in, unless that is the references; an
    unknown type is taken over.  Which sections go together is a fold over their lengths and types, a document's sections
    meet in one row for it, and their texts are joined once, when that is known."""
    text = F.coalesce("content", F.lit(""))
    piece = F.concat(F.lit("\n\n## "), F.coalesce("title", F.lit("")), F.lit("\n"), text)
    row = F.struct("ord", F.struct(*sections.columns).alias("r"), _edges(text).alias("own"), _edges(piece).alias("piece"), piece.alias("text"), (F.col("section_type") == "references").alias("apart"))
    listed = sections.groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("s"))
    empty = F.struct(F.lit(0).alias("total"), F.lit(0).alias("lead"), F.lit(0).alias("trail"))
    start = F.struct(empty.alias("at"), F.array().cast("array<int>").alias("groups"))

    def step(acc: Column, x: Column) -> Column:
        size = acc["at"]["total"] - acc["at"]["lead"] - acc["at"]["trail"]
        more = (F.size(acc["groups"]) > 0) & (size < least) & ~F.coalesce(x["apart"], F.lit(False))
        before = F.coalesce(F.get(acc["groups"], F.size(acc["groups"]) - 1), F.lit(-1))
        return F.struct(
            F.when(more, _joined(acc["at"], x["piece"])).otherwise(x["own"]).alias("at"), F.concat(acc["groups"], F.array(F.when(more, before).otherwise(before + 1))).alias("groups"))

    folded = listed.withColumn("g", F.aggregate("s", start, step, lambda acc: acc["groups"]))
    each = folded.select("doc_id", F.explode(F.arrays_zip("s", "g")).alias("x")).select("doc_id", "x.g", "x.s.ord", "x.s.r", "x.s.text")
    groups = each.groupBy("doc_id", "g").agg(F.sort_array(F.collect_list(F.struct("ord", "r", "text"))).alias("s"))
    first, known = F.get("s", F.lit(0))["r"], F.filter(F.transform("s", lambda x: x["r"]["section_type"]), lambda t: t.isNull() | (t != "unknown"))
    made = {
        "content": F.when(F.size("s") == 1, first["content"]).otherwise(F.concat(F.coalesce(first["content"], F.lit("")), F.array_join(F.transform(F.slice("s", 2, F.size("s")), lambda x: x["text"]), ""))),
        "section_type": F.when(F.size(known) > 0, F.get(known, F.lit(0))).otherwise(F.lit("unknown")),
    }
    return groups.select(*[made.get(c, first[c]).alias(c) for c in sections.columns])


def batch_sections(sections: DataFrame, budget: int = 10_000) -> DataFrame:
    """Sections with a batch number: neighbours packed up to `budget` characters, a larger one alone."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, batch, used, out = pdf.sort_values("ord"), 0, 0, []
        for n in pdf["n"]:
            if n > budget:
                batch, used = batch + (used > 0), 0
                out.append(batch)
                batch += 1
                continue
            if used and used + n > budget:
                batch, used = batch + 1, 0
            out.append(batch)
            used += n
        return pd.DataFrame({"doc_id": pdf["doc_id"], "ord": pdf["ord"], "batch": out})

    # only lengths go through Python
    sizes = sections.select("doc_id", "ord", F.coalesce(F.length("content"), F.lit(0)).alias("n"))
    fields = {f.name: f for f in sections.schema.fields}
    told = sizes.groupBy("doc_id").applyInPandas(fold, StructType([fields["doc_id"], fields["ord"], StructField("batch", IntegerType())]))
    return sections.join(told, ["doc_id", "ord"]).select(*sections.columns, "batch")


def important_sections(sections: DataFrame) -> DataFrame:
    """X7"""
    n = F.length(strip("content"))
    return sections.where((F.col("section_type").isin(*IMPORTANT) & (n > 200)) | ((F.col("section_type") == "unknown") & (n > 1000)))


def chunk_text(docs: DataFrame, size: int = 32_000, look: int = 1000) -> DataFrame:
    """doc_id, chunk_no, chunk: pieces of at most `size` characters, cut at the last blank line, full stop
    or line end within the last `look` characters of each, else right at the limit."""

    def cut(text: str):
        at = 0
        while len(text) - at > size:
            end = at + size
            for mark, keep, skip in (("\n\n", 0, 2), ("。", 1, 1), ("\n", 0, 1)):
                k = text.rfind(mark, max(at, end - look), end)
                if k > at:
                    yield text[at : k + keep]
                    at = k + skip
                    break
            else:
                yield text[at:end]
                at = end
        if at < len(text) or not text:
            yield text[at:]

    return each_text(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda t: enumerate(cut(t)), chunk_no="int", chunk="string")


def chunk_by_words(docs: DataFrame, words: int = 1000) -> DataFrame:
    """Chunks of so many words."""
    parts = F.filter(F.split("text", r"(?U)\s+"), lambda w: w != "")
    told = docs.select("doc_id", parts.alias("w")).where(F.size("w") > 0)
    cut = told.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / words).cast("int"))).alias("chunk_no"))
    return cut.select("doc_id", "chunk_no", F.array_join(F.slice("w", F.col("chunk_no") * words + 1, F.lit(words)), " ").alias("chunk"))


def chunk_by_sections(sections: DataFrame, tokens: int = 4000) -> DataFrame:
    """Neighbouring sections packed into chunks of up to `tokens` tokens (two characters each)."""
    packed = batch_sections(sections, tokens * 2)
    body = F.concat("title", F.lit("\n"), "content")
    return packed.groupBy("doc_id", F.col("batch").alias("chunk_no")).agg(F.array_join(in_order(body, "ord"), "").alias("chunk"))


def merge_chunk_results(results: DataFrame, titles=("title_cn", "title_en"), keywords=("keywords_cn", "keywords_en"), others=("abstract_cn", "abstract_en", "theoretical_framework", "references")) -> DataFrame:
    """X11: one row per doc_id from rows by chunk_no: the first filled title, keywords each once in order, other
    fields joined by a blank line."""
    have, aggs = set(results.columns), []
    for c in (x for x in titles if x in have):
        filled = F.when(blank_to_null(F.col(c)).isNotNull(), F.col("chunk_no"))
        aggs.append(F.coalesce(F.min_by(strip(c), filled), F.lit("")).alias(c))
    for c in (x for x in keywords if x in have):
        words = F.flatten(in_order(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda k: strip(k)), lambda k: k != ""), "chunk_no"))
        aggs.append(F.array_join(F.array_distinct(words), ", ").alias(c))
    for c in (x for x in others if x in have):
        aggs.append(F.array_join(F.array_compact(in_order(blank_to_null(F.col(c)), "chunk_no")), "\n\n").alias(c))
    return results.groupBy("doc_id").agg(*aggs)


def overlay_metadata(base: DataFrame, meta: DataFrame, fields: list[str]) -> DataFrame:
    """Fields of base, replaced by those of meta that are not blank."""
    m = meta.select("doc_id", *[F.col(f).alias(f"__{f}") for f in fields])
    return base.join(m, "doc_id", "left").select(
        *[F.coalesce(blank_to_null(F.col(f"__{c}")), F.col(c)).alias(c) if c in fields else F.col(c) for c in base.columns]
    )


def integrate_sections(values: DataFrame, sections: DataFrame, fields: list[str]) -> DataFrame:
    """Rows (doc_id, ord, field, value) to a column per field, values joined by a blank line; problems fall back
    on the introduction's first 500 characters, solutions on the methods, references on their section."""
    joined = values.where(blank_to_null(F.col("value")).isNotNull()).groupBy("doc_id").pivot("field", fields).agg(
        F.array_join(in_order(F.col("value"), "ord"), "\n\n")
    )
    joined = joined.select("doc_id", *[F.nullif(F.col(f), F.lit("")).alias(f) for f in fields])
    first = lambda kind: F.min_by(F.when(F.col("section_type") == kind, F.col("content")), F.when(F.col("section_type") == kind, F.col("ord")))
    fallback = sections.groupBy("doc_id").agg(first("introduction").alias("__intro"), first("references").alias("__refs"))
    whole = fallback.join(joined, "doc_id", "full")
    use = {"practical_problems": F.substring("__intro", 1, 500), "proposed_solutions": F.col("research_methods") if "research_methods" in fields else F.lit(None)}
    return whole.select(
        "doc_id",
        *[
            (F.coalesce("__refs", F.col(f)) if f == "references" else F.coalesce(F.col(f), use[f]) if f in use else F.col(f)).alias(f)
            for f in fields
        ],
    )


def corpus_stats(docs: DataFrame, by=("lang", "source")) -> DataFrame:
    """Documents, characters, lines and the longest document, by the columns with subtotals."""
    return docs.rollup(*by).agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"), F.round(F.avg(F.length("text")), 6).alias("mean_chars"),
        F.sum(F.size(F.split("text", "\n"))).cast("long").alias("lines"), F.max(F.length("text")).cast("long").alias("longest"),
    )
