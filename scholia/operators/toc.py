"""Tables of contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import strip
from scholia.operators.lines import doc_window, lines_of, once

# Fixed patterns of entries: type, level, confidence, pattern.  Special ones come first, then chapters, then sections.
SPECIAL = (
    ("abstract", 0, 0.95, r"^(摘\s*要|Abstract)"),
    ("conclusion", 1, 0.90, r"^(结\s*论|Conclusion|总结|Summary)"),
    ("references", 1, 0.95, r"^(参\s*考\s*文\s*献|References)"),
    ("achievements", 1, 0.90, r"^(攻读.*学位.*期间.*成果|研究成果|学术成果|Publications|Academic Achievements)"),
    ("acknowledgment", 1, 0.90, r"^(致\s*谢|Acknowledgment|Acknowledgement)"),
    ("author_profile", 1, 0.90, r"^(作者简介|个人简历|Author.*Profile|Biography|CV)"),
    ("appendix", 1, 0.85, r"^(附\s*录|Appendix)"),
    ("declaration", 1, 0.85, r"^(声\s*明|Declaration|Statement)"),
    ("copyright", 1, 0.85, r"^(版权声明|Copyright|License)"),
)
NUMBERED = (
    ("traditional_chapter", 1, 0.95, r"^(第[一二三四五六七八九十\d]+章)\s*([^\n\r\t\d]*)"),
    ("numeric_chapter", 1, 0.90, r"^(\d+)\s+([^\n\r\t\d].{3,})"),
    ("english_chapter", 1, 0.90, r"^(Chapter\s+\d+)\s+([^\n\r\t]+)"),
    ("english_chapter_caps", 1, 0.90, r"^(CHAPTER\s+\d+)\s+([^\n\r\t]+)"),
    ("level2_section", 2, 0.85, r"^(\d+\.\d+)\s+([^\n\r\t\d].{2,})"),
    ("level3_section", 3, 0.80, r"^(\d+\.\d+\.\d+)\s+([^\n\r\t\d].{2,})"),
    ("level4_section", 4, 0.75, r"^(\d+\.\d+\.\d+\.\d+)\s+([^\n\r\t\d].{2,})"),
)
# Fixed patterns and words of TOC lines.
TOC_LINE = (
    r"第[一二三四五六七八九十\d]+章.+\d+", r"\d+\.?\d*\s+.+\d+", r"[A-Z][a-z]+\s+\d+.+\d+", r"摘\s*要.+[IVX\d]+", r"Abstract.+[IVX\d]+", r"目\s*录.+[IVX\d]+",
    r"参\s*考\s*文\s*献.+\d+", r"References.+\d+", r"攻读.+学位.+期间.+成果.+\d+", r"研究成果.+\d+", r"学术成果.+\d+", r"Publications.+\d+", r"致\s*谢.+\d+",
    r"Acknowledgment.+\d+", r"作者简介.+\d+", r"个人简历.+\d+", r"后\s*记.+\d+", r"结\s*语.+\d+", r"Epilogue.+\d+", r"Author.+Profile.+\d+", r"Biography.+\d+",
    r"附\s*录.+\d+", r"Appendix.+\d+", r"声\s*明.+\d+", r"Declaration.+\d+", r".+\t+[IVX\d]+", r"[^\d]+\s+[IVX\d]+",
)
TOC_WORDS = (
    "攻读", "学位", "期间", "成果", "研究成果", "学术成果", "致谢", "作者简介", "个人简历", "声明", "版权", "后记", "结语", "Publications", "Acknowledgment",
    "Biography", "CV", "Declaration", "Epilogue",
)
TOC_HEADING = r"^(?:目\s*录|CONTENTS?|TABLE\s+OF\s+CONTENTS?|目\s*次)\s*$"
BODY_START = r"^(?:第[一二三四五六七八九十\d]+章\s+\S+|\d+\s+[^.\d\s]\S+|Chapter\s+\d+\s+\S+|引\s*言\s*$|绪\s*论\s*$|Introduction\s*$)"
ABSTRACT_LINE = r"^(?:摘\s*要|abstract)"
NOT_TOC = r"图\s*\d+|表\s*\d+|公式\s*\d+|算法\s*\d+|本章小结|如图\s*\d+|见表\s*\d+|^根据|^基于|^通过|^如果|^因此|^由于"
LIKELY_TOC = (
    r"第[一二三四五六七八九十\d]+章|^\d+\.\s*[^\d]|^\d+\.\d+\s*[^\d]|摘\s*要|目\s*录|参考文献|致\s*谢|攻读|附\s*录|绪\s*论|总结|展望|结论|ABSTRACT|CONCLUSION|REFERENCE"
)
BODY_TOC = r"^(?:第[一二三四五六七八九十\d]+章|\d+\.|[A-Z]+|摘\s*要|目\s*录|参考文献|致\s*谢|攻读|附\s*录)"
CHAPTER_TYPES = ("traditional_chapter", "numeric_chapter", "english_chapter", "chapter")
AFTER_REFERENCES = ("achievements", "acknowledgment", "author_profile", "appendix", "declaration", "copyright")
CHINESE_DIGITS = "一二三四五六七八九十"


def is_toc_line(c: Column) -> Column:
    """A line of a table of contents by pattern, by word and page number, or by section number."""
    line = strip(c)
    words = line.rlike("|".join(TOC_WORDS)) & line.rlike(r"[IVX\d]+$")
    numbered = line.rlike(r"^\d+\.\d+") & ~line.rlike(r"[。.].{10,}")
    return (line != "") & (line.rlike("^(?:" + "|".join(TOC_LINE) + ")$") | words | numbered | line.rlike(r"^第[一二三四五六七八九十\d]+章"))


def toc_boundary(docs: DataFrame, cap: int = 150) -> DataFrame:
    """doc_id, first, last (line numbers of the entries), way.  From a heading line to the line before the first
    body chapter, `cap` lines at most; else from the first three TOC lines in a row after the abstract; else all TOC lines."""
    toc = is_toc_line(F.col("line"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    lines = lines_of(docs).select("doc_id", "line_no", strip("line").alias("line")).withColumn("toc", toc)
    lines = lines.withColumns(
        {"run": F.sum(F.col("toc").cast("int")).over(order.rowsBetween(0, 2)), "heading": F.col("line").rlike("(?i)" + TOC_HEADING), "abstract": F.col("line").rlike("(?i)" + ABSTRACT_LINE)}
    )
    every = Window.partitionBy("doc_id")
    lines = lines.withColumns({"h": F.min(F.when(F.col("heading"), F.col("line_no"))).over(every), "a": F.min(F.when(F.col("abstract"), F.col("line_no"))).over(every)})
    body = F.when((F.col("line_no") > F.col("h")) & ~F.col("toc") & F.col("line").rlike("(?i)" + BODY_START), F.col("line_no"))
    found = lines.groupBy("doc_id").agg(
        F.first("h").alias("h"), F.min(body).alias("body"), F.max("line_no").alias("end"),
        F.min(F.when((F.col("line_no") > F.col("a")) & (F.col("run") == 3), F.col("line_no"))).alias("s"),
        F.min(F.when(F.col("toc"), F.col("line_no"))).alias("t0"), F.max(F.when(F.col("toc"), F.col("line_no"))).alias("t1"),
    )
    first = F.coalesce(F.col("h") + 1, F.col("s"), F.col("t0"))
    last = F.when(F.col("h").isNotNull(), F.least(F.coalesce(F.col("body") - 1, F.col("end")), F.col("h") + cap)).when(
        F.col("s").isNotNull(), F.least(F.col("t1"), F.col("s") + cap)
    ).otherwise(F.col("t1"))
    way = F.when(F.col("h").isNotNull(), "heading").when(F.col("s").isNotNull(), "abstract").otherwise("lines")
    return found.select("doc_id", first.alias("first"), last.alias("last"), way.alias("way")).where("first IS NOT NULL AND last >= first")


def toc_from_body(lines: DataFrame) -> DataFrame:
    """Lines of a text that look like entries and not like captions or sentences."""
    line = strip("line")
    return lines.where((F.length(line) >= 2) & line.rlike("(?iU)" + BODY_TOC) & ~line.rlike(NOT_TOC) & line.rlike("(?iU)" + LIKELY_TOC))


def page_number(c: Column) -> Column:
    """A page at a line's end, after dots, a tab or a space; null without one."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")).try_cast("int") for p in (r"\.+\s*(\d+)\s*$", r"\t+(\d+)\s*$", r"\s+(\d+)\s*$")])


def toc_entry(line: Column) -> Column:
    """struct(level, number, title, page, confidence, section_type) of an entry line, else null."""
    page, out = page_number(line), None

    def entry(kind, level, confidence, number, title):
        return F.struct(
            F.lit(level).alias("level"), number.alias("number"), strip(title).alias("title"), page.alias("page"), F.lit(confidence).alias("confidence"),
            F.lit(kind).alias("section_type"),
        )

    for kind, level, confidence, p in SPECIAL:
        made = entry(kind, level, confidence, F.lit(""), F.regexp_extract(line, "(?iU)" + p, 1))
        hit = line.rlike("(?iU)" + p)
        out = F.when(hit, made) if out is None else out.when(hit, made)
    for kind, level, confidence, p in NUMBERED:
        out = out.when(line.rlike("(?U)" + p), entry(kind, level, confidence, F.regexp_extract(line, "(?U)" + p, 1), F.regexp_extract(line, "(?U)" + p, 2)))
    return out


def parse_toc_entries(lines: DataFrame) -> DataFrame:
    """T4: doc_id, line_number and the fields of each line that is an entry."""
    told = once(lines.withColumn("line_number", F.col("line_no") + 1), "doc_id", "line_number", line=strip("line"))
    # the entry is made once a line, for the test and for each of its fields
    return once(told, "doc_id", "line_number", e=toc_entry(F.col("line"))).where("e IS NOT NULL").select("doc_id", "line_number", "e.*")


# Fixed forms of entry lines, in this order: link, [page], dots, number, chapter.
FORMS = (
    ("link", r"^\[(.+?)(?:\s+(\d+))?\]\(#.*\)$"),
    ("bracket", r"^(.+?)\s*\[(\d+)\]$"),
    ("dotted", r"^(.+?)\s*\.{2,}\s*(\d+)$"),
    ("numbered", r"^(\d+(?:\.\d+)*\.?\s+.+?)(?:\s+(\d+))?$"),
    ("chapter", r"^(第[一二三四五六七八九十\d]+章.*?)(?:\s+(\d+))?$"),
)


def parse_toc_formats(lines: DataFrame) -> DataFrame:
    """T5: doc_id, line_no, form, title, page of lines in one of the other forms of entries."""
    line = strip("line")
    pick = lambda g: F.coalesce(*[F.when(line.rlike(p), F.regexp_extract(line, p, g)) for _, p in FORMS])
    told = lines.select("doc_id", "line_no", F.coalesce(*[F.when(line.rlike(p), k) for k, p in FORMS]).alias("form"), strip(pick(1)).alias("title"), pick(2).try_cast("int").alias("page"))
    return told.where("form IS NOT NULL")


def dedupe_toc(entries: DataFrame) -> DataFrame:
    """The first entry of each number and title."""
    first = Window.partitionBy("doc_id", "number", "title").orderBy("line_number")
    return entries.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def fix_toc(entries: DataFrame) -> DataFrame:
    """Levels 1 to 4 from the dots of the number; a default title where it is blank."""
    dots = F.length(F.regexp_replace("number", r"[^.]", ""))
    level = F.when((F.col("number") != "") & (dots <= 3), dots + 1).otherwise(F.col("level"))
    fixed = entries.withColumn("level", level)
    default = F.concat(F.lit("第"), "number", F.when(F.col("level") == 1, "章").otherwise("节"))
    return fixed.withColumn("title", F.when((F.col("title") == "") & (F.col("number") != ""), default).otherwise(F.col("title")))


def sort_key(number: Column) -> Column:
    """Four ints of a number, Chinese digits included; entries without one last."""
    bare = F.regexp_replace(number, "[第章]", "")
    digit = lambda x: F.when((F.length(x) == 1) & (F.instr(F.lit(CHINESE_DIGITS), x) > 0), F.instr(F.lit(CHINESE_DIGITS), x)).otherwise(F.coalesce(x.try_cast("int"), F.lit(0)))
    parts = F.slice(F.concat(F.transform(F.split(bare, r"\."), digit), F.array_repeat(F.lit(0), 4)), 1, 4)
    return F.when(number == "", F.array(F.lit(999), F.lit(0), F.lit(0), F.lit(0))).otherwise(parts)


def sort_toc(entries: DataFrame) -> DataFrame:
    """Entries with pos, their place by number."""
    order = Window.partitionBy("doc_id").orderBy("key", "line_number")
    return entries.withColumn("key", sort_key(F.col("number"))).withColumn("pos", F.row_number().over(order)).drop("key")


def canonical_titles(entries: DataFrame) -> DataFrame:
    """The usual title of special sections."""
    t, k = F.col("title"), F.col("section_type")
    title = (
        F.when(k == "references", "参考文献").when(k == "acknowledgment", "致谢")
        .when((k == "achievements") & t.contains("攻读") & t.contains("学位"), "攻读学位期间取得的研究成果")
        .when((k == "achievements") & t.contains("研究成果"), "研究成果").when((k == "achievements") & t.contains("学术成果"), "学术成果")
        .when((k == "author_profile") & t.contains("作者简介"), "作者简介").when((k == "author_profile") & t.contains("个人简历"), "个人简历").otherwise(t)
    )
    return entries.withColumn("title", title)


def nest_toc(entries: DataFrame) -> DataFrame:
    """doc_id, chapters (with their sections), special_sections, post_references."""
    order = doc_window("line_number")
    chapter = (F.col("level") == 1) & F.col("section_type").isin(*CHAPTER_TYPES)
    told = entries.withColumns(
        {
            "chapter": F.last(F.when(chapter, F.col("line_number")), ignorenulls=True).over(order),
            "refs": F.max((F.col("section_type") == "references").cast("int")).over(order), "is_chapter": chapter,
        }
    )
    section = ~F.col("is_chapter") & (F.col("level") > 1) & F.col("chapter").isNotNull() & (F.col("refs") == 0)
    other = ~F.col("is_chapter") & ~section
    leaf = F.struct("line_number", "level", "number", "title", "page")
    per_chapter = told.where(F.col("is_chapter") | section).groupBy("doc_id", "chapter").agg(
        F.max(F.when(F.col("is_chapter"), F.struct("number", "title", "page"))).alias("c"), F.sort_array(F.collect_list(F.when(section, leaf))).alias("sections")
    )
    chapters = per_chapter.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chapter", "c.number", "c.title", "c.page", "sections"))).alias("chapters"))
    item = F.struct("line_number", "section_type", "title", "page")
    special = other & F.col("section_type").isin("abstract", "conclusion", "references")
    post = other & ~special & (F.col("refs") == 1) & F.col("section_type").isin(*AFTER_REFERENCES)
    rest = told.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.when(special, item))).alias("special_sections"), F.sort_array(F.collect_list(F.when(post, item))).alias("post_references")
    )
    return rest.join(chapters, "doc_id", "left")


def toc_summary(entries: DataFrame) -> DataFrame:
    """Entries, deepest level, mean confidence, share with number and page, entries by level and confidence band."""
    c = F.col("confidence")
    return entries.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("level").alias("max_level"), F.round(F.avg(c), 9).alias("confidence"),
        F.count_if(F.col("number") != "").alias("with_number"), F.count_if(F.col("page").isNotNull()).alias("with_page"),
        *[F.count_if(F.col("level") == k).alias(f"level_{k}") for k in range(5)],
        F.count_if(c >= 0.9).alias("high"), F.count_if((c >= 0.8) & (c < 0.9)).alias("medium"), F.count_if(c < 0.8).alias("low"),
    )


def toc_quality(summary: DataFrame) -> DataFrame:
    """0-100: 30 for any entry, up to 20 for their number, 15 depth, 15 numbers, 10 pages, 10 confidence."""
    n = F.col("n")
    size = F.when(n >= 20, 20).when(n >= 10, 15).when(n >= 5, 10).otherwise(0)
    depth = F.when(F.col("max_level") >= 3, 15).when(F.col("max_level") >= 2, 10).when(F.col("max_level") >= 1, 5).otherwise(0)
    part = lambda x, k: F.floor(x * k)
    total = 30 + size + depth + part(F.col("with_number") / n, 15) + part(F.col("with_page") / n, 10) + part(F.col("confidence"), 10)
    return summary.select("doc_id", F.least(total, F.lit(100)).cast("int").alias("quality"))


def heading_outline(paragraphs: DataFrame) -> DataFrame:
    """doc_id, paragraph_index, level, title, page of paragraphs in a heading style (`Heading n`, `标题 n`)."""
    level = F.nullif(F.regexp_extract("style_name", r"(?i)(?:heading|标题)\s*(\d)", 1), F.lit("")).cast("int")
    text = strip("text")
    told = paragraphs.select("doc_id", "paragraph_index", level.alias("level"), text.alias("title"), (F.floor((F.col("paragraph_index") - 1) / 28) + 1).cast("int").alias("page"))
    return told.where(F.col("level").isNotNull() & F.length("title").between(2, 100) & ~F.col("title").rlike(r"^[\d\s.]+$"))


def html_headings(pages: DataFrame) -> DataFrame:
    """Paragraphs for heading_outline from the <h1>..<h6> of HTML pages, by their order."""
    found = F.regexp_extract_all("html", F.lit(r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"), F.lit(1))
    texts = F.regexp_extract_all("html", F.lit(r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"), F.lit(2))
    told = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.arrays_zip(found.alias("h"), texts.alias("t"))).alias("k", "x"))
    return told.select("doc_id", (F.col("k") + 1).alias("paragraph_index"), F.concat(F.lit("Heading "), "x.h").alias("style_name"), F.regexp_replace("x.t", "(?s)<.*?>", "").alias("text"))


def level1_share(entries: DataFrame) -> DataFrame:
    """T14"""
    return entries.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("level") == 1).alias("level_1"), F.round(F.avg((F.col("level") == 1).cast("int")), 9).alias("share")
    )


def toc_regions(paragraphs: DataFrame, gap: int = 5, least: int = 3) -> DataFrame:
    """doc_id, region, first, last, n: entry-like paragraphs (title up to 100 characters, page up to 1000) at most
    `gap` apart, `least` or more of them."""
    text = strip("text")
    form = r"^(.+?)[\s.\t]+(\d+)$"
    ok = text.rlike(form) & (F.length(F.regexp_extract(text, form, 1)) <= 100) & (F.regexp_extract(text, form, 2).try_cast("int") <= 1000)
    order = doc_window("paragraph_index")
    picked = paragraphs.where(F.coalesce(ok, F.lit(False))).withColumn("gap", F.col("paragraph_index") - F.lag("paragraph_index").over(order))
    told = picked.withColumn("region", F.sum(F.when(F.col("gap") > gap, 1).otherwise(0)).over(order))
    return told.groupBy("doc_id", "region").agg(F.min("paragraph_index").alias("first"), F.max("paragraph_index").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
