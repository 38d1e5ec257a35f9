"""Reference lists of documents.

Blocks are found by position, entries by lines (a flag for lines that begin an entry and
a running sum over it), never by patterns that loop over continuation lines.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import strip
from scholia.operators.lines import each_text, in_order, lines_of, once

# Headings and end markers, in the order in which they are tried.
BLOCK_HEADINGS = (r"#+\s*参考文献\s*\n", r"参考文献\s*\n", r"References\s*\n", r"REFERENCES\s*\n", r"参\s*考\s*文\s*献")
BLOCK_ENDS = (
    "攻读硕士学位期间获得的成果", "攻读学位期间发表", "攻读硕士学位期间发表", "攻读学位期间取得", "攻读学位期间的研究成果", "个人简历", "作者简介",
    "致谢与声明", "致谢", "ACKNOWLEDGMENT", "ACKNOWLEDGEMENT", "附录", "APPENDIX",
)
LONGEST_HEADINGS = (
    (r"(?:^|\n)(?:##\s*)?参考文献\s*\n", ("缩略词表", "文献综述", "致谢与声明", "致谢", "附录", "作者简介", "个人简历")),
    (r"(?:^|\n)(?:##\s*)?REFERENCES?\s*\n", ("ACKNOWLEDGMENT", "APPENDIX", "文献综述", "致谢与声明", "致谢")),
    (r"(?:^|\n)(?:##\s*)?Bibliography\s*\n", ("ACKNOWLEDGMENT", "APPENDIX", "文献综述", "致谢与声明", "致谢")),
)
NEAREST_KEYWORDS = ("参考文献", "References", "REFERENCES", "Bibliography")
NEAREST_ENDS = ("致谢与声明", "缩略词表", "文献综述", "致谢", "ACKNOWLEDGMENT", "APPENDIX", "附录", "作者简介", "个人简历")
#: numbers that begin an entry: [n], full-width [n], 【n】, n. and (n).
ENTRY = r"^\s*(?:［(\d+)］|\[(\d+)\]|【(\d+)】|(\d+)\.|（(\d+)）|\((\d+)\))"
# Fixed words of publications: of numbered entries, of others, and of the strict rule.
PUBLICATION = (
    "Journal", "Proceedings", "Conference", "IEEE", "ACM", "Optics", "Nature", "Science", "Physical Review", "Applied Physics", "et al",
    "期刊", "会议", "学报", "大学学报", "论文集", "出版社", "学院学报", "音乐学院", "艺术学院", "师范大学", "大学出版社", "人民出版社", "文艺出版社",
    "音乐出版社", "上海音乐", "中央音乐", "沧桑", "戏剧", "音乐", "艺术", "文化", "研究", "分析", "探讨", "论文", "硕士", "博士", "学位论文", "毕业论文",
    "年第", "期", "页", "编", "著", "主编", "总编", "卷", "册", "版",
)
PUBLICATION_UNNUMBERED = (
    "Journal", "Proceedings", "Conference", "IEEE", "ACM", "Optics", "Nature", "Science", "Physical Review", "Applied Physics", "et al",
    "期刊", "会议", "学报", "大学学报", "论文集", "出版社", "学院学报", "计算机", "应用", "技术", "研究", "分析", "探讨", "论文", "硕士", "博士", "学位论文",
    "毕业论文", "年第", "期", "页", "编", "著", "主编", "总编", "卷", "册", "版", "[J]", "[D]", "[C]", "Transactions", "Systems", "Man", "Cybernetics",
)
PUBLICATION_STRICT = ("Journal", "Proceedings", "Conference", "IEEE", "ACM", "Optics", "期刊", "会议", "学报", "大学学报", "论文集", "出版社")
AUTHORS = r"[A-Z]\.\s*[A-Z]|et al|等|[\x{4e00}-\x{9fff}]{2,4}(?:：|编|著|主编)"
AUTHORS_UNNUMBERED = r"[A-Z]\.\s*[A-Z]|et al|等|[\x{4e00}-\x{9fff}]{2,4}(?:[,，.]|编|著|主编)|^[A-Z][a-z]+\s+[A-Z]|^[\x{4e00}-\x{9fff}]{2,4}[,，]"
PAGES = r"(?i):\d+[-–—]\d+|第\d+期|\(\d+\)|vol\.|no\.|pp\."
YEAR = r"(?:19|20)\d{2}"


def _position(c: Column, pattern: str) -> Column:
    """Code-point place of a pattern's first match, from 1; 0 if none."""
    return F.when(c.rlike(pattern), F.length(F.get(F.split(c, pattern, 2), F.lit(0))) + 1).otherwise(0)


def _from(c: Column, start: Column) -> Column:
    return F.substring(c, start, F.length(c))


def reference_block(docs: DataFrame, headings=BLOCK_HEADINGS, ends=BLOCK_ENDS, least: int = 100) -> DataFrame:
    """doc_id, block: from the first heading pattern, in list order, that occurs, to the first end
    marker, in list order, that occurs after it; blocks under `least` characters are dropped."""
    starts = [_position(F.col("text"), "(?iU)" + p) for p in headings]
    start = F.coalesce(*[F.when(s > 0, s) for s in starts])
    told = once(docs, "doc_id", "text", s=start).where("s IS NOT NULL")
    told = once(told, "doc_id", r=_from(F.col("text"), F.col("s")))
    end = F.coalesce(*[F.when(F.instr("r", m) > 0, F.instr("r", m) - 1) for m in ends], F.length("r"))
    return once(told, "doc_id", block=F.substring("r", F.lit(1), end)).where(F.length("block") >= least)


def reference_block_longest(docs: DataFrame, headings=LONGEST_HEADINGS, keywords=NEAREST_KEYWORDS, ends=NEAREST_ENDS) -> DataFrame:
    """R2: the longest text between a heading and its nearest end, of 200 characters or more; else
    from the first keyword, in list order, to the nearest marker, of 500 or more."""
    text = F.col("text")

    def longest(pattern, stops):
        parts = F.slice(F.split(text, "(?iU)" + pattern), 2, 1_000_000)
        stop = r"(?iU)\n\s*(?:" + "|".join(stops) + ")"
        bodies = F.transform(parts, lambda x: strip(F.get(F.split(x, stop, 2), F.lit(0))))
        most = F.array_max(F.transform(bodies, lambda b: F.struct(F.length(b).alias("n"), b.alias("b"))))
        return F.when(most["n"] >= 200, most["b"])

    def nearest(word):
        rest = _from(text, F.instr(text, word) + len(word))
        cut = F.get(F.split(rest, "|".join(re.escape(m) for m in ends), 2), F.lit(0))
        return F.when((F.instr(text, word) > 0) & (F.length(cut) >= 500), cut)

    found = F.coalesce(*[longest(p, s) for p, s in headings], *[nearest(k) for k in keywords])
    return once(docs, "doc_id", block=found).where("block IS NOT NULL")


def reference_number(c: Column) -> Column:
    """An entry's number, 999999 without one."""
    groups = [F.nullif(F.regexp_extract(c, ENTRY, g), F.lit("")) for g in range(1, 7)]
    return F.coalesce(*[g.try_cast("int") for g in groups], F.lit(999_999))


def split_references(blocks: DataFrame) -> DataFrame:
    """doc_id, pos (order in the block), ref_no, ref: entries by line.  A line with a number begins an
    entry, others go on with it; without any numbers each line that ends like an entry is one."""
    rows = blocks.select("doc_id", F.col("block").alias("text"))
    lines = lines_of(rows).select("doc_id", "line_no", strip("line").alias("line")).where("line != ''")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    begins = F.col("line").rlike(ENTRY)
    flagged = lines.withColumns({"begins": begins, "grp": F.sum(begins.cast("int")).over(order), "numbered": F.max(begins).over(Window.partitionBy("doc_id"))})
    numbered = (
        flagged.where("numbered AND grp > 0").groupBy("doc_id", "grp")
        .agg(F.min("line_no").alias("pos"), F.array_join(in_order(F.col("line"), "line_no"), " ").alias("ref"))
    ).select("doc_id", "pos", reference_number(F.col("ref")).alias("ref_no"), F.regexp_replace("ref", r"(?U)\s+", " ").alias("ref"))
    plain = flagged.where(~F.col("numbered") & F.col("line").rlike(r"^[A-Za-z\x{4e00}-\x{9fff}][^\n]{10,}[.\]]$"))
    plain = plain.select("doc_id", F.col("line_no").alias("pos"), F.row_number().over(order).alias("ref_no"), F.regexp_replace("line", r"(?U)\s+", " ").alias("ref"))
    return numbered.unionByName(plain)


def filter_numbering(refs: DataFrame, tolerance: int = 5, largest: int = 1000, least: int = 20) -> DataFrame:
    """Entries whose number is at most `largest` and at most `tolerance` above the next one expected, which
    grows with the entries accepted: a fold over the numbers of a document in order of position (null: not accepted)."""
    fits = (F.col("ref_no") <= largest) & (F.length("ref") >= least)
    row = F.struct("pos", F.coalesce("ref_no", F.lit(0)).alias("no"), F.coalesce(fits, F.lit(False)).alias("fits"), F.struct(*refs.columns).alias("r"))
    listed = refs.groupBy("doc_id").agg(F.sort_array(F.collect_list(row)).alias("rs"))
    # 0 stands for no entry accepted yet: then any number will do
    start = F.struct(F.lit(0).alias("expected"), F.array().cast("array<boolean>").alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        ok = x["fits"] & ((acc["expected"] == 0) | (x["no"] <= acc["expected"] + tolerance))
        # the number expected is never below 1 once an entry was accepted
        grown = F.greatest(acc["expected"], x["no"].cast("int") + 1, F.lit(1))
        return F.struct(F.when(ok, grown).otherwise(acc["expected"]).alias("expected"), F.concat(acc["kept"], F.array(ok)).alias("kept"))

    kept = F.aggregate("rs", start, step, lambda acc: acc["kept"])
    told = listed.select(F.explode(F.filter(F.arrays_zip("rs", kept.alias("kept")), lambda x: x["kept"])).alias("x"))
    return told.select(*[F.col(f"x.rs.r.{c}").alias(c) for c in refs.columns])


def _any(c: Column, words) -> Column:
    return c.rlike("|".join(re.escape(w) for w in words))


def is_reference(c: Column) -> Column:
    """20 characters or more, numbered up to 500, and two of: publication word, year, author form."""
    evidence = _any(c, PUBLICATION).cast("int") + c.rlike(YEAR).cast("int") + c.rlike(AUTHORS).cast("int")
    return (F.length(c) >= 20) & c.rlike(ENTRY) & (reference_number(c) <= 500) & (evidence >= 2)


def is_reference_unnumbered(c: Column) -> Column:
    """15 characters or more and two of: publication word, year, author form, pages or volume."""
    evidence = _any(c, PUBLICATION_UNNUMBERED).cast("int") + c.rlike(YEAR).cast("int") + c.rlike(AUTHORS_UNNUMBERED).cast("int") + c.rlike(PAGES).cast("int")
    return (F.length(c) >= 15) & (evidence >= 2)


def is_reference_strict(c: Column) -> Column:
    """20 characters or more, numbered, with a year or a publication word."""
    return (F.length(c) >= 20) & c.rlike(ENTRY) & (c.rlike(YEAR) | _any(c, PUBLICATION_STRICT))


def _regroup(pieces: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("n")
    grouped = pieces.withColumn("grp", F.sum(F.col("piece").rlike(ENTRY).cast("int")).over(order)).where("grp > 0")
    refs = grouped.groupBy("doc_id", "grp").agg(F.array_join(in_order(F.col("piece"), "n"), " ").alias("ref"))
    return refs.select("doc_id", "grp", strip(F.regexp_replace("ref", r"(?U)\s+", " ")).alias("ref")).where(F.length("ref") > 20)


def regroup_references(blocks: DataFrame, few: int = 5, cap: int = 100) -> DataFrame:
    """Entries by paragraph; documents with fewer than `few` are regrouped by line, where entries must
    be strictly valid; the first `cap` of each."""

    def pieces(pattern):
        cut = blocks.select("doc_id", F.posexplode(F.split("block", pattern)).alias("n", "p"))
        return cut.select("doc_id", "n", strip("p").alias("piece")).where("piece != ''")

    by_paragraph, by_line = _regroup(pieces(r"\n\s*\n")), _regroup(pieces("\n")).where(is_reference_strict(F.col("ref")))
    enough = by_paragraph.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= few).select("doc_id")
    chosen = by_paragraph.join(enough, "doc_id", "left_semi").unionByName(by_line.join(enough, "doc_id", "left_anti"))
    ranked = chosen.withColumn("ref_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("grp")))
    return ranked.where(F.col("ref_no") <= cap).select("doc_id", "ref_no", "ref")


def dedupe_references(refs: DataFrame) -> DataFrame:
    """The first entry of each key, which is the first 50 characters after the number."""
    key = strip(F.substring(F.regexp_replace("ref", r"^\s*(?:［\d+］|\[\d+\]|\d+\.)", ""), 1, 50))
    first = Window.partitionBy("doc_id", "key").orderBy("pos")
    return refs.withColumn("key", key).where("key != ''").withColumn("r", F.row_number().over(first)).where("r = 1").drop("r", "key")


def reference_quality(refs: DataFrame) -> DataFrame:
    """Mean over entries of 0.3 number, 0.3 venue, 0.2 year, 0.2 length of 30 to 500."""
    c = F.col("ref")
    score = (
        F.when(c.rlike(r"^\s*(?:［\d+］|\[\d+\]|\d+\.)"), 0.3).otherwise(0.0) + F.when(_any(c, ("Journal", "期刊", "Conference", "Proceedings")), 0.3).otherwise(0.0)
        + F.when(c.rlike(YEAR), 0.2).otherwise(0.0) + F.when(F.length(c).between(30, 500), 0.2).otherwise(0.0)
    )
    return refs.groupBy("doc_id").agg(F.round(F.avg(score), 9).alias("quality"))


def reference_stats(refs: DataFrame) -> DataFrame:
    """R12"""
    return refs.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_refs"), F.min("ref_no").alias("first_no"), F.max("ref_no").alias("last_no"), F.avg(F.length("ref")).alias("mean_length")
    )


def repeated_lines(docs: DataFrame, least: int = 20, n: int = 5) -> DataFrame:
    """Lines over `least` characters that a document repeats, its n most frequent."""
    lines = lines_of(docs).select("doc_id", strip("line").alias("line")).where(F.length("line") > least)
    counts = lines.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("n").desc(), "line")))
    return ranked.where(F.col("r") <= n).drop("r")


def reference_anomalies(docs: DataFrame, blocks: DataFrame, refs: DataFrame) -> DataFrame:
    """Share of the block in the document, and flags for a block over 50,000 characters, more than 300 entries,
    entries over 500 on average, markers of later sections in the block, and the longest three entries."""
    stats = reference_stats(refs)
    longest = refs.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.length("ref").desc(), "pos"))).where("r <= 3")
    longest = longest.groupBy("doc_id").agg(in_order(F.length("ref"), "r").alias("longest"))
    size = docs.select("doc_id", F.length("text").alias("n_chars"))
    joined = blocks.join(size, "doc_id").join(stats, "doc_id", "left").join(longest, "doc_id", "left")
    return joined.select(
        "doc_id", F.round(F.length("block") / F.col("n_chars"), 9).alias("share"), (F.length("block") > 50_000).alias("block_long"),
        (F.coalesce("n_refs", F.lit(0)) > 300).alias("many"), (F.coalesce("mean_length", F.lit(0.0)) > 500).alias("entries_long"),
        _any(F.col("block"), ("致谢", "附录", "个人简历", "ACKNOWLEDGMENT", "APPENDIX")).alias("runs_on"), "longest",
    )


def numbering_styles(blocks: DataFrame) -> DataFrame:
    """Entries by way of numbering, and the most frequent way."""
    styles = {"square": r"\[\d+\]", "round": r"\(\d+\)", "lenticular": r"【\d+】", "dot": r"\d+\."}
    counts = {k: F.regexp_count("block", F.lit(r"(?m)^\s*" + p)) for k, p in styles.items()}
    most = F.greatest(*counts.values())
    return blocks.select("doc_id", *[v.alias(k) for k, v in counts.items()], F.when(most > 0, F.coalesce(*[F.when(v == most, k) for k, v in counts.items()])).alias("style"))


def chunk_references(blocks: DataFrame, size: int = 15_000) -> DataFrame:
    """doc_id, chunk_no, chunk: pieces of at most about `size` characters, cut at the middle entry of the zone
    around each limit."""
    marker = re.compile(r"［\d+］|\[\d+\]|\n\d+\.")

    def cut(text: str):
        at = 0
        while at < len(text):
            end = min(at + size, len(text))
            if end < len(text) and len(text) > size:
                zone = max(end - 1000, at + size // 2)
                places = [m.start() for m in marker.finditer(text[zone : end + 500])]
                if places:
                    end = max(zone + places[len(places) // 2], at + 1)
            if piece := text[at:end].strip():
                yield piece
            at = end

    return each_text(blocks.select("doc_id", F.col("block").alias("text")), lambda t: enumerate(cut(t)), chunk_no="int", chunk="string")
