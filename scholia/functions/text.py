"""Column expressions over text.

Patterns are Java's; `U` makes \\s, \\w, \\d and letter case follow Unicode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U = "(?U)"


#: what Python's strip() takes off: white space, the wide kinds included.
SPACE = " \t\n\r\x0b\x0c\u00a0\u3000"


def strip(c) -> Column:
    """A column (or the name of one) without white space at its ends."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(SPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def strip_tags(c: Column) -> Column:
    """HTML tags removed; null becomes ''."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "<.*?>", "")


def normalize_date(c: Column) -> Column:
    """YYYYMMDD from year-month[-day] in several notations, a missing day being 01; null if none."""
    bare = F.regexp_replace(strip(c.cast("string")), r"（.*?）|\(.*?\)", "")
    dashed = F.regexp_replace(F.translate(bare, "年月日/.．", "--\0---"), r"(?U)[\s\x00]+", "")
    dashed = F.regexp_replace(dashed, "-+$", "")
    part = lambda p, g: F.nullif(F.regexp_extract(dashed, p, g), F.lit("")).try_cast("int")
    out = None
    for p, whole in ((r"^(\d{4})-(\d{1,2})-(\d{1,2})$", True), (r"^(\d{4})(\d{2})(\d{2})$", True), (r"^(\d{4})-(\d{1,2})$", False), (r"^(\d{4})(\d{2})$", False)):
        y, m, d = part(p, 1), part(p, 2), part(p, 3) if whole else F.lit(1)
        text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
        day = F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyyMMdd")
        out = F.when(dashed.rlike(p), day) if out is None else out.when(dashed.rlike(p), day)
    return out


def search_cutoff(*cols: str) -> Column:
    """The first date that can be read among the columns."""
    return F.coalesce(*[normalize_date(F.col(c)) for c in cols])


def script_ratio(c: Column) -> Column:
    """Han characters (and full-width forms) per word character, digits left out; null without any."""
    letters = F.regexp_replace(c, r"(?U)[\s\d\W]", "")
    han = F.length(F.regexp_replace(letters, r"[^\x{4e00}-\x{9fff}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]", ""))
    return F.when(F.length(letters) > 0, han / F.length(letters))


def is_chinese(c: Column, least: float = 0.3) -> Column:
    return F.coalesce(script_ratio(c) >= least, F.lit(False))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda w: w != ""))


def estimate_tokens(c: Column) -> Column:
    """P5: 1.5 a non-ASCII character plus words less those characters, cut to an int (may be below zero)."""
    wide = F.length(F.regexp_replace(c, r"[\x00-\x7F]", ""))
    return (wide * 1.5 + (word_count(c) - wide)).cast("int")


def size_tier(c: Column) -> Column:
    """P6"""
    tokens = F.floor(F.length(c) / 2)
    return F.when(tokens <= 64_000, "direct").when(tokens <= 200_000, "chunked").when(tokens <= 1_000_000, "map_reduce").otherwise("streaming")


def clean_field(c: Column) -> Column:
    """Control characters removed, white space collapsed, trimmed."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r"(?U)\s+", " "))


def strip_field_codes(c: Column) -> Column:
    """Residue of word-processor fields removed, white space collapsed."""
    out = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    # fixed patterns, in this order
    for p in (r'HYPERLINK.*?"', r"_Toc\d+", r'PAGEREF.*?"', r'REF.*?"', r'\\"'):
        out = F.regexp_replace(out, "(?i)" + p, "")
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


def truncate_by_lang(c: Column, lang: Column, chars: int = 30, words: int = 20) -> Column:
    """So many characters of Chinese or words of other text, then '...'."""
    zh = F.concat(strip(F.substring(c, 1, chars)), F.when(F.length(c) > chars, "...").otherwise(""))
    parts = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    other = F.when(F.size(parts) <= words, strip(c)).otherwise(F.concat(F.array_join(F.slice(parts, 1, words), " "), F.lit("...")))
    return F.when(lang == "chinese", zh).otherwise(other)


def normalize_chapter_title(c: Column) -> Column:
    """P10: blanks within chapter numbers removed."""
    out = F.regexp_replace(c, r"(?U)第\s*([一二三四五六七八九十]+|\d+)\s*章", "第$1章")
    return F.regexp_replace(out, r"(?iU)\b(chapter)\s+(\d+)", "$1 $2")


def clean_abstract(c: Column) -> Column:
    """Heading dropped, blanks collapsed."""
    out = F.regexp_replace(c, r"(?U)^(?:中文摘要|摘要|ABSTRACT|Abstract)[：:\s]*", "")
    return strip(F.regexp_replace(out, r"(?U)\s+", " "))


def refine_abstract(c: Column, cap: int = 2000, least: int = 1500) -> Column:
    """A heading line dropped, cut before the keywords, and, if over cap, after the last full stop that
    leaves more than `least` characters; without one it stays long."""
    headed = c.startswith("摘要") | c.startswith("摘\u3000要")
    after = F.when(F.instr(c, "\n") > 0, strip(_after(c, "\n"))).otherwise("")
    body = F.when(headed, after).otherwise(c)
    body = F.when(body.contains("关键词"), strip(F.substring_index(body, "关键词", 1))).otherwise(body)
    head = F.substring(body, 1, cap)
    stop = F.length(head) - F.instr(F.reverse(head), "。") + 1
    return F.when((F.length(body) > cap) & (F.instr(head, "。") > 0) & (stop - 1 > least), F.substring(head, F.lit(1), stop)).otherwise(body)


def _after(c: Column, mark: str) -> Column:
    return F.substring(c, F.instr(c, mark) + 1, F.length(c))


def split_keywords(c: Column) -> Column:
    """A keyword string without its label, split on commas, semicolons and white space."""
    bare = F.regexp_replace(c, r"(?iU)^(?:关键词|Keywords?|KEY\s+WORDS?)[：:\s]*", "")
    return F.filter(F.transform(F.split(bare, r"(?U)[,，;；\s]+"), lambda k: strip(k)), lambda k: k != "")


def format_keywords(c: Column, lang: Column) -> Column:
    return F.when(lang == "chinese", F.array_join(c, "；")).otherwise(F.array_join(c, "; "))


# Fixed patterns: labels that a value may carry.
LABELS = (
    r"^(?:学号|姓名|作者|标题|题目|专业|学院|大学)[：:\s]*",
    r"^(?:Student|Author|Title|Name|Major|College|University)[：:\s]*",
    r"^(?:学位授予单位|学位授予日期)[：:\s]*",
    r"年\s*月\s*日\s*$",
    r"^\*\*[^*]+\*\*[：:\s]*",
)


def clean_metadata(c: Column, field: str) -> Column:
    """A value without labels, then by field: a name of 2-4 characters, a title of 8 or
    more on one line, the university, the major, or the college."""
    out = strip(c)
    for p in LABELS:
        out = strip(F.regexp_replace(out, "(?iU)" + p, ""))
    some = lambda p: F.nullif(F.regexp_extract(out, p, 1), F.lit(""))
    if field == "author_cn":
        out = strip(F.regexp_replace(out, r"(?U)(?:姓名|作者|学生|研究生)[：:\s]*", ""))
        return F.coalesce(F.nullif(F.regexp_extract(out, r"(?U)([^\s\d]{2,4})", 1), F.lit("")), out)
    if field == "title_cn":
        for p in (r"\*\*转换时间\*\*[^*]*", r"^\d{4}-\d{2}-\d{2}.*", r"作者姓名.*", r"\n+"):
            out = F.regexp_replace(out, p, "")
        return F.when(F.length(strip(out)) < 8, "").otherwise(strip(out))
    if field == "title_en":
        out = strip(F.regexp_replace(out, r"\n+", " "))
        return F.when(out.contains("Dissertation") & out.contains("Degree") & (F.length(out) > 100), "").otherwise(out)
    if field == "university_cn":
        college = some(r"(?U)([^\s\d]*学院)")
        return F.coalesce(some(r"(?U)([^\s\d]*大学)"), F.when(~college.contains("材料"), college), out)
    if field == "major_cn":
        return strip(F.regexp_replace(out, r"(?U)(?:专业|学科)[：:\s]*", ""))
    if field == "college":
        return F.when(out.contains("学院"), out).otherwise("")
    return out


# Fixed patterns of the fields, the first that matches wins.
METADATA_PATTERNS = {
    "thesis_number": (r"论文编号[：:]\s*([A-Z0-9\-\.]+)", r"编号[：:]\s*([A-Z0-9\-\.]+)", r"分类号[：:]\s*([A-Z0-9\-\.]+)", r"密级[：:]\s*([A-Z0-9\-\.]+)", r"UDC[：:]\s*([A-Z0-9\-\.]+)"),
    "title_cn": (r"(?:中文)?(?:论文)?题目[：:\s]*([^\n\r]{10,200})", r"(?:论文)?标题[：:\s]*([^\n\r]{10,200})", r"([^\n\r\d]{8,50}\n[^\n\r\d]{8,50})", r"^([^A-Za-z\n\r]{10,100})$"),
    "author_cn": (r"(?:作者|姓名)[：:\s]*([^\d\n\r]{2,10})", r"研究生[：:\s]*([^\d\n\r]{2,10})"),
    "title_en": (r"(?:English\s+)?(?:Title|TITLE)[：:\s]*([A-Za-z\s\-:]{10,200})", r"([A-Z][A-Za-z\s\-,]{15,200}(?:\n[A-Za-z\s\-]{10,200})*)", r"^([A-Z][A-Za-z\s\-:]{15,200})$"),
    "author_en": (r"(?:Author|Name)[：:\s]*([A-Za-z\s]{2,30})", r"(?:By|by)[：:\s]*([A-Za-z\s]{2,30})"),
    "university_cn": (r"([^A-Za-z\n\r]*大学[^A-Za-z\n\r]*)", r"([^A-Za-z\n\r]*学院[^A-Za-z\n\r]*)"),
    "degree_level": (r"(博士|硕士|学士)(?:学位|研究生)?", r"(PhD|Master|Bachelor)"),
    "major_cn": (r"(?:专业|学科)[：:\s]*([^\n\r]{2,50})", r"(?:Major|MAJOR)[：:\s]*([^\n\r]{2,50})"),
    "college": (r"(?:学院|系)[：:\s]*([^\n\r]{2,50})", r"(?:College|School)[：:\s]*([^\n\r]{2,50})"),
    "supervisor_cn": (r"(?:导师|指导教师)[：:\s]*([^\d\n\r]{2,10})", r"(?:Supervisor|SUPERVISOR)[：:\s]*([^\d\n\r]{2,10})"),
    "supervisor_en": (
        r"(?:Supervisor|SUPERVISOR)[：:\s]*([A-Za-z\s\.]+?)(?:\n|$|[，,])", r"(?:Advisor|ADVISOR)[：:\s]*([A-Za-z\s\.]+?)(?:\n|$|[，,])",
        r"(?:Directed\s+by|DIRECTED\s+BY)[：:\s]*([A-Za-z\s\.]+?)(?:\n|$|[，,])", r"(?:Under\s+the\s+guidance\s+of)[：:\s]*([A-Za-z\s\.]+?)(?:\n|$|[，,])",
        r"((Prof\.|Professor|Dr\.)\s+[A-Za-z\s]+?)(?:\n|$|[，,])",
    ),
    "defense_date": (r"(?:答辩|Defense)(?:日期|Date)[：:\s]*(\d{4}[-/年]\d{1,2}[-/月]\d{1,2})", r"(\d{4}[-/]\d{1,2}[-/]\d{1,2})"),
    "keywords_cn": (r"(?:关键词|Keywords?)[：:\s]*([^\n\r]{5,200})", r"(?:Key\s+words?)[：:\s]*([^\n\r]{5,200})"),
    "keywords_en": (r"(?:Keywords?|KEY\s+WORDS?)[：:\s]*([A-Za-z\s,;]{5,200})",),
}


def extract_metadata(c: Column, patterns: dict = METADATA_PATTERNS) -> dict[str, Column]:
    """For each field the first group of the first pattern that matches; null if none does."""
    return {
        field: F.coalesce(*[blank_to_null(F.regexp_extract(c, "(?mU)" + p, 1)) for p in ordered]) for field, ordered in patterns.items()
    }


def field_candidates(c: Column, ordered, least: int = 2) -> Column:
    """Every match of every pattern, in order, each once, of `least` characters or more."""
    found = F.flatten(F.array(*[F.regexp_extract_all(c, F.lit("(?mU)" + p), F.lit(1)) for p in ordered]))
    return F.array_distinct(F.filter(F.transform(found, lambda x: strip(x)), lambda x: F.length(x) >= least))


# Fixed markers: what ends a cover, in this order.
COVER_ENDS = ("学位论文使用授权书", "学位论文原创性声明", "独创性声明", "版权使用授权书", "中文摘要", "摘要", "ABSTRACT")


def cover_region(c: Column, markers=COVER_ENDS) -> Column:
    """Text before the first marker, in list order, that is not at its very start; else a tenth."""
    tenth = F.substring(c, F.lit(1), F.floor(F.length(c) / 10).cast("int"))
    return F.coalesce(*[F.when(F.instr(c, m) > 1, F.substring(c, F.lit(1), F.instr(c, m) - 1)) for m in markers], tenth)


def front_matter(c: Column) -> Column:
    """P18"""
    return F.substring(c, F.lit(1), F.least(F.lit(10_000), F.floor(F.length(c) / 4)).cast("int"))


# Fixed patterns of section types, in this order.
SECTION_TYPES = {
    "abstract": (r"(?:摘\s*要|ABSTRACT)", r"(?:中文摘要|英文摘要)", r"(?:关键词|Keywords|关键字)"),
    "introduction": (r"(?:引\s*言|导\s*论|前\s*言|绪\s*论)", r"(?:INTRODUCTION)", r"(?:背景|研究背景|Background)"),
    "literature_review": (r"(?:文献综述|相关工作|研究现状)", r"(?:国内外研究现状|国内外发展现状)", r"(?:LITERATURE\s*REVIEW|Related\s*Work)", r"(?:理论基础|理论背景)"),
    "theory_framework": (r"(?:理论框架|理论基础|概念框架)", r"(?:系统设计|系统架构|架构设计)", r"(?:THEORY|FRAMEWORK)", r"(?:设计思路|设计原理)"),
    "methodology": (r"(?:研究方法|方法|算法|模型)", r"(?:METHODOLOGY|METHOD)", r"(?:技术路线|实现方案|解决方案)", r"(?:算法设计|模型构建)"),
    "experiment": (r"(?:实验|试验|测试|验证)", r"(?:EXPERIMENT|IMPLEMENTATION)", r"(?:实验设计|实验方案|实验过程)", r"(?:性能测试|功能测试)"),
    "results": (r"(?:结果|实验结果|测试结果)", r"(?:RESULTS|ANALYSIS)", r"(?:数据分析|结果分析|性能分析)", r"(?:讨论|Discussion)"),
    "conclusion": (r"(?:结论|总结|小结)", r"(?:CONCLUSION|SUMMARY)", r"(?:研究结论|主要结论)", r"(?:展望|未来工作|Future\s*Work)"),
    "references": (r"(?:参考文献|引用文献|文献)", r"(?:REFERENCES|BIBLIOGRAPHY)"),
    "appendix": (r"(?:附录|APPENDIX)",),
}
# Fixed words of chapter types, in this order.
CHAPTER_WORDS = (
    ("introduction", ("绪论", "引言", "背景", "introduction", "background")),
    ("literature_review", ("综述", "现状", "review", "survey")),
    ("methodology", ("方法", "设计", "method", "design", "approach")),
    ("experiment", ("实验", "experiment", "test")),
    ("results", ("结果", "分析", "result", "analysis")),
    ("conclusion", ("结论", "总结", "conclusion", "summary")),
)


def _words(c: Column, classes) -> Column:
    out = None
    for name, words in classes:
        hit = F.lit(False)
        for w in words:
            hit = hit | c.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def section_type(c: Column, types: dict = SECTION_TYPES) -> Column:
    """The first type with a pattern in the title, else 'unknown'."""
    out = None
    for name, patterns in types.items():
        hit = c.rlike("(?iU)" + "|".join(patterns))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unknown")


def guess_section_type(c: Column) -> Column:
    """P23"""
    return _words(F.lower(c), CHAPTER_WORDS).otherwise("unknown")


# Classes of known section types; words of titles, in this order; words of contents, in this order.
TYPE_CLASSES = {
    "introduction": "literature_review", "literature_review": "literature_review", "background": "literature_review",
    "methodology": "methodology", "methods": "methodology", "results": "results", "experiments": "results",
    "conclusion": "conclusion", "conclusions": "conclusion", "references": "references",
    "acknowledgment": "acknowledgment", "acknowledgments": "acknowledgment", "achievements": "achievements",
}
TITLE_CLASSES = (
    ("literature_review", ("绪论", "引言", "introduction", "综述", "现状", "背景", "概述")),
    ("methodology", ("方法", "method", "算法", "algorithm", "模型", "model", "设计")),
    ("results", ("实验", "experiment", "结果", "result", "分析", "analysis", "评估")),
    ("conclusion", ("结论", "conclusion", "总结", "summary", "展望")),
    ("references", ("参考文献", "reference", "文献")),
    ("acknowledgment", ("致谢", "acknowledgment", "谢辞")),
    ("theoretical", ("理论", "theory", "原理", "principle", "基础")),
    ("system", ("系统", "system", "实现", "implementation")),
)
CONTENT_CLASSES = (
    ("results", ("实验结果", "性能评估", "对比分析", "数据显示", "测试结果", "评价指标")),
    ("methodology", ("提出方法", "算法流程", "模型架构", "实现步骤", "设计思路", "技术路线")),
    ("literature_review", ("研究现状", "文献分析", "相关研究", "发展历程", "研究趋势")),
)


def classify_chapter(kind: Column, title: Column, content: Column) -> Column:
    """A known type's class, else by the title's words, else by those of the content's first 1000 characters, else 'general'."""
    known = None
    for k, v in TYPE_CLASSES.items():
        known = F.when(kind == k, v) if known is None else known.when(kind == k, v)
    head = F.lower(F.substring(content, 1, 1000))
    return F.coalesce(known, _words(F.lower(title), TITLE_CLASSES), _words(head, CONTENT_CLASSES), F.lit("general"))


# Types, numbers and words for a review chapter, and words against one.
REVIEW_TYPES = ("introduction", "literature_review", "background", "overview")
FIRST_NUMBERS = ("一", "1", "1.", "I", "第1章", "第一章")
REVIEW_WORDS = (
    "绪论", "引言", "综述", "背景", "现状", "概述", "introduction", "review", "background", "survey", "overview", "相关工作", "文献综述", "研究现状",
    "国内外研究", "理论基础", "related work", "literature review", "state of art", "theoretical foundation",
)
METHOD_WORDS = (
    "实验", "方法", "设计", "实现", "测试", "结果", "分析", "系统", "experiment", "method", "implementation", "test", "result", "analysis", "system",
)


def is_review_chapter(kind: Column, number: Column, title: Column, level: Column | None = None) -> Column:
    """P25: by type, as a first chapter of level 1, or by its words; never with a word against it."""
    low = F.lower(F.coalesce(title, F.lit("")))
    first = number.isin(*FIRST_NUMBERS) & ((level if level is not None else F.lit(1)) == 1)
    named = _words(low, (("y", REVIEW_WORDS),)).isNotNull()
    veto = _words(low, (("y", METHOD_WORDS),)).isNotNull()
    no = F.lit(False)
    return (F.coalesce(kind.isin(*REVIEW_TYPES), no) | F.coalesce(first, no) | named) & ~veto


def extract_json(c: Column) -> Column:
    """The outermost {...} of a text without code fences; null if none."""
    bare = F.regexp_replace(c, r"(?i)```(?:json)?", "")
    return F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit(""))


def parse_json_lenient(c: Column, fields: list[str]) -> Column:
    """A struct of string fields: parsed; else parsed without control characters; else each
    field by pattern.  Null if no way finds a field."""
    schema = ", ".join(f"`{f}` STRING" for f in fields)
    clean = F.regexp_replace(c, r"[\x00-\x1f]", " ")
    some = lambda s: F.when(F.coalesce(*[s[f] for f in fields]).isNotNull(), s)
    by_field = F.struct(*[F.nullif(F.regexp_extract(clean, rf'"{f}"\s*:\s*"([^"]*)"', 1), F.lit("")).alias(f) for f in fields])
    return F.coalesce(some(F.from_json(c, schema)), some(F.from_json(clean, schema)), some(by_field))


# Patterns of title lines in plain text, and words of main titles.
TITLE_LINES = (
    r"^\d+[\.、]\s*", r"^[一二三四五六七八九十]+[\.、]\s*", r"^第[一二三四五六七八九十]+章", r"^Abstract$|^摘要$", r"^Introduction$|^引言$", r"^Conclusion$|^结论$",
    r"^References$|^参考文献$", r"^致谢$|^Acknowledgments?$",
)
MAIN_WORDS = ("摘要", "Abstract", "引言", "结论", "参考文献")


def mark_headings(c: Column) -> Column:
    """Lines trimmed; of title lines, those under 50 characters with a main word get '## ', others under 80 '### '."""
    def mark(line):
        x, title = strip(line), None
        for p in TITLE_LINES:
            title = x.rlike(U + p) if title is None else title | x.rlike(U + p)
        main = F.lit(False)
        for w in MAIN_WORDS:
            main = main | x.contains(w)
        return F.when(title & (F.length(x) < 50) & main, F.concat(F.lit("## "), x)).when(title & (F.length(x) < 80), F.concat(F.lit("### "), x)).otherwise(x)

    return F.array_join(F.transform(F.split(c, "\n"), mark), "\n")


def md_title(c: Column) -> Column:
    """The first level-one heading."""
    return blank_to_null(F.regexp_extract(c, r"(?m)^#\s+(.+)$", 1))


def md_keywords(c: Column) -> Column:
    return blank_to_null(F.regexp_extract(c, r"(?miU)^[\*\s]*(?:关键词|关键字|key\s*words?)[\*\s]*[：:][\*\s]*(.+)$", 1))


def md_block(c: Column, heading: str) -> Column:
    """The text under a heading up to the next one."""
    return blank_to_null(F.regexp_extract(F.concat(F.lit("\n"), c), rf"(?is)\n#+[ \t]*[^\n]*?{heading}[^\n]*\n(.*?)(?=\n#|\z)", 1))


def md_date(c: Column, label: str) -> Column:
    """A labelled date, on the label's line or the next."""
    return normalize_date(F.nullif(F.regexp_extract(c, rf"(?U){label}[\*：:\s]*\n?\s*(\d{{4}}\s*[-年/.]\s*\d{{1,2}}(?:\s*[-月/.]\s*\d{{1,2}}\s*日?|\s*月)?)", 1), F.lit("")))


def count_references(c: Column) -> Column:
    """Lines that begin with [n]; where there are none, lines that are not blank."""
    lines = F.split(F.coalesce(c, F.lit("")), "\n")
    numbered = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*\[\d+\]")))
    return F.when(numbered > 0, numbered).otherwise(F.size(F.filter(lines, lambda x: strip(x) != "")))


def core_profile(fields: dict[str, int]) -> Column:
    """Fields cut to their lengths and joined."""
    return F.concat_ws(" | ", *[blank_to_null(F.substring(F.col(c), 1, n)) for c, n in fields.items()])


def with_metadata(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumns(extract_metadata(F.col(text_col)))
