"""Column expressions over paper records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholia.functions.text import blank_to_null, strip

# Fixed values of the rules: words, classes and their order.
INSTITUTION_WORDS = (
    "University", "Department", "College", "Institute", "Hospital", "Center", "School", "Laboratory",
    "Research", "Medical", "Electronic address", "USA", "China", "Dept.",
)
INSTITUTION_TYPES = ("大学", "医院", "研究院", "研究所", "中心")
FUND_SOURCES = (
    (("国家自然科学基金",), "国家自然科学基金"),
    (("国家重点研发计划",), "国家重点研发计划"),
    (("省自然科学基金", "省科学基金"), "省级自然科学基金"),
    (("教育部",), "教育部项目"),
    (("企业", "公司"), "企业资助"),
)
OTHER_FUND = "其他资助"
THEME_WORDS = (
    ("method", ("方法", "method", "模型", "model", "算法", "algorithm", "分析", "analysis", "技术", "technology")),
    ("theory", ("理论", "theory", "框架", "framework", "概念", "concept", "原理", "principle", "机制", "mechanism")),
    ("empirical", ("实证", "empirical", "实验", "experiment", "案例", "case", "调查", "survey", "数据", "data")),
    ("application", ("应用", "application", "实践", "practice", "系统", "system", "平台", "platform", "工具", "tool")),
)
RELEVANCE_WORDS = (
    ("研究方法与技术", ("方法", "method", "算法", "algorithm", "模型", "model", "技术", "technique")),
    ("理论框架构建", ("理论", "theory", "框架", "framework", "概念", "concept")),
    ("实证研究分析", ("实验", "experiment", "实证", "empirical", "案例", "case study")),
    ("应用实践研究", ("应用", "application", "实践", "practice", "系统", "system")),
    ("分析评估方法", ("分析", "analysis", "评估", "evaluation", "测量", "measurement")),
    ("优化改进研究", ("优化", "optimization", "改进", "improvement", "创新", "innovation")),
)
OTHER_RELEVANCE = "相关理论研究"
LAYER_WORDS = (
    ("theory", ("理论", "theory", "框架", "framework", "模型", "model", "机制", "mechanism")),
    ("method", ("方法", "method", "算法", "algorithm", "技术", "technique", "策略", "strategy")),
    ("application", ("应用", "application", "实验", "experiment", "案例", "case", "临床", "clinical")),
    ("review", ("综述", "review", "进展", "progress", "现状", "state")),
)


def contains_any(c: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | c.contains(w)
    return found


def first_class(c: Column, classes, otherwise: Column) -> Column:
    """The name of the first (name, words) of which c contains a word."""
    out = None
    for name, words in classes:
        hit = contains_any(c, words)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(otherwise)


def paper_keywords() -> Column:
    """The keyword list if there is one, else the keyword string split; entries of 2+ characters."""
    words = F.when(F.col("KeyWords") != "nan", F.transform(F.split(F.regexp_replace("KeyWords", "；", ";"), ";"), lambda k: strip(k)))
    chosen = F.when(F.size("DetailedKeywords") > 0, F.col("DetailedKeywords")).otherwise(words)
    return F.transform(F.filter(chosen, lambda k: F.length(k) > 1), lambda k: strip(k))


def is_person_name(c: Column) -> Column:
    """Filled, at most 50 characters, no word of an institution."""
    # one pattern, so that a name is put into lower case once
    institution = "|".join(f"\\Q{w.lower()}\\E" for w in INSTITUTION_WORDS)
    return F.coalesce((c != "") & (F.length(c) <= 50) & ~F.lower(c).rlike(institution), F.lit(False))


def fund_source(c: Column) -> Column:
    """P20"""
    return first_class(c, [(name, words) for words, name in FUND_SOURCES], F.lit(OTHER_FUND))


def institution_type(c: Column) -> Column:
    """P21"""
    return first_class(c, [(t, (t,)) for t in INSTITUTION_TYPES], F.lit(None).cast("string"))


def paper_relevance(keywords: Column, title: Column) -> Column:
    """P26"""
    both = F.concat_ws("\n", F.lower(keywords), F.lower(title))
    return first_class(both, RELEVANCE_WORDS, F.lit(OTHER_RELEVANCE))


def research_layers() -> dict[str, Column]:
    """A flag per layer over title, keywords and abstract."""
    text = F.lower(F.concat_ws(" ", "Title", "KeyWords", "Abstract"))
    return {f"is_{name}": contains_any(text, words) for name, words in LAYER_WORDS}


def theme_category(c: Column) -> Column:
    """P28"""
    return first_class(F.lower(c), THEME_WORDS, F.lit(None).cast("string"))


def similarity_band(c: Column) -> Column:
    """P29"""
    return F.when(c >= 0.8, "high").when(c >= 0.6, "medium").when(c >= 0.4, "low")


def paper_text() -> Column:
    """Title, keywords and abstract, blanks left out."""
    return F.concat_ws(" ", *[blank_to_null(F.col(c)) for c in ("Title", "KeyWords", "Abstract")])


def thesis_text(title: str, keywords: str, abstract: str) -> Column:
    return F.concat_ws(" ", *[blank_to_null(F.col(c)) for c in (title, keywords, abstract)])


def citation_card(chinese: Column | None = None) -> dict[str, Column]:
    """Display strings of a record: authors, publication, funds, metrics, abstract."""
    zh = F.col("lang") == "Chinese" if chinese is None else chinese
    named = F.filter("Authors", lambda a: F.coalesce(a["name"], F.lit("")) != "")
    shown = F.transform(F.slice(named, 1, 5), lambda a: F.concat(a["name"], F.when(a["corresponding"], "*").otherwise("")))
    more = F.when(F.size(named) > 5, F.when(zh, "等").otherwise(" et al.")).otherwise("")
    issue = F.when(blank_to_null(F.col("Source.issue")).isNotNull(), F.concat(F.lit("("), F.col("Source.issue"), F.lit(")"))).otherwise("")
    volume = F.concat(F.coalesce("Source.volume", F.lit("")), issue)
    loaded, cited = F.col("Metrics.download_count"), F.col("Metrics.citation_count")
    return {
        "authors": F.concat(F.array_join(shown, ", "), more),
        "publication": F.concat_ws(", ", blank_to_null(F.coalesce("Source.title", "Journal")), blank_to_null(F.col("Source.year")), blank_to_null(volume)),
        "funds": F.array_join(F.slice(F.filter("Funds.title", lambda t: F.coalesce(t, F.lit("")) != ""), 1, 2), "; "),
        "metrics": F.concat_ws(
            "; ", F.when(loaded > 0, F.when(zh, F.concat(F.lit("下载"), loaded.cast("string"), F.lit("次"))).otherwise(F.concat(loaded.cast("string"), F.lit(" downloads")))),
            F.when(cited > 0, F.when(zh, F.concat(F.lit("被引"), cited.cast("string"), F.lit("次"))).otherwise(F.concat(cited.cast("string"), F.lit(" citations")))),
        ),
        "abstract": F.when(F.length("Abstract") > 120, F.concat(F.substring("Abstract", 1, 120), F.lit("..."))).otherwise(F.col("Abstract")),
    }
