"""Column expressions on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from scholia.functions import papers as fp
from scholia.functions import text as t


def value(spark, make, *texts):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, c string")
    return [r["v"] for r in df.select("k", make(F.col("c")).alias("v")).orderBy("k").collect()]


def test_normalize_date(spark):
    cases = {
        "2024年12月": "20241201", "2024年6月": "20240601", "2024-05-06": "20240506", "2024/5/6": "20240506", "20240506": "20240506", "202405": "20240501",
        "2024年5月6日（周一）": "20240506", "2024．5．6": "20240506", "2024-13-01": None, "n.d.": None, "": None, None: None,
    }
    assert value(spark, t.normalize_date, *cases) == list(cases.values())


def test_script_and_language(spark):
    assert value(spark, lambda c: F.round(t.script_ratio(c), 3), "中文ab", "123 !", None) == [0.5, None, None]
    assert value(spark, t.is_chinese, "中文中文a", "only english", "", None) == [True, False, False, False]


def test_estimate_tokens_may_be_negative(spark):
    assert value(spark, t.estimate_tokens, "中文字", "two words", "") == [2, 2, 0]


def test_wide_space_in_headings(spark):
    assert value(spark, t.section_type, "摘　要", "第三章 方法", "References", "Nothing here") == ["abstract", "methodology", "references", "unknown"]


def test_titles_and_truncation(spark):
    assert value(spark, t.normalize_chapter_title, "第 一 章 绪论", "Chapter   1 x", "第 12 章") == ["第一章 绪论", "Chapter 1 x", "第12章"]
    assert value(spark, lambda c: t.truncate_by_lang(c, F.lit("english")), "a b", " ".join("x" * 25)) == ["a b", " ".join("x" * 20) + "..."]


def test_cover_and_metadata(spark):
    cover = "论文题目：一种新的高温合金设计制备方法\n作者：张三\nSupervisor: Dr. John Smith\n学位论文使用授权书\n摘要 text"
    assert value(spark, t.cover_region, cover, "摘要 first", "x" * 100)[0].endswith("John Smith\n")
    assert value(spark, t.cover_region, "x" * 100) == ["x" * 10]
    found = t.extract_metadata(F.col("c"))
    df = spark.createDataFrame([(cover,)], "c string").select(*[v.alias(k) for k, v in found.items()]).first()
    assert df["title_cn"] == "一种新的高温合金设计制备方法" and df["author_cn"] == "张三" and df["supervisor_en"] == "Dr. John Smith"
    assert df["thesis_number"] is None


@pytest.mark.parametrize("line,want", [("Supervisor: Dr. John Smith", "Dr. John Smith"), ("Advisor: Mary Lee", "Mary Lee"), ("Directed by: Prof. Ann Bell", "Prof. Ann Bell"), ("Professor Tim Hunt", "Professor Tim Hunt")])
def test_supervisors(spark, line, want):
    assert value(spark, lambda c: t.extract_metadata(c)["supervisor_en"], line + "\nnext") == [want]


def test_json_from_model_output(spark):
    fenced = 'Here:\n```json\n{"title": "A", "score": "7"}\n```'
    control = '{"title": "A\x01B", "score": "7"}'
    broken = '{"title": "A", "score": "7", oops'
    got = value(spark, lambda c: t.parse_json_lenient(F.coalesce(t.extract_json(c), c), ["title", "score"]), fenced, control, broken, "no json", None)
    assert [g and (g["title"], g["score"]) for g in got] == [("A", "7"), ("A B", "7"), ("A", "7"), None, None]


def test_markdown(spark):
    md = "# Title\n**关键词**：甲；乙\n## 摘要\nline one\nline two\n## Next\n日期：\n2021年3月4日\n"
    assert value(spark, t.md_title, md) == ["Title"]
    assert value(spark, lambda c: t.md_block(c, "摘要"), md) == ["line one\nline two"]
    assert value(spark, lambda c: t.md_date(c, "日期"), md) == ["20210304"]
    assert value(spark, lambda c: t.split_keywords(t.md_keywords(c)), md) == [["甲", "乙"]]


def test_count_references(spark):
    assert value(spark, t.count_references, "[1] a\n[2] b\nrest", "a\n\nb", "", None) == [2, 2, 0, 0]


def test_refine_abstract(spark):
    long = "摘要\n" + "句子内容。" * 500 + "关键词：x"
    early = "句子。" + "x" * 3000
    out = value(spark, t.refine_abstract, long, "摘　要 heading\n short 关键词 k", "中文摘要：kept as it is", early, "摘要 alone")
    assert len(out[0]) == 2000 and out[0].endswith("。") and out[1:] == ["short", "中文摘要：kept as it is", early, ""]
    assert len(value(spark, t.refine_abstract, "a" * 1500 + "。" + "b" * 600)[0]) == 2101  # a stop at 1500 is too early
    assert len(value(spark, t.refine_abstract, "a" * 1501 + "。" + "b" * 600)[0]) == 1502


def test_keywords_are_joined_by_language(spark):
    join = lambda lang: lambda c: t.format_keywords(t.split_keywords(c), F.lit(lang))
    assert value(spark, join("chinese"), "关键词：甲，乙 丙;丁") == ["甲；乙；丙；丁"]
    assert value(spark, join("english"), "KEY  WORDS: a, b", "Keyword b;c", " Keywords: x") == ["a; b", "b; c", "Keywords:; x"]


def test_clean_abstract(spark):
    assert value(spark, t.clean_abstract, "摘要：  a\n b ", "Abstract: x", "abstract: x", "英文摘要 x") == ["a b", "x", "abstract: x", "英文摘要 x"]


def test_classify_chapter(spark):
    df = spark.createDataFrame([
        ("introduction", "算法", ""), ("methods", "结论", ""), ("overview", "系统实现", ""), ("x", "谢辞", ""), ("x", "基础原理", ""), (None, "综述与方法", ""), ("x", "第五章", "本文技术路线"),
        ("x", "第五章", "y" * 1000 + "技术路线"), ("x", "参考文献", ""), ("conclusion", None, None), ("x", None, None),
    ], "kind string, title string, content string")
    got = [r[0] for r in df.select(t.classify_chapter(F.col("kind"), F.col("title"), F.col("content"))).collect()]
    assert got == ["literature_review", "methodology", "system", "acknowledgment", "theoretical", "literature_review", "methodology", "general", "references", "conclusion", "general"]


def test_review_chapters(spark):
    df = spark.createDataFrame([
        ("background", "9", "z", 1), ("x", "1.", "z", 1), ("x", "1", "z", 2), ("x", "I", "系统", 1), ("x", "2", "国内外研究", 1), ("introduction", "1", "Test bed", 1), ("x", "2", "Overview", 1),
        ("x", "2", "文献进展", 1), ("x", "第一章", None, 1), (None, None, "Design", 1),
    ], "kind string, number string, title string, level int")
    got = [r[0] for r in df.select(t.is_review_chapter(F.col("kind"), F.col("number"), F.col("title"), F.col("level"))).collect()]
    assert got == [True, True, False, False, True, False, True, False, True, False]


def test_mark_headings(spark):
    text = "  摘要 \n1. One\n2 two\n第一章 结论\n第1章 x\n\nAbstract of it\n一、" + "x" * 90 + "\n致谢\n3.14"
    want = "## 摘要\n### 1. One\n2 two\n## 第一章 结论\n第1章 x\n\nAbstract of it\n一、" + "x" * 90 + "\n### 致谢\n### 3.14"
    assert value(spark, t.mark_headings, text) == [want]


def test_person_names_and_funds(spark):
    assert value(spark, fp.is_person_name, "Li Wei", "Tsinghua University", "x" * 51, "", None) == [True, False, False, False, False]
    assert value(spark, fp.fund_source, "国家自然科学基金(1)", "省科学基金", "某公司", "other") == ["国家自然科学基金", "省级自然科学基金", "企业资助", "其他资助"]
    assert value(spark, fp.institution_type, "北京大学医院", "某医院", "x") == ["大学", "医院", None]


def test_themes(spark):
    assert value(spark, fp.theme_category, "深度学习模型", "Grounded Theory", "case study", "platform", "苹果") == ["method", "theory", "empirical", "application", None]
    assert value(spark, lambda c: fp.paper_relevance(c, F.lit("")), "algorithm", "framework", "case study", "x") == ["研究方法与技术", "理论框架构建", "实证研究分析", "相关理论研究"]
