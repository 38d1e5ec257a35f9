"""Sections, references, contents lists and chapters on hand-written documents."""

import hashlib

import pytest
from pyspark.sql import functions as F

from scholia import plans
from scholia.operators import chapters, quality, references, sections, toc
from scholia.operators.lines import lines_of
from scholia.plans import documents

STANDARD = """第五章 结论
参考文献
[1] 张三, 李四. 基于深度学习的图像识别方法研究[J]. 计算机学报, 2020, 43(5): 1-10.
[2] Smith J, Brown K. Machine Learning Applications[J]. Journal of AI Research, 2019, 15: 45-60.
[3] 王五. 自然语言处理技术综述[D]. 清华大学硕士学位论文, 2021.
致谢
感谢"""
WRAPPED = """参  考  文  献
[1] Smith J. A very long title about
the behaviour of wrapped lines. Journal of Texts, 2019.

【3】 Brown K. L. Another title. Proceedings of Things, 2020.
(4) White A. B. Last title of these. IEEE Press, 2021.
个人简历
nothing"""


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_reference_lists(spark):
    found = references.reference_block(docs(spark, STANDARD, WRAPPED, "no list", None))
    refs = references.split_references(found)
    got = {(r["doc_id"], r["ref_no"]): r["ref"] for r in refs.collect()}
    assert set(got) == {(0, 1), (0, 2), (0, 3), (1, 1), (1, 3), (1, 4)}
    assert got[1, 1] == "[1] Smith J. A very long title about the behaviour of wrapped lines. Journal of Texts, 2019."
    assert {r["doc_id"]: r["n_refs"] for r in references.reference_stats(refs).collect()} == {0: 3, 1: 3}
    assert all(r["v"] for r in refs.where("doc_id = 0").select(references.is_reference(F.col("ref")).alias("v")).collect())


def test_first_listed_marker_wins(spark):
    text = "参考文献\n" + "x" * 120 + "致谢" + "y" * 50 + "个人简历 z"
    assert references.reference_block(docs(spark, text)).first()["block"].endswith("y")
    nearest = references.reference_block_longest(docs(spark, "参考文献：" + "x" * 600 + "致谢" + "y" * 50 + "个人简历"))
    assert nearest.first()["block"] == "：" + "x" * 600


def test_many_continuation_lines(spark):
    text = "参考文献\n[1] start of it\n" + "\n".join(["more"] * 20_000)
    assert references.split_references(references.reference_block(docs(spark, text))).count() == 1


def test_numbering_filter(spark):
    rows = [(0, k, n, "x" * size) for k, (n, size) in enumerate([(1, 30), (2, 30), (40, 30), (3, 5), (4, 30), (2000, 30), (9, 30)])]
    refs = spark.createDataFrame(rows, "doc_id long, pos int, ref_no int, ref string")
    assert sorted(r["ref_no"] for r in references.filter_numbering(refs).collect()) == [1, 2, 4, 9]


def test_numbering_styles(spark):
    blocks = spark.createDataFrame([(0, "[1] a\n[2] b\n(3) c"), (1, "plain")], "doc_id long, block string")
    assert [(r["doc_id"], r["style"]) for r in references.numbering_styles(blocks).orderBy("doc_id").collect()] == [(0, "square"), (1, None)]


def test_sections(spark):
    text = "front\n摘要\nsome words\n1 引言\nintro text\nmore of it\n2.1 方法\n\n3. 参考文献\n[1] ref"
    got = [(r["ord"], r["title"], r["section_type"], r["level"]) for r in sections.parse_sections(docs(spark, text), plain=False).orderBy("ord").collect()]
    assert got == [(1, sections.HEADER, "header", 1), (2, "摘要", "abstract", 2), (3, "引言", "introduction", 1), (5, "参考文献", "references", 2)]


def test_merge_and_batch(spark):
    rows = [(0, k, f"t{k}", "x" * n, "unknown" if k == 1 else "results", 1) for k, n in enumerate([150, 500, 12_000, 50], 1)] + [(0, 9, "refs", "y", "references", 1)]
    s = spark.createDataFrame(rows, "doc_id long, ord int, title string, content string, section_type string, level int")
    merged = sections.merge_small_sections(s).orderBy("ord").collect()
    assert [(r["ord"], r["section_type"]) for r in merged] == [(1, "results"), (3, "results"), (4, "results"), (9, "references")]
    batches = {r["ord"]: r["batch"] for r in sections.batch_sections(s).collect()}
    assert batches == {1: 0, 2: 0, 3: 1, 4: 2, 9: 2}


def test_chunks_rebuild_the_text(spark):
    text = ("para one. " * 30 + "\n\n") * 20 + "句子。" * 500 + "z" * 3000
    got = [r["chunk"] for r in sections.chunk_text(docs(spark, text), 1000, 200).orderBy("chunk_no").collect()]
    assert max(map(len, got)) <= 1000 and "".join(got).replace("\n\n", "") == text.replace("\n\n", "")
    assert [r["chunk"] for r in sections.chunk_text(docs(spark, "", None)).collect()] == ["", ""]


def test_language(spark):
    zh, en, bo = "这是一个中文的句子内容\n" * 5, "these are many english words here\n" * 5, "བོད་ཡིག་བོད་ཡིག\n" * 5
    got = {r["doc_id"]: r["accepted"] for r in sections.language_gate(docs(spark, zh, en, bo, "")).collect()}
    assert got == {0: "chinese", 1: "english", 2: None, 3: None}


def test_contents_list(spark):
    text = "目 录\n摘要....I\n第一章 绪论....1\n1.1 背景....2\n1.2 意义....3\n参考文献....40\n致谢....45\n第一章 绪论 正文\nbody"
    bounds = toc.toc_boundary(docs(spark, text)).first()
    assert (bounds["first"], bounds["way"]) == (1, "heading")
    lines = lines_of(docs(spark, text)).where("line_no BETWEEN 1 AND 6")
    entries = toc.fix_toc(toc.dedupe_toc(toc.parse_toc_entries(lines)))
    got = [(r["level"], r["number"], r["page"], r["section_type"]) for r in entries.orderBy("line_number").collect()]
    assert got[1] == (1, "第一章", 1, "traditional_chapter") and got[2] == (2, "1.1", 2, "level2_section") and got[4][3] == "references"
    nested = toc.nest_toc(toc.parse_toc_entries(lines)).first()
    assert [len(c["sections"]) for c in nested["chapters"]] == [2] and [x["section_type"] for x in nested["special_sections"]] == ["abstract", "references"]
    assert [x["section_type"] for x in nested["post_references"]] == ["acknowledgment"]
    assert 0 < toc.toc_quality(toc.toc_summary(toc.parse_toc_entries(lines))).first()["quality"] <= 100


def test_sort_by_number(spark):
    rows = [(0, k, n) for k, n in enumerate(["", "第十章", "1.10", "1.2", "第二章"])]
    df = spark.createDataFrame(rows, "doc_id long, line_number int, number string")
    assert [r["number"] for r in toc.sort_toc(df).orderBy("pos").collect()] == ["1.2", "1.10", "第二章", "第十章", ""]


def test_toc_regions(spark):
    rows = [(0, k, f"Title {k} ... {k + 1}") for k in (1, 2, 4, 30, 31)] + [(0, 10, "prose")]
    df = spark.createDataFrame(rows, "doc_id long, paragraph_index int, text string")
    assert [(r["first"], r["last"], r["n"]) for r in toc.toc_regions(df).collect()] == [(1, 4, 3)]


MUSIC = "绪论\n正文一\n\n第一章 起源\n内容\n\n\n更多\n结语\n尾声\n致谢与声明\n声明\n致谢\n谢谢"


def test_chapter_boundaries(spark):
    found = [(0, k, x, "") for k, x in enumerate(["绪论", "起源", "结语", "致谢"])]
    ch = spark.createDataFrame(found, "doc_id long, ord int, title string, number string")
    ls = lines_of(docs(spark, MUSIC))
    starts = chapters.chapter_start_lines(ch, ls)
    assert {r["title"]: r["start_line"] for r in starts.collect()} == {"绪论": 0, "起源": 3, "结语": 8, "致谢": 12}
    got = {r["title"]: r["content"] for r in chapters.chapter_contents(chapters.chapter_ranges(starts, ls), ls).collect()}
    assert got["绪论"] == "正文一" and got["起源"] == "内容\n\n更多" and got["致谢"] == "谢谢"


def test_chapter_lines(spark):
    got = chapters.extract_chapters(docs(spark, "第一章 研究方法概述\n1. 背景介绍\nprose\nChapter 2 Results here"))
    assert [(r["number"], r["section_type"]) for r in got.orderBy("line_number").collect()] == [("一", "methodology"), ("1", "introduction"), ("Chapter 2", "results")]


def test_hierarchy(spark):
    text = "1 One\na\n1.1 Sub\nb\n1.2 Sub\nc\n2 Two\nd"
    got = [(r["number"], r["start_line"], r["end_line"]) for r in chapters.hierarchy(docs(spark, text)).orderBy("pos").collect()]
    assert got == [("1", 0, 5), ("2", 6, 7), ("1.1", 2, 3), ("1.2", 4, 5)]


@pytest.mark.parametrize("make", [
    lambda d: sections.parse_sections(d), lambda d: sections.detect_language(d), lambda d: references.reference_block(d), lambda d: toc.toc_boundary(d),
    lambda d: chapters.extract_chapters(d), lambda d: chapters.find_sections(d), lambda d: chapters.sections_by_marker(d), lambda d: references.repeated_lines(d),
])
def test_empty_and_null(spark, make):
    make(docs(spark, None, "")).collect()
    assert make(docs(spark, "x").limit(0)).count() == 0


def test_headings_keywords_titles_and_sections_far_into_a_text(spark, tmp_path):
    plain = "\n".join(f"plain words of line {k}" for k in range(300)) + "\n"
    end = "第二章 late\n第 二 章 Chapter   7; word"
    spark.createDataFrame([(1, plain + end), (2, "\n" * 20 + "aaaaaaaaaaaaaaa bbbbbbbbbbbbbbb")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    run = lambda name: {r["doc_id"]: r["value"] for r in plans.QUERIES[name](spark, str(tmp_path)).collect()}
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    assert run("p33_mark_headings_whole")[1] == md5(plain + end.replace("第二章 late", "### 第二章 late") + " end")
    assert run("p13_split_keywords_whole")[1] == md5("; ".join((plain + end).replace(";", " ").split()))
    assert run("p10_normalize_chapter_title_whole")[1] == md5("第三章 Chapter 4 " + plain + "第二章 late\n第二章 Chapter 7; word")
    rows = plans.QUERIES["a26_section_insights_whole"](spark, str(tmp_path)).where("doc_id = 2").collect()
    # empty lines have a blank strength and a score of 0 each, so the first five lines give ten
    assert {(r["ord"], r["kind"]) for r in rows} == {(k, x) for k in range(5) for x in ("strength", "low_score")}
    late = spark.createDataFrame([(1, "\n".join(["x" * 8 + " " + "y" * 30] + ["x" * 9] * 12))], "doc_id long, text string")
    got = quality.section_insights(documents.told_sections(late)).orderBy("rank").collect()
    assert got[1]["insight"] == "y" * 30 and max(r["ord"] for r in got) == 8


def test_fragments_have_words_of_running_text(spark):
    df = spark.createDataFrame([("通过实验", 1), ("第一章 绪论", 0), ("a long title, with commas, and more than fifty characters in it", 0), ("Results", 0), ("the results", 1)], "line string, want int")
    assert [r["want"] == r["got"] for r in df.select("want", chapters.is_content_fragment(F.col("line")).cast("int").alias("got")).collect()] == [True] * 5


def test_named_sections_need_their_bounds(spark):
    body = "句" * 120
    found = lambda text: {r["name"]: (r["start_position"], r["end_position"], r["content"]) for r in chapters.find_sections(docs(spark, text)).collect()}
    got = found(f"🙂x\n摘 要{body}关键词：甲，乙，丙\n1 绪论")
    assert got["abstract_cn"] == (3, 126, f"摘 要{body}") and got["keywords_cn"][2] == "关键词：甲，乙，丙" and set(got) == {"abstract_cn", "keywords_cn"}
    assert found(f"摘要{body[:99]}关键词：甲") == {} and "abstract_cn" not in found("摘要" + "句" * 5001 + "关键词")
    assert found("致谢" + "x" * 150)["acknowledgement"] == (0, 152, "致谢" + "x" * 150)
    rows = chapters.section_bounds(chapters.find_sections(docs(spark, f"a\nb\n摘要\n{body}\n目录")), docs(spark, f"a\nb\n摘要\n{body}\n目录")).collect()
    assert [(r["title"], r["start_line"], r["end_line"]) for r in rows] == [("摘要", 3, 5)]


def test_located_sections_take_the_best_pattern_of_their_family(spark):
    text = "见参考文献一节\n第二章  相关研究综述\n" + "x" * 30 + "\n 3. Third part\n参考文献\n[1] a"
    one = lambda title: [(r["title"], r["score"], r["start_line"], r["next_section"]) for r in chapters.locate_section(docs(spark, text), title).collect()]
    assert one("第二章") == one("参考文献") == [("第二章 相关研究综述", 2.0, 2, "3. Third part")]  # the words for chapter two come first
    assert one("References") == [("参考文献", 2.0, 5, "")]
    assert one("Third") == [("Third", 1.2, 4, "参考文献")]
    assert one("结论") == []


def test_chapter_content_by_number_title_or_first_letters(spark):
    body = "w " * 80
    text = f"目录\n第2章 Deep Nets\n{body}\n第3章 Other things\n{body}\n致谢\nthanks"
    rows = spark.createDataFrame([(0, 1, "Deep Nets", "2", 1), (0, 2, "Other-things!", "", 1), (0, 3, "thanks", "9", 1), (0, 4, "Missing", None, 1)], "doc_id long, ord int, title string, number string, level int")
    got = {r["ord"]: r["content"] for r in chapters.chapter_content_by_title(rows, docs(spark, text)).collect()}
    assert set(got) == {1, 2}
    assert got[1] == f"第2章 Deep Nets\n{body}".strip() and got[2] == f"Other things\n{body}".strip()


def test_topic_content(spark):
    told = lambda topic, text: docs(spark, text).select(chapters.topic_content(F.col("text"), topic).alias("c")).first()["c"]
    block = "研究现状" + "y" * 600
    assert told("literature", f"绪论 short 第二章 {block} 参考文献 z") == block + " "
    lines = "\n".join(["x", "技术 a"] * 150)
    assert told("literature", lines) == "\n".join(["技术 a"] * 100)  # the first 200 lines
    assert told("methodology", "研究方法" + "m" * 9_000).endswith("m...") and len(told("methodology", "研究方法" + "m" * 9_000)) == 8_003
    assert told("experiment", "实验设计" + "e" * 6_000) == "实验设计" + "e" * 4_996
    assert told("results", "no\nnothing") == ""


def test_conclusions_by_pattern_order_and_bounds(spark):
    block = lambda text: docs(spark, text).select(chapters.conclusion_block(F.col("text")).alias("c")).first()["c"]
    assert block("a 结论" + "c" * 300 + "参考文献") == "结论" + "c" * 300
    assert block("结论 short 参考文献 end") is None and block("结论" + "c" * 8_001) is None
    assert block("本论文主要研究了" + "d" * 9_000 + "附录") == "本论文主要研究了" + "d" * 9_000


def test_fallbacks_only_without_a_section(spark):
    cols = "doc_id long, text string, abstract_cn string, abstract_en string, keywords_cn string, keywords_en string, acknowledgement string"
    text = "摘要：" + "甲" * 60 + "关键词：一，二，三四\nAbstract " + "w" * 40 + " Keywords: a b"
    rows = [(0, text, None, None, None, None, None), (1, text, "摘要 given", "", None, "Keywords: k", " t ")]
    got = {r["doc_id"]: tuple(r)[1:] for r in chapters.fallback_fields(spark.createDataFrame(rows, cols)).collect()}
    assert got == {0: ("甲" * 60, "", "一；二；三四", "a; b", ""), 1: ("given", "", "一；二；三四", "k", "t")}


def test_sections_by_marker_end_by_their_own_rule(spark):
    text = "\n".join(["摘要", "text", "关键词：a", "PLAIN LINE", "参考文献"] + [f"entry {k}" for k in range(80)] + ["致谢" + "x" * 60, "致谢"] + ["y"] * 60)
    got = {r["section"]: (r["start_line"], r["end_line"]) for r in chapters.sections_by_marker(docs(spark, text)).collect()}
    assert got == {"abstract_cn": (0, 2), "keywords_cn": (2, 3), "references": (4, 86), "acknowledgement": (85, 135)}


def test_network_addresses_are_no_chapters(spark):
    got = chapters.extract_chapters(docs(spark, "56.187.231.175 Keit in lich auf\n28.68.19.23 from here\n8.8.4.114 and there\n1.2.3.4 Fourth level\n12. Twelfth\n3.14 Section"))
    assert {(r["number"], r["title"]) for r in got.collect()} == {("1", "2.3.4 Fourth level"), ("12", "Twelfth"), ("3", "14 Section")}


def test_next_chapter_has_its_title_on_its_line(spark):
    body = "x " * 80
    text = f"第1章 First\n{body}\n第2章 \nab.\n第3章 Third\n{body}\n2020\nsome text\n#\nmore text\n第4章 Fourth\n{body}"
    rows = spark.createDataFrame([(0, 1, "First", "1", 1), (0, 3, "Third", "3", 1)], "doc_id int, ord int, title string, number string, level int")
    got = {r["ord"]: r["content"] for r in chapters.chapter_content_by_title(rows, docs(spark, text)).collect()}
    assert got == {1: text[: text.index("第3章")].strip(), 3: text[text.index("第3章") : text.index("第4章")].strip()}


def test_next_section_has_its_title_on_its_line(spark):
    text = "start\n摘要\nsome words\n46895.\nmore words here\n12. Numbered part\nend"
    (row,) = chapters.locate_section(docs(spark, text), "摘要").collect()
    assert (row["end_pos"], row["next_section"]) == (text.index("\n12."), "12. Numbered part")


def test_rows_of_texts_are_handed_on_by_size(spark, monkeypatch):
    from scholia.operators import lines

    sent = []
    whole = lines.pa.RecordBatch
    kind = type(spark.range(1))
    monkeypatch.setattr(kind, "mapInArrow", lambda df, f, schema: sent.append(f))
    lines.each_text(docs(spark, "x"), lambda t: enumerate(t.split()), chunk_no="int", chunk="string")
    batch = whole.from_pydict({"doc_id": list(range(5)), "text": ["a b " * (1 << 17), "", None, "c", "d"]})
    got = list(sent[0](iter([batch])))
    assert sum(x.num_rows for x in got) == (1 << 18) + 2
    monkeypatch.setattr(lines, "HELD_CHARS", 1000)
    assert len(list(sent[0](iter([batch])))) == 2
    assert [(r["doc_id"], r["chunk"]) for x in sent[0](iter([batch])) for r in x.to_pylist()][-2:] == [(3, "c"), (4, "d")]


def test_chapters_are_numbered_as_in_the_contents_list(spark):
    body = "第1章 Alpha\n1. an item of a list\n1.2.3.4 Fourth level\n4.0. and a figure\n二、 a point\nChapter 7 of a book\n第2章 Beta\nend"
    said = lambda text: {(r["number"], r["title"]) for r in chapters.extract_chapters(docs(spark, text)).collect()}
    assert said("目录\n第1章 Alpha....3\n\n第2章 Beta....4\n" + body) == {("1", "Alpha....3"), ("2", "Beta....4"), ("1", "Alpha"), ("2", "Beta")}
    assert ("1", "an item of a list") in said("Contents\n  第1章 Alpha ... 3\n  1.1 Part ... 4\n" + body)
    # without a list, or where it has no numbers, every kind counts
    assert len(said(body)) == len(said("目录\nAlpha....3\n" + body)) == 7
    assert len(said("目 录\n第1章 Alpha....3")) == 1
    # long lists and long runs of blank lines are gone through once
    many = 50_000
    assert len(said("\n" * many + "目录\n" + "第1章 Alpha....3\n" * many + "\n" * many + "1. item\n第2章 Beta")) == 2


def test_first_chapter_is_no_number_of_another_kind(spark):
    text = "1.17.5.93 Foo bar\n1.2 Background of it\n1.\nsome words here\n绪论\nbody\n参考文献\n"
    (row,) = chapters.locate_section(docs(spark, text), "第一章").collect()
    assert (row["title"], row["score"], row["start_line"], row["next_section"]) == ("绪论", 1.8, 5, "参考文献")
    (row,) = chapters.locate_section(docs(spark, text + "1. A real title\nx"), "第一章").collect()
    assert (row["title"], row["score"], row["end_line"]) == ("A real title", 1.9, 9)


def test_sections_are_located_together(spark):
    text = "intro\n \n 中文摘要 \nwords\n\n\n3. Part three\nAbstract\nmore\n结 论\n附录"
    got = {r["section"]: (r["title"], r["score"], r["start_pos"], r["end_pos"], r["next_section"], r["content"]) for r in chapters.locate_sections(docs(spark, text, None, ""), ["摘要", "abstract", "结论", "第二章", "more"]).collect()}
    at = text.index
    assert got == {
        "摘要": ("中文摘要", 2.0, at("中"), at("\n\n\n3"), "3. Part three", "中文摘要 \nwords"), "abstract": ("Abstract", 2.0, at("Abstract"), at("\n结"), "结 论", "Abstract\nmore"),
        "结论": ("结 论", 2.0, at("结"), at("\n附"), "附录", "结 论"), "more": ("more", 2.0, at("more"), at("\n结"), "结 论", "more"),
    }
    blank = "\n" * 200_000  # gone through once
    row = chapters.locate_section(docs(spark, blank + "摘要" + blank + " 2. Part two"), "摘要").first()
    assert (row["score"], row["start_line"], row["end_pos"], row["content"]) == (2.0, 200_001, 200_002, "摘要")
