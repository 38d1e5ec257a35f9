"""The marker-offset index, the title index and the sweep against plain patterns and loops."""

import random
import re
import time

import pytest

from scholia.operators import chapters, offsets, titles
from scholia.operators.lines import lines_of

ATOMS = (
    "摘 要|中文摘要|ABSTRACT|Abstract|关键词：a，b c d e|英文摘要|目录|目 录|1 |1 绪论|\n1 绪论|\n 1  绪 论|2 |\n2 心脏建模的基础理论|\n2 研基础理论x基础理论|2 研|\n3 心脏CTA图像分割|\n3 研 图像分割 图像分割|3 |\n4 四维动态|4 研|"
    "\n4 四维动态统计体形心脏模型的构建|5 结|\n5 结论|5 |参考文献|参 考 文 献|致谢|攻读|攻读学位学位期间发表的论文和论文|第一章|第二章|第1章|###1.1|### 1.1 a|### 1.1\n\n b|###1.2|### 1.2 |###2.|###3.|###4.1 x|###4.2|###4.3\r|"
    "###4.4|###5.|文献综述|相关工作|基础理论|第三章|第四章|研究方法|实验结果分析|结果分析|模型构建|第五章|结论|总结|结论与展望|总 结与展望|研究总结|附录|REFERENCES|References|\n\n致谢与声明|\n 致 谢|\n\n|\n|\n|\r\n| |"
    "大连理工大学|Keywords|Key Words: a b c d e f|###2.1|###2.2 |###2.3|###3.1|###3.2|###3.3|###3.4|###3.5"
).split("|")


def text_of_atoms(rnd):
    filler = lambda: "".join(rnd.choice("ab 句1\n") for _ in range(rnd.randrange(12)))
    return "".join(rnd.choice(ATOMS) if rnd.random() < 0.6 else filler() for _ in range(rnd.choice([6, 20, 60])))


def narrowed(pattern):
    """A pattern whose bounds short texts try from both sides."""
    return re.sub(r"\{(\d+),(\d+)\}\?", lambda m: "{%d,%d}?" % (int(m[1]) // 50, int(m[2]) // 100), pattern)


def test_sections_are_the_first_matches_of_their_patterns():
    library = {n: narrowed(p) for n, p in chapters.LIBRARY.items()}
    assert sum(offsets.bounded(p) is None for p in library.values()) == 2  # the two of one line
    rnd, met = random.Random(1), 0
    for _ in range(1_500):
        text = text_of_atoms(rnd)
        want = {n: m.span() for n, p in library.items() if (m := re.search(p, text, re.I | re.M)) and m[0]}
        assert {x[0]: x[1:3] for x in offsets.first_sections(text, library)} == want
        met += len(want)
    assert met > 5_000


def test_patterns_of_another_form_are_matched_as_they_are(spark):
    library = {"a": r"(a[\s\S]{2,4}?)(?=b)", "word": r"W\w+", "cased": r"(\n*x.*?Yy[\s\S]{0,9}?)(?=z)", "none": "q"}
    df = spark.createDataFrame([(0, "ab a12b W33 xayy__z"), (1, None), (2, "")], "doc_id long, text string")
    got = {r["name"]: (r["start_position"], r["content"], r["start_line"]) for r in chapters.find_sections(df, library).collect()}
    assert got == {"a": (3, "a12", 1), "word": (8, "W33", 1), "cased": (12, "xayy__", 1)}


def test_the_cost_grows_with_the_length_of_a_text():
    rnd = random.Random(2)
    unit = "".join(text_of_atoms(rnd) + "x" * 60 for _ in range(40)) + " " * 400 + "\n" * 400
    took = []
    for k in (8, 64):
        best = []
        for _ in range(3):
            began = time.perf_counter()
            offsets.first_sections(unit * k, chapters.LIBRARY)
            best.append(time.perf_counter() - began)
        took.append(min(best))
    assert took[1] < 24 * took[0]  # eight times the text


def test_bounds_of_sections_from_elsewhere(spark):
    docs = spark.createDataFrame([(0, "a\nb\nc d\ne"), (1, "x")], "doc_id long, text string")
    told = spark.createDataFrame([(0, "s", 2, 7, "b\nc d"), (0, "t", 8, 9, "e"), (1, "u", 0, 1, "x")], "doc_id long, name string, start_position int, end_position int, content string")
    got = {r["name"]: (r["start_line"], r["end_line"], r["title"], r["content_length"]) for r in chapters.section_bounds(told, docs).collect()}
    assert got == {"s": (2, 3, "b", 5), "t": (4, 4, "e", 1), "u": (1, 1, "x", 1)}


def by_patterns(text, title, number, level, least=100, past=20):
    """The content of a chapter by the nine patterns, one after the other."""
    t, flags = re.escape(title), re.I | re.M
    tried = []
    if number:
        n = re.escape(number)
        tried += [rf"第{n}章\s*{t}", rf"Chapter\s+{n}\s*[：:]\s*{t}", rf"^{n}\s*{t}", rf"^{n}\.\s*{t}", rf"^{n}[\s\.、]\s*{t}"]
    tried.append(rf"^{t}\s*$")
    if level is not None and level <= 3:
        tried.append(rf"#{{{level},3}}\s*{t}")
    tried += [rf"^\s*{t}\s*[：:]?\s*$", t]
    m = next((m for p in tried if (m := re.search(p, text, flags))), None)
    if m is None:
        bare = re.sub(r"[^\w一-鿿]", "", title)
        m = re.search(r"[^\w一-鿿]*" + re.escape(bare[:5]), text, re.I) if len(bare) > 3 else None
    if m is None:
        return None
    rest = text[m.start() + len(title) + past :]
    ends = [x.start() for p in chapters.NEXT_CHAPTERS if (x := re.search(p, rest, flags))]
    end = m.start() + len(title) + past + ends[0] if ends else len(text)
    return m.start(), end


def test_titles_by_index_are_those_of_the_patterns():
    rnd, found = random.Random(7), 0
    names = ["绪论", "Deep", "deep nets", "a", "结果 分析", "致谢", "x-y z!", "方法", "aa"]
    marks = ["第%s章", "第 %s章 ", "Chapter %s: ", "chapter  %s ：", "\n%s", "\n%s ", "\n%s. ", "\n%s、", "%s.", "## ", "# ", "####", "\n", "\n  ", " ", ""]
    tails = ["\n", "：\n", " :", " \n\n", "\n ：  \n", " tail words here\n", "，"]
    for _ in range(3_000):
        text = ""
        for _ in range(rnd.randrange(1, 14)):
            m = rnd.choice(marks)
            text += (m % rnd.choice(["1", "2", "12", "一", "1.1"]) if "%s" in m else m) + rnd.choice([*names, "参考文献", "other text of a line"]) + rnd.choice(tails)
        rows = [{"title": t, "number": rnd.choice(["1", "2", "12", "一", "1.1", "", None]), "level": rnd.choice([1, 2, 3, 4, None])} for t in names]
        got = {k: span for k, *span in titles.contents_by_title(text, rows, chapters.NEXT_CHAPTERS, 20)}
        for k, c in enumerate(rows):
            want = by_patterns(text, c["title"], c["number"], c["level"])
            assert got.get(k) == (None if want is None else [want[0], max(want[1], min(want[0] + len(c["title"]) + 20, len(text)))]), (text, c)
            found += want is not None
    assert found > 10_000


def test_content_by_title_of_null_and_missing_texts(spark):
    docs = spark.createDataFrame([(0, None), (1, ""), (2, "T" * 3 + " x" * 100)], "doc_id long, text string")
    rows = spark.createDataFrame([(k, 1, "TTT", None, None) for k in (0, 1, 2, 9)] + [(2, 2, "", "1", 1), (2, 3, None, "1", 1)], "doc_id long, ord int, title string, number string, level int")
    assert [(r["doc_id"], r["ord"]) for r in chapters.chapter_content_by_title(rows, docs).collect()] == [(2, 1)]


def chapter_tables(spark, seed):
    rnd = random.Random(seed)
    docs, rows = [], []
    for d in range(12):
        titles_ = [rnd.choice(["绪论", "方法", "致谢", "结果与分析", "a b", "ab", "b", "aab"]) for _ in range(rnd.randrange(1, 7))]
        lines = []
        for _ in range(rnd.randrange(0, 40)):
            lines.append(rnd.choice(["", "", "  ", "text of a line", "致谢与声明", "x" * 60, *titles_, *(t + " and more words than that" for t in titles_), *(f"第一章 {t}" for t in titles_)]))
        docs.append((d, "\n".join(lines)))
        rows += [(d, k, t, str(k)) for k, t in enumerate(titles_)]
    return docs, rows, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(rows, "doc_id long, ord int, title string, number string")


@pytest.mark.parametrize("slack", [0, 5, 20])
def test_start_lines_ranges_and_contents_by_loops(spark, slack):
    docs, rows, df, ch = chapter_tables(spark, slack)
    ls = lines_of(df)
    starts = chapters.chapter_start_lines(ch, ls, slack)
    text = {d: t.split("\n") for d, t in docs}
    want = {}
    for d, k, t, _ in rows:
        at = [i for i, x in enumerate(text[d]) if x.strip() and t in x.strip() and len(x.strip()) <= len(t) + slack and not (t == "致谢" and "致谢与声明" in x)]
        want[d, k] = at[0] if at else 0
    assert {(r["doc_id"], r["ord"]): r["start_line"] for r in starts.collect()} == want
    ranges = chapters.chapter_ranges(starts, ls)
    edges = {}
    for d in text:
        mine = sorted((want[d, k], k) for x, k, _, _ in rows if x == d)
        for (s, k), nxt in zip(mine, [*mine[1:], None]):
            stop = max(s, nxt[0] - 1 if nxt else len(text[d]) - 1)
            full = [i for i in range(s + 1, stop + 1) if text[d][i].strip()]
            edges[d, k] = (full[0], full[-1]) if full else (s, stop)
    assert {(r["doc_id"], r["ord"]): (r["start_line"], r["end_line"]) for r in ranges.collect()} == edges
    out = {}
    for (d, k), (a, b) in edges.items():
        part = text[d][a : b + 1]
        out[d, k] = "\n".join(x for i, x in enumerate(part) if x.strip() or i == 0 or part[i - 1].strip())
    assert {(r["doc_id"], r["ord"]): r["content"] for r in chapters.chapter_contents(ranges, ls).collect()} == out


def test_contents_of_overlapping_ranges_and_lines_with_gaps(spark):
    ls = spark.createDataFrame([(0, k, x) for k, x in ((1, "a"), (2, ""), (4, " "), (5, "b"), (6, "c"))] + [(1, k, f"l{k}") for k in range(5)], "doc_id long, line_no int, line string")
    rs = spark.createDataFrame([(0, 1, "t", 0, 5), (0, 2, "t", 5, 9), (0, 3, "t", 7, 9), (1, 1, "u", 1, 3), (1, 2, "u", 0, 4), (1, 3, "u", 3, 1), (1, 4, "u", 4, 99)], "doc_id long, ord int, title string, start_line int, end_line int")
    got = {(r["doc_id"], r["ord"]): r["content"] for r in chapters.chapter_contents(rs, ls).collect()}
    assert got == {(0, 1): "a\n\nb", (0, 2): "b\nc", (1, 1): "l1\nl2\nl3", (1, 2): "l0\nl1\nl2\nl3\nl4", (1, 4): "l4"}


def test_ranges_move_lines_once(spark):
    _, _, df, ch = chapter_tables(spark, 3)
    ls = lines_of(df)
    plan = chapters.chapter_contents(chapters.chapter_ranges(ch.selectExpr("*", "0 AS start_line"), ls), ls)._jdf.queryExecution().executedPlan().toString()
    assert "BETWEEN" not in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan
