"""Registered queries over documents, pages, events and conversations, with their SQL.

The documents are plain prose without chapter numbers or reference lists, so marker and
pattern sets are given as parameters; `dressed` adds numbered headings and references that follow
from each document's own words, for the operators that need them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scholia.functions import text as t
from scholia.operators import chapters as ch
from scholia.operators import logs, quality, ranking, references, scoring, sections, toc
from scholia.operators.lines import lines_of, once
from scholia.sources import io, publish
from scholia.sources.sample import load

QUERIES, ORACLE_SQL = {}, {}


def add(name: str, make, sql: str | None = None) -> None:
    """make(docs, spark, sf_dir) -> DataFrame."""
    QUERIES[name] = lambda spark, sf_dir: make(load(spark, sf_dir, "documents"), spark, sf_dir)
    if sql:
        ORACLE_SQL[name] = stripping(sql)


#: what strip() takes off.
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288)"


def stripping(sql: str) -> str:
    """sql whose trim(x), which takes off spaces only, takes off all that strip() does."""
    out, at = "", 0
    while (k := sql.find("trim(", at)) >= 0:
        depth, j, two = 1, k + 5, False
        while depth:
            c = sql[j]
            depth += (c == "(") - (c == ")")
            two |= c == "," and depth == 1
            j += 1
        inner = stripping(sql[k + 5 : j - 1])
        out += sql[at : k + 5] + inner + ("" if two else ", " + BLANKS) + ")"
        at = j
    return out + sql[at:]


def scalar(name: str, expr, sql: str) -> None:
    """A query of one expression of a document's row."""
    add(name, lambda d, *_: d.select("doc_id", expr(F.col("text")).alias("value")), f"SELECT doc_id, {sql} AS value FROM documents")


WS = r"[ \t\n\x0b\f\r]+"
WORDS = f"list_filter(regexp_split_to_array(text, '{WS}'), lambda w: w <> '')"
FIRST_LINE = "string_split(text, chr(10))[1]"
LINES = "d AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"

# scalars
add("p1_strip_tags", lambda d, s, x: load(s, x, "pages").select("page_id", t.strip_tags(F.col("html")).alias("value")),
    "SELECT page_id, regexp_replace(coalesce(html, ''), '<.*?>', '', 'g') AS value FROM pages")
add("p2_normalize_date", lambda d, s, x: load(s, x, "orders").select("o_orderkey", *[
        t.normalize_date(c).alias(k) for k, c in {
            "iso": F.date_format("o_orderdate", "yyyy-MM-dd"), "han": F.date_format("o_orderdate", "yyyy年M月d日"), "month": F.date_format("o_orderdate", "yyyy年MM月"),
            "slash": F.concat(F.date_format("o_orderdate", "yyyy/M/d"), F.lit(" (note)")), "bad": F.col("o_orderpriority"),
        }.items()]),
    "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS iso, strftime(o_orderdate, '%Y%m%d') AS han, strftime(o_orderdate, '%Y%m01') AS month, strftime(o_orderdate, '%Y%m%d') AS slash, NULL::VARCHAR AS bad FROM orders")
add("p3_search_cutoff", lambda d, s, x: load(s, x, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.lit("")).otherwise(F.date_format("o_orderdate", "yyyy-MM")).alias("a"), F.date_format("o_orderdate", "yyyyMMdd").alias("b"))
    .select("o_orderkey", t.search_cutoff("a", "b").alias("cutoff")),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y%m%d') ELSE strftime(o_orderdate, '%Y%m01') END AS cutoff FROM orders")
scalar("p4_script_ratio", lambda c: F.round(t.script_ratio(F.concat(c, F.lit("中文"))), 9),
       r"round(2 / length(regexp_replace(text || '中文', '[\s\x0b\x{85}\x{a0}\p{Z}\p{Nd}]|[^\p{L}\p{M}\p{N}\p{Pc}]|\p{No}|\p{Nl}', '', 'g')), 9)")
scalar("p5_estimate_tokens", t.estimate_tokens, rf"CAST(trunc(length(regexp_replace(text, '[\x00-\x7F]', '', 'g')) * 1.5 + (len({WORDS}) - length(regexp_replace(text, '[\x00-\x7F]', '', 'g')))) AS INTEGER)")
scalar("p6_size_tier", lambda c: t.size_tier(F.repeat(c, 40)), "CASE WHEN length(text) * 40 // 2 <= 64000 THEN 'direct' WHEN length(text) * 40 // 2 <= 200000 THEN 'chunked' WHEN length(text) * 40 // 2 <= 1000000 THEN 'map_reduce' ELSE 'streaming' END")
scalar("p7_clean_field", lambda c: F.md5(t.clean_field(c)), rf"md5(trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '{WS}', ' ', 'g')))")
scalar("p8_strip_field_codes", lambda c: F.md5(t.strip_field_codes(F.concat(c, F.lit(' _Toc123 HYPERLINK "x end')))), rf"md5(trim(regexp_replace(text || ' x end', '{WS}', ' ', 'g')))")
scalar("p9_truncate_by_lang", lambda c: t.truncate_by_lang(c, F.when(F.col("doc_id") % 2 == 0, "chinese").otherwise("english")),
       f"CASE WHEN doc_id % 2 = 0 THEN trim(substr(text, 1, 30)) || CASE WHEN length(text) > 30 THEN '...' ELSE '' END WHEN len({WORDS}) <= 20 THEN trim(text) ELSE array_to_string(({WORDS})[1:20], ' ') || '...' END")
scalar("p10_normalize_chapter_title", lambda c: t.normalize_chapter_title(F.concat(F.lit("第 三 章 Chapter   4 "), c)), "'第三章 Chapter 4 ' || text")
scalar("p11_clean_abstract", lambda c: F.md5(t.clean_abstract(F.concat(F.lit("Abstract: "), c))), rf"md5(trim(regexp_replace(regexp_replace(text, '^{WS}', ''), '{WS}', ' ', 'g')))")
def abstract(c):
    head = F.when(F.col("doc_id") % 3 == 0, F.lit("摘要 of it\n")).when(F.col("doc_id") % 3 == 1, "摘\u3000要：").otherwise("")
    return F.concat(head, F.replace(c, F.lit("."), F.lit("。")), F.when(F.col("doc_id") % 2 == 0, F.lit("关键词 x")).otherwise(""))


scalar("p12_refine_abstract", lambda c: F.md5(t.refine_abstract(abstract(c))), """md5((
  SELECT CASE WHEN length(b) > 2000 AND strpos(substr(b, 1, 2000), '。') > 0 AND 2000 - strpos(reverse(substr(b, 1, 2000)), '。') > 1500
    THEN substr(b, 1, 2000 - strpos(reverse(substr(b, 1, 2000)), '。') + 1) ELSE b END
  FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN trim(a) ELSE a END AS b FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN trim(x) WHEN doc_id % 3 = 1 THEN
    CASE WHEN strpos(x, chr(10)) > 0 THEN trim(substr(x, strpos(x, chr(10)) + 1)) ELSE '' END ELSE x END AS a FROM (SELECT replace(text, '.', '。') AS x)))))""")
scalar("p13_split_keywords", lambda c: t.format_keywords(t.split_keywords(F.concat(F.lit("Keywords: "), c)), F.lit("english")),
       r"array_to_string(list_filter(regexp_split_to_array(text, '[,，;；\s\x0b]+'), lambda w: w <> ''), '; ')")
DRESSED_COVER = "concat_ws(chr(10), '论文题目：' || 'Study of ' || source || ' texts', '作者：张三 ', 'Supervisor: Dr. John Smith', '答辩日期：2023-05-06', '学位论文原创性声明', text)"


def cover(c):
    return F.concat_ws("\n", F.concat(F.lit("论文题目：Study of "), "source", F.lit(" texts")), F.lit("作者：张三 "), F.lit("Supervisor: Dr. John Smith"), F.lit("答辩日期：2023-05-06"), F.lit("学位论文原创性声明"), c)


scalar("p15_clean_metadata", lambda c: t.clean_metadata(F.concat(F.lit("题目："), F.substring_index(c, "\n", 1)), "title_cn"),
       f"CASE WHEN length(trim({FIRST_LINE})) < 8 THEN '' ELSE trim({FIRST_LINE}) END")
add("p16_extract_metadata", lambda d, *_: d.select("doc_id", *[v.alias(k) for k, v in t.extract_metadata(cover(F.col("text")), {k: t.METADATA_PATTERNS[k] for k in ("title_cn", "author_cn", "supervisor_en", "defense_date", "thesis_number")}).items()]),
    "SELECT doc_id, 'Study of ' || source || ' texts' AS title_cn, '张三' AS author_cn, 'Dr. John Smith' AS supervisor_en, '2023-05-06' AS defense_date, NULL::VARCHAR AS thesis_number FROM documents")
scalar("p17_cover_region", lambda c: F.md5(t.cover_region(F.when(F.col("doc_id") % 2 == 0, cover(c)).otherwise(c))),
       "md5(CASE WHEN doc_id % 2 = 0 THEN concat_ws(chr(10), '论文题目：Study of ' || source || ' texts', '作者：张三 ', 'Supervisor: Dr. John Smith', '答辩日期：2023-05-06', '') ELSE substr(text, 1, length(text) // 10) END)")
scalar("p18_front_matter", lambda c: F.md5(t.front_matter(c)), "md5(substr(text, 1, least(10000, length(text) // 4)))")
TYPES_SQL = "CASE " + " ".join("WHEN regexp_matches(lower({0}), lower('" + "|".join(p).replace(r"\s", r"[ \t]") + f"')) THEN '{n}'" for n, p in t.SECTION_TYPES.items()) + " ELSE 'unknown' END"
WORDS_SQL = "CASE " + " ".join("WHEN " + " OR ".join("contains({0}, '" + w + "')" for w in ws) + f" THEN '{n}'" for n, ws in t.CHAPTER_WORDS) + " {1} END"
SWAP = "replace(replace(replace({0}, ' the ', ' 方法 '), ' is ', ' summary '), ' les ', ' 背景 ')"


def swapped(c):
    for a, b in ((" the ", " 方法 "), (" is ", " summary "), (" les ", " 背景 ")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


scalar("p22_section_type", lambda c: t.section_type(swapped(F.substring_index(c, "\n", 1))), TYPES_SQL.format(SWAP.format(FIRST_LINE)))
scalar("p23_guess_section_type", lambda c: t.guess_section_type(swapped(F.substring_index(c, "\n", 1))), WORDS_SQL.format(f"lower({SWAP.format(FIRST_LINE)})", "ELSE 'unknown'"))
def has(x: str, words: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words.split(",")) + ")"


TITLE = f"lower({SWAP.format(FIRST_LINE)})"
CONTENT = "lower(substr(replace(replace(replace(text, ' and ', '实验结果'), ' und ', '技术路线'), ' de ', '研究趋势'), 1, 1000))"


def told(c):
    for a, b in ((" and ", "实验结果"), (" und ", "技术路线"), (" de ", "研究趋势")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


scalar("p24_classify_chapter", lambda c: t.classify_chapter(F.when(F.col("doc_id") % 5 == 0, "introduction").when(F.col("doc_id") % 5 == 1, "experiments").otherwise("other"), swapped(F.substring_index(c, "\n", 1)), told(c)),
       f"""CASE WHEN doc_id % 5 = 0 THEN 'literature_review' WHEN doc_id % 5 = 1 THEN 'results'
  WHEN {has(TITLE, '绪论,引言,introduction,综述,现状,背景,概述')} THEN 'literature_review' WHEN {has(TITLE, '方法,method,算法,algorithm,模型,model,设计')} THEN 'methodology'
  WHEN {has(TITLE, '实验,experiment,结果,result,分析,analysis,评估')} THEN 'results' WHEN {has(TITLE, '结论,conclusion,总结,summary,展望')} THEN 'conclusion'
  WHEN {has(TITLE, 'reference,文献')} THEN 'references' WHEN {has(TITLE, 'theory,principle,理论,原理,基础')} THEN 'theoretical' WHEN {has(TITLE, '系统,system,实现,implementation')} THEN 'system'
  WHEN {has(CONTENT, '实验结果')} THEN 'results' WHEN {has(CONTENT, '技术路线')} THEN 'methodology' WHEN {has(CONTENT, '研究趋势')} THEN 'literature_review' ELSE 'general' END""")
scalar("p25_is_review_chapter", lambda c: t.is_review_chapter(F.when(F.col("doc_id") % 11 == 0, "overview").otherwise("x"), (F.col("doc_id") % 7).cast("string"), swapped(F.substring_index(c, "\n", 1)), (F.col("doc_id") % 2 + 1)),
       f"""(doc_id % 11 = 0 OR (doc_id % 7 = 1 AND doc_id % 2 = 0) OR {has(TITLE, '绪论,引言,综述,背景,现状,概述,introduction,review,background,survey,overview,相关工作,国内外研究,理论基础,related work,state of art,theoretical foundation')})
  AND NOT {has(TITLE, '实验,方法,设计,实现,测试,结果,分析,系统,experiment,method,implementation,test,result,analysis,system')}""")
add("p31_extract_json", lambda d, s, x: load(s, x, "events").select("event_id", t.extract_json(F.concat(F.lit("Answer:\n```json\n"), "props", F.lit("\n``` done"))).alias("value")), "SELECT event_id, props AS value FROM events")
add("p32_parse_json_lenient", lambda d, s, x: load(s, x, "events").select("event_id", t.parse_json_lenient(F.concat(F.lit('{"kind": "'), "event_type", F.when(F.col("event_id") % 3 == 0, F.lit("\n")).otherwise(""), F.lit('", "id": "'), F.col("event_id").cast("string"), F.when(F.col("event_id") % 5 == 0, F.lit('", broken')).otherwise(F.lit('"}'))), ["kind", "id"]).alias("s"))
    .select("event_id", F.trim("s.kind").alias("kind"), "s.id"), "SELECT event_id, event_type AS kind, CAST(event_id AS VARCHAR) AS id FROM events")
# words of the prose as markers of a thesis, so that sections of all lengths come about
MARKS = (
    (" with ", "\n结论\n"), (" from ", "\n致谢\n"), (" this ", "\n摘要\n"), (" are ", "\n关键词：a，b c\n"), (" was ", "\n参考文献\n"), (" by ", "\n第二章 研究方法\n"), (" que ", "\n绪论\n"),
    (" die ", "\n实验结果\n"), (" la ", "\n目录\n"), (" it ", "\nAbstract\n"), (" und ", "\n 3. part\n"),
)


def marked(c):
    for a, b in MARKS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(c, F.lit(" end"))


MARKED = "text"
for a, b in MARKS:
    MARKED = f"replace({MARKED}, '{a}', '" + b.replace("\n", "' || chr(10) || '") + "')"
MARKED = f"{MARKED} || ' end'"
marks = lambda d: once(d, "doc_id", text=marked(F.col("text")))
HEADED = """array_to_string(list_transform(string_split({0}, chr(10)), lambda x: (CASE WHEN regexp_matches(trim(x),
  '^[0-9]+[.、]|^[一二三四五六七八九十]+[.、]|^第[一二三四五六七八九十]+章|^(Abstract|摘要|Introduction|引言|Conclusion|结论|References|参考文献|致谢|Acknowledgment|Acknowledgments)$')
  THEN CASE WHEN length(trim(x)) < 50 AND regexp_matches(x, '摘要|Abstract|引言|结论|参考文献') THEN '## ' WHEN length(trim(x)) < 80 THEN '### ' ELSE '' END ELSE '' END) || trim(x)), chr(10))"""
scalar("p33_mark_headings", lambda c: t.mark_headings(marked(c)), HEADED.format(MARKED))
# digests of the three above
scalar("p10_normalize_chapter_title_whole", lambda c: F.md5(t.normalize_chapter_title(F.concat(F.lit("第 三 章 Chapter   4 "), c))), "md5('第三章 Chapter 4 ' || text)")
scalar("p13_split_keywords_whole", lambda c: F.md5(t.format_keywords(t.split_keywords(F.concat(F.lit("Keywords: "), c)), F.lit("english"))),
       r"md5(array_to_string(list_filter(regexp_split_to_array(text, '[,，;；\s\x0b]+'), lambda w: w <> ''), '; '))")
scalar("p33_mark_headings_whole", lambda c: F.md5(t.mark_headings(marked(c))), f"md5({HEADED.format(MARKED)})")
MD = "'# T ' || source || chr(10) || '**关键词**：' || lang || ', x' || chr(10) || '## 摘要' || chr(10) || string_split(text, chr(10))[1] || chr(10) || '## Next' || chr(10) || '日期：' || chr(10) || '2021年3月4日'"


def markdown(c):
    return F.concat(F.lit("# T "), "source", F.lit("\n**关键词**："), "lang", F.lit(", x\n## 摘要\n"), F.substring_index(c, "\n", 1), F.lit("\n## Next\n日期：\n2021年3月4日"))


add("p34_markdown_fields", lambda d, *_: d.select("doc_id", *[f(markdown(F.col("text"))).alias(k) for k, f in {"title": t.md_title, "keywords": t.md_keywords, "block": lambda c: t.md_block(c, "摘要"), "date": lambda c: t.md_date(c, "日期")}.items()]),
    "SELECT doc_id, 'T ' || source AS title, lang || ', x' AS keywords, nullif(trim(string_split(text, chr(10))[1]), '') AS block, '20210304' AS date FROM documents")
scalar("p36_count_references", lambda c: t.count_references(F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(c, r"\n", "\n[7] ")).otherwise(c)),
       "CASE WHEN doc_id % 2 = 0 AND len(string_split(text, chr(10))) > 1 THEN (len(string_split(text, chr(10))) - 1)::INTEGER ELSE len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::INTEGER END")
add("p37_core_profile", lambda d, *_: d.select("doc_id", t.core_profile({"text": 200, "lang": 150, "source": 3}).alias("value")),
    "SELECT doc_id, concat_ws(' | ', nullif(trim(substr(text, 1, 200)), ''), lang, substr(source, 1, 3)) AS value FROM documents")
add("p38_field_candidates", lambda d, *_: d.select("doc_id", F.array_join(t.field_candidates(F.col("text"), (r"(?:^|\n)(Th[a-z]+) ", r" (un[a-z]*)[ ,.]")), "|").alias("value")), r"""
SELECT doc_id, array_to_string(list_filter(v, lambda z, i: list_position(v, z) = i), '|') AS value
FROM (SELECT doc_id, list_filter(list_concat(regexp_extract_all(text, '(?:^|\n)(Th[a-z]+) ', 1), regexp_extract_all(text, ' (un[a-z]*)[ ,.]', 1)), lambda z: length(z) >= 2) AS v FROM documents)""")

# documents: language, sections, chunks, statistics
LANG = f"""
WITH {LINES}, g AS (SELECT doc_id, len(list_filter(regexp_split_to_array(line, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z]{{4,}}'))) > 2 AS en FROM d WHERE line_no < 100 AND length(trim(line)) >= 3),
a AS (SELECT doc_id, count(*) AS n, bool_or(en) AS en FROM g GROUP BY doc_id)"""
add("x1_detect_language", lambda d, *_: sections.detect_language(d), LANG + """
SELECT x.doc_id, coalesce(n, 0) > 0 AS other, CASE WHEN en THEN 'english' WHEN n > 0 THEN 'other' ELSE 'unknown' END AS language FROM documents x LEFT JOIN a USING (doc_id)""")
add("x2_language_gate", lambda d, *_: sections.language_gate(d), LANG + f""",
w AS (SELECT doc_id, {WORDS.replace('text', 'substr(text, 1, 5000)')} AS w FROM documents)
SELECT w.doc_id, CASE WHEN n > 0 THEN CASE WHEN en THEN 'english' END WHEN len(list_filter(w, lambda x: NOT regexp_matches(x, '[^\\x00-\\x7F]'))) / greatest(len(w), 1) > 0.5 THEN 'english' END AS accepted FROM w LEFT JOIN a USING (doc_id)""")


def short():
    """Title lines of plain prose: those of up to 50 characters."""
    return F.when(F.length("line") <= 50, F.struct(F.col("line").alias("title"), F.lit("unknown").alias("section_type"), F.lit(1).alias("level")))


SEC = f"""
WITH {LINES}, l AS (SELECT doc_id, line_no, trim(line) AS line FROM d WHERE trim(line) <> ''),
g AS (SELECT *, length(line) <= 50 AS is_t, sum((length(line) <= 50)::INTEGER) OVER (PARTITION BY doc_id ORDER BY line_no) AS grp FROM l),
h AS (SELECT *, max((grp = 0)::INTEGER) OVER (PARTITION BY doc_id) AS lead FROM g),
s AS (SELECT doc_id, (grp + max(lead))::INTEGER AS ord, coalesce(max(CASE WHEN is_t THEN line END), '{sections.HEADER}') AS title,
  coalesce(string_agg(CASE WHEN NOT is_t THEN line || chr(10) END, '' ORDER BY line_no), '') AS content, CASE WHEN grp = 0 THEN 'header' ELSE 'unknown' END AS section_type, 1 AS level
  FROM h GROUP BY doc_id, grp)"""
add("x3_detect_titles", lambda d, *_: sections.detect_titles(lines_of(d)), f"""
WITH {LINES}, l AS (SELECT doc_id, line_no, trim(line) AS line FROM d), m AS (SELECT *, CASE WHEN NOT length(line) BETWEEN 2 AND 100 THEN 'none'
  WHEN regexp_matches(line, '^[0-9]+([.][0-9]+)*[.]? *.+$') THEN '^([0-9]+(?:[.][0-9]+)*[.]?) *(.+?)(?: *[.]{{3,}}.*)?$' WHEN regexp_matches(line, '(?i)^([IVX]+[.、]|[A-Z][.、]) *.+$') THEN '(?i)^([IVX]+[.、]|[A-Z][.、]) *(.+?)(?: *[.]{{3,}}.*)?$'
  WHEN regexp_matches(line, '(?i)^([A-Z][A-Z ]+|[^\\p{{L}}\\p{{M}}\\p{{N}}_ ]*.{{1,50}}[^\\p{{L}}\\p{{M}}\\p{{N}}_ ]*)$') THEN 'plain' ELSE 'type' END AS p FROM l),
n AS (SELECT *, CASE WHEN p IN ('plain', 'type') THEN line ELSE trim(regexp_extract(line, p, 2)) END AS title, CASE WHEN p IN ('plain', 'type') THEN line ELSE regexp_extract(line, p, 1) END AS number FROM m WHERE p <> 'none'),
t AS (SELECT doc_id, line_no, title, {TYPES_SQL.format('title')} AS section_type, CASE WHEN p = 'type' OR contains(number, '.') THEN 2 ELSE 1 END AS level, p FROM n)
SELECT doc_id, line_no::INTEGER AS line_no, title, section_type, level FROM t WHERE p <> 'type' OR section_type <> 'unknown'""")
add("x4_parse_sections", lambda d, *_: sections.parse_sections(d, title=short()), SEC + " SELECT * FROM s WHERE content <> ''")
SMALL = "length(trim(f.content)) < 200 AND q.section_type <> 'references'"
add("x5_merge_small_sections", lambda d, *_: sections.merge_small_sections(sections.parse_sections(d, title=short())), SEC.replace("WITH", "WITH RECURSIVE", 1) + f""",
q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM s WHERE content <> ''),
f AS (SELECT doc_id, ord, title, content, section_type, level, i, 0 AS g FROM q WHERE i = 1
  UNION ALL SELECT q.doc_id, CASE WHEN {SMALL} THEN f.ord ELSE q.ord END, CASE WHEN {SMALL} THEN f.title ELSE q.title END,
    CASE WHEN {SMALL} THEN f.content || chr(10) || chr(10) || '## ' || q.title || chr(10) || q.content ELSE q.content END,
    CASE WHEN {SMALL} AND f.section_type <> 'unknown' THEN f.section_type ELSE q.section_type END, CASE WHEN {SMALL} THEN f.level ELSE q.level END, q.i, CASE WHEN {SMALL} THEN f.g ELSE f.g + 1 END
  FROM f JOIN q ON q.doc_id = f.doc_id AND q.i = f.i + 1)
SELECT doc_id, ord, arg_max(title, i) AS title, arg_max(content, i) AS content, arg_max(section_type, i) AS section_type, arg_max(level, i) AS level FROM f GROUP BY doc_id, g, ord""")
BATCHED = SEC.replace("WITH", "WITH RECURSIVE", 1) + """,
q AS (SELECT doc_id, ord, title, content, length(content) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i FROM s WHERE content <> ''),
f AS (SELECT doc_id, ord, i, 0 AS batch, CASE WHEN n > 3000 THEN 0 ELSE n END AS used, n > 3000 AS big FROM q WHERE i = 1
  UNION ALL SELECT q.doc_id, q.ord, q.i, CASE WHEN f.big OR (f.used > 0 AND (f.used + q.n > 3000)) THEN f.batch + 1 ELSE f.batch END,
    CASE WHEN q.n > 3000 THEN 0 WHEN f.big OR (f.used > 0 AND f.used + q.n > 3000) THEN q.n ELSE f.used + q.n END, q.n > 3000 FROM f JOIN q ON q.doc_id = f.doc_id AND q.i = f.i + 1)"""
add("x6_batch_sections", lambda d, *_: sections.batch_sections(sections.parse_sections(d, title=short()), 3000).select("doc_id", "ord", "batch"), BATCHED + " SELECT doc_id, ord, batch::INTEGER AS batch FROM f")
add("x7_important_sections", lambda d, *_: sections.important_sections(sections.parse_sections(d, title=short())).select("doc_id", "ord"),
    SEC + " SELECT doc_id, ord FROM s WHERE section_type = 'unknown' AND length(trim(content)) > 1000")
add("x8_chunk_text", lambda d, *_: sections.chunk_text(d, 2000, 200).select("doc_id", "chunk_no", F.md5("chunk").alias("digest")), """
WITH RECURSIVE z AS (SELECT doc_id, text, 0 AS pos, -1 AS k, '' AS chunk FROM documents UNION ALL
  SELECT doc_id, text, CASE WHEN length(text) - pos <= 2000 THEN length(text) + 1 WHEN b > 0 THEN pos + 2001 - b WHEN p > 0 THEN pos + 2001 - p WHEN l > 0 THEN pos + 2001 - l ELSE pos + 2000 END, k + 1,
    CASE WHEN length(text) - pos <= 2000 THEN substr(text, pos + 1) WHEN b > 0 THEN substr(text, pos + 1, 1999 - b) WHEN p > 0 THEN substr(text, pos + 1, 2001 - p) WHEN l > 0 THEN substr(text, pos + 1, 2000 - l) ELSE substr(text, pos + 1, 2000) END
  FROM (SELECT *, strpos(w, chr(10) || chr(10)) AS b, strpos(w, '。') AS p, strpos(w, chr(10)) AS l FROM (SELECT *, reverse(substr(text, pos + 1801, 200)) AS w FROM z WHERE pos < length(text) OR k < 0)))
SELECT doc_id, k::INTEGER AS chunk_no, md5(chunk) AS digest FROM z WHERE k >= 0""")
add("x9_chunk_by_words", lambda d, *_: sections.chunk_by_words(d, 100).select("doc_id", "chunk_no", F.md5("chunk").alias("digest")), f"""
WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents) SELECT doc_id, k::INTEGER AS chunk_no, md5(array_to_string(w[k * 100 + 1:k * 100 + 100], ' ')) AS digest
FROM w, range(0, (len(w) - 1) // 100 + 1) AS r(k) WHERE len(w) > 0""")
add("x9_chunk_by_sections", lambda d, *_: sections.chunk_by_sections(sections.parse_sections(d, title=short()), 1500).select("doc_id", "chunk_no", F.md5("chunk").alias("digest")), BATCHED + """
SELECT doc_id, batch::INTEGER AS chunk_no, md5(string_agg(title || chr(10) || content, '' ORDER BY ord)) AS digest FROM f JOIN q USING (doc_id, ord) GROUP BY 1, 2""")


def chunk_results(d):
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_no", "line")).select(
        "doc_id", "chunk_no", F.when(F.length("line") > 40, F.substring("line", 1, 20)).alias("title_cn"), F.regexp_replace(F.substring("line", 1, 60), " ", ",").alias("keywords_cn"), F.substring("line", 1, 30).alias("abstract_cn")
    )


CHUNKS = f"""
WITH {LINES}, c AS (SELECT doc_id, line_no, CASE WHEN length(line) > 40 THEN substr(line, 1, 20) END AS t, replace(substr(line, 1, 60), ' ', ',') AS k, substr(line, 1, 30) AS a FROM d),
t AS (SELECT doc_id, first(trim(t) ORDER BY line_no) AS t FROM c WHERE trim(t) <> '' GROUP BY 1),
k0 AS (SELECT doc_id, line_no, unnest(string_split(k, ',')) AS k, generate_subscripts(string_split(k, ','), 1) AS i FROM c),
k1 AS (SELECT doc_id, trim(k) AS k, min(line_no * 1000 + i) AS o FROM k0 WHERE trim(k) <> '' GROUP BY 1, 2), k AS (SELECT doc_id, string_agg(k, ', ' ORDER BY o) AS k FROM k1 GROUP BY 1),
a AS (SELECT doc_id, string_agg(trim(a), chr(10) || chr(10) ORDER BY line_no) AS a FROM c WHERE trim(a) <> '' GROUP BY 1)
SELECT x.doc_id, coalesce(t, '') AS title_cn, coalesce(k, '') AS keywords_cn, coalesce(a, '') AS abstract_cn FROM documents x LEFT JOIN t USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN a USING (doc_id)"""
add("x11_merge_chunk_results", lambda d, *_: sections.merge_chunk_results(chunk_results(d)), CHUNKS)
add("x12_overlay_metadata", lambda d, s, x: sections.overlay_metadata(d.select("doc_id", "lang", "source"), load(s, x, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise(" ").alias("lang")), ["lang"]),
    "SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE lang END AS lang, source FROM documents LEFT JOIN labels USING (doc_id)")
add("x13_integrate_sections", lambda d, *_: sections.integrate_sections(
        lines_of(d).select("doc_id", F.col("line_no").alias("ord"), F.element_at(F.array(F.lit("abstract_cn"), F.lit("research_methods")), (F.col("line_no") % 2 + 1).cast("int")).alias("field"), F.col("line").alias("value")),
        sections.parse_sections(d, title=short()), ["abstract_cn", "research_methods", "proposed_solutions"]).select("doc_id", *[F.md5(c).alias(c) for c in ("abstract_cn", "research_methods", "proposed_solutions")]), f"""
WITH {LINES}, v AS (SELECT doc_id, line_no % 2 AS f, string_agg(line, chr(10) || chr(10) ORDER BY line_no) AS v FROM d WHERE trim(line) <> '' GROUP BY 1, 2)
SELECT doc_id, md5(a.v) AS abstract_cn, md5(b.v) AS research_methods, md5(b.v) AS proposed_solutions FROM (SELECT DISTINCT doc_id FROM v) LEFT JOIN (SELECT * FROM v WHERE f = 0) a USING (doc_id) LEFT JOIN (SELECT * FROM v WHERE f = 1) b USING (doc_id)""")
add("x31_corpus_stats", lambda d, *_: sections.corpus_stats(d), """
SELECT lang, source, count(*) AS docs, sum(length(text))::BIGINT AS chars, round(avg(length(text)), 6) AS mean_chars, sum(len(string_split(text, chr(10))))::BIGINT AS lines, max(length(text)) AS longest
FROM documents GROUP BY ROLLUP (lang, source)""")


# documents with numbered headings, a contents list and references made from their own words
def dressed(d):
    ls = F.filter(F.split("text", "\n"), lambda x: t.strip(x) != "")
    heads = F.transform(ls, lambda x, i: F.concat(F.lit("第"), (i + 1).cast("string"), F.lit("章 "), F.substring(F.regexp_replace(x, r"[^A-Za-z]", ""), 1, 12)))
    body = F.transform(F.arrays_zip(heads.alias("h"), ls.alias("b")), lambda x: F.concat(x["h"], F.lit("\n"), x["b"]))
    refs = F.transform(ls, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] Smith J. K. "), F.substring(x, 1, 40), F.lit(". Journal of Texts, "), (1990 + i % 35).cast("string")))
    return once(d, "doc_id", text=F.array_join(F.concat(F.array(F.lit("目录")), F.transform(heads, lambda h, i: F.concat(h, F.lit("...."), (i + 3).cast("string"))), body, F.array(F.lit("参考文献")), refs, F.array(F.lit("致谢"), F.lit("thanks"))), "\n"))


NONBLANK = "SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents"
REF = "'[' || i || '] Smith J. K. ' || substr(ls[i], 1, 40) || '. Journal of Texts, ' || (1990 + (i - 1) % 35)"
REFS = f"WITH b AS ({NONBLANK}), r AS (SELECT doc_id, i, {REF} AS ref, len(ls) AS n, ls[len(ls)] AS last FROM b, range(1, len(ls) + 1) AS q(i)), k AS (SELECT doc_id FROM r GROUP BY 1 HAVING sum(length(ref) + 1) + 5 >= 100)"
block = lambda d: references.reference_block(dressed(d))
split = lambda d: references.split_references(block(d))
add("r1_reference_block", lambda d, *_: block(d).select("doc_id", F.length("block").alias("n")), 
    REFS + r" SELECT doc_id, (sum(length(ref) + 1) + 5 + CASE WHEN regexp_matches(max(last), '#+\s*$') THEN length(regexp_extract(max(last), '#+\s*$')) + 1 ELSE 0 END)::INTEGER AS n FROM r SEMI JOIN k USING (doc_id) GROUP BY 1")
add("r2_reference_block_longest", lambda d, *_: references.reference_block_longest(dressed(d)).select("doc_id", F.length("block").alias("n")), REFS + " SELECT doc_id, (sum(length(ref) + 1) - 1)::INTEGER AS n FROM r GROUP BY 1 HAVING sum(length(ref) + 1) - 1 >= 200")
add("r3_split_references", lambda d, *_: split(d).select("doc_id", "ref_no"), REFS + " SELECT doc_id, i::INTEGER AS ref_no FROM r SEMI JOIN k USING (doc_id)")
add("r4_filter_numbering", lambda d, *_: references.filter_numbering(split(d)).select("doc_id", "ref_no"), REFS + " SELECT doc_id, i::INTEGER AS ref_no FROM r SEMI JOIN k USING (doc_id) WHERE i <= 1000")
for no, f in (("5", references.is_reference), ("6", references.is_reference_unnumbered), ("7", references.is_reference_strict)):
    add(f"r{no}_{f.__name__}", lambda d, *_, f=f: split(d).select("doc_id", "ref_no", f(F.col("ref")).alias("valid")), REFS + f" SELECT doc_id, i::INTEGER AS ref_no, {'i <= 500' if no == '5' else 'true'} AS valid FROM r SEMI JOIN k USING (doc_id)")
add("r8_regroup_references", lambda d, *_: references.regroup_references(block(d)).select("doc_id", "ref_no"), REFS + " SELECT doc_id, i::INTEGER AS ref_no FROM r SEMI JOIN k USING (doc_id) WHERE i <= 100")
add("r9_dedupe_references", lambda d, *_: references.dedupe_references(split(d)).select("doc_id", "ref_no"), REFS + r"""
SELECT doc_id, i::INTEGER AS ref_no FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, trim(substr(regexp_replace(regexp_replace(ref, '\s+', ' ', 'g'), '^\[\d+\]', ''), 1, 50)) ORDER BY i) AS r FROM r SEMI JOIN k USING (doc_id)) WHERE r = 1""")
add("r10_reference_number", lambda d, *_: split(d).select("doc_id", references.reference_number(F.col("ref")).alias("n"), references.reference_number(F.concat(F.lit("x "), "ref")).alias("none")), REFS + " SELECT doc_id, i::INTEGER AS n, 999999 AS none FROM r SEMI JOIN k USING (doc_id)")


def worn(d):
    """Entries of which three in four lack something: the number, the venue, the year, or the most of their length too."""
    kind = F.col("ref_no") % 5
    ref = F.when(kind == 0, F.regexp_replace("ref", r"^\[\d+\] ", "")).when(kind == 1, F.replace("ref", F.lit("Journal of Texts"), F.lit("Reports"))).when(kind == 2, F.regexp_replace("ref", r"\d{4}$", "n.d."))
    return split(d).withColumn("ref", ref.when(kind == 3, F.substring("ref", 1, 13)).otherwise(F.col("ref")))


add("r11_reference_quality", lambda d, *_: references.reference_quality(worn(d)).withColumn("quality", F.round("quality", 9)), REFS + f""",
w AS (SELECT doc_id, i, substr(regexp_replace(ls[i], '{WS}', ' ', 'g'), 1, 40) AS x, regexp_replace(trim(ref), '{WS}', ' ', 'g') AS ref FROM r SEMI JOIN k USING (doc_id) JOIN b USING (doc_id)),
q AS (SELECT doc_id, CASE i % 5 WHEN 3 THEN 0.3 + CASE WHEN regexp_matches(substr(ref, 1, 13), '(19|20)[0-9][0-9]') THEN 0.2 ELSE 0 END WHEN 0 THEN 0.7 WHEN 1 THEN 0.7 WHEN 2 THEN CASE WHEN regexp_matches(ref, '(19|20)[0-9][0-9].*, [0-9]+$') THEN 1.0 ELSE 0.8 END ELSE 1.0 END AS score FROM w)
SELECT doc_id, round(avg(score::DOUBLE), 9) AS quality FROM q GROUP BY doc_id""")
add("r12_reference_stats", lambda d, *_: references.reference_stats(split(d)).select("doc_id", "n_refs", "first_no", "last_no"), REFS + " SELECT doc_id, count(*) AS n_refs, 1 AS first_no, max(i)::INTEGER AS last_no FROM r SEMI JOIN k USING (doc_id) GROUP BY 1")
add("r13_repeated_lines", lambda d, *_: references.repeated_lines(d), f"""
WITH {LINES}, c AS (SELECT doc_id, trim(line) AS line, count(*) AS n FROM d WHERE length(trim(line)) > 20 GROUP BY 1, 2 HAVING count(*) > 1)
SELECT doc_id, line, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, line) AS r FROM c) WHERE r <= 5""")
add("r13_reference_anomalies", lambda d, *_: references.reference_anomalies(dressed(d), block(d), split(d)).withColumn("longest", F.array_join("longest", ",")), REFS + f""",
w AS (SELECT doc_id, length(concat_ws(chr(10), '目录', array_to_string(list_transform(range(1, len(ls) + 1), lambda i: '第' || i || '章 ' || h[i] || '....' || (i + 2)), chr(10)),
  array_to_string(list_transform(range(1, len(ls) + 1), lambda i: '第' || i || '章 ' || h[i] || chr(10) || ls[i]), chr(10)), '参考文献', array_to_string(list_transform(range(1, len(ls) + 1), lambda i: {REF}), chr(10)), '致谢', 'thanks')) AS chars
  FROM (SELECT *, list_transform(ls, lambda z: substr(regexp_replace(z, '[^A-Za-z]', '', 'g'), 1, 12)) AS h FROM b)),
t AS (SELECT doc_id, i, length(trim(ref)) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY length(trim(ref)) DESC, i) AS k FROM r SEMI JOIN k USING (doc_id)),
g AS (SELECT doc_id, count(*) AS refs, avg(n) AS mean, string_agg(n, ',' ORDER BY k) FILTER (k <= 3) AS longest FROM t GROUP BY 1)
SELECT doc_id, round(bl.n / chars, 9) AS share, bl.n > 50000 AS block_long, refs > 300 AS many, mean > 500 AS entries_long, false AS runs_on, longest FROM g JOIN w USING (doc_id) JOIN ("""
  + REFS + r" SELECT doc_id, (sum(length(ref) + 1) + 5 + CASE WHEN regexp_matches(max(last), '#+\s*$') THEN length(regexp_extract(max(last), '#+\s*$')) + 1 ELSE 0 END)::INTEGER AS n FROM r SEMI JOIN k USING (doc_id) GROUP BY 1) bl USING (doc_id)")
add("r14_numbering_styles", lambda d, *_: references.numbering_styles(block(d)), REFS + " SELECT doc_id, count(*)::INTEGER AS square, 0 AS round, 0 AS lenticular, 0 AS dot, 'square' AS style FROM r SEMI JOIN k USING (doc_id) GROUP BY 1")
# a limit is moved to the middle one of the marks in the zone around it
ZONE = "greatest(e + 500, e + 1500 // 2)"
X10 = REFS.replace("WITH", "WITH RECURSIVE", 1) + r""",
t AS (SELECT doc_id, CASE WHEN regexp_matches(max(last), '#+\s*$') THEN regexp_extract(max(last), '#+\s*$') || chr(10) ELSE '' END || '参考文献' || chr(10) || string_agg(ref, chr(10) ORDER BY i) || chr(10) AS t FROM r SEMI JOIN k USING (doc_id) GROUP BY 1),
z AS (SELECT doc_id, t, 0::BIGINT AS begun, 0::BIGINT AS e, -1 AS k FROM t UNION ALL
  SELECT doc_id, t, e, CASE WHEN e + 1500 >= length(t) THEN length(t) WHEN len(m) = 0 THEN e + 1500 ELSE greatest(z + (list_sum(list_transform(g[1:len(m) // 2 + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:len(m) // 2], lambda x: length(x))), 0))::BIGINT, e + 1) END, k + 1
  FROM (SELECT *, regexp_extract_all(w, '［[0-9]+］|\[[0-9]+\]|\n[0-9]+[.]') AS m, regexp_split_to_array(w, '［[0-9]+］|\[[0-9]+\]|\n[0-9]+[.]') AS g
    FROM (SELECT *, {zone} AS z, substr(t, {zone} + 1, e + 2000 - {zone}) AS w FROM z WHERE e < length(t))))
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1)::INTEGER AS chunk_no, trim(substr(t, begun + 1, e - begun)) AS chunk FROM z WHERE k >= 0 AND trim(substr(t, begun + 1, e - begun)) <> ''""".replace("{zone}", ZONE)
add("x10_chunk_references", lambda d, *_: references.chunk_references(block(d), 1500), X10)

heading = "^第\\d+章"
chapters = lambda d: ch.extract_chapters(dressed(d))
CHAP = f"WITH b AS ({NONBLANK}), c AS (SELECT doc_id, i, len(ls) AS n, substr(regexp_replace(ls[i], '[^A-Za-z]', '', 'g'), 1, 12) AS title FROM b, range(1, len(ls) + 1) AS q(i))"
LISTED = CHAP + """, e AS (SELECT doc_id, i::INTEGER AS line_number, CAST(i AS VARCHAR) AS number, title || '....' || (i + 2) AS title FROM c
  UNION ALL SELECT doc_id, (n + 1 + 2 * (i - 1))::INTEGER, CAST(i AS VARCHAR), title FROM c) SELECT * FROM e WHERE length(title) BETWEEN 3 AND 99"""
add("x18_extract_chapters", lambda d, *_: chapters(d).select("doc_id", "line_number", "number", "title"), LISTED)
add("x19_first_level_chapters", lambda d, *_: ch.first_level_chapters(chapters(d)).select("doc_id", "line_number", "number", "title"), LISTED)


def bodies(d):
    """Chapters of the body, in order: those after the contents list."""
    found = chapters(d).where(~F.col("title").contains("...")).where(F.col("number").rlike(r"^\d+$"))
    return found.select("doc_id", F.col("number").cast("int").alias("ord"), F.concat(F.lit("第"), "number", F.lit("章 "), "title").alias("title"), "number")


def ranges(d):
    ls = lines_of(dressed(d))
    return ch.chapter_ranges(ch.chapter_start_lines(bodies(d), ls, slack=0), ls), ls


add("x20_chapter_start_lines", lambda d, *_: ch.chapter_start_lines(bodies(d), lines_of(dressed(d)), slack=0).select("doc_id", "ord", "start_line"), CHAP + " SELECT doc_id, i::INTEGER AS ord, (n + 1 + 2 * (i - 1))::INTEGER AS start_line FROM c WHERE length(title) >= 3")
# a chapter's lines: its body, and those of chapters without a title of three letters, which are not chapters; the last goes on to the end
RANGES = CHAP + """, k AS (SELECT doc_id, i, n, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM c WHERE length(title) >= 3),
r AS (SELECT doc_id, i::INTEGER AS ord, (n + 2 + 2 * (i - 1))::INTEGER AS start_line, CASE WHEN nx IS NULL THEN 4 * n + 3 ELSE n + 2 * (nx - 1) END::INTEGER AS end_line FROM k)"""
add("x21_chapter_ranges", lambda d, *_: ranges(d)[0].select("doc_id", "ord", "start_line", "end_line"), RANGES + " SELECT * FROM r")
add("x22_chapter_contents", lambda d, *_: ch.chapter_contents(*ranges(d)).select("doc_id", "ord", F.md5("content").alias("digest")), RANGES.replace("CHAP", "") + f""",
x AS (SELECT doc_id, list_concat(['目录'], list_transform(range(1, len(ls) + 1), lambda i: '第' || i || '章 ' || h[i] || '....' || (i + 2)), flatten(list_transform(range(1, len(ls) + 1), lambda i: ['第' || i || '章 ' || h[i], ls[i]])),
  ['参考文献'], list_transform(range(1, len(ls) + 1), lambda i: {REF}), ['致谢', 'thanks']) AS l FROM (SELECT *, list_transform(ls, lambda z: substr(regexp_replace(z, '[^A-Za-z]', '', 'g'), 1, 12)) AS h FROM ({NONBLANK})))
SELECT r.doc_id, ord, md5(array_to_string(l[start_line + 1:end_line + 1], chr(10))) AS digest FROM r JOIN x USING (doc_id)""")


def chaptered(d):
    ls = F.filter(F.split("text", "\n"), lambda x: t.strip(x) != "")
    body = F.transform(ls, lambda x, i: F.concat(F.lit("第"), (i + 1).cast("string"), F.lit("章 "), F.substring(F.regexp_replace(x, r"[^A-Za-z]", ""), 1, 12), F.lit("\n"), x))
    return once(d, "doc_id", text=F.array_join(body, "\n"))


def titled(d):
    return d.select("doc_id", F.posexplode(F.filter(F.split("text", "\n"), lambda x: t.strip(x) != "")).alias("i", "x")).select(
        "doc_id", (F.col("i") + 1).alias("ord"), F.substring(F.regexp_replace("x", r"[^A-Za-z]", ""), 1, 12).alias("title"), (F.col("i") + 1).cast("string").alias("number"), F.lit(1).alias("level"))


# the first place of a pattern in a text, in characters from 1
PLACE = "CASE WHEN regexp_matches({0}, '{1}') THEN length(regexp_split_to_array({0}, '{1}')[1]) + 1 END"
add("x23_chapter_content_by_title", lambda d, *_: ch.chapter_content_by_title(titled(d), chaptered(d)).select("doc_id", "ord", F.length("content").alias("n"), F.md5("content").alias("digest")), f"""
WITH b AS ({NONBLANK}), c AS (SELECT doc_id, i, substr(regexp_replace(ls[i], '[^A-Za-z]', '', 'g'), 1, 12) AS title, ls[i] AS line FROM b, range(1, len(ls) + 1) AS q(i)),
x AS (SELECT doc_id, string_agg('第' || i || '章 ' || title || chr(10) || line, chr(10) ORDER BY i) AS text FROM c GROUP BY 1),
p AS (SELECT doc_id, i, strpos(text, '第' || i || '章 ' || title) AS pos, title, text FROM c JOIN x USING (doc_id) WHERE title <> ''),
r AS (SELECT *, substr(text, pos + length(title) + 20) AS rest FROM p),
e AS (SELECT *, coalesce({PLACE.format('rest', '第[一二三四五六七八九十0-9]+章[ ]*[^' + chr(92) + 'n' + chr(92) + 'r]{3,80}')}, {PLACE.format('rest', '(?m)^[0-9]+[. ]+[^' + chr(92) + 'n]{5,60}')}, {PLACE.format('rest', '(?m)^#{1,3} *[^' + chr(92) + 'n]{5,60}')}) AS k FROM r),
f AS (SELECT doc_id, i, trim(CASE WHEN k IS NULL THEN substr(text, pos) ELSE substr(text, pos, length(title) + 20 + k - 1) END) AS content FROM e)
SELECT doc_id, i::INTEGER AS ord, length(content)::INTEGER AS n, md5(content) AS digest FROM f WHERE length(content) >= 100""")
add("x24_is_content_fragment", lambda d, *_: lines_of(once(d, "doc_id", text=F.replace(F.replace(F.col("text"), F.lit(" the "), F.lit("通过")), F.lit(" und "), F.lit(" findings ")))).select("doc_id", "line_no", ch.is_content_fragment(F.col("line")).alias("value")), f"""
WITH {LINES.replace('string_split(text', "string_split(replace(replace(text, ' the ', '通过'), ' und ', ' findings ')")}
SELECT doc_id, line_no, {has('line', '总之,本工作,本研究,通过,采用,基于,）。在,研究中,揭示了,表明,结果显示,证明了,发现,exhibit,tendency,challenges,results,analysis,research,study,findings')} AS value FROM d""")


def lazy(text: str, head: str, least: int, most: int, stop: str, end: bool = True, lines: bool = False) -> str:
    """SQL for {p, c}: the first head (or line start) that a stop follows after least to most characters: its place from 1 and the characters up to the stop."""
    heads = f"regexp_extract_all({text}, '{head}')" if not lines else f"list_transform(string_split({text}, chr(10)), lambda z: '')"
    gaps = f"regexp_split_to_array({text}, '{head}')" if not lines else f"list_prepend('', list_transform(string_split({text}, chr(10)), lambda z: z || chr(10)))"
    begin = f"(list_sum(list_transform(({gaps})[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(({heads})[1:i - 1], lambda z: length(z))), 0))::BIGINT + 1"
    rest = f"substr({text}, x.p + x.h)"
    after = f"substr({rest}, {least + 1})"
    k = f"CASE WHEN regexp_matches({after}, '{stop}') THEN {least} + length(regexp_split_to_array({after}, '{stop}')[1])" + (f" WHEN length({rest}) >= {least} THEN length({rest})" if end else "") + " END"
    return f"""(list_filter(list_transform(list_transform(range(1, len({heads}) + 1), lambda i: {{'p': {begin}, 'h': length(({heads})[i])}}), lambda x: {{'p': x.p, 'c': substr({text}, x.p, x.h + {k}), 'k': {k}}}),
  lambda y: y.k <= {most}))[1]"""


SECTIONS = [
    ("cover", "", 200, 2000, "摘要|(?i:abstract)", False), ("abstract_cn", "摘要", 100, 5000, "关键词|(?i:abstract)|目录", False), ("abstract_en", "(?i)abstract", 100, 5000, "(?i)keyword|目录|1[ \\n]", False),
    ("toc", "目录", 200, 3000, "摘要|(?i:abstract)|第一章", False), ("introduction", "绪论", 500, 10000, "第二章|2[ \\n]", False), ("literature", "第二章", 1000, 20000, "3[ \\n]", False),
    ("methodology", "研究方法", 1000, 15000, "第四章|4[ \\n]", False), ("results", "实验结果", 1000, 15000, "5[ \\n]|结论", False), ("conclusion", "结论", 200, 8000, "参考文献|致谢|\\n", True),
    ("references", "参考文献", 0, 1_000_000, "\\n+[ ]*致谢|\\n[ ]*\\n", False), ("acknowledgement", "致谢", 100, 2000, "\\n", True),
]
FOUND = f"""WITH m AS (SELECT doc_id, {MARKED} AS text FROM documents),
f AS (""" + " UNION ALL ".join(
    f"SELECT doc_id, text, '{n}' AS name, {lazy('text', head, least, most, stop, end, n == 'cover')} AS x FROM m" for n, head, least, most, stop, end in SECTIONS
) + """ UNION ALL SELECT doc_id, text, 'keywords_cn', {'p': strpos(text, '关键词'), 'c': '关键词：a，b c', 'k': 0} FROM m WHERE contains(text, '关键词')),
s AS (SELECT doc_id, text, name, (x.p - 1)::INTEGER AS start_position, (x.p - 1 + length(x.c))::INTEGER AS end_position, trim(x.c) AS content FROM f WHERE x IS NOT NULL)"""
add("x14_find_sections", lambda d, *_: ch.find_sections(marks(d)).select("doc_id", "name", "start_position", "end_position", F.md5("content").alias("digest")),
    FOUND + " SELECT doc_id, name, start_position, end_position, md5(content) AS digest FROM s")
add("x15_section_bounds", lambda d, *_: ch.section_bounds(ch.find_sections(marks(d)), marks(d)).drop("content"), FOUND + """
SELECT doc_id, name, start_position, end_position, list_filter(list_transform(string_split(content, chr(10)), lambda z: trim(z)), lambda z: length(z) BETWEEN 1 AND 99)[1] AS title,
  len(string_split(substr(text, 1, start_position), chr(10)))::INTEGER AS start_line, len(string_split(substr(text, 1, end_position), chr(10)))::INTEGER AS end_line, length(content)::INTEGER AS content_length FROM s""")


def surrounded():
    """The kind of a section and what stands around it, by its place in the document."""
    o = F.col("ord")
    name = F.element_at(F.array(*map(F.lit, ("abstract_cn", "references", "chapter_1"))), (o % 3 + 1).cast("int"))
    return ch.boundary_confidence(name, F.col("content"), F.when(o % 2 == 0, "x \n  ").otherwise("x "), F.when(o % 5 < 2, " \ny").otherwise("y\n"))


add("x16_boundary_confidence", lambda d, *_: sections.parse_sections(d, title=short()).select("doc_id", "ord", surrounded().alias("confidence")),
    SEC + r""" SELECT doc_id, ord, round(least(1.0, 0.5 + CASE WHEN ord % 2 = 0 THEN 0.2 ELSE 0 END + CASE WHEN ord % 5 < 2 THEN 0.2 ELSE 0 END + CASE WHEN len(string_split(content, chr(10))) > 3 THEN 0.1 ELSE 0 END
  + CASE WHEN ord % 3 = 0 AND length(content) BETWEEN 100 AND 2000 AND NOT regexp_matches(content, '\[[0-9]+\]') THEN 0.2 WHEN ord % 3 = 1 AND regexp_matches(content, '\[[0-9]+\]|[0-9]+[.]') THEN 0.2 ELSE 0 END), 6)::DOUBLE AS confidence FROM s WHERE content <> ''""")
NEXT = chr(92) + "n[ " + chr(92) + "n]*(第[一二三四五六七八九十1-9]章|[0-9]+[.][ ]*[^" + chr(92) + "n]{5,50}|结论|参考文献|致谢|附录)"
# sections of five families by what they are asked for as, their marker in the texts, and the score of the pattern that it fits
LOCATED = (("结论", "结论", 2.0), ("中文摘要", "摘要", 2.0), ("Abstract", "Abstract", 2.0), ("Reference list", "参考文献", 2.0), ("第一章", "绪论", 1.8))


def located(d):
    told = ch.locate_sections(marks(d), [asked for asked, _, _ in LOCATED])
    return told.withColumn("digest", F.md5("content")).drop("content")


add("x17_locate_section", lambda d, *_: located(d), f"WITH m AS (SELECT doc_id, {MARKED} AS text FROM documents)" + " UNION ALL ".join(f"""
SELECT * FROM (WITH p AS (SELECT *, strpos(text, '{marker}') AS pos, substr(text, strpos(text, '{marker}') + {len(marker)}) AS rest FROM m WHERE contains(text, '{marker}')),
e AS (SELECT *, {PLACE.format('rest', NEXT)} AS k, trim(regexp_extract(rest, '{NEXT}', 0)) AS nx FROM p),
f AS (SELECT *, CASE WHEN k IS NULL THEN length(text) ELSE pos + {len(marker) - 2} + k END AS e FROM e)
SELECT '{asked}' AS section, doc_id, '{marker}' AS title, {score}::DOUBLE AS score, (pos - 1)::INTEGER AS start_pos, e::INTEGER AS end_pos, len(string_split(substr(text, 1, pos - 1), chr(10)))::INTEGER AS start_line,
  len(string_split(substr(text, 1, e), chr(10)))::INTEGER AS end_line, coalesce(nx, '') AS next_section, md5(trim(substr(text, pos, e - pos + 1))) AS digest FROM f)""" for asked, marker, score in LOCATED))
RESULT = "substr(text, strpos(text, '实验结果'))"
add("x25_topic_content", lambda d, *_: marks(d).select("doc_id", F.md5(ch.topic_content(F.col("text"), "results")).alias("digest")), f"""
WITH m AS (SELECT doc_id, {MARKED} AS text FROM documents),
p AS (SELECT *, CASE WHEN contains(text, '实验结果') THEN regexp_split_to_array({RESULT}, '第二章|结论|参考文献')[1] END AS block, list_filter(string_split(text, chr(10)), lambda z: regexp_matches(z, '结果|数据|图|表|分析|测试|性能|效果')) AS l FROM m),
q AS (SELECT *, array_to_string(list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN i = 1 OR length(array_to_string(l[1:i - 1], chr(10))) <= 2000 THEN l[i] END), lambda z: z IS NOT NULL), chr(10)) AS g FROM p)
SELECT doc_id, md5(substr(CASE WHEN length(block) > 300 THEN block ELSE coalesce(g, '') END, 1, 5000)) AS digest FROM q""")
add("x26_conclusion_block", lambda d, *_: marks(d).select("doc_id", F.md5(ch.conclusion_block(F.col("text"))).alias("digest")), f"""
WITH m AS (SELECT doc_id, {MARKED} AS text FROM documents) SELECT doc_id, md5(({lazy('text', '结论', 200, 8000, '参考文献|致谢')}).c) AS digest FROM m""")


def given(d):
    return marks(d).select("doc_id", "text", F.when(F.col("doc_id") % 2 == 0, "摘要： given  words ").alias("abstract_cn"), F.when(F.col("doc_id") % 3 == 0, "").alias("abstract_en"), F.lit(None).cast("string").alias("keywords_cn"),
                           F.when(F.col("doc_id") % 5 == 0, "Key  Words: k1, k2;k3").alias("keywords_en"), F.lit(None).cast("string").alias("acknowledgement"))


CLEAN = "trim(regexp_replace(regexp_replace({0}, '^(摘要|Abstract)[：:\\s]*', ''), '\\s+', ' ', 'g'))"
add("x27_fallback_fields", lambda d, *_: ch.fallback_fields(given(d)), f"""
WITH m AS (SELECT doc_id, {MARKED} AS text FROM documents),
f AS (SELECT doc_id, text, ({lazy('text', '摘要', 50, 3000, '关键词|(?i:abstract)|第一章|目录', False)}).c AS a, ({lazy('text', '(?i)abstract', 50, 3000, '(?i)keyword|第一章|目录', False)}).c AS b,
  ({lazy('text', '致谢', 50, 2000, '参考文献|' + chr(92) + 'n')}).c AS k FROM m)
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'given words' ELSE {CLEAN.format("coalesce(a, '')")} END AS abstract_cn, CASE WHEN doc_id % 3 = 0 THEN '' ELSE {CLEAN.format("coalesce(b, '')")} END AS abstract_en,
  CASE WHEN contains(text, '关键词') THEN 'a；b；c' ELSE '' END AS keywords_cn, CASE WHEN doc_id % 5 = 0 THEN 'k1; k2; k3' ELSE '' END AS keywords_en, trim(coalesce(k, '')) AS acknowledgement FROM f""")


def numbered(d):
    told = F.transform(F.split("text", "\n"), lambda x, i: F.when(i % 3 == 0, F.concat((F.floor(i / 3) + 1).cast("string"), F.lit(" Part"))).when(i % 3 == 1, F.concat((F.floor(i / 3) + 1).cast("string"), F.lit(".1 Sub"))).otherwise("x"))
    return d.select("doc_id", F.array_join(told, "\n").alias("text"))


HIER = """WITH n AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), m AS (SELECT doc_id, n, i, i // 3 + 1 AS c FROM n, range(0, n) AS q(i) WHERE i % 3 < 2)"""
add("x28_hierarchy", lambda d, *_: ch.hierarchy(numbered(d)), HIER + """
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i % 3, i)::INTEGER AS pos, c || CASE WHEN i % 3 = 1 THEN '.1' ELSE '' END AS number, CASE WHEN i % 3 = 1 THEN 'Sub' ELSE 'Part' END AS title,
  (i % 3 + 1)::INTEGER AS level, i::INTEGER AS start_line, least(n - 1, (i // 3) * 3 + 2)::INTEGER AS end_line FROM m""")
add("x29_hierarchy_summary", lambda d, *_: ch.hierarchy_summary(ch.hierarchy(numbered(d))), HIER + " SELECT doc_id, CAST(c AS VARCHAR) AS chapter, 1::BIGINT AS n, c || '.1' AS subsections FROM m WHERE i % 3 = 1")
add("x30_structure_profile", lambda d, *_: ch.structure_profile(sections.parse_sections(d, title=short())).select("doc_id", F.array_join(F.transform("sections", lambda x: F.concat_ws("|", x["ord"].cast("string"), x["section_type"], x["title"], x["n"].cast("string"))), "\n").alias("profile")),
    SEC + " SELECT doc_id, string_agg(concat_ws('|', ord, section_type, title, length(content)), chr(10) ORDER BY ord) AS profile FROM s WHERE content <> '' GROUP BY 1")
MARKED_LINES = "d AS (SELECT doc_id, trim(line) AS x, line, line_no, n FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no, len(ls) AS n FROM (SELECT doc_id, string_split(" + MARKED + ", chr(10)) AS ls FROM documents)))"
add("x32_sections_by_marker", lambda d, *_: ch.sections_by_marker(marks(d)).select("doc_id", "section", "start_line", "end_line", F.md5("content").alias("digest")), f"""
WITH {MARKED_LINES}, k AS (SELECT * FROM (VALUES ('abstract_cn', '摘要', '(?i)关键词|keyword|abstract', 100), ('abstract_en', 'abstract', '(?i)keyword|目录', 100), ('keywords_cn', '关键词', NULL, 0), ('toc', '目录', '第一章|第1章|绪论|引言', 200),
  ('introduction', '绪论|第一章', NULL, 0), ('conclusion', '结论', NULL, 0), ('references', '参考文献', '致谢|个人简历|附录', 1000000000), ('acknowledgement', '致谢', NULL, 0)) v(section, p, stop, cap)),
s AS (SELECT doc_id, section, stop, cap, min(line_no) AS s, max(n) AS n FROM d JOIN k ON regexp_matches(lower(x), p) GROUP BY ALL),
e AS (SELECT s.doc_id, section, s, s.n, min(line_no) FILTER (line_no < s + cap AND regexp_matches(x, stop) AND (section <> 'references' OR length(x) < 50)) AS own,
  min(line_no) FILTER (line_no < s + 50 AND x <> '' AND regexp_matches(x, '^#|第.*章|^[A-Z ]{{3,20}}$')) AS usual FROM s LEFT JOIN d ON d.doc_id = s.doc_id AND line_no > s GROUP BY ALL),
f AS (SELECT doc_id, section, s, coalesce(own, usual, least(s + 50, n)) AS e FROM e)
SELECT f.doc_id, section, s::INTEGER AS start_line, e::INTEGER AS end_line, md5(string_agg(line, chr(10) ORDER BY line_no)) AS digest FROM f JOIN d ON d.doc_id = f.doc_id AND line_no >= s AND line_no < e GROUP BY ALL""")

# tables of contents
entries = lambda d: toc.parse_toc_entries(lines_of(dressed(d)))
W = "[ " + chr(92) + "t]"  # white space within a line
DRESSED = f"""x AS (SELECT doc_id, list_concat(['目录'], list_transform(range(1, len(ls) + 1), lambda i: '第' || i || '章 ' || h[i] || '....' || (i + 2)), flatten(list_transform(range(1, len(ls) + 1), lambda i: ['第' || i || '章 ' || h[i], ls[i]])),
  ['参考文献'], list_transform(range(1, len(ls) + 1), lambda i: {REF}), ['致谢', 'thanks']) AS l FROM (SELECT *, list_transform(ls, lambda z: substr(regexp_replace(z, '[^A-Za-z]', '', 'g'), 1, 12)) AS h FROM ({NONBLANK}))),
dl AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS line_no FROM x),
d AS (SELECT doc_id, trim(line) AS line, line_no FROM dl)"""
ENTRIES = f"""WITH {DRESSED}, p AS (SELECT * FROM (VALUES
  (1, 'abstract', 0, 0.95::DOUBLE, '(?i)^(摘 *要|Abstract)', false), (2, 'conclusion', 1, 0.9, '(?i)^(结 *论|Conclusion|总结|Summary)', false), (3, 'references', 1, 0.95, '(?i)^(参 *考 *文 *献|References)', false),
  (4, 'achievements', 1, 0.9, '(?i)^(攻读.*学位.*期间.*成果|研究成果|学术成果|Publications|Academic Achievements)', false), (5, 'acknowledgment', 1, 0.9, '(?i)^(致 *谢|Acknowledgment|Acknowledgement)', false),
  (6, 'author_profile', 1, 0.9, '(?i)^(作者简介|个人简历|Author.*Profile|Biography|CV)', false), (7, 'appendix', 1, 0.85, '(?i)^(附 *录|Appendix)', false), (8, 'declaration', 1, 0.85, '(?i)^(声 *明|Declaration|Statement)', false),
  (9, 'copyright', 1, 0.85, '(?i)^(版权声明|Copyright|License)', false), (10, 'traditional_chapter', 1, 0.95, '^(第[一二三四五六七八九十0-9]+章)[ ]*([^0-9\t]*)', true), (11, 'numeric_chapter', 1, 0.9, '^([0-9]+){W}+([^0-9\t].{{3,}})', true),
  (12, 'english_chapter', 1, 0.9, '^(Chapter +[0-9]+) +([^\t]+)', true), (13, 'english_chapter_caps', 1, 0.9, '^(CHAPTER +[0-9]+) +([^\t]+)', true), (14, 'level2_section', 2, 0.85, '^([0-9]+[.][0-9]+){W}+([^0-9\t].{{2,}})', true),
  (15, 'level3_section', 3, 0.8, '^([0-9]+[.][0-9]+[.][0-9]+){W}+([^0-9\t].{{2,}})', true), (16, 'level4_section', 4, 0.75, '^([0-9]+[.][0-9]+[.][0-9]+[.][0-9]+){W}+([^0-9\t].{{2,}})', true)) v(o, section_type, level, confidence, p, numbered)),
b AS (SELECT doc_id, line, line_no, arg_min(p, o) AS p FROM d JOIN p ON regexp_matches(line, p.p) GROUP BY ALL),
e AS (SELECT doc_id, (line_no + 1)::INTEGER AS line_number, level, CASE WHEN numbered THEN regexp_extract(line, p, 1) ELSE '' END AS number,
  CASE WHEN numbered THEN trim(regexp_extract(line, p, 2)) ELSE trim(regexp_extract(line, p, 1)) END AS title,
  TRY_CAST(coalesce(nullif(regexp_extract(line, '[.]+ *([0-9]+) *$', 1), ''), nullif(regexp_extract(line, '\t+([0-9]+) *$', 1), ''), nullif(regexp_extract(line, '{W}+([0-9]+) *$', 1), '')) AS INTEGER) AS page, confidence, section_type
  FROM (SELECT doc_id, line, line_no, p.* FROM b JOIN p USING (p)))"""
SUMMARY = """ SELECT doc_id, count(*) AS n, max(level) AS max_level, round(avg(confidence), 9) AS confidence, count(*) FILTER (number <> '') AS with_number, count(page) AS with_page, count(*) FILTER (level = 0) AS level_0,
  count(*) FILTER (level = 1) AS level_1, count(*) FILTER (level = 2) AS level_2, count(*) FILTER (level = 3) AS level_3, count(*) FILTER (level = 4) AS level_4, count(*) FILTER (confidence >= 0.9) AS high,
  count(*) FILTER (confidence >= 0.8 AND confidence < 0.9) AS medium, count(*) FILTER (confidence < 0.8) AS low FROM e GROUP BY doc_id"""
TOC = """(line <> '' AND (regexp_matches(line, '^(第[一二三四五六七八九十0-9]+章.+[0-9]+|[0-9]+[.]?[0-9]*[ ]+.+[0-9]+|[A-Z][a-z]+ +[0-9]+.+[0-9]+|Abstract.+[IVX0-9]+|目 *录.+[IVX0-9]+|参 *考 *文 *献.+[0-9]+|致 *谢.+[0-9]+|.+\t+[IVX0-9]+|[^0-9]+[ ]+[IVX0-9]+)$')
  OR (regexp_matches(line, '致谢|Publications|Acknowledgment|Biography|CV|Declaration|Epilogue') AND regexp_matches(line, '[IVX0-9]+$')) OR (regexp_matches(line, '^[0-9]+[.][0-9]+') AND NOT regexp_matches(line, '[。.].{10,}')) OR regexp_matches(line, '^第[一二三四五六七八九十0-9]+章')))"""
add("t1_is_toc_line", lambda d, *_: lines_of(dressed(d)).select("doc_id", "line_no", toc.is_toc_line(F.col("line")).alias("toc")), f"WITH {DRESSED} SELECT doc_id, line_no::INTEGER AS line_no, {TOC} AS toc FROM d")
add("t2_toc_boundary", lambda d, *_: toc.toc_boundary(dressed(d)), f"""
WITH {DRESSED}, c AS (SELECT doc_id, line_no, {TOC} AS toc, regexp_matches(line, '(?i)^(第[一二三四五六七八九十0-9]+章 +[^ ]+|[0-9]+ +[^.0-9 ][^ ]+|Chapter +[0-9]+ +[^ ]+|引 *言|绪 *论|Introduction)') AS body FROM d),
g AS (SELECT doc_id, min(line_no) FILTER (line_no > 0 AND NOT toc AND body) AS body, max(line_no) AS last FROM c GROUP BY 1)
SELECT doc_id, 1::INTEGER AS first, least(coalesce(body - 1, last), 150)::INTEGER AS last, 'heading' AS way FROM g""")
add("t3_toc_from_body", lambda d, *_: toc.toc_from_body(lines_of(dressed(d))).select("doc_id", "line_no"), f"""
WITH {DRESSED} SELECT doc_id, line_no::INTEGER AS line_no FROM d WHERE length(line) >= 2 AND regexp_matches(line, '(?i)^(第[一二三四五六七八九十0-9]+章|[0-9]+[.]|[A-Z]+|摘 *要|目 *录|参考文献|致 *谢|攻读|附 *录)')
  AND NOT regexp_matches(line, '图 *[0-9]+|表 *[0-9]+|^根据|^基于|^通过') AND regexp_matches(line, '(?i)第[一二三四五六七八九十0-9]+章|^[0-9]+[.] *[^0-9]|^[0-9]+[.][0-9]+ *[^0-9]|摘 *要|目 *录|参考文献|致 *谢|攻读|附 *录|绪 *论|总结|展望|结论|ABSTRACT|CONCLUSION|REFERENCE')""")
add("t4_parse_toc_entries", lambda d, *_: entries(d).withColumn("page", F.coalesce("page", F.lit(-1))), ENTRIES + " SELECT * REPLACE (coalesce(page, -1)::INTEGER AS page) FROM e")
add("t5_parse_toc_formats", lambda d, *_: toc.parse_toc_formats(lines_of(dressed(d))).where("form = 'dotted'"), CHAP + " SELECT doc_id, i::INTEGER AS line_no, 'dotted' AS form, trim('第' || i || '章 ' || title) AS title, (i + 2)::INTEGER AS page FROM c")
add("t6_dedupe_toc", lambda d, *_: toc.dedupe_toc(entries(d)).select("doc_id", "line_number", "number", "title"),
    ENTRIES + " SELECT doc_id, min(line_number) AS line_number, number, title FROM e GROUP BY doc_id, number, title")
add("t7_fix_toc", lambda d, *_: toc.fix_toc(entries(d)).select("doc_id", "line_number", "level", "title"), ENTRIES + """,
f AS (SELECT *, CASE WHEN number <> '' AND len(string_split(number, '.')) <= 4 THEN len(string_split(number, '.'))::INTEGER ELSE level END AS l FROM e)
SELECT doc_id, line_number, l AS level, CASE WHEN title = '' AND number <> '' THEN '第' || number || CASE WHEN l = 1 THEN '章' ELSE '节' END ELSE title END AS title FROM f""")
add("t8_sort_toc", lambda d, *_: toc.sort_toc(entries(d)).select("doc_id", "line_number", "pos"), ENTRIES + """,
k AS (SELECT *, CASE WHEN number = '' THEN [999, 0, 0, 0] ELSE list_concat(list_transform(string_split(replace(replace(number, '第', ''), '章', ''), '.'), lambda z: coalesce(TRY_CAST(z AS INTEGER), 0)), [0, 0, 0, 0])[1:4] END AS k FROM e)
SELECT doc_id, line_number, row_number() OVER (PARTITION BY doc_id ORDER BY k, line_number)::INTEGER AS pos FROM k""")
add("t9_canonical_titles", lambda d, *_: toc.canonical_titles(entries(d)).select("doc_id", "line_number", "title"), ENTRIES + """
SELECT doc_id, line_number, CASE WHEN section_type = 'references' THEN '参考文献' WHEN section_type = 'acknowledgment' THEN '致谢' WHEN section_type IN ('achievements', 'author_profile') AND
  regexp_matches(title, '研究成果|学术成果|作者简介|个人简历') THEN regexp_extract(title, '研究成果|学术成果|作者简介|个人简历') ELSE title END AS title FROM e""")
add("t10_nest_toc", lambda d, *_: toc.nest_toc(entries(d)).select("doc_id", F.coalesce(F.size("chapters"), F.lit(0)).alias("chapters"), F.size("special_sections").alias("special"), F.size("post_references").alias("post")), ENTRIES + """,
w AS (SELECT *, level = 1 AND section_type IN ('traditional_chapter', 'numeric_chapter', 'english_chapter', 'chapter') AS c, bool_or(section_type = 'references') OVER (PARTITION BY doc_id ORDER BY line_number) AS r FROM e)
SELECT doc_id, count(*) FILTER (c)::INTEGER AS chapters, count(*) FILTER (section_type IN ('abstract', 'conclusion', 'references'))::INTEGER AS special,
  count(*) FILTER (r AND section_type IN ('achievements', 'acknowledgment', 'author_profile', 'appendix', 'declaration', 'copyright'))::INTEGER AS post FROM w GROUP BY 1""")
add("t11_toc_summary", lambda d, *_: toc.toc_summary(entries(d)), ENTRIES + SUMMARY)
add("t12_toc_quality", lambda d, *_: toc.toc_quality(toc.toc_summary(entries(d))), ENTRIES + ", s AS (" + SUMMARY + """)
SELECT doc_id, least(100, 30 + CASE WHEN n >= 20 THEN 20 WHEN n >= 10 THEN 15 WHEN n >= 5 THEN 10 ELSE 0 END + CASE WHEN max_level >= 3 THEN 15 WHEN max_level = 2 THEN 10 WHEN max_level = 1 THEN 5 ELSE 0 END
  + floor(with_number / n * 15) + floor(with_page / n * 10) + floor(confidence * 10))::INTEGER AS quality FROM s""")
add("t13_heading_outline", lambda d, s, x: toc.heading_outline(toc.html_headings(load(s, x, "pages"))), r"""
WITH h AS (SELECT page_id, regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 1) AS l, regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 2) AS x FROM pages),
r AS (SELECT page_id AS doc_id, i::INTEGER AS paragraph_index, CAST(l[i] AS INTEGER) AS level, trim(regexp_replace(x[i], '(?s)<.*?>', '', 'g')) AS title, ((i - 1) // 28 + 1)::INTEGER AS page FROM h, range(1, len(l) + 1) AS q(i))
SELECT * FROM r WHERE length(title) BETWEEN 2 AND 100 AND NOT regexp_matches(title, '^[\d\s.]+$')""")
add("t14_level1_share", lambda d, *_: toc.level1_share(entries(d)), ENTRIES + " SELECT doc_id, count(*) AS n, count(*) FILTER (level = 1) AS level_1, round(avg((level = 1)::INTEGER), 9) AS share FROM e GROUP BY 1")
add("t15_toc_regions", lambda d, *_: toc.toc_regions(lines_of(dressed(d)).select("doc_id", F.col("line_no").alias("paragraph_index"), F.col("line").alias("text"))), f"""
WITH {DRESSED}, k AS (SELECT doc_id, line_no, line_no - lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) AS gap FROM d
  WHERE regexp_matches(line, '^.+?[ .\t]+[0-9]+$') AND length(regexp_extract(line, '^(.+?)[ .\t]+([0-9]+)$', 1)) <= 100 AND TRY_CAST(regexp_extract(line, '^(.+?)[ .\t]+([0-9]+)$', 2) AS INTEGER) <= 1000),
r AS (SELECT *, sum(CASE WHEN gap > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS region FROM k)
SELECT doc_id, region::BIGINT AS region, min(line_no)::INTEGER AS first, max(line_no)::INTEGER AS last, count(*) AS n FROM r GROUP BY ALL HAVING count(*) >= 3""")

# stored versions, comparison, quality: labels and documents as two runs
FIELDS = ["lang", "source", "grade"]


def run_a(d, s, x):
    return d.select("doc_id", "lang", F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("source"), F.lit("").alias("grade"))


def run_b(d, s, x):
    return d.join(load(s, x, "labels"), "doc_id", "left").select("doc_id", F.when(F.col("toxic") == 1, "toxic").otherwise(F.col("lang")).alias("lang"), "source", F.col("quality").cast("string").alias("grade"))


AB = """WITH a AS (SELECT doc_id, lang, CASE WHEN doc_id % 4 <> 0 THEN source END AS source, '' AS grade FROM documents),
b AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' ELSE lang END AS lang, source, CAST(quality AS VARCHAR) AS grade FROM documents LEFT JOIN labels USING (doc_id)),
l AS (SELECT a.doc_id, f, nullif(trim(va), '') AS va, nullif(trim(vb), '') AS vb FROM (SELECT a.doc_id, unnest(['lang', 'source', 'grade']) AS f, unnest([a.lang, a.source, a.grade]) AS va, unnest([b.lang, b.source, b.grade]) AS vb FROM a JOIN b USING (doc_id)) a)"""
add("d10_best_candidate", lambda d, *_: ranking.best_candidate(lines_of(d).select("doc_id", F.lit("title_cn").alias("field"), F.col("line_no").alias("n"), F.col("line").alias("value")).where("value != ''"), {"title_cn": (5, 40)}), f"""
WITH {LINES} SELECT doc_id, 'title_cn' AS field, line AS value FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY (length(line) BETWEEN 5 AND 40) DESC, CASE WHEN length(line) BETWEEN 5 AND 40 THEN 0 ELSE -length(line) END, line_no) AS r FROM d WHERE line <> '') WHERE r = 1""")
add("d11_compare_extractions", lambda d, s, x: ranking.compare_extractions(run_a(d, s, x), run_b(d, s, x), FIELDS), AB + " SELECT doc_id, f AS field, CASE WHEN vb IS NULL THEN 'only_a' WHEN va IS NULL THEN 'only_b' ELSE 'differs' END AS status FROM l WHERE va IS DISTINCT FROM vb")
add("d12_improvement", lambda d, s, x: ranking.improvement(run_a(d, s, x), run_b(d, s, x), FIELDS), AB + """
SELECT doc_id, count(va) AS before, count(vb) AS after, count(vb) - count(va) AS delta, round((count(vb) - count(va)) / 33, 9) AS rate, coalesce(string_agg(f, ',' ORDER BY f) FILTER (va IS NULL), '') AS gained FROM l WHERE va IS NOT NULL OR vb IS NOT NULL GROUP BY doc_id""")
add("d13_fill_from", lambda d, s, x: ranking.fill_from(run_a(d, s, x), run_b(d, s, x), FIELDS), AB + " SELECT a.doc_id, a.lang, coalesce(a.source, b.source) AS source, coalesce(nullif(a.grade, ''), b.grade) AS grade FROM a JOIN b USING (doc_id)")
add("a25_extraction_quality", lambda d, s, x: quality.extraction_quality(run_b(d, s, x).withColumn("n", F.col("doc_id") % 20), FIELDS, "grade", F.col("n")), AB + """,
q AS (SELECT *, (lang IS NOT NULL)::INTEGER + (source IS NOT NULL)::INTEGER + (grade IS NOT NULL)::INTEGER AS filled FROM b)
SELECT doc_id, filled, round(filled / 3, 9) AS confidence, round(filled / 3 * 0.6::DOUBLE + CASE WHEN grade IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN doc_id % 20 > 10 THEN 0.2::DOUBLE ELSE 0 END, 9) AS quality FROM q""")


def told_sections(d):
    words = F.col("line")
    return lines_of(d).select("doc_id", F.col("line_no").alias("ord"), F.concat(F.lit("s"), F.col("line_no").cast("string")).alias("section"), (F.length("line") % 10).alias("score"),
                                 F.split(words, " ").alias("strengths"), F.when(F.length("line") > 100, F.array(F.lit("shorter"))).alias("suggestions"))


add("a26_section_insights", lambda d, *_: quality.section_insights(told_sections(d)), f"""
WITH {LINES}, l AS (SELECT * FROM d ),
i AS (SELECT doc_id, line_no, 0 AS g, k, 'strength' AS kind, string_split(line, ' ')[k] AS insight FROM l, range(1, least(2, len(string_split(line, ' '))) + 1) AS q(k)
 UNION ALL SELECT doc_id, line_no, 1, 1, 'suggestion', 'shorter' FROM l WHERE length(line) > 100 UNION ALL SELECT doc_id, line_no, 2, 1, 'low_score', CAST(length(line) % 10 AS VARCHAR) FROM l WHERE length(line) % 10 < 6)
SELECT doc_id, line_no::INTEGER AS ord, 's' || line_no AS section, kind, insight, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, g, k) AS rank FROM i) WHERE rank <= 10""")
add("a26_section_insights_whole", lambda d, *_: quality.section_insights(told_sections(d)),
    ORACLE_SQL["a26_section_insights"])
add("a30_validate_fields", lambda d, *_: quality.validate_fields(d.withColumn("first", F.substring_index("text", "\n", 1)), "source", "lang", "first"), f"""
SELECT doc_id, false AS number_ok, true AS author_ok, NOT (trim({FIRST_LINE}) <> '' AND length({FIRST_LINE}) < 10) AS title_ok,
  CASE WHEN trim({FIRST_LINE}) <> '' AND length({FIRST_LINE}) < 10 THEN 'number,title' ELSE 'number' END AS failed FROM documents""")
add("a31_weighted_confidence", lambda d, s, x: quality.weighted_confidence(run_b(d, s, x).withColumnRenamed("grade", "title_cn"), ["lang", "source", "title_cn"]), AB + """,
q AS (SELECT *, ((lang IS NOT NULL)::INTEGER + (source IS NOT NULL)::INTEGER + (grade IS NOT NULL)::INTEGER) / 3 AS share FROM b), r AS (SELECT *, CASE WHEN grade IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END + least(0.35::DOUBLE, share * 0.35::DOUBLE) AS c FROM q)
SELECT doc_id, round(share, 9) AS completeness, round(c, 9) AS confidence, round(share * 0.4::DOUBLE + c * 0.6::DOUBLE, 9) AS quality, CASE WHEN grade IS NULL THEN 'title_cn' ELSE '' END AS missing FROM r""")
add("a33_fill_rates", lambda d, s, x: quality.fill_rates(run_b(d, s, x), FIELDS), AB + " SELECT f AS field, round(count(vb) / (SELECT count(*) FROM documents), 9) AS rate, round(avg(length(vb)), 9) AS mean_length FROM l WHERE vb IS NOT NULL GROUP BY f")


def stored_lists(d, spark, sf_dir):
    """Documents as records of two stored lists, read back."""
    path = io.scratch(spark, "papers")
    record = d.select("lang", F.substring_index("text", "\n", 1).alias("Title"), F.col("source").alias("PublicationYear"), F.struct(F.length("text").alias("download_count"), F.lit(None).cast("int").alias("citation_count")).alias("Metrics"))
    record.where("lang = 'en'").drop("lang").write.json(f"{path}/T1_relevant_papers_dedup_English.json")
    record.where("lang != 'en'").drop("lang").write.json(f"{path}/T2_TOP30PAPERS_Chinese.json")
    return io.read_papers(spark, f"{path}/*.json", arrays=False).select("Title", "PublicationYear", "Metrics.download_count", "thesis_id", "kind", "lang")


add("s1_read_papers", stored_lists, f"""
SELECT {FIRST_LINE} AS "Title", source AS "PublicationYear", length(text)::INTEGER AS download_count, CASE WHEN lang = 'en' THEN 'T1' ELSE 'T2' END AS thesis_id, CASE WHEN lang = 'en' THEN 'dedup' ELSE 'top30' END AS kind,
  CASE WHEN lang = 'en' THEN 'English' ELSE 'Chinese' END AS lang FROM documents WHERE lang IS NOT NULL""")


def stored_texts(d, spark, sf_dir):
    """Texts stored by source, read back as whole files; a source may have several."""
    path = io.scratch(spark, "texts")
    d.select("source", F.col("text").alias("value")).write.partitionBy("source").text(path)
    files = io.read_documents(spark, path, "*.txt").select(F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"), "text")
    return files.groupBy("source").agg(F.sum(F.length("text")).alias("chars"), F.sum(F.size(F.split("text", "\n")) - 1).alias("lines"))


add("s2_read_documents", stored_texts, "SELECT source, sum(length(text) + 1)::BIGINT AS chars, sum(len(string_split(text, chr(10))))::BIGINT AS lines FROM documents GROUP BY 1")


def stored_by_language(d, spark, sf_dir):
    path = io.scratch(spark, "by-language")
    io.write_papers(d.select("doc_id", "lang", F.substring_index("text", "\n", 1).alias("Title")), path)
    return spark.read.parquet(path).select("doc_id", "lang", "Title")


add("s4_write_papers", stored_by_language, f"""SELECT doc_id, lang, {FIRST_LINE} AS "Title" FROM documents""")


def published_by_language(d, spark, *_):
    """Two states of a table, one in place of the other, read as its manifest has it."""
    root = io.scratch(spark, "published")
    papers = d.select("doc_id", "lang", F.substring_index("text", "\n", 1).alias("Title"))
    publish.publish_papers(papers.withColumn("Title", F.lit("old")), root, "first")
    publish.publish_papers(papers, root, "second")
    publish.publish_papers(papers.limit(0), root, "second")  # a job of a name that is published is not run again
    return publish.read_published(spark, root).select("doc_id", "lang", "Title")


def published_in_rounds(d, spark, *_):
    """Half of the documents, then those that are pending: each document is extracted once, in the round that it came in."""
    root = io.scratch(spark, "extractions")
    texts = d.select("doc_id", "text")
    publish.publish_extractions(texts.where("doc_id % 2 = 0"), root, "even", "rules", "1")
    todo = io.pending_documents(texts, publish.published_documents(spark, root))
    publish.publish_extractions(todo.select("doc_id", "text"), root, "rest", "rules", "2")
    return publish.read_published(spark, root).select("doc_id", "method", "extractor_version", "content_md5")


add("s4_publish_papers", published_by_language, f"""SELECT doc_id, lang, {FIRST_LINE} AS "Title" FROM documents""")
add("s5_publish_extractions", published_in_rounds, "SELECT doc_id, 'rules' AS method, CASE WHEN doc_id % 2 = 0 THEN '1' ELSE '2' END AS extractor_version, md5(text) AS content_md5 FROM documents")
add("s5_with_provenance", lambda d, *_: io.with_provenance(d.select("doc_id", "text"), "rules", "1").select("doc_id", "method", "extractor_version", "content_md5"), "SELECT doc_id, 'rules' AS method, '1' AS extractor_version, md5(text) AS content_md5 FROM documents")
done = lambda d: d.where("doc_id % 3 = 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise("old")).alias("content_md5"))
add("s6_pending_documents", lambda d, *_: io.pending_documents(d, done(d)).select("doc_id"), "SELECT doc_id FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 2 = 0)")
add("s6_reuse_documents", lambda d, *_: io.reuse_documents(d, done(d)).select("doc_id"), "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 2 = 0")


def versions(d, s, x):
    a, b = (f(d, s, x).select("doc_id", "source", F.lit(v).alias("version")) for f, v in ((run_a, "pro"), (run_b, "standard")))
    return a.unionByName(b)


add("s7_pick_best_version", lambda d, s, x: io.pick_best_version(versions(d, s, x), ["doc_id"], ["pro", "standard"], ["source"]), "SELECT doc_id, source, CASE WHEN doc_id % 4 <> 0 THEN 'pro' ELSE 'standard' END AS version FROM documents")
add("s8_artifact_inventory", lambda d, *_: io.artifact_inventory(d.select(F.col("source").alias("thesis_id"), F.when(F.col("lang") == "en", "papers").when(F.col("lang") == "fr", "top").otherwise("other").alias("kind"), F.length("text").alias("length"))), """
SELECT source AS thesis_id, count(*) AS n_files, sum(length(text))::BIGINT AS bytes, false AS has_extraction, bool_or(lang = 'en') AS has_papers, bool_or(lang = 'fr') AS has_top FROM documents GROUP BY 1""")


def raw_results(d):
    pair = lambda k, v: F.struct(F.lit(k).alias("name"), v.alias("value"))
    item = F.struct(
        F.array(pair("TI", F.concat(F.lit("<b>"), F.substring_index("text", "\n", 1), F.lit("</b>"))), pair("YE", F.col("source")), pair("KY", F.col("lang")), pair("PM", F.lit("1-9"))).alias("metadata"),
        F.array(F.struct(F.col("lang").alias("title"), F.lit("1").alias("id"), F.lit(True).alias("corresponding"))).alias("authors"),
        F.lit(None).cast("array<struct<id:string,title:string>>").alias("affiliations"), F.lit(None).cast("array<struct<name:string,value:string>>").alias("indexes"),
        F.lit(None).cast("struct<type:string,title:string,year:string,volume:string,issue:string,pages:string,pageRange:string>").alias("source"),
        F.lit(None).cast("array<struct<title:string>>").alias("funds"), F.array(F.struct(F.array(F.struct(F.col("source").alias("item"))).alias("items"))).alias("keywords"),
        F.array(pair("DTC", F.length("text").cast("string")), pair("CTC", F.col("source"))).alias("metrics"), F.lit(None).cast("struct<status:string,modes:array<string>>").alias("publishing"),
        F.lit(None).cast("struct<resource:string,dataset:string,type:string,ccl1:string,ccl2:string>").alias("repository"),
    )
    return d.select(F.struct(F.array(item).alias("data")).alias("data"))


add("s3_normalize_search_results", lambda d, *_: io.normalize_search_results(raw_results(d)).select("Title", "PublicationYear", "KeyWords", "PageRange", "FirstAuthor", F.array_join("DetailedKeywords", ",").alias("kw"), "Metrics.download_count", "Metrics.citation_count"),
    f"""SELECT regexp_replace('<b>' || {FIRST_LINE} || '</b>', '<.*?>', '', 'g') AS "Title", source AS "PublicationYear", lang AS "KeyWords", '1-9' AS "PageRange", lang AS "FirstAuthor", source AS kw, length(text)::INTEGER AS download_count, 0 AS citation_count FROM documents""")

# logs: views are requests, clicks responses
log = lambda s, x: load(s, x, "events").select("user_id", "event_id", "ts", F.when(F.col("event_type") == "view", "request").when(F.col("event_type") == "click", "response").when(F.col("event_type") == "purchase", "success").otherwise("empty").alias("kind"))
add("l1_parse_log", lambda d, s, x: logs.parse_log(load(s, x, "events").select(F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" INFO "), F.when(F.col("event_type") == "view", "Sending HTTP Request: POST x").when(F.col("event_type") == "click", 'HTTP Request: POST x "HTTP/1.1 200 OK"').otherwise("none")).alias("value"))),
    "SELECT date_trunc('millisecond', ts) AS ts, CASE event_type WHEN 'view' THEN 'request' ELSE 'response' END AS kind FROM events WHERE event_type IN ('view', 'click')")
add("l2_pair_requests", lambda d, s, x: logs.pair_requests(log(s, x), ["user_id"], ("ts", "event_id")).select("user_id", "n", F.round("seconds", 3).alias("seconds")), """
WITH e AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)::INTEGER AS n FROM events WHERE event_type IN ('view', 'click'))
SELECT a.user_id, a.n, round(epoch_us(b.ts) / 1e6 - epoch_us(a.ts) / 1e6, 3) AS seconds FROM e a JOIN e b ON a.user_id = b.user_id AND a.n = b.n AND a.event_type = 'view' AND b.event_type = 'click'""")
add("l3_request_intervals", lambda d, s, x: logs.request_intervals(log(s, x).where("kind = 'request'"), ["user_id"], ("ts", "event_id")), """
WITH e AS (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events WHERE event_type = 'view')
SELECT user_id, count(*) AS requests, round(avg(gap), 6) AS mean_gap, min(gap) AS min_gap, max(gap) AS max_gap FROM e GROUP BY 1""")
add("l4_success_rate", lambda d, s, x: logs.success_rate(log(s, x), ["user_id"]), """
WITH e AS (SELECT user_id, count(*) FILTER (event_type NOT IN ('view', 'click', 'purchase')) AS empty, count(*) FILTER (event_type = 'purchase') AS success FROM events GROUP BY 1)
SELECT user_id, empty, success, CASE WHEN empty + success > 0 THEN round(success / (empty + success), 9) END AS rate FROM e""")

# model scoring: the model is a function of the prompt
TEMPLATE = "Rate {dimension} of {lang} text: {text}"


def answer(prompts: list[str]) -> list[str]:
    if any(len(p) % 97 == 0 for p in prompts):
        raise ValueError("no answer")
    return ['{"score": "%d", "why": "length"}' % (len(p) % 10) if len(p) % 3 else "no idea" for p in prompts]


prompts = lambda d: scoring.build_prompts(d, TEMPLATE, ["lang", "text"], dimensions=["depth", "style"])
add("u1_build_prompts", lambda d, *_: prompts(d).select("doc_id", "dimension", F.md5("prompt").alias("digest")), "SELECT doc_id, m AS dimension, md5('Rate ' || m || ' of ' || lang || ' text: ' || text) AS digest FROM documents, (SELECT unnest(['depth', 'style']) AS m)")
N = "length('Rate ' || m || ' of ' || lang || ' text: ' || text)"
add("u2_score_prompts", lambda d, *_: scoring.score_prompts(prompts(d), answer).drop("prompt"),
    f"""SELECT doc_id, m AS dimension, CASE WHEN {N} % 97 = 0 THEN NULL WHEN {N} % 3 <> 0 THEN '{{"score": "' || {N} % 10 || '", "why": "length"}}' ELSE 'no idea' END AS response, CASE WHEN {N} % 97 = 0 THEN 'ValueError: no answer' END AS error
FROM documents, (SELECT unnest(['depth', 'style']) AS m)""")
add("u3_validate_scores", lambda d, *_: scoring.validate_scores(scoring.score_prompts(prompts(d), answer).select("doc_id", "dimension", "response"), ["score", "why"]).drop("response"),
    f"""SELECT doc_id, m AS dimension, {N} % 97 <> 0 AND {N} % 3 <> 0 AS valid, CASE WHEN {N} % 97 <> 0 AND {N} % 3 <> 0 THEN CAST({N} % 10 AS VARCHAR) ELSE '5' END AS score, CASE WHEN {N} % 97 <> 0 AND {N} % 3 <> 0 THEN 'length' ELSE '5' END AS why
FROM documents, (SELECT unnest(['depth', 'style']) AS m)""")
