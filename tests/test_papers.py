"""Papers: normalising, dedupe, ranking, scores, and stored files."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from scholia.operators import bibliometrics, logs, quality, ranking, scoring
from scholia.sources import io
from scholia.sources.schemas import PAPER

RAW = {
    "code": "200", "message": "ok",
    "data": {"total": 1, "size": 1, "data": [{
        "metadata": [{"name": "TI", "value": "<b>Title</b>"}, {"name": "YE", "value": "2021"}, {"name": "KY", "value": "a;;b"}],
        "authors": [{"title": "Li Wei", "id": "1", "corresponding": True}, {"title": "Ann"}], "source": {"title": "J", "pages": "<i>1-9</i>"},
        "keywords": [{"items": [{"item": "<i>deep</i>"}, {"item": "learning"}]}], "metrics": [{"name": "DTC", "value": "12"}, {"name": "CTC", "value": "n/a"}],
        "repository": {"ccl1": "S1", "ccl2": "S2"},
    }]},
}


def test_normalize_search_results(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(RAW))
    got = io.normalize_search_results(io.read_raw_results(spark, str(tmp_path))).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["Title"], r["PublicationYear"], r["FirstAuthor"], r["PageRange"], r["DetailedKeywords"]) == ("Title", "2021", "Li Wei", "1-9", ["deep", "learning"])
    assert (r["Metrics"]["download_count"], r["Metrics"]["citation_count"]) == (12, 0) and r["Authors"][1]["corresponding"] is False
    assert r["Affiliations"] is None and r["Repository"]["subject_category_2"] == "S2"


def papers(spark, *rows):
    cols = ["pos", "lang", "Title", "PublicationYear", "cited", "fund"]
    df = spark.createDataFrame([(r + (None,) * 6)[:6] for r in rows], "pos long, lang string, Title string, PublicationYear string, cited int, fund string")
    return df.select(
        *cols[:4], F.struct(F.lit(0).alias("download_count"), F.col("cited").alias("citation_count")).alias("Metrics"),
        F.when(F.col("fund").isNotNull(), F.array(F.struct(F.col("fund").alias("title")))).alias("Funds"), F.lit(None).cast("array<struct<id:string,name:string>>").alias("Affiliations"),
    )


def test_dedupe_keeps_the_first(spark):
    p = papers(spark, (3, "x", "A ", "2020"), (1, "x", "a", "2020"), (2, "x", "a", "2021"), (4, "x", None), (5, "x", None), (6, "x", None, "2020"))
    assert sorted(r["pos"] for r in ranking.dedupe_papers(p).collect()) == [1, 2, 4]


def test_citation_mean_counts_bad_years(spark):
    p = papers(spark, (1, "x", "a", "abc", 5), (2, "x", "b", "2020", 1), (3, "x", "c", None, None))
    assert bibliometrics.citation_stats(p).first()["citations_mean"] == 2.0
    assert bibliometrics.citation_stats(p, strict=True).first()["citations_mean"] == 0.5
    assert {r["metric"]: r["n"] for r in bibliometrics.year_stats(p).collect() if r["name"] is None} == {"earliest": 2020, "latest": 2020, "span": 1}


def test_ties_go_by_name(spark):
    counts = spark.createDataFrame([("b", 2), ("a", 2), ("c", 3)], "name string, n long")
    assert [r["name"] for r in bibliometrics.top(counts, 2).collect()] == ["c", "a"]


def test_zero_vector_ranks_last(spark):
    t = spark.createDataFrame([(1, "x", [1.0, 0.0])], "thesis_id long, lang string, embedding array<float>")
    p = spark.createDataFrame([(1, "x", 7, [0.0, 0.0]), (1, "x", 8, [-1.0, 0.0]), (1, "x", 9, [1.0, 1.0])], "thesis_id long, lang string, paper_id long, embedding array<float>")
    got = ranking.top_papers(ranking.cosine_similarity(t, p)).orderBy("rank").collect()
    assert [(r["paper_id"], r["similarity"] is None) for r in got] == [(9, False), (8, False), (7, True)]


def test_score(spark):
    p = papers(spark, (1, "x", "a", "2024", 2, "国家自然科学基金"), (2, "x", "b", "2021", 0, "企业"), (3, "x", "c", "bad"))
    assert [(r["pos"], r["score"]) for r in ranking.score_papers(p).collect()] == [(1, 210.0), (2, 70.0), (3, 0.0)]


def test_review_scores(spark):
    refs = "\n".join(f"[{k}] A. Study of things, {2017 + k % 9}" for k in range(1, 11))
    t = spark.createDataFrame([(1, refs, "x" * 1200), (2, None, None)], "thesis_id long, references string, review string")
    p = spark.createDataFrame([(1, "Chinese")] * 12, "thesis_id long, lang string")
    got = {r["thesis_id"]: r for r in quality.review_rating(t, p).collect()}
    assert (got[1]["coverage"], got[1]["depth"], got[1]["relevance"], got[1]["overall"]) == ("excellent", "good", "good", "good")
    assert got[1]["suggestions"] == "deeper review, wider search" and got[2]["coverage"] == "weak"
    years = quality.reference_years(t.where("thesis_id = 1"))
    assert sorted(r["year"] for r in years.collect())[:2] == [2017, 2018]
    assert quality.timeliness(years).first()["n"] == 10


def test_log_lines(spark):
    lines = [
        "2025-01-01 10:00:00,000 - INFO - Sending HTTP Request: POST https://x", '2025-01-01 10:00:07,500 - INFO - HTTP Request: POST https://x "HTTP/1.1 200 OK"',
        "2025-01-01 10:00:08,000 - API返回空内容", "2025-01-01 10:00:09,000 - API调用第1次成功", "2025-01-01 10:01:00,000 - INFO - Sending HTTP Request: POST https://x", "noise",
    ]
    log = logs.parse_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [r["seconds"] for r in logs.pair_requests(log).collect()] == [7.5]
    assert logs.success_rate(log).first()["rate"] == 0.5


def test_failures_stay_as_rows(spark):
    def model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("refused")
        return ['{"score": "8"}' for _ in prompts]

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, None)], "doc_id long, text string")
    got = scoring.validate_scores(scoring.score_prompts(scoring.build_prompts(df, "Rate: {text}", ["text"]), model), ["score"])
    assert {r["doc_id"]: (r["score"], r["valid"], r["error"]) for r in got.collect()} == {1: ("8", True, None), 2: ("5", False, "RuntimeError: refused"), 3: ("8", True, None)}


def test_written_papers_come_back(spark, tmp_path):
    path = str(tmp_path / "p")
    p = spark.createDataFrame([], PAPER).withColumn("lang", F.lit("x")).unionByName(papers(spark, (1, "zh", "a"), (2, "en", "b")).select("Title", "lang"), allowMissingColumns=True)
    io.write_papers(p, path)
    assert spark.read.parquet(path).where("lang = 'en'").first()["Title"] == "b"
    io.write_extractions(spark.createDataFrame([(1, "t")], "doc_id long, text string"), str(tmp_path / "e"), "rules", "1")
    docs = spark.createDataFrame([(1, "t"), (2, "u")], "doc_id long, text string")
    assert [r["doc_id"] for r in io.pending_documents(docs, spark.read.parquet(str(tmp_path / "e"))).collect()] == [2]


def test_paper_files(spark, tmp_path):
    for name in ("51177_relevant_papers_Chinese.json", "51177_relevant_papers_dedup_English.json", "51177_TOP30PAPERS_English.json"):
        (tmp_path / name).write_text(json.dumps([{"Title": "a"}, {"Title": "b"}]))
    got = io.read_papers(spark, str(tmp_path)).groupBy("thesis_id", "kind", "lang").count().collect()
    assert {(r["kind"], r["lang"], r["count"]) for r in got} == {("raw", "Chinese", 2), ("dedup", "English", 2), ("top30", "English", 2)}
    inventory = io.artifact_inventory(io.artifact_files(spark, str(tmp_path))).first()
    assert (inventory["n_files"], inventory["has_top"], inventory["has_extraction"]) == (3, True, False)
    (tmp_path / "d.md").write_text("# x\ny")
    assert io.read_documents(spark, str(tmp_path)).first()["text"] == "# x\ny"


def test_all_similarities_and_best_over_several_blocks(spark, monkeypatch):
    for name in ("THESES", "PAIR_PAPERS", "BEST_PAPERS", "STEP"):
        monkeypatch.setattr(ranking, name, 7)
    # ids that do not start at 0, one vector many times, a zero, a null and a short one
    rows = [(k, [float(k * k % 11 - 5), float(k % 7 - 3), 0.1 * (k % 3)] if k % 5 else [0.3, 0.1, 0.7], str(k % 2)) for k in range(100, 200)]
    rows += [(200, [0.0, 0.0, 0.0], "0"), (201, None, "1"), (202, [1.0], "0")]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, lang string")
    t, p = v.where("vec_id % 4 = 0").withColumnRenamed("vec_id", "thesis_id").select("thesis_id", "embedding"), v.withColumnRenamed("vec_id", "paper_id")
    pairs = t.select("thesis_id").crossJoin(p.select("paper_id", "lang", "embedding"))
    want = ranking.cosine_similarity(t, pairs, keys=("thesis_id",)).join(p.select("paper_id", "lang"), "paper_id").select("thesis_id", "paper_id", "lang", "similarity")
    assert sorted(map(str, ranking.all_similarities(t, p).collect())) == sorted(map(str, want.collect()))
    best = ranking.top_papers(want, 9)
    assert sorted(map(str, ranking.all_top_papers(t, p, 9).select(best.columns).collect())) == sorted(map(str, best.collect()))
    assert best.select("thesis_id").distinct().count() == 26


def test_query_verdict_counts_matches_without_ranking_them(spark):
    from scholia import plans

    plan = plans.QUERIES["d6_query_verdict"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "10000000" not in plan


def test_search_by_broadcast_and_by_salt(spark, monkeypatch):
    import random

    from scholia.operators import ranking

    rnd = random.Random(3)
    words = ["Deep", "nets", "graph", "Survey", "of", "steel", "brass"]
    papers = [(k, rnd.choice(["zh", "en", "en", "en"]), dt.date(2000 + k % 30, 1 + k % 12, 3), " ".join(rnd.choices(words, k=4)), rnd.choice([None, "Graph nets"])) for k in range(400)]
    queries = [(f"q{k}", rnd.choice(["zh", "en", "fr"]), rnd.choice([None, "20150101"]), rnd.choice(["T", "K"]), rnd.sample(words, rnd.randrange(3)), rnd.sample(words, rnd.randrange(3)), rnd.choice([None, ["OF"]])) for k in range(30)]
    p = spark.createDataFrame(papers, "pos int, lang string, pub_date date, Title string, KeyWords string")
    q = spark.createDataFrame(queries, "qid string, lang string, cutoff string, field string, all array<string>, any array<string>, none array<string>")
    want = set()
    for qid, lang, cutoff, field, every, some, none in queries:
        for pos, of, date, title, keys in papers:
            hay = ((title if field == "T" else keys) or "").lower()
            has = lambda w: w.lower() in hay  # noqa: B023, E731
            if of == lang and date.strftime("%Y%m%d") <= (cutoff or "20220101") and all(map(has, every)) and (not some or any(map(has, some))) and not any(map(has, none or [])):
                want.add((qid, pos))
    fields = {"T": ["Title"], "K": ["KeyWords"]}
    got = lambda: {(r["qid"], r["pos"]) for r in ranking.matching_papers(q, p, fields).collect()}
    assert got() == want and len(want) > 50
    monkeypatch.setattr(ranking, "MOST_QUERIES", 5)
    assert got() == want
    plan = ranking.matching_papers(q, p, fields)._jdf.queryExecution().optimizedPlan().toString()
    assert "salt" in plan


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_near_titles_are_all_pairs_within_two_edits(spark):
    import random

    from scholia.operators import ranking

    rnd = random.Random(8)
    titles = ["aaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaa", "aaaaaaa", "", None, "  ", "ab", "b", "ba", "Ünï côdé tïtle", "ünï code tïtle"]
    while len(titles) < 1_000:
        if rnd.random() < 0.5 and len(titles) > 20:
            t = list(rnd.choice([x for x in titles if x]))
            for _ in range(rnd.randrange(4)):
                k = rnd.randrange(len(t) + 1)
                t[k : k + rnd.randrange(2)] = rnd.choice([[], [rnd.choice("abc ")]])
            titles.append("".join(t))
        else:
            titles.append("".join(rnd.choice("abcdef ") for _ in range(rnd.choice([3, 6, 8, 9, 10, 11, 12, 20, 40]))))
    first = {}
    for k, t in enumerate(titles):
        if t and t.strip():
            first.setdefault(t.strip().lower(), k)
    rows = list(first.items())
    want = {(min(i, j), max(i, j), d) for x, (a, i) in enumerate(rows) for b, j in rows[:x] if abs(len(a) - len(b)) < 3 and (d := edits(a, b)) <= 2}
    df = spark.createDataFrame(list(enumerate(titles)), "pos int, Title string")
    got = [tuple(r) for r in ranking.near_titles(df).collect()]
    assert set(got) == want and len(got) == len(want) > 300
    assert ranking.near_titles(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [1, 2, 3])
def test_near_titles_of_long_texts(spark, most):
    import random

    from scholia.operators import ranking

    rnd, titles = random.Random(most), ["ab" * 20, "ab" * 21, "ba" * 20, "a" * 30, "a" * 31, "a" * 33]
    for n in (17, 18, 19, 20, 23, 24, 25, 26, 30, 40) * 4:
        word = [rnd.choice("ab") for _ in range(n)]
        titles.append("".join(word))
        for _ in range(5):
            t = list(word)
            for _ in range(rnd.randrange(1, most + 2)):
                k = rnd.randrange(len(t))
                t[k : k + rnd.randrange(2)] = rnd.choice([[], [rnd.choice("ab")]])
            titles.append("".join(t))
    rows = [(t, k) for k, t in enumerate(titles) if t not in titles[:k]]
    want = {(min(i, j), max(i, j), d) for x, (a, i) in enumerate(rows) for b, j in rows[:x] if abs(len(a) - len(b)) <= most and (d := edits(a, b)) <= most}
    got = ranking.near_titles(spark.createDataFrame(list(enumerate(titles)), "pos int, Title string"), most=most)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


def test_near_titles_give_no_more_keys_for_longer_titles(spark):
    from scholia.operators import ranking

    titles = spark.createDataFrame([(0, "abcdefghijklmnopqrs"), (1, "".join(map(str, range(3_000))))], "pos int, title string").withColumn("size", F.length("title"))
    for probe, n in ((False, 3), (True, 12)):
        assert [r["count"] for r in ranking._part_keys(titles, 2, probe).groupBy("pos").count().orderBy("pos").collect()] == [n, n]


def test_near_titles_by_bytes(spark):
    from scholia.operators import ranking

    titles = ["kühle", "kéhle", "kahle", "kahl", "Übersicht der Verfahren", "übersicht dér verfahren", "ubersicht der verfahren", "übérsicht dér verfahren"]
    rows = list(enumerate(t.lower().encode().decode("latin-1") for t in titles))
    want = {(i, j, d) for i, a in rows for j, b in rows if i < j and (d := edits(a, b)) <= 2}
    df = spark.createDataFrame(list(enumerate(titles)), "pos int, Title string")
    assert {tuple(r) for r in ranking.near_titles(df, in_bytes=True).collect()} == want
    assert (1, 3) not in {(a, b) for a, b, _ in want} and (1, 3, 2) in {tuple(r) for r in ranking.near_titles(df).collect()}


def test_blocks_of_theses_are_large_so_that_papers_are_seldom_repeated(spark, monkeypatch):
    v = spark.range(9_000).selectExpr("id", "array(cast(id AS float), 1f) AS embedding", "'x' AS lang")
    t, p = v.selectExpr("id AS thesis_id", "embedding"), v.limit(3).selectExpr("id AS paper_id", "lang", "embedding")
    sent = []
    kind = type(v)
    whole = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, *a, **k: (sent.append(df), whole(df, *a, **k))[1])
    got = ranking.all_similarities(t, p)
    assert got.count() == 27_000
    assert sent[0].count() <= 9_000 + 3 * 2


@pytest.mark.parametrize("name", ["a14_keyword_trends", "a29_metadata_report"])
def test_papers_are_gone_through_once(spark, name):
    from scholia import plans

    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    (lines,) = [x for x in plan.split("\n") if "collect_list(" in x]
    assert ("p_type" in lines, "s_name" in lines) == (name == "a14_keyword_trends", name == "a29_metadata_report")
