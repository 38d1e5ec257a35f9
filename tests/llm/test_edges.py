"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scholia.llm import bpe, chunk_dedup, decontaminate, exact_dedup, langid, preference, queries, secret_scan, simhash, suffix_dedup, toxicity

import public_tokenizers

from scholia.llm.common import discard, scope

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, digest string, row string, fp long, path string, "
    "kinds string, words string, blob_id string, id long, h long, places string, spans string"
)
LONG = "long text with many words " * 20_000
TEXTS = [None, "", "  \n\t ", "word", "word", "two words", "password = abcdef123", LONG, LONG, "é日本 🙂 ﷺ", "\x00\x1f", "a" * 50_000]


def rows(texts=TEXTS):
    out = [(k, t, "en" if k % 2 else None, None, 1, 0.5, "x", "x", 1, "x", "x", "x", "x", 1, 1, "x", "x") for k, t in enumerate(texts)]
    return out + [out[3], out[7], (None, "word", None, *out[0][3:]), (None, None, None, *out[0][3:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "word"), (2, None), (3, ""), (4, " ".join(f"w{k}" for k in range(20))), (None, "two words")], "item_id long, text string")


def labels(spark, some=True):
    return spark.createDataFrame([(k, 1, k % 2 if k % 3 else None) for k in range(12)] + [(None, None, None)] if some else [], "doc_id long, quality int, toxic int")


def operators(spark, bench, some):
    marks = labels(spark, some)
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return {
        "secret_scan": lambda d: secret_scan.findings_by_path(d, secret_scan.scan(d)[0]),
        "chunk_dedup": chunk_dedup.deduplicate,
        "suffix_dedup": suffix_dedup.deduplicate,
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, marks)),
        "bpe": lambda d: bpe.encode_documents(d, ranks, public_tokenizers.PATTERN),
        "simhash": simhash.near_groups,
        "exact_dedup": exact_dedup.exact_groups,
        "langid": lambda d: langid.predict(d, langid.train(d)),
        "decontaminate": lambda d: decontaminate.contamination(d, bench),
    }


@pytest.mark.parametrize("name", ["secret_scan", "chunk_dedup", "suffix_dedup", "toxicity", "bpe", "simhash", "exact_dedup", "langid", "decontaminate"])
def test_a_row_for_each_row(spark, docs, none, bench, name):
    got = operators(spark, bench, True)[name](docs)
    ids = sorted((r["doc_id"] for r in got.select("doc_id").collect()), key=lambda x: (x is None, x))
    assert ids == sorted((r[0] for r in rows()), key=lambda x: (x is None, x))
    assert operators(spark, bench, False)[name](none).count() == 0


def test_exact_groups_of_edges(docs):
    got = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs, keep="largest").collect()}
    assert {(0, 1, 3), (1, 1, 3), (None, 1, 3), (3, 4, 4), (4, 4, 4), (None, 4, 4), (7, 8, 3), (8, 8, 3), (5, 5, 1)} <= got


def test_exact_dedup_keeps_one_row(docs):
    kept = exact_dedup.deduplicate(docs, keep="largest")
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == [1, 2, 4, 5, 6, 8, 9, 10, 11]
    assert kept.columns == docs.columns


def test_weak_digest_falls_back_on_bytes(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a", "b", "a", "bb", "b", "cc", None])], "doc_id long, text string")
    weak = lambda c: F.unhex(F.sha2(F.length(c).cast("string"), 256))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs, digest=weak).collect()}
    assert got == {0: (0, 2), 1: (1, 2), 2: (0, 2), 3: (3, 1), 4: (1, 2), 5: (5, 1), 6: (6, 1)}


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_levels_of_runs_give_the_groups_and_filters_let_single_texts_pass(spark, keep):
    rnd = random.Random(4)
    rows = [(k, f"text {rnd.randrange(400) if rnd.random() < 0.3 else 1_000 + k}") for k in range(3_000)] + [(None, "text 7"), (None, "alone"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(23)
    index = exact_dedup.build_index(docs, keep=keep, runs=9, fanout=3)
    assert [lv.number for lv in index.levels] == [9, 3, 1]
    groups = {}
    for k, t in rows:
        groups.setdefault(hashlib.sha256((t or "").encode()).digest(), []).append(k)
    pick = {"smallest": min, "largest": max}[keep]
    want = {(d, pick((k for k in ks if k is not None), default=None), len(ks)) for d, ks in groups.items()}
    assert {(bytes(r["digest"]), r["keep_id"], r["n"]) for r in index.top.collect()} == want
    for lv in index.levels:
        assert lv.runs.groupBy("run", "digest").count().where("count > 1").isEmpty()
    for looked_up, passed in index.passed():  # most digests are in one run, and no filter of another holds them
        assert 0.6 * looked_up < passed < looked_up


def test_a_full_filter_lets_all_through_and_changes_nothing(spark, monkeypatch):
    rows = [(k, f"text {k % 700}") for k in range(1_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    told = lambda: {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs).collect()}
    want = {(k, k % 700, 2 if k % 700 < 300 else 1) for k in range(1_000)}
    assert told() == want
    monkeypatch.setattr(exact_dedup, "_slot", lambda digest, bits: F.pmod(F.xxhash64(digest), F.lit(3)))  # three bits for all digests
    assert told() == want


def test_probe_finds_known_texts(spark):
    old = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string")
    new = spark.createDataFrame([(100, "text 7"), (101, "new"), (102, None)], "doc_id long, text string")
    got = exact_dedup.probe(new, exact_dedup.build_index(old)).collect()
    assert [(r["doc_id"], r["keep_id"]) for r in got] == [(100, 7)]


def test_pipeline_stages_keep_columns(spark, tmp_path):
    base = [(k, f"some text number {k} with its own words {k * k}{' you idiot' * (k % 5 == 4)}", "en", "s", 10) for k in range(120)] + [(120, None, None, None, None), (121, "", "en", "s", 0)]
    docs = spark.createDataFrame(base + [base[0], base[1]], "doc_id long, text string, lang string, source string, n_chars long")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 4)) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "nothing like it at all")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf)
        assert at.columns == docs.columns
        stage(spark, docs.limit(0), sf).count()
    last = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(last) == {k for k in range(120) if k % 5 != 4} | {121}  # of the two empty texts the largest id stays
    assert last[5]["decoded_sha256"] == hashlib.sha256(base[5][1].encode()).hexdigest()


def test_queries_have_an_entry_for_each_operator():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}


def test_preference_edges(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (1, 2, "user", None), (1, 3, "assistant", "b"), (1, 4, "user", "bye"),
             (2, 0, "user", "x"), (3, 0, None, None), (None, 0, "assistant", "z"), (4, None, "assistant", ""),
             (5, 0, "user", "x"), (5, 1, "assistant", "long " * 50_000), (6, 0, "assistant", "r"), (6, 1, "assistant", "r")]
    conv = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, prompt string")
    keys = ("conv_id", "kind", "other_id")
    told = preference.format_pairs(preference.preference_pairs(conv), keys).collect()
    got = {r["conv_id"]: r for r in told if r["kind"] != "neighbour"}
    assert {k: r["kind"] for k, r in got.items()} == {1: "reply", 2: "no_reply", 3: "no_reply", None: "single_reply", 4: "single_reply", 5: "single_reply", 6: "reply"}
    assert got[1]["n_shared"] == 3 and got[1]["rejected"] == "<|assistant|>\na<|end|>\n<|user|>\nbye<|end|>\n"
    assert got[1]["chosen_mask"] == got[1]["rejected_mask"] == "14:23"
    assert got[6]["n_shared"] == 2 and got[6]["chosen"] == got[6]["rejected"] == ""
    assert got[5]["chosen"] == "" and got[5]["n_shared"] == 2 and len(got[5]["prompt"]) > 250_000
    met = [r for r in told if r["kind"] == "neighbour"]
    assert [(r["conv_id"], r["other_id"], r["n_shared"], r["rejected"], r["rejected_mask"]) for r in met] == [(5, 2, 1, "", "")]
    assert met[0]["chosen_mask"] == f"14:{len(met[0]['chosen'])}"
    pairs = spark.createDataFrame([(1, None, [("user", "q"), ("assistant", "r")]), (2, [], None)], "conv_id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>")
    out = {r["conv_id"]: r for r in preference.format_pairs(pairs).collect()}
    user = "<|user|>\nq<|end|>\n"
    assert out[1]["n_shared"] == 0 and out[1]["rejected_mask"] == f"{len(user) + 14}:{len(out[1]['rejected'])}"
    assert (out[2]["prompt"], out[2]["chosen"], out[2]["rejected"]) == ("", "", "")
    assert preference.format_pairs(preference.preference_pairs(conv.limit(0)), keys).count() == 0


def test_neighbours_are_paired_once_within_buckets(spark):
    rows = [(k, 0, "user", "hello") for k in range(1_000)] + [(k, 1, "assistant", f"reply {k}") for k in range(1_000)]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    met = preference.neighbour_pairs(conv, bucket=50).collect()
    n = {}
    for r in met:
        for c in (r["conv_id"], r["other_id"]):
            n[c] = n.get(c, 0) + 1
    assert 900 < len(met) < 1_000 and max(n.values()) <= 2 and len(n) > 990


def test_results_that_are_held_outlive_the_pipeline(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"words of text {k % 20}", "en", "s", 10) for k in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "nothing like it")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    held = [simhash.near_groups(docs), exact_dedup.exact_groups(docs), secret_scan.scan(docs)[0], chunk_dedup.deduplicate(docs)]
    first, second = corpus_pipeline.run(spark, sf), corpus_pipeline.run(spark, sf)
    assert first.count() == second.count() > 0
    assert [h.count() for h in held] == [60, 60, 0, 60]
    with scope() as mine:
        inner = exact_dedup.exact_groups(docs)
        with scope() as other:
            exact_dedup.exact_groups(docs)
    assert mine and other and not set(mine) & set(other)
    discard(spark, other)
    assert other == [] and inner.count() == 60


def test_a_ledger_that_is_stored_scans_nothing_twice(spark, tmp_path):
    docs = spark.createDataFrame([(1, "password = abcdef123"), (2, "nothing"), (3, None)], "doc_id long, text string")
    path = str(tmp_path / "ledger")
    secret_scan.store(*secret_scan.scan(docs), path)
    history, ledger = secret_scan.reopen(spark, path)
    assert secret_scan.unseen_pairs(docs, ledger).count() == 0
    more = docs.union(spark.createDataFrame([(4, "token: zzzzzz99"), (5, "password = abcdef123")], docs.schema))
    assert secret_scan.unseen_pairs(more, ledger).select("blob_id").distinct().count() == 1
    findings, _ = secret_scan.scan(more, ledger, history)
    assert {r["doc_id"]: r["n_assign"] for r in secret_scan.findings_by_path(more, findings).collect()} == {1: 1, 2: 0, 3: 0, 4: 1, 5: 1}


def test_the_sample_is_the_same_with_and_without_the_first_cut(spark):
    ids = spark.range(5_000)
    want = sorted(r["id"] for r in ids.orderBy(F.xxhash64("id"), "id").limit(300).collect())
    assert sorted(r["id"] for r in toxicity._least(ids, 300).collect()) == want
    assert toxicity._least(spark.createDataFrame([(7,)] * 3_000, "id long"), 100).count() == 100
    assert toxicity._least(ids.limit(0), 5).count() == 0 and toxicity._least(ids, 6_000).count() == 5_000


def test_near_groups_of_ids_that_repeat_or_are_missing(spark):
    rows = [(5, "alpha beta gamma delta"), (5, "another text altogether here"), (None, "alpha beta gamma delta"), (None, "only without an id"), (9, "alpha beta gamma delta"), (2, "another text altogether here")]
    got = simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 5), (2, 2), (5, 2), (5, 5), (9, 5)]


def test_chunk_dedup_of_rows_that_share_an_id(spark):
    rnd = random.Random(8)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    a, b = word(900), word(700)
    for key, kind in ((None, "long"), (7, "long"), ("seven", "string"), (None, "string")):
        df = spark.createDataFrame([(key, a), (key, a), (key, b), (key, ""), (key, None)], f"doc_id {kind}, text string")
        got = chunk_dedup.deduplicate(df).collect()
        assert sorted(bytes(r["kept"]) for r in got) == sorted([a.encode(), b.encode(), b"", b"", b""])
        assert sorted((r["n_bytes"], r["n_shared"], r["n_removed"], r["n_spans"]) for r in got) == [(0, 0, 0, 0), (0, 0, 0, 0), (700, 0, 0, 0), (900, 900, 0, 0), (900, 900, 900, 1)]
        assert {r["doc_id"] for r in got} == {key}
        # a passage of two rows without an id stays in one of them
        got = chunk_dedup.deduplicate(spark.createDataFrame([(key, a + b), (key, word(50) + a)], f"doc_id {kind}, text string")).collect()
        assert sum(r["n_removed"] > 0 for r in got) == 1


def test_langid_trains_on_distinct_whole_texts_within_bounds(spark, monkeypatch):
    long, seen = "word " * 5_000, {}
    rows = [(k, "same text", "a") for k in range(3_000)] + [(k, None, "a") for k in range(3_000, 3_600)]
    rows += [(k, f"number {'x' * (k % 97)} " * 600, "a") for k in range(3_600, 3_640)] + [(5_001, long, "a"), (5_001, long, "b"), (5_003, long, "b"), (None, "d'autres mots", "c")]
    monkeypatch.setattr(langid, "build", seen.update)
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert seen["a"].decode().count("same text") <= 1 and seen["a"].count(b"word ") == 0
    assert langid.SAMPLE_BYTES < len(seen["a"]) < langid.SAMPLE_BYTES + langid.LONG_BYTES + 200
    assert seen["b"].count(b"word ") == 5_000 and seen["c"] == b"d autres mots "
