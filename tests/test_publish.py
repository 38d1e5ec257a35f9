"""Published tables: whole before and after a job, whatever happens to it."""

import threading

import pytest
from pyspark.sql import functions as F

from scholia.sources import io, publish


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/table"


def table(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, text string")


def ids(spark, root):
    return sorted(r["doc_id"] for r in publish.read_published(spark, root).collect())


def test_a_job_that_dies_before_its_commit_changes_nothing(spark, root):
    assert publish.publish(table(spark, (1, "a")), root, "monday")
    left = publish.write_aside(table(spark, (2, "b")), root)  # written, and then the job is killed
    assert ids(spark, root) == [1]
    dead = table(spark, (3, "c")).select("doc_id", F.raise_error(F.lit("killed")).cast("string").alias("text"))
    with pytest.raises(Exception, match="killed"):
        publish.publish(dead, root, "tuesday")
    assert ids(spark, root) == [1] and publish.manifest(spark, root)["number"] == 1
    assert publish.publish(table(spark, (2, "b")), root, "tuesday")  # run again
    assert ids(spark, root) == [2] and publish.manifest(spark, root)["runs"] == ["monday", "tuesday"]
    assert publish.sweep(spark, root, running=(left,)) >= 1 and publish.sweep(spark, root) == 1
    assert ids(spark, root) == [2]


def test_a_job_is_published_once(spark, root):
    for _ in range(3):
        publish.publish(table(spark, (1, "a")), root, "one", append=True)
    folder = publish.write_aside(table(spark, (1, "a")), root)
    assert not publish.commit(spark, root, folder, "one", append=True)  # it was published between its write and its commit
    publish.publish(table(spark, (2, "b")), root, "two", append=True)
    assert ids(spark, root) == [1, 2]


def test_readers_keep_the_table_they_opened(spark, root):
    publish.publish(table(spark, (1, "a")), root, "one")
    before = publish.read_published(spark, root)
    publish.publish(table(spark, (2, "b")), root, "two")
    assert [r["doc_id"] for r in before.collect()] == [1] and ids(spark, root) == [2]


def test_jobs_that_commit_at_once_lose_nothing(spark, root):
    folders = [publish.write_aside(table(spark, (k, "x")), root) for k in range(6)]
    work = [threading.Thread(target=publish.commit, args=(spark, root, f, f"job {k}", True)) for k, f in enumerate(folders)]
    [w.start() for w in work]
    [w.join() for w in work]
    assert ids(spark, root) == list(range(6)) and publish.manifest(spark, root)["number"] == 6


def test_only_new_or_changed_documents_are_done_again(spark, root):
    done = lambda: publish.published_documents(spark, root)
    first = table(spark, (1, "a"), (2, "b"))
    assert io.pending_documents(first, done()).count() == 2
    publish.publish_extractions(first, root, "one", "rules", "1")
    second = table(spark, (1, "a"), (2, "changed"), (3, "c"))
    todo = io.pending_documents(second, done())
    assert sorted(r["doc_id"] for r in todo.collect()) == [2, 3]
    publish.publish_extractions(todo.select("doc_id", "text"), root, "two", "rules", "1")
    assert io.pending_documents(second, done()).count() == 0 and publish.read_published(spark, root).count() == 4


def test_papers_by_language_and_tables_not_published(spark, root):
    with pytest.raises(ValueError, match="nothing is published"):
        publish.read_published(spark, root)
    assert publish.read_published(spark, root, "a int").count() == 0
    papers = spark.createDataFrame([("t", "Chinese"), ("u", "English"), (None, None)], "Title string, lang string")
    publish.publish_papers(papers, root, "papers")
    got = publish.read_published(spark, root)
    assert sorted(map(str, got.select("Title", "lang").collect())) == sorted(map(str, papers.collect()))
    assert "PartitionFilters: [isnotnull(lang" in got.where("lang = 'English'")._jdf.queryExecution().executedPlan().toString()
