"""Intermediate tables and shuffle files go when a run is over."""

import glob
import random

import pytest

from scoreloom.llm import minhash
from scoreloom.llm._common import CLEANUP, Scratch, shared_dir


def folders(spark):
    return set(glob.glob(shared_dir(spark, "").removeprefix("file:").rsplit("/", 1)[0] + "/*"))


def near_copies(n, family):
    draw = random.Random(7)
    texts = []
    for _ in range(n):
        base = [str(draw.random()) for _ in range(200)]
        for _ in range(family):
            words = list(base)
            words[draw.randrange(200)] = str(draw.random())
            texts.append(" ".join(words))
    return list(enumerate(texts))


def test_near_duplicates_leave_their_result_alone(spark):
    docs = spark.createDataFrame(near_copies(4, 30), "doc_id long, text string")
    setting, before = spark.conf.get(CLEANUP, "false"), folders(spark)
    found = minhash.near_duplicates(docs)
    left = folders(spark) - before
    assert len(left) == 1 and "near-duplicates" in left.pop()
    assert spark.conf.get(CLEANUP, "false") == setting
    assert found.count() == 120 and found.select("component_id").distinct().count() == 4
    assert found.count() == 120  # a second action reads the same table


def test_a_failed_run_deletes_its_folder_and_restores_the_session(spark):
    setting, before = spark.conf.get(CLEANUP, "false"), folders(spark)
    with pytest.raises(ValueError), Scratch(spark, "failing") as run:
        kept = run.written(spark.range(3), "rows")
        assert kept.count() == 3 and spark.conf.get(CLEANUP) == "true"
        raise ValueError
    assert folders(spark) == before and spark.conf.get(CLEANUP, "false") == setting


def test_only_named_tables_are_dropped(spark):
    with Scratch(spark, "dropping") as run:
        a, b = run.written(spark.range(3), "rows"), run.written(spark.range(4), "rows")
        run.drop(a, a.select("id"))
        assert b.count() == 4 and len(glob.glob(run.path.removeprefix("file:") + "/*")) == 1


def test_components_of_a_chain_keep_the_last_labels_only(spark):
    with Scratch(spark, "chain") as run:
        labels = minhash.components(spark.createDataFrame([(k, k + 1) for k in range(300)], "a long, b long"), run)
        assert labels.where("component = 0").count() == 301
        assert len(glob.glob(run.path.removeprefix("file:") + "/*")) == 1
