"""Ids of all sizes through archives, and columns of all appends through merging."""

import pytest

pytest.importorskip("scoreloom.llm")

from pyspark.sql import functions as F  # noqa: E402

from scoreloom.llm import compaction, warc  # noqa: E402
from scoreloom.llm._common import shared_dir  # noqa: E402


def test_page_ids_of_all_sizes_come_back(spark):
    html = "<p>" + "x" * 200
    ids = [1 << 62, (1 << 63) - 1, -1, -(1 << 62), 0, 10**18]
    rows = [(k, f"u{k}", html) for k in ids] + [((1 << 62) + 1, "v", "y" * 40_000)]
    path = shared_dir(spark, "warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert set(got) == {k for k, *_ in rows} and all(r.error is None for r in got.values())
    assert {k: r.refers_to for k, r in got.items()} == {k: min(ids) if k in ids and k != min(ids) else None for k in got}
    for text in ("9223372036854775808", "-9223372036854775809", "1" * 41, "x", ""):
        with pytest.raises(ValueError):
            warc._number({"a": text}, "a")
    assert warc._number({"a": "-9223372036854775808"}, "a") == -(1 << 63)


def test_appends_with_other_columns_lose_nothing(spark):
    table = compaction.ShardTable(spark, shared_dir(spark, "t"), fan_in=2)
    table.append(spark.createDataFrame([(1, "a")], "id long, text string"))
    table.append(spark.createDataFrame([(2,)], "id long"))
    table.append(spark.createDataFrame([(3, "c", 0.5)], "id long, text string, more double"))
    table.append_each(spark.createDataFrame([(4, 1), (5, 2)], "id long, arrival int"), "arrival", compact=False)
    rows = [(1, "a", None), (2, None, None), (3, "c", 0.5), (4, None, None), (5, None, None)]
    assert sorted(map(tuple, table.read().select("id", "text", "more").collect())) == rows
    table.compact()
    table.vacuum(keep_versions=1, grace_seconds=-60)
    assert len(table.manifest()["runs"]) < 5 and sorted(map(tuple, table.read().select("id", "text", "more").collect())) == rows
    version = table.manifest()["version"]
    for odd in ("id string", "ID long", "text binary"):
        with pytest.raises(ValueError):
            table.append(spark.createDataFrame([], odd))
        with pytest.raises(ValueError):
            table.append_each(spark.createDataFrame([], f"{odd}, arrival int"), "arrival")
    assert table.manifest()["version"] == version and table.append(spark.range(0).select(F.col("id"))) == version + 1
