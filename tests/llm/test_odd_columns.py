"""Columns of any name and type pass through the operators that keep rows; repeated rows take no place in samples or sums."""

from collections import Counter

import pytest

pytest.importorskip("scoreloom.llm")

import corpus_pipeline  # noqa: E402
from scoreloom.llm import bpe, language_id, line_dedup, minhash, mixing  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, `x``y` int, m map<string,int>, s struct<`c.d`: int>"


@pytest.fixture(scope="module")
def docs(spark):
    text = lambda k: f"line of words number {k} that is long enough\n" + " ".join(f"w{(k * j) % 97}" for j in range(60))
    rows = [(k, text(k), "en" if k % 2 else "de", f"s{k % 3}", 0, "dot", 7, {"k": k}, (k,)) for k in range(30)]
    rows += [rows[3]] * 3 + [(None, None, None, None, None, None, None, None, None), (40, text(3) + " z", "en", "s0", 0, None, 8, {}, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


KEEP = {
    "drop_lines": line_dedup.drop_lines, "keep_first": minhash.keep_first, "taken_rows": mixing.taken_rows,
    "without_repeated_lines": lambda d: corpus_pipeline.without_repeated_lines(None, d, ""), "identified": lambda d: corpus_pipeline.identified(None, d, ""),
}


@pytest.mark.parametrize("name", sorted(KEEP))
def test_columns_pass_through(name, docs):
    found = KEEP[name](docs)
    assert found.columns == docs.columns and [f.dataType for f in found.schema] == [f.dataType for f in docs.schema]
    there = {(r.doc_id, r["a.b"], r["x`y"], str(r.m), str(r.s)) for r in docs.collect()}
    rows = found.collect()
    assert rows and {(r.doc_id, r["a.b"], r["x`y"], str(r.m), str(r.s)) for r in rows} <= there
    assert KEEP[name](docs.limit(0)).collect() == []


def test_columns_beside_new_ones(docs):
    encoded = bpe.decode(bpe.encode(docs))
    assert encoded.columns == [*docs.columns, "ids", "decoded"] and all(r.decoded == (r.text or "") for r in encoded.collect())
    told = language_id.predict(docs, language_id.fit(docs, per_lang=5))
    assert told.columns == [*docs.columns, "lang_pred", "score"] and told.count() == docs.count()


def test_repeated_rows_take_no_place_in_the_sample(spark):
    rows = [(1, "one text that repeats", "xx")] * 20_000 + [(k, f"text number {k} of the other language", "yy") for k in range(2, 202)] + [(k, f"of {k}", "zz") for k in range(300, 1300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    found = language_id.training_rows(df, per_lang=150)
    assert Counter(r["lang"] for r in found) == {"xx": 1, "yy": 150, "zz": 150} and len({(r["lang"], r["doc_id"]) for r in found}) == 301
    again = language_id.training_rows(df.repartition(7).limit(30_000), per_lang=150)
    assert [tuple(r) for r in again] == [tuple(r) for r in found]


def test_equal_rows_are_numbered_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a b c", "s")] * 1000 + [(2, "a b", "s"), (3, "x", "t")], "doc_id long, text string, source string").repartition(4)
    key = lambda r: (r.doc_id, r.size, r.copies)
    whole = Counter(map(key, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "BLOCK", 64)
    assert Counter(map(key, mixing.mix(df).collect())) == whole and sum(whole.values()) == 1002
