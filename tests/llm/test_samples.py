"""Samples for training: exact in size whatever repeats, bounded in bytes, the same however rows are partitioned."""

from __future__ import annotations

from collections import Counter

from polymere.llm import byte_cnn, common

from .data import prose

SCHEMA = "doc_id bigint, text string, lang string"


def test_size_is_exact_whatever_repeats(spark):
    for same in (7, 11, None):
        rows = [(same, "one text", "en")] * 5000 + [(i, f"text {i}", "en") for i in range(700)]
        df = spark.createDataFrame(rows, SCHEMA)
        got = common.sample_rows(df, 100, "lang", "text", 1 << 20)
        assert len(got) == 100 == len({(r.doc_id, r.text) for r in got})
        again = common.sample_rows(df.repartition(7), 100, "lang", "text", 1 << 20)
        assert [(r.doc_id, r.text) for r in got] == [(r.doc_id, r.text) for r in again]
    assert len(common.sample_rows(spark.createDataFrame([(1, "x", "en")] * 3000, SCHEMA), 100, "lang", "text", 1 << 20)) == 1
    assert common.sample_rows(spark.createDataFrame([], SCHEMA), 100, "lang", "text", 1 << 20) == []


def test_bytes_are_bounded(spark):
    rows = [(i, "y" * 1000, "en") for i in range(300)] + [(1000, "z" * 50_000, "en"), (1001, None, "de"), (1002, "", None)]
    got = common.sample_rows(spark.createDataFrame(rows, SCHEMA), 400, "lang", "text", 100_000)
    assert 90 <= len(got) <= 102 and sum(len(r.text or "") for r in got) <= 100_000
    assert {r.lang for r in got} == {"en", "de", None}


def test_a_hot_id_of_many_texts_is_sampled_too(spark):
    rows = [(7, prose(5, i), "en") for i in range(2000)]
    assert len(common.sample_rows(spark.createDataFrame(rows, SCHEMA), 60, "lang", "text", 1 << 20)) == 60


def test_sample_holds_each_language(spark):
    rows = [(None if i % 50 == 0 else i, f"text {i}", "rare" if i % 2000 == 7 else "few" if i % 100 == 3 else "en") for i in range(20_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = Counter(r.lang for r in common.sample_rows(df, 60, "lang", "text", 1 << 20, 20))
    assert got == {"rare": 10, "few": 20, "en": 60}
    assert byte_cnn.train(df, 60).languages == ["en", "few", "rare"]
    assert len(common.sample_rows(df.limit(50), 60, "lang", "text", 1 << 20)) == 50
