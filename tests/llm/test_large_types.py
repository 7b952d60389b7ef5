"""Operators over Arrow's large types, and over columns with dots in their names."""

from __future__ import annotations

import numpy as np
import pytest

from polymere.llm import byte_cnn, capture_merge, curriculum, guess_cost, line_crf, shard, simhash_index, telephony, text_density, winnow

from .data import SCHEMA, awkward, prose


@pytest.fixture(params=["false", "true"])
def large(spark, request):
    spark.conf.set("spark.sql.execution.arrow.useLargeVarTypes", request.param)
    yield
    spark.conf.unset("spark.sql.execution.arrow.useLargeVarTypes")


def test_every_operator(spark, large):
    df = spark.createDataFrame(awkward(), SCHEMA).selectExpr("*", "source as `a.b`", "text as `c d`")
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([(1, prose(30, 41))], "item_id bigint, text string")
    n = len(awkward())
    audio = telephony.store_pcm(df.selectExpr("*", "'ima_adpcm' as codec"), "doc_id", "text", "codec").collect()
    assert len(audio) == n and all((r.pcm is None) == (r.n_samples is None) for r in audio)
    assert byte_cnn.identify(df).count() == n
    assert guess_cost.scan(df).count() == 0
    assert line_crf.score(df, labels).count() == n
    assert line_crf.keep_good(df, labels).columns == df.columns
    assert simhash_index.deduplicate(df).columns == df.columns
    for held in (winnow.HELD_BYTES, 20):
        assert winnow.decontaminate(df, bench, held_bytes=held).count() == n
    assert curriculum.mix(df, budget=10**9).select(*[f"`{c}`" for c in df.columns]).count() == n
    assert shard.shuffle_into_shards(df, 5).count() == n
    pages = spark.createDataFrame([(1, "http://a.org", "<p>x</p>"), (None, None, None)], "page_id bigint, url string, html string")
    assert text_density.main_text(pages).count() == 2
    assert capture_merge.merge_runs(capture_merge.captures_of(pages, pages["page_id"])).count() == 2


def test_ids_that_are_no_numbers_are_null(spark):
    df = spark.createDataFrame([("x", prose(40, 1), "en", "s", 1), ("7", prose(40, 1), "en", "s", 1)], SCHEMA.replace("doc_id bigint", "doc_id string"))
    assert {r.doc_id for r in line_crf.score(df, spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).collect()} == {None, 7}
    assert simhash_index.near_duplicates(df).count() == 0
    assert {r.doc_id for r in byte_cnn.identify(df).collect()} == {None, 7}


def test_number_of_samples_is_told_before_decoding():
    for n in (0, 3, 4, 5, 255, 256, 259, 260, 1000):
        for codec in telephony.CODECS:
            got = telephony.decode([np.zeros(n, np.uint8)], [codec], 8000, 16000, 256)[0]
            assert len(got) == telephony.n_samples(n, codec, 8000, 16000, 256)
