"""From raw documents to training shards, in five stages, each written and read again.

quality   6: documents that the line field rejects go
near_dup 10: one document of each group of near-duplicates stays
leaks     9: documents that share a span of words with the benchmark go
mix       8: sources follow their curriculum; what is beyond a source's demand goes
shards    7: a uniform shuffle into shards of exact sizes

Once a stage's result is written, the tables that it needed on the way and its
predecessor's result are dropped; the last stage's input stays for the caller,
until polymere.llm.common.release.

Defined results: documents of null or empty text go in the first stage (a null
text has no quality, an empty one has quality 0); a null doc_id is never a
near-duplicate, and a doc_id that is no whole number counts as null; a document
that is repeated under its doc_id stays once; a null source is a source of its
own; an empty table gives an empty one. All columns of documents stay, extra ones
too, whatever their names; `shard` and `shard_position` get a trailing underscore
for each column of that name that is there already.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from polymere.llm import curriculum, line_crf, shard, simhash_index, winnow
from polymere.llm.common import persist_table, release, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_crf.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_index.deduplicate(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return winnow.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curriculum.mix(docs).select(*[f"`{c}`" for c in docs.columns])


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shard.shuffle_into_shards(docs)


STAGES = [("quality", quality), ("near_dup", near_dup), ("leaks", leaks), ("mix", mix), ("shards", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What STAGES make of the documents; what each gives is written and read again."""
    docs, before = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES[:-1]:
        docs, path = persist_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(spark, before | {path})
    return STAGES[-1][1](spark, docs, sf_dir)


#: None: the field's fit, the fingerprints and the random draws can't be written in SQL.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
