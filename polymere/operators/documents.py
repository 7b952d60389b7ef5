"""Semi-structured documents: JSON text as variants, with typed paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """JSON text to a variant; null where it isn't JSON."""
    return F.try_parse_json(text)


def field(document: Column, path: str, kind: str = "string") -> Column:
    """The value at `a.b.c` or `a[0].b`; null where it is missing or of another kind."""
    return F.try_variant_get(document, f"$.{path}" if path else "$", kind)


#: Levels of nesting that a document may have.
MAX_DEPTH = 256


def encode(document: Column) -> Column:
    """JSON text of a variant or struct; null beyond MAX_DEPTH levels of nesting."""
    text = F.to_json(document)
    # the text without what is quoted, and without all but brackets, holds an opening one for each level within reach
    brackets = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\\\]|\\\\.)*+"', ""), r"[^\[\]{}]", "")
    step = lambda d, c: F.struct((d["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(d["most"], d["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("most"))
    depth = F.aggregate(F.filter(F.split(brackets, ""), lambda c: c != ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda d: d["most"])
    return F.when(F.length(brackets) <= 2 * MAX_DEPTH, text).when(depth <= MAX_DEPTH, text)


def paths(df: DataFrame, document: str) -> DataFrame:
    """(path, documents): the top-level fields of all documents and how many have each."""
    return df.select(F.explode(F.map_keys(F.from_json(F.to_json(document), "map<string,string>"))).alias("path")).groupBy("path").agg(F.count("*").alias("documents"))


def content_addressed(df: DataFrame, content: str, key: str) -> DataFrame:
    """(digest, bytes, copies, first_key): each distinct content once, by its digest."""
    c = F.col(content).cast("binary")
    return df.groupBy(F.sha2(c, 256).alias("digest")).agg(F.max(F.octet_length(c)).cast("bigint").alias("bytes"), F.count("*").alias("copies"), F.min(key).alias("first_key"))


# -- blobs: a store has digest, content and refs; a blob is kept while something refers to it


def put(store: DataFrame, blobs: DataFrame, key: str, content: str) -> tuple[DataFrame, DataFrame]:
    """The store with the blobs, and (key, digest, was_new): a content that is there gets another reference."""
    given = blobs.select(F.col(key).alias("key"), F.col(content).cast("binary").alias("content")).filter("content is not null").withColumn("digest", F.sha2("content", 256))
    added = given.groupBy("digest").agg(F.first("content").alias("content"), F.count("*").alias("refs"), F.min("key").alias("__first"))
    known = store.select(F.col("digest").alias("__digest"))
    marked = added.join(known, F.col("digest") == F.col("__digest"), "left").select("digest", (F.col("__digest").isNull()).alias("__new"), "__first")
    answer = given.join(marked, "digest").select("key", "digest", (F.col("__new") & (F.col("key") == F.col("__first"))).alias("was_new"))
    merged = store.select("digest", "content", "refs").unionByName(added.select("digest", "content", "refs"))
    return merged.groupBy("digest").agg(F.first("content").alias("content"), F.sum("refs").alias("refs")), answer


def count_references(store: DataFrame, changes: DataFrame) -> DataFrame:
    """The store after changes (digest, by) of references: +1 retains, -1 releases; a blob without any goes."""
    sums = changes.groupBy(F.col("digest").alias("__digest")).agg(F.sum("by").alias("__by"))
    both = store.join(sums, F.col("digest") == F.col("__digest"), "left")
    return both.select("digest", "content", (F.col("refs") + F.coalesce("__by", F.lit(0))).alias("refs")).filter("refs > 0")


def blob_stats(store: DataFrame) -> DataFrame:
    """(blobs, refs, bytes, bytes_saved): what sharing contents saves."""
    size = F.octet_length("content").cast("bigint")
    zero = F.lit(0).cast("bigint")
    return store.agg(F.count("*").alias("blobs"), F.coalesce(F.sum("refs"), zero).alias("refs"), F.coalesce(F.sum(size), zero).alias("bytes"), F.coalesce(F.sum(size * (F.col("refs") - 1)), zero).alias("bytes_saved"))
