"""Full-text search: postings, TF-IDF, BM25, fuzzy terms, snippets.

Words are split and lowered in the JVM, and a document's words are counted where
it is read, by Arrow batches. Only the distinct words of a batch are stemmed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.types import StringType

from ..functions import text as T
from ..plans.scratch import cut
from .relational import is_small

#: Words that a task counts at once, and words whose postings one task sorts.
_WORDS_HELD, _WORDS_SORTED = 1 << 18, 1 << 21


@F.pandas_udf(StringType())  # a type in words would need a session at import
def _stem(words: pd.Series) -> pd.Series:
    return words.map(T.stem)


@dataclass(frozen=True)
class Index:
    """postings: doc_id, term, tf, and positions if kept. docs: doc_id and length, in indexed terms, of every document, terms or none; n of them, of this mean length."""

    postings: DataFrame
    docs: DataFrame
    stemmed: bool
    n: int
    mean: float

    def terms(self, query: str) -> list[str]:
        return T.tokens(query, self.stemmed)

    def lengths(self) -> DataFrame:
        """(doc_id, length) of every document in indexed terms."""
        return self.docs.select("doc_id", "length")

    def vocabulary(self) -> DataFrame:
        """(term, doc_freq, occurrences)"""
        return self.postings.groupBy("term").agg(F.count("*").alias("doc_freq"), F.sum("tf").alias("occurrences"))


def _split(text: str) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def words_of(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(doc_id, position, word): stop words are left out, but count for positions."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.posexplode(_split(text)).alias("position", "word"))
    return rows.filter(~F.col("word").isin(sorted(T.STOPWORDS)))


def _counted(ids: pa.Array, lists: pa.Array, stemmed: bool, positions: bool, stems: dict[str, str]) -> Iterator[pa.RecordBatch]:
    """Postings of documents' lists of words, by document and, in it, in no set order of terms."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, flat, first = np.cumsum(lengths), lists.flatten(), 0
    while first < len(lengths):
        before = int(ends[first] - lengths[first])
        last = max(first + 1, int(np.searchsorted(ends, before + _WORDS_HELD, "right")))
        n, words = lengths[first:last], flat.slice(before, int(ends[last - 1]) - before)
        coded = words.dictionary_encode()
        terms, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        keep = ~pc.is_in(terms, value_set=pa.array(sorted(T.STOPWORDS), terms.type)).to_numpy(zero_copy_only=False)[code]
        if stemmed:
            if len(stems) > 1_000_000:
                stems.clear()
            for w in terms.to_pylist():
                if w not in stems:
                    stems[w] = T.stem(w)
            coded = pa.array([stems[w] for w in terms.to_pylist()], terms.type).dictionary_encode()
            terms, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)[code]
        doc = np.repeat(np.arange(len(n)), n)[keep]
        at = (np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n))[keep]
        key = doc * max(1, len(terms)) + code[keep]
        # stable, so a term's positions stay in order
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        one = order[starts]
        out = [ids.slice(first, last - first).take(pa.array(doc[one])), terms.take(pa.array(code[keep][one])), pa.array(np.diff(starts, append=len(order)))]
        if positions:
            out.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), pa.array(at[order].astype(np.int32))))
        if len(starts):
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "term", "tf", *(["positions"] if positions else [])])
        first = last


def _postings(docs: DataFrame, id_column: str, text: str, stemmed: bool, positions: bool) -> DataFrame:
    """doc_id, term, tf, and positions if wanted, of each row of docs on its own; nothing is exchanged."""
    rows = docs.select(F.col(id_column).alias("doc_id"), _split(text).alias("words"))
    fields = [S.StructField("doc_id", rows.schema["doc_id"].dataType), S.StructField("term", S.StringType()), S.StructField("tf", S.LongType())]
    schema = S.StructType(fields + ([S.StructField("positions", S.ArrayType(S.IntegerType()))] if positions else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stems: dict[str, str] = {}
        for b in batches:
            yield from _counted(b.column(0), b.column(1), stemmed, positions, stems)

    return rows.mapInArrow(run, schema)


def _with_terms(words: DataFrame, stemmed: bool) -> DataFrame:
    """words with `term` for `word`; only the distinct words are stemmed."""
    if not stemmed:
        return words.withColumnRenamed("word", "term")
    stems = words.select("word").distinct().select(F.col("word").alias("__w"), _stem("word").alias("term"))
    return words.join(stems, F.col("word") == F.col("__w")).drop("word", "__w")


def index(docs: DataFrame, id_column: str = "doc_id", text: str = "text", stemmed: bool = True, positions: bool = True) -> Index:
    """The postings are written to the shared folder once, sorted by term, so that a query reads its own terms' row groups; so are lengths.

    A document's postings are made where it is read, and exchanged once, to be sorted. Ranges of (term, doc_id), as many as the words
    need, keep a frequent term's postings from being one task's. Rows of one id are one document. Positions, which phrases need, can be left out.
    """
    kept = F.size(F.filter(_split(text), lambda w: ~w.isin(sorted(T.STOPWORDS))))
    sums = docs.groupBy(F.col(id_column).alias("doc_id")).agg(F.sum(F.when(F.col(text).isNull(), 0).otherwise(kept)).alias("length"), F.count("*").alias("__rows"))
    lengths = cut(sums, "lengths")
    n, mean, words, repeated = lengths.agg(F.count("*"), F.avg("length"), F.sum("length"), F.max("__rows")).first()
    postings = _postings(docs, id_column, text, stemmed, positions)
    if (repeated or 0) > 1:
        offsets = [F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions")] if positions else []
        postings = postings.groupBy("doc_id", "term").agg(F.sum("tf").alias("tf"), *offsets)
    postings = postings.repartitionByRange(max(1, -(-(words or 0) // _WORDS_SORTED)), "term", "doc_id").sortWithinPartitions("term", "doc_id")
    return Index(cut(postings, "postings"), lengths.select("doc_id", "length"), stemmed, n, mean or 0.0)


def save(ix: Index, path: str) -> None:
    """The index as a folder, to be loaded for later queries."""
    ix.postings.write.parquet(f"{path}/postings")
    ix.docs.withColumn("stemmed", F.lit(ix.stemmed)).write.parquet(f"{path}/docs")


def load(spark: SparkSession, path: str) -> Index:
    docs = spark.read.parquet(f"{path}/docs")
    n, mean, stemmed = docs.agg(F.count("*"), F.avg("length"), F.bool_or("stemmed")).first()
    return Index(spark.read.parquet(f"{path}/postings"), docs.select("doc_id", "length"), bool(stemmed), n, mean or 0.0)


def _matched(ix: Index, terms: list[str]) -> DataFrame:
    """Postings of the terms with df, times (of the term in the query)."""
    counts = {t: terms.count(t) for t in terms}
    hit = ix.postings.filter(F.col("term").isin(sorted(counts)))
    df = hit.groupBy(F.col("term").alias("__t")).agg(F.count("*").alias("df"))  # a row for each term of the query
    times = F.element_at(F.create_map(*[x for t, n in sorted(counts.items()) for x in (F.lit(t), F.lit(n))]), F.col("term"))
    return hit.join(F.broadcast(df), F.col("term") == F.col("__t")).withColumn("times", times).drop("__t")


def _none(ix: Index) -> DataFrame:
    return ix.docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)


def tf_idf(ix: Index, query: str, mode: str = "and") -> DataFrame:
    """(doc_id, score) by the sum of (1 + ln tf) * ln(N / df); mode and: every term, or: any. Best first, then by doc_id."""
    terms = ix.terms(query)
    if not terms:
        return _none(ix)
    scored = _matched(ix, terms).withColumn("s", F.col("times") * (1 + F.log("tf")) * F.log(F.lit(float(ix.n)) / F.col("df")))
    out = scored.groupBy("doc_id").agg(F.sum("s").alias("score"), F.count("*").alias("__terms"))
    if mode == "and":
        out = out.filter(F.col("__terms") == len(set(terms)))
    return out.select("doc_id", "score").orderBy(F.desc("score"), "doc_id")


def _bm25(ix: Index, k1: float, b: float) -> Column:
    """A term's part of a document's score, from tf, df and length."""
    idf = F.log((F.lit(float(ix.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    return idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(ix.mean or 1.0)))


def _scored(ix: Index, hit: DataFrame, k1: float, b: float) -> DataFrame:
    """(doc_id, score, terms) of postings with df; documents without a hit aren't joined."""
    return hit.join(ix.docs, "doc_id").groupBy("doc_id").agg(F.sum(_bm25(ix, k1, b)).alias("score"), F.collect_set("term").alias("terms")).filter("score > 0")


def bm25(ix: Index, query: str | list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score) of documents with a positive score, for the query's distinct terms. Best first, then by doc_id."""
    terms = sorted(set(ix.terms(query) if isinstance(query, str) else query))
    if not terms:
        return _none(ix)
    return _scored(ix, _matched(ix, terms), k1, b).select("doc_id", "score").orderBy(F.desc("score"), "doc_id")


def rank(ix: Index, query: str, ids: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(doc_id, score) of the documents in ids (doc_id), 0 for those without a term. Best first, then by doc_id."""
    wanted = ids.select(F.col("doc_id").alias("__id")).distinct()
    scores = bm25(ix, query, k1, b)
    return wanted.join(scores, F.col("__id") == F.col("doc_id"), "left").select(F.col("__id").alias("doc_id"), F.coalesce("score", F.lit(0.0)).alias("score")).orderBy(F.desc("score"), "doc_id")


def bm25_all(ix: Index, queries: DataFrame, k: int, id_column: str = "item_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents for every row of queries, by its distinct terms.

    Terms of queries are sent to all tasks if they are proven few; else they meet postings by an equality that hashes. Postings are
    exchanged once, by document, where scores are summed, and only each task's best for a query are exchanged again.
    """
    asked = _with_terms(words_of(queries, id_column, text), ix.stemmed).select(F.col("doc_id").alias("query_id"), F.col("term").alias("__term")).distinct()
    few = is_small(asked)
    sent = F.broadcast if few else lambda df: df  # few: proven small
    hit = ix.postings.select("doc_id", "term", "tf").join(sent(asked.select(F.col("__term").alias("__t")).distinct()), F.col("term") == F.col("__t"), "left_semi")
    # a row for each term that is asked for
    df = hit.groupBy(F.col("term").alias("__t")).agg(F.count("*").alias("df"))
    by_term = asked.groupBy("__term").agg(F.collect_list("query_id").alias("__asking")) if few else asked
    parts = hit.repartition("doc_id").join(ix.docs, "doc_id").join(sent(df), F.col("term") == F.col("__t")).select("doc_id", "term", _bm25(ix, k1, b).alias("s"))
    met = parts.join(sent(by_term), F.col("term") == F.col("__term"))
    met = met.select("doc_id", "s", F.explode("__asking").alias("query_id")) if few else met
    scores = met.groupBy("query_id", "doc_id").agg(F.sum("s").alias("score")).filter("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def fuzzy_terms(vocabulary: DataFrame, word: Column | str, distance: int) -> DataFrame:
    """(term, distance) of all terms within an edit distance, nearest first."""
    word = F.lit(word) if isinstance(word, str) else word
    return vocabulary.select("term", F.levenshtein("term", word).alias("distance")).filter(F.col("distance") <= distance).orderBy("distance", "term")


def fuzzy_search(ix: Index, word: str, distance: int) -> DataFrame:
    """(doc_id) of documents with any term within the distance."""
    return ix.postings.filter(F.levenshtein("term", F.lit(word), distance) >= 0).select("doc_id").distinct()


def _back_by(i: int):
    return lambda p: p - i


def phrase(ix: Index, query: str) -> DataFrame:
    """(doc_id) of documents in which the query's terms follow one another; the index must have positions."""
    terms = ix.terms(query)
    hit = ix.postings.filter(F.col("term").isin(sorted(set(terms)))).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("__at"))
    starts = None
    for i, t in enumerate(terms):
        at = F.transform(F.col("__at")[t], _back_by(i))
        starts = at if starts is None else F.array_intersect(starts, at)
    return hit.filter(F.size(starts) > 0).select("doc_id")


def ranked(ix: Index, docs: DataFrame, query: str, fuzz: int, k: int, length: int = 160, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, snippet) of the k best by BM25 over the query's terms and those within `fuzz` of one, with snippets for these k only."""
    terms = sorted(set(ix.terms(query)))
    if not terms:
        return ix.docs.select("doc_id", F.lit(0.0).alias("score"), F.lit("").alias("snippet")).limit(0)
    near = F.col("term").isin(terms)
    for t in terms if fuzz > 0 else ():
        near = near | (F.levenshtein("term", F.lit(t), fuzz) >= 0)
    hit = ix.postings.filter(near)
    df = hit.groupBy(F.col("term").alias("__t")).agg(F.count("*").alias("df"))
    top = _scored(ix, hit.join(df, F.col("term") == F.col("__t")), 1.2, 0.75).orderBy(F.desc("score"), "doc_id").limit(k)
    stemmed = ix.stemmed

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            # a document's own terms that were looked for, as they stand in its text
            surface = [[w for w in T._WORD.findall(t or "") if (T.stem(w.lower()) if stemmed else w.lower()) in set(seen)] for t, seen in zip(p["text"], p["terms"])]
            yield pd.DataFrame({"doc_id": p["doc_id"], "score": p["score"], "snippet": [T.snippet(t, s, length) for t, s in zip(p["text"], surface)]})

    joined = docs.select(F.col(id_column).alias("__id"), F.col(text).alias("text")).join(F.broadcast(top), F.col("__id") == F.col("doc_id"))  # k rows
    return joined.select("doc_id", "score", "terms", "text").mapInPandas(mark, "doc_id bigint, score double, snippet string").orderBy(F.desc("score"), "doc_id")
