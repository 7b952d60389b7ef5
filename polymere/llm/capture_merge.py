"""Capture histories from locally sorted capture runs, by an external k-way merge.

Range bounds, pairs of URL key and time, come from a bounded sample of captures;
they only set how large a range is. Captures are sorted where they are read, each
partition being a run, and cut at the bounds into blocks, one row each, which
keep the run's order through the exchange. Where a range's blocks meet, a tree
of losers merges them by URL key, time, page and digest. The ranges' counts give
every capture its place in the global order.

A key that many captures share is cut by time, so it is no single task's. What
its later ranges must know of the earlier ones is the place of the key's first
capture, where a range always begins, and the digest of the last one before.

A URL key is the host's labels in reverse, then the path and sorted query in the
usual form of an index: no scheme, user, default port, leading www or fragment.

Defined results: a null URL has the empty host's key, `)/`; null times, ids and
digests come first, ties in all four follow in any order, repeated rows stay; an
empty table gives no rows. A page_id that is no whole number counts as null.
Captures of one key and second are merged by one task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import persist_table

#: Bytes of keys, URLs and digests of a range; a task holds a range.
RANGE_BYTES = 8 << 20
#: Captures sampled for each range, and at least.
SAMPLE_EACH, SAMPLE_LEAST = 8, 2000
FIELDS = "urlkey string, ts bigint, page_id bigint, url string, digest string, length bigint"
_SCHEMA = pa.schema([("urlkey", pa.string()), ("ts", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("length", pa.int64())])


def url_key(url: Column) -> Column:
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://", ""), r"#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    for pattern in (r"^[^@]*@", r":(80|443)$", r"^www[0-9]*\."):
        host = F.regexp_replace(host, pattern, "")
    path = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)), r"/+$", "")
    query = F.array_join(F.array_sort(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&")), "&")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


class LoserTree:
    """The least of k sorted streams at a time: a new head plays its way up against the losers of earlier games."""

    def __init__(self, streams: list[Iterator[tuple]]) -> None:
        self.streams = streams
        self.k = len(streams)
        self.heads = [next(s, None) for s in streams]
        self.loser = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        """An exhausted stream loses to any other; of equal heads the earlier stream's wins."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or x == y and a < b

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            other = self.loser[node]
            if other < 0:  # while the tree is filled, the first to come waits for its opponent
                self.loser[node] = i
                return
            if self._less(other, i):
                self.loser[node], i = i, other
            node //= 2
        self.winner = i

    def __iter__(self) -> Iterator[tuple]:
        while self.k:
            i = self.winner
            head = self.heads[i]
            if head is None:
                return
            yield head
            self.heads[i] = next(self.streams[i], None)
            self._play(i)


def captures_of(pages: DataFrame, ts: Column) -> DataFrame:
    """One index record for each page, fetched at `ts` (seconds)."""
    return pages.select(url_key(F.col("url").cast("string")).alias("urlkey"), ts.cast("bigint").alias("ts"), F.col("page_id").try_cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.md5(F.col("html").cast("binary")).alias("digest"), F.octet_length(F.col("html").cast("string")).cast("bigint").alias("length"))


def range_bounds(captures: DataFrame, range_bytes: int, sample_least: int) -> list[tuple[str, float]]:
    """Beginnings of ranges but the first, in order: a key with its time, or with -inf if the range begins with the key."""
    size = F.coalesce(F.octet_length("urlkey"), F.lit(0)) + F.coalesce(F.octet_length("url"), F.lit(0)) + 56
    rows, total = captures.agg(F.count("*"), F.sum(size)).first()
    ranges = max(1, math.ceil((total or 0) / range_bytes))
    if ranges == 1:
        return []
    share = min(1.0, max(sample_least, SAMPLE_EACH * ranges) / rows)
    some = captures.select("urlkey", "ts").filter(F.xxhash64(F.lit(17), "urlkey", "ts", "page_id") <= F.lit(int(share * 2**63) * 2 - 2**63 if share < 1 else 2**63 - 1))
    sample = sorted((k, -math.inf if t is None else float(t)) for k, t in some.distinct().collect())
    if not sample:
        return []
    at = [sample[len(sample) * i // ranges] for i in range(1, ranges)]
    times = {}
    for k, t in at:
        times.setdefault(k, set()).add(t)
    # a key within one range begins one, or lies between two; a key of more is cut by time besides
    return sorted({(k, -math.inf) for k in times} | {(k, t) for k, ts in times.items() if len(ts) > 1 for t in ts})


def merge_runs(captures: DataFrame, range_bytes: int = RANGE_BYTES, sample_least: int = SAMPLE_LEAST) -> DataFrame:
    """captures with position, capture_no and revisit, in global order of (urlkey, ts, page_id, digest).

    position counts all captures from 0, capture_no those of the same key from
    1; a revisit has the digest of the capture before.
    """
    bounds = range_bounds(captures, range_bytes, sample_least)
    context = captures.sparkSession.sparkContext
    held = context.broadcast(bounds)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of a run; bytes of UTF-8 compare as code points do."""
        keys = np.array([b[0].encode() for b in held.value], object)
        times = np.array([b[1] for b in held.value])
        parts: list[pa.RecordBatch] = []
        now = -1

        def place(key: np.ndarray, ts: np.ndarray) -> np.ndarray:
            if not len(keys):
                return np.zeros(len(key), np.int64)
            low, high = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            for k in np.unique(low[high > low]):  # a key that begins ranges: by time
                i = np.flatnonzero((low == k) & (high > low))
                high[i] = k + np.searchsorted(times[k : high[i[0]]], ts[i], "right")
            return high

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(parts, _SCHEMA)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _SCHEMA, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t)
            data = sink.getvalue().to_pybytes()
            # a name for the run that a second reading gives again
            run = hashlib.md5(data).hexdigest()
            last = {name: [t.column(name)[-1].as_py()] for name in ("ts", "page_id", "digest")}
            columns = [pa.array([now], pa.int32()), pa.array([run]), pa.array([t.num_rows], pa.int64()), pa.array(last["ts"], pa.int64()), pa.array(last["page_id"], pa.int64()), pa.array(last["digest"], pa.string()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["range", "run", "n", "last_ts", "last_page", "last_digest", "data"])

        for b in batches:
            b = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, _SCHEMA)], schema=_SCHEMA)
            if not b.num_rows:
                continue
            key = np.array([k.encode() for k in b.column("urlkey").to_pylist()], object)
            at = place(key, np.array([-np.inf if t is None else t for t in b.column("ts").to_pylist()], np.float64))
            starts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1]).astype(int)
            for s, e in zip(starts, [*starts[1:], len(at)]):
                if parts and at[s] != now:
                    yield block()
                    parts = []
                now = int(at[s])
                parts.append(b.slice(s, e - s))
        if parts:
            yield block()

    ordered = captures.sortWithinPartitions("urlkey", "ts", "page_id", "digest")  # nulls first
    blocks, _ = persist_table(ordered.mapInArrow(cut, "range int, run string, n bigint, last_ts bigint, last_page bigint, last_digest string, data binary"), "blocks")
    # the last of the blocks' last captures is the range's; nulls are the least in a maximum of structs
    last = F.max(F.struct("last_ts", "last_page", "last_digest")).alias("last")
    known = {r["range"]: r for r in blocks.groupBy("range").agg(F.sum("n").alias("n"), last).collect()}
    before, start, key_start, offsets, digest = 0, None, 0, {}, None
    for r in range(len(bounds) + 1):
        if r and bounds[r - 1][1] == -math.inf:
            start, key_start, digest = bounds[r - 1][0], before, None
        if r in known:
            # a range that goes on with a key: where the key began, and the digest before; the key itself only if it has captures
            offsets[r] = (before, start if r and bounds[r - 1][1] != -math.inf else None, before - key_start, digest)
            before += known[r]["n"]
            digest = known[r]["last"]["last_digest"]
    carried = context.broadcast(offsets)

    def stream(data: bytes) -> Iterator[tuple]:
        with pa.ipc.open_stream(data) as reader:
            for b in reader:
                for k, t, p, url, d, length in zip(*(c.to_pylist() for c in b.columns)):
                    yield (k, -math.inf if t is None else t, -math.inf if p is None else p, d or "", t, p, url, d, length)

    def merged(r: int, data: list[bytes]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[] for _ in range(9)]
        position, key, number, digest = carried.value[r]
        for k, _, _, _, t, p, url, d, length in LoserTree(_Ordered.of([stream(x) for x in data])):
            number = number + 1 if k == key else 1
            for column, v in zip(out, (position, k, t, p, url, d, length, number, number > 1 and d is not None and d == digest)):
                column.append(v)
            position, key, digest = position + 1, k, d
            if len(out[0]) == 20_000:
                yield _batch(out)
                out = [[] for _ in range(9)]
        if out[0]:
            yield _batch(out)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, data = None, []
        for b in batches:
            for r, d in zip(b.column("range").to_pylist(), b.column("data").to_pylist()):
                if r != now and data:
                    yield from merged(now, data)
                    data = []
                now = r
                data.append(d)
        if data:
            yield from merged(now, data)

    exchanged = blocks.select("range", "run", "data").repartitionById(len(bounds) + 1, "range").sortWithinPartitions("range", "run")
    return exchanged.mapInArrow(merge, f"position bigint, {FIELDS}, capture_no bigint, revisit boolean")


class _Ordered:
    """A record that compares by its first four parts only."""

    @staticmethod
    def of(streams: list[Iterator[tuple]]) -> list[Iterator[tuple]]:
        return [(_Row(x) for x in s) for s in streams]


class _Row(tuple):
    __slots__ = ()

    def __lt__(self, other: tuple) -> bool:
        return self[:4] < other[:4]

    def __eq__(self, other: object) -> bool:
        return self[:4] == other[:4]

    __hash__ = tuple.__hash__


def _batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), *_SCHEMA.types, pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["position", *_SCHEMA.names, "capture_no", "revisit"])


ORACLE_SQL = """
WITH a AS (
  SELECT page_id, url, md5(html) AS digest, strlen(html) AS length, 1704067200 + page_id % 1000 + visit * 86400 AS ts,
         regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '#.*$', '') AS rest
  FROM (SELECT page_id, url, visit, html || CASE WHEN visit = 2 AND page_id % 3 = 0 THEN '<!-- again -->' ELSE '' END AS html FROM pages, (VALUES (0), (1), (2)) v(visit))
), b AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^[^@]*@', ''), ':(80|443)$', ''), '^www[0-9]*\\.', '') AS host,
         regexp_replace(lower(regexp_extract(rest, '^[^/?]*([^?]*)', 1)), '/+$', '') AS path,
         array_to_string(list_sort(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&')), '&') AS query
  FROM a
), c AS (
  SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END
         || CASE WHEN query = '' THEN '' ELSE '?' || query END AS urlkey
  FROM b
)
SELECT row_number() OVER (ORDER BY urlkey, ts, page_id, digest) - 1 AS position, urlkey, ts, page_id, url, digest, length,
       row_number() OVER w AS capture_no, coalesce(digest = lag(digest) OVER w, false) AS revisit
FROM c WINDOW w AS (PARTITION BY urlkey ORDER BY ts, page_id, digest)
"""
