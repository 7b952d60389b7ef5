"""SimHash near-duplicates through an inverted index of byte positions, with count filtering.

A text's fingerprint has 128 bits, 16 bytes. Its features are the distinct words
of the lowered text. Two fingerprints within `distance` bits share positional
bytes: a byte that differs in e bits counts t + 1 - e, or nothing below 0, where
t = distance // 16 is the tolerance, and the counts of all 16 positions add up
to 16 * (t + 1) - distance at least, as each differing bit takes one away. For 21
bits that is a tally of 11, where an equal byte counts two and one that is one
bit off counts one. Pairs of an entry of the index are tallied, pairs below this
guaranteed minimum go, and the rest are verified by their Hamming distance. Of
pairs that meet by chance in an entry nearly all fail the tally.

A list of one byte at one position would hold 1/256 of the corpus, and its pairs
would grow with the square of the corpus. Entries are therefore combinations.
Triples of positional bytes, within each half of the positions, hold every pair
that shares five bytes (11 bits). Masks hold all that are further apart: the bits
form three blocks, of which one has at most 7, 6 or 6 of 21 differing bits
(8 + 7 + 7 > 21). In a block that may differ in t bits each bit has a vector of
t + 1 bits, and each of the 2^(t + 1) - 1 vectors but 0 is a mask of the bits whose
vectors have an odd product with it. The vectors of t bits have a common
orthogonal one, and its mask holds none of these bits: every pair within
`distance` is equal under at least one of the 509 masks (for 21), each of about
21 bits. So no pair within `distance` is missed; tests hold that against brute
force over all pairs, and against SQL over the fingerprints.

The index isn't sent anywhere. Distinct fingerprints are dealt to chunks, each
task holds two chunks and a share of the entries, and sorts its fingerprints by
one entry at a time. What a task holds is bounded whatever the skew: a group of
near copies, however large, is cut by the chunks as all else is, and exact copies
are one fingerprint.

Duplicate pairs form groups (connected components); of each the document with
the least doc_id stays.

Defined results: rows with null doc_id or null text are in no group. A text
without words has itself as its only feature, so that empty texts are copies of
one another. Rows of one doc_id are one document, whatever their texts. Other
columns aren't touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, persist_table, text_slices
from .words import find_words, mix

BYTES = 16
DISTANCE = 21
#: Distinct fingerprints of a chunk; a task holds two chunks, of 24 bytes a fingerprint.
CHUNK = 1_000_000
#: Tasks that share the entries of a pair of chunks, if there are many pairs, and tasks in all at least.
GROUPS, TASKS = 4, 12
#: First bit of each block of hi and lo, and of the end.
_BLOCKS = (0, 43, 86, 128)
#: Ids of this many duplicates are sent to every executor (16 bytes each); more are joined by an exchange.
HELD_IDS = 2_000_000
#: This many edges (16 bytes each) are connected by the driver; more by rounds of joins, with equal result.
HELD_EDGES = 2_000_000
TRIPLES = [t for base in (0, 8) for t in combinations(range(base, base + 8), 3)]
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int32)


def fingerprints_of(texts: pa.Array) -> np.ndarray:
    """One row of 16 bytes for each text; nulls count as empty."""
    out = np.zeros((len(texts), BYTES), np.uint8)
    for first, end, data, offsets in text_slices(pc.utf8_lower(texts)):
        w = find_words(data, offsets)
        order = np.lexsort((w.hash, w.text))
        text, feature = w.text[order], w.hash[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])
        text, feature = text[new], feature[new]
        counts = np.bincount(text, minlength=end - first)
        bits = np.concatenate([feature[:, None], mix(feature ^ np.uint64(0x5851F42D4C957F2D))[:, None]], axis=1)
        has = counts > 0
        if len(text):
            starts = np.concatenate([[0], np.cumsum(counts)[:-1]])[has]
            sums = np.empty((len(starts), BYTES * 8), np.int32)
            flat = np.ascontiguousarray(bits).view(np.uint8).reshape(len(text), BYTES)
            for k in range(BYTES):  # a byte column at a time stays in cache
                sums[:, 8 * k : 8 * k + 8] = np.add.reduceat(np.take(_BITS, flat[:, k], axis=0), starts, axis=0)
            out[first:end][has] = np.packbits(2 * sums > counts[has][:, None], axis=1)
        for i in np.flatnonzero(~has):
            h = np.uint64(0x2545F4914F6CDD1D)
            for b in data[offsets[i] : offsets[i + 1]]:
                h = mix(np.array([h ^ np.uint64(b)]))[0]
            out[first + i] = np.array([h, mix(np.array([h]))[0]]).view(np.uint8)
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words = fingerprints_of(b.column("text")).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words[:, 0].copy()), pa.array(words[:, 1].copy())], ["doc_id", "hi", "lo"])


def guaranteed(distance: int) -> int:
    """The least tally of two fingerprints within `distance` bits."""
    return BYTES * (distance // BYTES + 1) - distance


@lru_cache
def _points(tolerance: int) -> np.ndarray:
    """What a byte counts, by its exclusive or."""
    return np.maximum(tolerance + 1 - np.bitwise_count(np.arange(256, dtype=np.uint8)).astype(np.int16), 0).astype(np.uint8)


def tally(x: np.ndarray, tolerance: int) -> np.ndarray:
    """Shared positional bytes of pairs, from the exclusive or of their fingerprints, (n, 2) words."""
    return _points(tolerance)[np.ascontiguousarray(x).view(np.uint8).reshape(len(x), BYTES)].sum(axis=1, dtype=np.uint16)


def near(hi: np.ndarray, lo: np.ndarray, hi2: np.ndarray, lo2: np.ndarray, distance: int) -> np.ndarray:
    """Count filter, then verification, of pairs of fingerprints."""
    shape = np.broadcast_shapes(hi.shape, hi2.shape)
    x = np.empty((*shape, 2), np.int64)
    np.bitwise_xor(hi, hi2, out=x[..., 0])
    np.bitwise_xor(lo, lo2, out=x[..., 1])
    x = x.reshape(-1, 2)
    ok = tally(x, distance // BYTES) >= guaranteed(distance)
    ok[ok] = np.bitwise_count(x[ok].view(np.uint64)).sum(axis=1) <= distance
    return ok.reshape(shape)


def links(entry: np.ndarray, node: np.ndarray, hi: np.ndarray, lo: np.ndarray, distance: int, short: int = 64, label: np.ndarray | None = None) -> np.ndarray:
    """Pairs (n, 2) of nodes which connect whatever near pairs within lists of equal entry connect; nodes of one label are connected already.

    Short lists give all near pairs across labels. Of a long one the label of the
    fewest nodes is tried against all others, and then is either done with or
    joins what it is near to: a list of n copies takes a step or two, and not
    n * n / 2 rows.
    """
    order = np.argsort(entry, kind="stable")
    entry, node, hi, lo = entry[order], node[order], hi[order], lo[order]
    of = np.arange(len(entry)) if label is None else label[order]
    edge = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
    length = np.diff(np.append(edge, len(entry)))
    found: list[np.ndarray] = []
    some = (length > 1) & (length <= short)
    rows = np.repeat(edge[some], length[some])
    ends = rows + np.repeat(length[some], length[some])
    at = rows + (np.arange(len(rows)) - np.repeat(np.concatenate([[0], np.cumsum(length[some])[:-1]]), length[some])) if len(rows) else rows
    for lag in range(1, short):
        inside = at + lag < ends
        if not inside.any():
            break
        i = at[inside]
        i = i[of[i] != of[i + lag]]
        ok = i[near(hi[i], lo[i], hi[i + lag], lo[i + lag], distance)]
        found.append(np.stack([node[ok], node[ok + lag]], axis=1))
    for start, n in zip(edge[length > short], length[length > short]):
        found += _long_links(node[start : start + n], hi[start : start + n], lo[start : start + n], of[start : start + n], distance)
    if not found:
        return np.zeros((0, 2), np.int64)
    pairs = np.sort(np.concatenate(found), axis=1)
    return np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)


def _long_links(node: np.ndarray, hi: np.ndarray, lo: np.ndarray, label: np.ndarray, distance: int, most: int = 1 << 20) -> Iterator[np.ndarray]:
    """links of one list."""
    _, label = np.unique(label, return_inverse=True)
    size = np.bincount(label)
    left = np.arange(len(node))
    while True:
        alive = np.flatnonzero(size)
        if len(alive) < 2:
            return
        least = alive[size[alive].argmin()]
        mine, left = left[label[left] == least], left[label[left] != least]
        step = max(1, most // len(left))
        for k in range(0, len(mine), step):
            i = mine[k : k + step]
            x, y = np.nonzero(near(hi[i][:, None], lo[i][:, None], hi[left], lo[left], distance))
            if len(x):
                # one pair for each label that is near is enough
                near_to, first = np.unique(label[left[y]], return_index=True)
                yield np.stack([node[i[x[first]]], node[left[y[first]]]], axis=1)
                size[near_to[0]] += size[near_to[1:]].sum() + len(mine)
                size[near_to[1:]] = 0
                label[left[np.isin(label[left], near_to)]] = near_to[0]
                label[mine] = near_to[0]
                left = np.concatenate([left, mine])
                break
        size[least] = 0


@lru_cache
def masks(distance: int) -> list[tuple[int, int]]:
    """(block, mask of its bits): fingerprints within `distance` are equal under at least one."""
    out = []
    each, more = divmod(distance - len(_BLOCKS) + 2, len(_BLOCKS) - 1)
    for block, (first, end) in enumerate(zip(_BLOCKS, _BLOCKS[1:])):
        least = each + (block >= len(_BLOCKS) - 1 - more)
        if least < 0:
            continue  # the other blocks have one of few enough bits
        n = end - first
        by = np.arange(1, 2 ** (least + 1))
        tries = []
        for seed in range(100):  # of some choices that with the fewest pairs by chance
            rng = np.random.default_rng(seed)
            vectors = rng.choice(by, n, replace=len(by) < n)
            odd = np.bitwise_count(by[:, None] & vectors) & 1
            tries.append((float((0.5 ** odd.sum(axis=1)).sum()), seed, odd))
        odd = min(tries, key=lambda t: t[:2])[2].astype(np.uint64)
        out += [(block, int(m)) for m in (odd << np.arange(n, dtype=np.uint64)).sum(axis=1)]
    return out


def _block(hi: np.ndarray, lo: np.ndarray, block: int) -> np.ndarray:
    first, n = _BLOCKS[block], _BLOCKS[block + 1] - _BLOCKS[block]
    hi, lo = hi.view(np.uint64), lo.view(np.uint64)
    bits = hi >> np.uint64(first) if first < 64 else lo >> np.uint64(first - 64)
    if first < 64 < first + n:
        bits = bits | lo << np.uint64(64 - first)
    return bits & np.uint64(2**n - 1)


def _merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after those of a and of b have become one."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        root = np.arange(len(label))
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
        label = root[label]


@lru_cache
def entries(distance: int) -> list[tuple[int, int]]:
    """(block, mask of its bits): triples of positional bytes, of hi (3) or lo (4), then masks."""
    triples = [(3 + t[0] // 8, sum(255 << 8 * (p % 8) for p in t)) for t in TRIPLES]
    return triples + masks(distance)


def entry_links(node: np.ndarray, hi: np.ndarray, lo: np.ndarray, group: int, groups: int, distance: int) -> np.ndarray:
    """Near pairs (n, 2) of nodes which connect whatever near pairs that share an entry of the group connect."""
    n = len(node)
    low = np.uint64(max(1, n.bit_length()))
    label, found, held = np.arange(n), [np.zeros((0, 2), np.int64)], None
    for block, mask in entries(distance)[group::groups]:
        if held is None or held[0] != block:
            held = block, _block(hi, lo, block) if block < 3 else (hi, lo)[block - 3].view(np.uint64)
        # a hash of the entry above, the row below: what has equal hashes by chance is tallied as all is
        ranked = np.sort(mix(held[1] & np.uint64(mask)) >> low << low | np.arange(n, dtype=np.uint64))
        row, key = (ranked & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64), ranked >> low
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        of = label[row]
        open_ = np.minimum.reduceat(of, start) != np.maximum.reduceat(of, start)  # else all are connected by now
        if not open_.any():
            continue
        length = np.diff(np.append(start, n))
        some = np.repeat(open_, length)
        row, entry = row[some], np.repeat(np.arange(len(start)), length)[some]
        p = links(entry, row, hi[row], lo[row], distance, label=label[row])
        p = p[label[p[:, 0]] != label[p[:, 1]]]
        if len(p):
            label = _merged(label, p[:, 0], p[:, 1])
            found.append(node[p])
    return np.concatenate(found)


def indexed_pairs(nodes: DataFrame, distance: int) -> DataFrame:
    """(a, b): near pairs which connect whatever nodes (node, hi, lo) within `distance` connect."""
    chunks = max(1, -(-nodes.count() // CHUNK))
    pairs = max(1, chunks * (chunks - 1) // 2)
    groups = max(GROUPS, -(-TASKS // pairs))
    # a fingerprint goes to each pair that its chunk is of: pairs are numbered by the lesser chunk, then by the greater
    sent = nodes.select("node", "hi", "lo", F.pmod(F.xxhash64("hi", "lo"), F.lit(chunks)).alias("c"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("d"))
    if chunks > 1:
        low, high = F.least("c", "d"), F.greatest("c", "d")
        sent = sent.filter("c <> d").withColumn("pair", F.shiftright(low * (2 * chunks - 1 - low), 1) + high - low - 1)
    else:
        sent = sent.withColumn("pair", F.lit(0))
    sent = sent.select("node", "hi", "lo", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "pair").select("node", "hi", "lo", (F.col("pair") * groups + F.col("g")).cast("int").alias("task"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            node, hi, lo = (t.column(c).to_numpy() for c in ("node", "hi", "lo"))
            p = entry_links(node, hi, lo, held[0].column("task")[0].as_py() % groups, groups, distance)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0].copy()), pa.array(p[:, 1].copy())], ["a", "b"])

    return sent.repartitionById(groups * pairs, "task").mapInArrow(run, "a bigint, b bigint")


def connected(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (n, 2), and the least node of each one's component."""
    names, at = np.unique(edges, return_inverse=True)
    at = at.reshape(-1, 2)
    return names, names[_merged(np.arange(len(names)), at[:, 0], at[:, 1])]


def components(edges: DataFrame, held: int = HELD_EDGES) -> DataFrame:
    """(node, root) for each node of edges (a, b) whose component has a lesser node, its root.

    Up to `held` edges are connected at once. More are by alternating large-star
    and small-star steps, whose rounds grow with the logarithm of the component
    size; least neighbours are aggregated before they are exchanged and then
    joined, so that a node of very many edges is no single task's.
    """
    spark = edges.sparkSession
    now, path = persist_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    if now.count() <= held:
        t = now.toArrow()
        node, root = connected(np.stack([t.column(c).to_numpy() for c in "ab"], axis=1).astype(np.int64))
        some = node != root
        drop_table(spark, path)
        return spark.createDataFrame(pa.table({"node": node[some], "root": root[some]}), "node bigint, root bigint")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(pmod(xxhash64(b, a), 1000003))")).first())

    def with_least(df: DataFrame) -> DataFrame:
        return df.join(df.groupBy("a").agg(F.min("b").alias("m")), "a")

    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both).filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).filter("a <> b").distinct()
        oriented = with_least(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        small = oriented.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        after_df, after_path = persist_table(small, "edges")
        after = state(after_df)
        drop_table(spark, path)
        now, path = after_df, after_path
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, kept_id, group_size) of each document that has a near-duplicate with a lesser doc_id.

    Copies are counted, not listed: fingerprints are aggregated before they are
    exchanged, and what is found of them is joined to the documents.
    """
    rows = docs.select(F.col("doc_id").try_cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    prints, _ = persist_table(rows.mapInArrow(_fingerprint, "doc_id bigint, hi bigint, lo bigint"), "prints")
    both = prints.groupBy("doc_id").agg(F.min(F.struct("hi", "lo")).alias("f"), F.max(F.struct("hi", "lo")).alias("g"))
    ids, _ = persist_table(both.select("doc_id", F.col("f.hi").alias("hi"), F.col("f.lo").alias("lo"), (F.col("f") != F.col("g")).alias("more")), "ids")
    one, again = ids.select("doc_id", "hi", "lo", F.lit(1).cast("bigint").alias("n")), None
    if not ids.filter("more").isEmpty():
        # a doc_id that was read with several texts is one document, so its fingerprints' nodes belong together
        first = ids.filter("more").select("doc_id", F.col("hi").alias("hi1"), F.col("lo").alias("lo1"))
        again, _ = persist_table(prints.join(first, "doc_id").filter("hi <> hi1 or lo <> lo1").distinct(), "again")
        one = one.unionByName(again.select("doc_id", "hi", "lo", F.lit(0).cast("bigint").alias("n")))
    nodes, _ = persist_table(one.groupBy("hi", "lo").agg(F.min("doc_id").alias("node"), F.sum("n").alias("n")), "nodes")
    pairs = indexed_pairs(nodes, distance)
    if again is not None:
        a, b = (nodes.select(F.col("hi").alias(f"hi{k}"), F.col("lo").alias(f"lo{k}"), F.col("node").alias(x)) for k, x in ((1, "a"), (2, "b")))
        pairs = pairs.unionByName(again.withColumnsRenamed({"hi": "hi2", "lo": "lo2"}).join(a, ["hi1", "lo1"]).join(b, ["hi2", "lo2"]).select("a", "b"))
    of = nodes.join(components(pairs), "node", "left").select("hi", "lo", "n", F.coalesce("root", "node").alias("kept_id"))
    groups, _ = persist_table(of.groupBy("kept_id").agg(F.sum("n").alias("group_size")).filter("group_size > 1"), "groups")
    return ids.join(of.join(groups, "kept_id"), ["hi", "lo"]).filter("doc_id <> kept_id").select("doc_id", "kept_id", "group_size")


def deduplicate(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs without near-duplicates: the least doc_id of each group stays, once; rows of null doc_id or text stay."""
    gone, _ = persist_table(near_duplicates(docs, distance).select(F.col("doc_id").alias("__gone")), "gone")
    if gone.count() <= HELD_IDS:
        gone = F.broadcast(gone)
    ident = docs["doc_id"].try_cast("bigint")
    left = docs.join(gone, ident == gone["__gone"], "left_anti")
    repeated = docs.filter("doc_id is not null and text is not null").groupBy(F.col("doc_id").alias("__again")).count().filter("count > 1").select("__again")
    repeated, path = persist_table(repeated, "repeated")
    if repeated.isEmpty():
        drop_table(docs.sparkSession, path)
        return left
    rest = left.join(repeated, left["doc_id"] == repeated["__again"], "left_anti")
    text_less = left.join(repeated, left["doc_id"] == repeated["__again"], "left_semi")
    return rest.union(text_less.filter("text is not null").dropDuplicates(["doc_id"])).union(text_less.filter("text is null"))
