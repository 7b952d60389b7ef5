"""Column masks and policies, role checks, hash-chained audit logs, Merkle roots and proofs, field encryption."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mask_full(c: Column) -> Column:
    return F.when(c.isNotNull(), F.repeat(F.lit("*"), F.greatest(F.length(c), F.lit(1))))


def mask_partial(c: Column, prefix: int, suffix: int) -> Column:
    """The first and last characters stay; a text that they would show whole is masked whole."""
    n = F.length(c)
    middle = F.repeat(F.lit("*"), n - prefix - suffix)
    return F.when(n <= prefix + suffix, mask_full(c)).otherwise(F.concat(F.substring(c, 1, prefix), middle, F.right(c, F.lit(suffix)) if suffix else F.lit("")))


def mask_hash(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def mask_null(c: Column) -> Column:
    return F.lit(None).cast("string")


@dataclass(frozen=True)
class Rule:
    """How a column looks to the roles named; to all, if none is."""

    column: str
    mask: object
    roles: tuple[str, ...] = ()


def apply_policy(df: DataFrame, rules: Sequence[Rule], roles: Sequence[str]) -> DataFrame:
    """df as the roles see it: of each column the first rule that is for one of them applies."""
    chosen: dict[str, Rule] = {}
    for r in rules:
        if r.column in df.columns and (not r.roles or set(r.roles) & set(roles)):
            chosen.setdefault(r.column, r)
    return df.select(*[chosen[c].mask(F.col(c).cast("string")).alias(c) if c in chosen else F.col(c) for c in df.columns])


def _glob(pattern: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def allowed(requests: DataFrame, members: DataFrame, grants: Sequence[tuple[str, str, str]]) -> DataFrame:
    """requests (user, resource, permission) with `allowed`; members is (user, role), grants (role, resource glob, permission or *)."""
    hit = F.lit(False)
    for role, glob, permission in grants:
        right = F.lit(True) if permission == "*" else F.col("permission") == permission
        hit = hit | (F.array_contains("__roles", role) & F.col("resource").rlike(_glob(glob)) & right)
    roles = members.groupBy(F.col("user").alias("__user")).agg(F.collect_set("role").alias("__roles"))
    joined = requests.join(roles, F.col("user") == F.col("__user"), "left")
    return joined.select(*requests.columns, F.coalesce(hit, F.lit(False)).alias("allowed"))


def _content_hash(order: str, content: Sequence[str]) -> Column:
    """Of fields with their lengths before them; a null isn't an empty text, and no text can pass for two fields."""
    fields = [F.col(c).cast("string") for c in (order, *content)]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields]).cast("binary"), 256)


def _entry_hash(prev: Column, order: str, content: Sequence[str]) -> Column:
    return F.sha2(F.concat(prev, _content_hash(order, content)).cast("binary"), 256)


def chain(log: DataFrame, order: str, content: Sequence[str], segment: str) -> DataFrame:
    """log with entry_hash and prev_hash: each entry's hash covers its content and the hash of the entry before.

    A chain is made for each value of `segment`, such as a writer and day, so that
    chains are made side by side. Within a segment it can only be made one entry
    after the other; entries stream through the task in order, and it holds one
    hash. The order must be unique within a segment.
    """
    # hashes can't be compressed, so they are made after the exchange
    rows = log.repartition(segment).sortWithinPartitions(segment, order).withColumn("entry_hash", _content_hash(order, content)).withColumn("prev_hash", F.lit(""))
    schema = rows.schema

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, ""
        for b in batches:
            at, out, before = b.column(segment).to_pylist(), [], []
            for s, h in zip(at, b.column("entry_hash").to_pylist()):
                if (s,) != now:
                    now, last = (s,), ""
                before.append(last)
                last = hashlib.sha256((last + h).encode()).hexdigest()
                out.append(last)
            columns = [*b.columns[:-2], pa.array(out, b.schema.field("entry_hash").type), pa.array(before, b.schema.field("prev_hash").type)]
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return rows.mapInArrow(fold, schema)


def heads(chained: DataFrame, order: str, segment: str) -> DataFrame:
    """(segment, entries, head): the last hash of each chain, to be kept elsewhere."""
    return chained.groupBy(segment).agg(F.count("*").alias("entries"), F.max_by("entry_hash", order).alias("head"))


def broken_links(chained: DataFrame, order: str, content: Sequence[str], segment: str, anchors: DataFrame | None = None) -> DataFrame:
    """Entries whose content and prev_hash don't give their hash, or whose prev_hash isn't the hash of the entry before.

    A changed entry shows itself, or the next one if its hash was made anew, and
    so on to the head. Each entry is looked at on its own with the one before, so
    no chain is walked. anchors has (segment, anchor): the hash before the first
    entry of a pruned chain, or, of a full one, ''.
    """
    before = F.lag("entry_hash").over(Window.partitionBy(segment).orderBy(order))
    rows = chained.withColumn("__before", before)
    if anchors is not None:
        held = anchors.select(F.col(segment).alias("__segment"), "anchor")
        rows = rows.join(held, F.col(segment).eqNullSafe(F.col("__segment")), "left").withColumn("__before", F.coalesce("__before", "anchor"))
    wrong = (F.col("entry_hash") != _entry_hash(F.col("prev_hash"), order, content)) | (F.col("prev_hash") != F.coalesce("__before", F.lit("")))
    return rows.filter(F.coalesce(wrong, F.lit(True))).select(*chained.columns)


def entries(chained: DataFrame, user: object = None, resource: object = None, user_column: str = "user", resource_column: str = "resource") -> DataFrame:
    """Entries of a user, of a resource, or of both."""
    for column, wanted in ((user_column, user), (resource_column, resource)):
        if wanted is not None:
            chained = chained.filter(F.col(column) == F.lit(wanted))
    return chained


def prune(chained: DataFrame, order: str, segment: str, oldest: object) -> tuple[DataFrame, DataFrame]:
    """Entries from `oldest` on, and (segment, anchor), by which they are still verified."""
    kept = chained.filter(F.col(order) >= F.lit(oldest))
    return kept, kept.groupBy(segment).agg(F.min_by("prev_hash", order).alias("anchor"))


#: Nodes that a task makes one of, as a power of two.
_FAN = 10


def _pair(left: str, right: str) -> str:
    return hashlib.sha256((left + right).encode()).hexdigest()


def _subtree(nodes: list[str]) -> str:
    while len(nodes) > 1:
        nodes = [_pair(*nodes[k : k + 2]) if k + 1 < len(nodes) else nodes[k] for k in range(0, len(nodes), 2)]
    return nodes[0]


def _roots(nodes: DataFrame, size: int) -> DataFrame:
    """(g, h): the root of each group of nodes (g, i, h) of at most `size`, i counting from 0 in a group.

    2^_FAN nodes at a time become one within a task, so that few exchanges are
    needed, each of a thousandth of the rows before.
    """
    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("i").to_numpy())
        hashes = t.column("h").to_pylist()
        top = _subtree([hashes[k] for k in order])
        return pa.table({"g": t.column("g")[:1], "i": pa.array([t.column("i")[0].as_py() >> _FAN], pa.int64()), "h": pa.array([top], pa.string())})

    while size > 1:
        nodes = nodes.withColumn("__part", F.shiftright("i", _FAN)).groupBy("g", "__part").applyInArrow(lambda t: run(t), "g int, i bigint, h string")
        size = -(-size >> _FAN) if size % (1 << _FAN) == 0 else (size >> _FAN) + 1
    return nodes.select("g", "h")


def _leaves(leaves: DataFrame, position: str, content: str) -> DataFrame:
    return leaves.select(F.lit(0).alias("g"), F.col(position).cast("bigint").alias("i"), F.sha2(F.col(content).cast("binary"), 256).alias("h"))


def merkle_root(leaves: DataFrame, position: str, content: str) -> DataFrame:
    """(root, leaves) of the tree over contents by position, numbered from 0; an odd node at a level's end rises as it is."""
    level = _leaves(leaves, position, content)
    n = level.count()
    return _roots(level, n).select(F.col("h").alias("root"), F.lit(n).cast("bigint").alias("leaves"))


def merkle_proof(leaves: DataFrame, position: str, content: str, leaf: int) -> DataFrame:
    """(level, side, hash): the siblings of a leaf's path, from the bottom; side tells where the sibling stands.

    A leaf of the sibling's subtree at level k differs from the leaf's position in
    bit k first, so the siblings are the roots of these groups.
    """
    level = _leaves(leaves, position, content)
    n = level.count()
    if not 0 <= leaf < n:
        raise ValueError(f"there is no leaf {leaf}")
    apart = F.col("i").bitwiseXOR(F.lit(leaf).cast("bigint"))
    bit = (F.length(F.bin(apart)) - 1).cast("int")
    groups = level.filter(F.col("i") != leaf).withColumn("g", bit).withColumn("i", F.expr("i & (shiftleft(1L, g) - 1L)"))
    side = F.expr(f"if({leaf}L & shiftleft(1L, g) = 0, 'right', 'left')")
    return _roots(groups, max(1, n - 1)).select(F.col("g").alias("level"), side.alias("side"), F.col("h").alias("hash")).orderBy("level")


def merkle_verify(content: Column, proof: DataFrame) -> DataFrame:
    """(root) that a leaf's content and its proof give; a proof has a row for each level."""
    steps = proof.agg(F.array_sort(F.collect_list(F.struct("level", "side", "hash"))).alias("__steps"))
    first = F.sha2(content.cast("binary"), 256)
    up = F.aggregate("__steps", first, lambda h, s: F.sha2(F.when(s["side"] == "left", F.concat(s["hash"], h)).otherwise(F.concat(h, s["hash"])).cast("binary"), 256))
    return steps.select(up.alias("root"))


def encrypt(c: Column, key: Column | str, aad: str = "") -> Column:
    """AES-GCM, with the column's name as additional data if given."""
    return F.aes_encrypt(c.cast("binary"), F.lit(key) if isinstance(key, str) else key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(aad))


def decrypt(c: Column, key: Column | str, aad: str = "") -> Column:
    """The text again; null where the key or the data is wrong."""
    return F.try_aes_decrypt(c, F.lit(key) if isinstance(key, str) else key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(aad)).cast("string")
