"""Small tables for the tests: awkward rows of every kind."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SAMPLE = "/root/testdata/sf0.001"


def prose(n: int, seed: int) -> str:
    rng = random.Random(seed)
    parts = ["an", "er", "th", "ou", "re", "st", "in", "on", "ble", "tion", "ing", "hea", "wh"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(2, 4))) for _ in range(n))


def awkward() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    a, b = prose(80, 1), prose(60, 2)
    return [
        (1, a, "en", "x", len(a)), (2, a, "en", "x", len(a)), (2, a, "en", "x", len(a)), (3, b, None, "y", len(b)),
        (4, None, "en", "x", None), (None, b, "en", "x", len(b)), (5, "", "en", None, 0), (6, "", "de", "x", 0),
        (7, "\n\n \n", "en", "x", 4), (8, prose(60_000, 3), "en", "y", 1), (None, None, None, None, None), (9, "ß É 日本", "de", "x", 6),
    ]


def with_clashes(df):
    """Extra columns whose names operators use within or for results."""
    for name in ("shard", "shard_position", "node", "hi", "quality", "keep", "position", "count", "id", "payload", "item_id", "__again"):
        df = df.selectExpr("*", f"'{name}' as `{name}`")
    return df
