"""Vector codes against a literal version, on copies, ties, odd rows and the given table."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribewell.llm import codes, queries
from tests.oracle import SF_DIR, difference

SCHEMA = "vec_id long, embedding array<float>, label int, code int, pos string, row string"


def literal(rows, parts=16, entries=64, rounds=2):
    """What the contract says, one vector after the other; rows are (vec_id, vector, label)."""
    kept = [(i, [math.floor(256 * float(x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in kept), default=0)
    width = max(1, -(-width // parts))
    cut = lambda v: [tuple((v + [0] * (width * parts - len(v)))[p * width : (p + 1) * width]) for p in range(parts)]
    kept = [(i, cut(v), label) for i, v, label in kept]
    start = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p] for r in start] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda p, part: min((apart(part, e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        groups = {}
        for _, v, _ in kept:
            for p in range(parts):
                groups.setdefault((p, best(p, v[p])[1]), []).append(v[p])
        for (p, k), own in groups.items():
            books[p][k] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    found = [[best(p, v[p]) for p in range(parts)] for _, v, _ in kept]
    errors = [sum(d for d, _ in f) for f in found]
    sums = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        sums[label] = sums.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in f), e, sums[r[2]], sha) for r, f, e in zip(kept, found, errors, strict=True)), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_same_as_sql(spark):
    assert difference(spark, queries.op11_vector_codes, queries.oracle_sql()["op11_vector_codes"]) == ""


def test_same_as_literal_with_copies_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 32) / 64], int(rng.integers(3)) or None) for i in range(300)]
    rows += [(1000 + i, [0.5] * 32, 1) for i in range(200)]  # over a third are equal
    df = spark.createDataFrame([(i, v, label, 1, "x", "y") for i, v, label in rows], SCHEMA).repartition(5)
    assert rows_of(codes.compress(df)) == literal(rows)
    assert rows_of(codes.compress(df, parts=8, entries=5, rounds=4)) == literal(rows, 8, 5, 4)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1] * 16, 1), (1, [0.2] * 16, 2), (1, [0.2] * 16, 2), (None, [0.3] * 16, None), (2, None, 1), (3, [0.1, None] + [0.0] * 14, 1)]
    rows += [(4, [nan] * 16, 1), (5, [inf] * 16, None), (6, [-0.001] * 16, None), (7, [], 2), (8, [0.5] * 5, 2)]
    df = spark.createDataFrame([(i, v, label, 1, "x", "y") for i, v, label in rows], SCHEMA)
    found = rows_of(codes.compress(df))
    assert [r[0] for r in found] == [1, 1, 1, 6, 7, 8, None]
    assert found == literal([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows])


def test_large_components_and_empty_tables(spark):
    df = spark.createDataFrame([(1, [1e30] * 16, 1, 1, "x", "y"), (2, [-1e30] * 16, 1, 1, "x", "y")], SCHEMA)
    assert [(r[0], r[1], r[2]) for r in rows_of(codes.compress(df))] == [(1, "00" * 16, 0), (2, "01" * 16, 0)]
    none = codes.compress(df.where("false"))
    assert none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and none.count() == 0
    with pytest.raises(ValueError):
        codes.compress(df, entries=257)


def test_many_labels_and_hot_parts(spark):
    df = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    more = df.unionByName(df.withColumn("vec_id", F.col("vec_id") + 10_000).withColumn("embedding", F.array_repeat(F.lit(0.25).cast("float"), 64)))
    rows = [(r["vec_id"], list(r["embedding"]), r["label"]) for r in more.collect()]
    assert rows_of(codes.compress(more, entries=8, rounds=1)) == literal(rows, 16, 8, 1)
