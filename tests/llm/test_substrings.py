"""Substring dedup against a literal version, on hot passages, copies, odd rows and the given table."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from scribewell.llm import queries, substrings
from tests.oracle import SF_DIR, difference


def literal(rows, window=13):
    """(key, n_words, n_removed, kept) as the contract says, window by window; rows are (key, text)."""
    order = lambda k: (k is None, k or 0)
    split = [(key, (text or "").encode().split()) for key, text in rows]
    first = {}
    for key, words in split:
        for a in range(len(words) - window + 1):
            run = tuple(words[a : a + window])
            first[run] = min(first.get(run, order(key)), order(key))
    out = []
    for key, words in split:
        gone = set()
        for a in range(len(words) - window + 1):
            if first[tuple(words[a : a + window])] < order(key):
                gone |= set(range(a, a + window))
        out.append((key, len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out, key=str)


def rows_of(df, key="doc_id"):
    return sorted((tuple(r) for r in df.select(key, "n_words", "n_removed", "kept").collect()), key=str)


def test_same_as_sql(spark):
    assert difference(spark, queries.op13_substring_dedup, queries.oracle_sql()["op13_substring_dedup"]) == ""


@pytest.fixture(scope="module")
def planted():
    """A passage in over a third of all texts, copies, near copies, a common phrase with many ways on, and texts of one word over and over."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    passage, phrase, base = some(40), some(6), some(90)
    out = []
    for i in range(300):
        own = some(rng.randrange(0, 80))
        if i % 3 == 0:
            own = own[:5] + passage[rng.randrange(3) : 40 - rng.randrange(3)] + own[5:]
        elif i % 3 == 1:
            own = own[:9] + phrase + own[9:]
        elif i % 5 == 0:
            own = [w if rng.random() > 0.02 else "other" for w in base]
        elif i % 7 == 0:
            own = ["same"] * rng.randrange(10, 60)
        out.append((rng.randrange(10_000), " ".join(own)))
    return out


@pytest.mark.parametrize(("window", "seed"), [(13, 5), (13, 13), (8, 1), (5, 3)])
def test_same_as_literal(spark, planted, window, seed, monkeypatch):
    monkeypatch.setattr(substrings, "HOT_SHARE", 1 / 50)
    df = spark.createDataFrame(planted, "doc_id long, text string").repartition(6)
    assert rows_of(substrings.cut_repeats(df, window=window, seed=seed)) == literal(planted, window)


def test_a_full_filter_changes_nothing(spark, planted, monkeypatch):
    monkeypatch.setattr(substrings, "BITS_MOST", 1 << 16)
    monkeypatch.setattr(substrings, "BITS_EACH", 1)
    df = spark.createDataFrame(planted, "doc_id long, text string").repartition(6)
    assert rows_of(substrings.cut_repeats(df)) == literal(planted)


def test_odd_rows(spark, odd_documents, no_documents):
    cut = substrings.cut_repeats(odd_documents.withColumn("kept", F.lit(3)))
    given = [(r["doc_id"], r["text"]) for r in odd_documents.collect()]
    # with a window of three, so that short texts meet as well
    assert rows_of(cut) == literal(given)
    assert rows_of(substrings.cut_repeats(odd_documents, window=3, seed=2)) == literal(given, 3)
    assert set(cut.columns) == {*odd_documents.columns, "n_words", "n_removed", "removed", "kept"}
    assert substrings.cut_repeats(no_documents).count() == 0
    with pytest.raises(ValueError):
        substrings.cut_repeats(odd_documents, seed=14)


def test_null_and_equal_keys(spark):
    same = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(None, same), (None, same), (5, same), (5, same), (9, same + " more")], "doc_id long, text string")
    found = {(r["doc_id"], r["n_removed"]) for r in substrings.cut_repeats(df).collect()}
    assert found == {(None, 20), (5, 0), (9, 20)}


def test_removed_spans(spark):
    a, b = [f"a{i}" for i in range(15)], [f"b{i}" for i in range(14)]
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, "x " + " ".join(a) + " y z " + " ".join(b[:13]))], "doc_id long, text string")
    row = substrings.cut_repeats(df).where("doc_id = 3").first()
    assert [(s["start"], s["end"]) for s in row["removed"]] == [(1, 16), (18, 31)] and row["kept"] == "x y z"


def test_query_digest(spark):
    found = {r["doc_id"]: r["kept_sha256"] for r in queries.op13_substring_dedup(spark, SF_DIR).collect()}
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    assert found == {k: hashlib.sha256(kept.encode()).hexdigest() for k, _, _, kept in literal(texts)}
