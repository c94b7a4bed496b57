"""Phrase mining against a literal version, on hot phrases, repeats, odd rows, words beyond the list and the given table."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribewell.llm import phrases, queries
from tests.oracle import SF_DIR, difference

SCHEMA = "doc_id long, text string, lang string, n long, rank string"


def literal(rows, most=4, least=30, covered=80, top=2000):
    """What the contract says, phrase by phrase; rows are (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, most + 1):
                for s in range(len(words) - m + 1):
                    f[lang, tuple(words[s : s + m])] += 1
    candidates = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    longest = {}
    for (lang, g), a in candidates.items():
        for m in range(2, len(g)):
            for s in range(len(g) - m + 1):
                longest[lang, g[s : s + m]] = max(longest.get((lang, g[s : s + m]), 0), a)
    by = {}
    for (lang, g), a in candidates.items():
        if 100 * longest.get((lang, g), 0) >= covered * a:
            continue
        score, k, left, right = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k, f[lang, g[:k]], f[lang, g[k:]]) for k in range(1, len(g)))
        by.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -score) for lang, own in by.items() for rank, (score, a, p, left, right) in enumerate(sorted(own)[:top], 1))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_same_as_sql(spark):
    assert difference(spark, queries.op12_phrase_mining, queries.oracle_sql()["op12_phrase_mining"]) == ""


@pytest.fixture(scope="module")
def planted():
    """A pair in over a third of all texts, words over and over, repeated phrases, three languages and none."""
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)] + ["É", "naïve", "\x00", "\x1c"]
    fixed = [[rng.choice(words) for _ in range(rng.randrange(2, 7))] for _ in range(12)]
    out = []
    for i in range(900):
        own = []
        for _ in range(rng.randrange(0, 12)):
            own += rng.choice(fixed) if rng.random() < 0.4 else [rng.choice(words) for _ in range(rng.randrange(1, 5))]
            if rng.random() < 0.2:
                own[-1] += rng.choice([".", ", ", "\n", "\x0b", "; :", "!?"])
        if i % 2:
            own += ["Hot", "Pair"] * rng.randrange(1, 3)
        if i % 9 == 0:
            own += ["again"] * rng.randrange(2, 9)
        out.append((rng.choice([" ", "  ", "\t"]).join(own), rng.choice(["en", "en", "de", None, "und"])))
    return out


@pytest.mark.parametrize("listed", [1 << 18, 20, 0])
def test_same_as_literal(spark, planted, listed, monkeypatch):
    monkeypatch.setattr(phrases, "CHUNK_WORDS", 3000)
    df = spark.createDataFrame([(i, t, lang, 1, "x") for i, (t, lang) in enumerate(planted)], SCHEMA).repartition(5)
    expected = literal(planted)
    assert len(expected) > 50
    assert rows_of(phrases.collocations(df, listed=listed)) == expected
    assert rows_of(phrases.collocations(df, most=3, least=8, covered=60, top=7, listed=listed)) == literal(planted, 3, 8, 60, 7)


def test_hot_pivots_are_dealt_out(spark, planted, monkeypatch):
    monkeypatch.setattr(phrases, "PIVOT_FRAGMENTS", 40)
    df = spark.createDataFrame([(i, t, lang, 1, "x") for i, (t, lang) in enumerate(planted)], SCHEMA).repartition(5)
    assert rows_of(phrases.collocations(df)) == literal(planted)


def test_words_of_equal_hash(spark, planted, monkeypatch):
    """With so few hashes that most words share theirs with others, all are told apart."""
    monkeypatch.setattr(phrases, "tail_id", lambda lang, word: phrases._TAIL | (len(word) + len(lang)) % 3)
    monkeypatch.setattr(phrases, "tail_column", lambda: ((F.octet_length("word") + F.octet_length("lang")) % 3).cast("long").bitwiseOR(F.lit(phrases._TAIL)))
    df = spark.createDataFrame([(i, t, lang, 1, "x") for i, (t, lang) in enumerate(planted)], SCHEMA).coalesce(1)
    words = phrases.word_counts(df.select("lang", "text"))
    order = phrases.Order(words, 30, 10)
    assert not order.complete
    frequent = {(r["lang"], r["word"]): order.rewritten(r["lang"], [r["word"].encode()])[0] for r in words.where("n >= 30").collect()}
    assert len(set(frequent.values())) == len(frequent) and min(frequent.values()) >= 0


def test_tail_ids_are_the_same_in_columns(spark):
    rows = [("en", "word"), ("", "é"), ("und", "x" * 100)]
    found = spark.createDataFrame(rows, "lang string, word string").select("lang", "word", phrases.tail_column().alias("id")).collect()
    assert [r["id"] for r in found] == [phrases.tail_id(lang, word.encode()) for lang, word in rows]


def test_packed_fragments_come_back():
    rng = np.random.default_rng(4)
    rows, weights = phrases.fragments(rng.integers(-1, 6, 500), 4)
    words, places, back = phrases.unpacked(phrases.packed(rows, weights), 7)
    again = np.where(places >= 0, words[places], -1)
    assert Counter(zip(map(tuple, rows.tolist()), weights.tolist(), strict=True)) == Counter(zip(map(tuple, again.tolist()), back.tolist(), strict=True))


def test_odd_rows(spark, odd_documents, no_documents):
    given = [(r["text"], r["lang"]) for r in odd_documents.collect()]
    found = rows_of(phrases.collocations(odd_documents, least=2))
    assert found == literal(given, least=2) and any(r[2] == "word word word word" for r in found)
    assert phrases.collocations(no_documents).count() == 0
    # exact beyond 64 bits
    big = spark.createDataFrame([([1, 2], 9 * 10**17)], "ids array<long>, a long")
    singles = spark.createDataFrame([(1, 9 * 10**17), (2, 9 * 10**17 + 1)], "id long, n long")
    assert phrases.scored(big, singles).first()["score"] == 2_000_000 * 9 * 10**17 // (18 * 10**17 + 1)


def test_whole_table(spark):
    rows = [(r["text"], r["lang"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text", "lang").collect()]
    assert rows_of(queries.op12_phrase_mining(spark, SF_DIR)) == literal(rows)
