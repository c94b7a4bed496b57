"""Sharding, mixing, near-dedup, both vector searches and the pipeline against brute force and on odd rows."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scribewell.llm import ann, mixing, queries, sharding, simhash, topk
from tests.oracle import SF_DIR, connect, difference


@pytest.fixture(scope="module")
def documents():
    return connect().execute("SELECT doc_id, text, lang, source FROM documents ORDER BY 1").fetchall()


# --- sharding


def check_shards(rows, texts, shards):
    loads, places = Counter(), defaultdict(list)
    for r in rows:
        loads[r["shard"]] += r["size"]
        places[r["shard"]].append(r["slot"])
    for own in places.values():
        assert sorted(own) == list(range(len(own)))
    assert set(loads) <= set(range(shards))
    return loads


def test_shards_of_the_table(spark, documents):
    rows = queries.op1_sharding(spark, SF_DIR).collect()
    texts = {d[0]: (d[1] or "").encode() for d in documents}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in texts.items()}
    loads = check_shards(rows, texts, 16)
    assert len(loads) == 16 and max(loads.values()) - min(loads.values()) <= 0.02 * max(loads.values())


def test_shards_of_odd_rows(odd_documents, no_documents):
    rows = sharding.shard(odd_documents, 3).collect()
    assert len(rows) == 11
    check_shards(rows, None, 3)
    assert {(r["size"], r["text_crc32"]) for r in rows if r["doc_id"] in (3, 4)} == {(1, 0)}
    assert sharding.shard(no_documents, 3).count() == 0


def test_a_hot_key_is_split(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("x" * 50).alias("text"))
    loads = check_shards(sharding.shard(df, 8).collect(), None, 8)
    assert max(loads.values()) < 1.1 * min(loads.values())


def test_slot_maps(spark, tmp_path):
    rng = np.random.default_rng(2)
    sizes = {s: int(n) for s, n in enumerate(rng.integers(1, 1000, 500))}
    one = sharding.SlotMap.of(sizes, 5)
    assert max(one.loads()) < 1.02 * min(one.loads())
    two = one.grown()
    moved = {s for s in sizes if one.shard_of[s] != two.shard_of[s]}
    assert moved and all(two.shard_of[s] == 5 for s in moved)
    assert max(two.loads()) < 1.05 * min(two.loads())
    changed = {s: n * (3 if one.shard_of[s] == 0 else 1) for s, n in sizes.items()}
    three = one.rebalanced(changed)
    assert max(three.loads()) < 1.1 * min(three.loads())
    assert sum(three.shard_of[s] != one.shard_of[s] for s in sizes) < 0.5 * len(sizes)
    path = str(tmp_path / "map")
    assert sharding.SlotMap.load(spark, path) is None
    one.save(spark, path)
    two.save(spark, path)
    assert sharding.SlotMap.load(spark, path) == two
    assert sharding.SlotMap.load(spark, path, version=1) == one
    with pytest.raises(Exception, match="exists|EXISTS"):
        two.save(spark, path)


def test_an_edited_map_moves_the_rows_of_its_moved_slots(spark, tmp_path):
    """Two runs give versions 1 and 2; between them only rows of entries that the second map moves change shards, also after growth and in split slots."""
    path = str(tmp_path / "map")
    rows = [(7 if i < 300 else i, f"text {i} " * (1 + i % 9)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    more = df.unionByName(spark.createDataFrame([(9000 + i, "another text " * 30) for i in range(300)], "doc_id long, text string"))
    before = {(r["doc_id"], r["text_crc32"], r["size"]): r["shard"] for r in sharding.shard(df, 4, map_path=path).collect()}
    after = sharding.shard(more, 5, map_path=path).collect()
    one, two = (sharding.SlotMap.load(spark, path, version=v) for v in (1, 2))
    assert sharding.SlotMap.load(spark, path) == two and (one.shards, two.shards) == (4, 5) and one.ways == two.ways and one.ways
    loads = check_shards(after, None, 5)
    assert max(loads.values()) < 1.1 * min(loads.values())
    # entries of the rows that both runs place
    base = sharding.entered(sharding.sized(df), one.ways, sharding.part_most(one.bytes_of, 4) / 2, one.slots)
    entry = {(r["key"], r["text_crc32"], r["size"]): r["entry"] for r in base.collect()}
    now = {(r["doc_id"], r["text_crc32"], r["size"]): r["shard"] for r in after}
    assert {k for k in before if before[k] != now[k]} == {k for k, e in entry.items() if one.shard_of[e] != two.shard_of[e]}
    assert 0 < sum(before[k] != now[k] for k in before) < 0.6 * len(before)
    # another layout of the same rows, the same shards
    again = sharding.placed(sharding.sized(df.repartition(7, "text")), one).collect()
    assert {(r["key"], r["text_crc32"], r["size"]): r["shard"] for r in again} == before


def test_a_stored_map_follows_a_hot_slot_that_grows(spark, tmp_path):
    path = str(tmp_path / "map")
    rows = [(i + 10, f"text {i} " * 10) for i in range(4000)]
    hot = [(7, f"hot {i} " * 10) for i in range(6000)]
    shape = "doc_id long, text string"
    first = sharding.shard(spark.createDataFrame(rows + hot[:60], shape), 8, map_path=path).collect()
    second = sharding.shard(spark.createDataFrame(rows + hot, shape), 8, map_path=path).collect()
    one, two = (sharding.SlotMap.load(spark, path, version=v) for v in (1, 2))
    assert max(two.ways.values()) > 8 * max(one.ways.values(), default=1)
    loads = check_shards(second, None, 8)
    assert max(loads.values()) <= 1.05 * sum(loads.values()) / 8
    # and again, where the slot is split already: old parts stay parts
    third = sharding.shard(spark.createDataFrame(rows + hot + [(7, f"more {i} " * 10) for i in range(12_000)], shape), 8, map_path=path).collect()
    three = sharding.SlotMap.load(spark, path, version=3)
    slot = max(two.ways, key=two.ways.get)
    assert three.ways[slot] % two.ways[slot] == 0 and three.ways[slot] > two.ways[slot]
    loads = check_shards(third, None, 8)
    assert max(loads.values()) <= 1.05 * sum(loads.values()) / 8
    # rows of entries that didn't move stay
    assert sum(one.shard_of[e] == two.shard_of.get(e) for e in one.shard_of) > 0.4 * len(one.shard_of)
    where = lambda rows: {(r["doc_id"], r["text_crc32"]): r["shard"] for r in rows}
    a, b = where(first), where(second)
    assert sum(a[k] == b[k] for k in a) > 0.4 * len(a)


# --- mixing


def test_mix_is_the_sql(spark):
    assert difference(spark, queries.op8_mixing, queries.oracle_sql()["op8_mixing"]) == ""


def targets(sizes, weights, total, most=2.0):
    """Budgets one source after the other: those that would be over their limit get it, and the others share what is left."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        per = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if per * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = per * weights[i]
            break
        for i in full:
            out[i] = most * sizes[i]
            left -= out[i]
            open_.remove(i)
    return out


@pytest.mark.parametrize(("sizes", "weights", "share"), [([100, 100, 100], (3, 1, 2), 1.5), ([0, 10], (1, 1), 1.5), ([], (3, 1, 2), 1.5), ([5, 1, 1, 1], (1, 9), 1.9), ([10, 20, 30], (1,), 3.0), ([7], (2,), 0.5)])
def test_budgets(spark, sizes, weights, share):
    rows = [(None if i == 1 else f"s{i}", n, 1) for i, n in enumerate(sizes)]
    order = sorted(range(len(sizes)), key=lambda i: (i == 1, i))
    sources = mixing.written(spark.createDataFrame(rows, "source string, s long, n long"), "sources")
    got = {r["source"]: r["target"] for r in mixing.budgets(sources, weights, share, 2.0).collect()}
    want = targets([sizes[i] for i in order], [weights[k % len(weights)] for k in range(len(order))], share * sum(sizes))
    assert got == {rows[i][0]: pytest.approx(want[k]) for k, i in enumerate(order)}


def test_many_sources_are_not_broadcast(spark, monkeypatch):
    from scribewell.llm import common

    monkeypatch.setattr(common, "BROADCAST_ROWS", 100)
    rows = [(i, "w " * (1 + i * i % 50), f"source {i % 700}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(df)
    found = mixed.collect()
    sizes = {}
    for r in found:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    names = sorted(sizes)
    want = dict(zip(names, targets([sizes[s] for s in names], [(3, 1, 2)[k % 3] for k in range(len(names))], 1.5 * sum(sizes.values())), strict=True))
    assert {r["source"]: r["target"] for r in found} == {k: pytest.approx(v) for k, v in want.items()}
    taken = Counter()
    for r in found:
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == math.floor(want[s] + 1e-6) for s in names)
    got = Counter()
    for r in mixing.take(df, mixed).collect():
        got[r["source"]] += len(r["text"].split())
    assert got == taken


def test_mix_of_the_table(spark, documents):
    rows = queries.op8_mixing(spark, SF_DIR).collect()
    by = defaultdict(list)
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by[r["source"]].append(r)
    for own in by.values():
        assert sum(r["taken"] for r in own) == math.floor(own[0]["target"] + 1e-6)
        assert own[0]["source_size"] == sum(r["size"] for r in own)
    again = queries.op8_mixing(spark, SF_DIR)
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, rows), key=str)


def test_mix_of_odd_rows(odd_documents, no_documents):
    rows = mixing.mix(odd_documents).collect()
    assert len(rows) == 11
    assert {r["size"] for r in rows if r["doc_id"] in (3, 4, 5)} == {0}
    # the empty name comes first and weighs 3, then s0, s1, s2 and null
    sizes = {r["source"]: r["source_size"] for r in rows}
    want = targets([sizes[s] for s in ("", "s0", "s1", "s2", None)], [3, 1, 2, 3, 1], 1.5 * sum(r["size"] for r in rows))
    got = {r["source"]: r["target"] for r in rows}
    assert [got[s] for s in ("", "s0", "s1", "s2", None)] == pytest.approx(want)
    assert mixing.mix(no_documents).count() == 0


def test_take_cuts_at_the_budget(spark):
    df = spark.createDataFrame([(i, f"a{i} b c d", "s") for i in range(10)], "doc_id long, text string, source string")
    mixed = mixing.mix(df)
    taken = mixing.take(df, mixed).collect()
    assert sum(len(r["text"].split()) for r in taken) == 60
    assert max(Counter(r["doc_id"] for r in taken).values()) == 2


def test_take_agrees_with_the_mix(spark, no_documents):
    rows = [(i, " ".join(["w"] * (i % 7)), None if i % 5 == 0 else f"s{i % 3}", i) for i in range(300)] + [(900, None, "s0", 0), (None, "a b", "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, digest long")
    mixed = mixing.mix(df)
    got = Counter()
    for r in mixing.take(df, mixed).collect():
        got[r["doc_id"]] += len((r["text"] or "").split())
    assert {k: n for k, n in got.items() if n} == {r["doc_id"]: r["taken"] for r in mixed.collect() if r["taken"]}
    assert mixing.take(no_documents, mixing.mix(no_documents)).count() == 0
    # repeated rows in which the budget ends share what is left: none is lost but by rounding
    df = spark.createDataFrame([(1, "a b c d e", "s")] * 4 + [(2, "a", "t")], "doc_id long, text string, source string")
    taken = Counter()
    for r in mixing.take(df, mixing.mix(df)).collect():
        taken[r["doc_id"]] += len(r["text"].split())
    assert 25 <= taken[1] <= 31 and taken[2] in (1, 2)


# --- near-dedup


def brute_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, budget=2):
    """The least key that links reach, for (key, fingerprint) pairs."""
    values = sorted({f for _, f in fps})
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= budget:
                root[find(b)] = find(a)
    least = {}
    for k, f in fps:
        r = find(f)
        if k is not None:
            least[r] = min(k, least.get(r, k))
    return [(k, f, least.get(find(f))) for k, f in fps]


def test_near_duplicates_of_the_table(spark, documents):
    got = sorted((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in queries.op10_simhash_near_dedup(spark, SF_DIR).collect())
    assert got == sorted(brute_components([(d[0], brute_fingerprint(d[1])) for d in documents]))


def test_near_duplicates_of_odd_rows(odd_documents, no_documents):
    got = sorted(((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash.near_duplicates(odd_documents).collect()), key=str)
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in odd_documents.collect()]
    assert got == sorted(brute_components(rows), key=str)
    assert simhash.near_duplicates(no_documents).count() == 0
    kept = sorted((r["doc_id"] for r in simhash.keep_one(odd_documents).collect()), key=str)
    assert kept == sorted([1, 3, 6, 7, 8, 9, None], key=str)


def test_shared_words_in_upper_case_link(spark):
    df = spark.createDataFrame([(5, "One Two Three four"), (3, "one two three FOUR"), (4, "é two three four"), (6, "É two three four")], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert got == {5: 3, 3: 3, 4: 4, 6: 6}


def near_values(n, seed):
    rng = np.random.default_rng(seed)
    values = rng.integers(0, 2**64, n, dtype=np.uint64).tolist()
    for v in values[: n // 3]:
        for _ in range(3):
            for b in rng.integers(0, 64, rng.integers(0, 4)).tolist():
                v ^= 1 << b
            values.append(v)
    return np.unique(np.array(values, np.uint64))


@pytest.mark.parametrize("budget", [0, 1, 2, 3])
def test_trie_pairs(budget):
    values = near_values(300, budget)
    near = np.bitwise_count(values[:, None] ^ values[None]) <= budget
    want = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True) if i < j}
    i, j = simhash.trie_pairs(values, budget)
    assert len(i) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want


@pytest.mark.parametrize("most", [simhash.NODE_MOST, 4])
def test_links_connect_all_near_pairs(spark, monkeypatch, most):
    """Also where a block value is shared by so many that it is dealt out by trie nodes."""
    monkeypatch.setattr(simhash, "NODE_MOST", most)
    monkeypatch.setattr(simhash, "NODE_LEAST", min(most, simhash.NODE_LEAST))
    values = near_values(200, 9)
    values = np.unique(np.concatenate([values, values[:60] & np.uint64(0xFFF) | np.uint64(1 << 60)]))
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    found = simhash.links(df, 2)
    roots = {r["b"]: r["a"] for r in simhash.components(found).collect()}
    got = defaultdict(set)
    for v in values.view(np.int64).tolist():
        got[roots.get(v, v)].add(v & (2**64 - 1))
    want = defaultdict(set)
    for k, f, c in brute_components([(int(v), int(v)) for v in values]):
        want[c].add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def shingles(text, words=5):
    split = text.encode().lower().split()
    return {b" ".join(split[i : i + words]) for i in range(max(1, len(split) - words + 1))}


def planted_copies():
    """Texts of 150 random words, four near copies of each tenth one, and a passage that every third one shares."""
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    passage = " ".join(word() for _ in range(40))
    texts, of = [], []
    for g in range(200):
        base = [word() for _ in range(150)]
        for c in range(5 if g % 10 == 0 else 1):
            own = list(base)
            for k in rng.choice(150, c and 2, replace=False):
                own[k] = word()
            texts.append(" ".join(own) + (" " + passage if g % 3 == 0 else ""))
            of.append(g)
    return texts, of


def groups_of(n, pairs):
    """The least position of each position's component."""
    root = list(range(n))

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(v) for v in range(n)]


def alike(sets, least=0.8):
    return [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j])]


def copy_groups(spark, texts):
    roots = {r["b"]: r["a"] for r in simhash.components(simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    return [roots.get(i, i) for i in range(len(texts))]


@pytest.mark.parametrize(("most", "run"), [(simhash.ANCHOR_MOST, simhash.RUN_MOST), (8, 16)])
def test_near_copies_are_linked_and_others_not(spark, monkeypatch, most, run):
    """Also where anchors are shared by many, and where runs are gone through in parts."""
    monkeypatch.setattr(simhash, "ANCHOR_MOST", most)
    monkeypatch.setattr(simhash, "RUN_MOST", run)
    texts, _ = planted_copies()
    want = groups_of(len(texts), alike(list(map(shingles, texts))))
    assert sum(i != r for i, r in enumerate(want)) >= 60
    assert copy_groups(spark, texts) == want


@pytest.mark.parametrize("dense", [simhash.DENSE_FROM, 16])
def test_families_on_both_sides_of_the_similarity(spark, monkeypatch, dense):
    """Families whose members are all a bit more or a bit less alike than the similarity, so that many candidates fail."""
    monkeypatch.setattr(simhash, "DENSE_FROM", dense)
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    texts = []
    for family in range(6):
        base = [word() for _ in range(150)]
        for _ in range(25):
            own = list(base)
            for k in rng.choice(150, 1 + family % 3, replace=False):
                own[k] = word()
            texts.append(" ".join(own))
    sets = list(map(shingles, texts))
    want = groups_of(len(texts), alike(sets))
    assert len(set(want)) > 6 and len(alike(sets, 0.7)) > len(alike(sets)) > 100
    assert copy_groups(spark, texts) == want


def test_a_crowded_template_keeps_its_links(spark):
    """One anchor group of over ANCHOR_MOST texts with default constants: pairs in it are linked, and the others stay apart."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    template = " ".join(word() for _ in range(30))
    texts, sets = [], []
    for g in range(4500):
        own = [word() for _ in range(40)]
        texts.append(f"{template} {' '.join(own)}")
        if g % 30 == 0:
            own[rng.integers(5, 35)] = word()
            texts.append(f"{template} {' '.join(own)}")
    sets = list(map(shingles, texts))
    pairs = [(i, i + 1) for i in range(len(texts) - 1) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    assert len(pairs) == 150
    assert copy_groups(spark, texts) == groups_of(len(texts), pairs)


def test_set_links_are_exact():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**64, (5, 60), dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(60) < rng.choice([0.02, 0.1, 0.15]), rng.integers(0, 2**64, 60, dtype=np.uint64), base[k % 5])) for k in range(120)] + [np.zeros(0, np.uint64)] * 2
    want = groups_of(122, alike([set(x.tolist()) for x in sets]))
    assert 5 < len(set(want)) < 120
    for known in ([], [(i, r) for i, r in enumerate(want) if i % 2]):
        root = simhash.spanning(122, *np.array(known, np.int64).reshape(-1, 2).T)
        found = simhash.set_links(sets, root, 0.8)
        assert groups_of(122, known + found) == want


def test_forest_takes_the_heaviest_edges():
    rng = np.random.default_rng(3)
    i, j = rng.integers(0, 40, 300), rng.integers(0, 40, 300)
    weight = rng.integers(0, 20, 300).astype(float)
    chosen, root = simhash.forest(40, i, j, weight, np.arange(40))
    assert root.tolist() == groups_of(40, zip(i.tolist(), j.tolist(), strict=True))
    taken, total = list(range(40)), 0.0
    for k in np.argsort(-weight, kind="stable").tolist():
        a, b = taken[i[k]], taken[j[k]]
        if a != b:
            taken = [a if x == b else x for x in taken]
            total += weight[k]
    assert weight[chosen].sum() == total and len(chosen) == 40 - len(set(root.tolist()))


def test_keep_one_of_odd_rows(spark, odd_documents, no_documents):
    kept = simhash.keep_one(odd_documents, similar=(5, 0.8)).collect()
    assert sorted((r["doc_id"] for r in kept), key=str) == sorted([1, 3, 6, 7, 8, 9, None], key=str)
    assert kept[0].asDict().keys() == set(odd_documents.columns)
    assert simhash.keep_one(no_documents, similar=(5, 0.8)).count() == 0
    assert simhash.near_copies(no_documents).count() == 0
    # a key with two texts: each is judged by itself
    long = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(1, long), (2, long), (2, "another text under the same key"), (3, "another text under the same key"), (None, long)], "doc_id long, text string")
    for similar in (None, (5, 0.8)):
        assert sorted(map(tuple, simhash.keep_one(df, similar=similar).collect()), key=str) == sorted([(1, long), (2, "another text under the same key"), (None, long)], key=str)


def test_components_of_hubs(spark):
    """A vertex with very many links, others in chains, and repeated, reversed and empty links."""
    links = [(5000, i) for i in range(1, 3000)] + [(i, i + 1) for i in range(6000, 6040)] + [(6001, 6000), (9, 9), (None, 4)]
    got = {r["b"]: r["a"] for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in [*range(2, 3000), 5000]}, **{i: 6000 for i in range(6001, 6041)}}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_every_two_texts_of_a_crowded_anchor_meet(spark):
    each = spark.createDataFrame([(9, i) for i in range(50)] + [(8, i) for i in range(3)], "anchor long, class long")
    blocks = defaultdict(set)
    for r in simhash.in_blocks(each, "anchor", spark.createDataFrame([(9, 5)], "anchor long, ways int")).collect():
        blocks[r["anchor"], r["block"]].add(r["class"])
    assert max(map(len, blocks.values())) < 40
    assert blocks[8, 0] == {0, 1, 2}
    assert all(any({i, j} <= x for (anchor, _), x in blocks.items() if anchor == 9) for i in range(50) for j in range(i))


def test_long_chains_are_one_component(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    assert {r["b"]: r["a"] for r in simhash.components(pairs).collect()} == {**{i: 0 for i in range(1, 61)}, 101: 100}


# --- vectors

VECTORS = [(0, [1.0, 0.0]), (50, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.25]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, [0.0, 0.0]), (9, [0.25]), (1, [1.0, 0.0])]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    return spark.createDataFrame([(i, v, 1, "s") for i, v in VECTORS], "vec_id long, embedding array<float>, label int, score string")


def vectors():
    rows = connect().execute("SELECT vec_id, embedding FROM embeddings ORDER BY 1").fetchall()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)


def brute(ids, scores, k=5):
    out = {}
    for r, i in enumerate(ids.tolist()):
        if i % 50 == 0:
            s = scores[r].copy()
            s[r] = -np.inf
            out[i] = [(int(ids[j]), s[j]) for j in np.lexsort((ids, -s))[:k]]
    return out


def by_query(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_exact_topk_of_the_table(spark):
    ids, x = vectors()
    x = np.floor(256 * x)
    assert by_query(queries.op4_exact_topk(spark, SF_DIR).collect()) == brute(ids, x @ x.T)


def test_exact_topk_of_odd_rows(spark, odd_vectors):
    got = by_query(topk.search(odd_vectors, F.col("id") % 50 == 0).collect())
    assert got[0] == [(1, 65536), (2, 65536), (50, 32768), (9, 16384), (8, 0)]
    assert got[50] == [(0, 32768), (1, 32768), (2, 32768), (9, 8192), (8, 0)]
    assert topk.search(odd_vectors.limit(0), F.col("id") % 50 == 0).count() == 0
    assert topk.search(odd_vectors.where("vec_id = 0"), F.col("id") % 50 == 0).count() == 0
    huge = spark.createDataFrame([(0, [3e38]), (1, [3e38]), (2, [-3e38])], "vec_id long, embedding array<float>")
    assert by_query(topk.search(huge, F.col("id") % 50 == 0).collect())[0] == [(1, 2**63 - 1), (2, -(2**63))]


def test_pruning_keeps_ties():
    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (700, 8)).astype(float)
    ids = rng.permutation(700)
    q, v, s, _ = topk.search_blocks(x[:40], ids[:40], x, ids, 5, block=16)
    scores = x @ x.T
    for r in range(40):
        own = scores[r].copy()
        own[r] = -np.inf
        want = np.lexsort((ids, -own))[:5]
        assert v[q == ids[r]].tolist() == ids[want].tolist() and s[q == ids[r]].tolist() == own[want].tolist()


def clustered(n, groups, dims, seed):
    """Vectors around some centres, those of one centre in no order."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dims))
    return centres[rng.integers(0, groups, n)] + 0.05 * rng.standard_normal((n, dims))


def test_most_blocks_of_clustered_vectors_are_skipped():
    x = np.floor(256 * clustered(4096, 40, 16, 3))
    signs = np.random.default_rng(7).standard_normal((16, topk.SIGNS))
    x = x[np.argsort((x @ signs > 0) @ (1 << np.arange(topk.SIGNS)), kind="stable")]
    ids = np.arange(4096)
    own = topk.search_blocks(x[::50], ids[::50], x, ids, 5)
    assert own[3] < 0.5 * 64 * len(x[::50])
    floors = [own[2][own[0] == i].min() for i in ids[::50]]
    assert topk.search_blocks(x[::50], ids[::50], x, ids, 5, floors=np.array(floors))[3] <= own[3]


def test_few_parts_of_clustered_vectors_are_asked(spark, monkeypatch):
    """And the answers are exact: many parts, a part that several copies answer for, and bounds of several rows."""
    from scribewell.llm import vectors

    monkeypatch.setattr(topk, "GROUP", 128)
    monkeypatch.setattr(topk, "SUMMARIES", 8)
    monkeypatch.setattr(topk, "ASK_BLOCK", 16)
    monkeypatch.setattr(vectors, "ASK_ROWS", 2)
    asked, promising = [], topk.promising
    monkeypatch.setattr(topk, "promising", lambda *a: asked.append(promising(*a)) or asked[-1])
    x = clustered(3000, 30, 16, 5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = by_query(topk.search(df, F.col("id") % 50 == 0).collect())
    x = np.floor(256 * x)
    assert got == brute(np.arange(3000), x @ x.T)
    assert asked[0].count() < 0.5 * 60 * 24


def test_nearest_neighbours_of_the_table(spark):
    ids, x = vectors()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want, got = brute(ids, u @ u.T), by_query(queries.op9_nearest_neighbours(spark, SF_DIR).collect())
    assert got.keys() == want.keys()
    hits = sum(len({v for v, _ in want[q]} & {v for v, _ in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9
    at = {i: r for r, i in enumerate(ids.tolist())}
    assert all(abs(s - u[at[q]] @ u[at[v]]) < 1e-12 for q, own in got.items() for v, s in own)


def test_nearest_neighbours_of_odd_rows(odd_vectors):
    got = by_query(ann.search(odd_vectors, F.col("id") % 50 == 0).collect())
    assert [v for v, _ in got[0]] == [1, 2, 9, 50, 3]
    assert got[0][0][1] == got[0][1][1] == 1.0
    assert ann.search(odd_vectors.limit(0), F.col("id") % 50 == 0).count() == 0


def test_recall_with_copies_and_a_hot_bucket(spark):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(32)
    x = np.concatenate([centre + 0.02 * rng.standard_normal((2500, 32)), rng.standard_normal((2500, 32))])
    ids = rng.permutation(5000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    order = np.argsort(ids)
    want, got = brute(ids[order], (u @ u.T)[np.ix_(order, order)]), by_query(ann.search(df, F.col("id") % 50 == 0).collect())
    assert sum(len({v for v, _ in want[q]} & {v for v, _ in got[q]}) for q in want) / (5 * len(want)) >= 0.9


def test_parts_that_many_queries_ask_are_dealt(spark, monkeypatch):
    """The same answers with parts of few vectors, each of which several copies answer for."""
    from scribewell.llm import vectors

    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered(1500, 30, 16, 7))], "vec_id long, embedding array<double>")
    whole = by_query(ann.search(df, F.col("id") % 50 == 0).collect())
    monkeypatch.setattr(ann, "INDEX_ROWS", 100)
    monkeypatch.setattr(vectors, "ASK_ROWS", 2)
    assert by_query(ann.search(df, F.col("id") % 50 == 0).collect()) == whole


def test_probes_come_in_order_of_their_chances():
    rng = np.random.default_rng(8)
    inside = rng.uniform(0, 1, 3)
    found = ann.probes(np.zeros(3, int), inside, 0.4, 0.9)
    p = ann.chances(inside, 0.4)
    chance = [math.prod(p[i, c + 2] for i, c in enumerate(t)) for t in found]
    assert len(set(found)) == len(found) and chance == sorted(chance, reverse=True) and sum(chance) >= 0.9


# --- pipeline


def test_pipeline_is_its_stages_by_brute_force(spark, documents):
    import corpus_pipeline
    from scribewell.llm import langid, packing, secrets

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "secret_scan", "mixing", "best_fit_packing"]
    raw = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = langid.Classifier(langid.fit(raw.where(~langid.held_out(F.col("doc_id")))))
    kept = [d for d in documents if not model.predict(d[1])[2]]
    assert len(kept) >= 0.97 * len(documents)
    # groups by fingerprints within two bits, and by an exact five-word similarity of 0.8
    fps, sets = [brute_fingerprint(d[1]) for d in kept], [shingles(d[1]) for d in kept]
    near = alike(sets) + [(i, j) for i in range(len(kept)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    after = {kept[r][0] for r in groups_of(len(kept), near)}
    assert 0 < len(after) < len(kept)
    kept = [d for d in kept if d[0] in after]
    texts = {}
    for i, t, _, _ in kept:
        spans = secrets.joined(secrets.base_spans(t) + secrets.RULES.spans(t))
        texts[i] = secrets.masked(t, spans, "[SECRET]") if spans else t
    docs = raw
    frames = []
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF_DIR), name)
        frames.append(docs)
    assert {r["doc_id"]: r["text"] for r in frames[2].collect()} == texts
    assert all(r["n_chars"] == len(r["text"]) for r in frames[2].collect())
    assert [f.columns for f in frames[:4]] == [corpus_pipeline.COLUMNS] * 4
    words = sum(len(t.encode().split()) for t in texts.values())
    mixed = sum(len(r["text"].encode().split()) for r in frames[3].collect())
    assert abs(mixed - 1.5 * words) <= 20
    want = Counter()
    for r in frames[3].collect():
        n = len(packing.encoder(queries.tokenizer_path()).whole(r["text"])) + 1
        want[r["doc_id"]] += n
    got = Counter()
    for r in frames[4].collect():
        got[r["doc_id"]] += r["length"]
    assert got == want
    run = corpus_pipeline.run(spark, SF_DIR)
    assert run.columns == frames[4].columns and run.count() == frames[4].count()


def test_stages_on_empty_tables_and_odd_rows(spark, odd_documents, no_documents):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, no_documents, SF_DIR)
        assert none.count() == 0, name
        some = stage(spark, odd_documents, SF_DIR)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert some.columns == none.columns == corpus_pipeline.COLUMNS, name
    kept = {name: [r["doc_id"] for r in stage(spark, odd_documents, SF_DIR).collect()] for name, stage in corpus_pipeline.STAGES}
    # without a letter there is no language; texts without words are copies; all rows go through the scan
    assert not {3, 4, 5, 7} & set(kept["language_id"])
    assert sorted(kept["simhash_near_dedup"], key=str) == sorted([1, 3, 6, 7, 8, 9, None], key=str)
    assert len(kept["secret_scan"]) == 11 and set(kept["best_fit_packing"]) == {1, 2, 3, 4, 5, 6, 7, 8, 9, None}
