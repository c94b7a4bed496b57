"""SimHash near-duplicates: fingerprints of word shingles, a binary trie self-join, connected components.

The join goes over distinct fingerprints. Where two of them differ in at most ``k`` of 64 bits, they
agree in one of ``k + 1`` blocks of bits, so each block's value deals the fingerprints to tasks; in
a task a binary trie over the other bits is joined with itself: pairs of nodes are traversed
together, the bits in which they differ add up, and a pair of nodes over the budget is dropped with
all that is below it. A block value that very many fingerprints share is dealt out by pairs of trie nodes as well.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, checked, forget, hot_keys, map_batches, new_path, salted_join, small_batches, written

SEED = 42
BITS = 64
#: A block value with more distinct fingerprints, or with over HOT_SHARE of all and over NODE_LEAST, is dealt out over pairs of trie nodes.
NODE_MOST, NODE_LEAST = 20_000, 64
#: Trie levels by which it is dealt out: a fingerprint goes to 1 + 12 + 66 pairs of nodes at a budget of 2.
NODE_BITS = 12


def shingle_hashes(text: bytes, *lengths: int) -> list[np.ndarray]:
    """For each number of words the XXH64 of each shingle of lower-cased (A-Z) words of UTF-8 ``text``, repeats included; fewer words are one shingle, no words none."""
    import xxhash

    split = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    n = len(split)
    if not n:
        return [np.zeros(0, np.uint64) for _ in lengths]
    joined = b" ".join(split)
    digest = xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
    ends = ends.tolist()
    out = []
    for words in lengths:
        if n < words:
            out.append(np.array([digest(joined, SEED)], np.uint64))
        else:
            spans = zip(starts[: n - words + 1], ends[words - 1 :], strict=True)
            out.append(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n - words + 1))
    return out


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if it is set in over half of the hashes; none: 0."""
    total = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 65_536):
        total += np.unpackbits(hashes[a : a + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words: int = 3) -> int:
    """SimHash of UTF-8 ``text``."""
    return majority(shingle_hashes(text, words)[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """``key`` and fp, the fingerprint as a signed long, of every row (null text: 0)."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column("text").cast(pa.binary())
            fp = [fingerprint(x.as_py(), words) if x.is_valid else 0 for x in column]
            return pa.RecordBatch.from_arrays([batch.column("key"), pa.array(np.array(fp, np.uint64).view(np.int64))], ["key", "fp"])

        return each

    kind = df.schema[key].dataType.simpleString()
    return map_batches(df.select(F.col(key).alias("key"), F.col(text).alias("text")), make, f"key {kind}, fp long")


def trie_pairs(values: np.ndarray, budget: int, cuts: np.ndarray | None = None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of uint64 ``values`` that differ in at most ``budget`` of the lowest ``bits`` bits.

    ``cuts`` are the ends of the tries that lie one after the other in ``values``, by default one; the
    values of each are distinct and sorted. A node is a range of values with a common prefix; a level
    of the tries is gone through at once, for all pairs of nodes that are still within the budget.
    """
    a1 = np.array([len(values)], np.int64) if cuts is None else np.asarray(cuts, np.int64)
    a0 = np.concatenate([[0], a1[:-1]])
    a0, a1 = a0[a1 - a0 > 1], a1[a1 - a0 > 1]
    b0, b1 = a0.copy(), a1.copy()
    errors = np.zeros(len(a0), np.int64)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for level in range(bits - 1, -1, -1):
        if not len(a0):
            break
        bit = (values >> np.uint64(level)) & np.uint64(1)
        ones = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
        middle = lambda lo, hi: hi - (ones[hi] - ones[lo])  # noqa: E731  where the node's 1 branch begins
        am, bm = middle(a0, a1), middle(b0, b1)
        same = a0 == b0
        sides = [(a0, am, b0, bm, errors), (am, a1, bm, b1, errors), (a0, am, bm, b1, errors + 1), (am, a1, b0, bm, np.where(same, budget + 1, errors + 1))]
        a0, a1, b0, b1, errors = (np.concatenate(x) for x in zip(*sides, strict=True))
        keep = (a1 > a0) & (b1 > b0) & (errors <= budget) & ((a0 != b0) | (a1 - a0 > 1))
        a0, a1, b0, b1, errors = a0[keep], a1[keep], b0[keep], b1[keep], errors[keep]
        # single leaves need no further levels: their distance is known at once
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        if leaf.any():
            out.append(_within(values, a0[leaf], b0[leaf], budget, bits))
            a0, a1, b0, b1, errors = a0[~leaf], a1[~leaf], b0[~leaf], b1[~leaf], errors[~leaf]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = (np.concatenate(x) for x in zip(*out, strict=True))
    return np.minimum(i, j), np.maximum(i, j)


def _within(values: np.ndarray, i: np.ndarray, j: np.ndarray, budget: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << bits) - 1)
    near = np.bitwise_count((values[i] ^ values[j]) & mask) <= budget
    return i[near], j[near]


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position of each position's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def links(distinct: DataFrame, budget: int) -> DataFrame:
    """(a, b): pairs of ``distinct`` fingerprints (column fp) whose links connect all that differ in at most ``budget`` bits.

    Of the linked fingerprints that meet in a task each is linked with the least of its component there, so
    a group of copies gives no more rows than it has fingerprints.
    """
    blocks = budget + 1
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    keyed = distinct.select(
        "fp",
        F.explode(
            F.array(*[F.struct(F.lit(k).alias("block"), F.expr(f"shiftrightunsigned(fp, {edges[k]}) & {(1 << (edges[k + 1] - edges[k])) - 1}L").alias("value")) for k in range(blocks)])
        ).alias("at"),
    ).select("fp", "at.block", "at.value")
    # the trie levels below a shared block value: the next NODE_BITS bits above the block, around the word's end
    node = F.expr("CASE block " + " ".join(f"WHEN {k} THEN shiftrightunsigned(fp, {edges[(k + 1) % blocks]}) & {(1 << NODE_BITS) - 1}L" for k in range(blocks)) + " END")
    flips = [0, *[sum(1 << b for b in c) for r in range(1, budget + 1) for c in combinations(range(NODE_BITS), r)]] if budget <= 3 else None
    total = distinct.count()
    most = max(NODE_LEAST, min(NODE_MOST, int(total * HOT_SHARE)))
    crowded = written(keyed.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > most).select("block", "value", F.lit(True).alias("hot")), "crowded")
    keyed = keyed.join(checked(crowded), ["block", "value"], "left").withColumn("node", F.when(F.col("hot"), node))
    if flips:
        other = F.explode(F.when(F.col("node").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.array(*[F.lit(x).cast("long") for x in flips])))
        keyed = keyed.withColumn("flip", other)
        keyed = keyed.select("fp", "block", "value", F.coalesce(F.least("node", F.expr("node ^ flip")), F.lit(-1)).alias("low"), F.coalesce(F.greatest("node", F.expr("node ^ flip")), F.lit(-1)).alias("high"))
    else:
        keyed = keyed.select("fp", "block", "value", F.lit(-1).cast("long").alias("low"), F.lit(-1).cast("long").alias("high"))
    key = ["block", "value", "low", "high"]
    dealt = keyed.repartition(*key).sortWithinPartitions(*key)

    def joined(fp: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links in each of the runs of fingerprints that end at ``cuts``."""
        values = fp.view(np.uint64)
        values = values[np.lexsort((values, np.repeat(np.arange(len(cuts)), np.diff(cuts, prepend=0))))]
        i, j = trie_pairs(values, budget, cuts)
        if len(i):
            root = spanning(len(values), i, j)
            child = np.nonzero(root != np.arange(len(values)))[0]
            yield pa.RecordBatch.from_arrays([pa.array(values[root[child]].view(np.int64)), pa.array(values[child].view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal keys; the last run of a batch may go on in the next."""
        held: tuple[list, list] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in key], axis=1)
            fp = batch.column("fp").to_numpy()
            if held and (held[0] == keys[0]).all() and (keys[0] == keys[-1]).all():
                held[1].append(fp)  # all of the batch goes on with the run
                continue
            if held:
                before = np.concatenate(held[1])
                keys, fp = np.concatenate([np.repeat(held[0][None], len(before), axis=0), keys]), np.concatenate([before, fp])
            cuts = np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1
            last = cuts[-1] if len(cuts) else 0
            held = (keys[last], [fp[last:]])
            if last:
                yield from joined(fp[:last], cuts)
        if held:
            fp = np.concatenate(held[1])
            yield from joined(fp, np.array([len(fp)]))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(pairs: DataFrame, rounds: int = 40) -> DataFrame:
    """(b, a): every vertex of the links ``pairs`` (a, b) but the least of each component, with that least vertex.

    Large-star and small-star steps in turn, each a shuffle of the links, until nothing changes; links
    are written to the shared folder in each round, and those of the round before deleted. A vertex's least neighbour and its number of links
    come from an aggregate that combines in each task; the joins back to the links are salted for vertices of many links.
    Links of a vertex with itself and with null tell nothing; no links give an empty table.
    """
    spark, base = pairs.sparkSession, new_path(pairs.sparkSession, "links")
    now = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links", f"{base}/0")
    n = now.count()
    before = None
    for turn in range(1, rounds + 1):
        at = f"{base}/{turn}"
        both = now.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(now.select(F.col("b").alias("v"), F.col("a").alias("u")))
        # a vertex's least neighbour, its links, and those to smaller ones
        at_v = both.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"), F.sum(F.when(F.col("u") < F.col("v"), 1).otherwise(0)).alias("n_low"))
        least = written(at_v.select("v", F.least("v", "m").alias("m"), "n", "n_low"), "least", f"{at}-least")
        # large star: greater neighbours of a vertex are linked with its least neighbour
        large = salted_join(both.where("u > v"), least.select("v", "m"), "v", hot_keys(least, "v", "n", 2 * n), "u")
        large = large.select(F.col("m").alias("a"), F.col("u").alias("b")).where("a < b").distinct()
        # small star: a vertex and its smaller neighbours, no more than it had, are linked with the least of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = salted_join(large, low, "b", hot_keys(least.select(F.col("v").alias("b"), "n_low"), "b", "n_low", n), "a")
        new = small.select(F.col("m").alias("a"), "b").unionByName(small.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a < b").distinct()
        new = written(new, "links", at)
        n, total = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        for path in (f"{at}-least", f"{base}/{turn - 1}"):
            forget(spark, path)
        if (n, total) == before:
            return new.select("b", "a")
        now, before = new, (n, total)
    raise RuntimeError(f"links didn't settle in {rounds} rounds")


def roots_of(distinct: DataFrame, edges: DataFrame) -> DataFrame:
    """``distinct`` (one row for each fp) with root, the least fp that ``edges`` reach."""
    roots = components(edges).select(F.col("b").alias("fp"), F.col("a").alias("root"))
    return distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, budget: int = 2) -> DataFrame:
    """``key``, fp and component_id (the least key that links reach) of every row of ``df``.

    Null, empty and blank texts have fingerprint 0 and link like any other; fewer words than a shingle are one
    shingle; equal fingerprints are one vertex, so that copies need no pairs. Rows with null keys are kept
    and take their component's id (null if it has no key). Repeated rows stay; further columns are not read; an empty table gives an empty one.
    """
    rows = written(fingerprints(df, key, text, words), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("key").alias("least"), F.count("*").alias("n")), "classes")
    rooted = written(roots_of(classes, links(classes.select("fp"), budget)), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = rooted.join(ids, "root").select("fp", "component_id")
    hot = hot_keys(classes, "fp", "n", rows.count())
    out = salted_join(rows, of_class, "fp", hot, "key")
    return out.select(F.col("key").alias(key), "fp", "component_id")


# --- near copies by similarity: the same trie join in groups that share an anchor, and each link held to its exact similarity

#: Minima of the shingles' hashes under so many permutations: a sketch by which pairs become candidates,
#: and anchors, each of two of them.
MINIMA, ANCHORS = 128, 8
#: Standard deviations by which a pair at the similarity may miss in its sketch, or in its fingerprints' bits.
SLACK = 3.0
#: An anchor with more distinct texts than ANCHOR_MOST is dealt into runs of about RUN_MOST, any two of which meet in a task.
ANCHOR_MOST, RUN_MOST = 4096, 1024
#: Bytes of sets in a run of texts whose links are settled by their sets.
RUN_BYTES = 8 << 20
#: In a run of more texts all pairs are compared at once, without a trie, and those of higher estimates first.
DENSE_FROM, DENSE_STEPS = 256, (0.95, 0.88)
_MULTIPLIERS = np.random.default_rng(SEED).integers(1, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    least = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashes), 2048):
        mixed = hashes[a : a + 2048]
        mixed = mixed ^ (mixed >> np.uint64(29))
        np.minimum(least, (mixed[:, None] * _MULTIPLIERS[None]).min(axis=0), out=least)
    return least


def profiles(df: DataFrame, key: str, text: str, words: int, similar_words: int) -> DataFrame:
    """key, version (the hash of the text), fp (of ``words``), class, code (the fingerprint of ``similar_words``), anchors (ANCHORS longs), sketch (MINIMA bytes) of every row.

    One pass over the texts makes all of these. Texts of equal code and sketch are of one class.
    """

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column("text").cast(pa.binary())
            fps, codes, least = [], [], []
            for x in column:
                short, long = shingle_hashes(x.as_py() if x.is_valid else b"", words, similar_words)
                fps.append(majority(short))
                codes.append(majority(long))
                least.append(minima(long))
            m = np.stack(least)
            at = m[:, : 4 * ANCHORS].reshape(-1, ANCHORS, 4)
            odd = np.uint64(0x9E3779B97F4A7C15)
            turn = np.arange(ANCHORS, dtype=np.uint64)[None] * odd
            anchors = (at[:, :, 0] * odd ^ (at[:, :, 1] >> np.uint64(7))) + turn
            lists = pa.FixedSizeListArray.from_arrays(pa.array(anchors.view(np.int64).ravel()), ANCHORS).cast(pa.list_(pa.int64()))
            sketch = pa.array([x.tobytes() for x in (m >> np.uint64(40)).astype(np.uint8)], pa.binary())
            longs = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fps, codes)]
            return pa.RecordBatch.from_arrays([batch.column("key"), batch.column("version"), *longs, lists, sketch], ["key", "version", "fp", "code", "anchors", "sketch"])

        return each

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("version"), F.col(text).alias("text"))
    return map_batches(rows, make, f"key {kind}, version long, fp long, code long, anchors array<long>, sketch binary").withColumn("class", F.xxhash64("code", "sketch"))


def forest(n: int, i: np.ndarray, j: np.ndarray, weight: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (their positions) of a spanning forest of the ``n`` components ``root`` that has the heaviest edges, and the components then."""
    rank = np.empty(len(i), np.int64)
    rank[np.lexsort((j, i, weight))] = np.arange(len(i))
    open_, taken = np.arange(len(i)), []
    while True:
        a, b = root[i[open_]], root[j[open_]]
        apart = a != b
        open_, a, b = open_[apart], a[apart], b[apart]
        if not len(open_):
            return (np.unique(np.concatenate(taken)) if taken else np.zeros(0, np.int64)), root
        best = np.full(n, -1, np.int64)
        np.maximum.at(best, a, rank[open_])
        np.maximum.at(best, b, rank[open_])
        chosen = open_[(rank[open_] == best[a]) | (rank[open_] == best[b])]
        taken.append(chosen)
        root = spanning(n, np.concatenate([np.arange(n), i[chosen]]), np.concatenate([root, j[chosen]]))


class Texts:
    """The distinct texts of some runs, one after the other, that end at ``cuts``; pairs of a run become candidates by code and sketch."""

    def __init__(self, code: np.ndarray, sketch: np.ndarray, cuts: np.ndarray, budget: int, agree: float):
        self.code, self.sketch, self.budget, self.agree = code, sketch, budget, agree
        starts = np.concatenate([[0], cuts[:-1]])
        large = cuts - starts > DENSE_FROM
        self.dense = list(zip(starts[large].tolist(), cuts[large].tolist(), strict=True))
        self.small = self.by_trie(np.nonzero(np.repeat(~large, cuts - starts))[0], np.repeat(np.arange(len(cuts)), cuts - starts))

    def estimates(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        parts = [(self.sketch[i[a : a + 65_536]] == self.sketch[j[a : a + 65_536]]).mean(axis=1) for a in range(0, len(i), 65_536)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def by_trie(self, at: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All candidates in small runs: codes within the budget by the trie, texts of equal codes as well, and then by sketches."""
        order = at[np.lexsort((self.code[at], run[at]))]
        f, r = self.code[order], run[order]
        same = np.concatenate([[False], (f[1:] == f[:-1]) & (r[1:] == r[:-1])])[: len(f)]
        first = np.nonzero(~same)[0]
        value = np.cumsum(~same) - 1  # of each text, its code's place among the distinct ones
        cuts = np.nonzero(np.append(r[first][1:] != r[first][:-1], True))[0] + 1 if len(first) else np.zeros(0, np.int64)
        x, y = trie_pairs(f[first], self.budget, cuts) if len(first) else (first, first)
        # pairs of codes as pairs of texts, and pairs of texts of one code
        size = np.bincount(value, minlength=len(first)) if len(first) else np.zeros(0, np.int64)
        n = size[x] * size[y]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        xs, ys = np.repeat(x, n), np.repeat(y, n)
        i, j = first[xs] + k // size[ys], first[ys] + k % size[ys]
        twins = np.nonzero(size > 1)[0].tolist()
        if twins:
            inner = [tuple(first[v] + t for t in np.triu_indices(size[v], 1)) for v in twins]
            i, j = np.concatenate([i, *[t[0] for t in inner]]), np.concatenate([j, *[t[1] for t in inner]])
        i, j = order[i], order[j]
        i, j = np.minimum(i, j), np.maximum(i, j)
        weight = self.estimates(i, j)
        near = weight >= self.agree
        return i[near], j[near], weight[near]

    def tree(self) -> tuple[np.ndarray, np.ndarray]:
        """Candidates that make a spanning forest of each run."""
        n = len(self.code)
        i, j, weight = self.small
        chosen, root = forest(n, i, j, weight, np.arange(n))
        out = [(i[chosen], j[chosen])]
        for a, b in self.dense:
            for step in (*[s for s in DENSE_STEPS if s > self.agree], self.agree):
                for k in range(a, b, 64):
                    i, j = np.nonzero(np.bitwise_count(self.code[k : min(k + 64, b), None] ^ self.code[None, k:b]) <= self.budget)
                    i, j = i + k, j + k
                    apart = (i < j) & (root[i] != root[j])
                    i, j = i[apart], j[apart]
                    for c in range(0, len(i), 65_536):
                        x, y = i[c : c + 65_536], j[c : c + 65_536]
                        apart = root[x] != root[y]
                        x, y = x[apart], y[apart]
                        weight = self.estimates(x, y)
                        near = weight >= step
                        if near.any():
                            x, y = x[near], y[near]
                            chosen, root = forest(n, x, y, weight[near], root)
                            out.append((x[chosen], y[chosen]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def in_blocks(frame: DataFrame, group: str, ways: DataFrame) -> DataFrame:
    """``frame`` with a column block: a ``group`` that has ``ways`` (over one) is dealt into so many runs, and each row is in the blocks of its run with every other run.

    So any two rows of a group meet in a block, of about two runs' rows.
    """
    run = F.pmod(F.xxhash64("class", group), F.col("ways")).cast("int")
    block = "transform(filter(sequence(0, ways - 1), k -> k <> run), k -> least(k, run) * cast(ways AS long) + greatest(k, run))"
    dealt = frame.join(checked(ways), group, "left").withColumn("run", run)
    return dealt.withColumn("block", F.explode(F.when(F.col("ways") > 1, F.expr(block)).otherwise(F.expr("array(0L)")))).drop("ways", "run")


def by_block(df: DataFrame, group: str, columns: list[str], links_of: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> DataFrame:
    """(a, b): what ``links_of`` gives for the rows of whole blocks of ``df``."""
    dealt = df.select(group, "block", *columns).repartition(group, "block").sortWithinPartitions(group, "block", "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            g, b = batch.column(group).to_numpy(), batch.column("block").to_numpy()
            cuts = np.nonzero((g[1:] != g[:-1]) | (b[1:] != b[:-1]))[0] + 1
            if held and last != (g[0], b[0]):
                yield from links_of(pa.Table.from_batches(held))
                held = []
            if len(cuts):
                yield from links_of(pa.Table.from_batches([*held, batch.slice(0, cuts[-1])]))
                held = []
            held.append(batch.slice(cuts[-1] if len(cuts) else 0))
            last = g[-1], b[-1]
        if held:
            yield from links_of(pa.Table.from_batches(held))
        pa.default_memory_pool().release_unused()

    small_batches(df.sparkSession)
    return dealt.mapInArrow(run, "a long, b long")


def runs_of(now: pa.Table) -> np.ndarray:
    """The ends of the runs of one anchor and block."""
    anchor, block = now.column("anchor").to_numpy(), now.column("block").to_numpy()
    return np.append(np.nonzero((anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1]))[0] + 1, len(anchor))


def candidates(each: DataFrame, crowded: DataFrame, budget: int, agree: float) -> DataFrame:
    """(a, b): pairs of classes to be judged, from the rows ``each`` (class, code, sketch, anchor): the candidates of a spanning forest in each block."""

    def links_of(now: pa.Table) -> Iterator[pa.RecordBatch]:
        code, texts = now.column("code").to_numpy().view(np.uint64), now.column("class").to_numpy()
        sketch = np.frombuffer(b"".join(now.column("sketch").to_pylist()), np.uint8).reshape(-1, MINIMA)
        i, j = Texts(code, sketch, runs_of(now), budget, agree).tree()
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(texts[i]), pa.array(texts[j])], ["a", "b"])

    # a pair may come from several blocks
    return by_block(in_blocks(each, "anchor", crowded), "anchor", ["class", "code", "sketch"], links_of).distinct()


def set_links(sets: list[np.ndarray], root: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (i, j) by which all of the sets that have that Jaccard similarity or more are connected, beyond what ``root`` (changed in place) has.

    Exact: an inverted index gives what each set but those of the largest component has in common with all others.
    """
    n, size = len(sets), np.fromiter(map(len, sets), np.int64, len(sets))
    labels, counts = np.unique(root, return_counts=True)
    open_ = np.nonzero(root != labels[counts.argmax()])[0].tolist()
    if not open_:
        return []
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(size) - size
    holders = np.repeat(np.arange(n), size)[np.argsort(token, kind="stable")]
    n_holders = np.bincount(token)
    first = np.cumsum(n_holders) - n_holders
    out = []
    for i in open_:
        own = token[starts[i] : starts[i] + size[i]]
        m = n_holders[own]
        at = np.repeat(first[own] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        both = np.bincount(holders[at], minlength=n)
        for j in np.nonzero((both >= similarity * (size[i] + size - both)) & (root != root[i]))[0].tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                out.append((i, j))
    return out


def settled(each: DataFrame, ways: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links between classes of each block by the exact similarity of their sets, from the rows ``each`` (class, grams, anchor, yes).

    ``yes`` are classes with which a row's class is linked already.
    """

    def links_of(now: pa.Table) -> Iterator[pa.RecordBatch]:
        texts, cuts = now.column("class").to_numpy(), runs_of(now)
        grams, yes = now.column("grams"), now.column("yes").to_pylist()
        a = 0
        for b in cuts.tolist():
            place = {c: k for k, c in enumerate(texts[a:b].tolist())}
            known = [(k, place[c]) for k, row in enumerate(yes[a:b]) for c in row if c in place]
            root = spanning(b - a, *np.array(known, np.int64).reshape(-1, 2).T)
            found = set_links([np.frombuffer(x.as_py(), np.uint64) for x in grams[a:b]], root, similarity)
            if found:
                i, j = np.array(found).T + a
                yield pa.RecordBatch.from_arrays([pa.array(texts[np.minimum(i, j)]), pa.array(texts[np.maximum(i, j)])], ["a", "b"])
            a = b

    return by_block(in_blocks(each, "anchor", ways), "anchor", ["class", "grams", "yes"], links_of).distinct()


def held_to(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """(a, b, near): whether the sets ``grams`` (class, grams: sorted hashes) of each of ``pairs`` have that Jaccard similarity or more."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            near = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    near.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                # two texts without words are alike
                near.append(both >= similarity * (len(x) + len(y) - both))
            return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.bool_())], ["a", "b", "near"])

        return each

    n = pairs.count()
    one = lambda side: grams.select(F.col("class").alias(side[0]), F.col("grams").alias(side[1]))
    hot = lambda side: hot_keys(pairs.groupBy(side).agg(F.count("*").alias("n")), side, "n", n)
    both = salted_join(pairs, one("ax"), "a", hot("a"), "b")
    both = salted_join(both, one("by"), "b", hot("b"), "a")
    return map_batches(both.select("a", "b", "x", "y"), make, "a long, b long, near boolean")


def copies(rows: DataFrame, df: DataFrame, key: str, text: str, words: int, similarity: float) -> DataFrame:
    """(a, b): links between classes of ``rows`` (profiles of ``df``) by which all are connected whose texts' shingle sets have that Jaccard similarity or more.

    Texts are dealt to tasks by anchors, and a group is joined by the binary trie with the budget of bits that
    the similarity asks for; sketches make candidates of the pairs within it. Of each group the pairs of a spanning forest are held to
    their exact similarity. Where one fails, others may still connect its texts: such groups are gone through once more, now by their texts' whole sets.
    Null, empty and blank texts have no shingles and are one class; repeated rows are too; empty tables give no links; further columns of ``df``, whatever their names, are not read.
    """
    angle = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    budget = int(BITS * angle + SLACK * np.sqrt(BITS * angle * (1 - angle)))
    agree = similarity - SLACK * np.sqrt(similarity * (1 - similarity) / MINIMA)
    classes = written(rows.groupBy("class").agg(F.min(F.struct("key", "version", "code", "anchors", "sketch")).alias("t")).select("class", "t.*"), "classes")
    each = classes.select("class", "code", "sketch", F.explode("anchors").alias("anchor"))
    crowded = written(each.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > ANCHOR_MOST).select("anchor", F.ceil(F.col("n") / RUN_MOST).cast("int").alias("ways")), "crowded")
    pairs = written(candidates(each, crowded, budget, agree), "candidates")
    # what is in no pair here has no candidate at all, so its set is not needed
    used = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    wanted = written(used.join(classes.select("class", F.col("key").alias("__sw_key"), F.col("version").alias("__sw_version")), "class"), "wanted")
    texts = df.select(F.col(key).alias("__sw_key"), F.col(text).alias("__sw_text")).withColumn("__sw_version", F.xxhash64("__sw_text"))
    grams = written(sets_of(texts.join(checked(wanted), ["__sw_key", "__sw_version"]).select("class", F.col("__sw_text").alias("text")), words), "grams")
    judged = written(held_to(pairs, grams, similarity), "judged")
    linked, failed = judged.where("near").select("a", "b"), judged.where(~F.col("near"))
    at = classes.select("class", F.explode("anchors").alias("anchor"))
    of = lambda side: failed.join(at.select(F.col("class").alias(side), "anchor"), side).select("a", "b", "anchor")
    again = written(of("a").intersect(of("b")).select("anchor").distinct(), "again")
    yes = linked.groupBy(F.col("b").alias("class")).agg(F.collect_set("a").alias("yes"))
    each = at.join(checked(again), "anchor", "left_semi").join(yes, "class", "left").join(grams, "class")
    each = written(each.select("class", "anchor", "grams", F.coalesce("yes", F.array().cast("array<long>")).alias("yes")), "unsettled")
    n, size = F.col("n") / RUN_MOST, F.col("size") / RUN_BYTES
    ways = each.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.octet_length("grams")).alias("size")).where(F.greatest(n, size) > 2).select("anchor", F.ceil(F.greatest(n, size)).cast("int").alias("ways"))
    return linked.unionByName(settled(each, written(ways, "ways"), similarity))


def sets_of(rows: DataFrame, words: int) -> DataFrame:
    """(class, grams): the sorted distinct shingle hashes of the text of each row (class, text); rows that repeat a class count once."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column("text").cast(pa.binary())
            grams = [np.unique(shingle_hashes(x.as_py() if x.is_valid else b"", words)[0]).tobytes() for x in column]
            return pa.RecordBatch.from_arrays([batch.column("class"), pa.array(grams, pa.binary())], ["class", "grams"])

        return each

    return map_batches(rows, make, "class long, grams binary").groupBy("class").agg(F.first("grams").alias("grams"))


def near_copies(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(a, b): links between keys of texts whose sets of shingles of ``words`` words have this Jaccard similarity or more.

    The links connect all such texts of one group; each is exact, and candidates are missed with a chance of some thousandths at the
    similarity itself, and less above it. Of texts of one class the least key takes part, and the others are linked with it.
    An anchor of very many texts is dealt into runs, and every two runs meet in a task, so that no pair is lost and no task has a hot anchor whole;
    the comparisons grow with the square of its distinct texts. Rows with null keys take no part; null, empty and blank texts are one class; repeated rows
    link a key with itself; further columns are not read; an empty table gives an empty one.
    """
    rows = written(profiles(df.where(F.col(key).isNotNull()), key, text, words, words), "profiles")
    found = copies(rows, df, key, text, words, similarity)
    least = written(rows.groupBy("class").agg(F.min("key").alias("least"), F.count("*").alias("n")), "classes")
    name = lambda side, to: least.select(F.col("class").alias(side), F.col("least").alias(to))
    between = found.join(name("a", "x"), "a").join(name("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    equal = salted_join(rows.select("class", "key"), least.select("class", "least"), "class", hot_keys(least, "class", "n", rows.count()), "key").where("key <> least")
    return between.unionByName(equal.select(F.col("least").alias("a"), F.col("key").alias("b")))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, budget: int = 2, similar: tuple[int, float] | None = None) -> DataFrame:
    """``df`` with one row of each near-duplicate group, that of the least key and then of the least hash of its text.

    Groups are linked by fingerprints of ``budget`` or fewer differing bits and, with ``similar`` (words, similarity), by the exact similarity of
    shingle sets too (:func:`copies`). A row stands for its key and text: of rows that repeat both one stays, and a key's
    other texts are judged by themselves. Rows with null keys stay and link nothing. Null, empty and blank texts are one group. Columns that are called as
    those used here (beginning with ``__sw_``) are the only names that clash; an empty table gives an empty one.
    """
    keyed = df.where(F.col(key).isNotNull())
    if similar:
        rows = written(profiles(keyed, key, text, words, similar[0]), "profiles")
    else:
        version = keyed.select(F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("version")).alias("id"), F.col(text).alias("text"))
        rows = written(fingerprints(version, "id", "text", words).select("key.*", "fp"), "fingerprints")
    ids = written(rows.groupBy("fp").agg(F.min(F.struct("key", "version")).alias("least"), F.count("*").alias("n")), "classes")
    edges = links(ids.select("fp"), budget)
    if similar:
        # classes by their least fingerprint, which is linked with the class's others
        fps = written(rows.groupBy("class").agg(F.min("fp").alias("fp"), F.collect_set("fp").alias("fps")), "fps")
        found = written(copies(rows, keyed, key, text, *similar), "copies")
        n = found.count()
        for side in ("a", "b"):
            hot = hot_keys(found.groupBy(side).agg(F.count("*").alias("n")), side, "n", n)
            found = salted_join(found, fps.select(F.col("class").alias(side), F.col("fp").alias(f"{side}_fp")), side, hot, "b" if side == "a" else "a")
        within = fps.where(F.size("fps") > 1).select(F.col("fp").alias("a"), F.explode("fps").alias("b"))
        edges = edges.unionByName(within).unionByName(found.select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")))
    rooted = written(roots_of(ids, edges), "rooted")
    kept = rooted.groupBy("root").agg(F.min("least").alias("kept"))
    of_fp = rooted.join(kept, "root").select("fp", "kept")
    each = salted_join(rows.select("key", "version", "fp"), of_fp, "fp", hot_keys(ids, "fp", "n", rows.count()), "key")
    gone = each.where((F.col("key") != F.col("kept.key")) | (F.col("version") != F.col("kept.version")))
    gone = written(gone.select(F.col("key").alias("__sw_key"), F.col("version").alias("__sw_version")).distinct(), "gone")
    twice = written(rows.groupBy("key", "version").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("__sw_key"), F.col("version").alias("__sw_version")), "twice")
    named = df.withColumn("__sw_key", F.col(key)).withColumn("__sw_version", F.xxhash64(text))
    left = named.join(checked(gone), ["__sw_key", "__sw_version"], "left_anti")
    if not twice.isEmpty():
        both = ["__sw_key", "__sw_version"]
        left = left.join(checked(twice), both, "left_anti").unionByName(left.join(checked(twice), both, "left_semi").dropDuplicates(both))
    return left.select(*df.columns)
