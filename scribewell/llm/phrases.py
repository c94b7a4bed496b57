"""Phrase collocations: frequent word sequences, mined in partitions by their rarest word.

Words are ordered by how often they are there. A text goes to the partition of each of its words (the pivot) as
the fragment around it, cut off where a rarer word stands: that is all that sequences with this word as their rarest can
be made of. A partition counts the sequences of its pivot alone, so each is counted in one place, and longer ones only
where their parts are frequent. Fragments of very frequent pivots are dealt out, and their counts added up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import HOT_SHARE, checked, small_batches, written

# Words of a phrase at most, how often it is there at least, the share of it (in hundredths) that a longer one makes
# up to take its place, the factor of scores, and phrases of a language.
WORDS, LEAST, COVERED, SCALE, TOP = 4, 30, 80, 2_000_000, 2000
#: The language of rows without one.
NO_LANG = "und"
#: Where texts are split into pieces, and what stands for such a place.
BREAKS, BREAK = b".,;:!?\n\x0b\x0c\r", b"."
_FOLD = bytes.maketrans(bytes(range(65, 91)) + BREAKS, bytes(range(97, 123)) + BREAK * len(BREAKS))
#: Words that every task knows by rank. Rarer ones are ordered by a hash, behind all of these.
LISTED = 1 << 18
#: Steps of a doubling by which counts are told apart for the list.
STEPS = 16
#: Words that a task rewrites together, fragments of a partition, and of a pivot before it is dealt out.
CHUNK_WORDS, PART_FRAGMENTS, PIVOT_FRAGMENTS = 1 << 20, 1 << 19, 1 << 20
#: Different words that a task counts before it sends them on.
COUNTED = 1 << 20
_TAIL, _ODD = 1 << 62, np.uint64(0x9E3779B97F4A7C15)


def folded(texts: list[bytes]) -> list[bytes]:
    """The words of all ``texts`` in lower case (A-Z), BREAK between pieces and between texts."""
    return BREAK.join(texts).translate(_FOLD).replace(BREAK, b" . ").split()


def by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """The words of a batch's texts by language."""
    groups: dict[str, list[bytes]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
        if text.is_valid:
            groups.setdefault(NO_LANG if lang is None else lang, []).append(text.as_py())
    for lang, texts in groups.items():
        yield lang, folded(texts)


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) of all words of ``docs`` (text, lang); a task adds its words up before they are shuffled."""

    def rows(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            own.pop(BREAK, None)
            words, n = list(own.keys()), list(own.values())
            for a in range(0, len(words), 65_536):
                part = words[a : a + 65_536]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array(n[a : a + 65_536], pa.int64())], ["lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, words in by_lang(batch):
                counts.setdefault(lang, Counter()).update(words)
            if sum(map(len, counts.values())) > COUNTED:
                yield from rows(counts)
                counts = {}
        yield from rows(counts)
        pa.default_memory_pool().release_unused()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def tail_id(lang: str, word: bytes) -> int:
    """What stands for a word that isn't listed; the same as :func:`tail_column`."""
    import xxhash

    return _TAIL | xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang.encode(), 42)) >> 2


def tail_column() -> Column:
    return F.shiftrightunsigned(F.xxhash64("lang", "word"), 2).bitwiseOR(F.lit(_TAIL))


class Order:
    """Ids of words, greater for rarer ones: the listed ones by their counts, all others by hash behind them."""

    def __init__(self, words: DataFrame, least: int, listed: int = LISTED):
        """``words`` (lang, word, n) is a written table. Words of a hash that others have too are listed as well, with those below ``least`` as nothing."""
        frequent = words.where(F.col("n") >= least)
        step = F.floor(F.log2("n") * STEPS).cast("int")
        sizes = sorted(((r["step"], r["n"]) for r in frequent.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
        from_, held = None, 0
        for at, n in sizes:
            if held + n > listed:
                break
            from_, held = at, held + n
        #: Whether all frequent words are listed, so that others aren't frequent.
        self.complete = len(sizes) == 0 or (from_ is not None and from_ == sizes[-1][0])
        top = frequent.where(step >= from_) if from_ is not None else frequent.limit(0)
        # columns, not rows: the list is all that the driver holds of the words
        rows = top.select("lang", "word", "n").toArrow().sort_by([("n", "descending"), ("lang", "ascending"), ("word", "ascending")])
        self.ids: dict[str, dict[bytes, int]] = {}
        for k, (lang, word) in enumerate(zip(rows["lang"].to_pylist(), rows["word"].cast(pa.binary()).to_pylist(), strict=True)):
            self.ids.setdefault(lang, {})[word] = k
        #: How often the listed words are there.
        self.counts = rows["n"].to_numpy().astype(np.int64)
        if not self.complete:
            hashed = words.withColumn("id", tail_column())
            clash = written(hashed.groupBy("id").agg(F.count("*").alias("k"), F.max("n").alias("m")).where((F.col("k") > 1) & (F.col("m") >= least)).select("id"), "clashes")
            more = [r for r in hashed.join(checked(clash), "id", "left_semi").orderBy("lang", "word").collect() if r["word"].encode() not in self.ids.get(r["lang"], {})]
            for k, r in enumerate(more):
                self.ids.setdefault(r["lang"], {})[r["word"].encode()] = (_TAIL - 1 - k) if r["n"] >= least else -1

    def rewritten(self, lang: str, words: list[bytes]) -> np.ndarray:
        """Ids of ``words``; -1 for breaks and for words that can't be in a frequent phrase."""
        own = self.ids.get(lang, {})
        unknown = -1 if self.complete else -2
        ids = np.fromiter((own.get(w, unknown) for w in words), np.int64, len(words))
        if not self.complete:
            known: dict[bytes, int] = {BREAK: -1}
            for i in np.nonzero(ids == -2)[0].tolist():
                w = words[i]
                if (k := known.get(w)) is None:
                    k = known[w] = tail_id(lang, w)
                ids[i] = k
        return ids

    def ways(self, total: int) -> np.ndarray:
        """In how many ways the fragments of each listed word are dealt out: by how often it is likely to stand beside a word as frequent as itself."""
        share = np.cumsum(self.counts) / max(1, total)
        fragments = self.counts * (1 - (1 - share) ** 2)
        return np.ceil(fragments / min(PIVOT_FRAGMENTS, max(4096, total * HOT_SHARE))).astype(np.int64).clip(1)


def fragments(ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(fragments, weights): of each word that has a neighbour as frequent as itself the words around it, -1 beyond them; equal ones once.

    The word stands in the middle, at ``most - 1``. To its left all are more frequent, to its right none is rarer, so that a sequence in
    which its rarest word stands twice belongs to the first of them.
    """
    side = most - 1
    padded = np.concatenate([np.full(side, -1), ids, np.full(side, -1)])
    out = np.full((len(ids), 2 * side + 1), -1, np.int64)
    out[:, side] = ids
    for step in (-1, 1):
        open_ = ids >= 0
        for d in range(1, most):
            other = padded[side + step * d : side + step * d + len(ids)]
            open_ = open_ & (other >= 0) & ((other < ids) if step < 0 else (other <= ids))
            out[open_, side + step * d] = other[open_]
    out = out[(out[:, side - 1] >= 0) | (out[:, side + 1] >= 0)] if side else out[:0]
    mixed = np.zeros(len(out), np.uint64)
    for j in range(out.shape[1]):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _ODD + out[:, j].view(np.uint64)
    out = out[np.argsort(mixed)]
    begin = np.nonzero(np.concatenate([np.ones(min(1, len(out)), bool), (out[1:] != out[:-1]).any(axis=1)]))[0]
    return out[begin], np.diff(begin, append=len(out))


def packed(rows: np.ndarray, weights: np.ndarray) -> bytes:
    """Fragments as bytes: the different words, and for each reach to the left and right the rows' places in these."""
    words, code = np.unique(rows, return_inverse=True)
    code = code.reshape(rows.shape)
    kind = "<u2" if len(words) <= 1 << 16 else "<u4"
    there = rows >= 0
    side = rows.shape[1] // 2
    left, right = there[:, :side].sum(axis=1), there[:, side + 1 :].sum(axis=1)
    reach = left * (side + 1) + right
    heads, body = [], []
    for k in np.unique(reach).tolist():
        own = reach == k
        a, b = side - k // (side + 1), side + k % (side + 1) + 1
        heads += [k, int(own.sum())]
        body += [code[own, a:b].astype(kind).T.tobytes(), weights[own].astype("<i4").tobytes()]
    return b"".join([np.array([len(words), len(heads), *heads], "<i8").tobytes(), words.astype("<i8").tobytes(), *body])


def unpacked(blob: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of :func:`packed`, the rows as places in these (-1 beyond a fragment), and their weights."""
    n, m = np.frombuffer(blob, "<i8", 2).tolist()
    heads = np.frombuffer(blob, "<i8", m, 16).tolist()
    words = np.frombuffer(blob, "<i8", n, 16 + 8 * m)
    at, kind, side = 16 + 8 * (m + n), np.dtype("<u2" if n <= 1 << 16 else "<u4"), width // 2
    rows, weights = [], []
    for k, count in zip(heads[::2], heads[1::2], strict=True):
        a, b = side - k // (side + 1), side + k % (side + 1) + 1
        own = np.full((count, width), -1, np.int64)
        own[:, a:b] = np.frombuffer(blob, kind, count * (b - a), at).reshape(b - a, count).T
        at += count * (b - a) * kind.itemsize
        rows.append(own)
        weights.append(np.frombuffer(blob, "<i4", count, at).astype(np.int64))
        at += 4 * count
    return words, np.concatenate(rows), np.concatenate(weights)


def mined(rows: np.ndarray, weights: np.ndarray, n_words: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sequences, counts) of the sequences around the middle word that are there ``least`` times, level by level; a sequence is looked at only where its parts have passed."""
    side = rows.shape[1] // 2
    passed = {(0, 0): rows[:, side]}
    for size in range(2, side + 2):
        for left in range(size):
            right = size - 1 - left
            # by their own words and those of the sequence without its outermost one
            before, new = (passed.get((left - 1, right)), rows[:, side - left]) if left else (passed.get((0, right - 1)), rows[:, side + right])
            other = passed.get((left, right - 1)) if left and right else before
            if before is None or other is None:
                continue
            open_ = np.nonzero((before >= 0) & (other >= 0) & (new >= 0))[0]
            if not len(open_):
                continue
            _, first, code = np.unique(before[open_] * n_words + new[open_], return_index=True, return_inverse=True)
            counts = np.bincount(code, weights[open_]).astype(np.int64)
            good = counts >= least
            if not good.any():
                continue
            yield rows[open_[first[good]], side - left : side + right + 1], counts[good]
            here = np.full(len(rows), -1, np.int64)
            here[open_] = np.where(good[code], code, -1)
            passed[left, right] = here


def sequences(docs: DataFrame, order: Order, total: int, most: int = WORDS, least: int = LEAST) -> DataFrame:
    """(ids, a): the sequences of two to ``most`` words that are at least ``least`` times in ``docs`` (text, lang), which has ``total`` words."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, total // PART_FRAGMENTS)
    shared = spark.sparkContext.broadcast((order, order.ways(total)))
    width = 2 * most - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, ways = shared.value

        def rows(held: list[np.ndarray]) -> pa.RecordBatch:
            own, weights = fragments(np.concatenate(held), most)
            pivot = own[:, most - 1]
            n = np.where(pivot < len(ways), ways[np.minimum(pivot, len(ways) - 1)], 1) if len(ways) else np.ones(len(own), np.int64)
            # a fragment of a pivot that is dealt out goes by its other words
            salt = np.zeros(len(own), np.uint64)
            for j in range(width):
                salt = (salt ^ (salt >> np.uint64(29))) * _ODD + own[:, j].view(np.uint64)
            salt = (salt ^ (salt >> np.uint64(32))) % n.astype(np.uint64)
            place = (pivot.view(np.uint64) + np.uint64(1)) * _ODD + salt * np.uint64(0xC2B2AE3D27D4EB4F)
            place = ((place ^ (place >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)
            part = (place % np.uint64(parts)).astype(np.int64) + parts * (n > 1)
            at = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[at], np.arange(2 * parts + 1))
            full = np.nonzero(np.diff(cuts))[0].tolist()
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int64()), pa.array([packed(own[at[cuts[k] : cuts[k + 1]]], weights[at[cuts[k] : cuts[k + 1]]]) for k in full], pa.binary())], ["part", "data"])

        held, size = [], 0
        for batch in batches:
            for lang, words in by_lang(batch):
                held += [order.rewritten(lang, words), np.array([-1])]
                size += len(words)
            if size > CHUNK_WORDS:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)
        pa.default_memory_pool().release_unused()

    def count(blobs: list[bytes], least: int) -> Iterator[pa.RecordBatch]:
        found = [unpacked(b, width) for b in blobs]
        words = np.unique(np.concatenate([w for w, _, _ in found]))
        # -1 stays beyond fragments
        rows = np.concatenate([np.where(r >= 0, np.searchsorted(words, w)[r], -1) for w, r, _ in found])
        weights = np.concatenate([n for _, _, n in found])
        for own, counts in mined(rows, weights, len(words), least):
            for a in range(0, len(own), 65_536):
                ids = words[own[a : a + 65_536]]
                offsets = pa.array(np.arange(0, ids.size + 1, ids.shape[1]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(ids.ravel(), pa.int64())), pa.array(counts[a : a + 65_536], pa.int64())], ["ids", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = -1, []
        enough = lambda part: least if part < parts else 1  # noqa: E731  what is dealt out is complete only when added up
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("data"), strict=True):
                if part != now and held:
                    yield from count(held, enough(now))
                    held = []
                now = part
                held.append(blob.as_py())
        if held:
            yield from count(held, enough(now))
        pa.default_memory_pool().release_unused()

    small_batches(spark)
    dealt = docs.mapInArrow(deal, "part long, data binary").repartition(max(tasks, min(2 * parts, 20_000)), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "ids array<long>, a long").groupBy("ids").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def scored(grams: DataFrame, singles: DataFrame, covered: int = COVERED, scale: int = SCALE) -> DataFrame:
    """(ids, a, k, l, r, score): ``grams`` (ids, a) that no longer one covers, at the cut with the lowest score.

    ``singles`` (id, n) are the counts of single words. Decimals hold the products, which may pass 64 bits.
    """
    size = F.size("ids")
    inner = F.expr("flatten(transform(sequence(2, size(ids) - 1), m -> transform(sequence(1, size(ids) - m + 1), s -> slice(ids, s, m))))")
    parts = grams.where(size > 2).select(F.explode(F.array_distinct(inner)).alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("longer"))
    hidden = F.coalesce(F.col("longer").cast("decimal(20,0)") * 100 >= F.col("a").cast("decimal(20,0)") * covered, F.lit(False))
    left = grams.join(parts, "ids", "left").where(~hidden).select("ids", "a")
    counts = grams.unionByName(singles.select(F.array("id").alias("ids"), F.col("n").alias("a")))
    cuts = left.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.expr("slice(ids, 1, k)").alias("first"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("rest"))
    cuts = cuts.join(counts.select(F.col("ids").alias("first"), F.col("a").alias("l")), "first").join(counts.select(F.col("ids").alias("rest"), F.col("a").alias("r")), "rest")
    score = F.expr(f"(CAST(a AS DECIMAL(20,0)) * {scale}) DIV (CAST(l AS DECIMAL(20,0)) + r)").cast("long")
    return cuts.groupBy("ids", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")).select("ids", "a", "cut.*")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", most: int = WORDS, least: int = LEAST, covered: int = COVERED, scale: int = SCALE, top: int = TOP, listed: int = LISTED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` phrases.

    Texts are lower-cased (A-Z) and split at BREAKS into pieces, and these into words (runs of anything but spaces and tabs). A phrase has 2 to ``most``
    words and is ``least`` times or more in the pieces of its language, overlaps included: ``a``. ``l`` and ``r`` are the same for its two
    parts at the cut where floor(scale * a / (l + r)), the ``score``, is lowest, the first of such cuts; ``n`` counts the language's words. A
    phrase inside a longer one that makes up ``covered`` hundredths of it is left out. The order is by score, a (both descending) and phrase.
    Rows without a language count as NO_LANG, null and empty texts have no words, repeated rows count each, an
    empty table gives an empty one, and further columns are not read.
    """
    docs = df.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    words = written(word_counts(docs), "words")
    totals = written(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    order = Order(words, least, listed)
    spark = df.sparkSession
    known = pa.table({"lang": pa.array([x for x, own in order.ids.items() for _ in own], pa.string()), "word": pa.array([w.decode() for own in order.ids.values() for w in own], pa.string()), "listed": pa.array([k for own in order.ids.values() for k in own.values()], pa.int64())})
    listing = written(spark.createDataFrame(known), "listed")
    # of bounded size: the list
    named = words.where(F.col("n") >= least).join(F.broadcast(listing), ["lang", "word"], "left").select(F.coalesce("listed", tail_column()).alias("id"), "lang", "word", "n")
    named = written(named, "named")
    grams = written(sequences(docs, order, total, most, least), "sequences")
    best = scored(grams, named, covered, scale)
    in_lang = best.withColumn("id", F.element_at("ids", 1)).join(named.select("id", "lang"), "id").drop("id")
    # phrases that tie with the last one stay until they are known
    worth = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    near = written(in_lang.withColumn("at", F.rank().over(worth)).where(F.col("at") <= top).drop("at"), "best")
    spelled = near.select("ids", F.posexplode("ids").alias("place", "id")).join(named.select("id", "word"), "id")
    phrases = spelled.groupBy("ids").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    whole = near.join(phrases, "ids").join(checked(totals), "lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")
    return whole.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
