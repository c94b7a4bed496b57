"""Mixing sources to target weights with exact budgets of words.

Each row has a hash-random key; rows are ranged by key within their source, and where a row's words
stand in its source follows from distributed prefix sums: words are summed by key range, ranges are
summed up within the source, and rows are only put in order within one key range.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scribewell.operators.segments import running_sum, segmented

from .common import checked, map_batches, written

#: Rows in a key range, about: a window sorts one range at a time.
RANGE_ROWS = 4096
#: The weights that sources take in turn, what is mixed of all words, and the most of a source.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
#: Words as runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def budgets(sources: DataFrame, weights: tuple, share: float, most: float) -> DataFrame:
    """``sources`` (source, s, n; a written table) with target: budgets by weight that add up to ``share`` of all sizes, none over ``most`` times its size, the excess going to the others by weight.

    Sources in code point order, null last, take ``weights`` in turn; they are numbered by ranges, so no task has them all. Each round
    finds which are full at what a weight of one is worth so far, and what is left for the others; the driver gets sums only.
    """
    numbered = running_sum(segmented(sources.select("*", F.lit(0).alias("stream_id"), F.isnull("source").alias("last"), F.lit(1).alias("one")), "last", "source"), "one", "number", "last", "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    weighed = written(numbered.select("source", "s", "n", weight.cast("double").alias("w")), "weighed")
    every = weighed.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()
    total, open_, n_full = share * every["s"], every["w"], -1
    per, limit = total / open_ if open_ else 0.0, F.col("s") * most
    while open_:
        full = F.lit(per) * F.col("w") > limit
        now = weighed.agg(F.count(F.when(full, 1)).alias("n"), F.coalesce(F.sum(F.when(full, limit)), F.lit(0.0)).alias("given"), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0)).alias("open")).first()
        if now["n"] == n_full:
            break
        n_full, open_ = now["n"], now["open"]
        if open_:
            per = (total - now["given"]) / open_
    return weighed.select("source", "s", "n", F.when((F.lit(per) * F.col("w") > limit) | F.lit(not open_), limit).otherwise(F.lit(per) * F.col("w")).alias("target"))


def size_of(text: str) -> Column:
    """The number of words of a text; null has none."""
    size = F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))), F.lit(0))
    return F.when(F.col(text).isNull(), 0).otherwise(size).cast("long")


def digest_of(key: Column, size: Column, seed: str) -> Column:
    """The hash-random key by which the rows of a source are put in order; rows that tie have equal keys and sizes."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")), size.cast("string")))


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix") -> DataFrame:
    """``key``, source, size, source_size, target, taken of every row of ``df``.

    ``size`` is the text's number of words (null: 0). Sources in code point order, null last, take
    ``weights`` in turn. A source gives whole epochs and, of one more, the words up to its budget: the row in which
    the budget ends is cut, so that ``taken`` adds up to the whole part of the target. The order is by the MD5 of seed, key and size, so reruns
    agree. Null keys hash like a string of their own; rows that are repeated share a key and are taken in turn; empty
    texts are taken with no words; further columns are not read; an empty table gives an empty one.
    """
    name = F.col(source).cast("string")
    rows = df.select(F.col(key).alias("key"), name.alias("source"), size_of(text).alias("size")).withColumn("digest", digest_of(F.col("key"), F.col("size"), seed))
    rows = written(rows, "sizes")
    sources = written(rows.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")), "sources")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("n") / RANGE_ROWS)))).cast("int")
    plan = written(budgets(sources, weights, share, most).select(F.col("source").alias("p_source"), F.col("s").alias("source_size"), "target", bits.alias("bits")), "budgets")
    # key ranges: the first bits of the digest, more of them for a source with more rows
    lead = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    same = F.col("source").eqNullSafe(F.col("p_source"))
    placed = rows.join(checked(plan), same).drop("p_source").withColumn("lead", lead).withColumn("part", F.expr("shiftrightunsigned(lead, 32 - bits)"))
    parts = placed.groupBy("source", "part").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("source").alias("q_source"), F.col("part").alias("q_part"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("begin"))
    within = Window.partitionBy("source", "part").orderBy("digest", "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    both = ordered.join(parts, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("part") == F.col("q_part")))
    # whole epochs, and of one more the words below the rest of the budget
    goal = F.floor(F.col("target") + F.lit(1e-6))
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)
    rest = goal - epochs * F.col("source_size")
    cut = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), rest - F.col("begin") - F.col("start")))
    return both.select(F.col("key").alias(key), F.col("source"), "size", "source_size", "target", (epochs * F.col("size") + cut).cast("long").alias("taken"))


def take(df: DataFrame, mixed: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """The mixture's rows with the columns of ``df``: each row as often as ``mixed`` takes all of it, and cut where its budget ends.

    ``mixed`` is what :func:`mix` gives for ``df`` and ``seed``. A source's extra epoch ends at one digest, so a row's own digest tells how
    often it is taken; only those digests, one row for each source, go to the rows, and no text is shuffled. Rows that are not
    taken go. A row of no words stays once. Repeated rows in which a budget ends share what is left of it evenly, rounded down.
    """
    size, epochs = F.col("size"), F.floor(F.floor(F.col("target") + F.lit(1e-6)) / F.col("source_size"))
    each = mixed.where(size > 0).select(F.col(source).cast("string").alias("__sw_source"), digest_of(F.col(key), size, seed).alias("digest"), epochs.alias("__sw_epochs"), (F.col("taken") - epochs * size).alias("extra"))
    ends = written(each.groupBy("__sw_source").agg(F.max("__sw_epochs").alias("__sw_epochs"), F.max(F.when(F.col("extra") > 0, F.col("digest"))).alias("__sw_end")), "ends")
    at_end = each.drop("__sw_epochs").join(checked(ends).select(F.col("__sw_source").alias("s"), "__sw_end"), F.col("__sw_source").eqNullSafe(F.col("s")) & (F.col("digest") == F.col("__sw_end")))
    shares = at_end.groupBy("s").agg(F.floor(F.avg("extra")).alias("__sw_share"))
    plan = written(ends.join(checked(written(shares, "shares")), F.col("__sw_source").eqNullSafe(F.col("s")), "left").drop("s"), "plan")
    # words are counted once more: that is less than to shuffle the texts
    counted = df.withColumn("__sw_size", size_of(text)).withColumn("__sw_digest", digest_of(F.col(key), F.col("__sw_size"), seed))
    both = counted.join(checked(plan), F.col(source).cast("string").eqNullSafe(F.col("__sw_source")), "left")
    end, full = F.col("__sw_end"), F.coalesce(F.col("__sw_epochs"), F.lit(0))
    part = F.when(F.col("__sw_digest") == end, F.col("__sw_share"))
    times = F.when(F.col("__sw_size") == 0, 1).otherwise(full + F.when(F.col("__sw_digest") < end, 1).when(part > 0, 1).otherwise(0)).cast("int")
    copies = both.withColumn("__sw_copy", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>"))))
    words = F.when((F.col("__sw_size") > 0) & (F.col("__sw_copy") > full) & (part < F.col("__sw_size")), part)
    return cut_words(copies.withColumn("__sw_words", words).select(*df.columns, "__sw_words"), text, "__sw_words")


def cut_words(df: DataFrame, text: str, words: str) -> DataFrame:
    """``df`` without the column ``words``: where that isn't null, ``text`` ends after so many words.

    Null texts stay null, repeated rows are each cut, texts of fewer words stay whole, and an empty table gives an empty one.
    """
    names = [c for c in df.columns if c != words]

    def make():
        pattern = re.compile(WORD)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.column(words)
            if n.null_count < len(n):
                at = batch.schema.get_field_index(text)
                out = [t if k is None or t is None else upto(pattern, t, k) for t, k in zip(batch.column(at).to_pylist(), n.to_pylist(), strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
            return batch.select(names)

        return each

    return map_batches(df, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != words))


def upto(pattern: re.Pattern, text: str, n: int) -> str:
    end = 0
    for k, m in enumerate(pattern.finditer(text), 1):
        if k > n:
            break
        end = m.end()
    return text[:end]
