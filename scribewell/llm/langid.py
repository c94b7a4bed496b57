"""Language ID by compression: a text's language is that whose raw-content zstandard dictionary makes it smallest.

Dictionaries are cut from a bounded sample of labelled rows. A whole text is encoded block by block
with each of them; sizes add up over the blocks, so a long text counts by all of its blocks. A text whose two smallest
sizes lie too close together is rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: The sample that dictionaries are made of: rows of each language, and characters of each row, at most; and languages.
SAMPLE_ROWS, SAMPLE_CHARS, MOST_LANGUAGES = 256, 256, 500
LEVEL = 6
#: UTF-8 bytes encoded at once: few enough that the dictionary and not the text itself is what is found again.
BLOCK = 4096
#: A text is rejected if the second smallest size is larger by less than this share.
MARGIN = 0.002
UNDETERMINED = "und"
_NO_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Lower case, letters only, single spaces."""
    return _NO_LETTERS.sub(" ", text.lower())


@dataclass(frozen=True)
class Dictionaries:
    """For each language the content that its texts are encoded with; languages with more labelled texts come first."""

    content: dict[str, bytes]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Dictionaries:
    """Dictionaries from the first ``chars`` characters of ``rows`` rows of each label, those with the least hashes.

    Null labels and null texts take no part. The sample that the driver gets is at most languages x rows
    x chars characters, whatever the table's size; over MOST_LANGUAGES labels is an error.
    """
    # the hash is of what is sampled only, so that copies count once
    head = F.substring(text, 1, chars)
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), head.alias("head"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct(F.xxhash64("head"), 0.02).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} labels")
    if not counts:
        return Dictionaries({})
    spark = labelled.sparkSession
    space = 1 << 30
    # about eight times as many rows as wanted, by a hash threshold, before any row is ranked; copies fall together
    below = spark.createDataFrame([(c, min(space, 8 * rows * space // n + 1)) for c, n in counts.items()], "lang string, below long")
    near = known.withColumn("hash", F.xxhash64("head")).join(F.broadcast(below), "lang").where(F.pmod("hash", F.lit(space)) < F.col("below"))
    distinct = near.groupBy("lang", "hash").agg(F.min("head").alias("head"))
    found = distinct.groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.pmod("hash", F.lit(space)).alias("at"), "hash", "head"))), 1, rows).alias("sample"))
    content = {r["lang"]: " ".join(plain(x["head"]) for x in r["sample"]).encode() for r in found.collect()}
    return Dictionaries(dict(sorted(content.items(), key=lambda x: (-counts[x[0]], x[0]))))


class Classifier:
    """Encodes with each dictionary; one for each task."""

    def __init__(self, dictionaries: Dictionaries):
        import zstandard

        self.compressors = []
        for lang, content in dictionaries.content.items():
            data = zstandard.ZstdCompressionDict(content or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(level=LEVEL)
            self.compressors.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False)))

    def sizes(self, text: str) -> list[tuple[int, str]]:
        """The encoded size and the language, smallest first; ties to the language with more labelled texts."""
        total = [0] * len(self.compressors)
        for a in range(0, len(text), 1 << 20):
            data = plain(text[a : a + (1 << 20)]).encode()
            for b in range(0, len(data), BLOCK):
                block = data[b : b + BLOCK]
                for k, (_, c) in enumerate(self.compressors):
                    total[k] += len(c.compress(block))
        return sorted(((n, lang) for n, (lang, _) in zip(total, self.compressors, strict=True)), key=lambda x: x[0])

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether it is rejected. The score is the share that the smallest size saves on the second, doubled, up to 1."""
        if not text or not any(map(str.isalpha, text)) or not self.compressors:
            return UNDETERMINED, 0.0, True
        (best, lang), *rest = self.sizes(text)
        if not rest:
            return lang, 1.0, False
        margin = (rest[0][0] - best) / rest[0][0]
        return lang, min(1.0, 2 * margin), margin < MARGIN


def held_out(key: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(df: DataFrame, dictionaries: Dictionaries, text: str = "text") -> DataFrame:
    """``df`` with lang_pred, score and rejected.

    Null texts and texts with no letter are ``und``, with score 0, and rejected, as is everything if nothing was learned. Repeated rows stay;
    columns of ``df`` with these names are replaced; an empty table gives an empty one.
    """
    new = ["lang_pred", "score", "rejected"]
    kept = [f for f in df.schema.fields if f.name not in new]

    def make():
        model = Classifier(dictionaries)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [model.predict(x) for x in batch.column(text).to_pylist()]
            columns = [pa.array([x[i] for x in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *new])

        return each

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double, rejected boolean"
    return map_batches(df.select(*[F.col(f"`{f.name}`") for f in kept]), make, schema)
