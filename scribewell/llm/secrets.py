"""Secret scans by an incremental blob ledger: each distinct text is scanned once for each version of the rules.

A blob is a text under its SHA-256. The ledger is a Parquet table of (blob, rules) pairs that were
scanned, with what was found; a scan reads which pairs are missing, scans those blobs, appends to the ledger,
and joins the findings back to every row (path) that holds the blob.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checked, exists, hot_keys, map_batches, salted_join, shared_folder, written

# The base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
# Words one of which every assign match begins with.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Added rules: private key blocks, JSON web tokens, and access tokens with a fixed prefix.
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END (?:[A-Z]+ )*PRIVATE KEY-----)?")
JWT_PART, JWT_BEGIN, JWT_LEAST = re.compile(r"[A-Za-z0-9_-]+"), re.compile(r"\beyJ"), 10
PREFIXED = re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})")
BASE_KINDS = ("assign", "access", "hex")
LEDGER = "sha binary, rules string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
#: A maximal run of 16 or more is what HEX finds and LEAST leaves.
_HEX_LONG = re.compile(r"[0-9a-f]{16,}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules' matches, in code points, ordered by start and then kind."""
    out = []
    lower = text.lower()
    if any(w in lower for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in _HEX_LONG.finditer(text)]
    return sorted(out)


def private_keys(text: str) -> Iterator[tuple[int, int]]:
    if "PRIVATE KEY-----" in text:
        yield from (m.span() for m in PRIVATE_KEY.finditer(text))


def web_tokens(text: str) -> Iterator[tuple[int, int]]:
    """JSON web tokens: three runs of their signs with a dot between, of which the first two begin with eyJ; each run is gone through once."""
    if "eyJ" not in text:
        return
    before: list[tuple[int, int]] = []
    for m in JWT_PART.finditer(text):
        a, b = m.span()
        before = [*before[-1:], (a, b)] if len(before) < 2 or a != before[-1][1] + 1 or text[a - 1] != "." else [*before[-2:], (a, b)]
        if len(before) < 3 or before[1][0] != before[0][1] + 1 or text[before[0][1]] != ".":
            continue
        (first, end), (second, second_end), _ = before
        begins = text.startswith("eyJ", second) and second_end - second >= 3 + JWT_LEAST and b - a >= JWT_LEAST
        if begins and (start := JWT_BEGIN.search(text, first, end)) and end - start.start() >= 3 + JWT_LEAST:
            yield start.start(), b
            before = []


def prefixed_tokens(text: str) -> Iterator[tuple[int, int]]:
    yield from (m.span() for m in PREFIXED.finditer(text))


@dataclass(frozen=True)
class Rules:
    """Rules beside the base ones: kinds with what finds their spans. The version is a part of the ledger's key, so that a change of it scans every blob again."""

    version: str
    added: tuple[tuple[str, Callable[[str], Iterable[tuple[int, int]]]], ...]

    @property
    def kinds(self) -> tuple[str, ...]:
        return (*BASE_KINDS, *[kind for kind, _ in self.added])

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the added kinds."""
        return [(a, k, b) for k, (_, find) in enumerate(self.added, len(BASE_KINDS)) for a, b in find(text)]


RULES = Rules("1", (("private_key", private_keys), ("jwt", web_tokens), ("prefixed", prefixed_tokens)))


def joined(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = RULES.kinds) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(blobs: DataFrame, rules: Rules = RULES) -> DataFrame:
    """The ledger's rows for ``blobs`` (sha, text)."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for x in batch.column("text"):
                text = x.as_py()
                base = base_spans(text)
                for k, c in enumerate(("n_assign", "n_access", "n_hex")):
                    out[c].append(sum(s[1] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(base + rules.spans(text), rules.kinds))
            version = pa.array([rules.version] * batch.num_rows, pa.string())
            columns = [pa.array(v, pa.int64() if c[1] == "_" else pa.string()) for c, v in out.items()]
            return pa.RecordBatch.from_arrays([batch.column("sha"), version, *columns], ["sha", "rules", *out])

        return each

    return map_batches(blobs, make, LEDGER)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; where there is none yet, an empty one is laid down, so that a reader always finds a table."""
    if not exists(spark, path):
        spark.createDataFrame([], LEDGER).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def sha_of(text: str) -> Column:
    """The blob of a text; null is the empty text."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def update(df: DataFrame, ledger: str, text: str = "text", rules: Rules = RULES) -> DataFrame:
    """Scans the blobs of ``df`` that the ledger at ``ledger`` doesn't have for ``rules``; returns what it then has for these, a row for each blob.

    Null texts are the empty text, which is a blob like any other; repeated rows are one blob; an empty table adds nothing; further columns, whatever
    their names, are not read. Other versions of the rules keep their rows in the ledger.
    """
    spark = df.sparkSession
    done = read_ledger(spark, ledger).where(F.col("rules") == rules.version).select("sha")
    # copies fall together in each task before anything is shuffled; an anti join would be pushed below that
    blobs = df.select(sha_of(text).alias("sha"), F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("sha").agg(F.first("text").alias("text"))
    unseen = blobs.join(done.distinct().withColumn("seen", F.lit(True)).hint("merge"), "sha", "left").where(F.col("seen").isNull()).drop("seen")
    scan(unseen, rules).write.mode("append").parquet(ledger)
    return read_ledger(spark, ledger).where(F.col("rules") == rules.version).drop("rules").dropDuplicates(["sha"])


def scan_documents(df: DataFrame, ledger: str, key: str = "doc_id", text: str = "text", rules: Rules = RULES) -> DataFrame:
    """``key``, n_assign, n_access, n_hex, base_sha256, spans of every row of ``df``, by way of the ledger at ``ledger``.

    Null texts are empty texts. Blobs that the ledger has for these rules aren't scanned again; the others are
    scanned once however many rows hold them. Null keys and repeated rows stay; further columns are
    not read; an empty table gives an empty one.
    """
    found = update(df, ledger, text, rules)
    rows = written(df.select(F.col(key).alias("key"), sha_of(text).alias("sha")), "paths")
    counts = rows.groupBy("sha").agg(F.count("*").alias("n"))
    out = salted_join(rows, found, "sha", hot_keys(counts, "sha", "n", rows.count()), "key")
    return out.select(F.col("key").alias(key), "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def new_ledger(spark: SparkSession) -> str:
    """A path for a ledger of one run, in the shared folder."""
    return f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"


def mask(df: DataFrame, found: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with each span that ``found`` (rows of :func:`update`) has for its ``text`` replaced by ``mark``; other rows stay as they are.

    Null texts stay null and repeated rows are each masked; an empty ``df`` gives an empty one, and an empty ``found`` changes nothing.
    ``df`` has no columns named ``__sw_sha`` or ``__sw_spans``; all others go through as they are.
    """
    spans = "__sw_spans"

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.schema.get_field_index(text)
            has = batch.column(spans)
            if has.null_count < len(has):
                out = [t if s is None else masked(t, s, mark) for t, s in zip(batch.column(at).to_pylist(), has.to_pylist(), strict=True)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type))
            return batch.select([x for x in batch.schema.names if x != spans])

        return each

    hits = written(found.where(F.col("spans") != "").select(F.col("sha").alias("__sw_sha"), F.col("spans").alias(spans)), "hits")
    both = df.withColumn("__sw_sha", sha_of(text)).join(checked(hits), "__sw_sha", "left").drop("__sw_sha")
    return map_batches(both, make, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields))


def masked(text: str, spans: str, mark: str) -> str:
    """``text`` with the union of the spans (kind:start:end, ...) replaced, each run of overlapping ones by one ``mark``."""
    ranges: list[list[int]] = []
    for a, b in sorted(tuple(map(int, s.split(":")[1:])) for s in spans.split(",")):
        if ranges and a < ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], b)
        else:
            ranges.append([a, b])
    out, at = [], 0
    for a, b in ranges:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])
