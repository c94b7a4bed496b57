"""Addresses, statuses and messages: small rules as Columns."""

from __future__ import annotations

import json
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Addresses that can't be captured; and one more of another browser.
BLOCKED = ("chrome://", "chrome-extension://", "about:", "edge://", "brave://")
BLOCKED_EXTENDED = (*BLOCKED, "moz-extension://")
# Statuses, and words of errors after which another backend is tried.
STATUSES = ("loading", "ready", "error")
RUN_WORDS = ("WebGPU", "JSEP", "FILTER_IN_CHANNEL", "Conv")
START_WORDS = ("WebGPU", "JSEP")
TARGET = "offscreen"


def capturable(url: Column, prefixes: tuple[str, ...] = BLOCKED) -> Column:
    """False for null, empty, and addresses that begin with one of ``prefixes``; case counts."""
    blocked = reduce(lambda a, b: a | b, [F.startswith(url, F.lit(p)) for p in prefixes])
    return F.coalesce((url != "") & ~blocked, F.lit(False))


def capturable_rows(df: DataFrame, spark: SparkSession, url: str = "url") -> DataFrame:
    """The same as a left anti join with the handful of prefixes, which is broadcast; rows without an address go."""
    prefixes = F.broadcast(spark.createDataFrame([(p,) for p in BLOCKED], "prefix string"))
    return df.where(F.col(url) != "").join(prefixes, F.startswith(F.col(url), F.col("prefix")), "left_anti")


def falsy_default(value: Column, default: str) -> Column:
    """The default for null and the empty string."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def payload_field(payload: Column, path: str, default: str | None = None) -> Column:
    """A field of a JSON payload, or the default where it is missing or null."""
    found = F.get_json_object(payload, path)
    return found if default is None else F.coalesce(found, F.lit(default))


def known_status(status: Column) -> Column:
    return F.when(status.isin(*STATUSES), status).otherwise("unknown")


def text_or(payload: Column, key: str, default: str) -> Column:
    """A field if it is a JSON string, else the default."""
    value = F.try_variant_get(F.try_parse_json(payload), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(F.try_parse_json(payload), f"$.{key}", "string")).otherwise(default)


def retries_elsewhere(device: Column, message: Column, words: tuple[str, ...]) -> Column:
    """Whether an error on the GPU backend has one of the words."""
    return F.coalesce((device == "webgpu") & reduce(lambda a, b: a | b, [F.contains(message, F.lit(w)) for w in words]), F.lit(False))


def route(kind: Column, target: Column | None = None) -> Column:
    """Who a message goes to: the first rule that holds; ``none`` for unknown types."""
    out = F.when(kind.isin("start-transcription", "stop-transcription"), "recorder").when(kind.isin("get-recording-state"), "reply").when(kind.isin("recording-state", "transcript", "model-status", "capture-error"), "panel")
    out = out.when(kind == "offscreen-ready", "starter").otherwise("none")
    return out if target is None else F.when(target == TARGET, "offscreen").otherwise(out)


def start_outcome(url: Column, has_context: Column, context_made: Column, handle: Column) -> Column:
    """What a request to start gives: ``start`` at once where a context exists, else ``wait`` for the one that is made to be ready.

    A context that can't be made, an address that can't be captured and a stream without a handle are a ``capture-error`` each;
    with a new context the address and the handle are looked at once it is ready. Nulls count as false.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    waits = F.when(yes(context_made), "wait").otherwise("capture-error")
    return F.when(~yes(has_context), waits).when(capturable(url) & yes(handle != ""), "start").otherwise("capture-error")


#: The largest whole number that a reader's double holds with all below it; ids count up to it and begin again.
SAFE = (1 << 53) - 1


def pretty(value: object, indent: str = "") -> str:
    """A JSON value by lines with two blanks for each level, as readers' browsers write it: keys that are whole numbers first, and whole doubles without a point."""
    inner = indent + "  "
    if isinstance(value, dict):
        numbers = sorted((k for k in value if k.isdecimal() and k == str(int(k)) and int(k) < (1 << 32) - 1), key=int)
        items = [f"{json.dumps(k, ensure_ascii=False)}: {pretty(value[k], inner)}" for k in [*numbers, *[k for k in value if k not in set(numbers)]]]
    elif isinstance(value, list):
        items = [pretty(x, inner) for x in value]
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        return number_text(float(value))
    else:
        return json.dumps(value, ensure_ascii=False)
    begin, end = "{}" if isinstance(value, dict) else "[]"
    return f"{begin}\n{inner}" + f",\n{inner}".join(items) + f"\n{indent}{end}" if items else begin + end


def number_text(x: float) -> str:
    """A double in its shortest form: digits up to 10^21, else with an exponent."""
    if x in (float("inf"), float("-inf")):
        return "null"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, exponent = repr(x).partition("e")
    if not exponent:
        return digits
    if -7 < int(exponent) < 0:
        return f"{x:.{len(digits.replace('.', '').replace('-', '')) - 1 - int(exponent)}f}"
    return f"{digits.removesuffix('.0')}e{'+' if int(exponent) > 0 else '-'}{abs(int(exponent))}"


def rendered(text: Column) -> Column:
    """What is shown for a JSON value: text as it is, objects and lists by lines, other values in short; null and what is no JSON are empty."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        out = []
        for x in column.to_pylist():
            try:
                value = None if x is None else json.loads(x)
            except (ValueError, RecursionError):
                value = None
            out.append("" if value is None else value if isinstance(value, str) else pretty(value))
        return pa.array(out, pa.string())

    return run(text)
