"""Settings records: JSON text to a typed record, with defaults, right-biased merge and migration of the old layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The record's fields with their types and defaults.
FIELDS = {"mode": "string", "transcribeLanguage": "string", "translateTargetLanguage": "string", "includeMicrophone": "boolean", "summarizationLanguage": "string", "whisperModel": "string"}
DEFAULTS = {"mode": "transcribe", "transcribeLanguage": None, "translateTargetLanguage": "english", "includeMicrophone": False, "summarizationLanguage": "english", "whisperModel": "auto"}


def parsed(text: Column) -> Column:
    """The JSON value as a variant; null for null, empty and malformed text."""
    return F.try_parse_json(F.nullif(text, F.lit("")))


def json_type(text: Column) -> Column:
    """object, array, string, number, boolean, null; SQL null if the text is no JSON."""
    kind = F.schema_of_variant(parsed(text))
    return (
        F.when(kind.isNull(), F.lit(None).cast("string"))
        .when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .otherwise("number")
    )


def has_key(text: Column, key: str) -> Column:
    """Whether a JSON object has the key, whatever its value."""
    return F.coalesce(F.array_contains(F.json_object_keys(F.when(json_type(text) == "object", text)), key), F.lit(False))


def is_legacy(text: Column) -> Column:
    """The old layout has ``language`` and no ``mode``."""
    return has_key(text, "language") & ~has_key(text, "mode")


def field(text: Column, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(parsed(text), f"$.{key}", kind)


def field_type(text: Column, key: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(parsed(text), f"$.{key}", "variant"))
    return F.when(has_key(text, key), F.coalesce(kind, F.lit("VOID")))


def truthy(text: Column, key: str) -> Column:
    """False for a missing field, null, false, 0 and the empty string; all else is true, the string "false" too."""
    kind, value = field_type(text, key), field(text, key)
    return F.coalesce(
        F.when(kind == "VOID", False)
        .when(kind == "BOOLEAN", value == "true")
        .when(kind == "STRING", value != "")
        .when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), True)
        .otherwise(value.cast("double") != 0),
        F.lit(False),
    )


def merged(text: Column) -> Column:
    """Stored fields over the defaults: a key that is there wins, with an explicit null too."""
    fields = []
    for name, kind in FIELDS.items():
        stored = field(text, name, kind)
        fields.append(F.when(has_key(text, name), stored).otherwise(F.lit(DEFAULTS[name]).cast(kind)).alias(name))
    return F.struct(*fields)


def unknown(text: Column) -> Column:
    """JSON text of the keys of a stored object that are no fields of the record, with their values as they are; the old layout and what is no object have none.

    A merge keeps such keys: they go beside the record, and :func:`stored_with` writes them back.
    """
    every = F.from_json(F.when((json_type(text) == "object") & ~is_legacy(text), text), "map<string,variant>")
    return F.to_json(F.coalesce(F.map_filter(every, lambda k, v: ~k.isin(*FIELDS)), F.expr("cast(map() AS map<string,variant>)")))


def defaults() -> Column:
    return F.struct(*[F.lit(v).cast(FIELDS[k]).alias(k) for k, v in DEFAULTS.items()])


def migrated(text: Column) -> Column:
    """The record that stored text stands for.

    Null, empty and malformed text and values that are no object are the defaults. In the old layout a
    language is text, null or a list (which is its JSON text here, and no language); any other value, and a list that has "/", can't be read and is the defaults too. What
    stands before a slash counts without the blanks around it, a language without a slash as it is; one other than English means translation.
    """
    language, kind = field(text, "language"), field_type(text, "language")
    base = F.when(F.contains(language, F.lit("/")), F.regexp_replace(F.split_part(language, F.lit("/"), F.lit(1)), r"^\s+|\s+$", "")).otherwise(language)
    is_list = kind.startswith("ARRAY")
    english = (kind == "STRING") & (base == "english")
    old = F.struct(
        F.when(english, "transcribe").otherwise("translate").alias("mode"),
        F.when(english, language).alias("transcribeLanguage"),
        F.lit("english").alias("translateTargetLanguage"),
        truthy(text, "includeMicrophone").alias("includeMicrophone"),
        F.when((kind == "STRING") | is_list, language).otherwise("english").alias("summarizationLanguage"),
        F.lit("auto").alias("whisperModel"),
    )
    slash = F.exists(F.coalesce(F.from_json(F.get_json_object(text, "$.language"), "array<variant>"), F.array().cast("array<variant>")), lambda x: F.coalesce(F.to_json(x) == '"/"', F.lit(False)))
    unreadable = ~((kind == "STRING") | (kind == "VOID") | is_list) | (is_list & slash)
    return F.when(F.coalesce(json_type(text), F.lit("")) != "object", defaults()).when(is_legacy(text), F.when(unreadable, defaults()).otherwise(old)).otherwise(merged(text))


def stored(record: Column) -> Column:
    """JSON text of a record, null fields included."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def stored_with(record: Column, rest: Column) -> Column:
    """JSON text of a record and of the unknown keys ``rest`` that came with it."""
    known = F.regexp_replace(stored(record), r"\}$", "")
    return F.when(F.coalesce(rest, F.lit("{}")) == "{}", stored(record)).otherwise(F.concat(known, F.lit(","), F.substring(rest, 2, 1 << 30)))


def put(table: DataFrame, changes: DataFrame) -> DataFrame:
    """A key-value table (key, json) with ``changes`` (seq, key, json): the last change of a key overwrites it, and a null json deletes it."""
    last = changes.groupBy("key").agg(F.max_by(F.struct("json"), "seq").alias("new"))
    both = table.join(last, "key", "full")
    return both.select("key", F.when(F.col("new").isNotNull(), F.col("new.json")).otherwise(F.col("json")).alias("json")).where(F.col("json").isNotNull())


def updated(record: Column, **changes: object) -> Column:
    """The record with some fields replaced."""
    for name, value in changes.items():
        record = record.withField(name, F.lit(value).cast(FIELDS[name]))
    return record
