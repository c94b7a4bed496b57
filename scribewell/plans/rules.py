"""Queries of the rules: literal rows and whole given tables, the same in Spark and DuckDB, through the library's functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribewell.functions import languages, settings, web
from scribewell.operators import transcripts
from scribewell.sources import tables

# Rows of the rule tables, as SQL that both engines read.
URLS = "(VALUES (1, 'https://a'), (2, 'chrome://x'), (3, 'chrome-extension://x'), (4, 'about:blank'), (5, 'edge://x'), (6, 'brave://x'), (7, NULL), (8, ''), (9, 'CHROME://x'), (10, 'moz-extension://x')) AS t(id, url)"
SETTINGS = """(VALUES (1, NULL), (2, ''), (3, '{bad'), (4, 'null'), (5, '5'), (6, '"x"'), (7, '{"language":"english"}'), (8, '{"language":"english/x"}'), (9, '{"language":"spanish/castilian","includeMicrophone":"false"}'),
 (10, '{"language":""}'), (11, '{"language":null}'), (12, '{"language":5}'), (13, '{"language":"x","includeMicrophone":0}'), (14, '{"language":"x","includeMicrophone":{}}'), (15, '{"mode":null}'),
 (16, '{"mode":"translate","language":"english"}'), (17, '{}'), (18, '[]'), (19, '{"mode":"translate","transcribeLanguage":"korean","includeMicrophone":true,"summarizationLanguage":"japanese","whisperModel":"small"}'),
 (20, '{"language":" english /y","includeMicrophone":true}'), (21, '{"language":0}'), (22, '{"language":"x","includeMicrophone":[]}'), (23, '{"language":"x","includeMicrophone":""}'), (24, '{"language":"x","includeMicrophone":null}'),
 (25, '{"language":false}'), (26, '{"language":" english"}'), (27, '{"language":["x"]}'), (28, '{"language":["a","/"]}'), (29, '{"language":{}}'), (30, '{"language":"a/english"}')) AS t(id, json)"""
RESOLVE = "(VALUES (1, 'transcribe', NULL), (2, 'transcribe', ''), (3, 'transcribe', 'korean'), (4, 'translate', NULL), (5, 'translate', 'korean'), (6, NULL, NULL)) AS t(id, mode, chosen)"
NAMES = "(VALUES (1, 'english'), (2, 'spanish/castilian'), (3, 'haitian creole/haitian'), (4, ''), (5, ' Greek / x'), (6, NULL)) AS t(id, name)"
STATUS = "(VALUES (1, 'loading'), (2, 'ready'), (3, 'error'), (4, NULL), (5, 'done'), (6, 'unknown')) AS t(id, status)"
ERRORS = "(VALUES (1, 'webgpu', 'WebGPU lost'), (2, 'webgpu', 'JSEP x'), (3, 'webgpu', 'Conv failed'), (4, 'webgpu', 'FILTER_IN_CHANNEL'), (5, 'webgpu', 'oom'), (6, 'webgpu', NULL), (7, 'wasm', 'WebGPU lost'), (8, NULL, 'WebGPU')) AS t(id, device, message)"
PAYLOADS = """(VALUES (1, '{"error":"no tab"}'), (2, '{"error":5}'), (3, '{"error":null}'), (4, '{}'), (5, NULL), (6, '{"error":{"a":1}}'), (7, '{"error":""}')) AS t(id, payload)"""
OUTPUTS = "(VALUES (1, array['a', NULL, 'b']), (2, array['x']), (3, array[NULL]), (4, NULL)) AS t(id, outputs)"
TARGETS = "(VALUES (1, 'offscreen', 'start-recording'), (2, NULL, 'transcript'), (3, 'panel', 'start-transcription'), (4, 'offscreen', 'stop-recording'), (5, NULL, 'other'), (6, NULL, 'offscreen-ready'), (7, NULL, 'get-recording-state')) AS t(id, target, type)"
PIECES = "(VALUES (1, 1, 'a'), (1, 2, NULL), (1, 3, 'b'), (2, 1, ''), (2, 2, 'a'), (3, 1, NULL), (4, 1, ''), (4, 2, ''), (4, 3, 'z'), (4, 4, '')) AS t(stream_id, seq, piece)"
CONTEXTS = "(VALUES (1, 'OFFSCREEN_DOCUMENT'), (1, 'SIDE_PANEL'), (2, 'POPUP'), (3, NULL)) AS t(window_id, context_type)"
MODELS = "(VALUES (1, 'auto', true), (2, 'auto', false), (3, 'small', true), (4, NULL, true), (5, 'large', false)) AS t(id, model, gpu)"


STARTS = "(VALUES (1, 'https://a', true, false, 'h'), (2, 'chrome://a', true, false, 'h'), (3, 'https://a', true, false, NULL), (4, 'https://a', true, false, ''), (5, 'https://a', false, true, NULL), (6, 'https://a', false, false, 'h'), (7, NULL, true, false, 'h'), (8, 'https://a', NULL, NULL, 'h')) AS t(id, url, has_context, context_made, handle)"
EXTRAS = """(VALUES (1, '{"mode":"translate","extra":5}'), (2, '{"a":"x","b":null,"whisperModel":"small"}'), (3, '{"mode":"transcribe"}'), (4, '{bad'), (5, '{"language":"english","extra":1}'), (6, '[]'), (7, NULL), (8, '{"deep":{"k":[1,2]},"flag":true}')) AS t(id, json)"""


#: Rows of the given tables that follow the literal ones, in expressions that both engines read.
FROM_TABLES = {
    URLS: ("pages", ["page_id + 1000", "url"]),
    SETTINGS: ("documents", ["doc_id + 1000", """'{"language":"' || lang || '","includeMicrophone":' || (n_chars % 2) || ',"source":"' || source || '"}'"""]),
    RESOLVE: ("documents", ["doc_id + 1000", "CASE WHEN n_chars % 2 = 0 THEN 'translate' ELSE 'transcribe' END", "lang"]),
    NAMES: ("documents", ["doc_id + 1000", "source || '/' || lang"]),
    STATUS: ("events", ["event_id + 1000", "event_type"]),
    ERRORS: ("events", ["event_id + 1000", "CASE WHEN value < 50 THEN 'webgpu' ELSE 'wasm' END", "event_type || CASE WHEN event_type = 'click' THEN ' Conv' WHEN event_type = 'view' THEN ' JSEP' ELSE '' END"]),
    PAYLOADS: ("events", ["event_id + 1000", "props"]),
    OUTPUTS: ("conversations", ["conv_id * 1000 + turn + 1000", "split(text, ' ')"]),
    TARGETS: ("events", ["event_id + 1000", "CASE WHEN event_type = 'view' THEN 'offscreen' END", "event_type"]),
    PIECES: ("conversations", ["conv_id + 1000", "turn", "text"]),
    CONTEXTS: ("events", ["user_id + 1000", "CASE WHEN event_type = 'click' THEN 'OFFSCREEN_DOCUMENT' ELSE 'POPUP' END"]),
    MODELS: ("documents", ["doc_id + 1000", "CASE n_chars % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'small' ELSE 'large' END", "n_chars % 2 = 0"]),
    STARTS: ("pages", ["page_id + 1000", "url", "page_id % 2 = 0", "page_id % 3 = 0", "url"]),
    EXTRAS: ("events", ["event_id + 1000", "props"]),
}


def rows(spark: SparkSession, values: str, sf_dir: str | None = None) -> DataFrame:
    """The literal rows; with ``sf_dir`` those of the given table after them."""
    literal = spark.sql(f"SELECT * FROM {values.replace('array[', 'array(').replace('])', '))') if 'array[' in values else values}")
    if sf_dir is None or values not in FROM_TABLES:
        return literal
    name, columns = FROM_TABLES[values]
    return literal.unionByName(tables.table(spark, sf_dir, name).selectExpr(*[f"{e} AS {c}" for e, c in zip(columns, literal.columns, strict=True)]))


def url_capturable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, URLS, sf_dir).select("id", web.capturable(F.col("url")).alias("capturable"))


def url_capturable_ext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, URLS, sf_dir).select("id", web.capturable(F.col("url"), web.BLOCKED_EXTENDED).alias("capturable"))


def settings_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, SETTINGS, sf_dir).select("id", settings.json_type(F.col("json")).alias("json_type"))


def settings_is_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, SETTINGS, sf_dir).select("id", settings.is_legacy(F.col("json")).alias("legacy"))


def settings_truthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, SETTINGS, sf_dir).select("id", settings.truthy(F.col("json"), "includeMicrophone").alias("truthy"))


def _flat(record: str) -> list:
    return [F.col(f"{record}.{c}").alias(c) for c in settings.FIELDS]


def settings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, SETTINGS, sf_dir).select("id", settings.merged(F.col("json")).alias("r")).select("id", *_flat("r"))


def settings_migrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, SETTINGS, sf_dir).select("id", settings.migrated(F.col("json")).alias("r")).select("id", *_flat("r"))


def settings_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = settings.updated(settings.migrated(F.col("json")), whisperModel="small", includeMicrophone=True)
    return rows(spark, SETTINGS, sf_dir).select("id", record.alias("r")).select("id", *_flat("r"))


def settings_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is stored is read back as the same record."""
    once = rows(spark, SETTINGS, sf_dir).select("id", settings.stored(settings.migrated(F.col("json"))).alias("json"))
    return once.select("id", settings.migrated(F.col("json")).alias("r")).select("id", *_flat("r"))


def safe_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field as text whatever its type; the empty text if it is missing."""
    return rows(spark, PAYLOADS, sf_dir).select("id", web.payload_field(F.col("payload"), "$.error", "").alias("shown"))


def msg_error_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, PAYLOADS, sf_dir).select("id", web.text_or(F.col("payload"), "error", "unknown error").alias("shown"))


def falsy_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, STATUS, sf_dir).unionByName(rows(spark, "(VALUES (7, '')) AS t(id, status)")).select("id", web.falsy_default(F.col("status"), "none").alias("status"))


def status_whitelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, STATUS, sf_dir).select("id", web.known_status(F.col("status")).alias("status"))


def error_fallback_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, m = F.col("device"), F.col("message")
    return rows(spark, ERRORS, sf_dir).select("id", web.retries_elsewhere(d, m, web.RUN_WORDS).alias("run"), web.retries_elsewhere(d, m, web.START_WORDS).alias("start"))


def resolve_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, RESOLVE, sf_dir).select("id", languages.task(F.col("mode")).alias("task"), languages.language(F.col("chosen")).alias("language"))


def lang_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.dim_languages(spark).select("code", languages.display_name(F.col("name")).alias("display"))


def lang_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, NAMES, sf_dir).select("id", languages.primary(F.col("name")).alias("primary_name"))


def dim_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.dim_languages(spark)


def dim_models_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.dim_models(spark)


def model_label_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.with_labels(rows(spark, MODELS, sf_dir), languages.dim_models(spark)).select("id", "model", "label")


def model_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, MODELS, sf_dir).select("id", languages.recommended_model(F.col("model"), F.col("gpu")).alias("model"))


def msg_target_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, TARGETS, sf_dir).where(F.col("target") == web.TARGET).select("id", "type")


def msg_route_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, TARGETS, sf_dir).select("id", web.route(F.col("type"), F.col("target")).alias("route"))


def transcript_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, OUTPUTS, sf_dir).where(F.col("outputs").isNotNull()).select("id", transcripts.emitted(F.col("outputs")).alias("transcript"))


def transcript_append_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.appended(rows(spark, PIECES, sf_dir))


def transcript_concat_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.joined(rows(spark, PIECES, sf_dir))


def ctx_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that have an offscreen document already."""
    contexts = rows(spark, CONTEXTS, sf_dir)
    return contexts.select("window_id").distinct().join(contexts.where("context_type = 'OFFSCREEN_DOCUMENT'"), "window_id", "left_semi")


def settings_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that the record doesn't have are kept beside it."""
    return rows(spark, EXTRAS, sf_dir).select("id", settings.unknown(F.col("json")).alias("rest"))


def settings_stored_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is written back has the record's fields and the unknown keys; both are read from it again."""
    text = F.col("json")
    whole = rows(spark, EXTRAS, sf_dir).select("id", settings.stored_with(settings.migrated(text), settings.unknown(text)).alias("json"))
    return whole.select("id", settings.unknown(text).alias("rest"), settings.migrated(text)["mode"].alias("mode"))


def settings_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of settings after one key is overwritten twice, one deleted and one added."""
    table = rows(spark, SETTINGS, sf_dir).where("json IS NOT NULL").select(F.col("id").cast("string").alias("key"), "json")
    return settings.put(table, rows(spark, "(VALUES (1, '9', '{}'), (2, '9', '{\"mode\":\"translate\"}'), (3, '10', NULL), (4, 'new', '[]'), (5, 'none', NULL)) AS t(seq, key, json)"))


def start_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, STARTS, sf_dir).select("id", web.start_outcome(F.col("url"), F.col("has_context"), F.col("context_made"), F.col("handle")).alias("outcome"))


def model_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, MODELS, sf_dir).join(F.broadcast(languages.dim_model_ids(spark)), "model", "left").select("id", "model", "model_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [url_capturable, url_capturable_ext, settings_load, settings_is_legacy, settings_truthy, settings_merge, settings_migrate, settings_update, settings_roundtrip, safe_render, msg_error_text, falsy_default, status_whitelist, error_fallback_class, resolve_language, lang_display, lang_primary, dim_languages, dim_models_entries, model_label_lookup, model_recommend, msg_target_filter, msg_route_targets, transcript_emit, transcript_append_rules, transcript_concat_rules, ctx_semi, settings_unknown, settings_stored_whole, settings_put, start_outcome, model_ids]
    return {f.__name__: f for f in own}


def _starts(prefixes: tuple[str, ...]) -> str:
    return " OR ".join(f"starts_with(url, '{p}')" for p in prefixes)


def _values(pairs: dict[str, str], names: str) -> str:
    return "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in pairs.items()) + f") AS t({names})"


# DuckDB's side of the settings: types and presence of keys by its JSON functions.
_TYPED = f"""WITH typed AS (
  SELECT id, json, CASE WHEN json IS NULL OR json = '' OR NOT json_valid(json) THEN NULL
    ELSE CASE json_type(json) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END END AS kind
  FROM {SETTINGS}
), objects AS (
  SELECT id, kind, CASE WHEN kind = 'object' THEN json::JSON END AS o FROM typed
), keyed AS (
  SELECT *, coalesce(list_contains(json_keys(o), 'language'), false) AS has_language, coalesce(list_contains(json_keys(o), 'mode'), false) AS has_mode,
    json_type(o, '$.language') AS language_type, o->>'$.language' AS language,
    CASE coalesce(json_type(o, '$.includeMicrophone'), 'NULL') WHEN 'NULL' THEN false WHEN 'BOOLEAN' THEN (o->>'$.includeMicrophone') = 'true' WHEN 'VARCHAR' THEN (o->>'$.includeMicrophone') <> ''
      WHEN 'OBJECT' THEN true WHEN 'ARRAY' THEN true ELSE (o->>'$.includeMicrophone')::DOUBLE <> 0 END AS microphone,
    CASE coalesce(json_type(o, '$.language'), 'NULL') WHEN 'NULL' THEN false WHEN 'BOOLEAN' THEN (o->>'$.language') = 'true' WHEN 'VARCHAR' THEN (o->>'$.language') <> ''
      WHEN 'OBJECT' THEN true WHEN 'ARRAY' THEN true ELSE (o->>'$.language')::DOUBLE <> 0 END AS language_truthy
  FROM objects
)"""


def _stored(name: str) -> str:
    default, kind = settings.DEFAULTS[name], settings.FIELDS[name]
    text = "NULL" if default is None else "false" if default is False else f"'{default}'"
    value = f"TRY_CAST(o->>'$.{name}' AS BOOLEAN)" if kind == "boolean" else f"(o->>'$.{name}')"
    return f"CASE WHEN coalesce(list_contains(json_keys(o), '{name}'), false) THEN {value} ELSE {text} END"


_MERGE = _TYPED + " SELECT id, " + ", ".join(f"{_stored(n)} AS {n}" for n in settings.FIELDS) + " FROM keyed"
_MIGRATE = (
    _TYPED
    + """, sorted AS (
  SELECT *, has_language AND NOT has_mode AS old, has_language AND NOT has_mode AND (language_type NOT IN ('VARCHAR', 'NULL', 'ARRAY') OR language_type = 'ARRAY' AND list_contains(json_extract_string(o, '$.language[*]'), '/')) AS unreadable,
    language_type = 'VARCHAR' AND CASE WHEN contains(language, '/') THEN trim(split_part(language, '/', 1)) ELSE language END = 'english' AS english FROM keyed
), migrated AS (SELECT id, """
    + ", ".join(
        f"CASE WHEN kind IS NULL OR kind <> 'object' OR unreadable THEN {'NULL' if settings.DEFAULTS[n] is None else 'false' if settings.DEFAULTS[n] is False else repr(settings.DEFAULTS[n])} WHEN old THEN {old} ELSE {_stored(n)} END AS {n}"
        for n, old in {
            "mode": "CASE WHEN english THEN 'transcribe' ELSE 'translate' END",
            "transcribeLanguage": "CASE WHEN english THEN language END",
            "translateTargetLanguage": "'english'",
            "includeMicrophone": "microphone",
            "summarizationLanguage": "CASE WHEN language_type IN ('VARCHAR', 'ARRAY') THEN language ELSE 'english' END",
            "whisperModel": "'auto'",
        }.items()
    )
    + " FROM sorted)"
)


_KNOWN = ", ".join(f"'{n}'" for n in settings.FIELDS)
_REST = f"""WITH typed AS (SELECT id, json, CASE WHEN json IS NOT NULL AND json_valid(json) AND json_type(json) = 'OBJECT' THEN json::JSON END AS o FROM {EXTRAS}),
  kept AS (SELECT *, CASE WHEN o IS NULL OR (list_contains(json_keys(o), 'language') AND NOT list_contains(json_keys(o), 'mode')) THEN []::VARCHAR[] ELSE list_filter(json_keys(o), lambda k: k NOT IN ({_KNOWN})) END AS names FROM typed),
  rest AS (SELECT id, o, '{{' || array_to_string(list_transform(names, lambda k: '"' || k || '":' || CAST(json_extract(o, '$.' || k) AS VARCHAR)), ',') || '}}' AS rest FROM kept)"""


def oracle_sql() -> dict[str, str]:
    out = _literal_sql()
    for values, (name, columns) in FROM_TABLES.items():
        alias = values[values.rindex(" AS t(") :]
        whole = f"(SELECT * FROM {values} UNION ALL SELECT {', '.join(columns)} FROM {name}){alias}"
        out = {k: sql.replace(values, whole) for k, sql in out.items()}
    return out


def _literal_sql() -> dict[str, str]:
    return {
        "settings_unknown": _REST + " SELECT id, rest FROM rest",
        "settings_stored_whole": _REST + " SELECT id, rest, coalesce(o->>'$.mode', 'transcribe') AS mode FROM rest",
        "settings_put": f"SELECT CAST(id AS VARCHAR) AS key, CASE WHEN id = 9 THEN '{{\"mode\":\"translate\"}}' ELSE json END AS json FROM {SETTINGS} WHERE json IS NOT NULL AND id <> 10 UNION ALL SELECT 'new', '[]'",
        "start_outcome": f"SELECT id, CASE WHEN coalesce(has_context, false) THEN CASE WHEN coalesce(url <> '' AND NOT ({_starts(web.BLOCKED)}), false) AND coalesce(handle, '') <> '' THEN 'start' ELSE 'capture-error' END WHEN coalesce(context_made, false) THEN 'wait' ELSE 'capture-error' END AS outcome FROM {STARTS}",
        "model_ids": f"SELECT m.id, m.model, t.model_id FROM (SELECT * FROM {MODELS}) m LEFT JOIN {_values(languages.MODEL_IDS, 'model, model_id')} ON m.model = t.model",
        "url_capturable": f"SELECT id, coalesce(url <> '' AND NOT ({_starts(web.BLOCKED)}), false) AS capturable FROM {URLS}",
        "url_capturable_ext": f"SELECT id, coalesce(url <> '' AND NOT ({_starts(web.BLOCKED_EXTENDED)}), false) AS capturable FROM {URLS}",
        "settings_load": _TYPED + " SELECT id, kind AS json_type FROM typed",
        "settings_is_legacy": _TYPED + " SELECT id, has_language AND NOT has_mode AS legacy FROM keyed",
        "settings_truthy": _TYPED + " SELECT id, microphone AS truthy FROM keyed",
        "settings_merge": _MERGE,
        "settings_migrate": _MIGRATE + " SELECT * FROM migrated",
        "settings_update": _MIGRATE + " SELECT * REPLACE ('small' AS whisperModel, true AS includeMicrophone) FROM migrated",
        "settings_roundtrip": _MIGRATE + " SELECT * FROM migrated",
        "safe_render": f"SELECT id, coalesce(json_extract_string(payload, '$.error'), '') AS shown FROM {PAYLOADS}",
        "msg_error_text": f"SELECT id, CASE WHEN json_type(payload, '$.error') = 'VARCHAR' THEN json_extract_string(payload, '$.error') ELSE 'unknown error' END AS shown FROM {PAYLOADS}",
        "falsy_default": f"SELECT id, coalesce(nullif(status, ''), 'none') AS status FROM (SELECT * FROM {STATUS} UNION ALL SELECT 7, '')",
        "status_whitelist": f"SELECT id, CASE WHEN status IN ('loading', 'ready', 'error') THEN status ELSE 'unknown' END AS status FROM {STATUS}",
        "error_fallback_class": f"SELECT id, coalesce(device = 'webgpu' AND (contains(message, 'WebGPU') OR contains(message, 'JSEP') OR contains(message, 'FILTER_IN_CHANNEL') OR contains(message, 'Conv')), false) AS run, coalesce(device = 'webgpu' AND (contains(message, 'WebGPU') OR contains(message, 'JSEP')), false) AS start FROM {ERRORS}",
        "resolve_language": f"SELECT id, CASE WHEN mode = 'translate' THEN 'translate' ELSE 'transcribe' END AS task, coalesce(nullif(chosen, ''), 'ru') AS language FROM {RESOLVE}",
        "lang_display": f"SELECT code, array_to_string(list_transform(string_split(name, '/'), lambda p: upper(p[1]) || p[2:]), '/') AS display FROM {_values(languages.LANGUAGES, 'code, name')}",
        "lang_primary": f"SELECT id, regexp_replace(split_part(name, '/', 1), '^\\s+|\\s+$', '', 'g') AS primary_name FROM {NAMES}",
        "dim_languages": f"SELECT code, name FROM {_values(languages.LANGUAGES, 'code, name')}",
        "dim_models_entries": f"SELECT model, label FROM {_values(languages.MODELS, 'model, label')}",
        "model_label_lookup": f"SELECT m.id, m.model, t.label FROM (SELECT * FROM {MODELS}) m LEFT JOIN {_values(languages.MODELS, 'model, label')} ON m.model = t.model",
        "model_recommend": f"SELECT id, CASE WHEN model = 'auto' THEN CASE WHEN gpu THEN 'base' ELSE 'tiny' END ELSE model END AS model FROM {MODELS}",
        "msg_target_filter": f"SELECT id, type FROM {TARGETS} WHERE target = 'offscreen'",
        "msg_route_targets": f"SELECT id, CASE WHEN target = 'offscreen' THEN 'offscreen' WHEN type IN ('start-transcription', 'stop-transcription') THEN 'recorder' WHEN type = 'get-recording-state' THEN 'reply' WHEN type IN ('recording-state', 'transcript', 'model-status', 'capture-error') THEN 'panel' WHEN type = 'offscreen-ready' THEN 'starter' ELSE 'none' END AS route FROM {TARGETS}",
        "transcript_emit": f"SELECT id, array_to_string(list_transform(outputs, lambda x: coalesce(x, '')), chr(10)) AS transcript FROM {OUTPUTS} WHERE outputs IS NOT NULL",
        "transcript_append_rules": f"SELECT stream_id, chr(10) || string_agg(coalesce(piece, ''), chr(10) ORDER BY seq) AS transcript FROM {PIECES} GROUP BY stream_id",
        "transcript_concat_rules": f"SELECT stream_id, coalesce(string_agg(coalesce(piece, ''), chr(10) ORDER BY seq) FILTER (WHERE begun), '') AS transcript FROM (SELECT *, bool_or(coalesce(piece, '') <> '') OVER (PARTITION BY stream_id ORDER BY seq) AS begun FROM {PIECES}) GROUP BY stream_id",
        "ctx_semi": f"SELECT DISTINCT window_id FROM {CONTEXTS} WHERE context_type = 'OFFSCREEN_DOCUMENT'",
    }
