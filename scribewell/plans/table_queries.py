"""Queries over whole tables, with the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribewell.functions import languages, web
from scribewell.operators import audio, notices, pcm, providers, segments, state, transcripts
from scribewell.plans import distill
from scribewell.plans.rules import URLS, rows
from scribewell.sources import tables
from scribewell.streaming import processors, streams

#: Samples of a window on the stand-in table, whose chunks have 64 samples.
N = 100
START, STOP, RECORDING, TRANSCRIPT, STATUS = "start-transcription", "stop-transcription", "recording-state", "transcript", "model-status"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.messages(tables.table(spark, sf_dir, "events"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.chunks(tables.table(spark, sf_dir, "embeddings"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pieces(tables.table(spark, sf_dir, "conversations"))


def _number() -> F.Column:
    return web.payload_field(F.col("payload"), "$.k").cast("long")


# --- sources


def src_audio_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("stream_id", "seq", F.size("samples").cast("long").alias("n_samples"))


def src_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir)


def src_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.pages(tables.table(spark, sf_dir, "pages")).select("page_id", "url", F.length("html").cast("long").alias("n_chars"))


def src_first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.first_page(tables.table(spark, sf_dir, "pages")).select("page_id", "url")


# --- pages


def url_capturable_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = tables.table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url").unionByName(rows(spark, URLS).select(F.col("id").cast("long").alias("id"), "url"))
    return web.capturable_rows(every, spark)


def doc_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "pages").select("page_id", distill.article(F.col("html")).alias("article"))


def doc_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of all pages."""
    return distill.page_nodes(tables.table(spark, sf_dir, "pages"))


def doc_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown of the sections that score, as if no page had an article element."""
    return tables.table(spark, sf_dir, "pages").select("page_id", distill.markdown(distill.scored(F.col("html"))).alias("markdown"))


def doc_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "pages").select("page_id", distill.read(F.col("html"))["markdown"].alias("markdown"))


def doc_titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: capturable pages to capped markdown under a linked title."""
    done = distill.distilled(tables.table(spark, sf_dir, "pages"))
    return done.select("page_id", distill.titled(F.col("title"), F.col("url"), F.col("body")).alias("text"))


def doc_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distill.distilled(tables.table(spark, sf_dir, "pages")).select("page_id", distill.prompt(F.col("body")).alias("prompt"))


def doc_translate_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other document as if a Japanese reader had asked."""
    chosen = F.when(F.col("doc_id") % 2 == 0, "japanese").otherwise("english")
    return tables.table(spark, sf_dir, "documents").select("doc_id", distill.translate_prompt(chosen, F.col("text")).alias("prompt"))


#: Pages without content and without an article, after the given ones.
_BARE = "(VALUES (-1, NULL), (-2, ''), (-3, '<p>x</p>')) AS t(page_id, html)"


def doc_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages and three bare ones, for readers with a provider and without one."""
    pages = tables.table(spark, sf_dir, "pages").select("page_id", "html").unionByName(rows(spark, _BARE))
    read = pages.select("page_id", distill.status(F.col("html"), F.lit(True)).alias("with_provider"), distill.status(F.col("html"), F.lit(False)).alias("without"))
    each = read.select("page_id", F.explode(F.array(F.struct(F.lit(True).alias("provider"), F.col("with_provider").alias("status")), F.struct(F.lit(False).alias("provider"), F.col("without").alias("status")))).alias("x"))
    return each.select("page_id", "x.provider", "x.status", distill.failure_text(F.col("x.status")).alias("shown"))


def doc_head40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents").select("doc_id", distill.head_lines(F.col("text")).alias("head"))


def doc_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way with a stub for the text model."""
    done = distill.distilled(tables.table(spark, sf_dir, "pages"))
    return providers.answered(done.select("page_id", distill.prompt(F.col("body")).alias("prompt")), [providers.StubTextModel])


def doc_summarized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From pages to summaries under their titles, in Japanese for every third page, with stubs for both models."""
    pages = tables.table(spark, sf_dir, "pages").withColumn("language", F.when(F.col("page_id") % 3 == 0, "japanese").otherwise("english"))
    return distill.summarized(pages, [providers.StubTextModel], [providers.StubTextModel])


def doc_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by readers whose browsers have a text model, get one after a download, have none, or have one that can't be had and another."""
    pages = tables.table(spark, sf_dir, "pages").select("page_id")
    stub = providers.StubTextModel
    readers = {"readily": [stub], "after-download": [lambda: stub("after-download")], "no": [lambda: stub("no")], "second": [lambda: stub("no"), stub], "none": []}
    each = [providers.capabilities(pages, backends).withColumn("reader", F.lit(reader)) for reader, backends in readers.items()]
    return reduce(DataFrame.unionByName, each)


def locale_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "documents").select("doc_id", languages.locale_default(F.col("lang")).alias("language"))


def doc_language_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the name of their language; codes that aren't known have none."""
    docs = tables.table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    names = F.broadcast(languages.dim_languages(spark))
    return docs.join(names, docs["lang"] == names["code"], "left").select("lang", languages.display_name(F.col("name")).alias("display"), "n")


# --- messages


def msg_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("seq", "type", web.route(F.col("type")).alias("route"))


def msg_payload_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _messages(spark, sf_dir).select("seq", web.payload_field(F.col("payload"), "$.k", "0").alias("k"), web.payload_field(F.col("payload"), "$.missing", "none").alias("missing"))


def msg_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads as they are shown."""
    return _messages(spark, sf_dir).select("seq", web.rendered(F.col("payload")).alias("shown"))


def state_recording_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each stream was recording last: its payload's number is even."""
    return state.last_value(_messages(spark, sf_dir), _number() % 2 == 0, F.col("type") == RECORDING, F.lit(False)).withColumnRenamed("value", "recording")


def state_model_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.last_value(_messages(spark, sf_dir), web.known_status(F.when(_number() % 3 == 0, "loading").when(_number() % 3 == 1, "ready")), F.col("type") == STATUS, F.lit("unknown")).withColumnRenamed("value", "status")


def state_snapshot_plus_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State as of the 10th of January and what came after."""
    numbered = _messages(spark, sf_dir).where(F.col("type") == RECORDING).select("stream_id", "ts", "seq", _number().alias("value"))
    cut = F.lit("2024-01-10").cast("timestamp_ntz")
    at = numbered.where(F.col("ts") < cut).groupBy("stream_id").agg(F.max_by(F.struct("ts", "seq", "value"), state.order()).alias("s")).select("stream_id", "s.*")
    return state.snapshot_and_updates(at, numbered.where(F.col("ts") >= cut))


def chunk_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript messages by session."""
    marked = state.sessions(_messages(spark, sf_dir), F.col("type") == START)
    return marked.where(F.col("type") == TRANSCRIPT).groupBy("stream_id", "session").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def pair_pending_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.paired(_messages(spark, sf_dir), F.col("type") == START, F.col("type") == RECORDING)


def fsm_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.recorder(_messages(spark, sf_dir), F.col("type") == START, F.col("type") == STOP).select("stream_id", "seq", "state")


def error_visible_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.shown(_messages(spark, sf_dir), F.col("type") == STATUS)


def error_visible_ttl_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With an hour's timers, so that they overlap on this table."""
    return state.shown(_messages(spark, sf_dir), F.col("type") == STATUS, 3600)


def settings_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir)
    chosen = messages.where(F.col("type") == RECORDING).select("stream_id", "ts", "seq", _number().alias("setting"))
    return state.as_of(messages.where(F.col("type") == TRANSCRIPT), chosen, "setting").select("stream_id", "seq", "setting")


def shed_latest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the transcript messages of a stream in a day only the newest is worked on."""
    day = F.unix_date(F.col("ts").cast("date")).cast("long")
    return state.newest_by_batch(_messages(spark, sf_dir).where(F.col("type") == TRANSCRIPT), day)


def sliding_30s_10s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.sliding(tables.table(spark, sf_dir, "events"), "event_type").select("w_start", "event_type", "n", F.round("total", 2).alias("total"))


def trailing_30s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.trailing(tables.table(spark, sf_dir, "events"), "user_id").select("event_id", "n_trailing")


# --- the same for streams of any length


def hot_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = segments.sessions(_messages(spark, sf_dir), F.col("type") == START)
    return marked.where(F.col("type") == TRANSCRIPT).groupBy("stream_id", "session").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def hot_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("type")
    return segments.paired(_messages(spark, sf_dir), kind == START, kind == RECORDING, kind == STOP)


def hot_recorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.recorder(_messages(spark, sf_dir), F.col("type") == START, F.col("type") == STOP).select("stream_id", "seq", "state")


def hot_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _messages(spark, sf_dir)
    chosen = messages.where(F.col("type") == RECORDING).select("stream_id", "ts", "seq", _number().alias("setting"))
    return segments.as_of(messages.where(F.col("type") == TRANSCRIPT), chosen, "setting").select("stream_id", "seq", "setting")


def hot_trailing_30s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.trailing(_messages(spark, sf_dir), audio.SECONDS).select(F.col("seq").alias("event_id"), "n_trailing")


def hot_audio_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = audio.concatenated(segments.trailing_chunks(_chunks(spark, sf_dir), N))
    return held.withColumn("samples", audio.tail(F.col("samples"), N))


# --- notices: the messages of a stream as its log of actions


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _actions(_messages(spark, sf_dir)).drop("ts")


def _actions(messages: DataFrame) -> DataFrame:
    action = F.when(F.col("type") == START, "ADD").when(F.col("type") == TRANSCRIPT, "UPDATE").when(F.col("type") == STOP, "DISMISS").when(F.col("type") == STATUS, "REMOVE")
    k = _number() % 4
    named = F.when((action != "ADD") & (k == 3), F.lit(None)).otherwise(k.cast("string"))
    return messages.where(F.col("type") != RECORDING).select("stream_id", "ts", "seq", action.alias("action"), named.alias("id"), F.concat(F.lit("t"), F.col("seq").cast("string")).alias("title"))


def toast_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.newest(_log(spark, sf_dir).where("action = 'ADD'")).select("stream_id", "seq", "id", "title")


def toast_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that count up in each stream, and begin again where numbers aren't safe any more."""
    return _log(spark, sf_dir).where("action = 'ADD'").selectExpr("stream_id", "seq", f"CAST(row_number() OVER (PARTITION BY stream_id ORDER BY seq) % {web.SAFE} AS STRING) AS id")


def _latest_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir).where("action = 'ADD'").groupBy("stream_id", "id").agg(F.max_by("title", "seq").alias("title"))


def toast_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.updated(_latest_by_id(spark, sf_dir), _log(spark, sf_dir).where("action = 'UPDATE' AND id IS NOT NULL").select("stream_id", "id", "seq", "title"), "title")


def toast_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.removed(_latest_by_id(spark, sf_dir), _log(spark, sf_dir).where("action = 'REMOVE'").select("stream_id", "id"))


def toast_schedule_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.scheduled_once(_log(spark, sf_dir).where("action = 'DISMISS' AND id IS NOT NULL"))


def toast_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices.folded(_log(spark, sf_dir))


# --- samples


def chunk_nonempty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of which every fifth is emptied."""
    samples = F.when(F.col("seq") % 5 == 0, F.array().cast("array<float>")).otherwise(F.col("samples"))
    return _chunks(spark, sf_dir).withColumn("samples", samples).where(audio.not_empty(F.col("samples"))).select("stream_id", "seq")


def audio_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.stream_tails(_chunks(spark, sf_dir), N)


def audio_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.stream_heads(_chunks(spark, sf_dir), N)


def audio_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All samples of each session of 64 chunks."""
    chunks = _chunks(spark, sf_dir).select((F.col("seq") - F.col("seq") % 64).alias("stream_id"), "seq", "samples")
    return audio.concatenated(chunks)


def audio_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk with the first half of its own samples."""
    double = F.col("samples").cast("array<double>")
    return _chunks(spark, sf_dir).select("seq", audio.mixed(double, F.slice(double, 1, 32)).alias("samples"))


def audio_channel0(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = F.array(F.slice("samples", 1, 32), F.slice("samples", 33, 32))
    return _chunks(spark, sf_dir).select("seq", audio.channel(channels).alias("samples"))


def audio_downmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    double = F.col("samples").cast("array<double>")
    mixed = audio.downmix(F.slice(double, 1, 32), F.slice(double, 33, 32))
    return _chunks(spark, sf_dir).select("seq", F.transform(mixed, lambda x: F.round(x, 9)).alias("samples"))


def chunks_union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir).select("stream_id", "seq")
    return chunks.unionByName(chunks)


def audio_transcribed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stream's window through a stub whose first backend fails, so that the second answers."""
    windows = audio.stream_tails(_chunks(spark, sf_dir), N).withColumn("language", languages.language(F.lit(None).cast("string"))).withColumn("task", languages.task(F.lit("transcribe")))
    done = providers.transcribed(windows, [lambda: providers.StubTranscriber("webgpu", "WebGPU lost"), providers.StubTranscriber])
    return done.where(F.col("outputs").isNotNull()).select("stream_id", transcripts.emitted(F.col("outputs")).alias("transcript"), "backend", "status")


def audio_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stream as chunks of a WAV file of 16 bits, and its samples again."""
    found = pcm.samples_of(pcm.wav_chunks(_chunks(spark, sf_dir), audio.RATE))
    return audio.concatenated(found)


def audio_resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a rate of 48,000."""
    return audio.concatenated(pcm.samples_of(pcm.wav_chunks(_chunks(spark, sf_dir), 48_000)))


# --- transcripts


def transcript_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.appended(_pieces(spark, sf_dir))


def transcript_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.joined(_pieces(spark, sf_dir))


# --- streams


def stream_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(streams.routed(streams.message_stream(spark, sf_dir))).drop("batch_id")


def stream_handshake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(streams.paired(streams.message_stream(spark, sf_dir))).drop("batch_id")


def pair_until_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs as before, but a stop in between forgets the pending start."""
    kind = F.col("type")
    return state.paired(_messages(spark, sf_dir), kind == START, kind == RECORDING, kind == STOP)


def stream_handshake_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(streams.paired(streams.message_stream(spark, sf_dir), closed=STOP)).drop("batch_id")


def stream_recorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.drained(streams.recorder(streams.message_stream(spark, sf_dir))).drop("batch_id")


def _recorder_events(messages: DataFrame) -> DataFrame:
    """Messages as a recorder's events: a transcript stands for a chunk of k samples, a recording state for a setting k."""
    kind = F.when(F.col("type") == START, "start").when(F.col("type") == STOP, "stop").when(F.col("type") == TRANSCRIPT, "chunk").when(F.col("type") == RECORDING, "setting")
    n = F.when(F.col("type") == TRANSCRIPT, F.coalesce(_number(), F.lit(0)))
    rows = messages.withColumn("kind", kind).where(F.col("kind").isNotNull())
    return rows.select("stream_id", "ts", "seq", "kind", F.when(F.col("type") == RECORDING, _number()).alias("value"), n.alias("n"), F.array_repeat(F.col("seq").cast("float"), n.cast("int")).alias("samples"))


def recorded_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows of recorder sessions, after every chunk and every change of settings."""
    return state.recorded_windows(_recorder_events(_messages(spark, sf_dir)), N)


def _replayed_messages(spark: SparkSession, sf_dir: str, batches: int = 6) -> DataFrame:
    stream = streams.replayed(tables.table(spark, sf_dir, "events"), "ts", batches=batches)
    return tables.messages(stream).withColumn("ts", F.col("ts").cast("timestamp"))


def stream_recorded_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from keyed state, over several micro-batches."""
    found = streams.drained(processors.recorded_windows(_recorder_events(_replayed_messages(spark, sf_dir)), N))
    return found.select("stream_id", "seq", "cause", "session", "setting", F.size("samples").cast("long").alias("n_samples"), "oldest")


def stream_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From events to transcripts: sessions and windows in keyed state, a stub for the model, and its answers by stream in order."""
    windows = processors.recorded_windows(_recorder_events(_replayed_messages(spark, sf_dir)), N)
    asked = windows.withColumn("language", languages.language(F.lit(None).cast("string"))).withColumn("task", languages.task(F.lit("transcribe")))
    done = streams.drained(providers.transcribed(asked, [lambda: providers.StubTranscriber("webgpu", "WebGPU lost"), providers.StubTranscriber], also=("seq", "session")))
    pieces = done.where(F.col("outputs").isNotNull()).select("stream_id", "session", "seq", "batch_id", transcripts.emitted(F.col("outputs")).alias("piece"))
    return pieces.groupBy("stream_id", "session").agg(F.count("*").alias("n"), F.concat_ws("\n", F.array_sort(F.collect_list("piece"))).alias("transcript"))


def stream_shed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window, with the number that its stream has waiting in its week and its place among them, the newest first: work that falls behind begins at place 1, and what it sheds is known."""
    week = F.date_trunc("week", "ts")
    weekly = tables.table(spark, sf_dir, "events").withColumn("week", week)
    # a batch holds one week or more, each of them whole
    stream = tables.messages(streams.replayed(weekly, "week", batches=8)).withColumn("ts", F.col("ts").cast("timestamp"))
    found = streams.drained(processors.recorded_windows(_recorder_events(stream), N, part=F.unix_date(week.cast("date"))))
    return found.select("stream_id", "seq", "session", "setting", "n_waiting", "place")


def stream_state_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot of the 10th of January as the state to begin with, and the updates after it."""
    cut = F.lit("2024-01-10")
    numbered = lambda df: df.where(F.col("type") == RECORDING).select("stream_id", "ts", "seq", _number().alias("value"))
    snapshot = numbered(_messages(spark, sf_dir)).where(F.col("ts") < cut.cast("timestamp_ntz")).groupBy("stream_id").agg(F.max_by("value", state.order()).alias("value"))
    updates = numbered(_replayed_messages(spark, sf_dir)).where(F.col("ts") >= cut.cast("timestamp"))
    found = streams.drained(processors.last_values(updates, snapshot))
    return found.groupBy("stream_id").agg(F.max_by("value", F.struct("at", "seq")).alias("value"))


def stream_settings_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("type") == RECORDING, 0).otherwise(1)
    both = streams.message_stream(spark, sf_dir).where(F.col("type").isin(RECORDING, TRANSCRIPT))
    value = F.when(F.col("type") == RECORDING, _number())
    found = streams.drained(processors.settings_at(both.select("stream_id", "ts", "seq", kind.alias("kind"), value.alias("value"))))
    return found.select("stream_id", "seq", F.col("value").alias("setting"))


def stream_error_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors whose showing has ended: the next one came, or the timer ran out before the last error less the allowed lateness."""
    errors = streams.message_stream(spark, sf_dir).where(F.col("type") == STATUS)
    return streams.drained(streams.errors_shown(errors)).drop("batch_id")


def stream_toasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the batch fold gives, from keyed state."""
    found = streams.drained(streams.notices_kept(_actions(streams.message_stream(spark, sf_dir))), "update")
    last = found.groupBy("stream_id").agg(F.max_by(F.arrays_zip("ids", "titles", "opened"), "batch_id").alias("kept"))
    return last.select("stream_id", F.explode("kept").alias("x")).select("stream_id", F.col("x.ids").alias("id"), F.col("x.titles").alias("title"), F.col("x.opened").alias("open"))


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows that are closed: those that ended before the last event less the allowed lateness."""
    return streams.drained(streams.sliding_counts(streams.message_stream(spark, sf_dir))).select(F.col("w_start").cast("timestamp_ntz").alias("w_start"), "type", "n")


def stream_audio_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = tables.chunks(streams.event_stream(spark, sf_dir, "embeddings")).withColumn("ts", F.timestamp_seconds("seq"))
    found = streams.drained(processors.trailing_samples(chunks, N))
    return found.groupBy("stream_id").agg(F.max_by("samples", F.struct("batch_id", "seq")).alias("samples"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [src_audio_chunks, src_messages, src_pages, src_first_page, url_capturable_antijoin, doc_nodes, doc_article, doc_scored, doc_markdown, doc_titled, doc_prompt, doc_translate_prompt, doc_status, doc_head40, doc_summaries, doc_summarized, doc_capabilities, locale_default, doc_language_names, msg_route, msg_payload_field, msg_rendered, state_recording_last, state_model_last, state_snapshot_plus_updates, chunk_sessions, pair_pending_ready, fsm_recording, error_visible_ttl, error_visible_ttl_hour, settings_as_of, shed_latest_window, sliding_30s_10s, trailing_30s, hot_sessions, hot_pairs, hot_recorder, hot_settings, hot_trailing_30s, hot_audio_tail, toast_top1, toast_ids, toast_update, toast_remove, toast_schedule_once, toast_fold, chunk_nonempty, audio_tail, audio_head, audio_concat, audio_mix, audio_channel0, audio_downmix, chunks_union_all, audio_transcribed, audio_decoded, audio_resampled, transcript_append, transcript_concat, stream_route, stream_handshake, pair_until_closed, stream_handshake_closed, stream_recorder, recorded_windows, stream_recorded_windows, stream_transcripts, stream_shed_windows, stream_state_last, stream_settings_as_of, stream_error_ttl, stream_toasts, stream_sliding, stream_audio_tail]
    return {f.__name__: f for f in own}


_CASE = "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in tables.MESSAGE_OF_EVENT.items()) + " ELSE event_type END"
_M = f"WITH m AS (SELECT event_id AS seq, ts, user_id AS stream_id, {_CASE} AS type, props AS payload, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
_ROUTE = "CASE WHEN type IN ('start-transcription', 'stop-transcription') THEN 'recorder' WHEN type IN ('recording-state', 'transcript', 'model-status', 'capture-error') THEN 'panel' ELSE 'none' END"
_LOG = (
    _M
    + """, log AS (SELECT stream_id, seq, action, CASE WHEN action <> 'ADD' AND k % 4 = 3 THEN NULL ELSE CAST(k % 4 AS VARCHAR) END AS id, 't' || seq AS title
  FROM (SELECT *, CASE type WHEN 'start-transcription' THEN 'ADD' WHEN 'transcript' THEN 'UPDATE' WHEN 'stop-transcription' THEN 'DISMISS' WHEN 'model-status' THEN 'REMOVE' END AS action FROM m) WHERE action IS NOT NULL),
latest AS (SELECT stream_id, id, arg_max(title, seq) AS title FROM log WHERE action = 'ADD' GROUP BY stream_id, id)"""
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _text(text: str) -> str:
    """A SQL string; line breaks by chr."""
    return " || chr(10) || ".join(_quoted(x) for x in text.split("\n"))


# How the given pages are made: an article element with a headline and paragraphs, where bold text isn't ended and so goes on to the end,
# an advert before it, and four character references. The SQL reads these pages only, in its own way.


def _duck_decoded(sql: str) -> str:
    for a, b in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        sql = f"replace({sql}, {_quoted(a)}, {_quoted(b)})"
    return sql


def _duck_escaped(sql: str) -> str:
    """Text without tags, in which markdown reads no signs."""
    sql = _duck_decoded(f"regexp_replace({sql}, '<[^>]*>', '', 'g')")
    sql = f"trim(regexp_replace({sql}, '[ \\t\\r\\n\\f]+', ' ', 'g'), ' ')"
    for sign in "\\*_`[]":
        sql = f"replace({sql}, '{sign}', '\\{sign}')"
    return sql


def _duck_line(sql: str) -> str:
    sql = f"regexp_replace({sql}, '^(-|=|>|\\+ |#{{1,6}} |~~~)', '\\\\\\1')"
    return f"regexp_replace({sql}, '^([0-9]+)[.] ', '\\1\\\\. ')"


_ARTICLE = "regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1)"
_HEADLINE = _duck_line(_duck_escaped(f"regexp_extract({_ARTICLE}, '(?s)<h1>(.*?)</h1>', 1)"))
_PARTS = f"string_split_regex(regexp_replace({_ARTICLE}, '(?s)^.*?</h1>', ''), '</?p>')"
_PARAGRAPH = f"CASE WHEN {_duck_escaped('x')} = '' THEN '' WHEN contains(array_to_string(parts[:i], ''), '<b>') THEN '**' || {_duck_escaped('x')} || '**' ELSE {_duck_line(_duck_escaped('x'))} END"
_BODY = f"array_to_string(list_filter(['# ' || {_HEADLINE}] || list_transform(parts, lambda x, i: {_PARAGRAPH}), lambda t: t NOT IN ('', '# ')), chr(10) || chr(10))"
_MARKDOWN = f"list_transform([{_PARTS}], lambda parts: {_BODY})[1]"
_HAS_PARAGRAPH = f"len(list_filter({_PARTS}, lambda x: length(regexp_replace({_duck_decoded("regexp_replace(x, '<[^>]*>', '', 'g')")}, '[ \\t\\r\\n\\f]+', ' ', 'g')) >= 25)) > 0"
_ADVERT = _duck_line(_duck_escaped("regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)"))
_TITLE = _duck_decoded("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")
_BLOCKED = " OR ".join(f"starts_with(url, '{p}')" for p in web.BLOCKED)


def _duck_head(sql: str) -> str:
    return f"array_to_string((string_split({sql}, chr(10)))[1:{distill.LINES}], chr(10))"


_DISTILLED = f"(SELECT page_id, url, {_TITLE} AS title, {_duck_head(_MARKDOWN)} AS body FROM pages WHERE html IS NOT NULL AND coalesce(url <> '' AND NOT ({_BLOCKED}), false)) WHERE body <> ''"


# what the stub for a text model says
_SUMMARY = "'[stub summary] ' || left(split_part(body, chr(10), 1), 80)"


def _shown(seconds: int) -> str:
    us = seconds * 1_000_000
    return (
        _M
        + f""", e AS (SELECT stream_id, seq, epoch_us(ts) AS t_us FROM m WHERE type = 'model-status'),
    t AS (SELECT *, min(t_us) OVER (PARTITION BY stream_id ORDER BY t_us RANGE BETWEEN {us - 1} PRECEDING AND CURRENT ROW) AS first_us, lead(t_us) OVER (PARTITION BY stream_id ORDER BY t_us, seq) AS next_us FROM e)
    SELECT stream_id, seq, CAST(least(first_us + {us}, coalesce(next_us, first_us + {us})) - t_us AS BIGINT) AS shown_us FROM t"""
    )


_WINDOWS = (
    _M
    + f""", e AS (SELECT stream_id, ts, seq, k, CASE type WHEN 'recording-state' THEN 0 WHEN 'start-transcription' THEN 1 WHEN 'transcript' THEN 2 ELSE 3 END AS rank FROM m WHERE type <> 'model-status'),
    r AS (SELECT *, last_value(CASE WHEN rank IN (1, 3) THEN rank END IGNORE NULLS) OVER now AS state, last_value(CASE WHEN rank IN (1, 3) THEN rank END IGNORE NULLS) OVER before AS was,
        last_value(CASE WHEN rank = 0 THEN k END IGNORE NULLS) OVER now AS setting FROM e
        WINDOW now AS (PARTITION BY stream_id ORDER BY ts, rank, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), before AS (PARTITION BY stream_id ORDER BY ts, rank, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    s AS (SELECT *, (sum(CASE WHEN rank = 1 AND coalesce(was, 3) = 3 THEN 1 ELSE 0 END) OVER (PARTITION BY stream_id ORDER BY ts, rank, seq ROWS UNBOUNDED PRECEDING))::BIGINT AS session,
        CASE WHEN rank = 2 AND state = 1 THEN coalesce(k, 0) ELSE 0 END AS n FROM r),
    c AS (SELECT *, (sum(n) OVER (PARTITION BY stream_id, session ORDER BY ts, rank, seq ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM s),
    windows AS (SELECT stream_id, ts, rank, seq, CASE rank WHEN 0 THEN 'setting' ELSE 'chunk' END AS cause, session, setting, least(total, {N}) AS n_samples,
        (SELECT arg_min(d.seq, d.total) FROM c d WHERE d.stream_id = c.stream_id AND d.session = c.session AND d.n > 0 AND d.total <= c.total AND d.total > c.total - {N}) AS oldest
        FROM c WHERE state = 1 AND total > 0 AND (rank = 0 OR n > 0))"""
)


def oracle_sql() -> dict[str, str]:
    out = {
        "src_audio_chunks": "SELECT label AS stream_id, vec_id AS seq, len(embedding) AS n_samples FROM embeddings",
        "src_messages": _M + " SELECT seq, ts, stream_id, type, payload FROM m",
        "src_pages": "SELECT page_id, url, length(html) AS n_chars FROM pages WHERE html IS NOT NULL AND html <> ''",
        "src_first_page": "SELECT page_id, url FROM pages WHERE html IS NOT NULL AND html <> '' ORDER BY page_id LIMIT 1",
        "url_capturable_antijoin": f"SELECT id, url FROM (SELECT page_id AS id, url FROM pages UNION ALL SELECT CAST(id AS BIGINT), url FROM {URLS}) WHERE url <> '' AND NOT ({_BLOCKED})",
        "doc_article": f"SELECT page_id, {_ARTICLE} AS article FROM pages",
        "doc_scored": f"SELECT page_id, CASE WHEN {_HAS_PARAGRAPH} THEN {_MARKDOWN} WHEN length({_ADVERT}) >= 25 THEN {_ADVERT} ELSE '' END AS markdown FROM pages",
        "doc_markdown": f"SELECT page_id, {_MARKDOWN} AS markdown FROM pages",
        "doc_titled": f"SELECT page_id, '# [' || title || '](' || url || ')' || chr(10) || chr(10) || body AS text FROM {_DISTILLED}",
        "doc_prompt": f"SELECT page_id, {_text(distill.PROMPT)} || body AS prompt FROM {_DISTILLED}",
        "doc_translate_prompt": f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN {_text(distill.TRANSLATE)} || text END AS prompt FROM documents",
        "doc_status": f"""WITH p AS (SELECT page_id, html FROM pages UNION ALL SELECT * FROM {_BARE}),
            s AS (SELECT page_id, provider, CASE WHEN coalesce(html, '') = '' THEN 'no_content' WHEN {_ARTICLE} = '' THEN 'no_article' WHEN NOT provider THEN 'no_provider' ELSE 'ok' END AS status FROM p, (VALUES (true), (false)) AS r(provider))
            SELECT page_id, provider, status, CASE WHEN status <> 'ok' THEN 'Failed to summarize: ' || status END AS shown FROM s""",
        "doc_head40": f"SELECT doc_id, {_duck_head('text')} AS head FROM documents",
        "doc_summaries": f"SELECT page_id, {_SUMMARY} AS answer, 'stub' AS backend, 'ok' AS status FROM {_DISTILLED}",
        # the stub that translates answers with the first line of the summary that it is given
        "doc_summarized": f"SELECT page_id, '# [' || title || '](' || url || ')' || chr(10) || chr(10) || CASE WHEN page_id % 3 = 0 THEN '[stub summary] ' || left({_SUMMARY}, 80) ELSE {_SUMMARY} END AS text, 'ok' AS status FROM {_DISTILLED}",
        "doc_capabilities": "SELECT page_id, reader, available, backend FROM pages, (VALUES ('readily', 'readily', 'stub'), ('after-download', 'after-download', 'stub'), ('no', 'no', NULL), ('second', 'readily', 'stub'), ('none', 'no', NULL)) AS r(reader, available, backend)",
        # the stub says how many samples it was given, and only the second backend answers
        "audio_transcribed": f"SELECT label AS stream_id, '[stub transcribe ru: ' || least({N}, sum(len(embedding))) || ' samples]' AS transcript, 'wasm' AS backend, 'ok' AS status FROM embeddings GROUP BY label",
        "audio_decoded": "SELECT label AS stream_id, list_transform(flatten(list(embedding ORDER BY vec_id)), lambda x: (round_even(x::DOUBLE * 32768, 0) / 32768)::FLOAT) AS samples FROM embeddings GROUP BY label",
        "locale_default": "SELECT doc_id, CASE WHEN starts_with(lang, 'ja') THEN 'japanese' ELSE 'english' END AS language FROM documents",
        "doc_language_names": "SELECT d.lang, array_to_string(list_transform(string_split(l.name, '/'), lambda p: upper(p[1]) || p[2:]), '/') AS display, count(*) AS n FROM documents d LEFT JOIN (VALUES "
        + ", ".join(f"('{a}', '{b}')" for a, b in languages.LANGUAGES.items())
        + ") AS l(code, name) ON d.lang = l.code GROUP BY 1, 2",
        "msg_route": _M + f" SELECT seq, type, {_ROUTE} AS route FROM m",
        "msg_payload_field": _M + " SELECT seq, coalesce(json_extract_string(payload, '$.k'), '0') AS k, coalesce(json_extract_string(payload, '$.missing'), 'none') AS missing FROM m",
        "msg_rendered": _M + """ SELECT seq, '{' || chr(10) || '  "k": ' || k || chr(10) || '}' AS shown FROM m""",
        "state_recording_last": _M + " SELECT stream_id, arg_max(coalesce(k % 2 = 0, false), row(ts, seq)) AS recording FROM m WHERE type = 'recording-state' GROUP BY stream_id",
        "state_model_last": _M + " SELECT stream_id, arg_max(CASE k % 3 WHEN 0 THEN 'loading' WHEN 1 THEN 'ready' ELSE 'unknown' END, row(ts, seq)) AS status FROM m WHERE type = 'model-status' GROUP BY stream_id",
        "state_snapshot_plus_updates": _M + " SELECT stream_id, arg_max(k, row(ts, seq)) AS value FROM m WHERE type = 'recording-state' GROUP BY stream_id",
        "chunk_sessions": _M + """, s AS (SELECT *, sum((type = 'start-transcription')::INT) OVER (PARTITION BY stream_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM m)
            SELECT stream_id, session, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM s WHERE type = 'transcript' GROUP BY ALL""",
        "pair_pending_ready": _M + """, p AS (SELECT *, lag(type) OVER w AS before_type, lag(seq) OVER w AS before_seq FROM m WHERE type IN ('start-transcription', 'recording-state') WINDOW w AS (PARTITION BY stream_id ORDER BY ts, seq))
            SELECT stream_id, before_seq AS pending_seq, seq AS ready_seq FROM p WHERE type = 'recording-state' AND before_type = 'start-transcription'""",
        "fsm_recording": _M + """, p AS (SELECT *, lag(type) OVER (PARTITION BY stream_id ORDER BY ts, seq) AS before_type FROM m WHERE type IN ('start-transcription', 'stop-transcription'))
            SELECT stream_id, seq, CASE type WHEN 'start-transcription' THEN 'recording' ELSE 'idle' END AS state FROM p WHERE type <> coalesce(before_type, 'stop-transcription')""",
        "error_visible_ttl": _shown(8),
        "error_visible_ttl_hour": _shown(3600),
        "settings_as_of": _M + """, s AS (SELECT * FROM m WHERE type = 'recording-state')
            SELECT c.stream_id, c.seq, (SELECT arg_max(s.k, row(s.ts, s.seq)) FROM s WHERE s.stream_id = c.stream_id AND s.ts <= c.ts) AS setting FROM m c WHERE c.type = 'transcript'""",
        "shed_latest_window": _M + " SELECT stream_id, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS batch, arg_max(seq, row(ts, seq)) AS seq, count(*) AS n_waiting FROM m WHERE type = 'transcript' GROUP BY 1, 2",
        "sliding_30s_10s": """SELECT time_bucket(INTERVAL 10 SECONDS, ts) - n.k * INTERVAL 10 SECONDS AS w_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events, (VALUES (0), (1), (2)) AS n(k) GROUP BY 1, 2""",
        "trailing_30s": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 30 SECONDS PRECEDING AND CURRENT ROW) AS n_trailing FROM events",
        "toast_top1": _LOG + " SELECT stream_id, seq, id, title FROM log WHERE action = 'ADD' QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY seq DESC) <= 1",
        "toast_ids": _LOG + " SELECT stream_id, seq, CAST(row_number() OVER (PARTITION BY stream_id ORDER BY seq) AS VARCHAR) AS id FROM log WHERE action = 'ADD'",
        "toast_update": _LOG + ", u AS (SELECT stream_id, id, arg_max(title, seq) AS new FROM log WHERE action = 'UPDATE' AND id IS NOT NULL GROUP BY ALL) SELECT l.stream_id, l.id, coalesce(u.new, l.title) AS title FROM latest l LEFT JOIN u ON l.stream_id = u.stream_id AND l.id = u.id",
        "toast_remove": _LOG + ", r AS (SELECT * FROM log WHERE action = 'REMOVE') SELECT l.stream_id, l.id, l.title FROM latest l WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.stream_id = l.stream_id AND (r.id IS NULL OR r.id = l.id))",
        "toast_schedule_once": _LOG + " SELECT stream_id, id, min(seq) AS seq FROM log WHERE action = 'DISMISS' AND id IS NOT NULL GROUP BY ALL",
        "toast_fold": _LOG + """, top AS (SELECT stream_id, seq AS added, id, title FROM log WHERE action = 'ADD' QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY seq DESC) = 1),
            after AS (SELECT t.stream_id, t.id, t.title, l.seq, l.action, l.title AS new FROM top t LEFT JOIN log l ON l.stream_id = t.stream_id AND l.seq > t.added AND l.action <> 'ADD' AND (l.id = t.id OR (l.id IS NULL AND l.action <> 'UPDATE')))
            SELECT stream_id, id, coalesce(arg_max(new, seq) FILTER (WHERE action = 'UPDATE'), any_value(title)) AS title, NOT coalesce(bool_or(action = 'DISMISS'), false) AS open FROM after GROUP BY stream_id, id HAVING NOT coalesce(bool_or(action = 'REMOVE'), false)""",
        "chunk_nonempty": "SELECT label AS stream_id, vec_id AS seq FROM embeddings WHERE vec_id % 5 <> 0 AND len(embedding) > 0",
        "audio_tail": f"SELECT label AS stream_id, flatten(list(embedding ORDER BY vec_id))[-{N}:] AS samples FROM embeddings GROUP BY label",
        "audio_head": f"SELECT label AS stream_id, flatten(list(embedding ORDER BY vec_id))[1:{N}] AS samples FROM embeddings GROUP BY label",
        "audio_concat": "SELECT vec_id - vec_id % 64 AS stream_id, flatten(list(embedding ORDER BY vec_id)) AS samples FROM embeddings GROUP BY 1",
        "audio_mix": "SELECT vec_id AS seq, list_transform(embedding::DOUBLE[], lambda x, i: x + CASE WHEN i <= 32 THEN x ELSE 0 END) AS samples FROM embeddings",
        "audio_channel0": "SELECT vec_id AS seq, embedding[1:32] AS samples FROM embeddings",
        "audio_downmix": "SELECT vec_id AS seq, list_transform(embedding[1:32]::DOUBLE[], lambda x, i: round(sqrt(2.0) * (x + embedding[i + 32]::DOUBLE) / 2, 9)) AS samples FROM embeddings",
        "chunks_union_all": "SELECT label AS stream_id, vec_id AS seq FROM embeddings UNION ALL SELECT label, vec_id FROM embeddings",
        "transcript_append": "SELECT conv_id AS stream_id, chr(10) || string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id",
        "transcript_concat": "SELECT stream_id, coalesce(string_agg(coalesce(text, ''), chr(10) ORDER BY turn) FILTER (WHERE begun), '') AS transcript FROM (SELECT conv_id AS stream_id, turn, text, bool_or(coalesce(text, '') <> '') OVER (PARTITION BY conv_id ORDER BY turn) AS begun FROM conversations) GROUP BY stream_id",
        "stream_route": _M + f" SELECT seq, stream_id, type, {_ROUTE} AS route FROM m",
    }
    out["stream_sliding"] = _M + """, w AS (SELECT time_bucket(INTERVAL 10 SECONDS, ts) - n.k * INTERVAL 10 SECONDS AS w_start, type, count(*) AS n FROM m, (VALUES (0), (1), (2)) AS n(k) GROUP BY 1, 2)
            SELECT * FROM w WHERE w_start + INTERVAL 30 SECONDS <= (SELECT max(ts) FROM m) - INTERVAL 60 SECONDS"""
    out["stream_handshake"] = out["pair_pending_ready"]
    out["pair_until_closed"] = out["pair_pending_ready"].replace("IN ('start-transcription', 'recording-state')", "IN ('start-transcription', 'recording-state', 'stop-transcription')")
    out["stream_handshake_closed"] = out["pair_until_closed"]
    out["stream_recorder"] = out["fsm_recording"]
    out |= {"hot_sessions": out["chunk_sessions"], "hot_pairs": out["pair_until_closed"], "hot_recorder": out["fsm_recording"], "hot_settings": out["settings_as_of"], "hot_trailing_30s": out["trailing_30s"], "hot_audio_tail": out["audio_tail"]}
    out["recorded_windows"] = _WINDOWS + " SELECT stream_id, seq, cause, session, setting, n_samples, oldest FROM windows"
    out["stream_recorded_windows"] = out["recorded_windows"]
    out["stream_transcripts"] = _WINDOWS + """, p AS (SELECT stream_id, session, '[stub transcribe ru: ' || n_samples || ' samples]' AS piece FROM windows)
            SELECT stream_id, session, count(*) AS n, string_agg(piece, chr(10) ORDER BY piece) AS transcript FROM p GROUP BY stream_id, session"""
    out["stream_shed_windows"] = _WINDOWS + """ SELECT stream_id, seq, session, setting, count(*) OVER (PARTITION BY stream_id, date_trunc('week', ts)) AS n_waiting,
            row_number() OVER (PARTITION BY stream_id, date_trunc('week', ts) ORDER BY ts DESC, rank DESC, seq DESC) AS place FROM windows"""
    out["stream_state_last"] = out["state_snapshot_plus_updates"]
    out["stream_settings_as_of"] = out["settings_as_of"]
    out["stream_error_ttl"] = out["error_visible_ttl"] + " WHERE next_us IS NOT NULL OR (first_us + 8000000) // 1000 + 1 < (SELECT epoch_us(max(ts)) FROM m WHERE type = 'model-status') // 1000 - 60000"
    out["stream_toasts"] = out["toast_fold"]
    out["stream_audio_tail"] = out["audio_tail"]
    return out
