"""Literal rows of the rules, held against expected values and not against another engine."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scribewell.functions import languages, web
from scribewell.functions import settings as records
from scribewell.operators import audio, notices, providers, state, transcripts
from scribewell.plans import distill

D = ("transcribe", None, False, "english", "auto")


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (None, D), ("", D), ("{bad", D), ("null", D), ("5", D), ('"x"', D), ("{}", D), ("[]", D),
        ('{"language":"english"}', ("transcribe", "english", False, "english", "auto")),
        ('{"language":"english/x"}', ("transcribe", "english/x", False, "english/x", "auto")),
        ('{"language":"spanish/castilian","includeMicrophone":"false"}', ("translate", None, True, "spanish/castilian", "auto")),
        ('{"language":""}', ("translate", None, False, "", "auto")),
        ('{"language":null}', ("translate", None, False, "english", "auto")),
        ('{"language":5}', D),
        ('{"language":"x","includeMicrophone":0}', ("translate", None, False, "x", "auto")),
        ('{"language":"x","includeMicrophone":{}}', ("translate", None, True, "x", "auto")),
        ('{"mode":null}', (None, None, False, "english", "auto")),
        ('{"mode":"translate","language":"english"}', ("translate", None, False, "english", "auto")),
    ],
)
def test_settings_migrate(spark, text, expected):
    row = spark.createDataFrame([(text,)], "t string").select(records.migrated(F.col("t")).alias("r")).first()["r"]
    assert (row["mode"], row["transcribeLanguage"], row["includeMicrophone"], row["summarizationLanguage"], row["whisperModel"]) == expected


def test_capturable(spark):
    rows = [("https://a", True), ("chrome://x", False), ("about:blank", False), ("CHROME://x", True), (None, False), ("", False), ("moz-extension://x", True)]
    df = spark.createDataFrame(rows, "url string, want boolean")
    assert df.where(web.capturable(F.col("url")) != F.col("want")).count() == 0
    assert [r[0] for r in df.where(~web.capturable(F.col("url"), web.BLOCKED_EXTENDED) & (F.col("url") != "")).orderBy("url").collect()] == ["about:blank", "chrome://x", "moz-extension://x"]


def test_language_names(spark):
    df = spark.createDataFrame([("english", "English"), ("spanish/castilian", "Spanish/Castilian"), ("haitian creole/haitian", "Haitian creole/Haitian")], "n string, want string")
    assert df.where(languages.display_name(F.col("n")) != F.col("want")).count() == 0
    assert len(languages.LANGUAGES) == len(set(languages.LANGUAGES.values())) == 99
    assert sum("/" in x for x in languages.LANGUAGES.values()) == 10


def test_tail_and_head(spark):
    rows = [([1, 2, 3], [1, 2, 3], [1, 2, 3]), ([1, 2, 3, 4, 5, 6, 7], [3, 4, 5, 6, 7], [1, 2, 3, 4, 5]), ([], [], [])]
    for samples, tail, head in rows:
        got = spark.createDataFrame([(samples,)], "s array<int>").select(audio.tail(F.col("s"), 5), audio.head(F.col("s"), 5)).first()
        assert (list(got[0]), list(got[1])) == (tail, head)


def test_stream_tail_sheds_chunks(spark):
    chunks = spark.createDataFrame([(1, i, [float(i)] * 3) for i in range(10)] + [(2, 0, [1.0]), (3, 0, []), (4, 0, None)], "stream_id int, seq long, samples array<float>")
    assert audio.trailing_chunks(chunks, 5).where("stream_id = 1").count() == 2
    got = {r["stream_id"]: list(r["samples"]) for r in audio.stream_tails(chunks, 5).collect()}
    assert got == {1: [8.0, 8.0, 9.0, 9.0, 9.0], 2: [1.0]}


def test_transcript_folds(spark):
    pieces = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "b"), (2, 1, ""), (2, 2, "a")], "stream_id int, seq int, piece string")
    assert dict(transcripts.appended(pieces).collect()) == {1: "\na\n\nb", 2: "\n\na"}
    assert dict(transcripts.joined(pieces).collect()) == {1: "a\n\nb", 2: "a"}


def test_head_lines(spark):
    for n in (39, 40, 41):
        text = "\n".join(map(str, range(n)))
        assert spark.createDataFrame([(text,)], "t string").select(distill.head_lines(F.col("t"))).first()[0] == "\n".join(map(str, range(min(n, 40))))
    assert spark.createDataFrame([("",)], "t string").select(distill.head_lines(F.col("t"))).first()[0] == ""


def test_rough_html(spark):
    html = '<head><title>T &amp; U</title><script>var t="</p>";</script></head><!-- c --><div class="ad">no</div><article><h1>Head</h1><p><b>one<br><p>two &amp; &lt;three</p></article><footer>no</footer>'
    df = spark.createDataFrame([(1, "https://a", html), (2, "chrome://a", html), (3, "https://b", "<p>x</p>"), (4, None, html), (5, "https://c", None)], "page_id long, url string, html string")
    (row,) = distill.distilled(df).collect()
    assert (row["page_id"], row["title"]) == (1, "T & U")
    # bold text that isn't ended goes on in the paragraphs that follow
    assert row["body"] == "# Head\n\n**one**\n\n**two & <three**"


def markdown_of(spark, *pages, of=distill.markdown):
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    return [r[0] for r in rows.orderBy("i").select(of(F.col("html"))).collect()]


def test_markdown_marks(spark):
    cases = {
        '<p>see <a class="x" href="/u?a=1">the <b>page</b></a>, <a href=\'v\'>it</a><a href="n"></a></p>': "see [the **page**](/u?a=1), [it](v)",
        '<p><img src="a.png" alt="A"> <img alt="B" src="b.png"/><img width=1 src="c.png"></p>': "![A](a.png) ![B](b.png)![](c.png)",
        "<OL start=1><LI>one</LI><li>two <i>x</i></li></OL><ul><li>three</li></ul>": "1.  one\n2.  two _x_\n\n*   three",
        "<p>run <code>a b</code>:</p><pre><code>if x:\n    y  = 1\n</code></pre><p>end": "run `a b`:\n\n```\nif x:\n    y  = 1\n```\n\nend",
        "<h4>Four</h4><h6 id=a>Six</h6><hr/><blockquote><p>said</p></blockquote>": "#### Four\n\n###### Six\n\n* * *\n\n> said",
        "<table><tr><td>a</td><td>b</td></tr></table>": "a\n\nb",
        "&ldquo;x&rdquo; &mdash; &amp;lt;<!-- <b> --><bdi>y</bdi>": "“x” — &lt;y",
        "<ol><li>a<ol><li>x<li>y</ol><li>b<ul><li>c<p>d</p></ul></ol>": "1.  a\n    1.  x\n    2.  y\n2.  b\n    *   c\n\n        d",
        "<ol start=9><li>nine<li>ten</ol>": "9.  nine\n10. ten",
        "<table><tr><th>a<th>b<tr><td>1|2<td>&#8217;<tr><td>z</table>": "| a | b |\n| --- | --- |\n| 1\\|2 | ’ |\n| z |  |",
        "<p>a*b_c [x] &eacute; &#x2014;</p>": "a\\*b\\_c \\[x\\] é —",
        "<p>- x<br>1. y<p># z<p>1.5": "\\- x  \n1\\. y\n\n\\# z\n\n1.5",
        "<p><b> one <strong>two</strong> </b>three <i></i>.": "**one two** three .",
        "<blockquote>a<blockquote>b</blockquote><ul><li>c</ul></blockquote>": "> a\n>\n> > b\n>\n> *   c",
        '<pre class="language-py">a = "```"</pre><p><code>`x`</code>': '````py\na = "```"\n````\n\n`` `x` ``',
        '<p><a href="u" title="say">x <img src=i> y</a>': '[x ![](i) y](u "say")',
        "": "",
        None: None,
    }
    assert markdown_of(spark, *cases) == list(cases.values())


def test_articles_are_scored(spark):
    long = "A paragraph that goes on for a while, with commas, and with more than enough words."
    menu = '<div><p><a href="/a">A link of the menu that goes on and on, and on</a></p></div>'
    pages = {
        f"<body><nav><p>{long}</p></nav>{menu}<div><p>{long}</p><p>short</p></div><footer>{long}</footer></body>": f"<p>{long}</p><p>short</p>",
        f"<div><p>{long}</p></div><div><p>x</p></div><div><p>{long}</p></div>": f"<p>{long}</p>\n<p>{long}</p>",
        f"<article><p>{long[:30]}</p></article><article class=x><p>{long}</p></article><article></article>": f"<p>{long}</p>",
        f"<article>t</article><p>{long}</p>": "t",
        # what follows a nested article belongs to the outer one
        f"<article>a<article>{long}</article>after</article><p>{long}</p>": f"a<article>{long}</article>after",
        f"<body><p>{long}<p>x<p>{long}": f"<p>{long}\n<p>{long}",
        # paragraphs make their container and the one around it worth something
        f"<div id=a><div id=b><p>{long}</p><p>{long}</p></div><div><p>{long}</p></div><div><a href=x>{long}</a></div></div>": f"<p>{long}</p><p>{long}</p>\n<p>{long}</p>",
        f"<div hidden><p>{long}{long}</p></div><div><p>{long}</p></div>": f"<p>{long}</p>",
        "<article></article>": "",
        "<p>x</p>": "",
        "": "",
        None: None,
    }
    assert markdown_of(spark, *pages, of=distill.article) == list(pages.values())


def test_notices(spark):
    log = [(1, 1, "ADD", "a", "A"), (1, 2, "ADD", "b", "B"), (1, 3, "UPDATE", "b", "C"), (1, 4, "UPDATE", "z", "D"), (1, 5, "DISMISS", None, None), (2, 1, "ADD", "a", "A"), (2, 2, "REMOVE", None, None), (3, 1, "ADD", "a", "A"), (3, 2, "REMOVE", "z", None)]
    rows = spark.createDataFrame(log, notices.ACTION)
    got = {(r["stream_id"], r["id"], r["title"], r["open"]) for r in notices.folded(rows).collect()}
    assert got == {(1, "b", "C", False), (3, "a", "A", True)}
    assert notices.scheduled_once(spark.createDataFrame([(1, 1, "x"), (1, 2, "x")], "stream_id long, seq long, id string")).count() == 1


def test_pairs(spark):
    rows = [(1, "ready"), (2, "pending"), (3, "pending"), (4, "ready"), (5, "ready"), (6, "pending")]
    df = spark.createDataFrame([(7, i, i, k) for i, k in rows], "stream_id long, ts long, seq long, type string")
    assert [tuple(r) for r in state.paired(df, F.col("type") == "pending", F.col("type") == "ready").collect()] == [(7, 3, 4)]


def test_a_closing_message_forgets_what_is_pending(spark):
    rows = [(1, "pending"), (2, "closed"), (3, "ready"), (4, "pending"), (5, "ready")]
    df = spark.createDataFrame([(7, i, i, k) for i, k in rows], "stream_id long, ts long, seq long, type string")
    is_ = lambda k: F.col("type") == k
    assert [tuple(r) for r in state.paired(df, is_("pending"), is_("ready"), is_("closed")).collect()] == [(7, 4, 5)]


def test_old_timers_clear_new_errors(spark):
    df = spark.sql("SELECT 1 AS stream_id, id AS seq, TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(0, 0, 0, s) AS ts FROM VALUES (1, 0), (2, 5), (3, 20) AS t(id, s)")
    got = {r["seq"]: r["shown_us"] for r in state.shown(df, F.lit(True)).collect()}
    assert got == {1: 5_000_000, 2: 3_000_000, 3: 8_000_000}


def test_fallback_moves_on_once(spark):
    windows = spark.createDataFrame([(1, [0.5], "ru", "transcribe"), (2, [], "ru", "transcribe")], "stream_id int, samples array<float>, language string, task string").coalesce(1)
    stub = providers.StubTranscriber
    got = {r["stream_id"]: tuple(r)[1:] for r in providers.transcribed(windows, [lambda: stub("webgpu", "WebGPU lost"), stub]).collect()}
    assert got == {1: (["[stub transcribe ru: 1 samples]"], "wasm", "ok"), 2: (None, "wasm", "ok")}
    got = providers.transcribed(windows, [lambda: stub("webgpu", "oom"), stub]).first()
    assert (got["backend"], got["status"]) == ("webgpu", "error: oom")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=4), min_size=1, max_size=6), st.integers(1, 8))
def test_tails_are_suffixes(spark, parts, n):
    df = spark.createDataFrame([(0, i, [float(x) for x in p]) for i, p in enumerate(parts)], "stream_id int, seq long, samples array<float>")
    whole = [float(x) for p in parts for x in p]
    got = [list(r["samples"]) for r in audio.stream_tails(df, n).collect()]
    assert got == ([whole[-n:]] if whole else [])


def test_unknown_keys_are_kept(spark):
    rows = [('{"mode":"translate","extra":5}', '{"extra":5}'), ('{"a":"x","b":null}', '{"a":"x","b":null}'), ('{"language":"english","extra":1}', "{}"), ("[]", "{}"), ("{bad", "{}"), (None, "{}")]
    df = spark.createDataFrame(rows, "json string, want string")
    assert [(r["got"], r["want"]) for r in df.select(records.unknown(F.col("json")).alias("got"), "want").collect() if r["got"] != r["want"]] == []
    text = F.col("json")
    whole = [r[0] for r in df.select(records.stored_with(records.migrated(text), records.unknown(text))).collect()]
    assert whole[0] == '{"mode":"translate","transcribeLanguage":null,"translateTargetLanguage":"english","includeMicrophone":false,"summarizationLanguage":"english","whisperModel":"auto","extra":5}'
    assert whole[3].endswith('"whisperModel":"auto"}')


def test_start_outcomes(spark):
    rows = [("https://a", True, None, "h", "start"), ("chrome://a", True, None, "h", "capture-error"), ("https://a", True, None, None, "capture-error"), ("https://a", False, True, None, "wait"), ("https://a", False, False, "h", "capture-error")]
    df = spark.createDataFrame(rows, "url string, has boolean, made boolean, handle string, want string")
    got = df.select(web.start_outcome(F.col("url"), F.col("has"), F.col("made"), F.col("handle")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_summaries_are_translated_and_failures_shown(spark):
    class Broken(providers.StubTextModel):
        def prompt(self, text):
            raise RuntimeError("no model")

    html = "<title>T</title><article><h1>Head</h1></article>"
    pages = spark.createDataFrame([(1, "https://a", html, "japanese"), (2, "https://b", html, "english"), (3, "chrome://c", html, "english")], "page_id long, url string, html string, language string")
    stub = providers.StubTextModel
    got = {r["page_id"]: (r["text"], r["status"]) for r in distill.summarized(pages, [stub], [stub]).collect()}
    assert got == {1: ("# [T](https://a)\n\n[stub summary] [stub summary] # Head", "ok"), 2: ("# [T](https://b)\n\n[stub summary] # Head", "ok")}
    got = {r["page_id"]: r["text"] for r in distill.summarized(pages, [stub], [Broken]).collect()}
    assert got == {1: "Failed to summarize: error: no model", 2: "# [T](https://b)\n\n[stub summary] # Head"}


def test_notices_go_by_themselves_in_a_stream(spark, tmp_path):
    from scribewell.streaming import streams

    # stream 1: dismissed, and the timer runs out by a later action; 2: by the watermark; 3: the second dismissal starts nothing; 4: not dismissed
    rows = [(1, 1, 0, "ADD", "a", "A"), (1, 2, 10, "DISMISS", "a", None), (1, 3, 2000, "UPDATE", "a", "B")]
    rows += [(2, 4, 0, "ADD", "b", "A"), (2, 5, 10, "DISMISS", None, None)]
    rows += [(3, 6, 0, "ADD", "c", "A"), (3, 7, 1500, "DISMISS", "c", None), (3, 8, 2000, "DISMISS", "c", None), (3, 9, 2100, "UPDATE", "c", "B")]
    rows += [(4, 10, 0, "ADD", "d", "A"), (4, 11, 5, "ADD", "e", "E"), (4, 12, 6, "REMOVE", "d", None)]
    df = spark.createDataFrame(rows, "stream_id long, seq long, s long, action string, id string, title string").withColumn("ts", F.timestamp_seconds(F.col("s") + 86_400)).drop("s")
    df.coalesce(1).write.parquet(str(tmp_path / "log"))
    log = spark.readStream.schema(df.schema).parquet(str(tmp_path / "log"))
    found = streams.drained(streams.notices_kept(log, 1, 1_000_000), "update")
    last = found.groupBy("stream_id").agg(F.max_by(F.struct("ids", "titles", "opened"), "batch_id").alias("x"))
    got = {r["stream_id"]: (r["x"]["ids"], r["x"]["titles"], r["x"]["opened"]) for r in last.collect()}
    assert got == {1: ([], [], []), 2: ([], [], []), 3: (["c"], ["B"], [False]), 4: (["e"], ["E"], [True])}
    log = spark.readStream.schema(df.schema).parquet(str(tmp_path / "log"))
    found = streams.drained(streams.notices_kept(log, 1), "update").where("stream_id = 2").collect()
    assert [(r["ids"], r["opened"]) for r in found] == [(["b"], [False])]


def test_errors_in_a_stream_are_cleared_by_older_timers(spark, tmp_path):
    from scribewell.streaming import streams

    # the timer of 0 s clears what came at 5 s; that of 5 s, which no error waits for, clears what came at 10 s
    times = [(1, 1, 0), (1, 2, 5), (1, 3, 10), (1, 4, 40), (2, 5, 300)]
    df = spark.createDataFrame(times, "stream_id long, seq long, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 86_400)).drop("s")
    for i, part in enumerate(("seq <= 2", "seq > 2")):
        df.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "errors"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "errors"))
    got = {r["seq"]: r["shown_us"] for r in streams.drained(streams.errors_shown(stream)).collect()}
    assert got == {1: 5_000_000, 2: 3_000_000, 3: 3_000_000, 4: 8_000_000}


def test_capabilities_and_warm_up(spark):
    from scribewell.operators.providers import StubTranscriber, capabilities

    keys = spark.createDataFrame([(1,), (2,)], "page_id long").coalesce(1)
    of = lambda *backends: {(r["available"], r["backend"]) for r in capabilities(keys, list(backends)).collect()}
    assert of(lambda: StubTranscriber("webgpu", starts_with="JSEP not there"), StubTranscriber) == {("readily", "wasm")}
    # an error that no other backend mends ends the search
    assert of(lambda: StubTranscriber("webgpu", starts_with="out of memory"), StubTranscriber) == {("error: out of memory", None)}
    assert of(lambda: StubTranscriber("wasm", starts_with="WebGPU"), StubTranscriber) == {("error: WebGPU", None)}
    assert of() == {("no", None)}
    windows = spark.createDataFrame([(1, [0.5], "ru", "transcribe")], "stream_id int, samples array<float>, language string, task string")
    from scribewell.operators.providers import transcribed

    row = transcribed(windows, [lambda: StubTranscriber("webgpu", starts_with="WebGPU")]).first()
    assert (row["outputs"], row["backend"], row["status"]) == (None, None, "error: WebGPU")
    assert transcribed(windows, []).first()["status"] == "no_provider"


def test_migration_by_literal_rows(spark):
    """mode, language, microphone, language of summaries; by reading the rules, not from either engine."""
    default = ("transcribe", None, False, "english")
    cases = {
        '{"language":0}': default,  # no text has no "includes", and the error gives the initial value
        '{"language":false}': default,
        '{"language":5}': default,
        '{"language":{}}': default,
        '{"language":["a","/"]}': default,
        '{"language":["x"]}': ("translate", None, False, '["x"]'),
        '{"language":null}': ("translate", None, False, "english"),
        '{"language":""}': ("translate", None, False, ""),
        '{"language":" english"}': ("translate", None, False, " english"),  # only what stands before a slash is trimmed
        '{"language":" english /x"}': ("transcribe", " english /x", False, " english /x"),
        '{"language":"english"}': ("transcribe", "english", False, "english"),
        '{"language":"english/x","includeMicrophone":"false"}': ("transcribe", "english/x", True, "english/x"),
        '{"language":"a/english"}': ("translate", None, False, "a/english"),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "json string").select("json", records.migrated(F.col("json")).alias("r")).select("json", "r.*").collect()
    assert {r["json"]: (r["mode"], r["transcribeLanguage"], r["includeMicrophone"], r["summarizationLanguage"]) for r in rows} == cases


def test_values_as_they_are_shown(spark):
    cases = {
        '{"b":[1,2.0,{"c":null}],"a":"x\\u00e9\\n"}': '{\n  "b": [\n    1,\n    2,\n    {\n      "c": null\n    }\n  ],\n  "a": "xé\\n"\n}',
        '{"b":1,"10":2,"9":3,"01":4}': '{\n  "9": 3,\n  "10": 2,\n  "b": 1,\n  "01": 4\n}',
        "[]": "[]",
        '{"a":{}}': '{\n  "a": {}\n}',
        '"text"': "text",
        "1.50": "1.5",
        "1e21": "1e+21",
        "1e-7": "1e-7",
        "0.000001": "0.000001",
        "1.5e-5": "0.000015",
        "true": "true",
        "null": "",
        "{bad": "",
        None: "",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "json string").select("json", web.rendered(F.col("json")).alias("shown")).collect()
    assert {r["json"]: r["shown"] for r in rows} == cases


def test_references_need_no_semicolon(spark):
    """As HTML has it: a headline that is cut off inside an escaped sign."""
    assert markdown_of(spark, "<h1>this and&amp</h1><p>a &lt b &copy c &amp;amp &am") == ["# this and&\n\na < b © c &amp &am"]
