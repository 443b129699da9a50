"""Chunking, ingest, context, citations, catalog, export and streaming on literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from marginalia.functions import tokens as K
from marginalia.limits import EngineError
from marginalia.operators import catalog, chunking, citations, context, overview
from marginalia.plans import ask, ingest
from marginalia.sinks import export
from marginalia.sources import backends, cases, fetch, files, settings
from marginalia.sources.html import html_text
from marginalia.streaming.ingest import start_ingest


def test_chunk_contexts():
    text = "# トップ\n序文。\n\n## 子1\n子1の本文。\n\n### 孫\n孫の本文。\n\n## 子2\n子2の本文。"
    found = list(dict.fromkeys(c for c, _ in chunking.chunk(text, 8, 0)))
    assert found == ["トップ", "トップ > 子1", "トップ > 子1 > 孫", "トップ > 子2"]
    for head, want in (("## Learning C#", "Learning C#"), ("# F#", "F#"), ("## Heading ##", "Heading")):
        assert chunking.chunk(head + "\nbody")[0][0] == want
    assert len(chunking.chunk("# " + "x" * 400 + "\nbody")[0][0]) == 200


def test_chunk_sizes():
    text = "\n\n".join(" ".join(f"w{i}" for i in range(n, n + 40)) + "." for n in range(0, 2000, 40))
    parts = [t for _, t in chunking.chunk(text, 100, 20)]
    assert all(K.estimate(p) <= 120 + 40 for p in parts) and "w0" in parts[0] and "w1999" in parts[-1]
    assert all(set(a.split()[-5:]) & set(b.split()[:25]) for a, b in zip(parts, parts[1:]))
    assert [t for _, t in chunking.chunk("y" * 10_000, 100, 0)] and chunking.chunk("") == [] and chunking.chunk("\n \n") == []
    assert [len(t) for _, t in chunking.chunk("Ж" * 2600, 100, 0)] == [2600]  # nothing counted, so nothing is too long
    assert max(map(len, chunking.fitted("Ж" * 2600 + " " + "a " * 200, 100))) < 2600


def test_chunk_table(spark):
    sources = spark.createDataFrame([(1, "T", "# A\nx\n\n# B\ny"), (2, "", "plain"), (3, "N", None)], "source_id long, title string, text string")
    got = chunking.chunk_sources(sources, 2, 0).orderBy("source_id", "seq").collect()
    assert [(r["source_id"], r["seq"], r["context"]) for r in got] == [(1, 0, "T > A"), (1, 1, "T > B"), (2, 0, "")]


def test_html():
    page = "<html><head><title>題名</title><style>x{}</style></head><body><script>bad()</script><h1>見出し</h1><p>本文段落。</p></body></html>"
    assert html_text(page) == ("題名", "見出し\n本文段落。")
    assert html_text("<html><head><noscript><title>Fake</noscript></head><body><p>Real content here.</p></body></html>") == ("", "Real content here.")
    assert html_text("<html><head><title>My Page</head><body><p>Content here.</p></body></html>") == ("My Page", "Content here.")
    assert html_text("<p>a<!-- open <p>b &amp; c</p>") [1].endswith("b & c")


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo\0".encode())
    (tmp_path / "b.md").write_bytes("﻿# T".encode())
    (tmp_path / "c.txt").write_bytes("日本".encode("cp932"))
    (tmp_path / "d.txt").write_bytes("wide".encode("utf-16"))
    (tmp_path / "e.docx").write_bytes(b"x")
    (tmp_path / "f.txt").write_bytes(b" \n")
    (tmp_path / "g.pdf").write_bytes(b"%PDF broken")
    got = {r["origin"].rsplit("/", 1)[1]: r for r in files.read_files(spark, f"file://{tmp_path}").collect()}
    assert {k: r["text"] for k, r in got.items() if not r["error"]} == {"a.txt": "héllo", "b.md": "# T", "c.txt": "日本", "d.txt": "wide"}
    assert got["e.docx"]["error"] == "INGEST_UNSUPPORTED_FORMAT" and got["f.txt"]["error"] == "INGEST_EMPTY"
    assert got["g.pdf"]["error"] in ("INGEST_PDF_SUPPORT_MISSING", "INGEST_PARSE_FAILED")
    types = spark.createDataFrame([("text/html; Charset='utf-8'",), ("text/plain",)], "t string")
    assert [r[0] for r in types.select(files.charset_of(F.col("t"))).collect()] == ["utf-8", None]


def test_guard():
    assert fetch.is_public("93.184.216.34") and not any(map(fetch.is_public, ("127.0.0.1", "10.0.0.1", "169.254.1.1", "::1", "0.0.0.0", "fe80::1%eth0", "224.0.0.1")))
    for url in ("ftp://example.com", "http://", "file:///etc/passwd", "http://127.0.0.1/"):
        with pytest.raises(EngineError):
            scheme, host, _, _ = fetch.checked_url(url)
            fetch.resolve(host)


def test_cases(spark, tmp_path):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps([{"q": "a", "sources": [1, 2]}, {"q": "b", "sources": []}]))
    assert [(r["query"], r["expected"]) for r in cases.read_cases(spark, f"file://{good}").collect()] == [("a", [1, 2]), ("b", [])]
    for broken in ('[{"q": " ", "sources": [1]}]', '[{"q": "a", "sources": [true]}]', '[{"sources": [1]}]', "{", '{"q": "a"}', '[{"q": 1, "sources": [1]}]'):
        bad.write_text(broken)
        with pytest.raises(EngineError):
            cases.read_cases(spark, f"file://{bad}")


def test_settings(tmp_path, monkeypatch):
    path = tmp_path / "c.json"
    path.write_text('{"lang": "ja", "embed_batch": 4, "debug": true, "llm_url": null}')
    assert settings.from_file(path) == {"lang": "ja", "embed_batch": "4"} and settings.number("embed_batch", path=path) == 4
    monkeypatch.setenv("MARGINALIA_LANG", "fr")
    assert settings.setting("lang", path) == "fr" and settings.setting("llm_url", path).startswith("http")


def answers(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "answer_id int, text string")


def test_extract_and_validate(spark):
    texts = ["根拠[S2]と[S1]、再掲[S2]。", "[S1; S3] と [S2]", "根拠［Ｓ１，Ｓ２］", "セクションS1を参照", "[S1][S2][S3][S9][S0][S100]"]
    from marginalia.functions import text as X

    rows = answers(spark, *texts).withColumn("n", citations.cited(X.nfkc("text"))).orderBy("answer_id").select("n", citations.valid(F.col("n"), F.lit(3)).alias("v"), citations.invalid(F.col("n"), F.lit(3)).alias("i")).collect()
    assert [r["n"] for r in rows[:4]] == [[1, 2], [1, 2, 3], [1, 2], []]
    assert (rows[4]["v"], rows[4]["i"]) == ([1, 2, 3], [0, 9, 100])


S1, S2 = "書庫は文書を引用付きで検索するローカルアプリである。", "和紙は楮の繊維を漉いて作られる伝統的な紙である。"
GROUNDING = [
    ("書庫は引用付きで検索する[S1]。", (S1, S2), [1], []),
    ("収益が大きく伸びた[S1]。", ("売上高は前年比15%増加した。", S2), [], []),
    ("和紙は楮から作られる[S2]。", ("和紙は楮から作られる。", "量子コンピュータは高速に計算する。"), [], [2]),
    ("書庫は引用付きで検索する[S1]。火星には恐竜が生息している[S2]。", (S1, S2), [1], []),
    ("和紙は楮の繊維から作られる紙であり[S2]、活版印刷は金属活字を組む技術である[S1]。", ("和紙は楮の繊維から作られる伝統的な紙である。", "活版印刷は金属活字を組んで版を作る技術である。"), [], [1, 2]),
    ("無関係な主張[S9]。", (S1, S2), [], []),
]


def test_grounding(spark):
    bodies = spark.createDataFrame([(i, s + 1, b) for i, (_, two, _, _) in enumerate(GROUNDING) for s, b in enumerate(two)], "answer_id int, s int, body string")
    got = {r["answer_id"]: (r["confirmed"], r["misattributed"]) for r in citations.grounding(answers(spark, *(g[0] for g in GROUNDING)), bodies).collect()}
    assert got == {i: (c, m) for i, (_, _, c, m) in enumerate(GROUNDING)}


def test_uncited(spark):
    one = "書庫は軽量LLM向けのローカルツールである。"
    want = {one: [one], one + "[S1]": [], "書庫はローカルツールである[S1]。猫は液体であるという説がある。": ["猫は液体であるという説がある。"], "はい。": [], "その件についてはソースに記載なしです。": [], "書庫とは何ですか？": [], "What is the capital of France? Paris has existed for centuries.": ["Paris has existed for centuries."]}
    got = {r["answer_id"]: r["uncited"] for r in citations.uncited(answers(spark, *want)).collect()}
    assert [got[i] for i in range(len(want))] == list(want.values())


def test_context(spark):
    hits = spark.createDataFrame([(0, 2, 5, 1, "b " * 10, "T2 > Sec"), (0, 1, 1, 2, "a " * 100, ""), (0, 2, 6, 3, "c " * 200, "T2"), (0, 9, 7, 4, "Ж" * 900, "")], "query_id int, source_id long, chunk_id long, rank int, text string, context string")
    sources = spark.createDataFrame([(1, "T1"), (2, "T2")], "source_id long, title string")
    row = context.build_context(hits, sources, 300).first()
    s = row["sources"]
    assert [(x["s"], x["source_id"], x["title"], x["section"], x["chunk_ids"]) for x in s] == [(1, 2, "T2", "Sec", [5, 6]), (2, 1, "T1", "", [1]), (3, 9, "source-9", "", [7])]
    assert K.estimate(s[0]["body"]) == 100 and "\n…\n" in s[0]["body"] and K.estimate(s[1]["body"]) == 100 and len(s[2]["body"]) == 500
    assert row["block"].startswith("[S1] T2\n<<<SOURCE S1\nb b") and row["block"].count("\n>>>") == 3


def test_history(spark):
    rows = [(1, 1, "user", "問1"), (1, 2, "assistant", "答え ［Ｓ１，Ｓ２］と[S3]に基づく。".replace("［", "[").replace("］", "]"))]
    rows += [(2, i, "user" if i % 2 else "assistant", "あ" * 4000) for i in range(1, 41)]
    rows += [(3, 1, "assistant", "x"), (3, 2, "user", "q1"), (3, 3, "user", "q2"), (3, 4, "system", "[figs 1] kept [S1]")]
    found = context.history(spark.createDataFrame(rows, "conversation int, id int, role string, body string")).orderBy("conversation", "seq").collect()
    by = {k: [(r["role"], r["body"]) for r in found if r["conversation"] == k] for k in (1, 2, 3)}
    assert len(by[1]) == 2 and "S" not in by[1][1][1] and "基づく" in by[1][1][1]
    assert len(by[2]) <= 6 and sum(K.estimate(b) for _, b in by[2]) <= 400
    assert by[3] == [("user", "q2"), ("assistant", "[figs 1] kept")]


def test_overview(spark):
    rows = [(1, i) for i in range(10)] + [(2, 0)] + [(3, i) for i in range(4)]
    chunks = spark.createDataFrame(rows, "source_id long, seq int")
    got = lambda p: sorted((r["source_id"], r["seq"]) for r in overview.sample_chunks(chunks, p).collect())
    assert got(0) == [] and got(1) == [(1, 0), (2, 0), (3, 0)] and got(3) == [(1, 0), (1, 4), (1, 9), (2, 0), (3, 0), (3, 1), (3, 3)]
    lines = spark.createDataFrame([(1, "1. What is it?\n- plain\n（2）どこですか\n? \n・Why not"), (2, "no")], "notebook_id long, text string")
    assert [r["questions"] for r in overview.suggested_questions(lines).collect()] == [["What is it?", "どこですか", "Why not"]]


def test_catalog(spark):
    tables = catalog.empty_tables(spark)
    tables["notebooks"] = catalog.upgraded(spark.createDataFrame([(1, "n1"), (2, "n2")], "id long, name string"), "notebooks")
    tables["sources"] = catalog.upgraded(spark.createDataFrame([(1, 1, "old", "h1"), (2, 2, "t2", "h2"), (3, 1, "t3", "h1")], "id long, notebook_id long, title string, sha256 string"), "sources")
    tables["chunks"] = catalog.upgraded(spark.createDataFrame([(1, 1, 0, "x"), (2, 2, 0, "y")], "id long, source_id long, seq int, text string"), "chunks")
    assert {(r["id"], r["error"]) for r in catalog.dedup_sources(tables["sources"]).collect()} == {(1, None), (2, None), (3, "SOURCE_ALREADY_EXISTS")}
    assert {(r["id"], r["n_sources"], r["n_chunks"]) for r in catalog.counts(*(tables[t] for t in ("notebooks", "sources", "chunks"))).collect()} == {(1, 2, 1), (2, 1, 1)}
    held = tables["chunks"].withColumn("context", F.lit("old > A"))
    renamed = catalog.rename_sources(dict(tables, chunks=held), spark.createDataFrame([(1, " new ")], "id long, title string"))
    assert [r["context"] for r in renamed["chunks"].orderBy("id").collect()] == ["new > A", "old > A"]
    left = catalog.delete_notebooks(tables, spark.createDataFrame([(1,)], "id long"))
    assert [left[t].count() for t in ("notebooks", "sources", "chunks")] == [1, 1, 1]
    names = spark.createDataFrame([("",), ("x" * 201,), ("ok",)], "n string").select(catalog.name_error(F.col("n")).alias("e"))
    assert [r["e"] for r in names.collect()] == ["VALIDATION_REQUIRED_FIELD_MISSING", "VALIDATION_FIELD_FORMAT_INVALID", None]
    assert {r["value"] for r in catalog.put_setting(catalog.put_setting(tables["settings"], "k", "a"), "k", "b").collect()} == {"b"}


def test_index_and_refresh(spark):
    new = spark.createDataFrame(
        [(1, 1, "txt", "a", "o1", "text one", "h1", None, None), (2, 1, "txt", "b", "o2", "text one", "h1", None, None), (3, 1, "txt", "c", "o3", "", None, "INGEST_EMPTY", None)],
        "id long, notebook_id long, kind string, title string, origin string, text string, sha256 string, error string, added_at timestamp",
    )
    empty = catalog.empty_tables(spark)
    made = ingest.index_sources(new, empty["sources"], empty["chunks"])
    assert [r["id"] for r in made.sources.collect()] == [1] and made.chunks.count() == 1
    assert {(r["origin"], r["error"]) for r in made.refused.collect()} == {("o2", "SOURCE_ALREADY_EXISTS"), ("o3", "INGEST_EMPTY")}
    tables = dict(empty, sources=made.sources, chunks=catalog.upgraded(made.chunks, "chunks"))
    fresh = spark.createDataFrame([(1, "a2", "other text", "h9")], "id long, title string, text string, sha256 string")
    after = ingest.refresh_source(tables, fresh)
    assert [(r["title"], r["sha256"]) for r in after["sources"].collect()] == [("a2", "h9")] and [r["text"] for r in after["chunks"].collect()] == ["other text"]


def test_ask_and_studio(spark):
    chunks = spark.createDataFrame([(1, 1, 1, 0, "T", "the fox is a small animal with red fur", None), (2, 2, 1, 0, "U", "nothing else", None)], "chunk_id long, source_id long, notebook_id long, seq int, context string, text string, embedding array<float>")
    sources = spark.createDataFrame([(1, "T"), (2, "U")], "source_id long, title string")
    questions = spark.createDataFrame([(1, 1, "fox fur", None), (2, 1, "qqqq zzzz", None)], "query_id long, notebook_id long, query string, vector array<float>")
    got = {r["query_id"]: r for r in ask.ask(chunks, sources, questions, backends.OfflineBackend, 2).collect()}
    assert got[1]["text"].endswith("[S1]") and got[1]["report"]["cited"] == [1] and got[1]["report"]["confirmed"] == [1]
    assert got[2]["text"] == ask.NO_HIT and got[2]["report"] is None

    class Down:
        def chat(self, messages):
            raise EngineError("SYSTEM_SERVICE_UNAVAILABLE", "down")

    down = ask.ask(chunks, sources, questions, Down, 2).filter("query_id = 1").first()
    assert down["text"].startswith(ask.DEGRADED) and down["report"]["degraded"]
    assert ask.studio(chunks, sources, "faq", backends.OfflineBackend).first()["report"]["n_sources"] == 2
    with pytest.raises(EngineError):
        ask.studio(chunks, sources, "poem", backends.OfflineBackend)
    assert ask.suggest(chunks, sources, Down).count() == 0
    assert ask.rewritten("Fox fur?", "1. fox FUR?\n- red animal\n・red animal\n3) coat of foxes") == ["red animal", "coat of foxes"]


def test_embedding(spark):
    chunks = spark.createDataFrame([(i, "c", f"text {i}", None) for i in range(5)], "id long, context string, text string, embedding array<float>")
    made = backends.embed_chunks(chunks, backends.OfflineBackend, 2)
    assert made.filter("size(embedding) = 16").count() == 5


def test_exports(spark):
    rows = [(1, 1, "url", "A_b {c}\\ ^~%&$#\nx", "http://e/x_y", "2021-03-09T12:00:00"), (2, 1, "txt", "B", "f", "")]
    sources = spark.createDataFrame(rows, "id long, notebook_id long, kind string, title string, origin string, added_at string")
    bib = export.bibtex(sources).first()["body"]
    assert "  year = {2021},\n  note = {Source, added 2021-03-09}\n}\n\n@misc{source2," in bib and bib.endswith("added unknown}\n}\n")
    assert "title = {A\\_b {\\{}c{\\}}\\\\ \\^{}\\~{}\\%\\&\\$\\# x}," in bib
    ris = export.ris(sources).first()["body"].split("\n\n")
    assert ris[0] == "TY  - ELEC\nTI  - A_b {c}\\ ^~%&$# x\nUR  - http://e/x_y\nPY  - 2021\nDA  - 2021/03/09\nER  -" and "PY" not in ris[1] and "DA  - unknown" in ris[1]
    notebooks = spark.createDataFrame([(1, "My\nbook"), (2, "None")], "id long, name string")
    notes = spark.createDataFrame([(1, 1, "note", "said")], "id long, notebook_id long, title string, body string")
    report = '{"cited":[1],"invalid":[9],"coverage":0.25,"n_sources":4,"source_map":{"S2":"B","S1":"A"},"source_contexts":{"S1":"Sec"},"confirmed":[1],"uncited":["x"]}'
    outputs = spark.createDataFrame([(1, 1, "faq", "Q", "broken")], "id long, notebook_id long, kind string, body string, citation_report string")
    messages = spark.createDataFrame([(1, 1, "user", "hi\nyou", "{}"), (2, 1, "assistant", "yes [S1]", report)], "id long, notebook_id long, role string, body string, citation_report string")
    got = {r["notebook_id"]: r["body"] for r in export.markdown(notebooks, sources, notes, outputs, messages).collect()}
    assert got[2] == "# None\n\n## Sources\n"
    status = "⚠ invalid citations: S9 / ✓ grounding confirmed: S1 / ⚠ uncited assertions (1) / ⚠ low citation coverage (1/4)"
    assert got[1] == (
        "# My book\n\n## Sources\n- [S1] A_b {c}\\ ^~%&$# x (url) — http://e/x_y\n- [S2] B (txt) — f\n\n## Notes\n### note\nsaid\n\n## Studio Output\n### faq\nQ\n\n"
        f"## Chat History\n**User**: hi you\n\n**Assistant** (sources: S1=A (§ Sec), S2=B):\nyes [S1]\n*{status}*\n"
    )
    with pytest.raises(ValueError):
        export.export("docx")


def test_streaming_ingest(spark, tmp_path):
    folder = tmp_path / "in"
    spark.createDataFrame([(1, "T", "one"), (2, "U", "two")], "source_id long, title string, text string").write.parquet(f"file://{folder}")
    for _ in range(2):  # the second run finds nothing new
        start_ingest(spark, f"file://{folder}", "source_id long, title string, text string", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 2


def test_html_that_nothing_closes():
    assert html_text("<p>a</p><noscript>hidden<p>b</p>") == ("", "a\nhidden\nb")
    assert html_text("<template>x</template><p>y<script>if (a < b) '</p>'</script>z") == ("", "yz")
    assert html_text("<p>y<style>never closed <p>z") == ("", "y")
    assert html_text("<title>A<body>b <a title='x > y'>c</a> 1 < 2") == ("A", "b c 1 < 2")
    assert html_text("<head><noscript>x</head><body>Shown &lt;b&gt;") == ("", "xShown <b>")
    assert html_text("<textarea><p>raw &amp; plain</textarea><p>t<br/>u</p><p") == ("", "<p>raw & plain\nt\nu")


def test_adjacent_markers_keep_the_first_clause():
    from marginalia.operators.citations import claims_of

    found = dict(claims_of("Alpha beta [S1] gamma delta [S2][S1].", {1, 2}))
    assert "al" in found[1] and "ga" not in found[1] and "ga" in found[2]


def test_citation_numbers_beyond_int(spark):
    from marginalia.operators import citations

    rows = spark.createDataFrame([("x [S9999999999] [S1] [S99999999999999999999]",)], "t string").select(citations.cited(F.col("t")).alias("n"))
    got = rows.select("n", citations.invalid(F.col("n"), F.lit(3)).alias("bad")).first()
    assert got["n"] == [1, 9999999999, 2**63 - 1] and got["bad"] == [9999999999, 2**63 - 1]


class _Replies:
    """An endpoint on this machine that answers with what a test lays down."""

    def __init__(self, status=200, body=b"{}", kind="application/json"):
        import http.server
        import threading

        class Handler(http.server.BaseHTTPRequestHandler):
            def do_GET(self):
                self.send_response(status)
                self.send_header("Content-Type", kind)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body)

            do_POST = do_GET

            def log_message(self, *args):
                pass

        self.server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def __enter__(self):
        return backends.HttpBackend(f"http://127.0.0.1:{self.server.server_port}/v1", "m", "e")

    def __exit__(self, *_):
        self.server.shutdown()
        self.server.server_close()


def _code(call):
    with pytest.raises(EngineError) as e:
        call()
    return e.value.code


def test_http_backend_errors():
    with _Replies(500) as b:
        assert _code(lambda: b.chat([])) == "SYSTEM_LLM_HTTP_ERROR" and _code(lambda: list(b.chat_stream([]))) == "SYSTEM_LLM_HTTP_ERROR" and not b.available()
    with _Replies(body=b"<html>", kind="text/html") as b:
        assert _code(lambda: b.chat([])) == "SYSTEM_LLM_BAD_RESPONSE" and not b.available()
    with _Replies(body=b'{"choices": [{"message": {"content": null}}], "data": [{}]}') as b:
        assert _code(lambda: b.chat([])) == _code(lambda: b.embed(["x"])) == "SYSTEM_LLM_BAD_RESPONSE" and b.available()
    with _Replies(body=b'{"choices": [{"message": {"content": "hi"}}], "data": [{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}]}') as b:
        assert b.chat([]) == "hi" and b.embed(["x", "y"]) == [[1.0], [2.0]]
    stream = b': note\ndata: {"choices": [{"delta": {"content": "a"}}]}\n\ndata: broken\ndata: {"choices": []}\ndata: {"choices": [{"delta": {"content": "b"}}]}\ndata: [DONE]\ndata: {"error": 1}\n'
    with _Replies(body=stream) as b:
        assert "".join(b.chat_stream([])) == "ab"
    with _Replies(body=b'data: {"error": "full"}\n') as b:
        assert _code(lambda: list(b.chat_stream([]))) == "SYSTEM_LLM_BAD_RESPONSE"
    for url in ("http://[::1:1/v1", "nothing://x", "http://127.0.0.1:1"):
        bad = backends.HttpBackend(url, "m", " ")
        assert _code(lambda: bad.chat([])) == "SYSTEM_SERVICE_UNAVAILABLE" and not bad.available()  # noqa: B023
    assert _code(lambda: bad.embed(["x"])) == "SYSTEM_EMBED_DISABLED"


def test_query_vectors(spark):
    asked = spark.createDataFrame([(1, "a b"), (2, None)], "query_id long, query string")
    assert [len(r["vector"]) for r in backends.query_vectors(asked, backends.OfflineBackend, "m", "m").collect()] == [16, 16]
    assert {r["vector"] for r in backends.query_vectors(asked, backends.OfflineBackend, "m", "other").collect()} == {None}


def test_url_scan(spark):
    pages = {"http://a/x": (b"<title>T</title><p>hello", "text/html", "http://a/y"), "http://a/t": ("café".encode("cp1252"), "text/plain; charset=cp1252", "http://a/t")}

    def get(url):
        if url not in pages:
            raise EngineError("INGEST_FETCH_FAILED", url)
        return pages[url]

    urls = spark.createDataFrame([(u,) for u in (*pages, "http://gone")], "url string")
    got = {r["origin"]: (r["kind"], r["title"], r["text"], r["error"]) for r in files.read_urls(urls, get).collect()}
    assert got == {
        "http://a/y": ("url", "T", "hello", None), "http://a/t": ("url", "http://a/t", "café", None), "http://gone": ("url", "http://gone", "", "INGEST_FETCH_FAILED"),
    }
    assert _code(lambda: fetch.checked_url("http://[::1")) == "INGEST_URL_BLOCKED"
