"""File sources, sinks, streams, storage, the entry module."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.sources import documents, ledgers
from marlstone.storage import Scratch, shared_dir
from marlstone.streaming import ledger_stream


def rows(df, *cols):
    return {tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()}


def texts(spark, **files):
    return spark.createDataFrame([(k.replace("__", "/"), v) for k, v in files.items()], "path string, text string")


def test_jsonl(spark, tmp_path):
    f = tmp_path / "ledger.jsonl"
    f.write_text('{"claim_id": "a", "confidence": 0.5, "source_spans": [{"doc_id": "d"}]}\n\nnot json\n{"claim_id": "b", "extra": 1}\n')
    df = ledgers.read_jsonl(spark, str(f), ledgers.CLAIM)
    assert [(r["claim_id"], r["confidence"]) for r in df.orderBy("_seq").collect()] == [("a", 0.5), ("b", None)]
    assert rows(ledgers.read_jsonl(spark, str(f), ledgers.CLAIM, damaged=True)) == {("not json",)}
    out = str(tmp_path / "out")
    ledgers.append_jsonl(df.select("claim_id"), out)
    ledgers.append_jsonl(df.select("claim_id"), out)
    assert spark.read.json(out).count() == 4
    ledgers.write_snapshot(df.drop("_seq"), str(tmp_path / "snap"), "s1")
    with pytest.raises(Exception):
        ledgers.write_snapshot(df.drop("_seq"), str(tmp_path / "snap"), "s1")
    assert ("a", "canonical_text is missing") in rows(ledgers.validate_claims(df))


def test_manifests_and_files(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text(json.dumps({"doc_id": "d", "sha256": "x"}, indent=1))
    (tmp_path / "m" / "b.json").write_text("{}")
    assert rows(ledgers.read_manifests(spark, str(tmp_path / "m")), "doc_id", "trust") == {("d", 1.0)}
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "Page One.md").write_text("---\ntitle: First\n---\n# Other")
    t = documents.read_texts(spark, str(tmp_path / "w"))
    assert rows(documents.wiki_pages(t), "id", "title") == {("page-20one", "First")} or rows(documents.wiki_pages(t), "title") == {("First",)}
    assert ledgers.not_ingested(t, spark.createDataFrame([("x",)], "sha256 string")).count() == 1


def test_traces_and_locators(spark):
    c = spark.createDataFrame([("a", "verified", 5), ("b", "x", None)], "claim_id string, status string, utc_us long")
    k = spark.createDataFrame([("k", "a", "open", 3)], "id string, target_claim_id string, status string, utc_us long")
    e = spark.createDataFrame([("a", "verified", "disputed", 9)], "claim_id string, `from` string, `to` string, utc_us long")
    t = ledgers.event_trace(c, k, e)
    assert [(r["at_us"], r["kind"]) for r in t.orderBy("at_us").collect()] == [(3, "counter-claim"), (5, "claim"), (9, "transition")]
    assert rows(ledgers.trace_to_ledger(t)) == {("a", "verified", 5), ("a", "disputed", 9)}
    s = spark.createDataFrame([("a", "d", "Hello   WORLD"), ("b", "d", "nope"), ("c", "zz", "x"), ("e", "d", None)], "claim_id string, doc_id string, locator_text string")
    v = ledgers.verify_locators(s, spark.createDataFrame([("d", "say hello\nworld " + "x" * 300)], "doc_id string, text string"))
    assert rows(v, "claim_id", "found", "is_thin") == {("a", True, False), ("b", False, False), ("c", False, True)}


def test_markdown_captions_html(spark):
    h = documents.heading_tree(texts(spark, a="# A\ntext\n## B\n#### C\n## D\n# E"))
    assert rows(h, "line", "level", "title", "parent_line") == {(1, 1, "A", None), (3, 2, "B", 1), (4, 4, "C", 3), (5, 2, "D", 1), (6, 1, "E", None)}
    vtt = "WEBVTT\n\n1\n00:01.000 --> 00:02.000\n<v Bob>Hello</v>\n\n00:00:03.500 --> 00:04.000\nHello\n\n01:00:05,000 --> 01:00:06,000\nBye\nnow"
    assert rows(documents.captions(texts(spark, a=vtt)), "start", "text") == {(1.0, "Hello"), (3605.0, "Bye\nnow")}
    assert documents.html_text("<html><nav>menu</nav><h2>T</h2><p>One &amp; two<br>three</p><script>x</script><ul><li>i</ul>") == "## T\n\nOne & two\n\nthree\n\n- i"
    pages = spark.createDataFrame([(1, "<p>a"), (2, None), (3, "")], "page_id int, html string")
    assert rows(documents.html_to_text(pages), "page_id", "text") == {(1, "a"), (2, None), (3, "")}


def test_triples_and_graphs(spark, tmp_path):
    t = documents.turtle_triples(texts(spark, a='@prefix x: <http://x#> .\n# note\nx:a a x:Thing ;\n  x:says "hi; there, you" , x:b .\nx:Editor rdfs:subClassOf x:Person .\n'))
    assert rows(t, "s", "p", "o") == {("x:a", "rdf:type", "x:Thing"), ("x:a", "x:says", "hi; there, you"), ("x:a", "x:says", "x:b"), ("x:Editor", "rdfs:subClassOf", "x:Person")}
    assert rows(documents.taxonomy_audit(t, ["x:Person"], ["editor"])) == {("x:Editor", "x:Person")}
    f = tmp_path / "g.json"
    f.write_text(json.dumps({"nodes": [{"id": "a", "label": "a.py", "source_file": "./s/a.py"}, {"id": "b"}], "links": [{"source": "a", "target": "b", "relation": "contains"}, {"source": "a", "target": "zz", "relation": "uses"}]}))
    n, e = documents.code_graph(spark, str(f))
    assert rows(n, "id", "source_file") == {("a", "s/a.py"), ("b", None)} and rows(e, "source_id", "target_id", "weight") == {("a", "b", 1.0)}
    th = documents.read_thesis(spark, json.dumps({"book_id": "b", "thesis": {"statement": "s"}, "sub_arguments": [{"id": "x", "required_evidence": ["e"], "advanced_by_chapters": ["ch-1"]}], "invariants": [{"id": "i", "rule": "r"}]}))
    assert rows(th["sub-argument"], "id", "parent") == {("x", "b")} and th["sub-arg-evidence"].count() == 1 and th["invariant"].count() == 1


def test_design_notes(spark):
    spec = "# Spec\n\n### Requirement: REQ-1\nThe engine `load` works\nwell.\n\n#### Scenario: happy path\nx\n\n### Requirement: REQ-2\nother\n"
    d = texts(spark, specs__cap__spec_md=spec)
    assert rows(documents.requirements(d), "requirement_id", "capability", "text", "source_line") == {("REQ-1", "cap", "The engine `load` works well.", 3), ("REQ-2", "cap", "other", 10)}
    assert rows(documents.scenarios(d), "requirement_id", "text", "source_line") == {("REQ-1", "happy path", 7)}
    assert rows(documents.decisions(texts(spark, a="## Decision: Use Spark\n## Other")), "kind", "text") == {("decision", "Use Spark")}
    sh = "# Run it\n```bash\n# note\nmake all\n```\n```python\nx\n```\n## Then\n```sh\nls\n```"
    assert rows(documents.commands(texts(spark, a=sh)), "command", "shell", "purpose") == {("make all", "sh", "Run it"), ("ls", "sh", "Then")}
    t = spark.createDataFrame([("t/test_io.py", "def test_a():\n  pass\nasync def test_b(): pass\ndef x(): pass"), ("t/a.rs", "fn works() {}")], "path string, text string")
    assert rows(documents.tests(t), "name", "framework", "target") == {("test_a", "pytest", "io"), ("test_b", "pytest", "io"), ("works", "cargo", "a")}
    y = "name: CI\non:\n  push:\n  pull_request:\njobs:\n  unit:\n    steps:\n      - run: pytest t/test_io.py\n      - run: echo\n  lint:\n    steps: []\n"
    w = spark.createDataFrame([("ci/main.yml", y)], "path string, text string")
    assert rows(documents.workflows(w), "name", "trigger") == {("CI", "push,pull_request")} and rows(documents.jobs(w), "name", "command") == {("unit", "pytest t/test_io.py && echo"), ("lint", "")}


def test_streams(spark, tmp_path):
    src, target, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "k string, n int, v string"
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], schema).coalesce(1).write.parquet(src)
    df = spark.read.parquet(src)
    ledger_stream.keep_latest(ledger_stream.read_stream(spark, src, df.schema), "k", "n", target, cp).awaitTermination()
    spark.createDataFrame([("a", 3, "z"), ("b", 0, "late"), ("c", 1, "w")], schema).coalesce(1).write.mode("append").parquet(src)
    ledger_stream.keep_latest(ledger_stream.read_stream(spark, src, df.schema), "k", "n", target, cp).awaitTermination()
    assert rows(ledger_stream.read_latest(spark, target), "k", "v") == {("a", "z"), ("b", "y"), ("c", "w")}


def test_windows_on_streams(spark, data, tmp_path):
    ev = spark.read.parquet(f"{data}/events.parquet")
    src = str(tmp_path / "ev")
    ev.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type").coalesce(1).write.parquet(src)
    batch = spark.read.parquet(src)
    stream = ledger_stream.read_stream(spark, src, batch.schema)
    for name, df in (("w", ledger_stream.windowed_counts(stream, "ts", "event_type")), ("s", ledger_stream.sessions(stream, "ts", "user_id"))):
        df.writeStream.format("memory").queryName(f"out_{name}").outputMode("complete" if name == "w" else "append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"c{name}")).start().awaitTermination()
    assert spark.table("out_w").agg(F.sum("n")).first()[0] == batch.count()
    assert 0 < spark.table("out_s").agg(F.sum("n")).first()[0] <= batch.count()
    once = ledger_stream.distinct_rows(stream, "ts", ["event_id"])
    once.writeStream.format("memory").queryName("out_d").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cd")).start().awaitTermination()
    assert spark.table("out_d").count() == batch.select("event_id").distinct().count()
    bad = ledger_stream.bad_transitions(spark.createDataFrame([("a", 1, "refuted"), ("a", 2, "verified")], "k string, n int, s string"), "k", "s", "n")
    assert rows(bad, "from_status", "to_status") == {("refuted", "verified")}


def test_scratch(spark):
    s = Scratch(spark, "t")
    df = s.keep(spark.range(5))
    assert df.count() == 5 and s.root.startswith(shared_dir(spark))
    s.drop(df)
    with pytest.raises(Exception):
        spark.read.parquet(f"{s.root}/0").count()
