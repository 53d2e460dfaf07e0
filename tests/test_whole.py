"""Queries over whole profiles, witness lists and constraints."""

import collections
import re
import statistics

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pytest

import __spark_entry__ as entry
from marlstone.operators import belief, lint, nested, style, timestamps
from marlstone.plans import rules


def test_style_over_the_whole_profile(spark, tmp_path):
    # the word of rank r is in documents 0 to 3, and more often in lower ones, so that 300 of the 320 words are kept
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(320)]
    texts = [" ".join(w for i, w in enumerate(words) for _ in range(1 + (320 - i) * (k + 1) // 90)) for k in range(4)]
    docs = [(f"d{k}", t, "s", "chapter_draft", "c") for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id string, text string, source string, doc_kind string, chapter_id string").write.parquet(str(tmp_path / "documents.parquet"))
    counts = [collections.Counter(t.split()) for t in texts]
    total = sum(counts, collections.Counter())
    common = sorted(total, key=lambda w: (-total[w], w))[:300]
    freq = [{w: c[w] / c.total() for w in common} for c in counts]
    mean = {w: statistics.fmean(f[w] for f in freq) for w in common}
    dev = {w: statistics.pstdev([f[w] for f in freq]) for w in common}
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    profile = {r["word"]: r for r in run("style_profile")}
    assert [profile[w]["rank"] for w in common] == list(range(1, 301)) and len(profile) == 300
    assert all(profile[w]["mean"] == pytest.approx(mean[w], abs=2e-9) and profile[w]["stdev"] == pytest.approx(dev[w], abs=2e-9) for w in common)
    z = [{w: (f[w] - mean[w]) / dev[w] for w in common} for f in freq]
    delta = {r["doc_id"]: r for r in run("style_delta")}
    for k in range(4):
        assert delta[f"d{k}"]["delta"] == pytest.approx(statistics.fmean(map(abs, z[k].values())), abs=2e-6)
        assert delta[f"d{k}"]["l1"] == pytest.approx(statistics.fmean(abs(freq[k][w] - mean[w]) for w in common), abs=2e-8)
    top = collections.defaultdict(list)
    for r in run("style_top_deviations"):
        top[r["doc_id"]].append((r["rank"], r["word"], r["z"]))
    for k in range(4):
        got = sorted(top[f"d{k}"])
        assert [r[0] for r in got] == list(range(1, 16))
        assert [abs(r[2]) for r in got] == pytest.approx(sorted(map(abs, z[k].values()), reverse=True)[:15], abs=2e-6)
        assert all(r[2] == pytest.approx(z[k][r[1]], abs=2e-6) for r in got)


def odd_prose(spark, path):
    """Documents of more than a block with words at the edges of texts, other scripts and no words; their frequencies, means and deviations."""
    odd = ["the", "the", "end of", "ofthe", "", " ", None, "it's 'tis don't", "The\r\nCAT", "\u212aing \u0130stanbul na\u00efve \u00e9the\u00e9", "1a2b_c", "\u4e2d\u6587", "12 - 34"]
    texts = odd + [f"the cat sat on w{chr(97 + i % 26)} " * (1 + i % 7) for i in range(1200)] + ["the cat sat on words of it " * 200, "dogs ran " * 600]
    docs = [(i, t, "s", "chapter_draft" if i % 3 else "digest", "c") for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, source string, doc_kind string, chapter_id string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    counts = {i: collections.Counter(re.findall("[a-z']+", (t or "").lower())) for i, t, *_ in docs}
    counts = {i: c for i, c in counts.items() if c}
    total = sum((c for i, c in counts.items() if i % 3), collections.Counter())
    common = sorted(total, key=lambda w: (-total[w], w))[:300]
    freq = {i: {w: c[w] / c.total() for w in common} for i, c in counts.items()}
    mean = {w: statistics.fmean(f[w] for i, f in freq.items() if i % 3) for w in common}
    dev = {w: statistics.pstdev([f[w] for i, f in freq.items() if i % 3]) for w in common}
    z = {i: {w: (f[w] - mean[w]) / dev[w] for w in common} for i, f in freq.items()}
    return counts, {i: {w: f[w] - mean[w] for w in common} for i, f in freq.items()}, z


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_verdicts_move_no_documents(spark, tmp_path):
    counts, _, z = odd_prose(spark, tmp_path)
    df = entry.queries()["style_verdicts"](spark, str(tmp_path))
    assert not re.search("Exchange|Join|Generate", plan(df))
    delta = {i: statistics.fmean(map(abs, x.values())) for i, x in z.items()}
    assert {r["doc_id"]: r["verdict"] for r in df.collect()} == {
        i: "abstain" if c.total() < 1000 else "in-band" if delta[i] <= 0.75 else "near" if delta[i] <= 0.95 else "out" for i, c in counts.items()}


def test_deltas_move_no_documents(spark, tmp_path):
    counts, off, z = odd_prose(spark, tmp_path)
    df = entry.queries()["style_delta"](spark, str(tmp_path))
    assert not re.search("Exchange|Join|Generate", plan(df))
    got = {r["doc_id"]: r for r in df.collect()}
    assert {i: r["words"] for i, r in got.items()} == {i: c.total() for i, c in counts.items()}
    for i, r in got.items():
        assert r["delta"] == pytest.approx(statistics.fmean(map(abs, z[i].values())), abs=2e-6)
        assert r["l1"] == pytest.approx(statistics.fmean(map(abs, off[i].values())), abs=2e-8)
    none = style.burrows_delta(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), style.build_profile(spark.createDataFrame([(1, "1 2"), (2, None)], "doc_id long, text string")))
    assert none.columns == ["doc_id", "words", "delta", "l1"] and none.count() == 0


def test_deltas_take_long_documents_in_small_blocks(spark, tmp_path):
    # 60 documents of 200 kB, and one longer than a block: they came as one block, with nine times their bytes in a worker
    texts = [f"the cat sat on w{chr(97 + i % 26)} " * 10_000 + "and the dog ran " * (i + 1) for i in range(60)] + ["a dog of the end " * 150_000]
    docs = [(i, t, "s", "chapter_draft" if i % 3 else "digest", "c") for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, doc_kind string, chapter_id string").coalesce(1)
    df.write.parquet(str(tmp_path / "documents.parquet"))

    def fold(keys, words, n):
        return pa.RecordBatch.from_arrays([pa.array([len(keys)], pa.int64()), pa.array([int(pc.sum(pc.binary_length(words)).as_py())], pa.int64())], names=["docs", "bytes"])

    blocks = style._over_blocks(spark.read.parquet(str(tmp_path / "documents.parquet")), "docs long, bytes long", fold).collect()
    assert sum(b["docs"] for b in blocks) == 61 and sum(b["bytes"] for b in blocks) == sum(len(t.replace(" ", "")) for t in texts)
    assert all(b["docs"] == 1 or b["bytes"] <= 2 << 20 for b in blocks) and 7 <= len(blocks) <= 20

    counts = [collections.Counter(t.split()) for t in texts]
    common = set().union(*(c for i, c in enumerate(counts) if i % 3))
    freq = [{w: c[w] / c.total() for w in common} for c in counts]
    mean = {w: statistics.fmean(f[w] for i, f in enumerate(freq) if i % 3) for w in common}
    dev = {w: statistics.pstdev([f[w] for i, f in enumerate(freq) if i % 3]) for w in common}
    got = {r["doc_id"]: r for r in entry.queries()["style_delta"](spark, str(tmp_path)).collect()}
    assert {i: r["words"] for i, r in got.items()} == {i: c.total() for i, c in enumerate(counts)}
    for i, f in enumerate(freq):
        assert got[i]["delta"] == pytest.approx(statistics.fmean(abs(f[w] - mean[w]) / dev[w] for w in common), abs=2e-6)
        assert got[i]["l1"] == pytest.approx(statistics.fmean(abs(f[w] - mean[w]) for w in common), abs=2e-8)


def test_top_deviations_move_no_documents(spark, tmp_path):
    _, _, z = odd_prose(spark, tmp_path)
    df = entry.queries()["style_top_deviations"](spark, str(tmp_path))
    assert not re.search("Exchange|Join|Window", plan(df))
    got = collections.defaultdict(dict)
    for r in df.collect():
        got[r["doc_id"]][r["rank"]] = (r["word"], r["z"])
    assert got.keys() == z.keys()
    for i, rows in got.items():
        assert list(sorted(rows)) == list(range(1, 1 + min(15, len(z[i]))))
        assert all(v == pytest.approx(z[i][w], abs=2e-6) for w, v in rows.values())
        assert [abs(rows[r][1]) for r in sorted(rows)] == pytest.approx(sorted(map(abs, z[i].values()), reverse=True)[:15], abs=2e-6)
        assert [rows[r] for r in sorted(rows)] == sorted(rows.values(), key=lambda x: (-abs(x[1]), x[0]))


def test_ties_of_deviations_go_by_word(spark):
    # to six decimals b and c deviate alike, though c's frequency is a trifle further from the mean
    profile = spark.createDataFrame([("c", 0.3 + 1e-9, 1.0), ("b", 0.3, 1.0), ("d", 0.5, 0.0), ("a", 0.1, 1.0)], "word string, mean double, stdev double")
    docs = spark.createDataFrame([(1, "x y"), (2, "a a"), (3, "...")], "doc_id long, text string")
    got = lambda k: sorted((r["doc_id"], r["rank"], r["word"]) for r in style.contributions(docs, profile, k).collect())
    assert got(1) == [(1, 1, "b"), (2, 1, "a")] and got(0) == []
    every = [(1, 1, "b"), (1, 2, "c"), (1, 3, "a"), (1, 4, "d"), (2, 1, "a"), (2, 2, "b"), (2, 3, "c"), (2, 4, "d")]
    assert got(4) == every and got(9) == every


def test_all_witnesses_with_parents_first(spark):
    c = spark.createDataFrame([("a", True), ("b", False), ("c", True), ("d", True)], "claim_id string, load_bearing boolean")
    s = spark.createDataFrame([("a", "d", str(i)) for i in range(8)] + [("b", "d", "x"), ("c", "d", "0")], "claim_id string, doc_id string, locator_text string")
    e = spark.createDataFrame([("z", "a"), ("p", "a"), ("p", "a"), (None, "a"), ("q", "b")], "parent string, claim_id string")
    got = lambda *k: {r["claim_id"]: (r["witnesses"], r["truncated"]) for r in belief.why_provenance(c, s, *k, parents=e).collect()}
    every = ["parent-claim:p", "parent-claim:z"] + [f"d|{i}" for i in range(8)]
    assert got(None) == {"a": (every, False), "c": (["d|0"], False), "d": ([], False)}
    assert got(9)["a"] == (every[:9], True) and got(10)["a"] == (every, False)


def test_defects_count_every_witness(spark):
    facts = spark.createDataFrame([(f"{i:02d}", "s", "a", -1.0) for i in range(30)] + [("40", "t", "a", 1.0), ("41", None, "a", -1.0)], "claim_id string, subject string, predicate string, value_num double")
    cs = rules.parse_constraints("(defconstraint :pos :assert (> a 0)) (defconstraint :all :scope :corpus :assert (> a 0))")
    checks, every = rules.check_constraints(facts, cs), rules.constraint_witnesses(facts, cs)
    ids = [f"{i:02d}" for i in range(30)]
    got = {(r["constraint"], r["subject"]): (r["witnesses"], r["n_witnesses"]) for r in checks.collect()}
    assert got == {("pos", "s"): (ids[:20], 30), ("pos", "t"): (["40"], 1), ("pos", None): (["41"], 1), ("all", "*"): (ids[:20], 32)}
    assert every.count() == 32 + 32
    claims = spark.createDataFrame([(i, 0.1 if i == "25" else 0.9 if i == "26" else 0.4) for i in [*ids, "40", "41"]], "claim_id string, confidence double")
    d = rules.defect_confidence(checks, claims, witnesses=every)
    assert {(r["constraint"], r["subject"], r["confidence"], r["severity"]) for r in d.collect()} == {("pos", "s", 0.1, "critical"), ("all", "*", 0.1, "critical"), ("pos", None, 0.4, "important")}
    assert rules.verdict_confidence(d).first()[0] == pytest.approx((0.1 * 0.1 * 0.4) ** (1 / 3))
    with pytest.raises(Exception, match="cut"):
        rules.defect_confidence(checks, claims).collect()


def test_drumbeats_are_exempt(spark):
    beat = "The cat sat. The old dog ran far away. The bird sang a song. The rain fell on green hills. "
    texts = {
        "beat": beat + "Then all was still.", "not capped": beat.strip(), "content word": beat.replace("The", "Cats") + "Then all was still.",
        "one length": "The cat sat. The dog ran. The bird sang. The rain fell. Then all was still.",
        "same words": "The cat sat down. The cat sat down here. The cat sat down. The cat sat down here. Then all was still.",
        "two runs": beat + "Then all. " + beat.strip(), "short": "The cat. The dog.", "none": "",
    }
    d = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    got = {r["doc_id"]: (r["repeated_opening"], r["parallel_list"]) for r in lint.rhythm(d).collect()}
    assert got == {"beat": (0, 1), "not capped": (1, 0), "content word": (1, 0), "one length": (1, 0), "same words": (1, 0), "two runs": (1, 1), "short": (0, 0), "none": (0, 0)}


def test_analogy_is_asked_from_thirty_words(spark):
    long = "word " * 30
    blocks = [long, "word " * 29, long + "as\nif", long + "likely", "# " + long, "- " + long, "    " + long, "```\n" + long, "> " + long]
    d = spark.createDataFrame([("a", "\n\n\n".join(blocks)), ("b", None)], "doc_id string, text string")
    assert sorted((r["doc_id"], r["paragraph"]) for r in lint.analogy_absent(d).collect()) == [("a", 0), ("a", 3), ("a", 8)]


def test_texts_of_any_length_name_instants():
    texts = ["2024-01-02T03:04:05.1234567Z", "2024-01-02T03:04:05." + "1234567" * 20 + "Z", "2024-01-02" + " " * 90 + "03:04:05", "1704164645." + "1" * 90, "x" * 5000, "2024-01-02" + " " * 5000 + "x"]
    out = timestamps.to_utc_micros(pd.Series(texts), pd.Series([None] * 6), pd.Series([None] * 6), {}).tolist()
    t = 1704164645_000000
    assert out == [t + 123456, t + 123456, t, t + 111111, timestamps.NONE, timestamps.NONE]


def test_bare_numbers_of_any_year():
    # 1999, 2019, 2030 and 2040 in seconds, milli-, micro- and nanoseconds
    seconds = [915148800, 1546300800, 1893456000, 2208988800]
    texts = [str(s * 10**p) for s in seconds for p in (0, 3, 6, 9)]
    out = timestamps.to_utc_micros(pd.Series(texts), pd.Series([None] * 16), pd.Series([None] * 16), {}).tolist()
    assert out == [s * 10**6 for s in seconds for _ in range(4)]
    short = timestamps.to_utc_micros(pd.Series(["2024", "20240102", "0"]), pd.Series([None] * 3), pd.Series([None] * 3), {}).tolist()
    assert short == [timestamps.NONE] * 3


def test_tables_by_schema_path(spark):
    one = '{"id": "a", "n": 3, "spans": [{"doc": "x", "loc": {"page": 1}}, null, {"doc": "y"}, "bare"], "tags": ["p", "q"], "grid": [[{"v": 1}], [{"v": 2}]], "key": "own"}'
    rows = [(1, one), (1, one), (2, '{"id": "b", "spans": "[{\\"doc\\": \\"z\\"}]"}'), (3, "{damaged"), (4, None), (5, "[1, 2]")]
    t = nested.flat_tables(spark.createDataFrame(rows, "key int, payload string"), "key", "payload", ("spans",))
    got = lambda path, *cols: sorted((tuple(r[c] for c in cols) for r in t[path].collect()), key=str)
    assert set(t) == {"$", "$.spans[]", "$.spans[]#value", "$.spans[].loc", "$.tags[]", "$.grid[][]", "$[]"}
    assert got("$", "key", "dewey", "owner_dewey", "id", "n", "key_") == [(1, "", None, "a", "3", "own"), (2, "", None, "b", None, None)]
    assert got("$.spans[]", "key", "dewey", "owner_dewey", "doc") == [(1, "000002.000000", "", "x"), (1, "000002.000002", "", "y"), (2, "000001.000000", "", "z")]
    assert got("$.spans[].loc", "key", "owner_dewey", "page") == [(1, "000002.000000", "1")]
    assert got("$.tags[]", "dewey", "owner_dewey", "value") == [("000003.000000", "", "p"), ("000003.000001", "", "q")]
    assert got("$.grid[][]", "dewey", "owner_dewey", "v") == [("000004.000000.000000", "", "1"), ("000004.000001.000000", "", "2")]
    assert got("$.spans[]#value", "value") == [("bare",), (None,)] and got("$[]", "key", "owner_dewey", "value") == [(5, None, "1"), (5, None, "2")]
    assert nested.flat_tables(spark.createDataFrame([], "key int, payload string"), "key", "payload") == {}
