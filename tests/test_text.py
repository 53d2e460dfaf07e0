"""Prose functions, linters and style on hand-made texts, clean and dirty."""

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import lint, style


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "text string").select(column.alias("x")).first()["x"]


def rows(df, *cols):
    return {tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()}


@pytest.mark.parametrize("text,n", [("One. Two! Three? four", 4), ("", 0), ("   ", 0), ("Dr. No", 2), ("a.b c", 1), ("End.\n\nNext.", 2)])
def test_sentences(spark, text, n):
    assert len(one(spark, text, T.sentences(F.col("text")))) == n


def test_parts_of_null_and_long_texts(spark):
    assert one(spark, None, T.sentences(F.col("text"))) is None and one(spark, None, T.reading_ease(F.col("text"))) is None
    assert one(spark, "word " * 100_000, F.size(T.tokens(F.col("text")))) == 100_000
    assert one(spark, "a\r\nb\r\n\r\n# h\n\nc\n\n- item\n\n```\ncode\n\ncode\n```\n\nd", T.prose_paragraphs(F.col("text"))) == ["a\nb", "c", "d"]


@pytest.mark.parametrize("word,groups,pairs", [("cake", 1, 1), ("the", 1, 1), ("reading", 2, 2), ("idea", 2, 3), ("x", 1, 1), ("queue", 1, 1)])
def test_syllables(spark, word, groups, pairs):
    assert one(spark, word, T.syllables_by_groups(F.col("text"))) == groups
    assert one(spark, word, T.syllables_by_pairs(F.col("text"))) >= 1


def test_small_functions(spark):
    assert one(spark, " Hello, World! ", T.slug(F.col("text"))) == "hello-world" and one(spark, ".\\src//a.py", T.normal_path(F.col("text"))) == "src/a.py"
    assert one(spark, "Use `load_it()` and os.path.join", T.symbol_mentions(F.col("text"))) == ["load_it", "os.path.join"] and one(spark, "Max Load (kN)", T.canonical_name(F.col("text"), F.lit("B-1"))) == "max_load_kn_b_1"
    assert one(spark, "x", T.nearest_rank(F.array(*[F.lit(i) for i in range(1, 11)]), 0.25)) == 3


def test_phrase_findings(spark):
    d = docs(spark, "It may rain.\nPerhaps, clearly.", "Nothing here.", None, "", "Moreover, it is often done — clm-2020-000001")
    got = rows(lint.phrase_findings(d, ["hedge", "false-certainty", "transition-opening", "orphan-claim-token", "em-dash"]), "doc_id", "rule", "line")
    assert got == {(0, "hedge", 1), (0, "hedge", 2), (0, "false-certainty", 2), (4, "transition-opening", 1), (4, "hedge", 1), (4, "orphan-claim-token", 1), (4, "em-dash", 1)}


def test_phrase_columns_and_bounds(spark):
    d = docs(spark, "It may be quite odd.", "I would rather go than stay, rather.", "So it is. Moreover, a system fails", "The system that a judge built", "Method rests on 3 premises.\u0001")
    got = rows(lint.phrase_findings(d), "doc_id", "rule", "detail", "column")
    assert {(0, "hedge", "may", 4), (0, "hedge", "quite", 11), (1, "hedge", "rather", 30), (2, "transition-opening", "Moreover", 11)} <= got and (1, "hedge", "rather", 9) not in got
    assert not any(r[0] == 3 and r[1].startswith("sweeping") for r in got) and {(4, "listicle-abstract", "rests on 3 premise", 8), (4, "listicle-abstract", "rests on 3 premises", 8)} <= got
    assert rows(lint.phrase_findings(d, ["mine"], {"mine": ["odd"]}), "doc_id", "detail", "column") == {(0, "odd", 17)}


def test_cold_and_incurious(spark):
    plain = "word " * 29 + "word"
    d = docs(spark, plain, plain + " what if", "# heading\n\n" + plain + " you", "- " + plain, None, "")
    assert rows(lint.conversational_cold(d), "doc_id", "paragraph") == {(0, 0), (1, 0)}
    assert rows(lint.curiosity_absent(d), "doc_id", "paragraph") == {(0, 0), (2, 1)}


def greedy(counts, k=4, tol=3):
    i = hits = 0
    while i <= len(counts) - k:
        if max(counts[i: i + k]) - min(counts[i: i + k]) <= tol:
            hits, i = hits + 1, i + k
        else:
            i += 1
    return hits


def test_rhythm(spark):
    same = " ".join(f"The {'very ' * (i % 3)}dog ran." for i in range(9))
    d = docs(spark, same, "One. " + "Two words here now and then some more. One. " * 3, "")
    got = {r["doc_id"]: r for r in lint.rhythm(d).collect()}
    assert got[0]["uniform_length"] == greedy([3 + i % 3 for i in range(9)]) == 2 and got[0]["repeated_opening"] == 1
    assert got[1]["uniform_length"] == 0 and got[1]["repeated_opening"] == 0 and got[2]["uniform_length"] == 0


def test_burstiness(spark):
    flat, mixed = "a b c d. " * 6, "a. " + "b c d e f g h i j k l m n o p q r s t. " + "a b. c d e f g h. i."
    got = {r["doc_id"]: r for r in lint.burstiness(docs(spark, flat, mixed, "one")).collect()}
    assert got[0]["fano"] == 0 and got[0]["tier"] == "critical" and got[1]["tier"] == "pass" and 2 not in got


def test_paragraph_shapes(spark):
    shapes = {"Is it? Yes it is.": "question_answer", "The critic objects. Still it holds.": "concession_turn", "For example a dog. Therefore a cat.": "example_inference", "As commonly used it means x.": "definition_by_pressure",
              "It is so. But it is not.": "contrast", "It is so.": "assertion_only", "It is so. It stays.": "assertion_justification"}
    d = docs(spark, *shapes)
    assert {r["text"]: r["s"] for r in d.select("text", lint.paragraph_shape(F.col("text")).alias("s")).collect()} == shapes
    m = lint.paragraph_motion(docs(spark, "A is so.\n\nB is so.\n\nC is so.", "A is so. But no.\n\nBut yet.\n\nC.")).collect()
    assert {(r["doc_id"], r["is_flat"]) for r in m} == {(0, True), (1, False)}


def test_staccato(spark):
    short = "\n\n".join(["A is b. C is d."] * 3)
    closers = "\n\n".join(f"Some longer opening sentence number {i} that goes on. This is the end." for i in range(3))
    template = "\n\n".join(["The city is not a map. It is a story."] * 2)
    contrast = "\n\n".join([f"First {i}. We chose truth rather than comfort." for i in range(3)])
    run = "The system grows. The system works. The system fails. The system ends."
    got = rows(lint.staccato(docs(spark, short, closers, template, contrast, run, "Calm text of one sentence only.", None)), "doc_id", "rule")
    assert (0, "staccato-paragraph-run") in got and (1, "this-is-conclusion-overuse") in got and (2, "negation-affirmation-template") in got and (3, "antithesis-closer-overuse") in got and (4, "abstract-subject-run-approximate") in got
    assert not any(d in (5, 6) for d, _ in got)


def test_other_linters(spark):
    assert rows(lint.repeated_antithesis(docs(spark, "It is necessary and not sufficient, so necessary and not sufficient.")), "phrase", "n") == {("necessary and not sufficient", 2)}
    d = docs(spark, "We saw 40 cases. The source is clear. Then 50 more. At least 3 were new. And 7 came.")
    assert rows(lint.unattributed_numbers(d)) == {(0, 0), (0, 4)}
    assert rows(lint.list_anaphora(docs(spark, "- We go\n- We stay\n- We rest\n- You go\n\n1. We end")), "line", "first_word", "n") == {(1, "We", 3)}
    assert rows(lint.footnotes(docs(spark, "A[^1] b[^2].\n\n[^1]: one\n[^3]: three\n```\n[^9]\n```")), "rule", "detail") == {("orphan-marker", "2"), ("orphan-definition", "3")}
    assert rows(lint.abstraction(docs(spark, "The realization of the organization of the nation and the creation of justice is here")), "paragraph") == {(0,)}
    assert rows(lint.citation_presence(docs(spark, "Cited [^1] here.\n\nNot cited.")), "paragraph") == {(1,)}
    assert rows(lint.title_case_concepts(docs(spark, "The Grand Canal and New York met Grand Canal at Rome.")), "concept") == {("Grand Canal",)}
    assert [r["r"] for r in docs(spark, "It is nonsense.", "the algorithm", "once").select(lint.route_register(F.col("text")).alias("r")).collect()] == ["polemic", "technical", "narrative"]


def test_manuscripts(spark):
    body = "\n\n".join("word " * n for n in (40, 80, 120, 60))
    clean = f"# Chapter 1: One\n\n{'word ' * 1500}\n\n{body}\n" + 'class="footnote-ref"' * 4
    dirty = "# Chapter 2: Two\n\n### Deep\n\nclm-2020-000001 short\n\n<div>\n# inside\n</div>\n\n---\n\n## Glossary\n\nx"
    got = rows(lint.manuscript_defects(docs(spark, clean, dirty)), "doc_id", "rule")
    assert {r for d, r in got if d == 1} >= {"D1", "D2", "D4", "D5"} and (0, "D1") not in got and (0, "D4") not in got
    assert rows(lint.heading_jumps(docs(spark, "# a\n## b\n#### c\n# d")), "line", "from_level", "to_level") == {(3, 2, 4)}
    assert rows(lint.cross_references(docs(spark, 'x class="footnote-ref" id="fnref-1" <li id="fn-2">')), "detail") == {("no definition for 1",), ("no reference to 2",)}
    assets = spark.createDataFrame([("img/a.png",)], "path string")
    assert rows(lint.missing_assets(docs(spark, '![x](img/a.png) ![y](./img/b.png) <img src="https://x/y.png">'), assets), "detail") == {("img/b.png",)}
    assert lint.css_reset(docs(spark, "h1,h2,h3{font-size:inherit}", "h1,h2,h3{font-size:inherit} h1 {font-size: 2em}")).count() == 1
    with pytest.raises(ValueError):
        lint.lint_fragment(docs(spark, "x"), ["nothing"])
    assert lint.lint_fragment(docs(spark, "It may be.", None)).count() >= 1


def test_stylometry(spark):
    d = docs(spark, "the cat the dog", "the the the the", "a cat sat", "", None)
    top = [(r["word"], r["n"], r["rank"]) for r in style.most_common_words(d, 2).orderBy("rank").collect()]
    assert top == [("the", 6, 1), ("cat", 2, 2)]
    p = {r["word"]: r for r in style.build_profile(d, 2).collect()}
    assert p["the"]["mean"] == pytest.approx((0.5 + 1 + 0) / 3)
    delta = {r["doc_id"]: r for r in style.burrows_delta(d, style.build_profile(d, 2)).collect()}
    f = [[0.5, 0.25], [1, 0], [0, 1 / 3]]
    for i in range(3):
        want = 0
        for j in range(2):
            col = [x[j] for x in f]
            m = sum(col) / 3
            want += abs(f[i][j] - m) / (sum((x - m) ** 2 for x in col) / 3) ** 0.5 / 2
        assert delta[i]["delta"] == pytest.approx(want)
    v = spark.createDataFrame([(0.5, 2000), (1.1, 2000), (9.0, 2000), (0.5, 10)], "d double, w int").select(style.delta_verdict(F.col("d"), F.col("w"), 0.4, 0.8).alias("v"))
    assert [r["v"] for r in v.collect()] == ["in-band", "near", "out", "abstain"]
    assert style.contributions(d, style.build_profile(d, 2), 1).count() == 3


def test_bands_and_overlap(spark):
    d = spark.createDataFrame([("g", float(i)) for i in range(11)] + [("h", 5.0), ("h", None)], "g string, v double")
    got = {r["g"]: r for r in style.percentile_band(d, "v", ["g"]).collect()}
    assert (got["g"]["p10"], got["g"]["p50"], got["g"]["p90"]) == (1.0, 5.0, 9.0) and got["h"]["p25"] == 5.0 and got["h"]["cv"] == 0
    s = style.shared_ngrams(docs(spark, "one two three four five", "x y"), docs(spark, "zero one two three four"))
    assert rows(s) == {(0, 2, 1)}
    assert rows(style.collapse_repeats(docs(spark, "a\na\nb\na")), "n_lines", "n_kept", "text") == {(4, 3, "a\nb\na")}
    sm = spark.createDataFrame([(1, "c", "x. The ledger holds."), (2, "c", "A ledger falls. y"), (3, "d", "z")], "doc_id int, ch string, text string")
    assert rows(style.seams(sm, "ch", "doc_id")) == {("c", 2, 1)}


def test_signals_are_shares(spark):
    d = docs(spark, "Why is it so? The ledger explains every single case clearly. For example, 3 dogs ran.", "", None, "One.")
    for r in style.signals(d).collect():
        assert all(0 <= r[c] <= 1 for c in r.asDict() if c != "doc_id")
    assert next(r["curiosity"] for r in style.signals(d).collect() if r["doc_id"] == 0) == 1.0
    assert rows(style.concreteness(docs(spark, "stone idea stone"), spark.createDataFrame([("stone", 5.0), ("idea", 1.0)], "word string, rating double")), "rated", "mean_rating") == {(3, 11 / 3)}
