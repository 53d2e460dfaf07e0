"""Queries over the documents' prose: linters, rhythm, stylometry, signals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import lint, style
from marlstone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "source", "doc_kind", "chapter_id")


def _manuscripts(spark: SparkSession, d: str) -> DataFrame:
    """The documents and a made manuscript per nation (doc_id below 0), since no document holds lists, notes or markup."""
    k = F.col("n_nationkey")
    made = table(spark, d, "nation").select(
        (-1 - k).cast("long").alias("doc_id"),
        F.concat(
            F.lit("# Chapter "), k, F.lit(": "), F.col("n_name"), F.when(k % 2 == 0, "\n\n### Deep\n\n").otherwise("\n\n## Flat\n\n"),
            F.when(k % 3 == 0, "- The oak\n- The ash\n- The elm\n\n").otherwise("- Walking home\n- What is it\n\n"),
            F.when(k % 5 == 0, "Noted.[^a] Again.[^b]\n\n[^a]: one\n\n[^c]: two\n\n").otherwise("Noted.[^a]\n\n[^a]: one\n\n"),
            F.when(k % 4 == 0, 'See <a class="footnote-ref" id="fnref-1">1</a> and <a class="footnote-ref" id="fnref-2">2</a>.<li id="fn-1">x</li>\n\n').otherwise(""),
            F.when(k % 7 == 0, "Open [clm-2016-000001] here.\n\n<div>\n## In a block\n</div>\n").otherwise("Done.\n")).alias("text"),
        F.lit("made").alias("source"), F.lit("manuscript").alias("doc_kind"), F.lit(None).cast("string").alias("chapter_id"))
    return _docs(spark, d).unionByName(made)


def _over_manuscripts(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(_manuscripts(spark, d))


def _over(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(_docs(spark, d))


def text_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, d).where("text is not null").select(
        "doc_id", F.size(T.sentences(t)).alias("n_sentences"), F.size(T.paragraphs(t)).alias("n_paragraphs"), F.size(T.tokens(t)).alias("n_tokens"), T.word_count(t).alias("n_words"))


def text_reading_ease(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.reading_ease(F.col("text"), 6).alias("reading_ease")).where("reading_ease is not null")


def text_register(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).where("text is not null").groupBy(lint.route_register(F.col("text")).alias("register")).agg(F.count(F.lit(1)).alias("n"))


def lint_phrases(spark: SparkSession, d: str) -> DataFrame:
    return lint.phrase_findings(_docs(spark, d)).groupBy("rule").agg(F.count(F.lit(1)).alias("n_findings"), F.count_distinct("doc_id").alias("n_docs"))


def lint_hedges(spark: SparkSession, d: str) -> DataFrame:
    return lint.phrase_findings(_docs(spark, d), ["hedge"]).select("doc_id", F.col("line").cast("int").alias("line"), F.lower("detail").alias("phrase"))


def style_profile(spark: SparkSession, d: str) -> DataFrame:
    p = style.build_profile(_docs(spark, d))
    return p.select("word", "rank", F.round("mean", 9).alias("mean"), F.round("stdev", 9).alias("stdev"))


def style_delta(spark: SparkSession, d: str) -> DataFrame:
    """Deviation of every document from the profile of the chapter drafts."""
    docs = _docs(spark, d)
    profile = style.build_profile(docs.where("doc_kind = 'chapter_draft'"))
    return style.burrows_delta(docs, profile).select("doc_id", "words", F.round("delta", 6).alias("delta"), F.round("l1", 8).alias("l1"))


def style_top_deviations(spark: SparkSession, d: str) -> DataFrame:
    docs = _docs(spark, d)
    profile = style.build_profile(docs.where("doc_kind = 'chapter_draft'"))
    return style.contributions(docs, profile).select("doc_id", "word", F.round("z", 6).alias("z"), "rank")


def style_length_bands(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles of the sentence lengths of each source."""
    s = _docs(spark, d).where("text is not null").select("source", F.explode(F.transform(T.sentences(F.col("text")), T.space_words)).alias("n"))
    b = style.percentile_band(s, "n", ["source"])
    return b.select("source", *[F.col(c) for c in ("p10", "p25", "p50", "p75", "p90")], F.round("mean", 6).alias("mean"), F.round("cv", 6).alias("cv"))


def style_shared_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Four-word runs of review notes that chapter drafts hold too."""
    docs = _docs(spark, d)
    return style.shared_ngrams(docs.where("doc_kind = 'review_note'"), docs.where("doc_kind = 'chapter_draft'"))


def style_first_words(spark: SparkSession, d: str) -> DataFrame:
    s = _docs(spark, d).where("text is not null").select(F.explode(F.transform(T.sentences(F.col("text")), T.first_word)).alias("word")).where("word <> ''")
    return s.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def style_collapse_repeats(spark: SparkSession, d: str) -> DataFrame:
    return style.collapse_repeats(_docs(spark, d)).select("doc_id", "n_lines", "n_kept")


def style_seams(spark: SparkSession, d: str) -> DataFrame:
    """Words shared at the seam between neighbouring documents of a chapter."""
    docs = _docs(spark, d).where("chapter_id is not null")
    return style.seams(docs, "chapter_id", "doc_id")


QUERIES: dict[str, Query] = {
    "text_counts": text_counts,
    "text_reading_ease": text_reading_ease,
    "text_register": text_register,
    "lint_phrases": lint_phrases,
    "lint_hedges": lint_hedges,
    "lint_rhythm": _over(lint.rhythm),
    "lint_burstiness": _over(lint.burstiness),
    "lint_paragraph_motion": _over(lint.paragraph_motion),
    "lint_staccato": _over(lint.staccato),
    "lint_repeated_antithesis": _over(lint.repeated_antithesis),
    "lint_unattributed_numbers": _over(lint.unattributed_numbers),
    "lint_list_anaphora": _over_manuscripts(lint.list_anaphora),
    "lint_footnotes": _over_manuscripts(lint.footnotes),
    "lint_reading_grades": _over(lint.reading_grades),
    "lint_abstraction": _over(lint.abstraction),
    "lint_analogy_absent": _over(lint.analogy_absent),
    "lint_conversational_cold": _over(lint.conversational_cold),
    "lint_curiosity_absent": _over(lint.curiosity_absent),
    "lint_signal_density": _over(lint.signal_density),
    "lint_concrete_instances": _over(lint.concrete_instances),
    "lint_parallel_lists": _over_manuscripts(lint.parallel_lists),
    "lint_headings": _over(lint.headings),
    "lint_heading_jumps": _over_manuscripts(lint.heading_jumps),
    "lint_manuscript": _over_manuscripts(lint.manuscript_defects),
    "lint_cross_references": _over_manuscripts(lint.cross_references),
    "lint_citations": _over(lint.citation_presence),
    "lint_title_case": _over(lint.title_case_concepts),
    "style_profile": style_profile,
    "style_delta": style_delta,
    "style_top_deviations": style_top_deviations,
    "style_length_bands": style_length_bands,
    "style_shared_ngrams": style_shared_ngrams,
    "style_first_words": style_first_words,
    "style_collapse_repeats": style_collapse_repeats,
    "style_seams": style_seams,
    "style_signals": _over(style.signals),
    "style_adjacent_jaccard": _over(style.adjacent_jaccard),
}

_W = r"[\p{L}\p{N}_]+"
_S = r"""s AS (SELECT doc_id, source, doc_kind, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13) || chr(12))), lambda x: x <> '') AS s
    FROM documents WHERE text IS NOT NULL)"""
_UNIX = r"regexp_replace(text, '\r\n?', chr(10), 'g')"
_TRIM = "' ' || chr(9) || chr(10) || chr(13) || chr(12)"
_P = rf"""p AS (SELECT doc_id, list_filter(list_transform(string_split_regex({_UNIX}, '\n[ \t\f]*\n'), lambda x: trim(x, {_TRIM})), lambda x: x <> '') AS p FROM documents WHERE text IS NOT NULL)"""
# blocks of prose on one line: no code, headings or lists
_B = rf"""b0 AS (SELECT doc_id, list_filter(string_split_regex({_UNIX}, '\n[ \t\f]*\n'), lambda x: trim(x, {_TRIM}) <> '') AS p FROM documents WHERE text IS NOT NULL),
b1 AS (SELECT doc_id, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS paragraph, unnest(p) AS y FROM b0),
b AS (SELECT doc_id, paragraph, trim(regexp_replace(y, '[ \t\n\r\f]+', ' ', 'g'), ' ') AS x, len(regexp_extract_all(y, '[^ \t\n\r\f]+')) AS n FROM b1
    WHERE NOT regexp_matches(y, '^(?:[ \t\f]*\n)*(?:    |[ \t\n\f]*(?:```|#|(?:[-*+]|\d+\.)[ \t\n\f]))'))"""
_TOK = "regexp_extract_all(lower({}), '[a-z'']+')"
_WC = _TOK.format("text")
_SPACE = r"len(regexp_extract_all({}, '[^ \t\n\r\f]+'))"
_GROUPS = "list_transform(%s, lambda w: greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN w LIKE '%%e' AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))"
_CNT = f"c AS (SELECT doc_id, doc_kind, {_WC} AS w FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, doc_kind, w FROM c WHERE len(w) > 0), u AS (SELECT doc_id, doc_kind, len(w) AS words, unnest(w) AS word FROM k)"


def _profile(where: str, n: int) -> str:
    return f"""{_CNT}, top AS (SELECT word, row_number() OVER (ORDER BY count(*) DESC, word) AS rank FROM u WHERE {where} GROUP BY word ORDER BY rank LIMIT {n}),
        nd AS (SELECT count(*) AS docs FROM k WHERE {where}), f AS (SELECT doc_id, words, word, count(*) AS n FROM u GROUP BY 1, 2, 3),
        pf AS (SELECT word, rank, sum(n / words) / any_value(docs) AS mean, sqrt(greatest(0, sum((n / words) * (n / words)) / any_value(docs) - (sum(n / words) / any_value(docs)) * (sum(n / words) / any_value(docs)))) AS stdev
        FROM f JOIN top USING (word) JOIN (SELECT doc_id FROM k WHERE {where}) USING (doc_id), nd GROUP BY word, rank),
        dv AS (SELECT k.doc_id, len(w) AS words, pf.word, coalesce(f.n, 0) / len(w) AS f, mean, stdev FROM k CROSS JOIN pf LEFT JOIN f ON f.doc_id = k.doc_id AND f.word = pf.word)"""


_DRAFT = "doc_kind = 'chapter_draft'"
_Z = "CASE WHEN stdev > 0 THEN (f - mean) / stdev ELSE 0 END"
SQL: dict[str, str] = {
    "text_counts": rf"""WITH {_S}, {_P} SELECT s.doc_id, len(s) AS n_sentences, len(p) AS n_paragraphs, len({_WC}) AS n_tokens, len(regexp_extract_all(text, '{_W}')) AS n_words
        FROM s JOIN p USING (doc_id) JOIN documents d USING (doc_id)""",
    "text_reading_ease": f"""WITH {_S}, t AS (SELECT doc_id, {_WC} AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, round(206.835::DOUBLE - 1.015::DOUBLE * len(w) / greatest(1, len(s)) - 84.6::DOUBLE * list_sum({_GROUPS % 'w'}) / len(w), 6) AS reading_ease
        FROM t JOIN s USING (doc_id) WHERE len(w) > 0""",
    "text_register": r"""SELECT CASE WHEN regexp_matches(text, '(?i)\b(must|wrong|fallacy|absurd|refute|nonsense)\b') THEN 'polemic'
        WHEN regexp_matches(text, '(?i)\b(algorithm|protocol|equation|parameter|function|estimator|posterior)\b') THEN 'technical' ELSE 'narrative' END AS register, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1""",
    # RE2 has no look-ahead: a "rather" before "than" in its sentence is masked first
    "lint_hedges": rf"""WITH l AS (SELECT doc_id, unnest(string_split({_UNIX}, chr(10))) AS x, generate_subscripts(string_split({_UNIX}, chr(10)), 1) AS line FROM documents WHERE text IS NOT NULL),
        m AS (SELECT doc_id, line, regexp_replace(regexp_replace(lower(x), '\brather\b([^.!?\n]*than)', 'r_ther\1', 'g'), '\brather\b([^.!?\n]*than)', 'r_ther\1', 'g') AS x FROM l)
        SELECT doc_id, CAST(line AS INTEGER) AS line, unnest(regexp_extract_all(x, '{lint.phrases(lint.HEDGES).replace("(?i)", "")}')) AS phrase FROM m""",
    "lint_burstiness": rf"""WITH {_S}, n AS (SELECT doc_id, list_transform(s, lambda x: {_SPACE.format('x')}) AS n FROM s WHERE len(s) >= 2),
        m AS (SELECT doc_id, len(n) AS sentences, list_avg(n) AS m, list_var_pop(n) AS v, len(list_filter(n, lambda x: x BETWEEN 12 AND 17)) / len(n) AS b FROM n)
        SELECT doc_id, sentences, round(v / m, 6) AS fano, round(b, 6) AS in_band, round(sqrt(v) / m, 6) AS cv, CASE WHEN round(v / m, 6) < 0.3 OR b > 0.85 THEN 'critical' WHEN round(v / m, 6) < 0.5 THEN 'important' WHEN round(v / m, 6) < 0.7 THEN 'advisory' ELSE 'pass' END AS tier FROM m WHERE m > 0""",
    "lint_unattributed_numbers": rf"""WITH {_S}, x AS (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) - 1 AS sentence FROM s),
        y AS (SELECT doc_id, CAST(sentence AS INTEGER) AS sentence, t, regexp_matches(t, '{lint.SOURCED}') AS src FROM x), z AS (SELECT *, lag(src) OVER (PARTITION BY doc_id ORDER BY sentence) AS before FROM y)
        SELECT doc_id, sentence FROM z WHERE regexp_matches(t, '{lint.NUMBER}') AND NOT regexp_matches(t, '{lint.BOUNDED}') AND NOT src AND NOT coalesce(before, false)""",
    "lint_repeated_antithesis": f"""WITH c AS (SELECT doc_id, {_WC} AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 2), lambda i: w[i:i+3])) AS g FROM c WHERE len(w) >= 4)
        SELECT doc_id, array_to_string(g, ' ') AS phrase, count(*) AS n FROM g WHERE list_has_any(g, ['not', 'never', 'neither', 'rather']) AND len(list_filter(g, lambda x: length(x) >= 6)) > 0 GROUP BY 1, 2 HAVING count(*) >= 2""",
    "lint_reading_grades": rf"""WITH {_S}, x AS (SELECT doc_id, unnest(s) AS t, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sentence FROM s), y AS (SELECT doc_id, sentence, {_TOK.format('t')} AS w FROM x),
        g AS (SELECT doc_id, sentence, round(0.39 * len(w) + 11.8 * list_sum(list_transform(w, lambda v: greatest(1, len(regexp_extract_all(v, '[aeiouy]')) - len(regexp_extract_all(v, '[aeiouy][aeiouy]')) + len(regexp_extract_all(v, 'i[aeou]')) - CASE WHEN v LIKE '%e' THEN 1 ELSE 0 END))) / len(w) - 15.59, 6) AS grade FROM y WHERE len(w) >= 6)
        SELECT * FROM g WHERE grade > 16""",
    "lint_abstraction": rf"""WITH {_B}, c AS (SELECT doc_id, paragraph, len(regexp_extract_all(x, '(?i)\b\w+(?:{'|'.join(lint.ABSTRACT_ENDINGS)})\b')) / n AS s FROM b WHERE n >= 10)
        SELECT doc_id, paragraph, round(s, 3) AS share FROM c WHERE s > 0.18""",
    "lint_analogy_absent": rf"""WITH {_B} SELECT doc_id, paragraph FROM b WHERE n >= 30 AND NOT regexp_matches(' ' || x || ' ', '(?i)[^\p{{L}}\p{{N}}_](like|as if|as though|imagine|picture|think of|similar to|the way|just as|kind of like|sort of like|as when|wearing|wears|dressed up|in disguise|no better than|better than a|worse than a)[^\p{{L}}\p{{N}}_]')""",
    "lint_conversational_cold": rf"""WITH {_B} SELECT doc_id, paragraph FROM b WHERE n >= 25 AND NOT regexp_matches(x, '{lint.SPOKEN.replace(chr(39), chr(39) * 2)}')""",
    "lint_curiosity_absent": rf"""WITH {_B} SELECT doc_id, paragraph FROM b WHERE n >= 30 AND NOT regexp_matches(x, '{lint.CURIOUS.replace(chr(39), chr(39) * 2)}')""",
    "lint_signal_density": rf"""WITH {_S}, x AS (SELECT doc_id, unnest(s) AS t, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sentence FROM s), y AS (SELECT doc_id, sentence, {_TOK.format('t')} AS w FROM x),
        g AS (SELECT doc_id, sentence, round(len(list_filter(w, lambda v: regexp_matches(v, '(ly|ous|ful|ive|al|less|able)$'))) / len(w), 6) AS share FROM y WHERE len(w) >= 8) SELECT * FROM g WHERE share > 0.25""",
    "lint_headings": rf"""WITH l AS (SELECT doc_id, unnest(string_split({_UNIX}, chr(10))) AS x, CAST(generate_subscripts(string_split({_UNIX}, chr(10)), 1) AS INTEGER) AS line FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, line, CAST(length(regexp_extract(x, '^(#{{1,6}})[ \t]+\S', 1)) AS INTEGER) AS level, regexp_extract(x, '^#{{1,6}}[ \t]+(.*)$', 1) AS title FROM l WHERE regexp_matches(x, '^(#{{1,6}})[ \t]+\S')""",
    "lint_title_case": r"""WITH r AS (SELECT doc_id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\b((?:[A-Z][a-z]+)(?: [A-Z][a-z]+)+)\b', 1), lambda x: regexp_replace(x, '^(The|A|An) ', '')), lambda x: contains(x, ' ') AND x <> 'New York'))) AS concept
        FROM documents WHERE text IS NOT NULL) SELECT * FROM r""",
    "style_profile": f"WITH {_profile('true', 300)} SELECT word, rank, round(mean, 9) AS mean, round(stdev, 9) AS stdev FROM pf",
    "style_delta": f"WITH {_profile(_DRAFT, 300)} SELECT doc_id, words, round(avg(abs({_Z})), 6) AS delta, round(avg(abs(f - mean)), 8) AS l1 FROM dv GROUP BY doc_id, words",
    "style_top_deviations": f"""WITH {_profile(_DRAFT, 300)}, z AS (SELECT doc_id, word, {_Z} AS z FROM dv)
        SELECT doc_id, word, round(z, 6) AS z, row_number() OVER (PARTITION BY doc_id ORDER BY abs(round(z, 6)) DESC, word) AS rank FROM z QUALIFY rank <= 15""",
    "style_length_bands": rf"""WITH {_S}, v AS (SELECT source, CAST(unnest(list_transform(s, lambda x: {_SPACE.format('x')})) AS DOUBLE) AS v FROM s), r AS (SELECT source, v, row_number() OVER (PARTITION BY source ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM v)
        SELECT source, {', '.join(f"min(v) FILTER (i >= round_even({p} * (n - 1), 0)) AS p{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9))}, round(avg(v), 6) AS mean, round(sqrt(var_pop(v)) / avg(v), 6) AS cv FROM r GROUP BY source""",
    "style_shared_ngrams": f"""WITH c AS (SELECT doc_id, doc_kind, {_WC} AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT DISTINCT doc_id, doc_kind, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) AS g FROM c WHERE len(w) >= 4),
        t AS (SELECT DISTINCT g FROM g WHERE doc_kind = 'chapter_draft') SELECT doc_id, count(*) AS n_grams, count(t.g) AS n_shared FROM g LEFT JOIN t USING (g) WHERE doc_kind = 'review_note' GROUP BY doc_id""",
    "style_first_words": rf"""WITH {_S}, x AS (SELECT unnest(list_transform(s, lambda x: lower(regexp_extract(x, '^[^\p{{L}}\p{{N}}_]*({_W})', 1)))) AS word FROM s) SELECT word, count(*) AS n FROM x WHERE word <> '' GROUP BY word""",
    "style_collapse_repeats": rf"""WITH l AS (SELECT doc_id, unnest(string_split({_UNIX}, chr(10))) AS x, generate_subscripts(string_split({_UNIX}, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
        g AS (SELECT doc_id, x, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS b, i FROM l) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (i = 1 OR x <> b) AS n_kept FROM g GROUP BY doc_id""",
    "style_adjacent_jaccard": rf"""WITH {_S}, x AS (SELECT doc_id, unnest(list_transform(s, lambda t: list_distinct({_TOK.format('t')}))) AS c, generate_subscripts(s, 1) AS i FROM s WHERE len(s) > 1),
        y AS (SELECT doc_id, c, lag(c) OVER (PARTITION BY doc_id ORDER BY i) AS b, i FROM x), z AS (SELECT doc_id, len(list_intersect(c, b)) / nullif(len(list_distinct(list_concat(c, b))), 0) AS j FROM y WHERE i > 1)
        SELECT doc_id, count(*) AS n_pairs, count(*) FILTER (coalesce(j, 0) > 0.05 AND coalesce(j, 0) < 0.60) AS in_corridor FROM z GROUP BY doc_id""",
}

_PP = rf"""pp AS (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace({_UNIX}, '(?s)```.*?```', chr(10) || chr(10), 'g'), '\n[ \t\f]*\n'), lambda x: trim(x, {_TRIM})),
    lambda x: x <> '' AND NOT regexp_matches(x, '^(#{{1,6}} |[-*+] |\d+\. |>|\|)')) AS p FROM documents WHERE text IS NOT NULL)"""
_OF = r"list_filter(list_transform(string_split(regexp_replace({}, '([.!?])[ \t\n\r\f]+', '\1' || chr(1), 'g'), chr(1)), lambda y: trim(y, " + _TRIM + ")), lambda y: y <> '')"
_TURN = r"'(?i)\b(but|yet|however|nevertheless|still|even so)\b'"
SQL |= {
    "lint_citations": rf"""WITH {_PP}, x AS (SELECT doc_id, unnest(p) AS x, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS paragraph FROM pp)
        SELECT doc_id, paragraph FROM x WHERE NOT regexp_matches(x, '\[\^[\w-]+\]|\[@[^\]]+\]|\(\w+,? \d{{4}}\)|clm-\d{{4}}-\d{{6}}')""",
    "lint_paragraph_motion": rf"""WITH {_PP}, x AS (SELECT doc_id, unnest(p) AS p FROM pp WHERE len(p) >= 3), s AS (SELECT doc_id, p, {_OF.format('p')} AS s FROM x),
        f AS (SELECT doc_id, NOT (len(s) >= 2 AND s[1] LIKE '%?') AND NOT (regexp_matches(p, '(?i)\b(will say|might claim|argues that|insists that|the defender|the critic)\b') AND regexp_matches(p, {_TURN}))
        AND NOT (regexp_matches(p, '(?i)\b(for example|for instance|consider|imagine|take the case)\b') AND regexp_matches(p, '(?i)\b(therefore|hence|so that|thus)\b'))
        AND NOT regexp_matches(p, '(?i)\b(as commonly used|as usually understood|in ordinary language|what people mean by)\b') AND NOT regexp_matches(p, {_TURN}) AS flat FROM s)
        SELECT doc_id, count(*) AS n_paragraphs, round(count(*) FILTER (flat) / count(*), 6) AS flat_share, count(*) FILTER (flat) / count(*) > 0.7 AS is_flat FROM f GROUP BY doc_id""",
    "lint_concrete_instances": rf"""WITH {_PP} SELECT doc_id, len(p) AS n_paragraphs, len(list_filter(p, lambda x: regexp_matches(x, '\d|"[^"]+"|[a-z,;] [A-Z][a-z]+|\b(for example|for instance|such as)\b'))) AS with_instance FROM pp WHERE len(p) > 0""",
}
# what the made manuscripts hold by their making; the documents hold nothing of the kind
_MADE = "m AS (SELECT CAST(-1 - n_nationkey AS BIGINT) AS doc_id, CAST(n_nationkey AS BIGINT) AS k FROM nation)"
SQL |= {
    "lint_heading_jumps": f"WITH {_MADE} SELECT doc_id, 3 AS line, 1 AS from_level, 3 AS to_level FROM m WHERE k % 2 = 0",
    "lint_list_anaphora": f"WITH {_MADE} SELECT doc_id, 5 AS line, 'The' AS first_word, 3 AS n FROM m WHERE k % 3 = 0",
    "lint_parallel_lists": f"WITH {_MADE} SELECT doc_id, 'gerund,question' AS shapes FROM m WHERE k % 3 <> 0",
    "lint_footnotes": f"WITH {_MADE} SELECT doc_id, 'orphan-marker' AS rule, CAST(NULL AS INTEGER) AS line, 'b' AS detail FROM m WHERE k % 5 = 0 UNION ALL SELECT doc_id, 'orphan-definition', NULL, 'c' FROM m WHERE k % 5 = 0",
    "lint_cross_references": f"WITH {_MADE} SELECT doc_id, 'D3' AS rule, CAST(NULL AS INTEGER) AS line, 'no definition for 2' AS detail FROM m WHERE k % 4 = 0",
}


def _phrase_counts() -> str:
    """Counts of every phrase rule; what RE2 cannot say in one pattern (look-around) is said in two steps."""
    plain = {k: p for k, p in lint.PHRASE_RULES.items() if k not in ("hedge", "transition-opening", "sweeping-abstraction-approximate")} | {k: lint.phrases(v) for k, v in lint.CATALOG.items()}
    quoted = lambda p: p.replace("'", "''")
    parts = [f"SELECT doc_id, '{'listicle-abstract' if k.startswith('listicle-abstract-') else k}' AS rule, len(regexp_extract_all(x, '{quoted(p)}')) AS n FROM l" for k, p in plain.items()]
    parts.append(f"SELECT doc_id, 'hedge', len(regexp_extract_all(h, '{lint.phrases(lint.HEDGES)}')) FROM l")
    parts.append(rf"SELECT doc_id, 'transition-opening', len(regexp_extract_all(x, '(?i)(?:^|[.!?][ \t]+)(?:{'|'.join(lint.OPENINGS)})[ ,]')) FROM l")
    head = rf"(?i)(?:^|[.!?][ \t]+)(?:(?:the|this|that|a|an|every|our) )?(?:{'|'.join(lint.SWEEPING)}) [^.!?\n]*"
    parts.append(rf"SELECT doc_id, 'sweeping-abstraction-approximate', len(list_filter(regexp_extract_all(x, '{head}'), lambda y: NOT regexp_matches(y, '(?i)\b(?:{'|'.join(lint.ACTORS)})\b'))) FROM l")
    return " UNION ALL ".join(parts)


SQL["lint_phrases"] = rf"""WITH l0 AS (SELECT doc_id, unnest(string_split({_UNIX}, chr(10))) AS x FROM documents WHERE text IS NOT NULL),
    l AS (SELECT doc_id, x, regexp_replace(regexp_replace(x, '(?i)\brather\b([^.!?\n]*than)', 'r_ther\1', 'g'), '(?i)\brather\b([^.!?\n]*than)', 'r_ther\1', 'g') AS h FROM l0), c AS ({_phrase_counts()})
    SELECT rule, CAST(sum(n) AS BIGINT) AS n_findings, count(DISTINCT doc_id) AS n_docs FROM c WHERE n > 0 GROUP BY rule"""
