"""Stylometry and liveliness: profiles of corpora and scores of texts against them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators.ordered import lag_in_buckets

#: Words of a profile, and the least words of a text that a verdict is given for.
TOP_WORDS, LEAST_WORDS = 300, 1000
#: Documents, and bytes of their texts, whose words are counted at once in a worker: that takes some nine times the bytes.
BLOCK, BLOCK_BYTES = 1024, 2 << 20
#: The bytes of T.TOKEN; no other character's UTF-8 has them.
_IN_WORD = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz'"))


def word_counts(docs: DataFrame) -> DataFrame:
    """doc_id, word, n, words (all words of the document). Counts are summed within a task first."""
    rows = docs.where("text is not null").select("doc_id", T.tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    return rows.select("doc_id", F.size("w").alias("words"), F.explode("w").alias("word")).groupBy("doc_id", "words", "word").agg(F.count(F.lit(1)).alias("n"))


def _split(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words (T.tokens) of lower-case texts, one after another, and how many each text has."""
    text = text.cast(pa.large_string())
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at, inside = at - at[0], _IN_WORD[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    ends = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(ends), pa.py_buffer(data[inside])])
    return words, np.diff(np.searchsorted(begin, at))


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows with at most BLOCK rows and BLOCK_BYTES of text (column 1, no nulls), or one longer text."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < batch.num_rows:
        fit = int(np.searchsorted(ends, (ends[i - 1] if i else 0) + BLOCK_BYTES, "right")) - i
        n = max(1, min(fit, BLOCK))
        yield batch.slice(i, n)
        i += n


def _over_blocks(docs: DataFrame, schema: str, fold: Callable[[pa.Array, pa.Array, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """What fold makes of the keys, all words and numbers of words of each block of documents with words.

    A document's words stay in the task that read it: nothing is shuffled and no list of words is built row by row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block in _blocks(b):
                words, n = _split(block.column(1))
                if len(words):
                    yield fold(block.column(0).filter(pa.array(n > 0)), words, n[n > 0])

    return docs.where("text is not null").select("doc_id", F.lower("text").alias("text")).mapInArrow(run, schema)


def _frequencies(words: pa.Array, n: np.ndarray, listed: pa.Array) -> np.ndarray:
    """The relative frequency of each listed word (columns) in each document (rows)."""
    at = pc.index_in(words, value_set=listed).fill_null(-1).to_numpy(zero_copy_only=False)
    cell = (np.repeat(np.arange(len(n)) * len(listed), n) + at)[at >= 0]
    return np.bincount(cell, minlength=len(n) * len(listed)).reshape(len(n), len(listed)) / n[:, None]


def most_common_words(docs: DataFrame, n: int = TOP_WORDS) -> DataFrame:
    """word, n, rank of the n most common words; ties in the order of the word."""

    def fold(_: pa.Array, words: pa.Array, __: np.ndarray) -> pa.RecordBatch:
        word, count = words.value_counts().flatten()
        return pa.RecordBatch.from_arrays([word.cast(pa.string()), count], names=["word", "n"])

    rows = _over_blocks(docs, "word string, n long", fold).groupBy("word").agg(F.sum("n").alias("n"))
    top = rows.orderBy(F.col("n").desc(), "word").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "word")))


def build_profile(docs: DataFrame, n: int = TOP_WORDS) -> DataFrame:
    """word, rank, mean, stdev of the relative frequency of each common word over the documents with words.

    At most n rows; the words themselves are gathered first. Documents without the word count 0.
    """
    top = sorted((r["rank"], r["word"]) for r in most_common_words(docs, n).collect())
    listed = [word for _, word in top]

    def fold(_: pa.Array, words: pa.Array, total: np.ndarray) -> pa.RecordBatch:
        f = _frequencies(words, total, pa.array(listed, pa.large_string()))
        sums = [pa.array(f.sum(axis=0)), pa.array((f * f).sum(axis=0)), pa.array(np.full(len(listed), len(f)))]
        return pa.RecordBatch.from_arrays([pa.array(listed, pa.string()), pa.array([r for r, _ in top], pa.int32()), *sums], names=["word", "rank", "s", "q", "docs"])

    sums = _over_blocks(docs, "word string, rank int, s double, q double, docs long", fold).groupBy("word", "rank").agg(*[F.sum(c).alias(c) for c in ("s", "q", "docs")])
    mean = F.col("s") / F.col("docs")
    return sums.select("word", "rank", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("docs") - mean * mean)).alias("stdev"))


def _against(profile: DataFrame) -> tuple[list[str], np.ndarray, Callable[[np.ndarray], np.ndarray]]:
    """The profile's words and means (gathered: a bounded list, TOP_WORDS rows) and the z-scores of frequencies."""
    rows = profile.select("word", "mean", "stdev").collect()
    mean, stdev = (np.array([r[c] for r in rows], dtype=float) for c in ("mean", "stdev"))
    return [r["word"] for r in rows], mean, lambda f: np.divide(f - mean, stdev, out=np.zeros(f.shape), where=stdev > 0)


def _deviations(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """doc_id, words, word, f, mean, stdev for every document and profile word, absent words with f = 0.

    The profile is a bounded list (TOP_WORDS rows), so it rides along as one array.
    """
    listed = profile.agg(F.array_sort(F.collect_list(F.struct("rank", "word", "mean", "stdev"))).alias("p"))
    counts = word_counts(docs).join(profile.select("word"), "word").groupBy("doc_id", "words").agg(F.map_from_entries(F.collect_list(F.struct("word", "n"))).alias("m"))
    every = docs.where("text is not null").select("doc_id", F.size(T.tokens(F.col("text"))).alias("words")).where("words > 0")
    rows = every.join(counts, ["doc_id", "words"], "left").join(listed, F.lit(True)).select("doc_id", "words", F.coalesce("m", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))).alias("m"), F.explode("p").alias("p"))
    return rows.select("doc_id", "words", "p.word", (F.coalesce(F.try_element_at("m", F.col("p.word")), F.lit(0)) / F.col("words")).alias("f"), "p.mean", "p.stdev")


def _z() -> Column:
    return F.when(F.col("stdev") > 0, (F.col("f") - F.col("mean")) / F.col("stdev")).otherwise(0.0)


def burrows_delta(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """doc_id, words, delta (mean absolute z-score over the profile's words), l1 (mean absolute difference of frequencies).

    One row per document with words, none if the profile is empty.
    """
    listed, mean, scores = _against(profile)

    def fold(keys: pa.Array, words: pa.Array, total: np.ndarray) -> pa.RecordBatch:
        f = _frequencies(words, total, pa.array(listed, pa.large_string()))
        columns = [keys, pa.array(total, pa.int32()), pa.array(np.abs(scores(f)).mean(axis=1)), pa.array(np.abs(f - mean).mean(axis=1))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "words", "delta", "l1"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _over_blocks(docs if listed else docs.limit(0), f"doc_id {kind}, words int, delta double, l1 double", fold)


def cosine_delta(docs: DataFrame, profile: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, cosine_delta: one minus the cosine between the z-scores of each document and of the target (word, f)."""
    d = _deviations(docs, profile).withColumn("z", _z()).join(target.select("word", F.col("f").alias("tf")), "word", "left")
    t = F.when(F.col("stdev") > 0, (F.coalesce("tf", F.lit(0.0)) - F.col("mean")) / F.col("stdev")).otherwise(0.0)
    s = d.withColumn("t", t).groupBy("doc_id").agg(F.sum(F.col("z") * F.col("t")).alias("zt"), F.sum(F.col("z") * F.col("z")).alias("zz"), F.sum(F.col("t") * F.col("t")).alias("tt"))
    return s.select("doc_id", (1 - F.when((F.col("zz") > 0) & (F.col("tt") > 0), F.col("zt") / F.sqrt(F.col("zz") * F.col("tt"))).otherwise(0.0)).alias("cosine_delta"))


def delta_verdict(delta: Column, words: Column, p10: float, p90: float, least: int = LEAST_WORDS) -> Column:
    """in-band up to p90, near up to one band width more, else out; abstain below the least words."""
    return F.when(words < least, "abstain").when(delta <= p90, "in-band").when(delta <= p90 + (p90 - p10), "near").otherwise("out")


def contributions(docs: DataFrame, profile: DataFrame, k: int = 15) -> DataFrame:
    """doc_id, word, z, rank: the k words of each document that deviate most (to six decimals, ties in the order of the word).

    k bounds the rows, profile words the work. A document's nearest candidates leave its block with all that rounding may
    tie with them, and are ranked in their row.
    """
    listed, _, scores = _against(profile)

    def fold(keys: pa.Array, words: pa.Array, total: np.ndarray) -> pa.RecordBatch:
        z = scores(_frequencies(words, total, pa.array(listed, pa.large_string())))
        size, at = np.abs(z), min(max(len(listed) - k, 0), len(listed) - 1)
        near = size >= np.partition(size, at, axis=1)[:, at : at + 1] - 1e-5
        ends = np.concatenate([[0], np.cumsum(near.sum(axis=1))])
        rows = pa.StructArray.from_arrays([pa.array(listed, pa.string()).take(pa.array(np.nonzero(near)[1])), pa.array(z[near])], names=["word", "z"])
        return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)], names=["doc_id", "near"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = _over_blocks(docs if listed else docs.limit(0), f"doc_id {kind}, near array<struct<word: string, z: double>>", fold)
    order = F.sort_array(F.transform("near", lambda x: F.struct((-F.abs(F.round(x["z"], 6))).alias("size"), x["word"].alias("word"), x["z"].alias("z"))))
    return found.select("doc_id", F.posexplode(F.slice(order, 1, k)).alias("i", "x")).select("doc_id", "x.word", "x.z", (F.col("i") + 1).alias("rank"))


def percentile_band(df: DataFrame, column: str, by: list[str] = ()) -> DataFrame:
    """p10, p25, p50, p75, p90 (nearest rank), mean, cv of a column, per group.

    Values are ranked, not gathered: equal values are counted first, and a running count finds the
    value at each rank.
    """
    by = list(by) or [F.lit(0).alias("_g")]
    rows = df.where(F.col(column).isNotNull()).select(*by, F.col(column).cast("double").alias("v")).groupBy(*[c if isinstance(c, str) else "_g" for c in by], "v").agg(F.count(F.lit(1)).alias("n"))
    keys = [c if isinstance(c, str) else "_g" for c in by]
    up = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    all_ = rows.groupBy(*keys).agg(F.sum("n").alias("total"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), (F.sum(F.col("v") * F.col("v") * F.col("n")) / F.sum("n")).alias("sq"))
    ranked = rows.withColumn("upto", F.sum("n").over(up)).join(all_, keys)
    at = lambda p: F.min(F.when(F.col("upto") > F.bround(F.lit(p) * (F.col("total") - 1), 0), F.col("v"))).alias(f"p{int(p * 100)}")
    out = ranked.groupBy(*keys).agg(*[at(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9)], F.first("mean").alias("mean"), F.first("sq").alias("sq"))
    out = out.withColumn("cv", F.when(F.col("mean") != 0, F.sqrt(F.greatest(F.lit(0.0), F.col("sq") - F.col("mean") * F.col("mean"))) / F.col("mean"))).drop("sq")
    return out.drop("_g") if "_g" in keys else out


# liveliness signals, each between 0 and 1


STOP = "the a an and or but of to in on for with as at by from is are was were be been it this that these those not no what which who than then so if when".split()
SETUP = r"(?i)(\?$|\b(puzzle|strange|odd|curious|wonder|problem|question)\b)"
CASE = r"(?i)\b(for example|for instance|suppose|consider|imagine|take the case)\b"
ANALOGY = r"(?i)\b(like a|like an|as if|as though|resembles|is a kind of|analogy)\b"
WEAK_VERBS = r"(?i)^(is|are|was|were|be|been|being|has|have|had|do|does|did|seems|appears)$"


def content_words(s: Column) -> Column:
    return F.array_distinct(F.filter(T.tokens(s), lambda x: (F.length(x) > 2) & ~x.isin(STOP)))


def signals(docs: DataFrame, corpus_cv: float = 0.5) -> DataFrame:
    """doc_id and eight signals: cadence, novelty, curiosity, worked_case, and by approximation without a
    part-of-speech model concrete, analogy, sv_distance, verb_energy. Documents without sentences score 0.
    """
    d = docs.where("text is not null").select("doc_id", T.sentences(F.col("text")).alias("s")).select("doc_id", "s", F.transform("s", T.space_words).alias("n"), F.transform("s", content_words).alias("c"))
    n = F.size("s")
    cv = F.when(T.mean(F.col("n")) > 0, F.sqrt(T.variance(F.col("n"))) / T.mean(F.col("n"))).otherwise(0.0)
    cadence = F.when(n >= 3, F.greatest(F.lit(0.0), 1 - F.abs(1 - F.least(cv / corpus_cv, F.lit(2.0))))).otherwise(0.0)
    overlap = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), n)), lambda i: F.when(i <= n, T.jaccard(F.try_element_at("c", i), F.try_element_at("c", i - 1))))
    novelty = F.when(n > 1, F.size(F.filter(overlap, lambda x: (x > 0.05) & (x < 0.60))) / (n - 1)).otherwise(0.0)
    words = F.greatest(F.lit(1), T.total(F.col("n")))
    answered = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), n)), lambda i: F.coalesce(F.try_element_at("s", i).rlike(SETUP), F.lit(False)) & F.exists(
        F.sequence(i + 1, i + 2), lambda j: F.coalesce(~F.try_element_at("s", j).rlike(r"\?$") & (F.size(F.try_element_at("c", j)) >= 3), F.lit(False))))
    curiosity = F.least(F.lit(1.0), F.size(answered) / (words / 200))
    share = lambda p: F.when(n > 0, F.size(F.filter("s", lambda x: x.rlike(p))) / n).otherwise(0.0)
    verbs = F.flatten(F.transform("s", T.tokens))
    weak = F.when(F.size(verbs) > 0, F.size(F.filter(verbs, lambda x: x.rlike(WEAK_VERBS))) / F.size(verbs)).otherwise(0.0)
    first_verb = F.transform("s", lambda x: F.regexp_count(F.regexp_extract(x, r"(?i)^(.*?)\b(is|are|was|were|[a-z]+s|[a-z]+ed)\b", 1), F.lit(T.WORD)))
    r = lambda c, name: F.round(c, 6).alias(name)
    return d.select("doc_id", r(cadence, "cadence"), r(novelty, "novelty"), r(curiosity, "curiosity"), r(share(CASE), "worked_case"), r(share(r"\d|\"[^\"]+\"|[a-z,;] [A-Z][a-z]+"), "concrete"),
                    r(share(ANALOGY), "analogy"), r(F.greatest(F.lit(0.0), 1 - F.coalesce(T.mean(first_verb), F.lit(0.0)) / 10), "sv_distance"), r(F.greatest(F.lit(0.0), 1 - 5 * weak), "verb_energy"))


def adjacent_jaccard(docs: DataFrame) -> DataFrame:
    """doc_id, n_pairs, in_corridor: neighbouring sentences and those of them whose words overlap between .05 and .60."""
    d = docs.where("text is not null").select("doc_id", F.transform(T.sentences(F.col("text")), lambda s: F.array_distinct(T.tokens(s))).alias("c")).where(F.size("c") > 1)
    pairs = F.transform(F.sequence(F.lit(2), F.size("c")), lambda i: T.jaccard(F.element_at("c", i), F.element_at("c", i - 1)))
    return d.select("doc_id", F.size(pairs).alias("n_pairs"), F.size(F.filter(pairs, lambda x: (x > 0.05) & (x < 0.60))).alias("in_corridor"))


def concreteness(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """doc_id, rated, mean_rating: mean of the lexicon's ratings (word, rating) over a document's words."""
    return word_counts(docs).join(lexicon.select("word", "rating"), "word").groupBy("doc_id").agg(F.sum("n").alias("rated"), (F.sum(F.col("n") * F.col("rating")) / F.sum("n")).alias("mean_rating"))


def shared_ngrams(docs: DataFrame, corpus: DataFrame, n: int = 4) -> DataFrame:
    """doc_id, n_grams, n_shared: distinct n-word runs of each document, and those that the corpus holds too.

    Runs are compared by 64-bit hash: at 10^9 distinct runs the chance of any false match is a few percent.
    """
    def grams(df: DataFrame) -> DataFrame:
        w = df.where("text is not null").select("doc_id", T.tokens(F.col("text")).alias("w")).where(F.size("w") >= n)
        return w.select("doc_id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.array_join(F.slice("w", i, n), " "))))).alias("g"))

    there = grams(corpus).select("g").distinct().withColumn("hit", F.lit(1))
    return grams(docs).join(there, "g", "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_grams"), F.count("hit").alias("n_shared"))


def collapse_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept, text with each line that equals the one just before it left out."""
    rows = F.split(T.unix_lines(F.col("text")), "\n")
    kept = F.filter("rows", lambda x, i: (i == 0) | (x != F.try_element_at("rows", F.greatest(i, F.lit(1)))))
    return docs.where("text is not null").select("doc_id", rows.alias("rows")).select("doc_id", F.size("rows").alias("n_lines"), F.size(kept).alias("n_kept"), F.array_join(kept, "\n").alias("text"))


def seams(docs: DataFrame, by: str, order: str = "doc_id", width: int = 1_000_000) -> DataFrame:
    """by, doc_id, shared: content words that the first sentence of each document shares with the last of the one before.

    order is a number. Only the two sentences travel, not the texts, and a group's order is read in
    buckets of ``width``.
    """
    d = docs.where("text is not null").select(by, "doc_id", F.col(order).alias("_o"), T.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    d = d.withColumn("first", content_words(F.col("s")[0])).withColumn("last", content_words(F.element_at("s", -1))).drop("s")
    j = lag_in_buckets(d, by, "_o", ["last"], width)
    return j.where("before is not null").select(by, "doc_id", F.size(F.array_intersect("first", "before.last")).alias("shared"))


#: Words that open a turn of talk, words of address, marks of an example.
DISCOURSE = ["but", "so", "now", "then", "because", "however", "instead", "therefore", "and", "yet", "still", "here"]
ADDRESS = ["you", "your", "you're", "let's", "we", "our"]
EXAMPLES = ["for example", "for instance", "imagine", "picture", "think about", "consider", "watch", "say"]
_EXAMPLE = r"(?i)(?<![\p{L}\p{N}_])(" + "|".join(EXAMPLES) + r")(?![\p{L}\p{N}_])"


def diction(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, discourse_rate, address_rate, short_long_ratio, example_spacing, modifier_ratio, six decimals.

    Rates are shares of sentences that open with a discourse word, and that hold a word of address; short has six words at
    most and long twenty at least (without long ones the number of short ones); spacing is the mean distance between sentences with
    a mark of an example, 0 below two. modifier_ratio is the mean share of modifiers (approximate, by ending) over sentences of
    eight words or more. Documents without sentences give no row.
    """
    s = docs.where("text is not null").select("doc_id", T.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    one = F.transform("s", lambda x: F.struct(F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{N}_]+(?:'[\p{L}]+)?)"), 1).alias("w"), x.rlike(_EXAMPLE).alias("e")))
    p = s.select("doc_id", one.alias("s"), F.size("s").alias("n"))
    listed = lambda words: F.array(*[F.lit(w) for w in words])
    count = lambda f: F.size(F.filter("s", f))
    at = F.array_compact(F.transform("s", lambda x, i: F.when(x["e"], i)))
    long_ = count(lambda x: F.size(x["w"]) >= 20)
    short = count(lambda x: F.size(x["w"]).between(1, 6))
    eligible = F.filter("s", lambda x: F.size(x["w"]) >= 8)
    share = F.transform(eligible, lambda x: F.size(F.filter(x["w"], lambda w: w.rlike("(ly|ous|ful|ive|al|less|able)$"))) / F.size(x["w"]))
    spacing = F.when(F.size("at") > 1, (F.array_max("at") - F.array_min("at")) / (F.size("at") - 1)).otherwise(0.0)
    q = p.select("doc_id", F.col("n").alias("n_sentences"), count(lambda x: F.array_contains(listed(DISCOURSE), F.coalesce(F.try_element_at(x["w"], F.lit(1)), F.lit("")))).alias("d"),
                 count(lambda x: F.arrays_overlap(x["w"], listed(ADDRESS))).alias("a"), short.alias("short"), long_.alias("long"), at.alias("at"), F.coalesce(T.mean(share), F.lit(0.0)).alias("m"))
    r = lambda c, name: F.round(c, 6).alias(name)
    return q.select("doc_id", "n_sentences", r(F.col("d") / F.col("n_sentences"), "discourse_rate"), r(F.col("a") / F.col("n_sentences"), "address_rate"),
                    r(F.when(F.col("long") > 0, F.col("short") / F.col("long")).otherwise(F.col("short").cast("double")), "short_long_ratio"), r(spacing, "example_spacing"), r(F.col("m"), "modifier_ratio"))
