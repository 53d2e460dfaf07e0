"""Ids against another library with the same vocabulary, exact round trips, offsets."""

import base64

import pytest

from marlstone.llm import tokens

pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

TEXTS = ["", None, "Hello world", "naïve 😀 a", "<|endoftext|> is text", "a" * 30_000, "\r\n \t x", "该论点尚未证实。", "٣ ½ ﬁnal \x00", "Hello world"]


@pytest.fixture(scope="module")
def path():
    return tokens.tokenizer_file()


@pytest.fixture(scope="module")
def other():
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_ids_match_the_other_library(spark, other, path):
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(frame(spark, TEXTS)).collect()}
    assert got == {i: other.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}


def test_ids_of_the_documents(spark, data, other):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(docs).collect()}
    assert got == {r["doc_id"]: other.encode_ordinary(r["text"] or "") for r in docs.select("doc_id", "text").collect()}


def test_round_trip_and_offsets(spark, path):
    coded = tokens.encode_with_offsets(frame(spark, TEXTS))
    back = {r["doc_id"]: r["text"] for r in tokens.decode(coded).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    for r in coded.collect():
        text = TEXTS[r["doc_id"]] or ""
        raw = text.encode()
        assert len(r["byte_start"]) == len(r["ids"]) == len(r["char_end"])
        for i, token in enumerate(r["ids"]):
            assert raw[r["byte_start"][i]: r["byte_end"][i]] == tokens.id_bytes(path)[token]
            chars = text[r["char_start"][i]: r["char_end"][i]].encode()
            assert tokens.id_bytes(path)[token] in chars
    assert next(r["n_split"] for r in coded.collect() if r["doc_id"] == 3) == 1


def test_split_characters_at_the_edges(path):
    ids = tokens.tokenizer(path).encode("a 😀 b", add_special_tokens=False).ids
    cut = next(i for i in range(1, len(ids)) if "�" in tokens.decode_ids(ids[:i], path))
    assert tokens.decode_ids(ids[:cut], path, edges="drop") == "a "
    assert "�" in tokens.decode_ids(ids[cut:], path)
    assert tokens.decode_ids(ids[cut:], path, edges="drop") == " b"


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.encode(empty).collect() == []
    clash = spark.createDataFrame([(1, "a b", [9], "x")], "doc_id long, text string, ids array<int>, k string")
    assert tokens.encode(clash).collect()[0]["ids"] == [64, 275]
    assert tokens.token_counts(clash).collect()[0]["n_tokens"] == 2


def test_counts_equal_the_ids():
    path = tokens.tokenizer_file()
    c = tokens.counter(path[: -len("json")] + "tiktoken")
    texts = ["", "plain text's 12 words  \n\n", "a" * 20_000, "héllo 世界 🙂🙂", "<|endoftext|> is text", "   x", "\r\n\t", "ABC123abc", "é"]
    assert [len(c.encode_ordinary(x)) for x in texts] == [len(i) for i in tokens.encode_texts(texts, path)]


def test_roundtrip_in_one_pass(spark):
    df = spark.createDataFrame([(1, "naïve 🙂", "a"), (2, None, "b"), (3, "", None)], "doc_id long, text string, source string")
    out = {r["doc_id"]: (r["source"], r["n"] > 0, r["same"]) for r in tokens.roundtrip(df, keep=("source",)).collect()}
    assert out == {1: ("a", True, True), 2: ("b", False, True), 3: (None, False, True)}
