"""Encoding of texts with a public byte-level tokenizer, offsets and decoding.

Ids come from the tokenizers library, over Arrow batches. A byte-level vocabulary spells
every byte as a character of its own alphabet; the inverse of that table gives the bytes of
each id, from which byte and character offsets and the decoded text follow exactly, also
where a character is split over several tokens.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the public tokenizer files, the same path on every executor.
FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Characters that are encoded at a time; bounds the memory of a task.
CHARS_PER_CALL = 2_000_000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer in a file; strings of special tokens in a text are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def tokenizer_file(name: str = NAME, folder: str | None = None) -> str:
    return f"{folder or os.environ.get('MARLSTONE_TOKENIZERS', FOLDER)}/{name}.json"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of the byte-level alphabet stands for.

    Printable Latin-1 characters stand for themselves; the other bytes take the characters
    from U+0100 on in order.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def id_bytes(path: str) -> tuple[bytes, ...]:
    """The bytes of each id; special tokens stand for their own name."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    alphabet = byte_alphabet()
    special = {t["id"]: t["content"] for t in model.get("added_tokens", [])}
    vocab = model["model"]["vocab"]
    out = [b""] * (max([*vocab.values(), *special]) + 1)
    for token, i in vocab.items():
        out[i] = token.encode() if i in special else bytes(alphabet[c] for c in token)
    for i, token in special.items():
        out[i] = token.encode()
    return tuple(out)


@lru_cache(maxsize=4)
def id_lengths(path: str) -> np.ndarray:
    return np.array([len(b) for b in id_bytes(path)], dtype=np.int64)


def encode_texts(texts: list[str | None], path: str) -> Iterator[list[int]]:
    """Ids of each text in order; an empty list for null and empty texts."""
    t = tokenizer(path)
    at = 0
    while at < len(texts):
        end, chars = at, 0
        while end < len(texts) and (end == at or chars + len(texts[end] or "") <= CHARS_PER_CALL):
            chars += len(texts[end] or "")
            end += 1
        for e in t.encode_batch_fast([x or "" for x in texts[at:end]], add_special_tokens=False):
            yield e.ids
        at = end


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key and ids of every row; rows with null and empty texts have an empty list."""
    path = path or tokenizer_file()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            flat, ends = [], [0]
            for ids in encode_texts(texts, path):
                flat.append(np.array(ids, dtype=np.int32))
                ends.append(ends[-1] + len(ids))
            values = np.concatenate(flat) if flat else np.array([], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[key, "ids"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


#: Fixed value: the pattern by which the byte-level tokenizers cut texts before they merge.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


@lru_cache(maxsize=4)
def counter(path: str):
    """A faster reader of the same vocabulary, from the file of its merge ranks."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key and n_tokens of each row, 0 for null and empty texts; only the counts leave Python.

    path: a file of merge ranks (by default that of byte_bpe_50k, whose counts equal those of encode), read by tiktoken.
    """
    path = path or tokenizer_file()[: -len("json")] + "tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            n = [len(c.encode_ordinary(x)) if x else 0 for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, n_tokens long")


def offsets(text: str, ids: list[int], path: str) -> dict[str, np.ndarray]:
    """Byte and character ranges of each token, and whether it starts inside a character.

    A token's characters are those that any of its bytes belongs to, so the pieces of a split
    character share it.
    """
    raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
    lengths = id_lengths(path)[np.array(ids, dtype=np.int64)] if ids else np.array([], dtype=np.int64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    opens = (raw & 0xC0) != 0x80
    char_of = np.cumsum(opens) - 1
    first = char_of[starts] if len(starts) else starts
    last = char_of[ends - 1] + 1 if len(ends) else ends
    split = ~opens[starts] if len(starts) else np.array([], dtype=bool)
    return {"byte_start": starts, "byte_end": ends, "char_start": first, "char_end": last, "splits": split}


def encode_with_offsets(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, ids, byte_start, byte_end, char_start, char_end (arrays) and n_split of every row."""
    path = path or tokenizer_file()
    kind = df.schema[key].dataType.simpleString()
    names = ["byte_start", "byte_end", "char_start", "char_end"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [x if isinstance(x, str) else "" for x in b["t"]]
            rows = []
            for k, x, ids in zip(b["k"], texts, encode_texts(texts, path), strict=True):
                o = offsets(x, ids, path)
                rows.append((k, ids, *[o[n].astype(np.int32) for n in names], int(o["splits"].sum())))
            yield pd.DataFrame(rows, columns=["k", "ids", *names, "n_split"])

    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(
        run, f"k {kind}, ids array<int>, {', '.join(n + ' array<int>' for n in names)}, n_split int")
    return out.withColumnRenamed("k", key)


def roundtrip(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """key, the columns to keep, n (tokens), n_split (tokens that start inside a character) and same (the ids decode to the text), in one pass."""
    path = path or tokenizer_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            n, split, same = [], [], []
            for x, ids in zip(texts, encode_texts(texts, path), strict=True):
                n.append(len(ids))
                split.append(int(offsets(x, ids, path)["splits"].sum()))
                same.append(decode_ids(ids, path) == x)
            made = [pa.array(n, pa.int64()), pa.array(split, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), *[b.column(i + 2) for i in range(len(keep))], *made], names=[key, *keep, "n", "n_split", "same"])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (key, *keep))
    return df.select(key, text, *keep).mapInArrow(run, f"{kinds}, n long, n_split long, same boolean")


def decode_ids(ids: list[int], path: str, edges: str = "replace") -> str:
    """The text of ids by the reversed byte table.

    A character whose bytes are not all there becomes U+FFFD; with ``edges="drop"`` the pieces of
    characters cut at either end of the ids are left out instead.
    """
    table = id_bytes(path)
    raw = b"".join(table[i] for i in ids)
    if edges == "drop":
        a, b = 0, len(raw)
        while a < b and a < 3 and raw[a] & 0xC0 == 0x80:
            a += 1
        for back in range(1, min(4, b - a) + 1):
            lead = raw[b - back]
            if lead & 0xC0 != 0x80:
                need = 4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2 if lead >= 0xC0 else 1
                if need > back:
                    b -= back
                break
        raw = raw[a:b]
    return raw.decode("utf-8", errors="replace")


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None, edges: str = "replace") -> DataFrame:
    """key and text of every row of ids; null ids give null."""
    path = path or tokenizer_file()
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"k": b["k"], "text": [None if x is None else decode_ids([int(i) for i in x], path, edges) for x in b["i"]]})

    return df.select(F.col(key).alias("k"), F.col(ids).alias("i")).mapInPandas(run, f"k {kind}, text string").withColumnRenamed("k", key)
