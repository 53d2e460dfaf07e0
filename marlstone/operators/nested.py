"""Deeply nested records to flat related tables by Dewey labels.

Every value of a record is a node with the ordinal path from the top (its Dewey label) and
the path of names (its schema path). The label of a node's parent is its own label without
the last ordinal, so parents, owners and the nearest value around a node are found by
truncation. A record's nodes never leave the task that parsed it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Label = tuple[int, ...]
Node = tuple[Label, str, str, object]  # label, schema path, kind, value


def decode(text: object) -> object | None:
    """The JSON value of a payload; None where it is null, empty or damaged."""
    if not isinstance(text, str):
        return None
    try:
        return json.loads(text.lstrip("\ufeff \t\r\n"))
    except (ValueError, RecursionError):
        return None


def dewey_nodes(value: object, embedded: tuple[str, ...] = ()) -> Iterator[Node]:
    """Nodes of a decoded value in written order.

    Schema paths read like ``$.a[].b``. Text under a name in ``embedded`` that is itself a JSON
    array or object is decoded in place. Works without recursion, so depth is not limited.
    """
    stack: list[tuple[Label, str, str, object]] = [((), "$", "", value)]
    while stack:
        label, path, name, x = stack.pop()
        if isinstance(x, str) and name in embedded and x.lstrip()[:1] in ("[", "{"):
            inner = decode(x)
            x = inner if isinstance(inner, (list, dict)) else x
        if isinstance(x, dict):
            yield label, path, "object", None
            parts = [((*label, i), f"{path}.{k}", str(k), v) for i, (k, v) in enumerate(x.items())]
        elif isinstance(x, list):
            yield label, path, "array", None
            parts = [((*label, i), f"{path}[]", name, v) for i, v in enumerate(x)]
        else:
            kind = "null" if x is None else "bool" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "text"
            yield label, path, kind, x
            continue
        stack.extend(reversed(parts))


def dewey_text(label: Label) -> str:
    """Label as text that sorts in written order, such as 0001.0000.0012."""
    return ".".join(f"{i:06d}" for i in label)


def shred(df: DataFrame, key: str, payload: str, embedded: tuple[str, ...] = ()) -> DataFrame:
    """All nodes of all readable payloads: key, dewey, parent_dewey, path, kind, value (as text).

    Payloads that are null, empty or damaged give no rows; a repeated row gives its nodes again.
    """
    field = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, text in zip(b["k"], b["p"], strict=True):
                value = decode(text)
                if value is None:
                    continue
                for label, path, kind, x in dewey_nodes(value, embedded):
                    shown = None if kind in ("object", "array", "null") else x if kind == "text" else json.dumps(x)
                    rows.append((k, dewey_text(label), dewey_text(label[:-1]) if label else None, path, kind, shown))
            yield pd.DataFrame(rows, columns=["k", "dewey", "parent_dewey", "path", "kind", "value"])

    out = df.select(F.col(key).alias("k"), F.col(payload).cast("string").alias("p")).mapInPandas(
        run, f"k {field}, dewey string, parent_dewey string, path string, kind string, value string")
    return out.withColumnRenamed("k", key)


#: Schema paths of objects, and names within one, that a set of tables may have.
MOST_TABLES = 2_000


def flat_tables(df: DataFrame, key: str, payload: str, embedded: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The nodes of all payloads grouped by schema path into tables that keep their parent-child links.

    One table per path of objects: key, dewey, owner_dewey (the label of the nearest object or array element around it, by
    truncation; null at the top) and a text column for each value that an object of the path holds. One per path of plain array
    elements: key, dewey, owner_dewey, value. The rows of a table join those of its owner's on (key, owner_dewey = dewey). Identical
    rows of df count once; damaged payloads give none. Payloads are parsed once and the nodes written; at most
    MOST_TABLES paths and names are gathered. Names are taken as they are written, so one with a dot or brackets makes paths of its own.
    """
    from marlstone.storage import Scratch

    nodes = Scratch(df.sparkSession, "shredded").keep(shred(df.select(key, payload).distinct(), key, payload, embedded))
    plain = F.col("kind").isin("text", "number", "bool", "null")
    found = nodes.where((F.col("kind") == "object") | (plain & F.col("path").endswith("[]"))).groupBy("path").agg(F.max((F.col("kind") == "object").cast("int")).alias("o"), F.max(plain.cast("int")).alias("v")).limit(MOST_TABLES + 1).collect()
    owner = F.regexp_extract("path", r"^(.*)\.[^.\[\]]+$", 1)
    named = nodes.where(plain & (owner != "")).select(owner.alias("owner"), F.regexp_extract("path", r"\.([^.\[\]]+)$", 1).alias("name")).distinct().limit(MOST_TABLES + 1).collect()
    if len(found) > MOST_TABLES or len(named) > MOST_TABLES:
        raise ValueError(f"more than {MOST_TABLES} paths or names")
    names: dict[str, list[str]] = {}
    for r in named:
        names.setdefault(r["owner"], []).append(r["name"])
    out: dict[str, DataFrame] = {}
    for r in sorted(found, key=lambda r: r["path"]):
        path = r["path"]
        # an element of an array stands one label below the array, and so on for arrays of arrays
        up = 1 + len(re.search(r"(?:\[\])*$", path)[0]) // 2
        label = F.split("dewey", r"\.")
        above = F.when(F.size(label) >= up, F.array_join(F.slice(label, 1, F.size(label) - up), ".")) if path != "$" else F.lit(None).cast("string")
        if r["o"]:
            cols = sorted(names.get(path, []))
            own = nodes.where((F.col("path") == path) & (F.col("kind") == "object")).select(key, "dewey", above.alias("owner_dewey"))
            if cols:
                held = nodes.where(F.col("path").isin([f"{path}.{c}" for c in cols]) & plain).groupBy(key, F.col("parent_dewey").alias("dewey")).agg(
                    *[F.max(F.when(F.col("path") == f"{path}.{c}", F.col("value"))).alias(c if c not in (key, "dewey", "owner_dewey") else f"{c}_") for c in cols])
                own = own.join(held, [key, "dewey"], "left")
            out[path] = own
        if r["v"] and path.endswith("[]"):
            out[path if not r["o"] else f"{path}#value"] = nodes.where((F.col("path") == path) & plain).select(key, "dewey", above.alias("owner_dewey"), "value")
    return out


def _nearest(label: Label, found: dict[Label, str]) -> str | None:
    for i in range(len(label), -1, -1):
        if label[:i] in found:
            return found[label[:i]]
    return None


_LIST = re.compile(r"[;,|\s]+")


def claim_children(value: object) -> Iterator[tuple[str | None, str, int, str]]:
    """(claim_id, child, pos, child_key) of every claim object of a decoded payload.

    A claim is an object with a text ``claim_id`` of its own. A span is an object with its own
    text ``locator_text`` below the claim's ``source_spans``; its doc_id is its own or that of the
    nearest object around it, up to the top of the payload, or empty. A chapter is each id in
    ``supports_chapters``: a text (a list in one text is split at commas, semicolons, bars and
    blanks) or the ``chapter_id`` of an object.
    """
    nodes = list(dewey_nodes(value, ("source_spans", "supports_chapters")))
    claims: dict[Label, str] = {}
    docs: dict[Label, str] = {}
    for label, path, kind, x in nodes:  # group by schema path, parent by truncation
        if kind == "text" and path.endswith(".claim_id"):
            claims[label[:-1]] = x
        elif kind == "text" and path.endswith(".doc_id"):
            docs[label[:-1]] = x
    owner_at: dict[Label, str] = {}  # label of each claim's source_spans and supports_chapters
    for label, path, _, _ in nodes:
        if label[:-1] in claims and label:
            if path.endswith(".source_spans"):
                owner_at[label] = "source_spans"
            elif path.endswith(".supports_chapters"):
                owner_at[label] = "supports_chapters"
    seen: dict[tuple[Label, str], int] = {}
    for label, path, kind, x in nodes:
        if kind != "text":
            continue
        at = next((label[:i] for i in range(len(label), 0, -1) if label[:i] in owner_at), None)
        if at is None:
            continue
        child, claim = owner_at[at], at[:-1]
        if child == "source_spans":
            if not path.endswith(".locator_text"):
                continue
            keys = [f"{_nearest(label[:-1], docs) or ''}|{x}"]
        elif path.endswith(".chapter_id") and label != at:
            keys = [x]
        elif label == at:
            keys = [p for p in _LIST.split(x) if p]
        elif path.endswith("supports_chapters[]"):
            keys = [x]
        else:
            continue
        for key in keys:
            pos = seen.get((claim, child), 0)
            seen[(claim, child)] = pos + 1
            yield claims[claim], child, pos, key


def claim_child_rows(df: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """record key, claim_id, child, pos, child_key of every readable payload.

    Null, empty and damaged payloads give no rows; repeated deliveries count once.
    """
    field = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, text in zip(b["k"], b["p"], strict=True):
                value = decode(text)
                if value is not None:
                    rows += [(k, *child) for child in claim_children(value)]
            yield pd.DataFrame(rows, columns=["k", "claim_id", "child", "pos", "child_key"])

    out = df.select(F.col(key).alias("k"), F.col(payload).cast("string").alias("p")).mapInPandas(
        run, f"k {field}, claim_id string, child string, pos int, child_key string")
    return out.distinct().withColumnRenamed("k", key)


def claim_rows(df: DataFrame, key: str = "record_id", payload: str = "payload") -> DataFrame:
    """record key, dewey, claim_id, canonical_text, status of every claim object."""
    field = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, text in zip(b["k"], b["p"], strict=True):
                value = decode(text)
                if value is None:
                    continue
                claims: dict[Label, dict[str, str]] = {}
                for label, path, kind, x in dewey_nodes(value):
                    name = path.rpartition(".")[2]
                    if kind == "text" and name in ("claim_id", "canonical_text", "status"):
                        claims.setdefault(label[:-1], {})[name] = x
                rows += [(k, dewey_text(at), c["claim_id"], c.get("canonical_text"), c.get("status")) for at, c in claims.items() if "claim_id" in c]
            yield pd.DataFrame(rows, columns=["k", "dewey", "claim_id", "canonical_text", "status"])

    out = df.select(F.col(key).alias("k"), F.col(payload).cast("string").alias("p")).mapInPandas(
        run, f"k {field}, dewey string, claim_id string, canonical_text string, status string")
    return out.distinct().withColumnRenamed("k", key)
