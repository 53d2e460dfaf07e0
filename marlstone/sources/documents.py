"""Documents as files: Markdown, captions, HTML, triples, code graphs, theses, design notes."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import normal_path, slug, unix_lines


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.md") -> DataFrame:
    """path, text, sha256, bytes of every file of a folder tree; texts are read as UTF-8."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return raw.select("path", F.decode("content", "UTF-8").alias("text"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def lines_of(docs: DataFrame, key: str = "path") -> DataFrame:
    """key, line (from 1), value of every line."""
    return docs.where("text is not null").select(key, F.posexplode(F.split(unix_lines(F.col("text")), "\n")).alias("p", "value")).select(key, (F.col("p") + 1).alias("line"), "value")


def _folded(docs: DataFrame, key: str, state: str, start, step) -> DataFrame:
    """key and the rows that folding a document's lines gives: step(acc, line struct) with acc.out."""
    rows = F.transform(F.split(unix_lines(F.col("text")), "\n"), lambda x, i: F.struct(x.alias("v"), (i + 1).alias("n")))
    return docs.where("text is not null").select(key, F.explode(F.aggregate(rows, start, step, lambda a: a["out"])).alias("r")).select(key, "r.*")


def heading_tree(docs: DataFrame, key: str = "path") -> DataFrame:
    """key, line, level, title, parent_line of every heading; the parent is the nearest heading above of a lower level."""
    none = F.array().cast("array<struct<line:int,level:int,title:string,parent_line:int>>")
    start = F.struct(none.alias("out"))

    def step(acc, x):
        level = F.length(F.regexp_extract(x["v"], r"^(#{1,6})\s+\S", 1))
        above = F.filter(acc["out"], lambda h: h["level"] < level)
        row = F.struct(x["n"].alias("line"), level.alias("level"), F.trim(F.regexp_extract(x["v"], r"^#{1,6}\s+(.*)$", 1)).alias("title"), F.try_element_at(above, F.lit(-1))["line"].alias("parent_line"))
        return F.struct(F.when(level > 0, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

    return _folded(docs, key, "", start, step)


def wiki_pages(docs: DataFrame) -> DataFrame:
    """id, path, title of wiki files: the title is the front matter's, else the first heading, else the name."""
    name = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    front = F.regexp_extract("text", r"(?s)\A---\n.*?^?title:\s*\"?([^\"\n]+)\"?.*?\n---", 1)
    head = F.regexp_extract(unix_lines(F.col("text")), r"(?m)^#\s+(.+)$", 1)
    title = F.when(front != "", front).when(head != "", head).otherwise(name)
    return docs.select(slug(name).alias("id"), "path", F.trim(title).alias("title"))


def captions(docs: DataFrame, key: str = "path") -> DataFrame:
    """key, start (seconds), text of the cues of WebVTT files, tags taken out, a line equal to the one before left out."""
    blocks = F.filter(F.split(unix_lines(F.col("text")), r"\n[ \t]*\n"), lambda b: b.contains("-->"))
    cue = F.transform(blocks, lambda b: F.struct(
        F.regexp_extract(b, r"((?:\d+:)?\d{2}:\d{2}[.,]\d{3})\s*-->", 1).alias("t"), F.trim(F.regexp_replace(F.regexp_replace(b, r"(?s)^.*?-->[^\n]*\n?", ""), r"<[^>]+>", "")).alias("x")))
    rows = docs.where("text is not null").select(key, F.posexplode(F.filter(cue, lambda c: c["x"] != "")).alias("i", "c"), F.filter(cue, lambda c: c["x"] != "").alias("all"))
    p = F.split(F.regexp_replace("c.t", ",", "."), ":")
    at = F.aggregate(p, F.lit(0.0), lambda a, v: a * 60 + v.cast("double"))
    return rows.where((F.col("i") == 0) | (F.col("c.x") != F.try_element_at("all", F.greatest(F.col("i"), F.lit(1)))["x"])).select(key, F.round(at, 3).alias("start"), F.col("c.x").alias("text"))


class _Main(HTMLParser):
    """Text of the main content: blocks as lines, headings as Markdown, navigation and scripts left out."""

    SKIP = {"script", "style", "nav", "header", "footer", "aside", "noscript", "template", "form"}
    BLOCK = {"p", "div", "section", "article", "main", "li", "tr", "table", "ul", "ol", "blockquote", "pre", "br", "h1", "h2", "h3", "h4", "h5", "h6", "figure"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.depth = 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in self.SKIP:
            self.depth += 1
        elif tag in self.BLOCK:
            self.out.append("\n\n" + ("#" * int(tag[1]) + " " if tag[0] == "h" and tag[1:].isdigit() else "- " if tag == "li" else ""))

    def handle_endtag(self, tag: str) -> None:
        if tag in self.SKIP:
            self.depth = max(0, self.depth - 1)
        elif tag in self.BLOCK:
            self.out.append("\n\n")

    def handle_data(self, data: str) -> None:
        if not self.depth:
            self.out.append(" ".join(data.split()) + (" " if data[-1:].isspace() else "") if data.strip() else " ")


def html_text(html: str | None) -> str | None:
    """Main content of a page as Markdown-like text."""
    if html is None:
        return None
    p = _Main()
    p.feed(html)
    p.close()
    blocks = [" ".join(b.split()) for b in "".join(p.out).split("\n\n")]
    return "\n\n".join(b for b in blocks if b.strip("#- "))


def html_to_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with text, the main content of the HTML column; damaged markup is read as far as it goes."""
    @F.pandas_udf("string")
    def convert(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(html_text)

    return pages.withColumn("text", convert(column))


def turtle_triples(docs: DataFrame, key: str = "path") -> DataFrame:
    """key, s, p, o of simple Turtle: one subject per statement, predicates after semicolons, objects after commas; ``a`` is rdf:type.

    Prefixes are kept as written. Blank node lists and multi-line literals are not read.
    """
    bare = F.regexp_replace(F.regexp_replace(unix_lines(F.col("text")), r"(?m)^\s*(@prefix|@base|PREFIX|BASE)[^\n]*$", ""), r"(?m)(^|\s)#[^\n]*$", "$1")
    statements = F.filter(F.transform(F.split(bare, r"\s\.\s*(?:\n|$)|\.\s*\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    s = docs.where("text is not null").select(key, F.explode(statements).alias("x")).select(key, F.regexp_extract("x", r"^(\S+)", 1).alias("s"), F.regexp_replace("x", r"^\S+\s*", "").alias("rest"))
    po = s.select(key, "s", F.explode(F.split("rest", r"\s*;\s*(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)")).alias("y")).select(key, "s", F.regexp_extract("y", r"^(\S+)", 1).alias("p"), F.regexp_replace("y", r"^\S+\s*", "").alias("objs")).where("p <> ''")
    o = po.select(key, "s", "p", F.explode(F.split("objs", r"\s*,\s*(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)")).alias("o"))
    return o.select(key, "s", F.when(F.col("p") == "a", "rdf:type").otherwise(F.col("p")).alias("p"), F.regexp_replace(F.regexp_replace(F.trim("o"), r"\s*\.$", ""), r'^"(.*)"(?:@\w+|\^\^\S+)?$', "$1").alias("o"))


def taxonomy_audit(triples: DataFrame, identity: list[str], suffixes: list[str]) -> DataFrame:
    """child, parent: classes named by a role (a suffix) that are subclasses of an identity class."""
    t = triples.where("p = 'rdfs:subClassOf'").select(F.col("s").alias("child"), F.col("o").alias("parent")).distinct()
    return t.where(F.col("parent").isin(identity) & F.lower("child").rlike("(" + "|".join(s.lower() for s in suffixes) + ")$"))


GRAPH = """nodes array<struct<id: string, label: string, file_type: string, source_file: string, source_location: string, rank: double, community: string>>,
links array<struct<source: string, target: string, relation: string, weight: double>>"""


def code_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, source_file, rank, community) and edges (id, source_id, target_id, relationship, weight) of a code graph file.

    Edges whose ends are not among the nodes are left out.
    """
    raw = spark.read.schema(GRAPH).option("multiLine", True).json(path)
    n = raw.select(F.explode("nodes").alias("n")).select("n.id", "n.label", normal_path(F.col("n.source_file")).alias("source_file"), "n.rank", "n.community").where("id is not null").distinct()
    e = raw.select(F.explode("links").alias("e")).select("e.source", "e.target", "e.relation", F.coalesce("e.weight", F.lit(1.0)).alias("weight"))
    e = e.join(n.select(F.col("id").alias("source")), "source", "left_semi").join(n.select(F.col("id").alias("target")), "target", "left_semi")
    return n, e.select(F.concat_ws("\u001f", "source", "relation", "target").alias("id"), F.col("source").alias("source_id"), F.col("target").alias("target_id"), F.col("relation").alias("relationship"), "weight").distinct()


def read_thesis(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """Relations thesis-node, sub-argument, sub-arg-chapter, sub-arg-evidence and invariant of a thesis file (YAML or JSON), read on the driver."""
    try:
        import yaml

        data = yaml.safe_load(text)
    except ImportError:
        data = json.loads(text)
    book = data.get("book_id") or "thesis"
    th, subs = data.get("thesis") or {}, data.get("sub_arguments") or []
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "thesis-node": make([(book, th.get("statement"), th.get("polarity"), th.get("scope"))], "id string, statement string, polarity string, scope string"),
        "sub-argument": make([(s["id"], s.get("statement"), s.get("polarity"), s.get("parent") or book) for s in subs], "id string, statement string, polarity string, parent string"),
        "sub-arg-chapter": make([(f"{s['id']}\u001f{c}", s["id"], c) for s in subs for c in s.get("advanced_by_chapters") or []], "id string, sub_arg_id string, chapter string"),
        "sub-arg-evidence": make([(f"{s['id']}\u001f{e}", s["id"], e) for s in subs for e in s.get("required_evidence") or []], "id string, sub_arg_id string, evidence string"),
        "invariant": make([(i["id"], i.get("rule"), i.get("formal"), i.get("subject"), i.get("pinned_value"), i.get("forbidden_value")) for i in data.get("invariants") or []],
                          "id string, rule string, formal string, subject string, pinned_value string, forbidden_value string"),
    }


# design notes


def _carried(docs: DataFrame, heading: str, key: str = "path") -> DataFrame:
    """key, line, value and head (the last line before or at it that fits ``heading``, group 1)."""
    none = F.array().cast("array<struct<line:int,value:string,head:string>>")
    start = F.struct(F.lit(None).cast("string").alias("head"), none.alias("out"))

    def step(acc, x):
        found = F.regexp_extract(x["v"], heading, 1)
        head = F.when(found != "", found).otherwise(acc["head"])
        return F.struct(head.alias("head"), F.concat(acc["out"], F.array(F.struct(x["n"].alias("line"), x["v"].alias("value"), head.alias("head")))).alias("out"))

    return _folded(docs, key, "", start, step)


def requirements(docs: DataFrame, key: str = "path") -> DataFrame:
    """id, requirement_id, capability, status, text, source_path, source_line of ``### Requirement: REQ-..`` headings.

    The text is the lines up to the next heading. The capability is the folder of the file; files under
    ``changes`` are proposed, others current.
    """
    pattern = r"^#{2,4}\s+Requirement:\s*(\S[^\n]*)$"
    body = F.regexp_extract_all(unix_lines(F.col("text")), F.lit(r"(?m)^#{2,4}\s+Requirement:[^\n]*\n((?:(?!#)[^\n]*\n?)*)"), 1)
    heads = F.filter(F.transform(F.split(unix_lines(F.col("text")), "\n"), lambda x, i: F.struct(F.regexp_extract(x, pattern, 1).alias("id"), (i + 1).alias("line"))), lambda h: h["id"] != "")
    rows = docs.where("text is not null").select(key, F.posexplode(F.arrays_zip(heads.alias("h"), body.alias("b"))).alias("i", "z"))
    cap = F.element_at(F.split(key, "/"), -2)
    rid = F.trim(F.col("z.h.id"))
    return rows.select(F.concat_ws(":", F.lit("requirement"), cap, rid).alias("id"), rid.alias("requirement_id"), cap.alias("capability"), F.when(F.col(key).contains("/changes/"), "proposed").otherwise("current").alias("status"),
                       F.trim(F.regexp_replace(F.coalesce("z.b", F.lit("")), r"\s+", " ")).alias("text"), F.col(key).alias("source_path"), F.col("z.h.line").alias("source_line"))


def scenarios(docs: DataFrame, key: str = "path") -> DataFrame:
    """id, requirement_id, capability, text, source_path, source_line of ``#### Scenario:`` headings, under the requirement before them."""
    rows = _carried(docs, r"^#{2,4}\s+Requirement:\s*(\S[^\n]*)$", key)
    title = F.trim(F.regexp_extract("value", r"^#{3,5}\s+Scenario:\s*(.+)$", 1))
    cap = F.element_at(F.split(key, "/"), -2)
    return rows.where((title != "") & F.col("head").isNotNull()).select(
        F.concat_ws(":", F.lit("scenario"), cap, F.trim("head"), F.col("line").cast("string"), slug(title)).alias("id"), F.trim("head").alias("requirement_id"), cap.alias("capability"), title.alias("text"), F.col(key).alias("source_path"), F.col("line").alias("source_line"))


def decisions(docs: DataFrame, key: str = "path") -> DataFrame:
    """id, kind, status, text, rationale, source_path, source_line of ``## Decision: title`` headings (also Alternative, Risk, Constraint)."""
    pattern = r"(?i)^#{2,4}\s+(?:decision|alternative|risk|constraint)[ \d]*:\s*(.+)$"
    rows = lines_of(docs, key).where(F.col("value").rlike(pattern))
    kind, title = F.lower(F.regexp_extract("value", r"(?i)^#{2,4}\s+(decision|alternative|risk|constraint)", 1)), F.trim(F.regexp_extract("value", pattern, 1))
    return rows.select(F.concat_ws(":", F.lit("design"), key, F.col("line").cast("string"), kind, slug(title)).alias("id"), kind.alias("kind"), F.lit("documented").alias("status"), title.alias("text"), F.lit("").alias("rationale"), F.col(key).alias("source_path"), F.col("line").alias("source_line"))


def commands(docs: DataFrame, key: str = "path") -> DataFrame:
    """id, command, shell, purpose, source_path, source_line of the lines in fenced shell blocks; the purpose is the heading above."""
    none = F.array().cast("array<struct<line:int,command:string,shell:string,purpose:string>>")
    start = F.struct(F.lit("").alias("purpose"), F.lit(None).cast("string").alias("fence"), none.alias("out"))

    def step(a, x):
        v = F.trim(x["v"])
        head, fence = F.regexp_extract(x["v"], r"^#{1,6}\s+(.+)$", 1), F.regexp_extract(v, r"^```(\w+)", 1)
        inside = a["fence"].isNotNull()
        closing = inside & (v == "```")
        opened = ~inside & v.startswith("```")
        row = F.struct(x["n"].alias("line"), v.alias("command"), a["fence"].alias("shell"), a["purpose"].alias("purpose"))
        take = inside & ~closing & (a["fence"] != "") & (v != "") & ~v.startswith("#")
        shell = F.when(fence.isin("bash", "sh", "shell", "zsh", "console"), "sh").when(fence.isin("powershell", "ps1", "pwsh"), "powershell").otherwise("")
        return F.struct(F.when(~inside & (head != ""), F.trim(head)).otherwise(a["purpose"]).alias("purpose"),
                        F.when(closing, F.lit(None).cast("string")).when(opened, shell).otherwise(a["fence"]).alias("fence"), F.when(take, F.concat(a["out"], F.array(row))).otherwise(a["out"]).alias("out"))

    rows = _folded(docs, key, "", start, step)
    return rows.select(F.concat_ws(":", F.lit("command"), key, F.col("line").cast("string")).alias("id"), "command", "shell", "purpose", F.col(key).alias("source_path"), F.col("line").alias("source_line"))


def tests(docs: DataFrame, key: str = "path") -> DataFrame:
    """id, name, framework, target, source_path, source_line of test functions in Python, Rust and Clojure files."""
    rows = lines_of(docs, key)
    py, rs, cl = F.regexp_extract("value", r"^\s*(?:async )?def (test_\w+)", 1), F.regexp_extract("value", r"^\s*fn (\w+)\s*\(\)", 1), F.regexp_extract("value", r"^\s*\(deftest\s+([^\s)]+)", 1)
    name = F.when(F.col(key).endswith(".py"), py).when(F.col(key).endswith(".rs"), rs).otherwise(cl)
    frame = F.when(F.col(key).endswith(".py"), "pytest").when(F.col(key).endswith(".rs"), "cargo").otherwise("cljs")
    target = F.regexp_replace(F.regexp_extract(key, r"([^/]+)\.\w+$", 1), r"(^test_|_test$)", "")
    return rows.withColumn("n", name).where("n <> ''").select(F.concat_ws("::", key, "n").alias("id"), F.col("n").alias("name"), frame.alias("framework"), target.alias("target"), F.col(key).alias("source_path"), F.col("line").alias("source_line"))


def workflows(docs: DataFrame, key: str = "path") -> DataFrame:
    """id, name, trigger, source_path, source_line of CI workflow files."""
    t = unix_lines(F.col("text"))
    name = F.regexp_extract(t, r"(?m)^name:\s*[\"']?([^\"'\n]+)", 1)
    return docs.where("text is not null").select(F.concat_ws(":", F.lit("workflow"), key).alias("id"), F.trim(F.when(name != "", name).otherwise(F.regexp_extract(key, r"([^/]+)\.ya?ml$", 1))).alias("name"),
                                                 F.array_join(F.regexp_extract_all(F.regexp_extract(t, r"(?ms)^on:(.*?)^\w", 1), F.lit(r"(?m)(?:^\s{2}|[\[,]\s*|^\s*)(\w[\w-]*)(?=[:,\]\s])"), 1), ",").alias("trigger"), F.col(key).alias("source_path"), F.lit(1).alias("source_line"))


def jobs(docs: DataFrame, key: str = "path") -> DataFrame:
    """id, workflow_id, name, command, source_path, source_line of the jobs of CI workflow files: keys two blanks in under ``jobs:``."""
    none = F.array().cast("array<struct<line:int,name:string,command:string>>")
    start = F.struct(F.lit(False).alias("inside"), none.alias("out"))

    def step(a, x):
        top = F.regexp_extract(x["v"], r"^(\w[\w-]*):", 1)
        inside = F.when(top != "", top == "jobs").otherwise(a["inside"])
        job, run = F.regexp_extract(x["v"], r"^  (\w[\w-]*):\s*$", 1), F.trim(F.regexp_extract(x["v"], r"^\s+-?\s*run:\s*(.+)$", 1))
        last = F.try_element_at(a["out"], F.lit(-1))
        grown = F.struct(last["line"].alias("line"), last["name"].alias("name"), F.concat_ws(" && ", F.when(last["command"] != "", last["command"]), run).alias("command"))
        out = F.when(inside & (job != ""), F.concat(a["out"], F.array(F.struct(x["n"].alias("line"), job.alias("name"), F.lit("").alias("command"))))).when(
            inside & (run != "") & (F.size(a["out"]) > 0), F.concat(F.slice(a["out"], 1, F.greatest(F.lit(0), F.size(a["out"]) - 1)), F.array(grown))).otherwise(a["out"])
        return F.struct(inside.alias("inside"), out.alias("out"))

    rows = _folded(docs, key, "", start, step)
    return rows.select(F.concat_ws(":", F.lit("job"), key, "name").alias("id"), F.concat_ws(":", F.lit("workflow"), key).alias("workflow_id"), "name", "command", F.col(key).alias("source_path"), F.col("line").alias("source_line"))
