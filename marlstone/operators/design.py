"""The design graph: links from claims and requirements to code, tests and gates, and questions about them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import normal_path, symbol_mentions
from marlstone.operators.graphs import shortest_trails
from marlstone.plans.catalog import GraphCatalog

SEP = "\u001f"


def code_claim_links(claims: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Promoted links (code_id, claim_id, kind) and all evidence (with score, witness, promoted).

    claims: claim_id, text, source_files (array). nodes: id, label, source_file. edges: source_id, target_id,
    relationship. A named file that one module node has scores 1.0, else 0.75. A named symbol scores 1.0 if one
    node has it and a trail of contains or uses edges leads up from it, 0.75 with a trail only, else 0.5.
    """
    module = nodes.where(F.col("label") == F.regexp_extract("source_file", r"([^/]+)$", 1)).select(F.col("id").alias("code_id"), normal_path(F.col("source_file")).alias("file"))
    named = claims.select("claim_id", F.explode(F.array_distinct(F.transform("source_files", normal_path))).alias("file"))
    files = named.join(module, "file").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("claim_id", "file")))
    by_file = files.select("code_id", "claim_id", F.lit("file-path").alias("kind"), F.when(F.col("n") == 1, 1.0).otherwise(0.75).alias("score"), F.col("file").alias("witness"), (F.col("n") == 1).alias("promoted"))
    symbols = nodes.select(F.col("id").alias("code_id"), F.regexp_replace("label", r"\(\)$", "").alias("symbol"))
    said = claims.select("claim_id", F.explode(symbol_mentions(F.col("text"))).alias("symbol")).join(symbols, "symbol").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("claim_id", "symbol")))
    up = edges.where(F.col("relationship").isin("contains", "uses")).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))
    trails = shortest_trails(up, said.select(F.col("code_id").alias("id")).distinct()).where("steps > 0").select(F.col("id").alias("code_id"), "trail")
    j = said.join(trails, "code_id", "left")
    sure = (F.col("n") == 1) & F.col("trail").isNotNull()
    by_symbol = j.select("code_id", "claim_id", F.lit("exact-symbol").alias("kind"), F.when(sure, 1.0).when(F.col("trail").isNotNull(), 0.75).otherwise(0.5).alias("score"), F.concat_ws(": ", "symbol", "trail").alias("witness"), sure.alias("promoted"))
    evidence = by_file.unionByName(by_symbol).distinct()
    return evidence.where("promoted").select("code_id", "claim_id", "kind").distinct(), evidence


def traceability(requirements: DataFrame, nodes: DataFrame, tests: DataFrame, jobs: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """from_id, to_id, kind, witness, promoted of the links between requirements, code, tests and jobs.

    requirement-implemented-by: code whose symbol or source file the requirement's text names (promoted if one node has it).
    requirement-covered-by: tests whose target is the requirement. workflow-runs-test: jobs whose command names the test's file.
    requirement-gated-by: jobs that run a test of the requirement. test-exercises-code: code of the files that the test's file
    imports. requirements: id, requirement_id, text. nodes: id, label, source_file. tests: id, target, source_path. jobs: id, command.
    imports: source_path, module_path (the files that each test file imports).
    """
    says = requirements.select("id", F.explode(symbol_mentions(F.col("text"))).alias("witness"))
    symbols = nodes.select(F.col("id").alias("to_id"), F.regexp_replace("label", r"\(\)$", "").alias("witness"))
    paths = requirements.select("id", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("`([^`]*/[^`]*)`"), 1), normal_path))).alias("witness"))
    files = nodes.where(F.col("label") == F.regexp_extract("source_file", r"([^/]+)$", 1)).select(F.col("id").alias("to_id"), normal_path(F.col("source_file")).alias("witness"))
    code = says.join(symbols, "witness").unionByName(paths.join(files, "witness")).distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("id", "witness")))
    row = lambda df, frm, to, kind, witness, sure=F.lit(True): df.select(F.col(frm).alias("from_id"), F.col(to).alias("to_id"), F.lit(kind).alias("kind"), F.col(witness).alias("witness"), sure.alias("promoted"))
    covered = tests.join(requirements.select(F.col("id").alias("rid"), F.col("requirement_id").alias("target")), "target").select("rid", "id", "target", "source_path")
    # a command names a file by its path or by the end of a longer one, cut at a slash
    named = jobs.select(F.col("id").alias("job"), F.explode(F.regexp_extract_all("command", F.lit(r"([\w./\\-]+)"), 1)).alias("p")).select("job", F.split(normal_path(F.col("p")), "/").alias("w"))
    ends = named.select("job", F.explode(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.array_join(F.slice("w", i, F.size("w")), "/"))).alias("source_path")).distinct()
    runs = ends.join(tests.select(F.col("id").alias("test"), "target", normal_path(F.col("source_path")).alias("source_path")), "source_path")
    gated = runs.join(requirements.select(F.col("id").alias("rid"), F.col("requirement_id").alias("target")), "target").select("rid", "job", "source_path").distinct()
    links = [row(code, "id", "to_id", "requirement-implemented-by", "witness", F.col("n") == 1), row(covered, "rid", "id", "requirement-covered-by", "target"),
             row(runs, "job", "test", "workflow-runs-test", "source_path"), row(gated, "rid", "job", "requirement-gated-by", "source_path")]
    if imports is not None:
        used = imports.select("source_path", normal_path(F.col("module_path")).alias("witness")).distinct().join(files, "witness").join(tests.select(F.col("id").alias("test"), "source_path"), "source_path")
        links.append(row(used, "test", "to_id", "test-exercises-code", "witness"))
    return reduce(DataFrame.unionByName, links).distinct()


def dominant_communities(nodes: DataFrame, links: DataFrame, chosen: DataFrame) -> DataFrame:
    """rank, community, n_claims, first_claim: communities of code by the chosen claims that link to them, most first, ties by name.

    nodes: id, community. links: code_id, claim_id. chosen: claim_id. Claims count once a community; the ranks are given over one row
    per community. community_claims has the claims.
    """
    per = community_claims(nodes, links, chosen).groupBy("community").agg(F.count(F.lit(1)).alias("n_claims"), F.min("claim_id").alias("first_claim"))
    return per.select(F.row_number().over(Window.orderBy(F.col("n_claims").desc(), "community")).alias("rank"), "community", "n_claims", "first_claim")


def community_claims(nodes: DataFrame, links: DataFrame, chosen: DataFrame) -> DataFrame:
    """community, claim_id of the chosen claims that link to its code, once each."""
    own = nodes.where("community is not null").select(F.col("id").alias("code_id"), "community")
    return links.select("code_id", "claim_id").distinct().join(chosen.select("claim_id").distinct(), "claim_id", "left_semi").join(own, "code_id").select("community", "claim_id").distinct()


def run_design_query(catalog: GraphCatalog, name: str, target: str | None = None, min_rank: float = 0.9) -> DataFrame:
    """One of impact, why, coverage-gaps, stale-docs, untested-god-nodes, claim-grounding, ci-gates."""
    links, reqs = catalog.relation("traceability-link"), catalog.relation("design-requirement")
    promoted = links.where("promoted")
    code = catalog.relation("code-node").where((F.col("id") == target) | (F.col("label") == target) | F.coalesce(F.col("source_file").endswith(target or "\0"), F.lit(False))).select("id")
    wanted = reqs.where((F.col("id") == target) | (F.col("requirement_id") == target) | (F.col("capability") == target))
    shown = ["kind", "from_id", "to_id", "witness", "provenance", "source_path", "source_line"]
    touching = lambda ids: promoted.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").unionByName(promoted.join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi")).select(*shown).distinct()
    if name == "impact":
        return touching(code)
    if name == "why":
        own = wanted.select(F.lit("requirement").alias("kind"), F.col("id").alias("from_id"), F.lit(None).cast("string").alias("to_id"), F.col("text").alias("witness"), F.col("capability").alias("provenance"), "source_path", "source_line")
        return own.unionByName(touching(wanted.select("id").unionByName(code)))
    if name == "coverage-gaps":
        need = F.array(F.lit("requirement-implemented-by"), F.lit("requirement-covered-by"), F.lit("requirement-gated-by"))
        have = promoted.groupBy(F.col("from_id").alias("id")).agg(F.collect_set("kind").alias("have"))
        gaps = reqs.join(have, "id", "left").withColumn("missing", F.array_except(need, F.coalesce("have", F.array().cast("array<string>"))))
        return gaps.where(F.size("missing") > 0).select("requirement_id", "capability", F.array_join("missing", ",").alias("missing"), "source_path", "source_line")
    if name == "stale-docs":
        return links.where("not coalesce(promoted, false)").join(promoted.select("kind", "from_id", "to_id"), ["kind", "from_id", "to_id"], "left_anti").select(*shown)
    if name == "untested-god-nodes":
        tested = promoted.where("kind = 'test-exercises-code'").select(F.col("to_id").alias("id"))
        return catalog.relation("code-node").where(F.col("rank") >= min_rank).join(tested, "id", "left_anti").select("id", "label", "source_file", "rank")
    if name == "claim-grounding":
        l = catalog.relation("code-claim-link").join(code.select(F.col("id").alias("code_id"), F.lit(1).alias("hit")), "code_id", "left").where((F.col("hit") == 1) | (F.col("claim_id") == target) | (F.col("code_id") == target))
        n = catalog.relation("code-node").select(F.col("id").alias("code_id"), F.col("label").alias("code_label"), "source_file")
        c = catalog.relation("claim").select(F.col("id").alias("claim_id"), F.col("status").alias("claim_status"), F.col("canonical_text").alias("claim_text"))
        return l.join(n, "code_id", "left").join(c, "claim_id", "left").select("code_id", "code_label", "claim_id", "claim_status", "claim_text", "kind", "source_file")
    if name == "ci-gates":
        wide = reqs.where((F.col("id") == target) | (F.col("requirement_id") == target) | (F.col("capability") == target) | F.contains("source_path", F.lit(target or "\0")))
        g = promoted.where("kind = 'requirement-gated-by'").join(wide.select(F.col("id").alias("from_id"), "requirement_id", "capability"), "from_id")
        j = catalog.relation("ci-job").select(F.col("id").alias("to_id"), F.col("name").alias("job"), "required", "selector", "command")
        return g.join(j, "to_id", "left").select("requirement_id", "capability", F.col("to_id").alias("ci_job_id"), "job", "required", "selector", "command", "source_path", "source_line")
    raise ValueError(f"unknown design query {name!r}")


def evaluate_contract(metrics: DataFrame, contracts: DataFrame) -> DataFrame:
    """chapter, test, value, passes: each test ``metric op value`` of contracts (chapter, test) on metrics (chapter, metric, value).

    An unknown metric passes; true and false allow == and != only.
    """
    p = contracts.select("chapter", "test", F.regexp_extract("test", r"^\s*([\w.-]+)\s*(==|!=|<=|>=|<|>)\s*(\S+)\s*$", 1).alias("metric"), F.regexp_extract("test", r"(==|!=|<=|>=|<|>)", 1).alias("op"), F.regexp_extract("test", r"(?:==|!=|<=|>=|<|>)\s*(\S+)\s*$", 1).alias("want"))
    j = p.join(metrics, ["chapter", "metric"], "left")
    flag = F.col("want").isin("true", "false")
    want = F.when(flag, (F.col("want") == "true").cast("double")).otherwise(F.col("want").try_cast("double"))
    v = F.col("value").cast("double")
    ok = F.when(F.col("op") == "==", v == want).when(F.col("op") == "!=", v != want).when(flag, F.lit(False)).when(F.col("op") == "<=", v <= want).when(F.col("op") == ">=", v >= want).when(F.col("op") == "<", v < want).when(F.col("op") == ">", v > want)
    return j.select("chapter", "test", v.alias("value"), F.when(v.isNull(), True).otherwise(F.coalesce(ok, F.lit(False))).alias("passes"))


def supports_report(paragraphs: DataFrame, supports: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, kind (no-support, broken, unreachable): paragraphs against the thesis nodes they declare to carry.

    paragraphs: id. supports: id, node. nodes: node, root depth as of nested_sets (depth -1: leads nowhere). Where no
    paragraph declares anything, nothing is flagged.
    """
    any_ = supports.limit(1).count() > 0
    none = paragraphs.join(supports.select("id"), "id", "left_anti").select("id", F.lit("no-support").alias("kind"))
    j = supports.join(nodes.select("node", "depth"), "node", "left")
    bad = j.where("depth is null or depth < 0").select("id", F.when(F.col("depth").isNull(), "broken").otherwise("unreachable").alias("kind")).distinct()
    out = none.unionByName(bad)
    return out if any_ else out.limit(0)
