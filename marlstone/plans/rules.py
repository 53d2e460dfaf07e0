"""Rules over text claims: lifting typed facts, checking assertions, verdicts and remedies."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.plans.edn import Keyword, List, Symbol, read_all, read_edn

#: Number words that a lift understands.
NUMBER_WORDS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve".split())}


@dataclass
class Lift:
    """A pattern whose named groups give a typed fact."""

    predicate: str
    pattern: str  # with groups (?<subject>..) and (?<value>..) or (?P<..>..)
    kind: str = "real"  # int, real, bool, string, entity
    subject: str | None = None  # a fixed subject, where the pattern has no such group

    def __post_init__(self) -> None:
        if self.kind not in ("int", "real", "bool", "string", "entity"):
            raise ValueError(f"unknown kind {self.kind!r} of lift {self.predicate!r}")
        self.pattern = self.pattern.replace("(?P<", "(?<")
        names = re.findall(r"\((?!\?)|\(\?<([a-z]+)>", self.pattern)
        self.groups = {n: i + 1 for i, n in enumerate(names) if n}
        if self.kind != "bool" and "value" not in self.groups:
            raise ValueError(f"lift {self.predicate!r} has no group value")


def parse_lifts(text: str) -> list[Lift]:
    """Lifts of ``(deflift :name :pattern "..." :kind :int :subject "...")`` forms, in order."""
    out = []
    for form in read_all(text):
        if not isinstance(form, List) or form[0] != Symbol("deflift"):
            raise ValueError(f"expected a deflift form, got {form!r}")
        opts = {k.name: v for k, v in zip(form[2::2], form[3::2], strict=True)}
        kind = opts.get("kind", Keyword("real"))
        out.append(Lift(form[1].name, opts["pattern"], kind.name, opts.get("subject")))
    return out


def apply_lifts(claims: DataFrame, lifts: list[Lift]) -> DataFrame:
    """claim_id, predicate, subject, value_num, value_str, value_bool of each claim.

    The first lift in order that matches counts; a claim that none matches has the predicate OPAQUE.
    Thousands separators and number words are read; an unreadable number leaves the value null.
    """
    text = F.coalesce("canonical_text", F.lit(""))
    words = F.create_map(*[x for w, n in NUMBER_WORDS.items() for x in (F.lit(w), F.lit(float(n)))])

    def fact(i: Lift) -> Column:
        part = lambda g: F.regexp_extract(text, i.pattern, i.groups[g])
        raw = part("value") if "value" in i.groups else F.lit("")
        num = F.coalesce(F.try_element_at(words, F.lower(raw)), F.regexp_replace(raw, ",", "").try_cast("double"))
        subject = part("subject") if "subject" in i.groups else F.lit(i.subject)
        empty = F.lit(None)
        return F.struct(
            F.lit(i.predicate).alias("predicate"), F.lower(F.trim(subject)).alias("subject"),
            (F.floor(num).cast("double") if i.kind == "int" else num if i.kind == "real" else empty.cast("double")).alias("value_num"),
            (raw if i.kind in ("string", "entity") else empty.cast("string")).alias("value_str"),
            ((~F.lower(raw).isin("no", "not", "false", "never")) if i.kind == "bool" else empty.cast("boolean")).alias("value_bool"))

    nothing = F.struct(F.lit("OPAQUE").alias("predicate"), F.lit(None).cast("string").alias("subject"), F.lit(None).cast("double").alias("value_num"),
                       F.lit(None).cast("string").alias("value_str"), F.lit(None).cast("boolean").alias("value_bool"))
    first = F.coalesce(*[F.when(text.rlike(i.pattern), fact(i)) for i in lifts], nothing)
    return claims.select("claim_id", first.alias("f")).select("claim_id", "f.*")


def predicate_coverage(facts: DataFrame) -> DataFrame:
    """predicate, n, share."""
    total = facts.agg(F.count(F.lit(1)).alias("t"))
    return facts.groupBy("predicate").agg(F.count(F.lit(1)).alias("n")).join(total, F.lit(True)).select("predicate", "n", (F.col("n") / F.col("t")).alias("share"))


def opaque_gate(facts: DataFrame, most: float = 0.5) -> DataFrame:
    """n, opaque_share, passes: at most half of the claims may stay without a fact."""
    share = F.avg((F.col("predicate") == "OPAQUE").cast("int"))
    return facts.agg(F.count(F.lit(1)).alias("n"), F.coalesce(share, F.lit(0.0)).alias("opaque_share"), (F.coalesce(share, F.lit(0.0)) <= most).alias("passes"))


# assertions

_FOLD = {"+": lambda a, b: a + b, "*": lambda a, b: a * b, "and": lambda a, b: a & b, "or": lambda a, b: a | b}
_CHAIN = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b}


def approx_relative(a: Column, b: Column, eps: float) -> Column:
    """abs(a - b) <= abs(b) * eps, as a rule is checked."""
    return F.abs(a - b) <= F.abs(b) * eps


def approx_absolute(a: Column, b: Column, eps: float) -> Column:
    """abs(a - b) <= eps, as a fold is checked."""
    return F.abs(a - b) <= eps


def compile_assert(form: object, absolute: bool = False) -> Column:
    """An assertion form as a Column over one column per predicate.

    Heads: = != < <= > >= (chained), + - * / mod, and or not => ite, ~= and approx= (with a tolerance),
    and over arrays sum count in select forall exists (a variable stands in the body of the last two).
    Names of predicates are symbols; a missing value makes the comparison null, that is not satisfied.
    """
    return _compile(read_edn(form) if isinstance(form, str) else form, absolute, {})


def _compile(x: object, absolute: bool, env: dict[str, Column]) -> Column:
    if isinstance(x, Symbol):
        return env.get(x.name, F.col(f"`{x.name}`"))
    if isinstance(x, Keyword):
        return F.lit(x.name)
    if not isinstance(x, List):
        return F.lit(x)
    if not x or not isinstance(x[0], Symbol):
        raise ValueError(f"{x!r} is no assertion")
    head, args = x[0].name, list(x[1:])
    if head in ("forall", "exists"):  # (forall [v array] body)
        name, array = args[0][0].name, _compile(args[0][1], absolute, env)
        body = lambda v: _compile(args[1], absolute, env | {name: v})
        return F.forall(array, body) if head == "forall" else F.exists(array, body)
    c = [_compile(a, absolute, env) for a in args]
    if head in _FOLD and c:
        return reduce(_FOLD[head], c)
    if head in _CHAIN and len(c) >= 2:
        return reduce(lambda a, b: a & b, [_CHAIN[head](a, b) for a, b in zip(c, c[1:])])
    if head == "-":
        return -c[0] if len(c) == 1 else reduce(lambda a, b: a - b, c)
    if head in ("/", "mod") and len(c) == 2:
        return F.try_divide(c[0], c[1]) if head == "/" else F.when(c[1] != 0, F.pmod(c[0], c[1]))
    if head == "not" and len(c) == 1:
        return ~c[0]
    if head == "=>" and len(c) == 2:
        return ~c[0] | c[1]
    if head == "ite" and len(c) == 3:
        return F.when(c[0], c[1]).otherwise(c[2])
    if head in ("~=", "approx=") and len(c) in (2, 3):
        eps = float(args[2]) if len(args) == 3 else 1e-6
        return (approx_absolute if absolute else approx_relative)(c[0], c[1], eps)
    if head == "sum" and len(c) == 1:
        return F.aggregate(c[0], F.lit(0.0), lambda a, v: a + v)
    if head == "count" and len(c) == 1:
        return F.size(c[0])
    if head == "in" and len(c) == 2:
        return F.array_contains(c[1], c[0])
    if head == "select" and len(c) == 2:
        return F.try_element_at(c[0], c[1] + 1)
    raise ValueError(f"unknown head {head!r} or wrong number of terms")


_ORDERLESS = {"=", "+", "*", "and", "or", "!="}


def canonical_form(x: object) -> object:
    """An assertion with the operands of orderless heads sorted and nested ones of an associative head joined."""
    if not isinstance(x, List) or not x:
        return x
    head, args = x[0], [canonical_form(a) for a in x[1:]]
    if isinstance(head, Symbol) and head.name in ("+", "*", "and", "or"):
        args = [b for a in args for b in (a[1:] if isinstance(a, List) and a and a[0] == head else [a])]
    if isinstance(head, Symbol) and head.name in _ORDERLESS:
        args = sorted(args, key=repr)
    return List([head, *args])


def alpha_form(x: object, names: dict[str, str] | None = None) -> object:
    """A form with its ?variables renamed in order of appearance, so renamed twins are equal."""
    names = {} if names is None else names
    if isinstance(x, Symbol) and x.name.startswith("?"):
        return Symbol(names.setdefault(x.name, f"?v{len(names)}"))
    if isinstance(x, List):
        return List([alpha_form(i, names) for i in x])
    if isinstance(x, list):
        return [alpha_form(i, names) for i in x]
    return x


def dedup_rules(rules: list[tuple[str, object]]) -> list[tuple[object, list[str]]]:
    """Rules (origin, form) that are equal up to names and order, once, with all their origins."""
    seen: dict[str, tuple[object, list[str]]] = {}
    for origin, form in rules:
        c = canonical_form(alpha_form(form))
        seen.setdefault(repr(c), (form, []))[1].append(origin)
    return [(f, sorted(set(o))) for f, o in seen.values()]


@dataclass
class Constraint:
    name: str
    form: object
    predicates: list[str]
    severity: str = "critical"
    scope: str = "subject"  # or corpus
    remedies: list[str] = field(default_factory=list)


def parse_constraints(text: str) -> list[Constraint]:
    """Constraints of ``(defconstraint :name :assert (...) :severity :critical :scope :subject)`` forms."""
    out = []
    for form in read_all(text):
        if not isinstance(form, List) or form[0] != Symbol("defconstraint"):
            raise ValueError(f"expected a defconstraint form, got {form!r}")
        opts = {k.name: v for k, v in zip(form[2::2], form[3::2], strict=True)}
        name = lambda k, d: getattr(opts.get(k), "name", opts.get(k)) or d
        out.append(Constraint(form[1].name, opts["assert"], sorted(_names(opts["assert"])), name("severity", "critical"), name("scope", "subject")))
    return out


def _names(x: object) -> set[str]:
    if isinstance(x, List):
        own = {x[1][0].name} if x and x[0] in (Symbol("forall"), Symbol("exists")) else set()
        return set().union(*[_names(i) for i in x[1:]], set()) - own
    if isinstance(x, list):
        return set().union(*[_names(i) for i in x[1:]], set())
    return {x.name} if isinstance(x, Symbol) else set()


#: Most witnesses that a check lists; constraint_witnesses has them all.
LISTED = 20


def _scoped(facts: DataFrame, constraints: list[Constraint]) -> list[tuple[list[Constraint], DataFrame]]:
    """The constraints of each scope that has any, and the facts they read."""
    out = []
    for scope in ("subject", "corpus"):
        if mine := [c for c in constraints if c.scope == scope]:
            rows = facts.where(F.col("predicate").isin(sorted({p for c in mine for p in c.predicates})))
            out.append((mine, rows.withColumn("subject", F.col("subject") if scope == "subject" else F.lit("*"))))
    return out


def constraint_witnesses(facts: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """constraint, subject, claim_id: every claim that a constraint reads of a subject (``*`` in the corpus scope), once."""
    out = []
    for mine, rows in _scoped(facts, constraints):
        used = facts.sparkSession.createDataFrame([(c.name, p) for c in mine for p in c.predicates], "constraint string, predicate string")
        out.append(rows.join(used, "predicate").where("claim_id is not null").select("constraint", "subject", "claim_id").distinct())
    return reduce(DataFrame.unionByName, out)


def _with_subject(left: DataFrame, right: DataFrame) -> DataFrame:
    """left with the columns of its one row, if any, in right: the same constraint and subject, which may be null."""
    r = right.withColumnsRenamed({"constraint": "_c", "subject": "_s"})
    return left.join(r, F.col("constraint").eqNullSafe(F.col("_c")) & F.col("subject").eqNullSafe(F.col("_s")), "left").drop("_c", "_s")


def check_constraints(facts: DataFrame, constraints: list[Constraint]) -> DataFrame:
    """constraint, severity, subject, status (sat, unsat, unknown), witnesses, n_witnesses: each constraint on each subject's facts.

    facts: claim_id, subject, predicate, value_num. A subject that states different values of one
    predicate is checked on its least and its greatest; unsat if either fails, unknown if a value is
    missing. witnesses are the first LISTED of the n_witnesses claims concerned, cut by rank before they are
    gathered. The corpus scope takes all facts as one subject, named ``*``.
    """
    out = []
    for mine, rows in _scoped(facts, constraints):
        names = sorted({p for c in mine for p in c.predicates})
        ends = rows.groupBy("subject").agg(
            *[F.min(F.when(F.col("predicate") == p, F.col("value_num"))).alias(f"lo_{p}") for p in names], *[F.max(F.when(F.col("predicate") == p, F.col("value_num"))).alias(f"hi_{p}") for p in names])
        both = ends.select("subject", F.explode(F.array(*[F.struct(*[F.col(f"`{e}_{p}`").alias(p) for p in names]) for e in ("lo", "hi")])).alias("v")).select("subject", "v.*")
        checks = F.array(*[F.struct(F.lit(c.name).alias("constraint"), F.lit(c.severity).alias("severity"), compile_assert(c.form).alias("ok")) for c in mine])
        result = both.select("subject", F.explode(checks).alias("k")).groupBy("subject", "k.constraint", "k.severity").agg(
            F.max(F.when(~F.col("k.ok"), 2).when(F.col("k.ok").isNull(), 1).otherwise(0)).alias("code"))
        status = F.element_at(F.array(F.lit("sat"), F.lit("unknown"), F.lit("unsat")), F.col("code") + 1)
        out.append(result.select("constraint", "severity", "subject", status.alias("status")))
    every = constraint_witnesses(facts, constraints)
    first = every.withColumn("r", F.row_number().over(Window.partitionBy("constraint", "subject").orderBy("claim_id"))).where(F.col("r") <= LISTED)
    listed = first.groupBy("constraint", "subject").agg(F.sort_array(F.collect_list("claim_id")).alias("witnesses"))
    counted = every.groupBy("constraint", "subject").agg(F.count(F.lit(1)).alias("n_witnesses"))
    r = _with_subject(_with_subject(reduce(DataFrame.unionByName, out), listed), counted)
    return r.withColumns({"witnesses": F.coalesce("witnesses", F.array().cast("array<string>")), "n_witnesses": F.coalesce("n_witnesses", F.lit(0))})


def verdict(checks: DataFrame) -> DataFrame:
    """status of all checks: unsat if any is, else unknown if any is, else sat; and how many of each."""
    n = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("int")), F.lit(0)).alias(f"n_{s}")
    return checks.agg(n("sat"), n("unknown"), n("unsat")).withColumn("status", F.when(F.col("n_unsat") > 0, "unsat").when(F.col("n_unknown") > 0, "unknown").otherwise("sat"))


def defect_confidence(defects: DataFrame, claims: DataFrame, weak: float = 0.5, witnesses: DataFrame | None = None) -> DataFrame:
    """constraint, subject, confidence (least of its witnesses'), severity (one step lower if all witnesses are below weak).

    witnesses: constraint_witnesses. Without them the defects' lists are read, and a list that is not whole is an error.
    A defect without witnesses has confidence 1.
    """
    unsat = defects.where("status = 'unsat'")
    if witnesses is None:
        whole = F.when(F.col("n_witnesses") > F.size("witnesses"), F.raise_error(F.lit("a list of witnesses is cut; pass constraint_witnesses"))).otherwise(F.col("witnesses"))
        witnesses = unsat.select("constraint", "subject", F.explode(whole).alias("claim_id"))
    conf = F.coalesce("confidence", F.lit(1.0))
    ends = witnesses.join(claims.select("claim_id", "confidence"), "claim_id", "left").groupBy("constraint", "subject").agg(F.min(conf).alias("least"), F.max(conf).alias("best"))
    s = _with_subject(unsat.select("constraint", "subject", "severity"), ends)
    lower = F.when(F.col("severity") == "critical", "important").when(F.col("severity") == "important", "minor").otherwise(F.col("severity"))
    return s.select("constraint", "subject", F.coalesce("least", F.lit(1.0)).alias("confidence"), F.when(F.col("best") < weak, lower).otherwise(F.col("severity")).alias("severity"))


def verdict_confidence(defects: DataFrame) -> DataFrame:
    """confidence: geometric mean of the defects' confidences, 0 if any is 0, 1 without defects."""
    return defects.agg(F.when(F.count(F.lit(1)) == 0, 1.0).when(F.min("confidence") <= 0, 0.0).otherwise(F.exp(F.avg(F.ln("confidence")))).alias("confidence"))


#: The status that a remedy proposes for each kind of ticket.
PROPOSALS = {"contradiction": "disputed", "unsupported": "proposed", "refuted": "refuted", "replaced": "superseded"}


def propose(tickets: DataFrame, claims: DataFrame) -> DataFrame:
    """claim_id, from_status, to_status, is_allowed: what each ticket (claim_id, kind) proposes; kinds without a proposal are left out."""
    from marlstone.operators.ledger import check_transitions

    to = F.create_map(*[x for k, v in PROPOSALS.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")]
    j = tickets.join(claims.select("claim_id", F.col("status").alias("from_status")), "claim_id").withColumn("to_status", to).where("to_status is not null").select("claim_id", "from_status", "to_status").distinct()
    return check_transitions(j, "from_status", "to_status")


def fit_tolerance(pairs: DataFrame, left: str, right: str, most: float) -> DataFrame:
    """eps: the least relative tolerance that satisfies every row, null if it is above ``most`` or a right side is 0 and differs."""
    need = F.when(F.col(right) != 0, F.abs(F.col(left) - F.col(right)) / F.abs(F.col(right))).when(F.col(left) == F.col(right), 0.0).otherwise(F.lit(float("inf")))
    return pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull()).agg(F.max(need).alias("eps")).select(F.when(F.col("eps") <= most, F.col("eps")).alias("eps"))
