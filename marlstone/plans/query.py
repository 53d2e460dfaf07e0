"""Declarative graph queries and integrity constraints as DataFrame plans.

A ``defquery`` has ``:find``, ``:where``, ``:filter`` and ``:not``. Triples ``[?e :rel/attr term]``
of one entity variable are one scan; scans join on shared variables, null matching null;
comparisons drop rows with a null operand; each entity group of ``:not`` is an anti-join of its
own. Results are sets. ``(count ?x)`` counts the distinct bindings of all body variables,
``(count-distinct ?x)`` the values of one.

A ``defconstraint`` has no ``:find``; it returns a row per ``?focus`` that its body holds for. A
variable that is bound only inside ``:not`` there asks for any value that is not null.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.plans.catalog import GraphCatalog, snake
from marlstone.plans.edn import Keyword, List, Symbol, read_edn

COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "!=": operator.ne, "=": operator.eq}


@dataclass
class Atom:
    """One scan: a relation, its literals and the variables it binds."""

    relation: str
    literals: list[tuple[str, object]] = field(default_factory=list)
    binds: list[tuple[str, str]] = field(default_factory=list)  # attribute, variable

    @property
    def variables(self) -> set[str]:
        return {v for _, v in self.binds}


@dataclass
class Query:
    name: str
    find: list[tuple[str, str]]  # kind (var, count, count-distinct), variable
    where: list[Atom]
    filters: list[tuple[str, object, object]]
    negations: list[Atom]
    options: dict[str, object]


def is_variable(x: object) -> bool:
    return isinstance(x, Symbol) and x.name.startswith("?")


def column_of(variable: str) -> str:
    return snake(variable.lstrip("?"))


def _sections(form: object, head: str) -> tuple[str, dict[str, object]]:
    if not isinstance(form, (tuple, list)) or len(form) < 2 or not isinstance(form[0], Symbol) or form[0].name != head:
        raise ValueError(f"expected a ({head} ...) form")
    if not isinstance(form[1], (Keyword, Symbol)):
        raise ValueError(f"{head} needs a name")
    rest = list(form[2:])
    if len(rest) % 2:
        raise ValueError(f"{head} {form[1].name}: sections come in pairs")
    return form[1].name, {k.name: v for k, v in zip(rest[::2], rest[1::2], strict=True)}


def _atoms(clauses: Iterable[object], catalog: GraphCatalog, where: str) -> tuple[list[Atom], list[tuple[str, object, object]]]:
    """Scans of the clauses, in order of appearance, and comparisons among them."""
    groups: dict[object, Atom] = {}
    compares = []
    for n, clause in enumerate(clauses):
        if isinstance(clause, List):  # positional: (relation term ...), or (op a b)
            if not clause or not isinstance(clause[0], Symbol):
                raise ValueError(f"{where}: {clause!r} has no relation")
            name = clause[0].name
            if name in COMPARE:
                compares.append(_comparison(clause, where))
                continue
            attrs = list(catalog.attributes(name))
            if len(clause) - 1 > len(attrs):
                raise ValueError(f"{where}: {name} takes at most {len(attrs)} terms")
            atom = groups.setdefault(n, Atom(name))
            for a, term in zip(attrs, clause[1:], strict=False):
                if isinstance(term, Symbol) and term.name == "_":
                    continue
                _bind(atom, a, term)
            continue
        if not isinstance(clause, list) or len(clause) != 3:
            raise ValueError(f"{where}: a triple has three parts, got {clause!r}")
        entity, attr, term = clause
        if not is_variable(entity):
            raise ValueError(f"{where}: {entity!r} is no entity variable")
        if not isinstance(attr, Keyword) or "/" not in attr.name:
            raise ValueError(f"{where}: {attr!r} is no relation/attribute")
        relation, _, a = attr.name.partition("/")
        if a not in catalog.attributes(relation):
            raise ValueError(f"unknown attribute {a!r} of relation {relation!r}")
        atom = groups.setdefault(entity.name, Atom(relation))
        if atom.relation != relation:
            raise ValueError(f"{where}: {entity.name} stands for {atom.relation!r} and for {relation!r}")
        _bind(atom, a, term)
    return list(groups.values()), compares


def _bind(atom: Atom, attr: str, term: object) -> None:
    if is_variable(term):
        atom.binds.append((attr, term.name))
    elif isinstance(term, Symbol):
        raise ValueError(f"{term.name!r} is neither a variable nor a literal")
    else:
        atom.literals.append((attr, term.name if isinstance(term, Keyword) else term))


def _comparison(clause: object, where: str) -> tuple[str, object, object]:
    if not isinstance(clause, (list, tuple)) or len(clause) != 3:
        raise ValueError(f"{where}: a comparison has three parts, got {clause!r}")
    op, a, b = clause
    if not isinstance(op, Symbol) or op.name not in COMPARE:
        raise ValueError(f"{where}: {op!s} is no comparator")
    if not is_variable(a) and not is_variable(b):
        raise ValueError(f"{where}: a comparison needs a variable")
    return op.name, a, b


def parse(text: str | tuple, catalog: GraphCatalog, head: str = "defquery") -> Query:
    """The checked parts of a form; ValueError names what is wrong."""
    name, parts = _sections(read_edn(text) if isinstance(text, str) else text, head)
    where, compares = _atoms(parts.get("where") or [], catalog, f"{name} :where")
    if not where:
        raise ValueError(f"{name}: :where is empty")
    negations, more = _atoms(parts.get("not") or [], catalog, f"{name} :not")
    if more:
        raise ValueError(f"{name}: comparisons belong outside :not")
    filters = compares + [_comparison(c, f"{name} :filter") for c in parts.get("filter") or []]
    bound = set().union(*[a.variables for a in where])
    for _, a, b in filters:
        for x in (a, b):
            if is_variable(x) and x.name not in bound:
                raise ValueError(f"{name}: {x.name} in :filter is not bound in :where")
    find: list[tuple[str, str]] = []
    if head == "defquery":
        for term in parts.get("find") or []:
            kind, v = "var", term
            if isinstance(term, List):
                if len(term) != 2 or not isinstance(term[0], Symbol) or term[0].name not in ("count", "count-distinct"):
                    raise ValueError(f"{name}: unknown aggregate {term!r}")
                kind, v = term[0].name, term[1]
            if not is_variable(v):
                raise ValueError(f"{name}: {v!r} in :find is no variable")
            if v.name not in bound:
                raise ValueError(f"{name}: {v.name} in :find is not bound in :where")
            find.append((kind, v.name))
        if not find:
            raise ValueError(f"{name}: :find is empty")
        for a in negations:
            if free := a.variables - bound:
                raise ValueError(f"{name}: unsafe negation, {', '.join(sorted(free))} is not bound in :where")
    elif "find" in parts:
        raise ValueError(f"{name}: a constraint has no :find")
    for a in negations:
        if not a.variables & bound:
            raise ValueError(f"{name}: a group of :not shares no variable with :where")
    return Query(name, find, where, filters, negations, parts)


def scan(atom: Atom, catalog: GraphCatalog) -> DataFrame:
    """Rows of one scan, a column per variable."""
    df = catalog.relation(atom.relation)
    for a, value in atom.literals:
        df = df.where(F.col(snake(a)).isNull() if value is None else F.col(snake(a)) == F.lit(value))
    of: dict[str, str] = {}
    for a, v in atom.binds:
        if v in of:
            df = df.where(F.col(snake(a)).eqNullSafe(F.col(of[v])))
        else:
            of[v] = snake(a)
    return df.select(*[F.col(c).alias(column_of(v)) for v, c in of.items()])


def _matched(left: DataFrame, right: DataFrame, shared: list[str], how: str) -> DataFrame:
    """Join on equal columns, null matching null."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}" if c in shared else c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in shared])
    return left.join(renamed, on, how).drop(*[f"_r_{c}" for c in shared])


def _body(q: Query, catalog: GraphCatalog, cartesian: bool) -> DataFrame:
    waiting = list(q.where)
    df = scan(waiting[0], catalog)
    bound = set(waiting.pop(0).variables)
    while waiting:
        nxt = next((a for a in waiting if a.variables & bound), None)
        if nxt is None:
            if not cartesian:
                raise ValueError(f"{q.name}: the scans of :where share no variable; a product must be asked for with cartesian=True")
            nxt = waiting[0]
        waiting.remove(nxt)
        right, shared = scan(nxt, catalog), sorted(column_of(v) for v in nxt.variables & bound)
        # a scan that adds no variable only tells whether a match exists
        how = "left_semi" if shared and not nxt.variables - bound else "inner"
        df = _matched(df, right, shared, how) if shared else df.crossJoin(right)
        bound |= nxt.variables
    for op, a, b in q.filters:
        df = df.where(COMPARE[op](_operand(a), _operand(b)))
    for atom in q.negations:
        shared = sorted(column_of(v) for v in atom.variables & bound)
        right = scan(atom, catalog)
        for v in sorted(atom.variables - bound):
            right = right.where(F.col(column_of(v)).isNotNull())
        df = _matched(df, right.select(*shared), shared, "left_anti")
    return df


def _operand(x: object) -> Column:
    return F.col(column_of(x.name)) if is_variable(x) else F.lit(x.name if isinstance(x, Keyword) else x)


def run_query(text: str | tuple, catalog: GraphCatalog, cartesian: bool = False) -> DataFrame:
    """The rows of a defquery: a column per :find term, named after its variable (count_x, count_distinct_x)."""
    q = parse(text, catalog)
    df = _body(q, catalog, cartesian)
    plain = [column_of(v) for k, v in q.find if k == "var"]
    if len(plain) == len(q.find):
        return df.select(*plain).distinct()
    if any(k == "count" for k, _ in q.find):
        df = df.distinct()
    aggs = [
        (F.count(F.lit(1)).alias(f"count_{column_of(v)}") if k == "count" else F.count_distinct(column_of(v)).alias(f"count_distinct_{column_of(v)}"))
        for k, v in q.find if k != "var"]
    out = df.groupBy(*plain).agg(*aggs)
    return out.select(*[column_of(v) if k == "var" else f"{snake(k)}_{column_of(v)}" for k, v in q.find])


def run_constraint(text: str | tuple, catalog: GraphCatalog) -> DataFrame:
    """constraint, focus_node, path, message, component (empty where none is named): one row per focus that violates a defconstraint."""
    q = parse(text, catalog, "defconstraint")
    if "?focus" not in set().union(*[a.variables for a in q.where]):
        raise ValueError(f"{q.name}: ?focus is not bound in :where")
    if not isinstance(q.options.get("message"), str):
        raise ValueError(f"{q.name}: :message is missing")
    return _body(q, catalog, False).select(
        F.lit(q.name).alias("constraint"), F.col("focus").alias("focus_node"),
        F.lit(q.options.get("path") or "").alias("path"), F.lit(q.options["message"]).alias("message"),
        F.lit(q.options.get("component") or "").alias("component")).distinct()


def constraint_report(constraints: Iterable[str], catalog: GraphCatalog) -> DataFrame:
    """Violations of all constraints; the graph conforms if it is empty."""
    return reduce(DataFrame.unionByName, [run_constraint(c, catalog) for c in constraints])


def competency_report(queries: dict[str, tuple[str, str, str | None]], catalog: GraphCatalog) -> DataFrame:
    """query, class, severity, n_rows of each (text, class, severity), in one plan."""
    def one(name: str, text: str, kind: str, severity: str | None) -> DataFrame:
        return run_query(text, catalog).agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("query"), F.lit(kind).alias("class"), F.lit(severity).cast("string").alias("severity"), "n_rows")

    return reduce(DataFrame.unionByName, [one(n, *spec) for n, spec in queries.items()])


def assert_not_blocked(report: DataFrame) -> None:
    """Raise if a critical defeasible query found rows."""
    hits = [r["query"] for r in report.where("class = 'defeasible' and severity = 'critical' and n_rows > 0").collect()]
    if hits:
        raise ValueError(f"blocked by {', '.join(sorted(hits))}")
