"""A plain Python evaluator of the query language, for property tests."""

from __future__ import annotations

from marlstone.plans.catalog import GraphCatalog, snake
from marlstone.plans.query import COMPARE, Atom, Query, is_variable, parse

Rows = dict[str, list[dict]]


def _match(atom: Atom, rows: list[dict], env: dict, free_not_null: bool = False) -> list[dict]:
    out = []
    for r in rows:
        if any(r.get(snake(a)) != v or (v is not None and r.get(snake(a)) is None) for a, v in atom.literals):
            continue
        new, ok = dict(env), True
        for a, v in atom.binds:
            cell = r.get(snake(a))
            if v in new:
                ok = new[v] == cell and (new[v] is None) == (cell is None)
            else:
                new[v] = cell
                ok = not free_not_null or cell is not None
            if not ok:
                break
        if ok:
            out.append(new)
    return out


def bindings(q: Query, tables: Rows) -> list[dict]:
    envs: list[dict] = [{}]
    for atom in q.where:
        envs = [n for e in envs for n in _match(atom, tables.get(atom.relation, []), e)]
    value = lambda e, x: e[x.name] if is_variable(x) else x
    for op, a, b in q.filters:
        envs = [e for e in envs if value(e, a) is not None and value(e, b) is not None and COMPARE[op](value(e, a), value(e, b))]
    for atom in q.negations:
        envs = [e for e in envs if not _match(atom, tables.get(atom.relation, []), e, True)]
    return envs


def evaluate(text: str, catalog: GraphCatalog, tables: Rows) -> set[tuple]:
    """The result set of a defquery over rows given as dicts."""
    q = parse(text, catalog)
    envs = bindings(q, tables)
    if all(k == "var" for k, _ in q.find):
        return {tuple(e[v] for _, v in q.find) for e in envs}
    groups: dict[tuple, list[dict]] = {}
    for e in envs:
        groups.setdefault(tuple(e[v] for k, v in q.find if k == "var"), []).append(e)
    out = set()
    for key, es in groups.items():
        row, i = [], 0
        for k, v in q.find:
            if k == "var":
                row.append(key[i])
                i += 1
            elif k == "count":
                row.append(len({tuple(sorted(e.items(), key=lambda x: x[0])) for e in es}))
            else:
                row.append(len({e[v] for e in es if e[v] is not None}))
        out.add(tuple(row))
    return out
