"""A query as pattern-language text with parameters: for reading and for other engines. Spark runs the DataFrame plan."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from .spec import Query


@dataclass(frozen=True)
class Statement:
    text: str
    params: dict

    def __post_init__(self):
        if not self.text or not self.text.strip():
            raise ValueError("statement must not be blank")


_ARROWS = {"OUTBOUND": ("-", "->"), "INBOUND": ("<-", "-"), "UNDIRECTED": ("-", "-")}


def render(query: Query) -> Statement:
    params: dict[str, Any] = {}

    def pattern(path) -> str:
        nodes = [f"({a}{''.join(':' + x for x in query.nodes[a].labels)})" for a in query.walk(path)]
        out = nodes[0]
        for alias, node in zip(path.edges, nodes[1:], strict=True):
            edge = query.edges[alias]
            left, right = _ARROWS[edge.direction]
            out += f"{left}[{alias}{':' + edge.type if edge.type else ''}]{right}{node}"
        return f"MATCH {path.alias} = {out}"

    tests = []
    for kind, held in (("node", query.nodes), ("edge", query.edges)):
        for alias, x in held.items():
            wanted = ([("id", "id", x.id)] if x.id is not None else []) + [(k, f"prop_{k}", v) for k, v in x.properties.items()]
            for key, suffix, value in wanted:
                name = f"{kind}_{alias}_{suffix}"
                params[name] = value
                tests.append(f"{alias}.{key} = ${name}")
            for k, (key, operator, value) in enumerate(query.tests.get(alias, ())):
                name = f"{kind}_{alias}_cond{k}_value"
                params[name] = value
                tests.append(f"{alias}.{key} {'=' if operator == 'EQ' else operator} ${name}")
    lines = [pattern(p) for p in query.paths]
    if tests:
        lines.append("WHERE " + "\n  AND ".join(tests))
    lines.append("RETURN " + ",\n       ".join(f"{i.ref} AS {i.alias}" for i in query.returned()))
    if query.limit is not None:
        lines.append(f"LIMIT {query.limit}")
    return Statement("\n".join(lines), params)
