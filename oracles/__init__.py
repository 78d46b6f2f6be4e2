"""Independent DuckDB statements for the registered queries.

``NAMED`` maps a relation name to its SELECT.  ``statement`` puts every relation a query mentions, directly or
through others, into one WITH clause.
"""

from __future__ import annotations

import re

NAMED: dict[str, str] = {}


def name(**relations: str) -> None:
    for key, sql in relations.items():
        NAMED[key] = sql.strip()


def statement(sql: str) -> str:
    order: list[str] = []

    def visit(text: str, path: tuple[str, ...]) -> None:
        for word in dict.fromkeys(re.findall(r"\b[a-z_0-9]+\b", text)):
            if word in NAMED and word not in order and word not in path:
                visit(NAMED[word], (*path, word))
                order.append(word)

    visit(sql, ())
    if not order:
        return sql
    return "WITH " + ",\n".join(f"{n} AS ({NAMED[n]})" for n in order) + "\n" + sql
