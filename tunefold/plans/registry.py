"""Registry of queries and the SQL that says the same thing.

SQL texts may name shared CTEs from roles.CTES; those they use are prepended, dependencies first.
"""
from __future__ import annotations

import re

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}

_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _needed(text: str, seen: list[str], open_: frozenset = frozenset()) -> None:
    for w in _WORD.findall(text):
        if w in CTES and w not in seen and w not in open_:
            _needed(CTES[w], seen, open_ | {w})
            if w not in seen:
                seen.append(w)


def compose(sql: str) -> str:
    names: list[str] = []
    _needed(sql, names)
    if not names:
        return sql.strip()
    # names starting with rec_ are recursive and carry their column list in the first line of the text
    parts = []
    for n in names:
        body = CTES[n].strip()
        if n.startswith("rec_"):
            cols, body = body.split("\n", 1)
            parts.append(f"{n}{cols} AS ({body})")
        else:
            parts.append(f"{n} AS MATERIALIZED ({body})")
    head = ",\n".join(parts)
    body = sql.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH RECURSIVE {head},\n{body[5:]}"
    return f"WITH RECURSIVE {head}\n{body}"


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(name)
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco
