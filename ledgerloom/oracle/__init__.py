"""The same results stated as SQL for another engine, used only as a check.

Each section of the ``.sql`` files is one named relation; a query's text is
that relation with every relation it mentions put in front as a CTE.
"""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

_HEADER = re.compile(r"^-- name: (\w+)\s*$", re.M)


@lru_cache(maxsize=1)
def relations() -> dict[str, str]:
    out: dict[str, str] = {}
    for path in sorted(Path(__file__).parent.glob("*.sql")):
        pieces = _HEADER.split(path.read_text())
        for name, body in zip(pieces[1::2], pieces[2::2]):
            out[name] = body.strip()
    return out


@lru_cache(maxsize=None)
def _needs(name: str) -> tuple[str, ...]:
    known = relations()
    words = dict.fromkeys(re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", known[name]))
    return tuple(w for w in words if w in known and w != name)


def sql_for(name: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for dep in _needs(n):
            visit(dep)
        if n not in order:
            order.append(n)

    visit(name)
    known = relations()
    # Relations are reached many times; without MATERIALIZED each mention is planned anew.
    ctes = [f"{n} AS MATERIALIZED (\n{known[n]}\n)" for n in order if n != name]
    head = "WITH " + ",\n".join(ctes) + "\n" if ctes else ""
    return head + known[name]
