"""Puts the shared sub-queries a statement needs in front of it."""

from __future__ import annotations

import re


class SqlLibrary:
    def __init__(self, *modules):
        self.ctes: dict[str, str] = {}
        for module in modules:
            self.ctes.update(module.CTES)

    def _needs(self, sql: str) -> list[str]:
        words = set(re.findall(r"(?:FROM|JOIN|,)\s+([a-z_0-9]+)\b", sql))
        return [name for name in self.ctes if name in words]

    def statement(self, sql: str) -> str:
        order: list[str] = []

        def visit(name: str) -> None:
            if name in order:
                return
            for other in self._needs(self.ctes[name]):
                if other != name:
                    visit(other)
            order.append(name)

        for name in self._needs(sql):
            visit(name)
        if not order:
            return sql.strip()
        heads = ",\n".join(f"{name} AS MATERIALIZED ({self.ctes[name].strip()})" for name in order)
        return f"WITH {heads}\n{sql.strip()}"
