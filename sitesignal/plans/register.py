"""Registers queries with their oracle SQL under the function's name."""

from __future__ import annotations

from collections.abc import Callable


class Register:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, oracle: str | None = None):
        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if oracle:
                self.oracles[f.__name__] = oracle
            return f

        return add
