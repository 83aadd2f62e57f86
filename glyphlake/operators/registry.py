"""Names for transforms and column functions: matchers, formatters (the plug-in surface)."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Registry:
    """A name can be given once; an unknown one raises KeyError with those there are."""

    def __init__(self, kind: str):
        self._kind = kind
        self._known: dict[str, Callable[..., Any]] = {}

    def register(self, name: str) -> Callable:
        def add(made: Callable) -> Callable:
            if name in self._known:
                raise ValueError(f"{self._kind} {name} is registered already")
            self._known[name] = made
            return made

        return add

    def get(self, name: str) -> Callable[..., Any]:
        if name not in self._known:
            raise KeyError(f"unknown {self._kind} {name}; there are {', '.join(sorted(self._known)) or 'none'}")
        return self._known[name]

    def names(self) -> list[str]:
        return sorted(self._known)
