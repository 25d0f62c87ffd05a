"""Named functions: policies, scorers, confidence methods."""

from __future__ import annotations

from collections.abc import Callable
from typing import Generic, TypeVar

T = TypeVar("T")


class Registry(Generic[T]):
    def __init__(self, kind: str):
        self.kind, self._held = kind, {}

    def register(self, name: str, value: T | None = None) -> Callable[[T], T] | T:
        def keep(v: T) -> T:
            if name in self._held:
                raise ValueError(f"there is already a {self.kind} {name!r}")
            self._held[name] = v
            return v

        return keep if value is None else keep(value)

    def __getitem__(self, name: str) -> T:
        if name not in self._held:
            raise ValueError(f"unknown {self.kind} {name!r}; there are {', '.join(sorted(self._held))}")
        return self._held[name]

    def names(self) -> list[str]:
        return sorted(self._held)
