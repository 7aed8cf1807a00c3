"""One operator's tables at a time in a Python worker.

Workers outlive tasks, and so do the tables of words that operators keep in them. When
another operator's task comes to a worker, the others' tables go.
"""

from __future__ import annotations

from collections.abc import Callable

_clear: dict[str, Callable[[], None]] = {}


def register(name: str, clear: Callable[[], None]) -> None:
    _clear[name] = clear


def use(name: str) -> None:
    """Called where a task of ``name`` begins."""
    for other, clear in _clear.items():
        if other != name:
            clear()
