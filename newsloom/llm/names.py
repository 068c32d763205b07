"""Column names that do not clash."""

from __future__ import annotations

from collections.abc import Iterable

def free(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores in front until no column is called so (Spark ignores case)."""
    taken = {t.lower() for t in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(names: Iterable[str], gone: Iterable[str]) -> list[str]:
    """The names that are not, but for case, among ``gone``."""
    gone = {g.lower() for g in gone}
    return [n for n in names if n.lower() not in gone]
