"""Names for helper columns."""

from __future__ import annotations


def fresh_names(taken: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with so many underscores in front that no column, in either case, has it."""
    used, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out
