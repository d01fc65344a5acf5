"""Which rules a text can match at all, found by one pass of a multi-pattern automaton.

The syntax tree of a pattern tells which literal texts every match must hold one of: a run of literals,
or for alternatives one of each branch. A rule whose literals do not occur cannot match, so its
expressions need not run. Patterns without such literals always pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

try:
    import re._constants as ops
    import re._parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as ops
    import sre_parse as parser

_SAME = str.maketrans({"İ": "i", "ı": "i"})
_SHORTEST = 2


def plain(text: str) -> str:
    """A text as literals are compared: letters that any case-insensitive match takes as equal are equal."""
    return text if text.isascii() and text.islower() else text.translate(_SAME).casefold()


def _best(sets: list[set[str]]) -> set[str] | None:
    good = [s for s in sets if s and min(map(len, s)) >= _SHORTEST]
    return max(good, key=lambda s: (min(map(len, s)), -len(s))) if good else None


def _needed(tree: Any) -> set[str] | None:
    """Literals of which every match of the sequence holds one, or None."""
    sets, run = [], ""
    for op, arg in tree:
        if op is ops.LITERAL:
            run += chr(arg)
            continue
        if run:
            sets.append({plain(run)})
            run = ""
        if op is ops.SUBPATTERN:
            inner = _needed(arg[-1])
        elif op is ops.BRANCH:
            each = [_needed(b) for b in arg[1]]
            inner = None if None in each else set().union(*each)
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and arg[0] >= 1:
            inner = _needed(arg[2])
        else:
            inner = None
        if inner:
            sets.append(inner)
    if run:
        sets.append({plain(run)})
    return _best(sets)


def literals(pattern: str) -> set[str] | None:
    return _needed(parser.parse(pattern))


def needs(node: dict[str, Any]) -> list[set[str]]:
    """Sets of literals; a match of the tree needs one of each set."""
    if "regex" in node:
        found = literals(node["regex"])
        return [found] if found else []
    if "near" in node:
        return [s for s in (literals(node["near"]["a"]), literals(node["near"]["b"])) if s]
    if "all" in node:
        return [s for child in node["all"] for s in needs(child)]
    if "any" in node:
        each = [needs(child) for child in node["any"]]
        return [] if [] in each else [set().union(*(c[0] for c in each))]
    return []


def gate(trees: list[dict[str, Any]]) -> Callable[[str], list[int]]:
    """A function that gives the numbers of the trees a text may match."""
    try:
        import ahocorasick
    except ImportError:
        return lambda text: list(range(len(trees)))
    wanted = [needs(t) for t in trees]
    always = [k for k, sets in enumerate(wanted) if not sets]
    full = {k: (1 << len(sets)) - 1 for k, sets in enumerate(wanted) if sets}
    owners: dict[str, list[tuple[int, int]]] = {}
    for k, sets in enumerate(wanted):
        for j, s in enumerate(sets):
            for word in s:
                owners.setdefault(word, []).append((k, 1 << j))
    machine = ahocorasick.Automaton()
    for word, who in owners.items():
        machine.add_word(word, (word, who))
    if owners:
        machine.make_automaton()

    def run(text: str) -> list[int]:
        if not owners:
            return always
        seen = {}
        for _, (word, who) in machine.iter(plain(text)):
            seen[word] = who
        held: dict[int, int] = {}
        for who in seen.values():
            for k, bit in who:
                held[k] = held.get(k, 0) | bit
        return sorted([*always, *(k for k, bits in held.items() if bits == full[k])])

    return run
