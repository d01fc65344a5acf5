"""Texts that a rule matches, and texts that just miss it, made from its patterns."""

from __future__ import annotations

import random
import re
from re import _constants as K
from re import _parser as P
from typing import Any

from quernstone.operators.rules import OPERATORS, Rule

_CLASSES = {K.CATEGORY_SPACE: " ", K.CATEGORY_WORD: "a", K.CATEGORY_DIGIT: "1", K.CATEGORY_NOT_SPACE: "a", K.CATEGORY_NOT_WORD: " ", K.CATEGORY_NOT_DIGIT: "a"}


def _one_of(items: list, rng: random.Random) -> str:
    """A character of a set."""
    if items[0][0] is K.NEGATE:
        left_out = "".join(re.escape(chr(a)) if op is K.LITERAL else r"\s" for op, a in items[1:] if op is K.LITERAL or a is K.CATEGORY_SPACE)
        return next(c for c in " xo1" if not re.match(f"[{left_out}]", c))
    op, arg = rng.choice(items)
    if op is K.LITERAL:
        return chr(arg)
    if op is K.RANGE:
        return chr(rng.randint(*arg))
    return _CLASSES[arg]


def _made(tree: Any, rng: random.Random, groups: dict[int, str]) -> str:
    out = ""
    for op, arg in tree:
        if op is K.LITERAL:
            out += chr(arg)
        elif op is K.NOT_LITERAL:
            out += "x" if arg != ord("x") else "y"
        elif op is K.ANY:
            out += "x"
        elif op is K.IN:
            out += _one_of(arg, rng)
        elif op is K.BRANCH:
            out += _made(rng.choice(arg[1]), rng, groups)
        elif op is K.SUBPATTERN:
            groups[arg[0]] = _made(arg[3], rng, groups)
            out += groups[arg[0]]
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, inner = arg
            # a gap between words is one space, a choice may be left out
            times = low if low else int(int(high) > 1 and rng.random() < 0.8)
            out += "".join(_made(inner, rng, groups) for _ in range(times))
        elif op is K.GROUPREF:
            out += groups.get(arg, "")
    return out


def example(pattern: str, seed: int = 0, tries: int = 3000) -> str:
    """A text that a pattern finds."""
    rng, tree = random.Random(f"{seed}{pattern}"), P.parse(pattern)
    for _ in range(tries):
        text = _made(tree, rng, {}).strip()
        if re.search(pattern, text):
            return text
    raise ValueError(f"no example for {pattern!r}")


def found(node: dict[str, Any], text: str) -> bool:
    """Whether a match tree matches a text, by the patterns alone."""
    kind = next(k for k in OPERATORS if k in node)
    body = node[kind]
    if kind == "regex":
        return re.search(body, text) is not None
    if kind == "not":
        return not found(body, text)
    if kind == "near":
        spans = [[m.span() for m in re.finditer(body[k], text)] for k in "ab"]
        return any((y[0] - x[1] if y[0] >= x[1] else x[0] - y[1]) <= body.get("window", 40) for x in spans[0] for y in spans[1])
    return (all if kind == "all" else any)(found(c, text) for c in body)


def positive(node: dict[str, Any], seed: int = 0) -> str:
    """A text that a match tree matches."""
    kind = next(k for k in OPERATORS if k in node)
    body = node[kind]
    if kind == "regex":
        return example(body, seed)
    if kind == "near":
        gap = "\n" if "(?m)" in body["a"] + body["b"] else " "
        return example(body["a"], seed) + gap + example(body["b"], seed)
    if kind == "not":
        return "nothing of the kind"
    return " ".join(positive(c, seed) for c in body) if kind == "all" else positive(body[seed % len(body)], seed)


def fitting(rule: Rule, tries: int = 100) -> str:
    """A text that the whole rule matches."""
    return next(t for t in (positive(rule.match, k) for k in range(tries)) if found(rule.match, t))


def near_miss(rule: Rule) -> str:
    """A text one letter or word away from one that matches, which does not."""
    text = fitting(rule)
    words = text.split(" ")
    tried = [" ".join([*words[:i], w[:1] + "q" + w[1:], *words[i + 1 :]]) for i, w in enumerate(words)]
    tried += [" ".join([*words[:i], *words[i + 1 :]]) for i in range(len(words))] + [text[: len(text) * k // 8] for k in (7, 6, 5, 4, 3, 2)]
    return next(t for t in [*tried, re.sub(r"\w", "q", text), "q"] if t.strip() and not found(rule.match, t))
