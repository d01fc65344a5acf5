"""Signature rules: a small match language compiled to Column expressions.

A rule tree (regex, all, any, not, near) becomes one expression that yields the span of its match, so a
whole rule set is evaluated in a single projection, without a join and without Python. Patterns follow
the Unicode-aware dialect ((?dU)); spans count code points from 0 and end one past the match.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import lru_cache
from pathlib import Path
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.columns import let
from quernstone.operators.rules.gate import gate

SEVERITIES = {"info": 10, "low": 20, "medium": 30, "high": 40, "critical": 50}
SCOPES = ("user", "system", "retrieved", "tool_result", "file")
#: How much a match counts by the view it was found in.
VIEW_CONFIDENCE = {"canonical": 1.0, "decoded": 0.9, "folded": 0.6}
OTHER_CONFIDENCE = 0.5
OPERATORS = ("regex", "all", "any", "not", "near")
# The longest pattern, and the shape of nested quantifiers.
LONGEST_PATTERN = 400
_NESTED = re.compile(r"\([^)]*[+*]\)[+*{]")
SHIPPED = Path(__file__).parent / "signatures.yaml"


class RuleError(ValueError):
    """A rule that cannot be compiled; names the rule."""


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    severity: str
    labels: tuple[str, ...]
    scope: tuple[str, ...]
    match: dict[str, Any]
    views: tuple[str, ...] = ("canonical",)
    weight: float = 0.5
    positive: tuple[str, ...] = field(default=())
    negative: tuple[str, ...] = field(default=())


def _checked(pattern: object, rule: str) -> str:
    if not isinstance(pattern, str):
        raise RuleError(f"{rule}: a pattern must be text, not {type(pattern).__name__}")
    if len(pattern) > LONGEST_PATTERN:
        raise RuleError(f"{rule}: a pattern has over {LONGEST_PATTERN} characters")
    if _NESTED.search(pattern):
        raise RuleError(f"{rule}: nested quantifiers may backtrack without end: {pattern!r}")
    try:
        re.compile(pattern)
    except re.error as e:
        raise RuleError(f"{rule}: {pattern!r} does not compile: {e}") from e
    return pattern


def check_node(node: object, rule: str) -> None:
    """Raise RuleError unless the node is a well-formed match tree."""
    if not isinstance(node, dict):
        raise RuleError(f"{rule}: a match node must be a mapping")
    kinds = [k for k in OPERATORS if k in node]
    if len(kinds) != 1:
        raise RuleError(f"{rule}: a match node needs exactly one of {', '.join(OPERATORS)}; it has {kinds or 'none'}")
    kind, body = kinds[0], node[kinds[0]]
    if kind == "regex":
        _checked(body, rule)
    elif kind in ("all", "any"):
        if not isinstance(body, list) or not body:
            raise RuleError(f"{rule}: {kind} needs a list that is not empty")
        for child in body:
            check_node(child, rule)
    elif kind == "not":
        check_node(body, rule)
    else:
        if not isinstance(body, dict) or "a" not in body or "b" not in body:
            raise RuleError(f"{rule}: near needs a and b")
        window = body.get("window", 40)
        if isinstance(window, bool) or not isinstance(window, int) or window <= 0:
            raise RuleError(f"{rule}: the window of near must be a positive whole number")
        _checked(body["a"], rule)
        _checked(body["b"], rule)


def parse_rule(raw: object, need_tests: bool = False) -> Rule:
    """One rule of a rule document."""
    if not isinstance(raw, dict):
        raise RuleError("a rule must be a mapping")
    name = str(raw.get("id", "?"))
    for key in ("id", "name", "severity", "labels", "scope", "match"):
        if key not in raw:
            raise RuleError(f"{name}: {key} is missing")
    if raw["severity"] not in SEVERITIES:
        raise RuleError(f"{name}: unknown severity {raw['severity']!r}")
    views, weight = tuple(raw.get("views") or ("canonical",)), float(raw.get("weight", 0.5))
    for kind, given, known in (("scope", raw["scope"], SCOPES), ("view", views, VIEW_CONFIDENCE)):
        for x in given:
            if x not in known:
                raise RuleError(f"{name}: unknown {kind} {x!r}")
    if not 0 < weight <= 1:
        raise RuleError(f"{name}: the weight must be above 0 and at most 1")
    tests = raw.get("tests") or {}
    if need_tests and not (tests.get("positive") and tests.get("negative")):
        raise RuleError(f"{name}: tests in both directions are required")
    check_node(raw["match"], name)
    return Rule(name, raw["name"], raw["severity"], tuple(raw["labels"]), tuple(raw["scope"]), raw["match"], views, weight, tuple(tests.get("positive", ())), tuple(tests.get("negative", ())))


def rules_from_text(text: str, need_tests: bool = False) -> list[Rule]:
    """The rules of a YAML document of version 1; ids must be unique."""
    document = yaml.safe_load(text)
    if not isinstance(document, dict) or document.get("version") != 1:
        raise RuleError("a rule document must have version 1")
    rules = [parse_rule(raw, need_tests) for raw in document.get("rules") or []]
    _unique(rules)
    return rules


def rules_from_dir(directory: str | Path, need_tests: bool = False) -> list[Rule]:
    """The rules of all YAML files of a folder, in the order of their names."""
    rules = [r for path in sorted(Path(directory).glob("*.yaml")) for r in rules_from_text(path.read_text(), need_tests)]
    _unique(rules)
    return rules


def _unique(rules: list[Rule]) -> None:
    ids = [r.id for r in rules]
    for x in ids:
        if ids.count(x) > 1:
            raise RuleError(f"{x}: the id occurs twice")


@lru_cache(maxsize=1)
def _shipped() -> tuple[Rule, ...]:
    return tuple(rules_from_text(SHIPPED.read_text(), True))


def shipped_rules() -> list[Rule]:
    return list(_shipped())


def rule_ids(rules: list[Rule] | None = None) -> list[str]:
    """The ids of a rule set, in its order; of the shipped one by default."""
    return [r.id for r in (shipped_rules() if rules is None else rules)]


def subset(rules: list[Rule], ids: set[str]) -> list[Rule]:
    return [r for r in rules if r.id in ids]


# -- compilation ---------------------------------------------------------------------------------


def _java(pattern: str) -> str:
    """The pattern in the Unicode-aware dialect of the JVM; long escapes are written as it wants them."""
    return "(?dU)" + re.sub(r"\\U([0-9A-Fa-f]{8})", lambda m: f"\\x{{{int(m.group(1), 16):X}}}", pattern)


def first_span(text: Column, pattern: str) -> Column:
    """Span of the first match, null without one."""
    p = _java(pattern)
    begin = F.length(F.element_at(F.split(text, p, 2), 1))
    made = let(begin, lambda b: F.struct(b.alias("s"), (b + F.length(F.regexp_extract(text, p, 0))).alias("e")))
    return F.when(text.rlike(p), made)


def all_spans(text: Column, pattern: str) -> Column:
    """Spans of all matches of a pattern that never matches nothing."""
    p = _java(pattern)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["g"])
        end = begin + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("s"), end.alias("e")))).alias("out"))

    found = F.regexp_extract_all(text, F.lit(p), F.lit(0))
    parts = let(found, lambda m: F.arrays_zip(F.slice(F.split(text, p, -1), 1, F.size(m)).alias("g"), m.alias("m")))
    return F.aggregate(parts, start, step, lambda acc: acc["out"])


def near_span(text: Column, a: str, b: str, window: int) -> Column:
    """The shortest span that holds a match of each pattern at most `window` characters apart; the first of equals."""
    pair = lambda x, y: F.struct(
        (F.greatest(x["e"], y["e"]) - F.least(x["s"], y["s"])).alias("len"),
        x["s"].alias("xs"),
        y["s"].alias("ys"),
        F.least(x["s"], y["s"]).alias("s"),
        F.greatest(x["e"], y["e"]).alias("e"),
        F.when(y["s"] >= x["e"], y["s"] - x["e"]).otherwise(x["s"] - y["e"]).alias("gap"),
    )
    right = all_spans(text, b)
    pairs = F.flatten(F.transform(all_spans(text, a), lambda x: F.transform(right, lambda y: pair(x, y))))
    best = F.array_min(F.filter(pairs, lambda z: z["gap"] <= window))
    made = let(best, lambda z: F.when(z.isNotNull(), F.struct(z["s"].alias("s"), z["e"].alias("e"))))
    return F.when(text.rlike(_java(a)) & text.rlike(_java(b)), made)


def span(text: Column, node: dict[str, Any]) -> Column:
    """Span of a match tree in a text, null where it does not match."""
    kind = next(k for k in OPERATORS if k in node)
    body = node[kind]
    if kind == "regex":
        return first_span(text, body)
    if kind == "near":
        return near_span(text, body["a"], body["b"], body.get("window", 40))
    if kind == "not":
        return F.when(span(text, body).isNull(), F.struct(F.lit(0).alias("s"), F.lit(0).alias("e")))
    children = [span(text, c) for c in body]
    if kind == "any" or len(children) == 1:
        return F.coalesce(*children)
    every = children[0].isNotNull()
    for c in children[1:]:
        every = every & c.isNotNull()
    return F.when(every, F.struct(F.least(*[c["s"] for c in children]).alias("s"), F.greatest(*[c["e"] for c in children]).alias("e")))


# -- whole rule sets as one expression -----------------------------------------------------------
# Thousands of nodes are faster written as text and parsed at once than built call by call.


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _spans_text(t: str, pattern: str) -> str:
    p = _literal(_java(pattern))
    parts = f"element_at(transform(array(regexp_extract_all({t}, {p}, 0)), m -> zip_with(slice(split({t}, {p}, -1), 1, size(m)), m, (g, k) -> named_struct('g', g, 'm', k))), 1)"
    step = "named_struct('at', acc.at + length(x.g) + length(x.m), 'out', concat(acc.out, array(named_struct('s', acc.at + length(x.g), 'e', acc.at + length(x.g) + length(x.m)))))"
    return f"aggregate({parts}, named_struct('at', 0, 'out', cast(array() AS array<struct<s:int,e:int>>)), (acc, x) -> {step}, acc -> acc.out)"


def span_text(t: str, node: dict[str, Any]) -> str:
    """The expression of `span` as text; t names the text."""
    kind = next(k for k in OPERATORS if k in node)
    body = node[kind]
    if kind == "regex":
        p = _literal(_java(body))
        made = f"element_at(transform(array(length(element_at(split({t}, {p}, 2), 1))), b -> named_struct('s', b, 'e', b + length(regexp_extract({t}, {p}, 0)))), 1)"
        return f"CASE WHEN {t} RLIKE {p} THEN {made} END"
    if kind == "near":
        a, b = body["a"], body["b"]
        pair = "named_struct('len', greatest(x.e, y.e) - least(x.s, y.s), 'xs', x.s, 'ys', y.s, 's', least(x.s, y.s), 'e', greatest(x.e, y.e), 'gap', CASE WHEN y.s >= x.e THEN y.s - x.e ELSE x.s - y.e END)"
        pairs = f"flatten(transform({_spans_text(t, a)}, x -> transform({_spans_text(t, b)}, y -> {pair})))"
        best = f"array_min(filter({pairs}, z -> z.gap <= {int(body.get('window', 40))}))"
        made = f"element_at(transform(array({best}), z -> CASE WHEN z IS NOT NULL THEN named_struct('s', z.s, 'e', z.e) END), 1)"
        return f"CASE WHEN {t} RLIKE {_literal(_java(a))} AND {t} RLIKE {_literal(_java(b))} THEN {made} END"
    if kind == "not":
        return f"CASE WHEN ({span_text(t, body)}) IS NULL THEN named_struct('s', 0, 'e', 0) END"
    children = [span_text(t, c) for c in body]
    if kind == "any" or len(children) == 1:
        return f"coalesce({', '.join(children)})"
    every = f"array({', '.join(children)})"
    extent = "named_struct('s', array_min(transform(c, y -> y.s)), 'e', array_max(transform(c, y -> y.e)))"
    return f"element_at(transform(array({every}), c -> CASE WHEN NOT exists(c, y -> y IS NULL) THEN {extent} END), 1)"


MATCH_SCHEMA = "array<struct<rule:string,severity:string,labels:array<string>,weight:double,s:int,e:int>>"


def view_matches(rules: list[Rule], text: str, kind: str, scope: str, gate: str | None = None) -> Column:
    """The rules that match a view of this kind in this scope: an array in rule order."""
    return F.expr(matches_text(rules, text, kind, scope, gate))


def matches_text(rules: list[Rule], text: str, kind: str, scope: str, gate: str | None = None) -> str:
    """The expression of view_matches as text.

    Text, kind, scope and gate are expressions (usually names of columns). The span is computed only for
    rules that scope, view and gate (numbers of the rules that may match at all) let through.
    """
    found = []
    quoted = lambda names: ", ".join(map(_literal, names))
    for k, r in enumerate(rules):
        weights = " ".join(f"WHEN {_literal(v)} THEN {round(r.weight * c, 4)}D" for v, c in VIEW_CONFIDENCE.items())
        weight = f"CASE {kind} {weights} ELSE {round(r.weight * OTHER_CONFIDENCE, 4)}D END"
        value = f"named_struct('rule', {_literal(r.id)}, 'severity', {_literal(r.severity)}, 'labels', array({quoted(r.labels)}), 'weight', {weight}, 's', x.s, 'e', x.e)"
        allowed = f"{scope} IN ({quoted(r.scope)}) AND {kind} IN ({quoted(r.views)})"
        if gate:
            allowed = f"array_contains({gate}, {k}) AND {allowed}"
        found.append(f"CASE WHEN {allowed} THEN transform(filter(array({span_text(text, r.match)}), x -> x IS NOT NULL), x -> {value}) END")
    every = ", ".join(found) or f"cast(NULL AS {MATCH_SCHEMA})"
    return f"flatten(filter(array({every}), x -> x IS NOT NULL))"


def noisy_or(weights: Column) -> Column:
    """1 - product of (1 - weight), each weight kept below 1."""
    rest = F.aggregate(weights, F.lit(1.0), lambda acc, w: acc * (1 - F.least(F.greatest(w, F.lit(0.0)), F.lit(0.999))))
    return F.round(1 - rest, 6)


def label_set(labels: Column) -> Column:
    """Sorted distinct labels of an array of label lists."""
    return F.array_sort(F.array_distinct(F.flatten(labels)))


def gate_column(rules: list[Rule], text: Column) -> Column:
    """Numbers of the rules that a text may match at all."""
    trees = [r.match for r in rules]

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        may = gate(trees)
        return pd.Series([may(t) if t is not None else [] for t in texts], dtype=object)

    return run.asNondeterministic()(text)


def scan_texts(df: DataFrame, rules: list[Rule], id_col: str, text_col: str, scope: str | Column = "user", gated: bool = True) -> DataFrame:
    """(id, rule, severity, labels, weight, s, e): matches in the text as it stands (its canonical view)."""
    used = [r for r in rules if scope in r.scope] if isinstance(scope, str) else rules
    shaped = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"), (F.lit(scope) if isinstance(scope, str) else scope).alias("_scope"))
    if gated:
        shaped = shaped.withColumn("_gate", gate_column(used, F.col("_text")))
    found = view_matches(used, "_text", "'canonical'", "_scope", "_gate" if gated else None)
    # an inner explode would make the optimiser filter on the whole expression first, and so compute it twice
    return shaped.select("id", F.explode_outer(found).alias("m")).where("m IS NOT NULL").select("id", "m.*")


def report_matches(rules: list[Rule], views: str, scope: str) -> Column:
    """Matches over all views of a report, heaviest first: of each rule the first view that fires, with its span in the original text.

    One expression within the row: no view is exploded, shuffled or joined.
    """
    origin = "element_at(transform(array(slice(v.origins, m.s + 1, greatest(m.e - m.s, 1))), p -> named_struct('s', array_min(p), 'e', array_max(p) + 1)), 1)"
    at = f"CASE WHEN v.origins IS NULL THEN named_struct('s', m.s, 'e', greatest(m.e, m.s + 1)) WHEN size(v.origins) = 0 THEN named_struct('s', 0, 'e', 0) ELSE {origin} END"
    made = f"named_struct('rule', m.rule, 'ord', ord, 'severity', m.severity, 'labels', m.labels, 'weight', m.weight, 'view', v.kind, 'provenance', v.provenance, 'at', {at})"
    every = f"array_sort(flatten(transform({views}, (v, ord) -> transform({matches_text(rules, 'v.text', 'v.kind', scope, 'v.gate')}, m -> {made}))))"
    first = f"element_at(transform(array({every}), o -> filter(o, (x, i) -> i = 0 OR element_at(o, greatest(i, 1)).rule <> x.rule)), 1)"
    return F.expr(f"transform(array_sort(transform({first}, x -> named_struct('w', -x.weight, 'rule', x.rule, 'x', x))), x -> x.x)")


def explained(matches: Column, text: Column, rules: list[Rule] | None = None) -> Column:
    """Matches of a report with the name of the rule, the matched text (up to 200 characters) and why it counts."""
    names = {r.id: r.name for r in (shipped_rules() if rules is None else rules)}
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else F.create_map(F.lit(""), F.lit(""))

    def one(m: Column) -> Column:
        name = F.try_element_at(table, m["rule"])
        source = F.when(m["provenance"].isNotNull(), F.concat(F.lit(": "), m["provenance"])).otherwise(F.lit(""))
        where = F.when(m["view"] == "canonical", F.lit("")).otherwise(F.concat(F.lit(" in the "), m["view"], F.lit(" view"), source))
        held = F.substring(text, m["at"]["s"] + 1, F.least(m["at"]["e"] - m["at"]["s"], F.lit(200)))
        return m.withField("name", name).withField("text", held).withField("rationale", F.concat(m["rule"], F.lit(", "), F.coalesce(name, F.lit("?")), F.lit(", fires"), where))

    return F.transform(matches, one)


# -- the same in SQL, for the check of ASCII texts -----------------------------------------------


def _quoted(pattern: str) -> str:
    return "'" + re.sub(r"\\U([0-9A-Fa-f]{8})", lambda m: f"\\x{{{int(m.group(1), 16):X}}}", pattern).replace("'", "''") + "'"


def _sql_spans(text: str, pattern: str) -> str:
    p = _quoted(pattern)
    g, m = f"string_split_regex({text}, {p})", f"regexp_extract_all({text}, {p})"
    before = f"coalesce(list_sum(list_transform(({g})[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(({m})[1:i-1], lambda x: length(x))), 0)"
    return f"list_transform(range(1, len({m}) + 1), lambda i: {{'s': {before}, 'e': {before} + length(({m})[i])}})"


def sql_condition(text: str, node: dict[str, Any]) -> str:
    """Whether a match tree matches, as SQL over an ASCII text."""
    kind = next(k for k in OPERATORS if k in node)
    body = node[kind]
    if kind == "regex":
        return f"regexp_matches({text}, {_quoted(body)})"
    if kind == "not":
        return f"NOT {sql_condition(text, body)}"
    if kind == "near":
        a, b, w = _quoted(body["a"]), _quoted(body["b"]), body.get("window", 40)
        gap = "CASE WHEN y.s >= x.e THEN y.s - x.e ELSE x.s - y.e END"
        some = f"len(list_filter(flatten(list_transform({_sql_spans(text, body['a'])}, lambda x: list_transform({_sql_spans(text, body['b'])}, lambda y: {gap}))), lambda d: d <= {w})) > 0"
        return f"CASE WHEN regexp_matches({text}, {a}) AND regexp_matches({text}, {b}) THEN {some} ELSE false END"
    return "(" + (" OR " if kind == "any" else " AND ").join(sql_condition(text, c) for c in body) + ")"
