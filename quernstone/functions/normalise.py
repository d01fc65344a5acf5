"""Normalisation of hostile text: views of one text with a way back to its own positions.

Single transforms are Column functions. The full report needs compatibility forms of single characters,
which Spark lacks, so it is one Arrow function; printable ASCII text takes a path that only folds and
looks for encoded blobs.

Null texts give a null report. Texts are truncated to 200,000 characters and marked. Lone surrogates
cannot occur in Spark strings.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions import decoding

MAX_CHARS = 200_000

# Characters that are removed, and characters that stand for others.
ZERO_WIDTH = "​‌‍﻿⁠­᠎͏"
BIDI = "‪‫‬‭‮⁦⁧⁨⁩‎‏؜"
CONFUSABLE_FROM = "аАеЕоОрРсСуУхХіІјЈѕЅһНԁԒԛԝВКМТгбӏ" + "αΑεΕοΟρΡιΙκΚνΝτΤυΥχΧβΒΖΗΜσϲϹ" + "ıȷℓǀⱪɡɩɪʀʋᴠᴡոօᎠᏞ"
CONFUSABLE_TO = "aAeEoOpPcCyYxXiIjJsShHdRqwBKMTrbl" + "aAeEoOpPiIkKvNtTuYxXBBZHMocC" + "ijllkgiiRvVWnoDL"
LEET_FROM = "013457@$!+|("
LEET_TO = "oieastasitlc"
#: Letters set apart by white space, four or more, at word edges.
SPACED = r"(?:(?<=\s)|\A)(?:[A-Za-z]\s+){3,}[A-Za-z](?=\s|\Z)"

_SPACED = re.compile(SPACED)
_APART = re.compile(r"[A-Za-z]\s+[A-Za-z]\s+[A-Za-z]\s")
_FOLD = dict(zip(map(ord, CONFUSABLE_FROM), CONFUSABLE_TO))
_LEET = str.maketrans(LEET_FROM, LEET_TO)
_DROPPED = {c: "zero_width" for c in ZERO_WIDTH} | {c: "bidi" for c in BIDI}


# -- single transforms ---------------------------------------------------------------------------


def truncated(text: Column, limit: int = MAX_CHARS) -> Column:
    return F.substring(text, 1, limit)


def is_truncated(text: Column, limit: int = MAX_CHARS) -> Column:
    return F.length(text) > limit


def printable_ascii(text: Column) -> Column:
    """Whether no canonical transform can apply: only characters from space to tilde."""
    return text.rlike(r"^[\x20-\x7E]*\z")


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def strip_zero_width(text: Column) -> Column:
    return without(text, ZERO_WIDTH)


def strip_bidi(text: Column) -> Column:
    return without(text, BIDI)


def removed_count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(without(text, characters))


def fold_confusables(text: Column) -> Column:
    return F.translate(text, CONFUSABLE_FROM, CONFUSABLE_TO)


def fold_leet(text: Column) -> Column:
    return F.translate(text, LEET_FROM, LEET_TO)


def collapse_spaced(text: Column) -> Column:
    """Join letters that are set apart by white space."""
    pattern = "(?dU)" + SPACED
    between, runs = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    joined = F.transform(runs, lambda r: F.regexp_replace(r, r"(?U)\s+", ""))
    pieces = F.zip_with(between, joined, lambda g, r: F.concat(g, F.coalesce(r, F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(pieces, "")).otherwise(text)


def folded_view(canonical: Column) -> Column:
    """Leet and spaced letters folded; null where that changes nothing."""
    out = collapse_spaced(fold_leet(canonical))
    return F.when(out != canonical, out)


def obfuscation(depth: Column, capped: Column, zero_width: Column, bidi: Column, rewrites: Column, length: Column) -> Column:
    """How hard the text resisted reading, from 0 to 1."""
    score = (
        F.least(depth, F.lit(3)) * 0.22
        + F.when(capped, 0.15).otherwise(0.0)
        + F.when(zero_width, 0.20).otherwise(0.0)
        + F.when(bidi, 0.25).otherwise(0.0)
        + F.least(rewrites / F.greatest(length, F.lit(1)), F.lit(0.3)) * 0.6
    )
    return F.when(length == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def original_span(origins: Column, s: Column, e: Column, length: Column) -> Column:
    """Positions in the original text of a span of a view; a null map means the same positions."""
    size = F.coalesce(F.size(origins), length)
    s, e = F.least(F.greatest(s, F.lit(0)), size - 1), F.least(F.greatest(e, F.lit(0)), size)
    part = F.slice(origins, s + 1, F.greatest(e - s, F.lit(1)))
    there = F.struct(F.array_min(part).alias("s"), (F.array_max(part) + 1).alias("e"))
    return F.when(size <= 0, F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"))).when(origins.isNull(), F.struct(s.alias("s"), F.greatest(e, s + 1).alias("e"))).otherwise(there)


# -- the full report -----------------------------------------------------------------------------

REPORT = (
    "struct<length:int,truncated:boolean,max_depth:int,capped:boolean,zero_width:int,bidi:int,nfkc:int,confusable:int,score:double,"
    "views:array<struct<kind:string,text:string,depth:int,provenance:string,origins:array<int>,gate:array<int>>>>"
)


@lru_cache(maxsize=1)
def _changing() -> tuple[re.Pattern[str], dict[str, str]]:
    """A pattern of the characters that canonical form changes, and the compatibility forms of those that have one."""
    wide, runs = {}, []
    for n in range(0x80, 0x110000):
        c = chr(n)
        if 0xD800 <= n < 0xE000 or 0x3400 <= n < 0xA000 or 0xAC00 <= n < 0xD7A4 or 0x20000 <= n < 0x2F800:
            continue
        form = unicodedata.normalize("NFKC", c)
        if form != c:
            wide[c] = form
        if form != c or c in _DROPPED or n in _FOLD:
            if runs and runs[-1][1] == n - 1:
                runs[-1][1] = n
            else:
                runs.append([n, n])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]"), wide


def _canonical(text: str) -> tuple[str, list[int] | None, dict[str, int]]:
    """Canonical text, origins of its characters (None where they are its own positions) and what was changed."""
    counts = {"zero_width": 0, "bidi": 0, "nfkc": 0, "confusable": 0}
    pattern, wide = _changing()
    parts: list[str] = []
    places: list[np.ndarray] = []
    at, moved = 0, False
    for m in pattern.finditer(text):
        i, c = m.start(), m.group()
        parts.append(text[at:i])
        places.append(np.arange(at, i, dtype=np.int32))
        at = i + 1
        dropped = _DROPPED.get(c)
        if dropped:
            counts[dropped] += 1
            moved = True
            continue
        form = wide.get(c, c)
        counts["nfkc"] += form != c
        out = [(_FOLD.get(ord(x)), x) for x in form if x not in _DROPPED]
        counts["confusable"] += sum(y is not None for y, _ in out)
        parts.append("".join(y or x for y, x in out))
        places.append(np.full(len(out), i, np.int32))
        moved |= len(out) != 1
    if not parts:
        return text, None, counts
    parts.append(text[at:])
    places.append(np.arange(at, len(text), dtype=np.int32))
    return "".join(parts), np.concatenate(places).tolist() if moved else None, counts


def _folded(text: str, origins: list[int] | None) -> tuple[str, list[int] | None] | None:
    leet = text.translate(_LEET)
    runs = list(_SPACED.finditer(leet)) if _APART.search(leet) else []
    if leet == text and not runs:
        return None
    drop = {i for m in runs for i in range(m.start(), m.end()) if leet[i].isspace()}
    if not drop:
        return leet, origins
    kept = [i for i in range(len(leet)) if i not in drop]
    out = "".join([leet[i] for i in kept])
    if out == text:
        return None
    return out, [origins[i] for i in kept] if origins else kept


def report(text: str | None, decode: bool = True, fold: bool = True, max_chars: int = MAX_CHARS, max_depth: int = decoding.MAX_DEPTH) -> dict | None:
    """The normalisation report of one text; origins of a view are null where they are its own positions."""
    if text is None:
        return None
    long = len(text) > max_chars
    text = text[:max_chars]
    if text.isascii():
        canonical, origins, counts = text, None, {"zero_width": 0, "bidi": 0, "nfkc": 0, "confusable": 0}
    else:
        canonical, origins, counts = _canonical(text)
    views = [{"kind": "canonical", "text": canonical, "depth": 0, "provenance": None, "origins": origins}]
    if fold and (view := _folded(canonical, origins)):
        views.append({"kind": "folded", "text": view[0], "depth": 0, "provenance": "leet+spaced", "origins": view[1]})
    depth, capped = 0, False
    if decode:
        found, capped = decoding.layered(canonical, max_depth)
        place = origins if origins is not None else range(len(canonical))
        for d in found:
            low = place[d.start] if d.start < len(place) else 0
            high = place[min(d.end, len(place)) - 1] if len(place) else 0
            depth = max(depth, d.depth)
            views.append({"kind": "decoded", "text": d.text, "depth": d.depth, "provenance": f"{d.scheme}@[{low}:{high + 1}]", "origins": [min(low, high)] * len(d.text)})
    length = len(text)
    score = 0.0
    if length:
        rewrites = counts["nfkc"] + counts["confusable"]
        score = min(depth, 3) * 0.22 + 0.15 * capped + 0.20 * (counts["zero_width"] > 0) + 0.25 * (counts["bidi"] > 0) + 0.6 * min(rewrites / length, 0.3)
    return {"length": length, "truncated": long, "max_depth": depth, "capped": capped, **counts, "score": max(0.0, min(1.0, score)), "views": views}


def normalise(df: DataFrame, text_col: str, out: str = "l0", decode: bool = True, fold: bool = True, max_chars: int = MAX_CHARS, max_depth: int = decoding.MAX_DEPTH, gate: Callable[[], Callable[[str], list[int]]] | None = None) -> DataFrame:
    """df with the report as a struct column; with a gate (made once a batch) each view says which rules it may match."""

    @F.pandas_udf(REPORT)
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [report(t or "", decode, fold, max_chars, max_depth) for t in texts]
        may = gate() if gate else None
        for r in rows:
            for v in r["views"]:
                v["gate"] = may(v["text"]) if may else None
        return pd.DataFrame(rows, columns=["length", "truncated", "max_depth", "capped", "zero_width", "bidi", "nfkc", "confusable", "score", "views"])

    # marked so that no filter inferred from a later explode runs it a second time
    once = run.asNondeterministic()
    return df.withColumn(out, F.when(F.col(text_col).isNotNull(), once(F.col(text_col))))


def views(df: DataFrame, id_col: str, report_col: str = "l0") -> DataFrame:
    """One row per view: (id, ord, kind, text, depth, provenance, origins)."""
    return df.select(F.col(id_col).alias("id"), F.posexplode(F.col(f"{report_col}.views")).alias("ord", "v")).select("id", "ord", "v.*").drop("gate")


def views_of(report_col: Column, kind: str) -> Column:
    """The views of one kind, in their order."""
    return F.filter(report_col["views"], lambda v: v["kind"] == kind)


def view_of(report_col: Column, kind: str) -> Column:
    """The first view of a kind, null without one."""
    return F.try_element_at(views_of(report_col, kind), F.lit(1))


def canonical_text(report_col: Column) -> Column:
    return view_of(report_col, "canonical")["text"]


def without_quotations(text: Column) -> Column:
    """Prose without code blocks, code spans and quotations of up to 400 characters, each replaced by a blank."""
    # fixed values: the shapes of all three
    for pattern in (r"(?s)```.*?```", r"`[^`]*`", r'"[^"]{0,400}"'):
        text = F.regexp_replace(text, pattern, " ")
    return text
