"""Problem 5: one form for texts that look the same but consist of other characters.

A text is brought to compatibility form, ignorable characters are deleted, and each run of letters
becomes a lattice: every letter that has look-alikes in other alphabets stands for all of them. Viterbi
picks the path with the best score of a model of adjacent letters per script, counted over all texts, at a
price for each change of script and a bonus for the script of the text, which is that of most of its
letters without look-alikes. Neither lattice nor bonus depend on which of the look-alikes was written, so
all disguises of a word come out the same. Accents stay on the letter they belong to.

Letter case, missing accents, punctuation and ordinary white space are kept. Null stays null, an empty
text stays empty; texts of any length are processed whole. A blank text matches nothing.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.kernels import code_points
from quernstone.plans.runtime import materialise, text_slices

#: Fixed values, from the public list of confusable characters: letters that look the same, as Latin,
#: Cyrillic, Greek ("-": none), then those of Armenian, Cherokee, Coptic and Lisu, small capitals and letters
#: with another dot or hook.
LOOKALIKES = """
a а - ɑ
b - - Ꮟ
c с - ϲ ᴄ ⲥ
d ԁ - ꓒ
e е - ҽ
g - - ɡ ց
h һ - հ Ꮒ
i і - ı ɩ ɪ Ꭵ
j ј - ϳ ȷ
l ӏ - ⅼ
n - - ո
o о ο օ ᴏ ⲟ
p р ρ ⲣ
q ԛ - զ
r г - ʀ
s ѕ - ꜱ
u - υ ս ᴜ ʋ
v ѵ ν ᴠ
w ԝ - ᴡ
x х - ⲭ
y у - ყ
z - - ᴢ
A А Α Ꭺ ꓮ Ⲁ
B В Β Ᏼ ꓐ Ⲃ
C С - Ϲ Ꮯ ꓚ Ⲥ
D - - Ꭰ ꓓ
E Е Ε Ꭼ ꓰ Ⲉ
F - - Ϝ ꓝ
G Ԍ - Ꮐ ꓖ
H Н Η Ꮋ ꓧ Ⲏ
I І Ι Ӏ ꓲ Ⲓ
J Ј - Ϳ Ꭻ ꓙ
K К Κ Ꮶ ꓗ Ⲕ
L - - Ꮮ ꓡ Լ
M М Μ Ꮇ ꓟ Ⲙ
N - Ν ꓠ Ⲛ
O О Ο Օ ꓳ Ⲟ
P Р Ρ Ꮲ ꓑ Ⲣ
Q Ԛ -
R - - Ꭱ Ꮢ ꓣ
S Ѕ - Տ Ꮪ Ꮥ ꓢ
T Т Τ Ꭲ ꓔ Ⲧ
U - - Ս ꓴ
V Ѵ - Ꮩ ꓦ
W Ԝ - Ꮤ Ꮃ ꓪ
X Х Χ ꓫ Ⲭ
Y Ү Υ Ꭹ ꓬ
Z - Ζ Ꮓ ꓜ
"""
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")
#: What a change of script within a word costs, and what the script of the text saves, in units of ln of a letter's share.
SWITCH, OWN_SCRIPT = 20.0, 8.0
IGNORABLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff]")
_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")
_ALPHABET = 0x600


@lru_cache(maxsize=1)
def lattice() -> dict[str, tuple[str | None, ...]]:
    """For each letter with look-alikes, the letter in each script."""
    out = {}
    for line in LOOKALIKES.split("\n"):
        row = line.split()
        if row:
            choice = tuple(None if c == "-" else c for c in row[:3])
            for c in row:
                if c != "-":
                    out[c] = choice
    return out


@lru_cache(maxsize=1)
def letter_index() -> np.ndarray:
    """Code points below U+0600 by their base letter: 0 for what is no Latin, Cyrillic or Greek letter."""
    table = np.zeros(_ALPHABET, np.int64)
    for c in range(_ALPHABET):
        base = unicodedata.normalize("NFD", chr(c))[0]
        if base.isalpha() and script_of(base) >= 0 and ord(base) < _ALPHABET:
            table[c] = ord(base)
    return table


@lru_cache(maxsize=8192)
def script_of(c: str) -> int:
    """The number of the letter's script, -1 for another."""
    name = unicodedata.name(c, "?").split()[0]
    return SCRIPTS.index(name) if name in SCRIPTS else -1


class LetterModel:
    """Scores of adjacent letters; None stands for the edge of a word."""

    def __init__(self, counts: dict[tuple[int, int], int] | None = None):
        self.counts = counts or {}
        self.totals: dict[int, int] = {}
        for (a, _), n in self.counts.items():
            self.totals[a] = self.totals.get(a, 0) + n

    def score(self, a: str | None, b: str | None) -> float:
        x, y = ord(a) if a else 0, ord(b) if b else 0
        return float(np.log((self.counts.get((x, y), 0) + 0.5) / (self.totals.get(x, 0) + 500)))

    def best(self, choices: list[tuple[str | None, ...]], own: int = -1) -> list[str]:
        """Viterbi over letters with a choice in each script; `own` is the script of the text."""
        paths: dict[int, tuple[float, list[str], str | None]] = {-1: (0.0, [], None)}
        for options in choices:
            after = {}
            for s, c in enumerate(options):
                if c is None:
                    continue
                best = None
                for before, (cost, path, last) in paths.items():
                    step = cost - self.score(last, c) if before == s else cost - self.score(None, c) + (SWITCH if before >= 0 else -OWN_SCRIPT if s == own else 0.0)
                    if best is None or step < best[0]:
                        best = step, path, c
                after[s] = best[0], [*best[1], c], c
            paths = after
        return min((cost - self.score(last, None), s, path) for s, (cost, path, last) in paths.items())[2]


class Canonical:
    """Brings texts to the consistent form; remembers words."""

    def __init__(self, model: LetterModel):
        self.model = model
        self.known: dict[tuple[str, int], str] = {}

    def word(self, token: str, own: int = -1) -> str:
        table = lattice()
        parts = unicodedata.normalize("NFD", token)
        if not any(c in table for c in parts):
            return token
        choices, where = [], []
        for i, c in enumerate(parts):
            if c in table:
                choices.append(table[c])
                where.append(i)
            elif (s := script_of(c)) >= 0 and not unicodedata.combining(c):
                choices.append(tuple(c if k == s else None for k in range(3)))
                where.append(i)
        fixed = {k for options in choices if sum(o is not None for o in options) == 1 for k, o in enumerate(options) if o is not None}
        only = next(iter(fixed)) if len(fixed) == 1 else None
        if only is not None and all(options[only] is not None for options in choices):
            path = [options[only] for options in choices]
        else:
            path = self.model.best(choices, own)
        out = list(parts)
        for i, c in zip(where, path):
            out[i] = c
        return unicodedata.normalize("NFC", "".join(out))

    def text(self, text: str) -> str:
        if not text.isascii():
            text = IGNORABLE.sub("", unicodedata.normalize("NFKC", IGNORABLE.sub("", text)))
        own = text_script(text)

        def replace(match: re.Match) -> str:
            key = match.group(), own
            found = self.known.get(key)
            if found is None:
                if len(self.known) > 500_000:
                    self.known.clear()
                found = self.known[key] = self.word(*key)
            return found

        return _TOKEN.sub(replace, text)


def text_script(text: str) -> int:
    """The script of most letters that have no look-alikes, -1 without any."""
    if text.isascii():
        return 0 if _PLAIN.search(text) else -1
    counts = [len(p.findall(text)) for p in _own_letters()]
    return counts.index(max(counts)) if any(counts) else -1


@lru_cache(maxsize=1)
def _own_letters() -> list[re.Pattern[str]]:
    """For each script, a pattern of its letters that have no look-alikes."""
    table = lattice()
    letters = [[chr(c) for c in range(0x41, 0x530) if chr(c).isalpha() and script_of(chr(c)) == k and unicodedata.normalize("NFD", chr(c))[0] not in table] for k in range(len(SCRIPTS))]
    return [re.compile("[" + "".join(own) + "]") for own in letters]


_PLAIN = re.compile("[" + "".join(c for c in map(chr, range(65, 123)) if c.isalpha() and c not in lattice()) + "]")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.concatenate([letter_index(), [0]])
    counts = np.zeros(_ALPHABET * _ALPHABET, np.int64)
    scripts = np.array([script_of(chr(c)) if c else -1 for c in range(_ALPHABET)])
    for whole in batches:
        for batch in text_slices(whole, "text"):
            codes, starts = code_points([(t or "") + "\n" for t in batch.column("text").to_pylist()])
            letters = table[np.minimum(codes, _ALPHABET)]
            a, b = np.concatenate([[0], letters[:-1]]), letters
            good = ((a == 0) | (b == 0) | (scripts[a] == scripts[b])) & ((a > 0) | (b > 0))
            found, n = np.unique(a[good] * _ALPHABET + b[good], return_counts=True)
            counts[found] += n
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], ["pair", "n"])


def letter_model(texts: DataFrame) -> LetterModel:
    """The model of adjacent letters over all texts (column text); at most (letters + 1)**2 rows reach the driver."""
    rows = texts.mapInArrow(_pairs, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return LetterModel({divmod(r.pair, _ALPHABET): r.n for r in rows})


def _canonical(model: LetterModel, keys_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = Canonical(model)
        digest = lambda t: hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            forms = [None if t is None else canonical.text(t) for t in texts]
            if keys_only:
                seen = pa.array([bool(f) and not f.isspace() for f in forms])
                keys = [pa.array([digest(t or "") for t in column], pa.binary()) for column in (forms, texts)]
                yield pa.RecordBatch.from_arrays([batch.column("id"), *keys], ["id", "form", "own"]).filter(seen)
            else:
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(forms, pa.string())], ["id", "form"])

    return run


def consistent_texts(rows: DataFrame, id_col: str, text_col: str, model: LetterModel | None = None) -> DataFrame:
    """(id, form) of every row."""
    source = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = model or letter_model(source.select("text"))
    return source.mapInArrow(_canonical(model, False), f"id {source.schema['id'].dataType.simpleString()}, form string")


def _forms(rows: DataFrame, id_col: str, text_col: str, model: LetterModel, label: str) -> DataFrame:
    source = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    keys = source.mapInArrow(_canonical(model, True), f"id {source.schema['id'].dataType.simpleString()}, form binary, own binary")
    return materialise(keys, label)


def lookalike_pairs(forms: DataFrame) -> DataFrame:
    """(id_a, id_b) of the rows (id, form, own) with the same form but another text.

    Rows with equal texts are one class until the end, so that copies are not compared with each other.
    """
    torn = forms.groupBy("form").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select("form")
    members = materialise(forms.join(torn, "form", "left_semi"), "members")
    classes = members.select("form", "own").distinct()
    pairs = classes.alias("x").join(classes.alias("y"), "form").where("x.own < y.own").select("form", F.col("x.own").alias("own_x"), F.col("y.own").alias("own_y"))
    left = members.select("form", F.col("own").alias("own_x"), F.col("id").alias("x"))
    right = members.select("form", F.col("own").alias("own_y"), F.col("id").alias("y"))
    both = pairs.join(left, ["form", "own_x"]).join(right, ["form", "own_y"]).where("x <> y")
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def disguised_pairs(index_entries: DataFrame, detect_requests: DataFrame, corpus_rows: DataFrame) -> DataFrame:
    """(id_a, id_b): index entries with requests that show them, and corpus rows that look alike."""
    texts = index_entries.select("text").unionByName(detect_requests.select("text")).unionByName(corpus_rows.select("text"))
    model = letter_model(texts)
    known = _forms(index_entries, "id", "text", model, "known")
    asked = _forms(detect_requests, "request_id", "text", model, "asked").select(F.col("id").alias("request"), "form", F.col("own").alias("other"))
    shown = known.join(asked, "form").where("own <> other").select(F.least("id", "request").alias("id_a"), F.greatest("id", "request").alias("id_b")).distinct()
    return shown.unionByName(lookalike_pairs(_forms(corpus_rows, "id", "text", model, "rows")))
