"""Problem 9: text that was stored in one encoding and read in another.

For every pair of a true and a wrong encoding the garbled form of each plausible character (multi-byte
encodings) or pair of letters (single-byte encodings) is computed beforehand, and one automaton finds
all of them in a single pass over the text. Only matched spans are replaced; correct text around them
stays as it is. Passes repeat until they find nothing, so that text garbled several times is restored too.
Japanese that was Shift-JIS or EUC-JP is looked for first, stretch by stretch, since its bytes form
sequences of UTF-8 by chance.

A match counts only where it is no ordinary text: forms that consist of letters of one alphabet need a
neighbour that matches as well or a place where such letters cannot stand (a capital after a small letter,
an opening quotation mark inside a word); single-byte forms need whole words of them in a consistent letter
case. Which single-byte pair a word was garbled by is settled stretch by stretch: Viterbi over the words,
by the frequency of the letters that each pair gives, at a price for every change of pair.
Lost characters (U+FFFD) mark a text as damaged; they cannot be restored.

Null and empty texts are intact. Texts of any length are read whole. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encodings that UTF-8 is taken for, most frequent first.
WRONG = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp850", "cp437", "cp1250", "cp1253", "koi8-r", "cp866", "mac_cyrillic", "iso8859-2", "iso8859-5", "iso8859-7", "iso8859-15", "cp1254", "cp1257", "cp852")
#: Of them, those in which ideographs are looked for.
WIDE = ("cp1252", "latin-1", "mac_roman", "cp850", "cp437")
#: Single-byte pairs whose true text is Cyrillic or Greek, read as Latin.
#: Hebrew, Arabic and Thai, too; and Cyrillic encodings taken for each other, which turns the letter case round.
LETTERWISE = (("cp1255", "cp1252"), ("cp1256", "cp1252"), ("cp874", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp1251", "cp1252"), ("cp1253", "cp1252"), ("koi8-r", "cp1252"), ("iso8859-5", "cp1252"), ("cp866", "cp1252"), ("mac_cyrillic", "cp1252"), ("cp1251", "mac_roman"), ("cp1253", "mac_roman"), ("cp1251", "cp850"), ("cp866", "cp850"), ("koi8-r", "cp850"), ("cp1251", "cp437"), ("cp866", "cp437"))
#: Alphabets by their encodings, Cyrillic where none is named.
ALPHABET_OF = {"cp1253": "GREEK", "cp1255": "HEBREW", "cp1256": "ARABIC", "cp874": "THAI"}
#: Single-byte pairs of Latin alphabets: true, wrong.
LATIN_PAIRS = (("iso8859-2", "latin-1"), ("cp1250", "cp1252"), ("cp1250", "latin-1"), ("mac_roman", "cp1252"), ("cp850", "cp1252"), ("cp437", "cp1252"), ("cp1252", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "cp437"))
#: Encodings of Japanese that are read as latin-1 or cp1252, each with the shape of a character.
JAPANESE = {"cp932": r"[\x81-\x9f\xe0-\xfc][@-~\x80-\xfc]|[\xa1-\xdf]", "euc_jp": r"[\xa1-\xfe]{2}|\x8e[\xa1-\xdf]|\x8f[\xa1-\xfe]{2}"}
#: Letters of the languages in question beyond ASCII.
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœąćęłńóśźżčďěňřšťůž"
PUNCTUATION = "‘’“”–—…€™‚„•«»°£¥§©®±½¼¾·¿¡\xa0"
#: How frequent the letters of the alphabets are, most frequent first.
FREQUENT = {
    "CYRILLIC": "оеаинтсрвлкмдпуяыьгзбчйхжшюцщэфъё",
    "GREEK": "αοιετσνηυρπκμλςίόάγέδήωχθύφβξζώψϊϋΐΰ",
    "HEBREW": "יוהלאתשרבמנדחקפעטכסגזצםןךףץ",
    "ARABIC": "اليمنرتوبةعدسفهكقأحجشطصخإذىضءثزغئظؤآ",
    "THAI": "านรกอเงมยลวดทสตะปบคหแจพชขใไโผณซถฟศธภษฉฐญฝิ่้ีั็์ุูืึำๆ",
}
#: Letters of cp1252 that no language writes after a capital with an accent; they are the second bytes of UTF-8.
NEVER_SECOND = "ƒˆŠŒŽšœžŸªµº"
OPENING, CLOSING = "“‘«‚„", "”’»–—"
#: What a change of the pair costs, and each letter that a pair does not explain, against ln(2 + rank) of a letter.
CHANGE, UNEXPLAINED = 6.0, 6.0
#: What a capital after the first letter costs, and a word in a letter case that words do not have.
CAPITAL, ODD_CASE = 0.7, 3.0


def read_as(data: bytes, encoding: str) -> str:
    """Bytes read in an encoding; bytes that it leaves open become control characters."""
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        out = []
        for b in data:
            try:
                out.append(bytes([b]).decode(encoding))
            except UnicodeDecodeError:
                if 0x80 <= b < 0xA0:
                    out.append(chr(b))
                else:
                    raise
        return "".join(out)


def stored_in(text: str, encoding: str) -> bytes | None:
    """The inverse of read_as."""
    out = bytearray()
    for c in text:
        try:
            out += c.encode(encoding)
        except UnicodeEncodeError:
            if not 0x80 <= ord(c) < 0xA0:
                return None
            out.append(ord(c))
    return bytes(out)


@lru_cache(maxsize=4096)
def script(c: str) -> str:
    return unicodedata.name(c, "?").split()[0] if c.isalpha() else ""


def _ordinary(garbled: str) -> bool:
    """Whether such a form may well occur in correct text: letters of one alphabet, or lines of a table."""
    if all("─" <= c <= "╿" for c in garbled):
        return True
    if not all(c.isalpha() for c in garbled):
        return garbled[0] in "–—" or (len(garbled) == 2 and garbled[1] in "‘’“”–—«»\xa0" and garbled[0].isalpha())
    if len({script(c) for c in garbled}) > 1:
        return False
    return len(garbled) == 2 or garbled.islower() or garbled.isupper() or garbled[1:].islower()


@lru_cache(maxsize=1)
def byte_forms() -> dict[str, tuple[str, bool, str]]:
    """Garbled forms of single characters that were UTF-8: the character, whether the form is conclusive alone, the encoding."""
    narrow = [chr(c) for a, b in ((0xA0, 0x180), (0x386, 0x3CF), (0x400, 0x460), (0x2010, 0x2040)) for c in range(a, b)] + list("€™•−≤≥′″№")
    wide = [chr(c) for a, b in ((0x3000, 0x3011), (0x3041, 0x3100), (0x4E00, 0x9FA1), (0xFF01, 0xFF5F)) for c in range(a, b)]
    # scripts that are looked for in the two most frequent encodings only
    near = [chr(c) for a, b in ((0x531, 0x588), (0x5D0, 0x5EB), (0x60C, 0x6D5)) for c in range(a, b)]
    near += [chr(c) for a, b in ((0x904, 0x970), (0xE01, 0xE5C), (0x10D0, 0x1100), (0x1E00, 0x1F00), (0x2190, 0x2800), (0xAC00, 0xD7A4), (0x1F1E6, 0x1FB00)) for c in range(a, b)] + ["\u200d", "\ufe0f"]
    far = frozenset(wide + near)
    forms: dict[str, tuple[str, bool, str]] = {}
    for wrong in WRONG:
        for c in narrow + (wide if wrong in WIDE else []) + (near if wrong in WIDE[:2] else []):
            if not c.isprintable() and c not in "\xa0\u200d\ufe0f":
                continue
            try:
                garbled = read_as(c.encode(), wrong)
            except UnicodeDecodeError:
                continue
            if len(garbled) > 1 and garbled not in forms:
                sure = c in PUNCTUATION and len(garbled) > 2 or not _ordinary(garbled)
                if c in far and garbled.isalpha():
                    sure = False
                if wrong in ("cp1252", "iso8859-15") and len(garbled) == 2 and garbled[1] in NEVER_SECOND and garbled[0].isupper():
                    sure = True
                if wrong in ("cp866", "mac_cyrillic", "iso8859-5", "koi8-r", "iso8859-7", "cp1254", "cp1257", "cp852") and len(garbled) < 3:
                    sure = False
                forms[garbled] = c, sure, wrong
    return forms


@lru_cache(maxsize=1)
def automaton() -> object:
    """All garbled forms: of single characters that were UTF-8, and of pairs of letters of single-byte encodings."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for garbled, (c, sure, wrong) in byte_forms().items():
        machine.add_word(garbled, (len(garbled), c, sure, wrong))
    machine.make_automaton()
    return machine


@lru_cache(maxsize=1)
def alphabets() -> dict[str, frozenset[str]]:
    """All letters of each alphabet, in both cases."""
    return {name: frozenset(order + order.upper() + ("ЁΆΈΉΊΌΎΏ" if name in ("CYRILLIC", "GREEK") else "")) for name, order in FREQUENT.items()}


@lru_cache(maxsize=2)
def letter_automaton(within: bool) -> object:
    """Pairs of letters of a single-byte encoding as another one shows them: within Cyrillic, or as letters and signs of the west."""
    import ahocorasick

    pairs: dict[str, set[int]] = {}
    for k, (true, wrong) in enumerate(LETTERWISE):
        if within != (wrong in ("koi8-r", "cp1251")):
            continue
        own = {}
        for c in sorted(alphabets()[ALPHABET_OF.get(true, "CYRILLIC")]):
            try:
                own[c] = read_as(c.encode(true), wrong)
            except UnicodeError:
                continue
        for a, x in own.items():
            for b, y in own.items():
                if b.upper() == b.lower() or b.islower() or a.isupper():
                    pairs.setdefault(x + y, set()).add(k)
    machine = ahocorasick.Automaton()
    for garbled, which in pairs.items():
        if not garbled.isascii() and not all("─" <= c <= "╿" for c in garbled):
            machine.add_word(garbled, frozenset(which))
    machine.make_automaton()
    return machine


def _rarity(word: str, alphabet: str) -> float:
    """How rare the letters of a word are; capitals count a little more."""
    order = FREQUENT[alphabet]
    return sum(math.log(2 + (order.index(c) if c in order else len(order))) for c in word.lower()) + CAPITAL * sum(c != d for c, d in zip(word[1:], word[1:].lower()))


def _cost(word: str, alphabet: str) -> float | None:
    """The rarity of a word; None if it isn't a word of this alphabet in one letter case."""
    if not alphabets()[alphabet].issuperset(word) or len(set(word)) < 3:
        return None
    if word.upper() != word.lower() and not (word[1:].islower() or word.isupper()):
        return None
    return _rarity(word, alphabet)


Span = tuple[int, int, str]


def _misplaced(text: str, a: int, b: int) -> bool:
    """Whether a form of two characters stands where they cannot stand in ordinary text."""
    if b - a != 2:
        return False
    x, y = text[a], text[b - 1]
    before, after = text[a - 1 : a], text[b : b + 1]
    if not x.isupper() or script(x) != "LATIN":
        return False
    if y == "\xa0":
        if before.isalpha():
            return before.islower()
        return x in "ÃÂ" or x == "Å" and after.isalpha() and not text[:a].rstrip()[-1:].isdigit()
    if y in OPENING or y in CLOSING:
        return before.islower() or after.isalpha() and (y in OPENING or not before.isalpha())
    return y.isalpha() and (before.islower() or y.isupper() and after.islower() and not before.isalpha())


def _was(stretch: str, encodings: tuple[str, ...]) -> str | None:
    """What a stretch was if all of it was UTF-8 and read in one of the encodings."""
    for wrong in encodings:
        data = stored_in(stretch, wrong)
        try:
            original = data.decode() if data else None
        except UnicodeDecodeError:
            continue
        if original:
            return original
    return None


def byte_spans(text: str) -> list[Span]:
    """Spans that were UTF-8, with their original: where one encoding explains a whole stretch, all of it; else form by form."""
    hits = [(end - n + 1, end + 1, c, sure or (wrong in WRONG[:2] and _misplaced(text, end - n + 1, end + 1)), wrong) for end, (n, c, sure, wrong) in automaton().iter_long(text)]
    out: list[Span] = []
    left, at = [], 0
    known = tuple(dict.fromkeys(h[4] for h in hits if h[3]))
    while at < len(hits):
        end = at + 1
        while end < len(hits) and hits[end][0] == hits[end - 1][1]:
            end += 1
        run, at = hits[at:end], end
        a, b = run[0][0], run[-1][1]
        if out and a < out[-1][1]:
            continue
        whole = text[a:b]
        letters = whole.isalpha() and (whole.isupper() or whole.islower() or whole[1:].islower())
        sure = any(h[3] for h in run)
        if sure or (len(run) > 2 and not letters) or (known and (len(run) > 1 or not letters or "ƒ" in whole) and _was(whole, known)):
            x, y = a, b
            while x and text[x - 1] > "\x7f" and not (out and x <= out[-1][1]):
                x -= 1
            while y < len(text) and text[y] > "\x7f":
                y += 1
            encodings = tuple(dict.fromkeys([h[4] for h in run if h[3] or not sure] + [w for w in WRONG[:2]]))
            if original := _was(text[x:y], encodings):
                out.append((x, y, original))
            elif original := _was(whole, encodings):
                out.append((a, b, original))
            else:
                out += [(i, j, c) for i, j, c, *_ in run]
        else:
            left.append(run)
    if out:
        # short words between garbled ones were garbled with them
        begin, end = out[0][0], out[-1][1]
        taken = {i for a, b, _ in out for i in range(a, b)}
        for run in left:
            a, b = run[0][0], run[-1][1]
            if begin < a and b < end and a not in taken and not text[a - 1].isalnum() and not text[b].isalnum():
                out += [(i, j, c) for i, j, c, *_ in run]
        out.sort()
    return out


_AS_BYTES = {ord(c): b for b in range(0x80, 0xA0) if (c := read_as(bytes([b]), "cp1252")) != chr(b)}
_JAPANESE_HINT = re.compile(r"[\x82‚][Ÿ\x9f-ñ]|[\x83ƒ][@-~\x80-\x96€-™]|[¤¥][¡-ö]|[\x88-\x98][@-~\x80-ü]")
_UNITS = {true: re.compile(shape) for true, shape in JAPANESE.items()}
_STRETCH = {true: re.compile(f"(?:{shape})+") for true, shape in JAPANESE.items()}
_IDEOGRAPH_BYTES = re.compile(rb"[\xe3-\xe9][\x80-\xbf]{2}")


def _kind(c: str, unit: str, true: str) -> str:
    """K: kana, C: common kanji, P: punctuation and full-width forms, H: half-width kana, R: anything rare."""
    if "\u3041" <= c <= "\u30ff":
        return "K"
    if "\u4e00" <= c <= "\u9fff":
        return "C" if ("\x88" <= unit[0] <= "\x98" if true == "cp932" else "\xb0" <= unit[0] <= "\xcf") else "R"
    if "\u3000" <= c <= "\u3040" or "\uff01" <= c <= "\uff5e":
        return "P"
    return "H" if "\uff61" <= c <= "\uff9f" else "R"


def _stretches(raw: str, true: str, start: int, end: int) -> Iterator[tuple[int, int, str, str]]:
    """(begin, end, original, kinds) of what decodes in a stretch, cut where a character isn't assigned."""
    begin, at, out, kinds = start, start, [], []
    while at < end and (m := _UNITS[true].match(raw, at, end)):
        try:
            c = m.group().encode("latin-1").decode(true)
        except UnicodeDecodeError:
            if out:
                yield begin, at, "".join(out), "".join(kinds)
            begin, out, kinds = m.end(), [], []
        else:
            out.append(c)
            kinds.append(_kind(c, m.group(), true))
        at = m.end()
    if out:
        yield begin, at, "".join(out), "".join(kinds)


def _was_utf8(raw: str, a: int, b: int) -> bool:
    while a and "\x80" <= raw[a - 1] <= "\xff":
        a -= 1
    while b < len(raw) and "\x80" <= raw[b] <= "\xff":
        b += 1
    data = raw[a:b].encode("latin-1")
    try:
        data.decode()
        return True
    except UnicodeDecodeError:
        return 6 * len(_IDEOGRAPH_BYTES.findall(data)) > len(data)


def japanese_spans(text: str) -> list[Span]:
    """Stretches of Japanese that were Shift-JIS or EUC-JP, each in the encoding that gives most kana and common kanji.

    A stretch counts by three kana, or by kanji alone if control characters lead them; shorter ones count
    next to it.
    """
    if not _JAPANESE_HINT.search(text):
        return []
    raw = text.translate(_AS_BYTES)
    sure, rest = [], []
    for true in JAPANESE:
        for m in _STRETCH[true].finditer(raw):
            # a letter that stands before the stretch shifts all of it by one
            readings = [list(_stretches(raw, true, a, m.end())) for a in (m.start(), m.start() + 1)]
            for a, b, original, kinds in max(readings, key=lambda r: sum(k.count("K") + k.count("C") - 2 * k.count("R") - k.count("H") for *_, k in r)):
                n, kana = len(kinds), kinds.count("K")
                odd = kinds.count("R")
                found = kana > 2 and 5 * (odd + kinds.count("H")) <= n
                # Greek that was UTF-8 and read as cp850 or cp852: the sign leads half of its letters
                found = found and not ("╬" in text and true == "euc_jp" and set(raw[a:b:2]) == {"¤"})
                if not found and true == "cp932" and kinds.count("C") > 1 and set(kinds) <= set("KCP"):
                    found = not (a and "\x80" <= raw[a - 1] <= "\xff") and all("\x80" <= text[u.start()] < "\xa0" for u in _UNITS[true].finditer(raw, a, b))
                if found and not _was_utf8(raw, a, b):
                    sure.append((n - odd, a, b, original, true))
                elif 5 * odd <= n:
                    rest.append((a, b, original, true))
    if not sure:
        return []
    taken: list[tuple[int, int, str, str]] = []
    for _, a, b, original, true in sorted(sure, reverse=True):
        if all(b <= x or y <= a for x, y, *_ in taken):
            taken.append((a, b, original, true))
    taken.sort()
    # short stretches beside them, without a letter in between, were garbled with them
    for order, near in ((1, lambda t, r: (t[1], r[0])), (-1, lambda t, r: (r[1], t[0]))):
        merged = sorted(taken + rest)[::order]
        last, spans = None, []
        for s in merged:
            if s in taken:
                spans.append(s)
                last = s
            elif last and s[3] == last[3]:
                x, y = near(last, s)
                if 0 <= y - x <= 40 and not any(c.isalpha() for c in text[x:y]):
                    spans.append(s)
                    last = s
        taken = []
        for s in sorted(spans):
            if not taken or taken[-1][1] <= s[0]:
                taken.append(s)
    return [(a, b, original) for a, b, original, _ in taken]


_INVERTED = re.compile(r"[а-яё][А-ЯЁ]{2,}")


def _readings(word: str, which: frozenset[int]) -> dict[int, tuple[str, float]]:
    """What the word was, and how rare its letters are, by each pair that explains it."""
    out = {}
    for k in which:
        true, wrong = LETTERWISE[k]
        data = stored_in(word, wrong)
        try:
            original = data.decode(true) if data else ""
        except UnicodeDecodeError:
            continue
        cost = _cost(original, ALPHABET_OF.get(true, "CYRILLIC")) if original else None
        if cost is not None:
            out[k] = original, cost
    return out


#: How far back the word before a stretch may begin.
LONGEST_WORD = 400
_TOKEN = re.compile(r"[^\s.,;:!?()\"]+")
_BEFORE = re.compile(r"([^\s.,;:!?()\"]+)[ .,;:!?()\"]{1,3}\Z")
_AFTER = re.compile(r"[ .,;:!?()\"]{1,3}([^\s.,;:!?()\"]+)")


def _same_pair(word: str, k: int, alphabet: frozenset[str]) -> str | None:
    """What a word was by a pair that is settled; None if it does not hold."""
    true, wrong = LETTERWISE[k]
    data = None if word.isascii() else stored_in(word, wrong)
    try:
        original = data.decode(true) if data else ""
    except UnicodeDecodeError:
        return None
    return original if original and alphabet.issuperset(original) else None


def _settled(words: list[tuple[int, int, dict[int, tuple[str, float]], float]]) -> list[int | None]:
    """The pair each word was garbled by, or None for a word that stays, at the least cost over all words."""
    states = sorted({k for *_, readings, _ in words for k in readings})
    costs: dict[int | None, float] = dict.fromkeys([None, *states], 0.0)
    steps = []
    for a, b, readings, plain in words:
        best = min(costs, key=lambda s: costs[s])
        after, came = {}, {}
        for state in [None, *states]:
            own = plain if state is None else readings[state][1] if state in readings else UNEXPLAINED * (b - a)
            stay, move = costs.get(state, math.inf), costs[best] + CHANGE
            after[state], came[state] = min(stay, move) + own, state if stay <= move else best
        costs = after
        steps.append(came)
    at = min(costs, key=lambda s: costs[s])
    out = []
    for came in reversed(steps):
        out.append(at)
        at = came[at]
    return out[::-1]


def letter_spans(text: str, fixed: bytes = b"") -> list[Span]:
    """Whole words of Cyrillic, Greek, Hebrew, Arabic or Thai letters that another single-byte encoding shows as others; what is fixed stays."""
    runs: list[list] = []
    hits = letter_automaton(False).iter(text)
    if _INVERTED.search(text):
        # only a word in the wrong letter case tells that Cyrillic was taken for other Cyrillic
        hits = sorted([*hits, *letter_automaton(True).iter(text)], key=lambda h: h[0])
    for end, which in hits:
        a, b = end - 1, end + 1
        if runs and runs[-1][1] >= a + 1 and runs[-1][1] <= b and (both := runs[-1][2] & which):
            runs[-1][1], runs[-1][2] = b, both
        else:
            runs.append([a, b, which])
    words = []
    for a, b, which in runs:
        if b - a < 4 or (a and text[a - 1].isalpha()) or (b < len(text) and text[b].isalpha()) or 1 in fixed[a:b]:
            continue
        word = text[a:b]
        readings = _readings(word, which)
        if readings:
            # a word of the alphabet may well stay as it is, less so in a letter case that words do not have
            plain = UNEXPLAINED * (b - a)
            if alphabets()["CYRILLIC"].issuperset(word):
                plain = _rarity(word, "CYRILLIC") + (0.0 if word[1:].islower() or word.isupper() else ODD_CASE)
            words.append((a, b, readings, plain))
    if not words:
        return []
    spans: list[Span] = []
    chosen = _settled(words)
    at = 0
    while at < len(words):
        end = at + 1
        while end < len(words) and chosen[end] == chosen[at]:
            end += 1
        k, own = chosen[at], words[at:end]
        at = end
        if k is None:
            continue
        true, wrong = LETTERWISE[k]
        found = [(a, b, readings[k][0]) for a, b, readings, _ in own if k in readings]
        if not found or (max(b - a for a, b, _ in found) < 5 and len(found) < 2):
            continue
        within = script(text[found[0][0]]) == "CYRILLIC"
        if within and not any(_INVERTED.fullmatch(text[a:b]) for a, b, _ in found):
            continue
        # the pair is settled: shorter words in the same stretch were garbled with the others
        alphabet, known = alphabets()[ALPHABET_OF.get(true, "CYRILLIC")], {a for a, _, _ in found}
        first, last = found[0][0], found[-1][1]
        for m in _TOKEN.finditer(text[first:last]):
            if m.start() + first not in known and 1 not in fixed[m.start() + first : m.end() + first] and (word := _same_pair(m.group(), k, alphabet)):
                found.append((m.start() + first, m.end() + first, word))
        # and so were those right beside the stretch, unless they may be ordinary words of the same alphabet
        while not within and (m := _BEFORE.search(text, max(0, first - LONGEST_WORD), first)) and (word := _same_pair(m.group(1), k, alphabet)):
            first = m.start(1)
            found.append((first, m.end(1), word))
        while not within and (m := _AFTER.match(text, last)) and (word := _same_pair(m.group(1), k, alphabet)):
            last = m.end(1)
            found.append((m.start(1), last, word))
        spans += found
    return sorted(spans)


@lru_cache(maxsize=1)
def latin_maps() -> list[tuple[dict[str, str], frozenset[str]]]:
    """For each pair of Latin encodings: garbled character to true letter, and those that are odd inside a word."""
    maps = []
    for true, wrong in LATIN_PAIRS:
        own = {}
        for c in ACCENTED + ACCENTED.upper():
            if len(c) == 1:
                try:
                    own[read_as(c.encode(true), wrong)] = c
                except UnicodeError:
                    continue
        own = {g: c for g, c in own.items() if g != c and len(g) == 1}
        maps.append((own, frozenset(g for g in own if not g.isalpha() or g in "ŸŽžŒœƒŠ")))
    return maps


@lru_cache(maxsize=1)
def latin_automaton() -> object:
    """A letter, or what stands for one, followed by a character that is odd inside a word, with the pairs that give it."""
    import ahocorasick

    forms: dict[str, set[int]] = {}
    plain = [chr(c) for c in (*range(65, 91), *range(97, 123))]
    for k, (own, odd) in enumerate(latin_maps()):
        for g in odd:
            for first in {*plain, *own, *ACCENTED, *ACCENTED.upper()}:
                forms.setdefault(first + g, set()).add(k)
    machine = ahocorasick.Automaton()
    for garbled, which in forms.items():
        machine.add_word(garbled, frozenset(which))
    machine.make_automaton()
    return machine


_LATIN_WORD = re.compile(r"[A-Za-z\x80-\x9fÀ-ɏ¡-¿ŒœŠšŽžŸƒˆ˜‚„…†‡‰‹›•™√-≥◊∂∑∏∫ΩΑ-ωА-яЁё░-▓═-╬╒-╫]+")


def latin_spans(text: str, fixed: bytes = b"") -> list[Span]:
    """Words of Latin letters in which characters of another Latin encoding stand for accented letters; what is fixed stays."""
    hits = [end for end, _ in latin_automaton().iter(text)]
    if not hits:
        return []
    maps, at = latin_maps(), 0
    # words with a hit inside, with the weight each pair gives them
    words: list[tuple[int, int, dict[int, int]]] = []
    for m in _LATIN_WORD.finditer(text):
        while at < len(hits) and hits[at] < m.start():
            at += 1
        w = m.group()
        if at == len(hits):
            break
        if hits[at] >= m.end() - 1 or len(w) < 3 or 1 in fixed[m.start() : m.end()] or not any("a" <= c <= "z" for c in w):
            continue
        weights = {}
        for k, (own, odd) in enumerate(maps):
            inner = sum(c in odd for c in w[1:-1])
            if inner and all(c in own or (c.isalpha() and script(c) == "LATIN") for c in w):
                weights[k] = inner
        if weights:
            words.append((m.start(), m.end(), weights))
    out: list[Span] = []
    begin = 0
    while begin < len(words):
        # a stretch goes on while one pair explains all its words
        shared, end = set(words[begin][2]), begin + 1
        while end < len(words) and shared & set(words[end][2]):
            shared &= set(words[end][2])
            end += 1
        own = words[begin:end]
        begin = end
        k = min(shared, key=lambda k: (-sum(w[k] for *_, w in own), k))
        if len(own) < 2 or sum(w[k] for *_, w in own) < 2:
            continue
        # the pair is settled: in this stretch characters that are ordinary letters were garbled as well
        table, first, last = maps[k][0], own[0][0], own[-1][1]
        out += [(m.start() + first, m.end() + first, "".join(table.get(c, c) for c in m.group())) for m in _LATIN_WORD.finditer(text[first:last]) if any(c in table for c in m.group()) and 1 not in fixed[m.start() + first : m.end() + first]]
    return out


def repair(text: str | None) -> tuple[str | None, int, bool]:
    """The text with garbled spans replaced, how many there were, and whether characters are lost for good."""
    if not text or text.isascii():
        return text, 0, False
    count, fixed = 0, bytes(len(text))
    while True:
        before = count
        for find in (japanese_spans, byte_spans):
            spans = find(text)
            if spans and find is byte_spans:
                # forms by chance inside a word that a single-byte pair explains as a whole
                spans = _without_chance(spans, letter_spans(text, fixed))
            count += len(spans)
            text, fixed = _replaced(text, fixed, spans)
        if count == before:
            break
    for find in (letter_spans, latin_spans):
        spans = find(text, fixed)
        count += len(spans)
        text, fixed = _replaced(text, fixed, spans)
    return text, count, "\ufffd" in text


def _without_chance(spans: list[Span], words: list[Span]) -> list[Span]:
    """The spans but those that make up less than two thirds of a word which a single-byte pair explains as a whole."""
    starts, dropped = [s[0] for s in spans], set()
    for a, b, _ in words:
        first = at = bisect_left(starts, a)
        held = 0
        while at < len(spans) and spans[at][1] <= b:
            held += spans[at][1] - spans[at][0]
            at += 1
        if 3 * held < 2 * (b - a):
            dropped.update(range(first, at))
    return [s for i, s in enumerate(spans) if i not in dropped]


def _replaced(text: str, fixed: bytes, spans: list[Span]) -> tuple[str, bytes]:
    """The text with the spans replaced, and a mark for each character that is restored already."""
    parts, marks, at = [], [], 0
    for a, b, original in spans:
        if a >= at:
            parts += [text[at:a], original]
            marks += [fixed[at:a], b"\1" * len(original)]
            at = b
    return "".join([*parts, text[at:]]), b"".join([*marks, fixed[at:]])


def _run(only_found: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fixed = [repair(t) for t in batch.column("text").to_pylist()]
            hit = pa.array([n > 0 or lost for _, n, lost in fixed], pa.bool_())
            if only_found:
                yield pa.RecordBatch.from_arrays([batch.column("id")], ["id"]).filter(hit)
            else:
                columns = [batch.column("id"), pa.array([t for t, _, _ in fixed], pa.string()), pa.array([n for _, n, _ in fixed], pa.int32()), pa.array([x for _, _, x in fixed], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "restored", "spans", "lost"])

    return run


def restore_texts(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, restored, spans, lost) of every row."""
    source = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_run(False), f"id {source.schema['id'].dataType.simpleString()}, restored string, spans int, lost boolean")


def garbled_documents(documents: DataFrame) -> DataFrame:
    """(doc_id) of the documents with garbled passages."""
    source = documents.select(F.col("doc_id").alias("id"), F.col("text"))
    return source.mapInArrow(_run(True), f"id {source.schema['id'].dataType.simpleString()}").select(F.col("id").alias("doc_id")).distinct()
