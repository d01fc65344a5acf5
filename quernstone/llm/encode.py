"""Problem 7: encoding of a corpus with a public tokenizer.

Texts are cut into words for a whole batch at once: the cutting rule of the byte-level vocabularies is
evaluated on an array of character classes. Words are told apart by two hashes, and only those a worker
has not met yet are merged. For them an index maps each pair of symbols to all its positions in all the
words of the batch; active ranks are applied in ascending order, and the lists of the neighbouring
pairs are brought up to date.

Null and empty texts give an empty list. Strings of special tokens are ordinary text. Texts of any
length are encoded whole. Unpaired surrogates cannot occur in Arrow strings.

The vocabulary files are named by a parameter, read on the driver and broadcast (under 2 MB each).
"""

from __future__ import annotations

import base64
import heapq
import os
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.kernels import BASES, SpanHash, code_points
from quernstone.plans.runtime import text_slices

TOKENIZER_DIR = "/opt/tokenizers"
LETTER, NUMBER, SPACE, OTHER = range(4)
#: Words whose ids a worker keeps; the store starts anew beyond that.
KEPT_WORDS = 1 << 20


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Letter, number, white space or other, for each code point."""
    import regex

    every = "".join(map(chr, range(0xD800))) + "x" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    table = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = kind
    table[0xD800:0xE000] = OTHER
    return table


def word_starts(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where words begin.

    A word is a contraction ('s 't 're 've 'm 'll 'd), or a run of letters, of numbers or of other
    characters with a space before it if there is one; of white space before anything else the last
    character stands alone (or joins the word that follows if it is a space).
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[codes]
    first_of_row = np.zeros(n + 1, bool)
    first_of_row[starts[:-1]] = True
    first_of_row[n] = True
    begins = first_of_row[:n].copy()
    begins[1:] |= kind[1:] != kind[:-1]
    begin = np.flatnonzero(begins)
    end = np.append(begin[1:], n)
    space = kind[begin] == SPACE
    cut = np.zeros(n + 1, bool)
    blank = (codes == 32) & (kind == SPACE)
    words = begin[~space]
    joined = np.zeros(len(words), bool)
    has_before = words > 0
    joined[has_before] = blank[words[has_before] - 1] & ~first_of_row[words[has_before]]
    cut[words - joined] = True
    a, b = begin[space], end[space]
    last_run = first_of_row[b]
    cut[a[last_run | (b - a > 1)]] = True
    alone = ~last_run & (codes[b - 1] != 32)
    cut[b[alone] - 1] = True
    quote = words[(codes[words] == 39) & ~joined]
    quote = quote[quote + 1 < n]
    quote = quote[(kind[quote + 1] == LETTER) & ~first_of_row[quote + 1]]
    if len(quote):
        one = codes[quote + 1]
        has_two = (quote + 2 < n) & ~first_of_row[np.minimum(quote + 2, n)]
        two = np.where(has_two, codes[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for hit, size in ((short, 2), (long & ~short, 3)):
            at = quote[hit]
            cut[at + 1] = False
            after = at + size
            inside = (after < n) & ~first_of_row[np.minimum(after, n)]
            after = after[inside]
            cut[after[kind[after] == LETTER]] = True
    return np.flatnonzero(cut[:n])


class PairIndexBpe:
    """Byte-pair merges over many words at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.known: dict[tuple[int, int], int] = {}

    def rank(self, a: int, b: int) -> int:
        key = (a, b)
        found = self.known.get(key)
        if found is None:
            found = self.known[key] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return found

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        out: list[list[int]] = [[]] * len(words)
        symbols: list[int] = []
        spans = []
        single, rank = self.single, self.rank
        for i, word in enumerate(words):
            whole = self.ranks.get(word)
            if whole is not None:
                out[i] = [whole]
            elif word:
                at = len(symbols)
                symbols.extend([single[b] for b in word])
                symbols.append(-1)
                spans.append((i, at, len(symbols) - 1))
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        places: dict[tuple[int, int], list[int]] = defaultdict(list)
        for p in range(len(symbols) - 1):
            if symbols[p] >= 0 and symbols[p + 1] >= 0:
                places[symbols[p], symbols[p + 1]].append(p)
        active = [(r, pair) for pair in places if (r := rank(*pair)) >= 0]
        heapq.heapify(active)
        while active:
            new, pair = heapq.heappop(active)
            a, b = pair
            for p in sorted(places.pop(pair, ())):
                q = after[p]
                if symbols[p] != a or q >= len(symbols) or symbols[q] != b:
                    continue
                symbols[p], symbols[q] = new, -2
                r = after[p] = after[q]
                before[r] = p
                right = symbols[r]
                if right >= 0:
                    key = (new, right)
                    if key not in places and (k := rank(new, right)) >= 0:
                        heapq.heappush(active, (k, key))
                        places[key].append(p)
                    elif key in places:
                        places[key].append(p)
                left = before[p]
                if left >= 0 and symbols[left] >= 0:
                    key = (symbols[left], new)
                    if key not in places and (k := rank(symbols[left], new)) >= 0:
                        heapq.heappush(active, (k, key))
                        places[key].append(left)
                    elif key in places:
                        places[key].append(left)
        for i, a, b in spans:
            out[i] = [s for s in symbols[a:b] if s >= 0]
        return out


class BatchEncoder:
    """Encodes batches of texts; keeps the ids of words it has met."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bpe = PairIndexBpe(ranks)
        self.reset()

    def reset(self) -> None:
        self.slot: dict[int, int] = {}
        self.check: list[int] = []
        self.ids: list[list[int]] = []

    def encode(self, slices: list[list[str | None]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Flat ids and row offsets of each slice of texts."""
        if len(self.ids) > KEPT_WORDS:
            self.reset()
        held = []
        fresh: list[str] = []
        for texts in slices:
            texts = [t or "" for t in texts]
            whole = "".join(texts)
            codes, starts = code_points(texts)
            s = word_starts(codes, starts)
            e = np.append(s[1:], len(codes))
            h, g = (SpanHash(codes, base).of(s, e) for base in BASES)
            words, first, which = np.unique(h, return_index=True, return_inverse=True)
            slots = np.empty(len(words), np.int64)
            for i, (key, f) in enumerate(zip(words.tolist(), first.tolist())):
                at = self.slot.get(key)
                if at is None:
                    at = self.slot[key] = len(self.check)
                    self.check.append(int(g[f]))
                    fresh.append(whole[s[f] : e[f]])
                slots[i] = at
            slots = slots[which]
            held.append((slots, np.searchsorted(s, starts), self._collided(slots, g, whole, s, e, fresh)))
        self.ids.extend(self.bpe.merge([w.encode() for w in fresh]))
        for slots, rows, own in held:
            for at, slot in own.items():
                slots[at] = slot
            used, slots = np.unique(slots, return_inverse=True)
            parts = [self.ids[i] for i in used.tolist()]
            length = np.array([len(p) for p in parts], np.int64)
            flat = np.array([x for p in parts for x in p], np.int32)
            begin = np.concatenate([[0], np.cumsum(length)])
            ends = np.concatenate([[0], np.cumsum(length[slots])])
            ids = flat[np.arange(ends[-1]) + np.repeat(begin[slots] - ends[:-1], length[slots])] if len(slots) else flat
            yield ids, ends[rows]

    def _collided(self, slots: np.ndarray, g: np.ndarray, whole: str, s: np.ndarray, e: np.ndarray, fresh: list[str]) -> dict[int, int]:
        """Words whose first hash is another word's: each gets a slot of its own."""
        check = np.array(self.check, np.uint64)
        own = {}
        for at in np.flatnonzero(check[slots] != g).tolist():
            own[at] = len(self.check)
            self.check.append(int(g[at]))
            fresh.append(whole[s[at] : e[at]])
        return own


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a vocabulary file with lines of base64 bytes and a number."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}


class LibraryEncoder:
    """The other public tokenizers, by the libraries that define them."""

    def __init__(self, name: str, data: bytes):
        if name.endswith(".json"):
            from tokenizers import Tokenizer

            model = Tokenizer.from_str(data.decode())
            model.encode_special_tokens = True
            self.run = lambda texts: [x.ids for x in model.encode_batch(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=data)
            self.run = lambda texts: model.encode(texts, num_threads=1)

    def encode(self, slices: list[list[str | None]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for texts in slices:
            ids = self.run([t or "" for t in texts])
            yield np.array([x for row in ids for x in row], np.int32), np.concatenate([[0], np.cumsum([len(row) for row in ids])]).astype(np.int64)


def tokenizer_file(tokenizer: str, directory: str = TOKENIZER_DIR) -> tuple[str, bytes]:
    """Name and content of a tokenizer's file; the form of ranks comes first."""
    for suffix in (".tiktoken", ".json", ".model"):
        path = os.path.join(directory, tokenizer + suffix)
        if os.path.exists(path):
            with open(path, "rb") as f:
                return tokenizer + suffix, f.read()
    raise ValueError(f"no tokenizer {tokenizer!r} in {directory}")


_encoders: dict[str, object] = {}


def encoder(name: str, data: Callable[[], bytes]) -> BatchEncoder | LibraryEncoder:
    """This worker's encoder."""
    if name not in _encoders:
        _encoders[name] = BatchEncoder(read_ranks(data())) if name.endswith(".tiktoken") else LibraryEncoder(name, data())
    return _encoders[name]


def _run(name: str, data: object, counts: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(name, lambda: data.value)
        for whole in batches:
            slices = list(text_slices(whole, "text"))
            for k in range(0, len(slices), 16):
                some = slices[k : k + 16]
                for batch, (ids, offsets) in zip(some, own.encode([b.column("text").to_pylist() for b in some])):
                    result = pa.array(np.diff(offsets).astype(np.int32)) if counts else pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                    yield pa.RecordBatch.from_arrays([batch.column("id"), result], ["id", "n_tokens" if counts else "ids"])

    return run


def encode_texts(rows: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k", counts: bool = False, directory: str = TOKENIZER_DIR) -> DataFrame:
    """(id, ids) of every row, or (id, n_tokens) with counts; without special tokens."""
    name, data = tokenizer_file(tokenizer, directory)
    shipped = rows.sparkSession.sparkContext.broadcast(data)
    source = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(_run(name, shipped, counts), f"id {kind}, " + ("n_tokens int" if counts else "ids array<int>"))


def document_ids(documents: DataFrame) -> DataFrame:
    """(doc_id, ids) of every document by byte_bpe_50k."""
    return encode_texts(documents, "doc_id", "text").withColumnRenamed("id", "doc_id")
