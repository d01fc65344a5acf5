"""Problem 1: rows that are copies apart from formatting.

Every text streams through one table that skips a character (value 0) or folds it to its lower-case
letter or digit. Two polynomial hashes roll over the folded codes: a skipped character adds nothing
and does not move the exponent, so the canonical string is never built. Rows whose 128-bit hashes
collide are then compared with the smallest row of the group by two pointers that skip alike; rows
that fail (a true collision) are regrouped by their exact canonical form. The text of the smallest row of
a large group is repeated so that its members are compared in many tasks.

JSON payloads hash as trees: objects as sums over their fields, so that their order does not matter.

Null, empty and blank texts, and texts without a letter or digit, are copies of nothing; so are
invalid or null payloads. Rows with the same id are the same row. A null split is a split of its own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernstone.functions.kernels import BASES, code_points, mix, powers
from quernstone.plans.runtime import materialise, text_slices


#: Members that are compared with one copy of the first row's text.
MEMBERS = 20_000


@lru_cache(maxsize=1)
def fold_table() -> np.ndarray:
    """Folded code of every code point; 0 where it is skipped."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        low = [x for x in chr(c).lower() if x.isalnum()]
        if low:
            table[c] = ord(low[0])
    return table


def _sigma(text: str) -> str:
    """The one letter whose lower case depends on its place in the word."""
    return text.lower() if "Σ" in text else text


def fold_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two rolling hashes of the folded codes of each text, and the number of codes kept."""
    codes, starts = code_points([_sigma(t) for t in texts])
    folded = fold_table()[codes]
    kept = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(folded > 0, out=kept[1:])
    value = mix(folded.astype(np.uint64))
    value[folded == 0] = 0
    out = []
    for base in BASES:
        power, inverse = powers(base, len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(value * power[kept[:-1]], out=sums[1:])
        out.append(mix((sums[starts[1:]] - sums[starts[:-1]]) * inverse[kept[starts[:-1]]]))
    return out[0], out[1], kept[starts[1:]] - kept[starts[:-1]]


def same_folded(a: str, b: str) -> bool:
    """Two pointers over both texts; characters that fold to nothing are skipped on either side."""
    table = fold_table()
    a, b, i, j = _sigma(a), _sigma(b), 0, 0
    while True:
        while i < len(a) and not table[ord(a[i])]:
            i += 1
        while j < len(b) and not table[ord(b[j])]:
            j += 1
        if i == len(a) or j == len(b):
            return i == len(a) and j == len(b)
        if table[ord(a[i])] != table[ord(b[j])]:
            return False
        i, j = i + 1, j + 1


def folded(text: str) -> str:
    """The canonical form itself; only for rows that two pointers set apart."""
    return "".join(c for c in text.lower() if c.isalnum())


class _Bad(ValueError):
    pass


def _constant(_: str) -> None:
    raise _Bad


def parse(payload: str) -> object:
    """The JSON value; raises ValueError (or RecursionError) unless it is valid JSON."""
    return json.loads(payload, parse_constant=_constant)


def _digest(tag: bytes, data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(tag + data, digest_size=16).digest(), "little")


def json_hash(value: object, text_hash: Callable[[str], int]) -> int:
    """128-bit hash of a JSON value, the same for any order of fields."""
    if isinstance(value, dict):
        total = sum(_digest(b"f", k.encode("utf-8", "surrogatepass") + b"\0" + json_hash(v, text_hash).to_bytes(16, "little")) for k, v in value.items())
        return _digest(b"o", (total & ((1 << 128) - 1)).to_bytes(16, "little") + len(value).to_bytes(8, "little"))
    if isinstance(value, list):
        return _digest(b"l", b"".join(json_hash(v, text_hash).to_bytes(16, "little") for v in value))
    if isinstance(value, str):
        return text_hash(value)
    if isinstance(value, bool) or value is None:
        return _digest(b"c", repr(value).encode())
    return _digest(b"n", str(hash(value)).encode())


def same_json(a: object, b: object) -> bool:
    """Equal fields and values; strings compare as folded texts, true is not 1."""
    if isinstance(a, dict):
        return isinstance(b, dict) and a.keys() == b.keys() and all(same_json(v, b[k]) for k, v in a.items())
    if isinstance(a, list):
        return isinstance(b, list) and len(a) == len(b) and all(map(same_json, a, b))
    if isinstance(a, str):
        return isinstance(b, str) and same_folded(a, b)
    if isinstance(b, (dict, list, str)) or isinstance(a, bool) != isinstance(b, bool):
        return False
    return a == b


def canonical_json(value: object) -> str:
    """The canonical form of a payload, for rows that the comparison set apart."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{canonical_json(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, str):
        return json.dumps("s" + folded(value))
    return f"{type(value).__name__ if isinstance(value, bool) else ''}{hash(value)}" if value is not None else "null"


def _strings(value: object, out: list[str]) -> None:
    if isinstance(value, str):
        out.append(value)
    elif isinstance(value, dict):
        for v in value.values():
            _strings(v, out)
    elif isinstance(value, list):
        for v in value:
            _strings(v, out)


def _text_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h1, h2, kept = fold_hashes(texts)
    return h1, h2, kept > 0


def _json_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    values, ok = [], np.ones(len(texts), bool)
    for i, t in enumerate(texts):
        try:
            values.append(parse(t))
        except (ValueError, RecursionError):
            values.append(None)
            ok[i] = False
    strings: list[str] = []
    for v in values:
        _strings(v, strings)
    s1, s2, _ = fold_hashes(strings)
    known = {s: int(x) << 64 | int(y) for s, x, y in zip(strings, s1.tolist(), s2.tolist())}
    whole = [json_hash(v, known.__getitem__) for v in values]
    low = (1 << 64) - 1
    return np.array([h >> 64 for h in whole], np.uint64), np.array([h & low for h in whole], np.uint64), ok


def _hashed(keys: Callable, column: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, column):
                texts = batch.column("text")
                h1, h2, ok = keys([t or "" for t in texts.to_pylist()])
                ok &= ~texts.is_null().to_numpy(zero_copy_only=False)
                out = pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("split"), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["id", "split", "h1", "h2"]
                )
                yield out.filter(pa.array(ok))

    return run


def _compared(json_rows: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Members whose text agrees with the first row's keep it; the others get their canonical form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            form = []
            for a, b in zip(batch.column("first_text").to_pylist(), batch.column("text").to_pylist()):
                if json_rows:
                    x, y = parse(a), parse(b)
                    form.append(None if same_json(x, y) else canonical_json(y))
                else:
                    form.append(None if same_folded(a, b) else folded(b))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("split"), batch.column("first_id"), pa.array(form, pa.string())], ["id", "split", "first_id", "form"])

    return run


def formatting_copies(rows: DataFrame, id_col: str = "id", text_col: str = "text", split_col: str | None = None, json_rows: bool = False) -> DataFrame:
    """(first_id, copy_id): each member of a set of copies but its smallest id."""
    split = F.col(split_col) if split_col else F.lit("")
    source = rows.select(F.col(id_col).alias("id"), split.alias("split"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    kind = source.schema["id"].dataType.simpleString()
    hashed = source.mapInArrow(_hashed(_json_keys if json_rows else _text_keys, "text"), f"id {kind}, split string, h1 bigint, h2 bigint")
    hashed = materialise(hashed, "folds")
    sets = hashed.groupBy("split", "h1", "h2").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts")).where("first_id < last_id")
    same = F.col("s.split").eqNullSafe(F.col("m.split")) & (F.col("s.h1") == F.col("m.h1")) & (F.col("s.h2") == F.col("m.h2"))
    members = hashed.alias("m").join(sets.alias("s"), same).where("m.id > s.first_id").select("m.id", "m.split", "s.first_id", "s.salts").distinct()
    members = materialise(members, "members")
    texts = source.select("id", "text").dropDuplicates(["id"]) if rows.isStreaming else source.select("id", "text")
    wanted = members.select("id").union(members.select("first_id")).distinct()
    texts = materialise(texts.join(wanted, "id", "left_semi"), "texts")
    firsts = members.groupBy("first_id").agg(F.max("salts").alias("salts")).join(texts.select(F.col("id").alias("first_id"), F.col("text").alias("first_text")), "first_id")
    firsts = firsts.select("first_id", "first_text", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    both = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).join(texts, "id").join(firsts, ["first_id", "salt"])
    checked = both.select("id", "split", "first_id", "text", "first_text").mapInArrow(_compared(json_rows), f"id {kind}, split string, first_id {kind}, form string")
    checked = materialise(checked, "checked")
    good = checked.where("form IS NULL").select("first_id", F.col("id").alias("copy_id"))
    apart = checked.where("form IS NOT NULL")
    least = apart.groupBy(F.col("split").alias("s"), F.col("form").alias("f")).agg(F.min("id").alias("least"))
    rest = apart.join(least, F.col("split").eqNullSafe(F.col("s")) & (F.col("form") == F.col("f"))).where("id > least").select(F.col("least").alias("first_id"), F.col("id").alias("copy_id"))
    return good.unionByName(rest).distinct()


def copy_counts(found: DataFrame) -> DataFrame:
    """(kept_id, copies): each kept row with the number of rows it stands for, itself included."""
    return found.groupBy(F.col("first_id").alias("kept_id")).agg((F.count("*") + 1).alias("copies"))


def corpus_copies(corpus_rows: DataFrame, raw_records: DataFrame) -> DataFrame:
    """Copies within one split of the corpus, and among raw payloads."""
    return formatting_copies(corpus_rows, "id", "text", "source_split").unionByName(formatting_copies(raw_records, "id", "payload", None, True))
