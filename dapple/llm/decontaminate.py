"""Benchmark decontamination by template canonicalisation.

Words are lower-cased and stripped of marks; numbers become ``<num>``, units
after a number ``<unit>``, and capitalised words inside a sentence ``<name>``.
Windows of ``WINDOW`` canonical words of texts and benchmark items are joined
by hash, so an item whose numbers, names or units were replaced is still found.
Windows with names are joined with their names as plain words too, as names are
told by letter case and a copy in other case has none.
A match of a text and an item at one alignment counts only if its slots are
consistent: of the values that the windows cover, equal ones of one type in the
item stand where the text has equal ones, and different ones where it has
different ones (a renaming, so to speak).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import SPACED, U64, Words, as_bytes, grams, mix, whole, words
from .scratch import Scratch

WINDOW = 10
#: A window with fewer words that are no placeholders proves nothing by itself; it must be the same with its values.
LEAST_LITERALS = 4
#: Up to so many distinct benchmark windows every task holds them all as a filter (8 bytes each); beyond, a bit table of FILTER_BITS does.
FILTER_WINDOWS, FILTER_BITS = 2_000_000, 1 << 28
#: Tasks that make a bit table each; the driver joins them one after the other.
FILTER_TASKS = 8

#: Units of measure.
UNITS = "km m cm mm mile miles foot feet inch inches yard yards kg g mg lb lbs pound pounds ounce ounces ton tons l ml litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years % percent dollar dollars euro euros cent cents usd eur degree degrees kmh mph"
_NUMBER = re.compile(rb"[-+]?[\$\xe2\x82\xac]{0,3}\d[\d.,:/]*(st|nd|rd|th)?%?", re.IGNORECASE)
_MARKS = b"!\"#$&'()*+,-./:;<=>?@[\\]^_`{|}~"

_STRIP = np.zeros(256, dtype=bool)
_STRIP[list(_MARKS)] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".!?:")] = True
_DIGITS = np.zeros(256, dtype=bool)
_DIGITS[48:58] = True
_UNIT_HASHES = np.sort(np.array([next(words([u.encode()], SPACED)).hashes[0] for u in UNITS.split()], dtype=U64))
NUM, UNIT, NAME = (U64(k) for k in (101, 102, 103))


def canonical(texts: list[bytes]) -> Iterator[tuple[Words, np.ndarray, np.ndarray, np.ndarray]]:
    """Words of each block with marks stripped off their ends: canonical hash, slot type (0: none) and own hash."""
    for w in words(texts, SPACED, hashed=False):
        raw, starts, ends = w.raw, w.starts.copy(), w.ends.copy()
        closing = _STOP[raw[ends - 1]] if len(ends) else np.zeros(0, dtype=bool)
        while len(starts):  # one mark off each end a turn
            front = (ends - starts > 0) & _STRIP[raw[np.minimum(starts, len(raw) - 1)]]
            starts = starts + front
            back = (ends - starts > 0) & _STRIP[raw[ends - 1]]
            ends = ends - back
            if not (front.any() or back.any()):
                break
        full = ends > starts
        # a blank of marks only is no word, but it can close a sentence
        stop_before = np.zeros(len(full), dtype=bool)
        stop_before[1:] = closing[:-1]
        opens = np.ones(len(full), dtype=bool)
        opens[1:] = (w.doc[1:] != w.doc[:-1]) | stop_before[1:] | (raw[w.starts[1:] - 1] == 10)
        doc, starts, ends, opens = w.doc[full], starts[full], ends[full], opens[full]
        own = _range_hashes(raw, starts, ends)
        slot = np.zeros(len(own), dtype=np.int8)
        digits = np.concatenate([[0], np.cumsum(_DIGITS[raw])])
        for k in np.flatnonzero(digits[ends] > digits[starts]):
            if _NUMBER.fullmatch(raw[starts[k] : ends[k]].tobytes()):
                slot[k] = 1
        if len(own) > 1:
            unit = np.isin(own[1:], _UNIT_HASHES) & (slot[:-1] == 1) & (doc[1:] == doc[:-1])
            slot[1:][unit & (slot[1:] == 0)] = 2
        if len(own):
            inner = np.maximum(ends - starts - 1, 0)
            upper = np.concatenate([[0], np.cumsum(_UPPER[raw])])
            name = _UPPER[raw[starts]] & ~opens & (inner > 0) & (upper[ends] - upper[starts] == 1)
            slot[name & (slot == 0)] = 3
        canon = np.where(slot == 0, own, np.choose(slot, [U64(0), NUM, UNIT, NAME]))
        first = np.searchsorted(doc, np.arange(w.hi - w.lo + 1))
        yield Words(w.lo, w.hi, starts, ends, doc, first, canon, raw, w.base), canon, slot, own


def _range_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of lower-cased byte ranges, as ``words`` gives them."""
    from .kernel import LOWER, _power_table

    if not len(starts):
        return np.zeros(0, dtype=U64)
    length = ends - starts
    at = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(at, length)
    kept = LOWER[raw[np.repeat(starts, length) + place]]
    with np.errstate(over="ignore"):
        h = np.add.reduceat((kept.astype(U64) + U64(1)) * _power_table(int(length.max()) + 1)[place], at)
        return mix(h + length.astype(U64))


def _literals(slot: np.ndarray, window: int) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(slot == 0)])
    return c[window:] - c[:-window] if len(slot) >= window else c[:0]


def _forms(canon: np.ndarray, slot: np.ndarray, own: np.ndarray, size: int, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Keys of all windows of ``size`` words, which of them are usable, and the slots they have: canonical, with names as words, and all as words if little else is left."""
    plain = np.where(slot == 3, 0, slot)
    lit, plain_lit = _literals(slot, size), _literals(plain, size)
    if len(lit):
        yield _key(canon, size, window), lit >= LEAST_LITERALS, slot
        # without a name both are one
        yield _key(np.where(slot == 3, own, canon), size, window), (plain_lit > lit) & (plain_lit >= LEAST_LITERALS), plain
        yield _key(own, size, window), plain_lit < LEAST_LITERALS, np.zeros_like(slot)


def _key(hashes: np.ndarray, size: int, window: int) -> np.ndarray:
    return grams(hashes, size) if size == window else _short_key(hashes, size)


_COLUMNS = [("key", pa.int64()), ("id", pa.int64()), ("at", pa.int64()), ("width", pa.int32()), ("form", pa.int32()), ("slots", pa.list_(pa.int64()))]
_SCHEMA = "key long, id long, at long, width int, form int, slots array<long>"


def _cut(batches: Iterator[pa.RecordBatch], window: int, passes, short: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """Windows of texts. slots: offset, type and value hash of each placeholder in the window, flat.

    ``passes``: the benchmark's windows as a sorted array or a bit table (a broadcast), or None for all.
    ``short``: widths below the window that items have as a whole; a text gives its windows of those widths too.
    """
    table = passes.value if passes is not None else None
    for batch in batches:
        key, ids, places, widths, form, slots = [], [], [], [], [], []
        names = batch.column(0).to_pylist()
        for w, _canon, slot, own in canonical(as_bytes(batch.column(1))):
            rows = []
            if table is not None:
                # a text of a few words matches an item that is the same as a whole
                few = np.flatnonzero((np.diff(w.first) > 0) & (np.diff(w.first) < LEAST_LITERALS))
                for i in few:
                    s = w.of(i)
                    h = _few(own[s])
                    if _passes(h, table)[0]:
                        rows.append((s.start, int(i), int(h[0].astype(np.int64)), s.stop - s.start, 2, np.zeros(s.stop - s.start, dtype=np.int8)))
                for size in (window, *(k for k in short if k >= LEAST_LITERALS)):
                    for f, (h, usable, kinds) in enumerate(_forms(w.hashes, slot, own, size, window)):
                        # all windows of the block at once; those that reach over two texts go
                        at = np.flatnonzero(usable & (w.doc[: len(h)] == w.doc[size - 1 : size - 1 + len(h)]))
                        at = at[_passes(h[at], table)]
                        rows += [(int(k), int(w.doc[k]), int(h[k].astype(np.int64)), size, f, kinds[k : k + size]) for k in at]
            else:
                for i in range(w.hi - w.lo):
                    s, first = w.of(i), int(w.first[i])
                    size = min(window, s.stop - s.start)
                    if size == 0:
                        continue
                    if size < LEAST_LITERALS:
                        rows.append((first, i, int(_few(own[s])[0].astype(np.int64)), size, 2, np.zeros(size, dtype=np.int8)))
                        continue
                    for f, (h, usable, kinds) in enumerate(_forms(w.hashes[s], slot[s], own[s], size, window)):
                        rows += [(first + int(k), i, int(h[k].astype(np.int64)), size, f, kinds[k : k + size]) for k in np.flatnonzero(usable)]
                    if s.stop - s.start == size and slot[first] == 0 and _UPPER[w.raw[w.starts[first]]] and (slot[s] == 0).sum() >= LEAST_LITERALS:
                        # inside a text's sentence the first word would pass for a name
                        named, kinds = w.hashes[s].copy(), slot[s].copy()
                        named[0], kinds[0] = NAME, 3
                        rows.append((first, i, int(_key(named, size, window)[0].astype(np.int64)), size, 0, kinds))
            for k, i, v, width, f, kinds in rows:
                at_slots = np.flatnonzero(kinds)
                key.append(v)
                ids.append(names[w.lo + i])
                places.append(k - int(w.first[i]))
                widths.append(width)
                form.append(f)
                slots.append([x for o in at_slots for x in (int(o), int(kinds[o]), int(own[k + o].astype(np.int64)))])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip((key, ids, places, widths, form, slots), _COLUMNS, strict=True)], names=[n for n, _ in _COLUMNS])


def _short_key(hashes: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(grams(hashes, n) + U64(n))


def _few(own: np.ndarray) -> np.ndarray:
    """Key of a whole text of fewer than LEAST_LITERALS words."""
    with np.errstate(over="ignore"):
        return mix(whole(own) + U64(0xFE3))


def _passes(h: np.ndarray, table) -> np.ndarray:
    kind, t = table
    if kind == "set":
        at = np.minimum(np.searchsorted(t, h), len(t) - 1)
        return t[at] == h
    bit = h & U64(FILTER_BITS - 1)
    return (t[(bit >> U64(3)).astype(np.int64)] >> (bit & U64(7)).astype(np.uint8)) & 1 == 1


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for batch in batches:
        bit = batch.column("key").to_numpy().view(U64) & U64(FILTER_BITS - 1)
        np.bitwise_or.at(table, (bit >> U64(3)).astype(np.int64), (U64(1) << (bit & U64(7))).astype(np.uint8))
    yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], names=["bits"])


def _filter(keys: DataFrame):
    """What lets a window through before the join: all benchmark windows if they are few, else a bit table made from them."""
    n = keys.count()
    if n == 0:
        return None
    if n <= FILTER_WINDOWS:
        return "set", np.sort(np.array([r[0] for r in keys.collect()], dtype=np.int64).view(U64))
    table = np.zeros(FILTER_BITS // 8, dtype=np.uint8)  # 32 MB, whatever the benchmark
    parts = keys.repartition(FILTER_TASKS).mapInArrow(_bits, "bits binary")
    for r in parts.toLocalIterator():  # one table a task
        table |= np.frombuffer(r["bits"], dtype=np.uint8)
    return "bits", table


def _consistent(slots: list[tuple[int, int, int, int]]) -> bool:
    """slots: place, type, value in the item, value in the text. Whether values map one to one within a type."""
    there: dict = {}
    back: dict = {}
    for _, kind, a, b in slots:
        if there.setdefault((kind, a), b) != b or back.setdefault((kind, b), a) != a:
            return False
    return True


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches sorted by text, item, diagonal, place and form -> one row for each alignment, in one pass.

    Windows that match only as words (form 1) are held against those without names, and never make the others inconsistent.
    """
    names = ["doc_id", "item_id", "diagonal", "first", "last", "windows", "consistent"]
    types = [pa.int64()] * 6 + [pa.bool_()]

    def packed(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    now, out = None, []

    def closed():
        return (*now["key"], now["first"], now["last"], now["n"], any(now["any"][k] and _consistent([(p, *v) for p, v in sorted(now["slots"][k].items())]) for k in (0, 1)))

    for batch in batches:
        for d, i, g, at, width, form, a, b in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "item_id", "diagonal", "at", "width", "form", "item_slots", "doc_slots")), strict=True):
            if now is None or now["key"] != (d, i, g):
                if now is not None:
                    out.append(closed())
                now = {"key": (d, i, g), "first": at, "last": at + width, "n": 0, "at": None, "any": [False, False], "slots": ({}, {})}
                if len(out) >= 5000:
                    yield packed(out)
                    out = []
            if form and now["at"] == (at, width, 0):
                continue  # it matches with its names as names
            now["last"], now["n"], now["at"] = max(now["last"], at + width), now["n"] + (now["at"] != (at, width, form)), (at, width, form)
            now["any"][form] = True
            for to in (1,) if form else (0,) if 3 in a[1::3] else (0, 1):
                for k in range(0, len(a), 3):
                    now["slots"][to][at + a[k]] = (a[k + 1], a[k + 2], b[k + 2])
    if now is not None:
        out.append(closed())
    if out:
        yield packed(out)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Pairs of a text and a benchmark item that it holds, whole or in part, possibly with other values.

    Returns doc_id, item_id, diagonal (place in the text less place in the item),
    first and last (words of the text matched), windows (matched) and consistent.
    A pair with a consistent row is contamination.  An item shorter than
    ``window`` counts as one window of its length.  Windows with fewer than
    LEAST_LITERALS words that are no placeholders match only with their own
    values.  Items with fewer words than that match only texts that are the same
    words and no more; null and empty texts match nothing.  Rows without id are
    not reported.  Repeated rows of one id count once.  Long texts and texts
    with many matches are one row a match.  Ids are integers; a text id that is
    no number stops the run.  Other columns are ignored; without texts or items
    there are no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    cut = scratch.save(items.mapInArrow(partial(_cut, window=window, passes=None, short=()), _SCHEMA), "items")
    table = _filter(cut.select("key").distinct())
    schema = "doc_id long, item_id long, diagonal long, first long, last long, windows long, consistent boolean"
    if table is None:
        return spark.createDataFrame([], schema)
    short = tuple(sorted(r[0] for r in cut.where(F.col("width") < window).select("width").distinct().collect()))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.mapInArrow(partial(_cut, window=window, passes=spark.sparkContext.broadcast(table), short=short), _SCHEMA)
    left = found.select("key", F.col("id").alias("doc_id"), "at", "width", F.col("form").alias("doc_form"), F.col("slots").alias("doc_slots"))
    right = cut.select("key", F.col("id").alias("item_id"), F.col("at").alias("item_at"), F.col("width").alias("w"), F.col("form").alias("item_form"), F.col("slots").alias("item_slots")).dropDuplicates(["key", "item_id", "item_at", "w"])
    matched = left.join(right, "key").where("width = w").select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal"), "at", "width", (F.greatest("doc_form", "item_form") > 0).cast("int").alias("form"), "item_slots", "doc_slots")
    matched = matched.repartition("doc_id", "item_id", "diagonal").sortWithinPartitions("doc_id", "item_id", "diagonal", "at", "width", "form")
    return matched.mapInArrow(_check, schema)
