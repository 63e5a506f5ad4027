"""Removal of passages that an earlier document has, by recompression.

A window is WINDOW consecutive words. A word goes when a window over it also starts in a document
with a smaller id. To find such windows without shuffling every one of them:

1. Rounds of recompression (recompression.py) name runs and pairs of symbols, from words up. Equal
   content has equal names on all machines, and a symbol recurs wherever the words that it depends
   on recur. Each window takes the symbol of the highest level, then of the least name, among those
   whose context lies in it. So equal windows take equal symbols, at the same place in them, and
   neighbouring windows mostly the same one: a text has a row for each 19 words or so. A window that
   no round has named a symbol in (long runs) stands for itself.
2. A round over all documents finds the symbols that at least two of them have, by a partial
   aggregation over names; all other rows end there.
3. A second one names each shared symbol with the words on both sides as far as its windows reach: a
   class. All windows of a member recur in the class's smallest document, so for all others they go
   at once. However often a passage is copied, one member of a class goes on.
4. Only where a symbol has several classes - at the ends of a repeat - the windows of one member of
   each are named singly (128 bits), and the smallest document of each window is found.
5. Windows of one row that recur in one other row at one distance are a stretch. The other row's
   words of it travel to the row, and a stretch goes only if the words are the same.

Texts travel only if a window of theirs may recur: the rows in question are put in a sieve of a fixed
number of bits, which goes to all executors; what it lets through for nothing ends in the join.

Defined cases: a null text has no words; texts shorter than a window lose nothing; repeats inside a
document or among rows with one id lose nothing; a row with a null id neither loses words nor takes
them from others; repeated rows each get a row; an empty table gives none; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, join_apart, utf8, values, words_of
from .recompression import Spans, U, mix, recompress, word_hashes

WINDOW = 50
#: Rounds of recompression: four make symbols of about five words, known from about twenty.
ROUNDS = 4
#: Words that are worked on at once; a longer text is worked on alone.
CHUNK_WORDS = 200_000
#: Bits of the sieve; it is a table of 64 bits a row.
SIEVE_BITS = 1 << 25
_FOUND = pa.list_(pa.struct([("at", pa.int64()), ("words", pa.string())]))
_LOW32 = U(0xFFFFFFFF)
_NO_SYMBOL = U(0xFFFFFFFFFFFFFFFF)


class _Least:
    """At each place the least of the values put over it. An interval is two that overlap, of a power
    of two places each, and those are handed down to their halves at the end."""

    def __init__(self, n: int, longest: int):
        self.of = [np.full(n, _NO_SYMBOL, dtype=np.uint64) for _ in range(longest.bit_length())]

    def put(self, first: np.ndarray, last: np.ndarray, value: np.ndarray) -> None:
        power = np.log2(last - first + 1).astype(np.int64)
        for k, least in enumerate(self.of):
            m = power == k
            np.minimum.at(least, first[m], value[m])
            np.minimum.at(least, last[m] + 1 - (1 << k), value[m])

    def all(self) -> np.ndarray:
        for k in range(len(self.of) - 1, 0, -1):
            half, above, below = 1 << (k - 1), self.of[k], self.of[k - 1]
            np.minimum(below, above, out=below)
            below[half:] = np.minimum(below[half:], above[: len(above) - half])
        return self.of[0]


def shared_symbols(texts: list[list[bytes]], window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """Rows of word lists: (which text, symbol's name, name of symbol and surroundings, first window's
    start, last window's start), windows counted from the text's first word. Of the equal windows of
    a run of one word only the first is there."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    text = np.repeat(np.arange(len(texts)), sizes)
    hashes = word_hashes([w for t in texts for w in t])
    spans = Spans(hashes)
    least = _Least(len(hashes), window)
    place = np.zeros((2 * rounds + 1, len(hashes)), dtype=np.int64)  # of the symbol of a level that starts at a word
    names, lows, highs = ([np.zeros(1, t)] for t in (np.uint64, np.int64, np.int64))
    n_symbols = 1
    for level, s in enumerate(recompress(hashes, text, rounds), 1):
        first = np.maximum(s.high - window, begins[s.text])
        last = np.minimum(s.low, ends[s.text] - window)
        fits = (s.high - s.low <= window) & (first <= last)
        s, first, last = s.take(fits), first[fits], last[fits]
        # the highest level first, then the least name, then the first place
        least.put(first, last, (U(2 * rounds - level) << U(56)) | ((s.name >> U(40)) << U(32)) | s.start.astype(np.uint64))
        place[level, s.start] = n_symbols + np.arange(len(s.name))
        n_symbols += len(s.name)
        for to, x in ((names, mix(s.name ^ mix(spans.name(s.low, s.high, 0)))), (lows, s.low), (highs, s.high)):
            to.append(x)
    names, lows, highs = map(np.concatenate, (names, lows, highs))
    p = np.arange(len(hashes), dtype=np.int64)
    p = p[p + window <= ends[text]]
    best = least.all()[p]
    own = best == _NO_SYMBOL
    at = np.zeros(len(p), dtype=np.int64)  # the symbol of each window
    at[~own] = place[2 * rounds - (best[~own] >> U(56)).astype(np.int64), (best[~own] & _LOW32).astype(np.int64)]
    key = names[at]
    key[own] = ~spans.name(p[own], p[own] + window, 0)
    head = np.ones(len(p), dtype=bool)
    head[1:] = (p[1:] != p[:-1] + 1) | (text[p[1:]] != text[p[:-1]]) | (key[1:] != key[:-1]) | (at[1:] != at[:-1])
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(p)) - 1
    own, at, key, p1, p2 = own[first], at[first], key[first], p[first], p[last]
    p2 = np.where(own, p1, p2)  # a run of one word: its first window stands for all
    which = text[p1]
    low = np.where(own, p1, np.maximum(begins[which], highs[at] - window))
    high = np.where(own, p1 + window, np.minimum(ends[which], lows[at] + window))
    around = spans.name(low, high, 1) ^ (spans.name(low, np.where(own, p1, lows[at]), 0) * U(3))
    return which, key, around, p1 - begins[which], p2 - begins[which]


def _chunks(rows: Iterator[tuple], words_at: int) -> Iterator[list[tuple]]:
    chunk, size = [], 0
    for row in rows:
        chunk.append(row)
        size += len(row[words_at])
        if size >= CHUNK_WORDS:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _column(batch: pa.RecordBatch, name: str) -> Iterator:
    col = batch.column(name)
    return utf8(col) if pa.types.is_string(col.type) else values(col)


def _symbol_batches(window: int):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = map(words_of, utf8(batch.column("text")))
            rows = (x for x in zip(batch.column("id").to_numpy(), batch.column("row").to_numpy(), texts) if len(x[2]) >= window)
            for chunk in _chunks(rows, 2):
                which, key, around, p1, p2 = shared_symbols([x[2] for x in chunk], window)
                ids = np.array([x[:2] for x in chunk], dtype=np.int64)[which]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ascontiguousarray(ids[:, i])) for i in range(2)]
                    + [pa.array(key.view(np.int64)), pa.array(around.view(np.int64)), pa.array(p1.astype(np.int32)), pa.array(p2.astype(np.int32))],
                    ["id", "row", "key", "around", "p1", "p2"],
                )
        give_back()

    return batches


def _window_batches(window: int):
    """Rows with text and places (p1 * 2^32 + p2): the two names of each window that starts there."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for id_, row, text, places in zip(*(_column(batch, c) for c in ("id", "row", "text", "places"))):
                spans = Spans(word_hashes(words_of(text)))
                p = np.unique(np.concatenate([np.arange(x >> 32, (x & 0xFFFFFFFF) + 1) for x in places]))
                n = len(p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, id_)), pa.array(np.full(n, row))]
                    + [pa.array(spans.name(p, p + window, k).view(np.int64)) for k in (0, 1)]
                    + [pa.array(p.astype(np.int32))],
                    ["id", "row", "h1", "h2", "p"],
                )

    return batches


def _reference_batches(window: int):
    """Rows with text, and a row that asks for places in it by its own and their shifts: the words of
    each stretch of windows that overlap or touch, and where it lies in the row that asks."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            last, words = None, []
            for name, text, id_, row, places in zip(*(_column(batch, c) for c in ("name", "text", "id", "row", "places"))):
                if name != last:
                    last, words = name, words_of(text)
                shifted: dict[int, list[int]] = {}
                for x in places:
                    shifted.setdefault(x["shift"], []).append(x["place"])
                found = [{"at": a, "words": b" ".join(words[a - n : b - n]).decode()} for n, some in sorted(shifted.items()) for a, b in stretches(some, window)]
                yield pa.RecordBatch.from_arrays([pa.array([id_], pa.int64()), pa.array([row], pa.int64()), pa.array([found], _FOUND)], ["id", "row", "found"])

    return batches


def stretches(places: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """Begin and end of the words that windows cover which start at places (first * 2^32 + last)."""
    out: list[list[int]] = []
    for x in sorted(places):
        a, b = x >> 32, (x & 0xFFFFFFFF) + window
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def removed(words: list[bytes], found, window: int) -> np.ndarray:
    """Of each word whether it lies in a stretch whose words are those of its reference, or in a run of
    one word of which such a stretch holds a window."""
    gone = np.zeros(len(words), dtype=bool)
    for f in found or ():
        again = f["words"].encode().split()
        a, b = f["at"], f["at"] + len(again)
        if words[a:b] != again:
            continue
        gone[a:b] = True
        at = a
        while at + window <= b:
            end = at + 1
            while end < b and words[end] == words[at]:
                end += 1
            if end - at >= window:
                left, right = at, end
                while left and words[left - 1] == words[at]:
                    left -= 1
                while right < len(words) and words[right] == words[at]:
                    right += 1
                gone[left:right] = True
            at = end
    return gone


def _kept_batches(window: int, with_text: bool):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out = []
            for text, found in zip(_column(batch, "text"), _column(batch, "found")):
                words = words_of(text)
                gone = removed(words, found, window)
                n_gone = int(gone.sum())
                left = b" ".join(w for w, g in zip(words, gone) if not g) if n_gone else b" ".join(words)
                digest = hashlib.sha256(left).hexdigest()
                out.append((len(words), n_gone, left.decode("utf-8", "replace") if with_text else digest))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.string())],
                ["id", "n_words", "n_removed", "kept"],
            )

    return batches


def _sieved(t: DataFrame, rows: DataFrame) -> DataFrame:
    """t with `hit`: false only for rows that are certainly not among rows (id, row)."""
    slot = F.pmod(F.xxhash64("id", "row"), F.lit(SIEVE_BITS))
    word, bit = F.shiftright(slot, 6), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id, row), {SIEVE_BITS}) & 63 as int))")
    sieve = cut(rows.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("mask")))  # SIEVE_BITS / 64 rows at most
    met = t.join(F.broadcast(sieve), word == F.col("word"), "left")
    return met.withColumn("hit", F.coalesce(F.col("mask").bitwiseAND(bit) != 0, F.lit(False))).drop("word", "mask")


def _place(p1: str, p2: str):
    return F.shiftleft(F.col(p1).cast("long"), 32).bitwiseOR(F.col(p2).cast("long"))


def _selected(repeats: DataFrame, p1: str, p2: str) -> DataFrame:
    """Windows of a row that recur in the row ref, whose place there is `shift` words before."""
    return repeats.select("id", "row", _place(p1, p2).alias("place"), F.col("ref.id").alias("ref_id"), F.col("ref.row").alias("ref_row"), (F.col(p1) - F.col("ref.p")).alias("shift"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: id, n_words, n_removed, and kept_sha256 (or kept_text, with_text)."""
    if window < 1:
        raise ValueError("a window has at least one word")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # An id may come twice, with other texts: its text's hash tells such rows apart.
    t = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("row"), text.alias("text"))
    rows = cut(t.filter("id is not null").mapInArrow(_symbol_batches(window), "id long, row long, key long, around long, p1 int, p2 int"))
    shared = cut(rows.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("key"))
    met = cut(rows.join(shared, "key"))
    first = lambda p: F.min(F.struct("id", "row", F.col(p).alias("p"))).alias("ref")
    classes = cut(met.groupBy("key", "around").agg(first("p1")))
    many = cut(classes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"))
    placed = met.join(classes, ["key", "around"])
    at_once = _selected(placed.filter("ref.id < id"), "p1", "p2")
    ends = placed.filter("ref.id = id").join(many, "key").groupBy("id", "row").agg(F.collect_set(_place("p1", "p2")).alias("places"))
    ends = cut(ends)
    single = join_apart(_sieved(t, ends).filter("hit"), ends, ["row", "id"]).mapInArrow(_window_batches(window), "id long, row long, h1 long, h2 long, p int")
    recurring = single.groupBy("h1", "h2").agg(first("p"), F.max("id").alias("b")).filter("ref.id < b")
    later = _selected(join_apart(single, recurring, ["h1", "h2"]).filter("ref.id < id"), "p", "p")
    asked = cut(at_once.unionAll(later).groupBy("id", "row", "ref_id", "ref_row").agg(F.collect_set(F.struct("shift", "place")).alias("places")))

    refs = _sieved(t, asked.select(F.col("ref_id").alias("id"), F.col("ref_row").alias("row"))).filter("hit")
    refs = refs.select(F.col("id").alias("ref_id"), F.col("row").alias("ref_row"), "text").dropDuplicates(["ref_id", "ref_row"])
    wanted = join_apart(asked, refs, ["ref_row", "ref_id"]).select(F.struct("ref_id", "ref_row").alias("name"), "text", "id", "row", "places")
    found = wanted.mapInArrow(_reference_batches(window), "id long, row long, found array<struct<at: bigint, words: string>>")
    found = found.groupBy("id", "row").agg(F.flatten(F.collect_list("found")).alias("found"))

    t = _sieved(t, asked.select("id", "row"))
    clean = t.filter("not hit").select("id", "text", F.lit(None).cast("array<struct<at: bigint, words: string>>").alias("found"))
    touched = join_apart(t.filter("hit"), found, ["row", "id"], "left").select("id", "text", "found")
    schema = "id long, n_words long, n_removed long, kept string"
    out = clean.mapInArrow(_kept_batches(window, with_text), schema).unionAll(touched.mapInArrow(_kept_batches(window, with_text), schema))
    return out.toDF(id_col, "n_words", "n_removed", "kept_text" if with_text else "kept_sha256")
