"""License notices by conditional compression.

Adjacent lines with words are one paragraph, so a wrapped notice is whole; lines and their lengths
have no other meaning. Over each paragraph with a cue word slide windows as long as each wording, and
where a window has enough of its words, the span that aligns best is a candidate block. A candidate
is compressed on its own and with every wording as zstandard's raw dictionary, and the wordings are
ranked by the share of bytes they save. In that order they are confirmed by their exact differences
in words: what the block adds to, lacks of and keeps of a wording. A short wording's own words, which
no other license has, must be there. Years, versions and variant letters tell licenses apart, so of
blocks that overlap the one that agrees in most words less those that differ wins, then the better
ranked. No wording is left out for its rank.

Each text is read whole in one pass without a shuffle. Defined cases: null and empty texts have no
candidates; equal ranks go to the smaller name; repeated rows each get a row; an empty table gives
none; other columns are ignored.
"""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import values
from .license_texts import WORDINGS

# Words one of which every wording has.
CUES = re.compile(r"licen[cs]e|copyright|\brights\s+reserved|permission|permitted|redistribut|public\s+domain|\bcc0?\b|as\s+is", re.I)
#: A block's share of a wording's words, and the other way round, that confirm it.
SHARE = 0.8
#: In wordings of up to so many words, those that only one license has must be there.
SHORT_WORDS = 12
_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


@dataclass
class Match:
    block: str
    license: str
    saved: float
    missing: tuple[str, ...]  # words of the wording that the block lacks
    added: tuple[str, ...]


def words(text: str) -> list[str]:
    return [w.casefold() for w in _WORD.findall(text)]


def plain(text: str) -> bytes:
    """What is compressed: letters in one case, white space as single spaces."""
    return " ".join(text.casefold().split()).encode()


class Matcher:
    def __init__(self, wordings: dict[str, tuple[str, ...]] = WORDINGS, level: int = 3):
        self.plain = zstandard.ZstdCompressor(level=level)
        self.items = []
        for name, texts in sorted(wordings.items()):
            for text in texts:
                d = zstandard.ZstdCompressionDict(plain(text), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                self.items.append((name, words(text), zstandard.ZstdCompressor(level=level, dict_data=d)))
        users: dict[str, set[str]] = {}
        for name, wording, _ in self.items:
            for w in wording:
                users.setdefault(w, set()).add(name)
        self.known = frozenset(users)
        self.own = [{w for w in wording if len(users[w]) == 1} if len(wording) <= SHORT_WORDS else set() for _, wording, _ in self.items]

    def ranked(self, block: str) -> list[tuple[float, str, int]]:
        """All wordings by the share of the block's bytes that they save: (- saved, license, number)."""
        raw = plain(block)
        alone = len(self.plain.compress(raw))
        return sorted((-(alone - len(c.compress(raw))) / alone, name, i) for i, (name, _, c) in enumerate(self.items))

    def spans(self, text: str) -> tuple[int, list[tuple[int, int, Match]]]:
        """How many candidate blocks a paragraph has, and its notices with where they begin and end."""
        at = [(m.start(), m.end()) for m in _WORD.finditer(text)]
        own = [text[a:b].casefold() for a, b in at]
        total = Counter(w for w in own if w in self.known)
        candidates: dict[tuple[int, int], dict[int, tuple]] = {}
        for i, (_, wording, _) in enumerate(self.items):
            need = Counter(wording)
            if sum(min(n, total[w]) for w, n in need.items()) >= SHARE * len(wording) and all(w in total for w in self.own[i]):
                for a, b, same, missing, added in _aligned(own, wording, need):
                    candidates.setdefault((a, b), {})[i] = (same, missing, added)
        found = []
        for (a, b), alike in candidates.items():
            block = text[at[a][0] : at[b - 1][1]]
            for saved, name, i in self.ranked(block):
                if i in alike and self.own[i].isdisjoint(alike[i][1]):
                    same, missing, added = alike[i]
                    found.append((len(missing) + len(added) - same, saved, name, a, b, Match(block, name, -saved, missing, added)))
        out: list[tuple[int, int, Match]] = []
        for *_, a, b, m in sorted(found, key=lambda f: f[:5]):
            if all(b <= x or a >= y for x, y, _ in out):
                out.append((a, b, m))
        return len(candidates), [(at[a][0], at[b - 1][1], m) for a, b, m in sorted(out, key=lambda f: f[:2])]


def _aligned(own: list[str], wording: list[str], need: Counter) -> Iterator[tuple[int, int, int, tuple[str, ...], tuple[str, ...]]]:
    """Spans of words that agree with a wording: begin, end, equal words, missing and added ones."""
    m, long = len(wording), math.ceil(len(wording) / SHARE)
    least = SHARE * m
    # overlap[i]: words of the window from i that the wording has too, each as often as there
    have: Counter = Counter()
    n, overlap = 0, []
    for j in range(len(own) + long - 1):
        if j < len(own) and own[j] in need:
            have[own[j]] += 1
            n += have[own[j]] <= need[own[j]]
        if j >= long and own[j - long] in need:
            n -= have[own[j - long]] <= need[own[j - long]]
            have[own[j - long]] -= 1
        if j >= long - 1:
            overlap.append(n)
    at = 0
    while at < len(overlap):
        if overlap[at] < least:
            at += 1
            continue
        a = max(range(at, min(at + long, len(overlap))), key=lambda i: (overlap[i], -i))
        window = own[a : a + long]
        blocks = difflib.SequenceMatcher(None, window, wording, autojunk=False).get_matching_blocks()[:-1]
        best: tuple | None = None
        for x in range(len(blocks)):
            same = 0
            for y in range(x, len(blocks)):
                same += blocks[y].size
                size = blocks[y].a + blocks[y].size - blocks[x].a
                if same >= least and same >= SHARE * size:
                    got = (size + m - 2 * same, x, y)
                    best = got if best is None or got < best else best
        if best is None:
            at = a + 1
            continue
        kept = blocks[best[1] : best[2] + 1]
        begin, end = kept[0].a, kept[-1].a + kept[-1].size
        in_span = {i for k in kept for i in range(k.a, k.a + k.size)}
        in_wording = {i for k in kept for i in range(k.b, k.b + k.size)}
        yield a + begin, a + end, len(in_span), tuple(wording[i] for i in range(m) if i not in in_wording), tuple(window[i] for i in range(begin, end) if i not in in_span)
        at = a + end


def paragraphs(text: str) -> list[str]:
    """Lines joined with those next to them; a line without a word parts them."""
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        if _WORD.search(line):
            out[-1].append(line)
        elif out[-1]:
            out.append([])
    return ["\n".join(p) for p in out if p]


def notices(text: str | None, matcher: Matcher, seen: dict[str, tuple[int, list[Match]]] | None = None) -> tuple[int, list[Match]]:
    """How many candidate blocks a text has, and the notices found. seen: paragraphs matched before."""
    seen = {} if seen is None else seen
    n, found = 0, []
    for paragraph in paragraphs(text) if text and CUES.search(text) else ():
        if not CUES.search(paragraph):
            continue
        if paragraph not in seen:
            if len(seen) > 10_000:
                seen.clear()
            here, spans = matcher.spans(paragraph)
            got = (here, [m for _, _, m in spans])
            if len(paragraph) < 2000:  # short ones come again, long ones would only fill memory
                seen[paragraph] = got
        else:
            got = seen[paragraph]
        n += got[0]
        found += got[1]
    return n, found


_matcher: Matcher | None = None


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    global _matcher
    _matcher = _matcher or Matcher()
    seen: dict[str, tuple[int, list[Match]]] = {}
    for batch in it:
        out = []
        for text in values(batch.column(1)):
            n_blocks, found = notices(text, _matcher, seen)
            names = sorted({m.license for m in found})
            out.append((n_blocks, len(found), ",".join(names) or None, max((m.saved for m in found), default=None), sum(len(m.missing) + len(m.added) for m in found)))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64())
        cols = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(cols, kinds)]], ["id", "n_candidates", "n_confirmed", "licenses", "best_saved", "n_differing_words"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_candidates, n_confirmed, licenses (sorted, comma-joined, or null),
    best_saved, n_differing_words."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_batches, "id long, n_candidates long, n_confirmed long, licenses string, best_saved double, n_differing_words long")
    return out.withColumnRenamed("id", id_col)
