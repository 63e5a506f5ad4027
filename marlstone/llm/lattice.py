"""SentencePiece vocabularies as lattices, and sampling of segmentations without replacement.

The lattice of a text has an edge for each vocabulary piece that matches somewhere, and for a
character that is no piece one edge of its byte pieces. The file's pieces are a BPE's, scored by
merge rank only; a segmentation's weight is the product of (rank + 2)^-alpha over its pieces, a
Zipf law, which makes the BPE vocabulary a unigram model. No piece crosses the start of a run of
spaces or a line end, so a text's lattice is a chain of its units' lattices, and equal units of a
batch share one.

Gumbel top-k: give each segmentation its log probability plus Gumbel noise; the k largest are k
segmentations sampled without replacement. Perturbed A* search finds them without listing any
others. A search node is a set of segmentations: a common beginning and, at one state, the edges
not yet taken. Its key is the exact maximum of the noisy values inside, drawn top-down: the best
of a set goes on with the set's own value, and what is left gets a Gumbel of its own mass,
truncated by that value. Backward sums of the lattice give all masses. Taking the best node k
times emits the k segmentations in order; the next key is the threshold of the inclusion
probabilities 1 - exp(-exp(log p - threshold)).

All texts of a batch are searched together, one array step for the next edge of every open unit.
Noise comes from hashes of (row key, sample, unit, step), so neither batching nor machine matters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import sentencepiece

from .recompression import U, mix

SPACE = "▁"
ALPHA = 1.0
#: Units whose lattices are kept between batches at most.
MOST_KEPT = 30_000
_NEG = -np.inf


def _unit_pattern(pieces: list[str]) -> re.Pattern:
    """A unit is SPACE characters and a run of characters that pieces join. Characters that stand side
    by side in a piece are joined, and so on; no piece then crosses from one such class to another,
    and a text may be cut there. Only classes with ASCII characters are told apart from the rest."""
    parent: dict[str, str] = {}

    def root(c: str) -> str:
        while parent.setdefault(c, c) != c:
            parent[c] = c = parent[parent[c]]
        return c

    for piece in pieces:
        for a, b in zip(piece, piece[1:]):
            if SPACE not in (a, b):
                parent[root(a)] = root(b)
    classes: dict[str, list[str]] = {}
    for c in sorted(parent):
        classes.setdefault(root(c), []).append(c)
    small = sorted(classes.values(), key=len)[:-1]
    named = [c for c in small if any(x.isascii() for x in c)]
    every = re.escape("".join(x for c in named for x in c))
    runs = "|".join([f"[{re.escape(''.join(c))}]+" for c in named] + [f"[^▁\\n{every}]+"])
    return re.compile(f"\n|▁*(?:{runs})|▁+")


class _HashTable:
    """Non-negative int64 keys to values, looked up by arrays; -1 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length() + 3)
        self.keys = np.full((1 << self.bits) + 64, -1, dtype=np.int64)
        self.values = np.full((1 << self.bits) + 64, -1, dtype=np.int64)
        left = np.arange(len(keys))
        step = 0
        while len(left):
            at = self._home(keys[left]) + step
            free = self.keys[at] == -1
            place, first = np.unique(at[free], return_index=True)
            put = left[free][first]
            self.keys[place], self.values[place] = keys[put], values[put]
            left = left[~np.isin(left, put)]
            step += 1
            if step > 60:
                raise ValueError("too many equal hashes")
        self.steps = step

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._home(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.values[at], -1)
        for step in range(1, self.steps):
            open_ = np.flatnonzero((got != keys) & (got != -1))
            if not len(open_):
                break
            there = at[open_] + step
            got[open_] = self.keys[there]
            out[open_] = np.where(got[open_] == keys[open_], self.values[there], -1)
        return out


class Vocabulary:
    """Pieces of a SentencePiece model, given as the bytes of its file."""

    def __init__(self, model: bytes, alpha: float = ALPHA):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.alpha, self.size = alpha, n
        self.kept: dict[str, int] = {}
        self.kept_lattices: Lattices | None = None
        self.raw: list[bytes] = [b""] * n  # what a piece decodes to
        self.logit = np.full(n, _NEG)
        self.byte_id = np.full(256, -1, dtype=np.int64)
        trie: list[dict[str, int]] = [{}]
        final = [-1]
        pieces: list[str] = []
        for i in range(n):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            piece = sp.id_to_piece(i)
            rank = max(0.0, -sp.get_score(i))
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
                self.logit[i] = -alpha * np.log(n + 2.0)
                continue
            self.raw[i] = piece.replace(SPACE, " ").encode()
            self.logit[i] = -alpha * np.log(rank + 2.0)
            if "\n" in piece or SPACE in piece.lstrip(SPACE):
                raise ValueError(f"piece {piece!r} crosses units")
            pieces.append(piece)
            at = 0
            for ch in piece:
                if ch not in trie[at]:
                    trie[at][ch] = len(trie)
                    trie.append({})
                    final.append(-1)
                at = trie[at][ch]
            final[at] = i
        self.raw_array = np.array(self.raw, dtype=object)
        self.unit = _unit_pattern(pieces)
        moves = sorted((node << 21 | ord(ch), to) for node, edges in enumerate(trie) for ch, to in edges.items())
        self.moves = _HashTable(np.array([m[0] for m in moves], dtype=np.int64), np.array([m[1] for m in moves], dtype=np.int64))
        self.final = np.array(final, dtype=np.int64)
        first = np.full(0x110000, -1, dtype=np.int32)  # the first step from the root, by character
        for ch, to in trie[0].items():
            first[ord(ch)] = to
        self.first = first

    def units(self, text: str) -> list[str]:
        return self.unit.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def decode(self, ids) -> bytes:
        """Pieces to text, as UTF-8. A SPACE character of the text comes back as a space."""
        return b"".join(self.raw_array[ids].tolist())[1:]


class _Numbers(dict):
    """Numbers its keys as they come up."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


@dataclass
class Lattices:
    """Lattices of units in one state space. State s has edges ptr[s] to ptr[s + 1]; a unit starts
    at start[u] and ends in a state without edges. p and logp are probabilities given the state."""

    start: np.ndarray
    ptr: np.ndarray
    to: np.ndarray
    piece: np.ndarray  # >= 0: a piece; else -1 - code point, spelled in bytes
    p: np.ndarray
    logp: np.ndarray
    cum: np.ndarray  # probability of the state's edges up to this one


def build(vocab: Vocabulary, units: list[str]) -> Lattices:
    n_units = len(units)
    sizes = np.fromiter(map(len, units), dtype=np.int32, count=n_units)
    codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int32)
    ends = np.cumsum(sizes, dtype=np.int32)
    unit = np.repeat(np.arange(n_units, dtype=np.int32), sizes)
    left = ends[unit] - np.arange(len(codes), dtype=np.int32)  # characters to the unit's end
    # States in order of that distance: first the ends of the units, then one before each character.
    # Edges then lead to smaller states, and a distance's edges lie together.
    longest = int(left.max(initial=0))
    order = np.argsort(left.astype(np.int16) if longest < 1 << 15 else left, kind="stable")  # 16 bits sort by radix
    state = np.empty(len(codes), dtype=np.int32)
    state[order] = np.arange(n_units, n_units + len(codes), dtype=np.int32)
    n_states = n_units + len(codes)

    node = vocab.first[codes]
    at = np.flatnonzero(node >= 0).astype(np.int32)
    node = node[at].astype(np.int64)
    found: list[tuple[np.ndarray, int, np.ndarray]] = []
    single = np.zeros(len(codes), dtype=bool)
    count = np.zeros(n_states, dtype=np.int32)
    size = 1
    while len(at):
        piece = vocab.final[node]
        hit = piece >= 0
        there = at[hit]
        found.append((there, size, piece[hit]))
        count[state[there]] += 1
        if size == 1:
            single[there] = True
        more = left[at] > size
        at, node = at[more], node[more]
        node = vocab.moves.get(node << 21 | codes[at + size])
        ok = node >= 0
        at, node = at[ok], node[ok]
        size += 1
    bare = np.flatnonzero(~single)
    found.append((bare, 1, -1 - codes[bare].astype(np.int64)))
    count[state[bare]] += 1

    # Into state order without a sort: a state's edges lie from ptr on, long pieces first - they are
    # the likely ones, so a search for an edge ends early.
    ptr = np.zeros(n_states + 1, dtype=np.int64)
    np.cumsum(count, out=ptr[1:])
    free = ptr[:-1].copy()
    piece = np.empty(int(ptr[-1]), dtype=np.int32)
    to = np.empty(int(ptr[-1]), dtype=np.int32)
    for at, size, ids in reversed(found):
        s = state[at]
        e = free[s]
        free[s] = e + 1
        piece[e] = ids
        ends_here = left[at] == size
        to[e] = np.where(ends_here, unit[at], state[np.where(ends_here, at, at + size)])
    w = vocab.logit[np.maximum(piece, 0)]
    bare = np.flatnonzero(piece < 0)
    code = piece[bare]
    w[bare] = (1 + (code < -0x80) + (code < -0x800) + (code < -0x10000)) * vocab.logit[vocab.byte_id[0]]

    # Backward sums, one distance after another.
    beta = np.zeros(n_states)
    logp, p, cum = (np.empty(len(w)) for _ in range(3))
    steps = n_units + np.cumsum(np.bincount(left, minlength=longest + 1))
    for lo, hi in zip(steps[:-1], steps[1:]):
        a, b = int(ptr[lo]), int(ptr[hi])
        if a == b:
            continue
        heads, n = ptr[lo:hi] - a, count[lo:hi]
        x = w[a:b] + beta[to[a:b]]
        top = np.maximum.reduceat(x, heads)
        x -= np.repeat(top, n)
        ex = np.exp(x)
        total = np.add.reduceat(ex, heads)
        log_total = np.log(total)
        beta[lo:hi] = top + log_total
        logp[a:b] = x - np.repeat(log_total, n)
        ex /= np.repeat(total, n)
        p[a:b] = ex
        run = np.cumsum(ex)
        cum[a:b] = run - np.repeat(run[heads] - ex[heads], n)
    cum[ptr[1:][count > 0] - 1] = 2.0  # a state's last edge takes what rounding leaves
    return Lattices(state[ends - sizes] if n_units else np.zeros(0, np.int32), ptr, to, piece, p, np.minimum(logp, 0.0), cum)


def _lattices(vocab: Vocabulary, number: dict[str, int], unit: np.ndarray) -> Lattices:
    """Of all numbered units. Units that come up twice in a batch are kept for later ones, up to a bound."""
    n_kept = len(vocab.kept)
    new = list(number)[n_kept:]
    b = build(vocab, new)
    room = MOST_KEPT - n_kept
    if room > 0:
        often = np.flatnonzero(np.bincount(unit, minlength=len(number))[n_kept:] > 1)[:room]
        more = [new[i] for i in often.tolist()]
        add = build(vocab, more)
        result = _joined(vocab.kept_lattices, b) if n_kept else b
        vocab.kept_lattices = _joined(vocab.kept_lattices, add) if n_kept else add
        vocab.kept.update((u, n_kept + i) for i, u in enumerate(more))
        return result
    return _joined(vocab.kept_lattices, b)


def _joined(a: Lattices, b: Lattices) -> Lattices:
    """b's units numbered after a's."""
    states, edges = len(a.ptr) - 1, len(a.to)
    join = np.concatenate
    return Lattices(
        join([a.start, b.start + states]), join([a.ptr[:-1], b.ptr + edges]), join([a.to, b.to + states]),
        join([a.piece, b.piece]), join([a.p, b.p]), join([a.logp, b.logp]), join([a.cum, b.cum]),
    )


def _uniform(seed: np.ndarray, a, b) -> np.ndarray:
    """In (0, 1), from hashes."""
    a, b = np.atleast_1d(np.asarray(a, dtype=np.uint64)), np.atleast_1d(np.asarray(b, dtype=np.uint64))
    x = mix(seed + a * U(0x9E3779B97F4A7C15) + b * U(0xC2B2AE3D27D4EB4F))
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _edges_at(lat: Lattices, state: np.ndarray, u: np.ndarray) -> np.ndarray:
    e = lat.ptr[state]
    on = np.flatnonzero(lat.cum[e] < u)
    while len(on):
        e[on] += 1
        on = on[lat.cum[e[on]] < u[on]]
    return e


def _walk(lat: Lattices, state: np.ndarray, seed: np.ndarray, place: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From each open unit's state to its end: (index of the unit, edge, uniform for the rest), in
    order of unit and step."""
    idx = np.flatnonzero(lat.ptr[state + 1] > lat.ptr[state])
    size = np.zeros(len(state), dtype=np.int64)
    state, steps, step = state[idx], [], 0
    seed, place = seed[idx], place[idx].astype(np.uint64)
    while len(idx):
        tag = U((sample << 40) | step * 2)
        e = _edges_at(lat, state, _uniform(seed, place, tag))
        steps.append((idx, e, _uniform(seed, place, tag + U(1))))
        size[idx] += 1
        state = lat.to[e]
        open_ = np.flatnonzero(lat.ptr[state + 1] > lat.ptr[state])
        idx, state, seed, place, step = idx[open_], state[open_], seed[open_], place[open_], step + 1
    first = np.cumsum(size) - size
    edges, rest = np.empty(int(size.sum()), dtype=np.int64), np.empty(int(size.sum()))
    for step, (idx, e, u) in enumerate(steps):
        at = first[idx] + step
        edges[at], rest[at] = e, u
    return np.repeat(np.arange(len(size)), size), edges, rest


def _truncated(mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel of location mass, known to be at most bound."""
    with np.errstate(invalid="ignore", over="ignore"):
        g = bound - np.logaddexp(0.0, np.log(-np.log(u)) + bound - mass)
    return np.where(mass == _NEG, _NEG, g)


@dataclass
class Sample:
    ids: np.ndarray
    log_prob: float
    value: float  # log_prob with its Gumbel noise
    inclusion: float


class _Text:
    """Search state of one text: emitted paths, and the k best open nodes."""

    __slots__ = ("open", "paths", "n")

    def __init__(self):
        self.open: list[tuple] = []  # (value, path, position, edges taken, their p, log mass before)
        self.paths: list[tuple] = []  # (edges, unit of each edge, log_prob, value)


def _add_nodes(texts: list[_Text], owner: np.ndarray, bound: np.ndarray, u: np.ndarray, path: list[int], pos: np.ndarray, edge: np.ndarray, lat: Lattices, before: np.ndarray, keep: int) -> None:
    """Of each text's new nodes, a node for what is left beside each edge, the `keep` largest. owner is
    sorted; bound is each text's. Truncated by one bound, Gumbels stay in the order of those not
    truncated, so only the largest are truncated."""
    if not len(owner):
        return
    heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    sizes = np.diff(np.append(heads, len(owner)))
    with np.errstate(divide="ignore"):
        free = before + np.log((1.0 - lat.p[edge]) / -np.log(u))
    for _ in range(keep):
        top = np.maximum.reduceat(free, heads)
        is_top = np.flatnonzero(free == np.repeat(top, sizes))
        is_top = is_top[free[is_top] > _NEG]
        if not len(is_top):
            return
        is_top = is_top[np.append(True, owner[is_top][1:] != owner[is_top][:-1])]
        mass = before[is_top] + np.log1p(-lat.p[edge[is_top]])
        value = _truncated(mass, bound[owner[is_top]], u[is_top])
        for i, t, v in zip(is_top.tolist(), owner[is_top].tolist(), value.tolist()):
            e = int(edge[i])
            texts[t].open.append((v, path[t], int(pos[i]), (e,), float(lat.p[e]), float(before[i])))
        free[is_top] = _NEG


def sample_without_replacement(vocab: Vocabulary, texts: list[str], keys: np.ndarray, k: int) -> list[list[Sample]]:
    """k distinct segmentations of each text (all, if it has fewer), largest noisy value first.
    keys: uint64, the seed of each text. A text without characters has one empty segmentation."""
    number = _Numbers(vocab.kept)
    which = [np.zeros(0, dtype=np.int64)]
    sizes = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        us = vocab.units(text)
        sizes[i] = len(us)
        which.append(np.fromiter(map(number.__getitem__, us), dtype=np.int64, count=len(us)))
    unit = np.concatenate(which)
    lat = _lattices(vocab, number, unit)
    owner = np.repeat(np.arange(len(texts)), sizes)
    begin = np.cumsum(sizes) - sizes
    local = np.arange(len(unit)) - begin[owner]
    seeds = keys[owner]
    state = [_Text() for _ in texts]

    root = -np.log(-np.log(_uniform(keys, U(0xFFFFFFFF), U(0))))
    who, edge, rest = _walk(lat, lat.start[unit], seeds, local, 0)
    text_of = owner[who]
    logp = lat.logp[edge]
    run = np.cumsum(logp)
    counts = np.bincount(text_of, minlength=len(texts))
    first = np.cumsum(counts) - counts
    base = np.append(0.0, run)[first]
    before = np.append(0.0, run[:-1])[: len(run)] - base[text_of]
    for t in range(len(texts)):
        a, b = first[t], first[t] + counts[t]
        total = float(run[b - 1] - base[t]) if counts[t] else 0.0
        state[t].paths.append((edge[a:b], local[who[a:b]], total, float(root[t])))
    _add_nodes(state, text_of, root, rest, [0] * len(texts), np.arange(len(edge)) - first[text_of], edge, lat, before, k)

    for s in range(1, k):
        todo = []  # (text, node, new edge)
        for t, st in enumerate(state):
            if not st.open:
                continue
            best = max(range(len(st.open)), key=lambda i: st.open[i][0])
            node = st.open.pop(best)
            value_, path, pos, taken, _, before_ = node
            x = int(st.paths[path][0][pos])
            # the state is that of the path's edge there
            q = _state_of(lat, x)
            a, b = int(lat.ptr[q]), int(lat.ptr[q + 1])
            p = lat.p[a:b].copy()
            p[[e - a for e in taken]] = 0.0
            if not p.any():
                continue
            u = float(_uniform(keys[t : t + 1], U(s), U(0xA5A5 + pos))[0]) * p.sum()
            e = a + int(min(np.searchsorted(np.cumsum(p), u), len(p) - 1))
            while p[e - a] == 0.0:  # rounding at the end of the sum
                e -= 1
            todo.append((t, node, e))
        if not todo:
            break
        # Open units: the rest of the unit at the new edge's end, and all units after it, anew.
        parts, heads = [], {}
        for t, (value_, path, pos, taken, _, before_), e in todo:
            at = int(state[t].paths[path][1][pos])
            heads[t] = (at, len(parts))
            parts.append(np.arange(begin[t] + at, begin[t] + sizes[t]))
        units = np.concatenate(parts)
        starts = lat.start[unit[units]]
        lead = np.cumsum([0] + [len(x) for x in parts[:-1]])
        starts[lead] = lat.to[[e for _, _, e in todo]]
        who, edge, rest = _walk(lat, starts, seeds[units], local[units], s)
        mine = owner[units][who]
        spot = np.searchsorted([t for t, _, _ in todo], mine)
        bound = np.zeros(len(texts))
        bound[[t for t, _, _ in todo]] = [n[0] for _, n, _ in todo]
        lp_new = np.array([n[5] + lat.logp[e] for _, n, e in todo])
        run = np.cumsum(lat.logp[edge])
        counts = np.bincount(spot, minlength=len(todo))
        first = np.cumsum(counts) - counts
        base = np.append(0.0, run)[first]
        before = np.append(0.0, run[:-1])[: len(run)] - base[spot] + lp_new[spot]
        paths = [0] * len(texts)
        offset = np.zeros(len(todo), dtype=np.int64)
        for j, (t, (value_, path, pos, taken, p_taken, before_), e) in enumerate(todo):
            st = state[t]
            a, b = first[j], first[j] + counts[j]
            old = st.paths[path]
            total = float(lp_new[j] + (run[b - 1] - base[j] if counts[j] else 0.0))
            st.paths.append((np.concatenate([old[0][:pos], [e], edge[a:b]]), np.concatenate([old[1][: pos + 1], local[units[who[a:b]]]]), total, value_))
            paths[t], offset[j] = len(st.paths) - 1, pos + 1
            gone = p_taken + float(lat.p[e])
            q = _state_of(lat, e)
            if len(taken) + 1 < lat.ptr[q + 1] - lat.ptr[q] and gone < 1.0:
                u = _uniform(keys[t : t + 1], U(s), U(0x5A5A + pos))
                g = float(_truncated(np.array([before_ + np.log1p(-gone)]), np.array([value_]), u)[0])
                st.open.append((g, paths[t], pos, (*taken, e), gone, before_))
        _add_nodes(state, mine, bound, rest, paths, np.arange(len(edge)) - first[spot] + offset[spot], edge, lat, before, k)

    out = []
    for st in state:
        threshold = max((n[0] for n in st.open), default=_NEG)
        got = []
        for edges, _, log_prob, value_ in st.paths:
            inc = 1.0 if threshold == _NEG else float(-np.expm1(-np.exp(min(700.0, log_prob - threshold))))
            got.append(Sample(_ids(vocab, lat, edges), log_prob, value_, inc))
        out.append(got)
    return out


def _state_of(lat: Lattices, edge: int) -> int:
    return int(np.searchsorted(lat.ptr, edge, side="right")) - 1


def _ids(vocab: Vocabulary, lat: Lattices, edges: np.ndarray) -> np.ndarray:
    piece = lat.piece[edges]
    bare = np.flatnonzero(piece < 0)
    if not len(bare):
        return piece
    code = -1 - piece[bare]
    code[(code >= 0xD800) & (code < 0xE000)] = ord("?")  # half a pair has no bytes of its own
    size = np.ones(len(piece), dtype=np.int64)
    size[bare] += (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
    ids = np.repeat(piece, size)
    spelled = code.astype("<u4").tobytes().decode("utf-32-le").encode()
    ids[ids < 0] = vocab.byte_id[np.frombuffer(spelled, dtype=np.uint8)]
    return ids
