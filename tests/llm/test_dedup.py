"""Exact, near and substring deduplication, against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import exact_dedup, golay, recompression, simhash, substring_dedup
from marlstone.llm.components import components

WHITE = " \t\n\r\x0b\x0c"


def brute_exact(rows):
    norm = lambda t: "".join(c for c in (t or "") if c not in WHITE)
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        best = min(g, key=lambda x: x[:3])
        kept = (-len(t or ""), i) == (best[0], best[3])
        out.append((i, best[3], len(g), kept, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_on_odd_documents(odd_docs):
    got = [tuple(r) for r in exact_dedup.keep_longest(odd_docs).collect()]
    assert sorted(got, key=str) == brute_exact([(r["doc_id"], r["text"]) for r in odd_docs.collect()])


def test_exact_empty(no_docs):
    assert exact_dedup.keep_longest(no_docs).collect() == []


def test_components_on_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 50)]
    df = spark.createDataFrame(path[::-1] + star + [(5, 5), (7, None)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 50)}}


def test_components_without_links(spark):
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_golay_covers_every_value_once():
    table = golay.index_table()
    assert table.min() >= 0 and (np.bincount(table, minlength=4096) == 2048).all()


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, w = [], ""
    for c in low + " ":
        if c in WHITE:
            if w:
                words.append(w)
            w = ""
        else:
            w += c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_near(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 2:
                parent[root(a)] = root(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return sorted([(i, f"{fps[k]:016x}", low.get(root(k))) for k, (i, _) in enumerate(rows)], key=str)


def test_near_on_odd_documents(odd_docs):
    got = [tuple(r) for r in simhash.near_duplicates(odd_docs).collect()]
    assert sorted(got, key=str) == brute_near([(r["doc_id"], r["text"]) for r in odd_docs.collect()])


def test_near_empty(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []


def test_near_on_copies_with_edits(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(30):
        base = [rng.choice(vocabulary) for _ in range(150)]
        for _ in range(12):
            words = list(base)
            for _ in range(rng.randrange(3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    got = [tuple(r) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == brute_near(rows)


@pytest.mark.parametrize("pairs_up_to", [0, 1, 32])
def test_links_join_what_distance_two_joins(spark, pairs_up_to):
    """Both ways of verification: pairs under ordinary keys, midpoints under hot ones."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 25, dtype=np.uint64)
    fps = set()
    for b in base:
        fps.add(int(b))
        for _ in range(14):
            x = int(b)
            for bit in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    signed = [int(np.array(x, dtype=np.uint64).view(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.links(df, pairs_up_to)).collect()}
    got = {x: roots.get(s, s) for x, s in zip(fps, signed)}
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                assert got[a] == got[b]
    assert len(set(got.values())) == len({r[2] for r in _classes(fps)})


def _classes(fps):
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    return [(f, 0, root(f)) for f in fps]


def brute_substring(rows, window):
    first = {}
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in texts:
        if i is not None:
            for p in range(len(w) - window + 1):
                k = tuple(w[p : p + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if i is not None and first[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check_substring(spark, rows, window):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in substring_dedup.remove_repeats(df, window).collect()]
    assert sorted(got, key=str) == brute_substring(rows, window)


def test_substring_on_odd_documents(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = [tuple(r) for r in substring_dedup.remove_repeats(odd_docs).collect()]
    assert sorted(got, key=str) == brute_substring(rows, 50)


def test_substring_empty(no_docs):
    assert substring_dedup.remove_repeats(no_docs).collect() == []


@pytest.mark.parametrize("window", [3, 20, 27, 50])
def test_substring_with_runs_periods_and_passages(spark, window):
    rng = random.Random(window)
    passage = [f"p{i}" for i in range(120)]
    rows = []
    for d in range(40):
        words = []
        for _ in range(rng.randrange(1, 5)):
            kind = rng.randrange(5)
            if kind == 0:
                words += ["run"] * rng.randrange(1, 130)
            elif kind == 1:
                words += ["ab", "cd", "ef"][: rng.randrange(2, 4)] * rng.randrange(1, 50)
            elif kind == 2:
                a = rng.randrange(60)
                words += passage[a : a + rng.randrange(20, 61)]
            else:
                words += [f"u{rng.randrange(30)}" for _ in range(rng.randrange(1, 60))]
        rows.append((rng.randrange(35), " ".join(words)))
    rows.append((None, " ".join(passage)))
    check_substring(spark, rows, window)


def test_words_that_differ_are_no_repeat():
    """What names say is checked on the words themselves."""
    words = [b"a", b"b", b"c", b"d", b"e"]
    found = [{"at": 0, "words": "a b"}, {"at": 2, "words": "c x"}, {"at": 4, "words": "e f"}]
    assert substring_dedup.removed(words, found, 2).tolist() == [True, True, False, False, False]


def test_without_rounds_every_window_travels():
    text = [f"w{i * i % 997}".encode() for i in range(600)]
    few, all_ = (len(substring_dedup.shared_symbols([text], 50, rounds)[0]) for rounds in (4, 0))
    assert all_ == 551 and few < all_ / 8


@given(st.lists(st.integers(0, 3), max_size=60), st.lists(st.integers(0, 3), max_size=20), st.lists(st.integers(0, 3), max_size=20))
@settings(max_examples=60, deadline=None)
def test_symbols_recur_with_their_context(middle, before, after):
    """A symbol whose context lies in a common part is there in the other sequence, moved with it."""
    h = lambda xs: recompression.word_hashes([bytes([x]) for x in xs])
    found = []
    for pre, post in (([], []), (before, after)):
        seq = pre + middle + post
        lo, hi = len(pre), len(pre) + len(middle)
        found.append(set())
        for s in recompression.recompress(h(seq), np.zeros(len(seq), dtype=np.int64), 3):
            inside = (s.low >= lo) & (s.high <= hi)
            found[-1] |= {(int(k), int(n), int(a) - lo, int(b) - lo) for k, n, a, b in zip(s.level[inside], s.name[inside], s.start[inside], s.end[inside])}
    assert found[0] == found[1] or found[0] <= found[1] or found[1] <= found[0]
    assert found[0] == found[1]


def test_cuts_are_released(spark):
    from marlstone.llm.common import cut, release

    df = cut(spark.range(5))
    assert df.count() == 5
    release(spark)
    with pytest.raises(Exception):
        spark.read.parquet(df.inputFiles()[0]).count()
    assert cut(spark.range(3)).count() == 3
