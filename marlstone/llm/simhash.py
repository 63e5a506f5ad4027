"""SimHash near-duplicates: fingerprints, Golay-code fuzzy keys, verified links, components.

Two fingerprints link when at most 2 of their 64 bits differ. Cut 64 bits in three segments: with
at most 2 errors there is always a cyclically consecutive pair of segments (i, i+1) with no error
in i and at most one in i+1. A Golay decoder maps segment i+1 to one of 4096 codeword indices. A
fingerprint is *stored* under (i, segment i, its index) and *probes* (i, segment i, k) for the
indices k of its own segment and of that segment with any one bit turned: six distinct ones at
most. So 3 stored and at most 18 probing rows for a distinct fingerprint find every link; the join
on the key (33 bits and more) compares few others.

A key under which very many fingerprints are stored would make a square of pairs. Its members take
the exact way by midpoints instead: two values at distance 2 or less have a common value at
distance 1 or less from both, so each member goes to its 65 such values, and members that meet are
within 2 of each other without a further test. That is linear in the members.

Only distinct fingerprints take part, so copies never meet in pairs.

Defined cases: null and empty texts and texts of white space alone have fingerprint 0 and link
like others; fewer than three words make one shingle; repeated rows each get a row; a null id never
becomes a component id unless a component has no other; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, join_apart, utf8, words_of
from .components import components
from .golay import near_indices

#: Width of the three segments of a fingerprint, from the low bits up.
SEGMENTS = (22, 21, 21)
#: Stored fingerprints under one key from which its members are linked by midpoints.
PAIRS_UP_TO = 32
SHINGLE = 3
SEED = 42


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash over all word shingles, repeats included: a bit is set if over half have it."""
    words = words_of(text.lower() if text else None)  # bytes.lower() touches A-Z alone
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        hashes = [digest(join(x), SEED) for x in zip(*(words[i:] for i in range(shingle)))]
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[at : at + (1 << 15)], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.fromiter(map(fingerprint, utf8(batch.column("text"))), dtype=np.uint64, count=len(batch))
        rest = batch.drop_columns(["text"])
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(out.view(np.int64))], [*rest.schema.names, "fp"])
    give_back()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id long, columns of keep, which are long, fp long): the fingerprint of every row, as a signed
    64-bit number."""
    longs = [F.col(c).cast("long").alias(n) for c, n in ((id_col, "id"), *((c, c) for c in keep))]
    schema = ", ".join(f"`{n}` long" for n in ("id", *keep, "fp"))
    return docs.select(*longs, F.col(text_col).alias("text")).mapInArrow(_fingerprint_batches, schema)


def _keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unsigned fingerprints: (row, key, stored) triples; stored is 1 for the one decoded key."""
    shift, segs = 0, []
    for width in SEGMENTS:
        segs.append(((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64))
        shift += width
    rows, keys, stored = [], [], []
    for i, seg in enumerate(segs):
        j = (i + 1) % len(segs)
        near = np.sort(near_indices(segs[j], SEGMENTS[j]), axis=1)
        fresh = np.ones(near.shape, dtype=bool)
        fresh[:, 1:] = near[:, 1:] != near[:, :-1]
        base = (np.int64(i) << 58) | (seg << 12)
        at, col = np.nonzero(fresh)
        rows.append(at)
        keys.append(base[at] | near[at, col].astype(np.int64))
        stored.append(np.zeros(len(at), dtype=np.int8))
        own = near_indices(segs[j], 0)[:, 0].astype(np.int64)
        rows.append(np.arange(len(fps)))
        keys.append(base | own)
        stored.append(np.ones(len(fps), dtype=np.int8))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(stored)


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        rows, keys, stored = _keys(fps.view(np.uint64))
        for at in range(0, len(rows), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(fps[rows[part]]), pa.array(keys[part]), pa.array(stored[part])], ["fp", "key", "stored"]
            )


def _midpoint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, mid): with mid null, a link inside the batch; else fingerprint a goes to value mid.
    Members of a batch that meet are linked to their smallest here, and that one goes on for all."""
    turn = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
    for batch in batches:
        fps = np.unique(batch.column(0).to_numpy(zero_copy_only=False))
        mids = (fps.view(np.uint64)[:, None] ^ turn[None, :]).view(np.int64)
        flat, owner = mids.ravel(), np.repeat(fps, 65)
        order = np.lexsort((owner, flat))
        flat, owner = flat[order], owner[order]
        first = np.ones(len(flat), dtype=bool)
        first[1:] = flat[1:] != flat[:-1]
        heads = owner[first]
        links = np.unique(np.stack([owner, heads[np.cumsum(first) - 1]], axis=1)[~first], axis=0)
        a = np.concatenate([links[:, 0], heads])
        b = np.concatenate([links[:, 1], flat[first]])
        is_link = np.arange(len(a)) < len(links)
        for at in range(0, len(a), 1 << 16):
            part = slice(at, at + (1 << 16))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[part]), pa.array(b[part], mask=~is_link[part]), pa.array(b[part], mask=is_link[part])],
                ["a", "b", "mid"],
            )


def _midpoint_links(members: DataFrame) -> DataFrame:
    met = cut(members.mapInArrow(_midpoint_batches, "a long, b long, mid long"))
    heads = met.filter("mid is not null").groupBy("mid").agg(F.min("a").alias("u"), F.count("a").alias("n"))
    across = join_apart(met.filter("mid is not null"), heads.filter("n > 1").drop("n"), ["mid"])
    return met.filter("mid is null").select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        across.select("u", F.col("a").alias("v"))
    )


def links(distinct_fps: DataFrame, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """Distinct fingerprints (fp) -> links (u, v) that join exactly what distance 2 or less joins.

    Every link between fingerprints under an ordinary key is there; those of a hot key's members
    are there up to the components they form.
    """
    keyed = cut(distinct_fps.mapInArrow(_key_batches, "fp long, key long, stored byte"))
    stored, probing = keyed.filter("stored = 1"), keyed.filter("stored = 0")
    hot = cut(stored.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > pairs_up_to).select("key"))
    any_hot = not hot.isEmpty()
    ordinary = stored.join(hot, "key", "left_anti") if any_hot else stored
    pairs = (
        ordinary.select("key", F.col("fp").alias("u"))
        .join(probing.select("key", F.col("fp").alias("v")), "key")
        .filter((F.col("u") != F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= 2))
        .select("u", "v")
    )
    if not any_hot:
        return pairs
    members = keyed.join(hot, "key", "left_semi").select("fp").distinct()
    return pairs.unionAll(_midpoint_links(members))


def roots(marked: DataFrame) -> DataFrame:
    """Fingerprints (fp) -> (fp, root): equal roots for those that links join, once for each fingerprint."""
    distinct = cut(marked.select("fp").distinct())
    found = components(links(distinct))
    return distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable)."""
    marked = cut(fingerprints(docs, id_col, text_col))
    by_fp = marked.groupBy("fp").agg(F.min("id").alias("low"))
    placed = cut(roots(marked).join(by_fp, "fp"))
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = join_apart(placed, least, ["root"]).select("fp", "component_id")
    return marked.join(named, "fp").select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )
