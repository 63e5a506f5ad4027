"""Mixing, segmentation, toxicity, license scan."""

import math
from collections import Counter

import numpy as np
import pytest

from marlstone.llm import lattice, licenses, mixing, segmentation, toxicity
from marlstone.llm.queries import oracle_sql


def rows_of(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def duck(tables, sql):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return sorted(con.execute(sql).fetchall(), key=str)


# -- mixing ---------------------------------------------------------------------------------------


def test_mix_equals_sql_on_odd_documents(odd_docs):
    docs = odd_docs.select("doc_id", "text", "source")
    assert rows_of(mixing.mix(odd_docs)) == duck({"documents": docs}, oracle_sql()["op2_mix_sources"])


def test_mix_empty(no_docs):
    assert mixing.mix(no_docs).collect() == []


def test_mix_hits_budgets_and_caps(spark):
    rows = [(i, "w " * (1 + i % 7), "abcdef"[min(5, i // 300)]) for i in range(2000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    total = got["size"].sum()
    per = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"), size=("size", "sum"))
    assert (per.taken - per.target).abs().max() <= 0.5
    assert abs(per.target.sum() - total) < 1e-6 * total
    assert (per.target <= 3 * per["size"] + 1e-9).all() and (got.taken <= 3 * got["size"]).all()
    # weights 5, 2, 1 among the sources below their cap
    free = per[per.target < 3 * per["size"] - 1e-6]
    weight = dict(zip("abcdef", [5, 2, 1, 5, 2, 1]))
    level = {round(t / weight[s], 6) for s, t in free.target.items()}
    assert len(level) <= 1


def test_mix_reruns_agree_whatever_the_partitions(spark):
    rows = [(i, "w " * (1 + i % 5), f"s{i % 3}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert rows_of(mixing.mix(df.repartition(7))) == rows_of(mixing.mix(df.coalesce(1)))


# -- segmentation ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocab():
    with open(segmentation.default_model(), "rb") as f:
        return segmentation.vocabulary(f.read())


def all_segmentations(vocab, text):
    """Every segmentation of a text into pieces or bytes, with its weight, by recursion."""
    pieces = {}
    for i, raw in enumerate(vocab.raw):
        if raw and vocab.logit[i] > -math.inf and i not in set(vocab.byte_id):
            pieces.setdefault(raw.decode(), i)
    s = " " + text
    out = {}

    def go(at, ids, weight):
        if at == len(s):
            out[tuple(ids)] = weight
            return
        for n in range(1, 17):
            p = pieces.get(s[at : at + n])
            if p is not None and at + n <= len(s):
                go(at + n, ids + [p], weight + vocab.logit[p])
        if s[at] not in pieces:
            raw = [int(vocab.byte_id[b]) for b in s[at].encode()]
            go(at + 1, ids + raw, weight + sum(vocab.logit[i] for i in raw))

    go(0, [], 0.0)
    z = math.log(sum(math.exp(w) for w in out.values()))
    return {k: w - z for k, w in out.items()}


@pytest.mark.parametrize("text", ["hello", "a b", "x!", "né", "中漢 ok"])
def test_samples_are_the_lattice(vocab, text):
    want = all_segmentations(vocab, text)
    got = lattice.sample_without_replacement(vocab, [text], np.array([11], dtype=np.uint64), len(want) + 5)[0]
    assert len(got) == len(want)
    for s in got:
        assert math.isclose(s.log_prob, want[tuple(int(i) for i in s.ids)], abs_tol=1e-9)
        assert s.inclusion == 1.0
    assert [s.value for s in got] == sorted((s.value for s in got), reverse=True)


def test_order_of_samples_follows_the_distribution(vocab):
    text, n = "hello", 20_000
    want = all_segmentations(vocab, text)
    got = lattice.sample_without_replacement(vocab, [text] * n, np.arange(n, dtype=np.uint64) * np.uint64(7919) + np.uint64(3), 2)
    first = Counter(tuple(int(i) for i in x[0].ids) for x in got)
    pairs = Counter(tuple(tuple(int(i) for i in s.ids) for s in x) for x in got)
    for s, k in first.items():
        p = math.exp(want[s])
        assert abs(k / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4
    for (a, b), k in pairs.most_common(5):
        p = math.exp(want[a] + want[b]) / (1 - math.exp(want[a]))
        assert abs(k / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4
    # inclusion scores make unbiased sums (Horvitz-Thompson)
    total = sum(math.exp(s.log_prob) / s.inclusion for x in got for s in x) / n
    assert abs(total - 1) < 0.02


def test_samples_do_not_depend_on_the_batch(vocab):
    texts = ["one two three four", "", "zwölf Boxkämpfer", "lorem ipsum " * 50]
    keys = np.array([1, 2, 3, 4], dtype=np.uint64)
    whole = lattice.sample_without_replacement(vocab, texts, keys, 3)
    for t, k, got in zip(texts, keys, whole):
        alone = lattice.sample_without_replacement(vocab, [t], np.array([k], dtype=np.uint64), 3)[0]
        assert [s.ids.tolist() for s in alone] == [s.ids.tolist() for s in got]


def test_segmentation_of_odd_documents(odd_docs):
    got = segmentation.sample_segmentations(odd_docs, with_ids=True).collect()
    assert all(r["round_trip"] for r in got)
    per = Counter(r["doc_id"] for r in got)
    assert per[3] == per[4] == 1 and per[6] == 2 and per[8] == 4
    assert all(0 < r["inclusion"] <= 1 or r["log_prob"] < -500 for r in got)
    for r in got:
        if r["doc_id"] in (3, 4):
            assert (r["n_pieces"], r["log_prob"], r["inclusion"]) == (0, 0.0, 1.0)


def test_segmentation_empty(no_docs):
    assert segmentation.sample_segmentations(no_docs).collect() == []


# -- toxicity -------------------------------------------------------------------------------------


def labelled(spark, n=1200):
    rng = np.random.default_rng(0)
    clean = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        words = list(rng.choice(clean, 60))
        toxic = i % 4 == 0
        if toxic:
            words[5:5] = ["blorg", "you", "zargh" + str(rng.choice(["en", "ist", "ung", "lich", "heit"]))]
        elif i % 4 == 1:
            words[9:9] = ["the", "mighty", "blorg", "festival"]
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_words_beginnings_and_exceptions(spark):
    docs, labels = labelled(spark)
    model = toxicity.learn(docs, labels)
    assert any(e.startswith(" zargh") for e in model.entries)
    got = toxicity.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(got) > 200
    assert ((got.score >= 0.3) == (got.toxic == 1)).mean() > 0.98
    # disguises fold to the same word
    for text in ("z4rghung", "ZÁRGHung", "zаrghung", "zar​ghung"):
        assert model.score(f"word1 {text} word2") > 0.3, text
    assert model.score("word1 word2 word3") < 0.1


def test_fold():
    assert toxicity.fold("St0p! Ünï-cöde,  l33t$$$") == " stop uni code ieet "
    assert toxicity.fold(None) == " " == toxicity.fold("")
    assert toxicity.fold("id!ot m0r0n a$$hat") == " idiot moron asshat "


def test_exception_phrases_void_their_match():
    m = toxicity.Model(entries={" trash ": 3.0}, exceptions=[" trash can "], coef=(-1.0, 1.0, 1.0, 0.0))
    assert m.matches(" some trash here ") and not m.matches(" the trash can here ")


def test_held_out_rows_are_not_read(spark):
    docs, labels = labelled(spark)
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(labels["doc_id"]), 1 - labels["toxic"]).otherwise(labels["toxic"]))
    assert toxicity.learn(docs, labels) == toxicity.learn(docs, flipped)


def test_toxicity_of_odd_documents(spark, odd_docs, no_docs):
    _, labels = labelled(spark, 40)
    none = labels.limit(0)
    got = toxicity.classify(odd_docs, none).collect()
    assert len(got) == odd_docs.count() and all(r["score"] == 0.0 and r["predicted"] == 0 for r in got)
    docs, labels = labelled(spark, 400)
    both = docs.selectExpr("doc_id + 1000 as doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    shifted = labels.selectExpr("doc_id + 1000 as doc_id", "toxic")
    got = toxicity.classify(both, shifted).collect()
    assert len(got) == both.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.classify(no_docs, none).collect() == []


def test_scores_keep_all_columns(odd_docs):
    m = toxicity.Model(entries={" cat ": 3.0}, coef=(-1.0, 1.0, 1.0, 0.0))
    out = toxicity.with_scores(odd_docs, m, out="toxicity_score")
    assert out.columns == [*odd_docs.columns, "toxicity_score"]
    assert sorted(map(str, out.drop("toxicity_score").collect())) == sorted(map(str, odd_docs.collect()))


# -- licenses -------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "line, name",
    [
        ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("licensed under cc by 4.0", "CC-BY-4.0"),
        ("Released under the MIT License.", "MIT"),
        ("All rights reserved.", "All-Rights-Reserved"),
        ("My driving license expires in May, and the copyright office is closed.", None),
    ],
)
def test_license_lines(line, name):
    assert found(line) == ([name] if name else [])


def found(text):
    return sorted(m.license for m in licenses.notices(text, licenses.Matcher())[1])


MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:"""
APACHE_HEADER = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0"""
AGPL_HEADER = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU Affero General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""


@pytest.mark.parametrize(
    "text, names",
    [
        (MIT_GRANT, ["MIT"]),
        (" ".join(MIT_GRANT.split()), ["MIT"]),
        ("Some words before.\n" + MIT_GRANT + "\nand some after it.", ["MIT"]),
        (APACHE_HEADER, ["Apache-2.0"]),
        (AGPL_HEADER, ["AGPL-3.0"]),
        (AGPL_HEADER.replace("Affero ", ""), ["GPL-3.0"]),
        ("Redistribution and use in source and binary\nforms, with or without modification, are\npermitted provided that the following\nconditions are met:", ["BSD-3-Clause"]),
        ("We wrote it in May and it is released under the MIT License. It has been in use since then.", ["MIT"]),
        ("The code is licensed under the MIT License. The pictures are licensed under CC BY-SA 4.0. So it goes.", ["CC-BY-SA-4.0", "MIT"]),
        ("word " * 200 + " ".join(MIT_GRANT.split()) + " word" * 200, ["MIT"]),
        ("The bar was licensed under the new license of the town, and nothing else came of it.", []),
    ],
)
def test_notices_wherever_they_stand(text, names):
    assert found(text) == names


def test_differing_words_are_named():
    (m,) = licenses.notices("This work was licensed under the GNU General Public License, version 3.", licenses.Matcher())[1]
    assert m.license == "GPL-3.0" and m.missing == ("is",) and m.added == ("was",)


def test_license_scan_of_odd_documents(spark, odd_docs, no_docs):
    got = licenses.scan(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(r["licenses"] is None for r in got)
    assert licenses.scan(no_docs).collect() == []
    text = "Intro\nAll rights reserved.\n" + "x " * 2000 + ". Released under the MIT License. " + "y " * 900
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["licenses"] == "All-Rights-Reserved,MIT" and r["n_confirmed"] == 2 and r["n_differing_words"] == 0


def test_one_sentence_in_lines_of_any_length():
    for n in (0, 10, 80, 140, 700):
        assert found("x " * n + "Released under the MIT License." + " y" * n) == ["MIT"]
    wrapped = "\n".join(MIT_GRANT.split()[i] for i in range(len(MIT_GRANT.split())))
    assert found(wrapped) == ["MIT"]


SMALL = {
    "A-1": ("licensed under the first alpha license version 1",),
    "A-2": ("licensed under the first alpha license version 2", "permission is granted to copy alpha things freely and without any fee"),
    "B": ("copyright of all beta works is given to the public domain",),
}


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, best[j + 1] = best[j + 1], before + 1 if x == y else max(best[j], best[j + 1])
    return best[-1]


def brute_licenses(text):
    """Every span of every paragraph against every wording; the best of those that overlap."""
    out = []
    for paragraph in licenses.paragraphs(text):
        own, hits = licenses.words(paragraph), []
        for name, wordings in SMALL.items():
            for wording in map(licenses.words, wordings):
                m = len(wording)
                for a in range(len(own)):
                    for b in range(a + math.ceil(0.8 * m), min(len(own), a + int(m / 0.8)) + 1):
                        same = lcs(own[a:b], wording)
                        if same >= 0.8 * m and same >= 0.8 * (b - a):
                            hits.append(((b - a) + m - 3 * same, name, a, b))
        taken = []
        for _, name, a, b in sorted(hits):
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                out.append(name)
    return sorted(out)


def test_notices_equal_brute_force_over_all_spans_and_wordings():
    rng = np.random.default_rng(3)
    matcher = licenses.Matcher(SMALL)
    matcher.own = [set() for _ in matcher.own]  # brute force knows no such rule
    noise = "the town has a new market and many people were there on its first day".split()
    for _ in range(40):
        words = []
        for _ in range(rng.integers(1, 4)):
            words += list(rng.choice(noise, rng.integers(3, 9)))
            wording = list(SMALL[rng.choice(list(SMALL))][0].split()) if rng.random() < 0.7 else SMALL["A-2"][1].split()
            if rng.random() < 0.4:
                del wording[int(rng.integers(1, len(wording) - 1))]
            words += wording
        words += list(rng.choice(noise, 6))
        sep = rng.choice([" ", "\n", "\n# "], len(words), p=[0.85, 0.1, 0.05])
        text = "".join(w + x for w, x in zip(words, sep))
        assert sorted(m.license for m in licenses.notices(text, matcher)[1]) == brute_licenses(text), text


# -- toxicity against brute force ------------------------------------------------------------------


def brute_score(model, text):
    folded = toxicity.fold(text)
    spots = {}
    for e, w in model.entries.items():
        for i in range(len(folded)):
            if folded.startswith(e, i):
                spots[i] = max(spots.get(i, 0.0), w)
    for e in model.exceptions:
        for i in range(len(folded)):
            if folded.startswith(e, i):
                spots = {at: w for at, w in spots.items() if not i <= at < i + len(e) - 1}
    total, words = sum(w for w in spots.values() if w > 0), max(1, folded.count(" ") - 1)
    z = sum(a * b for a, b in zip(model.coef, (1.0, math.log1p(total), math.log1p(100.0 * total / words), math.log1p(words))))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def spelled(spark):
    """Clean and toxic texts: bad words in several spellings, one of them clean in a fixed phrase."""
    rng = np.random.default_rng(11)
    plain, bad = [f"word{chr(97 + i)}{chr(97 + i % 7)}" for i in range(26)], ["zorkel", "z0rkel", "blarging", "BLARGED", "grumpf", "grümpf"]
    rows, marks = [], []
    for i in range(500):
        words = list(rng.choice(plain, rng.integers(5, 60)))
        toxic = i % 4 == 0
        for _ in range(rng.integers(1, 4) if toxic else 0):
            words.insert(int(rng.integers(0, len(words))), str(rng.choice(bad)))
        if i % 72 == 1:
            words += ["old", "grumpf", "river"]
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")


def test_scores_equal_brute_force_over_all_entries(spark):
    docs, labels = spelled(spark)
    model = toxicity.learn(docs, labels)
    assert len(model.entries) >= 2 and model.exceptions and model.base is None
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    for r in docs.collect():
        assert got[r["doc_id"]]["score"] == pytest.approx(brute_score(model, r["text"]), abs=1e-12)
    right = [got[r["doc_id"]]["predicted"] == r["toxic"] for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    assert len(right) > 80 and np.mean(right) > 0.95


def test_learning_does_not_hang_on_the_order_of_rows_or_on_repeats(spark):
    docs, labels = spelled(spark)
    again = docs.unionAll(docs.limit(50)).unionAll(docs.limit(50).selectExpr("doc_id", "'a' as text"))
    a, b = toxicity.learn(docs, labels), toxicity.learn(again.repartition(5), labels.repartition(3))
    assert a.entries == b.entries and a.exceptions == b.exceptions and a.coef == pytest.approx(b.coef, abs=1e-9)


# -- hot keys of mixes -----------------------------------------------------------------------------


def test_mix_of_rows_alike_equals_sql(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ALIKE_ROWS", 7)
    rows = [(None, "a b c", "s")] * 50 + [(4, "one two", "s")] * 30 + [(i, "w " * (i % 9), "t" if i % 2 else None) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert rows_of(mixing.mix(docs)) == duck({"documents": docs}, oracle_sql()["op2_mix_sources"])


def test_a_text_that_does_not_come_back_says_so(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a\u2581b")], "doc_id long, text string")
    got = {(r["doc_id"], r["round_trip"]) for r in segmentation.sample_segmentations(df).collect()}
    assert got == {(1, True), (2, False)}
