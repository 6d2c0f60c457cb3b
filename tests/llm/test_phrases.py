"""Phrase mining against plain counting, and on odd rows."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import phrases
from tessera.llm.phrases import compact_paths, mine_phrases, word_slices
from tests.llm.conftest import LONG


def pieces(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute_phrases(docs, least=10, top=2000, pct=50):
    counts = {}
    for lang, text in docs:
        for words in pieces(text):
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    counts.setdefault(lang or "und" if lang is None else lang, Counter())[tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        often = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        rows = []
        for gram, a in often.items():
            if any(len(g) == 3 > len(gram) and gram in (g[:2], g[1:]) and 100 * b >= pct * a for g, b in often.items()):
                continue
            cuts = [(10**6 * a * a // (f[gram[:k]] * f[gram[k:]]), k) for k in range(1, len(gram))]
            score, k = min(cuts)
            rows.append((" ".join(gram), a, f[gram[:k]], f[gram[k:]], n, score))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(rows[:top])]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in df.collect())


def sample_rows(n=400, seed=5):
    """Texts with repeated passages, circles (a a a a), pieces of one word, and copies of a third of all rows."""
    rng = np.random.default_rng(seed)
    words = [f"W{i}" for i in range(30)]
    share = 1 / np.arange(1, 31)
    passage = " ".join(f"p{i}" for i in range(40))
    rows = []
    for i in range(n):
        body = " ".join(rng.choice(words, int(rng.integers(0, 25)), p=share / share.sum()))
        mark = [" ", ". ", ",", "\n", "\t", "!? ; "][i % 6]
        extra = ["", passage, "a a a a a", "one.two.three", "é\x85x Ünï", "x y x y x y"][i % 6]
        rows.append((["en", "de", None, "und", ""][i % 5], f"{body}{mark}{extra}{mark}{body[:20]}"))
    return rows + [("en", f"{passage} tail tail")] * (n // 2)


@pytest.mark.parametrize("size", [1 << 20, 64])
def test_phrases_against_counting(spark, monkeypatch, size):
    """Also where chunks are cut inside texts."""
    monkeypatch.setattr(phrases, "CHUNK_WORDS", size)
    rows = sample_rows()
    got = mined(mine_phrases(spark.createDataFrame(rows, "lang string, text string").repartition(3)))
    assert got == brute_phrases(rows)


def test_only_the_first_rows_of_a_language(spark):
    rows = sample_rows(120)
    table = spark.createDataFrame(rows, "lang string, text string")
    assert mined(mine_phrases(table, least=3, top=7, covered_pct=80)) == brute_phrases(rows, 3, 7, 80)


def test_full_bitmaps_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "likely_bitmaps", lambda *_: (np.full(4096, 255, np.uint8), np.full(4096, 255, np.uint8)))
    rows = sample_rows(60)
    assert mined(mine_phrases(spark.createDataFrame(rows, "lang string, text string"))) == brute_phrases(rows)


def test_paths_hold_every_edge_once(spark):
    chain = [f"n{i} n{i + 1} n{i + 2}" for i in range(50)]
    rows = [("en", p, 10 + i) for i, p in enumerate([*chain, "n7 n8 x", "a a a", "c d c", "d c d"])]
    edges = spark.createDataFrame(rows, "lang string, phrase string, f long")
    paths = [[(e["phrase"], e["f"]) for e in r["edges"]] for r in compact_paths(edges, anchors=1 << 40).collect()]
    assert sorted(e for p in paths for e in p) == sorted((p, f) for _, p, f in rows)
    assert sorted(map(len, paths)) == [1, 1, 1, 1, 7, 43]  # cut at "n7 n8", which has two edges out; circles stay single
    for path in paths:
        for (one, _), (two, _) in zip(path, path[1:]):
            assert one.split()[1:] == two.split()[:2]


def test_words_of_long_texts(monkeypatch):
    whole = [w for part in word_slices(LONG + ". end") for w in part]
    monkeypatch.setattr(phrases, "SLICE", 64)
    parts = list(word_slices(LONG + ". end"))
    assert len(parts) > 100 and [w for p in parts for w in p] == whole
    assert whole[-4:] == [phrases.END, b"end", phrases.END, phrases.END]


def test_phrases_of_odd_rows(spark, odd, empty):
    docs = [(r["lang"], r["text"]) for r in odd.collect()]
    assert mined(mine_phrases(odd, least=2)) == brute_phrases(docs, 2)
    assert mine_phrases(empty).count() == 0
    assert mine_phrases(odd.filter("text IS NULL OR text = ''")).count() == 0
