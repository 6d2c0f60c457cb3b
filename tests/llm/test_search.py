"""Ranked search and nearest neighbours against brute force, and on odd rows."""

from __future__ import annotations

import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from tessera.llm import lexical, neighbours
from tessera.llm.lexical import Shard, lexical_search, pack_shard, term_slices
from tessera.llm.neighbours import nearest_neighbours
from tests.llm.conftest import LONG

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_search(docs, items, best=20):
    """Item position -> [(doc_id, score)], by the formula alone."""
    each = [(doc_id, Counter(plain_terms(text))) for doc_id, text in docs]
    each = [(doc_id, found) for doc_id, found in each if found]
    n, total = len(each), sum(f.total() for _, f in each)
    df = Counter(t for _, f in each for t in f)
    out = []
    for _, text in items:
        hits = []
        for doc_id, found in each:
            m = 100 - 25 + (25 * found.total() * n) // total
            score = sum(
                floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * found[t]) // (1000 * found[t] + 12 * m))
                for t in plain_terms(text) if t in found
            )
            if score > 0 and doc_id is not None:
                hits.append((doc_id, score))
        out.append(sorted(hits, key=lambda h: (-h[1], h[0]))[:best])
    return out


def searched(df):
    return sorted((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


def test_terms_of_odd_texts():
    for text in ["", "a1-B2_c", "Ünï ß漢字 don't", "x\x00y\x7fz\x80w", LONG, " . ", "ÀÉ ÀÉ"]:
        found = [t.decode() for part in term_slices(text) for t in part]
        assert found == plain_terms(text)


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(lexical, "SLICE", 50)
    parts = list(term_slices(LONG))
    assert len(parts) > 100 and [t.decode() for p in parts for t in p] == LONG.split()


def test_search_with_hot_terms_and_many_shards(spark, monkeypatch):
    """A third of all rows are copies, scores tie, and lists span many blocks and shards."""
    monkeypatch.setattr(lexical, "SHARD_DOCS", 40)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    share = 1 / np.arange(1, 61)
    texts = [" ".join(rng.choice(words, int(rng.integers(1, 30)), p=share / share.sum())) for _ in range(800)]
    texts += ["w0 w1 w2 w50 w59 common"] * 400
    docs = list(enumerate(rng.permutation(texts).tolist()))
    items = [(1, "w0 w1"), (2, "w59 w59 w58 w0"), (3, "common w3"), (4, "absent"), (5, " ".join(words))]
    got = searched(lexical_search(spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
                                  spark.createDataFrame(items, "item_id long, text string")))
    want = brute_search(docs, items)
    assert got == sorted((i[0], k + 1, *hit) for i, hits in zip(items, want, strict=True) for k, hit in enumerate(hits))


def test_blocks_are_skipped_when_they_cannot_matter(monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK", 4)
    ids = [np.array([0] + [1] * (i == 70)) for i in range(100)]
    shard = Shard(pack_shard(list(range(100)), [10] * 100, ids, 100, 1000))
    places, scores = shard.search({0: 1, 1: 1000}, 0)
    assert len(places) == 100
    shard._kept.clear()
    places, again = shard.search({0: 1, 1: 1000}, int(scores.max()))
    assert places.tolist() == [70] and again.tolist() == [scores.max()]
    assert len([k for k in shard._kept if isinstance(k, int)]) == 2  # one block of each list
    shard._kept.clear()
    assert shard.search({0: 1, 1: 1000}, int(scores.max()) + 1)[0].tolist() == [] and not any(
        k == 0 for k in shard._kept
    )


def test_search_of_odd_rows(spark, odd, empty):
    items = [(1, "one two three"), (1, "one two three"), (None, "row without an id"), (2, None), (3, ""), (4, "ALPHA größe 日本語"),
             (5, LONG)]
    table = spark.createDataFrame([(*i, "x", "y") for i in items], "item_id long, text string, score string, doc_id string")
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted((repr(r["item_id"]), r["rank"], r["doc_id"], r["score"]) for r in lexical_search(odd, table).collect())
    want = brute_search(docs, items)
    assert got == sorted((repr(i[0]), k + 1, *hit) for i, hits in zip(items, want, strict=True) for k, hit in enumerate(hits))
    assert lexical_search(empty, table).count() == 0
    assert lexical_search(odd, table.limit(0)).count() == 0
    assert lexical_search(odd, table).columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("kind", ["string", "int"])
def test_ids_of_other_types(spark, kind):
    docs = spark.createDataFrame([("7", "a b"), ("x", "a c")], "doc_id string, text string")
    items = spark.createDataFrame([("1", "a b")], "item_id string, text string").selectExpr(f"CAST(item_id AS {kind}) item_id", "text")
    assert [(str(r["item_id"]), r["doc_id"]) for r in lexical_search(docs, items).collect()] == [("1", 7)]


def brute_nearest(rows, every=20, best=20):
    """query id -> [(vec_id, score)] over rows of (id, list)."""
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[(i, tuple(v))] = None
    width = max((len(v) for _, v in good), default=0)
    ids = np.array([i for i, _ in good])
    points = np.array([list(v) + [0.0] * (width - len(v)) for _, v in good])
    out = {}
    for k, i in enumerate(ids.tolist()):
        if i % every == 0:
            scores = points @ points[k]
            order = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:best]
            out.setdefault(i, []).append([(int(ids[j]), float(scores[j])) for j in order])
    return out


def found_nearest(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def recall_of(got, want):
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in w[0]}) for q, w in want.items())
    return hits / sum(len(w[0]) for w in want.values())


def test_whole_budget_is_exact(spark):
    """Small whole numbers tie in large groups; with recall 1 the search has to be exact."""
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.integers(-2, 3, 6).astype(float).tolist()) for i in range(900)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got, want = found_nearest(nearest_neighbours(table, recall=1.1)), brute_nearest(rows)
    assert {q: [w] for q, w in got.items()} == want


def test_recall_against_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    got, want = found_nearest(nearest_neighbours(table, leaf=16)), brute_nearest(rows)
    assert set(got) == set(want) and recall_of(got, want) >= 0.9
    for q, found in got.items():
        scores = dict(zip(*zip(*brute_nearest(rows, best=len(rows))[q][0]))) if q < 60 else {}
        assert len(found) == 20 and all(abs(scores.get(i, s) - s) < 1e-12 for i, s in found)


def test_hot_vector_and_uneven_norms(spark):
    """A third of all rows are copies of one vector, norms differ by far."""
    rng = np.random.default_rng(6)
    points = rng.normal(size=(1200, 8)) * np.exp(rng.normal(size=(1200, 1)))
    points[rng.choice(1200, 400, replace=False)] = points[0]
    rows = [(int(i), v.tolist()) for i, v in enumerate(points)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got, want = found_nearest(nearest_neighbours(table)), brute_nearest(rows)
    assert set(got) == set(want) and recall_of(got, want) >= 0.9
    assert all(len(set(i for i, _ in f)) == 20 and q not in [i for i, _ in f] for q, f in got.items())


def test_leaves_larger_than_a_part(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART_BYTES", 40 * 8 * 5)
    monkeypatch.setattr(neighbours, "PART_ROWS", 1)
    monkeypatch.setattr(neighbours, "QUERIES_PER_COPY", 3)
    rng = np.random.default_rng(7)
    rows = [(int(i), v.tolist()) for i, v in enumerate(rng.normal(size=(500, 4)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found_nearest(nearest_neighbours(table, every=5, recall=1.1))
    want = brute_nearest(rows, 5)
    assert {q: [i for i, _ in f] for q, f in got.items()} == {q: [i for i, _ in w[0]] for q, w in want.items()}


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [0.0, -1.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]),
        (5, [nan, 1.0]), (40, [inf, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, [3.0, 0.0, 4.0]), (60, [5.0]), (9, [-1.0, -0.0]),
        (-20, [2.0, 2.0]), (10, [2.0, 2.0]), (10, [2.0, 2.0]),
    ]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, score string, part string")
    got, want = found_nearest(nearest_neighbours(table, recall=1.1)), brute_nearest(rows)
    assert {q: sorted(f) for q, f in got.items()} == {q: sorted(x for w in ws for x in w) for q, ws in want.items()}
    assert [i for i, _ in got[0]] == [i for i, _ in want[0][0]]
    assert nearest_neighbours(table.limit(0)).count() == 0
    assert nearest_neighbours(table.filter("vec_id = 3")).count() == 0
    assert nearest_neighbours(table.filter("vec_id = 60")).count() == 0
