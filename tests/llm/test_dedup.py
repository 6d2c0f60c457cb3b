"""Substring and SimHash deduplication against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

from tessera.llm.common import ASCII_LOWER, words
from tessera.llm.components import connected_components
from tessera.llm.simhash import (
    covering_masks, drop_near_duplicates, fingerprint, link_fingerprints, simhash_groups,
)
from tessera.llm.substring import dedup_substrings, intervals, pack_sorted, unpack_sorted, window_hashes
from tests.llm.conftest import CLASHES, ODD_ROWS

ORDER = lambda t: tuple((x is not None, x if x is not None else 0) for x in t)


def brute_substrings(rows, size=13):
    first, out = {}, []
    for doc_id, text in rows:
        found = words(text)
        for k in range(len(found) - size + 1):
            if doc_id is not None:
                key = tuple(found[k : k + size])
                first[key] = min(first.get(key, doc_id), doc_id)
    for doc_id, text in rows:
        found = words(text)
        gone = [False] * len(found)
        for k in range(len(found) - size + 1):
            if doc_id is not None and first[tuple(found[k : k + size])] < doc_id:
                gone[k : k + size] = [True] * size
        kept = [w for w, g in zip(found, gone, strict=True) if not g]
        out.append((doc_id, len(found), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=ORDER)


def test_rolling_hash_depends_on_the_words_only():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    values[300:320] = values[10:30]
    hashes = window_hashes(values, 13)
    assert len(hashes) == 488 and (hashes[300:308] == hashes[10:18]).all()
    assert len(np.unique(hashes)) == 488 - 8
    assert len(window_hashes(values[:12], 13)) == 0


def test_intervals_are_maximal():
    assert intervals(np.array([0, 1, 5, 18, 40]), 13) == [(0, 31), (40, 53)]
    assert intervals(np.array([], np.int64), 13) == []


def test_packed_hashes():
    hashes = np.sort(np.random.default_rng(2).integers(0, 1 << 62, 5000).astype(np.uint64))
    for base in (0, int(hashes[0])):
        assert (unpack_sorted(pack_sorted(hashes, base), base) == hashes).all()
    far = np.array([5, 1 << 60], np.uint64)
    assert (unpack_sorted(pack_sorted(far, 0), 0) == far).all()


def test_substrings_against_brute_force(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    want = brute_substrings(rows)
    for chunk in (12_000_000, 20_000):  # one chunk, and many
        got = dedup_substrings(documents, digest=True, chunk_bytes=chunk).collect()
        assert sorted((tuple(r) for r in got), key=ORDER) == want
    assert sum(r[2] for r in want) > 0


def test_substrings_of_odd_rows(odd, empty):
    got = dedup_substrings(odd, digest=True).collect()
    assert sorted((tuple(r) for r in got), key=ORDER) == brute_substrings([r[:2] for r in ODD_ROWS])
    texts = dedup_substrings(odd)
    assert texts.columns == [*odd.columns, "_removed"]
    found = {(r["doc_id"], r["text"]) for r in texts.collect()}
    assert (2, "") in found and (3, None) in found and (5, " \t\n\r ") in found and (7, ODD_ROWS[8][1]) in found
    assert all(r[c] == "x" for r in texts.collect() for c in CLASHES)
    assert dedup_substrings(empty).count() == 0 == dedup_substrings(empty, digest=True).count()


def test_removed_text_and_spans(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, f"start {passage}\nend"), (2, f"other  start {passage} tail\tend"), (3, "nothing to see here")]
    out = {r["doc_id"]: r for r in dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1]["text"] == rows[0][1] and out[3]["text"] == rows[2][1]
    # "start" and the passage stand in both.
    assert out[2]["text"] == "other tail end" and [tuple(x) for x in out[2]["removed"]] == [(1, 62)]


def plain_fingerprint(text, n=3):
    found = [w.translate(ASCII_LOWER) for w in words(text)]
    if not found:
        return 0
    shingles = [b" ".join(found[i : i + n]) for i in range(max(1, len(found) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=3):
    """Smallest member of each fingerprint's component."""
    every = sorted(set(prints))
    values, root = np.array(every, np.uint64), {p: p for p in every}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for k, p in enumerate(every):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= radius):
            a, b = find(p), find(every[k + 1 + j])
            root[max(a, b)] = min(a, b)
    return {p: find(p) for p in every}


def brute_groups(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    roots, least = brute_components(prints), {}
    for (doc_id, _), p in zip(rows, prints, strict=True):
        known = least.get(roots[p])
        least[roots[p]] = doc_id if known is None else known if doc_id is None else min(known, doc_id)
    out = [(d, f"{p:016x}", least[roots[p]]) for (d, _), p in zip(rows, prints, strict=True)]
    return sorted(out, key=lambda t: (ORDER((t[0],)), t[1]))


def test_fingerprints():
    for text in (None, "", "One", "one two", "one two three", "A b C d É f É f A b C", "x " * 500):
        assert fingerprint(text) == plain_fingerprint(text)


def test_masks_cover_every_pair_within_the_radius():
    rng = np.random.default_rng(3)
    for radius in (1, 2, 3, 4):
        masks = covering_masks(list(range(64)), radius)
        assert len(masks) == 2 ** (radius + 1) - 1
        for _ in range(500):
            difference = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
            assert any(not m & difference for m in masks)


def test_groups_against_brute_force(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in simhash_groups(documents).collect()), key=lambda t: (ORDER((t[0],)), t[1]))
    assert got == brute_groups(rows)
    kept = sorted(r["doc_id"] for r in drop_near_duplicates(documents).collect())
    assert kept == sorted({r[2] for r in got})


def test_large_buckets_go_through_all_levels(spark):
    rng, prints = np.random.default_rng(1), set()
    for base in rng.integers(0, 1 << 63, 4).tolist():
        prints.add(base)
        for _ in range(300):
            prints.add(base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 9), replace=False)))
    signed = {p: int(np.uint64(p).view(np.int64)) for p in prints}
    table = spark.createDataFrame([(s,) for s in signed.values()], "print long")
    roots = {r["node"]: r["root"] for r in connected_components(link_fingerprints(table, 3, bucket=8)).collect()}
    want = brute_components(prints)
    groups = {}
    for p, root in want.items():
        groups.setdefault(root, set()).add(roots.get(signed[p], signed[p]))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (7, 7), (300, 301)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r["node"], r["root"]) for r in found} == {(i, 0) for i in range(61)} | {
        (100, 100), (200, 100), (300, 300), (301, 300)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_of_odd_rows(odd, empty):
    got = sorted((tuple(r) for r in simhash_groups(odd).collect()), key=lambda t: (ORDER((t[0],)), t[1]))
    assert got == brute_groups([r[:2] for r in ODD_ROWS])
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    # One row for each component; doc_id 8 names two, as it stands for two texts.
    assert kept.count() == len(set(brute_components([plain_fingerprint(r[1]) for r in ODD_ROWS]).values()))
    assert simhash_groups(empty).count() == 0 == drop_near_duplicates(empty).count()
