"""Benchmark decontamination and chat snapshots."""

from __future__ import annotations

import random

from tessera.llm.chat import render_maximal
from tessera.llm.decontam import PIECED, ItemIndex, best_match, drop_contaminated, find_leaks, normal_word
from tests.llm.conftest import ODD_ROWS


def edit_distance_in(item, text):
    """Least edit distance of the item to any part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_exact_check_against_the_full_table():
    rng = random.Random(3)
    for _ in range(400):
        item = [rng.randrange(4) for _ in range(rng.randint(1, 12))]
        text = [rng.randrange(4) for _ in range(rng.randint(0, 20))]
        want = edit_distance_in(item, text)
        for most in (0, 2, 12):
            got = best_match(item, text, most)
            assert (got[0] if got else None) == (want if want <= most and text else None)


def edited(text, share, rng):
    found = text.split()
    for p in rng.sample(range(len(found)), int(share * len(found))):
        found[p] = rng.choice(["zz%d" % rng.randrange(999), "", found[p] + " zq"])
    return " ".join(found)


def test_recall_of_edited_passages(spark, sf_dir, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    index, hosts = ItemIndex(items, 0.2), [r["text"] for r in documents.limit(100).collect()]
    rng = random.Random(5)
    for share, least in ((0.0, 1.0), (0.1, 0.95), (0.18, 0.9)):
        hits = 0
        for key, text in items * 2:
            host = rng.choice(hosts).split()[:400]
            at = rng.randrange(len(host) + 1)
            planted = " ".join([*host[:at], edited(text, share, rng), *host[at:]])
            hits += any(m[0] == key for m in index.search([planted])[0])
        assert hits >= least * 2 * len(items), share


def test_items_at_a_texts_start_without_their_first_words():
    rng = random.Random(7)
    items = [(i, " ".join(f"w{rng.randrange(20_000)}" for _ in range(60))) for i in range(40)]
    index = ItemIndex(items, 0.2)
    for lost in (0, 1, 2, 3, 8):
        # Several texts in one call: each one but the first has another text before it.
        texts = [" ".join([*text.split()[lost:], "and", "more", "words"]) for _, text in items]
        for (key, _), matches in zip(items, index.search(texts), strict=True):
            assert [m[:3] for m in matches] == [(key, lost, 0)], lost


def test_recall_of_each_item_length_at_the_most_edits():
    rng = random.Random(11)
    some = lambda n: [f"w{rng.randrange(20_000)}" for _ in range(n)]
    for size in (1, 4, 5, 9, 11, 12, 13, 14, 16, 18, 20, 24, 25, 30, 40, 47, 48, 60, 100):
        items = [(i, " ".join(some(size))) for i in range(60)]
        index, texts = ItemIndex(items, 0.2), []
        for _, text in items:
            found = text.split()
            for p in rng.sample(range(size), int(0.2 * size)):
                found[p] = rng.choice(["zz", "", found[p] + " zq"])
            texts.append(" ".join([*some(20), *found, *some(20)]))
        hits = sum(any(m[0] == key for m in got) for (key, _), got in zip(items, index.search(texts), strict=True))
        assert hits == 60 if size < PIECED else hits >= 57, size


def test_leaks_are_what_an_exact_search_finds(spark, sf_dir, documents):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in find_leaks(documents, benchmark).collect()}
    assert got == {(r["doc_id"], r["item_id"]) for r in find_leaks(documents, benchmark, block_items=7).collect()}
    rows, items = documents.collect(), benchmark.collect()
    assert {(d["doc_id"], i["item_id"]) for d in rows for i in items if i["text"] in d["text"]} <= got
    norm = lambda t: [normal_word(w) for w in t.encode().split()]
    texts, wanted = {d["doc_id"]: norm(d["text"]) for d in rows}, {i["item_id"]: norm(i["text"]) for i in items}
    for doc_id, item_id in got:  # every row is within the allowed edits
        assert edit_distance_in(wanted[item_id], texts[doc_id]) <= 0.2 * len(wanted[item_id])
    clean = {r["doc_id"] for r in drop_contaminated(documents, benchmark).collect()}
    assert clean == set(texts) - {d for d, _ in got}


def test_leaks_of_odd_rows(spark, odd, empty):
    items = spark.createDataFrame(
        [(1, "One two, three FOUR five six seven eight nine ten eleven twelve thirteen fourteen"), (2, None), (3, ""),
         (None, "alpha beta gamma delta"), (4, "another text with"), (4, "another text with"), (5, "...")],
        "item_id long, text string",
    )
    got = sorted((r["doc_id"], r["item_id"]) for r in find_leaks(odd, items).collect())
    assert got == [(1, 1), (2, 1), (2, 1), (8, 4), (8, 5)]
    kept = drop_contaminated(odd, items)
    assert kept.columns == odd.columns and kept.count() == len(ODD_ROWS) - 5
    assert find_leaks(empty, items).count() == 0 == find_leaks(odd, items.limit(0)).count()
    assert drop_contaminated(odd, items.limit(0)).count() == len(ODD_ROWS) and drop_contaminated(empty, items).count() == 0


def brute_maximal(rows):
    talks = {}
    for conv, _, role, text in sorted(rows, key=lambda r: (r[0], r[1] is None, r[1] or 0)):
        talks.setdefault(conv, []).append((role, text))
    inner = {tuple(t[:n]) for t in talks.values() for n in range(1, len(t))}
    first = {}
    for conv in sorted(talks):
        first.setdefault(tuple(talks[conv]), conv)
    return {
        conv: "".join(f"<|im_start|>{r or 'user'}\n{x or ''}<|im_end|>\n" for r, x in talk)
        for talk, conv in first.items() if talk not in inner
    }


def rendered(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["conv_id"], r["segment"])):
        out[r["conv_id"]] = out.get(r["conv_id"], "") + r["rendered"]
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def test_conversations_against_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    # Snapshots, a repeat, and one conversation that many partitions share.
    rows += [(10_000 + c, t, r, x) for c, t, r, x in rows if t < 2] + [(20_000 + c, t, r, x) for c, t, r, x in rows]
    rows += [(50_000, t, "user", f"turn {t}") for t in range(500)] + [(50_001, t, "user", f"turn {t}") for t in range(320)]
    for segment in (256, 3):
        out = render_maximal(spark.createDataFrame(rows, SCHEMA).repartition(8), segment_turns=segment)
        assert rendered(out) == brute_maximal(rows)


def test_odd_conversations(spark):
    rows = [
        (1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, None, None), (3, 0, None, "hi"), (4, 0, "user", None), (5, 0, "user", ""),
        (6, None, "user", "late"), (6, 0, "user", "early"), (7, 0, "user", "same"), (7, 0, "user", "same"), (None, 0, "user", "lost"),
        (8, 0, "user", "same"),
    ]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", n string, part string")
    got = rendered(render_maximal(table))
    assert got == brute_maximal([r for r in rows if r[0] is not None])
    assert set(got) == {2, 3, 4, 5, 6, 7} and got[6].index("early") < got[6].index("late")
    assert render_maximal(table.limit(0)).count() == 0


def plain_span(item, text):
    """(distance, shortest spans) of the item against every part of the text, by the full table."""
    best, spans = len(item) + 1, set()
    for start in range(len(text) + 1):
        row = list(range(len(item) + 1))
        for end in range(start, len(text) + 1):
            if row[-1] < best:
                best, spans = row[-1], set()
            if row[-1] == best:
                spans.add((start, end))
            if end < len(text):
                new = [row[0] + 1]
                for j, word in enumerate(item):
                    new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (word != text[end])))
                row = new
    return best, spans


def test_spans_of_edited_items_against_the_full_table(spark):
    """Starts too: inserted and missing words move them."""
    rng = random.Random(8)
    words_of = [f"w{i}" for i in range(400)]
    items = [(i, [rng.choice(words_of) for _ in range(n)]) for i, n in enumerate((10, 15, 20, 30, 48, 60, 80))]
    docs, planted = [], {}
    for i, item in items:
        for kind in range(4):
            edited = list(item)
            for _ in range(min(kind, len(item) // 5)):
                at = rng.randrange(1, len(edited) - 1)
                how = rng.randrange(3)
                edited[at : at + (how != 0)] = [f"x{rng.randrange(99)}"] if how < 2 else []
            before = [f"b{rng.randrange(99)}" for _ in range(kind * 3)]
            text = [*before, *edited, *[f"a{rng.randrange(99)}" for _ in range(5)]]
            planted[len(docs)] = (i, item, text)
            docs.append((len(docs), " ".join(text)))
    out = find_leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                     spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r for r in out.collect()}
    assert set(got) == {(d, i) for d, (i, _, _) in planted.items()}
    for d, (i, item, text) in planted.items():
        distance, spans = plain_span(item, text)
        row = got[(d, i)]
        assert row["distance"] == distance and (row["start_word"], row["end_word"]) in spans


def test_ids_that_are_text(spark):
    docs = spark.createDataFrame([("d1", "one two three four five"), ("7", "one two three four five")], "doc_id string, text string")
    items = spark.createDataFrame([("x", "one two three four five"), ("3", "one two three four five")], "item_id string, text string")
    assert sorted(((r["doc_id"] or 0), r["item_id"]) for r in find_leaks(docs, items).collect()) == [(0, 3), (7, 3)]
