"""Language identification and pseudo-likelihood."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from tessera.llm import langid, lm
from tessera.llm.langid import Model, Scorer, identify, keep_identified
from tessera.llm.lm import Network, Vocabulary, count_words, pseudo_likelihood
from tests.llm.conftest import ODD_ROWS


def test_held_out_accuracy(documents):
    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    got = identify(documents).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held) > 0


def test_one_stray_row_draws_in_no_other_language(spark, documents):
    rows = documents.select("doc_id", "text", "lang")
    ids = [i for i in range(10**9, 10**9 + 9) if zlib.crc32(str(i).encode()) % 3 != 1]
    for stray in ("Qua zuru, wexo!", "the und les"):
        more = spark.createDataFrame([(ids[0], stray, "xx"), (ids[1], "zuru wexo", None)], rows.schema)
        got = {r["doc_id"]: r["lang_pred"] for r in identify(rows.union(more)).collect()}
        truth = {r["doc_id"]: r["lang"] for r in rows.collect()}
        assert "xx" not in [got[k] for k in truth]
        assert sum(got[k] == v for k, v in truth.items()) >= 0.97 * len(truth)
        assert stray != "Qua zuru, wexo!" or got[ids[0]] == got[ids[1]] == "xx"


def test_nothing_is_learned_from_held_out_rows(spark):
    rows = [(i, "alpha beta gamma" if zlib.crc32(str(i).encode()) % 3 == 1 else "uno dos tres", 
             "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else "es", "s") for i in range(60)]
    got = identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert {r["lang_pred"] for r in got} == {"es"}


def test_words_first_then_shorter_grams():
    model = Model({"a": {"haus": 5}, "b": {"maison": 5}}, {"a": {"ha": 9, "h": 9}, "b": {"mai": 9, "m": 9}})
    assert model.scores(["haus"])[0].tolist() == model.word_rows[model.words["haus"]].tolist()
    assert model.back_off("hat")[0] == [model.grams["ha"]] and model.back_off("hat")[1] == 2
    found = [r[0] for r in Scorer(model).predict(["haus", "MAIS!", "hat", None, "12 ... \n", ""])]
    assert found == ["a", "b", "a", "und", "und", "und"]


def test_language_of_odd_rows(odd, empty):
    got = identify(odd).collect()
    assert len(got) == len(ODD_ROWS)
    for r in got:
        if r["doc_id"] in (3, 4, 5):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    kept = keep_identified(odd)
    assert kept.columns == odd.columns and 0 < kept.count() < len(ODD_ROWS)
    assert identify(empty).count() == 0 == keep_identified(empty).count()
    unlabelled = odd.selectExpr("doc_id", "text", "cast(NULL AS string) AS lang")
    assert {r["lang_pred"] for r in identify(unlabelled).collect()} == {"und"}


def plain_score(network, classes):
    """Word by word, with no vectors over places."""
    padded = [lm.EDGE] * lm.SIDE + list(classes) + [lm.EDGE] * lm.SIDE
    total = 0.0
    for i, goal in enumerate(classes):
        around = padded[i : i + lm.SIDE] + padded[i + lm.SIDE + 1 : i + 2 * lm.SIDE + 1]
        hidden = np.tanh(sum(network.context[k][c].astype(float) for k, c in enumerate(around)) + network.bias)
        scores = hidden @ network.out.astype(float) + network.prior
        total += scores[goal] - math.log(np.exp(scores).sum())
    return total


def test_scores_against_a_plain_loop():
    rng = np.random.default_rng(4)
    network = Network(rng.normal(0, 0.3, Network().flat.shape))
    for n in (1, 2, 5, 300):
        classes = rng.integers(0, lm.CLASSES, n).astype(np.int16)
        got = network.log_probabilities(Network.contexts(classes, np.arange(n)), classes).sum()
        assert abs(got - plain_score(network, classes)) < 1e-3 * n


def test_the_word_itself_is_masked():
    classes = np.arange(10, dtype=np.int16)
    other = classes.copy()
    other[4] = 99
    assert (Network.contexts(classes, np.array([4])) == Network.contexts(other, np.array([4]))).all()


def test_sampled_contexts_are_those_of_all_words():
    vocabulary, text = Vocabulary([b"a", b"b"]), "a b c D e f a B c " * 7
    classes = vocabulary.classes(text)
    for first, every in ((0, 16), (3, 5), (0, 1), (80, 16)):
        around, goal = vocabulary.sampled(text, first, every)
        at = np.arange(first, len(classes), every)
        assert (around == Network.contexts(classes, at)).all() and (goal == classes[at]).all()
    assert vocabulary.sampled(None, 0, 16)[0].shape == (4, 0)


def test_gradient_steps_learn_both_sides():
    rng = np.random.default_rng(5)
    left, right = rng.integers(0, 16, 6000), rng.integers(0, 16, 6000)
    context = np.full((4, 6000), lm.EDGE)
    context[1], context[2] = left, right
    target = np.where(left % 2 == 0, right, left)
    network = Network(prior=np.zeros(lm.CLASSES))
    before = network.log_probabilities(context, target).mean()
    for _ in range(12):
        network.train(context, target, 0.5)
    assert network.log_probabilities(context, target).mean() > before + 3


def test_training_beats_word_frequencies(spark, documents):
    counts = {bytes(r["word"]): r["n"] for r in count_words(documents).collect()}
    top = sorted(counts, key=lambda w: (-counts[w], w))[: lm.COMMON]
    total, vocabulary = sum(counts.values()), Vocabulary(top)
    own = np.array([counts[w] for w in top], float)
    rest = np.full(lm.CLASSES - lm.COMMON, (total - own.sum()) / (lm.CLASSES - lm.COMMON))
    prior = np.log((np.concatenate([own, rest]) + 1) / (total + lm.CLASSES))
    flat = Network(np.zeros_like(Network().flat), prior=prior)
    base = n = 0
    for r in documents.collect():
        classes = vocabulary.classes(r["text"])
        base += flat.log_probabilities(Network.contexts(classes, np.arange(len(classes))), classes).sum()
        n += len(classes)
    got = pseudo_likelihood(documents).collect()
    assert sum(r["n_words"] for r in got) == n
    assert sum(r["log_likelihood"] for r in got) > base


def test_likelihood_of_odd_rows(odd, empty):
    got = pseudo_likelihood(odd).collect()
    assert len(got) == len(ODD_ROWS)
    for r in got:
        assert (r["n_words"] == 0) == (r["mean_log_likelihood"] is None) and r["log_likelihood"] <= 0
    assert pseudo_likelihood(empty).count() == 0


def test_token_scores_tell_words_of_a_class_apart(spark, documents):
    junk = [(10**9 + i, f"zq{i}xtion zr{i}ytion ZS{i}wtion", "s") for i in range(20)]
    rows = documents.select("doc_id", "text", "source").union(spark.createDataFrame(junk, "a long, b string, c string"))
    counts = {bytes(r["word"]): r["n"] for r in count_words(rows).collect()}
    vocabulary = Vocabulary(sorted(counts, key=lambda w: (-counts[w], w))[: lm.COMMON])
    sizes = np.zeros(lm.CLASSES)
    for w, n in counts.items():
        sizes[vocabulary.of([w])[0]] += n
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    for known in (lm.KNOWN, 300):  # from the ranked words alone, and with a join for the others
        got = pseudo_likelihood(rows, known=known).collect()
        assert len(got) == len(texts)
        for r in got:
            found = (texts[r["doc_id"]] or "").encode().translate(lm.ASCII_LOWER).split()
            want = sum(math.log(counts[w] / sizes[vocabulary.of([w])[0]]) for w in found)
            assert abs(r["token_log_likelihood"] - r["log_likelihood"] - want) < 1e-6 * (1 + len(found))


def test_every_word_of_short_texts_is_trained(spark):
    # By a hash of their first letters, texts of three words could be left out of both rounds.
    text = next(t for t in (f"alpha beta{k} gamma" for k in range(99))
                if all(xxhash.xxh32_intdigest(t, turn) % 16 >= 3 for turn in (0, 1)))
    rows = spark.createDataFrame([(i, text) for i in range(600)], "doc_id long, text string")
    common = sorted(text.encode().split())
    prior = np.log(np.array([1 / 3] * 3 + [1e-6] * (lm.CLASSES - 3)))
    classes = Vocabulary(common).classes(text)
    context = Network.contexts(classes, np.arange(3))
    before = Network(np.zeros_like(Network().flat), prior=prior).log_probabilities(context, classes).sum()
    after = lm.train_network(rows, common, prior, 2).log_probabilities(context, classes)
    assert after.sum() > before + 1 and after.min() > before / 3


def plain_two_level(network, context, target):
    """Word by word in double precision: log-probabilities, and the gradient of their mean's negative."""
    parts = {name: np.array(getattr(network, name), np.float64) for name in network.SHAPES}
    slope = {name: np.zeros_like(p) for name, p in parts.items()}
    logs = []
    for i, goal in enumerate(target):
        group, number = int(goal) % lm.GROUPS, int(goal) // lm.GROUPS
        hidden = np.tanh(sum(parts["context"][k][context[k][i]] for k in range(2 * lm.SIDE)) + parts["bias"])
        levels = ((hidden @ parts["upper"] + parts["first"], group), (hidden @ parts["lower"][group] + parts["second"][group], number))
        shares = [np.exp(s - s.max()) / np.exp(s - s.max()).sum() for s, _ in levels]
        logs.append(sum(math.log(share[at]) for share, (_, at) in zip(shares, levels)))
        for share, (_, at) in zip(shares, levels):
            share[at] -= 1
        slope["upper"] += np.outer(hidden, shares[0])
        slope["first"] += shares[0]
        slope["lower"][group] += np.outer(hidden, shares[1])
        slope["second"][group] += shares[1]
        back = (parts["upper"] @ shares[0] + parts["lower"][group] @ shares[1]) * (1 - hidden * hidden)
        slope["bias"] += back
        for k in range(2 * lm.SIDE):
            slope["context"][k][context[k][i]] += back
    return np.array(logs), {name: s / len(target) for name, s in slope.items()}


def random_words(n, seed=3):
    rng = np.random.default_rng(seed)
    classes = np.minimum(rng.zipf(1.3, n) - 1, lm.CLASSES - 1).astype(np.int16)
    return Network.contexts(classes, np.arange(n)).astype(np.int16), classes


def test_two_level_scores_and_steps_against_a_plain_loop():
    rng = np.random.default_rng(6)
    network = lm.TwoLevel(rng.normal(0, 0.3, lm.TwoLevel().flat.shape))
    context, target = random_words(400)
    want, slope = plain_two_level(network, context, target)
    assert np.abs(network.log_probabilities(context, target) - want).max() < 1e-3
    before = {name: np.array(getattr(network, name)) for name in network.SHAPES}
    network.train(context, target, 0.1)
    for name, old in before.items():
        moved = old - 0.1 * slope[name] / np.sqrt(1e-6 + slope[name] ** 2)
        assert np.abs(getattr(network, name) - moved).max() < 2e-3, name
    large = lm.TwoLevel(rng.normal(0, 40, network.flat.shape))
    assert not large.bounded() and np.isfinite(large.log_probabilities(context, target)).all()


def test_groups_start_at_the_frequencies_of_their_classes():
    prior = np.log(np.random.default_rng(2).dirichlet(np.ones(lm.CLASSES)))
    network = lm.TwoLevel(np.zeros_like(lm.TwoLevel().flat), prior=prior)
    context, target = random_words(300)
    assert np.abs(network.log_probabilities(context, target) - prior[target]).max() < 1e-4


def test_scores_do_not_depend_on_files_or_tasks(spark, documents, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_WORDS", 9000)  # several shards, whose copies are averaged
    rows = documents.select("doc_id", "text")
    found = []
    for parts in (1, 8, 32):
        got = pseudo_likelihood(rows.repartition(parts)).collect()
        found.append({r["doc_id"]: (r["log_likelihood"], r["token_log_likelihood"]) for r in got})
    assert len(found[0]) == documents.count()
    for other in found[1:]:
        assert all(abs(a - b) <= 1e-5 * (1 + abs(a)) for k, pair in found[0].items() for a, b in zip(pair, other[k]))


def test_commonest_words_by_the_histogram(spark):
    rows = [(f"w{i:05d}".encode(), 1 + (5000 - i) // 7) for i in range(5000)]
    counts = spark.createDataFrame(rows, "word binary, n long")
    for known in (1000, 2500, 10_000):
        top, left = lm.commonest(counts, known)
        assert max(lm.COMMON, 0) <= len(top) <= known and top == sorted(rows, key=lambda r: (-r[1], r[0]))[: len(top)]
        assert all(n <= left for _, n in sorted(rows, key=lambda r: (-r[1], r[0]))[len(top) :])
    few, left = lm.commonest(counts, 10)  # the network's own words come in any case
    assert len(few) == lm.COMMON and few == sorted(rows, key=lambda r: (-r[1], r[0]))[: lm.COMMON]
    assert lm.commonest(counts.limit(0), 10) == ([], 0)


def test_words_of_many_texts_are_classed_together(monkeypatch):
    """As one by one, and with one hash for each ending instead of one for each word."""
    rng = np.random.default_rng(8)
    known = [f"w{k}".encode() for k in range(2000)]
    texts = [None, "", " ", "\t a B\x0b\x0cc\x1cd \n", "W3 w3\u2003w1999 W2000", "".join(f"{chr(i)}X" for i in range(256)), "Größe 日本語"]
    texts += [" ".join(f"W{k}" for k in rng.integers(0, 4000, rng.integers(0, 60))) for _ in range(200)] + [""]
    for ranked, part in ((known, slice(0, 300)), (known[:300], slice(3, 100)), ([], slice(0, 9)), (known, slice(0, 0))):
        one_by_one, together = Vocabulary(ranked[: lm.COMMON]), lm.Ranks(ranked[: lm.COMMON], ranked)
        found, sizes = lm.split_words(pa.array(texts, pa.string())[part])
        plain = [lm.words(t) for t in texts[part]]
        assert sizes.tolist() == [len(w) for w in plain]
        assert found.to_pylist() == [w.translate(lm.ASCII_LOWER) for text in plain for w in text]
        classes, ranks = together.of(found)
        assert ranks.tolist() == [ranked.index(w) if w in ranked else len(ranked) for w in found.to_pylist()]
        each = [one_by_one.classes(t) for t in texts[part]]
        assert classes.tolist() == [c for text in each for c in text.tolist()]
        around = [Network.contexts(c, np.arange(len(c))).T.tolist() for c in each]
        assert lm.all_contexts(classes, sizes).T.tolist() == [c for text in around for c in text]
        times = lm._times(found, np.repeat(np.arange(len(sizes)), sizes), len(sizes)).to_pylist()
        counted = [Counter(w.translate(lm.ASCII_LOWER) for w in text) for text in plain]
        assert [{r["word"]: r["times"] for r in text} for text in times] == counted
    hashed, digest = [], xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda *a: hashed.append(a) or digest(*a))
    found, _ = lm.split_words(pa.array([" ".join(f"{k}{end}" for k in range(3000) for end in ("abc", "xyz"))]))
    assert len(set(lm.Ranks(known[:9]).of(found)[0].tolist())) == len(hashed) == 2


def test_counts_of_more_words_than_are_held(spark):
    # In one task: batches whose words are the same are merged, those with too many new ones are passed on.
    number = "IF(id < 10000, id % 900, id) * 400 + k"
    text = f"concat('Same ', array_join(transform(sequence(0, 399), k -> concat('w', {number})), ' '), ' same')"
    rows = spark.range(0, 13_000, 1, 1).selectExpr("id AS doc_id", f"{text} AS text")
    got = count_words(rows).selectExpr("count(*) AS words", "sum(n) AS n", "max(n) AS most", "max_by(word, n) AS word").first()
    assert (got["words"], got["n"], got["most"], bytes(got["word"])) == (1 + 400 * 3900, 402 * 13_000, 26_000, b"same")


def test_every_label_is_learned(spark):
    """Also more than 200, and a model too large is an error."""
    letters = "abcdefghij"
    rows = []
    for k in range(230):
        word = "".join(letters[int(d)] for d in f"{k:03d}")
        rows += [(k * 10 + j, f"{word}x {word}y {word}z", f"l{k:03d}") for j in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in identify(docs).collect()}
    learned = {lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    known = [(i, lang) for i, _, lang in rows if lang in learned]
    assert len(learned) > 200 and sum(got[i] == lang for i, lang in known) >= 0.98 * len(known)


def test_models_that_are_too_large(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} other", "en") for i in range(9)], "doc_id long, text string, lang string")
    monkeypatch.setattr(langid, "MAX_ENTRIES", 5)
    with pytest.raises(ValueError, match="counts"):
        langid.train(docs)
    monkeypatch.setattr(langid, "MAX_LABELS", 0)
    with pytest.raises(ValueError, match="labels"):
        langid.train(docs)


def plain_back_off(model, text):
    """Language and score by the model's counts, word by word and language by language."""
    sums, letters = dict.fromkeys(model.languages, 0.0), False
    for token in (text or "").split():
        word = "".join(c for c in token if c.isalpha()).lower()
        if not word:
            continue
        letters = True
        if word in model.words:
            each = model.word_rows[model.words[word]]
        else:
            marked, open_places, found, steps = f"^{word}$", set(range(len(word) + 2)), [], 0
            for step, n in enumerate(langid.SIZES):
                hit = set()
                for i in range(len(marked) - n + 1):
                    here = set(range(i, i + n))
                    if (open_places - hit) & here and marked[i : i + n] in model.grams:
                        hit |= here
                        found.append(model.gram_rows[model.grams[marked[i : i + n]]])
                        steps += step
                open_places -= hit
                if not open_places:
                    break
            each = (sum(found) + langid.BACKOFF * steps) / len(found) if found else [math.log(1e-7)] * len(sums)
        for lang, value in zip(model.languages, each):
            sums[lang] += value
    if not letters:
        return "und", 0.0
    best = max(model.languages, key=lambda k: (sums[k], [-ord(c) for c in k]))
    return best, 1 / sum(math.exp(max(s - sums[best], -700)) for s in sums.values())


def test_predictions_against_a_plain_back_off(spark, documents):
    model = langid.train(documents)
    rows = documents.select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(documents).collect()}
    for r in rows:
        lang, score = plain_back_off(model, r["text"])
        assert got[r["doc_id"]][0] == lang and abs(got[r["doc_id"]][1] - score) < 1e-6
