"""The operators' methods against brute force, round trips and held-out accuracy."""

import random
import re
import zlib
from collections import Counter
from math import log

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from spanloom.llm import decontam, langid, licences, lm, packing, quality, rules, sampling, simhash, substrings, urls
from spanloom.llm.common import table
from spanloom.llm.components import components
from spanloom.llm.queries import QUERIES

MID_DIR = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _pandas(spark, name, sf_dir=MID_DIR):
    return table(spark, sf_dir, name).toPandas()


# 1: licences

def test_variant_of_a_licence_has_its_digest(spark):
    text = dict((i, t) for i, t in licences.NOTICES if len(t) > 500)["MIT"]
    variant = ("  Copyright (C) 2020, Some Body.\n\n" + text.upper().replace("LICENSE", "LICENCE").replace(",", " -- "))
    docs = spark.createDataFrame([(1, variant), (2, "x\nReleased under the  M.I.T licence\ny"), (3, text + " and more"),
                                  (4, "prose\nreleased under the mit license!\nReleased under the MIT License.")],
                                 "doc_id bigint, text string")
    got = {r.doc_id: (r.license_id, r.notice_ids, r.n_notices)
           for r in licences.scan_licences(docs, licences.known_digests(spark)).collect()}
    assert got[1][0] == "MIT" and got[3][0] is None and got[4] == (None, "MIT", 2) and got[2] == (None, "", 0)


# 3: SimHash

def test_segments_within_one_bit_share_a_codeword():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    index = simhash.codeword_indices(words)
    assert set((index >= 0).sum(axis=1)) == {1, 6}
    for bit in range(23):
        other = simhash.codeword_indices(words ^ (1 << bit))
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(index, other))


@given(st.integers(0, 2**64 - 1), st.integers(0, 63), st.integers(0, 63))
@settings(max_examples=300, deadline=None)
def test_prints_within_two_bits_share_a_key(value, a, b):
    near = value ^ (1 << a) ^ (1 << b if a != b else 0)
    keys = simhash.golay_keys(np.array([value, near], np.uint64).view(np.int64))
    assert set(keys[0][keys[0] >= 0]) & set(keys[1][keys[1] >= 0])


def _plain_groups(prints):
    root = {d: d for d, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (d, p) in enumerate(prints):
        for e, q in prints[:i]:
            if (p ^ q).bit_count() <= 2:
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: find(d) for d, _ in prints}


@pytest.mark.parametrize("pairs_up_to", [64, 1])
def test_groups_equal_brute_force(spark, monkeypatch, pairs_up_to):
    """Also where every shared key counts as crowded."""
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", pairs_up_to)
    rng = random.Random(3)
    prints = []
    for _ in range(12):
        p = rng.getrandbits(64)
        for _ in range(25):
            prints.append(p)
            p ^= sum(1 << rng.randrange(64) for _ in range(rng.randrange(4)))
    prints = [(i, p & (1 << 64) - 1) for i, p in enumerate(dict.fromkeys(prints))]
    signed = [(p - (1 << 64) if p >> 63 else p, i) for i, p in prints]
    nodes = spark.createDataFrame(signed, "print bigint, node bigint")
    got = {r.node: r.root for r in components(simhash.near_links(nodes)).collect()}
    want = _plain_groups(prints)
    assert {i: got.get(i, i) for i, _ in prints} == want


@pytest.mark.parametrize("max_bits", [0, 1])
@pytest.mark.parametrize("pairs_up_to", [64, 1])
def test_smaller_radius(spark, monkeypatch, max_bits, pairs_up_to):
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", pairs_up_to)
    rng = random.Random(5)
    prints = [p ^ (1 << rng.randrange(63)) if i % 2 else p for p in (rng.getrandbits(63) for _ in range(30)) for i in range(8)]
    nodes = spark.createDataFrame(list(enumerate(dict.fromkeys(prints))), "node bigint, print bigint")
    got = {frozenset((r.a, r.b)) for r in simhash.near_links(nodes, max_bits).collect()}
    rows = list(enumerate(dict.fromkeys(prints)))
    want = {frozenset((i, j)) for i, p in rows for j, q in rows if i < j and (p ^ q).bit_count() <= max_bits}
    assert got == want
    with pytest.raises(ValueError):
        simhash.near_links(nodes, 3)


@pytest.mark.parametrize("kind", ["string", "int", "bigint"])
def test_ids_of_other_types(spark, kind):
    """Near copies and repeats have the same groups whatever the type of the id."""
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(3, "a b c d"), (1, "a b c d"), (2, passage), (4, "x y " + passage), (5, None), (None, "a b c d")]
    docs = spark.createDataFrame([(None if i is None else i if kind != "string" else f"n{i}", t) for i, t in rows],
                                 f"doc_id {kind}, text string")
    name = (lambda i: f"n{i}") if kind == "string" else (lambda i: i)
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert groups == {name(1): name(1), name(3): name(1), name(2): name(2), name(4): name(4), name(5): name(5), None: name(1)}
    removed = {r.doc_id: r.n_removed for r in substrings.digest_repeats(docs).collect()}
    assert removed == {name(1): 0, name(2): 0, name(3): 0, name(4): 55, name(5): 0, None: 0}
    assert {r.doc_id: r.text for r in substrings.cut_repeats(docs).collect()}[name(4)] == "x y "


def test_fingerprint_equals_the_definition():
    import xxhash
    for text in (None, "", " \n", "One", "one TWO", "É a A b c d É a A b", "x " * 70_000):
        words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        parts = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
        hashes = Counter(xxhash.xxh64_intdigest(p.encode(), 42) for p in parts)
        want = sum(1 << b for b in range(64) if 2 * sum(n for h, n in hashes.items() if h >> b & 1) > len(parts))
        assert int.from_bytes(simhash.fingerprint(text)) == want


# 4: packing

def test_pieces_are_the_documents_and_sequences_have_no_gaps(spark):
    got = QUERIES["op4_packing"](spark, MID_DIR).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = _pandas(spark, "documents")
    want = {d: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
            for d, t in zip(docs.doc_id, docs.text)}
    seen = Counter()
    for r in got.sort_values(["doc_id", "start"]).itertuples():
        ids = want[r.doc_id]
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
        seen[r.doc_id] += r.length
    assert seen == {d: len(i) for d, i in want.items()}
    got = got.sort_values(["sequence_id", "offset"])
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    sizes = got.groupby("sequence_id").length.sum()
    assert sizes.max() <= 2048 and 1 - sizes.sum() / (2048 * len(sizes)) < 0.02


@pytest.mark.parametrize("text", ["İstanbul İ. x", "a.b,.,c ..", "don't, we'll. 12.5", "é é, ﬁ. क़.", "<|endoftext|>."])
def test_word_tokens_equal_the_tokenizers(text):
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert next(packing.WordTokens(path).of([text])) == np.array([*ids, 1], "<u4").tobytes()


def test_fractional_plan_is_near_the_volume_bound():
    sizes, demand = np.array([3, 5, 7, 11]), np.array([40, 33, 21, 18])
    patterns, times = packing.fractional_plan(sizes, demand, 16)
    assert (patterns @ sizes <= 16).all() and (patterns.T @ times >= demand - 1e-6).all()
    plan = packing.whole_plan(sizes, demand, 16)
    assert (sum(p * n for p, n in plan) >= demand).all()
    assert sum(n for _, n in plan) <= np.ceil(times.sum()) + len(sizes)


@pytest.mark.parametrize("length,documents,sequences", [(1, 4000, 2), (5, 4000, 10), (20, 1000, 10), (70, 400, 14)])
def test_short_documents_leave_little_padding(spark, length, documents, sequences):
    cut = spark.range(documents).selectExpr("id", "0L as start", f"{length}L as length", "id as ids_crc32", f"{length}L as doc_tokens")
    got = packing.pack(cut).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("offset").alias("last")).collect()
    assert sum(r.n for r in got) == length * documents and max(r.n for r in got) <= 2048
    assert len(got) <= sequences and all(r.last == r.n - length for r in got)


def test_short_and_long_documents_together(spark):
    rng = random.Random(9)
    rows = [(i, 0, rng.choice([1, 2, 3, 9, 33, 65, 130, 700, 1500, 2048]), i, 0) for i in range(3000)]
    got = packing.pack(spark.createDataFrame(rows, "id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"))
    sizes = [r.n for r in got.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert sum(sizes) == sum(r[2] for r in rows) and max(sizes) <= 2048
    large = Counter(r[2] for r in rows)  # the short ones fit beside these
    assert len(sizes) <= large[2048] + large[1500] + -(-large[700] // 2) + 10


# 6: rules

def _plain_repeats(words):
    windows = Counter(zip(words, words[1:], words[2:]))
    return len({i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)})


def test_statistics_equal_brute_force(spark):
    got = QUERIES["op6_quality_rules"](spark, MID_DIR).toPandas().set_index("doc_id")
    for d, text in zip(*(_pandas(spark, "documents")[c] for c in ("doc_id", "text"))):
        words, lines = WORDS.findall(text or ""), [x for x in (text or "").split("\n") if WORDS.search(x)]
        want = (len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"),
                len(lines) - len(set(lines)), _plain_repeats(words))
        row = got.loc[d]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == want
        assert row.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (row.base_failed and row.kept)


def test_rules_follow_the_labels_and_their_directions(spark):
    got = QUERIES["op6_quality_rules"](spark, MID_DIR).toPandas().merge(_pandas(spark, "labels"), on="doc_id")
    judged = got[~got.base_failed]
    assert (judged.kept == (judged.quality == 1)).mean() > 0.97
    trees = rules.train(table(spark, MID_DIR, "documents"), table(spark, MID_DIR, "labels"))
    x = np.random.default_rng(0).uniform(0, 1, (500, len(rules.FEATURES))) * [8, 8, 1, 1, 1, 1, 1, 1, 1, 1, 40, 1]
    for f, direction in enumerate(rules.FEATURES.values()):
        more = x.copy()
        more[:, f] += 0.3
        change = trees.score(more) - trees.score(x)
        assert direction == 0 or (direction * change >= -1e-12).all()


def test_flattened_trees_equal_a_walk():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(400, 3)), rng.integers(0, 2, 400).astype(float)
    y[x[:, 0] > 0] = 1
    trees = rules.grow(x, y, np.array([1, 0, 0]))
    for row, got in zip(x[:50], trees.score(x[:50])):
        total = trees.base
        for at in trees.roots:
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.threshold[at] else trees.right[at]
            total += trees.value[at]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))


# 2 and 8: learned, held out

def _plain_bag(net, rows):
    w, hidden, weight = net.weights, [], []
    for x in rows:
        h = np.tanh(sum(x[i] * w["encode"][i] for i in range(len(x))) + w["encode0"])
        t, g = np.tanh(h @ w["attend"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        hidden.append(h)
        weight.append(np.exp(sum(t[k] * g[k] * w["weigh"][k] for k in range(len(t)))))
    z = sum(a * h for a, h in zip(weight, hidden)) / sum(weight)
    return 1 / (1 + np.exp(-(z @ w["out"] + w["out0"][0])))


def _small_network(rng):
    net = quality.fit([], np.zeros(0))
    for k, v in net.weights.items():
        net.weights[k] = rng.normal(0, 0.4, v.shape)
    return net


def test_attention_equals_a_loop_over_passages():
    rng = np.random.default_rng(3)
    net, bags = _small_network(rng), [rng.uniform(0, 1, (n, quality.N_FEATURES)) for n in (1, 4, 7)]
    first = np.cumsum([0, *(len(b) for b in bags[:-1])])
    got = net.forward(np.concatenate(bags), first)
    assert got["p"] == pytest.approx([_plain_bag(net, b) for b in bags])
    assert np.add.reduceat(got["a"], first) == pytest.approx(1)


def test_gradient_equals_finite_differences():
    rng = np.random.default_rng(4)
    net, bags = _small_network(rng), [rng.uniform(0, 1, (n, quality.N_FEATURES)) for n in (2, 1, 5)]
    x, first, y = np.concatenate(bags), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = net.forward(x, first)["p"]
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, slope in net.gradient(x, first, y).items():
        value = net.weights[name]
        for at in {tuple(rng.integers(0, n) for n in value.shape) for _ in range(12)}:
            kept, ends = value[at], []
            for step in (1e-5, -1e-5):
                value[at] = kept + step
                ends.append(loss())
            value[at] = kept
            assert slope[at] == pytest.approx((ends[0] - ends[1]) / 2e-5, abs=1e-7, rel=1e-4), name


def test_languages_equal_a_vote_of_pairs():
    rng = np.random.default_rng(5)
    languages = np.array([["de", "en", "nl", "es", "xx"][i % 5] for i in range(200)])
    x = (rng.uniform(0, 1, (200, 40)) + 2 * (np.arange(40) % 5 == (np.arange(200) % 5)[:, None])).astype(np.float32)
    model = langid.fit(x, languages)
    assert sorted(map(sorted, model.families)) == [["de", "en", "nl"], ["es"], ["xx"]]
    names, score = model.predict(x)
    margin = np.hstack([x, np.ones((200, 1))]) @ model.weights.T
    for i in range(200):
        f = int(np.argmax(margin[i, :3]))
        at = 3 + sum(len(p) for p in model.pairs[:f])
        wins = Counter({name: 0 for name in model.families[f]})
        for k, (a, b) in enumerate(model.pairs[f]):
            wins[model.families[f][a if margin[i, at + k] > 0 else b]] += 1
        assert wins[names[i]] == max(wins.values())
    assert (np.array(names) == languages).mean() > 0.95 and ((score > 0) & (score <= 1)).all()


def test_samples_hold_at_most_their_limit_of_rows(spark):
    rows = [(1, f"text {i}") for i in range(500)] + [(i, f"other {i}") for i in range(2, 90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    targets = spark.createDataFrame([(i, i % 2) for i in range(1, 90)], "doc_id bigint, target int")
    for limit, balanced in ((1, False), (7, False), (7, True), (1000, True)):
        got = sampling.training_texts(docs, targets, limit, 100, balanced=balanced).collect()
        assert len(got) == min(limit, 89)
    plan = sampling.training_texts(docs, targets, 7, 100, balanced=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan.lower()

def test_quality_classifier_on_held_out_documents(spark):
    got = QUERIES["op2_quality_classifier"](spark, MID_DIR).toPandas()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    held = got[got.held_out].merge(_pandas(spark, "labels"), on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.95


def test_language_of_held_out_documents(spark):
    got = QUERIES["op8_language_id"](spark, MID_DIR).toPandas().merge(_pandas(spark, "documents"), on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.97 and got.score.between(0, 1).all()


# 7: decontamination

def _plain_nearest(item, text):
    row = list(range(len(item) + 1))
    best = (row[-1], 0)
    for j, c in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(item, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        best = min(best, (row[-1], j))
    return best


@given(st.text("abc", min_size=1, max_size=90), st.text("abc", max_size=120))
@settings(max_examples=200, deadline=None)
def test_bit_parallel_distance(item, text):
    assert decontam.nearest(item, text) == _plain_nearest(item, text)


@given(st.randoms(use_true_random=False))
@settings(max_examples=60, deadline=None)
def test_every_item_within_its_budget_is_found(rng):
    item = "".join(rng.choice("abcdefg ") for _ in range(rng.randrange(20, 200)))
    edited = list(item)
    for _ in range(len(item) // decontam.CHARS_PER_ERROR):
        at = rng.randrange(len(edited))
        edited[at] = rng.choice(["", "x", edited[at] + "y"])
    text = "zz" * rng.randrange(50) + "".join(edited) + "qq" * rng.randrange(50)
    found = list(decontam.Items([(5, item)]).found_in(text))
    assert [(k, d, e) for k, d, e in found] == [(5, *_plain_nearest(item, text))]


def test_leaks_equal_a_scan_of_all_pairs(spark):
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_benchmark_decontamination"](spark, MID_DIR).collect()}
    docs, items = _pandas(spark, "documents"), _pandas(spark, "benchmark")
    exact = {(d, i) for d, t in zip(docs.doc_id, docs.text) for i, q in zip(items.item_id, items.text)
             if decontam.folded(q) in decontam.folded(t)}
    assert exact and exact <= got


def test_leaks_equal_the_distance_of_all_pairs(spark):
    """Every document against every item, whole texts, without pieces."""
    small = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.item_id): (r.distance, r.match_end) for r in QUERIES["op7_benchmark_decontamination"](spark, small).collect()}
    items = [(i, decontam.folded(q)) for i, q in _pandas(spark, "benchmark", small)[["item_id", "text"]].itertuples(index=False)]
    want = {}
    for d, text in _pandas(spark, "documents", small)[["doc_id", "text"]].itertuples(index=False):
        for i, item in items:
            distance, end = decontam.nearest(item, decontam.folded(text))
            if item and distance <= len(item) // decontam.CHARS_PER_ERROR:
                want[d, i] = distance, end
    assert want and got == want


def test_short_items_are_found_as_words_only(spark):
    docs = spark.createDataFrame([(1, "I know a comparison"), (2, "No! Paris?"), (3, "in Paris, no"), (4, "parisno")], "doc_id bigint, text string")
    items = spark.createDataFrame([(0, "no"), (1, "paris")], "item_id bigint, text string")
    rows = decontam.leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id) for r in rows) == [(2, 0), (2, 1), (3, 0), (3, 1)] and all(r.short for r in rows)
    assert _ids(decontam.drop_leaks(docs, items)) == [1, 4]
    assert _ids(decontam.drop_leaks(docs, items, least_chars=decontam.CHARS_PER_ERROR)) == [1, 2, 3, 4]
    assert decontam.leaks(docs.where("1 = 0"), items).count() == decontam.leaks(docs, items.where("1 = 0")).count() == 0


# 9: language models

@pytest.mark.parametrize("model_rows", [1 << 20, 0])
@pytest.mark.parametrize("min_words,min_pairs", [(1, 2), (2, 2), (3, 3), (100, 100)])
def test_losses_equal_brute_force(spark, monkeypatch, model_rows, min_words, min_pairs):
    """Broadcast or as tables, with words and pairs below the counts that the models take."""
    for name, value in (("MODEL_ROWS", model_rows), ("MIN_WORDS", min_words), ("MIN_PAIRS", min_pairs)):
        monkeypatch.setattr(lm, name, value)
    texts = {1: "a b a b c", 2: "b a d", 3: "a b e f", 4: "c a b", 5: "a b c a b c"}
    target = {1, 4}
    docs = spark.createDataFrame([(i, t, i in target) for i, t in texts.items()],
                                 "doc_id bigint, text string, is_target boolean")
    model = lm.train(docs)
    assert isinstance(model, lm.Tables) == (model_rows == 0 and min_words < 100)
    got = {r.doc_id: (r.target_loss, r.background_loss) for r in lm.cross_entropy(spark, docs, model).collect()}
    for side, chosen in ((0, target), (1, set(texts))):
        seqs = [texts[i].split() for i in chosen]
        one, total = Counter(w for s in seqs for w in s), sum(map(len, seqs))
        two = Counter(p for s in seqs for p in zip(["^", *s], s))
        times = Counter(w for t in texts.values() for w in t.split())
        vocabulary = {w for w, n in times.items() if n >= min_words}
        every = Counter(p for t in texts.values() for p in zip(["^", *t.split()], t.split()))
        kept = {p for p in every if every[p] >= min_pairs}
        unseen = sum(n for w, n in one.items() if w not in vocabulary)
        context = Counter({**one, "^": len(seqs)})

        def p_word(w):
            return ((one[w] if w in vocabulary else unseen) + lm.SMOOTH) / (total + lm.SMOOTH * (len(vocabulary) + 1))

        def p_next(v, w):
            add = {p: lm.PAIR_WEIGHT * two[p] / context[v] for p in kept if p[0] == v and two[p]}
            return (1 - sum(add.values())) * p_word(w) + add.get((v, w), 0)

        for i, t in texts.items():
            losses = [-log(p_next(v, w)) for v, w in zip(["^", *t.split()], t.split())]
            assert got[i][side] == pytest.approx(sum(losses) / len(losses))


def test_models_in_blocks_score_as_one(spark, monkeypatch):
    """Models too large to broadcast at once: the documents meet them block by block, no pair of words is a row."""
    texts = [" ".join(f"w{(i * j) % 23}" for j in range(i % 40)) for i in range(60)]
    rows = [(i // 2 if i % 7 else None, t, i % 3 == 0) for i, t in enumerate(texts)] + [(5, None, False), (9, texts[9], False), (9, texts[9], False)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, is_target boolean").repartition(3)

    def scores(model):
        return sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score or 0) for r in lm.cross_entropy(spark, docs, model).collect())

    want = scores(lm.train(docs))
    monkeypatch.setattr(lm, "MODEL_ROWS", 0)
    monkeypatch.setattr(lm, "BLOCK_ROWS", 20)
    got = scores(lm.train(docs))
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want])


def test_target_documents_score_lower(spark):
    got = QUERIES["op9_lm_scoring"](spark, MID_DIR).toPandas().merge(_pandas(spark, "labels"), on="doc_id")
    assert got[got.quality == 1].score.mean() < got[got.quality == 0].score.mean()


# 10: urls

@pytest.mark.parametrize("parts", ["1", "7"])
def test_nested_rules_equal_brute_force(spark, parts):
    rng = random.Random(4)
    label, step = (lambda: rng.choice("abc")), (lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randrange(4))))
    pages = [(i, "http://" + ".".join(label() for _ in range(rng.randrange(1, 5))) + step()) for i in range(400)]
    pages += [(i, "http://a.a.a/x/") for i in range(400, 600)]  # one url with a third of the rows
    rules_ = {(".".join(label() for _ in range(rng.randrange(1, 4))), rng.choice(["", step()])): rng.choice(["allow", "block"])
              for _ in range(60)}
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(
        spark.createDataFrame(pages, "page_id bigint, url string"),
        spark.createDataFrame([(*k, v) for k, v in rules_.items()], "host string, path string, verdict string")).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    for i, url in pages:
        host, _, rest = url[7:].partition("/")
        fits = [(len(h + p), len(h), h + p, v) for (h, p), v in rules_.items()
                if (host == h or host.endswith("." + h)) and ("/" + rest).startswith(p)]
        assert got[i] == (max(fits)[2:] if fits else (None, "allow"))


# pipeline

def _ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_rules_stage_does_what_its_operator_says(spark):
    docs = table(spark, MID_DIR, "documents")
    rated = corpus_pipeline.quality_rules(spark, docs, MID_DIR)
    assert _ids(rated) == _ids(QUERIES["op6_quality_rules"](spark, MID_DIR).where("kept"))


def test_near_dedup_stage_does_what_its_operator_says(spark):
    docs = table(spark, MID_DIR, "documents")
    single = corpus_pipeline.near_dedup(spark, docs, MID_DIR)
    assert _ids(single) == _ids(QUERIES["op3_simhash_near_dedup"](spark, MID_DIR).where("doc_id = component_id"))


def test_decontamination_stage_does_what_its_operator_says(spark):
    docs = table(spark, MID_DIR, "documents")
    clean = corpus_pipeline.decontaminate(spark, docs, MID_DIR)
    leaked = {r.doc_id for r in QUERIES["op7_benchmark_decontamination"](spark, MID_DIR).collect()}
    assert set(_ids(clean)) == set(_ids(docs)) - leaked


def test_substring_stage_does_what_its_operator_says(spark):
    docs = table(spark, MID_DIR, "documents")
    cut = corpus_pipeline.substring_dedup(spark, docs, MID_DIR).toPandas().set_index("doc_id")
    want = QUERIES["op5_substring_dedup"](spark, MID_DIR).where("n_removed < n_words or n_words = 0").toPandas()
    assert sorted(cut.index) == sorted(want.doc_id)
    for r in want.itertuples():
        text = cut.loc[r.doc_id, "text"]
        assert len(text.encode().split()) == r.n_words - r.n_removed and cut.loc[r.doc_id, "n_chars"] == len(text)


def test_pipeline_packs_what_the_stages_keep(spark):
    docs = table(spark, MID_DIR, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(
            stage(spark, docs, MID_DIR).toPandas(), docs.schema)
    got = corpus_pipeline.run(spark, MID_DIR).groupBy("doc_id").agg(F.max("doc_tokens").alias("n"), F.sum("length").alias("m"))
    got = {r.doc_id: (r.n, r.m) for r in got.collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in docs.collect()}
    assert got == {d: (n, n) for d, n in want.items()}
