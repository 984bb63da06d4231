"""Hard negatives, ranked search and secret scans against plain loops, and their edge rows."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from compare import connect, difference
from spanloom.llm import automata, hardneg, lexical, secretscan
from spanloom.llm.common import table
from spanloom.llm.queries import ORACLE, QUERIES

MID_DIR = "/root/testdata/sf0.01"
CLASHES = ("id", "item", "label", "vector", "n", "tf", "m", "chunk", "rank", "kind", "spans", "n_masked", "score", "tile")


@pytest.mark.parametrize("name", ["op11_hard_negative_mining", "op12_ranked_lexical_search"])
def test_search_queries_equal_sql(spark, name):
    got = QUERIES[name](spark, MID_DIR).toPandas()
    assert len(got) and difference(got, connect(MID_DIR).execute(ORACLE[name]).df()) is None


# 11: hard negatives

def _plain_negatives(rows, low=50, high=95, n_pos=5, n_neg=3):
    one = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and None not in v:
            one[i] = min(one.get(i, (label, v)), (label, v))
    width = max((len(v) for _, v in one.values()), default=0)
    full = {i: (label, v + [0] * (width - len(v))) for i, (label, v) in one.items()}
    out = []
    for a, (label, v) in full.items():
        if a % 50:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in full.items()}
        order = sorted(full, key=lambda i: (-score[i], i))
        for p in [i for i in order if full[i][0] == label and i != a][:n_pos]:
            fits = [i for i in order if full[i][0] != label and low * score[p] <= 100 * score[i] <= high * score[p]]
            out += [(a, p, r, n, score[p], score[n]) for r, n in enumerate(fits[:n_neg], 1)]
    return sorted(out)


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, label int, vector array<bigint>")


def _mined(df, **options):
    return sorted(tuple(r) for r in hardneg.mine(df, F.col("vec_id") % 50 == 0, **options).collect())


@pytest.mark.parametrize("leaf,fanout,block,parts", [(512, 16, 1 << 14, "8"), (4, 2, 3, "3"), (1, 3, 1, "1")])
def test_negatives_equal_brute_force(spark, monkeypatch, leaf, fanout, block, parts):
    """Small leaves, blocks of anchors and one or several trees; ties, small and negative scores, one very common vector."""
    for name, value in (("LEAF_ROWS", leaf), ("FANOUT", fanout), ("ANCHOR_BLOCK", block), ("RUN_ROWS", 64)):
        monkeypatch.setattr(hardneg, name, value)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    rng = random.Random(leaf)
    rows = [(i, rng.randrange(4), [rng.randrange(-6, 7) for _ in range(4)]) for i in range(300)]
    rows += [(i, i % 3, [3, 3, -1, 2]) for i in range(300, 451)]  # a third of all rows
    rows += [(i, 7, [9, 9, 9, 9]) for i in range(500, 503)]  # a label with fewer than five rows
    assert _mined(_vectors(spark, rows)) == _plain_negatives(rows)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_negatives_of_edge_rows(spark):
    rows = [(0, 1, [5, 5]), (0, 2, [5, 5]), (0, 1, [5, 5]), (1, 1, [10, 10]), (2, 2, [8, 8]), (3, 2, [8]), (None, 2, [9, 9]),
            (4, None, [9, 9]), (5, 2, None), (6, 2, [9, None]), (7, 2, []), (50, 3, [1, 1]), (8, 2, [7, 7]), (9, 1, [10, 10])]
    docs = _vectors(spark, rows).withColumns({c: F.lit("x") for c in CLASHES if c not in ("label", "vector")})
    assert _mined(docs) == _plain_negatives(rows) != []
    assert _mined(docs.where("1 = 0")) == [] and _mined(docs.where("vec_id = 50")) == []
    assert _mined(_vectors(spark, [(0, 1, []), (1, 1, []), (2, 2, [])])) == _plain_negatives([(0, 1, []), (1, 1, []), (2, 2, [])])
    big = [(i, i % 2, [(1 << 28) + i, (1 << 28) - 3 * i, 5]) for i in range(0, 60, 5)]  # scores beyond 2^53
    assert _mined(_vectors(spark, big), high_percent=100) == _plain_negatives(big, high=100) != []
    with pytest.raises(Exception, match="64 bits"):
        _mined(_vectors(spark, [(0, 1, [1 << 40]), (1, 1, [1 << 40]), (2, 2, [1 << 40])]))


def test_most_boxes_are_dropped_where_vectors_have_structure(spark, monkeypatch):
    import numpy as np
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(64, 8)) * 60
    rows = np.floor(centres[np.arange(4096) % 64] + rng.normal(size=(4096, 8))).astype(np.int64)
    labels, ids = np.arange(4096) % 64 // 8, np.arange(4096)
    visits = []
    plain = hardneg._Search._visit
    monkeypatch.setattr(hardneg, "LEAF_ROWS", 32)
    monkeypatch.setattr(hardneg._Search, "_visit", lambda self, at, group: (visits.append(len(group)), plain(self, at, group)))
    import pyarrow as pa
    leaves = [b for at in hardneg._leaf_rows(ids, labels, rows) for b in [at]]
    fields = [f.split()[0] for f in hardneg._LEAF.split(", ")]
    packed = [(ids[a].min(), labels[a].min(), labels[a].max(), ids[a].tobytes(), labels[a].tobytes(),
               b"i8" + rows[a].tobytes(), rows[a].min(axis=0).tobytes(), rows[a].max(axis=0).tobytes()) for a in leaves]
    tree = hardneg._Tree(pa.table([pa.array(c) for c in zip(*packed)], names=fields), 8)
    anchors = ids[ids % 50 == 0]
    shape = (len(anchors), 1)
    hardneg._Search(tree, anchors, labels[anchors], rows[anchors], np.full(shape, -(1 << 61)), np.full(shape, 1 << 61), 5, True).run()
    assert sum(visits) < 0.1 * len(anchors) * len(leaves)


# 12: ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _plain_ranks(docs, items, k=50):
    counted = [(d, Counter(_terms(t))) for d, t in docs]
    n_docs, total = sum(1 for _, c in counted if c), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    union = {}
    for i, text in items:
        union.setdefault(i, set()).update(_terms(text))
    out = []
    for item, wanted in union.items():
        scored = []
        for d, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
                        for t in wanted if c[t])
            if score > 0:
                scored.append((-score, d is None, d, score))
        out += [(item, r, d, s) for r, (_, _, d, s) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk,block", [(256, 1_000_000), (1, 60)])
def test_ranks_equal_brute_force(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(lexical, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(lexical, "BLOCK_CHARS", block)
    rng = random.Random(chunk)
    words = [f"w{i}" for i in range(30)] + ["É", "é", "Ab", "ab", "1"]
    docs = [(i, " ".join(rng.choices(words, weights=range(35, 0, -1), k=rng.randrange(0, 12)))) for i in range(150)]
    docs += [(i, "w1 w2, w3!") for i in range(200, 320)] + [(400, "w5 " * 5000), (401, None), (402, ""), (None, "w1 w2 w3"), (7, "w1 w9")]
    items = [(i, " ".join(rng.choices(words, k=4)).upper()) for i in range(9)] + [(20, "w1 w2 w3"), (21, None), (22, "..."),
                                                                                  (None, "w5"), (20, "w9"), (20, "w9")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in CLASHES})
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumns({c: F.lit("x") for c in CLASHES})
    got = sorted((tuple(r) for r in lexical.rank_documents(d, i, k=7).collect()), key=repr)
    assert got == _plain_ranks(docs, items, 7)
    for a, b in ((d.where("1 = 0"), i), (d, i.where("1 = 0"))):
        assert lexical.rank_documents(a, b).count() == 0


def test_ranks_of_text_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("é", "z z z z")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "X")], "item_id string, text string")
    rows = lexical.rank_documents(docs, items).orderBy("rank").collect()
    assert [(r.item_id, r.rank, r.doc_id) for r in rows] == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, None)]


# 13: secrets

KINDS = {"assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                               re.I | re.A), 2, 12),
         "access": (re.compile("AKIA[A-Z0-9]+"), 0, 18), "hex": (re.compile("[0-9a-f]+"), 0, 16)}
PARTS = ["password", "TOKEN", "api_key", "apikey", "Secret", "passwd", "=", ":", " ", "'", '"', "AKIA", "ABCDEF0123456789",
         "0123456789abcdef", "deadbeef", "é😀", "ß\n", "x", "-", "==", "abc/def+ghi_", "K", "f", "9", "\x00"]


def _plain_spans(text):
    return sorted((m.start(), list(KINDS).index(k), m.end()) for k, (p, group, least) in KINDS.items()
                  for m in p.finditer(text or "") if len(m.group(group)) >= least)


@pytest.fixture(scope="module")
def base():
    return secretscan.Scanner(secretscan.BASE_RULES)


@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=40).map("".join), max_size=60))
@settings(max_examples=150, deadline=None)
def test_spans_equal_a_leftmost_search(base, texts):
    assert list(base.of_texts([t.encode() for t in texts])) == [_plain_spans(t) for t in texts]


def test_secret_query_equals_brute_force(spark):
    docs = {r.doc_id: r.text for r in table(spark, MID_DIR, "documents").collect()}
    rows = QUERIES["op13_secret_scans"](spark, MID_DIR).collect()
    assert len(rows) == len(docs) and sum(r.n_assign + r.n_access + r.n_hex for r in rows)
    for r in rows:
        spans = [(s, k, e) for s, k, e in _plain_spans(docs[r.doc_id])]
        text = ",".join(f"{list(KINDS)[k]}:{s}:{e}" for s, k, e in spans)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_secrets_of_edge_rows(spark):
    long = "zz" * 300_000 + " token=abcdefghijklmnop " + "q" * 400_000
    rows = [(1, "é password: 'abcdefghijkl' AKIA12345678901234"), (1, "é password: 'abcdefghijkl' AKIA12345678901234"), (2, None),
            (3, ""), (None, "0123456789abcdef"), (4, long), (5, "ghp_" + "a1B2" * 9 + " https://me:pass@host"),
            (6, "-----BEGIN RSA PRIVATE KEY-----"), (7, "token=short secret=alsoshort")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("x") for c in CLASHES})
    got = [(r.doc_id, [tuple(s) for s in r.spans]) for r in secretscan.find_secrets(docs).collect()]
    found = {d: s for d, s in got}
    assert len(got) == len(rows) and [d for d, _ in got].count(1) == 2
    assert found[1] == [("assign", 2, 25), ("access", 27, 45)] and found[2] == found[3] == found[7] == []
    assert found[None] == [("hex", 0, 16)] and found[4] == [("assign", 600_001, 600_023)]
    assert [k for k, _, _ in found[5]] == ["github", "url_login"] and found[6] == [("private_key", 0, 31)]
    assert secretscan.find_secrets(docs.where("1 = 0")).count() == 0
    masked = {r.doc_id: r for r in secretscan.mask_secrets(docs).collect()}
    assert masked[1].text == "é [assign]' [access]" and masked[1]._n_masked == 2 and masked[2].text is None
    assert masked[7].text == rows[-1][1] and masked[1].n_masked == "x" and masked[1].id == "x"


def test_minimised_automaton_has_no_equal_states():
    import numpy as np
    trees = [automata.parse(p) for p in ("a(b|c)d", "abd|acd", "x{2,3}y?")]
    whole = automata.build(trees)
    table_, accepts = whole.table, whole.accepts
    same = {(i, j) for i in range(len(accepts)) for j in range(i) if accepts[i] == accepts[j]}
    while True:  # pairs that no byte tells apart
        ok = {p for p in same if all(a == b or (max(a, b), min(a, b)) in same for a, b in zip(table_[p[0]], table_[p[1]]))}
        if ok == same:
            break
        same = ok
    assert not same
    for text, want in (("abd", 3), ("acd", 3), ("ad", 0), ("xx", 4), ("xxxy", 4), ("x", 0)):
        state = 0
        for byte in text.encode():
            state = table_[state][whole.classes[byte]] if state >= 0 else -1
        assert (accepts[state] if state >= 0 else 0) == want
    assert np.issubdtype(table_.dtype, np.integer)


@pytest.mark.parametrize("pattern", ["a(b", "a)b", ".", "é", "[a", "a{2", r"\d"])
def test_unknown_patterns_are_errors(pattern):
    with pytest.raises(ValueError):
        automata.parse(pattern)
