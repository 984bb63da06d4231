"""Entity and token scores against plain loops and hand-written rows."""

import hashlib
import random
from itertools import groupby

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom import vocab
from spanloom.operators import entity_eval, lines, predict, token_eval
from spanloom.plans import scoring

TAGS = list(vocab.TAGS) + ["X-EAS"]


def _random_sentences(seed, n, longest=12):
    rnd = random.Random(seed)
    return [(0, i, [rnd.choice("abcd") for _ in range(k)], [rnd.choice(TAGS) for _ in range(k)],
             [rnd.choice(TAGS) for _ in range(k)])
            for i, k in ((i, rnd.randint(0, longest)) for i in range(n))]


SCHEMA = "doc_id bigint, sent_id int, tokens array<string>, gold array<string>, pred array<string>"


def _expected_runs(tags, tokens):
    """Neighbours with the ending of a listed suffix are a run, every other tag stands alone.

    A run opens with a tag of a listed suffix; any tag with its last three letters continues it.
    """
    endings, open_ending = [], None
    for tag in tags:
        listed = any(tag.endswith(x) for x in vocab.RUN_SUFFIXES)
        open_ending = tag[-3:] if listed or (open_ending and tag.endswith(open_ending)) else None
        endings.append(open_ending)

    def key(at):
        return (endings[at],) if endings[at] else at

    out = []
    for name, group in groupby(range(len(tags)), key):
        places = list(group)
        first = tags[places[0]]
        if isinstance(name, tuple):
            out.append((name[0], " ".join(tokens[p] for p in places)))
        else:
            out.append((None, None) if first.startswith("I-") else (first, tokens[places[0]]))
        out.extend((None, None) for _ in places[1:])
    return out


def _expected_spans(tags, tokens):
    out = []
    for i, tag in enumerate(tags):
        before = tags[i - 1] if i else "O"
        if tag == "O":
            continue
        if tag.startswith("I-") and before != "O" and before[2:] == tag[2:]:
            out[-1][1] = i + 1
            out[-1][3] += " " + tokens[i]
        else:
            out.append([i, i + 1, tag[2:], tokens[i]])
    return list(map(tuple, out))


def test_suffix_runs_match_the_loop(spark):
    rows = _random_sentences(1, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    runs = df.select("sent_id", entity_eval.merge_runs(F.col("gold"), F.col("tokens")).alias("r")).collect()
    got = {r.sent_id: list(zip(r.r.types, r.r.surfaces)) for r in runs}
    assert got == {s: _expected_runs(g, t) for _, s, t, g, _ in rows}


def test_bio_spans_and_runs_match_the_loop(spark):
    rows = [(d, s, t, [x for x in g if x != "X-EAS"] + ["O"] * g.count("X-EAS"), p)
            for d, s, t, g, p in _random_sentences(2, 300)]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = {(s, *x) for _, s, t, g, _ in rows for x in _expected_spans(g, t)}
    assert {tuple(r)[1:] for r in entity_eval.bio_spans(df, "gold").collect()} == expected
    runs = entity_eval.explode_runs(df.select("doc_id", "sent_id", entity_eval.merge_runs(
        F.col("gold"), F.col("tokens"), "bio").alias("runs"))).where("entity_type <> 'O'").collect()
    assert {(r.sent_id, r.pos, r.entity_type, r.surface_string) for r in runs} == {
        (s, b, label, text) for s, b, _, label, text in expected}


def test_grades(spark):
    rows = [  # gold type, gold, predicted type, predicted, (type, partial, exact, strict)
        (None, None, None, None, (None,) * 4), (None, None, "TIM", "a", ("SPU",) * 4),
        ("TIM", "a", None, None, ("MIS",) * 4), ("TIM", "a", "TIM", "a", ("COR",) * 4),
        ("TIM", "a b", "TIM", "a", ("COR", "PAR", "INC", "INC")),
        ("TIM", "a", "TIM", "z", ("COR", "INC", "INC", "INC")),
        ("TIM", "a", "SUB", "a", ("INC", "COR", "COR", "INC")),
        ("TIM", "a", "tim", "a", ("COR", "COR", "COR", "INC")),
        ("TIM", "a b", "SUB", "b", ("INC", "PAR", "INC", "INC")),
        ("TIM", "a", "SUB", "z", ("INC", "INC", "INC", "INC")),
        ("TIM", "", "SUB", "z", ("INC", "PAR", "INC", "INC"))]
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)],
                               "i int, gt string, gs string, pt string, ps string")
    got = df.select("i", entity_eval.grade(*map(F.col, ("gt", "gs", "pt", "ps"))).alias("g")).collect()
    assert {r.i: tuple(r.g) for r in got} == {i: r[4] for i, r in enumerate(rows)}


def test_alignment_of_separate_tables(spark):
    schema = "doc_id bigint, sent_id int, entities array<struct<entity_type:string,surface_string:string>>"
    gold = spark.createDataFrame([(1, 0, [("B-TIM", "a"), ("O", "b")]), (1, 1, [("B-MEAS", "c")])], schema)
    pred = spark.createDataFrame([(1, 0, [("B-TIM", "a"), ("O", "b"), ("B-SUB", "z")]), (9, 9, [("O", "q")])], schema)
    pairs = entity_eval.aligned_pairs(entity_eval.join_sentences(gold, pred))
    counts = entity_eval.grade_counts(entity_eval.graded_pairs(pairs))
    assert pairs.count() == 3
    rows = {(r.entity_type, r.Measure): r.Strict for r in counts.collect()}
    assert rows["TIM", "COR"] == 1 and rows["MEA", "MIS"] == 1 and rows["O", "COR"] == 1
    metrics = {r.entity_type: r for r in entity_eval.entity_metrics(counts).collect()}
    assert metrics["Overall"].POS == 3 and metrics["MEA"].Exact_F1 == 0


def test_by_token_pairs_match_join_and_keep_last(spark):
    rnd = random.Random(3)
    gold = pd.DataFrame([(rnd.choice("abcdO"), rnd.choice(["O", "B-SUB", "I-TIM"])) for _ in range(60)],
                        columns=["token", "true"])
    pred = pd.DataFrame([(rnd.choice("abcdeO"), rnd.choice(["O", "B-SUB", "I-TIM"])) for _ in range(60)],
                        columns=["token", "pred"])
    merged = gold.merge(pred, how="right", on="token")
    sides = [spark.createDataFrame(f.assign(at=range(len(f)))) for f in (gold, pred)]

    def as_set(frame):
        return {tuple(None if pd.isna(x) else x for x in r) for r in
                frame[["token", "true", "pred"]].itertuples(index=False)}
    assert as_set(token_eval.pairs_by_token(*sides).toPandas()) == as_set(
        merged.drop_duplicates("token", keep="last"))
    no_outside = merged.replace({"O": None}).dropna().drop_duplicates("token", keep="last")
    assert as_set(token_eval.pairs_by_token_no_outside(*sides).toPandas()) == as_set(no_outside)
    counted = token_eval.pair_counts_by_token(*sides).toPandas()
    assert counted["n_pairs"].sum() == len(merged)


def test_score_invariants(spark):
    rows = spark.createDataFrame(_random_sentences(5, 200), SCHEMA)
    counts = token_eval.pair_counts(token_eval.pairs_in_rows(rows))
    scores = token_eval.class_scores(counts)
    pdf = counts.toPandas()
    accuracy = pdf[pdf["true"] == pdf["pred"]]["n"].sum() / pdf["n"].sum()
    averages = {r.average: r for r in token_eval.average_scores(scores).collect()}
    assert abs(averages["micro"].f1 - accuracy) < 1e-12
    support = {r.tag: r.support for r in scores.collect()}
    matrix = token_eval.confusion(counts, tuple(TAGS)).groupBy("true").agg(F.sum("n").alias("n")).collect()
    assert {r.true: r.n for r in matrix if r.n} == {t: n for t, n in support.items() if n}
    listed = token_eval.class_scores(counts, ("B-SUB", "NONE")).collect()
    assert {r.tag: r.f1 > 0 for r in listed} == {"B-SUB": True, "NONE": False}


def test_tagger_with_hot_tokens_and_unknown_words(spark):
    model = predict.learn_frequent_tags(spark.createDataFrame(
        [("a", "B-SUB")] * 2 + [("a", "O")] * 2 + [("b", "I-TIM")], "token string, tag string"))
    rows = spark.createDataFrame([(0, 0, i, "a") for i in range(50)] + [(0, 1, 0, "b"), (0, 1, 1, "c")],
                                 "doc_id bigint, sent_id int, tok_idx int, token string")
    got = predict.apply_frequent_tags(rows, model, hot_share=4).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, predict.apply_frequent_tags(rows, model).collect()))
    assert len(got) == 52
    assert {(r.token, r.pred) for r in got} == {("a", "B-SUB"), ("b", "I-TIM"), ("c", "O")}


def test_order_holds_for_large_and_text_ids(spark):
    for ids in ((1, 2 ** 33 + 1, 2 ** 32), ("a", "c", "b")):
        kind = "bigint" if isinstance(ids[0], int) else "string"
        rows = spark.createDataFrame([(ids[0], 7, "w", "B-SUB", "O"), (ids[1], 0, "w", "B-TIM", "B-SUB"),
                                      (ids[2], 3, "w", "O", "B-TIM")],
                                     f"doc_id {kind}, tok_idx int, token string, true string, pred string")
        placed = rows.withColumn("at", F.struct("doc_id", "tok_idx"))
        assert [tuple(r) for r in token_eval.last_pairs(placed).collect()] == [("w", "B-TIM", "B-SUB")]
        assert [tuple(r) for r in token_eval.last_pairs(placed, outside=False).collect()] == [("w", "B-TIM", "B-SUB")]
        first = lines.first_seen(rows, "token", "doc_id", "tok_idx").collect()
        assert [tuple(r) for r in first] == [("w", ids[0], 7)]


def test_predicted_only_tokens_keep_their_word(spark):
    gold = spark.createDataFrame([(1, 0, 0, "a", "O")], "doc_id bigint, sent_id int, tok_idx int, token string, true string")
    pred = spark.createDataFrame([(1, 0, 1, "b", "O")], "doc_id bigint, sent_id int, tok_idx int, token string, pred string")
    got = {tuple(r)[2:] for r in token_eval.pairs_by_position(gold, pred).collect()}
    assert got == {(0, "a", "O", None), (1, "b", None, "O")}


def test_listed_labels_have_rows_for_every_group(spark):
    counts = spark.createDataFrame([("m1", "B-SUB", "B-SUB", 3), ("m2", "O", "O", 1)],
                                   "model string, true string, pred string, n bigint")
    got = {(r.model, r.tag): r.support for r in token_eval.class_scores(counts, ("B-SUB", "B-TIM"), by=("model",)).collect()}
    assert got == {("m1", "B-SUB"): 3, ("m1", "B-TIM"): 0, ("m2", "B-SUB"): 0, ("m2", "B-TIM"): 0}


def test_tagger_gets_whole_tokens_and_must_answer_each(spark):
    rows = spark.createDataFrame([(1, 0, ["New York", "x"])], "doc_id bigint, sent_id int, tokens array<string>")
    got = predict.flatten_predictions(predict.tag_sentences(rows, lambda: lambda s: [["B-SUB", "O"] for _ in s])).collect()
    assert [(r.token, r.pred) for r in got] == [("New York", "B-SUB"), ("x", "O")]
    with pytest.raises(Exception, match="one tag per token"):
        predict.tag_sentences(rows, lambda: lambda s: [["O"] for _ in s]).collect()


def test_type_names_are_repaired_only_where_they_are_cut(spark):
    tagged = spark.createDataFrame([(1, 0, ["a"], ["B-MEAS"], ["B-MEAS"])], SCHEMA)
    assert {r.entity_type for r in scoring.entity_report(tagged).collect()} == {"MEA", "Overall"}
    assert {r.entity_type for r in scoring.entity_report(tagged, mode="bio").collect()} == {"MEAS", "Overall"}


def test_vocabulary_has_its_literal_values():
    """Against values written out here, not taken from the module."""
    assert vocab.TAGS == tuple("B-MED I-MED B-PRO I-PRO B-UNI I-UNI B-SUB I-SUB B-TIM I-TIM B-DEC I-DEC B-ROU I-ROU "
                               "B-MEAS I-MEAS B-RTIM I-RTIM O".split())
    assert vocab.SCORED_TAGS == tuple("O B-SUB B-DEC B-ROU B-TIM B-UNI I-ROU I-TIM I-SUB B-MEAS B-RTIM".split())
    assert vocab.SCORED_CLASSES == tuple("SUB DEC ROU TIM UNI MEAS RTIM".split())
    assert vocab.RUN_SUFFIXES == tuple("TIM SUB ROU UNI MEAS DEC RTIM".split())
    assert vocab.LISTED_STRIP == tuple("B-SUB B-DEC B-ROU B-TIM B-UNI I-ROU I-TIM I-SUB B-MEAS B-RTIM".split())
    assert (vocab.MODES, vocab.GRADES) == (("type", "partial", "exact", "strict"), ("COR", "INC", "PAR", "MIS", "SPU"))
    assert {a for a, b in vocab.DISPLAY_GOLD.items() if b[:2] + b[3:] != a} == {"B-RTIM"} and vocab.DISPLAY_GOLD["B-RTIM"] == "B-RTIM"
    assert vocab.DISPLAY_PRED["I-SUB"] == "I-ISUB" and "I-ROU" not in vocab.DISPLAY_PRED
    sizes = pd.Series(list(vocab.CONCEPT_LABELS.values())).value_counts().to_dict()
    assert sizes == {"TIM": 26, "UNI": 7, "MEAS": 7, "ROU": 6, "MED": 1, "PRO": 1, "RTIM": 1}
    assert vocab.CONCEPT_LABELS["258773002 |Milliliter (qualifier value)|"] == "MEAS" and vocab.CONCEPT_LABELS["RTIM"] == "RTIM"
    assert vocab.LABEL_PARENTS["ROU"] == "284009009 |Route of administration value (qualifier value)|"
    assert vocab.CONCEPT_LIST_EXCLUDES == ("18629005 |Administration of drug or medicament (procedure)|",)
    listed = "\n".join(f"{concept}\t{label}" for concept, label in vocab.CONCEPT_LABELS.items())
    assert hashlib.sha256(listed.encode()).hexdigest() == "bfed64bf662ebc0b5942ecfc1d8e07bd934dd942634341e0b144117777054f20"


@pytest.mark.parametrize("mode", ["suffix", "bio"])
@pytest.mark.parametrize("lines", [1, 2, 3, 7])
def test_runs_of_flat_rows_equal_those_in_the_row(spark, mode, lines):
    rnd = random.Random(lines)
    kinds = ["O", "B-TIM", "I-TIM", "B-RTIM", "I-MEAS", "B-XEAS", "B-SUB", "I-SUB", "MED", "I-MED"]
    rows = []
    for s in range(60):
        tags: list[str] = []
        while len(tags) < rnd.randrange(1, 30):
            tags += [rnd.choice(kinds)] * rnd.randrange(1, 9)
        rows.append((s % 7, s, [f"w{i}" for i in range(len(tags))], tags))
    docs = spark.createDataFrame(rows, "doc_id bigint, sent_id int, tokens array<string>, tags array<string>")
    flat = docs.select("doc_id", "sent_id", F.posexplode(F.arrays_zip("tags", "tokens")).alias("pos", "_x")).select(
        "doc_id", "sent_id", "pos", F.col("_x.tags").alias("entity_type"), F.col("_x.tokens").alias("surface_string"))
    merged = entity_eval.merge_runs(F.col("tags"), F.col("tokens"), mode)
    want = entity_eval.explode_runs(docs.select("doc_id", "sent_id", merged.alias("runs")))
    got = entity_eval.merge_runs_flat(flat, mode, lines)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_short_sentences_are_not_summarised(spark):
    """Sentences of one chunk need nothing from the chunks before; rows without a sentence or a place are left out."""
    flat = spark.createDataFrame([(d, 0, i, t, f"w{i}") for d in (1, 2) for i, t in enumerate(["B-SUB", "I-SUB", "O", "B-TIM"])]
                                 + [(None, 0, 0, "O", "x"), (1, None, 0, "O", "x"), (1, 0, None, "O", "x")],
                                 "doc_id bigint, sent_id int, pos int, entity_type string, surface_string string")
    for lines, summarised in ((4, False), (2, True)):
        rows = entity_eval.merge_runs_flat(flat, "bio", lines)
        assert sorted(map(tuple, rows.collect()), key=repr) == sorted(
            (d, 0, *x) for d in (1, 2) for x in ((0, "SUB", "w0 w1"), (1, None, None), (2, "O", "w2"), (3, "TIM", "w3")))
        final = rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert ("min_by" in final) == summarised


@pytest.mark.parametrize("mode", ["suffix", "bio"])
def test_scattered_rows_of_a_sentence_move_once(spark, mode):
    """Rows in any order, some without a type: sentences that fit a row are merged whole, without a window over their rows."""
    rnd = random.Random(3)
    kinds = ["O", "B-TIM", "I-TIM", "B-RTIM", "I-MEAS", "B-SUB", "I-SUB", None]
    docs = {(f"d{s % 5}", s): [rnd.choice(kinds) for _ in range(rnd.randrange(1, 20)) for _ in range(rnd.randrange(1, 4))] for s in range(40)}
    rows = [(*k, i, t, f"w{i}") for k, tags in docs.items() for i, t in enumerate(tags)]
    rnd.shuffle(rows)
    schema = "doc_id string, sent_id int, pos int, entity_type string, surface_string string"
    got = entity_eval.merge_runs_flat(spark.createDataFrame(rows, schema).repartition(5), mode)
    scanned = entity_eval._merge_scanned(spark.createDataFrame(rows, schema), mode, 1 << 16)
    found = got.collect()
    assert sorted(map(tuple, found), key=repr) == sorted(map(tuple, scanned.collect()), key=repr)
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
