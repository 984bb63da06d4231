"""Readers and writers on small files."""

import json
import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.operators import bio, entity_eval, lines, offsets, predict
from spanloom.plans import scoring
from spanloom.sources import blocks, listing, packed, readers, sinks, tables
from spanloom.streaming import parts
from spanloom.streaming.folders import clean_folder


def test_notes_spans_and_listings(spark, tmp_path):
    root = tmp_path / "corpus"
    for name, text in (("doc-1", "one two"), ("doc 2", "ยา 5 mg")):
        folder = root / name
        folder.mkdir(parents=True)
        (folder / "a.txt").write_text(text, encoding="utf-8")
        (folder / "b.txt").write_text("second file", encoding="utf-8")
        (folder / readers.SPAN_FILE).write_text(
            '<?xml version="1.0"?><x:XMI xmlns:x="x" xmlns:xmi="i" xmlns:custom="c">'
            '<custom:CustomMCN xmi:id="7" begin="0" end="3" Concept="5"/>'
            '<custom:CustomMCN xmi:id="8" begin="4" end="7"/></x:XMI>', encoding="utf-8")
    (root / "doc-1" / "deep").mkdir()
    (root / "doc-1" / "deep" / "c.bin").write_bytes(b"x")
    notes = readers.read_notes(spark, str(root))
    assert {r.doc_id: r.text for r in notes.collect()} == {"doc-1": "one two", "doc2": "ยา 5 mg"}
    spans = readers.read_spans(spark, str(root))
    assert {(r.doc_id, r.ann_id, r.begin, r.end, r.concept) for r in spans.collect()} == {
        (d, i, b, e, c) for d in ("doc-1", "doc2") for i, b, e, c in ((7, 0, 3, "5"), (8, 4, 7, None))}
    tagged = bio.bio_lines(notes, bio.label_spans(spans)).where("doc_id = 'doc-1'").orderBy("line_no").collect()
    assert [(r.token, r.tag) for r in tagged] == [("one", "B-DEC"), ("two", "O")]
    folders = {(r.folder, r.depth) for r in readers.list_folders(spark, str(root)).collect()}
    assert {d for _, d in folders} == {1, 2} and ("doc-1/deep", 2) in folders
    assert readers.list_files(spark, str(root / "doc-1")).count() == 3
    assert readers.list_files(spark, str(root), recursive=True).count() == 7


def test_archives_stay_in_place(spark, tmp_path):
    path = tmp_path / "in" / "x.zip"
    path.parent.mkdir()
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("d1/a.txt", "hello")
        z.writestr("d2/b.txt", "there")
    rows = readers.expand_archives(spark, str(path.parent)).collect()
    assert {(r.member, bytes(r.content)) for r in rows} == {("d1/a.txt", b"hello"), ("d2/b.txt", b"there")}
    assert path.exists()


def test_token_files(spark, tmp_path):
    docs = spark.createDataFrame([("d1", ["a", "b"], ["B-SUB", "O"])],
                                 "doc_id string, tokens array<string>, tags array<string>")
    out = str(tmp_path / "lines")
    sinks.write_line_docs(docs, out)
    text = spark.read.text(out).select("value").collect()
    assert [r.value for r in text] == ["a B-SUB", "b O"]
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "d9.txt").write_text("New York B-SUB\n\n\n\nx O\n", encoding="utf-8")
    row = readers.read_line_docs(spark, str(tmp_path / "raw")).first()
    assert (row.doc_id, row.tokens, row.tags) == ("d9", ["New York", "x"], ["B-SUB", "O"])
    for text in ("a O\nb B-SUB\n\nc O", "a O\r\nb B-SUB\r\n\r\nc O\r\n", "\na O\nb B-SUB\n \t\n\nc O\n\n"):
        (tmp_path / "s.conll").write_bytes(text.encode())
        got = readers.read_sentences(spark, str(tmp_path / "s.conll")).orderBy("sent_id").collect()
        assert [(r.sent_id, r.tokens, r.tags) for r in got] == [(0, ["a", "b"], ["O", "B-SUB"]), (1, ["c"], ["O"])]


def test_blank_collapse_and_strict_parse(spark):
    df = spark.createDataFrame([("a\n\n \n\nb\n",)], "t string")
    assert df.select(readers.collapse_blank_lines(F.col("t"))).first()[0] == "a\n\nb\n"
    assert df.select(lines.collapse_blank_array(F.split("t", "\n"))).first()[0] == ["a", "", "b", ""]
    raw = spark.createDataFrame([("a O",), ("a  O",), ("a b O",), (" a O ",), ("",)], "value string")
    assert {r.value: r.ok for r in readers.parse_strict(raw).collect()} == {
        "a O": True, "a  O": False, "a b O": False, " a O ": True}


def test_entity_json(spark, tmp_path):
    path = tmp_path / "gold.json"
    path.write_text(json.dumps([[["B-TIM", "a"], ["O", "b"]], []]), encoding="utf-8")
    rows = readers.read_entity_json(spark, str(path)).orderBy("sent_id").collect()
    assert [[tuple(e) for e in r.entities] for r in rows] == [[("B-TIM", "a"), ("O", "b")], []]


def test_new_files_are_cleaned_once(spark, tmp_path):
    source, target, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    source.mkdir()

    def run():
        clean_folder(spark, str(source), str(target), str(state)).awaitTermination(120)
        rows = spark.read.text(str(target)).select("doc_id", "value").collect()
        return sorted((str(r.doc_id), r.value) for r in rows)

    (source / "d1.txt").write_text("a B-SUB\na B-TIM\nb O\n", encoding="utf-8")
    first = run()
    assert first == [("d1", "a B-SUB"), ("d1", "b O")]
    (source / "d2.txt").write_text("c O\n", encoding="utf-8")
    assert run() == first + [("d2", "c O")]


def test_listings_keep_inner_folders_and_empty_files(spark, tmp_path):
    root = tmp_path / "q"
    (root / "b" / "q" / "x y").mkdir(parents=True)
    (root / "b" / "q" / "x y" / "empty.txt").write_text("")
    (root / "a+b").mkdir()
    (root / "a+b" / "n.txt").write_text("text")
    folders = {r.folder for r in readers.list_folders(spark, str(root)).collect()}
    assert folders == {"b", "b/q", "b/q/x y", "a+b"}
    sizes = {r.file_name: r.length for r in readers.list_files(spark, str(root), recursive=True).collect()}
    assert sizes == {"empty.txt": 0, "n.txt": 4}
    assert {r.doc_id: r.text for r in readers.read_notes(spark, str(root)).collect()} == {"xy": "", "ab": "text"}


def test_folders_with_one_cleaned_name_are_an_error(spark, tmp_path):
    for name in ("A/doc 1", "B/doc1"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "t.txt").write_text(name)
    with pytest.raises(Exception, match="doc1"):
        readers.read_notes(spark, str(tmp_path)).collect()


def test_equal_names_in_two_folders_are_two_documents(spark, tmp_path):
    for name in ("A", "B"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "d.txt").write_text(f"{name} O\n")
    got = {r.doc_id: r.tokens for r in readers.read_line_docs(spark, str(tmp_path)).collect()}
    assert got == {"A/d": ["A"], "B/d": ["B"]}


def test_text_ids_of_entity_lines(spark, tmp_path):
    rows = spark.createDataFrame([("n1", 0, [("TIM", "a")])],
                                 "doc_id string, sent_id int, entities array<struct<entity_type:string,surface_string:string>>")
    sinks.write_entity_lines(rows, str(tmp_path / "e"))
    assert [r.doc_id for r in readers.read_entity_lines(spark, str(tmp_path / "e")).collect()] == ["n1"]


def test_two_json_files_are_scored(spark, tmp_path):
    for side, sentences in (("gold", [[["B-TIM", "a"], ["O", "b"]], [["B-SUB", "c"]]]), ("pred", [[["B-TIM", "a"], ["O", "b"]]])):
        (tmp_path / side).mkdir()
        (tmp_path / side / "test.json").write_text(json.dumps(sentences))
    report = scoring.json_entity_report(spark, str(tmp_path / "gold"), str(tmp_path / "pred")).collect()
    got = {r.entity_type: (r.POS, r.Exact_Recall) for r in report}
    assert got["TIM"] == (1, 1) and got["SUB"] == (1, 0) and got["Overall"][0] == 3


def test_token_file_is_tagged_and_scored(spark, tmp_path):
    (tmp_path / "t.conll").write_text("a B-SUB\nb I-SUB\n\nc O\nd B-TIM\n")
    tokens, spans = scoring.conll_report(
        spark, str(tmp_path / "t.conll"), lambda: lambda s: [["B-SUB", "I-SUB"] if len(t) == 2 and t[0] == "a" else ["O", "O"] for t in s])
    assert {r.tag: (r.tp, r.support) for r in tokens.collect()} == {"B-SUB": (1, 1), "I-SUB": (1, 1), "O": (1, 1), "B-TIM": (0, 1)}
    assert {r.label: (r.tp, r.support) for r in spans.collect()} == {"SUB": (1, 1), "TIM": (0, 1), "Overall": (1, 2)}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _plain_sentences(path):
    out, sentence = [], []
    with open(path, encoding="utf-8", newline="\n") as lines_:
        for line in [*lines_, ""]:
            parts = line.split()
            if parts:
                sentence.append((parts[0], parts[1] if len(parts) > 1 else None))
            elif sentence:
                out.append(sentence)
                sentence = []
    return out


@pytest.fixture
def block_size(spark):
    """Sets the size of a block, as very large files would."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield use
    for name, value in zip(names, before):
        spark.conf.set(name, value)


@pytest.mark.parametrize("size,broadcast", [(40, True), (200, False), (1000, True)])
def test_token_files_read_in_blocks(spark, tmp_path, block_size, monkeypatch, size, broadcast):
    rnd = random.Random(size)
    for f in range(3):
        text = "".join(rnd.choice(["tok B-SUB\n", "x O\n", "\n", "  \t\n", "y z q\n", "only\n", "\r\n", "ยา O\r\n", "w O\n", "w O\n"])
                       for _ in range(200))
        (tmp_path / f"f{f}.conll").write_bytes((text + "last O" * (f % 2)).encode())
    block_size(size)
    if not broadcast:
        monkeypatch.setattr(blocks, "BROADCAST_BLOCKS", 0)
    rows = readers.read_sentences(spark, str(tmp_path)).collect()
    got = {(r.doc_id.rsplit("/", 1)[1], r.sent_id): list(zip(r.tokens, r.tags)) for r in rows}
    assert len(got) == len(rows)
    assert got == {(p.name, i): s for p in tmp_path.iterdir() for i, s in enumerate(_plain_sentences(p))}
    assert spark.read.option("lineSep", "\n").text(str(tmp_path)).rdd.getNumPartitions() > 3


def test_token_files_are_parsed_once(spark, tmp_path):
    """Lines go through Arrow when the sentences are staged; what comes after reads those, and no row is joined to itself."""
    (tmp_path / "t.conll").write_bytes(b"a B-SUB\xff\nb\n\n \r\nc O\n")
    rows = readers.read_sentences(spark, str(tmp_path / "t.conll"))
    tagged = scoring.tagged_by(rows, lambda: lambda s: [["O"] * len(t) for t in s])
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (rows, tagged)]
    assert "MapInArrow" not in plans[0] and "FileScan text" not in plans[0]
    assert "FileScan text" not in plans[1] and "SortMergeJoin" not in plans[1] and plans[1].count("MapInArrow") == 1
    assert sorted((r.sent_id, r.tokens, r.gold, r.pred) for r in tagged.collect()) == [
        (0, ["a", "b"], ["B-SUB\ufffd", None], ["O", "O"]), (1, ["c"], ["O"], ["O"])]


@pytest.mark.parametrize("size,broadcast", [(33, True), (200, False), (1 << 20, True)])
def test_nested_json_read_in_blocks(spark, tmp_path, block_size, monkeypatch, size, broadcast):
    rnd = random.Random(size)
    words = ["a", "x]y", "[", "]]", "\\\"q", "q\"],[\"", "é😀", "\\\\", "back\\", ""]
    for f, n in enumerate((0, 1, 120, 60)):
        content = [[[rnd.choice(["O", "B-TIM"]), rnd.choice(words)] for _ in range(rnd.randrange(0, 6))] for _ in range(n)]
        (tmp_path / f"f{f}.json").write_text(json.dumps(content, ensure_ascii=f % 2 == 0, indent=2 if f == 3 else None)
                                             + "\n" * (f == 2), encoding="utf-8")
    block_size(size)
    if not broadcast:
        monkeypatch.setattr(blocks, "BROADCAST_BLOCKS", 0)
    rows = readers.read_entity_json(spark, str(tmp_path)).collect()
    got = {(r.doc_id, r.sent_id): [list(e) for e in r.entities] for r in rows}
    assert len(got) == len(rows)
    assert got == {(p.name, i): s for p in tmp_path.iterdir() for i, s in enumerate(json.loads(p.read_text(encoding="utf-8")))}


def test_nested_json_is_read_twice_at_most(spark, tmp_path):
    """Once for the blocks, once for the texts, which are staged; both ways to find the marks of a record agree."""
    (tmp_path / "a.json").write_text('[[["O","a]"]],[["B-TIM","ü["]]]', encoding="utf-8")
    rows = readers.read_entity_json(spark, str(tmp_path))
    assert "MapInArrow" not in _plan(rows) and "FileScan text" not in _plan(rows)
    assert [tuple(e) for r in rows.orderBy("sent_id").collect() for e in r.entities] == [("O", "a]"), ("B-TIM", "ü[")]
    rnd = random.Random(2)
    texts = ["".join(rnd.choice('["é, x') for _ in range(rnd.randrange(9))) for _ in range(300)]
    found, looped = (blocks._marks(pa.array(x)) for x in (texts, [*texts, "\\\\"]))
    assert all((a == b[:-1]).all() for a, b in zip(found, looped))


def test_nested_json_is_written_one_list_per_file(spark, tmp_path):
    kind = "doc_id bigint, sent_id int, entities array<struct<entity_type:string,surface_string:string>>"
    rows = [(d, s, [("O", f"w{d}]"), ("B-TIM", None)][:s]) for d in range(20) for s in range(3)]
    sinks.write_entity_json(spark.createDataFrame(rows, kind).repartition(5), str(tmp_path / "e"), parts=4)
    files = sorted((tmp_path / "e").glob("part=*/*.txt"))
    assert len(files) == 4
    content = [s for f in files for s in json.loads(f.read_text())]
    assert sorted(map(repr, content)) == sorted(repr([list(e) for e in r[2]]) for r in rows)


def test_offsets_in_utf16_units(spark):
    rnd = random.Random(2)
    notes = [(d, "".join(rnd.choice("aé😀ยา𝐀\n") for _ in range(rnd.randrange(0, 1500)))) for d in range(12)] + [(90, "plain"), (91, None)]
    spans, want = [], {}
    for d, text in notes:
        for a in range(15):
            b = rnd.randint(0, len(text or ""))
            e = rnd.randint(b, len(text or ""))
            units = [len((text or "")[:x].encode("utf-16-le")) // 2 for x in (b, e)]
            spans.append((d, a, *units))
            want[d, a] = (b, e)
    spans += [(0, 99, None, 3), (12345, 1, 4, 5)]
    got = {(r.doc_id, r.ann_id): (r.begin, r.end) for r in offsets.from_utf16(
        spark.createDataFrame(spans, "doc_id bigint, ann_id bigint, begin int, end int"),
        spark.createDataFrame(notes, "doc_id bigint, text string")).collect()}
    assert got.pop((0, 99))[0] is None and got.pop((12345, 1)) == (4, 5)
    assert got == want
    inside = spark.createDataFrame([(1, 0, 2, 3)], "doc_id int, ann_id int, begin int, end int")
    one = offsets.from_utf16(inside, spark.createDataFrame([(1, "a😀b")], "doc_id int, text string")).first()
    assert (one.begin, one.end) == (1, 2)  # the middle of the character is the character


def test_spans_with_utf16_offsets_are_read(spark, tmp_path):
    folder = tmp_path / "d"
    folder.mkdir()
    (folder / "n.txt").write_text("😀😀 aspirin", encoding="utf-8")
    (folder / readers.SPAN_FILE).write_text('<x:XMI xmlns:x="x" xmlns:xmi="i" xmlns:custom="c">'
                                            '<custom:CustomMCN xmi:id="1" begin="5" end="12" Concept="A"/></x:XMI>')
    notes = readers.read_notes(spark, str(tmp_path))
    spans = readers.read_spans(spark, str(tmp_path), utf16_notes=notes)
    assert [r.surface for r in bio.span_texts(notes, spans).collect()] == ["aspirin"]


def test_annotations_are_listed_and_read_by_tasks(spark, tmp_path):
    """The files below the root are no file index of the driver; elements are those that Spark's XML reader finds."""
    element = "custom:CustomMCN"
    content = (f'<a xmlns:xmi="x">\n<{element} xmi:id="1" begin="0"\n end="5" Concept="a &gt; b > c/>"/><{element}Other xmi:id="9"/>'
               f"<!-- <{element} xmi:id='8'/> --><{element} xmi:id='2' begin='3' end='4' Concept=''>t<b/></{element}>"
               f'<{element} begin="1"/><{element}/>\n<{element} xmi:id="3" Concept=" ä \'q\' "></{element}></a>')
    for folder in ("n 1", "n2/deep", ".hidden", "_off"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / readers.SPAN_FILE).write_text(content, encoding="utf-8")
    (tmp_path / "n2" / "other.xmi").write_text(content)
    rows = readers.read_spans(spark, str(tmp_path))
    assert "FileScan" not in _plan(rows) and "Scan xml" not in _plan(rows)
    plain = (spark.read.format("xml").option("rowTag", element).option("recursiveFileLookup", "true").option("pathGlobFilter", readers.SPAN_FILE)
             .schema("`_xmi:id` bigint, _begin int, _end int, _Concept string").load(str(tmp_path)).collect())
    assert len(plain) == 10 and {r.doc_id for r in rows.collect()} == {"n1", "deep"}
    assert sorted(map(repr, map(tuple, rows.drop("doc_id").collect()))) == sorted(map(repr, map(tuple, plain)))
    (tmp_path / "n2" / "deep" / readers.SPAN_FILE).unlink()
    (tmp_path / "n 1" / readers.SPAN_FILE).write_text(f'<a><{element} xmi:id="1"/><{element} xmi:id="2" Concept="b')
    assert [r.ann_id for r in readers.read_spans(spark, str(tmp_path)).collect()] == [1, None]
    (tmp_path / "n 1" / readers.SPAN_FILE).write_text(f'<a><{element} xmi:id="x"/></a>')
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        readers.read_spans(spark, str(tmp_path)).collect()


def test_listing_is_made_by_tasks(spark, tmp_path):
    for d in ("a/x", "a/empty", "b b/y z", "c+d"):
        (tmp_path / d).mkdir(parents=True)
    for f in ("top.txt", "a/1.txt", "a/x/2.txt", "b b/y z/3.txt", "c+d/4.bin"):
        (tmp_path / f).write_text("x" * len(f))
    rows = listing.listing(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() == 4  # the root's own files and three folders
    got = {(r.below, r.is_folder, r.length if not r.is_folder else 0) for r in rows.collect()}
    want = {(str(p.relative_to(tmp_path)), p.is_dir(), 0 if p.is_dir() else p.stat().st_size) for p in tmp_path.rglob("*")}
    assert got == want
    assert {r.folder for r in readers.list_folders(spark, str(tmp_path)).where("depth = 1").collect()} == {"a", "b b", "c+d"}


def test_packed_documents_come_back(spark, tmp_path):
    rows = [(i, None if i == 3 else "" if i == 4 else f"ยา {i}\nline two\n" * (i % 5)) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    path = str(tmp_path / "p")
    packed.write_packed(docs, path)
    assert len(list((tmp_path / "p" / "data").iterdir())) <= 4 and sum(packed.parts_of(path).values()) == 50
    read = lambda: sorted(tuple(r) for r in packed.read_packed(spark, path, "bigint").collect())
    assert read() == rows
    (tmp_path / "p" / "data" / "lost.txt").write_text("of a task that was lost")  # no manifest names it
    packed.write_packed(docs.where("doc_id < 2").selectExpr("doc_id + 100 as doc_id", "text"), path)
    assert len(read()) == 52
    packed.write_packed(docs.limit(0), path)
    assert len(read()) == 52
    packed.write_packed(docs.where("doc_id = 7"), path, mode="overwrite")
    assert read() == [rows[7]]


def test_failed_jobs_leave_no_packed_documents(spark, tmp_path):
    path = str(tmp_path / "p")
    packed.write_packed(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), path)
    bad = spark.range(0, 40, 1, 4).selectExpr("id as doc_id", "if(id = 39, raise_error('no'), 'b') as text")
    with pytest.raises(Exception, match="no"):
        packed.write_packed(bad, path)
    assert [tuple(r) for r in packed.read_packed(spark, path, "bigint").collect()] == [(1, "a")]


def test_tables_in_buckets_join_without_exchange(spark, tmp_path):
    kind = "doc_id bigint, sent_id int, entities array<struct<entity_type:string,surface_string:string>>"
    gold = spark.createDataFrame([(d, s, [("B-TIM", "a"), ("O", "b")]) for d in range(30) for s in range(2)], kind)
    pred = gold.where("doc_id <> 4").withColumn("entities", F.slice("entities", 1, 1))
    sides = [tables.write_bucketed(x, tables.fresh_name(n), 4, path=str(tmp_path / n)) for n, x in (("gold", gold), ("pred", pred))]
    pairs = entity_eval.join_sentences(*sides)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    counts = entity_eval.grade_counts(entity_eval.graded_pairs(entity_eval.aligned_pairs(pairs)))
    got = {(r.entity_type, r.Measure): r.Strict for r in counts.collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    assert got["TIM", "COR"] == 58 and got["TIM", "MIS"] == 2 and got["O", "MIS"] == 60


def test_documents_in_parts_are_cleaned_like_whole_ones(spark, tmp_path):
    rnd = random.Random(11)
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    whole = {f"d{d}": [(rnd.choice("abc"), rnd.choice(["O", "B-SUB", "I-TIM"])) for _ in range(rnd.randrange(1, 60))] for d in range(5)}
    files = []
    for name, rows in whole.items():
        cuts = sorted(rnd.randrange(len(rows) + 1) for _ in range(6))
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
            files.append((f"{name}.{k}.txt", "".join(f"{w} {t}\n" for w, t in rows[a:b]) or "\n"))
    rnd.shuffle(files)
    for some in (files[:12], files[12:20], files[20:]):  # a restart after each
        for name, text in some:
            (tmp_path / "in" / name).write_text(text)
        parts.clean_parts(spark, source, target, state, files_per_batch=7).awaitTermination(240)
    got = spark.read.parquet(target).orderBy("doc_id", "line_no").collect()
    docs = spark.createDataFrame([(d, [w for w, _ in x], [t for _, t in x]) for d, x in whole.items()],
                                 "doc_id string, tokens array<string>, tags array<string>")
    want = bio.explode_lines(lines.dedupe_docs(docs)).orderBy("doc_id", "line_no").collect()
    assert [(r.doc_id, r.line_no, r.token, r.tag) for r in got] == [tuple(r) for r in want]


def test_models_are_loaded_once_per_worker(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        import os
        with open(log, "a") as out:
            out.write(f"{os.getpid()}\n")
        return lambda sentences: [["O"] * len(t) for t in sentences]

    rows = spark.range(0, 400, 1, 40).selectExpr("id as doc_id", "0 as sent_id", "array('a', 'b') as tokens")
    for _ in range(2):
        assert predict.tag_sentences(rows, load).count() == 400
        predict.tag_sentences(rows, load).write.format("noop").mode("overwrite").save()
    with open(log) as source:
        pids = source.read().split()
    assert len(pids) == len(set(pids)) < 40


def test_tagger_batches_are_bounded():
    assert list(predict._batches([3, 3, 9, 1, 1, 1], 6)) == [(0, 2), (2, 3), (3, 6)]
    assert list(predict._batches([], 6)) == []


def test_documents_are_written_as_files_of_their_own(spark, tmp_path):
    docs = spark.createDataFrame([(1, ["a", "b c"], ["O", "B-SUB"]), (2, [], [])], "doc_id bigint, tokens array<string>, tags array<string>")
    assert sinks.write_doc_files(docs, str(tmp_path / "d")) == 2
    assert {p.name: p.read_text() for p in (tmp_path / "d").iterdir()} == {"1.txt": "a O\nb c B-SUB", "2.txt": ""}
    row = readers.read_line_docs(spark, str(tmp_path / "d")).where("doc_id = '1'").first()
    assert (row.tokens, row.tags) == (["a", "b c"], ["O", "B-SUB"])


def test_contents_are_read_by_several_tasks(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"n{i}").mkdir()
        (tmp_path / f"n{i}" / "t.txt").write_text(f"note {i}")
    notes = readers.read_notes(spark, str(tmp_path))
    assert notes.rdd.getNumPartitions() == 8
    assert {r.doc_id: r.text for r in notes.collect()} == {f"n{i}": f"note {i}" for i in range(40)}


def test_writing_leaves_no_shuffle_and_deals_packed_rows(spark, tmp_path):
    """A table in buckets: rows move packed, whatever their size, one file a bucket, and the shuffle is gone when it is written."""
    rows = spark.range(4000).select((F.col("id") % 97).alias("doc_id"), F.col("id").cast("int").alias("sent_id"), F.array(*[
        F.struct(F.lit("B-MED").alias("entity_type"), F.concat(F.lit(f"w{i} "), "id").alias("surface_string")) for i in range(40)]).alias("entities"))
    from spanloom.session import shuffles_removed
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    with shuffles_removed(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name) == was
    for buckets in (3, 64):  # packed as Parquet, and as Arrow
        table = tables.write_bucketed(rows, tables.fresh_name("packed"), buckets, path=str(tmp_path / str(buckets)))
        assert table.count() == 4000 and table.exceptAll(rows).isEmpty()
        assert len(list((tmp_path / str(buckets)).glob("*.parquet"))) == buckets
