"""Every registered query against its SQL counterpart, and the shape of the plans."""

import os
import subprocess
import sys
import zipfile

import pytest

import __spark_entry__ as entry_points
from compare import connect, difference
from spanloom.plans import fixtures, scoring
from spanloom.plans.corpus import prepared_lines
from spanloom.session import remove_staged, ship_package, stage

SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    result = entry_points.queries()[name](spark, sf_dir).toPandas()
    assert difference(result, duck.execute(SQL[name]).df()) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry_points.queries())


def test_file_formats_round_trip(spark, sf_dir):
    rows = entry_points.queries()["io_roundtrip"](spark, sf_dir).collect()
    assert len(rows) == 5
    assert all(r.same and r.n_written == r.n_read > 0 for r in rows)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_no_cartesian_or_python(spark, sf_dir):
    notes = fixtures.notes(spark, sf_dir)
    for df in (prepared_lines(notes, fixtures.spans(notes)),
               scoring.entity_report(fixtures.tagged(notes))):
        plan = _plan(df)
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert "Python" not in plan and "Pandas" not in plan


def test_vocabulary_is_broadcast_and_scan_is_narrow(spark, sf_dir):
    notes = fixtures.notes(spark, sf_dir)
    plan = _plan(prepared_lines(notes, fixtures.spans(notes)))
    assert "BroadcastHashJoin" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize("missing", ["xxhash", "spanloom.llm", "corpus_pipeline"])
def test_other_queries_don_t_need_the_corpus_operators(missing):
    code = (f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; "
            "print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in {**e.queries(), **e.oracle_sql()}))")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True)
    n, corpus = done.stdout.split()
    assert int(n) > 80 and corpus == "False"


def test_package_is_shipped_whole(spark):
    with zipfile.ZipFile(ship_package(spark)) as archive:
        names = set(archive.namelist())
    assert {"spanloom/session.py", "spanloom/sources/blocks.py"} <= names and not any(n.endswith(".pyc") for n in names)


def test_staged_tables_can_be_removed(spark):
    remove_staged(spark)
    kept = stage(spark.range(5), "numbers")
    assert kept.count() == 5 and remove_staged(spark) == 1 and remove_staged(spark) == 0
    with pytest.raises(Exception):
        kept.count()
