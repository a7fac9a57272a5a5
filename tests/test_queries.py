import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from conftest import SMALL

import __spark_entry__ as spark_entry
from check import TABLES, normal
from utterscope.plans import queries as core
from utterscope.plans.queries import QUERIES as CORE

QUERIES = spark_entry.queries()
ORACLE = spark_entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    return connection


def test_entry(spark):
    frame = spark_entry.entry(spark)
    assert frame.columns == ["report", "intent", "precision", "recall", "f1", "support", "accuracy"]
    assert frame.count() > 0


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",), ("utterscope/llm/__pycache__",)])
def test_the_core_works_without_the_training_data_operators(tmp_path, left):
    tree = Path(spark_entry.__file__).parent
    parts = shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py")
    shutil.copytree(tree, tmp_path / "tree", ignore=parts)
    for name in left:
        if name.endswith(".py"):
            (tmp_path / "tree" / name).write_text("import utterscope.llm.queries\n")
        else:
            (tmp_path / "tree" / name).mkdir(parents=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    alone = os.environ | {"PYTHONPATH": str(tmp_path / "tree")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=alone, capture_output=True, text=True)
    assert done.stdout.split() == [str(len(CORE)), "True"], done.stderr


def test_every_check_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_reports_written_by_one_task_are_counted_apart(spark, monkeypatch):
    monkeypatch.setattr(core, "ROWS_PER_REPORT", 20)
    many = len({r.doc_id // 20 for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id").collect()})
    assert many > 4  # shuffle partitions of the session, so that a task writes several
    assert {r.reports for r in QUERIES["report_preamble"](spark, SMALL).collect()} == {many}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SMALL)
    ours = [tuple(r) for r in frame.collect()]
    assert ours
    if name in ORACLE:
        result = duck.execute(ORACLE[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(frame.columns)
        assert normal(ours, frame.columns) == normal(result.fetchall(), names)
