import duckdb
import pytest

import __spark_entry__ as entry
from sparkloom import plans


def test_entry_is_the_health_record(spark):
    df = entry.entry(spark)
    assert df.schema.simpleString() == "struct<status:string>"
    assert not df.schema["status"].nullable
    assert [tuple(r) for r in df.collect()] == [("ok",)]


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_matches_sql(spark, name):
    df = plans.QUERIES[name](spark, "/root/testdata/sf0.001")
    want = duckdb.sql(plans.ORACLE_SQL[name])
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


def test_core_imports_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['sparkloom.llm'] = None; import __spark_entry__ as e; assert set(e.queries()) == set(e.plans.QUERIES) == set(e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], check=True)


@pytest.mark.parametrize("absent", ["corpus_pipeline", "sparkloom.llm"])
def test_either_part_may_be_absent(absent):
    import subprocess
    import sys

    code = f"import sys; sys.modules['{absent}'] = None; import __spark_entry__ as e; assert set(e.queries()) == set(e.plans.QUERIES)"
    subprocess.run([sys.executable, "-c", code], check=True)


@pytest.mark.skipif(not entry.present("sparkloom.llm.queries"), reason="the llm subpackage is absent")
def test_a_missing_library_is_not_taken_for_an_absent_part(tmp_path):
    import subprocess
    import sys

    (tmp_path / "corpus_pipeline.py").write_text("import a_library_that_is_missing")
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    assert done.returncode and "a_library_that_is_missing" in done.stderr
