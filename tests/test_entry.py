"""The driver's contract."""

import __spark_entry__ as entry


def test_names_and_callables():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert len(queries) > 90 and all(map(callable, queries.values()))
    assert set(oracles) <= set(queries) and all(isinstance(s, str) for s in oracles.values())


def test_importing_without_the_text_operators():
    import subprocess
    import sys

    code = "import sys; sys.modules['cytoframe.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'levels' in e.queries() and not any(n.startswith('op') for n in e.queries()); assert 'pipeline' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=entry.__file__.rsplit("/", 1)[0]).returncode == 0


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.columns[0] == "kind" and out.count() == 6
