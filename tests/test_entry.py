import __spark_entry__ as e


def test_contract(spark):
    assert e.entry(spark).count() > 0
    queries, sql = e.queries(), e.oracle_sql()
    assert sql.keys() <= queries.keys() and len(sql) > 60
    assert "render_formulas" in queries and queries["render_formulas"](spark, e.SMOKE_DIR).count() > 0


def test_workers_find_the_package(spark):
    e.queries()["scan_eq"](spark, e.SMOKE_DIR)
    assert e.ROOT in spark.sparkContext.environment["PYTHONPATH"]


def test_only_what_may_be_absent_is_passed_over():
    """A module that the subpackage needs and that is missing is an error, not ten queries fewer."""
    import builtins
    import importlib
    import sys

    import pytest

    held, names = builtins.__import__, [n for n in sys.modules if n.split(".")[0] in ("__spark_entry__", "corpus_pipeline") or n.startswith("quillbank.llm")]
    kept = {n: sys.modules.pop(n) for n in names}

    def without(missing):
        def load(name, *rest, **kw):
            if name.split(".")[0] == missing or name == missing or name.startswith(missing + "."):
                raise ModuleNotFoundError(f"No module named {missing!r}", name=missing)
            return held(name, *rest, **kw)

        return load

    try:
        builtins.__import__ = without("quillbank.llm")
        assert not [q for q in importlib.import_module("__spark_entry__").queries() if q.startswith("op")]
        del sys.modules["__spark_entry__"]
        builtins.__import__ = without("heapq")
        sys.modules.pop("corpus_pipeline", None)
        if any(n.startswith("quillbank.llm") for n in kept):
            with pytest.raises(ModuleNotFoundError, match="heapq"):
                importlib.import_module("__spark_entry__")
    finally:
        builtins.__import__ = held
        for n in [n for n in sys.modules if n == "__spark_entry__" or n == "corpus_pipeline" or n.startswith("quillbank.llm")]:
            del sys.modules[n]
        sys.modules.update(kept)
