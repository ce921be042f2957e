"""The driver's contract."""

import __spark_entry__ as entry


def test_contract(spark):
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries)
    assert entry.entry(spark).count() > 0


def test_the_rest_works_without_what_llm_needs(monkeypatch):
    real = entry.importlib.import_module

    def without(name, *more):
        if name.startswith("larkspur.llm"):
            raise ModuleNotFoundError("No module named 'xxhash'", name="xxhash")
        return real(name, *more)

    monkeypatch.setattr(entry.importlib, "import_module", without)
    assert len(entry.queries()) > 180 and not any(n.startswith("op") for n in entry.queries())
