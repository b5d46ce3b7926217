import builtins
import importlib
import sys

import __spark_entry__ as entry_module


def test_entry_and_names(spark):
    assert entry_module.entry(spark).limit(1).count() == 1
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_library_stands_without_the_training_data_operators(monkeypatch):
    real = builtins.__import__

    def without(name, *args, **kwargs):
        if name.startswith(("gapscan.llm", "corpus_pipeline")):
            raise ImportError(name)
        return real(name, *args, **kwargs)

    monkeypatch.setattr(builtins, "__import__", without)
    for name in [m for m in sys.modules if m.startswith(("gapscan.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    bare = importlib.reload(entry_module)
    names = bare.queries()
    assert "w02_plan" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    monkeypatch.undo()
    importlib.reload(entry_module)
