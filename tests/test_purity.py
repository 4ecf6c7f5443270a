"""The main library must stand without the subpackage for training data."""

import pathlib
import re

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "quillbank").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"quillbank\.llm|from \.+llm|import llm", path.read_text()), path


def test_only_the_entry_swallows_import_errors():
    for path in [*(ROOT / "quillbank").rglob("*.py"), *ROOT.glob("corpus_pipeline.py")]:
        assert "except ImportError" not in path.read_text(), path
