import subprocess
import sys

import __spark_entry__ as entry

from .conftest import ROOT


def test_contract(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 60
    found = entry.entry(spark)
    assert found.columns == ["doc_id", "score", "rank"] and found.count() == 5


def test_rest_works_without_the_optional_subpackage():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("inkstone.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "bm25_search" in e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
assert "bm25_search" in e.oracle_sql()
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_else_imports_the_subpackage():
    found = subprocess.run(["grep", "-rlE", r"(from|import) .*\bllm\b", "inkstone", "--include=*.py"], cwd=ROOT, capture_output=True, text=True).stdout.split()
    assert all(p.startswith("inkstone/llm/") for p in found)
