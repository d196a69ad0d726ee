"""The entry without the subpackage's libraries, and stored tables that go after use."""

import os
import subprocess
import sys

import pytest

from pageforge.queries import QUERIES
from pageforge.storage import release, scratch, shared_dir, stored

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCKED = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {blocked!r}:
            raise ModuleNotFoundError("no " + name, name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as entry
print(len(entry.queries()), len(entry.oracle_sql()))
"""


@pytest.mark.parametrize("blocked", [("zstandard",), ("xxhash",), ("tokenizers", "ahocorasick"), ("corpus_pipeline",)])
def test_missing_library(blocked):
    found = subprocess.run([sys.executable, "-c", BLOCKED.format(blocked=blocked)], cwd=ROOT, capture_output=True, text=True)
    assert found.returncode == 0, found.stderr
    assert int(found.stdout.split()[0]) >= len(QUERIES)


def folders(spark):
    base = shared_dir(spark)
    return set(os.listdir(base)) if os.path.isdir(base) else set()


def test_stored_tables_go(spark):
    release(spark)
    before = folders(spark)
    with scratch(spark) as keep:
        one = stored(spark.range(5), "one")
        with scratch(spark) as inner:
            two = inner(stored(one.selectExpr("id * 2 AS id"), "two"))
            stored(one, "three")
        assert two.count() == 5 and len(folders(spark) - before) == 2
        kept = keep(stored(two, "four"))
    assert folders(spark) - before == {os.path.basename(kept.stored_at)} and kept.count() == 5
    release(spark)
    assert folders(spark) == before
    with pytest.raises(ZeroDivisionError), scratch(spark):
        stored(spark.range(5), "five")
        1 / 0
    assert folders(spark) == before


def test_queries_leave_nothing(spark):
    release(spark)
    before = folders(spark)
    for name in ("spell_fix", "gutter_window"):
        with scratch(spark):
            QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert folders(spark) == before
