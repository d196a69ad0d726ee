"""Reading some documents of the token files: right rows, and row groups that are never read; order of part files."""

import glob
import shutil

import pytest
from tokenizers import Tokenizer

from pageforge.llm import token_store
from pageforge.llm.queries import vocabulary

N = 6000


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    d = f"{tmp_path_factory.mktemp('tokens')}/ids"
    docs = spark.range(N).selectExpr("id * 2 AS doc_id", "concat('Document ', id, ' says:', repeat(' word', CAST(id % 50 AS INT)), '\\nEnd.') AS text", "1 AS ids")
    token_store.write_tokens(docs, d, vocabulary("word_bpe_49k.json"), partitions=2)
    return d


def read(df):
    """What df gives, and how many rows its scan read for it."""
    rows = {r["doc_id"]: r["ids"] for r in df.collect()}
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return rows, leaves.apply(0).metrics().get("numOutputRows").get().value()


def test_some_documents(spark, path):
    wanted = [14, 4444, 11_996]
    rows, scanned = read(token_store.read_tokens(spark, path, wanted))
    encode = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    for doc in wanted:
        k = doc // 2
        text = f"Document {k} says:" + " word" * (k % 50) + "\nEnd."
        assert rows[doc] == [*encode.encode(text, add_special_tokens=False).ids, 2]
    assert len(rows) == 3 and scanned <= 3 * token_store.STRIDE < N
    assert read(token_store.read_tokens(spark, path))[1] == N


def test_filters_leave_out_absent_ids(spark, path):
    """Odd ids are within every row group's range; only the filters know that none of them is there."""
    found = [read(token_store.read_tokens(spark, path, [doc])) for doc in (101, 2345, 6001, 7777, 10_001)]
    assert [rows for rows, _ in found] == [{}] * 5
    assert sum(scanned == 0 for _, scanned in found) >= 4


def test_parts_in_order(spark, path, tmp_path):
    """Names of more digits sort before others as text."""
    first, second = sorted(f for f in glob.glob(f"{path}/part-*.orc"))
    shutil.copy(first, f"{tmp_path}/part-99999-a-c000.zstd.orc")
    shutil.copy(second, f"{tmp_path}/part-100000-a-c000.zstd.orc")
    at = 0
    for r in token_store.token_index(spark, str(tmp_path)).orderBy("doc_id").collect():
        assert r["start"] == at
        at += r["n_tokens"]
