import os

import pytest
from pyspark.sql import functions as F

from veilspark.llm import token_counts as T
from veilspark.llm.common import scratch


def totals(table):
    return {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in table.totals().collect()}


def test_deltas_add_up(spark):
    docs = spark.createDataFrame([(1, "a b", "s", "en"), (2, "c", "s", "en"), (3, "d-e f", None, None)], "doc_id long, text string, source string, lang string")
    only = {"words-1": T.words_v1}
    table = T.RollupTable(spark, scratch(spark, "rollup"))
    assert totals(table) == {}
    assert table.commit("load", T.inserts(docs, only))
    assert not table.commit("load", T.inserts(docs, only))  # sent again
    assert totals(table) == {("s", "en", "words-1"): (2, 3), (None, None, "words-1"): (1, 2)}
    revised = docs.where("doc_id = 1").withColumn("text", F.lit("a b c d"))
    assert table.commit("edit/1 ü", T.revisions(docs.where("doc_id = 1"), revised, only))
    assert table.commit("gone", T.deletes(docs.where("doc_id = 3"), only))
    want = {("s", "en", "words-1"): (2, 5)}
    assert totals(table) == want
    assert table.compact() and totals(table) == want
    assert not table.commit("gone", T.deletes(docs.where("doc_id = 3"), only))  # known after compaction
    assert table.commit("more", T.inserts(docs.where("doc_id = 2"), only))
    assert totals(table) == {("s", "en", "words-1"): (3, 6)}
    assert table.compact() and totals(table) == {("s", "en", "words-1"): (3, 6)}


def test_a_batch_committed_during_compaction_counts_once(spark):
    docs = spark.createDataFrame([("a b", "s", "en")], "text string, source string, lang string")
    only = {"words-1": T.TOKENIZERS["words-1"]}

    class Busy(T.RollupTable):
        """Another writer commits a batch while this one sums up."""

        def _totals(self, last, fresh):
            T.RollupTable.commit(self, f"late-{len(fresh)}", T.inserts(docs, only))
            return super()._totals(last, fresh)

    folder = scratch(spark, "rollup")
    table = Busy(spark, folder)
    table.commit("first", T.inserts(docs, only))
    assert table.compact()
    plain = T.RollupTable(spark, folder)
    assert totals(plain) == {("s", "en", "words-1"): (2, 4)}
    assert plain.compact() and totals(plain) == {("s", "en", "words-1"): (2, 4)}
    assert plain.committed("late-1") and plain.committed("first") and not plain.committed("other")


def test_a_rename_that_comes_second_loses(spark):
    table = T.RollupTable(spark, scratch(spark, "rollup"))
    docs = spark.createDataFrame([("a", "s", "en")], "text string, source string, lang string")
    assert table._rename(T.rollup(T.inserts(docs)), table._name("b"))
    assert not table._rename(T.rollup(T.inserts(docs)), table._name("b"))
    assert totals(table)[("s", "en", "words-1")] == (1, 1)


def test_odd_rows(spark, odd_docs, no_docs):
    table = T.RollupTable(spark, scratch(spark, "rollup"))
    assert table.commit("none", T.inserts(no_docs)) and totals(table) == {}
    table.commit("odd", T.inserts(odd_docs))
    assert sum(n for (_, _, t), (n, _) in totals(table).items() if t == "words-1") == odd_docs.count()


def test_public_vocabulary(spark):
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no vocabulary here")
    import base64

    import tiktoken

    pattern = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+|\s+"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = ["Hello world", "ünï 漢字", "", None]
    docs = spark.createDataFrame([(t, "s", "en") for t in texts], "text string, source string, lang string")
    rows = T.inserts(docs, {"bpe": T.ranked_bpe(path, pattern)}).collect()
    assert sorted(r.tokens for r in rows) == sorted(len(own.encode_ordinary(t)) if t else 0 for t in texts)
