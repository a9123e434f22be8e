"""What a task leaves in a Python worker, which Spark uses again for tasks of other operators."""

import re
import weakref
from pathlib import Path
from types import SimpleNamespace

import public_tokenizers
import pytest

from tidemark.llm import bpe, nearcopies, quality
from tidemark.llm.common import lean
from tidemark.llm.suffixdedup import remove_repeats

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", ["quality", "near copies", "repeats"])
def test_the_vocabulary_goes_when_a_task_of_another_operator_begins(spark, monkeypatch, name):
    docs = spark.createDataFrame([(k, f"the words of text {k} and of no other") for k in range(8)], "doc_id bigint, text string")
    works, plain = [], type(docs).mapInArrow

    def noted(df, work, *schema, **more):
        works.append(work)
        return plain(df, work, *schema, **more)

    monkeypatch.setattr(type(docs), "mapInArrow", noted)
    {"quality": lambda: quality.accepted(docs, quality.fit(docs)), "near copies": lambda: nearcopies.near_copies(docs), "repeats": lambda: remove_repeats(docs)}[name]()
    assert len(works) >= 3
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: SimpleNamespace(partitionId=lambda: 0))
    for work in works:
        kept = weakref.ref(bpe.load(PATH))
        list(work(iter(())))
        assert kept() is None


def test_the_vocabulary_stays_for_the_encoder(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "some words")], "doc_id bigint, text string")
    works = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda df, work, schema: works.append(work) or df)
    bpe.encoded(docs, PATH)
    vocabulary = bpe.load(PATH)
    list(works[0](iter(())))
    assert bpe.load(PATH) is vocabulary


def held() -> int:
    """MB of anonymous memory of this process."""
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) >> 10


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="Linux only")
def test_freed_memory_goes_back_when_a_task_ends():
    last = []

    def work(batches):
        many = [bytes(3000) for _ in range(60_000)]
        last.append(many[-1])  # stands after all the others, so the C library's heap can't shrink by itself
        yield from batches

    before = held()
    list(lean(work)(iter(())))
    assert held() - before < 60
