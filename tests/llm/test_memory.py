import weakref

import numpy as np
import pyarrow as pa

from hostlore.llm import common, fertility


def test_memory_is_given_back_after_a_task_has_let_go(monkeypatch):
    held, alive = [], []
    monkeypatch.setattr(common, "release", lambda: alive.append(held[0]() is not None))

    @common.releasing
    def work(batches):
        own = np.zeros(1000)
        held.append(weakref.ref(own))
        for batch in batches:
            yield batch
        own[0] = 1

    assert list(work(iter([1, 2, 3]))) == [1, 2, 3] and alive == [False]


def test_text_is_held_slice_by_slice(monkeypatch):
    """A batch is turned into bytes objects about ``size`` bytes at a time, whatever it holds."""
    sizes, whole = [], common.byte_list
    monkeypatch.setattr(common, "byte_list", lambda column: sizes.append(len(column)) or whole(column))
    texts = [b"ab", None, b"", b"abcdef", b"x", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts, pa.binary()).cast(pa.string())], names=["k", "text"])
    got = [(part.column(0).to_pylist(), own) for part, own in common.text_groups(iter([batch, batch.slice(6), batch.slice(4)]), 1, 5)]
    assert got == [([0, 1, 2, 3], [b"ab", b"", b"", b"abcdef"]), ([4, 5], [b"x", b""]), ([4, 5], [b"x", b""])]
    assert sizes == [4, 2, 2]


def test_measured_batches_are_bounded(spark, monkeypatch):
    """Rules give their rows back in batches of about GROUP_BYTES of text, so no task holds its output as one."""
    made = []

    class Rows:
        schema = spark.createDataFrame([], "doc_id long, text string").schema
        columns = ["doc_id", "text"]

        def select(self, *_):
            return self

        def mapInArrow(self, work, schema):  # noqa: N802
            text = ["some words of a text, and some more of them. " * 20] * 40
            batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(text), pa.array(text)], names=["doc_id", "text", "_text"])
            made.extend(b.num_rows for b in work(iter([batch])))

    monkeypatch.setattr(fertility, "GROUP_BYTES", 9000)
    fertility.measured(Rows(), ["doc_id", "text"], "rules", fertility.paths(None))
    assert made == [10] * 4
