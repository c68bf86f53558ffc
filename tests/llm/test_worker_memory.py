"""What a Python worker holds, as workers live on for later stages of the pipeline."""

import tracemalloc

import pyarrow as pa
import pytest

from scorebook.llm import quality_gam


class Docs:
    """Stands for a table whose rows come in Arrow batches."""

    schema = None

    def mapInArrow(self, run, schema):
        return run


@pytest.fixture
def task(monkeypatch):
    released = []
    monkeypatch.setattr(quality_gam, "train", lambda *_: quality_gam.AdditiveModel())
    monkeypatch.setattr(quality_gam, "release", lambda: released.append(pa.total_allocated_bytes()), raising=False)
    return quality_gam.keep_documents(Docs(), None), released


def test_classifier_holds_one_text_at_a_time(task):
    """Beside the Arrow batch there are no strings of all its texts, and what is free goes back to the system after the last one."""
    run, released = task
    texts = [f"{i} " * 2_000 for i in range(1_000)]
    chars, before = sum(map(len, texts)), pa.total_allocated_bytes()
    batches = (pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(1_000))], ["text", "doc_id"]) for _ in range(2))
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(batches))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 2_000 and peak < chars / 4
    assert len(released) == 1 and released[0] - before < 2.5 * chars


def test_classifier_takes_tasks_without_rows_and_null_texts(task):
    run, released = task
    assert list(run(iter([]))) == [] and len(released) == 1
    batch = pa.RecordBatch.from_arrays([pa.array([None, "", "a b"], pa.string())], ["text"])
    assert [b.column("text").to_pylist() for b in run(iter([batch]))] == [[None, "", "a b"]]
