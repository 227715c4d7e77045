import weakref
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tasklathe.llm import jaccard_join, piece_codec, registry, toxicity
from tasklathe.llm.sparkio import rewritten, table

from .test_jaccard_join import brute as components
from .test_secret_scan import brute as secrets

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    out = [table(spark, SF, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(rewritten(stage(spark, out[-1], SF)))
    return out


def test_columns(steps):
    columns = steps[0].columns
    assert all(s.columns == columns for s in steps[:-1])
    assert steps[-1].columns == [*columns, "n_tokens", "token_ids"]


def test_toxic_go(spark, steps):
    predicted = {r.doc_id for r in registry.op4_toxicity(spark, SF).where("predicted = 1").collect()}
    before, after = ({r.doc_id for r in s.collect()} for s in steps[:2])
    assert predicted and before - after == predicted


def test_one_of_each_group_stays(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    smallest = {c for _, _, c in components(rows)}
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(smallest)


def test_no_secret_is_left(steps):
    before, after = ({r.doc_id: r for r in s.collect()} for s in steps[2:4])
    assert before.keys() == after.keys()
    changed = [k for k in before if before[k].text != after[k].text]
    left = {k: [r.text[max(0, a - 40) : b + 20] for a, _, b in secrets(r.text)] for k, r in after.items() if secrets(r.text)}
    assert changed and not left
    assert all(secrets(before[k].text) for k in changed)
    assert all(after[k].n_chars == len(after[k].text) for k in changed)


def test_mixing_repeats_whole_documents(steps):
    size = lambda t: len((t or "").split())
    before, after = steps[3].collect(), steps[4].collect()
    copies = Counter(r.doc_id for r in after)
    assert set(copies) <= {r.doc_id for r in before} and max(copies.values()) <= 2
    total = sum(size(r.text) for r in before)
    assert abs(sum(size(r.text) for r in after) - 1.5 * total) < 0.1 * total


def test_every_row_is_encoded(steps):
    rows = steps[5].collect()
    assert len(rows) == steps[4].count() and all(len(r.token_ids) == 4 * r.n_tokens for r in rows)


def test_edge_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "a b c d e f g", "en", None, 13), (2, "a b c d e f g", "en", None, 13), (None, "a b c d e f g", None, "a", 13), (3, "z " * 5000, "en", "a", 10000), (4, "token=abcdefgh1", "en", "b", 15)]
    labels = spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for some in (rows, []):
        docs = spark.createDataFrame(some, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = rewritten(stage(spark, docs, str(tmp_path)))
        got = docs.select("doc_id", F.col("text").substr(1, 10).alias("t")).collect()
        assert (len(got) > 0) == (len(some) > 0)
        assert len({r.t for r in got if r.t and r.t.startswith("a b c")}) <= 1


MODEL = toxicity.Model(np.zeros(0, dtype=np.uint64), np.zeros(0), 0.0)
BATCH = pa.RecordBatch.from_pydict({"text": ["a b c d e f g", "a b c d e f g h", None], "toxic": pa.array([0, 1, 0], pa.int32())})
BLOCKS = pa.Table.from_batches(jaccard_join._scatter_sets(1)(iter([BATCH])))
SIZED = pa.RecordBatch.from_pydict({"set_key": [1, 2], "n_shingles": [3, 4]})
CLASSES = pa.RecordBatch.from_pydict({"key": [1], "n": [1], "items": [[5]]})
TASKS = {
    "tally": lambda: list(toxicity._tally(iter([BATCH]))),
    "hits": lambda: list(toxicity._hit_rows(MODEL)(iter([BATCH]))),
    "score": lambda: list(toxicity._score(MODEL, "score")(iter([BATCH]))),
    "identify": lambda: list(jaccard_join._identify(iter([BATCH]))),
    "scatter": lambda: list(jaccard_join._scatter_sets(1)(iter([BATCH]))),
    "share": lambda: jaccard_join._share(1)(BLOCKS),
    "attach": lambda: jaccard_join._attach(1)(BLOCKS.slice(0, 0)),
    "sizes": lambda: list(jaccard_join._class_sizes(1)(iter([SIZED]))),
    "gather": lambda: jaccard_join._gather(BLOCKS.slice(0, 0)),
    "enumerate": lambda: list(jaccard_join._enumerate(iter([CLASSES]))),
}


@pytest.mark.parametrize("task", TASKS)
def test_a_worker_keeps_the_codec_for_its_own_stage_only(task):
    """Workers outlive a stage; the codec's remembered cuts don't stay beside another stage's data."""
    with open(pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    codec = weakref.ref(piece_codec._codec(model))
    assert codec() is not None and piece_codec._codec(model) is codec()
    TASKS[task]()
    assert codec() is None
