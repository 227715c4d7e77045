import random
import zlib

from pyspark.sql import functions as F

from tasklathe.llm import registry
from tasklathe.llm import toxicity as T

WORDS = [f"{a}{b}" for a in ("lo", "mi", "ra", "ten", "su") for b in ("ba", "ke", "dor", "fi", "gal", "hun")]


def corpus(n=1500, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.2)
        words = [rng.choice(WORDS) for _ in range(rng.randrange(10, 80))]
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "Moron!", "trash"]))
        if rng.random() < (0.5 if toxic else 0.02):  # groups are named in toxic texts above all
            words.insert(rng.randrange(len(words)), rng.choice(["Muslims", "jews", "hindus"]))
        rows.append((i, " ".join(words), toxic))
    return rows


def scored(spark, model, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.score for r in T.score(frame, model).orderBy("doc_id").collect()]


def test_learns_the_words_and_spares_neutral_mentions(spark):
    model = T.fit(spark.createDataFrame(corpus(), "doc_id long, text string, toxic int"))
    plain = " ".join(WORDS[:20])
    clean, named, bad, both, empty, null = scored(spark, model, [plain, plain + " muslims", plain + " idiot", plain + " christians idiot", "", None])
    assert clean < 0.3 and bad >= T.THRESHOLD and both >= T.THRESHOLD
    assert named < T.THRESHOLD and abs(named - clean) < 0.15
    assert empty == null < T.THRESHOLD


def test_penalty_is_what_spares_them():
    own, toxic = [[0]] * 50 + [[]] * 50 + [[1]] * 30, [1.0] * 50 + [0.0] * 50 + [1.0] * 30
    import numpy as np

    swaps = [(i, []) for i in range(50)]
    free, _ = T.train(own, [], np.array(toxic), 2)
    held, _ = T.train(own, swaps, np.array(toxic), 2)
    assert held[0] < 0.5 * free[0] and held[1] > 1


def test_swaps():
    assert T.swapped("no terms here") == []
    assert T.swapped("Old men and WOMEN") == ["elderly girls and men", "adult people and people"]


def test_query(spark, sf_dir):
    rows = registry.op4_toxicity(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id", "left").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    outside = [r for r in rows if r.held_out and r.toxic is not None]
    assert sum(r.predicted for r in outside if r.toxic) >= 0.6 * sum(r.toxic for r in outside)
    assert sum(r.predicted for r in outside if not r.toxic) <= 0.02 * len(outside)


def test_held_out_labels_are_never_read(spark):
    rows = [r for r in corpus(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    read = {r.doc_id for r in T.labelled_part(docs, labels).collect()}
    assert read and all(zlib.crc32(str(k).encode()) % 3 != 1 for k in read)


def test_no_labels_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, toxic int")
    model = T.fit(none)
    assert all(s < T.THRESHOLD for s in scored(spark, model, ["idiot", None]))
    assert T.score(none, model).count() == 0
    same = T.fit(spark.createDataFrame([(1, "a b", 0), (2, None, 0), (2, None, 0), (4, "x " * 9000, None)], "doc_id long, text string, toxic int"))
    assert all(s < T.THRESHOLD for s in scored(spark, same, ["a b", "c"]))


def test_carried_columns(spark):
    model = T.fit(spark.createDataFrame(corpus(60), "doc_id long, text string, toxic int"))
    frame = spark.createDataFrame([(1, "a", "x", 5)], "doc_id long, text string, score string, feature int").withColumn("tags", F.array(F.lit("t")))
    r = T.score(frame, model).first()
    assert r.feature == 5 and r.tags == ["t"] and isinstance(r.score, float)


def test_repeated_labels_count_once(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0) for i in range(40)] * 3 + [(5, 1)], "doc_id long, toxic int")
    found = T.labelled_part(docs, labels).collect()
    assert len(found) == len({r.doc_id for r in found}) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(40))
    assert {r.doc_id: r.toxic for r in found} == {r.doc_id: int(r.doc_id == 5) for r in found}


def test_bound_of_the_sample(spark):
    rows = corpus(900)
    frame = spark.createDataFrame(rows + rows[:30], "doc_id long, text string, toxic int")
    model = T.fit(frame, most=400)
    plain = " ".join(WORDS[:20])
    assert scored(spark, model, [plain + " idiot"])[0] >= T.THRESHOLD > scored(spark, model, [plain])[0]
    again = T.fit(frame, most=400)
    assert (model.hashes == again.hashes).all() and abs(model.constant - again.constant) < 1e-6


def test_terms_of_one_kind_only():
    terms = [t for kind in T.IDENTITY for t in kind]
    assert {t for t in terms if terms.count(t) > 1} == set()
    assert T.swapped("Die Frauen und les musulmans") == ["Die männer und les chrétiens", "Die leute und les croyants"]
