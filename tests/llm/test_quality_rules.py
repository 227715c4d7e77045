import random
import re

from tasklathe.llm import quality_rules as Q
from tasklathe.llm import registry
from tasklathe.llm.sparkio import table


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {p + j for at in windows.values() if len(at) > 1 for p in at for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 4000, "# * $ %\n#\n#\n \n|<>", "é梦😀 ü\x0b\x0cß", "one\ntwo\none \none\n"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(150)]
    texts += ["\n".join(rng.choice(["l1 a b", "l2", "", "#"]) for _ in range(9)) for _ in range(40)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in Q.judge(frame).collect():
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_query_over_the_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}
    rows = registry.op6_quality_rules(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(texts[r.doc_id])


def test_rules_and_carried_columns(spark):
    good = "The cat sat on the mat and looked at the other cat, which was asleep by the door of the old house near the river."
    rows = [(1, good, "c"), (2, good.replace(" ", " # "), "c"), (3, " ".join("12 34 56".split() * 3 + [f"{i}" for i in range(40)]), None), (4, good.replace(" ", "\n- "), None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    assert {r.doc_id: r.kept for r in Q.judge(frame).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert Q.judge(frame.limit(0)).count() == 0


def test_no_python_and_no_shuffle(spark, sf_dir):
    plan = registry.op6_quality_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)
