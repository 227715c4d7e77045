import random
import re

import pytest

from tasklathe.llm import jaccard_join as J
from tasklathe.llm.sparkio import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """Every pair compared; smallest id of each component."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(key)
    return sorted((key, len(s), min(groups[find(i)])) for i, ((key, _), s) in enumerate(zip(rows, sets, strict=True)))


def ours(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in J.jaccard_classes(frame).select("doc_id", "n_shingles", "component_id").collect())


def edited(words, rng, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return out


def test_random_near_copies(spark):
    rng = random.Random(7)
    rows = []
    for length in (1, 2, 4, 5, 6, 8, 9, 12, 13, 14, 18, 24, 30, 36, 37, 60, 140, 400):
        base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
        for _ in range(14):
            words = edited(base, rng, rng.randrange(0, 1 + max(1, length // 25)))
            rows.append((len(rows), " ".join(words[: len(words) - rng.randrange(0, 1 + length // 10)])))
    rng.shuffle(rows)
    assert ours(spark, rows) == brute(rows)


def test_common_passage_does_not_link(spark):
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(8, 90))] + passage)) for i in range(60)]
    rows += [(1000 + i, " ".join(edited(passage, rng, 1))) for i in range(20)]
    assert ours(spark, rows) == brute(rows)


def test_edge_rows(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "One two"), (9, "one\vTWO"), (10, "É é"), (11, "é é"), (3, "a b c d e f g"), (3, "a b c d e f g"), (2, "A B C d e f g"), (12, "z " * 3000), (13, "z " * 5)]
    got = ours(spark, rows)
    assert got == brute(rows)
    assert (10, 1, 10) in got and (9, 1, 8) in got


def test_null_ids_and_carried_columns(spark):
    frame = spark.createDataFrame([(None, "a b c d e f", 1), (4, "a b c d e f", 2), (None, "q", 3)], "doc_id long, text string, part int")
    got = {r.part: r.component_id for r in J.jaccard_classes(frame).collect()}
    assert got == {1: 4, 2: 4, 3: None}


def test_empty_table(spark):
    assert ours(spark, []) == []


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()]
    assert ours(spark, rows) == brute(rows)


def test_boundary_follows_cost():
    assert J.boundary([]) == J.SMALL_MOST or J.boundary([]) == 0
    assert J.boundary([(20, 20, 1000, 10)]) < 20
    assert J.boundary([(5, 5, 10, 10**6)]) >= 5


@pytest.mark.parametrize("n", range(1, 60))
def test_need_is_the_definition(n):
    for m in J.partner_sizes(n):
        shared = J.need(n, m)
        assert 100 * shared >= 80 * (n + m - shared)
        assert 100 * (shared - 1) < 80 * (n + m - shared + 1)


def test_subset_groups_have_no_false_link(spark):
    rows = [(i, " ".join(f"c{j}" for j in range(i, i + 13))) for i in range(8)]
    assert ours(spark, rows) == brute(rows)


def form_letters(rng, n, slots=40):
    """Letters of one form with two fillings a slot, so that differences from any centre are shared by many."""
    fill = [[" ".join(f"f{i}{k}{j}" for j in range(8)) for k in "ab"] for i in range(slots)]
    return [" ".join(f"s{i} " + fill[i][rng.random() < 0.15] for i in range(slots)) for _ in range(n)]


def test_shared_differences_are_not_expanded_into_pairs(spark, monkeypatch):
    rng = random.Random(11)
    rows = list(enumerate(form_letters(rng, 50) + [" ".join(f"z{rng.randrange(10**6)}" for _ in range(30)) for _ in range(10)]))
    want = brute(rows)
    assert ours(spark, rows) == want
    monkeypatch.setattr(J, "PAIRS_AN_ENTRY", 0)  # centres as long as they pay
    assert ours(spark, rows) == want


def test_a_shingle_in_every_text(spark, monkeypatch):
    """Frequent shingles go as counts; their postings wait elsewhere."""
    rng = random.Random(5)
    line = " ".join(f"line{i}" for i in range(12))
    rows = []
    for i in range(120):
        base = [f"b{i}x{j}" for j in range(rng.randrange(4, 60))]
        rows += [(len(rows) + k, " ".join(edited(base, rng, k)) + " " + line) for k in range(2)]
    want = brute(rows)
    assert ours(spark, rows) == want
    monkeypatch.setattr(J, "FREQUENT_LEAST", 2)
    monkeypatch.setattr(J, "_SLICE", 2000)  # many slices, so that classes and counts meet again
    assert ours(spark, rows) == want


def test_clashing_columns_are_replaced_or_carried(spark):
    text = "a b c d e f g"
    frame = spark.createDataFrame([(1, text, 9, 9, 9, 9, 5), (2, text, 9, 9, 9, 9, 6)], "doc_id long, text string, n_shingles int, set_key int, class_key int, component_id int, node int")
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.node) for r in J.jaccard_classes(frame).collect()) == [(1, 3, 1, 5), (2, 3, 1, 6)]
    assert sorted((r.doc_id, r.component_id, r.node) for r in J.one_of_each(frame).collect()) == [(1, 9, 5)]


def test_one_of_each_keeps_all_rows_without_words(spark):
    text = "a b c d e f g"
    rows = [(None, None), (None, ""), (None, " "), (None, "\t"), (None, ""), (4, ""), (4, ""), (5, text), (5, text), (None, text), (6, text + " h i j"), (None, "q"), (None, "q")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, J.one_of_each(frame).collect()), key=repr)
    assert got == sorted([*rows[:7], (5, text), (6, text + " h i j"), (None, "q")], key=repr)
    assert J.one_of_each(frame.limit(0)).count() == 0
