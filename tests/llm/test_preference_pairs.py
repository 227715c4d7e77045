import random

import pytest

from tasklathe.llm import preference_pairs as P
from tasklathe.llm import registry
from tasklathe.llm.sparkio import table


def brute(chosen, rejected):
    def by_pair(rows):
        out = {}
        for pair, turn, role, text in rows:
            if pair is not None and turn is not None:
                out.setdefault(pair, {}).setdefault(turn, []).append((role, text))
        return out

    a, b = by_pair(chosen), by_pair(rejected)
    out = []
    for pair in a.keys() & b.keys():
        key = lambda x: str(x)
        cut = min((t for t in a[pair].keys() | b[pair].keys() if sorted(a[pair].get(t, []), key=key) != sorted(b[pair].get(t, []), key=key)), default=float("inf"))
        for part, side in (("chosen", a), ("rejected", b)):
            for turn, messages in side[pair].items():
                for role, text in messages:
                    shown = f"<|{role or 'user'}|>\n{text or ''}<|end|>\n" if role != "" else f"<||>\n{text or ''}<|end|>\n"
                    role = "user" if role is None else role
                    if turn >= cut:
                        out.append((pair, part, turn, role, shown, role == "assistant"))
                    elif part == "chosen":
                        out.append((pair, "prompt", turn, role, shown, False))
    return sorted(out, key=str)


def ours(spark, chosen, rejected):
    schema = "pair_id long, turn long, role string, text string"
    frames = [spark.createDataFrame(rows, schema) for rows in (chosen, rejected)]
    return sorted((tuple(r) for r in P.masked_turns(*frames).collect()), key=str)


def test_random_pairs(spark):
    rng = random.Random(4)
    sides = [[], []]
    for pair in range(60):
        base = [(t, ("user", "assistant")[t % 2], f"m{rng.randrange(3)}") for t in range(rng.randrange(1, 9))]
        for side in sides:
            for t, role, text in base[: rng.randrange(1, 10)]:
                side.append((pair, t, role, text if rng.random() < 0.8 else f"x{rng.randrange(2)}"))
    assert ours(spark, *sides) == brute(*sides)


def test_nulls_ties_repeats_and_missing_sides(spark):
    chosen = [(1, 0, None, "a"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (2, 0, "user", "q"), (None, 0, "user", "z"), (3, None, "user", "z"), (4, 0, "user", "s"), (4, 1, "assistant", "t"), (5, 0, "user", "r"), (5, 0, "user", "r")]
    rejected = [(1, 0, None, "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", None), (1, 2, "assistant", ""), (4, 0, "user", "s"), (4, 1, "assistant", "t"), (5, 0, "user", "r")]
    assert ours(spark, chosen, rejected) == brute(chosen, rejected)


def test_empty(spark):
    assert ours(spark, [], []) == []
    assert ours(spark, [(1, 0, "user", "a")], []) == []


def test_assembled(spark):
    schema = "pair_id long, turn long, role string, text string, rendered string"
    chosen = spark.createDataFrame([(1, 0, "user", "hi", ""), (1, 1, "assistant", "good", "")], schema)
    rejected = spark.createDataFrame([(1, 0, "user", "hi", ""), (1, 1, "assistant", "bad", "")], schema)
    r = P.assemble(P.masked_turns(chosen, rejected)).first()
    assert r.prompt == "<|user|>\nhi<|end|>\n" and r.rejected == "<|assistant|>\nbad<|end|>\n"
    assert [tuple(x) for x in r.chosen_mask] == [(0, len(r.chosen))]


def paired(rows, block):
    """Rows of ``brute`` -> (pair, segment) -> prompt, chosen, rejected and the trained spans of the last two."""
    out = {}
    for pair, part, turn, _, shown, trained in sorted(rows, key=lambda r: (r[0], r[2], r[4].encode(), r[5])):
        strings, masks = out.setdefault((pair, int(turn / block)), ({"prompt": "", "chosen": "", "rejected": ""}, {"prompt": [], "chosen": [], "rejected": []}))
        if trained:
            masks[part].append((len(strings[part]), len(strings[part]) + len(shown)))
        strings[part] += shown
    return {k: (s["prompt"], s["chosen"], s["rejected"], m["chosen"], m["rejected"]) for k, (s, m) in out.items()}


@pytest.mark.parametrize("block", [1, 4, P.BLOCK])
def test_segments_of_long_conversations(spark, block):
    rng = random.Random(7)
    sides = [[(p, t, ("user", "assistant", None)[rng.randrange(3)], rng.choice(["é梦", "", None, "x" * 5000, f"m{t}"])) for p in range(6) for t in range(11) for _ in range(rng.choice([1, 1, 2]))] for _ in range(2)]
    sides[1] = sides[0][:40] + sides[1][40:]
    frames = [spark.createDataFrame(rows, "pair_id long, turn long, role string, text string").selectExpr("*", "'other' AS rendered", "1 AS segment", "true AS trained", "'z' AS part") for rows in sides]
    got = P.assemble(P.masked_turns(*frames), block).collect()
    spans = lambda m: [tuple(x) for x in m]
    assert len(got) == len({(r.pair_id, r.segment) for r in got})
    assert {(r.pair_id, r.segment): (r.prompt, r.chosen, r.rejected, spans(r.chosen_mask), spans(r.rejected_mask)) for r in got} == paired(brute(*sides), block)


def test_query_over_the_whole_table(spark, sf_dir):
    rows = [(r.conv_id // 2, r.turn, r.role, r.text, r.conv_id % 2) for r in table(spark, sf_dir, "conversations").collect() if r.conv_id is not None]
    told = paired(brute(*[[r[:4] for r in rows if r[4] == side] for side in (0, 1)]), P.BLOCK)
    text = lambda spans: ",".join(f"{a}:{b}" for a, b in spans)
    got = {tuple(r)[:2]: tuple(r)[2:] for r in registry.op1_preference_pairs(spark, sf_dir).collect()}
    assert got == {k: (*v[:3], text(v[3]), text(v[4])) for k, v in told.items()}


def test_assembled_empty(spark):
    none = spark.createDataFrame([], "pair_id long, turn long, role string, text string")
    assert P.assemble(P.masked_turns(none, none)).collect() == []
