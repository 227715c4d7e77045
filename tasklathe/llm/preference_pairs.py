"""Preference formatting of chosen and rejected conversations.

Method.  The two sides of a pair are aligned by turn number.  The first turn at
which they differ, in role, text or by being absent on one side, ends their
longest common prefix.  That prefix is rendered once, as the prompt; each side's
remaining turns are rendered as its completion, and a mask says which of them are
trained on (assistant turns only).

Turns stay rows: sides are compared by per-turn digests and a minimum per pair,
both partial aggregates, so no conversation is gathered in one task however long
it is.  ``assemble`` joins a pair's turns into one row, prompt and both masked
completions side by side; a pair of very many turns becomes several such rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROMPT, CHOSEN, REJECTED = "prompt", "chosen", "rejected"
#: Turn numbers that one row of ``assemble`` holds.
BLOCK = 256


def masked_turns(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Rendered turns of every pair: ``pair_id``, ``part``, ``turn``, ``role``, ``rendered``, ``trained``.

    Both tables have ``pair_id``, ``turn`` (long), ``role`` and ``text``; other
    columns are left aside, whatever their names.  Texts of any length stay whole,
    each in its row.  ``part`` is prompt, chosen or rejected; the prompt's
    turns come once.  Pairs that lack a side give no rows; equal sides give a
    prompt and no completions.  A null role reads as ``user``, a null text as
    empty, when rendered; they are equal only to nulls.  Turns without a number
    or a pair are left out.  A turn number that a conversation repeats is one
    turn of several messages: it is common if both sides have the same messages,
    repeats counted.  Empty tables give no rows.
    """
    tagged = [side.select("pair_id", "turn", "role", "text", F.lit(k).alias("side")) for k, side in enumerate((chosen, rejected))]
    turns = tagged[0].unionByName(tagged[1]).where("pair_id IS NOT NULL AND turn IS NOT NULL")
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit(""))
    digest = F.xxhash64(mark("role"), mark("text"))
    here = lambda k: F.col("side") == k
    # Messages of a turn as a multiset: their number, and the sum of their digests (decimal, so it can't overflow).
    total = lambda k: F.sum(F.when(here(k), digest.cast("decimal(20,0)")))
    aligned = turns.groupBy("pair_id", "turn").agg(F.count(F.when(here(0), 1)).alias("n0"), F.count(F.when(here(1), 1)).alias("n1"), total(0).alias("d0"), total(1).alias("d1"))
    differ = ~((F.col("n0") == F.col("n1")) & F.col("d0").eqNullSafe(F.col("d1")))
    cut = aligned.groupBy("pair_id").agg(F.min(F.when(differ, F.col("turn"))).alias("cut"), (F.sum("n0") > 0).alias("has0"), (F.sum("n1") > 0).alias("has1")).where("has0 AND has1").select("pair_id", "cut")
    common = F.coalesce(F.col("turn") < F.col("cut"), F.lit(True))
    told = turns.join(cut, "pair_id").where(~common | here(0))
    part = F.when(common, PROMPT).when(here(0), CHOSEN).otherwise(REJECTED)
    role = F.coalesce("role", F.lit("user"))
    rendered = F.concat(F.lit("<|"), role, F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    return told.select("pair_id", part.alias("part"), "turn", role.alias("role"), rendered.alias("rendered"), (~common & (role == "assistant")).alias("trained"))


def assemble(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Paired completions: ``pair_id``, ``segment``, ``prompt``, ``chosen``, ``rejected``, and the spans of trained characters of either completion.

    A segment is the turns whose number divided by ``block`` has one whole part, so
    a pair of fewer turns than that is one row, and a longer one is several, whose
    strings follow each other by segment and which no single task has to hold.
    Spans count code points from the start of the segment's own string, ends
    exclusive.  Turns come by number, messages of one turn by their rendering,
    repeats each for themselves; all messages of one turn number, however long,
    are in one row.  A part without turns is the empty string with no spans;
    other columns are left aside; an empty table gives no rows.
    """
    one = F.struct("turn", "rendered", "trained")
    kept = lambda part: F.array_sort(F.collect_list(F.when(F.col("part") == part, one)))
    segment = F.expr(f"turn div {int(block)}").alias("segment")
    held = turns.groupBy("pair_id", segment).agg(*[kept(p).alias(f"_{p}") for p in (PROMPT, CHOSEN, REJECTED)])
    text = lambda c: F.array_join(F.transform(c, lambda x: x["rendered"]), "")
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["rendered"])).alias("at"),
        F.when(x["trained"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(x["rendered"])).alias("end"))))).otherwise(acc["out"]).alias("out"),
    )
    mask = lambda c: F.aggregate(c, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])
    return held.select("pair_id", "segment", text("_prompt").alias("prompt"), text("_chosen").alias("chosen"), text("_rejected").alias("rejected"), mask("_chosen").alias("chosen_mask"), mask("_rejected").alias("rejected_mask"))


ORACLE = r"""
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), a AS (
  SELECT pair_id, turn, list(coalesce('=' || role, '') || chr(1) || coalesce('=' || text, '') ORDER BY coalesce('=' || role, '') || chr(1) || coalesce('=' || text, '')) FILTER (side = 0) AS c,
    list(coalesce('=' || role, '') || chr(1) || coalesce('=' || text, '') ORDER BY coalesce('=' || role, '') || chr(1) || coalesce('=' || text, '')) FILTER (side = 1) AS r FROM t GROUP BY ALL
), cut AS (
  SELECT pair_id, min(turn) FILTER (c IS DISTINCT FROM r) AS cut FROM a GROUP BY pair_id HAVING count(c) > 0 AND count(r) > 0
), o AS (
  SELECT pair_id, turn // 256 AS segment, CASE WHEN cut IS NULL OR turn < cut THEN 'prompt' WHEN side = 0 THEN 'chosen' ELSE 'rejected' END AS part, turn,
    '<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS rendered,
    (cut IS NOT NULL AND turn >= cut AND coalesce(role, 'user') = 'assistant') AS trained
  FROM t JOIN cut USING (pair_id) WHERE side = 0 OR (cut IS NOT NULL AND turn >= cut)
), s AS (
  SELECT *, sum(length(rendered)) OVER (PARTITION BY pair_id, segment, part ORDER BY turn, rendered, trained ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM o
)
SELECT pair_id, segment, coalesce(string_agg(rendered, '' ORDER BY stop) FILTER (part = 'prompt'), '') AS prompt,
  coalesce(string_agg(rendered, '' ORDER BY stop) FILTER (part = 'chosen'), '') AS chosen,
  coalesce(string_agg(rendered, '' ORDER BY stop) FILTER (part = 'rejected'), '') AS rejected,
  coalesce(string_agg((stop - length(rendered)) || ':' || stop, ',' ORDER BY stop) FILTER (part = 'chosen' AND trained), '') AS chosen_mask,
  coalesce(string_agg((stop - length(rendered)) || ':' || stop, ',' ORDER BY stop) FILTER (part = 'rejected' AND trained), '') AS rejected_mask
FROM s GROUP BY pair_id, segment
"""
