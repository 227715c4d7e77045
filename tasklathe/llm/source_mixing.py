"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Method.  Source i gets its weight's share of the whole mix, but no more than
``most`` times its own size; what is over is shared among the others by weight
until no source is above its limit.  That is water filling, and has a closed
form: sources are ordered by limit over weight, and those whose limit is below
the running level are full.

Within a source, every document draws an exponential key -ln(u) / quality with a
reproducible uniform u, and documents are taken in key order.  Complete epochs
come first (every document once each); the rest of the target is a prefix of the
key order, the document at its end being taken in part.

The prefix ends at one document of each source, its edge.  That is found by
narrowing, as in a radix select: a source's keys fall into cells, the cells' sums
are prefix-summed, and only the rows of the cell that holds the edge go on, with
cells of their own, until they are few.  Nothing else is sorted or moved: a
document compares its key with its source's edge, so texts stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sparkio import durable, release

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
#: Cells of a source's keys in each turn, and rows of a cell that are looked through one by one.
CELLS, FEW = 4096, 1000
#: Sources whose edges may be broadcast; with more of them the edges are joined as they come.
BROADCAST_SOURCES = 10_000


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality(size: Column) -> Column:
    """Documents of 200 words or more draw with weight 1, shorter ones with less, 0.25 at least."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.25), size / F.lit(200.0)))


def targets(sources: DataFrame) -> DataFrame:
    """``source``, ``source_size`` -> also ``target``.  A source is one row; their number is small beside the rows'."""
    everything = Window.partitionBy()
    listed = Window.orderBy(F.col("source").isNull(), F.col("source"))
    cycle = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(listed) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    limits = sources.withColumn("weight", cycle.cast("double")).withColumn("limit", (F.col("source_size") * MOST).cast("double"))
    by_level = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * SHARE - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = limits.withColumn("level", level).withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    first = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)  # levels fall from the first that isn't full
    return levels.select("source", "source_size", F.when(F.col("full"), F.col("limit")).otherwise(first * F.col("weight")).alias("target"))


def draw_key(doc_id: Column, weight: Column) -> Column:
    """The exponential key of a document: -ln(u) / weight, u from a digest of its id."""
    digest = F.substring(F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(SEED)).cast("binary")), 1, 13)
    u = (F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def _beside(rows: DataFrame, by_source: DataFrame, sources: int, on: Column) -> DataFrame:
    """``rows`` with what is known of their source, which is broadcast where sources are few."""
    return rows.join(F.broadcast(by_source) if sources <= BROADCAST_SOURCES else by_source, on)


def _edges(rows: DataFrame, goal: DataFrame, sources: int) -> DataFrame:
    """``source`` and its edge: key, id and size (``e_key``, ``e_id``, ``e_size``), the words before it, and how many rows are alike there.

    rows: ``source``, ``id``, ``size``, ``key``.  The edge is the row at which a source's words in key order pass ``rest``.
    """
    near = F.exp(-F.col("key"))  # falls as keys grow, and tells large ones apart
    now = _beside(rows.withColumn("near", near), goal.select(F.col("source").alias("s"), F.col("rest").cast("double").alias("left")), sources, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    now, held = now.withColumns({"lo": F.lit(0.0), "hi": F.lit(1.0)}), None
    while True:
        wide = F.col("hi") - F.col("lo")
        celled = now.withColumn("cell", F.when(wide > 0, F.least(F.lit(CELLS - 1), F.floor((F.col("hi") - F.col("near")) / wide * CELLS).cast("int"))).otherwise(0))
        sums = celled.groupBy("source", "cell").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"), F.min("near").alias("lo"), F.max("near").alias("hi"), F.max("left").alias("left"))
        ahead = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        left = F.col("left") - F.coalesce(F.sum("words").over(ahead), F.lit(0))
        edge = durable(sums.withColumn("left", left).where("left >= 0 AND left < words").select(F.col("source").alias("s"), F.col("cell").alias("c"), "rows", "lo", "hi", "left"))
        most = edge.agg(F.max(F.when(F.col("hi") > F.col("lo"), F.col("rows")))).first()[0]
        inside = celled.select("source", "id", "size", "key", "near", "cell")
        now = durable(_beside(inside, edge, sources, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c"))).select("source", "id", "size", "key", "near", "lo", "hi", "left"))
        release(edge, *[held] * (held is not None))
        held = now
        if (most or 0) <= FEW:
            break
    alike = now.groupBy("source", F.col("key").alias("e_key"), F.col("id").alias("e_id"), F.col("size").alias("e_size")).agg(F.count(F.lit(1)).alias("e_rows"), F.max("left").alias("left"))
    ahead = Window.partitionBy("source").orderBy("e_key", "e_id", "e_size").rowsBetween(Window.unboundedPreceding, -1)
    alike = alike.withColumn("left", F.col("left") - F.coalesce(F.sum(F.col("e_size") * F.col("e_rows")).over(ahead), F.lit(0)))
    found = durable(alike.where("left >= 0 AND left < e_size * e_rows"))
    release(now)
    return found


def mix(docs: DataFrame, size: Column, weight: Column) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``taken`` and ``copies``.

    docs has ``doc_id`` and ``source`` (null is a source of its own, after the
    others).  size is a document's words; weight its positive draw weight; both
    are evaluated twice a row, on whole texts however long.  ``taken`` counts the
    words that the mix takes, repeats included: whole epochs of the size, plus the
    part of the last prefix.  ``copies`` rounds that to whole documents, half a
    document and more being one.  A document of size 0 takes no words and has a
    copy for each complete epoch of its source, none if the source has no words at
    all.  Repeated ids share a draw, as all null ids do; among them smaller sizes
    come first, and of rows alike in id and size those with the smaller digest of
    all columns.  Columns with an output's name, and those whose names begin
    with ``__mix``, are replaced or dropped.  An empty table gives an empty result.
    """
    out = ("size", "source_size", "target", "taken", "copies")
    kept = [c for c in docs.columns if c not in out and not c.startswith("__mix")]
    keyed = docs.select(*kept, size.cast("long").alias("__mix_size"), weight.alias("__mix_weight")).withColumn("__mix_key", draw_key(F.col("doc_id"), F.col("__mix_weight"))).drop("__mix_weight")
    rows = durable(keyed.select("source", F.col("doc_id").alias("id"), F.col("__mix_size").alias("size"), F.col("__mix_key").alias("key")))
    by_source = durable(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = by_source.count()
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = durable(targets(by_source).withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")))
    edges = _edges(rows, goal, sources)
    tied = not edges.where("e_rows > 1").isEmpty()
    edge = edges.withColumnRenamed("source", "s")
    known = goal.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    plan = durable(known.select(*[F.col(c).alias(f"__mix_{c}") for c in ("source", "source_size", "target", "epochs", "rest", "e_key", "e_id", "e_size", "e_rows", "left")]))
    release(rows, by_source, goal, edges)
    m = {c: F.col(f"__mix_{c}") for c in ("size", "key", "source", "source_size", "target", "epochs", "rest", "e_key", "e_id", "e_size", "left")}
    placed = _beside(keyed, plan, sources, F.col("source").eqNullSafe(m["source"]))
    same = (m["key"] == m["e_key"]) & F.col("doc_id").eqNullSafe(m["e_id"])
    at_edge = F.coalesce(same & (m["size"] == m["e_size"]), F.lit(False))
    before = (m["key"] < m["e_key"]) | (same & (m["size"] < m["e_size"])) | ((m["key"] == m["e_key"]) & ~same & (F.col("doc_id").isNull() | (F.col("doc_id") < m["e_id"])))
    before = F.coalesce(before, m["rest"] >= m["source_size"])  # without an edge all is taken, or nothing
    placed = placed.withColumn("__mix_rank", F.lit(0).cast("long"))
    if tied:
        alike = Window.partitionBy("source").orderBy(F.xxhash64(*kept))
        ranked = placed.where(at_edge).withColumn("__mix_rank", F.row_number().over(alike).cast("long") - 1)
        placed = placed.where(~at_edge).unionByName(ranked)
    edge_part = F.greatest(F.lit(0), F.least(m["size"], m["left"].cast("long") - F.col("__mix_rank") * m["size"]))
    part = F.when(at_edge, edge_part).when(before, m["size"]).otherwise(0)
    taken = (m["epochs"] * m["size"] + part).cast("long").alias("taken")
    told = placed.select(*kept, m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), taken, m["epochs"].alias("__mix_epochs"))
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.col("__mix_epochs")).cast("int").alias("copies")
    return told.select(*kept, *out[:-1], copies)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), k AS (
  SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix-1'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / least(1.0::DOUBLE, greatest(0.25::DOUBLE, size / 200.0::DOUBLE)) AS k FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
    (source_size * 2)::DOUBLE AS most FROM s
), l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM w WINDOW b AS (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, CASE WHEN most <= level * weight THEN most
    ELSE (SELECT max(level) FROM l WHERE NOT (most <= level * weight)) * weight END AS target FROM l
), p AS (
  SELECT doc_id, source, size, (coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before FROM k
), e AS (
  SELECT p.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS epochs
  FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - before)))::BIGINT AS taken FROM e
"""
