"""Mixing sources to target weights along a curriculum.

A source's target is its share by weight of the words to take; no target passes
``max_epochs`` times the source's size, and what is above goes to the others by
weight until none is above. Inside a source, documents stand in the order of a
hash of their id, and the source's demand runs over that order again and again
until its target is met. Each source has a schedule, a density over training
time that is linear between knots; its integral is the share of the demand met
by then, and inverting it at a copy's place in the demand gives the copy's
training position. Documents are range-sorted by position.

Running totals inside a source are taken in two steps, over hash slices and then
within a slice, so a source that holds a third of all rows is spread out.

Defined cases: null text has size 0; a null source is a source like any other and
comes last; rows that repeat an id each count; with no words at all, targets are 0.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairforge.functions.indexing import dense_index
from pairforge.llm import kernel as K
from pairforge.llm.common import positional, sized, table, written

#: Weights by the source's place in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Density over training time by weight: heavy sources early, light ones late.
CURRICULUM = {5: ((0.0, 1.25), (1.0, 0.75)), 2: ((0.0, 1.0), (1.0, 1.0)), 1: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))}
#: Documents in a hash slice of a source, about.
SLICE_ROWS = 4_000


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in K.slices(whole, "text"):
            _, _, rows = K.spans(*K.flat(batch.column("text")), K.NOT_SPACE)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "tag")), pa.array(np.diff(rows).astype(np.int64))], names=["doc_id", "source", "tag", "size"])


def targets(sources: DataFrame, share: float, weights: Sequence[float], max_epochs: float) -> DataFrame:
    """sources (source, source_size) with place, weight and target; place: of the source in code point order, null last."""
    n = len(weights)
    ranked = dense_index(sources, [F.col("source").asc_nulls_last()], "place").withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % n + 1).cast("int")))
    ranked = written(ranked.withColumn("cap", F.col("source_size") * float(max_epochs)), "sources")
    level, capped = 0.0, -1
    wanted = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share
    while wanted:  # each round caps at least one more source, or ends
        over = F.col("cap") <= F.col("weight") * level
        full, free, now = ranked.agg(F.sum(F.when(over, F.col("cap")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count_if(over)).first()
        if now == capped or not free:
            level = level if free else float("inf")
            break
        level, capped = (wanted - full) / free, now
    return ranked.withColumn("target", F.least(F.col("cap"), F.col("weight") * F.lit(level)) if wanted else F.lit(0.0)).drop("cap")


def inverse_schedule(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time by which the integral of the density through ``knots`` reaches ``share`` of the whole."""
    pieces, total = [], 0.0
    for (t0, d0), (t1, d1) in zip(knots, knots[1:], strict=False):
        pieces.append((t0, t1, d0, d1, total))
        total += (t1 - t0) * (d0 + d1) / 2
    out = None
    for t0, t1, d0, d1, before in reversed(pieces):
        area, slope = share * total - before, (d1 - d0) / (t1 - t0)
        # the root of slope/2 x^2 + d0 x = area in a form that also holds for slope 0
        x = 2 * area / (d0 + F.sqrt(F.greatest(F.lit(0.0), d0 * d0 + 2 * slope * area)))
        here = F.least(F.lit(float(t1)), F.greatest(F.lit(float(t0)), t0 + x))
        out = here if out is None else F.when(share * total < before + (t1 - t0) * (d0 + d1) / 2, here).otherwise(out)
    return out


def mix(
    docs: DataFrame,
    share: float = 1.5,
    weights: Sequence[float] = WEIGHTS,
    max_epochs: float = 2.0,
    curriculum: Mapping[float, Sequence[tuple[float, float]]] = CURRICULUM,
    whole: bool = False,
) -> DataFrame:
    """(doc_id, tag, source, no, of, size, source_size, target, taken, position, …), a row for each document.

    position is that of the first copy (null if none is taken). At the end of a
    source's demand one document is cut so that the target is met exactly; with
    ``whole`` its last copy is taken whole or not at all, whichever is nearer.
    Rows equal in id, source and text (tag) are one unit until the end, so however
    many they are they are one row in a slice; no and of: which of them, and how many.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("tag"), "text")
    sizes = given.mapInArrow(_sized, "doc_id long, source string, tag long, size long")
    units = sizes.groupBy("doc_id", "source", "tag").agg(F.first("size").alias("size"), F.count("*").alias("of")).withColumn("all", F.col("size") * F.col("of"))
    units = written(units.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), "tag")), "units")
    sources = units.groupBy("source").agg(F.sum("all").alias("source_size"), F.count("*").alias("rows"))
    goal = written(targets(sources, share, weights, max_epochs), "targets")
    biggest = goal.agg(F.max("rows")).first()[0] or 0
    bits = max(1, (biggest // SLICE_ROWS).bit_length())
    placed = units.join(goal.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "inner").drop("_source", "rows").withColumn("slice", F.shiftrightunsigned("h", 64 - bits))
    sums = placed.groupBy("place", "slice").agg(F.sum("all").alias("n"))
    before = sums.select("place", "slice", F.coalesce(F.sum("n").over(Window.partitionBy("place").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = Window.partitionBy("place", "slice").orderBy("h", "doc_id", "size", "tag").rowsBetween(Window.unboundedPreceding, -1)
    at = placed.withColumn("at", F.coalesce(F.sum("all").over(inside), F.lit(0))).join(before, ["place", "slice"]).withColumn("at", F.col("at") + F.col("before"))
    each = at.withColumn("no", F.explode(F.sequence(F.lit(1).cast("long"), "of"))).withColumn("at", F.col("at") + (F.col("no") - 1) * F.col("size"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long") - F.col("at")
    part = F.when(rest * 2 >= F.col("size"), F.col("size")).otherwise(0) if whole else F.greatest(F.lit(0), F.least(F.col("size"), rest))
    taken = each.withColumn("epochs", epochs).withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long"))
    position = F.when(F.col("taken") > 0, _position(F.col("at"), curriculum))
    return taken.withColumn("position", position).select("doc_id", "tag", "source", "no", "of", "size", "source_size", "target", "taken", "position", "weight", "at")


def _position(at: Column, curriculum: Mapping[float, Sequence[tuple[float, float]]]) -> Column:
    share = F.least(F.lit(1.0), at / F.col("target"))
    out = share
    for weight, knots in curriculum.items():
        out = F.when(F.col("weight") == float(weight), inverse_schedule(share, knots)).otherwise(out)
    return out


def mixed_documents(docs: DataFrame, curriculum: Mapping[float, Sequence[tuple[float, float]]] = CURRICULUM, **options) -> DataFrame:
    """The columns of ``docs``, a row for each whole copy that the mix takes, range-sorted by training position."""
    plain, name = positional(docs)
    own = ["doc_id", "own_source", "tag"]
    tagged = plain.withColumn("tag", F.xxhash64(name["text"])).withColumn("doc_id", F.col(name["doc_id"]).cast("long")).withColumn("own_source", F.col(name["source"]).cast("string"))
    given = tagged.select("doc_id", F.col("own_source").alias("source"), "tag", F.col(name["text"]).alias("text"))
    plan = written(mix(given, curriculum=curriculum, whole=True, **options).drop("position"), "plan")
    its = [F.col(c).alias(f"its_{c}") for c in ("doc_id", "source", "tag")]
    copies = plan.where("taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("taken") / F.col("size")) - 1).cast("int"))))
    placed = written(copies.select(*its, "of", F.col("no").alias("its_no"), _position(F.col("at") + F.col("copy") * F.col("source_size"), curriculum).alias("position")), "placed")
    on = F.col("doc_id").eqNullSafe(F.col("its_doc_id")) & F.col("own_source").eqNullSafe(F.col("its_source")) & (F.col("tag") == F.col("its_tag"))
    # most rows are the only ones of their id, source and text
    out = tagged.join(sized(placed.where("of = 1"), 120), on).select(*tagged.columns, "position")
    repeated = written(plan.where("of > 1 and no = 1").select(*its), "repeated")
    if not repeated.isEmpty():
        # the others are numbered by the part they were written in, and what the parts before hold: no group meets in one task
        many = written(tagged.join(sized(repeated, 80), on, "left_semi").withColumn("part", F.spark_partition_id()), "many")
        held = many.groupBy("part", *own).agg(F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*own).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        held = written(held.select(*(F.col(c).alias(f"b_{c}") for c in ("part", *own)), before.alias("before")), "held")
        numbered = many.withColumn("row", F.row_number().over(Window.partitionBy("part", *own).orderBy("part")))
        same = F.col("part") == F.col("b_part")
        for c in own:
            same = same & F.col(c).eqNullSafe(F.col(f"b_{c}"))
        numbered = numbered.join(sized(held, 80), same).withColumn("row", F.col("row") + F.col("before"))
        out = out.unionByName(numbered.join(placed.where("of > 1"), on & (F.col("row") == F.col("its_no"))).select(*tagged.columns, "position"))
    ordered = out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
    return ordered.select(*plain.columns).toDF(*docs.columns)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "position")
