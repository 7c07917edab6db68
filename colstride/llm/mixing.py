"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import _shared as S

#: Documents of a hash range of a source, so that one hot source never meets in one task.
RANGE_ROWS = 1_000_000
#: Seed of the order in which documents give the fractional part of their source.
SEED = 17


def cyclic_weights(sizes: DataFrame, source: str = "source") -> DataFrame:
    """Add ``weight``: 1, 2, 3, repeating, over the sources by code point, null last.

    ``sizes`` holds one row per source; only that table is sorted in one place.
    """
    rank = F.row_number().over(W.orderBy(F.col(source).asc_nulls_last()))
    return sizes.withColumn("weight", ((rank - 1) % 3 + 1).cast("double"))


def water_fill(sizes: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """Add ``target`` to rows (source_size, weight): their sum is shared by weight under a cap of
    ``max_epochs`` times a source's size; the excess is reshared by weight until none is above.

    The fixed point is found in one pass: sources fill up in the order of cap / weight, so the
    filled ones are a prefix of that order and the level follows from running sums. A source of
    size 0, or a total of 0, gets target 0. Works on one row per source.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    # Sums of whole sizes and of the weights 1, 2, 3 stay exact in doubles below 2^53.
    w = W.orderBy((F.col("_cap") / F.col("weight")), F.col("_cap"), F.col("weight"))
    everything = W.partitionBy()
    levelled = (
        sizes.withColumn("_cap", cap)
        .withColumn("_total", F.sum(F.col("source_size").cast("double")).over(everything))
        .withColumn("_before", F.coalesce(F.sum("_cap").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(w.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_weights"))
        # The first source that the level doesn't fill ends the prefix of full ones.
        .withColumn("_open", F.col("_cap") >= F.col("_level") * F.col("weight"))
        .withColumn("_final", F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("weight"), "_level"))).over(everything)["_level"])
    )
    target = F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_final") * F.col("weight")))
    return levelled.withColumn("target", target).select(*sizes.columns, "target")


def rank(doc_id: str, size: str, seed: int):
    """The seeded order of documents within their source, as 60 bits of an MD5; ties go by id and size."""
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(size).cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _plan(docs: DataFrame, doc_id: str, source: str, text: str, max_epochs: float, seed: int) -> DataFrame:
    """(doc_id, source, size, rank_, source_size, target, whole, extra), one row per row of ``docs``."""
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), S.word_count(F.col(f"`{text}`")).alias("size"))
    # The sizes, not the texts, are what all later steps read.
    base = S.stored(base.withColumn("rank_", rank("doc_id", "size", seed)), "mix")
    # Ranges of the 60 bits of a rank, 256 of a source at least: as many as keep them to their size.
    bits = min(24, max(8, (base.count() // RANGE_ROWS).bit_length()))
    base = base.withColumn("range_", F.shiftright("rank_", 60 - bits).cast("int"))
    per_range = base.groupBy("source", "range_").agg(F.sum("size").alias("range_size"))
    sizes = per_range.groupBy("source").agg(F.sum("range_size").alias("source_size"))
    targets = water_fill(cyclic_weights(sizes), max_epochs)
    # One row for each range of a source; their running sums give every range its start.
    starts = per_range.withColumn("start", F.coalesce(F.sum("range_size").over(W.partitionBy("source").orderBy("range_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    plan = (
        starts.alias("a").join(targets.alias("t"), F.col("a.source").eqNullSafe(F.col("t.source")))
        .select(F.col("a.source").alias("s_"), F.col("range_").alias("r_"), "start", "source_size", "target",
                F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).alias("whole"))
        .withColumn("part", F.floor("target") - F.col("whole") * F.col("source_size"))
    )
    inside = W.partitionBy("source", "range_").orderBy("rank_", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = base.withColumn("upto", F.sum("size").over(inside))
    joined = placed.join(plan, placed.source.eqNullSafe(plan.s_) & (placed.range_ == plan.r_))
    room = F.col("part") - F.col("start") - F.col("upto") + F.col("size")
    extra = F.greatest(F.lit(0), F.least(F.col("size"), room)).alias("extra")
    return joined.select("doc_id", placed.source, "size", "rank_", "source_size", "target", "whole", extra)


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", max_epochs: float = 3.0, seed: int = SEED) -> DataFrame:
    """How much of each document the mix takes.

    Returns (doc_id, source, size, source_size, target, taken) and nothing else, one row per input
    row: ``size`` words, of which ``taken`` are used, repeats counted. With ratio = target /
    source_size, every document is taken floor(ratio) whole times, and the remaining words of the
    source's target come from its documents in a seeded order, the last of them in part; so a
    source's taken words are its target rounded down. Null text has size 0, null source is a source
    of its own, repeated rows are separate documents (in any order: they are alike), an empty table
    gives an empty result, and further columns of ``docs`` are ignored.
    """
    taken = (F.col("whole") * F.col("size") + F.col("extra")).cast("long").alias("taken")
    return _plan(docs, doc_id, source, text, max_epochs, seed).select("doc_id", "source", "size", "source_size", "target", taken)


def apply_mix(docs: DataFrame, seed: int = SEED, max_epochs: float = 3.0, most_broadcast: int = 100_000) -> DataFrame:
    """The mixed documents with the columns of ``docs``: each whole repetition is a row of its own and
    the fractional one is a row with its first words; documents of which nothing is taken go.

    Needs the columns doc_id, source and text. The plan reaches the texts as one row per source: how many
    whole times, and the document in the seeded order at which the fractional part ends. Rows that are
    alike in id, source and size at that very place all take its part.
    """
    plan = _plan(docs, "doc_id", "source", "text", max_epochs, seed)
    last = F.max(F.when(F.col("extra") > 0, F.struct("rank_", "doc_id", "size", "extra"))).alias("_last")
    cuts = S.stored(plan.groupBy(F.col("source").alias("_source")).agg(F.max("whole").cast("int").alias("_whole"), last), "cuts")
    size, place, source, whole, extra_, last_, cut = (S.fresh(docs, name) for name in ("size", "place", "source", "whole", "extra", "last", "cut"))
    cuts = cuts.select(F.col("_source").alias(source), F.col("_whole").alias(whole), F.col("_last").alias(last_))
    side = F.broadcast(cuts) if cuts.count() <= most_broadcast else cuts
    sized = docs.withColumn(size, S.word_count(F.col("text"))).where(F.col(size) > 0)
    sized = sized.withColumn(place, F.struct(rank("doc_id", size, seed).alias("rank_"), F.col("doc_id"), F.col(size).alias("size")))
    joined = sized.join(side, F.col("source").eqNullSafe(F.col(source)))
    last = F.col(last_)
    end = F.struct(last["rank_"].alias("rank_"), last["doc_id"].alias("doc_id"), last["size"].alias("size"))
    extra = F.when(last.isNull(), 0).when(F.col(place) < end, F.col(size)).when(F.col(place) == end, last["extra"]).otherwise(0)
    joined = joined.withColumn(extra_, extra.cast("int"))
    # -1 stands for a whole repetition, a number for that many first words.
    part = F.when(F.col(extra_) == F.col(size), F.array(F.lit(-1))).when(F.col(extra_) > 0, F.array(extra_)).otherwise(F.array().cast("array<int>"))
    head = F.when(F.col(cut) < 0, F.col("text")).otherwise(F.array_join(F.slice(S.words(F.col("text")), F.lit(1), F.abs(cut)), " "))
    out = joined.withColumn(cut, F.explode(F.concat(F.array_repeat(F.lit(-1), F.col(whole)), part))).withColumn("text", head)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(cut) < 0, F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
