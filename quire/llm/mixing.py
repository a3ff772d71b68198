"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The words to take are divided into equal blocks. Blocks go to sources by highest quotients
of their targets, and a source's blocks to its shards by highest quotients of their sizes,
so each shard has an integer quota. Within a shard the documents lie in seeded order as a
ring of words cut into blocks; the quota is filled by the blocks from a seeded one on, round
and round. What a document gives is the overlap of its words with the blocks taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.texts import WORD
from quire.runtime import broadcast_if_small, materialize

#: Weights of the sources in order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: No source is taken more than so many times over.
MAX_REPEATS = 3
#: Largest block, in words; blocks are smaller where a source's target is small.
BLOCK = 64
#: The smallest positive target holds at least so many blocks.
BLOCKS_LEAST = 256
#: Documents of a shard, about.
SHARD_ROWS = 1024
SEED = 17


def sizes(docs: DataFrame, carry: bool = False) -> DataFrame:
    """(doc_id, source, size): the words of each document, 0 for null; with carry the row as well."""
    words = F.regexp_count(F.col("text").cast("string"), F.lit(WORD))
    row = [F.struct(*docs.columns).alias("row")] if carry else []
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(words, F.lit(0)).cast("long").alias("size"), *row)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: int = MAX_REPEATS) -> DataFrame:
    """Add weight, target and block to sources (source, source_size), one row each.

    All words times share are divided by weight; a target stops at most times its source's
    size and the excess goes to the others by weight, until none is above. With sources in
    order of the words they can give for each unit of weight, the ones that stop come first,
    and the others share what those leave at one level. One row a source passes through a
    single task.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(names) - 1, F.lit(len(weights))) + 1
    ranked = sources.select("*", F.row_number().over(names).alias("source_no"), F.element_at(F.array(*map(F.lit, weights)), place).cast("double").alias("weight"))
    ranked = ranked.withColumn("most", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("most") / F.col("weight"), "source_no")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / F.sum("weight").over(onward))
    level = F.min_by(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level")), F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("most") / F.col("weight"))).over(everything)
    full = levels.withColumn("target", F.least("most", F.coalesce(level * F.col("weight"), F.col("most"))))
    smallest = F.min(F.when(F.col("target") > 0, F.col("target"))).over(everything)
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.coalesce(smallest, F.lit(1.0)) / BLOCKS_LEAST))).cast("long")
    return full.withColumn("block", block).select("source", "source_no", "source_size", "weight", "target", "block")


def apportion(claims: DataFrame, group: list[str], claim: str, seats: str, tie: str) -> DataFrame:
    """Add quota: seats of each group shared out among its rows by Sainte-Lague's highest quotients.

    claim is a row's size, seats the group's number (equal in all its rows), tie a column that
    orders equal quotients. With n rows in the group, quotients above claim sum / (seats - n/2)
    are sure to win and number at least seats - n, so they are counted by rounding; the few
    others are listed and ranked. The listed rows are at most 3n and a little, whatever the seats.
    """
    by = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    total, n = F.sum(claim).over(by), F.count("*").over(by)
    near = claims.withColumn("_share", F.when(total > 0, F.col(claim) / total).otherwise(0.0)).withColumn("_n", n)
    half = F.col("_n") / 2 + 1
    near = near.withColumn("_sure", F.greatest(F.lit(0), F.floor(F.col("_share") * (F.col(seats) - half) + 0.5)).cast("long"))
    near = near.withColumn("_last", F.floor(F.col("_share") * (F.col(seats) + half) + 0.5).cast("long") + 1)
    near = near.withColumn("_rest", F.col(seats) - F.sum("_sure").over(by))
    listed = near.where(F.col("_share") > 0).select(*group, tie, "_share", "_rest", F.explode(F.sequence(F.col("_sure") + 1, "_last")).alias("_k"))
    ranked = listed.withColumn("_rank", F.row_number().over(by.orderBy((F.col("_share") / (2 * F.col("_k") - 1)).desc(), tie)))
    won = ranked.where(F.col("_rank") <= F.col("_rest")).groupBy(*group, tie).agg(F.count("*").alias("_won"))
    out = near.join(won, [*group, tie], "left").withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0)))
    return out.drop("_share", "_n", "_sure", "_last", "_rest", "_won")


def _key(source: Column) -> Column:
    """A source's name as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document.

    taken counts the words that the mix takes, repeats counted. The same documents and seed
    give the same mix. Null texts have size 0, null sources are one source, ordered last;
    documents of size 0 give nothing; repeated rows count each; null ids are allowed; an empty
    table gives an empty result.
    """
    return _laid(docs, weights, share, seed, False).select("doc_id", "size", "source_size", "target", "taken")


def _laid(docs: DataFrame, weights: tuple[int, ...], share: float, seed: int, carry: bool) -> DataFrame:
    """Documents with what is taken of them; first is the word, from 0, at which a partial copy starts.

    A partial copy runs on from the document's start where it passes its end. With carry each
    document's row moves along with its place in the ring, so texts are shuffled once.
    """
    sized = materialize(sizes(docs).withColumn("key", _key(F.col("source"))))
    sources = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    planned = targets(sources.select("source", "source_size", "key", "docs"), weights, share).withColumn("key", _key(F.col("source")))
    planned = planned.join(sources.select("key", "docs"), "key")
    planned = planned.withColumn("blocks", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / F.col("block")).cast("long"))
    planned = materialize(apportion(planned, [], "target", "blocks", "source_no").withColumnRenamed("quota", "source_quota"))
    shards = F.greatest(F.lit(1), F.ceil(F.col("docs") / SHARD_ROWS)).cast("long")
    lot = F.xxhash64(F.lit(seed), "doc_id", "size")
    plan = planned.select("key", "source_no", "source_size", "target", "block", "source_quota", shards.alias("shards"))
    rows = sizes(docs, carry).withColumn("key", _key(F.col("source"))) if carry else sized
    kept = ["row"] if carry else []
    dealt = rows.join(broadcast_if_small(plan), "key").select(*kept, "doc_id", "size", "source_no", F.pmod(F.xxhash64(F.lit(seed + 1), lot), "shards").alias("shard"), lot.alias("lot"))
    ring = materialize(dealt.groupBy("source_no", "shard").agg(F.sum("size").alias("ring")))
    quotas = ring.join(broadcast_if_small(plan.drop("key", "shards")), "source_no")
    quotas = apportion(quotas, ["source_no"], "ring", "source_quota", "shard")
    take = F.least(F.col("quota") * F.col("block"), F.col("ring") * MAX_REPEATS)
    start = F.pmod(F.xxhash64(F.lit(seed + 2), "source_no", "shard"), F.greatest(F.lit(1), F.floor(F.col("ring") / F.col("block")))) * F.col("block")
    quotas = materialize(quotas.select("source_no", "shard", "source_size", "target", "ring", take.alias("take"), start.alias("start")))
    along = Window.partitionBy("source_no", "shard").orderBy("lot", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = dealt.withColumn("end", F.sum("size").over(along)).join(broadcast_if_small(quotas), ["source_no", "shard"])
    laid = laid.withColumn("begin", F.col("end") - F.col("size"))
    whole, rest = F.floor(F.col("take") / F.greatest("ring", F.lit(1))), F.col("take") % F.greatest("ring", F.lit(1))
    laid = laid.withColumn("whole", whole.cast("long")).withColumn("stop", F.col("start") + rest)
    overlap = lambda a, b: F.greatest(F.lit(0), F.least(F.col("end"), b) - F.greatest(F.col("begin"), a))
    ahead, wrapped = overlap(F.col("start"), F.col("stop")), overlap(F.lit(0), F.col("stop") - F.col("ring"))
    first = F.when(ahead > 0, F.greatest(F.col("start") - F.col("begin"), F.lit(0))).otherwise(0)
    taken = F.col("whole") * F.col("size") + ahead + wrapped
    return laid.select(*kept, "doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), first.cast("int").alias("first"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, seed: int = SEED) -> DataFrame:
    """The documents of the mix, columns as given: whole copies, and the part of a document in the last round.

    A part has its words and the white space between them; n_chars is counted anew.
    """
    laid = _laid(docs, weights, share, seed, True).where("taken > 0")
    words = F.regexp_extract_all(F.col("row.text").cast("string"), F.lit(r"[\x20\x09-\x0D]*+" + WORD), F.lit(0))
    part = (F.col("taken") % F.col("size")).cast("int")
    ahead = F.least(part, F.col("size").cast("int") - F.col("first"))
    joined = lambda start, n: F.ltrim(F.array_join(F.slice("_words", start, n), ""))
    cut = F.concat_ws("\n", joined(F.col("first") + 1, ahead), F.when(part > ahead, joined(F.lit(1), part - ahead)))
    laid = laid.withColumn("_words", F.when(part > 0, words))
    copies = F.array_repeat(F.col("row.text").cast("string"), (F.col("taken") / F.col("size")).cast("int"))
    texts = F.when(part > 0, F.concat(copies, F.array(cut))).otherwise(copies)
    out = laid.select("row", F.explode(texts).alias("_text"))
    new = {"text": F.col("_text")} | ({"n_chars": F.char_length("_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
