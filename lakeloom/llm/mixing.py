"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes (words) are counted once and cut to the checkpoint folder; equal rows are one row with a count there.
2. Targets are found by water-filling over the table of sources.
3. Each source is dealt by a hash of its rows, many equal ones in lots, into blocks of about
   ``block_words`` words. It is drawn in passes: whole passes over all its
   blocks, then a last pass over a random prefix of the permuted blocks; the
   block at the border gives a prefix of its permuted documents, so that the
   words taken equal the target to the word.
4. The output shards are the leaves of a binary tree. At each node the
   exact number of block draws of every source is split between the two
   halves: all draws of the node are put in random order and the first half
   goes left, which is a multivariate hypergeometric draw of the quotas.
5. Each shard takes its quota from each source's permuted draws, disjoint from
   the other shards', and shuffles its documents locally.

All of it is DataFrame code. Nothing is gathered for a whole source: windows run
over blocks, or over the documents of one block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, clean_text, cut, whole_row

#: A target stops at this many times the source's size.
MAX_EPOCHS = 3


def source_targets(sizes: DataFrame, weights: Column | None = None, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) for a frame of (source, size).

    Default weights are 1, 2, 3, repeating, over the sources in code point
    order, null last; ``weights`` may be an expression of ``source`` and
    ``position`` (from 0). All sizes together are shared by weight; what would
    exceed ``max_epochs`` times a source's size is shared again among the rest.
    One window runs over one row a source.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    named = (
        sizes.groupBy("source")
        .agg(F.sum("size").cast("long").alias("source_size"))
        .withColumn("position", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
        .withColumn("weight", weights if weights is not None else (F.col("position") % 3 + 1).cast("double"))
        .withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    )
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "position")
    levelled = (
        named.withColumn("level", F.row_number().over(by_level))
        .withColumn("capped_before", F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap"))
        .withColumn("weight_left", F.sum("weight").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("all_words", F.sum("source_size").over(everything))
        .withColumn("theta", (F.col("all_words") - F.col("capped_before")) / F.col("weight_left"))
        .withColumn("free", F.col("theta") * F.col("weight") <= F.col("cap"))
    )
    water = F.min(F.when(F.col("free"), F.struct("level", "theta"))).over(everything)["theta"]
    return levelled.withColumn("water", water).select(
        "source", "source_size", F.least(F.col("weight") * F.col("water"), F.col("cap")).alias("target")
    )


def shard_quotas(draws: DataFrame, depth: int, seed: int, n_draws: int = 0, window_rows: int = 1 << 18) -> DataFrame:
    """(source, shard, quota) from (source, draws), by the splitting tree of ``depth`` levels.

    Its rows are block draws. A node of more than about ``window_rows`` of the ``n_draws`` draws is ranked in 64 slices of its random
    order, whose counts are added up first, so that no window holds a whole large node; the ranks are the same.
    """
    tokens = draws.select("source", F.explode(F.sequence(F.lit(1), F.col("draws").cast("int"))).alias("draw"), F.lit(0).alias("node"))
    for level in range(depth):
        tokens = tokens.withColumn("order", F.xxhash64(F.lit(seed), F.lit(level), "source", "draw"))
        if n_draws >> level > window_rows:
            tokens = tokens.withColumn("slice", F.shiftright("order", 58))
            node, along = Window.partitionBy("node"), Window.partitionBy("node").orderBy("slice")
            slices = tokens.groupBy("node", "slice").agg(F.count(F.lit(1)).alias("n")).select(
                "node", "slice", (F.sum("n").over(along) - F.col("n")).alias("before"), F.sum("n").over(node).alias("all")
            )
            inside = Window.partitionBy("node", "slice").orderBy("order", "source", "draw")
            tokens = tokens.withColumn("rank", F.row_number().over(inside)).join(slices, ["node", "slice"]).withColumn("rank", F.col("rank") + F.col("before"))
        else:
            here = Window.partitionBy("node")
            tokens = tokens.withColumn("rank", F.row_number().over(here.orderBy("order", "source", "draw"))).withColumn("all", F.count(F.lit(1)).over(here))
        left = F.col("rank") * 2 <= F.col("all") + 1
        tokens = tokens.select("source", "draw", (F.col("node") * 2 + F.when(left, 0).otherwise(1)).alias("node"))
    return tokens.groupBy("source", F.col("node").alias("shard")).agg(F.count(F.lit(1)).alias("quota"))


def _row_key(docs: DataFrame, text_col: str) -> list[Column]:
    """What tells the rows of one id apart: 128 bits of the text, 64 of all columns. Rows that agree in it are equal."""
    every = [F.col(f"`{c}`") for c in docs.columns]
    return [F.md5(clean_text(text_col)).alias("_md5"), F.xxhash64(*every, *[c.isNull() for c in every]).alias("_rest")]


#: What deals a lot to its block and its place there.
_LOT = ("_id", "_md5", "_rest", "lot")


def lots(classes: DataFrame, block_words: int) -> DataFrame:
    """Classes of equal rows (``size`` words, ``copies`` of them) in lots of ``n`` copies, numbered ``lot``: each a small part of a block, so that copies spread over the blocks of their source."""
    most = F.greatest(F.lit(1), F.least(F.lit(4096), F.expr(f"{max(1, block_words // 16)} div greatest(size, 1)")))
    many = classes.withColumn("_most", most).withColumn("lot", F.explode(F.expr("sequence(0, (copies - 1) div _most)")))
    return many.withColumn("n", F.least(F.col("_most"), F.col("copies") - F.col("lot") * F.col("_most"))).drop("_most", "copies")


def block_of(seed: int) -> Column:
    """The block of a lot among the ``blocks`` of its source."""
    return F.pmod(F.xxhash64(F.lit(seed), *_LOT), F.col("blocks")).cast("int")


def _plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int | None = None, seed: int = 17, weights: Column | None = None, block_words: int = 1 << 16, max_blocks: int = 1 << 20, shard_words: int = 1 << 22, max_shards: int = 1 << 16) -> tuple[DataFrame, int]:
    """See :func:`mix_plan`; also the number of shards."""
    if shards is not None and shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    words = F.regexp_count(clean_text(text_col), F.lit(WORD)).cast("long")
    rows = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("source"), words.alias("size"), *_row_key(docs, text_col))
    sizes = cut(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")))
    sources = cut(
        source_targets(sizes.select("source", (F.col("size") * F.col("copies")).alias("size")), weights)
        .withColumn("words", F.round("target").cast("long"))
        .withColumn("passes", F.when(F.col("source_size") > 0, F.expr("words div source_size")).otherwise(0).cast("int"))
        .withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
    )
    total = sources.agg(F.sum("source_size")).head()[0] or 0
    if shards is None:
        shards = min(1 << max(0, (total // shard_words).bit_length()), max_shards)
    depth = shards.bit_length() - 1
    block_words = max(block_words, total // max_blocks)
    sources = sources.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("int"))
    dealt = lots(sizes, block_words).join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = dealt.withColumn("block", block_of(seed))
    permuted = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "source", "block"), "block")
    blocks = (
        dealt.groupBy("source", "block")
        .agg(F.sum(F.col("size") * F.col("n")).alias("block_words"), F.first("passes").alias("passes"), F.first("rest").alias("rest"))
        .withColumn("place", F.row_number().over(permuted) - 1)
        .withColumn("before", F.sum("block_words").over(permuted.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("block_words"))
        .withColumn("extra", F.greatest(F.lit(0), F.least(F.col("block_words"), F.col("rest") - F.col("before"))))
        .withColumn("n_draws", F.col("passes") + F.when(F.col("extra") > 0, 1).otherwise(0))
    )
    blocks = cut(blocks.select("source", "block", "block_words", "place", "passes", "extra", "n_draws"))
    # A source's draws are numbered pass by pass, in a new order in each pass.
    in_order = Window.partitionBy("source").orderBy("pass", F.when(F.col("pass") < F.col("passes"), F.xxhash64(F.lit(seed + 2), "pass", "source", "block")).otherwise(F.col("place")), "block")
    draws = (
        blocks.filter("n_draws > 0")
        .withColumn("pass", F.explode(F.expr("sequence(0, n_draws - 1)")))
        .withColumn("number", F.row_number().over(in_order))
    )
    per_source = blocks.groupBy("source").agg(F.sum("n_draws").alias("draws")).filter("draws > 0")
    along = Window.partitionBy("source").orderBy("shard")
    ranges = shard_quotas(per_source, depth, seed + 3, n_draws=total // block_words).withColumn("last", F.sum("quota").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ranges = ranges.select(F.col("source").alias("_source"), "shard", (F.col("last") - F.col("quota")).alias("first"), "last")
    placed = draws.join(ranges, F.col("source").eqNullSafe(F.col("_source")) & (F.col("number") > F.col("first")) & (F.col("number") <= F.col("last")))
    # At most MAX_EPOCHS + 1 draws a block.
    placed = placed.groupBy(F.col("source").alias("_source"), F.col("block").alias("_block")).agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("_draws"))
    kept = blocks.select("source", "block", "block_words", "extra").join(placed, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")), "left")
    kept = kept.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "block_words", "extra", "_draws")
    in_block = Window.partitionBy("source", "block").orderBy(F.xxhash64(F.lit(seed + 4), *_LOT), "_id", "size", "_md5", "_rest", "lot")
    whole = dealt.join(kept, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    weight = F.col("size") * F.col("n")
    whole = whole.withColumn("_before", F.sum(weight).over(in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - weight)
    # A lot's copies follow each other.
    whole = whole.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("_before", F.col("_before") + F.col("_copy") * F.col("size"))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - F.col("_before")))
    of_draw = F.transform(
        F.coalesce("_draws", F.array().cast("array<struct<pass:int,shard:int>>")),
        lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.when(d["pass"] < F.col("passes"), F.col("size")).otherwise(last).alias("words")),
    )
    return whole.select(
        F.col("_id").alias(id_col), "source", "size", "source_size", "target",
        (F.col("passes") * F.col("size") + last).alias("taken"),
        F.filter(of_draw, lambda d: d["words"] > 0).alias("draws"), "_md5", "_rest",
    ), shards


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """What the mix takes of every row of ``docs``.

    Returns id, ``source``, ``size`` (words; null text: 0), ``source_size``,
    ``target`` (its source's), ``taken`` (words, repeats counted) and
    ``draws``, an array of (pass, shard, words). ``shards`` is a power of two; by default
    there are as many as make a shard about ``shard_words`` words, ``max_shards`` at most; beyond that shards grow. Blocks have ``block_words`` words,
    more where they would number over ``max_blocks``: that bounds the tree, whatever the size of the corpus.
    Null is a source of its own, the last. Empty documents are taken 0 words,
    a source of only empty ones has target 0. Equal rows are mixed as separate
    rows; which of them a border cuts is left open, the rest depends on ids and
    sizes alone, so reruns agree. An empty table gives no rows.
    """
    return _plan(docs, id_col, text_col, source_col, **options)[0].drop("_md5", "_rest")


def cut_words(text: Column, words: Column) -> Column:
    """The first ``words`` words of ``text`` with the white space around them."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), words), "")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int | None = None, seed: int = 17, **options) -> DataFrame:
    """The mixed corpus: the columns of ``docs``, a row for each time that the mix takes a document.

    A document at a border is cut to the words taken from it. The rows
    lie in one partition a shard, in random order; what the writer makes of it is a file a shard. Draws find
    their rows by id, text and all other columns; equal rows are one row there, that all their draws take.
    """
    plan, shards = _plan(docs, id_col, text_col, source_col, shards, seed, **options)
    draws = plan.select(F.col(id_col).alias("_mix_id"), F.col("_md5").alias("_mix_md5"), F.col("_rest").alias("_mix_rest"), F.col("size").alias("_mix_size"), F.explode("draws").alias("_mix_draw"))
    whole = F.col("_row")[text_col]
    text = F.when(F.col("_mix_draw")["words"] < F.col("_mix_size"), cut_words(whole, F.col("_mix_draw")["words"].cast("int"))).otherwise(whole)
    rows = docs.select(whole_row(docs), *_row_key(docs, text_col)).groupBy("_md5", "_rest").agg(F.first("_row").alias("_row"))
    out = rows.join(draws, (F.col("_md5") == F.col("_mix_md5")) & (F.col("_rest") == F.col("_mix_rest")))
    order = F.xxhash64(F.lit(seed + 5), F.col("_mix_draw"), F.col("_mix_id"))
    return (
        out.withColumns({"_mix_text": text, "_mix_order": order, "_mix_shard": F.col("_mix_draw")["shard"]})
        .repartitionById(shards, F.col("_mix_shard"))
        .sortWithinPartitions("_mix_shard", "_mix_order")
        .select(*[F.col("_mix_text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
    )
