"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's target is a number of equal blocks of its words, at least SOURCE_BLOCKS unless it has fewer words. The quotas
of blocks stand at the root of a binary tree; at every node half of the blocks, drawn without replacement from all sources
together, go to the left child, so that the counts by source follow the multivariate hypergeometric law, until each leaf is
an output shard. A source's documents are permuted by a hash; its blocks are runs of that order, and shards take disjoint
runs of blocks, going through the source again when the target is larger than the source. Blocks only deal copies to
shards: which documents are taken, and how often, follows from the words before each. Of the last document just the words
are taken that the target still lacks, so a source, however small, takes its target to the word. drawn() gives the
copies by shard, each shard shuffled by another hash.

Targets: sources in code point order, null last, weigh 5, 2, 1, repeating, and share all words; a target stops at
MAX_REPEATS times the source's size and what is over is shared again by weight, until none is above.

Defined results: a text without words (or null) has size 0 and is never taken; rows without id are permuted by their texts;
rows that repeat id and text are separate documents, next to each other in the permutation; a table without words has
targets 0; columns other than id, text and source are not read. Reruns agree: hashes and draws depend on SEED and the
rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citemill.llm.common import SPACE, read_table, word_count, written

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
OUTPUT_SHARDS = 16
#: Blocks in all targets together, about: a block has total words / BLOCKS, but a source has SOURCE_BLOCKS at least. So the
#: tree's work is the same for tables of all sizes.
BLOCKS = 1 << 16
SOURCE_BLOCKS = 1 << 10
#: Documents of a source whose prefix sums one task forms at a time, about.
RANGE_ROWS = 2000
#: Rows of a drawn shard that one task sorts, about.
LOT_ROWS = 20_000
#: The most partitions into which the lots of all shards are dealt; with more lots a task writes several.
MOST_PARTS = 4096
#: A row's key is hot when more than RANGE_ROWS and 1/HOT_PARTS of all rows have it; so there are HOT_PARTS hot keys at most.
HOT_PARTS = 1000
#: Ranges that the rows of a hot key are dealt to.
SALTS = 256
SEED = 7


def permutation_key(id_col: Column, text_col: Column) -> Column:
    """32 hexadecimal digits that order documents at random."""
    return F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(id_col.cast("string"), F.lit("")), F.xxhash64(text_col)).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size -> also target, words (the target in whole words, 1 at least unless the source is empty),
    block_words, the words of a block, and quota, the blocks that hold the target's words.

    Weights fill all sources at one level until a source reaches its limit; ordered by limit over weight, the level at
    each source follows from what the full sources before it hold.
    """
    by_source = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.row_number().over(by_source) - 1, F.lit(len(weights))) + 1)
    ranked = sizes.withColumn("weight", weight.cast("double")).withColumn("limit", (F.col("source_size") * max_repeats).cast("double"))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "weight", "source")
    before, after = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    everything = by_limit.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = ranked.withColumn("total", total).withColumn("level", left / F.sum("weight").over(after))
    level = level.withColumn("open", F.col("limit") > F.col("level") * F.col("weight"))
    # The first source that isn't full sets the level of all after it.
    common = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(everything)
    target = F.least(F.col("limit"), F.coalesce(common, F.lit(0.0)) * F.col("weight"))
    wanted = F.least(F.greatest(F.lit(1), F.round("target").cast("long")), F.col("source_size") * max_repeats)
    words = F.greatest(F.lit(1), F.least(F.ceil(F.col("total") / BLOCKS), F.floor(F.col("words") / SOURCE_BLOCKS))).cast("long")
    quota = F.ceil(F.col("words") / F.col("block_words")).cast("int")
    out = level.withColumn("target", target).withColumn("words", wanted).withColumn("block_words", words).withColumn("quota", quota)
    return out.select("source", "source_size", "target", "words", "block_words", "quota")


def split_quotas(quotas: DataFrame, shards: int = OUTPUT_SHARDS) -> DataFrame:
    """source and starts: for each shard the number of the first of its source's blocks, then the quota's end.

    quotas has one row per source. The tree's nodes are rows with the array of their quotas by source; a node is split
    by drawing each of its blocks with the chance (still needed) / (blocks left).
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "quota")))
    nodes = quotas.agg(listed.alias("listed")).select(F.lit(0).alias("first"), F.lit(shards).alias("width"), F.transform("listed", lambda x: x["quota"]).alias("counts"))
    for level in range((shards - 1).bit_length()):
        left_width = F.floor((F.col("width") + 1) / 2).cast("int")
        size = F.aggregate("counts", F.lit(0), lambda a, x: a + x)
        nodes = nodes.withColumn("left_width", left_width).withColumn("size", size)
        need = F.floor(F.col("size") * F.col("left_width") / F.col("width")).cast("int")
        begin = F.struct(need.alias("need"), F.col("size").alias("rest"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

        def draw(acc: Column, count: Column) -> Column:
            # chance in (0, 1) of each block, from the node, the source and the block
            def one(taken: Column, j: Column) -> Column:
                chance = F.pmod(F.xxhash64(F.lit(SEED), F.lit(level), F.col("first"), acc["n"], j), F.lit(1 << 30)) / float(1 << 30)
                return taken + F.when(chance * (acc["rest"] - j + 1) < acc["need"] - taken, 1).otherwise(0)

            blocks = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
            taken = F.aggregate(blocks, F.lit(0), one)
            return F.struct((acc["need"] - taken).alias("need"), (acc["rest"] - count).alias("rest"), (acc["n"] + 1).alias("n"), F.array_append(acc["out"], taken).alias("out"))

        nodes = nodes.withColumn("left", F.aggregate("counts", begin, draw)["out"])
        left = F.struct(F.col("first"), F.col("left_width").alias("width"), F.col("left").alias("counts"))
        right = F.struct((F.col("first") + F.col("left_width")).alias("first"), (F.col("width") - F.col("left_width")).alias("width"), F.zip_with("counts", "left", lambda x, y: x - y).alias("counts"))
        both = F.when(F.col("width") > 1, F.array(left, right)).otherwise(F.array(F.struct(F.col("first"), F.col("width"), F.col("counts"))))
        nodes = nodes.select(F.explode(both).alias("node")).select("node.*")
    counts = nodes.select("first", F.posexplode("counts").alias("n", "count")).groupBy("n").agg(F.array_sort(F.collect_list(F.struct("first", "count"))).alias("by_shard"))
    starts = F.aggregate("by_shard", F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + x["count"]))
    names = quotas.agg(listed.alias("listed")).select(F.posexplode("listed").alias("n", "entry")).select("n", F.col("entry.source").alias("source"))
    return names.join(counts.select("n", starts.alias("starts")), "n").select("source", "starts")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


#: Prefix of the columns that mix() adds or needs; columns of documents keep their names.
OWN = "_mix_"


def _marked(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """docs with size, source, key and range (a stretch of the source's permutation), under own names."""
    digits = max(1, min(6, (max(1, docs.count() // RANGE_ROWS)).bit_length() // 4 + 1))
    marked = docs.withColumns({f"{OWN}size": word_count(F.col(text_col)), f"{OWN}source": _source_key(F.col(source_col)), f"{OWN}key": permutation_key(F.col(id_col), F.col(text_col))})
    return marked.withColumn(f"{OWN}range", F.substring(f"{OWN}key", 1, digits))


def _counted(marked: DataFrame) -> DataFrame:
    """source, range, words and rows: the ranges of each source."""
    short = marked.select(*[F.col(f"{OWN}{c}").alias(c) for c in ("source", "range", "size")])
    return written(short.groupBy("source", "range").agg(F.sum("size").alias("words"), F.count("*").alias("rows")), "ranges")


def _spread(marked: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """marked and its ranges, with the rows of hot keys, which are all alike, dealt to ranges of their own behind the one
    that they were in. These rows are written, so that the numbers by which they are dealt stay."""
    most, total = ranges.agg(F.max("rows"), F.sum("rows")).first()
    if (most or 0) <= 4 * RANGE_ROWS:
        return marked, ranges
    keys = marked.groupBy(f"{OWN}key").agg(F.count("*").alias(f"{OWN}rows")).filter(F.col(f"{OWN}rows") > max(RANGE_ROWS, total // HOT_PARTS)).select(f"{OWN}key")
    keys = F.broadcast(written(keys, "hot-keys"))
    salt = F.lpad(F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("string"), 3, "0")
    hot = marked.join(keys, f"{OWN}key").withColumn(f"{OWN}range", F.concat_ws("~", f"{OWN}range", f"{OWN}key", salt)).select(*marked.columns)
    spread = marked.join(keys, f"{OWN}key", "left_anti").select(*marked.columns).unionByName(written(hot, "hot-rows"))
    return spread, _counted(spread)


def _plan(ranges: DataFrame, shards: int, weights: tuple[int, ...], max_repeats: int) -> tuple[DataFrame, DataFrame]:
    """The sources (source, source_size, target, words, block_words, quota, starts), and the words before each range, all
    columns under own names. The list of sources has the size of a configuration: one row for each."""
    names = F.when(F.col("source") == "", F.lit(None)).otherwise(F.substring("source", 2, 1 << 30))
    sizes = ranges.groupBy("source").agg(F.sum("words").alias("source_size")).withColumn("source", names)
    quotas = written(targets(sizes, weights, max_repeats).coalesce(1), "quotas")
    tree = written(split_quotas(quotas, shards).withColumnRenamed("source", "name").coalesce(1), "tree")
    sources = quotas.join(tree, F.col("source").eqNullSafe(F.col("name"))).drop("name").withColumn("source", _source_key(F.col("source")))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    prefix = ranges.select("source", "range", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    named = [t.select(*[F.col(c).alias(f"{OWN}{c}") for c in t.columns]) for t in (sources, prefix)]
    return written(named[0], "sources"), written(named[1], "prefixes")


def mix(docs: DataFrame, shards: int = OUTPUT_SHARDS, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, with all columns, and _mix_size, _mix_source_size, _mix_target, _mix_times (0 to max_repeats
    copies taken), _mix_shards (the output shard of each copy) and _mix_words (the words taken of each copy)."""
    own = lambda c: F.col(f"{OWN}{c}")
    rows = _marked(docs, id_col, text_col, source_col)
    rows, ranges = _spread(rows, _counted(rows))
    sources, prefix = _plan(ranges, shards, weights, max_repeats)
    inside = Window.partitionBy(f"{OWN}source", f"{OWN}range").orderBy(f"{OWN}key", id_col, F.xxhash64(text_col)).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(f"{OWN}inside", F.coalesce(F.sum(f"{OWN}size").over(inside), F.lit(0)))
    rows = rows.join(prefix, [f"{OWN}source", f"{OWN}range"]).join(sources, f"{OWN}source")
    # Copy c of a document begins c * source_size words after its first; it is taken if that is before the target's end.
    rows = rows.withColumn(f"{OWN}place", own("before") + own("inside"))
    times = F.when(own("size") > 0, F.ceil(F.try_divide(own("words") - own("place"), own("source_size"))).cast("int"))
    rows = rows.withColumn(f"{OWN}times", F.greatest(F.lit(0), F.coalesce(times, F.lit(0))))
    numbers = F.when(own("times") > 0, F.sequence(F.lit(0), own("times") - 1)).otherwise(F.array().cast("array<int>"))
    begin = lambda c: own("place") + c * own("source_size")
    shard_of = F.transform(numbers, lambda c: F.size(F.filter(own("starts"), lambda s: s <= F.floor(begin(c) / own("block_words")))) - 1)
    words = F.transform(numbers, lambda c: F.least(own("size"), own("words") - begin(c)))
    rows = rows.withColumns({f"{OWN}shards": shard_of, f"{OWN}taken": words}).drop(f"{OWN}words").withColumnRenamed(f"{OWN}taken", f"{OWN}words")
    return rows.select(*docs.columns, *[f"{OWN}{c}" for c in ("size", "source_size", "target", "times", "shards", "words")])


def first_words(text: Column, n: Column) -> Column:
    """The first n words of a text with the white space between them."""
    pieces = F.regexp_extract_all(text, F.lit(f"[^{SPACE}]+[{SPACE}]*"), F.lit(0))
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def drawn(docs: DataFrame, shards: int = OUTPUT_SHARDS, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with the columns of docs and _mix_shard, by shards and
    within a shard in random order. Of a source's last document the text holds just the words that are taken."""
    own = lambda c: F.col(f"{OWN}{c}")
    rows = mix(docs, shards, id_col=id_col, text_col=text_col, **options)
    copies = rows.select("*", F.posexplode(F.arrays_zip(F.col(f"{OWN}shards").alias("shard"), F.col(f"{OWN}words").alias("words"))).alias(f"{OWN}copy", f"{OWN}of"))
    cut = F.when(own("of")["words"] < own("size"), first_words(F.col(text_col), own("of")["words"])).otherwise(F.col(text_col))
    copies = copies.withColumns({f"{OWN}shard": own("of")["shard"], f"{OWN}position": F.xxhash64(F.lit(SEED), own("of")["shard"], own("copy"), id_col, text_col), text_col: cut})
    # A lot is a stretch of a shard's positions, so lots sorted one by one are the shard in its order.
    lots = max(1, -(-docs.count() // (shards * LOT_ROWS)))
    lot = F.floor((F.shiftright(own("position"), 32) + (1 << 31)) * lots / float(1 << 32)).cast("int")
    dealt = copies.withColumn(f"{OWN}lot", lot).repartition(min(shards * lots, MOST_PARTS), f"{OWN}shard", f"{OWN}lot")
    return dealt.sortWithinPartitions(f"{OWN}shard", f"{OWN}position").select(*docs.columns, f"{OWN}shard")


def op9_mixing_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = mix(docs)
    taken = F.aggregate("_mix_words", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), taken.alias("taken"), F.col("_mix_times").alias("times"), F.array_join("_mix_shards", ",").alias("shards"))
