"""Document fingerprints by a homomorphic multiset hash.

A text is the multiset of its paragraphs: what lies between line breaks and, in a line, between sentence ends. Each is
hashed into a wide vector, and a document's fingerprint is the sum of the vectors, lane by lane modulo a power of two.
So the order of paragraphs doesn't matter, and a paragraph is inserted or deleted by adding or subtracting its vector.

The vector has two parts: 4 lanes of 62 random bits, for equality, and 128 lanes of one random bit, summed
with two lanes of 30 bits in a long. With the number of paragraphs n, a one-bit lane with sum c is the sum 2 c - n of
random signs, and the products of two documents' signed lanes estimate how many paragraphs they share: likeness is the
cosine of the two vectors, 1 for equal multisets and about 0 for disjoint ones, within about 0.09 (one deviation).

Defined results: null counts as empty; texts without paragraphs have the zero fingerprint, 1 like each other and 0
like others; an empty table gives an empty table. Lanes don't wrap: a text, at most 2 ** 31 bytes, has fewer than
2 ** 30 paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampType

from citemill.llm.common import bounded, read_table, text_or_empty, written

PARAGRAPH_END = r"[\r\n]+|(?<=[.!?]) +"
WIDE_LANES = 4
WIDE_MASK = (1 << 62) - 1
#: Two lanes of 30 bits in a long, each with two bits above for carries; 32 shifts of two hash words give 64 longs.
LANE_MASK = 0x3FFFFFFF3FFFFFFF
LANE_BITS = 30
ONE_BITS = 0x0000000100000001
WORDS, SHIFTS = 2, 32
PACKED = WORDS * SHIFTS
#: Paragraphs that four lanes of 16 bits in a long hold without its sign; the lowest bits of the four, and the first and third of them.
PART = (1 << 15) - 1
NARROW_ONES, NARROW_MASK = 0x0001000100010001, 0x0000FFFF0000FFFF
LANES = PACKED * 2
#: Documents that one task takes next to each other at a time, about, in MAX_RUNS runs at most (with more documents the runs
#: grow); a range of ids is cut where it has over RUN_LIMIT times as many. DEPTH: cuts of cuts.
RUN_ROWS = 1_000
MAX_RUNS = 1 << 20
RUN_LIMIT = 4
DEPTH = 8


# The expressions have some 200 terms, so they are written as SQL: one call instead of one for each term.


def paragraphs(column: str) -> str:
    return f"filter(split({column}, r'{PARAGRAPH_END}'), p -> trim(p) <> '')"


def _struct(n: str, wide: list[str], packed: list[str]) -> str:
    return "named_struct(" + ", ".join([f"'n', {n}", *(f"'w{i}', {x}" for i, x in enumerate(wide)), *(f"'s{i}', {x}" for i, x in enumerate(packed))]) + ")"


def multiset_sum(column: str) -> Column:
    """The vector of a text column's paragraphs: struct n (their number), w0..w3 (wide lanes), s0..s63 (packed lanes).

    Paragraphs are first summed in parts that four lanes of 16 bits in a long can hold, which halves the terms."""
    hashes = ", ".join(f"'h{i}', xxhash64(p, {i})" for i in range(WIDE_LANES))
    hashed = f"transform({paragraphs(column)}, p -> named_struct({hashes}))"
    wide = [f"(a.w{i} + (h.h{i} & {WIDE_MASK}L)) & {WIDE_MASK}L" for i in range(WIDE_LANES)]
    half = SHIFTS // 2
    narrow = [f"a.s{j} + (shiftrightunsigned(h.h{j // half}, {j % half}) & {NARROW_ONES}L)" for j in range(PACKED // 2)]
    part = f"aggregate(slice(all_, i + 1, {PART}), {_struct('0', ['0L'] * WIDE_LANES, ['0L'] * (PACKED // 2))}, (a, h) -> {_struct('a.n + 1', wide, narrow)})"
    parts = f"transform(sequence(0, greatest(size(all_) - 1, 0), {PART}), i -> {part})"
    added = [f"(a.w{i} + b.w{i}) & {WIDE_MASK}L" for i in range(WIDE_LANES)]
    # Lane i % 32 of a word stands in the long of its lower 16 bits' shift, in its first or its second half.
    packed = [f"a.s{i} + (shiftrightunsigned(b.s{i // SHIFTS * half + i % half}, {i % SHIFTS // half * half}) & {NARROW_MASK}L)" for i in range(PACKED)]
    whole = f"aggregate({parts}, {_struct('0', ['0L'] * WIDE_LANES, ['0L'] * PACKED)}, (a, b) -> {_struct('a.n + b.n', added, packed)})"
    return F.expr(f"element_at(transform(array({hashed}), all_ -> {whole}), 1)")


def combine(a: str, b: str, sign: int = 1) -> Column:
    """The vector of both columns' multisets together or, with sign -1, of a without b."""
    part = lambda name, top, mask: f"({a}.{name} + {f'{b}.{name}' if sign > 0 else f'({top}L - {b}.{name})'}) & {mask}L"
    wide = [part(f"w{i}", WIDE_MASK + 1, WIDE_MASK) for i in range(WIDE_LANES)]
    packed = [part(f"s{i}", LANE_MASK + ONE_BITS, LANE_MASK) for i in range(PACKED)]
    return F.expr(_struct(f"{a}.n + {sign} * {b}.n", wide, packed))


def _listed(v: str, packed_only: bool = False) -> str:
    names = [] if packed_only else [f"{v}.w{i}" for i in range(WIDE_LANES)]
    return f"array({', '.join([*names, *(f'{v}.s{i}' for i in range(PACKED))])})"


def as_string(v: str) -> Column:
    """The fingerprint: number of paragraphs, wide lanes and packed lanes in hexadecimal digits."""
    return F.expr(f"concat(lpad(hex({v}.n), 8, '0'), array_join(transform({_listed(v)}, x -> lpad(hex(x), 16, '0')), ''))")


def lanes(v: str) -> Column:
    """The signed one-bit lanes of a vector column: array of 2 c - n."""
    mask = (1 << LANE_BITS) - 1
    two = ", ".join(f"(shiftright(s, {32 * j}) & {mask}L) * 2 - {v}.n" for j in range(2))
    return F.expr(f"flatten(transform({_listed(v, True)}, s -> array({two})))")


def likeness(a: str, b: str, lanes_a: str, lanes_b: str) -> Column:
    """0 to 1, from two vector columns and the columns of their lanes."""
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> cast(p * q as double)), 0d, (s, p) -> s + p)"
    same = " and ".join(f"{a}.{c} = {b}.{c}" for c in ["n", *(f"w{i}" for i in range(WIDE_LANES))])
    cosine = f"try_divide({dot(lanes_a, lanes_b)}, sqrt({dot(lanes_a, lanes_a)} * {dot(lanes_b, lanes_b)}))"
    return F.expr(f"case when {same} then 1d when {a}.n = 0 or {b}.n = 0 then 0d else coalesce(greatest(0d, least(1d, {cosine})), 0d) end")


def _places(rows: DataFrame) -> list[Column]:
    """Numbers whose order, one after the other, is that of rows (doc_id, text): of the id, or of six bytes of it at a time,
    and of the text's hash."""
    kind = rows.schema["doc_id"].dataType
    if isinstance(kind, StringType):
        part = lambda n: F.conv(F.rpad(F.hex(F.substring(F.col("doc_id").cast("binary"), 6 * n + 1, 6)), 12, "0"), 16, 10).cast("double")
        ids = [part(n) for n in range(4)]
    elif isinstance(kind, (NumericType, BooleanType)):
        ids = [F.col("doc_id").cast("double")]
    elif isinstance(kind, (DateType, TimestampType)):
        ids = [F.col("doc_id").cast("timestamp").cast("double")]
    else:
        raise TypeError(f"ids of type {kind.simpleString()} have no order of runs")
    return [*ids, F.xxhash64("text").cast("double")]


def with_runs(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) with run: ranges of the order by id, then by the text's hash, of about RUN_ROWS rows.

    The range of ids is cut into equal parts, whose rows are counted exactly. Parts with too many rows are cut again, by
    the id or, where it is one id, by the next number of _places; and so on. A run is what lies between two multiples
    of its size in these counts, so it may hold many small parts, and never more than RUN_LIMIT + 1 sizes unless rows are
    alike. The tables of parts have MAX_RUNS rows at most, for the whole table together, so they are broadcast.
    """
    places = _places(rows)
    low, high, count = rows.agg(F.min(places[0]), F.max(places[0]), F.count("*")).first()
    size = max(RUN_ROWS, -(-count // MAX_RUNS))
    # A node is a part: before, the rows ahead of it, names it. Its rows are cut into parts at low + n * width by places[level].
    top = F.when(places[0].isNull(), F.lit(1)).otherwise(F.lit(0))
    at = rows.withColumns({"before": F.lit(-1).cast("long"), "level": F.lit(0), "low": F.lit(float(low or 0)), "width": F.lit(max(float(high or 0) - float(low or 0), 0.0)), "parts": F.lit(max(1, -(-count // size)))})
    for depth in range(DEPTH):
        place = F.lit(None).cast("double")
        for n, value in enumerate(places):
            place = F.when(F.col("level") == n, value).otherwise(place)
        share = F.when(F.col("width") > 0, (place - F.col("low")) / F.col("width")).otherwise(F.lit(0.0))
        part = F.least(F.col("parts") - 1, F.greatest(F.lit(0), F.floor(share * F.col("parts")))).cast("int")
        part = F.when(F.col("level").isNull(), F.lit(None)).when(top == 1, F.col("parts")).otherwise(part) if not depth else F.when(F.col("level").isNotNull(), part)
        here = at.withColumns({"parent": F.col("before"), "part": part})
        bounds = [f(v).alias(f"{name}{n}") for n, v in enumerate(places if depth else places[:-1]) for name, f in (("low", F.min), ("high", F.max))]
        one_id = F.min("doc_id").eqNullSafe(F.max("doc_id")).alias("one_id")
        counts = here.filter("part is not null").groupBy("parent", "part").agg(F.count("*").alias("rows"), one_id, *bounds)
        order = Window.partitionBy("parent").orderBy("part")
        counts = counts.withColumn("before", F.greatest("parent", F.lit(0)) + F.sum("rows").over(order) - F.col("rows"))
        crowded, cut = F.col("rows") > RUN_LIMIT * size, F.lit(None).cast("struct<level:int,low:double,width:double>")
        for n in reversed(range(len(bounds) // 2)):
            wide = (F.col(f"high{n}") > F.col(f"low{n}")) & (F.lit(n < len(places) - 1) | F.col("one_id"))
            cut = F.when(wide, F.struct(F.lit(n).alias("level"), F.col(f"low{n}").alias("low"), (F.col(f"high{n}") - F.col(f"low{n}")).alias("width"))).otherwise(cut)
        if not depth:  # the text's hash isn't read where ids alone do
            by_hash = F.struct(F.lit(len(places) - 1).alias("level"), F.lit(-(2.0**63)).alias("low"), F.lit(2.0**64).alias("width"))
            cut = F.coalesce(cut, F.when(F.col("one_id"), by_hash))
        nodes = counts.select("parent", "part", "before", F.when(crowded, cut).alias("cut"), F.ceil(F.col("rows") / size).cast("int").alias("parts"))
        nodes = written(nodes.select("parent", "part", "before", "cut.*", "parts"), "parts")
        kept = [c for c in at.columns if c not in ("before", "level", "low", "width", "parts")]
        joined = here.select(*kept, "parent", "part").join(bounded(nodes, 2 * MAX_RUNS), ["parent", "part"], "left")
        at = joined.select(*kept, F.coalesce("before", "parent").alias("before"), "level", "low", "width", "parts")
        if nodes.filter("level is not null").isEmpty():
            break
    return at.select(*rows.columns, F.floor(F.col("before") / size).cast("int").alias("run"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, vector, next_text, next_vector: each document beside the next by ascending id, the last beside
    the first. Ids that are null come last; rows with one id are ordered by a hash of the text.

    Ranges of ids meet in one exchange of the texts; the first row of each range is also sent to the range before.
    """
    rows = with_runs(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("hash"))
    firsts = rows.groupBy("run").agg(F.min(place).alias("first"))
    order, everything = Window.orderBy("run"), Window.orderBy("run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("run", "first", F.coalesce(F.lag("run").over(order), F.last("run").over(everything)).alias("earlier"))
    firsts = written(firsts.coalesce(1), "runs")  # MAX_RUNS rows and one at most
    beside = rows.join(F.broadcast(firsts), "run")
    own = F.struct("run", F.lit(False).alias("extra"))
    extra = F.when(place.eqNullSafe(F.col("first")), F.struct(F.col("earlier").alias("run"), F.lit(True).alias("extra")))
    dealt = beside.select("doc_id", "text", F.explode(F.array_compact(F.array(own, extra))).alias("place")).select("doc_id", "text", "place.*").repartition("run")
    summed = dealt.withColumn("vector", multiset_sum("text"))
    order = Window.partitionBy("run").orderBy("extra", F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    next_row = F.lead(F.struct("text", "vector")).over(order)
    return summed.withColumn("next", next_row).filter(~F.col("extra")).select("doc_id", "text", "vector", F.col("next.text").alias("next_text"), F.col("next.vector").alias("next_vector"))


def op7_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(read_table(spark, sf_dir, "documents"))
    n = F.length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", n.alias("n_chars"), "vector", "next_vector", edited.alias("edited"))
    rows = rows.withColumn("edited_vector", multiset_sum("edited"))
    rows = rows.select("*", *[lanes(v).alias(f"{v}_lanes") for v in ("vector", "edited_vector", "next_vector")])
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_string("vector").alias("fingerprint"),
        as_string("edited_vector").alias("edited_fingerprint"),
        likeness("vector", "edited_vector", "vector_lanes", "edited_vector_lanes").alias("near_edited"),
        likeness("vector", "next_vector", "vector_lanes", "next_vector_lanes").alias("near_next"),
    )
