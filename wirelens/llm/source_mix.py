"""Mixing sources to target weights.

Each source's words are laid end to end in a pseudorandom document order and packed into blocks of BLOCK words.
The mix is a run of slots of one block each, dealt into output shards. Every slot draws a source with the target
weights, so each shard's source counts are multinomial; the counts are then tied to the targets: a source takes
its first quota draws, and the draws beyond are dealt to the sources that fell short. The k-th slot of a source
with n blocks takes block P(k mod n) of pass k div n, where P is a pseudorandom permutation of the source's block
numbers, one for each pass. Blocks are joined by (source, number), and a document's share of the blocks that
were taken is what the mix takes from it.

Sources are weighed 1, 2, 3, repeating, by code point, null last. A target is the source's share of all words,
at most CAP times its own words; the excess goes to the others by weight.

Only doc_id, source and a word count leave the scan; texts don't move. Offsets come from sums over buckets, so
that a source which holds a third of all rows is spread over many tasks. Everything is DataFrame functions, and
all draws are hashes of row values: reruns agree.

Edge cases: a null text has size 0, and a document of size 0 is taken 0 times; a source without words has target 0.
Fully repeated rows take neighbouring places. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Work, read_table, word_count

BLOCK = 128
SHARD_SLOTS = 1024
CAP = 3
#: Rows of one bucket of documents, about.
BUCKET_ROWS = 2_000
#: Cells of a line on which points look for their stretch.
LINE_CELLS = 4096
#: Rounds of a permutation.
ROUNDS = 8
#: Slots that one task takes through the permutation, about.
TASK_SLOTS = 20_000


def number(*parts):
    """A pseudorandom bigint from 0 to 2^60 - 1, made of the text of its parts (the same in any SQL engine)."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("~")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, cap: int = CAP) -> DataFrame:
    """source, source_size, weight, sno (its number) and target, from source, source_size: one row a source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = sizes.withColumn("sno", F.row_number().over(by_name)).withColumn("weight", ((F.col("sno") - 1) % 3 + 1).cast("long"))
    # Sources fill up in the order of cap / weight. A source is full if its cap is at most what the rest, which isn't full yet, gets.
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "sno")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    wide = "decimal(19,0)"
    everything = Window.partitionBy()
    filled = (
        n.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("room", F.col("total") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("open", F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", (cap * F.col("source_size")).cast(wide) * F.col("open").cast(wide) <= F.col("room").cast(wide) * F.col("weight").cast(wide))
    )
    level = F.min(F.when(~F.col("full"), F.struct((F.col("source_size") / F.col("weight")).alias("a"), "sno", "room", "open"))).over(everything)
    return filled.withColumn("level", level).select(
        "source",
        "source_size",
        "weight",
        "sno",
        F.when(F.col("full"), (cap * F.col("source_size")).cast("double"))
        .otherwise(F.col("weight") * F.col("level.room").cast("double") / F.col("level.open"))
        .alias("target"),
    )


def quotas(goals: DataFrame, block: int = BLOCK, cap: int = CAP) -> DataFrame:
    """goals with blocks (a source's blocks), quota (slots that it gets) and upto, low (ends of its stretch of all slots)."""
    blocks = F.ceil(F.col("source_size") / block)
    # Blocks hold source_size / blocks words on average; the last one may be short.
    fit = F.round(F.col("target") * F.col("blocks") / F.greatest(F.col("source_size"), F.lit(1)))
    q = goals.withColumn("blocks", blocks.cast("long")).withColumn("quota", F.least(fit.cast("long"), cap * F.col("blocks")))
    running = Window.orderBy("sno").rowsBetween(Window.unboundedPreceding, 0)
    return q.withColumn("upto", F.sum("quota").over(running)).withColumn("low", F.col("upto") - F.col("quota"))


def on_line(points: DataFrame, at: str, stretches: DataFrame, low: str, upto: str, length: int) -> DataFrame:
    """points joined with the one stretch [low, upto) that holds their `at`, by an equi-join on cells of the line."""
    cell = max(1, length // LINE_CELLS)
    cells = stretches.where(F.col(upto) > F.col(low)).withColumn(
        "__cell", F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor((F.col(upto) - 1) / cell)))
    )
    return (
        points.withColumn("__cell", F.floor(F.col(at) / cell))
        .join(cells, "__cell")
        .where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(upto)))
        .drop("__cell")
    )


def drawn_slots(plan: DataFrame, slots: int, work: Work, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """slot, sno, k: every slot's source, and its rank among the source's slots, which is below the source's quota."""
    spark = work.spark
    points = spark.range(slots).select(
        F.col("id").alias("slot"),
        F.floor(F.col("id") / shard_slots).alias("shard"),
        F.pmod(number(F.lit("draw"), F.col("id")), F.lit(slots)).alias("point"),
    )
    drawn = work.save(on_line(points, "point", plan.select("sno", "low", "upto"), "low", "upto", slots).select("slot", "shard", "sno"), "draws")
    counts = drawn.groupBy("sno", "shard").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("sno").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("sno", "shard", F.coalesce(earlier, F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "sno").orderBy("slot")) - 1
    ranked = drawn.withColumn("rank", rank).join(starts, ["sno", "shard"]).select("slot", "sno", (F.col("start") + F.col("rank")).alias("k"))
    # What a source drew beyond its quota is dealt, in order, to the sources that drew too little.
    totals = counts.groupBy("sno").agg(F.sum("n").alias("drawn"))
    running = Window.orderBy("sno").rowsBetween(Window.unboundedPreceding, 0)
    balance = (
        plan.select("sno", "quota")
        .join(totals, "sno", "left")
        .withColumn("drawn", F.coalesce("drawn", F.lit(0)))
        .withColumn("over", F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)))
        .withColumn("under", F.greatest(F.col("quota") - F.col("drawn"), F.lit(0)))
        .withColumn("over_low", F.sum("over").over(running) - F.col("over"))
        .withColumn("under_upto", F.sum("under").over(running))
        .withColumn("under_low", F.col("under_upto") - F.col("under"))
    )
    placed = ranked.join(balance.select("sno", "quota", "over_low"), "sno")
    stay = placed.where("k < quota").select("slot", "sno", "k")
    spare = placed.where("k >= quota").select("slot", (F.col("over_low") + F.col("k") - F.col("quota")).alias("j"))
    needy = balance.select("sno", "drawn", "under_low", "under_upto")
    moved = on_line(spare, "j", needy, "under_low", "under_upto", slots).select(
        "slot", "sno", (F.col("drawn") + F.col("j") - F.col("under_low")).alias("k")
    )
    return stay.unionByName(moved)


def permuted(sno: str, turn: str, n: str, i: str, rounds: int = ROUNDS) -> str:
    """SQL for the place of i in a pseudorandom permutation of 0 .. n - 1 (swap-or-not rounds, a bijection for any n)."""
    draw = "cast(conv(substring(md5(concat_ws('|', {})), 1, 15), 16, 10) as bigint)".format
    key = draw(f"'key', {sno}, {turn}, r")
    bit = draw(f"'bit', {sno}, {turn}, r, greatest(x, y)")
    swap = f"element_at(transform(array(pmod({key} - x, {n})), y -> CASE WHEN pmod({bit}, 2) = 1 THEN y ELSE x END), 1)"
    return f"aggregate(sequence(1, {rounds}), cast({i} as bigint), (x, r) -> {swap})"


def taken_blocks(plan: DataFrame, slots: DataFrame, n: int) -> DataFrame:
    """sno, block, times, of n slots; they are spread anew, as the permutation costs more than it reads."""
    spread = slots.repartition(n // TASK_SLOTS + 1, "slot")
    placed = spread.join(plan.where("blocks > 0").select("sno", "blocks"), "sno").select(
        "sno", "blocks", F.floor(F.col("k") / F.col("blocks")).alias("turn"), F.pmod("k", "blocks").alias("i")
    )
    picked = placed.select("sno", F.expr(permuted("sno", "turn", "blocks", "i")).alias("block"))
    return picked.groupBy("sno", "block").agg(F.count(F.lit(1)).alias("times"))


def word_offsets(sized: DataFrame, rows: int) -> DataFrame:
    """sized (doc_id, sno, size) with off: the words of the source before the document, in a pseudorandom order."""
    buckets = max(1, -(-rows // BUCKET_ROWS))
    keyed = sized.withColumn("h", number(F.lit("order"), F.col("doc_id"))).withColumn("bucket", F.pmod(F.col("h"), F.lit(buckets)))
    sums = keyed.groupBy("sno", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("sno").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("sno", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sno", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    return (
        keyed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(base, ["sno", "bucket"])
        .select("doc_id", "sno", "size", (F.col("base") + F.col("inner")).alias("off"))
    )


def mix(docs: DataFrame, work: Work, block: int = BLOCK, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of docs (doc_id, source, text)."""
    sized = work.save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    plan = work.save(quotas(targets(sizes, cap), block, cap), "plan")
    totals = plan.agg(F.sum("quota")).first()  # one number
    slots = totals[0] or 0
    rows = sized.count()
    same = F.col("z.source").eqNullSafe(F.col("p.source"))
    named = sized.alias("z").join(plan.alias("p"), same).select("doc_id", "sno", "size")
    placed = work.save(word_offsets(named, rows), "offsets")
    full = placed.where("size > 0")
    parts = full.withColumn("block", F.explode(F.sequence(F.floor(F.col("off") / block), F.floor((F.col("off") + F.col("size") - 1) / block))))
    overlap = F.least(F.col("off") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("off"), F.col("block") * block)
    times = taken_blocks(plan, drawn_slots(plan, slots, work), slots)
    # An offset is one document's only, as sizes are at least 1 here.
    taken = (
        parts.withColumn("words", overlap)
        .join(times, ["sno", "block"], "left")
        .groupBy("sno", "off", "doc_id", "size")
        .agg(F.sum(F.col("words") * F.coalesce("times", F.lit(0))).alias("taken"))
    )
    every = taken.select("doc_id", "sno", "size", "taken").unionByName(
        placed.where("size = 0").select("doc_id", "sno", "size", F.lit(0).cast("long").alias("taken"))
    )
    return every.join(plan.select("sno", "source", "source_size", "target"), "sno").select(
        "doc_id", "size", "source_size", "target", "taken", "source"
    )


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"), Work(spark))


def _rounds_sql() -> str:
    """The rounds of the permutation, one CTE each: p0 has x, every next one the swapped x."""
    draw = "('0x' || substr(md5({}), 1, 15))::BIGINT".format
    parts = []
    for r in range(1, ROUNDS + 1):
        key = draw(f"'key|' || sno || '|' || turn || '|{r}'")
        bit = draw(f"'bit|' || sno || '|' || turn || '|{r}|' || greatest(x, y)")
        parts.append(
            f"q{r} AS MATERIALIZED (SELECT *, (({key} - x) % blocks + blocks) % blocks AS y FROM p{r - 1}), "
            f"p{r} AS MATERIALIZED (SELECT sno, blocks, turn, CASE WHEN {bit} % 2 = 1 THEN y ELSE x END AS x FROM q{r})"
        )
    return ",\n".join(parts)


#: The same mix in plain SQL, each round of the permutation once; a slot's rank among its source's slots is taken over all slots at once.
ORACLE = rf"""
WITH z AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM z GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sno, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
f AS (SELECT *, sum(source_size) OVER () - {CAP} * coalesce(sum(source_size) OVER b, 0) AS room, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS open
      FROM n WINDOW b AS (ORDER BY source_size / weight::DOUBLE, sno ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT *, {CAP} * source_size::HUGEINT * open <= room::HUGEINT * weight AS is_full FROM f),
v AS (SELECT first(room ORDER BY source_size / weight::DOUBLE, sno) AS room, first(open ORDER BY source_size / weight::DOUBLE, sno) AS open FROM g WHERE NOT is_full),
t AS (SELECT g.source, source_size, sno, CASE WHEN is_full THEN ({CAP} * source_size)::DOUBLE ELSE weight * v.room::DOUBLE / v.open END AS target, ceil(source_size / {BLOCK}.0)::BIGINT AS blocks FROM g LEFT JOIN v ON true),
u AS (SELECT *, least(round(target * blocks / greatest(source_size, 1))::BIGINT, {CAP} * blocks) AS quota FROM t),
plan AS (SELECT *, sum(quota) OVER (ORDER BY sno) AS upto, sum(quota) OVER (ORDER BY sno) - quota AS low FROM u),
w AS (SELECT sum(quota)::BIGINT AS n FROM plan),
d AS (SELECT slot, ('0x' || substr(md5('draw|' || slot), 1, 15))::BIGINT % n AS point FROM w, (SELECT unnest(range(0, (SELECT n FROM w))) AS slot)),
r AS (SELECT slot, sno, row_number() OVER (PARTITION BY sno ORDER BY slot) - 1 AS k FROM d JOIN plan ON point >= low AND point < upto),
c AS (SELECT sno, count(*) AS drawn FROM r GROUP BY sno),
b AS (SELECT plan.sno, quota, blocks, coalesce(drawn, 0) AS drawn, greatest(coalesce(drawn, 0) - quota, 0) AS over, greatest(quota - coalesce(drawn, 0), 0) AS under FROM plan LEFT JOIN c ON plan.sno = c.sno),
a AS (SELECT *, sum(over) OVER (ORDER BY sno) - over AS over_low, sum(under) OVER (ORDER BY sno) AS under_upto, sum(under) OVER (ORDER BY sno) - under AS under_low FROM b),
e AS (SELECT r.sno, k, quota, over_low + k - quota AS j FROM r JOIN a ON r.sno = a.sno),
o AS (SELECT sno, k FROM e WHERE k < quota UNION ALL SELECT a.sno, a.drawn + e.j - a.under_low FROM e JOIN a ON e.k >= e.quota AND e.j >= a.under_low AND e.j < a.under_upto),
p0 AS MATERIALIZED (SELECT o.sno, blocks, (k // blocks)::BIGINT AS turn, (k % blocks)::BIGINT AS x FROM o JOIN a ON o.sno = a.sno),
{_rounds_sql()},
m AS (SELECT sno, x AS block, count(*) AS times FROM p{ROUNDS} GROUP BY 1, 2),
h AS (SELECT z.doc_id, sno, size, ('0x' || substr(md5('order|' || coalesce(z.doc_id::VARCHAR, '~')), 1, 15))::BIGINT AS h FROM z JOIN plan ON z.source IS NOT DISTINCT FROM plan.source),
x AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY sno ORDER BY h % greatest(1, ceil((SELECT count(*) FROM z) / {BUCKET_ROWS}.0)::BIGINT), h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM h),
i AS (SELECT *, unnest(range(off // {BLOCK}, (off + size - 1) // {BLOCK} + 1)) AS block FROM x WHERE size > 0),
k AS (SELECT i.sno, i.off, i.doc_id, sum((least(off + size, (i.block + 1) * {BLOCK}) - greatest(off, i.block * {BLOCK})) * coalesce(times, 0)) AS taken FROM i LEFT JOIN m ON i.sno = m.sno AND i.block = m.block GROUP BY ALL)
SELECT x.doc_id, x.size, source_size, target, coalesce(k.taken, 0)::BIGINT AS taken, plan.source
FROM x JOIN plan ON x.sno = plan.sno LEFT JOIN k ON x.sno = k.sno AND x.off = k.off AND x.doc_id IS NOT DISTINCT FROM k.doc_id AND x.size > 0
"""
