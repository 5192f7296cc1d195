"""Mixing sources to target weights along a low-discrepancy schedule. DataFrame functions only.

Golden-ratio points, mapped through the sources' cumulative shares, name the source of each slot.
A slot takes the next block of its source's shuffled documents, all blocks holding as many words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import WORD, checkpointed, row_hash

WEIGHTS = (5, 2, 1)
MOST = 3  # times a source is used at most
BLOCK = 1024  # words in a block
GOLDEN = 0.6180339887498949
CELLS = 4096  # of the unit interval, for finding a point's source by an equi-join
CHUNK = 1 << 16  # slots ranked together


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST) -> DataFrame:
    """One row a source: source, source_no, source_size, weight, target.

    Weights repeat along the sources by code point, null last. The target is the least of
    most x source_size and weight x level, the level being such that targets add up to all words.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, by_cap = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "source_no")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("source_no", F.row_number().over(by_name).cast("long")).withColumn("weight", w)
    per = per.withColumn("cap", (F.col("source_size") * most).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = rest / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return per.select("source", "source_no", "source_size", "weight", F.least("cap", F.col("weight") * F.col("level")).alias("target"))


def lined_up(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Each document's first word on its source's line of shuffled documents, as off.

    Sums run within slices of the shuffle order, then over slices, so that no source is one task's work.
    """
    d = sized.withColumn("turn", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    d = d.join(sources, sized["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    d = d.withColumn("slice", F.substring("turn", 1, 3))
    whole = d.groupBy("source_no", "slice").agg(F.sum("size").alias("words"))
    over = Window.partitionBy("source_no").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("source_no", "slice", F.coalesce(F.sum("words").over(over), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source_no", "slice").orderBy("turn", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("off", F.sum("size").over(within) - F.col("size"))
    return d.join(whole, ["source_no", "slice"]).withColumn("off", F.col("off") + F.col("ahead")).drop("ahead", "slice", "turn")


def slots(sources: DataFrame, block: int) -> DataFrame:
    """source_no, rank (of the source's slots, from 0), slot (place in the mix).

    A source of n blocks gets n slots: its first n points, and where the points of one round are
    fewer, the rest after that round.
    """
    every, upto = Window.partitionBy(), Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    s = sources.select("source_no", F.ceil(F.floor("target") / block).cast("long").alias("blocks")).where("blocks > 0")
    s = s.withColumn("all", F.sum("blocks").over(every)).withColumn("hi", F.sum("blocks").over(upto))
    s = checkpointed(s.select("source_no", "blocks", "all", ((F.col("hi") - F.col("blocks")) / F.col("all")).alias("lo"), (F.col("hi") / F.col("all")).alias("hi")))
    n = s.agg(F.max("all")).first()[0] or 0
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1))
    parts = s.withColumn("cell", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))))
    point = (F.col("id") + 0.5) * GOLDEN
    p = s.sparkSession.range(n).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("u")).withColumn("cell", cell(F.col("u")))
    hit = p.join(parts, "cell").where("u >= lo and u < hi").select("source_no", "blocks", "slot")
    hit = hit.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    sums = hit.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("source_no", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(Window.partitionBy("source_no", "chunk").orderBy("slot")) - 1
    ranked = hit.withColumn("rank", rank).join(ahead, ["source_no", "chunk"]).select("source_no", (F.col("rank") + F.col("ahead")).alias("rank"), "slot", "blocks")
    short = s.join(sums.groupBy("source_no").agg(F.sum("n").alias("n")), "source_no", "left").select("source_no", "blocks", F.coalesce("n", F.lit(0)).alias("n")).where("n < blocks")
    short = short.withColumn("base", F.sum(F.col("blocks") - F.col("n")).over(upto) - (F.col("blocks") - F.col("n")))
    tail = short.withColumn("rank", F.explode(F.expr("sequence(n, blocks - 1)"))).select("source_no", "rank", (F.lit(n) + F.col("base") + F.col("rank") - F.col("n")).alias("slot"))
    return ranked.where("rank < blocks").select("source_no", "rank", "slot").unionByName(tail)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The documents with what the mix takes of them, and the mix itself.

    docs: doc_id long, text string, source string; other columns are ignored.
    First: doc_id, row (row_hash of doc_id, source and text), size, source, source_no, source_size, off, target, taken,
    first_slot (the first slot of the mix that holds words of it, null if none does); a row for each row of docs.
    Second: slot, source_no, off, start (word in the document), words, round; in order of slot it is the mix.

    Null text: size 0. Documents without words are taken 0 times. Null source: a source of its own,
    last in order. Null doc_id: one place in the shuffle, as for any repeated id. Rows that agree in id,
    source and size are interchangeable. Empty input: no rows. Reruns give the same rows.
    """
    sized = checkpointed(docs.select("doc_id", "source", row_hash("doc_id", "source", "text").alias("row"), word_count(F.col("text")).alias("size")))
    sources = checkpointed(source_targets(sized, weights, most))
    line = lined_up(sized, sources, seed)  # its exchanges are reused where it is read again
    r = F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
    pieces = line.where("size > 0").select("source_no", "off", "size", F.floor("target").alias("upto"), "source_size", r.alias("round"))
    pieces = pieces.withColumn("at", F.col("round") * F.col("source_size") + F.col("off")).withColumn("end", F.least(F.col("at") + F.col("size"), "upto")).where("at < end")
    pieces = pieces.withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))))
    first = F.greatest("at", F.col("rank") * block)
    pieces = pieces.select("source_no", "rank", "off", "round", (first - F.col("at")).alias("start"), (F.least("end", (F.col("rank") + 1) * block) - first).alias("words"))
    schedule = pieces.join(slots(sources, block), ["source_no", "rank"]).select("slot", "source_no", "off", "start", "words", "round")
    taken = schedule.groupBy("source_no", "off").agg(F.sum("words").alias("got"), F.min("slot").alias("slot"))
    has = F.col("size") > 0
    got, slot = F.when(has, F.coalesce("got", F.lit(0))).otherwise(F.lit(0)).cast("long"), F.when(has, F.col("slot"))
    out = line.join(taken, ["source_no", "off"], "left")
    return out.select("doc_id", "row", "size", "source", "source_no", "source_size", "off", "target", got.alias("taken"), slot.alias("first_slot")), schedule


def copies(taken: DataFrame, schedule: DataFrame) -> DataFrame:
    """row, slot, off: one for each time that the mix takes a document for the most part, at its place in the mix."""
    whole = schedule.groupBy("source_no", "off", "round").agg(F.sum("words").alias("words"), F.min("slot").alias("slot"))
    placed = taken.where("size > 0").select("row", "size", "source_no", "off").join(whole, ["source_no", "off"])
    return placed.where("words * 2 >= size").select("row", "slot", "off")


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        md5('17:' || COALESCE(doc_id::VARCHAR, 'null')) AS turn FROM documents),
per AS (SELECT source, SUM(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM sized GROUP BY source),
capped AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((no - 1) % 3 + 1)::INT] AS weight, (source_size * 3)::DOUBLE AS cap FROM per),
levels AS (SELECT *, ((SUM(source_size) OVER ())::DOUBLE - COALESCE(SUM(cap) OVER b, 0)) / (SUM(weight) OVER () - COALESCE(SUM(weight) OVER b, 0)) AS level
        FROM capped WINDOW b AS (ORDER BY cap / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, no, source_size, least(cap, weight * MAX(level) OVER ()) AS target FROM levels),
line AS (SELECT d.doc_id, d.size, t.no, t.source_size, t.target, floor(t.target)::BIGINT AS upto,
        (SUM(d.size) OVER (PARTITION BY d.source ORDER BY d.turn, d.doc_id, d.size ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS off
        FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
blocks AS (SELECT no, ceil(floor(target) / 1024)::BIGINT AS n FROM targets WHERE floor(target) >= 1),
bounds AS (SELECT no, n, (SUM(n) OVER ())::DOUBLE AS total, (SUM(n) OVER (ORDER BY no))::DOUBLE AS hi FROM blocks),
points AS (SELECT i AS slot, (i + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE - floor((i + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE) AS u FROM range((SELECT COALESCE(SUM(n), 0)::BIGINT FROM blocks)) t(i)),
hits AS (SELECT b.no, b.n, slot, row_number() OVER (PARTITION BY b.no ORDER BY slot) - 1 AS rank FROM points JOIN bounds b ON u >= (b.hi - b.n) / b.total AND u < b.hi / b.total),
short AS (SELECT no, n, got, total, SUM(n - got) OVER (ORDER BY no) - (n - got) AS base FROM (SELECT b.no, b.n, b.total::BIGINT AS total, COUNT(h.slot) AS got FROM bounds b LEFT JOIN hits h USING (no) GROUP BY ALL) WHERE n > got),
slots AS (SELECT no, rank, slot FROM hits WHERE rank < n UNION ALL SELECT no, rank, (total + base + rank - got)::BIGINT FROM (SELECT *, unnest(range(got, n)) AS rank FROM short))
SELECT l.doc_id, l.size, source_size, target,
        (greatest(0, least(upto, off + size) - off) + greatest(0, least(upto, source_size + off + size) - source_size - off)
        + greatest(0, least(upto, 2 * source_size + off + size) - 2 * source_size - off))::BIGINT AS taken, CASE WHEN size > 0 AND off < upto THEN s.slot END AS first_slot
FROM line l LEFT JOIN slots s ON s.no = l.no AND s.rank = off // 1024
"""
