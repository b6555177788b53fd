"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots of equally many words. Slot t takes the golden-ratio point
``frac((t + 1) * phi)`` through the cumulated targets to a source, and the slot's rank among
the slots of its source says which block of that source it holds: every source's documents
are shuffled onto a line of words, the line is cut into blocks, and a source that is used up
starts anew, MAX_EPOCHS times at most. A source takes what its slots hold, which is its target
but for the points' discrepancy of a few slots. Ranks are counted in stretches of slots, so a
source with most of the slots is not one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metaquarry.llm.common import WORD, query, stored, table
from metaquarry.llm.prefix_sums import digest, lay_out

#: The mix has this many slots for each document with words, and at least LEAST_SLOTS where it
#: has as many words; a slot's words follow from that.
DOCUMENT_SLOTS, LEAST_SLOTS = 8, 65_536
#: Slots whose ranks are counted together.
SLOT_STRETCH = 65_536
#: Most times that a source, and so a document, is taken.
MAX_EPOCHS = 3
GOLDEN = 0.6180339887498949


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, weight, target) for ``sizes``, one row (source, source_size) each.

    Sources in code point order, null last, take the weights in turn and share the sum of
    all sizes by them. A target stops at MAX_EPOCHS times the source's size; what is over goes
    to the others by weight. Sorted by size per weight, the sources that stop are the first
    ones, so running sums find them all at once.
    """
    everything = Window.partitionBy()
    numbered = sizes.withColumn(
        "weight",
        F.element_at(
            F.array(*map(F.lit, weights)),
            (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1,
        ),
    )
    upto = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    after = upto.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    capped = F.coalesce(F.sum(F.col("source_size") * MAX_EPOCHS).over(before), F.lit(0))
    left = numbered.withColumns(
        {
            "free": F.sum("source_size").over(everything) - capped,
            "open": F.sum("weight").over(after),
            "cap": F.col("source_size") * MAX_EPOCHS,
        }
    ).withColumn("stops", F.col("free") * F.col("weight") > F.col("cap") * F.col("open"))
    # the first source that does not stop sets the level for itself and all after it
    level = F.first(F.when(~F.col("stops"), F.struct("free", "open")), ignorenulls=True).over(
        upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    target = F.when(level.isNull(), F.col("cap").cast("double")).otherwise(
        level["free"].cast("double") * F.col("weight") / level["open"]
    )
    return left.select("source", "source_size", "weight", target.alias("target"))


def slot_words(words: int, docs: int) -> int:
    """Words of a slot, for a mix of so many words made of so many documents."""
    return max(1, -(-words // max(DOCUMENT_SLOTS * docs, LEAST_SLOTS)))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """(line, rank, slot): the slots of the mix; ``line`` is a struct of the source, and ``rank``
    numbers the slots of a source from 0.

    ``targets`` has source and quota, in words. The mix has as many slots of ``block`` words as
    hold all quotas. The points alone say which source a slot belongs to.
    """
    spark = targets.sparkSession
    upto = Window.orderBy(F.col("source").asc_nulls_last())
    sources = targets.filter("quota > 0").withColumn("high", F.sum("quota").over(upto))
    low = F.col("high") - F.col("quota")
    sources = stored(sources.select(F.struct("source").alias("line"), low.alias("low"), "high"), "shares")
    total = sources.agg(F.max("high")).first()[0] or 0
    points = spark.range(-(-total // block)).select(
        F.col("id").alias("slot"),
        F.floor((((F.col("id") + 1) * F.lit(GOLDEN)) % 1.0) * total).cast("long").alias("point"),
    )
    # a point's source: the cumulated shares are cut into cells, so this is an equi-join
    cell = max(1, total // 1_024)
    cells = sources.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell)))
    )
    taken = (
        points.withColumn("cell", F.floor(F.col("point") / cell))
        .join(cells, "cell")
        .filter("point >= low and point < high")
        .select("line", "slot")
        .withColumn("stretch", F.floor(F.col("slot") / SLOT_STRETCH))
    )
    inside = Window.partitionBy("line", "stretch").orderBy("slot")
    counts = taken.groupBy("line", "stretch").agg(F.count("*").alias("n"))
    over = Window.partitionBy("line").orderBy("stretch").rowsBetween(Window.unboundedPreceding, 0)
    before = counts.withColumn("before", F.sum("n").over(over) - F.col("n")).drop("n")
    ranked = taken.withColumn("inside", F.row_number().over(inside) - 1).join(before, ["line", "stretch"])
    return ranked.select("line", (F.col("before") + F.col("inside")).alias("rank"), "slot")


def mix_sources(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    source_col: str,
    weights: tuple[int, ...] = (1, 2, 3),
    order_col: str | None = None,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, row, first_slot, n_slots) of every row.

    ``taken`` is the number of words that the mix takes of the document, ``first_slot`` the
    first slot of the mix that holds some, ``n_slots`` how many do. ``row`` is the position on
    the source's line. A source's ``taken`` comes within a few slots of its target; a document's
    never exceeds MAX_EPOCHS times its size. Null and blank texts have size 0 and are not taken;
    null sources form one source; null ids are kept. Repeated rows are documents of their own.
    ``order_col`` (the id) decides the shuffle. Texts of any length are counted whole. Other
    columns are ignored, whatever their names. An empty table gives no rows.
    """
    sized = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            digest(F.col(order_col or id_col)).alias("digest"),
        ),
        "sizes",
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights), "targets")
    quota = F.least(F.floor(F.col("target") + 0.5).cast("long"), F.col("source_size") * MAX_EPOCHS)
    lines = targets.select("source", F.struct("source").alias("line"), "source_size", "target", quota.alias("quota"))
    n_rows, n_docs = sized.agg(F.count("*"), F.count_if(F.col("size") > 0)).first()
    words = lines.agg(F.sum("quota")).first()[0] or 0
    block = slot_words(words, n_docs)
    slots = stored(schedule(lines.select("source", "quota"), block), "schedule")
    held = F.least(F.count("*") * block, F.first("source_size") * MAX_EPOCHS).alias("held")
    reach = slots.join(lines.select("line", "source_size"), "line").groupBy("line").agg(held)
    lines = lines.join(reach, "line", "left").select("line", "source_size", "target", F.coalesce("held", F.lit(0)).alias("held"))
    placed = lay_out(sized, "size", n_rows).withColumn("line", F.struct("source")).drop("source", "digest")
    placed = placed.join(lines, "line")

    def of_epoch(k: int) -> tuple[Column, Column]:
        """Words and slots of the document in the line's k-th round."""
        first = F.col("start") + F.col("source_size") * k
        stop = F.least(first + F.col("size"), F.col("held"))
        some = stop > first
        n = F.floor((stop - 1) / block) - F.floor(first / block) + 1
        return F.when(some, stop - first).otherwise(0), F.when(some, n).otherwise(0)

    rounds = [of_epoch(k) for k in range(MAX_EPOCHS)]
    taken = sum((r[0] for r in rounds[1:]), rounds[0][0])
    n_slots = sum((r[1] for r in rounds[1:]), rounds[0][1])
    asked = placed.withColumns(
        {
            "taken": taken.cast("long"),
            "n_slots": n_slots.cast("long"),
            "rank": F.when(rounds[0][0] > 0, F.floor(F.col("start") / block)),
        }
    )
    return asked.join(slots, ["line", "rank"], "left").select(
        "doc_id",
        "size",
        "source_size",
        "target",
        "taken",
        F.col("line.source").alias("source"),
        F.col("start").alias("row"),
        F.col("slot").alias("first_slot"),
        "n_slots",
    )


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '-')) AS digest
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source
), sums AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER
      (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open
  FROM sizes
), level AS (
  SELECT free, open FROM sums WHERE NOT free * weight > cap * open
  ORDER BY source_size / weight, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size,
    CASE WHEN sums.free * weight > cap * sums.open THEN CAST(cap AS DOUBLE)
      ELSE CAST(level.free AS DOUBLE) * weight / CAST(level.open AS DOUBLE) END AS target
  FROM sums LEFT JOIN level ON true
), shares AS (
  SELECT *, sum(quota) OVER (ORDER BY source NULLS LAST) AS high FROM (
    SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 3 * source_size) AS quota FROM targets)
), mix AS (
  SELECT words, greatest(1, (words + least_slots - 1) // least_slots) AS block
  FROM (SELECT CAST(sum(quota) AS BIGINT) AS words,
    greatest({DOCUMENT_SLOTS} * (SELECT count(*) FROM sized WHERE size > 0), {LEAST_SLOTS}) AS least_slots FROM shares)
), points AS (
  SELECT slot, CAST(floor((slot + 1) * {GOLDEN!r} % 1.0 * words) AS BIGINT) AS point
  FROM (SELECT words, unnest(range((words + block - 1) // block)) AS slot FROM mix)
), slots AS (
  SELECT source, slot, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS rank
  FROM points JOIN shares ON point >= high - quota AND point < high
), lines AS (
  SELECT s.source, any_value(source_size) AS source_size, any_value(target) AS target,
    least(count(slot) * any_value(block), 3 * any_value(source_size)) AS held, any_value(block) AS block
  FROM shares AS s LEFT JOIN slots AS x ON s.source IS NOT DISTINCT FROM x.source, mix GROUP BY s.source
), placed AS (
  SELECT doc_id, source, size, CAST(sum(size) OVER (PARTITION BY source ORDER BY digest, doc_id, size
    ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS start
  FROM sized
), rounds AS (
  SELECT p.*, source_size, target, block, k, start + k * source_size AS first,
    least(start + k * source_size + size, held) AS stop
  FROM placed AS p JOIN lines AS t ON p.source IS NOT DISTINCT FROM t.source, range({MAX_EPOCHS}) AS r(k)
), added AS (
  SELECT doc_id, source, size, start, any_value(source_size) AS source_size, any_value(target) AS target,
    any_value(block) AS block, CAST(sum(greatest(stop - first, 0)) AS BIGINT) AS taken,
    CAST(sum(CASE WHEN stop > first THEN (stop - 1) // block - first // block + 1 ELSE 0 END) AS BIGINT) AS n_slots,
    CASE WHEN bool_or(k = 0 AND stop > first) THEN start // any_value(block) END AS rank
  FROM rounds GROUP BY doc_id, source, size, start
)
SELECT doc_id, size, source_size, target, taken, a.source, slot AS first_slot, n_slots
FROM added AS a LEFT JOIN slots AS s ON a.source IS NOT DISTINCT FROM s.source AND a.rank = s.rank
"""


@query("op5_source_mix", SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by weights 1, 2, 3: size, source's size and target, words taken, and
    where in the mix."""
    mixed = mix_sources(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "first_slot", "n_slots")
