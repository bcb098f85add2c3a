"""Run logs: the activities section and the trade history of every log in a directory.

Logs are read line by line, so a large log is cut into blocks that many tasks read. Lines stand in order inside a
block; what a block can't know by itself (the section it begins in, the objects before it) is handed on from the
blocks before, one row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeline.operators.scratch import stored
from tapeline.schema import PRICE_COLUMNS

FIELDS = ("timestamp", "buyer", "seller", "symbol", "price", "quantity")
ACTIVITIES, TRADES = "Activities log:", "Trade History:"
BLOCK = ("path", "block")
#: Characters of lines (a line counts as SHORT at least, for its path) that one task takes at a time.
PART, SHORT = 1 << 26, 200


class LogError(ValueError):
    """A log that breaks its contract."""


def read_logs(spark: SparkSession, path) -> DataFrame:
    """run (the file's name), path, block (where the part of the file begins that was read together), at (grows along a
    block), line. Files of one name in different folders are different logs."""
    file = F.col("_metadata.file_path")
    return spark.read.text(path).select(F.element_at(F.split(file, "/"), -1).alias("run"), file.alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def _handed_on(ends: DataFrame, **made: Column) -> DataFrame:
    """ends (a row a block) with what the blocks before it in the file have made: columns over an unnamed window."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(*BLOCK, *[c.over(before).alias(name) for name, c in made.items()])


def _parts(logs: DataFrame) -> DataFrame:
    """logs with whole blocks in parts whose size doesn't grow with the logs."""
    size = logs.agg(F.sum(F.greatest(F.length("line"), F.lit(SHORT)))).first()[0] or 0
    return logs.repartition(size // PART + 1, *BLOCK)


def _sections(logs: DataFrame) -> DataFrame:
    """Lines of the two sections with section: `activities` (up to a blank line) or `trades` (to the end); without
    the sections' own titles. Comes in the parts of _parts."""
    logs = _parts(logs)
    turn = F.when(F.col("line") == ACTIVITIES, "A").when(F.col("line").rlike(r"^\s*$"), "B")
    traded = F.col("line") == TRADES
    upto = Window.partitionBy(*BLOCK).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = logs.withColumn("_turn", F.last(turn, ignorenulls=True).over(upto)).withColumn("_traded", F.max(traded).over(upto))
    ends = logs.groupBy(*BLOCK).agg(F.max_by(turn, F.when(turn.isNotNull(), F.col("at"))).alias("_turn"), F.max(traded).alias("_traded"))
    carried = _handed_on(ends, _turn0=F.last("_turn", ignorenulls=True), _traded0=F.max("_traded"))
    rows = rows.join(carried, list(BLOCK))
    trades = F.col("_traded") | F.coalesce("_traded0", F.lit(False))
    section = F.when(trades, "trades").when(F.coalesce("_turn", "_turn0") == "A", "activities")
    return rows.select(*logs.columns, section.alias("section")).filter(F.col("section").isNotNull() & ~F.col("line").isin(ACTIVITIES, TRADES))


def _demand(ok: Column, value: Column, message: Column) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(message).cast("string"))


def _refuse(bad: DataFrame, message: str) -> None:
    """Raises for the first log (run) of bad."""
    if found := bad.select("run").head(1):
        raise LogError(f"{message} {found[0].run}")


def activities(logs: DataFrame) -> DataFrame:
    """run, day, timestamp, product, mid_price, profit_and_loss of each row of `Activities log:`.

    Raises for a log without the section, with another header, or without rows; its result raises for a row that
    has not 17 fields or whose numbers don't parse, and the message holds the row.
    """
    header = ";".join(PRICE_COLUMNS)
    lines = stored(_sections(logs).filter("section = 'activities'").drop("section"), "activities")
    heads = lines.groupBy("path").agg(F.min_by("line", F.struct("block", "at")).alias("head"), F.count("*").alias("n"), F.sum((F.col("line") == header).cast("int")).alias("headers"))
    known = heads.filter((F.col("head") == header) & (F.col("n") > 1) & (F.col("headers") == 1))
    _refuse(logs.select("run", "path").distinct().join(known, "path", "left_anti"), "no activities section with the known header and rows in")
    rows = lines.filter(F.col("line") != header)
    f = F.split("line", ";")
    fine = F.size(f) == len(PRICE_COLUMNS)
    for i, kind in ((0, "int"), (1, "long"), (15, "double"), (16, "double")):
        fine = fine & F.get(f, F.lit(i)).try_cast(kind).isNotNull()
    good = F.split(_demand(fine, F.col("line"), F.concat(F.lit("malformed activity row: "), F.col("line"))), ";")
    return rows.select("run", good.alias("f")).select(
        "run", F.get("f", F.lit(0)).cast("int").alias("day"), F.get("f", F.lit(1)).cast("long").alias("timestamp"), F.get("f", F.lit(2)).alias("product"),
        F.get("f", F.lit(15)).cast("double").alias("mid_price"), F.get("f", F.lit(16)).cast("double").alias("profit_and_loss"),
    )


def trade_history(logs: DataFrame) -> DataFrame:
    """run, timestamp, buyer, seller, symbol, price, quantity of each object after `Trade History:`.

    The objects are no valid JSON (trailing commas), so fields are matched one by one, on whatever lines of the object
    they stand; objects are numbered through a log by their opening braces. A log without the section raises; the result raises
    for an object without a field. A history without trades is fine; an object that is never closed is none.
    """
    _refuse(logs.select("run", "path").distinct().join(logs.filter(F.col("line") == TRADES).select("path").distinct(), "path", "left_anti"), "no trade history in")
    lines = _sections(logs).filter("section = 'trades'").select("run", *BLOCK, "at", F.posexplode(F.split("line", r"(?<=\})|(?=\{)")).alias("piece", "text"))
    opens = F.col("text").contains("{").cast("long")
    lines = stored(lines.withColumn("open", opens), "trades")
    upto = Window.partitionBy(*BLOCK).orderBy("at", "piece").rowsBetween(Window.unboundedPreceding, 0)
    carried = _handed_on(lines.groupBy(*BLOCK).agg(F.sum("open").alias("_opened")), _before=F.sum("_opened"))
    rows = _parts(lines.withColumnRenamed("text", "line")).withColumnRenamed("line", "text")
    rows = rows.withColumn("_upto", F.sum("open").over(upto)).join(carried, list(BLOCK))
    rows = rows.withColumn("item", F.col("_upto") + F.coalesce("_before", F.lit(0))).filter("item > 0")
    value = {}
    for name in FIELDS:
        pattern = rf'"{name}":\s*(?:"((?:[^"\\]|\\.)*)"|(-?\d+(?:\.\d+)?))'
        found = F.concat(F.regexp_extract("text", pattern, 1), F.regexp_extract("text", pattern, 2))
        value[name] = F.first(F.when(F.rlike("text", F.lit(pattern)), found), ignorenulls=True).alias(name)
    # lines become objects where their block is; only objects meet again, for those that go on in the next block
    items = rows.groupBy("run", *BLOCK, "item").agg(*value.values(), F.max(F.col("text").contains("}")).alias("closed"))
    items = items.groupBy("run", "path", "item").agg(*[F.min_by(name, F.when(F.col(name).isNotNull(), F.col("block"))).alias(name) for name in FIELDS], F.max("closed").alias("closed")).filter("closed")
    for name in FIELDS:
        items = items.withColumn(name, _demand(F.col(name).isNotNull(), F.col(name), F.concat(F.lit(f"no field {name} in trade "), F.col("item").cast("string"), F.lit(" of "), F.col("run"))))
    return items.select("run", F.col("timestamp").cast("long").alias("timestamp"), "buyer", "seller", "symbol", F.col("price").cast("double").alias("price"), F.col("quantity").cast("long").alias("quantity"))
