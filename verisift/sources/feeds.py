"""Sources and sinks of JSON and JSON lines, and robots.txt bodies.

Nothing here goes out to the network: pages, catalogue pages and logs are read from files that some fetcher has left.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

USAGE = "ts string, tool string, preview boolean, payment_provided boolean, outcome string, ip_hash string, question_hash string, duration_ms double, status int"
CATALOGUE = "resource string, description string, serviceName string, tags array<string>, accepts array<struct<amount:string,network:string,payTo:string>>, quality struct<l30DaysTotalCalls:double,l30DaysUniquePayers:double>"
TRANSFERS = "block long, tx string, topics array<string>"
#: Blocks of a day, and of one read of the log.
BLOCKS_PER_DAY, CHUNK = 43_200, 2_000


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines log; lines that are no JSON are dropped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def append_lines(rows: DataFrame, path: str) -> None:
    """Append rows to a JSON-lines log, one object a line, nulls left out."""
    rows.write.mode("append").json(path)


def stream_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path, mode="DROPMALFORMED")


def parse_lines(lines: DataFrame, schema: str, col: str = "line") -> DataFrame:
    """The same from a column of lines: rows whose line isn't a JSON object go."""
    ok = F.schema_of_variant(F.try_parse_json(F.col(col))).startswith("OBJECT")
    return lines.filter(ok).select(*[c for c in lines.columns if c != col], F.from_json(F.col(col), schema).alias("row")).select("*", "row.*").drop("row")


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Items of catalogue snapshots (JSON files, each an object with a list `items`)."""
    return spark.read.schema(f"items array<struct<{CATALOGUE.replace(' ', ':').replace(',:', ',')}>>").json(path, multiLine=True).select(F.explode("items").alias("i")).select("i.*")


def catalogue_items(pages: DataFrame, page: str = "page", body: str = "body") -> DataFrame:
    """Items of a catalogue's pages (JSON text with a list `items`), with page and position; pages that can't be read give
    none."""
    shape = f"items array<struct<{CATALOGUE.replace(' ', ':').replace(',:', ',')}>>"
    return pages.select(page, F.posexplode(F.from_json(body, shape)["items"]).alias("pos", "i")).select(page, "pos", "i.*")


def containment(items: DataFrame, needle: str, total: int) -> DataFrame:
    """rows seen, how many hold the needle anywhere in their JSON, and whether all rows that are said to exist were seen."""
    text = F.to_json(F.struct("*"))
    return items.select(text.alias("t")).agg(F.count("*").alias("seen"), F.count_if(F.col("t").contains(needle)).alias("found")).withColumn("complete", F.col("seen") >= total)


def block_chunks(spark: SparkSession, head: int, days: int) -> DataFrame:
    """first and last of each chunk of blocks that covers the last days up to `head`."""
    first = head - min(days * BLOCKS_PER_DAY, head - 1)
    return spark.range(first, head + 1, CHUNK).select(F.col("id").alias("first"), F.least(F.col("id") + CHUNK - 1, F.lit(head)).alias("last"))


def transfers(logs: DataFrame, recipients: DataFrame, first: int, last: int) -> DataFrame:
    """sender, recipient, tx of log rows (block, tx, topics) of a block range, whose recipient is in `recipients` (address).
    The block range reaches the scan; only recipients, one row each, are joined."""
    address = lambda i: F.concat(F.lit("0x"), F.substring(F.col("topics")[i], 27, 40))
    rows = logs.filter(F.col("block").between(first, last)).select("tx", address(1).alias("sender"), address(2).alias("recipient"))
    return rows.join(recipients.select(F.lower("address").alias("recipient")).distinct(), "recipient", "left_semi").select("sender", "recipient", "tx")


def find_rank(body: Column, path: str, field: str, wanted: str) -> Column:
    """1-based place of the first row of a JSON list whose field is `wanted`; null without one."""
    rows = F.try_variant_get(F.try_parse_json(body), path, "array<variant>")
    at = F.array_position(F.transform(rows, lambda r: F.coalesce(F.try_variant_get(r, f"$.{field}", "string"), F.lit(""))), F.lit(wanted))
    return F.when(at > 0, at)


def parse_robots(files: DataFrame, agent: str, origin: str = "origin", body: str = "body", limit: int = 128 * 1024) -> DataFrame:
    """origin, allow, path of the rules for an agent: groups of consecutive user-agent lines; groups that name an agent whose
    token ours starts with come before those for `*` alone. Ours is the product name of the agent, up to a slash or blank.
    Comments go; an empty disallow is no rule. A null body, one of more than `limit` bytes, which is refused whole, or no
    group for the agent, gives no rules. One body is one small group of lines."""
    token = re.split(r"[\s/]", agent)[0].lower()
    read = files.filter(F.octet_length(body) <= limit)
    lines = read.select(origin, F.posexplode(F.split(body, "\r?\n")).alias("pos", "raw"))
    line = F.trim(F.regexp_replace("raw", "#.*$", ""))
    lines = lines.withColumn("line", line).filter(F.col("line").contains(":"))
    field, value = F.lower(F.trim(F.substring_index("line", ":", 1))), F.trim(F.expr("substring(line, instr(line, ':') + 1)"))
    by = Window.partitionBy(origin).orderBy("pos")
    lines = lines.select(origin, "pos", field.alias("field"), value.alias("value")).withColumn("was", F.lag("field").over(by))
    starts = (F.col("field") == "user-agent") & ~F.coalesce(F.col("was") == "user-agent", F.lit(False))
    lines = lines.withColumn("grp", F.sum(starts.cast("int")).over(by)).filter("grp > 0 AND field IN ('user-agent', 'allow', 'disallow')")
    name = F.lower("value")
    hit = (name == "*") | ((name != "") & F.lit(token).startswith(name))
    named = F.col("field") == "user-agent"
    groups = lines.groupBy(origin, "grp").agg(F.bool_or(F.when(named, hit)).alias("ours"), F.bool_or(F.when(named, name != "*")).alias("special")).filter("ours")
    best = groups.groupBy(origin).agg(F.bool_or("special").alias("any_special"))
    groups = groups.join(best, origin).filter("special OR NOT any_special").select(origin, "grp")
    rules = lines.filter(~named).join(groups, [origin, "grp"]).select(origin, (F.col("field") == "allow").alias("allow"), F.col("value").alias("path"))
    return rules.filter("path <> '' OR allow")
