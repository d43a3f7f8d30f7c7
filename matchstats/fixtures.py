"""Battles derived from the star-schema tables, and the frames that queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.ingest import dedupe_first

#: Tables that battles are derived from.
TABLES = ["lineitem", "orders", "customer", "nation"]
#: So many players at most are broadcast to the battles (about 100 bytes each): a shuffle for each side moves all battles.
BROADCAST_PEOPLE = 1_000_000
DEDUPE_ORDER = ["battle_at", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_battles(spark: SparkSession, sf_dir: str, first_only: bool = False) -> DataFrame:
    """One battle a line item, with repeated battle_ids; ``batch_no`` says with which of four batches it arrives.

    With ``first_only``, the first line item of each battle_id alone, found before anything is joined to it but its order:
    rows are dealt out by order once, for that join and the sort, with what cannot be derived later and nothing else.
    """
    customers = table(spark, sf_dir, "customer")
    np = customers.agg(F.floor(F.count("*") / 10).cast("long")).scalar()
    people = customers.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).where(F.col("c_custkey") < np)
    people = people.select(F.col("c_custkey").alias("p"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("language"), F.col("n_regionkey").cast("int").alias("region"))
    flag = F.col("l_returnflag")
    winner = F.when(flag == "A", 1).when(flag == "R", 2).otherwise(1 + F.col("l_suppkey") % 2).cast("int").alias("winner")
    day = F.unix_date(F.to_date("l_shipdate")).cast("long").alias("day")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", winner, day)
    few = False
    if first_only:
        lines = lines.repartition("l_orderkey")
        few = people.count() <= BROADCAST_PEOPLE
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    d = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    d = d.withColumn("battle_at", (F.col("day") * 86400 + (part * 37 + supp * 11 + F.col("l_quantity").cast("int")) % 86400).cast("long"))
    if first_only:
        d = dedupe_first(d, ["l_orderkey", "l_linenumber"], DEDUPE_ORDER)
    d = d.withColumns({"q": F.col("l_quantity").cast("int"), "k": part + 7 * supp + line, "y": F.year(F.date_from_unix_date(F.col("day").cast("int"))), "p1": F.col("o_custkey") % np})
    d = d.withColumn("p2", (F.col("p1") + 1 + supp % (np - 1)) % np)
    sides = {}
    for k in (1, 2):
        own = people.select(*(F.col(c).alias(f"{c}_{k}") for c in people.columns))
        own = F.broadcast(own) if few else own
        d = d.join(own, F.col(f"p{k}") == F.col(f"p_{k}"), "left")
        p, code, change = F.col(f"p{k}"), part if k == 1 else F.col("k"), supp % 21 - 10
        rank = (p * 7) % 33 + (F.col("q") if k == 1 else F.col("q") + line) % 4 + (code % 12) % 3
        rated = F.when(line != 7, 1000 + (part if k == 1 else supp) % 500)
        sides |= {
            f"player{k}_character_id": ((code % 12) * 4).cast("int"),
            f"player{k}_name": F.col(f"name_{k}"),
            f"player{k}_region": F.when((p % 11 != 0) & (line != 6), F.col(f"region_{k}")),
            f"player{k}_language": F.col(f"language_{k}"),
            f"player{k}_polaris_id": F.concat(F.lit("P"), F.lpad(p.cast("string"), 11, "0")),
            f"player{k}_power": 10000 + p * 100 + F.col("day") % 1000,
            f"player{k}_dan_rank": rank.cast("int"),
            f"player{k}_rating_before": rated.cast("int"),
            f"player{k}_rating_change": (change if k == 1 else -change).cast("int"),
            f"player{k}_rounds_won": F.when(F.col("winner") == k, 3).otherwise(line % 3).cast("int"),
            f"player{k}_id": p.cast("string"),
        }
    kind = F.when(part % 10 == 0, 1).when(part % 10 == 1, 3).when(part % 10 == 2, 4).otherwise(2)
    version = F.when(F.col("y") < 1999, 10001 + (F.col("y") - 1994) * 100).otherwise(20000 + F.col("y") - 1998)
    return d.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), line.cast("string")).alias("battle_id"),
        "battle_at",
        kind.cast("int").alias("battle_type"),
        version.cast("int").alias("game_version"),
        *(c.alias(n) for n, c in sides.items()),
        ((part % 16 + 1) * 100).cast("int").alias("stageid"),
        "winner",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        (F.col("l_orderkey") % 4).cast("int").alias("batch_no"),
    )


def battles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a battle_id: the first."""
    return raw_battles(spark, sf_dir, first_only=True)
