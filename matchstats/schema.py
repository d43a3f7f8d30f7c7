"""Record schema, code tables and constants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKED = 2
SEASON_SPLIT = 20001
MIN_MATCHUP_GAMES = 3
TIERS = ["master", "advanced", "intermediate", "beginner"]

_SIDE = [("chara_id", "character_id", T.IntegerType()), ("name", "name", T.StringType()), ("region_id", "region", T.IntegerType()), ("lang", "language", T.StringType()), ("polaris_id", "polaris_id", T.StringType()), ("power", "power", T.LongType()), ("rank", "dan_rank", T.IntegerType()), ("rating_before", "rating_before", T.IntegerType()), ("rating_change", "rating_change", T.IntegerType()), ("rounds", "rounds_won", T.IntegerType()), ("user_id", "id", T.StringType())]

#: Columns of one player in a battle, without the player{1,2}_ prefix.
SIDE_COLUMNS = [name for _, name, _ in _SIDE]

#: Field of a replay record -> column of a battle, with its type. Ids are strings, whatever the record has.
WIRE = (
    [("battle_id", "battle_id", T.StringType()), ("battle_at", "battle_at", T.LongType()), ("battle_type", "battle_type", T.IntegerType()), ("game_version", "game_version", T.IntegerType())]
    + [(f"p{k}_{wire}", f"player{k}_{name}", kind) for k in (1, 2) for wire, name, kind in _SIDE]
    + [("stage_id", "stageid", T.IntegerType()), ("winner", "winner", T.IntegerType())]
)
WIRE_SCHEMA = T.StructType([T.StructField(wire, kind) for wire, _, kind in WIRE])
BATTLE_COLUMNS = [name for _, name, _ in WIRE]

# Names of the codes in replay records.
CHARACTERS = {
    0: "Paul", 1: "Law", 2: "King", 3: "Yoshimitsu", 4: "Hwoarang", 5: "Xiaoyu", 6: "Jin", 7: "Bryan", 8: "Kazuya", 9: "Steve", 10: "Jack-8", 11: "Asuka", 12: "Devil Jin", 13: "Feng",
    14: "Lili", 15: "Dragunov", 16: "Leo", 17: "Lars", 18: "Alisa", 19: "Claudio", 20: "Shaheen", 21: "Nina", 22: "Lee", 23: "Kuma", 24: "Panda", 28: "Zafina", 29: "Leroy", 32: "Jun",
    33: "Reina", 34: "Azucena", 35: "Victor", 36: "Raven", 38: "Eddy", 39: "Lidia", 40: "Heihachi", 41: "Clive", 42: "Anna", 43: "Fahkumram",
}
STAGES = {
    100: "Arena", 101: "Arena Underground", 200: "Urban Square", 201: "Urban Square Evening", 300: "Yakushima", 400: "Coliseum of Fate", 500: "Rebel Hangar", 700: "Fallen Destiny",
    900: "Descent into Subconscious", 1000: "Sanctum", 1100: "Into the Stratosphere", 1200: "Ortiz Farm", 1300: "Celebration On The Seine", 1400: "Secluded Training Ground", 1500: "Elegant Palace", 1600: "Midnight Siege",
}
RANKS = {
    0: "Beginner", 1: "1st Dan", 2: "2nd Dan", 3: "Fighter", 4: "Strategist", 5: "Combatant", 6: "Brawler", 7: "Ranger", 8: "Cavalry", 9: "Warrior", 10: "Assailant", 11: "Dominator", 12: "Vanquisher",
    13: "Destroyer", 14: "Eliminator", 15: "Garyu", 16: "Shinryu", 17: "Tenryu", 18: "Mighty Ruler", 19: "Flame Ruler", 20: "Battle Ruler", 21: "Fujin", 22: "Raijin", 23: "Kishin", 24: "Bushin",
    25: "Tekken King", 26: "Tekken Emperor", 27: "Tekken God", 28: "Tekken God Supreme", 29: "God of Destruction", 30: "God of Destruction I", 31: "God Of Destruction II", 32: "God of Destruction III",
    33: "God of Destruction IV", 34: "God of Destruction V", 35: "God of Destruction VI", 36: "God of Destruction VII", 37: "God of Destruction Infinity", 100: "God of Destruction", 101: "God of Destruction I",
    102: "God Of Destruction II", 103: "God of Destruction III", 104: "God of Destruction IV", 105: "God of Destruction V", 106: "God of Destruction VI", 107: "God of Destruction VII", 765: "God of Destruction Infinity",
}
PLATFORMS = {3: "PC", 8: "PlayStation", 9: "XBOX"}
BATTLE_TYPES = {1: "quick", 2: "ranked", 3: "group", 4: "player"}

_TABLES = {
    "character": (CHARACTERS, lambda c: F.concat(F.lit("Undefined Character ID: "), c)),
    "stage": (STAGES, lambda c: F.lit("Undefined stage name")),
    "rank": (RANKS, lambda c: F.lit("Undefined DAN name")),
    "platform": (PLATFORMS, lambda c: F.lit("Undefined platform")),
    "battle_type": (BATTLE_TYPES, lambda c: F.lit(None)),
}


def code_table(spark: SparkSession, kind: str) -> DataFrame:
    """code (string), name: a fixed table of tens of rows."""
    return spark.createDataFrame([(str(k), v) for k, v in _TABLES[kind][0].items()], "code string, name string")


def with_names(df: DataFrame, kind: str, code: str, name: str) -> DataFrame:
    """``df`` with ``name`` looked up from column ``code``; an unknown code gets the default text of its kind."""
    own = code_table(df.sparkSession, kind).select(F.col("code").alias("_code"), F.col("name").alias("_name"))
    c = F.col(code).cast("string")
    return df.join(F.broadcast(own), c == F.col("_code"), "left").withColumn(name, F.coalesce("_name", _TABLES[kind][1](c))).drop("_code", "_name")


def name_of(kind: str, code: Column) -> Column:
    """The same as an expression, where a join would be in the way."""
    names, default = _TABLES[kind]
    c = code.cast("string")
    table = F.create_map(*(F.lit(x) for k, v in names.items() for x in (str(k), v)))
    return F.when(c.isNotNull(), F.coalesce(F.try_element_at(table, c), default(c)))
