"""Player views, each for many players at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import format_id, pad18, share, utc_date, valid_player_id
from ..schema import MIN_MATCHUP_GAMES, SEASON_SPLIT, name_of

NO_CHARACTER, NO_RANK = "No Character Data", "N/A"


def main_character_overall(stats: DataFrame) -> DataFrame:
    """Of the characters that reached the player's highest rank, the one with most games over all versions."""
    by = Window.partitionBy("player_id")
    d = stats.groupBy("player_id", "character_id").agg(F.max("dan_rank").alias("dan_rank"), F.sum(F.col("wins") + F.col("losses")).alias("total_plays"))
    d = d.withColumn("n", F.row_number().over(by.orderBy(F.desc("dan_rank"), F.desc("total_plays"), F.col("character_id").cast("int"))))
    return d.where("n = 1").select("player_id", "character_id", "dan_rank", "total_plays")


def recent_character(stats: DataFrame) -> DataFrame:
    """Character and rank of each player's latest battle; a tie goes to the newest version, then to the lowest character."""
    first = F.struct((-F.coalesce("latest_battle", F.lit(-1))).alias("t"), (-F.col("game_version")).alias("v"), F.col("character_id").cast("int").alias("c"))
    return stats.groupBy("player_id").agg(F.min_by("character_id", first).alias("character_id"), F.min_by("dan_rank", first).alias("dan_rank"), F.max("latest_battle").alias("latest_battle"))


def merge_matchups(d: DataFrame) -> DataFrame:
    """Counts of matchups added up: batches may be merged in any order."""
    return d.groupBy("player_id", "character_id", "opp_character_id").agg(F.sum("wins").alias("wins"), F.sum("losses").alias("losses"))


def matchup_state(sides: DataFrame) -> DataFrame:
    """Wins and losses of each (player, own character, opponent's character) over ranked sides."""
    win = F.col("is_win").cast("long")
    return merge_matchups(sides.select("player_id", "character_id", "opp_character_id", win.alias("wins"), (1 - win).alias("losses")))


def rated(matchups: DataFrame) -> DataFrame:
    """Matchup counts with total and rate."""
    return matchups.withColumn("total", F.col("wins") + F.col("losses")).withColumn("winrate", share(F.col("wins"), F.col("total")))


def player_matchups(sides: DataFrame) -> DataFrame:
    """Wins, losses and rate of each (player, own character, opponent's character) over ranked sides."""
    return rated(matchup_state(sides))


def best_worst_matchups(matchups: DataFrame, min_games: int = MIN_MATCHUP_GAMES) -> DataFrame:
    """Best and worst opponent's character of each (player, character); a tie goes to the name first in the alphabet."""
    d = matchups.where(F.col("total") >= min_games).withColumn("opponent", name_of("character", F.col("opp_character_id")))
    high, low = F.struct((-F.col("winrate")).alias("r"), "opponent"), F.struct(F.col("winrate").alias("r"), "opponent")
    return d.groupBy("player_id", "character_id").agg(
        F.min_by("opponent", high).alias("best_opponent"), F.max("winrate").alias("best_winrate"), F.min_by("opponent", low).alias("worst_opponent"), F.min("winrate").alias("worst_winrate")
    )


def character_totals(stats: DataFrame) -> DataFrame:
    d = stats.groupBy("player_id", "character_id").agg(F.sum("wins").alias("wins"), F.sum("losses").alias("losses"))
    return d.withColumn("winrate", share(F.col("wins"), F.col("wins") + F.col("losses")))


def season_ranks(stats: DataFrame, split: int = SEASON_SPLIT) -> DataFrame:
    """Rank at the newest version since ``split``, and at the newest before it."""
    gv = F.col("game_version")
    return stats.groupBy("player_id", "character_id").agg(
        F.max_by("dan_rank", F.when(gv >= split, gv)).alias("current_season_rank"), F.max_by("dan_rank", F.when(gv < split, gv)).alias("previous_season_rank")
    )


def _named(d: DataFrame) -> DataFrame:
    """Adds main_character and main_rank as names; players without statistics have the defaults."""
    return d.withColumn("main_character", F.coalesce(name_of("character", F.col("character_id")), F.lit(NO_CHARACTER))).withColumn(
        "main_rank", F.coalesce(name_of("rank", F.col("dan_rank")), F.lit(NO_RANK))
    )


def with_stats(players: DataFrame, stats: DataFrame) -> DataFrame:
    """Players with an array of their character statistics, empty if there are none."""
    row = F.struct("game_version", "character_id", "dan_rank", "wins", "losses", "latest_battle")
    own = stats.groupBy("player_id").agg(F.array_sort(F.collect_list(row)).alias("character_stats"))
    empty = F.array().cast(own.schema["character_stats"].dataType)
    return players.join(own, "player_id", "left").withColumn("character_stats", F.coalesce("character_stats", empty))


def player_metadata(players: DataFrame, stats: DataFrame) -> DataFrame:
    d = _named(players.join(main_character_overall(stats), "player_id", "left"))
    return d.select("player_id", "name", "region_id", "polaris_id", utc_date(F.col("latest_battle"), False).alias("latest_battle_date"), "power", "main_character", "main_rank")


def check_query(q: str) -> None:
    if not q.strip() or len(q) >= 20:
        raise ValueError("a query has 1 to 19 characters, not all blank")


def search_predicate(q: str, name: Column, polaris_id: Column) -> Column:
    """Name contains ``q`` in any case, or the id contains it without dashes; ``%`` and ``_`` are plain characters."""
    check_query(q)
    low = q.lower()
    return F.lower(name).contains(low) | F.lower(polaris_id).contains(low.replace("-", ""))


def _search_order(q: str) -> list[Column]:
    """Equal names first, then names that start with the query, then short names."""
    name, low = F.lower("name"), q.lower()
    return [F.when(name == low, 0).when(name.startswith(low), 1).otherwise(20), F.length("name").asc_nulls_last(), F.col("name").asc_nulls_last(), F.col("player_id")]


def rank_search(found: DataFrame, q: str, limit: int = 20) -> DataFrame:
    return found.orderBy(*_search_order(q)).limit(limit)


def found_players(found: DataFrame, stats: DataFrame, q: str) -> DataFrame:
    """The rows of a search result in their order; ``stats`` has those of the players found."""
    d = _named(found.join(main_character_overall(stats), "player_id", "left")).orderBy(*_search_order(q))
    return d.select("player_id", "name", "polaris_id", format_id(F.col("polaris_id")).alias("formatted_id"), F.coalesce("region_id", F.lit(-1)).alias("region_id"), "main_character", "main_rank")


def player_search(players: DataFrame, stats: DataFrame, q: str, limit: int = 20) -> DataFrame:
    """By a scan of all players; ``search`` has the same by an index."""
    found = rank_search(players.where(search_predicate(q, F.col("name"), F.col("polaris_id"))), q, limit)
    return found_players(found, stats.join(F.broadcast(found.select("player_id")), "player_id", "left_semi"), q)  # ``limit`` rows


def recently_active(players: DataFrame, stats: DataFrame, now: Column | None = None, seconds: int = 600, limit: int = 40) -> DataFrame:
    """Players seen in the last ``seconds``, newest first."""
    now = F.unix_timestamp() if now is None else now
    found = players.where(F.col("latest_battle") > now - seconds).orderBy(F.desc("latest_battle"), "player_id").limit(limit)
    own = stats.join(F.broadcast(found.select("player_id")), "player_id", "left_semi")  # ``limit`` rows
    d = found.withColumnRenamed("latest_battle", "last_seen").join(recent_character(own).drop("latest_battle"), "player_id", "left")
    d = _named(d).select("player_id", "name", "polaris_id", "region_id", "power", "last_seen", F.col("main_character").alias("recent_character"), F.col("main_rank").alias("recent_rank"))
    return d.orderBy(F.desc("last_seen"), "player_id")  # a join keeps no order


def leaderboard(players: DataFrame, stats: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` players of greatest power; they are cut before they are numbered."""
    top = players.orderBy(F.desc("power"), "player_id").limit(n)
    own = stats.join(F.broadcast(top.select("player_id")), "player_id", "left_semi")  # n rows
    d = top.join(main_character_overall(own), "player_id", "left")
    d = d.withColumn("ranking", F.row_number().over(Window.orderBy(F.desc("power"), "player_id")))  # over n rows
    return _named(d).select("ranking", "name", "player_id", "power", F.col("main_rank").alias("rank"), F.col("main_character").alias("character")).orderBy("ranking")


def resolve_player_ids(players: DataFrame, polaris_ids: DataFrame) -> DataFrame:
    """Padded player id and its spelling without zeros for ids (polaris_id, perhaps with dashes or blanks); malformed ones are left out."""
    clean = F.regexp_replace(F.trim("polaris_id"), "-", "")
    wanted = polaris_ids.select(F.col("polaris_id").alias("asked"), clean.alias("polaris_id")).where(valid_player_id(clean))
    d = wanted.join(players.select("polaris_id", "player_id"), "polaris_id")
    return d.select("asked", "polaris_id", pad18(F.col("player_id")).alias("player_id"), F.regexp_replace("player_id", "^0+", "").alias("short_id"))


def player_profile(players: DataFrame, stats: DataFrame, matchups: DataFrame) -> DataFrame:
    """One row a (player, character): attributes, totals, season ranks, best and worst matchup (``matchups`` with rates)."""
    own = stats.join(players.select("player_id"), "player_id", "left_semi")
    games = matchups.join(players.select("player_id"), "player_id", "left_semi")
    head = player_metadata(players, own).join(players.select("player_id", "latest_battle"), "player_id").drop("latest_battle_date")
    key = ["player_id", "character_id"]
    d = character_totals(own).join(season_ranks(own), key).join(best_worst_matchups(games), key, "left")
    return head.join(d, "player_id", "left").withColumn("character", name_of("character", F.col("character_id")))


def history_pages(history: DataFrame, days: int = 30, parts: int | None = None) -> DataFrame:
    """A player's battles (``history`` has player_id, in any order), newest first, in a row for each ``days`` days that have any: however long a history is, a row holds one period.

    Rows are dealt out by player and period (to ``parts`` partitions) before they are gathered: gathered first, they would be sorted twice and move no smaller.
    """
    page = F.floor(F.col("battle_at") / (86400 * days)).alias("page")
    fields = [c for c in history.columns if c not in ("player_id", "battle_at")]
    dealt = history.repartition(*([] if parts is None else [parts]), "player_id", page)
    return dealt.groupBy("player_id", page).agg(F.sort_array(F.collect_list(F.struct("battle_at", *fields)), asc=False).alias("battles"))


def nested_profiles(players: DataFrame, stats: DataFrame, matchups: DataFrame) -> DataFrame:
    """One row a player: attributes and a map of characters with their matchups; both are bounded by the number of characters. The battles are in ``history_pages``."""
    flat = player_profile(players, stats, matchups)
    m = matchups.withColumn("opponent", name_of("character", F.col("opp_character_id")))
    m = m.groupBy("player_id", "character_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("opponent", F.struct("wins", "losses", "total", F.col("winrate").cast("float").alias("winrate")))))).alias("matchups"))
    flat = flat.join(m, ["player_id", "character_id"], "left")
    summary = F.struct("wins", "losses", F.col("winrate").cast("float").alias("winrate"), "current_season_rank", "previous_season_rank", "best_opponent", "best_winrate", "worst_opponent", "worst_winrate", "matchups")
    attributes = ["player_id", "name", "region_id", "polaris_id", "power", "latest_battle", "main_character", "main_rank"]
    return flat.groupBy(*attributes).agg(F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("character").isNotNull(), F.struct("character", summary.alias("s")))), lambda a, b: F.when(a["character"] < b["character"], -1).otherwise(1))).alias("played_characters"))
