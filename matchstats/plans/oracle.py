"""The same queries in SQL, written independently: unions for grouping sets, joins for windows."""

from __future__ import annotations

from ..schema import BATTLE_TYPES, CHARACTERS, RANKS
from .queries import PAGE_STEP, PAGE_WIDTH, SEARCH, SEARCH_ID


def _values(name: str, codes: dict[int, str]) -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in codes.items())
    return f"{name}(code, label) AS (VALUES {rows})"


def _side(k: int) -> str:
    o = 3 - k
    pad = lambda c: f"CASE WHEN length({c}) < 18 THEN lpad({c}, 18, '0') ELSE {c} END"
    return f"""SELECT battle_id, {k} AS side, battle_at, battle_type, game_version, batch_no, {pad(f'player{k}_id')} AS player_id, player{k}_polaris_id AS polaris_id,
      player{k}_name AS name, player{k}_language AS language, player{k}_character_id::VARCHAR AS character_id, player{k}_region AS region_id, player{k}_dan_rank AS dan_rank,
      player{k}_power AS power, player{k}_rating_before AS rating_before, player{k}_rating_change AS rating_change, player{k}_rounds_won AS rounds_won,
      {pad(f'player{o}_id')} AS opp_player_id, player{o}_character_id::VARCHAR AS opp_character_id, player{o}_dan_rank AS opp_dan_rank, winner = {k} AS is_win FROM battles"""


def _tier(null_tier: str = "NULL") -> str:
    beginner = "ELSE 'beginner'" if null_tier == "beginner" else "WHEN dan_rank >= 0 THEN 'beginner' ELSE NULL"
    return f"CASE WHEN dan_rank >= 27 THEN 'master' WHEN dan_rank >= 21 THEN 'advanced' WHEN dan_rank >= 15 THEN 'intermediate' {beginner} END"


def _stats(where: str) -> str:
    return f"""SELECT player_id, character_id, game_version, first(dan_rank ORDER BY battle_at DESC, battle_id) AS dan_rank, max(battle_at) AS latest_battle,
      count(*) FILTER (WHERE is_win) AS wins, count(*) FILTER (WHERE NOT is_win) AS losses FROM sides WHERE {where} GROUP BY ALL"""


def _cells(category: str) -> str:
    where = "" if category == "overall" else """WHERE NOT EXISTS (SELECT 1 FROM reg b WHERE b.player_id = a.player_id AND b.game_version = a.game_version AND
        (b.dan_rank > a.dan_rank OR b.dan_rank = a.dan_rank AND (b.total_plays > a.total_plays OR b.total_plays = a.total_plays AND b.character_id::INT < a.character_id::INT)))"""
    return f"""SELECT game_version, character_id, dan_rank, '{category}' AS category, region_id, sum(wins)::BIGINT AS total_wins, sum(losses)::BIGINT AS total_losses,
      count(DISTINCT player_id) AS total_players, sum(total_plays)::BIGINT AS total_replays FROM reg a {where} GROUP BY ALL"""


_BASE = {
    "np": "np AS (SELECT count(*) // 10 AS np FROM customer)",
    "cust": "cust AS (SELECT c_custkey, c_name, c_mktsegment, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)",
    "l0": """l0 AS (SELECT l.*, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS day, l_quantity::INT AS q, l_partkey + 7 * l_suppkey + l_linenumber AS k,
      year(l_shipdate) AS y, o_custkey % np AS p1, (o_custkey % np + 1 + l_suppkey % (np - 1)) % np AS p2,
      (CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 1 + l_suppkey % 2 END)::INT AS winner FROM lineitem l JOIN orders ON l_orderkey = o_orderkey, np)""",
    "raw": """raw AS (SELECT concat(l_orderkey, '-', l_linenumber) AS battle_id, (day * 86400 + (l_partkey * 37 + l_suppkey * 11 + q) % 86400)::BIGINT AS battle_at,
      (CASE l_partkey % 10 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 2 END)::INT AS battle_type,
      (CASE WHEN y < 1999 THEN 10001 + (y - 1994) * 100 ELSE 20000 + y - 1998 END)::INT AS game_version,
      p1::VARCHAR AS player1_id, p2::VARCHAR AS player2_id, concat('P', lpad(p1::VARCHAR, 11, '0')) AS player1_polaris_id, concat('P', lpad(p2::VARCHAR, 11, '0')) AS player2_polaris_id,
      a.c_name AS player1_name, b.c_name AS player2_name, a.c_mktsegment AS player1_language, b.c_mktsegment AS player2_language,
      CASE WHEN p1 % 11 = 0 OR l_linenumber = 6 THEN NULL ELSE a.n_regionkey::INT END AS player1_region, CASE WHEN p2 % 11 = 0 OR l_linenumber = 6 THEN NULL ELSE b.n_regionkey::INT END AS player2_region,
      ((l_partkey % 12) * 4)::INT AS player1_character_id, ((k % 12) * 4)::INT AS player2_character_id,
      ((p1 * 7) % 33 + q % 4 + (l_partkey % 12) % 3)::INT AS player1_dan_rank, ((p2 * 7) % 33 + (q + l_linenumber) % 4 + (k % 12) % 3)::INT AS player2_dan_rank,
      10000 + p1 * 100 + day % 1000 AS player1_power, 10000 + p2 * 100 + day % 1000 AS player2_power,
      CASE WHEN l_linenumber = 7 THEN NULL ELSE (1000 + l_partkey % 500)::INT END AS player1_rating_before, CASE WHEN l_linenumber = 7 THEN NULL ELSE (1000 + l_suppkey % 500)::INT END AS player2_rating_before,
      (l_suppkey % 21 - 10)::INT AS player1_rating_change, (10 - l_suppkey % 21)::INT AS player2_rating_change,
      (CASE WHEN winner = 1 THEN 3 ELSE l_linenumber % 3 END)::INT AS player1_rounds_won, (CASE WHEN winner = 2 THEN 3 ELSE l_linenumber % 3 END)::INT AS player2_rounds_won,
      ((l_partkey % 16 + 1) * 100)::INT AS stageid, winner, l_partkey, l_suppkey, l_quantity, l_extendedprice, (l_orderkey % 4)::INT AS batch_no
      FROM l0 LEFT JOIN cust a ON a.c_custkey = p1 LEFT JOIN cust b ON b.c_custkey = p2)""",
    "battles": "battles AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY battle_id ORDER BY battle_at, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1)",
    "allsides": f"allsides AS ({_side(1)} UNION ALL {_side(2)})",
    "sides": "sides AS (SELECT * FROM allsides WHERE battle_type = 2)",
    "stats": f"stats AS ({_stats('true')})",
    "old": f"old AS ({_stats('batch_no < 3')})",
    "players": """players AS (SELECT player_id, first(polaris_id ORDER BY battle_at, battle_id) AS polaris_id, first(name ORDER BY battle_at DESC, battle_id) AS name,
      first(region_id ORDER BY battle_at DESC, battle_id) FILTER (WHERE region_id IS NOT NULL) AS region_id,
      first(language ORDER BY battle_at DESC, battle_id) FILTER (WHERE language IS NOT NULL) AS language, max(battle_at) AS latest_battle,
      first(power ORDER BY battle_at DESC, battle_id) AS power FROM sides GROUP BY player_id)""",
    "swr": "swr AS (SELECT s.*, region_id, wins + losses AS total_plays FROM stats s JOIN players USING (player_id))",
    "reg": "reg AS (SELECT * FROM swr WHERE region_id IS NOT NULL)",
    "std": f"std AS ({_cells('standard')})",
    "ovr": f"ovr AS ({_cells('overall')})",
    "cells": "cells AS (SELECT * FROM std UNION ALL SELECT * FROM ovr)",
    "chars": _values("chars", CHARACTERS),
    "ranks": _values("ranks", RANKS),
    "types": _values("types", BATTLE_TYPES),
    "inserted": """inserted AS (SELECT * FROM raw WHERE batch_no IN (2, 3) AND battle_id NOT IN (SELECT battle_id FROM raw WHERE batch_no IN (0, 1, 2))
      QUALIFY row_number() OVER (PARTITION BY battle_id ORDER BY battle_at, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1)""",
    "totals": "totals AS (SELECT player_id, character_id, max(dan_rank) AS dan_rank, sum(wins + losses)::BIGINT AS total_plays FROM stats GROUP BY ALL)",
    "main": "main AS (SELECT * FROM totals QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY dan_rank DESC, total_plays DESC, character_id::INT) = 1)",
    "named": """named AS (SELECT player_id, m.character_id, m.dan_rank, coalesce(c.label, 'Undefined Character ID: ' || m.character_id) AS main_character, coalesce(r.label, 'Undefined DAN name') AS main_rank
      FROM main m LEFT JOIN chars c ON c.code = m.character_id LEFT JOIN ranks r ON r.code = m.dan_rank::VARCHAR)""",
    "matchups": """matchups AS (SELECT player_id, character_id, opp_character_id, count(*) FILTER (WHERE is_win) AS wins, count(*) FILTER (WHERE NOT is_win) AS losses, count(*) AS total,
      count(*) FILTER (WHERE is_win)::DOUBLE * 100 / count(*)::DOUBLE AS winrate FROM sides GROUP BY ALL)""",
    "bw": """bw AS (SELECT player_id, character_id, first(opponent ORDER BY winrate DESC, opponent) AS best_opponent, max(winrate) AS best_winrate,
      first(opponent ORDER BY winrate, opponent) AS worst_opponent, min(winrate) AS worst_winrate
      FROM (SELECT *, coalesce(label, 'Undefined Character ID: ' || opp_character_id) AS opponent FROM matchups LEFT JOIN chars ON code = opp_character_id WHERE total >= 3) GROUP BY ALL)""",
    "season": """season AS (SELECT player_id, character_id, first(dan_rank ORDER BY game_version DESC) FILTER (WHERE game_version >= 20001) AS current_season_rank,
      first(dan_rank ORDER BY game_version DESC) FILTER (WHERE game_version < 20001) AS previous_season_rank FROM stats GROUP BY ALL)""",
    "ctotals": """ctotals AS (SELECT player_id, character_id, sum(wins)::BIGINT AS wins, sum(losses)::BIGINT AS losses, sum(wins)::DOUBLE * 100 / sum(wins + losses)::DOUBLE AS winrate FROM stats GROUP BY ALL)""",
    "marks": """marks AS (SELECT min(battle_at) AS oldest_at, first(battle_id ORDER BY battle_at, battle_id) AS oldest_id, max(battle_at) AS newest_at,
      first(battle_id ORDER BY battle_at DESC, battle_id) AS newest_id FROM battles WHERE battle_type = 2)""",
    "pages": f"pages_ AS (SELECT ((newest_at - t) // {PAGE_STEP})::INT AS page_no, t AS page_end, t - {PAGE_WIDTH} AS page_start FROM (SELECT newest_at, unnest(range(newest_at, oldest_at - 1, -{PAGE_STEP})) AS t FROM marks))",
    "vw": f"""vw AS (SELECT game_version, character_id, {_tier()} AS rank_category, sum(total_wins)::BIGINT AS w, sum(total_wins + total_losses)::BIGINT AS n
      FROM cells WHERE category = 'standard' GROUP BY ALL)""",
    "vg": "vg AS (SELECT * FROM vw UNION ALL SELECT game_version, character_id, 'global', sum(w)::BIGINT, sum(n)::BIGINT FROM vw GROUP BY ALL)",
    "last2": "last2 AS (SELECT DISTINCT game_version FROM cells ORDER BY game_version DESC LIMIT 2)",
    "latest": f"""latest AS (SELECT {_tier()} AS rank_category, character_id, sum(total_wins)::BIGINT AS total_wins, sum(total_losses)::BIGINT AS total_losses, sum(total_replays)::BIGINT AS total_replays
      FROM cells WHERE category = 'standard' AND game_version = (SELECT max(game_version) FROM cells) GROUP BY ALL)""",
}

_RATE = "((w * 20000 + n) // (2 * n))"


def _levels(null_tier: str, having: str, extra: str) -> str:
    parts = []
    for tier in (False, True):
        for region in (False, True):
            t = _tier(null_tier) if tier else "'allRanks'"
            r = "region_id::VARCHAR" if region else "'Global'"
            parts.append(f"""SELECT game_version, character_id, {t} AS rank_category, {r} AS region, sum(total_wins)::BIGINT AS total_wins, sum(total_losses)::BIGINT AS total_losses{extra}
              FROM cells WHERE category = 'standard' GROUP BY game_version, character_id{', ' + t if tier else ''}{', region_id' if region else ''} {having if region or null_tier == 'beginner' else ''}""")
    return " UNION ALL ".join(parts)


def _changes(rates: str, k: int | None) -> str:
    cut = f"QUALIFY row_number() OVER (PARTITION BY rank_category, trend ORDER BY abs(delta) DESC, character_id::INT) <= {k}" if k else ""
    return f"""SELECT character_id, rank_category, abs(delta) / 100.0::DOUBLE AS change, trend FROM (
      SELECT a.character_id, a.rank_category, {_RATE.replace('w', 'a.w').replace('(2 * n)', '(2 * a.n)').replace('+ n', '+ a.n')} - {_RATE.replace('w', 'b.w').replace('(2 * n)', '(2 * b.n)').replace('+ n', '+ b.n')} AS delta,
        CASE WHEN delta > 0 THEN 'increase' ELSE 'decrease' END AS trend
      FROM {rates} a JOIN {rates} b ON a.character_id = b.character_id AND a.rank_category = b.rank_category AND a.game_version > b.game_version
      WHERE a.n > 0 AND b.n > 0 AND a.game_version IN (FROM last2) AND b.game_version IN (FROM last2)) WHERE delta <> 0 {cut}"""


def _search(q: str) -> str:
    low, bare = q.lower(), q.lower().replace("-", "")
    return f"""SELECT player_id, name, polaris_id, CASE WHEN length(polaris_id) >= 12 THEN concat(polaris_id[1:4], '-', polaris_id[5:8], '-', polaris_id[9:]) ELSE polaris_id END AS formatted_id,
      coalesce(region_id, -1) AS region_id, coalesce(main_character, 'No Character Data') AS main_character, coalesce(main_rank, 'N/A') AS main_rank
      FROM (SELECT * FROM players WHERE contains(lower(name), '{low}') OR contains(lower(polaris_id), '{bare}')
            ORDER BY CASE WHEN lower(name) = '{low}' THEN 0 WHEN starts_with(lower(name), '{low}') THEN 1 ELSE 20 END, length(name), name, player_id LIMIT 20) LEFT JOIN named USING (player_id)"""


_BATTLE = "battle_id, battle_at, battle_type, game_version, " + ", ".join(f"player{k}_{c}" for k in (1, 2) for c in ("name", "polaris_id", "character_id", "region", "power", "dan_rank", "rounds_won")) + ", winner, stageid"
_FORMAT = "CASE WHEN length(polaris_id) >= 12 THEN concat(polaris_id[1:4], '-', polaris_id[5:8], '-', polaris_id[9:]) ELSE polaris_id END"


def _checks() -> str:
    unique = lambda t, k: f"SELECT '{t[0]}' AS table_name, 'unique({k})' AS constraint_name, count(*)::BIGINT AS violations FROM (SELECT {k} FROM {t[1]} GROUP BY ALL HAVING count(*) > 1)"
    null = lambda t, c: f"SELECT '{t}', 'not_null({c})', count(*) FILTER (WHERE {c} IS NULL) FROM {t}"
    parts = [unique(("raw_battles", "raw"), "battle_id"), unique(("battles", "battles"), "battle_id"), unique(("character_stats", "stats"), "player_id,character_id,game_version"), unique(("players", "players"), "player_id")]
    parts += [null("battles", c) for c in ("battle_at", "game_version", "player1_id", "player2_id", "player1_region", "player2_region", "winner")] + [null("players", c) for c in ("region_id", "name")]
    parts.append("SELECT 'character_stats', 'foreign(player_id)', count(*) FROM stats WHERE player_id NOT IN (SELECT player_id FROM players)")
    return " UNION ALL ".join(parts)


_HEAD = "player_id, name, region_id, polaris_id, power, latest_battle"

_SELECT: dict[str, str] = {
    "dedupe_battles": "SELECT battle_id, battle_at, battle_type, game_version, player1_id, player2_id, winner, stageid, batch_no FROM battles",
    "battle_sides": "SELECT battle_id, side, battle_at, battle_type, game_version, player_id, character_id, region_id, dan_rank, power, rating_before, rating_change, rounds_won, opp_player_id, opp_character_id, opp_dan_rank, is_win FROM allsides",
    "insert_new_battles": "SELECT battle_id, battle_at, battle_type, game_version, winner FROM inserted",
    "affected_versions": "SELECT DISTINCT game_version FROM inserted WHERE battle_type = 2",
    "player_name_history": "SELECT player_id, name, min(battle_at) AS first_seen, max(battle_at) AS last_seen FROM sides WHERE name IS NOT NULL GROUP BY ALL",
    "constraint_report": _checks(),
    "battle_history": f"SELECT lpad(p, 18, '0') AS player_id, {_BATTLE} FROM (SELECT *, unnest([player1_id, player2_id]) AS p FROM battles)",
    "water_marks": "SELECT * FROM marks",
    "backfill_pages": "SELECT page_no, page_end, page_start FROM pages_",
    "page_coverage": "SELECT page_no, page_start, page_end, count(battle_id) AS battles FROM pages_ LEFT JOIN battles ON battle_at > page_start AND battle_at <= page_end GROUP BY ALL",
    "upsert_players": "SELECT * FROM players",
    "upsert_character_stats": "SELECT * FROM stats",
    "rebuild_character_stats": "SELECT * FROM stats",
    "replace_counts": """SELECT player_id, character_id, game_version, CASE WHEN o.wins IS NULL THEN s.dan_rank ELSE o.dan_rank END AS dan_rank, CASE WHEN o.wins IS NULL THEN s.latest_battle ELSE o.latest_battle END AS latest_battle,
      s.wins, s.losses FROM stats s LEFT JOIN old o USING (player_id, character_id, game_version)""",
    "reconcile_character_stats": """SELECT player_id, character_id, game_version, o.wins AS stored_wins, o.losses AS stored_losses, s.wins AS rebuilt_wins, s.losses AS rebuilt_losses
      FROM stats s LEFT JOIN old o USING (player_id, character_id, game_version) WHERE o.wins IS NULL OR o.wins <> s.wins OR o.losses <> s.losses""",
    "latest_rank": """SELECT player_id, character_id, first(dan_rank ORDER BY battle_at DESC, battle_id) AS dan_rank, first(power ORDER BY battle_at DESC, battle_id) AS power, max(battle_at) AS battle_at FROM sides GROUP BY ALL""",
    "stats_summary": "SELECT count(*) FILTER (WHERE battle_type = 2) AS total_ranked_replays, count(*) FILTER (WHERE battle_type <> 2) AS total_unranked_replays, (SELECT count(*) FROM players) AS total_players FROM battles",
    "stats_with_region": "SELECT * FROM swr",
    "main_character_by_version": "SELECT * FROM reg QUALIFY row_number() OVER (PARTITION BY player_id, game_version ORDER BY dan_rank DESC, total_plays DESC, character_id::INT) = 1",
    "build_cells": "SELECT * FROM cells",
    "cells_standard": "SELECT * FROM std",
    "cells_overall": "SELECT * FROM ovr",
    "game_versions": "SELECT DISTINCT game_version FROM cells",
    "latest_two_versions": "SELECT * FROM last2",
    "popularity_levels": _levels("NULL", "HAVING sum(total_replays) > 0", ", sum(total_replays)::BIGINT AS total_replays"),
    "winrate_levels": f"SELECT *, total_wins::DOUBLE * 100 / (total_wins + total_losses)::DOUBLE AS winrate FROM ({_levels('beginner', 'HAVING sum(total_wins + total_losses) > 0', '')})",
    "rank_distribution": """SELECT c.game_version, c.category, dan_rank, sum(total_players)::DOUBLE * 100 / t.total::DOUBLE AS percentage
      FROM cells c JOIN (SELECT game_version, category, sum(total_players)::BIGINT AS total FROM cells GROUP BY ALL) t ON c.game_version = t.game_version AND c.category = t.category GROUP BY c.game_version, c.category, dan_rank, t.total""",
    "top_popularity": "SELECT rank_category, character_id, total_replays, row_number() OVER (PARTITION BY rank_category ORDER BY total_replays DESC, character_id::INT)::INT AS rank FROM latest WHERE total_replays > 0 QUALIFY rank <= 5",
    "top_winrates": """SELECT rank_category, character_id, total_wins, total_losses, ((total_wins * 20000 + total_wins + total_losses) // (2 * (total_wins + total_losses))) / 100.0::DOUBLE AS winrate,
      row_number() OVER (PARTITION BY rank_category ORDER BY total_wins::DOUBLE * 100 / (total_wins + total_losses)::DOUBLE DESC, character_id::INT)::INT AS rank FROM latest WHERE total_wins + total_losses > 0 QUALIFY rank <= 5""",
    "version_winrates": f"SELECT game_version, character_id, rank_category, {_RATE} / 100.0::DOUBLE AS winrate FROM vw",
    "version_winrates_global": f"SELECT game_version, character_id, rank_category, {_RATE} / 100.0::DOUBLE AS winrate FROM vg WHERE game_version IN (FROM last2)",
    "winrate_changes_top": _changes("vw", 2),
    "winrate_changes_all": _changes("vg", None),
    "main_character_overall": "SELECT * FROM main",
    "recent_character": """SELECT player_id, first(character_id ORDER BY latest_battle DESC, game_version DESC, character_id::INT) AS character_id,
      first(dan_rank ORDER BY latest_battle DESC, game_version DESC, character_id::INT) AS dan_rank, max(latest_battle) AS latest_battle FROM stats GROUP BY player_id""",
    "player_matchups": "SELECT * FROM matchups",
    "best_worst_matchups": "SELECT * FROM bw",
    "player_character_totals": "SELECT * FROM ctotals",
    "season_ranks": "SELECT * FROM season",
    "player_metadata": """SELECT player_id, name, region_id, polaris_id, strftime(to_timestamp(latest_battle) AT TIME ZONE 'UTC', '%m/%d/%Y %H:%M') AS latest_battle_date, power, main_character, main_rank
      FROM players LEFT JOIN named USING (player_id)""",
    "player_search": _search(SEARCH),
    "player_search_by_id": _search(SEARCH_ID),
    "recently_active": """SELECT p.player_id, p.name, p.polaris_id, p.region_id, p.power, p.latest_battle AS last_seen, coalesce(c.label, 'Undefined Character ID: ' || r.character_id) AS recent_character,
      coalesce(k.label, 'Undefined DAN name') AS recent_rank
      FROM (SELECT * FROM players WHERE latest_battle > (SELECT max(latest_battle) FROM players) - 604800 ORDER BY latest_battle DESC, player_id LIMIT 40) p
      JOIN (SELECT player_id, first(character_id ORDER BY latest_battle DESC, game_version DESC, character_id::INT) AS character_id, first(dan_rank ORDER BY latest_battle DESC, game_version DESC, character_id::INT) AS dan_rank
            FROM stats GROUP BY player_id) r USING (player_id) LEFT JOIN chars c ON c.code = r.character_id LEFT JOIN ranks k ON k.code = r.dan_rank::VARCHAR""",
    "leaderboard": """SELECT row_number() OVER (ORDER BY power DESC, player_id)::INT AS ranking, name, player_id, power, main_rank AS rank, main_character AS character
      FROM (SELECT * FROM players ORDER BY power DESC, player_id LIMIT 20) JOIN named USING (player_id)""",
    "resolve_player_ids": f"SELECT ' ' || {_FORMAT} AS asked, polaris_id, player_id, ltrim(player_id, '0') AS short_id FROM players WHERE length(polaris_id) <= 12",
    "player_profile": f"""SELECT {_HEAD}, main_character, main_rank, t.character_id, wins, losses, winrate, current_season_rank, previous_season_rank, best_opponent, best_winrate, worst_opponent, worst_winrate,
      coalesce(c.label, 'Undefined Character ID: ' || t.character_id) AS character
      FROM players JOIN (SELECT player_id, main_character, main_rank FROM named) USING (player_id) JOIN ctotals t USING (player_id) JOIN season USING (player_id, character_id) LEFT JOIN bw USING (player_id, character_id)
      LEFT JOIN chars c ON c.code = t.character_id""",
    "rank_tiers": f"SELECT DISTINCT dan_rank, {_tier()} AS tier, {_tier('beginner')} AS tier_or_beginner FROM sides",
    "named_characters": "SELECT character_id, count(*) AS sides, coalesce(label, 'Undefined Character ID: ' || character_id) AS name FROM sides LEFT JOIN chars ON code = character_id GROUP BY character_id, label",
    "format_ids": f"SELECT player_id, ltrim(player_id, '0') AS short_id, {_FORMAT} AS formatted_id FROM players",
    "battle_dates": """SELECT battle_id, strftime(to_timestamp(battle_at) AT TIME ZONE 'UTC', '%m/%d/%Y %H:%M:%S UTC') AS date, strftime(to_timestamp(battle_at) AT TIME ZONE 'UTC', '%m/%d/%Y %H:%M') AS minute FROM battles""",
    "battle_type_names": "SELECT battle_type, label AS battle_type_name, count(*) AS battles FROM battles JOIN types ON code = battle_type::VARCHAR GROUP BY ALL",
    "valid_player_ids": f"""SELECT id, regexp_full_match(trim(id), '[A-Za-z0-9]+') AND length(trim(id)) <= 12 AS valid FROM (SELECT unnest([polaris_id, {_FORMAT}, polaris_id || '9']) AS id FROM (SELECT DISTINCT polaris_id FROM sides))""",
}


def _names(sql: str) -> set[str]:
    import re

    return {w for w in re.findall(r"\b[a-z_0-9]+\b", sql)}


def _full(sql: str) -> str:
    """The statement after the common tables that it needs, in order."""
    label = {k: v.split(" ", 1)[0].split("(", 1)[0] for k, v in _BASE.items()}
    need, todo = set(), [sql]
    while todo:
        words = _names(todo.pop())
        for k, name in label.items():
            if k not in need and name in words:
                need.add(k)
                todo.append(_BASE[k])
    parts = [v for k, v in _BASE.items() if k in need]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql


ORACLES: dict[str, str] = {name: _full(sql) for name, sql in _SELECT.items()}
