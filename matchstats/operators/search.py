"""Player search by an inverted index of character trigrams.

Names and ids, in lower case, are cut into the three characters that start at each place, with two end marks behind. A
query of three characters or more can only be found where its rarest trigram is; a shorter one only where a trigram
starts with it, which is one range of the sorted postings. A posting carries what is needed to verify and to rank, so
players themselves are not read. Postings are partitioned by a hash of the first character and sorted by trigram, so a
query reads a few partitions and, in them, the row groups of its trigrams.

Cases: as for a scan with the same predicate. Null names and ids have no postings; a query of dashes alone, which any id
contains, is answered by a scan of the postings of ids.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .players import check_query, found_players, rank_search

#: Partitions of the postings.
HEADS = 256
_END = "\0\0"
_SHOWN = ["player_id", "name", "polaris_id", "region_id"]


def grams(text: str) -> list[str]:
    """Trigrams of a query of three characters or more."""
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


def head(gram: str) -> int:
    return zlib.crc32(gram[:1].encode()) % HEADS


def postings(players: DataFrame) -> DataFrame:
    """head, of (name or id), gram, and the columns of a result, one row for each distinct trigram of each text."""
    texts = F.array(*(F.struct(F.lit(of).alias("of"), F.lower(c).alias("text")) for of, c in (("name", "name"), ("id", "polaris_id"))))
    d = players.select(*_SHOWN, F.explode(texts).alias("t")).where("t.text IS NOT NULL")
    # an empty text has a posting of end marks
    all_places = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length("t.text"))), lambda i: F.substring(F.concat("t.text", F.lit(_END)), i, F.lit(3)))
    d = d.select(*_SHOWN, "t.of", F.explode(F.array_distinct(all_places)).alias("gram"))
    return d.withColumn("head", (F.crc32(F.substring("gram", 1, 1).cast("binary")) % HEADS).cast("int"))


@dataclass
class SearchIndex:
    """Written postings and the number of players of each trigram, in two folders under ``path``."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, players: DataFrame, path: str) -> SearchIndex:
        d = postings(players)
        # ranges of (head, gram): a first character that most names have is many tasks and files
        ranged = d.repartitionByRange("head", "of", "gram", "player_id").sortWithinPartitions("head", "of", "gram", "player_id")
        ranged.write.partitionBy("head").parquet(f"{path}/postings")
        index = cls(players.sparkSession, path)
        counts = index.postings.groupBy("head", "of", "gram").agg(F.count("*").alias("players"))
        counts.repartitionByRange("head", "of", "gram").sortWithinPartitions("head", "of", "gram").write.partitionBy("head").parquet(f"{path}/counts")
        return index

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.schema("player_id string, name string, polaris_id string, region_id int, of string, gram string, head int").parquet(f"{self.path}/postings")

    @property
    def counts(self) -> DataFrame:
        return self.spark.read.schema("of string, gram string, players long, head int").parquet(f"{self.path}/counts")

    def rarest(self, wanted: dict[str, str]) -> dict[str, str]:
        """Of each text of three characters or more, the trigram that fewest players have; a text with a trigram that none has is left out."""
        asked = {of: grams(text) for of, text in wanted.items() if len(text) >= 3}
        if not asked:
            return {}
        heads = sorted({head(g) for own in asked.values() for g in own})
        here = self.counts.where(F.col("head").isin(heads)).where(F.col("gram").isin(sorted({g for own in asked.values() for g in own})))
        found = {(r["of"], r["gram"]): r["players"] for r in here.collect()}  # the trigrams of one query
        return {of: min(own, key=lambda g: (found[of, g], g)) for of, own in asked.items() if all((of, g) in found for g in own)}

    def candidates(self, q: str) -> DataFrame:
        """The players whose name or id contains ``q``, once each."""
        check_query(q)
        wanted = {"name": q.lower(), "id": q.lower().replace("-", "")}
        rarest, parts = self.rarest(wanted), []
        for of, column in (("name", "name"), ("id", "polaris_id")):
            text = wanted[of]
            own: Column = F.col("of") == of
            if len(text) >= 3:
                if of not in rarest:
                    continue
                own = own & (F.col("head") == head(rarest[of])) & (F.col("gram") == rarest[of])
            elif text:
                own = own & (F.col("head") == head(text)) & F.col("gram").startswith(text)
            parts.append(own & F.lower(column).contains(text))
        d = self.postings
        d = d.where(parts[0] | parts[1] if len(parts) == 2 else parts[0] if parts else F.lit(False))
        return d.select(*_SHOWN).dropDuplicates(["player_id"])

    def search(self, stats: DataFrame, q: str, limit: int = 20) -> DataFrame:
        """As ``player_search`` over the players that the index was built from. The ``limit`` rows are found first; of ``stats``, only theirs are read."""
        found = rank_search(self.candidates(q), q, limit)
        rows = found.collect()  # ``limit`` rows
        return found_players(self.spark.createDataFrame(rows, found.schema), stats.where(F.col("player_id").isin([r["player_id"] for r in rows])), q)
