"""Substring search without a scan: posting lists of trigrams, intersected rarest first, candidates verified.

An index is two written tables.  `postings` has, for each trigram of the lower-cased words of a row, blocks of sorted ids, in folders by the trigram's hash, so a query reads the folders of its own trigrams and in them only matching row groups.  `texts` has the lower-cased fields by block.  A block holds some BLOCK ids whatever the number of rows: a common trigram is many bounded lists, and intersections go block by block in as many tasks as there are blocks.  Only words of three letters and more choose candidates; a query of shorter ones reads all texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK, FOLDERS = 10_000, 64
#: Trigrams of a query that are intersected; the rest is left to the verification.
RAREST = 6


def _grams(word: str) -> list[str]:
    return [word[k : k + 3] for k in range(len(word) - 2)]


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


class SearchIndex:
    def __init__(self, spark: SparkSession, path: str, fields: list[str], id_: str):
        self.spark, self.path, self.fields, self.id = spark, path, fields, id_

    @classmethod
    def build(cls, df: DataFrame, id_: str, fields: list[str], path: str, block: int = BLOCK) -> SearchIndex:
        """Index the fields of df, whose ids are distinct; null fields are empty."""
        blocks = max(1, -(-df.count() // block))
        low = [F.lower(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f) for f in fields]
        rows = df.select(F.pmod(F.xxhash64(id_), F.lit(blocks)).cast("int").alias("block"), id_, *low).repartition("block")
        rows.write.partitionBy("block").parquet(f"{path}/texts")
        words = F.array_distinct(F.split(F.concat_ws(" ", *fields), r"\s+"))
        grams = F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: F.char_length(w) >= 3), lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))
        lists = rows.select("block", id_, F.explode(grams).alias("gram")).groupBy("gram", "block").agg(F.sort_array(F.collect_list(id_)).alias("ids"))
        lists = lists.withColumn("folder", _folder(F.col("gram"))).sortWithinPartitions("folder", "gram", "block")  # lists are made where their block is: no id is shuffled
        lists.write.partitionBy("folder").parquet(f"{path}/postings")
        return cls(df.sparkSession, path, fields, id_)

    def postings(self, grams: list[str]) -> DataFrame:
        """gram, block, ids of these trigrams only."""
        folders = [r[0] for r in self.spark.createDataFrame([(g,) for g in grams], "g string").select(_folder(F.col("g"))).distinct().collect()]
        return self.spark.read.parquet(f"{self.path}/postings").filter(F.col("folder").isin(folders) & F.col("gram").isin(grams)).drop("folder")

    def candidates(self, query: str) -> DataFrame | None:
        """block and id of the rows that hold the rarest trigrams of the query's words; None if no word has a trigram."""
        grams = sorted({g for w in query.lower().split() for g in _grams(w)})
        if not grams:
            return None
        sizes = {r["gram"]: r["n"] for r in self.postings(grams).groupBy("gram").agg(F.sum(F.size("ids")).alias("n")).collect()}  # a row a trigram of the query
        rarest = sorted(grams, key=lambda g: (sizes.get(g, 0), g))[:RAREST]
        lists = self.postings(rarest).groupBy("block").agg(F.sort_array(F.collect_list(F.struct(F.size("ids").alias("n"), "ids"))).alias("lists")).filter(F.size("lists") == len(rarest))
        both = F.aggregate(F.slice(F.col("lists"), 2, len(rarest)), F.element_at("lists", 1)["ids"], lambda held, x: F.array_intersect(held, x.ids))
        return lists.select("block", F.explode(both).alias(self.id))

    def _verified(self, query: str, test: Column) -> DataFrame:
        texts, found = self.spark.read.parquet(f"{self.path}/texts"), self.candidates(query)
        rows = texts if found is None else texts.join(found, ["block", self.id], "left_semi")
        return rows.filter(test).select(self.id)

    def all_words(self, query: str) -> DataFrame:
        """Ids of the rows in which every word of the query is somewhere; all rows for a blank query."""
        hay = F.concat_ws(" ", *self.fields)
        return self._verified(query, F.forall(F.array(*[F.lit(w) for w in query.lower().split()]), lambda w: F.contains(hay, w)) if query.split() else F.lit(True))

    def phrase(self, query: str) -> DataFrame:
        """Ids of the rows that have the query, as it is, inside one of their fields."""
        inside = F.lit(False)
        for f in self.fields:
            inside = inside | F.contains(F.col(f), F.lit(query.lower()))
        return self._verified(query, inside)
