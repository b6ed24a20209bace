"""Words of texts as stored postings, so that a query reads those of its own words and not every text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.checkpoint import cut


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def asked_terms(query: str) -> list[str]:
    return sorted({w for w in "".join(c if c.isalnum() else " " for c in query.lower()).split()})


class Postings:
    """(term, key, length, tf) of every text's words, stored in ranges of terms, and one row of totals.

    Files hold ranges of terms in order, so that a filter on terms skips most of them by their statistics; a term that many
    texts have is several files.
    """

    def __init__(self, rows: DataFrame, key: str, text: str):
        self.key = key
        words = rows.select(key, terms(F.col(text)).alias("w")).withColumn("length", F.size("w"))
        self.totals = cut(words.agg(F.count("*").alias("n"), F.avg("length").alias("mean")))
        each = words.select(F.explode("w").alias("term"), key, "length").groupBy("term", key, "length").agg(F.count("*").cast("int").alias("tf"))
        self.table = cut(each.repartitionByRange("term", key).sortWithinPartitions("term", key))

    def frequencies(self, query: str) -> tuple[list[str], DataFrame]:
        """The query's terms, and (key, length, tf0, tf1, ..., df0, df1, ..., n, mean) of the rows that hold any."""
        asked = asked_terms(query)
        held = self.table.where(F.col("term").isin(asked)) if asked else self.table.limit(0)
        is_term = lambda i: F.col("term") == F.lit(asked[i])
        each = range(len(asked))
        wide = held.groupBy(self.key, "length").agg(*(F.coalesce(F.max(F.when(is_term(i), F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i in each), F.count("*").alias("_held")).drop("_held")
        counts = held.agg(*(F.count_if(is_term(i)).alias(f"df{i}") for i in each), F.count("*").alias("_all")).drop("_all")
        return asked, wide.crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(self.totals))  # one row each
