"""Counting words of a dated lexicon and the change signals made from the counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import stage


def cohort_counts(docs: DataFrame, vocabulary: DataFrame, lexicon: DataFrame, *, ident: list[str], text: str) -> tuple[DataFrame, DataFrame]:
    """((ident..., n_words), (ident..., category, kind, year, cnt)).

    Words are runs of ASCII letters; only those of the vocabulary count as words.  Counts stay long,
    a row per cohort that occurs, so a lexicon of any number of cohorts needs no new columns.
    Documents without a vocabulary word have no row; null texts none either.
    """
    words = docs.select(*ident, F.explode(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))).alias("w")).withColumn("word", F.upper("w"))
    # counted per document first: the join then sees each distinct word once
    seen = stage(words.groupBy(*ident, "word").agg(F.count(F.lit(1)).alias("c")).join(vocabulary.select("word").distinct(), "word"), "words")  # texts are read once
    totals = seen.groupBy(*ident).agg(F.sum("c").alias("n_words"))
    cohorts = seen.join(lexicon, "word").groupBy(*ident, "category", "kind", "year").agg(F.sum("c").alias("cnt"))
    return totals, cohorts


def active(kind: Column, year: Column, at: Column | None) -> Column:
    """Whether a cohort is in force in a year: added before it, or removed in it or later; without a
    year, the latest list: additions only."""
    if at is None:
        return kind == "a"
    return F.when(kind == "a", year < at).otherwise(at <= year)


def shares(totals: DataFrame, cohorts: DataFrame, years: DataFrame, *, ident: list[str]) -> DataFrame:
    """(ident..., year_at, category, share): share of a category's words under the list of ``year_at``.

    ``years`` is (ident..., year_at, category), one row per wanted share; null without words.
    """
    live = F.sum(F.when(active(F.col("kind"), F.col("year"), F.col("year_at")), F.col("cnt")).otherwise(0))
    hits = years.join(cohorts, [*ident, "category"], "left").groupBy(*ident, "year_at", "category").agg(F.coalesce(live, F.lit(0)).alias("hits"))
    n = F.when(F.col("n_words") > 0, F.col("n_words"))
    return hits.join(totals, ident, "left").select(*ident, "year_at", "category", (F.col("hits") / n).alias("share"), "n_words")
