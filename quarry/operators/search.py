"""Inverted index and conjunctive substring search (F3, A1, P8, J6, J7, T1, T2,
P9, P10).

Plan shape at scale:

* ``postings``: records dealt to tasks of bounded size, one native projection
  + explode, one shuffle on ``(term, id)`` for the distinct (hash on both
  columns, so a hot term such as ``medium`` is spread over all reducers).
* *Dictionary*: with the index goes a table from character bigrams (and single
  characters) to the terms that hold them, in folders by a hash of the bigram
  and sorted inside, and the number of terms of each bigram. Any term that
  contains a word holds the word's rarest bigram.
* ``search_query``: one word reads one folder of the dictionary, pruned while
  planning, and of it the row groups of one bigram; matched terms then
  equi-join the postings. Without a dictionary (an index that is not stored) the
  words meet the *distinct vocabulary* in a broadcast nested-loop join.
* ``search_batch``: a table of queries can be large, so substring matching
  runs as an equi-join on the word's rarest bigram, with the stored dictionary
  or one made from the vocabulary, and is verified with ``contains``; each query
  then starts from the ids of its rarest word.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import normalize_word, split_words
from quarry.sources import store

MIN_TERM_LEN = 2
#: Folders of the dictionary.
GRAM_FOLDERS = 64
#: Records whose terms one task explodes and holds, about.
RECORDS_PER_TASK = 50_000


class Dictionary(NamedTuple):
    """``grams (gram, term, folder)`` and ``sizes (gram, n_terms)``."""

    grams: DataFrame
    sizes: DataFrame


def index_terms(title="title", topic="topic", tags="tags", difficulty="difficulty", xp="xp",
                time_complexity="time_complexity", space_complexity="space_complexity"):
    """title words, topic words, whole tags, difficulty, str(xp) and both
    complexities, each normalised; terms shorter than 2 are dropped."""
    parts = F.concat(
        split_words(F.col(title)), split_words(F.col(topic)),
        F.transform(F.coalesce(F.col(tags), F.array().cast("array<string>")),
                    lambda t: F.coalesce(t, F.lit(""))),
        F.array(F.coalesce(F.col(difficulty), F.lit("")),
                F.coalesce(F.col(xp), F.lit(0)).cast("string"),
                F.coalesce(F.col(time_complexity), F.lit("")),
                F.coalesce(F.col(space_complexity), F.lit(""))))
    terms = F.transform(parts, lambda w: normalize_word(w))
    return F.array_distinct(F.filter(terms, lambda t: F.length(t) >= MIN_TERM_LEN))


def postings(records: DataFrame) -> DataFrame:
    """A1: long form ``(term, id)``, one row per distinct pair.

    The list form (term -> all ids) is deliberately not materialised: a term
    can cover a third of the corpus and must never become one row.

    The distinct holds the pairs of a task before its shuffle, and nearly all
    are distinct already: a compressed file of many records would be one task
    with all their pairs. So records are counted and dealt by a row number.
    """
    return (_spread(records).select(F.explode(index_terms()).alias("term"), F.col("id"))
            .dropDuplicates(["term", "id"]))


def _spread(records: DataFrame, key: str | None = None) -> DataFrame:
    """``records`` in tasks of about ``RECORDS_PER_TASK`` by ``key``, else by a
    row number, however its files are cut; as they are where one task is enough."""
    tasks = -(-records.count() // RECORDS_PER_TASK)
    if tasks <= 1:
        return records
    if key:
        return records.repartition(tasks, key)
    return records.withColumn("_row", F.monotonically_increasing_id()).repartition(tasks, "_row").drop("_row")


def search_summary(records: DataFrame) -> DataFrame:
    """The seven-field lookup record per id (defaults for missing fields)."""
    return records.select(
        "id",
        F.coalesce(F.col("title"), F.lit("")).alias("title"),
        F.coalesce(F.col("difficulty"), F.lit("")).alias("difficulty"),
        F.coalesce(F.col("tags"), F.array().cast("array<string>")).alias("tags"),
        F.coalesce(F.col("topic"), F.lit("")).alias("topic"),
        F.coalesce(F.col("xp"), F.lit(0)).cast("int").alias("xp"),
        F.coalesce(F.col("time_complexity"), F.lit("")).alias("time_complexity"),
        F.coalesce(F.col("space_complexity"), F.lit("")).alias("space_complexity"))


def query_words(spark: SparkSession, query: str) -> list[str]:
    """Normalised, distinct, non-empty words of one query (driver side, tiny)."""
    raw = (query or "").split()
    if not raw:
        return []
    df = spark.createDataFrame([(w,) for w in raw], "w string").select(normalize_word("w").alias("w"))
    out: list[str] = []
    for r in df.collect():  # bounded by the query text
        if r.w and r.w not in out:
            out.append(r.w)
    return out


def _folder(gram: str) -> int:
    """Driver-side twin of the ``folder`` column of the dictionary."""
    return zlib.crc32(gram.encode()) % GRAM_FOLDERS


def _grams_of(word: str) -> set[str]:
    return {word[i:i + 2] for i in range(len(word) - 1)} or {word}


def dictionary_terms(dictionary: Dictionary, words: list[str]) -> DataFrame | None:
    """(word, term): terms that contain each of ``words``; None where some word
    holds a bigram that no term has, so that nothing can match all words.

    Each word's lookup is a plan of its own over the folder of its rarest bigram.
    """
    asked = sorted(set().union(*map(_grams_of, words)))
    sizes = {r["gram"]: r["n_terms"]  # bounded by the query
             for r in dictionary.sizes.where(F.col("gram").isin(asked)).collect()}
    if len(sizes) < len(asked):
        return None
    found = None
    for word in words:
        gram = min(_grams_of(word), key=lambda g: (sizes[g], g))
        own = (dictionary.grams.where((F.col("folder") == _folder(gram)) & (F.col("gram") == gram)
                                      & F.col("term").contains(word))
               .select(F.lit(word).alias("word"), "term"))
        found = own if found is None else found.unionByName(own)
    return found


def _vocabulary_terms(spark: SparkSession, post: DataFrame, words: list[str]) -> DataFrame:
    wdf = F.broadcast(spark.createDataFrame([(w,) for w in words], "word string"))
    return post.select("term").distinct().join(wdf, F.col("term").contains(F.col("word"))).select("word", "term")


def matching_ids(spark: SparkSession, post: DataFrame, query: str, dictionary: Dictionary | None = None) -> DataFrame:
    """J7 + T1: ids whose terms contain every query word (substring match).

    ``dictionary`` must be that of ``post``; it changes what is read, not what
    is found."""
    words = query_words(spark, query)
    matched = None
    if words:
        matched = dictionary_terms(dictionary, words) if dictionary else _vocabulary_terms(spark, post, words)
    if matched is None:
        return spark.createDataFrame([], "id string")
    hits = matched.join(post, "term").select("word", "id").distinct().groupBy("id").agg(F.count("*").alias("n"))
    return hits.where(F.col("n") == len(words)).select("id")


def search_query(spark: SparkSession, post: DataFrame, summary: DataFrame, query: str,
                 dictionary: Dictionary | None = None) -> DataFrame:
    """Matched ids joined to their summary; ids without a summary drop.

    The summary is joined sorted, in partitions by its number of rows: its
    files can be small enough for a broadcast that each task then holds, or for
    a few partitions, and yet have very many rows."""
    return matching_ids(spark, post, query, dictionary).join(_spread(summary, "id").hint("merge"), "id")


def result_lines(df: DataFrame) -> DataFrame:
    """P10: the four display lines of a search hit, joined by newlines."""
    line = F.concat_ws(
        "\n",
        F.format_string("[%s] %s (%s, %s XP)", "id", "title", "difficulty", F.col("xp").cast("string")),
        F.concat(F.lit("  Topic: "), F.col("topic")),
        F.concat(F.lit("  Tags: "), F.array_join("tags", ", ")),
        F.concat(F.lit("  Complexity: "), F.col("time_complexity"), F.lit(" | "), F.col("space_complexity")))
    return df.withColumn("line", line)


def _pad(c, width: int):
    """Left-justify to at least ``width`` characters, never truncating."""
    return F.when(F.length(c) >= width, c).otherwise(F.rpad(c, width, " "))


def problem_listing(records: DataFrame) -> DataFrame:
    """Fixed-width listing rows (the total is ``store_count``, one
    aggregate; it is not repeated on every row)."""
    row = F.concat_ws(" | ",
                      _pad(F.coalesce(F.col("id"), F.lit("")), 10),
                      _pad(F.substring(F.coalesce(F.col("title"), F.lit("")), 1, 28), 30),
                      _pad(F.coalesce(F.col("difficulty"), F.lit("")), 10),
                      _pad(F.substring(F.coalesce(F.col("topic"), F.lit("")), 1, 18), 20))
    return records.select("id", row.alias("row"))


def _bigrams(c):
    """Distinct character bigrams of a string (empty for length < 2)."""
    n = F.length(c)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(c, i, 2))))


def term_grams(vocab: DataFrame) -> DataFrame:
    """(gram, term): the distinct bigrams and characters of each distinct term."""
    term = F.col("term")
    chars = F.transform(F.sequence(F.lit(1), F.length(term)), lambda i: F.substring(term, i, 1))
    pieces = F.array_distinct(F.concat(_bigrams(term), chars))
    return (vocab.select("term").where(F.length(term) > 0).distinct()
            .select(F.explode(pieces).alias("gram"), "term"))


def gram_sizes(grams: DataFrame) -> DataFrame:
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n_terms"))


def _folder_of(gram: str) -> Column:
    return F.pmod(F.crc32(F.col(gram)), F.lit(GRAM_FOLDERS)).cast("int")


def matching_terms(words: DataFrame, vocab: DataFrame, dictionary: Dictionary | None = None) -> DataFrame:
    """(word, term): terms of ``vocab`` that contain each of ``words``.

    An equi-join on a piece of the word that every such term has: the one of
    its bigrams that fewest terms hold (a single character: itself). Words
    with a bigram in no term match nothing and drop out here. A stored
    ``dictionary`` stands for ``vocab``, whose bigrams are made anew otherwise.
    """
    if dictionary is None:
        held = term_grams(vocab)
        sizes = gram_sizes(held)
    else:
        held, sizes = dictionary
    own = F.when(F.length("word") >= 2, _bigrams(F.col("word"))).otherwise(F.array("word"))
    key = (words.select("word", F.explode(own).alias("gram")).join(sizes, "gram", "left")
           .groupBy("word").agg(F.min(F.struct(F.coalesce("n_terms", F.lit(0)).alias("n"), "gram")).alias("least"))
           .where("least.n > 0").select("word", F.col("least.gram").alias("gram")))
    on = ["gram"]
    if dictionary is not None:
        key, on = key.withColumn("folder", _folder_of("gram")), ["folder", "gram"]
    return key.join(held, on).where(F.col("term").contains(F.col("word"))).select("word", "term")


def search_batch(post: DataFrame, summary: DataFrame, queries: DataFrame,
                 query_id="query_id", text="query", dictionary: Dictionary | None = None) -> DataFrame:
    """Conjunctive search for a whole table of queries in one plan.

    Output ``(query_id, id, ...summary)``. Matching (word, term) pairs are
    computed once for the distinct words of all queries; each query starts
    from the ids of its rarest word, and the other words only check those.
    """
    qw = (queries.select(F.col(query_id).alias("query_id"),
                         F.explode(split_words(F.col(text))).alias("w"))
          .select("query_id", normalize_word("w").alias("word"))
          .where(F.col("word") != "").distinct())
    matched = matching_terms(qw.select("word").distinct(), post, dictionary)
    word_ids = matched.join(post, "term").select("word", "id").distinct()
    sizes = word_ids.groupBy("word").agg(F.count(F.lit(1)).alias("n_ids"))
    per_query = (qw.join(sizes, "word", "left").groupBy("query_id")
                 .agg(F.min(F.struct(F.coalesce("n_ids", F.lit(0)).alias("n_ids"), "word")).alias("rarest"),
                      F.count(F.lit(1)).alias("n_words"))
                 .where("rarest.n_ids > 0").select("query_id", F.col("rarest.word").alias("word"), "n_words"))
    start = per_query.join(word_ids, "word").select("query_id", F.col("word").alias("first"), "n_words", "id")
    others = (start.join(qw, "query_id").where(F.col("word") != F.col("first"))
              .join(word_ids, ["word", "id"], "left_semi")
              .groupBy("query_id", "id").agg((F.count(F.lit(1)) + 1).alias("n")))
    alone = start.where("n_words = 1").select("query_id", "id")
    all_words = (others.join(per_query.select("query_id", "n_words"), "query_id")
                 .where(F.col("n") == F.col("n_words")).select("query_id", "id"))
    return alone.unionByName(all_words).join(summary, "id")


POSTINGS_SCHEMA = "term string, id string"
SUMMARY_SCHEMA = ("id string, title string, difficulty string, tags array<string>, topic string, xp int, "
                  "time_complexity string, space_complexity string")


GRAMS_SCHEMA = "gram string, term string, folder int"
SIZES_SCHEMA = "gram string, n_terms long"
_TABLES = ["postings", "summary", "grams", "gram_sizes"]


def write_index(post: DataFrame, summary: DataFrame, base: str) -> None:
    """Postings range-sorted by term, the summary table and the dictionary
    of the terms, as Parquet.

    Each call writes a new version folder; readers take the newest one whose
    tables are all complete, so an index being rewritten stays readable. The
    dictionary is made from the postings as written. A bigram that very many
    terms hold fills several files of its folder.
    """
    spark = post.sparkSession
    used = store.version_numbers(spark, base)
    path = f"{base.rstrip('/')}/v={(used[-1] + 1 if used else 1):06d}"
    (post.repartitionByRange("term", "id").sortWithinPartitions("term", "id")
     .write.mode("errorifexists").parquet(f"{path}/postings"))
    summary.write.mode("errorifexists").parquet(f"{path}/summary")
    written = spark.read.schema(POSTINGS_SCHEMA).parquet(f"{path}/postings")
    order = ["folder", "gram", "term"]
    (term_grams(written).withColumn("folder", _folder_of("gram"))
     .repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("errorifexists").partitionBy("folder").parquet(f"{path}/grams"))
    grams = spark.read.schema(GRAMS_SCHEMA).parquet(f"{path}/grams")
    (gram_sizes(grams).repartitionByRange("gram").sortWithinPartitions("gram")
     .write.mode("errorifexists").parquet(f"{path}/gram_sizes"))


def _newest(spark: SparkSession, base: str) -> list[str]:
    """Paths of the tables of the newest complete version; none: empty."""
    for v in reversed(store.version_numbers(spark, base)):
        paths = [f"{base.rstrip('/')}/v={v:06d}/{t}" for t in _TABLES]
        if all(store.committed(spark, p) for p in paths):
            return paths
    return []


def read_index(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """Postings and summary of the newest complete index; none reads as empty."""
    return open_index(spark, base)[:2]


def open_index(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame, Dictionary]:
    """Postings, summary and dictionary, all of one version: the newest complete
    one. None reads as empty tables."""
    schemas = [POSTINGS_SCHEMA, SUMMARY_SCHEMA, GRAMS_SCHEMA, SIZES_SCHEMA]
    paths = _newest(spark, base)
    if paths:
        post, summary, grams, sizes = (spark.read.schema(s).parquet(p) for s, p in zip(schemas, paths))
    else:
        post, summary, grams, sizes = (spark.createDataFrame([], s) for s in schemas)
    return post, summary, Dictionary(grams, sizes)
