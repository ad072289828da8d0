"""Classes of texts by a dictionary of terms, as a join of word runs with a table.

A text's runs of one to as many words as the longest term has are joined with the terms by equality; the term of the least place gives the
class. The work does not grow with the dictionary, and a run that is no term ends where it is made, as SENT terms at most are sent along to
all tasks; more are joined by a shuffle. Places are those of a table in its order, so the result is that of trying one term after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyloom.functions import lexicons as L
from storyloom.functions.text import family
from storyloom.operators.similarity import _STATE_SQL, TOPICS, topic_of
from storyloom.registry import register
from storyloom.sources.pages import _HOST, domain

#: Terms that are sent to all tasks, at most.
SENT = 10_000


def terms_table(spark: SparkSession, rows: list[list[str]]) -> DataFrame:
    """(term, class, place, words) of rows [class, term, ...]; terms in normal form, the first row that has a term names its class."""
    found: dict[str, tuple] = {}
    place = 0
    for name, *terms in rows:
        for term in terms:
            plain = " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in term.lower()).split())
            if plain:
                found.setdefault(plain, (plain, name, place, len(plain.split())))
                place += 1
    return spark.createDataFrame(list(found.values()), "term string, class string, place int, words int")


def first_class(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, class) for each row of texts (id, text): that of the term with the least place, null if no term stands in the text."""
    longest, many = terms.agg(F.coalesce(F.max("words"), F.lit(0)), F.count("*")).first()
    if not longest:
        return texts.select("id", F.lit(None).cast("string").alias("class"))
    # Cut at what is no word rather than put into normal form, which takes several times as long on whole texts; empty words are at the ends only.
    # Each length from the one before, by one pass over the words; what stands past the end is null, and no term is null or has an empty word.
    runs = texts.select("id", F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+").alias("run1"))
    for n in range(2, longest + 1):
        runs = runs.withColumn(f"run{n}", F.zip_with(f"run{n - 1}", F.slice("run1", n, F.size("run1")), lambda a, b: F.concat(a, F.lit(" "), b)))
    runs = runs.select("id", F.explode(F.array_distinct(F.concat(*(f"run{n}" for n in range(1, longest + 1))))).alias("term"))
    # Spark knows no size of rows made on the driver, and would shuffle the runs of all texts.
    hits = runs.join(F.broadcast(terms) if many <= SENT else terms, "term").groupBy("id").agg(F.min_by("class", "place").alias("class"))
    return texts.select("id").join(hits, "id", "left")


def source_families(url: Column) -> Column:
    return family(domain(url))


def geo_topic_tagging(articles: DataFrame, terms: DataFrame, topics: list[tuple[str, str]]) -> DataFrame:
    """(id, state, topic, family, n_state_topic, n_state_family) of articles (id, title, summary, url): state by dictionary, topic by the first
    pattern, the publisher of the url, and how many articles share the state and the topic, and the state and the publisher."""
    text = F.concat_ws(" ", "title", "summary")
    rows = articles.select("id", text.alias("text"), source_families(F.col("url")).alias("family"))
    tagged = rows.select("id", topic_of(F.col("text"), topics).alias("topic"), "family").join(first_class(rows.select("id", "text"), terms).withColumnRenamed("class", "state"), "id")
    by_topic = tagged.groupBy(F.col("state").alias("s1"), F.col("topic").alias("t1")).agg(F.count("*").alias("n_state_topic"))
    by_family = tagged.groupBy(F.col("state").alias("s2"), F.col("family").alias("f2")).agg(F.count("*").alias("n_state_family"))
    out = tagged.join(by_topic, F.col("state").eqNullSafe(F.col("s1")) & F.col("topic").eqNullSafe(F.col("t1"))).join(by_family, F.col("state").eqNullSafe(F.col("s2")) & F.col("family").eqNullSafe(F.col("f2")))
    return out.select("id", "state", "topic", "family", "n_state_topic", "n_state_family")


_TOPIC_SQL = f"CASE {' '.join(f'''WHEN regexp_matches(lower(title), '{p}') THEN '{n}' ''' for n, p in TOPICS)} ELSE 'general' END"
register(
    "geo_state", "v_articles", lambda a: first_class(a.select("id", F.concat_ws(" ", "title", "summary").alias("text")), terms_table(a.sparkSession, L.DATA["states"])).withColumnRenamed("class", "state"),
    f"SELECT id, {_STATE_SQL} AS state FROM (SELECT id, concat_ws(' ', title, summary) AS title FROM v_articles)",
)
register(
    "geo_topic_tagging", "v_articles", lambda a: geo_topic_tagging(a, terms_table(a.sparkSession, L.DATA["states"]), TOPICS),
    f"""WITH a AS (SELECT id, concat_ws(' ', title, summary) AS title, array_to_string(string_split({_HOST}, '.')[CASE WHEN {_HOST} LIKE '%.co.uk' THEN -3 ELSE -2 END:], '.') AS family FROM v_articles),
    t AS (SELECT id, {_STATE_SQL} AS state, {_TOPIC_SQL} AS topic, family FROM a)
    SELECT *, count(*) OVER (PARTITION BY state, topic) AS n_state_topic, count(*) OVER (PARTITION BY state, family) AS n_state_family FROM t""",
)
