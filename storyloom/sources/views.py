"""Logical tables derived from the landed ones. Each is stated once, as SQL that differs between engines only by the helpers here."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"
STAR_AS_OF = "2001-12-01 00:00:00"
BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class SparkText:
    """How Spark SQL writes what differs between engines."""

    @staticmethod
    def ts(text: str) -> str:
        return f"TIMESTAMP_NTZ '{text}'"

    @staticmethod
    def hours(number: str) -> str:
        return f"make_interval(0, 0, 0, 0, CAST({number} AS INT))"

    @staticmethod
    def json(column: str, key: str) -> str:
        return f"get_json_object({column}, '$.{key}')"


class DuckText:
    """The same for DuckDB."""

    @staticmethod
    def ts(text: str) -> str:
        return f"TIMESTAMP '{text}'"

    @staticmethod
    def hours(number: str) -> str:
        return f"to_hours(CAST({number} AS BIGINT))"

    @staticmethod
    def json(column: str, key: str) -> str:
        return f"json_extract_string({column}, '$.{key}')"


def views(d: type) -> dict[str, str]:
    return {
        "v_sources": """SELECT source AS id, source AS name, concat(source, CASE WHEN k % 3 = 0 THEN '.example.org' WHEN k % 3 = 1 THEN '.example.net' ELSE concat('.paper', CAST(k % 4 AS STRING), '.co.uk') END) AS domain,
            CASE WHEN k % 4 = 0 THEN 'A' WHEN k % 4 = 1 THEN 'B' ELSE 'unknown' END AS tier,
            CASE WHEN k % 4 = 0 THEN 1.1e0 WHEN k % 4 = 1 THEN 1.0e0 ELSE 0.7e0 END AS weight
            FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INT) AS k FROM documents)""",
        "v_articles": f"""SELECT doc_id AS id, source AS source_id, lang,
            concat('https://', CASE WHEN doc_id % 5 = 0 THEN 'www.' ELSE '' END, source, '.example.org/', CASE WHEN doc_id % 13 = 0 THEN 'jobs/' WHEN doc_id % 17 = 0 THEN 'author/' ELSE '' END, lang, '/', CAST(doc_id % 700 AS STRING), CASE WHEN doc_id % 3 = 0 THEN '?utm_source=x&id=7#top' ELSE '' END) AS url,
            trim(regexp_extract(text, '^[^.\\n]*', 0)) AS title, text AS summary,
            {d.ts(AS_OF)} - {d.hours('doc_id % 720')} AS ts,
            CASE WHEN doc_id % 11 = 0 THEN 'non_article' WHEN doc_id % 11 = 1 THEN 'uncertain' WHEN doc_id % 11 = 2 THEN NULL ELSE 'article' END AS quality_label
            FROM documents""",
        "v_links": """SELECT md5(lower(title)) AS story_id, id AS article_id, ts, row_number() OVER (PARTITION BY md5(lower(title)) ORDER BY ts, id) = 1 AS is_primary FROM v_articles""",
        "v_stories": f"""SELECT md5(lower(title)) AS id, min(title) AS title, CASE WHEN max(id) % 41 = 0 THEN concat('Edited ', min(title)) END AS editor_title,
            CASE WHEN max(id) % 23 = 0 THEN concat('An editor wrote that this story is about ', min(title)) END AS editor_summary, CASE max(id) % 7 WHEN 0 THEN 'full' WHEN 1 THEN 'excerpt' WHEN 2 THEN 'headline_only' END AS preview_type,
            CASE WHEN max(id) % 7 < 2 THEN max(summary) END AS preview_text, CAST(max(id) % 10 AS DOUBLE) / 10 AS preview_confidence, CASE WHEN max(id) % 2 = 0 THEN 'chosen' END AS preview_reason, CASE WHEN max(id) % 29 = 0 THEN 'pinned' WHEN max(id) % 31 = 0 THEN 'hidden' WHEN max(id) % 37 = 0 THEN 'demoted' ELSE 'active' END AS status,
            min(summary) AS summary, CASE WHEN max(id) % 3 = 0 THEN CAST(max(id) % 100 AS INT) END AS homepage_rank, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS article_count FROM v_articles GROUP BY md5(lower(title))""",
        "star_links": """SELECT story_id, id AS article_id, title, source_id, ts, row_number() OVER (PARTITION BY story_id ORDER BY ts, id) = 1 AS is_primary FROM
            (SELECT DISTINCT l_orderkey AS story_id, concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(l_linenumber AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING)) AS id,
             p_name AS title, l_suppkey AS source_id, l_shipdate AS ts FROM lineitem JOIN part ON p_partkey = l_partkey)""",
        "star_sources": """SELECT s_suppkey AS id, s_name AS name, concat(lower(replace(s_name, '#', '-')), '.example.com') AS domain, CASE WHEN s_acctbal > 6000 THEN 1.2e0 WHEN s_acctbal > 2000 THEN 1.0e0 WHEN s_acctbal > 0 THEN 0.7e0 END AS weight FROM supplier""",
        "v_events": f"""SELECT event_id AS id, ts AS created_at, user_id, CASE event_type WHEN 'signup' THEN 'usage' WHEN 'purchase' THEN 'gate' WHEN 'error' THEN 'alert' WHEN 'click' THEN 'email' ELSE 'menu' END AS event_type,
            CAST({d.json('props', 'k')} AS INT) AS k, value FROM events""",
        "v_fetch_log": "SELECT event_id AS id, user_id % 20 AS feed_id, ts, event_type <> 'error' AS success, CASE WHEN event_type = 'error' THEN concat('error ', CAST(event_id % 7 AS STRING)) END AS error FROM events",
        "v_vectors": f"SELECT vec_id AS id, embedding, label, {d.ts(AS_OF)} - {d.hours('vec_id % 240')} AS ts FROM embeddings",
    }


#: Which views a view reads.
NEEDS = {"v_links": ["v_articles"], "v_stories": ["v_articles"]}


def _with(names: Iterable[str], d: type) -> str:
    wanted: list[str] = []
    for name in names:
        for x in [*NEEDS.get(name, []), name]:
            if x not in wanted:
                wanted.append(x)
    text = views(d)
    return ",\n".join(f"{n} AS ({text[n]})" for n in wanted)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a landed table, as a DataFrame."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _with([name], SparkText)
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if f" {t}" in text or f"({t}" in text}
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(f"WITH {text} SELECT * FROM {name}", **tables)


def duck(names: str, body: str) -> str:
    """A DuckDB statement over the named views."""
    body = body.strip()
    head = _with(names.split(), DuckText)
    if not head:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{body[14:]}"
    return f"WITH {head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head}\n{body}"
