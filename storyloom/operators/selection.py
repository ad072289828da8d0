"""Choosing and ordering stories for an edition: penalties and collapses as joins and windows, the sequential rules on bounded pools.

The greedy rules depend on what was chosen before. They run as one grouped map for each edition, on a pool that was cut to `pool` rows by
a top-k first; editions run in parallel and no task holds more than one pool.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.functions import lexicons as L
from storyloom.functions.text import normal
from storyloom.operators.filters import DATA_AUDIENCE, audiences
from storyloom.operators.graphs import stored
from storyloom.operators.scoring import BOARD, DATA_LEXICON, HOME_SQL, board, board_sql, story_ranking
from storyloom.operators.similarity import TOPIC_PAIR_SQL, TOPICS, data_topical, overlap_pairs, state_of, topic_of
from storyloom.registry import register

SIMILAR, STRONG = 0.4, 0.58


def prior_overlap_penalty(ranked: DataFrame, pairs: DataFrame) -> DataFrame:
    """ranked (id, pos, score, pinned, and edition if there are several lists) with scores cut by the largest overlap with any story
    ranked before; pairs (i, j, ratio)."""
    list_of = [c for c in ranked.columns if c == "edition"]
    both = pairs.select("i", "j", "ratio").union(pairs.select("j", "i", "ratio"))
    at = ranked.select(*list_of, F.col("id").alias("j"), F.col("pos").alias("pos_j"))
    worst = both.join(at, "j").join(ranked.select(*list_of, F.col("id").alias("i"), "pos"), ["i", *list_of]).where("pos_j < pos").groupBy(*list_of, F.col("i").alias("id")).agg(F.max("ratio").alias("overlap"))
    out = ranked.join(worst, ["id", *list_of], "left").withColumn("overlap", F.coalesce("overlap", F.lit(0.0)))
    factor = F.when(F.col("pinned") | (F.col("overlap") < SIMILAR), 1.0).when(F.col("overlap") >= STRONG, 0.62).otherwise(0.8)
    return out.select(*list_of, "id", "pinned", F.round(F.col("score") * factor, 2).alias("score"))


def ranked_pool(rolled: DataFrame, k: int) -> DataFrame:
    """The k best stories of the homepage score, with their place."""
    best = story_ranking(rolled, lexicon=DATA_LEXICON).orderBy(F.desc("score"), "id").limit(k)
    return best.withColumns({"pos": F.row_number().over(Window.orderBy(F.desc("score"), "id")), "pinned": F.col("status") == "pinned"})


def _penalised(stories: DataFrame, pool: DataFrame) -> DataFrame:
    """Only pairs within the pool are asked for."""
    return prior_overlap_penalty(pool, overlap_pairs(data_topical(stories.join(pool.select("id"), "id", "left_semi")), least=SIMILAR))


register(
    "prior_overlap_penalty", BOARD, lambda s, *t: _penalised(s, stored(ranked_pool(board(s, *t), 200).select("id", "pos", "score", "pinned"))),
    HOME_SQL + f", pool AS (SELECT id, score, status = 'pinned' AS pinned, row_number() OVER (ORDER BY score DESC, id) AS pos FROM q QUALIFY pos <= 200), near AS ({TOPIC_PAIR_SQL} SELECT i, j, ratio FROM o)"
    + """, b AS (SELECT i, j, ratio FROM near UNION ALL SELECT j, i, ratio FROM near), w AS (SELECT b.i, max(ratio) AS overlap FROM b JOIN pool x ON x.id = b.i JOIN pool y ON y.id = b.j WHERE y.pos < x.pos GROUP BY 1)
    SELECT id, pinned, round(score * CASE WHEN pinned OR coalesce(overlap, 0) < 0.4 THEN 1.0::DOUBLE WHEN overlap >= 0.58 THEN 0.62::DOUBLE ELSE 0.8::DOUBLE END, 2) AS score FROM pool LEFT JOIN w ON i = id""",
)


def exact_title_collapse(candidates: DataFrame) -> DataFrame:
    """Candidates with one title become one: counts add up, weights average by articles, times span, the best rank and first summary stay."""
    key = normal(F.regexp_replace(F.coalesce("title", F.lit("")), r"^[^|]{1,30}\|", ""))
    order = F.struct((F.col("status") != "pinned").alias("p"), (-F.col("article_count")).alias("n"), "id")
    return candidates.withColumn("k", key).groupBy("k").agg(
        F.min_by("id", order).alias("id"), F.array_join(F.array_sort(F.collect_set("id")), ",").alias("story_ids"), F.sum("article_count").alias("article_count"),
        F.round(F.sum(F.col("avg_weight") * F.col("article_count")) / F.sum("article_count"), 6).alias("avg_weight"), F.min(F.when(F.col("homepage_rank") > 0, F.col("homepage_rank"))).alias("homepage_rank"),
        F.min_by("summary", F.when(F.col("summary").isNotNull(), order)).alias("summary"),
    ).drop("k")


#: Titles up to their first comma, so that some are equal.
_BEFORE_COMMA = "regexp_extract(title, '^[^,]*', 0)"
register(
    "exact_title_collapse", BOARD, lambda *t: exact_title_collapse(board(*t).withColumn("title", F.expr(_BEFORE_COMMA))),
    board_sql() + f""", k AS (SELECT *, trim(regexp_replace(lower(regexp_replace({_BEFORE_COMMA}, '^[^|]{{1,30}}\\|', '')), '[^a-z0-9]+', ' ', 'g')) AS k FROM r)
    SELECT first(id ORDER BY status <> 'pinned', article_count DESC, id) AS id, string_agg(id, ',' ORDER BY id) AS story_ids, CAST(sum(article_count) AS BIGINT) AS article_count, round(sum(avg_weight * article_count) / sum(article_count), 6) AS avg_weight,
    min(CASE WHEN homepage_rank > 0 THEN homepage_rank END) AS homepage_rank, first(summary ORDER BY status <> 'pinned', article_count DESC, id) FILTER (WHERE summary IS NOT NULL) AS summary FROM k GROUP BY k""",
)


def menu_sort(candidates: DataFrame, limit: int = 60) -> DataFrame:
    keys = (F.desc("score"), F.desc("family_count"), F.desc("source_count"), F.desc("article_count"), F.desc("latest_at"), "id")
    best = candidates.orderBy(*keys).limit(limit)
    return best.select("id", F.row_number().over(Window.orderBy(*keys)).alias("pos"))


register("menu_sort", BOARD, lambda *t: menu_sort(story_ranking(board(*t), lexicon=DATA_LEXICON)), HOME_SQL + " SELECT id, CAST(row_number() OVER (ORDER BY score DESC, family_count DESC, source_count DESC, article_count DESC, latest_at DESC, id) AS INT) AS pos FROM q QUALIFY pos <= 60")


def preview_ready_fallback(scored: DataFrame, limit: int) -> DataFrame:
    """Only the rows with a preview if there are enough of them, else all. scored (edition, id, ready)."""
    n = F.sum(F.col("ready").cast("int")).over(Window.partitionBy("edition"))
    return scored.withColumn("n", n).where(F.col("ready") | (F.col("n") < min(limit, 12))).select("edition", "id", "ready")


register(
    "preview_ready_fallback", "orders", lambda o: preview_ready_fallback(o.select(F.expr("o_custkey % 200").alias("edition"), F.col("o_orderkey").alias("id"), F.expr("o_orderkey % 3 > 0").alias("ready")), 8),
    "SELECT edition, id, ready FROM (SELECT *, count(*) FILTER (WHERE ready) OVER (PARTITION BY edition) AS n FROM (SELECT o_custkey % 200 AS edition, o_orderkey AS id, o_orderkey % 3 > 0 AS ready FROM orders)) WHERE ready OR n < 8",
)


def pool_stats(staged: DataFrame) -> DataFrame:
    """Counts of a menu's three stages. staged (source_count, filtered, returned)."""
    parts = {"candidates": F.lit(True), "filtered": F.col("filtered"), "returned": F.col("returned")}
    return staged.agg(*(F.count_if(c).alias(n) for n, c in parts.items()), *(F.count_if(c & (F.col("source_count") > 1)).alias(f"{n}_multi") for n, c in parts.items()))


register(
    "pool_stats", BOARD, lambda *t: pool_stats(board(*t).select("source_count", F.expr("status = 'active'").alias("filtered"), F.expr("status = 'active' and article_count > 1").alias("returned"))),
    board_sql() + """ SELECT count(*) AS candidates, count(*) FILTER (WHERE status = 'active') AS filtered, count(*) FILTER (WHERE status = 'active' AND article_count > 1) AS returned, count(*) FILTER (WHERE m) AS candidates_multi,
    count(*) FILTER (WHERE m AND status = 'active') AS filtered_multi, count(*) FILTER (WHERE m AND status = 'active' AND article_count > 1) AS returned_multi FROM (SELECT *, source_count > 1 AS m FROM r)""",
)


def with_traits(stories: DataFrame, states: list = L.DATA["states"], topics: list = TOPICS, audience: dict | None = DATA_AUDIENCE, hints: list[str] = L.NOVELTY_HINTS, tokens: Callable[[DataFrame], DataFrame] = data_topical) -> DataFrame:
    """What the selection rules look at: tokens by class, state, topic, audiences, whether the title hints at news. stories (id, title, summary)."""
    by_class = tokens(stories.select("id", "title")).select("id", "tokens", "action", "strong")
    hint = F.lower(F.coalesce("title", F.lit(""))).rlike("|".join(hints))
    own = stories.select("id", state_of(F.col("title"), states).alias("state"), topic_of(F.col("title"), topics).alias("topic"), audiences(F.concat_ws(" ", "title", "summary"), audience).alias("audience"), hint.alias("hint"))
    return own.join(by_class, "id")


def _overlap(a: set, b: set) -> float:
    return len(a & b) / max(1, min(len(a), len(b))) if a and b else 0.0


def same_event(a: dict, b: dict) -> bool:
    """Whether two rows tell of one event: much overlap with a strong token or two actions, or some overlap of both kinds."""
    shared, ratio = len(a["tokens"] & b["tokens"]), _overlap(a["tokens"], b["tokens"])
    strong, action = len(a["strong"] & b["strong"]), len(a["action"] & b["action"])
    return strong >= 1 or action >= 2 if ratio >= SIMILAR else ratio >= 0.3 and shared >= 3 and action >= 1 and strong >= 1


def select_diverse(pool: pd.DataFrame, limit: int, state_limit: int = 1, audience_limit: int = 1, window: int = 10, events: int = 20) -> list:
    """Ids of the chosen rows of one edition, in order. pool: rows in rank order with id, pinned, urgent, state, topic, audience, hint,
    source_count, recent_count, latest, tokens, action, strong."""
    rows = [{**r, "tokens": set(r["tokens"]), "action": set(r["action"]), "strong": set(r["strong"])} for r in pool.to_dict("records")]
    if len(rows) <= limit:
        return [r["id"] for r in rows]
    chosen = [r for r in rows if r["pinned"]][:limit]
    taken = {r["id"] for r in chosen}

    def state_ok(r: dict) -> bool:
        if len(chosen) >= window or r["pinned"] or r["urgent"] or r["state"] is None or r["source_count"] >= 3:
            return True
        return sum(c["state"] == r["state"] for c in chosen[:window]) < state_limit

    def audience_ok(r: dict) -> bool:
        if len(chosen) >= window or r["pinned"] or r["urgent"] or r["source_count"] > 1:
            return True
        return all(sum(a in c["audience"] for c in chosen[:window] if c["source_count"] <= 1) < audience_limit for a in r["audience"])

    def event_ok(r: dict) -> bool:
        if len(chosen) >= events:
            return True
        same = [c for c in chosen if same_event(r, c)]
        if not same:
            return True
        other = max(same, key=lambda c: _overlap(r["tokens"], c["tokens"]))
        hours = (r["latest"] - other["latest"]).total_seconds() / 3600
        sources, recent = r["source_count"] - other["source_count"], r["recent_count"] - other["recent_count"]
        return bool(r["hint"]) and hours >= 6 and (sources >= 1 or recent >= 2) or hours >= 24 and sources >= 4 and recent >= 2

    for strict in (True, False):
        for r in rows:
            if len(chosen) >= limit:
                break
            if r["id"] in taken or not state_ok(r) or not event_ok(r):
                continue
            if strict and (not audience_ok(r) or max((_overlap(r["tokens"], c["tokens"]) for c in chosen), default=0.0) >= SIMILAR):
                continue
            chosen.append(r)
            taken.add(r["id"])
    return [r["id"] for r in chosen]


def diverse_selection(ranked: DataFrame, traits: DataFrame, limit: int = 20, pool: int = 200) -> DataFrame:
    """(edition, id, pos): the greedy choice of each edition. ranked (edition, id, pos, pinned, urgent, source_count, recent_count, latest_at)."""
    rows = ranked.where(F.col("pos") <= pool).select("edition", "id", "pos", "pinned", "urgent", "source_count", "recent_count", F.col("latest_at").alias("latest")).join(traits, "id")

    def fold(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ids = select_diverse(part.sort_values(["pos", "id"]).assign(state=lambda d: d["state"].where(d["state"].notna(), None)), limit)
        return pd.DataFrame({"edition": [key[0]] * len(ids), "id": ids, "pos": range(1, len(ids) + 1)})

    return rows.groupBy("edition").applyInPandas(fold, "edition string, id string, pos int")


def editions(rolled: DataFrame, k: int = 200, lexicon: dict = DATA_LEXICON, audience: dict | None = DATA_AUDIENCE) -> DataFrame:
    """Stories ranked for each edition: one of all, and one for each audience that a story concerns; the k best of each."""
    who = audiences(F.concat_ws(" ", "title", "summary"), audience)
    scored = story_ranking(rolled, lexicon=lexicon).withColumn("edition", F.explode(F.concat(F.array(F.lit("all")), who)))
    pos = F.row_number().over(Window.partitionBy("edition").orderBy(F.desc("score"), "id"))
    return scored.withColumns({"pos": pos, "pinned": F.col("status") == "pinned"}).where(F.col("pos") <= k)


def _chosen(s: DataFrame, *t: DataFrame) -> DataFrame:
    pool = stored(editions(board(s, *t)).select("edition", "id", "pos", "pinned", "urgent", "source_count", "recent_count", "latest_at", "title", "summary"))
    return diverse_selection(pool, with_traits(pool.select("id", "title", "summary").dropDuplicates(["id"])), 20)


register("diverse_selection", BOARD, _chosen)


def near_words(text: str) -> set:
    """Words of a summary that tell it from others."""
    return {w for w in re.split(r"\s+", re.sub(r"[^a-z0-9\s]", " ", text.lower())) if len(w) >= 4 and w not in L.SUMMARY_STOPWORDS}


def near_duplicate(a: str, b: str, theta: float = 0.82) -> bool:
    """Whether two summaries nearly repeat each other."""
    if " ".join(a.lower().split()) == " ".join(b.lower().split()):
        return True
    return _overlap(near_words(a), near_words(b)) >= theta


def display_summary_dedupe(ranked: DataFrame, pool: int = 200, theta: float = 0.82) -> DataFrame:
    """ranked (edition, id, pos, editor_summary, summary) with the summary that is shown: none that nearly repeats one shown above."""

    def fold(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        seen: list[str] = []
        shown = []
        for r in part.sort_values(["pos", "id"]).itertuples():
            pick = next((x for x in (r.editor_summary, r.summary) if x and not any(near_duplicate(x, s, theta) for s in seen)), None)
            if pick:
                seen.append(pick)
            shown.append((key[0], r.id, pick))
        return pd.DataFrame(shown, columns=["edition", "id", "shown"])

    return ranked.where(F.col("pos") <= pool).select("edition", "id", "pos", "editor_summary", "summary").groupBy("edition").applyInPandas(fold, "edition string, id string, shown string")


register("display_summary_dedupe", BOARD, lambda *t: display_summary_dedupe(editions(board(*t)).select("edition", "id", "pos", "editor_summary", F.col("auto_summary").alias("summary"))))


def title_normalisation(articles: DataFrame) -> DataFrame:
    """(id, title, story_key, key_n): display titles without site name, section and date; their keys and how often each occurs."""
    from storyloom.functions.text import story_key

    t = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"[ \t\r\n]+", " "))
    parts = F.split(t, " - ")
    t = F.when(F.size(parts) > 1, F.trim(F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), " - "))).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)^[a-z][a-z &/+-]{1,30}\|\s*", ""), r"(?i) +[·|] *(jan|feb|mar|apr|may|jun|jul|aug|sept?|oct|nov|dec) +[0-9]{1,2}\b.*$", "")
    t = F.when(t.rlike(r"(?i)^from +[a-z]") & (F.size(F.split(t, " ")) <= 8), "").otherwise(F.trim(t))
    rows = articles.select("id", t.alias("title")).withColumn("story_key", story_key(F.col("title")))
    n = rows.groupBy("story_key").agg(F.count("*").alias("key_n"))
    return rows.join(n, "story_key").select("id", "title", "story_key", "key_n")


def _title_sql() -> str:
    from storyloom.functions.text import q, sql_words

    w = f"list_filter({sql_words('title')}, lambda w: length(w) > 2 AND w NOT IN ({q(L.STOPWORDS)}))"
    return f"""WITH v AS (SELECT id, trim(regexp_replace(concat(CASE WHEN id % 7 = 0 THEN 'News | ' WHEN id % 7 = 1 THEN 'From the ' ELSE '' END, title, CASE WHEN id % 5 = 0 THEN ' - Site' WHEN id % 5 = 1 THEN ' | Jan 3, 2024' ELSE '' END), '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS t FROM v_articles),
    p AS (SELECT id, CASE WHEN len(string_split(t, ' - ')) > 1 THEN trim(array_to_string(string_split(t, ' - ')[:-2], ' - '), ' ') ELSE t END AS t FROM v),
    c AS (SELECT id, regexp_replace(regexp_replace(t, '(?i)^[a-z][a-z &/+-]{{1,30}}\\|\\s*', ''), '(?i) +[·|] *(jan|feb|mar|apr|may|jun|jul|aug|sept?|oct|nov|dec) +[0-9]{{1,2}}\\b.*$', '') AS t FROM p),
    d AS (SELECT id, CASE WHEN regexp_matches(t, '(?i)^from +[a-z]') AND len(string_split(t, ' ')) <= 8 THEN '' ELSE trim(t, ' ') END AS title FROM c), k AS (SELECT id, title, {w} AS w FROM d),
    s AS (SELECT id, title, array_to_string(list_sort(list_filter(w, lambda x, i: list_position(w, x) = i)[1:8]), '-') AS story_key FROM k) SELECT id, title, story_key, count(*) OVER (PARTITION BY story_key) AS key_n FROM s"""


register("title_normalisation", "v_articles", lambda a: title_normalisation(a.withColumn("title", F.expr("concat(case when id % 7 = 0 then 'News | ' when id % 7 = 1 then 'From the ' else '' end, title, case when id % 5 = 0 then ' - Site' when id % 5 = 1 then ' | Jan 3, 2024' else '' end)"))), _title_sql())


_HEAD = "concat(case id % 6 when 0 then 'dpscd and it teams: ' when 1 then 'TX 43RD $74.5K ' when 2 then 'IS IT K-12? ' when 3 then 'mcmahon, in 2024-25 ' else '' end, replace(replace(case id % 4 when 0 then upper(title) when 1 then lower(title) else title end, 'ß', 's'), 'SS', 's'))"


def headlines(articles: DataFrame) -> DataFrame:
    """(id, headline) for articles with a title."""
    from storyloom.functions.headline import headline

    return articles.where("trim(title) <> ''").select("id", headline(F.col("title")).alias("headline"))


def _headline_sql() -> str:
    from storyloom.functions.headline import sql_headline

    return sql_headline(f"(SELECT id, {_HEAD} AS title FROM (SELECT id, replace(title, 'ß', 's') AS title FROM v_articles))")


register("normalize_headline", "v_articles", lambda a: headlines(a.withColumn("title", F.expr("replace(title, 'ß', 's')")).withColumn("title", F.expr(_HEAD))), _headline_sql())
