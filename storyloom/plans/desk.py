"""The desk: the publish gate, corroboration of single-source stories with its audit, and the batch from items to ranks."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.functions import lexicons as L
from storyloom.functions import patterns as P
from storyloom.functions.summaries import sanitized
from storyloom.functions.text import family, story_key
from storyloom.operators.events import gate_reason_merge
from storyloom.operators.filters import VARIED, _varied, article_quality, item_admission, topic_flags, us_only
from storyloom.operators.graphs import merge_plan, stored
from storyloom.operators.rollups import dominant_value
from storyloom.operators.scoring import BOARD, HOME_SQL, board, story_ranking
from storyloom.operators.similarity import _ENT_SQL, _STATE_SQL, _veto, cluster_outlier_counts, coverage_join, decided, entity_tokens, group_by_story_key, merge_apply, split_mixed, state_of, with_tokens
from storyloom.operators.upserts import article_upsert
from storyloom.plans.homepage import DATA, Rules, homepage_rank_refresh, top_stories
from storyloom.plans.products import merge_passes, summary_refill
from storyloom.registry import register
from storyloom.sources.pages import domain, normal_url
from storyloom.sources.views import AS_OF

#: Titles of round-ups.
ROUNDUP = r"\b(number of the week|week in review|roundup|a look at|what to know)\b"


def is_aggregator(host: Column) -> Column:
    """Whether a host is one of the sites that only pass on others' articles, or below one."""
    h = F.regexp_replace(F.lower(F.trim(F.coalesce(host, F.lit("")))), r"^(www\.|\.+)|\.$", "")
    return reduce(lambda a, b: a | b, ((h == d) | h.endswith("." + d) for d in L.AGGREGATORS))


# --- publish gate ------------------------------------------------------------------------------------------------------------------


def gate_pass(top: DataFrame, outliers: DataFrame, as_of: str = AS_OF, stale_top3: int = 48, stale_top10: int = 72, least_states: int = 2, least_entities: int = 2) -> DataFrame:
    """(id, rank, state_n, reasons): why top stories must not lead.

    top (id, rank, title, status, source_count, recent_count, article_count, latest_at, state); outliers of cluster_outlier_counts. Thin or
    round-up stories of one source, stale ones, clusters with articles of other states or entities; then, of what is left, all but the
    first of a state, unless pinned or of three sources.
    """
    c = F.col
    hours = F.greatest(F.lit(0.0), F.expr(f"timestampdiff(SECOND, latest_at, TIMESTAMP_NTZ '{as_of}')") / 3600)
    quiet, single, shown = c("recent_count") == 0, c("source_count") <= 1, c("rank") <= 10
    old = F.concat(F.round("hours").cast("int").cast("string"), F.lit("h"))
    of = lambda k: F.concat(c(k).cast("string"), F.lit("/"), c("n").cast("string"))
    rows = top.withColumn("hours", hours).join(outliers.withColumnRenamed("story_id", "id"), "id", "left").fillna(0, ["n", "state_n", "entity_n"])
    rows = rows.withColumn("r", F.array_compact(F.array(
        F.when(shown & single & (c("article_count") <= 1) & quiet, "thin_single_source_top_slot"), F.when(shown & single & F.lower("title").rlike(ROUNDUP), "roundup_single_source_top_slot"),
        F.when((c("rank") <= 3) & quiet & (c("hours") >= stale_top3), F.concat(F.lit("stale_top3:"), old)).when(shown & quiet & (c("hours") >= stale_top10), F.concat(F.lit("stale_top10:"), old)),
        F.when((c("n") >= 3) & (c("state_n") >= least_states), F.concat(F.lit("state_mismatch_articles:"), of("state_n"))), F.when((c("n") >= 5) & (c("entity_n") >= least_entities), F.concat(F.lit("entity_conflict_articles:"), of("entity_n"))),
    )))
    rows = rows.withColumn("r", F.when(c("status") == "pinned", F.array().cast("array<string>")).otherwise(c("r")))
    free = c("state").isNotNull() & (F.size("r") == 0)
    place = F.row_number().over(Window.partitionBy("state", free).orderBy("rank", "id"))
    full = free & (place > 1) & (c("status") != "pinned") & (c("source_count") < 3)
    rows = rows.withColumn("r", F.when(full, F.array(F.concat(F.lit("state_saturation:"), c("state")))).otherwise(c("r")))
    return rows.where(F.size("r") > 0).select("id", "rank", F.when(c("n") >= 3, c("state_n")).otherwise(0).cast("long").alias("state_n"), c("r").alias("reasons"))


def _outliers(top: DataFrame, links: DataFrame, articles: DataFrame, rules: Rules) -> DataFrame:
    good = articles.where("coalesce(quality_label, 'unknown') <> 'non_article'").select(F.col("id").alias("article_id"), "title")
    titled = links.select("story_id", "article_id").join(top.select(F.col("id").alias("story_id")), "story_id", "left_semi").join(good, "article_id")
    return cluster_outlier_counts(titled.select("story_id", "title"), top.select("id", "title"), rules.states, rules.generic, rules.actions)


def _first_ten(ranked: DataFrame, rules: Rules) -> DataFrame:
    return ranked.select("id", "rank", "title", "status", "source_count", "recent_count", "article_count", "latest_at", state_of(F.col("title"), rules.states).alias("state"))


def _by_score(s: DataFrame, x: DataFrame, a: DataFrame, c: DataFrame, k: int = 40) -> DataFrame:
    best = story_ranking(board(s, x, a, c), lexicon=DATA.lexicon).orderBy(F.desc("score"), "id").limit(k)
    top = stored(_first_ten(best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))), DATA))  # read three times
    return gate_pass(top, _outliers(top, x, a, DATA)).select("id", "rank", "state_n", F.array_join("reasons", ",").alias("reasons"))


def _gate_sql(k: int = 40) -> str:
    from storyloom.functions.text import q, sql_distinct_first
    from storyloom.functions.tokens import sql_merge_tokens

    act, gen = q(L.DATA["actions"]), q(L.DATA["generic"])
    return HOME_SQL + f""", top AS (SELECT id, title, status, source_count, recent_count, article_count, hours, {_STATE_SQL} AS state, row_number() OVER (ORDER BY score DESC, id) AS rank FROM q QUALIFY rank <= {k}),
    k0 AS (SELECT id AS story_id, title, 'i' AS side, {sql_merge_tokens('title')[0]} AS raw FROM top UNION ALL SELECT t.id, a.title, 'j', {sql_merge_tokens('a.title')[0]} FROM top t JOIN v_links l ON l.story_id = t.id JOIN v_articles a ON a.id = l.article_id WHERE coalesce(quality_label, 'unknown') <> 'non_article' AND trim(a.title) <> ''),
    k1 AS (SELECT *, {sql_distinct_first('raw', 24)} AS tokens, {_STATE_SQL} AS state, {_ENT_SQL} AS ent FROM k0), k2 AS (SELECT *, list_filter(tokens, lambda x: x NOT IN ({act}) AND x NOT IN ({gen})) AS strong, list_filter(tokens, lambda x: x IN ({act})) AS action FROM k1),
    ou AS (SELECT j.story_id AS id, count(*) AS n, count(*) FILTER (WHERE i.state <> j.state) AS state_n, count(*) FILTER (WHERE NOT coalesce(i.state <> j.state, false) AND len(i.ent) >= 2 AND len(j.ent) >= 2 AND len(list_intersect(i.ent, j.ent)) = 0 AND len(list_intersect(i.strong, j.strong)) = 0 AND len(list_intersect(i.action, j.action)) >= 1) AS entity_n
      FROM k2 j JOIN k2 i ON i.story_id = j.story_id AND i.side = 'i' AND j.side = 'j' GROUP BY 1),
    g AS (SELECT top.*, coalesce(n, 0) AS n, coalesce(state_n, 0) AS state_n, coalesce(entity_n, 0) AS entity_n, greatest(0, hours) AS h FROM top LEFT JOIN ou USING (id)),
    b AS (SELECT *, CASE WHEN status = 'pinned' THEN '' ELSE concat_ws(',', CASE WHEN rank <= 10 AND source_count <= 1 AND article_count <= 1 AND recent_count = 0 THEN 'thin_single_source_top_slot' END, CASE WHEN rank <= 10 AND source_count <= 1 AND regexp_matches(lower(title), '{ROUNDUP}') THEN 'roundup_single_source_top_slot' END,
      CASE WHEN rank <= 3 AND recent_count = 0 AND h >= 48 THEN concat('stale_top3:', CAST(round(h) AS INT), 'h') WHEN rank <= 10 AND recent_count = 0 AND h >= 72 THEN concat('stale_top10:', CAST(round(h) AS INT), 'h') END,
      CASE WHEN n >= 3 AND state_n >= 2 THEN concat('state_mismatch_articles:', state_n, '/', n) END, CASE WHEN n >= 5 AND entity_n >= 2 THEN concat('entity_conflict_articles:', entity_n, '/', n) END) END AS base FROM g),
    f AS (SELECT *, CASE WHEN base = '' AND state IS NOT NULL AND row_number() OVER (PARTITION BY state, base = '' ORDER BY rank, id) > 1 AND status <> 'pinned' AND source_count < 3 THEN concat('state_saturation:', state) ELSE base END AS reasons FROM b)
    SELECT id, CAST(rank AS INT) AS rank, CASE WHEN n >= 3 THEN state_n ELSE 0 END AS state_n, reasons FROM f WHERE reasons <> ''"""


register("publish_gate", BOARD, _by_score, _gate_sql())


def publish_gate(stories: DataFrame, links: DataFrame, articles: DataFrame, sources: DataFrame, rules: Rules, passes: int = 3, size: int = 10, scan: int = 20, as_of: str = AS_OF) -> tuple[DataFrame, DataFrame]:
    """(stories, details): passes of the gate over the list of all stories until one demotes nothing; flagged active stories are demoted.

    Each pass needs the ranking after the one before. details (story_id, rank, state_n, reasons) sum up all passes.
    """
    details = None
    for _ in range(passes):
        top = top_stories(stories, links, articles, sources, rules, scan, as_of=as_of, edition="all").orderBy("pos").limit(size)
        top = stored(_first_ten(top.withColumn("rank", F.col("pos")), rules))
        found = stored(gate_pass(top, _outliers(top, links, articles, rules), as_of).withColumnRenamed("id", "story_id"))
        details = found if details is None else details.unionByName(found)
        gone = found.select(F.col("story_id").alias("id")).join(stories.where("coalesce(status, 'active') not in ('hidden', 'pinned', 'demoted')").select("id"), "id", "left_semi")
        if gone.isEmpty():
            break
        stories = stored(stories.join(gone.withColumn("_gone", F.lit(True)), "id", "left").withColumn("status", F.when(F.col("_gone"), "demoted").otherwise(F.col("status"))).drop("_gone"))
    return stories, gate_reason_merge(details)


register("publish_gate_run", BOARD, lambda *t: publish_gate(*t, DATA)[1])

# --- corroboration -----------------------------------------------------------------------------------------------------------------

#: The order of the gates; those from `source_family` on come after the family check.
AFTER_FAMILY = ("candidate_filtered_quality_label", "candidate_filtered_relevance", "candidate_time_window_mismatch", "candidate_state_mismatch", "candidate_entity_conflict", "candidate_similarity_too_low")


def corroboration_match(seeds: DataFrame, found: DataFrame, rules: Rules, hours: int = 72, least: float = 0.28, per_story: int = 8, most: int = 2, search: float = 0.1) -> DataFrame:
    """(seed, cand, place, reason, similarity): of the best candidates of each seed, in order, the first gate that each fails, or `linked`.

    seeds (id, title, summary, ts, families array); found (id, url, domain, title, summary: a lede or empty, ts, family, quality_label, us,
    strict_signal, off_topic, stories array: those that it is in). Candidates are the `per_story` most alike within twice the hours. A link's
    family is taken for the candidates after it, and after `most` links a seed's search ends: what follows is `unchecked`. Seeds are judged
    on one snapshot, so two may link one article.
    """
    near = coverage_join(seeds.select("id", "title", "summary", "ts"), found.select("id", "title", "summary", "ts"), 2 * hours, search, per_story)
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("similarity"), "cand"))
    near = near.withColumn("place", place).where(F.col("place") <= per_story)
    side = lambda df, p, keep: with_tokens(df, rules.actions, rules.generic).select(F.col("id").alias("seed" if p == "i" else "cand"), *(F.col(k).alias(f"{k}_{p}") for k in ("strong", "action", "ts", *keep)), state_of(F.col("title"), rules.states).alias(f"s_{p}"), entity_tokens(F.col("title"), rules.generic, rules.actions).alias(f"e_{p}"))
    rows = near.join(side(seeds, "i", ["families"]), "seed").join(side(found, "j", ["title", "summary", "url", "domain", "family", "quality_label", "us", "strict_signal", "off_topic", "stories"]), "cand")
    c = F.col
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    veto = _veto(F.size(F.array_intersect("strong_i", "strong_j")), F.size(F.array_intersect("action_i", "action_j")))
    apart = F.abs(F.unix_seconds(c("ts_i").cast("timestamp")) - F.unix_seconds(c("ts_j").cast("timestamp"))) > hours * 3600
    reason = (
        F.when(blank(c("title_j")) | blank(c("url_j")) | blank(c("domain_j")) | is_aggregator(c("domain_j")), "candidate_filtered_quality")
        .when(F.array_contains("stories_j", c("seed").cast("string")), "candidate_canonical_duplicate").when(F.size("stories_j") > 0, "candidate_in_different_cluster")
        .when(blank(c("summary_j")), "candidate_filtered_lede").when(F.coalesce(F.array_contains("families_i", c("family_j")), F.lit(False)), "candidate_source_family_duplicate")
        .when(c("quality_label_j") == "non_article", AFTER_FAMILY[0]).when(~c("us_j") | c("off_topic_j") | ~c("strict_signal_j"), AFTER_FAMILY[1]).when(apart, AFTER_FAMILY[2])
        .when(veto == "state_mismatch", AFTER_FAMILY[3]).when(veto == "entity_conflict", AFTER_FAMILY[4]).when(c("similarity") < least, AFTER_FAMILY[5])
    )
    rows = rows.withColumn("reason", reason)
    passes, fam = c("reason").isNull(), F.coalesce("family_j", F.concat(F.lit("?"), c("cand").cast("string")))
    first = F.row_number().over(Window.partitionBy("seed", fam, passes).orderBy("place")) == 1
    rows = rows.withColumn("links", passes & first)
    before = Window.partitionBy("seed").orderBy("place")
    rows = rows.withColumn("done", F.coalesce(F.sum(c("links").cast("int")).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    taken = F.coalesce(F.max((c("links")).cast("int")).over(Window.partitionBy("seed", fam).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    final = F.when(c("done") >= most, "unchecked").when(taken & (passes | c("reason").isin(*AFTER_FAMILY)), "candidate_source_family_duplicate").when(c("links"), "linked").otherwise(c("reason"))
    return rows.select("seed", "cand", "place", F.regexp_replace(final, "_(lede|quality_label)$", F.lit("_quality")).alias("reason"), "similarity").withColumn("reason", F.regexp_replace("reason", "_quality_quality$", "_quality"))


def single_sources(rolled: DataFrame, rules: Rules, as_of: str = AS_OF, least_score: float = 4.0) -> DataFrame:
    """Scored stories of one source and one family; `skipped` says why no corroboration is sought."""
    scored = story_ranking(rolled, as_of, rules.lexicon).where("source_count <= 1 and family_count <= 1")
    wanted = (F.col("status") == "pinned") | F.col("urgent") | (F.col("score") >= least_score) | F.col("story_type").isin("breaking", "policy")
    return scored.withColumn("skipped", F.when(~wanted, "not_high_importance_singleton"))


def corroboration_sides(stories: DataFrame, links: DataFrame, articles: DataFrame, sources: DataFrame, rules: Rules, us: list[str], non_us: list[str], as_of: str = AS_OF) -> tuple[DataFrame, DataFrame]:
    """(seeds, candidates) for corroboration_match: single-source stories with their families, and all articles with what the gates read."""
    # Texts are cleaned where they are read: what the join with the sources shuffles are ledes.
    rows = topic_flags(articles.withColumn("summary", sanitized(F.col("summary"))), rules.topic).withColumn("us", us_only("title", "summary", us, non_us))
    rows = rows.join(sources.select(F.col("id").alias("source_id"), family(F.col("domain")).alias("source_family")), "source_id", "left")
    rows = rows.withColumns({"url": normal_url(F.col("url")), "domain": domain(F.col("url"))}).withColumn("family", F.coalesce("source_family", family(F.col("domain"))))
    home = links.groupBy(F.col("article_id").alias("id")).agg(F.array_sort(F.collect_set(F.col("story_id").cast("string"))).alias("stories"))
    rows = stored(rows.select("id", "url", "domain", "title", "summary", "ts", "family", "quality_label", "us", "strict_signal", "off_topic").join(home, "id", "left").withColumn("stories", F.coalesce("stories", F.array().cast("array<string>"))))
    singles = single_sources(board(stories, links, articles, sources, as_of), rules, as_of)
    of = links.select("story_id", F.col("article_id").alias("id")).join(rows.select("id", "family"), "id").groupBy("story_id").agg(F.collect_set("family").alias("families"))
    seeds = singles.join(of.withColumnRenamed("story_id", "id"), "id", "left").select("id", "title", F.coalesce("summary", F.lit("")).alias("summary"), F.col("latest_at").alias("ts"), F.coalesce("families", F.array().cast("array<string>")).alias("families"), "score", "skipped")
    return stored(seeds), rows


def single_source_audit(seeds: DataFrame, matches: DataFrame) -> DataFrame:
    """(seed, skipped, checked, linked, reasons, samples, accepted): for each single-source story how its candidates fared."""
    done = matches.where("reason <> 'unchecked'")
    per = done.groupBy("seed").agg(F.count("*").alias("checked"), F.count_if(F.col("reason") == "linked").alias("linked"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("reason") == "linked", F.col("cand")))), ",").alias("accepted"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("reason") != "linked", F.struct("place", "cand", "reason")))), lambda x: F.concat_ws(":", x["cand"].cast("string"), x["reason"])), ",").alias("samples"))
    counts = done.where("reason <> 'linked'").groupBy("seed", "reason").agg(F.count("*").alias("n")).groupBy("seed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reason", "n"))), lambda r: F.concat_ws(":", r["reason"], r["n"].cast("string"))), ",").alias("reasons"))
    rows = seeds.select(F.col("id").alias("seed"), "skipped").join(per, "seed", "left").join(counts, "seed", "left")
    none = F.col("skipped").isNull() & F.col("checked").isNull()
    return rows.select("seed", "skipped", F.coalesce("checked", F.lit(0)).alias("checked"), F.coalesce("linked", F.lit(0)).alias("linked"), F.when(none, "no_candidate_found:1").otherwise(F.coalesce("reasons", F.lit(""))).alias("reasons"), F.coalesce("samples", F.lit("")).alias("samples"), F.coalesce("accepted", F.lit("")).alias("accepted"))


_US, _NON = ["with", "que", "und"], ["tion", "heit", "mento"]


def _matched(s: DataFrame, x: DataFrame, a: DataFrame, c: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stories linked to their primary articles only, so that the others are free."""
    seeds, found = corroboration_sides(s, x.where("is_primary"), a, c, DATA, _US, _NON)
    return seeds, stored(corroboration_match(seeds.where("skipped is null"), found, DATA))


register("corroboration_match", BOARD, lambda *t: _matched(*t)[1])
register("single_source_audit", BOARD, lambda *t: single_source_audit(*_matched(*t)))

# --- the batch ---------------------------------------------------------------------------------------------------------------------


def ingest_counters(items: DataFrame) -> DataFrame:
    """The gates' counters in one aggregate: items, by quality label, off topic, with a topical signal."""
    judged = topic_flags(article_quality(items), P.DATA_TOPIC)
    label = lambda x: F.count_if(F.col("quality_label") == x).alias(x)
    return judged.agg(F.count("*").alias("items"), label("article"), label("non_article"), label("uncertain"), F.count_if("off_topic").alias("off_topic"), F.count_if("signal").alias("signal"))


def _counter_sql() -> str:
    from storyloom.operators.filters import _QUALITY_SQL, _topic_sql

    quality, topic = _QUALITY_SQL, _topic_sql(rows=VARIED)
    return f"""SELECT (SELECT count(*) FROM v_articles) AS items, q.*, t.* FROM (SELECT count(*) FILTER (WHERE quality_label = 'article') AS article, count(*) FILTER (WHERE quality_label = 'non_article') AS non_article, count(*) FILTER (WHERE quality_label = 'uncertain') AS uncertain FROM ({quality} SELECT * FROM r)) q,
    (SELECT count(*) FILTER (WHERE off_topic) AS off_topic, count(*) FILTER (WHERE signal) AS signal FROM ({topic} SELECT * FROM h)) t"""


register("ingest_counters", "v_articles", lambda a: ingest_counters(_varied(a)), _counter_sql())

#: The counters of a batch, in order. Those of fetching, decoding and models stay zero, as landed files stand for fetches.
COUNTERS = (
    "feeds fetchedItems inserted updated skipped unresolvedGoogleSkipped googleNewsDecodeAttempts googleNewsDecodeLimit grouped mergedStories mixedStoryCandidates mixedStoryOutliers mixedStoriesSplit guardrailAlerts parseFailures qualityChecked nonArticleBlocked"
    " nonArticleFlagged summariesEnriched summaryAdjudicatedAI summaryAdjudicatedDeterministic summaryGeneratedLLM summaryRejected homepageRanked publishGateChecked publishGateFlagged publishGateDemoted singleSourceAuditChecked corroborationDiscovered corroborationLinked topStoryDuplicatePairs relevanceChecked relevanceRejected"
).split()


def guardrail_alerts(n: dict[str, int], merged: int = 80, ratio: float = 0.8, outliers: int = 20, splits: int = 12) -> list[str]:
    """Alerts on a batch's grouping."""
    share = n["mergedStories"] / max(1, n["grouped"])
    found = [(n["mergedStories"] >= merged, f"high_merge_count:{n['mergedStories']}"), (n["grouped"] >= 5 and share >= ratio, f"high_merge_ratio:{share:.2f}"), (n["mixedStoryOutliers"] >= outliers, f"mixed_outliers:{n['mixedStoryOutliers']}"), (n["mixedStoriesSplit"] >= splits, f"mixed_splits:{n['mixedStoriesSplit']}")]
    return [text for hit, text in found if hit]


def taken_in(articles: DataFrame, good: DataFrame) -> DataFrame:
    """articles after the admitted items: of items with one url the latest counts; a known url keeps its id and source and takes title, time,
    and the better summary by article_upsert(), a new one comes as it is. Columns of good, and `action`."""
    latest = good.groupBy("url").agg(F.max_by(F.struct(*good.columns), F.struct("ts", "id")).alias("n")).select("n.*")
    old = articles.select(*good.columns)
    merged = article_upsert(old.withColumn("relevance", F.lit(None).cast("double")), latest.withColumn("relevance", F.lit(None).cast("double")))
    merged = merged.select("url", "title", "summary", F.col("ts").cast("timestamp_ntz").alias("ts"), "action")
    changing = ("url", "title", "summary", "ts")
    rest = old.join(latest.select("url"), "url", "left_anti").withColumn("action", F.lit("kept"))
    fixed = old.join(latest.select("url"), "url", "left_semi").unionByName(latest.join(old.select("url"), "url", "left_anti")).drop(*(c for c in changing if c != "url"))
    return rest.select(*good.columns, "action").unionByName(fixed.join(merged, "url").select(*good.columns, "action"))


def with_primaries(links: DataFrame, before: DataFrame) -> DataFrame:
    """links (story_id, article_id) with is_primary from before (story_id, article_id, is_primary): an article is still its story's primary one if
    it was that of the same story."""
    return links.join(before.where("is_primary").select("story_id", "article_id", F.lit(True).alias("was")).distinct(), ["story_id", "article_id"], "left").select("story_id", "article_id", F.coalesce("was", F.lit(False)).alias("is_primary"))


def run_events(n: dict[str, int], alerts: list[str], gate: DataFrame, added: DataFrame, as_of: str) -> DataFrame:
    """(created_at, event_type, story_id, detail) of a run: its counters, its alerts, each story that the gate named, each link that was found."""
    spark = gate.sparkSession
    run = spark.createDataFrame([("ingest_run", None, json.dumps(n)), *((("grouping_guardrail", None, json.dumps({"alerts": alerts})),) if alerts else ())], "event_type string, story_id string, detail string")
    named = gate.select(F.lit("publish_gate").alias("event_type"), F.col("story_id").cast("string").alias("story_id"), F.to_json(F.struct("reasons")).alias("detail"))
    found = added.select(F.lit("corroboration_linked").alias("event_type"), F.col("story_id").cast("string").alias("story_id"), F.to_json(F.struct("article_id")).alias("detail"))
    return run.unionByName(named).unionByName(found).select(F.expr(f"TIMESTAMP_NTZ '{as_of}'").alias("created_at"), "event_type", "story_id", "detail")


def run_pipeline(
    items: DataFrame, articles: DataFrame, stories: DataFrame, links: DataFrame, sources: DataFrame, rules: Rules, us: list[str], non_us: list[str], as_of: str = AS_OF, rank: int = 60
) -> tuple[DataFrame, DataFrame, DataFrame, dict[str, int], list[str], DataFrame]:
    """(stories, links, ranked, counters, alerts, events) after a batch of new items (id, url, title, summary, source_id, ts, lang).

    Admission, upsert of new and known urls, rescan of quality, grouping by key, merges, splits, summaries, publish gate, corroboration, ranks,
    duplicates. Each stage's snapshot is stored; the counters are sums of a row each. A story keeps its primary article; one that has
    none gets its newest. events are what event_append() takes, by type.
    """
    n = dict.fromkeys(COUNTERS, 0)
    judged = stored(item_admission(items, rules.topic).join(items.select("id", us_only("title", "summary", us, non_us).alias("us")), "id").withColumn("reject_reason", F.when(~F.col("us") & F.col("reject_reason").isNull(), "not_us").otherwise(F.col("reject_reason"))))
    by = {r["reject_reason"]: r["count"] for r in judged.groupBy("reject_reason").count().collect()}  # a row for each reason
    n["fetchedItems"], n["feeds"] = sum(by.values()), items.select("source_id").distinct().count()
    n["skipped"] = sum(v for k, v in by.items() if k)
    n["relevanceChecked"] = n["fetchedItems"]
    n["nonArticleBlocked"], n["relevanceRejected"] = by.get("non_article", 0), by.get("off_topic", 0) + by.get("no_signal", 0)
    good = items.join(judged.where("reject_reason is null").select("id"), "id", "left_semi")
    taken = stored(taken_in(articles, good))
    done = {r["action"]: r["count"] for r in taken.groupBy("action").count().collect()}  # a row for each action
    n["inserted"], n["updated"] = done.get("inserted", 0), done.get("updated", 0)
    every = stored(article_quality(taken).select(*(c for c in good.columns if c != "quality_label"), "quality_label"))
    n["qualityChecked"], n["nonArticleFlagged"] = every.count(), every.where("quality_label = 'non_article'").count()
    # Grouping of what is in no story.
    free = every.where("quality_label <> 'non_article'").join(links.select(F.col("article_id").alias("id")), "id", "left_anti")
    grouped = stored(group_by_story_key(free.withColumn("story_key", story_key(F.col("title"))), stories.withColumn("story_key", story_key(F.col("title"))), as_of))
    n["grouped"] = grouped.count()
    owned = stored(links.select("story_id", "article_id", "is_primary").unionByName(grouped.select("story_id", F.col("id").alias("article_id"), "is_primary")))
    linked = owned.select("story_id", "article_id")
    order = F.struct(~F.col("is_primary"), "id")
    made = grouped.where("is_new").join(every.drop("story_key"), "id").groupBy("story_id").agg(F.min_by("title", order).alias("title"), F.min_by("summary", order).alias("summary"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("article_count"))
    snapshot = stored(stories.select("id", "title", "summary", "status", "first_seen", "last_seen", "article_count").unionByName(made.select(F.col("story_id").alias("id"), "title", "summary", F.lit("active").alias("status"), "first_seen", "last_seen", "article_count")))
    before = snapshot.count()
    merged, linked, _ = merge_passes(snapshot, linked, lambda t, touched: decided(t, 0.56, touched=touched), 3)
    merged, linked = stored(merged), stored(with_primaries(linked, owned))
    n["mergedStories"] = before - merged.count()
    # Splits of mixed clusters.
    dated = every.select(F.col("id").alias("article_id"), "ts", "title", state_of(F.concat_ws(" ", "title", "url"), rules.states).alias("state"), story_key(F.col("title")).alias("story_key"), "quality_label")
    rows = stored(linked.join(dated.where("quality_label <> 'non_article'"), "article_id"))
    own = merged.select(F.col("id").alias("story_id"), state_of(F.col("title"), rules.states).alias("own_state"))
    _, split_links, counts = split_mixed(merged.withColumn("story_key", story_key(F.col("title"))), rows, dominant_value(rows.select("story_id", "state"), own))
    c = counts.first()
    n["mixedStoryCandidates"], n["mixedStoryOutliers"], n["mixedStoriesSplit"] = c["candidates"], c["flagged"], c["split"]
    links_now = stored(split_links.unionByName(linked.join(rows.select("story_id", "article_id"), ["story_id", "article_id"], "left_anti").select("story_id", "article_id", "is_primary")))
    alerts = guardrail_alerts(n)
    n["guardrailAlerts"] = len(alerts)
    split_off = links_now.join(merged.select(F.col("id").alias("story_id")), "story_id", "left_anti").join(every.select(F.col("id").alias("article_id"), "title", "summary", "ts"), "article_id")
    extra = split_off.groupBy(F.col("story_id").alias("id")).agg(F.min_by("title", "article_id").alias("title"), F.min_by("summary", "article_id").alias("summary"), F.lit("active").alias("status"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("article_count"))
    now = stored(merged.join(links_now.select(F.col("story_id").alias("id")), "id", "left_semi").unionByName(extra))
    # Summaries of those that need one.
    nothing = {"editor_title": "string", "editor_summary": "string", "preview_text": "string", "preview_type": "string", "preview_confidence": "double", "preview_reason": "string", "homepage_rank": "int"}
    now = now.withColumns({k: F.lit(None).cast(v) for k, v in nothing.items()})
    refill = stored(summary_refill(now, links_now, every).select("id", F.col("summary").alias("refilled"), "kind", F.col("preview_type").alias("shown_as"), "preview", "confidence", "reason"))
    n["summaryAdjudicatedDeterministic"] = refill.count()
    n["summariesEnriched"] = refill.where("kind <> 'fallback'").count()
    fresh = lambda new, old: F.when(F.col("refilled").isNotNull(), F.col(new)).otherwise(F.col(old))
    previews = {"preview_text": fresh("preview", "preview_text"), "preview_type": fresh("shown_as", "preview_type"), "preview_confidence": fresh("confidence", "preview_confidence"), "preview_reason": fresh("reason", "preview_reason")}
    now = now.join(refill, "id", "left").withColumns({**previews, "summary": F.coalesce("refilled", "summary")})
    now = stored(now.drop("refilled", "kind", "shown_as", "preview", "confidence", "reason"))
    # Publish gate, after a merge among the top stories.
    first = stored(top_stories(now, links_now, every, sources, rules, 20, as_of=as_of, edition="all").select("id"))
    plan = stored(merge_plan(now.join(first, "id", "left_semi"), decided(now.join(first, "id", "left_semi"), 0.54, 10), 4))
    if not plan.isEmpty():
        n["mergedStories"] += plan.count()
        after, pairs = merge_apply(now, links_now, plan.select("source", "target"))
        now, links_now = stored(after.withColumns({k: F.lit(None).cast(v) for k, v in nothing.items()})), stored(pairs.join(links_now, ["story_id", "article_id"], "left").select("story_id", "article_id", F.coalesce("is_primary", F.lit(False)).alias("is_primary")))
    was = now.where("status = 'demoted'").count()
    now, details = publish_gate(now, links_now, every, sources, rules, as_of=as_of)
    details = stored(details)
    n["publishGateChecked"], n["publishGateFlagged"], n["publishGateDemoted"] = min(10, now.count()), details.count(), now.where("status = 'demoted'").count() - was
    # Corroboration of what has one source.
    seeds, found = corroboration_sides(now, links_now, every, sources, rules, us, non_us, as_of)
    matches = stored(corroboration_match(seeds.where("skipped is null"), found, rules))
    n["singleSourceAuditChecked"], n["corroborationDiscovered"] = seeds.count(), matches.where("reason <> 'unchecked'").count()
    added = matches.where("reason = 'linked'").select(F.col("seed").alias("story_id"), F.col("cand").alias("article_id"), F.lit(False).alias("is_primary"))
    added = stored(added)
    n["corroborationLinked"] = added.count()
    links_now = stored(links_now.unionByName(added).groupBy("story_id", "article_id").agg(F.max("is_primary").alias("is_primary")))
    top = stored(top_stories(now, links_now, every, sources, rules, rank, as_of=as_of, edition="all"))
    n["homepageRanked"] = top.count()
    n["topStoryDuplicatePairs"] = decided(now.join(top.where("pos <= 20").select("id"), "id", "left_semi"), 0.54).where("should_merge").count()
    return now, links_now, homepage_rank_refresh(now, top), n, alerts, run_events(n, alerts, details, added, as_of)


def _batch(s: DataFrame, x: DataFrame, a: DataFrame, c: DataFrame) -> DataFrame:
    """Primary articles are the snapshot, all others come as new items: every row is on one side."""
    old = x.where("is_primary")
    known = a.join(old.select(F.col("article_id").alias("id")), "id", "left_semi")
    items = a.join(old.select(F.col("article_id").alias("id")), "id", "left_anti")
    now, _, ranked, n, alerts, _ = run_pipeline(items, known, s, old, c, DATA, _US, _NON)
    rows = now.select("id", "status", "article_count").join(ranked.select("id", "homepage_rank"), "id").select("id", F.col("status").alias("what"), F.coalesce("homepage_rank", F.lit(0)).cast("long").alias("n"))
    spark = s.sparkSession
    counters = spark.createDataFrame([("counter", k, v) for k, v in n.items()] + [("alert", k, 1) for k in alerts], rows.schema)
    return rows.unionByName(counters)


register("run_pipeline", BOARD, _batch)
