"""The homepage and the weekly menu as compositions: rollup, gates, previews, scores, penalties, diverse choice, lead, summaries shown once.

The newest stories are cut to a pool by a top-k over the rollup (a parameter; the lists show the newest only). All that follows works on
that pool, for each edition on its own: one of all stories, and one for each audience.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyloom.functions import lexicons as L
from storyloom.functions import patterns as P
from storyloom.functions.summaries import TEMPLATES
from storyloom.operators.filters import DATA_AUDIENCE, audiences, lanes, non_story, reject_titles, topic_flags
from storyloom.operators.graphs import stored
from storyloom.operators.rollups import lead_selection, rank_apply_join
from storyloom.operators.scoring import BOARD, DATA_LEXICON, DEFAULT, board, newsletter_ranking, story_ranking
from storyloom.operators.selection import diverse_selection, display_summary_dedupe, exact_title_collapse, near_duplicate, pool_stats, prior_overlap_penalty, with_traits
from storyloom.operators.similarity import TOPICS, data_tokens, data_topical, overlap_pairs, topical, with_tokens
from storyloom.plans.products import menu_articles
from storyloom.registry import register
from storyloom.sources.views import AS_OF


@dataclass(frozen=True)
class Rules:
    """The word lists that the lists' rules read."""

    lexicon: dict = field(default_factory=lambda: DEFAULT)
    audience: dict | None = None
    topic: dict = field(default_factory=lambda: P.TOPIC)
    states: list = field(default_factory=lambda: L.STATES)
    topics: list = field(default_factory=lambda: L.TOPICS)
    generic: list = field(default_factory=lambda: L.GENERIC_TOKENS)
    actions: list = field(default_factory=lambda: L.ACTION_TOKENS)
    lane_policy: list = field(default_factory=lambda: L.LANE_POLICY)
    merging: Callable[[DataFrame], DataFrame] = with_tokens
    shown: Callable[[DataFrame], DataFrame] = topical

    def traits(self, stories: DataFrame) -> DataFrame:
        return with_traits(stories, self.states, self.topics, self.audience, L.NOVELTY_HINTS, self.shown)


#: The rules with word lists for the driver's invented prose.
DATA = Rules(DATA_LEXICON, DATA_AUDIENCE, P.DATA_TOPIC, L.DATA["states"], TOPICS, L.DATA["generic"], L.DATA["actions"], L.LANE_POLICY, data_tokens, data_topical)


def is_opinion() -> Column:
    """Opinion pieces by type or title, unless they are pinned."""
    return (F.col("status") != "pinned") & ((F.col("story_type") == "opinion") | F.trim("title").rlike(r"(?i)^opinion\s*[:\-]"))


def shown_titles(rolled: DataFrame) -> DataFrame:
    """Rows that are not hidden and have a title of a story."""
    good = rolled.where("status <> 'hidden'").join(reject_titles(rolled).select("id"), "id", "left_semi")
    return good.where(~non_story(F.col("title"), F.lit("")))


def candidates(rolled: DataFrame, rules: Rules, limit: int, as_of: str = AS_OF, edition: str | None = None) -> DataFrame:
    """Scored rows for each edition, or for one: on the topic or pinned, and with a preview if there are enough of those."""
    scored = story_ranking(shown_titles(rolled), as_of, rules.lexicon).withColumn("score", F.round(F.col("score") * F.col("preview_factor"), 2))
    scored = topic_flags(scored.withColumn("url", F.lit("")), rules.topic).where("status = 'pinned' or strict_signal")
    who = audiences(F.concat_ws(" ", "title", "summary"), rules.audience)
    editions = F.concat(F.array(F.lit("all")), who)
    editions = editions if edition is None else F.filter(editions, lambda e: e == edition)
    rows = scored.withColumn("edition", F.explode(editions)).withColumns({"pinned": F.col("status") == "pinned", "ready": (F.col("status") == "pinned") | F.col("summary").isNotNull(), "opinion": is_opinion()})
    enough = F.sum(F.col("ready").cast("int")).over(Window.partitionBy("edition")) >= min(limit, 12)
    keep = ["edition", "id", "title", "summary", "auto_summary", "editor_summary", "status", "pinned", "urgent", "story_type", "lead_eligible", "lead_reason", "score", "homepage_rank", "preview_type", "article_count", "source_count", "family_count", "recent_count", "latest_at"]
    return rows.withColumn("enough", enough).where("ready or not enough").select(*keep, "opinion")


def top_stories(stories: DataFrame, links: DataFrame, articles: DataFrame, sources: DataFrame, rules: Rules, limit: int = 20, pool: int | None = 200, stored_rank: bool = False, verdict: DataFrame | None = None, as_of: str = AS_OF, edition: str | None = None) -> DataFrame:
    """(edition, pos, id, shown, ...): each edition's list, or that of one edition alone.

    Live, stories are ordered by score (pinned first), cut where they repeat one above, reordered by a verdict (id, place, demote) if there
    is one, chosen with diversity, filled up with demoted ones, led by an eligible one. With stored_rank an edition that has stored ranks
    keeps their order, and its lead. Summaries are shown once.
    """
    rows = stored(candidates(board(stories, links, articles, sources, as_of, k=pool), rules, limit, as_of, edition))
    has = F.max(F.col("homepage_rank").isNotNull().cast("int")).over(Window.partitionBy("edition")) == 1 if stored_rank else F.lit(False)
    ready = rows.withColumn("kept_order", has).where("not opinion")
    per = Window.partitionBy("edition")
    ranked = F.col("homepage_rank").isNotNull()
    bucket = F.when(F.col("pinned") & ranked, 0).when(F.col("pinned"), 1).when(ranked, 2).otherwise(3)
    stays = F.col("kept_order")
    keys = [F.when(stays, bucket).otherwise(F.when(F.col("pinned"), 0).otherwise(1)), F.when(stays, F.coalesce("homepage_rank", F.lit(0))).otherwise(0), F.desc("score"), "id"]
    live = ready.where("status <> 'demoted'").withColumn("pos", F.row_number().over(per.orderBy(*keys)))
    live = stored(live)
    near = overlap_pairs(rules.shown(stories.join(live.select("id").distinct(), "id", "left_semi")), least=0.4)
    cut = prior_overlap_penalty(live.select("edition", "id", "pos", "score", "pinned"), near).select("edition", "id", F.col("score").alias("cut"))
    again = live.join(cut, ["edition", "id"]).withColumn("score", F.when(stays, F.col("score")).otherwise(F.col("cut"))).drop("cut")
    order = [F.when(stays, F.col("pos")).otherwise(F.when(F.col("pinned"), 0).otherwise(1)), F.desc("score"), "pos"]
    again = again.withColumn("pos", F.row_number().over(per.orderBy(*order)))
    if verdict is not None:
        judged = again.join(verdict, "id", "left").where(stays | ~F.coalesce("demote", F.lit(False)))
        rest, place = ~stays & F.col("place").isNull(), F.when(stays, F.col("pos")).otherwise(F.col("place"))
        again = judged.withColumn("pos", F.row_number().over(per.orderBy(rest, place, "pos"))).drop("place", "demote")
    again = stored(again.where(stays | (F.col("pos") <= max(limit, 30))))
    chosen = diverse_selection(again, rules.traits(again.select("id", "title", "summary").dropDuplicates(["id"])), limit, 10**9)
    # Demoted stories fill up what is left, best first.
    size = chosen.groupBy("edition").agg(F.count("*").cast("int").alias("size"))
    spare = ready.where("status = 'demoted'").join(size, "edition", "left").withColumn("pos", F.coalesce("size", F.lit(0)) + F.row_number().over(per.orderBy(F.desc("score"), "id")))
    listed = chosen.select("edition", "id", "pos").unionByName(spare.where(F.col("pos") <= limit).select("edition", "id", "pos"))
    listed = stored(listed.join(rows.join(ready.select("edition", "id", "kept_order"), ["edition", "id"]).drop("score"), ["edition", "id"]).join(again.select("edition", "id", "score").unionByName(spare.select("edition", "id", "score")), ["edition", "id"]))
    led = lead_selection(listed.select("edition", "id", "pos", (F.col("lead_eligible") & ~stays).alias("eligible"), "pinned"))
    final = listed.drop("pos").join(led, ["edition", "id"])
    shown = display_summary_dedupe(final.select("edition", "id", "pos", "editor_summary", F.col("auto_summary").alias("summary")), 10**9)
    return final.join(shown, ["edition", "id"]).drop("opinion", "kept_order")


_SHOWN = ("edition", "pos", "id", "score", "shown")
register("top_stories", BOARD, lambda *t: top_stories(*t, DATA, 20).select(*_SHOWN))
register("top_stories_stored", BOARD, lambda *t: top_stories(*t, DATA, 20, stored_rank=True).select(*_SHOWN))


def homepage_rank_refresh(stories: DataFrame, top: DataFrame) -> DataFrame:
    """(id, title, homepage_rank): stored ranks after a list of all stories; whoever is not on it has none."""
    return rank_apply_join(stories, top.where("edition = 'all'").select(F.col("id").alias("story_id"), F.col("pos").alias("rank")))


register("homepage_rank_refresh", BOARD, lambda s, *t: homepage_rank_refresh(s, top_stories(s, *t, DATA, 60, edition="all")))


# --- weekly menu -------------------------------------------------------------------------------------------------------------------


def newsletter_menu(
    stories: DataFrame, links: DataFrame, articles: DataFrame, sources: DataFrame, rules: Rules, limit: int = 30, days: int = 7, audience: str | None = None, lane: str | None = None, least_sources: int | None = None, exclude_ids: DataFrame | None = None, exclude_types: tuple[str, ...] = (), as_of: str = AS_OF,
) -> tuple[DataFrame, DataFrame]:
    """(menu, stats): the weekly menu with each story's articles, and the counts of its three stages.

    The pool is the newest stories of the last days, ten times the limit and 200 at least, 14 times if the menu is filtered, 600 at most.
    """
    limit, days = min(max(limit, 10), 50), min(max(days, 3), 14)
    filtered_menu = bool(audience or lane or least_sources or exclude_ids is not None or exclude_types)
    pool = min(600, max(limit * (14 if filtered_menu else 10), 200))
    rolled = shown_titles(board(stories, links, articles, sources, as_of, 72, days, pool))
    on_topic = topic_flags(rolled.withColumn("url", F.lit("")), rules.topic).where("strict_signal")
    scored = newsletter_ranking(on_topic, as_of, rules.lexicon, rules.audience).where("story_type not in ('opinion', 'evergreen')")
    text = F.concat_ws(" ", "title", "summary")
    scored = stored(scored.withColumns({"lanes": lanes(text, F.col("story_type"), F.col("why"), rules.lane_policy, rules.audience), "who": audiences(text, rules.audience)}))
    collapsed = exact_title_collapse(scored).select("id", F.split("story_ids", ",").alias("story_ids"), F.col("article_count").alias("all_articles"))
    rows = scored.join(collapsed, "id")
    wanted = F.lit(True)
    for condition in (audience and F.array_contains("who", audience), lane and F.array_contains("lanes", lane), least_sources and F.col("source_count") >= least_sources, exclude_types and ~F.col("story_type").isin(*exclude_types)):
        if condition is not None and not isinstance(condition, (str, int, tuple)):
            wanted = wanted & condition
    kept = rows.where(wanted)
    if exclude_ids is not None:
        out = kept.select("id", F.explode("story_ids").alias("story_id")).join(exclude_ids.select(F.col("id").alias("story_id")), "story_id", "left_semi").select("id")
        kept = kept.join(out, "id", "left_anti")
    keys = (F.desc("score"), F.desc("family_count"), F.desc("source_count"), F.desc("article_count"), F.desc("latest_at"), "id")
    placed = stored(kept.withColumns({"edition": F.lit("menu"), "pinned": F.lit(False), "pos": F.row_number().over(Window.orderBy(*keys))}))
    near = overlap_pairs(rules.shown(stories.join(placed.select("id"), "id", "left_semi")), least=0.4)
    cut = prior_overlap_penalty(placed.select("edition", "id", "pos", "score", "pinned"), near).select("id", F.col("score").alias("cut"))
    again = stored(placed.join(cut, "id").withColumn("score", F.col("cut")).drop("cut").withColumn("pos", F.row_number().over(Window.orderBy(*keys))))
    chosen = stored(diverse_selection(again, rules.traits(again.select("id", "title", "summary")), limit, 10**9).select("id", "pos"))
    stats = pool_stats(rows.join(kept.select("id", F.lit(True).alias("filtered")), "id", "left").join(chosen.select("id", F.lit(True).alias("returned")), "id", "left").select("source_count", F.coalesce("filtered", F.lit(False)).alias("filtered"), F.coalesce("returned", F.lit(False)).alias("returned")))
    menu = chosen.join(again.drop("pos", "edition", "pinned"), "id")
    listed = menu_articles(menu.select("id", "story_ids"), links, articles)
    return menu.join(listed, "id", "left"), stats


def _menu(*t: DataFrame) -> DataFrame:
    menu, _ = newsletter_menu(*t, DATA, 30, 14)
    return menu.select("pos", "id", "score", "story_type", F.array_join("why", ",").alias("why"), F.array_join("lanes", ",").alias("lanes"), F.array_join("story_ids", ",").alias("story_ids"), "primary", "supporting")


register("newsletter_menu", BOARD, _menu)
register("newsletter_menu_filtered", BOARD, lambda s, *t: newsletter_menu(s, *t, DATA, 10, 14, audience="teachers", least_sources=1, exclude_ids=s.where("status = 'demoted'").select("id"), exclude_types=("breaking",))[0].select("pos", "id", "score"))


# --- report on what is shown -------------------------------------------------------------------------------------------------------


def preview_quality_report(shown: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row about a list (id, pos, shown, preview_type, lead_eligible): blanks, templates, types, openings of six words that repeat,
    pairs of near-equal previews (each against those above it), pairs of alike titles (i, j), and whether the lead should be another.
    """
    opening = F.array_join(F.slice(F.split(F.trim(F.regexp_replace(F.lower("shown"), "[^a-z0-9]+", " ")), " "), 1, 6), " ")
    again = shown.where("shown is not null").groupBy(opening.alias("o")).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("v"))
    template = F.coalesce(F.col("shown").rlike("(?i)" + "|".join(TEMPLATES)), F.lit(False))
    kind = lambda x: F.count_if(F.col("preview_type") == x).alias(x)
    lead = F.max(F.when(F.col("pos") == 1, ~F.col("lead_eligible")))
    base = shown.agg(F.count("*").alias("n"), F.count_if(F.col("shown").isNull()).alias("blank"), F.count_if(template).alias("templates"), kind("full"), kind("excerpt"), kind("headline_only"), (lead & F.max(F.when(F.col("pos") > 1, F.col("lead_eligible")))).alias("lead_issue"))

    @F.udf("boolean")
    def near(a: str, b: str) -> bool:
        return near_duplicate(a, b)

    texts = shown.where("shown is not null").select("id", "pos", "shown")
    x, y = texts.toDF("i", "p", "a"), texts.toDF("j", "q", "b")
    # The list is a page of at most some dozens of rows; its pairs are few.
    alike = x.join(y, F.col("p") < F.col("q")).where(near("a", "b")).agg(F.count("*").alias("v"))
    topical_pairs = pairs.join(shown.select(F.col("id").alias("i")), "i", "left_semi").join(shown.select(F.col("id").alias("j")), "j", "left_semi").agg(F.count("*").alias("v"))
    one = lambda df, name: df.select(F.lit(1).alias("k"), F.col("v").alias(name))
    out = base.withColumn("k", F.lit(1))
    for df, name in ((again, "repeated_openings"), (alike, "near_pairs"), (topical_pairs, "topical_pairs")):
        out = out.join(one(df, name), "k")
    return out.drop("k").withColumn("lead_issue", F.coalesce("lead_issue", F.lit(False)))


def _report(s: DataFrame, *t: DataFrame) -> DataFrame:
    top = stored(top_stories(s, *t, DATA, 60, edition="all").select("id", "pos", "shown", "preview_type", "lead_eligible"))
    return preview_quality_report(top, overlap_pairs(data_topical(s.join(top, "id", "left_semi")), least=0.4).select("i", "j"))


register("preview_quality_report", BOARD, _report)
