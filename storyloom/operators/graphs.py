"""Components, chains and greedy merge plans over edges, as loops of joins with a checkpoint each round.

Few edges (BOUND at most, counted first) are done by one task instead, with the same result: the rounds' fixed cost would be all there is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Edges that one task takes.
BOUND = 100_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; where it is unset a new temporary folder, in local mode only."""
    import tempfile

    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(base)
    return base


def stored(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def in_one_task(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """work on all rows of df at once; whoever calls it has counted them."""

    def whole(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(parts)
        if held:
            yield work(pd.concat(held, ignore_index=True))

    return df.coalesce(1).mapInPandas(whole, schema)


def _roots(part: pd.DataFrame) -> pd.DataFrame:
    up: dict = {}

    def find(x):  # noqa: ANN001, ANN202
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in zip(part["i"], part["j"]):
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return pd.DataFrame({"id": list(up), "cluster_id": [find(x) for x in up]})


def cluster_labels(ids: DataFrame, pairs: DataFrame, rounds: int = 60, bound: int = BOUND) -> DataFrame:
    """(id, cluster_id): connected components of pairs (i, j), named by their smallest id; an id without pairs is its own.

    Each round passes the smallest label on and jumps once.
    """
    edges = stored(pairs.select("i", "j").distinct())
    kind = ids.schema["id"].dataType.simpleString()
    if edges.count() <= bound:
        found = in_one_task(edges, _roots, f"id {kind}, cluster_id {kind}")
        return ids.select("id").join(found, "id", "left").select("id", F.coalesce("cluster_id", "id").alias("cluster_id"))
    both = edges.select(F.col("i").alias("a"), F.col("j").alias("b")).union(edges.select("j", "i"))
    labels = ids.select("id", F.col("id").alias("cluster_id"))
    for _ in range(rounds):
        least = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("cluster_id").alias("m"))
        new = labels.join(least, "id", "left").select("id", F.least("cluster_id", F.coalesce("m", "cluster_id")).alias("c"), "cluster_id")
        up = new.select(F.col("id").alias("c"), F.col("c").alias("cc"))
        new = stored(new.join(up, "c", "left").select("id", F.least("c", F.coalesce("cc", "c")).alias("c"), F.col("cluster_id").alias("old")))
        changed = new.where("c <> old").limit(1).count()
        labels = new.select("id", F.col("c").alias("cluster_id"))
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _ends(part: pd.DataFrame) -> pd.DataFrame:
    up = dict(zip(part["source"], part["target"]))
    for x in list(up):
        path = []
        while up[x] in up:
            path.append(x)
            x = up[x]
            if len(path) > len(up):
                raise ValueError("the plan has a cycle")
        for y in path:
            up[y] = up[x]
    return pd.DataFrame({"source": list(up), "target": list(up.values())})


def path_compress(plan: DataFrame, rounds: int = 60, bound: int = BOUND) -> DataFrame:
    """(source, target) with chains resolved to their last target, by pointer jumping; each source has one target."""
    out = stored(plan.select("source", "target"))
    if out.count() <= bound:
        kind = {c: out.schema[c].dataType.simpleString() for c in out.columns}
        return in_one_task(out, _ends, f"source {kind['source']}, target {kind['target']}")
    for _ in range(rounds):
        nxt = out.select(F.col("source").alias("target"), F.col("target").alias("beyond"))
        out = stored(out.join(nxt, "target", "left").select("source", F.coalesce("beyond", "target").alias("target"), F.col("beyond").isNotNull().alias("moved")))
        if not out.where("moved").limit(1).count():
            return out.drop("moved")
        out = out.drop("moved")
    raise ValueError("the plan has a cycle")


_SEQ = "concat(lpad(cast(1000000000000 - t_a as string), 13, '0'), '/', a, '/', lpad(cast(1000000000000 - t_b as string), 13, '0'), '/', b)"
_PLAN = "source string, target string, seq string"
_WALKED = f"{_PLAN}, pinned boolean, n long, t long"


def greedy_walk(part: pd.DataFrame) -> pd.DataFrame:
    """The pairs (a, b, seq, n, t and pinned of both) in order: each joins two stories if both are still there. With the target's traits then."""
    state: dict = {}
    for r in part.itertuples():
        state[r.a], state[r.b] = [r.pinned_a, r.n_a, r.t_a], [r.pinned_b, r.n_b, r.t_b]
    gone, out = set(), []
    for r in part.sort_values("seq").itertuples():
        if r.a in gone or r.b in gone:
            continue
        target, source = (r.a, r.b) if state[r.a] >= state[r.b] else (r.b, r.a)
        gone.add(source)
        state[target] = [state[target][0], state[target][1] + state[source][1], max(state[target][2], state[source][2])]
        out.append((source, target, r.seq, *state[target]))
    return pd.DataFrame(out, columns=["source", "target", "seq", "pinned", "n", "t"])


def greedy_slices(rows: DataFrame, bound: int, rounds: int = 10_000) -> DataFrame:
    """What greedy_walk gives, for any number of pairs: one task walks the first pairs in order, about `bound` at most; then joins take the
    pairs of stories that are gone out of the rest and give the others their new traits, and so on. As a merge ends all other pairs of its
    source, far fewer slices are walked than the pairs would fill."""
    bound = max(bound, 8)
    alive, plan = stored(rows), None
    for _ in range(rounds):
        count = alive.count()
        if not count:
            break
        first, rest = alive, None
        if count > bound:
            # A cut from a sample: where it lies decides on a slice's size only, not on the plan.
            drawn = sorted(r[0] for r in alive.sample(min(1.0, (1000 + 20 * count / bound) / count), 1).select("seq").collect())
            cut = drawn[int(len(drawn) * 0.8 * bound / count)] if drawn else alive.agg(F.min("seq")).first()[0]
            first, rest = alive.where(F.col("seq") <= cut), alive.where(F.col("seq") > cut)
        done = stored(in_one_task(first, greedy_walk, _WALKED))
        plan = done if plan is None else plan.union(done)
        if rest is None:
            break
        gone = done.select(F.col("source").alias("id")).distinct()
        grown = done.groupBy(F.col("target").alias("id")).agg(F.max_by(F.struct("pinned", "n", "t"), "seq").alias("new")).join(gone, "id", "left_anti")
        for p in "ab":
            rest = rest.join(gone.withColumnRenamed("id", p), p, "left_anti").join(grown.withColumnRenamed("id", p), p, "left")
            rest = rest.withColumns({f"{c}_{p}": F.coalesce(F.col(f"new.{c}"), F.col(f"{c}_{p}")) for c in ("pinned", "n", "t")}).drop("new")
        alive = stored(rest.select(rows.columns))
    else:
        raise RuntimeError(f"the plan did not end in {rounds} rounds")
    return rows.sparkSession.createDataFrame([], _PLAN) if plan is None else plan.select("source", "target", "seq")


def merge_plan(stories: DataFrame, decisions: DataFrame, most: int | None = None, bound: int = BOUND) -> DataFrame:
    """(source, target, seq): which story goes into which, each at most once as a source; with `most`, the first so many in order.

    Pairs are walked by the last times of their stories, newest first; a merge changes the target's size and time for those after it. Beyond
    `bound` pairs they are walked in slices of that order. stories (id, status, article_count, last_seen).
    """
    pairs = stored(decisions.where("should_merge").select("i", "j"))
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', last_seen)")
    traits = stories.select("id", (F.col("status") == "pinned").alias("pinned"), F.col("article_count").cast("long").alias("n"), seconds.alias("t"))
    s = lambda p, q: traits.select(F.col("id").alias(p), *(F.col(c).alias(f"{c}_{q}") for c in ("pinned", "n", "t")))
    rows = pairs.join(s("i", "i"), "i").join(s("j", "j"), "j")
    first = (F.col("t_i") > F.col("t_j")) | ((F.col("t_i") == F.col("t_j")) & (F.col("i") < F.col("j")))
    pick = lambda x, y, name: F.when(first, F.col(x)).otherwise(F.col(y)).alias(name)
    sides = [pick("i", "j", "a"), pick("j", "i", "b")] + [pick(f"{c}_{x}", f"{c}_{y}", f"{c}_{p}") for c in ("pinned", "n", "t") for x, y, p in (("i", "j", "a"), ("j", "i", "b"))]
    rows = rows.select(*sides).withColumn("seq", F.expr(_SEQ))
    plan = in_one_task(rows, greedy_walk, _WALKED).select("source", "target", "seq") if pairs.count() <= bound else greedy_slices(rows, bound)
    return plan if most is None else plan.orderBy("seq").limit(most)


def numbered(df: DataFrame, *keys) -> DataFrame:  # noqa: ANN002
    """df with pos from 1 in the order of keys, for rows that a top-k has cut before."""
    return df.withColumn("pos", F.row_number().over(Window.orderBy(*keys)))
