"""Components, chains and merge plans: one task, tasks by component and rounds give what a plain loop gives."""

import datetime as dt
import random

import pytest

from storyloom.operators.graphs import cluster_labels, merge_plan, path_compress


def plain_plan(stories, pairs):
    at = {s[0]: [s[1] == "pinned", s[2], s[3]] for s in stories}
    order = {i: k for k, i in enumerate(sorted(at, key=lambda i: (-at[i][2].timestamp(), i)))}
    gone, out = set(), []
    for a, b in sorted((tuple(sorted(p, key=order.get)) for p in pairs), key=lambda p: (order[p[0]], order[p[1]])):
        if a in gone or b in gone:
            continue
        target, source = (a, b) if at[a] >= at[b] else (b, a)
        gone.add(source)
        at[target][1] += at[source][1]
        at[target][2] = max(at[target][2], at[source][2])
        out.append((source, target))
    return out


@pytest.mark.parametrize("bound", [100_000, 12, 0])
def test_merge_plan(spark, bound):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    stories = [(f"s{k:03d}", rng.choice(("pinned", "active", "active")), rng.randrange(1, 5), start + dt.timedelta(hours=rng.randrange(30))) for k in range(60)]
    pairs = {tuple(sorted(rng.sample([s[0] for s in stories[c * 12 : c * 12 + 12]], 2))) for c in range(5) for _ in range((6, 9, 14, 5, 2)[c])}
    df = spark.createDataFrame(stories, "id string, status string, article_count long, last_seen timestamp_ntz")
    decisions = spark.createDataFrame([(i, j, True) for i, j in pairs] + [("s000", "s059", False)], "i string, j string, should_merge boolean")
    want = plain_plan(stories, pairs)
    got = merge_plan(df, decisions, bound=bound).collect()
    assert [(r["source"], r["target"]) for r in sorted(got, key=lambda r: r["seq"])] == want
    assert [(r["source"], r["target"]) for r in sorted(merge_plan(df, decisions, 4, bound).collect(), key=lambda r: r["seq"])] == want[:4]


def test_a_long_plan_ends_in_few_slices(spark):
    """A chain in which each merge waits for the one before: the slices follow from the number of pairs, not from the length of the chain."""
    from storyloom.operators.graphs import greedy_slices

    n = 240
    pairs = [(f"s{k:03d}", f"s{k + 1:03d}", f"{k:04d}", False, 1 + k % 3, n - k, False, 1 + (k + 1) % 3, n - k - 1) for k in range(n)]
    rows = spark.createDataFrame(pairs, "a string, b string, seq string, pinned_a boolean, n_a long, t_a long, pinned_b boolean, n_b long, t_b long")
    state, gone, want = {}, set(), []
    for a, b, _, pa, na, ta, pb, nb, tb in pairs:
        x, y = state.setdefault(a, [pa, na, ta]), state.setdefault(b, [pb, nb, tb])
        if a in gone or b in gone:
            continue
        target, source = (a, b) if x >= y else (b, a)
        gone.add(source)
        state[target] = [False, x[1] + y[1], max(x[2], y[2])]
        want.append((source, target))
    got = sorted(greedy_slices(rows, 60, rounds=8).collect(), key=lambda r: r["seq"])
    assert [(r["source"], r["target"]) for r in got] == want


@pytest.mark.parametrize("bound", [100_000, 0])
def test_components_and_chains(spark, bound):
    pairs = [(k, k + 1) for k in range(20)] + [(50, 53), (53, 51), (7, 7)]
    got = {r["id"]: r["cluster_id"] for r in cluster_labels(spark.range(60), spark.createDataFrame(pairs, "i long, j long"), bound=bound).collect()}
    assert got == {k: 0 if k <= 20 else 50 if k in (50, 51, 53) else k for k in range(60)}
    chain = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 5)], "source long, target long")
    assert {r["source"]: r["target"] for r in path_compress(chain, bound=bound).collect()} == {k: 30 for k in [*range(30), 100]}
    with pytest.raises(Exception):  # noqa: B017
        path_compress(spark.createDataFrame([(1, 2), (2, 1)], "source long, target long"), rounds=5, bound=bound).collect()


def test_embedding_pairs_of_clusters_and_noise(spark, monkeypatch):
    import numpy as np

    from storyloom.operators import embeddings
    from storyloom.operators.embeddings import embedding_pairs

    monkeypatch.setattr(embeddings, "PER_PIVOT", 4)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 32))
    x = np.concatenate([*(c + 0.35 * rng.normal(size=(25, 32)) for c in centres), rng.normal(size=(30, 32))])
    at = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(h)) for h in rng.integers(0, 200, len(x))]
    df = spark.createDataFrame([(k, v.tolist(), t) for k, (v, t) in enumerate(zip(x, at))] + [(999, None, at[0]), (998, x[0].tolist(), None)], "id long, embedding array<float>, ts timestamp_ntz")
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for theta in (0.85, 0.3):
        want = {(a, b): round(float(u[a] @ u[b]), 4) for a in range(len(x)) for b in range(a + 1, len(x)) if abs((at[a] - at[b]).total_seconds()) <= 72 * 3600 and round(float(u[a] @ u[b]), 4) > theta}
        for pivots, unit in ((128, 4096), (8, 7)):
            got = embedding_pairs(df, theta, 72, pivots, unit).collect()
            assert len(got) == len(want) and {(r["i"], r["j"]): r["cosine"] for r in got} == pytest.approx(want)


def test_later_passes_decide_on_what_has_changed(spark):
    """Three full passes, each deciding on all pairs, give the same stories and links; the second and third decide on fewer pairs."""
    from storyloom.operators.similarity import decided, merge_apply
    from storyloom.plans.products import merge_passes

    rng = random.Random(5)
    words = "council school river budget strike fire election trial storm harbour museum airport clinic bridge market protest verdict senate tunnel stadium".split()
    start = dt.datetime(2024, 1, 1)
    titles = [" ".join(rng.sample(words, rng.choice((3, 4, 5)))) for _ in range(150)]
    titles[:40] = [None if rng.random() < 0.2 else t for t in titles[:40]]
    rows = [(f"s{k:03d}", t, t, rng.choice(("active", "active", "pinned")), start, start + dt.timedelta(hours=rng.randrange(400)), rng.randrange(1, 5)) for k, t in enumerate(titles)]
    stories = spark.createDataFrame(rows, "id string, title string, summary string, status string, first_seen timestamp_ntz, last_seen timestamp_ntz, article_count long")
    links = spark.createDataFrame([(f"s{k:03d}", k) for k in range(150)], "story_id string, article_id long")
    s, x = stories, links
    full = []
    for _ in range(3):
        decisions = decided(s).cache()
        full.append(decisions.count())
        plan = merge_plan(s, decisions).cache()
        if plan.isEmpty():
            break
        s, x = (y.cache() for y in merge_apply(s, x, plan.select("source", "target")))
    got_s, got_x, counts = merge_passes(stories, links, lambda t, touched: decided(t, touched=touched))
    assert sorted(map(repr, got_s.collect())) == sorted(map(repr, s.collect())) and sorted(map(tuple, got_x.collect())) == sorted(map(tuple, x.collect()))
    assert len(counts) >= 2 and counts[0] == full[0] and all(a < b for a, b in zip(counts[1:], full[1:])), (counts, full)


def test_two_levels_of_pivots_lose_no_pair_and_spare_products(spark, monkeypatch):
    """Clusters in clusters: all pairs above theta are found, with less than a third of the products that one level of pivots asks for."""
    import numpy as np

    from storyloom.operators import embeddings

    monkeypatch.setattr(embeddings, "PER_PIVOT", 4)
    rng = np.random.default_rng(5)
    counts, groups = [], rng.normal(size=(6, 24))
    for n in (600, 2400):
        centres = np.concatenate([g + 0.5 * rng.normal(size=(n // 60, 24)) for g in groups])
        x = np.concatenate([c + 0.03 * rng.normal(size=(10, 24)) for c in centres])
        at = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(h)) for h in rng.integers(0, 60, len(x))]
        df = spark.createDataFrame([(k, v.tolist(), t) for k, (v, t) in enumerate(zip(x, at))], "id long, embedding array<double>, ts timestamp_ntz").repartition(4).cache()
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        cosine = np.round(u @ u.T, 4)
        want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(cosine > 0.99, 1)))}
        got = embeddings.embedding_pairs(df, 0.99, 72, 40).collect()
        assert {(r["i"], r["j"]) for r in got} == want and len(got) == len(want)
        two = embeddings.products(embeddings.embedding_units(df, 0.99, 72, 40))
        monkeypatch.setattr(embeddings, "NUMBERS", 1)
        one = embeddings.products(embeddings.embedding_units(df, 0.99, 72, 40))
        monkeypatch.setattr(embeddings, "NUMBERS", 4 << 20)
        counts.append((two, one))
        df.unpersist()
    assert all(3 * two < one for two, one in counts), counts


def test_vectors_that_cells_cannot_part_are_copied_for_units_only(spark, monkeypatch):
    """Noise under a wide angle: the copies of a vector follow from the units of its bins, not from the number of pivots."""
    import numpy as np

    from storyloom.operators import embeddings

    monkeypatch.setattr(embeddings, "PER_PIVOT", 4)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 32))
    df = spark.createDataFrame([(k, v.tolist(), dt.datetime(2024, 1, 1) + dt.timedelta(hours=k % 60)) for k, v in enumerate(x)], "id long, embedding array<float>, ts timestamp_ntz").repartition(3)
    assert embeddings.embedding_units(df, 0.35).count() <= 7 * 300
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(np.round(u @ u.T, 4) > 0.35, 1)))}
    assert {(r["i"], r["j"]) for r in embeddings.embedding_pairs(df, 0.35).collect()} == want


def test_what_is_held_is_not_copied_for_what_asks(spark):
    """Vectors of one cell cut into parts: one copy of each is held, and one asks for each part of its bin and the next."""
    import numpy as np

    from storyloom.operators import embeddings

    x = np.random.default_rng(9).normal(size=(200, 16))
    df = spark.createDataFrame([(k, v.tolist(), dt.datetime(2024, 1, 1) + dt.timedelta(hours=k % 60)) for k, v in enumerate(x)], "id long, embedding array<float>, ts timestamp_ntz").repartition(3).cache()
    units = embeddings.embedding_units(df, 0.35, unit=20).cache()
    parts = units.agg({"p": "max"}).first()[0] + 1
    assert parts > 5 and units.where("not asks").count() == 200 and units.count() <= 200 * (1 + 2 * parts)
    one = sorted(map(tuple, embeddings.embedding_pairs(df, 0.35).collect()))
    assert one and sorted(map(tuple, embeddings.embedding_pairs(df, 0.35, unit=20).collect())) == one
