import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackdensity.functions import columns as C
from trackdensity.operators import chains
from trackdensity.sources.run_store import RunStore

FEATURES, DEPTH, BINS, MIN_ROWS, ROUNDS, PATIENCE = ["a", "b"], 2, 8, 4, 3, 1
RATE = lambda k: 0.5 * 0.9**k


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    out, t0 = [], dt.datetime(2024, 1, 1)
    for i in range(12 * 18):
        a, b = float(rng.normal()), float(rng.integers(5))
        y = math.sin(a) + 0.3 * b + 0.05 * (i // 18) + float(rng.normal()) * 0.1
        out.append((i, t0 + dt.timedelta(minutes=80 * i), a, b, y))
    return out


@pytest.fixture(scope="module")
def fitted(spark, rows):
    df = spark.createDataFrame(rows, "id long, time timestamp, a double, b double, y double").repartition(4)
    plan = chains.chain_plan(df.select(F.to_date("time").alias("day")).distinct(), 2)
    got = chains.fit(df, plan, "y", FEATURES, lambda r: C.pseudo_huber(r, 1.0), RATE, ROUNDS, ["time", "id"], depth=DEPTH, bins=BINS, min_rows=MIN_ROWS, patience=PATIENCE)
    return df, plan, got


def huber(r):
    s = 1 + r * r
    return r / math.sqrt(s), 1 / (s * math.sqrt(s))


def whole(x):
    return int(math.floor(abs(x) * 2**20 + 0.5)) * (1 if x >= 0 else -1)


def brute(rows, plan, cuts):
    """One chain after the other, one fold after the other, in plain Python."""
    bins = {r[0]: [sum(c < x for c in cuts[f]) for f, x in zip(FEATURES, r[2:4])] for r in rows}
    label = {r[0]: r[4] for r in rows}
    day = {}
    for r in rows:
        day.setdefault(r[1].date(), []).append(r[0])
    folds = {}
    for p in plan:
        folds.setdefault((p.chain, p.pos, p.fold), {}).setdefault(p.role, []).append(p.day)
    forecasts, kept, models = {}, {}, {}
    score = lambda g, h: (g / 2**20) ** 2 / (h / 2**20 + 1.0)

    def grow(ids, y):
        gh = {i: tuple(map(whole, huber(y[i] - label[i]))) for i in ids}
        nodes, at = {}, dict.fromkeys(ids, 1)
        for _ in range(DEPTH):
            for node in sorted(set(at.values())):
                own = [i for i in ids if at[i] == node]
                best = None
                for f in range(len(FEATURES)):
                    for b in sorted({bins[i][f] for i in own}):
                        lo, hi = [i for i in own if bins[i][f] <= b], [i for i in own if bins[i][f] > b]
                        if min(len(lo), len(hi)) < MIN_ROWS:
                            continue
                        s = [[sum(gh[i][k] for i in part) for k in (0, 1)] for part in (lo, hi)]
                        gain = round(score(*s[0]) + score(*s[1]) - score(s[0][0] + s[1][0], s[0][1] + s[1][1]), 9)
                        if gain > 0 and (best is None or (gain, -f, -b) > best):
                            best = (gain, -f, -b)
                if best and node not in nodes:
                    nodes[node] = (-best[1], -best[2])
            at = {i: (2 * n + (bins[i][nodes[n][0]] > nodes[n][1]) if n in nodes and n < 2 ** (DEPTH + 1) else n) for i, n in at.items()}
        value = {}
        for node in set(at.values()):
            g, h = (sum(gh[i][k] for i in ids if at[i] == node) for k in (0, 1))
            value[node] = -(g / 2**20) / (h / 2**20 + 1.0)
        return nodes, value

    def predict(tree, i):
        nodes, value = tree
        at = 1
        while at in nodes:
            at = 2 * at + (bins[i][nodes[at][0]] > nodes[at][1])
        return value.get(at, 0.0)

    for chain in sorted({c for c, _, _ in folds}):
        model = []
        for _, pos, fold in sorted(k for k in folds if k[0] == chain):
            parts = folds[chain, pos, fold]
            ids = [i for d in sorted(parts["train"]) for i in day.get(d, [])]
            size = len(ids) // 6
            val = {i for n, i in enumerate(ids) if min(n // size, 5) in (3, 4)}
            train = [i for i in ids if i not in val]
            best, since, grown, stay = float("inf"), 0, list(model), list(model)
            for k in range(ROUNDS):
                y = {i: sum(r * predict(t, i) for r, t in grown) for i in ids}
                grown.append((RATE(k), grow(train, y)))
                err = sum(whole((sum(r * predict(t, i) for r, t in grown) - label[i]) ** 2) for i in val) / 2**20 / len(val)
                if err < best:
                    best, since, stay = err, 0, list(grown)
                else:
                    since += 1
                    if since >= PATIENCE:
                        break
            kept[chain, pos] = len(stay) - len(model)
            model = stay
            models[fold] = model
            for d in parts["forecast"]:
                for i in day.get(d, []):
                    forecasts[fold, i] = sum(r * predict(t, i) for r, t in model)
    return forecasts, kept, {f: {i: sum(r * predict(t, i) for r, t in m) for i in label} for f, m in models.items()}


def test_all_chains_at_once_equal_one_fold_after_the_other(rows, fitted):
    df, plan, got = fitted
    forecasts, kept, models = brute(rows, plan.collect(), got.cuts)
    assert {(r.chain, r.pos): r.rounds for r in got.kept.collect()} == kept
    mine = {(r.fold, r.id): r.prediction for r in got.forecasts.collect()}
    assert mine.keys() == forecasts.keys() and len({f for f, _ in mine}) == 5
    assert all(abs(mine[k] - forecasts[k]) < 1e-9 for k in mine)
    for fold in (2, 4):  # a fold's snapshot, applied to rows it never saw
        scored = {r.id: r.prediction for r in got.snapshot(fold).score(df).collect()}
        assert all(abs(scored[i] - p) < 1e-9 for i, p in models[fold].items())


def test_stored_snapshot_scores_the_same(spark, fitted, tmp_path):
    df, _, got = fitted
    store = RunStore(spark, str(tmp_path), "dr1_all_h2")
    run = store.begin()
    got.snapshot(4).save(run, "snapshot")
    run.commit()
    pick = lambda m: sorted(tuple(r) for r in m.score(df, F.lit(1.5)).select("id", "prediction").collect())
    assert pick(chains.Trees.load(store, "snapshot")) == pick(got.snapshot(4))


def test_jobs_do_not_grow_with_the_folds(spark, rows, monkeypatch):
    def jobs(n_rows):
        df = spark.createDataFrame(rows[:n_rows], "id long, time timestamp, a double, b double, y double")
        plan = chains.chain_plan(df.select(F.to_date("time").alias("day")).distinct(), 1)
        done = []
        save = chains.saved
        monkeypatch.setattr(chains, "saved", lambda d, n: done.append(n) or save(d, n))
        chains.fit(df, plan, "y", FEATURES, lambda r: C.pseudo_huber(r, 1.0), RATE, 1, ["time", "id"], depth=1, bins=4, min_rows=4)
        monkeypatch.setattr(chains, "saved", save)
        return len(done), plan.select("fold").distinct().count()

    few, many = jobs(9 * 18), jobs(11 * 18)
    assert few[0] <= many[0] <= few[0] + 3 * 2 and many[1] > few[1]


def test_plan_and_blocks(spark, fitted):
    _, plan, _ = fitted
    every = plan.collect()
    assert all(r.pos == (r.fold + 4) % 7 and r.chain == str((r.fold + 4) // 7) for r in every) and {r.fold for r in every} == set(range(5))


def test_rounds_move_blocks_and_not_rows(spark, rows, fitted, monkeypatch):
    """Each round wrote a row for each row and chain, with the plan's map beside it (F8, F10, F12). Small blocks and early writes change nothing."""
    df, plan, whole = fitted
    written, save = [], chains.saved

    def saved(d, name):
        out = save(d, name)
        written.append((name, out.count()))
        return out

    for name, value in (("saved", saved), ("BLOCK", 9), ("EVERY", 1), ("NODES_HELD", 4)):
        monkeypatch.setattr(chains, name, value, raising=False)
    got = chains.fit(df, plan, "y", FEATURES, lambda r: C.pseudo_huber(r, 1.0), RATE, ROUNDS, ["time", "id"], depth=DEPTH, bins=BINS, min_rows=MIN_ROWS, patience=PATIENCE)
    assert all(n < len(rows) / 2 for name, n in written if name == "state")
    pick = lambda x: sorted((r.chain, r.fold, r.id, r.prediction) for r in x.forecasts.collect())
    assert pick(got) == pick(whole) and sorted(map(tuple, got.kept.collect())) == sorted(map(tuple, whole.kept.collect()))
