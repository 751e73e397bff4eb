import random

import numpy as np
import xxhash
from conftest_llm import plan_of, prose

from scorelake.llm import common
from scorelake.llm import simhash_groups as S


def slow_fingerprint(text, words=4):
    tokens = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))]
    if not tokens:
        return 0
    k = min(words, len(tokens))
    hashes = [xxhash.xxh64_intdigest(" ".join(tokens[i:i + k]).encode(), 42) for i in range(len(tokens) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(ids, fps, bits=4):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return {i: min((x for x in groups[find(k)] if x is not None), default=None) for k, i in enumerate(ids)}


def test_fingerprint_is_the_stated_one():
    rng = random.Random(1)
    for text in ["", " \n", "One", "two words", "A b C d e\x0bf", prose(rng, 300), "Été Über naïve café x"]:
        assert S.fingerprint(text) & (2**64 - 1) == slow_fingerprint(text)


def test_components_match_brute_force(spark):
    """Fingerprints planted at every small distance, chains of links, and dense clusters."""
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for base in fps[:40]:
        x = base
        for _ in range(rng.randint(1, 5)):
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            fps.append(x)
    center, places = rng.getrandbits(64), rng.sample(range(64), 9)
    fps += [center ^ sum(1 << p for i, p in enumerate(places) if m >> i & 1) for m in range(0, 512, 3)]
    fps += [0, 1 << 63, 3 << 62, 2**64 - 1]
    signed = [f - 2**64 if f >= 2**63 else f for f in dict.fromkeys(fps)]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long")
    clusters = S.components(S.stars(nodes))
    placed = nodes.join(clusters.toDF("fp", "root"), "fp", "left").selectExpr("fp", "coalesce(root, fp) cluster")
    merged = {r.node: r.root for r in S.components(S.close_pairs(placed)).collect()}
    got = {r.fp: merged.get(r.cluster, r.cluster) for r in placed.collect()}
    want = brute(signed, [f & (2**64 - 1) for f in signed])
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups(got) == groups(want)


def test_grid_loses_no_pair(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(-2**63, 2**63, 30)]
    rows = []
    for b in base:
        for d in range(1, 5):
            m = sum(1 << int(i) for i in rng.choice(64, d, replace=False))
            other = (b ^ m) & (2**64 - 1)
            rows += [(b, b), (other - 2**64 if other >= 2**63 else other, other % 997)]
    nodes = spark.createDataFrame(list({fp: c for fp, c in rows}.items()), "fp long, cluster long")
    got = {(r.a, r.b) for r in S.close_pairs(nodes).collect()}
    cluster = {r.fp: r.cluster for r in nodes.collect()}
    fps = list(cluster)
    want = {(max(cluster[a], cluster[b]), min(cluster[a], cluster[b])) for a in fps for b in fps
            if a < b and cluster[a] != cluster[b] and bin((a ^ b) & (2**64 - 1)).count("1") <= 4}
    assert got == want


def test_long_chain_in_few_rounds(spark, monkeypatch):
    """Labels in the chain's order, in which each round of an order that stays the same would take one node off."""
    rounds, stored = [], S.stored
    monkeypatch.setattr(S, "stored", lambda df, purpose: (rounds.append(purpose), stored(df, purpose))[1])
    links = spark.range(1, 10_000).selectExpr("id a", "id - 1 b")
    got = S.components(links)
    assert got.count() == 10_000 and got.select("root").distinct().count() == 1
    assert rounds.count("parents") <= 30


def test_odd_rows(spark, docs_of, odd_rows, clashing):
    got = S.near_groups(clashing(docs_of(odd_rows))).collect()
    by_fp = {}
    for r in got:
        by_fp.setdefault(r.fp, set()).add(r.component_id)
    assert len(got) == len(odd_rows) and by_fp[0] == {1} and {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    assert S.near_groups(docs_of([])).count() == 0


def test_dedup_keeps_one_of_each_group(spark, docs_of, odd_rows, clashing):
    rng = random.Random(8)
    text = prose(rng, 2000)
    rows = [*odd_rows, (20, text, "en", "a", 1), (21, text + " more", "en", "a", 1), (22, prose(rng, 2000), "en", "a", 1)]
    df = clashing(docs_of(rows))
    out = S.near_dedup(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, 1), (False, 4), (False, 5), (False, 7), (False, 20), (False, 22), (True, 0)]


def test_dedup_tells_rows_of_one_id_apart(docs_of):
    rng = random.Random(2)
    a, b, c, d = (prose(rng, 300) for _ in range(4))
    rows = [(5, a, "en", "a", 1), (5, b, "en", "a", 1), (6, c, "en", "a", 1), (5, a, "en", "b", 2), (None, d, "en", "a", 1), (None, d, "en", "a", 1), (None, c, "en", "a", 1)]
    got = [(r.doc_id, r.text) for r in S.near_dedup(docs_of(rows)).collect()]
    assert sorted(got, key=str) == sorted([(5, a), (5, b), (6, c), (None, d)], key=str)


def test_dedup_is_one_row_of_each_brute_force_component(docs_of):
    rng, texts = random.Random(11), []
    for n in (3, 30, 200, 600):
        for _ in range(6):
            words = prose(rng, n).split()
            texts += [" ".join(words)] * rng.randint(1, 3)
            for changes in (1, 2, 5):
                for at in rng.sample(range(n), min(changes, n)):
                    words[at] = f"x{rng.random()}"
                texts.append(" ".join(words))
    rng.shuffle(texts)
    fps = [slow_fingerprint(t) for t in texts]
    least = brute(list(range(len(texts))), fps)
    got = [r.doc_id for r in S.near_dedup(docs_of([(i, t, "en", "a", 1) for i, t in enumerate(texts)])).collect()]
    assert sorted(got) == sorted(set(least.values())) and len(got) < len(texts)


def test_grid_points_are_not_broadcast(spark):
    """A stored table of nodes is small by its files, its points are some fifty times as many."""
    nodes = common.stored(spark.range(1000).selectExpr("xxhash64(id) fp", "id cluster"), "nodes")
    plan = plan_of(S.close_pairs(nodes))
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def seen_plans(monkeypatch):
    """Plans of all that is stored, which is now more than may be broadcast."""
    plans, stored = [], S.stored
    monkeypatch.setattr(common, "MOST_BROADCAST", -1)
    monkeypatch.setattr(S, "stored", lambda df, purpose: (plans.append(plan_of(df)), stored(df, purpose))[1])
    return plans


def test_dedup_broadcasts_no_table_of_many_rows(docs_of, odd_rows, monkeypatch):
    rng = random.Random(4)
    text = prose(rng, 400)
    df = docs_of([*odd_rows, *[(30 + i, text + f" w{i}", "en", "a", 1) for i in range(5)]])
    want = sorted(map(str, S.near_dedup(df).collect()))
    plans = seen_plans(monkeypatch)
    out = S.near_dedup(df)
    plans.append(plan_of(out))
    assert sorted(map(str, out.collect())) == want
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_groups_broadcast_no_table_of_many_rows(docs_of, odd_rows, monkeypatch):
    rng = random.Random(4)
    text = prose(rng, 400)
    df = docs_of([*odd_rows, *[(30 + i, text + f" w{i}", "en", "a", 1) for i in range(5)]])
    want = sorted(map(str, S.near_groups(df).collect()))
    plans = seen_plans(monkeypatch)
    out = S.near_groups(df)
    plans.append(plan_of(out))
    assert sorted(map(str, out.collect())) == want
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
