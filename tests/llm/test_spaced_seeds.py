import itertools
import random
import re

from conftest_llm import plan_of, prose

from scorelake.llm import common
from scorelake.llm import spaced_seeds as S


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items, window=16, share=0.8):
    """Pairs with a window of equal places, over every alignment."""
    out = set()
    for d, dt in docs:
        for i, it in items:
            a, b = tokens(dt), tokens(it)
            span = min(window, len(b))
            for diagonal in range(-len(b), len(a) + 1):
                lo, hi = max(0, -diagonal), min(len(b), len(a) - diagonal)
                same = [a[diagonal + j] == b[j] for j in range(lo, hi)]
                seeded = any(all(same[k + o] for o, m in enumerate(mask) if m == "1") for mask in S.MASKS for k in range(len(same) - len(mask) + 1))
                if seeded and any(sum(same[k:k + span]) >= share * span for k in range(len(same) - span + 1)):
                    out.add((d, i))
    return out


def test_overlaps_match_brute_force(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.choice([7, 9, 12, 15, 40]))) for i in range(12)] + [(50, None), (51, "")]
    docs = [(i, prose(rng, 50)) for i in range(20)]
    for n, (i, text) in enumerate(items[:12]):
        words = text.split()
        changed = [w if rng.random() > 0.12 else "zzz" for w in words]
        docs += [(100 + n, prose(rng, 10) + " " + text.upper() + ". " + prose(rng, 5)), (200 + n, prose(rng, 30) + " " + ", ".join(changed)), (300 + n, " ".join(words[: len(words) // 2]))]
    docs += [(900, None), (901, ""), (None, items[0][1])]
    got = S.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute([d for d in docs if d[0] is not None], [i for i in items])
    assert len(got) == len({(r.doc_id, r.item_id) for r in got}) and all(r.doc_end - r.doc_start == r.n_compared for r in got)
    text = dict(docs)
    for r in got:
        a, b = tokens(text[r.doc_id])[r.doc_start:r.doc_end], tokens(dict(items)[r.item_id])
        assert max(sum(x == y for x, y in zip(a, b[k:])) for k in range(len(b) - len(a) + 1)) >= r.n_equal


def test_without_broadcast_the_result_is_the_same(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, 30)) for i in range(4)]
    docs = spark.createDataFrame([(i, prose(rng, 20) + " " + items[i % 4][1]) for i in range(8)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda **o: sorted(map(tuple, S.overlaps(docs, bench, **o).collect()))
    assert rows() == rows(most_broadcast=0) != []


def test_many_contaminated_documents_are_not_broadcast(spark, docs_of, monkeypatch):
    rng = random.Random(7)
    item = prose(rng, 30)
    docs = docs_of([(i, prose(rng, 30) + (" " + item if i % 3 == 0 else ""), "en", "a", 1) for i in range(12)])
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    want = sorted(map(tuple, S.decontaminated(docs, bench).collect()))
    monkeypatch.setattr(common, "MOST_BROADCAST", 3)
    out = S.decontaminated(docs, bench)
    assert "SortMergeJoin" in plan_of(out) and "Broadcast" not in plan_of(out)
    assert sorted(map(tuple, out.collect())) == want and len(want) == 8


def test_filter_and_odd_rows(spark, docs_of, odd_rows, clashing):
    rng = random.Random(4)
    item = prose(rng, 40)
    rows = [*odd_rows, (30, prose(rng, 30) + " " + item, "en", "a", 1), (30, prose(rng, 30) + " " + item, "en", "a", 1)]
    bench = spark.createDataFrame([(1, item), (1, item), (2, "same text"), (None, item)], "item_id long, text string")
    df = clashing(docs_of(rows))
    out = S.decontaminated(df, bench)
    assert out.columns == df.columns and out.count() == len(odd_rows) and out.where("doc_id = 30").count() == 0
    assert S.overlaps(docs_of(rows), bench.limit(0)).count() == 0 and S.overlaps(docs_of([]), bench).count() == 0


def test_masks_hit_every_accepted_pattern():
    for span in range(S.LEAST_ITEM, 17):
        masks = S.masks_for(span, 0.8)
        assert set(masks) <= set(S.MASKS)
        differ = max(k for k in range(span + 1) if span - k >= 0.8 * span)
        for places in itertools.combinations(range(span), differ):
            assert any(all(m == "0" or k + o not in places for o, m in enumerate(mask)) for mask in masks for k in range(span - len(mask) + 1)), (span, places)


def test_short_and_changed_items_are_found(spark):
    """Every alignment, with and without a seed: all places of two or three changed words, and items down to three tokens."""
    rng = random.Random(6)
    items = [(i, prose(rng, n)) for i, n in enumerate([3, 4, 5, 6, 7, 8, 10, 12, 16, 20])]
    docs = []
    for i, text in items:
        words = text.split()
        differ = max(k for k in range(17) if len(words[:16]) - k >= 0.8 * len(words[:16]))
        for places in itertools.islice(itertools.combinations(range(len(words[:16])), differ), 0, None, 9):
            docs.append((len(docs), "qq ww " + " ".join("zzz" if k in places else w for k, w in enumerate(words)) + " ee"))
    got = {(r.doc_id, r.item_id) for r in S.overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for d, text in docs:
        a = tokens(text)
        for i, item in items:
            b = tokens(item)
            span = min(16, len(b))
            if any(sum(a[x + k] == b[y + k] for k in range(span)) >= 0.8 * span for x in range(len(a) - span + 1) for y in range(len(b) - span + 1)):
                want.add((d, i))
    assert got == want and {i for _, i in got} == {i for i, _ in items}
