import hashlib
import random
import zlib

import pytest
from conftest_llm import prose

from scorelake.llm.merkle import PACK, Manifest, built, descend, folded, from_bytes, verified

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS])


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [digest(*nodes[i:i + 3]) for i in range(0, len(nodes), 3)]
        out.append(nodes)
    return out


def brute(rows):
    """All columns of the query, one list level after the other."""
    by_id = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r))
    trees = {}
    for r in sorted(rows, key=by_id):
        trees.setdefault(r["source"], []).append(r)
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    own = {s: levels([leaf(r) for r in trees[s]]) for s in names}
    high = levels([own[s][-1][0] for s in names])
    out = []
    for place, s in enumerate(names):
        for nth, r in enumerate(trees[s]):
            changed = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and r["text"] is not None
            fold, siblings = leaf({**r, "text": r["text"].replace("\n", "")} if changed else r), []
            for each, at in ((own[s], nth), (high, place)):
                for level in each[:-1]:
                    run, digit = level[at // 3 * 3:at // 3 * 3 + 3], at % 3
                    siblings += run[:digit] + run[digit + 1:]
                    fold, at = digest(*run[:digit], fold, *run[digit + 1:]), at // 3
            out.append((r["doc_id"], leaf(r), own[s][-1][0], high[-1][0], digest(*siblings), fold, fold == high[-1][0]))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r))


@pytest.fixture()
def dicts(odd_rows):
    return lambda rows: [dict(zip(["doc_id", "text", "lang", "source", "n_chars"], r)) for r in rows]


def test_odd_rows(docs_of, odd_rows, clashing, dicts):
    rows = odd_rows + [(None, "no id here", "en", "a", 1), (10, "a\nb", "en", "ä", 3), (11, "a\nb", "en", "z", 3), (12, "a\n", "en", "+", 2), (15, "x\ny", "en", "", 2)]
    out = verified(clashing(docs_of(rows)))
    assert ordered(out.drop("proof").collect()) == ordered(brute(dicts(rows)))


def test_many_rows_over_several_tiers(docs_of, dicts):
    rng = random.Random(4)
    rows = [(rng.randrange(50_000) if rng.random() < 0.99 else None, rng.choice(["one\ntwo", "text", None, ""]), "en", rng.choice(["a"] * 60 + ["b", "c", None]), n) for n in range(2 * PACK + 700)]
    rows += [(n, "t", "en", f"source {n}", n) for n in range(400)]
    out = verified(docs_of(rows), keep_proof=False)
    assert ordered(out.collect()) == ordered(brute(dicts(rows)))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 27, 28, PACK])
def test_one_source_of_any_size(docs_of, dicts, n):
    rows = [(i, f"text {i}\n", "en", "s", i) for i in range(n)]
    assert ordered(verified(docs_of(rows), keep_proof=False).collect()) == ordered(brute(dicts(rows)))


def test_descent_finds_every_node():
    rng = random.Random(8)
    for n in (1, 2, 3, 4, 9, 10, 82, 700):
        leaves = [rng.randbytes(32) for _ in range(n)]
        root, records, height = built(leaves, True)
        for rank, own in enumerate(leaves):
            node, path = descend(dict(records), root, height, rank)
            assert node == own and folded(node, path) == root and folded(rng.randbytes(32), path) != root


def test_records_and_proofs_as_stored(docs_of):
    rng = random.Random(6)
    docs = docs_of([(i, prose(rng, 3), "en", "ab"[i % 2], i) for i in range(40)])
    own = Manifest(docs)
    records = {r["digest"]: r["children"] for r in own.records().collect()}
    assert all(digest(*children) == name for name, children in records.items())
    held, waiting = set(), [own.root.hex()]
    while waiting:
        node = waiting.pop()
        held.add(node)
        waiting += records.get(node, [])
    out = verified(docs).collect()
    assert {r["leaf"] for r in out} <= held and all(r["verified"] for r in out)
    assert all(folded(bytes.fromhex(r["leaf"]), from_bytes(bytes(r["proof"]))).hex() == r["root"] for r in out)


def test_a_lost_record_is_an_error():
    _, records, height = built([bytes([i]) * 32 for i in range(5)], True)
    with pytest.raises(KeyError):
        descend(dict(records[1:]), records[-1][0], height, 0)


def test_empty_table(docs_of):
    out = verified(docs_of([]))
    assert out.count() == 0 and out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof"]
