import math
import os
import random
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from conftest_llm import prose
from pyspark.sql import functions as F

import corpus_pipeline as C
from scorelake.llm import quality_rules, simhash_groups, source_mixing, spaced_seeds, token_shards
from scorelake.llm.queries import CHECKS, QUERIES

ROOT = Path(__file__).resolve().parents[2]
FOLDER = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not Path(FOLDER).exists(), reason="driver tables are absent")


def test_stages_and_names():
    assert [n for n, _ in C.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_shards"]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14)) and set(CHECKS) <= set(QUERIES)


@here
def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in C.STAGES:
        out = stage(spark, docs, FOLDER)
        if name == "token_shards":
            assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
            break
        assert out.columns == docs.columns
        before, rows = {r.doc_id for r in docs.select("doc_id").collect()}, out.collect()
        assert {r.doc_id for r in rows} <= before and all(texts[r.doc_id] == r.text for r in rows)
        if name == "simhash_near_dedup":
            fps = [simhash_groups.fingerprint(r.text) & (2**64 - 1) for r in rows]
            assert len(rows) < len(before) and min(bin(a ^ b).count("1") for i, a in enumerate(fps) for b in fps[:i]) > 4
        if name == "benchmark_decontamination":
            assert spaced_seeds.overlaps(out, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).count() == 0 and len(rows) < len(before)
        docs = spark.createDataFrame(rows, docs.schema)
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_shards.default_tokenizer())
    last, start = out.orderBy("start").collect(), 0
    kept = sorted(r.doc_id for r in docs.collect())
    assert [r.doc_id for r in last] == kept
    for r in last:
        ids = np.array(whole.encode(texts[r.doc_id], add_special_tokens=False).ids + [2], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


@here
def test_run_is_repeatable(spark):
    assert sorted(map(tuple, C.run(spark, FOLDER).collect())) == sorted(map(tuple, C.run(spark, FOLDER).collect()))


def fences(values, groups, spark):
    """Fences of the quality rules from sorted values, by the rules' own table of slacks."""
    def quartile(sorted_values, share):
        value = sorted_values[-(-len(sorted_values) * share // 4) - 1]
        fine = max(value.bit_length() - 6, 0)
        return value >> fine << fine

    out = {}
    for name, (_, below, above) in quality_rules.RATES.items():
        for group in set(groups.values()):
            mine = [values[i][name] for i in values if groups[i] == group]
            if len(mine) < 50:
                mine = [values[i][name] for i in values if groups[i][0] == group[0]]
            if len(mine) < 50:
                mine = [v[name] for v in values.values()]
            mine.sort()
            q1, q3 = quartile(mine, 1), quartile(mine, 3)
            out[name, group] = (q1 - max(3 * (q3 - q1), below) if below is not None else 0, q3 + max(3 * (q3 - q1), above))
    return out


def by_hand(spark, rows, items):
    """The five stages in plain Python: (doc_id, start, n_tokens, ids_crc32) of the rows (doc_id, text, lang, source, n_chars)."""
    from test_quality_rules import WORD, measures
    from test_simhash_groups import brute, slow_fingerprint
    from test_source_mixing import entropy, weights
    from test_spaced_seeds import tokens
    from tokenizers import Tokenizer

    # Quality: measures, quartiles of their sketches, fences.
    texts, groups, values = {r[0]: r[1] or "" for r in rows}, {r[0]: (r[2], r[3]) for r in rows}, {}
    for i, text in texts.items():
        n, chars, symbols, dups, repeats = measures(text)
        if n >= 10 and 100 * repeats <= 20 * n:
            lines = len([x for x in text.split("\n") if WORD.search(x)])
            values[i] = {"word_length": 1000 * chars // n, "symbols": 1000 * symbols // n, "capitals": 1000 * len(re.findall("[A-Z]", text)) // n, "dup_lines": 1000 * dups // lines, "repeats": 1000 * repeats // n}
    limits = fences(values, {i: groups[i] for i in values}, spark)
    kept = sorted(i for i, v in values.items() if all(limits[m, groups[i]][0] <= v[m] <= limits[m, groups[i]][1] for m in v))
    # Near duplicates: all pairs of fingerprints.
    kept = sorted(set(brute(kept, [slow_fingerprint(texts[i]) for i in kept]).values()))
    # Benchmark passages: every alignment.
    def shares_a_passage(text):
        a = tokens(text)
        for item in items:
            b = tokens(item)
            span = min(16, len(b))
            if span >= 3 and any(sum(x == y for x, y in zip(a[p:p + span], b[q:q + span])) >= 0.8 * span for p in range(len(a) - span + 1) for q in range(len(b) - span + 1)):
                return True
        return False

    kept = [i for i in kept if not shares_a_passage(texts[i])]
    # Mixing: the exponent by plain bisection, then blocks in their keyed order.
    count = {i: len(WORD.findall(texts[i])) for i in kept}
    total, names = sum(count.values()), sorted({groups[i][1] for i in kept})
    share = [sum(count[i] for i in kept if groups[i][1] == s) / total for s in names]
    wanted, low, high = entropy(share) + 0.9 * (math.log(len(share)) - entropy(share)), 0.0, 1.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if entropy(weights(share, middle)) >= wanted else (low, middle)
    assert max(w / p for w, p in zip(weights(share, low), share)) < 4
    at = {r.i: r.at for r in spark.createDataFrame([(i,) for i in kept], "i long").select("i", source_mixing.place(F.col("i"), 17).alias("at")).collect()}
    taken = []
    for name, weight in zip(names, weights(share, low)):
        mine = sorted((i for i in kept if groups[i][1] == name), key=at.get)
        blocks, room, turn = sorted({at[i] >> 55 for i in mine}), math.floor(weight * total), 0
        while room > 0:
            order = [r.b for r in spark.createDataFrame([(b, turn) for b in blocks], "b int, p int").orderBy(F.xxhash64(F.lit(17), "p", "b"), "b").collect()]
            for block in order:
                for i in (i for i in mine if at[i] >> 55 == block):
                    if room >= count[i]:
                        room -= count[i]
                        taken.append(i)
                    else:
                        room = 0
                        break
                if room <= 0:
                    break
            turn += 1
    # Token ids of the whole texts, in order of id.
    coder, start, out = Tokenizer.from_file(token_shards.default_tokenizer()), 0, []
    for i in sorted(taken):
        ids = np.array(coder.encode(texts[i], add_special_tokens=False).ids + [2], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_run_against_plain_python(spark, tmp_path):
    rng, rows = random.Random(12), []
    items = [prose(rng, 24) for _ in range(4)]
    for i in range(260):
        text = prose(rng, rng.randint(20, 140)).capitalize() + "."
        rows.append((i, text, "en" if i % 4 else "de", "web" if i % 10 < 7 else "book" if i % 10 < 9 else "code", len(text)))
    other = len(rows)
    for k in range(20):
        base = rows[rng.randrange(other)]
        rows.append((len(rows), base[1], *base[2:]))
        words = rows[rng.randrange(other)][1].split()
        rows.append((len(rows), " ".join([*words, "tail"]), "en", "web", 1))
        words = items[k % 4].split()
        words[k % 24] = "other"
        rows.append((len(rows), prose(rng, 30) + " " + " ".join(words) + " " + prose(rng, 20), "en", "web", 1))
        rows.append((len(rows), " ".join(w + "%$#" for w in prose(rng, 30).split()), "en", "web", 1))
        rows.append((len(rows), (prose(rng, 6) + "\n") * 8, "en", "book", 1))
    rows += [(len(rows), "", "en", "web", 0), (len(rows) + 1, "few words only", "en", "web", 3)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = sorted(map(tuple, C.run(spark, folder).collect()), key=lambda r: r[1])
    want = by_hand(spark, rows, items)
    assert got == want and 100 < len({r[0] for r in want}) <= 260


def test_no_local_checkpoint_and_no_pair_join():
    for path in [*(ROOT / "scorelake" / "llm").glob("*.py"), ROOT / "corpus_pipeline.py"]:
        text = path.read_text(encoding="utf-8")
        assert "localCheckpoint" not in text and "crossJoin" not in text and "tempfile" not in text


def test_entry_without_the_package(tmp_path):
    """The other queries import where the package, its tests and the pipeline are gone."""
    for name in ("scorelake", "__spark_entry__.py"):
        source, target = ROOT / name, tmp_path / name
        if source.is_dir():
            for f in source.rglob("*.py"):
                if "llm" not in f.relative_to(source).parts:
                    (target / f.relative_to(source)).parent.mkdir(parents=True, exist_ok=True)
                    (target / f.relative_to(source)).write_bytes(f.read_bytes())
        else:
            target.write_bytes(source.read_bytes())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not [n for n in q if n.startswith('op')]; print(len(q))"
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0 and int(run.stdout) > 150, run.stderr
