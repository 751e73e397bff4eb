"""Tree digests of files: one result for any split and either way of reading."""

import hashlib
import random

import pytest

from scorelake.sources.fingerprints import listed_files, table_fingerprint, tree_fingerprints


def by_hand(data, chunk, fan):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    leaves = [sha(data[i:i + chunk]) for i in range(0, max(len(data), 1), chunk)]
    blocks = [sha("".join(leaves[i:i + fan]).encode()) for i in range(0, len(leaves), fan)]
    return sha(f"{len(data)}:{''.join(blocks)}".encode())


@pytest.fixture()
def files(tmp_path):
    rng = random.Random(1)
    found = {f"a b{n}.bin": rng.randbytes(n) for n in (1, 63, 64, 65, 256, 1000, 5000)}
    for name, data in found.items():
        (tmp_path / "data" / "sub").mkdir(parents=True, exist_ok=True)
        (tmp_path / "data" / ("sub" if len(data) % 2 else ".") / name).write_bytes(data)
    return str(tmp_path / "data"), found


@pytest.mark.parametrize("options", [{}, {"task_bytes": 100}, {"task_bytes": 1 << 30}, {"ranges": False}])
def test_any_split_gives_the_digest(spark, files, options):
    folder, found = files
    rows = tree_fingerprints(spark, folder, chunk=64, fan=4, **options).collect()
    got = {r.length: r.tree_sha256 for r in rows}
    assert got == {len(d): by_hand(d, 64, 4) for d in found.values()} and len(rows) == len(found)


def test_chunks_of_one_file_are_spread(spark, files):
    folder, _ = files
    from scorelake.sources.fingerprints import _chunk_digests

    parts = _chunk_digests(listed_files(spark, folder).where("length = 5000"), 64, 500)
    assert parts.rdd.getNumPartitions() == 10
    assert sum(1 for n in parts.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n) > 3


def test_a_changed_byte_changes_file_and_table(spark, files, tmp_path):
    folder, found = files
    table = lambda: table_fingerprint(tree_fingerprints(spark, folder, 64, 4), folder).first()
    before = table()
    assert (before.files, before.bytes) == (len(found), sum(map(len, found.values())))
    name = "a b1000.bin"
    data = bytearray(found[name])
    data[500] ^= 1
    (tmp_path / "data" / name).write_bytes(bytes(data))
    assert table().sha256 != before.sha256
    (tmp_path / "data" / name).write_bytes(found[name])
    assert table() == before


def test_a_folder_without_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert tree_fingerprints(spark, str(tmp_path / "none")).count() == 0
