"""The Merkle manifest against a plain tree."""

from __future__ import annotations

import hashlib
import zlib

import pytest

from textloom.llm import merkle, queries


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """Root of hex digests and the siblings of each leaf, level by level."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(nodes) > 1:
        for path, i in zip(paths, at):
            run = nodes[i // 3 * 3 : i // 3 * 3 + 3]
            path.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        at = [i // 3 for i in at]
    return nodes[0], paths


def leaf(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain(rows):
    """Contract rows from (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, (r[1] or "").encode(), r[0] is not None, r[0] or 0, leaf(*r))):
        trees.setdefault(r[1], []).append(r)
    made = [tree([leaf(*r) for r in part]) for part in trees.values()]
    root, tops = tree([m[0] for m in made])
    out = []
    for part, (subroot, paths), top in zip(trees.values(), made, tops):
        for r, path in zip(part, paths):
            text = r[4].replace("\n", "") if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4]
            node = leaf(*r[:4], text)
            for before, after in path + top:
                node = sha(before, node, after)
            out.append((r[0], leaf(*r), subroot, root, sha(*(b + a for b, a in path + top)), node, node == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, root string, block long"


@pytest.mark.parametrize("n", [*range(1, 31), 80, 81, 82, 242, 700])
def test_traversal(n):
    leaves = [sha(str(i)) for i in range(n)]
    levels = merkle.height(n, 20)
    root, paths = tree(leaves)
    assert merkle.block_root([x.encode() for x in leaves], levels).decode() == root
    found = [list(map(bytes.decode, p)) for p in merkle.proofs([x.encode() for x in leaves], levels)]
    assert found == [[s for pair in path for s in pair] for path in paths]


def test_stacks_stay_small():
    runs = merkle.Runs(5, [b"x"] * 729)
    most = 0
    for _ in range(729):
        runs.feed()
        most = max(most, sum(map(len, runs.tree.waiting)) + len(runs.nodes))
    assert most <= 2 * 5 + 3


def check(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.QUERIES["op13_merkle_traversal_manifest"](spark, str(tmp_path)).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


def test_edges(spark, tmp_path):
    """Nulls anywhere, empty and long texts, ties and repeats, sources that sort bytewise, clashing names."""
    rows = [(1, "b", "en", 3, "a\nb"), (2, "b", None, None, None), (None, "b", "en", 1, "\n"), (None, None, None, None, None), (3, None, "x", 0, ""), (4, "", "é", 5, "é\n\n" * 300_000)]
    rows += [(5, "B", "en", 1, "x"), (5, "B", "en", 1, "x"), (5, "B", "en", 2, "y\n"), (6, "ä", "-", -1, "-"), (7, "z", "1:", 2, "\n1:x"), (-8, "z", "en", 1, "a\n")]
    check(spark, rows, tmp_path)


def test_two_stages_and_hot_rows(spark, tmp_path, monkeypatch):
    """Blocks of nine leaves, so that trees take several stages; a third of the rows are one row repeated."""
    monkeypatch.setattr(merkle.manifest, "__defaults__", (None, 2))
    rows = [(i, f"s{i % 13 % 11}" if i % 3 else "hot", "en", 1, f"t\n{i}") for i in range(400)] + [(7, "hot", "en", 1, "same\n")] * 200
    check(spark, rows, tmp_path)


def test_ranges(spark):
    from textloom.llm import ranks, storage

    rows = [("a" if i % 3 else str(i % 7), i % 50 // 10) for i in range(3000)] + [("hot", 1)] * 2000
    with storage.Scratch(spark) as scratch:
        got = ranks.positions(spark.createDataFrame(rows, "g string, o long"), "g", ["o"], scratch, per_range=300).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["g"], []).append((r["position"], r["o"], r["n"]))
    for g, part in groups.items():
        part.sort()
        assert [p[0] for p in part] == list(range(len(part))) and [p[1] for p in part] == sorted(o for x, o in rows if x == g) and {p[2] for p in part} == {len(part)}


def test_empty_and_unchanged(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest(empty).collect() == []
    one = merkle.manifest(spark.createDataFrame([(1, "s", "en", 1, "x", "", 1)], SCHEMA)).first()
    assert one["verified"] and one["leaf"] == one["root"] == one["subroot"] and one["proof_sha256"] == sha("")
