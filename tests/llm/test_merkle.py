import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from siftlog.llm.merkle import down_sweep, fold, manifest, proof_of, up_sweep, widths

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, KEY int"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(digests):
    """The root and, for each leaf, its (before, after) steps, level by level."""
    paths, members, now = [[] for _ in digests], [[i] for i in range(len(digests))], list(digests)
    while len(now) > 1:
        runs = [range(a, min(a + 2, len(now))) for a in range(0, len(now), 2)]
        for run in runs:
            for i in run:
                for leaf in members[i]:
                    paths[leaf].append((now[run[0]:i], now[i + 1:run[-1] + 1]))
        members = [sum((members[i] for i in run), []) for run in runs]
        now = [sha(*(now[i] for i in run)) for run in runs]
    return now[0], paths


def leaf_of(row, change=0):
    values = [row[0], row[3], row[2], None if row[4] is None else row[4] + change, row[1]]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for g in order}
    trees = {g: tree([leaf_of(r) for r in made[g]]) for g in order}
    root, tops = tree([trees[g][0] for g in order]) if order else (None, [])
    out = []
    for g, top in zip(order, tops, strict=True):
        for row, path in zip(made[g], trees[g][1], strict=True):
            steps = path + top
            value = leaf_of(row, int(row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0))
            for before, after in steps:
                value = sha(*before, value, *after)
            out.append((row[0], leaf_of(row), trees[g][0], root, sha(*(d for b, a in steps for d in (*b, *a))), value, value == root))
    return sorted(out, key=repr)


def got(spark, rows, levels=12):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, df["n_chars"] + 1).otherwise(df["n_chars"])
    return sorted((tuple(r) for r in manifest(df, COLUMNS, tampered={"n_chars": changed}, levels=levels).collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 64, 100])
def test_sweeps(n):
    leaves = [sha(str(i)) for i in range(n)]
    root, paths = tree(leaves)
    nodes = up_sweep(leaves, widths(n))
    assert nodes[-1] == root
    made = down_sweep(nodes, widths(n), "")
    assert made == ["".join(f"{''.join(b)}.{''.join(a)};" for b, a in p) for p in paths]
    assert all(fold(leaf, path) == root for leaf, path in zip(leaves, made, strict=True))
    assert [proof_of(p) for p in made] == ["".join(d for b, a in p for d in (*b, *a)) for p in paths]


def test_equals_brute_force_over_several_rounds(spark):
    rng = random.Random(1)
    rows = [(i * 37 % 1009, rng.choice(["", None, "é" * i, "text %d" % i]), rng.choice(["en", "en", "en", "de", None, "", "Z", "zß"]),
             rng.choice([None, "a", "b"]), rng.choice([None, i])) for i in range(400)]
    rows += [rows[5], rows[5], (None, "a", "en", None, 3), (None, "b", "en", None, 3), (7, "other text of the id", "en", None, 1)]
    rows += [(5000 + i, "t", "lang%d" % i, "s", i) for i in range(60)]
    assert got(spark, rows, levels=3) == expected(rows)  # chunks of 8: several rounds
    assert got(spark, rows) == expected(rows)


def test_small_and_long(spark):
    assert got(spark, []) == []
    one = [(3, "w " * 500_000, "en", "s", 1_000_000)]
    assert got(spark, one) == expected(one)
    assert got(spark, one)[0][4] == sha("")
    same = [(1, "x", None, None, None)] * 50
    assert got(spark, same) == expected(same)


def test_path_proves_a_row(spark):
    df = spark.createDataFrame([(i, "t%d" % i, "en" if i % 3 else "fr") for i in range(40)], "doc_id long, text string, lang string")
    rows = manifest(df, ["doc_id", "text"], with_path=True).collect()
    assert all(r.verified and fold(r.leaf, r.path) == r.root for r in rows)
    assert fold(sha("1:3", "5:wrong"), rows[3].path) != rows[3].root
