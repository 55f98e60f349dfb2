import random
import zlib
from collections import Counter

import pytest

from siftlog.llm.spelling import Grams, near_pairs, variants, word_counts

LETTERS = "abcdeé"


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def some_words(rng, n, least=7, most=11):
    words = {"".join(rng.choice(LETTERS) for _ in range(rng.randint(least, most))) for _ in range(n)}
    for w in list(words):
        for _ in range(2):
            i = rng.randrange(len(w))
            words.add(rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(LETTERS) + w[i:], w[:i] + rng.choice(LETTERS) + w[i + 1:]]))
    return sorted(words)


def dictionary(words, common):
    counts = Counter(w[i:i + n] for w in words for n in range(2, 5) for i in range(len(w) - n + 1))
    ranks = sorted((n, g) for g, n in counts.items() if n > common)
    return Grams(frozenset(g for g in counts if len(g) > 2 and counts[g[:-1]] > common), {g: i for i, (_, g) in enumerate(ranks)})


@pytest.mark.parametrize("common", [3, 30])
def test_bound_holds_for_every_edit(common):
    rng = random.Random(common)
    words = some_words(rng, 300)
    grams = dictionary(words, common)
    for w in rng.sample(words, 60):
        parts = grams.parts(w)
        bound = grams.affected(w, parts)
        for i in range(len(w) + 1):
            edits = [(w[:i] + c + w[i:], 1, i) for c in LETTERS] + (
                [(w[:i] + c + w[i + 1:], 0, i + 1) for c in LETTERS] + [(w[:i] + w[i + 1:], -1, i + 1)] if i < len(w) else [])
            for t, shift, after in edits:
                there = set(grams.parts(t))
                lost = sum(not (((s, e) in there and e <= i) or ((s + shift, e + shift) in there and s >= after)) for s, e in parts)
                assert lost <= bound, (w, t)
                if t != w:  # and the two list a common gram
                    mine, theirs = grams.listed(w), grams.listed(t)
                    assert any(g == h and (b == a or b == a + shift) for g, a in mine for h, b in theirs), (w, t)


def test_near_pairs_equal_brute_force(spark):
    words = some_words(random.Random(7), 300)
    words += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", *("é" * n for n in (63, 64, 65, 66, 400, 401)), "é" * 63 + "a", "a" + "é" * 64, "é" * 399 + "a"]
    words += ["a" * i + "b" * (64 + k - i) for i in range(0, 60, 9) for k in (0, 1)]
    want = sorted((a, b) if (len(a), a) < (len(b), b) else (b, a) for i, a in enumerate(words) for b in words[i + 1:] if one_edit(a, b))
    df = spark.createDataFrame([(w,) for w in set(words)], "word string")
    for grams in (dictionary(words, 5), None):
        assert sorted(tuple(r) for r in near_pairs(df, grams).collect()) == sorted(set(want))


def expected(rows, least=7, times=10):
    counts = Counter()
    for i, text in rows:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for w in "".join(c if "a" <= c <= "z" or "À" <= c <= "ÿ" else " " for c in text).split():
            if i is not None:
                h = zlib.crc32(f"{i}:{w}".encode())
                if h % 31 == 0:
                    w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least and n >= 2}
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words.get(form[w], -1)) for w, n in words.items())


def test_variants_equal_brute_force(spark):
    rng = random.Random(3)
    base = ["running", "running", "grammar", "Ëlegant×s", "straße", "colouring", "spelling", "analysis"]
    rows = []
    for i in range(300):
        words = []
        for _ in range(rng.randrange(60)):
            w = base[min(int(rng.expovariate(0.6)), len(base) - 1)]
            if rng.random() < 0.08:
                at = rng.randrange(len(w))
                w = w[:at] + rng.choice(["", "x", "É", "l"]) + w[at + rng.randrange(2):]
            words.append(rng.choice([w, w.upper(), w + ".", w + "1"]))
        rows.append((i, " ".join(words)))
    rows += [(None, "running grammar grammer grammer"), (5, None), (6, ""), (7, "runninG " * 50_000), (7, rows[7][1]), (8, "é" * 30_000 + " " + "é" * 30_000)]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, WORD string, n int").repartition(3)
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in variants(word_counts(df)).collect())
    assert got == expected(rows)
    assert any(r[1] for r in got) and any(r[2] not in (r[0], r[1]) or not r[1] for r in got)
    assert variants(word_counts(df.limit(0))).collect() == []
    assert variants(spark.createDataFrame([(None, 3), ("running", 1), ("running", 1)], "word string, n long")).first().n == 2


def test_paths_of_forms(spark):
    rows = [("grammar", 2000), ("grammer", 150), ("gramer", 1), ("gramerr", 12), ("gramerrs", 2), ("alphabet", 7)]
    got = {r.word: r for r in variants(spark.createDataFrame(rows, "word string, n long"), times=5).collect()}
    assert got["gramerrs"].form == "gramerr" and got["grammer"].root == "grammar"
    assert got["alphabet"].root == "alphabet" and got["alphabet"].form is None
