import hashlib

import pytest

from quern.llm import components, minhash_dedup, substring_dedup
from tests.llm.data import WORDS, docs, texts


def brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
            w = WORDS.findall(low)
            s = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
            sets.setdefault(i, set()).add(s)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            for x in sets[a]:
                for y in sets[b]:
                    if a < b and x and y and 100 * len(x & y) >= percent * len(x | y):
                        ra, rb = find(a), find(b)
                        parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("k,percent", [(2, 80), (5, 80), (2, 60), (2, 50)])
def test_components(spark, k, percent):
    rows = texts()
    got = minhash_dedup.components(docs(spark), k, percent).collect()
    assert len(got) == len(rows)
    want = brute_components(rows, k, percent)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id == r.component_id)


def test_components_of_several_texts_for_one_id(spark):
    rows = [(1, "a b c d e f g h"), (1, "q r s t u v w x"), (2, "a b c d e f g h"), (3, "q r s t u v w x"), (4, "zz")]
    got = {r.doc_id: r.component_id for r in minhash_dedup.components(docs(spark, rows), 2, 80).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_large_near_copy_group_is_settled_in_blocks(spark):
    """A group in which most copies are linked to the base alone, and blocks are tiny."""
    import random

    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        own = list(base)
        for j in rng.sample(range(120), rng.randrange(2, 9)):
            own[j] = f"x{i}_{j}"
        rows.append((i + 5, " ".join(own)))
    got = {r.doc_id: r.component_id for r in minhash_dedup.components(docs(spark, rows), 2, 80, block=4).collect()}
    assert got == brute_components(rows, 2, 80)


def test_dedup_keeps_columns_and_rows_without_id(spark):
    df = docs(spark)
    out = minhash_dedup.dedup(df, 5)
    assert out.columns == df.columns
    assert out.where("doc_id is null").count() == df.where("doc_id is null").count()
    assert {r.doc_id for r in out.where("doc_id in (100, 101, 110)").collect()} == {100}


def test_empty_tables(spark):
    assert minhash_dedup.components(docs(spark, []), 2).count() == 0
    assert substring_dedup.dedup(docs(spark, [])).count() == 0


@pytest.mark.parametrize("edges,want", [([], {}), ([(5, 5)], {}), ([(9, 8), (8, 7), (7, 6), (6, 5), (3, 2), (2, 3)], {9: 5, 8: 5, 7: 5, 6: 5, 5: 5, 3: 2, 2: 2})])
def test_connected_components(spark, edges, want):
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.component for r in components.connected_components(df, "test").collect()} == want


def test_signature_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(3)
    a = rng.integers(1, 2**63, 600, dtype=np.uint64)
    pi = minhash_dedup._pi(512)
    sig = minhash_dedup.signatures([a[:500], a[100:]], 512, pi)
    assert abs((sig[0] == sig[1]).mean() - 400 / 600) < 0.08


@pytest.mark.parametrize("percent", [50, 60, 80, 95])
def test_pairs_at_the_limit_share_a_bucket(percent):
    """At least 0.999 of pairs whose similarity is exactly the limit, as the bands are planned."""
    import numpy as np

    bands, rows = minhash_dedup.plan_bands(percent)
    assert bands * rows <= minhash_dedup.COORDINATES
    rng = np.random.default_rng(percent)
    pi, missed = minhash_dedup._pi(bands * rows), 0
    for _ in range(3000):
        a = rng.integers(1, 2**63, 100, dtype=np.uint64)
        # Of 100 shingles in the union, ``percent`` are in both.
        left, right = a[: percent + (100 - percent) // 2], np.concatenate([a[:percent], a[percent + (100 - percent) // 2 : 100]])
        sig = minhash_dedup.signatures([left, right], bands * rows, pi)
        one, two = minhash_dedup.band_hashes(sig, bands, rows)
        missed += not (one == two).any()
    assert missed <= 3


def test_bands_of_other_limits():
    assert minhash_dedup.plan_bands(80) == (48, 6)
    assert minhash_dedup.plan_bands(100)[0] == 1 and minhash_dedup.plan_bands(1)[1] == 1
    with pytest.raises(ValueError):
        minhash_dedup.plan_bands(0)


def test_intermediate_tables_are_removed(spark):
    import glob

    before = set(glob.glob(spark.conf.get("spark.checkpoint.dir") + "/quern/*/minhash-*"))
    minhash_dedup.components(docs(spark), 2, 80)
    left = set(glob.glob(spark.conf.get("spark.checkpoint.dir") + "/quern/*/minhash-*")) - before
    assert len(left) == 1 and "minhash-result" in left.pop()


def brute_windows(rows, size):
    first = {}
    words = [(i, WORDS.findall(t or "")) for i, t in rows]
    for i, w in words:
        if i is not None:
            for j in range(len(w) - size + 1):
                key = tuple(w[j : j + size])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - size + 1):
            if i is not None and first[tuple(w[j : j + size])] < i:
                gone.update(range(j, j + size))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [50, 40])
def test_substring_dedup(spark, size):
    rows = texts()
    got = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup.dedup(docs(spark), size).collect()]
    assert sorted(got, key=str) == brute_windows(rows, size)


def test_difference_cover():
    differences = {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER}
    assert differences == set(range(substring_dedup.PERIOD))


def test_window_size_must_exceed_period(spark):
    with pytest.raises(ValueError):
        substring_dedup.dedup(docs(spark), 31)
