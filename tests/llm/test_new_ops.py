"""Vector codes, collocations and the suffix family against brute force and the SQL of their contracts."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from quern.llm import collocations, queries, suffix_family, vector_codes
from tests.llm.data import docs, texts

VECTORS = "vec_id long, embedding array<double>, label int, code string, n long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", 1) for i, v, label in rows], VECTORS)


def brute_codes(rows, parts, entries, rounds):
    kept = sorted(((i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[int(np.floor(4096 * c)) for c in v] for _, v, _ in kept], dtype=object)
    wide = x.shape[1] // parts
    codes, errors, digits = [[] for _ in kept], [0] * len(kept), []
    for p in range(parts):
        y = x[:, p * wide : (p + 1) * wide]
        book = [list(r) for r in y[:entries]]

        def near(v, book):
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in book]
            return d.index(min(d)), min(d)

        for _ in range(rounds):
            own = [near(v, book)[0] for v in y]
            for e in range(len(book)):
                mine = [v for v, o in zip(y, own, strict=True) if o == e]
                if mine:
                    book[e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        for j, v in enumerate(y):
            e, d = near(v, book)
            codes[j].append(f"{e:02x}")
            errors[j] += d
        digits += [str(c) for b in book for c in b]
    total = Counter()
    for (_, _, label), e in zip(kept, errors, strict=True):
        total[label] += e
    h = hashlib.sha256(",".join(digits).encode()).hexdigest()
    return sorted(((i, "".join(c), e, total[label], h) for (i, _, label), c, e in zip(kept, codes, errors, strict=True)), key=str)


def codes_of(out):
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("count,parts,entries,rounds,leaf", [(300, 4, 16, 6, 4), (300, 4, 5, 2, 32), (9, 2, 16, 3, 2), (120, 1, 16, 6, 1)])
def test_codes(spark, monkeypatch, count, parts, entries, rounds, leaf):
    monkeypatch.setattr(vector_codes, "LEAF", leaf)
    rng = np.random.default_rng(count)
    rows = [(i, [float(c) for c in rng.choice([-0.5, 0.25, 1.0], 8) + rng.normal(0, 0.01, 8)], int(rng.integers(3)) if i % 5 else None) for i in range(count)]
    rows += [(count + i, [0.25] * 8, 1) for i in range(60)] + [(0, rows[0][1], 2), (None, rows[1][1], None)]
    bad = [(900, None, 1), (901, [None] + [0.0] * 7, 1), (902, [float("nan")] * 8, 1), (903, [float("inf")] + [0.0] * 7, 1)]
    random.Random(3).shuffle(rows)
    assert codes_of(vector_codes.compress(vectors(spark, rows + bad), parts, entries, rounds)) == brute_codes(rows, parts, entries, rounds)


def test_codes_of_equal_vectors_and_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "CHUNK", 1)
    rows = [(i, [0.5, -0.25] if i % 3 else [0.5, 1.0], i % 2) for i in range(150)]
    assert codes_of(vector_codes.compress(vectors(spark, rows), 2, 16, 6)) == brute_codes(rows, 2, 16, 6)


def test_codes_of_odd_vectors(spark):
    rows = [(1, [1.0, 2.0], 5), (2, [1.5, 2.0], 5), (3, [1.0, 2.0, 3.0], 5), (4, [], 6), (5, [1e30, 0.0], 5)]
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in vector_codes.compress(vectors(spark, rows), 2, 16, 1).collect()}
    assert got == {1: ("0000", 0, 0), 2: ("0100", 0, 0), 3: (None, None, 0), 4: (None, None, None), 5: (None, None, 0)}
    assert vector_codes.compress(vectors(spark, [])).count() == 0
    assert [tuple(r)[:4] for r in vector_codes.compress(vectors(spark, rows[3:4])).collect()] == [(4, None, None, None)]


def test_balls_are_owned_whole():
    """Far fewer points than all are compared with entries one by one, and sums of balls equal sums of points."""
    rng = np.random.default_rng(5)
    points = (rng.integers(0, 12, (4000, 1)) * 1000 + rng.integers(0, 40, (4000, 4))).astype(np.int64)
    tree = vector_codes.Tree.load(vector_codes.Tree.build(points).dump())
    book = np.array([[i * 1000] * 4 for i in range(12)])
    nearest, sums, counts = tree.walk(book)
    want = ((tree.points[:, None] - book) ** 2).sum(axis=2).argmin(axis=1)
    assert (nearest == want).all() and counts.sum() == 4000
    assert all((sums[e] == tree.points[want == e].sum(axis=0)).all() for e in range(12))
    assert (points[tree.order] == tree.points).all()
    inside = [((tree.points[a:b] - c) ** 2).sum(axis=1).max() <= (r + 1e-6) ** 2 for a, b, c, r in zip(tree.start, tree.end, tree.centre, tree.radius, strict=True)]
    assert all(inside)


def sql_rows(sql, table, frame):
    db = duckdb.connect()
    db.register(table, frame)
    return sorted(map(tuple, db.execute(sql).fetchall()), key=str)


ODD = [(1, None, "en"), (2, "", "en"), (3, "Of the of the OF THE; of the\nof the\tof the", None), (4, "of the, of the. of the", "und"), (5, "é ü é ü é ü é ü é ü", "de"), (5, "é ü é ü é ü é ü é ü", "de"), (None, "a\x0bb\x0ca b:a b", ""), (6, " \t ", "fr")]


def phrases_of(spark, rows, **how):
    table = spark.createDataFrame([(i, t, lang, 1, 2, "w") for i, t, lang in rows], "doc_id long, text string, lang string, n long, a long, w1 string")
    got = sorted((tuple(r) for r in collocations.collocations(table, **how).collect()), key=str)
    how.pop("bits", None)
    return got, sql_rows(collocations.oracle(**how), "documents", table.select("text", "lang").toPandas())


@pytest.mark.parametrize("how", [{"minimum": 2}, {"minimum": 3, "longest": 2}, {"minimum": 4, "longest": 3, "top": 7}, {"minimum": 2, "bits": 16, "top": 50}])
def test_collocations(spark, how):
    rows = [(i, t, ["en", "de", None][k % 3]) for k, (i, t) in enumerate(texts())]
    got, want = phrases_of(spark, [*ODD, *rows], **how)
    assert got == want and want


def test_collocations_in_small_slices(spark, monkeypatch):
    """A task's texts in slices of a few bytes: pieces and windows go over slices."""
    monkeypatch.setattr(collocations.W, "_SLICE", 16)
    blob = b"one two. three four five ,six\n seven eight nine ten eleven twelve thirteen;  fourteen fifteen " * 3
    parts = list(collocations.tokens(blob, 0))
    assert len(parts) > 5
    words = [p[a:b] for p, s, e, _, _ in parts for a, b in zip(s, e, strict=True)]
    follows = np.concatenate([f for *_, f in parts]).tolist()
    want = [(w, k > 0) for piece in __import__("re").split(rb"[.,;:!?\x0a-\x0d]", blob) for k, w in enumerate(piece.split())]
    assert list(zip(words, follows, strict=True)) == want


def test_collocations_when_hashes_clash(spark, monkeypatch):
    """With two spellings for one hash under the first salt, the next one is taken."""
    real, first = collocations.tokens, set()

    def tokens(blob, salt):
        first.add(salt)
        for part, a, b, h, f in real(blob, salt):
            yield part, a, b, (np.ones_like(h) if salt == 0 else h), f

    counted = [r for b in [__import__("pyarrow").RecordBatch.from_pydict({"lang": ["en"], "text": ["x y x y"]})] for r in _rows(monkeypatch, tokens, b)]
    assert {(w, h) for _, w, h, _ in counted} == {("x", 1), ("y", 1)}


def _rows(monkeypatch, tokens, batch):
    monkeypatch.setattr(collocations, "tokens", tokens)
    return [tuple(r.values()) for out in collocations._count_words(0)(iter([batch])) for r in out.to_pylist()]


def test_no_phrases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert collocations.collocations(empty).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, "a b c", "en")], "doc_id long, text string, lang string")).count() == 0
    with pytest.raises(ValueError):
        collocations.collocations(empty, longest=1)


def brute_strings(rows, size):
    every = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[j : j + size] for _, b in every for j in range(len(b) - size + 1))
    out = []
    for i, b in every:
        gone = np.zeros(len(b) + 1, bool)
        for j in range(len(b) - size + 1):
            if seen[b[j : j + size]] > 1:
                gone[j : j + size] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def stripped(out):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in out.collect()), key=str)


def shared_texts():
    """Passages around the limit in length, with different surroundings, in one text and in many; runs of one and two bytes."""
    rng = random.Random(6)
    noise = lambda n: "".join(rng.choice("abcdefghé \n") for _ in range(n))
    passages = [noise(n) for n in (38, 39, 40, 41, 45, 60, 79, 120)]
    rows = [(i, "".join(noise(rng.randrange(0, 50)) + rng.choice(passages) for _ in range(rng.randrange(1, 6))) + noise(rng.randrange(30))) for i in range(40)]
    rows += [(90, "x" * 300), (91, "ab" * 90 + noise(50)), (92, noise(60) + "x" * 45 + noise(60)), (93, passages[5] + passages[5]), (None, rows[3][1]), (3, rows[3][1])]
    return rows + [(94, None), (95, ""), (96, "é" * 20), (97, "é" * 19), (98, noise(39))]


@pytest.mark.parametrize("batches,group", [(1, 4096), (4, 2)])
def test_suffix_family(spark, batches, group):
    rows = shared_texts()
    assert stripped(suffix_family.dedup(docs(spark, rows), 40, batches, group)) == brute_strings(rows, 40)


def test_suffix_family_with_the_usual_size(spark):
    rows = texts()
    assert stripped(suffix_family.dedup(docs(spark, rows))) == brute_strings(rows, 200)
    assert suffix_family.dedup(docs(spark, [])).count() == 0


def test_suffixes_of_a_text_in_slices(spark, monkeypatch):
    """A long text's slices give the suffixes that it gives as a whole, each once."""
    rows = [(1, shared_texts()[0][1] * 3 + "x" * 200 + " ".join(t or "" for _, t in shared_texts()))]
    table = suffix_family.identified(docs(spark, rows))
    batch = __import__("pyarrow").RecordBatch.from_pylist([r.asDict() for r in table.select("d1", "d2", "text").collect()])
    mapper = []

    class Catch:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            mapper.append(run)

    suffix_family.suffixes(Catch(), 40)
    whole = [r for b in mapper[0](iter([batch])) for r in b.to_pylist()]
    monkeypatch.setattr(suffix_family, "_SLICE", 100)
    assert [r for b in mapper[0](iter([batch])) for r in b.to_pylist()] == whole


def test_levels_merge_geometrically(spark):
    family = suffix_family.SuffixFamily(spark, 40)
    table = suffix_family.identified(docs(spark, shared_texts()))
    sizes = []
    for i in range(4):
        family.add(table.where(f"pmod(d1, 4) = {i}").select("d1", "d2", "text"))
        sizes.append([n for n, _ in family.levels])
    assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1]]
    family.merge()
    assert [n for n, _ in family.levels] == [4]
    entries = sum(level.agg({"n": "sum"}).first()[0] for _, level in family.levels)
    assert entries == suffix_family.suffixes(table.where("octet_length(text) >= 40"), 40).count()


def test_one_passage_with_many_surroundings_is_split(spark):
    """A group far above its bound comes down to small ones, by halves of the offsets."""
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefgh") for _ in range(45))
    rows = [(i, "".join(rng.choice("klmnop") for _ in range(30)) + passage[i % 4 :] + "".join(rng.choice("klmnop") for _ in range(30))) for i in range(60)]
    assert stripped(suffix_family.dedup(docs(spark, rows), 40, 2, 5)) == brute_strings(rows, 40)


@pytest.mark.parametrize("name,table", [("op11_vector_codes", "embeddings"), ("op12_collocations", "documents"), ("op13_suffix_dedup", "documents")])
def test_queries_agree_with_sql(spark, sf_dir, name, table):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = db.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want.fetchall(), key=str)
