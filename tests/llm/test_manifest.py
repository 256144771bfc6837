"""The Merkle manifest, whitening and token counts against brute force, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from opineflow.llm import merkle, token_counts, whitening
from opineflow.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, g int, path string, leaf string, rid long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row, more=0):
    doc_id, text, lang, source, n_chars = row[:5]
    n_chars = n_chars + more if n_chars is not None else None
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def brute_tree(nodes, fanout):
    """Levels from the nodes to the one that remains."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def brute_path(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        start = i // fanout * fanout
        run = level[start : start + fanout]
        out.append((run[: i - start], run[i - start + 1 :]))
        i //= fanout
    return out


def brute_manifest(rows, fanout):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is None, r[0] or 0, brute_leaf(r)))
        trees[name] = brute_tree([brute_leaf(r) for r in groups[name]], fanout)
    over = brute_tree([trees[name][-1][0] for name in names], fanout)
    for g, name in enumerate(names):
        for i, row in enumerate(groups[name]):
            path = brute_path(trees[name], i, fanout) + brute_path(over, g, fanout)
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            folded = brute_leaf(row, int(hit))
            for left, right in path:
                folded = sha(*left, folded, *right)
            root = over[-1][0]
            yield (row[0], brute_leaf(row), trees[name][-1][0], root, sha(*(s for p in path for side in p for s in side)), folded, folded == root)


def manifest_rows():
    rng = random.Random(6)
    rows = []
    for i in range(400):
        rows.append((rng.choice([i, 7, -(2**63), 2**63 - 1, i << 40]), rng.choice(["some text", "é ß 😀", "", None, f"t{i}"]), rng.choice(["en", "en", "de", None, "", "e", "engl\0", "a name of many bytes"]), rng.choice(["web", None]), rng.choice([None, 3, i])))
    rows += [(5, "same", "en", "s", 4)] * 300 + [(None, None, None, None, None)] * 3  # a third of the rows is one row
    return [(*r, 1, 2, "x", "y", 3) for r in rows]


@pytest.mark.parametrize(("fanout", "bucket_rows", "block_leaves"), [(2, 128, 64), (2, 3, 4), (3, 16, 30)])
def test_manifest(spark, fanout, bucket_rows, block_leaves):
    rows = manifest_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = merkle.tampered_proofs(docs, fanout, bucket_rows, block_leaves).collect()
    assert Counter(map(tuple, got)) == Counter(brute_manifest(rows, fanout))
    assert 0 < sum(not r.verified for r in got) < len(got) / 2


@pytest.mark.parametrize("n", [0, 1, 3, 65])
def test_manifest_sizes(spark, n):
    rows = [(i, f"t{i}", "en", None, 1, 0, 0, "", "", 0) for i in range(n)]
    got = merkle.tampered_proofs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(map(tuple, got)) == Counter(brute_manifest(rows, 2))


def test_ranks_and_general_output(spark):
    """Ranks have no gaps, paths verify, and one group a row is a tree over groups."""
    docs = spark.range(500).select((F.col("id") * 1_000_003 % 500).alias("doc_id"), F.lit("x").alias("text"), F.concat(F.lit("group"), F.col("id")).alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(1).alias("n_chars"))
    rows = merkle.merkle_manifest(docs, bucket_rows=8).select("*", merkle.fold(F.col("leaf"), F.col("path")).alias("folded")).collect()
    assert {r.rank for r in rows} == {0} and {r["size"] for r in rows} == {1} and all(r.folded == r.root and r.leaf == r.subroot for r in rows)
    one = merkle.merkle_manifest(docs.withColumn("lang", F.lit("en")), bucket_rows=8).collect()
    assert sorted(r.rank for r in one) == list(range(500)) and all(r.rank == r.doc_id for r in one)


def test_manifest_of_a_long_text(spark):
    long = "word " * 1_000_000
    rows = [(1, long, "en", None, 1, 0, 0, "", "", 0), (2, "", "en", None, 1, 0, 0, "", "", 0)]
    got = merkle.tampered_proofs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(map(tuple, got)) == Counter(brute_manifest(rows, 2))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_manifest_sql(spark):
    con, path = duckdb.connect(), "/root/testdata/sf0.001/documents.parquet"
    con.sql(f"create view documents as select * from '{path}'")
    want = con.sql(merkle.ORACLE_SQL)
    got = merkle.tampered_proofs(spark.read.parquet(path)).select(*want.columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())


def brute_whitened(vectors, k):
    """Covariance in whole numbers, eigenvectors by numpy."""
    x = {tuple(int(np.floor(256 * float(c))) for c in v) for v in vectors}
    n, width = len(x), len(next(iter(x)))
    sums = [sum(v[d] for v in x) for d in range(width)]
    y = [[n * v[d] - sums[d] for d in range(width)] for v in x]
    m = [[sum(r[i] * r[j] for r in y) for j in range(width)] for i in range(width)]
    values, basis = np.linalg.eigh(np.array([[float(c) / n**3 for c in r] for r in m]))
    return n, sums, values[::-1][:k], basis[:, ::-1][:, :k], values.sum()


def test_whitening(spark):
    rng = random.Random(2)
    vectors = [[float(np.float32(rng.gauss(3 * d, 0.1 + 0.3 * d))) for d in range(6)] for _ in range(200)]
    vectors += [vectors[0]] * 100 + [[c + 1e-9 for c in vectors[1]]] * 2  # a third are copies; some differ, but not as whole numbers
    rows = [(i, v, "clash", 1) for i, v in enumerate(vectors)]
    bad = [(900, None, "", 1), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0], "", 1), (902, [float("nan")] * 6, "", 1), (903, [float("inf")] * 6, "", 1), (904, [1.0, 2.0], "", 1), (905, [], "", 1)]
    rows += [rows[5], (None, vectors[7], "", 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, x string, n int").repartition(5)
    got = whitening.whitened_embeddings(df).collect()
    n, sums, values, basis, trace = brute_whitened(vectors, 4)
    assert len(got) == 4 * len(rows) and {r.n for r in got} == {n}
    by = defaultdict(list)
    for r in got:
        by[r.vec_id].append(r)
    signs = {}
    for vec_id, v, *_ in rows:
        x = [int(np.floor(256 * c)) for c in v]
        y = [n * a - s for a, s in zip(x, sums, strict=True)]
        for r in by[vec_id]:
            k = r.component - 1
            z = float(np.dot(y, basis[:, k])) / (n * values[k] ** 0.5)
            sign = signs.setdefault(k, 1 if z * r.whitened > 0 else -1)
            assert r.deviation == sum(c * c for c in y) and abs(sign * z - r.whitened) < 1e-8 and abs(r.explained - values[k] / trace) < 1e-10
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def test_whitening_spans_many_magnitudes(spark):
    """One dimension of a variance 10 ** 18 times the others', beside a far mean: the later components are still right."""
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (400, 8))
    x[:, 2] *= 1e9
    x[:, 5] += 1e10
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = whitening.whitened_embeddings(df).collect()
    assert got[0].identity_error < 1e-9 and len(got) == 1600
    assert all(r.deviation is None or r.deviation > 0 for r in got) and any(r.deviation is None for r in got)


@pytest.mark.parametrize(("rows", "components"), [([], 0), ([[1.0, 2.0]], 0), ([[1.0, 2.0]] * 5, 0), ([[1.0, 2.0], [2.0, 1.0]], 1), ([[0.0, 1e300], [1.0, -1e300], [0.5, 0.0]], 1), ([[], []], 0)])
def test_whitening_of_little(spark, rows, components):
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    got = whitening.whitened_embeddings(df).collect()
    assert len(got) == components * len(rows)


def test_sliced_product_is_exact():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**60), 2**60, (5, 40_000)).astype(object) * 2**30 + 7, rng.integers(-(2**61), 2**61, (40_000, 3))
    assert (whitening.sliced_product(a, b) == a.dot(b.astype(object))).all()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_whole_tokens(library):
    """The proof agrees with the library on every string of the vocabulary."""
    path = tokenizer_path("byte_bpe_50k.json")
    proved, counter = token_counts.whole_tokens(path), token_counts.TokenCounter(path)
    decoded = [s for s in (library.decode([i]) for i in range(len(counter.vocab))) if "�" not in s]
    assert {s for s, e in zip(decoded, library.encode_batch(decoded, add_special_tokens=False), strict=True) if len(e.ids) == 1} == {s for s in decoded if s in proved}
    assert 0 < len(proved) < len(counter.vocab)


def test_token_counts(spark, library):
    rng = random.Random(8)
    pieces = ["word", " another", "\n", "  ", "don't", "'LL", "12345", "é", "日本", "😀", "\x1c", "\x85", "　", "...", " !?", "antidisestablishment", "<|endoftext|>", "<|endof", "ſ", "İ", "qzxjkv"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 400))) for _ in range(150)]
    texts += [None, "", " ", "a" * 100_000, "ab" * 50_000, "<|endoftext|>" * 3, "word " * 1_000_000, texts[0], texts[0]]
    rows = [(i if i % 9 else None, t, 1, True) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, over_limit boolean").repartition(3)
    want = [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    want = Counter((r[0], len((t or "").encode()), n, n > 512) for r, t, n in zip(rows, texts, want, strict=True))
    assert Counter(map(tuple, token_counts.token_counts(df, tokenizer_path("byte_bpe_50k.json")).collect())) == want
    assert token_counts.token_counts(df.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0
