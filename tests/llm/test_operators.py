"""Each corpus operator against brute force on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import os
import random
import re
import subprocess
import sys
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as pf

from opineflow.llm import dart_minhash, line_chunks, multiset_hash, packing, secret_ledger, substring, toxicity_fm, warc
from opineflow.llm.bpe import bpe_round_trip
from opineflow.llm.exact_sort import content_sort_dedup
from opineflow.llm.packing import binary_pieces, power_of_two_pack
from opineflow.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def word(rng):
    return "".join(rng.choice("abcdefgstu") for _ in range(rng.randint(3, 8)))


def prose(rng, n):
    return " ".join(word(rng) + rng.choice(["", "", "", ".", ","]) + rng.choice(["", "", "", "\n"]) for _ in range(n))


def corpus():
    rng = random.Random(4)
    texts = [prose(rng, rng.choice([8, 60, 150])) for _ in range(40)]
    base = prose(rng, 200)
    for k in range(12):  # near copies
        w = base.split(" ")
        w[5 * k + 3] = "changed"
        texts.append(" ".join(w))
    passage = "the first line of a passage\nthat is repeated here and there\nin several of the documents\nof this small corpus so that\nit has lines to be removed\nby one operator or the other\nif all is right and well done\n" * 2
    for _ in range(5):
        texts.append(prose(rng, 40) + "\n" + passage + prose(rng, 30))
    texts += [texts[0], texts[0], " " + texts[1], None, "", None, " \n\t", "x", "aa bb", "\n", "日本語 テキスト 😀 é ß", "a " * 3000, "password = 'hunter2hunter2' token=secret=abc token: abcdef AKIA" + "A" * 16 + " " + "0af" * 9, "<|endoftext|> twice <|endoftext|>"]
    rows = [(i * 3 % 101, t, "en", "s", None) for i, t in enumerate(texts)]
    return rows + [rows[0], (None, "no id at all", None, None, None), (None, "no id at all", None, None, None)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(i):
    return (i is None, i or 0)


def test_content_sort(rows, docs, empty):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), key(i), i))
    got = content_sort_dedup(docs, partitions=5).collect()
    want = Counter((i, min(g)[2], len(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for _, _, i in g)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(hashlib.sha256(n.encode()).hexdigest() for n in groups)
    assert content_sort_dedup(empty).count() == 0


def test_content_sort_hot_group(spark):
    hot = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'same text', concat('other ', id)) as text", "1 as keep_id")
    got = content_sort_dedup(hot, partitions=16).where("group_size > 1")
    assert got.count() == 1000 and got.where("kept").collect()[0].doc_id == 0
    assert got.select("group_size", "keep_id").distinct().collect() == [(1000, 0)]


def test_packing(rows, docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = power_of_two_pack(docs, path, longest=64).collect()
    assert len({r.sequence_id for r in got}) == len(got) and {r.offset for r in got} == {0}
    parts = defaultdict(list)
    for r in got:
        assert r.length == 1 << r.bucket <= 64 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        parts[r.doc_id, r.doc_tokens, r.start].append(tuple(r.ids))
    want = defaultdict(list)
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        for start, n in binary_pieces(len(ids), 64):
            want[i, len(ids), start].append(tuple(ids[start : start + n]))
    assert {k: sorted(v) for k, v in parts.items()} == {k: sorted(v) for k, v in want.items()}
    assert power_of_two_pack(empty, path).count() == 0


def test_signs_after_letters_that_get_marks():
    words = [f"ab{c}{sign}" for c in "\u0130\u0958\u095f\ufb2a\ufb4eé\u00dfz" for sign in ".,"]
    ids = packing._WordIds(tokenizer_path("word_bpe_49k.json"))
    ids.add(set(words))
    for w in words:
        assert ids[w] == np.array(ids.tokenizer.encode(w, add_special_tokens=False).ids, np.uint32).tobytes()


def test_bpe(rows, docs, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    want = []
    for i, t, *_ in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        shas = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False))]
        want.append((i, len(ids), *shas))
    assert Counter(map(tuple, bpe_round_trip(docs, path).collect())) == Counter(want)
    assert bpe_round_trip(empty, path).count() == 0


def brute_secrets(text):
    rules = [(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6), (r"AKIA[A-Z0-9]+", 0, 20), (r"[0-9a-f]+", 0, 24)]
    found = [[(m.start(), k, m.end()) for m in re.finditer(p, text) if len(m[g]) >= n] for k, (p, g, n) in enumerate(rules)]
    listed = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(sum(found, [])))
    return (*map(len, found), hashlib.sha256(listed.encode()).hexdigest())


def test_secrets(rows, docs, empty):
    got = secret_ledger.document_secrets(docs).collect()
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == Counter((i, *brute_secrets(t or "")) for i, t, *_ in rows)
    assert secret_ledger.document_secrets(empty).count() == 0
    clean = secret_ledger.redact_secrets(docs.withColumn("spans", docs.lang))
    assert clean.count() == len(rows) and not any(any(brute_secrets(r.text or "")[:3]) for r in clean.collect())


def test_ledger_scans_only_new_pairs(spark):
    """Three versions of two paths; then one rule is changed, one added."""
    key_ = "AKIA" + "B" * 20
    text = {1: f"token = abcdef123 {key_}", 2: "nothing", 3: key_}
    versions = spark.createDataFrame([("a", 1, text[1]), ("b", 1, text[1]), ("a", 2, text[2]), ("a", 3, text[3])], "path string, version int, text string")
    assign, access, hex_ = secret_ledger.BASE_RULES
    found, ledger = secret_ledger.scan_incremental(versions.where("version < 3"), rules=[assign, access])
    assert sorted(r.rule for r in found.collect()) == ["access", "assign"] and ledger.count() == 4
    found2, new = secret_ledger.scan_incremental(versions, ledger, found, rules=[assign, access])
    assert (found2.count(), new.count()) == (3, 2)  # the third text's two pairs
    ledger, longer = ledger.unionByName(new), access._replace(least=30)
    found3, new = secret_ledger.scan_incremental(versions, ledger, found2, rules=[assign, longer, hex_])
    assert sorted((r.rule, r.rule_version) for r in new.collect()) == sorted([("access", longer.version), ("hex", hex_.version)] * 3)
    assert [r.rule for r in found3.collect()] == ["assign"]  # what the old rule found is gone
    rows = secret_ledger.findings_by_path(versions, secret_ledger.key128(pf.col("text")), secret_ledger.spans_of_blobs(found2, [assign, access])).collect()
    assert Counter((r.row.path, r.row.version, r.found and len(r.found.spans)) for r in rows) == Counter({("a", 1, 2): 1, ("b", 1, 2): 1, ("a", 2, None): 1, ("a", 3, 1): 1})


CLASHES = ["__key", "__id", "__doc", "__spans", "__blob", "__cut", "__lines", "__split", "__n", "row", "id", "key", "spans", "body", "cut", "gone", "split", "found", "blob_id", "salt", "keep", "t", "clean"]


def test_columns_of_any_name_are_left_alone(spark, rows):
    docs = spark.createDataFrame(rows[:30] + [(900, rows[0][1] + " token = abcdef123", "en", "s", None)], SCHEMA).withColumns({c: pf.lit(c) for c in CLASHES})
    model = toxicity_fm.fit([], np.zeros(0))
    for change in (line_chunks.remove_line_chunks, dart_minhash.keep_one_per_class, secret_ledger.redact_secrets, lambda d: toxicity_fm.drop_toxic(d, model._replace(bias=-1.0))):
        out = change(docs)
        got = out.collect()
        assert out.columns == docs.columns and got and all(r[c] == c for r in got for c in CLASHES)


@pytest.mark.parametrize("sizes", [(16384, 8192), (64, 16)])
def test_warc(spark, tmp_path, sizes):
    rng = random.Random(1)
    bodies = [None, "", "short", "short", "é" * 90, "é" * 90, "é" * 90, "x" * 100, "x" * 100, "x" * 99, "x" * 99, "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9, prose(rng, 3000)]
    pages = [(i * 7 % 13, f"http://h/{i} WARC/1.1", b) for i, b in enumerate(bodies)] + [(None, None, "é" * 90)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = warc.warc_round_trip(df, str(tmp_path / "w"), segment_bytes=sizes[0], chunk_bytes=sizes[1]).collect()
    want, first = [], {}
    for i, _, b in sorted(pages, key=lambda p: key(p[0])):
        raw = (b or "").encode()
        again = len(raw) >= 100 and raw in first
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[raw] if again else None))
        first.setdefault(raw, i)
    assert Counter(map(tuple, got)) == Counter(want)
    assert warc.warc_round_trip(df.limit(0), str(tmp_path / "e")).count() == 0


def test_plain_words_need_the_model_only():
    """All letters up to U+024F, in words with and without signs: the library's ids, and the whole tokenizer sees only the signs."""
    path = tokenizer_path("word_bpe_49k.json")
    words = packing._WordIds(path)
    whole, given = words.tokenizer, []

    class Seen:
        def encode_batch_fast(self, texts, **kw):
            given.extend(texts)
            return whole.encode_batch_fast(texts, **kw)

    words.tokenizer = Seen()
    letters = [chr(i) for i in range(0x250) if chr(i).isalpha() and i != 0x130]
    signs = [chr(i) for i in range(33, 127) if not chr(i).isalnum()]
    rng = random.Random(9)
    plain = [*letters, *(a + b for a in letters for b in "aZß"), *("".join(rng.choices(letters, k=rng.randint(2, 90))) for _ in range(3000))]
    ended = [f"wOrd{a}" for a in signs] + [rng.choice(plain) + "".join(rng.choices(signs, k=rng.randint(1, 4))) for _ in range(3000)]
    texts = [" ".join(rng.sample(plain + ended, 500)) for _ in range(30)] + [" ".join(plain), " ".join(ended), "", "a" + "=" * 500]
    want = [np.array(x.ids, "<u4").tobytes() for x in whole.encode_batch(texts, add_special_tokens=False)]
    assert words.encode(texts) == want and words.encode(texts) == want
    assert given and not any(c.isalpha() for x in given for c in x)
    assert max(map(len, words)) <= packing.CACHE_CHARS
    odd = ["İstanbul, İ. Σας ΣΑΣ. Å Å e\u0301a. don't. it's, a1. x²! _a_ a\u0345. 日本語。 日本. <|endoftext|>. a<|endoftext|> no\u200bgap\x1cb ſt. ŉa"]
    assert words.encode(odd) == [np.array(x.ids, "<u4").tobytes() for x in whole.encode_batch(odd, add_special_tokens=False)]


def test_toxicity(spark, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        rows.append((i, prose(rng, 30) + (" zzinsult" if bad else ""), None, None, None))
        labels.append((i, 0, int(bad)))
    docs, labels = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*labels, (None, 0, 1), (3, 0, None)], "doc_id long, quality long, toxic long")
    model = toxicity_fm.fit_toxicity(docs, labels)
    got = {r.doc_id: r for r in toxicity_fm.score_toxicity(docs, model).withColumn("held", toxicity_fm.held_out()).collect()}
    held = [i for i in got if got[i].held]
    assert held and all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held)
    assert np.mean([got[i].predicted == (i % 5 == 0) for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in toxicity_fm.score_toxicity(spark.createDataFrame(corpus(), SCHEMA), model).collect())
    assert toxicity_fm.score_toxicity(empty, toxicity_fm.fit_toxicity(empty, labels.limit(0))).count() == 0


def test_repeated_id_is_collected_once(spark, monkeypatch):
    """What the driver collects for fitting has one row an id, the least slots of its texts."""
    collected = []
    monkeypatch.setattr(type(spark.range(0)), "toPandas", lambda self, f=type(spark.range(0)).toPandas: collected.append(f(self)) or collected[-1])
    texts = [f"word{chr(97 + i % 7)} text" for i in range(200)]
    docs = spark.createDataFrame([(2, t) for t in texts] + [(3, "other text"), (4, None)], "doc_id long, text string")
    toxicity_fm.fit_toxicity(docs, spark.createDataFrame([(2, 1), (3, 0), (4, 0)], "doc_id long, toxic long"))
    held = {i for i in (2, 3, 4) if zlib.crc32(str(i).encode()) % 5 == 0}
    got = {r.doc_id: r.slots for r in collected[0].itertuples()}
    assert 2 not in held and len(collected[0]) == len(got) and set(got) == {2, 3, 4} - held
    assert bytes(got[2]) == min(toxicity_fm.slots_of(t).tobytes() for t in texts)


def test_fit_holds_its_sample_once(spark, monkeypatch):
    """The driver gets the sample as Arrow batches, and fitting makes no second copy of its slots."""
    how, key = [], "spark.sql.execution.arrow.pyspark.enabled"
    monkeypatch.setattr(type(spark.range(0)), "toPandas", lambda self, f=type(spark.range(0)).toPandas: how.append(spark.conf.get(key)) or f(self))
    before = spark.conf.get(key)
    toxicity_fm.fit_toxicity(spark.createDataFrame([(2, "a"), (3, None)], "doc_id long, text string"), spark.createDataFrame([(2, 1), (3, 0)], "doc_id long, toxic long"))
    assert how == ["true"] and spark.conf.get(key) == before
    rng = np.random.default_rng(3)
    texts = [np.unique(rng.integers(0, 1 << toxicity_fm.BITS, 2000)).astype(np.int32) for _ in range(6000)]
    labels = (rng.random(6000) < 0.1).astype(float)
    tracemalloc.start()
    model = toxicity_fm.fit(texts, labels, epochs=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * sum(t.nbytes for t in texts)  # the model's own arrays and a batch's
    assert np.array_equal(model.raw_each(texts), model.raw(np.concatenate(texts), np.cumsum([len(t) for t in texts])))
    assert model.raw_each([]).size == 0


def test_rare_families_are_learnt():
    """A rarer language's insults, each in a few rows of many, whose beginnings clean texts have too."""
    rng = random.Random(5)
    family = ["kobment" + word(rng) for _ in range(60)]
    texts, labels = [], []
    for i in range(4400):
        rare, bad = i % 20 == 0, rng.random() < 0.2
        own = (rng.sample(family[:50], 4) if bad else [rng.choice(family[50:])] if i % 40 else []) if rare else ["zzinsult"] if bad else []
        texts.append(toxicity_fm.slots_of(" ".join([prose(rng, 20), *own])))
        labels.append((float(bad), rare))
    y, rare = np.array([b for b, _ in labels]), np.array([r for _, r in labels])
    fm = toxicity_fm.fit(texts[:4000], y[:4000])
    got = fm.raw(np.concatenate(texts), np.cumsum([len(t) for t in texts])) > 0
    assert got[4000:][y[4000:] == 1].mean() > 0.9 and got[4000:][y[4000:] == 0].mean() < 0.02
    assert got[rare & (y == 1)].mean() > 0.9


def test_raw_scores_against_a_plain_loop():
    rng = np.random.default_rng(4)
    fm = toxicity_fm.FactorizationMachine(0.3, rng.normal(size=50).astype(np.float32), rng.normal(size=(50, 4)).astype(np.float32))
    texts = [np.sort(rng.choice(50, n, replace=False)) for n in (1, 5, 0, 12, 2)]
    want = []
    for t in texts:
        scale = max(len(t), 1) ** -0.25
        pairs = sum(float(fm.factors[i] @ fm.factors[j]) for i in t for j in t if i < j)
        want.append(0.3 + scale * sum(float(fm.weights[i]) for i in t) + scale**2 * pairs)
    assert np.allclose(fm.raw(np.concatenate(texts), np.cumsum([len(t) for t in texts])), want, atol=1e-5)


def test_one_half_is_the_best_cut():
    rng = np.random.default_rng(6)
    raw, y = np.round(np.concatenate([rng.normal(-3, 1, 900), rng.normal(0, 1, 100)]), 1), np.repeat([0.0, 1.0], [900, 100])
    gain = lambda c: (raw[900:] >= c).mean() - toxicity_fm.FALSE_ALARM * (raw[:900] >= c).mean()
    assert gain(toxicity_fm.best_cut(raw, y)) == max(gain(c) for c in np.arange(-7, 5, 0.05))
    assert toxicity_fm.best_cut(raw, np.zeros(1000)) == 0


def test_pairs_of_terms_are_learnt():
    """Toxic if and only if both terms are there: linear weights alone can't tell."""
    rng = np.random.default_rng(0)
    x = [np.array(sorted({*({1} if a else set()), *({2} if b else set()), *rng.integers(10, 40, 5).tolist()}), np.int32) for a, b in rng.integers(0, 2, (800, 2))]
    y = np.array([float((1 in t) == (2 in t)) for t in x])
    fm = toxicity_fm.fit(x, y, epochs=40)
    raw = fm.raw(np.concatenate(x), np.cumsum([len(t) for t in x]))
    assert ((raw > 0) == y).mean() > 0.9


def test_fingerprints_of_one_id(spark):
    """A third of the rows under one id and a third without: their ranges are cut by hash, and the order stays whole."""
    from pyspark.sql import functions as F

    plain = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"text {i}" if i % 10 else "same") for i in range(3000)]
    docs = spark.createDataFrame(plain, "doc_id long, text string").repartition(6)
    rows = multiset_hash.with_next_text(docs, parts=30).cache()
    assert rows.count() == len(plain) and rows.groupBy("part").count().agg(F.max("count")).first()[0] <= 300
    hashes = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(plain, key=lambda r: (r[0] is None, -(r[0] or 0), hashes[r[1]], r[1]))
    want = sorted(((a[0] is None, a[0] or 0, a[1], b[1]) for a, b in zip(order, order[1:] + order[:1])))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text, r.next_text) for r in rows.collect()) == want


def test_fingerprints(spark, rows, docs, empty):
    plain = [(i, t) for i, t, *_ in rows if i is not None]
    plain = list({i: (i, t) for i, t in plain}.values())
    got = {r.doc_id: r for r in multiset_hash.document_fingerprints(spark.createDataFrame(plain, "doc_id long, text string"), parts=5).collect()}
    order = sorted(plain, key=lambda p: -p[0])
    prints = {}
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt, r = t or "", nxt or "", got[i]
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert prints.setdefault(t, r.fingerprint) == r.fingerprint
    distinct = {frozenset(Counter(x for x in re.split(r"\n+|(?<=[.!?])\s+", t or "") if x).items()) for _, t in plain}
    assert len(set(prints.values())) == len(distinct)
    # order does not matter, and the sums are additive
    x = spark.createDataFrame([(1, "one\ntwo\nthree"), (2, "three\none\ntwo"), (3, "one\ntwo"), (4, "three")], "doc_id long, text string")
    sums = {r.doc_id: r for r in multiset_hash.fingerprint_sums(x, ["doc_id"]).collect()}
    assert sums[1][1:] == sums[2][1:] == tuple(a + b for a, b in zip(sums[3][1:], sums[4][1:], strict=True))
    assert multiset_hash.document_fingerprints(empty).count() == 0
    assert multiset_hash.document_fingerprints(docs).count() == len(rows)


def brute_lanes(text):
    """Sums of random signs, and exact words, over the elements of a text."""
    signs, words, n = [0] * 128, [0] * 8, 0
    for unit in (x for x in re.split(r"\n+|(?<=[.!?])\s+", text) if x):
        n += 1
        for h in range(6):
            v = xxhash.xxh64(unit.encode(), seed=xxhash.xxh64(h.to_bytes(8, "little"), seed=42).intdigest()).intdigest()
            if h < 2:
                for j in range(64):
                    signs[(j % 32) + 32 * h + 64 * (j >= 32)] += 1 if v >> j & 1 else -1
            else:
                words[2 * h - 4] += v & 0xFFFFFFFF
                words[2 * h - 3] += v >> 32
    return np.array(signs, float), [w % 2**32 for w in words], n


def test_likeness_against_brute_force(spark):
    rng = random.Random(8)
    texts = {i: ". ".join(prose(rng, rng.randint(3, 9)).replace(".", "") for _ in range(rng.choice([0, 1, 5, 20]))) for i in range(14)}
    texts[6] = texts[5] + ". one more"
    got = {r.doc_id: r for r in multiset_hash.document_fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), parts=3).collect()}
    like = lambda a, b: 1.0 if (a == b).all() else max(0.0, min(1.0, a @ b / (a @ a * (b @ b)) ** 0.5)) if (a @ a) * (b @ b) else 0.0
    for i, t in texts.items():
        nxt = texts[i - 1 if i else 13]
        (own, words, n), (edited, *_), (after, *_) = (brute_lanes(x) for x in (t, t[: len(t) - len(t) // 2] + nxt[: len(t) // 2], nxt))
        assert abs(got[i].near_edited - like(own, edited)) < 1e-9 and abs(got[i].near_next - like(own, after)) < 1e-9
        assert got[i].fingerprint.startswith("".join(f"{w:08x}" for w in [n, *words]))


def test_elements_are_inserted_and_deleted(spark):
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    sums = multiset_hash.fingerprint_sums(frame([(1, "one\ntwo\ntwo"), (2, "three")]), ["doc_id"])
    new = multiset_hash.updated_sums(sums, ["doc_id"], inserted=frame([(1, "four"), (1, "five\nsix"), (3, "seven")]), deleted=frame([(1, "two"), (2, "three")]))
    want = multiset_hash.fingerprint_sums(frame([(1, "six\ntwo\none\nfour\nfive"), (2, ""), (3, "seven")]), ["doc_id"])
    text = lambda df: {r.doc_id: r.f for r in df.select("doc_id", multiset_hash.fingerprint_text().alias("f")).collect()}
    assert text(new) == text(want)


def shingle_counts(t):
    w = (t or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute_classes(texts, similarity=0.8):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    bags = [shingle_counts(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            union = (bags[i] | bags[j]).total()
            if (texts[i] or "") == (texts[j] or "") or (union and (bags[i] & bags[j]).total() >= similarity * union):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(texts))]


def test_near_duplicates(rows, docs, empty):
    roots = brute_classes([t for _, t, *_ in rows])
    groups = defaultdict(list)
    for (i, *_), r in zip(rows, roots, strict=True):
        groups[r].append(i)
    want = Counter((i, min(g, key=key), len(g)) for g in groups.values() for i in g)
    got = dart_minhash.near_duplicate_classes(docs).collect()
    assert Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    kept = dart_minhash.keep_one_per_class(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert dart_minhash.near_duplicate_classes(empty).count() == 0


def test_large_buckets_lose_no_link(spark):
    """Many variants of one text, of which most are like a few others only."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)]
    for n in range(60):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(1, 9)), replace=False):
            words[at] = f"x{n}y{at}" if at % 2 else f"z{at}"
        texts.append(" ".join(words))
    roots = brute_classes(texts)
    want = [min(i for i, r in enumerate(roots) if r == own) for own in roots]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicate_classes(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want

    sets = spark.createDataFrame([(str(i).encode(), s.tobytes()) for i, s in enumerate(dart_minhash.occurrence_sets(texts))], "id binary, items binary")
    pairs = dart_minhash.prefix_pairs(sets.withColumn("root", sets.id))
    found = {frozenset((int(r.a), int(r.b))) for r in dart_minhash.verified_links(pairs, sets).collect()}
    bags = [shingle_counts(t) for t in texts]
    alike = {frozenset((i, j)) for i in range(len(texts)) for j in range(i) if (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total()}
    assert found == alike and len(alike) < 61 * 60 / 2


def join_rows(spark, since):
    """The most rows that a join of the executions from number ``since`` on has made."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    runs = store.executionsList(since, 1_000_000)
    for run in (runs.apply(i).executionId() for i in range(runs.size())):
        nodes, values = store.planGraph(run).allNodes(), store.executionMetrics(run)
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size()) if "Join" in node.name()):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


@pytest.mark.parametrize("often", [1 << 19, 16, 1])
def test_prefixes_are_found_before_any_join(spark, monkeypatch, often):
    """A large component of near copies beside texts that are like some of them: only prefixes are joined, no link is lost."""
    monkeypatch.setattr(dart_minhash, "OFTEN", often, raising=False)
    rng = np.random.default_rng(17)
    texts, roots = [], []
    for n in range(90):
        words = [f"w{i}" for i in range(120)]
        for at in rng.choice(120, 2 if n < 60 else int(rng.integers(2, 9)), replace=False):
            words[at] = f"x{n}y{at}"
        texts.append(" ".join(words))
        roots.append(b"one" if n < 60 else str(n).encode())
    sets = dart_minhash.occurrence_sets(texts)
    df = spark.createDataFrame([(str(i).encode(), s.tobytes(), r) for i, (s, r) in enumerate(zip(sets, roots, strict=True))], "id binary, items binary, root binary")
    since = spark._jsparkSession.sharedState().statusStore().executionsList().size()
    pairs = dart_minhash.materialize(dart_minhash.prefix_pairs(df), "found-pairs")
    assert 0 < join_rows(spark, since) <= sum(len(s) - int(np.ceil(0.8 * len(s))) + 1 for s in sets)
    found = {frozenset((int(r.a), int(r.b))) for r in dart_minhash.verified_links(pairs, df).collect()}
    bags = [shingle_counts(t) for t in texts]
    alike = {frozenset((i, j)) for i in range(90) for j in range(i) if roots[i] != roots[j] and (bags[i] & bags[j]).total() >= 0.8 * (bags[i] | bags[j]).total()}
    assert found == alike and alike


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(3)
    h = rng.integers(1, 2**63, 400).astype(np.uint64)
    a, b = rng.integers(1, 9, 400), rng.integers(1, 9, 400)
    hashes, of, w = np.concatenate([h, h]), np.repeat([0, 1], 400), np.concatenate([a, b])
    s = dart_minhash.signatures(hashes, of, w, 2, 2000)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - true) < 0.04


def brute_chunks(rows, passages=True):
    """The texts without repeated chunks and, by a look at all runs of lines, repeated passages."""
    docs = list({(i, t or "") for i, t, *_ in rows})
    place, text_key = {}, lambda t: hashlib.sha256(t.encode()).digest()[:16]
    for i, t in docs:
        lines = t.split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        start = 0
        for k in range(len(lines)):
            roll = ((h[k - 1] if k else 0) * 1_000_003 + h[k]) % 2_147_483_647
            if k == len(lines) - 1 or roll % line_chunks.EVERY == 0:
                place.setdefault((i, t), []).append((start, k + 1))
                start = k + 1
    first = {}
    occurrences = [((*key(i), text_key(t), n), (i, t), s) for (i, t), spans in place.items() for n, s in enumerate(spans) if s[1] - s[0] > 1]
    body = lambda d, s: "\n".join(d[1].split("\n")[s[0] : s[1]])
    for k, d, s in occurrences:
        first[body(d, s)] = min(first.get(body(d, s), k), k)
    gone = defaultdict(set)
    for k, d, s in occurrences:
        if first[body(d, s)] != k:
            gone[d] |= set(range(*s))
    if passages:
        runs = []
        for i, t in docs:
            lines = t.split("\n")
            words = [len(x.encode().split()) for x in lines]
            runs += [((*key(i), text_key(t), a), (i, t), (a, z)) for a in range(len(lines)) for z in range(a + 1, len(lines) + 1) if words[a] and words[z - 1] and sum(words[a:z]) > 50]
        first = {}
        for k, d, s in runs:
            first[body(d, s)] = min(first.get(body(d, s), k), k)
        for k, d, s in runs:
            if first[body(d, s)] != k:
                gone[d] |= set(range(*s))
    return {d: "\n".join(x for n, x in enumerate(d[1].split("\n")) if n not in gone[d]) for d in docs}


def test_line_chunks(rows, docs, empty):
    want = brute_chunks(rows)
    got = line_chunks.line_chunk_digest(docs).collect()
    assert Counter((r.doc_id, r.clean_sha256) for r in got) == Counter((i, hashlib.sha256(want[i, t or ""].encode()).hexdigest()) for i, t, *_ in rows)
    assert sum(r.removed_chunks for r in got) > 0
    clean = line_chunks.remove_line_chunks(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    alone = brute_chunks(rows, passages=False)
    assert Counter((r.doc_id, r.text or "") for r in clean.collect()) == Counter((i, alone[i, t or ""]) for i, t, *_ in rows)
    assert line_chunks.line_chunk_digest(empty).count() == 0


def test_recall_of_the_query(spark):
    """Passages of 1-8 lines and some 60 words, in three texts each between unlike lines: all copies but the first go, and nothing else."""
    rng = random.Random(33)
    line = lambda n: " ".join(word(rng) for _ in range(n))
    passages = [[line(60 // n + 1) for _ in range(n)] for n in (1, 2, 3, 4, 6, 8) for _ in range(8)]
    rows = [(1000 * k + i, "\n".join([line(9), *p, line(9), line(7)]), "en", "s", None) for k in range(3) for i, p in enumerate(passages)]
    got = {r.doc_id: r.removed_lines for r in line_chunks.line_chunk_digest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert got == {1000 * k + i: len(p) if k else 0 for k in range(3) for i, p in enumerate(passages)}


def test_repeated_passages_go_in_full(spark):
    """Recall of the pipeline's line dedup on passages of 1-6 lines: 1, and no other line goes."""
    import corpus_pipeline

    rng = random.Random(21)
    lines = lambda n, words: [" ".join(word(rng) for _ in range(words)) for _ in range(n)]
    passages = [lines(n, 51 // n + 1) for n in range(1, 7) for _ in range(10)] + [[*lines(1, 60), *lines(1, 3)], [*lines(1, 3), *lines(1, 60)]]
    short = lines(1, 50)  # no passage
    texts = []
    for k in range(3):
        for p in passages:
            around = [lines(rng.randint(0, 3), 9) for _ in range(2)]
            texts.append((k, p, around, "\n".join([*around[0], *p, *around[1]])))
    rows = [(i, t, "en", "s", None) for i, (*_, t) in enumerate(texts)] + [(9000, short[0], "en", "s", None), (9001, "\n".join(lines(1, 5) + short[:1]), "en", "s", None)]
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), None).collect()}
    for i, (k, _, around, t) in enumerate(texts):
        assert got[i] == (t if k == 0 else "\n".join([*around[0], *around[1]]))
    assert got[9000] == rows[-2][1] and got[9001] == rows[-1][1]


def paragraphs_of(text):
    """(start, end, body) of each line with words, from its first word to its last."""
    at = 0
    for line in (text or "").split("\n"):
        if line.strip():
            start = at + len(line) - len(line.lstrip())
            yield start, start + len(line.strip()), line.strip()
        at += len(line) + 1


def alike(a, b, similarity=0.8):
    if a == b:
        return True
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return bool(x and y) and len(x & y) >= similarity * len(x | y)


def brute_paragraphs(rows):
    """Classes of all paragraphs by comparing every pair."""
    units = [(*key(i), a, z, body) for i, t in rows for a, z, body in paragraphs_of(t)]
    group = list(range(len(units)))
    for i in range(len(units)):
        for j in range(i):
            if group[i] != group[j] and alike(units[i][-1], units[j][-1]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    classes = defaultdict(set)
    for (no_id, i, a, z, _), g in zip(units, group, strict=True):
        classes[g].add((None if no_id else i, a, z))
    return [c for c in classes.values() if len(c) > 1]


def test_paragraphs_against_all_pairs(spark, empty):
    """End to end: equal, near and short paragraphs between different neighbours; recall 0.99, no false link."""
    rng = random.Random(9)
    line = lambda n: " ".join(word(rng) for _ in range(n))
    texts, bases = [], [line(n) for n in (30, 40, 50, 60, 80, 100) for _ in range(4)]
    for k in range(150):
        own = bases[k % len(bases)].split(" ")
        for at in rng.sample(range(len(own)), rng.choice([0, 1, 1, 2])):
            own[at] = word(rng)
        texts.append("\n".join([line(12), " ".join(own), "", line(20)]))
    texts += [f"{line(9)}\nprivacy policy\n{line(15)}" for _ in range(20)]  # a short paragraph
    texts += [f"{line(30)}\n\nthis one has just under the five\n\n{line(3)}"[: rng.choice([10**6, 40])] for _ in range(6)]
    texts += ["\u65e5\u672c\u8a9e" * 1000, "x\n" + "\u65e5\u672c\u8a9e" * 1000, "y" * 5_000_000, None, "", " \n\t\n", "x"]
    rows = list(enumerate(texts)) + [(None, texts[1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"__id": pf.lit(1), "n": pf.lit(2), "key": pf.lit(3)}).repartition(3)
    got = defaultdict(set)
    keeps = defaultdict(set)
    for r in substring.repeated_paragraphs(df).where("paragraph").collect():
        got[r.keep_doc_id, r.keep_start].add((r.doc_id, r.start, r.end))
        keeps[r.keep_doc_id, r.keep_start].add(None if r.removed else (r.doc_id, r.start))
    for at, members in got.items():
        assert at == min(members, key=lambda m: (*key(m[0]), m[1]))[:2] and keeps[at] - {None} == {at}
    want = brute_paragraphs(rows)
    of = {m: n for n, c in enumerate(want) for m in c}
    assert all(len({of[m] for m in c}) == 1 for c in got.values())  # nothing is linked that isn't alike
    assert {m for c in want for m in c} - {m for c in got.values() for m in c} == set()
    pairs = lambda cs: sum(len(c) * (len(c) - 1) // 2 for c in cs)
    assert pairs(got.values()) >= 0.99 * pairs(want)
    assert max(map(len, got.values())) >= 20
    assert substring.repeated_paragraphs(empty).count() == 0


def test_near_paragraph_recall():
    """Of paragraph pairs whose Jaccard is just 0.8 or more nearly all share a band."""
    rng, near, met = random.Random(3), 0, 0
    for _ in range(1500):
        a = [word(rng) for _ in range(rng.randint(40, 120))]
        b = list(a)
        for at in rng.sample(range(len(a)), rng.choice([1, 1, 2])):
            b[at] = word(rng) + "x"
        if alike(" ".join(a), " ".join(b)):
            schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("text", pa.string())])
            batch = pa.record_batch([pa.array([1, 2]), pa.array([1, 2]), pa.array([" ".join(a), " ".join(b)])], schema=schema)
            keys = [set(r["keys"]) for x in substring._units(iter([batch])) for r in x.to_pylist() if r["paragraph"]]
            near, met = near + 1, met + bool(keys[0] & keys[1])
    assert near > 500 and met >= 0.98 * near


def test_passages_within_paragraphs(spark):
    """Passages of 51 words and more, in the middle of long paragraphs: at least a piece of nearly all is found, and nothing else."""
    rng = random.Random(10)
    line = lambda n: " ".join(word(rng) for _ in range(n))
    passages = [line(rng.randint(51, 120)) for _ in range(60)]
    texts = [f"{line(rng.randint(5, 90))} {p} {line(rng.randint(5, 90))}" for p in passages for _ in range(3)] + [line(200) for _ in range(30)]
    rows = substring.repeated_paragraphs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    covered = defaultdict(int)
    for r in rows:
        p = passages[r.doc_id // 3]
        at = texts[r.doc_id].index(p)
        assert not r.paragraph and at <= r.start < r.end <= at + len(p)
        assert texts[r.keep_doc_id][r.keep_start :].startswith(texts[r.doc_id][r.start : r.end]) and r.removed == (r.doc_id != r.keep_doc_id)
        covered[r.doc_id] += r.end - r.start
    assert len(covered) >= 0.97 * 180
    assert sum(covered.values()) > 0.6 * sum(len(p) for p in passages) * 3


def test_repeated_rows_count(spark):
    df = spark.createDataFrame([(1, "one same line\nother"), (1, "one same line\nother"), (2, "one same line")], "doc_id long, text string")
    got = substring.repeated_paragraphs(df).collect()
    assert Counter((r.doc_id, r.start, r.removed) for r in got) == Counter({(1, 0, False): 1, (1, 0, True): 1, (1, 14, False): 1, (1, 14, True): 1, (2, 0, True): 1})


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline(spark):
    import corpus_pipeline

    root = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{root}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, root)
        assert after.columns == docs.columns
        if name in ("line_dedup", "secret_scan"):
            assert after.count() == before.count()
        before = spark.createDataFrame(after.collect(), docs.schema)
    texts = [r.text for r in before.collect()]
    assert not any(any(brute_secrets(t)[:3]) for t in texts)
    packed = corpus_pipeline.STAGES[-1][1](spark, before, root)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in before.collect()}


def test_workers_keep_one_operators_caches(spark):
    """Whichever operator's batch comes next in a Python worker, the caches of those before it are gone."""
    path = tokenizer_path("word_bpe_49k.json")
    batch = pa.record_batch([pa.array([b"a", b"b"]), pa.array(["one two three four five six", "seven"])], names=["id", "text"])
    lines = pa.record_batch([pa.array([1]), pa.array([b"k"]), pa.array([b"one two"])], names=["doc_id", "text_key", "text"])
    for stage in (lambda: line_chunks._passages(iter([lines])), lambda: dart_minhash._keys(iter([batch])), lambda: dart_minhash._sets(iter([batch]))):
        packing.encoder(path).encode(["some words"])
        toxicity_fm.slots_of("some words")
        list(stage())
        assert not packing._ENCODERS and not toxicity_fm._TERMS
    # a worker of Spark's: one task at a time, so that the stages share it
    docs = spark.createDataFrame([(i, f"some words of row {i}", i % 2 == 0) for i in range(40)], "doc_id long, text string, toxic boolean").coalesce(1)
    assert power_of_two_pack(docs, path).count() and toxicity_fm.score_toxicity(docs, toxicity_fm.fit([], np.zeros(0))).agg({"score": "sum"}).first()

    def kept(batches):
        list(batches)
        yield pa.record_batch([pa.array([os.getpid()]), pa.array([len(packing._ENCODERS)]), pa.array([len(toxicity_fm._TERMS)])], names=["pid", "encoders", "terms"])

    got = spark.range(1000).repartition(16).mapInArrow(kept, "pid long, encoders long, terms long").collect()
    assert not any(r.encoders and r.terms for r in got)


def test_encoder_starts_no_threads():
    """Tasks run side by side, so an encoder has no threads of its own, each of which would hold memory."""
    code = f"""import os
from opineflow.llm.packing import encoder
words = encoder({tokenizer_path("word_bpe_49k.json")!r})
before = len(os.listdir("/proc/self/task"))
words.encode([" ".join(f"wört{{i}}er x{{i}}y zw{{i}}, Plain" for i in range(3000))])
assert len(os.listdir("/proc/self/task")) == before, before
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(packing.__file__).parents[2])


def test_many_secrets_in_one_text(spark):
    """Spans and redaction of thousands of hits in one text, overlapping ones too, by plain loops."""
    rng = random.Random(12)
    text = "".join(rng.choice(["é plain words ", "token=abcdef123456 ", "token=" + "0af" * 9 + " ", "AKIA" + "B" * 16 + " ", "0af" * 8 + "\n", "password: short "]) for _ in range(3000))
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in secret_ledger.document_secrets(df, secret_ledger.BASE_RULES).collect()}
    found = []
    for rank, rule in enumerate(secret_ledger.BASE_RULES):
        found += [(m.start(), rank, m.end(), rule.kind) for m in re.finditer(rule.pattern.replace("(?i:", "(?ai:"), text) if len(m[rule.group]) >= rule.least]
    assert got[1].spans == ",".join(f"{k}:{a}:{z}" for a, _, z, k in sorted(found)) and len(found) > 1500
    at, out = 0, ""
    for a, _, z, k in sorted(found):
        if a >= at:
            out += text[at:a] + f"[{k}]"
        at = max(at, z)
    clean = {r.doc_id: r.text for r in secret_ledger.redact_secrets(df, rules=secret_ledger.BASE_RULES).collect()}
    assert clean == {1: out + text[at:], 2: None, 3: ""}


def test_long_words_leave_no_trace(spark):
    """Words over the cache's length are encoded right and are not kept."""
    encoder = packing._WordIds(tokenizer_path("word_bpe_49k.json"))
    long = ["x" * 100, "y" * 65 + ".", "z" * 5000]
    first = encoder.encode([" ".join([*long, "short", *long])])
    assert not any(len(w) > packing.CACHE_CHARS for w in encoder) and "short" in encoder
    assert encoder.encode([" ".join([*long, "short", *long])]) == first
    assert np.frombuffer(first[0], np.uint32).tolist() == encoder.tokenizer.encode(" ".join([*long, "short", *long]), add_special_tokens=False).ids
