"""The ten operators against brute force, round trips and edge cases."""

import collections
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanbook.llm import (ann, exact_dedup, license_scan, line_dedup, mixing, ngram_join, packing, token_counts,
                          token_output, toxicity)
from loanbook.llm.encoding import vocabulary_path
from loanbook.llm.prefix_tree import PrefixTree
from loanbook.llm.tables import scratch_path

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), T.StructField("node", T.StringType())])
WORDS = [f"w{k}" for k in range(400)]


def _text(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def rows():
    """Nulls, empty and long texts, ties, repeated rows, near copies, odd characters."""
    rng = np.random.default_rng(3)
    base = _text(rng, 120)
    near = base.replace(" ", "  ", 3).split(" ")
    texts = [None, "", "  \n\t ", "one", "One two three", base, base.upper(), " ".join(near[:-2] + ["x", "y"]),
             base + "\n" + _text(rng, 40) + "\n" + base, _text(rng, 30_000), "日本 語 é ß 👍 <|endoftext|> don't  we'll",
             "Licensed under the Apache License, Version 2.0 and CC BY-NC 4.0\nmail a.b@c.de from 10.0.0.1 no 1234567890123"]
    texts += [_text(rng, int(n)) for n in rng.integers(1, 200, 30)]
    out = [(k, t, "en", ["a", "b", None][k % 3], 1, "clash") for k, t in enumerate(texts)]
    return out + [out[5], (None, base, None, None, None, None), (90, base, "en", "a", 1, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def _sets(rows):
    out = []
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append((d, {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()))
    return out


def _similar(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b)


def test_prefix_tree_finds_what_brute_force_finds():
    r = np.random.default_rng(1)
    for turn in range(60):
        base = np.unique(r.integers(0, 400, r.integers(1, 200)).astype(np.uint64))
        sets = [base]
        for _ in range(int(r.integers(1, 20))):
            x = np.unique(np.concatenate([base[r.random(len(base)) > r.random() * .3], r.integers(0, 400, 3).astype(np.uint64)]))
            sets.append(x)
        sets += [sets[1].copy(), sets[1][:max(1, len(sets[1]) - 1)]]
        tree = PrefixTree(sets)
        for p in sets[:5]:
            want = [i for i, x in enumerate(sets) if 100 * len(np.intersect1d(x, p)) >= 80 * len(np.union1d(x, p))]
            assert sorted(tree.search(p, 80)) == want, turn


def test_op1(docs, rows, empty):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in ngram_join.ngram_components(docs).collect()}
    sets = _sets(rows)
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (a, s) in enumerate(sets):
        for j in range(i):
            if sets[j][0] == a or _similar(s, sets[j][1]):
                parent[find(i)] = find(j)
    for i, (d, s) in enumerate(sets):
        ids = [sets[k][0] for k in range(len(sets)) if find(k) == find(i) and sets[k][0] is not None]
        assert got[(d, len(s))] == (min(ids) if s else d)
    assert ngram_join.ngram_components(empty).count() == 0
    kept = ngram_join.near_dedup(docs)
    assert kept.columns == docs.columns and {0, 1, 2, 5}.issubset({r.doc_id for r in kept.collect()})


def test_op2(spark, empty):
    rng = np.random.default_rng(5)
    rows = [(k, _text(rng, 60) + (" vile nasty" if k % 8 == 0 else ""), "en", "a", 1, None) for k in range(400)]
    rows += [(400, None, None, None, None, None), (401, "", None, None, None, None)]
    d = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, int(k % 8 == 0)) for k in range(0, 400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.score(d, toxicity.fit(d, labels)).toPandas().set_index("doc_id")
    assert len(out) == 402 and out.score.between(0, 1).all()
    assert all(out.held_out[k] == (zlib.crc32(str(k).encode()) % 5 == 0) for k in range(402))
    assert (out.predicted[:400] == (np.arange(400) % 8 == 0)).mean() > 0.99
    # labels of the held-out fold change nothing
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.score(d, toxicity.fit(d, flipped)).toPandas().set_index("doc_id")
    assert (again.score.sort_index() == out.score.sort_index()).all()
    assert toxicity.accepted(d, labels).columns == d.columns
    none = toxicity.fit(d, labels.limit(0))
    assert toxicity.score(d, none).where("predicted = 1").count() == 0 and toxicity.score(empty, none).count() == 0


def test_op3(docs, rows, empty):
    got = collections.Counter(tuple(r) for r in license_scan.scan(docs).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect())
    want = collections.Counter()
    for d, t, *_ in rows:
        w = license_scan.words_of(t or "")
        at = [(i, lab) for p, lab in license_scan.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        want[(d, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None),
              ",".join(sorted({lab for _, lab in at})))] += 1
    assert got == want and license_scan.scan(empty).count() == 0
    s = license_scan.Scanner(license_scan.PHRASES, license_scan.TEMPLATES)
    for name, text in license_scan.TEMPLATES.items():
        ids = [s.words[w] for w in license_scan.words_of(text)]
        matches = []
        s.scan(ids, 0, [], matches)
        assert any(s.labels[k] == name and c == 1.0 for *_, k, c in s.spans(matches))


def test_op4(docs, spark, empty):
    from tokenizers import Tokenizer
    path = vocabulary_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)

    def count(t):
        return len(tok.encode(t or "", add_special_tokens=False).ids)
    out = token_counts.edited_counts(docs, path, pattern=token_counts.MASKED).join(
        docs.select(F.col("doc_id").alias("d"), "text"), F.col("d") == F.col("doc_id")).collect()
    assert sum(r.n_edits for r in out) > 0
    assert all((r.n_tokens, r.n_tokens_edited) == (count(r.text), count(r.edited_text)) for r in out)
    rng = np.random.default_rng(9)
    long = " ".join(rng.choice(["word", "don't", "é", "x  y", "\n\n", "  ", "日本"], 4000))
    edits = []
    for a in sorted(rng.choice(len(long) - 40, 40, replace=False).tolist()):
        if not edits or a > edits[-1][1]:
            edits.append((a, a + int(rng.integers(0, 30)), str(rng.choice(["", " ", "new text", "é\n", "  "]))))
    schema = "doc_id long, text string, e array<struct<start: int, end: int, replacement: string>>"
    d = spark.createDataFrame([(1, long, edits), (2, "abc", None), (3, None, []), (4, "", [(0, 0, "hi there")])], schema)
    for r in token_counts.edited_counts(d, path, edits_col="e").collect():
        assert r.n_tokens_edited == count(r.edited_text)
        if r.doc_id == 1:
            want = long
            for a, b, new in reversed(edits):
                want = want[:a] + new + want[b:]
            assert r.edited_text == want and r.reencoded_bytes < 2 * len(want.encode())
    assert token_counts.edited_counts(empty, path, pattern="(?P<x>a)").count() == 0


def test_op5(docs, rows, empty):
    import hashlib
    groups = collections.defaultdict(list)
    for d, t, *_ in rows:
        groups[t or ""].append(d)
    for keep, pick in (("max", max), ("min", min)):
        want = collections.Counter()
        for t, ids in groups.items():
            k = pick(i for i in ids if i is not None)
            for d in ids:
                want[(d, k, len(ids), d == k, hashlib.sha256(t.encode()).hexdigest())] += 1
        assert collections.Counter(tuple(r) for r in exact_dedup.exact_groups(docs, keep=keep).collect()) == want
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.exact_dedup(docs).columns == docs.columns


def test_op5_is_native(docs):
    plan = exact_dedup.exact_groups(docs.select("doc_id", "text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_op6(spark, rows, docs, empty):
    rng = np.random.default_rng(7)
    lines = [_text(rng, 20) for _ in range(30)]
    lines += [x[:40] + "#" + x[41:] for x in lines[10:20]]  # one character changed
    lines += [x + " w1" for x in lines[:10]] + ["short", "tiny", "ab"]
    some = [(k, "\n".join(rng.choice(lines, 6)) + "\n\n", "en", "a", 1, None) for k in range(20)] + [(None, lines[0], "en", None, 1, None)]
    d = spark.createDataFrame(some, DOCS)
    out = {r.doc_id: r for r in line_dedup.dedup_lines(d).collect()}
    every = [(-1 if k is None else k, n, x) for k, t, *_ in some for n, x in enumerate(t.split("\n")) if x.strip()]
    w = line_dedup.SHINGLE
    shingles = {x: {x[i:i + w] for i in range(max(1, len(x) - w + 1))} for _, _, x in every}
    names = sorted(shingles)
    comp = {x: x for x in names}
    for a in names:
        for b in names:
            if a < b and _similar(shingles[a], shingles[b]):
                old, new = comp[b], comp[a]
                comp = {x: new if c == old else c for x, c in comp.items()}
    first = {}
    for k, n, x in sorted(every):
        first.setdefault(comp[x], (k, n))
    for k, t, *_ in some:
        want = "\n".join(x for n, x in enumerate(t.split("\n")) if not x.strip() or first[comp[x]] == (-1 if k is None else k, n))
        assert out[k].text == want
    assert line_dedup.dedup_lines(docs).count() == len(rows)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_op7(spark, docs, rows, empty):
    from tokenizers import Tokenizer
    rng = np.random.default_rng(2)
    for n in (0, 1, 127, 128, 129, 5000):
        for top in (1, 2, 70_000, 2 ** 32):
            ids = rng.integers(0, top, n).astype(np.uint32)
            ids[::17] = top - 1
            assert (token_output.decode_blocks(token_output.encode_blocks(ids)) == ids).all()
    path = vocabulary_path("byte_bpe_50k.json")
    tok, start, want = Tokenizer.from_file(path), 0, []
    for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    to = scratch_path(spark, "test")
    token_output.write_tokens(docs, to, path)
    got = token_output.read_tokens(spark, to).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    to = scratch_path(spark, "test")
    token_output.write_tokens(empty, to, path)
    assert token_output.read_tokens(spark, to).count() == 0


def test_op8(docs, rows, empty):
    from tokenizers import Tokenizer
    path = vocabulary_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    p = packing.pack(docs, path).toPandas()
    want = sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, *_ in rows)
    assert p.length.sum() == want and (p.ids.map(len) == 4 * p.length).all()
    assert all(zlib.crc32(i) == c for i, c in zip(p.ids, p.ids_crc32))
    for d, t, *_ in rows:
        if d is None or d == 5:
            continue
        own = p[p.doc_id == d].sort_values("start")
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        assert b"".join(own.ids) == np.array(ids, "<u4").tobytes() and (own.doc_tokens == len(ids)).all()
        assert (own.start == own.length.cumsum() - own.length).all()
    for _, s in p.sort_values("offset").groupby("sequence_id"):
        assert (s.offset == s.length.cumsum() - s.length).all()
        n = int(s.length.sum())
        assert n <= 2048 and n & (n - 1) == 0  # no padding
    assert packing.pack(empty, path).count() == 0


def test_op9(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 16))
    x[100:300] = x[100]  # a large group of equal vectors
    rows = [(k, [float(v) for v in x[k]], None) for k in range(600)]
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] * 16, 1), (603, [1.0] * 15 + [None], 1),
             (604, [float("inf")] * 16, 1), (None, [1.0] * 16, 1), (605, [], 1), rows[0]]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = ann.nearest(d, d.where("vec_id % 50 = 0"), k=5, shards=3).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, g in out.groupby("query_id"):
        g = g.sort_values("rank")
        s = u @ u[q]
        s[q] = -2
        best = np.lexsort((np.arange(600), -np.round(s, 12)))[:5]
        hits += len(set(best) & set(g.vec_id))
        assert g["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(g.score, s[g.vec_id])
        if q in (100, 150, 200, 250):
            assert g.vec_id.tolist() == [v for v in range(100, 107) if v != q][:5]
    assert out.query_id.nunique() == 12 and hits >= 0.9 * 60
    assert ann.nearest(d.limit(0), d).count() == 0 and ann.nearest(d.limit(1), d.limit(3)).count() >= 1


def test_op9_shards_stay_within_a_fixed_size(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 8))
    rows = [(k, [float(v) for v in x[k]]) for k in range(900)] + [(900 + k, [float(v) for v in x[k, :4]]) for k in range(60)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(ann, "SHARD_VECTORS", 40)
    monkeypatch.setattr(ann, "QUERY_NUMBERS", 100)  # several pieces of queries
    assert ann.shard_count(d, 3) == 24 and ann.shard_count(d, 30) == 30 and ann.shard_count(d.limit(0)) == 1
    sizes = [r["count"] for r in ann.shard_nodes(d, 24, 6).groupBy("shard").count().collect()]
    assert sum(sizes) == 960 and max(sizes) <= 80
    out = ann.nearest(d, d.where("vec_id % 20 = 0"), k=5, shards=3).toPandas()
    assert out.query_id.nunique() == 48
    for n, u in ((900, x), (60, x[:60, :4])):
        u = u / np.linalg.norm(u, axis=1, keepdims=True)
        low = 0 if n == 900 else 900
        for q, g in out[out.query_id.between(low, low + n - 1)].groupby("query_id"):
            s = u @ u[q - low]
            s[q - low] = -2
            assert g.sort_values("rank").vec_id.tolist() == (low + np.argsort(-s)[:5]).tolist()
    monkeypatch.setattr(ann, "SHARD_VECTORS", 20_000)
    monkeypatch.setattr(ann, "SHARD_NUMBERS", 744)
    assert ann.shard_count(d) == 10


def test_op10(spark, docs, rows, empty):
    rng = np.random.default_rng(8)
    some = [(k, _text(rng, int(n)), "en", ["s1", "s2", "s3", None][k % 4 if k % 5 else 0], 1, None)
            for k, n in enumerate(rng.integers(1, 300, 800))]
    d = spark.createDataFrame(some, DOCS)
    out = mixing.mix(d, block_rows=64).toPandas()
    again = mixing.mix(d.repartition(7), block_rows=64).toPandas()
    by = ["doc_id", "taken"]
    assert out[by].sort_values(by).values.tolist() == again[by].sort_values(by).values.tolist()
    assert (out["size"] == [len(some[k][1].split()) for k in out.doc_id]).all() and (out.taken <= 3 * out["size"]).all()
    total = out["size"].sum()
    sums = out.groupby(out.source.fillna("~")).agg(target=("target", "first"), taken=("taken", "sum"), own=("source_size", "first"))
    free = {n: w for n, w in zip(sorted(sums.index), (1, 2, 3, 1))}
    target, full = {}, {}
    while True:
        left = total - sum(full.values())
        target = {n: left * w / sum(x for m, x in free.items() if m not in full) for n, w in free.items() if n not in full}
        more = {n: 3 * int(sums.own[n]) for n in target if target[n] >= 3 * sums.own[n]}
        if not more:
            break
        full |= more
    target |= full
    for n in sums.index:
        assert abs(sums.target[n] - target[n]) < 1e-6 and abs(sums.taken[n] - target[n]) <= out["size"].max() / 2
    assert mixing.mix(docs).count() == len(rows) and mixing.mix(empty).count() == 0
    taken = {(r.doc_id, r.source, r["size"]): r.copies for r in mixing.mix(docs).collect()}
    seen = collections.Counter((r.doc_id, r.source) for r in mixing.mixed_documents(docs).collect())
    assert seen[(90, "a")] == taken[(90, "a", 120)]


def test_pipeline(spark, sf_small):
    import corpus_pipeline
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, sf_small)
        path = scratch_path(spark, f"test{k}")
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if k < 4:
            assert docs.columns == columns
            assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty()
    pieces = docs.toPandas()
    assert isinstance(pieces, pd.DataFrame) and len(pieces)
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048


def test_registered_queries_hold_their_contract(spark, sf_small):
    from loanbook.llm import queries
    want = {
        "op1_ngram_join": ["doc_id", "n_shingles", "component_id"], "op2_toxicity": ["doc_id", "held_out", "score", "predicted"],
        "op3_license_scan": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
        "op5_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
        "op7_token_output": ["doc_id", "start", "n_tokens", "ids_crc32"],
        "op9_nearest": ["query_id", "rank", "vec_id", "score"],
        "op10_mixing": ["doc_id", "size", "source_size", "target", "taken"]}
    for name, columns in want.items():
        assert queries.QUERIES[name](spark, sf_small).columns[:len(columns)] == columns


def test_line_links_of_one_probe_and_of_many():
    rng = np.random.default_rng(5)
    for _ in range(200):
        base = rng.choice(1000, rng.integers(1, 40), replace=False)
        sets = [np.unique(np.concatenate([rng.permutation(base)[:rng.integers(1, len(base) + 1)], rng.choice(1000, rng.integers(0, 4))]))
                .astype(np.uint64) for _ in range(rng.integers(1, 8))]
        n = len(sets)
        for sides in ([1] + [0] * (n - 1), [2] * n):
            roots = rng.integers(0, n + 1, n).tolist()
            want = {(i, k) for i in range(n) for k in range(n) if sides[i] and (sides[k] == 0 or (sides[k] == 2 and k > i))
                    and roots[i] != roots[k]
                    and 100 * len(np.intersect1d(sets[i], sets[k])) >= 80 * len(np.union1d(sets[i], sets[k]))}
            assert set(line_dedup.counted_links(list(range(n)), roots, sides, sets, 80)) == want


def test_line_links_of_many_groups():
    rng = np.random.default_rng(6)
    sets, sides, begins, want = [], [], [], set()
    for g in range(300):
        base = rng.choice(1000, rng.integers(1, 40), replace=False)
        n = int(rng.integers(1, 14))
        kind = g % 3
        own = [1] + [0] * (n - 1) if kind == 0 else [2] * n if kind == 1 else rng.integers(0, 2, n).tolist()
        own = rng.permutation(own).tolist()
        begins.append(len(sets))
        sides += own
        sets += [np.unique(np.concatenate([rng.permutation(base)[:rng.integers(max(1, len(base) - 4), len(base) + 1)], rng.choice(1000, rng.integers(0, 4))]))
                 .astype(np.uint64) for _ in range(n)]
    roots = rng.integers(0, 6, len(sets)).tolist()
    for a, b in zip(begins, [*begins[1:], len(sets)], strict=True):
        for i in range(a, b):
            for k in range(a, b):
                meets = (sides[i] == 1 and sides[k] == 0) or (sides[i] == sides[k] == 2 and i < k)
                if meets and roots[i] != roots[k] and 100 * len(np.intersect1d(sets[i], sets[k])) >= 80 * len(np.union1d(sets[i], sets[k])):
                    want.add((min(i, k), max(i, k)))
    links = line_dedup.links_of_groups(list(range(len(sets))), roots, sides, sets, begins, 80)
    assert {(min(x), max(x)) for x in links} == want and want


def test_line_sets_hold_the_shingles_of_each_line():
    lines = ["abcdefgh", "abc", "abcdefghabcdefgh", "é" * 30, "x", "abcdefghi", "abc"]
    sets = line_dedup.line_sets(lines)
    grams = [{t[i:i + line_dedup.SHINGLE] for i in range(max(1, len(t) - line_dedup.SHINGLE + 1))} for t in lines]
    assert [len(s) for s in sets] == [len(g) for g in grams]
    for i, g in enumerate(grams):
        assert (np.diff(sets[i].astype(object)) > 0).all()
        for k, o in enumerate(grams):
            assert len(np.intersect1d(sets[i], sets[k])) == len(g & o)


def test_line_bands_miss_hardly_any_pair_at_the_threshold():
    assert (1 - 0.8 ** line_dedup.ROWS) ** line_dedup.BANDS <= 5e-5
    rng = np.random.default_rng(9)
    own, tail, pairs = 90, 10, 20_000  # 80 of 100 shingles are shared
    letters = np.array([chr(c) for c in range(0x4E00, 0x4E00 + 4000)])
    body = rng.integers(0, 4000, (pairs, own + line_dedup.SHINGLE - 1))
    other = body.copy()
    other[:, -tail:] = rng.integers(0, 4000, (pairs, tail))
    a, b = (line_dedup._signatures(["".join(r) for r in letters[x]]) for x in (body, other))
    assert ((a == b).any(axis=1)).sum() >= pairs - 8


def test_op6_drops_lines_with_one_changed_character(spark):
    rng = np.random.default_rng(10)
    lines = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n - 2)) for n in range(49, 81)]
    lines = [f"A{x}Z" for x in lines]
    changed = [x[:len(x) // 2] + "9" + x[len(x) // 2 + 1:] for x in lines]
    d = spark.createDataFrame([(1, "\n".join(lines), "en", "a", 1, None), (2, "\n".join([*changed, "own line"]), "en", "a", 1, None)], DOCS)
    out = {r.doc_id: r for r in line_dedup.dedup_lines(d).collect()}
    assert out[1].text.split("\n") == lines and out[2].text == "own line" and out[2]["__dropped"] == len(lines)


def test_line_pairs_and_entries_that_bit_maps_allow(monkeypatch):
    """Keys of few lines give their possible pairs at once, larger ones the entries with a possible partner."""
    rng = np.random.default_rng(2)

    def some_bits():
        return rng.integers(0, 1 << 63, line_dedup.MAP_WORDS).astype(np.uint64)
    for turn in range(60):
        rows = int(rng.integers(1, 120))
        key = np.sort(rng.integers(0, max(1, rows // int(rng.integers(1, 14))), rows))
        node, base = rng.integers(0, 40, rows), some_bits()
        maps = np.stack([base & ~np.where(rng.random(len(base)) < .25, some_bits() & some_bits(), np.uint64(0)) for _ in range(40)])
        n = rng.integers(480, 560, 40)
        bits = [set(np.flatnonzero(np.unpackbits(m.view(np.uint8))).tolist()) for m in maps]
        pairs, entries = set(), set()
        for i in range(rows):
            for j in np.flatnonzero((key == key[i]) & (node != node[i])).tolist():
                x, y = int(node[i]), int(node[j])
                a, b = len(bits[x] - bits[y]), len(bits[y] - bits[x])
                if min(100 * (n[x] - a) - 80 * (n[x] + b), 100 * (n[y] - b) - 80 * (n[y] + a)) >= 0:
                    if (key == key[i]).sum() <= line_dedup.FEW:
                        pairs.add((min(x, y), max(x, y)))
                    else:
                        entries.add((int(key[i]), x))
        batch = pa.record_batch([pa.array(key), pa.array(node), pa.array(n[node].astype(np.int32)), line_dedup._map_column(maps[node])],
                                names=["key", "node", "n", "map"])
        for most in (1 << 14, 9):
            monkeypatch.setattr(line_dedup, "MOST_MAPS", most)
            got = [r for b in line_dedup._promising([batch.slice(a, 10) for a in range(0, rows, 10)]) for r in b.to_pylist()]
            own = [(r["key"], r["node"]) for r in got if r["key"] is not None]
            assert {(r["hub"], r["node"]) for r in got if r["key"] is None} == pairs, turn
            assert entries <= set(own) and len(own) <= rows and (most == 9 or set(own) == entries)


def test_lines_are_split_at_line_feeds_alone():
    rng = np.random.default_rng(4)
    for _ in range(500):
        docs = ["".join(rng.choice(list("ab\n\n \t\x0b\ré"), rng.integers(0, 14))) for _ in range(rng.integers(0, 6))]
        off = np.cumsum([0, *(len(d.encode()) for d in docs)])
        data = np.frombuffer("".join(docs).encode(), np.uint8)
        got = [(d, k, data[a:b].tobytes().decode()) for a, b, d, k in zip(*line_dedup._lines(data, off), strict=True)]
        assert got == [(d, k, x) for d, t in enumerate(docs) for k, x in enumerate(t.split("\n")) if x.strip(" \t\n\x0b\x0c\r")]


def test_dropped_lines_are_those_not_kept(docs):
    rows = docs.select("doc_id", F.xxhash64("text").alias("doc_key"), "text")
    every = line_dedup.line_components(rows).collect()
    got = [tuple(r) for r in line_dedup.dropped_lines(rows).collect()]
    assert collections.Counter(got) == collections.Counter((r.doc_id, r.doc_key, r.line) for r in every if not r.kept) and got
