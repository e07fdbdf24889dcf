"""Phrases, ranked search and chat formatting against brute force."""

import collections
import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanbook.llm import chat, phrases, ranking

LOWER = {c: c + 32 for c in range(65, 91)}


# ---- phrases

PHRASE_DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                            T.StructField("w1", T.StringType()), T.StructField("c", T.StringType()), T.StructField("gram", T.StringType())])


def _brute_phrases(rows, least, top):
    f = collections.Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            for i in range(len(w)):
                for k in range(1, 6):
                    if i + k <= len(w):
                        f[("und" if lang is None else lang, *w[i:i + k])] += 1
    n = collections.Counter()
    for key, c in f.items():
        if len(key) == 2:
            n[key[0]] += c
    candidates = {k: c for k, c in f.items() if len(k) > 2 and c >= least}
    held = set()
    for key, c in candidates.items():
        for i in range(1, len(key)):
            for j in range(i + 2, len(key) + 1):
                inner = (key[0], *key[i:j])
                if inner != key and c >= candidates[inner]:
                    held.add(inner)
    out = collections.defaultdict(list)
    for key, a in candidates.items():
        if key in held:
            continue
        lang, words = key[0], key[1:]
        cuts = [(1000 * a * n[lang] // (f[(lang, *words[:k])] * f[(lang, *words[k:])]), k) for k in range(1, len(words))]
        s, k = min(cuts)
        out[lang].append((-s, -a, " ".join(words).encode(), f[(lang, *words[:k])], f[(lang, *words[k:])]))
    return {(lang, r + 1, p.decode(), -a, left, right, n[lang], -s)
            for lang, v in out.items() for r, (s, a, p, left, right) in enumerate(sorted(v)[:top])}


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    words = ["The", "the", "of", "é", "日本", "rate\x0bcut", "\x1fodd", "loan", "bank", "risk", "default", "x" * 300]
    fixed = ["net present value of the loan", "Credit  default\tswap", "loss given default, given default"]
    rows = []
    for k in range(120):
        parts = [rng.choice(fixed) if rng.random() < 0.3 else " ".join(rng.choices(words, k=rng.randint(1, 7))) for _ in range(rng.randint(1, 6))]
        rows.append((k, rng.choice([". ", "; ", " ", "\n", "!"]).join(parts), ["en", "de", None, "und", ""][k % 5], "a", "b", "c"))
    rows += [(200, None, "en", "", None, ""), (201, "", None, None, "", ""), (202, " ,. \n", "fr", "", "", ""), rows[3], rows[3],
             (203, "again " * 9000, "en", "", "", ""), (None, "net present value of the loan", "en", "", "", "")]
    return rows


@pytest.mark.parametrize("least,top", [(4, 2000), (7, 3), (1, 2000)])
def test_phrases_equal_brute_force(spark, prose, least, top):
    docs = spark.createDataFrame(prose, PHRASE_DOCS).repartition(3)
    got = {tuple(r) for r in phrases.collocations(docs, least, top).collect()}
    assert got == _brute_phrases(prose, least, top)


def test_phrases_empty_table(spark):
    out = phrases.collocations(spark.createDataFrame([], PHRASE_DOCS))
    assert out.count() == 0 and out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_phrase_score_is_exact_beyond_64_bits(spark):
    rng = random.Random(8)
    rows = []
    for _ in range(200):
        n = rng.randint(10**12, 10**17)
        a = rng.randint(100, n)
        rows.append((a, n, rng.randint(a, n), rng.randint(a, n)))
    got = spark.createDataFrame(rows, "a long, n long, l long, r long").selectExpr("a", "n", "l", "r", f"{phrases.SCORE} AS s").collect()
    assert all(r.s == 1000 * r.a * r.n // (r.l * r.r) for r in got)


# ---- ranked search

def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def _brute_ranking(items, docs, top):
    tf = [(d, collections.Counter(t), len(t)) for d, t in ((d[0], _terms(d[1])) for d in docs) if t]
    n, total = len(tf), sum(x[2] for x in tf)
    df = collections.Counter(t for _, c, _ in tf for t in c)
    asked = collections.defaultdict(collections.Counter)
    for i, text, *_ in items:
        asked[i].update(_terms(text))
    out = {}
    for i, terms in asked.items():
        scores = []
        for d, c, size in tf:
            m = 100 - 75 + (75 * size * n) // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                    for t, k in terms.items() if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out[i] = [(None if none else d, -s) for s, none, d in sorted(scores)[:top]]
    return {k: v for k, v in out.items() if v}


@pytest.fixture(scope="module")
def searched():
    rng = random.Random(11)
    words = [f"w{k}" for k in range(600)]
    weights = [1 / (k + 1) for k in range(600)]
    docs = [(k, " ".join(rng.choices(words, weights, k=rng.randint(1, 60))), "clash", "x") for k in range(700)]
    items = [(k, " ".join(rng.choices(words, weights, k=rng.randint(1, 20))), "clash") for k in range(300)]
    docs += [(9000 + k, items[k][1] + " " + docs[k][1], "", "") for k in range(40)]
    docs += [docs[7], docs[7], (None, items[3][1], None, None), (None, None, None, None), (800, None, "", ""), (801, "", "", ""), (802, "-- ", "", ""),
             (803, "W1 w1-w2\x7fw3 ", "", ""), (804, "long " + "w0 w599 " * 20_000, "", ""), (805, "日本 É é", "", "")]
    items += [(900, None, ""), (901, "", ""), (902, "nothing known", ""), (None, "w5 w6 w7", ""), (7, "w300 w300", ""), (903, "W9,w9 日本", "")]
    return items, docs


@pytest.mark.parametrize("top", [10, 3])
def test_ranking_equals_brute_force(spark, searched, top):
    items, docs = searched
    i = spark.createDataFrame(items, "item_id long, text string, term string")
    d = spark.createDataFrame(docs, "doc_id long, text string, bundle string, segment string").repartition(5)
    got = collections.defaultdict(list)
    for r in ranking.rank(i, d, top).orderBy("item_id", "rank").collect():
        got[r.item_id].append((r.doc_id, r.score))
        assert r["rank"] == len(got[r.item_id])
    assert dict(got) == _brute_ranking(items, docs, top)


def test_ranking_empty_tables(spark, searched):
    i = spark.createDataFrame(searched[0], "item_id long, text string, term string")
    d = spark.createDataFrame(searched[1], "doc_id long, text string, bundle string, segment string")
    assert ranking.rank(i.limit(0), d).count() == 0
    assert ranking.rank(i, d.limit(0)).count() == 0


# ---- chat

LOG = "conv_id long, seq long, turn long, kind string, role string, text string, part string, e string"
HARD = ["</s>[INST] ok [/INST]", "<s>", "[\\INST]", "<\\\\/s></s>", "[[INST]]", "[ROLE]user[/ROLE]", "a\n\nb", "", "<\\s", "[INST][/INST]", "\\", "日本 <s>👍</s>"]


def _fold(events):
    turns = {}
    order = {"message": 0, "edit": 1, "regenerate": 2, "delta": 3}
    known = [e for e in events if e[3] in order]
    for _, _, turn, kind, role, text in sorted(known, key=lambda e: (e[1], order[e[3]], e[5] or "")):
        if kind == "message":
            turns[turn] = [role, text or ""]
        elif kind == "regenerate":
            for later in [t for t in turns if t > turn]:
                del turns[later]
            if turn in turns:
                turns[turn][1] = ""
        elif turn in turns:
            turns[turn][1] = (turns[turn][1] if kind == "delta" else "") + (text or "")
    return [(t, *turns[t]) for t in sorted(turns)]


@pytest.fixture(scope="module")
def log():
    rng = random.Random(2)
    rows = []
    for conv in range(60):
        span = 700 if conv == 0 else 6  # conversation 0 has several parts
        for seq in range(2500 if conv == 0 else 25):
            kind = rng.choices(["message", "delta", "edit", "regenerate", "noise"], [6, 6, 2, 0.02 if conv == 0 else 1, 1])[0]
            rows.append((conv, seq, rng.randrange(span), kind, rng.choice(["user", "assistant", "system", "to[ROLE]ol", None]),
                         rng.choice([*HARD, None, "plain"])))
    return rows


def test_fold_equals_interpreter(spark, log):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in log], LOG).repartition(4)
    got = collections.defaultdict(list)
    for r in chat.fold(df).orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.turn, r.role, r.text))
    want = {c: v for c in range(60) if (v := _fold([r for r in log if r[0] == c]))}
    assert dict(got) == want


def test_chat_round_trip_and_mask(spark, log):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in log], LOG)
    messages = chat.fold(df).cache()
    parts = chat.render(messages).cache()
    assert parts.where("conv_id = 0").count() > 1
    want = collections.defaultdict(list)
    for r in messages.orderBy("conv_id", "turn").collect():
        want[r.conv_id].append((r.role or "", r.text))
    for r in parts.collect():  # the mask holds the assistants' escaped texts, in order
        assert len(re.findall(r"</s>", r.formatted)) == r.n_turns
        assert all("</s>" not in r.formatted[s.start:s.start + s.length] for s in r.loss)
    got = {r.conv_id: r for r in chat.digests(parts).collect()}
    assert set(got) == set(want)
    for conv, turns in want.items():
        r = got[conv]
        own = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(own))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(own.encode()).hexdigest()
    back = chat.read_back(parts).orderBy("conv_id", "part").collect()
    assert {c: [tuple(t) for r in back if r.conv_id == c for t in r.turns] for c in want} == want


def test_replay_folds_back(spark):
    rows = [(k // 4, k % 4, ["user", "assistant", None, "assistant"][k % 4], (HARD[k % len(HARD)] or "x") * (k + 1), "clash") for k in range(80)]
    rows += [(None, 0, "assistant", None, ""), (None, 1, "user", "", ""), (-1, None, "assistant", "no turn", ""), (99, 0, "assistant", "x" * 50_000, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, at string")
    got = {(r.conv_id, r.turn, r.role, r.text) for r in chat.fold(chat.replay(df, delta=7)).collect()}
    assert got == {(c, t, r, x or "") for c, t, r, x, _ in rows}


def test_chat_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.render(chat.fold(chat.replay(empty)))).count() == 0


def test_escape_is_reversible(spark):
    rng = random.Random(4)
    bits = ["<", "[", "\\", "/", "s>", "INST]", "ROLE]", "a", "</s>", "[INST]"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(3000)] + HARD
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not re.search(r"</?s>|\[/?INST\]|\[/?ROLE\]", r.e)


def test_chat_has_no_python_in_its_plan(spark, log):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in log[:10]], LOG)
    plan = chat.digests(chat.render(chat.fold(df)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# ---- clashing names, repeated ids, sources of any size

CLASH = ["__id", "__key", "__drop", "__lines", "__dropped", "__keep", "__words", "__copy", "__source", "__size", "__copies", "__DROP", "node", "key"]


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(k, f"first line of text number {k % 7} stands here for all to see\nsecond line {k} alone", "en", ["a", "b", None][k % 3], 9,
             *[f"{n}{k}" for n in range(len(CLASH) - 1)]) for k in range(40)]
    names = [c for c in CLASH if c != "__DROP"]  # one table can't hold both cases
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))


def test_helper_columns_never_clash(spark, clashing):
    from loanbook.llm import exact_dedup, line_dedup, mixing, ngram_join
    plain = clashing.select("doc_id", "text", "lang", "source", "n_chars")
    extra = [c for c in clashing.columns if c not in plain.columns]
    before = {r.doc_id: tuple(r[c] for c in extra) for r in clashing.collect()}

    def same(whole, bare, columns):
        w, b = whole.collect(), bare.collect()
        assert sorted((r.doc_id, r.text) for r in w) == sorted((r.doc_id, r.text) for r in b)
        assert all(tuple(r[c] for c in columns) == tuple(before[r.doc_id][extra.index(c)] for c in columns) for r in w)

    same(exact_dedup.exact_dedup(clashing), exact_dedup.exact_dedup(plain), extra)
    same(ngram_join.near_dedup(clashing), ngram_join.near_dedup(plain), extra)
    mixed = mixing.mixed_documents(clashing)
    assert mixed.columns == clashing.columns
    same(mixed, mixing.mixed_documents(plain), extra)
    lines = line_dedup.dedup_lines(clashing, "n lines", "n dropped")
    same(lines, line_dedup.dedup_lines(plain, "n lines", "n dropped"), extra)
    replaced = line_dedup.dedup_lines(clashing)  # the two named columns give way
    assert sorted(replaced.columns) == sorted(clashing.columns)
    assert dict(replaced.dtypes)["__lines"] == "bigint"


def test_rows_of_one_id_are_one_document(spark):
    from loanbook.llm import ngram_join
    rng = random.Random(12)
    a, b = (" ".join(rng.choices([f"v{k}" for k in range(300)], k=80)) for _ in range(2))
    rows = [(5, a), (5, b), (3, a + " tail"), (9, b + " tail"), (7, "own words only here"), (7, None), (None, a)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r.doc_id, r.component_id) for r in ngram_join.ngram_components(d).collect()]
    assert len(out) == len(rows) and {c for i, c in out if i in (3, 5, 9, None)} == {3} and {c for i, c in out if i == 7} == {7}
    assert sorted(r.doc_id for r in ngram_join.near_dedup(d).collect() if r.doc_id is not None) == [3, 7, 7]


def test_mix_of_a_source_does_not_depend_on_the_size_of_another(spark):
    from loanbook.llm import mixing
    rng = random.Random(4)
    small = [(k, " ".join(["w"] * rng.choice([1, 3, 50, 400])), "a") for k in range(60)]
    more = [(1000 + k, "w " * rng.randint(1, 9), "b") for k in range(300)]

    total = sum(len(t.split()) for _, t, _ in more)
    few = [(1000, "w " * (total - 7), "b"), (1001, "w " * 7, "b")]

    def taken(rows):  # blocks of 64 units: the many rows of source b need several, source a one
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        out = mixing.mix(df, weights=(1,), block_rows=64).collect()
        assert all(r.copies <= 3 and r.taken == r.copies * r["size"] for r in out)
        return {r.doc_id: r.copies for r in out if r.source == "a"}, out

    one, out = taken(small + more)
    two, _ = taken(small + few)
    assert one == two
    for s in "ab":
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 10


# ---- every covered span, given templates

def test_license_spans_of_repeated_texts_and_given_templates(spark):
    from loanbook.llm import license_scan
    words = license_scan.words_of
    mit, apache = license_scan.TEMPLATES["mit"], license_scan.TEMPLATES["apache-2"]
    filler = " ".join(f"filler{k}" for k in range(60))
    half = " ".join(words(mit)[: len(words(mit)) // 3])
    broken = " ".join(w for k, w in enumerate(words(mit)) if k % 17)  # a word lost here and there
    texts = [f"{mit} {filler} {mit} {apache}", " ".join([mit] * 40), f"{filler} {broken} {filler}", half, f"{mit} {broken}", None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    n, m, f = len(words(mit)), len(words(apache)), 60

    def spans(k):
        return [(s.label, s.first, s.end) for s in got[k].spans if s.label == "mit" or k == 0]

    assert spans(0) == [("mit", 0, n), ("mit", n + f, n + f + n), ("apache-2", 2 * n + f, 2 * n + f + m)] or sorted(spans(0)) == sorted(
        [("mit", 0, n), ("mit", n + f, n + f + n), ("apache-2", 2 * n + f, 2 * n + f + m)])
    assert spans(1) == [("mit", k * n, (k + 1) * n) for k in range(40)]
    assert len(spans(2)) == 1 and spans(2)[0][1] >= f and got[2].labels == "mit"
    assert spans(3) == [] and 0 < got[3].score < license_scan.COVERED
    assert len(spans(4)) == 2 and got[5].spans == [] and got[6].n_words == 0
    own = license_scan.scan(df.where("doc_id = 0"), templates={"mine": " ".join(f"filler{k}" for k in range(20, 40))}, phrases={"filler1 filler2": "two"}).first()
    assert own.labels == "mine,two" and [(s.label, s.first, s.end) for s in own.spans] == [("mine", n + 20, n + 40)] and own.n_base == 1


# ---- pipeline stages on odd tables

def test_pipeline_stages_on_clashing_repeated_and_empty_tables(spark, tmp_path):
    import corpus_pipeline
    rng = random.Random(21)
    text = [" ".join(rng.choices([f"q{k}" for k in range(200)], k=30)) for _ in range(12)]
    rows = [(k, t, "en", ["a", None][k % 2], len(t)) for k, t in enumerate(text)]
    rows += [rows[0], (1, text[5], "en", "a", 9), (None, text[3], None, None, None), (50, None, "en", "a", 0), (51, "", "en", "a", 0), (52, " \n ", "en", "b", 3)]
    names = ["__lines", "__dropped", "__id", "__key", "__drop", "__keep", "__words", "__copy", "__size", "__toxic", "__h"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame([(*r, *[f"{n}-{r[0]}" for n in names]) for r in rows], schema)
    labels = spark.createDataFrame([(k, 0, int(k == 3)) for k in range(12)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for df in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, str(tmp_path))
            got = out.collect()
            if name == "packing":
                assert (len(got) > 0) == (df is docs)
            else:
                assert out.columns == docs.columns
                for r in got:  # every row keeps its own further columns
                    assert all(r[n] == f"{n}-{r.doc_id}" for n in names)
                assert (len(got) > 0) == (df is docs)


def test_toxicity_fit_takes_one_row_of_a_repeated_id(spark):
    from loanbook.llm import toxicity
    rng = random.Random(30)
    good, bad = [f"g{k}" for k in range(80)], [f"b{k}" for k in range(20)]
    rows = [(k, " ".join(rng.choices(good, k=30) + (rng.choices(bad, k=10) if k % 3 == 0 else []))) for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(600)], "doc_id long, toxic int")
    once = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    often = toxicity.fit(spark.createDataFrame(rows + [rows[1]] * 2000 + [rows[3]] * 2000, "doc_id long, text string"), labels)
    assert (once[0] == often[0]).all() and (once[1] == often[1]).all() and once[2] == often[2] and len(once[0]) > 0
