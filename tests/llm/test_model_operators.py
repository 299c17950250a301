"""Operators without SQL: held-out accuracy, brute force, exact round trips."""

import hashlib
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultloom.llm import ann, langid, minhash, packing, quality, suffix_array, suffix_dedup
from faultloom.llm.queries import default_tokenizer, queries

SF = "/root/testdata/sf0.001"
HARD = [(1, "Hello there, one two three four five six"), (2, None), (3, ""), (4, "12 34 !!"), (5, "word " * 30_000), (6, "hello THERE, one two three four five six"), (7, "a"), (7, "a")]


@pytest.fixture(scope="module")
def hard(spark):
    df = spark.createDataFrame(HARD, "doc_id long, text string")
    for name in ("id", "x", "h1", "bands", "class_id", "score", "packed"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_language_held_out(spark):
    got = queries()["op8_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.95 * got.count() > 0


def test_language_against_brute_force(spark):
    """The same ridge regression and decoding on all rows at once; the sample bound is above their number."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    taught = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] is not None and r["text"] is not None]
    names = sorted({r["lang"] for r in taught})
    x = np.array([langid.profile(r["text"]) for r in taught], float)
    y, code = np.array([names.index(r["lang"]) for r in taught]), langid.codewords(len(names))
    w = 1 / np.bincount(y)[y] / len(names)
    weights = np.linalg.solve((x * w[:, None]).T @ x + langid.RIDGE * np.eye(x.shape[1]), (x * w[:, None]).T @ code[y])
    trust = (((x @ weights) * code[y] > 0) * w[:, None]).sum(axis=0).clip(0.05)
    got = {r["doc_id"]: r for r in queries()["op8_language_id"](spark, SF).collect()}
    for r in rows:
        if r["text"] is None or not any(map(str.isalpha, r["text"])):
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        loss = (np.exp(-2 * (langid.profile(r["text"]).astype(float) @ weights) * code) * trust).sum(axis=1) / trust.sum()
        share = np.exp(-4 * (loss - loss.min()))
        share /= share.sum()
        assert abs(got[r["doc_id"]]["score"] - share.max()) < 0.02
        if np.diff(np.sort(share))[-1] > 0.05:
            assert got[r["doc_id"]]["lang_pred"] == names[int(share.argmax())]


def test_language_hard_rows(spark, hard):
    model = langid.LanguageModel.fit(hard.withColumn("lang", F.lit("en")))
    got = sorted((r["doc_id"], r["lang_pred"]) for r in langid.identify(hard, model).collect())
    assert got == [(1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "en"), (6, "en"), (7, "en"), (7, "en")]
    nothing = langid.LanguageModel.fit(hard.limit(0).withColumn("lang", F.lit("en")))
    assert {r["lang_pred"] for r in langid.identify(hard, nothing).collect()} == {"und"}
    code = langid.codewords(12)
    assert min((code[i] != code[j]).sum() for i in range(12) for j in range(i)) >= 8


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries()["op6_quality"](spark, SF).join(labels, "doc_id").filter("held_out")
    assert got.filter("predicted = quality").count() >= 0.9 * got.count() > 0


def test_quality_against_brute_force(spark):
    """Class densities worked out with whole matrices, inverses and determinants."""
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] in (0, 1)]
    taught = [(i, q) for i, q in labels if i in rows and zlib.crc32(str(i).encode()) % 3 != 1]
    x, y = np.array([quality.statistics(rows[i]) for i, _ in taught]), np.array([q for _, q in taught])
    spread = [np.cov(x[y == k].T, bias=True) for k in (0, 1)]
    pooled = sum((y == k).mean() * spread[k] for k in (0, 1))
    parts = []
    for k in (0, 1):
        mixed = (1 - quality.TO_POOLED) * spread[k] + quality.TO_POOLED * pooled
        parts.append((x[y == k].mean(axis=0), (1 - quality.TO_IDENTITY) * mixed + quality.TO_IDENTITY * np.diag(np.diag(pooled).clip(1e-6)), (y == k).mean()))
    for r in queries()["op6_quality"](spark, SF).collect():
        v = np.array(quality.statistics(rows[r["doc_id"]]))
        logs = [math.log(p) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (v - m) @ np.linalg.inv(s) @ (v - m) for m, s, p in parts]
        want = 1 / (1 + math.exp(min(max(logs[0] - logs[1], -700), 700)))
        assert abs(r["score"] - want) < 1e-6 and r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_quality_hard_rows(spark, hard):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(hard, labels).collect()
    assert len(got) == 8 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_quality(hard.limit(0), labels).count() == 0


def test_neighbours_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    got = {}
    for r in queries()["op5_nearest"](spark, SF).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -9
        hits += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(got[ids[i]]))
        assert all(abs(s[np.flatnonzero(ids == v)[0]] - score) < 1e-12 for v, score in got[ids[i]].items())
    assert hits >= 0.9 * 20 * len(got)


def recall(spark, x, queries, **options):
    """Mean recall at 20 against brute force, with scores, order and own ids checked."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(8)
    got = {}
    for r in ann.nearest_neighbours(df, df.filter(F.col("vec_id").isin(queries)), k=20, **options).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert sorted(got) == sorted(queries)
    found = []
    for q, rows in got.items():
        s = np.einsum("ij,j->i", x, x[q])
        order = np.lexsort((np.arange(len(x)), -s))
        want = order[order != q][:20]
        mine = [rows[rank] for rank in sorted(rows)]
        assert sorted(rows) == list(range(1, 21)) and q not in dict(mine) and mine == sorted(mine, key=lambda m: (-m[1], m[0]))
        assert all(abs(s[v] - score) < 1e-12 for v, score in mine)
        found.append(len(set(want.tolist()) & {v for v, _ in mine}) / 20)
    return float(np.mean(found))


def test_neighbours_recall_without_clusters(spark):
    x = np.random.default_rng(1).normal(size=(20_000, 32))
    assert recall(spark, x / np.linalg.norm(x, axis=1)[:, None], list(range(0, 20_000, 100))) >= 0.95


def test_neighbours_recall_in_clusters_of_many_lengths(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 24)) * 4
    x = centres[rng.integers(0, 40, 12_000)] + rng.normal(size=(12_000, 24)) * rng.uniform(0.1, 1.0, (12_000, 1))
    assert recall(spark, x, list(range(0, 12_000, 100)), block_rows=1000) >= 0.9


def test_neighbours_beside_many_copies(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    plain = np.array([r["embedding"] for r in rows], float)
    x = np.concatenate([plain, np.repeat(plain[77:78], len(plain) // 2, axis=0)])
    assert recall(spark, x[np.random.default_rng(3).permutation(len(x))], list(range(0, len(x), 20)), block_rows=500) >= 0.93


def test_regions_hold_their_entries():
    rng = np.random.default_rng(4)
    pivots, held = rng.normal(size=(50, 8)), rng.integers(0, 400, 50)
    held[3], held[9] = 5000, 0
    blocks = ann.regions(pivots, held, 1000)
    assert len(blocks[3]) == 5 and blocks[9] == []
    sums = Counter()
    for n, own in zip(held.tolist(), blocks, strict=True):
        sums.update({b: n / len(own) for b in own})
    assert sorted(sums) == list(range(len(sums))) and max(sums.values()) <= 1000


def test_neighbours_hard_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit("x"))
    got = [tuple(r) for r in ann.nearest_neighbours(df, df.filter("vec_id IN (0, 4)"), k=20).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 8, 0.5)]
    assert ann.nearest_neighbours(df.limit(0), df).count() == 0


def bag(text):
    w = text.translate({i: i + 32 for i in range(65, 91)}).encode().split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def test_near_duplicates_against_brute_force(spark):
    docs = {r["doc_id"]: bag(r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    root = {i: i for i in docs}
    for i in docs:
        for j in docs:
            if j < i:
                both = sum((docs[i] & docs[j]).values())
                if both and both / (sum(docs[i].values()) + sum(docs[j].values()) - both) >= 0.8:
                    a, b = root[i], root[j]
                    root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    got = {r["doc_id"]: r["class_id"] for r in queries()["op9_near_dedup"](spark, SF).collect()}
    assert got == root


def classes(docs, threshold=0.8):
    bags, root = {i: bag(t) for i, t in docs.items()}, {i: i for i in docs}
    for i in bags:
        for j in bags:
            if j < i:
                both = sum((bags[i] & bags[j]).values())
                if both and both / (sum(bags[i].values()) + sum(bags[j].values()) - both) >= threshold:
                    a, b = root[i], root[j]
                    root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()} if a != b else root
    return root


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_of_crowds(spark, seed):
    """Copies of a few texts at all distances, with and without those that link them."""
    import random

    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(400))
    bases, docs = [[word() for _ in range(n)] for n in (60, 150, 150)], {}
    bases[2][:75] = bases[1][:75]
    for i in range(150):
        text = list(rng.choice(bases))
        for _ in range(rng.choice((0, 1, 2, 3, 4, 6, 9))):
            text[rng.randrange(len(text))] = word()
        docs[i] = " ".join(text)
    for i in range(150, 200):  # chains: each a little further from the one before
        text = docs[i - 1].split()
        text[rng.randrange(len(text))] = word()
        docs[i] = " ".join(text)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(df).collect()} == classes(docs)


def test_near_duplicates_hard_rows(spark, hard):
    got = sorted((r["doc_id"], r["class_id"], r["class_size"], r["kept"]) for r in minhash.near_duplicates(hard).collect())
    assert got == [(1, 1, 2, True), (2, 2, 1, True), (3, 3, 1, True), (4, 4, 1, True), (5, 5, 1, True), (6, 1, 2, False), (7, 7, 2, True), (7, 7, 2, True)]
    assert minhash.near_duplicates(hard.limit(0)).count() == 0


def test_signatures_are_unbiased():
    from faultloom.llm import shingles as S

    word = S.mix(np.arange(300, dtype=np.uint64))
    a = np.sort(np.concatenate([np.repeat(word[:50], 9), word[100:300]]))
    b = np.sort(np.concatenate([np.repeat(word[:50], 5), word[200:300]]))
    sign, _ = minhash.bag_signatures(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 3000)
    assert abs((sign[0] == sign[1]).mean() - (250 + 100) / (450 + 200)) < 0.04


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for n in [*range(30), 200]:
        for k in (1, 2, 4, 26):
            raw = rng.integers(0, k, n).astype(np.uint8)
            sa, b = suffix_array.suffix_array(np.append(raw.astype(int) + 1, 0), 257), raw.tobytes()
            assert sa.tolist() == [n, *sorted(range(n), key=lambda i: b[i:])]
            if n:
                common, at = suffix_array.permuted_prefixes(raw, sa), {p: i for i, p in enumerate(sa.tolist())}
                for i in range(n):
                    j, m = sa[at[i] - 1], 0
                    while max(i, j) + m < n and b[i + m] == b[j + m]:
                        m += 1
                    assert common[i] == m


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_suffix_dedup_against_brute_force(spark, hot):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(1000, None), (1001, ""), (1002, "ab" * 400), (1003, "é" * 150)], "doc_id long, text string"))
    data = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    count = Counter(b[p : p + 200] for b in data.values() for p in range(len(b) - 199))
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(docs, hot=hot).collect()}
    assert set(got) == set(data)
    for i, b in data.items():
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 199):
            if count[b[p : p + 200]] > 1:
                gone[p : p + 200] = True
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        runs = int((np.diff(np.concatenate([[0], gone.view(np.int8), [0]])) == 1).sum())
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len(b), int(gone.sum()), runs, hashlib.sha256(left).hexdigest())


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1, 5])
def test_suffix_dedup_of_runs_and_shared_passages(spark, hot):
    """Runs of one word in many texts, and a passage with unlike neighbours, cut short here and there."""
    import random

    rng, length = random.Random(6), 200
    noise = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = noise(420)
    texts = [noise(rng.randrange(80)) + "the " * rng.choice((40, 70, 120)) + noise(rng.randrange(80)) for _ in range(12)]
    texts += [noise(rng.choice((0, 3, 150))) + passage[rng.choice((0, 0, 90)) : rng.choice((420, 420, 330))] + noise(rng.choice((0, 3, 150))) for _ in range(40)]
    texts += ["x" * 700, "x" * 450, "ab" * 150 + "x" * 300, passage[:260] + "Z" + passage[261:]]
    seen, want = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1)), {}
    for doc, t in enumerate(texts):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        want[doc] = "".join(c for c, g in zip(t, gone, strict=True) if not g)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, packed string, at int")
    assert {r["doc_id"]: r["kept_text"] for r in suffix_dedup.suffix_dedup(df, hot=hot).collect()} == want


def test_suffix_dedup_hard_rows(spark, hard):
    got = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(hard.filter("doc_id < 7")).collect()}
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"]) for i, r in got.items()} == {i: (len(t or ""), 150_000 if i == 5 else 0, int(i == 5)) for i, t in HARD if i < 7}
    assert got[2]["kept_sha256"] == got[3]["kept_sha256"] == hashlib.sha256(b"").hexdigest()


def test_suffix_dedup_repeated_ids(spark):
    rows = [(1, "x" * 150 + "y" * 100), (1, "x" * 150 + "y" * 100), (2, "short")]
    got = sorted((r["doc_id"], r["n_removed"]) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 250), (1, 250), (2, 0)]
    assert suffix_dedup.suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packing_round_trip(spark, hard):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(hard.select((F.col("doc_id") + 10_000).alias("doc_id"), F.concat("text", F.lit(" é İ ς <|endoftext|> ²"))).filter("doc_id <> 10007"))
    encode = packing.encoder(default_tokenizer()).tokenizer.encode
    pieces = packing.pack(docs, default_tokenizer()).toPandas()
    for r in docs.collect():
        ids = np.array([*encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in pieces[pieces.doc_id == r["doc_id"]].sort_values("start").itertuples():
            assert (p.start, p.ids_crc32, p.doc_tokens) == (at, zlib.crc32(ids[at : at + p.length].tobytes()), len(ids))
            at += p.length
        assert at == len(ids)
    for _, s in pieces.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.length.sum() <= 4096 and s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
    assert pieces.length.sum() / pieces.sequence_id.nunique() / 4096 > 0.9
    assert packing.pack(docs.limit(0), default_tokenizer()).count() == 0


def test_packing_hard_rows(spark, hard):
    """Ids beyond the exact range of a double stay exact beside a null id; repeated ids are packed each."""
    rows = [((1 << 53) + 1, "one two"), ((1 << 53) + 3, "three"), (None, "four"), (None, None), (5, "five"), (5, "five")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash")).withColumn("length", F.lit(-1))
    got = packing.pack(df, default_tokenizer()).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert packing.pack(hard, default_tokenizer()).filter("start = 0").count() == len(HARD)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_packing_with_any_tokenizer(spark, name):
    import public_tokenizers

    path, texts = public_tokenizers.path(name), ["Hello  World's\ttabs 123", "", "İstanbul ÀB e\u0301 <|endoftext|>", "x" * 5000]
    own = packing.encoder(path)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r["doc_id"], r["start"]): (r["length"], r["ids_crc32"]) for r in packing.pack(df, path).collect()}
    for i, text in enumerate(texts):
        ids = np.array([*own.tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        n = got[i, 0][0]
        assert own.encode(text) == ids[:-1].tobytes() and got[i, 0][1] == zlib.crc32(ids[:n].tobytes())


def test_encoders_keep_few_bytes():
    """A worker's memory stays small however many words, or however long ones, its texts have."""
    own = packing.WordEncoder(default_tokenizer())
    letters = str.maketrans("0123456789", "abcdefghij")
    texts = [" ".join(f"{1000 * i + j}".translate(letters) + "," for j in range(1000)) for i in range(350)]
    texts += [" ".join("ab" * 2000 + f"{i}z{j}" for j in range(20)) for i in range(50)]
    tracemalloc.start()
    found = [zlib.crc32(own.encode(t)) for t in texts]
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    for i in (0, 170, 349, 350, 399):
        assert found[i] == zlib.crc32(np.array(own.tokenizer.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes())
    assert kept < 50e6


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF).toPandas()
    assert len(out) and out.groupby("sequence_id").length.sum().max() <= 4096
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, None, None, None), (9002, "!!! 123", "en", "s", 7)], docs.schema)
    for _, stage in corpus_pipeline.STAGES[:1]:
        kept = stage(spark, docs.union(extra), SF)
        assert kept.columns == list(corpus_pipeline.COLUMNS) and kept.filter("doc_id > 9000").count() == 0 and kept.count() >= 0.98 * docs.count()
