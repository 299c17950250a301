"""Each stage of the pipeline against a brute-force version, on rows with nulls, copies and repeated lines."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from faultloom.llm import packing
from faultloom.llm.queries import default_tokenizer

SF = "/root/testdata/sf0.001"
COLUMNS = corpus_pipeline.COLUMNS


def rows_of(df):
    return [tuple(r) for r in df.select(*COLUMNS).collect()]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def mixed(rows, quality):
    """The mix in plain Python: water-filled targets, keys, prefix sums."""
    sources = defaultdict(list)
    for r in rows:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
        draw = str(r[0]) if r[0] is not None else hashlib.md5((r[1] or "").encode()).hexdigest()
        u = (int(hashlib.md5(f"17:{draw}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        sources[r[3]].append((-math.log(u) / {1: 2.0, 0: 0.5}.get(quality.get(r[0]), 1.0), words, r))
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    size = {s: sum(w for _, w, _ in sources[s]) for s in names}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, float(sum(size.values()))
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * size[s], level * weight[s]) for s in names) < sum(size.values()) else (low, level)
    out = []
    for s in names:
        target, at = min(3 * size[s], high * weight[s]), 0
        epochs = int(target // size[s]) if size[s] else 0
        for _, words, r in sorted(sources[s], key=lambda x: x[:2]):
            out += [r] * (epochs + (2 * at + words < 2 * (target - epochs * size[s])))
            at += words
    return out


@pytest.fixture(scope="module")
def docs(spark):
    """All documents, then null ids (copies among them), null sources and texts, repeated lines."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    rows = rows_of(base)
    long = [r for r in rows if r[2] == "en" and len(r[1]) > 400][:12]
    extra = [(None, f"{r[1]} also line {i}", r[2], r[3], 1) for i, r in enumerate(long[:4])]
    extra += [(None, "We have read this short text about the house and the garden of the neighbours.", "en", None, 1)] * 2
    extra += [(9000 + i, r[1], r[2], "copied", 1) for i, r in enumerate(long[4:8])]
    extra += [(9100 + i, f"the same menu line\n{r[1][: 200 + i]}\n\n the same menu line ", r[2], "menus", 1) for i, r in enumerate(long)]
    extra += [(9200, None, None, None, None), (9201, "", "en", "s", 0), (9202, "!!! 123", "en", "s", 7)]
    return spark.createDataFrame(rows + extra, base.schema)


def test_null_ids_reach_the_end(spark, docs):
    stages = dict(corpus_pipeline.STAGES)
    some = docs.filter("doc_id IS NULL OR doc_id % 3 = 0").cache()
    nulls = lambda df: Counter(r["text"] for r in df.filter("doc_id IS NULL").select("text").collect())
    assert sum(nulls(some).values()) == 6
    for name in ("language_id", "near_dedup"):
        assert sum(nulls(stages[name](spark, some, SF)).values()) == 6
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    want = mixed(rows_of(some), quality)
    got = stages["mixing"](spark, some, SF)
    assert got.columns == list(COLUMNS) and any(r[0] is None for r in want)
    same(rows_of(got), want)
    packed = stages["packing"](spark, got, SF)
    assert packed.filter("doc_id IS NULL AND start = 0").count() == sum(r[0] is None for r in want)


def test_mixing_takes_rows_of_one_id_apart(spark):
    rows = [(7, "a b c", "en", "s", 5), (7, "d e f g", "en", "s", 7), (8, "h", "en", "t", 1), (None, "i j", "en", "t", 3), (None, None, "en", "t", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    same(rows_of(dict(corpus_pipeline.STAGES)["mixing"](spark, df, SF)), mixed(rows, {7: None, **{r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}}))


def test_language_id_keeps_all_but_rejected_rows(spark, docs):
    kept = rows_of(dict(corpus_pipeline.STAGES)["language_id"](spark, docs, SF))
    left, all_rows = Counter(map(repr, kept)), rows_of(docs)
    assert not left - Counter(map(repr, all_rows))
    assert not any(r[0] in (9200, 9201, 9202) for r in kept)
    assert len(kept) >= 0.98 * sum(bool(re.search(r"[^\W\d_]", r[1] or "")) for r in all_rows)


def test_line_dedup_against_brute_force(spark, docs):
    rows = rows_of(docs)
    pages, on = Counter(r[3] for r in rows), Counter()
    trim = lambda x: x.strip(" \t\r\f\x0b")
    for r in rows:
        on.update({(r[3], trim(x)) for x in (r[1] or "").split("\n")})
    often = {k for k, n in on.items() if k[1] and n >= 5 and n > 0.08 * pages[k[0]]}
    assert ("menus", "the same menu line") in often
    want = []
    for i, t, lang, source, _ in rows:
        t = t if t is None else "\n".join(x for x in t.split("\n") if (source, trim(x)) not in often)
        want.append((i, t, lang, source, None if t is None else len(t)))
    same(rows_of(dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, SF)), want)


def test_near_dedup_against_brute_force(spark, docs):
    def bag(text):
        w = (text or "").translate({i: i + 32 for i in range(65, 91)}).encode().split()
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])

    rows = [r for r in rows_of(docs) if r[0] is not None]
    bags, root = {r[0]: bag(r[1]) for r in rows}, {r[0]: r[0] for r in rows}
    for i in bags:
        for j in bags:
            if j < i:
                both = sum((bags[i] & bags[j]).values())
                if both and both / (sum(bags[i].values()) + sum(bags[j].values()) - both) >= 0.8:
                    a, b = root[i], root[j]
                    root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    got = rows_of(dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, SF))
    assert sum(root[i] != i for i in root) >= 4
    same(got, [r for r in rows_of(docs) if r[0] is None or root[r[0]] == r[0]])


def test_mixing_against_brute_force(spark, docs):
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    same(rows_of(dict(corpus_pipeline.STAGES)["mixing"](spark, docs, SF)), mixed(rows_of(docs), quality))


def test_packing_against_brute_force(spark, docs):
    encode, want = packing.encoder(default_tokenizer()).tokenizer.encode, []
    for r in rows_of(docs):
        ids, at = np.array([*encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4"), 0
        while at < len(ids):
            n = 4096 if len(ids) - at >= 4096 else min(1024, len(ids) - at)
            want.append((r[0], at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)))
            at += n
    got = dict(corpus_pipeline.STAGES)["packing"](spark, docs, SF).collect()
    same([(r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got], want)
    windows = defaultdict(list)
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in windows.values():
        ends = np.cumsum([n for _, n in sorted(pieces)]).tolist()
        assert [at for at, _ in sorted(pieces)] == [0, *ends[:-1]] and ends[-1] <= 4096


def test_run_is_its_stages(spark):
    one = rows = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        one = stage(spark, one, SF)
    key = lambda df: Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in df.collect())
    assert rows.count() and key(one) == key(corpus_pipeline.run(spark, SF))


def hard(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and columns of clashing names."""
    line = "the quick brown fox reads one more book about the old town"
    rows = [(i % 7 or None, f"{line}\nand page {i % 5} of it, in plain words", "en", ["s", "t", None][i % 3], 1) for i in range(30)]
    rows += [(50, None, None, None, None), (None, None, None, None, None), (51, "", "en", "s", 0), (52, "short", None, "s", 5), (53, "long words here " * 40_000, "en", "s", None)]
    rows += [(54, "!!! 123", "de", "t", 7)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("id", "size", "hash", "bands", "__lines", "row", "copies", "shard", "length", "site", "score", "held_out", "lang_pred"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_hard_rows_and_empty_tables(spark, name):
    stage, docs = dict(corpus_pipeline.STAGES)[name], hard(spark)
    rows = rows_of(docs)
    got = stage(spark, docs, SF)
    if name == "packing":
        starts = Counter(r["doc_id"] for r in got.filter("start = 0").collect())
        assert starts == Counter(r[0] for r in rows)
    else:
        assert got.columns == list(COLUMNS)
        out = rows_of(got)
        if name == "language_id":
            assert Counter(map(repr, out)) == Counter(repr(r) for r in rows if r[1] and re.search(r"[^\W\d_]", r[1]))
        elif name == "line_dedup":
            assert sorted(map(repr, ((r[0], r[1] is None) for r in out))) == sorted(map(repr, ((r[0], r[1] is None) for r in rows)))
        elif name == "near_dedup":
            # rows that repeat an id are one class; null ids stay, each
            assert sum(r[0] is None for r in out) == sum(r[0] is None for r in rows) and len({r[0] for r in out if r[0]}) == sum(r[0] is not None for r in out)
            assert {r[0] for r in out} >= {1, 50, 51, 52, 53, 54}
        else:
            assert set(map(repr, out)) <= set(map(repr, rows))
    assert stage(spark, docs.limit(0), SF).count() == 0
