"""Language identification by error-correcting output codes.

Languages get codewords; for each bit one linear classifier over hashed character
n-grams tells the languages with a 1 from those with a 0.  A text gets the language
whose codeword has the least loss, each bit weighted by how well its classifier did
in training; if a second codeword is about as near, the row is flagged ambiguous.

Scale.  Training looks at a bounded number of labelled rows (``LanguageModel.fit``:
``rows_per_language`` and ``most_rows``); their n-gram counts are made on the executors,
and one task learns from them, so the driver sees the finished weights only.  Prediction is one row-local pass over the texts without a shuffle, in
slices of bounded memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 11
ROWS_PER_LANGUAGE = 1000
MOST_ROWS = 8000
RIDGE = 1e-3
#: Score of the best language less that of the second below which a row is ambiguous.
MARGIN = 0.05
#: Bytes of a text that are looked at together; the next slice overlaps by two.
SLICE = 1 << 20

# One table for bytes: ASCII that is no letter is a space, other bytes stay.
_FOLD = np.array([b if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint32)


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def ngram_counts(text: str, bits: int = BITS) -> np.ndarray:
    """Counts of the hashed 2- and 3-grams of bytes of the lower-cased text."""
    size, counts = 1 << bits, np.zeros(1 << bits, np.float64)
    data = b" " + text.lower().encode("utf-8", "replace") + b" "
    shift = np.uint32(32 - bits)
    for at in range(0, len(data) - 2, SLICE - 2):
        x = _FOLD[np.frombuffer(data, np.uint8, min(SLICE, len(data) - at), at)]
        if len(x) < 3:
            continue
        two = x[:-2] * np.uint32(256) + x[1:-1]
        three = two * np.uint32(256) + x[2:]
        # runs of spaces say nothing
        three = three[three != 0x202020]
        for codes, odd in ((two, 2654435761), (three, 2246822519)):
            counts += np.bincount((codes * np.uint32(odd)) >> shift, minlength=size)[:size]
    return counts


def profile(text: str, bits: int = BITS) -> np.ndarray:
    """Square roots of the shares of the n-grams: a vector of length 1."""
    counts = ngram_counts(text, bits)
    return np.sqrt(counts / max(counts.sum(), 1.0)).astype(np.float32)


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """A row of -1 and 1 for each language.

    Up to five languages get the exhaustive code (every way to split them once), more
    the random code, of 200, whose nearest rows are farthest apart.
    """
    if languages <= 5:
        splits = range(1 << (languages - 1), (1 << languages) - 1)
        return np.array([[1 if s >> (languages - 1 - i) & 1 else -1 for s in splits] for i in range(languages)]).reshape(languages, -1)
    length, rng = math.ceil(10 * math.log2(languages)), np.random.default_rng(seed)
    best, apart = None, -1
    for _ in range(200):
        code = rng.choice([-1, 1], (languages, length))
        nearest = ((length - code @ code.T) // 2 + length * np.eye(languages, dtype=int)).min()
        if nearest > apart and (np.abs(code.sum(axis=0)) < languages).all():
            best, apart = code, nearest
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bit_weights: np.ndarray
    bits: int

    @staticmethod
    def fit(
        docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        rows_per_language: int = ROWS_PER_LANGUAGE, most_rows: int = MOST_ROWS, bits: int = BITS,
    ) -> LanguageModel:
        """Learn from at most ``rows_per_language`` rows a language, ``most_rows`` in all.

        Rows with a null language or text are left out.  Rows are taken by a hash of
        the id, so reruns learn the same.  Without any row the model knows no language.
        """
        rows = docs.select(
            F.col(lang_col).cast("string").alias("lang"),
            F.col(text_col).cast("string").alias("text"),
            F.xxhash64(F.col(id_col).cast("string"), F.lit(bits)).alias("h"),
        ).filter("lang IS NOT NULL AND text IS NOT NULL")
        found = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect())
        if not found:
            return LanguageModel([], np.zeros((0, 0)), np.zeros((1 << bits, 0)), np.zeros(0), bits)
        cap = max(1, min(rows_per_language, most_rows // len(found)))
        chance = F.create_map(*(F.lit(x) for lang, n in found for x in (lang, min(1.0, cap / n))))
        picked = rows.filter((F.pmod("h", F.lit(1 << 30)) / float(1 << 30)) < chance[F.col("lang")])

        def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [profile(t, bits).astype("<f2").tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.binary())], ["lang", "h", "x"])

        names = [lang for lang, _ in found]
        code = codewords(len(names))

        def learn(sample: pd.DataFrame) -> pd.DataFrame:
            """Ridge regression of each bit, the languages weighing alike."""
            sample = sample.sort_values(["h", "lang"], kind="stable")
            place = np.array([names.index(x) for x in sample["lang"]], dtype=int)
            x = np.frombuffer(b"".join(sample["x"]), "<f2").reshape(len(place), 1 << bits)
            w = 1.0 / np.bincount(place, minlength=len(names)).clip(1)[place] / len(names)
            gram, aim = RIDGE * np.eye(1 << bits), np.zeros((1 << bits, code.shape[1]))
            for at in range(0, len(place), 1024):
                part = x[at : at + 1024].astype(np.float64)
                weighed = part * w[at : at + 1024, None]
                gram += part.T @ weighed
                aim += weighed.T @ code[place[at : at + 1024]]
            weights = np.linalg.solve(gram, aim)
            right = np.zeros(code.shape[1])
            for at in range(0, len(place), 1024):
                lot = slice(at, at + 1024)
                right += (((x[lot].astype(np.float64) @ weights) * code[place[lot]] > 0) * w[lot, None]).sum(axis=0)
            return pd.DataFrame({"weights": [weights.tobytes()], "bit_weights": [right.clip(0.05).tobytes()]})

        # Twice the rows aimed at are a bound even if ids repeat, so one task can learn from
        # them; only the weights leave it.
        sample = picked.mapInArrow(profiles, "lang string, h long, x binary")
        nth = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
        sample = sample.withColumn("nth", nth).filter(F.col("nth") <= 2 * cap).withColumn("all", F.lit(0))
        learned = sample.groupBy("all").applyInPandas(learn, "weights binary, bit_weights binary").collect()
        if not learned:
            return LanguageModel(names, code, np.zeros((1 << bits, code.shape[1])), np.full(code.shape[1], 0.05), bits)
        weights = np.frombuffer(learned[0]["weights"]).reshape(1 << bits, -1)
        return LanguageModel(names, code, weights, np.frombuffer(learned[0]["bit_weights"]), bits)

    def scores(self, text: str) -> np.ndarray:
        """A score for each language; they sum to 1."""
        margins = profile(text, self.bits).astype(float) @ self.weights
        loss = (np.exp(-2.0 * margins * self.code) * self.bit_weights).sum(axis=1) / max(self.bit_weights.sum(), 1e-9)
        rank = np.exp(-4.0 * (loss - loss.min()))
        return rank / rank.sum()


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns of ``keep``, ``lang_pred``, ``score`` and ``ambiguous``.

    The score is the share of the predicted language among all learned ones, 0 to 1.
    A text that is null or has no letter is ``und`` with score 0 and not ambiguous; so
    is every text if the model knows no language.  Rows are judged one by one, whole
    texts of any length; an empty table gives an empty result, and other columns of
    the input are not read.
    """
    fields = [docs.schema[id_col], *(docs.schema[c] for c in keep)]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, best, unsure = [], [], []
            for text in batch.column(len(fields)):
                text = text.as_py()
                if not model.languages or not has_letter(text):
                    langs.append("und")
                    best.append(0.0)
                    unsure.append(False)
                    continue
                scores = model.scores(text)
                first = int(scores.argmax())
                rest = np.delete(scores, first)
                langs.append(model.languages[first])
                best.append(float(scores[first]))
                unsure.append(bool(len(rest) and scores[first] - rest.max() < MARGIN))
            columns = [batch.column(i) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(langs), pa.array(best, pa.float64()), pa.array(unsure, pa.bool_())],
                [*(f.name for f in fields), "lang_pred", "score", "ambiguous"],
            )

    rows = docs.select(*(F.col(f.name) for f in fields), F.col(text_col).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"{shape}, lang_pred string, score double, ambiguous boolean")
