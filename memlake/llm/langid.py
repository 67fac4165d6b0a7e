"""Language identification by sparse multinomial logistic regression (operator 10).

Features are TF-IDF weights of character n-grams of one to three letters, hashed into a fixed table.
Document frequencies come from all training documents. The regression is fitted by
follow-the-regularised-leader with elastic-net penalties on a bounded sample of the training
documents (``sample`` a language, those of the smallest seeded hashes; whole texts), a fifth of which is kept
apart to calibrate a temperature. Prediction is a sum of table look-ups over all positions of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ppm import held_out
from .shared import staged

BITS = 16
SAMPLE = 300
CHUNK_CHARS = 400_000
FLAGS = 256  # texts whose features are flagged in a table, of 64 KB each
SCALE = 40.0
UNKNOWN = "und"

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """For every code point: itself if a letter, else 32."""
    global _LETTER
    if _LETTER is None:
        table = np.full(0x110000, 32, np.uint32)
        for a, b in ((0, 0x3400), (0xA000, 0xD7A4), (0xF900, 0x10000), (0x10000, 0x1F000)):
            part = [c if chr(c).isalpha() else 32 for c in range(a, b)]
            table[a:b] = part
        for a, b in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0x20000, 0x323B0)):
            table[a:b] = np.arange(a, b)
        _LETTER = table
    return _LETTER


def features(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows ``lo:hi`` with the hashed n-grams at all positions, the row (from 0) of each, and the letters of each row.

    N-grams have a letter at least, and runs of anything but letters count as one space.
    """
    mask = np.uint32((1 << BITS) - 1)
    table = _letters()
    lo = 0
    while lo < len(texts):
        hi, size, parts = lo, 0, []
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= CHUNK_CHARS):
            parts.append(" " + (texts[hi] or "").lower() + " ")
            size += len(parts[-1])
            hi += 1
        code = table[np.frombuffer("".join(parts).encode("utf-32-le", "replace"), np.uint32)]
        row = np.repeat(np.arange(hi - lo), [len(p) for p in parts])
        letter = code != 32
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] = True
        code, row, letter = code[keep], row[keep], letter[keep]
        n_letters = np.bincount(row[letter], minlength=hi - lo)
        a = code * np.uint32(0x9E3779B1)
        b = (a[:-1] ^ (code[1:] * np.uint32(0x85EBCA77) + np.uint32(0x3C6EF372))) * np.uint32(0xC2B2AE3D)
        c = (b[:-1] ^ (code[2:] * np.uint32(0x27D4EB2F) + np.uint32(0x165667B1))) * np.uint32(0x9E3779B1)
        same2, same3 = row[1:] == row[:-1], row[2:] == row[:-2]
        ids = np.concatenate([a[letter], b[same2], c[same3]])
        rows = np.concatenate([row[letter], row[:-1][same2], row[:-2][same3]])
        yield lo, hi, ((ids >> np.uint32(11)) ^ ids >> np.uint32(3)) & mask, rows, n_letters
        lo = hi


def _documents(folds: int, fold: int):
    """Training documents and the number of them that have each feature, of each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            ids, texts, langs = (batch.column(k).to_pylist() for k in range(3))
            train = ~held_out(ids, folds, fold)
            texts = [t for t, ok, g in zip(texts, train, langs, strict=True) if ok and g is not None and t]
            for lo, hi, ids_, rows, _ in features(texts):
                if hi - lo <= FLAGS:
                    has = np.zeros((hi - lo) << BITS, bool)
                    has[(rows << BITS) | ids_] = True
                    df += has.reshape(hi - lo, -1).sum(0)
                else:  # very many short texts: the same in memory of the features' number
                    df += np.bincount(np.unique((rows << BITS) | ids_) & ((1 << BITS) - 1), minlength=1 << BITS)
                n += hi - lo
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1)), pa.array(np.append(df[k], n))], ["k", "n"])

    return run


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi, ids, rows, _ in features(texts):
            order = np.argsort(rows, kind="stable")
            at = np.searchsorted(rows[order], np.arange(hi - lo + 1))
            for i in range(hi - lo):
                k, c = np.unique(ids[order[at[i] : at[i + 1]]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([langs[lo + i]]), pa.array([k.astype(np.int32).tobytes()], pa.binary()), pa.array([c.astype(np.int32).tobytes()], pa.binary())], ["lang", "k", "c"])


class Regression:
    """Multinomial logistic regression fitted by FTRL-proximal; a temperature divides its logits."""

    def __init__(self, languages: list[str], idf: np.ndarray) -> None:
        self.languages, self.idf, self.temperature = languages, idf, 1.0
        self.weights = np.zeros((len(languages), len(idf)), np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def _rows(self, docs: list[tuple[np.ndarray, np.ndarray]], columns: np.ndarray) -> np.ndarray:
        x = np.zeros((len(docs), len(columns)), np.float32)
        for i, (k, c) in enumerate(docs):
            x[i, np.searchsorted(columns, k)] = SCALE * self.idf[k] * c / max(c.sum(), 1)
        return x

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 42, epochs: int = 8, alpha: float = 0.2, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> None:
        columns = np.unique(np.concatenate([k for k, _ in docs])) if docs else np.zeros(0, np.int64)
        n_lang = len(self.languages)
        z, n = np.zeros((n_lang, len(columns) + 1), np.float32), np.zeros((n_lang, len(columns) + 1), np.float32)
        apart = np.arange(len(docs)) % 5 == 4 if len(docs) >= 5 * n_lang else np.zeros(len(docs), bool)
        train, rng = np.flatnonzero(~apart), np.random.default_rng(seed)
        w = np.zeros_like(z)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(train), max(1, len(train) // 32)):
                own = np.unique(np.concatenate([docs[i][0] for i in part]))  # the other columns have no gradient
                at = np.append(np.searchsorted(columns, own), len(columns))
                x = np.hstack([self._rows([docs[i] for i in part], own), np.ones((len(part), 1), np.float32)])
                was = w[:, at]
                p = self._softmax(x @ was.T)
                p[np.arange(len(part)), y[part]] -= 1
                g = p.T @ x / len(part)
                old = n[:, at]
                grown = old + g * g
                moved = z[:, at] + g - (np.sqrt(grown) - np.sqrt(old)) / alpha * was
                z[:, at], n[:, at] = moved, grown
                w[:, at] = np.where(np.abs(moved) <= l1, 0, -(moved - np.sign(moved) * l1) / ((beta + np.sqrt(grown)) / alpha + l2))
        self.weights[:, columns], self.bias = w[:, :-1], w[:, -1]
        held = np.flatnonzero(apart)
        if len(held):
            logits = np.vstack([self._rows([docs[i]], columns) for i in held]) @ w[:, :-1].T + w[:, -1]
            grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
            loss = [-np.log(self._softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
            self.temperature = float(grid[int(np.argmin(loss))])
        self.table = np.ascontiguousarray(self.weights * self.idf[None, :] * SCALE)

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = [], np.zeros(len(texts))
        for lo, hi, ids, rows, letters in features(texts):
            n = np.maximum(np.bincount(rows, minlength=hi - lo), 1)
            order = np.argsort(rows, kind="stable") if len(rows) else rows
            ids, at = ids[order], np.searchsorted(rows[order], np.arange(hi - lo))
            logits = np.zeros((hi - lo, len(self.languages)))
            full = letters > 0
            for k in range(len(self.languages)):
                if full.any():
                    logits[full, k] = np.add.reduceat(self.table[k][ids], at[full])
            p = self._softmax(((logits / n[:, None]) + self.bias) / self.temperature)
            best = p.argmax(1)
            scores[lo:hi] = np.where(full, p[np.arange(hi - lo), best], 0.0)
            langs += [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, full, strict=True)]
        return langs, scores


def train(docs: DataFrame, folds: int = 4, fold: int = 2, sample: int = SAMPLE, seed: int = 42) -> Regression | None:
    """Fit on the documents whose ``crc32(doc_id as text) mod folds`` is not ``fold`` and that have a ``lang``; None if there are none."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = docs.mapInArrow(_documents(folds, fold), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    df = {r.k: r.n for r in rows}
    total = df.pop(-1, 0)
    if not total:
        return None
    idf = np.full(1 << BITS, np.log((1 + total) / 1) + 1, np.float32)
    idf[list(df)] = np.log((1 + total) / (1 + np.array(list(df.values())))) + 1
    fit = docs.where("lang is not null and text is not null").where(F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds)) != fold)
    sizes = staged(fit.groupBy("lang").agg(F.count("*").alias("n")), "langs")
    at = fit.join(sizes, "lang").withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    near = at.where(F.col("h").cast("double") / 2.0**64 + 0.5 <= F.lit(2.0 * sample) / F.col("n"))  # about twice as many as wanted
    few = near.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("r") <= sample)
    got = sorted(few.select("lang", "text").mapInArrow(_sparse, "lang string, k binary, c binary").toPandas().itertuples(index=False), key=lambda r: (r.lang, r.k, r.c))
    languages = sorted({r.lang for r in got})
    order = np.random.default_rng(seed).permutation(len(got))
    examples = [(np.frombuffer(got[i].k, np.int32), np.frombuffer(got[i].c, np.int32)) for i in order]
    model = Regression(languages, idf)
    model.fit(examples, np.array([languages.index(got[i].lang) for i in order], np.int64))
    return model


def identify(docs: DataFrame, folds: int = 4, fold: int = 2, sample: int = SAMPLE, carried: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs`` (``doc_id, text, lang``): ``doc_id, held_out, lang_pred, score``, and the columns ``carried``.

    Texts that are null or have no letter are ``und`` with score 0, as is every text if no document has a ``lang``
    to learn from. Equal texts get equal predictions and repeated rows are told each; an empty table gives no rows; every value
    of ``lang`` is learned (each takes 0.3 MB of the model, and 0.8 MB more while it is fitted); other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, folds, fold, sample))
    rest = [c for c in carried if c not in ("doc_id", "text")]
    more = [c for c in carried if c != "doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            known = model.value
            langs, scores = known.predict(batch.column(1).to_pylist()) if known and known.languages else ([UNKNOWN] * len(ids), np.zeros(len(ids)))
            found = [ids, pa.array(held_out(ids.to_pylist(), folds, fold)), pa.array(langs, pa.string()), pa.array(scores)]
            yield pa.RecordBatch.from_arrays([*found, *(batch.column(c) for c in more)], ["doc_id", "held_out", "lang_pred", "score", *more])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *rest)
    kinds = "".join(f", `{c}` {read.schema[c].dataType.simpleString()}" for c in more)
    return read.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double" + kinds)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, by ``identify``."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
