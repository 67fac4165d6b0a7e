"""Language-model scores by prediction by partial matching over bytes (operator 3).

The trie holds the byte contexts of up to ORDER bytes of the training texts with the counts of the
bytes that followed. A byte is coded in the longest context that the trie has; a byte not seen there
costs an escape (method D: distinct / (2 * total)) and is coded one byte shorter with the
symbols already ruled out excluded from the counts, down to a uniform choice among the bytes never
seen. A text's code ends with an end symbol, so scores of finished texts form a distribution.

No context is left out, however large the corpus, and no task or broadcast holds the trie. Texts are dealt to chunks.
A gram is a context, last byte first, and the byte after it; a chunk's distinct grams, sorted, packed and
compressed, go to shards that are ranges of grams, cut at quantiles of a sample (which decides balance, never results),
so a frequent ending is cut as finely as it takes. All contexts but those that a cut runs through lie whole in one shard.
Shards first report the counts of the few contexts at their two cuts; these are summed up, and then every shard prices its
grams and sends the prices back to the chunks. Words for the unigram baseline go the same way, in buckets of word keys,
and come back with their counts; a chunk sends a word once, so no frequent word can dominate a bucket.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import LOWER, chunks, in_groups, mixed, ranges, word_keys, words
from .shared import staged

ORDER = 6  # 7 at most: a gram is a 64-bit key
END = 0xFF  # never a byte of UTF-8
#: Bytes of text of a chunk, of those that one shard of grams and one bucket of words stand for, and texts of a chunk.
CHUNK_TEXT, SHARD_TEXT, CHUNK_ROWS = 1 << 24, 1 << 23, 1 << 20
PIECE = 1 << 20  # bytes of text looked at at once
UNIT = 2.0**20  # prices of bytes travel and are summed up in whole parts of this
SAMPLE_TEXT, SAMPLE_KEYS = 1 << 13, 64  # sampled bytes of text and grams for each shard
GRAMS, WORDS, TEXTS = range(3)
PACKED = pa.schema([("kind", pa.int8()), ("chunk", pa.int64()), ("shard", pa.int32()), ("n", pa.int64()), ("body", pa.binary())])


def held_out(ids: list, folds: int, fold: int) -> np.ndarray:
    """Whether ``crc32(id as text) mod folds`` is ``fold``; a null id counts as the empty text."""
    return np.array([zlib.crc32(b"" if x is None else str(x).encode()) % folds == fold for x in ids], bool)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit values, their bytes in planes, compressed."""
    head = np.array([len(arrays), *map(len, arrays)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays))


def unpack(body: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(body)
    sizes = np.frombuffer(data, "<i8", int(np.frombuffer(data, "<i8", 1)[0]), 8).tolist()
    at, out = 8 + 8 * len(sizes), []
    for n in sizes:
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n).T).view(np.uint64).ravel())
        at += 8 * n
    return out


def _steps(sorted_: np.ndarray) -> np.ndarray:
    return np.diff(sorted_, prepend=np.uint64(0))


def grams_of(buf: np.ndarray, offs: np.ndarray, order: int) -> np.ndarray:
    """The gram at every byte and end of the texts: the ``order`` bytes before, last first in the high bits, and the byte."""
    lens = np.diff(offs)
    at = np.cumsum(lens + order + 1) - (lens + order + 1)
    s = np.full(int(lens.sum()) + (order + 1) * len(lens), END, np.uint8)  # each text between `order` end symbols and one
    s[ranges(at + order, lens)] = buf
    if len(s) <= order:
        return np.zeros(0, np.uint64)
    x = np.zeros(len(s) - order, np.uint64)
    for back in [*range(1, order + 1), 0]:
        x = (x << np.uint64(8)) | s[order - back : len(s) - back]
    keep = np.ones(len(x), bool)
    keep[(at[1:, None] - np.arange(1, order + 1)[None, :]).ravel()] = False
    return x[keep]


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[cut], np.add.reduceat(counts[order], cut)


class _Tally:
    """Counts of 64-bit keys, compacted as they grow."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size, self.last = 0, 0

    def add(self, keys: np.ndarray, counted: bool) -> None:
        """Count the keys, or only take note of them."""
        if len(keys):
            keys.sort()
            cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.parts.append((keys[cut], np.diff(np.append(cut, len(keys))).astype(np.int32) if counted else np.zeros(len(cut), np.int32)))
            self.size += len(cut)
            if self.size > self.last + 1_500_000:
                self.compact()

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate([np.zeros(0, t), *x]) for t, x in zip((np.uint64, np.int32), zip(*self.parts, strict=True) if self.parts else ((), ()), strict=True))
        self.parts = []
        keys, counts = _summed(keys, counts)
        self.parts, self.size, self.last = [(keys, counts)], len(keys), len(keys)
        return keys, counts


def _split(folds: int, fold: int, order: int, chunk_text: int, cuts, buckets: int):
    """Texts dealt to chunks, and each chunk's distinct grams by shard and words by bucket with their counts in training texts."""

    def row(kind: int, chunk: int, shard: int, n: int, body: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((kind, chunk, shard, n, body), PACKED.types, strict=True)], schema=PACKED)

    def finish(chunk: int, seen: _Tally, vocab: list) -> Iterator[pa.RecordBatch]:
        keys, counts = seen.compact()
        at = [0, *np.searchsorted(keys, cuts.value).tolist(), len(keys)]
        for shard, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            if b > a:
                yield row(GRAMS, chunk, shard, b - a, pack(_steps(keys[a:b]), counts[a:b].astype(np.int64)))
        if vocab:
            lo, hi, n = (np.concatenate(x) for x in zip(*vocab, strict=True))
            o, cut = in_groups(lo, hi)
            lo, hi, n = lo[o][cut], hi[o][cut], np.add.reduceat(n[o], cut)
            bucket = (mixed(lo, hi, 1) >> np.uint64(32)) % np.uint64(buckets)
            o = np.lexsort((lo, hi, bucket))
            lo, hi, n, bucket = lo[o], hi[o], n[o], bucket[o]
            at = np.searchsorted(bucket, np.arange(buckets + 1).astype(np.uint64)).tolist()
            for b in range(buckets):
                if at[b + 1] > at[b]:
                    own = slice(at[b], at[b + 1])
                    yield row(WORDS, chunk, b, at[b + 1] - at[b], pack(lo[own], _steps(hi[own]), n[own]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, vocab = _Tally(), []
        chunk, rows, size = TaskContext.get().partitionId() << 24, 0, 0
        for batch in batches:
            train = ~held_out(batch.column(0).to_pylist(), folds, fold)
            for a, b, buf, offs in chunks(batch.column(1), PIECE):
                if rows and (size + len(buf) > chunk_text or rows + b - a > CHUNK_ROWS):
                    yield from finish(chunk, seen, vocab)
                    seen, vocab = _Tally(), []
                    chunk, rows, size = chunk + 1, 0, 0
                rows, size = rows + b - a, size + len(buf)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                    out.write_batch(batch.slice(a, b - a))
                own = train[a:b]
                yield row(TEXTS, chunk, 0, int(own.sum()), sink.getvalue().to_pybytes())
                low = LOWER[buf]
                starts, ends, bounds = words(low, offs)
                lo, hi = word_keys(low, starts, ends)
                o, cut = in_groups(lo, hi)
                if len(cut):
                    vocab.append((lo[o][cut], hi[o][cut], np.add.reduceat(np.repeat(own, np.diff(bounds))[o].astype(np.int64), cut)))
                grams, of_train = grams_of(low, offs, order), np.repeat(own, np.diff(offs) + 1)
                seen.add(grams[of_train], True)
                seen.add(grams[~of_train], False)
        if rows:
            yield from finish(chunk, seen, vocab)

    return run


def _sampled(order: int, one_of: int):
    """Of the texts' distinct grams those whose mixed value is divisible by ``one_of``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offs in chunks(batch.column(0), PIECE):
                keys = np.unique(grams_of(LOWER[buf], offs, order))
                yield pa.RecordBatch.from_arrays([pa.array(keys[mixed(keys, keys) % np.uint64(one_of) == 0].view(np.int64))], ["key"])

    return run


def _find(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``x`` is in ``sorted_``, and whether it is."""
    if not len(sorted_):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return at, sorted_[at] == x


def _cell(grams: np.ndarray, order: int, k: int) -> np.ndarray:
    """The last ``k`` bytes of the contexts and the byte after."""
    context = grams >> np.uint64(8 * (order + 1 - k)) if k else np.zeros(len(grams), np.uint64)
    return (context << np.uint64(8)) | (grams & np.uint64(0xFF))


class _Level:
    """Contexts of one length: their symbols' counts, totals and distinct symbols; and what the shorter context has besides."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray, up: _Level | None) -> None:
        self.cells, self.counts = cells, counts
        owner = cells >> np.uint64(8)
        cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(cells) else np.zeros(0, np.int64)
        self.contexts = owner[cut]
        self.distinct = np.diff(np.append(cut, len(cells)))
        self.total = np.add.reduceat(counts, cut) if len(cut) else np.zeros(0, np.int64)
        if up is not None and len(cut):
            shared = up.counts[_find(up.cells, ((owner >> np.uint64(8)) << np.uint64(8)) | (cells & np.uint64(0xFF)))[0]]
            at = _find(up.contexts, self.contexts >> np.uint64(8))[0]
            self.left = up.total[at] - np.add.reduceat(shared, cut)
            self.kinds = up.distinct[at] - self.distinct


def _own_cells(keys: np.ndarray, counts: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The cells of all context lengths, from 0, with their counts, of sorted distinct grams."""
    out = [(keys, counts)]
    for k in range(order - 1, -1, -1):
        cells, n = out[0]
        shorter = ((cells >> np.uint64(16)) << np.uint64(8)) | (cells & np.uint64(0xFF)) if k else cells & np.uint64(0xFF)
        out.insert(0, _summed(shorter, n))
    return out


def levels_of(keys: np.ndarray, counts: np.ndarray, order: int, cut: dict[int, dict[int, tuple[list[int], list[int]]]]) -> list[_Level]:
    """Levels 0 to ``order`` of sorted distinct grams; contexts in ``cut`` (by length) have the symbols and counts given there instead."""
    out: list[_Level] = []
    for k, (cells, n) in enumerate(_own_cells(keys, counts, order)):
        if given := cut.get(k):
            whole = ~np.isin(cells >> np.uint64(8), np.array(list(given), np.uint64))
            more = [np.array(s, np.uint64) | np.uint64(c << 8) for c, (s, _) in given.items()]
            cells = np.concatenate([cells[whole], *more])
            n = np.concatenate([n[whole], *(np.array(x, np.int64) for _, x in given.values())])
            o = np.argsort(cells, kind="stable")
            cells, n = cells[o], n[o]
        out.append(_Level(cells, n, out[-1] if k else None))
    return out


def log_probabilities(grams: np.ndarray, levels: list[_Level]) -> np.ndarray:
    """Log10 probability of the byte of each gram after its context."""
    order = len(levels) - 1
    log = lambda x: np.log10(np.maximum(x, 1))
    best = rest = np.full(len(grams), -math.log10(max(257 - len(levels[0].cells), 1)))
    before = np.zeros(len(grams), np.int64)
    for k, level in enumerate(levels):
        cells = _cell(grams, order, k)
        at, has = _find(level.contexts, cells >> np.uint64(8))
        if not has.any():
            break
        cell, seen = _find(level.cells, cells)
        n = np.where(seen, level.counts[cell], 0)
        if k:  # symbols of this context are ruled out in the shorter one
            left = log(2 * level.left[at])
            rest = np.where(before > 0, log(2 * before - 1) - left, np.where(level.kinds[at] > 0, log(level.kinds[at]) - left, 0.0) + rest)
        own = np.where(seen, log(2 * n - 1), log(level.distinct[at]) + rest) - log(2 * level.total[at])
        best, before = np.where(has, own, best), n
    return best


def _merged(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The grams of each chunk, and of all of them the distinct ones and their counts."""
    got = [unpack(x) for x in table.column("body").to_pylist()]
    own = [np.cumsum(steps, dtype=np.uint64) for steps, _ in got]
    return own, *_summed(np.concatenate(own), np.concatenate([n.view(np.int64) for _, n in got]))


def _at_cuts(order: int, cuts):
    """Of a shard the own counts of the contexts, of each length, that its lower and upper cut run through."""
    schema = pa.schema([("shard", pa.int32()), ("k", pa.int32()), ("context", pa.int64()), ("symbols", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        _, keys, n = _merged(table)
        ends = np.concatenate([[np.uint64(0)], cuts.value, [np.uint64(0xFFFFFFFFFFFFFFFF >> (8 * (7 - order)))]])[shard : shard + 2].astype(np.uint64)
        rows = []
        for k, (cells, count) in enumerate(_own_cells(keys[n > 0], n[n > 0], order)):
            for context in sorted(set((_cell(ends, order, k) >> np.uint64(8)).tolist())):
                a, b = np.searchsorted(cells, np.array([context << 8, (context << 8) | 0xFF], np.uint64))
                b += b < len(cells) and cells[b] == (context << 8) | 0xFF
                rows.append({"shard": shard, "k": k, "context": context, "symbols": (cells[a:b] & np.uint64(0xFF)).astype(np.int32).tolist(), "counts": count[a:b].tolist()})
        return pa.Table.from_pylist(rows, schema=schema)

    return run, "shard int, k int, context long, symbols array<int>, counts array<long>"


def _priced(order: int):
    def run(table: pa.Table, cut: pa.Table) -> pa.Table:
        own, keys, n = _merged(table)
        given: dict[int, dict[int, tuple[list[int], list[int]]]] = {}
        for r in cut.to_pylist():
            given.setdefault(r["k"], {})[r["context"]] = [x["symbol"] for x in r["cells"] or ()], [x["n"] for x in r["cells"] or ()]
        prices = np.rint(log_probabilities(keys, levels_of(keys[n > 0], n[n > 0], order, given)) * -UNIT).astype(np.int64)
        bodies = []
        for x in own:
            bodies.append(pack(_steps(x), prices[np.searchsorted(keys, x)]))
        return pa.table({"kind": pa.array([GRAMS] * len(own), pa.int8()), "chunk": table.column("chunk"), "body": pa.array(bodies, pa.binary())})

    return run


def _counted(table: pa.Table) -> pa.Table:
    """The words of one bucket go back to the chunks with their counts; how many words and tokens of training texts there are."""
    got = [unpack(x) for x in table.column("body").to_pylist()]
    los, his = [lo for lo, _, _ in got], [np.cumsum(hi, dtype=np.uint64) for _, hi, _ in got]
    n = np.concatenate([n.view(np.int64) for _, _, n in got])
    o, cut = in_groups(np.concatenate(los), np.concatenate(his))
    total = np.add.reduceat(n[o], cut)
    each = np.empty(len(o), np.int64)
    each[o] = np.repeat(total, np.diff(np.append(cut, len(o))))
    at = np.cumsum([0, *map(len, los)]).tolist()
    bodies = [pack(lo, _steps(hi), each[a:b]) for lo, hi, a, b in zip(los, his, at[:-1], at[1:], strict=True)]
    rest = [0] * (len(bodies) - 1)
    return pa.table({"kind": pa.array([WORDS] * len(bodies), pa.int8()), "chunk": table.column("chunk"), "body": pa.array(bodies, pa.binary()), "distinct": pa.array([int((total > 0).sum()), *rest], pa.int64()), "tokens": pa.array([int(total.sum()), *rest], pa.int64())})


def _scored(order: int, folds: int, fold: int):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        kinds, bodies = answers.column("kind").to_pylist(), answers.column("body")
        of = lambda kind: [unpack(bodies[i].as_py()) for i, k in enumerate(kinds) if k == kind]
        words_, grams_ = of(WORDS), of(GRAMS)
        lo, hi, n = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (([w[0] for w in words_]), ([np.cumsum(w[1], dtype=np.uint64) for w in words_]), ([w[2] for w in words_])))
        n = n.view(np.int64)
        salt = 2
        while len(vocab := pd.Index(mixed(lo, hi, salt).view(np.int64))) and not vocab.is_unique:  # all words asked for are among these, so unlike values tell them apart
            salt += 1
        index = pd.Index(np.concatenate([np.zeros(0, np.uint64), *(np.cumsum(g[0], dtype=np.uint64) for g in grams_)]).view(np.int64))
        price = np.concatenate([np.zeros(0, np.int64), *(g[1].view(np.int64) for g in grams_)])
        parts = []
        for body in texts.column("body"):
            got = pa.ipc.open_stream(body.as_buffer()).read_all()
            ids, out = got.column(0).combine_chunks(), held_out(got.column(0).to_pylist(), folds, fold)
            for a, b, buf, offs in chunks(got.column(1), PIECE):
                low = LOWER[buf]
                starts, ends, bounds = words(low, offs)
                doc = np.repeat(np.arange(b - a), np.diff(bounds))
                count = n[vocab.get_indexer(mixed(*word_keys(low, starts, ends), salt).view(np.int64))] if len(doc) else np.zeros(0, np.int64)
                known = np.bincount(doc[count > 0], minlength=b - a).astype(np.int64)
                base = np.bincount(doc, np.log10(count + 0.1), minlength=b - a)
                each = price[index.get_indexer(grams_of(low, offs, order).view(np.int64))]
                score = np.add.reduceat(each, offs[:-1] + np.arange(b - a))
                parts.append(pa.RecordBatch.from_arrays([ids.slice(a, b - a).cast(pa.int64()), pa.array(out[a:b]), pa.array(np.diff(bounds) + 1), pa.array(known), pa.array(base), pa.array(score / -UNIT)], schema=schema))
        return pa.Table.from_batches(parts, schema=schema)

    return run, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"


def _quantiles(docs: DataFrame, order: int, size: int, shards: int) -> np.ndarray:
    """Cuts between ``shards`` ranges of grams, from a sample of about SAMPLE_KEYS grams a shard."""
    share = min(1.0, max(shards * SAMPLE_TEXT, 1 << 20) / max(size, 1))
    one_of = max(1, int(size * share) // (4 * SAMPLE_KEYS * shards))
    keys = docs.where(F.rand(5) < share).select("text").mapInArrow(_sampled(order, one_of), "key long").toArrow().column("key").to_numpy().astype(np.uint64)
    keys = np.sort(keys)
    return np.unique(keys[np.arange(1, shards) * len(keys) // shards]) if len(keys) >= shards else keys[:0]


def ppm_scores(docs: DataFrame, folds: int = 10, fold: int = 0, chunk_text: int = CHUNK_TEXT, shard_text: int = SHARD_TEXT, order: int = ORDER) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Rows with ``crc32(doc_id as text) mod folds = fold`` are held out of training. Null and empty texts
    have one token, the end; equal texts score alike; with nothing to learn from, every byte is uniform
    over 257 symbols; an empty table gives no rows; other columns are not read. A word of any length is one word:
    up to 15 bytes it is its own key, beyond its 120-bit hash is. Scores do not depend on ``chunk_text`` (bytes of a chunk) or ``shard_text``.
    """
    if not 1 <= order <= 7:
        raise ValueError("order must be 1 to 7")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    shards = max(8, -(-size // shard_text))
    sc = docs.sparkSession.sparkContext
    cuts = sc.broadcast(_quantiles(docs, order, size, shards))
    split = staged(docs.mapInArrow(_split(folds, fold, order, chunk_text, cuts, shards), "kind byte, chunk long, shard int, n long, body binary"), "split")
    of = lambda kind: split.where(F.col("kind") == kind)
    grams = of(GRAMS).select("chunk", "shard", "body")
    run, schema = _at_cuts(order, cuts)
    at_cuts = staged(grams.groupBy("shard").applyInArrow(run, schema), "cuts")
    cells = at_cuts.select("k", "context", F.explode(F.arrays_zip("symbols", "counts")).alias("x")).groupBy("k", "context", F.col("x.symbols").alias("symbol")).agg(F.sum("x.counts").alias("n"))
    cells = cells.groupBy("k", "context").agg(F.collect_list(F.struct("symbol", "n")).alias("cells"))  # 256 at most
    needed = at_cuts.select("shard", "k", "context").join(cells, ["k", "context"], "left")
    counted = staged(of(WORDS).select("chunk", "shard", "body").groupBy("shard").applyInArrow(_counted, "kind byte, chunk long, body binary, distinct long, tokens long"), "words")
    distinct, tokens = counted.agg(F.coalesce(F.sum("distinct"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    ends = of(TEXTS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # one end a training text
    total, distinct = tokens + ends, distinct + (ends > 0)
    priced = grams.groupBy("shard").cogroup(needed.groupBy("shard")).applyInArrow(_priced(order), "kind byte, chunk long, body binary")
    answers = priced.union(counted.select("kind", "chunk", "body")).withColumnRenamed("chunk", "of")
    run, schema = _scored(order, folds, fold)
    each = of(TEXTS).select("chunk", "body").groupBy("chunk").cogroup(answers.groupBy("of")).applyInArrow(run, schema)
    denominator, end = math.log10(total + 0.1 * (distinct + 1)), math.log10(ends + 0.1)
    return each.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + end - F.col("n_tokens") * denominator).alias("base_score"),
        "score",
    )


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``; null texts are empty, repeated rows are scored each, see ``ppm_scores``."""
    return ppm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
