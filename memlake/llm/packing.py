"""Bound-certified best-fit packing of tokenised texts into sequences (operator 1).

Pieces are dealt to partitions of a few thousand. Each partition runs best-fit decreasing and computes
lower bounds from dual-feasible functions; bins that meet the bound are certified optimal. A partition's
loose bins (the emptiest, and a quarter of all where the bound is not met) give their documents back,
and these are exchanged: dealt to fewer, new partitions that rerun best-fit decreasing, until
one partition holds what is left. So waste is counted per corpus, not per partition.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import LOWER, SHORT, chunks, mixed, ranges, word_keys, words
from .shared import staged

CAPACITY = 4096
END_ID = 1
PARTITION_PIECES = 4096
#: New words go to the tokenizer so many at a time, with this character between them.
GROUP_WORDS, MARK = 64, "\x01"


class WordEncoder:
    """Token ids of whole texts for a tokenizer that drops white space, so that words can be encoded apart.

    Each distinct word is given to the tokenizer once per worker; texts are put together from the words' ids.
    """

    def __init__(self, path: str, most: int = 2_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.most = most
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        if ids("ab \n cd,e") != ids("ab") + ids("cd,e"):
            raise ValueError("this tokenizer does not encode words apart")
        mark = ids(MARK)
        self.mark = mark[0] if len(mark) == 1 and ids(f"ab {MARK} cd") == [*ids("ab"), *mark, *ids("cd")] else None
        self.fold = LOWER if all(ids(chr(c)) == ids(chr(c + 32)) for c in range(65, 91)) else np.arange(256, dtype=np.uint8)
        self.clear()

    def clear(self) -> None:
        self.mix, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.lo, self.hi, self.long = np.zeros(0, np.uint64), np.zeros(0, np.uint64), {}
        self.at, self.flat, self.odd = np.zeros(1, np.int64), np.zeros(0, np.uint32), {}

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, texts: list[bytes]) -> np.ndarray:
        """Slots of new words. A group whose words hold the mark themselves is told by its count of marks, and encoded word by word."""
        groups = [texts[k : k + GROUP_WORDS] for k in range(0, len(texts), GROUP_WORDS)]
        flats, sizes, between = [self.flat], [], f" {MARK} ".encode()
        joined = self._ids([between.join(g).decode("utf-8", "replace") for g in groups]) if self.mark is not None else [[]] * len(groups)
        for group, ids in zip(groups, joined, strict=True):
            flat = np.array(ids, np.uint32)
            marks = flat == self.mark
            at = np.flatnonzero(marks)
            if self.mark is not None and len(at) == len(group) - 1:
                flats.append(flat[~marks])
                sizes.append(np.diff(at, prepend=-1, append=len(flat)) - 1)
            else:
                got = self._ids([t.decode("utf-8", "replace") for t in group])
                flats.append(np.array([x for word in got for x in word], np.uint32))
                sizes.append(np.array([len(word) for word in got], np.int64))
        slots = len(self.at) - 1 + np.arange(len(texts))
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(np.concatenate(sizes))])
        self.flat = np.concatenate(flats)
        return slots

    def _known(self, mix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each is or would be in the sorted table, and whether it is there."""
        i, order = np.empty(len(mix), np.int64), np.argsort(mix)
        i[order] = np.searchsorted(self.mix, mix[order])  # in order, neighbours share what they read of the table
        return i, np.append(self.mix, np.uint64(0))[i] == mix if len(self.mix) else np.zeros(len(mix), bool)

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a chunk one after another, and ``len(offs)`` bounds.

        Words are looked up by a hash, and every hit is confirmed by the word itself: its key up to SHORT bytes, its bytes beyond.
        """
        low = self.fold[buf]
        starts, ends, bounds = words(low, offs)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        if len(self.mix) + len(self.odd) > self.most:
            self.clear()
        lo, hi = word_keys(low, starts, ends)
        codes, uniq = pd.factorize(mixed(lo, hi).view(np.int64))
        uniq = uniq.view(np.uint64)
        first = np.zeros(len(uniq), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        data = low.tobytes()
        word = lambda t: data[starts[t] : ends[t]]
        i, hit = self._known(uniq)
        if not hit.all():
            new = np.flatnonzero(~hit)
            slots = self._learn([word(t) for t in first[new].tolist()])
            order = np.argsort(uniq[new])
            where = i[new][order]
            for name, value in (("mix", uniq[new]), ("slot", slots), ("lo", lo[first[new]]), ("hi", hi[first[new]])):
                setattr(self, name, np.insert(getattr(self, name), where, value[order]))
            self.long |= {int(s): word(t) for s, t in zip(slots, first[new].tolist(), strict=True) if ends[t] - starts[t] > SHORT}
            i += np.searchsorted(where, i, "right")  # moved by the words put in before
            i[new[order]] = where + np.arange(len(new))
        lo1, hi1 = lo[first], hi[first]
        other = (self.lo[i] != lo1) | (self.hi[i] != hi1)
        for u in np.flatnonzero(~other & (ends[first] - starts[first] > SHORT)).tolist():
            other[u] = self.long[int(self.slot[i[u]])] != word(first[u])
        slot = self.slot[i][codes]
        odd = (lo1[codes] != lo) | (hi1[codes] != hi) | other[codes]
        for t in np.flatnonzero(~odd & (ends - starts > SHORT)).tolist():
            odd[t] = word(t) != word(first[codes[t]])
        for t in np.flatnonzero(odd).tolist():  # another word of the same hash
            if word(t) not in self.odd:
                self.odd[word(t)] = int(self._learn([word(t)])[0])
            slot[t] = self.odd[word(t)]
        source = self.at[slot]
        sizes = self.at[slot + 1] - source
        ends_at = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[ranges(source, sizes)], ends_at[bounds]


_ENCODERS: dict[str, WordEncoder] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every text, cut only where longer than ``capacity``.

    A text's ids end with END_ID; null and empty texts are one piece of that id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault(tokenizer, None) or _ENCODERS.__setitem__(tokenizer, WordEncoder(tokenizer)) or _ENCODERS[tokenizer]
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, offs in chunks(batch.column(1)):
                flat, bounds = encoder.encode(buf, offs)
                size = np.diff(bounds)
                n = -(-(size + 1) // capacity)
                row = np.repeat(np.arange(hi - lo), n)
                piece = ranges(np.zeros(hi - lo, np.int64), n)
                start = piece * capacity
                length = np.minimum(size[row] + 1 - start, capacity)
                out = np.full(len(flat) + hi - lo, END_ID, "<u4")
                at = bounds[:-1] + np.arange(hi - lo)
                out[ranges(at, size)] = flat
                data, first = out.tobytes(), (at[row] + start) * 4
                crc = [zlib.crc32(data[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist(), strict=True)]
                columns = [ids.slice(lo, hi - lo).take(pa.array(row)).cast(pa.int64()), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(np.cumsum(length) - length, length.sum()).astype(np.int32)), pa.array(out[ranges(at[row] + start, length)].astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of several dual-feasible bounds on the number of bins."""
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    total = int((count * size).sum())
    best = -(-total // capacity)
    cum_n, cum_s = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    cut = np.arange(1, capacity // 2 + 1)  # sizes over capacity - cut count as full, those under cut as nothing
    big = cum_n[-1] - cum_n[capacity - cut + 1]
    middle = cum_s[capacity - cut + 1] - cum_s[cut]
    best = max(best, int((big + -(-middle // capacity)).max(initial=0)))
    for k in range(1, 21):  # sizes rounded to multiples of 1 / k
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # times k * capacity
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bin and offset of each piece, and the filled length of each bin."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fill = 0, []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if room > n:
            rooms[room - n].append(b)
            mask |= 1 << (room - n)
    return bins, offsets, np.array(fill, np.int64)


def _pack(round_: int, capacity: int, final: bool):
    def run(table: pa.Table) -> pa.Table:
        group = table.column("g")[0].as_py()
        lengths = table.column("length").to_numpy().astype(np.int64)
        bins, offsets, fill = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        loose = fill < capacity * 0.97
        if len(fill) > bound:
            loose |= fill <= np.partition(fill, len(fill) // 4)[len(fill) // 4]
        if len(fill):
            loose[fill.argmin()] |= fill.min() < capacity
        if final:
            loose[:] = False
        table = table.drop_columns([c for c in ("sequence_id", "offset", "open", "certified") if c in table.column_names])
        base = (round_ << 56) | (group << 24)
        for name, value in (("sequence_id", base + bins), ("offset", offsets), ("open", loose[bins]), ("certified", np.full(len(bins), len(fill) == bound))):
            table = table.append_column(name, pa.array(value))
        return table

    return run


def pack(sized: DataFrame, capacity: int = CAPACITY, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` of 1 to ``capacity``; all rows are kept.

    Sequences are gapless from offset 0 and hold ``capacity`` at most. ``certified`` tells whether the row's
    partition met its lower bound. Needs ``doc_id`` and ``piece`` to deal the rows; repeated rows are packed each.
    """
    names = [f"{c.name} {c.dataType.simpleString()}" for c in sized.schema]
    done, todo, round_, before = None, staged(sized, "pieces"), 0, None
    keep = sized.columns
    while True:
        n = todo.count()
        if n == 0 and done is not None:
            return done.select(*keep, "sequence_id", "offset", "certified")
        groups = max(1, -(-n // partition_pieces))
        final = groups == 1 or before == groups
        salt = F.when(F.lit(round_ == 0), F.monotonically_increasing_id()).otherwise(F.lit(round_))
        dealt = todo.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", salt), F.lit(groups)))
        packed = dealt.groupBy("g").applyInArrow(_pack(round_, capacity, final), ", ".join([*names, "g long", "sequence_id long", "offset long", "open boolean", "certified boolean"]))
        packed = staged(packed, "packed")
        closed = packed.where("not open")
        done = closed if done is None else done.union(closed)
        if final:
            return done.select(*keep, "sequence_id", "offset", "certified")
        todo, before, round_ = packed.where("open").select(*keep), groups, round_ + 1


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack all ``docs`` (``doc_id, text``) into as few sequences of ``capacity`` tokens as the method finds.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified``. Null or empty
    text: one piece of one id. Repeated rows are packed once each; an empty table gives no rows; other columns are not read.
    """
    return pack(pieces(docs, tokenizer or tokenizer_path(), capacity), capacity)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all ``documents`` in sequences of 4096 tokens, by ``pack_documents``; the tokenizer's path is a parameter there."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
