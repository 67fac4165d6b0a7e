"""SimHash near-duplicates by a segment-popcount embedding (operator 5).

A 64-bit fingerprint is embedded as the vector of bit counts of its segments. The Manhattan distance
of two such vectors is a lower bound of the Hamming distance, so fingerprints that link at two bits
lie at Manhattan distance two or less, and then some grid cell lies at distance one or less from both.
Each distinct fingerprint is therefore put into its own cell and the cells one step away; an equi-join
on cells is the grid range-join, and ``bit_count(a ^ b) <= 2`` verifies every candidate exactly.
A cell with more than ``dense`` fingerprints is not paired up: there each fingerprint names the 65
values within one bit of it, and all that share a value link (they differ in at most two bits, and any
two that do share one), which needs a number of rows linear in the cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytetext import LOWER, chunks, ranges, single_spaced, words
from .components import components
from .shared import staged
from .xxh import xxh64

SEED = 42
MAX_BITS = 2


def fingerprints_of(buf: np.ndarray, offs: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of the texts of a chunk; zero for a text without words."""
    low = LOWER[buf]
    starts, ends, bounds = words(low, offs)
    out = np.zeros(len(offs) - 1, np.uint64)
    n_words = np.diff(bounds)
    n = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    if not n.sum():
        return out
    low, starts, ends = single_spaced(low, starts, ends)
    doc = np.repeat(np.arange(len(n)), n)
    first = ranges(bounds[:-1], n)
    h = xxh64(low, starts[first], ends[np.minimum(first + width, bounds[doc + 1]) - 1], SEED)
    full = np.flatnonzero(n)
    parts = -(-n[full] // 255)  # byte lanes hold counts up to 255
    lo = np.cumsum(n) - n
    heads = np.repeat(lo[full], parts) + 255 * ranges(np.zeros(len(full), np.int64), parts)
    lanes = np.stack([np.add.reduceat((h >> np.uint64(s)) & np.uint64(0x0101010101010101), heads) for s in range(8)], 1)
    counts = np.add.reduceat(lanes.view(np.uint8).reshape(len(heads), 64).astype(np.int64), np.cumsum(parts) - parts, axis=0)
    bits = (2 * counts > n[full][:, None]).reshape(-1, 8, 8)  # [text, shift, lane]: bit 8 * lane + shift
    value = (bits * (np.uint64(1) << (8 * np.arange(8)[None, :] + np.arange(8)[:, None]).astype(np.uint64))[None]).sum((1, 2), dtype=np.uint64)
    out[full] = value
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) of every row of ``docs``; null texts count as empty, and empty ones get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, buf, offs in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(fingerprints_of(buf, offs, width).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _u(x: int) -> F.Column:
    """A 64-bit mask as a signed literal."""
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def _cells(fp: F.Column, segment_bits: int) -> F.Column:
    """The cell of the popcount vector, packed, and the cells one step away that hold vectors of fingerprints."""
    ones, twos = fp.bitwiseAND(_u(0x5555555555555555)), F.shiftrightunsigned(fp, 1).bitwiseAND(_u(0x5555555555555555))
    own = ones.bitwiseXOR(twos).bitwiseOR(F.shiftleft(ones.bitwiseAND(twos), 1))
    if segment_bits == 4:
        own = own.bitwiseAND(_u(0x3333333333333333)) + F.shiftrightunsigned(own, 2).bitwiseAND(_u(0x3333333333333333))
    near = [own]
    for k in range(0, 64, segment_bits):
        count = F.shiftrightunsigned(own, k).bitwiseAND(F.lit((1 << segment_bits) - 1).cast("long"))
        if segment_bits == 4:
            near += [F.when(count < 4, own + _u(1 << k)), F.when(count > 0, own - _u(1 << k))]
        else:  # the top field reaches the sign bit, so steps are made by XOR: 0 -> 1 -> 2
            near += [F.when(count == 0, own.bitwiseXOR(_u(1 << k))).when(count == 1, own.bitwiseXOR(_u(3 << k)))]
            near += [F.when(count == 1, own.bitwiseXOR(_u(1 << k))).when(count == 2, own.bitwiseXOR(_u(3 << k)))]
    return F.array_compact(F.array(*near))


def links(distinct: DataFrame, segment_bits: int = 4, dense: int = 16) -> DataFrame:
    """Edges ``u, v`` between ``rep`` values whose fingerprints ``fp`` differ in two bits or fewer.

    Every such pair is joined by an edge or, inside dense cells, by a path of edges between such pairs.
    """
    cells = distinct.select(F.explode(_cells(F.col("fp"), segment_bits)).alias("cell"), "fp", "rep")
    shared = cells.withColumn("n", F.count("*").over(Window.partitionBy("cell"))).where("n > 1")
    shared = staged(shared, "cells")
    few = shared.where(F.col("n") <= dense)
    a, b = few.select("cell", F.col("fp").alias("fa"), F.col("rep").alias("u")), few.select("cell", F.col("fp").alias("fb"), F.col("rep").alias("v"))
    near = a.join(b, "cell").where((F.col("fa") < F.col("fb")) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= MAX_BITS)).select("u", "v").distinct()
    ball = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(_u(1 << k)) for k in range(64)))
    crowd = shared.where(F.col("n") > dense).select("fp", "rep").distinct().select(F.explode(ball).alias("value"), "rep")
    hubs = crowd.groupBy("value").agg(F.min("rep").alias("v"), F.count("*").alias("n")).where("n > 1")
    star = crowd.join(hubs, "value").where("rep <> v").select(F.col("rep").alias("u"), "v").distinct()
    return near.union(star)


def simhash_groups(docs: DataFrame, width: int = 3, segment_bits: int = 4, dense: int = 16) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint`` (16 hex digits), ``component_id``.

    ``segment_bits`` is 4 (16 segments) or 2 (32 segments, finer cells for over about 100 million distinct
    fingerprints). Null or word-less texts have fingerprint zero and link like any other; texts of fewer
    than ``width`` words are one shingle; equal texts share a group; an empty table gives no rows; other
    columns of ``docs`` are not read.
    """
    fps = staged(fingerprints(docs, width), "fps")
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    group = components(links(distinct, segment_bits, dense)).withColumnsRenamed({"node": "rep"})
    labelled = distinct.join(group, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(labelled, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every row of ``documents``, by ``simhash_groups``."""
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
