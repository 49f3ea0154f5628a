"""Near-duplicates by SetSketch registers: banded register values propose pairs, a joint likelihood screens them, whole sets decide.

A sketch has ``REGISTERS`` exponentially spaced, truncated minima: every shingle is a Poisson
process of points in (time, register), a register's value is 1 - log_b of its first point
over all shingles, rounded down and held in 16 bits. So the sketch of a union is the larger
value of each register (``merge``), and registers of sets with similarity J are equal with
probability log_b(1 + J (b - 1)), next to J for the base taken here.

Points up to a time at which all registers of a set of n shingles are filled but for one set
in 100 000 are about REGISTERS (ln REGISTERS + 12) for any n, and only they are made; sets
with an empty register are done again with twice the time.

1. Equal sets are one class (``jaccard.set_table``).
2. Registers are banded: ``BANDS`` keys of ``ROWS`` register values. At J = 0.85 a band agrees
   with probability 0.85^6 = 0.38, so a pair meets nowhere with 2 x 10^-9; unrelated sets
   agree in a register with 1 in 400, in a band with 10^-16.
3. Of the sets of a bucket one leads, and each set is compared with one leader, so a bucket
   of N near copies is N comparisons; only pairs of a bucket that are not yet in one class
   stay open, and sets of one leader are looked up by their differences from it
   (``jaccard._links``, which also bounds them by the shingles that occur elsewhere).
4. Candidate pairs are estimated jointly: the counts of larger, smaller and equal registers
   have a likelihood in J, as the sizes of the sets are known. A pair is dropped only if that
   of the threshold is below the best one by e^-``DOUBT`` (about 10^-8 for a pair at the threshold).
5. What is left is compared over the whole shingle sets. Links are exact; that a link is
   found has the probability of step 2 and 4.

Defined cases are those of ``jaccard``: empty sets are linked with nothing, repeated rows are
rows of one class, rows without an id link others but give no name. ``kept`` is true for the
row whose id names its class, and false for rows without an id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import jaccard, store, words

BANDS, ROWS = 42, 6
REGISTERS = BANDS * ROWS
#: Base of the registers and the rate that keeps small sets' values above 0.
BASE, RATE = 1.01, 20.0
#: Differences of log-likelihood up to which a pair goes on to the comparison.
DOUBT = 16.0
#: Points made at once.
_BLOCK = 1 << 16


def _points(hashes: np.ndarray, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(gap, register) of points first .. first + count - 1 of each shingle's process."""
    x = words.mix(hashes[:, None] + (np.arange(first, first + count, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    gap = -np.log(((x >> np.uint64(24)).astype(np.float64) + 0.5) / 2.0**40) / REGISTERS
    return gap, ((x & np.uint64(0xFFFFFF)) * np.uint64(REGISTERS) >> np.uint64(24)).astype(np.int64)


def _minima(rows: np.ndarray, hashes: np.ndarray, until: np.ndarray, out: np.ndarray) -> None:
    """First points up to each row's time, in ``out`` (rows x registers)."""
    flat, now, done = out.reshape(-1), np.zeros(len(rows)), 0
    while len(rows):
        count = max(1, min(256, _BLOCK // len(rows)))
        gap, register = _points(hashes, done, count)
        time = now[:, None] + np.cumsum(gap, axis=1)
        i, j = np.nonzero(time <= until[rows][:, None])
        np.minimum.at(flat, rows[i] * REGISTERS + register[i, j], time[i, j])
        now, done = time[:, -1], done + count
        more = now <= until[rows]
        rows, hashes, now = rows[more], hashes[more], now[more]


def sketches(rows: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The registers (len(n) x REGISTERS, uint16) of sets given by (row, shingle hash); empty sets have zeros."""
    out = np.full((len(n), REGISTERS), np.inf)
    until = (np.log(REGISTERS) + 12) / np.maximum(n, 1)
    todo = n > 0
    while todo.any():
        mine = todo[rows]
        _minima(rows[mine], hashes[mine], until, out)
        todo = todo & np.isinf(out).any(axis=1)
        until = until * 2
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(1 - np.log(out / RATE) / np.log(BASE)), 0, 65535).astype(np.uint16)


def merge(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(x, y)


def bands(registers: np.ndarray) -> np.ndarray:
    """Keys (sets x BANDS) of each band's register values."""
    v = registers.reshape(len(registers), BANDS, ROWS).astype(np.uint64)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] + np.uint64(1)
    for i in range(ROWS):
        key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + v[:, :, i])
    return key


def _log_likelihood(j, larger, smaller, equal, u, v):
    def p(x):
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = p(u - v * j), p(v - u * j)
    return larger * np.log(up) + smaller * np.log(down) + equal * np.log(np.maximum(1 - up - down, 1e-12))


def joint_estimate(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, at: float) -> tuple[np.ndarray, np.ndarray]:
    """(likeliest similarity, how far the log-likelihood of ``at`` is below the best if the best is lower, else 0) of pairs of sketches of sets of known sizes."""
    larger, smaller = (x > y).sum(axis=1), (x < y).sum(axis=1)
    equal = x.shape[1] - larger - smaller
    u = nx / (nx + ny)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    low, high = np.zeros(len(u)), most.astype(float)
    fit = lambda j: _log_likelihood(j, larger, smaller, equal, u, v)
    for _ in range(40):  # the log-likelihood has one maximum
        a, b = low + (high - low) / 3, high - (high - low) / 3
        right = fit(a) < fit(b)
        low, high = np.where(right, a, low), np.where(right, high, b)
    best = (low + high) / 2
    short = np.where(most < at, np.inf, fit(best) - fit(np.minimum(at, most)))
    return best, np.where(best >= at, 0.0, short)


def _band_rows(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """sig, cls, n: a row for each band of each set that can have an unequal linked set."""
    schema = pa.schema([("sig", pa.int64()), ("cls", pa.int64()), ("n", pa.int32())])

    def run(batches):
        for batch in batches:
            for _, _, bounds, h, r in jaccard._sets(batch.column("text"), k):
                n = np.diff(bounds)
                own = np.flatnonzero(jaccard._differ(n, num, den) > 0)
                if not len(own):
                    continue
                at = np.full(len(n), -1)
                at[own] = np.arange(len(own))
                keep = at[r] >= 0
                keys = bands(sketches(at[r[keep]], h[keep], n[own]))
                cls = np.array([jaccard._digest(h[bounds[i] : bounds[i + 1]]) for i in own], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(cls, BANDS)), pa.array(np.repeat(n[own].astype(np.int32), BANDS))], schema=schema)

    return texts.mapInArrow(run, "sig long, cls long, n int")


def _members(docs: DataFrame, sets: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Buckets (sig, cls, n, shared) and token sets (cls, n, tokens) of the classes that meet another one in a band."""
    heads = jaccard._heads(docs, sets)
    rows = store.table(_band_rows(heads.select("text"), k, num, den).dropDuplicates(["sig", "cls"]), "sketch-bands")
    many = store.table(rows.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1").select("sig"), "sketch-many")
    met = store.table(rows.join(store.checked_broadcast(many), "sig", "left_semi"), "sketch-met")
    live = store.table(met.select("cls").distinct(), "sketch-live")
    tokens = jaccard._tokens(docs, sets, live, k)
    least = tokens.select("cls", "n").join(jaccard._shared(tokens), "cls", "left").select("cls", (F.col("n") - F.coalesce("own", F.lit(0))).cast("int").alias("shared"), "n")
    least = store.table(least.where(f"shared * {den}L >= n * {num}L").select("cls", "shared"), "sketch-shared")
    return store.table(met.join(store.checked_broadcast(least), "cls"), "sketch-members"), tokens


def _sketch_table(live: DataFrame) -> DataFrame:
    """cls, size, sketch (binary) of token sets."""
    schema = pa.schema([("cls", pa.int64()), ("size", pa.int32()), ("sketch", pa.binary())])

    def run(batches):
        for batch in batches:
            own = [np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column("tokens")]
            n = np.array([len(x) for x in own], np.int64)
            if len(own):
                made = sketches(np.repeat(np.arange(len(own)), n), np.concatenate(own), n)
                yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(n.astype(np.int32)), pa.array([x.tobytes() for x in made], pa.binary())], schema=schema)

    return store.table(live.select("cls", "tokens").mapInArrow(run, "cls long, size int, sketch binary"), "sketch-registers")


def screen(num: int, den: int):
    """A filter of candidate pairs (a, b) over token sets by the joint estimate."""
    made: dict[str, DataFrame] = {}

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("x", "y"))
                _, short = joint_estimate(x, y, batch.column("nx").to_numpy(), batch.column("ny").to_numpy(), num / den)
                yield batch.select(["a", "b"]).filter(pa.array(short <= DOUBT))

    def keep(pairs: DataFrame, live: DataFrame) -> DataFrame:
        if "table" not in made:
            made["table"] = _sketch_table(live)
        of = made["table"]
        both = pairs.select("a", "b").join(of.toDF("a", "nx", "x"), "a").join(of.toDF("b", "ny", "y"), "b")
        return both.select("a", "b", "nx", "ny", "x", "y").mapInArrow(run, "a long, b long")

    return keep


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents whose shingle sets are linked, directly or over others, when den * |x & y| >= num * |x | y|."""
    named = jaccard.join_classes(docs, k, num, den, members=_members, screen=screen(num, den))
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
