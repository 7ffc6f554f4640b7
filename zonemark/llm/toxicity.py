"""Toxicity by class-conditional Kneser-Ney models of bytes (operator 2).

For each class (toxic, ordinary) an interpolated Kneser-Ney model of order ``ORDER``: the highest
order uses counts, the orders below it continuation counts of the same class, and below order 3 both
classes share one set of continuation counts, so that what is rare is judged by the same backoff.
The score compares the two log-likelihoods, divided by the length: of the whole text, and of the
``WINDOW`` symbols in a row that are likeliest to be toxic, so that a few words in a long text are not
lost among the others.

* The n-gram counts come from every labelled text of the training folds: each task sums its own, Spark
  adds them up, and continuation counts are group-bys over the distinct n-grams.
* Tables of discounts hold every n-gram that was counted, found by a hash and compared as it is, so what
  was not counted takes nobody's mass. A model grows with the distinct n-grams of the training folds, 12
  bytes each where it is gathered and sent and up to 28 in a worker; documents are scored where they lie, without a shuffle.
* A logistic curve from the compared likelihoods to a probability is fitted on labelled rows of a fold
  that the counts have not seen, ``CALIBRATION_ROWS`` of them at most, by smallest hash.

Folds are crc32(doc_id) mod 5: 0 is held out and never read, 1 to 3 are counted, 4 calibrates.

Defined cases: null and empty texts have no n-grams and get the curve's value at nothing, near the share of label 1;
rows without doc_id are of fold 0 and unlabelled; a doc_id with labels that differ is left out of
training; with labels of one class only every score is that class, without any it is 0; rows that share
an id are scored each; very long texts are scored whole; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import keeps, lean
from .storage import discard, stored

ORDER, SHARED = 4, 2
#: Symbols of a passage.
WINDOW = 24
CALIBRATION_ROWS = 20_000
FOLDS = 5

_SYMBOL = np.full(256, 32, np.uint8)
_SYMBOL[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_SYMBOL[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_SYMBOL[ord("0") : ord("9") + 1] = ord("0")
_SYMBOL[128:] = np.arange(128, 256)


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)), F.lit(0))


def _symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after the other, bounds): letters folded, other marks a space; each text
    begins with ORDER - 1 spaces."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    lens = np.diff(off)
    pad = ORDER - 1
    bounds = np.concatenate([[0], np.cumsum(lens + pad)])
    out = np.full(bounds[-1], 32, np.uint8)
    shift = np.repeat(np.arange(1, len(lens) + 1) * pad, lens)
    out[np.arange(len(raw)) + shift] = _SYMBOL[raw]
    return out, bounds


def _grams(sym: np.ndarray, order: int) -> np.ndarray:
    """At each place the last ``order`` symbols, the latest in the low byte; places before the first
    whole n-gram come out short and are not used."""
    g = sym.astype(np.uint64)
    for k in range(1, order):
        g[k:] |= sym[:-k].astype(np.uint64) << np.uint64(8 * k)
    return g


def _slot(gram: np.ndarray, bits: int) -> np.ndarray:
    """A hash of n-grams to 2 ** bits slots."""
    x = gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def _slices(texts: pa.Array, size: int = 1_000_000) -> Iterator[pa.Array]:
    n = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    lo = 0
    while lo < len(texts):
        hi = lo + max(1, int(np.searchsorted(np.cumsum(n[lo:]), size, "right")))
        yield texts.slice(lo, hi - lo)
        lo = hi


def count_grams(rows: DataFrame) -> DataFrame:
    """gram, n_toxic, n_ordinary over all rows (text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            key = np.concatenate([h[0] for h in held])
            u, at = np.unique(key, return_inverse=True)
            return u, *(np.bincount(at, np.concatenate([h[c] for h in held]), len(u)) for c in (1, 2))

        for b in batches:
            tox = b.column(1).to_numpy(zero_copy_only=False).astype(float)
            lo = 0
            for part in _slices(b.column(0)):
                sym, bounds = _symbols(part)
                ok = np.ones(len(sym), bool)
                first = bounds[:-1]
                for k in range(ORDER - 1):
                    ok[np.minimum(first + k, len(sym) - 1)] = False
                t = np.repeat(tox[lo : lo + len(part)], np.diff(bounds))[ok]
                u, at = np.unique(_grams(sym, ORDER)[ok], return_inverse=True)
                n1 = np.bincount(at, t, len(u))
                held.append((u, n1, np.bincount(at, minlength=len(u)) - n1))
                lo += len(part)
                if sum(len(h[0]) for h in held) > 1_000_000:
                    held = [merged()]
                    if len(held[0][0]) > 500_000:
                        yield _gram_batch(*held.pop())
        if held:
            yield _gram_batch(*merged())

    part = rows.select("text", "toxic").mapInArrow(lean(run), "gram long, n_toxic long, n_ordinary long")
    return part.groupBy("gram").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_ordinary").alias("n_ordinary"))


def _gram_batch(u: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    cols = [pa.array(x.astype(np.int64)) for x in (u, a, b)]
    return pa.RecordBatch.from_arrays(cols, ["gram", "n_toxic", "n_ordinary"])


@dataclass
class Table:
    """Distinct n-grams and their values, [n-gram, class]; all others have ``rest``."""

    grams: np.ndarray
    values: np.ndarray
    rest: float

    def open(self) -> "OpenTable":
        """Slots by linear probing, a quarter to half of them used at most."""
        n = len(self.grams)
        bits = max(4, (2 * n).bit_length())
        where = np.full(1 << bits, n, np.int32)
        at, todo = _slot(self.grams, bits), np.arange(n, dtype=np.int32)
        while len(todo):
            free = where[at] == n
            where[at[free]] = todo[free]
            left = where[at] != todo
            at, todo = (at[left] + 1) & (len(where) - 1), todo[left]
        grams = np.append(self.grams, np.uint32(0))
        return OpenTable(bits, where, grams, np.vstack([self.values, np.full((1, 2), self.rest, np.float32)]))


@dataclass
class OpenTable:
    bits: int
    where: np.ndarray
    grams: np.ndarray
    values: np.ndarray

    def of(self, gram: np.ndarray) -> np.ndarray:
        none, mask = len(self.grams) - 1, len(self.where) - 1
        at = _slot(gram, self.bits)
        row = self.where[at]
        other = np.flatnonzero((self.grams[row] != gram) & (row != none))
        at = at[other]
        while len(other):
            at = (at + 1) & mask
            row[other] = found = self.where[at]
            more = (self.grams[found] != gram[other]) & (found != none)
            other, at = other[more], at[more]
        return self.values[row]


@dataclass
class Model:
    """Per order above SHARED: own[k] the discounted share, left[k] for a context the weight of the order
    below; base[pair of bytes]: the shared probability. What is sent to the tasks has the n-grams only;
    a worker lays them out on first use."""

    own: dict[int, Table]
    left: dict[int, Table]
    base: np.ndarray

    def open(self) -> "OpenModel":
        if _OPEN.get("model") is not self:
            _OPEN.clear()
            opened = OpenModel({k: t.open() for k, t in self.own.items()}, {k: t.open() for k, t in self.left.items()}, self.base)
            _OPEN.update(model=self, opened=opened)
        return _OPEN["opened"]


_OPEN = keeps("toxicity")


@dataclass
class OpenModel:
    own: dict[int, OpenTable]
    left: dict[int, OpenTable]
    base: np.ndarray

    def compare(self, sym: np.ndarray) -> np.ndarray:
        """log p(toxic) - log p(ordinary) of each symbol."""
        p = np.repeat(self.base[_grams(sym, SHARED).astype(np.int64)][:, None], 2, axis=1)
        for k in range(SHARED + 1, ORDER + 1):
            g = _grams(sym, k)
            p *= self.left[k].of(g >> np.uint64(8))
            p += self.own[k].of(g)
        np.log(p, out=p)
        return p[:, 0] - p[:, 1]


_CLASSES = ("n_toxic", "n_ordinary")


def _discount(n1: int, n2: int) -> float:
    """Absolute discount from the counts of counts."""
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5


def _table(rows: DataFrame, rest: float) -> Table:
    """Rows (gram, a, b) with distinct n-grams: all of them are gathered."""
    got = rows.select(F.col(rows.columns[0]).cast("long").alias("gram"), F.col("a").cast("float"), F.col("b").cast("float")).toArrow()
    values = np.stack([got.column(c).to_numpy() for c in "ab"], axis=1)
    return Table(got.column("gram").to_numpy().astype(np.uint32), values, rest)


def fit(rows: DataFrame) -> Model:
    """A model of all rows (text, toxic 0/1)."""
    now = grams = stored(count_grams(rows), "grams")
    own: dict[int, Table] = {}
    left: dict[int, Table] = {}
    for k in range(ORDER, SHARED, -1):
        ones = now.agg(*[F.count(F.when(F.col(c) == n, 1)) for c in _CLASSES for n in (1, 2)]).first()
        d = dict(zip(_CLASSES, (_discount(ones[0], ones[1]), _discount(ones[2], ones[3]))))
        both = now.withColumn("ctx", F.shiftright("gram", 8))
        ctx = both.groupBy("ctx").agg(
            *[F.sum(c).alias(f"t_{c}") for c in _CLASSES], *[F.count(F.when(F.col(c) > 0, 1)).alias(f"k_{c}") for c in _CLASSES]
        )
        share = [F.when(F.col(c) > 0, (F.col(c) - F.lit(d[c])) / F.col(f"t_{c}")).otherwise(0.0) for c in _CLASSES]
        weight = [F.when(F.col(f"t_{c}") > 0, F.lit(d[c]) * F.col(f"k_{c}") / F.col(f"t_{c}")).otherwise(1.0) for c in _CLASSES]
        own[k] = _table(both.join(ctx, "ctx").select("gram", *[x.alias(n) for x, n in zip(share, "ab")]), 0.0)
        left[k] = _table(ctx.select("ctx", *[x.alias(n) for x, n in zip(weight, "ab")]), 1.0)
        mask = (1 << (8 * (k - 1))) - 1
        now = now.groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(*[F.count(F.when(F.col(c) > 0, 1)).alias(c) for c in _CLASSES])
    pairs = np.zeros(1 << 16)
    for r in now.collect():  # pairs of bytes: 65536 at most
        pairs[r["gram"]] = r["n_toxic"] + r["n_ordinary"]
    pairs = pairs.reshape(256, 256)
    total, kinds = np.maximum(pairs.sum(1, keepdims=True), 1), (pairs > 0).sum(1, keepdims=True)
    low = (pairs > 0).sum(0) + 0.5
    dd = _discount(int((pairs == 1).sum()), int((pairs == 2).sum()))
    base = np.maximum(pairs - dd, 0) / total + np.where(kinds > 0, dd * kinds / total, 1.0) * low / low.sum()
    discard(grams)
    return Model(own, left, base.ravel().astype(np.float32))


def _peaks(total: np.ndarray, lo: np.ndarray, hi: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Per text the largest mean of ``width`` log ratios in a row, of running sums; of shorter texts the mean
    of all."""
    lens = hi - lo
    out = (total[hi] - total[lo]) / np.maximum(lens, 1)
    long = np.flatnonzero(lens > width)
    if len(long):
        runs = total[width:] - total[:-width]
        # from a text's first run to behind its last one, and on to the next text's first
        cut = np.column_stack([lo[long], hi[long] - width + 1]).ravel()
        best = np.maximum.reduceat(np.append(runs, -np.inf), cut)[::2]
        out[long] = best / width
    return out


def compared(rows: DataFrame, text_col: str, held) -> DataFrame:
    """``rows`` with llr double (the mean of the log ratios), peak double (that of the worst passage) and
    n_symbols long; held: a broadcast model. The text is a column, which then goes, or a field of the struct
    ``row``, which stays."""
    inside = text_col not in rows.columns
    at = rows.columns.index("row" if inside else text_col)
    keep = [c for c in rows.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value.open()

        def text_of(b: pa.RecordBatch) -> pa.Array:
            return pc.struct_field(b.column(at), text_col).cast(pa.string()) if inside else b.column(at)

        for b in batches:
            llr, peak, n = [np.empty(0)], [np.empty(0)], [np.empty(0, np.int64)]
            for part in _slices(text_of(b)):
                sym, bounds = _symbols(part)
                total = np.concatenate([[0.0], np.cumsum(m.compare(sym), dtype=np.float64)])
                lens = np.diff(bounds) - (ORDER - 1)
                lo = bounds[:-1] + ORDER - 1
                llr.append((total[bounds[1:]] - total[lo]) / np.maximum(lens, 1))
                peak.append(_peaks(total, lo, bounds[1:]))
                n.append(lens)
            cols = [b.column(k) for k in range(b.num_columns) if inside or k != at]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(np.concatenate(x)) for x in (llr, peak, n)]], [*keep, "llr", "peak", "n_symbols"])

    schema = T.StructType([f for f in rows.schema if f.name != text_col]).add("llr", "double").add("peak", "double").add("n_symbols", "long")
    return rows.mapInArrow(lean(run, "toxicity"), schema)


def _features(llr: np.ndarray, peak: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(llr)), llr * 100, llr * np.sqrt(n) * 10, peak * 10, np.log1p(n) / 10])


def calibrate(llr: np.ndarray, peak: np.ndarray, n: np.ndarray, toxic: np.ndarray, prior: float, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic curve by Newton's method, held to the prior log odds as by a row or so."""
    x = _features(llr, peak, n)
    hold = np.array([1.0, 0.01, 0.01, 0.01, 0.01])
    start = np.array([prior, 0.0, 0.0, 0.0, 0.0])
    w = start.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (p - toxic) + hold * (w - start))
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_broadcast_labels: int = 2_000_000,
    with_row: bool = False,
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; also llr, n_symbols and, with
    ``with_row``, the row as the struct ``row``."""
    ids = F.col(id_col).cast("long")
    text = F.col(text_col).cast("string").alias("text")
    texts = docs.select(ids.alias("doc_id"), text)
    rows = docs.select(F.struct("*").alias("row"), ids.alias("doc_id")) if with_row else texts
    row = ["row"] if with_row else []
    one = labels.filter(F.col(label_col).isin(0, 1)).groupBy(ids.alias("doc_id")).agg(F.min(label_col).alias("toxic"), F.max(label_col).alias("_hi"))
    one = stored(one.filter(F.col("toxic") == F.col("_hi")).drop("_hi").filter(fold(F.col("doc_id")) > 0), "labels")
    # without a shuffle of the texts while the labels are few enough
    side = F.broadcast(one) if one.count() <= max_broadcast_labels else one
    known = texts.filter(fold(F.col("doc_id")) > 0).join(side, "doc_id")
    held_out = (fold(F.col("doc_id")) == 0).alias("held_out")
    classes = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}  # two at most
    if len(classes) < 2:
        size = F.coalesce(F.octet_length(F.col("row")[text_col].cast("string") if with_row else F.col("text")), F.lit(0)).cast("long")
        only = int(*classes or [0])
        same = [F.lit(float(only)).alias("score"), F.lit(only).alias("predicted"), F.lit(0.0).alias("llr")]
        return rows.select("doc_id", held_out, *same, size.alias("n_symbols"), *row)
    model = fit(known.filter(fold(F.col("doc_id")) < FOLDS - 1).select("text", "toxic"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # as large as the distinct n-grams
    seen = known.filter(fold(F.col("doc_id")) == FOLDS - 1)
    few = one.filter(fold(F.col("doc_id")) == FOLDS - 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_ROWS).select("doc_id")
    got = compared(seen.join(F.broadcast(few), "doc_id", "left_semi").select("toxic", "text"), "text", held).toArrow()
    prior = math.log((classes[1] + 0.5) / (classes[0] + 0.5))
    w = calibrate(*(got.column(c).to_numpy().astype(float) for c in ("llr", "peak", "n_symbols", "toxic")), prior)
    f = [F.lit(1.0), F.col("llr") * 100, F.col("llr") * F.sqrt("n_symbols") * 10, F.col("peak") * 10, F.log1p("n_symbols") / 10]
    z = sum((F.lit(float(a)) * b for a, b in zip(w[1:], f[1:])), F.lit(float(w[0])) * f[0])
    out = compared(rows, text_col if with_row else "text", held)
    out = out.withColumn("score", 1 / (1 + F.exp(-z)))
    return out.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "llr", "n_symbols", *row)
