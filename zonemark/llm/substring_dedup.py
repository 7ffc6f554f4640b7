"""Substring deduplication by recompression (operator 9).

A window is ``WINDOW`` consecutive words of one document.  Words covered by a window that also starts in
a document with a smaller id go.

Recompression names runs and pairs of symbols, round after round: a run of one word gets a name, then
every pair whose left symbol falls in one half of the names and whose right one in the other.  Names are
fingerprints of what they stand for, so all tasks give equal pairs equal names, and whether two
neighbours are joined depends on them alone: equal substrings have the same symbols inside, and only
the symbols near their ends depend on what is outside.  Each symbol keeps the span of words that it and
its being cut there depend on.

* Round one of Spark: after ``ROUNDS`` rounds of naming, a text is a row of anchors: its last symbols,
  each with the words of its span.  Buckets of anchors tell which of them several documents have.
* If a window is repeated, so are all anchors with spans inside it.  Windows with an anchor that no
  other document has are out; what is left is nearly only true repeats.
* Round two verifies these on all of their words: for each distinct window of a part of the documents
  goes its smallest id, and one bit comes back, whether any other part has a smaller one.
* A last pass over the texts marks the words and makes the digests.

Documents are dealt out by a hash of their ids, anchors and windows by themselves, each summed up within
its part before it moves, so a passage that a third of all documents share counts once a part.  There are
as many parts and buckets as the texts' bytes ask for, so what a task holds does not grow with the input.

Defined cases: null texts and texts without words have no words, and the digest of the empty string;
rows without doc_id are kept whole and not compared; rows that share a doc_id are no repeats of each
other; a repeat within one document is none; an empty table gives an empty result; other columns are
not read.  Anchors are told apart by at least 36 bits, which only lets more windows be verified; windows by
128, two fingerprints of 64 with nothing in common, down to the bytes of the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import lean
from .storage import parts_of, release, stored
from .tokens import ragged
from .words import Words, _powers, fingerprints, mix, runs, second, slices

WINDOW, ROUNDS = 13, 3
#: Text bytes a part; a part's number has 24 bits, so beyond 268 TB parts grow.
PART_BYTES, MAX_PARTS = 16_000_000, 1 << 24


def anchors(w: Words, width: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, first word, end word of the span) of the symbols after some rounds whose spans are
    inside their document and not longer than ``width``."""
    h, n = w.print, len(w.print)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    # block compression: runs of one word
    new = np.ones(n, bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    end = np.append(at[1:], n)
    sym, d = mix(h[at] + (end - at).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), doc[at]
    lo, hi = at - 1, end + 1  # a run is known to end by the words beside it
    for k in range(rounds):
        side = (mix(sym ^ np.uint64(0xA0761D6478BD642F * (k + 1) & (1 << 64) - 1)) & np.uint64(1)).astype(bool)
        near = np.zeros(len(sym), bool)
        near[:-1] = d[1:] == d[:-1]
        pair = np.zeros(len(sym), bool)
        pair[:-1] = near[:-1] & ~side[:-1] & side[1:]
        second = np.zeros(len(sym), bool)
        second[1:] = pair[:-1]
        # what stays alone: a left one because of its right neighbour, a right one because of its left one
        new_lo, new_hi = lo.copy(), hi.copy()
        alone = ~pair & ~second
        nxt, prv = np.append(hi[1:], hi[-1] + width), np.append(lo[0] - width, lo[:-1])
        has_next = near
        has_prev = np.append(False, near[:-1])
        left, right = alone & ~side, alone & side
        new_hi[left] = np.where(has_next[left], nxt[left], hi[left] + width)
        new_lo[right] = np.where(has_prev[right], prv[right], lo[right] - width)
        first = np.flatnonzero(pair)
        new_hi[first] = hi[first + 1]
        name = sym.copy()
        name[first] = mix(sym[first] * np.uint64(0xE7037ED1A0B428DB) + sym[first + 1] + np.uint64(k))
        keep = ~second
        sym, d, lo, hi = name[keep], d[keep], new_lo[keep], new_hi[keep]
    ok = (lo >= w.bounds[d]) & (hi <= w.bounds[d + 1]) & (hi - lo <= width)
    sym, lo, hi = sym[ok], lo[ok], hi[ok]
    power, inverse = _powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * power[:n], out=sums[1:])
    return mix((sums[hi] - sums[lo]) * inverse[lo] + sym), lo, hi


def candidates(w: Words, shared: np.ndarray, span: tuple[np.ndarray, np.ndarray], width: int = WINDOW) -> np.ndarray:
    """The first words of the windows none of whose anchors is unshared."""
    lo, hi = (x[~shared] for x in span)
    n = len(w.print)
    out = np.zeros(n + 1, np.int32)
    np.add.at(out, np.maximum(hi - width, 0), 1)
    np.add.at(out, lo + 1, -1)
    ok = np.cumsum(out[:n]) == 0
    last = np.repeat(w.bounds[1:], np.diff(w.bounds)) - width
    return np.flatnonzero(ok & (np.arange(n) <= last))


# An anchor is known by its bucket and 36 bits of it; what moves is these and the number of the part that it is
# of, 24 bits.
_TOKEN, _PART = np.uint64((1 << 36) - 1), np.uint64(MAX_PARTS - 1)


def _anchor_bucket(a: np.ndarray, buckets: int) -> np.ndarray:
    return (a >> np.uint64(36)) % np.uint64(buckets)


def _anchor_ids(a: np.ndarray, buckets: int) -> np.ndarray:
    return _anchor_bucket(a, buckets) << np.uint64(36) | a & _TOKEN


def _post_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            at, keys = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            order = np.lexsort((keys, at.astype(np.uint16) if buckets < 65536 else at))
            at, keys = at[order], keys[order]
            first = np.ones(len(keys), bool)
            first[1:] = (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])
            again = ~first
            again[1:] &= first[:-1]  # an anchor that a part has twice is sent twice, not more often
            at, keys = at[first | again], keys[first | again]
            cut = np.flatnonzero(np.diff(at, prepend=-1))
            return pa.RecordBatch.from_arrays(
                [pa.array(at[cut], pa.int32()), pa.array([keys[a:z].tobytes() for a, z in zip(cut, [*cut[1:], len(at)])], pa.binary())], ["bucket", "data"]
            )

        for b in batches:
            part = b.column(0).to_numpy().astype(np.uint64)
            for at, texts in slices(b.column(1)):
                w = fingerprints(texts, fold_case=False)
                a, lo, _ = anchors(w)
                doc = np.searchsorted(w.bounds, lo, "right") - 1
                held.append((_anchor_bucket(a, buckets).astype(np.int64), (a & _TOKEN) << np.uint64(24) | part[at + doc]))
                if sum(len(x[0]) for x in held) > 2_000_000:
                    yield flush()
                    held = []
        if sum(len(x[0]) for x in held):
            yield flush()

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> dict[int, list[tuple]]:
    mine: dict[int, list[tuple]] = {}
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            mine.setdefault(row[0], []).append(row[1:])
    return mine


def _shared_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each part, the anchors of a bucket that it has and that several documents have."""
    for bucket, rows in _by_bucket(batches).items():
        keys = np.sort(np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows]))
        tok = keys >> np.uint64(24)
        same = np.zeros(len(tok), bool)
        same[1:] = tok[1:] == tok[:-1]
        shared = same.copy()
        shared[:-1] |= same[1:]
        keys = keys[shared]
        both = np.unique((keys & _PART) << np.uint64(36) | keys >> np.uint64(24))
        part = (both >> np.uint64(36)).astype(np.int64)
        cut = np.flatnonzero(np.diff(part, prepend=-1))
        low = np.ascontiguousarray((both & _TOKEN).view(np.uint8).reshape(-1, 8)[:, :5])
        if len(cut):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part[cut], pa.int32()),
                    pa.array(np.full(len(cut), bucket), pa.int32()),
                    pa.array([low[a:z].tobytes() for a, z in zip(cut, [*cut[1:], len(part)])], pa.binary()),
                ],
                ["part", "bucket", "data"],
            )


class _Part:
    """What a task gathers of one part: shared anchors and replies first, then texts."""

    def __init__(self, number: int, buckets: int) -> None:
        self.number, self.buckets = number, buckets
        self.shared: list[np.ndarray] = []
        self.bits: dict[int, np.ndarray] = {}
        self.docs: list[int | None] = []
        self.texts: list[pa.Array] = []

    def read(self) -> Iterator[tuple[list[int | None], Words, np.ndarray, np.ndarray, np.ndarray]]:
        """Per slice: ids, words, first words of candidate windows, two fingerprints of these."""
        known = np.sort(np.concatenate(self.shared)) if self.shared else np.empty(0, np.uint64)
        texts = pa.concat_arrays(self.texts)
        for at, t in slices(texts):
            w = fingerprints(t, fold_case=False)
            ids = self.docs[at : at + len(t)]
            a, lo, hi = anchors(w)
            a = _anchor_ids(a, self.buckets)
            k = np.searchsorted(known, a)
            k[k == len(known)] = 0
            hit = known[k] == a if len(known) else np.zeros(len(a), bool)
            c = candidates(w, hit, (lo, hi))
            nobody = np.array([d is None for d in ids], bool)
            if nobody.any():
                c = c[~nobody[np.searchsorted(w.bounds, c, "right") - 1]]
            none = np.empty(0, np.uint64)
            yield ids, w, c, *([runs(x, WINDOW, k)[c] for k, x in enumerate((w.print, second(w)))] if len(c) else (none, none))


def _parts(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[_Part]:
    """Rows (part, kind, bucket, data, doc, text), sorted by part and kind."""
    now, p = None, None
    for b in batches:
        part, kind = b.column(0).to_numpy(), b.column(1).to_numpy()
        cut = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(kind, prepend=-1) != 0))
        for a, z in zip(cut, [*cut[1:], len(part)]):
            if part[a] != now:
                if p is not None and p.texts:
                    yield p
                now, p = part[a], _Part(int(part[a]), buckets)
            if kind[a] == 2:
                p.docs += b.column(4).slice(a, z - a).to_pylist()
                p.texts.append(b.column(5).slice(a, z - a))
                continue
            for bucket, data in zip(b.column(2).slice(a, z - a).to_pylist(), b.column(3).slice(a, z - a).to_pylist()):
                if kind[a] == 0:
                    low = np.frombuffer(data, np.uint8).reshape(-1, 5)
                    tok = np.zeros((len(low), 8), np.uint8)
                    tok[:, :5] = low
                    p.shared.append(tok.view(np.uint64).ravel() | np.uint64(bucket << 36))
                else:
                    p.bits[bucket] = np.unpackbits(np.frombuffer(data, np.uint8))
    if p is not None and p.texts:
        yield p


def _lowest(p: _Part, buckets: int) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """The part's slices (ids, words, first words of candidate windows, number of each window); its distinct
    windows in the order of their buckets and fingerprints, [window, 2], the smallest id and the bucket of each."""
    kept, prints, docs = [], [], []
    for ids, w, c, h, h2 in p.read():
        kept.append((ids, w, c))
        prints.append((h, h2))
        docs.append(np.array([d or 0 for d in ids], np.int64)[np.searchsorted(w.bounds, c, "right") - 1] if len(ids) else np.empty(0, np.int64))
    h, h2 = (np.concatenate([x[k] for x in prints]) for k in (0, 1))
    doc = np.concatenate(docs)
    at = (h % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((doc, h2, h, at))
    h, h2, doc, at = h[order], h2[order], doc[order], at[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
    number = np.empty(len(h), np.int64)
    number[order] = np.cumsum(first) - 1
    ends = np.cumsum([0, *(len(c) for _, _, c in kept)])
    kept = [(*x, number[a:z]) for x, a, z in zip(kept, ends[:-1], ends[1:])]
    return kept, np.column_stack([h[first], h2[first]]), doc[first], at[first]


def _post_windows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _parts(batches, buckets):
            _, h, doc, at = _lowest(p, buckets)
            cut = np.flatnonzero(np.diff(at, prepend=-1))
            ends = [*cut[1:], len(at)]
            if len(cut):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(at[cut], pa.int32()),
                        pa.array(np.full(len(cut), p.number), pa.int32()),
                        pa.array([h[a:z].tobytes() for a, z in zip(cut, ends)], pa.binary()),
                        pa.array([doc[a:z].tobytes() for a, z in zip(cut, ends)], pa.binary()),
                    ],
                    ["bucket", "part", "h", "doc"],
                )

    return run


def _reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each window of each part: has another part a smaller document with it?"""
    for bucket, rows in _by_bucket(batches).items():
        h = np.concatenate([np.frombuffer(r[1], np.uint64) for r in rows]).reshape(-1, 2)
        doc = np.concatenate([np.frombuffer(r[2], np.int64) for r in rows])
        order = np.lexsort((doc, h[:, 1], h[:, 0]))
        first = np.ones(len(h), bool)
        first[1:] = (h[order][1:] != h[order][:-1]).any(1)
        low = np.repeat(doc[order][first], np.diff(np.append(np.flatnonzero(first), len(h))))
        smaller = np.empty(len(h), bool)
        smaller[order] = low < doc[order]
        n = [len(r[2]) // 8 for r in rows]
        ends = np.cumsum(n)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array(np.full(len(rows), bucket), pa.int32()),
                pa.array([np.packbits(smaller[z - k : z]).tobytes() for k, z in zip(n, ends)], pa.binary()),
            ],
            ["part", "bucket", "data"],
        )


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _remove(buckets: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in _parts(batches, buckets):
            kept, _, low, at = _lowest(p, buckets)
            other = np.zeros(len(low), bool)
            cut = np.flatnonzero(np.diff(at, prepend=-1))
            for a, z in zip(cut, [*cut[1:], len(at)]):
                other[a:z] = p.bits[int(at[a])][: z - a]
            for ids, w, c, k in kept:
                doc = np.searchsorted(w.bounds, c, "right") - 1
                mine = np.array([d or 0 for d in ids], np.int64)
                gone = other[k] | (low[k] < mine[doc]) if len(c) else np.zeros(0, bool)
                cover = np.zeros(len(w.print) + 1, np.int32)
                cover[c[gone]] += 1  # windows begin once each
                cover[c[gone] + WINDOW] -= 1
                drop = np.cumsum(cover[:-1]) > 0
                yield _digests(ids, w, drop, with_text)

    return run


def _digests(ids: list, w: Words, drop: np.ndarray, with_text: bool) -> pa.RecordBatch:
    keep = np.flatnonzero(~drop)
    bounds = np.searchsorted(keep, w.bounds)
    size = w.end[keep] - w.first[keep] + 1  # each with a space after it
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    out[ragged(ends - size, size - 1)] = w.raw[ragged(w.first[keep], size - 1)]
    edge = np.concatenate([[0], ends])[bounds]
    whole = out.tobytes()
    texts = [whole[a : max(a, z - 1)] for a, z in zip(edge[:-1], edge[1:])]
    cols = [
        pa.array(ids, pa.int64()),
        pa.array(np.diff(w.bounds), pa.int64()),
        pa.array(np.diff(w.bounds) - np.diff(bounds), pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
    ]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    if with_text:
        cols.append(pa.array(texts, pa.binary()).cast(pa.string()))
        names.append("kept")
    return pa.RecordBatch.from_arrays(cols, names)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row; with ``with_text`` also the kept words."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    parts = min(MAX_PARTS, parts_of(rows, "text", part_bytes))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(parts)).cast("int"))
    shared = _shared(rows, parts)
    release(spark)  # the texts of one round are gone before those of the next are dealt out
    replies = _replies(rows, shared, parts)
    release(spark)
    return _dealt(rows, parts, [shared, replies]).mapInArrow(lean(_remove(parts, with_text)), RESULT + (", kept string" if with_text else ""))


def _shared(rows: DataFrame, parts: int) -> DataFrame:
    posted = rows.filter("doc is not null and text is not null").select("part", "text").mapInArrow(lean(_post_anchors(parts)), "bucket int, data binary")
    return stored(posted.repartitionById(parts, F.col("bucket")).mapInArrow(lean(_shared_anchors), "part int, bucket int, data binary"), "shared")


def _replies(rows: DataFrame, shared: DataFrame, parts: int) -> DataFrame:
    windows = _dealt(rows, parts, [shared]).mapInArrow(lean(_post_windows(parts)), "bucket int, part int, h binary, doc binary")
    return stored(windows.repartitionById(parts, F.col("bucket")).mapInArrow(lean(_reply), "part int, bucket int, data binary"), "replies")


def _dealt(rows: DataFrame, parts: int, told: list[DataFrame]) -> DataFrame:
    """What the parts are told (kinds 0 and 1) and their texts (kind 2), a part a task."""
    none, text = F.lit(None), F.lit(None).cast("string")
    out = rows.select("part", F.lit(2).alias("kind"), none.cast("int").alias("bucket"), none.cast("binary").alias("data"), "doc", "text")
    for k, t in enumerate(told):
        out = out.unionByName(t.select("part", F.lit(k).alias("kind"), "bucket", "data", none.cast("long").alias("doc"), text.alias("text")))
    return out.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind")


def oracle() -> str:
    """The query's rows in DuckDB's SQL, window by window."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     p AS (SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
     k AS (SELECT r, doc_id, i, w[i] AS word, CASE WHEN i + {WINDOW - 1} <= len(w) THEN array_to_string(w[i:i + {WINDOW - 1}], ' ') END AS win FROM p),
     low AS (SELECT win, min(doc_id) AS first FROM k WHERE win IS NOT NULL GROUP BY win),
     b AS (SELECT k.r, i, word, coalesce(first < doc_id, false) AS starts FROM k LEFT JOIN low ON k.win = low.win),
     g AS (SELECT r, i, word, bool_or(starts) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM b),
     s AS (SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM g GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (r)"""
