"""Benchmark decontamination by pigeonhole edit matching (operator 5).

Texts and test items are compared in a plain form: lower case, each run of other than letters and
digits one space.  An item of m characters may differ from a passage by k = floor(ERROR_RATE * m)
edits.  It is split into k + 1 pieces; k edits leave at least one of them whole, so every passage
within the budget holds a piece exactly.  For the same reason at least one of the item's groups of g pieces has
g - 1 edits at most and holds a whole piece.  One Aho-Corasick pass over a whole text finds the pieces;
at the place that a hit implies Myers' bit-parallel distance verifies the piece's group, and then the
item, each free to begin and end anywhere near there.

Documents are searched where they lie.  The items are sent to the tasks in blocks of at most
``MAX_BLOCK_CHARS`` characters, one pass over the documents a block, so their size is bounded: a worker
holds 100 bytes a character, measured on 2 million.

Defined cases: null and empty texts hold no item; items of fewer than MIN_CHARS plain characters are
held where they stand word for word, between word bounds; items without any are not searched for; items with equal texts are all reported; rows that share an id are
searched each; an empty table on either side gives no matches; other columns are passed on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .memory import keeps, lean

ERROR_RATE, MIN_CHARS = 0.08, 16
MAX_BLOCK_CHARS = 2_000_000
GROUP = 4

_OTHER = re.compile(r"[\W_]+")


def plain(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def masks_of(item: str) -> dict[str, int]:
    """Where each character stands, as bits."""
    out: dict[str, int] = {}
    for k, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << k
    return out


def distance(item: str, masks: dict[str, int], window: str) -> int:
    """Least number of edits between the item and any part of the window; stops at 0."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    vp, vn, score, best = full, 0, m, m
    for c in window:
        x = masks.get(c, 0) | vn
        d0 = (((x & vp) + vp) ^ vp) | x
        hn = vp & d0
        hp = vn | (~(vp | d0) & full)
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
            if score < best:
                best = score
                if not best:
                    return 0
        x = (hp << 1) & full
        vn = x & d0
        vp = ((hn << 1) | ~(x | d0)) & full
    return best


class Matcher:
    """Items as (id, text)."""

    def __init__(self, items: list[tuple[int | None, str | None]], rate: float = ERROR_RATE, min_chars: int = MIN_CHARS) -> None:
        import ahocorasick

        ids: dict[str, list[int | None]] = {}
        for i, t in items:
            p = plain(t or "")
            if p:
                ids.setdefault(p, []).append(i)
        self.items = list(ids)
        self.ids = list(ids.values())
        self.short = [len(p) < min_chars for p in self.items]
        self.budget = [0 if s else int(rate * len(p)) for p, s in zip(self.items, self.short)]
        self.masks = [masks_of(p) for p in self.items]
        pieces: dict[str, list[tuple[int, int, tuple | None]]] = {}
        for n, p in enumerate(self.items):
            parts = self.budget[n] + 1
            cuts = [len(p) * j // parts for j in range(parts + 1)]
            for j in range(0, parts, GROUP):
                mine = cuts[j : j + GROUP + 1]
                text = p[mine[0] : mine[-1]]
                group = (mine[0], text, masks_of(text), len(mine) - 2) if parts > GROUP else None
                for a, b in zip(mine, mine[1:]):
                    pieces.setdefault(p[a:b], []).append((n, a, group))
        self.automaton = ahocorasick.Automaton()
        for s, where in pieces.items():
            self.automaton.add_word(s, (len(s), where))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def find(self, text: str | None) -> list[tuple[int | None, int]]:
        """(item id, edits) of the items that the text holds."""
        if self.empty or not text:
            return []
        t = plain(text)
        best: dict[int, int] = {}
        tried: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(t):
            for n, off, group in where:
                if best.get(n) == 0:
                    continue
                start, k = end + 1 - size - off, self.budget[n]
                seen = tried.setdefault(n, set())
                if start in seen:
                    continue
                seen.add(start)
                item = self.items[n]
                if self.short[n]:
                    if t[max(0, start - 1) : start] in ("", " ") and t[end + 1 : end + 2] in ("", " "):
                        best[n] = 0
                    continue
                if start >= 0 and t.startswith(item, start):
                    best[n] = 0
                    continue
                if group:
                    ga, text_g, masks_g, kg = group
                    if distance(text_g, masks_g, t[max(0, start + ga - kg) : max(0, start + ga + len(text_g) + kg)]) > kg:
                        seen.discard(start)
                        continue
                d = distance(item, self.masks[n], t[max(0, start - k) : max(0, start + len(item) + k)])
                if d <= k and d < best.get(n, k + 1):
                    best[n] = d
        return [(i, d) for n, d in best.items() for i in self.ids[n]]


_MATCHERS = keeps("decontaminate")

_HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType())]))
_HITS_ARROW = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))


def with_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rate: float = ERROR_RATE,
    min_chars: int = MIN_CHARS,
    max_block_chars: int = MAX_BLOCK_CHARS,
) -> DataFrame:
    """``docs`` as the struct ``row``, and ``hits``: an array of (item_id, distance)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).filter("t is not null")
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-chars // max_block_chars) if chars > max_block_chars else 1
    out = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"), F.lit(None).cast(_HITS).alias("hits"))
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k) if blocks > 1 else items
        held = spark.sparkContext.broadcast([(r["i"], r["t"]) for r in part.collect()])  # bounded by max_block_chars
        out = out.mapInArrow(lean(_searcher(held, rate, min_chars), "decontaminate"), out.schema)
    return out.select("row", F.coalesce("hits", F.array().cast(_HITS)).alias("hits"))


def _searcher(held, rate: float, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (held.id if hasattr(held, "id") else id(held), rate, min_chars)
        if key not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[key] = Matcher(held.value, rate, min_chars)
        m = _MATCHERS[key]
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                p = b.slice(lo, 1000)
                hits = [
                    (old or []) + [{"item_id": i, "distance": d} for i, d in m.find(t)]
                    for t, old in zip(p.column(1).to_pylist(), p.column(2).to_pylist())
                ]
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array(hits, _HITS_ARROW)], p.schema.names)

    return run


def matches(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, item_id, distance: a row for each item that a document holds."""
    rows = with_hits(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), benchmark, **options)
    return rows.select(F.col("row.doc_id"), F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.distance")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold an item."""
    return with_hits(docs, benchmark, **options).filter(F.size("hits") == 0).select("row.*")
