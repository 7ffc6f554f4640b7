"""Vector bin packing of token sequences (operator 3).

A sequence has three capacities: tokens, segments and loss-bearing tokens.  Each task packs the rows
of its own input partition, block by block, so no text is shuffled and nothing is gathered:

1. a document's ids are cut into whole ``max_tokens`` pieces and a remainder;
2. remainders of a block are placed by the dot-product heuristic (Panigrahy et al. 2011): into the
   open sequence goes the piece, of those that fit in all three dimensions, whose demand vector has
   the largest dot product with what the sequence has left, weighted by the mean demand;
3. what the emptiest sequences hold is cut to fill the gaps of the fullest, within all limits;
4. what is still not full is cut at powers of two, which need no padding.

Defined cases: a null text is an empty one (its only id is the end id); an empty table gives an empty
result; repeated rows are packed once each; other columns of the input, whatever their names, are
not read.  A very long text becomes many whole pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import lean
from .tokens import default_path, tokenizer_for

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence. ``block_items`` bounds what one packing call looks at."""

    max_tokens: int = 4096
    max_segments: int = 256
    max_loss_tokens: int = 4096
    block_items: int = 4096


@dataclass
class Piece:
    """ids[start:start+length] of document ``doc``; of its ids, those from ``prompt`` on bear loss."""

    doc: int
    start: int
    length: int
    prompt: int = 0

    @property
    def loss(self) -> int:
        return max(0, self.start + self.length - max(self.start, self.prompt))

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return Piece(self.doc, self.start, n, self.prompt), Piece(self.doc, self.start + n, self.length - n, self.prompt)


def place(pieces: list[Piece], lim: Limits) -> list[list[Piece]]:
    """Dot-product placement of pieces, none larger than the limits, into sequences."""
    kinds: dict[tuple[int, int], list[Piece]] = {}
    for p in pieces:
        kinds.setdefault((p.length, p.loss), []).append(p)
    if not kinds:
        return []
    shape = np.array(sorted(kinds, reverse=True), float)
    waiting = [kinds[tuple(map(int, k))] for k in shape]
    left = np.array([len(w) for w in waiting])
    cap = np.array([lim.max_tokens, lim.max_segments, max(1, lim.max_loss_tokens)], float)
    need = np.column_stack([shape[:, 0], np.ones(len(shape)), shape[:, 1]]) / cap
    weight = (need * left[:, None]).sum(0) / left.sum()
    gain = need * weight
    out: list[list[Piece]] = []
    while len(need):
        room, now = np.ones(3), []
        while True:
            fits = (need <= room + 1e-12).all(1) & (left > 0)
            if not fits.any():
                break
            k = int(np.argmax(np.where(fits, gain @ room, -1.0)))
            now.append(waiting[k].pop())
            left[k] -= 1
            room = room - need[k]
        if not now:
            raise ValueError("a piece is larger than an empty sequence")
        out.append(now)
        if (left == 0).sum() * 2 > len(left):  # forget the kinds that are used up
            keep = left > 0
            need, gain, left, waiting = need[keep], gain[keep], left[keep], [w for w, k in zip(waiting, keep) if k]
        elif not left.any():
            break
    return out


def fill(bins: list[list[Piece]], lim: Limits) -> list[list[Piece]]:
    """Cut the pieces of the emptiest sequences to fill the gaps of the fullest ones."""
    size = lambda b: sum(p.length for p in b)
    bins = sorted(bins, key=size, reverse=True)
    i, j = 0, len(bins) - 1
    gap = lim.max_tokens - size(bins[i]) if bins else 0
    while i < j:
        to = bins[i]
        loss = lim.max_loss_tokens - sum(p.loss for p in to)
        if gap <= 0 or len(to) >= lim.max_segments:
            i += 1
            gap = lim.max_tokens - size(bins[i])
            continue
        piece = bins[j].pop()
        n = min(gap, piece.length)
        while n and piece.cut(n)[0].loss > loss:
            n -= max(1, piece.cut(n)[0].loss - loss)
        n = max(0, n)
        head, rest = piece.cut(n)
        if n:
            to.append(head)
            gap -= n
        if rest.length:
            bins[j].append(rest)
            if n < min(gap + n, piece.length):  # the loss limit stops this sequence
                gap = 0
        if not bins[j]:
            j -= 1
    return [b for b in bins if b]


def halve(bin_: list[Piece], lim: Limits) -> list[list[Piece]]:
    """Sequences of power-of-two lengths from one that is not full."""
    total = sum(p.length for p in bin_)
    if total == lim.max_tokens:
        return [bin_]
    out, todo = [], list(reversed(bin_))
    for bit in range(total.bit_length() - 1, -1, -1):
        room, now = total & (1 << bit), []
        while room:
            p = todo.pop()
            if p.length > room:
                p, rest = p.cut(room)
                todo.append(rest)
            now.append(p)
            room -= p.length
        if now:
            out.append(now)
    return out


def pack(docs: list[tuple[int, int]], lim: Limits) -> list[list[Piece]]:
    """Sequences for documents given as (ids, ids before the first that bears loss)."""
    whole, rest = [], []
    step = min(lim.max_tokens, max(1, lim.max_loss_tokens))
    for k, (n, prompt) in enumerate(docs):
        full = n - n % step
        whole += [[Piece(k, s, step, prompt)] for s in range(0, full, step)]
        if n > full:
            rest.append(Piece(k, full, n - full, prompt))
    bins = place(rest, lim)
    if step < lim.max_tokens:
        bins += whole
        whole = []
    return whole + [s for b in fill(bins, lim) for s in halve(b, lim)]


def _rows(doc_ids: list, ids: list[np.ndarray], prompts: list[int], lim: Limits, first: int) -> tuple[pa.RecordBatch, int]:
    seqs = pack([(len(x), p) for x, p in zip(ids, prompts)], lim)
    cols: list[list] = [[] for _ in range(7)]
    for k, seq in enumerate(seqs):
        at = 0
        for p in seq:
            raw = ids[p.doc][p.start : p.start + p.length].astype("<u4").tobytes()
            for c, v in zip(cols, (doc_ids[p.doc], p.start, p.length, zlib.crc32(raw), len(ids[p.doc]), first + k, at)):
                c.append(v)
            at += p.length
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names), first + len(seqs)


def pack_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    prompt_col: str | None = None,
    tokenizer_path: str | None = None,
    end_id: int | None = 2,
    limits: Limits = Limits(),
) -> DataFrame:
    """Pack every document; one row a piece, with the columns of ``SCHEMA``.

    ``prompt_col`` (instruction data): how many of a row's first ids bear no loss; none if absent.
    ``sequence_id`` is the input partition's number and the sequence's number in it, so a task that
    runs again after a lost executor gives the same rows.
    """
    path = tokenizer_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok = tokenizer_for(path)
        tail = [] if end_id is None else [end_id]
        nxt = TaskContext.get().partitionId() << 32
        doc_ids: list = []
        ids: list[np.ndarray] = []
        prompts: list[int] = []
        held = 0
        for b in batches:
            new = b.column(0).to_pylist()
            pro = [int(p or 0) for p in b.column(2).to_pylist()]
            texts = b.column(1)
            for lo in range(0, len(new), 5000):
                enc = tok.encode(texts.slice(lo, 5000))
                enc = [np.append(x, tail).astype(np.uint32) for x in enc]
                doc_ids += new[lo : lo + 5000]
                prompts += pro[lo : lo + 5000]
                ids += enc
                held += sum(map(len, enc))
                if len(ids) >= limits.block_items or held > 6_000_000:
                    out, nxt = _rows(doc_ids, ids, prompts, limits, nxt)
                    yield out
                    doc_ids, ids, prompts, held = [], [], [], 0
        if ids:
            yield _rows(doc_ids, ids, prompts, limits, nxt)[0]

    prompt = F.col(prompt_col).cast("long") if prompt_col else F.lit(0).cast("long")
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), prompt).mapInArrow(lean(run, "tokens"), SCHEMA)
