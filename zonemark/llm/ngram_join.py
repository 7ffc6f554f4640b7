"""N-gram Jaccard join with signature trees (operator 6): exact, over whole texts.

A document's set is its distinct shingles of five words (A-Z lower-cased).  Documents with
100 * |a & b| >= 80 * |a | b| link.

1. A task makes the sets of its texts.  Equal sets have one key and go on as one.  Of sets of more than
   128 shingles only those of a fixed half of the hash space take part in the search (sets of up to 160
   take part with all as well, so any two sets that can link meet in one of these two views).  A set with
   little in that half takes part with the other half, too: if a fifth of a set or less were there, no
   more than 0.36 of a set that it links with could be, so both are in the third view.
2. Packed postings go to buckets of shingles, where each shingle's number of sets is counted, up to
   ``FREQUENT``.  A shingle that a task alone has so often goes on from there, and the bucket hears only
   that it is frequent.  A set can miss at most a fifth of its size: more shingles that nobody else has,
   and it links with nothing.
3. The remaining sets name their rarest shingles, a fifth of their size and one (of any two sets that
   link both name one in common).  Sets with a common name and fitting sizes are connected, first within
   a task, which passes on one row a name and run of sizes.
4. The connected sets are clusters; a cluster's texts come together in a task, which builds a signature
   tree over their sets and links them by dual traversal, each link verified on the whole sets.  Clusters
   of many sets or shingles are cut by size bands and into parts; each pair of parts that can hold links
   is a task of its own, and the components of what they find are taken in Spark.

No list of pairs is made; a group of n near copies costs n links. What moves: seven bytes a shingle of
half the hash space, the shared ones once more, and the texts of clusters.  There are as many buckets as
the texts' bytes ask for, so what a task holds does not grow with the input.

Defined cases: a text with one to four words has its whole sequence as its only shingle; null texts and
texts without words have no shingles and link with nothing, also not through their id; rows without
doc_id link with nothing and have no component; other rows that share a doc_id are linked through it;
repeated texts are one set; an empty table gives an empty result; other columns are not read.  Shingles
are told apart by 64-bit fingerprints, sets by one more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .memory import lean
from .signature_tree import Links, SignatureTree
from .storage import few, parts_of, release, stored
from .tokens import ragged
from .words import fingerprints, mix, runs, slices

WIDTH, PERCENT = 5, 80
WHOLE_UP_TO, HALF_FROM, VIEWS = 160, 128, 3
#: A set with no more of its shingles in the half that is searched gives the other half as well.
THIN = 0.36
#: From so many sets on shingles are equally frequent.
FREQUENT = 1024
#: Sets of a cluster that one task takes, and their shingles; larger ones are cut.
CLUSTER_SETS, PART_SETS = 4000, 1500
CLUSTER_SHINGLES, PART_SHINGLES = 8_000_000, 3_000_000
#: Text bytes a bucket.
BUCKET_BYTES = 16_000_000


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(place of the first text, sorted distinct shingles of each)."""
    for at, part in slices(texts):
        w = fingerprints(part, fold_case=True)
        s = runs(w.print, WIDTH)
        out = []
        for a, b in zip(w.bounds[:-1], w.bounds[1:]):
            if b - a >= WIDTH:
                out.append(np.unique(s[a : b - WIDTH + 1]))
            elif b > a:
                h = w.print[a:b] * (np.arange(1, b - a + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
                out.append(mix(h.sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.empty(0, np.uint64))
        yield at, out


def set_key(s: np.ndarray) -> int:
    k = np.bitwise_xor.reduce(s, keepdims=True) * np.uint64(0x9E3779B97F4A7C15) + s.sum(keepdims=True) + np.uint64(len(s))
    return int(mix(k).view(np.int64)[0])


def _views(n: int, s: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if n <= WHOLE_UP_TO:
        yield 0, s
    if n > HALF_FROM:
        half = int(np.searchsorted(s, np.uint64(1) << np.uint64(63)))
        yield 1, s[:half]
        if half <= THIN * n + 1:
            yield 2, s[half:]


def _row(kind: int, bucket: int, *cols: np.ndarray) -> tuple:
    return (kind, bucket, *[c.tobytes() for c in cols], *[b""] * (4 - len(cols)))


def _home(ref: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that what concerns a set goes to: the same for up to 256 sets of a task."""
    return (mix((ref >> 8).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)


_PACKED = "kind int, bucket int, a binary, b binary, c binary, d binary"
_DOC, _SET, _POST, _SHARED, _HOT = 0, 1, 2, 3, 4


def _by_bucket(kind: int, bucket: np.ndarray, *cols: np.ndarray, each: np.ndarray | None = None) -> list[tuple]:
    """A row a bucket of columns that are sorted by bucket, or are put in that order."""
    if len(bucket) and (np.diff(bucket) < 0).any():
        order = np.argsort(bucket, kind="stable")
        bucket, cols = bucket[order], [c[order] for c in cols]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    more = [] if each is None else [each]
    return [_row(kind, int(bucket[a]), *[c[a:z] for c in cols], *more) for a, z in zip(cut, [*cut[1:], len(bucket)])]


def _low(tok: np.ndarray) -> np.ndarray:
    """The five low bytes of tokens: all that a bucket has to be told."""
    return np.ascontiguousarray(tok).view(np.uint8).reshape(-1, 8)[:, :5]


def _outside(tok: np.ndarray, buckets: int) -> np.ndarray:
    """Tokens as they are called out of their buckets."""
    return tok.astype(np.int64) & ((1 << 40) - 1) | _bucket(tok, buckets) << 40


def _bucket(tok: np.ndarray, buckets: int) -> np.ndarray:
    return (tok >> np.uint64(41)).astype(np.int64) % buckets


def _whole(low: bytes) -> np.ndarray:
    five = np.frombuffer(low, np.uint8).reshape(-1, 5)
    out = np.zeros((len(five), 8), np.uint8)
    out[:, :5] = five
    return out.view(np.int64).ravel()


def _often(tok: np.ndarray, least: int) -> np.ndarray:
    """The tokens that stand there ``least`` times or more."""
    s = np.sort(tok)
    if len(s) < least:
        return s[:0]
    return np.unique(s[: len(s) - least + 1][s[least - 1 :] == s[: len(s) - least + 1]])


def _shared_rows(tok: np.ndarray, ref: np.ndarray, df: np.ndarray, buckets: int) -> list[tuple]:
    """What the sets' homes are told: set, token, number of sets."""
    return _by_bucket(_SHARED, _home(ref, buckets), ref, tok, df.astype(np.uint16))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["kind", "bucket", "a", "b", "c", "d"])


def _postings(buckets: int, frequent: int):
    """Documents, sets and packed postings of a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        seen: dict[int, int] = {}
        nxt = 0

        def flush() -> pa.RecordBatch:
            rows = []
            if ids:
                rows.append(_row(_DOC, base % buckets, *[np.array(x, np.int64) for x in (ids, doc_n, doc_key, doc_text)]))
            if keys:
                cols = [np.array(x, np.int64) for x in (keys, sizes)]
                seen_in = np.array(views, np.int64).T
                refs = base + first + np.arange(len(keys))
                at = _home(refs, buckets)
                for b in np.unique(at):
                    m = at == b
                    rows.append(_row(_SET, int(b), refs[m], cols[0][m], cols[1][m], seen_in[:, m]))
                t = np.concatenate(toks)
                w = np.repeat(np.array([x for x, _ in who], np.int64), [x for _, x in who])
                often = _often(t, frequent)
                if len(often):
                    hot = np.isin(t, often)
                    rows += _shared_rows(_outside(t[hot], buckets), refs[w[hot]], np.full(int(hot.sum()), frequent), buckets)
                    rows += _by_bucket(_HOT, _bucket(often, buckets), _low(often))
                    t, w = t[~hot], w[~hot]
                bk = _bucket(t, buckets)
                order = np.argsort(bk.astype(np.uint16) if buckets < 65536 else bk, kind="stable")
                t, w, bk = t[order], w[order].astype(np.uint16), bk[order]
                rows += _by_bucket(_POST, bk, _low(t), w, each=np.array([base + first], np.int64))
            return _batch(rows) if rows else None

        def clear():
            return [], [], [], [], [], [], [], [], [], nxt

        ids, doc_text, doc_n, doc_key, keys, sizes, views, toks, who, first = clear()
        held = 0
        for b in batches:
            doc_ids, prints = b.column(0).to_pylist(), b.column(2).to_pylist()
            for at, sets in shingle_sets(b.column(1)):
                for d, p, s in zip(doc_ids[at : at + len(sets)], prints[at : at + len(sets)], sets):
                    n = len(s)
                    key = set_key(s) if n else 0
                    ids.append(-1 if d is None else d)
                    doc_n.append(-1 - n if d is None else n)
                    doc_key.append(key)
                    doc_text.append(p)
                    if not n or d is None or seen.get(key) == n:
                        continue
                    if len(seen) > 2_000_000:
                        seen.clear()
                    seen[key] = n
                    k = len(keys)
                    keys.append(key)
                    sizes.append(n)
                    v = [0, 0, 0]
                    for view, part in _views(n, s):
                        v[view] = len(part)
                        toks.append(part << np.uint64(2) | np.uint64(view))
                        who.append((k, len(part)))
                        held += len(part)
                    views.append(v)
                    nxt += 1
                    if len(keys) >= 65_000 or held > 2_500_000:
                        yield flush()
                        ids, doc_text, doc_n, doc_key, keys, sizes, views, toks, who, first = clear()
                        held = 0
                if len(ids) > 500_000:
                    yield flush()
                    ids, doc_text, doc_n, doc_key, keys, sizes, views, toks, who, first = clear()
                    held = 0
        last = flush()
        if last is not None:
            yield last

    return run


def _gather(batches: Iterator[pa.RecordBatch], through: tuple[int, ...]) -> Iterator[tuple[pa.RecordBatch | None, dict]]:
    """Passes rows of some kinds on at once; the others by bucket at the end."""
    mine: dict[int, list[tuple]] = {}
    for b in batches:
        kind = b.column(0).to_numpy()
        other = np.isin(kind, through)
        if other.any():
            yield b.filter(pa.array(other)), {}
        for k in np.flatnonzero(~other):
            row = tuple(b.column(c)[int(k)].as_py() for c in range(6))
            mine.setdefault(row[1], []).append(row)
    yield None, mine


def _count_shared(buckets: int, frequent: int):
    """Postings of a bucket: those of shingles that several sets have go back to the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for through, mine in _gather(batches, (_DOC, _SET, _SHARED)):
            if through is not None:
                yield through
            for bucket, rows in mine.items():
                post = [r for r in rows if r[0] == _POST]
                if not post:
                    continue
                tok = np.concatenate([_whole(r[2]) for r in post])
                ref = np.concatenate([np.frombuffer(r[3], np.uint16) + np.frombuffer(r[4], np.int64) for r in post])
                order = np.argsort(tok, kind="stable")
                tok, ref = tok[order], ref[order]
                cut = np.flatnonzero(np.diff(tok, prepend=-1))
                n = np.diff(np.append(cut, len(tok)))
                hot = [_whole(r[2]) for r in rows if r[0] == _HOT]
                df = np.minimum(n, frequent)
                if hot:
                    df[np.isin(tok[cut], np.concatenate(hot))] = frequent
                df = np.repeat(df, n)
                keep = df > 1
                if keep.any():
                    yield _batch(_shared_rows(tok[keep] | bucket << 40, ref[keep], df[keep], buckets))

    return run


#: A document has no lo; a run of sets with a name in common goes from lo to n; an edge goes from key to lo.
_NAMED = "doc long, print long, n long, key long, tok long, lo long"


def _name(buckets: int):
    """Sets that can link, with their rarest shared shingles; and the documents."""

    def out(*cols) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], ["doc", "print", "n", "key", "tok", "lo"])

    def names(mine: dict[int, list[tuple]]) -> Iterator[pa.RecordBatch]:
        for rows in mine.values():
            sets = [r for r in rows if r[0] == _SET]
            post = [r for r in rows if r[0] == _SHARED]
            if not sets or not post:
                continue
            ref, key, n = (np.concatenate([np.frombuffer(r[c], np.int64) for r in sets]) for c in (2, 3, 4))
            views = np.concatenate([np.frombuffer(r[5], np.int64).reshape(VIEWS, -1) for r in sets], axis=1)
            order = np.argsort(ref)
            ref, key, n, views = ref[order], key[order], n[order], views[:, order]
            p, tok = (np.concatenate([np.frombuffer(r[c], np.int64) for r in post]) for c in (2, 3))
            df = np.concatenate([np.frombuffer(r[4], np.uint16) for r in post])
            who, view = np.searchsorted(ref, p), tok & 3
            for v in range(VIEWS):
                m = view == v
                w, t, d = who[m], tok[m], df[m]
                shared = np.bincount(w, minlength=len(ref))
                left = n // 5 + 1 - (views[v] - shared)  # names to give
                order = np.lexsort((t, d, w))
                w, t = w[order], t[order]
                start = np.cumsum(shared) - shared
                take = np.where(shared > 0, np.clip(left, 0, shared), 0)
                at = ragged(start, take)
                if len(at):
                    w, t = w[at], t[at]
                    yield _run_rows(t, key[w], n[w], n[w])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for through, mine in _gather(batches, (_DOC,)):
            if through is not None:
                for cols in zip(*(through.column(k).to_pylist() for k in (2, 3, 4, 5))):
                    ids, n, key, text = (np.frombuffer(x, np.int64) for x in cols)
                    nobody = pa.nulls(len(ids), pa.int64())
                    yield out(pa.array(ids, mask=n < 0), text, np.where(n < 0, -1 - n, n), key, nobody, nobody)
            for r in _connect(names(mine)):
                tok, key, lo, hi = r.columns
                nobody = pa.nulls(r.num_rows, pa.int64())
                yield out(nobody, nobody, hi, key, tok, lo)

    return run


_RUNS = "tok long, key long, lo long, hi long"


def _run_rows(*cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.astype(np.int64)) for c in cols], ["tok", "key", "lo", "hi"])


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (name, key, lo, hi): sets with a name, of sizes from lo to hi without a gap that is too wide,
    that are connected to the set ``key``.  Joins runs of one name whose sizes meet or fit; gives one row
    a run, and the edges (null, key, smallest key of its run, 0)."""

    def joined(tok, key, lo, hi) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((key, hi, lo, tok))
        tok, key, lo, hi = tok[order], key[order], lo[order], hi[order]
        first = np.flatnonzero(np.diff(tok, prepend=tok[0] - 1 if len(tok) else 0))
        # the largest size so far, of the name; names have numbers that are apart by more than any size
        step = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(tok)))) << 40
        reach = np.maximum.accumulate(hi + step) - step
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (100 * reach[:-1] < PERCENT * lo[1:])
        start = np.flatnonzero(new)
        low, size = np.minimum.reduceat(key, start), np.diff(np.append(start, len(key)))
        to = np.repeat(low, size)
        pairs = np.unique(np.column_stack([key, to])[to != key], axis=0)
        for at in range(0, len(pairs), 50_000):
            p = pairs[at : at + 50_000]
            yield _run_rows(pa.nulls(len(p), pa.int64()), p[:, 0], p[:, 1], np.zeros(len(p)))
        yield _run_rows(tok[start], low, lo[start], np.maximum.reduceat(hi, start))

    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) > 2_000_000:
            done = list(joined(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in range(4))))
            yield from done[:-1]
            held = done[-1:]
            if held[0].num_rows > 1_000_000:
                yield held.pop()
    if held:
        yield from joined(*(np.concatenate([x.column(c).to_numpy() for x in held]) for c in range(4)))


def _edges(named: DataFrame, tasks: int) -> DataFrame:
    """(a, b): the sets that a name in common connects. The runs of a task were joined before they move."""
    runs = named.filter("tok is not null").select("tok", "key", "lo", F.col("n").alias("hi"))
    far = runs.repartition(tasks, "tok").mapInArrow(lean(_connect), _RUNS).filter("tok is null")
    near = named.filter("tok is null and lo is not null")
    return near.select(F.col("key").alias("a"), F.col("lo").alias("b")).unionByName(far.select(F.col("key").alias("a"), F.col("lo").alias("b")))


def _link_clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, key, text) sorted by group: edges (key, smallest key of its component there)."""
    now, keys, sets = None, [], []

    def done() -> Iterator[pa.RecordBatch]:
        if len(keys) < 2:
            return
        order = sorted(range(len(keys)), key=lambda k: (len(sets[k]), sets[k][: min(4, len(sets[k]))].tolist()))
        tree = SignatureTree([sets[k] for k in order])
        links: Links = tree.link(PERCENT)
        k = np.array([keys[o] for o in order], np.int64)
        low = np.full(len(k), np.iinfo(np.int64).max)
        np.minimum.at(low, links.label, k)
        low = low[links.label]
        m = low != k
        if m.any():
            yield pa.RecordBatch.from_arrays([pa.array(k[m]), pa.array(low[m])], ["a", "b"])

    for b in batches:
        group, key = b.column(0).to_pylist(), b.column(1).to_pylist()
        for at, part in shingle_sets(b.column(2)):
            for g, k, s in zip(group[at:], key[at:], part):
                if g != now:
                    yield from done()
                    now, keys, sets = g, [], []
                keys.append(k)
                sets.append(s)
    yield from done()


def link_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    cluster_sets: int = CLUSTER_SETS,
    part_sets: int = PART_SETS,
    cluster_shingles: int = CLUSTER_SHINGLES,
    part_shingles: int = PART_SHINGLES,
    bucket_bytes: int = BUCKET_BYTES,
    frequent: int = FREQUENT,
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    # a row's text is found again by id and print: rows may share an id
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"), F.xxhash64(text).alias("print"))
    buckets = parts_of(rows, "text", bucket_bytes)
    named = stored(_named(rows, buckets, frequent), "named")
    release(spark)
    infos = named.filter("lo is null").select("doc", "print", "n", "key")
    real = infos.filter("doc is not null and n > 0")
    by_key = stored(real.groupBy("key").agg(F.min("doc").alias("low"), F.min(F.struct("doc", "print")).alias("one"), F.first("n").alias("n")), "sets")
    clusters = components(_edges(named, buckets), reduced=True)
    clusters = stored(clusters.select(F.col("node").alias("key"), F.col("component").alias("cluster")), "clusters")
    # one text a set
    first = few(clusters).join(by_key, "key").select("key", "cluster", "n", F.col("one.doc").alias("doc"), F.col("one.print").alias("print"))
    first = stored(_groups(stored(first, "first"), cluster_sets, part_sets, cluster_shingles, part_shingles), "groups")
    texts = rows.filter("doc is not null").join(few(first), ["doc", "print"]).select("group", "key", "text")
    found = texts.repartition("group").sortWithinPartitions("group").mapInArrow(lean(_link_clusters), "a long, b long")
    found = stored(found.distinct().unionByName(_same_id(real)), "links")
    release(spark)
    sets = stored(components(found, reduced=True).withColumnRenamed("node", "key"), "linked")
    # from keys to smallest ids: by_key has a row a key, and no join has an aggregate below it, so Spark
    # can split what is left of a large group
    named_sets = by_key.select("key", "low").join(few(sets), "key", "left").withColumn("g", F.coalesce("component", "key"))
    by_group = stored(named_sets.groupBy("g").agg(F.min("low").alias("component_id")), "low")
    comp = stored(named_sets.select("key", "g").join(by_group, "g").select("key", "component_id"), "by_key")
    out = infos.withColumn("key", F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.col("key"))).join(comp, "key", "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))


def _named(rows: DataFrame, buckets: int, frequent: int) -> DataFrame:
    packed = rows.select("doc", "text", "print").mapInArrow(lean(_postings(buckets, frequent)), _PACKED)
    packed = packed.repartitionById(buckets, F.col("bucket")).mapInArrow(lean(_count_shared(buckets, frequent)), _PACKED)
    return packed.repartitionById(buckets, F.col("bucket")).mapInArrow(lean(_name(buckets)), _NAMED)


def _same_id(real: DataFrame) -> DataFrame:
    """Edges between the sets of rows that share an id."""
    shared = real.groupBy("doc").agg(F.min("key").alias("b"), F.max("key").alias("_hi")).filter("b <> _hi").select("doc", "b")
    shared = stored(shared, "shared")
    if not shared.take(1):
        return shared.select(F.col("b").alias("a"), "b")
    return real.join(few(shared), "doc").filter("key <> b").select(F.col("key").alias("a"), "b").distinct()


def _groups(first: DataFrame, cluster_sets: int, part_sets: int, cluster_shingles: int, part_shingles: int) -> DataFrame:
    """doc, print, key, group: a cluster is one group, or one a pair of parts if it is large."""
    size = first.groupBy("cluster").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("total"))
    large = stored(size.filter((F.col("sets") > cluster_sets) | (F.col("total") > cluster_shingles)).select("cluster"), "large")
    whole = F.xxhash64("cluster").alias("group")
    if not large.take(1):
        return first.select("doc", "print", "key", whole)
    small = first.join(few(large), "cluster", "left_anti").select("doc", "print", "key", whole)
    step = math.log(100 / PERCENT)
    # sizes that can link are in one band or in neighbouring ones
    band = first.join(few(large), "cluster").withColumn("band", F.floor(F.log("n") / step + 1e-9))
    parts = band.groupBy("cluster", "band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / part_sets), F.ceil(F.sum("n") / part_shingles)).alias("parts"))
    parts = stored(parts, "parts")
    near = parts.select("cluster", (F.col("band") - 1).alias("band"), F.col("parts").alias("above"))
    under = parts.select("cluster", (F.col("band") + 1).alias("band"), F.col("parts").alias("below"))
    x = band
    for side in (parts, near, under):
        x = x.join(few(side), ["cluster", "band"], "left")
    x = x.withColumn("p", F.pmod(F.xxhash64("key"), F.col("parts")))
    up_to = lambda c: F.sequence(F.lit(0), F.coalesce(F.col(c), F.lit(0)).cast("int") - 1)
    # pair of parts as (band, part, band, part), the smaller first
    own = F.transform(up_to("parts"), lambda q: F.xxhash64("cluster", F.lit(0), "band", F.least("p", q.cast("long")), F.greatest("p", q.cast("long"))))
    above = F.when(F.col("above") > 0, F.transform(up_to("above"), lambda q: F.xxhash64("cluster", F.lit(1), "band", "p", q.cast("long"))))
    below = F.when(F.col("below") > 0, F.transform(up_to("below"), lambda q: F.xxhash64("cluster", F.lit(1), F.col("band") - 1, q.cast("long"), "p")))
    none = F.array().cast("array<bigint>")
    cut = x.select("doc", "print", "key", F.explode(F.concat(own, F.coalesce(above, none), F.coalesce(below, none))).alias("group"))
    return small.unionByName(cut)


def oracle() -> str:
    """The query's rows in DuckDB's SQL: sets with a shingle in common, pair by pair. For small tables."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     g AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= {WIDTH} THEN list_transform(range(1, len(w) - {WIDTH - 2}), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))
                                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END)) AS sh FROM d),
     one AS (SELECT min(doc_id) AS low, sh, len(sh) AS n FROM g WHERE len(sh) > 0 GROUP BY sh),
     s AS (SELECT low, n, unnest(sh) AS t FROM one),
     pairs AS (SELECT a.low AS a, b.low AS b FROM s a JOIN s b ON a.t = b.t AND a.low < b.low AND 100 * least(a.n, b.n) >= {PERCENT} * greatest(a.n, b.n)
               GROUP BY a.low, b.low, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))),
     e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
     reach AS (SELECT low AS v, low AS u FROM one UNION SELECT reach.v, e.b FROM reach JOIN e ON reach.u = e.a),
     comp AS (SELECT v, min(u) AS component FROM reach GROUP BY v)
SELECT g.doc_id, CAST(len(g.sh) AS BIGINT) AS n_shingles, coalesce(component, g.doc_id) AS component_id
FROM g LEFT JOIN one ON g.sh = one.sh LEFT JOIN comp ON one.low = comp.v"""
