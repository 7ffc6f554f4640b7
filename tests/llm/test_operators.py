"""The operators against brute force, round trips and held-out labels, and on odd tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from zonemark.llm import ann, decontaminate, line_dedup, ngram_join, packing, pfor, queries, sharding, signature_tree, storage, substring_dedup, tokens, toxicity, url_filter, words
from zonemark.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hits string, row string, part int"


def frame(spark, texts, first=0):
    """Documents, with columns whose names operators might use themselves."""
    rows = [(first + k if not isinstance(t, tuple) else t[0], t[1] if isinstance(t, tuple) else t, "en", None if k % 7 == 6 else f"src{k % 2}", None, "x", "y", k) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(150)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = [text(rng.randint(30, 220)) for _ in range(30)]
    out = [None, "", "   \n\t ", "one", "one two three", "ONE two  three", "A b\x0bc d\xa0e", base[0], base[0], base[0].upper()]
    out += base
    for b in base[:15]:
        for _ in range(4):
            w = b.split()
            for _ in range(rng.randint(1, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            out.append(" ".join(w))
    passage = text(60)
    out += [f"{text(rng.randint(5, 40))} {passage} {text(rng.randint(0, 30))}" for _ in range(12)]
    out += [" ".join(["la"] * n) for n in (5, 13, 14, 40, 300)] + [" ".join(["la", "lo"] * 30), text(3) + " " + " ".join(["la"] * 20)]
    out.append(" ".join([text(3000)] * 2))
    return out


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return frame(spark, corpus).repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_steps_are_kept_in_the_shared_folder_and_cleared(spark):
    """One machine may do without the setting; several must have it."""
    kept = storage.stored(spark.range(5), "five")
    folder = storage.shared_folder(spark)
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir")) and all(f.startswith(folder.replace("file://", "file:")) or folder in f for f in kept.inputFiles())
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    storage.stored(kept, "again")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_folder(Cluster)
    Cluster.sparkContext.master = "local[4]"
    assert storage.shared_folder(Cluster).startswith("file:///tmp/")


# ---- 1 ----------------------------------------------------------------------------------------------------


def boilerplate(rows, ratio, least):
    """(host, line) pairs to drop, of rows (host, text)."""
    pages = collections.Counter(h for h, _ in rows)
    seen = collections.Counter((h, x) for h, t in rows for x in set((t or "").split("\n")) if t is not None)
    return {hl for hl, n in seen.items() if n >= least and n > ratio * pages[hl[0]] and hl[1].strip(" \t\n\x0b\x0c\r")}


@pytest.mark.parametrize("few", [{}, {"broadcast_lines": 0}, {"host_lines": 1}])
def test_line_dedup_against_brute_force(spark, few):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["menu", "menu", "foot", " ", "\t", "", "\xa0", f"own {k}", f"own {k + 1}"]) for _ in range(6)) for k in range(60)] + [None, "", "menu"]
    df = frame(spark, texts)
    got = {r.doc_id: r for r in line_dedup.drop_boilerplate(df, counts=True, ratio=0.2, min_pages=5, **few).collect()}
    host = [None if k % 7 == 6 else k % 2 for k in range(len(texts))]
    bad = boilerplate(list(zip(host, texts)), 0.2, 5)
    assert bad and "\xa0" in {x for _, x in bad}
    for k, t in enumerate(texts):
        want = None if t is None else "\n".join(x for x in t.split("\n") if (host[k], x) not in bad)
        assert got[k].text == want and got[k].hits == "x"
        assert got[k].n_lines - got[k].n_removed == (0 if t is None else sum((host[k], x) not in bad for x in t.split("\n")))
    assert line_dedup.drop_boilerplate(empty(spark), **few).count() == 0


@pytest.mark.parametrize("few", [{}, {"broadcast_lines": 0}])
def test_line_dedup_on_hosts_of_all_sizes(spark, few):
    """The ratio decides, on a host of two pages as on one of 400; rows that repeat or share ids are pages each."""
    rows = [(None if k % 3 else 7, f"own {size} {k}" + ("\nfoot" if k <= share * size else ""), f"h{size}") for size in (1, 2, 9, 40, 400) for share in (0.04, 0.06) for k in range(size)]
    rows += [(1, "same\nrow", "copies")] * 3 + [(1, "other", "copies")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    bad = boilerplate([(h, t) for _, t, h in rows], line_dedup.RATIO, line_dedup.MIN_PAGES)
    assert {h for h, x in bad if x == "foot"} >= {"h2", "h9"} and ("copies", "row") in bad
    want = sorted((h, "\n".join(x for x in t.split("\n") if (h, x) not in bad)) for _, t, h in rows)
    assert sorted((r.source, r.text) for r in line_dedup.drop_boilerplate(df, **few).collect()) == want


# ---- 2 ----------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_keeps_held_out_labels_out(spark):
    rng = random.Random(5)
    say = lambda n, bad: " ".join(rng.choice(["vile", "scummy"]) if bad and rng.random() < 0.15 else "".join(rng.choice("aeioutnr") for _ in range(4)) for _ in range(n))
    toxic = [rng.random() < 0.3 for _ in range(700)]
    df = frame(spark, [say(rng.randint(20, 60), t) for t in toxic] + [None, ""])
    labels = spark.createDataFrame([(k, int(t), "z") for k, t in enumerate(toxic)], "doc_id long, toxic int, text string")
    got = {r.doc_id: r for r in toxicity.score_documents(df, labels).collect()}
    assert len(got) == 702 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [k for k in range(700) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (k in set(held)) for k in range(700))
    assert sum(got[k].predicted == toxic[k] for k in held) >= 0.9 * len(held)
    flipped = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score_documents(df, flipped).collect()}
    assert again == {k: r.score for k, r in got.items()}
    assert {r.score for r in toxicity.score_documents(df, labels.limit(0)).collect()} == {0.0}
    kept = toxicity.score_documents(df, labels, with_row=True)
    assert kept.select("row.*").columns == df.columns and kept.count() == 702
    assert toxicity.score_documents(empty(spark), labels).count() == 0


def kneser_ney(texts, labels):
    """Probability of the last symbol of an n-gram, by class, worked out from dictionaries."""
    order = toxicity.ORDER
    syms = [[32] * (order - 1) + [int(x) for x in toxicity._SYMBOL[np.frombuffer((t or "").encode(), np.uint8)]] for t in texts]
    count = [collections.Counter(), collections.Counter()]
    for s, y in zip(syms, labels):
        for k in range(order - 1, len(s)):
            count[1 - y][tuple(s[k - order + 1 : k + 1])] += 1  # toxic first
    levels = {order: count}
    for k in range(order - 1, 1, -1):
        levels[k] = [collections.Counter(g[1:] for g in levels[k + 1][c]) for c in (0, 1)]
    share = lambda n: (lambda a, b: a / (a + 2 * b) if a and b else 0.5)(list(n).count(1), list(n).count(2))
    pairs = levels[2][0] + levels[2][1]
    low = collections.Counter(b for _, b in pairs)
    dd, all_low = share(pairs.values()), sum(low[b] + 0.5 for b in range(256))

    def p(g, c):
        ctx = [n for (a, _), n in pairs.items() if a == g[-2]]
        total = max(1, sum(ctx))
        out = max(pairs[tuple(g[-2:])] - dd, 0) / total + (dd * len(ctx) / total if ctx else 1) * (low[g[-1]] + 0.5) / all_low
        for k in range(3, order + 1):
            n, d, own = levels[k][c], share(levels[k][c].values()), tuple(g[-k:])
            seen = [v for x, v in n.items() if x[:-1] == own[:-1]]
            if seen:
                out = max(n[own] - d, 0) / sum(seen) + d * len(seen) / sum(seen) * out
        return out

    return syms, p


def test_toxicity_models_by_hand(spark):
    texts = ["you vile scum", "a vile thing, scum!", "vile é vile", "a calm day", "the calm sea and a day", "sea of days", "", None]
    labels = [1, 1, 1, 0, 0, 0, 0, 1]
    syms, p = kneser_ney(texts, labels)
    rows = spark.createDataFrame(list(zip(texts, labels)), "text string, toxic int")
    model = toxicity.fit(rows)
    held = spark.sparkContext.broadcast(model)
    more = texts + ["a vile sea", "zzz vile é day of calm scum and thing"]
    odd = kneser_ney(more, [0] * len(more))[0]
    got = toxicity.compared(spark.createDataFrame(list(enumerate(more)), "n int, text string"), "text", held).collect()
    for r in got:
        s = odd[r.n]
        each = [np.log(p(s[: k + 1], 0)) - np.log(p(s[: k + 1], 1)) for k in range(toxicity.ORDER - 1, len(s))]
        assert r.n_symbols == len(each) and abs(r.llr - (np.mean(each) if each else 0)) < 1e-4
        w = toxicity.WINDOW
        runs = [np.mean(each[k : k + w]) for k in range(max(1, len(each) - w + 1))] if each else [0]
        assert abs(r.peak - max(runs)) < 1e-4
    for c in (0, 1):
        for ctx in (syms[0][5:8], syms[4][6:9], [1, 2, 3]):
            assert abs(sum(p([*ctx, b], c) for b in range(256)) - 1) < 1e-9


def test_toxicity_defined_cases(spark):
    df = frame(spark, [(None, "a vile text"), (3, "x " * 200_000), (3, "vile"), (4, None), (5, "")])
    for labels, want in (([], 0.0), ([(3, 1), (4, 1)], 1.0), ([(3, 0)], 0.0)):
        given = spark.createDataFrame(labels, "doc_id long, toxic int")
        assert [r.score for r in toxicity.score_documents(df, given).collect()] == [want] * 5
    both = spark.createDataFrame([(k, k % 2) for k in range(1, 60)] + [(3, 0)], "doc_id long, toxic int")
    many = df.unionByName(frame(spark, [f"{'vile' if k % 2 else 'calm'} words {k}" for k in range(60)], 0))
    got = toxicity.score_documents(many, both).collect()
    assert len(got) == 65 and all(0 <= r.score <= 1 for r in got) and all(r.held_out for r in got if r.doc_id is None)


def test_toxicity_tables_hold_every_gram(spark):
    """What was not counted takes nobody's mass, however many n-grams there are."""
    n = 600_000
    grams = np.random.default_rng(3).permutation(2 * n).astype(np.uint32)
    rows = spark.createDataFrame(pa.table({"gram": grams[:n].astype(np.int64), "a": grams[:n] % 7 + 1.0, "b": grams[:n] % 5 + 1.0}))
    got = toxicity._table(rows, 0.0).open().of(grams.astype(np.uint64))
    assert (got[:n] == np.stack([grams[:n] % 7 + 1, grams[:n] % 5 + 1], axis=1)).all() and not got[n:].any()


# ---- 3, 10 ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def raw_tokens(corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return {k: t.encode(x or "", add_special_tokens=False).ids for k, x in enumerate(corpus)}


def test_tokens_are_the_tokenizers(corpus, raw_tokens):
    odd = ["İstanbul <|endoftext|> x<|startoftext|>y <|ENDOFTEXT|> d'être we'RE 12.5% ...,, a,b. ﬁ ſ ß, 日本語。 a\x1cb c\x85d ª² ẋ Σας ΟΔΟΣ. K", None]
    tok = tokens.ChunkTokenizer(tokens.default_path(), max_known=100)
    for k in range(0, len(corpus), 40):
        part = pa.array(corpus).slice(k, 40)
        assert [x.tolist() for x in tok.encode(part)] == [raw_tokens[k + j] for j in range(len(part))]
    assert [x.tolist() for x in tok.encode(pa.array(odd))] == [tok.raw.encode(x or "", add_special_tokens=False).ids for x in odd]


def test_tokens_of_another_tokenizer(corpus):
    """Whose texts cannot be taken apart in the same way."""
    import public_tokenizers

    tok = tokens.ChunkTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert tok.whole_texts and not tokens.ChunkTokenizer(tokens.default_path()).whole_texts
    texts = corpus[:20] + ["Case  and   spaces, it's <|endoftext|> 12"]
    assert [x.tolist() for x in tok.encode(pa.array(texts))] == [tok.raw.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_tokens_of_random_texts():
    rng = random.Random(3)
    letters = list("abcdeZÉéßİ'.,!?-_#$%&*()[]{}<>|~`^@+=/\\\"0123 \n\t \u0308\u0958é日本ſªσς½")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(8000)]
    tok = tokens.ChunkTokenizer(tokens.default_path())
    assert all(a.tolist() == tok.raw.encode(b, add_special_tokens=False).ids for a, b in zip(tok.encode(pa.array(texts)), texts))


@pytest.mark.parametrize("limits", [packing.Limits(), packing.Limits(256, 4, 200, 50), packing.Limits(64, 2, 64, 1000)])
def test_packing_keeps_every_id_within_the_limits(spark, docs, raw_tokens, limits):
    rows = packing.pack_documents(docs, limits=limits).collect()
    pieces, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        ids = np.array([*raw_tokens[r.doc_id], 2], "<u4")
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        seqs[r.sequence_id].append((r.offset, r.length))
    for k, ids in raw_tokens.items():
        at = 0
        for s, n in sorted(pieces[k]):
            assert s == at and n > 0
            at += n
        assert at == len(ids) + 1
    padding = 0
    for parts in seqs.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        n = sum(n for _, n in parts)
        assert n <= min(limits.max_tokens, limits.max_loss_tokens) and len(parts) <= limits.max_segments
        padding += limits.max_tokens - n if n & (n - 1) else 0
    assert padding == 0
    assert packing.pack_documents(empty(spark)).count() == 0


def test_vector_packing_respects_loss():
    rng = random.Random(1)
    lim = packing.Limits(100, 3, 40, 1000)
    items = [packing.Piece(k, 0, n := rng.randint(1, 60), max(0, n - rng.randint(0, 40))) for k in range(200)]
    for bins in (packing.place(items, lim), packing.fill(packing.place(items, lim), lim)):
        for b in bins:
            assert sum(p.length for p in b) <= 100 and len(b) <= 3 and sum(p.loss for p in b) <= 40
        assert sum(p.length for b in bins for p in b) == sum(p.length for p in items)


def test_token_files(spark, docs, raw_tokens):
    got = sorted(pfor.tokens_roundtrip(docs, segment_ids=3000).collect())
    at = 0
    for r, (k, ids) in zip(got, sorted(raw_tokens.items())):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k, at, len(ids) + 1, zlib.crc32(np.array([*ids, 1], "<u4").tobytes()))
        at += len(ids) + 1
    assert pfor.tokens_roundtrip(empty(spark)).count() == 0
    twice = frame(spark, [(None, "b"), (None, "a"), (3, None), (3, "c")])
    assert [r.start for r in pfor.tokens_roundtrip(twice).orderBy("start").collect()] == [0, 2, 4, 5]


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 255, 256, 257, 5000])
@pytest.mark.parametrize("high", [1, 2, 300, 1 << 20, 1 << 32])
def test_blocks_round_trip(n, high):
    rng = np.random.default_rng(n + high % 1000)
    ids = rng.integers(0, high, n).astype(np.uint32)
    ids[rng.random(n) < 0.05] = np.uint32(0xFFFFFFFF)
    for block, p in ((8, 0.5), (256, 0.9), (64, 1.0)):
        starts, payload = pfor.encode_ids(ids, block, p)
        assert (pfor.decode_ids(starts, payload, n, block) == ids).all()
    data = pfor.write_segment([None, 5], [ids, ids[:3]])
    d, x = pfor.read_segment(data)
    assert d == [None, 5] and (x[0] == ids).all() and (x[1] == ids[:3]).all()
    whole = np.concatenate([ids, ids[:3]])
    if len(whole):
        k = (len(whole) - 1) // pfor.BLOCK
        assert (pfor.read_block(data, k) == whole[k * pfor.BLOCK : (k + 1) * pfor.BLOCK]).all()


# ---- 4 ----------------------------------------------------------------------------------------------------


def nearest(ids, x, q, k=5):
    """(id, cosine) of the k nearest rows of other ids, by scaled doubles."""
    m = np.array([v / np.abs(v).max() for v in x.astype(np.float64)])
    norm = np.sqrt((m * m).sum(1))
    s = (m * m[q]).sum(1) / (norm * norm[q])
    order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
    return [(int(ids[j]), float(s[j])) for j in order]


def clustered(n, groups, dim, rng):
    return rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] + 0.15 * rng.normal(size=(n, dim))


@pytest.mark.parametrize("options", [{}, {"max_parts": 4, "part_rows": 60, "sample": 300}, {"block_bytes": 64 * 16 * 8, "max_parts": 1}])
def test_neighbours(spark, options):
    rng = np.random.default_rng(4)
    x = clustered(1500, 40, 16, rng).astype(np.float32)
    x[200:500] = x[7]
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    odd = [(5000, None, 0), (5050, [0.0] * 16, 0), (5100, [float("nan")] * 16, 0), (5150, [None] * 16, 0), (5200, [1.0] * 3, 0), (None, [1.0] * 16, 0)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, part int").repartition(4)
    got = collections.defaultdict(dict)
    for r in ann.search(df, F.col("vec_id") % 50 == 0, **options).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    assert sorted(got) == list(range(0, 1500, 50)) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    ids, hits = np.arange(1500), 0
    for q, g in got.items():
        want = nearest(ids, x, q)
        score = dict(want) | {v: c for v, c in nearest(ids, x, q, 1499)}
        assert all(abs(score[v] - c) < 1e-12 for v, c in g.values())
        hits += len({v for v, _ in g.values()} & {v for v, _ in want})
        if options.get("max_parts") == 1:
            assert [g[k][0] for k in range(1, 6)] == [v for v, _ in want]
    assert hits >= 0.9 * 5 * 30
    assert ann.search(df.limit(0), F.lit(True), **options).count() == 0
    assert ann.search(df.filter("vec_id in (0, 1, 2)"), F.col("vec_id") == 0, **options).count() == 2


@pytest.mark.parametrize("n", [40, 500, 3000])
def test_parts_are_learned_and_few_of_them_searched(n):
    """At every size; recall at least 0.9 with at most half of the rows compared, on vectors in clusters."""
    rng = np.random.default_rng(n)
    x = clustered(n, max(4, n // 30), 24, rng)
    r = ann.learn(x, 1 << int(np.log2(n) / 2))
    assert r.parts > 1
    u = ann.unit(x)
    own, (i, part) = r.own(u), r.search(u)
    size = np.bincount(own, minlength=r.parts)
    assert size[part].sum() <= 0.5 * n * n
    near = ann.neighbour_graph(u, 5)
    searched = np.zeros((n, r.parts), bool)
    searched[i, part] = True
    assert np.take_along_axis(searched, own[near], axis=1).mean() >= 0.9


def test_neighbours_of_very_large_and_small_vectors(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 8)) * 10.0 ** rng.choice([-200, 0, 200], 60)[:, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    for r in ann.search(df, F.col("vec_id") < 60, max_parts=1).collect():
        v, c = nearest(np.arange(60), x, r.query_id)[r["rank"] - 1]
        assert r.vec_id == v and abs(r.score - c) < 1e-12


def test_neighbours_of_rows_that_share_an_id(spark):
    x = np.array([[1, 0.0], [0.9, 0.1], [0, 1.0], [1, 0.05], [0.05, 1]])
    ids = [1, 1, 2, 3, 4]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = sorted((r["rank"], r.vec_id) for r in ann.search(df, F.col("vec_id") == 1, k=3).collect())
    assert got == [(1, 3), (2, 3), (3, 4)]
    assert [r.vec_id for r in ann.search(df, F.col("vec_id") == 2, k=2).orderBy("rank").collect()] == [4, 1]


# ---- 5 ----------------------------------------------------------------------------------------------------


def edits(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p):
        new = [i + 1]
        for j, x in enumerate(t):
            new.append(min(row[j] + (c != x), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_decontamination_against_edit_distance(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [" ".join(word() for _ in range(rng.randint(4, 30))) for _ in range(12)] + ["tiny", None, ""]
    texts = [None, ""]
    for k in range(120):
        t = list(rng.choice(items[:12]))
        for _ in range(rng.randint(0, 1 + len(t) // 8)):
            j = rng.randrange(len(t))
            t[j] = rng.choice(["", "x", t[j] + "y"])
        texts.append(f"{word()}, {word()}! {''.join(t).upper()} {word()}.")
    bench = spark.createDataFrame([(k, t, 3) for k, t in enumerate(items)] + [(99, items[0], 3)], "item_id long, text string, hits int")
    want = set()
    for k, t in enumerate(texts):
        for i, p in [*enumerate(items[:12]), (99, items[0])]:
            q = decontaminate.plain(p)
            if t and edits(q, decontaminate.plain(t)) <= int(decontaminate.ERROR_RATE * len(q)):
                want.add((k, i, edits(q, decontaminate.plain(t))))
    df = frame(spark, texts)
    assert {tuple(r) for r in decontaminate.matches(df, bench).collect()} == want
    assert {tuple(r) for r in decontaminate.matches(df, bench, max_block_chars=300).collect()} == want
    left = decontaminate.clean(df, bench)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == set(range(len(texts))) - {k for k, _, _ in want}
    assert decontaminate.clean(df, bench.limit(0)).count() == len(texts) and decontaminate.matches(empty(spark), bench).count() == 0


def test_short_items_are_found_word_for_word(spark):
    bench = spark.createDataFrame([(1, "Is 7 prime?"), (2, "cat"), (3, "?!")], "item_id long, text string")
    df = frame(spark, ["So: is 7, prime", "is 7 primes", "this 7 prime", "concat cats", "a cat", "Cat!", "is 8 prime", "?!"])
    want = {(0, 1, 0), (4, 2, 0), (5, 2, 0)}
    assert {tuple(r) for r in decontaminate.matches(df, bench).collect()} == want
    assert {r.doc_id for r in decontaminate.clean(df, bench).collect()} == {1, 2, 3, 6, 7}


# ---- 6 ----------------------------------------------------------------------------------------------------


def shingles(t):
    w = WORD.findall((t or "").encode().lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("limits", [{}, {"cluster_sets": 3, "part_sets": 2, "bucket_bytes": 500}, {"cluster_shingles": 200, "part_shingles": 150, "frequent": 3}])
def test_join_against_all_pairs(spark, docs, corpus, limits):
    sets = [shingles(t) for t in corpus]
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if n and 100 * n >= 80 * len(a | sets[j]):
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_documents(docs, **limits).collect()}
    assert got == {k: (len(s), label[k]) for k, s in enumerate(sets)}


def test_join_views_of_sets_with_little_in_the_searched_half():
    """The view that such sets take part in beside the usual ones."""
    rng = np.random.default_rng(5)
    half = np.uint64(1) << np.uint64(63)
    for n, low in ((200, 0), (200, 40), (400, 79), (1000, 340), (300, 150)):
        s = np.sort(np.concatenate([rng.integers(0, 1 << 63, low, dtype=np.uint64), rng.integers(0, 1 << 63, n - low, dtype=np.uint64) + half]))
        views = dict(ngram_join._views(n, s))
        assert (2 in views) == (low <= 0.36 * n + 1) and 0 not in views
        assert sum(map(len, views.values())) == (n if 2 in views else low)


def test_join_links_rows_that_share_an_id(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    for rows, want in (
        ([(3, a), (7, a + " end"), (7, b), (5, b)], {3: {3}, 7: {3}, 5: {3}}),
        ([(3, a), (7, a), (7, b)], {3: {3}, 7: {3}}),
        ([(7, a), (7, b), (7, None), (9, b), (2, None)], {7: {7}, 9: {7}, 2: {2}}),
    ):
        got = collections.defaultdict(set)
        for r in ngram_join.link_documents(frame(spark, rows)).collect():
            got[r.doc_id].add(r.component_id)
        assert got == want


def test_join_on_odd_tables(spark):
    df = frame(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "A B C D E F"), (9, None), (8, "")])
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in ngram_join.link_documents(df).collect())
    assert got == [(-1, 2, -1), (2, 2, 2), (4, 2, 2), (4, 2, 2), (8, 0, 8), (9, 0, 9)]
    assert ngram_join.link_documents(empty(spark)).count() == 0


def test_signature_tree_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(15):
        sets = []
        for _ in range(rng.integers(1, 10)):
            base = rng.integers(0, 1 << 62, rng.integers(3, 200)).astype(np.uint64)
            sets += [s for _ in range(rng.integers(1, 12)) if len(s := np.unique(base[rng.random(len(base)) > rng.random() * 0.25]))]
        links = signature_tree.SignatureTree(sorted(sets, key=len)).link(80)
        sets.sort(key=len)
        label = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                n = len(np.intersect1d(sets[i], sets[j]))
                if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                    x, y = label[i], label[j]
                    label = [min(x, y) if v in (x, y) else v for v in label]
        assert links.label.tolist() == label


@pytest.mark.parametrize("one_task", [200_000, 0])
def test_components(spark, one_task):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 200)] + [(1000, 1000 - k) for k in range(1, 300)] + [(rng.randint(5000, 5400), rng.randint(5000, 5400)) for _ in range(200)]
    label = {v: v for e in edges for v in e}

    def find(v):
        while label[v] != v:
            v = label[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7), one_task=one_task).collect()}
    assert got == {v: find(v) for v in label if find(v) != v or any(find(u) == v for u in label if u != v)}


# ---- 7 ----------------------------------------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://Example.ORG/es/a?x#y", "https://a.example.org/en/17", "https://a.example.org/en/2", "ftp://x.com/fr/1", "http://com/de/x", "http://x.com", "http://x.com?/de/", "http://a.b.net/de/", "http://org#/", "x://y://z.org/", "http://notorg/", "http://xorg/es/", "http://www.com/de/#"]


def judged(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest, re.S)
    host, path = m[1].lower(), m[2]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("most", [url_filter.MAX_LISTED, 305, 304, 60])
def test_urls(spark, most):
    rng = random.Random(6)
    rules = [*url_filter.RULES, *[(f"h{k}.net", f"/{'abc'[k % 3]}/", rng.choice(["allow", "block"])) for k in range(300)]]
    urls = URLS + [f"https://{rng.choice(['', 'www.'])}h{rng.randint(0, 600)}.net/{rng.choice('abcd')}/{k}" for k in range(800)]
    urls += urls[-5:]
    pages = spark.createDataFrame([(k, u, "<html>", "x") for k, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.rules_frame(spark, rules), max_listed=most).collect()}
    assert got == {k: judged(u, rules) for k, u in enumerate(urls)}
    assert url_filter.judge(pages.limit(0), url_filter.rules_frame(spark)).count() == 0


@pytest.mark.parametrize("most", [url_filter.MAX_LISTED, 1])
def test_rules_of_a_whole_host(spark, most):
    rules = [("example.org", "", "block"), ("good.example.org", "", "allow"), ("com", "/fr/", "block")]
    urls = URLS + ["http://example.org", "http://a.example.org?q", "http://good.example.org/x", "http://example.orgs/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, url_filter.rules_frame(spark, rules), max_listed=most).collect()}
    assert got == {k: judged(u, rules) for k, u in enumerate(urls)}


def test_cascade_is_exact(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = keys.filter(F.pmod(F.xxhash64("key"), F.lit(9)) == 0)
    c = url_filter.build_cascades([listed], keys, rate=0.3)[0]
    assert len(c.levels) > 2
    words = [x.words.scalar() for x in c.levels]
    held = keys.select("key", *[w.alias(f"w{k}") for k, w in enumerate(words)])
    found = held.filter(url_filter.member(F.col("key"), [F.col(f"w{k}") for k in range(len(words))], c)).select("key")
    assert sorted(r.key for r in found.collect()) == sorted(r.key for r in listed.collect())


# ---- 8 ----------------------------------------------------------------------------------------------------


def test_shards_follow_fractional_ranks(spark):
    """Placement by hand: a seeded order within each source, then all rows by fractional rank."""
    rows = [(k, f"t{k}", "en", None if k % 11 == 0 else f"s{k % 3 % 2}", 0, "", "", 0) for k in range(200)]
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard_rows(spark.createDataFrame(rows, SCHEMA).repartition(3), shards=6, seed=5).collect()}
    by = collections.defaultdict(list)
    for k, *_, in rows:
        by[rows[k][3]].append((hashlib.md5(f"5:{k}".encode()).hexdigest(), k))
    placed = []
    for source, members in by.items():
        name = "null" if source is None else f"={source}"
        placed += [((r + 0.5) / len(members), name, h, k) for r, (h, k) in enumerate(sorted(members))]
    want, slots = {}, collections.Counter()
    for g, (*_, k) in enumerate(sorted(placed)):
        shard = g * 6 // len(rows)
        want[k] = (shard, slots[shard])
        slots[shard] += 1
    assert got == want


def test_shards_are_equal_and_match_the_mixture(spark):
    rows = [(k, None if k == 5 else f"t{k}é", "en", None if k % 10 == 9 else "big" if k % 3 else f"s{k % 9}", 0, "", "", 0) for k in range(1000)] + [(5, "t", "en", "big", 0, "", "", 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sharding.shard_rows(df, shards=7).collect()
    assert len(got) == 1001
    size = collections.Counter(r.shard for r in got)
    assert sorted(size) == list(range(7)) and max(size.values()) - min(size.values()) <= 1
    for s in range(7):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(size[s]))
    for src, n in collections.Counter(r.source for r in got).items():
        each = collections.Counter(r.shard for r in got if r.source == src)
        assert all(abs(each[s] - n / 7) <= 2 for s in range(7)), src
    for r in got:
        t = next(x[1] for x in rows if x[0] == r.doc_id) if r.doc_id != 5 else None
        if r.doc_id != 5:
            assert r.size == len(t.encode()) + 8 and r.text_crc32 == zlib.crc32(t.encode()) and r.law == "rows" and r.grown_shard is None
    again = sharding.shard_rows(df.repartition(2), shards=7).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert sharding.shard_rows(empty(spark)).count() == 0 and sharding.shard_rows(df.limit(3)).count() == 3


# ---- 9 ----------------------------------------------------------------------------------------------------


def removed(rows):
    first, out = {}, {}
    texts = sorted((d, t) for d, t in rows)
    for d, t in texts:
        w = WORD.findall((t or "").encode())
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), d)
    for d, t in texts:
        w = WORD.findall((t or "").encode())
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < d:
                gone |= set(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("part_bytes", [substring_dedup.PART_BYTES, 700])
def test_repeats_against_brute_force(spark, docs, corpus, part_bytes):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, part_bytes=part_bytes).collect()}
    want = removed([(k, t or "") for k, t in enumerate(corpus)])
    assert got == want and sum(r[1] > 0 for r in got.values()) > 20
    odd = frame(spark, [(None, corpus[10]), (3, corpus[10]), (3, corpus[10]), (None, corpus[10])])
    assert [r.n_removed for r in substring_dedup.remove_repeats(odd, with_text=True).collect()] == [0] * 4
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0


def test_anchors_depend_on_their_spans_alone():
    rng = random.Random(7)
    inner = [rng.choice("abcd") * rng.randint(1, 3) for _ in range(60)]
    seen = []
    for _ in range(6):
        left, right = ([rng.choice("abcd") for _ in range(rng.randint(0, 9))] for _ in range(2))
        w = words.fingerprints(pa.array([" ".join([*left, *inner, *right])]), False)
        a, lo, hi = substring_dedup.anchors(w)
        n = len(left)
        seen.append({(int(x), int(s) - n, int(e) - n) for x, s, e in zip(a, lo, hi) if s >= n and e <= n + len(inner)})
    assert all(s == seen[0] for s in seen) and len(seen[0]) > 10


# ---- queries ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, small).select(want.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))
