"""The pipeline's stages, each on its own input."""

import collections
import re
import zlib

import corpus_pipeline as cp
import numpy as np
from tokenizers import Tokenizer
from zonemark.llm import decontaminate, line_dedup, tokens, toxicity
from zonemark.llm.storage import stored


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    cols, kept = docs.columns, {}
    for name, stage in cp.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stored(stage(spark, docs, small), name)
        assert docs.columns == cols
        kept[name] = (before, {r.doc_id: r for r in docs.collect()})
    before, after = kept["line_dedup"]
    assert before.keys() == after.keys() and all(r.n_chars == len(r.text) for r in after.values())
    assert all(set(r.text.split("\n")) <= set(before[k].text.split("\n")) for k, r in after.items() if r.text)
    before, after = kept["ngram_jaccard_join"]
    w = {k: re.findall(rb"[^\x20\x09-\x0d]+", r.text.encode().lower()) for k, r in before.items()}
    sets = {k: {tuple(x[i : i + 5]) for i in range(max(1, len(x) - 4))} if x else set() for k, x in w.items()}
    label = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            n = len(sets[a] & sets[b]) if b < a else 0
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    assert set(after) == {k for k, v in label.items() if k == v}
    before, after = kept["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    m = decontaminate.Matcher(items)
    assert set(after) == {k for k, r in before.items() if not m.find(r.text)}
    assert all(k not in after for k, r in before.items() if any(decontaminate.plain(t) in decontaminate.plain(r.text) for _, t in items))
    packed = cp.STAGES[-1][1](spark, docs, small).collect()
    assert {r.doc_id for r in packed} == set(after)


def test_run(spark, small):
    assert cp.run(spark, small).count() > 0


def test_toxicity_stage(spark, small):
    """What stays is what the operator predicts to be ordinary, as it is."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    scored = toxicity.score_documents(docs, spark.read.parquet(f"{small}/labels.parquet")).collect()
    keep = {r.doc_id for r in scored if r.predicted == 0}
    out = cp.toxicity(spark, docs, small)
    assert out.columns == docs.columns and keep and sorted(map(tuple, out.collect())) == sorted(tuple(r) for r in docs.collect() if r.doc_id in keep)


def test_line_dedup_stage(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    docs = docs.unionByName(docs.filter("doc_id < 20").withColumn("doc_id", docs.doc_id + 10_000))
    rows = docs.collect()
    pages, seen = collections.defaultdict(set), collections.Counter()
    for r in rows:
        pages[r.source].add(r.text)
    for h, texts in pages.items():
        for t in texts:
            for x in set((t or "").split("\n")) if t is not None else ():
                seen[h, x] += 1
    bad = {hx for hx, n in seen.items() if n >= 2 and n > line_dedup.RATIO * len(pages[hx[0]]) and hx[1].strip(" \t\n\x0b\x0c\r")}
    want = {r.doc_id: r.text and "\n".join(x for x in r.text.split("\n") if (r.source, x) not in bad) for r in rows}
    got = {r.doc_id: r for r in cp.line_dedup(spark, docs, small).collect()}
    assert bad and {k: r.text for k, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values() if r.text is not None)


def test_packing_stage(spark, small):
    """Every id of every text once, in sequences of 4096 at most, without padding but at powers of two."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    raw = Tokenizer.from_file(tokens.default_path())
    ids = {r.doc_id: [*raw.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    pieces, size = collections.defaultdict(list), collections.Counter()
    for r in cp.packing(spark, docs, small).collect():
        pieces[r.doc_id].append((r.start, r.length))
        size[r.sequence_id] += r.length
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert pieces.keys() == ids.keys()
    for k, ps in pieces.items():
        ends = [0, *(a + n for a, n in sorted(ps))]
        assert [a for a, _ in sorted(ps)] == ends[:-1] and ends[-1] == len(ids[k])
    assert all(n == 4096 or n & (n - 1) == 0 for n in size.values())


def test_stages_on_odd_tables(spark, small):
    """An empty table, null texts, rows that repeat, and columns of other names and of the stages' own."""
    cols = COLS + ", hits string, row string, _h int"
    rows = [(1, None, None, None, None, "a", "b", 1), (1, None, None, None, None, "a", "b", 1), (None, "x y z", "en", "s", 5, "a", "b", 1), (4, "", "en", "s", 0, None, None, None)]
    for docs in (spark.createDataFrame([], cols), spark.createDataFrame(rows, cols)):
        now = docs
        for name, stage in cp.STAGES[:-1]:
            now = stored(stage(spark, now, small), name)
            assert now.columns == docs.columns
        assert now.count() == (0 if docs.count() == 0 else 4)
        cp.STAGES[-1][1](spark, now, small).collect()


COLS = "doc_id long, text string, lang string, source string, n_chars long"


def test_copies_are_no_boilerplate(spark, small):
    """A text that a third of a site's pages repeat keeps its lines; a line of different pages goes."""
    texts = [f"menu\nown {k}\nmore of {k}" for k in range(60)] + ["one passage\nand its end"] * 30
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], COLS).repartition(5)
    got = {r.doc_id: r.text for r in cp.line_dedup(spark, docs, small).collect()}
    assert got == {k: t.removeprefix("menu\n") for k, t in enumerate(texts)}


def test_one_row_of_each_group_stays(spark, small):
    """With ids that repeat or are missing, too."""
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(60)) for x in "abcde")
    rows = [(1, a), (1, a), (2, a), (None, b), (None, b), (3, c), (4, c + " end"), (4, d), (None, e), (5, e), (6, None), (6, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], COLS).repartition(3)
    out = cp.ngram_jaccard_join(spark, docs, small)
    assert out.columns == docs.columns
    want = [(1, a), (None, b), (3, c), (4, d), (5, e), (6, None), (6, "")]
    assert sorted((tuple(r)[:2] for r in out.collect()), key=str) == sorted(want, key=str)
