"""Word and byte operators against plain Python, awkward rows included."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from . import brute, corpus
from crawlgrid.llm import chosen_path, components, ctw, fm_decontam, quality, resample, substring_doubling, suffix_refine, textbuf

ROWS = corpus.random_docs()


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.frame(spark, ROWS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return corpus.frame(spark, [])


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_substring_doubling(docs, empty):
    got = substring_doubling.dedup(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    rows = [tuple(r) for r in got.select("doc_id", "n_words", removed, F.sha2("kept", 256)).collect()]
    want = brute.repeated_words(ROWS)
    assert ordered(rows) == ordered(want)
    assert sum(r[2] > 0 for r in want) > 5
    assert substring_doubling.dedup(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 4, 5, 20])
def test_substring_doubling_lengths(docs, n):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    rows = [tuple(r) for r in substring_doubling.dedup(docs, n).select("doc_id", "n_words", removed, F.sha2("kept", 256)).collect()]
    assert ordered(rows) == ordered(brute.repeated_words(ROWS, n))


@pytest.mark.parametrize("n", [50, 13, 70])
def test_suffix_refinement(docs, empty, n):
    got = suffix_refine.dedup(docs, n)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    rows = [tuple(r) for r in got.select("doc_id", "n_bytes", removed, F.size("spans"), F.sha2("kept", 256)).collect()]
    assert ordered(rows) == ordered(brute.repeated_bytes(ROWS, n))
    assert suffix_refine.dedup(empty, n).count() == 0


def test_suffix_refinement_whole_characters(docs):
    for r in suffix_refine.dedup(docs, 10, whole_characters=True).select("kept").collect():
        bytes(r.kept).decode()


@pytest.mark.parametrize("n", [8, 9, 16, 31, 50])
def test_bucket_pointers(n):
    r = random.Random(n)
    text = bytes(r.choice(b"ab") for _ in range(700))
    ends = np.repeat(np.array([300, 420, 700]), [300, 120, 280])
    got = suffix_refine.refine(np.frombuffer(text, np.uint8), ends, n)
    places = [i for i in range(700) if i + n <= ends[i]]
    classes = {}
    for i in places:
        classes.setdefault(int(got[i]), set()).add(text[i:i + n])
    assert all(len(c) == 1 for c in classes.values())
    assert len(classes) == len({text[i:i + n] for i in places})


def test_slices_meet(monkeypatch):
    """Runs that a slice boundary cuts give the same result."""
    buf, offs = textbuf.buffer_of(pa.array([t for _, t in ROWS]))
    a = [np.concatenate(x) for x in zip(*suffix_refine.anchored(buf, offs, 50))]
    monkeypatch.setattr(suffix_refine, "SLICE", 333)
    b = [np.concatenate(x) for x in zip(*suffix_refine.anchored(buf, offs, 50))]
    assert np.array_equal(np.repeat(a[2], a[1] - a[0]), np.repeat(b[2], b[1] - b[0]))


def test_windows_of_a_bucket_take_little_memory():
    """3 MB of text, runs of windows slice by slice: slices of 256 KB."""
    r = random.Random(3)
    buf, offs = textbuf.buffer_of(pa.array(["".join(r.choices("abcdefgh ", k=3000)) for _ in range(1000)]))
    tracemalloc.start()
    n = sum(len(a[0]) for a in suffix_refine.anchored(buf, offs, 50, True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 1000
    assert peak < 5e7


ITEMS = [(1, ROWS[0][1]), (2, "abc de"), (3, ""), (4, None), (5, " ".join(["Ünïcode ﷺ 😀"] * 9)), (None, ROWS[20][1]), (10, ROWS[3][1]), (10, ROWS[4][1]), (11, ROWS[0][1])]


@pytest.mark.parametrize("block", [8 << 20, 300, 100])
def test_decontamination(spark, docs, empty, block, monkeypatch):
    monkeypatch.setattr(fm_decontam, "BLOCK_BYTES", block)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = fm_decontam.verdicts(fm_decontam.scan(docs, bench))
    names = F.array_sort(F.col("item_ids").cast("array<string>"))
    rows = [tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", names), 256), "contaminated").collect()]
    want = [(d, *brute.decontamination([(d, t)], ITEMS)[d]) for d, t in ROWS]
    assert ordered(rows) == ordered(want)
    assert any(r[5] for r in want) and not all(r[5] for r in want)
    assert fm_decontam.scan(empty, bench).count() == 0
    assert fm_decontam.verdicts(fm_decontam.scan(docs, bench.limit(0))).where("contaminated").count() == 0


def test_fm_index_counts_and_places():
    r = np.random.default_rng(1)
    seq = r.integers(1, 6, 500)
    index = fm_decontam.FMIndex(seq, 5)
    for _ in range(50):
        s = int(r.integers(0, 480))
        pattern = seq[s:s + int(r.integers(1, 8))]
        lo, hi = index.search(pattern[None, :].astype(np.int64), np.array([len(pattern)]))
        places = sorted(index.locate(np.arange(lo[0], hi[0])).tolist())
        assert places == [k for k in range(len(seq) - len(pattern) + 1) if (seq[k:k + len(pattern)] == pattern).all()]


def test_context_tree_weighting(docs, empty):
    got = {(r.doc_id, r.n_tokens): r for r in ctw.score(docs).collect()}
    rows = [(d, t) for d, t in ROWS]
    # ids that recur are looked up with their number of tokens
    base = brute_base(rows)
    want = ctw_by_row(rows)
    for (d, t), b, w in zip(rows, base, want):
        r = got[d, b[1]]
        assert (r.held_out, r.n_known, r.train_tokens) == (b[0], b[2], b[3])
        assert r.base_score == pytest.approx(b[4], rel=1e-9)
        assert r.score == pytest.approx(w, rel=1e-5)
    assert ctw.score(empty).count() == 0
    only_held = [r for r in ROWS if r[0] is not None and brute.zlib.crc32(str(r[0]).encode()) % 10 == 0]
    assert ctw.score(docs.where("crc32(cast(doc_id as string)) % 10 = 0")).count() == len(only_held)


def brute_base(rows):
    """As brute.base_scores, row by row (ids may be null or recur)."""
    counts, out = {}, []
    for d, t in rows:
        tokens = [*brute.SPACED.findall((t or "").translate(brute.UPPER)), None]
        held = brute.zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
        out.append((held, tokens))
        if not held:
            for x in tokens:
                counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    return [(h, len(x), sum(y in counts for y in x), n, sum(brute.math.log10((counts.get(y, 0) + 0.1) / (n + 0.1 * (v + 1))) for y in x)) for h, x in out]


class Row(int):
    """A row number whose text is the row's id, as the checksum reads it."""

    def __new__(cls, k, d):
        self = super().__new__(cls, k)
        self.id = d
        return self

    def __str__(self):
        return "" if self.id is None else str(self.id)


def ctw_by_row(rows):
    got = brute.ctw_scores([(Row(k, d), t) for k, (d, t) in enumerate(rows)], ctw.DEPTH)
    return [got[k] for k in range(len(rows))]


def test_probabilities_of_next_bytes_add_up():
    """In any context the probabilities of the 256 next bytes sum to one."""
    r = np.random.default_rng(0)
    grams = np.unique(r.integers(97, 100, (300, 6)).astype(np.uint64) @ (np.uint64(256) ** np.arange(5, -1, -1, dtype=np.uint64)))
    counts = r.integers(0, 9, len(grams))
    above = np.full((256, 3, 256), 0.5)
    above[:, 0] = 0.2
    above[:, 1] = 0.5
    context = grams[7] >> np.uint64(8) << np.uint64(8)
    every = np.unique(np.append(grams, context + np.arange(256, dtype=np.uint64)))
    full = np.zeros(len(every), np.int64)
    full[np.searchsorted(every, grams)] = counts
    log = ctw.log_probabilities(every, full, above)
    at = np.searchsorted(every, context + np.arange(256, dtype=np.uint64))
    assert (10 ** log[at]).sum() == pytest.approx(1)


def test_jaccard_join(docs, empty):
    rows = [tuple(r) for r in chosen_path.join(docs).select("doc_id", "n_links", "component_id").collect()]
    assert ordered(rows) == ordered(brute.jaccard_links(ROWS))
    assert chosen_path.join(empty).count() == 0


def test_jaccard_join_large_groups(spark, monkeypatch):
    """Groups beyond a leaf and a tile, with a passage that all documents share."""
    monkeypatch.setattr(chosen_path, "LEAF", 4)
    monkeypatch.setattr(chosen_path, "TILE", 7)
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    shared = " ".join(word() for _ in range(30))
    rows = []
    for g in range(4):
        body = [word() for _ in range(150)]
        for k in range(25 if g == 0 else 3):
            copy = list(body)
            for _ in range(r.randrange(3)):
                copy[r.randrange(150)] = word()
            rows.append((len(rows) * 7 % 211, " ".join(copy) + " " + shared))
    rows += [(500 + k, " ".join(word() for _ in range(40)) + " " + shared) for k in range(30)]
    got = [tuple(x) for x in chosen_path.join(corpus.frame(spark, rows)).select("doc_id", "n_links", "component_id").collect()]
    assert ordered(got) == ordered(brute.jaccard_links(rows))


def test_jaccard_recall_at_the_deepest_level(spark, monkeypatch):
    """Pairs of 40 and 50 words, the first within the second, on paths that are
    all split to the end."""
    monkeypatch.setattr(chosen_path, "LEAF", 1)
    monkeypatch.setattr(chosen_path, "ALIKE", 1.1)
    pairs = 10_000
    rows = [(2 * k + more, " ".join(f"{k}.{w}" for w in range(50 if more else 40))) for k in range(pairs) for more in (0, 1)]
    share, runs = 0.8, chosen_path.runs_needed(0.8, chosen_path.RECALL)
    sets = chosen_path.sketch(corpus.frame(spark, rows).repartition(4), 1, share, runs, "doc_id", "text")
    sets = components.saved(sets.select(F.struct(F.col("doc_id").alias("rep"), "s1").alias("node"), "signature", "paths"))
    met = chosen_path.candidates(sets, share).where("u.rep div 2 = v.rep div 2").count()
    assert pairs - met <= 0.0015 * pairs


def test_one_of_each(docs):
    stay = chosen_path.one_of_each(docs)
    assert stay.columns == docs.columns
    want = [(d, t) for (d, t), (_, _, c) in zip(ROWS, brute.jaccard_links(ROWS)) if c == d]
    seen, kept = set(), []
    for d, t in want:
        key = (d, t) if brute.shingles(t) and d is not None else object()
        if key not in seen:
            seen.add(key)
            kept.append((d, t))
    assert ordered([(r.doc_id, r.text) for r in stay.collect()]) == ordered(kept)


def test_one_of_each_goes_by_row(spark):
    body = [f"w{k}" for k in range(60)]
    near, other = " ".join(body), " ".join(body[:-1])
    single = [(None, near), (None, near), (3, ""), (3, ""), (4, None), (4, None), (1, "no copy of the other rows with this id")]
    group = [(1, near), (1, other), (1, near.replace(" ", "  ")), (2, near)]
    for repeated in ([], [(1, near)] * 2 + [(1, other)]):
        stay = [(r.doc_id, r.text) for r in chosen_path.one_of_each(corpus.frame(spark, single + group + repeated)).collect()]
        kept = [x for x in stay if x in group and x[0] is not None]
        assert len(kept) == 1 and kept[0][0] == 1
        assert ordered([x for x in stay if x not in group]) == ordered(single)


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 460)] + [(7, 7)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = brute.components({x for p in links for x in p}, links)
    assert {n: got.get(n, n) for n in want} == want
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_long_texts_take_little_memory(monkeypatch):
    """One text of 3 MB: what an operator takes beside it is a constant and 27 bytes
    a byte at most (600 MB for 20 MB); cutting it changes no result."""
    r = random.Random(1)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9))) for _ in range(20_000)]
    text = " ".join(r.choices(vocab, [1 / (k + 10) for k in range(20_000)], k=500_000)).encode()
    buf, offs = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    table = pa.table({"id": pa.array([1]), "text": pa.array([text], pa.large_binary()), "r": pa.array([{"held_out": False}])})
    model = quality.Model(np.random.default_rng(1).normal(size=quality.BUCKETS).astype(np.float32), 0.0)
    phrases = fm_decontam.Phrases([" ".join(r.choices(vocab, k=300)) for _ in range(20)], 13)

    def repeated():
        for shard in substring_doubling.shards(table, 13):
            shard.least(8, shard.windows)
            shard.exact(shard.windows)

    runs = {"quality": lambda: model.scores(buf, offs), "jaccard": lambda: chosen_path.shingle_sets(buf, offs, 5)[0], "substrings": repeated,
            "tree": lambda: ctw.Shelf(table, 4).grams, "decontamination": lambda: list(phrases.scan(buf, offs)),
            "resampling": lambda: sum(len(b) for _, _, b in resample.features(buf, offs))}
    got = {}
    for name, run in runs.items():
        tracemalloc.start()
        got[name] = run()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak <= 6e7 + 27 * len(text), (name, peak / len(text))
    for module, name in ((textbuf, "PIECE_BYTES"), (quality, "PIECE_BYTES"), (ctw, "SLICE_BYTES"), (resample, "SLICE")):
        monkeypatch.setattr(module, name, 1 << 30)
    assert model.scores(buf, offs) == pytest.approx(got["quality"])
    assert (chosen_path.shingle_sets(buf, offs, 5)[0] == got["jaccard"]).all()
    assert (ctw.Shelf(table, 4).grams == got["tree"]).all()
    assert list(phrases.scan(buf, offs)) == got["decontamination"]


def test_fragments_are_told_apart_by_their_bytes(monkeypatch):
    """Fragments around one anchor whose second hashes are equal, their bytes not."""
    from crawlgrid.llm import exchange
    strong = suffix_refine.window_hash
    monkeypatch.setattr(suffix_refine, "window_hash", lambda pre, s, e, which=0: strong(pre, s, e, which) & np.uint64(2**64 - 1 if which == 0 else 0))
    r = random.Random(1)
    word = lambda k: "".join(r.choice("abcdef") for _ in range(k))
    common = word(40)
    rows = [(i % 17, word(r.randint(0, 40)) + common + r.choice(["", word(3), "qrst" * 9]) + word(r.randint(0, 40))) for i in range(60)]
    buckets = [pa.table({"id": [d for d, _ in part], "text": [t for _, t in part]}) for part in (rows[::2], rows[1::2])]
    by = lambda blobs, key: {k: blobs.filter(pc.equal(blobs[key], k)) for k in set(blobs[key].to_pylist())}
    keys = exchange.blobs([x for b, t in enumerate(buckets) for x in suffix_refine.anchors(b, t, 50, 1)])
    shared = by(exchange.shared_keys(keys), "b")
    sent = exchange.blobs([x for b, t in enumerate(buckets) for x in suffix_refine.fragments(b, t, shared[b], 50, 1)])
    bits = by(suffix_refine.settle(sent, 50), "b")
    got = []
    for b, t in enumerate(buckets):
        t = t.take(list(range(len(t)))[::-1])  # the order of a bucket's rows doesn't matter
        sizes, left, spans = suffix_refine.kept(t, pa.concat_tables([shared[b], bits[b]]), 50, 1, False)
        got += [(d, n, sum(s["end"] - s["start"] for s in x), len(x), brute.sha(k)) for d, n, k, x in zip(t["id"].to_pylist(), sizes.to_pylist(), left.to_pylist(), spans.to_pylist())]
    want = brute.repeated_bytes(rows)
    assert ordered(got) == ordered(want) and sum(w[2] > 0 for w in want) > 5
