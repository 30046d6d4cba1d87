"""Tokenizer, archives, vectors, licenses, classifier and pipeline, awkward rows included."""

import base64
import difflib
import gzip
import math
import os
import random
import threading
import tracemalloc

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from crawlgrid.llm import bpe, license_scan, quality, queries, subspace_join, suffix_refine, warc
from crawlgrid.session import scratch_dir

from . import brute, corpus

ROWS = corpus.random_docs()
RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return corpus.frame(spark, ROWS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return corpus.frame(spark, [])


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_rows(docs, empty, oracle):
    got = bpe.encode(docs, RANKS, P.PATTERN, carry=("doc_id", "kept"))
    rows = [(r.doc_id, tuple(r.token_ids), r.kept) for r in got.collect()]
    assert ordered(rows) == ordered([(d, tuple(oracle.encode_ordinary(t or "")), "k") for d, t in ROWS])
    back = bpe.decode(got.select("doc_id", "token_ids"), RANKS, P.PATTERN)
    assert ordered([(r.doc_id, bytes(r.decoded)) for r in back.collect()]) == ordered([(d, (t or "").encode()) for d, t in ROWS])
    assert bpe.encode(empty, RANKS, P.PATTERN).count() == 0


def test_bpe_pieces(oracle):
    r = random.Random(4)
    tool = bpe.codec(RANKS, P.PATTERN)
    texts = ["".join(r.choice("aabbcde th in'sé語😀\n\x1c 9") for _ in range(r.randint(0, 90))) for _ in range(400)]
    texts += ["ab" * 400, "the" * 200, "z" * 129, "=" * 1000, "é" * 300, "don't I'll", "<|endoftext|>"]
    ids, count = tool.encode(texts)
    for got, text in zip(np.split(ids, np.cumsum(count)[:-1]), texts):
        assert got.tolist() == oracle.encode_ordinary(text)


def test_bpe_long_text(oracle, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 1000)
    text = "Some words, and 'more' of them. " * 400
    ids, count = bpe.codec(RANKS, P.PATTERN).encode([None, text, "", text])
    assert count.tolist() == [0, count[1], 0, count[1]]
    assert ids[:count[1]].tolist() == oracle.encode_ordinary(text)


def test_bpe_cache_is_bounded(oracle, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 50)
    tool = bpe.Codec(dict(bpe.codec(RANKS, P.PATTERN).ranks), P.PATTERN)
    for k in range(5):
        text = " ".join(f"w{k}x{i}" for i in range(60))
        assert tool.encode([text])[0].tolist() == oracle.encode_ordinary(text)
    assert len(tool.index) < 400


PAGES = [(1, "http://a/x", "<p>one</p>"), (2, "http://b/\r\nInjected: 1%0A", "<p>one</p>"), (3, None, None), (4, "http://d", ""),
         (5, "http://e", "é" * 40_000), (None, "http://f", "<p>one</p>"), (None, "http://g", "only"), (7, "http://h", "WARC/1.1\r\n\r\n"),
         (8, "http://i", "<p>one</p>"), (8, "http://i", "<p>one</p>")]


@pytest.mark.parametrize("split,least", [(16 << 20, 0), (97, 0), (200, 11)])
def test_warc_round_trip(spark, split, least):
    r = random.Random(split)
    noise = [(100 + k, "u", "".join(chr(r.randrange(32, 1000)) for _ in range(r.randrange(400)))) for k in range(60)]
    pages = spark.createDataFrame(PAGES + noise, "id long, uri string, html string").select("id", "uri", F.encode("html", "UTF-8").alias("payload"))
    folder = scratch_dir(spark, "warc-test")
    manifest = warc.write(warc.with_types(pages.repartition(3), least), folder, file_bytes=3000)
    assert manifest.agg(F.sum("records")).first()[0] == len(PAGES + noise)
    got = warc.read(spark, manifest, split).collect()
    most = {}
    for i, _, h in PAGES + noise:
        b = (h or "").encode()
        most[b] = max(most.get(b, -1), -1 if i is None else i)
    want = []
    for i, u, h in PAGES + noise:
        b = (h or "").encode()
        again = most[b] >= 0 and i != most[b] and len(b) >= least
        want.append((f"urn:page:{'' if i is None else i}", "revisit" if again else "response", f"urn:page:{most[b]}" if again else None, u,
                     len(b), brute.digest(b), None if again else b))
    assert ordered([(x.record_id, x.record_type, x.refers_to, x.uri, x.payload_bytes, x.payload_digest, None if x.payload is None else bytes(x.payload)) for x in got]) == ordered(want)
    assert all(x.intact for x in got)


def test_warc_empty(spark):
    pages = spark.createDataFrame([], "id long, uri string, payload binary")
    assert warc.read(spark, warc.write(warc.with_types(pages), scratch_dir(spark, "warc-test"))).count() == 0


def test_warc_hot_payload_is_split(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    kept = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        hot = "".join(random.Random(0).choices("abcdefghijklmnop", k=40_000))  # no run that block compression would shorten
        pages = spark.range(900, numPartitions=16).selectExpr("id", "'u' AS uri", f"encode(IF(id % 3 = 0, '{hot}', sha2(string(id), 512)), 'UTF-8') AS payload")
        typed = warc.with_types(pages)
        assert len(typed.collect()) == 900
        assert "skew=true" in typed._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_warc_magic_that_is_no_member(tmp_path):
    """Ranges own the records that start in them, whatever lies between."""
    member = [gzip.compress(warc.record(f"<urn:page:{k}>", "u", b"x" * k, "response", None, "d")) for k in range(5)]
    raw = member[0] + b"\x1f\x8b\x08junk" + member[1] + gzip.compress(b"no record") + member[2] + member[3] + b"\x1f\x8b" + member[4]
    path = tmp_path / "f.warc.gz"
    path.write_bytes(raw)
    from pyarrow import fs

    with fs.LocalFileSystem().open_input_file(str(path)) as f:
        for step in (1000, 37, 1):
            found = [r["record_id"] for s in range(0, len(raw), step) for _, r in warc.records_in(f, s, s + step)]
            assert found == [f"urn:page:{k}" for k in range(5)]


VECTORS = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.1, 0.0]), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [math.nan, 1.0, 0.0]), (7, [math.inf, 1.0, 0.0]),
           (8, [1.0, None, 0.0]), (None, [1.0, 0.0, 0.0]), (9, [1.0, 0.0]), (10, [3.0, 0.1]), (11, [1.0, 0.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [-1.0, 0.0, 0.0]), (13, [5.0])]


def test_subspace_join(spark, monkeypatch):
    monkeypatch.setattr(subspace_join, "TILE", 40)
    monkeypatch.setattr(subspace_join, "STRIP", 16)
    r = np.random.default_rng(3)
    base = r.standard_normal((30, 16))
    rows = [(100 + k, (base[k % 30] + r.standard_normal(16) * r.choice([0.0, 0.1, 0.25, 0.4])).tolist()) for k in range(260)]
    rows += [(100 + k, rows[3][1]) for k in range(300, 340)]
    got = subspace_join.join(spark.createDataFrame(VECTORS + rows, "vec_id long, embedding array<double>").repartition(3))
    assert ordered([tuple(x) for x in got.collect()]) == ordered(brute.vector_links(VECTORS + rows))
    none = spark.createDataFrame([(3, None), (4, [])], "vec_id long, embedding array<double>")
    assert ordered([tuple(x) for x in subspace_join.join(none).collect()]) == [(3, 0, 3), (4, 0, 4)]
    assert subspace_join.join(none.limit(0)).count() == 0



def test_subspace_join_stores_each_vector_once(spark, monkeypatch):
    """Disk follows the vectors, not the pairs of tiles: over 30 times the input when each pair of tiles had its copy."""
    monkeypatch.setattr(subspace_join, "TILE", 64)
    monkeypatch.setattr(subspace_join, "STRIP", 32)
    r = np.random.default_rng(4)
    points = r.standard_normal((1500, 64)).astype(np.float32)
    points[1000:1200] = points[:200] + r.standard_normal((200, 64)).astype(np.float32) * r.choice([0.1, 0.3, 0.45, 0.55], (200, 1)).astype(np.float32)
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(points)], "vec_id long, embedding array<float>").repartition(4)

    folders = [spark.conf.get("spark.checkpoint.dir"), *(d.getPath() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())]
    used, done = [], threading.Event()

    def watch():  # while it runs, as Spark removes what is no longer needed
        while not done.is_set():
            used.append(sum(size(d, n) for f in folders for d, _, names in os.walk(f) for n in names))
            done.wait(0.02)

    def size(folder, name):
        try:
            return os.path.getsize(f"{folder}/{name}")
        except OSError:
            return 0

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = ordered([tuple(x) for x in subspace_join.join(rows).collect()])
    finally:
        done.set()
        watcher.join()
    assert max(used) - used[0] < 8 * points.nbytes
    unit = points.astype(float) / np.linalg.norm(points.astype(float), axis=1)[:, None]
    pairs = np.argwhere(np.triu(unit @ unit.T >= 0.9, 1)).tolist()
    assert 80 < len(pairs) < 190
    root = brute.components(range(1500), pairs)
    degree = np.bincount(np.ravel(pairs), minlength=1500).tolist()
    assert got == [(k, degree[k], root[k]) for k in range(1500)]


def test_subspace_join_tiles(monkeypatch):
    """Cells have about as many points each, also of dense regions and of points that repeat; each pair of tiles meets once."""
    monkeypatch.setattr(subspace_join, "STRIP", 8)
    r = np.random.default_rng(5)
    points = np.concatenate((r.standard_normal((600, 5)), r.standard_normal((600, 5)) * 1e-3, np.zeros((600, 5)))).astype(np.float32)
    cell = subspace_join.locate(subspace_join.cells(points[::3], 12), points)
    assert np.bincount(cell[:1200]).max() < 300 and len(np.unique(cell)) > 6
    assert sorted(subspace_join.in_strips(points[:100])) == list(range(100))
    same = subspace_join.cells(np.ones((100, 3), np.float32), 4)
    assert subspace_join.locate(same, points[:, :3]).tolist() == [0] * 1800
    for n in (1, 2, 5, 8):
        meets = np.array([subspace_join.partners(i, n) for i in range(n)])
        assert (meets | meets.T).all() and not (meets & meets.T & ~np.eye(n, dtype=bool)).any()


def test_license_scan(spark, docs, empty):
    mit, gpl = license_scan.TEMPLATES["MIT"], license_scan.TEMPLATES["GPL-3.0-header"]
    words = gpl.split()
    wrapped = "\n".join(" ".join(words[k:k + 9]) for k in range(0, len(words), 9))
    changed = mit.replace("Released", "Distributed")
    rows = [(1, f"text\n{mit}\nmore"), (2, wrapped), (3, f"intro\n{wrapped}\n\n{license_scan.TEMPLATES['CC-BY-NC-4.0']}\nend"), (4, None), (5, ""),
            (6, "You need a license to drive, and permission of your parents."), (7, mit), (7, mit), (None, mit),
            (8, gpl.replace("either version 3", "either the version 3").replace("any later", "any")), (9, "\n".join(["x"] * 30_000) + "\n" + mit), (10, changed + " nothing")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    found = ordered([(r.doc_id, r.first_line, r.license, r.missing_words, r.extra_words) for r in got.collect()])
    assert found == ordered([(1, 1, "MIT", 0, 0), (2, 0, "GPL-3.0-header", 0, 0), (3, 1, "GPL-3.0-header", 0, 0), (3, 1 + len(wrapped.split("\n")) + 1, "CC-BY-NC-4.0", 0, 0),
                             (7, 0, "MIT", 0, 0), (7, 0, "MIT", 0, 0), (None, 0, "MIT", 0, 0), (8, 0, "GPL-3.0-header", 1, 1), (9, 30_000, "MIT", 0, 0)])
    assert license_scan.scan(empty).count() == 0


def found_in(text):
    return [(a, b, name) for a, b, name, *_ in license_scan.Scanner(license_scan.TEMPLATES).scan(text)]


@pytest.mark.parametrize("around", [0, 20, 100, 5000])
def test_license_reduction_does_not_depend_on_the_line(around):
    r = random.Random(around)
    prose = [" ".join(r.choice(["river", "of", "the", "stone", "a", "License", "bird", "software"]) for _ in range(around)) for _ in range(2)]
    tool = license_scan.Scanner(license_scan.TEMPLATES)
    for name, text in license_scan.TEMPLATES.items():
        alone, = tool.scan(text)
        assert list(tool.scan(f"{prose[0]} {text} {prose[1]}")) == [alone] and alone[2] == name and alone[3] > 0.4
        assert [x[2] for x in tool.scan(text.upper())] == [name]
    assert found_in(license_scan.TEMPLATES["MIT"] + " See the LICENSE file at the top of this repository for the full text.") == [(0, 0, "MIT")]


def test_license_scan_goes_on_behind_a_finding():
    every = list(license_scan.TEMPLATES)
    assert found_in(" ".join(license_scan.TEMPLATES.values())) == [(0, 0, name) for name in every]
    mit, cc = license_scan.TEMPLATES["MIT"], license_scan.TEMPLATES["CC-BY-4.0"]
    assert found_in(f"x\n{mit} {cc} Or: {mit}\n{cc}") == [(1, 1, "MIT"), (1, 1, "CC-BY-4.0"), (1, 1, "MIT"), (2, 2, "CC-BY-4.0")]
    header = license_scan.TEMPLATES["MIT-permission"].replace("any person ", "any person\n")
    assert found_in(f"{header}. {mit}") == [(0, 1, "MIT-permission"), (1, 1, "MIT")]


@pytest.mark.parametrize("mark", ["\n", "\n\n", "\r\n * ", "\n# "])
def test_license_notices_wrapped_anywhere(spark, mark):
    for name, text in license_scan.TEMPLATES.items():
        words = text.split()
        for k in range(1, len(words)):
            wrapped = " ".join(words[:k]) + mark + " ".join(words[k:])
            assert found_in(f"Foo 2020, Bar. {wrapped} Baz") == [(0, mark.count("\n"), name)]
        assert found_in("Copyright 2020 Foo. " + mark.join(words)) == [(0, mark.count("\n") * (len(words) - 1), name)]
    last = license_scan.TEMPLATES["Unlicense"].replace("public ", "public" + mark)
    assert [r.license for r in license_scan.scan(corpus.frame(spark, [(1, last)])).collect()] == ["Unlicense"]


def brute_licenses(text):
    """Every template at every word, ranked by what it saves, the first of near wording taken."""
    tool, words, out, s = license_scan.Scanner(license_scan.TEMPLATES), license_scan.word_list(text), [], 0
    while s < len(words):
        step = 1
        for name in tool.ranked(words, s, license_scan.TEMPLATES):
            template, block = tool.wording[name], words[s:s + tool.room[name]]
            runs = [m for m in difflib.SequenceMatcher(None, template, block, autojunk=False).get_matching_blocks() if m.size]
            if not runs or runs[0].b:
                continue
            same, end = sum(m.size for m in runs), runs[-1].b + runs[-1].size
            if len(template) - same + end - same <= license_scan.TOLERANCE * len(template):
                out.append((name, s, len(template) - same, end - same))
                step = end
                break
        s += step
    return out


def test_license_scan_against_every_place():
    r = random.Random(12)
    names = list(license_scan.TEMPLATES)
    prose = ["the", "license", "software", "of", "warranty", "and", "river", "copyright", "under", "permission", "4.0", "MIT"]
    for _ in range(60):
        parts = []
        for _ in range(r.randint(1, 4)):
            parts += r.choices(prose, k=r.randint(0, 25))
            notice = license_scan.TEMPLATES[r.choice(names)].split()
            for _ in range(r.choice([0, 0, 1, 2, 5])):  # some stay near, some don't
                k = r.randrange(len(notice))
                notice[k:k + r.randint(0, 1)] = r.choices(prose, k=r.randint(0, 1))
                notice = notice or ["x"]
            parts += notice
        text = " license " + " ".join(parts)
        got = [(name, missing, extra) for _, _, name, _, missing, extra in license_scan.Scanner(license_scan.TEMPLATES).scan(text)]
        assert got == [(name, missing, extra) for name, _, missing, extra in brute_licenses(text)], text


@pytest.mark.parametrize("text, name", [
    ("# SPDX-License-Identifier: MIT", "SPDX-MIT"), ("/* SPDX-License-Identifier: GPL-2.0-or-later */ int x;", "SPDX-GPL-2.0-or-later"),
    ("Distributed under the terms of the MIT license.", "MIT-terms"),
    ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\n"
     "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.", "MIT-warranty")])
def test_license_identifiers_and_warranty(text, name):
    assert [n for _, _, n in found_in(text)] == [name]
    assert found_in("SPDX-License-Identifier: of no known license") == []


def test_license_reduction_ranks_the_own_template_first():
    tool = license_scan.Scanner(license_scan.TEMPLATES)
    for name, text in license_scan.TEMPLATES.items():
        assert tool.reductions(text)[0][1] == name


def labelled(spark, n=300):
    r = random.Random(8)
    good, bad = ["water", "stone", "tree", "sky", "bird", "river"], ["BUY", "CLICK", "win$$$", "cash!!!", "FREE###"]
    rows, labels = [], []
    for k in range(n):
        q = int(r.random() < 0.8)
        rows.append((k, " ".join(r.choice(good if q else bad) for _ in range(r.randint(5, 60)))))
        labels.append((k, q, 0))
    labels += [(0, None, 0), (None, 1, 0), (99_999, 1, 0), (5, 7, 0)]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out_accuracy(spark):
    rows, labels = labelled(spark)
    docs = corpus.frame(spark, rows + [(None, None), (4000, ""), (4001, "tree " * 50_000)])
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held = [(k, q) for k, q, _ in labels.where("quality in (0, 1) and doc_id < 300").collect() if brute.zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum((got[k] >= 0.5) == bool(q) for k, q in held) >= 0.95 * len(held)
    prior = 1 / (1 + math.exp(-model.bias))
    assert got[None] == pytest.approx(prior) and got[4000] == pytest.approx(prior) and got[4001] > 0.5
    again = quality.fit(docs.repartition(5), labels)
    assert np.array_equal(again.weights, model.weights)


def test_quality_held_out_labels_are_never_read(spark):
    rows, labels = labelled(spark, 120)
    docs = corpus.frame(spark, rows)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.fit(docs, labels).weights, quality.fit(docs, flipped).weights)


def test_quality_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, none)
    assert {r.score for r in quality.score(docs, model).collect()} == {0.5}
    assert quality.score(empty, model).count() == 0


def test_quality_whole_texts_in_slices(monkeypatch):
    buf, offs = quality.buffer_of(pa.array([t for _, t in ROWS]))
    model = quality.Model(np.random.default_rng(0).standard_normal(quality.BUCKETS).astype(np.float32), 0.1)
    whole = model.scores(buf, offs)
    single = [model.scores(*quality.buffer_of(pa.array([t])))[0] for _, t in ROWS]
    assert np.allclose(whole, single)


def brute_quality(text, model):
    """The mean weight of a text's words and 3-5-byte strings, one after the other."""
    data = (text or "").encode()
    plain = bytes(b if quality.SPACED[b] else 32 for b in data)
    found = [m.group() for m in brute.re.finditer(rb"[^ ]+", plain)]
    for n in quality.NGRAMS:  # a string may begin with the blank before its word
        found += [plain[i:i + n] for i in range(len(plain) - n + 1) if b" " not in plain[i + 1:i + n]]
    shift = np.uint64(64 - quality.BUCKETS.bit_length() + 1)
    total = 0.0
    for x in found:
        values = quality.BYTE_VALUES[np.frombuffer(x, np.uint8)]
        total += model.weights[int(quality.window_hash(quality.prefix(values), np.array([0]), np.array([len(x)]))[0] >> shift)]
    return 1 / (1 + math.exp(-(total / max(len(found), 1) + model.bias)))


def test_quality_scores_against_plain_python(monkeypatch):
    model = quality.Model(np.random.default_rng(0).standard_normal(quality.BUCKETS).astype(np.float32), 0.1)
    rows = [t for _, t in ROWS if not t or len(t) < 3000]
    want = [brute_quality(t, model) for t in rows]
    for size in (quality.PIECE_BYTES, 40, 7):  # cutting a text changes no feature
        monkeypatch.setattr(quality, "PIECE_BYTES", size)
        assert model.scores(*quality.buffer_of(pa.array(rows))) == pytest.approx(want, rel=1e-5)


def test_quality_training_features_whatever_the_piece(monkeypatch):
    """The training task's features are the same, however texts are cut."""
    texts = [*(t for _, t in ROWS), "ab " * 500 + "x" * 700 + " ab\tab", None, ""]
    buf, offs = quality.buffer_of(pa.array(texts))
    want = []
    for a, z in zip(offs[:-1], offs[1:]):
        found = [b for _, b in quality.features(buf[a:z], np.array([0, z - a]))] if z > a else [np.zeros(0, np.int64)]
        key, count = np.unique(np.concatenate(found), return_counts=True)
        want.append((key.tolist(), (count.astype(np.float32) / np.float32(max(count.sum(), 1))).tolist()))
    for size in (quality.PIECE_BYTES, 1000, 40, 7):
        monkeypatch.setattr(quality, "PIECE_BYTES", size)
        assert [(k.tolist(), c.tolist()) for k, c in quality.bags(buf, offs)] == want


@pytest.mark.parametrize("n", [1, 1000])
def test_quality_training_features_take_little_memory(n):
    """3 MB of texts, one long or many: scratch arrays are those of one piece
    (over 400 MB when rows of 2 MB, or a whole long text, were hashed at once)."""
    r = random.Random(n)
    vocab = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9))) for _ in range(5000)]
    buf, offs = quality.buffer_of(pa.array([" ".join(r.choices(vocab, k=500_000 // n)) for _ in range(n)]))
    assert len(buf) > 2_500_000
    tracemalloc.start()
    got = list(quality.bags(buf, offs))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == n
    assert peak - sum(a.nbytes + b.nbytes for a, b in got) < 1e8


def test_quality_query(spark, sf_dir):
    folder, rows, _ = sf_dir
    got = queries.op9(spark, folder).collect()
    assert len(got) == len(rows)
    model = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append(t)
    for r in got:
        assert r.held_out == (brute.zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1
        if all(len(t or "") < 3000 for t in texts[r.doc_id]):
            assert any(r.score == pytest.approx(brute_quality(t, model), rel=1e-4) for t in texts[r.doc_id])


@pytest.fixture(scope="module")
def sf_dir(spark):
    """Tables of a small corpus; contaminated rows and near copies among them."""
    rows, labels = labelled(spark, 60)
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    items = [(k, " ".join(word() for _ in range(30))) for k in range(3)]
    body = [[word() for _ in range(80)] for _ in range(8)]
    rows += [(1000 + k, " ".join(body[k % 8][:k % 5 + 75])) for k in range(30)]
    rows += [(2000 + k, " ".join(word() for _ in range(40)) + " " + " ".join(items[k][1].split()[3:20])) for k in range(3)]
    rows += [(3000, " ".join(word() for _ in range(400)) + " " + " ".join(items[0][1].split()[:13])), (3001, "ü" * 60 + "a"), (3002, "é" + "ü" * 60)]
    rows += [(d if d is None or d >= 900 else d + 5000, t) for d, t in ROWS[-12:]]
    folder = scratch_dir(spark, "tables")
    corpus.frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_pipeline_stages(spark, sf_dir, oracle):
    """Every stage against plain Python on what the stage before kept (the
    classifier against its own scores)."""
    folder, rows, items = sf_dir
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    take = lambda df: [(r.doc_id, r.text) for r in df.collect()]

    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    kept = corpus_pipeline.quality_stage(spark, docs, folder)
    assert kept.columns == names
    score = lambda t: model.scores(*quality.buffer_of(pa.array([t])))[0]
    assert ordered(take(kept)) == ordered([(d, t) for d, t in rows if score(t) >= 0.3])
    rows = take(kept)

    one = corpus_pipeline.near_duplicate_stage(spark, kept, folder)
    assert one.columns == names
    stay = [(d, t) for (d, t), (_, _, c) in zip(rows, brute.jaccard_links(rows)) if c == d]
    stay = [x for k, x in enumerate(stay) if x not in stay[:k] or not brute.shingles(x[1])]
    assert ordered(take(one)) == ordered(stay)

    cut = corpus_pipeline.substring_stage(spark, one, folder)
    assert cut.columns == names
    gone = {(d, t): n for (d, t), (_, _, n, _, _) in zip(stay, brute.repeated_bytes(stay))}
    after = {r.doc_id: r for r in cut.where("doc_id is not null").collect()}
    for (d, t), n in gone.items():
        if d is not None:
            if n == 0:
                assert after[d].text == t
            else:
                assert len(after[d].text.encode()) <= len(t.encode()) - n and after[d].n_chars == len(after[d].text)
    assert any(gone.values())
    assert cut.count() == len(stay)
    rows = take(cut)

    clean = corpus_pipeline.decontamination_stage(spark, cut, folder)
    assert clean.columns == names
    assert ordered(take(clean)) == ordered([(d, t) for d, t in rows if not brute.decontamination([(d, t)], items)[d][4]])
    assert not {2000, 2001, 2002} & {d for d, _ in take(clean)} and 3000 in {d for d, _ in take(clean)}

    ids = corpus_pipeline.tokenize_stage(spark, clean, folder)
    assert ordered([(r.doc_id, tuple(r.token_ids), r.n_tokens, r.round_trip) for r in ids.collect()]) == ordered(
        [(d, tuple(x := oracle.encode_ordinary(t or "")), len(x), True) for d, t in take(clean)])
    assert ordered([(r.doc_id, tuple(r.token_ids)) for r in corpus_pipeline.run(spark, folder).collect()]) == ordered([(r.doc_id, tuple(r.token_ids)) for r in ids.collect()])


def test_pipeline_on_empty_tables(spark, empty, sf_dir):
    folder = scratch_dir(spark, "tables")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir[0]}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    empty.write.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_whole_characters_go(spark):
    rows = corpus.frame(spark, [(1, "ü" * 60 + "a"), (2, "é" + "ü" * 60)])
    got = suffix_refine.dedup(rows, whole_characters=True).where("doc_id = 2").first()
    assert bytes(got.kept).decode() == "é"


SMALL = "/root/testdata/sf0.001"


def test_queries_match_their_sql(spark):
    import __spark_entry__ as E
    from crawlgrid.llm.registry import ORACLES, QUERIES
    from crawlgrid.plans.compare import compare, duck_connect

    assert {n.split("_")[0] for n in QUERIES} == {"pipeline", *(f"op{k}" for k in range(1, 14))}
    assert QUERIES.items() <= E.queries().items()
    con = duck_connect(SMALL)
    for name, sql in ORACLES.items():
        got = compare(QUERIES[name](spark, SMALL), con, sql)
        assert got["match"], (name, got)
