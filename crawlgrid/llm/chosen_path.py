"""N-gram Jaccard join by chosen paths.

Documents are sets of shingles of ``n`` words (runs without white space,
unchanged; a text of fewer words, but not none, is one shingle). Documents of
equal sets form one class. Two classes link if their Jaccard similarity is at
least ``threshold``.

Candidates come from a random tree, walked breadth-first: in each run a set
follows every token whose hash, for the path so far, is small enough that sets
similar enough share a next token about once a level. First the tokens are the
shingles themselves, deeper they are entries of the set's minhash signature.
Sets that are alone on a path drop out; a path with at most ``LEAF`` sets is
compared by brute force on signatures; larger ones are split again, unless
nearly all sets agree with one of them already, and what is still together
after ``DEPTH`` splits is kept together. Runs are repeated until a pair
at the threshold is met with probability ``recall`` at the deepest level.

Candidate groups (connected candidates) are then settled exactly on whole
sets, every pair of a group once, in tiles of ``TILE`` sets: links are counted
where they are found and only spanning links leave the task. So a pair that
no run met is still found if it lies in one group.

Null and empty texts have no shingles and link with nothing. Rows with a null
id are returned without links and class, and nothing links to them. Repeated
rows count as copies.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgrid.session import scratch_dir

from .components import components, local_roots, saved
from .textbuf import SPACED, buffer_of, hashed_words, mix64, prefix, returning, slices, window_hash

SHINGLE_WORDS = 5
THRESHOLD = (4, 5)
RECALL = 0.999
DEPTH = 4
LEAF = 64
SLOTS = 32
ALIKE = 0.9  # share of a path's sets that agree with its least, to keep it together
LOOSE = 0.5  # least share of equal signature slots for a candidate (0.8 has 0.07 of deviation)
TILE = 256
BROADCAST_ROWS = 500_000
COLUMNS = 4096


def runs_needed(threshold: float, recall: float) -> int:
    """Runs after which a pair at the threshold has met with this probability,
    should its paths be split to the end. All runs share the signature: how
    many of its slots are equal is binomial, and the miss is averaged over it."""
    meet, share = [], []
    for same in range(SLOTS + 1):
        m = 1.0
        for _ in range(DEPTH):  # of the equal slots, each is followed with probability 1 / (threshold * SLOTS)
            m = 1 - (1 - m / (threshold * SLOTS)) ** same
        # the shingles of the first path: about Poisson with mean 1
        meet.append(1 - math.exp(-m) if same >= LOOSE * SLOTS else 0.0)
        share.append(math.comb(SLOTS, same) * threshold ** same * (1 - threshold) ** (SLOTS - same))
    if sum(p for p, m in zip(share, meet) if not m) >= 1 - recall:
        raise ValueError(f"LOOSE = {LOOSE} loses more than {1 - recall:.2g} of the pairs at {threshold}, whatever the runs")
    runs = 1
    while sum(p * (1 - m) ** runs for p, m in zip(share, meet)) >= 1 - recall:
        runs += 1
    return runs


def shingle_sets(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes end to end, ascending in each row; row offsets)."""
    rows, hashes = hashed_words(buf, offs, SPACED)[2:]
    m = len(offs) - 1
    if not len(rows):
        return np.zeros(0, np.uint64), np.zeros(m + 1, np.int64)
    count = np.bincount(rows, minlength=m)
    stop = np.cumsum(count)
    first = stop - count
    at = np.arange(len(rows))
    at = at[(at + n <= stop[rows]) | (at == first[rows])]
    h = window_hash(prefix(hashes), at, np.minimum(at + n, stop[rows[at]]))
    row = rows[at]
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])))
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(m + 1))


def summed(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    total = np.concatenate(([np.uint64(0)], np.cumsum(values, dtype=np.uint64)))
    return total[cut[1:]] - total[cut[:-1]]


def seeds(count: int) -> np.ndarray:
    return mix64(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def fraction(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def row_key(id_col: str, text_col: str) -> F.Column:
    """Tells rows apart that share an id but not a text."""
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


def without_set(id_col: str, text_col: str) -> F.Column:
    """Rows with no id or no shingles."""
    return F.col(id_col).isNull() | ~F.coalesce(text_col, F.lit("")).rlike(r"[^\x20\x09-\x0D]")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))


SKETCH = "doc_id long, key long, s1 long, s2 long, size long, signature binary, paths array<long>"


def sketch(docs: DataFrame, n: int, threshold: float, runs: int, id_col: str, text_col: str) -> DataFrame:
    """For each row with shingles: set identity, size, minhash signature and first paths."""
    names = [x.split()[0] for x in SKETCH.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot_seeds, run_seeds = seeds(SLOTS), seeds(SLOTS + runs)[SLOTS:]
        for batch in batches:
            whole, ends = buffer_of(batch.column(2))
            for i, j in slices(ends):
                h, cut = shingle_sets(whole[ends[i]:ends[j]], ends[i:j + 1] - ends[i], n)
                size = np.diff(cut)
                on = np.flatnonzero(size)
                if not len(on):
                    continue
                s1, s2 = summed(mix64(h), cut)[on], summed(mix64(h ^ np.uint64(0x5851F42D4C957F2D)), cut)[on]
                signature = np.stack([np.minimum.reduceat(mix64(h ^ s), cut[on]) >> np.uint64(32) for s in slot_seeds], 1).astype(np.uint32)
                share = np.repeat(1 / (threshold * np.maximum(size, 1)), size)
                row = np.repeat(np.arange(len(size)), size)
                picked, owner = [], []
                for s in run_seeds:
                    x = mix64(h ^ s)
                    hit = fraction(x) < share
                    picked.append(mix64(x[hit] + s))
                    owner.append(row[hit])
                picked, owner = np.concatenate(picked), np.concatenate(owner)
                order = np.argsort(owner, kind="stable")
                path_cut = np.searchsorted(owner[order], np.append(on, len(size)))
                yield pa.RecordBatch.from_arrays([
                    *(c.slice(i, j - i).take(pa.array(on)) for c in batch.columns[:2]), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array(size[on]),
                    pa.array([x.tobytes() for x in signature], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(path_cut.astype(np.int32)), pa.array(picked[order].view(np.int64)))], names=names)

    return keyed(docs, id_col, text_col).select("doc_id", "key", "text").mapInArrow(returning(run), SKETCH)


def split_further(rows: DataFrame, threshold: float) -> DataFrame:
    """(path, node, signature) -> the paths one token deeper."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            path = batch.column(0).to_numpy().view(np.uint64)
            slots = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, SLOTS).astype(np.uint64)
            token = mix64(slots << np.uint64(8) | np.arange(SLOTS, dtype=np.uint64))
            x = mix64(token ^ path[:, None])
            row, slot = np.nonzero(fraction(x) < 1 / (threshold * SLOTS))
            yield pa.RecordBatch.from_arrays([pa.array(mix64(x[row, slot] + np.uint64(1)).view(np.int64)), batch.column(1).take(pa.array(row))], names=["path", "node"])

    return rows.select("path", "node", "signature").mapInArrow(returning(run), rows.select("path", "node").schema)


def leaf_links(rows: DataFrame) -> DataFrame:
    """Brute force on paths of at most LEAF sets: spanning links of the pairs
    whose signatures agree well enough."""
    out = rows.select(F.col("node").alias("u"), F.col("node").alias("v")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, blobs in grouped(batches, 1):
            slots = np.frombuffer(b"".join(blobs[1].to_pylist()), np.uint32).reshape(-1, SLOTS)
            same = (slots[:, None, :] == slots[None, :, :]).mean(2) >= LOOSE
            a, b = np.nonzero(np.triu(same, 1))
            root = local_roots(len(slots), a, b)
            far = np.flatnonzero(root != np.arange(len(root)))
            if len(far):
                yield pa.RecordBatch.from_arrays([blobs[0].take(pa.array(far)), blobs[0].take(pa.array(root[far]))], names=["u", "v"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("path", "node", "signature").repartition(parts, "path").sortWithinPartitions("path").mapInArrow(returning(run), out)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.Array]]]:
    """(key, other columns) of each run of equal keys in sorted batches."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(k)) for k in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cut = np.append(np.flatnonzero(new), batch.num_rows)
        for s, e in zip(cut[:-1], cut[1:]):
            key = tuple(c[s] for c in cols)
            if held and key != held_key:
                yield held_key, _joined(held, keys)
                held = []
            held.append(batch.slice(s, e - s))
            held_key = key
    if held:
        yield held_key, _joined(held, keys)


def _joined(held: list[pa.RecordBatch], keys: int) -> list[pa.Array]:
    table = pa.Table.from_batches(held).combine_chunks()
    return [table.column(k).chunk(0) for k in range(keys, table.num_columns)]


def to_least(rows: DataFrame) -> DataFrame:
    """All sets of a path as candidates of its least."""
    return rows.where(F.col("node") != F.col("least")).select(F.col("node").alias("u"), F.col("least").alias("v"))


def alike_paths(large: DataFrame, sizes: DataFrame, signatures: DataFrame) -> DataFrame:
    """Paths nearly all of whose sets agree with the least one's signature:
    splitting these (a group of near copies) would only carry them on."""
    leaders = sizes.select("path", F.col("least").alias("node")).join(signatures, "node").select("path", F.col("signature").alias("leader"))
    same = sum((F.substring("signature", 4 * k + 1, 4) == F.substring("leader", 4 * k + 1, 4)).cast("int") for k in range(SLOTS))
    judged = large.join(leaders, "path").select("path", (same >= LOOSE * SLOTS).cast("int").alias("near"))
    return judged.groupBy("path").agg(F.avg("near").alias("near")).where(F.col("near") >= ALIKE).select("path")


def candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """Candidate links (u, v) between class nodes."""
    signatures = classes.select("node", "signature")
    level = classes.select(F.explode("paths").alias("path"), "node").distinct()
    found = None
    for depth in range(DEPTH + 1):
        # saved, so that the join has a shuffle on both sides and a hot path can be split
        sizes = saved(level.groupBy("path").agg(F.count("*").alias("sets"), F.min("node").alias("least")).where("sets > 1"))
        met = level.join(sizes, "path")
        if depth < DEPTH:
            rows, large_rows = sizes.agg(F.coalesce(F.sum("sets"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("sets") > LEAF, F.col("sets"))), F.lit(0))).first()
            met = saved(met.join(signatures, "node"), rows)
            links = leaf_links(met.where(F.col("sets") <= LEAF))
            if large_rows:
                large = met.where(F.col("sets") > LEAF)
                alike = saved(alike_paths(large, sizes.where(F.col("sets") > LEAF), signatures))
                links = links.unionByName(to_least(large.join(alike, "path", "left_semi")))
                level = saved(split_further(large.join(alike, "path", "left_anti"), threshold).distinct(), large_rows)
        else:
            links = leaf_links(met.where(F.col("sets") <= LEAF).join(signatures, "node"))
            links = links.unionByName(to_least(met.where(F.col("sets") > LEAF)))
        found = links if found is None else found.unionByName(links)
        if depth == DEPTH or not large_rows or level.isEmpty():
            break
    return found.distinct()


EXACT = "u struct<rep:long,s1:long>, v struct<rep:long,s1:long>, links long"


def settle(docs: DataFrame, members: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """Exact comparison of all pairs in each candidate group. Rows (u, null,
    links): links found for u; rows (u, v, null): spanning links."""
    spark = docs.sparkSession
    sizes = members.groupBy("root").agg(F.count("*").alias("sets"))
    tiled = (members.join(sizes, "root")
             .withColumn("tiles", F.ceil(F.col("sets") / TILE).cast("int"))
             .withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
             .select(F.col("node.rep").alias("id"), F.col("node.s1").alias("s1"), F.xxhash64("root").alias("group"), "tiles", "tile", "copies"))
    tiled = saved(tiled)
    if tiled.count() <= BROADCAST_ROWS:  # 48 bytes a row
        tiled = F.broadcast(tiled)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(tiled, "id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, ends = buffer_of(batch.column(1))
            for i, j in slices(ends):
                h, cut = shingle_sets(whole[ends[i]:ends[j]], ends[i:j + 1] - ends[i], n)
                own = summed(mix64(h), cut).view(np.int64) == batch.column(2).slice(i, j - i).to_numpy()
                at = np.flatnonzero(own)  # a repeated id may belong to another text
                blobs = pa.array([h[cut[k]:cut[k + 1]].tobytes() for k in at], pa.binary())
                yield pa.RecordBatch.from_arrays([c.slice(i, j - i).take(pa.array(at)) for c in (batch.column(0), *batch.columns[2:])] + [blobs], names=["id", "s1", "group", "tiles", "tile", "copies", "set"])

    whole = texts.select("id", "text", "s1", "group", "tiles", "tile", "copies").mapInArrow(
        sets, "id long, s1 long, group long, tiles int, tile int, copies long, set binary")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least(k, F.col("tile")).alias("a"), F.greatest(k, F.col("tile")).alias("b")))
    spread = whole.withColumn("pair", F.explode(pairs)).select("group", "pair.a", "pair.b", "tile", "id", "s1", "copies", "set")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["u", "v", "links"]

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, a, b), cols in grouped(batches, 3):
            yield from _compare(int(a), int(b), cols, num, den, names)

    return spread.repartition(parts, "group", "a", "b").sortWithinPartitions("group", "a", "b").mapInArrow(returning(exact), EXACT)


def _compare(a: int, b: int, cols: list[pa.Array], num: int, den: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    tile, ids, s1, copies = (np.asarray(c) for c in cols[:4])
    order = np.lexsort((s1, ids))
    first = np.concatenate(([True], (ids[order][1:] != ids[order][:-1]) | (s1[order][1:] != s1[order][:-1])))
    order = order[first]  # a class once, however often its row is repeated; least id first
    tile, ids, s1, copies = tile[order], ids[order], s1[order], copies[order]
    sets = [np.frombuffer(cols[4][k].as_py(), np.uint64) for k in order]
    size = np.array([len(x) for x in sets])
    token, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(count > 1) - 1
    row = np.repeat(np.arange(len(sets)), size)
    on = count[column] > 1  # a shingle of one set adds to no intersection
    row, column = row[on], shared[column[on]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    left, right = (np.flatnonzero(tile == a), np.flatnonzero(tile == b))
    common = np.zeros((len(left), len(right)), np.float32)
    for c in range(0, int(shared[-1]) + 1 if len(shared) else 0, COLUMNS):
        s, e = np.searchsorted(column, (c, c + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[s:e], column[s:e] - c] = 1
        common += part[left] @ part[right].T
    linked = common * (num + den) >= num * (size[left][:, None] + size[right][None, :]) - 0.25
    linked &= left[:, None] != right[None, :]
    links = np.zeros(len(sets), np.int64)
    links[left] = linked @ copies[right]
    if a != b:
        links[right] = linked.T @ copies[left]
    x, y = np.nonzero(linked)
    root = local_roots(len(sets), left[x], right[y])
    far, some = np.flatnonzero(root != np.arange(len(root))), np.flatnonzero(links)

    def node(k: np.ndarray) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(ids[k]), pa.array(s1[k])], ["rep", "s1"])

    kind = pa.struct([("rep", pa.int64()), ("s1", pa.int64())])
    yield pa.RecordBatch.from_arrays([pa.concat_arrays([node(some), node(far)]), pa.concat_arrays([pa.nulls(len(some), kind), node(root[far])]),
                                      pa.concat_arrays([pa.array(links[some]), pa.nulls(len(far), pa.int64())])], names=names)


def join(docs: DataFrame, n: int = SHINGLE_WORDS, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, class_id, copies, n_links, component_id) of each row: its
    ``row_key``, the least id with an equal set, the rows with that set, the
    other rows linked directly, and the least id reachable by links."""
    return linked(docs, n, threshold, recall, id_col, text_col).drop("component_key")


def linked(docs: DataFrame, n: int = SHINGLE_WORDS, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL,
           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``join``, with what tells components of the same least id apart (ids
    may recur); null for rows without a set."""
    spark = docs.sparkSession
    num, den = threshold
    share = num / den
    path = scratch_dir(spark, "chosen-path")
    sketch(docs, n, share, runs_needed(share, recall), id_col, text_col).write.parquet(path)
    rows = spark.read.parquet(path)
    classes = (rows.where("doc_id is not null").groupBy("s1", "s2")
               .agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("signature").alias("signature"), F.first("paths").alias("paths"))
               .withColumn("node", F.struct("rep", "s1")))
    classes = saved(classes)
    groups = components(candidates(classes, share))
    members = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct()).join(classes.select("node", "copies"), "node")
    exact = saved(settle(docs, members, n, num, den, id_col, text_col))
    links = exact.where("links is not null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(exact.where("links is null").select("u", "v"))
    known = (classes.join(links, "node", "left").join(roots, "node", "left")
             .select("s1", "s2", F.col("rep").alias("class_id"), "copies", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce(F.col("root.rep"), F.col("rep")).alias("component_id"), F.coalesce(F.col("root.s1"), F.col("s1")).alias("component_key")))
    has = rows.where("doc_id is not null").select("doc_id", "key", "s1", "s2").join(known, ["s1", "s2"]).select("doc_id", "key", "class_id", "copies", "n_links", "component_id", "component_key")
    one = F.lit(1).cast("long")
    lone = keyed(docs, id_col, text_col).where(without_set("doc_id", "text"))
    lone = lone.select("doc_id", "key", F.col("doc_id").alias("class_id"), one.alias("copies"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component_key"))
    return has.unionByName(lone)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group: that of the least id, of several with this id the
    one of least key. Rows without an id or without shingles all stay."""
    got = linked(docs, id_col=id_col, text_col=text_col, **options)
    own = got.where("component_key is not null and doc_id = component_id").groupBy("component_id", "component_key", "key").agg(F.count("*").alias("rows"))
    least = own.groupBy("component_id", "component_key").agg(F.min(F.struct("key", "rows")).alias("least")).select("least.*")
    stay = saved(least.unionByName(got.where("component_key is null").select("key", F.lit(0).cast("long").alias("rows")).distinct()))
    name = "_row_key_" + uuid.uuid4().hex
    kept = docs.withColumn(name, row_key(id_col, text_col)).join(stay.select(F.col("key").alias(name)), name, "left_semi")
    if not stay.where("rows > 1").isEmpty():
        lone = without_set(id_col, text_col)
        kept = kept.where(lone).unionByName(kept.where(~lone).dropDuplicates([name]))
    return kept.select(*docs.columns)
