"""Job item / log files and package files.

Job files are many and mostly small, some up to 1 GB, and the reader is
planned by bytes. Files of up to ``SMALL_FILE`` bytes come as whole files from
the ``binaryFile`` source, which packs many of them into a task; their lines
are numbered by exploding them where they lie, without a shuffle. Longer ones
come from the text source, which splits them by byte ranges at line ends;
each range counts its lines, a prefix sum over a file's ranges gives each
one's first line, and a row's number is that plus its place in the range. So
a 1 GB log of one job is numbered by all the tasks that scan it. Which source
reads a file is decided by the listing alone: both filter on the length
before anything is opened.

Millions of files of a few hundred bytes each take a disk block apiece and are
all listed on the driver. They can be kept in packs instead: parquet files of
(path, lines, length, content) beside the plain ones, which hold the files of
up to ``PACKED_FILE`` bytes byte for byte. The readers take both.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crawlgrid.functions.audit import package_checksum
from crawlgrid.functions.text import package_info_version, version_key
from crawlgrid.operators.logs import DEFAULT_CHARSETS, choose_charset, decoded, fits

SMALL_FILE = 8 << 20
# longer files stay files of their own, so these are few; a reader's batch of
# 4096 packed ones takes half a GB at most
PACKED_FILE = 128 << 10
PACK_FILES = 100_000  # files in a pack

# --- fixed values: storage layouts (v1, v2) ---
_V1 = r"(?:^|/)(items|logs)/([^/]+)/([^/]+)/([^/]+)\.(jl|log)$"
_V2 = r"(?:^|/)projects/(\d+)/spiders/([^/]+)/jobs/([^/]+)/(items\.jl|job\.log)$"
_PKG_V1 = r"(?:^|/)eggs/([^/]+)/([^/]+)\.egg$"
_PKG_V2 = r"(?:^|/)projects/(\d+)/eggs/([^/]+)\.egg$"


def job_file_index(paths: DataFrame, path_col: str = "path") -> DataFrame:
    """Layout, kind, project, spider, job id (or package version) of a
    path in one of the crawl server's two layouts. Unknown paths get NULL layout."""
    p = F.col(path_col)

    def x(pat, i):
        return F.regexp_extract(p, pat, i)

    is_v1, is_v2 = F.regexp_like(p, F.lit(_V1)), F.regexp_like(p, F.lit(_V2))
    is_p1, is_p2 = F.regexp_like(p, F.lit(_PKG_V1)), F.regexp_like(p, F.lit(_PKG_V2))
    layout = (F.when(is_v1 | is_p1, "v1").when(is_v2 | is_p2, "v2"))
    kind = (F.when(is_v1, F.when(x(_V1, 1) == "items", "items").otherwise("log"))
            .when(is_v2, F.when(x(_V2, 4) == "items.jl", "items").otherwise("log"))
            .when(is_p1 | is_p2, "package"))
    project = (F.when(is_v1, x(_V1, 2)).when(is_v2, x(_V2, 1))
               .when(is_p1, x(_PKG_V1, 1)).when(is_p2, x(_PKG_V2, 1)))
    spider = F.when(is_v1, x(_V1, 3)).when(is_v2, x(_V2, 2))
    job = F.when(is_v1, x(_V1, 4)).when(is_v2, x(_V2, 3))
    version = F.when(is_p1, x(_PKG_V1, 2)).when(is_p2, x(_PKG_V2, 2))
    return paths.select("*", layout.alias("layout"), kind.alias("kind"), project.alias("project"),
                        spider.alias("spider"), job.alias("job_id"), version.alias("version"))


def whole_files(spark: SparkSession, paths, glob: str | None = None, most: int = SMALL_FILE) -> DataFrame:
    """(path, content) of the files of up to ``most`` bytes; the length filter is
    pushed into the listing."""
    options = {"pathGlobFilter": glob} if glob else {}
    return (spark.read.format("binaryFile").options(recursiveFileLookup="true", **options).load(paths)
            .where(F.col("length") <= most).select("path", "content"))


def pack_folder(root: str, kind: str) -> str:
    return root.rstrip("/") + f"/_packs-{kind}"


def packed_files(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """(path, length, content) of the files in the packs of a kind under ``root``."""
    return spark.read.parquet(pack_folder(root, kind)).where(F.col("content").isNotNull()).select("path", "length", "content")


def split_lines(text: Column) -> Column:
    """The lines of a whole text: only '\\n' ends a line, the last may lack it."""
    parts = F.split(text, "\n", -1)
    return F.slice(parts, F.lit(1), F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0))


def whole_lines(files: DataFrame) -> DataFrame:
    """(path, line_no, line) of whole files (path, content) in UTF-8."""
    rows = files.select("path", F.posexplode(split_lines(F.make_valid_utf8(F.col("content").cast("string")))).alias("_pos", "line"))
    return rows.select("path", (F.col("_pos") + 1).cast("long").alias("line_no"), "line")


def _plain_path(file_path: Column) -> Column:
    """``_metadata.file_path`` is percent-encoded, the path column of ``binaryFile`` isn't."""
    return F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))


def long_lines(spark: SparkSession, paths, glob: str | None = None, least: int = SMALL_FILE,
               charsets: Sequence[str] = ("UTF-8",)) -> DataFrame:
    """(path, line_no, line, charset) of the files of more than ``least`` bytes.
    The charset is chosen per file, the first that fits all its lines; where
    none does, the file gives one row without a line."""
    options = {"pathGlobFilter": glob} if glob else {}
    df = spark.read.options(lineSep="\n", recursiveFileLookup="true", **options).text(paths)
    df = df.where(F.col("_metadata.file_size") > least).select(
        F.col("value").cast("binary").alias("_raw"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_mid"))
    splits = df.groupBy("_file", "_split").agg(
        F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"), *[F.bool_and(fits(F.col("_raw"), c)).alias(f"_fits{k}") for k, c in enumerate(charsets)])
    whole = Window.partitionBy("_file")
    earlier = whole.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    good = [F.bool_and(f"_fits{k}").over(whole) for k in range(len(charsets))]
    splits = splits.select(F.col("_file").alias("_f"), F.col("_split").alias("_s"), "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
                           F.coalesce(*[F.when(g, F.lit(c)) for g, c in zip(good, charsets)]).alias("charset"))
    met = df.join(splits, (F.col("_file") == F.col("_f")) & (F.col("_split") == F.col("_s")))
    number = (F.col("_before") + F.col("_mid") - F.col("_first") + 1).cast("long")
    return (met.withColumn("line_no", number).where(F.col("charset").isNotNull() | (F.col("line_no") == 1))
            .select(_plain_path(F.col("_file")).alias("path"), "line_no", decoded(F.col("_raw"), F.col("charset"), charsets).alias("line"), "charset"))


def read_lines(spark: SparkSession, paths, glob: str | None = None, charsets: Sequence[str] | None = None,
               small_file: int = SMALL_FILE, packs: str | None = None) -> DataFrame:
    """Every line of every file under ``paths`` with its exact 1-based line
    number in its file: (path, line_no, line). Only '\\n' ends a line. With
    ``packs`` (their kind) the files packed under the one path are read, too.

    Without ``charsets`` the text is UTF-8, malformed bytes replaced. With
    them each file is decoded as a whole with the first that fits (I3) and
    ``charset`` is returned, too; a file that none fits gives one row with a
    NULL line, so that its job isn't lost."""
    files = whole_files(spark, paths, glob, small_file)
    if packs:
        files = files.unionByName(packed_files(spark, paths, packs).select("path", "content"))
    if charsets is None:
        return whole_lines(files).unionByName(long_lines(spark, paths, glob, small_file).drop("charset"))
    files = files.withColumn("charset", choose_charset(F.col("content"), charsets))
    lines = F.coalesce(split_lines(decoded(F.col("content"), F.col("charset"), charsets)), F.array(F.lit(None).cast("string")))
    rows = files.select("path", "charset", F.posexplode(lines).alias("_pos", "line"))
    small = rows.select("path", (F.col("_pos") + 1).cast("long").alias("line_no"), "line", "charset")
    return small.unionByName(long_lines(spark, paths, glob, small_file, charsets))


LINE_END = "__line_end__"


def item_object(raw: Column) -> Column:
    """The object on an item line as a map (nested values as JSON text); NULL
    unless the whole line is one strict JSON object. The parser stops at the
    end of the first value it reads, so the line is put into an array whose
    second and last element it must leave in place: text, a second object or
    further elements behind the first break that. Single quotes are no JSON."""
    both = F.from_json(F.concat(F.lit("["), raw, F.lit(f',{{"{LINE_END}":1}}]')), "array<map<string,string>>", {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"})
    return F.when((F.size(both) == 2) & (F.get(both, F.lit(1))[LINE_END] == "1"), F.get(both, F.lit(0)))


def json_variant(raw: Column) -> Column:
    """A text as VARIANT; NULL unless all of it is one strict JSON value."""
    both = F.try_parse_json(F.concat(F.lit("["), raw, F.lit(f',"{LINE_END}"]')))
    whole = (F.try_variant_get(both, "$[1]", "string") == LINE_END) & F.try_variant_get(both, "$[2]", "variant").isNull()
    return F.when(whole, F.try_variant_get(both, "$[0]", "variant"))


def item_variant(raw: Column) -> Column:
    """The object on an item line as VARIANT: numbers, booleans, nulls and nesting
    keep their types; NULL unless the whole line is one strict JSON object."""
    return F.when(F.regexp_like(raw, F.lit(r"^[ \t\r\n]*\{")), json_variant(raw))


def parse_items(lines: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Parse item lines: ``item`` (VARIANT) and ``bad`` for lines that are blank,
    not strict JSON, or not a JSON object."""
    return lines.withColumn("item", item_variant(F.col(raw_col))).withColumn("bad", F.col("item").isNull())


def read_job_items(spark: SparkSession, root, glob: str = "*.jl", fmt: str = "text", small_file: int = SMALL_FILE) -> DataFrame:
    """Every item line of every job under ``root`` (a path or several) with
    its parsed object; malformed lines are kept with ``bad = true``.

    ``fmt='text'``: raw JSON-lines files in the crawl server's layouts, numbered
    exactly by ``read_lines``; ``fmt='packed'``: those and the packed ones.
    ``fmt='store'``: the parquet store written by ``write_job_data`` (W1),
    which already carries job_id and line_no.
    """
    if fmt == "store":
        lines = spark.read.parquet(root).select("project", "spider", "job_id", "line_no", "raw")
    else:
        lines = job_file_index(read_lines(spark, root, glob, small_file=small_file, packs="items" if fmt == "packed" else None)).where(F.col("kind") == "items").select(
            "project", "spider", "job_id", "line_no", F.col("line").alias("raw"))
    return parse_items(lines)


def read_job_logs(spark: SparkSession, root, glob: str = "*.log", charsets: Sequence[str] = DEFAULT_CHARSETS,
                  small_file: int = SMALL_FILE, packed: bool = False) -> DataFrame:
    """S3 (+ I3): every log line of every job under ``root``, in order, each file
    decoded with the first of ``charsets`` that fits it (``charset``). A log
    that none fits is one row with a NULL line: no facts, but the job stays.
    ``packed``: the packed files, too."""
    lines = job_file_index(read_lines(spark, root, glob, charsets, small_file, "logs" if packed else None))
    return lines.where(F.col("kind") == "log").select("project", "spider", "job_id", "line_no", "line", "charset")


def package_versions(file_index: DataFrame) -> DataFrame:
    """Package versions per project in loose-version order (the listing),
    with the latest flagged. The listing is a global sort (range-partitioned,
    so a project with very many versions is split across tasks); the latest
    per project is a decomposable max_by."""
    pk = file_index.where(F.col("kind") == "package").select("project", "version")
    latest = (pk.groupBy("project").agg(F.max_by("version", F.struct(version_key("version"), "version"))
                                        .alias("_latest")))
    return (pk.join(latest, "project")
            .select("project", "version", (F.col("version") == F.col("_latest")).alias("is_latest"))
            .orderBy("project", version_key("version"), "version"))


PKG_INFO = "EGG-INFO/PKG-INFO"
PACKAGE_BATCH = 8  # package files that a Python worker holds at once


def _member(content: bytes, name: str) -> bytes | None:
    """A member of a zip archive, found by its central directory; NULL if the
    archive is damaged or lacks it."""
    import io
    import zipfile

    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            return archive.read(name)
    except (zipfile.BadZipFile, KeyError, EOFError, OSError, RuntimeError, ValueError, NotImplementedError):
        return None


def read_packages(spark: SparkSession, root: str, glob: str = "*.egg", packed: bool = False) -> DataFrame:
    """F10, F16, S5 on package files: (path, layout, project, version as the file
    is named, length, checksum of the bytes, info_version as the archive's
    metadata says; NULL where the archive can't be read or doesn't say). The
    bytes are hashed on the JVM; only a member's text leaves the Python worker.
    ``packed``: the packed files, too."""
    files = spark.read.format("binaryFile").options(pathGlobFilter=glob, recursiveFileLookup="true").load(root).select("path", "length", "content")
    if packed:
        files = files.unionByName(packed_files(spark, root, "packages"))
    named = files.select("path", "length", package_checksum("content").alias("checksum"), "content")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, PACKAGE_BATCH):
                batch = whole.slice(at, PACKAGE_BATCH)
                info = [_member(x.as_buffer().to_pybytes(), PKG_INFO) if x.is_valid else None for x in batch.column(3)]
                text = [None if x is None else x.decode("utf-8", "replace") for x in info]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(text, pa.string())], names=["path", "length", "checksum", "info"])

    read = named.mapInArrow(run, "path string, length long, checksum string, info string")
    return job_file_index(read).where(F.col("kind") == "package").select(
        "path", "layout", "project", "version", "length", "checksum", package_info_version("info").alias("info_version"))


def write_job_files(df: DataFrame, root: str, content_col: str, kind: str, order_col: str | None = None, packed: bool = False) -> DataFrame:
    """Write one file per job under ``root`` in the crawl server's first layout
    (``items/<project>/<spider>/<job>.jl``, ``logs/...log``): a folder a
    spider, not a job. Rows are lines (text, in ``order_col`` order) or, if
    ``content_col`` is binary, bytes that are written as they are. Returns the
    manifest (path, lines, bytes), which is also kept under ``root``.

    A job's rows meet in one task, which streams them to the file in batches;
    it is written under a hidden name and then moved, so a repeated task
    leaves the same file. ``root`` may be on any file system Arrow knows.

    ``packed``: files of up to ``PACKED_FILE`` bytes go into packs, which are
    the manifest, too, and replace the packs that were there."""
    folder, ending = {"items": ("items", ".jl"), "logs": ("logs", ".log")}[kind]
    order = [order_col] if order_col else []
    binary = df.schema[content_col].dataType.typeName() == "binary"
    rows = (df.select("project", "spider", "job_id", F.coalesce(F.col(content_col).cast("binary"), F.lit(b"")).alias("data"), *order)
            .repartition("project", "spider", "job_id").sortWithinPartitions("project", "spider", "job_id", *order)
            .select(F.concat_ws("/", F.lit(folder), "project", "spider").alias("folder"), F.concat("job_id", F.lit(ending)).alias("name"), "data"))
    hold = PACKED_FILE if packed else -1  # bytes that may wait for their pack

    def run(batches: Iterator) -> Iterator:
        import uuid

        import pyarrow as pa

        store, base = _file_system(root)
        state = {"key": None, "out": None, "part": None, "lines": 0, "bytes": 0}
        held: list[bytes] = []
        done: list[tuple[str, int, int, bytes | None]] = []
        waiting = 0

        def close() -> None:
            nonlocal waiting
            if state["key"] is not None:
                path = "/".join(state["key"])
                if state["out"] is not None:
                    state["out"].close()
                    store.move(state["part"], f"{base}/{path}")
                    done.append((path, state["lines"], state["bytes"], None))
                else:
                    done.append((path, state["lines"], state["bytes"], b"".join(held)))
                    waiting += state["bytes"]
                held.clear()

        def plain(key: tuple[str, str]) -> None:
            place = f"{base}/{key[0]}"
            store.create_dir(place, recursive=True)
            part = f"{place}/.{key[1]}.{uuid.uuid4().hex}"
            state.update(out=store.open_output_stream(part), part=part)
            for data in held:
                state["out"].write(data)
            held.clear()

        def opened(key: tuple[str, str]) -> None:
            close()
            state.update(key=key, out=None, part=None, lines=0, bytes=0)

        def manifest() -> pa.RecordBatch:
            nonlocal waiting
            types = (pa.string(), pa.int64(), pa.int64(), pa.binary())
            got = [pa.array(c, t) for c, t in zip(zip(*done), types)]
            done.clear()
            waiting = 0
            return pa.RecordBatch.from_arrays(got, names=["path", "lines", "length", "content"])

        for batch in batches:
            for key0, key1, data in zip(*(c.to_pylist() for c in batch.columns)):
                if (key0, key1) != state["key"]:
                    opened((key0, key1))
                    if len(done) > 1000 or waiting > PACKED_FILE << 4:
                        yield manifest()
                data = data if binary else data + b"\n"
                state["lines"] += 1
                state["bytes"] += len(data)
                if state["out"] is None and state["bytes"] > hold:
                    plain((key0, key1))
                if state["out"] is None:
                    held.append(data)
                else:
                    state["out"].write(data)
        close()
        if done:
            yield manifest()

    written = rows.mapInArrow(run, "path string, lines long, length long, content binary")
    spark, path = df.sparkSession, root.rstrip("/") + f"/_manifest-{kind}"
    if packed:
        path = _write_packs(written, root, kind)
    else:
        written.select("path", "lines", F.col("length").alias("bytes")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path).select("path", "lines", F.col("length").alias("bytes")) if packed else spark.read.parquet(path)


def _write_packs(files: DataFrame, root: str, kind: str) -> str:
    path = pack_folder(root, kind)
    files.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", PACK_FILES).parquet(path)
    return path


def write_packages(packages: DataFrame, root: str, packed: bool = False) -> DataFrame:
    """Build and write a package archive for each row (project, version, says:
    the version its metadata gives or NULL, damaged: cut short) in the crawl
    server's first layout; (project, version, checksum) of what was written.
    ``packed``: archives of up to ``PACKED_FILE`` bytes go into packs, one for
    each project and version."""
    def run(batches: Iterator) -> Iterator:
        import hashlib
        import io
        import zipfile

        import pyarrow as pa

        store, base = _file_system(root)
        before = None
        for batch in batches:
            paths, sums, sizes, contents = [], [], [], []
            for r in batch.to_pylist():
                info = "Metadata-Version: 1.1\nName: x\n" + (f"Version: {r['says']}\n" if r["says"] is not None else "")
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
                    for name, text in ((PKG_INFO, info), ("spiders/__init__.py", ""), ("EGG-INFO/not-zip-safe", "\n")):
                        archive.writestr(zipfile.ZipInfo(name), text)
                data = out.getvalue()[:40] if r["damaged"] else out.getvalue()
                path = f"eggs/{r['project']}/{r['version']}.egg"
                pack = packed and len(data) <= PACKED_FILE
                if not pack:
                    store.create_dir(f"{base}/eggs/{r['project']}", recursive=True)
                    with store.open_output_stream(f"{base}/{path}") as f:
                        f.write(data)
                paths.append(path)
                sums.append(hashlib.sha1(data).hexdigest())
                sizes.append(len(data))
                contents.append(data if pack and path != before else None)  # a path has one file
                before = path
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.string()), pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(contents, pa.binary())],
                                             names=["project", "version", "checksum", "path", "length", "content"])

    rows = packages.select("project", "version", "says", "damaged")
    if packed:  # rows of one path side by side
        at = F.concat_ws("/", F.coalesce("project", F.lit("None")), F.coalesce("version", F.lit("None")))
        rows = rows.repartition(at).sortWithinPartitions(at)
    written = rows.mapInArrow(run, "project string, version string, checksum string, path string, length long, content binary")
    if packed:
        path = _write_packs(written, root, "packages")
    else:
        path = root.rstrip("/") + "/_manifest-packages"
        written.select("project", "version", "checksum").write.mode("overwrite").parquet(path)
    return packages.sparkSession.read.parquet(path).select("project", "version", "checksum")


def _file_system(root: str):
    """(Arrow file system, path in it) of a path or URI."""
    import re

    from pyarrow import fs

    if re.match(r"^file:/+", root):
        root = re.sub(r"^file:/+", "/", root)
    if "://" in root:
        store, base = fs.FileSystem.from_uri(root)
        return store, base.rstrip("/")
    return fs.LocalFileSystem(), root.rstrip("/")
