"""Read captures: folders with data files, an index and a session record.

Three layouts are read alike; ``path`` may be one capture or a folder of captures, on any
file system Spark can read:

- flat: ``<capture>/{*.jsonl, *.jsonl.zst, index.jsonl, metadata.json}``
- one written capture: ``<capture>/data/seg=<file>/*``, ``<capture>/{index,metadata}/*``
- many written together: ``<root>/capture=<name>/seg=<file>/*``, ``<root>/{index,metadata}/capture=<name>/*``

A written data file lies in a folder of its own, whose name is the file's name in the index. For Spark these
folders are partitions, so which files a join leaves over is settled in the plan (dynamic pruning).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from emberlog.operators.capture_index import build_index
from emberlog.operators.decoding import decode
from emberlog.operators.filters import file_may_match, tail_n
from emberlog.schema import ENTRY_WIRE, INDEX, METADATA

# Files of a capture folder that hold no entries.
NOT_DATA = ("index.jsonl", "metadata.json", "audit.jsonl", "manifest.sha256")
DATA_GLOB = "*.{jsonl,jsonl.zst,jsonl.gz,json,json.gz,txt,txt.gz}"

# Paths spell unusual characters as %XX: once in a URI, and once more in partition folders. A plus
# sign stands for itself in both.

def _unescaped(text: Column) -> Column:
    return F.when(text.contains("%"), F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))).otherwise(text)


def _plain(path: Column) -> Column:
    """The path without the folder that a written data file has for itself."""
    last = F.substring_index(path, "/", -2)
    above = F.substring(path, F.lit(1), F.length(path) - F.length(last))
    return F.when(last.startswith("seg="), F.concat(above, F.substring_index(path, "/", -1))).otherwise(path)


def _file(path: Column) -> Column:
    """The name under which an index knows the file."""
    last = F.substring_index(path, "/", -2)
    own = F.substring_index(F.substring(last, F.lit(len("seg=") + 1), F.length(last)), "/", 1)
    return F.when(last.startswith("seg="), own).otherwise(F.substring_index(path, "/", -1))


def _path() -> Column:
    return _plain(_unescaped(F.col("_metadata.file_path")))


def _name() -> Column:
    return _file(_unescaped(F.col("_metadata.file_path")))


_PARTS = ("data", "index", "metadata")


# These run for every line, so they cut the path at its slashes instead of matching a regex.

def _folder(path: Column, up: int) -> Column:
    """Name of the folder ``up`` levels above the file."""
    return F.substring_index(F.substring_index(path, "/", -1 - up), "/", 1)


def _capture(path: Column) -> Column:
    """The folder above the file, or above its data/index/metadata folder."""
    name = F.when(_folder(path, 1).isin(*_PARTS), _folder(path, 2)).otherwise(_folder(path, 1))
    return F.when(name.startswith("capture="), _unescaped(F.substring(name, F.lit(len("capture=") + 1), F.length(name)))).otherwise(name)


def _below(path: Column, folder: str) -> Column:
    return (_folder(path, 1) == folder) | ((_folder(path, 2) == folder) & _folder(path, 1).startswith("capture="))


def _is_data(path: Column, name: Column) -> Column:
    # Text files count only where the writer puts them.
    stray = (name.endswith(".txt") | name.endswith(".txt.gz")) & (_folder(path, 1) != "data")
    return ~name.isin(*NOT_DATA) & ~stray & ~_below(path, "index") & ~_below(path, "metadata")


#: Paths, as URIs, of which one match says what ``_is_data`` would cut from them; the others go the long way.
_PLAINLY_DATA = (r"^[^%]*(?<!/index)(?<!/metadata)/(?!(?:index|metadata)/|seg=)[^/%]+/"
                 r"(?:seg=s[0-9-]+-[0-9a-f]+/[^/%]+|(?!(?:index|audit)\.jsonl\z)[^/%]*\.jsonl(?:\.zst|\.gz)?)\z")


def is_data_file() -> Column:
    """Whether a row of a file reader comes from a file with entries. Asked once a file in the listing, and then of every line."""
    return F.col("_metadata.file_path").rlike(_PLAINLY_DATA) | _is_data(_path(), _name())


def _is_index(path: Column, name: Column) -> Column:
    return (name == "index.jsonl") | (_below(path, "index") & name.endswith(".json"))


def _is_metadata(path: Column, name: Column) -> Column:
    return (name == "metadata.json") | (_below(path, "metadata") & name.endswith(".json"))


def _capture_dir(path: Column) -> Column:
    """The capture's folder; used for one row per file only."""
    parts = "|".join(_PARTS)
    together = F.regexp_replace(path, rf"/(?:{parts})/(capture=[^/]+)/[^/]+$", "/$1/")
    return F.regexp_replace(together, rf"(?:/(?:{parts}))?/[^/]*$", "")


def _files(spark: SparkSession, glob: str):
    # A receiver may rotate a file away between listing and reading; only here is that no error.
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("ignoreMissingFiles", True)


def read_lines(spark: SparkSession, path: str | list[str], only: Column | None = None) -> DataFrame:
    """Stored lines, without blank ones, with their place: value, capture, file, block (offset of the file split).

    The conditions on file names are answered from the listing, so other files are not opened."""
    lines = _files(spark, DATA_GLOB).text(path)
    if only is not None:
        lines = lines.where(only)
    return lines.where(is_data_file() & (F.col("value") != "")).select(
        "value", _capture(_path()).alias("capture"), _name().alias("file"),
        F.col("_metadata.file_block_start").alias("block"))


def _found(spark: SparkSession, glob: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    return bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path))


def _layout(spark: SparkSession, path: str | list[str]) -> tuple[str, str] | None:
    """Of a path with written data files: the folder whose folders Spark reads as partitions, and where those
    of the data files lie (a glob). None if there are none right below, or it cannot be told."""
    if not isinstance(path, str) or getattr(spark, "_jvm", None) is None:
        return None
    root = path.rstrip("/")
    if _found(spark, f"{root}/capture=*/seg=*"):
        return root, f"{root}/capture=*"
    base = next((b for b in (f"{root}/data", root) if _found(spark, f"{b}/seg=*")), None)
    return base and (base, base)


def _not_starting(prefix: str) -> str:
    """A glob of the visible names that do not start with ``prefix``."""
    shorter = [name for n in range(1, len(prefix)) for name in (prefix[:n], f"{prefix[:n]}[^{prefix[n]}]*")]
    return "{" + ",".join([f"[^{prefix[0]}._]*", *shorter]) + "}"


def _beside_segments(spark: SparkSession, path: str | list[str]) -> list[str] | None:
    """What else there is beside the folders of written data files, as paths to read: those folders, of which there
    is one a file, are then not listed. None if ``path`` has no such folders."""
    layout = _layout(spark, path)
    if layout is None:
        return None
    root, (base, data) = path.rstrip("/"), layout
    beside = [f"{data}/{_not_starting('seg=')}"]
    if data != base:
        beside.append(f"{root}/{_not_starting('capture=')}")
    elif base != root:
        beside += [f"{root}/{_not_starting('data')}", f"{root}/data?*"]
    return [glob for glob in beside if _found(spark, glob)]


def _segments(spark: SparkSession, path: str | list[str]) -> DataFrame | None:
    """Lines of written captures with their folders as partition columns; none if there are other data files too."""
    layout = _layout(spark, path)
    if layout is None:
        return None
    beside = _beside_segments(spark, path)
    if beside and not list_files(spark, beside).isEmpty():
        return None
    base, glob = layout
    capture = F.col("capture") if base != glob else _capture(F.lit(f"{base}/_"))
    schema = "value string, capture string, seg string" if base != glob else "value string, seg string"
    lines = (spark.read.schema(schema).option("basePath", base).option("pathGlobFilter", DATA_GLOB).option("ignoreMissingFiles", True).text(glob))
    return lines.where("value <> ''").select("value", capture.alias("capture"), F.col("seg").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def read_lines_of(spark: SparkSession, path: str, files: DataFrame, inverse: bool = False) -> DataFrame:
    """Lines of the ``files`` (capture, file), or of all others; no other file is opened.

    For written captures that is a join in the plan: dynamic pruning drops the folders of the other
    files before they are opened, and no name passes through this program. It is broadcast, as
    the listing that Spark plans the scan from is larger. In the flat layout, where files share folders, the names become a condition
    on the reader's file path, which is answered from that listing."""
    wanted = files.select("capture", "file").distinct()
    lines = _segments(spark, path)
    if lines is not None:
        if inverse:
            wanted = list_files(spark, path).select("capture", "file").join(wanted, ["capture", "file"], "left_anti")
        # The condition holds for all files; it tells Spark that this side selects.
        return lines.join(F.broadcast(wanted.where("file > ''")), ["capture", "file"], "left_semi").select("value", "capture", "file", "block")
    names = [f"{r.capture}/{r.file}" for r in wanted.toLocalIterator()]
    if not names:
        return read_lines(spark, path, None if inverse else F.lit(False))
    listed = F.concat_ws("/", _capture(_path()), _name()).isin(names)
    return read_lines(spark, path, ~listed if inverse else listed)


def parse_entries(lines: DataFrame) -> DataFrame:
    """Decode the ``value`` column; blank and malformed lines are left out, unknown fields
    ignored. An entry without a time keeps a null time and still counts."""
    rest = [c for c in lines.columns if c != "value"]
    return (decode(lines.where(F.col("value") != ""), "value", ENTRY_WIRE)
            .withColumn("_ts", F.col("ts").try_cast("timestamp"))
            .where("ts is null or _ts is not null")
            .select(F.col("_ts").alias("ts"), "labels", F.coalesce("msg", F.lit("")).alias("msg"),
                    F.octet_length("value").alias("raw_bytes"), *rest))


def parse_all_lines(lines: DataFrame) -> DataFrame:
    """Every stored line as it is (``value``), with time and labels; ``bad`` marks lines without
    a readable entry and time."""
    rest = [c for c in lines.columns if c != "value"]
    ts = F.col("ts").try_cast("timestamp")
    return (decode(lines.where(F.col("value") != ""), "value", ENTRY_WIRE, keep_bad=True)
            .select("value", ts.alias("ts"), "labels", (F.col("_corrupt").isNotNull() | ts.isNull()).alias("bad"), *rest))


def number_lines(entries: DataFrame) -> DataFrame:
    """``line_no`` of each entry in its file.

    Entries are numbered within their file split, whose size Spark bounds, and moved up by
    the number of entries in the splits before it. A large file is never one task's work."""
    keys = ["capture", "file"]
    marked = entries.withColumn("_at", F.monotonically_increasing_id())
    sizes = entries.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    starts = starts.persist()  # one short row per file split, used whenever the entries are
    inside = Window.partitionBy(*keys, "block").orderBy("_at")
    return (marked.join(starts, [*keys, "block"])
            .withColumn("line_no", F.col("_start") + F.row_number().over(inside))
            .drop("_at", "_start"))


def read_capture(spark: SparkSession, path: str | list[str], line_numbers: bool = False) -> DataFrame:
    """Entries: ts, labels, msg, raw_bytes, capture, file, block[, line_no]."""
    entries = parse_entries(read_lines(spark, path))
    return number_lines(entries) if line_numbers else entries


def read_capture_pruned(spark: SparkSession, path: str, index: DataFrame, frm=None, to=None, labels=None) -> DataFrame:
    """Read only files that the index cannot rule out; files it does not know are read."""
    out = index.where(~F.coalesce(file_may_match(frm, to, labels), F.lit(True)))
    return parse_entries(read_lines_of(spark, path, out, inverse=True))


def tail_capture(spark: SparkSession, path: str, n: int, grep: str | None = None, label: tuple[str, str] | None = None) -> DataFrame:
    """The last ``n`` entries of a capture's newest file, then filtered. The file is found in the listing;
    no other is opened."""
    newest = list_files(spark, path).orderBy(F.desc("file"), "capture").limit(1)
    return tail_n(number_lines(parse_entries(read_lines_of(spark, path, newest))), n, grep, label)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of all captures below ``path``; bad lines are skipped, no index gives no rows."""
    rows = _files(spark, "*.{jsonl,json}").text(_beside_segments(spark, path) or path)
    rows = rows.where(_is_index(_path(), _name()) & (F.trim("value") != "")).select(
        "value", _capture(_path()).alias("capture"))
    schema = T.StructType([*INDEX.fields, T.StructField("_corrupt", T.StringType())])
    return decode(rows, "value", schema).where("file is not null").select("capture", *INDEX.fieldNames())


def full_index(spark: SparkSession, path: str, index: DataFrame | None = None) -> DataFrame:
    """The stored index, and rows computed for the data files it does not know. All lines of
    those count, readable or not; the other files are not opened."""
    index = read_index(spark, path) if index is None else index
    known = index.select("capture", "file")
    orphans = list_files(spark, path).select("capture", "file").join(known, ["capture", "file"], "left_anti")
    computed = build_index(parse_all_lines(read_lines_of(spark, path, orphans)), F.octet_length("value"), ["capture", "file"])
    return index.unionByName(computed)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Session records of all captures below ``path``, with ``capture`` and ``dir``."""
    docs = (_files(spark, "*.json").schema(METADATA).option("multiLine", True)
            .option("mode", "DROPMALFORMED").json(_beside_segments(spark, path) or path))
    return docs.where(_is_metadata(_path(), _name())).select(
        _capture(_path()).alias("capture"), _capture_dir(_path()).alias("dir"),
        *METADATA.fieldNames())


def list_files(spark: SparkSession, path: str | list[str], data_only: bool = True) -> DataFrame:
    """capture, dir, file, bytes of each file, and whether it has a folder of its own; the contents are not read."""
    files = _files(spark, DATA_GLOB if data_only else "*").format("binaryFile").load(path)
    plain, name = _plain(F.col("path")), _file(F.col("path"))
    if data_only:
        files = files.where(_is_data(plain, name))
    return files.select(_capture(plain).alias("capture"), _capture_dir(plain).alias("dir"), name.alias("file"), F.col("length").alias("bytes"),
                        (plain != F.col("path")).alias("own_folder"))


def read_file_contents(spark: SparkSession, path: str) -> DataFrame:
    """capture, file, content of every file but the manifest, for digests. Data files are
    bounded in size when written, which keeps one file within one task's memory."""
    files = _files(spark, "*").format("binaryFile").load(path)
    name = _file(F.col("path"))
    return files.where(name != "manifest.sha256").select(
        _capture(_plain(F.col("path"))).alias("capture"), name.alias("file"), "content")


def catalog(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """All captures below ``root``, newest first; not recursive: root itself and its direct folders."""
    def local(dir_: Column) -> Column:  # listings and readers spell the file: scheme differently
        return F.regexp_replace(dir_, "^file:/+", "/")

    disk = list_files(spark, root).groupBy(local(F.col("dir")).alias("dir")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    metadata = read_metadata(spark, root).withColumn("dir", local(F.col("dir")))
    if not recursive:
        below = F.substring_index("dir", re.sub("^file:/+", "/", root.rstrip("/")), -1)
        metadata = metadata.where(below.rlike(r"^(?:/[^/]+)?$"))
    zero = F.lit(0).cast("bigint")
    return (metadata.join(disk, "dir", "left")
            .select("capture", "started", "stopped", F.coalesce("files", zero).alias("files"),
                    F.col("total_lines").alias("entries"), F.coalesce("bytes", zero).alias("bytes"),
                    (F.col("stopped").isNull() | (F.year("stopped") <= 1)).alias("active"),
                    F.array_join("labels_seen", ";").alias("labels"))
            .orderBy(F.desc("started")))


def new_files(seen: DataFrame, files: DataFrame) -> DataFrame:
    """Files that were not there at the last look."""
    return files.join(seen, ["capture", "file"], "left_anti")

