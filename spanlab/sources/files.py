"""JSON lines, zipped text, file listings, responses, logs, digests."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """JSON lines of a fixed schema; ``tolerant`` skips broken lines, else they are an error.  Blank lines never count."""
    if not tolerant:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    df = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return df.where("_corrupt_record is null").drop("_corrupt_record")


def holds_nan(value: Column, kind: T.DataType) -> Column | None:
    """Whether a NaN is anywhere in a value, null for types that can't hold one."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.isnan(value)
    if isinstance(kind, T.ArrayType):
        return None if holds_nan(value, kind.elementType) is None else F.exists(value, lambda x: holds_nan(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return holds_nan(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        parts = [p for f in kind.fields if (p := holds_nan(value[f.name], f.dataType)) is not None]
        return F.exists(F.array(*parts), lambda x: x) if parts else None
    return None


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with sorted keys; a NaN anywhere is an error."""
    parts = [p for f in df.schema.fields if (p := holds_nan(F.col(f"`{f.name}`"), f.dataType)) is not None]
    if parts and not df.where(F.exists(F.array(*parts), lambda x: x)).isEmpty():
        raise ValueError("NaN can't be written as JSON")
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_exact(df: DataFrame, path: str, frames: str, depth: int, *by: str) -> int:
    """Writes the rows whose ``frames`` array has exactly ``depth`` elements, partitioned; returns how many were dropped.

    None left to write is an error.
    """
    exact = F.coalesce(F.size(frames) == depth, F.lit(False))
    kept, dropped = (int(n or 0) for n in df.agg(F.sum(exact.cast("int")), F.sum((~exact).cast("int"))).first())
    if not kept:
        raise ValueError(f"no row has {depth} elements in {frames}")
    df.where(exact).write.mode("overwrite").partitionBy(*by).parquet(path)
    return dropped


def read_zip_text(spark: SparkSession, path: str) -> DataFrame:
    """path, member, line_no, line of the text members of zip files; an archive is read by one task."""
    import pandas as pd

    def read(batches):
        import io
        import zipfile

        for pdf in batches:
            for p, raw in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for name in sorted(n for n in z.namelist() if not n.endswith("/")):
                        lines = z.read(name).decode("utf-8", "replace").splitlines()
                        yield pd.DataFrame({"path": p, "member": name, "line_no": range(len(lines)), "line": lines})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, member string, line_no int, line string")


def _store(path: str):
    """The file system of a path, local or remote, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace(":/", ":///", 1) if ":/" in path and "://" not in path else path)


FOLDERS = 256


def folder_of(name: str) -> str:
    """The folder, one of ``FOLDERS``, in which a named file is kept."""
    return f"{zlib.crc32(name.encode()) % FOLDERS:03d}"


def write_named(lines: DataFrame, path: str, order: str, head: str | None = None, foldered: bool = True) -> int:
    """``lines(name, value, <order>)`` as a file a name below ``path``, a line a row in order; returns how many files.

    A name's rows meet in one task, which streams them into its file, so a file may have any size and any number of
    files takes the same time each; nothing is renamed or committed afterwards.  A repeated task writes the same files again.
    What ``path`` held before goes.
    ``head`` is each file's first line.  ``foldered`` spreads the files over ``FOLDERS`` folders, for ``read_named``.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(path)
        made, now, out, folders = 0, None, None, set()
        try:
            for batch in batches:
                for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if name != now:
                        if out is not None:
                            out.close()
                        file = f"{top}/{folder_of(name)}/{name}" if foldered else f"{top}/{name}"
                        above = file.rsplit("/", 1)[0]
                        if not foldered or above not in folders:
                            store.create_dir(above, recursive=True)
                            folders.add(above)
                        out, now, made = store.open_output_stream(file), name, made + 1
                        if head is not None:
                            out.write(f"{head}\n".encode())
                    out.write(f"{value}\n".encode())
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64())], names=["n"])

    store, top = _store(path)
    store.create_dir(top, recursive=True)
    store.delete_dir_contents(top)
    tasks = 4 * lines.sparkSession.sparkContext.defaultParallelism
    dealt = lines.repartition(tasks, "name").sortWithinPartitions("name", order).select("name", "value")
    return int(dealt.mapInArrow(write, "n long").agg({"n": "sum"}).first()[0] or 0)


def read_named(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """name, length, content of the files that ``write_named`` keeps in folders; each task lists and reads some folders.

    Without ``content`` no file is opened.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = _store(path)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                found = [f for f in store.get_file_info(fs.FileSelector(f"{top}/{k:03d}", allow_not_found=True, recursive=True)) if f.type == fs.FileType.File]
                names, lengths, texts, held = [], [], [], 0
                for f in found:
                    names.append(f.path[len(top.rstrip("/")) + 5 :])
                    lengths.append(f.size)
                    texts.append(store.open_input_file(f.path).read() if content else None)
                    held += f.size if content else 0
                    if held > 16 << 20 or len(names) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(lengths, pa.int64()), pa.array(texts, pa.binary())], names=["name", "length", "content"])
                        names, lengths, texts, held = [], [], [], 0
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(lengths, pa.int64()), pa.array(texts, pa.binary())], names=["name", "length", "content"])

    tasks = min(FOLDERS, 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, FOLDERS, 1, tasks).mapInArrow(read, "name string, length long, content binary")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of whole files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def listed(spark: SparkSession, root: str, pattern: str, unique_stems: bool = False) -> DataFrame:
    """path, stem, length of the files below ``root``; the contents aren't read.  ``unique_stems``: a repeated stem is an error."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    df = df.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), "length")
    if unique_stems:
        twice = df.groupBy("stem").count().where("count > 1").limit(5).collect()
        if twice:
            raise ValueError(f"several files are called {sorted(r.stem for r in twice)}")
    return df


def response_problem(raw: Column) -> Column:
    """What is wrong with a JSON-encoded answer: missing, not JSON, not a string, empty, or null."""
    text = F.trim(raw)
    is_json = F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))
    value = F.from_json(F.concat(F.lit('{"v":'), text, F.lit("}")), "v string")["v"]
    return F.when(raw.isNull(), "missing").when(~is_json, "not JSON").when(~text.startswith('"'), "not a string").when(F.coalesce(F.trim(value), F.lit("")) == "", "empty")


def last_timings(log: DataFrame, order: str, line: str) -> DataFrame:
    """Stage to seconds from the last line that begins with ``timings``."""
    last = log.where(F.col(line).startswith("timings ")).agg(F.max_by(line, order).alias("line"))
    pairs = F.transform(F.regexp_extract_all("line", F.lit(r"(\w+=[0-9.]+)"), F.lit(1)), lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substring_index(p, "=", -1).cast("double").alias("v")))
    return last.select(F.map_from_entries(pairs).alias("stages"))
