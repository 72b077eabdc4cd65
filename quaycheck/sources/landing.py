"""Landed objects: the inventory of what is there, payload bytes, lines of files of any size."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaycheck.operators.identity import basename, object_key

INVENTORY = "path string, length bigint, modified_at timestamp"


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Names and sizes of everything under a folder, markers and empty files included.

    Spark's file sources hide files that start with _ or ., and `binaryFile` hides empty ones, so
    the names come from the file system. The driver lists the first level; each sub-folder is walked
    by a task. Where the object store writes an inventory report, use `from_table`.
    """
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    top = [(s.getPath().toString(), s.isDirectory(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(root)]
    schema = "path string, is_folder boolean, length bigint, modified_ms bigint"
    first = spark.createDataFrame(top, schema)
    folders = first.where("is_folder").select("path").repartition(max(1, spark.sparkContext.defaultParallelism))
    deeper = folders.mapInPandas(_walk, "path string, length bigint, modified_ms bigint")
    files = first.where("not is_folder").select("path", "length", "modified_ms").unionByName(deeper)
    return describe(files.select("path", "length", F.timestamp_millis("modified_ms").alias("modified_at")))


def _arrow_uri(path: str) -> str:
    """A path as the Arrow file systems name it, with percent signs."""
    from urllib.parse import quote

    scheme, rest = path.split(":", 1)
    return f"{'s3' if scheme == 's3a' else scheme}:{'//' if scheme == 'file' and not rest.startswith('//') else ''}{quote(rest)}"


def _walk(batches):
    import pandas as pd
    from pyarrow import fs as arrow_fs

    for batch in batches:
        for path in batch["path"]:
            store, base = arrow_fs.FileSystem.from_uri(_arrow_uri(path))
            scheme = path.split("://", 1)[0]
            found = [f for f in store.get_file_info(arrow_fs.FileSelector(base, recursive=True)) if f.is_file]
            names = [f"{scheme}:{f.path}" if scheme == "file" else f"{scheme}://{f.path}" for f in found]
            yield pd.DataFrame({"path": names, "length": [f.size for f in found],
                                "modified_ms": [f.mtime_ns // 1_000_000 for f in found]})


def from_table(inventory: DataFrame, path: str, length: str, modified: str) -> DataFrame:
    """Inventory out of an object store's inventory report."""
    return describe(inventory.select(F.col(path).alias("path"), F.col(length).alias("length"), F.col(modified).alias("modified_at")))


def describe(files: DataFrame) -> DataFrame:
    return files.select("path", basename(F.col("path")).alias("basename"), object_key(F.col("path")).alias("object_key"),
                        "length", "modified_at")


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Whole payloads, one row per file (up to 2 GB each). Larger files: `read_lines`."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return raw.select("path", basename(F.col("path")).alias("basename"), "length", F.col("modificationTime").alias("modified_at"), "content")


def inline_payloads(requests: DataFrame, base64: str, text: str) -> DataFrame:
    """Payloads sent along with a request, encoded or as plain text."""
    sent = F.coalesce(F.unbase64(F.col(base64)), F.encode(F.col(text), "UTF-8"), F.lit(b""))
    return requests.withColumn("content", sent)


#: Stretches in which a file's lines are joined with facts about the file: what one task gets of a huge file.
STRETCH = 64 << 20
#: Codecs whose first wrong byte is looked for; latin-1 has none.
CODECS = ("utf8", "ascii", "cp1252")
FACTS = ["length", "checksum", "has_bom", "first_line", *[f"bad_{c}{p}" for c in CODECS for p in ("", "_byte")]]


def payload_facts(files: DataFrame, uri: str = "uri", chunk: int = 4 << 20) -> DataFrame:
    """`files` with what a stream over each payload finds, in bounded memory whatever its size: length, SHA-256, byte-order
    mark, first line that is not blank (null if it is not UTF-8), and the first wrong byte and its offset by codec.

    A digest is sequential, so a file is one task's work; files are dealt over tasks. A file that is not there has nulls.
    """
    found = f"`{uri}` string, length bigint, checksum string, has_bom boolean, first_line string, " + ", ".join(f"bad_{c} bigint, bad_{c}_byte string" for c in CODECS)

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = [(path, *_streamed(path, chunk)) for path in batch[uri]]
            yield pd.DataFrame(rows, columns=[uri, *FACTS]).astype({n: "Int64" for n in ("length", *[f"bad_{c}" for c in CODECS])})

    tasks = max(1, files.sparkSession.sparkContext.defaultParallelism)
    facts = files.select(uri).where(F.col(uri).isNotNull()).distinct().repartition(4 * tasks, uri).mapInPandas(run, found)
    return files.join(facts, uri, "left")


def _streamed(path: str, chunk: int) -> tuple:
    import codecs
    import hashlib
    import re

    from pyarrow import fs as arrow_fs

    store, base = arrow_fs.FileSystem.from_uri(_arrow_uri(path))
    if store.get_file_info([base])[0].type != arrow_fs.FileType.File:
        return (None,) * len(FACTS)
    wrong = {"ascii": re.compile(rb"[\x80-\xff]"), "cp1252": re.compile(rb"[\x81\x8d\x8f\x90\x9d]")}
    bad: dict[str, tuple] = {}
    digest, size, head, utf8 = hashlib.sha256(), 0, b"", codecs.getincrementaldecoder("utf-8")()
    line, first, done = b"", None, False
    with store.open_input_stream(base) as stream:
        while True:
            data = stream.read(chunk)
            digest.update(data)
            head = (head + data)[:3] if len(head) < 3 else head
            if "utf8" not in bad:
                held = utf8.getstate()[0]
                try:
                    utf8.decode(data, final=not data)
                except UnicodeDecodeError as e:
                    bad["utf8"] = size - len(held) + e.start, (held + data)[e.start : e.start + 1].hex()
            for name, pattern in wrong.items():
                if name not in bad and (m := pattern.search(data)):
                    bad[name] = size + m.start(), m.group().hex()
            if not done:
                *whole, line = re.split(rb"\r\n|\r|\n", line + data) if data else (line, b"")
                filled = [x for x in whole if x.strip()]
                if filled or not data:
                    first, done = (filled[0] if filled else None), True
            size += len(data)
            if not data:
                break
    if first is not None and "utf8" not in bad:
        first = first.decode()
    else:
        first = None
    return size, digest.hexdigest(), head == b"\xef\xbb\xbf", first, *[x for c in CODECS for x in bad.get(c, (None, None))]


def read_splits(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Lines as bytes, with the split of the file that they were read in: (uri, split_at, seen, raw).

    Spark splits the files; `seen` grows inside a split. Lines end at any of the three terminators, and a byte-order mark
    is not part of the first one. Files whose names start with _ or . are hidden from the reader.
    """
    raw = spark.read.option("recursiveFileLookup", "true").text(paths)
    seen = F.monotonically_increasing_id()
    return raw.select(decoded_uri(F.col("_metadata.file_path")).alias("uri"), F.col("_metadata.file_block_start").alias("split_at"),
                      seen.alias("seen"), F.col("value").cast("binary").alias("raw"))


def decoded_uri(uri: Column) -> Column:
    """File paths as Spark names them, without percent signs."""
    return same_form(F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B"))))


def same_form(uri: Column) -> Column:
    """Local files with three slashes, whichever way they were named."""
    return F.regexp_replace(uri, "^file:/+", "file:///")


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered lines of text files that may be larger than one task: (path, line_no, line).

    A line's place in its split comes with the reading; what is added is the number of lines in the splits before it.
    Only one row per split is summed over a file, and the text is neither sorted nor windowed.
    """
    raw = read_splits(spark, folder)
    splits = raw.groupBy("uri", "split_at").agg(F.min("seen").alias("first_seen"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("uri").orderBy("split_at").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first_seen")
    places = splits.select("uri", "split_at", shift.alias("shift"))
    return raw.join(places, ["uri", "split_at"]).select(
        F.col("uri").alias("path"), (F.col("seen") + F.col("shift")).alias("line_no"), F.col("raw").cast("string").alias("line"))


def delimited_rows(lines: DataFrame, keep: Iterable[str], line: str, schema: str, delimiter: str) -> DataFrame:
    """Rows of delimited lines under a given schema; short lines lack the tail, bad ones give nulls."""
    parsed = F.from_csv(F.col(line), schema, {"sep": delimiter, "mode": "PERMISSIVE"})
    return lines.select(*keep, parsed.alias("row")).select(*keep, "row.*")


def read_lake(spark: SparkSession, fmt: str, path: str, schema: str | None = None) -> DataFrame:
    """Lake formats by contract name. Delta and Avro need their packages on the session."""
    name = {"Parquet": "parquet", "JSONL": "json", "Delta": "delta", "Avro": "avro"}[fmt]
    reader = spark.read.format(name)
    if schema:
        reader = reader.schema(schema)
    return reader.load(path)


def json_rows(lines: DataFrame, line: str = "line") -> DataFrame:
    """JSON lines with what does not parse kept and marked."""
    doc = F.call_function("try_parse_json", F.col(line))
    return lines.withColumn("doc", doc).withColumn("parses", F.col("doc").isNotNull())


def json_text(doc: Column, path: str) -> Column:
    return F.call_function("try_variant_get", doc, F.lit(path), F.lit("string"))
