"""Files of a corpus: Parquet footers and file order, text, CSV and JSON records, benchmark items, parallel corpora, lanes."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import strip

SURVEY = "corpus string, path string, size long, reachable boolean, row_groups int, n_rows long, columns array<string>, actual_size long, size_matches boolean"


def footer(spark: SparkSession, path: str) -> tuple[int, int, list[str], int]:
    """(row groups, rows, columns, bytes) of one Parquet file, from its footer alone, on any file system of the session."""
    jvm = spark._jvm
    file = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(file)
    try:
        meta = reader.getFooter()
        return meta.getBlocks().size(), reader.getRecordCount(), [f.getName() for f in meta.getFileMetaData().getSchema().getFields()], file.getLength()
    finally:
        reader.close()


def parquet_files(spark: SparkSession, path: str) -> list[str]:
    """The files of a table that is a folder, at any depth, by path; those that Spark hides (_ and .) are left out. A file is
    its own only one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.getFileStatus(at)
    if top.isFile():
        return [path]
    root, found, listed = top.getPath().toUri().getPath().rstrip("/"), [], fs.listFiles(at, True)
    while listed.hasNext():
        file = listed.next().getPath()
        inside = file.toUri().getPath()[len(root) + 1 :].split("/")
        if not any(x.startswith(".") or x.startswith("_") and "=" not in x for x in inside):
            found.append(file.toString())
    return sorted(found)


def table_footers(spark: SparkSession, path: str) -> tuple[int, int, list[str], int] | None:
    """footer() of a file, or of all files of a folder: sums, and the columns of all as they first come; None without a file."""
    with ThreadPoolExecutor(8) as some:  # each read waits for the store
        each = list(some.map(lambda p: footer(spark, p), parquet_files(spark, path)))
    if not each:
        return None
    groups, rows, names, sizes = zip(*each)
    return sum(groups), sum(rows), list(dict.fromkeys(c for n in names for c in n)), sum(sizes)


def survey(planned: DataFrame) -> DataFrame:
    """planned(corpus, path, size), a short list of files, or of folders of files -> with what the footers say, whether it can be
    reached, and whether its size is the one recorded; another size means other data under the same name. A folder without
    Parquet files, or with one that can't be read, can't be reached."""
    rows = []
    for r in planned.select("corpus", "path", "size").collect():
        try:
            found = table_footers(planned.sparkSession, r["path"])
        except Py4JJavaError:
            found = None
        groups, n, names, size = found or (None,) * 4
        rows.append((r["corpus"], r["path"], r["size"], found is not None, groups, n, names, size, r["size"] == size if found else None))
    return planned.sparkSession.createDataFrame(rows, SURVEY)


def in_file_order(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """The wanted columns that the files have (all when they have none), with file and row, a row's place in its file: what
    to order by, since rows are read in parallel."""
    rows = spark.read.parquet(path)
    some = [c for c in columns if c in rows.columns] or rows.columns
    return rows.select(*some, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def in_order(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """in_file_order() with place, a row's place over all files, which come in order of their paths' bytes. Files are counted
    without reading a column; a row for each file comes to the driver."""
    counted = spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n")).collect()
    before, at = [], 0
    for r in sorted(counted, key=lambda r: unquote(r["file"]).encode()):  # the path is an URI: %20 for a space
        before.append((r["file"], at))
        at += r["n"]
    starts = spark.createDataFrame(before, "file string, __before long")
    return in_file_order(spark, path, columns).join(F.broadcast(starts), "file").withColumn("place", F.col("__before") + F.col("row")).drop("__before")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, text): each file whole; name is the file's without its ending. A file is one row, so it must fit a task."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(name.alias("name"), F.col("value").alias("text"))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of CSV with a header, fields over several lines, and perhaps a byte order mark; all columns are strings."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return rows.toDF(*[c.lstrip("﻿") for c in rows.columns])


def json_records(spark: SparkSession, path: str, address: str = "", schema: str | None = None) -> DataFrame:
    """Records of JSON files that hold an array, or an object with arrays: address names the array, as in `market.deals`.
    Malformed JSON fails the read."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    rows = (reader.schema(schema) if schema else reader).json(path)
    return rows.select(F.explode(address).alias("r")).select("r.*") if address else rows


def item_texts(document: Column) -> Column:
    """Array of the items of a benchmark file's JSON: a list, or an object with a list `items`, of strings or of objects with
    a question or a text; blank ones are left out."""
    listed = F.coalesce(F.from_json(document, "array<string>"), F.from_json(document, "struct<items:array<string>>")["items"])
    one = lambda s: F.coalesce(F.get_json_object(s, "$.question"), F.get_json_object(s, "$.text"), s)
    return F.filter(F.transform(listed, lambda s: strip(F.when(s.startswith("{"), one(s)).otherwise(s))), lambda t: t != "")


QUESTION_COLUMNS = ("question", "query", "text")


def question_items(rows: DataFrame, options: Sequence[str] = (), least_words: int = 6, candidates: Sequence[str] = QUESTION_COLUMNS) -> DataFrame:
    """(text): distinct items in order, a row's question and its non-blank options as a leaked text would hold them; items of
    fewer than least_words are left out. Without a question column there is nothing to read, which raises."""
    lowered = {c.lower(): c for c in rows.columns}
    question = next((lowered[c] for c in candidates if c in lowered), None)
    if question is None:
        raise ValueError(f"no question column among {rows.columns}")
    given = [F.nullif(strip(F.col(c).cast("string")), F.lit("")) for c in (question, *options)]
    text = rows.where(given[0].isNotNull()).select(F.concat_ws(" ", *given).alias("text"))
    return text.where(F.size(F.array_remove(F.split("text", r"\s+"), "")) >= least_words).distinct().orderBy("text")


def parallel_texts(rows: DataFrame, columns: dict[str, str], order: str) -> DataFrame:
    """rows with a column for each language, columns {column: lang} -> (lang, text): the lines of each in order; languages
    without a column are left out. A language's lines are gathered: evaluation sets of some thousand lines."""
    some = [(c, lang) for c, lang in columns.items() if c in rows.columns]
    long = rows.select(order, F.explode(F.array(*[F.struct(F.lit(lang).alias("lang"), F.col(c).alias("line")) for c, lang in some])).alias("x")).select(order, "x.*")
    lines = long.where("line != ''").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct(order, "line"))).alias("l"))
    return lines.select("lang", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def lane_texts(files: DataFrame) -> DataFrame:
    """files(lane, path, content binary) -> (lane, n_files, skipped, text): a lane's files in order of their paths, joined by
    blank lines; those that aren't UTF-8 are skipped and counted."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    parts = F.array_sort(F.collect_list(F.when(valid, F.struct("path", F.col("content").cast("string").alias("text")))))
    lanes = files.groupBy("lane").agg(F.count_if(valid).alias("n_files"), F.count_if(~valid).alias("skipped"), parts.alias("p"))
    return lanes.select("lane", "n_files", "skipped", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"))
