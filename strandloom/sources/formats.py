"""Readers and writers of sequence and annotation formats."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions.sequences import clean

# Columns of the tab-separated formats.
BED = "chrom string, start long, end long, name string, score string, strand string"
GFF = "seqid string, source string, type string, start long, end long, score string, strand string, phase string, attributes string"
VCF = "chrom string, pos long, id string, ref string, alt string, qual string, filter string, info string"
SAM = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string"


def parse_records(text: str) -> Iterator[tuple[str, str, str | None]]:
    """(name, sequence, quality) of FASTA or FASTQ text, told apart record by record by its first character; wrapped lines are joined."""
    lines = text.splitlines()
    i, n = 0, len(lines)
    while i < n:
        line = lines[i].strip()
        i += 1
        if line.startswith(">"):
            parts = []
            while i < n and not lines[i].startswith((">", "@")):
                parts.append(lines[i].strip())
                i += 1
            yield line[1:], "".join(parts), None
        elif line.startswith("@"):
            parts, quality = [], []
            while i < n and not lines[i].startswith("+"):
                parts.append(lines[i].strip())
                i += 1
            i += 1
            sequence = "".join(parts)
            while i < n and sum(map(len, quality)) < len(sequence):
                quality.append(lines[i].strip())
                i += 1
            yield line[1:], sequence, "".join(quality)


def read_whole_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source_file, name, seq, quality of FASTA/FASTQ files, plain or gzipped, one task a file; for gzip, which can't be split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                rows = [(path, *r) for r in parse_records(data.decode("utf-8", "replace"))]
                for k in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows[k : k + 1000], strict=True)], ["source_file", "name", "seq", "quality"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInArrow(run, "source_file string, name string, seq string, quality string").withColumn("seq", clean(F.col("seq")))


def read_fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source_file, name, seq of FASTA, split between records by the reader itself, so a large plain file is read by many tasks. A `>` inside a line is part of that line."""
    return fasta_records(spark.read.option("lineSep", "\n>").text(paths))


def fasta_records(rows: DataFrame) -> DataFrame:
    """source_file, name, seq of text cut at each `>` that begins a line; on a table and on a stream."""
    each = rows.select(F.col("_metadata.file_path").alias("source_file"), F.regexp_replace("value", "^>", "").alias("value")).where(F.trim("value") != "")
    name = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    return each.select("source_file", name.alias("name"), clean(F.regexp_replace(F.substr("value", F.length(name) + 1), r"\s", "")).alias("seq"))


def read_fastq(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source_file, name, seq, quality of four-line FASTQ, plain files in splits, gzipped ones streamed.

    A first pass counts the lines of each split, so the second knows which line of a record each is. Records that lie in one split are whole at once; only
    the few lines beside the splits' borders are shuffled to meet.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    first: dict[tuple[str, int], int] = {}
    upto: dict[str, int] = {}
    for file, start, n in lines.groupBy("file", "start").count().orderBy("file", "start").collect():  # a row a split
        first[file, start] = upto.get(file, 0)
        upto[file] = first[file, start] + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, held = None, 0, []

        def rows(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int32(), pa.list_(pa.string())))], ["file", "record", "line", "lines"])

        for batch in batches:
            done = []
            for file, start, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, start) != now:
                    if held:
                        done.append((now[0], number // 4, number % 4 - len(held), held))
                    now, number, held = (file, start), first[file, start], []
                held.append(value)
                number += 1
                if number % 4 == 0:
                    done.append((file, number // 4 - 1, 4 - len(held), held))
                    held = []
            if done:
                yield rows(done)
        if held:
            yield rows([(now[0], number // 4, number % 4 - len(held), held)])

    parts = lines.mapInArrow(run, "file string, record long, line int, lines array<string>")
    whole = parts.where(F.size("lines") == 4)
    broken = parts.where(F.size("lines") < 4).groupBy("file", "record").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("line", "lines"))), lambda p: p["lines"])).alias("lines"))
    each = whole.select("file", "lines").unionByName(broken.select("file", "lines")).where("size(lines) >= 2 and lines[0] like '@%'")
    return each.select(F.col("file").alias("source_file"), F.substr(F.trim(F.col("lines")[0]), F.lit(2)).alias("name"), clean(F.trim(F.col("lines")[1])).alias("seq"), F.trim(F.get("lines", F.lit(3))).alias("quality"))


def is_fastq(path: str) -> bool:
    return path.removesuffix(".gz").endswith((".fq", ".fastq"))


def read_sequences(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source_file, name, seq of FASTA and FASTQ files, told apart by their names."""
    fastq, fasta = [p for p in paths if is_fastq(p)], [p for p in paths if not is_fastq(p)]
    parts = [read_fastq(spark, fastq).drop("quality")] if fastq else []
    parts += [read_fasta(spark, fasta)] if fasta else []
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def missing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Paths (or patterns) that match nothing."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def found(path: str) -> bool:
        at = jvm.org.apache.hadoop.fs.Path(path)
        status = at.getFileSystem(conf).globStatus(at)
        return status is not None and len(status) > 0

    return [p for p in paths if not found(p)]


def genomes_of(records: DataFrame) -> DataFrame:
    """gid (1 on, in order of file and name), name cut at the first space, seq, len. Only names are numbered in one place, sequences are joined to their numbers."""
    named = records.select("source_file", F.substring_index("name", " ", 1).alias("name"), "seq")
    numbers = named.select("source_file", "name").distinct().withColumn("gid", F.row_number().over(Window.orderBy("source_file", "name")))
    return named.join(numbers, ["source_file", "name"]).select("gid", "name", "seq", F.length("seq").alias("len"))


def reads_of(records: DataFrame) -> DataFrame:
    """read_id (a hash of file, name and sequence, the same in every evaluation; equal reads of one file and name are one), source_file, name (whole), seq; quality is dropped."""
    return records.select(F.xxhash64("source_file", "name", "seq").alias("read_id"), "source_file", "name", "seq")


def read_tabular(spark: SparkSession, paths: list[str], schema: str, comment: str = "#") -> DataFrame:
    """Tab-separated annotation with an explicit schema (BED, GFF, VCF, SAM); short rows get nulls, more columns are dropped."""
    return spark.read.schema(schema).option("sep", "\t").option("comment", comment).option("quote", "").option("mode", "PERMISSIVE").csv(paths)


def sam_cigar(text: Column) -> Column:
    """array<struct<op, n>> of a CIGAR string."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.substr(p, F.length(p), F.lit(1)).alias("op"), F.regexp_extract(p, r"^(\d+)", 1).cast("long").alias("n")))


def gff_attributes(text: Column) -> Column:
    return F.str_to_map(text, F.lit(";"), F.lit("="))


def genomic_region(text: Column) -> list[Column]:
    """chrom, start (0-based), end of `chr:beg-end`; thousands separators are allowed, missing ends are null."""
    part = lambda k: F.regexp_replace(F.regexp_extract(text, r"^([^:]+)(?::([\d,]+)(?:-([\d,]+))?)?$", k), ",", "")
    number = lambda k: F.when(part(k) != "", part(k).cast("long"))
    return [part(1).alias("chrom"), (number(2) - 1).alias("start"), number(3).alias("end")]


def file_prefix(path: Column) -> Column:
    """File name without folders and without what follows its first dot."""
    return F.substring_index(F.element_at(F.split(path, "/"), -1), ".", 1)


def fasta_text(seqs: DataFrame, width: int = 80) -> DataFrame:
    return seqs.select(F.concat(F.lit(">"), "name", F.lit("\n"), F.regexp_replace("seq", f"(.{{1,{width}}})", "$1\n")).alias("value"))


def write_lines(rows: DataFrame, path: str, order: list[str], header: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Sorted text parts in one folder; a header is a part of its own that sorts first."""
    body = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).select("value")
    if header:
        rows.sparkSession.createDataFrame([(h,) for h in header], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    body.write.mode(mode).text(f"{path}/records")


def gvf_text(variants: DataFrame) -> DataFrame:
    """Nine tab-separated columns of clip records; missing ends are dots."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return variants.select(F.concat_ws("\t", "genome", F.lit("strandloom"), "type", dot("start"), dot("end"), F.lit("."), F.lit("."), F.lit("."), dot("attrs")).alias("value"))
