"""BAM: records and blocks are made by the executors, and stream through the driver into one file."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: letters of operations and bases in order of their codes, and the empty block that ends a file.
OPERATIONS = "MIDNSHP=X"
BASE_CODES = "=ACMGRSVTWYHKDBN"
END_OF_FILE = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK = 60_000


def block(data: bytes) -> bytes:
    """One BGZF block: a gzip member whose extra field holds its size."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def bin_of(begin: int, end: int) -> int:
    """Smallest bin of the 5-level index scheme that holds [begin, end)."""
    end = max(end, begin + 1) - 1
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if begin >> shift == end >> shift:
            return first + (begin >> shift)
    return 0


def record(name: str, flag: int, gid: int, pos: int, mapq: int, cigar: list[tuple[str, int]], seq: str, sa: str) -> bytes:
    """One alignment; pos is 0-based, gid the genome's place in the header."""
    title = name.encode()[:254] + b"\0"
    ops = struct.pack(f"<{len(cigar)}I", *[n << 4 | OPERATIONS.index(o) for o, n in cigar])
    codes = [BASE_CODES.index(c) if c in BASE_CODES else 15 for c in seq]
    if len(codes) % 2:
        codes.append(0)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    tag = b"SAZ" + sa.encode() + b"\0" if sa else b""
    reach = sum(n for o, n in cigar if o in "MDN=X")
    body = struct.pack("<iiBBHHHiiii", gid, pos, len(title), mapq, bin_of(pos, pos + reach), len(cigar), flag, len(seq), -1, -1, 0) + title + ops + packed + b"\xff" * len(seq) + tag
    return struct.pack("<i", len(body)) + body


def header(lines: list[str], genomes: list[tuple[str, int]]) -> bytes:
    text = "".join(f"{x}\n" for x in lines).encode()
    names = b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in genomes)
    return b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(genomes)) + names


def blocks(lines: DataFrame, reads: DataFrame, order: dict[int, int]) -> DataFrame:
    """BGZF blocks of the records of (read_id, line_id, gid, flag, pos, mapq, cigar, sa), sorted by read and line. order: place of each gid in the header."""
    from strandloom.functions.sequences import reverse_complement

    seq = F.when(F.col("flag").bitwiseAND(16) != 0, reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    rows = lines.join(reads.select("read_id", F.col("name").alias("qname"), "seq"), "read_id").select("read_id", "line_id", "qname", "flag", "gid", "pos", "mapq", "cigar", seq.alias("seq"), "sa")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = b""
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                held += record(r["qname"], r["flag"], order[r["gid"]], r["pos"] - 1, r["mapq"], [(e["op"], e["n"]) for e in r["cigar"]], r["seq"], r["sa"] or "")
                while len(held) >= BLOCK:
                    out.append(block(held[:BLOCK]))
                    held = held[BLOCK:]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["block"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([block(held)], pa.binary())], ["block"])

    return rows.repartitionByRange("read_id", "line_id").sortWithinPartitions("read_id", "line_id").mapInArrow(run, "block binary")


def write_bam(lines: DataFrame, reads: DataFrame, genomes: DataFrame, path: str, head: list[str]) -> None:
    """One file at any path that Spark can write; a task's blocks are held by the driver at a time."""
    spark = lines.sparkSession
    known = genomes.select("gid", "name", F.length("seq").alias("n")).orderBy("gid").collect()
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        data = header(head, [(r["name"], r["n"]) for r in known])
        for i in range(0, len(data), BLOCK):
            out.write(bytearray(block(data[i : i + BLOCK])))
        for row in blocks(lines, reads, {r["gid"]: i for i, r in enumerate(known)}).toLocalIterator():
            out.write(bytearray(row["block"]))
        out.write(bytearray(END_OF_FILE))
    finally:
        out.close()
