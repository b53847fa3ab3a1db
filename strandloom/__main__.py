"""Command line: maps read files to genome files and writes blocks, APF, SAM or BAM records of each read file under its own name."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from strandloom.config import gap_length, preset
from strandloom.operators import alignments
from strandloom.plans import mapping
from strandloom.sources import bam, formats

# Bits of --output-type.
APF, SAM_BIT, BAM_BIT = 1, 2, 4


def options() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandloom", description=__doc__)
    p.add_argument("files", nargs="+", help="read files, then x, then genome files (two files need no x); FASTA or FASTQ, plain or gzipped, each may hold several separated by commas")
    p.add_argument("-o", "--output", required=True, help="folder")
    p.add_argument("-p", "--preset", type=int, default=1, choices=(0, 1, 2))
    p.add_argument("-g", "--gap", type=int, nargs="?", const=1, default=1, help="gap mapping: 0 off, 1 gaps over 50 bases, 2 to 9 over 10, else over that many")
    p.add_argument("-ot", "--output-type", type=int, default=SAM_BIT, help="sum of 1 APF, 2 SAM, 4 BAM")
    p.add_argument("-f", "--formats", default="", help="names instead of a sum: any of blocks, apf, sam, bam, separated by commas")
    p.add_argument("-a", "--append", action="store_true", help="add to what is in the folder")
    return p


def reads_and_genomes(files: list[str]) -> tuple[list[str], list[str]]:
    """Read and genome files of `reads x genomes`, or of two arguments."""
    if "x" in files:
        cut = files.index("x")
        sides = files[:cut], files[cut + 1 :]
    elif len(files) == 2:
        sides = files[:1], files[1:]
    else:
        raise ValueError("give read files, x, genome files")
    reads, genomes = ([p for f in side for p in f.split(",")] for side in sides)
    if not reads or not genomes:
        raise ValueError("give read files and genome files")
    return reads, genomes


def main(argv: list[str] | None = None) -> int:
    """0, or 2 for arguments that make no sense, 3 for files that aren't there."""
    given = options().parse_args(argv)
    try:
        read_files, genome_files = reads_and_genomes(given.files)
    except ValueError as wrong:
        print(wrong, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("strandloom").getOrCreate()
    if absent := formats.missing(spark, read_files + genome_files):
        print(f"not found: {', '.join(absent)}", file=sys.stderr)
        return 3
    params = replace(preset(given.preset), gap_len=gap_length(given.gap))
    kinds = set(given.formats.split(",")) if given.formats else {k for k, bit in (("apf", APF), ("sam", SAM_BIT), ("bam", BAM_BIT)) if given.output_type & bit}
    genomes = formats.genomes_of(formats.read_sequences(spark, genome_files)).persist()
    header = alignments.sam_header(genomes, command=" ".join(argv or sys.argv[1:]))
    for path in read_files:  # each read file has its own results
        out = f"{given.output}/{prefix_of(path)}"
        reads = formats.reads_of(formats.read_sequences(spark, [path])).persist()
        found = mapping.map_reads(reads, genomes, params)
        mode = "append" if given.append else "overwrite"
        if "blocks" in kinds:
            found.blocks.write.mode(mode).parquet(f"{out}/blocks")
        if "apf" in kinds:
            formats.write_lines(alignments.apf_text(found.cords, reads, genomes), f"{out}/apf", ["read_id", "block_id", "ord"], mode=mode)
        if "sam" in kinds:
            formats.write_lines(alignments.sam_text(found.lines, reads), f"{out}/sam", ["read_id", "line_id"], header, mode=mode)
        if "bam" in kinds:
            bam.write_bam(found.lines, reads, genomes, f"{out}/records.bam", header)
        reads.unpersist()
    return 0


def prefix_of(path: str) -> str:
    """File name without folders and without what follows its first dot."""
    return path.rstrip("/").rsplit("/", 1)[-1].split(".", 1)[0]


if __name__ == "__main__":
    sys.exit(main())
