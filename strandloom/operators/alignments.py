"""Virtual alignments: cords to CIGAR lines, SAM fields and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.config import SamParams
from strandloom.functions import sequences as S

SUPPLEMENTARY, REVERSE = 2048, 16


def line_ids(cords: DataFrame, params: SamParams = SamParams()) -> DataFrame:
    """Adds line_id: a new SAM line begins after a block's end, where x or y steps back, at a change of strand or genome, or where both gaps are over `line_gap`."""
    by = Window.partitionBy("read_id").orderBy("ord")
    lag = lambda c: F.lag(c).over(by)
    new = (
        lag("ord").isNull() | (lag("block_id") != F.col("block_id")) | (F.col("x1") < lag("x1")) | (F.col("y1") < lag("y1"))
        | ((F.col("x1") - lag("x2") > params.line_gap) & (F.col("y1") - lag("y2") > params.line_gap)) | (lag("strand") != F.col("strand")) | (lag("gid") != F.col("gid"))
    )
    return cords.withColumn("new", F.when(new, 1).otherwise(0)).withColumn("line_id", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def pair_operations(dx: Column, dy: Column, op: str) -> Column:
    """`op` of min(dx, dy), then D or I of what is left; empty ones have n = 0."""
    rest = dx - dy
    return F.array(F.struct(F.lit(op).alias("op"), F.least(dx, dy).cast("long").alias("n")), F.struct(F.when(rest >= 0, "D").otherwise("I").alias("op"), F.abs(rest).cast("long").alias("n")))


def merged_runs(cigar: Column) -> Column:
    """Neighbours with the same operation as one, without empty ones."""
    kept = F.filter(cigar, lambda e: e["n"] > 0)

    def step(done: Column, e: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        both = F.struct(e["op"].alias("op"), (last["n"] + e["n"]).alias("n"))
        head = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(last["op"] == e["op"], F.array_append(head, both)).otherwise(F.array_append(done, F.struct(e["op"].alias("op"), e["n"].alias("n"))))

    return F.aggregate(kept, F.array().cast("array<struct<op:string,n:bigint>>"), step)


def run_lengths(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The same over exploded rows (keys, ord, op, n): islands of one operation, summed."""
    by = Window.partitionBy(*keys).orderBy("ord")
    kept = rows.where("n > 0")
    runs = kept.withColumn("new", F.when(F.lag("op").over(by) == F.col("op"), 0).otherwise(1)).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "run", "op").agg(F.sum("n").alias("n"))


def virtual_alignments(cords: DataFrame, reads: DataFrame, params: SamParams = SamParams()) -> DataFrame:
    """A row for each SAM line: read_id, line_id, gid, flag, pos (1-based), mapq, cigar.

    cords: read_id, ord, block_id, gid, strand, x1, y1, x2, y2. Windows give =, what lies between them X, and the rest D or I; S at both ends.
    """
    lines = line_ids(cords, params)
    by = Window.partitionBy("read_id", "line_id").orderBy("ord")
    nx, ny = F.lead("x1").over(by), F.lead("y1").over(by)
    inside_x, inside_y = F.least(F.col("x2"), nx) - F.col("x1"), F.least(F.col("y2"), ny) - F.col("y1")
    between = F.when(nx.isNull(), F.array().cast("array<struct<op:string,n:bigint>>")).otherwise(pair_operations(F.greatest(nx - F.col("x2"), F.lit(0)), F.greatest(ny - F.col("y2"), F.lit(0)), "X"))
    inside = F.when(nx.isNull(), pair_operations(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), "=")).otherwise(pair_operations(inside_x, inside_y, "="))
    steps = lines.withColumn("ops", F.concat(inside, between))
    grouped = steps.groupBy("read_id", "line_id").agg(
        F.first("gid").alias("gid"), F.first("strand").alias("strand"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("y2").alias("y2"), F.sort_array(F.collect_list(F.struct("ord", "ops"))).alias("all")
    )
    lengths = reads.select("read_id", F.length("seq").cast("long").alias("len"))
    clip = lambda n: F.array(F.struct(F.lit("S").alias("op"), n.cast("long").alias("n")))
    ops = F.flatten(F.transform("all", lambda a: a["ops"]))
    out = grouped.join(lengths, "read_id").withColumn("cigar", merged_runs(F.concat(clip(F.col("y1")), ops, clip(F.col("len") - F.col("y2")))))
    return out.select("read_id", "line_id", "gid", sam_flag(F.col("line_id"), F.col("strand")).alias("flag"), (F.col("x1") + 1).alias("pos"), F.lit(params.mapq).alias("mapq"), "cigar")


def sam_flag(line_id: Column, strand: Column) -> Column:
    return (F.when(line_id > 1, SUPPLEMENTARY).otherwise(0) + F.when(strand == 1, REVERSE).otherwise(0)).cast("int")


def short_cigar(cigar: Column) -> Column:
    """S M D-or-I S of a CIGAR for SA tags: M is all of = and X."""
    total = lambda *ops: F.aggregate(cigar, F.lit(0).cast("long"), lambda s, e: s + F.when(e["op"].isin(*ops), e["n"]).otherwise(0))
    end = lambda at: F.when(F.try_element_at(cigar, F.lit(at))["op"] == "S", F.try_element_at(cigar, F.lit(at))["n"]).otherwise(0)
    part = lambda n, op: F.when(n > 0, F.concat(n.cast("string"), F.lit(op))).otherwise("")
    net = total("D") - total("I")
    return F.concat(part(end(1), "S"), part(total("=", "X", "M"), "M"), part(net, "D"), part(-net, "I"), part(F.when(F.size(cigar) > 1, end(-1)).otherwise(0), "S"))


def edit_count(cigar: Column) -> Column:
    return F.aggregate(cigar, F.lit(0).cast("long"), lambda s, e: s + F.when(e["op"].isin("X", "I", "D"), e["n"]).otherwise(0))


def supplementary_tags(lines: DataFrame, genomes: DataFrame) -> DataFrame:
    """Adds sa: for each line, name,pos,strand,cigar,mapq,nm; of the read's other lines in order.

    Lines of a read are few, so they are gathered once and each takes out its own.
    """
    named = lines.join(genomes.select("gid", F.col("name").alias("gname")), "gid")
    own = F.concat_ws(",", "gname", F.col("pos").cast("string"), F.when(F.col("flag").bitwiseAND(REVERSE) != 0, "-").otherwise("+"), short_cigar(F.col("cigar")), F.col("mapq").cast("string"), edit_count(F.col("cigar")).cast("string"))
    every = F.sort_array(F.collect_list(F.struct("line_id", own.alias("sa"))).over(Window.partitionBy("read_id")))
    others = named.withColumn("every", every)
    return others.withColumn("sa", F.array_join(F.transform(F.filter("every", lambda e: e["line_id"] != F.col("line_id")), lambda e: F.concat(e["sa"], F.lit(";"))), "")).drop("every")


def sam_text(lines: DataFrame, reads: DataFrame) -> DataFrame:
    """value: the tab-separated records (read_id, line_id kept for ordering)."""
    named = lines.join(reads.select("read_id", F.col("name").alias("qname"), "seq"), "read_id")
    seq = F.when(F.col("flag").bitwiseAND(REVERSE) != 0, S.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    tag = F.when(F.col("sa") != "", F.concat(F.lit("\tSA:Z:"), F.col("sa"))).otherwise("")
    fields = F.concat_ws("\t", "qname", F.col("flag").cast("string"), "gname", F.col("pos").cast("string"), F.col("mapq").cast("string"), S.cigar_text(F.col("cigar")), F.lit("*"), F.lit("0"), F.lit("0"), seq, F.lit("*"))
    return named.select("read_id", "line_id", F.concat(fields, tag).alias("value"))


def sam_header(genomes: DataFrame, sample: str = "sample", command: str = "") -> list[str]:
    """Header lines; one for each genome, so few."""
    rows = genomes.select("name", F.length("seq").alias("len"), "gid").orderBy("gid").collect()
    return ["@HD\tVN:1.6", *[f"@SQ\tSN:{r['name']}\tLN:{r['len']}" for r in rows], f"@RG\tID:1\tSM:{sample}", f"@PG\tID:strandloom\tCL:{command}"]


def apf_rows(cords: DataFrame) -> DataFrame:
    """read_id, block_id, ord, y, x, dy, dx, strand: positions and steps from the row before in the block (0 for its first)."""
    by = Window.partitionBy("read_id", "block_id").orderBy("ord")
    step = lambda c: F.coalesce(F.col(c) - F.lag(c).over(by), F.lit(0))
    return cords.select("read_id", "block_id", "ord", F.col("y1").alias("y"), F.col("x1").alias("x"), step("y1").alias("dy"), step("x1").alias("dx"), "strand")


def apf_text(cords: DataFrame, reads: DataFrame, genomes: DataFrame) -> DataFrame:
    """read_id, block_id, ord, value: for each block a line `@ read length ystart yend strand genome length xstart xend` (strand: of most of its cords, the first's if even),
    then a line `| y x dy dx strand` for each cord."""
    by = Window.partitionBy("read_id", "block_id")
    named = cords.join(reads.select("read_id", F.col("name").alias("rname"), F.length("seq").alias("rlen")), "read_id").join(genomes.select("gid", F.col("name").alias("gname"), F.length("seq").alias("glen")), "gid")
    ones, n = F.sum(F.col("strand")).over(by), F.count("*").over(by)
    first = F.first("strand").over(by.orderBy("ord"))
    sign = F.when(2 * ones > n, "-").when((2 * ones == n) & (first == 1), "-").otherwise("+")
    whole = named.withColumns({"sign": sign, "ys": F.first("y1").over(by.orderBy("ord")), "xs": F.first("x1").over(by.orderBy("ord")), "place": F.row_number().over(by.orderBy("ord")), "ye": F.max("y2").over(by), "xe": F.max("x2").over(by)})
    heads = whole.where("place = 1").select("read_id", "block_id", F.lit(0).cast("long").alias("ord"), F.concat_ws(" ", F.lit("@"), "rname", "rlen", "ys", F.least("ye", "rlen"), "sign", "gname", "glen", "xs", F.least("xe", "glen")).alias("value"))
    rows = apf_rows(cords)
    own = rows.select("read_id", "block_id", F.col("ord").cast("long").alias("ord"), F.concat_ws(" ", F.lit("|"), "y", "x", "dy", "dx", F.when(F.col("strand") == 1, "-").otherwise("+")).alias("value"))
    return heads.unionByName(own)


def sequence_by_cigar(cigar: Column, genome: Column, read: Column) -> Column:
    """The SEQ of a virtual alignment: = and M give genome bases, I and S the read's, X the read's where it differs from the genome's and else N; D only moves on.

    `genome` begins at the alignment's position.
    """
    start = F.struct(F.lit(1).cast("long").alias("g"), F.lit(1).cast("long").alias("r"), F.lit("").alias("out"))

    def step(s: Column, e: Column) -> Column:
        n, op = e["n"], e["op"]
        g, r = F.substr(genome, s["g"].cast("int"), n.cast("int")), F.substr(read, s["r"].cast("int"), n.cast("int"))
        mixed = F.array_join(F.zip_with(F.split(r, ""), F.split(g, ""), lambda a, b: F.when(a == b, "N").otherwise(F.coalesce(a, F.lit("")))), "")
        piece = F.when(op.isin("=", "M"), g).when(op.isin("I", "S"), r).when(op == "X", mixed).otherwise("")
        return F.struct((s["g"] + F.when(op.isin("=", "M", "X", "D"), n).otherwise(0)).alias("g"), (s["r"] + F.when(op.isin("=", "M", "X", "I", "S"), n).otherwise(0)).alias("r"), F.concat(s["out"], piece).alias("out"))

    return F.aggregate(cigar, start, step)["out"]
