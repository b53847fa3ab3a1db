"""Queries over the driver's tables, one or more for each operator, with the same result in DuckDB's SQL.

Bridge: letters of `documents` texts, taken as bases, are the reads; `benchmark` texts are the genomes. `events` by user are ordered points, `lineitem` with `orders`
intervals and pairs of steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.config import BinParams, ChainParams, EngineParams
from strandloom.functions import sequences as S
from strandloom.operators import alignments, anchors, blocks, chains, composition, exact, features, scores, seeds
from strandloom.plans import mapping
from strandloom.sources import formats
from strandloom.streaming import runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
SPARK_TYPES = {"l": "long", "d": "double", "s": "string", "b": "boolean"}
DUCK_TYPES = {"l": "BIGINT", "d": "DOUBLE", "s": "VARCHAR", "b": "BOOLEAN"}


def define(name: str, spec: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query whose columns are `spec` ("name type ..."), in both engines with the same types."""
    columns = [tuple(c.split(":")) for c in spec.split()]

    def wrap(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).select(*[F.col(c).cast(SPARK_TYPES[t]).alias(c) for c, t in columns])

        QUERIES[name] = run
        if sql is not None:
            head, _, last = sql.rpartition("=>") if "=>" in sql else ("", "", sql)
            ORACLES[name] = (f"WITH {head.strip()} " if head.strip() else "") + "SELECT " + ", ".join(f"CAST({c} AS {DUCK_TYPES[t]}) AS {c}" for c, t in columns) + f" FROM ({last.strip()}) AS q"
        return run

    return wrap


def T(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T(spark, sf_dir, "documents").select(F.col("doc_id").alias("read_id"), F.concat(F.lit("read"), "doc_id").alias("name"), S.dna(F.col("text")).alias("seq"))


def genomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T(spark, sf_dir, "benchmark").select(F.col("item_id").alias("gid"), F.concat(F.lit("chr"), "item_id").alias("name"), S.dna(F.col("text")).alias("seq"))


def whole_text_distances(seqs: DataFrame) -> DataFrame:
    """doc_id, edit (to the sequence of the next id, null if there is none), hamming (to its own reverse complement), over whole sequences."""
    following = seqs.select((F.col("read_id") - 1).alias("id"), F.col("seq").alias("b"))
    pairs = seeds.spread(seqs.select(F.col("read_id").alias("id"), F.col("seq").alias("a"))).join(following, "id", "left")
    return exact.whole_distances(pairs).withColumnRenamed("id", "doc_id")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, ord, x (seconds), y (ord), value, event_id."""
    e = T(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("x"))
    return e.withColumn("ord", F.row_number().over(Window.partitionBy("user_id").orderBy("x", "event_id"))).withColumn("y", F.col("ord"))


def days(c: str) -> F.Column:
    return F.datediff(F.col(c).cast("date"), F.lit("1992-01-01").cast("date")).cast("long")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cust, left_id (order and line), start_, end_ in days: from order to shipment."""
    l, o = T(spark, sf_dir, "lineitem"), T(spark, sf_dir, "orders")
    both = l.join(o, l["l_orderkey"] == o["o_orderkey"])
    out = both.select(F.col("o_custkey").alias("cust"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("left_id"), F.col("l_orderkey"), days("o_orderdate").alias("start_"), days("l_shipdate").alias("end_"))
    return out.where("end_ > start_")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, l_linenumber, dx, dy, same_strand."""
    l = T(spark, sf_dir, "lineitem")
    return l.select("l_orderkey", "l_linenumber", (F.floor(F.col("l_extendedprice") / 20) - 300).cast("long").alias("dx"), (F.floor(F.col("l_quantity") * 40) - 100).cast("long").alias("dy"), (F.col("l_returnflag") != "R").alias("same_strand"))


def cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey, cigar: an order's lines as operations."""
    l = T(spark, sf_dir, "lineitem")
    op = F.when(F.col("l_returnflag") == "R", "=").when(F.col("l_returnflag") == "A", "D").when(F.col("l_linestatus") == "F", "X").otherwise("I")
    return l.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").isNull().alias("last"), "l_linenumber", op.alias("op"), F.floor("l_quantity").cast("long").alias("n")))).alias("a")).select("l_orderkey", F.transform("a", lambda x: F.struct(x["op"].alias("op"), x["n"].alias("n"))).alias("cigar"))


DNA = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
D_READS = f"reads AS (SELECT doc_id AS read_id, 'read' || doc_id AS name, {DNA} AS seq FROM documents)"
D_GENOMES = f"genomes AS (SELECT item_id AS gid, 'chr' || item_id AS name, {DNA} AS seq FROM benchmark)"
D_POINTS = "e AS (SELECT user_id, event_id, value, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS x FROM events), points AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x, event_id) AS ord, row_number() OVER (PARTITION BY user_id ORDER BY x, event_id) AS y FROM e)"
D_INTERVALS = "ivs AS (SELECT o_custkey AS cust, l_orderkey * 10 + l_linenumber AS left_id, l_orderkey, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS start_, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS end_ FROM lineitem JOIN orders ON l_orderkey = o_orderkey), intervals AS (SELECT * FROM ivs WHERE end_ > start_)"
D_STEPS = "steps AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_extendedprice / 20) - 300 AS BIGINT) AS dx, CAST(floor(l_quantity * 40) - 100 AS BIGINT) AS dy, l_returnflag <> 'R' AS same_strand FROM lineitem)"
D_OPS = "ops AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN '=' WHEN l_returnflag = 'A' THEN 'D' WHEN l_linestatus = 'F' THEN 'X' ELSE 'I' END AS op, CAST(floor(l_quantity) AS BIGINT) AS n FROM lineitem)"
RC = "reverse(translate({0}, 'ACGTN', 'TGCAN'))"


def d_kmers(source: str, seq_id: str, k: int, step: int = 1) -> str:
    return f"(SELECT seq_id, pos, kmer FROM (SELECT seq_id, p AS pos, substr(seq, p + 1, {k}) AS kmer FROM (SELECT {seq_id} AS seq_id, seq, unnest(range(0, greatest(length(seq) - {k} + 1, 0), {step})) AS p FROM {source})) WHERE kmer NOT LIKE '%N%')"


COUNT = "(length({0}) - length(replace({0}, '{1}', '')))"
STRAND = "3 * ({T} - {A}) + {G} - {C}".format(**{b: COUNT.format("kmer", b) for b in "ACGT"})
BITS = "+".join(f"(instr('ACGT', substr(rpad(ext, 4, 'A'), {i + 1}, 1)) - 1) * {4 ** (3 - i)}" for i in range(4))


def d_seeds(source: str, seq_id: str, step: int) -> str:
    words = ", ".join(f"substr(canon, {i}, 13)" for i in range(1, 10))
    return (
        f"(SELECT seq_id, pos, strand, minimizer, {BITS} AS ext FROM (SELECT *, substr(canon, list_position([{words}], minimizer) + 13, 4) AS ext FROM (SELECT *, least({words}) AS minimizer FROM "
        f"(SELECT seq_id, pos, CASE WHEN {STRAND} > 0 THEN 0 ELSE 1 END AS strand, CASE WHEN {STRAND} > 0 THEN kmer ELSE {RC.format('kmer')} END AS canon FROM {d_kmers(source, seq_id, 21, step)}))))"
    )


D_INDEX = f"""gseeds AS (SELECT *, lag(minimizer) OVER w AS lm, lag(pos) OVER w AS lp FROM {d_seeds('genomes', 'gid', 9)} WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
gnew AS (SELECT * FROM gseeds WHERE lm IS NULL OR lm <> minimizer OR pos - lp > 10),
gindex AS (SELECT seq_id AS gid, pos AS x, strand, minimizer, ext FROM gnew WHERE minimizer IN (SELECT minimizer FROM gnew GROUP BY 1 HAVING count(*) <= 400))"""
D_PROBES = f"""long AS (SELECT * FROM reads WHERE length(seq) > 200),
rseeds AS (SELECT *, lag(minimizer) OVER (PARTITION BY seq_id ORDER BY pos) AS lm FROM {d_seeds('long', 'read_id', 15)}),
probes AS (SELECT seq_id AS read_id, pos AS y, strand, minimizer, ext, length(seq) AS len FROM rseeds JOIN long ON seq_id = read_id WHERE lm IS NULL OR lm <> minimizer)"""


def d_anchors(where: str, more: str = "") -> str:
    return f"""anchors AS (SELECT read_id, gid, strand, x, y, x - y AS diag{more} FROM (SELECT r.read_id, g.gid, xor(r.strand, g.strand) AS strand, g.x, CASE WHEN r.strand = g.strand THEN r.y ELSE r.len - 21 - r.y END AS y, r.ext AS ext_r, g.ext AS ext_g FROM probes r JOIN gindex g USING (minimizer)) WHERE {where})"""


SUBSTITUTED = "(xor(ext_g, ext_r) = 0 OR xor(ext_g, ext_r) / greatest(xor(ext_g, ext_r) & -xor(ext_g, ext_r), 1) < 4)"
D_ANCHORS = ",\n".join([D_READS, D_GENOMES, D_INDEX, D_PROBES, d_anchors(SUBSTITUTED)])
LEAST = 2  # these genomes are short: bins with more than 2 anchors
D_BINNED = f"{D_ANCHORS}, binned AS (SELECT *, floor((diag + 1048576) / 30000) AS bin FROM anchors), counted AS (SELECT *, count(*) OVER (PARTITION BY read_id, gid, strand, bin) AS n_bin FROM binned), best AS (SELECT *, max(n_bin) OVER (PARTITION BY read_id) AS best FROM counted), kept AS (SELECT * FROM best WHERE n_bin > {LEAST} OR best <= {LEAST})"


def shown(df: DataFrame) -> DataFrame:
    """Minimizers as words."""
    return df.withColumn("minimizer", S.unpack(F.col("minimizer"), 13))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.genome_index(genomes(spark, sf_dir))


def found(spark: SparkSession, sf_dir: str, mode: str = "d") -> DataFrame:
    return anchors.match(seeds.read_probes(reads(spark, sf_dir)), index(spark, sf_dir), mode=mode)


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.bin_filter(found(spark, sf_dir), BinParams(least=LEAST))


# sequence functions
define("seq_project", "read_id:l seq:s rc:s", f"{D_READS} => SELECT read_id, seq, {RC.format('seq')} AS rc FROM reads")(lambda s, d: reads(s, d).withColumn("rc", S.reverse_complement(F.col("seq"))))
define("seq_length_filter", "read_id:l len:l", f"{D_READS} => SELECT read_id, length(seq) AS len FROM reads WHERE length(seq) > 200")(lambda s, d: reads(s, d).withColumn("len", F.length("seq")).where("len > 200"))
define("seq_homopolymer", "read_id:l hpc:s", f"{D_READS} => SELECT read_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(seq, 'A+', 'A', 'g'), 'C+', 'C', 'g'), 'G+', 'G', 'g'), 'T+', 'T', 'g') AS hpc FROM reads")(lambda s, d: reads(s, d).select("read_id", S.homopolymer_compressed(F.col("seq")).alias("hpc")))
define("kmer_explode", "seq_id:l pos:l kmer:s", f"{D_READS} => SELECT * FROM {d_kmers('reads', 'read_id', 9, 5)}")(lambda s, d: seeds.kmer_rows(reads(s, d), "read_id", 9, 5))
define("kmer_count", "kmer:s n:l", f"{D_READS} => SELECT kmer, count(*) AS n FROM {d_kmers('reads', 'read_id', 9)} GROUP BY kmer")(lambda s, d: seeds.kmer_counts(reads(s, d), "read_id", 9))
define("canonical_strand", "seq_id:l pos:l total:l canon:s", f"{D_GENOMES} => SELECT seq_id, pos, {STRAND} AS total, CASE WHEN {STRAND} > 0 THEN kmer ELSE {RC.format('kmer')} END AS canon FROM {d_kmers('genomes', 'gid', 21)}")(
    lambda s, d: seeds.kmer_rows(genomes(s, d), "gid", 21).select("seq_id", "pos", S.strand_sum(F.col("kmer")).alias("total"), S.canonical(F.col("kmer")).alias("canon"))
)
define("kmer_pack", "seq_id:l pos:l number:l back:s", f"{D_GENOMES} => SELECT seq_id, pos, {'+'.join(f'(instr(chr(65) || chr(67) || chr(71) || chr(84), substr(kmer, {i + 1}, 1)) - 1) * {4 ** (8 - i)}' for i in range(9))} AS number, kmer AS back FROM {d_kmers('genomes', 'gid', 9)}")(
    lambda s, d: seeds.kmer_rows(genomes(s, d), "gid", 9).select("seq_id", "pos", S.pack(F.col("kmer")).alias("number"), S.unpack(S.pack(F.col("kmer")), 9).alias("back"))
)
define("forward_projection", "read_id:l fwd_start:l fwd_end:l flipped:l", f"{D_READS} => SELECT read_id, CASE WHEN read_id % 2 = 0 THEN 10 ELSE length(seq) - 1 - 60 END AS fwd_start, CASE WHEN read_id % 2 = 0 THEN 60 ELSE length(seq) - 1 - 10 END AS fwd_end, length(seq) * (read_id % 2) - (2 * (read_id % 2) - 1) * 10 AS flipped FROM reads")(
    lambda s, d: reads(s, d).select(
        "read_id", S.forward_start(F.lit(10), F.lit(60), F.col("read_id") % 2, F.length("seq")).alias("fwd_start"), S.forward_end(F.lit(10), F.lit(60), F.col("read_id") % 2, F.length("seq")).alias("fwd_end"), S.flip(F.lit(10), F.length("seq"), F.col("read_id") % 2).alias("flipped")
    )
)
define("cord_pack_unpack", "l_orderkey:l l_linenumber:l cord:l strand:l gid:l x:l y:l", "SELECT l_orderkey, l_linenumber, ((CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END)::BIGINT << 61) | (l_linenumber::BIGINT << 50) | (l_partkey::BIGINT << 20) | l_suppkey AS cord, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS strand, l_linenumber AS gid, l_partkey AS x, l_suppkey AS y FROM lineitem")(
    lambda s, d: T(s, d, "lineitem").select("l_orderkey", "l_linenumber", S.pack_cord(F.when(F.col("l_returnflag") == "R", 1).otherwise(0), F.lit(0), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).alias("cord")).select("l_orderkey", "l_linenumber", "cord", *S.unpack_cord(F.col("cord")))
)
define("edit_and_hamming", "doc_id:l edit:l hamming:l", "b AS (SELECT doc_id, translate(md5(text), '0123456789abcdef', 'ACGTACGTACGTACGT') AS a, translate(md5(source || lang), '0123456789abcdef', 'ACGTACGTACGTACGT') AS c FROM documents) => SELECT doc_id, levenshtein(a, c) AS edit, hamming(a, c) AS hamming FROM b")(
    lambda s, d: (lambda b: b.select("doc_id", S.edit_distance(F.col("a"), F.col("c")).alias("edit"), S.hamming(F.col("a"), F.col("c")).alias("hamming")))(
        T(s, d, "documents").select("doc_id", *[F.translate(F.md5(c.cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT").alias(n) for n, c in (("a", F.col("text")), ("c", F.concat("source", "lang")))])
    )
)
AMINO = f"substr('{S.CODE}', (instr('ACGT', substr(st, i * 3 + 1 + {{f}}, 1)) - 1) * 16 + (instr('ACGT', substr(st, i * 3 + 2 + {{f}}, 1)) - 1) * 4 + instr('ACGT', substr(st, i * 3 + 3 + {{f}}, 1)), 1)"
define("translate_frames", "gid:l f0:s f1:s f3:s f5:s", f"{D_GENOMES} => SELECT gid, " + ", ".join(f"array_to_string(list_transform(range(0, (length(seq) - {f % 3}) // 3), lambda i: {AMINO.format(f=f % 3).replace('st,', ('seq' if f < 3 else RC.format('seq')) + ',')}), '') AS f{f}" for f in (0, 1, 3, 5)) + " FROM genomes")(
    lambda s, d: genomes(s, d).select("gid", *[S.translated(F.col("seq"), f).alias(f"f{f}") for f in (0, 1, 3, 5)])
)

# seeds and joins
define("minimizer", "seq_id:l pos:l strand:l minimizer:s ext:l", f"{D_GENOMES} => SELECT * FROM {d_seeds('genomes', 'gid', 9)}")(lambda s, d: shown(seeds.seed_rows(genomes(s, d), "gid", 9)))
define("read_probes", "read_id:l y:l strand:l minimizer:s ext:l len:l", f"{D_READS}, {D_PROBES} => SELECT * FROM probes")(lambda s, d: shown(seeds.read_probes(reads(s, d))))
define("genome_index", "gid:l x:l strand:l minimizer:s ext:l", f"{D_GENOMES}, {D_INDEX} => SELECT * FROM gindex")(lambda s, d: shown(index(s, d)))
define("kmer_freq_cap", "seq_id:l pos:l minimizer:s", f"{D_READS}, seeds AS (SELECT * FROM {d_seeds('reads', 'read_id', 8)}) => SELECT seq_id, pos, minimizer FROM seeds WHERE minimizer IN (SELECT minimizer FROM seeds GROUP BY 1 HAVING count(*) <= 4)")(lambda s, d: shown(seeds.capped(seeds.seed_rows(reads(s, d), "read_id", 8), 4)))
define("index_statistics", "n:l blocks:l", f"{D_READS} => SELECT n, count(*) AS blocks FROM (SELECT minimizer, count(*) AS n FROM {d_seeds('reads', 'read_id', 9)} GROUP BY 1) GROUP BY 1")(lambda s, d: seeds.index_statistics(seeds.seed_rows(reads(s, d), "read_id", 9)))
define("anchor_join", "read_id:l gid:l strand:l x:l y:l diag:l", f"{D_ANCHORS} => SELECT * FROM anchors")(found)
define("anchor_hindex", "read_id:l gid:l strand:l x:l y:l diag:l", ",\n".join([D_READS, D_GENOMES, D_INDEX, D_PROBES, d_anchors("ext_g = ext_r OR ext_g = 0")]) + " => SELECT * FROM anchors")(lambda s, d: found(s, d, "h"))
define("anchor_long_pattern", "read_id:l gid:l strand:l x:l y:l long_pattern:b", ",\n".join([D_READS, D_GENOMES, D_INDEX, D_PROBES, d_anchors("x > y", ", ext_r = ext_g AS long_pattern")]) + " => SELECT * FROM anchors")(lambda s, d: found(s, d, "s"))
define("diag_bin_filter", "read_id:l gid:l strand:l x:l y:l bin:l n_bin:l", f"{D_BINNED} => SELECT * FROM kept")(kept)
D_BLOCKS = f"{D_BINNED}, stepped AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM kept WINDOW w AS (PARTITION BY read_id, gid, strand, bin ORDER BY x, y)), marked AS (SELECT *, sum(CASE WHEN dx >= 0 AND dx < 500 AND dy >= 0 AND dy < 500 THEN 0 ELSE 1 END) OVER (PARTITION BY read_id, gid, strand, bin ORDER BY x, y ROWS UNBOUNDED PRECEDING) AS block_id FROM stepped), blocks AS (SELECT read_id, gid, strand, bin, block_id, min(y) AS ystart, max(y) AS yend, min(x) AS xstart, max(x) AS xend, count(*) AS n_anchors FROM marked GROUP BY 1, 2, 3, 4, 5)"
define("map_reads", "read_id:l gid:l strand:l ystart:l yend:l xstart:l xend:l n_anchors:l", f"{D_BLOCKS} => SELECT * FROM blocks")(lambda s, d: mapping.anchor_blocks(reads(s, d), genomes(s, d), EngineParams(bins=BinParams(least=LEAST))))
define("diag_islands", "read_id:l gid:l strand:l x:l y:l island:l", f"{D_ANCHORS}, st AS (SELECT *, CASE WHEN diag - lag(diag) OVER w < (abs(y - lag(y) OVER w) >> 2) THEN 0 ELSE 1 END AS fresh FROM anchors WINDOW w AS (PARTITION BY read_id, gid, strand ORDER BY diag, y, x)) => SELECT *, sum(fresh) OVER (PARTITION BY read_id, gid, strand ORDER BY diag, y, x ROWS UNBOUNDED PRECEDING) AS island FROM st")(lambda s, d: anchors.diagonal_islands(found(s, d)))
define("density_filter", "read_id:l gid:l strand:l island:l n:l span_y:l", f"{D_ANCHORS}, st AS (SELECT *, CASE WHEN diag - lag(diag) OVER w < (abs(y - lag(y) OVER w) >> 2) THEN 0 ELSE 1 END AS fresh FROM anchors WINDOW w AS (PARTITION BY read_id, gid, strand ORDER BY diag, y, x)), isl AS (SELECT *, sum(fresh) OVER (PARTITION BY read_id, gid, strand ORDER BY diag, y, x ROWS UNBOUNDED PRECEDING) AS island FROM st) => SELECT read_id, gid, strand, island, count(*) AS n, max(y) - min(y) AS span_y FROM isl GROUP BY 1, 2, 3, 4 HAVING count(*) > greatest((max(y) - min(y)) / 1024, 2)")(lambda s, d: anchors.density_filter(anchors.diagonal_islands(found(s, d))))
define("genomes_of_reads", "read_id:l gid:l", f"{D_ANCHORS} => SELECT DISTINCT read_id, gid FROM anchors")(lambda s, d: anchors.genomes_of_reads(found(s, d)))
define("read_genome_semi", "read_id:l len:l", f"{D_ANCHORS} => SELECT read_id, length(seq) AS len FROM reads WHERE read_id IN (SELECT read_id FROM anchors)")(lambda s, d: anchors.reads_touching(reads(s, d), anchors.genomes_of_reads(found(s, d))).withColumn("len", F.length("seq")))
define("topk_blocks", "read_id:l gid:l xstart:l n_anchors:l rank:l", f"{D_BLOCKS}, r AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY n_anchors DESC, gid, strand, bin, block_id) AS rank, max(n_anchors) OVER (PARTITION BY read_id) AS best FROM blocks) => SELECT * FROM r WHERE rank = 1 OR (rank <= 5 AND n_anchors > 0.8 * best)")(
    lambda s, d: blocks.block_table(kept(s, d), ["read_id", "gid", "strand", "bin"], 500)
    .withColumn("rank", F.row_number().over(Window.partitionBy("read_id").orderBy(F.desc("n_anchors"), "gid", "strand", "bin", "block_id")))
    .withColumn("best", F.max("n_anchors").over(Window.partitionBy("read_id")))
    .where("rank = 1 or (rank <= 5 and n_anchors > 0.8 * best)")
)

# composition features
WIN = "(SELECT seq_id, cell, substr(seq, cell * 16 + 1, {n}) AS w FROM (SELECT read_id AS seq_id, seq, unnest(range(0, CASE WHEN length(seq) >= {n} THEN (length(seq) - {n}) // 16 + 1 ELSE 0 END)) AS cell FROM reads))"
PAIR = lambda a: f"(length(w) - length(replace(w, '{a}', ''))) // 2" if a[0] != a[1] else f"(length(w) - length(replace(w, '{a[0]}', '')) - len(regexp_extract_all(w, '{a[0]}+')))"
ONE = lambda a: f"(length(w) - length(replace(w, '{a}', '')))"
D_DIMERS = f"{D_READS}, f AS (SELECT seq_id, cell, [{', '.join(map(PAIR, features.DIMERS))}] AS counts FROM {WIN.format(n=48)})"
define("dimer_features", "seq_id:l cell:l counts:s", f"{D_DIMERS} => SELECT seq_id, cell, array_to_string(counts, ',') AS counts FROM f")(lambda s, d: features.dimer_features(reads(s, d), "read_id").withColumn("counts", F.concat_ws(",", F.col("counts").cast("array<string>"))))
define("monomer_features", "seq_id:l cell:l counts:s", f"{D_READS} => SELECT seq_id, cell, array_to_string([{', '.join(map(ONE, 'ACG'))}], ',') AS counts FROM {WIN.format(n=32)}")(lambda s, d: features.monomer_features(reads(s, d), "read_id").withColumn("counts", F.concat_ws(",", F.col("counts").cast("array<string>"))))
DIST = "list_sum([{}])".format(", ".join(f"abs(a.counts[{i}] - b.counts[{i}])" for i in range(1, 16)))
D_DIST = f"{D_DIMERS}, s AS (SELECT seq_id, cell, counts AS c1, lead(counts, 3) OVER w AS c2, lead(counts, 6) OVER w AS c3, lead(counts, 9) OVER w AS c4 FROM f WINDOW w AS (PARTITION BY seq_id ORDER BY cell)), dist AS (SELECT seq_id, cell, {' + '.join(f'abs(c1[{i}] - c3[{i}]) + abs(c2[{i}] - c4[{i}])' for i in range(1, 16))} AS dist FROM s WHERE c4 IS NOT NULL)"


def distances(s: SparkSession, d: str) -> DataFrame:
    return features.step_distances(features.dimer_features(reads(s, d), "read_id"))


define("window_distance", "seq_id:l cell:l dist:l", f"{D_DIST} => SELECT * FROM dist")(distances)
define("window_reject", "seq_id:l cell:l dist:l", f"{D_DIST} => SELECT * FROM dist WHERE dist < 50")(lambda s, d: distances(s, d).where("dist < 50"))

# scores
REJ = scores.REJECT
D_SCORE = {
    "anchor_score": (scores.anchor_score, f"CASE WHEN dy < 10 THEN {REJ} WHEN da < 10 THEN 100 - sdy ELSE 100 - sdy - sderr END FROM (SELECT *, CASE WHEN e < 5 THEN 4 * e WHEN e < 10 THEN 6 * e - 10 WHEN e < 100 THEN e * e - 5 * e ELSE 1000 END AS sderr, CASE WHEN dy // 15 < 150 THEN (dy // 15) // 5 WHEN dy // 15 < 10000 THEN ((dy // 15) * (dy // 15)) // 200 + 20 ELSE 10000 END AS sdy FROM (SELECT *, abs(dx - dy) AS da, (100 * abs(dx - dy)) // greatest(abs(dx), abs(dy), 50) AS e FROM steps))"),
    "anchor_score_retry": (scores.anchor_score_retry, f"CASE WHEN dy < 5 THEN {REJ} WHEN abs(dx - dy) >= 30 THEN 100 - dy - abs(dx - dy) ELSE 100 - dy END FROM steps"),
    "block_score": (scores.block_score, f"CASE WHEN dx < 0 OR dy < 0 OR NOT same_strand OR dx > 20000 OR dy > 20000 THEN {REJ} WHEN (abs(dx - dy) > 100 OR (100 * abs(dx - dy)) // greatest(dx, dy, 1) > 50) AND dy > dx THEN 70 - dy // 1000 - dx // 100 WHEN abs(dx - dy) > 100 OR (100 * abs(dx - dy)) // greatest(dx, dy, 1) > 50 THEN 70 - dy // 100 - dx // 1000 ELSE 100 - dy // 95 END FROM steps"),
    "gap_anchor_score": (scores.gap_anchor_score, f"CASE WHEN dy < 0 OR NOT same_strand OR (abs(dx) < 8 AND dx <> dy) THEN {REJ} ELSE 100 - (CASE WHEN dy < 100 THEN dy // 4 WHEN dy < 200 THEN dy // 3 - 9 ELSE dy - 145 END) - (CASE WHEN e < 10 THEN 0 WHEN e < 15 THEN 10 + 2 * e ELSE (e * e) // 10 + 40 END) END FROM (SELECT *, (100 * abs(dx - dy)) // greatest(dy, 50) AS e FROM steps)"),
    "gap_anchor_score_2": (scores.gap_anchor_score_2, f"CASE WHEN dy < 0 OR NOT same_strand OR (abs(dy) < 8 AND dx <> dy) THEN {REJ} ELSE 100 - (dy * (dy + 300)) // 300 - (CASE WHEN e < 5 THEN 4 * e WHEN e < 10 THEN 6 * e - 10 ELSE e * e - 5 * e END) END FROM (SELECT *, (100 * abs(dx - dy)) // greatest(dx, dy, 50) AS e FROM steps)"),
    "clip_score": (scores.clip_score, f"CASE WHEN dy <= 0 OR NOT same_strand OR ((abs(dx) < 3 OR abs(dy) < 3) AND dx <> dy) THEN {REJ} ELSE 100 - (CASE WHEN da = 0 THEN 0 WHEN da < 2 THEN 30 + 5 * da WHEN da < 5 THEN 36 + 2 * da ELSE 41 + da END) - (dy * (12 * dy + 650)) // 450 END FROM (SELECT *, abs(dx - dy) AS da FROM steps)"),
}
KIND = "CASE WHEN NOT same_strand THEN 'inv' WHEN dx - dy < -greatest(abs(dx) / 4, 50.0) AND dx > -50 THEN 'ins' WHEN dx - dy < -greatest(abs(dx) / 4, 50.0) THEN 'dup' WHEN dx - dy > greatest(dy / 4, 50.0) THEN 'del' ELSE 'normal' END"
PART = lambda v: f"(CASE WHEN {v} > 300 THEN {v} // 4 - 25 ELSE {v} // 6 END)"
D_SCORE["gap_block_score"] = (scores.gap_block_score, f"CASE WHEN dx < -40 OR dy < -40 THEN {REJ} WHEN kind = 'inv' THEN 80 - {PART('dy')} WHEN kind = 'ins' THEN 80 - {PART('dx')} WHEN kind = 'dup' THEN 40 - {PART('dy')} WHEN kind = 'del' THEN 80 - {PART('dy')} ELSE 100 - {PART('dy')} END FROM (SELECT *, {KIND} AS kind FROM steps)")
D_SCORE["gap_block_score_2"] = (scores.gap_block_score_2, f"CASE WHEN dx < 0 OR dy < 0 THEN {REJ} WHEN NOT same_strand THEN 20 - {PART('dy')} ELSE 100 - (CASE WHEN 100 * (dx - dy) < 15 * greatest(m, 100) THEN (r * (r + 20)) // 40 WHEN 100 * (dx - dy) < 30 * greatest(m, 100) THEN (r * (r + 50)) // 45 ELSE (r * (r + 100)) // 45 END) - (m * (m + 450)) // 2000 END FROM (SELECT *, (100 * abs(dx - dy)) // greatest(dx, dy, 100) AS r, greatest(dx, dy) AS m FROM steps)")
for _name, (_score, _sql) in D_SCORE.items():
    _args = (lambda f: (lambda s, d: steps(s, d).withColumn("score", f(F.col("dx"), F.col("dy"), F.col("same_strand")))) if f.__code__.co_argcount == 3 else (lambda s, d: steps(s, d).withColumn("score", f(F.col("dx"), F.col("dy")))))(_score)
    define(_name, "l_orderkey:l l_linenumber:l score:l", f"{D_STEPS} => SELECT l_orderkey, l_linenumber, " + _sql.replace(" FROM ", " AS score FROM ", 1) if " END FROM " not in _sql else f"{D_STEPS} => SELECT l_orderkey, l_linenumber, " + " END AS score FROM ".join(_sql.split(" END FROM ", 1)))(_args)
define("variant_class", "l_orderkey:l l_linenumber:l kind:s probability:d", f"{D_STEPS}, k AS (SELECT *, {KIND} AS kind FROM steps) => SELECT *, CASE kind WHEN 'inv' THEN 0.5 WHEN 'ins' THEN 0.5 WHEN 'dup' THEN 0.25 WHEN 'del' THEN 0.5 ELSE 1.0 END AS probability FROM k")(
    lambda s, d: steps(s, d).withColumn("kind", scores.variant_class(F.col("dx"), F.col("dy"), F.col("same_strand"))).withColumn("probability", scores.variant_probability(F.col("kind")))
)

# blocks, sweeps, range joins
define("islands_blocks", "user_id:l block_id:l xstart:l xend:l ystart:l yend:l n_anchors:l", f"{D_POINTS}, st AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM points WINDOW w AS (PARTITION BY user_id ORDER BY x, y)), m AS (SELECT *, sum(CASE WHEN dx >= 0 AND dx < 20000 AND dy >= 0 AND dy < 20000 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY x, y ROWS UNBOUNDED PRECEDING) AS block_id FROM st) => SELECT user_id, block_id, min(x) AS xstart, max(x) AS xend, min(y) AS ystart, max(y) AS yend, count(*) AS n_anchors FROM m GROUP BY 1, 2")(lambda s, d: blocks.block_table(points(s, d), ["user_id"], 20_000))
D_UNCOVERED = f"{D_INTERVALS}, custs AS (SELECT c_custkey AS cust, 2600 AS len FROM customer), g AS (SELECT cust, coalesce(max(end_) OVER (PARTITION BY cust ORDER BY start_, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gap_start, start_ AS gap_end FROM intervals UNION ALL SELECT cust, coalesce(last_end, 0), len FROM custs LEFT JOIN (SELECT cust, max(end_) AS last_end FROM intervals GROUP BY 1) USING (cust))"
define("uncovered_gaps", "cust:l gap_start:l gap_end:l", f"{D_UNCOVERED} => SELECT * FROM g WHERE gap_end - gap_start > 30")(lambda s, d: blocks.uncovered(intervals(s, d).select("cust", "start_", "end_"), ["cust"], T(s, d, "customer").select(F.col("c_custkey").alias("cust"), F.lit(2600).cast("long").alias("len")), 30))
D_SWEEP = f"{D_INTERVALS}, ev AS (SELECT cust, p, sum(step) AS step FROM (SELECT cust, start_ AS p, 1 AS step FROM intervals UNION ALL SELECT cust, end_, -1 FROM intervals) GROUP BY 1, 2), cov AS (SELECT * FROM (SELECT cust, p AS start_, lead(p) OVER w AS end_, sum(step) OVER (PARTITION BY cust ORDER BY p ROWS UNBOUNDED PRECEDING) AS coverage FROM ev WINDOW w AS (PARTITION BY cust ORDER BY p)) WHERE end_ IS NOT NULL)"
define("coverage_sweep", "cust:l start_:l end_:l coverage:l", f"{D_SWEEP} => SELECT * FROM cov")(lambda s, d: blocks.coverage_steps(intervals(s, d), ["cust"]))
define("low_coverage", "cust:l start_:l end_:l", f"{D_SWEEP}, low AS (SELECT *, CASE WHEN start_ - lag(end_) OVER (PARTITION BY cust ORDER BY start_) < 20 THEN 0 ELSE 1 END AS fresh FROM cov WHERE coverage < 2), lr AS (SELECT *, sum(fresh) OVER (PARTITION BY cust ORDER BY start_ ROWS UNBOUNDED PRECEDING) AS run FROM low) => SELECT cust, min(start_) AS start_, max(end_) AS end_ FROM lr GROUP BY cust, run HAVING max(end_) - min(start_) > 20")(lambda s, d: blocks.low_coverage(intervals(s, d), ["cust"]))
D_ORDERS = f"{D_INTERVALS}, ord AS (SELECT cust, l_orderkey AS chain_id, min(start_) AS start_, max(end_) AS end_ FROM intervals GROUP BY 1, 2)"


def order_spans(s: SparkSession, d: str) -> DataFrame:
    return intervals(s, d).groupBy("cust", F.col("l_orderkey").alias("chain_id")).agg(F.min("start_").alias("start_"), F.max("end_").alias("end_"))


define("range_overlap_join", "left_id:l overlap:l", f"{D_ORDERS} => SELECT a.chain_id AS left_id, max(least(a.end_, b.end_) - greatest(a.start_, b.start_)) AS overlap FROM ord a JOIN intervals b ON a.cust = b.cust AND a.start_ < b.end_ AND b.start_ < a.end_ GROUP BY 1")(lambda s, d: blocks.largest_overlap(order_spans(s, d).withColumnRenamed("chain_id", "left_id"), intervals(s, d).select("cust", "start_", "end_"), ["cust"], 64))
define("contained_anti_join", "cust:l chain_id:l start_:l end_:l", f"{D_ORDERS} => SELECT * FROM ord a WHERE NOT EXISTS (SELECT 1 FROM ord b WHERE a.cust = b.cust AND a.chain_id <> b.chain_id AND b.start_ <= a.start_ AND a.end_ <= b.end_ AND a.end_ - a.start_ < 0.5 * (b.end_ - b.start_))")(lambda s, d: blocks.not_contained(order_spans(s, d), ["cust"]))
define("split_at_cuts", "cust:l chain_id:l start_:l end_:l", f"{D_ORDERS}, cuts AS (SELECT DISTINCT cust, p FROM (SELECT cust, start_ AS p FROM ord UNION ALL SELECT cust, end_ FROM ord)), own AS (SELECT cust, chain_id, p AS start_, lead(p) OVER (PARTITION BY cust, chain_id ORDER BY p) AS end_ FROM ord JOIN cuts USING (cust) WHERE p BETWEEN ord.start_ AND ord.end_) => SELECT * FROM own WHERE end_ IS NOT NULL")(lambda s, d: blocks.cut_points(order_spans(s, d), ["cust"]))
D_ASOF = f"{D_POINTS}, l AS (SELECT * FROM points WHERE event_type = 'purchase'), r AS (SELECT * FROM points WHERE event_type <> 'purchase')"
define(
    "asof_stick", "user_id:l x:l y:l main_x:l main_y:l",
    f"{D_ASOF}, nearby AS (SELECT l.user_id, l.x, l.y, max_by(struct_pack(x := r.x, y := r.y), struct_pack(x := r.x, y := r.y)) FILTER (WHERE r.x <= l.x) AS last_, min_by(struct_pack(x := r.x, y := r.y), struct_pack(x := r.x, y := r.y)) AS first_ FROM l JOIN r ON l.user_id = r.user_id GROUP BY 1, 2, 3), m AS (SELECT *, coalesce(last_, first_) AS main FROM nearby) => SELECT user_id, x, y, main.x AS main_x, main.y AS main_y FROM m WHERE abs((x - y) - (main.x - main.y)) <= 9000",
)(lambda s, d: anchors.stick_to_chain(points(s, d).where("event_type = 'purchase'"), points(s, d).where("event_type <> 'purchase'"), ["user_id"], 9000))
D_G = f"{D_POINTS}, g AS (SELECT user_id, ord, x // 3600 AS gx, CAST(floor(value) AS BIGINT) AS gy, x, y FROM points)"
gained = lambda s, d: points(s, d).select("user_id", "ord", F.expr("x div 3600").alias("gx"), F.floor("value").alias("gy"), "x", "y")
define(
    "breakpoint_argmax", "user_id:l ord:l score:l",
    f"{D_G}, b AS (SELECT *, lead(gx, 5) OVER w - gx + lead(gy, 5) OVER w - gy AS right_, gx - lag(gx, 5) OVER w + gy - lag(gy, 5) OVER w AS left_ FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ord)) => SELECT user_id, -max(struct_pack(s := right_ - left_, o := -ord)).o AS ord, max(struct_pack(s := right_ - left_, o := -ord)).s AS score FROM b WHERE left_ < 1000 AND right_ > -1000 GROUP BY 1",
)(lambda s, d: blocks.breakpoint(gained(s, d), ["user_id"], 5, 1000, -1000))
define(
    "x_drop", "user_id:l ord:l",
    f"{D_G}, a AS (SELECT *, coalesce(greatest(gx - lag(gx) OVER w, y - lag(y) OVER w), 0) AS gap FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ord)), b AS (SELECT *, CASE WHEN gap > 40 OR sum(gap) OVER (PARTITION BY user_id ORDER BY ord ROWS 4 PRECEDING) > 90 THEN 1 ELSE 0 END AS stop FROM a), c AS (SELECT *, max(stop) OVER (PARTITION BY user_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS stopped FROM b) => SELECT user_id, ord FROM c WHERE stopped = 0",
)(lambda s, d: blocks.x_drop(gained(s, d).select("user_id", "ord", F.col("gx").alias("x"), "y"), ["user_id"], 40, 90))
define("main_strand", "user_id:l strand:l", f"{D_POINTS}, p AS (SELECT user_id, ord, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS strand FROM points) => SELECT user_id, CASE WHEN 2 * sum(strand) > count(*) THEN 1 WHEN 2 * sum(strand) < count(*) THEN 0 ELSE min_by(strand, ord) END AS strand FROM p GROUP BY 1")(
    lambda s, d: blocks.main_strand(points(s, d).select("user_id", "ord", F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("strand")), ["user_id"])
)

# alignments
D_RUNS = f"{D_OPS}, fr AS (SELECT *, CASE WHEN lag(op) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, op, n) = op THEN 0 ELSE 1 END AS fresh FROM ops WHERE n > 0), rn AS (SELECT *, sum(fresh) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, op, n ROWS UNBOUNDED PRECEDING) AS run FROM fr), rl AS (SELECT l_orderkey, run, op, sum(n) AS n FROM rn GROUP BY 1, 2, 3)"
define("cigar_rle", "l_orderkey:l cigar:s", f"{D_RUNS} => SELECT l_orderkey, string_agg(CAST(n AS VARCHAR) || op, '' ORDER BY run) AS cigar FROM rl GROUP BY 1")(lambda s, d: cigars(s, d).select("l_orderkey", S.cigar_text(alignments.merged_runs(F.col("cigar"))).alias("cigar")).where("cigar <> ''"))
define("run_lengths", "l_orderkey:l run:l op:s n:l", f"{D_RUNS} => SELECT * FROM rl")(lambda s, d: alignments.run_lengths(cigars(s, d).select("l_orderkey", F.posexplode("cigar").alias("ord", "e")).select("l_orderkey", "ord", "e.op", "e.n"), ["l_orderkey"]))
define("cigar_lengths", "l_orderkey:l ref_len:l read_len:l", f"{D_OPS} => SELECT l_orderkey, sum(CASE WHEN op IN ('=', 'X', 'D') THEN n ELSE 0 END) AS ref_len, sum(CASE WHEN op IN ('=', 'X', 'I') THEN n ELSE 0 END) AS read_len FROM ops GROUP BY 1")(lambda s, d: cigars(s, d).select("l_orderkey", *[c.alias(n) for c, n in zip(S.cigar_lengths(F.col("cigar")), ("ref_len", "read_len"), strict=True)]))
define("nm_sa_cigar", "l_orderkey:l nm:l sa_cigar:s", f"{D_OPS}, t AS (SELECT l_orderkey, sum(CASE WHEN op IN ('X', 'I', 'D') THEN n ELSE 0 END) AS nm, sum(CASE WHEN op IN ('=', 'X') THEN n ELSE 0 END) AS m, sum(CASE WHEN op = 'D' THEN n WHEN op = 'I' THEN -n ELSE 0 END) AS net FROM ops GROUP BY 1) => SELECT l_orderkey, nm, CASE WHEN m > 0 THEN CAST(m AS VARCHAR) || 'M' ELSE '' END || CASE WHEN net > 0 THEN CAST(net AS VARCHAR) || 'D' WHEN net < 0 THEN CAST(-net AS VARCHAR) || 'I' ELSE '' END AS sa_cigar FROM t")(lambda s, d: cigars(s, d).select("l_orderkey", alignments.edit_count(F.col("cigar")).alias("nm"), alignments.short_cigar(F.col("cigar")).alias("sa_cigar")))
define("cigar_pair", "l_orderkey:l l_linenumber:l op1:s n1:l op2:s n2:l", f"{D_STEPS} => SELECT l_orderkey, l_linenumber, 'X' AS op1, least(dx, dy) AS n1, CASE WHEN dx - dy >= 0 THEN 'D' ELSE 'I' END AS op2, abs(dx - dy) AS n2 FROM steps")(lambda s, d: steps(s, d).withColumn("p", alignments.pair_operations(F.col("dx"), F.col("dy"), "X")).select("l_orderkey", "l_linenumber", *[F.col("p")[i][f].alias(f"{n}{i + 1}") for i in (0, 1) for f, n in (("op", "op"), ("n", "n"))]))


def cords(s: SparkSession, d: str) -> DataFrame:
    """Cords of the kept anchors: windows of 21 bases, in order of genome, strand and place."""
    by = Window.partitionBy("read_id").orderBy("gid", "strand", "x", "y")
    return kept(s, d).select("read_id", F.row_number().over(by).alias("ord"), (F.col("gid") * 2 + F.col("strand")).alias("block_id"), "gid", "strand", F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 21).alias("x2"), (F.col("y") + 21).alias("y2"))


D_CORDS = f"{D_BINNED}, cords AS (SELECT read_id, row_number() OVER (PARTITION BY read_id ORDER BY gid, strand, x, y) AS ord, gid * 2 + strand AS block_id, gid, strand, x AS x1, y AS y1, x + 21 AS x2, y + 21 AS y2 FROM kept)"
D_LINES = f"{D_CORDS}, nl AS (SELECT *, CASE WHEN lag(ord) OVER w IS NULL OR lag(block_id) OVER w <> block_id OR x1 < lag(x1) OVER w OR y1 < lag(y1) OVER w OR (x1 - lag(x2) OVER w > 8000 AND y1 - lag(y2) OVER w > 8000) OR lag(strand) OVER w <> strand OR lag(gid) OVER w <> gid THEN 1 ELSE 0 END AS fresh FROM cords WINDOW w AS (PARTITION BY read_id ORDER BY ord)), lines AS (SELECT *, sum(fresh) OVER (PARTITION BY read_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS line_id FROM nl)"
define("sam_line_split", "read_id:l ord:l line_id:l flag:l", f"{D_LINES} => SELECT read_id, ord, line_id, CASE WHEN line_id > 1 THEN 2048 ELSE 0 END + CASE WHEN strand = 1 THEN 16 ELSE 0 END AS flag FROM lines")(lambda s, d: alignments.line_ids(cords(s, d)).withColumn("flag", alignments.sam_flag(F.col("line_id"), F.col("strand"))))
define("apf_rows", "read_id:l block_id:l ord:l y:l x:l dy:l dx:l strand:l", f"{D_CORDS} => SELECT read_id, block_id, ord, y1 AS y, x1 AS x, coalesce(y1 - lag(y1) OVER w, 0) AS dy, coalesce(x1 - lag(x1) OVER w, 0) AS dx, strand FROM cords WINDOW w AS (PARTITION BY read_id, block_id ORDER BY ord)")(lambda s, d: alignments.apf_rows(cords(s, d)))
D_VALIGN = f"""{D_LINES}, nx AS (SELECT *, lead(x1) OVER w AS nx, lead(y1) OVER w AS ny FROM lines WINDOW w AS (PARTITION BY read_id, line_id ORDER BY ord)),
q AS (SELECT *, CASE WHEN nx IS NULL THEN x2 - x1 ELSE least(x2, nx) - x1 END AS ix, CASE WHEN nx IS NULL THEN y2 - y1 ELSE least(y2, ny) - y1 END AS iy, greatest(coalesce(nx, x2) - x2, 0) AS bx, greatest(coalesce(ny, y2) - y2, 0) AS by_ FROM nx),
line AS (SELECT read_id, line_id, min(gid) AS gid, min(strand) AS strand, min(x1) AS x1, min(y1) AS y1, max(y2) AS y2 FROM lines GROUP BY 1, 2),
vo AS (SELECT read_id, line_id, 0 AS k, 'S' AS op, y1 AS n FROM line UNION ALL SELECT read_id, line_id, ord * 4, '=', least(ix, iy) FROM q UNION ALL SELECT read_id, line_id, ord * 4 + 1, CASE WHEN ix >= iy THEN 'D' ELSE 'I' END, abs(ix - iy) FROM q UNION ALL SELECT read_id, line_id, ord * 4 + 2, 'X', least(bx, by_) FROM q UNION ALL SELECT read_id, line_id, ord * 4 + 3, CASE WHEN bx >= by_ THEN 'D' ELSE 'I' END, abs(bx - by_) FROM q UNION ALL SELECT read_id, line_id, 1000000000, 'S', length(seq) - y2 FROM line JOIN reads USING (read_id)),
vf AS (SELECT *, CASE WHEN lag(op) OVER (PARTITION BY read_id, line_id ORDER BY k) = op THEN 0 ELSE 1 END AS fresh FROM vo WHERE n > 0),
vr AS (SELECT *, sum(fresh) OVER (PARTITION BY read_id, line_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM vf),
vs AS (SELECT read_id, line_id, run, op, sum(n) AS n FROM vr GROUP BY 1, 2, 3, 4),
vc AS (SELECT read_id, line_id, string_agg(CAST(n AS VARCHAR) || op, '' ORDER BY run) AS cigar FROM vs GROUP BY 1, 2),
va AS (SELECT read_id, line_id, gid, CASE WHEN line_id > 1 THEN 2048 ELSE 0 END + CASE WHEN strand = 1 THEN 16 ELSE 0 END AS flag, x1 + 1 AS pos, cigar FROM line JOIN vc USING (read_id, line_id))"""
define("virtual_alignment", "read_id:l line_id:l gid:l flag:l pos:l cigar:s", f"{D_VALIGN} => SELECT * FROM va")(lambda s, d: alignments.virtual_alignments(cords(s, d), reads(s, d)).withColumn("cigar", S.cigar_text(F.col("cigar"))))
define("sa_tag", "read_id:l line_id:l sa:s", f"""{D_VALIGN},
ct AS (SELECT read_id, line_id, coalesce(sum(n) FILTER (WHERE op = 'S' AND run = 1), 0) AS s1, coalesce(sum(n) FILTER (WHERE op = 'S' AND run > 1), 0) AS s2, coalesce(sum(n) FILTER (WHERE op IN ('=', 'X')), 0) AS m, coalesce(sum(CASE WHEN op = 'D' THEN n WHEN op = 'I' THEN -n ELSE 0 END), 0) AS net, coalesce(sum(n) FILTER (WHERE op IN ('X', 'I', 'D')), 0) AS nm FROM vs GROUP BY 1, 2),
one AS (SELECT read_id, line_id, 'chr' || gid || ',' || pos || ',' || CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END || ',' || CASE WHEN s1 > 0 THEN CAST(s1 AS VARCHAR) || 'S' ELSE '' END || CASE WHEN m > 0 THEN CAST(m AS VARCHAR) || 'M' ELSE '' END || CASE WHEN net > 0 THEN CAST(net AS VARCHAR) || 'D' WHEN net < 0 THEN CAST(-net AS VARCHAR) || 'I' ELSE '' END || CASE WHEN s2 > 0 THEN CAST(s2 AS VARCHAR) || 'S' ELSE '' END || ',255,' || CAST(nm AS VARCHAR) || ';' AS sa FROM va JOIN ct USING (read_id, line_id))
=> SELECT a.read_id, a.line_id, coalesce(string_agg(b.sa, '' ORDER BY b.line_id), '') AS sa FROM one a LEFT JOIN one b ON a.read_id = b.read_id AND a.line_id <> b.line_id GROUP BY 1, 2""")(lambda s, d: alignments.supplementary_tags(alignments.virtual_alignments(cords(s, d), reads(s, d)), genomes(s, d)))
define("genome_header", "gid:l line:s", f"{D_GENOMES} => SELECT gid, '@SQ' || chr(9) || 'SN:' || name || chr(9) || 'LN:' || length(seq) AS line FROM genomes")(lambda s, d: genomes(s, d).select("gid", F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.length("seq").cast("string")).alias("line")))
define("file_prefix", "page_id:l prefix:s", "SELECT page_id, split_part(split_part(url, '/', -1), '.', 1) AS prefix FROM pages")(lambda s, d: T(s, d, "pages").select("page_id", formats.file_prefix(F.col("url")).alias("prefix")))

# library operators
define("d2_similarity", "left_id:l right_id:l d2:l", f"{D_GENOMES}, c AS (SELECT seq_id, kmer, count(*) AS n FROM {d_kmers('genomes', 'gid', 5)} GROUP BY 1, 2) => SELECT a.seq_id AS left_id, b.seq_id AS right_id, sum(a.n * b.n) AS d2 FROM c a JOIN c b USING (kmer) GROUP BY 1, 2")(lambda s, d: composition.d2(genomes(s, d).withColumnRenamed("gid", "left_id"), genomes(s, d).withColumnRenamed("gid", "right_id"), 5))
define("d2_cosine", "left_id:l right_id:l d2z:d", f"{D_GENOMES}, c AS (SELECT seq_id, kmer, count(*) AS n FROM {d_kmers('genomes', 'gid', 5)} GROUP BY 1, 2), nn AS (SELECT seq_id, sqrt(sum(n * n)) AS nn FROM c GROUP BY 1), dd AS (SELECT a.seq_id AS left_id, b.seq_id AS right_id, sum(a.n * b.n) AS d2 FROM c a JOIN c b USING (kmer) GROUP BY 1, 2) => SELECT left_id, right_id, round(d2 / (x.nn * y.nn), 9) AS d2z FROM dd JOIN nn x ON x.seq_id = left_id JOIN nn y ON y.seq_id = right_id")(lambda s, d: composition.centred_d2(genomes(s, d).withColumnRenamed("gid", "left_id"), genomes(s, d).withColumnRenamed("gid", "right_id"), 5).withColumn("d2z", F.round("d2z", 9)))
define("bin_filter_counts", "query_id:l bin_id:l n:l", f"{D_READS}, {D_GENOMES} => SELECT q.seq_id AS query_id, b.seq_id AS bin_id, count(*) AS n FROM (SELECT DISTINCT seq_id, kmer FROM {d_kmers('reads', 'read_id', 11)}) q JOIN (SELECT DISTINCT seq_id, kmer FROM {d_kmers('genomes', 'gid', 11)}) b USING (kmer) GROUP BY 1, 2 HAVING count(*) >= 8")(lambda s, d: composition.bin_counts(genomes(s, d).withColumnRenamed("gid", "bin_id"), reads(s, d).withColumnRenamed("read_id", "query_id"), 11, 8))
define("gapped_qgrams", "gram:s n:l", f"{D_GENOMES} => SELECT substr(kmer, 1, 2) || substr(kmer, 4, 1) || substr(kmer, 6, 2) AS gram, count(*) AS n FROM {d_kmers('genomes', 'gid', 7)} GROUP BY 1")(lambda s, d: composition.gapped_qgrams(genomes(s, d), "gid", "1101011").groupBy("gram").agg(F.count("*").alias("n")))
define("markov_model", "state:s next:s n:l p:d", f"{D_READS}, t AS (SELECT substr(kmer, 1, 2) AS state, substr(kmer, 3, 1) AS next, count(*) AS n FROM {d_kmers('reads', 'read_id', 3)} GROUP BY 1, 2) => SELECT state, next, n, round(n / sum(n) OVER (PARTITION BY state), 9) AS p FROM t")(lambda s, d: composition.markov_transitions(reads(s, d), "read_id", 2).withColumn("p", F.round("p", 9)))
define("word_zscores", "kmer:s n:l expected:d z:d", f"{D_GENOMES}, b AS (SELECT kmer AS base, count(*) AS m FROM {d_kmers('genomes', 'gid', 1)} GROUP BY 1), p AS (SELECT base, m / sum(m) OVER () AS p FROM b), c AS (SELECT kmer, count(*) AS n FROM {d_kmers('genomes', 'gid', 3)} GROUP BY 1), e AS (SELECT kmer, n, x.p * y.p * z.p AS p, sum(n) OVER () AS total FROM c JOIN p x ON x.base = substr(kmer, 1, 1) JOIN p y ON y.base = substr(kmer, 2, 1) JOIN p z ON z.base = substr(kmer, 3, 1)) => SELECT kmer, n, round(total * p, 6) AS expected, round((n - total * p) / sqrt(total * p * (1 - p)), 6) AS z FROM e")(lambda s, d: composition.word_zscores(genomes(s, d), "gid", 3).withColumns({"expected": F.round("expected", 6), "z": F.round("z", 6)}))
define("pile_up", "gid:s pos:l base:s depth:l share:d", f"p AS (SELECT lang AS gid, pos, kmer AS base FROM documents JOIN {d_kmers(f'(SELECT doc_id, {DNA} AS seq FROM documents)', 'doc_id', 1)} ON seq_id = doc_id), c AS (SELECT gid, pos, base, count(*) AS n FROM p GROUP BY 1, 2, 3), r AS (SELECT *, sum(n) OVER (PARTITION BY gid, pos) AS depth, row_number() OVER (PARTITION BY gid, pos ORDER BY n DESC, base) AS k FROM c) => SELECT gid, pos, base, depth, round(n / depth, 9) AS share FROM r WHERE k = 1")(
    lambda s, d: composition.pile_up(seeds.kmer_rows(T(s, d, "documents").select(F.struct("doc_id", "lang").alias("id"), S.dna(F.col("text")).alias("seq")), "id", 1).select(F.col("seq_id.lang").alias("gid"), "pos", F.col("kmer").alias("base"))).withColumn("share", F.round("share", 9))
)
define("exact_find", "pattern_id:l seq_id:l pos:l", f"{D_READS}, {D_GENOMES} => SELECT gid AS pattern_id, seq_id, pos FROM {d_kmers('reads', 'read_id', 24)} JOIN genomes ON kmer = substr(seq, 1, 24)")(lambda s, d: composition.exact_matches(reads(s, d), "read_id", genomes(s, d).select(F.col("gid").alias("pattern_id"), F.substr("seq", F.lit(1), F.lit(24)).alias("pattern")), 24))
define("hamming_find", "pattern_id:l seq_id:l pos:l distance:l", f"{D_READS}, {D_GENOMES} => SELECT gid AS pattern_id, seq_id, pos, hamming(kmer, substr(seq, 1, 24)) AS distance FROM {d_kmers('genomes', 'gid', 24)} JOIN genomes ON hamming(kmer, substr(seq, 1, 24)) <= 3")(lambda s, d: composition.hamming_matches(genomes(s, d), "gid", genomes(s, d).select(F.col("gid").alias("pattern_id"), F.substr("seq", F.lit(1), F.lit(24)).alias("pattern")), 24, 3))
# The same operators over whole sequences, without SQL twins (too slow there); the tests hold them against brute force.
define("edit_and_hamming_texts", "doc_id:l edit:l hamming:l")(lambda s, d: whole_text_distances(reads(s, d)))
define("exact_find_windows", "pattern_id:l start:l seq_id:l pos:l")(lambda s, d: composition.exact_matches(reads(s, d), "read_id", seeds.kmer_rows(genomes(s, d), "gid", 24).select(F.struct(F.col("seq_id").alias("gid"), F.col("pos").alias("start")).alias("pattern_id"), F.col("kmer").alias("pattern")), 24).select("pattern_id.gid", "pattern_id.start", "seq_id", "pos").withColumnRenamed("gid", "pattern_id"))
define("hamming_find_windows", "pattern_id:l start:l seq_id:l pos:l distance:l")(lambda s, d: composition.hamming_windows(reads(s, d), "read_id", genomes(s, d).select(F.col("gid").alias("pattern_id"), "seq")))
define("repeat_words", "seq_id:l kmer:s n:l", f"{D_READS} => SELECT seq_id, kmer, count(*) AS n FROM {d_kmers('reads', 'read_id', 24)} GROUP BY 1, 2 HAVING count(*) >= 2")(lambda s, d: composition.repeats(reads(s, d), "read_id", 24))
define("genomic_region", "p_partkey:l chrom:s start:l end:l", "SELECT p_partkey, p_brand AS chrom, p_size * 1000 - 1 AS start, p_size * 1000 + 500 AS \"end\" FROM part".replace('"end"', "end_").replace("end_", '"end"'))(lambda s, d: T(s, d, "part").select("p_partkey", *formats.genomic_region(F.concat("p_brand", F.lit(":"), (F.col("p_size") * 1000).cast("string"), F.lit("-"), (F.col("p_size") * 1000 + 500).cast("string")))))
ORACLES["genomic_region"] = 'SELECT p_partkey, p_brand AS chrom, CAST(p_size * 1000 - 1 AS BIGINT) AS start, CAST(p_size * 1000 + 500 AS BIGINT) AS "end" FROM part'
define("normal_cdf", "p_partkey:l p:d", "z AS (SELECT p_partkey, (p_retailprice - 1000) / (300 * sqrt(2.0)) AS z FROM part), t AS (SELECT *, 1 / (1 + 0.3275911 * abs(z)) AS t FROM z) => SELECT p_partkey, round((1 + sign(z) * (1 - (((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t) * exp(-z * z))) / 2, 6) AS p FROM t")(lambda s, d: T(s, d, "part").select("p_partkey", F.round(S.normal_cdf(F.col("p_retailprice"), 1000.0, 300.0), 6).alias("p")))

# event time
define("event_sessions", "user_id:l start_:l end_:l n:l", "s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM s) => SELECT user_id, epoch_us(min(ts)) AS start_, epoch_us(max(ts)) + 1800000000 AS end_, count(*) AS n FROM r GROUP BY user_id, run")(lambda s, d: runs.event_sessions(T(s, d, "events")).select("user_id", F.unix_micros("start_").alias("start_"), F.unix_micros("end_").alias("end_"), "n"))
define("event_windows", "event_type:s start_:l n:l total:d", "SELECT event_type, epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")(lambda s, d: runs.event_windows(T(s, d, "events")).select("event_type", F.unix_micros("start_").alias("start_"), "n", F.round("total", 4).alias("total")))

# ordered folds: no SQL form; the tests hold them against plain loops
define("chain_dp", "read_id:l gid:l strand:l chain_id:l chain_score:l chain_ord:l x:l y:l")(lambda s, d: chains.chain_anchors(kept(s, d), ChainParams()))
define("major_chains", "read_id:l gid:l strand:l chain_id:l chain_score:l n:l xstart:l xend:l ystart:l yend:l rank:l")(lambda s, d: chains.major_chains(chains.chain_anchors(kept(s, d))))
define("median_islands", "read_id:l gid:l strand:l x:l y:l island:l")(lambda s, d: chains.islands_by_median(found(s, d)))
define("cord_repair", "read_id:l ord:l x1:l y1:l x2:l y2:l")(lambda s, d: chains.repaired(cords(s, d)))
define("sam_records", "read_id:l line_id:l value:s")(lambda s, d: alignments.sam_text(mapping.map_reads(reads(s, d), genomes(s, d), EngineParams(bins=BinParams(least=LEAST))).lines, reads(s, d)))
define("banded_alignment", "pair_id:l score:l")(lambda s, d: composition.alignment_scores(genomes(s, d).select(F.col("gid").alias("pair_id"), F.col("seq").alias("a"), S.reverse_complement(F.col("seq")).alias("b"))))

# other indexes
from strandloom.config import IndexParams  # noqa: E402
from strandloom.operators import gaps  # noqa: E402

define("index_span_21_cap_200", "gid:l x:l strand:l minimizer:s ext:l", f"{D_GENOMES}, s AS (SELECT *, lag(minimizer) OVER w AS lm, lag(pos) OVER w AS lp FROM {d_seeds('genomes', 'gid', 8)} WINDOW w AS (PARTITION BY seq_id ORDER BY pos)), n AS (SELECT * FROM s WHERE lm IS NULL OR lm <> minimizer OR pos - lp > 10) => SELECT seq_id AS gid, pos AS x, strand, minimizer, ext FROM n WHERE minimizer IN (SELECT minimizer FROM n GROUP BY 1 HAVING count(*) <= 200)")(
    lambda s, d: shown(seeds.genome_index(genomes(s, d), IndexParams(step=8, cap=200)))
)
define("index_span_17_cap_1024", "gid:l x:l strand:l minimizer:s ext:l")(lambda s, d: seeds.genome_index(genomes(s, d), IndexParams(span=17, weight=9, step=8, cap=1024)))


def mapped(s: SparkSession, d: str) -> DataFrame:
    return mapping.anchor_blocks(reads(s, d), genomes(s, d), EngineParams(bins=BinParams(least=LEAST)))


D_GAPS = f"""{D_BLOCKS}, gm AS (SELECT b.*, length(seq) AS len, lag(xend) OVER w AS px, lag(yend) OVER w AS py, lead(ystart) OVER w AS ny FROM blocks b JOIN reads USING (read_id) WINDOW w AS (PARTITION BY read_id, gid, strand ORDER BY ystart, xstart, yend, xend)),
gb AS (SELECT *, least(ystart, xstart, 2000) AS h, least(len - yend, 2000) AS t FROM gm),
gaps AS (SELECT read_id, gid, strand, 'head' AS kind, xstart - h AS x_lo, xstart AS x_hi, ystart - h AS y_lo, ystart AS y_hi FROM gb WHERE py IS NULL AND h > 50
UNION ALL SELECT read_id, gid, strand, 'inner', px, xstart, py, ystart FROM gb WHERE abs(xstart - px) < 3000 AND xstart >= px AND ystart >= py AND greatest(xstart - px, ystart - py) > 50
UNION ALL SELECT read_id, gid, strand, 'tail', xend, xend + t, yend, yend + t FROM gb WHERE ny IS NULL AND t > 50)"""
define("gap_table", "read_id:l gid:l strand:l kind:s x_lo:l x_hi:l y_lo:l y_hi:l", f"{D_GAPS} => SELECT * FROM gaps")(lambda s, d: gaps.gap_table(mapped(s, d), reads(s, d)))
define(
    "gap_range_join", "read_id:l gid:l strand:l kind:s x:l y:l",
    f"""{D_GAPS}, cutg AS (SELECT g.*, CASE WHEN strand = 0 THEN r.seq ELSE {RC.format('r.seq')} END AS rs, o.seq AS gs FROM gaps g JOIN reads r USING (read_id) JOIN genomes o USING (gid)),
lw AS (SELECT *, substr(gs, p + 1, 9) AS kmer FROM (SELECT *, unnest(range(x_lo, least(x_hi, length(gs)) - 8, 5)) AS p FROM cutg)), rw AS (SELECT *, substr(rs, q + 1, 9) AS kmer FROM (SELECT *, unnest(range(y_lo, least(y_hi, length(rs)) - 8)) AS q FROM cutg))
=> SELECT l.read_id, l.gid, l.strand, l.kind, p AS x, q AS y FROM lw l JOIN rw r ON l.read_id = r.read_id AND l.gid = r.gid AND l.strand = r.strand AND l.kind = r.kind AND l.x_lo = r.x_lo AND l.y_lo = r.y_lo AND l.kmer = r.kmer WHERE p - q BETWEEN least(l.x_lo - l.y_lo, l.x_hi - l.y_hi) - 50 AND greatest(l.x_lo - l.y_lo, l.x_hi - l.y_hi) + 50""",
)(lambda s, d: gaps.gap_anchors(gaps.gap_table(mapped(s, d), reads(s, d)), reads(s, d), genomes(s, d)))
define("gap_remap", "read_id:l gid:l strand:l ord:l x:l y:l from_gap:b")(lambda s, d: gaps.remapped(mapped(s, d), kept(s, d), reads(s, d), genomes(s, d)))
D_GL = f"{D_G}, sg AS (SELECT *, coalesce(greatest(x - lag(x) OVER w - 3600, 0), 0) AS sx, coalesce(greatest(y - lag(y) OVER w - 3600, 0), 0) AS sy FROM g WINDOW w AS (PARTITION BY user_id ORDER BY ord))"
define("gap_lengths", "user_id:l ord:l lx:l ly:l", f"{D_GL} => SELECT user_id, ord, sum(sx) OVER v AS lx, sum(sy) OVER v AS ly FROM sg WINDOW v AS (PARTITION BY user_id ORDER BY ord ROWS UNBOUNDED PRECEDING)")(lambda s, d: gaps.gap_lengths(points(s, d), ["user_id"], 3600).withColumnsRenamed({"gx": "lx", "gy": "ly"}))
D_CUT = f"{D_POINTS}, h AS (SELECT user_id, ord, x // 3600 AS main, CAST(floor(value) AS BIGINT) AS cost, event_type FROM points)"
halves = lambda s, d: points(s, d).select("user_id", "ord", F.expr("x div 3600").alias("main"), F.floor("value").alias("cost"), "event_type")
define("breakpoint_cut", "user_id:l ord_1:l ord_2:l cost:l", f"{D_CUT}, p AS (SELECT a.user_id, struct_pack(cost := a.cost + b.cost + b.main - a.main, ord_1 := a.ord, ord_2 := b.ord) AS m FROM h a JOIN h b ON a.user_id = b.user_id AND b.main - a.main BETWEEN 0 AND 30 WHERE a.event_type = 'purchase' AND b.event_type <> 'purchase') => SELECT user_id, min(m).ord_1 AS ord_1, min(m).ord_2 AS ord_2, min(m).cost AS cost FROM p GROUP BY 1")(lambda s, d: gaps.best_cut(halves(s, d).where("event_type = 'purchase'"), halves(s, d).where("event_type <> 'purchase'"), ["user_id"]))
define("extension_filter", "user_id:l ord:l", f"{D_POINTS}, f AS (SELECT *, CASE WHEN abs(x - lag(x) OVER w) > 90000 OR abs(y - lag(y) OVER w) > 90000 THEN 1 ELSE 0 END AS far FROM points WINDOW w AS (PARTITION BY user_id ORDER BY ord)), s AS (SELECT *, max(far) OVER (PARTITION BY user_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS stop FROM f) => SELECT user_id, ord FROM s WHERE stop = 0")(lambda s, d: gaps.until_far(points(s, d), ["user_id"], 90_000))
define("gap_group_filter", "cust:l left_id:l n:l", f"{D_INTERVALS}, sz AS (SELECT cust, l_orderkey, count(*) AS n FROM intervals GROUP BY 1, 2), st AS (SELECT cust, median(n) AS mid, count(*) AS groups FROM sz GROUP BY 1) => SELECT i.cust, i.left_id, sz.n FROM intervals i JOIN sz USING (cust, l_orderkey) JOIN st ON st.cust = i.cust WHERE groups <= 3 OR n >= mid")(lambda s, d: gaps.large_groups(intervals(s, d), ["cust"], "l_orderkey", 3))
D_CH = f"{D_ORDERS}, ch AS (SELECT cust, chain_id, start_ AS xstart, end_ AS xend, chain_id % 1000 AS ystart, chain_id % 1000 + (end_ - start_) AS yend, end_ - start_ AS n, 100 AS len FROM ord)"
spans = lambda s, d: order_spans(s, d).select("cust", "chain_id", F.col("start_").alias("xstart"), F.col("end_").alias("xend"), (F.col("chain_id") % 1000).alias("ystart"), (F.col("chain_id") % 1000 + F.col("end_") - F.col("start_")).alias("yend"), (F.col("end_") - F.col("start_")).alias("n"), F.lit(100).alias("len"), (F.col("chain_id") % 2).alias("strand"))
define("beside_major_chain", "cust:l chain_id:l n:l", f"{D_CH}, tm AS (SELECT *, row_number() OVER w AS rank, first(xstart) OVER w AS mxs, first(xend) OVER w AS mxe, first(ystart) OVER w AS mys, first(yend) OVER w AS mye FROM ch WINDOW w AS (PARTITION BY cust ORDER BY n DESC, chain_id)) => SELECT cust, chain_id, n FROM tm WHERE rank = 1 OR (xstart <= mxe + 200 AND xend >= mxs - 200 AND (ystart > mye OR yend < mys))")(lambda s, d: gaps.beside_major(spans(s, d), ["cust"], "len"))
define("best_strand", "cust:l strand:l total:l", f"{D_CH}, sm AS (SELECT cust, chain_id % 2 AS strand, sum(yend - ystart) AS total FROM ch GROUP BY 1, 2) => SELECT cust, -max(struct_pack(t := total, s := -strand)).s AS strand, max(total) AS total FROM sm GROUP BY 1")(lambda s, d: gaps.best_strand(spans(s, d), ["cust"]))
define("hit_list", "cust:l group_id:l n:l rank:l", f"{D_CH}, rk AS (SELECT cust, chain_id AS group_id, n, row_number() OVER (PARTITION BY cust ORDER BY n DESC, chain_id) AS rank, max(n) OVER (PARTITION BY cust) AS top FROM ch) => SELECT * FROM rk WHERE rank <= 10 AND n >= 0.1 * top")(lambda s, d: gaps.hit_list(spans(s, d).withColumnRenamed("chain_id", "group_id"), ["cust"]))
define("block_scores", "user_id:l drift:d mapped:l", f"{D_POINTS}, st AS (SELECT user_id, abs((x - y) - lag(x - y) OVER w) AS dd, y - lag(y) OVER w AS dy FROM points WINDOW w AS (PARTITION BY user_id ORDER BY ord)) => SELECT user_id, round(avg(dd), 6) AS drift, coalesce(sum(dy) FILTER (WHERE dy >= 0 AND dy < 400), 0) AS mapped FROM st GROUP BY 1")(lambda s, d: gaps.block_scores(points(s, d), ["user_id"]))
define("paf_rows", "read_id:l block_id:l rname:s rlen:l ystart:l yend:l sign:s gname:s glen:l xstart:l xend:l windows:l", f"{D_CORDS} => SELECT c.read_id, block_id, r.name AS rname, length(r.seq) AS rlen, min(y1) AS ystart, max(y2) AS yend, CASE WHEN strand = 1 THEN '-' ELSE '+' END AS sign, g.name AS gname, length(g.seq) AS glen, min(x1) AS xstart, max(x2) AS xend, count(*) AS windows FROM cords c JOIN reads r USING (read_id) JOIN genomes g USING (gid) GROUP BY c.read_id, block_id, r.name, r.seq, strand, g.name, g.seq")(lambda s, d: gaps.paf_rows(cords(s, d), reads(s, d), genomes(s, d)))
define("cigar_error_share", "l_orderkey:l share:d", f"{D_OPS} => SELECT l_orderkey, round(sum(CASE WHEN op = 'X' OR op IN ('I', 'D') THEN n ELSE 0 END) / greatest(sum(n), 1), 6) AS share FROM ops GROUP BY 1")(lambda s, d: cigars(s, d).select("l_orderkey", gaps.error_shares(F.col("cigar")).alias("share")))
define("window_extend", "start_id:l ord:l x:l y:l")(
    lambda s, d: gaps.extended(genomes(s, d).select(F.col("gid").alias("start_id"), F.lit(0).alias("x"), F.lit(0).alias("y"), F.col("seq").alias("genome"), F.col("seq").alias("read")))
)

# alignment checks and small predicates
from strandloom.operators import exact  # noqa: E402

define("exact_alignment", "pair_id:l score:l cigar:s sound:b")(
    lambda s, d: exact.aligned(genomes(s, d).select(F.col("gid").alias("pair_id"), F.col("seq").alias("a"), S.homopolymer_compressed(F.col("seq")).alias("b"))).select(
        "pair_id", "score", S.cigar_text(F.col("cigar")).alias("cigar"), exact.sound(F.col("score"), F.col("cigar")).alias("sound")
    )
)
define("colinear_steps", "l_orderkey:l l_linenumber:l colinear:b", f"{D_STEPS} => SELECT l_orderkey, l_linenumber, dx >= 0 AND dy >= 0 AND abs(dx - dy) < 50 AS colinear FROM steps")(lambda s, d: steps(s, d).withColumn("colinear", exact.colinear(F.col("dx"), F.col("dy"))))
define("band_areas", "l_orderkey:l area:l", "SELECT l_orderkey, sum((2 * l_linenumber + 1) * CAST(floor(l_quantity) AS BIGINT)) AS area FROM lineitem GROUP BY 1")(lambda s, d: exact.band_areas(T(s, d, "lineitem").select("l_orderkey", F.floor("l_quantity").alias("len"), F.col("l_linenumber").alias("width")), ["l_orderkey"]))
define("diagonal_tiles", "user_id:l ord:l", f"{D_G}, bs AS (SELECT *, first(gx - gy) OVER (PARTITION BY user_id ORDER BY ord) AS base FROM g) => SELECT user_id, ord FROM bs WHERE abs(gx - gy - base) <= 80")(lambda s, d: exact.off_diagonal(gained(s, d).select("user_id", "ord", F.col("gx").alias("x"), F.col("gy").alias("y")), ["user_id"]))
define("probable_score", "l_orderkey:l l_linenumber:l score:d", f"{D_STEPS}, k AS (SELECT *, {KIND} AS kind, (abs(dx - dy) - 1000.0) / (1000 * sqrt(2.0)) AS z FROM steps), t AS (SELECT *, 1 / (1 + 0.3275911 * abs(z)) AS t FROM k), c AS (SELECT *, (1 + sign(z) * (1 - (((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t) * exp(-z * z))) / 2 AS cdf FROM t) => SELECT l_orderkey, l_linenumber, round(100 * (CASE kind WHEN 'inv' THEN 0.5 WHEN 'ins' THEN 0.5 WHEN 'dup' THEN 0.25 WHEN 'del' THEN 0.5 ELSE 1.0 END) * (1 - cdf), 4) AS score FROM c")(
    lambda s, d: steps(s, d).withColumn("score", exact.probable_score(scores.variant_class(F.col("dx"), F.col("dy"), F.col("same_strand")), F.abs(F.col("dx") - F.col("dy"))))
)
define("small_indels", "l_orderkey:l cigar:s")(lambda s, d: cigars(s, d).select("l_orderkey", S.cigar_text(exact.without_small_indels(F.col("cigar"))).alias("cigar")))
