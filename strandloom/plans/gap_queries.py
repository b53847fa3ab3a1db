"""Queries of relations between cords, blocks and chains over the driver's tables; see `queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.operators import alignments, blocks, composition, relations, scores, seeds
from strandloom.plans.queries import D_GENOMES, D_INDEX, D_INTERVALS, D_POINTS, D_READS, D_STEPS, DNA, T, d_kmers, define, genomes, index, intervals, points, reads, steps

INSIDE = "{0} > -100 AND {0} < 10000"


@define("cord_relations", "l_orderkey:l l_linenumber:l chainable:b overlapping:b gap_before:b off_up:b off_down:b", f"""{D_STEPS} => SELECT l_orderkey, l_linenumber,
({INSIDE.format('dx')}) AND CASE WHEN same_strand THEN ({INSIDE.format('dy')}) ELSE ({INSIDE.format('(dy - 400)')}) OR ({INSIDE.format('(300 - dy)')}) END AS chainable,
same_strand AND abs(dx) < 96 AND abs(dy) < 96 AS overlapping, dx >= 96 AS gap_before,
abs(dy - dx) > floor(greatest(abs(dx), abs(dy), 30) * CAST(0.2 AS DOUBLE)) AND dy - dx >= 0 AS off_up, abs(dy - dx) > floor(greatest(abs(dx), abs(dy), 30) * CAST(0.2 AS DOUBLE)) AND dy + dx >= 0 AS off_down FROM steps""")
def cord_relations(spark: SparkSession, sf: str) -> DataFrame:
    dx, dy, same = F.col("dx"), F.col("dy"), F.col("same_strand")
    return steps(spark, sf).select(
        "l_orderkey", "l_linenumber", relations.chainable(same, dx, dy, dy - 400, 300 - dy).alias("chainable"), relations.overlapping(same, dx, dy).alias("overlapping"),
        relations.gap_before(dx).alias("gap_before"), relations.off_anchor(dx, dy, 1).alias("off_up"), relations.off_anchor(dx, dy, -1).alias("off_down"),
    )


@define("gap_branch", "l_orderkey:l l_linenumber:l branch:s code:l", f"""{D_STEPS},
k AS (SELECT *, CASE WHEN NOT same_strand THEN 'inv' WHEN dx - dy < -greatest(abs(dx) / 4, 50) AND dx > -50 THEN 'ins' WHEN dx - dy < -greatest(abs(dx) / 4, 50) THEN 'dup' WHEN dx - dy > greatest(dy / 4, 50) THEN 'del' ELSE 'normal' END AS kind FROM steps) =>
SELECT l_orderkey, l_linenumber, CASE WHEN NOT same_strand THEN 'both_ends' WHEN dy - dx > 80 THEN 'insertion' WHEN dy - dx < -80 THEN 'deletion' WHEN greatest(dx, dy) > 90 THEN 'remap' ELSE 'none' END AS branch,
CASE kind WHEN 'inv' THEN 1 WHEN 'ins' THEN 2 WHEN 'del' THEN 4 WHEN 'trs' THEN 8 WHEN 'dup' THEN 16 ELSE 0 END AS code FROM k""")
def gap_branch(spark: SparkSession, sf: str) -> DataFrame:
    dx, dy, same = F.col("dx"), F.col("dy"), F.col("same_strand")
    return steps(spark, sf).select("l_orderkey", "l_linenumber", relations.gap_branch(dx, dy, same).alias("branch"), relations.variant_code(scores.variant_class(dx, dy, same)).alias("code"))


@define("near_long_islands", "user_id:l event_id:l x:l", f"""{D_POINTS}, a AS (SELECT user_id, event_id, x // 60 AS x, event_type = 'purchase' AS long_pattern FROM points),
n AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY user_id ORDER BY x) < 400 THEN 0 ELSE 1 END AS new FROM a WHERE long_pattern),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY x) AS island FROM n),
s AS (SELECT user_id, island, count(*) AS n, floor(avg(x)) AS mean_x FROM i GROUP BY 1, 2),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, island) <= 5) =>
SELECT user_id, event_id, x FROM a WHERE EXISTS (SELECT 1 FROM m WHERE m.user_id = a.user_id AND abs(a.x - m.mean_x) < 2500)""")
def near_long_islands(spark: SparkSession, sf: str) -> DataFrame:
    a = points(spark, sf).select("user_id", "event_id", F.floor(F.col("x") / 60).alias("x"), (F.col("event_type") == "purchase").alias("long_pattern"))
    return relations.near_long_islands(a, ["user_id"], 400)


@define("banded_words", "read_id:l gid:l kmer:s x:l y:l", f"""{D_READS}, {D_GENOMES} => SELECT r.seq_id AS read_id, g.seq_id AS gid, r.kmer AS kmer, g.pos AS x, r.pos AS y
FROM {d_kmers('reads', 'read_id', 12)} r JOIN {d_kmers('genomes', 'gid', 12)} g ON r.kmer = g.kmer AND g.pos - r.pos >= -50 AND g.pos - r.pos < 50""")
def banded_words(spark: SparkSession, sf: str) -> DataFrame:
    left = seeds.kmer_rows(genomes(spark, sf), "gid", 12).select(F.col("seq_id").alias("gid"), F.col("pos").alias("x"), "kmer")
    right = seeds.kmer_rows(reads(spark, sf), "read_id", 12).select(F.col("seq_id").alias("read_id"), F.col("pos").alias("y"), "kmer")
    return relations.banded_words(left, right, [], -50, 50)


def halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    p = points(spark, sf).withColumn("n", F.count("*").over(Window.partitionBy("user_id"))).select("user_id", "ord", (F.floor(F.col("x") / 3600)).alias("x"), (F.col("y") * 10).alias("y"), "n")
    return p.where("ord * 10 <= n * 6"), p.where("ord * 10 > n * 4")


D_HALVES = f"{D_POINTS}, p AS (SELECT user_id, ord, x // 3600 AS x, y * 10 AS y, count(*) OVER (PARTITION BY user_id) AS n FROM points), a AS (SELECT * FROM p WHERE ord * 10 <= n * 6), b AS (SELECT * FROM p WHERE ord * 10 > n * 4)"


@define("facing_overlap", "user_id:l from_1:l to_2:l", f"""{D_HALVES},
starts AS (SELECT user_id, arg_min(x, ord) AS x2, arg_min(y, ord) AS y2 FROM b GROUP BY 1), ends AS (SELECT user_id, arg_max(x, ord) AS x1, arg_max(y, ord) AS y1 FROM a GROUP BY 1),
one AS (SELECT user_id, coalesce(max(CASE WHEN x < x2 - 25 AND y < y2 - 25 THEN ord + 1 END), min(ord)) AS from_1 FROM a JOIN starts USING (user_id) GROUP BY 1),
two AS (SELECT user_id, min(CASE WHEN x > x1 + 50 AND y > y1 + 50 THEN ord END) AS to_2 FROM b JOIN ends USING (user_id) GROUP BY 1) => SELECT * FROM one JOIN two USING (user_id)""")
def facing_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return relations.facing_overlap(*halves(spark, sf), ["user_id"])


@define("framed_tiles", "user_id:l ord:l role:s x1:l y1:l x2:l y2:l", f"""{D_POINTS}, p AS (SELECT user_id, ord, x // 600 AS x, y * 4 AS y, event_type FROM points),
g AS (SELECT user_id, min(x) AS x_lo, min(y) AS y_lo, max(x) + 40 AS x_hi, max(y) + 200 AS y_hi FROM p GROUP BY 1), t AS (SELECT * FROM p WHERE event_type = 'purchase'),
l AS (SELECT user_id, arg_max(x, ord) AS lx, arg_max(y, ord) AS ly, max(ord) AS n, min(ord) AS f FROM t GROUP BY 1),
r AS (SELECT *, least(x_hi - x_lo, y_hi - y_lo, 96) AS w, coalesce(least(lx - x_lo, ly - y_lo, 96), w) AS h, coalesce(least(x_hi - lx, y_hi - ly, 96), w) AS q FROM (SELECT g.*, lx, ly, n, f FROM g LEFT JOIN l USING (user_id))) =>
SELECT user_id, coalesce(f, 1) - 1 AS ord, 'head' AS role, x_lo AS x1, y_lo AS y1, x_lo + h AS x2, y_lo + h AS y2 FROM r UNION ALL SELECT user_id, coalesce(n, 0) + 1, 'tail', x_hi - q, y_hi - q, x_hi, y_hi FROM r
UNION ALL SELECT user_id, ord, 'tile', x, y, x + least(x_hi - x, y_hi - y, 96), y + least(x_hi - x, y_hi - y, 96) FROM t JOIN g USING (user_id)""")
def framed_tiles(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf).select("user_id", "ord", F.floor(F.col("x") / 600).alias("x"), (F.col("y") * 4).alias("y"), "event_type")
    gaps = p.groupBy("user_id").agg(F.min("x").alias("x_lo"), F.min("y").alias("y_lo"), (F.max("x") + 40).alias("x_hi"), (F.max("y") + 200).alias("y_hi"))
    return relations.framed_tiles(p.where("event_type = 'purchase'").select("user_id", "ord", "x", "y"), gaps, ["user_id"])


@define("closest_chain", "l_orderkey:l chain_id:l", f"{D_STEPS} => SELECT l_orderkey, min(l_linenumber) AS chain_id FROM steps WHERE abs(dx - dy) < 50 AND greatest(abs(dx), abs(dy)) < 1500 GROUP BY 1")
def closest_chain(spark: SparkSession, sf: str) -> DataFrame:
    chains = steps(spark, sf).select("l_orderkey", F.col("l_linenumber").alias("chain_id"), F.col("dx").alias("x"), F.col("dy").alias("y"), F.lit(0).alias("gx"), F.lit(0).alias("gy"))
    return relations.closest_chain(chains, ["l_orderkey"], within=1500)


@define("merged_blocks", "l_orderkey:l l_linenumber:l merged_id:l", f"""{D_STEPS}, b AS (SELECT l_orderkey, l_linenumber, dx AS xstart, dx + 300 AS xend, dy AS ystart, dy + 200 AS yend, same_strand AS strand FROM steps),
n AS (SELECT *, xstart - lag(xend) OVER w AS gx, ystart - lag(yend) OVER w AS gy, lag(strand) OVER w AS s FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY xstart, ystart, l_linenumber)) =>
SELECT l_orderkey, l_linenumber, sum(CASE WHEN {INSIDE.format('gx')} AND {INSIDE.format('gy')} AND strand = s THEN 0 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY xstart, ystart, l_linenumber) AS merged_id FROM n""")
def merged_blocks(spark: SparkSession, sf: str) -> DataFrame:
    b = steps(spark, sf).select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("block_id"), F.col("dx").alias("xstart"), (F.col("dx") + 300).alias("xend"), F.col("dy").alias("ystart"), (F.col("dy") + 200).alias("yend"), F.col("same_strand").alias("strand"))
    return relations.merged_blocks(b, ["l_orderkey"])


@define("segment_limit", "user_id:l event_id:l", "=> SELECT user_id, event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) <= 65)")
def segment_limit(spark: SparkSession, sf: str) -> DataFrame:
    return relations.small_groups(T(spark, sf, "events").select("user_id", "event_id"), ["user_id"], most=65)


def columns(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf).select("user_id", "ord", ((F.col("event_id") * 7919) % 1000 < F.when(F.col("ord") < 34, 300).otherwise(900)).cast("int").alias("m"))
    by = Window.partitionBy("user_id").orderBy("ord")
    return p.select("user_id", "ord", F.sum("m").over(by).alias("matches"), F.sum(F.when(F.col("m") == 1, 5).otherwise(-3)).over(by).alias("score"))


@define("density_breakpoint", "user_id:l ord:l gain:d", f"""{D_POINTS}, m AS (SELECT user_id, ord, CASE WHEN event_id * 7919 % 1000 < CASE WHEN ord < 34 THEN 300 ELSE 900 END THEN 1 ELSE 0 END AS m FROM points),
c AS (SELECT user_id, ord, sum(m) OVER w AS matches, sum(CASE WHEN m = 1 THEN 5 ELSE -3 END) OVER w AS score FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ord)),
b AS (SELECT user_id, ord, count(*) OVER l - 1 AS bn, count(*) OVER r - 1 AS an, CAST(score - first_value(score) OVER l AS DOUBLE) AS ls, CAST(last_value(score) OVER r - score AS DOUBLE) AS rs, CAST(matches - first_value(matches) OVER l AS DOUBLE) AS lm, CAST(last_value(matches) OVER r - matches AS DOUBLE) AS rm
FROM c WINDOW l AS (PARTITION BY user_id ORDER BY ord ROWS BETWEEN 50 PRECEDING AND CURRENT ROW), r AS (PARTITION BY user_id ORDER BY ord ROWS BETWEEN CURRENT ROW AND 50 FOLLOWING)),
f AS (SELECT user_id, ord, round(rs / an - ls / bn, 9) AS gain FROM b WHERE bn >= 10 AND an >= 10 AND lm / bn < 0.65 AND rm / an > 0.75) =>
SELECT user_id, ord, gain FROM f WHERE gain >= 2.2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY gain DESC, ord) = 1""")
def density_breakpoint(spark: SparkSession, sf: str) -> DataFrame:
    return relations.density_breakpoint(columns(spark, sf), ["user_id"], head=True)


@define("gap_share", "cust:l share:d again:b", f"""{D_INTERVALS}, len AS (SELECT cust, max(end_) + 100 AS len FROM ivs WHERE end_ > start_ GROUP BY 1),
i AS (SELECT cust, start_, coalesce(max(end_) OVER (PARTITION BY cust ORDER BY start_, end_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM ivs WHERE end_ > start_),
g AS (SELECT cust, start_ - e AS n FROM i WHERE start_ - e > 20 UNION ALL SELECT cust, 100 FROM len) =>
SELECT cust, round(CAST(sum(n) AS DOUBLE) / max(len), 6) AS share, round(CAST(sum(n) AS DOUBLE) / max(len), 6) >= 0.7 AS again FROM g JOIN len USING (cust) GROUP BY 1""")
def gap_share(spark: SparkSession, sf: str) -> DataFrame:
    ivs = intervals(spark, sf)
    lengths = ivs.groupBy("cust").agg((F.max("end_") + 100).alias("len"))
    shares = relations.gap_shares(blocks.uncovered(ivs, ["cust"], lengths, 20), lengths, ["cust"])
    return shares.withColumn("again", F.col("share") >= 0.7)


@define("sort_check", "user_id:l n:l", f"{D_POINTS}, d AS (SELECT user_id, value < lag(value) OVER (PARTITION BY user_id ORDER BY ord) AS back FROM points) => SELECT user_id, count(*) FILTER (WHERE back) AS n FROM d GROUP BY 1")
def sort_check(spark: SparkSession, sf: str) -> DataFrame:
    return relations.out_of_order(points(spark, sf), ["user_id"], "ord", "value")


@define("index_slices", "gid:l seeds:l first_x:l last_x:l", f"{D_GENOMES}, {D_INDEX} => SELECT gid, count(*) AS seeds, min(x) AS first_x, max(x) AS last_x FROM gindex GROUP BY 1")
def index_slices(spark: SparkSession, sf: str) -> DataFrame:
    """One index for all genomes, read a genome at a time."""
    return index(spark, sf).groupBy("gid").agg(F.count("*").alias("seeds"), F.min("x").alias("first_x"), F.max("x").alias("last_x"))


PACKED = "(" + " + ".join(f"(instr('ACGT', substr({{0}}, {i + 1}, 1)) - 1) * {4 ** (9 - i)}" for i in range(10)) + ")"


@define("equal_bases", "doc_id:l at_left:l at_right:l", f"""w AS (SELECT doc_id, {PACKED.format("substr(d, 1, 10)")} AS a, {PACKED.format("substr(d, 11, 10)")} AS b FROM (SELECT doc_id, translate(md5(text), '0123456789abcdef', 'ACGTACGTACGTACGT') AS d FROM documents)),
v AS (SELECT doc_id, xor(CAST(a AS BIGINT), CAST(b AS BIGINT)) AS z FROM w) =>
SELECT doc_id, CASE WHEN z = 0 THEN 10 ELSE 10 - (length(bin(z)) + 1) // 2 END AS at_left, CASE WHEN z = 0 THEN 10 ELSE (length(bin(z & -z)) - 1) // 2 END AS at_right FROM v""")
def equal_bases(spark: SparkSession, sf: str) -> DataFrame:
    d = F.translate(F.md5(F.col("text").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT")
    left, right = relations.equal_bases(S.pack(F.substr(d, F.lit(1), F.lit(10))), S.pack(F.substr(d, F.lit(11), F.lit(10))), 10)
    return T(spark, sf, "documents").select("doc_id", left.alias("at_left"), right.alias("at_right"))


MIXED = "list_aggregate(list_transform(range(1, {n} + 1), lambda i: CASE WHEN substr({r}, i, 1) = substr({g}, i, 1) THEN 'N' ELSE substr({r}, i, 1) END), 'string_agg', '')"


@define("sequence_by_cigar", "gid:l seq:s", f"""g AS (SELECT item_id AS gid, substr({DNA}, 1, 30) AS g, translate(md5(text), '0123456789abcdef', 'ACGTACGTACGTACGT') AS r FROM benchmark),
p AS (SELECT *, substr(g, 7, 8) AS gx, substr(r, 11, 8) AS rx FROM g WHERE length(g) = 30) =>
SELECT gid, substr(r, 1, 4) || substr(g, 1, 6) || {MIXED.format(n=8, r='rx', g='gx')} || substr(r, 19, 5) || substr(g, 18, 7) AS seq FROM p""")
def sequence_by_cigar(spark: SparkSession, sf: str) -> DataFrame:
    """4S 6= 8X 5I 3D 7M over each genome's first bases and its digest's."""
    cigar = F.array(*[F.struct(F.lit(op).alias("op"), F.lit(n).cast("long").alias("n")) for op, n in (("S", 4), ("=", 6), ("X", 8), ("I", 5), ("D", 3), ("M", 7))])
    text = T(spark, sf, "benchmark").select(F.col("item_id").alias("gid"), F.substr(S.dna(F.col("text")), F.lit(1), F.lit(30)).alias("g"), F.translate(F.md5(F.col("text").cast("binary")), "0123456789abcdef", "ACGTACGTACGTACGT").alias("r")).where("length(g) = 30")
    return text.select("gid", alignments.sequence_by_cigar(cigar, F.col("g"), F.col("r")).alias("seq"))


@define("cord_lines", "l_orderkey:l l_linenumber:l line:s", f"{D_STEPS} => SELECT l_orderkey, l_linenumber, l_orderkey || ':' || dx || CASE WHEN same_strand THEN '+' ELSE '-' END || dy AS line FROM steps")
def cord_lines(spark: SparkSession, sf: str) -> DataFrame:
    return steps(spark, sf).select("l_orderkey", "l_linenumber", relations.cord_text(F.col("l_orderkey"), F.when(F.col("same_strand"), 0).otherwise(1), F.col("dx"), F.col("dy")).alias("line"))


BASE = "CASE {0} WHEN 'A' THEN pa WHEN 'C' THEN pc WHEN 'G' THEN pg ELSE pt END"


@define("d2_star", "gid:l other:l score:d", f"""{D_GENOMES}, k AS {d_kmers('genomes', 'gid', 3)}, c AS (SELECT seq_id, kmer, count(*) AS n FROM k GROUP BY 1, 2), t AS (SELECT seq_id, sum(n) AS total FROM c GROUP BY 1),
f AS (SELECT {', '.join(f"CAST(sum(length(seq) - length(replace(seq, '{b}', ''))) AS DOUBLE) / sum(length(seq)) AS p{b.lower()}" for b in 'ACGT')} FROM genomes),
w AS (SELECT kmer, ({BASE.format('substr(kmer, 1, 1)')}) * ({BASE.format('substr(kmer, 2, 1)')}) * ({BASE.format('substr(kmer, 3, 1)')}) AS p FROM (SELECT DISTINCT kmer FROM c), f),
x AS (SELECT t.seq_id, w.kmer, w.p, coalesce(n, 0) - total * p AS v, total FROM t CROSS JOIN w LEFT JOIN c ON c.seq_id = t.seq_id AND c.kmer = w.kmer) =>
SELECT a.seq_id AS gid, b.seq_id AS other, round(sum(a.v * b.v / (sqrt(CAST(a.total AS DOUBLE) * b.total) * a.p)), 6) AS score FROM x a JOIN x b ON a.kmer = b.kmer AND b.seq_id = a.seq_id + 1 GROUP BY 1, 2""")
def d2_star(spark: SparkSession, sf: str) -> DataFrame:
    g = genomes(spark, sf)
    pairs = g.select(F.col("gid"), (F.col("gid") + 1).alias("other"))
    return composition.d2_star(g, "gid", pairs, 3)
