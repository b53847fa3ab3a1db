"""Every query with a SQL twin against DuckDB, the ordered folds against plain loops, sources, sinks and streams."""

import gzip
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.config import BinParams, ChainParams, gap_length, preset
from strandloom.functions import sequences as S
from strandloom.operators import alignments, anchors, blocks, chains, composition, scores, seeds
from strandloom.plans import gap_queries, mapping, queries  # noqa: F401
from strandloom.sources import formats
from strandloom.streaming import runs

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in TABLES.split():
        c.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return c


def plain(frame):
    show = lambda x: "-" if x is None or x != x else f"{x:.6g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(show, row)) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, expected = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert plain(got) == plain(expected)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_windows_by_join_equal_windows_by_order(spark):
    from strandloom.operators import features

    f = features.dimer_features(queries.reads(spark, SF).limit(20), "read_id").persist()
    pairs = f.select(F.col("seq_id").alias("left_id"), F.col("cell").alias("left_cell"), F.col("seq_id").alias("right_id"), (F.col("cell") + 6).alias("right_cell"))
    joined = features.window_distances(f, f, pairs).select(F.col("left_id").alias("seq_id"), F.col("left_cell").alias("cell"), "dist")
    assert plain(joined.toPandas()) == plain(features.step_distances(f).toPandas())


def test_islands_by_median_equal_a_plain_loop(spark):
    r = np.random.default_rng(7)
    rows = [(int(k % 3), 1, 0, int(x), int(y)) for k, (x, y) in enumerate(zip(r.integers(0, 900, 150), r.integers(0, 900, 150)))]
    got = {}
    for q in chains.islands_by_median(spark.createDataFrame(rows, "read_id long, gid int, strand int, x long, y long")).collect():
        got.setdefault(q["read_id"], []).append((q["x"] - q["y"], q["y"], q["x"], q["island"]))
    for read, found in got.items():
        found.sort()
        island, begin = 1, 0
        for i, (d, y, _, k) in enumerate(found):
            if i > begin:
                m = (begin + i) // 2
                if d - found[m][0] >= abs(y - found[m][1]) // 4:
                    island, begin = island + 1, i
            assert k == island, (read, i)


def test_sam_records_of_the_tables(spark):
    """Every record's CIGAR spans its whole read, its place lies in its genome, and the reads are those of the plan's chains."""
    import re

    lengths = {f"read{q['read_id']}": len(q["seq"]) for q in queries.reads(spark, SF).collect()}
    genomes = {q["name"]: len(q["seq"]) for q in queries.genomes(spark, SF).collect()}
    records = [q["value"].split("\t") for q in queries.QUERIES["sam_records"](spark, SF).collect()]
    assert records
    for name, flag, genome, pos, mapq, cigar, *_ in records:
        ops = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
        assert "".join(f"{n}{op}" for n, op in ops) == cigar and sum(n for n, op in ops if op in "=XIS") == lengths[name]
        assert 1 <= int(pos) and int(pos) - 1 + sum(n for n, op in ops if op in "=XD") <= genomes[genome] and int(flag) & ~(2048 | 16) == 0 and mapq == "255"


def test_finds_and_distances_over_whole_sequences(spark, tmp_path):
    r = np.random.default_rng(9)
    word = lambda n: "".join("ACGT"[i] for i in r.integers(0, 4, n)).translate(str.maketrans("ACGT", "abcd"))
    genome, other = word(90), word(60)
    changed = list(genome[40:80])
    for i in (3, 15, 30):
        changed[i] = "abcd"["abcd".index(changed[i]) - 1]
    texts = [word(30) + genome[50:85] + word(20), word(10) + "".join(changed) + word(5), word(70), other]
    spark.createDataFrame([(0, genome), (1, other)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cut = lambda t: [(i, t[i : i + 24]) for i in range(len(t) - 23)]
    every = [(g, i, d, j, sum(a != b for a, b in zip(x, y))) for g, p in enumerate((genome, other)) for i, x in cut(p) for d, t in enumerate(texts) for j, y in cut(t)]
    rows = lambda name: sorted(map(tuple, queries.QUERIES[name](spark, str(tmp_path)).collect()))
    assert rows("exact_find_windows") == sorted(e[:4] for e in every if not e[4])
    assert rows("hamming_find_windows") == sorted(e for e in every if e[4] <= 3)
    assert any(0 < e[4] <= 3 and e[1] > 0 for e in every)

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    own = [sum(x + y != "ad" and x + y != "da" and x + y != "bc" and x + y != "cb" for x, y in zip(t, t[::-1])) for t in texts]
    got = sorted(map(tuple, queries.QUERIES["edit_and_hamming_texts"](spark, str(tmp_path)).collect()), key=lambda q: q[0])
    assert got == [(i, edit(texts[i], texts[i + 1]) if i < 3 else None, own[i]) for i in range(4)]


def test_whole_edit_distances_equal_a_plain_loop(spark, monkeypatch):
    from strandloom.operators import exact

    r = np.random.default_rng(5)
    word = lambda n, k=4: "".join("ACGT"[i] for i in r.integers(0, k, n))
    texts = [(word(n), word(m, 2)) for n in (0, 1, 63, 64, 65, 128, 129) for m in (0, 1, 64, 65)] + [(t, t[:70] + t[75:] + "A") for t in (word(200), word(300))] + [("aé√x", "éx√"), (word(9), None), (None, word(9))]

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    other = dict(zip("ACGT", "TGCA", strict=True))
    expected = [(i, None if a is None or b is None else edit(a, b), None if a is None else sum(x != other.get(y, y) for x, y in zip(a, a[::-1]))) for i, (a, b) in enumerate(texts)]
    got = exact.whole_distances(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(texts)], "id long, a string, b string")).collect()
    assert sorted(map(tuple, got)) == expected
    for words in (1, 7):
        monkeypatch.setattr(exact, "WORDS", words)
        whole = [(np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)) for a, b in texts[:-3]]
        assert exact.edit_distances(whole).tolist() == [e for _, e, _ in expected[:-3]]


def odd_lines(spark, tmp_path, rows):
    import duckdb

    kinds = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, kinds).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect(config={"threads": 1})
    c.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    return lambda name: (plain(queries.QUERIES[name](spark, str(tmp_path)).toPandas()), plain(c.sql(queries.ORACLES[name]).df()))


def test_merged_blocks_of_equal_starts(spark, tmp_path):
    rows = [(1, 7, 47.0, 37296.71, "A", "O"), (1, 7, 47.0, 37297.63, "R", "F"), (2, 3, 6.0, 14001.65, "A", "O"), (2, 7, 50.0, 36921.45, "R", "O"), (2, 7, 50.0, 36930.9, "R", "F"), (2, 4, 24.0, 98618.48, "A", "O")]
    got, expected = odd_lines(spark, tmp_path, rows)("merged_blocks")
    assert got == expected and len(got) == 6


def test_runs_of_equal_lines_no_lengths_and_no_line_numbers(spark, tmp_path):
    rows = [(1, 2, 30.0, 1.0, "A", "O"), (1, 2, 30.0, 2.0, "A", "O"), (1, 2, 27.0, 1.0, "A", "O"), (2, 1, 0.5, 1.0, "R", "O"), (3, None, 4.0, 1.0, "R", "O"), (3, 1, 5.0, 1.0, "A", "O"), (4, 1, None, 1.0, "R", "O")]
    pairs = odd_lines(spark, tmp_path, rows)
    for name, n in (("run_lengths", 3), ("cigar_rle", 2)):
        got, expected = pairs(name)
        assert got == expected and len(got) == n


def test_repeats_count_words_beside_their_sequence(spark, monkeypatch):
    from collections import Counter

    r = np.random.default_rng(6)
    word = lambda n: "".join("ACGTN"[i] for i in r.choice(5, n, p=[0.3, 0.3, 0.2, 0.19, 0.01]))
    rows = [(i, word(400)) for i in range(5)] + [(1, word(400)), (None, word(50)), (None, word(50)), (7, None), (8, ""), (9, "ACGX" * 9)] + [(10, word(300)) for _ in range(4)]
    for k in (4, 35):
        all_words = Counter((i, s[j : j + k]) for i, s in rows for j in range(len(s or "") - k + 1) if "N" not in s[j : j + k])
        for held in (1 << 21, 500):
            monkeypatch.setattr(composition, "HELD", held)
            found = composition.repeats(spark.createDataFrame(rows, "seq_id long, seq string"), "seq_id", k)
            assert sorted(map(tuple, found.collect()), key=str) == sorted(((i, w, n) for (i, w), n in all_words.items() if n >= 2), key=str)
        assert "Generate" not in found._jdf.queryExecution().toString()  # no row a word before the shuffle


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["read_id", "gid", "strand", "ystart", "yend", "xstart", "xend", "n_anchors"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def column(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


def test_sequence_functions(spark):
    assert column(spark, "ACGTN", S.reverse_complement) == "NACGT"
    assert column(spark, "acgxN", S.clean) == "ACGNN"
    assert column(spark, "AACCCGT", S.homopolymer_compressed) == "ACGT"
    assert column(spark, "ATGGCCTAAX", lambda c: S.translated(c, 0)) == "MA*"
    assert column(spark, "TTAGGCCAT", lambda c: S.translated(c, 3)) == "MA*"
    assert column(spark, "ACGT", S.pack) == 27 and column(spark, "ACNT", S.pack) is None
    assert abs(column(spark, 1.96, lambda c: S.normal_cdf(c, 0.0, 1.0), "double") - 0.9750021) < 1e-6
    assert [r["pos"] for r in column(spark, "ACGTACG", lambda c: S.kmers(c, 3, 2))] == [0, 2, 4]
    assert column(spark, "AC", lambda c: S.kmers(c, 3)) == []


def test_minimizers_of_both_strands(spark):
    seq = "".join(np.random.default_rng(1).choice(list("ACGT"), 400))
    both = spark.createDataFrame([(0, seq), (1, seq[::-1].translate(str.maketrans("ACGT", "TGCA")))], "id int, seq string")
    rows = seeds.seed_rows(both, "id", 1).collect()
    one = {(r["pos"], r["minimizer"], r["strand"]) for r in rows if r["seq_id"] == 0}
    assert one == {(400 - 21 - r["pos"], r["minimizer"], 1 - r["strand"]) for r in rows if r["seq_id"] == 1}


def test_windows_restart_after_n(spark):
    rows = seeds.kmer_rows(spark.createDataFrame([(0, "NNACGTNACGNN")], "id int, seq string"), "id", 3).collect()
    assert [(r["pos"], r["kmer"]) for r in sorted(rows)] == [(2, "ACG"), (3, "CGT"), (7, "ACG")]


def test_cap_and_length_boundaries(spark):
    seeds_ = spark.createDataFrame([(0, i, "a") for i in range(400)] + [(0, i, "b") for i in range(401)], "seq_id int, pos int, minimizer string")
    assert {r["minimizer"] for r in seeds.capped(seeds_, 400).collect()} == {"a"}
    reads = spark.createDataFrame([(n, "ACGTTGCA" * 40, n) for n in (199, 200, 201)], "read_id int, seq string, n int").withColumn("seq", F.expr("substr(seq, 1, n)"))
    assert {r["read_id"] for r in seeds.read_probes(reads).select("read_id").collect()} == {201}


def test_bins_of_ten_and_eleven(spark):
    rows = [(1, 1, 0, 10 * i, 0, 10 * i) for i in range(11)] + [(1, 1, 1, 10 * i, 0, 10 * i) for i in range(10)] + [(2, 1, 0, 10 * i, 0, 10 * i) for i in range(10)]
    kept = anchors.bin_filter(spark.createDataFrame(rows, "read_id int, gid int, strand int, x int, y int, diag int"), BinParams())
    assert sorted((r["read_id"], r["strand"]) for r in kept.collect()) == [(1, 0)] * 11 + [(2, 0)] * 10


@pytest.mark.parametrize("mutation", ["none", "reverse", "deletion", "insertion"])
def test_planted_reads_are_found(spark, mutation):
    r = np.random.default_rng(5)
    genome = "".join(r.choice(list("ACGT"), 20_000))
    part = genome[3000:9000]
    read = {"none": part, "reverse": part[::-1].translate(str.maketrans("ACGT", "TGCA")), "deletion": genome[3000:6000] + genome[6900:9900], "insertion": part[:3000] + "".join(r.choice(list("ACGT"), 900)) + part[3000:]}[mutation]
    reads = spark.createDataFrame([(1, "r", read), (2, "n", "N" * 500), (3, "short", read[:150])], "read_id long, name string, seq string")
    genomes = spark.createDataFrame([(1, "g", genome), (2, "h", "".join(r.choice(list("ACGT"), 5000)))], "gid int, name string, seq string")
    out = mapping.map_reads(reads, genomes)
    best = out.chains.where("rank = 1").first()
    assert (best["read_id"], best["gid"], best["strand"]) == (1, 1, int(mutation == "reverse"))
    span = out.chains.where(f"gid = 1 and strand = {best['strand']}").agg(F.min("xstart").alias("a"), F.max("xend").alias("b")).first()
    assert abs(span["a"] - 3000) < 300 and abs(span["b"] - (9900 if mutation == "deletion" else 9000)) < 300  # a variant splits the read into two chains
    lines = out.lines.collect()
    assert lines and {q["read_id"] for q in lines} == {1}
    for q in lines:
        assert sum(e["n"] for e in q["cigar"] if e["op"] in "=XIS") == len(read)
    assert alignments.sam_text(out.lines, reads).count() == len(lines)


def test_chain_is_the_best_path(spark):
    r = np.random.default_rng(2)
    x = np.sort(r.integers(0, 1500, 40))[::-1].astype(np.int64)
    y = np.maximum(0, x - 100 + r.integers(-15, 15, 40)).astype(np.int64)
    p = ChainParams()
    total = np.zeros(40, np.int64)
    for i in range(40):
        for j in range(i):
            if j >= i - p.depth or x[j] - x[i] < p.dx:
                s = int(chains.anchor_scores(np.array([x[j] - x[i]]), np.array([y[j] - y[i]]))[0])
                if s > 0:
                    total[i] = max(total[i], s + total[j])
    assert chains.best_chains(x, y, p)[0][0] == total.max()
    table = spark.createDataFrame([(int(a), int(b)) for a in range(-100, 2000, 37) for b in range(-50, 2500, 61)], "dx long, dy long")
    both = table.withColumn("s", scores.anchor_score(F.col("dx"), F.col("dy"))).collect()
    assert [q["s"] for q in both] == chains.anchor_scores(np.array([q["dx"] for q in both]), np.array([q["dy"] for q in both])).tolist()


def test_variant_classes(spark):
    cases = [(100, 100, True, "normal"), (0, 1000, True, "ins"), (-80, 1000, True, "dup"), (1000, 10, True, "del"), (50, 50, False, "inv"), (1000, 940, True, "normal")]
    table = spark.createDataFrame([c[:3] for c in cases], "dx long, dy long, same boolean")
    assert [r["k"] for r in table.select(scores.variant_class(F.col("dx"), F.col("dy"), F.col("same")).alias("k")).collect()] == [c[3] for c in cases]


def test_uncovered_parts(spark):
    windows = [(1, 192 * k, 192 * k + 192) for k in range(100) if k not in {45, 46, 47, 48, 49, 53, 54}]
    gaps = blocks.uncovered(spark.createDataFrame(windows, "id int, start_ int, end_ int"), ["id"], spark.createDataFrame([(1, 19_200), (2, 500)], "id int, len int"), 50)
    assert sorted((r["id"], r["gap_start"], r["gap_end"]) for r in gaps.collect()) == [(1, 45 * 192, 50 * 192), (1, 53 * 192, 55 * 192), (2, 0, 500)]


def test_repair_boundaries(spark):
    cords = [(1, 1, 0, 0, 96, 96), (1, 2, 95, 96, 200, 200), (1, 3, 181, 200, 300, 300), (1, 4, 280, 300, 400, 400)]
    got = sorted(chains.repaired(spark.createDataFrame(cords, "read_id int, ord int, x1 int, y1 int, x2 int, y2 int")).collect(), key=lambda r: r["ord"])
    assert got[1]["x1"] - got[0]["x2"] == 0 and got[2]["x1"] - got[1]["x2"] == 0 and got[3]["x1"] - got[2]["x2"] == -20


def test_sequence_by_cigar(spark):
    cigar = "array(struct('=' as op, 2L as n), struct('X' as op, 2L as n), struct('D' as op, 1L as n), struct('I' as op, 1L as n), struct('S' as op, 2L as n))"
    assert spark.range(1).select(alignments.sequence_by_cigar(F.expr(cigar), F.lit("ACGTA"), F.lit("GGGCTAA")).alias("s")).first()["s"] == "ACNCTAA"


def test_banded_score():
    assert composition.banded_score("ACGT", "ACGT", 5) == 12
    assert composition.banded_score("ACGT", "AGT", 5) == 8
    assert composition.banded_score("", "AC", 5) == -2


def test_presets():
    assert preset(1).chain.stop_ratio == 0 and preset(0).chain.stop_ratio == 0.7
    assert [gap_length(n) for n in (0, 1, 5, 10, 77)] == [0, 50, 10, 10, 77]


def test_files_and_streams(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">chr1 first\nACGT\nACGTN\n>chr2\nGGGCC\n")
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@r1 x\nACGT\n+\nIIII\n@r2\nTTTT\n+r2\n@@@@\n")
    (tmp_path / "empty.fa").write_text("")
    whole = formats.read_whole_files(spark, [str(tmp_path / n) for n in ("a.fa", "b.fq.gz", "empty.fa")])
    assert sorted((r["name"], r["seq"], r["quality"]) for r in whole.collect()) == [("chr1 first", "ACGTACGTN", None), ("chr2", "GGGCC", None), ("r1 x", "ACGT", "IIII"), ("r2", "TTTT", "@@@@")]
    fasta = formats.read_fasta(spark, [str(tmp_path / "a.fa")])
    assert sorted((r["name"], r["seq"]) for r in fasta.collect()) == [("chr1 first", "ACGTACGTN"), ("chr2", "GGGCC")]
    named = formats.genomes_of(fasta)
    assert [(r["gid"], r["name"], r["len"]) for r in named.orderBy("gid").collect()] == [(1, "chr1", 9), (2, "chr2", 5)]
    assert alignments.sam_header(named)[1] == "@SQ\tSN:chr1\tLN:9"
    (tmp_path / "v.bed").write_text("#c\nchr1\t5\t10\tx\nchr2\t1\t2\n")
    assert [(r["chrom"], r["start"], r["name"]) for r in formats.read_tabular(spark, [str(tmp_path / "v.bed")], formats.BED).collect()] == [("chr1", 5, "x"), ("chr2", 1, None)]
    assert column(spark, "3M1I2S", lambda c: S.cigar_text(formats.sam_cigar(c))) == "3M1I2S"
    assert column(spark, "/x/reads.fa.gz", formats.file_prefix) == "reads"

    r = np.random.default_rng(9)
    genome = "".join(r.choice(list("ACGT"), 6000))
    os.makedirs(tmp_path / "in")
    for k in range(3):
        (tmp_path / "in" / f"{k}.fa").write_text(f">r{k}\n{genome[k * 1000 : k * 1000 + 3000]}\n")
    index = seeds.genome_index(spark.createDataFrame([(1, "g", genome)], "gid int, name string, seq string"))
    query = runs.map_stream(spark, runs.fasta_stream(spark, str(tmp_path / "in"), 1), index, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("read_id").distinct().count() == 3 and out.where("abs((diag + 500) % 1000 - 500) > 9").count() == 0  # spans that share a minimizer begin within 9 bases


def test_sessions_on_a_stream_equal_the_table(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = runs.event_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")), late="60 days")
    query = stream.writeStream.outputMode("update").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination()
    last = spark.table("windows").groupBy("event_type", "start_").agg(F.max("n").alias("n"))
    assert plain(last.toPandas()) == plain(runs.event_windows(events).select("event_type", "start_", "n").toPandas())


def test_lines_are_written_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"v{k:03}") for k in range(200)], "k int, value string")
    formats.write_lines(rows, str(tmp_path / "sam"), ["k"], ["@HD"])
    assert [r["value"] for r in spark.read.text(str(tmp_path / "sam" / "header")).collect()] == ["@HD"]
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "sam" / "records")).collect()) == [f"v{k:03}" for k in range(200)]


def test_command_line_writes_sam_and_bam(spark, tmp_path):
    import struct

    from strandloom.__main__ import main

    r = np.random.default_rng(4)
    genome = "".join(r.choice(list("ACGT"), 8000))
    (tmp_path / "g.fa").write_text(f">chrA x\n{genome}\n")
    (tmp_path / "r.fq").write_text("".join(f"@r{k}\n{genome[k * 500 : k * 500 + 4000]}\n+\n{'I' * 4000}\n" for k in range(4)))
    assert main([str(tmp_path / "r.fq"), str(tmp_path / "g.fa"), "-o", str(tmp_path / "out"), "-f", "blocks,sam,bam,apf"]) == 0
    assert main([str(tmp_path / "no.fq"), "x", str(tmp_path / "g.fa"), "-o", str(tmp_path / "out")]) == 3 and main(["a", "b", "c", "-o", "d"]) == 2
    text = sorted(x["value"] for x in spark.read.text(str(tmp_path / "out" / "r" / "sam" / "records")).collect())
    data = gzip.decompress((tmp_path / "out" / "r" / "records.bam").read_bytes())
    assert data[:4] == b"BAM\1"
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    assert struct.unpack_from("<i", data, at)[0] == 1
    at += 8 + struct.unpack_from("<i", data, at + 4)[0]
    assert struct.unpack_from("<i", data, at)[0] == 8000
    at, found = at + 4, []
    while at < len(data):
        size, gid, pos, n_name, mapq, _, n_ops, flag, n_seq = struct.unpack_from("<iiiBBHHHi", data, at)
        found.append((data[at + 36 : at + 35 + n_name].decode(), flag, pos + 1, mapq, n_seq))
        at += 4 + size
    assert sorted(found) == sorted((f[0], int(f[1]), int(f[3]), int(f[4]), len(f[9])) for f in (x.split("\t") for x in text)) and len(found) >= 4
    assert spark.read.parquet(str(tmp_path / "out" / "r" / "blocks")).count() >= 4


def test_exact_alignment(spark):
    from strandloom.operators import exact

    r = np.random.default_rng(8)

    def plain_score(a, b):
        row = [-j for j in range(len(b) + 1)]
        for i, c in enumerate(a, 1):
            new = [-i]
            for j, d in enumerate(b, 1):
                new.append(max(row[j - 1] + (3 if c == d else -2), row[j] - 1, new[-1] - 1))
            row = new
        return row[-1]

    rows = []
    for k in range(30):
        a = "".join(r.choice(list("ACGT"), int(r.integers(0, 60))))
        b = "".join(c for c in a if r.random() > 0.1) + "".join(r.choice(list("ACGT"), 3))
        rows.append((k, a, b))
    for q in exact.aligned(spark.createDataFrame(rows, "pair_id int, a string, b string")).collect():
        _, a, b = rows[q["pair_id"]]
        assert q["score"] == plain_score(a, b) == composition.banded_score(a, b, 48)
        total = {o: sum(e["n"] for e in q["cigar"] if e["op"] == o) for o in "=XID"}
        assert total["="] + total["X"] + total["D"] == len(a) and total["="] + total["X"] + total["I"] == len(b)
        assert q["score"] == 3 * total["="] - 2 * total["X"] - total["I"] - total["D"]
    cigar = "array(struct('=' as op, 5L as n), struct('D' as op, 3L as n), struct('=' as op, 2L as n), struct('I' as op, 40L as n))"
    row = spark.range(1).select(S.cigar_text(exact.without_small_indels(F.expr(cigar))).alias("c"), exact.sound(F.lit(20), F.expr(cigar)).alias("s")).first()
    assert (row["c"], row["s"]) == ("10=40I", False)


def test_gap_tiles_fill_a_gap(spark):
    from strandloom.operators import gaps

    r = np.random.default_rng(3)
    genome = "".join(r.choice(list("ACGT"), 3000))
    reads = spark.createDataFrame([(1, "r", genome[200:2700])], "read_id long, name string, seq string")
    genomes = spark.createDataFrame([(1, "g", genome)], "gid int, name string, seq string")
    table = spark.createDataFrame([(1, 1, 0, 0, 1000, 200, 1200, 9), (1, 1, 0, 1600, 2400, 1800, 2600, 9)], "read_id long, gid int, strand int, ystart long, yend long, xstart long, xend long, n_anchors long")
    kinds = {(g["kind"], g["x_lo"], g["x_hi"], g["y_lo"], g["y_hi"]) for g in gaps.gap_table(table, reads).collect()}
    assert kinds == {("inner", 1200, 1800, 1000, 1600), ("tail", 2600, 2700, 2400, 2500)}
    points = table.select("read_id", "gid", "strand", F.col("xstart").alias("x"), F.col("ystart").alias("y"))
    tiles = [t for t in gaps.remapped(table, points, reads, genomes).collect() if t["from_gap"]]
    assert len(tiles) > 60 and all(t["x"] - t["y"] == 200 for t in tiles)


def test_windows_extend_along_the_diagonal(spark):
    from strandloom.operators import gaps

    r = np.random.default_rng(6)
    genome = "".join(r.choice(list("ACGT"), 3000))
    read = genome[160:1760] + "".join(r.choice(list("ACGT"), 800))
    found = gaps.extended(spark.createDataFrame([(1, 160, 0, genome, read), (2, 0, 0, "", ""), (3, 0, 0, None, "A")], "start_id long, x long, y long, genome string, read string")).collect()
    assert {f["start_id"] for f in found} == {1} and all(f["x"] - f["y"] == 160 for f in found) and max(f["y"] for f in found) >= 1500


def test_fastq_in_splits(spark, tmp_path):
    r = np.random.default_rng(8)
    rows = [(f"r{k} x>y", "".join(r.choice(list("ACGT"), int(r.integers(1, 60))))) for k in range(400)]
    quality = lambda q, k: ("@" if k % 3 else "+") + "I" * (len(q) - 1)
    (tmp_path / "a.fastq").write_text("".join(f"@{n}\n{q}\n+\n{quality(q, k)}\n" for k, (n, q) in enumerate(rows)))
    (tmp_path / "b.fq").write_text("".join(f"@{n}b\n{q}\n+\n{quality(q, k)}\n" for k, (n, q) in enumerate(rows[:50])))
    with gzip.open(tmp_path / "c.fq.gz", "wt") as f:
        f.write("@z\nACGN\n+\nIIII")
    (tmp_path / "d.fa").write_text("".join(f">{n}\n{q}\n{q}\n" for n, q in rows))
    old, spread = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "777")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = formats.read_fastq(spark, [str(tmp_path / n) for n in ("a.fastq", "b.fq", "c.fq.gz")])
        assert got.rdd.getNumPartitions() > 20
        assert sorted((x["name"], x["seq"], x["quality"]) for x in got.collect()) == sorted([(n, q, quality(q, k)) for k, (n, q) in enumerate(rows)] + [(n + "b", q, quality(q, k)) for k, (n, q) in enumerate(rows[:50])] + [("z", "ACGN", "IIII")])
        fasta = formats.read_fasta(spark, [str(tmp_path / "d.fa")])
        assert sorted((x["name"], x["seq"]) for x in fasta.collect()) == sorted((n, q + q) for n, q in rows)
        both = formats.read_sequences(spark, [str(tmp_path / "b.fq"), str(tmp_path / "d.fa")])
        assert both.count() == 450 and formats.reads_of(both).select("read_id").distinct().count() == 450
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", spread)
    assert formats.missing(spark, [str(tmp_path / "*.fq"), str(tmp_path / "none")]) == [str(tmp_path / "none")]


def test_variants_are_found_with_both_ends(spark):
    r = np.random.default_rng(5)
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    genome = "".join(r.choice(list("ACGT"), 20_000))
    part, new = genome[3000:9000], "".join(r.choice(list("ACGT"), 2000))
    noisy = lambda s: "".join("ACGT"[r.integers(4)] if r.random() < 0.04 else c for c in s)
    planted = {f"del{n}": genome[3000:6000] + genome[6000 + n : 9000 + n] for n in (120, 500, 1000, 2000)}
    planted |= {f"ins{n}": part[:3000] + new[:n] + part[3000:] for n in (120, 300, 1000, 2000)}
    planted |= {f"inv{n}": part[:2500] + turn(part[2500 : 2500 + n]) + part[2500 + n :] for n in (200, 800, 2000)}
    names = [*planted, *planted]
    reads = spark.createDataFrame([(k, n, s) for k, (n, s) in enumerate([*planted.items(), *((n, turn(noisy(s))) for n, s in planted.items())])], "read_id long, name string, seq string")
    out = mapping.map_reads(reads, spark.createDataFrame([(1, "g", genome)], "gid int, name string, seq string"))
    cords = {}
    for c in out.cords.collect():
        cords.setdefault(c["read_id"], []).append(c)
    for k, name in enumerate(names):
        length, kind, n = len(planted[name]), name[:3], int(name[3:])
        main = int(k >= len(planted))
        forward = [((c["y1"], c["y2"]) if c["strand"] == 0 else (length - c["y2"], length - c["y1"]), (c["x1"], c["x2"]), c["strand"]) for c in cords[k]]
        if main:
            forward = [((length - b, length - a), x, s) for (a, b), x, s in forward]  # the read as it was before it was turned
        own = [(y, x) for y, x, s in forward if s == main]
        if kind == "inv":
            y, x = zip(*[(y, x) for y, x, s in forward if s != main])
            ends = {"y_lo": (min(a for a, _ in y), 2500), "y_hi": (max(b for _, b in y), 2500 + n), "x_lo": (min(a for a, _ in x), 5500), "x_hi": (max(b for _, b in x), 5500 + n)}
        else:
            at = 3000 if kind == "del" else 3000 + n / 2
            left, right = [c for c in own if sum(c[0]) / 2 < at], [c for c in own if sum(c[0]) / 2 >= at]
            ends = {"x_left": (max(c[1][1] for c in left), 6000), "x_right": (min(c[1][0] for c in right), 6000 + n * (kind == "del")), "y_left": (max(c[0][1] for c in left), 3000), "y_right": (min(c[0][0] for c in right), 3000 + n * (kind == "ins"))}
        assert all(abs(a - b) <= 30 for a, b in ends.values()), (name, main, ends)


def test_chains_that_cover_a_read(spark):
    reads = spark.createDataFrame([(1, "A" * 3000)], "read_id long, seq string")
    row = lambda c, s, x, y, score: [(1, 1, s, c, score, k, x + 100 * k, y + 100 * k) for k in range(5)]
    table = spark.createDataFrame([*row(1, 0, 0, 0, 900), *row(2, 0, 5000, 100, 800), *row(3, 0, 9000, 50, 300), *row(4, 1, 700, 1500, 200), *row(5, 0, 1, 2500, 20)], chains.CHAIN_SCHEMA)
    got = {r["chain_id"]: r["rank"] for r in chains.covering_chains(table, reads).collect()}
    assert got == {1: 1, 2: 2, 4: 3}  # 3 lies under the best and is far weaker, 5 is too weak


def test_chains_of_blocks(spark):
    r = np.random.default_rng(3)
    rows = [(1, k, int(r.integers(2)), int(x), int(x) + 200, int(y), int(y) + 180, int(r.integers(1, 60))) for k, (x, y) in enumerate(zip(r.integers(0, 6000, 14), r.integers(0, 6000, 14)))]
    table = spark.createDataFrame(rows, "read_id long, block_id long, strand long, xstart long, xend long, ystart long, yend long, score long")
    got = chains.chain_blocks(table).collect()

    def best(i):  # over all ways to go on from a block
        later = [chains.block_step_score(q[3] - rows[i][4], q[5] - rows[i][6], q[2] == rows[i][2]) + best(j) for j, q in enumerate(rows) if chains.block_step_score(q[3] - rows[i][4], q[5] - rows[i][6], q[2] == rows[i][2]) > 0]
        return rows[i][7] + max(later, default=0)

    assert max(c["chain_score"] for c in got) == max(best(i) for i in range(len(rows)))
    assert sorted(c["block_id"] for c in got) == list(range(14))  # chains share no block
    steps = table.selectExpr("xstart - 3000 as dx", "ystart - 3000 as dy", "strand = 1 as same").withColumn("s", scores.block_score(F.col("dx"), F.col("dy"), F.col("same"))).collect()
    assert [q["s"] for q in steps] == [chains.block_step_score(q["dx"], q["dy"], q["same"]) for q in steps]


def test_points_that_step_back(spark):
    rows = [(1, 1, 1, 0, 0), (1, 1, 2, 100, 90), (1, 1, 3, 60, 100), (1, 1, 4, 90, 80), (1, 1, 5, 30, 20), (1, 1, 6, 200, 180), (1, 2, 7, 5, 5), (1, 3, 8, 7, 7), (1, 3, 9, 8, 8)]
    table = spark.createDataFrame([(*q, 9000) for q in rows], "read_id long, block_id long, ord long, x long, y long, len long")
    assert sorted(q["ord"] for q in chains.without_steps_back(table).collect()) == [1, 2, 5, 6, 8, 9]


def test_apf_text(spark):
    cords = spark.createDataFrame([(1, 1, 7, 1, 0, 10, 106, 5, 101), (1, 2, 7, 1, 0, 60, 156, 45, 141), (1, 3, 8, 1, 1, 500, 596, 300, 396)], "read_id long, ord long, block_id int, gid int, strand int, x1 long, x2 long, y1 long, y2 long")
    reads = spark.createDataFrame([(1, "r", "A" * 350)], "read_id long, name string, seq string")
    genomes = spark.createDataFrame([(1, "g", "C" * 700)], "gid int, name string, seq string")
    got = [q["value"] for q in alignments.apf_text(cords, reads, genomes).orderBy("read_id", "block_id", "ord").collect()]
    assert got == ["@ r 350 5 141 + g 700 10 156", "| 5 10 0 0 +", "| 45 60 40 50 +", "@ r 350 300 350 - g 700 500 596", "| 300 500 0 0 -"]


def test_lines_of_a_stream(spark, tmp_path):
    r = np.random.default_rng(9)
    genome = "".join(r.choice(list("ACGT"), 6000))
    os.makedirs(tmp_path / "in")
    for k in range(2):
        (tmp_path / "in" / f"{k}.fa").write_text(f">r{k} a>b\n{genome[k * 1000 : k * 1000 + 3000]}\n")
    genomes = spark.createDataFrame([(1, "g", genome)], "gid int, name string, seq string")
    shown = []
    listener = runs.Progress(shown.append)
    spark.streams.addListener(listener)
    try:
        runs.map_stream_lines(spark, runs.fasta_stream(spark, str(tmp_path / "in"), 1), genomes, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    finally:
        spark.streams.removeListener(listener)
    lines = [q["value"].split("\t") for q in spark.read.text(str(tmp_path / "out")).select("value").collect()]
    assert sorted((x[0], x[1], x[2]) for x in lines) == [("r0 a>b", "0", "g"), ("r1 a>b", "0", "g")]
    assert all(abs(int(x[3]) - 1 - 1000 * int(x[0][1])) < 30 for x in lines)


def test_windows_from_both_cords(spark):
    from strandloom.operators import gaps

    r = np.random.default_rng(6)
    genome = "".join(r.choice(list("ACGT"), 4000))
    read = genome[:2000] + genome[2400:]  # 400 bases are missing
    rows = [(1, 160, 160, 3600, 3200, genome, read), (2, 160, 160, 3600, 3600, genome, genome), (3, 160, 160, 1600, 1600, genome, "A" * 3000)]
    table = spark.createDataFrame(rows, "start_id long, x long, y long, x2 long, y2 long, genome string, read string")
    got = {}
    for q in gaps.patched(table).orderBy("start_id", "ord").collect():
        got.setdefault(q["start_id"], []).append((q["x"], q["y"], q["side"]))
    left, right = ([(x, y) for x, y, s in got[1] if s == side] for side in ("left", "right"))
    assert all(abs(x - y) <= 32 for x, y in left) and max(y for _, y in left) > 1700
    assert all(abs(x - y - 400) <= 32 for x, y in right) and min(y for _, y in right) < 2300
    assert all(abs(x - y) <= 32 for x, y, _ in got[2]) and len(got[2]) > 30 and 3 not in got
    assert all(a[0] < b[0] and a[1] < b[1] for k in got for a, b in zip(got[k], got[k][1:]))
    back = gaps.extended_back(table.where("start_id = 2").select("start_id", F.col("x2").alias("x"), F.col("y2").alias("y"), "genome", "read")).orderBy("ord").collect()
    assert [q["ord"] for q in back] == list(range(1, len(back) + 1)) and back[-1]["y"] < 200 and all(a["y"] > b["y"] for a, b in zip(back, back[1:]))
