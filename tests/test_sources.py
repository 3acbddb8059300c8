from pyspark.sql import functions as F

from tessera.sources import sinks, text


def put(tmp_path, name, content):
    (tmp_path / name).write_text(content)
    return str(tmp_path / name)


def test_fastq_round_trip(spark, tmp_path):
    path = put(tmp_path, "a.fq", "@r1/1 x\nACGT\n+\n@III\n@r2\nGG\n+\nII\n")
    assert sorted(map(tuple, text.fastq(spark, path).collect())) == [("r1", "ACGT", "@III"), ("r2", "GG", "II")]
    sinks.write_fastq(text.fastq(spark, path).withColumn("gene", F.lit("A")), str(tmp_path / "out"), "gene")
    assert text.fastq(spark, str(tmp_path / "out" / "gene=A")).count() == 2


def test_fastq_over_many_splits(spark, tmp_path):
    records = "".join(f"@r{i}\n{'ACGT' * 5}\n+\n{'@' * 20}\n" for i in range(3000))
    path = put(tmp_path, "many.fq", records)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = text.fastq(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 3000 and {r["seq"] for r in got} == {"ACGT" * 5} and len({r["name"] for r in got}) == 3000


def test_fasta_and_regions(spark, tmp_path):
    path = put(tmp_path, "a.fa", ">s1 first one\nACGT\nACGT\n>s2\nTTTT\n")
    seqs = text.fasta(spark, path)
    assert sorted(map(tuple, seqs.collect())) == [("s1", "first one", "ACGTACGT"), ("s2", "", "TTTT")]
    regions = spark.createDataFrame([("s1:3-6",), ("s2",)], "t string").select(text.region(F.col("t")).alias("r")).select("r.*")
    assert [r["seq"] for r in text.fetch(seqs, regions.where("start is not null")).collect()] == ["GTAC"]
    sinks.write_fasta(seqs, str(tmp_path / "fa"), 3)
    assert {r["seq"] for r in text.fasta(spark, str(tmp_path / "fa")).collect()} == {"ACGTACGT", "TTTT"}
    assert {r["qual"] for r in sinks.constant_quality(seqs).collect()} == {"I" * 8, "I" * 4}


def test_fasta_heads_only_at_line_starts(spark, tmp_path):
    path = put(tmp_path, "a.fa", "; note\n>s1 a->b note\r\nAC>GT\r\n\nACGT\n>s2>x\n>s3\nGG\n")
    assert sorted(map(tuple, text.fasta(spark, path).collect())) == [("s1", "a->b note", "AC>GTACGT"), ("s2>x", "", ""), ("s3", "", "GG")]
    put(tmp_path, "many.fa", "".join(f">c{i} n\n" + "ACGTA\n" * (i % 50) for i in range(600)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {r["name"]: len(r["seq"]) for r in text.fasta(spark, f"{tmp_path}/many.fa").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {f"c{i}": 5 * (i % 50) for i in range(600)}


def test_repeated_keys_do_not_end_a_scan(spark, tmp_path):
    path = put(tmp_path, "a.vcf", "#CHROM\nc\t5\t.\tA\tG\t30\tPASS\tDP=9;DP=10;DB;CSQ=a=b\tGT:AD:GT\t0|1:3,4:1\n")
    r = text.vcf(spark, path).first()
    assert r["info"] == {"DP": "9", "DB": None, "CSQ": "a=b"} and r["gt"] == [0, 1]
    sam = put(tmp_path, "a.sam", "r1\t0\tc\t11\t60\t4M\t=\t0\t0\tACGT\tIIII\tNM:i:1\tNM:i:2\n")
    assert text.sam(spark, sam).first()["tags"] == {"NM": "1"}


def test_vcf_keeps_info_filter_and_fields(spark, tmp_path):
    path = put(tmp_path, "a.vcf", "#CHROM\nc\t5\trs1\tA\tG\t30.0\tlow\tDP=9;DB\tGT:AD:PS\t0|1:3,4:7\nc\t6\t.\tA\tG\t.\t.\t.\tGT\t0/1\n")
    sinks.write_vcf(text.vcf(spark, path), str(tmp_path / "v"), "s")
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "v")).where("value not like '#%'").collect())
    assert lines == ["c\t5\trs1\tA\tG\t30.0\tlow\tDP=9;DB\tGT:AD:PS\t0|1:3,4:7", "c\t6\t.\tA\tG\t.\t.\t.\tGT:PS\t0/1:0"]
    bare = spark.createDataFrame([("c", 4, "A", ["G"], None, [0, 1], True, 3)], "chrom string, pos int, ref string, alts array<string>, qual double, gt array<int>, phased boolean, ps int")
    sinks.write_vcf(bare, str(tmp_path / "w"), "s")
    assert spark.read.text(str(tmp_path / "w")).where("value not like '#%'").first()["value"] == "c\t5\t.\tA\tG\t.\tPASS\t.\tGT:PS\t0|1:3"


def test_sam(spark, tmp_path):
    path = put(tmp_path, "a.sam", "@HD\tVN:1\nr1\t0\tc\t11\t60\t4M\t=\t0\t0\tACGT\tIIII\tNM:i:1\tBX:Z:AA:B\n")
    row = text.sam(spark, path).first()
    assert (row["pos"], row["tags"]) == (10, {"NM": "1", "BX": "AA:B"})


def test_vcf_round_trip(spark, tmp_path):
    path = put(tmp_path, "a.vcf", "##x\n#CHROM\nc\t5\t.\tA\tG,T\t30\tPASS\tDP=9;DB\tGT:AD:PS\t0|1:3,4,0:7\nc\t9\t.\tC\tT\t.\t.\tDP=1\tGT:AD\t./1\n")
    rows = text.vcf(spark, path).orderBy("pos").collect()
    assert rows[0]["gt"] == [0, 1] and rows[0]["ps"] == 7 and rows[0]["ad"] == [3, 4, 0] and rows[0]["info"]["DP"] == "9" and rows[0]["phased"]
    assert rows[1]["gt"] == [None, 1] and rows[1]["qual"] is None and rows[1]["ps"] == 0
    sinks.write_vcf(text.vcf(spark, path), str(tmp_path / "v"), "s")
    assert text.vcf(spark, str(tmp_path / "v")).count() == 2


def test_fragments(spark, tmp_path):
    path = put(tmp_path, "f", "2 r1 3 01 7 1 III\n1 r2 0 -1 -1 4 10 I5\n")
    got = sorted(map(tuple, text.fragments(spark, path).select("name", "site", "allele", "quality").collect()))
    assert got == [("r1", 2, 0, 40), ("r1", 3, 1, 40), ("r1", 6, 1, 40), ("r2", 3, 1, 40), ("r2", 4, 0, 20)]
    sinks.write_fragments(text.fragments(spark, path), str(tmp_path / "fo"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "fo")).collect()) == ["r1 2:2 6:1", "r2 3:2"]


def test_small_formats(spark, tmp_path):
    assert text.bed(spark, put(tmp_path, "b", "c\t1\t5\tx\n")).first()["end"] == 5
    assert text.depth(spark, put(tmp_path, "d", "c\t1\t5\n")).first()["pos"] == 0
    assert text.blast(spark, put(tmp_path, "bl", "# c\nq\ts\t99.5\t10\t1\t0\t1\t10\t1\t10\t1e-5\t20\n")).first()["pident"] == 99.5
    assert text.paf(spark, put(tmp_path, "p", "q\t10\t0\t10\t+\tt\t20\t0\t10\t9\t10\t60\n")).first()["identity"] == 0.9
    assert text.contig_index(spark, put(tmp_path, "i", "c\t100\t1\t60\t61\n")).first()["length"] == 100
    people = text.pedigree(spark, put(tmp_path, "ped", "f c d m 1 0\nf\td\t0\t0\t1\t0\nf m 0 0 2 0\n"))
    assert [tuple(r) for r in text.trios(people).collect()] == [("c", "m", "d")]
    assert {tuple(r) for r in text.key_values(spark, put(tmp_path, "kv", "# x\na = 1\nb=c=d\n")).collect()} == {("a", "1"), ("b", "c=d")}
    log = "User time (seconds): 3600.0\nSystem time (seconds): 0\nMaximum resident set size (kbytes): 1048576\n"
    row = text.time_logs(spark, put(tmp_path, "log", log)).first()
    assert (row["cpu_hours"], row["peak_gb"]) == (1.0, 1.0)
    assert text.genetic_map(spark, put(tmp_path, "gm", "position rate cM\n5 0.1 0.2\n")).first()["position"] == 5
    bp = put(tmp_path, "bp", "c\t10\t+\tc\t20\t+\tA\nc\t10\t+\td\t20\t+\tA\nc\t50\t+\tc\t60\t+\tA\n")
    out = text.breakpoints(spark, bp, spark.createDataFrame([("c", 55, 70)], "chrom string, start long, end long"))
    assert [r["start"] for r in out.collect()] == [10]


def test_alignments_and_samples(spark, tmp_path):
    row = "\t".join(["@read1", "0", "c", "5", "60", "4M", "*", "0", "0", "ACGT", "IIII", "NM:i:1"])
    (tmp_path / "a.sam").write_text("@HD\tVN:1.6\n@SQ\tSN:c\tLN:10\n" + row + "\n")
    assert [(r["qname"], r["pos"], r["tags"]["NM"]) for r in text.sam(spark, f"{tmp_path}/a.sam").collect()] == [("@read1", 4, "1")]
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\n"
    (tmp_path / "a.vcf").write_text(head + "c\t3\t.\tA\tC,G\t50\tPASS\t.\tGT:AD:DP:PS\t0|1:5,6,0:11:7\t1/2\n")
    got = {r["sample"]: (r["pos"], r["gt"], r["phased"], r["ad"], r["dp"], r["ps"]) for r in text.vcf_samples(spark, f"{tmp_path}/a.vcf").collect()}
    assert got == {"s1": (2, [0, 1], True, [5, 6, 0], 11, 7), "s2": (2, [1, 2], False, None, None, 0)}


def test_fragment_dialects(spark, tmp_path):
    (tmp_path / "f.txt").write_text("1 r1 3 011 III\n2 r2 2 ACGT-1 -1 3 01 9 1 III\n1 r3 1 40 500 3 0 I\n")
    got = {(r["name"], r["site"]): (r["kind"], r["barcode"], r["mate"], r["insert"], r["allele"]) for r in text.fragments(spark, f"{tmp_path}/f.txt").collect()}
    assert got[("r1", 3)] == (None, None, None, None, 1) and got[("r2", 8)] == (2, "ACGT-1", None, None, 1) and got[("r3", 2)] == (1, None, 39, 500, 0) and len(got) == 7


def test_report_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("h1", 0.75), ("h2", 0.25)], "file string, freq double")
    sinks.write_frequencies(rows, f"{tmp_path}/freq", 12)
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/freq").collect()]
    assert sorted(lines)[0].endswith("is 12") and sorted(lines)[1:] == ["h1 0.75", "h2 0.25"]
    one = spark.createDataFrame([("s", "g", "a", "b", 0.8, 0.2, 30, 0.5, 2.0, 2.0, 0.0, "Y")], ", ".join(f"{c} string" if c in ("sample", "gene", "first", "second", "loss") else f"{c} double" if c != "sites" else "sites int" for c in sinks.COPY_REPORT))
    sinks.write_copies(one, f"{tmp_path}/copies")
    assert len(spark.read.option("sep", "\t").option("header", True).csv(f"{tmp_path}/copies").columns) == 12


def test_pair_matrices(spark, tmp_path):
    path = put(tmp_path, "m", "1 3 0.5 0.1 0.2 0.7\n2 3 1 0 0 1\n\n")
    got = sorted((r["a"], r["b"], round(r["same"], 6), round(r["other"], 6), r["w01"]) for r in text.matrix_fragments(spark, path).collect())
    assert got == [(0, 2, 1.2, 0.3, 0.1), (1, 2, 2.0, 0.0, 0.0)]


def test_calls_with_a_column_for_each_allele(spark, tmp_path):
    def line(kind, ref, a, b, qa, qb, ra, rb, zygosity="het"):
        f = [""] * 25
        f[0], f[2], f[3], f[5], f[6], f[7], f[8], f[9], f[10], f[11], f[21], f[22], f[24] = "7", "c", "10", zygosity, kind, ref, a, b, qa, qb, ra, rb, "30"
        return "\t".join(f)

    lines = ["#x", line("snp", "A", "A", "C", "40", "50", "9", "11"), line("snp", "A", "C", "C", "40", "50", "9", "9"), line("del", "AC", "", "AC", "40", "30", "9", "4"), line("snp", "A", "C", "G", "40", "50", "9", "11"), line("snp", "A", "C", "?", "40", "0", "9", ""), line("ref", "A", "A", "A", "1", "1", "", ""), line("snp", "A", "?", "?", "1", "1", "", "", "no-call")]
    got = [tuple(r)[2:] for r in text.allele_calls(spark, put(tmp_path, "v", "\n".join(lines) + "\n")).collect()]
    assert got == [
        ("A", ["C"], 50.0, 30, [9, 11], [0, 1], 40), ("A", ["C"], 50.0, 30, [0, 9], [1, 1], 40), ("NAC", ["N"], 40.0, 30, [4, 9], [0, 1], 30), ("A", ["C", "G"], 50.0, 30, [0, 20], [1, 2], 40), ("A", ["C"], 40.0, 30, [0, 9], [None, None], 0),
    ]
