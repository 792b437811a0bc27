import gzip

from strandline.plans import mapper
from strandline.operators import intervals, sketch
from strandline.sources import records as R
from tests import scalar


def write(path, text, zipped=False):
    f = gzip.open(path, "wb") if zipped else open(path, "wb")
    with f:
        f.write(text.encode())
    return str(path)


def rows(df):
    return [(r.rid, r.name, r.comment, r.seq) for r in df.orderBy("rid").collect()]


def test_fasta(spark, tmp_path):
    p = write(tmp_path / "x.fa", ">seq1 first one\nACGT\r\nAC\r\n>seq2\nTGCU\n\n>seq3\n")
    assert rows(R.read_sequences(spark, p)) == [(0, "seq1", "first one", "ACGTAC"), (1, "seq2", "", "TGCT"), (2, "seq3", "", "")]
    p = write(tmp_path / "y.fa", "name without mark\nAC>mid\nGT")
    assert rows(R.read_sequences(spark, p)) == [(0, "name", "without mark", "AC"), (1, "mid", "", "GT")]
    assert R.longest_id(R.read_sequences(spark, p)).first()[0] == 4


def test_fastq_with_mixed_line_ends(spark, tmp_path):
    text = "".join(f"{chr(0xFEFF) if i == 3 else ''}@r{i} c\n{'ACGU' * 5}\n+\n{'I' * 20}\n".replace("\n", "\r\n" if i % 2 else "\n") for i in range(9))
    for name, z in (("x.fq", False), ("x.fastq.gz", True)):
        got = R.read_sequences(spark, write(tmp_path / name, text, z)).orderBy("rid").collect()
        assert [r.name for r in got] == [f"r{i}" for i in range(9)] and {r.seq for r in got} == {"ACGT" * 5} and {r.qual for r in got} == {"I" * 20}


def test_pairs_and_fragments(spark):
    a = R.from_strings(spark, ["A", "C", "G"], ["x/1", "y/1", "z/1"])
    b = R.from_strings(spark, ["T", "G"], ["x/2", "y/2"])
    got = sorted((r.frag_id, r.seg, r.name, r.seq) for r in R.read_paired(a, b).collect())
    assert got == [(0, 0, "x", "A"), (0, 1, "x", "T"), (1, 0, "y", "C"), (1, 1, "y", "G")]
    inter = R.from_strings(spark, list("ACGTA"), ["x/1", "x/2", "y", "z/1", "z/2"])
    assert [(r.frag_id, r.seg) for r in R.fragments(inter).orderBy("rid").collect()] == [(0, 0), (0, 1), (2, 0), (3, 0), (3, 1)]


def test_positions_of_a_file(spark, tmp_path):
    body = "ACGTTGCATGCCGATAGCTAGCTAGGATCGATCGATTAGCTAGGCTCTATATCGCGCGATT"
    p = write(tmp_path / "x.fa", f">a\n{body}NN{body.lower()}\n>b\nACG\n")
    got = sorted((r.rid, r.pos) for r in mapper.extract_positions(spark, p).collect())
    one = scalar.syncmers(body, 31, 11)
    assert got == [(0, x) for x in one] + [(0, x + len(body) + 2) for x in one]
    full = {(r.rid, r.pos): r.hash & (1 << 64) - 1 for r in mapper.extract_full(spark, p).collect()}
    for x in one:
        k = body[x : x + 31]
        assert full[(0, x)] == scalar.mix64(min(scalar.code(k), scalar.code(scalar.rc(k))))


def test_packing_round_trip(spark):
    seqs = ["", "A", "ACGT", "TTTTG", "GATTACA" * 9]
    df = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    p = R.packed_2bit(df)
    assert p.filter("seq_id = 2").first().packed == bytes([0b11100100])
    assert [r.seq for r in R.unpacked_2bit(p).orderBy("seq_id").collect()] == seqs


def test_tables_of_a_reference(spark, tmp_path):
    bed = write(tmp_path / "x.bed", "chr1\t100\t900\tt\t500\t+\t0\t0\t0\t3\t50,60,70,\t0,200,730,\nchr1\t100\t900\tu\t7\t+\t0\t0\t0\t2\t50,70\t0,730\n#c\n")
    got = sorted((r.chrom, r.st, r.en, r.cnt) for r in intervals.introns_of_bed12(R.read_bed12(spark, bed), 10).collect())
    assert got == [("chr1", 150, 300, 1), ("chr1", 360, 830, 1)]
    sp = write(tmp_path / "s.tsv", "chr1\t10\t+\tD\t80\nchr1\t99\t-\tA\t-2.5\nchrX\t1\t+\tD\t1\n")
    refs = spark.createDataFrame([("chr1", 0, 50)], "name string, rid long, len long")
    assert [(r.pos, r.strand, r.score) for r in intervals.splice_scores(R.read_splice_scores(spark, sp), refs).collect()] == [(10, 1, 63)]
    names = write(tmp_path / "alt.txt", "chr1 note\n\n")
    assert intervals.mark_alt(refs, R.read_names(spark, names)).first().is_alt


def test_gaps_break_kmers(spark):
    df = spark.createDataFrame([(1, "xxACGTNacgt"), (2, None), (3, "")], "seq_id long, text string")
    got = sorted((r.seq_id, r.file_offset, r.logical_len, r.type) for r in sketch.segments(df).collect())
    assert got == [(1, 0, 2, "N_GAP"), (1, 2, 4, "BASES"), (1, 6, 1, "N_GAP"), (1, 7, 4, "BASES")]


def test_folders_of_files_in_many_splits(spark, tmp_path):
    """Every record of every file as a plain reading has it, in order, though splits and tasks mix files."""
    want_q, want_a = [], []
    for d in ("q", "a"):
        (tmp_path / d).mkdir()
    for f in range(3):
        q = [(f"f{f}r{i}", "ACGT" * (10 + i % 7) + "ACGT"[i % 4], "I" * (41 + i % 5)) for i in range(90 + f)]
        write(tmp_path / "q" / f"{f}.fq", "".join(f"@{n} c\n{s}\n+\n{x}\n" for n, s, x in q))
        write(tmp_path / "a" / f"{f}.fa", "".join(f">{n} c\n{s[:20]}\n{s[20:]}\n" for n, s, _ in q))
        want_q += q
        want_a += [(n, s) for n, s, _ in q]
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = R.read_fastq(spark, str(tmp_path / "q")).orderBy("rid").collect()
        assert [(r.name, r.seq, r.qual) for r in got] == want_q and [r.rid for r in got] == list(range(len(want_q)))
        got = R.read_fasta(spark, str(tmp_path / "a")).orderBy("rid").collect()
        assert [(r.name, r.seq) for r in got] == want_a and [r.rid for r in got] == list(range(len(want_a)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
