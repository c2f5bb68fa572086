import bz2
import gzip
import json
import lzma
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from hashloom import cli
from hashloom.functions.kmers import hashes
from hashloom.model import from_rows
from hashloom.operators.sketch import digests, sketch
from hashloom.sources import fastx, sinks
from hashloom.sources.fromfile import matching, read_fromfile
from hashloom.sources.loader import LoadError, load
from hashloom.sources.signatures import read_manifest
from hashloom.sources.similarity import read_similarities

FASTA = ">one first\nACGTACGTTGCA\nGATTACA\n>two\nACGTNACGTTTGCAACGGT\n"
FASTQ = "@r1\nACGTACGTAC\n+\nIIIIIIIIII\n"


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "a.fa").write_text(FASTA)
    (tmp_path / "b.fq").write_text(FASTQ)
    (tmp_path / "c.fa.gz").write_bytes(gzip.compress(FASTA.encode()))
    (tmp_path / "p.fa").write_text(">p\nMKVLAAGIVGLLLAQWERTY\n")
    (tmp_path / "bad.txt").write_text("nothing here\n")
    return tmp_path


def test_fastx(spark, files):
    rows = fastx.read_fastx(spark, [str(files / n) for n in ("a.fa", "b.fq", "c.fa.gz")]).collect()
    got = {(r.filename.rsplit("/", 1)[1], r.record_ix): (r.record_id, bytes(r.seq)) for r in rows}
    assert got["a.fa", 0] == ("one first", b"ACGTACGTTGCAGATTACA") == got["c.fa.gz", 0]
    assert got["b.fq", 0] == ("r1", b"ACGTACGTAC") and len(got) == 5
    assert fastx.from_bytes(spark, b"").count() == 0
    with pytest.raises(Exception, match="neither FASTA nor FASTQ"):
        fastx.read_fastx(spark, str(files / "bad.txt")).count()


def test_packed_fastx():
    zstandard = pytest.importorskip("zstandard")
    data = FASTA.encode()
    frames = [zstandard.ZstdCompressor().compress(part) for part in (data[:20], data[20:])]
    for packed in (data, gzip.compress(data), bz2.compress(data), lzma.compress(data), b"".join(frames)):
        assert fastx.plain(packed) == data


def test_prefixes_are_globs_of_files(spark, files):
    (files / "a.fa.d").mkdir()
    (files / "a.fa.d" / "x.fa").write_text(FASTA)
    want = {str(files / n) for n in ("a.fa", "p.fa")}
    assert matching(spark, f"{files}/[ap].fa") == want == matching(spark, f"file://{files}/[ap].fa")
    assert matching(spark, f"{files}/none") == set() == matching(spark, f"{files}/no/such/")


def test_sketch_round_trips(spark, files, tmp_path):
    sk = cli.singlesketch(spark, [str(files / "a.fa")], ["k=5,scaled=1,abund_k=7,scaled=2"], name="sample")
    assert {(r.ksize, r.scaled, r.with_abundance, r.name) for r in sk.manifest.collect()} == {(5, 1, True, "sample"), (7, 2, False, "sample")}
    want = {int(h) for seq in (b"ACGTACGTTGCAGATTACA", b"ACGTNACGTTTGCAACGGT") for hs, _ in hashes(seq, "DNA", 5) for h in hs}
    assert {r.hash for r in sk.select(ksize=5).postings.collect()} == want
    out = str(tmp_path / "x.zip")
    sinks.write_zip(sk, out)
    back = load(spark, out)
    assert sorted(r.md5 for r in back.manifest.collect()) == sorted(r.md5 for r in sk.manifest.collect())
    assert sorted((r.hash, r.abund) for r in back.postings.collect()) == sorted((r.hash, r.abund) for r in sk.postings.collect())
    assert {r.md5 for r in digests(back.postings, back.manifest.select("sketch_id", "ksize_nt")).collect()} == {r.md5 for r in sk.manifest.collect()}
    sinks.write_manifest(back, str(tmp_path / "m.csv"))
    assert read_manifest(spark, str(tmp_path / "m.csv")).count() == 2
    with pytest.raises(ValueError):
        sinks.write_zip(sk, str(tmp_path / "x.txt"))
    sinks.write_signatures(sk, str(tmp_path / "x.sig.gz"))
    assert load(spark, str(tmp_path / "x.sig.gz"), 5, "DNA").postings.count() == len(want)


def test_bottom_sketch_and_singletons(spark, files):
    rows = fastx.read_fastx(spark, str(files / "a.fa")).select(F.lit("s").alias("name"), F.lit("dna").alias("input_moltype"), "filename", "record_id", "seq")
    every = sketch(rows, "dna,k=4,scaled=1").postings
    few = sketch(rows, "dna,k=4,num=3").postings
    assert sorted(r.hash % (1 << 64) for r in few.collect()) == sorted(r.hash % (1 << 64) for r in every.collect())[:3]
    assert {r.name for r in sketch(rows, "dna,k=4,scaled=1", singleton=True).manifest.collect()} == {"one first", "two"}
    short = sketch(rows, "dna,k=51,scaled=1")
    assert short.manifest.first().n_hashes == 0 and short.postings.count() == 0
    assert sketch(rows, "protein").manifest.count() == 0


def test_fromfile(spark, files):
    def put(text):
        (files / "list.csv").write_text(text)
        return str(files / "list.csv")

    a, p = files / "a.fa", files / "p.fa"
    got = read_fromfile(spark, put(f"name,genome_filename,protein_filename\nx,{a},{p}\nx,{a},{p}\ny,,{p}\n")).collect()
    assert sorted((r.name, r.input_moltype) for r in got) == [("x", "dna"), ("x", "protein"), ("y", "protein")]
    got = read_fromfile(spark, put(f"name,read1,read2\nx,{a},\n")).first()
    assert got.paths == [str(a)]
    got = read_fromfile(spark, put(f"name,input_moltype,prefix,exclude\nx,DNA,{files}/,{files}/p\n".replace(f"{files}/,", f"{files}/a,"))).first()
    assert got.paths == [str(a)]
    twice = put(f"name,input_moltype,prefix,exclude\nx,DNA,{files}/a,\ny,DNA,{files}/a,\n")
    with pytest.raises(ValueError, match="Duplicated"):
        read_fromfile(spark, twice)
    assert read_fromfile(spark, twice, force=True).count() == 2
    with pytest.raises(ValueError, match="Invalid header"):
        read_fromfile(spark, put("a,b\n1,2\n"))
    sk = cli.manysketch(spark, put(f"name,genome_filename,protein_filename\nx,{a},{p}\n"), ["dna,k=5,scaled=1", "hp,k=4,scaled=1"])
    assert {(r.moltype, r.ksize_nt) for r in sk.manifest.collect()} == {("DNA", 5), ("hp", 12)}


def test_loader(spark, files, tmp_path):
    sk = cli.singlesketch(spark, [str(files / "a.fa")], ["dna,k=5,scaled=1"])
    one, two = str(tmp_path / "one.sig"), str(tmp_path / "two.zip")
    sinks.write_signatures(sk, one)
    sinks.write_zip(sk, two)
    paths = tmp_path / "paths.txt"
    paths.write_text(f"{one}\n{two}\n{one}\n/no/such/file\n")
    assert load(spark, str(paths)).manifest.count() == 2
    with pytest.raises(LoadError):
        load(spark, str(paths), allow_failed=False)
    with pytest.raises(LoadError):
        load(spark, one, ksize=99)
    with pytest.raises(LoadError):
        load(spark, "/no/such/file")
    with pytest.raises(LoadError):
        load(spark, str(tmp_path))
    m = tmp_path / "manifest.csv"
    sinks.write_manifest(sk, str(m))
    m.write_text(m.read_text().replace(f"signatures/{sk.manifest.first().md5}.sig.gz", one))
    assert load(spark, str(m)).manifest.count() == 1


def test_similarity_reader(spark, tmp_path):
    sk = from_rows(spark.createDataFrame([("a", 1), ("a", 2), ("b", 2)], "id string, hash long"), "id", "hash")
    from hashloom.operators.overlap import pairwise

    out = str(tmp_path / "pw.csv")
    sinks.write_csv(pairwise(sk, ani=True), out, single=True)
    assert read_similarities(spark, out).first().jaccard == 0.5
    (tmp_path / "bad.csv").write_text("query_name\nx\n")
    with pytest.raises(ValueError, match="missing column"):
        read_similarities(spark, str(tmp_path / "bad.csv"))


def test_pretty(spark):
    sk = from_rows(spark.createDataFrame([("a-very-long-name-indeed", 1), ("b", 1)], "id string, hash long"), "id", "hash")
    from hashloom.operators.overlap import manysearch

    lines = [r.line for r in sinks.pretty(manysearch(sk, sk)).collect()]
    assert len(lines) == 4 and lines[0].startswith("a-very-long-name-  100.0%") and lines[-1].endswith("     b")


def test_commands(spark, files, tmp_path, capsys):
    a = str(files / "a.fa")
    z = str(tmp_path / "s.zip")
    assert cli.main(["singlesketch", a, "-o", z, "-p", "k=5,scaled=1,abund", "-n", "s"]) == 0
    for command in (["multisearch", z, z, "-a", "-p"], ["manysearch", z, z], ["fastgather", z, z, "-t", "0"], ["fastmultigather", z, z, "-t", "0"]):
        assert cli.main([*command, "-k", "5"]) == 0
        assert "s" in capsys.readouterr().out
    assert cli.main(["pairwise", z, "-k", "5"]) == 1  # a single sketch
    ix = str(tmp_path / "ix")
    assert cli.main(["index", z, "-k", "5", "-o", ix]) == 0 and cli.main(["check", ix]) == 0 and cli.main(["check", ix, "--upgrade", "--quick"]) == 0
    assert cli.main(["manysearch", z, ix, "-k", "5", "-o", str(tmp_path / "o1")]) == 0
    assert cli.main(["fastmultigather", z, ix, "-k", "5", "-t", "0", "-o", str(tmp_path / "o2")]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "o1")).first().containment == "1.0"
    pre = str(tmp_path / "pre")
    assert cli.main(["fastmultigather", z, z, "-k", "5", "-t", "0", "-o", str(tmp_path / "o3"), "--output-prefetch", pre]) == 0
    assert [r["query"] for r in spark.read.option("header", True).csv(pre).collect()] == ["s"]
    assert cli.main(["multisearch", "/no/such", z]) == 1
    (files / "l.csv").write_text(f"name,genome_filename,protein_filename\nx,{a},\ny,{files / 'c.fa.gz'},\n")
    many = str(tmp_path / "m.zip")
    assert cli.main(["manysketch", str(files / "l.csv"), "-o", many, "-p", "dna,k=5,scaled=1"]) == 0
    assert cli.main(["manysketch", str(files / "l.csv"), "-o", "m.txt", "-p", "dna"]) == 1
    pw = str(tmp_path / "pw")
    assert cli.main(["pairwise", many, "-k", "5", "-a", "-o", pw]) == 0
    assert cli.main(["cluster", pw, "-o", str(tmp_path / "cl"), "--cluster-sizes", str(tmp_path / "cs")]) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "cl")).first().nodes == "x;y"


def test_streaming(spark, tmp_path):
    from hashloom.streaming.incremental import search_stream

    against = from_rows(spark.createDataFrame([("m", 1), ("m", 2)], "id string, hash long"), "id", "hash")
    spark.createDataFrame([("q", 1), ("q", 5)], "id string, hash long").write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("id string, hash long").parquet(str(tmp_path / "in"))
    search_stream(stream, against, "id", "hash", lambda df, n: got.extend(df.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert [(r.query_id, r.match_id, r.containment) for r in got] == [("q", "m", 0.5)]


def test_entry_without_extras(tmp_path):
    code = "import json, __spark_entry__ as e; print(json.dumps([len(e.queries()), len(e.oracle_sql())]))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=str(__import__("pathlib").Path(__file__).resolve().parent.parent), timeout=120)
    n, m = json.loads(out.stdout.strip().splitlines()[-1])
    assert n >= 40 and m >= 40


def test_pretty_rounds_the_exact_value(spark):
    """One decimal as printf gives it: ties to the even digit, and 0.35 lies below its tie."""
    rng = random.Random(3)
    values = [k / 8 for k in range(801)] + [k / 20 for k in range(2001)] + [100 * a / b for b in range(1, 90) for a in range(b + 1)]
    values += [rng.random() * 10 ** rng.randint(-9, 12) for _ in range(3000)] + [5e-324, 0.05, 0.95, 9.95, 2.0**49 + 0.25]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", sinks.tenths(F.col("v")).alias("t")).collect()
    assert [(r.v, r.t) for r in rows if r.t != f"{r.v:.1f}"] == []
