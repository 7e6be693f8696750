"""Readers on small files written here."""

from __future__ import annotations

import base64
import gzip
import struct
import zlib

import pytest

from strandline.operators.peptides import best_matches, digest, fragment_ions, hyperscore, infer_proteins, peptide_mass, phosphorylated, precursor_candidates, with_decoys
from strandline.sources import text as S
from strandline.sources.spectra import clean_peaks, read_mzml


@pytest.fixture
def put(tmp_path):
    def write(name: str, body: str) -> str:
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(gzip.compress(body.encode()) if name.endswith(".gz") else body.encode())
        return str(path)

    return write


def test_vcf(spark, put):
    body = "##x\n#CHROM\tPOS\n1\t10\t.\tA\tG\t50\tPASS\tAF=0.5,0.1;GENE=TP53\nchr2\t20\t.\tC\tT\t.\tPASS\tAF1=0.25;ANN=T|x|y|BRCA1|z\r\n3\t-4\t.\tA\tG\t1\tPASS\n4\t5\t.\tA\n"
    for name in ("a.vcf", "a.vcf.gz"):
        rows = S.read_vcf(spark, put(name, body)).orderBy("pos").collect()
        assert [(r.chrom, r.pos, r.qual, round(r.af, 4), r.gene) for r in rows] == [("1", 10, 50.0, 0.5, "TP53"), ("chr2", 20, 0.0, 0.25, "BRCA1")]


def test_cnv_vcf(spark, put):
    body = "1\t10\t.\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;END=90;LOG2=-1.5\n1\t20\t.\tN\t<X>\t.\tPASS\tSVTYPE=INV\n1\t30\t.\tN\t.\t.\tPASS\tTCN=4.5\n"
    rows = S.read_cnv_vcf(spark, put("c.vcf", body)).orderBy("start_pos").collect()
    assert [(r.start_pos, r.end_pos, r.copy_number, r.log2_ratio) for r in rows] == [(10, 90, 1.0, -1.5), (30, 31, 4.5, None)]


def test_expression_and_methylation(spark, put):
    rows = S.read_expression(spark, put("e.tsv", "gene\ts1\ts2\nA\t1.5\tx\n\t2\t3\nB\t 4 \n")).orderBy("gene_id", "sample_no").collect()
    assert [(r.gene_id, r.sample_id, r.value) for r in rows] == [("A", "s1", 1.5), ("A", "s2", 0.0), ("B", "s1", 4.0), ("B", "s2", 0.0)]
    bed = "track x\n1\t5\t6\t.\t800\t+\n1\t7\t8\t0.5\n1\t9\t10\t150\n1\t11\t12\tG1\t2000\n1\tx\t12\tG1\t20\n"
    rows = S.read_methylation(spark, put("m.bed", bed)).orderBy("start_pos").collect()
    assert [(r.start_pos, r.methylation, r.gene) for r in rows] == [(5, 80.0, "."), (7, 50.0, None), (9, 100.0, None), (11, 100.0, "G1")]


def test_checked_formats_and_gmt(spark, put):
    good, bad = S.read_checked(spark, put("p.narrowPeak", "chr1\t1\t9\tn\t5\t.\t1\t2\t3\t-1\nchr1\t9\t1\tn\t5\t.\t1\t2\t3\t-1\n"), "narrowpeak")
    assert good.count() == 1 and [r.reason for r in bad.collect()] == ["invalid_value"]
    row = S.read_gmt(spark, put("g.gmt", "# c\nset\tabout\ttp53\t\tBrca1\n")).first()
    assert (row.set_name, row.genes) == ("set", ["TP53", "BRCA1"])


def test_features(spark, put):
    line = lambda f, a, b, t: f'1\tx\t{f}\t{a}\t{b}\t.\t+\t.\tgene_id "G1"; transcript_id "{t}"; gene_name "N";'
    path = put("a.gtf", "\n".join([line("exon", 11, 20, "T1"), line("exon", 31, 40, "T1"), line("exon", 35, 60, "T2"), "1\tx\tgene\t5\t70\t.\t+\t.\tID=g;gene_id=G2"]))
    features = S.read_features(spark, path)
    spans = {r.gene_id: (r.start_pos, r.end_pos) for r in S.gene_spans(features).collect()}
    assert spans == {"G1": (10, 60), "G2": (4, 70)}
    assert [(r.donor, r.acceptor) for r in S.splice_junctions(features).collect()] == [(20, 30)]


def test_sequences(spark, put):
    fasta = put("r.fa", ">chr1 first > one\nacgt\nNNrg\n>chr2\nTT\n>empty\n")
    assert {r.name: r.sequence for r in S.read_fasta(spark, fasta).collect()} == {"chr1": "ACGTNNRG", "chr2": "TT"}
    assert S.read_fasta(spark, fasta, only_bases=True).filter("name = 'chr1'").first().sequence == "ACGTNNNG"
    fastq = put("q.fastq", "@r1\nACGT\n+\n@?!I\n@r2\nGG\n+\nII\n")
    row = S.fastq_quality(spark, fastq).first()
    assert (row.n_reads, row.n_bases, row.mean_length) == (2, 6, 3.0)
    assert row.gc_pct == pytest.approx(400 / 6) and row.q30_pct == pytest.approx(500 / 6)


def test_mex(spark, put, tmp_path):
    put("x/matrix.mtx", "%%MatrixMarket\n%c\n3 2 3\n1 1 5\n3 1 2\n2 2 7\n")
    put("x/barcodes.tsv.gz", "AA\nBB\n")
    put("x/features.tsv", "id1\tG1\nid2\tG2\nid3\n")
    rows = S.read_mex(spark, str(tmp_path / "x")).orderBy("barcode", "feature").collect()
    assert [(r.barcode, r.feature, r.n) for r in rows] == [("AA", "G1", 5), ("AA", "id3", 2), ("BB", "G2", 7)]


def _mzml(spectra) -> str:
    def array(values, kind, packed):
        raw = struct.pack(f"<{len(values)}d", *values)
        raw = zlib.compress(raw) if packed else raw
        marks = f'<cvParam accession="MS:1000523"/><cvParam accession="{kind}"/>' + ('<cvParam accession="MS:1000574"/>' if packed else "")
        return f"<binaryDataArray>{marks}<binary>{base64.b64encode(raw).decode()}</binary></binaryDataArray>"

    body = "".join(
        f'<spectrum><cvParam accession="MS:1000511" value="2"/><scan><cvParam accession="MS:1000016" value="0.5"/></scan>'
        f'<selectedIon><cvParam accession="MS:1000744" value="{mz}"/><cvParam accession="MS:1000041" value="1"/></selectedIon>'
        f"{array(x, 'MS:1000514', i % 2)}{array(y, 'MS:1000515', i % 2)}</spectrum>"
        for i, (mz, x, y) in enumerate(spectra)
    )
    return f'<mzML xmlns="http://psi.hupo.org/ms/mzml"><run>{body}</run></mzML>'


def test_search_finds_the_peptide_of_a_spectrum(spark, put):
    proteins = spark.createDataFrame([("P1", "MAGICPEPTIDEKSAMPLERGGGGGGK"), ("P2", "LLLLLLLKPPPPR"), ("P3", "XXXXXXK")], "name string, sequence string")
    peptides = digest(proteins)
    found = {r.peptide: r for r in peptides.collect()}
    assert "MAGICPEPTIDEK" in found and "LLLLLLLKPPPPR" in found and "XXXXXXK" not in found
    assert found["MAGICPEPTIDEKSAMPLER"].n_missed == 1
    both = with_decoys(peptides)
    assert both.filter("is_decoy and peptide = 'EDITPEPCIGAMK'").count() == 1
    b, y = fragment_ions(both["peptide"])
    target = both.filter("peptide = 'MAGICPEPTIDEK'").select(b.alias("b"), y.alias("y"), peptide_mass(both["peptide"]).alias("mass")).first()
    assert target.b[-1] + target.y[0] == pytest.approx(target.mass + 2 * 1.007276)
    peaks = sorted((m, 10.0) for m in target.b + target.y)
    mz, intensity = [p[0] for p in peaks], [p[1] for p in peaks]
    path = put("run/a.mzML", _mzml([(target.mass + 1.007276, mz, intensity), (target.mass + 1.007276, mz[:3], [1.0, 100.0, 0.5])]))
    spectra = read_mzml(spark, path.rsplit("/", 1)[0])
    assert [(r.scan, r.ms_level, r.rt) for r in spectra.orderBy("scan").collect()] == [(1, 2, 30.0), (2, 2, 30.0)]
    assert clean_peaks(spectra).filter("scan = 2").first().intensity == pytest.approx([0.01, 1.0])
    best = best_matches(hyperscore(precursor_candidates(spectra, both, ppm=20.0), ppm=50.0), spectrum=["path", "scan"])
    first = best.filter("scan = 1").first()
    assert (first.peptide, first.is_decoy, first.n_b, first.n_y) == ("MAGICPEPTIDEK", False, 12, 12) and first.delta > 0
    assert infer_proteins(best.filter("scan = 1")).first().n_peptides == 1


def test_phosphorylation(spark):
    peptides = spark.createDataFrame([("ASTKY", 500.0)], "peptide string, mass double")
    rows = phosphorylated(peptides, most=2).collect()
    assert sorted(tuple(r.sites) for r in rows) == [(), (2,), (2, 3), (2, 5), (3,), (3, 5), (5,)]
    assert {len(r.sites): round(r.mass, 3) for r in rows} == {0: 500.0, 1: 579.966, 2: 659.933}
