import gzip
import hashlib

import pytest
from genomes import brute_bins, calls, write_genotype, write_plink, write_vcf

from ldspark import cli, sinks
from ldspark.config import LdConfig, OptionError, parse
from ldspark.operators import aggregates, blocks, ehh, pairs, rebin, regions
from ldspark.operators.sites import keep_first, union_inputs
from ldspark.plans.run import execute
from ldspark.sources import files, results

CFG = LdConfig(max_kb=10)


def bins(sites, out_type=1, n_hap=None, max_dist=10_000):
    rows = aggregates.decay(keep_first(files.kept(sites)), out_type, max_dist, n_hap).collect()
    return {r["dist"]: (r["n"], round(r["sum_rr"], 8)) for r in rows}


def close(a, b):
    assert a.keys() == b.keys()
    for k, (n, s) in a.items():
        assert n == b[k][0] and (b[k][1] is None or s == pytest.approx(b[k][1], abs=1e-6)), k


@pytest.fixture(scope="module")
def rows():
    return calls()


def test_vcf_matches_brute_force(spark, tmp_path, rows):
    for phased in (False, True):
        for name in ("a.vcf", "a.vcf.gz"):
            path = write_vcf(tmp_path / f"{phased}{name}", rows, phased)
            sites = files.read_vcf(spark, path, CFG)
            close(bins(sites, n_hap=40), brute_bins(rows, 10_000, phased=phased))


def test_block_kernel_and_folded_popcounts_match_the_join(spark, tmp_path, rows):
    sites = keep_first(files.kept(files.read_vcf(spark, write_vcf(tmp_path / "a.vcf", rows), CFG))).persist()
    for t in (1, 2, 7):
        a, b, c = ({r["dist"]: r for r in x.collect()} for x in (aggregates.decay(sites, t, 10_000, 40), aggregates.decay(sites, t, 10_000), blocks.decay_by_blocks(sites, t, 10_000)))
        assert a.keys() == b.keys() == c.keys()
        for k in a:
            for other in (b[k], c[k]):
                assert a[k]["n"] == other["n"] and a[k]["sum_rr"] == pytest.approx(other["sum_rr"]) and a[k]["sum_d"] == (other["sum_d"] if t != 2 else pytest.approx(other["sum_d"]))


def test_plink_equals_unphased_vcf(spark, tmp_path, rows):
    a = bins(files.read_vcf(spark, write_vcf(tmp_path / "a.vcf", rows), CFG))
    b = bins(files.read_plink(spark, write_plink(tmp_path / "p", rows), CFG))
    close(a, b)


def test_genotype_group_equals_vcf(spark, tmp_path, rows):
    every = [("g", list(range(20)))]
    a = bins(files.read_vcf(spark, write_vcf(tmp_path / "a.vcf", rows), CFG, every))
    close(a, bins(files.read_genotype(spark, write_genotype(tmp_path / "a.geno", rows), CFG, every)))


def test_genotype_without_groups(spark, tmp_path):
    path = tmp_path / "g"
    path.write_text("# x\nc\t5\tA A R G N Z\nc\t9\tA A A A A A\nc\t11\tA C G A A A\nbad\n")
    rows = files.read_genotype(spark, str(path), LdConfig(miss=0.5)).orderBy("pos").collect()
    assert [r["reason"] for r in rows] == ["biallelic", "maf", "biallelic"]  # Z counts as an allele of its own
    path.write_text("c\t5\tA A R G N -\n")
    (r,) = files.read_genotype(spark, str(path), LdConfig(miss=0.5)).collect()
    assert r["reason"] is None and r["minor"] == [0b000011_10_0000] and r["miss"] == [0b1111_0000_0000]


def test_ploidy(spark, tmp_path, rows):
    def text(f):
        lines = (tmp_path / "base.vcf").read_text().splitlines()
        return "\n".join(x if x.startswith("#") else "\t".join(x.split("\t")[:9] + [f(g) for g in x.split("\t")[9:]]) for x in lines) + "\n"

    write_vcf(tmp_path / "base.vcf", [(c, p, [None if g is None else (g[0], g[0]) for g in gts]) for c, p, gts in rows])
    (tmp_path / "hap.vcf").write_text(text(lambda g: g[0]))
    (tmp_path / "poly.vcf").write_text(text(lambda g: f"{g}/{g[0]}"))
    heads = [files.vcf_header(spark, str(tmp_path / f"{n}.vcf")) for n in ("base", "hap", "poly")]
    assert [(h.haploid, h.polyploid) for h in heads] == [(False, False), (True, False), (False, True)]
    a, b, c = (bins(files.read_vcf(spark, str(tmp_path / f"{n}.vcf"), CFG)) for n in ("base", "hap", "poly"))
    assert a == b == c and a


def test_indels_duplicates_and_bad_heads(spark, tmp_path, rows):
    extra = ["chr1\t5\t.\tAT\tA\t.\t.\t.\tGT\t" + "\t".join(["0/1"] * 20), "chr1\t7\t.\tA\tC\t.\t.\t.\tGT\t" + "\t".join(["0/0"] * 20),
             "chr1\t7\t.\tA\tC\t.\t.\t.\tGT\t" + "\t".join(["0/1", "1/1"] + ["0/0"] * 18), "chr1\t7\t.\tA\tC\t.\t.\t.\tGT\t" + "\t".join(["1/1"] * 3 + ["0/0"] * 17)]
    sites = files.read_vcf(spark, write_vcf(tmp_path / "a.vcf", rows, extra=extra), CFG)
    counts = {r["reason"]: r["n"] for r in aggregates.skip_counts(sites).collect()}
    assert counts["indel"] == 1 and counts["biallelic"] >= 1
    (kept,) = keep_first(files.kept(sites)).filter("pos = 7").collect()
    assert kept["minor_count"] == 3  # the first kept one, not the monomorphic one before it
    (tmp_path / "b.vcf").write_text("chr1\t1\n")
    with pytest.raises(ValueError, match="#CHROM"):
        files.vcf_header(spark, str(tmp_path / "b.vcf"))


def test_bad_plink(spark, tmp_path, rows):
    p = write_plink(tmp_path / "p", rows)
    raw = (tmp_path / "p.bed").read_bytes()
    (tmp_path / "p.bed").write_bytes(raw[:2] + b"\0" + raw[3:])
    with pytest.raises(ValueError, match="variant-major"):
        files.read_plink(spark, p, CFG)
    (tmp_path / "p.bed").write_bytes(raw[:-1])
    with pytest.raises(ValueError, match="bytes"):
        files.read_plink(spark, p, CFG)
    (tmp_path / "p.fam").write_text("F A\nF A\n")
    with pytest.raises(ValueError, match="twice"):
        files.plink_names(spark, p)


def test_regions(spark, tmp_path, rows):
    found = regions.load_regions("chr1:1-100,chr1:20-30")
    df = spark.createDataFrame([("chr1", p) for p in (10, 25, 50)], "contig string, pos long")
    frame = regions.region_frame(spark, found)
    assert {(r[0], r[1]) for r in regions.assign(df, frame).collect()} == {("chr1:1-100", 10), ("chr1:20-30", 25)}
    assert regions.assign(df, frame, strict_compat=False).count() == 4
    bed = tmp_path / "x.bed"
    bed.write_text("track\nchr1 0 100\nbad\nchr1 0 100\nchr2\t9\t10\n")
    with pytest.warns(UserWarning):
        assert regions.load_regions(str(bed)) == [("chr1", 1, 100, "chr1:1-100"), ("chr2", 10, 10, "chr2:10-10")]
    with gzip.open(tmp_path / "x.bed.gz", "wt") as f:
        f.write("chr1 0 100\n")
    assert regions.load_regions(str(tmp_path / "x.bed.gz")) == [("chr1", 1, 100, "chr1:1-100")]
    with pytest.raises(ValueError):
        regions.load_regions("chr1:9-3")
    # a region's result is that of a file with its sites only
    path = write_vcf(tmp_path / "a.vcf", rows)
    part = write_vcf(tmp_path / "b.vcf", [r for r in rows if r[0] == "chr1"])
    assert bins(files.read_vcf(spark, path, CFG, regions=regions.load_regions("chr1"))) == bins(files.read_vcf(spark, part, CFG))


def test_sample_lists(tmp_path):
    (tmp_path / "a b.list").write_text("S1\nS2\nS3\nS9\n")
    (tmp_path / "g.txt").write_text("S1 x\nS2 x\nS3 x\nS4 y\nS5 y\nS6 y\n")
    assert files.sample_groups((str(tmp_path / "a b.list"),)) == [("", ["S1", "S2", "S3", "S9"])]
    two = files.sample_groups((str(tmp_path / "g.txt"), str(tmp_path / "a b.list")))
    assert [g[0] for g in two] == ["x", "y", "a_b.list"]
    assert files.resolve(two[:1], ["S3", "S2", "S1", "S1"]) == [("x", [0, 1, 2, 3])]
    with pytest.raises(ValueError, match="3 are needed"):
        files.resolve([("x", ["S1"])], ["S1", "S2"])


def test_ped_converter(spark, tmp_path):
    (tmp_path / "x.map").write_text("1 a 0 100\n1 b 0 -200\n")
    (tmp_path / "x.ped").write_text("F A 0 0 0 0 1 1 2 0\nF B 0 0 0 0 1 3 0 0\nF C 0 0 0 0 0 4 N 2\n")
    rows = files.ped_to_genotype(spark, str(tmp_path / "x.ped"), str(tmp_path / "x.map")).orderBy("seq").collect()
    assert [(r["contig"], r["pos"], r["codes"]) for r in rows] == [("1", 100, ["A", "R", "T"]), ("1", 200, ["C", "-", "NC"])]


def test_run_writes_the_established_files(spark, tmp_path, rows):
    vcf = write_vcf(tmp_path / "a.vcf.gz", rows)
    run = lambda **k: execute(spark, LdConfig(in_vcf=vcf, out_stat=str(tmp_path / "o.stat.gz"), max_kb=10, **k).checked(), say=lambda s: None)
    text = lambda p: gzip.open(p, "rt").read()
    empty = text(run(out_type=0)["stat "])
    assert hashlib.sha256(empty.encode()).hexdigest().startswith("84f7167f9a064ac7")
    stats = {t: text(run(out_type=t)["stat "]) for t in (1, 6, 8)}
    assert stats[1] == stats[6] == stats[8] and stats[1].count("\n") > 10
    ld = text(run(out_type=8)["LD "]).splitlines()
    assert ld[0] == sinks.PAIR_HEADERS[8].rstrip() and len(ld[1].split("\t")) == 9
    hist = run(out_type=4)["stat "]
    assert text(hist).splitlines()[1] == "#2SampleSize\t40" and results.kind_of(spark, hist) == "hist4" and results.sample_size(spark, hist) == 40
    by_values = rebin.mean_bins(rebin.histogram_as_bins(results.read_stat(spark, hist))).agg({"n": "sum"}).collect()[0][0]
    last = sum(n for d, (n, _) in brute_bins(rows, 10_000).items() if d < 10_000)
    assert by_values == last
    out = run(out_filter=True)
    again = execute(spark, LdConfig(in_vcf=out["filter vcf"], out_stat=str(tmp_path / "p"), max_kb=10).checked(), say=lambda s: None)
    assert text(again["stat "]) == stats[1]
    (tmp_path / "g").write_text("".join(f"S{k} {'x' if k < 10 else 'y'}\n" for k in range(20)))
    both = run(sub_pop=(str(tmp_path / "g"),))
    assert set(both) == {"stat x", "stat y"} and both["stat x"].endswith("o.x.stat.gz")
    stat = results.read_stat(spark, run(out_type=2)["stat "], "p")
    assert stat.columns == ["pop", "dist", "n", "sum_rr", "sum_d"] and stat.filter("sum_d IS NULL").count() == 0


def test_large_files_do_not_pass_the_driver(spark, tmp_path, rows, monkeypatch):
    """Pair tables and filtered inputs are parts that executors write; one file is the same lines in the same order."""
    vcf = write_vcf(tmp_path / "a.vcf.gz", rows)
    parsed = files.read_vcf(spark, vcf, CFG, keep_lines=True)
    values = pairs.pair_values(pairs.pair_tables(files.kept(parsed), 10_000), 8)
    found = sorted(values.collect(), key=lambda r: (r["contig"], r["p1"], r["p2"]))
    lines = ["\t".join((r["contig"], str(r["p1"]), str(r["p2"]), *(f"{r[c]:.4f}" for c in ("d", "lod", "rr")), *(f"{r[c] / 100:.2f}" for c in ("low", "high")), str(r["dist"]))) for r in found]
    kept = [r["line"] for r in sorted(parsed.filter("reason IS NULL").select("seq", "line").collect())]

    def refused(*_, **__):
        raise AssertionError("rows are sent to the driver")

    for name in ("toLocalIterator", "collect", "toPandas", "toArrow"):
        monkeypatch.setattr(type(values), name, refused)
    sinks.write_pairs(values, str(tmp_path / "a.LD.gz"), 8)
    sinks.write_pairs(values.filter("false"), str(tmp_path / "none.LD.gz"), 8)
    sinks.write_filtered(parsed, str(tmp_path / "f.gz"), ["##one", "##two"])
    monkeypatch.undo()
    text = lambda name: gzip.open(tmp_path / name, "rt").read()
    assert text("a.LD.gz") == sinks.PAIR_HEADERS[8] + "".join(x + "\n" for x in lines) and len(lines) > 100
    assert text("none.LD.gz") == sinks.PAIR_HEADERS[8]
    assert text("f.gz").splitlines() == ["##one", "##two", *kept] and len(kept) > 10
    assert spark.read.text(str(tmp_path / "a.LD.gz")).count() == len(lines) + 1  # all gzip members are read


def test_mixed_input_keeps_the_vcf_site(spark, tmp_path, rows):
    vcf, geno = write_vcf(tmp_path / "a.vcf", rows[:40]), write_genotype(tmp_path / "a.geno", rows[20:60])
    every = [("", list(range(20)))]
    a, b = files.read_vcf(spark, vcf, CFG), files.read_genotype(spark, geno, CFG, every)
    both = union_inputs(files.kept(a).drop("input_rank"), files.kept(b).drop("input_rank"))
    assert both.filter("input_rank = 1").count() == files.kept(b).filter(f"pos > {rows[39][1]}").count()


def test_ehh(spark, tmp_path):
    rows = [(c, p, g) for c, p, g in calls(("chr1",), 40, 12, missing=0)]
    sites = keep_first(files.kept(files.read_vcf(spark, write_vcf(tmp_path / "a.vcf", rows, True), LdConfig(maf=0.05)))).persist()
    kept = {r["pos"]: r for r in sites.collect()}
    pos = sorted(kept)
    core = pos[len(pos) // 2]
    got = {r["pos"]: r for r in ehh.ehh_decay(sites, "chr1", core, 1_000_000).collect()}
    assert sorted(got) == pos and got[core]["dist"] == 0
    hap = {p: [kept[p]["minor"][0] >> h & 1 for h in range(24)] for p in pos}
    k = pos.index(core) + 1
    strings = ["".join(str(hap[p][h]) for p in pos[k - 1 : k + 1]) for h in range(24)]
    assert got[pos[k]]["ehh_all"] == pytest.approx(sum(strings.count(s) * (strings.count(s) - 1) for s in set(strings)) / (24 * 23))
    assert got[pos[k]]["ehh_all"] == pytest.approx(got[pos[k]]["ehh_0"] + got[pos[k]]["ehh_1"])
    assert ehh.ehh_decay(sites, "chrX", core, 1_000_000).count() == 0
    assert ehh.ehh_decay(sites, "chr1", core, 10).count() == 0  # fewer than eight sites
    import numpy as np

    p, h = np.arange(10) * 10 + 100, np.eye(10, dtype=int)
    assert [ehh.decay(p, h, at)[c][0] > 0 for at, c in ((5, 8), (100, 1))] == [True, True]
    assert ehh.parse_core("chr1::77") == ("chr1", 77)


@pytest.mark.parametrize("args", ["-i x -o y -MAF 1.1", "-i x -o y -MAF 0.1x", "-i x -o y -MAF nan", "-i x -o y -OutType 9", "-i x", "-o y", "-i x -o y -Zzz 1",
                                  "-i x -o y -EHH chr1", "-i x -o y -Method 2", "-i x -o", "-i x -InPlink p -o y", "-i x -o y -MaxDist 3.5", "-i x -o y -Het -1"])
def test_bad_options(args):
    with pytest.raises(OptionError):
        parse(args.split())


def test_options():
    c = parse("--InVCF a -o b -MaxDist 0 -T 999 -s p -SubPop q -OutPairLD 3 -OutFilterSNP".split())
    assert (c.in_vcf, c.max_kb, c.threads, c.sub_pop, c.out_type, c.out_filter) == ("a", 1, 256, ("p", "q"), 3, True)
    assert parse("-i a -o b -MaxDist 99999999".split()).max_kb == 1073740
    assert cli.main(["-h"]) == 1 and cli.main(["-i", "x"]) == 1
    assert sinks.stat_prefix("a.stat.gz") == "a"


def test_store_prunes(spark, tmp_path, rows):
    from ldspark.sources import store

    path = str(tmp_path / "sites")
    sites = keep_first(files.kept(files.read_vcf(spark, write_vcf(tmp_path / "a.vcf", rows), CFG)))
    store.write_sites(sites, path)
    all_back = store.read_sites(spark, path)
    a, b = ({(r["contig"], r["pos"]): r["minor"] for r in t.collect()} for t in (sites, all_back))
    assert a == b
    some = store.read_sites(spark, path, regions.load_regions("chr10:1-20000,chr2"))
    assert {(r["contig"], r["pos"]) for r in some.collect()} == {k for k in a if k[0] == "chr2" or k[0] == "chr10" and k[1] <= 20000}
    one = store.read_sites(spark, path, regions.load_regions("chr1:1-5000"))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(contig" in plan and "GreaterThanOrEqual(pos" in plan
    assert {r["dist"]: r["n"] for r in aggregates.decay(all_back, 1, 10_000, 40).collect()} == {r["dist"]: r["n"] for r in aggregates.decay(sites, 1, 10_000, 40).collect()}


def test_minor_count_with_the_64th_haplotype(spark, tmp_path):
    """Words are signed; the last haplotype is the sign."""
    calls = ["0|0"] * 30 + ["0|1"] * 2
    line = "\t".join(["c", "100", ".", "A", "C", ".", ".", ".", "GT", *calls])
    (tmp_path / "a.vcf").write_text("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(f"s{k}" for k in range(32)) + "\n" + line + "\n")
    row = files.kept(files.read_vcf(spark, str(tmp_path / "a.vcf"), LdConfig(maf=0.01))).collect()[0]
    assert row["minor_count"] == 2 and row["minor"][0] < 0


def test_lines_are_numbered_over_splits(spark, tmp_path):
    text = [f"line {k}" for k in range(5000)]
    (tmp_path / "t.txt").write_text("\n".join(text) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = files.lines_of(spark, str(tmp_path / "t.txt"))
        assert [r["value"] for r in sorted(rows.collect(), key=lambda r: r["seq"])] == text and sorted(r["seq"] for r in rows.collect()) == list(range(5000))
        assert "Python" not in rows._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "empty").write_text("")
    assert files.lines_of(spark, str(tmp_path / "empty")).count() == 0


def test_rebin_command_line(spark, tmp_path):
    import gzip

    from ldspark import rebin_cli, sinks

    bins = spark.createDataFrame([(9, 1, 0.5, 0.5, 1.0, 1.0), (10, 2, 1.0, 0.5, 1.0, 0.5), (99, 1, 0.25, 0.25, 0.5, 0.5), (100, 4, 1.0, 0.25, None, None), (150, 1, 0.1, 0.1, None, None)],
                                 "dist long, n long, sum_rr double, mean_rr double, sum_d double, mean_d double")
    sinks.write_bins(bins, str(tmp_path / "a.stat.gz"))
    sinks.write_bins(bins, str(tmp_path / "b.stat.gz"))
    (tmp_path / "list").write_text(f"{tmp_path}/a.stat.gz\tp\n{tmp_path}/b.stat.gz\tp\n")
    out = rebin_cli.execute(spark, rebin_cli.parse(["-inList", f"{tmp_path}/list", "-output", f"{tmp_path}/o"]))
    with gzip.open(out["bin p"], "rt") as f:
        rows = [line.split("\t") for line in f.read().splitlines()[1:]]
    assert [r[0] for r in rows] == ["10", "20", "100", "200"] and [int(r[5]) for r in rows] == [2, 4, 2, 10] and rows[3][2] == "NA" and float(rows[0][1]) == 0.5
    hist = spark.createDataFrame([(5, 10, 3, 1), (5, 90, 1, 3), (250, 20, 2, 2)], "dist long, bucket int, n_rr long, n_d long")
    sinks.write_histogram(hist, str(tmp_path / "h.stat.gz"), 4, 64)
    for method, want in (("MedianBin", [("0", 0.1), ("200", 0.2)]), ("PercentileBin", [("0", 0.9), ("200", 0.2)])):
        cfg = rebin_cli.parse(["-inFile", f"{tmp_path}/h.stat.gz", "-output", f"{tmp_path}/q", "-method", method, "-percent", "1", "-measure", "both"])
        out = rebin_cli.execute(spark, cfg)
        with gzip.open(out[f"{method} r2 "], "rt") as f:
            assert [(x, float(v)) for x, v in (line.split("\t") for line in f.read().splitlines())] == want
        assert len(out) == 2
    out = rebin_cli.execute(spark, rebin_cli.parse(["-inFile", f"{tmp_path}/h.stat.gz", "-output", f"{tmp_path}/w", "-method", "HW"]))
    with gzip.open(out["HW r2 "], "rt") as f:
        assert len(f.read().splitlines()) == 2
    assert rebin_cli.main(["-inFile", "x"]) == rebin_cli.main(["-help"]) == 1
    with pytest.raises(ValueError):
        rebin_cli.execute(spark, rebin_cli.parse(["-inFile", f"{tmp_path}/a.stat.gz", "-output", "x", "-method", "HW"]))


def test_messages_of_a_run_and_stored_sites(spark, tmp_path):
    def vcf(name, calls):
        rows = ["\t".join(["c", str(100 * k + 100), ".", "A", "C", ".", ".", ".", "GT", *c]) for k, c in enumerate(calls)]
        (tmp_path / name).write_text("\n".join(["#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(f"s{k}" for k in range(len(calls[0]))), *rows]) + "\n")
        said = []
        out = execute(spark, parse(["-InVCF", f"{tmp_path}/{name}", "-OutStat", f"{tmp_path}/{name}", "-OutSites", f"{tmp_path}/{name}.sites", "-MaxDist", "1"]), said.append)
        return "\n".join(said), out

    two = [["0/0", "0/1", "1/1", "0/1"], ["0/1", "0/0", "1/1", "0/1"], ["0/0", "0/1", "0/1", "1/1"]]
    said, out = vcf("two", two)
    assert "GT detected" not in said and "3 sites of 1 contigs, 8 haplotypes" in said
    again = execute(spark, parse(["-InSites", out["sites"], "-OutStat", f"{tmp_path}/again", "-MaxDist", "1"]), print)
    with gzip.open(out["stat "]) as f, gzip.open(again["stat "]) as g:
        assert f.read() == g.read()
    part = execute(spark, parse(["-InSites", out["sites"], "-OutStat", f"{tmp_path}/part", "-MaxDist", "1", "-L", "c:100-200"]), print)
    with gzip.open(part["stat "], "rt") as f:
        assert [line.split("\t")[0] for line in f] == ["#Dist", "100"]
    assert "haploid GT detected in sample s1" in vcf("one", [["0/0", "1", "0", "0/1"], *two[1:]])[0]
    assert "polyploid GT detected in sample s2" in vcf("three", [["0/0", "0/1", "0/1/1", "0/1"], *two[1:]])[0]
    with pytest.raises(OptionError):
        parse(["-InSites", "a", "-InVCF", "b", "-OutStat", "c"])


def test_wide_panels_by_blocks(spark, tmp_path):
    """Above 512 haplotypes bins come from the block kernel and equal those of the pair tables."""
    import random

    from ldspark.operators import pairs

    r = random.Random(4)
    names = "\t".join(f"s{k}" for k in range(300))
    lines = ["#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + names]
    for k in range(12):
        lines.append("\t".join(["c", str(50 * k + 10), ".", "A", "C", ".", ".", ".", "GT", *(f"{r.randint(0, 1)}|{r.randint(0, 1)}" if r.random() < 0.9 else ".|." for _ in range(300))]))
    (tmp_path / "w.vcf").write_text("\n".join(lines) + "\n")
    cfg = parse(["-InVCF", f"{tmp_path}/w.vcf", "-OutStat", f"{tmp_path}/w", "-MaxDist", "1"])
    out = execute(spark, cfg, print)
    found = files.kept(files.read_vcf(spark, f"{tmp_path}/w.vcf", cfg))
    want = {r["dist"]: r for r in aggregates.distance_bins(pairs.pair_values(pairs.pair_tables(found, 1000, 600), 1), 1).collect()}
    with gzip.open(out["stat "], "rt") as f:
        rows = [line.rstrip("\n").split("\t") for line in f][1:]
    assert {int(x[0]): (x[1], int(x[5])) for x in rows} == {d: (f"{b['mean_rr']:.4f}", b["n"]) for d, b in want.items()}


def test_regions_plan_neither_explodes_nor_aggregates(spark):
    sites = spark.createDataFrame([("", "c", p) for p in (10, 25, 50, 150)], "grp string, contig string, pos long")
    where = regions.region_frame(spark, [("c", 1, 100, "a"), ("c", 20, 30, "b"), ("c", 20, 22, "d"), ("c", 140, 160, "e")])
    out = regions.assign(sites, where)
    assert sorted((r["contig"], r["pos"]) for r in out.collect()) == [("a", 10), ("b", 25), ("e", 150)]
    assert "Aggregate" not in out._jdf.queryExecution().executedPlan().toString()
    assert len(regions.assign(sites, where, False).collect()) == 5
