"""Seeded genotype files for the tests."""

import gzip
import random

import numpy as np


def calls(contigs=("chr1", "chr10", "chr2"), sites=60, samples=20, seed=5, missing=0.05):
    """(contig, pos, [(a, b) or None]) with runs of correlated sites."""
    r = random.Random(seed)
    out = []
    for c in contigs:
        pos, base = 1000, [r.random() < 0.4 for _ in range(2 * samples)]
        for _ in range(sites):
            pos += r.randint(1, 1500)
            base = [x if r.random() < 0.9 else r.random() < 0.4 for x in base]
            out.append((c, pos, [None if r.random() < missing else (int(base[2 * s]), int(base[2 * s + 1])) for s in range(samples)]))
    return out


def write_vcf(path, rows, phased=False, alleles="AG", names=None, extra=()):
    n = len(rows[0][2])
    names = names or [f"S{k}" for k in range(n)]
    sep = "|" if phased else "/"
    lines = ["##fileformat=VCFv4.2", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *names])]
    for c, p, gts in rows:
        fields = [f".{sep}." if g is None else f"{g[0]}{sep}{g[1]}" for g in gts]
        lines.append("\t".join([c, str(p), ".", alleles[0], alleles[1], ".", ".", ".", "GT", *fields]))
    lines += extra
    data = ("\n".join(lines) + "\n").encode()
    with (gzip.open(path, "wb") if str(path).endswith(".gz") else open(path, "wb")) as f:
        f.write(data)
    return str(path)


def write_plink(prefix, rows, names=None, alleles="AG"):
    n = len(rows[0][2])
    names = names or [f"S{k}" for k in range(n)]
    with open(f"{prefix}.fam", "w") as f:
        f.writelines(f"F {x} 0 0 0 -9\n" for x in names)
    with open(f"{prefix}.bim", "w") as f:
        f.writelines(f"{c}\tv{k}\t0\t{p}\t{alleles[0]}\t{alleles[1]}\n" for k, (c, p, _) in enumerate(rows))
    code = {None: 1, 0: 0, 1: 2, 2: 3}
    with open(f"{prefix}.bed", "wb") as f:
        f.write(bytes((0x6C, 0x1B, 0x01)))
        for _, _, gts in rows:
            v = [code[None if g is None else sum(g)] for g in gts] + [0] * (-n % 4)
            f.write(bytes(v[k] | v[k + 1] << 2 | v[k + 2] << 4 | v[k + 3] << 6 for k in range(0, len(v), 4)))
    return str(prefix)


def write_genotype(path, rows, names=None, alleles="AG"):
    code = {(0, 0): alleles[0], (1, 1): alleles[1], (0, 1): "R", (1, 0): "R", None: "N"}
    n = len(rows[0][2])
    with open(path, "w") as f:
        f.write("#CHROM\tPOS\t" + " ".join(names or [f"S{k}" for k in range(n)]) + "\n")
        f.writelines(f"{c}\t{p}\t" + " ".join(code[g] for g in gts) + "\n" for c, p, gts in rows)
    return str(path)


def brute_bins(rows, max_dist, maf=0.005, het=0.88, miss=0.25, phased=False):
    """dist: (pairs, sum of r2), straight from the definitions, for calls without odd sites."""
    sites = []
    for c, p, gts in rows:
        n = len(gts)
        got = [g for g in gts if g is not None]
        if (n - len(got)) / n > miss or sum(a != b for a, b in got) / n > het:
            continue
        ones = sum(a + b for a, b in got)
        zeros = 2 * len(got) - ones
        if not ones or not zeros or min(ones, zeros) / (ones + zeros) < maf:
            continue
        minor = 0 if ones > zeros else 1
        haps = []
        for g in gts:
            haps += [-1, -1] if g is None else [0, 1] if not phased and g[0] != g[1] else [int(g[0] == minor), int(g[1] == minor)]
        sites.append((c, p, np.array(haps)))
    out = {}
    for i, (c, p, x) in enumerate(sites):
        for d, q, y in sites[i + 1 :]:
            if c != d or not 0 < q - p <= max_dist:
                continue
            ok = (x >= 0) & (y >= 0)
            a, b = x[ok], y[ok]
            if not a.sum() or not b.sum():
                continue
            pa, pb, pab = 1 - a.mean(), 1 - b.mean(), ((a == 0) & (b == 0)).mean()
            den = pa * pb * (1 - pa) * (1 - pb)
            r = (pab - pa * pb) ** 2 / den if den else None
            n, s = out.get(q - p, (0, 0.0))
            out[q - p] = (n + 1, s if r is None or s is None else s + r)
    return out
