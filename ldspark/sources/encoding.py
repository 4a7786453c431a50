"""From the genotypes of one site to a packed site, for file inputs.

A reader turns a line or a variant into two byte arrays, the first and the second allele character of
each sample; filters, allele choice and packing are the same for all formats and follow sites.py, which
does it on tables. Modes differ as the formats do:

  vcf             missing if the first character is '.'; '.' in second place is an allele character
  plink           characters '0' (A1), '1' (A2); unphased
  genotype_group  missing if 'N'; unphased
  genotype_all    as below in `encode_iupac`; frequencies over all haplotypes, tested before the alleles
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..config import LdConfig

MISSING = {"vcf": ord("."), "plink": ord("."), "genotype_group": ord("N"), "genotype_all": ord("N")}

#: Codes of genotypes.
IUPAC = {"M": "AC", "K": "GT", "Y": "CT", "R": "AG", "W": "AT", "S": "CG", "A": "AA", "C": "CC", "G": "GG", "T": "TT", "-": "NN", "N": "NN"}
HET_CODE = {frozenset(v): k for k, v in IUPAC.items() if v[0] != v[1]}


@dataclass(frozen=True)
class Site:
    """Counts, the reason it is filtered (None: kept) and, if kept, its planes."""

    n_miss: int
    n_het: int
    best: int
    sed: int
    maf: float | None
    reason: str | None
    minor: np.ndarray | None = None
    miss: np.ndarray | None = None


def choose(counts: np.ndarray, skip: int | None = None) -> tuple[int, int, int, int, int]:
    """(best, its count, second, its count, number of alleles) of counts by character. The lower character is
    best on ties; among equals for second place the last."""
    chars = [c for c in np.flatnonzero(counts).tolist() if c != skip]
    if not chars:
        return -1, 0, -1, 0, 0
    best = max(chars, key=lambda c: (counts[c], -c))
    rest = [c for c in chars if c != best]
    sed = max(rest, key=lambda c: (counts[c], c)) if rest else -1
    return best, int(counts[best]), sed, int(counts[sed]) if rest else 0, len(chars)


def words(bits: np.ndarray) -> np.ndarray:
    """Haplotype flags as 64-bit words, lowest bit first."""
    return np.packbits(np.concatenate([bits, np.zeros(-len(bits) % 64, bool)]), bitorder="little").view("<i8")


def encode(a: np.ndarray, b: np.ndarray, cfg: LdConfig, mode: str, phased: bool = False, tokens: list[str] | None = None) -> Site:
    """The site of allele characters a, b (bytes, one a sample). tokens: the codes, for genotype_all."""
    n = len(a)
    lost = MISSING[mode]
    missing = a == lost
    het = (a != b) if mode == "genotype_all" else ~missing & (a != b)
    n_miss, n_het = int(missing.sum()), int(het.sum())
    if mode == "genotype_all":
        counts = np.bincount(np.concatenate([a, b]), minlength=256)
        best, n_best, sed, n_sed, alleles = choose(counts, lost)
    else:
        counts = np.bincount(np.concatenate([a[~missing], b[~missing]]), minlength=256)
        best, n_best, sed, n_sed, alleles = choose(counts, ord("N") if mode == "genotype_group" else None)
    whole = 2 * n if mode == "genotype_all" else n_best + n_sed
    maf = n_sed / whole if whole else None
    rare = maf is not None and maf < cfg.maf
    if n_miss / n > cfg.miss:
        reason = "miss"
    elif n_het / n > cfg.het:
        reason = "het"
    elif mode == "genotype_all":
        reason = "maf" if rare else "biallelic" if alleles != 2 else None
    else:
        reason = "biallelic" if alleles == 1 or alleles > 2 else "maf" if rare else None
    if reason:
        return Site(n_miss, n_het, best, sed, maf, reason)
    if mode == "genotype_all":
        va, vb = encode_iupac(tokens, chr(best), chr(sed))
    else:
        value = lambda x: np.where(missing, 2, np.where(x == best, 0, np.where(x == sed, 1, 2)))
        va, vb = value(a), value(b)
        if alleles == 0:
            va = vb = np.full(n, 2)
        if not phased:
            va, vb = np.where(het, 0, va), np.where(het, 1, vb)
    v = np.stack([va, vb], axis=1).ravel()
    return Site(n_miss, n_het, best, sed, maf, None, words(v == 1), words(v == 2))


def encode_iupac(tokens: list[str], best: str, sed: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of codes without sample groups: a code that is neither allele nor missing is a heterozygote,
    and so is 'N' itself where the two alleles have no code."""
    het = HET_CODE.get(frozenset((best, sed)), "N")
    known = {"n": (2, 2), "N": (2, 2), "-": (2, 2)} | {best: (0, 0)} | {sed: (1, 1)} | {het: (0, 1)}
    v = np.array([known.get(t, (0, 1)) for t in tokens])
    return v[:, 0], v[:, 1]


def iupac_alleles(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Allele characters of codes; an unknown code is a character of its own, 0."""
    pairs = [IUPAC.get(t, "\0\0") for t in tokens]
    return (np.frombuffer("".join(p[k] for p in pairs).encode("latin-1"), np.uint8) for k in (0, 1))
