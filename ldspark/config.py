"""Run configuration and strict option parsing."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

#: The largest distance in kb, and the range of output types.
MAX_KB, OUT_TYPES = ((1 << 30) - 1024) // 1000, range(9)


class OptionError(ValueError):
    """An option that is missing, unknown or out of range."""


@dataclass(frozen=True)
class LdConfig:
    """What to read, which sites to keep and what to compute. strict_compat keeps the established output
    conventions (histograms printed one distance further on, last region wins, EHH core rule); without
    it they are corrected."""

    in_vcf: str | None = None
    in_genotype: str | None = None
    in_plink: str | None = None
    in_sites: str | None = None
    out_sites: str | None = None
    out_stat: str | None = None
    sub_pop: tuple[str, ...] = ()
    maf: float = 0.005
    het: float = 0.88
    miss: float = 0.25
    max_kb: int = 300
    out_type: int = 1
    ehh: str | None = None
    out_filter: bool = False
    region: str | None = None
    threads: int = 4
    method: int = 1
    strict_compat: bool = True

    @property
    def max_dist(self) -> int:
        return self.max_kb * 1000

    def checked(self) -> LdConfig:
        if not (self.in_vcf or self.in_genotype or self.in_plink or self.in_sites):
            raise OptionError("an input is needed: -InVCF, -InGenotype, -InPlink or -InSites")
        if self.in_sites and (self.in_vcf or self.in_genotype or self.in_plink or self.out_filter):
            raise OptionError("-InSites can't be combined with another input or -OutFilterSNP")
        if self.in_plink and (self.in_vcf or self.in_genotype):
            raise OptionError("-InPlink can't be combined with another input")
        if not self.out_stat:
            raise OptionError("-OutStat is needed")
        if self.method != 1:
            raise OptionError("-Method: only 1")
        return replace(self, max_kb=min(max(1, self.max_kb), MAX_KB), threads=min(max(1, self.threads), 256))


def rate(text: str) -> float:
    """A whole token that is a finite number from 0 to 1."""
    try:
        value = float(text)
    except ValueError:
        raise OptionError(f"not a number: {text}") from None
    if not math.isfinite(value) or not 0 <= value <= 1 or text != text.strip() or "_" in text:
        raise OptionError(f"not in 0..1: {text}")
    return value


def whole(text: str) -> int:
    if not text.lstrip("+-").isdigit() or not text.isascii():
        raise OptionError(f"not a whole number: {text}")
    return int(text)


def _out_type(text: str) -> int:
    if (value := whole(text)) not in OUT_TYPES:
        raise OptionError(f"-OutType is 0 to 8, not {text}")
    return value


def _core(text: str) -> str:
    if ":" not in text:
        raise OptionError("-EHH is chromosome:position")
    return text


#: Option names without dashes: field and reader (None: a flag).
OPTIONS = {
    "InVCF": ("in_vcf", str), "i": ("in_vcf", str), "InGenotype": ("in_genotype", str), "InPlink": ("in_plink", str), "InSites": ("in_sites", str), "OutSites": ("out_sites", str),
    "OutStat": ("out_stat", str), "o": ("out_stat", str), "SubPop": ("sub_pop", str), "s": ("sub_pop", str),
    "MAF": ("maf", rate), "Het": ("het", rate), "Miss": ("miss", rate), "MaxDist": ("max_kb", whole),
    "OutType": ("out_type", _out_type), "OutPairLD": ("out_type", _out_type), "EHH": ("ehh", _core), "OutFilterSNP": ("out_filter", None),
    "L": ("region", str), "Region": ("region", str), "T": ("threads", whole), "Threads": ("threads", whole), "Method": ("method", whole),
}


class HelpAsked(Exception):
    pass


def parse(args: list[str]) -> LdConfig:
    """Options in any order; -SubPop can be repeated, others keep their last value."""
    found: dict = {}
    rest = list(args)
    while rest:
        flag = rest.pop(0)
        name = flag.replace("-", "")
        if not flag.startswith("-") or name not in OPTIONS:
            if name in ("help", "h"):
                raise HelpAsked
            raise OptionError(f"unknown option {flag}")
        field, reader = OPTIONS[name]
        if reader is None:
            found[field] = True
            continue
        if not rest or rest[0].startswith("-") and rest[0].replace("-", "") in OPTIONS:
            raise OptionError(f"{flag} lacks an argument")
        value = reader(rest.pop(0))
        found[field] = (*found.get(field, ()), value) if field == "sub_pop" else value
    return LdConfig(**found).checked()
