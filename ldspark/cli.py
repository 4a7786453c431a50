"""Command line: python -m ldspark.cli -InVCF in.vcf.gz -OutStat out [options]"""

from __future__ import annotations

import sys

from . import config

USAGE = """options: -InVCF/-i FILE | -InGenotype FILE | -InPlink PREFIX | -InSites FOLDER (of -OutSites FOLDER), -OutStat/-o PREFIX, -SubPop/-s LIST (repeatable),
-MAF .005, -Het .88, -Miss .25, -MaxDist 300 (kb), -OutType 0..8 (1), -EHH chr:pos, -OutFilterSNP, -L/-Region BED|chr:a-b,..,
-T/-Threads 4 (local cores), -Method 1, -help"""


def main(args: list[str]) -> int:
    try:
        cfg = config.parse(args)
    except config.HelpAsked:
        print(USAGE)
        return 1
    except config.OptionError as e:
        print(e, file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from .plans.run import execute

    spark = SparkSession.builder.master(f"local[{cfg.threads}]").config("spark.ui.enabled", "false").getOrCreate()
    try:
        for kind, path in execute(spark, cfg).items():
            print(f"{kind.strip()}\t{path}")
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
