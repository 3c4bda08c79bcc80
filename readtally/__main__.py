"""``python -m readtally config.toml``"""

from __future__ import annotations

import os
import sys
import tempfile
import traceback

from pyspark.sql import SparkSession

from readtally import __version__, config
from readtally.shipping import ship
from readtally.sources import sinks

USAGE = "usage: python -m readtally config.toml\n       python -m readtally --version"


def friendly(kind, error, trace) -> None:
    """What a user sees of an error that nobody foresaw: a sentence, and where the details are."""
    with tempfile.NamedTemporaryFile("w", prefix="readtally-report-", suffix=".txt", delete=False) as f:
        f.write(f"readtally {__version__}\n" + "".join(traceback.format_exception(kind, error, trace)))
    print(f"readtally had a problem and stopped. Please attach the report {f.name} when you tell its authors.", file=sys.stderr)


def main(args: list[str]) -> int:
    if "NO_FRIENDLY_PANIC" not in os.environ:
        sys.excepthook = friendly
    if "--test-friendly-panic" in args:
        raise RuntimeError("friendly panic test!")
    if "--version" in args:
        print(__version__)
        return 0
    if not args or "--help" in args or "-h" in args:
        print(USAGE)
        return 0 if args else 1
    try:
        settings = config.load(args[0])
        spark = SparkSession.builder.appName("readtally").getOrCreate()
        ship(spark)
        sinks.write(spark, settings)
    except (config.ConfigError, ValueError, OSError) as e:
        print(f"The quantification failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
