"""python -m pixelsieve COMMAND ROOT ARGS...: runs a command in a Spark session taken from the environment."""

import sys

from pyspark.sql import SparkSession

from .plans.commands import run

if __name__ == "__main__":
    if len(sys.argv) < 4:
        sys.exit(__doc__)
    run(SparkSession.builder.appName("pixelsieve").getOrCreate(), *sys.argv[1:])
