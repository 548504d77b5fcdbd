"""python -m graphloom ROOT: every function of a source tree, most important first, with its callers and callees."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from graphloom.service import CodeMap


def main(root: str) -> None:
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    code = CodeMap(spark, root).index()
    print(f"{code.importance.count()} functions under {root}\n")
    for row in code.dump().orderBy("pos").toLocalIterator():
        print(row["text"] + "\n")


if __name__ == "__main__":
    if len(sys.argv) != 2:
        sys.exit("usage: python -m graphloom ROOT")
    main(sys.argv[1])
