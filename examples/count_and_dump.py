"""Count the k-mers of sequence files, keep the table, and print those of a range of counts: python examples/count_and_dump.py 21 reads.fa [...]"""

import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402

from kmerspark.operators.collections import KmerDatabase  # noqa: E402
from kmerspark.operators.count import bounded, count_kmers, top_kmers  # noqa: E402
from kmerspark.operators.summarize import histogram, stats  # noqa: E402
from kmerspark.sources.database import write_database  # noqa: E402
from kmerspark.sources.sequences import read_sequences  # noqa: E402


def main(k: int, files: list[str]) -> None:
    spark = SparkSession.builder.appName("count_and_dump").getOrCreate()
    path = f"{tempfile.mkdtemp()}/counts"
    write_database(count_kmers(read_sequences(spark, files), k, canonical=True), path, k, True)
    db = KmerDatabase.open(spark, path)
    stats(db.counts).show()
    histogram(db.counts, high=20).orderBy("bucket").show()
    for row in top_kmers(bounded(db.counts, lower=2), 10).collect():
        print(row["kmer"], row["count"], db[row["kmer"]])


if __name__ == "__main__":
    if len(sys.argv) < 3:
        sys.exit(__doc__)
    main(int(sys.argv[1]), sys.argv[2:])
