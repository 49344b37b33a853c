"""Named queries over the driver tables, with the SQL that defines each result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerspark.functions import alphabet as A
from kmerspark.functions.gf2 import BinaryMatrix
from kmerspark.operators import count as C
from kmerspark.operators import extract, lookup, setops, sketch, summarize
from kmerspark.scratch import scratch_path
from kmerspark.sources import database, generators, sequences
from kmerspark.streaming import running

from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


# --- pieces of SQL


def mers_sql(name: str, reads: str, k: int, canonical: bool = False, seq: str = "seq") -> str:
    """A table expression of all valid windows; only the eight base letters are folded or kept."""
    mer = "least(m, reverse(translate(m, 'ACGT', 'TGCA')))" if canonical else "m"
    windows = f"SELECT rid, i - 1 AS pos, substr(s, i, {k}) AS m FROM (SELECT rid, s, unnest(range(1, length(s) - {k - 2})) AS i FROM (SELECT rid, translate({seq}, 'acgt', 'ACGT') AS s FROM {reads}) WHERE length(s) >= {k})"
    return f"{name} AS (SELECT rid, pos, {mer} AS kmer FROM ({windows}) WHERE NOT regexp_matches(m, '[^ACGT]'))"


def counts_sql(name: str, reads: str, k: int, canonical: bool = False, seq: str = "seq") -> str:
    return f"{mers_sql(f'{name}_m', reads, k, canonical, seq)}, {name} AS (SELECT kmer, count(*)::BIGINT AS count FROM {name}_m GROUP BY kmer)"


def with_sql(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def histogram_sql(counts: str, low: int = 1, high: int = 10_000, increment: int = 1, full: bool = False) -> str:
    base, ceiling, n = summarize.bucket_bounds(low, high, increment)
    found = f"SELECT {base} + CASE WHEN count < {base} THEN 0 WHEN count > {ceiling} THEN {n - 1} ELSE (count - {base}) // {increment} END * {increment} AS bucket, count(*)::BIGINT AS n FROM {counts} GROUP BY 1"
    if not full:
        return f"SELECT bucket::BIGINT AS bucket, n FROM ({found})"
    return f"SELECT r.b::BIGINT AS bucket, coalesce(n, 0)::BIGINT AS n FROM (SELECT unnest(range({base}, {base + n * increment}, {increment})) AS b) r LEFT JOIN ({found}) f ON r.b = f.bucket"


STATS_SQL = "SELECT coalesce(sum(CASE WHEN count = 1 THEN 1 END), 0)::BIGINT AS unique_mers, count(*)::BIGINT AS distinct_mers, coalesce(sum(count), 0)::BIGINT AS total, coalesce(max(count), 0)::BIGINT AS max_count FROM c"

# --- counting: every mode of it


def _count_query(name: str, reads: str, k: int, canonical: bool = False, engine: str = "auto"):
    @query(name, with_sql(X.SQL[reads], counts_sql("c", reads, k, canonical)) + "SELECT kmer, count FROM c")
    def run(spark: SparkSession, d: str) -> DataFrame:
        return C.count_kmers(getattr(X, reads)(spark, d), k, canonical=canonical, engine=engine)


_count_query("kmer_count_k5", "reads_a", 5)
_count_query("kmer_count_k5_jvm", "reads_a", 5, engine="sql")
_count_query("kmer_count_canonical_k9", "reads_a", 9, True)
_count_query("kmer_count_canonical_k9_jvm", "reads_a", 9, True, engine="sql")
_count_query("kmer_count_k21", "reads_a", 21)
_count_query("kmer_count_text_k3", "reads_text", 3, True)
_count_query("kmer_count_text_k3_jvm", "reads_text", 3, True, engine="sql")
_count_query("kmer_large_key_k31", "reads_long", 31, True)
_count_query("kmer_large_key_k32", "reads_long", 32, True)
_count_query("kmer_large_key_k100", "reads_long", 100)


@query("kmer_positions", with_sql(X.SQL["reads_c"], mers_sql("m", "reads_c", 7, True)) + "SELECT rid, pos::BIGINT AS pos, kmer FROM m")
def _(spark, d):
    return extract.kmers_at(X.reads_c(spark, d), 7, ["rid"], canonical=True)


@query("distinct_kmers", with_sql(X.SQL["reads_c"], mers_sql("m", "reads_c", 8, True)) + "SELECT DISTINCT kmer FROM m")
def _(spark, d):
    return C.distinct_kmers(X.reads_c(spark, d), 8, canonical=True)


_A7 = (X.SQL["reads_a"], counts_sql("c", "reads_a", 7))


@query("count_lower_upper", with_sql(*_A7) + "SELECT kmer, count FROM c WHERE count BETWEEN 40 AND 60")
def _(spark, d):
    return C.count_kmers(X.reads_a(spark, d), 7, lower=40, upper=60)


@query("count_saturated_1byte", with_sql(X.SQL["reads_a"], counts_sql("c", "reads_a", 4)) + "SELECT kmer, least(count, 255)::BIGINT AS count FROM c WHERE count >= 200")
def _(spark, d):
    return C.count_kmers(X.reads_a(spark, d), 4, lower=200, saturate_bytes=1)


def _masked_sql(threshold: int) -> str:
    return f"masked AS (SELECT rid, array_to_string(list_transform(range(1, length(seq) + 1), lambda i: CASE WHEN ascii(substr(qual, i, 1)) < {threshold} THEN 'N' ELSE substr(seq, i, 1) END), '') AS seq FROM reads_a)"


@query("count_quality_char", with_sql(X.SQL["reads_a"], _masked_sql(ord("D")), counts_sql("c", "masked", 5, True)) + "SELECT kmer, count FROM c")
def _(spark, d):
    return C.count_kmers(X.reads_a(spark, d), 5, qual="qual", min_qual=ord("D"), canonical=True)


@query("count_min_quality_offset", with_sql(X.SQL["reads_a"], _masked_sql(33 + 34), counts_sql("c", "masked", 6)) + "SELECT kmer, count FROM c")
def _(spark, d):
    from kmerspark.functions.helpers import quality_threshold

    return C.count_kmers(X.reads_a(spark, d), 6, qual="qual", min_qual=quality_threshold(min_quality=34, quality_start=33), engine="sql")


_BOTH = "both_reads AS (SELECT rid, seq FROM reads_a UNION ALL SELECT rid, seq FROM reads_b)"


@query("count_multi_source", with_sql(X.SQL["reads_a"], X.SQL["reads_b"], _BOTH, counts_sql("c", "both_reads", 8, True)) + "SELECT kmer, count FROM c")
def _(spark, d):
    return C.count_kmers(X.reads_a(spark, d).select("rid", "seq").unionByName(X.reads_b(spark, d)), 8, canonical=True)


_IF = (X.SQL["reads_a"], X.SQL["reads_c"], counts_sql("c", "reads_a", 7), mers_sql("k", "reads_c", 7))


def _only_if(spark, d, lower=None):
    return C.count_kmers(X.reads_a(spark, d), 7, only=C.distinct_kmers(X.reads_c(spark, d), 7), lower=lower)


@query("count_only_if", with_sql(*_IF) + "SELECT d.kmer, coalesce(count, 0)::BIGINT AS count FROM (SELECT DISTINCT kmer FROM k) d LEFT JOIN c ON d.kmer = c.kmer")
def _(spark, d):
    return _only_if(spark, d)


@query("count_only_if_lower1", with_sql(*_IF) + "SELECT c.kmer, count FROM (SELECT DISTINCT kmer FROM k) d JOIN c ON d.kmer = c.kmer")
def _(spark, d):
    return _only_if(spark, d, 1)


_LONG20 = (X.SQL["reads_long"], counts_sql("c", "reads_long", 20, True))


@query("count_bf_minus_one", with_sql(*_LONG20) + "SELECT kmer, count - 1 AS count FROM c WHERE count >= 2")
def _(spark, d):
    return C.count_kmers(X.reads_long(spark, d), 20, canonical=True, prefilter="minus1")


@query("count_bc_exact", with_sql(*_LONG20) + "SELECT kmer, count FROM c WHERE count >= 2")
def _(spark, d):
    return C.count_kmers(X.reads_long(spark, d), 20, canonical=True, prefilter="exact2")


@query("count_bc_first_pass", with_sql(X.SQL["reads_a"], X.SQL["reads_b"], counts_sql("c", "reads_a", 8), counts_sql("p", "reads_b", 8)) + "SELECT c.kmer, c.count FROM c JOIN p ON c.kmer = p.kmer WHERE p.count >= 2")
def _(spark, d):
    return C.count_kmers(X.reads_a(spark, d), 8, prefilter="exact2", seen_twice=C.count_kmers(X.reads_b(spark, d), 8))


@query("bloom_counter_class", with_sql(X.SQL["reads_a"], counts_sql("c", "reads_a", 10)) + "SELECT kmer, least(count, 2)::BIGINT AS count FROM c")
def _(spark, d):
    return C.count_kmers(X.reads_a(spark, d), 10).withColumn("count", F.least("count", F.lit(2)))


# --- summaries

_A9 = (X.SQL["reads_a"], counts_sql("c", "reads_a", 9, True))


def _a9(spark, d):
    return C.count_kmers(X.reads_a(spark, d), 9, canonical=True)


@query("histo_default", with_sql(*_A9) + histogram_sql("c"))
def _(spark, d):
    return summarize.histogram(_a9(spark, d))


@query("histo_low_high_inc", with_sql(*_A9) + histogram_sql("c", 3, 20, 4))
def _(spark, d):
    return summarize.histogram(_a9(spark, d), 3, 20, 4)


@query("histo_full", with_sql(*_A9) + histogram_sql("c", 1, 50, 2, True))
def _(spark, d):
    return summarize.histogram(_a9(spark, d), 1, 50, 2, True)


@query("stats_default", with_sql(*_A9) + STATS_SQL)
def _(spark, d):
    return summarize.stats(_a9(spark, d))


@query("stats_range", with_sql(*_A9) + STATS_SQL + " WHERE count BETWEEN 2 AND 9")
def _(spark, d):
    return summarize.stats(_a9(spark, d), 2, 9)


@query("top_kmers", with_sql(*_A9) + "SELECT kmer, count FROM c ORDER BY count DESC, kmer LIMIT 25")
def _(spark, d):
    return C.top_kmers(_a9(spark, d), 25)


# --- merging

_ABC = (X.SQL["reads_a"], X.SQL["reads_b"], X.SQL["reads_c"], *[counts_sql(f"c{x}", f"reads_{x}", 8) for x in "abc"], "u AS (SELECT * FROM ca UNION ALL SELECT * FROM cb UNION ALL SELECT * FROM cc)")


def _abc(spark, d, n=3):
    return [C.count_kmers(f(spark, d), 8, packed=True) for f in (X.reads_a, X.reads_b, X.reads_c)[:n]]


@query("merge_sum", with_sql(*_ABC) + "SELECT kmer, sum(count)::BIGINT AS count FROM u GROUP BY kmer")
def _(spark, d):
    return extract.spelled(setops.merge(_abc(spark, d)), 8)


@query("merge_min", with_sql(*_ABC) + "SELECT kmer, min(count)::BIGINT AS count FROM u GROUP BY kmer HAVING count(*) = 3")
def _(spark, d):
    return extract.spelled(setops.merge(_abc(spark, d), "min"), 8)


@query("merge_max", with_sql(*_ABC) + "SELECT kmer, max(count)::BIGINT AS count FROM u GROUP BY kmer")
def _(spark, d):
    return extract.spelled(setops.merge(_abc(spark, d), "max"), 8)


@query("merge_range", with_sql(*_ABC) + "SELECT kmer, sum(count)::BIGINT AS count FROM u GROUP BY kmer HAVING sum(count) BETWEEN 20 AND 30")
def _(spark, d):
    return extract.spelled(setops.merge(_abc(spark, d), lower=20, upper=30), 8)


def _jaccard_sql(n: int) -> str:
    u = " UNION ALL ".join(f"SELECT * FROM c{x}" for x in "abc"[:n])
    return with_sql(*_ABC[:-1]) + f"SELECT round(sum(CASE WHEN lo > 0 THEN 1 ELSE 0 END)::DOUBLE / count(*), 9) AS jaccard, round(sum(lo)::DOUBLE / sum(hi), 9) AS wjaccard FROM (SELECT CASE WHEN count(*) < {n} THEN 0 ELSE min(count) END AS lo, max(count) AS hi FROM ({u}) GROUP BY kmer)"


@query("jaccard_two", _jaccard_sql(2))
def _(spark, d):
    return setops.jaccard(_abc(spark, d, 2)).select(F.round("jaccard", 9).alias("jaccard"), F.round("wjaccard", 9).alias("wjaccard"))


@query("jaccard_three", _jaccard_sql(3))
def _(spark, d):
    return setops.jaccard(_abc(spark, d)).select(F.round("jaccard", 9).alias("jaccard"), F.round("wjaccard", 9).alias("wjaccard"))


@query("count_matrix", with_sql(*_ABC[:-1]) + "SELECT kmer, coalesce(ca.count, 0)::BIGINT AS a, coalesce(cb.count, 0)::BIGINT AS b, coalesce(cc.count, 0)::BIGINT AS c FROM ca FULL JOIN cb USING (kmer) FULL JOIN cc USING (kmer)")
def _(spark, d):
    return extract.spelled(setops.count_matrix(dict(zip("abc", _abc(spark, d), strict=True))), 8)


# --- lookups

_MERS = [("ACGTACG",), ("acgtacgTTT",), ("AAAAAAA",), ("ACG",), ("ACGTNCG",), ("TTTTTTT",), ("CCCCCCCCCCC",), ("ACGTACG",)]
_MERS_SQL = "q AS (SELECT translate(substr(m, 1, 7), 'acgt', 'ACGT') AS m FROM (VALUES " + ", ".join(f"('{m}')" for (m,) in _MERS) + ") v(m) WHERE length(m) >= 7 AND NOT regexp_matches(upper(substr(m, 1, 7)), '[^ACGT]'))"
_CANONICAL7 = (X.SQL["reads_a"], counts_sql("c", "reads_a", 7, True), _MERS_SQL, "k AS (SELECT least(m, reverse(translate(m, 'ACGT', 'TGCA'))) AS mer FROM q)")


def _asked(spark):
    return spark.createDataFrame(_MERS, "mer string")


@query("query_points", with_sql(*_CANONICAL7) + "SELECT mer, coalesce(count, 0)::BIGINT AS count FROM k LEFT JOIN c ON mer = kmer")
def _(spark, d):
    return lookup.query(C.count_kmers(X.reads_a(spark, d), 7, canonical=True), _asked(spark), 7, canonical=True)


@query("query_bloom_classes", with_sql(*_CANONICAL7) + "SELECT mer, least(coalesce(count, 0), 2)::BIGINT AS count FROM k LEFT JOIN c ON mer = kmer")
def _(spark, d):
    return lookup.query_classes(C.count_kmers(X.reads_a(spark, d), 7, canonical=True), _asked(spark), 7, canonical=True)


_READS9 = (X.SQL["reads_a"], X.SQL["reads_c"], counts_sql("c", "reads_a", 9), mers_sql("m", "reads_c", 9))


@query("query_sequence", with_sql(*_READS9) + "SELECT rid, pos::BIGINT AS pos, m.kmer AS mer, coalesce(count, 0)::BIGINT AS count FROM m LEFT JOIN c ON m.kmer = c.kmer")
def _(spark, d):
    return lookup.query_sequences(C.count_kmers(X.reads_a(spark, d), 9, packed=True), X.reads_c(spark, d), 9, ["rid"])


@query("query_per_read", with_sql(*_READS9) + "SELECT rid, string_agg(coalesce(count, 0)::VARCHAR, ' ' ORDER BY pos) AS counts FROM m LEFT JOIN c ON m.kmer = c.kmer GROUP BY rid")
def _(spark, d):
    per = lookup.query_per_read(C.count_kmers(X.reads_a(spark, d), 9, packed=True), X.reads_c(spark, d), 9, ["rid"])
    return per.select("rid", F.array_join(F.col("counts").cast("array<string>"), " ").alias("counts"))


@query("weighted_add", with_sql(X.SQL["reads_c"], mers_sql("m", "reads_c", 6)) + "SELECT kmer, sum(pos + 1)::BIGINT AS count FROM m GROUP BY kmer")
def _(spark, d):
    return C.add_weighted(extract.kmers_at(X.reads_c(spark, d), 6, ["rid"]).withColumn("value", F.col("pos") + 1))


@query("update_add", with_sql(X.SQL["reads_b"], X.SQL["reads_c"], counts_sql("c", "reads_c", 9), mers_sql("m", "reads_b", 9)) + "SELECT c.kmer, (any_value(c.count) + coalesce(sum(m.pos), 0))::BIGINT AS count FROM c LEFT JOIN m ON c.kmer = m.kmer GROUP BY c.kmer")
def _(spark, d):
    return C.update_add(C.count_kmers(X.reads_c(spark, d), 9), extract.kmers_at(X.reads_b(spark, d), 9, ["rid"]).withColumn("value", F.col("pos")))


# --- the algebra, over all windows of reads_c

_C6 = (X.SQL["reads_c"], mers_sql("w", "reads_c", 6), "m AS (SELECT DISTINCT kmer FROM w)")


def _algebra(name: str, sql: str):
    def add(f):
        @query(name, with_sql(*_C6) + f"SELECT kmer, {sql} FROM m")
        def run(spark, d):
            return f(C.distinct_kmers(X.reads_c(spark, d), 6))

    return add


@_algebra("mer_revcomp", "reverse(translate(kmer, 'ACGT', 'TGCA')) AS rc")
def _(m):
    return m.select("kmer", A.reverse_complement("kmer").alias("rc"))


@_algebra("mer_canonical", "least(kmer, reverse(translate(kmer, 'ACGT', 'TGCA'))) AS canonical")
def _(m):
    return m.select("kmer", A.canonical("kmer").alias("canonical"))


@_algebra("mer_shift_left", "substr(kmer, 2) || 'G' AS shifted, substr(kmer, 1, 1) AS popped")
def _(m):
    shifted, popped = A.shift_left("kmer", F.lit("g"))
    return m.select("kmer", shifted.alias("shifted"), popped.alias("popped"))


@_algebra("mer_shift_right", "'T' || substr(kmer, 1, 5) AS shifted, substr(kmer, 6, 1) AS popped")
def _(m):
    shifted, popped = A.shift_right("kmer", F.lit("T"))
    return m.select("kmer", shifted.alias("shifted"), popped.alias("popped"))


@_algebra("mer_base_at", "substr(kmer, 6, 1) AS base0, substr(kmer, 4, 1) AS base2, substr(kmer, 1, 3) || 'A' || substr(kmer, 5) AS set2, (instr('ACGT', substr(kmer, 6, 1)) - 1)::BIGINT AS code0, translate(substr(kmer, 6, 1), 'ACGT', 'TGCA') AS complement0")
def _(m):
    return m.select("kmer", A.base_at("kmer", 0).alias("base0"), A.base_at("kmer", 2).alias("base2"), A.set_base("kmer", 2, "A").alias("set2"), A.code(A.base_at("kmer", 0)).cast("long").alias("code0"), A.complement_base(A.base_at("kmer", 0)).alias("complement0"))


@_algebra("mer_homopolymer", "kmer = repeat(substr(kmer, 1, 1), 6) AS homopolymer, kmer = 'AAAAAA' AS poly_a")
def _(m):
    return m.select("kmer", A.is_homopolymer("kmer").alias("homopolymer"), (F.col("kmer") == A.poly("A", 6)).alias("poly_a"))


_PACKED = " + ".join(f"(instr('ACGT', substr(kmer, {i + 1}, 1)) - 1)::BIGINT * {4 ** (5 - i)}" for i in range(6))


@_algebra("mer_bits", f"({_PACKED})::BIGINT AS packed, (({_PACKED}) >> 2 & 15)::BIGINT AS bits")
def _(m):
    return m.select("kmer", A.pack("kmer").alias("packed"), A.get_bits("kmer", 2, 4).alias("bits"))


@_algebra("mer_order", "kmer < reverse(translate(kmer, 'ACGT', 'TGCA')) AS lt_rc, kmer = reverse(translate(kmer, 'ACGT', 'TGCA')) AS palindrome")
def _(m):
    return m.select("kmer", (A.pack("kmer") < A.pack(A.reverse_complement("kmer"))).alias("lt_rc"), (F.col("kmer") == A.reverse_complement("kmer")).alias("palindrome"))


# --- files: what is written is read back

_C7 = (X.SQL["reads_c"], counts_sql("c", "reads_c", 7, True))


def _c7(spark, d):
    return C.count_kmers(X.reads_c(spark, d), 7, canonical=True)


@query("dump_fasta", with_sql(*_C7) + "SELECT '>' || count || chr(10) || kmer AS value FROM c WHERE count >= 2")
def _(spark, d):
    return database.dump_fasta(_c7(spark, d), lower=2)


@query("dump_columns", with_sql(*_C7) + "SELECT kmer || chr(9) || count AS value FROM c")
def _(spark, d):
    return database.dump_columns(_c7(spark, d), tab=True)


def _wrapped(c: str):
    return F.regexp_replace(c, "(.{13})", "$1\n")


@query("fasta_scan", with_sql(X.SQL["reads_c"]) + "SELECT 'r' || rid || ' > x' AS header, seq FROM reads_c")
def _(spark, d):
    path = scratch_path(spark, "fasta")
    X.reads_c(spark, d).select(F.concat(F.lit(">r"), F.col("rid").cast("string"), F.lit(" > x\n"), _wrapped("seq"), F.lit("\n")).alias("value")).write.text(path)
    return sequences.read_fasta(spark, path).select("header", "seq")


@query("fasta_scan_streamed", with_sql(X.SQL["reads_c"], counts_sql("c", "reads_c", 9)) + "SELECT kmer, count FROM c")
def _(spark, d):
    path = scratch_path(spark, "fasta")
    X.reads_c(spark, d).select(F.concat(F.lit(">r"), F.col("rid").cast("string"), F.lit("\r\n"), F.regexp_replace("seq", "(.{13})", "$1\r\n"), F.lit("\r")).alias("value")).write.option("compression", "gzip").text(path)
    return C.count_kmers(sequences.read_sequences(spark, path), 9)


@query("fastq_scan", with_sql(X.SQL["reads_a"]) + "SELECT rid AS header, seq, qual FROM reads_a")
def _(spark, d):
    path = scratch_path(spark, "fastq")
    X.reads_a(spark, d).select(F.concat(F.lit("@"), "rid", F.lit("\n"), _wrapped("seq"), F.lit("\n+\n"), _wrapped("qual")).alias("value")).write.text(path)
    return sequences.read_sequences(spark, path).select("header", "seq", "qual")


@query("sam_scan", with_sql(X.SQL["reads_a"]) + "SELECT rid AS header, seq, qual FROM reads_a")
def _(spark, d):
    path = scratch_path(spark, "sam")
    sequences.fastq_to_sam(X.reads_a(spark, d).withColumnRenamed("rid", "header")).write.text(path)
    return sequences.read_sam(spark, path).select("header", "seq", "qual")


@query("database_round_trip", with_sql(*_C7) + "SELECT kmer, count FROM c")
def _(spark, d):
    path = scratch_path(spark, "counts")
    database.write_database(_c7(spark, d), path, 7, True)
    return database.read_database(spark, path)


@query("binary_round_trip", with_sql(X.SQL["reads_a"], counts_sql("c", "reads_a", 3)) + "SELECT kmer, least(count, 65535)::BIGINT AS count FROM c")
def _(spark, d):
    path = scratch_path(spark, "binary")
    database.write_exchange(C.count_kmers(X.reads_a(spark, d), 3), path, 3, counter_len=2)
    return database.read_binary(spark, path)


@query("text_round_trip", with_sql(*_C7) + "SELECT kmer, count FROM c")
def _(spark, d):
    path = scratch_path(spark, "text")
    database.write_exchange(_c7(spark, d), path, 7, True, text=True)
    return database.read_text(spark, path)


@query("generator_commands", "SELECT kmer, count::BIGINT AS count FROM (VALUES ('ACG', 3), ('CGT', 2), ('GTA', 1)) v(kmer, count)")
def _(spark, d):
    commands = generators.read_commands("# comment\nprintf '>a\\nACGT\\n'\n\nprintf '>b\\nacg\\nTA\\n>c\\nACG'\n")
    return C.count_kmers(generators.run_generators(spark, commands, allow_execution=True), 3)


_RANDOM = "r AS (SELECT rid, substr(" + " || ".join(f"translate(md5('base-' || rid || '-7-{i}'), '{X.HEX}', '{X.NO_N}')" for i in range(5)) + ", 1, 150) AS seq FROM (SELECT unnest(range(2000)) AS rid))"


@query("random_reads", with_sql(_RANDOM, counts_sql("c", "r", 6, True)) + histogram_sql("c"))
def _(spark, d):
    return summarize.histogram(C.count_kmers(generators.random_reads(spark, 2000, 150, seed=7), 6, canonical=True))


@query("udtf_kmers", with_sql(*_C7) + "SELECT kmer, count FROM c")
def _(spark, d):
    from kmerspark.functions.udtf import register

    register(spark)
    return spark.sql("SELECT k.kmer, count(1) AS count FROM {reads} r, LATERAL kmers(r.seq, 7, true) k GROUP BY k.kmer", reads=X.reads_c(spark, d))


# --- streams and sketches


@query("stream_running_counts", with_sql(X.SQL["reads_c"], counts_sql("c", "reads_c", 5, True)) + "SELECT kmer, count FROM c")
def _(spark, d):
    path, name = scratch_path(spark, "stream"), "running_" + scratch_path(spark, "x")[-8:]
    X.reads_c(spark, d).repartition(3).write.parquet(path)
    reads = running.stream_reads(spark, path, "rid long, seq string", files_per_trigger=2)
    q = running.running_counts(reads, 5, canonical=True).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", scratch_path(spark, "checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query("stream_partials_compacted", with_sql(X.SQL["reads_c"], counts_sql("c", "reads_c", 9)) + "SELECT kmer, count FROM c")
def _(spark, d):
    path, out = scratch_path(spark, "stream"), scratch_path(spark, "partials")
    X.reads_c(spark, d).repartition(3).write.parquet(path)
    reads = running.stream_reads(spark, path, "rid long, seq string", files_per_trigger=1)
    running.append_partials(reads, 9, out, scratch_path(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return running.compact(spark, out)


_FILES = X.SQL["reads_c"], mers_sql("m", "reads_c", 12), "c AS (SELECT kmer, count(*)::BIGINT AS count FROM m GROUP BY kmer)"


def _counted_once(spark, d):
    """Counts that a counter is sized by, built from and asked for: written, so that they are not counted anew for each."""
    path = scratch_path(spark, "counted")
    C.count_kmers(X.reads_c(spark, d), 12).write.parquet(path)
    return X.spread(spark.read.parquet(path))


@query("bloom_sketch_fp_bounded", with_sql(*_FILES) + "SELECT count(*) FILTER (WHERE count >= 2)::BIGINT AS twice, 0::BIGINT AS lost, TRUE AS within FROM c")
def _(spark, d):
    """k-mers that a Bloom counter of a first pass keeps: all that occur twice, and a bounded share of those that occur once."""
    counts = _counted_once(spark, d)
    shape = sketch.Counter.sized(12, max(counts.count(), 1), 0.01)
    seen = sketch.check(counts, sketch.bloom_counter(counts, shape), shape)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    twice, over = F.col("count") >= 2, (F.col("count") < 2) & (F.col("seen") >= 2)
    return seen.agg(one(twice).alias("twice"), one(F.col("seen") < F.least("count", F.lit(2))).alias("lost"), (one(over) <= 0.03 * one(~twice) + 5).alias("within"))


@query("bloom_counter_file", with_sql(*_FILES) + "SELECT count(*)::BIGINT AS kmers, 0::BIGINT AS lost, TRUE AS within FROM c")
def _(spark, d):
    """A counter written as one file, read back by ranges, and asked for every k-mer."""
    counts = _counted_once(spark, d)
    shape = sketch.Counter.sized(12, max(counts.count(), 1), 0.001)
    path = scratch_path(spark, "counter.bc")
    sketch.write_counter(sketch.bloom_counter(counts, shape), path, shape)
    cells, back = sketch.read_counter(spark, path)
    seen = sketch.check(counts, cells, back)
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    wrong = one(F.col("seen") > F.least("count", F.lit(2)))
    return seen.agg(F.count(F.lit(1)).alias("kmers"), one(F.col("seen") < F.least("count", F.lit(2))).alias("lost"), (wrong <= 0.005 * F.count(F.lit(1)) + 5).alias("within"))


_MATRIX = BinaryMatrix.chance(40, 12, 5)
_IMAGE = "0::BIGINT"
for _i, _c in enumerate(reversed(_MATRIX.columns)):
    _IMAGE = f"xor({_IMAGE}, CASE WHEN p >> {_i} & 1 = 1 THEN {_c} ELSE 0 END::BIGINT)"


@query("gf2_images", with_sql(*_C6) + f"SELECT kmer, {_IMAGE} AS image FROM (SELECT kmer, ({_PACKED})::BIGINT AS p FROM m)")
def _(spark, d):
    """Every 6-mer's image under a random matrix over GF(2)."""
    return C.distinct_kmers(X.reads_c(spark, d), 6).select("kmer", _MATRIX.column(A.pack("kmer")).alias("image"))


@query("fastq_split", with_sql(X.SQL["reads_a"]) + "SELECT rid AS header, seq, qual FROM reads_a")
def _(spark, d):
    """Four-line FASTQ, of which each task writes a file, read in many ranges of each."""
    path = scratch_path(spark, "fastq")
    sequences.to_fastq(X.reads_a(spark, d).withColumnRenamed("rid", "header")).write.text(path)
    return sequences.read_sequences(spark, path, split_bytes=1 << 20).select("header", "seq", "qual")
