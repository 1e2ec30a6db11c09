"""Quality rules with host verdicts, in DataFrame functions only.

Document rules give base_failed; failures are then counted by host (the source
column), each host's failure rate is shrunk towards an empirical beta prior
fitted to all hosts by the moments of a beta-binomial, in which hosts weigh as their
documents and their sampling noise is taken off, and hosts whose shrunk rate exceeds a limit
take their other documents with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritrove.plans.session import written

SPACE = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Hosts above this shrunk failure rate are rejected.
HOST_LIMIT = 0.5
#: Pseudo-documents of the prior where hosts' rates don't differ or there is one host; and the range it is held in.
PRIOR_DEFAULT, PRIOR_LEAST, PRIOR_MOST = 10.0, 1.0, 10_000.0


def words_of(text: str) -> F.Column:
    trimmed = F.btrim(F.col(text), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def quality_features(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed in a struct `q`.

    Null texts count as empty. Repeated windows of three words are found by
    sorting a text's (window hash, place) pairs, so the work follows n log n in
    the text's words, and their words are counted once where windows overlap."""
    d = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    d = d.withColumn("_w", words_of("_text")).withColumn("_n", F.size("_w"))
    window = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 3),
        lambda i: F.struct(F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)).alias("h"), i.alias("p")),
    )
    none = F.array().cast("array<struct<h:bigint,p:int>>")
    d = d.withColumn("_s", F.when(F.col("_n") >= 3, F.array_sort(window)).otherwise(none))
    again = F.filter("_s", lambda x, i: (x.h == F.get("_s", i - 1).h) | (x.h == F.get("_s", i + 1).h))
    d = d.withColumn("_p", F.array_sort(F.transform(again, lambda x: x.p)))
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(-1).alias("e"), F.lit(0).alias("t")),
        lambda a, p: F.struct((p + 2).alias("e"), (a.t + F.least(F.lit(3), p + 2 - a.e)).alias("t")),
        lambda a: a.t,
    )
    d = d.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != ""))
    d = d.withColumn(
        "q",
        F.struct(
            F.col("_n").cast("long").alias("n_words"),
            F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
            F.regexp_count("_text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            covered.cast("long").alias("n_repeat_words"),
        ),
    )
    failed = (F.col("q.n_words") < MIN_WORDS) | (100 * F.col("q.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("q.n_words"))
    return d.withColumn("q", F.col("q").withField("base_failed", failed)).drop("_text", "_w", "_n", "_s", "_p", "_lines")


def host_verdicts(flags: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """host, n_docs, n_failed, host_rate (shrunk), host_failed from (host, base_failed) rows."""
    hosts = flags.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    n, k = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    sums = hosts.agg(F.count("*").alias("c"), F.sum(n).alias("n"), F.sum(k).alias("k"), F.sum(k * k / n).alias("kk"), F.sum(n * n).alias("nn"))
    mean = F.col("k") / F.col("n")
    # between hosts: what the weighted spread of rates has over that of samples from one rate
    spread = F.col("kk") - mean * F.col("k") - mean * (1 - mean) * (F.col("c") - 1)
    most = mean * (1 - mean) * (F.col("n") - F.col("nn") / F.col("n") - (F.col("c") - 1))
    prior = sums.where("c > 0").select(mean.alias("mean"), F.when(most > 0, spread / most).alias("rho"))
    size = F.greatest(F.lit(PRIOR_LEAST), F.least(F.lit(PRIOR_MOST), (1 - F.col("rho")) / F.col("rho")))
    prior = prior.select(
        "mean",
        F.when(F.col("rho").isNull(), PRIOR_DEFAULT).when(F.col("rho") > 0, size).otherwise(PRIOR_MOST).alias("size"),
        F.lit(1).alias("_one"),
    )
    shrunk = (F.col("n_failed") + F.col("mean") * F.col("size")) / (F.col("n_docs") + F.col("size"))
    return (
        hosts.withColumn("_one", F.lit(1))
        .join(F.broadcast(prior), "_one")  # one row
        .select("host", "n_docs", "n_failed", shrunk.alias("host_rate"), (shrunk > limit).alias("host_failed"))
    )


def _host(source: str = "source") -> F.Column:
    return F.coalesce(F.col(source), F.lit(""))


def quality_rules(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and host_failed for every row.

    A null source is the host ''. Rows without words fail. Repeated rows count
    as often as they occur. An empty table gives an empty result."""
    thin = docs.select("doc_id", "text", _host().alias("host"))
    f = written(quality_features(thin).select("doc_id", "host", "q.*"), "quality")
    failed = _failed_hosts(f, limit).withColumn("host_failed", F.lit(True))
    out = f.join(failed, "host", "left").withColumn("host_failed", F.coalesce("host_failed", F.lit(False)))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), "host_failed",
    )


def _failed_hosts(flags: DataFrame, limit: float) -> DataFrame:
    """host of the hosts that fail, as a written table: Spark knows its size, and broadcasts it only where that is small."""
    return written(host_verdicts(flags, limit).where("host_failed").select("host"), "hosts")


def keep_good(docs: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of docs that pass, with their columns as they were.

    Features are taken once: rows that pass the rules are written with their host, of the others the host alone.
    Null and blank texts fail; a null source is the host ''; repeated rows stay or go together; an empty table stays empty."""
    # the row goes along as a struct, so its names can't clash with those used here
    tagged = quality_features(docs.select(F.struct("*").alias("_doc"), "text", _host().alias("host")))
    judged = tagged.select(F.when(~F.col("q.base_failed"), F.col("_doc")).alias("_doc"), "host", F.col("q.base_failed").alias("base_failed"))
    judged = written(judged, "judged")
    return judged.where("not base_failed").join(_failed_hosts(judged, limit), "host", "left_anti").select("_doc.*")
