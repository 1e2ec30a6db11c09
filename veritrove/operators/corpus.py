"""The fourteen corpus operators over knowledge models.

A model here is any object with DataFrames `passages` (passage_idx, source_file,
char_offset, char_length, content_hash, passage_id), `base` and optionally
`optimised` (passage_idx, vec), and a `revision` and `dim` for the base band.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritrove.functions import text as T
from veritrove.functions.vectors import dot, l2_normalize
from veritrove.operators import overlap, search, simjoin
from veritrove.operators.cluster import components

CITATION = ["passage_idx", "source_file", "char_offset", "char_length", "content_hash", "passage_id"]


def _ids(band: DataFrame) -> DataFrame:
    return band.select(F.col("passage_idx").alias("id"), "vec")


def check_pair(a, b, same_revision: bool = False) -> None:
    if a.dim != b.dim:
        raise ValueError(f"base bands differ in dimension: {a.dim} and {b.dim}")
    if same_revision and a.revision != b.revision:
        raise ValueError(f"base bands differ in revision: {a.revision} and {b.revision}")


def between(op, a, b, *args, same_revision: bool = True, **options):
    """op(base band of a, base band of b, ...) of two models, refused where their base bands can't be compared: for unique,
    intersect, corpus_diff, merge, compare and the others that take two tables."""
    check_pair(a, b, same_revision)
    return op(_ids(a.base), _ids(b.base), *args, **options)


def locate(model, passage_idx: int) -> DataFrame:
    """The passage's citation; an error if there is none."""
    row = model.passages.where(F.col("passage_idx") == passage_idx).select(*CITATION)
    if row.isEmpty():
        raise IndexError(f"no passage {passage_idx}")
    return row


def profile(passages: DataFrame) -> DataFrame:
    """source_file, n: passages by file."""
    return passages.groupBy("source_file").agg(F.count("*").alias("n"))


@dataclass
class Profile:
    """What a model is made of. drift is empty unless its sources were given; files has a row for each (source_file, n)."""

    passages: int
    source_files: int
    files: DataFrame
    bands: dict[str, int]
    encoder: str
    revision: str
    format_version: int
    drift: dict[str, int]


def profile_of(model, sources: DataFrame | None = None) -> Profile:
    """Counts, bands and their dimensions, the encoder, and with sources how many passages are verified, drifted and missing."""
    n, n_files = model.passages.agg(F.count("*"), F.count_distinct("source_file")).first()
    bands = {name: int(b.agg(F.coalesce(F.max(F.size("vec")), F.lit(0))).first()[0]) for name, b in model.bands.items()}
    drift = {} if sources is None else {r["drift_status"]: r["n"] for r in drift_tallies(model.passages, sources).collect()}
    backbone = model.metadata.get("archive", {}).get("backbone", {})
    return Profile(n, n_files, profile(model.passages), bands, str(backbone.get("name", "")), model.revision, int(model.metadata.get("format_version", 4)), drift)


def drift_tallies(passages: DataFrame, sources: DataFrame) -> DataFrame:
    """drift_status, n of all passages."""
    return search.verified(passages, sources).groupBy("drift_status").agg(F.count("*").alias("n"))


def corpus_size(passages: DataFrame) -> DataFrame:
    """One row: passages, distinct files, characters."""
    return passages.agg(F.count("*").alias("passages"), F.count_distinct("source_file").alias("files"), F.coalesce(F.sum("char_length"), F.lit(0)).cast("long").alias("chars"))


def neighbors(model, passage_idx: int, k: int = 10, prefer: str | None = None) -> DataFrame:
    band = _ids(model.band(prefer))
    one = band.where(F.col("id") == passage_idx)
    return simjoin.nearest(one, band, k, same=True).select(F.col("b").alias("passage_idx"), "cosine", "rank").join(model.passages, "passage_idx")


def near_duplicates(band: DataFrame, threshold: float = 0.95) -> DataFrame:
    """cluster_id (smallest id), id, size, mean_cosine (over all pairs of the cluster), of clusters of two and more.

    The mean over pairs is had from the sum vector: |sum|^2 is the sum of all ordered pairs' dots."""
    labels = components(simjoin.self_pairs(band, threshold), "a", "b").select(F.col("node").alias("id"), F.col("component").alias("cluster_id"))
    members = labels.join(band, "id")
    sums = (
        members.select("cluster_id", F.posexplode(F.col("vec").cast("array<double>")).alias("pos", "x"))
        .groupBy("cluster_id", "pos").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("size"))
        .groupBy("cluster_id").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("q"), F.max("size").alias("size"))
    )
    mean = (F.col("ss") - F.col("q")) / (F.col("size") * (F.col("size") - 1))
    return labels.join(sums.select("cluster_id", "size", mean.alias("mean_cosine")), "cluster_id")


def clusters(band: DataFrame, threshold: float) -> DataFrame:
    """id, cluster_id of every row, singletons included."""
    labels = components(simjoin.self_pairs(band, threshold), "a", "b")
    return band.select("id").join(labels.select(F.col("node").alias("id"), "component"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster_id"))


def centroid(band: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The mean vector, normalised, of a table or of each group."""
    by = by or []
    means = band.select(*by, F.posexplode(F.col("vec").cast("array<double>")).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg("x").alias("m"))
    vec = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s.m)
    return means.groupBy(*by).agg(vec.alias("vec")).select(*by, l2_normalize("vec").alias("vec"))


def compare(a: DataFrame, b: DataFrame, sample_size: int | None = 512, seed: int = 0) -> DataFrame:
    """One row: centroid_cosine, coverage_a_in_b, coverage_b_in_a, overlap. Exact up to sample_size rows a side or with None."""

    def some(x: DataFrame) -> DataFrame:
        return x if sample_size is None else x.orderBy(F.sha2(F.concat_ws(":", F.lit(seed), "id"), 256), "id").limit(sample_size)

    ab = simjoin.best_cosine(some(a), b).agg(F.coalesce(F.avg("cosine"), F.lit(0.0)).alias("coverage_a_in_b"))
    ba = simjoin.best_cosine(some(b), a).agg(F.coalesce(F.avg("cosine"), F.lit(0.0)).alias("coverage_b_in_a"))
    one, other = centroid(a).select(F.col("vec").alias("x"), F.lit(1).alias("k")), centroid(b).select(F.col("vec").alias("y"), F.lit(1).alias("k"))
    c = one.join(other, "k").select(dot("x", "y").alias("centroid_cosine"), "k")
    j = c.join(ab.withColumn("k", F.lit(1)), "k").join(ba.withColumn("k", F.lit(1)), "k").drop("k")
    return j.withColumn("overlap", (F.col("coverage_a_in_b") + F.col("coverage_b_in_a")) / 2)


def unique(a: DataFrame, b: DataFrame, threshold: float = 0.7) -> DataFrame:
    """id, cosine of a's rows whose best match in b is below the threshold; all of a if b is empty."""
    return simjoin.best_cosine(a, b).where(F.col("cosine") < threshold)


def intersect(a: DataFrame, b: DataFrame, threshold: float = 0.7, max_pairs: int | None = 10_000) -> DataFrame:
    found = simjoin.pairs(a, b, threshold)
    return found if max_pairs is None else found.orderBy(F.desc("cosine"), "a", "b").limit(max_pairs)


def check_members(members: dict) -> list[str]:
    """Labels of the models whose revision isn't the first one's, to be reported; an error where dimensions differ."""
    models = list(members.values())
    for other in models[1:]:
        check_pair(models[0], other)
    return [name for name, m in members.items() if m.revision != models[0].revision]


def compose_models(members: dict, q: list[float], k: int = 10) -> tuple[DataFrame, list[str]]:
    """The k best rows of all models' bands, and the labels of those of another revision."""
    odd = check_members(members)
    return compose({name: _ids(m.band()) for name, m in members.items()}, q, k), odd


def compose(members: dict[str, DataFrame], q: list[float], k: int = 10) -> DataFrame:
    """label, id, score: the k best rows of all members, each searched by itself."""
    parts = [search.top_k(m.select("id", "vec"), q, k).withColumn("label", F.lit(name)) for name, m in members.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(F.desc("score"), "label", "id").limit(k)


def numbered(rows: DataFrame, order: list, column: str = "passage_idx") -> DataFrame:
    """rows numbered 0.. in order: sorted by ranges, counted by partition, so no task sees all rows."""
    parts = rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33))
    from veritrove.plans.session import written

    parts = written(parts, "numbered")
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n"))
    inside = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return parts.join(before, "_p").withColumn(column, (F.col("_before") + inside).cast("long")).drop("_m", "_p", "_n", "_before")


def merge(a: DataFrame, b: DataFrame, threshold: float = 0.92) -> DataFrame:
    """origin, id of what stays of a followed by b: of each cluster the first row."""
    last = a.agg(F.max("id")).first()[0]
    shift = 0 if last is None else last + 1
    both = a.select("id", "vec", F.lit("a").alias("origin")).unionByName(b.select((F.col("id") + shift).alias("id"), "vec", F.lit("b").alias("origin")))
    kept = clusters(both.select("id", "vec"), threshold).where("id = cluster_id").select("id")
    return both.join(kept, "id").select("origin", F.when(F.col("origin") == "b", F.col("id") - shift).otherwise(F.col("id")).alias("id"))


def evidence(model, sources: DataFrame, q: list[float], k: int = 10, prefer: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Top-k hits with their text and drift status, and their confidence row. Drifted hits stay."""
    hits = search.top_k(_ids(model.band(prefer)), q, k).withColumnRenamed("id", "passage_idx")
    v = search.verified(hits.join(model.passages, "passage_idx"), sources)
    return v, search.confidence(v)


def drift(passages: DataFrame, sources: DataFrame) -> DataFrame:
    return search.verified(passages, sources).drop("text")


def corpus_diff(old: DataFrame, new: DataFrame, threshold: float = 0.95) -> DataFrame:
    """bucket (removed, added, unchanged), id."""
    o = simjoin.best_cosine(old, new).select(F.when(F.col("cosine") < threshold, "removed").otherwise("unchanged").alias("bucket"), "id")
    n = simjoin.best_cosine(new, old).where(F.col("cosine") < threshold).select(F.lit("added").alias("bucket"), "id")
    return o.union(n)


def contradictions(band: DataFrame, texts: DataFrame, cosine: float = 0.85, lexical: float = 0.3, max_pairs: int | None = 1000) -> DataFrame:
    """a, b, cosine, jaccard: near in meaning by vector, far in wording. texts has id, text; 3-grams are compared by 64-bit hashes."""
    from veritrove.plans.session import written

    p = written(simjoin.self_pairs(band, cosine), "similar")
    met = p.select(F.col("a").alias("id")).union(p.select("b")).distinct()
    # once a text, not once a pair
    grams = written(texts.join(met, "id", "left_semi").select(F.monotonically_increasing_id().alias("set"), "id", T.word_3grams("text", hashed=True).alias("items")), "grams")
    j = overlap.jaccards(p, grams, lexical)
    return j if max_pairs is None else j.orderBy(F.desc("cosine"), "a", "b").limit(max_pairs)


def audit(band: DataFrame, texts: DataFrame, q: list[float], k: int = 10, support: float = 0.7, cosine: float = 0.85, lexical: float = 0.3) -> DataFrame:
    """role (supporter, contradicting), id, score. Contradicting rows are near a supporter but worded otherwise; the first supporter counts."""
    sup = search.top_k(band.select("id", "vec"), q, k).where(F.col("score") >= support)
    near = simjoin.pairs(band.join(sup.select("id"), "id", "left_semi"), band, cosine).join(sup.select(F.col("id").alias("b")), "b", "left_anti")
    x, y = texts.select(F.col("id").alias("a"), F.col("text").alias("x")), texts.select(F.col("id").alias("b"), F.col("text").alias("y"))
    far = near.join(x, "a").join(y, "b").where(T.jaccard_3gram("x", "y") <= lexical).join(sup.select(F.col("id").alias("a"), "score"), "a")
    first = far.groupBy("b").agg(F.max_by("cosine", F.struct("score", (-F.col("a")).alias("n"))).alias("score"))
    return sup.select(F.lit("supporter").alias("role"), "id", "score").union(first.select(F.lit("contradicting"), "b", "score"))
