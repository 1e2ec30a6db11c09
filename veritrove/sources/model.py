"""A knowledge model on disk: Parquet tables in snapshot folders, and a pointer that is flipped last.

Layout: <path>/<snapshot>/{metadata.json, passages, bands/<band>, projections/<band>, graphs/<band>, sources, manifest}
and <path>/CURRENT. Files go through Spark or Hadoop's file systems, so a
model can live wherever the session's tables do. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrove.functions.vectors import l2_normalize
from veritrove.operators import graph

FORMAT = 4


@dataclass
class Model:
    passages: DataFrame
    bands: dict[str, DataFrame]  # passage_idx, vec
    metadata: dict = field(default_factory=dict)
    sources: DataFrame | None = None  # bundled texts
    manifest: DataFrame | None = None  # remote ones
    projections: dict[str, np.ndarray] = field(default_factory=dict)  # of bands made from the base, of fixed size
    graphs: dict[str, DataFrame] = field(default_factory=dict)  # search indexes of bands (see operators.graph)

    @property
    def dim(self) -> int:
        return int(self.metadata.get("dim", 0))

    @property
    def revision(self) -> str:
        return str(self.metadata.get("revision", ""))

    @property
    def base(self) -> DataFrame:
        return self.bands["base"]

    def band(self, prefer: str | None = None) -> DataFrame:
        """The band asked for, else the optimised one, else the base."""
        if prefer is not None:
            if prefer not in self.bands:
                raise KeyError(prefer)
            return self.bands[prefer]
        return self.bands.get("optimised", self.bands["base"])


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _put(spark: SparkSession, path: str, text: str) -> None:
    p, fs = _fs(spark, path + ".tmp")
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    renamed(spark, path + ".tmp", path)


def renamed(spark: SparkSession, old: str, new: str) -> None:
    """Renames a file over what is there in one step, so a reader finds the old one or the new one."""
    p, fs = _fs(spark, old)
    q, _ = _fs(spark, new)
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(p), fs.makeQualified(q), over)


def _get(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())


def check(m: Model) -> None:
    """Numbers must run from 0 without gaps, and every band must have a vector for each passage."""
    n, distinct, last = m.passages.agg(F.count("*"), F.count_distinct("passage_idx"), F.max("passage_idx")).first()
    if n and (n != distinct or last + 1 != n):
        raise ValueError("passage numbers aren't contiguous")
    if set(m.projections) - set(m.bands):
        raise ValueError("a projection needs its band")
    for name, band in m.bands.items():
        if name in m.projections and (np.ndim(m.projections[name]) != 2 or not len(m.projections[name])):
            raise ValueError(f"the projection of band {name} is no matrix")
        if band.join(m.passages, "passage_idx", "left_semi").count() != n or band.count() != n:
            raise ValueError(f"band {name} doesn't fit the passages")


def save(m: Model, path: str) -> str:
    """Writes a snapshot, normalising vectors, and makes it current. Returns its name."""
    spark = m.passages.sparkSession
    check(m)
    snap = uuid.uuid4().hex
    at = f"{path.rstrip('/')}/{snap}"
    m.passages.write.parquet(f"{at}/passages")
    for name, band in m.bands.items():
        band.select("passage_idx", l2_normalize("vec").cast("array<float>").alias("vec")).write.parquet(f"{at}/bands/{name}")
    for name in ("sources", "manifest"):
        if getattr(m, name) is not None:
            getattr(m, name).write.option("compression", "zstd").parquet(f"{at}/{name}")
    for name, w in m.projections.items():
        spark.createDataFrame([(k, row) for k, row in enumerate(np.asarray(w, np.float64).tolist())], "row int, w array<double>").coalesce(1).write.parquet(f"{at}/projections/{name}")
    sizes = {}
    for name, g in m.graphs.items():
        g.write.parquet(f"{at}/graphs/{name}")
        sizes[name] = list(spark.read.parquet(f"{at}/bands/{name}").agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first())
        graph.check(spark.read.parquet(f"{at}/graphs/{name}"), *sizes[name])
    meta = {**m.metadata, "format_version": FORMAT, "bands": sorted(m.bands), "projections": sorted(m.projections), "graphs": sizes}
    meta |= {"has": [n for n in ("sources", "manifest") if getattr(m, n) is not None]}
    _put(spark, f"{at}/metadata.json", json.dumps(meta, sort_keys=True))
    _put(spark, f"{path.rstrip('/')}/CURRENT", snap)
    return snap


def load(spark: SparkSession, path: str) -> Model:
    """The current snapshot. Unknown metadata stays; another format version is refused."""
    snap = _get(spark, f"{path.rstrip('/')}/CURRENT").strip()
    at = f"{path.rstrip('/')}/{snap}"
    meta = json.loads(_get(spark, f"{at}/metadata.json"))
    if meta.get("format_version") != FORMAT:
        raise ValueError(f"format version {meta.get('format_version')}")
    read = spark.read.parquet
    of = {name: np.array([r.w for r in read(f"{at}/projections/{name}").orderBy("row").collect()]) for name in meta.get("projections", [])}
    return Model(read(f"{at}/passages"), {b: read(f"{at}/bands/{b}") for b in meta["bands"]}, meta, *(read(f"{at}/{n}") if n in meta["has"] else None for n in ("sources", "manifest")), of, {b: graph.load(spark, f"{at}/graphs/{b}", *size) for b, size in meta.get("graphs", {}).items()})


def with_band(m: Model, name: str, band: DataFrame, projection: np.ndarray | None = None) -> Model:
    """The model with one more band, and the projection from the base band where there is one."""
    projections = {k: w for k, w in m.projections.items() if k != name} | ({name: projection} if projection is not None else {})
    return Model(m.passages, {**m.bands, name: band}, m.metadata, m.sources, m.manifest, projections, {k: g for k, g in m.graphs.items() if k != name})


def indexed(m: Model) -> Model:
    """The model with a search graph for each band that is large enough for one."""
    graphs = {name: graph.index_of(band.select(F.col("passage_idx").alias("id"), "vec")) for name, band in m.bands.items()}
    return Model(m.passages, m.bands, m.metadata, m.sources, m.manifest, m.projections, {k: g for k, g in graphs.items() if g is not None})


def retrieve(m: Model, queries: DataFrame, k: int = 10, prefer: str | None = None) -> DataFrame:
    """a, b (passage_idx), cosine, rank of the passages nearest to queries (id, vec of the base band): in the band asked for, else the
    optimised one, else the base; by its graph where it has one, else exactly."""
    name = prefer or ("optimised" if "optimised" in m.bands else "base")
    band = m.band(name).select(F.col("passage_idx").alias("id"), "vec")
    return graph.retrieve(queries, band, m.graphs.get(name), m.projections.get(name), k)


def build(sources: DataFrame, make_encoder, revision: str = "hashed-64", least: int = 200, most: int = 3200, bundle: bool = True) -> Model:
    """Chunks, hashes, numbers and encodes sources (source_file, text)."""
    from veritrove.functions.chunk import passages
    from veritrove.functions.encode import encoded
    from veritrove.operators.corpus import numbered

    p = numbered(passages(sources, least, most), ["source_file", "char_offset"])
    band = p.select("passage_idx", encoded("text", make_encoder).alias("vec"))
    first = band.select(F.size("vec")).first()
    return Model(p.drop("text"), {"base": band}, {"revision": revision, "dim": first[0] if first else 0, "build": {"least": least, "most": most}}, sources if bundle else None)


def converted(m: Model, sources: DataFrame, bundle: bool = False, manifest: DataFrame | None = None) -> Model:
    """The model with its texts kept another way; refused if any passage no longer hashes to what it did."""
    from veritrove.operators.search import verified

    if not verified(m.passages, sources).where("drift_status <> 'verified'").isEmpty():
        raise ValueError("passages have drifted; refresh first")
    return Model(m.passages, m.bands, m.metadata, sources if bundle else None, manifest, m.projections, m.graphs)


def build_bounds(m: Model, least: int | None = None, most: int | None = None) -> tuple[int, int]:
    """The chunk bounds a model was built with, each replaced by one that is given."""
    spec = {"least": 200, "most": 3200} | m.metadata.get("build", {})
    return spec["least"] if least is None else least, spec["most"] if most is None else most


def refreshed(m: Model, sources: DataFrame, make_encoder, skipped: DataFrame | None = None, least: int | None = None, most: int | None = None) -> tuple[Model, dict[str, int]]:
    """The model brought up to its sources, and passages by bucket. Nothing changed: the same model comes back.

    Chunk bounds are those that the model was built with, unless others are given. Unreadable files
    keep their passages. An optimised band is dropped, to be projected anew."""
    from veritrove.functions.chunk import passages
    from veritrove.functions.encode import encoded
    from veritrove.operators.incremental import apply_delta, bucketise, protect_skipped
    from veritrove.plans.session import written

    least, most = build_bounds(m, least, most)
    delta = bucketise(m.passages, passages(sources, least, most))
    if skipped is not None:
        delta = protect_skipped(delta, m.passages, skipped)
    delta = written(delta, "delta")
    counts = {r["bucket"]: r["count"] for r in delta.groupBy("bucket").count().collect()}
    if not set(counts) - {"unchanged"}:
        return m, counts
    p, band = apply_delta(m.passages, m.base, delta, lambda t: encoded(t, make_encoder))
    meta = {**m.metadata, "build": {"least": least, "most": most}}
    return Model(p, {"base": band}, meta, sources if m.sources is not None else None, m.manifest), counts
