"""A knowledge model as one archive file: a ZIP of metadata, passage lines, matrices and source texts.

    metadata.json            format version, backbone, bands, store mode
    passages.jsonl           a line for each passage, numbered by its place
    bands/<band>.npz         `embeddings`, a row for each passage
    bands/<band>_W.npz       `projection`, for a band that was made from the base
    source/<path>            zstd frames, in store mode bundled
    manifest.json            url and sha256 of each source, in store mode remote

Reading is a Python data source: it splits a member into ranges of rows (matrices), bytes (lines) or names (sources), and each
range is streamed in a task of its own, without extracting anything. Lines get their numbers from counts by range. A
deflated matrix has no way in but from its start, so a range skips what is before it; ranges are therefore large. An
archive is one stream, so one task writes it, in order and in bounded memory; what it writes is made by all.
Files are opened by pyarrow's file systems, so an archive may lie wherever these reach.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from veritrove.functions import text as T
from veritrove.functions.vectors import l2_normalize
from veritrove.sources.model import FORMAT, Model, check, renamed

# The archive's member names and array keys.
METADATA, PASSAGES, MANIFEST, SOURCES, BANDS = "metadata.json", "passages.jsonl", "manifest.json", "source/", "bands/"
BAND_KEY, PROJECTION_KEY = "embeddings", "projection"
#: Bytes of lines, bytes of matrix rows and number of source files in a range; rows of a batch.
RANGE_BYTES, MATRIX_BYTES, RANGE_FILES, BATCH = 8 << 20, 256 << 20, 256, 4096
_LINE = "id string, source_file string, char_offset long, char_length long, content_hash string"
_KINDS = {"lines": "range int, line long, json string", "matrix": "row long, vec array<float>", "files": "source_file string, text string", "whole": "text string"}


@contextmanager
def _opened(path: str):
    """The archive as a file that can seek, and its directory."""
    from pyarrow import fs

    at, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    with at.open_input_file(name) as f, zipfile.ZipFile(f) as z:
        yield f, z


def _start(f, info: zipfile.ZipInfo) -> int:
    """Where a member's bytes begin."""
    f.seek(info.header_offset + 26)
    names, extra = struct.unpack("<HH", f.read(4))
    return info.header_offset + 30 + names + extra


@contextmanager
def _matrix(z: zipfile.ZipFile, member: str, key: str):
    """A stream of an NPZ member's array, after its header, with shape and type."""
    with z.open(member) as outer, zipfile.ZipFile(outer) as npz, npz.open(f"{key}.npy") as f:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, by_column, kind = read(f)
        if len(shape) != 2 or by_column:
            raise ValueError(f"{member}: {key} must be a matrix stored by rows")
        yield f, shape, kind


class Range(InputPartition):
    def __init__(self, at: int, first: int, last: int):
        self.at, self.first, self.last = at, first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.kind, self.member, self.key = (options.get(k, "") for k in ("path", "kind", "member", "key"))

    def _files(self, z: zipfile.ZipFile) -> list[str]:
        return [n for n in z.namelist() if n.startswith(SOURCES) and not n.endswith("/")]

    def partitions(self) -> list[InputPartition]:
        with _opened(self.path) as (_, z):
            if self.kind == "matrix":
                with _matrix(z, self.member, self.key) as (_, shape, kind):
                    size, step = shape[0], max(1, MATRIX_BYTES // max(1, shape[1] * kind.itemsize))
            elif self.kind == "lines":
                info = z.getinfo(self.member)
                size = info.file_size
                step = RANGE_BYTES if info.compress_type == zipfile.ZIP_STORED else max(1, size)
            else:
                size, step = (len(self._files(z)), RANGE_FILES) if self.kind == "files" else (1, 1)
        return [Range(k, a, min(a + step, size)) for k, a in enumerate(range(0, size, step))] or [Range(0, 0, 0)]

    def read(self, p: Range) -> Iterator[pa.RecordBatch]:
        with _opened(self.path) as (f, z):
            yield from {"matrix": self._rows, "lines": self._lines, "files": self._texts, "whole": self._whole}[self.kind](f, z, p)

    def _rows(self, f, z, p: Range) -> Iterator[pa.RecordBatch]:
        with _matrix(z, self.member, self.key) as (m, shape, kind):
            width = shape[1] * kind.itemsize
            before = p.first * width
            while before:
                before -= len(m.read(min(before, 1 << 20)))
            for a in range(p.first, p.last, BATCH):
                n = min(BATCH, p.last - a)
                x = np.frombuffer(m.read(n * width), kind).astype(np.float32)
                ends = pa.array(np.arange(0, n * shape[1] + 1, shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), pa.ListArray.from_arrays(ends, pa.array(x))], names=["row", "vec"])

    def _lines(self, f, z, p: Range) -> Iterator[pa.RecordBatch]:
        """Lines that begin in the range; the last one is read to its end."""
        info = z.getinfo(self.member)
        if info.compress_type == zipfile.ZIP_STORED:
            begin = _start(f, info)
            f.seek(begin + p.first - (p.first > 0))
            left = info.file_size - p.first + (p.first > 0)
            stream = io.BufferedReader(_Limited(f, left), 1 << 20)
        else:
            stream = io.BufferedReader(z.open(info), 1 << 20)
        at = p.first
        if p.first:
            at += len(stream.readline()) - 1  # the rest of a line that begins before, or its end alone
        lines, number = [], 0
        while at < p.last:
            raw = stream.readline()
            at += len(raw)
            lines.append(raw.rstrip(b"\r\n").decode())
            if len(lines) == BATCH or at >= p.last:
                yield pa.RecordBatch.from_arrays([pa.array([p.at] * len(lines), pa.int32()), pa.array(np.arange(number, number + len(lines))), pa.array(lines, pa.string())], names=["range", "line", "json"])
                number, lines = number + len(lines), []

    def _texts(self, f, z, p: Range) -> Iterator[pa.RecordBatch]:
        import zstandard

        for name in self._files(z)[p.first : p.last]:
            text = zstandard.ZstdDecompressor().decompressobj().decompress(z.read(name)).decode()
            yield pa.RecordBatch.from_arrays([pa.array([name.removeprefix(SOURCES)]), pa.array([text])], names=["source_file", "text"])

    def _whole(self, f, z, p: Range) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([z.read(self.member).decode()])], names=["text"])


class _Limited(io.RawIOBase):
    """So many bytes of a file from where it stands."""

    def __init__(self, f, left: int):
        self.f, self.left = f, left

    def readable(self) -> bool:
        return True

    def readinto(self, b) -> int:
        data = self.f.read(min(len(b), self.left))
        self.left -= len(data)
        b[: len(data)] = data
        return len(data)


class ArchiveSource(DataSource):
    """spark.read.format("veritrove_archive"): options path, kind (lines, matrix, files, whole), member, key."""

    @classmethod
    def name(cls) -> str:
        return "veritrove_archive"

    def schema(self) -> str:
        return _KINDS[self.options["kind"]]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def member(spark: SparkSession, path: str, kind: str, name: str = "", key: str = "") -> DataFrame:
    """A member's rows."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("veritrove_archive").options(path=path, kind=kind, member=name, key=key).load()


def passage_lines(spark: SparkSession, path: str) -> DataFrame:
    """passage_idx and the fields of every passage line; ids that are missing come from the coordinates. Blank or broken lines are refused."""
    lines = member(spark, path, "lines", PASSAGES)
    sizes = {r["range"]: r["count"] for r in lines.groupBy("range").count().collect()}  # one number for each 8 MB
    first, starts = 0, []
    for k in sorted(sizes):
        starts.append((k, first))
        first += sizes[k]
    start = F.broadcast(spark.createDataFrame(starts, "range int, first long"))
    p = F.from_json("json", _LINE, {"mode": "FAILFAST"})
    d = lines.join(start, "range").select((F.col("first") + F.col("line")).alias("passage_idx"), p.alias("p"))
    name = F.coalesce("p.source_file", F.raise_error(F.lit("a passage line has no source_file")))
    made = T.passage_id(F.col("source_file"), F.col("char_offset"), F.col("char_length"))
    d = d.select("passage_idx", name.alias("source_file"), F.col("p.char_offset"), F.col("p.char_length"), F.col("p.content_hash"), F.col("p.id").alias("_id"))
    return d.withColumn("passage_id", F.coalesce(F.when(F.col("_id") != "", F.col("_id")), made)).drop("_id")


def read(spark: SparkSession, path: str) -> Model:
    """The model in an archive. Refused: other format versions, bands without their matrix, a projection or its band alone, bands
    whose rows aren't as many as the passages, and a remote model without its manifest."""
    bands, projections = {}, {}
    with _opened(path) as (_, z):
        names = set(z.namelist())
        meta = json.loads(z.read(METADATA))
        if meta.get("format_version", FORMAT) != FORMAT:
            raise ValueError(f"format version {meta['format_version']}")
        rows = {}
        for band, info in (meta.get("bands") or {}).items():
            at, w = f"{BANDS}{band}.npz", f"{BANDS}{band}_W.npz"
            if at not in names or info.get("w_shape") is not None and w not in names:
                raise ValueError(f"band {band} is declared but its matrix or its projection is missing")
            if info.get("w_shape") is None and w in names:
                raise ValueError(f"band {band} has a projection that isn't declared")
            with _matrix(z, at, BAND_KEY) as (_, shape, _kind):
                rows[band] = shape[0]
            bands[band] = at
            if w in names and info.get("w_shape") is not None:
                with _matrix(z, w, PROJECTION_KEY) as (m, shape, kind):  # of fixed size
                    projections[band] = np.frombuffer(m.read(), kind).reshape(shape).astype(np.float64)
        lone = {n for n in names if n.startswith(BANDS)} - {f"{BANDS}{b}{x}.npz" for b in bands for x in ("", "_W")}
        if lone:
            raise ValueError(f"not declared: {sorted(lone)}")
        mode = meta.get("store_mode", "local")
        if mode == "remote" and MANIFEST not in names:
            raise ValueError("a remote model without its manifest")
        has_lines = z.getinfo(PASSAGES).file_size > 0
    passages = passage_lines(spark, path) if has_lines else spark.createDataFrame([], f"passage_idx long, {_LINE.partition(', ')[2]}, passage_id string")
    n = passages.count()
    if any(k != n for k in rows.values()):
        raise ValueError(f"{n} passages, but bands of {rows} rows")
    tables = {b: member(spark, path, "matrix", at, BAND_KEY).select(F.col("row").alias("passage_idx"), "vec") for b, at in bands.items()}
    sources = member(spark, path, "files") if mode == "bundled" else None
    manifest = None
    if mode == "remote":
        of = F.from_json("text", "map<string, struct<url: string, sha256: string>>")
        manifest = member(spark, path, "whole", MANIFEST).select(F.explode(of).alias("source_file", "x")).select("source_file", "x.url", "x.sha256")
    backbone = meta.get("backbone", {})
    known = {"revision": backbone.get("revision", ""), "dim": backbone.get("dim", 0), "build": meta.get("build_config", {}), "archive": meta}
    return Model(passages, tables, known, sources, manifest, projections)


def _metadata(m: Model, shapes: dict[str, tuple[int, int]], mode: str) -> dict:
    """What is known, what was read from an archive before, unknown keys too, and the bands as they are now."""
    before = dict(m.metadata.get("archive", {}))
    bands = {}
    for band, (n, dim) in shapes.items():
        old = dict((before.get("bands") or {}).get(band, {}))
        w = m.projections.get(band)
        now = {"role": "retrieval_default" if band == "base" else "in_corpus_retrieval", "l2_norm": True, **old, "dim": dim, "passage_count": n}
        now["w_shape"] = None if w is None else list(np.shape(w))
        bands[band] = now
    backbone = {**before.get("backbone", {}), "revision": m.revision, "dim": m.dim}
    return {**before, "format_version": FORMAT, "kind": before.get("kind", "corpus"), "backbone": backbone, "bands": bands, "store_mode": mode, "build_config": m.metadata.get("build", {})}


def write(m: Model, path: str) -> None:
    """Writes a model as an archive, under another name first. Vectors are normalised; passages must be numbered from 0 without gaps."""
    spark = m.passages.sparkSession
    check(m)
    if m.sources is not None and m.manifest is not None:
        raise ValueError("texts are bundled or remote, not both")
    mode = "bundled" if m.sources is not None else "remote" if m.manifest is not None else "local"
    n = m.passages.count()
    shapes = {b: (n, t.agg(F.coalesce(F.max(F.size("vec")), F.lit(0))).first()[0]) for b, t in m.bands.items()}
    head = json.dumps(_metadata(m, shapes, mode), indent=2, sort_keys=True)
    none = F.lit(None).cast("string")
    fields = F.struct("char_length", "char_offset", "content_hash", F.col("passage_id").alias("id"), "source_file")
    parts = [m.passages.select(F.lit(PASSAGES).alias("member"), F.lit(0).alias("place"), F.col("passage_idx").alias("row"), F.to_json(fields).alias("text"), F.lit(None).cast("array<float>").alias("vec"))]
    for k, (band, t) in enumerate(sorted(m.bands.items()), 1):
        parts.append(t.select(F.lit(f"{BANDS}{band}.npz"), F.lit(k), "passage_idx", none, l2_normalize("vec").cast("array<float>")))
    if m.sources is not None:
        parts.append(m.sources.select(F.concat(F.lit(SOURCES), "source_file"), F.lit(1_000), F.lit(0).cast("long"), "text", F.lit(None).cast("array<float>")))
    if m.manifest is not None:
        entry = F.to_json(F.struct("source_file", "url", "sha256"))
        parts.append(m.manifest.select(F.lit(MANIFEST), F.lit(2_000), F.lit(0).cast("long"), entry, F.lit(None).cast("array<float>")))
    # the metadata come as a row too, so that there is one to write even without passages
    rows = spark.createDataFrame([(METADATA, -1, 0, head, None)], "member string, place int, row long, text string, vec array<float>")
    for p in parts:
        rows = rows.union(p)
    projections = {b: np.asarray(w, np.float32) for b, w in m.projections.items()}
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _write_stream(tmp, shapes, projections, batches)
        yield pa.RecordBatch.from_arrays([pa.array([tmp])], names=["path"])

    rows.repartition(1).sortWithinPartitions("place", "member", "row").mapInArrow(run, "path string").collect()
    renamed(spark, tmp, path)


def _write_stream(path: str, shapes: dict, projections: dict, batches: Iterator[pa.RecordBatch]) -> None:
    """One member after the other, from rows that come in the members' order."""
    import zstandard
    from pyarrow import fs

    at, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    with at.open_output_stream(name) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        now, closers, write_row, seen = None, [], None, set()

        def close() -> None:
            while closers:
                closers.pop()()

        def matrix(member: str, key: str, shape: tuple[int, int]):
            outer = z.open(member, "w", force_zip64=True)
            npz = zipfile.ZipFile(outer, "w", zipfile.ZIP_DEFLATED)
            f = npz.open(f"{key}.npy", "w", force_zip64=True)
            np.lib.format.write_array_header_1_0(f, {"descr": "<f4", "fortran_order": False, "shape": shape})
            closers.extend([outer.close, npz.close, f.close])
            return f

        def begin(member: str):
            close()
            seen.add(member)
            if member == METADATA:
                return lambda text, vec: z.writestr(member, text.as_py())
            if member.startswith(BANDS):
                f = matrix(member, BAND_KEY, shapes[member[len(BANDS) : -len(".npz")]])
                return lambda text, vec: f.write(np.asarray(vec.values, np.float32).tobytes())
            if member.startswith(SOURCES):
                return lambda text, vec: z.writestr(member, zstandard.ZstdCompressor().compress(text.as_py().encode()))
            f = z.open(member, "w", force_zip64=True)
            closers.append(f.close)
            first = [True]
            if member == MANIFEST:
                closers.append(lambda: f.write(b"\n}"))

            def line(text, vec) -> None:
                d = json.loads(text.as_py())
                if member == MANIFEST:
                    f.write((b"{\n" if first[0] else b",\n") + f"{json.dumps(d.pop('source_file'))}: {json.dumps(d, sort_keys=True)}".encode())
                else:
                    f.write((b"" if first[0] else b"\n") + json.dumps(d, sort_keys=True).encode())
                first[0] = False

            return line

        for b in batches:
            for member, text, vec in zip(b.column("member").to_pylist(), b.column("text"), b.column("vec")):
                if member != now:
                    now, write_row = member, begin(member)
                write_row(text, vec)
        close()
        for member in [PASSAGES, *(f"{BANDS}{b}.npz" for b in shapes)]:  # what has no rows
            if member not in seen:
                begin(member)
                close()
        for band, w in projections.items():
            matrix(f"{BANDS}{band}_W.npz", PROJECTION_KEY, w.shape).write(w.tobytes())
            close()
