"""Source files, transcripts and remote texts as tables (source_file, text)."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrove.functions.text import lf

# The suffixes that are read as text.
TEXT_SUFFIXES = (
    ".py .pyi .md .rst .txt .js .jsx .ts .tsx .go .rs .c .h .cpp .hpp .cc .java .kt .swift .rb .php .cs .json .yaml .yml "
    ".toml .ini .cfg .sh .bash .zsh .fish .sql .html .css .scss .tex .org"
).split()
FOLDERS = ("docs", "src", "lib", "notebooks", "examples")


def common_root(paths: list[str]) -> str:
    return os.path.commonpath([p if os.path.isdir(p) else os.path.dirname(os.path.abspath(p)) for p in map(os.path.abspath, paths)])


def detect_sources(folder: str) -> list[str]:
    """The usual folders, and top-level text files."""
    here = Path(folder)
    found = [str(here / f) for f in FOLDERS if (here / f).is_dir()]
    return found + sorted(str(p) for p in here.iterdir() if p.suffix in (".md", ".rst", ".txt"))


def walk(spark: SparkSession, paths: list[str], root: str, suffixes: list[str] = TEXT_SUFFIXES) -> tuple[DataFrame, DataFrame]:
    """(source_file, text), and (source_file, reason) of what couldn't be decoded. Paths are relative to root; each once."""
    # the suffixes go to the listing, so other files are never read
    either = lambda x: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*{" + ",".join(map(either, suffixes)) + "}").load(paths)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace("path", "^[a-z0-9]+:/+", "/")
    raw = raw.select(F.when(F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1))).otherwise(path).alias("source_file"), F.col("content").cast("string").alias("text"))
    raw = raw.where(F.lower(F.regexp_extract("source_file", r"(\.[^./]+)$", 1)).isin(*suffixes)).dropDuplicates(["source_file"])
    good = raw.where(F.is_valid_utf8("text")).select("source_file", lf("text").alias("text"))
    return good, raw.where(~F.is_valid_utf8("text")).select("source_file", F.lit("decode").alias("reason"))


def guarded(sources: DataFrame) -> DataFrame:
    """sources, or an error where a path leads out of the root."""
    bad = F.startswith("source_file", F.lit("/")) | F.array_contains(F.split("source_file", "/"), "..")
    return sources.withColumn("source_file", F.when(bad, F.raise_error(F.concat(F.lit("path leaves the root: "), "source_file")).cast("string")).otherwise(F.col("source_file")))


def fetched(manifest: DataFrame, opener: Callable[[str], bytes]) -> DataFrame:
    """source_file, sha256, pinned, text, ok: contents by an injected opener, many tasks at once; null where it failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = []
            for url in b.url:
                try:
                    texts.append(opener(url).decode("utf-8").replace("\r\n", "\n").replace("\r", "\n"))
                except (OSError, UnicodeDecodeError):
                    texts.append(None)
            yield b.assign(text=texts)[["source_file", "url", "pinned", "text"]]

    m = manifest.select("source_file", "url", F.col("sha256").alias("pinned"))
    got = m.mapInPandas(run, "source_file string, url string, pinned string, text string")
    return got.withColumn("sha256", F.sha2("text", 256)).withColumn("ok", F.col("sha256") == F.col("pinned"))


def transcripts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """conv_id, turn, role, text, n_tools from JSON lines of {type, message: {role, content}}; content is a string or blocks."""
    raw = spark.read.text(paths).select(F.input_file_name().alias("conv_id"), F.monotonically_increasing_id().alias("turn"), F.try_parse_json("value").alias("v"))
    raw = raw.where("v is not null")
    get = lambda p, t: F.try_variant_get("v", p, t)
    blocks = get("$.message.content", "array<struct<type:string,text:string,name:string>>")
    text = F.coalesce(F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n"), get("$.message.content", "string"), F.lit(""))
    tools = F.coalesce(F.size(F.filter(blocks, lambda b: b["type"] == "tool_use")), F.lit(0))
    role = get("$.message.role", "string")
    return raw.select("conv_id", "turn", role.alias("role"), text.alias("text"), tools.alias("n_tools")).where(F.col("role").isin("user", "assistant"))
