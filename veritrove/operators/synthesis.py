"""Queries for passages from a language model, resumable: no passage that has been answered is asked again.

A task asks a few passages at once and appends each reply to a log of its own in the cache folder as it comes. A
run first takes away what any log holds, and a task that is repeated reads what its earlier tries wrote. Style comes from
example questions that the model makes up from a few passages once. The folder is that of the corpus, the description and the
model's name, so nothing is taken over from other texts.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrove.functions import text as T
from veritrove.operators.optimise import good_queries, stratified
from veritrove.plans.session import written
from veritrove.sources.model import _fs, _get, _put

# Passages that examples are made from, examples, their words, characters of a passage that are shown, calls at once,
# and the caps of the sample.
ANCHOR_PASSAGES, ANCHORS, ANCHOR_WORDS, SHOWN, AT_ONCE, PER_FILE, MOST = 15, 5, (3, 30), 4000, 8, 3, 6_000
VERSION = 1
_LOG = "passage_idx long, reply string, input_tokens long, output_tokens long"

Ask = Callable[[str, list[dict], int], tuple[str, int, int]]


@dataclass
class Synthesis:
    """queries (passage_idx, query), the examples, and tallies: replies, kept ones, tokens in and out, over all runs."""

    queries: DataFrame
    anchors: list[str]
    replies: int
    kept: int
    input_tokens: int
    output_tokens: int

    @property
    def retention(self) -> float:
        return self.kept / self.replies if self.replies else 0.0

    def cost(self, input_price: float, output_price: float) -> float:
        """In dollars, at prices for a million tokens."""
        return (self.input_tokens * input_price + self.output_tokens * output_price) / 1e6


def anchors_of(reply: str) -> list[str]:
    """Questions in a reply: a JSON array of strings, fenced or not, else its lines without bullets; of 3 to 30 words, five at most."""
    start, end = reply.find("["), reply.rfind("]")
    try:
        found = [x.strip() for x in json.loads(reply[start : end + 1]) if isinstance(x, str)]
    except ValueError:
        found = [x.strip().lstrip("-•*0123456789. )").strip(' "') for x in reply.splitlines() if x.strip() and not x.startswith("```")]
    return [x for x in found if ANCHOR_WORDS[0] <= len(x.split()) <= ANCHOR_WORDS[1]][:ANCHORS]


def anchor_prompt(description: str) -> str:
    return f"The passages below come from {description}. Write {ANCHORS} questions that someone who uses it would ask, in its own style and on its topics, without quoting. Reply with a JSON array of {ANCHORS} strings only."


def query_prompt(description: str, anchors: list[str]) -> str:
    examples = "".join(f"\n- {a}" for a in anchors)
    return f"You use {description}. Write the one question that the passage you are given answers, as you would ask it yourself: no quotes, no word about passages or texts. Reply with the question only." + (f"\nQuestions of this style, on other topics:{examples}" if examples else "")


def _folder(passages: DataFrame, cache: str, description: str, model: str) -> str:
    fields = [F.col("passage_idx").cast("string"), F.col("source_file"), F.col("text")]
    found = passages.agg(T.fingerprint(fields).alias("f")).first().f
    return f"{cache.rstrip('/')}/{_key(VERSION, model, description, found)}"


def _key(*parts) -> str:
    return hashlib.sha256("\x1e".join(map(str, parts)).encode()).hexdigest()[:16]


def _logged(spark: SparkSession, folder: str) -> DataFrame:
    """All whole lines of all logs; a line that was cut off by a crash doesn't count."""
    p, fs = _fs(spark, f"{folder}/logs")
    if not fs.exists(p) or not len(fs.listStatus(p)):
        return spark.createDataFrame([], _LOG)
    lines = spark.read.text(f"{folder}/logs").select(F.from_json("value", _LOG).alias("x"))
    return lines.where("x.passage_idx is not null and x.reply is not null").select("x.*").dropDuplicates(["passage_idx"])


def _ask_all(todo: DataFrame, folder: str, run_id: str, system: str, ask: Ask, at_once: int) -> DataFrame:
    """Asks every passage of todo (passage_idx, text), logging replies as they come; how many were answered and failed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        at, name = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        mine = f"{name}/logs/{run_id}-{TaskContext.get().partitionId()}-"
        at.create_dir(f"{name}/logs", recursive=True)
        done = set()
        for f in at.get_file_info(fs.FileSelector(f"{name}/logs")):  # what earlier tries of this task have
            if f.path.startswith(mine):
                for line in at.open_input_stream(f.path).read().decode().split("\n")[:-1]:
                    done.add(json.loads(line)["passage_idx"])
        answered = failed = 0
        with at.open_output_stream(f"{mine}{uuid.uuid4().hex}.jsonl") as log, ThreadPoolExecutor(at_once) as pool:
            waiting: dict[Future, int] = {}

            def take(when: str) -> None:
                nonlocal answered, failed
                for f in wait(waiting, return_when=when).done:
                    i = waiting.pop(f)
                    try:
                        reply, given, got = f.result()
                    except Exception:  # one call; the next run asks again
                        failed += 1
                        continue
                    log.write((json.dumps({"passage_idx": i, "reply": reply, "input_tokens": given, "output_tokens": got}) + "\n").encode())
                    log.flush()
                    answered += 1

            for b in batches:
                for i, text in zip(b.column("passage_idx").to_pylist(), b.column("text").to_pylist()):
                    if i not in done:
                        if len(waiting) >= at_once:
                            take(FIRST_COMPLETED)
                        waiting[pool.submit(ask, system, [{"role": "user", "content": (text or "").strip()[:SHOWN]}], 128)] = i
            while waiting:
                take(FIRST_COMPLETED)
        yield pa.RecordBatch.from_arrays([pa.array([answered]), pa.array([failed])], names=["answered", "failed"])

    return todo.select(F.col("passage_idx").cast("long").alias("passage_idx"), "text").mapInArrow(run, "answered long, failed long")


def generate(passages: DataFrame, ask: Ask, cache: str, description: str = "a knowledge model", model: str = "", per_file: int = PER_FILE, most: int = MOST, at_once: int = AT_ONCE, seed: int = 0, tasks: int = 4) -> Synthesis:
    """One query for each passage of a sample (`per_file` a file, `most` in all) of passages (passage_idx, source_file, text).

    ask(system, messages, most tokens) gives text, input tokens and output tokens; `tasks` times `at_once` calls run at a time. cache is a
    folder that driver and workers share. Calls that fail are asked again by the next run; replies that don't pass the filter aren't."""
    spark = passages.sparkSession
    folder = _folder(passages, cache, description, model)
    p, fs = _fs(spark, f"{folder}/anchors.json")
    if fs.exists(p):
        known = json.loads(_get(spark, f"{folder}/anchors.json"))
    else:
        h = F.sha2(F.concat_ws(":", F.lit(f"anchors {seed}"), "passage_idx"), 256)
        some = [r.text or "" for r in passages.orderBy(h).limit(ANCHOR_PASSAGES).select("text").collect()]
        known = {"anchors": [], "tokens": [0, 0]}
        if some:
            reply, *tokens = ask(anchor_prompt(description), [{"role": "user", "content": "\n\n".join(f"[{k}] {t.strip()[:1000]}" for k, t in enumerate(some, 1))}], 512)
            known = {"anchors": anchors_of(reply), "tokens": tokens}
        _put(spark, f"{folder}/anchors.json", json.dumps(known))
    sample = stratified(passages, per_file, most, seed).select("passage_idx", "text")
    todo = written(sample.join(_logged(spark, folder), "passage_idx", "left_anti"), "to-ask")
    _ask_all(todo.repartition(tasks), folder, uuid.uuid4().hex, query_prompt(description, known["anchors"]), ask, at_once).collect()  # two numbers a task
    replies = _logged(spark, folder)
    queries = good_queries(replies.select("passage_idx", F.trim("reply").alias("q"))).select("passage_idx", F.col("q").alias("query")).orderBy("passage_idx")
    n, given, got = replies.agg(F.count("*"), F.coalesce(F.sum("input_tokens"), F.lit(0)), F.coalesce(F.sum("output_tokens"), F.lit(0))).first()
    return Synthesis(queries, known["anchors"], n, queries.count(), given + known["tokens"][0], got + known["tokens"][1])
