"""Memory rows: recall through gates, listing, votes, retention, consolidation, capture and distilling.

A row: row_id, text, polarity (array), recurrence_count, created_at and
last_corroborated_at (ISO strings), transcript_hash, is_bad, vec.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritrove.functions import text as T
from veritrove.functions.vectors import dot
from veritrove.operators import corpus, search, simjoin

# Half-life in seconds, rows kept, and weight in recall of each tier.
TIERS = {"working": (86_400.0, 200, 0.5), "episodic": (14 * 86_400.0, 2_000, 0.3), "semantic": (float("inf"), 20_000, 0.2)}
FLOOR = 1e-3
ULID_ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _by_tier(tier: Column, k: int, default: float) -> Column:
    out = F.lit(default)
    for name, values in TIERS.items():
        out = F.when(tier == name, F.lit(float(values[k]))).otherwise(out)
    return out


def ulid() -> str:
    """26 Crockford digits: 48 bits of milliseconds, 80 of chance."""
    n = (int(time.time() * 1000) & (2**48 - 1)) << 80 | int.from_bytes(os.urandom(10), "big")
    return "".join(ULID_ALPHABET[n >> 5 * k & 31] for k in reversed(range(26)))


def recall(rows: DataFrame, q: list[float], scope: str | None, floor: float = 0.7, gap: float = 0.0, least_recurrence: int = 3, k: int = 5) -> DataFrame:
    """The rows that pass the gates, in this order: not bad, in scope, cosine at the floor; the lead over the second
    at least `gap`, else none; recurrence. A row that recurs too little can so veto the others by its closeness."""
    scopes = F.array(F.lit("cross-workspace"), *([F.lit(scope)] if scope else []))
    ok = rows.where(~F.col("is_bad") & F.arrays_overlap("polarity", scopes))
    ok = search.scored(ok, q).drop("vec").where(F.col("score") >= floor)
    top = ok.orderBy(F.desc("score"), "row_id").limit(2).agg(F.max("score").alias("_1"), F.min("score").alias("_2"), F.count("*").alias("_n"))
    lead = top.where((F.col("_n") < 2) | (F.col("_1") - F.col("_2") >= gap)).select(F.lit(1).alias("_pass"))
    passed = ok.withColumn("_pass", F.lit(1)).join(F.broadcast(lead), "_pass").drop("_pass")  # one row or none
    return passed.where(F.col("recurrence_count") >= least_recurrence).orderBy(F.desc("score"), "row_id").limit(k)


def tier_recall(entries: DataFrame, q: list[float], k: int = 10) -> DataFrame:
    s = search.scored(entries, q).drop("vec")
    return s.withColumn("score", F.col("score") * _by_tier(F.col("tier"), 2, 0.1) * F.col("salience")).orderBy(F.desc("score"), "id").limit(k)


def listed(rows: DataFrame, polarity: str | None = None, least_recurrence: int = 0, hide_bad: bool = True, limit: int | None = 50) -> DataFrame:
    r = rows.where(F.col("recurrence_count") >= least_recurrence)
    if polarity:
        r = r.where(F.array_contains("polarity", polarity))
    if hide_bad:
        r = r.where(~F.col("is_bad"))
    r = r.orderBy(F.desc("recurrence_count"), F.desc("created_at"), "row_id")
    return r if limit is None else r.limit(limit)


def gc_doomed(rows: DataFrame, is_bad: bool | None = None, polarity: str | None = None, most_recurrence: int | None = None, before: str | None = None) -> DataFrame:
    """row_id of the rows that all given filters match; refuses to match everything."""
    tests = []
    if is_bad is not None:
        tests.append(F.col("is_bad") == is_bad)
    if polarity is not None:
        tests.append(F.array_contains("polarity", polarity))
    if most_recurrence is not None:
        tests.append(F.col("recurrence_count") <= most_recurrence)
    if before is not None:
        tests.append(F.col("last_corroborated_at") < before)
    if not tests:
        raise ValueError("gc needs a filter")
    for t in tests:
        rows = rows.where(t)
    return rows.select("row_id")


def delete_rows(rows: DataFrame, doomed: DataFrame) -> DataFrame:
    return rows.join(doomed, "row_id", "left_anti")


def vote(rows: DataFrame, row_id: str, kind: str, now: str) -> DataFrame:
    """bad and good set and clear the flag; corroborate counts once more and stamps the time."""
    me = F.col("row_id") == row_id
    if kind in ("bad", "good"):
        return rows.withColumn("is_bad", F.when(me, F.lit(kind == "bad")).otherwise(F.col("is_bad")))
    if kind != "corroborate":
        raise ValueError(f"unknown vote {kind!r}")
    return rows.withColumns({"recurrence_count": F.when(me, F.col("recurrence_count") + 1).otherwise(F.col("recurrence_count")), "last_corroborated_at": F.when(me, F.lit(now)).otherwise(F.col("last_corroborated_at"))})


def voted(rows: DataFrame, votes: DataFrame, now: str) -> DataFrame:
    """rows after a table of votes (n, row_id, kind) in the order of n: the last of bad and good holds, each corroborate counts.

    One join, however many votes there are. Unknown kinds are refused when the result is read."""
    flag = F.col("kind").isin("bad", "good")
    kind = F.when(flag | (F.col("kind") == "corroborate"), F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown vote "), F.coalesce("kind", F.lit("null")))))
    v = votes.withColumn("kind", kind).groupBy("row_id").agg(
        F.max_by(F.when(flag, F.col("kind") == "bad"), F.when(flag, F.col("n"))).alias("_bad"), F.count_if(F.col("kind") == "corroborate").alias("_more")
    )
    r = rows.join(v, "row_id", "left")
    return r.withColumns({
        "is_bad": F.coalesce("_bad", "is_bad"),
        "recurrence_count": (F.col("recurrence_count") + F.coalesce("_more", F.lit(0))).cast(rows.schema["recurrence_count"].dataType),
        "last_corroborated_at": F.when(F.col("_more") > 0, F.lit(now)).otherwise(F.col("last_corroborated_at")),
    }).drop("_bad", "_more")


def retained(entries: DataFrame, now: Column) -> DataFrame:
    """entries (tier, salience, created_utc, id) with `effective`, decayed; those above the floor, as many as each tier holds."""
    age = T.age_seconds(F.col("created_utc"), now)
    e = entries.withColumn("effective", T.decay(F.col("salience"), age, _by_tier(F.col("tier"), 0, float("inf"))))
    e = e.where(F.col("effective") >= FLOOR)
    # the tier's cap is found without one task per tier: rank within salted parts, then among what they keep
    w1 = Window.partitionBy("tier", "_salt").orderBy(F.desc("effective"), "id")
    w2 = Window.partitionBy("tier").orderBy(F.desc("effective"), "id")
    cap = _by_tier(F.col("tier"), 1, 20_000.0)
    e = e.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= cap)
    return e.withColumn("_r", F.row_number().over(w2)).where(F.col("_r") <= cap).drop("_r", "_salt")


def consolidated(entries: DataFrame, threshold: float = 0.92, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(one row for each cluster of `least` and more: id of its first member, recurrence_count), (ids that it replaces)."""
    c = corpus.clusters(entries.select("id", "vec"), threshold)
    big = c.groupBy("cluster_id").agg(F.count("*").alias("recurrence_count")).where(F.col("recurrence_count") >= least)
    return big.select(F.col("cluster_id").alias("id"), "recurrence_count"), c.join(big, "cluster_id", "left_semi").select("id")


def capture_gate(messages: DataFrame, least_chars: int = 200, require_tool_use: bool = True) -> DataFrame:
    """conv_id, captured, reason of each transcript (conv_id, role, text, n_tools)."""
    role = F.col("role")
    chars = F.length(F.coalesce("text", F.lit("")))
    g = messages.groupBy("conv_id").agg(
        F.sum(F.when(role == "assistant", chars).otherwise(0)).alias("said"),
        F.sum(F.when(role == "user", 1).otherwise(0)).alias("asks"),
        F.sum(F.when(role == "user", chars).otherwise(0)).alias("asked"),
        F.sum("n_tools").alias("tools"),
    )
    reason = F.when(F.col("said") < least_chars, "short_assistant")
    if require_tool_use:
        reason = reason.when(F.col("tools") < 1, "no_tool_use")
    reason = reason.when((F.col("asks") <= 1) & (F.col("asked") <= 30), "trivial")
    return g.select("conv_id", reason.isNull().alias("captured"), F.coalesce(reason, F.lit("")).alias("reason"))


def captured(messages: DataFrame, workspace: str, now: str, require_tool_use: bool = False, most_chars: int = 24_000) -> DataFrame:
    """A factual row for each transcript that passes the gate: what the assistant said, in order, scrubbed and cut.

    messages has conv_id, turn, role, text, n_tools, and may have session_id and tools (array of name, path, content), which
    then count in the transcript's hash. A transcript's messages are sorted by turn within a partition and go by one at a
    time, through a running hash and a running cut, so a transcript may be of any length."""
    ok = capture_gate(messages, require_tool_use=require_tool_use).where("captured").select("conv_id")
    closed = lambda *parts: F.concat(*(x for p in parts for x in (F.coalesce(p, F.lit("")), F.lit("\x00"))))
    hashed = closed(F.col("role"), F.col("text"))
    if "tools" in messages.columns:
        called = F.transform("tools", lambda t: closed(t["name"], t["path"], t["content"]))
        hashed = F.concat(hashed, F.coalesce(F.array_join(called, ""), F.lit("")))
    session = closed(F.col("session_id")) if "session_id" in messages.columns else F.lit("")
    said = F.when(F.col("role") == "assistant", T.redact(F.col("text")))
    rows = messages.join(ok, "conv_id").select("conv_id", "turn", "role", "text", hashed.alias("hashed"), session.alias("session"), said.alias("said"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "hashed", "session", "said")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, pieces, chars, kind, any_ = None, None, [], 0, None, False

        def ended() -> pa.RecordBatch:
            body = "\n\n".join(pieces)[:most_chars]
            return pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([body]), pa.array([sha.hexdigest()])], names=["conv_id", "text", "transcript_hash"])

        for b in batches:
            kind = b.schema.field("conv_id").type
            for now_at, h, s, t in zip(*(b.column(c).to_pylist() for c in ("conv_id", "hashed", "session", "said"))):
                if not any_ or now_at != conv:
                    if any_:
                        yield ended()
                    conv, sha, pieces, chars, any_ = now_at, hashlib.sha256(s.encode()), [], 0, True
                sha.update(h.encode())
                if t is not None and chars < most_chars:  # what comes after the cut isn't kept
                    pieces.append(t)
                    chars += len(t) + 2
        if any_:
            yield ended()

    made = rows.mapInArrow(run, f"conv_id {messages.schema['conv_id'].dataType.simpleString()}, text string, transcript_hash string")
    return made.select(
        "conv_id", "text",
        F.array(F.lit("factual"), F.lit(workspace)).alias("polarity"),
        F.lit(1).alias("recurrence_count"), F.lit(now).alias("created_at"), F.lit(now).alias("last_corroborated_at"),
        "transcript_hash", F.lit(False).alias("is_bad"),
    )


def capture_rows(rows: DataFrame) -> DataFrame:
    """Raw captures: factual, and neither manual, distilled nor migrated."""
    h = F.col("transcript_hash")
    return rows.where(F.array_contains("polarity", "factual") & (h != "manual") & ~h.startswith("distilled:") & ~h.startswith("migrated:"))


def distil_input(rows: DataFrame, session: str | None = None, everything: bool = False, since: str | None = None, watermark: str | None = None) -> DataFrame:
    """What to distil: a session's rows, else all, else those after `since`, else those after the watermark (strictly)."""
    r = capture_rows(rows)
    if session is not None:
        return r.where(F.col("transcript_hash") == session)
    after = None if everything else since or watermark
    return r if after is None else r.where(F.col("created_at") > after)


def dedupe_match(candidates: DataFrame, rows: DataFrame, threshold: float = 0.92) -> DataFrame:
    """candidate id, row_id, cosine of the best row of the same primary polarity at the threshold; ties go to the larger row_id.

    Similar pairs are found first, by blocks; polarities are compared only on those."""
    primary = lambda c: F.get(F.filter(c, lambda t: t.isin("prefer", "avoid", "factual")), F.lit(0))
    j = simjoin.pairs(candidates.select("id", "vec"), rows.select(F.col("row_id").alias("id"), "vec"), threshold)
    c = candidates.select(F.col("id").alias("a"), primary(F.col("polarity")).alias("p"))
    r = rows.select(F.col("row_id").alias("b"), primary(F.col("polarity")).alias("p2"))
    j = j.join(c, "a").join(r, "b").where("p = p2")
    return j.groupBy(F.col("a").alias("id")).agg(F.max_by("b", F.struct("cosine", "b")).alias("row_id"), F.max("cosine").alias("cosine"))


def add_rows(rows: DataFrame, new: DataFrame) -> DataFrame:
    """rows and new ones; an error if a new row's polarity isn't valid. Write the result as the next snapshot."""
    return rows.unionByName(new.withColumn("polarity", T.valid_polarity(F.col("polarity"))))


def corroborated(rows: DataFrame, matches: DataFrame, now: str) -> DataFrame:
    """rows with recurrence_count raised by their matches (row_id, one row each) and the time stamped."""
    n = matches.groupBy("row_id").agg(F.count("*").alias("_more"))
    r = rows.join(n, "row_id", "left")
    hit = F.col("_more").isNotNull()
    return r.withColumns({
        "recurrence_count": F.col("recurrence_count") + F.coalesce("_more", F.lit(0)),
        "last_corroborated_at": F.when(hit, F.lit(now)).otherwise(F.col("last_corroborated_at")),
    }).drop("_more")


def unseen(candidates: DataFrame, journal: DataFrame) -> DataFrame:
    """Candidates whose (row_id, transcript_hash) isn't in the journal. Append them to it before acting on them."""
    return candidates.join(journal.select("row_id", "transcript_hash").distinct(), ["row_id", "transcript_hash"], "left_anti")


def append_log(rows: DataFrame, path: str) -> None:
    """Audit, journal and cache tables only grow."""
    rows.write.mode("append").json(path)


def latest_capture(rows: DataFrame) -> DataFrame:
    """transcript_hash of the newest raw capture, as one row (null without any)."""
    return capture_rows(rows).agg(F.max_by("transcript_hash", F.struct("created_at", "row_id")).alias("transcript_hash"))


def replaced_tier(entries: DataFrame, tier: str, new: DataFrame) -> DataFrame:
    return entries.where(F.col("tier") != tier).unionByName(new.withColumn("tier", F.lit(tier)))


LLM = Callable[[str, list[dict], int], tuple[str, int, int]]


def lessons(reply: str, workspace: str, most: int = 2) -> list[dict]:
    """The lessons in a model's reply: objects with text and a valid polarity, of the first JSON array in it that has only objects."""
    at = reply.find("[")
    while at >= 0:
        try:
            found, _ = json.JSONDecoder().raw_decode(reply[at:])
        except ValueError:
            found = [None]
        if all(isinstance(x, dict) for x in found):
            return _valid_lessons(found, workspace)[:most]
        at = reply.find("[", at + 1)
    return []


def _valid_lessons(found: list[dict], workspace: str) -> list[dict]:
    out = []
    for x in found:
        if not isinstance(x.get("text"), str) or not x["text"].strip() or not isinstance(x.get("polarity"), list):
            continue
        tags = [str(t).replace("{workspace_hash}", workspace) for t in x["polarity"]]
        if sum(t in ("prefer", "avoid", "factual") for t in tags) == 1:
            out.append({"text": x["text"].strip(), "polarity": tags, "intent": x.get("intent") or ""})
    return out


def distil(captures: list[dict], workspace: str, ask: LLM, scrubs: Callable[[str], bool], seen: set[tuple[str, str]], most: int = 2) -> list[dict]:
    """Lessons from captured rows (row_id, text, transcript_hash), none twice for a (row, transcript) and none that holds a secret.

    seen is the journal; what is returned was added to it first, so a repeat is never counted twice."""
    out = []
    for c in captures:
        key = (c["row_id"], c["transcript_hash"])
        if key in seen:
            continue
        reply, _, _ = ask("Return a JSON array of lessons with text, polarity and intent.", [{"role": "user", "content": c["text"]}], 1024)
        seen.add(key)
        for lesson in lessons(reply, workspace, most):
            if not scrubs(lesson["text"]):
                out.append({**lesson, "transcript_hash": c["transcript_hash"] if c["transcript_hash"].startswith("distilled:") else f"distilled:{c['transcript_hash']}"})
    return out


def migrated(entries: DataFrame, workspace: str, default: str = "factual") -> DataFrame:
    """Layered entries (text, tier, created_utc, recurrence_count) as rows: polarity by its verbs, origin by its tier."""
    return entries.select(
        "text", F.array(T.polarity(F.col("text"), default), F.lit(workspace)).alias("polarity"), "recurrence_count",
        F.col("created_utc").alias("created_at"), F.col("created_utc").alias("last_corroborated_at"),
        F.concat(F.lit("migrated:"), F.col("tier")).alias("transcript_hash"), F.lit(False).alias("is_bad"),
    )


def migration_tallies(rows: DataFrame) -> DataFrame:
    """primary polarity, tier it came from, n of migrated rows."""
    tier = F.regexp_replace("transcript_hash", "^migrated:", "")
    return rows.groupBy(F.get("polarity", F.lit(0)).alias("primary_polarity"), tier.alias("tier")).agg(F.count("*").alias("n"))


def checked_migration(entries: DataFrame, target: DataFrame, workspace: str) -> DataFrame:
    """migrated(), refused where the target has rows."""
    if not target.isEmpty():
        raise ValueError("the target has rows; migrate into an empty store")
    return migrated(entries, workspace)


def tier_sizes(entries: DataFrame) -> DataFrame:
    return entries.groupBy("tier").agg(F.count("*").alias("n"))


def injection_block(rows: list, budget: int = 6_000) -> str:
    """Lines of polarity and text, whole rows only, while they fit; the first isn't exempt."""
    out, used = [], 0
    for r in rows:
        line = f"- *{r['polarity'][0]}* — {r['text']}"
        if used + len(line) + 1 > budget:
            break
        out.append(line)
        used += len(line) + 1
    return "\n".join(out)


def primer(entries: DataFrame, k: int = 10, novelty: float = 0.3) -> DataFrame:
    """Semantic and episodic entries near their common centroid, semantic ones at full weight, the others at 0.7."""
    e = entries.where(F.col("tier").isin("semantic", "episodic"))
    c = corpus.centroid(e.select("vec")).select(F.col("vec").alias("_c"), F.lit(1).alias("_k"))
    s = e.withColumn("_k", F.lit(1)).join(F.broadcast(c), "_k").withColumn("score", dot("vec", "_c")).where(F.col("score") >= novelty)  # one row
    return s.withColumn("score", F.col("score") * F.when(F.col("tier") == "semantic", 1.0).otherwise(0.7)).drop("_c", "_k", "vec").orderBy(F.desc("score"), "id").limit(k)
