"""Query synthesis: anchors, caps, filter, and what is asked again after crashes, failures and repeated runs."""

import collections
import os

import pytest
from pyspark.sql import functions as F

from veritrove.operators import synthesis as Y


def passages(spark, n=40, files=20):
    return spark.createDataFrame([(k, f"f{k % files}", f"Text number {k} about engines.") for k in range(n)], "passage_idx long, source_file string, text string")


def asker(path, dies_after=None, fails=()):
    """A model that notes each call in a file; it may take the worker down, or fail for some passages."""

    def ask(system, messages, most):
        text = messages[0]["content"]
        if text.startswith("[1]"):
            kind = "anchors"
        else:
            kind = text.split()[2]
        with open(path, "a") as f:
            f.write(kind + "\n")
        if dies_after is not None and sum(1 for _ in open(path)) > dies_after:
            os._exit(1)
        if kind in fails:
            raise ConnectionError("no reply")
        if kind == "anchors":
            return 'Sure:\n```json\n["How do engines work today?", "no", "What is in text number one?"]\n```', 100, 10
        return (f"What does number {kind} say of engines?" if int(kind) % 5 else "This passage says little"), 10, 3

    return ask


def calls(path):
    return collections.Counter(open(path).read().split())


def test_whole_run(spark, tmp_path):
    log = str(tmp_path / "calls")
    run = lambda **kw: Y.generate(passages(spark), asker(log), str(tmp_path / "cache"), "manuals", at_once=3, **kw)
    s = run()
    assert s.anchors == ["How do engines work today?", "What is in text number one?"]
    assert calls(log) == {"anchors": 1} | {str(k): 1 for k in range(40)}
    assert [r.passage_idx for r in s.queries.collect()] == [k for k in range(40) if k % 5] and (s.replies, s.kept) == (40, 32)
    assert (s.input_tokens, s.output_tokens) == (500, 130) and s.retention == 0.8 and s.cost(1.0, 10.0) == pytest.approx(0.0018)
    again = run()
    assert sum(calls(log).values()) == 41 and again.queries.collect() == s.queries.collect() and again.input_tokens == 500
    Y.generate(passages(spark).withColumn("text", F.concat("text", F.lit("!"))), asker(log), str(tmp_path / "cache"), "manuals", per_file=1, most=7)
    assert sum(calls(log).values()) == 41 + 1 + 7  # other texts, another cache; the caps hold


def test_killed_half_way(spark, tmp_path):
    log, cache = str(tmp_path / "calls"), str(tmp_path / "cache")
    with pytest.raises(Exception):
        Y.generate(passages(spark), asker(log, dies_after=15), cache, at_once=1, tasks=1)
    before = calls(log)
    assert sum(before.values()) == 16
    s = Y.generate(passages(spark), asker(log), cache, at_once=1, tasks=2)
    again = [k for k, n in calls(log).items() if n > 1]
    assert len(again) == 1 and s.replies == 40  # only the call during which the worker died


def test_failures_are_asked_again(spark, tmp_path):
    log, cache = str(tmp_path / "calls"), str(tmp_path / "cache")
    s = Y.generate(passages(spark), asker(log, fails=("7", "8")), cache)
    assert s.replies == 38
    s = Y.generate(passages(spark), asker(log), cache)
    assert s.replies == 40 and {k for k, n in calls(log).items() if n > 1} == {"7", "8"}
    part = next((tmp_path / "cache").glob("*/logs"))
    (part / "torn.jsonl").write_text('{"passage_idx": 99, "re')
    assert Y.generate(passages(spark), asker(log), cache).replies == 40


def test_anchors_of():
    assert Y.anchors_of("- one two three?\n2) four five six?\nshort") == ["one two three?", "four five six?"]
    assert Y.anchors_of("[]") == [] and Y.anchors_of('["a b c"]' + " x" * 50) == ["a b c"]
    assert len(Y.anchors_of(str([f"what is the number {k}" for k in range(9)]).replace("'", '"'))) == 5
