from __future__ import annotations

import os

import pytest

from talkmill.operators.translation_memory import remembered, translate_once


@pytest.fixture
def calls(tmp_path):
    """Texts a translator was asked for, over all processes."""
    at = tmp_path / "calls"
    at.mkdir()
    return at


def translator(calls, down=()):
    folder = str(calls)

    def run(texts, code):
        with open(os.path.join(folder, f"{os.getpid()}.txt"), "a") as f:
            f.writelines(f"{code}:{t}\n" for t in texts)
        if code in down:
            raise RuntimeError("translator down")
        return [f"[{code}] {t}" for t in texts]

    return run


def asked(calls):
    return sorted(line for p in calls.iterdir() for line in p.read_text().splitlines())


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, comment_text string, source_code string, other int").repartition(5)


def test_copies_cost_one_call_and_failures_are_not_remembered(spark, tmp_path, calls):
    memory = str(tmp_path / "memory")
    rows = [(i, "hot text", "de", 1) for i in range(1000)] + [(2000, "hot text", "fr", 1), (2001, "lost", "hi", 2), (2002, "lost", "hi", 2), (2003, None, "de", 3), (2004, "", "de", 3), (2005, "none", None, 4)]
    got = translate_once(table(spark, rows), translator(calls, ["hi"]), memory).collect()
    assert len(got) == len(rows)
    by = {r.id: (r.translation, r.translation_failed) for r in got}
    assert by[5] == ("[de] hot text", False) and by[2000] == ("[fr] hot text", False) and by[2001] == by[2002] == ("lost", True)
    assert by[2003] == by[2004] == ("[de] ", False) and by[2005] == (None, False)
    assert asked(calls) == ["de:", "de:hot text", "fr:hot text", "hi:lost"]
    # The next run asks only for what is new or failed.
    again = translate_once(table(spark, [(1, "hot text", "de", 1), (2, "lost", "hi", 1), (3, "new", "de", 1)]), translator(calls), memory).collect()
    assert {r.id: r.translation for r in again} == {1: "[de] hot text", 2: "[hi] lost", 3: "[de] new"} and not any(r.translation_failed for r in again)
    assert asked(calls) == ["de:", "de:hot text", "de:new", "fr:hot text", "hi:lost", "hi:lost"]
    assert remembered(spark, memory).count() == 5


def test_nothing_to_translate(spark, tmp_path, calls):
    memory = str(tmp_path / "memory")
    assert translate_once(table(spark, []), translator(calls), memory).collect() == []
    assert [r.translation for r in translate_once(table(spark, [(1, "a", None, 1)]), translator(calls), memory).collect()] == [None]
    assert asked(calls) == [] and remembered(spark, memory).count() == 0
