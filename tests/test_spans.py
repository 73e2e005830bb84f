"""Shared and own spans against all pairs of titles, in pieces of any size."""

import random
import re

import pytest

from resultlake.operators import scans, spans

SEP = r"[_\-|｜·•,，、;；:：()（）\[\]【】<>《》\"'“”…\s]+"


def brute(rows, label=""):
    out = {}
    groups = {}
    for g, t in rows:
        if t:
            groups.setdefault(g, []).append(t[:200])
    for g, all_ in groups.items():
        for t in set(all_):
            others = list(all_)
            others.remove(t)
            held = lambda s: any(s in o for o in others)
            shared = max((next((t[i : i + n] for n in range(len(t) - i, 0, -1) if held(t[i : i + n])), "") for i in range(len(t))), key=len, default="")
            own = ""
            if others and len(t) >= 2 and not held(t) and re.search("[A-Za-z0-9一-鿿]", t):
                segs = [s for s in (x.strip(".") for x in re.split(SEP, t)) if s]
                free = [s for s in segs if len(s) >= 2 and not held(s) and not (label and label in s)]
                best = max(free, key=len) if free else max(segs, key=len) if segs else t
                own = best[:14]
            out[g, t] = all_.count(t), shared, own
    return out


@pytest.mark.parametrize("piece", [7, 60, 10**6])
def test_spans_equal_all_pairs(spark, monkeypatch, piece):
    monkeypatch.setattr(scans, "PIECE", piece)
    rng = random.Random(2)
    words = ["harbour", "port", "北京", "extension", "v1.2", "...dots.", "a", "aaaa", "aaa", "计划", "b"]
    rows = [("hot", " - ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))) for _ in range(40)]
    rows += [("few", t) for t in ("one", "only one", "one", "—", "。", "x", "alone|together")] + [(None, "without group"), (None, "with"), ("single", "no sibling here"), ("odd", None), ("odd", ""), ("long", "p" * 300), ("long", "p" * 250 + "q"), ("long", "q" + "p" * 100)]
    frame = spark.createDataFrame(rows, "group string, title string").repartition(3)
    got = {(r.group, r.title): (r.n, r.shared, r.own) for r in spans.spans(frame).collect()}
    assert got == brute(rows)
    labelled = {(r.group, r.title): (r.n, r.shared, r.own) for r in spans.spans(frame, "'port'").collect()}
    assert labelled == brute(rows, "port")
    assert spans.spans(frame.limit(0)).collect() == []


@pytest.mark.parametrize("piece", [3, 10**6])
def test_suffixes_are_sorted_once(spark, monkeypatch, piece):
    monkeypatch.setattr(scans, "PIECE", piece)
    rows = [("g", t) for t in ("a\0b", "a\0", "a", "\0", "x😀y", "😀y 😀", "aaaa", "aa", "￿😀")] + [("h", "aaaaaa"), ("h", "😀")]
    found = spans.spans(spark.createDataFrame(rows, "group string, title string"))
    got = {(r.group, r.title): r.shared for r in found.collect()}
    assert got == {k: v[1] for k, v in brute(rows).items()}
    # pieces come sorted; no window over all suffixes sorts them again
    assert not re.search(r"Window.*suffix#\d+ (ASC|DESC)", found._jdf.queryExecution().executedPlan().toString())
