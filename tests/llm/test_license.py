"""The licence scan's query against word loops and dictionaries."""

import math
import os
import re

import pytest

from oarframe.llm import license_scan, registry

SF = "/root/testdata/sf0.001"
MASK, BASE = (1 << 64) - 1, 0x9E3779B97F4A7C15
MARKS = set(b"#*/;-%!=|<>+~_")


def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def words_of(line):
    return [w.lower() for w in re.findall(rb"[^\x20\x09-\x0d]+", line) if not set(w) <= MARKS]


def word_hash(word):
    return mix(sum((b + 1) * pow(BASE, k + 1, 1 << 64) for k, b in enumerate(word)) & MASK ^ len(word))


def grams(words, n):
    out = []
    for i in range(len(words) - n + 1):
        value = 0
        for w in words[i : i + n]:
            value = mix((value * BASE + w) & MASK)
        out.append(value if n > 1 else words[i])
    return out


def judged(model, line):
    """(class, probability) of a line, by a dictionary of weights."""
    hashes = [word_hash(w) for w in words_of(line)]
    found = [g for n in (1, 2, 3) for g in grams(hashes, n)]
    logits = [float(b) for b in model.weights[-1]]
    for g in found:
        row = model.weights[(g >> 20) % license_scan.DIMS]
        logits = [x + float(w) / math.sqrt(len(found)) for x, w in zip(logits, row)]
    top = max(logits)
    odds = [math.exp((x - top) / model.temperature) for x in logits]
    best = max(range(len(odds)), key=lambda c: odds[c])
    return best, odds[best] / sum(odds), set(grams(hashes, 3))


def notices_of(model, text, threshold=0.25, confirm=0.6):
    """[(family, probability)] of one text, line by line; None if template words stand on several lines of one block."""
    none, vague = len(model.classes) - 1, len(model.classes) - 2
    templates = [(c, {int(g) for g in t}) for c, t in model.templates]
    known = set().union(*(t for _, t in templates))
    out, lines = [], text.encode().split(b"\n")
    block, owners = [], []
    for i, line in enumerate([*lines, b""]):
        words = [word_hash(w) for w in words_of(line)]
        if words:
            block += words
            owners += [i] * len(words)
            continue
        hits = [k for k, g in enumerate(grams(block, 3)) if g in known]
        if hits and owners[hits[0]] != owners[hits[-1] + 2]:
            return None
        block, owners = [], []
    for line in lines:
        best, p, own = judged(model, line)
        found = None
        if best != none and p >= threshold and (best == vague or own & known):
            share = max((len(t & own) / len(t) for c, t in templates if c == best), default=0)
            found = (model.classes[best] if share >= confirm else "unknown", p)
        for tag in license_scan.TAG.finditer(line):
            family = license_scan.SPDX.get(tag[1].decode())
            if family or not found:
                found = (family or "unknown", 1.0)
        if found:
            out.append(found)
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_op7_query_equals_word_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = license_scan.train(docs)
    got = {r["doc_id"]: r for r in registry.queries()["op7_license_scan"](spark, SF).collect()}
    compared = licensed = 0
    for doc_id, text in docs.collect():
        notices = notices_of(model, text or "")
        if notices is None:
            continue  # notices over several lines have tests of their own
        compared += 1
        sure = [n for n in notices if n[0] != "unknown"]
        licensed += bool(sure)
        r = got[doc_id]
        assert (doc_id, r["n_paragraphs"], r["families"], r["n_unknown"]) == (doc_id, len(sure), ",".join(sorted({f for f, _ in sure})), len(notices) - len(sure))
        assert r["probability"] == pytest.approx(max((p for _, p in sure), default=0.0), abs=2e-4)
    assert compared == len(got) == docs.count() and licensed > 0
