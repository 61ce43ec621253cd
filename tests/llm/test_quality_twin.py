"""The whole quality query beside a plain Python twin that enumerates labelings."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from veridelta.llm import crf, quality_classifier


def texts(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeéñ", k=rng.randint(1, 14)))
    good = lambda: " ".join(word() for _ in range(rng.randint(4, 14))).capitalize() + "."
    bad = lambda: rng.choice((" ".join(f"{word().upper()}!!" for _ in range(6)), " | ".join(word() for _ in range(8)), "12 34 " * 5, "### $$ word"))
    out = []
    for i in range(160):
        y = int(rng.random() < 0.7)
        lines = [(good if rng.random() < (0.9 if y else 0.2) else bad)() for _ in range(rng.randint(1, 7))]
        if rng.random() < 0.3:
            lines.insert(rng.randint(0, len(lines)), rng.choice(("", "  ", lines[0])))
        out.append((i, "\n".join(lines), y))
    return out


def measures(lines):
    seen, out = set(), []
    for line in lines:
        words = line.split()
        if not words:
            out.append([0.0] * 16)
            continue
        n, count = len(words), Counter(words)
        symbols = sum(c in "#*$%&|<>{}[]=_~^\\/" for c in line)
        out.append(
            [
                min(1, math.log1p(n) / 8), min(1, sum(map(len, words)) / n / 12), min(1, symbols / n / 2),
                min(1, sum(c in "0123456789" for c in line) / len(line) * 4), sum(c != c.lower() for c in line) / len(line),
                len(count) / n, max(count.values()) / n, sum(len(w) < 4 for w in count) / len(count), sum(len(w) < 4 for w in words) / n,
                float(line.rstrip()[-1] in ".?!\"'”»…"), float(words[0][0].isupper()), float(line in seen), min(1, line.count("!") / n),
                min(1, len(re.findall("[,.]", line)) / n * 3), sum(len(w) > 12 for w in words) / n, sum(a == b for a, b in zip(words, words[1:])) / n,
            ]
        )
        seen.add(line)
    return out


def twin_score(text, model):
    lines = (text or "").split("\n")
    if not any(x.strip() for x in lines):
        return model.prior
    width = 16 * 9
    active = [[k * 9 + min(int(np.float32(v) * 8), 7) + (v > 0) for k, v in enumerate(m)] for m in measures(lines)]
    emission = []
    for i in range(len(lines)):
        near = [[j + part * width for j in active[i + step]] if 0 <= i + step < len(lines) else [3 * width] * 16 for part, step in ((0, 0), (1, -1), (2, 1))]
        emission.append(sum(model.weights[j] for part in near for j in part))
    weight, good = 0.0, [0.0] * len(lines)
    for labels in itertools.product((0, 1), repeat=len(lines)):
        p = math.exp(sum(e for e, y in zip(emission, labels) if y) + sum(model.trans[a][b] for a, b in zip(labels, labels[1:])))
        weight += p
        good = [g + p * y for g, y in zip(good, labels)]
    sizes = [len(x) if x.strip() else 0 for x in lines]
    share = min(max(sum(n * g / weight for n, g in zip(sizes, good)) / sum(sizes), 1e-4), 1 - 1e-4)
    return 1 / (1 + math.exp(-(model.slope * math.log(share / (1 - share)) + model.shift)))


def test_query_against_enumeration(spark):
    rows = texts()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    more = [(900, None), (901, ""), (902, " \n "), (None, rows[0][1]), (5, rows[5][1])]
    docs = spark.createDataFrame([r[:2] for r in rows] + more, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1), (777, 0)], "doc_id long, quality int")
    model = quality_classifier.fit(docs, labels)
    text = dict([r[:2] for r in rows] + more)
    got = quality_classifier.quality(docs, labels).collect()
    assert len(got) == len(rows) + len(more)
    for r in got:
        want = twin_score(text[r["doc_id"]], model)
        assert r["score"] == pytest.approx(want, abs=1e-6)
        assert r["held_out"] == held(r["doc_id"]) and r["predicted"] == int(r["score"] >= 0.3)
    right = [(r["predicted"], dict((i, y) for i, _, y in rows)[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert len(right) > 15 and sum(a == b for a, b in right) / len(right) > 0.7


def test_long_texts_are_scored_but_not_learnt(spark, monkeypatch):
    monkeypatch.setattr(quality_classifier, "TRAIN_CHARS", 200)
    rows = texts()
    learnt = []
    monkeypatch.setattr(crf, "train", lambda t, y: learnt.extend(t) or crf.Model(np.zeros(3 * crf.WIDTH + 1), np.zeros((2, 2))))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    assert quality_classifier.quality(docs, labels).count() == len(rows)
    assert learnt and max(map(len, learnt)) <= 200 < max(len(t) for _, t, _ in rows)
