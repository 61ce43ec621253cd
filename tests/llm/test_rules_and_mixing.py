"""Quality rules, source mixing, packing and url rules against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from veridelta.llm import mixing, packing, quality_rules, queries, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, mix_key string, n long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, "clash", 1) for i, t, s in rows], SCHEMA).repartition(3)


def texts(seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 9)))
    out = [None, "", " \n\t", "a", "a b c a b c", "x" * 5000, "# | $ " * 40, "same line\n" * 30, "a b\r\nc\x0b\x0cd", "\u00a0 \u3000 w"]
    for _ in range(40):
        n = rng.choice([3, 49, 50, 51, 120, 400])
        words = [word() for _ in range(n)]
        if rng.random() < 0.4:
            words[n // 2 :] = words[: n - n // 2]
        lines = [" ".join(words[i : i + 9]) for i in range(0, n, 9)]
        if rng.random() < 0.3:
            lines += [lines[0]] * 40
        out.append(rng.choice(["\n", " \n ", "\n\n"]).join(lines))
    plain = [f"{word()} {word()}{i}" for i in range(60)]
    out += [" ".join(plain).upper(), " | ".join(plain), "! ".join(plain), "...\n".join(plain), " … \n".join(plain), "\n".join(plain)]
    return out + ["one two three four five " * 4000]


def plain_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n, chars = len(words), sum(map(len, words))
    symbols, dup, repeat = sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)
    failed = n < 50 or 100 * repeat > 50 * n
    bad = failed or chars < 2 * n or chars > 20 * n or symbols * 2 > n or dup * 10 > len(lines) * 6
    bad |= text.count("!") * 10 > n * 3
    bad |= sum(not any(c.isalnum() for c in w) for w in words) * 10 > n * 3
    bad |= sum(bool(re.search("(?:\\.\\.\\.|…)[ \t\x0b\f\r]*$", x)) for x in lines) * 10 > len(lines) * 3
    return n, chars, symbols, dup, repeat, failed, not bad


def test_later_measures_are_not_taken_of_rejected_rows(spark):
    """The costly rule would fail on the texts that the cheap one rejects."""
    rules = (
        quality_rules.Rule("cheap", lambda m: F.startswith(m.text, F.lit("bad"))),
        quality_rules.Rule("costly", lambda m: F.when(F.startswith(m.text, F.lit("bad")), F.raise_error(F.lit("measured"))).otherwise(False)),
    )
    df = docs(spark, [(i, f"{'bad' if i % 2 else 'good'} text", "s") for i in range(20)]).select(F.col("text"), "doc_id")
    found = df.select("doc_id", quality_rules.judged(rules, F.col("text")).alias("by")).collect()
    assert all(r["by"] == ("cheap" if r["doc_id"] % 2 else None) for r in found)
    with pytest.raises(Exception, match="measured"):
        df.select(quality_rules.judged(rules[::-1], F.col("text")).alias("by")).collect()


def test_cheap_selective_rules_come_first(spark):
    rows = [(i, ("x " * 300 if i % 2 else "short"), "s") for i in range(60)]
    never = quality_rules.Rule("never", lambda m: m("n_repeat_words") < 0)
    order = quality_rules.rule_order(docs(spark, rows), (never, *quality_rules.BASE_RULES))
    assert {r.name for r in order} == {"never", "few_words", "repeated_windows"} and order[-1].name == "never"


def test_a_filter_on_the_verdict_keeps_the_measures_single(spark):
    found = quality_rules.quality_rules(docs(spark, [(1, "a b c", "s")]))
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in (found, found.filter("kept and n_repeat_words < 3"))]
    assert plans[0].count("xxhash64") == plans[1].count("xxhash64")


def test_quality_rules(spark):
    rows = [(i, t, "s") for i, t in enumerate(texts())]
    rows += rows[:2] + [(None, "a null id", None)]
    got = quality_rules.quality_rules(docs(spark, rows)).collect()
    want = sorted(((i, *plain_rules(t)) for i, t, _ in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    kept = quality_rules.keep_good(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r[0] for r in want if r[-1])


def test_order_changes_no_verdict(spark):
    df = docs(spark, [(i, t, "s") for i, t in enumerate(texts(5))])
    want = {tuple(r) for r in quality_rules.quality_rules(df).collect()}
    assert {tuple(r) for r in quality_rules.quality_rules(df, quality_rules.RULES[::-1]).collect()} == want


def test_rules_run_by_rejection_per_cost(spark):
    keen = quality_rules.Rule("keen", lambda m: m("n_words") >= 0)
    lax = quality_rules.Rule("lax", lambda m: m("n_words") < 0)
    df = docs(spark, [(i, "a b", "s") for i in range(50)])
    assert [r.name for r in quality_rules.rule_order(df, (lax, keen))] == ["keen", "lax"]


def test_rules_of_nothing(spark):
    none = docs(spark, [(1, "x", "s")]).limit(0)
    assert quality_rules.quality_rules(none).count() == 0 and quality_rules.keep_good(none).count() == 0


# --- mixing ---------------------------------------------------------------


def plain_draw(rate, doc_id, text, seed=mixing.SEED):
    ident = "null" if doc_id is None else str(doc_id)
    u = int(hashlib.md5(f"{seed}|{ident}|{text or ''}".encode()).hexdigest()[:12], 16) / 2**48
    k, p = 0, math.exp(-rate)
    cdf = p
    while cdf <= u:
        k += 1
        p *= rate / k
        cdf += p
    return k


def mixed_rows(seed=0):
    rng = random.Random(seed)
    rows = [(i, "w" * rng.randint(1, 50), "hot") for i in range(400)]
    rows += [(1000 + i, "w" * rng.randint(1, 50), rng.choice(["a", "b", None])) for i in range(90)]
    return rows + [(2000, None, "a"), (2001, "", "b"), (None, "text", "a"), (2002, "long " * 20_000, "b")]


@pytest.mark.parametrize("weights", [None, {"hot": 0.2, "a": 0.5, None: 0.3}])
def test_mixing(spark, weights):
    rows = mixed_rows()
    rows += rows[:2]
    mass = defaultdict(int)
    for _, t, s in rows:
        mass[s] += len(t or "")
    shares = {s: math.sqrt(m) for s, m in mass.items()} if weights is None else {s: weights.get(s, 0.0) for s in mass}
    total = sum(shares.values())
    rate = {s: shares[s] / total * sum(mass.values()) / mass[s] for s in mass}
    df = mixing.mix(docs(spark, rows), weights)
    assert df.columns == ["doc_id", "text", "lang", "source", "n", "mix_copy", "mix_key"]
    got = Counter((r["doc_id"], r["text"], r["source"]) for r in df.collect())
    want = Counter()
    for i, t, s in rows:
        if n := plain_draw(rate[s], i, t):
            want[i, t, s] += n
    assert got == want


def test_mixing_meets_the_weights(spark):
    df = spark.range(60_000).selectExpr("id as doc_id", "repeat('w', 20) as text", "if(id % 10 = 0, 'small', 'hot') as source")
    got = {r["source"]: r["count"] for r in mixing.mix(df, {"small": 1, "hot": 1}).groupBy("source").count().collect()}
    assert abs(got["small"] / 30_000 - 1) < 0.03 and abs(got["hot"] / 30_000 - 1) < 0.03


def test_mixing_is_shuffled_and_repeatable(spark):
    df = spark.range(2000).selectExpr("id as doc_id", "cast(id as string) as text", "if(id < 1000, 'x', 'y') as source")
    a = [r["doc_id"] for r in mixing.mix(df).collect()]
    assert sorted(a) == sorted(r["doc_id"] for r in mixing.mix(df.repartition(7)).collect())
    assert np.corrcoef(np.arange(len(a)), a)[0, 1] < 0.3


def test_mixing_edges(spark):
    none = docs(spark, mixed_rows()).limit(0)
    assert mixing.mix(none).count() == 0
    blank = docs(spark, [(i, "", "s") for i in range(200)])
    assert 100 < mixing.mix(blank).count() < 300
    # A rate far over one step of copies: two rows of 300,000 characters beside one character.
    few = docs(spark, [(1, "w" * 300_000, "hot"), (2, "v" * 300_000, "hot"), (3, "x", "rare"), (4, None, None)])
    got = {r["doc_id"]: r["count"] for r in mixing.mix(few).groupBy("doc_id").count().collect()}
    rate = {r["source"]: r["rate"] for r in mixing.rates(few).collect()}["rare"]
    assert rate > 700 and abs(got[3] - rate) < 6 * rate**0.5
    many = docs(spark, [(i, "w" * 1000, "hot") for i in range(90)] + [(9000, "w", "rare")])
    rows = mixing.mix(many, {"hot": 0.5, "rare": 0.5}).filter("doc_id = 9000").select("mix_copy").collect()
    assert abs(len(rows) - 45_000) < 1500 and sorted(r[0] for r in rows) == list(range(1, len(rows) + 1))


# --- packing --------------------------------------------------------------


def test_packing_is_a_partition_of_all_tokens(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.choice([0, 1, 5, 300, 511, 512, 700, 4095, 4096, 9000]), "s") for i in range(300)]
    rows += [(7, "again " * 20, "s"), (None, None, None), rows[0]]
    got = packing.best_fit_packing(docs(spark, rows), shard=200).collect()
    lengths = Counter()
    for r in got:
        lengths[r["doc_id"]] += r["length"]
        assert r["bin_capacity"] in packing.SIZES and r["start"] == r["piece"] * packing.SIZES[-1]
        assert r["bin_offset"] + r["length"] <= r["bin_used"] <= r["bin_capacity"]
    want = Counter()
    for i, t, _ in rows:
        want[i] += len(WORD.findall(t or "")) + 1
    assert lengths == want
    # In order the pieces of a document are its text.
    texts = defaultdict(list)
    for r in sorted(got, key=lambda r: r["piece"]):
        texts[r["doc_id"]].append(r["text"])
    repeated = {7, None, rows[0][0]}
    assert all("".join(texts[i]) == (t or "") for i, t, _ in rows if i not in repeated)
    assert all(len(WORD.findall(r["text"])) in (r["length"], r["length"] - 1) for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append(r)
    for pieces in bins.values():
        pieces.sort(key=lambda r: r["bin_offset"])
        assert [p["bin_offset"] for p in pieces] == [sum(p["length"] for p in pieces[:k]) for k in range(len(pieces))]
        used = sum(p["length"] for p in pieces)
        assert {p["bin_used"] for p in pieces} == {used}
        assert {p["bin_capacity"] for p in pieces} == {min(s for s in packing.SIZES if s >= used)}
    assert sum(lengths.values()) / sum(p[0]["bin_capacity"] for p in bins.values()) > 0.9


def slow_best_fit(lengths, choose):
    bins = []  # used, room, when last filled
    for turn, n in enumerate(lengths):
        fits = [b for b in bins if b[1] >= n]
        if fits:
            b = min(fits, key=lambda b: (b[1], -b[2]))
        else:
            b = [0, choose(n, lengths[turn + 1 :]), 0]
            bins.append(b)
        b[:] = b[0] + n, b[1] - n, turn
    return sorted(b[0] for b in bins)


def slow_least_cost(n, rest, sizes=(16, 32, 64), overhead=16):
    costs = []
    for s in sizes:
        if s >= n:
            room, used = s - n, n
            for m in rest:  # falling
                if m <= room:
                    room, used = room - m, used + m
            costs.append(((s + overhead) / used, -s))
    return -min(costs)[1]


def test_best_fit_against_a_slow_one():
    rng, sizes = random.Random(4), (16, 32, 64)
    for _ in range(50):
        lengths = sorted((rng.randint(1, 64) for _ in range(60)), reverse=True)
        chosen = [(packing.least_cost(sizes, 16), slow_least_cost)]
        chosen += [(packing.fixed(sizes, o), lambda n, rest, o=o: o if n <= o else min(s for s in sizes if s >= n)) for o in sizes]
        costs = []
        for fast, slow in chosen:
            want = slow_best_fit(lengths, slow)
            assert sorted(packing.best_fit(np.array(lengths), sizes, fast)[2].tolist()) == want
            costs.append(sum(min(s for s in sizes if s >= u) + 16 for u in want))
        assert int((packing.pack(np.array(lengths), sizes, 16)[3] + 16).sum()) == min(costs)


def test_cuts_are_whole_words():
    for text in ("", " ", "a", " a b  c\nd ", "a b c d ", "x\x85y z\u2003w v u"):
        for most in (1, 2, 3, 9):
            got = packing.cut(text, most)
            assert "".join(t for *_, t in got) == text and sum(n for _, n, _ in got) == len(WORD.findall(text)) + 1
            assert [s for s, *_ in got] == [k * most for k in range(len(got))] and all(1 <= n <= most for _, n, _ in got)
            assert [len(WORD.findall(t)) for *_, t in got] == [n for _, n, _ in got[:-1]] + [got[-1][1] - 1]


def test_packing_edges(spark):
    assert packing.best_fit_packing(docs(spark, [(1, "x", "s")]).limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.best_fit_packing(docs(spark, [(1, "x", "s")]), sizes=())


# --- urls -----------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "https://com/", "http://Example.COM/en/", "http://example.com/en", "http://a.example.com/en/x?y#z",
    "http://www.example.com/en/x", "http://x.www.example.com/en/", "http://notexample.com/en/", "http://a.net/es/1", "http://net/fr/", "http://a.net/de/",
    "http://a.b.c.net/fr/?q=http://x.com/", "ftp://user@h.org/p#://y.com/", "http://com?x", "http://a..com/", "http://.net/es/", "http://é.COM/É?x", "x://y://z.com/",
]


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), raw), re.match(r"[^?#]*", rest[len(raw) :])[0]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


@pytest.mark.parametrize("most", [url_filter.MAX_BYTES, 0])
def test_urls(spark, monkeypatch, most):
    """By cascades, and by the join that stands in for too large ones."""
    monkeypatch.setattr(url_filter, "MAX_BYTES", most)
    rng = random.Random(3)
    hosts = ["com", "net", "example.com", "www.example.com", "a.net", "b.a.net", "org"]
    urls = URLS + [f"http://{rng.choice(['', 'x.', 'y.z.'])}{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'de'])}/{i}" for i in range(200)]
    pages = spark.createDataFrame([(i, u, "<p>", "clash") for i, u in enumerate(urls)] + [(0, None, None, None)], "page_id long, url string, html string, host string")
    got = url_filter.judge(pages, queries.URL_RULES).collect()
    want = [(i, *plain_verdict(u, queries.URL_RULES)) for i, u in enumerate(urls)] + [(0, "", "", None, "allow")]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)


def test_cascade_is_exact_on_its_universe(spark, monkeypatch):
    """Weak filters make many false positives; deeper levels mend them all."""
    monkeypatch.setattr(url_filter, "FIRST", (2, 1))
    monkeypatch.setattr(url_filter, "DEEPER", (2, 1))
    universe = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    listed = universe.filter("cast(substring(key, 2) as int) % 7 = 0")
    cascade = url_filter.Cascade(listed, universe)
    assert len(cascade.levels) > 2
    got = {r["key"] for r in universe.filter(cascade.contains(F.col("key"))).collect()}
    assert got == {r["key"] for r in listed.collect()}


def test_url_edges(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, queries.URL_RULES).count() == 0
    assert [r["verdict"] for r in url_filter.judge(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), []).collect()] == ["allow"]
    for bad in ([("maybe", "com", "/")], [("allow", "com", "/"), ("block", "com", "/")]):
        with pytest.raises(ValueError):
            url_filter.judge(none, bad)
