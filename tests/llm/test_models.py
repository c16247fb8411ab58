from __future__ import annotations


import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import LOWER, WORDS
from treeline.llm import pii, quality, suffix_tree

D = "/root/testdata/sf0.01"


# --- quality -------------------------------------------------------------------------------------------------------------


def test_lines_of_texts():
    rng = random.Random(1)
    for _ in range(300):
        given = ["".join(rng.choice("ab \n!") for _ in range(rng.choice([0, 0, 1, 2, 6]))) for _ in range(rng.randint(1, 6))]
        want = [len(t[:-1].split("\n")) if len(t) > 1 and t.endswith("\n") else 1 if t in ("", "\n") else len(t.split("\n")) for t in given]
        assert np.diff(quality.Lines(pa.array(given, pa.string())).bounds).tolist() == want


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    field = quality.Field.empty()
    field.start, field.step = rng.normal(size=2), rng.normal(size=(2, 2))
    odds, bounds = rng.normal(size=7), np.array([0, 1, 4, 7])
    got, moves, z = field.marginals(odds, bounds, pairs=True)
    total, want_moves = 0.0, np.zeros((2, 2))
    for a, b in zip(bounds, bounds[1:]):
        mass, good, steps = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for code in range(2 ** (b - a)):
            y = [code >> i & 1 for i in range(b - a)]
            w = math.exp(field.start[y[0]] + sum(odds[a + i] * y[i] for i in range(b - a)) + sum(field.step[y[i], y[i + 1]] for i in range(b - a - 1)))
            mass += w
            good += w * np.array(y)
            for i in range(b - a - 1):
                steps[y[i], y[i + 1]] += w
        assert got[a:b] == pytest.approx(good / mass)
        want_moves += steps / mass
        total += math.log(mass)
    assert moves == pytest.approx(want_moves) and z == pytest.approx(total)


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    rows = quality.classify(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def plain_bins(text):
    """The bins of a text's lines, one character after another."""
    lines = re.findall(r"[^\n]*\n|[^\n]+$", text or "") or [""]
    words = [WORDS.findall(x) for x in lines]
    letters, digits, stops = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:'\"()-"
    mark = lambda c: "!" <= c <= "~" and c not in letters + digits + stops
    out = []
    for x, w in zip(lines, words):
        n, k = max(len(x), 1), max(len(w), 1)
        wide = len(x.encode()) - sum(c < "\x80" for c in x)
        values = {
            "length": len(x), "upper": sum(c in letters[26:] for c in x) / max(1, sum(c in letters for c in x)), "digit": sum(c in digits for c in x) / n, "mark": sum(map(mark, x)) / n,
            "stop": sum(c in stops for c in x) / n, "foreign": wide / max(len(x.encode()), 1), "word": len(x) / k, "fresh": len(set(w)) / k, "tail": sum(mark(v[-1]) for v in w) / k, "copies": words.count(w),
        }
        out.append([sum(c <= values[f] for c in cuts) for f, cuts in quality._CUTS.items()])
    return out, [max(len(x), 1e-9) for x in lines]


def plain_quality(text, field):
    """The length-weighted marginals by all sequences of labels."""
    bins, lengths = plain_bins(text)
    n, k = len(bins), range(quality.FEATURES)
    odds = [sum(field.own[f, bins[i][f]] for f in k) + sum(field.before[f, bins[i - 1][f]] for f in k if i) + sum(field.after[f, bins[i + 1][f]] for f in k if i + 1 < n) for i in range(n)]
    mass, good = 0.0, [0.0] * n
    for code in range(2**n):
        y = [code >> i & 1 for i in range(n)]
        w = math.exp(field.start[y[0]] + sum(o * v for o, v in zip(odds, y)) + sum(field.step[a, b] for a, b in zip(y, y[1:])))
        mass += w
        good = [g + w * v for g, v in zip(good, y)]
    return sum(g / mass * c for g, c in zip(good, lengths)) / sum(lengths)


def test_the_registered_scores_of_quality_against_enumeration(spark, docs):
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    field = quality.fit(small, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    got = {r.doc_id: r for r in quality.op6_quality(spark, "/root/testdata/sf0.001").collect()}
    tried = 0
    for r in small.collect():
        own = got[r.doc_id]
        assert own.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and own.predicted == (own.score >= 0.7)
        if (r.text or "").count("\n") < 8:
            assert own.score == pytest.approx(plain_quality(r.text, field), abs=1e-6)
            tried += 1
    assert tried > 50
    odd = docs.filter("doc_id is not null and coalesce(regexp_count(text, '\\n'), 0) < 8").dropDuplicates(["doc_id"])
    assert {r.doc_id: r.score for r in quality.score(odd, field).collect()} == pytest.approx({r.doc_id: plain_quality(r.text, field) for r in odd.collect()}, abs=1e-6)


def test_a_repeated_label_trains_once(spark):
    rows = [(0, "Good words here.\n"), (1, "### !!! 123\n"), *[(1, "### !!! 123\n")] * 500]
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, 0)], "doc_id long, quality int")
    many, once = (quality.fit(spark.createDataFrame(r, "doc_id long, text string"), labels) for r in (rows, rows[:2]))
    assert np.array_equal(many.own, once.own)


def test_quality_of_odd_rows(spark, docs, nothing):
    labels = spark.createDataFrame([(0, 1), (3, 0), (6, None), (None, 1), (9, 1), (9, 1)], "doc_id long, quality int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(nothing, labels).count() == 0
    assert quality.keep_good(docs.withColumnRenamed("lang", "score"), labels).columns == [c if c != "lang" else "score" for c in docs.columns]


# --- language model ------------------------------------------------------------------------------------------------------


def brute_scores(texts, held, depth, least):
    """Counts of all runs of words, and contexts kept by the divergence test from the shortest on; scores of all texts."""
    counts = [Counter() for _ in range(depth + 1)]
    for t, h in zip(texts, held):
        if not h:
            for d in range(depth + 1):
                counts[d].update(zip(*(t[i:] for i in range(d + 1))))
    n, v, lam = sum(counts[0].values()), len(counts[0]), suffix_tree.WEIGHTS
    states, candidates = {}, {()}

    def p(context, w):
        """By the longest of the states that the context ends with."""
        out = (counts[0][w,] + 1) / (n + v + 1)
        for d in range(1, len(context) + 1):
            c = context[-d:]
            if c in states:
                out = (counts[d][*c, w] + states[c] * out) / (counts[d - 1][c] + states[c])
        return out

    for d in range(1, depth + 1):
        candidates = {c for c, m in counts[d - 1].items() if m >= least and c[-1] is not None and c[:-1] in candidates}
        gains = {}
        for k, m in counts[d].items():
            if k[:-1] in candidates:
                c, q = k[:-1], p(k[1:-1], k[-1])
                g = gains.setdefault(c, [0.0] * len(lam))
                for i, w in enumerate(lam):
                    g[i] += m * (math.log((m - 1 + w * q) / (counts[d - 1][c] - 1 + w)) - math.log(q))
        states |= {c: lam[g.index(max(g))] for c, g in gains.items() if max(g) > suffix_tree.GAIN and max(g) > suffix_tree.GAIN_EACH * counts[d - 1][c]}
    out = []
    for t in texts:
        score = sum(math.log10(p(tuple(t[max(0, j - depth) : j]), w)) for j, w in enumerate(t))
        out.append((len(t), sum((w,) in counts[0] for w in t), n, sum(math.log10((counts[0][w,] + 1) / (n + v + 1)) for w in t), score))
    return out, Counter(map(len, states))


@pytest.mark.parametrize("depth,least,chunk", [(2, 4, 300), (3, 2, 300), (4, 2, 1 << 19)])
def test_scores_against_brute_force(docs, depth, least, chunk):
    given = docs.union(docs).union(docs)
    rows = given.collect()
    texts = [[*WORDS.findall((r.text or "").translate(LOWER)), None] for r in rows]
    held = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows]
    want, kept = brute_scores(texts, held, depth, least)
    assert kept[1] > 3 and kept[2] > 3
    fields = lambda i, h, x: (i is None, i or 0, h, *x[:3], round(x[3], 4), round(x[4], 4))
    got = sorted(fields(r.doc_id, r.held_out, (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in suffix_tree.score(given, depth, least, chunk).collect())
    assert got == sorted(fields(r.doc_id, h, w) for r, h, w in zip(rows, held, want))


def test_the_registered_scores_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    texts = [[*WORDS.findall((r.text or "").translate(LOWER)), None] for r in rows]
    held = [zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows]
    want, _ = brute_scores(texts, held, suffix_tree.DEPTH, suffix_tree.SEEN)
    got = {r.doc_id: r for r in suffix_tree.op9_suffix_tree(spark, "/root/testdata/sf0.001").collect()}
    for r, h, w in zip(rows, held, want):
        g = got[r.doc_id]
        assert (g.held_out, g.n_tokens, g.n_known, g.train_tokens) == (h, *w[:3])
        assert g.base_score == pytest.approx(w[3], rel=1e-9) and g.score == pytest.approx(w[4], rel=1e-6)


def test_no_documents_to_learn_from(spark, nothing):
    assert suffix_tree.score(nothing).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = suffix_tree.score(spark.createDataFrame([(only, "a b")], "doc_id long, text string")).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


def test_a_context_is_a_state_in_a_large_corpus_too(spark):
    filler = spark.range(20).selectExpr("id AS doc_id", f"repeat('z ', {1 << 20}) AS text")
    phrase = spark.range(1000, 1012).selectExpr("id AS doc_id", "'alpha beta' AS text")
    rows = suffix_tree.score(filler.union(phrase)).filter("doc_id >= 1000").collect()
    assert sum(not r.held_out for r in rows) < 1e-6 * rows[0].train_tokens
    assert all(r.score > r.base_score + 1 for r in rows)


# --- personal data -------------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+){3}", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
BITS = ["a", "b@", "@", ".", "c", "12", "4", "4111 1111-1111 1111", "4111111111111111", "+1 (555) 555-1234", "1.2.3.4", "300.1.1.1", "-", " ", "é", "日", "_", "%", "\n", "+", "(", ")", "x@y.zz", "255", "0000255.1.1.1", "37 8282246310005"]


def good(kind, value):
    d = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 14 <= len(d) <= 19 and sum((2 * x - 9 * (x > 4)) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def base_spans(text):
    found = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if good(k, m.group())]
    return [s for _, _, s in sorted(found)]


def test_base_spans_against_the_plain_patterns(spark):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(BITS) for _ in range(rng.randrange(30)))) for i in range(600)]
    rows += [(5000, None), (None, "a@b.c"), (7, "1" * 30_000 + " " + "a" * 30_000 + " " + "1-" * 20_000 + "a@" + "b." * 20_000), (7, "a@b.c")]
    out = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, tuple(r.base)) for r in out) == Counter((i, tuple(base_spans(t))) for i, t in rows)
    for r in out:
        spans = [s.split(":") for s in r.spans.split(",") if s]
        assert set(r.base) <= {":".join(s) for s in spans} and sum((r.n_email, r.n_ip, r.n_card, r.n_phone)) == len(r.base)
        assert [(int(a), pii.KINDS.index(k)) for k, a, _ in spans] == sorted((int(a), pii.KINDS.index(k)) for k, a, _ in spans)


def test_the_registered_base_spans_against_the_plain_patterns(spark):
    import hashlib

    rows = spark.read.parquet(f"{D}/documents.parquet").collect()
    got = {r.doc_id: r for r in pii.op10_pii(spark, D).collect()}
    for r in rows:
        want = base_spans(r.text)
        own = got[r.doc_id]
        assert own.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (own.n_email, own.n_ip, own.n_card, own.n_phone) == tuple(sum(s.startswith(k) for s in want) for k in pii.KINDS)


#: What only the looser forms find, around it words that say what it is, and its kind.
PLANTED = [
    ("write to ", "{a}.{b} (at) mail{n} (dot) org", "email"), ("my mail is ", "{a} at {b} dot com", "email"), ("call ", "(2{n2}) 555-01{n2}", "phone"), ("phone ", "0049 30 1234{n2}{n2}", "phone"),
    ("server ", "10[.]0[.]{n}[.]{n2}", "ip"), ("host ", "2001:db8:0:{n}:0:0:0:{n2}", "ip"), ('api token = "', "9f{n2}c3d4e5f6a7b8{n2}d0e1f2", "secret"),
]
#: What looks like it and isn't.
PLAIN = ["order 1234567890123{n3} shipped", "version 1.2.{n}", "isbn 978-3-16-148410-{n}", "he was at home at noon", "in 2019 and 20{n2}", "abcdefghijklmnopqrstuvwxyz{a}", "ratio 3:4:{n}"]


def test_added_spans_and_redaction(spark):
    rng = random.Random(8)
    fill = lambda t, i: t.format(a=rng.choice(["ann", "bo", "cy"]), b=rng.choice(["lee", "ray"]), n=i % 9 + 1, n2=f"{i % 90 + 10}", n3=f"{i % 900 + 100}")
    rows, want = [], {}
    for i in range(40):
        rows.append((i, f"call +1 (20{i % 10}) 555-01{i:02d} or write to me{i}@mail.example.com from server 10.0.0.{i} with card 4111 1111 1111 1111"))
    for i in range(40, 320):
        before, value, kind = PLANTED[i % len(PLANTED)]
        value = fill(value, i)
        text = f"some words and {before}{value}" + ('"' if kind == "secret" else "") + " then more"
        rows.append((i, text))
        want[i] = f"{kind}:{text.index(value)}:{text.index(value) + len(value)}"
    rows += [(i, f"some words {fill(PLAIN[i % len(PLAIN)], i)} then more") for i in range(320, 600)]
    rows += [(1000, "Des +1 (826) 555-4081 190.137.223.204 du"), (1001, None), (1002, "\ue000 a@b.com \ue000 x"), (1002, "\ue000 a@b.com \ue000 x"), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'clash' as uid", "1 as candidates", "2 as spans")
    got = [(r.doc_id, r.spans, r.base) for r in pii.find(df).collect()]
    added = {i: [x for x in s.split(",") if x and x not in b] for i, s, b in got if i is not None}
    hits = sum(want[i] in added[i] for i in want)
    total = sum(map(len, added.values()))
    assert hits >= 0.9 * len(want) and hits >= 0.9 * total, (hits, len(want), total)
    found = {i: s for i, s, _ in got}
    assert found[1000] == "phone:4:21,ip:22:37" and found[1001] == "" and found[1002] == "email:2:9"
    clean = pii.redact(df)
    assert clean.columns == df.columns and clean.dtypes == df.dtypes
    texts = dict(rows)

    def cut(i):
        out, at = "", 0
        for kind, a, b in (x.split(":") for x in found[i].split(",") if x):
            if int(a) >= at:
                out += texts[i][at : int(a)] + f"<{kind}>"
            at = max(at, int(b))
        return out + texts[i][at:]

    assert {r.doc_id: r.text for r in clean.collect()} == {i: None if t is None else cut(i) for i, t in texts.items()}


def test_reliabilities_find_the_better_labeler():
    rng = random.Random(9)
    counts = Counter()
    for _ in range(4000):
        y = rng.random() < 0.4
        right = [rng.random() < r for r in (0.95, 0.9, 0.6, 0.85, 0.7)]
        counts[tuple(2 if ok == y else 0 for ok in right)] += 1
    patterns = [("card", v, n) for v, n in sorted(counts.items())]
    post, shares = pii.reliabilities(patterns)
    good = [(shares["card"][1, i, 2] + shares["card"][0, i, 0]) / 2 for i in range(5)]
    assert good == pytest.approx([0.95, 0.9, 0.6, 0.85, 0.7], abs=0.05)
    # the last round's posterior, by Bayes' rule from the distributions it used
    mass = sum(p * n for p, (_, _, n) in zip(post, patterns))
    total = sum(n for _, _, n in patterns)
    for p, (_, v, _) in zip(post, patterns):
        odds = (mass + 1) / (total - mass + 1) * math.prod(shares["card"][1, i, x] / shares["card"][0, i, x] for i, x in enumerate(v))
        assert p == pytest.approx(odds / (1 + odds), abs=1e-3)


def test_chains_of_added_spans_keep_the_last_that_stays(spark):
    row = lambda name, a, b: f"named_struct('name', '{name}', 'start', {a}, 'end', {b}, 'value', 'v', 'before', '', 'after', '')"
    weights = {(k,): 5.0 for k in pii.ALL}
    df = spark.sql(f"SELECT array({row('loose_phone', 0, 10)}, {row('secret', 8, 20)}, {row('ipv6', 15, 30)}, {row('email', 28, 33)}, {row('secret', 40, 50)}) AS candidates")
    got = pii.spans(df, weights).first().spans
    assert [(x.start, x.end, x.more) for x in got] == [(0, 10, True), (28, 33, False), (40, 50, True)]


def test_personal_data_of_odd_rows(docs, nothing):
    assert pii.find(docs).count() == docs.count() and pii.find(nothing).count() == 0 and pii.redact(nothing).count() == 0


def test_only_dataframe_functions_in_the_plan(spark):
    df = spark.read.parquet(f"{D}/documents.parquet")
    for out in (pii.find(df), pii.redact(df)):
        assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
