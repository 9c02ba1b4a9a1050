"""Spelling variants, periodic runs and language identification against brute force and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import langid, periodic, spelling
from strandline.llm.queries import queries
from strandline.session import table

SF = "/root/testdata/sf0.001"


def docs(spark, rows, schema="doc_id long, text string"):
    clash = {c: F.lit("x") for c in ("word", "n", "run", "id", "h", "form", "start", "period", "score", "held_out", "bucket", "_r")}
    return spark.createDataFrame(rows, schema).withColumns(clash)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# ---- spelling variants


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_variants(rows, dropped=31):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % dropped == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    around = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, vs in around.items():
        if vs and n[best := min(vs, key=lambda v: (-n[v], v))] >= 10 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(around[w]), n[form[w]] if w in form else None))
    return sorted(out, key=repr)


NAMES = ("word", "form", "root", "n", "n_near", "form_n")


def made_up(seed, words=400):
    rng = random.Random(seed)
    base = ["".join(rng.choice("aebÀéß") for _ in range(rng.randrange(6, 13))) for _ in range(40)] + ["aaaaaaa", "aaaaaaaa", "abababab", "abababa", "bababab"]
    rows = []
    for i in range(60):
        said = []
        for _ in range(words // 20):
            w = rng.choice(base)
            for _ in range(rng.choice((0, 0, 0, 1, 1, 2))):
                at = rng.randrange(len(w))
                w = rng.choice((w[:at] + w[at + 1 :], w[:at] + "b" + w[at:], w[:at] + "e" + w[at + 1 :]))
            said += [w.upper() if rng.random() < 0.2 else w] * rng.choice((1, 1, 2, 30))
        rows.append((i, rng.choice((" ", "-", "\n")).join(said)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_equal_brute_force(spark, seed):
    rows = made_up(seed) + [(None, "Elephants elephants elephant7"), (7, None), (7, None), (8, ""), (9, "×÷ÀÀÀÀÀÀÀ ÀÀÀÀÀÀÀ")]
    assert rows_of(spelling.spelling_variants(docs(spark, rows)), *NAMES) == brute_variants(rows)


def test_frequent_halves_are_spread_and_lose_nothing(spark):
    rng = random.Random(4)
    words = {"inter" + "".join(rng.choice("abc") for _ in range(rng.randrange(3, 8))) for _ in range(300)} | {"".join(rng.choice("abc") for _ in range(rng.randrange(3, 8))) + "tional" for _ in range(300)}
    rows = [(w, rng.randrange(2, 500)) for w in sorted(words)]
    found = spelling.near_words(spark.createDataFrame(rows, "word string, n long"), shard_words=20, frequent=1_000_000)
    n = dict(rows)
    wanted = []
    for w in n:
        vs = [v for v in n if near(w, v)]
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        wanted.append((w, n[w], len(vs), best if best and n[best] >= 10 * n[w] else None))
    assert rows_of(found, "word", "n", "n_near", "form") == sorted(wanted, key=repr)


def test_variants_of_a_table_equal_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert rows_of(queries()["op11_spelling_variants"](spark, SF), *NAMES) == brute_variants(rows)


def test_roots_follow_long_chains(spark):
    links = [(f"w{i:02}", f"w{i + 1:02}") for i in range(17)] + [("w17", None), ("x", None), ("y", "w05")]
    found = {r["word"]: r["root"] for r in spelling.with_roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert found == {w: "x" if w == "x" else "w17" for w, _ in links}


def test_words_of_very_long_and_of_no_texts(spark):
    rows = [(1, "a" * 3_000_000), (2, "B" * 3_000_000), (3, "longword " * 100_000)]
    assert [r[0] for r in rows_of(spelling.spelling_variants(docs(spark, rows)), "word")] == ["longword"] or rows_of(spelling.spelling_variants(docs(spark, rows)), *NAMES) == brute_variants(rows)
    assert spelling.spelling_variants(docs(spark, []).limit(0)).collect() == []
    assert spelling.spelling_variants(docs(spark, [(1, None), (2, "short words")])).collect() == []


# ---- periodic runs


def brute_runs(words):
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def brute_row(i, text, planted=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if planted and n and i is not None and (h := zlib.crc32(str(i).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    runs = brute_runs(words)
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    s, length, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    said = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    return i, len(runs), s, length, q, 1000 * length // q if runs else None, sha(said), sha(" ".join(w for k, w in enumerate(words) if k not in gone))


RUN_NAMES = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_arrays_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(250):
        words = []
        while len(words) < rng.randrange(1, 160):
            block = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
            words += (block * rng.randrange(1, 9))[: rng.randrange(1, 60)]
        assert periodic.periodic_runs(np.array(words, np.int32)) == brute_runs(words), words


def test_rows_equal_brute_force_with_odd_rows(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for i in range(150)]
    rows += [(None, "x " * 9), (3, None), (4, ""), (4, ""), (5, " \t\x0b\n"), (6, "a b c " * 7), (7, "| a | b | c | d | e | f | g |"), (8, "\x1c\x85 " * 6)]
    rows += [(100 + i, "a b c " * 20 + "a b " * 20) for i in range(30)]
    assert rows_of(periodic.collapse_runs(docs(spark, rows), planted=True), *RUN_NAMES) == sorted((brute_row(i, t) for i, t in rows), key=repr)
    assert rows_of(periodic.collapse_runs(docs(spark, rows)), *RUN_NAMES) == sorted((brute_row(i, t, False) for i, t in rows), key=repr)
    assert periodic.collapse_runs(docs(spark, rows).limit(0)).collect() == []


def test_runs_of_a_table_equal_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    found = rows_of(queries()["op12_periodic_runs"](spark, SF), *RUN_NAMES)
    assert found == sorted((brute_row(i, t) for i, t in rows), key=repr) and sum(r[1] for r in found) > 5


def test_very_long_runs_end_soon(spark):
    rows = [(1, "word " * 1_000_000), (2, "a b " * 300_000 + "a a " * 300_000), (3, " ".join(f"the {i}" for i in range(200_000)))]
    found = {r["doc_id"]: r for r in periodic.collapse_runs(docs(spark, rows)).collect()}
    assert (found[1]["n_runs"], found[1]["length"], found[1]["period"]) == (1, 1_000_000, 1)
    assert found[2]["n_runs"] == 2 and (found[2]["start"], found[2]["length"], found[2]["period"]) == (600_000, 600_000, 1)
    assert found[3]["n_runs"] == 0


# ---- languages


def test_gradient_rule_equals_a_dense_scalar_version():
    rng = np.random.default_rng(3)
    model = langid.Ftrl(6, 3)
    z, n = [[0.0] * 3 for _ in range(6)], [[0.0] * 3 for _ in range(6)]
    for _ in range(40):
        rows = rng.choice(6, 3, replace=False)
        values, label = rng.random(3), int(rng.integers(3))
        w = {r: [0.0 if abs(z[r][k]) <= model.l1 else -(z[r][k] - (1 if z[r][k] > 0 else -1) * model.l1) / ((model.beta + n[r][k] ** 0.5) / model.alpha + model.l2) for k in range(3)] for r in rows}
        s = [sum(v * w[r][k] for r, v in zip(rows, values)) for k in range(3)]
        e = [np.exp(x - max(s)) for x in s]
        for r, v in zip(rows, values):
            for k in range(3):
                g = v * (e[k] / sum(e) - (k == label))
                z[r][k] += g - ((n[r][k] + g * g) ** 0.5 - n[r][k] ** 0.5) / model.alpha * w[r][k]
                n[r][k] += g * g
        model.learn(rows, values, label)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_grams_and_counts_equal_a_plain_version():
    count = langid.Counter()
    for text in ("Hello, WORLD 12 é", "aaa", "ß漢字 x", "a-b"):
        plain = " " + " ".join("".join(c.lower()[0] if c.isalpha() else " " for c in text).split()) + " "
        units = [g for n in (1, 2, 3) for g in (plain[i : i + n] for i in range(len(plain) - n + 1)) if g != " " or n > 1]
        wanted = Counter(units)
        one = [c for c in plain[1:-1]]
        wanted = Counter(one + [g for g in units if len(g) > 1])
        found, n = count(langid.grams(text))
        assert sorted(n.tolist()) == sorted(wanted.values()) and len(set(found.tolist())) == len(wanted)
    assert len(langid.grams("12 ?!")) == 0 and len(langid.grams("")) == 0


def test_temperature_calibrates():
    rng = np.random.default_rng(5)
    scores = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in langid.softmax(scores)])
    assert abs(langid.temperature(scores * 5, labels) - 5) < 0.6


def test_held_out_languages_are_found(spark):
    sf = "/root/testdata/sf0.01"
    known = {r["doc_id"]: r for r in table(spark, sf, "documents").select("doc_id", "lang", "text").collect()}
    found = queries()["op13_language_id"](spark, sf).collect()
    assert len(found) == len(known) and set(found[0].asDict()) == {"doc_id", "held_out", "lang_pred", "score"}
    tested = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found) and len(tested) > 200
    right = [r["lang_pred"] == known[r["doc_id"]]["lang"] for r in tested]
    assert np.mean(right) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in found) and abs(np.mean([r["score"] for r in tested]) - np.mean(right)) < 0.05


def test_languages_never_look_at_what_they_predict(spark):
    rows = [(i, ("the cat and the dog %d" if i % 2 else "der Hund und die Katze %d") % i, "en" if i % 2 else "de") for i in range(60)]
    rows += [(None, "the dog", None), (61, None, "en"), (62, "12 34 !", "de"), (63, "", None), (63, "", None), (64, "die Katze", None)]
    df = docs(spark, rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    found = rows_of(langid.predict(df, model), "doc_id", "lang_pred", "score")
    # held-out labels are not learnt from, and predictions don't see lang
    other = df.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang")))
    again = langid.train(other)
    assert again.languages == model.languages == ["de", "en"] and np.array_equal(again.weights, model.weights)
    assert rows_of(langid.predict(other.drop("lang"), again), "doc_id", "lang_pred", "score") == found
    said = {}
    for i, lang, score in found:
        said.setdefault(i, []).append((lang, score))
    assert said[61] == said[62] == [("und", 0.0)] and said[63] == [("und", 0.0)] * 2
    assert said[None][0][0] == "en" and said[64][0][0] == "de"
    assert langid.train(df.limit(0)) is None and langid.predict(df.limit(0), None).collect() == []
    assert {r["lang_pred"] for r in langid.predict(df, None).collect()} == {"und"}
    long = docs(spark, [(1, "the cat " * 400_000)])
    assert langid.predict(long, model).collect()[0]["lang_pred"] == "en"
