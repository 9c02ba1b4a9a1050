"""Exact and near dedup, sharding and URL rules against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from strandline.llm import cuckoo, sharding, simhash, urlcascade
from strandline.llm.queries import URL_RULES

ROWS = [(5, "a  b"), (2, "a b"), (2, "a b"), (9, None), (4, ""), (7, " "), (None, "a\tb"), (8, "x y z"), (None, None)]
SCHEMA = "doc_id long, text string"


def docs(spark, rows=ROWS, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({"row": F.lit("r"), "id": F.lit(1), "digest": F.lit("d"), "print": F.lit(0), "mix_topic": F.lit("t"), "source": F.lit("s"), "lang": F.lit(None).cast("string")}) if extra else df


def test_exact_groups_with_nulls_repeats_and_clashing_names(spark):
    found = cuckoo.exact_duplicates(docs(spark)).collect()
    assert len(found) == len(ROWS)
    groups = {}
    for i, t in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    for r in found:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        assert r["group_size"] == len(groups[text]) and r["keep_id"] == min(i for i in groups[text] if i is not None)
    assert sorted(r["doc_id"] for r in found if r["kept"]) == [2, 4, 7, 8]
    kept = cuckoo.drop_exact_duplicates(docs(spark))
    assert kept.columns == docs(spark).columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 7, 8]
    assert cuckoo.exact_duplicates(docs(spark).limit(0)).count() == 0


def test_cuckoo_index_inserts_deletes_and_resizes():
    index, live, rng = cuckoo.CuckooIndex(2), {}, random.Random(4)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for _ in range(9000):
        k = rng.choice(keys)
        if k in live and rng.random() < 0.5:
            assert index.delete(k)
            del live[k]
        elif k not in live:
            assert index.get(k) is None
            index.insert(k, len(live))
            live[k] = len(live)
    assert dict(index.items()) == live and len(index) == len(live) and index.resizes > 0
    assert all(index.maybe(k) for k in live) and not any(index.delete(k) for k in keys if k not in live)


def test_live_digests_after_changes(spark):
    d = lambda *names: spark.createDataFrame([(bytearray(hashlib.sha256(n.encode()).digest()),) for n in names], "digest binary")
    changes = d("a", "n").withColumn("inserted", F.lit(True)).unionByName(d("b", "gone").withColumn("inserted", F.lit(False)))
    found = {bytes(r["digest"]) for r in cuckoo.apply_changes(d("a", "b", "c"), changes).collect()}
    assert found == {hashlib.sha256(n.encode()).digest() for n in ("a", "c", "n")}


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_brute_force():
    for t in ["", " \n", "One", "One two", "A b c", "Ä É b c d e", "x " * 500, "the cat sat on the mat " * 9 + "Ünï"]:
        assert simhash.fingerprint(t.encode()) == brute_print(t)


def test_links_find_every_near_pair(spark):
    rng = random.Random(8)
    prints = {rng.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1}
    for p in list(prints)[:25]:
        for _ in range(3):
            q = p
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                q ^= 1 << b
            prints.add(q)
    signed = lambda p: p - 2**64 if p >= 2**63 else p
    wanted = {tuple(sorted((signed(p), signed(q)))) for p in prints for q in prints if p < q and (p ^ q).bit_count() <= 2}
    found = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "print long"))
    assert {(r["a"], r["b"]) for r in found.collect()} == wanted and len(wanted) > 20


def test_components_of_chains_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 9)] + [(201, 202), (202, 203), (203, 201), (-5, -5)]
    found = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(31)) and all(found[100 + i] == 100 for i in range(9)) and {found[i] for i in (201, 202, 203)} == {201}


def test_near_groups_with_nulls_and_repeats(spark):
    base = " ".join(f"w{i}" for i in range(400))
    rows = [(3, base), (1, base + " tail"), (1, base + " tail"), (6, None), (4, ""), (None, " "), (9, "something else entirely different here")]
    found = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    near = (brute_print(base) ^ brute_print(base + " tail")).bit_count() <= 2
    assert {(6, 4), (4, 4), (None, 4), (9, 9), (1, 1), (3, 1 if near else 3)} == found
    kept = simhash.drop_near_duplicates(docs(spark, rows))
    assert kept.columns == docs(spark).columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({1, 4, 9} | ({3} if not near else set()))
    assert simhash.near_duplicates(docs(spark).limit(0)).count() == 0


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_scalar_form():
    import numpy as np

    keys = [random.Random(1).getrandbits(64) for _ in range(300)] + [0, 2**64 - 1]
    for n in (1, 2, 24, 1000):
        assert sharding.jump_hash(np.array(keys, np.uint64), n).tolist() == [jump(k, n) for k in keys]


def test_shards_hold_their_law(spark):
    import zlib

    rows = [(i, "é" * (i % 7)) for i in range(2000)] + [(5, "é" * 5), (None, None)]
    found = sharding.assign_shards(docs(spark, rows), 24).collect()
    assert len(found) == len(rows)
    for s in range(24):
        assert sorted(r["slot"] for r in found if r["shard"] == s) == list(range(sum(r["shard"] == s for r in found)))
    assert all(r["grown_shard"] in (r["shard"], 24) for r in found) and any(r["grown_shard"] == 24 for r in found)
    assert len({(r["doc_id"], r["shard"]) for r in found}) == 2001
    for r in found:
        text = "" if r["doc_id"] is None else "é" * (r["doc_id"] % 7)
        assert r["size"] == len(text.encode()) + 8 and r["text_crc32"] == zlib.crc32(text.encode())


URLS = ["http://a.com/en/1", "https://Example.COM/en/7x?q#f", "http://example.com/en/8", "http://b.example.net/de/8", "http://example.net/de/7", "x", None, "http://", "http://org", "://org/es/",
        "http://notexample.com/en/7", "http://com/en", "http://a..com/en/", "http://example.com:80/en/7", "http://x.org/es/?a://b", "ftp://é.org/es/ü"]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best.verdict if best else "allow"


def test_urls_equal_brute_force(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS * 2)], "page_id long, url string").withColumn("rule", F.lit("clash"))
    found = urlcascade.judge_urls(df, URL_RULES).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found} == {i: judged(u) for i, u in enumerate(URLS * 2)}
    assert urlcascade.judge_urls(df.limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in urlcascade.judge_urls(df, []).collect()} == {"allow"}


@pytest.mark.parametrize("n_listed", [1, 40, 400])
def test_cascade_is_exact_over_its_universe(spark, n_listed):
    keys = [f"k{i}" for i in range(2000)]
    universe = spark.createDataFrame([(k,) for k in keys] * 2 + [(None,)], "key string")
    cascade = urlcascade.build_cascade(universe, keys[:n_listed], 600)  # a rate too high on purpose, so that levels follow
    found = {r["key"] for r in universe.where("key is not null").where(urlcascade.member(F.col("key"), cascade)).collect()}
    assert found == set(keys[:n_listed])
    assert len(cascade.levels) > 1 or n_listed == 1


def test_spark_never_chooses_a_broadcast_by_the_size_it_takes_a_table_to_have(spark, monkeypatch):
    """Behind an explode, or in Parquet files of few values, a table is far larger than Spark's estimate."""
    texts = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("w "), F.col("id") % 250).alias("text"))
    key, kept = "spark.sql.autoBroadcastJoinThreshold", simhash.materialize
    before = spark.conf.get(key)
    joins = []
    try:
        for size in ("-1", "10m"):
            spark.conf.set(key, size)
            steps = []
            monkeypatch.setattr(simhash, "BROADCAST_EDGES", 0, raising=False)
            monkeypatch.setattr(simhash, "materialize", lambda df, *a: (steps.append(df), kept(df, *a))[1])
            assert simhash.near_duplicates(texts).select("fingerprint").distinct().count() == 250
            joins.append([df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") for df in steps])
    finally:
        spark.conf.set(key, before)
    assert joins[0] == joins[1] and len(joins[0]) > 4


def test_stars_of_many_edges_are_joined_as_those_of_few(spark, monkeypatch):
    edges = spark.range(1, 400).select(F.col("id").alias("a"), (F.col("id") - F.when(F.col("id") % 50 == 0, 0).otherwise(1)).alias("b"))
    few = {tuple(r) for r in simhash.components(edges).collect()}
    monkeypatch.setattr(simhash, "BROADCAST_EDGES", 0, raising=False)
    assert {tuple(r) for r in simhash.components(edges).collect()} == few
    assert {root for _, root in few} == {0, *range(50, 400, 50)}
