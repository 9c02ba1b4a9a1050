"""Near copies by shingle similarity against brute force over all pairs."""

import random

import corpus_pipeline
from strandline.llm import minhash


def brute_links(texts, words=5, least=0.8):
    """All pairs of texts by the Jaccard similarity of their word tuples."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            union = len(sets[a]) + len(sets[b]) - both
            if both >= least * union:
                yield a, b


def kept(texts, links):
    """The smallest id of each component."""
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {find(i) for i in texts}


def made(seed=3):
    """Bases with copies of which a few words are changed, some chains of them, one large group, and odd texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(4))
    texts, n = {0: "", 1: " \n", 2: None, 3: "One two", 4: "one  TWO", 5: "one two three"}, 10
    for base in range(30):
        text = [word() for _ in range(rng.randrange(60, 300))]
        for _ in range(40 if base == 0 else 5):
            texts[n] = " ".join(text)
            n += 1
            if base % 3 == 1:
                text = list(text)  # a chain: each is a copy of the one before
            copy = list(text)
            for _ in range(rng.randrange(1, max(2, len(text) // 50))):
                copy[rng.randrange(len(copy))] = word()
            if base % 3 == 1:
                text = copy
            else:
                texts[n] = " ".join(copy)
                n += 1
    return texts


def test_similar_texts_go_as_by_brute_force(spark):
    texts = made()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = minhash.drop_similar(df)
    links = list(brute_links(texts))
    assert out.columns == df.columns and {r["doc_id"] for r in out.collect()} == kept(texts, links)
    key = {i: set(minhash.bands(minhash.shingles((t or "").encode())).tolist()) for i, t in texts.items()}
    assert sum(bool(key[a] & key[b]) for a, b in links) >= 0.999 * len(links)
    assert minhash.drop_similar(df.limit(0)).count() == 0


def test_the_stage_drops_copies_with_a_few_words_changed(spark):
    rng = random.Random(4)
    text = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    near, far = list(text), list(text)
    near[50] = near[120] = "changed"
    far[::8] = ["changed"] * len(far[::8])
    rows = [(7, " ".join(text)), (8, " ".join(near)), (9, " ".join(far))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect()) == [7, 9]


def letters(n, seed, words=60, changed=3):
    """Form letters: one text with a few words of each one's own, some of them twice with one word more changed at the end."""
    rng = random.Random(seed)
    form = [f"w{i}" for i in range(words)]
    texts = {}
    for i in range(n):
        t = list(form)
        for at in rng.sample(range(words), changed):
            t[at] = f"own{i}-{at}"
        texts[i] = " ".join(t)
        if i % 50 == 0:
            texts[n + i] = " ".join([*t[:-1], f"end{i}"])
    return texts


def test_form_letters_take_few_comparisons_and_lose_no_copy(spark, monkeypatch):
    compared = []
    verified = minhash._verified
    monkeypatch.setattr(minhash, "_verified", lambda pairs, sets, least: compared.append(pairs.count()) or verified(pairs, sets, least))
    texts = letters(400, 5)
    out = {r["doc_id"] for r in minhash.drop_similar(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert out == kept(texts, brute_links(texts)) and len(out) < len(texts)
    compared.clear()
    texts = letters(2000, 6)
    out = minhash.drop_similar(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).count()
    assert out >= 1990 and sum(compared) < 20 * len(texts), compared


def test_rarest_shingles_meet_wherever_sets_are_similar(spark):
    rng = random.Random(8)
    sets = []
    for i in range(120):
        base = sets[rng.randrange(len(sets))][1] if sets and rng.random() < 0.6 else [rng.randrange(1, 1 << 40) for _ in range(rng.randrange(1, 60))]
        found = {x if rng.random() < 0.93 else rng.randrange(1, 1 << 40) for x in base} | {rng.randrange(5) for _ in range(rng.randrange(3))}
        sets.append((i, sorted(found)))
    df = spark.createDataFrame(sets, "print long, found array<long>")
    rare = {}
    for r in minhash._prefixed(df, 0.8).collect():
        rare.setdefault(r["print"], {})[r["shingle"]] = r["left"]
    near = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1 :] if len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y))]
    size = {i: len(x) for i, x in sets}
    assert len(near) > 20 and all(any(min(rare[a][x], rare[b][x]) >= (size[a] + size[b]) * 0.8 / 1.8 - 1e-6 for x in rare[a].keys() & rare[b].keys()) for a, b in near)
    assert all(len(rare[i]) == len(x) - -(-8 * len(x) // 10) + 1 for i, x in sets)


def test_near_copies_are_found_by_simhash_signatures_alone(spark, monkeypatch):
    candidates = minhash._candidates
    monkeypatch.setattr(minhash, "_candidates", lambda distinct: candidates(distinct).where("false"))
    rng = random.Random(9)
    texts = {}
    for i in range(0, 60, 3):
        t = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(900)]
        texts[i], texts[i + 1], texts[i + 2] = " ".join(t), " ".join([*t, "end"]), " ".join([*t[:450], *["far"] * 450])
    print_of = {i: minhash.majority([minhash.shingles(t.encode())], len(minhash.shingles(t.encode()))) for i, t in texts.items()}
    for i, t in texts.items():
        found = minhash.shingles(t.encode()).tolist()
        assert print_of[i] == sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in found) > len(found))
    near = [(a, b) for a, b in brute_links(texts) if (print_of[a] ^ print_of[b]).bit_count() <= 2]
    assert len(near) >= 10
    out = minhash.drop_similar(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["doc_id"] for r in out.collect()} == kept(texts, near)
