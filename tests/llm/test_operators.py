import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import public_tokenizers
from quire.llm import boosting, decontamination, language, mixing, nearcopies, pii, quality, queries, repeats, simhash, substrings, suffixes, tokens, topk
from quire.llm.common import fold
from quire.llm.graph import components

MODEL = public_tokenizers.path(queries.TOKENIZER)


def words(t):
    return (t or "").encode().split()


def multiset(rows):
    return Counter(map(tuple, rows))


def test_token_counts():
    rng = random.Random(1)
    bits = ["a", "the", "ing", " ", "  ", "\n", "\t", "▁", "é", "中", "😀", "\x00", "<s>", "</s>", "1", "!!", "aaaa", "    ", "　", "ि", "====="]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += ["", "a" * 5000, " " * 100, "ab" * 3000, "the " * 2000]
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    counter = tokens.Counter(open(MODEL, "rb").read())
    assert counter.counts(texts) == [len(x) for x in model.encode(texts, num_threads=1)]
    assert counter.counts([None, *texts[:50]])[1:] == [len(x) for x in model.encode(texts[:50], num_threads=1)]
    assert all(counter.merger.one_by_one("▁" + w) == n for w, n in (("the", 1), ("", 1)))


def test_token_column(docs, corpus):
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = docs.select("doc_id", "text", tokens.token_count(F.col("text"), MODEL)).collect()
    assert multiset(got) == Counter((d, t, len(model.encode(t or ""))) for d, t in corpus)


def test_boosting_learns_and_survives():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = boosting.fit(x[:400], y[:400])
    assert ((trees.probability(x[400:]) >= 0.5) == y[400:]).mean() > 0.95
    assert boosting.fit(np.zeros((0, 3)), np.zeros(0)).probability(x[:2]).tolist() == [0.5, 0.5]
    assert boosting.fit(x, np.ones(600)).probability(x[:1])[0] > 0.9
    row = x[0]  # one row by hand against the arrays
    total = trees.base
    for f, c, leaf in zip(trees.feature, trees.cut, trees.leaf):
        at = 0
        while at < len(f):
            at = 2 * at + 1 + int(row[f[at]] > c[at])
        total += leaf[at - len(f)]
    assert abs(total - trees.margin(x[:1])[0]) < 1e-9


def test_quality_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = queries.op3_quality_scores(spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out").select("quality", "predicted", "score").collect()
    assert np.mean([r.quality == r.predicted for r in got]) > 0.97
    assert np.mean([r.predicted for r in got if r.quality == 1]) > 0.99
    assert all(0 <= r.score <= 1 for r in got) and docs.count() == 10_000


def test_quality_without_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    known = quality.labelled(docs, labels, F.lit(True), 100)
    trees = quality.train(known, "text", "label", F.col("order"), 100)
    assert {r[0] for r in docs.select(quality.score(F.col("text"), trees)).collect()} == {0.5}
    nulls = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0)], "doc_id long, quality int")
    assert quality.labelled(docs, nulls, F.lit(True), 100).count() == 2 * docs.where("doc_id = 2").count()


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_pii(text):
    out = {}
    for kind, pattern in BASE.items():
        out[kind] = []
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 13 <= len(d) <= 19 and pii.luhn(d), "phone": lambda: 9 <= len(d) <= 15}
            if good[kind]():
                out[kind].append(m.span())
    return out


def test_pii_base():
    rng = random.Random(2)
    bits = [*"ab.-@+ ()0123456789", "@a.b", "1.2.3.4", "4111 1111 1111 1111", "+1 (839) 555-1724", "é", "00"]
    for _ in range(20000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 30)))
        assert pii.base(text) == brute_pii(text), text
    assert pii.base("1" * 200_000) and pii.base("a" * 200_000 + "@b.c")["email"] == [(0, 200_004)]


def test_pii_added_and_redacted(spark):
    selector = pii.train()
    rng = random.Random(9)
    held = [(t, good) for t, good in pii.examples(1000, seed=77)]
    found = [any(selector.added(t, pii.base(t)).values()) or any(pii.base(t).values()) for t, _ in held]
    right = [f for f, (_, good) in zip(found, held) if good]
    wrong = [f for f, (_, good) in zip(found, held) if not good]
    assert np.mean(right) > 0.8 and np.mean(wrong) < 0.05, (np.mean(right), np.mean(wrong))
    texts = [None, "", "mail a.b@c.de or 10.0.0.1 now", "write to jane (at) mail.org", "clean text on 2020-11-12"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(pii.redact(F.col("t"), selector)).collect()]
    assert got == [None, "", "mail <EMAIL> or <IP> now", "write to <EMAIL>", "clean text on 2020-11-12"]
    row = spark.createDataFrame([(texts[2],)], "t string").select(pii.find(F.col("t"), selector).alias("f")).select("f.*").first()
    assert (row.n_email, row.n_ip, row.base) == (1, 1, "email:5:13,ip:17:25") and rng


def test_pii_added_in_documents(spark):
    """What the base patterns miss in the documents: the values of `token = "..."`, and nothing else; whole long texts."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    selector = pii.train(pii.pieces(docs))
    assert 20 < len(pii.pieces(docs, count=50)) <= 50 and pii.pieces(docs.limit(0)) == []
    found = right = real = 0
    texts = [r.text or "" for r in docs.collect()]
    for t in texts:
        first, every = selector.spans(t)
        assert all(set(first[kind]) <= set(every[kind]) for kind in pii.KINDS)
        added = {s for kind in pii.ALL for s in every[kind]} - {s for v in first.values() for s in v}
        secret = {m.span(1) for m in re.finditer(r'(?i)token = "([0-9a-f]{30,})"', t)}
        found, right, real = found + len(added), right + len(added & secret), real + len(secret)
    assert real > 100 and right >= 0.95 * real and right >= 0.95 * found, (found, right, real)
    long = next(t for t in texts if 'token = "' in t)
    moved = [(a + 300_000, b + 300_000) for a, b in selector.spans(long)[1]["secret"]]
    assert moved and selector.spans("word " * 60_000 + long)[1]["secret"] == moved


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    coder = language.train(language.sample(docs, fold(F.col("doc_id"), 4) != 2, 60))
    got = docs.where(fold(F.col("doc_id"), 4) == 2).select("lang", language.predict(F.col("text"), coder).alias("p")).select("lang", "p.*").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.95 and all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(None,), ("",), ("123 !",), ("ß",)], "text string")
    assert [r[0] for r in odd.select(language.predict(F.col("text"), coder)["lang_pred"]).collect()][:3] == ["und"] * 3
    none = language.train(language.sample(docs.limit(0), F.lit(True)))
    assert odd.select(language.predict(F.col("text"), none)["lang_pred"]).distinct().collect()[0][0] == "und"


def test_language_trees_and_pieces(spark, docs, monkeypatch):
    """Counts of the executors are those of the texts at once, and code lengths don't depend on where pieces are cut."""
    rows = docs.where("lang is not null and text is not null").collect()
    trees = language.sample(docs, F.lit(True), 10_000)
    assert trees == {lang: language.tree_of([r.text for r in rows if r.lang == lang and r.doc_id is not None]) for lang in {r.lang for r in rows}}
    coder = language.train(trees)
    flat = np.frombuffer(b"".join(r.text.encode() for r in rows), np.uint8)
    starts = np.cumsum([0, *(len(r.text.encode()) for r in rows)])
    whole = coder.bits(flat, starts)
    monkeypatch.setattr(language, "PIECE", 97)
    assert np.allclose(coder.bits(flat, starts), whole)


def test_language_code_lengths():
    """Against prediction by partial matching written out byte by byte."""
    samples = {"x": ["abracadabra", "abrakadabra"], "y": ["banana band", "bandana"]}
    coder = language.train({lang: language.tree_of(v) for lang, v in samples.items()})
    texts = ["abracad", "banabra", "", "zzz", "a"]
    flat = np.frombuffer("".join(texts).encode(), np.uint8)
    starts = np.cumsum([0, *map(len, texts)])
    got = coder.bits(flat, starts)
    for j, lang in enumerate(coder.languages):
        counts = [defaultdict(Counter) for _ in range(language.ORDER + 1)]
        for t in samples[lang]:
            for i in range(len(t)):
                for k in range(min(i, language.ORDER) + 1):
                    counts[k][t[i - k : i]][t[i]] += 1
        kept = {c for t in samples.values() for s in t for i in range(len(s)) for c in [s[i - language.ORDER : i]] if i >= language.ORDER}
        seen = {c: max(sum(1 for s in v for i in range(language.ORDER, len(s)) if s[i - language.ORDER : i] == c) for v in samples.values()) for c in kept}
        known = {c for s in samples.values() for t in s for c in t}

        def p(context, symbol):
            lower = p(context[1:], symbol) if context else 1 / 256
            own = counts[len(context)].get(context)
            return lower if not own else (own[symbol] + len(own) * lower) / (own.total() + len(own))

        for i, t in enumerate(texts):
            bits = 0.0
            for at, symbol in enumerate(t):
                context = t[max(0, at - language.ORDER) : at]
                while context and (any(c not in known for c in context) or (len(context) == language.ORDER and seen.get(context, 0) < language.SEEN) or not any(context in "".join(["\0", *s]) and any(context == s[n - len(context) : n] for s in v for n in range(len(context), len(s))) for v in samples.values() for s in [v])):
                    context = context[1:]
                bits -= np.log2(p(context, symbol))
            assert abs(bits - got[i, j]) < 1e-3, (lang, t)


def brute_fingerprint(t, k=3):
    w = (t or "").encode().lower().split()
    grams = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_kernels():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 100, dtype=np.uint64)
    flips = [base.copy() for _ in range(5)]
    for f in flips:
        for _ in range(3):
            f ^= np.uint64(1) << rng.integers(0, 64, 100).astype(np.uint64)
    x = rng.permutation(np.unique(np.concatenate([base, *flips])))
    distance = np.bitwise_count(x[:, None] ^ x[None])
    group = np.sort(rng.integers(0, 30, len(x)))
    for radius in (0, 1, 2, 3, 6):
        want = set(zip(*map(lambda v: v.tolist(), np.nonzero(distance <= radius))))
        assert {p for a, b in simhash.near_each(x, x, radius) for p in zip(a.tolist(), b.tolist())} == want
        a, b = simhash.near_ahead(x, group, radius)
        assert set(zip(a.tolist(), b.tolist())) == {(i, j) for i, j in want if i < j and group[i] == group[j]}
        rows = [(r, b) for a, b in nearcopies._leaders(x, radius, 64) for r, b in zip(a.tolist(), b.tolist())]
        leaders = {*range(len(x))} - {r for r, _ in rows}
        assert all(distance[r, b] <= radius and b in leaders and b < r for r, b in rows)
        assert all(distance[a, b] > radius for a in leaders for b in leaders if a != b)


@pytest.mark.parametrize("heavy", [4096, 4])
def test_simhash_components(spark, docs, corpus, monkeypatch, heavy):
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    got = [(r.id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect()]
    prints = {d: brute_fingerprint(t) for d, t in corpus}
    assert Counter((d, f) for d, f, _ in got) == Counter((d, prints[d]) for d, _ in corpus)
    distinct = sorted(set(prints.values()))
    links = [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= 2]
    root = closure(links, distinct)
    least = defaultdict(lambda: 1 << 62)
    for d, f in prints.items():
        least[root[f]] = min(least[root[f]], 1 << 62 if d is None else d)
    assert all(c == least[root[f]] for _, f, c in got)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    pairs = [(max(a, b), min(a, b)) for a, b in ((rng.randrange(400), rng.randrange(400)) for _ in range(300)) if a != b] + [(i + 1001, i + 1000) for i in range(150)]
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "u long, v long")).collect()))
    want = {n: r for n, r in closure(pairs, {n for p in pairs for n in p}).items() if n != r}
    assert got == want


@pytest.mark.parametrize("rows", [1 << 12, 3])
def test_near_copies(spark, docs, corpus, monkeypatch, rows):
    monkeypatch.setattr(nearcopies, "ROWS", rows)
    got = nearcopies.near_copies(docs).collect()
    shingles = {}
    for d, t in corpus:
        w = (t or "").encode().lower().split()
        shingles[d, t] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    keys = [*shingles]
    links = [(i, j) for i in range(len(keys)) for j in range(i) if len(shingles[keys[i]] & shingles[keys[j]]) >= 0.8 * len(shingles[keys[i]] | shingles[keys[j]])]
    root = closure(links, range(len(keys)))
    groups = defaultdict(list)
    for i, r in root.items():
        groups[r].append(keys[i][0])
    least = {keys[i][0]: min((x for x in groups[r] if x is not None), default=None) for i, r in root.items()}
    assert {(r.id, r.group_id) for r in got} == set(least.items())
    assert sum(r.keeps for r in got) == len(groups) and all(r.id == r.group_id for r in got if r.keeps)
    assert sorted(docs.columns) == sorted(nearcopies.one_of_each(docs).columns)
    assert nearcopies.one_of_each(docs).count() == len(groups)
    assert nearcopies.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rows", [1 << 12, 40])
def test_near_copies_star(spark, monkeypatch, rows):
    """A page and its edited versions, alike over the page alone, in buckets of over SMALL texts and in several blocks."""
    monkeypatch.setattr(nearcopies, "ROWS", rows)
    rng = random.Random(12)
    texts = []
    for page in range(2):
        base = [f"{page}w{k}" for k in range(204)]
        texts.append(base)
        for v in range(250):
            edited = list(base)
            for at in rng.sample(range(5, 200), 3):
                edited[at] = f"e{v}x{at}"
            texts.append(edited)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(links) < 0.1 * len(sets) ** 2
    root = closure(links, range(len(sets)))
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.id: r.group_id for r in nearcopies.near_copies(frame).collect()}
    assert len(set(root.values())) == 2 and got == root


def test_near_copies_large_group(spark):
    """Thousands of near copies of one text, in buckets far over SMALL, and one exact copy many times, among unlike texts."""
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(100)]
    texts = []
    for _ in range(3400):
        edited = list(base)
        edited[rng.randrange(100)] = word()
        texts.append(" ".join(edited))
    texts += [" ".join(word() for _ in range(60)) for _ in range(500)] + [texts[0]] * 2000
    frame = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(6)
    got = {r.id: (r.group_id, r.keeps, r.times) for r in nearcopies.near_copies(frame).collect()}
    assert got == {i: (0 if i < 3400 or i >= 3900 else i, i == 0 or 3400 <= i < 3900, 1) for i in range(len(texts))}
    assert nearcopies.one_of_each(frame).count() == 501


def test_near_copies_repeated_line(spark):
    """The same shingles, a line once more or many times more: alike, however far apart fingerprints over all shingles are."""
    rng = random.Random(21)
    rows = []
    for k in range(30):
        word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
        body, line = [word() for _ in range(300)], [word() for _ in range(12)]
        rows += [(2 * k, " ".join(body + line * 2)), (2 * k + 1, " ".join(body + line * 40))]
    prints = [simhash.fingerprint_of(simhash.shingle_hashes(t, 5)) for _, t in rows]
    assert any((a ^ b).bit_count() > nearcopies.RADIUS for a, b in zip(prints[::2], prints[1::2]))
    got = {r.id: r.group_id for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(60)}


def test_decontamination(spark, docs, corpus, monkeypatch):
    by_id = dict(corpus)
    long = [t for t in by_id.values() if t and len(t.split()) > 60]
    items = [(1, long[0].upper()), (2, " ".join(long[1].split()[5:30])), (3, "x"), (4, None), (5, " .. "), (None, long[2]), (6, " ".join(long[1].split()[5:9])), (7, "x"), (10, "x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    want = Counter()
    for d, t in corpus:
        w, hit, found = split(t), set(), set()
        for item, text in items:
            v = split(text)
            if item is None or not v:
                continue
            n = min(10, len(v))
            grams = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    found.add(str(item))
        want[d, len(w), len(hit), tuple(sorted(found))] += 1
    clean = Counter((d, t) for d, t in corpus if not any(k[2] for k in want if k[0] == d))
    for limit in (decontamination.SET, 1):
        monkeypatch.setattr(decontamination, "SET", limit)
        got = decontamination.contaminated(docs, bench).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == want
        kept = decontamination.without_contaminated(docs, bench)
        assert kept.columns == docs.columns and multiset(kept.select("doc_id", "text").collect()) == clean
    assert decontamination.contaminated(docs, bench.limit(0)).where("n_hit > 0").count() == 0
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("rows,queries_,blocks", [(8192, 2048, 20_000), (40, 3, 20_000), (40, 3, 0)])
def test_top_k(spark, monkeypatch, rows, queries_, blocks):
    monkeypatch.setattr(topk, "BLOCKS", blocks)
    monkeypatch.setattr(topk, "ROWS", rows)
    monkeypatch.setattr(topk, "QUERIES", queries_)
    rng = random.Random(4)
    vectors = [(i, [rng.choice([rng.gauss(0, 1), 0.5]) for _ in range(6)]) for i in range(200)]
    vectors += [(i, [0.5] * 6) for i in range(200, 260)] + [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, [float("inf")]), (304, []), (305, [2.0]), (None, [1.0]), vectors[7]]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    got = [tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 20 == 0, 5).collect()]
    good = [(i, [int(np.floor(1024 * x)) for x in v] + [0] * (6 - len(v))) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, own in (r for r in good if r[0] % 20 == 0):
        scores = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in good if i != q)[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scores, 1)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(frame.limit(0), F.lit(True)).count() == 0


def test_top_k_large_components(spark):
    """Products beyond doubles and beyond 64 bits: exact, or an error if such a score would be returned."""
    vectors = [(0, [3e6 + 0.25, 1.0]), (1, [2e6 + 0.5, 7.0]), (2, [2e6, 8.0]), (3, [-1e300, 1.0])]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(frame.where("vec_id < 3"), F.col("vec_id") == 0, 2).collect()]
    ints = {i: [int(np.floor(1024 * x)) for x in v] for i, v in vectors}
    score = lambda a, b: sum(x * y for x, y in zip(ints[a], ints[b]))
    assert got == [(0, 1, 1, score(0, 1)), (0, 2, 2, score(0, 2))]
    assert [r.vec_id for r in topk.top_k(frame, F.col("vec_id") == 0, 2).collect()] == [1, 2]
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(frame, F.col("vec_id") == 0, 3).collect()


def brute_repeats(rows, scheme):
    first, out = {}, []
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        s = scheme.parse((t or "").encode())
        gone = np.zeros(len(s), bool)
        for i in range(len(s) - scheme.window + 1):
            if first.setdefault(scheme.join(s[i : i + scheme.window]), (d, i)) != (d, i):
                gone[i : i + scheme.window] = True
        kept = scheme.kept((t or "").encode(), s, gone)
        out.append((d, len(s), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest(), kept))
    return Counter(out)


@pytest.mark.parametrize("hot", [1000, 1])
@pytest.mark.parametrize("scheme", [substrings.Words(20), suffixes.Bytes(100)], ids=["words", "bytes"])
def test_remove_repeats(docs, corpus, monkeypatch, scheme, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "HOT_SHARE", 0.0 if hot == 1 else 0.02)
    got = Counter((r.id, r.n, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in repeats.remove_repeats(docs, scheme).collect())
    assert got == brute_repeats(corpus, scheme)
    assert repeats.remove_repeats(docs.limit(0), scheme).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_remove_repeats_of_one_id(spark, corpus, kind):
    """Rows of one id with other texts: windows that start earlier in another document go, whichever row they are in."""
    line = lambda a: " ".join(f"{a}{k}" for k in range(40))
    rows = [(1, line("w")), (2, line("v")), (2, line("w") + " tail"), (3, line("w")), (3, line("w")), (None, line("v")), (None, line("x"))]
    frame = spark.createDataFrame([(None if d is None else str(d) if kind == "string" else d, t) for d, t in rows], f"doc_id {kind}, text string")
    got = Counter((None if r.id is None else int(r.id), r.n, r.n_removed) for r in repeats.remove_repeats(frame, substrings.Words(20)).collect())
    assert got == Counter([(1, 40, 0), (2, 40, 0), (2, 41, 40), (3, 40, 40), (3, 40, 40), (None, 40, 40), (None, 40, 0)])


def test_pieces_of_long_texts(monkeypatch):
    """Texts over several pieces give the same runs as in one piece."""
    rng = np.random.default_rng(6)
    scheme = substrings.Words(20)
    h = rng.integers(0, 50, 4000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    whole = {(s + k, a) for s, n, a in zip(*map(lambda v: v.tolist(), repeats.anchors(h, np.array([0]), np.array([len(h)]), 20, 5))) for k in range(n)}
    monkeypatch.setattr(repeats, "CHUNK", 300)
    pieces = repeats._Pieces(scheme)
    runs = [*pieces.add(0, h), *pieces.flush()]
    got = [(s + k, a) for _, start, n, anchor in runs for s, m, a in zip(start.tolist(), n.tolist(), anchor.tolist()) for k in range(m)]
    assert len(got) == len(set(got)) == len(h) - 19 and set(got) == whole


def test_suffix_array():
    rng = random.Random(4)
    for trial in range(200):
        parts = [[rng.randint(1, 2 if trial % 2 else 4) for _ in range(rng.randint(0, 30))] for _ in range(rng.randint(1, 6))]
        x = np.array([s for p in parts for s in (*p, 0)], np.uint16)
        text = lambda i: tuple(x[i : i + int(np.argmax(x[i:] == 0))].tolist())
        order = suffixes.suffix_array(x, 50).tolist()
        assert sorted(order) == list(range(len(x)))
        assert [text(i) for i in order] == sorted(text(i) for i in order)


def test_targets():
    assert mixing.targets({"a": 100, "b": 100, None: 100}) == {"a": 50.0, "b": 100.0, None: 150.0}
    got = mixing.targets({"a": 1000, "b": 10, "c": 10})
    assert got == {"a": 960.0, "b": 30, "c": 30} and mixing.targets({}) == {}
    assert mixing.targets({"a": 0, "b": 5})["a"] == 0


def test_flight_keeps_totals():
    rng = np.random.default_rng(8)
    size = rng.integers(0, 3000, 500)
    p = np.full(500, 0.37)
    out = mixing.flight(p, size, rng.random(500))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - p.sum()) < 1e-6 and abs(out @ size - p @ size) < 1e-3


def test_mix(spark, docs, corpus, monkeypatch):
    for flight in (mixing.FLIGHT, 8):
        monkeypatch.setattr(mixing, "FLIGHT", flight)
        monkeypatch.setattr(mixing, "REST", 2)
        got = mixing.mix(docs).collect()
        assert Counter((r.id, r.size) for r in got) == Counter((d, len(words(t))) for d, t in corpus)
        by = defaultdict(list)
        for r in got:
            by[r.source].append(r)
        goal = mixing.targets({s: sum(r.size for r in v) for s, v in by.items()})
        for s, v in by.items():
            assert all(r.target == goal[s] and r.source_size == sum(x.size for x in v) and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in v)
            if max(r.size for r in v) < 0.3 * sum(r.size for r in v):
                assert abs(sum(r.taken for r in v) - goal[s]) <= max(5, 0.005 * goal[s]), s
        assert multiset(mixing.mix(docs).collect()) == multiset(got)
    whole = mixing.mixed(docs)
    assert Counter((r.doc_id, r.source, r.size, r.copies, r.taken) for r in whole.collect()) == Counter((r.id, r.source, r.size, r.copies, r.taken) for r in got)
    assert whole.count() == len(corpus) and set(docs.columns) <= set(whole.columns)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mix_equal_rows(spark, monkeypatch):
    """Null ids, and equal rows in numbers far over a flight: each row is a document, and totals hold."""
    monkeypatch.setattr(mixing, "FLIGHT", 64)
    monkeypatch.setattr(mixing, "SHARES", 4)
    rows = [(7, "a", "x y z")] * 400 + [(None, "a", " ".join(["w"] * k)) for k in range(200)] + [(k, "b", "one two") for k in range(50)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3).cache()
    got = mixing.mix(frame).collect()
    assert Counter((r.id, r.source, r.size) for r in got) == Counter((d, s, len(t.split())) for d, s, t in rows)
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.01 * own[0].target and all(0 <= r.taken <= 3 * r.size for r in own)
    assert mixing.mixed(frame).count() == len(rows)


def test_mix_keeps_the_landing(spark, monkeypatch):
    """A small source is settled alike whether or not another one takes several flights, and so is a large one's total."""
    rng = np.random.default_rng(31)
    size = {s: np.r_[np.maximum(1, rng.lognormal(5, 1, n)).astype(int), 20_000] for s, n in (("a", 100), ("b", 900))}
    rows = [(1000 * k + i, s, " ".join(["w"] * int(n))) for k, (s, v) in enumerate(size.items()) for i, n in enumerate(v)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string").cache()
    monkeypatch.setattr(mixing, "REST", 2)
    found = {}
    for flight in (4096, 128):
        monkeypatch.setattr(mixing, "FLIGHT", flight)
        found[flight] = mixing.mix(frame, weights=(1, 1.3)).collect()
        for s in "ab":
            own = [r for r in found[flight] if r.source == s]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 0.005 * own[0].target, (flight, s)
    small = [{r.id: r.copies for r in v if r.source == "a"} for v in found.values()]
    assert small[0] == small[1]


def test_folds(spark):
    ids = [0, 1, 17, 123456789]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i long").select(fold(F.col("i"), 3)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 3 for i in ids]
