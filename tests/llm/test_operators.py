"""Each operator against plain Python on a small table that holds the edge cases, and on an empty table."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

xxhash = pytest.importorskip("xxhash")

from tallyport.llm import anchors, debruijn, embeddings, kneser_ney, mixing, packing, quality_rules, simhash_golay, spelling, suffix_levels, token_counts, toxicity, word_bpe  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def pairs(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def counted(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


# --- token counts and packing -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return word_bpe.word_ids(word_bpe.default_path()).library


def test_token_counts(docs, library):
    want = Counter((i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 2048) for i, t in pairs(docs))
    assert counted(token_counts.token_counts(docs), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_prefix_counts(texts, library):
    for t in [*texts, "a<|endoftext|>b <|endoftext|> <| c|> " * 9, "Tail <|endoftext|><|endoftext|>.", "É<|é <|x|> İ<|endoftext|>"]:
        if not t:
            continue
        t = t[:400]
        p = token_counts.PrefixCounts(t, word_bpe.default_path())
        for k in range(0, len(t.encode()) + 1, 7):
            assert p.count(k) == len(library.encode(t.encode()[:k].decode("utf-8", "ignore"), add_special_tokens=False).ids)
        for budget in (0, 1, 5, 50, 10_000):
            cut = p.fit(budget)
            assert p.count(cut) <= budget
            rest = [e for e in p.ends.tolist() if e > cut]
            assert not rest or p.count(rest[0]) > budget


def test_prefix_table(docs, library):
    for r in token_counts.prefix_table(docs.where("length(text) < 3000")).join(docs.select("doc_id", "text"), "doc_id").dropDuplicates(["doc_id"]).collect():
        raw = (r.text or "").encode()
        assert len(r.prefix_bytes) == len(raw.split())
        assert r.prefix_tokens == [len(library.encode(raw[:e].decode(), add_special_tokens=False).ids) for e in r.prefix_bytes]


def test_long_text_is_counted_in_linear_time(library):
    import time

    text = "word <|endoftext|> Other<|x " * 40_000
    began = time.time()
    p = token_counts.PrefixCounts(text, word_bpe.default_path())
    assert p.count(len(text)) == len(library.encode(text, add_special_tokens=False).ids) and time.time() - began < 30


def test_word_ids_are_those_of_the_library(library):
    import random

    import pyarrow as pa

    memo, rng = word_bpe.WordIds(word_bpe.default_path(), max_words=50), random.Random(1)
    letters = "aAbB éÉßİΣς'’ st.,!?\x0b\x0c\x85\xa0\x1c 12٣漢字ｶﾞẞﬁéͅ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    for t in texts:
        rows, at, special = word_bpe.ids_of(pa.array([t]), memo)
        assert not special and memo.gather(rows).tolist() == library.encode(t, add_special_tokens=False).ids


def test_packing(docs, library):
    found = packing.pack(docs).collect()
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    padding = total = 0
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
        total += at
    assert padding <= 0.02 * total
    want = Counter()
    for i, t in pairs(docs):
        want[i, zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes())] += 1
    whole = Counter((r.doc_id, r.ids_crc32) for r in found if r.length == r.doc_tokens)
    assert not whole - want
    cut = [r for r in found if r.length < r.doc_tokens]
    assert sum((want - whole).values()) == sum(r.start == 0 for r in cut)
    for r in cut:
        options = [np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in pairs(docs) if i == r.doc_id]
        assert any(len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for ids in options)
    assert packing.pack(docs.limit(0)).count() == 0


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(2)
    for _ in range(60):
        pos = [0, *np.cumsum(rng.integers(1, 9, 14)).tolist()]
        penalty = [0, *rng.integers(0, 6, 14).tolist()]
        best = {0: 0}
        for j in range(1, len(pos)):
            best[j] = min(best[i] + 16 - (pos[j] - pos[i]) + penalty[j] for i in range(j) if pos[j] - pos[i] <= 16)
        cuts = packing.cut_places(pos, penalty, 16, last=False)
        price = dict(zip(pos, penalty, strict=True))
        assert sum(16 - (b - a) + price[b] for a, b in zip(cuts, cuts[1:], strict=False)) == best[len(pos) - 1]
    assert packing.tail(1500, 2048)[1] == [1024, 1280, 1408, 1472, 1488, 1496, 1500] and packing.tail(2047, 2048) == (1, [2047])


def test_stream_in_chunks_is_complete(library):
    """Documents longer than a chunk and chunk borders lose nothing."""
    import pyarrow as pa

    stream = packing._Stream(64, 0, np.zeros(50_000, bool), pa.int64())
    rng, out, docs = np.random.default_rng(0), [], []
    for d, n in enumerate([5, 1000, 1, 64, 63, 400, 7]):
        ids = rng.integers(0, 40_000, n).astype(np.uint32)
        docs.append(ids)
        stream.add([d], np.array([n]), ids)
        out.append(stream.cut(False))
    out.append(stream.cut(True))
    rows = [r for b in out if b for r in b.to_pylist()]
    for d, ids in enumerate(docs):
        at = 0
        for r in sorted((r for r in rows if r["doc_id"] == d), key=lambda r: r["start"]):
            assert r["start"] == at and zlib.crc32(ids[at : at + r["length"]].astype("<u4").tobytes()) == r["ids_crc32"]
            at += r["length"]
        assert at == len(ids)
    sums = Counter()
    for r in rows:
        sums[r["sequence_id"]] += r["length"]
    assert max(sums.values()) <= 64


# --- quality rules and classifier ---------------------------------------------------------------------------------------


def base_counts(t):
    w = WORD.findall(t)
    c, covered = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)), set()
    for i in range(len(w) - 4):
        if c[tuple(w[i : i + 5])] > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs):
    want = Counter((i, *(b := base_counts(t)), b[0] < 10 or 100 * b[4] > 20 * b[0]) for i, t in pairs(docs))
    got = quality_rules.quality_rules(docs)
    assert counted(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert got.where("base_failed AND kept").count() == 0
    assert got.where("NOT base_failed AND kept").count() > 50
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_js_distance(spark):
    df = spark.createDataFrame([(1, 0, 0, 1), (2, 2, 1, 1), (0, 0, 1, 1), (3, 1, 1, 1)], "a int, b int, c int, d int")
    got = [r[0] for r in df.select(quality_rules.js_distance([F.col("a"), F.col("b")], [F.col("c"), F.col("d")])).collect()]
    m = [(0.75 + 0.5) / 2, (0.25 + 0.5) / 2]
    want = (sum(p * np.log2(p / x) for p, x in zip((0.75, 0.25), m, strict=True)) / 2 + sum(0.5 * np.log2(0.5 / x) for x in m) / 2) ** 0.5
    assert got[0] == pytest.approx(1) and got[1] == 0 and got[2] is None and got[3] == pytest.approx(want)


def test_rules_reject_unlike_text(spark, sf_dir):
    junk = [(1, "| ".join(["Qzxv|||"] * 3) + " | ".join(f"zzq{i}x||" for i in range(120)), "en"), (2, " ".join(f"WORD{i}!!" for i in range(150)), "en")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id") + 100, "text", "lang").toDF("doc_id", "text", "lang")
    got = quality_rules.quality_rules(docs.union(spark.createDataFrame(junk, "doc_id long, text string, lang string")))
    assert [r.kept for r in got.where("doc_id < 100").collect()] == [False, False]


def test_every_language_has_its_own_characters(spark):
    """A language without listed words is judged by its characters alone; a null one by the base rule alone."""
    rows = [(i, " ".join(f"слово{i}ж{j}" for j in range(80)), "xx") for i in range(30)]
    junk = " ".join(f"{j}{j + 1}!!{j}" for j in range(150))
    df = spark.createDataFrame([*rows, (100, junk, "xx"), (101, junk, None), (102, junk, "yy")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules.quality_rules(df).collect()}
    assert [got[i].kept for i in (0, 29, 100, 101, 102)] == [True, True, False, True, True]
    assert got[101].char_distance is None and got[102].char_distance == pytest.approx(0, abs=1e-6) and all(r.word_distance is None for r in got.values())


def plain_kneser_ney(texts):
    """log2 probability of a gram, straight from the definition."""
    table, size, n = spelling.class_table(), spelling.CLASSES, spelling.ORDER
    counts = [Counter() for _ in range(n + 1)]
    for t in texts:
        codes = [spelling.START] * (n - 1) + [int(table[ord(c)]) if ord(c) < 65536 else 62 for c in t]
        for i in range(n - 1, len(codes)):
            counts[n][tuple(codes[i - n + 1 : i + 1])] += 1
    for k in range(n - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1
    cut = [None] + [spelling.discounts(*[sum(v == j for v in counts[k].values()) for j in (1, 2, 3, 4)]) for k in range(1, n + 1)]
    d = lambda k, c: cut[k][min(c, 3) - 1]
    totals = [None] + [Counter() for _ in range(n)]
    lefts = [None] + [Counter() for _ in range(n)]
    for k in range(1, n + 1):
        for g, c in counts[k].items():
            totals[k][g[:-1]] += c
            lefts[k][g[:-1]] += d(k, c)

    def p(g):
        if not g:
            return 1 / size
        k, total = len(g), totals[len(g)][g[:-1]]
        if not total:
            return p(g[1:])
        c = counts[k][g]
        return ((c - d(k, c)) / total if c else 0) + lefts[k][g[:-1]] / total * p(g[1:])

    return p


def halved(spark, texts):
    return spark.createDataFrame([(t, zlib.crc32(t.encode()) % 2) for t in texts], "text string, half int")


def test_kneser_ney_equals_the_definition(spark, texts):
    some = [t for t in texts[:40] if t]
    models = spelling.trained(halved(spark, some))
    rng = np.random.default_rng(0)
    for half, model in enumerate(models):
        dense, p = model.dense(), plain_kneser_ney([t for t in some if zlib.crc32(t.encode()) % 2 == half])
        for g in [*rng.integers(0, 64, (300, 4)).tolist(), [20, 8, 5, 0], [63, 63, 63, 46], [8, 5, 0, 15]]:
            code = g[0] << 18 | g[1] << 12 | g[2] << 6 | g[3]
            assert dense[code] / spelling.SCALE == pytest.approx(np.log2(p(tuple(g))), abs=2e-3)
        assert np.exp2(dense.reshape(-1, 64) / spelling.SCALE).sum(axis=1) == pytest.approx(1, abs=1e-3)
    assert spelling.trained(halved(spark, [])) == [None, None]


def plain_word_bits(texts, trusted, spell):
    """Bits of each text by bigrams of the trusted texts of the other half, straight from the definition; spell(word, half) is log2 of its spelling."""
    half = lambda t: zlib.crc32(t.encode()) % 2
    padded = lambda t: ["<", *WORD.findall(t), ">"]
    counts = {(k, m): Counter() for k in (1, 2) for m in (0, 1)}
    for t in trusted:
        w = padded(t)
        counts[2, 1 - half(t)].update(zip(w, w[1:], strict=False))
    for m in (0, 1):
        counts[1, m].update(b for _, b in counts[2, m])
    cut = {k: spelling.discounts(*[sum(v == j for v in c.values()) for j in (1, 2, 3, 4)]) for k, c in counts.items()}
    totals, lefts = Counter(), Counter()
    for (k, m), own in counts.items():
        for g, c in own.items():
            at = (m, g[0]) if k == 2 else (m,)
            totals[at] += c
            lefts[at] += cut[k, m][min(c, 3) - 1]

    def share(k, m, g, at):
        c = counts[k, m][g]
        return (c - cut[k, m][min(c, 3) - 1]) / totals[at] if c else 0

    log2 = lambda x: np.log2(x) if x else -np.inf

    def p(m, v, w, base):
        """log2; base too, as the spelling of a long word has no number"""
        low = np.logaddexp2(log2(share(1, m, w, (m,))), log2(lefts[m,] / totals[m,]) + base)
        return np.logaddexp2(log2(share(2, m, (v, w), (m, v))), log2(lefts[m, v] / totals[m, v]) + low) if totals[m, v] else low

    out = []
    for t in texts:
        w, m = padded(t), half(t)
        out.append(-sum(p(m, v, x, spell(x, m) if x != ">" else -6) for v, x in zip(w, w[1:], strict=False)))
    return out


def test_bits_limits_and_kept_equal_the_definition(spark, texts, docs, labels, monkeypatch):
    """The whole classifier by plain Python, with blocks of a few documents each: bits, limits of each language, decisions."""
    import pyarrow as pa

    monkeypatch.setattr(kneser_ney, "BLOCK", 3000)
    rows = docs.collect()
    good = {r.doc_id for r in labels.where("quality = 1").collect()} - {None}
    trusted = [r.text or "" for r in rows if r.doc_id in good]
    dense = [m.dense() for m in spelling.trained(halved(spark, trusted))]
    table = spelling.class_table()
    spell = lambda w, half: float(spelling.spelled(pa.array([w]), table, dense[1 - half])[0])
    want = []
    for r, bits in zip(rows, plain_word_bits([r.text or "" for r in rows], trusted, spell), strict=True):
        t = r.text or ""
        gram, _ = spelling.grams(pa.array([t]), table)
        size = max(len(t), 1)
        want.append((r, size, -float(dense[1 - zlib.crc32(t.encode()) % 2][gram].sum(dtype=int)) / spelling.SCALE / size, bits / size))
    q = lambda x, f: sorted(x)[int(np.ceil(f * len(x))) - 1] if x else None
    step = lambda x: np.floor(x * 1024 + 0.5) / 1024
    ends = lambda own: (q([step(w[2]) for w in own], 0.005), q([step(w[2]) for w in own], 0.995), q([step(w[3]) for w in own], 0.995), len(own))
    known = [w for w in want if w[0].doc_id in good and w[1] >= 100]
    plan = Counter()
    for r, size, plain, bits in want:
        low, most, high, n = ends([w for w in known if w[0].lang == r.lang] or known)
        slack = 0.05 * (2000 / size) ** 0.5 * (1 + 40 / size) * (1 + 50 / n)
        kept = bool(WORD.search(r.text or "")) and low - 3 * slack <= plain <= most + slack and bits <= high + slack
        plan[r.doc_id, r.lang, len(r.text or ""), round(bits, 3), round(plain, 3), kept] += 1
    got = kneser_ney.quality_classifier(docs, labels, carry=("text", "kept")).collect()
    found = Counter()
    for r in got:
        assert r.carry.kept == "clash" and len(r.carry.text or "") == r.n_chars
        # rounding may fall on either side
        near = [(r.doc_id, r.lang, r.n_chars, round(r.bits_per_char + a, 3), round(r.spelling_bits + b, 3), r.kept) for a in (0, 5e-4, -5e-4) for b in (0, 5e-4, -5e-4)]
        found[next((k for k in near if plan[k] > found[k]), near[0])] += 1
    assert found == +plan


def test_one_half_alone_scores_all(spark):
    rows = [(i, f"alpha beta gamma {i}", "en") for i in range(20)]
    good = [i for i, t, _ in rows if zlib.crc32(t.encode()) % 2]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = kneser_ney.quality_classifier(docs, spark.createDataFrame([(i, 1) for i in good], "doc_id long, quality int")).collect()
    assert len(got) == 20 and all(r.kept and r.bits_per_char > 0 for r in got)


def test_scores_dont_depend_on_the_deal(spark, docs, labels):
    one = counted(kneser_ney.quality_classifier(docs.coalesce(1), labels), "doc_id", "bits_per_char", "spelling_bits", "low", "high", "kept")
    assert one == counted(kneser_ney.quality_classifier(docs.repartition(11), labels), "doc_id", "bits_per_char", "spelling_bits", "low", "high", "kept")


def test_order_of_words_counts(spark, sf_dir):
    """What the trusted texts say grows with them: the same words in another order, which classes hardly tell apart, cost more."""
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(400)]
    after = {w: [words[k] for k in rng.integers(0, 400, 3)] for w in words}

    def chain(n):
        out = [words[rng.integers(400)]]
        while len(out) < n:
            out.append(after[out[-1]][rng.integers(3)])
        return out

    rows = [(i, " ".join(chain(150)), "en") for i in range(400)]
    rows += [(1000 + i, " ".join(rng.permutation(chain(150))), "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(400)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in kneser_ney.quality_classifier(docs, labels).collect()}
    assert sum(kept[i] for i in range(400)) >= 396 and not any(kept[1000 + i] for i in range(20))


def test_short_noise_is_rejected(spark):
    rng = np.random.default_rng(2)
    prose = lambda n: " ".join("".join(rng.choice(list("aeiorst"), rng.integers(2, 7))) for _ in range(n))
    rows = [(i, prose(8 if i % 8 == 0 else 60), "en") for i in range(200)] + [(900, "Xq*** zvwj$$$ kp&&& wvqk$$$", "en"), (901, "Zk*** qjw.###", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(200)], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in kneser_ney.quality_classifier(docs, labels).collect()}
    assert sum(kept[i] for i in range(200)) >= 196 and not kept[900] and not kept[901]


def test_rare_languages_have_their_own_limits(spark):
    rng = np.random.default_rng(3)
    prose = lambda letters: " ".join("".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(200))
    rows = [(i, prose("abcdefghijklmnopqrstuvwxyz"), "en") for i in range(120)] + [(500 + i, prose("ae"), "xx") for i in range(30)]
    rows += [(900, prose("abcdefghijklmnopqrstuvwxyz"), "xx"), (901, prose("abcdefghijklmnopqrstuvwxyz"), "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, _, _ in rows if i < 900], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in kneser_ney.quality_classifier(docs, labels).collect()}
    assert all(kept[500 + i] for i in range(30)) and not kept[900] and kept[901]


def test_quality_classifier(docs, labels, spark):
    got = kneser_ney.quality_classifier(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in pairs(docs))
    kept = {r.doc_id: r.kept for r in got}
    text = dict(pairs(docs))
    assert all(not kept[i] for i in text if not WORD.search(text[i]) and i is not None)
    assert sum(kept[i] for i in range(10, 70)) >= 58
    assert kneser_ney.quality_classifier(docs.limit(0), labels).count() == 0
    bare = kneser_ney.quality_classifier(docs, labels.limit(0)).collect()
    assert all(r.kept == bool(WORD.search(text[r.doc_id])) for r in bare if r.doc_id is not None)


# --- toxicity -----------------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    hit = sum(r.toxic == 1 and r.predicted == 1 for r in got)
    assert hit >= 0.9 * sum(r.toxic for r in got) and hit >= 0.95 * sum(r.predicted for r in got)


def test_toxicity_edges(docs, labels, spark):
    got = toxicity.toxicity(docs, labels)
    assert Counter(r.doc_id for r in got.collect()) == Counter(i for i, _ in pairs(docs))
    assert got.where("score IS NULL OR score < 0 OR score > 1 OR predicted <> CAST(score >= 0.5 AS INT)").count() == 0
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_toxicity_learns_one_text_an_id(spark, monkeypatch):
    """What comes to the driver is bounded by ids that were drawn, however many documents repeat one of them."""
    texts = [(i, f"you stupid idiot number {i}" if i % 4 == 0 else f"a calm sentence about topic {i}", int(i % 4 == 0)) for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts] + [(4, f"{t} again") for _, t, _ in texts] + [(None, "you idiot"), (7, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts] + [(None, 1)], "doc_id long, toxic int")
    seen = []
    fitted = toxicity.BoostedTrees.fit
    monkeypatch.setattr(toxicity.BoostedTrees, "fit", lambda self, x, y: seen.append(len(x)) or fitted(self, x, y))
    got = toxicity.toxicity(docs, labels, max_rows=40).collect()
    assert len(got) == 162 and seen and seen[0] <= 40 and {r.held_out for r in got if r.doc_id is None} == {True}


def test_isotonic_and_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 1)).astype(float)
    model = toxicity.BoostedTrees(rounds=40).fit(x[:3000], y[:3000])
    assert ((model.raw(x[3000:]) > 0) == y[3000:]).mean() > 0.95
    at, level = toxicity.isotonic(np.array([1.0, 2, 3, 4, 4, 5]), np.array([0.0, 1, 0, 0, 1, 1]))
    assert (np.diff(level) >= 0).all() and np.interp([1, 3, 5], at, level).tolist() == [0, 0.5, 1]


# --- near-duplicates ----------------------------------------------------------------------------------------------------


def plain_simhash(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    w = WORD.findall(t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    rows = sorted(pairs(docs), key=lambda r: (r[0] is None, r[0] or 0))
    fps = [plain_simhash(t) for _, t in rows]
    root = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    want = Counter((i, f"{fp:016x}", rows[r][0]) for (i, _), fp, r in zip(rows, fps, root, strict=True))
    assert counted(simhash_golay.simhash_groups(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash_golay.simhash_groups(docs.limit(0)).count() == 0


def test_golay_keys_meet():
    code, rng = simhash_golay.Golay(), np.random.default_rng(0)
    assert len(set(code.index(np.arange(1 << 23)).tolist())) == 4096
    fp = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    for bits in range(5):
        other = fp.copy()
        for i in range(len(other)):
            for b in rng.choice(64, bits, replace=False).tolist():
                other[i] ^= np.uint64(1 << b)
        met = [set() for _ in fp], [set() for _ in fp]
        for side, x in zip(met, (fp, other), strict=True):
            for r, k in zip(*(a.tolist() for a in simhash_golay.compound_keys(x, code)), strict=True):
                side[r].add(k)
        assert all(a & b for a, b in zip(*met, strict=True))


def test_simhash_chains_and_hot_groups(spark):
    """A chain of links is one group though its ends are far apart; a large group of fingerprints near one centre too."""
    rng = np.random.default_rng(4)
    chain = [0]
    for b in rng.permutation(60)[:40].tolist():
        chain.append(chain[-1] ^ (1 << b))
    far = (1 << 63) - 1
    ball = {far ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (400, 2))}
    rows = spark.createDataFrame([(x,) for x in {*chain, *ball}], "fp long")
    from tallyport.llm.components import components as joined
    from tallyport.llm.shared import Workspace

    roots = {r.v: r.root for r in joined(simhash_golay.simhash_links(rows), Workspace(spark)).collect()}
    assert len({roots.get(x, x) for x in chain}) == 1 and len({roots.get(x, x) for x in ball}) == 1


def plain_embedding_groups(rows, least=0.9):
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in ok}
    links = [(a, b) for a in ok for b in ok if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least]
    n = Counter(x for e in links for x in e)
    root = components(len(rows), links)
    return Counter((rows[i][0], n[i], rows[root[i]][0], rows[i][0] == rows[root[i]][0]) for i in range(len(rows)))


@pytest.mark.parametrize("tile", [embeddings.TILE, 7])
def test_embeddings(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + rng.normal(size=16) * 0.18).astype(np.float32).tolist()) for i in range(90)]
    rows += [(100 + i, rows[3][1]) for i in range(4)] + [(3, rows[3][1])]
    rows += [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [1.0, None]), (204, []), (205, [1.0, 2.0]), (206, [2.0, 4.0]), (207, [float("inf")] * 16)]
    rows.sort(key=lambda r: r[0])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "'x' AS cid", "'y' AS bucket")
    got = counted(embeddings.embedding_groups(df), "vec_id", "n_links", "component_id", "kept")
    assert got == plain_embedding_groups(rows)
    assert embeddings.embedding_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize(("dim", "hashes", "least"), [(64, 2, 0.99), (64, 3, 0.99), (64, 4, 0.97), (64, 5, 0.95), (384, 2, 0.97), (384, 3, 0.95), (768, 2, 0.97), (768, 3, 0.95), (1536, 2, 0.95)])
def test_cross_polytope_recall(dim, hashes, least):
    """Pairs at cosine 0.9 exactly share a bucket in one table at least."""
    rng, n = np.random.default_rng(3), 600
    a = embeddings.units(rng.normal(size=(n, dim)))
    b = rng.normal(size=(n, dim))
    b = embeddings.units(b - (a * b).sum(axis=1, keepdims=True) * a)
    near = 0.9 * a + np.sqrt(1 - 0.81) * b
    hasher = embeddings.CrossPolytope(dim, hashes, 1 << hashes)
    met = (hasher.keys(a)[:, :, :, None] == hasher.keys(near)[:, :, None, :]).any(axis=(1, 2, 3))
    print(dim, hashes, met.mean())
    assert met.mean() >= least


def test_number_of_hashes():
    assert [embeddings.shape(64, n)[0] for n in (10, 130_000, 10**6, 10**9)] == [2, 2, 3, 4]
    assert [embeddings.shape(1536, n)[0] for n in (10, 10**8, 10**9)] == [2, 2, 3]


def test_many_hashes_and_mixed_lengths_lose_no_link(spark):
    """Five hashes at 1,536 dimensions, and vectors of 1,024 and 2,048 dimensions in one table."""
    rng, rows = np.random.default_rng(4), []
    for k, dim in enumerate((1024, 1536, 2048)):
        for i in range(25):
            v = rng.normal(size=dim)
            rows += [(1000 * k + 2 * i, v.tolist()), (1000 * k + 2 * i + 1, (v + 0.05 * rng.normal(size=dim)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert counted(embeddings.embedding_groups(df, hashes=5), "vec_id", "n_links", "component_id", "kept") == plain_embedding_groups(rows)


def test_a_bucket_of_mixed_lengths():
    """Vectors of 2, 4 and 8 numbers whose keys met by chance: only those of a length are compared."""
    import pyarrow as pa

    vectors = [np.eye(d)[i % 2] for i in range(4) for d in (2, 4, 8)]
    keys = (np.arange(embeddings.TABLES, dtype=np.int64)[:, None] << embeddings.KEY_BITS).tobytes()
    columns = {"bucket": [0] * 12, "tile": [0] * 12, "part": [0] * 12, "cid": list(range(12)), "copies": [1] * 12, "vector": [v.tobytes() for v in vectors], "keys": [keys] * 12}
    (out,) = embeddings._verify(embeddings.TABLES, "<f8", 0.9)([pa.RecordBatch.from_pydict(columns)])
    linked = {frozenset(e) for e in zip(out["a"].to_pylist(), out["b"].to_pylist(), strict=True) if e[1] is not None}
    assert linked == {frozenset((i, j)) for i in range(12) for j in range(i) if (i - j) == 6}


# --- repeated spans -----------------------------------------------------------------------------------------------------


def plain_spans(sequences, window):
    seen = Counter(tuple(s[p : p + window]) for s in sequences for p in range(len(s) - window + 1))
    for s in sequences:
        covered = np.zeros(len(s) + 1, int)
        for p in range(len(s) - window + 1):
            if seen[tuple(s[p : p + window])] > 1:
                covered[p] += 1
                covered[p + window] -= 1
        yield np.cumsum(covered)[:-1] > 0


@pytest.mark.parametrize(("batches", "many"), [(1, anchors.MANY), (3, 2), (2, 0)])
def test_substring_dedup(docs, monkeypatch, batches, many):
    monkeypatch.setattr(anchors, "MANY", many)
    rows = [(i, t.encode()) for i, t in pairs(docs)]
    want = Counter()
    for (i, b), gone in zip(rows, plain_spans([b for _, b in rows], 200), strict=True):
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i, len(b), int(gone.sum()), runs, hashlib.sha256(rest).hexdigest()] += 1
    assert sum(k[2] for k in want) > 1000
    got = suffix_levels.substring_dedup(docs, batches=batches)
    assert counted(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffix_levels.substring_dedup(docs.limit(0)).count() == 0


def test_levels_merge_geometrically(spark, texts):
    from tallyport.llm.shared import Workspace

    index = suffix_levels.SuffixLevels(Workspace(spark), 50)
    rows = spark.createDataFrame([(i, (t or "").encode()) for i, t in enumerate(texts[:40])], "rid long, text binary")
    sizes = []
    for k in range(4):
        index.add(rows.where(F.col("rid") % 4 == k), rows)
        index.merge()
        sizes.append([rank for rank, _, _ in index.levels])
    assert sizes == [[0], [1], [1, 0], [2]]


@pytest.mark.parametrize("many", [anchors.MANY, 2])
def test_word_spans(docs, monkeypatch, many):
    monkeypatch.setattr(anchors, "MANY", many)
    rows = [(i, t.encode().split()) for i, t in pairs(docs)]
    want = Counter()
    for (i, w), gone in zip(rows, plain_spans([w for _, w in rows], 35), strict=True):
        want[i, len(w), int(gone.sum()), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()] += 1
    assert sum(k[2] for k in want) > 200
    assert counted(debruijn.word_span_dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert debruijn.word_span_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("kind", [anchors.Bytes(40, 16), anchors.Words(12, 4)])
def test_segments_and_windows(kind, monkeypatch):
    """Super-windows hold each window once, with the same anchor for equal windows, also where a text is worked off in segments."""
    monkeypatch.setattr(anchors, "SEGMENT", 64)
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 500).astype(kind.symbol)
    data[300:400] = data[100:200]
    seen = {}
    for held in anchors._segments(np.array([0, 500]), kind.window):
        _, first, length = (np.array(x) for x in zip(*held, strict=True))
        starts = np.cumsum(length) - length
        buffer = np.concatenate([data[f : f + n] for _, f, n in held])
        piece, at, count, anchor, h, _ = anchors.super_windows(kind, buffer, starts, length)
        for p, a, n, o, x in zip(piece, at - starts[piece] + first[piece], count, anchor, h, strict=True):
            for j in range(n):
                assert a + j not in seen
                seen[a + j] = (o - j, x)
    assert sorted(seen) == list(range(500 - kind.window + 1))
    assert all(seen[p] == seen[p + 200] for p in range(100, 200 - kind.window + 1))
    places = np.array(sorted(seen))
    want = [sum(bytes(data[p : p + kind.window]) == bytes(data[q : q + kind.window]) for q in places) > 1 for p in places]
    assert anchors.repeated_windows(kind, data, places).tolist() == want


# --- mixing -------------------------------------------------------------------------------------------------------------


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, total, target = set(names), 1.5 * sum(sizes.values()), {}
    while left:
        level = total / sum(weight[s] for s in left)
        full = [s for s in left if weight[s] * level >= 2 * sizes[s]]
        if not full:
            return target | {s: weight[s] * level for s in left}
        for s in full:
            target[s] = 2.0 * sizes[s]
            total -= target[s]
            left.remove(s)
    return target


def test_mixing(docs):
    got = mixing.mixing_plan(docs).collect()
    size = lambda t: len(WORD.findall(t or ""))
    rows = docs.select("doc_id", "text", "source").collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r.doc_id, size(r.text)) for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size(r.text)
    target = plain_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 64 for s in sizes)
    again = mixing.mixing_plan(docs.repartition(7))
    assert counted(again, "doc_id", "size", "taken") == Counter((r.doc_id, r.size, r.taken) for r in got)
    assert mixing.mixing_plan(docs.limit(0)).count() == 0


def test_mixed_documents(docs):
    plan = mixing.mixing_plan(docs).where("taken > 0")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    assert counted(out.select("doc_id", words.alias("w")), "doc_id", "w") == counted(plan, "doc_id", "taken")


def highest_quotients(votes, caps, seats):
    """One seat after another; ties go to the first."""
    won = [0] * len(votes)
    for _ in range(seats):
        k = max((i for i in range(len(votes)) if won[i] < caps[i]), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


def test_taken_words_one_by_one(docs):
    """Every document's taken words by dealing all blocks one after another; shards and starts are Spark's hashes."""
    start = F.pmod(F.xxhash64(F.lit(45), F.col("shard"), F.col("source")), F.greatest("n_blocks", F.lit(1)))
    plan = mixing.mixing_plan(docs).withColumn("start", start).collect()
    shards = {}
    for r in sorted(plan, key=lambda r: (r.draw, r.doc_id is not None, r.doc_id or 0, r.size)):
        shards.setdefault((r.source is None, r.source or "", r.shard), []).append(r)
    words = {k: sum(r.size for r in own) for k, own in shards.items()}
    blocks = {k: -(-n // mixing.BLOCK_WORDS) for k, n in words.items()}
    ratio = {k: own[0].target / own[0].source_size if own[0].source_size else 0.0 for k, own in shards.items()}
    names = sorted({k[:2] for k in shards})
    of = lambda name: sorted(k for k in shards if k[:2] == name)
    votes = [sum(ratio[k] * blocks[k] for k in of(s)) for s in names]
    by_source = highest_quotients(votes, [sum(2 * blocks[k] for k in of(s)) for s in names], int(sum(votes) + 0.5))
    for name, seats in zip(names, by_source, strict=True):
        own = of(name)
        for k, quota in zip(own, highest_quotients([ratio[x] * blocks[x] for x in own], [2 * blocks[x] for x in own], seats), strict=True):
            n = blocks[k]
            times = [quota // n + ((b + shards[k][0].start) * (quota % n) // n != ((b + shards[k][0].start + 1) * (quota % n)) // n) for b in range(n)]
            assert sum(times) == quota
            at = 0
            for r in shards[k]:
                assert r.taken == sum(times[w // mixing.BLOCK_WORDS] for w in range(at, at + r.size))
                at += r.size


def test_sainte_lague(spark):
    votes = [53.0, 24.0, 23.0, 0.0, 7.5]
    df = spark.createDataFrame([("g", i, v, 100) for i, v in enumerate(votes)] + [("f", 0, 5.0, 3)], "g string, i int, votes double, cap long")
    seats = F.when(F.col("g") == "g", F.lit(17)).otherwise(F.lit(9)).cast("long")
    got = {(r.g, r.i): r.quota for r in mixing.sainte_lague(df, ["g"], [F.col("i")], "votes", seats, "cap").collect()}
    won = [0] * len(votes)
    for _ in range(17):
        won[max(range(len(votes)), key=lambda i: votes[i] / (2 * won[i] + 1))] += 1
    assert [got["g", i] for i in range(len(votes))] == won and got["f", 0] == 3
