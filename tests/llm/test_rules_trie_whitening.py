"""Quality rules, conversation trie and whitening: brute-force versions and the odd cases they define."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillon.llm.rules")

from quillon.llm import prefixes, queries, rules, whitening  # noqa: E402

WORD = re.compile("[^\x20\x09-\x0d]+")


# --- quality rules


def counted(text):
    """The five counts of one text, by the rule's words."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    held = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            twice += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), twice, len(held)


def odd_texts():
    rng = random.Random(3)
    out = [None, "", " ", "\n\n", "a", "a b", "a b c", "a a a a", "a b a b a b", "x\nx\nx ", "x\n\nx\n \n ", "é é é é", "日本 語\n日本 語", "#*$%&|<>", "a\x0bb\x0cc\rd", "a b  c", "w " * 60, "\x00 \x00 \x00 \x00"]
    for _ in range(60):
        out.append("".join(rng.choice(["a", "b", "é", "文", " ", " ", "\n", "\t", "#", "|"]) for _ in range(rng.randint(1, 200))))
    return out + [out[9], out[9]]


SCHEMA = "doc_id long, text string, n_words string, score string, id string, label string"


def test_rule_counts_as_brute_force(spark):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t, "x", "y", "z", "l") for i, t in enumerate(texts)] + [(None, "no id", None, None, None, None)], SCHEMA).repartition(3)
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = rules.ruled(docs, rules.fitted(docs, none)).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        if r.doc_id is not None:
            want = counted(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert r.kept == (not r.base_failed)  # nothing to learn from
    assert rules.ruled(docs.where("false"), rules.fitted(docs.where("false"), none)).count() == 0


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["word ", "é ", "other\n", "abcdefghij"]) for _ in range(300)) for _ in range(3)] + ["x" * 900 + " y " + "x" * 900, "z" * 1000, " " * 500 + "end"]
    for text in texts:
        data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
        whole, grams = rules.measured(data, offsets)
        monkeypatch.setattr(rules, "PIECE", 64)
        parts, split = rules.measured(data, offsets)
        monkeypatch.undo()
        assert whole.tolist() == parts.tolist() == [list(counted(text))]
        assert (grams[:, : rules.CHARS] == split[:, : rules.CHARS]).all() and grams.sum() == split.sum()


def test_rule_grams_as_brute_force():
    """Every row's n-grams, whatever stands beside it, by counting them one by one."""
    texts = [t or "" for t in odd_texts()]
    data = b"".join(t.encode() for t in texts)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    _, counts = rules.measured(np.frombuffer(data, np.uint8), offsets)
    for text, row in zip(texts, counts, strict=True):
        raw, want = text.encode(), np.zeros(rules.CHARS, int)
        for size in (2, 3, 4):
            for i in range(len(raw) - size + 1):
                code = int.from_bytes(raw[i : i + size], "little") ^ (size * 0x5BD1)
                want[(code * 2654435761 & 0xFFFFFFFF) >> 21] += 1
        assert (row[: rules.CHARS] == want).all()
        n = len(raw.split())
        assert row[rules.CHARS :].sum() == n + max(n - 1, 0)


def test_rules_tell_labels_apart_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 1
    model = rules.fitted(docs, labels, ~held)
    got = rules.ruled(docs, model).join(labels.where(held), "doc_id").select("quality", "kept", "score", "base_failed").toPandas()
    low, good = got[got.quality == 0], got[got.quality == 1]
    assert len(low) > 8 and len(good) > 50
    assert (~low.kept).mean() >= 0.8
    assert good[~good.base_failed].kept.mean() >= 0.98
    # rank quality, and calibration: what is promised is what comes
    pairs = (good.score.to_numpy()[:, None] > low.score.to_numpy()[None]).mean()
    assert pairs > 0.95
    assert abs(got.score.mean() - got.quality.mean()) < 0.08


def test_the_classifier_decides(spark):
    """Rows that pass the rules and differ in their n-grams alone are told apart."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeioubdfgklmnprst") for _ in range(rng.randint(2, 8)))
    clean = [" ".join(word() for _ in range(120)) + "." for _ in range(80)]
    junk = [" ".join(word() + "$%%" for _ in range(120)) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(clean + junk)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(160) if i % 2] + [(1, None), (None, 0), (999, 1)], "doc_id long, quality int")
    got = rules.ruled(docs, rules.fitted(docs, labels)).collect()
    assert all(not r.base_failed and r.kept == (r.doc_id < 80) for r in got)


# --- conversation trie


def trie(rows, rebuild=True):
    """Nodes by their paths, each conversation's nodes walked one by one."""
    own = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(conv, []).append((role or "", text or ""))
    paths = {}
    for c, turns in own.items():
        base, h = int(math.fmod(c, 5)), zlib.crc32(str(c).encode()) % 9
        base = c - base
        paths[c] = tuple(turns if base == c or not rebuild else own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    own_saved = {p: (len(m) - 1) * (len(p[-1][1].encode()) if p else 0) for p, m in members.items()}
    children, saved, leaves = Counter(), Counter(), Counter()
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p in members:
        for d in range(len(p) + 1):
            saved[p[:d]] += own_saved[p]
            leaves[p[:d]] += not children[p]
    sha = lambda m: hashlib.sha256(",".join(map(str, sorted(m))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha([c for c in m if len(paths[c]) == len(p)])) for p, m in members.items())


FIELDS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def run_trie(spark, rows, rebuild=True):
    frame = spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, conv string, digest string, depth int, total int").repartition(3)
    turns = prefixes.numbered(frame)
    got = prefixes.prefix_trie(*(prefixes.rebuilt(turns) if rebuild else prefixes.whole(turns))).select(*FIELDS).collect()
    return sorted(tuple(r) for r in got)


def conversations(n, most, seed):
    rng = random.Random(seed)
    out = []
    for c in range(-7, n):
        if c % 11 == 3:
            continue  # absent, some of them firsts of their groups
        for t in range(rng.randint(1, most)):
            out.append((c, rng.choice([t, t, t, None, 1]), rng.choice(["user", "assistant", None, ""]), rng.choice(["a", "b", "é", "", None, "a b"])))
    return [*out, (None, 1, "user", "nobody's"), out[0], out[0]]


@pytest.mark.parametrize("rebuild", [True, False])
def test_trie_as_brute_force(spark, rebuild):
    rows = conversations(60, 12, 5)
    assert run_trie(spark, rows, rebuild) == trie(rows, rebuild)


def test_trie_in_blocks_and_pieces(spark, monkeypatch):
    """Windows of three turns, and one conversation that lies in many pieces: the same nodes."""
    rows = conversations(30, 10, 6) + [(20, t, "user", "ab"[t % 7 == 3]) for t in range(400)] + [(40, t, "user", "ab"[t % 7 == 3]) for t in range(395)]
    monkeypatch.setattr(prefixes, "BLOCK", 3)
    assert run_trie(spark, rows) == trie(rows)


def test_trie_of_nothing_and_of_copies(spark):
    assert run_trie(spark, [(None, 1, "a", "b")]) == []
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 3000, 5) for t in range(3)]  # firsts of groups: as they are
    got = run_trie(spark, rows)
    assert got == trie(rows) and len(got) == 4


def test_registered_trie_has_its_columns(spark):
    got = queries.op12_prefixes(spark, "/root/testdata/sf0.001")
    kinds = dict(got.dtypes)
    assert set(FIELDS) <= set(kinds) and all(kinds[c] == "bigint" for c in FIELDS[:-1])


# --- whitening


def exact(vectors):
    """n, sums, and the covariance as fractions, of the distinct integer vectors."""
    fit = sorted({tuple(math.floor(256 * float(c)) for c in v) for v in vectors})
    n, d = len(fit), len(fit[0])
    sums = [sum(x[k] for x in fit) for k in range(d)]
    y = [[n * x[k] - sums[k] for k in range(d)] for x in fit]
    cov = [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(d)] for i in range(d)]
    return fit, n, sums, cov


def held(spark, vectors, components=4):
    """The operator's rows against the exact ones; returns them."""
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = whitening.whitened(frame, components=components).collect()
    fit, n, sums, cov = exact(vectors)
    by = {(r.vec_id, r.component): r for r in got}
    found = max((r.component for r in got), default=0)
    trace = sum(cov[k][k] for k in range(len(cov)))
    for i, v in enumerate(vectors):
        x = [math.floor(256 * float(c)) for c in v]
        want = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        for k in range(1, found + 1):
            assert by[i, k].deviation == (want if want < 10**38 else None) and by[i, k].n == n and by[i, k].identity_error <= 1e-4
    # the whitened fit list: mean 0, covariance 1, and directions that the covariance maps on themselves
    first = {tuple(math.floor(256 * float(c)) for c in v): i for i, v in enumerate(vectors)}
    w = np.array([[by[first[x], k].whitened for k in range(1, found + 1)] for x in fit]).reshape(len(fit), found)
    if found:
        assert np.abs(w.T @ w / n - np.eye(found)).max() < 1e-6 and np.abs(w.mean(0)).max() < 1e-6
        explained = [by[0, k].explained for k in range(1, found + 1)]
        assert explained == sorted(explained, reverse=True)
        y = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(x, sums, strict=True)] for x in fit])
        for k in (k for k in range(found) if explained[k] > 1e-9):  # beyond that, floats cannot tell
            e = explained[k] * float(trace)
            direction = y.T @ w[:, k] / n / math.sqrt(e)  # V u / e = u
            assert abs(np.linalg.norm(direction) - 1) < 1e-6
    return got


def test_whitening_exact(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 6)) * [3, 2, 1, 0.5, 0.2, 0.1]
    got = held(spark, np.concatenate([v, v[:40], v[:1]]).tolist())
    assert len(got) == 341 * 4
    x = np.floor(256 * v)
    e = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert np.allclose([r.explained for r in got if r.vec_id == 0], (e / e.sum())[:4], rtol=1e-9)


@pytest.mark.parametrize("far", [1e6, 1e12, 1e15])
def test_whitening_far_from_the_origin(spark, far):
    """Where squares of the entries swallow the spread in floats."""
    rng = np.random.default_rng(3)
    v = np.round(rng.normal(size=(200, 5)) * [4, 3, 2, 1, 1] * 256) / 256 * (256 if far > 1e13 else 1) + far
    held(spark, v.tolist())


def test_whitening_of_far_apart_components(spark):
    """Variances over twenty orders of magnitude: each component keeps its digits."""
    rng = np.random.default_rng(4)
    q, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    v = (rng.normal(size=(150, 4)) * [1e11, 1e5, 1e2, 1.0]) @ q
    got = held(spark, v.tolist())
    assert len(got) == 150 * 4


def test_whitening_without_variance_or_rows(spark):
    assert held(spark, [[1.0, 2.0]] * 5) == []
    line = held(spark, [[float(k), 2.0 * k, 0.0] for k in range(9)])
    assert {r.component for r in line} == {1} and all(abs(r.explained - 1) < 1e-12 for r in line)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whitened(none).count() == 0
    square = held(spark, [[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0], [0.0, -1.0]])  # equal eigenvalues
    assert len(square) == 8


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (None, [2.0, 1.0]), (1, [2.0, 1.0]), (2, None), (3, []), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, -inf]), (7, [1.0, 2.0, 3.0]), (8, [-0.0, 0.001])]
    frame = spark.createDataFrame([(*r, "x", 1, 1.0) for r in rows], "vec_id long, embedding array<float>, id string, n int, whitened double")
    got = whitening.whitened(frame).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in got) == sorted((i is None, i or 0, k) for i in (0, 1, 1, 8, None) for k in (1, 2))
    assert {r.n for r in got} == {3}
    equal = {(r.component, r.whitened, r.deviation) for r in got if r.vec_id in (1, None)}
    assert len(equal) == 2


def test_whitening_deviation_beyond_a_long(spark, tmp_path):
    rows = [(i, [float(i) * 1e9, 1.0]) for i in range(50)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op13_whitening(spark, str(tmp_path)).collect()
    assert dict(queries.op13_whitening(spark, str(tmp_path)).dtypes)["deviation"] == "bigint"
    assert all(r.deviation is None or r.deviation >= 0 for r in got) and any(r.deviation is None for r in got)


def test_limbs_put_together():
    rng = random.Random(9)
    for bits in (1, 10, 19, 20, 21, 40, 61, 100, 200):
        values = [rng.randint(-(1 << bits) + 1, (1 << bits) - 1) for _ in range(50)] + [(1 << bits) - 1, 1 - (1 << bits), 0]
        parts = whitening.limbs(np.array(values, object if bits > 61 else np.int64), whitening.limb_count(bits))
        assert max(np.abs(p).max() for p in parts) <= 1 << 20
        assert [sum(int(p[k]) << (whitening.LIMB * i) for i, p in enumerate(parts)) for k in range(len(values))] == values
        for v in values:
            assert sum(x << (32 * k) for k, x in enumerate(whitening.digits(v, 8))) == v
