"""Fill-in-middle, spelling variants and near vectors against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from kinweave.llm import cover_tree, fill_in_middle, spelling
from kinweave.llm.batches import pieces
from kinweave.llm.queries import queries
from pyspark.sql import functions as F


# --- fill in middle ---------------------------------------------------------------------------------

def moved(doc_id, text):
    text = text or ""
    n = len(text)
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    return (n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}")


def test_middles_match_brute_force(spark, docs, corpus):
    extra = [(900 + i, t) for i, t in enumerate(["<P>", "a<S", "x <M> y", "<", "😀" * 40, "<P<S<M", "é", "a\n\nb"] * 6)]
    rows = spark.createDataFrame([(r.doc_id, r.text) for r in corpus] + extra, "doc_id bigint, text string")
    out = fill_in_middle.transform(rows).withColumn("back", fill_in_middle.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((d, *moved(d, t), t or "") for d, t in [(r.doc_id, r.text) for r in corpus] + extra)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in out) == want
    assert {r.form for r in out} == {"plain", "psm", "spm"}


@settings(deadline=None, max_examples=60)
@given(st.lists(st.text(alphabet="ab 1é.\n😀,<", max_size=30), min_size=1, max_size=6), st.data())
def test_cuts_fall_on_units(texts, data):
    piece = next(pieces(pa.array(texts), 1 << 20))
    matrix = fill_in_middle.WaveletMatrix(fill_in_middle.classes(piece.data, piece.bounds))
    first, last = piece.bounds[:-1], piece.bounds[1:]
    for unit, pattern in (("char", r"(?s)."), ("word", r"(?<![^\W_])[^\W_]+"), ("line", r"\n"), ("sentence", r"[.!?]")):
        draws = [np.array(data.draw(st.lists(st.integers(0, 2**32 - 1), min_size=len(texts), max_size=len(texts))), dtype=np.uint64) for _ in range(2)]
        units, low, high = fill_in_middle._cuts(matrix, unit, first, last, draws)
        for i, text in enumerate(texts):
            found = [m.start() if unit in ("char", "word") else m.end() for m in re.finditer(pattern, text.replace("😀", "x") if unit == "word" else text)]
            if unit in ("char", "word"):
                n = max(len(found), 1 if text and unit == "word" else 0)
                at = lambda k: 0 if k == 0 else len(text) if k >= n else found[k]
            else:
                n = len(found) + (bool(text) and (not found or found[-1] < len(text)))
                at = lambda k: 0 if k == 0 else len(text) if k >= n else found[k - 1]
            assert units[i] == n
            ks = sorted(int(d[i]) % (n + 1) for d in draws)
            assert [int(x[i]) - int(first[i]) for x in (low, high)] == [len(text[: at(k)].encode()) for k in ks]


def test_sentinels_must_be_told_apart(docs):
    with pytest.raises(ValueError):
        fill_in_middle.transform(docs, sentinels=("<P>", "<P>x", "<M>"))
    with pytest.raises(ValueError):
        fill_in_middle.transform(docs, unit="page")


def test_words_and_other_sentinels(spark):
    rows = spark.createDataFrame([(i, "one two  three four") for i in range(40)], "doc_id bigint, text string")
    out = fill_in_middle.transform(rows, unit="word", share=100, sentinels=("[p]", "[s]", "[m]")).collect()
    assert {r.n for r in out} == {4} and {r.form for r in out} == {"psm", "spm"}
    for r in out:
        parts = dict(re.findall(r"(?s)\[([psm])\]([^\[]*)", r.output))
        assert parts["p"] + parts["m"] + parts["s"] == "one two  three four"
        assert not re.search(r"\S$", parts["p"]) or parts["p"].endswith("four")


# --- spelling ---------------------------------------------------------------------------------------

def word_table(rows, shortest, fewest, noise):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if noise and h % noise == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= fewest}
    masks = {}
    for w in words:
        for i in range(len(w)):
            masks.setdefault((w[:i], w[i + 1 :], True), []).append(w)
            masks.setdefault((w[:i], w[i + 1 :], False), []).append(w)
        for i in range(len(w) + 1):
            masks.setdefault((w[:i], w[i:], False), []).append(w)
    near = {w: set() for w in words}
    for (_, _, replaced), group in masks.items():
        for a in group:
            near[a] |= {b for b in group if b != a and (len(a) == len(b)) == replaced and abs(len(a) - len(b)) <= 1}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def spelled(corpus):
    base = ["running", "chained", "straße", "ÉCOLE", "naïveté", "little", "aaaaaaa", "bridge", "bridges", "fridge"]
    rows = [(r.doc_id, r.text) for r in corpus]
    for i, w in enumerate(base):
        rows.append((1000 + i, " ".join([w] * 40)))
        for k in range(len(w)):
            for v in (w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "q" + w[k + 1 :]):
                rows.append((2000 + 100 * i + k, f"{v}, {v}; {v} " + (f"{v[1:]} " * 3 if k % 2 else "")))
    return rows + [(5000, "".join(chr(97 + i % 26) for i in range(5000)) + " " + "Z" * 70000)] * 3


@pytest.mark.parametrize("noise, most", [(97, 50_000), (7, 40), (None, 5)])
def test_spelling_matches_brute_force(spark, corpus, monkeypatch, noise, most):
    rows = spelled(corpus)
    monkeypatch.setattr(spelling, "RARE", 1)
    monkeypatch.setattr(spelling.near_pairs, "__defaults__", (spelling.LONGEST, most))
    out = spelling.spelling_variants(spark.createDataFrame(rows, "doc_id bigint, text string"), noise=noise).collect()
    assert {tuple(r) for r in out} == word_table(rows, 5, 3, noise)
    assert len(out) > 200 and any(r.root not in (r.word, r.form) for r in out)


@settings(deadline=None, max_examples=200)
@given(st.lists(st.text(alphabet="abé", min_size=2, max_size=12), min_size=1, max_size=5), st.sets(st.text(alphabet="abé\x01", min_size=2, max_size=4), max_size=40),
       st.sampled_from([5, 4, 3, 2]), st.data())
def test_bounds_hold_for_every_edit(words, grams, longest, data):
    frequent = np.array(sorted(int.from_bytes(g.encode("latin-1"), "big") for g in grams), dtype=np.uint64)
    word, place, code, count, bound = spelling.decomposed(words, frequent, longest)
    i = data.draw(st.integers(0, len(words) - 1))
    w, k, kind = words[i], data.draw(st.integers(0, len(words[i]))), data.draw(st.sampled_from("idr"))
    other = w[:k] + data.draw(st.sampled_from("abé")) + w[k:] if kind == "i" else w[: k] + w[k + 1 :] if kind == "d" else w[:k] + "b" + w[k + 1 :]
    if len(other) < 2:
        return
    _, there, codes, _, _ = spelling.decomposed([other], frequent, longest)
    shift = len(other) - len(w)
    target = Counter(zip(there.tolist(), codes.tolist()))
    own = [(p, c) for x, p, c in zip(word.tolist(), place.tolist(), code.tolist()) if x == i]
    common = sum((p, c) in target if p <= k else (p + shift, c) in target or (p, c) in target for p, c in own)
    assert len(own) == count[i] and common >= bound[i]
    if longest == 2:
        assert bound[i] >= 1


# --- vectors ----------------------------------------------------------------------------------------

def clusters(seed, dims=12):
    r = np.random.default_rng(seed)
    rows = []
    for size, spread in [(1, 0)] * 150 + [(4, 0.02), (30, 0.06), (60, 0.1), (90, 0.001)] + [(120, 0.12)]:
        middle = r.normal(size=dims)
        middle /= np.linalg.norm(middle)
        rows += [(middle + spread * r.normal(size=dims)) * r.uniform(0.1, 9) for _ in range(size)]
    rows += [rows[160].copy() for _ in range(70)] + [3 * rows[5], -rows[5]]
    return [x.astype(np.float32) for x in rows]


def linked(vectors, cosine):
    x = [None if v is None or any(c is None or not np.isfinite(c) for c in v) or not any(v) else np.array(v, dtype=float) for v in vectors]
    n = len(x)
    u = [None if v is None else v / np.linalg.norm(v) for v in x]
    near = np.zeros((n, n), dtype=bool)
    for i in range(n):
        for j in range(n):
            near[i, j] = i != j and u[i] is not None and u[j] is not None and len(u[i]) == len(u[j]) and u[i] @ u[j] >= cosine
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(near)):
        root[find(int(i))] = find(int(j))
    return near.sum(axis=1), [find(i) for i in range(n)]


def expected(ids, vectors, cosine):
    counts, root = linked(vectors, cosine)
    least = {}
    for i, r in zip(ids, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return Counter((i, int(c), least.get(r), i is not None and least[r] == i) for i, c, r in zip(ids, counts, root))


@pytest.mark.parametrize("kind, block", [("float", 64), ("double", 64), ("float", 5000)])
def test_near_vectors_match_brute_force(spark, kind, block):
    vectors = [v.tolist() for v in clusters(3)]
    vectors += [None, [], [0.0] * 12, [1.0, None] + [0.0] * 10, [float("inf")] + [1.0] * 11, [float("nan")] * 12, [1.0, 1.0], [2.0, 2.0], [1.0]]
    ids = list(range(100, 100 + len(vectors)))
    ids[3], ids[200], ids[210] = None, None, ids[211]
    frame = spark.createDataFrame(list(zip(ids, vectors, ["x"] * len(ids))), f"vec_id bigint, embedding array<{kind}>, n_links string")
    out = cover_tree.near_vectors(frame, 0.95, block).collect()
    assert Counter(tuple(r) for r in out) == expected(ids, vectors, 0.95)


@settings(deadline=None, max_examples=25)
@given(st.integers(0, 10_000), st.sampled_from([0.5, 0.8, 0.95, 0.99]), st.booleans())
def test_traversal_finds_every_link(seed, cosine, same):
    rows = clusters(seed, 4)
    parts = [np.array(rows[i::2]) for i in range(2)]
    trees = []
    for p in parts[:1] if same else parts:
        order, nodes = cover_tree.grown(p, np.arange(len(p)), np.sqrt(2 - 2 * cosine))
        assert sorted(order.tolist()) == list(range(len(p)))
        trees.append((cover_tree.Tree(cover_tree.unit_rows(p[order]), order, nodes), p[order]))
    (a, first), (b, second) = trees[0], trees[-1]
    links = cover_tree.traverse(a, a if same else b, cosine)
    x, y = cover_tree.unit_rows(first), cover_tree.unit_rows(second)
    near = x @ y.T >= cosine
    if same:
        np.fill_diagonal(near, False)
        assert (links.counts == near.sum(axis=1)).all()
    else:
        assert (links.counts == np.concatenate([near.sum(axis=1), near.sum(axis=0)])).all()
    u, v = np.nonzero(near)
    assert (links.label[u] == links.label[v + (0 if same else len(x))]).all()


# --- all three --------------------------------------------------------------------------------------

def test_empty_tables_and_extra_columns(spark, none, wide, corpus):
    assert fill_in_middle.transform(none).count() == 0
    assert spelling.spelling_variants(none).count() == 0
    assert cover_tree.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    out = fill_in_middle.transform(wide, keep=["n", "size", "doc_id"])
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "size"] and out.count() == len(corpus)
    assert dict(out.dtypes)["n"] == "bigint"
    assert spelling.spelling_variants(wide).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_registered():
    assert {"op11_fill_in_middle", "op12_spelling_variants", "op13_cover_tree"} <= set(queries())
