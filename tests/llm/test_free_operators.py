"""Metric join, token codes, mixing, classifier, languages and substring removal against plain Python."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kinweave.llm import components, metric_join, mixing, ordinal_quality, rank_profiles, suffix_dedup, token_codes
from kinweave.llm.batches import pieces, split

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_word_batches_agree_with_the_pattern():
    texts = ["a b", None, "", "  x\t\ny ", "ünï  cödé", "漢字 a", "a"]
    for limit in (1, 5, 1000):
        got = []
        for piece in pieces(pa.array(texts), limit):
            w = split(piece)
            ends = np.cumsum(w.per_row)
            raw = piece.data.tobytes()
            for i in range(piece.last - piece.first):
                own = slice(ends[i] - w.per_row[i], ends[i])
                got.append([raw[a:b].decode() for a, b in zip(w.starts[own], w.ends[own])])
        assert got == [words(t) for t in texts]
    same = [h for p in pieces(pa.array(["word x", "y word", "Word"])) for h in split(p, lower=True).hashes.tolist()]
    assert same[0] == same[3] == same[4] and len(set(same)) == 3


def shingle_links(corpus, width, percent):
    sets = []
    for r in corpus:
        w = words((r.text or "").translate(LOWER))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    parent = list(range(len(corpus)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = Counter()
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and corpus[i].doc_id is not None and corpus[j].doc_id is not None and 100 * len(a & b) >= percent * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(corpus):
        if r.doc_id is not None:
            least[find(i)] = min(least.get(find(i), r.doc_id), r.doc_id)
    return Counter((r.doc_id, len(sets[i]), least.get(find(i)) if r.doc_id is not None else None, links[i]) for i, r in enumerate(corpus))


@pytest.mark.parametrize("width, percent, leaf", [(3, 90, 256), (5, 80, 256), (3, 90, 4)])
def test_metric_join_matches_brute_force(docs, corpus, monkeypatch, width, percent, leaf):
    monkeypatch.setattr(metric_join, "LEAF", leaf)  # 4: families are split into cells and blocks
    got = metric_join.similar_sets(docs, width, percent)
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got.collect()) == shingle_links(corpus, width, percent)


def chain(name, classes, first_id):
    """Windows of 102 words that move on by one word: each text is close to some texts before and after it."""
    from pyspark.sql import Row

    return [Row(doc_id=first_id + i, text=" ".join(f"{name}{k}" for k in range(i, i + 102))) for i in range(classes)]


def joined(spark, rows, percent):
    got = metric_join.similar_sets(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, percent)
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in got.collect())


@pytest.mark.parametrize("percent", [90, 80])
def test_metric_join_keeps_links_across_cells(spark, percent):
    rows = chain("w", 300, 0)  # one family of more than LEAF classes
    assert len(rows) > metric_join.LEAF
    assert joined(spark, rows, percent) == shingle_links(rows, 3, percent)


def test_cells_of_neighbouring_families_differ():
    sets = [np.arange(i, i + 100, dtype="<u8") for i in range(0, 80, 10)]
    members = [{"parent": f, "region": f, "cid": i, "n": 100, "size": 1, "keys": x.tobytes(), "homes": [], "path": []}
               for f in range(64) for i, x in enumerate(sets)]
    kinds = {"parent": pa.int64(), "region": pa.int64(), "cid": pa.int64(), "n": pa.int64(), "size": pa.int64(), "keys": pa.binary(),
             "homes": pa.list_(pa.int32()), "path": pa.list_(pa.int32())}
    batch = pa.RecordBatch.from_pylist(members, schema=pa.schema(list(kinds.items())))
    made = [r for b in metric_join._cells({f: sets for f in range(64)}, 0.2)([batch]) for r in b.to_pylist()]
    assert len({r["region"] for r in made}) == len({(r["parent"], r["path"][0]) for r in made}) == 64 * len(sets)


def test_metric_join_of_two_large_families(spark):
    rows = chain("v", 300, 0) + chain("w", 300, 1000)
    assert joined(spark, rows, 90) == shingle_links(rows, 3, 90)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 102), (102, 101), (7, 7), (200, 199)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "x bigint, y bigint")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100, 199: 199, 200: 199}


def test_token_codes_round_trip(spark, docs, corpus, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_codes, "SEGMENT", 4000)
    model = Tokenizer.from_file(TOKENIZER)
    path = token_codes.shared_folder(spark, "codes")
    token_codes.write_tokens(docs, TOKENIZER, path)
    got = token_codes.read_documents(spark, path).collect()
    expected = Counter()
    for r in corpus:
        ids = np.array([*model.encode(r.text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        expected[(r.doc_id, len(ids), token_codes.zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == expected
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered if r.doc_id is not None] == sorted(r.doc_id for r in corpus if r.doc_id is not None)
    at = 0
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    asked = [0, 1, at - 1, at // 2, at // 3]
    found = {r.position: r.token for r in token_codes.tokens_at(spark, path, spark.createDataFrame([(i,) for i in asked], "position bigint")).collect()}
    text = {r.doc_id: r.text for r in corpus if r.doc_id is not None}
    for position in asked:
        r = next(r for r in ordered if r.start <= position < r.start + r.n_tokens)
        if r.doc_id not in (None, 1):
            ids = [*model.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 1]
            assert found[position] == ids[position - r.start]
    assert set(found) == set(asked)


def test_marks_after_other_characters_are_encoded_whole():
    from tokenizers import Tokenizer

    ends = ["”", "’", "…", "😀", "❤️", "हि", "में", "e\u0301", "x\u0327", "é", "я", "漢", "€", "½", "٣", "a", "7", "\u00a0", "«", "™", "a.”", "!…", "it's", "x-"]
    marks = [".", "!", ",", "?!", "...", "!!!!", "?!?!?", "'", "')", "\"", "=", "<|", "'s", ".”", "’."]
    texts = [f"{a}{b} word" for a in ends for b in marks] + [f"word{a}{b}" for a in ends for b in marks]
    model, encoder = Tokenizer.from_file(TOKENIZER), token_codes.WordEncoder(TOKENIZER)
    for limit in (40, 1 << 20):
        for piece in pieces(pa.array(texts), limit):
            ids, counts = encoder.encode(piece)
            got = np.split(ids, np.cumsum(counts)[:-1])
            for text, own in zip(texts[piece.first : piece.last], got):
                assert own.tolist() == model.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("top", [200, 60_000, 2**32 - 1])
def test_levels_give_any_token(top):
    ids = np.random.default_rng(top).integers(0, top, 3001, dtype=np.uint64).astype(np.uint32)
    levels = token_codes.encode_levels(ids)
    assert (token_codes.decode_levels(levels) == ids).all()
    at = np.random.default_rng(1).permutation(len(ids))
    assert (token_codes.access(levels, at) == ids[at]).all()


def test_mix_meets_targets(docs, corpus, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    monkeypatch.setattr(mixing, "FAN", 2)  # several levels of the tree
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    key = lambda rs: Counter((r.doc_id, r.source, r.size, r.taken) for r in rs)
    assert key(rows) == key(again)
    sizes = defaultdict(int)
    for r in corpus:
        sizes[r.source] += len(words(r.text))
    total = sum(sizes.values())
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped = set()
    while True:
        share = (total - sum(3 * sizes[s] for s in capped)) / max(1, sum(weight[s] for s in order if s not in capped))
        new = {s for s in order if s not in capped and share * weight[s] > 3 * sizes[s]}
        if not new:
            break
        capped |= new
    taken = defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(min(3 * sizes[r.source], share * weight[r.source]))
        assert r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    largest = {s: max(len(words(r.text)) for r in corpus if r.source == s) for s in order}
    assert all(abs(taken[s] - min(3 * sizes[s], share * weight[s])) <= largest[s] for s in order)
    assert sum(r.size for r in rows) == total and len(rows) == len(corpus)


def test_classifier_learns_grades(spark):
    good, bad = "plain prose about rivers and hills", "vile nasty slur"
    rows = []
    for i in range(300):
        text = f"{good} number{i % 37} town{i % 11} " * 3
        rows.append((i, text + (f" {bad}" if i % 3 == 0 else " ZZZ!! QQQ!! XXX!!" if i % 3 == 1 else "")))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 1), int(i % 3 == 0)) for i in range(200)] + [(None, 1, 0), (3, None, None)],
                                   "doc_id bigint, quality int, toxic int")
    model = ordinal_quality.quality_model(docs, labels)
    assert model.thresholds[0] <= model.thresholds[1]
    got = {r.doc_id: r for r in ordinal_quality.grade_documents(docs, model, ["doc_id"]).collect()}
    held = [got[i] for i in range(200, 300)]
    assert all(r.kept == (r.doc_id % 3 == 2) for r in held)
    mean = [np.mean([r.expected_grade for r in held if r.doc_id % 3 == k]) for k in (0, 1, 2)]
    assert mean[0] < mean[1] < mean[2]


def test_toxic_labels_need_no_quality(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(0, None, 1), (1, None, 0), (2, None, None), (3, 0, 0), (4, 1, None), (5, 1, 0), (5, None, 1), (None, None, 1)],
                                   "doc_id bigint, quality int, toxic int")
    assert {r.doc_id: r.grade for r in ordinal_quality.ratings(docs, labels).collect()} == {0: 0, 3: 1, 4: 2, 5: 0}


def test_classifier_without_ratings_keeps_all(spark, docs, none, corpus):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    model = ordinal_quality.quality_model(docs, labels)
    assert ordinal_quality.grade_documents(docs, model, ["doc_id", "text"]).where("kept").count() == len(corpus)
    assert ordinal_quality.grade_documents(none, model, ["doc_id"]).count() == 0


def test_languages_follow_the_definition(spark):
    stems = {"aa": ["banana", "papaya", "mango"], "bb": ["quick", "zephyr", "jinx"], "cc": ["øre", "århus", "smør"]}
    rows = [(i, " ".join(stems[k][(i + j) % 3] for j in range(1 + i % 9)), k) for i, k in enumerate(["aa", "bb", "cc"] * 40)]
    rows += [(900, None, "aa"), (901, "12 34 !!", "bb"), (902, "", "cc"), (903, "banana", None), (None, "mango papaya", "aa")]
    got = {r.doc_id: r for r in rank_profiles.predict_languages(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:120])
    assert [got[i].lang_pred for i in (900, 901, 902, 903, None)] == ["und", "und", "und", "aa", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    assert rank_profiles.ranked(rank_profiles.grams("ab ab")).tolist()[:1] != [] and len(set(rank_profiles.grams("ab").tolist())) == 7


def test_languages_match_brute_force(spark):
    """Out-of-place distance over ranked n-grams, counted with plain dictionaries."""
    texts = [("aa", "mango papaya banana mango"), ("aa", "papaya mango"), ("bb", "zephyr jinx quick quick"), ("bb", "jinx jinx"), ("cc", "øre smør århus øre")]
    asked = ["mango quick", "øre papaya", "zephyr", "smør smør banana", "q", "jinx århus mango", "x1y 22 ø"]
    learn = spark.createDataFrame([(t, k) for k, t in texts], "text string, lang string")
    profiles = rank_profiles.language_profiles(learn, 40)
    got = [(r.text, r.lang_pred, r.score) for r in rank_profiles.identify(
        spark.createDataFrame([(t, "z") for t in asked], "text string, score string"), profiles, ["text", "score"], 40).collect()]

    def order(counts):
        return [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:40]

    known = {}
    for lang in {k for k, _ in texts}:
        counts = Counter()
        for k, t in texts:
            counts.update(rank_profiles.grams(t).tolist() if k == lang else [])
        known[lang] = {c: i for i, c in enumerate(order(counts))}
    for text, lang, score in got:
        own = order(Counter(rank_profiles.grams(text).tolist()))
        away = {k: sum(abs(p[c] - i) if c in p else 40 for i, c in enumerate(own)) for k, p in known.items()}
        best = min(sorted(away), key=away.get)
        assert lang == best and score == pytest.approx(1 - away[best] / (40 * len(own)))
    assert len(got) == len(asked)


def test_classifier_gradient_is_the_derivative():
    """Against differences of the log likelihood of the cumulative-link model, written out."""
    rng = np.random.default_rng(2)
    score, grade, thresholds = rng.normal(size=40), rng.integers(0, 3, 40), np.array([-0.7, 0.4])

    def likelihood(score, thresholds):
        cut = 1 / (1 + np.exp(-(score[:, None] - thresholds[None, :])))
        tail = np.hstack([np.ones((len(score), 1)), cut, np.zeros((len(score), 1))])
        at = np.arange(len(score))
        return np.log(tail[at, grade] - tail[at, grade + 1])

    by_score, by_threshold = ordinal_quality._gradients(score, grade, thresholds)
    step = 1e-6
    assert by_score == pytest.approx((likelihood(score + step, thresholds) - likelihood(score - step, thresholds)) / (2 * step), abs=1e-6)
    for k in range(2):
        move = np.eye(2)[k] * step
        difference = (likelihood(score, thresholds + move) - likelihood(score, thresholds - move)).sum() / (2 * step)
        assert by_threshold[k] == pytest.approx(difference, abs=1e-5)


def removed(corpus, width):
    rows = sorted((r for r in corpus if r.doc_id is not None), key=lambda r: r.doc_id)
    first, out = {}, Counter()
    for r in rows:
        w = words(r.text)
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), r.doc_id)
    for r in corpus:
        w = words(r.text)
        keep = [True] * len(w)
        for i in range(len(w) - width + 1):
            if r.doc_id is not None and first[tuple(w[i : i + width])] < r.doc_id:
                keep[i : i + width] = [False] * width
        kept = " ".join(x for x, k in zip(w, keep) if k)
        out[(r.doc_id, len(w), len(w) - sum(keep), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("shard", [200_000, 30])
def test_repeats_match_brute_force(docs, corpus, shard):
    changed, untouched = suffix_dedup.remove_repeats(docs, 13, shard)  # 30: owners and anchors beyond a shard
    rows = changed.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("h")).unionByName(
        untouched.select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("kept_sha256").alias("h")))
    assert Counter(tuple(r) for r in rows.collect()) == removed(corpus, 13)


@pytest.mark.parametrize("letters, width", [(2, 3), (3, 5), (4, 4), (9, 5)])
def test_automaton_matches_windows_of_smaller_documents(letters, width):
    rng = np.random.default_rng(letters * 10 + width)
    for _ in range(40):
        texts = [rng.integers(0, letters, rng.integers(3, 60)).tolist() for _ in range(20)]
        texts += [[x if rng.random() < 0.9 else 99 for x in t] for t in texts]  # near copies
        automaton, seen = suffix_dedup.SuffixAutomaton(width), {}
        for doc, text in enumerate(texts):
            windows = [tuple(text[i : i + width]) for i in range(len(text) - width + 1)]
            assert automaton.matches(text, doc).tolist() == [seen.get(w, doc) < doc for w in windows]
            for w in windows:
                seen.setdefault(w, doc)
            automaton.add(text, doc)


def test_empty_tables(spark, none):
    assert metric_join.similar_sets(none, 3, 90).count() == 0
    assert mixing.mix(none).count() == 0
    assert rank_profiles.predict_languages(none).count() == 0
    changed, untouched = suffix_dedup.remove_repeats(none)
    assert changed.count() == untouched.count() == 0
    path = token_codes.shared_folder(spark, "codes")
    token_codes.write_tokens(none, TOKENIZER, path)
    assert token_codes.read_documents(spark, path).count() == 0


def test_extra_columns_do_not_clash(spark, wide, corpus):
    assert metric_join.similar_sets(wide, 3, 90, keep=["lang"]).count() == len(corpus)
    assert mixing.mix(wide).count() == len(corpus)
    assert rank_profiles.predict_languages(wide).count() == len(corpus)
    changed, untouched = suffix_dedup.remove_repeats(wide)
    assert changed.count() + untouched.count() == len(corpus)
