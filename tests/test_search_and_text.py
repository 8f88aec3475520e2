import json

import pytest
from pyspark.sql import functions as F

from kinweave import Catalog
from kinweave.functions import labels, text
from kinweave.operators import search
from kinweave.plans.lineage import cut


def _column(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.o for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_native_and_batch_normalisation_agree(spark):
    latin = [chr(c) for c in range(1, 256)]
    samples = latin + [a + b + c for a in "aZ9ß" for b in "BÉé-" for c in "xY1"] + [
        "CustomerID", "HTTPServerName", "order2Cash", "  spaced__out--Text ", "Straße ÜBER", "ﬁne ＡＢＣ", "日本語 テスト", "éa", "Ⅳ x²", "ΣΑΣ", "",
    ]
    assert _column(spark, samples, text.normalize_term) == [text.normalize_text(s) for s in samples]


def test_terms_and_placeholders(spark):
    assert _column(spark, ["a b a", "one", ""], text.index_terms) == [["a", "b", "a b a"], ["one"], []]
    values = ["N/A", "To Be Determined", "-1.#IND", "unknown customers", "TBD!"]
    got = _column(spark, values, lambda v: text.is_placeholder(text.normalize_term(v)))
    assert got == [True, True, True, False, True]


def test_json_strings(spark):
    values = ['{"a":"x","b":"y [1]"}', '{"a":{"b":["p",{"c":"q"}],"n":1},"t":true,"z":null}', '["s",["t"]]', None, "{}"]
    assert _column(spark, values, text.json_strings) == [
        ["a", "x", "b", "y [1]"], ["a", "b", "p", "c", "q", "n", "t", "z"], ["s", "t"], [], [],
    ]


def test_edge_labels_round_trip(spark):
    ends = [("n1", ["a"], "n2", ["b", "c"]), ('t"x', ["a,b", "d"], "a[b]", ["e->f"]), ("café", ["ü"], "p.q", ["z"]), ("tab\there", ["a]"], "x", ["y"])]
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "i int, a string, ac array<string>, b string, bc array<string>")
    labelled = df.select("i", labels.edge_label(F.col("a"), F.col("ac"), F.col("b"), F.col("bc")).alias("label"))
    got = {r.i: (r.label, tuple(r.s)) for r in labelled.select("i", "label", labels.split_edge_label(F.col("label")).alias("s")).collect()}
    assert {i: s for i, (_, s) in got.items()} == dict(enumerate(ends))
    assert got[0][0] == "n1[a] -> n2[b,c]"
    assert got[1][0] == '"t\\"x"["a,b",d] -> "a[b]"["e->f"]'
    bad = ["", "a[b]", "a[b] -> c[d] ", "a[b] => c[d]", 'x["y] -> c[d]', "a[b]->c[d]", "a[b] -> c[d"]
    assert _column(spark, bad, labels.split_edge_label) == [None] * len(bad)


def plain_search(subjects, query, limit):
    """Subjects: (kind, key, ord, label, [(field, value)]). The rules written out one value at a time."""
    n = text.normalize_text(query)
    found = {}
    for kind, key, order, label, values in subjects:
        idx = 0
        for field, value in values:
            v = text.normalize_text(value)
            if not v:
                continue
            terms = {v, *v.split()}
            options = [(0, n)] if n in terms else []
            options += [(1, t) for t in terms if t.startswith(n) and t != n]
            words, have = n.split(), v.split()
            if len(words) > 1 and (kind, field) in search._WORD_FIELDS and all(any(h.startswith(w) for h in have) for w in words):
                runs = [have[i:i + len(words)] for i in range(len(have) - len(words) + 1)
                        if all(h.startswith(w) for h, w in zip(have[i:], words))]
                options.append((2, " ".join(runs[0])) if runs else (3, " ".join(next(h for h in have if h.startswith(w)) for w in words)))
            if options and n:
                found.setdefault((kind, key, order, text.normalize_text(label)), []).append((min(options), search.FIELDS.index(field), idx, value))
            idx += 1
    result = {}
    for kind in search.KINDS:
        ranked = sorted((min(m)[0][0], label, order or 0, key, sorted((o[0], f, i, o[1], v) for o, f, i, v in m))
                        for (k, key, order, label), m in found.items() if k == kind)
        for place, (_, _, _, key, matches) in enumerate(ranked[:limit], 1):
            for j, (rank, _, _, term, value) in enumerate(matches, 1):
                result[(kind, key, place, j)] = (search.MATCH_TYPES[rank], term, value, len(ranked))
    return result


@pytest.fixture(scope="module")
def library(spark):
    identities = [(f"id_{i}", n, d, s) for i, (n, d, s) in enumerate([
        ("Customer Account", "tbd", ["client"]), ("Account Holder", "Holds an account", []), ("AccountCustomer", "N/A", ["customer account"]),
        ("Loan", "Money lent to a customer", ["credit", "customerLoan"]), ("Ünïcode Straße", "", []),
    ])]
    datasets = [(f"ds.{i}", i, (q, d, "none", [], [t]), ("sqlite", f"/srv/{d}.db", {"team": t}, json.dumps({"k": d, "deep": {"x": [q]}})), None)
                for i, (q, d, t) in enumerate([("sales.main.customer_account", "customers", "core"), ("sales.account.by_customer", "accounts", "core"), ("hr.people", "People", "hr")])]
    columns = [("ds.0", i, n, d, v, []) for i, (n, d, v) in enumerate([("customer_id", "the customer", "todo"), ("acct", "account number", ""), ("zip", "", "")])]
    definitions = [("ds.0", 0, "id_0", ["customer_id"], "complete", True, True, True, ["upper(customer_id)"], '{"note":"customer key"}', ""),
                   ("ds.1", 0, "id_0", ["acct"], "partial", None, True, None, [], None, "")]
    stated = [("id_0", "id_3", "1:many", "always", "optional", ["A customer takes loans", "unknown"])]
    from kinweave import catalog as c
    cat = Catalog(
        spark, identities=spark.createDataFrame(identities, c.IDENTITIES), columns=spark.createDataFrame(columns, c.COLUMNS),
        datasets=spark.createDataFrame(datasets, "node_id string, pos int, descriptor struct<qualified_name: string, display_name: string, description: string, synonyms: array<string>, tags: array<string>>, "
                                       "accessor struct<kind: string, endpoint: string, labels: map<string,string>, properties: string>, grain string").drop("grain"),
        definitions=spark.createDataFrame(definitions, c.DEFINITIONS), entity_relationships=spark.createDataFrame(stated, c.ENTITY_RELATIONSHIPS),
    )
    subjects = [("identity", k, None, n, [("stable_id", k), ("canonical_name", n)] + ([("description", d)] if d not in ("tbd", "N/A") else []) + [("synonym", s) for s in syn]) for k, n, d, syn in identities]
    for node, _, (q, d, _, _, tags), (kind, endpoint, lab, props), _ in datasets:
        accessor = [kind, endpoint, *[x for kv in lab.items() for x in kv], *text.string_leaves(json.loads(props))]
        subjects.append(("dataset", node, None, d, [("stable_id", node), ("canonical_name", d), ("qualified_name", q)] + [("tag", t) for t in tags] + [("accessor", a) for a in accessor]))
    for i, (n, d, v) in enumerate([("acct", "account number", ""), ("customer_id", "the customer", ""), ("zip", "", "")], 1):
        subjects.append(("column", f"C{i}", i, n, [("column", n), ("description", d)]))
    subjects.append(("entity_definition", "D1", 1, "upper(customer_id)", [("stable_id", "id_0"), ("dataset_columns", "customer_id"), ("entity_expression", "upper(customer_id)"), ("entity_metadata", "note"), ("entity_metadata", "customer key")]))
    subjects.append(("entity_definition", "D2", 2, "id_0", [("stable_id", "id_0"), ("dataset_columns", "acct")]))
    subjects.append(("entity_relationship", "X1", 1, "id_0 id_3", [("description", "A customer takes loans")]))
    return cat, subjects


def test_search_follows_the_rules(spark, library):
    cat, subjects = library
    asked = ["customer", "customer account", "account customer", "cust acc", "ACCOUNT", "acc", "sales customer", "id 0", "--", "strasse", "x", "customer key", "the customer", "main cust"]
    queries = spark.createDataFrame([(q, q) for q in asked], "query_id string, query string")
    values = cut(search.corpus(cat))
    for limit in (1, 50):
        rows = search.search(cat, queries, limit, values=values).collect()
        for q in asked:
            got = {(r.kind, r.key, r["rank"], r.match_rank): (r.match_type, r.matched_term, r.matched_value, r.total) for r in rows if r.query_id == q}
            assert got == plain_search(subjects, q, limit), q
        assert all(r.truncated == (r.total > limit) for r in rows)
    assert {r.match_field for r in rows if r.kind == "dataset"} <= {"node_id", "display_name", "qualified_name", "tag", "accessor"}


def test_values_are_numbered_in_their_row_and_texts_read_last(spark, library, monkeypatch):
    cat, subjects = library
    plan = search.corpus(cat, ["identity", "dataset"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    kept = []
    monkeypatch.setattr(search, "stored", lambda df: kept.append(df.columns) or cut(df))
    queries = spark.createDataFrame([("q", "main cust")], "query_id string, query string")
    rows = search.search(cat, queries, 50).collect()
    assert {(r.kind, r.key, r["rank"], r.match_rank): (r.match_type, r.matched_term, r.matched_value, r.total) for r in rows} == plain_search(subjects, "main cust", 50)
    assert kept[-1] == ["query_id", "kind", "key", "value_idx", "rank", "ord", "words"]  # no value or label for each match


def test_prefixes_are_intervals_of_the_vocabulary(spark, monkeypatch):
    monkeypatch.setattr(search, "TERM_BLOCK", 2)
    terms = ["a", "ab", "abc", "abd", "b", "ba", "été", "éta", "z", "zz", "zzz", "a b", "a bc", "日本", "日本語"]
    words = ["a", "ab", "abc", "c", "zz", "é", "日", "a b", "zzzz", "b"]
    got = search.matched_terms(
        spark.createDataFrame([(t,) for t in terms * 2], "term string"), spark.createDataFrame([(w,) for w in words * 2], "word string")).collect()
    assert sorted(map(tuple, got)) == sorted((w, t) for w in words for t in terms if t.startswith(w))
    nothing = spark.createDataFrame([], "word string")
    assert search.matched_terms(spark.createDataFrame([("a",)], "term string"), nothing).count() == 0


def test_subject_rows_and_postings(spark, library, tmp_path):
    cat, _ = library
    unknown = {r.key: r.unknown_fields for r in search.subject_rows(cat, "entity_definition").collect()}
    assert unknown == {"D1": [], "D2": ["conforms", "unique"]}
    assert {r.key: r.endpoints for r in search.subject_rows(cat, "entity_relationship").collect()} == {"X1": ["id_0", "id_3"]}
    assert search.subject_rows(cat, "dataset").first().unknown_fields == ["grain"]
    postings = search.build_postings(search.corpus(cat, ["column"]))
    search.write_postings(postings, str(tmp_path / "postings"))
    kept = spark.read.parquet(str(tmp_path / "postings")).where(F.col("term").startswith("cust"))
    assert {r.term for r in kept.collect()} == {"customer", "customer id"}
    with pytest.raises(ValueError):
        search.subjects(cat, ["nothing"])
