"""Benchmark decontamination with a distributed positional inverted index.

Documents are cut into tokens with positions. Of each test phrase only the rarest terms are looked
up: document counts of the test vocabulary decide which. The postings of these terms are stored; a
posting names document, term and position. A list is adjusted by the term's offset in the phrase, so
lists that agree on (document, start) intersect to candidate starts. The postings of the rarest term
keep the words around them, against which a candidate is compared word by word.
Looser matches ask that all terms start within ``slack`` words of one another, whichever is looked up first;
terms that no document holds are then not asked for.

Test terms are broadcast in portions of a checked size; more terms only mean more passes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from kinweave.llm.common import lower_ascii, small
from kinweave.plans.lineage import cut

#: What separates words, after A-Z became a-z (fixed pattern).
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PORTION = 300_000
RAREST = 3
KEY = ["doc_id", "text_key"]


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def phrases(items: DataFrame, width: int) -> DataFrame:
    """(item, phrase): every ``width``-word window of the items; a shorter item is one phrase."""
    size = F.size("words")
    window = F.transform(
        F.sequence(F.lit(0), F.greatest(size - width, F.lit(0))), lambda i: F.slice(F.col("words"), i + 1, width)
    )
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), tokens(F.col("text")).alias("words"))
    return rows.where(size > 0).select("item", F.explode(window).alias("phrase")).distinct()


def _portions(terms: DataFrame) -> list[DataFrame]:
    n = max(1, -(-terms.count() // PORTION))
    return [F.broadcast(terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == k)) for k in range(n)]


def _exploded(docs: DataFrame) -> DataFrame:
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), tokens(F.col("text")).alias("words"))
    return keyed.select(*KEY, "words", F.posexplode("words").alias("pos", "term"))


def term_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, n) over all tokens of ``docs``, for terms of ``vocabulary`` that occur."""
    seen = docs.select(F.explode(tokens(F.col("text"))).alias("term"))
    parts = [seen.join(p, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n")) for p in _portions(vocabulary)]
    return reduce(DataFrame.unionByName, parts)


def lookup_plan(wanted: DataFrame, counts: DataFrame, rarest: int, absent: bool = False) -> DataFrame:
    """(phrase, terms, all): the ``rarest`` terms of each phrase, and all of them, rarest first, with their offsets.

    A phrase with a term that no document holds has no row, unless ``absent``: then such terms are left out.
    """
    each = wanted.select("phrase").distinct().select("phrase", F.posexplode("phrase").alias("offset", "term"))
    found = each.join(counts, "term").groupBy("phrase").agg(
        F.sort_array(F.collect_list(F.struct("n", "term", "offset"))).alias("all"))  # at most one per phrase word
    if not absent:
        found = found.where(F.size("all") == F.size("phrase"))
    return found.select("phrase", F.slice("all", 1, rarest).alias("terms"), "all")


def postings(docs: DataFrame, terms: DataFrame, around: int) -> DataFrame:
    """(doc_id, text_key, term, pos, near): where ``terms`` (term, main) occur.

    ``near`` holds the words from ``around`` before to ``around`` after, for main terms only.
    """
    low = F.greatest(F.col("pos") - around, F.lit(0))
    near = F.when(F.col("main"), F.slice(F.col("words"), low + 1, F.col("pos") - low + around + 1))
    parts = [_exploded(docs).join(p, "term").select(*KEY, "term", "pos", near.alias("near")) for p in _portions(terms)]
    return reduce(DataFrame.unionByName, parts).dropDuplicates([*KEY, "term", "pos"])


def _loose_starts(found: DataFrame, around: int, slack: int) -> DataFrame:
    """Starts s such that every term of the phrase stands at s + its offset or up to ``slack`` words later.

    ``found`` has a row for each place of a phrase's first term; ``places`` are those of all terms from s on.
    """
    first = F.greatest(F.col("pos") - around, F.lit(0))

    def places(start: Column) -> Column:
        return F.transform("all", lambda t: F.filter(
            F.sequence(start + t["offset"], start + t["offset"] + slack),
            lambda p: F.coalesce((p >= first) & (F.get("near", p - first) == t["term"]), F.lit(False))))

    starts = F.transform(F.sequence(F.col("start") - slack, F.col("start")), lambda s: F.struct(s.alias("start"), places(s).alias("places")))
    held = F.filter(starts, lambda s: F.forall(s["places"], lambda p: F.size(p) > 0))
    return found.select(*KEY, "phrase", F.explode(held).alias("s")).select(
        *KEY, "phrase", "s.start", F.array_distinct(F.flatten("s.places")).alias("places")).distinct()


def phrase_matches(docs: DataFrame, wanted: DataFrame, width: int, rarest: int = RAREST, slack: int = 0) -> DataFrame:
    """(doc_id, text_key, phrase, start): occurrences of the phrases of ``wanted``.

    With ``slack`` 0 these are exact. Otherwise a match at ``start`` has every term of the phrase at start +
    its offset or up to ``slack`` words later: the starts that the terms give differ by ``slack`` at most,
    whichever is looked up first. Terms that no document holds are not asked for, and a phrase of nothing
    else has no match. ``start`` may lie before the text; ``places`` lists the positions of the terms.
    """
    vocabulary = cut(wanted.select(F.explode("phrase").alias("term")).distinct())
    counts = cut(term_counts(docs, vocabulary))
    plan = cut(lookup_plan(wanted, counts, rarest, slack > 0))
    asked = plan.select(F.posexplode("terms").alias("rank", "t")).groupBy(F.col("t.term").alias("term")).agg(
        F.max(F.col("rank") == 0).alias("main"))
    index = cut(postings(docs, cut(asked), width + slack))

    lead = plan.select("phrase", "terms", *(["all"] if slack else []), F.col("terms")[0]["term"].alias("term"), F.col("terms")[0]["offset"].alias("offset"))
    found = index.join(small(lead, PORTION), "term").withColumn("start", F.col("pos") - F.col("offset"))
    if not slack:
        found = found.where("start >= 0")
    for k in range(1, rarest):
        other, place = F.get("terms", F.lit(k)), F.col("start") + F.get("terms", F.lit(k))["offset"]
        step = found.where(F.size("terms") > k).withColumns({"other": other["term"], "place": place})
        lists = index.select(F.col("doc_id").alias("d"), F.col("text_key").alias("t"), F.col("term").alias("other"), F.col("pos").alias("there"))
        same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t"))
        if slack:
            lists = lists.withColumn("cell", F.floor(F.col("there") / slack))
            step = step.withColumn("cell", F.explode(F.sequence(F.floor((F.col("place") - slack) / slack), F.floor((F.col("place") + slack) / slack))))
            hit = step.join(lists, [step["other"] == lists["other"], step["cell"] == lists["cell"], same, F.abs(F.col("there") - F.col("place")) <= slack], "left_semi").select(*found.columns).distinct()
        else:
            hit = step.join(lists, [step["other"] == lists["other"], step["place"] == lists["there"], same], "left_semi").select(*found.columns)
        found = hit.unionByName(found.where(F.size("terms") <= k))
    if slack:
        return _loose_starts(found, width + slack, slack)
    first = F.greatest(F.col("pos") - width, F.lit(0))
    found = found.where(F.slice("near", F.col("start") - first + 1, F.size("phrase")) == F.col("phrase"))
    return found.select(*KEY, "phrase", "start")


def contamination(docs: DataFrame, items: DataFrame, width: int = 13, keep: list[str] | None = None, slack: int = 0) -> DataFrame:
    """Hit words and items of every document: n_words, n_hit, items, n_items, contaminated.

    With ``slack`` a word is hit if it is a term of a loose match, see ``phrase_matches``.

    NULL and empty texts have no words and are clean; items without words match nothing, and an item
    without an id is named by the empty string. Repeated rows and equal texts each get their own
    result. ``keep`` names further columns of ``docs`` to carry along.
    """
    wanted = cut(phrases(items, width))
    hits = phrase_matches(docs, wanted, width, slack=slack)
    covered = F.size(F.array_distinct(F.flatten(F.collect_set("places") if slack else F.transform(
        F.collect_set(F.struct("start", F.size("phrase").alias("n"))),
        lambda s: F.sequence(s["start"], s["start"] + s["n"] - 1)))))
    hits = cut(hits)
    words_hit = hits.groupBy(*KEY).agg(covered.cast("bigint").alias("n_hit"))
    ids = hits.join(wanted, "phrase").groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias("items"))
    found = words_hit.alias("a").join(
        ids.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_key") == F.col("b.text_key"))
    ).select(F.col("a.doc_id").alias("_d"), F.col("a.text_key").alias("_t"), "n_hit", "items")
    rows = docs.select(
        "doc_id", F.xxhash64("text").alias("_key"), F.size(tokens(F.col("text"))).cast("bigint").alias("n_words"),
        *[c for c in keep or [] if c != "doc_id"])
    joined = rows.join(small(cut(found), PORTION), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_t")), "left")
    hit = F.coalesce("n_hit", F.lit(0))
    return joined.drop("_key", "_d", "_t").withColumns({
        "n_hit": hit, "items": F.coalesce("items", F.array().cast("array<string>")),
        "contaminated": (hit > 0) & (20 * hit >= F.col("n_words")),
    }).withColumn("n_items", F.size("items").cast("bigint"))
