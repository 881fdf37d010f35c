"""Exact dedup, lexical search and vector codes against brute force, on odd rows and at their borders."""

from __future__ import annotations

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from montage.llm import exact_dedup, lexical_search, vector_codes
from montage.llm.common import join_groups, settle

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, m_key string, digest string, row int, n long"


def made_docs(spark):
    texts = [None, "", " \t\n\v\f\r", "a b", "ab", "a  b", "AB", "a\xa0b", "é", "é", "x" * 200_000 + " y", "x" * 200_000 + "y", "😀 z", "😀z"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "a b"), (None, "a b"), (None, "a   b"), (40, "a  b"), (None, None)]
    rows += [(100 + i, "copy" + " " * (i % 3)) for i in range(300)]
    return spark.createDataFrame([(i, t, "k", "d", 7, 8) for i, t in rows], DOCS), rows


def brute_groups(rows: list[tuple]) -> dict:
    """normalised text -> (rows, keep_id, kept rows)."""
    by = collections.defaultdict(list)
    for i, t in rows:
        by[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0))
    return {k: (len(v), None if min(v)[1] else min(v)[2]) for k, v in by.items()}


@pytest.mark.parametrize("split", ["half", "none", "all", "odd"])
def test_exact_dedup_against_brute_force(spark, split):
    docs, rows = made_docs(spark)
    past = {"half": exact_dedup.earlier_half(docs), "none": None, "all": F.lit(True), "odd": F.col("id") % 2 == 1}[split]
    out = exact_dedup.exact_dedup(docs, past).collect()
    groups = brute_groups(rows)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    assert len(out) == len(rows)
    assert all((r["group_size"], r["keep_id"]) == by_sha[r["text_sha256"]] for r in out)
    kept = [r for r in out if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == sorted((i is None, i or 0) for i, _ in rows)


def test_exact_dedup_over_runs(spark, tmp_path):
    """The index of one run judges the rows of the next, and takes them in."""
    schema = "doc_id long, text string"
    first, second = [(1, "a b"), (2, "c"), (3, "c ")], [(11, "ab"), (12, "d"), (13, "d"), (14, "c   ")]
    none = exact_dedup.index_of(settle(exact_dedup.grouped(exact_dedup.keyed(spark.createDataFrame([], schema)))))
    out, index = exact_dedup.dedup_against(spark.createDataFrame(first, schema), none)
    assert {(r["doc_id"], r["keep_id"], r["kept"], r["in_history"]) for r in out.collect()} == {(1, 1, True, False), (2, 3, False, False), (3, 3, True, False)}
    index.write(f"{tmp_path}/index")
    out, index = exact_dedup.dedup_against(spark.createDataFrame(second, schema), exact_dedup.DigestIndex.read(spark, f"{tmp_path}/index"))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["in_history"]) for r in out.collect()}
    # 11 repeats 1, which stays; 14 is longer than what was kept and takes its place; 12 and 13 are new
    assert got == {11: (1, 2, False, True), 12: (12, 2, True, False), 13: (12, 2, False, False), 14: (14, 3, True, True)}
    assert sum(len(r["n"]) for r in index.table.select("n").collect()) == 3


def test_minimal_perfect_hash():
    rng = np.random.default_rng(5)
    digests = np.unique(rng.integers(0, 256, (5000, 32), dtype=np.uint8), axis=0)
    levels, order = exact_dedup.build_levels(exact_dedup._words(digests))
    places = levels.places(exact_dedup._words(digests))
    assert sorted(places.tolist()) == list(range(len(digests))) and (order[places] == np.arange(len(digests))).all()
    hit, at = exact_dedup.member_slots(digests, levels, digests[order])
    assert hit.all() and (digests[order][at] == digests).all()
    others = rng.integers(0, 256, (5000, 32), dtype=np.uint8)
    assert not exact_dedup.member_slots(others, levels, digests[order])[0].any()
    # digests that rest at no level are searched
    few = exact_dedup.Levels(levels.sizes[:1], levels.bits[: levels.sizes[0]])
    rests = few.places(exact_dedup._words(digests))
    held = np.concatenate((digests[np.argsort(rests)[(rests < 0).sum() :]], digests[rests < 0]))
    assert exact_dedup.member_slots(digests, few, held)[0].all()


def test_small_buckets_give_the_same_groups(spark):
    docs, rows = made_docs(spark)
    groups = settle(exact_dedup.grouped(exact_dedup.keyed(docs)))
    index = exact_dedup.index_of(groups, bucket_keys=2)
    after = exact_dedup.looked_up(groups, index).collect()
    assert index.buckets > 3 and len(after) == len(brute_groups(rows)) and all(r["member"] for r in after)
    assert sum(r["n"] for r in after) == 2 * len(rows)


def test_join_groups_with_hot_and_null_keys(spark):
    rows = settle(spark.createDataFrame([(1 if i % 3 else None, i) for i in range(90)] + [(k, k) for k in range(2, 2000)], "k int, other int"))
    groups = settle(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("other").alias("s")))
    got = join_groups(rows, groups, "k", "n")
    assert got.columns == ["k", "other", "n", "s"] and got.count() == rows.count()
    assert got.filter("k is null").select("n").distinct().collect() == [(30,)]


# ---- lexical search -------------------------------------------------------------------------------------------------


def brute_search(docs: list[tuple], items: list[tuple], k: int = 10) -> list[tuple]:
    def terms(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))

    held = [(i, collections.Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(c.total() for _, c in held)
    df = collections.Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 25 + 75 * c.total() * n_docs // max(n_terms, 1)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return out


def test_search_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ünï", "ünï", "日本", "x-y", "O'Neil", "١٢"]
    text = lambda n: " ".join(rng.choice(vocabulary, n, p=(q := 1 / np.arange(1, len(vocabulary) + 1)) / q.sum()))
    docs = [(i, text(int(rng.integers(0, 60)))) for i in range(700)] + [(None, "w1 w2 日本"), (5, "w3"), (800, None), (801, ""), (802, "--- ..."), (803, text(40_000))]
    docs += [(900 + i, "w10 W11 w12, w399") for i in range(60)]
    items = [(i, text(12)) for i in range(30)] + [(30, None), (31, "?!"), (32, "absent"), (32, "w399 w399 w12"), (None, "日本 ünï"), (33, "w0")]
    made = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in docs], "doc_id long, text string, m_key string, rank int, score int").repartition(5)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    monkeypatch.setattr(lexical_search, "MOST_TERMS", 60)
    out = lexical_search.search(lexical_search.build_index(made), asked).collect()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, out), key=key) == sorted(brute_search(docs, items), key=key)


def test_search_of_nothing(spark):
    some, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(lexical_search.build_index(none), asked).count() == 0
    assert lexical_search.search(lexical_search.build_index(some), asked.filter("false")).count() == 0
    # of one document every term has weight 1000 * ln(4 / 3)
    assert [tuple(r) for r in lexical_search.search(lexical_search.build_index(some), asked).collect()] == [(1, 1, 1, 287 * (10**9 // 1800))]


def test_index_can_be_kept(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a b{i} c") for i in range(50)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "b7 b9 a")], "item_id long, text string")
    built = lexical_search.build_index(docs, f"{tmp_path}/index")
    read = lexical_search.LexicalIndex.read(spark, f"{tmp_path}/index")
    assert sorted(lexical_search.search(built, asked).collect()) == sorted(lexical_search.search(read, asked).collect())
    assert [r["doc_id"] for r in lexical_search.search(read, asked, k=2).orderBy("rank").collect()] == [7, 9]


def test_bytes_bound_the_impacts():
    tf = np.array([1, 1, 2, 50, 10**6, 1, 3], np.int64)
    m = np.array([25, 100, 25, 25, 25, 10**9, 10**7], np.int64)
    exact = lexical_search.impact(tf, m)
    up = -(-exact // lexical_search.STEP)
    assert (up <= 255).all() and (up * lexical_search.STEP >= exact).all() and (np.where(up > 0, (up - 1) * lexical_search.STEP + 1, 0) <= exact).all()


def test_few_documents_are_scored_exactly():
    """Most documents of a block are passed over by their bytes alone, and the best are found all the same."""
    rng = np.random.default_rng(2)
    p = 1 / np.arange(1, 301)
    block = lexical_search._Block()
    names = rng.integers(1, 2**63, 300, dtype=np.uint64)
    for i in range(1000):
        block.add([i], names[rng.choice(300, 50, p=p / p.sum())], np.array([0, 50]))
    dictionary, starts, doc, counts, n = block.postings()
    up = -(-lexical_search.impact(counts.astype(np.int64), lexical_search.lengths(n, 1000, 50_000)[doc]) // lexical_search.STEP)
    row = {"dictionary": dictionary, "starts": starts, "docs": doc, "impacts": up.astype("u1"), "counts": counts, "lengths": n}
    vocabulary = np.sort(names)
    asked = lexical_search._Queries(vocabulary, [(0, np.searchsorted(vocabulary, np.sort(names[40:60])), np.ones(20, np.int64))])
    weights = np.full(300, 3000)
    best = [lexical_search._Best(10)]
    scored = lexical_search.score_block(row, block.ids, asked, weights, 1000, 50_000, best)
    assert 10 <= scored < 100 and len(best[0].found) == 10


# ---- vector codes ---------------------------------------------------------------------------------------------------


def brute_codes(rows: list[tuple], parts: int = 8, entries: int = 16, rounds: int = 6) -> list[tuple]:
    fine = [(i, [math.floor(4096 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    out, errors = [], collections.Counter()
    for length in sorted({len(v) for _, v, _ in fine}):
        width = max(1, -(-length // parts))
        own = [(i, v + [0] * (parts * width - length), label) for i, v, label in fine if len(v) == length]
        cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in own]
        books = [[c[p] for c in cut[:entries]] for p in range(parts)]
        far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
        nearest = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
        for _ in range(rounds):
            for p in range(parts):
                at = [nearest(c[p], books[p]) for c in cut]
                books[p] = [
                    [sum(col) // len(mine) for col in zip(*mine, strict=True)] if (mine := [c[p] for c, a in zip(cut, at, strict=True) if a == e]) else old
                    for e, old in enumerate(books[p])
                ]
        sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
        for (i, _, label), c in zip(own, cut, strict=True):
            at = [nearest(c[p], books[p]) for p in range(parts)]
            error = sum(far(c[p], books[p][at[p]]) for p in range(parts))
            errors[label] += error
            out.append([i, "".join(f"{a:02x}" for a in at), error, label, sha])
    return [(i, code, min(error, 2**63 - 1), min(errors[label], 2**63 - 1), sha) for i, code, error, label, sha in out]


def compare(spark, rows: list[tuple], **parts) -> None:
    made = spark.createDataFrame([(i, v, label, 1, 2) for i, v, label in rows], "vec_id long, embedding array<double>, label string, code int, v int").repartition(3)
    got = vector_codes.vector_codes(made, **parts).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, got), key=lambda r: str(key(r))) == sorted(brute_codes(rows, **parts), key=lambda r: str(key(r)))


def test_codes_of_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=16).tolist(), "ab"[i % 2] if i % 5 else None) for i in range(300)]
    rows += [(500 + i, rows[7][1], "a") for i in range(200)]  # copies
    rows += [(None, rng.normal(size=16).tolist(), None), (3, rng.normal(size=16).tolist(), "a"), rows[9]]
    rows += [(900, None, "a"), (901, [1.0, None], "a"), (902, [float("nan")] * 16, "a"), (903, [float("inf")] * 16, "b")]
    rows += [(910, [], "c"), (911, [], None), (920, [0.5, -0.5, 1.0], "c"), (921, [0.25, 0.5, 9.0], "c")]
    compare(spark, rows)


def test_codes_with_ties(spark):
    """Points of a small grid: many are equally far from several entries, and entries repeat."""
    rng = np.random.default_rng(6)
    rows = [(i, (rng.integers(0, 3, 16) / 4096).tolist(), "a") for i in range(400)]
    compare(spark, rows)
    compare(spark, rows[:5])


def test_codes_of_large_components(spark):
    rng = np.random.default_rng(7)
    compare(spark, [(i, (rng.normal(size=8) * (1e9 if i % 2 else 1)).tolist(), "a") for i in range(60)], rounds=2)


def test_codes_of_nothing_and_of_floats(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vector_codes.vector_codes(none).count() == 0


def test_trees_filter_like_plain_rounds_and_assign_whole_subtrees():
    rng = np.random.default_rng(9)
    centres = rng.integers(-4000, 4000, (16, 4))
    points = centres[rng.integers(0, 16, 4000)] + rng.integers(-150, 150, (4000, 4))
    tree, entries = vector_codes.Tree(points), centres + 10
    plain = ((points[:, None] - entries[None]) ** 2).sum(-1).argmin(1)
    assert (tree.codes(entries) == plain).all()
    kept = vector_codes.read_tree(vector_codes._kept(tree), 4, True)
    sums, counts = kept.totals(entries)
    assert (counts == np.bincount(plain, minlength=16)).all()
    assert (sums == np.stack([points[plain == e].sum(0) for e in range(16)])).all()
    whole = sum(int(tree.sizes[level][node].sum()) for level, node, _ in tree.walk(entries) if level >= 0)
    assert whole > 3000


def test_decoding_gives_the_error(spark):
    rng = np.random.default_rng(10)
    rows = spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(200)], "vec_id long, embedding array<double>")
    kept = vector_codes.prepared(rows, "vec_id", "embedding", None)
    trees, books = vector_codes.learn(kept, 8, 16, 3)
    coded = vector_codes.encoded(trees, kept, books).join(rows.withColumnRenamed("vec_id", "id"), "id")
    back = coded.withColumn("back", vector_codes.decoded(F.col("code"), books[16]))
    far = F.aggregate(F.zip_with("embedding", "back", lambda a, b: F.floor(a * 4096) - F.floor(b * 4096 + 0.5)), F.lit(0).cast("long"), lambda s, d: s + d * d)
    assert back.filter(far != F.col("error")).count() == 0
