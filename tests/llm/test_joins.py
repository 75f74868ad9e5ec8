"""The Jaccard join, hard negatives and the alignment of tokenizers against brute force, and edge rows."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from movelog.llm import buckets, op11_jaccard_join, op12_hard_negatives, op13_alignment
from movelog.llm.op06_token_counts import byte_characters

from .test_operators import brute_components, empty, odd, random_texts  # noqa: F401

# ---------------------------------------------------------------- op11


def clusters(rng, sizes, length=60, changes=8):
    """Texts of several clusters, whose members differ from their cluster's text by up to so many words."""
    texts = []
    for size in sizes:
        base = [f"w{rng.randrange(3000)}" for _ in range(length)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(changes)):
                words[rng.randrange(length)] = f"x{rng.randrange(3000)}"
            texts.append(" ".join(words))
    return texts


def test_join_by_brute_force(spark):
    rng = random.Random(11)
    shared = " ".join(f"s{k}" for k in range(30))
    texts = clusters(rng, [1, 2, 9, 40], changes=4) + [f"{shared} " + " ".join(f"y{rng.randrange(500)}" for _ in range(rng.randrange(1, 25))) for _ in range(60)]
    texts += ["", None, "A", "a", "a b c", "A B C", "a b c d e f", "a b c d e f"]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((5, 80), (1, 60), (2, 90)):
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in op11_jaccard_join.jaccard_join(docs, width, percent).collect()}
        assert found == brute_components(rows, width, percent)


def test_cells_find_all_links_by_brute_force(monkeypatch):
    monkeypatch.setattr(op11_jaccard_join, "LEAF", 6)
    rng, cut = np.random.default_rng(3), 0
    for trial in range(12):
        base = [rng.choice(400, 60, replace=False) for _ in range(4)]
        sets = []
        for _ in range(80):
            own = base[rng.integers(4)].copy()
            at = rng.integers(0, 60, rng.integers(0, 10))
            own[at] = rng.integers(400, 900, len(at))
            sets.append(np.unique(own))
        cell = op11_jaccard_join.Cell(pd.DataFrame({"node": range(80), "part": range(80), "shingles": sets}), 80)
        cell.compare = lambda members, seen=None, plain=cell.compare: (counted.append(len(members)), plain(members, seen))[1]
        counted = []
        cell.join(np.arange(80))
        cut += max(counted, default=0) < 80
        parent = list(range(80))
        for a in range(80):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if both * 100 >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = parent[a], parent[b]
                    parent = [min(x, y) if p in (x, y) else p for p in parent]
        groups = lambda labels: {frozenset(np.flatnonzero(np.array(labels) == x).tolist()) for x in set(labels)}
        assert groups(cell.part.tolist()) == groups(parent)
        assert len(cell.links) == 80 - len(groups(parent))  # a forest: no link twice
    assert cut >= 6  # regions were cut into cells


def test_prefixes_meet_whatever_the_order():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 40))
        a = np.unique(rng.integers(0, 60, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 60, 2).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both * 100 >= 80 * (len(a) + len(b) - both):
            common = (np.arange(0, 60, 3, dtype=np.uint64), rng.integers(1, 9, 20))
            assert np.intersect1d(*(op11_jaccard_join.prefix(s, common, 80) for s in (a, b))).size


def test_prefixes_meet_at_any_size():
    rng, linked = np.random.default_rng(6), 0
    for _ in range(1500):
        percent = int(rng.choice([60, 67, 80, 90, 100]))
        a = np.unique(rng.integers(0, 1 << 62, int(np.exp(rng.uniform(0, 6.5))) + 1).astype(np.uint64))
        kept = int(np.ceil(len(a) * rng.uniform(percent / 100, 1)))
        more = int(rng.integers(0, max(1, kept * 100 // percent - len(a) + 1)))
        b = np.unique(np.concatenate([rng.permutation(a)[:kept], rng.integers(0, 1 << 62, more).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if both * 100 >= percent * (len(a) + len(b) - both):
            linked += 1
            common = (np.unique(rng.permutation(a)[: len(a) // 2]), rng.integers(1, 1 << 40, len(a) // 2))
            x, y = (op11_jaccard_join.prefix(s, common, percent) for s in (a, b))
            met = np.array([len(np.intersect1d(x, y))] * 2)
            assert met[0] and op11_jaccard_join.possible(np.array([len(a), len(b)]), met, percent).all()
    assert linked > 1000


def test_chance_makes_no_regions(spark, monkeypatch):
    """Documents that share single shingles of their prefixes, as more and more do in a growing corpus, meet nowhere."""
    rng, tables = random.Random(12), {}
    lines = [" ".join(f"line{k}x{j}" for j in range(5)) for k in range(150)]
    texts = [" ".join([*(f"w{k}x{j}" for j in range(150)), *rng.sample(lines, 3)]) for k in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:5] + [texts[7] + " end"])), "doc_id long, text string")
    write = op11_jaccard_join.materialise
    monkeypatch.setattr(op11_jaccard_join, "materialise", lambda df, name: tables.update({name: write(df, name)}) or tables[name])
    found = {r.doc_id: r.component_id for r in op11_jaccard_join.jaccard_join(docs).collect()}
    assert found == {k: k for k in range(150)} | {150 + k: k for k in range(5)} | {155: 7}
    assert {r.node for r in tables["join-regions"].collect()} == {7, 155}


def test_regions_within_others_go(spark):
    regions = [(1, k) for k in (1, 2, 3, 4)] + [(2, k) for k in (2, 3)] + [(4, k) for k in (4, 5)] + [(9, k) for k in (8, 9)]
    found = op11_jaccard_join.outermost(spark.createDataFrame(regions, "leader long, node long")).collect()
    assert sorted(map(tuple, found)) == [r for r in regions if r[0] != 2]


def test_texts_stay_where_documents_are_many(spark, monkeypatch):
    monkeypatch.setattr(op11_jaccard_join, "BROADCAST_IDS", 50)
    docs = spark.createDataFrame([(k, f"text {k % 190}") for k in range(200)] + [(None, "none")], "doc_id long, text string")
    known = docs.where("doc_id IS NOT NULL").select("doc_id", F.md5("text").alias("set_key"))
    kept = op11_jaccard_join.without_copies(docs, known, known.groupBy("set_key").agg(F.min("doc_id").alias("node")))
    assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in kept.collect()) == list(range(190))


def test_bands_move_once(spark, monkeypatch):
    """Buckets' members are counted where the one shuffle of all bands puts them, even if no table is small enough to be broadcast."""
    rng, plans = random.Random(5), []
    reps = [(k, rng.sample(range(400), 6) + ([1000] if k % 2 else [])) for k in range(200)]
    write = buckets.materialise
    monkeypatch.setattr(buckets, "materialise", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = buckets.gathered(spark.createDataFrame(reps, "node long, bands array<long>"), "test").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum("Generate explode" in p for p in plans) == 1 and plans[0].count("Exchange") == 1
    members = Counter(b for _, bands in reps for b in bands)
    weight = {k: sum(members[b] for b in bands if members[b] > 1) for k, bands in reps}
    leader = {b: max((weight[k], -k) for k, bands in reps if b in bands)[1] for b in members}
    assert sorted(map(tuple, found)) == sorted((b, k, -leader[b]) for k, bands in reps for b in bands if members[b] > 1)


def test_join_edges(spark, odd):  # noqa: F811
    rows = op11_jaccard_join.jaccard_join(odd).collect()
    assert len(rows) == odd.count()
    by = {(r.doc_id, r.n_shingles): r.component_id for r in rows}
    assert by[1, 0] == 1 and by[6, 0] == 6 and by[None, 1] is None and by[8, 1] == 8
    assert by[4, 39_996] == 4 and by[5, 39_997] == 4
    assert op11_jaccard_join.jaccard_join(empty(odd)).count() == 0


# ---------------------------------------------------------------- op12


def brute_negatives(rows, anchor, positives=5, negatives=10, low=30, high=90):
    """Sorted output tuples; rows: (id, label, vector) of whole numbers."""
    out = []
    score = lambda v, w: sum(x * y for x, y in zip(v, w))
    for i, label, v in rows:
        if not anchor(i):
            continue
        best = sorted((-score(v, w), j) for j, other, w in rows if other == label and j != i)[:positives]
        for p, j in ((-s, j) for s, j in best):
            found = sorted((-s, m) for s, m in ((score(v, w), m) for m, other, w in rows if other != label and m != i) if low * p <= 100 * s <= high * p)
            out += [(i, j, rank, m, p, -s) for rank, (s, m) in enumerate(found[:negatives], 1)]
    return sorted(out)


def mined(df, is_anchor, **options):
    found = op12_hard_negatives.hard_negatives(op12_hard_negatives.prepared(df, is_anchor), op12_hard_negatives.Mining(**options))
    return sorted(tuple(r) for r in found.collect())


def test_negatives_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op12_hard_negatives, "ANCHORS", 20)
    monkeypatch.setattr(op12_hard_negatives, "CHUNK", 7)
    monkeypatch.setattr(op12_hard_negatives, "ROWS", 40)
    monkeypatch.setattr(op12_hard_negatives, "PART", 100)
    rng = np.random.default_rng(12)
    middle = rng.normal(0, 0.2, (4, 21))
    rows = []
    for k in range(500):
        v = middle[k % 4] + rng.normal(0, 0.1, 21)
        rows.append((k, int(rng.integers(3)), [float(x) for x in v[: 21 - k % 3]]))
    rows += [(k, lab, v) for (k, lab, v) in rows[100:110]]  # repeated rows
    rows += [(1000 + k, rows[k][1], rows[k][2]) for k in range(60)]  # ties
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("part", F.lit(3)).repartition(5)
    whole = [(i, lab, [math.floor(x * 256) for x in v]) for i, lab, v in rows]
    anchor = lambda i: i % 13 == 0
    assert mined(df, F.col("vec_id") % 13 == 0) == brute_negatives(whole, anchor)
    assert mined(df, F.col("vec_id") % 13 == 0, positives=2, negatives=30, low=-50, high=99) == brute_negatives(whole, anchor, 2, 30, -50, 99)


def test_bounds_hold_and_exclude():
    rng = np.random.default_rng(1)
    left, right = (np.cumsum(rng.integers(-20, 21, (50, 64)), axis=1) for _ in range(2))  # neighbouring components are alike
    side = lambda v: op12_hard_negatives.Side(pd.DataFrame({"id": range(50), "label": 0, "vector": list(v)}).assign(**{f"level{k}": list(x.astype(np.float32)) for k, x in enumerate(op12_hard_negatives.summaries(v))}))
    a, x = side(left), side(right)
    exact, width = left @ right.T, []
    for level in range(len(op12_hard_negatives.WIDTHS)):
        low, high = op12_hard_negatives.bounds(a, x, level)
        assert (low <= exact).all() and (exact <= high).all()
        i, j = np.nonzero(exact > -1)
        some = op12_hard_negatives.bounds(a, x, level, (i, j))
        assert np.allclose(some[0], low[i, j]) and np.allclose(some[1], high[i, j])
        width.append((high - low).mean())
    assert width[0] > 2 * width[1] > 2 * width[2]  # narrower segments bound more tightly


def test_negatives_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, 1, [0.5]), (3, 2, [0.5, 0.5]), (4, 2, [0.4, 0.4]), (5, None, [9.0, 9.0]), (6, 2, None), (None, 2, [0.5, 0.5]), (8, 2, [nan, 1.0]), (9, 2, [inf, 1.0]), (10, 2, [None, 1.0]), (11, 2, []), (13, 2, [0.3, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("row", F.lit("x")).withColumn("id", F.lit(1))
    whole = [(i, lab, [math.floor(np.float32(x) * 256.0) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and not any(x is None or not math.isfinite(x) for x in v)]
    assert mined(df, F.col("vec_id") == 0) == brute_negatives(whole, lambda i: i == 0) != []
    assert mined(empty(df), F.col("vec_id") == 0) == [] == mined(df, F.lit(False))
    # Sums beyond floating point's whole numbers stay exact, those beyond a long stay at its end.
    big = [(0, 1, [2.0**22 + 1, 1.0]), (1, 1, [2.0**22 + 1, 3.0]), (2, 2, [2.0**21 + 1, 1.0]), (3, 2, [2.0**21 + 1, 2.0]), (4, 1, [1e38, 0.0])]
    df = spark.createDataFrame(big, "vec_id long, label int, embedding array<double>")
    found = mined(df, F.col("vec_id") == 0)
    dot = lambda i, j: 65536 * (int(big[i][2][0]) * int(big[j][2][0]) + int(big[i][2][1]) * int(big[j][2][1]))
    assert [r for r in found if r[1] == 1] == [(0, 1, 1, 3, dot(0, 1), dot(0, 3)), (0, 1, 2, 2, dot(0, 1), dot(0, 2))]
    assert not [r for r in found if r[1] == 4]


# ---------------------------------------------------------------- op13

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_alignment(texts):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each text, token by token."""
    a_model, b_model = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_model.encode_special_tokens = True
    byte = {c: k for k, c in enumerate(byte_characters())}
    spell_a = lambda k: bytes(byte[c] for c in a_model.id_to_token(k))
    spell_b = lambda k: bytes([int(b_model.id_to_piece(k)[3:5], 16)]) if b_model.is_byte(k) else b_model.id_to_piece(k).replace("▁", " ").encode()
    found, counts = [], Counter()
    for text in texts:
        a, b = a_model.encode(" " + (text or ""), add_special_tokens=False).ids, b_model.encode(text or "")
        whole = (" " + (text or "")).encode()
        if not text or b"".join(map(spell_a, a)) != whole or b"".join(map(spell_b, b)) != whole:
            found.append(None)
            continue
        sides = []
        for ids, spell in ((a, spell_a), (b, spell_b)):
            at, rows = 0, []
            for k in ids:
                rows.append((at, at := at + len(spell(k)), k))
            sides.append(rows)
        cuts = sorted({e for _, e, _ in sides[0]} & {e for _, e, _ in sides[1]})
        groups = ["|".join(",".join(str(k) for s, e, k in rows if start <= s and e <= end) for rows in sides) for start, end in zip([0, *cuts], cuts)]
        links = [(j, k) for s, e, j in sides[0] for t, f, k in sides[1] if s < f and t < e]
        counts.update(links)
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, k), n in counts.items():
        best[k] = max(best[k], n)
    return [(0, 0, 0, 0, 0, 0, "") if x is None else (*x[:3], len(x[3]), sum(counts[p] == best[p[1]] for p in x[3]), sum(counts[p] for p in x[3]), x[4]) for x in found]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_by_brute_force(spark):
    texts = random_texts(150)[:-3] + ["a" * 300, "naïve café \U0001f600\U0001f468‍\U0001f469", "▁ under ▁score", "<s> </s> <0x41> <unk>", "tab\tand\r\nline\x00end", "  two  spaces ", "　 wide", "日本語のテキスト", None, "", "the same", "the same"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    wanted = dict(enumerate(brute_alignment(texts)))
    for common in (op13_alignment.COMMON, 0):  # with no pairs sent but the regular ones, all others are joined
        found = op13_alignment.align_tokenizers(df, A, B, common=common).collect()
        assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in found} == wanted and len(found) == len(texts)


def test_pair_counts_are_those_of_all_links(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["hello there world", "hello hello", None])], "doc_id long, text string")
    alignment = op13_alignment.Alignment(df, A, B)
    pairs = alignment.pair_counts().collect()
    assert sum(r.n for r in pairs) == sum(r.n_links for r in alignment.documents().collect())
    assert all(r.is_best == (r.n == max(x.n for x in pairs if x.b == r.b)) for r in pairs)


def test_alignment_edges(spark, odd):  # noqa: F811
    rows = op13_alignment.align_tokenizers(odd, A, B).collect()
    assert len(rows) == odd.count()
    texts = [r.text for r in odd.collect() if len(r.text or "") < 1000]
    wanted = Counter((x[0], x[1], x[6]) for x in brute_alignment(texts))
    found = Counter((r.n_a, r.n_b, r.groups_sha256) for r in rows)
    assert wanted <= found and sum((found - wanted).values()) == 2  # the two long ones
    assert op13_alignment.align_tokenizers(empty(odd), A, B).count() == 0
