"""The operators as queries, and the pipeline, on the smallest table."""

import re
from collections import defaultdict
from pathlib import Path

import duckdb
import pytest

queries = pytest.importorskip("tamis.llm.queries")


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op11_topk", "op13_negatives"}))  # searches, whose rows SQL tells
def test_whole_table(spark, sf, name):
    table = {"op4_html": "pages", "op6_embeddings": "embeddings", "op12_clusters": "embeddings"}.get(name, "documents")
    n = spark.read.parquet(f"{sf}/{table}.parquet").count()
    got = queries.QUERIES[name](spark, sf)
    assert got.count() >= n if name == "op1_packing" else got.count() == n


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, sf, name):
    con = duckdb.connect()
    for table in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rel = con.sql(queries.ORACLES[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[k] for k in at) for r in rel.fetchall())


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.score, labels[r.doc_id]) for r in queries.QUERIES["op8_toxicity"](spark, sf).where("held_out").collect() if labels.get(r.doc_id) is not None]
    bad, good = [s for s, y in rows if y], [s for s, y in rows if not y]
    assert sum(a > b for a in bad for b in good) / (len(bad) * len(good)) > 0.8


def test_pipeline_stages(spark, sf):
    """Each stage against a plain version of what it does, over what the stage before it kept."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tamis.llm import pii
    from tamis.llm.common import materialize

    word = re.compile(r"[^\x20\x09-\x0D]+")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = materialize(stage(spark, docs, sf), f"test-{name}")
        rows = docs.collect()
        seen[name] = rows
        if name != "packing":
            assert docs.columns == columns
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            kept = {r.doc_id for r in rows}
            assert all(i in kept for i in before if labels.get(i) == 1)
            assert sum(i not in kept for i in before if labels.get(i) == 0) >= 0.8 * sum(labels.get(i) == 0 for i in before)
        if name == "near-duplicates":
            sets = {}
            for i, r in before.items():
                w = word.findall((r.text or "").lower())
                sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])
            parent = {i: i for i in sets}

            def root(k, parent=parent):
                while parent[k] != k:
                    k = parent[k]
                return k

            for i in sets:
                for j in sets:
                    if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                        a, b = root(i), root(j)
                        parent[max(a, b)] = min(a, b)
            assert {r.doc_id for r in rows} == {i for i in sets if root(i) == i}
        if name == "pii":
            assert {r.doc_id for r in rows} == set(before)
            for r in rows:
                assert not pii.base_spans(r.text or "") and r.n_chars == len(r.text)
                assert r.text == before[r.doc_id].text or pii.all_spans(before[r.doc_id].text, pii.trained()) != ([], [])
        if name == "packing":
            by = defaultdict(int)
            for r in rows:
                by[r.doc_id] += r.length
            assert set(by) == set(before)


def test_near_duplicates_of_repeated_and_null_ids(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")
    rows = [(5, a), (5, a), (3, a), (7, b), (7, c), (2, c), (None, d), (None, d), (None, "alone in this"), (8, None), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_duplicates_stage(spark, docs, "").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(3, a), (7, b), (2, c), (None, d), (None, "alone in this"), (8, None), (8, None)]))


ODD = "doc_id long, text string, lang string, source string, n_chars long, _row long, rep string, keep int, size string, component_id long"


def odd_documents(spark):
    """Nulls, blanks, a very long text, ties, repeated rows, and columns with names that operators use."""
    prose = ". ".join(" ".join(f"word{k}x{i}" for i in range(9)).capitalize() for k in range(12)) + "."
    texts = [None, "", " \n ", "Short but fine.", prose, prose, prose + " More of it.", "mail me@here.org or call +1 (555) 555-1234 please.", "x" * 200_000, "long words here " * 30_000, "%%% ### " * 50]
    rows = [(k, t, None if k % 3 else "en", None if k % 4 == 0 else f"s{k % 2}", None, 1, "r", 0, "big", 5) for k, t in enumerate(texts)]
    plain = lambda k: ". ".join(" ".join(f"{'aeiou'[i % 5]}l{'bcdfg'[k % 5]}on{k}n{i}{j}" for i in range(7)).capitalize() for j in range(6)) + "."
    rows += [(100 + k, plain(k), "en", "s0", 1, 1, "r", 0, "big", 5) for k in range(60)]
    rows += [rows[3], rows[3], (None, "no id at all.", None, None, 13, 1, "r", 0, "big", 5), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, ODD).repartition(3)


def test_stages_on_odd_documents(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from tamis.llm.common import materialize

    for docs in (odd_documents(spark), odd_documents(spark).limit(0)):
        columns, many = docs.columns, docs.count()
        for name, stage in corpus_pipeline.STAGES:
            before = docs.collect()
            docs = materialize(stage(spark, docs, ""), f"odd-{name}")
            rows = docs.collect()
            if name != "packing":
                assert docs.columns == columns
            if name == "quality":
                assert not many or {3, 4, 7} <= {r.doc_id for r in rows} and sum(r.doc_id == 3 for r in rows) == 3
                assert set(map(repr, rows)) <= set(map(repr, before))
            if name == "near-duplicates":
                ids = [r.doc_id for r in rows]
                assert not many or ids.count(3) == 1 and ids.count(4) == 1 and 5 not in ids and 6 not in ids
                assert sum(not (r.text or "").split() for r in rows) == sum(not (r.text or "").split() for r in before)
            if name == "pii":
                assert len(rows) == len(before) and not any("here.org" in (r.text or "") for r in rows)
            if name == "mixing":
                assert all((r.text or "").split() for r in rows) and (not many or rows)
            if name == "packing":
                assert sum(r.length for r in rows if r.start == 0) and all(r.length > 0 for r in rows) or not many
            if not many:
                assert not rows


def test_classifiers_on_odd_documents(spark):
    from tamis.llm import quality, toxicity

    docs = odd_documents(spark)
    scored = quality.score_documents(docs).collect()
    assert len(scored) == docs.count() and all(0 <= r.quality_score <= 1 for r in scored)
    assert len({r.quality_score for r in scored if r.doc_id == 3}) == 1 and len({r.quality_score for r in scored if not (r.text or "").split()}) == 1
    labels = spark.createDataFrame([(k, k % 2) for k in range(11)] + [(3, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    made = toxicity.score_documents(docs, labels, tasks=2).collect()
    assert len(made) == docs.count() and all(0 <= r.score <= 1 for r in made)
    assert len({r.score for r in made if r.doc_id == 3}) == 1
    again = {(r.doc_id, r.score) for r in toxicity.score_documents(docs.repartition(5), labels, tasks=2).collect()}
    assert again == {(r.doc_id, r.score) for r in made}


def test_posteriors_are_those_of_a_plain_loop():
    """Expectation-maximisation over counted patterns against one over documents, vote by vote."""
    import numpy as np
    from tamis.llm import quality

    rng = np.random.default_rng(2)
    truth = rng.random(1500) < 0.7
    votes = np.stack([np.where(rng.random(1500) < 0.3, -1, np.where(rng.random(1500) < a, truth, ~truth)) for a in (0.9, 0.8, 0.7, 0.85)], 1)
    pattern, count = np.unique(quality.patterns(votes), return_counts=True)
    post, rates, prior = quality.expectation_maximisation(pattern, count.astype(float), 4, rounds=40)
    own = []
    for v in votes.tolist():
        bad, good = v.count(0), v.count(1)
        own.append(0.95 if not bad else 0.05 if bad >= 2 else (good + 1) / (good + 10))
    for _ in range(40):
        table = [[[0.5, 0.4, 0.1] for _ in range(4)], [[0.5, 0.1, 0.4] for _ in range(4)]]
        for p, v in zip(own, votes.tolist(), strict=True):
            for k, x in enumerate(v):
                table[0][k][x + 1] += 1 - p
                table[1][k][x + 1] += p
        table = [[[x / sum(row) for x in row] for row in side] for side in table]
        share = (sum(own) + 1) / (len(own) + 2)
        new = []
        for v in votes.tolist():
            lift = np.log(share / (1 - share)) + sum(np.log(table[1][k][x + 1] / table[0][k][x + 1]) for k, x in enumerate(v) if x >= 0)
            new.append(1 / (1 + np.exp(-lift)))
        if max(abs(a - b) for a, b in zip(own, new, strict=True)) < 1e-9:
            break
        own = new
    assert all(abs(post[p] - q) < 1e-6 for p, q in zip(quality.patterns(votes).tolist(), own, strict=True))
    assert abs(prior - share) < 1e-6


@pytest.mark.parametrize("good", [0.2, 0.5, 0.9])
def test_bad_documents_go_whatever_the_share_of_good_ones(good):
    """The share is estimated, not assumed: votes of accuracy 0.8 to 0.9 tell most documents at any share."""
    import numpy as np
    from tamis.llm import quality

    rng = np.random.default_rng(7)
    truth = rng.random(20_000) < good
    right = (0.85, 0.8, 0.9, 0.85, 0.8, 0.9)
    votes = np.stack([np.where(rng.random(len(truth)) < 0.25, -1, np.where(rng.random(len(truth)) < a, truth, ~truth)) for a in right], 1)
    pattern, count = np.unique(quality.patterns(votes), return_counts=True)
    post, _, prior = quality.expectation_maximisation(pattern, count.astype(float), len(right))
    kept = np.array([post[p] for p in quality.patterns(votes).tolist()]) >= 0.5
    assert abs(prior - good) < 0.03
    assert kept[~truth].mean() < 0.2 and kept[truth].mean() > 0.8 and (kept == truth).mean() > 0.93


def test_documents_without_votes_stay_where_most_are_bad(spark):
    from tamis.llm import quality

    rows = [(k, "!! ?? ;; %% && " * 30 + str(k)) for k in range(60)] + [(100, None), (101, ""), (102, "a few words")]
    got = {r.doc_id: r for r in quality.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k].keep for k in (100, 101, 102)) and not any(got[k].keep for k in range(60))


def test_one_text_repeated_often_is_one_of_the_sample(spark):
    from tamis.llm import quality
    from tamis.llm.common import word_runs

    plain = [f"This is a sentence about thing {k}, and it goes on for some words. Then it ends here." for k in range(30)]
    docs = spark.createDataFrame([(k, plain[k % 30]) for k in range(60)] + [(k, "BUY NOW!! " * 40) for k in range(60, 400)], "doc_id long, text string")
    import pyarrow as pa

    alike = [quality.learn(d, sample=40)[0] for d in (docs, docs.repartition(7))]
    texts = pa.array([*plain, "BUY NOW!! " * 40, ""])
    one, two = ([s(r)[1].tolist() for r in word_runs(texts)] for s in alike)
    assert one == two and all(x > 0.5 for x in one[0][:30])


def test_ratios_are_log_count_ratios(spark):
    """Where the labels' n-grams don't meet, a weight has the sign of its log-count ratio, recomputed by hand."""
    import numpy as np
    from tamis.llm import toxicity

    rows = [(f"clean words {k % 7}", 0) for k in range(40)] + [(f"nasty grobnik {k % 7}", 1) for k in range(40)]
    model = toxicity.learn(spark.createDataFrame(rows, "text string, toxic int"), tasks=2)
    counts = {0: defaultdict(int), 1: defaultdict(int)}
    for text, y in rows:
        found = {int(g) for grams, _ in toxicity.ngrams([text], model.sizes, model.bits) for g in grams}
        for g in found:
            counts[y][g] += 1
    sizes = {y: sum(c.values()) + (1 << model.bits) for y, c in counts.items()}
    for g in np.flatnonzero(model.weights).tolist():
        ratio = np.log((counts[1][g] + 1) / sizes[1]) - np.log((counts[0][g] + 1) / sizes[0])
        assert np.sign(model.weights[g]) == np.sign(ratio) or abs(model.weights[g]) < 1e-3
    scores = toxicity.scores(["nasty grobnik", "clean words", ""], model)
    assert scores[0] > 0.9 and scores[1] < 0.1 and np.count_nonzero(model.weights) > 10
