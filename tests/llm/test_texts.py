"""Token counts, classifier, language model, sharding, mixing, the kernel and the pipeline."""

import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from citemill.llm import lmscore, mixing, quality, queries, sharding, textkernel, tokencounts
from citemill.llm import lattice as lattice_module
from citemill.llm.lattice import Lattice, load_pieces
from pyspark.sql import functions as F

from tests.conftest import SF, agrees
from tests.llm.common import crc, docs, words

BIG = "lorem ipsum dolor " * 20_000
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (4, "One two"), (None, "no id here"), (5, BIG), (6, "été ÉTÉ the The")]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_agrees_with_sql(spark, name):
    agrees(spark, queries.QUERIES[name], queries.SQL[name])


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_word_hashes_tell_words_apart():
    texts = [t or "" for _, t in ODD] + ["", "a" * 5000 + " b", "\x0bq\x0c r"]
    seen = {}
    for _, _, data, offs in textkernel.chunks(pa.array(texts)):
        h, doc, start, end = textkernel.words(data, offs)
        for x, a, b in zip(h, start, end, strict=True):
            w = bytes(data[a:b]).lower() if bytes(data[a:b]).isascii() else bytes(data[a:b])
            assert seen.setdefault(int(x), w) == w
        assert list(np.bincount(doc, minlength=len(texts))) == [len(words(t)) for t in texts]


def test_edits_recount_like_whole_texts():
    count, rnd = tokencounts.encoder(tokencounts.RANKS_FILE), random.Random(4)
    for text in ("", " ", "a", "The cat's  hat.\n\n" * 9, "x" * 900, "naïve café 123 " * 30):
        tree, now = tokencounts.TokenTree(text, count, leaf=24), text
        assert tree.tokens == count(now)
        for _ in range(25):
            at, cut, put = rnd.randrange(len(now) + 2), rnd.choice([0, 1, 3, 50]), rnd.choice(["", " ", "\n", "'s", "new word", " 9", "  "])
            tree.edit(at, cut, put)
            at = min(at, len(now))
            now = now[:at] + put + now[at + cut :]
            assert (tree.text(), tree.tokens, tree.chars) == (now, count(now), len(now))


def _edited(text, edits):
    for start, deleted, inserted in edits:
        text = text[:start] + inserted + text[start + deleted :]
    return text


def _sample_edits(text):
    n = len(text)
    return [(n // 4, 0, " (edited) "), (n // 2, 5, ""), (n * 3 // 4, 3, "2nd\n\nnew")]


def test_token_counts_are_those_of_whole_texts(spark):
    from citemill.runtime import table

    count = tokencounts.encoder(tokencounts.RANKS_FILE)
    texts = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    got = tokencounts.op1_token_counts(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        now = _edited(texts[r.doc_id], _sample_edits(texts[r.doc_id]))
        assert (r.n_tokens, r.n_edited, r.n_chars) == (count(texts[r.doc_id]), count(now), len(now))
    assert sum(r.n_encoded for r in got) < 0.7 * sum(r.n_chars for r in got)


def test_kept_trees_of_odd_rows_are_edited_in_turn(spark):
    from citemill.runtime import materialize

    count = tokencounts.encoder(tokencounts.RANKS_FILE)
    trees = materialize(tokencounts.token_trees(docs(spark, ODD), leaf=40), "trees")
    assert {r.doc_id: r.n_tokens for r in trees.collect()} == {d: count(t or "") for d, t in ODD}
    once = materialize(tokencounts.edited_trees(trees.withColumn("edits", tokencounts.sample_edits(F.col("n_chars")))), "trees")
    twice = tokencounts.edited_trees(once.withColumn("edits", tokencounts.sample_edits(F.col("n_chars")))).collect()
    assert len(twice) == len(ODD)
    for r in twice:
        text = dict(ODD)[r.doc_id] or ""
        now = _edited(text, _sample_edits(text))
        now = _edited(now, _sample_edits(now))
        assert ("".join(r.leaves), r.n_tokens) == (now, count(now))
        assert r.n_encoded <= 3 * len(now) + 30 and (r.doc_id != 5 or r.n_encoded < 0.01 * len(BIG))
    none = trees.withColumn("edits", F.lit(None).cast("array<struct<start:int,deleted:int,inserted:string>>"))
    assert tokencounts.edited_trees(none).where("before <> n_tokens or n_encoded > 0").count() == 0
    key = trees.where("doc_id = 6").first().row
    some = spark.createDataFrame([(key, [(0, 3, "x y")])], "row binary, edits array<struct<start:int,deleted:int,inserted:string>>")
    only = tokencounts.apply_edits(trees, some).collect()
    assert [("".join(r.leaves), r.n_tokens) for r in only] == [("x y ÉTÉ the The", count("x y ÉTÉ the The"))]
    assert tokencounts.token_trees(docs(spark, ODD).where("false")).count() == 0


def _segmentations(word, weights):
    ways = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        ways[end] = sum(ways[k] * weights.get(word[k:end], 0.0) for k in range(max(0, end - 40), end))
    return ways[-1]


def test_lattice_sums_all_segmentations(monkeypatch):
    rnd = random.Random(2)
    weights = {bytes([b]): 1e-3 for b in range(256)} | {w: rnd.random() / 50 for w in (b" a", b" ab", b"ab", b"abc", b"ca", b"bc", b" abcab")}
    pieces = sorted(weights)
    lattice = Lattice(pieces, np.log([weights[p] for p in pieces]))
    given = [b"abcab", b"", b"zz", "é".encode(), b"abcabcabc" * 10]
    for long in (512, 0):
        monkeypatch.setattr(lattice_module, "LONG", long)
        for at, matrix in Lattice.by_length(given):
            both = lattice.by_weights(matrix, np.stack((lattice.logp[:-1], np.log(np.full(len(pieces), 0.01)))))
            for i, g, h in zip(at, lattice.totals(matrix), both, strict=True):
                assert g == pytest.approx(math.log(_segmentations(b" " + given[i], weights)), abs=1e-9)
                assert h == pytest.approx((g, math.log(_segmentations(b" " + given[i], dict.fromkeys(pieces, 0.01)))), abs=1e-9)


@pytest.mark.parametrize("size", [1, 7, 127, 128, 129, 1000, 40_000])
def test_long_words_are_scored_by_stretches(size):
    pieces = [p for p, _ in load_pieces(lmscore.MODEL_FILE)][::3] + [bytes([b]) for b in range(256)]
    pieces = sorted(set(pieces))
    lattice = Lattice(pieces, lmscore.power_weights(-np.arange(len(pieces), dtype=float))[2])
    word = np.frombuffer(("e5thingand/unbroken" * size)[:size].encode(), np.uint8)
    began = time.time()
    got = lattice._long(word)
    assert time.time() - began < 20
    if size <= 1000:
        assert got == pytest.approx(lattice.forward(word[None, :])[0, -1], rel=1e-12)


@pytest.mark.parametrize("hot", [0, 3, 1 << 17])
def test_language_model_counts(spark, hot):
    rows = [(i, " ".join(random.Random(i).choice(["the", "The", "of", f"w{i}", "cat"]) for _ in range(i % 9))) for i in range(60)] + [(100, None), (101, BIG), (None, "the x"), (7, "the the")]
    got = sorted(lmscore.score_texts(docs(spark, rows), lmscore.remainder(F.col("doc_id"), 10) != 0, hot_words=hot).collect(), key=lambda r: (str(r.doc_id), r.n_tokens, r.base_score))
    train = [t for d, t in rows if d is not None and crc(d) % 10]
    c = Counter(w for t in train for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    want = sorted(((str(d), len(words(t)) + 1, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), None]), sum(c[w] > 0 for w in [*words(t), None])) for d, t in rows))
    assert [(str(r.doc_id), r.n_tokens, r.n_known) for r in got] == [(d, k, m) for d, k, _, m in want]
    assert [r.base_score for r in got] == pytest.approx([b for *_, b, _ in want])
    assert all(r.train_tokens == n for r in got)
    # the score of a text is that of all segmentations of its words under the likeliest of the weights, and of its end
    vocabulary = load_pieces(lmscore.MODEL_FILE)
    pieces, logps = [p for p, _ in vocabulary], lmscore.power_weights(np.array([x for _, x in vocabulary]))
    ways = []
    for logp in logps:
        weights = dict(zip(pieces, np.exp(logp), strict=True))
        ways.append({w: math.log10(_segmentations(b" " + w, weights)) for _, t in rows for w in set(words(t))})
    likeliest = max(ways, key=lambda lp: sum(k * lp[w] for w, k in c.items() if w is not None))
    ends, inside = math.log10((c[None] + 0.5) / (n + 1)), math.log10(1 - (c[None] + 0.5) / (n + 1))
    plain = sorted((str(d), len(words(t)) + 1, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words(t), None]), ends + sum(likeliest[w] + inside for w in words(t))) for d, t in rows)
    assert [r.score for r in got] == pytest.approx([p[3] for p in plain])
    kinds, once, twice = v - 1, sum(k == 1 for w, k in c.items() if w is not None), sum(k == 2 for w, k in c.items() if w is not None)
    off = (once + 1) / (once + 2 * twice + 2)
    own = lambda w: math.log10(max(c[w] - off, 0) / n + off * kinds / n * 10 ** likeliest[w])
    assert sorted(r.word_score for r in got) == pytest.approx(sorted(math.log10(c[None] / n) + sum(map(own, words(t))) for _, t in rows))
    assert lmscore.score_texts(docs(spark, rows).where("false"), F.lit(True)).count() == 0


def test_vocabulary_has_every_byte():
    pieces = [p for p, _ in load_pieces(lmscore.MODEL_FILE)]
    assert {bytes([b]) for b in range(256)} <= set(pieces) and len(pieces) == len(set(pieces))


def test_classifier_on_held_out_labels(spark):
    from citemill.runtime import table

    sf = SF.replace("0.001", "0.01")
    scored = quality.op7_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    good, bad = scored[scored.quality == 1].score.to_numpy(), scored[scored.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.98
    assert ((scored.predicted == 1) == (scored.quality == 1)).mean() > 0.95


def test_classifier_learns_from_labels_of_the_table(spark):
    rows = [(i, "Some plain words are here, as always." if i % 2 else "zz9 !! QQ zz9 zz9 !!") for i in range(200)]
    labels = spark.range(100_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    out = quality.quality_scores(docs(spark, rows), labels, sample=100).collect()
    assert all((r.score > 0.5) == (r.doc_id % 2 == 1) for r in out)


def _plain_contexts(texts):
    """Context vectors of words and forms by plain loops."""
    places, signs = quality._random_index(quality.BUCKETS, quality.DIMS, quality.FILLED, 1)
    index = quality._form_index()
    words, forms, uses = np.zeros((quality.BUCKETS, quality.DIMS)), np.zeros((quality.FORMS, quality.FORM_DIMS)), np.zeros(quality.FORMS)
    given = [next(iter(quality._words(pa.array([t])))) for t in texts if t and t.split()]
    for _, _, w, _, f in given:
        for i in range(len(w)):
            uses[f[i]] += 1
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(w):
                    words[w[i], places[w[j]]] += signs[w[j]]
                    forms[f[i]] += index[f[j]]
    forms /= np.maximum(uses, 1)[:, None]
    forms -= (uses[:, None] * forms).sum(0) / uses.sum()
    norm = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    return norm(words), norm(forms), given


def test_vectors_are_those_of_plain_loops(spark):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(["The", "cat", "sat", "on", "mats,", "A1", "--", "cat"]) for _ in range(rnd.randrange(12))) for _ in range(40)] + [None, "", "one"]
    words_, forms, given = _plain_contexts(texts)
    df = docs(spark, list(enumerate(texts))).repartition(3)
    got = quality.context_tables(df)
    assert np.allclose(got[0], words_, atol=1e-5) and np.allclose(got[1], forms, atol=1e-5)
    vectors = {r.doc_id: np.frombuffer(r.vector, np.float32) for r in quality.document_vectors(df, got).collect()}
    full = [i for i, t in enumerate(texts) if t and t.split()]
    for i, (_, _, w, _, f) in zip(full, given, strict=True):
        assert np.allclose(vectors[i], np.concatenate((words_[w].mean(0), forms[f].mean(0))), atol=1e-5)
    assert not vectors[40].any() and not vectors[41].any()


def test_temperature_is_the_best_of_its_grid():
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (600, 5))
    y = (x[:, 0] + rng.normal(0, 1.5, 600) > 0).astype(int)
    net = quality.Network(x, y)
    order = np.random.default_rng(7).permutation(600)[:120]
    z = net._logits((x[order] - net.center) / net.scale)
    loss = lambda t: float(np.mean(np.log1p(np.exp(-np.where(y[order] == 1, 1, -1) * z / t))))
    assert all(loss(net.temperature) <= loss(t) + 1e-9 for t in np.exp(np.linspace(-1.5, 2.5, 81)))
    assert loss(net.temperature) < loss(0.25)


def test_classifier_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, 1, 0), (99, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.quality_scores(docs(spark, ODD), labels).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert {r.score for r in quality.quality_scores(docs(spark, ODD), labels.where("false")).collect()} == {0.5}
    assert quality.quality_scores(docs(spark, ODD).where("false"), labels).count() == 0


@pytest.mark.parametrize("n", [0, 1, 39, 41, 1000])
def test_shards_match_the_mixture(spark, n):
    rows = [(i if i % 50 else None, f"t{i % 7}", None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 5}") for i in range(n)]
    df = docs(spark, rows)
    out = sharding.stratified_shards(df, 8, keys=("doc_id", "n_chars")).collect()
    assert len(out) == n
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values(), default=0) - min((sizes.get(s, 0) for s in range(8)), default=0) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(k)) for s, k in sizes.items())
    for s, k in Counter(r.source for r in out).items():
        assert all(abs(sum(r.source == s and r.shard == i for r in out) - k / 8) < 2.01 for i in range(8))


def test_poisson_counts_follow_the_rates(spark):
    steps = mixing.poisson_steps(2.5)
    assert steps[0] == pytest.approx(math.exp(-2.5)) and steps[-1] == pytest.approx(1)
    rows = [(i, "t", "hot" if i % 3 else "rare") for i in range(6000)] + [(9000, None, None), (9001, "", "hot")]
    df = docs(spark, rows)
    out = mixing.poisson_replicate(df.drop("copy"), {"hot": 0.5, "rare": 0.5, "none": 0.0})
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["hot"] - 3001) < 250 and abs(n["rare"] - 3001) < 250 and None not in n
    again = mixing.global_shuffle(out.select("doc_id", "copy"), ("doc_id", "copy")).collect()
    assert sorted(r.position for r in again) == list(range(sum(n.values())))
    assert mixing.poisson_replicate(df.drop("copy").where("false"), {"hot": 1.0}).count() == 0


def test_rates_of_any_size_are_met(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 100, raising=False)
    df = docs(spark, [(i, f"t{i}", None if i < 10 else "hot") for i in range(20_000)]).drop("copy")
    out = mixing.poisson_replicate(df, {"hot": 0.6}, 0.4)  # 800 copies of each null-source row
    n = {r.doc_id: (r["count"], r.last) for r in out.where("source is null").groupBy("doc_id").agg(F.count("*").alias("count"), F.max("copy").alias("last"), F.countDistinct("copy").alias("d")).where("d = count").collect()}
    assert len(n) == 10 and all(abs(k - 800) < 150 and top == k - 1 for k, top in n.values()) and len(set(n.values())) > 3
    assert abs(sum(k for k, _ in n.values()) - 8000) < 450
    assert abs(out.where("source = 'hot'").count() - 12_000) < 550


def test_rows_without_an_id_of_their_own_are_drawn_apart(spark, tmp_path):
    rows = [(None, f"n{i}", "a") for i in range(2000)] + [(7, f"r{i}", "b") for i in range(2000)] + [(i, f"t{i}", "a") for i in range(10_000, 12_000)]
    df = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    n = Counter((r.doc_id, r.source) for r in mixing.poisson_replicate(df, {"a": 1 / 3, "b": 1 / 3}).collect())
    assert abs(n[None, "a"] - 1000) < 150 and abs(n[7, "b"] - 2000) < 220 and abs(sum(n.values()) - 4000) < 320
    df.write.parquet(f"{tmp_path}/documents.parquet")
    named = {f"src{i}": s for i, s in enumerate("ab")}
    spark.read.parquet(f"{tmp_path}/documents.parquet").replace({s: k for k, s in named.items()}, subset="source").write.parquet(f"{tmp_path}/named/documents.parquet")
    out = mixing.op8_mixing(spark, f"{tmp_path}/named").collect()
    assert abs(sum(r.doc_id is None for r in out) - 300) < 90 and abs(sum(r.doc_id == 7 for r in out) - 480) < 110
    assert sorted(r.position for r in out) == list(range(len(out)))
    first = [r for r in out if r.position < len(out) // 2]  # in random order, not side by side
    assert 0.35 < sum(r.doc_id == 7 for r in first) / sum(r.doc_id == 7 for r in out) < 0.65
    mixed = [r.doc_id for r in mixing.mixture(df, {"a": 1 / 3, "b": 1 / 3}).collect()]
    assert sum(a is None and b is None for a, b in zip(mixed, mixed[1:], strict=False)) < len(mixed) // 8


def test_copies_of_a_document_are_spread_over_shards(spark):
    import corpus_pipeline as cp

    rows = [(1, "again", "a")] * 200 + [(None, "again", None)] * 100 + [(i, f"t{i}", "a") for i in range(2, 202)] + [(1, "other", "a")] * 2
    out = cp.sharding(spark, docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars"), SF).collect()
    assert len(out) == len(rows) and {len([r for r in out if r.shard == s]) for s in range(cp.SHARDS)} <= {12, 13}
    n = Counter(r.shard for r in out if r.doc_id == 1 and r.text == "again")
    assert sum(n.values()) == 200 and len(n) > 35 and max(n.values()) < 11
