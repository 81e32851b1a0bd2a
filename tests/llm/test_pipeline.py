"""The corpus pipeline, stage by stage, against plain Python over whole tables."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from citemill.llm import mixing, quality
from citemill.runtime import materialize, table

from tests.conftest import SF
from tests.llm.common import docs, near_groups, words
from tests.llm.test_texts import _plain_contexts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def md5(*parts):
    return hashlib.md5(":".join("\x00" if p is None else str(p) for p in parts).encode()).hexdigest()


def plain_scores(rows, labels, learn=lambda d: True):
    """Quality score of each (doc_id, text), ids unique."""
    word, form, given = _plain_contexts([t for _, t in rows])
    full = [i for i, (_, t) in enumerate(rows) if words(t)]
    x = np.zeros((len(rows), quality.WIDTH), np.float32)
    for i, (_, _, w, _, f) in zip(full, given, strict=True):
        x[i] = np.concatenate((word[w].mean(0), form[f].mean(0)))
    at = {d: i for i, (d, _) in enumerate(rows)}
    known = sorted((md5(d, "quality"), q, d) for d, q in labels if d in at and learn(d))[: quality.SAMPLE]
    net = quality.Network(x[[at[d] for *_, d in known]], np.array([q for _, q, _ in known]))
    return dict(zip([d for d, _ in rows], net.score(x), strict=True))


def plain_leaks(rows, items):
    """Ids of the rows that hold a window of an item of five tokens or more with its allowed substitutions."""
    found = set()
    for text in [words(t) for t in items]:
        n = len(text)
        size, off = min(n, 13), 2 if n >= 13 else 1 if n >= 8 else 0
        if n < 5:
            continue
        for d, t in rows:
            w = words(t)
            same = Counter(i - j for j, x in enumerate(text) for i in [k for k, y in enumerate(w) if y == x])
            for shift in [s for s, c in same.items() if c >= size - off]:
                hits = [0 <= j + shift < len(w) and w[j + shift] == x for j, x in enumerate(text)]
                if any(sum(hits[s : s + size]) >= size - off for s in range(n - size + 1)):
                    found.add(d)
    return found


def plain_copies(rows):
    """Number of copies of each (doc_id, source)."""
    n = Counter(s for _, s in rows)
    named = sum(n[s] for s in mixing.TARGETS)
    out = Counter()
    for d, s in rows:
        rate = mixing.TARGETS[s] * len(rows) / n[s] if s in mixing.TARGETS else mixing.OTHER * len(rows) / (len(rows) - named)
        u = int(md5(d, mixing.SEED)[:13], 16) / 2**52
        out[d] = sum(step < u for step in mixing.poisson_steps(rate))
    return +out


def plain_shards(rows, shards=40):
    """(doc_id, shard, slot) of each row (doc_id, text, source)."""
    nth, keyed = Counter(), []
    for d, t, s in rows:
        crc = None if t is None else zlib.crc32(t.encode())
        nth[d, crc, s] += 1
        stratum = "null" if s is None else "s" + s
        keyed.append((stratum, md5(d, crc, nth[d, crc, s], 5), d))
    n, rank, placed = Counter(k[0] for k in keyed), Counter(), []
    for stratum, key, d in sorted(keyed):
        rank[stratum] += 1
        odd = 2 * rank[stratum] - 1
        placed.append(((odd * 4096) // (2 * n[stratum]), odd / (2 * n[stratum]), stratum, key, d))
    total, out = len(rows), []
    for at, (*_, d) in enumerate(sorted(placed)):
        shard = at * shards // total
        out.append((d, shard, at - (shard * total + shards - 1) // shards))
    return sorted(out)


def test_whole_pipeline_is_that_of_plain_python(spark):
    import corpus_pipeline as cp

    given = table(spark, SF, "documents")
    rows = {r.doc_id: r for r in given.collect()}
    labels = [(r.doc_id, r.quality) for r in table(spark, SF, "labels").collect()]
    scores = plain_scores([(d, r.text) for d, r in rows.items()], labels)
    assert min(abs(s - quality.REJECT) for s in scores.values()) > 1e-4  # no score so close that rounding decides
    good = [(d, rows[d].text) for d, s in scores.items() if s >= quality.REJECT]
    first = materialize(cp.quality(spark, given, SF), "t")
    assert {r.doc_id for r in first.collect()} == {d for d, _ in good} and first.columns == given.columns
    alone = [(d, rows[d].text) for d, (_, c) in near_groups(good, 5, 80).items() if d == c]
    second = materialize(cp.near_dedup(spark, first, SF), "t")
    assert {r.doc_id for r in second.collect()} == {d for d, _ in alone} and second.columns == given.columns
    leaky = plain_leaks(alone, [r.text for r in table(spark, SF, "benchmark").collect()])
    third = materialize(cp.decontamination(spark, second, SF), "t")
    assert {r.doc_id for r in third.collect()} == {d for d, _ in alone} - leaky and leaky and third.columns == given.columns
    copies = plain_copies([(d, rows[d].source) for d, _ in alone if d not in leaky])
    fourth = materialize(cp.mixing(spark, third, SF), "t")
    assert Counter(r.doc_id for r in fourth.collect()) == copies and fourth.columns == given.columns
    want = plain_shards([(d, rows[d].text, rows[d].source) for d, k in copies.items() for _ in range(k)])
    got = cp.run(spark, SF)
    assert sorted((r.doc_id, r.shard, r.slot) for r in got.collect()) == want and got.columns == [*given.columns, "shard", "slot"]


def test_classifier_query_is_that_of_plain_python(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    labels = [(r.doc_id, r.quality) for r in table(spark, SF, "labels").collect()]
    want = plain_scores(rows, labels, lambda d: zlib.crc32(str(d).encode()) % 4 != 2)
    for r in quality.op7_quality(spark, SF).collect():
        assert r.score == pytest.approx(want[r.doc_id], abs=1e-4) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert r.predicted == (r.score >= 0.7)


def test_stages_take_odd_rows(spark):
    import corpus_pipeline as cp

    same = "one two three four five six seven eight nine ten eleven"
    rows = [(1, same, "src1"), (1, same, "src1"), (2, same, "src2"), (None, None, None), (None, "", "src0"), (None, "no id but some words here", None), (None, "no id but some words here", None),
            (3, "", "src1"), (4, None, "src1"), (5, "word " * 40_000, "src3"), (1, "another text of the same id", "src1"), *[(i, f"text number {i} of a few more words {i * 7}", "src1") for i in range(10, 60)]]
    df = docs(spark, rows)  # with columns named row, version, copy, key, rank and kept
    df = df.selectExpr("*", "9 as shard", "8 as slot", "7 as position", "6 as component")
    kept = materialize(cp.quality(spark, df, SF), "t")
    assert kept.columns == df.columns and kept.count() == len(rows)  # labels name ids of other texts: too few to reject by
    near = materialize(cp.near_dedup(spark, df, SF), "t")
    left = [(r.doc_id, r.text) for r in near.collect()]
    assert near.columns == df.columns and Counter(left) == Counter({(d, t): 1 for d, t, _ in rows if (d, t) != (2, same)})
    assert near.where("copy <> 2 or row <> 1 or shard <> 9 or component <> 6").count() == 0
    clean = cp.decontamination(spark, df, SF)
    assert clean.columns == df.columns and clean.count() == len(rows)
    mixed = materialize(cp.mixing(spark, df, SF), "t")
    assert mixed.columns == df.columns and mixed.where("copy <> 2 or position <> 7").count() == 0
    assert {(r.doc_id, r.text) for r in mixed.collect()} <= {(d, t) for d, t, _ in rows}
    last = cp.sharding(spark, df.select(*COLUMNS), SF)
    assert last.count() == len(rows) and last.columns == [*COLUMNS, "shard", "slot"]
    none = df.where("false")
    for _, stage in cp.STAGES:
        assert stage(spark, none.select(*COLUMNS), SF).count() == 0
