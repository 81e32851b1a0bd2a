"""Near duplicates, decontamination, line dedup, licences and top-k against plain models."""

import itertools
import random

import numpy as np
import pytest
from citemill.llm import decontam, licenses, linededup, neardup, topk
from citemill.llm import rows as llm_rows
from pyspark.sql import functions as F

from tests.llm.common import docs, near_groups


def _copies(seed, base=12, each=9, words=60):
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(base):
        text = [rnd.choice(vocabulary) for _ in range(rnd.randint(3, words))]
        for _ in range(each):
            t = list(text)
            for _ in range(rnd.randint(0, max(1, len(t) // 12))):
                t[rnd.randrange(len(t))] = rnd.choice(vocabulary)
            rows.append((k, " ".join(t)))
            k += 1
    return rows


ODD = [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (1004, "One"), (1005, "x " * 30_000), (1006, "X " * 30_001)]


@pytest.mark.parametrize(("n", "large", "groups", "exact"), [(2, 2, 0, False), (5, 2, 250_000, False), (2, 64, 250_000, False), (2, 2, 250_000, True), (5, 64, 0, True)])
def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, n, large, groups, exact):
    monkeypatch.setattr(neardup, "LARGE", large)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    monkeypatch.setattr(llm_rows, "SMALL_GROUPS", groups)
    monkeypatch.setattr(llm_rows, "HOT", 5)
    rows = _copies(n) + [(2000 + i, "again and again and again") for i in range(9)] + ODD
    if large == 2:
        monkeypatch.setattr(neardup, "DRAWS", (1,))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs(spark, rows), n=n, exact=exact).collect()}
    assert got == near_groups(rows, n, 80)


def test_blocks_of_one_large_component_dont_meet(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rows = [(i, 100, 0) for i in range(40)] + [(50 + i, 200 + i // 2, 0) for i in range(6)] + [(70, 300, 70), (71, 301, 70)]
    dealt = neardup._dealt(spark.createDataFrame(rows, "vertex long, component long, head long")).collect()
    seen = {}
    for r in dealt:
        seen.setdefault((r.cluster, r.x, r.y), set()).add(r.vertex)
    component, met = {v: c for v, c, _ in rows}, set()
    for task in seen.values():
        assert len(task) < 28 and len({component[v] for v in task}) > 1
        met |= {(a, b) for a in task for b in task if a < b}
    cluster = {r.vertex: r.cluster for r in dealt}
    assert all((a, b) in met for a in component for b in component if a < b and cluster[a] == cluster[b] and component[a] != component[b])


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    text = "a b c d e f g h i j"
    rows = [(None, text), (3, text), (3, text), (3, "q r s t u"), (None, "alone here now"), (4, "")]
    out = neardup.near_duplicates(docs(spark, rows), n=2).collect()
    assert len(out) == len(rows)
    assert {r.component_id for r in out if r.n_shingles == 9} == {3}
    left = neardup.without_near_duplicates(docs(spark, rows), n=2).collect()
    assert sorted((str(r.doc_id), r.text) for r in left) == sorted([("3", text), ("3", "q r s t u"), ("None", "alone here now"), ("4", "")])
    assert neardup.near_duplicates(docs(spark, [(1, "a")]).where("false")).count() == 0


def test_masks_leave_no_choice_of_substitutions_out():
    for size, k in [*((n, 0) for n in range(5, 8)), *((n, 1) for n in range(8, 13)), (13, 2)]:
        places = [{o + p for p in m} for m in decontam.MASKS for o in range(size - m[-1])]
        assert all(any(not p & set(e) for p in places) for e in itertools.combinations(range(size), k))


def test_leaks_with_substitutions(spark):
    rnd = random.Random(5)
    item = [f"b{i}" for i in range(20)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "p q r s t u v w"), (3, "five words are just enough"), (4, "too short"), (5, None)], "item_id long, text string")
    filler = lambda k: [f"f{rnd.randrange(10**6)}" for _ in range(k)]
    two, three = list(item), list(item)
    two[6] = two[11] = "other"
    for i in (2, 6, 10, 14, 18):
        three[i] = "other"
    rows = [
        (1, " ".join(filler(9) + [w.upper() for w in item] + filler(9))),
        (2, " ".join(filler(5) + two)),
        (3, " ".join(three)),
        (4, " ".join(filler(4) + "p q r X t u v w".split() + filler(3))),
        (5, "so five words are just enough here"),
        (6, "five words are not enough"),
        (7, None),
        (8, ""),
        (None, " ".join(item[:13])),
        (9, " ".join(item[:12])),
    ]
    got = {(r.doc_id, r.item_id): r.matched for r in decontam.leaks(docs(spark, rows), bench).collect()}
    assert got == {(1, 1): 13, (2, 1): 12, (4, 2): 7, (5, 3): 5, (None, 1): 13, (9, 1): 12}
    brief = spark.createDataFrame([(1, "b3"), (2, "are not enough"), (3, "too short"), (4, "B4 b5"), (4, "b4 b5"), (5, "")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id, r.window, r.matched) for r in decontam.leaks(docs(spark, rows), brief).collect())
    assert got == sorted([(str(d), 1, 1, 1) for d in (1, 2, 3, 9, None)] + [("6", 2, 3, 3)] + [(str(d), 4, 2, 2) for d in (1, 2, 3, 9, None)] * 2)
    assert decontam.decontaminated(docs(spark, rows), brief).count() == len(rows)
    assert {r.doc_id for r in decontam.decontaminated(docs(spark, rows), brief, 2).collect()} == {4, 5, 7, 8}
    long = [(1, "word " * 200_000 + " ".join(item) + " word" * 100), (1, "word " * 200_000 + " ".join(item) + " word" * 100)]
    assert [(r.doc_id, r.matched) for r in decontam.leaks(docs(spark, long), bench).collect()] == [(1, 13)]
    assert decontam.leaks(docs(spark, rows).where("false"), bench).count() == 0 == decontam.leaks(docs(spark, rows), bench.where("false")).count()
    left = {r.doc_id for r in decontam.decontaminated(docs(spark, rows), bench).collect()}
    assert {3, 6, 7, 8} <= left and not left & {1, 2, 4, 5, 9, None}


def _edit1(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return a != b and False
    return any(a[:k] == b[:k] and (a[k + 1 :] == b[k + 1 :] or a[k + 1 :] == b[k:] or a[k:] == b[k + 1 :]) for k in range(max(len(a), len(b))))


def test_lines_within_one_edit_go(spark):
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcdé ") for _ in range(k)).strip() or "z" for k in (1, 2, 3, 10, 47, 48, 49, 50, 97, 98, 200, 3000)]
    lines = []
    for s in base:
        lines.append(s)
        for _ in range(4):
            at, kind = rnd.randrange(len(s) + 1), rnd.randrange(3)
            lines.append((s[:at] + rnd.choice("abxyé") + s[at + (kind == 0) :]) if kind < 2 else s[:at] + s[at + 1 :])
            lines.append(lines[-1][::-1])
    rnd.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 6 : i * 6 + 6])) for i in range(len(lines) // 6 + 1)] + [(500, None), (501, ""), (502, "\n \n"), (None, lines[0])]
    first, order = {}, []
    for i, (_, t) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        for j, s in enumerate((t or "").split("\n")):
            s = s.strip(" ")
            if s and s not in first:
                first[s] = (i, j)
                order.append(s)
    gone = {s for k, s in enumerate(order) if any(_edit1(s, e) for e in order[:k])}
    got = {r.doc_id: (sorted(r.kept), r.near) for r in linededup.kept_lines(docs(spark, rows)).collect()}
    assert sum(n for _, n in got.values()) == len(gone) > 5
    assert sum(len(k) for k, _ in got.values()) == len(order) - len(gone)
    texts = {r.doc_id: r.text for r in linededup.deduplicated(docs(spark, rows)).collect()}
    assert texts[500] is None and texts[501] == "" and texts[502] == "\n \n" and texts[None] == ""
    assert sorted(s.strip(" ") for t in texts.values() for s in (t or "").split("\n") if s.strip(" ")) == sorted(set(order) - gone)


def test_band_misses_are_rare():
    assert [licenses.window_size(m) for m in (1, 3, 4, 6, 7, 9, 10, 13, 37, 49)] == [4, 4, 8, 8, 12, 12, 16, 24, 64, 96]
    for m in range(1, 5000):
        size = licenses.window_size(m)
        assert size % licenses.STARTS == 0 and m + size // licenses.STARTS <= size and (m < 3 or size < 2.01 * m)
        assert (1 - licenses.least_similarity(m)) ** licenses.BANDS <= 1.01e-8


def _contained(text, templates):
    """Best containments by all windows."""
    out = set()
    w = licenses.template_words(text or "")
    have = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    for i, (_, body) in enumerate(templates):
        t = licenses.template_words(body)
        want = {tuple(t[j : j + 3]) for j in range(len(t) - 2)}
        if not want:
            continue
        size = licenses.window_size(len(t) - 2)
        best = None
        for at in range(0, len(have), size // 4):
            own = have[at : at + size]
            got = want & set(own)
            digits = {s for s in want if any(c.isdigit() for x in s for c in x)}
            if got and len(got) >= 0.8 * len(want) and digits <= got:
                places = [at + k for k, s in enumerate(own) if s in want]
                best = max(best or (0,), (len(got), -places[0], -places[-1] - 2))
        if best:
            out.add((i, best[0], -best[1], -best[2]))
    return out


def test_licences_like_all_windows(spark):
    rnd = random.Random(6)
    rows = []
    for k in range(120):
        body = licenses.template_words(rnd.choice(licenses.TEMPLATES)[1])
        for _ in range(rnd.choice([0, 1, 2, len(body) // 20])):
            body[rnd.randrange(len(body))] = rnd.choice(["x", "2", "the"])
        pad = lambda: [rnd.choice(["the", "software", "and", "a", f"w{rnd.randrange(50)}"]) for _ in range(rnd.randrange(60))]
        rows.append((k, " ".join(pad() + body + pad() + (body if k % 9 == 0 else []))))
    rows += [(7, rows[3][1]), (3, rows[3][1]), (None, rows[3][1])]
    got = {}
    for r in licenses.license_matches(docs(spark, rows)).collect():
        got.setdefault(r.row, [r.doc_id, set()])[1].add((r.template, r.matched, r.start, r.end))
    want = sorted(((str(d), sorted(_contained(t, licenses.TEMPLATES))) for d, t in set(rows)), key=str)
    assert sorted(((str(d), sorted(m)) for d, m in got.values()), key=str) == [w for w in want if w[1]] and len(got) > 60


def test_licences_of_another_version_do_not_match(spark):
    rows = [(v, f"This work is licensed under the GNU General Public License, version {v}.") for v in (1, 2, 3)]
    assert {(r.doc_id, r.license) for r in licenses.license_matches(docs(spark, rows)).collect()} == {(2, "GPL-2.0"), (3, "GPL-3.0")}
    assert licenses.license_matches(docs(spark, rows).where("false")).count() == 0


def test_licences(spark):
    mit = licenses.TEMPLATES[2][1]
    rows = [(1, "Hello.\n" + mit.upper() + "\nbye"), (2, "all rights reserved"), (3, "all rights were reserved"), (4, None), (5, ""), (6, "word " * 5000 + licenses.TEMPLATES[5][1]), (None, "Released under the MIT License.")]
    got = {(r.doc_id, r.license) for r in licenses.license_matches(docs(spark, rows)).collect()}
    assert got == {(1, "MIT"), (2, "Proprietary"), (6, "GPL-3.0"), (None, "MIT")}
    span = licenses.license_matches(docs(spark, rows)).where("doc_id = 2").first()
    assert (span.start, span.end, span.matched, span.of) == (0, 2, 1, 1)


def test_licences_of_any_length(spark):
    body = " ".join(f"clause{i % 90} w{i}" for i in range(700))
    templates = (("Body", body), ("MIT", "MIT License"), ("GPL", "GPLv3"), ("None", " - "), ("MIT", "under the MIT License"))
    rows = [(1, "word " * 333 + body + " end" * 90), (2, "the mit LICENSE, the MIT license"), (3, "MIT-style license"), (4, "(GPLv3)"), (5, body[: len(body) // 2]), (6, None), (7, ""), (None, "under the MIT License")]
    got = {(r.doc_id, r.template, r.matched == r.of, r.start, r.end) for r in licenses.license_matches(docs(spark, rows), templates).collect()}
    assert got == {(1, 0, True, 333, 1732), (2, 1, True, 1, 2), (4, 2, True, 0, 0), (None, 1, True, 2, 3), (None, 4, True, 0, 3)}


def _top(rows, queries, k):
    ints = {i: (d, np.floor(1024 * np.asarray(v, float)).astype(int)) for i, (d, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for i, (q, v) in ints.items():
        if q in queries:
            found = sorted((-int(v @ w), 10**9 if e is None else e) for j, (e, w) in ints.items() if j != i and len(w) == len(v))[:k]
            out += [(q, r + 1, None if e == 10**9 else e, -s) for r, (s, e) in enumerate(found)]
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_top_k_with_ties_and_bad_vectors(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(topk, "BLOCK", 16)
        monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rnd = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rnd.normal(0, 1 + i % 3, 20).round(1)]) for i in range(300)]
    rows += [(301, None), (302, []), (303, [float("nan")] * 20), (304, [None] * 20), (305, [float("inf")] * 20), (306, rows[7][1]), (307, rows[7][1]), (None, rows[7][1]), (400, [1.0, 2.0]), (401, [1.0, 1.0]), (500, [0.0] * 20), (100, rows[9][1]), (100, rows[100][1]), (0, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "7 as label", "1 as slab", "2 as id")
    got = sorted((tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect()), key=str)
    assert got == _top(rows, range(0, 600, 100), 10)
    assert topk.top_k(df.where("false"), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("kind", ["float", "double"])
def test_top_k_of_large_components(spark, kind):
    rnd = np.random.default_rng(5)
    cut = (lambda x: float(np.float32(x))) if kind == "float" else float
    scales = (1.0, 2.0**22, 2.0**25) if kind == "float" else (1.0, 2.0**22, 2.0**26)
    rows = [(i, [cut(x) for x in rnd.normal(0, scales[i % 3], 6)]) for i in range(120)]
    huge = [(200, [cut(1e30)] + [0.0] * 5), (201, [cut(-1e30)] + [1.0] * 5)] + ([(202, [1e300] * 6), (203, [1.7e308, -1e200] + [0.0] * 4)] if kind == "double" else [])
    rows += huge
    whole = {i: [min(max(int(np.floor(x * 1024.0)), -int(1.7976931348623157e308)), int(1.7976931348623157e308)) if abs(x) < 1e305 else int(np.sign(x)) * int(1.7976931348623157e308) for x in v] for i, v in rows}
    want = set()
    for q in [0, 100, 200]:
        scores = sorted((-min(max(sum(a * b for a, b in zip(whole[q], v, strict=True)), -(2**63)), 2**63 - 1), i) for i, v in whole.items() if i != q)
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:10])}
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect()} == want
