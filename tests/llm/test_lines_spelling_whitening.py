"""Operators 11 to 13 against plain, slow versions of what they must give."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmatch.llm import lines, spelling, whitening
from docmatch.llm.queries import QUERIES
from tests.llm.cases import docs, prose, texts

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# --- lines -----------------------------------------------------------------------------------------------

def plain_lines(rows, least_chars, least_docs):
    """(id, n_lines, n_dropped, kept text) per row; None is the smallest id."""
    rank = lambda i: (i is not None, i or 0)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[ascii_lower(line.strip(SPACE))].add(rank(i))
    keeper = {k: max(v) for k, v in holders.items() if len(k) >= least_chars and len(v) >= least_docs}
    out = []
    for i, text in rows:
        said = (text or "").split("\n")
        stay = [s for s in said if keeper.get(ascii_lower(s.strip(SPACE)), rank(i)) == rank(i)]
        out.append((i, len(said), len(said) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def line_rows():
    rng = random.Random(5)
    common = ["Licensed under the terms of the licence, see there", "  É" + "x" * 45 + "É\x0b", "\tshort line ", "", "y" * 40, "z" * 39]
    rows = []
    for i in range(40):
        said = [rng.choice(common) for _ in range(rng.randrange(8))] + [f"only in document {i}, and nowhere else at all"]
        rng.shuffle(said)
        rows.append((i, "\n".join(s.upper() if rng.random() < 0.2 else s for s in said)))
    return rows + [rows[3], rows[3], (3, common[0]), (None, common[0]), (None, "\n".join(common * 2)), (None, None), (77, "\n" * 5),
                   (78, "\n".join(common * 300)), (79, None), (80, "")]


@pytest.mark.parametrize("least_chars,least_docs", [(40, 5), (1, 2), (0, 15), (40, 10_000)])
def test_lines_against_plain_python(spark, monkeypatch, least_chars, least_docs):
    rows = line_rows() + [r for r in texts()]
    want = plain_lines(rows, least_chars, least_docs)
    for shard in (lines.SHARD_LINES, 7):
        monkeypatch.setattr(lines, "SHARD_LINES", shard)
        got = lines.dedup_lines(docs(spark, rows), least_chars, least_docs).collect()
        assert sorted(map(tuple, got), key=repr) == want
    assert least_docs > 1000 or any(r[2] for r in want)


def test_line_bitmaps_hold_the_lines_that_stay(spark):
    rows = [(i, f"first {i}\n" + "shared " * 10 + f"\nmiddle {i}\n" + "shared " * 10) for i in range(6)]
    found = {r.doc_id: (r.n_lines, [tuple(k) for k in r.keep]) for r in lines.keep_bitmaps(docs(spark, rows)).collect()}
    assert found == {i: (4, [(0, 1), (2, 1)]) for i in range(5)}


def test_lines_of_an_empty_table(spark):
    assert lines.dedup_lines(docs(spark, [])).collect() == []


def test_lines_stay_in_the_jvm(spark):
    plan = QUERIES["op11_line_dedup"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# --- spelling --------------------------------------------------------------------------------------------

def plain_words(rows, least_chars=7):
    seen = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = ascii_lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least_chars:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def plain_variants(counts, ratio=10):
    near = {w: [] for w in counts}
    ordered = sorted(counts)
    for x, a in enumerate(ordered):
        for b in ordered[x + 1:]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {w: min(vs, key=lambda v: (-counts[v], v)) if vs else None for w, vs in near.items()}
    form = {w: v if v and counts[v] >= ratio * counts[w] else None for w, v in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts)


def sortable(rows):
    return sorted(rows, key=lambda r: r[0])


def word_rows():
    """Words over few letters, with runs of equal ones, ties, chains of forms, and odd rows."""
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choice("abÉ") for _ in range(rng.randrange(4, 9))) for _ in range(400))) for i in range(30)]
    chain = [("raritan" * 1, 2), ("raritans", 25), ("raritansé", 300), ("aaaaaaaa", 40), ("aaaaaaa", 40), ("aaaaaaaaa", 2), ("baaaaaaa", 2)]
    rows += [(500 + k, " ".join([w] * n)) for k, (w, n) in enumerate(chain)]
    return rows + [(1, "x" * 3000), (1, "x" * 3000), (2, "x" * 1500 + "y" + "x" * 1499 + "×"), (2, "x" * 1500 + "y" + "x" * 1499 + "×"), (3, "x" * 2999 + "y"), (3, "x" * 2999 + "y"),
                   (None, "nothing nothing NOTHING Größenordnung größenordnung"), (None, None), (4, ""), (5, "1234 5678")]


def test_variants_against_plain_python(spark):
    rows = word_rows() + texts()
    want = plain_variants(plain_words(rows))
    assert sortable(got_variants(spark, rows)) == sortable(want)
    assert any(f for _, f, *_ in want) and any(r != f for _, f, r, *_ in want if f)


def got_variants(spark, rows, **more):
    return [tuple(r) for r in spelling.variants(docs(spark, rows), **more).select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_variants_with_digests_for_all_and_few_counted_words(spark, monkeypatch):
    rows = word_rows()[:20] + word_rows()[30:]
    want = plain_variants(plain_words(rows))
    monkeypatch.setattr(spelling, "LONG", 8)
    monkeypatch.setattr(spelling, "COUNTED", 3)
    assert sortable(got_variants(spark, rows)) == sortable(want)


def test_variants_of_an_empty_table(spark):
    assert got_variants(spark, []) == []


def test_query_of_variants_over_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    counts = plain_words(rows)
    got = sortable([tuple(r) for r in QUERIES["op13_spelling_variants"](spark, SF).collect()])
    assert [(r[0], r[3]) for r in got] == sorted(counts.items())
    # Neighbours by brute force over deletions, for all words.
    gone = defaultdict(set)
    for w in counts:
        gone[w].add(w)
        for k in range(len(w)):
            gone[w[:k] + w[k + 1:]].add(w)
    near = defaultdict(set)
    for group in gone.values():
        for a in group:
            near[a].update(b for b in group if one_edit(a, b))
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    assert [(r[0], r[1], r[4], r[5]) for r in got] == [(w, form[w], len(near[w]), counts.get(form[w])) for w in sorted(counts)]


# --- whitening -------------------------------------------------------------------------------------------

def plain_whitening(vectors, count=16):
    """n, deviations, covariance's eigenvalues and vectors of the usable vectors, by numpy."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    e, u = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True).reshape(len(s), len(s)))
    far = [sum((n * int(v) - int(t)) ** 2 for v, t in zip(row, s)) for row in x]
    return n, far, e[::-1], u[:, ::-1], x - s / n


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, n int, x string")


@pytest.mark.parametrize("seed,rows,dim,spread", [(1, 200, 20, 1.0), (2, 40, 3, 30.0), (3, 5, 12, 1.0), (4, 300, 8, 1e6)])
def test_whitening_against_numpy(spark, seed, rows, dim, spread):
    rng = np.random.default_rng(seed)
    vectors = (rng.standard_normal((rows, dim)) * spread * np.arange(1, dim + 1) ** 0.5).astype(np.float32).tolist()
    vectors += vectors[:3] * 5
    n, far, e, u, z = plain_whitening(vectors)
    got = whitening.whiten(frame(spark, vectors)).collect()
    rank = min(dim, n - 1)
    assert len(got) == len(vectors) * min(16, rank)
    by = {(r.vec_id, r.component): r for r in got}
    for k in range(min(16, rank)):
        mine = np.array([by[i, k + 1].whitened for i in range(len(vectors))])
        theirs = z @ u[:, k] / math.sqrt(e[k])
        assert np.allclose(mine, theirs if mine @ theirs > 0 else -theirs, rtol=1e-8, atol=1e-8)
        assert math.isclose(by[0, k + 1].explained, e[k] / e.sum(), rel_tol=1e-9)
    assert all(r.n == n and r.deviation == (far[r.vec_id] if far[r.vec_id] < 2 ** 63 else None) and r.identity_error < 1e-9 for r in got)


def test_whitening_leaves_out_what_has_no_numbers(spark):
    good = [[1.0, 2.0, 0.5], [0.0, 1.0, 4.0], [3.0, 1.0, 1.0], [3.0, 1.5, 1.0], [0.0, 1.0, 4.0]]
    odd = [None, [], [1.0, None, 2.0], [1.0, math.nan, 2.0], [1.0, math.inf, 2.0], [1.0], [1e30, 0.0, 0.0]]
    both = whitening.whiten(frame(spark, good + odd)).collect()
    alone = whitening.whiten(frame(spark, good)).collect()
    assert len(both) == len(alone) == 15
    for r, s in zip(sorted(both), sorted(alone)):
        assert r[:4] == s[:4] and math.isclose(r.whitened, s.whitened, rel_tol=1e-12) and r.explained == s.explained
    nulls = frame(spark, good).withColumn("vec_id", F.lit(None).cast("bigint"))
    assert len(whitening.whiten(nulls).collect()) == 15
    assert whitening.whiten(frame(spark, odd[:5])).collect() == []
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [[1.0, 2.0]] * 9)).collect() == []


def test_equal_eigenvalues_share_an_orthonormal_basis(spark):
    """The corners of a cross-polytope: all directions have the same variance."""
    corners = [[float(s * (i == j)) for j in range(6)] for i in range(6) for s in (1, -1)]
    got = whitening.whiten(frame(spark, corners)).collect()
    assert len(got) == 12 * 6 and all(r.identity_error < 1e-12 and math.isclose(r.explained, 1 / 6) for r in got)


def test_polynomial_and_roots_are_exact(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(-50, 50, (30, 6))
    x[:, 5] = x[:, 4]  # a root of zero
    a = (x.T @ x).astype(object)
    c = whitening.characteristic(spark, a)
    powers, m = [], np.eye(6, dtype=int).astype(object)
    for _ in range(6):
        m = m @ a
        powers.append(m.trace())
    want = [Fraction(1)]  # Newton's identities
    for k in range(1, 7):
        want.append(-sum(want[k - i - 1] * powers[i] for i in range(k)) / k)
    assert c == [int(v) for v in reversed(want)] and c[0] == 0
    assert whitening.roots_above([-6, 11, -6, 1], 0, 0) == 3 and whitening.roots_above([-6, 11, -6, 1], 3, 1) == 2
    assert whitening.roots_above([-6, 11, -6, 1], 2, 0) == 1 and whitening.roots_above([0, 0, 4, -4, 1], 1, 0) == 2
    low, high, shift, above, within = whitening.isolated([0, 0, 4, -4, 1], 1, 9)
    assert (above, within) == (0, 2) and low < 2 << shift <= high
    for k, root in ((1, 3), (2, 2), (3, 1)):
        low, high, shift, above, within = whitening.isolated([-6, 11, -6, 1], k, 6)
        assert (above, within) == (k - 1, 1) and low < root << shift <= high and high - low == 1


def test_sums_are_exact_beyond_doubles():
    x = np.array([[2 ** 61, -3], [-(2 ** 61) + 5, 7], [12345678901234567, -1]], np.int64)
    total = whitening.products(iter([x[:2], x[2:]]))
    led = [[1, *map(int, row)] for row in x]
    assert total.tolist() == [[sum(r[i] * r[j] for r in led) for j in range(3)] for i in range(3)]


def test_queries_over_empty_tables(spark, tmp_path):
    for name in ("documents", "embeddings"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("op11_line_dedup", "op12_whitening", "op13_spelling_variants"):
        assert QUERIES[name](spark, str(tmp_path)).collect() == []


def test_line_digests_over_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in plain_lines(rows, 40, 5)]
    assert sorted(map(tuple, QUERIES["op11_line_dedup"](spark, SF).collect())) == sorted(want)
