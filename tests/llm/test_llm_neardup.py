"""SimHash and embedding near-duplicates against brute force."""

from __future__ import annotations

import math
import random
from itertools import combinations

import duckdb
import numpy as np
import pytest
from brute import SF, components, shingles, simhash

from skylane.llm.embeddings import _depths, embedding_components, linked_pairs
from skylane.llm.queries import ORACLE_SQL, QUERIES
from skylane.llm.simhash import drop_near_duplicates, link_fingerprints, simhash_components
from skylane.llm.staging import connected_components

DOCS = "doc_id long, text string"


def _bits(a, b):
    return (a ^ b).bit_count()


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_components_settle_chains_hubs_and_nulls(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 300)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 if k <= 40 else 100 for k in [*range(41), *range(100, 300)]}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    fps = {r.doc_id: simhash(r.text) for r in docs}
    roots = components(sorted(fps), [(a, b) for a, b in combinations(sorted(fps), 2) if _bits(fps[a], fps[b]) <= 3])
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in QUERIES["op1_simhash_near_dedup"](spark, SF).collect()}
    assert got == {(d, f"{fps[d]:016x}", roots[d]) for d in fps}


def test_links_at_every_distance(spark):
    rng, fps = random.Random(5), []
    for k in range(120):
        base = rng.getrandbits(64)
        fps.append(base)
        for d in (1, 2, 3, 4, 5):
            low, span = rng.choice([(0, 64), (0, 22), (22, 21), (43, 21)])  # also all flips inside one third
            fps.append(base ^ sum(1 << b for b in rng.sample(range(low, low + span), d)))
    fps = list(dict.fromkeys(fps))
    nodes = spark.createDataFrame([(n, _signed(f)) for n, f in enumerate(fps)], "node long, fp long")
    want = components(range(len(fps)), [(a, b) for a, b in combinations(range(len(fps)), 2) if _bits(fps[a], fps[b]) <= 3])
    assert {r.node: r.root for r in link_fingerprints(nodes).collect()} == want


def test_simhash_odd_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "a b c d", 9), (3, "a b c d", 9), (4, "A B\tC\x0bd", 9), (None, "a b c d", 9), (5, "z " * 200_000, 9)]
    got = simhash_components(spark.createDataFrame(rows, DOCS + ", fp int")).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == [("1", 1), ("2", 1), ("3", 3), ("3", 3), ("4", 3), ("5", 5), ("None", 3)]
    assert simhash_components(spark.createDataFrame([], DOCS)).count() == 0


def test_drop_near_duplicates_keeps_what_brute_force_keeps(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: frozenset(shingles(r.text, 5)) for r in docs.collect()}
    near = []
    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x == y or min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) >= 0.8 * len(x | y):
            near.append((a, b))
    roots = components(sorted(sets), near)
    assert sum(sets[a] != sets[b] for a, b in near) > 10
    assert {r.doc_id for r in drop_near_duplicates(docs).select("doc_id").collect()} == {d for d in roots if roots[d] == d}


def _words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def _kept_and_wanted(spark, texts):
    """Ids kept of texts numbered from 0, and those that brute force keeps."""
    sets = [frozenset(shingles(t, 5)) for t in texts]
    near = [(a, b) for a, b in combinations(range(len(sets)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    roots = components(range(len(sets)), near)
    kept = {r.doc_id for r in drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), DOCS)).select("doc_id").collect()}
    return kept, {d for d in roots if roots[d] == d}


def test_drop_near_duplicates_finds_texts_with_a_passage_added(spark):
    rng, texts = random.Random(8), []
    for k in range(200):
        base = _words(rng, rng.randrange(60, 300))
        share = (0.24, 0.2, 0.15, 0.26)[k % 4]  # of the base; Jaccard 0.81, 0.83, 0.87 and below 0.8
        texts += [" ".join(base), " ".join(base + ["footer"] * 2 + _words(rng, int(share * len(base)) - 2))]
    kept, want = _kept_and_wanted(spark, texts)
    assert kept == want and 200 < len(want) < 300


def test_drop_near_duplicates_finds_pairs_of_interleaved_templates(spark):
    rng, texts = random.Random(9), []
    page = _words(rng, 240)
    for _ in range(60):  # two pages of each family stand far apart in the order of ids, among all other families
        own = _words(rng, 36)
        texts.append(" ".join(page[:100] + own + page[100:]))
    texts += [t + " " + " ".join(_words(rng, 8)) for t in rng.sample(texts, 60)]
    texts = [" ".join(page[:150])] + texts
    kept, want = _kept_and_wanted(spark, texts)
    assert kept == want and len(want) == 61


def test_drop_near_duplicates_odd_rows(spark):
    rows = [(1, "one two three four five six", "x"), (2, "One  two three four five SIX", "x"), (2, "One  two three four five SIX", "x"), (3, None, "x"), (4, "", "x"),
            (None, "one two three four five six", "x"), (5, "other words stand here now", "x"), (5, "yet another text of the same id", "x")]
    docs = spark.createDataFrame(rows, DOCS + ", id string")
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "3", "5", "5", "None"]
    assert drop_near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_drop_near_duplicates_keeps_a_clean_text_whose_id_has_a_near_copy(spark):
    rng = random.Random(10)
    base, clean = " ".join(_words(rng, 80)), " ".join(_words(rng, 80))
    rows = [(1, base), (2, clean), (2, base + " tail"), (3, clean + " tail")]
    out = sorted(tuple(r) for r in drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert out == [(1, base), (2, clean)]


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, node string")


def test_linked_pairs_are_exact():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 24))
    x = np.repeat(base, 10, axis=0) + rng.normal(size=(400, 24)) * rng.choice([0.02, 0.1, 0.15, 0.2], size=(400, 1))
    axes = np.linalg.qr(rng.normal(size=(24, 24)))[0]
    i, j = linked_pairs(x, x, axes, 0.98)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(k.tolist() for k in np.nonzero(unit @ unit.T >= 0.98))))


@pytest.mark.parametrize("tile_rows", [3, 8192])
def test_embeddings_equal_brute_force(spark, tile_rows):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 20))
    x = np.repeat(base, 12, axis=0) + rng.normal(size=(144, 20)) * 0.13
    rows = [(k, int(k % 3 == 0), v.tolist(), "n") for k, v in enumerate(x)]
    rows += [(200 + k, 0, x[k * 7].tolist(), "n") for k in range(5)]
    odd = [(300, None, x[0].tolist()), (301, 0, None), (302, 0, [0.0] * 20), (303, 0, [math.nan] * 20), (304, 0, [None] * 20), (305, 0, []), (306, 0, [math.inf] * 20), (307, 0, [1.0, 2.0])]
    rows += [(*r, "n") for r in odd]
    good = {r[0]: (r[1], np.array(r[2])) for r in rows if r[0] < 300}
    cos = lambda a, b: a @ b / (np.linalg.norm(a) * np.linalg.norm(b))
    links = [(a, b) for a, b in combinations(good, 2) if good[a][0] == good[b][0] and cos(good[a][1], good[b][1]) >= 0.98]
    roots = components([r[0] for r in rows], links)
    want = {(n, sum(n in p for p in links), roots[n], roots[n] == n) for n in roots}
    got = embedding_components(_vectors(spark, rows), tile_rows=tile_rows).collect()
    assert {tuple(r) for r in got} == want and len(links) > 100
    assert embedding_components(_vectors(spark, [])).count() == 0


def test_overfull_cells_are_named_by_more_dimensions(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([np.tile([1.0, 0, 0, 0, 0, 0], (60, 1)) + 0, rng.normal(size=(200, 6))])
    x[:60, 3] = np.linspace(-1, 1, 60)  # far apart in one direction only
    rows = [(k, k % 2, (v / np.linalg.norm(v)).tolist(), "n") for k, v in enumerate(x)]
    placed = spark.createDataFrame([(0, [0, 0, k, 0]) for k in range(50)] + [(1, [k, 0, 0, 0]) for k in range(50)], "label int, coords array<int>")
    assert {r.label: r.depth for r in _depths(placed, 4, 5).collect()} == {0: 3, 1: 2}
    some, all_ = (sorted(map(tuple, embedding_components(_vectors(spark, rows), tile_rows=n).collect())) for n in (4, 8192))
    assert some == all_ and any(r[1] for r in some)


def test_embeddings_of_one_id_are_not_merged(spark):
    rows = [(1, 0, [1.0, 0.0, 0.0]), (2, 0, [0.0, 1.0, 0.0]), (2, 0, [0.999, 0.001, 0.0]), (3, 0, [0.001, 0.999, 0.0])]
    got = embedding_components(_vectors(spark, [(*r, "n") for r in rows])).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (2, 1, 1, False), (2, 1, 2, True), (3, 1, 2, False)]


def test_embeddings_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    cur = con.execute(ORACLE_SQL["op2_embedding_near_dedup"])
    names = [d[0] for d in cur.description]
    got = QUERIES["op2_embedding_near_dedup"](spark, SF).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(cur.fetchall())


def test_tasks_of_other_stages_let_go_the_words_that_encoding_keeps():
    """A Python worker is used again by later stages; what one operator keeps there is no load on the next."""
    from skylane.llm import pieces, simhash

    vocabulary = {"key": "k", "pieces": ["a", "b"], "scores": [0.0, -1.0], "kinds": [pieces._NORMAL] * 2, "bpe": True}
    codec = pieces._codec(vocabulary)
    assert pieces._codec(vocabulary) is codec  # its own tasks find it again
    assert list(simhash._slices(iter([]))) == [] and not pieces._codecs
