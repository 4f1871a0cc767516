"""Spelling variants, language identification and the filter audit against plain versions."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from brute import SF, lower
from pyspark.sql import functions as F

from skylane.llm import language, oracle
from skylane.llm.audit import filter_interactions
from skylane.llm.queries import QUERIES
from skylane.llm.spelling import spelling_groups

DOCS = "doc_id long, text string, lang string, source string"
AWKWARD = [
    (1, None, "en", None), (2, "", None, "a"), (None, "Plain words here", "en", "a"), (3, "Plain words here", "de", ""), (3, "Plain words here", "de", ""),
    (4, "plain " * 30_000, "en", "a"), (5, "1234 !!", "fr", "a"), (6, "Plain words here", "en", "a"),
]


# -- spelling variants -------------------------------------------------------------------------------------------------
def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def spelling_brute(rows) -> dict:
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 5
    n = {w: c for w, c in counts.items() if c >= 3}
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    out, form = {}, {}
    for w in n:
        others = [o for size in (len(w) - 1, len(w), len(w) + 1) for o in by_size.get(size, []) if near(w, o)]
        best = min(others, key=lambda o: (-n[o], o), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
        out[w] = [form.get(w), w, n[w], len(others), n[form[w]] if w in form else None]
    for w in n:
        while out[w][1] in form:
            out[w][1] = form[out[w][1]]
    return {w: tuple(v) for w, v in out.items()}


def _spelled(df) -> dict:
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


def test_spelling_query_equals_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = spelling_brute(rows)
    assert _spelled(QUERIES["op11_spelling_variants"](spark, SF)) == want and sum(v[0] is not None for v in want.values()) > 100


def test_spelling_chains_ties_repeated_letters_and_odd_rows(spark):
    # A chain of one letter more each time, counts 3, 6, 12, ...; two forms of one count; doubled letters; letters beyond ASCII.
    words = {"abcde" + "f" * k: 3 << k for k in range(9)} | {"tower": 3, "lower": 9, "mower": 9, "aaaaaa": 4, "aaaaa": 8, "étoile": 5, "etoile": 10, "Étoile": 3, "x×÷yz": 3}
    rows = [(k, (w + " ") * n, None, None) for k, (w, n) in enumerate(words.items())] + AWKWARD + [(None, "odd1odd odd-odd house houses house", None, None)] * 3
    df = spark.createDataFrame(rows, DOCS).withColumn("n", F.lit("clash")).withColumn("word", F.lit(0))
    got, want = _spelled(spelling_groups(df)), spelling_brute([r[:2] for r in rows])
    assert got == want
    assert got["tower"][0] == "lower" and got["abcde"][1] == "abcde" + "f" * 8 and got["aaaaaa"][3] == 1
    assert _spelled(spelling_groups(df.where("false"))) == {}
    with pytest.raises(ValueError):
        spelling_groups(df, factor=1)


# -- language ----------------------------------------------------------------------------------------------------------
def test_language_tables_equal_plain_convolution():
    rng = np.random.default_rng(3)
    network = language.Network.new(3, widths=(2, 3, 5), filters=4, depth=6)
    for a in network.arrays():
        a += rng.normal(0, 0.3, a.shape).astype(np.float32)
    network.embed[language.END] = 0
    window, texts = 16, ["a", "abc", "x" * 16, "Grüße und Küsse " * 9, "", None, "0123456789abcdef0"]

    def plain(text):
        data, total = list(text.encode()), np.zeros(3)
        starts = [s for s in range(0, len(data), window - 4) if s == 0 or s + 4 < len(data)]
        for s in starts:
            piece = data[s : s + window]
            held, piece = len(piece), piece + [language.END] * (window - len(piece))
            top = []
            for w, f in network.filters.items():
                at = [sum(network.embed[piece[p + k]] @ f[k] for k in range(w)) + network.floors[w] for p in range(window - w + 1)]
                top.append(np.maximum(np.max(at, axis=0), 0))
            logits = np.concatenate(top) @ network.dense + network.bias
            total += held * np.exp(logits) / np.exp(logits).sum()
        return total / total.sum()

    whole = pa.array(["skipped", *texts])
    for data in (pa.array(texts), whole[1:], whole.cast(pa.large_string())[1:]):
        got = language.Reader(network, window).texts(data)
        for text, row in zip(texts, got):
            assert np.allclose(row, plain(text) if text else 0, atol=1e-5)


def test_language_gradients_equal_differences():
    rng = np.random.default_rng(4)
    network = language.Network.new(3, widths=(2, 3), filters=4, depth=5)
    network.embed, network.dense, network.bias = (a.astype(np.float64) for a in (network.embed, network.dense, network.bias))
    network.filters, network.floors = ({w: a.astype(np.float64) for w, a in d.items()} for d in (network.filters, network.floors))
    ids, langs = rng.integers(0, 257, (12, 6)), np.array([0, 1, 2, 0, 1, 1])

    def loss():
        top = np.concatenate([network._pooled(ids, w)[0] for w in network.filters], axis=1)
        chances = language._softmax(np.maximum(top, 0) @ network.dense + network.bias)
        return -np.log(chances[np.arange(6), langs]).mean()

    for weights, slope in zip(network.arrays(), network.gradients(ids, langs)):
        flat = weights.reshape(-1)
        places = np.flatnonzero(slope.reshape(-1))[:40]
        assert len(places)
        for k in places:
            flat[k] += 1e-6
            up = loss()
            flat[k] -= 2e-6
            down = loss()
            flat[k] += 1e-6
            assert abs((up - down) / 2e-6 - slope.reshape(-1)[k]) < 1e-5


def test_language_query_is_right_on_held_out_documents(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op12_language_id"](spark, sf).collect()
    assert len(got) == len(docs) and {r.doc_id for r in got} == set(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) / len(held) > 0.98


def test_language_odd_rows(spark):
    rows = [*AWKWARD, *((k, f"{'more plain' if k % 2 else 'einfache'} words", "en" if k % 2 else "de", "a") for k in range(10, 30))]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash")).withColumn("answer", F.lit(1))
    got = language.identify(df, rounds=2).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "lang", "source", "answer", "held_out", "lang_pred", "score"}
    for r in got:
        odd = not r.text or r.text == "1234 !!"
        assert ((r.lang_pred, r.score) == ("und", 0.0)) if odd else (r.lang_pred in {"en", "de"} and 0 < r.score <= 1), r.asDict() | {"text": (r.text or "")[:20]}
    assert len({(r.lang_pred, r.score) for r in got if r.text == "Plain words here"}) == 1
    assert language.identify(df.where("false")).collect() == []
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.train(df.where("text = '1234 !!'")) is None


# -- filter audit ------------------------------------------------------------------------------------------------------
def audit_brute(rows, labels) -> dict:
    first, marks, out = {}, {}, {}
    for doc_id, text, _, _ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    for doc_id, quality, toxic in labels:
        good, bad = marks.get(doc_id, (False, False))
        marks[doc_id] = good or quality == 1, bad or toxic == 1
    for doc_id, text, _, part in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": re.search("[#$%&*|]", t) is not None, "E": doc_id is not None and doc_id > first[t],
        }
        good, toxic = marks.get(doc_id, (False, False)) if doc_id is not None else (False, False)
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                now = fails[f] and not gone
                row = out.setdefault((part or "", order, step), Counter())
                row.update(kept=not (gone or now), removed=now, redundant=fails[f] and gone, good_lost=now and good, toxic_lost=now and toxic)
                row.update(unique_fails=fails[f] and sum(fails.values()) == 1)
                gone = gone or now
    total = Counter()
    for (part, order, step), row in out.items():
        total[part, order[step - 1]] += row["removed"]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(p, o, s): (*(row[n] for n in names), total[p, o[s - 1]]) for (p, o, s), row in out.items()}


def _audited(df) -> dict:
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_query_equals_brute_force_and_sql(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    df = QUERIES["op13_filter_audit"](spark, SF)
    want = audit_brute(docs, labels)
    assert _audited(df) == want and len(want) == 600 * len({d[3] for d in docs})
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    sql = con.execute(oracle.FILTERS).fetch_arrow_table().select(df.columns).to_pylist()
    assert sorted(map(str, sql)) == sorted(str(r.asDict()) for r in df.collect())


def test_audit_odd_rows(spark):
    rows = [*AWKWARD, (7, "A#", None, "a"), (8, "A#", None, "b"), (8, "A#", None, "b"), (9, "word " * 60, None, "a"), (9, " ".join(map(str, range(60))), None, "a")]
    labels = [(3, 1, None), (3, 0, 1), (8, 1, 1), (None, 1, 1), (4, None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("step", F.lit("clash")).withColumn("fails", F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("source", F.lit("clash"))
    assert _audited(filter_interactions(df, marks)) == audit_brute(rows, labels)
    assert _audited(filter_interactions(df, marks.where("false"))) == audit_brute(rows, [])
    assert filter_interactions(df.where("false"), marks).collect() == []
