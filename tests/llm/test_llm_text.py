"""Fingerprints, classifier, token counts, pieces and pages against brute force, round trips and held-out labels."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from brute import SF
from pyspark.sql import functions as F

from skylane.llm import chunks, quality, staging
from skylane.llm.html import extract_pages, main_text, second_pass
from skylane.llm.pieces import PieceCodec, check_inner_marks, decode_ids, encode_texts, load_vocabulary
from skylane.llm.queries import QUERIES
from skylane.llm.tokens import _encoder, count_documents, document_token_counts, is_known_store, read_token_files

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


# -- document fingerprints ---------------------------------------------------------------------------------------------
def _ends(data: bytes) -> list[int]:
    """One byte at a time, with a plain 32-bit gear hash of the 16 bytes before each place."""
    gear = [xxhash.xxh64_intdigest(bytes([b]), 17) & 0xFFFFFFFF for b in range(256)]
    ends, start = [], 0
    while start < len(data):
        for end in range(min(start + chunks.LEAST, len(data)), len(data) + 1):
            h = sum(gear[data[end - 1 - k]] << k for k in range(min(16, end))) & 0xFFFFFFFF
            mask = 127 if end - start < chunks.NORMAL else 7
            if end == len(data) or end - start == chunks.MOST or (h >> 9) & mask == 0:
                break
        ends.append(end)
        start = end
    return ends


def test_chunk_ends_equal_a_byte_by_byte_scan():
    rng = random.Random(1)
    for n in (0, 1, 7, 8, 9, 500, 3000):
        data = bytes(rng.choice(b"abcdefgh \n") for _ in range(n))
        assert chunks.chunk_ends(data) == _ends(data)


def test_chunks_resist_shifts():
    rng = random.Random(2)
    data = bytes(rng.randrange(97, 123) for _ in range(5000))
    moved = chunks.containment(chunks.chunk_set(data), chunks.chunk_set(data[:100] + b"inserted" + data[100:]))
    assert moved > 0.9 and chunks.containment(set(), set()) == 1 and chunks.containment(set(), {"a"}) == 0


def test_fingerprints_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in QUERIES["op3_document_fingerprints"](spark, SF).collect()}
    assert len(got) == len(docs)
    for k, d in enumerate(docs):
        text, after = d.text or "", docs[(k + 1) % len(docs)].text or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        own, other, nxt = (chunks.chunk_set(t.encode()) for t in (text, edited, after))
        r = got[d.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == ("".join(sorted(own)), "".join(sorted(other)))
        assert (r.near_edited, r.near_next) == (chunks.containment(own, other), chunks.containment(own, nxt))


def test_fingerprints_do_not_depend_on_ranges_and_odd_rows(spark):
    rows = [(k, f"text number {k} " * (k % 7), "x") for k in range(60)] + [(70, None, "x"), (71, "", "x"), (None, "no place", "x"), (60, "same", "x"), (60, "same", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    one, many = (sorted(map(str, chunks.fingerprints_with_next(docs, range_rows=n).collect())) for n in (1000, 7))
    assert one == many and len(one) == len(rows)
    assert chunks.fingerprints_with_next(docs.limit(0)).count() == 0


def test_fingerprints_of_many_rows_of_one_id(spark):
    rows = [(5, f"text {k} " * (k % 9)) for k in range(3000)] + [(4, "before"), (6, "after"), (6, "after")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    cuts = chunks._range_cuts(docs.selectExpr("doc_id", "xxhash64(cast(text as binary)) AS h"), 300)
    assert len(cuts.places) >= 5
    order = sorted(rows, key=lambda r: (r[0], _hash64(r[1])))
    want = {}
    for k, (i, t) in enumerate(order):
        after, n = order[(k + 1) % len(order)][1], len(t) // 4
        row = (i, hashlib.sha256((t[: len(t) - n] + after[:n]).encode()).hexdigest())
        want[row] = want.get(row, 0) + 1
    got = chunks.fingerprints_with_next(docs, range_rows=300).groupBy("doc_id", "edited_sha256").count().collect()
    assert {(r.doc_id, r.edited_sha256): r["count"] for r in got} == want


def _hash64(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


# -- quality classifier ------------------------------------------------------------------------------------------------
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op4_quality_classifier"](spark, sf).collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) for r in rows)
    test = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    good, bad = [s for s, y in test if y == 1], [s for s, y in test if y == 0]
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    kept = np.mean([s >= 0.3 for s in good])
    print("AUC", auc, "clean kept", kept, "rejected", np.mean([s < 0.3 for s in bad]))
    assert auc > 0.9 and kept > 0.95


def test_classifier_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a good text", 5), (3, "a good text", 5), (None, "x", 5), (4, "w" * 300_000, 5)], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(1, 0), (2, None), (3, 1), (3, 0), (None, 1), (6, 7)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got) and got[2].score == got[3].score and got[0].score == got[1].score
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


# -- token counts ------------------------------------------------------------------------------------------------------
def _blocks(spark, files, size):
    rows = [(f, k, np.array(ids[at : at + size], "<u2").tobytes()) for f, ids in files.items() for k, at in enumerate(range(0, len(ids), size))]
    return spark.createDataFrame(rows, "file string, block long, data binary")


@pytest.mark.parametrize("size,group", [(1, 2), (3, 2), (7, 3), (1000, 2)])
def test_separator_scan_across_blocks(spark, size, group):
    rng, files = random.Random(size), {}
    for f in "abc":
        files[f] = [9 if rng.random() < {"a": 0.5, "b": 0.03, "c": 0}[f] else 1 for _ in range(120)]
    want = set()
    for f, ids in files.items():
        parts = "".join("x" if i == 9 else "." for i in ids).split("x")
        want |= {(f, k, len(p)) for k, p in enumerate(parts) if k < len(parts) - 1 or p}
    assert {tuple(r) for r in count_documents(_blocks(spark, files, size), 9, group_blocks=group).collect()} == want


def test_token_files_are_read_in_blocks(spark, tmp_path):
    ids = [1, 1, 9, 9, *([2] * 50), 9, 3]
    (tmp_path / "x.bin").write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    got = count_documents(read_token_files(spark, str(tmp_path), block_tokens=8), 9)
    assert [r.n_tokens for r in got.orderBy("ordinal").collect()] == [2, 0, 50, 1]


def test_token_counts_equal_the_tokenizer(spark):
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.n_tokens for r in QUERIES["op5_token_counts"](spark, SF).collect()}
    assert got == {r.doc_id: len(coder.encode_ordinary(r.text or "")) for r in docs.collect()}
    odd = spark.createDataFrame([(1, None), (1, None), (None, "a b"), (2, "<|endoftext|>")], "doc_id long, text string")
    counts = sorted((str(r.doc_id), r.n_tokens) for r in document_token_counts(odd, RANKS, 50256, block_tokens=2).collect())
    assert counts == [("1", 0), ("1", 0), ("2", len(coder.encode_ordinary("<|endoftext|>"))), ("None", 2)]
    assert document_token_counts(odd.limit(0), RANKS, 50256).count() == 0


# -- pieces --------------------------------------------------------------------------------------------------------------
def test_pieces_equal_the_library_and_come_back(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = ["", None, " ", "  two  spaces ", "\n\nlines\n", "tabs\tand 🙂 ünïcode", "a" * 20_000, "▁mark", "don't...stop!!!", "x \n y"]
    rows = docs.union(spark.createDataFrame([(-k - 1, t) for k, t in enumerate(odd)], "doc_id long, text string"))
    out = encode_texts(rows, load_vocabulary(MODEL))
    for r in decode_ids(out, load_vocabulary(MODEL)).collect():
        assert r.ids == (sp.encode(r.text) if r.text else []), r.text
        assert r.n_ids == len(r.ids) and r.round_trip == (r.decoded == (r.text or "")) and (r.round_trip or "▁" in r.text)
    assert encode_texts(rows.limit(0), load_vocabulary(MODEL)).count() == 0


def test_unigram_search_finds_the_best_path():
    pieces = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab"]
    scores = [0, -3.0, -2.5, -2.7, -2.9, -3.1, -3.3, -4.7, -3.9, -4.2, -3.05, -4.35]
    codec = PieceCodec({"key": "u", "pieces": pieces, "scores": scores, "kinds": [2] + [1] * 11, "bpe": False})
    rng = random.Random(8)

    def best(t: str) -> float:
        got = [0.0] + [-np.inf] * len(t)
        for e in range(1, len(t) + 1):
            got[e] = max(got[s] + scores[pieces.index(t[s:e])] for s in range(e) if t[s:e] in pieces)
        return got[-1]

    for n in (1, 3, 9, 40, 300):
        text = "".join(rng.choice("abc ") for _ in range(n))
        ids = codec.encode(text)
        marked = "▁" + text.replace(" ", "▁")
        assert "".join(pieces[i] for i in ids) == marked and abs(sum(scores[i] for i in ids) - best(marked)) < 1e-9
        assert list(codec.segments(marked[k : k + 3] for k in range(0, len(marked), 3))) == list(codec.segments([marked]))


# -- pages ---------------------------------------------------------------------------------------------------------------
BODY = "This is the first part of the story that was told by the people of the town, and it is long enough to count."


def test_main_text_leaves_out_what_surrounds_it():
    page = f"""<html><head><title>T</title><script>var x = "<p>no</p>";</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies on this site, and you agree to it.</p></div>
    <article><h1>Title &amp; more</h1><p>{BODY}</p><ul><li>short item</li></ul><p>And   then
    it&nbsp;was over for all of us in the end.</p></article>
    <section id="comments"><p>I liked this story and it was the best that I have read in a year.</p></section>
    <form><p>Subscribe to the letter</p></form><footer><p>All rights are reserved by the owner of this site.</p></footer></body></html>"""
    assert main_text(page) == f"Title & more\n{BODY}\nshort item\nAnd then it was over for all of us in the end."


def test_short_blocks_follow_their_neighbours():
    assert second_pass([1, 0, 0, -1, 0], -1) == [1, 1, -1, -1, -1]
    assert second_pass([0, 0], 1) == [1, 1]


def test_pages_odd_rows(spark):
    rows = [(1, None, "u"), (2, "", "u"), (3, "<p", "u"), (4, "<!-- open", "u"), (5, "plain words only", "u"), (5, "plain words only", "u"), (None, f"<p>{BODY}" * 2000, "u")]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, html string, text string")).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 0), ("2", 0), ("3", 0), ("4", 0), ("5", 16), ("5", 16), ("None", 2000 * (len(BODY) + 1) - 1)]
    whole = QUERIES["op8_html_extraction"](spark, SF)
    assert whole.count() == spark.read.parquet(f"{SF}/pages.parquet").count()
    assert whole.where(F.length("text") != F.col("n_chars")).count() == 0 and whole.where("n_chars > 0").count() > 0.9 * whole.count()


def test_every_character_of_a_long_word_is_a_feature():
    features = quality.Features(18)
    long = "".join(chr(0x4E00 + k * 7 % 5000) for k in range(300))
    parts = [set(features(t)[0].tolist()) for t in (long, long[:200] + "x1y" + long[203:], long[:200])]
    assert parts[0] != parts[1] and len(parts[0] - parts[2]) > 50
    assert set(features("https://a.example/" + "b/" * 10 + "1")[0].tolist()) != set(features("https://a.example/" + "b/" * 10 + "%")[0].tolist())
    assert max(map(len, features.known)) <= 64
    slots = lambda t: set(features(t)[0].tolist())
    for one, other in (("paid 100000 now", "paid 100 now"), ("paid 1000 now", "paid 100 now"), ("soooooooooo good", "soo good"), ("x" * 64, "x" * 65)):
        assert slots(one) != slots(other)
    assert len(slots("x" * 64)) == len(slots("x" * 65))  # no length has features of its own kind


def test_a_class_that_only_contains_an_out_word_keeps_the_text():
    text = "This is the main text of the page and it is long enough to be kept as it stands here with you."
    for page in (
        f'<div class="content has-sidebar"><p>{text}</p></div>', f'<article class="post comments-open"><p>{text}</p></article>',
        f'<div id="content-sidebar-wrap"><p>{text}</p></div>', f'<div class="sidebar"><article><p>{text}</p></article></div>',
    ):
        assert main_text(page) == text
    for name in ("ad", "site-footer", "ad-slot", "box related-posts", "cookie_banner"):
        assert main_text(f'<article><p>{text}</p></article><div class="{name}"><article><p>Other {text}</p></article></div>') == text
        assert main_text(f'<article><p>{text}</p><div class="{name}"><p>Other {text}</p></div></article>') == text


def test_pieces_with_an_inner_space_mark_are_refused():
    check_inner_marks(["\u2581", "\u2581\u2581", "\u2581the", "a"])
    with pytest.raises(ValueError):
        check_inner_marks(["\u2581of\u2581the"])


# -- quality classifier against a plain version -----------------------------------------------------------------------
def _plain_features(text: str | None, bits: int) -> dict[int, float]:
    """Slots and values, one n-gram at a time."""
    import re

    mask, out = (1 << 64) - 1, {}
    words = "".join(f" {c} " if "\u4e00" <= c <= "\u9fff" else c for c in text or "").split()
    cut = lambda s: re.sub(r"(.)\1\1+", r"\1\1", s, flags=re.S)
    shape = lambda w: cut(re.sub(r"\d+", "0", re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a", w)))
    a = [xxhash.xxh64_intdigest(w.lower(), 1) for w in words]
    longest = lambda w: max([n for k in range(len(w)) for n in range(3, len(w) - k + 1) if len(set(w[k : k + n])) == 1], default=0)
    sizes = [xxhash.xxh64_intdigest(f"{len(w)} {longest(w)}", 3) for w in words]
    b = [xxhash.xxh64_intdigest(shape(w), 2) for w in words]
    pair = lambda x, y: (x * 0x9E3779B97F4A7C15 + y * 0xC2B2AE3D27D4EB4F) & mask
    families = [a, list(map(pair, a, a[1:])), b, list(map(pair, b, b[1:])), sizes, [12345 if x == y else 12346 for x, y in zip(a, a[1:])]]
    for k, values in enumerate(families):
        counts: dict[int, int] = {}
        for v in values:
            slot = (((v ^ k) * 0x9E3779B97F4A7C15) & mask) >> (64 - bits)
            counts[slot] = counts.get(slot, 0) + 1
        size = sum(counts.values()) if k == 5 else sum(n * n for n in counts.values()) ** 0.5
        for slot, n in counts.items():
            out[slot] = out.get(slot, 0.0) + n / size
    return out


def _plain_ftrl(rows, bits, alpha, beta, l1, l2, low, epochs):
    """Weights after ``epochs`` readings, one coordinate at a time; the bias is at slot -1."""
    import math

    z, n = {}, {}

    def weight(s):
        if abs(z.get(s, 0.0)) <= l1:
            return 0.0
        return -(z[s] - math.copysign(l1, z[s])) / ((beta + math.sqrt(n[s])) / alpha + l2)

    for _ in range(epochs):
        for x, label in rows:
            x = {**x, -1: 1.0}
            w = {s: weight(s) for s in x}
            p = 1 / (1 + math.exp(-sum(w[s] * v for s, v in x.items())))
            for s, v in x.items():
                g = (p - label) * (1.0 if label else low) * v
                old = n.get(s, 0.0)
                z[s] = z.get(s, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / alpha * w[s]
                n[s] = old + g * g
    return {s: weight(s) for s in z}


def test_scores_equal_a_plain_version(spark):
    import math

    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "of", "Good", "bad", "1234", "aaaa", "#!?", "STOP", "x" * 70 + str(k), "中文字", "!!!!!"]) for _ in range(rng.randrange(0, 30))) for k in range(40)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, k % 3 > 0) for k in range(30)], "doc_id long, quality boolean").selectExpr("doc_id", "int(quality) AS quality")
    order = [r.doc_id for r in labels.orderBy(F.xxhash64("doc_id")).collect()]
    weights = _plain_ftrl([(_plain_features(texts[k], 12), int(k % 3 > 0)) for k in order], 12, 1.0, 1.0, 0.005, 0.01, 2.5, 5)
    got = quality.quality_scores(docs, quality.train(docs, labels, bits=12, updates=150), bits=12)
    for r in got.collect():
        total = weights[-1] + sum(weights.get(s, 0.0) * v for s, v in _plain_features(r.text, 12).items())
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-9 and r.predicted == int(r.score >= 0.3)


def test_stretches_commit_ids_where_paths_meet(monkeypatch):
    """A stretch is taken in by the longest piece, so its first ids are settled long before its end; none is lost."""
    codec, ends = PieceCodec(load_vocabulary(MODEL)), []
    plain = PieceCodec._path
    monkeypatch.setattr(PieceCodec, "_path", lambda self, text, back, width, end: ends.append(len(text)) or plain(self, text, back, width, end))
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for n in (40, 1000, 50_000):
        ends.clear()
        word = "".join(random.Random(n).choice("abcdefghilmnorstu") for _ in range(n))
        assert codec.encode(word).tolist() == sp.encode(word)
        assert len(ends) > n // (2 * codec.longest) and max(ends) <= 4 * codec.longest


def test_token_counts_in_a_store_that_only_spark_opens(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(3)
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (None, "a b")], "doc_id long, text string"))
    want = sorted(map(str, document_token_counts(docs, RANKS, 50256).collect()))
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tokens.link./shared", f"file://{tmp_path}")
    monkeypatch.setattr(staging, "shared_dir", lambda _: "viewfs://tokens/shared")
    for size in (7, 1 << 18):
        assert sorted(map(str, document_token_counts(docs, RANKS, 50256, block_tokens=size).collect())) == want
    assert document_token_counts(docs.limit(0), RANKS, 50256).count() == 0
    assert any(tmp_path.rglob("token-blocks-*"))
    staging.clear_staged(spark)
    assert not any(tmp_path.rglob("*.parquet"))


def test_a_local_session_without_a_shared_folder_gets_one(spark):
    class Bare:
        """A session without the setting."""

        conf = property(lambda self: self)
        sparkContext = property(lambda self: self)
        master, applicationId = "local[2]", "app-without-folder"

        def get(self, *_):
            return None

        def getConf(self):
            return self

    assert staging.shared_dir(Bare()).startswith("file:///") and staging.shared_dir(Bare()) == staging.shared_dir(Bare())
    Bare.master = "spark://host:7077"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(Bare())


def test_stores_have_one_name_for_both_readers():
    assert is_known_store("file:///tmp/x") and is_known_store("/tmp/x") and not is_known_store("viewfs://nowhere/x") and not is_known_store("nothing://x/y")


def test_vocabularies_of_one_size_have_encoders_of_their_own():
    one = {bytes([i]): i for i in range(256)}
    two = {bytes([i]): 255 - i for i in range(256)}
    assert _encoder(("one", ".", one)).encode_ordinary("a") == [97] and _encoder(("two", ".", two)).encode_ordinary("a") == [158]
