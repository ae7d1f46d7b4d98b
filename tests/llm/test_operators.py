"""The training-data operators against brute force, round trips and held-out accuracy, with edge cases."""

import collections
import datetime
import hashlib
import html.parser
import itertools
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import bpe, decontam, html_crf, langid, near_dups, pseudonyms, quality_qda, rans, suffix_dedup, weak_supervision
from sievework.llm.registry import vocabulary
from sievework.llm.suffix_array import common_prefixes, sort_integers, suffix_array

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# --- 1 ----------------------------------------------------------------------------------------------


def hits_by_force(text, items, window=10):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    words = find((text or "").translate(LOWER))
    hit, found = set(), set()
    for i, item in items:
        w = find((item or "").translate(LOWER))
        for k in range(max(1, len(w) - window + 1)) if w else ():
            win = w[k : k + window]
            for j in range(len(words) - len(win) + 1):
                if words[j : j + len(win)] == win:
                    hit.update(range(j, j + len(win)))
                    if i is not None:
                        found.add(str(i))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, bool(hit)


def test_decontamination(spark, docs):
    items = [(1, "one two THREE"), (2, "one"), (3, None), (4, "..."), (5, "a b c d e f g h i j k l"), (5, "c d e f g h i j k l m"), (None, "zz yy")]
    texts = ["", None, "One, two three!", "x a b c d e f g h i j k l m n", "d e f g h i j k l m n zz yy", "a b c d e f g h i", "zz-yy one" * 3, "one two threes", "c d e f g h i j k l a b c d e f g h i j"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("hits", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontam.hit_table(df, bench).collect()}
    assert got == {k: hits_by_force(t, items) for k, t in enumerate(texts)}
    assert decontam.hit_table(df.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in decontam.hit_table(df, bench.limit(0)).collect())
    full = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [tuple(r) for r in full.select("item_id", "text").collect()][:6]
    some = docs.where("length(text) < 1500 or text is null").limit(60)
    small = full.where(F.col("item_id").isin([i for i, _ in items]))
    texts = {r.doc_id: r.text for r in some.collect()}
    assert {r.doc_id: tuple(r)[1:] for r in decontam.hit_table(some, small).collect()} == {k: hits_by_force(t, items) for k, t in texts.items()}


def test_items_in_blocks_give_the_same(spark, docs, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = sorted(map(tuple, decontam.hit_table(docs, bench).collect()), key=str)
    build = decontam.build_automata
    monkeypatch.setattr(decontam, "build_automata", lambda b, w: build(b, w, block_bytes=3000))
    assert sorted(map(tuple, decontam.hit_table(docs, bench).collect()), key=str) == one


def test_spans_are_cut(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    df = spark.createDataFrame([(1, "w " * 30 + "(A b, c d e f g h i j) end", 5), (2, "a b c d e f g h i j k", 21), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in decontam.remove_spans(df, bench).collect()}
    assert got == {1: ("w " * 30 + "() end", 66), 3: (None, None)}


def test_spans_are_cut_beside_clashing_columns(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j", "x")], "item_id long, text string, doc_id string")
    df = spark.createDataFrame([(1, "w " * 30 + "a b c d e f g h i j", "keep", 7)], "doc_id long, text string, hits string, HITS_ long")
    out = decontam.remove_spans(df, bench)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, "w " * 30, "keep", 7)]
    assert decontam.remove_spans(df.limit(0), bench).count() == 0


# --- 2, 5, 7 ----------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_qda.score_table(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 40 and sum(r.predicted == r.quality for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_quality_against_densities(spark):
    """Scores from single rows, inverses and determinants, without sums, factors or tasks."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: np.array(quality_qda.statistics(r.text)) for r in docs.collect()}
    learn = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    x = {k: np.array([rows[i] for i, y in learn.items() if y == k and i in rows]) for k in (0, 1)}
    cov = {k: np.cov(v.T, bias=True) for k, v in x.items()}
    n = {k: len(v) for k, v in x.items()}
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    a, b = quality_qda.SHRINK_POOLED, quality_qda.SHRINK_IDENTITY
    shrunk = {k: (1 - b) * ((1 - a) * cov[k] + a * pooled) + b * np.diag(np.diag(pooled) + 1e-4) for k in (0, 1)}

    def density(v, k):
        d = v - x[k].mean(axis=0)
        return -0.5 * (d @ np.linalg.solve(shrunk[k], d) + np.linalg.slogdet(shrunk[k])[1])

    for r in quality_qda.score_table(docs, labels).collect():
        odds = (density(rows[r.doc_id], 1) - density(rows[r.doc_id], 0)) / quality_qda.TEMPERATURE + np.log(n[1] / n[0])
        want = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        assert abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= 0.3)


def test_quality_beside_clashing_columns(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    wide = docs.withColumn("x", F.lit("clash")).withColumn("score", F.lit(-1))
    out = quality_qda.keep_good(wide, labels)
    assert out.columns == wide.columns and {r.x for r in out.collect()} <= {"clash"}
    assert quality_qda.score_table(wide, labels).count() == docs.count()


def test_quality_edges(spark, docs, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = quality_qda.score_table(docs, labels)
    assert got.count() == docs.count() and got.where("score is null or isnan(score)").count() == 0
    assert quality_qda.score_table(empty, labels).count() == 0
    none = quality_qda.score_table(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r.score for r in none] == [0.5]
    assert quality_qda.keep_good(docs, labels).columns == docs.columns


def test_rule_counts(docs, rows):
    got = collections.defaultdict(set)
    for r in weak_supervision.verdicts(docs).collect():
        got[r.doc_id].add(tuple(r)[1:7])
    for r in rows:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        count = collections.Counter(grams)
        cov = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cov), len(w) < 10 or 100 * len(cov) > 20 * len(w))
        assert want in got[r.doc_id]


def test_estimates_by_rows(spark):
    """Expectation and maximisation over single documents and products of likelihoods, without patterns or odds."""
    w = weak_supervision
    voted = w.votes(w.statistics(spark.read.parquet(f"{SF}/documents.parquet").withColumn("kept", F.lit("clash")).select("doc_id", "text"))).cache()
    rows = voted.collect()
    v = np.array([[r[f"vote_{x}"] for x in w.RULES] for r in rows])
    share, acc = w.PRIOR, np.full(len(w.RULES), w.START)

    def good_of():
        like = lambda up, down: np.prod(np.where(v > 0, up, np.where(v < 0, down, 1.0)), axis=1)
        g, b = share * like(acc, 1 - acc), (1 - share) * like(1 - acc, acc)
        return g / (g + b)

    for _ in range(w.ROUNDS):
        g = good_of()[:, None]
        share = (g.sum() + w.SMOOTHING * w.PRIOR) / (len(v) + w.SMOOTHING)
        right = np.where(v > 0, g, np.where(v < 0, 1 - g, 0)).sum(axis=0)
        acc = np.clip((right + w.SMOOTHING * w.START) / ((v != 0).sum(axis=0) + w.SMOOTHING), w.LOWEST, w.HIGHEST)
    want = dict(zip([r.doc_id for r in rows], good_of(), strict=True))
    for r in w.judged(voted).collect():
        assert abs(r.posterior - want[r.doc_id]) < 1e-6
        assert r.kept == (not r.base_failed and r.posterior >= w.KEEP_AT)


def test_rule_verdicts(spark, empty):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = weak_supervision.verdicts(docs).join(labels, "doc_id").where("not base_failed").collect()
    assert sum(r.kept == (r.quality == 1) for r in got) / len(got) > 0.95
    assert weak_supervision.verdicts(empty).count() == 0


def test_phrases_against_search(docs, rows):
    samples = langid.sample(docs)
    lang = langid.Languages(samples)
    lang.prepare()
    whole = {n: " ".join(filter(None, map(langid.normalised, t))) for n, t in samples.items()}
    for text in [r.text or "" for r in rows if len(r.text or "") < 900][:12] + ["ЖЖ abc", "x" * 50]:
        t = langid.normalised(text)
        for name, n in zip(lang.names, lang.phrases([lang.symbols(text)])[0], strict=True):
            assert phrases_by_force(t, whole[name]) == n


def phrases_by_force(t, whole):
    i = count = 0
    while i < len(t):
        k = 1
        while i + k <= len(t) and t[i : i + k] in whole:
            k += 1
        i += max(1, k - 1)
        count += 1
    return count


@pytest.mark.parametrize("block", [3, 16, 50])
def test_phrases_across_blocks(monkeypatch, block):
    """Blocks give the phrases of the whole text, also where they never fall into step, with rare characters too."""
    rng = random.Random(block)
    monkeypatch.setattr(langid, "BLOCK", block)
    monkeypatch.setattr(langid, "COLUMNS", 3)
    some = lambda n, pool="abcdeé ж中": "".join(rng.choice(pool) for _ in range(n))
    samples = {"p": ["ab" * 40 + some(60)], "q": [some(200)], "r": [some(90, "xyz ")]}
    lang = langid.Languages(samples)
    lang.prepare()
    texts = [some(rng.randint(0, 400)) for _ in range(40)] + ["ab" * 300, "a" * 333, "xyz " * 70, "é", ""]
    got = lang.phrases([lang.symbols(t) for t in texts])
    for t, row in zip(texts, got, strict=True):
        for name, n in zip(lang.names, row, strict=True):
            assert phrases_by_force(langid.normalised(t), langid.normalised(samples[name][0])) == n


def test_languages_of_any_length_and_script(spark):
    """Short labelled texts, and scripts of many characters, are learned."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    short = docs.withColumn("text", F.substring("text", 1, 250))
    got = langid.identify(short).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'").collect()
    assert len(got) > 150 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.9
    french = docs.withColumn("text", F.when(F.col("lang") == "fr", F.substring("text", 1, 290)).otherwise(F.col("text")))
    got = langid.identify(french).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang = 'fr'").collect()
    assert sum(r.lang_pred == "fr" for r in got) / len(got) > 0.9
    rng = random.Random(9)
    rows = []
    for k, first in enumerate((0x4E00, 0x5E00)):
        weights = [1 / (i + 1) for i in range(3000)]
        rows += [(10**6 + 1000 * k + i, "".join(chr(c) for c in rng.choices(range(first, first + 3000), weights, k=rng.randint(40, 900))), f"x{k}") for i in range(150)]
    made = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    table = docs.select("doc_id", "text", "lang").union(made)
    got = langid.identify(table).join(made.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 40 and all(r.lang == r.lang_pred for r in got)
    long = spark.createDataFrame([(1, "uno dos tres " * 9000, "es"), (2, "un deux trois " * 9000, "fr"), (3, "deux trois un", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(long).collect()}[3] == "fr"


def test_languages_in_groups_give_the_same(spark, docs, monkeypatch):
    want = sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(docs.withColumn("least", F.lit("clash"))).collect())
    monkeypatch.setattr(langid, "TABLE_BYTES", 1)
    assert len(langid.groups(langid.sample(docs))) > 1
    assert sorted((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(docs).collect()) == want


def test_ties_between_languages(spark):
    rows = [(1, "same text here", "b"), (2, "same text here", "a"), (7, "same text", None), (7, "same text", None)]
    got = langid.identify(spark.createDataFrame([(i + 10 * k, t, x) for k in range(5) for i, t, x in rows], "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in got} == {"a"} and len(got) == 20


def test_languages(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(table).join(table.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    odd = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).where("doc_id > 900000").collect()}
    assert odd[900001] == odd[900002] == odd[900003] == odd[900010] == ("und", 0.0)
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


# --- 3, 6 -------------------------------------------------------------------------------------------

ODD_TEXTS = ["", " ", "  a  b ", "Hello<|startoftext|> World <|endoftext|>!!", "ΣΑΣ İstanbul ẞ", "a\x1cb \x85c\xa0d", "it's we're I'LL 123 ½ 四", "x" * 900, "é Å", "😀 👨‍👩‍👧", "a \n b\n c", "tab\t x", " lead", "trail "]


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    coder = rans.Coder(rans.quantised(np.bincount(rng.zipf(1.3, 50_000) % 5000, minlength=5000)))
    blocks = [(rng.zipf(1.3, n) % 5000).astype(np.uint32) for n in (1, 5, 64, 65, 16384, 3000)]
    words, states = coder.encode(blocks)
    for a, b in zip(blocks, coder.decode(words, states, np.array([len(b) for b in blocks])), strict=True):
        assert (a == b).all()


def test_token_files(docs, rows, empty):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = [e.tolist() for e in rans.PieceTokens(path).encode(ODD_TEXTS)]
    assert got == [e.ids for e in library.encode_batch(ODD_TEXTS, add_special_tokens=False)]
    out = sorted(map(tuple, rans.round_trip(docs, path).collect()))
    want, start = [], 0
    texts = sorted(rows, key=lambda r: r.doc_id)
    for r, e in zip(texts, library.encode_batch([r.text or "" for r in texts], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 0], dtype="<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert out == sorted(want)
    assert rans.round_trip(empty, path).count() == 0


def test_damage_is_noticed():
    coder = rans.Coder(rans.quantised(np.ones(100, dtype=np.int64)))
    row = rans._pack(coder, 0, 0, 0, [1], [np.arange(90, dtype=np.uint32)])
    assert rans.unpack(coder, row)[1][0].tolist() == list(range(90))
    row["checks"] = bytes(4)
    with pytest.raises(ValueError, match="checksum"):
        rans.unpack(coder, row)


def test_words_as_the_library_has_them(docs, rows, empty):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    code = bpe.WordCoder(path)
    rng = random.Random(3)
    pool = "abcXYZ 'stremvd123\n\t éÉßΣσ中文😀́<|>endoftext.,!½²"
    texts = ODD_TEXTS + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(500)]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert code.joined(t) == (" ".join(map(str, e.ids)), library.decode(e.ids, skip_special_tokens=False))
    got = {tuple(r) for r in bpe.digest_table(docs, path).collect()}
    for r, e in zip(rows, library.encode_batch([r.text or "" for r in rows], add_special_tokens=False), strict=True):
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.doc_id, len(e.ids), sha(" ".join(map(str, e.ids))), sha(library.decode(e.ids, skip_special_tokens=False))) in got
    assert bpe.digest_table(empty, path).count() == 0
    assert code._heap([code.first[ord(c)] for c in "tokenization"] * 60) == code._scan([code.first[ord(c)] for c in "tokenization"] * 60)


# --- 4 ----------------------------------------------------------------------------------------------


def test_suffix_arrays():
    rng = random.Random(5)
    for _ in range(300):
        strings = [bytes(rng.choice(b"ab\x00\xffc"[: rng.randint(1, 5)]) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 6))]
        t, _, sa = suffix_array(strings)
        u = [x for i, s in enumerate(strings) for x in [*(1000 + b for b in s), i]]
        assert sa.tolist() == sorted(range(len(u)), key=lambda i: u[i:])
        p = common_prefixes(t, sa, 10)
        for a, b in zip(sa.tolist(), sa.tolist()[1:], strict=False):
            n = 0
            while n < 10 and max(a, b) + n < len(u) and u[a + n] == u[b + n]:
                n += 1
            assert p[b] == n
        s = [rng.randint(0, rng.randint(0, 4)) for _ in range(rng.randint(1, 25))]
        assert sort_integers(s, 5) == sorted(range(len(s)), key=lambda i: s[i:])


def cuts_by_force(rows, length=50):
    seen, out = {}, []
    for r in sorted(rows, key=lambda r: r.doc_id):
        raw = (r.text or "").encode()
        mask = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if seen.get(raw[i : i + length], r.doc_id) < r.doc_id:
                mask[i : i + length] = True
        for i in range(len(raw) - length + 1):
            seen.setdefault(raw[i : i + length], r.doc_id)
        spans = int((np.diff(np.concatenate([[0], mask.view(np.int8)])) == 1).sum())
        kept = np.frombuffer(raw, np.uint8)[~mask].tobytes()
        out.append((r.doc_id, len(raw), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [4000, 1])
def test_cuts(docs, rows, empty, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    assert sorted(map(tuple, suffix_dedup.cut_table(docs).collect())) == cuts_by_force(rows)
    assert suffix_dedup.cut_table(empty).count() == 0


def test_cuts_under_one_id(spark):
    a, b = "the quick brown fox jumps over the lazy dog again and again " * 2, "z" * 130
    df = spark.createDataFrame([(1, a + b), (1, b + a), (2, "xx" + a), (None, a), (3, b)], "doc_id long, text string")
    got = sorted([tuple(r)[:4] for r in suffix_dedup.cut_table(df).collect()], key=str)
    assert got == sorted([(1, 250, 0, 0), (1, 250, 0, 0), (2, 122, 120, 1), (None, 120, 0, 0), (3, 130, 130, 1)], key=str)


def test_long_runs_of_one_period(spark):
    texts = [(unit * (n // len(unit) + 1))[:n] for n in (40_000, 70_000, 100_000) for unit in ("z", "word ", "a short line of one text\n")]
    rows = [(10 * k + i, f"{'ab'[i]}{k}" + t) for k, t in enumerate(texts) for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.cut_table(df).collect())) == cuts_by_force(df.collect())


def test_anchors_alone_are_not_cut_out(spark):
    """Segments that share their anchor only need no shard; those that share a string with it do."""
    rng = random.Random(9)
    some = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    for beside, most in ((0, 0), (17, 800), (40, 10_000)):
        rows = []
        for k in range(400):
            g = some(16 + beside)
            rows += [(2 * k, some(60) + g + some(60)), (2 * k + 1, some(60) + g + some(60))]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        further = suffix_dedup.compared(df.selectExpr("doc_id", "0L as fp", "text"), 4).where(F.col("how") != suffix_dedup.REMOVED).count()
        assert further <= most and (further > 0) == (most > 0)
        assert sorted(map(tuple, suffix_dedup.cut_table(df).collect())) == cuts_by_force(df.collect())


def test_anchors_that_repeat(spark):
    """A+G+x+G+B and A+G+C: the common strings hold the first of two places of G."""
    rng = random.Random(8)
    some = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    rows = []
    for k in range(400):
        a, g = some(rng.randint(34, 50)), some(16)
        rows += [(2 * k, a + g + some(rng.randint(1, 15)) + g + some(60)), (2 * k + 1, a + g + some(60))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.cut_table(df).collect())) == cuts_by_force(df.collect())


# --- 8 ----------------------------------------------------------------------------------------------


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def test_pseudonyms(spark):
    key = "k1"
    texts = ["4111111111111111", "4111111111111111 and 4111 1111 1111 1111", "+1 (974) 555-3436", "97.51.17.173 300.1.1.1", "2021-02-28 2021-02-30 31.12.1999", 'token = "908038b7daaf91e730d2f64001c5abcd"', "und.34@mail7.example.com", None, "", "plain 5 words", "1234567890123456", "call +4915112345678 now", "+35312345678"]
    got = [r.text for r in pseudonyms.pseudonym_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key).orderBy("doc_id").collect()]
    assert luhn(got[0]) and got[0] != texts[0] and got[1].startswith(got[0])
    assert got[1].split(" and ")[1].replace(" ", "") == got[0] and got[1][25] == " "
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[2]) and got[2] != texts[2]
    ip, bad = got[3].split(" ")
    assert bad == "300.1.1.1" and all(int(x) < 256 for x in ip.split("."))
    days = got[4].split(" ")
    assert re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", days[0]) and days[1] == "2021-02-30" and re.fullmatch(r"\d\d\.\d\d\.(19|20)\d\d", days[2])
    assert re.fullmatch(r'token = "[0-9a-f]{32}"', got[5]) and got[5] != texts[5]
    assert re.fullmatch(r"[a-z]{3}\.\d\d@[a-z]{4}\d\.example\.com", got[6]) and got[6] != texts[6]
    assert got[7:11] == [None, "", "plain 5 words", "1234567890123456"]
    assert re.fullmatch(r"call \+49\d{11} now", got[11]) and got[11] != texts[11]
    assert re.fullmatch(r"\+353\d{8}", got[12]) and got[12] != texts[12]


def _prf(key, tag, half):
    return int(hashlib.sha256(f"{key}|{tag}|{half}".encode()).hexdigest()[:15], 16)


def _feistel(a, b, size_a, size_b, tag, key):
    for i in range(8):
        if i % 2 == 0:
            a = (a + _prf(key, f"{tag}:{i}", b) % size_a) % size_a
        else:
            b = (b + _prf(key, f"{tag}:{i}", a) % size_b) % size_b
    return a, b


def _digits(s, tag, key):
    n = len(s) // 2
    a, b = _feistel(int(s[:n]), int(s[n:]), 10**n, 10 ** (len(s) - n), f"{tag}:{len(s)}", key)
    return f"{a:0{n}d}{b:0{len(s) - n}d}"


def _classes(s, tag, key, groups):
    half = len(s) // 2
    parts = [s[:half], s[half:]]
    for r in range(4):
        own, digest = parts[r % 2], hashlib.sha256(parts[1 - r % 2].encode()).hexdigest()
        new = ""
        for i, c in enumerate(own):
            k = _prf(key, f"{tag}:{r}:{i}", digest)
            new += next((g[(g.index(c) + k) % len(g)] for g in groups if c in g), c)
        parts[r % 2] = new
    return "".join(parts)


def test_pseudonyms_against_a_second_network(spark):
    """The same Feistel network written in Python."""
    rng = random.Random(12)
    key, groups = "second", ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    rows = []
    for _ in range(60):
        body = str(rng.randint(10**14, 10**15 - 1))
        card = next(body + d for d in "0123456789" if luhn(body + d))
        new = _digits(card[:-1], "card", key)
        rows.append((card, next(new + d for d in "0123456789" if luhn(new + d))))
        ip = [rng.randint(0, 255) for _ in range(4)]
        a, b = _feistel(ip[0] * 256 + ip[1], ip[2] * 256 + ip[3], 65536, 65536, "ip", key)
        rows.append((".".join(map(str, ip)), f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"))
        digits = str(rng.randint(10**9, 10**10 - 1))
        new = _digits(digits, "phone", key)
        rows.append((f"+1 ({digits[:3]}) {digits[3:6]}-{digits[6:]}", f"+1 ({new[:3]}) {new[3:6]}-{new[6:]}"))
        local, host = "".join(rng.choices("abcXYZ019._", k=rng.randint(1, 12))), "".join(rng.choices("abz-9", k=rng.randint(1, 9)))
        rows.append((f"{local}@{host}.example.org", f"{_classes(local, 'email', key, groups)}@{_classes(host, 'host', key, groups)}.example.org"))
        secret = "".join(rng.choices("0123456789abcdef", k=32)) + "a"
        rows.append((f"token: {secret}", f"token: {_classes(secret, 'secret', key, ('0123456789abcdef',))}"))
        day = datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73049))
        n = (day - datetime.date(1900, 1, 1)).days
        while True:
            a, b = _feistel(n // 270, n % 270, 271, 270, "date", key)
            n = a * 270 + b
            if n < 73049:
                break
        rows.append((day.strftime("%d.%m.%Y"), (datetime.date(1900, 1, 1) + datetime.timedelta(n)).strftime("%d.%m.%Y")))
    df = spark.createDataFrame([(i, f"see {a} there") for i, (a, _) in enumerate(rows)], "doc_id long, text string")
    got = [r.text for r in pseudonyms.pseudonym_table(df, key).orderBy("doc_id").collect()]
    assert got == [f"see {b} there" for _, b in rows]


def test_pseudonyms_of_hostile_texts(spark):
    """Long runs and hosts of many labels: linear time, no recursion."""
    n = 1_000_000
    texts = ["a" * n, "x@" + "a." * 100_000 + "com", "1" * n, "key" + " " * n, "key=" * (n // 4), "a@" * (n // 2), "1.2." * (n // 4), "12 " * (n // 3), "+1 " * (n // 3), "z" * 20_000 + "@host.org"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    began = time.time()
    got = {r.doc_id: (r.text, r.n_replaced) for r in pseudonyms.pseudonym_table(df, "k").collect()}
    assert time.time() - began < 60
    assert got[0] == (texts[0], 0) and got[1][1] == 1 and len(got[1][0]) == len(texts[1]) and got[2] == (texts[2], 0) and got[9][1] == 1


def test_pseudonyms_beside_clashing_columns(spark):
    df = spark.createDataFrame([(1, "1.2.3.4", "a", 7)], "doc_id long, text string, pii string, n_chars long")
    out = pseudonyms.pseudonymise(df, "k")
    row = out.first()
    assert out.columns == df.columns and row.pii == "a" and row.n_chars == len(row.text) and row.text != "1.2.3.4"


def test_permutations_are_one_to_one(spark):
    nums = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("s"))
    assert nums.select(pseudonyms._digits(F.col("s"), "t", "k").alias("p")).distinct().count() == 1000
    days = spark.range(3000).select(F.date_format(F.date_add(F.to_date(F.lit("1999-01-01")), F.col("id").cast("int")), "yyyy-MM-dd").alias("s"))
    out = days.select(pseudonyms._date(F.col("s"), "k").alias("p"))
    assert out.distinct().count() == 3000 and out.where(F.to_date("p").isNull()).count() == 0
    words = spark.createDataFrame([(a + b + c,) for a in "abz" for b in "019" for c in "AQ-"], "s string")
    assert words.select(pseudonyms._by_class(F.col("s"), "t", "word", "k").alias("p")).distinct().count() == 27


def test_pseudonymised_documents(docs, empty):
    out = pseudonyms.pseudonymise(docs, "k")
    assert out.columns == docs.columns and len(out.collect()) == docs.count() and pseudonyms.pseudonymise(empty, "k").count() == 0
    nodes = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in nodes and "Arrow" not in nodes


# --- 9 ----------------------------------------------------------------------------------------------


def test_pages(spark):
    field = html_crf.trained()
    right = total = 0
    for page, labels in html_crf.labelled_pages(120, seed=99):
        blocks = html_crf.leaf_blocks(page.replace(html_crf.MARK, ""))
        assert len(blocks) == len(labels)
        if blocks:
            right += int((field.decode(html_crf.features(blocks)) == np.array(labels)).sum())
            total += len(labels)
    assert right / total > 0.98
    rows = [
        (1, "u", "<body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One\n two&nbsp;three, and a sentence.<p><b>More <br>text follows here.</article><footer>&copy; x</footer>"),
        (2, None, None),
        (3, "u", ""),
        (4, "u", "<script>var a='<p>no</p>'</script><style>p{}</style>"),
    ]
    got = {r.page_id: (r.text, r.n_chars) for r in html_crf.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1][0] == "A & B\n\nOne two three, and a sentence.\n\nMore text follows here." and got[1][1] == len(got[1][0])
    assert got[2] == got[3] == got[4] == ("", 0)


def test_pages_of_the_table(spark, tmp_path):
    """Every page of the smallest table against its article, cut by the library's parser."""

    class Article(html.parser.HTMLParser):
        def __init__(self):
            super().__init__()
            self.blocks, self.inside = [], False

        def handle_starttag(self, tag, _):
            self.inside = self.inside or tag == "article"
            if tag in ("article", "h1", "h2", "p", "li"):
                self.blocks.append("")
            elif tag == "br":
                self.handle_data(" ")

        def handle_endtag(self, tag):
            self.inside = self.inside and tag != "article"

        def handle_data(self, data):
            if self.inside:
                self.blocks[-1] += data

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {}
    for r in pages.collect():
        a = Article()
        a.feed(r.html)
        want[r.page_id] = "\n\n".join(t for t in (" ".join(b.split()) for b in a.blocks) if t)
    again = pages.union(pages).withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(-1))
    got = html_crf.extracted(again).collect()
    assert len(got) == 2 * len(want) and all(r.text == want[r.page_id] and r.n_chars == len(r.text) for r in got)
    assert html_crf.extracted(pages.limit(0)).count() == 0


def test_nothing_of_an_article_is_dropped(spark):
    page = "<html><body><nav><a href=/>Home</a></nav><article><h1>Formulas of the year</h1><p>The sum <math><mi>x</mi>+<mi>y</mi></math> is shown here, and it is long enough.</p><noscript><p>A picture of the sum, told in words for all who read.</p></noscript><svg><text>Axis of time</text></svg><p>And so it ends, with a last sentence.</p></article></body></html>"
    text = html_crf.main_text(page, html_crf.trained())
    assert all(x in text for x in ("The sum x+y is shown", "told in words", "Axis of time", "it ends")) and "Home" not in text


def test_hostile_pages_take_linear_time():
    n = 50_000
    pages = ["<a " * n, '<a "' * n, '<a x=">"' * n + 'x="', "<div>a" * n, "<ul>" + "<div>" * n + "<li></li>" * n, "<div>" * n + "</section>" * n, "<!-- " * n, "<script></script" * n, "<script>" * n, "<a " + "= " * n + ">", "&amp" * n, "<" * n, "<p>" * n, "<td>" * n]
    began = time.time()
    for p in pages:
        html_crf.features(html_crf.leaf_blocks(p))
    assert time.time() - began < 60


def test_best_labels_by_force():
    rng = np.random.default_rng(5)
    for n in (1, 2, 5, 9):
        field = html_crf.Field(rng.normal(size=(2, 4)), rng.normal(size=(2, 2)))
        x = rng.integers(0, 2, (n, 4)).astype(float)

        def total(y, x=x, field=field):
            s = x @ field.weights.T
            return sum(s[t, k] for t, k in enumerate(y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:], strict=False))

        best = max(itertools.product((0, 1), repeat=n), key=total)
        assert field.decode(x).tolist() == list(best)
    tied = html_crf.Field(np.zeros((2, 4)), np.zeros((2, 2)))
    assert tied.decode(np.ones((4, 4))).tolist() == [0, 0, 0, 0]


def test_training_climbs_the_likelihood(monkeypatch):
    """The trained field beats all single changes of its weights on the penalised likelihood, counted by force."""
    rng = np.random.default_rng(2)
    monkeypatch.setattr(html_crf, "FEATURES", ("a", "b", "c"))
    pages = [(rng.integers(0, 2, (n, 3)).astype(float), rng.integers(0, 2, n)) for n in (1, 3, 4, 6) for _ in range(6)]

    def value(w, m):
        out = 0.0
        for x, y in pages:
            s = x @ w.T
            of = lambda z, s=s: sum(s[t, k] for t, k in enumerate(z)) + sum(m[a, b] for a, b in zip(z, z[1:], strict=False))
            out += of(y.tolist()) - np.log(sum(np.exp(of(z)) for z in itertools.product((0, 1), repeat=len(y))))
        return out / len(pages) - 0.05 * ((w**2).sum() + (m**2).sum()) / 2

    field = html_crf.train(pages, rounds=400, penalty=0.05)
    top = value(field.weights, field.moves)
    for k in range(field.weights.size):
        for step in (-0.2, 0.2):
            w = field.weights.copy()
            w.flat[k] += step
            assert value(w, field.moves) < top
    for k in range(4):
        for step in (-0.2, 0.2):
            m = field.moves.copy()
            m.flat[k] += step
            assert value(field.weights, m) < top


# --- 10 ---------------------------------------------------------------------------------------------


def components_by_force(rows, size):
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(LOWER))
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                up[max(find(i), find(j))] = min(find(i), find(j))
    out = []
    for i, r in enumerate(rows):
        first = rows[find(i)].doc_id
        out.append((r.doc_id, len(sets[i]), first, r.doc_id == first))
    return sorted(out)


def test_near_dups(docs, rows, empty):
    assert sorted(map(tuple, near_dups.components(docs, 4).collect())) == components_by_force(rows, 4)
    assert near_dups.components(empty, 4).count() == 0
    assert near_dups.one_of_each(docs, 5).columns == docs.columns


def test_large_nodes_branch(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for k in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append((k, " ".join(w)))
    texts += [(100 + k, " ".join(f"y{rng.randrange(10**6)}" for _ in range(80)) + " " + " ".join(base[:30])) for k in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(near_dups, "NODE", 16)
    rows = sorted(df.collect(), key=lambda r: r.doc_id)
    assert sorted(map(tuple, near_dups.components(df, 4).collect())) == components_by_force(rows, 4)


def test_isolated_pairs_in_large_nodes(spark, monkeypatch):
    """Texts around one passage (similarity 0.77), among which pairs share a little more."""
    rng = random.Random(6)
    own = lambda n: " ".join(f"y{rng.randrange(10**9)}" for _ in range(n))
    passage = " ".join(f"w{i}" for i in range(200))
    texts = [passage + " " + own(30) for _ in range(250)]
    for _ in range(40):
        more = passage + " " + own(8)
        texts += [more + " " + own(22), more + " " + own(22)]
    monkeypatch.setattr(near_dups, "NODE", 16)
    monkeypatch.setattr(near_dups, "BLOCK", 50)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = components_by_force(sorted(df.collect(), key=lambda r: r.doc_id), 4)
    assert sum(not kept for *_, kept in want) == 40
    assert sorted(map(tuple, near_dups.components(df, 4).collect())) == want


def test_one_row_of_each_component_stays(spark):
    """Shared and null ids, equal rows and clashing names: one row of a component stays, and all without words."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, b), (5, a), (5, b), (6, a + " end"), (7, c), (7, c), (None, c), (None, d), (None, d), (8, None), (8, ""), (None, " "), (9, "x y"), (9, "X y")]
    df = spark.createDataFrame([(i, t, k, "s", 1.5) for k, (i, t) in enumerate(rows)], "doc_id long, text string, v long, set string, component_id double")
    out = near_dups.one_of_each(df, 5)
    assert out.columns == df.columns
    kept = sorted((r.v for r in out.collect()))
    assert [k for k in kept if k not in (4, 5, 7, 8, 12, 13)] == [0, 1, 9, 10, 11]
    assert sum(k in (4, 5) for k in kept) == sum(k in (7, 8) for k in kept) == sum(k in (12, 13) for k in kept) == 1
    assert near_dups.one_of_each(df.limit(0), 5).count() == 0


def test_all_pairs_of_a_large_node_are_found(spark):
    """640 texts around one passage (similarity under 0.7976) with 40 pairs of 0.84, at the operator's own constants."""
    rng = random.Random(11)
    own = lambda n: " ".join(f"y{rng.randrange(10**12)}" for _ in range(n))
    passage = " ".join(f"w{i}" for i in range(200))
    texts = [(i, f"{passage} {own(25)}") for i in range(560)]
    for k in range(40):
        more = f"{passage} {own(7)}"
        texts += [(4000 + 2 * k + i, f"{more} {own(18)}") for i in range(2)]
    rng.shuffle(texts)
    got = {r.doc_id: (r.component_id, r.kept) for r in near_dups.components(spark.createDataFrame(texts, "doc_id long, text string"), 4).collect()}
    want = {i: (i, True) for i in range(560)} | {4000 + 2 * k + i: (4000 + 2 * k, i == 0) for k in range(40) for i in range(2)}
    assert got == want


def test_long_pieces_are_not_kept(monkeypatch):
    """Caches are bounded by characters, and results don't depend on them."""
    from tokenizers import Tokenizer

    rng = random.Random(3)
    texts = ["".join(rng.choices("abcdefgh", k=3000)) + " tail." for _ in range(8)] + ["one two"] * 3
    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(rans, "CACHE_SIZE", 4000)
    tokens = rans.PieceTokens(path)
    for t in texts:
        assert tokens.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids
        assert tokens.held <= 8000
    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    monkeypatch.setattr(bpe, "CACHE_CHARS", 4000)
    code = bpe.WordCoder(path)
    for t in texts:
        assert code.encode(t) == library.encode(t, add_special_tokens=False).ids
        assert code.held <= 8000


def test_products_count_as_merges_do():
    rng = np.random.default_rng(4)
    a, b = ([np.unique(rng.integers(0, 6000, rng.integers(1, 4000)).astype(np.uint64)) for _ in range(n)] for n in (5, 7))
    tokens = np.unique(np.concatenate([*a, *b]))
    assert near_dups._overlaps(a, b, tokens).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


# --- pipeline ---------------------------------------------------------------------------------------


def quality_by_force(docs, labels):
    """doc_ids that the classifier keeps, from its own scores of single documents."""
    return {r.doc_id for r in quality_qda.score_table(docs, labels).where("predicted = 1").collect()}


def test_pipeline(spark, monkeypatch):
    """Each stage against brute force or another tool on what the one before it kept."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    found = {}

    def seen(before, stage):
        def run(spark, docs, sf_dir):
            found[before] = docs
            return stage(spark, docs, sf_dir)

        return run

    names = ["documents", *(name for name, _ in corpus_pipeline.STAGES)]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(name, seen(before, stage)) for before, (name, stage) in zip(names, corpus_pipeline.STAGES, strict=False)])
    found["encode"] = corpus_pipeline.run(spark, SF).cache()
    assert all(v.columns == found["documents"].columns for k, v in found.items() if k != "encode")
    by_id = {k: {r.doc_id: r.text for r in v.collect()} for k, v in found.items() if k != "encode"}
    assert by_id["quality"] == {k: by_id["documents"][k] for k in quality_by_force(found["documents"], spark.read.parquet(f"{SF}/labels.parquet"))}
    rows = sorted(found["quality"].collect(), key=lambda r: r.doc_id)
    kept = [i for i, _, _, k in components_by_force(rows, 5) if k]
    assert by_id["near_dups"] == {i: by_id["quality"][i] for i in kept}
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    left = {}
    for i, t in by_id["near_dups"].items():
        n, hit, *_ = hits_by_force(t, items)
        if hit <= 0.5 * n:
            left[i] = n - hit
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    assert {i: len(find(t.translate(LOWER))) for i, t in by_id["decontaminate"].items()} == left
    same = {i: t for i, t in by_id["decontaminate"].items() if not re.search("[0-9@]", t)}
    assert by_id["pseudonyms"].keys() == by_id["decontaminate"].keys() and all(by_id["pseudonyms"][i] == t for i, t in same.items())
    library = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    for r in found["encode"].collect():
        ids = library.encode(by_id["pseudonyms"][r.doc_id], add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
    assert found["encode"].count() == len(by_id["pseudonyms"])


def test_pipeline_edges(spark, docs, empty):
    """Null, empty, long and equal texts, shared ids, clashing names and an empty table go through every stage."""
    import corpus_pipeline

    wide = docs.withColumn("hits", F.lit(1)).withColumn("v", F.lit("x")).withColumn("pii", F.lit(2.5))
    for table in (wide, empty):
        now = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, SF).cache()
            assert name == "encode" or out.columns == now.columns
            assert out.count() <= now.count()
            now = out


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from sievework.llm import common

    class Unset:
        sparkContext = type("c", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: {})})
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Unset())
