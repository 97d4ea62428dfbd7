"""The training-text operators against brute force, and on awkward rows."""

import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

pytest.importorskip("edgewright.llm")

from pyspark.sql import functions as F  # noqa: E402

from edgewright.llm import bpe, classlm, components, langid, licences, neardup, packing, pagediff, quality, substrings, winnow  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def awkward(spark):
    """Null, empty, blank, one word, very long, repeated rows, ties and columns with clashing names."""
    rng = random.Random(5)
    long = prose(rng, 60_000)
    texts = [None, "", " \n\t ", "word", long, long + " tail", "a b c d e f", "a b c d e f", "é́ 日本 🙂", "x" * 20_000]
    df = documents(spark, texts).withColumns({"bucket": F.lit(1), "row": F.lit("r"), "label": F.lit(2), "spans": F.lit(3), "n_words": F.lit(4), "minimiser": F.lit(5)})
    return df.union(df.where("doc_id in (3, 7)"))


@pytest.fixture(scope="module")
def near(spark):
    """Families of near copies, chains of edits, nested cuts and unrelated texts."""
    rng = random.Random(1)
    texts = []
    for _ in range(6):
        base = prose(rng, rng.choice((30, 90, 160))).split()
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(10_000))
            if rng.random() < 0.3:
                w = w[: int(len(w) * rng.uniform(0.8, 1))]
            texts.append(" ".join(w))
        chain = list(base)
        for _ in range(4):
            chain[rng.randrange(len(chain))] = "step" + str(rng.randrange(10_000))
            texts.append(" ".join(chain))
    texts += [prose(rng, 50) for _ in range(20)] + ["one two", "One TWO", "one", None, "", texts[0], texts[3].upper()]
    rng.shuffle(texts)
    return documents(spark, texts)


def sql_rows(df, sql):
    con = duckdb.connect()
    con.register("documents", df.select("doc_id", "text", "source").toPandas())
    return con.sql(sql).df().sort_values("doc_id").reset_index(drop=True)


def same(ours, theirs):
    ours = ours.toPandas().sort_values("doc_id").reset_index(drop=True)
    for c in theirs.columns:
        a, b = ours[c], theirs[c]
        assert ((a == b) | (a.isna() & b.isna())).all(), c


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (9, 9), (7, 5), *((i, i + 1) for i in range(100, 130))], "u long, v long")
    got = {r.id: r.label for r in components.components(edges).collect()}
    assert got[3] == 1 and got[7] == got[5] == 4 and got[130] == 100 and 9 not in got


def test_near_groups_equal_sql(near):
    found = neardup.groups(near).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    same(found, sql_rows(near, neardup.SQL))


def test_near_groups_through_many_shared_shingles(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 2)
    rng = random.Random(3)
    hub = prose(rng, 80).split()
    extra = prose(rng, 14).split()
    texts = [" ".join(hub)]
    for i in range(12):
        w = list(hub)
        w[40:54] = extra
        w[i] = f"own{i}"
        texts.append(" ".join(w))
    df = documents(spark, texts)
    same(neardup.groups(df).withColumn("kept", F.col("doc_id") == F.col("component_id")), sql_rows(df, neardup.SQL))


def test_near_groups_of_awkward_rows(awkward):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(awkward).collect()}
    assert got[0] == (0, 0) and got[1] == (0, 1) and got[3] == (1, 3) and got[7][1] == 6 and got[5][1] == 4
    assert neardup.groups(awkward.limit(0)).count() == 0
    kept = neardup.keep(awkward)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, 4, 6, 8, 9}


def test_repeated_passages_equal_sql(spark):
    rng = random.Random(2)
    passages = [prose(rng, n) for n in (13, 20, 60)]
    texts = [" ".join([prose(rng, rng.randrange(30)), rng.choice(passages), prose(rng, rng.randrange(5)), rng.choice(passages)]) for _ in range(60)]
    texts += [None, "", passages[0], passages[2] + "\n\n" + passages[2], "a a a a a a a a a a a a a a a a", "a a a a a a a a a a a a a a"]
    df = documents(spark, texts)
    found = substrings.cleaned(df.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("clean_text", 256).alias("kept_sha256"))
    same(found, sql_rows(df, substrings.SQL))


def test_repeated_passages_of_awkward_rows(awkward):
    got = {r.doc_id: r for r in substrings.cleaned(awkward).collect()}
    assert got[5].n_removed == 60_000 and got[5].clean_text == "tail" and got[4].n_removed == 0
    assert got[0].n_words == 0 and got[0].clean_text == ""
    assert substrings.cleaned(awkward.limit(0)).count() == 0
    kept = substrings.without_repeats(awkward)
    assert kept.columns == awkward.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts[0] is None and texts[2] == " \n\t " and texts[5] == "tail"


def test_encoding_equals_the_library(spark, awkward):
    from tokenizers import Tokenizer

    texts = ["  a  b\n\n c", "x<|endoftext|> y  <|endoftext|>", "　a  b", "don't 'LL 12ab  ", "tab\tand\x1cmore", " lead", "trail ", "The (quick) brown-fox, it's 3.5%!"]
    df = documents(spark, texts).unionByName(awkward.select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", F.col("doc_id") + 100))
    tokenizer = Tokenizer.from_file(bpe.vocabulary_path())
    lexicon = bpe.build_lexicon(spark, df, size=40)
    rows = {r.doc_id: r for r in bpe.round_trip(df, lexicon).collect()}
    for r in df.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert list(rows[r.doc_id].ids) == ids and rows[r.doc_id].decoded == tokenizer.decode(ids, skip_special_tokens=False)
    apart = bpe.decode(bpe.encode(df, lexicon))
    assert {(r.doc_id, r.decoded) for r in apart.collect()} == {(k, r.decoded) for k, r in rows.items()}
    assert bpe.round_trip(df.limit(0), lexicon).count() == 0


def test_lexicon_finds_its_words_only(tmp_path):
    entries = {b" the": [1], b" then": [1, 2], b" hen": [3], b"the": [4, 5, 6], b" t": [7]}
    bpe.compile_lexicon(entries, str(tmp_path / "x"))
    found = bpe.Lexicon(str(tmp_path / "x"))
    for word, ids in entries.items():
        assert np.frombuffer(found.get(word), np.uint32).tolist() == ids
    assert found.get(b" th") is None and found.get(b"zebra") is None and found.get(b"") is None
    assert found.states < sum(map(len, entries))


def test_language_profiles(spark, awkward):
    english, german = "the cat and the dog went to the house with the children", "der hund und die katze gehen mit den kindern nach dem haus"
    train = spark.createDataFrame([(i, t, lang) for i in range(20) for t, lang in ((english, "en"), (german, "de"), ("hm", None))], "doc_id long, text string, lang string")
    known = langid.profiles(train)
    assert set(known) == {"en", "de"}
    docs = spark.createDataFrame([(0, "the dog and the cat", "de"), (1, "die katze und der hund", None), (2, "12 34 !!", "en"), (3, None, "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, known).collect()}
    assert [got[i][0] for i in range(4)] == ["en", "de", "und", "und"] and got[2][1] == 0 and all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in langid.predict(docs, {}).collect()} == {"und"}
    kept = langid.keep(awkward, train)
    assert kept.columns == awkward.columns and not {0, 1, 2} & {r.doc_id for r in kept.collect()}
    assert langid.predict(awkward.limit(0), known).count() == 0


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    found = langid.query(spark, sf_dir).join(docs, "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.95 * found.count()


def brute_measures(t):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)


def test_quality_measures_equal_brute_force(spark, awkward, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").union(awkward.where("doc_id > 2").select(F.col("doc_id") + 10_000, "text"))
    got = {r.doc_id: r for r in quality.measures(docs).collect()}
    for r in docs.collect():
        x = got[r.doc_id]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute_measures(r.text)


def test_binomial_tail():
    want = sum(math.comb(30, i) * 0.1**i * 0.9 ** (30 - i) for i in range(4))
    assert quality.binomial_tail(3, 30, 0.1) == pytest.approx(want)


def test_certified_cutoffs_limit_false_rejections(spark):
    rng = random.Random(4)
    texts, labels = [], []
    for i in range(6000):
        good = i % 5 > 0
        w = prose(rng, 30).split()
        if not good or rng.random() < 0.0005:
            w = [x + "%%%%%%%" for x in w]
        texts.append(" ".join(w))
        labels.append((i, int(good)))
    docs, marks = documents(spark, texts), spark.createDataFrame([*labels, (10**9, 1), (None, 1), (1, None)], "doc_id long, quality int")
    got = quality.judged(docs, marks).join(marks, "doc_id").where("quality is not null")
    assert got.where("quality = 1 and not kept").count() <= quality.MAX_FALSE_REJECTION * got.where("quality = 1").count()
    assert got.where("quality = 0 and not kept").count() >= 0.95 * got.where("quality = 0").count()
    few = quality.judged(docs.limit(40), marks.limit(40))
    assert few.where("not kept and not base_failed").count() == 0


def test_quality_keeps_columns(spark, awkward):
    labels = spark.createDataFrame([(4, 1)], "doc_id long, quality int")
    kept = quality.keep(awkward, labels)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} == {4, 5}
    assert quality.judged(awkward.limit(0), labels).count() == 0


def test_packing_places_every_piece(spark, awkward):
    rng = random.Random(6)
    docs = documents(spark, [prose(rng, rng.choice((3, 40, 400, 3000))) for _ in range(150)] + [None, "", "x y"]).select("doc_id", "text").union(awkward.select(F.col("doc_id") + 1000, "text"))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    rows = packing.packed_documents(docs).toPandas()
    want = Counter()
    for r in docs.collect():
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1]
        for piece, i in enumerate(range(0, len(ids), 4096)):
            part = ids[i : i + 4096]
            want[r.doc_id, piece, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter(rows[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 4096
    assert rows.sequence_id.nunique() <= math.ceil(rows.length.sum() / 4096) + 1
    assert packing.packed_documents(docs.limit(0)).count() == 0


def test_plan_of_many_shapes():
    rng = np.random.default_rng(0)
    for lengths, most in ((rng.integers(1, 4097, 4000), 1.05), (np.full(500, 1500), 1.0), (np.full(99, 4096), 1.0), (rng.integers(1, 60, 9000), 1.01)):
        histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
        plan = packing.plan(histogram)
        used = Counter()
        for pattern, uses in plan:
            assert sum(pattern) <= 4096
            for n in pattern:
                used[n] += uses
        assert used == Counter(histogram)
        least = max(math.ceil(lengths.sum() / 4096), math.ceil(len(lengths) / (4096 // lengths.min())) if len(set(lengths.tolist())) == 1 else 0)
        assert sum(u for _, u in plan) <= math.ceil(most * least)


def test_class_model(spark, awkward):
    rng = random.Random(7)
    det, noun, verb = ["the", "a", "this"], ["cat", "dog", "bird", "fish"], ["sees", "likes", "hears"]
    texts = [" ".join(f"{rng.choice(det)} {rng.choice(noun)} {rng.choice(verb)}" for _ in range(20)) for _ in range(80)] + [None, "", "The strange WORD"]
    docs = documents(spark, texts).select("doc_id", "text").union(awkward.select(F.col("doc_id") + 1000, "text"))
    train = classlm.training_rows(docs)
    counts = classlm.word_counts(train)
    model = classlm.train_model(train, counts, classes=6)
    got = {r.doc_id: r for r in classlm.score(docs, counts, model).collect()}
    seen = Counter()
    split = {r.doc_id: [*(r.text or "").encode().lower().split(), b"\n"] for r in docs.collect()}
    for r in train.collect():
        seen.update(split[r.doc_id])
    n, v = sum(seen.values()), len(seen)
    assert (model.tokens, model.vocabulary) == (n, v)
    for d, words in split.items():
        base = sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in words)
        assert got[d].n_tokens == len(words) and got[d].n_known == sum(w in seen for w in words) and got[d].base_score == pytest.approx(base)
    plain = [d for d in range(80)]
    assert sum(got[d].score for d in plain) > sum(got[d].base_score for d in plain)
    kinds = {w: model.class_of(w.encode()) for w in (*det, *noun, *verb)}
    assert len({kinds[w] for w in det} & {kinds[w] for w in noun}) == 0
    # probabilities of a class's words and its place for strangers add up to one
    total = sum(10 ** (math.log10(c + classlm.ADDED) - model.emitted[model.class_of(w)]) for w, c in seen.items())
    strangers = sum(classlm.ADDED / 10 ** model.emitted[c] for c in set(model.classes.tolist()))
    assert total + strangers == pytest.approx(len(set(model.classes.tolist())), rel=1e-6)


def test_class_model_without_training_rows(spark):
    docs = documents(spark, ["a b", None]).select("doc_id", "text")
    counts = classlm.word_counts(docs.limit(0))
    got = classlm.score(docs, counts, classlm.train_model(docs.limit(0), counts)).collect()
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in got)


def test_winnowing_guarantee_and_edges(spark, awkward):
    rng = random.Random(8)
    shared = prose(rng, winnow.GRAM + winnow.SPAN - 1)
    pairs = [(i, f"{prose(rng, 20)} {shared} {prose(rng, 9)}") for i in range(12)]
    df = winnow.winnowed(spark.createDataFrame(pairs, "doc_id long, text string"), "text", "picks").withColumn("own", winnow.hashes("picks"))
    sets = [set(r.own) for r in df.collect()]
    assert all(a & b for a in sets for b in sets)
    found = winnow.fingerprints(awkward).collect()
    assert len(found) == awkward.count()
    rows = sorted(awkward.collect(), key=lambda r: (r.doc_id, r.text or ""))
    edited = Counter()
    for r, after in zip(rows, [*rows[1:], rows[0]], strict=True):
        t, n = r.text or "", after.text or ""
        half = len(t) // 2
        edited[r.doc_id, t[: len(t) - half] + n[:half]] += 1
    assert Counter((r.doc_id, r.edited) for r in found) == edited
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    assert winnow.fingerprints(awkward.limit(0)).count() == 0


def test_winnowing_chooses_the_rightmost_least(spark):
    rng = random.Random(9)
    text = " ".join(rng.choice("abc") for _ in range(60))
    row = spark.createDataFrame([(text,)], "text string")
    chosen = winnow.chosen(F.col("text"))
    for name, value in chosen.items():
        row = row.withColumn(name, value)
    r = row.withColumn("open", winnow.unpacked("picks")).first()
    top = [h >> winnow._BITS & ((1 << 34) - 1) for h in r.grams]
    signed = [h >> winnow._BITS for h in r.grams]
    want = set()
    for i in range(len(top) - winnow.SPAN + 1):
        least = min(signed[i : i + winnow.SPAN])
        want.add(max(j for j in range(i, i + winnow.SPAN) if signed[j] == least))
    assert sorted(x.position for x in r.open) == sorted(want)
    assert all(x.hash == top[x.position] for x in r.open)


def test_licences_equal_sql_and_inherit(spark):
    rows = [(1, "Released under the MIT License.", "s"), (12, "some words", "s"), (123, "more words", "s"), (13, "Licensed under the Apache License, Version 2.0.\nand much other text " + "word " * 40, "s"), (2, None, "s"), (3, "", None), (14, "the licence is unknown", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = licences.scan(df.select("doc_id", licences.document_path().alias("path"), "text"))
    same(found, sql_rows(df, licences.SQL))
    got = {r.doc_id: r for r in found.collect()}
    assert got[1].licence_file and got[12].licence == "MIT" and got[12].licence_folder == "s" and got[123].licence == "MIT"
    assert got[13].licence == "Apache-2.0" and got[13].licence_folder is None and got[14].licence == "NONE"
    assert licences.scan(df.limit(0).select("doc_id", licences.document_path().alias("path"), "text")).count() == 0


PAGE = """<html><head><title>x</title><script>if (a < b) {{ "<p>" }}</script></head><body><header class="site-header"><h1>Site</h1></header><div id="menu"><a href="/">Home</a></div>
{body}<div id="comments"><article class="comment">nice</article></div><form>q</form><p class="notice">hey</p><footer>f &copy;</footer>"""


def test_page_texts(spark):
    body = '<div class="content"><h1>T &amp; U</h1><p>One  two<br>three &nbsp; x<p>Four <b>five</b>six<div class="advert">Buy</div><ul><li>i<li>j</ul></div>'
    plain = "<div>Shared line of every page</div><div>Own {n} text</div><div>Last line</div>"
    rows = [(0, "http://h/a/1", PAGE.format(body=body)), (1, "http://h/a/2", PAGE.format(body=body)), (2, None, None), (3, "http://g/x/10", plain.format(n="ten")), (4, "http://g/x/11", plain.format(n="eleven")), (5, "http://g/x/11", ""), (6, "bad url", "<p>a<")]
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = Counter((r.page_id, r.text) for r in pagediff.extract(df).collect())
    text = "T & U\nOne two three x\nFour fivesix\ni\nj"
    assert got == Counter({(0, text): 1, (1, text): 1, (2, ""): 1, (3, "Own ten text"): 2, (4, "Own eleven text"): 1, (5, ""): 1, (6, "a<"): 1})
    assert pagediff.extract(df.limit(0)).count() == 0


def test_common_lines_is_a_longest_common_subsequence():
    rng = random.Random(11)
    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(15))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        got = pagediff.common_lines(a, b)
        assert len(got) == best[-1][-1] and got == sorted(set(got))
        rest = iter(b)
        assert all(any(a[i] == y for y in rest) for i in got)


def test_repeated_passages_of_heavy_minimisers(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HEAVY", 1)
    monkeypatch.setattr(substrings, "OFTEN", 1)
    rng = random.Random(12)
    passages = [prose(rng, n) for n in (14, 30)]
    texts = [" ".join([prose(rng, rng.randrange(30)), rng.choice(passages), prose(rng, 3)]) for _ in range(40)] + [passages[1], None]
    df = documents(spark, texts)
    assert substrings.heavy_minimisers(df.select("doc_id", F.col("text").cast("binary"))).size > 20
    found = substrings.cleaned(df.select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2("clean_text", 256).alias("kept_sha256"))
    same(found, sql_rows(df, substrings.SQL))


def test_near_groups_of_differing_rows_of_one_id(spark):
    a, b = prose(random.Random(1), 40), prose(random.Random(2), 40)
    rows = [(5, a), (5, b), (3, b), (7, a + " tail"), (9, b), (None, a)]
    got = Counter((r.doc_id, r.component_id) for r in neardup.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter({(5, 5): 1, (5, 3): 1, (3, 3): 1, (7, 5): 1, (9, 3): 1, (None, 5): 1})


def test_encoding_of_blank_lines_and_wide_spaces_equals_the_library(spark):
    from tokenizers import Tokenizer

    rng = random.Random(14)
    atoms = [" ", "  ", "\n", "\n\n", "\t", " \n", "\n ", "　", "\xa0", "  ", "\r\n", "\x1c", "\x85", "don't", "it's", "word", "Word,", "x.y", "12", "3,4", "é", "»", "日本", "a'll ", "--", "<|endoftext|>", "🙂", "1st", "½", "!\n", "?\n\n"]
    df = documents(spark, ["".join(rng.choice(atoms) for _ in range(rng.randrange(1, 30))) for _ in range(1500)])
    tokenizer = Tokenizer.from_file(bpe.vocabulary_path())
    for r in bpe.round_trip(df, bpe.build_lexicon(spark, df, size=20)).join(df.select("doc_id", "text"), "doc_id").collect():
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids
        assert list(r.ids) == ids and r.decoded == tokenizer.decode(ids, skip_special_tokens=False)
