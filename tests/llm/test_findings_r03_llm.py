"""What round 3's findings asked for, training text."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from edgewright.llm import bpe, classlm, packing


def likelihood(texts, own):
    """The class bigrams' part of the likelihood that exchange compares."""
    pairs, left, right = Counter(), Counter(), Counter()
    for text in texts:
        seq = [own[w] for w in [classlm.END, *text, classlm.END]]
        for a, b in zip(seq, seq[1:]):
            pairs[a, b] += 1
            left[a] += 1
            right[b] += 1
    h = lambda c: sum(n * np.log(n) for n in c.values())
    return h(pairs) - h(left) - h(right)


def test_gains_equal_the_whole_likelihood():
    rng = random.Random(3)
    texts = [[rng.choice([b"a", b"b", b"c", b"d", b"e", b"f"]) for _ in range(rng.randrange(9))] for _ in range(60)]
    own = {w: i % 4 for i, w in enumerate([b"a", b"b", b"c", b"d", b"e", b"f", classlm.END])}
    names = sorted(own)
    pairs = np.zeros((4, 4))
    into, out, self_ = np.zeros((7, 4)), np.zeros((7, 4)), np.zeros(7)
    for text in texts:
        seq = [classlm.END, *text, classlm.END]
        for x, y in zip(seq, seq[1:]):
            pairs[own[x], own[y]] += 1
            if x == y:
                self_[names.index(x)] += 1
            else:
                into[names.index(y), own[x]] += 1
                out[names.index(x), own[y]] += 1
    got = classlm.gains(pairs, np.array([own[w] for w in names]), into, out, self_)
    for i, w in enumerate(names):
        want = np.array([likelihood(texts, own | {w: c}) for c in range(4)])
        np.testing.assert_allclose(got[i] - got[i, 0], want - want[0], atol=1e-8)


def test_every_counted_word_is_exchanged(spark, monkeypatch):
    # two kinds of words that alternate, each with one frequent word; the others all have the same ending
    monkeypatch.setattr(classlm, "BUCKET_WORDS", 7)
    rng = random.Random(4)
    x, y = [f"x{i}end" for i in range(40)], [f"y{i}end" for i in range(40)]
    texts = [" ".join(f"red {rng.choice(x + 20 * ['dog'])} on {rng.choice(y + 20 * ['mat'])}" for _ in range(30)) for _ in range(40)]
    train = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    choose = classlm.choose_types
    monkeypatch.setattr(classlm, "choose_types", lambda counts: choose(counts, words=5, endings=2))
    counts = classlm.word_counts(train)
    model = classlm.train_model(train, counts, classes=6)
    assert set(model.types.words) == {b"red", b"on", b"dog", b"mat"}
    kinds = {r.word.decode(): r["class"] for r in model.words.collect()}
    assert {r.word: r.n for r in model.words.collect()} == {r.word: r.n for r in counts.collect()}
    assert {kinds[w] for w in x if w in kinds} == {kinds["dog"]} != {kinds["mat"]} == {kinds[w] for w in y if w in kinds}
    assert model.class_of(b"x3end") == kinds["x3end"]
    # scores by brute force, with the words' own classes
    docs = train.limit(5).unionByName(spark.createDataFrame([(90, "red unseen1end on zz"), (91, None), (92, " Red\n")], "doc_id long, text string"))
    n = {r.word: r.n for r in counts.collect()}
    got = {r.doc_id: r for r in classlm.score(docs, counts, model).collect()}
    for r in docs.collect():
        words = [*(r.text or "").lower().encode().split(), classlm.END]
        own = [model.class_of(w) for w in words]
        want = sum(model.transition[a, b] + np.log10(n.get(w, 0) + classlm.ADDED) - model.emitted[b] for a, b, w in zip([own[-1], *own], own, words))
        assert abs(got[r.doc_id].score - want) < 1e-6 and got[r.doc_id].n_tokens == len(words) and got[r.doc_id].n_known == sum(w in n for w in words)


def test_streams_are_the_words_of_python():
    rng = random.Random(5)
    atoms = [b" ", b"\n", b"\x0b", b"\x1c", "　".encode(), b"\xc2\x85", b"Ab", "É".encode(), b"a", b"\x00", b"\t\r\x0c"]
    texts = [None, b"", b" \n ", b"\x1c"] + [b"".join(rng.choice(atoms) for _ in range(rng.randrange(12))) for _ in range(3000)]
    stream = classlm.Stream.of(pa.array(texts, pa.binary()))
    words = stream.words.to_pylist()
    assert [words[i] for i in stream.ids] == [w for t in texts for w in [*(t or b"").lower().split(), classlm.END]]
    assert stream.lengths.tolist() == [len((t or b"").split()) + 1 for t in texts]
    assert len(classlm.Stream.of(pa.array([], pa.binary())).ids) == 0


def test_frequent_pieces_are_those_of_python(spark, monkeypatch):
    monkeypatch.setattr(bpe, "COUNTED_BYTES", 200)
    rng = random.Random(6)
    atoms = ["a", "b.", "c,,", "Don't", "--", "", "é!", "x\ny", "\t", "日本"]
    texts = [None, "", " "] + [" ".join(rng.choice(atoms) for _ in range(rng.randrange(20))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {b" " + p.rstrip(bpe.MARKS) for t in texts if t for p in t.encode().split(b" ")} - {b" "}
    found = bpe.frequent_pieces(df, "text", 100)
    assert len(found) == len(set(found)) and set(found) == want


def test_a_worker_merges_a_piece_once(tmp_path, monkeypatch):
    bpe.compile_lexicon({b" the": [1]}, str(tmp_path / "x"))
    coder = bpe.Encoder(bpe.vocabulary_path(), str(tmp_path / "x"))
    merged = Counter()
    monkeypatch.setattr(coder.merger, "encode_piece", lambda piece: merged.update([piece]) or [1])
    for _ in range(2):
        for begin in range(0, 500_000, 50_000):
            coder.encode(b" ".join(b"w%d" % i for i in range(begin, begin + 50_000)))
            coder.trim()
    assert sum(merged.values()) == 500_000


def test_a_worker_tokenizes_a_word_once():
    coder = packing.Coder(packing.vocabulary_path())
    letters = lambda i: bytes(97 + i // 26**k % 26 for k in range(4))
    learned = []
    learn = coder.learn
    coder.learn = lambda words: learned.append(len(words)) or learn(words)
    for _ in range(2):
        for begin in range(0, 200_000, 50_000):
            coder.ids([b" ".join(letters(i) for i in range(begin, begin + 50_000))])
    assert learned == [50_000] * 4 + [0] * 4
