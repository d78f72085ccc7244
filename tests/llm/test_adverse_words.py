"""Words made against the kernels: very long ones, repetitive ones, and pairs that weak hashes take for one."""

import random
import string
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pledgelens.llm.common import PRIME, RollingHash, _powers, _times, utf8
from pledgelens.llm.minhash import keep_one, near_duplicates
from pledgelens.llm.mixing import label_domains, mix_documents
from pledgelens.llm.pieces import Vocabulary, encode_slice
from pledgelens.llm.quality import features, fit_quality
from pledgelens.llm.suffix_dedup import remove_repeats
from pledgelens.llm.suffix_tree import score_texts

DOC = "doc_id long, text string"
SWAP = str.maketrans("ab", "ba")


def thue_morse(n):
    """The word of 2**n letters over a and b, and the one with both letters swapped."""
    w = "a"
    for _ in range(n):
        w += w.translate(SWAP)
    return w, w.translate(SWAP)


def test_products_modulo_the_prime():
    rng, p = np.random.default_rng(5), int(PRIME)
    a, b = (np.r_[rng.integers(0, p, 5000, dtype=np.uint64), np.array([0, p - 1, p - 1, 1], np.uint64)] for _ in range(2))
    b[-4:] = [p - 1, p - 1, 1, p - 1]
    assert _times(a, b).tolist() == [int(x) * int(y) % p for x, y in zip(a, b)]
    assert _powers(12345, 70_000)[[0, 1, 69_999]].tolist() == [1, 12345, pow(12345, 69_999, p)]
    assert _powers(3, 0).tolist() == [1]


def test_names_do_not_depend_on_the_place():
    data = np.random.default_rng(6).integers(0, 256, 80_000, dtype=np.uint8)
    roll, at = RollingHash(np.r_[data, data]), np.arange(79_000)
    one = roll.of(at, at + 300)
    assert (one == roll.of(at + 80_000, at + 80_300)).all() and len(np.unique(one)) == len(at)
    assert (RollingHash(data[5:]).of(at[:9] + 1, at[:9] + 7) == roll.of(at[:9] + 6, at[:9] + 12)).all()


@pytest.mark.parametrize("n", [7, 10, 12, 16])
def test_made_words_have_two_names(n):
    one, other = thue_morse(n)
    data = np.frombuffer((one + other).encode(), np.uint8)
    a, b = RollingHash(data).of(np.array([0, len(one)]), np.array([len(one), 2 * len(one)]))
    assert a != b


def test_made_words_stay_apart(spark):
    """Two documents of one such word each: no class of near duplicates, no repeat, no common feature; the one that was not learned scores lower."""
    one, other = thue_morse(10)
    docs = spark.createDataFrame([(1, one), (2, other), (3, other)], DOC)
    assert {r.doc_id: r.class_id for r in near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 2}
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == [1, 2]
    rows = [(1, one), (2, other)]
    want = {}
    for i, t in rows:
        gone = set()
        for p in range(len(t) - 199):
            s = t[p : p + 200]
            if sum(u.startswith(s, q) for j, u in rows for q in range(len(u) - 199) if (j, q) != (i, p)):
                gone.update(range(p, p + 200))
        want[i] = len(gone)
    assert {r.doc_id: r.n_removed for r in remove_repeats(spark.createDataFrame(rows, DOC)).collect()} == want
    row, slot, _ = features(*utf8(pa.array([one, other])), 20)
    assert set(slot[row == 0].tolist()).isdisjoint(slot[row == 1].tolist())
    texts = spark.createDataFrame([(i, one) for i in range(6)] + [(9, other)], DOC)
    got = {r.id: r.score for r in score_texts(texts, F.col("doc_id") == 9).select(F.col("doc_id").alias("id"), "score").collect()}
    assert got[9] < got[0] - 0.3


def piece_library():
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    return sentencepiece.SentencePieceProcessor(model_file=path), Vocabulary(path)


def encoded(v, texts):
    ids, at = encode_slice(v, *utf8(pa.array(texts)))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


def test_long_words_equal_the_library():
    sp, v = piece_library()
    rnd = random.Random(3)
    signs = ["ab", "abcdefgh", string.ascii_lowercase, string.ascii_letters + string.digits + "+/", "the", "=-", "日本語の中é", "eth ", "heran", "()[]{};", "a\U0001F600"]
    texts = ["".join(rnd.choices(rnd.choice(signs), k=rnd.randint(50, 500))) for _ in range(600)]
    texts += [("".join(rnd.choices(string.ascii_lowercase, k=rnd.randint(1, 6))) * 500)[: rnd.randint(60, 500)] for _ in range(300)]
    pieces = [sp.id_to_piece(i).strip("▁") for i in range(300, 20_000)]
    texts += ["".join(rnd.choices(pieces, k=rnd.randint(15, 150))) for _ in range(600)]
    texts += [f"short words, then {t} and  more\n" for t in texts[::50]]
    assert encoded(v, texts) == sp.encode(texts, add_bos=True, add_eos=True)


@pytest.mark.parametrize("signs", [string.ascii_lowercase, string.ascii_letters + string.digits + "+/", "a", "-", "日"])
def test_a_word_of_a_megabyte(signs):
    """It took hours when each round merged one pair of a word; its first part is compared with the library."""
    sp, v = piece_library()
    rnd = random.Random(4)
    word = "".join(rnd.choices(signs, k=1_000_000))
    begun = time.time()
    ids, _ = encode_slice(v, *utf8(pa.array([word])))
    assert time.time() - begun < 60
    assert b"".join(v.piece_bytes[i] for i in ids.tolist()).decode() == " " + word
    assert encoded(v, [word[:100_000]])[0] == sp.encode(word[:100_000], add_bos=True, add_eos=True)


def test_training_does_not_depend_on_the_order_of_rows(spark):
    rows = [(i % 7, f"word{i} common {'good' if i % 7 < 3 else 'bad'} text") for i in range(60)]
    labels = spark.createDataFrame([(i, int(i < 3)) for i in range(7)], "doc_id long, quality int")
    one = fit_quality(spark.createDataFrame(rows, DOC).repartition(1), labels)
    other = fit_quality(spark.createDataFrame(rows[::-1], DOC).repartition(5), labels)
    assert one.bias == other.bias and (one.weights == other.weights).all() and np.any(one.weights)


def test_small_domains_meet_their_own_targets(spark):
    at = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{at}/{n}.parquet") for n in ("documents", "labels"))
    _, m = mix_documents(docs, label_domains(labels))
    assert min(m.targets) < 0.05 * sum(m.targets)
    assert all(abs(a - b) <= 1e-3 * b for a, b in zip(m.reached, m.targets))
