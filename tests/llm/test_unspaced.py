"""Languages written without blanks: all of their text is learned, and summed over its whole length."""

import random

import numpy as np
import public_tokenizers

from spotflow.llm import language_id

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def sentence(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n)) + "。"


def test_training_on_unspaced_scripts(spark):
    rng = random.Random(6)
    scripts = {"zh": "的一是不了在人有我他这中大来上国", "ja": "のにはをたがでてとしれさいるまなあ", "th": "กขคงจชดตนบปมยรลวสหอ"}
    rows = [(10 * k + i, " ".join(sentence(rng, letters, 40 + 30 * i) for _ in range(3)) + " 12 ab", lang)
            for k, (lang, letters) in enumerate(scripts.items()) for i in range(8)]
    rows.append((99, sentence(rng, scripts["ja"], 50), "xx"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counted = language_id.word_counts(docs.select("lang", "text")).collect()
    text = "".join(r[1] for r in rows).replace(" ", "").lower().encode()
    assert sum(len(r.word.strip()) * r.n for r in counted) == len(text)
    assert all(len(r.word.lstrip(b" ")) <= language_id.TRAINED and r.word.decode() for r in counted)
    model = language_id.train(docs.where("lang <> 'xx'"), RANKS)
    assert model.languages == ["ja", "th", "zh"]
    new = [(k, sentence(rng, letters, 200), lang) for k, (lang, letters) in enumerate(scripts.items())]
    got = language_id.identify(spark.createDataFrame(new, "doc_id long, text string, lang string"), model).collect()
    assert all(r.lang_pred == r.lang for r in got)
    assert language_id.train(docs, RANKS).languages == ["ja", "th", "xx", "zh"]


def test_long_words_are_summed_whole():
    own = language_id.vocabulary(RANKS)
    chance = np.random.default_rng(0).random((own.size, 2)) ** 4
    rng = random.Random(7)
    words = ["".join(rng.choice("theandingtion的一") for _ in range(n)).encode() for n in (257, 300, 700, 256, 900, 40)] + [b"x"]
    texts = [w + b" ab" for w in words] + [words[2] + b" " + words[2]]
    one = lambda w: language_id._log_sums(np.frombuffer(b" " + w, np.uint8)[None, :], own, chance)[0]
    got = language_id._log_likelihoods(texts, own, chance)
    assert np.allclose(got, [one(w) + one(b"ab") for w in words] + [2 * one(words[2])])
