"""The automaton's counts against plain longest match."""

import random

import public_tokenizers
import sentencepiece

from tessera.llm import wordpiece

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def _plain(word, first, later):
    count, at = 0, 0
    while at < len(word):
        own = later if at else first
        for end in range(len(word), at, -1):
            if word[at:end] in own:
                break
        else:
            return -1
        count, at = count + 1, end
    return count


def test_random_vocabularies():
    rng = random.Random(3)
    piece = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 5)))
    for _ in range(300):
        first, later = {piece() for _ in range(rng.randint(0, 8))}, {piece() for _ in range(rng.randint(0, 8))}
        own = wordpiece.Automaton(sorted(first), sorted(later))
        for _ in range(60):
            word = "".join(rng.choice("abcd" if rng.random() < 0.1 else "abc") for _ in range(rng.randint(0, 14)))
            assert own.count(word) == _plain(word, first, later), (word, first, later)


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(wordpiece, "MEMORY", 40)
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    first, later = {p for p in plain if p.startswith("▁")}, {p for p in plain if not p.startswith("▁")}
    texts = [None, "", " \n\t", "The quick brown fox's tail.", "Straße \U0001f9ff façade 中文 中 x", "a" * 3000, "one two " * 4000, "naïve \u0085x"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "tie tie", 0), (0, None, 0)], "doc_id long, text string, n_words int")
    found = wordpiece.count_tokens(docs, MODEL).collect()
    assert len(found) == len(texts) + 2
    for r in found:
        words = [w.decode() for w in (("tie tie" if r.doc_id is None else texts[r.doc_id]) or "").encode().split()]
        counts = [_plain("▁" + w, first, later) for w in words]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(max(c, 1) for c in counts), sum(c < 0 for c in counts))
    assert wordpiece.count_tokens(docs.limit(0), MODEL).count() == 0
