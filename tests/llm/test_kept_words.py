import numpy as np
import public_tokenizers

from placeproof.llm import tokenids


def test_kept_words_give_the_same_ids(monkeypatch):
    """Words that an earlier batch has shown are not encoded again, and their ids are those of encoding alone, past the bound too."""
    kept = tokenids.Words(public_tokenizers.path("word_bpe_49k.json"))
    batches = [["red", "red,", "DEĞİLDİ.", "", "a1-b2"], ["blue", "red", "x<|startoftext|>y", "a1-b2", "blue!"], ["red", "blue", "hill."], ["new"], []]
    asked, plain = [], kept.encode
    monkeypatch.setattr(kept, "encode", lambda words: asked.append(list(words)) or plain(words))
    for bound in (500_000, 6, 2, 0):
        monkeypatch.setattr(tokenids, "KEPT", bound)
        for words in batches + batches:
            flat, first, size = kept.known(words)
            for w, f, n in zip(words, first, size):
                assert np.array_equal(flat[f:f + n], kept._ids(w))
        if bound == 500_000:
            assert asked == [batches[0], ["blue", "x<|startoftext|>y", "blue!"], ["hill."], ["new"], [], [], [], [], [], []]
        assert len(kept.rows) == len(kept.first) == len(kept.size) <= max(bound, 0)
