from lodestrata.llm import packing


def test_words_come_back(monkeypatch):
    """A worker has one encoder for all its tasks, and a full cache does not forget the words that are met again and again."""
    path = packing.default_tokenizer()
    assert packing._encoder(path) is packing._encoder(path)
    monkeypatch.setattr(packing, "CACHE", 3)
    encode, met = packing._Encoder(path), []
    model = encode.model

    class Counted:
        def tokenize(self, text):
            met.append(text)
            return model.tokenize(text)

    encode.model = Counted()
    texts = [f"often {a}qx {b}zv" for a, b in zip("abcdefgh", "stuvwxyz", strict=True)]
    want = [packing._Encoder(path)([t])[0] for t in texts]
    assert [encode([t])[0] for t in texts] == want
    assert met.count("often") == 1
