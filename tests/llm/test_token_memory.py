import numpy as np

from corvid.llm import _tokens


def test_more_words_in_a_text_than_are_remembered(monkeypatch):
    monkeypatch.setattr(_tokens, "REMEMBERED", 8)
    words, learn, calls = _tokens.WordIds(_tokens.WORD_TOKENIZER), _tokens.WordIds._learn, []

    def counted(self, *args):
        calls.append(len(args[0]))
        assert len(calls) < 10, "learns the same words again and again"
        learn(self, *args)

    monkeypatch.setattr(_tokens.WordIds, "_learn", counted)
    long = " ".join(f"word{i} x{i}y," for i in range(20))
    for text in ("word3 and x7y", long, "word3 other", long + " more", long):
        data = np.frombuffer(text.encode(), np.uint8)
        ids, at = words.ids(data, np.array([0, len(data)]))
        assert ids.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids and at.tolist() == [0, len(ids)]
