"""Words in runs through the tokenizers library, against words one by one."""

import numpy as np

from postern.llm import token_files
from postern.llm.queries import vocabulary_path

WORDS = [b" hello", b" \xc3\xa9t\xc3\xa9", b"Start", b" ", b"  ", b" a1", b" it", b"'s", b"\n", b" \xff\xfe", b"\xc3\xa9", b" 42", b" na\xc3\xafve", b" \xe4\xb8\xad\xe6\x96\x87", b" cafe\xcc\x81", b"!", b" !?", *(b" w" + bytes([97 + k % 26, 97 + k // 26]) for k in range(300))]


def encoded(encoder, words: list[bytes]) -> list[list[int]]:
    data = np.frombuffer(b"".join(words), np.uint8)
    lengths = np.array([len(w) for w in words])
    ids, counts = encoder.encode_types(data, np.cumsum(lengths) - lengths, lengths)
    ends = np.cumsum(counts)
    return [ids[b - n : b].tolist() for n, b in zip(counts.tolist(), ends.tolist())]


def test_runs_give_the_ids_of_words_alone(monkeypatch):
    encoder = token_files.LibraryEncoder(vocabulary_path())
    alone = [encoder.tokenizer.encode(w.decode("utf-8", "replace"), add_special_tokens=False).ids for w in WORDS]
    calls = []
    counted = encoder._encoded
    monkeypatch.setattr(encoder, "_encoded", lambda texts: calls.append(len(texts)) or counted(texts))
    assert encoded(encoder, WORDS) == alone
    assert sum(calls) < len(WORDS) // 5  # the lettered ones went in runs
    assert encoded(encoder, WORDS[::-1]) == alone[::-1] and encoded(encoder, [WORDS[3], b" new", WORDS[0]])[::2] == [alone[3], alone[0]]
    monkeypatch.setattr(token_files, "CACHED_WORDS", 10)
    assert encoded(encoder, WORDS[5:]) == alone[5:]


def test_runs_that_do_not_part_at_words_go_one_by_one():
    encoder = token_files.LibraryEncoder(vocabulary_path())
    alone = encoded(encoder, WORDS)
    encoder.forget()
    encoder.width = encoder.width + 1
    assert encoded(encoder, WORDS) == alone
