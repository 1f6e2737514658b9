import random

import numpy as np

from scoreloom.llm import hashing


def test_equal_words_and_no_others_share_a_hash():
    rng = random.Random(3)
    words = {"".join(rng.choice("abcdeXé́日_0") for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 40]))) for _ in range(4000)}
    words |= {"a" * n for n in (1, 7, 8, 9, 1023, 1024, 1025, 5000)} | {"a" * 5000 + "b", "b" + "a" * 5000, "a" * 2499 + "b" + "a" * 2500}
    given = [*words, *rng.sample(sorted(words), 500)]
    rng.shuffle(given)
    text = "".join(w + rng.choice([" ", "\t", "\n", "\x0b", "\x0c", "\r", "  \n"]) for w in given)
    hashes, starts = hashing.word_hashes(("\n " + text).encode())
    folded = hashing.folded_words(text)
    assert len(hashes) == len(folded) == len(given)
    assert len(set(hashes.tolist())) == len(set(folded)) and len(set(zip(hashes.tolist(), folded, strict=True))) == len(set(folded))
    raw = ("\n " + text).encode()
    assert all(raw[s : s + len(w)].lower() == w.lower() for s, w in zip(starts.tolist(), folded, strict=True))


def test_a_word_has_one_hash_wherever_it_stands():
    for text in ("a", " a", "a ", "x a", "A\n", "longer-word a " * 3):
        hashes, _ = hashing.word_hashes(text.encode())
        assert hashing.word_hashes(b"a")[0][0] in hashes
    for empty in (b"", b" \n\t"):
        assert len(hashing.word_hashes(empty)[0]) == 0 and len(hashing.word_hashes(empty)[1]) == 0
    bits = np.array([int(h).bit_count() for h in hashing.word_hashes(" ".join(map(str, range(5000))).encode())[0]])
    assert abs(bits.mean() - 32) < 0.3
