import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from cairn.llm import packing as K

PATH = P.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def check(pieces, expected):
    """Every id of every document lies in one piece; sequences have no gap and no overlap."""
    held, places = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(bytes(p["ids"]), dtype="<u4").tolist()
        assert len(ids) == p["length"]
        held[p["doc_id"], p["doc_tokens"]].append((p["start"], ids))
        places[p["sequence_id"]].append((p["offset"], p["length"]))
    for key, want in expected.items():
        rest = sorted(held.pop(key))
        assert [x for _, ids in rest for x in ids] == want and rest[0][0] == 0
    assert not held
    total = padded = 0
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= K.CAPACITY
        total += at
        padded += at if at & (at - 1) == 0 else K.CAPACITY
    return total, padded


def test_documents(documents):
    want = {}
    for r in documents.collect():
        ids = TOKENIZER.encode(r["text"], add_special_tokens=False).ids + [2]
        want[r["doc_id"], len(ids)] = ids
    total, padded = check(K.pack(documents, PATH, group=50).collect(), want)
    assert total == padded


def test_odd_rows(odd, empty):
    out = K.pack(odd, PATH).collect()
    counts = Counter()
    for r in out:
        counts[r["doc_id"]] += r["length"]
    for r in odd.dropDuplicates(["doc_id"]).collect():
        n = len(TOKENIZER.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        assert counts[r["doc_id"]] == n * (2 if r["doc_id"] == 5 else 1)
    assert K.pack(empty, PATH).count() == 0


@pytest.mark.parametrize("text", ["İstanbul ΣΑΣ ǅ", "éa b\x1cc\x85d", "don't 'RE ²³ 12½ ªº", "<|endoftext|>x", "ﬁ ß ſ 漢字🙂"])
def test_encoder_equals_tokenizer(text):
    own = np.frombuffer(K.Encoder(open(PATH, "rb").read()).ids(text), dtype="<u4").tolist()
    assert own == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_encoder_on_random_plain_text():
    own, rng = K.Encoder(open(PATH, "rb").read()), random.Random(5)
    chars = [c for c in map(chr, range(9, 0x180)) if not K.PLAIN.search(c)] + list(" '' s t re") * 20
    for _ in range(400):
        text = "".join(rng.choice(chars) for _ in range(60))
        assert np.frombuffer(own.ids(text), dtype="<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_first_fit_decreasing_equals_a_plain_scan():
    rng = random.Random(2)
    for n in (0, 1, 2, 57, 300):
        sizes = [rng.randint(1, 100) for _ in range(n)]
        room, want = [], [0] * n
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
            room += [100] * (k == len(room))
            room[k] -= sizes[i]
            want[i] = k
        assert K.first_fit_decreasing(sizes, 100) == want
