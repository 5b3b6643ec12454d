import base64

import public_tokenizers as P
import tiktoken

from cairn.llm import byte_bpe as B

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
TIKTOKEN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_equals_tiktoken_and_round_trips(documents, odd):
    for docs in (documents, odd):
        texts = {}
        for r in docs.select("doc_id", "text").collect():
            texts.setdefault(r["doc_id"], r["text"] or "")
        for r in B.encode_decode(docs, PATH, P.PATTERN).collect():
            ids = TIKTOKEN.encode_ordinary(texts[r["doc_id"]])
            assert r["ids"] == ",".join(map(str, ids)) and r["n_tokens"] == len(ids)
            assert bytes(r["decoded"]) == texts[r["doc_id"]].encode()


def test_long_match():
    for piece in (b"a" * 4097, bytes(range(256)) * 20, "漢字🙂é".encode() * 400):
        assert B.encode_piece(piece, RANKS) == TIKTOKEN._core_bpe.encode_single_piece(piece)


def test_empty(empty):
    assert B.encode_decode(empty, PATH, P.PATTERN).count() == 0
