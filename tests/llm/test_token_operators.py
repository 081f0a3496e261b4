"""op6 and op9: exact ids, files that read back, and packing."""

import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quayside.llm import packing, token_files
from quayside.llm.tokens import PieceTokenizer

BYTES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def plain(path):
    t = Tokenizer.from_file(path)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path,blanks", [(BYTES, True), (WORDS, False)])
def test_pieces_give_the_ids_of_the_whole_text(rows, path, blanks):
    rng = random.Random(3)
    signs = list("ab .,'\n!é \t9$€ß ") + ["  ", "'s"]
    texts = [r[1] for r in rows] + ["".join(rng.choices(signs, k=rng.randint(0, 30))) for _ in range(1500)]
    texts += ["<|endoftext|> x", "hello <|endoftext|> world", "a<|endoftext|><|endoftext|>b", "<|ENDOFTEXT|> <|endoftext",
              "<|startoftext|>Hello<|endoftext|>", "x<|endof", "text|> y", "[UNK] [CLS] <unk> <s>", "a\x1cb", "テスト　x.", "it's\n\nok", "don't. 'tis, x9y"]
    want, tok = plain(path), PieceTokenizer(path, blanks)
    for _ in range(2):  # unknown pieces first, then known ones
        for text, raw in zip(texts, tok.ids(pa.array(texts))):
            ids = want(text)
            assert raw == struct.pack(f"<{len(ids)}I", *ids), text


def test_token_files_round_trip(corpus, rows):
    got = token_files.read_token_files(token_files.write_token_files(corpus, BYTES)).collect()
    ids, expected = plain(BYTES), []
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        raw = np.array(ids(r[1]) + [0], "<u4").tobytes()
        expected.append((r[0], len(raw) // 4, zlib.crc32(raw)))
    start, by_start = 0, []
    for doc, n, crc in expected:
        by_start.append((doc, start, n, crc))
        start += n
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda x: x[1]) == by_start


def test_token_files_random_access_and_damage(spark, corpus, tmp_path):
    manifest = token_files.write_token_files(corpus, BYTES, folder=f"{tmp_path}/f").collect()
    path = manifest[0]["path"]
    reader, ids = token_files.FrameReader(path), plain(BYTES)
    text = {r.doc_id: r.text for r in corpus.collect()}
    k = len(reader.ids) - 1
    assert np.frombuffer(reader.document(k), "<u4").tolist() == ids(text[reader.ids[k]]) + [0]
    with open(path, "r+b") as f:
        f.seek(reader.offsets[k] + reader.entries[k][0] // 2)
        byte = f.read(1)
        f.seek(-1, 1)
        f.write(bytes([byte[0] ^ 0xFF]))
    with pytest.raises(Exception):
        token_files.FrameReader(path).document(k)


def naive_first_fit(lengths, capacity):
    room, out = [], []
    for n in lengths:
        k = next((i for i, r in enumerate(room) if r >= n), len(room))
        if k == len(room):
            room.append(capacity)
        out.append((k, capacity - room[k]))
        room[k] -= n
    return out


def test_tree_places_as_a_plain_search_does():
    rng = random.Random(1)
    for _ in range(30):
        lengths = sorted((rng.randint(1, 100) for _ in range(rng.randint(1, 200))), reverse=True)
        assert list(zip(*packing.first_fit(lengths, 100))) == naive_first_fit(lengths, 100)


def test_packing_covers_every_id_once(corpus, rows):
    got = packing.pack(corpus, WORDS, end_id=1, capacity=2048, group_pieces=64).collect()
    ids = plain(WORDS)
    want = sorted((r[0] is not None, r[0] or 0, tuple(ids(r[1]) + [1])) for r in rows)
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        docs[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert 0 < r.length <= 2048
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(r.length for r in got) == sum(len(w[2]) for w in want)
    for known, doc, seq in want:
        own = docs[doc if known else None]
        for start in range(0, len(seq), 2048):
            part = np.array(seq[start:start + 2048], "<u4").tobytes()
            assert any(r.start == start and r.ids_crc32 == zlib.crc32(part) and r.doc_tokens == len(seq)
                       and r.length == len(part) // 4 for r in own)
    assert sum(r.length for r in got) / (2048 * len(sequences)) > 0.9


def test_empty_tables(empty):
    assert packing.pack(empty, WORDS).count() == 0
    assert token_files.read_token_files(token_files.write_token_files(empty, BYTES)).count() == 0
