import random
import zlib

import numpy as np
import pytest

from attesta.llm import packing, token_matrix, tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path("word_bpe_49k.json"))


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_encoder_agrees_with_the_tokenizer(tokenizer, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 300)
    random.seed(3)
    pieces = list("abcABCéÉßÜüñ \n\t\r.,!?'\"-_#*$%123²½ΣσςİŞşæÆ漢字́\xa0\x1c\x85​<|>") + ["<|endoftext|>", "'s", "'LL", "<|startoftext|>", "<|ENDOFTEXT|>", "  ", "ﬁ", "Å", "Å", "don't"]
    texts = ["".join(random.choices(pieces, k=random.randint(0, 40))) for _ in range(3000)] + ["", " ", "word " * 400, "y" * 300]
    encoder = tokens.WordEncoder(tokens.tokenizer_path("word_bpe_49k.json"))
    for text, got in zip(texts, encoder.encode_all(texts)):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def first_fit(lengths, capacity):
    bins, out = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        for b, used in enumerate(bins):
            if used + lengths[i] <= capacity:
                break
        else:
            b, used = len(bins), 0
            bins.append(0)
        out[i] = (b, used)
        bins[b] += lengths[i]
    return out


def best_fit_bins(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_trees_pack_as_plain_search_does(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 7, 32, rng.randint(1, 64)]) for _ in range(rng.randint(1, 200))]
    assert packing.first_fit_decreasing(lengths, 64) == first_fit(lengths, 64)
    rooms = {}
    for n, (place, _) in zip(lengths, token_matrix.best_fit_decreasing(lengths, 64)):
        rooms[place] = rooms.get(place, 64) - n
    assert sorted(rooms.values()) == best_fit_bins(lengths, 64)


def test_every_id_lies_in_one_piece(docs_of, odd, tokenizer):
    rows = packing.pack_first_fit(docs_of(odd), room=256, per_group=16).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    texts = {}
    for doc_id, text in odd:
        ids = ids_of(tokenizer, text)
        texts.setdefault((doc_id, len(ids)), []).append(ids)
    assert texts.keys() == by_doc.keys()
    for key, pieces in by_doc.items():
        want = sorted((s, len(x[s : s + 256]), zlib.crc32(np.array(x[s : s + 256], "<u4").tobytes())) for x in texts[key] for s in range(0, len(x), 256))
        assert sorted((p.start, p.length, p.ids_crc32) for p in pieces) == want
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256


def test_matrices_give_the_documents_back(docs_of, odd, tokenizer):
    rows = token_matrix.packed_matrices(docs_of(odd), room=256, per_group=8).collect()
    pieces = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u2" if r.id_bytes == 2 else "<u4").tolist()
        assert len(ids) == r.n_tokens <= 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == len(ids)
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32 and r.position_resets == r.cu_seqlens[:-1]
        positions = token_matrix.position_ids(r.position_resets, r.n_tokens).tolist()
        assert positions == [i for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]) for i in range(b - a)]
        for doc_id, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            pieces.setdefault((doc_id, start), []).append(tuple(ids[a:b]))
    want = {}
    for doc_id, text in odd:
        ids = ids_of(tokenizer, text)
        for s in range(0, len(ids), 256):
            want.setdefault((doc_id, s), []).append(tuple(ids[s : s + 256]))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted(v) for k, v in want.items()}


def test_padded_rows_are_one_matrix(docs_of, odd, tmp_path, spark):
    plain = {r.sequence_id: r for r in token_matrix.packed_matrices(docs_of(odd), room=256, per_group=8).collect()}
    token_matrix.write_matrices(docs_of(odd), str(tmp_path / "m"), room=256, per_group=8)
    rows = spark.read.parquet(str(tmp_path / "m")).collect()
    matrix = token_matrix.load_matrix([r.ids for r in rows], 256)
    assert matrix.shape == (len(plain), 256) and len({r.id_bytes for r in rows}) == 1
    for r, line in zip(rows, matrix):
        assert line[: r.n_tokens].tobytes() == plain[r.sequence_id].ids and not line[r.n_tokens :].any()


def test_empty_table(docs_of):
    assert packing.pack_first_fit(docs_of([])).count() == 0
    assert token_matrix.packed_matrices(docs_of([])).count() == 0


def test_blocks_of_a_large_group_keep_their_sequences_apart(docs_of, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_PIECES", 3)
    rows = packing.pack_first_fit(docs_of([(1, "same text")] * 10), room=8).collect()
    assert len(rows) == 10
    seen = {(r.sequence_id, r.offset) for r in rows}
    assert len(seen) == 10
