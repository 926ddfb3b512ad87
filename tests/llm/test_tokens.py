import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslens.llm.packing import cut_lengths, harmonic_classes, pack_documents
from corpuslens.llm.token_counts import count_tokens, spliced_ids
from corpuslens.llm.tokens import id_bytes, splits_at_white_space, tokenizer

HARD = ["", " ", "'s It's 'RE", "Straße ÇA É. ǅ İstanbul ΣΑΣ", "<|endoftext|>x<|startoftext|>", "a\x1cb\x85c\xa0d", "éa ́b", "가각ᆨ", "#" * 300]
PIECES = st.sampled_from([*HARD, "the", "\n", "  ", "ab12", "naïve,", "!?", "…", "́", "字"])


def ids(path, text):
    return tokenizer(path).encode(text, add_special_tokens=False).ids


def test_word_memo_equals_the_library(tokenizer_path):
    assert splits_at_white_space(tokenizer_path)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(PIECES, max_size=12))
    def check(parts):
        text = "".join(parts)
        assert np.frombuffer(id_bytes(text, tokenizer_path), "<u4").tolist() == ids(tokenizer_path, text)

    check()


def test_spliced_chunks_equal_the_whole(tokenizer_path):
    rng = random.Random(3)
    texts = ["ab" * 4000 + "é" * 3000 + " x" * 2000, "<|endoftext|>" * 1500, "'re" * 4000, "é" * 3000, "字" * 5000]
    texts += ["".join(rng.choice([*HARD, "word ", "x", "\n", "12"]) for _ in range(3000)) for _ in range(3)]
    for text in texts:
        for chunk, overlap in ((1500, 40), (700, 300)):
            assert [i for part in spliced_ids(text, tokenizer_path, chunk, overlap) for i in part] == ids(tokenizer_path, text)


def test_counts(odd_documents, no_documents, tokenizer_path):
    rows = count_tokens(odd_documents, tokenizer_path, 5, chunk=5000).collect()
    want = [(str(r.doc_id), len((r.text or "").encode()), len(ids(tokenizer_path, r.text or ""))) for r in odd_documents.collect()]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == sorted(want)
    assert all(r.over_limit == (r.n_tokens > 5) for r in rows)
    assert count_tokens(no_documents, tokenizer_path, 5).count() == 0


def test_cuts_use_every_token_and_fit_their_class():
    for capacity in (16, 100, 4096):
        classes = harmonic_classes(capacity)
        for total in [*range(1, 300), 4095, 4096, 4097, 123_456]:
            pieces = cut_lengths(total, capacity)
            assert sum(pieces) == total and all(0 < p <= capacity for p in pieces)
            assert all(any(p <= capacity // j for j in classes) for p in pieces)


def packed_ok(docs, rows, path, capacity, end=2):
    want = sorted(tuple(ids(path, r.text or "") + [end]) for r in docs.collect())
    by_row, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        by_row[r.doc_id, r.doc_tokens].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length, r["class"]))
    got = []
    for pieces in by_row.values():
        pieces.sort(key=lambda r: r.start)
        copies = sum(r.start == 0 for r in pieces)  # rows that repeat an id
        for k in range(copies):
            got.append(tuple(i for r in pieces[k::copies] for i in r.ids))
    assert sorted(got) == want
    for pieces in by_bin.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity and len({c for *_, c in pieces}) == 1 and len(pieces) <= pieces[0][2]


def test_packing(spark, odd_documents, no_documents, tokenizer_path):
    docs = odd_documents.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    packed_ok(docs, pack_documents(docs, tokenizer_path, 64, keep_ids=True).collect(), tokenizer_path, 64)
    assert pack_documents(odd_documents, tokenizer_path, 4096).count() > 0
    assert pack_documents(no_documents, tokenizer_path, 4096).count() == 0


def test_all_bins_but_the_last_of_a_class_are_filled(spark, tokenizer_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = pack_documents(docs, tokenizer_path, 4096, keep_ids=True).collect()
    packed_ok(docs, rows, tokenizer_path, 4096)
    by_class = defaultdict(lambda: defaultdict(int))
    for r in rows:
        by_class[r["class"]][r.sequence_id] += 1
    for j, bins in by_class.items():
        assert sorted(bins.values())[1:] == [j] * (len(bins) - 1)
