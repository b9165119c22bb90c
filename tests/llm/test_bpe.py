import random

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helixmark.llm import bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
REF = Tokenizer.from_file(PATH)
OWN = bpe.Encoder(PATH)


def same(texts):
    ids = OWN.encode(texts)
    for t, got, want in zip(texts, ids, REF.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(got, "<u4").tolist() == want.ids
        assert OWN.decode(got) == REF.decode(want.ids, skip_special_tokens=False) == t


def test_documents(documents):
    same([r["text"] for r in documents.select("text").collect()])


def test_random_texts():
    rng = random.Random(4)
    alphabet = [chr(c) for c in [*range(0x250), 0x85, 0xA0, 0x2028, 0x3000, 0x4E00, 0x1F600, 0xB2, 0xBD, 0x660, 0x300, 0x200B, 0xFEFF]]
    same(["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)])
    same(["a" * n + "b" for n in (1, 2, 3, 500, 5000)] + ["x<|endoftext|>y <|endoftext|><|endoftext|> ", ""])


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    same([text])


def test_every_token_encodes_to_itself():
    assert all(len(ids) == 1 for _, ids in OWN.vocabulary.encode_words(list(OWN.vocabulary.ids)))


def test_small_caches_change_nothing(documents, monkeypatch):
    texts = [r["text"] for r in documents.select("text").limit(60).collect()]
    wanted = OWN.encode(texts)
    monkeypatch.setattr(bpe, "CACHE", 50)
    monkeypatch.setattr(bpe, "PAIRS", 10)
    monkeypatch.setattr(bpe, "CHUNK", 2000)
    small = bpe.Encoder(PATH)
    assert [x for c in bpe._chunks(texts) for x in small.encode(c)] == wanted


def test_edge_cases(edge, nothing):
    out = bpe.encode(edge, PATH, decoded=True).toPandas()
    texts = {r["doc_id"]: r["text"] for r in edge.collect()}
    assert len(out) == edge.count()
    for r in out[out.doc_id.notna()].itertuples():
        assert r.text == (texts[r.doc_id] or "")
    assert queries.encoded_digests(nothing).count() == 0
    two = bpe.decode(bpe.encode(edge, PATH), PATH)
    assert sorted(two.toPandas().text) == sorted(out.text)


def test_other_kinds_of_files_are_refused():
    import json

    import pytest

    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    bpe.check_kind(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"model": spec["model"] | {"type": "Unigram"}}, {"model": spec["model"] | {"ignore_merges": True}}):
        with pytest.raises(ValueError):
            bpe.check_kind(spec | change)
