"""Piece encoding, offsets and decoding against the sentencepiece library."""

import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from tesserae.llm import pieces, queries
from tesserae.llm.charmap import NORMAL, UNUSED, Model, normalise
from tesserae.llm.tokenization import public_path
from tests.llm.test_texts import frame, texts

PARTS = ["a", "b", " ", "  ", "▁", "the ", "é", "日本", "😀", "\n", "\t", "\x00", "<s>", "</s>", "<0x41>", "1", "Hello", "   x", "ﬁ", "́", "İ", "ab" * 5]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def own():
    return pieces.pieces(public_path("piece_bpe_32k.model"))


def strings(n=400):
    rng = random.Random(2)
    return ["", " ", "  ", " a", "▁", "▁▁a", " " * 500 + "x" * 500, *(t or "" for t in texts()), *("".join(rng.choices(PARTS, k=rng.randrange(1, 40))) for _ in range(n))]


@pytest.mark.parametrize("short", [64, 0])
def test_encoding_and_spans(own, library, monkeypatch, short):
    monkeypatch.setattr(pieces, "SHORT", short)
    own.memo.clear()
    own.memo.old.clear()
    for t in strings():
        ids, starts, ends = own.encode(t)
        assert ids.tolist() == library.encode(t, add_bos=True, add_eos=True)
        assert own.decode(ids) == library.decode(ids.tolist())
        n = len(t.encode())
        assert (starts[0], ends[0], starts[-1], ends[-1]) == (0, 0, n, n)
        assert starts[1:].tolist() == ends[:-1].tolist()  # the spans tile the text
        for k, s, e, p in zip(ids[1:-1], starts[1:-1], ends[1:-1], library.encode(t, return_type="proto").pieces):
            assert k == p.id and (k < 259 or (s, e) == (p.begin, p.end))


def test_decoding_of_any_ids(own, library):
    rng = random.Random(3)
    for _ in range(2000):
        ids = [rng.choice([0, 1, 2, 3 + rng.randrange(256), rng.randrange(32000), 29871]) for _ in range(rng.randrange(12))]
        assert own.decode(np.array(ids, "<u4")) == library.decode(ids)


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("trim", [False, True])
@pytest.mark.parametrize("prefix", [False, True])
def test_normalisation_and_offsets(rule, trim, prefix):
    """Compiled character maps that come with the library; its offsets count characters."""
    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=trim, escape_whitespaces=True)
    model, rng = Model(lib.serialized_model_proto()), random.Random(4)
    assert (model.trim, model.dummy_prefix, bool(model.charmap.units)) == (trim, prefix, rule != "identity")
    pool = [chr(c) for a, b in ((1, 0x250), (0x300, 0x370), (0x1100, 0x1200), (0x200B, 0x2010), (0x3000, 0x3400), (0xAC00, 0xAC40), (0xFF00, 0xFFEF)) for c in range(a, b)] + [" "] * 300
    for _ in range(400):
        t = " " * rng.randrange(3) + "".join(rng.choices(pool, k=rng.randrange(12))) + " " * rng.randrange(3)
        want, at = lib.normalize(t, with_offsets=True)
        got, where = normalise(t, model)
        assert got == want
        if got:
            chars = np.cumsum([0, *((b & 0xC0) != 0x80 for b in t.encode())])
            first = [k for k, b in enumerate(got.encode()) if (b & 0xC0) != 0x80]
            assert [int(chars[where[k]]) for k in [*first, -1]] == list(at)


def varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def message(*fields):
    out = b""
    for k, v in fields:
        out += varint(k << 3 | (0 if isinstance(v, int) else 5 if isinstance(v, np.float32) else 2))
        out += varint(v) if isinstance(v, int) else v.tobytes() if isinstance(v, np.float32) else varint(len(v)) + v
    return out


def small(vocabulary, kinds=None, byte_fallback=0, **rules):
    """A model file of merged pieces, by falling score."""
    named = [("<unk>", 2), ("<s>", 3), ("</s>", 3), *((p, (kinds or {}).get(p, NORMAL)) for p in vocabulary)]
    own = [(1, message((1, p.encode()), (2, np.float32(-k)), (3, t))) for k, (p, t) in enumerate(named)]
    return message(*own, (2, message((3, 2), (35, byte_fallback))), (3, message((1, b"x"), *((int(k[1:]), v) for k, v in rules.items()))))


@pytest.mark.parametrize("kinds", [{}, {"ab": UNUSED}, {"ab": UNUSED, "abc": UNUSED}])
@pytest.mark.parametrize("words", [["▁", "a", "b", "c", "ab", "abc", "▁a"], ["▁", "a", "b", "c", "bc", "ab", "a▁", "abc", "c▁b"]])
@pytest.mark.parametrize("trim", [0, 1])
def test_small_models(kinds, words, trim):
    """Unused pieces, pieces across marks, unknown characters without byte fallback."""
    data, rng = small(words, kinds, f4=trim), random.Random(5)
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Pieces(data)
    for _ in range(300):
        t = "".join(rng.choices(["a", "b", "c", " ", "é", "日"], k=rng.randrange(14)))
        ids, starts, ends = own.encode(t, False, False)
        assert ids.tolist() == lib.encode(t)
        assert [(int(s), int(e)) for s, e in zip(starts, ends)] == [(p.begin, p.end) for p in lib.encode(t, return_type="proto").pieces]
        assert own.decode(ids) == lib.decode(ids.tolist())


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Pieces(small(["a"], {"a": 4}))


def test_op12(spark, library, tmp_path):
    rows = [*enumerate([*strings(60), None, "long words " * 30_000]), (None, "no id"), (3, "twice"), (3, "twice")]
    frame(spark, rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.spanned_bytes) for r in queries.QUERIES["op12_sentencepiece"](spark, str(tmp_path)).collect())
    want = []
    for key, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((key is None, key or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), len((t or "").encode())))
    assert got == sorted(want)
    assert pieces.decode_pieces(pieces.encode_pieces(frame(spark, []))).count() == 0
    spans = pieces.encode_pieces(frame(spark, [(1, "é 日本 x")])).first()
    assert (spans.starts[1], spans.ends[-2]) == (0, 11) and all(s <= e for s, e in zip(spans.starts, spans.ends))

