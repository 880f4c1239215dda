import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from understory.llm import packing, pieces, token_files, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long, ids string, length int, start int"
ALPHABET = " \n\t'a'bsS123.é<|à!中́Å​ ſK\U0001f600 re'll ßÿ²"


def texts(n, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(80))) for _ in range(n)] + ["", " ", "x<|endoftext|>y", "a  b\n\n c\t\td ", "it's it'll", "word " * 4000, "é" * 30_000]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1, 2) for i, t in rows], DOCS)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_ids_are_the_librarys(name):
    library, own = Tokenizer.from_file(tokens.path_of(name)), tokens.TextTokenizer(name)
    some = texts(1500)
    for t, ids in zip(some, own.encode_many(some), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, ascii(t)


def test_ids_are_the_librarys_on_the_tables(spark):
    library, own = Tokenizer.from_file(tokens.path_of("word_bpe_49k.json")), tokens.TextTokenizer("word_bpe_49k.json")
    some = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode_many(some)] == [e.ids for e in library.encode_batch(some, add_special_tokens=False)]


def check_packed(spark, rows, capacity):
    library = Tokenizer.from_file(tokens.path_of("word_bpe_49k.json"))
    want = sorted((library.encode(t or "", add_special_tokens=False).ids + [2] for _, t in rows), key=repr)
    got = packing.pack_documents(frame(spark, rows), capacity=capacity, least=8).collect()
    by, places = {}, {}
    for p in got:
        by.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, np.frombuffer(p.ids, "<u4").tolist()))
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert p.length == len(p.ids) // 4
    for spots in places.values():  # gapless from zero, within capacity
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted((i for found in by.values() for _, ids in sorted(found) for i in ids)) == sorted(i for ids in want for i in ids)
    for (_, n), found in by.items():
        at = 0
        for start, ids in sorted(found):
            assert start == at
            at += len(ids)
        assert at == n
    return places


def test_packing_holds_every_id_once(spark):
    rows = list(enumerate(texts(300))) + [(1000, None)]
    places = check_packed(spark, rows, 256)
    used = sum(n for spots in places.values() for _, n in spots)
    assert used / (256 * len(places)) > 0.95


def piece(doc, n):
    return doc, 0, n, bytes(4 * n), n


def test_classes_take_a_fixed_count():
    packer = packing.Packer(64, 0)
    assert packer.place(piece("filler", 40)) == []
    closed = [p for k in range(8) for p in packer.place(piece(k, 16))]
    assert [p[5] for p in closed] == [0] * 4 + [1] * 4 and [p[6] for p in closed] == [0, 16, 32, 48] * 2
    # a gap is filled from the filler's head; a full sequence closes at once
    closed = [p for k in range(3) for p in packer.place(piece(k, 15))]
    assert closed == [] and packer.place(piece(3, 15 + 64))[0][2:3] == (64,) and len(packer.open[4]) == 0
    packer = packing.Packer(64, 0, least=8)
    packer.place(piece("filler", 40))
    assert [(p[0], p[1], p[2], p[6]) for p in packer.place(piece("a", 50))] == [("a", 0, 50, 0), ("filler", 0, 14, 50)]
    assert packer.filler[1:3] == (14, 26)
    packer.place(piece("b", 34))  # takes the filler whole and waits: 34 + 26 leaves 4, under 8
    assert packer.filler is None


def test_bins_cost_one_cut_and_waste_little():
    r, packer, out, n = random.Random(3), packing.Packer(4096, 0), [], 5000
    for k in range(n):
        out += packer.place(piece(k, r.choice([r.randrange(1, 60), r.randrange(1, 900), r.randrange(1, 20_000)])))
    total = sum(p[2] for p in out)
    bins = {p[5]: 0 for p in out}
    for p in out:
        bins[p[5]] += p[2]
    assert all(4096 - 16 < size <= 4096 for size in bins.values()) and total / 4096 / len(bins) > 0.998
    assert len(out) < n + 2 * len(bins)
    rest = packer.rest()
    assert {p[5] for p in rest}.isdisjoint(bins) and sum(p[2] for p in rest) < 300 * 4096
    sizes = {}
    for p in rest:
        sizes[p[5]] = sizes.get(p[5], 0) + p[2]
    assert sum(size < 4096 for size in sizes.values()) <= 1


def test_token_files_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 4095, 4096, 4097, 60_000):
        for top in (1, 2, 50_257, 2**32 - 1):
            x = r.integers(0, top, n, dtype=np.uint32, endpoint=True)
            if n > 50:
                x[7] = 2**32 - 1
            for block in (64, 4096):
                raw = token_files.encode_ids(x, block)
                assert (token_files.decode_ids(raw) == x).all()
                assert (token_files.decode_ids(raw, n // 3, n // 2) == x[n // 3 : n // 2]).all()


def test_files_hold_their_documents():
    r = np.random.default_rng(1)
    for docs in ([], [7], list(range(300)), [-(2**62), 0, 2**62, 2**63 - 1], [5, 5, 9, None, None], ["a", "b", "b", None]):
        lengths = r.integers(1, 90, len(docs)).tolist()
        ids = r.integers(0, 50_000, sum(lengths), dtype=np.uint32)
        got = token_files.decode_file(token_files.encode_file(ids, lengths, docs))
        assert (got[0] == ids).all() and got[1].tolist() == lengths and got[2] == docs
    with pytest.raises(ValueError):
        token_files.encode_file(np.zeros(2, np.uint32), [1, 1], [None, 3])
    with pytest.raises(ValueError):
        token_files.decode_file(token_files.encode_ids(np.zeros(30, np.uint32)))


def test_named_documents_round_trip(spark):
    df = spark.createDataFrame([("b", "two words"), ("a", None), (None, "none")], "doc_id string, text string")
    got = token_files.read_token_files(spark, token_files.write_token_files(df)).orderBy("start").collect()
    assert [r.doc_id for r in got] == ["a", "b", None] and [r.start for r in got] == [0, 1, 4]


def test_outliers_do_not_widen_blocks():
    x = np.arange(4096, dtype=np.uint32) % 16
    small = len(token_files.encode_ids(x))
    x[100] = 2**31
    assert len(token_files.encode_ids(x)) <= small + 8


def test_written_files_read_back_in_order(spark):
    rows = [(k * 3, t) for k, t in enumerate(texts(200))] + [(999, None), (999, "twice"), (-5, "first")]
    library = Tokenizer.from_file(tokens.path_of("byte_bpe_50k.json"))
    path = token_files.write_token_files(frame(spark, rows), file_ids=500)
    got = sorted(token_files.read_token_files(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda x: (x[0], x[1] or "")), strict=True):
        want = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        assert (r.doc_id, r.start, zlib.crc32(r.ids)) == (i, at, zlib.crc32(want))
        at += len(want) // 4


def test_null_ids_and_empty_tables(spark):
    none = frame(spark, [])
    assert packing.pack_documents(none).count() == 0
    assert token_files.read_token_files(spark, token_files.write_token_files(none)).count() == 0
    assert pieces.round_trip(none).count() == 0
    got = token_files.read_token_files(spark, token_files.write_token_files(frame(spark, [(None, "b"), (1, "a")]))).orderBy("start").collect()
    assert [r.doc_id for r in got] == [1, None]


def test_pieces_equal_the_library_and_cover_the_text():
    m = pieces.PieceModel("piece_bpe_32k.model")
    for t in texts(1500) + ["▁ a", "\x00x", "</s> <s>", "\n\n a"]:
        ids, spans = m.encode(t)
        assert ids.tolist() == m.library.encode(t)
        raw = t.encode()
        if len(ids):
            assert spans[0, 0] == 0 and spans[-1, 1] == len(raw) and (spans[1:, 0] == spans[:-1, 1]).all()
            for k, (a, b) in zip(ids.tolist(), spans, strict=True):
                if not m.library.is_byte(k):
                    assert m.library.id_to_piece(k).encode() in ("▁".encode() + raw[a:b].replace(b" ", "▁".encode()), raw[a:b].replace(b" ", "▁".encode()))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_normalisation_by_compiled_map_equals_the_library(rule):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    proto = pb.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    own = pieces.Normalizer(proto.normalizer_spec)
    for t in texts(800) + ["ﬁ① ＡＢ　ｶﾞ  x ", "㍿  ½"]:
        normal, begin = own(t)
        assert normal.decode() == library.normalize(t)
        assert len(begin) == len(normal) + 1 and (np.diff(begin) >= 0).all()


def test_round_trip_digests(spark):
    import hashlib

    m = pieces.PieceModel("piece_bpe_32k.model")
    rows = list(enumerate(texts(60))) + [(500, None)]
    for r in pieces.round_trip(frame(spark, rows)).collect():
        t = dict(rows)[r.doc_id] or ""
        ids = m.library.encode(t)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(m.library.decode(ids).encode()).hexdigest())


def test_long_texts_are_cut_where_pre_tokens_begin(monkeypatch):
    monkeypatch.setattr(tokens, "runs", lambda text, own=tokens.runs: own(text, 50))
    some = " ".join(texts(300)).replace("Σ", "s").replace("<|endoftext|>", "")
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        library, own = Tokenizer.from_file(tokens.path_of(name)), tokens.TextTokenizer(name)
        usual = "".join(c for c in some if not tokens.unusual()(c))
        for t in (some, usual, "it's 'street ''s ,'s 's's x'RE J̌ Å " * 40):
            assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("squeeze", [False, True])
def test_every_text_goes_through_the_compiled_map(squeeze, tmp_path):
    """With another map the same path gives the library's ids, and spans that cover the text."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto, rules = pb.ModelProto(), pb.ModelProto()
    proto.ParseFromString(open(tokens.path_of("piece_bpe_32k.model"), "rb").read())
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = squeeze
    path = tmp_path / "mapped.model"
    path.write_bytes(proto.SerializeToString())
    m = pieces.PieceModel(str(path))
    assert m.normalize.starts.any() and not pieces.PieceModel("piece_bpe_32k.model").normalize.starts.any()
    for t in texts(600) + ["ﬁ① ＡＢ　ｶﾞ  x ", "㍿  ½", "  a", "á "]:
        ids, spans = m.encode(t)
        assert ids.tolist() == m.library.encode(t), ascii(t)
        assert (spans[:, 0] <= spans[:, 1]).all() and (spans[1:, 0] >= spans[:-1, 0]).all()
