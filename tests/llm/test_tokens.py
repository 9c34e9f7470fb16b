import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tillweave.llm import packing, token_counts, token_files
from tillweave.llm.encoding import CachedEncoder
from tillweave.llm.tables import new_path

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
ENCODERS = {p: CachedEncoder(p, words=50, parts=20) for p in (BYTE, WORD)}
PIECES = sentencepiece.SentencePieceProcessor(model_file=PIECE)
TEXT = st.text(alphabet=list("abXYZ'st   \n\t\r.,!<|>09é ñ\xa0　​\x1c\x85\x00中²ⅧßİΣς😀-_`{}́▁"), max_size=60)


@settings(max_examples=400, deadline=None)
@given(TEXT)
def test_chunks_encode_like_the_whole(text):
    for path, own in ENCODERS.items():
        assert np.frombuffer(own.encode(text), "<u4").tolist() == own.library.encode(text, add_special_tokens=False).ids
    assert sum(token_counts.part_length(PIECE, p) for p in token_counts.pre_tokens(text)) * bool(text) == len(PIECES.encode(text))


def test_special_strings_and_spaces():
    for text in ("<|endoftext|>", "a <|endoftext|> b", "x<|startoftext|>y", "  lead", "trail  ", "a  b", "a \n b\n", "don't it's 'tis ,'s"):
        for own in ENCODERS.values():
            assert np.frombuffer(own.encode(text), "<u4").tolist() == own.library.encode(text, add_special_tokens=False).ids


def test_counts_of_whole_texts(odd, empty):
    rows = token_counts.token_counts(odd, PIECE, limit=10, entries=5).collect()
    texts = Counter((r["doc_id"], r["text"] or "") for r in odd.collect())
    expected = Counter((i, len(t.encode()), len(PIECES.encode(t)), len(PIECES.encode(t)) > 10) for i, t in texts.elements())
    assert Counter(tuple(r) for r in rows) == expected
    assert token_counts.token_counts(empty, PIECE).count() == 0


def test_documents_are_counted_as_the_library_does(spark, documents):
    """Over the whole table, with a table of frequent parts from a few documents and a cache that overflows."""
    counted = token_counts.token_counts(documents, PIECE, entries=50, sample_rows=20, cache=100)
    got = {r["doc_id"]: r["n_tokens"] for r in counted.collect()}
    assert got == {r["doc_id"]: len(PIECES.encode(r["text"] or "")) for r in documents.collect()}
    assert "Exchange" not in counted._jdf.queryExecution().toString()


def test_frequent_parts_are_bounded_and_right(documents, empty):
    table = token_counts.frequent_parts(documents, PIECE, entries=30, sample_rows=100)
    assert 0 < len(table) <= 30
    assert all(n == token_counts.part_length(PIECE, p) for p, n in table.items())
    assert token_counts.frequent_parts(empty, PIECE) == {}


def expected_ids(path, text, end):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_files_round_trip_and_keyed_access(spark, odd):
    folder = new_path(spark, "test-token-files")
    token_files.write_token_files(odd, WORD, folder, end_id=2, shards=3)
    got = token_files.read_documents(spark, folder).collect()
    source = sorted(odd.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ""))
    start, expected = 0, []
    for r in source:
        ids = expected_ids(WORD, r["text"], 2)
        expected.append((r["doc_id"], start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expected
    keys = spark.createDataFrame([(1,), (8,), (7,), (-5,), (1000,), (None,)], "k long")
    found = {r["key"]: r["ids"] for r in token_files.fetch(spark, folder, keys).collect()}
    assert found[8] == expected_ids(WORD, source[[r["doc_id"] for r in source].index(8)]["text"], 2)
    assert found[-5] is None and found[1000] is None and found[None] is None


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(3).integers(-(2**62), 2**62, 20_000))
    perfect = token_files.PerfectHash.build(keys)
    assert sorted(perfect.slots(keys).tolist()) == list(range(len(keys)))
    shard = token_files.Shard.of_bytes(token_files.shard_bytes(np.sort(keys), np.ones(len(keys), np.int64), b"\0\0" * len(keys), 2))
    assert (shard.find(np.sort(keys)) == np.arange(len(keys))).all()
    assert (shard.find(np.arange(5000)) == -1).mean() > 0.999


def test_no_documents_no_shards(spark, empty):
    folder = new_path(spark, "test-token-files")
    assert token_files.write_token_files(empty, WORD, folder).count() == 0
    assert token_files.read_documents(spark, folder).count() == 0


def check_packing(rows, docs, most):
    lengths = Counter()
    by_sequence = defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
        lengths[r["length"]] += 1
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= most
    for r in docs:
        ids = expected_ids(BYTE, r["text"], 0)
        starts = {(p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in by_doc[r["doc_id"]]}
        at = 0
        for number, length in enumerate(packing.cut_lengths(len(ids), most)):
            assert (number, at, length, crc(ids[at : at + length])) in starts
            at += length
    return by_sequence, lengths


def best_fit_decreasing(lengths, most):
    gaps = []
    for length in sorted(lengths.elements(), reverse=True):
        fitting = [g for g in gaps if g >= length]
        if fitting:
            gaps.remove(min(fitting))
        gaps.append((min(fitting) if fitting else most) - length)
    return len(gaps)


def test_packing_is_whole_and_as_tight_as_best_fit(odd, documents, empty):
    for docs, most in ((odd, 64), (documents, 2048)):
        rows = packing.pack_documents(docs, BYTE, most=most).collect()
        sequences, lengths = check_packing(rows, docs.collect(), most)
        assert len(sequences) <= best_fit_decreasing(lengths, most)
    assert packing.pack_documents(empty, BYTE).count() == 0


def test_words_encoded_together_give_the_same_ids(monkeypatch, documents):
    """Against the library's ids of whole texts, with caches so small that they turn over, and waiting texts of few words."""
    from tillweave.llm import encoding

    monkeypatch.setattr(encoding, "_WAITING", 50)
    monkeypatch.setattr(encoding, "_TOGETHER", 7)
    texts = [r.text for r in documents.select("text").limit(60).collect()] + ODD_TEXTS
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        some = encoding.CachedEncoder(public_tokenizers.path(name), words=40, parts=9)
        want = [np.array(some.library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert some.encode_all(texts) == want and some.encode_all(texts) == want


ODD_TEXTS = [
    None, "", " ", "a", " a", "a ", "a  b", "İstanbul İ! x", "naïve café, déjà vu", "don't they'll I'M we've", "x\ny z", "1 22 333 4a5 b6",
    "<|endoftext|> a b", "中文 字 a", "a\u0301 b e\u0301e c", "ǅ ǆ ß ẞ ſt ﬁ x", "tab\tin side", "a b\u00a0c d", "- -- --- a- -b", "😀 a 😀b c😀 d",
]


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, max_size=4))
def test_texts_encoded_together_are_encoded_like_the_whole(texts):
    for own in ENCODERS.values():
        want = [np.array(own.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert own.encode_all(texts) == want


def test_a_word_is_learned_once_whatever_stands_around_it():
    """Ends of sentences and lines take no cache entries of their own, and nothing is handed to the library word by word."""
    stems = [a + b + c for a in ("ab", "ün", "qu", "st") for b in ("or", "el", "é") for c in ("ing", "tion", "m", "xe")]
    rest = [f"{a}{end} {b}" for a, b in zip(stems, stems[1:]) for end in (",", ".", ";", "!")]
    texts = ["x " + " y ".join(rest) + " z", "x " + " y ".join(f"{a}.\n{b}" for a in stems for b in stems[:8]) + " z"]
    for path in (BYTE, WORD):
        own, alone = CachedEncoder(path), []
        one = own._ids
        own._ids = own.parts.compute = lambda text: alone.append(text) or one(text)
        want = [np.array(own.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert own.encode_all(texts) == want
        assert len(own.words) <= 2 * len(stems) + 10
        assert len(alone) <= 10
