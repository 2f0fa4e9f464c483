"""BPE, JPEG media, packing, chat formatting: round trips and brute force, with awkward rows."""

import base64
import collections
import hashlib
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tonewright.llm import bestfit_packing, byte_bpe, chat_format, jpeg_dc

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
AWKWARD = [
    (1, "Plain words, twice. Plain words, twice.", "en", "x"),
    (2, None, None, None),
    (3, "", "fr", "x"),
    (4, "it's  IT'S\n\n\tdon't \x1c x 　é漢字🙂 \x85 <|endoftext|>", "de", "x"),
    (5, "lorem " * 30000, "en", "x"),
    (6, "a" * 5000 + "!" * 3000 + " " * 3000, "en", "x"),
    (7, "Plain words, twice. Plain words, twice.", "en", "x"),
    (7, "Plain words, twice. Plain words, twice.", "en", "x"),
    (None, "no id", "en", "x"),
]
SCHEMA = "doc_id long, text string, lang string, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def clashing(spark, docs):
    """The rows with columns named as the operators name theirs."""
    names = ["piece", "start", "length", "sequence_id", "fp", "n_tokens", "payload", "media", "ids_crc32", "salt", "row"]
    return docs.select("*", *[F.lit("x").alias(n) for n in names])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def reference_bpe():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_library(docs, empty):
    library = reference_bpe()
    rows = byte_bpe.encode_decode(docs, RANKS, public_tokenizers.PATTERN, keep_ids=True).collect()
    assert len(rows) == len(AWKWARD)
    texts = sorted((str(i), t or "") for i, t, *_ in AWKWARD)
    for row, (_, text) in zip(sorted(rows, key=lambda r: (str(r.doc_id), r.ids_sha256)), sorted(texts, key=lambda x: (x[0], hashlib.sha256(",".join(map(str, library.encode_ordinary(x[1]))).encode()).hexdigest())), strict=True):
        ids = library.encode_ordinary(text)
        assert row.ids == ids and row.n_tokens == len(ids)
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.encode_decode(empty, RANKS, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab c'sdtl \n\t\x1c\x85\xa0　1٣!?é漢🙂̄", max_size=80))
def test_bpe_any_text(text):
    assert byte_bpe.codec(RANKS, public_tokenizers.PATTERN).encode(text) == reference_bpe_cached().encode_ordinary(text)


_LIBRARY = []


def reference_bpe_cached():
    if not _LIBRARY:
        _LIBRARY.append(reference_bpe())
    return _LIBRARY[0]


@pytest.mark.parametrize("alphabet", ["a", "ab", "aeinst", " \n", "the of and", "漢字かな", "0123456789", "=-_"])
def test_bpe_of_long_pieces(alphabet):
    """Pieces of one row a matrix, with repeats that overlap, touch, and make pairs of lower ranks."""
    import random

    bpe, library = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN), reference_bpe()
    rng = random.Random(len(alphabet))
    for n in [*range(2, 40), 300, 3000]:
        piece = "".join(rng.choice(alphabet) for _ in range(n))
        assert bpe.merge_one(piece.encode()).tolist() == library._core_bpe.encode_single_piece(piece.encode()), piece[:80]
    piece = alphabet * (60_000 // len(alphabet))
    assert bpe.merge_one(piece.encode()).tolist() == library._core_bpe.encode_single_piece(piece.encode())


def test_clashing_columns(docs, clashing):
    order = lambda df: sorted(map(repr, df.collect()))
    for run in (
        lambda d: byte_bpe.encode_decode(d, RANKS, public_tokenizers.PATTERN),
        lambda d: bestfit_packing.pack_documents(d, WORDS).drop("sequence_id", "offset"),
        lambda d: jpeg_dc.digest_media(jpeg_dc.encode_media(d)),
    ):
        assert order(run(clashing)) == order(run(docs))


def test_media_round_trip(docs, empty):
    rows = {(r.doc_id, r.n_bytes): r for r in jpeg_dc.digest_media(jpeg_dc.encode_media(docs)).collect()}
    for name, text, *_ in AWKWARD:
        raw = (text or "").encode()
        payload = jpeg_dc.padded(raw)
        row = rows[name, len(raw)]
        assert len(payload) % 576 == 0 and row.payload_bytes == len(payload)
        assert row.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert row.tail_crc32 == zlib.crc32(payload[-32:])
    assert rows[1, 39].feature == rows[7, 39].feature
    assert jpeg_dc.digest_media(jpeg_dc.encode_media(empty)).count() == 0


def test_jpeg_of_several_pictures():
    payload = bytes(np.random.default_rng(1).integers(0, 256, 576 * 700, dtype=np.uint8))
    (stream,) = jpeg_dc.encode_payload([payload])
    (frames,) = jpeg_dc.decode_frames([stream])
    assert len(frames) == 3 and frames[0].width == 192
    assert b"".join(f.luminance.tobytes() for f in frames) == payload


def test_jpeg_with_ac_and_colour():
    """A 4:2:0 picture made bit by bit here, with AC codes and no restart markers."""
    rng = np.random.default_rng(2)
    dc = {s: 4 for s in range(12)}
    ac = {0x00: 2, 0xF0: 4, 0x01: 3, 0x12: 3, 0x23: 4}
    dc_table, dc_codes = jpeg_dc.canonical(dc)
    ac_table, ac_codes = jpeg_dc.canonical(ac)
    bits, wanted, level = [], [], [0, 0, 0]
    put = lambda code, n: bits.extend((code >> (n - 1 - i)) & 1 for i in range(n))
    across, down = 3, 2
    for _ in range(across * down):
        for component in (0, 0, 0, 0, 1, 2):
            value = int(rng.integers(-60, 60))
            diff = value - level[component]
            level[component] = value
            size = abs(diff).bit_length()
            put(*dc_codes[size])
            put(diff if diff > 0 else diff + (1 << size) - 1, size)
            if component == 0:
                wanted.append(value)
            for _ in range(int(rng.integers(0, 4))):
                symbol = int(rng.choice([0xF0, 0x01, 0x12, 0x23]))
                put(*ac_codes[symbol])
                put(int(rng.integers(0, 1 << (symbol & 15))), symbol & 15)
            put(*ac_codes[0])
    bits += [1] * (-len(bits) % 8)
    data = np.packbits(np.array(bits, np.uint8)).tobytes().replace(b"\xff", b"\xff\x00")
    sof = struct.pack(">BHHB", 8, down * 16, across * 16 - 3, 3) + b"\x01\x22\x00\x02\x11\x01\x03\x11\x01"
    stream = b"\xff\xd8" + jpeg_dc.segment(0xE0, b"JFIF\0") + jpeg_dc.segment(0xDB, b"\x00" + bytes([16] * 64) + b"\x01" + bytes([3] * 64)) + jpeg_dc.segment(0xC0, sof)
    stream += jpeg_dc.segment(0xC4, b"\x00" + dc_table + b"\x10" + ac_table) + jpeg_dc.segment(0xDA, b"\x03\x01\x00\x02\x00\x03\x00\x00\x3f\x00") + data + b"\xff\xd9"
    ((frame,),) = jpeg_dc.decode_frames([stream])
    assert (frame.width, frame.height) == (across * 16 - 3, down * 16)
    grid = np.array(wanted).reshape(down, across, 2, 2).transpose(0, 2, 1, 3).reshape(down * 2, across * 2)
    assert (frame.luminance == ((grid * 16 + 4) // 8 + 128).clip(0, 255)).all()


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    rows = bestfit_packing.pack_documents(docs, WORDS).collect()
    bins, pieces = {}, {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    for name, text, *_ in AWKWARD:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        copies = sum(1 for i, *_ in AWKWARD if i == name)
        cuts = [ids[k : k + 2048] for k in range(0, len(ids), 2048)]
        want = sorted((k, 2048 * k, len(c), zlib.crc32(struct.pack(f"<{len(c)}I", *c))) for k, c in enumerate(cuts)) * copies
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[name]) == sorted(want)
    assert bestfit_packing.pack_documents(empty, WORDS).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plan_fills_bins(counts):
    plan = bestfit_packing.plan_best_fit(counts, 64)
    taken, bins = {}, {}
    for length, first, last, start, each, base in plan:
        taken.setdefault(length, []).extend(range(first, last))
        for rank in range(first, last):
            place = rank - first
            bins.setdefault(start + place // each, []).append((base + place % each * length, length))
    assert {k: sorted(v) for k, v in taken.items()} == {k: list(range(n)) for k, n in counts.items()}
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(k * n for k, n in counts.items())
    assert len(bins) <= 1 + 1.5 * total / 64 + sum(n for k, n in counts.items() if k > 32)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab c'sT \n\x1c\xa0|1!?.,;É×÷é漢🙂İΣ<>#&", max_size=60))
def test_word_ids_any_text(text):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    library.encode_special_tokens = True
    texts = pa.array(["before", text, None, "", text[::-1], f" {text}\x0b"])
    found = bestfit_packing.word_ids(WORDS).of_texts(texts.slice(1))
    for ids, own in zip(found, texts.to_pylist()[1:], strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(own or "", add_special_tokens=False).ids


def test_other_tokenizer_files_are_refused():
    with pytest.raises(ValueError, match="another way"):
        bestfit_packing.WordIds(public_tokenizers.path("byte_bpe_50k.json"))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    """As many bins as best-fit-decreasing over single pieces makes."""
    rooms: list[int] = []
    for length in sorted(lengths, reverse=True):
        fitting = [i for i, room in enumerate(rooms) if room >= length]
        if fitting:
            rooms[min(fitting, key=rooms.__getitem__)] -= length
        else:
            rooms.append(64 - length)
    plan = bestfit_packing.plan_best_fit(dict(collections.Counter(lengths)), 64)
    bins = {start + (rank - first) // each for _, first, last, start, each, _ in plan for rank in range(first, last)}
    assert len(bins) == len(rooms)


def test_chat_round_trip(spark):
    texts = ["plain", None, "", "\\", "\\\\n", "### user: hi", "####", "</turn>", "<\\/turn>\n", "a</turn>\n### assistant: b</turn>\n", chat_format.EXTRA_TEXT, "#</turn", "x" * 50000, "ends \\"]
    rows = [(c, i, role, t, 9) for c, order in enumerate((texts, texts[::-1], [])) for i, t in enumerate(order) for role in (["assistant", "us: er\n", None][i % 3],)]
    rows += [(0, None, "system", "first"), (0, 3, "user", "tie"), (0, 3, "user", "tie"), (None, 1, "user", "lost")] and [(0, None, "system", "first", 1), (0, 3, "user", "tie", 1), (0, 3, "user", "tie", 1), (None, 1, "user", "lost", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    out = chat_format.format_conversations(df)
    assert out.filter("not round_trip").count() == 0
    spans = out.select("conv_id", "formatted", "turns", chat_format.loss_spans(out["cuts"]).alias("spans")).collect()
    for r in spans:
        bodies = [t.body for t in r.turns if t.role == "assistant"]
        assert [r.formatted[s.first : s.last] for s in r.spans] == bodies
    for r in chat_format.digests(out).collect():
        own = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text, _ in rows if c == r.conv_id))
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{text}\n" for _, role, text in own).encode()).hexdigest()
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat_format.digests(chat_format.format_conversations(df.limit(0))).count() == 0


def test_loss_digest_follows_the_mask(spark):
    rows = [(1, 0, "user", "ask"), (1, 1, "assistant", "a</turn>\\ ###"), (1, 2, "assistant", "second")]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    wrong = out.withColumn("loss_spans", F.slice("loss_spans", 1, 1))
    for df, loss in ((out, rows[1][3] + "second"), (wrong, rows[1][3])):
        (r,) = chat_format.digests(df).collect()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_a_lost_round_trip_ends_the_job(spark):
    rows = [(1, 0, "user", "ask"), (1, 1, "assistant", "answer")]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert chat_format.digests(out).count() == 1
    with pytest.raises(Exception, match="does not parse back to its source: 1"):
        chat_format.digests(out.withColumn("round_trip", F.lit(False))).collect()
