import random
import zlib

import numpy as np
import pytest

from helixframe.llm.packing import hilbert_keys, pack, sequence_of
from helixframe.llm.queries import tokenizer_path
from helixframe.llm.tokens import TokenIds

tokenizers = pytest.importorskip("tokenizers")


def library():
    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


TEXTS = ["", None, "Hello, World! it's 2024 don't", "ÀÉÎ ß straße İstanbul ΣΑΣ", "é café ́x", "日本語 text nbsp em", "a\x1cb\x1fc \x85d", "<|endoftext|> [x](y)'''s", "x" * 5000, "1234567 $$$ ***&&&", "🙂🙂 zwj👩‍👩‍👧"]


def test_ids_are_the_librarys():
    t, own = library(), TokenIds(open(tokenizer_path(), encoding="utf-8").read())
    r = random.Random(3)
    pool = "abcXYZ '’.,!*-_09éÀßñ\t\n ́İΣς日🙂&"
    texts = [x or "" for x in TEXTS] + ["".join(r.choice(pool) for _ in range(r.randrange(1, 60))) for _ in range(500)]
    for x in texts:
        assert own(x) == t.encode(x, add_special_tokens=False).ids, x


def test_pieces_cover_every_id_once_and_sequences_have_no_padding(spark):
    r = random.Random(5)
    rows = [(i, x) for i, x in enumerate(TEXTS)] + [(100 + i, " ".join(r.choice(["alpha", "beta", "Gamma,", "der", "und"]) for _ in range(r.choice([1, 10, 900, 3000])))) for i in range(60)]
    rows += [(7000 + i, "copy of one text") for i in range(300)] + [(None, "no id")]
    length = 256
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' as key", "1 as n")
    got = pack(df, tokenizer_path(), length=length, with_ids=True).collect()
    t = library()
    want = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x in rows}
    pieces, sequences = {}, {}
    for p in got:
        pieces.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
        assert p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and len(p.ids) == p.length > 0
    assert pieces.keys() == want.keys()
    for i, own in pieces.items():
        own.sort(key=lambda p: p.start)
        assert sum((p.ids for p in own), []) == want[i]
        assert [p.start for p in own] == list(np.cumsum([0, *[p.length for p in own]])[:-1])
        assert {p.doc_tokens for p in own} == {len(want[i])}
    assert sorted(sequences) == list(range(len(sequences)))
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        n = sum(p.length for p in own)
        assert [p.offset for p in own] == list(np.cumsum([0, *[p.length for p in own]])[:-1])
        assert n <= length and (n == length or n & (n - 1) == 0)
    assert pack(df.limit(0), tokenizer_path()).count() == 0


def test_hilbert_neighbours_are_neighbours():
    import helixframe.llm.packing as packing

    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    order = cells[np.argsort(hilbert_keys(cells))]
    assert len(set(hilbert_keys(cells).tolist())) == side**packing.DIMS
    assert (np.abs(np.diff(order, axis=0)).sum(axis=1) == 1).all()


def test_sequences_of_the_rest_are_powers_of_two():
    at = sequence_of(2048 * 2 + 1300, 2048)
    assert at(0) == (0, 0, 2048) and at(4095) == (1, 2048, 4096)
    assert [at(p)[2] - at(p)[1] for p in (4096, 4096 + 1024, 4096 + 1280, 4096 + 1296)] == [1024, 256, 16, 4]
