import random
import zlib
from array import array
from collections import defaultdict

from samples import SF
from tokenizers import Tokenizer

from almacen.llm import packing, queries
from almacen.llm.common import table

PATH = queries.tokenizer("word_bpe_49k.json")


def _check(pieces, docs, capacity=2048):
    lib = Tokenizer.from_file(PATH)
    want = defaultdict(list)
    for i, t in docs:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        want[i].append(ids)
    got, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        got[p["doc_id"]].append(p)
        windows[p["sequence_id"]].append(p)
    assert set(got) == set(want)
    for i, copies in want.items():
        ids = copies[0]
        if any(c != ids for c in copies):
            continue
        ps = sorted(got[i], key=lambda p: p["start"])
        assert all(p["doc_tokens"] == len(ids) for p in ps)
        if len(copies) == 1:
            at = 0
            for p in ps:
                assert p["start"] == at
                at += p["length"]
            assert at == len(ids)
        for p in ps:
            part = ids[p["start"]:p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(array("I", part).tobytes())
    for ps in windows.values():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at <= capacity
    return sum(p["length"] for p in pieces), len(windows)


def test_odd_rows(odd):
    docs = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    _check(packing.pack_documents(odd.coalesce(1), PATH).collect(), docs)


def test_empty(empty):
    assert packing.pack_documents(empty, PATH).count() == 0


def test_table_with_little_padding(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    used, windows = _check(queries.op2_packing(spark, SF).collect(), docs)
    assert used > 0.95 * 2048 * windows


def test_encoder_equals_library_on_every_character():
    enc, lib = packing.WordEncoder(PATH), Tokenizer.from_file(PATH)
    chars = [chr(c) for c in range(1, 0x3400) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(chars), 7):
        text = " ".join(f"ab{c}Cd {c}" for c in chars[i:i + 7])
        assert enc.encode(text) == array("I", lib.encode(text, add_special_tokens=False).ids).tobytes(), repr(text)


def test_differencing_is_near_equal_and_pack_keeps_all():
    rnd = random.Random(1)
    for n, k in ((1, 1), (5, 8), (60, 7), (300, 40)):
        sizes = [rnd.randint(1, 900) for _ in range(n)]
        bins = packing.differencing(sizes, k)
        assert len(bins) == k and sorted(i for b in bins for i in b) == list(range(n))
        if n > 5 * k:
            loads = [sum(sizes[i] for i in b) for b in bins]
            assert max(loads) - min(loads) < 0.2 * max(loads)
    for lengths in ([2047] * 50, [1100] * 90, [1] * 5, [2048], [], [3, 2000, 60, 700] * 30):
        windows = packing.pack(lengths)
        parts = sorted(x for w in windows for x in w)
        at = defaultdict(int)
        for i, s, n in parts:
            assert s == at[i]
            at[i] += n
        assert [at[i] for i in range(len(lengths))] == lengths
        assert all(sum(n for _, _, n in w) <= 2048 for w in windows)
