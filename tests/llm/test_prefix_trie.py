import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from almacen.llm import prefix_trie


def _plain(rows):
    """The contract in plain Python over ``(conv_id, turn, role, text)``."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    out = Counter()
    for node, convs in members.items():
        below = [n for n in members if n[:len(node)] == node]
        parents = {n[:-1] for n in members if n}
        ends = ",".join(map(str, sorted(c for c in convs if len(paths[c]) == len(node))))
        out[min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
            sum(n[:-1] == node for n in members if n), sum(n not in parents for n in below),
            sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in below if n), hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def _rows(seed, convs):
    rnd = random.Random(seed)
    texts = ["", "a", "ü" * 3, "hello there", "x" * 100]
    rows = []
    for c in range(convs):
        if c % 3 == 0:                                  # a third of the conversations are alike
            rows += [(c, k, "user", "the same") for k in range(4)]
        else:
            rows += [(c, k, rnd.choice(["user", "assistant", None]), rnd.choice(texts)) for k in range(rnd.randint(1, 6))]
    rows += [(convs, k, "user", rnd.choice(texts)) for k in range(200)]                         # a very long one
    rows += [(convs + 1, None, "system", None), (convs + 1, 1, "user", "q"), (convs + 1, None, None, "z")]
    rows += [(convs + 2, 1, "user", "b"), (convs + 2, 1, "assistant", "b"), (convs + 2, 1, "user", "a")] * 2
    rows += [(None, 0, "user", "lost"), (convs + 3, 0, "us", "er x"), (convs + 4, 0, "use", "r x"), (10**12, 0, "user", "far")]
    rnd.shuffle(rows)
    return rows


def _got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert all(t == "bigint" for c, t in df.dtypes if c != "ends_sha256")
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("shard_turns, piece, broadcast", [(1 << 18, 1 << 16, None), (40, 8, None), (40, 16, "-1"), (700, 8, None)])
def test_equals_the_plain_version(spark, monkeypatch, shard_turns, piece, broadcast):
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", shard_turns)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if broadcast:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        rows = _rows(shard_turns, 90)
        df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                                   "conv_id long, turn long, role string, text string, depth int, node string")
        assert _got(prefix_trie.prefix_trie(df)) == _plain(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_equal_conversations_alone(spark, monkeypatch):
    """A single path, parted over all shards: every node is a skeleton node."""
    monkeypatch.setattr(prefix_trie, "SHARD_TURNS", 10)
    rows = [(5 * c, k, "user", f"t{k}") for c in range(30) for k in range(3)]
    got = _got(prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert got == _plain(rows) and len(got) == 4


def test_conversations_without_turns_end_at_the_root(spark):
    # No base, and a shared head longer than the conversation itself: nothing is left.
    c = next(c for c in range(1, 100) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(c, 0, "user", "a"), (c, 1, "assistant", "b")]
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(r)[:7] for r in got] == [(c, 0, None, 1, 0, 1, 0)]
    assert got[0]["ends_sha256"] == hashlib.sha256(str(c).encode()).hexdigest()


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(df).count() == 0
