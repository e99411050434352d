import hashlib
import random
import re
import zlib

import pytest

from shelfmark.llm import prefix_trie as P
from shelfmark.llm import scans
from shelfmark.llm.common import Scratch

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Nodes by a plain walk, from (conv_id, turn, role, text) with different turns in a conversation."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), (role or "", text or "")))
    convs = {c: [x for _, x in sorted(v)] for c, v in convs.items()}
    members = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        turns = convs.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[h:]
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append((c, len(turns) == d))
    below = {}
    for k in members:
        if k:
            below.setdefault(k[:-1], []).append(k)
    out, sums = [], {}
    for k in sorted(members, key=len, reverse=True):
        n, kids = len(members[k]), below.get(k, [])
        tokens = len(re.findall("[^\x20\x09-\x0d]+", k[-1][1])) if k else 0
        sums[k] = (sum(sums[x][0] for x in kids) or 1, (n - 1) * tokens + sum(sums[x][1] for x in kids))
        ends = ",".join(map(str, sorted(c for c, last in members[k] if last)))
        out.append((min(c for c, _ in members[k]), len(k), min(c for c, _ in members[k[:-1]]) if k else None, n, len(kids), *sums[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_all_conversations_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    expected = brute([(r.conv_id, r.turn, r.role, r.text) for r in table.collect()])
    assert found(P.prefix_trie(table)) == expected
    # small blocks and every round of the ranks, to the last two pieces
    assert found(P.prefix_trie(table.repartition(7), block=16, last=2)) == expected


def test_random_conversations(spark):
    rng = random.Random(3)
    rows = []
    for c in [*range(-30, 90), 10**15, 10**15 + 1]:
        for t in range(rng.choice([1, 1, 2, 4, 9])):
            rows.append((c, None if t == 0 else t, rng.choice(["user", "bot", None]), rng.choice(["a b", "c", "", None])))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(P.prefix_trie(table, block=32, last=4)) == brute(rows)


def test_one_conversation_has_most_rows_and_many_share_a_beginning(spark):
    rows = [(5, t, "user", f"t{t % 7}") for t in range(3000)]
    rows += [(c, t, "user", "same" if t < 3 else f"{c}") for c in range(20, 400) for t in range(4)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert found(P.prefix_trie(table.repartition(5), block=64, last=8)) == brute(rows)


def test_edges(spark):
    kind = "conv_id long, turn int, role string, text string, depth string, number int"
    rows = [(1, 0, None, None, "x", 1), (None, 0, "user", "lost", "x", 1), (41, 0, "a", "w " * 200_000, "x", 1), (2, 3, "a", "b", "x", 1), (2, 3, "a", "b", "x", 1)]
    table = spark.createDataFrame(rows, kind)
    nodes = P.prefix_trie(table).collect()
    assert [r.n_convs for r in nodes if r.depth == 0] == [3]
    assert P.prefix_trie(table.limit(0)).count() == 0
    turnless = spark.createDataFrame([(c, 0, "u", "t") for c in (21, 22, 23, 24)], "conv_id long, turn int, role string, text string")
    assert found(P.prefix_trie(turnless)) == brute([tuple(r) for r in turnless.collect()])


def test_a_node_where_many_end(spark, monkeypatch):
    monkeypatch.setattr(P, "PIECE", 64)
    rows = [(c, 0, "u", "t") for c in range(1000)]
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    assert found(P.prefix_trie(table)) == brute(rows)


@pytest.mark.parametrize("base", [0, 1, 0x9E3779B97F4A7C15])
def test_scan_over_groups_of_all_sizes(spark, base):
    rng = random.Random(base)
    rows = [(g, i, rng.randrange(-(10**12), 10**12)) for g, n in enumerate([1, 500, 2, 3, 900, 1]) for i in range(n)]
    df = spark.createDataFrame(rows, "g long, i int, v long").repartition(9)
    for group in ("g", None):
        expected, h, place, last = {}, 0, 0, None
        for g, i, v in rows:
            if group and g != last:
                h, place = 0, 0
            before, h, place, last = h, (h * base + v) % 2**64, place + 1, g
            expected[g, i] = (place, before, h)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
        try:
            out = scans.scan(df, ["g", "i"], {"v": base}, Scratch(spark), group).collect()
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        assert {(r.g, r.i): (r.place, r.v_before % 2**64, r.v_with % 2**64) for r in out} == expected


@pytest.mark.parametrize("shuffled", [False, True])
def test_ranks_of_a_list(spark, shuffled):
    n = 700
    order = list(range(n))
    if shuffled:
        random.Random(1).shuffle(order)
    links = spark.createDataFrame(list(zip(order, [*order[1:], None])), "id long, next long")
    ranks = {r.id: r.rank for r in scans.list_ranks(links, Scratch(spark), block=64, last=3).collect()}
    assert ranks == {x: i for i, x in enumerate(order)}
