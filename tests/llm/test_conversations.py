"""Operators on conversations against plain Python, with nulls, ties, repeated rows, gaps, long and empty conversations."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from episodelake.llm import common, corpus_queries, digests, list_rank, prefix_trie, turn_repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, piece long, key string, copies long"


def made(spark, rows, tmp_path):
    spark.createDataFrame([(*r, "c", 1, "k", 2) for r in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def talk(seed, n, conv):
    rng = random.Random(seed)
    out = []
    for t in range(n):
        role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
        out.append((conv, t * 2 if rng.random() < 0.1 else t * 2 + 1, role, rng.choice(["yes.", "no!", "and", "", " \t", None, f"word {rng.random()}.", "same?", "ends \x0b.\n "])))
    return out


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out[conv] += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    for conv, some in out.items():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{'' if conv is None else conv}:{str(conv is None).lower()}:{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        inner = re.sub("[\x20\x09-\x0d]", "", text)
        out.append("blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows, kinds):
    """The least (cost, audit) row by row over the states of the grammar, and the repaired rows."""
    moves = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    full = {"u": "user", "a": "assistant"}

    def with_inserts(best):
        for _ in range(3):
            for q, (cost, audit, kept) in list(best.items()):
                for i in "ua":
                    if q in moves[i]:
                        new = (cost + 5, audit + "I", [*kept, (full[i], "")])
                        best[moves[i][q]] = min(best.get(moves[i][q], new), new)
        return best

    best = {0: (0, "", [])}
    for (_, role, text), kind in zip(rows, kinds, strict=True):
        new = {}
        for q, (cost, audit, kept) in with_inserts(best).items():
            options = [(cost + 2, audit + "D", kept, q)]
            if kind not in ("blank", "duplicate"):
                extra = 5 * (kind == "truncated")
                if role[:1] in moves and q in moves[role[0]]:
                    options.append((cost + extra, audit + "K", [*kept, (role, text)], moves[role[0]][q]))
                options += [(cost + extra + 1, audit + "R", [*kept, (full[i], text)], moves[i][q]) for i in "ua" if q in moves[i]]
            for c, a, k, to in options:
                new[to] = min(new.get(to, (c, a, k)), (c, a, k))
        best = new
    return min(v for q, v in with_inserts(best).items() if q in (0, 3))


def report_of(rows):
    out = set()
    for conv, some in plain_damage(rows).items():
        kinds, turns = faults(some), [r[0] for r in some if r[0] is not None]
        first = [r[1][:1] for r in some]
        cost, audit, kept = plain_repair(some, kinds)
        gaps = max(turns) - min(turns) + 1 - len({*turns}) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.add((conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return out


TALKS = [r for i in range(150) for r in talk(i, i % 12, i)] + talk(900, 60, 900)
ODD = [(None, 1, "user", "x."), (None, None, None, None), (950, None, "user", "a."), (950, None, "assistant", "b."), (951, 3, "user", "a."), (951, 3, "user", "a."), (951, 3, "assistant", "b."), (952, 10**12, "system", "z" * 100_000), (952, -5, "user", "q.")]


def repair_query(spark, folder):
    return {tuple(r) for r in corpus_queries.op11_turn_repair(spark, folder).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}


def test_repair(spark, tmp_path):
    folder = made(spark, TALKS + ODD, tmp_path)
    assert repair_query(spark, folder) == report_of(TALKS + ODD)


def test_repair_of_nothing(spark, tmp_path):
    assert repair_query(spark, made(spark, [], tmp_path)) == set()


@pytest.mark.parametrize("rows, chunk", [(1, 2), (3, 512), (7, 3)])
def test_repair_in_pieces(spark, tmp_path, monkeypatch, rows, chunk):
    """Conversations in many small pieces have the same repair."""
    monkeypatch.setattr(turn_repair, "PIECE_ROWS", rows)
    monkeypatch.setattr(turn_repair, "CHUNK", chunk)
    some = [r for r in TALKS if r[0] % 7 == 0 or r[0] >= 900] + ODD
    assert repair_query(spark, made(spark, some, tmp_path)) == report_of(some)


def test_repair_of_a_hot_conversation(spark, tmp_path):
    """One conversation holds nearly all rows, many of them alike."""
    rows = [(1, i, "user" if i % 2 else "assistant", "again." if i % 3 else f"n {i}.") for i in range(6000)] + talk(5, 6, 2)
    assert repair_query(spark, made(spark, rows, tmp_path)) == report_of(rows)


def test_agenda_is_lightest():
    """All short conversations of all kinds of rows against the layered search, and its audits against every string of edits."""
    kinds = [(r, k) for r in ("system", "user", "assistant", "tool") for k in ("", "blank", "truncated")]
    for n in range(4):
        for some in product(kinds, repeat=n):
            rows = [(i, r, "t") for i, (r, _) in enumerate(some)]
            want = plain_repair(rows, [k for _, k in some])
            got = turn_repair.repaired(tuple((r[0], k == "blank", k == "truncated", 1) for r, k in some))
            assert got == want[:2], some
            assert [(e["role"], e["text"]) for e in turn_repair.applied([(r, "t", 1) for r, _ in some], got[1], 0) if e["edit"] != "D"] == want[2]


# --- the trie of prefixes ----------------------------------------------------


def plain_trie(rows):
    """Every node from lists of members."""
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn, role or "", text or ""))
    for some in convs.values():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()[:16]))
    paths = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        turns = [r[1:] for r in convs.get(c - c % 100, [])[:h] + own[h:]]
        for d in range(len(turns) + 1):
            node = paths.setdefault(tuple(turns[:d]), {"members": [], "ends": [], "children": set()})
            node["members"].append(c)
            if d:
                paths[tuple(turns[: d - 1])]["children"].add(tuple(turns[:d]))
        node["ends"].append(c)
    out, sums = set(), {}
    for path in sorted(paths, key=len, reverse=True):
        node = paths[path]
        own = (len(node["members"]) - 1) * len(path[-1][1]) if path else 0
        below = [sums[c] for c in node["children"]]
        sums[path] = (sum(x for x, _ in below) or 1, own + sum(x for _, x in below))
        parent = min(paths[path[:-1]]["members"]) if path else None
        ends = hashlib.sha256(",".join(map(str, sorted(node["ends"]))).encode()).hexdigest()
        out.add((min(node["members"]), len(path), parent, len(node["members"]), len(node["children"]), *sums[path], ends))
    return out


def trie_query(spark, folder):
    got = corpus_queries.op12_prefix_trie(spark, folder).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()
    assert len({*got}) == len(got)
    return {tuple(r) for r in got}


GROUPS = [(c, *r[1:]) for c in [*range(100, 160), *range(200, 230), 305, 400, 401] for r in talk(c % 7, 3 + c % 5, c)]
GROUPS += [(500, i, "user", f"é日 {i % 3}") for i in range(300)] + [(501, i, "user", f"é日 {i % 3}") for i in range(300)] + [(1001, 0, "user", "one turn only")]


def test_trie(spark, tmp_path):
    rows = GROUPS + ODD
    assert trie_query(spark, made(spark, rows, tmp_path)) == plain_trie(rows)


def test_trie_of_nothing(spark, tmp_path):
    assert trie_query(spark, made(spark, [], tmp_path)) == set()


def test_trie_in_pieces(spark, tmp_path, monkeypatch):
    """Names from pieces of conversations, lists contracted in many rounds, ids digested in pieces, hot parents broadcast."""
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(prefix_trie, "list_sums", lambda *a: list_rank.list_sums(*a, last=5))
    monkeypatch.setattr(prefix_trie, "joined_ids_sha256", lambda *a: digests.joined_ids_sha256(*a, most=3))
    rows = [*GROUPS, *[(c, i, "user", "same") for c in range(1100, 1130) for i in range(6)]]
    assert trie_query(spark, made(spark, rows, tmp_path)) == plain_trie(rows)


def test_list_sums(spark):
    """Lists whose elements lie in no order."""
    rng = random.Random(5)
    order = rng.sample(range(3000), 3000)
    lists = [order[:1], order[1:2], order[2:1500], order[1500:]]
    rows, want = [], {}
    for some in lists:
        before = 0
        for a, b in zip(some, [*some[1:], None], strict=True):
            want[a] = before
            rows.append((a, b, a % 5, rng.randrange(100)))
            before += a % 5
    df = spark.createDataFrame(rows, "id long, next long, w long, spot long")
    got = list_rank.list_sums(df, ["w"], ["spot", "id"], last=10).collect()
    assert len(got) == 3000 and {r.id: r.before_w for r in got} == want
