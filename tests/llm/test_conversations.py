"""Prefix trie and structure repair against plain Python."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from shelfline.llm import repair, trie

EMPTY = hashlib.sha256(b"").hexdigest()
WORD = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture
def conversations(spark):
    def make(rows):
        full = [(*r, 1, "x") for r in rows]
        return spark.createDataFrame(full, "conv_id long, turn long, role string, text string, own long, turns string").repartition(3)

    return make


def by_conversation(rows, null=""):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        out[c].append((turn is not None, turn or 0, null if role is None else role, null if text is None else text))
    return {c: sorted(v) for c, v in out.items()}


def brute_trie(rows):
    own = {c: [t[2:] for t in v] for c, v in by_conversation(rows).items() if c is not None}
    paths = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    out = set()
    for node, cs in members.items():
        sub = [x for x in members if x[: len(node)] == node]
        children = [x for x in sub if len(x) == len(node) + 1]
        leaves = [x for x in sub if not any(y[: len(x)] == x and len(y) > len(x) for y in sub)]
        saved = sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in sub if x)
        ends = sorted(c for c in cs if len(paths[c]) == len(node))
        said = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        parent = min(members[node[:-1]]) if node else None
        out.add((min(cs), len(node), parent, len(cs), len(children), len(leaves), saved, said))
    return out


def nodes_of(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def shared(seed, n=150, long=40):
    """Conversations that share beginnings, many equal ones, some without turns of their own, a few long ones."""
    rnd = random.Random(seed)
    texts = ["yes", "no way", "", None, "a b c", "tell me more . "]
    rows = []
    for c in rnd.sample(range(400), n):
        length = rnd.choice([1, 1, 2, 3, 4, 5, rnd.randrange(1, long)])
        body = ["go", "on"] if c % 3 == 0 else [rnd.choice(texts) for _ in range(length)]
        for turn, text in enumerate(body):
            rows.append((c, turn if rnd.random() < 0.95 or turn else None, rnd.choice(["user", "assistant"]) if turn > 3 else "user", text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("turns", [1 << 18, 7])
def test_trie(spark, conversations, monkeypatch, seed, turns):
    monkeypatch.setattr(trie, "TURNS", turns)
    monkeypatch.setattr(trie, "PIECE", 5)
    rows = shared(seed)
    assert nodes_of(trie.prefix_trie(trie.rebuilt(conversations(rows)))) == brute_trie(rows)


def test_trie_edges(conversations):
    assert trie.prefix_trie(trie.rebuilt(conversations([]).limit(0))).count() == 0
    rows = [(None, 1, "user", "no id"), (7, None, None, None), (7, 2, "user", "x" * 100_000), (-3, 1, "a", "b")]
    rows += [(40, t, "user", f"turn {t // 2}") for t in range(100)] + [(c, t, "user", "again") for c in range(800, 860) for t in range(6)]
    assert nodes_of(trie.prefix_trie(trie.rebuilt(conversations(rows)))) == brute_trie([r for r in rows if r[0] != -3] + [(-3, 1, "a", "b")])


def test_trie_of_the_table(spark, folder):
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    assert nodes_of(trie.prefix_trie(trie.rebuilt(table))) == brute_trie([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


# -- repair ------------------------------------------------------------------------------


def damage(rows):
    for c, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        case = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if case:
            text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
            for _ in range(2 if case == 3 else 1):
                yield (c, turn, "user" if case == 4 else role, text)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        core = WORD.findall(text)
        out.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1][-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def all_repairs(rows, found):
    """The cheapest repair by trying every edit string, least cost first and least letters next."""
    pattern, n = re.compile("(s?(ua)+)?"), len(rows)
    best = None

    def prefix_ok(roles):
        return any(pattern.fullmatch(roles + more) for more in ("", "a", "ua"))

    def go(i, roles, cost, said, parts):
        nonlocal best
        if best and (cost, said) >= best[:2] or not prefix_ok(roles) or cost > 3 * n:
            return
        if i == n and pattern.fullmatch(roles):
            best = (cost, said, parts) if best is None or (cost, said) < best[:2] else best
        if i < n:
            _, _, role, text = rows[i]
            go(i + 1, roles, cost + 3, said + "D", parts)
            if found[i] not in ("blank", "duplicate"):
                extra = found[i] == "truncated"
                go(i + 1, roles + (role[:1] if role[:1] in "sua" and role[:1] else "?"), cost + extra, said + "K", [*parts, f"{role}:{text}"])
                for new in ("user", "assistant"):
                    go(i + 1, roles + new[0], cost + 2 + extra, said + "R", [*parts, f"{new}:{text}"])
        for new in ("user", "assistant"):
            go(i, roles + new[0], cost + 2, said + "I", [*parts, f"{new}:"])

    go(0, "", 0, "", [])
    return best


def brute_repair(rows, change=damage):
    out, after = set(), by_conversation(change(rows), " ")
    for c in {r[0] for r in rows}:
        mine = after.get(c, [])
        found = faults(mine)
        turns = {t[1] for t in mine if t[0]}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        firsts = [t[2][:1] for t in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(firsts))
        cost, said, parts = all_repairs(mine, found)
        digest = hashlib.sha256("\n".join(parts).encode()).hexdigest()
        out.add((c, gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, said, digest))
    return out


def rough(seed, n=120, most=7):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in sorted(rnd.sample(range(12), rnd.randrange(1, most))):
            role = rnd.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "sage"])
            rows.append((c if c else None, None if rnd.random() < 0.05 else turn, role, rnd.choice(["Yes.", "No", "", None, " \t", "Why? ", "Well!", f"text {turn}."])))
    return rows


@pytest.mark.parametrize("seed,block", [(1, 1 << 16), (2, 3)])
def test_repair(conversations, monkeypatch, seed, block):
    monkeypatch.setattr(repair, "ROWS", block)
    rows = rough(seed)
    assert nodes_of(repair.repair(repair.damaged(conversations(rows)))) == brute_repair(rows)


def test_repair_of_untouched_rows(conversations):
    rows = rough(3)
    assert nodes_of(repair.repair(repair.untouched(conversations(rows)))) == brute_repair(rows, lambda r: [tuple(" " if i > 1 and x is None else x for i, x in enumerate(t)) for t in r])


def test_repair_edges(conversations):
    assert repair.repair(repair.damaged(conversations([]).limit(0))).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    rows = [(5, gone, "user", "x")] + [(6, t, ("user", "assistant")[t % 2], "same words.") for t in range(3000)] + [(8, 1, "user", "y" * 300_000)]
    found = {r.conv_id: r for r in repair.repair(repair.damaged(conversations(rows))).collect()}
    assert tuple(found[5])[1:] == (0, 0, 0, 0, 0, 0, "", EMPTY)
    assert found[6].audit.count("D") > 2500 and found[8].audit in ("KI", "RI", "D")


def test_repair_of_the_table(spark, folder):
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert nodes_of(repair.repair(repair.damaged(table))) == brute_repair(rows)
